"""Relational operators that are more than one call of the DataFrame API."""
