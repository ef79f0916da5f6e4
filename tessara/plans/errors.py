"""Errors by the stage that finds them."""


class EngineError(Exception):
    """Any error of the engine."""


class ParseError(EngineError):
    """The text is not a statement."""


class PlanError(EngineError):
    """A name, an argument or a clause does not fit."""


class TypeMismatch(PlanError):
    """Operands have types that the operator does not take."""


class SourceError(EngineError):
    """An input cannot be read as declared."""
