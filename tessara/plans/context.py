"""Context: register tables, run the dialect's SQL, look at schemas and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import csv as csv_source
from ..sources.csv import CsvOptions
from .errors import PlanError
from .parser import parse
from .planner import Planner, kind_of


class Result:
    """A query's DataFrame with readers for cells, rows and a text table."""

    def __init__(self, df: DataFrame, explained: str | None = None):
        self.df, self.explained = df, explained

    def rows(self) -> list[tuple]:
        return [tuple(r) for r in self.df.collect()]

    def value(self, row: int, column: int) -> object:
        return self.rows()[row][column]

    def text_rows(self) -> list[list[str]]:
        return [[render(v) for v in r] for r in self.rows()]

    def to_table(self) -> str:
        if self.explained is not None:
            return self.explained
        body = [self.df.columns, *self.text_rows()]
        widths = [max(len(r[i]) for r in body) for i in range(len(self.df.columns))]
        line = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
        shown = ["|" + "|".join(f" {v:<{w}} " for v, w in zip(r, widths, strict=True)) + "|" for r in body]
        return "\n".join([line, shown[0], line, *shown[1:], line])


def render(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        return f"{value:.1f}"
    return str(value)


class Context:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: dict[str, DataFrame] = {}
        self._names: dict[str, str] = {}

    def register(self, name: str, df: DataFrame) -> Context:
        self._tables[name.lower()] = df
        self._names[name.lower()] = name
        return self

    def register_parquet(self, name: str, path: str) -> Context:
        return self.register(name, self.spark.read.parquet(path))

    def register_csv(self, name: str, path: str, options: CsvOptions | None = None) -> Context:
        return self.register(name, csv_source.read_csv(self.spark, path, options))

    def register_csv_text(self, name: str, text: str, options: CsvOptions | None = None) -> Context:
        return self.register(name, csv_source.read_csv_text(self.spark, text, options))

    def table_names(self) -> list[str]:
        return sorted(self._names.values())

    def schema_of(self, name: str) -> list[tuple[str, str]]:
        df = self._tables.get(name.lower())
        if df is None:
            raise PlanError(f"no table {name}")
        return [(f.name, kind_of(f.dataType)) for f in df.schema.fields]

    def plan(self, text: str) -> DataFrame:
        """The query as a DataFrame, not run."""
        return Planner(self.spark, self._tables).plan(parse(text))

    def sql(self, text: str) -> Result:
        """EXPLAIN gives all of Catalyst's plans as text and runs nothing."""
        query = parse(text)
        df = Planner(self.spark, self._tables).plan(query)
        if query.explain:
            return Result(df, df._explain_string("extended") if hasattr(df, "_explain_string") else _explained(df))
        return Result(df)


def _explained(df: DataFrame) -> str:
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    return out.getvalue()
