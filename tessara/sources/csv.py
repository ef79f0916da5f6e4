"""CSV with the dialect's inference: types widen over the first rows, misfits become null.

Files are read by Spark's CSV source as strings and split as usual; only a
bounded head is looked at to infer types.
"""

from __future__ import annotations

import csv as _csv
import io
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import semantics as S
from ..plans.errors import SourceError


@dataclass(frozen=True)
class CsvOptions:
    has_header: bool = True
    delimiter: str = ","
    infer_rows: int = 1000
    null_values: tuple[str, ...] = ("NULL", "null", "NA", "\\N")


def _empty(column: Column, options: CsvOptions) -> Column:
    text = F.trim(column)
    return column.isNull() | (text == "") | text.isin(*options.null_values)


_FITS = {
    "boolean": lambda c: F.lower(F.trim(c)).isin("true", "false"),
    "long": lambda c: F.trim(c).rlike(r"^[+-]?\d+$") & F.trim(c).try_cast("bigint").isNotNull(),
    "double": lambda c: F.trim(c).rlike(r"(?i)^[+-]?(\d+\.?\d*([e][+-]?\d+)?|\.\d+([e][+-]?\d+)?|inf|infinity|nan)$"),
    "date": lambda c: F.trim(c).rlike(r"^\d{4}-\d{2}-\d{2}$") & F.trim(c).try_cast("date").isNotNull(),
}


def infer(raw: DataFrame, options: CsvOptions) -> dict[str, str]:
    """The narrowest type that all non-null cells of the head fit; string for none and for mixed ones."""
    head = raw.limit(options.infer_rows)
    wanted = []
    for i, name in enumerate(raw.columns):
        cell = F.col(f"`{name}`")
        here = ~_empty(cell, options)
        wanted.append(F.count(F.when(here, 1)).alias(f"n{i}"))
        for kind, fits in _FITS.items():
            wanted.append(F.count(F.when(here & fits(cell), 1)).alias(f"{kind}{i}"))
    seen = head.agg(*wanted).first()
    out = {}
    for i, name in enumerate(raw.columns):
        n = seen[f"n{i}"]
        out[name] = next((k for k in ("boolean", "long", "double", "date") if n and seen[f"{k}{i}"] == n), "string")
    return out


def typed(raw: DataFrame, options: CsvOptions) -> DataFrame:
    kinds = infer(raw, options)
    columns = []
    for name in raw.columns:
        cell, kind = F.col(f"`{name}`"), kinds[name]
        text = F.trim(cell)
        if kind == "double":
            low = F.lower(text)
            value = F.when(low.isin("inf", "+inf", "infinity"), F.lit(float("inf"))).when(low.isin("-inf", "-infinity"), F.lit(float("-inf"))).otherwise(text.try_cast("double"))
        else:
            value = text if kind == "string" else S.cast(text, "string", kind)
        columns.append(F.when(~_empty(cell, options), value).alias(name))
    return raw.select(*columns)


def _names(first: list[str], options: CsvOptions) -> list[str]:
    return [n.strip() for n in first] if options.has_header else [f"column_{i + 1}" for i in range(len(first))]


def _read(spark: SparkSession, source, first: str | None, options: CsvOptions) -> DataFrame:
    if first is None or not first.strip():
        raise SourceError("the CSV input is empty")
    names = _names(next(_csv.reader(io.StringIO(first), delimiter=options.delimiter)), options)
    internal = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    # FAILFAST turns a row with too few or too many fields into an error.
    raw = spark.read.schema(internal).options(header=options.has_header, sep=options.delimiter, quote='"', escape='"', mode="FAILFAST", enforceSchema=True).csv(source)
    return typed(raw.toDF(*names), options)


def read_csv(spark: SparkSession, path: str, options: CsvOptions | None = None) -> DataFrame:
    """A typed DataFrame of a CSV file or folder; a ragged row fails when it is read."""
    options = options or CsvOptions()
    head = spark.read.text(path).filter(F.trim("value") != "").first()
    return _read(spark, path, head.value if head else None, options)


def read_csv_text(spark: SparkSession, text: str, options: CsvOptions | None = None) -> DataFrame:
    """The same for CSV given as a string."""
    options = options or CsvOptions()
    lines = [x for x in text.splitlines() if x.strip()]
    # A small in-memory input: one partition keeps the header first.
    source = spark.sparkContext.parallelize(lines, 1)
    return _read(spark, source, lines[0] if lines else None, options)


def write_csv(df: DataFrame, path: str, options: CsvOptions | None = None) -> None:
    options = options or CsvOptions()
    df.write.options(header=options.has_header, sep=options.delimiter, quote='"', escape='"', nullValue="NULL").csv(path)
