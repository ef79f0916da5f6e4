"""Strict type checking, and lowering of parsed queries to DataFrames.

Every column of a table gets an internal name, so self-joins and equal names
never clash.  Types are checked here; Catalyst sees null-on-error functions
only and keeps all of its rewrites.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import semantics as S
from .errors import PlanError, TypeMismatch
from .parser import Query, TableRef, show

AGGREGATES = {"COUNT", "SUM", "AVG", "MEAN", "MIN", "MAX"}
_NUMERIC = ("long", "double")
_FLIP = {"<": "<", ">": ">"}


@dataclass(frozen=True)
class Field:
    qualifier: str | None
    name: str
    kind: str
    column: str


@dataclass(frozen=True)
class Typed:
    column: Column
    kind: str


#: Arrays and the like: they are carried through, but nothing is computed from them.
OTHER = "other"


def kind_of(data_type: T.DataType) -> str:
    """The dialect's type of a Spark type."""
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "long"
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "double"
    for spark_type, kind in ((T.StringType, "string"), (T.BooleanType, "boolean"), (T.DateType, "date"), ((T.TimestampType, T.TimestampNTZType), "timestamp"), (T.NullType, "null")):
        if isinstance(data_type, spark_type):
            return kind
    raise PlanError(f"columns of type {data_type.simpleString()} are not supported")


def unify(a: str, b: str, what: str) -> str:
    if OTHER in (a, b):
        raise TypeMismatch(f"{what}: arrays, maps and structs can only be selected")
    if a == b or b == "null":
        return a
    if a == "null":
        return b
    if {a, b} == set(_NUMERIC):
        return "double"
    raise TypeMismatch(f"{what}: {a} and {b} do not go together")


def _widen(x: Typed, kind: str) -> Column:
    return x.column if x.kind == kind else S.cast(x.column, x.kind, kind)


class Scope:
    """Names in reach, and expressions that an aggregation has already computed."""

    def __init__(self, fields: list[Field], made: dict[tuple, Typed] | None = None, grouped: bool = False):
        self.fields, self.made, self.grouped = fields, made or {}, grouped

    def find(self, qualifier: str | None, name: str) -> Field:
        hits = [f for f in self.fields if f.name.lower() == name.lower() and (qualifier is None or (f.qualifier or "").lower() == qualifier.lower())]
        full = f"{qualifier}.{name}" if qualifier else name
        if len(hits) > 1:
            raise PlanError(f"column {full} is ambiguous")
        if not hits:
            raise PlanError(f"no column {full}; there are {', '.join(f.name for f in self.fields) or 'none'}")
        return hits[0]

    def canonical(self, e: tuple) -> tuple:
        """The expression with its columns resolved, for comparison."""
        if e and e[0] == "col":
            return ("col", None, self.find(e[1], e[2]).column)
        return tuple(self.canonical(x) if isinstance(x, tuple) else x for x in e)

    def lower(self, e: tuple) -> Typed:
        if self.made and e[0] != "lit":
            known = self.made.get(self.canonical(e))
            if known:
                return known
        return getattr(self, f"_{e[0]}")(*e[1:])

    def boolean(self, e: tuple, what: str) -> Column:
        x = self.lower(e)
        if x.kind not in ("boolean", "null"):
            raise TypeMismatch(f"{what} must be boolean, not {x.kind}: {show(e)}")
        return x.column.cast("boolean")

    def _lit(self, value: object, kind: str) -> Typed:
        if kind == "null":
            return Typed(F.lit(None), "null")
        return Typed(F.lit(value).cast(S.TYPES[kind]), kind)

    def _col(self, qualifier: str | None, name: str) -> Typed:
        f = self.find(qualifier, name)
        if self.grouped:
            raise PlanError(f"column {f.name} must be in GROUP BY or inside an aggregate")
        return Typed(F.col(f.column), f.kind)

    def _star(self) -> Typed:
        raise PlanError("* is only an argument of COUNT")

    def _un(self, op: str, e: tuple) -> Typed:
        if op == "NOT":
            return Typed(~self.boolean(e, "NOT"), "boolean")
        x = self.lower(e)
        if x.kind not in (*_NUMERIC, "null"):
            raise TypeMismatch(f"cannot negate {x.kind}: {show(e)}")
        return Typed(S.negate(x.column, x.kind), x.kind)

    def _bin(self, op: str, left: tuple, right: tuple) -> Typed:
        if op in ("AND", "OR"):
            a, b = self.boolean(left, op), self.boolean(right, op)
            return Typed(a & b if op == "AND" else a | b, "boolean")
        a, b = self.lower(left), self.lower(right)
        if op in ("=", "<>", "<", "<=", ">", ">="):
            return Typed(self._compare(op, a, b, show(("bin", op, left, right))), "boolean")
        for x in (a, b):
            if x.kind not in (*_NUMERIC, "null"):
                raise TypeMismatch(f"{op} takes numbers, not {x.kind}: {show(('bin', op, left, right))}")
        if op == "/":
            return Typed(S.divide(a.column, b.column), "double")
        kind = unify(a.kind, b.kind, op)
        if kind == "null":
            return Typed(F.lit(None), "null")
        if op == "*":
            return Typed(S.multiply(_widen(a, kind), _widen(b, kind), kind), kind)
        make: Callable = {"+": S.add, "-": S.subtract, "%": S.remainder}[op]
        return Typed(make(_widen(a, kind), _widen(b, kind)), kind)

    def _compare(self, op: str, a: Typed, b: Typed, shown: str) -> Column:
        kind = unify(a.kind, b.kind, shown)
        if kind == "null":
            return F.lit(None).cast("boolean")
        x, y = _widen(a, kind), _widen(b, kind)
        return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    def _isnull(self, e: tuple, negated: bool) -> Typed:
        x = self.lower(e).column
        return Typed(x.isNotNull() if negated else x.isNull(), "boolean")

    def _in(self, e: tuple, items: tuple, negated: bool) -> Typed:
        x, others = self.lower(e), [self.lower(i) for i in items]
        if not others:
            return Typed(F.lit(negated), "boolean")
        kind = x.kind
        for i in others:
            kind = unify(kind, i.kind, "IN")
        if kind == "null":
            return Typed(F.lit(None).cast("boolean"), "boolean")
        found = _widen(x, kind).isin(*[_widen(i, kind) for i in others])
        return Typed(~found if negated else found, "boolean")

    def _between(self, e: tuple, low: tuple, high: tuple, negated: bool) -> Typed:
        inside = ("bin", "AND", ("bin", ">=", e, low), ("bin", "<=", e, high))
        return self.lower(("un", "NOT", inside) if negated else inside)

    def _like(self, e: tuple, pattern: tuple, negated: bool) -> Typed:
        x, p = self.lower(e), self.lower(pattern)
        for t in (x, p):
            if t.kind not in ("string", "null"):
                raise TypeMismatch(f"LIKE takes strings, not {t.kind}")
        found = S.like(x.column.cast("string"), p.column.cast("string"))
        return Typed(~found if negated else found, "boolean")

    def _case(self, branches: tuple, otherwise: tuple | None) -> Typed:
        whens = [self.boolean(w, "WHEN") for w, _ in branches]
        thens = [self.lower(t) for _, t in branches]
        rest = self.lower(otherwise) if otherwise is not None else Typed(F.lit(None), "null")
        kind = rest.kind
        for t in thens:
            kind = unify(kind, t.kind, "CASE")
        if kind == "null":
            return Typed(F.lit(None), "null")
        out = F.when(whens[0], _widen(thens[0], kind))
        for w, t in zip(whens[1:], thens[1:], strict=True):
            out = out.when(w, _widen(t, kind))
        return Typed(out.otherwise(_widen(rest, kind)), kind)

    def _cast(self, e: tuple, kind: str) -> Typed:
        x = self.lower(e)
        return Typed(S.cast(x.column, x.kind, kind), kind)

    def _call(self, name: str, distinct: bool, args: tuple) -> Typed:
        if name not in AGGREGATES:
            raise PlanError(f"unknown function {name}")
        raise PlanError(f"{name} is an aggregate and cannot stand here")

    def aggregate(self, e: tuple) -> Typed:
        """An aggregate call over the input rows."""
        _, name, distinct, args = e
        if len(args) != 1:
            raise PlanError(f"{name} takes one argument")
        if args[0] == ("star",):
            if name != "COUNT":
                raise PlanError(f"{name}(*) has no meaning")
            return Typed(F.count(F.lit(1)), "long")
        x = self.lower(args[0])
        if name == "COUNT":
            return Typed(F.count_distinct(x.column) if distinct else F.count(x.column), "long")
        if name in ("MIN", "MAX"):
            return Typed((F.min if name == "MIN" else F.max)(x.column), x.kind)
        if x.kind not in (*_NUMERIC, "null"):
            raise TypeMismatch(f"{name} takes numbers, not {x.kind}")
        if name == "SUM":
            return Typed(S.sum_(_widen(x, "double") if x.kind == "null" else x.column, distinct, x.kind), x.kind if x.kind != "null" else "double")
        column = _widen(x, "double")
        return Typed(F.try_divide(F.sum_distinct(column), F.count_distinct(column)) if distinct else F.avg(column), "double")


def aggregates_in(e: object) -> list[tuple]:
    """Aggregate calls inside an expression, outermost first."""
    if not isinstance(e, tuple) or not e:
        return []
    if e[0] == "call" and e[1] in AGGREGATES:
        if any(aggregates_in(a) for a in e[3]):
            raise PlanError(f"aggregates cannot be nested: {show(e)}")
        return [e]
    return [a for x in e for a in aggregates_in(x)]


class Planner:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark, self.tables = spark, tables

    def scan(self, ref: TableRef, number: int) -> tuple[DataFrame, list[Field]]:
        df = self.tables.get(ref.name.lower())
        if df is None:
            raise PlanError(f"no table {ref.name}; there are {', '.join(sorted(self.tables)) or 'none'}")
        fields, columns = [], []
        for i, f in enumerate(df.schema.fields):
            try:
                kind = kind_of(f.dataType)
            except PlanError:
                kind = OTHER
            name, column = f"t{number}_{i}", "`" + f.name.replace("`", "``") + "`"
            fields.append(Field(ref.alias or ref.name, f.name, kind, name))
            plain = kind in ("null", OTHER) or f.dataType.simpleString() == S.TYPES[kind]
            columns.append(f"{column} AS {name}" if plain else f"CAST({column} AS {S.TYPES[kind]}) AS {name}")
        return df.selectExpr(*columns), fields  # one call to the JVM, however many columns there are

    def source(self, tables: list[TableRef]) -> tuple[DataFrame, list[Field]]:
        if not tables:
            return self.spark.range(1).select(), []
        df, fields = self.scan(tables[0], 0)
        for k, ref in enumerate(tables[1:], 1):
            other, more = self.scan(ref, k)
            fields = fields + more
            if ref.how == "cross":
                df = df.crossJoin(other)
            else:
                df = df.join(other, Scope(fields).boolean(ref.on, "ON"), ref.how)
        names = [(t.alias or t.name).lower() for t in tables]
        if len(set(names)) < len(names):
            raise PlanError("two tables go by one name")
        return df, fields

    def plan(self, q: Query) -> DataFrame:
        df, fields = self.source(q.tables)
        scope = Scope(fields)
        if q.where is not None:
            if aggregates_in(q.where):
                raise PlanError("WHERE cannot hold aggregates")
            df = df.filter(scope.boolean(q.where, "WHERE"))
        items = self.expand(q, fields)
        aliases = {a.lower(): e for e, a in items if a}
        groups = [self.group_key(e, items, aliases) for e in q.groups]
        orders = [(self.order_key(e, items, aliases), up) for e, up in q.orders]
        calls = [a for e in [*[e for e, _ in items], q.having, *[e for e, _ in orders]] for a in aggregates_in(e)]
        if groups or calls:
            df, scope = self.aggregated(df, scope, groups, calls)
        if q.having is not None:
            if not (groups or calls):
                raise PlanError("HAVING needs GROUP BY or an aggregate")
            df = df.filter(scope.boolean(q.having, "HAVING"))

        made = [scope.lower(e) for e, _ in items]
        shown = [x.column.alias(f"o{i}") for i, x in enumerate(made)]
        keys, hidden = [], []
        known = {self.key_of(scope, e): f"o{i}" for i, (e, _) in reversed(list(enumerate(items)))}
        for e, up in orders:
            at = known.get(self.key_of(scope, e))
            if at is None:
                if q.distinct:
                    raise PlanError(f"with DISTINCT, ORDER BY takes selected columns only: {show(e)}")
                at = f"h{len(hidden)}"
                hidden.append(scope.lower(e).column.alias(at))
            keys.append(S.ordered(F.col(at), up))
        df = df.select(*shown, *hidden)
        if q.distinct:
            df = df.distinct()
        if keys:
            df = df.orderBy(*keys)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return df.select(*[F.col(f"o{i}").alias(a or (e[2] if e[0] == "col" else show(e))) for i, (e, a) in enumerate(items)])

    @staticmethod
    def key_of(scope: Scope, e: tuple) -> tuple:
        return scope.canonical(e)

    def expand(self, q: Query, fields: list[Field]) -> list[tuple]:
        items = []
        for item in q.items:
            if item[0] != "star":
                items.append(item)
                continue
            own = [f for f in fields if item[1] is None or (f.qualifier or "").lower() == item[1].lower()]
            if not own:
                raise PlanError(f"nothing to expand {item[1]}.* from" if item[1] else "* needs a table")
            items += [(("col", f.qualifier, f.name), None) for f in own]
        return items

    def ordinal(self, e: tuple, items: list[tuple], clause: str) -> tuple | None:
        if e[0] == "lit" and e[2] == "long":
            if not 1 <= e[1] <= len(items):
                raise PlanError(f"{clause} position {e[1]} is not in the select list")
            return items[e[1] - 1][0]
        return None

    def group_key(self, e: tuple, items: list[tuple], aliases: dict[str, tuple]) -> tuple:
        """An ordinal, else an alias (which wins over a column of that name), else the expression."""
        found = self.ordinal(e, items, "GROUP BY")
        if found is None and e[0] == "col" and e[1] is None:
            found = aliases.get(e[2].lower())
        found = e if found is None else found
        if aggregates_in(found):
            raise PlanError("GROUP BY cannot hold aggregates")
        return found

    def order_key(self, e: tuple, items: list[tuple], aliases: dict[str, tuple]) -> tuple:
        found = self.ordinal(e, items, "ORDER BY")
        if found is None and e[0] == "col" and e[1] is None:
            found = aliases.get(e[2].lower())
        return e if found is None else found

    def aggregated(self, df: DataFrame, scope: Scope, groups: list[tuple], calls: list[tuple]) -> tuple[DataFrame, Scope]:
        made: dict[tuple, Typed] = {}
        keys, values = [], []
        for e in groups:
            canonical = scope.canonical(e)
            if canonical not in made:
                x = scope.lower(e)
                made[canonical] = Typed(F.col(f"g{len(keys)}"), x.kind)
                keys.append(x.column.alias(f"g{len(keys)}"))
        for e in calls:
            canonical = scope.canonical(e)
            if canonical not in made:
                x = scope.aggregate(e)
                made[canonical] = Typed(F.col(f"a{len(values)}"), x.kind)
                values.append(x.column.alias(f"a{len(values)}"))
        grouped = df.groupBy(*keys)
        out = grouped.agg(*values) if values else df.select(*keys).distinct()
        return out, Scope(scope.fields, made, grouped=True)
