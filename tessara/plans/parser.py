"""Lexer and precedence-climbing parser of the SQL dialect.

Expressions are nested tuples, so they compare and hash by structure:
("lit", value, type), ("col", qualifier, name), ("un", op, e), ("bin", op, a, b),
("isnull", e, negated), ("in", e, items, negated), ("between", e, lo, hi, negated),
("like", e, pattern, negated), ("case", ((when, then), ...), otherwise),
("cast", e, type), ("call", NAME, distinct, args), ("star",).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .errors import ParseError

KEYWORDS = frozenset(
    """SELECT DISTINCT FROM WHERE GROUP BY HAVING ORDER ASC DESC LIMIT OFFSET AS AND OR NOT NULL TRUE FALSE IN
    BETWEEN LIKE IS CASE WHEN THEN ELSE END CAST JOIN INNER LEFT RIGHT FULL OUTER CROSS ON EXPLAIN INSERT CREATE
    TABLE INTO VALUES UNION""".split()
)
TYPE_NAMES = {n: t for t, names in {"long": "INT INTEGER BIGINT INT64", "double": "FLOAT DOUBLE REAL FLOAT64", "string": "TEXT STRING VARCHAR UTF8", "boolean": "BOOL BOOLEAN", "date": "DATE DATE32"}.items() for n in names.split()}
_TOKEN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|/\*.*?\*/)|(?P<num>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<quoted>"[^"]*")|(?P<str>'(?:[^']|'')*')|(?P<op><>|!=|<=|>=|[=<>+\-*/%(),.;])""",
    re.X | re.S,
)
_COMPARE = {"=": "=", "<>": "<>", "!=": "<>", "<": "<", "<=": "<=", ">": ">", ">=": ">="}


@dataclass
class Token:
    kind: str
    value: object
    at: int
    shown: str


@dataclass
class TableRef:
    name: str
    alias: str | None
    how: str = "first"
    on: tuple | None = None


@dataclass
class Query:
    items: list = field(default_factory=list)  # (expression, alias) or ("star", qualifier)
    distinct: bool = False
    tables: list[TableRef] = field(default_factory=list)
    where: tuple | None = None
    groups: list = field(default_factory=list)
    having: tuple | None = None
    orders: list = field(default_factory=list)  # (expression, ascending)
    limit: int | None = None
    offset: int = 0
    explain: bool = False


def where_is(text: str, at: int) -> str:
    line = text.count("\n", 0, at) + 1
    return f"line {line}, column {at - text.rfind(chr(10), 0, at)}"


def lex(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            kind = {"'": "string literal", '"': "quoted identifier"}.get(text[at])
            if text.startswith("/*", at):
                kind = "block comment"
            raise ParseError(f"unterminated {kind} at {where_is(text, at)}" if kind else f"unexpected character {text[at]!r} at {where_is(text, at)}")
        value = m[0]
        if m.lastgroup == "word":
            upper = value.upper()
            out.append(Token("kw", upper, at, upper) if upper in KEYWORDS else Token("id", value, at, value))
        elif m.lastgroup == "num":
            whole = value.isdigit() and int(value) < 2**63
            out.append(Token("int", int(value), at, value) if whole else Token("float", float(value), at, value))
        elif m.lastgroup == "quoted":
            out.append(Token("id", value[1:-1], at, value))
        elif m.lastgroup == "str":
            out.append(Token("str", value[1:-1].replace("''", "'"), at, value))
        elif m.lastgroup == "op":
            out.append(Token("op", value, at, value))
        at = m.end()
    out.append(Token("end", None, len(text), "end of input"))
    return out


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.i = text, lex(text), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def fail(self, message: str) -> ParseError:
        return ParseError(f"{message} at {where_is(self.text, self.now.at)} (found {self.now.shown})")

    def take(self, kind: str, *values: object) -> Token | None:
        t = self.now
        if t.kind == kind and (not values or t.value in values):
            self.i += 1
            return t
        return None

    def need(self, kind: str, *values: object) -> Token:
        found = self.take(kind, *values)
        if found is None:
            raise self.fail("expected " + (" or ".join(map(str, values)) or {"id": "a name", "int": "a whole number"}.get(kind, kind)))
        return found

    def several(self, one) -> list:
        out = [one()]
        while self.take("op", ","):
            out.append(one())
        return out

    def statement(self) -> Query:
        explain = bool(self.take("kw", "EXPLAIN"))
        query = self.query()
        query.explain = explain
        self.take("op", ";")
        if self.now.kind != "end":
            raise self.fail("expected end of statement")
        return query

    def query(self) -> Query:
        self.need("kw", "SELECT")
        q = Query(distinct=bool(self.take("kw", "DISTINCT")))
        q.items = self.several(self.item)
        if self.take("kw", "FROM"):
            q.tables = self.tables()
        if self.take("kw", "WHERE"):
            q.where = self.expression()
        if self.take("kw", "GROUP"):
            self.need("kw", "BY")
            q.groups = self.several(self.expression)
        if self.take("kw", "HAVING"):
            q.having = self.expression()
        if self.take("kw", "ORDER"):
            self.need("kw", "BY")
            q.orders = self.several(self.order)
        if self.take("kw", "LIMIT"):
            q.limit = self.need("int").value
        if self.take("kw", "OFFSET"):
            q.offset = self.need("int").value
        return q

    def item(self):
        if self.take("op", "*"):
            return ("star", None)
        ahead = self.tokens[self.i : self.i + 3]
        if [t.kind for t in ahead] == ["id", "op", "op"] and ahead[1].value == "." and ahead[2].value == "*":
            self.i += 3
            return ("star", ahead[0].value)
        return (self.expression(), self.alias())

    def alias(self) -> str | None:
        if self.take("kw", "AS"):
            return self.need("id").value
        found = self.take("id")
        return found.value if found else None

    def order(self):
        e = self.expression()
        down = self.take("kw", "DESC")
        if not down:
            self.take("kw", "ASC")
        return (e, not down)

    def tables(self) -> list[TableRef]:
        out = [TableRef(self.need("id").value, self.alias())]
        while True:
            if self.take("op", ","):
                how = "cross"
            elif self.take("kw", "CROSS"):
                self.need("kw", "JOIN")
                how = "cross"
            elif t := self.take("kw", "LEFT", "RIGHT"):
                self.take("kw", "OUTER")
                self.need("kw", "JOIN")
                how = t.value.lower()
            elif self.take("kw", "INNER"):
                self.need("kw", "JOIN")
                how = "inner"
            elif self.take("kw", "JOIN"):
                how = "inner"
            else:
                return out
            ref = TableRef(self.need("id").value, self.alias(), how)
            if how != "cross":
                self.need("kw", "ON")
                ref.on = self.expression()
            out.append(ref)

    def expression(self, least: int = 0) -> tuple:
        """Levels: OR 1, AND 2, comparison 3, postfix predicates 4, + - 5, * / % 6."""
        left = self.prefix()
        while True:
            t = self.now
            negated = t.kind == "kw" and t.value == "NOT" and self.tokens[self.i + 1].value in ("IN", "BETWEEN", "LIKE")
            word = self.tokens[self.i + 1].value if negated else t.value
            if t.kind == "kw" and word in ("IS", "IN", "BETWEEN", "LIKE") and least <= 4:
                self.i += 1 + negated
                left = self.postfix(left, word, negated)
                continue
            level = {"OR": 1, "AND": 2}.get(t.value, 0) if t.kind == "kw" else 0
            if t.kind == "op":
                level = 3 if t.value in _COMPARE else {"+": 5, "-": 5, "*": 6, "/": 6, "%": 6}.get(t.value, 0)
            if not level or level < least:
                return left
            self.i += 1
            left = ("bin", _COMPARE.get(t.value, t.value), left, self.expression(level + 1))

    def postfix(self, left: tuple, word: str, negated: bool) -> tuple:
        if word == "IS":
            inverted = bool(self.take("kw", "NOT"))
            self.need("kw", "NULL")
            return ("isnull", left, inverted)
        if word == "LIKE":
            return ("like", left, self.expression(5), negated)
        if word == "BETWEEN":
            low = self.expression(5)
            self.need("kw", "AND")
            return ("between", left, low, self.expression(5), negated)
        self.need("op", "(")
        items = [] if self.now.value == ")" and self.now.kind == "op" else self.several(self.expression)
        self.need("op", ")")
        return ("in", left, tuple(items), negated)

    def prefix(self) -> tuple:
        if self.take("kw", "NOT"):
            return ("un", "NOT", self.expression(3))
        if self.take("op", "+"):
            return self.expression(7)
        if self.take("op", "-"):
            e = self.expression(7)
            return ("lit", -e[1], e[2]) if e[0] == "lit" and e[2] in ("long", "double") else ("un", "-", e)
        return self.primary()

    def primary(self) -> tuple:
        for kind, type_ in (("int", "long"), ("float", "double"), ("str", "string")):
            if t := self.take(kind):
                return ("lit", t.value, type_)
        if t := self.take("kw", "TRUE", "FALSE"):
            return ("lit", t.value == "TRUE", "boolean")
        if self.take("kw", "NULL"):
            return ("lit", None, "null")
        if self.take("kw", "CASE"):
            return self.case()
        if self.take("kw", "CAST"):
            self.need("op", "(")
            e = self.expression()
            self.need("kw", "AS")
            name = self.need("id").value.upper()
            if name not in TYPE_NAMES:
                self.i -= 1
                raise self.fail(f"unknown type {name}")
            self.need("op", ")")
            return ("cast", e, TYPE_NAMES[name])
        if self.take("op", "("):
            e = self.expression()
            self.need("op", ")")
            return e
        if t := self.take("id"):
            if self.take("op", "("):
                return self.call(t.value.upper())
            if self.take("op", "."):
                return ("col", t.value, self.need("id").value)
            return ("col", None, t.value)
        raise self.fail("expected an expression")

    def call(self, name: str) -> tuple:
        distinct = bool(self.take("kw", "DISTINCT"))
        if self.take("op", "*"):
            args: tuple = (("star",),)
        elif self.now.kind == "op" and self.now.value == ")":
            args = ()
        else:
            args = tuple(self.several(self.expression))
        self.need("op", ")")
        return ("call", name, distinct, args)

    def case(self) -> tuple:
        branches = []
        while self.take("kw", "WHEN"):
            when = self.expression()
            self.need("kw", "THEN")
            branches.append((when, self.expression()))
        if not branches:
            raise self.fail("expected WHEN")
        otherwise = self.expression() if self.take("kw", "ELSE") else None
        self.need("kw", "END")
        return ("case", tuple(branches), otherwise)


def parse(text: str) -> Query:
    return Parser(text).statement()


def show(e: tuple) -> str:
    """The canonical text of an expression."""
    kind = e[0]
    if kind == "lit":
        if e[2] == "string":
            return "'" + e[1].replace("'", "''") + "'"
        return {None: "NULL", True: "TRUE", False: "FALSE"}.get(e[1], str(e[1])) if e[2] in ("null", "boolean") else str(e[1])
    if kind == "col":
        return f"{e[1]}.{e[2]}" if e[1] else e[2]
    if kind == "star":
        return "*"
    if kind == "un":
        return f"(NOT {show(e[2])})" if e[1] == "NOT" else f"(-{show(e[2])})"
    if kind == "bin":
        return f"({show(e[2])} {e[1]} {show(e[3])})"
    no = "NOT " if e[-1] is True else ""
    if kind == "isnull":
        return f"({show(e[1])} IS {no}NULL)"
    if kind == "in":
        return f"({show(e[1])} {no}IN ({', '.join(map(show, e[2]))}))"
    if kind == "between":
        return f"({show(e[1])} {no}BETWEEN {show(e[2])} AND {show(e[3])})"
    if kind == "like":
        return f"({show(e[1])} {no}LIKE {show(e[2])})"
    if kind == "cast":
        return f"CAST({show(e[1])} AS {e[2].upper()})"
    if kind == "call":
        return f"{e[1]}({'DISTINCT ' if e[2] else ''}{', '.join(map(show, e[3]))})"
    branches = " ".join(f"WHEN {show(w)} THEN {show(t)}" for w, t in e[1])
    return f"CASE {branches}{f' ELSE {show(e[2])}' if e[2] is not None else ''} END"
