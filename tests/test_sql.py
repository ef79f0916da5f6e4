import datetime as dt

import pytest

from tessara.plans import cli
from tessara.plans.context import Context
from tessara.plans.errors import ParseError, PlanError, SourceError, TypeMismatch
from tessara.plans.parser import parse, show
from tessara.sources.csv import CsvOptions, read_csv_text

#: Small tables and what queries on them give.
TRIPS = """id,city,fare,rider,tip,day
1,Austin,12.50,ann,2.0,2024-01-05
2,Dallas,8.00,bob,,2024-01-06
3,Austin,20.00,cat,4.5,2024-01-06
4,Dallas,30.00,dan,0.0,2024-01-07
5,Austin,5.25,ann,1.0,2024-01-08
6,Houston,45.00,eve,9.0,2024-01-08
7,Dallas,,frank,3.0,2024-01-09
"""
CITIES = "name,state,pop\nAustin,TX,961855\nDallas,TX,1304379\nSeattle,WA,749256\n"


@pytest.fixture(scope="module")
def ctx(spark):
    c = Context(spark).register_csv_text("trips", TRIPS).register_csv_text("cities", CITIES)
    return c.register_csv_text("n", "x\n1\n2\n")


def rows(ctx, sql):
    return ctx.sql(sql).rows()


def ids(ctx, tail):
    return [r[0] for r in rows(ctx, f"SELECT id FROM trips {tail}")]


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT 10 / 4, 7 / 2, 7 % 2, 1 / 0, 1 % 0", [(2.5, 3.5, 1, None, None)]),
        ("SELECT 9223372036854775807 + 1, 2 - 3, -2 * 4", [(None, -1, -8)]),
        ("SELECT COUNT(*), COUNT(fare), MIN(fare), MAX(fare), SUM(fare) FROM trips", [(7, 6, 5.25, 45.0, 120.75)]),
        ("SELECT city, COUNT(*) AS n, SUM(fare), MAX(fare) FROM trips GROUP BY city ORDER BY n DESC, city LIMIT 2", [("Austin", 3, 37.75, 20.0), ("Dallas", 3, 38.0, 30.0)]),
        ("SELECT SUM(fare) / COUNT(fare) FROM trips", [(20.125,)]),
        ("SELECT SUM(fare), COUNT(fare) FROM trips WHERE id > 100", [(None, 0)]),
        ("SELECT COUNT(DISTINCT city), COUNT(DISTINCT rider) FROM trips", [(3, 6)]),
        ("SELECT SUM(DISTINCT x), AVG(x) FROM n", [(3, 1.5)]),
        ("SELECT CAST('42' AS INT), CAST(42 AS TEXT), CAST(3.9 AS INT), CAST('banana' AS INT)", [(42, "42", 3, None)]),
        ("SELECT CAST('yes' AS BOOL), CAST('2024-1-5' AS DATE), CAST(2.0 AS TEXT), CAST('2024-01-05' AS DATE)", [(True, None, "2.0", dt.date(2024, 1, 5))]),
        ("SELECT NULL AND FALSE, NULL OR TRUE, NOT NULL, NULL = 1", [(False, True, None, None)]),
        ("SELECT 1 IN (), 1 NOT IN (), 1 IN (2, NULL), 'a' LIKE 'A', 'a\\b' LIKE 'a\\_'", [(False, True, None, False, True)]),
        ("SELECT LENGTH FROM (SELECT 1)", None),
        ("SELECT t.city, c.state FROM trips t JOIN cities c ON t.city = c.name AND c.pop > 1000000", [("Dallas", "TX")] * 3),
        ("SELECT city AS rider, COUNT(*) FROM trips GROUP BY rider ORDER BY 1", [("Austin", 3), ("Dallas", 3), ("Houston", 1)]),
        ("SELECT DISTINCT city FROM trips ORDER BY city DESC LIMIT 1 OFFSET 1", [("Dallas",)]),
        ("SELECT city FROM trips GROUP BY city HAVING COUNT(*) > 1 ORDER BY SUM(fare)", [("Austin",), ("Dallas",)]),
        ("SELECT rider FROM trips ORDER BY day DESC, id LIMIT 2", [("frank",), ("ann",)]),
        ("SELECT COUNT(*) FROM trips a JOIN trips b ON a.city = b.city AND a.id < b.id", [(6,)]),
    ],
)
def test_goldens(ctx, sql, want):
    if want is None:
        with pytest.raises(ParseError):
            ctx.sql(sql)
    else:
        assert rows(ctx, sql) == want


def test_filters_and_orders(ctx):
    assert ids(ctx, "WHERE fare > 15 ORDER BY id") == [3, 4, 6]
    assert ids(ctx, "ORDER BY fare DESC")[1:] == [6, 4, 3, 1, 2, 5] and ids(ctx, "ORDER BY fare")[-1] == 7
    assert len(ids(ctx, "WHERE city IN ('Austin', 'Houston')")) == 4 and ids(ctx, "WHERE fare BETWEEN 10 AND 25 ORDER BY id") == [1, 3]
    assert [len(ids(ctx, f"WHERE {p}")) for p in ("city LIKE 'A%'", "city LIKE '%as%'", "rider LIKE '_nn'", "city NOT LIKE 'A%'")] == [3, 3, 2, 4]
    assert ids(ctx, "WHERE day > CAST('2024-01-07' AS DATE) ORDER BY id") == [5, 6, 7]
    case = "SELECT CASE WHEN fare > 25 THEN 'high' WHEN fare > 10 THEN 'mid' ELSE 'low' END FROM trips WHERE id < 7 ORDER BY id"
    assert [r[0] for r in rows(ctx, case)] == ["mid", "low", "mid", "high", "low", "high"]


def test_joins(ctx):
    j = "FROM trips t {} cities c ON t.city = c.name"
    assert len(rows(ctx, "SELECT * " + j.format("JOIN"))) == 6
    left = rows(ctx, "SELECT t.id, c.state " + j.format("LEFT JOIN"))
    assert len(left) == 7 and (6, None) in left
    assert (None, "Seattle") in rows(ctx, "SELECT t.id, c.name " + j.format("RIGHT OUTER JOIN"))
    assert len(rows(ctx, "SELECT * FROM trips CROSS JOIN cities")) == len(rows(ctx, "SELECT * FROM trips, cities")) == 21
    assert len(rows(ctx, "SELECT t.id " + j.format("LEFT JOIN") + " AND c.pop > 1000000")) == 7


@pytest.mark.parametrize("bad", ["SELECT", "SELECT FROM t", "SELECT a FROM", "SELECT a FROM t WHERE", "SELECT a FROM t GROUP a", "SELECT a FROM t ORDER a", "SELECT a FROM t LIMIT x", "SELECT a FROM t JOIN u", "SELECT 'open", 'SELECT "open', "SELECT /* open", "SELECT a ! b", "SELECT CASE END", "SELECT a FROM t t2 t3", "SELECT a, FROM t", "SELECT a FROM t WHERE b IN"])
def test_malformed(bad):
    with pytest.raises(ParseError, match="line 1, column"):
        parse(bad)


@pytest.mark.parametrize(
    ("sql", "error"),
    [
        ("SELECT city + 1 FROM trips", TypeMismatch), ("SELECT id FROM trips WHERE city > 1", TypeMismatch), ("SELECT id FROM trips WHERE fare", TypeMismatch),
        ("SELECT SUM(city) FROM trips", TypeMismatch), ("SELECT -city FROM trips", TypeMismatch), ("SELECT CASE WHEN TRUE THEN 1 ELSE 'a' END", TypeMismatch),
        ("SELECT nope FROM trips", PlanError), ("SELECT id FROM nope", PlanError), ("SELECT name FROM cities a, cities b", PlanError), ("SELECT id, COUNT(*) FROM trips", PlanError),
        ("SELECT id FROM trips HAVING id > 1", PlanError), ("SELECT SUM(COUNT(*)) FROM trips", PlanError), ("SELECT UPPER(city) FROM trips", PlanError), ("SELECT SUM(*) FROM trips", PlanError),
        ("SELECT id FROM trips ORDER BY 2", PlanError), ("SELECT DISTINCT city FROM trips ORDER BY id", PlanError), ("SELECT id FROM trips WHERE COUNT(*) > 1", PlanError), ("SELECT x.* FROM trips", PlanError), ("SELECT *", PlanError),
    ],
)
def test_plan_errors(ctx, sql, error):
    with pytest.raises(error):
        ctx.sql(sql)


def test_precedence():
    for text, want in [("1 + 2 * 3", "(1 + (2 * 3))"), ("a = b IS NULL", "(a = (b IS NULL))"), ("NOT a = b AND c", "((NOT (a = b)) AND c)"), ("-2 - -x", "(-2 - (-x))"), ("a OR b AND c", "(a OR (b AND c))"), ("a NOT IN (1, 2) AND b", "((a NOT IN (1, 2)) AND b)"), ("a - b - c", "((a - b) - c)")]:
        assert show(parse(f"SELECT {text}").items[0][0]) == want


def test_csv(spark):
    df = read_csv_text(spark, 'i,f,s,b,d,m,z\n1,1.5,"x, ""y""",true,2024-01-05,1,\n-2,3, pad ,false,NA,x,NULL\n')
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "string", "boolean", "date", "string", "string"]
    assert [tuple(r) for r in df.collect()][0] == (1, 1.5, 'x, "y"', True, dt.date(2024, 1, 5), "1", None)
    assert df.collect()[1].s == "pad"
    late = read_csv_text(spark, "a\n1\n2\nx\n", CsvOptions(infer_rows=2))
    assert [r.a for r in late.collect()] == [1, 2, None]
    bare = read_csv_text(spark, "1;a\n2;b\n", CsvOptions(has_header=False, delimiter=";"))
    assert bare.columns == ["column_1", "column_2"] and bare.count() == 2
    with pytest.raises(SourceError):
        read_csv_text(spark, " \n")
    for ragged in ("a,b\n1\n", "a,b\n1,2,3\n"):
        with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
            read_csv_text(spark, ragged).collect()


def test_plans_push_down(spark):
    c = Context(spark).register_parquet("lineitem", "/root/testdata/sf0.001/lineitem.parquet").register_parquet("orders", "/root/testdata/sf0.001/orders.parquet")
    text = c.sql("EXPLAIN SELECT o_orderpriority, SUM(l_quantity) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 10 GROUP BY o_orderpriority").to_table()
    physical = text[text.index("Physical Plan") :]
    assert "GreaterThan(l_quantity,10.0)" in physical and "l_extendedprice" not in physical and "Cartesian" not in physical and "NestedLoop" not in physical


def test_shell(ctx):
    said = []
    cli.shell(ctx, [".tables\n", ".schema cities\n", "SELECT COUNT(*) AS n\n", "FROM trips;\n", "SELECT nope;\n", ".timing off\n", "SELECT 1;\n", ".what\n", ".quit\n", "SELECT 2;\n"], said.append)
    assert said[0].split() == ["cities", "n", "trips"] and "pop long" in said[1] and "| 7 |" in said[2] and "(1 row) in" in said[2] and said[3].startswith("error:") and said[5].endswith("(1 row)") and len(said) == 7


def test_star_carries_arrays_and_distinct_sums_overflow_to_null(spark):
    from pyspark.sql import functions as F

    from tessara.plans.errors import PlanError

    top = 2**63 - 1
    rows = spark.createDataFrame([(1, top, [1.5, 2.0]), (1, top, None), (1, 5, []), (2, 7, [0.0]), (2, 7, [1.0])], "g long, x long, v array<double>")
    ctx = Context(spark).register("t", rows.withColumn("m", F.create_map(F.lit("a"), "x")))
    got = ctx.plan("SELECT * FROM t WHERE g = 2")
    assert got.columns == ["g", "x", "v", "m"] and sorted(tuple(r) for r in got.collect()) == [(2, 7, [0.0], {"a": 7}), (2, 7, [1.0], {"a": 7})]
    assert sorted(map(tuple, ctx.plan("SELECT g, SUM(DISTINCT x) AS s FROM t GROUP BY g").collect())) == [(1, None), (2, 7)]
    for bad in ("SELECT v + 1 FROM t", "SELECT g FROM t WHERE v = m", "SELECT SUM(v) FROM t"):
        with pytest.raises(PlanError):
            ctx.plan(bad)


def test_products_that_overflow_raise_no_exceptions(spark):
    from pyspark.sql import functions as F

    from tessara.functions import semantics as S

    top = 2**63 - 1
    pairs = [(top, 1), (-(2**63), 1), (-(2**63), -1), (3037000499, 3037000500), (3037000500, 3037000500), (top, 2), (top, top), (2**62, 2), (2**62, -2), (0, top), (None, 2)]
    df = spark.createDataFrame(pairs, "a long, b long")
    want = [None if a is None or not -(2**63) <= a * b <= top else a * b for a, b in pairs]
    assert [r.p for r in df.select(S.multiply(F.col("a"), F.col("b"), "long").alias("p")).collect()] == want
    plan = df.select(S.multiply(F.col("a"), F.col("b"), "long").alias("p"))._jdf.queryExecution().toString()
    assert "9.3E18" in plan  # what surely overflows is not multiplied
