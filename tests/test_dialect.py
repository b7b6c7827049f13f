import pytest
from pyspark.errors import AnalysisException, ParseException

from tidemark.engine import Engine
from tidemark.functions.dialect import DialectError, glob, strftime, translate
from tidemark.plans.usage import CoAccess, IndexPolicy, PathPolicy, Usage, column_name, column_type


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(1, "ab", '{"a": {"b": 5}}'), (2, "CD", "{}"), (3, None, "no json")], "k long, s string, payload string"))
    return e


@pytest.mark.parametrize("text", ["", "DELETE FROM t", "SELECT 1; SELECT 2", "SELECT 'open", "SELECT ifnull(1", "INSERT INTO t VALUES (1)"])
def test_only_one_select(text):
    with pytest.raises(DialectError):
        translate(text)


@pytest.mark.parametrize("text", ["SELECT * FROM t WHERE k =", "SELECT * FROM t garbage here"])
def test_syntax_errors_are_raised(engine, text):
    with pytest.raises(ParseException):
        engine.sql(text)


def test_unknown_columns_are_raised(engine):
    with pytest.raises(AnalysisException):
        engine.sql("SELECT nothing FROM t")


@pytest.mark.parametrize(
    ("text", "rows"),
    [
        ("SELECT k FROM t WHERE s LIKE 'A%'", [(1,)]),
        ("SELECT k FROM t WHERE s NOT LIKE 'A%'", [(2,)]),
        ("SELECT k FROM t WHERE k NOT IN (1, 2)", [(3,)]),
        ("SELECT k FROM t WHERE k NOT BETWEEN 1 AND 2;", [(3,)]),
        ("SELECT 'it''s' AS a, 'x.y' AS b, 'a\\b' AS c", [("it's", "x.y", "a\\b")]),
        ("SELECT t.k FROM t WHERE t.s IS NULL", [(3,)]),
        ("SELECT CAST(json_extract(payload, '$.a.b') AS INT) AS x FROM t WHERE k = 1", [(5,)]),
        ("SELECT k FROM t WHERE json_valid(payload) ORDER BY k DESC", [(2,), (1,)]),
        ("SELECT group_concat(k, '-') AS g FROM t WHERE k < 2", [("1",)]),
        ("SELECT int_div(7, 2) AS a, int_div(7, 0) AS b", [(3, None)]),
        ("SELECT k FROM t ORDER BY s", [(3,), (2,), (1,)]),
        ("SELECT k FROM t ORDER BY k OFFSET 2", [(3,)]),
        ("SELECT COUNT(*) AS count FROM t WHERE k > 99", [(0,)]),
        ("SELECT 1.5 AS x, -2 AS y, 'LIKE' AS z", [(pytest.approx(1.5), -2, "LIKE")]),
        ("SELECT quote(s) AS q FROM t WHERE k <> 2 ORDER BY k", [("'ab'",), ("NULL",)]),
    ],
)
def test_answers(engine, text, rows):
    got = engine.query(text)
    assert [tuple(float(c) if type(c).__name__ == "Decimal" else c for c in r) for r in got.rows] == rows
    assert got.stats["rows"] == len(rows)


def test_materialized_path(spark):
    e = Engine(spark)
    e.register("m", spark.createDataFrame([('{"a": 1}', 7)], "payload string, payload_a long"))
    e.materialized("payload", "$.a", "payload_a")
    assert e.query("SELECT json_extract(payload, '$.a') AS x FROM m").rows == [("7",)]  # the type is that of the text's value


def test_formats():
    assert strftime("%Y-%m-%dT%H") == "yyyy-MM-dd'T'HH"
    assert glob("a*?.c") == r"^a.*.\.c$"
    with pytest.raises(DialectError):
        strftime("%Q")


def test_usage_and_policies(spark):
    u = Usage()
    for i in range(120):
        u.record("SELECT json_extract(payload, '$.a.total') FROM t WHERE tenant_id = 'x' AND NOT user_id NOT IN (1) ORDER BY k", now=i)
    assert u.top(2) == [("tenant_id", 120), ("user_id", 120)]
    assert u.operators["user_id"]["in"] == 120
    assert IndexPolicy().decide(u, {"old"}) == (["tenant_id", "user_id"], ["old"])
    assert PathPolicy().decide(u) == [("payload $.a.total", "payload_a_total", "string")]
    rows = spark.createDataFrame([('{"a": {"total": 1.5, "n": 7, "status": "active"}}',), ('{"a": {"total": 2.25, "n": 8, "status": 3}}',), (None,)], "payload string")
    assert PathPolicy().decide(u, rows) == [("payload $.a.total", "payload_a_total", "double")]
    assert column_name("payload $.a.b") == "payload_a_b"
    assert [column_type(rows, f"payload $.a.{n}") for n in ("n", "status", "none")] == ["bigint", "string", "string"]
    u.prune(before=1000)
    assert u.top(1) == []


def test_co_access():
    g = CoAccess()
    for _ in range(3):
        for f in "abc":
            g.access(f)
    assert g.next("a") == ["b"]
    for _ in range(8):
        g.decay()
    assert g.next("a", 0) == []
