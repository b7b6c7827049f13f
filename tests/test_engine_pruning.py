"""SQL over a store reads only the files that the statement can need, and no fewer."""

import pytest

from tests.test_storage import DAY, START, rows
from tidemark.engine import Engine
from tidemark.operators import storage
from tidemark.plans import pruning
from tidemark.plans.extract import asked


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    s = storage.Store(spark, str(tmp_path_factory.mktemp("sql")), filters=("user_id", "event_type"))
    for k in range(3):
        s.ingest(rows(spark, 40, 40 * k), f"b{k}")
    e = Engine(spark)
    e.register_store("ev", s)
    e.register("every", s.scan())
    return e


STATEMENTS = [
    ("event_time < {a}", True),
    ("event_time BETWEEN {a} AND {b} AND tenant_id = 'tenant_1'", True),
    ("{a} > event_time", True),
    ("user_id = 99", True),
    ("user_id IN (98, 99) AND event_type = 'click'", True),
    ("event_type = 'none'", True),
    ("tenant_id = 'zzz' OR event_time < {a}", True),
    ("tenant_id = 'zzz' OR event_type LIKE 'c%'", False),
    ("NOT event_time < {a}", None),
    ("tenant_id LIKE 'TENANT_1'", False),
    ("event_time + 1 < {a}", False),
    ("user_id IS NULL", None),
    ("CAST(user_id AS STRING) = '3'", None),
    ("event_time < {a} + 0", True),
    ("user_id > 2.5 AND event_time < {a}", True),
]


@pytest.mark.parametrize("where,prunes", STATEMENTS)
def test_statement(engine, where, prunes):
    where = where.format(a=START + DAY, b=START + 2 * DAY)
    got = engine.query(f"SELECT event_type, COUNT(*) AS n, SUM(user_id) AS s FROM ev WHERE {where} GROUP BY event_type ORDER BY 1")
    plain = engine.query(f"SELECT event_type, COUNT(*) AS n, SUM(user_id) AS s FROM every WHERE {where} GROUP BY event_type ORDER BY 1")
    assert got.rows == plain.rows
    total = engine.stores["ev"][0].manifest.active().count()
    assert got.stats["partitions_scanned"] + got.stats["partitions_pruned"] == total
    if prunes is not None:
        assert (got.stats["partitions_pruned"] > 0) is prunes


def test_joins_aliases_and_subqueries(engine):
    a = START + DAY
    for text in (
        "SELECT COUNT(*) FROM {t} x JOIN {t} y ON x.event_id = y.event_id WHERE x.event_time < {a} AND y.user_id = 3",
        "SELECT COUNT(*) FROM (SELECT user_id AS event_time, event_time AS user_id FROM {t}) z WHERE z.event_time = 3 AND z.user_id < {a}",
        "SELECT COUNT(*) FROM {t} WHERE event_time < {a} AND user_id > (SELECT AVG(user_id) FROM {t})",
        "SELECT COUNT(*) FROM {t} WHERE user_id IN (SELECT user_id FROM {t} WHERE event_time < {a} LIMIT 3)",
        "SELECT COUNT(*) FROM (SELECT * FROM {t} WHERE event_time < {a} UNION ALL SELECT * FROM {t} WHERE user_id = 99) u",
        "SELECT x.user_id, COUNT(y.user_id) AS n FROM {t} x LEFT JOIN {t} y ON x.user_id = y.user_id AND y.event_time < {a} GROUP BY 1 ORDER BY 1",
    ):
        assert engine.query(text.format(t="ev", a=a)).rows == engine.query(text.format(t="every", a=a)).rows, text


def test_values_are_found_by_each_phase(engine):
    store = engine.stores["ev"][0]
    active = store.manifest.active()
    for p in (("=", "user_id", 5), ("=", "user_id", 99), ("and", ("in", "user_id", (1, 99)), ("=", "event_type", "view"))):
        by_range, by_all = pruning.pruned(active, p).count(), store.files_of(p).count()
        assert by_all <= by_range
        assert store.scan(p).count() == store.scan().where(pruning.condition(p)).count()
    assert pruning.pruned(active, ("=", "event_type", "none")).count() == active.count()
    assert store.files_of(("=", "event_type", "none")).count() == 0
    assert pruning.needed(("and", ("=", "a", 1), ("and", ("in", "a", (1, 2)), ("or", ("=", "b", 1), ("=", "b", 2))))) == {"a": [1]}


def test_files_without_filters_stay(spark, tmp_path):
    plain, filtered = storage.Store(spark, str(tmp_path / "s")), storage.Store(spark, str(tmp_path / "s"), filters=("event_type",))
    plain.ingest(rows(spark, 10), "a")
    filtered.ingest(rows(spark, 10, 10), "b")
    p = ("=", "event_type", "click")
    assert filtered.scan(p).count() == 10
    assert 0 < filtered.files_of(("=", "event_type", "none")).count() == plain.manifest.active().where("batch = 'a'").count()


def test_an_index_answers_and_new_files_stay(spark, tmp_path):
    s = storage.Store(spark, str(tmp_path / "s"))
    s.ingest(rows(spark, 40), "a")
    assert s.index("event_type") == s.manifest.active().count() and s.index("event_type") == 0
    assert s.files_of(("=", "event_type", "none")).count() == 0
    s.ingest(rows(spark, 10, 40), "b")
    assert s.files_of(("=", "event_type", "none")).count() == s.manifest.active().where("batch = 'b'").count()
    assert s.scan(("=", "event_type", "click")).count() == 25


def test_what_cannot_be_told(engine, spark):
    store, folder = engine.stores["ev"]
    spark.read.schema(store.read(store.manifest.files(0)).schema).parquet(folder).createOrReplaceTempView("stand_in")
    assert asked(spark.sql("SELECT * FROM stand_in"), folder) is None
    assert asked(spark.sql("SELECT * FROM stand_in WHERE user_id = 5 AND length(payload) > 3"), folder) is not None
    with pytest.raises(ValueError):
        pruning.condition(("any",))


def test_large_results_are_refused(engine):
    with pytest.raises(ValueError, match="more than 10 rows"):
        engine.query("SELECT * FROM ev", most=10)
