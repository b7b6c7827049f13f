"""Ingest, pruning, compaction and the rest, on small stores."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import ulid
from tidemark.operators import routing, storage
from tidemark.plans import pruning
from tidemark.plans.usage import Backpressure
from tidemark.sources import manifest, schemas
from tidemark.sources.tables import json_batch, read_files, to_micros
from tidemark.streaming.notify import Notice, Notifier

DAY = 86_400_000_000
START = 1_704_067_200_000_000


def rows(spark, n=60, first=0):
    data = [(None, f"tenant_{i % 3}", i % 7, START + i * DAY // 20, ["click", "view"][i % 2], '{"k": 1}') for i in range(first, first + n)]
    return spark.createDataFrame(data, "event_id binary, tenant_id string, user_id long, event_time long, event_type string, payload string")


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = storage.Store(spark, str(tmp_path_factory.mktemp("store")))
    s.ingest(rows(spark), "a")
    s.ingest(rows(spark, first=30), "b")
    return s


def test_batches_come_once(spark, store):
    assert store.scan().count() == 120
    store.ingest(rows(spark), "a")
    assert store.scan().count() == 120
    assert store.scan().where("length(event_id) = 16").select("event_id").distinct().count() == 120


def test_bad_rows_are_given_back(spark, tmp_path):
    s = storage.Store(spark, str(tmp_path / "s"))
    bad = rows(spark, 3).withColumn("tenant_id", F.when(F.col("user_id") == 1, F.lit("")).otherwise(F.col("tenant_id"))).withColumn("event_time", F.when(F.col("user_id") == 2, F.lit(0)).otherwise(F.col("event_time")))
    assert sorted(r.errors[0] for r in s.ingest(bad).collect()) == ["event_time: not above 0", "tenant_id: empty"]
    assert s.scan().count() == 1
    assert storage.Store(spark, str(tmp_path / "none")).scan().count() == 0


leaf = st.one_of(
    st.tuples(st.just("="), st.just("user_id"), st.integers(-1, 8)),
    st.tuples(st.sampled_from(["<", "<=", ">", ">="]), st.just("event_time"), st.integers(START - DAY, START + 6 * DAY)),
    st.tuples(st.just("between"), st.just("event_time"), st.integers(START, START + 2 * DAY), st.integers(START, START + 5 * DAY)),
    st.tuples(st.just("in"), st.just("tenant_id"), st.lists(st.sampled_from(["tenant_0", "tenant_2", "x"]), max_size=2).map(tuple)),
    st.tuples(st.just("="), st.just("event_type"), st.just("click")),
)
tree = st.recursive(leaf, lambda p: st.one_of(st.tuples(st.sampled_from(["and", "or"]), p, p), st.tuples(st.just("not"), p)), max_leaves=5)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(p=tree)
def test_pruning_loses_nothing(store, p):
    everything = store.scan().where(pruning.condition(p)).count()
    assert store.scan(p).count() == everything


def test_pruning_prunes(store):
    got = pruning.counts(store.manifest.active(), ("<", "event_time", START + DAY)).first()
    assert 0 < got.matched < got.files


def test_compaction_and_garbage(spark, tmp_path):
    s = storage.Store(spark, str(tmp_path / "c"))
    for k in range(3):
        s.ingest(rows(spark, 20, 20 * k).withColumn("event_time", F.lit(START)).withColumn("extra", F.lit(k)), f"b{k}")
    before = storage.fingerprint(s.scan())
    key = s.candidates().first().partition_key
    assert s.compact(key) == {"key": key, "files": 3, "rows": 60, "done": True}
    assert storage.fingerprint(s.scan()) == before
    assert s.manifest.active().count() == 1 and s.manifest.files().count() == 4
    path = s.manifest.active().first().path
    assert "extra" in spark.read.parquet(path).columns
    assert manifest.reconcile(s.manifest.files(), s.present()).count() == 0
    assert s.collect_garbage(age_ms=10**9) == []
    later = storage.now() + 2 * 10**9
    assert len(s.collect_garbage(10**9, later, dry=True)) == 3
    assert len(s.collect_garbage(10**9, later)) == 3
    assert s.manifest.files().count() == 1 and s.scan().count() == 60
    assert s.compact(key)["done"] is False


def test_one_writer(store):
    base = store.manifest.version()
    with pytest.raises(RuntimeError):
        store.manifest.commit(store.manifest.files(), base - 1)


def test_index_sees_new_files(spark):
    files = spark.createDataFrame([("a",), ("b",), ("new",)], "path string")
    data = spark.createDataFrame([("v", "a", 1), ("w", "b", 2)], "value string, path string, event_time long")
    index = storage.build_index(data, "value")
    got = storage.files_for(files, index, "v", spark.createDataFrame([("a",), ("b",)], "path string"))
    assert sorted(r.path for r in got.collect()) == ["a", "new"]


def test_schemas():
    r = schemas.Registry()
    new = schemas.Schema(9, (*schemas.EVENTS_V1.columns, schemas.Column("region", "TEXT")))
    assert r.register(new).version == 2 and r.register(new).version == 2
    assert r.added(1, 2) == ["region"]
    bad = schemas.Schema(0, (schemas.Column("a", "TEXT"), schemas.Column("a", "DATE")), (("z",),))
    assert len(bad.faults()) == 5
    with pytest.raises(ValueError):
        r.register(bad)


def test_evolved_reads(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "v1"))
    schema = schemas.Schema(2, (schemas.Column("id", "INTEGER", key=True), schemas.Column("region", "TEXT"))).spark()
    assert [tuple(r) for r in read_files(spark, [str(tmp_path / "v1")], schema).orderBy("id").collect()] == [(0, None), (1, None)]
    assert read_files(spark, [], schema).count() == 0


def test_routing(spark):
    r = rows(spark, 40)
    assert routing.routed(r).select("partition_key").distinct().count() == 2
    assert routing.routed(r, "hash", 4).groupBy("user_id").agg(F.count_distinct("partition_key").alias("n")).where("n > 1").count() == 0
    with pytest.raises(Exception, match="tenant_id is empty"):
        routing.routed(r.withColumn("tenant_id", F.lit("")), "tenant").collect()
    assert [routing.target_bytes(n) >> 20 for n in (0, 1 << 30, 10 << 30, 1 << 40)] == [64, 128, 192, 256]


def test_units_and_json(spark):
    big = (1 << 60) + 1
    df = json_batch(spark, [{"tenant_id": "t", "user_id": big, "event_time": 5, "event_type": "e"}])
    assert df.first().user_id == big and df.first().payload == "{}"
    one = spark.range(1).select(to_micros(F.lit(7), "s").alias("s"), to_micros(F.lit(7), "ms").alias("ms"), to_micros(F.lit(7999), "ns").alias("ns")).first()
    assert tuple(one) == (7_000_000, 7_000, 7)


def test_ulids():
    g = ulid.Generator()
    made = [g.new(5) for _ in range(100)] + [g.new(4)]
    assert made == sorted(set(made)) and {ulid.milliseconds(u) for u in made} == {5}
    assert all(ulid.parse(ulid.text(u)) == u for u in made)
    assert sorted(map(ulid.text, made)) == [ulid.text(u) for u in made]
    for bad in ("", "U" * 26, "8" + "0" * 25):
        with pytest.raises(ValueError):
            ulid.parse(bad)


def test_notices():
    n = Notifier(size=1)
    q, other = n.subscribe("2024"), n.subscribe("x")
    n.publish(Notice("created", "20240101"))
    n.publish(Notice("created", "20240102"))
    assert q.get_nowait().key == "20240101" and other.empty() and n.missed == 1
    n.unsubscribe(q)
    n.publish(Notice("created", "20240103"))
    assert q.empty()


def test_backpressure():
    b = Backpressure(limit=8)
    for k, ok in enumerate([False] * 6 + [True] * 4):
        b.report(ok, at=k)
    assert b.pause(9, at=10) and not b.pause(8, at=10) and not b.pause(0, at=10)
    assert [b.adjust(at=10) for _ in range(4)] == [4, 2, 1, 1]
    b.report(True, at=5000)  # the failures are forgotten
    assert [b.adjust(at=5000) for _ in range(4)] == [2, 4, 8, 8]
    slow = Backpressure(limit=4, most=100)
    for ok in [False] + [True] * 49:
        slow.report(ok, at=0)
    assert slow.adjust(at=0) == 6  # 2 percent, at most half the threshold
    for ok in [False] * 2 + [True] * 25:
        slow.report(ok, at=0)
    assert slow.adjust(at=0) == 7  # 3.9 percent
    assert Backpressure(limit=2).adjust(at=0) == 3  # no results yet


def test_filters_and_columns_reach_the_scan(spark, store, capsys):
    store.scan(("and", ("=", "user_id", 3), ("=", "tenant_id", "tenant_1"))).select("event_type").explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(user_id,3)" in plan and "EqualTo(tenant_id,tenant_1)" in plan
    schema = next(x for x in plan.splitlines() if x.startswith("ReadSchema"))
    assert "payload" not in schema and "Exchange" not in plan


def added(spark, *paths):
    return spark.createDataFrame([(p, "k", 1) for p in paths], "path string, partition_key string, row_count long")


def test_two_writers_lose_nothing(spark, tmp_path):
    """Two writers stand at one version; both have written; the first takes the marker, the second reads again and adds its own."""
    first, second = (manifest.Manifest(spark, str(tmp_path / "m")) for _ in range(2))
    first.add(added(spark, "a"))
    mark, met = second._mark, []

    def late(base, *rest):
        if not met:
            met.append(base)
            first.add(added(spark, "A"))
        return mark(base, *rest)

    second._mark = late
    assert second.add(added(spark, "B"))
    assert met == [1] and second.version() == 3
    assert sorted(r.path for r in first.active().collect()) == ["A", "B", "a"]
    assert sorted(r.path for r in first.active(2).collect()) == ["A", "a"]
    with pytest.raises(RuntimeError):
        second.commit(second.files(), 2)
    assert sorted(r.path for r in first.active().collect()) == ["A", "B", "a"]


def test_one_batch_of_two_writers(spark, tmp_path):
    s, t = (storage.Store(spark, str(tmp_path / "s")) for _ in range(2))
    write = t.manifest._write

    def meanwhile(out):
        s.ingest(rows(spark, 10), "same")
        t.manifest._write = write
        return write(out)

    t.manifest._write = meanwhile
    t.ingest(rows(spark, 10), "same")
    assert s.scan().count() == 10
    assert manifest.reconcile(s.manifest.files(), s.present()).groupBy("fault").count().collect()[0].fault == "orphan"
    assert s.recover()["orphans"] == []  # too young
    assert s.recover(0)["orphans"] and s.scan().count() == 10
    assert manifest.reconcile(s.manifest.files(), s.present()).count() == 0


def test_a_crash_before_the_marker_leaves_the_last_version(spark, tmp_path):
    s = storage.Store(spark, str(tmp_path / "s"))
    for k in range(2):
        s.ingest(rows(spark, 20, 20 * k).withColumn("event_time", F.lit(START)), f"b{k}")
    before, key = storage.fingerprint(s.scan()), s.candidates().first().partition_key
    mark = s.manifest._mark
    s.manifest._mark = lambda *_: (_ for _ in ()).throw(KeyboardInterrupt())
    with pytest.raises(KeyboardInterrupt):
        s.compact(key)
    s.manifest._mark = mark
    assert storage.fingerprint(storage.Store(spark, s.folder).scan()) == before
    left = s.recover(0)
    assert left["orphans"] and left["folders"] and not left["dangling"]
    assert s.compact(key)["done"] and storage.fingerprint(s.scan()) == before


def test_compaction_meets_its_target(spark, tmp_path):
    s = storage.Store(spark, str(tmp_path / "s"))
    data = spark.range(20_000).select(F.lit(None).cast("binary").alias("event_id"), F.concat(F.lit("t"), F.col("id") % 9).alias("tenant_id"), F.col("id").alias("user_id"), (F.lit(START) + F.col("id")).alias("event_time"), F.lit("e").alias("event_type"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    for k in range(2):
        s.ingest(data.where(F.col("user_id") % 2 == k), f"b{k}")
    old = s.manifest.active().agg(F.sum("size_bytes").alias("b")).first().b
    target = old // 8
    assert s.compact("20240101", target=target)["rows"] == 20_000
    sizes = [r.size_bytes for r in s.manifest.active().collect()]
    assert 6 <= len(sizes) <= 10 and max(sizes) < 2 * target
    got = pruning.counts(s.manifest.active(), ("=", "tenant_id", "t4")).first()
    assert got.matched < got.files  # files are cut by tenant


def test_a_superseded_file_is_not_compacted_twice(spark, tmp_path):
    m = manifest.Manifest(spark, str(tmp_path / "m"))
    m.add(added(spark, "a", "b"))
    m.replace(["a", "b"], added(spark, "c"), 1)
    with pytest.raises(RuntimeError):
        m.replace(["a"], added(spark, "d"), 2)
    assert [r.path for r in m.active().collect()] == ["c"]


def test_many_increments(spark, tmp_path):
    m = manifest.Manifest(spark, str(tmp_path / "m"))
    for k in range(manifest.MOST + 3):
        m.add(added(spark, f"f{k:02d}"))
        if k == 4:
            m.drop(["f01"])
    assert len(m._marker(m.version())["parts"]) < manifest.MOST
    assert sorted(r.path for r in m.files().collect()) == [f"f{k:02d}" for k in range(manifest.MOST + 3) if k != 1]


def test_busy_days_are_candidates(spark, tmp_path):
    s = storage.Store(spark, str(tmp_path / "s"))
    big = spark.createDataFrame([(f"p{i}", "k", 10, 1 << 40, 5) for i in range(4)], "path string, partition_key string, row_count long, size_bytes long, created_at long")
    s.manifest.add(big)
    assert s.candidates().count() == 0
    assert [(r.partition_key, r.files) for r in s.candidates(most=3).collect()] == [("k", 4)]


def test_text_in_a_number_column(spark, tmp_path):
    """A value that isn't of a kept path's type fails nothing: it is read from the text."""
    s = storage.Store(spark, str(tmp_path / "s"))
    s.ingest(rows(spark, 4).withColumn("payload", F.when(F.col("user_id") == 1, '{"status": "active"}').otherwise('{"status": 3}')), paths={"payload_status": ("payload $.status", "bigint")})
    got = spark.read.parquet(*[r.path for r in s.manifest.active().collect()])
    assert sorted((r.user_id, r.payload_status) for r in got.collect()) == [(0, 3), (1, None), (2, 3), (3, 3)]
    assert sorted(r.x for r in got.select(storage.json_path(got, "$.status", "string", name="payload_status").alias("x")).collect()) == ["3", "3", "3", "active"]


def test_registry_outlives_the_process(spark, tmp_path):
    new = schemas.Schema(9, (*schemas.EVENTS_V1.columns, schemas.Column("region", "TEXT")))
    other = schemas.Schema(9, (*schemas.EVENTS_V1.columns, schemas.Column("device", "TEXT")))
    a, b = (schemas.Registry(spark=spark, folder=str(tmp_path / "r")) for _ in range(2))
    assert a.register(new).version == 2 and b.register(other).version == 3 and b.register(new).version == 2
    c = schemas.Registry(spark=spark, folder=str(tmp_path / "r"))
    assert [v.version for v in c.versions] == [1, 2, 3] and c.added(1, 3) == ["device"]


def test_notices_of_a_store(spark, tmp_path):
    n = Notifier()
    q = n.subscribe("2024")
    s = storage.Store(spark, str(tmp_path / "s"), notifier=n)
    for k in range(2):
        s.ingest(rows(spark, 5, 5 * k).withColumn("event_time", F.lit(START)), f"b{k}")
    s.index("user_id")
    s.compact("20240101")
    assert [q.get_nowait().kind for _ in range(q.qsize())] == ["created", "created", "indexed", "compacted"]


def test_landing(spark, tmp_path):
    from tidemark.sources.tables import EVENTS
    from tidemark.streaming import ingest

    s, landing = storage.Store(spark, str(tmp_path / "s")), str(tmp_path / "landing")
    ingest.append(rows(spark, 6).drop("event_id").repartition(2), landing)
    query = ingest.into_store(ingest.landed(spark, landing, EVENTS), s, "live", str(tmp_path / "c"), "1 second")
    ingest.drain(query)
    assert s.scan().count() == 6
    ingest.append(rows(spark, 4, 6).drop("event_id"), landing)
    ingest.drain(query)
    query.stop()
    assert s.scan().count() == 10
    again = ingest.into_store(ingest.landed(spark, landing, EVENTS), s, "live", str(tmp_path / "c2"))  # all batches come again
    again.awaitTermination()
    assert s.scan().where("user_id is not null").count() == 10


def test_no_private_folder_on_a_cluster(spark, monkeypatch):
    from tidemark import session

    class Elsewhere:
        class conf:
            get = staticmethod(lambda key, default="": {"spark.master": "spark://host:7077"}.get(key, default))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Elsewhere)


def test_keys_are_compacted_together(spark, tmp_path):
    """Small and large keys, and one whose files differ in a column's type from the others', each with its own files, in one version."""
    s, wide = storage.Store(spark, str(tmp_path / "s")), F.sha2(F.col("event_time").cast("string"), 256)
    many = spark.range(6000).select(F.lit(None).cast("binary").alias("event_id"), F.lit("t").alias("tenant_id"), F.col("id").alias("user_id"), (F.lit(START + 9 * DAY) + F.col("id")).alias("event_time"), F.lit("e").alias("event_type"), F.lit("{}").alias("payload"))
    for k in range(2):
        s.ingest(rows(spark, 60, 60 * k).withColumn("event_time", F.lit(START) + F.pmod("user_id", F.lit(3)) * DAY).withColumn("extra", F.lit("x")), f"a{k}")
        s.ingest(many.withColumn("payload", wide).where(F.col("user_id") % 2 == k), f"b{k}")
        s.ingest(rows(spark, 5, 5 * k).withColumn("event_time", F.lit(START + 5 * DAY)).withColumn("extra", F.lit(k)), f"c{k}")
    before, keys = storage.fingerprint(s.scan()), [r.partition_key for r in s.candidates().orderBy("partition_key").collect()]
    was, target = s.manifest.version(), s.manifest.active().groupBy("partition_key").agg(F.sum("size_bytes").alias("b")).agg(F.max("b")).first()[0] // 4
    with s.together(keys, target=target):
        got = [s.compact(k, target=target) for k in keys]
        with pytest.raises(ValueError):
            s.compact("20300101", target=target)
    assert len(keys) == len(got) > 3 and all(g["done"] and g["files"] == 2 for g in got) and sum(g["rows"] for g in got) == 6130
    assert storage.fingerprint(s.scan()) == before and s.manifest.version() == was + 1
    files = {r.partition_key: r["count"] for r in s.manifest.active().groupBy("partition_key").count().collect()}
    assert 3 <= files.pop("20240110") <= 5 and set(files.values()) == {1}
    paths = {r.path: r.partition_key for r in s.manifest.active().collect()}
    assert all(paths[r.compacted_into] == r.partition_key for r in s.manifest.files().where("compacted_into is not null").collect())
    assert manifest.reconcile(s.manifest.files(), s.present()).count() == 0


def test_an_error_between_compactions_commits_none(spark, tmp_path):
    s = storage.Store(spark, str(tmp_path / "s"))
    for k in range(2):
        s.ingest(rows(spark, 40), f"a{k}")  # 40 rows of two days, each with an id of its own in each batch
    was, keys = s.manifest.version(), [r.partition_key for r in s.candidates().orderBy("partition_key").collect()]
    with pytest.raises(KeyboardInterrupt), s.together(keys, drop_duplicates=True):
        s.compact(keys[0], drop_duplicates=True)
        raise KeyboardInterrupt
    assert s.manifest.version() == was and s.scan().count() == 80
    with s.together(keys):
        s.compact(keys[0])
    assert s.manifest.active().where(F.col("partition_key") == keys[0]).count() == 1
    assert s.manifest.active().where(F.col("partition_key") == keys[1]).count() == 2 and s.scan().count() == 80
