"""Queries over the data-management operators: routing, statistics, pruning, indexes, schemas, ingest, compaction, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import bloom
from tidemark.operators import routing, storage
from tidemark.operators.statements import ORACLE_VIEW
from tidemark.plans import pruning, usage
from tidemark.registry import Registry
from tidemark.session import work_dir
from tidemark.sources import manifest, schemas, shared
from tidemark.sources.tables import EVENTS, events, json_rows, read_files
from tidemark.streaming.ingest import append, into_store, into_table, landed, windowed

QUERIES = Registry()
_FIRST_WEEK = ("between", "event_time", 1704067200000000, 1704671999999999)
_SUM = "SELECT event_type, COUNT(*) AS n, CAST(SUM(user_id) AS BIGINT) AS s, MIN(event_time) AS t FROM ev GROUP BY event_type"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows of the store's schema."""
    e = events(spark, sf_dir)
    return e.select(F.unhex(F.lpad(F.hex("event_id"), 32, "0")).alias("event_id"), "tenant_id", "user_id", "event_time", "event_type", "payload")


def _summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("s"), F.min("event_time").alias("t"))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics with each day as a file."""
    return manifest.file_stats(events(spark, sf_dir).withColumn("path", F.col("partition_key")))


@QUERIES.query("m_route_time", ORACLE_VIEW + "SELECT partition_key, COUNT(*) AS n FROM ev GROUP BY partition_key")
def route_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.routed(_rows(spark, sf_dir), "time").groupBy("partition_key").agg(F.count("*").alias("n"))


@QUERIES.query("m_route_tenant", ORACLE_VIEW + "SELECT tenant_id AS partition_key, COUNT(*) AS n FROM ev GROUP BY tenant_id")
def route_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.routed(_rows(spark, sf_dir), "tenant").groupBy("partition_key").agg(F.count("*").alias("n"))


@QUERIES.query("m_route_hash", ORACLE_VIEW + "SELECT user_id, CAST(1 AS BIGINT) AS keys, COUNT(*) AS n FROM ev GROUP BY user_id")
def route_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's rows share one key."""
    return routing.routed(_rows(spark, sf_dir), "hash", 16).groupBy("user_id").agg(F.count_distinct("partition_key").alias("keys"), F.count("*").alias("n"))


@QUERIES.query("m_file_stats", ORACLE_VIEW + "SELECT partition_key AS path, partition_key, MIN(user_id) AS min_user_id, MAX(user_id) AS max_user_id, MIN(event_time) AS min_event_time, MAX(event_time) AS max_event_time, MIN(tenant_id) AS min_tenant_id, MAX(tenant_id) AS max_tenant_id, COUNT(*) AS row_count, COUNT(DISTINCT user_id) AS n_user_id, COUNT(DISTINCT event_time) AS n_event_time, COUNT(DISTINCT tenant_id) AS n_tenant_id FROM ev GROUP BY partition_key")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir)


@QUERIES.query("m_prune_counts", ORACLE_VIEW + ", f AS (SELECT partition_key, MIN(event_time) AS a, MAX(event_time) AS b, MIN(user_id) AS c, MAX(user_id) AS d FROM ev GROUP BY partition_key), k AS (SELECT COUNT(*) AS files, COUNT(*) FILTER (b >= 1704067200000000 AND a <= 1704671999999999 AND c <= 5 AND d >= 5) AS matched FROM f) SELECT files, matched, files - matched AS pruned, (files - matched) / CAST(files AS DOUBLE) AS ratio FROM k")
def prune_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pruning.counts(_daily(spark, sf_dir), ("and", _FIRST_WEEK, ("=", "user_id", 5), ("=", "event_type", "click")))


@QUERIES.query("m_zone_map", ORACLE_VIEW + "SELECT DISTINCT partition_key FROM ev WHERE user_id IN (3, 77)")
def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that hold one of two users: the zone maps tell which may, and only those keys' rows are asked."""
    rows = events(spark, sf_dir)
    keys = manifest.zone_may_hold(manifest.zone_map(rows, "user_id"), [3, 77])
    return rows.join(keys, "partition_key", "left_semi").where(F.col("user_id").isin(3, 77)).select("partition_key").distinct()


@QUERIES.query("m_index_lookup", ORACLE_VIEW + "SELECT CAST(user_id AS VARCHAR) AS value, partition_key AS path, COUNT(*) AS row_count, MIN(event_time) AS min_time, MAX(event_time) AS max_time FROM ev WHERE user_id = 7 GROUP BY user_id, partition_key")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = storage.build_index(events(spark, sf_dir).withColumn("path", F.col("partition_key")), "user_id")
    return storage.lookup(index, "7").drop("bucket")


@QUERIES.query("m_schema_evolution", ORACLE_VIEW + "SELECT CASE WHEN user_id % 2 = 1 THEN 'eu' END AS region, COUNT(*) AS n FROM ev GROUP BY 1")
def schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of version 1 read as null in a column that version 2 added."""
    rows, folder = _rows(spark, sf_dir), work_dir(spark)
    rows.where("user_id % 2 = 0").write.parquet(f"{folder}/v1")
    rows.where("user_id % 2 = 1").withColumn("region", F.lit("eu")).write.parquet(f"{folder}/v2")
    registry = schemas.Registry()
    registry.register(schemas.Schema(1, (*schemas.EVENTS_V1.columns, schemas.Column("region", "TEXT"))))


    return read_files(spark, [f"{folder}/v1", f"{folder}/v2"], registry.latest().spark()).groupBy("region").agg(F.count("*").alias("n"))


@QUERIES.query("m_materialized_json", ORACLE_VIEW + "SELECT CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k, COUNT(*) AS n FROM ev GROUP BY 1")
def materialized_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON path answered by the column that the store keeps it in, in files that were written with it, and from the text elsewhere."""
    store, rows = storage.Store(spark, work_dir(spark)), _rows(spark, sf_dir)
    path = "payload $.k"
    store.ingest(rows.where("user_id % 2 = 0"), "kept", paths={usage.column_name(path): (path, usage.column_type(rows, path))})
    store.ingest(rows.where("user_id % 2 = 1"), "plain")
    files = [r.path for r in store.manifest.active().select("path").collect()]
    both = spark.read.option("mergeSchema", "true").parquet(*files)
    return both.groupBy(storage.json_path(both, "$.k", "bigint", name="payload_k").alias("k")).agg(F.count("*").alias("n"))


@QUERIES.query("m_validation", ORACLE_VIEW + ", b AS (SELECT nullif(tenant_id, 'tenant_03') AS t, CASE WHEN user_id % 7 = 0 THEN 0 ELSE event_time END AS e FROM ev) SELECT CAST((t IS NULL)::INT + (e <= 0)::INT AS INTEGER) AS faults, COUNT(*) AS n FROM b GROUP BY 1")
def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("tenant_id", F.nullif("tenant_id", F.lit("tenant_03"))).withColumn("event_time", F.when(F.col("user_id") % 7 == 0, F.lit(0)).otherwise(F.col("event_time")))
    return schemas.checked(rows).groupBy(F.size("errors").alias("faults")).agg(F.count("*").alias("n"))


@QUERIES.query("m_idempotent_ingest", ORACLE_VIEW + _SUM)
def idempotent_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that comes twice is there once."""
    store = storage.Store(spark, work_dir(spark))
    for _ in range(2):
        store.ingest(_rows(spark, sf_dir), "first")
    return _summary(store.scan())


@QUERIES.query("m_pruned_scan", ORACLE_VIEW + "SELECT event_type, COUNT(*) AS n, CAST(SUM(user_id) AS BIGINT) AS s, MIN(event_time) AS t FROM ev WHERE event_time BETWEEN 1704067200000000 AND 1704671999999999 AND (user_id = 5 OR NOT tenant_id = 'tenant_04') GROUP BY event_type")
def pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = storage.Store(spark, work_dir(spark))
    store.ingest(_rows(spark, sf_dir), "all")
    return _summary(store.scan(("and", _FIRST_WEEK, ("or", ("=", "user_id", 5), ("not", ("=", "tenant_id", "tenant_04"))))))


@QUERIES.query("m_compaction_invariant", ORACLE_VIEW + _SUM)
def compaction_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compacting changes no answer."""
    store = storage.Store(spark, work_dir(spark))
    for k in range(2):
        store.ingest(_rows(spark, sf_dir).where(F.col("user_id") % 2 == k), f"part-{k}")
    keys = [r.partition_key for r in store.candidates().orderBy("partition_key").collect()]
    with store.together(keys):
        for key in keys:
            store.compact(key)
    return _summary(store.scan())


@QUERIES.query("m_reconcile", "SELECT 'dangling' AS fault, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'orphan', 2")
def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that lost a file and found two that nobody committed; superseded files are no faults."""
    store, rows = storage.Store(spark, work_dir(spark)), _rows(spark, sf_dir)
    for k in range(2):
        store.ingest(rows.where(F.col("user_id") % 2 == k), f"part-{k}")
    store.compact(store.candidates().orderBy("partition_key").first().partition_key)
    shared.remove(spark, store.manifest.active().orderBy("path").first().path)
    for k in range(2):
        rows.where("user_id = 1").coalesce(1).write.parquet(f"{store.folder}/data/batch=lost-{k}")
    return manifest.reconcile(store.manifest.files(), store.present()).groupBy("fault").agg(F.count("*").alias("n"))


@QUERIES.query("m_sql_pruned", ORACLE_VIEW + "SELECT event_type, COUNT(*) AS n, CAST(SUM(user_id) AS BIGINT) AS s, MIN(event_time) AS t, TRUE AS pruned FROM ev WHERE event_time BETWEEN 1704067200000000 AND 1704671999999999 AND (tenant_id = 'tenant_05' OR user_id < 20) GROUP BY event_type")
def sql_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement over a store reads the files that its filters leave."""
    from tidemark.engine import Engine

    store, engine = storage.Store(spark, work_dir(spark)), Engine(spark)
    store.ingest(_rows(spark, sf_dir), "all")
    engine.register_store("stored", store)
    rows = engine.sql("SELECT event_type, COUNT(*) AS n, SUM(user_id) AS s, MIN(event_time) AS t FROM stored WHERE event_time BETWEEN 1704067200000000 AND 1704671999999999 AND (tenant_id = 'tenant_05' OR user_id < 20) GROUP BY event_type")
    return rows.withColumn("pruned", F.lit(engine.last["pruned"] > engine.last["scanned"]))


@QUERIES.query("m_three_phase", ORACLE_VIEW + "SELECT event_id, event_time, TRUE AS narrowed FROM ev WHERE user_id = 7 AND event_time BETWEEN 1704067200000000 AND 1704671999999999")
def three_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user's events of a week: least and greatest values keep the week's files, zone maps and Bloom filters those that hold the user."""
    store = storage.Store(spark, work_dir(spark), filters=("user_id",))
    store.ingest(_rows(spark, sf_dir), "all")
    predicate = ("and", _FIRST_WEEK, ("=", "user_id", 7))
    active = store.manifest.active()
    found, week, every = (x.count() for x in (store.files_of(predicate), pruning.pruned(active, predicate), active))
    return store.scan(predicate).select(F.conv(F.hex("event_id"), 16, 10).cast("long").alias("event_id"), "event_time", F.lit(found <= week < every).alias("narrowed"))


@QUERIES.query("m_index_scan", ORACLE_VIEW + "SELECT event_type, COUNT(*) AS n, CAST(SUM(user_id) AS BIGINT) AS s, MIN(event_time) AS t FROM ev WHERE user_id IN (3, 77) GROUP BY event_type")
def index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan that an index narrows, over files that it knows and files that came later."""
    store, rows = storage.Store(spark, work_dir(spark)), _rows(spark, sf_dir)
    store.ingest(rows.where("event_type = 'click'"), "old")
    store.index("user_id")
    store.ingest(rows.where("event_type <> 'click'"), "new")
    return _summary(store.scan(("in", "user_id", (3, 77))))


@QUERIES.query("m_json_batch", ORACLE_VIEW + _SUM)
def json_batch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that come as JSON text, parsed where they lie."""
    rows = _rows(spark, sf_dir).drop("event_id")
    return _summary(json_rows(rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))))


@QUERIES.query("m_stream_equals_batch", ORACLE_VIEW + _SUM)
def stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that came as a stream answer like rows that came at once."""
    folder = work_dir(spark)
    store = storage.Store(spark, f"{folder}/store")
    _rows(spark, sf_dir).drop("event_id").repartition(2).write.json(f"{folder}/landing")
    into_store(landed(spark, f"{folder}/landing", EVENTS), store, "events", f"{folder}/checkpoint").awaitTermination()
    return _summary(store.scan())


@QUERIES.query("m_bloom", ORACLE_VIEW + "SELECT COUNT(*) AS held, TRUE AS rare FROM (SELECT DISTINCT partition_key, user_id FROM ev)")
def bloom_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's filter holds all of its users, and hardly any strangers. Filters are as large as the day with the most users asks for,
    and strangers are ids of the whole range that no event has."""
    rows = events(spark, sf_dir).select("partition_key", "user_id").distinct()
    most = rows.groupBy("partition_key").agg(F.count("user_id").alias("n")).agg(F.max("n").alias("n")).first()["n"]
    shape = bloom.Shape.of(max(1000, most or 0), 0.001)
    filters = bloom.build(rows, "user_id", shape, "partition_key")
    held = bloom.own_may_hold(filters, rows, "user_id", shape, "partition_key")
    some = spark.range(1000).select(F.xxhash64("id").alias("user_id"))
    strangers = some.join(rows.join(F.broadcast(some), "user_id", "left_semi"), "user_id", "left_anti")
    wrong = bloom.may_hold(filters, strangers, "user_id", shape, "partition_key")
    days = rows.select("partition_key").distinct().agg(F.count("*").alias("days"))
    one = held.agg(F.count("*").alias("held")).withColumn("k", F.lit(1)).join(wrong.agg(F.count("*").alias("wrong")).withColumn("k", F.lit(1)), "k").join(days.withColumn("k", F.lit(1)), "k")
    return one.select("held", (F.col("wrong") <= F.col("days") * 5).alias("rare"))


@QUERIES.query("m_compaction_candidates", ORACLE_VIEW + ", f AS (SELECT partition_key, user_id % 3 AS part, COUNT(*) AS rows FROM ev GROUP BY 1, 2) SELECT partition_key, COUNT(*) AS files, CAST(SUM(rows) AS BIGINT) AS rows FROM f WHERE rows < 200 GROUP BY 1 HAVING COUNT(*) >= 2")
def compaction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with several small files, a third of a day's users being a file."""
    store = storage.Store(spark, work_dir(spark))
    for k in range(3):
        store.ingest(_rows(spark, sf_dir).where(F.col("user_id") % 3 == k), f"part-{k}")
    return store.candidates(rows_below=200).select("partition_key", "files", "rows")


@QUERIES.query("m_duplicate_ids", ORACLE_VIEW + "SELECT COUNT(DISTINCT event_id) AS ids, COUNT(*) * 2 AS rows FROM ev")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that came twice are one after compaction."""
    store = storage.Store(spark, work_dir(spark))
    for k in range(2):
        store.ingest(_rows(spark, sf_dir), f"time-{k}")
    rows = store.scan().count()
    keys = [r.partition_key for r in store.manifest.active().select("partition_key").distinct().orderBy("partition_key").collect()]
    with store.together(keys, drop_duplicates=True):
        for key in keys:
            store.compact(key, drop_duplicates=True)
    return store.scan().agg(F.count("*").alias("ids"), F.lit(rows).cast("long").alias("rows"))


@QUERIES.query("m_windows", ORACLE_VIEW + "SELECT date_trunc('hour', ts) AS begin, event_type, COUNT(*) AS n FROM ev GROUP BY 1, 2")
def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type, counted by a stream over files that have landed."""
    folder = work_dir(spark)
    append(_rows(spark, sf_dir).drop("event_id"), f"{folder}/landing")
    return into_table(windowed(landed(spark, f"{folder}/landing", EVENTS)), f"{folder}/hours", f"{folder}/checkpoint").withColumn("begin", F.col("begin").cast("timestamp_ntz"))


@QUERIES.query("m_access_pairs", ORACLE_VIEW + ", l AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_time, event_id) AS b FROM ev) SELECT a, b, CAST(COUNT(*) AS DOUBLE) AS weight FROM l WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2")
def access_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The co-access graph of a log: how often one kind of access follows another."""
    graph = usage.CoAccess()
    graph.learn(usage.successions(events(spark, sf_dir), "event_type", "user_id", "event_time", "event_id"))
    return spark.createDataFrame([(a, b, w) for (a, b), w in sorted(graph.edges.items())], "a string, b string, weight double")
