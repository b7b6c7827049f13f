"""The event store on a folder: validated batches in, compaction, validation, garbage collection, secondary indexes, JSON paths as columns."""

from __future__ import annotations

import time
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import bloom
from tidemark.functions.ulid import ulids
from tidemark.operators.routing import STEPS, routed, target_bytes
from tidemark.plans.pruning import Predicate, condition, needed, pruned
from tidemark.sources import shared
from tidemark.sources.manifest import Manifest, file_stats, reconcile, zone_map, zone_may_hold
from tidemark.sources.schemas import Registry, checked, sound
from tidemark.sources.tables import read_files
from tidemark.streaming.notify import Notice, Notifier

#: Columns with a Parquet Bloom filter and its false-positive rate; each filter is as large as its file's values need.
BLOOMS = {"tenant_id": 1e-5, "user_id": 1e-4, "event_type": 1e-4}

#: The shape of a file's filter, one for all so that they are asked alike: bits are kept only where they are set, at most 30,000 words a file.
SHAPE = bloom.Shape.of(100_000, 0.01)
#: What a byte of a row's values takes on disk, about.
PACKED = 0.5
#: Files are dealt by these, so that a file's least and greatest values are near each other.
CLUSTER = ("partition_key", "tenant_id", "event_time", "user_id")
#: Keys of several files each that are rewritten in one job.
LARGE = 50


def now() -> int:
    return int(time.time() * 1000)


def targets(total: Column) -> Column:
    """The file size to aim at for a key of so many bytes, as `target_bytes` gives it."""
    out = F.lit(target_bytes(0))
    for start, _ in STEPS[1:]:
        out = F.when(total >= start, target_bytes(start)).otherwise(out)
    return out


@dataclass
class Rewritten:
    """Keys whose files were written anew and checked, and that no version shows yet. how: duplicates dropped, target; told: what `compact`
    says of each key; old: its files; files: manifest rows of the new ones; asked: keys to be committed."""

    how: tuple
    told: dict[str, dict] = field(default_factory=dict)
    old: dict[str, list[str]] = field(default_factory=dict)
    files: list[DataFrame] = field(default_factory=list)
    asked: set[str] = field(default_factory=set)


@dataclass
class Store:
    """Data under `<folder>/data/`, the manifest under `<folder>/manifest`, filters, zones and indexes beside them.

    filters: columns for which each file gets a Bloom filter and each key a zone map. notifier: told of new files, indexes and compactions.
    """

    spark: SparkSession
    folder: str
    registry: Registry | None = None
    filters: tuple[str, ...] = ()
    notifier: Notifier | None = None

    def __post_init__(self) -> None:
        self.folder = self.folder.rstrip("/")
        self.registry = self.registry or Registry()
        self.manifest = Manifest(self.spark, f"{self.folder}/manifest")
        self._ahead: Rewritten | None = None

    def _tell(self, kind: str, keys: DataFrame) -> None:
        """A notice for each key of the rows."""
        if self.notifier:
            for r in keys.groupBy("partition_key").agg(F.min("path").alias("path")).orderBy("partition_key").toLocalIterator():
                self.notifier.publish(Notice(kind, r.partition_key, r.path))

    def _write(self, rows: DataFrame, folder: str, version: int, batch: str | None, parts: int | None, paths: dict[str, tuple[str, str]] | None = None, more: tuple[Column, ...] = ()) -> DataFrame:
        """Write rows(partition_key, ...) as files, dealt by ranges of CLUSTER into `parts` tasks or, for None, as they come, and give their
        manifest rows, with more aggregates of each file if asked for. A key of any size is spread over as many files as its share of the
        rows asks for; small keys share a task."""
        for name, (path, kind) in (paths or {}).items():
            column, _, rest = path.partition(" ")
            rows = rows.withColumn(name, F.get_json_object(column, rest).try_cast(kind))
        dealt = rows if parts is None else rows.repartitionByRange(parts, *CLUSTER)
        writer = dealt.sortWithinPartitions(*CLUSTER).write.partitionBy("partition_key").option("parquet.bloom.filter.adaptive.enabled", "true")
        for column, rate in BLOOMS.items():
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.fpp#{column}", str(rate))
        writer.parquet(folder)
        back = self.spark.read.schema(rows.schema).parquet(folder).select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
        for column in self.filters:
            values = back.select("path", "partition_key", column).distinct()
            held = bloom.build(values, column, SHAPE, "path").withColumn("column", F.lit(column))
            held.write.mode("append").partitionBy("column").parquet(f"{self.folder}/filters")
            zone_map(values, column).withColumn("column", F.lit(column)).write.mode("append").partitionBy("column").parquet(f"{self.folder}/zones")
        stats = file_stats(back, distinct="none", more=(F.max("size").alias("size_bytes"), *more))
        return stats.select("*", F.lit(version).alias("schema_version"), F.lit(now()).cast("long").alias("created_at"), F.lit(None).cast("long").alias("superseded_at"), F.lit(None).cast("string").alias("compacted_into"), F.lit(batch).cast("string").alias("batch"), F.lit(",".join(self.filters)).alias("filters"))

    def ingest(self, rows: DataFrame, batch: str | None = None, strategy: str = "time", paths: dict[str, tuple[str, str]] | None = None, target: int | None = None) -> DataFrame:
        """Append the good rows and give the bad ones with their errors. A batch that is already there adds nothing; of two writers of one
        batch one adds it. Files that were written and not committed are nobody's until `recover` deletes them. target: bytes of a file;
        by default each key's own, by what it holds."""
        bad = checked(rows).where(F.size("errors") > 0)
        if batch is not None and self.manifest.files().where(F.col("batch") == batch).limit(1).count():
            return bad
        good, lacks = routed(sound(rows).drop("errors"), strategy), F.coalesce(F.length("event_id"), F.lit(0)) == 0
        text = [f.name for f in good.schema if f.dataType.typeName() in ("string", "binary") and f.name not in ("partition_key", "event_id")]
        width = reduce(lambda a, b: a + b, (F.coalesce(F.octet_length(c), F.lit(0)) for c in text), F.lit(16 + 8 * (len(good.columns) - len(text) - 1)))
        each = good.groupBy("partition_key").agg((F.sum(width.cast("long")) * PACKED).alias("total"), F.count_if(lacks).alias("lacking"))
        parts, total, lacking = each.agg(F.sum(F.ceil(F.col("total") / (F.lit(target) if target else targets(F.col("total"))))).alias("n"), F.sum("total"), F.sum("lacking")).first()
        if not parts:
            return bad
        if lacking:  # new ids are made in Python, through which all rows pass
            good = good.withColumn("event_id", F.when(lacks, ulids(F.col("event_time"))).otherwise(F.col("event_id")))
        folder = f"{self.folder}/data/batch={batch or 'one'}-{uuid.uuid4().hex}"
        if parts > 1:  # small keys share files' tasks
            parts = max(1, min(parts, -(-int(total) // (target or target_bytes(0)))))
        files = self._write(good, folder, self.registry.latest().version, batch, int(parts), paths)
        if self.manifest.add(files, batch):
            self._tell("created", files)
        return bad

    def _known(self, name: str, schema: str) -> DataFrame | None:
        """A side table, if there is one."""
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if shared.names(self.spark, f"{self.folder}/{name}") else None

    def files_of(self, predicate: Predicate | None, version: int | None = None) -> DataFrame:
        """Active files that can hold a matching row, told in three phases: least and greatest values, then the zone maps of keys, then the
        files' Bloom filters or an index. A later phase asks only for values that a row must have; files that it knows nothing of stay."""
        files = self.manifest.active(version)
        if predicate is None:
            return files
        files = pruned(files, predicate)
        for column, values in needed(predicate).items():
            if not values:
                continue
            knows = F.array_contains(F.split(F.coalesce("filters", F.lit("")), ","), column)
            if (zones := self._known("zones", "partition_key string, word long, mask long, column string")) is not None:
                keys = zone_may_hold(zones.where(F.col("column") == column), values)
                files = files.where(~knows).unionByName(files.where(knows).join(keys, "partition_key", "left_semi"))
            if (index := self._known(f"index/{column}", "value string, path string, row_count long, min_time long, max_time long, bucket int")) is not None:
                wanted = self.spark.createDataFrame([(str(v),) for v in values], "value string")
                own = index.where(F.col("bucket").isin([r[0] for r in wanted.select(bucket(F.col("value"))).distinct().collect()])).join(F.broadcast(wanted), "value", "left_semi")
                covered = self._known(f"indexed/{column}", "path string")
                fresh = files.select("path").join(covered, "path", "left_anti")
                files = files.join(own.select("path").union(fresh).distinct(), "path", "left_semi")
            elif (held := self._known("filters", "path string, word long, mask long, column string")) is not None:
                asked = self.spark.createDataFrame([(v,) for v in values], "value " + ("long" if isinstance(values[0], int) else "string"))
                hits = bloom.may_hold(held.where(F.col("column") == column), asked, "value", SHAPE, "path").select("path").distinct()
                files = files.where(~knows).unionByName(files.where(knows).join(hits, "path", "left_semi"))
        return files

    def read(self, files: DataFrame) -> DataFrame:
        """Rows of some of the files under the latest schema."""
        return self.read_paths(sorted(r.path for r in files.select("path").collect()))  # a path for each file that is read

    def read_paths(self, paths: list[str]) -> DataFrame:
        """Rows of files by path under the latest schema."""
        return read_files(self.spark, paths, self.registry.latest().spark())

    def scan(self, predicate: Predicate | None = None, version: int | None = None) -> DataFrame:
        """Rows of the active files under the latest schema, files that can't match left out."""
        rows = self.read(self.files_of(predicate, version))
        return rows if predicate is None else rows.where(condition(predicate))

    def index(self, column: str) -> int:
        """Add the active files that a column's index doesn't know to it; the number of them."""
        files = self.manifest.active().select("path", "partition_key")
        if (covered := self._known(f"indexed/{column}", "path string")) is not None:
            files = files.join(covered, "path", "left_anti")
        new = [(r.path, r.partition_key) for r in files.collect()]  # a path for each file that is read
        if new:
            rows = self.spark.read.option("mergeSchema", "true").parquet(*(p for p, _ in new)).withColumn("path", F.col("_metadata.file_path"))
            entries = build_index(rows, column).select("value", "path", "row_count", "min_time", "max_time", "bucket")
            entries.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.folder}/index/{column}")
            told = self.spark.createDataFrame(new, "path string, partition_key string")
            told.select("path").write.mode("append").parquet(f"{self.folder}/indexed/{column}")
            self._tell("indexed", told)
        return len(new)

    def candidates(self, least: int = 2, rows_below: int | None = None, most: int = 100) -> DataFrame:
        """(partition_key, files, rows, total, target): keys with several files below the size that the key should have, or below a number of
        rows; and keys that got more than `most` files in a day, with all files of those days."""
        files = self.manifest.active().withColumn("day", F.floor(F.col("created_at") / 86_400_000))
        total = files.groupBy("partition_key").agg(F.sum("size_bytes").alias("total"))
        files = files.join(total.withColumn("target", targets(F.col("total"))), "partition_key")
        busy = files.groupBy("partition_key", "day").agg(F.count("*").alias("made")).where(F.col("made") > most)
        files = files.join(busy, ["partition_key", "day"], "left")
        small = files.where((F.col("size_bytes") < F.col("target") if rows_below is None else F.col("row_count") < rows_below) | F.col("made").isNotNull())
        found = small.groupBy("partition_key").agg(F.count("*").alias("files"), F.sum("row_count").alias("rows"), F.max("total").alias("total"), F.max("target").alias("target"), F.max("made").alias("made"))
        return found.where((F.col("files") >= least) | F.col("made").isNotNull()).drop("made")

    def compact(self, key: str, drop_duplicates: bool = False, target: int | None = None) -> dict:
        """Rewrite a key's active files as files of the key's target size; all columns are kept. The new files are checked against the old
        ones before they are committed, in one version with the end of the old ones. Of rows with one event_id the least stays. Inside of
        `together` the key is already rewritten and checked, and is committed when that ends."""
        how, work = (drop_duplicates, target), self._ahead
        alone = self._rewrite([key], *how) if work is None else None
        work = work or alone
        if key not in work.told or work.how != how:
            raise ValueError(f"{key} wasn't rewritten this way")
        work.asked.add(key)
        if alone:
            self._commit(alone)
        return work.told[key]

    @contextmanager
    def together(self, keys: Iterable[str], drop_duplicates: bool = False, target: int | None = None) -> Iterator[None]:
        """Compact many keys as one: all are rewritten and checked in a job when the block begins, so that time follows their size and not
        their number, and those that `compact` is called for are committed in one version when it ends. An error, or another writer who
        has replaced one of the files, leaves the last version."""
        self._ahead = work = self._rewrite(list(dict.fromkeys(keys)), drop_duplicates, target)
        try:
            yield
            self._commit(work)
        finally:
            self._ahead = None

    def _rewrite(self, keys: list[str], drop_duplicates: bool, target: int | None) -> Rewritten:
        """Write the active files of some keys anew and check them key by key. A key that becomes one file is written by one task, which small
        keys share; a larger one is dealt by ranges of its own."""
        work, info = Rewritten((drop_duplicates, target)), defaultdict(list)
        wanted = self.spark.createDataFrame([(k,) for k in keys], "partition_key string")
        for r in self.manifest.active().join(F.broadcast(wanted), "partition_key", "left_semi").select("partition_key", "path", "schema_version", "size_bytes").collect():
            info[r.partition_key].append(r)
        work.told = {k: {"key": k, "files": len(info[k]), "rows": 0, "done": False} for k in keys}
        work.old = {k: [r.path for r in info[k]] for k in keys if len(info[k]) > 1}
        total = {k: sum(r.size_bytes or 0 for r in info[k]) for k in work.old}
        number = {k: max(1, -(-total[k] // (target or target_bytes(total[k])))) for k in work.old}
        by_version = defaultdict(list)
        for k in work.old:
            by_version[max(r.schema_version for r in info[k])].append(k)
        for version, found in by_version.items():
            large = [k for k in found if number[k] > 1]
            for group in [[k for k in found if number[k] == 1], *(large[i : i + LARGE] for i in range(0, len(large), LARGE))]:
                self._rewrite_group(work, group, version, total, number)
        return work

    def _rewrite_group(self, work: Rewritten, group: list[str], version: int, total: dict[str, int], number: dict[str, int]) -> None:
        """Keys of one file, or larger ones, in one job."""
        if not group:
            return
        try:
            schema = self.spark.read.option("mergeSchema", "true").parquet(*(p for k in group for p in work.old[k])).drop("partition_key").schema
        except (PySparkException, Py4JJavaError):  # keys whose columns differ in type are no job of one schema
            if len(group) == 1:
                raise
            for k in group:
                self._rewrite_group(work, [k], version, total, number)
            return
        most, slots, filled = max(1, min(work.how[1] or target_bytes(0), -(-sum(total[k] for k in group) // self.spark.sparkContext.defaultParallelism))), {}, 0
        for k in group:
            if not slots or filled + total[k] > most:
                slots[k], filled = max(slots.values(), default=-1) + 1, 0
            else:
                slots[k] = max(slots.values())
            filled += total[k]
        rows = self._rows_of(schema, group, work, slots)
        if work.how[0]:  # told from each other once, for the check and for the files
            rows = rows.persist(StorageLevel.DISK_ONLY)
        before = fingerprints(rows.drop("slot"))
        if number[group[0]] == 1:
            dealt = rows.repartitionById(max(slots.values()) + 1, "slot").drop("slot")
        else:
            each = [(rows.where(F.col("partition_key") == k) if work.how[0] else self._rows_of(schema, [k], work, slots)).drop("slot").repartitionByRange(number[k], *CLUSTER) for k in group]
            dealt = reduce(lambda a, b: a.unionByName(b), each)
        folder = f"{self.folder}/data/batch=compacted-{uuid.uuid4().hex}"
        files = self._write(dealt, folder, version, None, None, more=(hashed(schema.names).alias("hashes"),)).persist()
        rows.unpersist()
        work.files.append(files)
        after = {r.partition_key: (r.n, int(r.h or 0)) for r in files.groupBy("partition_key").agg(F.sum("row_count").alias("n"), F.sum("hashes").alias("h")).collect()}
        for k in {*group, *after}:
            if before.get(k, (0, 0)) != after.get(k, (0, 0)):
                raise RuntimeError(f"compacting {k} changed its rows: {before.get(k)} became {after.get(k)}")
            work.told[k] |= {"rows": before.get(k, (0, 0))[0], "done": True}

    def _rows_of(self, schema, keys: list[str], work: Rewritten, slots: dict[str, int]) -> DataFrame:
        """Rows of some keys' old files, with partition_key and slot; duplicates left out if they are to be."""
        told = self.spark.createDataFrame([(p, k, slots[k]) for k in keys for p in work.old[k]], "file string, key string, slot int")
        rows = self.spark.read.schema(schema).parquet(*(p for k in keys for p in work.old[k])).select("*", F.col("_metadata.file_path").alias("file"))
        rows = rows.join(F.broadcast(told), "file", "left")
        key = F.coalesce("key", F.raise_error(F.concat(F.lit("no key has the file "), F.col("file")))).alias("partition_key")
        rows = rows.select(*schema.names, key, "slot")
        if work.how[0]:
            rows = rows.groupBy("partition_key", "slot", "event_id").agg(F.min(F.struct(*schema.names)).alias("r")).select("r.*", "partition_key", "slot")
        return rows

    def _commit(self, work: Rewritten) -> None:
        """One version with the new files of the keys that were asked for and the end of their old ones."""
        if keys := sorted(k for k in work.asked if k in work.old):
            files = reduce(lambda a, b: a.unionByName(b), work.files).drop("hashes")
            files = files.join(F.broadcast(self.spark.createDataFrame([(k,) for k in keys], "partition_key string")), "partition_key", "left_semi")
            self.manifest.replace([p for k in keys for p in work.old[k]], files, now())
            self._tell("compacted", files)
        for f in work.files:
            f.unpersist()

    def collect_garbage(self, age_ms: int = 7 * 86_400_000, at: int | None = None, dry: bool = False) -> list[str]:
        """Delete files that were superseded long enough ago, from disk and then from the manifest."""
        at = now() if at is None else at
        paths = [r.path for r in self.manifest.files().where(F.col("superseded_at").isNotNull() & (F.col("superseded_at") <= at - age_ms)).select("path").collect()]
        if paths and not dry:
            for p in paths:
                shared.remove(self.spark, p)
            self.manifest.drop(paths)
        return sorted(paths)

    def recover(self, age_ms: int = 86_400_000, at: int | None = None) -> dict:
        """Clean up after writers that died between writing and committing: data files and manifest folders that no version shows and
        that are old enough are deleted. Files of the manifest that are gone are reported, not forgotten. A compaction or a batch
        that died this way left the last version as it was, and is simply done again."""
        before = (now() if at is None else at) - age_ms
        there = self.present(F.unix_millis("modificationTime").alias("at"))
        faults = reconcile(self.manifest.files(), there).join(there, "path", "left").where((F.col("fault") == "dangling") | (F.col("at") <= before))
        found = [(r.path, r.fault) for r in faults.select("path", "fault").collect()]  # what failed, not what there is
        orphans = sorted(p for p, f in found if f == "orphan")
        for p in orphans:
            shared.remove(self.spark, p)
        shown = self.manifest.parts()
        left = [n for n in shared.names(self.spark, self.manifest.folder) if n.startswith("d-") and n not in shown]
        if age_ms <= 0 or left:
            fs, _ = shared._at(self.spark, self.manifest.folder)
            path = self.spark._jvm.org.apache.hadoop.fs.Path
            left = [n for n in left if fs.getFileStatus(path(f"{self.manifest.folder}/{n}")).getModificationTime() <= before]
        for n in left:
            shared.remove(self.spark, f"{self.manifest.folder}/{n}")
        return {"orphans": orphans, "dangling": sorted(p for p, f in found if f == "dangling"), "folders": left}

    def present(self, *more: Column) -> DataFrame:
        """(path) of all data files on disk, with more about them if asked for (of path, modificationTime and length)."""
        schema = "path string, modificationTime timestamp, length long, content binary"
        if not shared.names(self.spark, f"{self.folder}/data"):
            return self.spark.createDataFrame([], schema).select("path", *more)
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.folder}/data").select("path", *more)


def hashed(columns: list[str]) -> Column:
    """A sum of rows' hashes that doesn't depend on their order."""
    return F.sum(F.xxhash64(*sorted(columns)).cast("decimal(38,0)"))


def fingerprint(rows: DataFrame) -> tuple[int, int]:
    """Rows and the sum of their hashes."""
    r = rows.agg(F.count("*").alias("n"), hashed(rows.columns).alias("h")).first()
    return r["n"], int(r["h"] or 0)


def fingerprints(rows: DataFrame) -> dict[str, tuple[int, int]]:
    """The fingerprint of each key's rows, without the key."""
    own = [c for c in rows.columns if c != "partition_key"]
    return {r["partition_key"]: (r["n"], int(r["h"] or 0)) for r in rows.groupBy("partition_key").agg(F.count("*").alias("n"), hashed(own).alias("h")).collect()}


def build_index(rows: DataFrame, column: str, buckets: int = 64) -> DataFrame:
    """(bucket, value, path, row_count, min_time, max_time): where each value lies; written by bucket, a lookup reads one."""
    return rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value"), "path").agg(F.count("*").alias("row_count"), F.min("event_time").alias("min_time"), F.max("event_time").alias("max_time")).withColumn("bucket", bucket(F.col("value"), buckets))


def bucket(value: Column, buckets: int = 64) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def lookup(index: DataFrame, value: str, buckets: int = 64) -> DataFrame:
    """Index entries of a value."""
    return index.where((F.col("bucket") == bucket(F.lit(value), buckets)) & (F.col("value") == value))


def files_for(active: DataFrame, index: DataFrame, value: str, indexed: DataFrame) -> DataFrame:
    """Active files that hold the value or that the index doesn't know yet."""
    hits = lookup(index, value).select("path")
    fresh = active.join(indexed.select("path"), "path", "left_anti").select("path")
    return active.join(hits.union(fresh).distinct(), "path", "left_semi")


def json_path(rows: DataFrame, path: str, kind: str, column: str = "payload", name: str | None = None) -> Column:
    """A JSON path's value: the column that it is kept in, where there is one, or else taken from the text."""
    from_text = F.get_json_object(F.col(column), path).cast(kind)
    return F.coalesce(F.col(name).cast(kind), from_text) if name in rows.columns else from_text
