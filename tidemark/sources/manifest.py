"""The manifest: a versioned table of data files and their statistics, grown by increments.

A commit writes its rows as a Parquet folder with a name that no other writer uses, and then takes the next version's marker file, which
can be created only once and lists the folders that make up the version. A reader pins a version; a crash before the marker leaves the
last one; of two writers one gets the marker, and the other reads the new version, checks that its change still makes sense, and tries
again with the rows it has written. After MOST increments a commit writes the table anew as one folder.

Files are told by path. A file is added, later superseded, at last forgotten, so of several rows of a path the one that is furthest counts.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tidemark.sources import shared

FILES = S.StructType(
    [
        S.StructField("path", S.StringType()),
        S.StructField("partition_key", S.StringType()),
        S.StructField("min_user_id", S.LongType()),
        S.StructField("max_user_id", S.LongType()),
        S.StructField("min_event_time", S.LongType()),
        S.StructField("max_event_time", S.LongType()),
        S.StructField("min_tenant_id", S.StringType()),
        S.StructField("max_tenant_id", S.StringType()),
        S.StructField("row_count", S.LongType()),
        S.StructField("size_bytes", S.LongType()),
        S.StructField("schema_version", S.IntegerType()),
        S.StructField("created_at", S.LongType()),
        S.StructField("superseded_at", S.LongType()),
        S.StructField("compacted_into", S.StringType()),
        S.StructField("batch", S.StringType()),
        S.StructField("filters", S.StringType()),
    ]
)
#: How far a file's row is: added, superseded, forgotten.
ADDED, SUPERSEDED, FORGOTTEN = range(3)
ROWS = S.StructType([*FILES.fields, S.StructField("state", S.IntegerType())])
#: Increments that a version is read from at most, manifest rows of a written file, and tries against other writers.
MOST, ROWS_A_FILE, TRIES = 16, 1_000_000, 50
STATS = ("user_id", "event_time", "tenant_id")


def file_stats(rows: DataFrame, path: str = "path", distinct: str = "exact", more: tuple[Column, ...] = ()) -> DataFrame:
    """Least and greatest values, rows, and numbers of distinct values for each file of rows(path, partition_key, ...). distinct: `exact`
    counts, which move every value; `sketch`, estimates by sketches that are merged; or `none`. more: aggregates told in the same pass."""
    aggregates = [f(c).alias(f"{n}_{c}") for c in STATS for n, f in (("min", F.min), ("max", F.max))]
    count = {"exact": lambda c: [F.count_distinct(c)], "sketch": lambda c: [F.approx_count_distinct(c, 0.02)], "none": lambda c: []}[distinct]
    return rows.groupBy(path, "partition_key").agg(*aggregates, F.count("*").alias("row_count"), *(x.alias(f"n_{c}") for c in STATS for x in count(c)), *more)


class Manifest:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def version(self) -> int:
        """The last committed version; 0 for none."""
        return max((int(n[1:-5]) for n in shared.names(self.spark, self.folder) if n.startswith("v") and n.endswith(".done")), default=0)

    def _marker(self, version: int) -> dict:
        """parts: folders of the version; plain: whether each path has one row in them; rows: how many there are about."""
        return json.loads(shared.text_of(self.spark, f"{self.folder}/v{version}.done")) if version else {"parts": [], "plain": True, "rows": 0}

    def files(self, version: int | None = None) -> DataFrame:
        """All files of a version, superseded ones too."""
        now = self._marker(self.version() if version is None else version)
        if not now["parts"]:
            return self.spark.createDataFrame([], FILES)
        rows = self.spark.read.schema(ROWS).parquet(*(f"{self.folder}/{p}" for p in now["parts"]))
        if not now["plain"]:
            rows = rows.groupBy("path").agg(F.max_by(F.struct(*ROWS.names), "state").alias("r")).select("r.*").where(F.col("state") < FORGOTTEN)
        return rows.select(*FILES.names)

    def active(self, version: int | None = None) -> DataFrame:
        return self.files(version).where("compacted_into is null")

    def _write(self, rows: DataFrame) -> tuple[str, int]:
        """A folder of manifest rows that no version shows yet, and their number."""
        name = f"d-{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}"
        for f in ROWS:
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
        rows.select(*(F.col(f.name).cast(f.dataType) for f in ROWS)).write.option("maxRecordsPerFile", ROWS_A_FILE).parquet(path)
        return name, self.spark.read.schema(ROWS).parquet(path).count()

    def _mark(self, base: int, name: str, n: int, fresh: bool) -> bool:
        """Make the folder part of the next version; False if another writer was first. fresh: the rows' paths are new."""
        now = self._marker(base)
        parts, plain, total = [*now["parts"], name], now["plain"] and fresh, now["rows"] + n
        if len(parts) > MOST:
            rows = self.spark.read.schema(ROWS).parquet(*(f"{self.folder}/{p}" for p in parts))
            if not plain:
                rows = rows.groupBy("path").agg(F.max_by(F.struct(*ROWS.names), "state").alias("r")).select("r.*").where(F.col("state") < FORGOTTEN)
            whole, total = self._write(rows.repartition(1 + total // ROWS_A_FILE))
            parts, plain = [whole], True
        return shared.put_new(self.spark, f"{self.folder}/v{base + 1}.done", json.dumps({"parts": parts, "plain": plain, "rows": total}))

    def commit(self, files: DataFrame, base: int) -> int:
        """Write the next version as a whole; refused if another one was committed after `base`."""
        if self.version() != base:
            raise RuntimeError(f"version {base} isn't the last one")
        name, n = self._write(files.withColumn("state", F.when(F.col("compacted_into").isNull(), ADDED).otherwise(SUPERSEDED)))
        if not shared.put_new(self.spark, f"{self.folder}/v{base + 1}.done", json.dumps({"parts": [name], "plain": True, "rows": n})):
            raise RuntimeError(f"version {base + 1} was committed by another writer")
        return base + 1

    def add(self, files: DataFrame, batch: str | None = None) -> bool:
        """Add files; a batch that is already there adds nothing, and False is returned. Writers that add at once all succeed."""
        name = None
        for _ in range(TRIES):
            base = self.version()
            if batch is not None and self.files(base).where(F.col("batch") == batch).limit(1).count():
                return False
            if name is None:
                name, n = self._write(files.withColumn("batch", F.lit(batch).cast("string")).withColumn("state", F.lit(ADDED)))
            if self._mark(base, name, n, True):
                return True
        raise RuntimeError(f"other writers were first {TRIES} times")

    def _paths(self, paths: list[str] | DataFrame) -> DataFrame:
        return paths.select("path") if isinstance(paths, DataFrame) else self.spark.createDataFrame([(p,) for p in paths], "path string")

    def replace(self, old: list[str] | DataFrame, new: DataFrame, at: int) -> None:
        """Mark files as compacted into the new ones of their key, and add those, in one version. Refused if one of the files isn't active any
        more."""
        old = self._paths(old).distinct()
        many, name = old.count(), None
        for _ in range(TRIES):
            base = self.version()
            gone = self.active(base).join(old, "path", "left_semi")
            if gone.count() != many:
                raise RuntimeError("some of the files aren't active any more")
            if name is None:
                into = new.groupBy("partition_key").agg(F.min("path").alias("into"))
                gone = gone.join(F.broadcast(into), "partition_key", "left").withColumn("compacted_into", F.coalesce("into", F.lit(uuid.uuid4().hex))).drop("into")
                gone = gone.withColumn("superseded_at", F.lit(at)).withColumn("state", F.lit(SUPERSEDED))
                name, n = self._write(gone.unionByName(new.withColumn("state", F.lit(ADDED)), allowMissingColumns=True))
            if self._mark(base, name, n, False):
                return
        raise RuntimeError(f"other writers were first {TRIES} times")

    def drop(self, paths: list[str] | DataFrame) -> None:
        """Forget files."""
        name, n = self._write(self._paths(paths).distinct().withColumn("state", F.lit(FORGOTTEN)))
        for _ in range(TRIES):
            if self._mark(self.version(), name, n, False):
                return
        raise RuntimeError(f"other writers were first {TRIES} times")

    def parts(self) -> set[str]:
        """Folders that some version shows."""
        return {p for n in shared.names(self.spark, self.folder) if n.endswith(".done") and n.startswith("v") for p in self._marker(int(n[1:-5]))["parts"]}


def zone_map(rows: DataFrame, column: str, bits: int = 1 << 16) -> DataFrame:
    """For each key a bit map of its values' hashes, as (partition_key, word, mask) rows; all of one size, so that they can be united."""
    spot = F.pmod(F.xxhash64(F.col(column)), F.lit(bits))
    return rows.where(F.col(column).isNotNull()).select("partition_key", F.shiftright(spot, 5).alias("word"), spot.bitwiseAND(31).cast("int").alias("s")).groupBy("partition_key", "word").agg(F.expr("bit_or(shiftleft(1L, s))").alias("mask"))


def zone_may_hold(zones: DataFrame, values: list, bits: int = 1 << 16) -> DataFrame:
    """Keys whose bit map may hold one of the values."""
    spark = zones.sparkSession
    wanted = spark.createDataFrame([(v,) for v in values], "v " + ("long" if all(isinstance(v, int) for v in values) else "string"))
    spot = F.pmod(F.xxhash64("v"), F.lit(bits))
    wanted = wanted.select(F.shiftright(spot, 5).alias("word"), spot.bitwiseAND(31).cast("int").alias("s"))
    return zones.join(F.broadcast(wanted), "word").where(F.expr("(mask & shiftleft(1L, s)) <> 0")).select("partition_key").distinct()


def reconcile(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """(path, fault): `dangling` files are in the manifest only, `orphan` ones on disk only. Superseded files are known ones; sidecars don't count."""
    known, there = manifest.select("path").distinct(), present.select("path").where("path like '%.parquet'").distinct()
    return known.join(there, "path", "left_anti").withColumn("fault", F.lit("dangling")).unionByName(there.join(known, "path", "left_anti").withColumn("fault", F.lit("orphan")))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames, missing columns as null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
