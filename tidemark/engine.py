"""The query surface: SQL text or DataFrames over registered tables and stores, with a result envelope.

A statement over a store reads only the files that it can need: its filters, as Catalyst pushes them down to the scan, narrow the manifest's
files before any of them is listed or opened.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.dialect import translate
from tidemark.operators.storage import Store
from tidemark.plans.extract import asked, scans
from tidemark.plans.usage import Usage
from tidemark.session import work_dir


@dataclass
class Result:
    """columns, rows and what is known about the run."""

    columns: list[str]
    rows: list[tuple]
    stats: dict = field(default_factory=dict)
    request_id: str = ""


class Engine:
    def __init__(self, spark: SparkSession, usage: Usage | None = None) -> None:
        self.spark = spark
        self.usage = usage or Usage()
        self.paths: dict[str, str] = {}
        self.stores: dict[str, tuple[Store, str]] = {}
        self.last: dict[str, int] = {}

    def register(self, name: str, df: DataFrame) -> None:
        """Make a table known to SQL by name."""
        df.createOrReplaceTempView(name)

    def register_store(self, name: str, store: Store) -> None:
        """Make a store's rows known to SQL by name; each statement reads the files that it can need."""
        folder = f"{work_dir(self.spark)}/empty"
        self.spark.createDataFrame([], store.read(store.manifest.files(0)).schema).write.parquet(folder)
        self.stores[name] = (store, folder)

    def _stored(self, text: str) -> None:
        """Register each store that the statement names with the files that it needs, and count them."""
        self.last = {}
        if not self.stores:
            return
        for name, (store, folder) in self.stores.items():
            self.spark.read.schema(store.read(store.manifest.files(0)).schema).parquet(folder).createOrReplaceTempView(name)
        plan = self.spark.sql(text)
        scanned = total = 0
        for name, (store, folder) in self.stores.items():
            version = store.manifest.version()
            if not scans(plan, folder):
                continue
            files = store.files_of(asked(plan, folder), version)
            paths = sorted(r.path for r in files.select("path").collect())  # a path for each file that is read
            scanned += len(paths)
            total += store.manifest.active(version).count()
            store.read_paths(paths).createOrReplaceTempView(name)
        self.last = {"scanned": scanned, "pruned": total - scanned}

    def materialized(self, column: str, path: str, name: str) -> None:
        """Tell that a JSON path of a column is kept as a column of its own."""
        self.paths[f"{column} {path}"] = name

    def sql(self, text: str) -> DataFrame:
        """A SELECT statement of the dialect as a DataFrame; errors of syntax and names are raised, never swallowed."""
        translated = translate(text, self.paths)
        self._stored(translated)
        df = self.spark.sql(translated)
        self.usage.record(text)
        return df

    def query(self, text: str, most: int = 100_000) -> Result:
        """The statement's rows on the driver, with the files read and left out; a result of over `most` rows is an error: such results are
        written from `sql(...)`."""
        began = time.perf_counter()
        df = self.sql(text)
        rows = [tuple(r) for r in df.limit(most + 1).toLocalIterator()]
        if len(rows) > most:
            raise ValueError(f"the result has more than {most} rows")
        took = round((time.perf_counter() - began) * 1000, 3)
        return Result(df.columns, rows, {"rows": len(rows), "ms": took, "partitions_scanned": self.last.get("scanned"), "partitions_pruned": self.last.get("pruned")}, uuid.uuid4().hex)
