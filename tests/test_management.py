"""What the data-management queries do on the way to their rows."""

from pyspark.sql import functions as F

from tidemark.catalog import CATALOG
from tidemark.operators import storage
from tidemark.sources.manifest import Manifest
from tidemark.sources.tables import events

DATA = "/root/testdata/sf0.001"


def spied(monkeypatch, name):
    """Calls of a Store's method, as (arguments, result)."""
    calls, method = [], getattr(storage.Store, name)

    def call(self, *args, **more):
        out = method(self, *args, **more)
        calls.append((args, more, out))
        return out

    monkeypatch.setattr(storage.Store, name, call)
    return calls


def test_every_candidate_is_compacted(spark, monkeypatch):
    calls = spied(monkeypatch, "compact")
    CATALOG.queries["m_compaction_invariant"](spark, DATA).collect()
    both = events(spark, DATA).groupBy("partition_key").agg(F.count_distinct(F.col("user_id") % 2).alias("parts")).where("parts = 2")
    assert sorted(args[0] for args, _, _ in calls) == sorted(r.partition_key for r in both.collect())
    assert all(out["done"] for _, _, out in calls)


def test_duplicates_go_by_compaction(spark, monkeypatch):
    calls = spied(monkeypatch, "compact")
    got = CATALOG.queries["m_duplicate_ids"](spark, DATA).first()
    assert calls and all(more == {"drop_duplicates": True} and out["done"] for _, more, out in calls)
    assert got.rows == 2 * got.ids == 2 * sum(out["rows"] for _, _, out in calls)


def versions_of(monkeypatch, spark, name):
    """How many versions end files while a query runs, and how often rows are written."""
    ends, writes = [], []
    replace, write = Manifest.replace, storage.Store._write
    monkeypatch.setattr(Manifest, "replace", lambda *args: (ends.append(1), replace(*args))[1])
    monkeypatch.setattr(storage.Store, "_write", lambda *args, **more: (writes.append(1), write(*args, **more))[1])
    CATALOG.queries[name](spark, DATA).collect()
    return len(ends), len(writes)


def test_duplicates_of_all_days_go_in_one_job(spark, monkeypatch):
    assert versions_of(monkeypatch, spark, "m_duplicate_ids") == (1, 3)


def test_candidates_are_compacted_in_one_job(spark, monkeypatch):
    assert versions_of(monkeypatch, spark, "m_compaction_invariant") == (1, 3)


def test_candidates_come_from_the_store(spark, monkeypatch):
    calls = spied(monkeypatch, "candidates")
    got = CATALOG.queries["m_compaction_candidates"](spark, DATA).collect()
    assert len(calls) == 1 and sorted(map(tuple, got)) == sorted((r.partition_key, r.files, r.rows) for r in calls[0][2].collect())
