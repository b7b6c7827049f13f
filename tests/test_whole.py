"""Queries that go over all events."""

import duckdb
import pytest

from tests.oracle import answer, asked
from tidemark.catalog import CATALOG

DATA = "/root/testdata/sf0.01"
WHOLE = [n for n in ("q_star", "q_qualified_star", "q_alias", "q_literal_escape", "q_order_asc", "q_order_multi", "q_order_nonprojected", "q_json_build", "q_math", "x_window")]


@pytest.mark.parametrize("name", WHOLE)
def test_all_events_are_asked(spark, name):
    got = CATALOG.queries[name](spark, DATA)
    [(rows, users)] = duckdb.sql(f"SELECT COUNT(*), COUNT(DISTINCT user_id) FROM read_parquet('{DATA}/events.parquet')").fetchall()
    assert got.count() == (users if name == "q_math" else rows)
    assert asked(got) == answer(DATA, CATALOG.oracle[name])


@pytest.mark.parametrize("name", [n for n in WHOLE if "order" in n])
def test_all_events_are_sorted(spark, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{DATA}/events.parquet')")
    got = CATALOG.queries[name](spark, DATA)
    assert [r["event_id"] for r in got.collect()] == [r[0] for r in c.execute(f"SELECT event_id FROM ({CATALOG.oracle[name]})").fetchall()]
