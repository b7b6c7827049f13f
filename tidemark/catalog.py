"""All queries of the event engine, gathered from their modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.engine import Engine
from tidemark.operators.management import QUERIES as MANAGEMENT
from tidemark.operators.statements import ORACLE_VIEW, STATEMENTS
from tidemark.registry import Registry
from tidemark.sources.tables import events, table

CATALOG = Registry()
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
FLAGSHIP = "SELECT user_id, COUNT(*) AS n FROM ev WHERE tenant_id = 'tenant_05' AND event_time BETWEEN 1704067200000000 AND 1706659199999999 GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10"


def engine(spark: SparkSession, sf_dir: str, text: str) -> Engine:
    """An engine that knows the tables that the statement names."""
    out = Engine(spark)
    out.register("ev", events(spark, sf_dir))
    for name in TABLES:
        if f" {name} " in text:
            out.register(name, table(spark, sf_dir, name))
    return out


def _statement(text: str):
    return lambda spark, sf_dir: engine(spark, sf_dir, text).sql(text)


for _name, _text, _oracle in [("q_flagship", FLAGSHIP, None), *STATEMENTS]:
    CATALOG.add(_name, _statement(_text), ORACLE_VIEW + (_oracle or _text))
for _name, _query in MANAGEMENT.queries.items():
    CATALOG.add(_name, _query, MANAGEMENT.oracle.get(_name))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The busiest users of one tenant in a month."""
    return CATALOG.queries["q_flagship"](spark, sf_dir)
