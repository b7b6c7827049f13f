"""Which files a predicate can touch, told from the manifest alone.

Predicates are trees of tuples: ("and", p, q...), ("or", p, q...), ("not", p), ("=", column, value), ("<" "<=" ">" ">=" likewise), ("in", column, values),
("between", column, low, high), ("null", column), and ("any",) for what can't be told. Only what must hold narrows the files: conjuncts, and a disjunction if all its
branches narrow. Negations, unknown columns and null statistics keep the file, so no file with a matching row is left out.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = ("user_id", "event_time", "tenant_id")
Predicate = tuple


def day(micros: int) -> str:
    """The partition key of a time."""
    return datetime.fromtimestamp(micros // 1_000_000, timezone.utc).strftime("%Y%m%d")


def _may(low: Column, high: Column) -> Column:
    """Unknown statistics keep the file."""
    return F.coalesce(low & high, F.lit(True))


def may_match(p: Predicate, time_keys: bool = True) -> Column | None:
    """A condition on manifest rows that holds for every file with a matching row; None if the predicate tells nothing."""
    kind = p[0]
    if kind == "and":
        parts = [c for c in (may_match(x, time_keys) for x in p[1:]) if c is not None]
        return reduce(lambda a, b: a & b, parts) if parts else None
    if kind == "or":
        parts = [may_match(x, time_keys) for x in p[1:]]
        return None if not parts or any(c is None for c in parts) else reduce(lambda a, b: a | b, parts)
    if kind in ("not", "null", "any") or p[1] not in (*STATS, "partition_key"):
        return None
    column = p[1]
    if kind == "in":
        return reduce(lambda a, b: a | b, (may_match(("=", column, v), time_keys) for v in p[2])) if p[2] else F.lit(False)
    low, high = {"=": lambda: (p[2], p[2]), "between": lambda: (p[2], p[3]), ">": lambda: (p[2], None), ">=": lambda: (p[2], None), "<": lambda: (None, p[2]), "<=": lambda: (None, p[2])}[kind]()
    if column == "partition_key":
        least, greatest = F.col("partition_key"), F.col("partition_key")
    else:
        least, greatest = F.col(f"min_{column}"), F.col(f"max_{column}")
    out = F.coalesce(_may(greatest >= F.lit(low) if low is not None else F.lit(True), least <= F.lit(high) if high is not None else F.lit(True)), F.lit(True))
    if column == "event_time" and time_keys:  # one-sided bounds; only keys that are days
        key = F.col("partition_key")
        bounds = [key >= day(low)] if low is not None else []
        bounds += [key <= day(high)] if high is not None else []
        out = out & F.when(key.rlike(r"^\d{8}$"), reduce(lambda a, b: a & b, bounds)).otherwise(F.lit(True))
    return out


def needed(p: Predicate) -> dict[str, list]:
    """For columns that must equal one of some values in every matching row, those values."""
    out: dict[str, list] = {}
    for q in p[1:] if p[0] == "and" else (p,):
        if q[0] == "and":
            more = needed(q)
        else:
            more = {q[1]: [q[2]]} if q[0] == "=" else {q[1]: list(q[2])} if q[0] == "in" else {}
        for column, values in more.items():
            if all(isinstance(v, int) for v in values) or all(isinstance(v, str) for v in values):
                out[column] = [v for v in values if v in out[column]] if column in out else values
    return out


def pruned(files: DataFrame, p: Predicate) -> DataFrame:
    """The files that the predicate can touch."""
    condition = may_match(p)
    return files if condition is None else files.where(condition)


def counts(files: DataFrame, p: Predicate) -> DataFrame:
    """One row: files, matched, pruned, ratio."""
    condition = may_match(p)
    hit = F.lit(True) if condition is None else condition
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.when(hit, 1).otherwise(0)), F.lit(0)).cast("long").alias("matched")).select("files", "matched", (F.col("files") - F.col("matched")).alias("pruned"), F.coalesce((F.col("files") - F.col("matched")) / F.nullif(F.col("files"), F.lit(0)), F.lit(0.0)).alias("ratio"))


def condition(p: Predicate) -> Column:
    """The predicate on rows."""
    kind = p[0]
    if kind in ("and", "or"):
        return reduce((lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b), map(condition, p[1:]))
    if kind == "not":
        return ~condition(p[1])
    if kind == "any":
        raise ValueError("what can't be told isn't a condition on rows")
    c = F.col(p[1])
    return {"=": lambda: c == p[2], "<": lambda: c < p[2], "<=": lambda: c <= p[2], ">": lambda: c > p[2], ">=": lambda: c >= p[2], "in": lambda: c.isin(list(p[2])), "between": lambda: c.between(p[2], p[3]), "null": c.isNull}[kind]()
