"""Declared, versioned schemas: validity rules, a registry, what changed between versions, and rows that break the rules."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tidemark.sources import shared

TYPES = {"TEXT": S.StringType(), "INTEGER": S.LongType(), "REAL": S.DoubleType(), "BLOB": S.BinaryType()}


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = True
    key: bool = False


@dataclass(frozen=True)
class Schema:
    version: int
    columns: tuple[Column, ...]
    indexes: tuple[tuple[str, ...], ...] = ()

    def faults(self) -> list[str]:
        """What makes the schema invalid; empty if nothing does."""
        names = [c.name for c in self.columns]
        out = [] if self.version >= 1 else ["version below 1"]
        out += ["no columns"] if not names else []
        out += [f"unnamed column {i}" for i, n in enumerate(names) if not n]
        out += [f"{n} twice" for n in sorted({n for n in names if n and names.count(n) > 1})]
        out += [f"{c.name} has the unknown type {c.type}" for c in self.columns if c.type not in TYPES]
        out += [] if any(c.key for c in self.columns) else ["no key"]
        out += [f"index on {n}, which isn't a column" for i in self.indexes for n in i if n not in names]
        return out

    def spark(self) -> S.StructType:
        return S.StructType([S.StructField(c.name, TYPES[c.type], c.nullable) for c in self.columns])

    def same(self, other: Schema) -> bool:
        """Equal but for the version."""
        return (self.columns, self.indexes) == (other.columns, other.indexes)


EVENTS_V1 = Schema(
    1,
    (
        Column("event_id", "BLOB", False, True),
        Column("tenant_id", "TEXT", False),
        Column("user_id", "INTEGER", False),
        Column("event_time", "INTEGER", False),
        Column("event_type", "TEXT", False),
        Column("payload", "TEXT", False),
    ),
    (("tenant_id", "event_time"), ("user_id", "event_time")),
)


@dataclass
class Registry:
    """Versions of a schema. With a folder they are kept there, one file each that can be created only once, so that they outlive the process
    and two writers can't give one number to different schemas."""

    versions: list[Schema] = field(default_factory=lambda: [EVENTS_V1])
    spark: SparkSession | None = None
    folder: str | None = None

    def __post_init__(self) -> None:
        if self.folder:
            self.folder = self.folder.rstrip("/")
            for v in self.versions:
                shared.put_new(self.spark, f"{self.folder}/v{v.version}.json", self._text(v))
            self.reload()

    @staticmethod
    def _text(schema: Schema) -> str:
        return json.dumps(asdict(schema))

    def reload(self) -> None:
        """Read the versions that any writer has registered."""
        if self.folder:
            found = [json.loads(shared.text_of(self.spark, f"{self.folder}/{n}")) for n in shared.names(self.spark, self.folder) if n.startswith("v") and n.endswith(".json")]
            self.versions = sorted((Schema(x["version"], tuple(Column(**c) for c in x["columns"]), tuple(map(tuple, x["indexes"]))) for x in found), key=lambda v: v.version)

    def register(self, schema: Schema) -> Schema:
        """The known version that equals the schema, or a new one."""
        if faults := schema.faults():
            raise ValueError("; ".join(faults))
        while True:
            self.reload()
            for known in self.versions:
                if known.same(schema):
                    return known
            new = Schema(max(v.version for v in self.versions) + 1 if self.versions else 1, schema.columns, schema.indexes)
            if not self.folder or shared.put_new(self.spark, f"{self.folder}/v{new.version}.json", self._text(new)):
                self.versions.append(new)
                return new

    def latest(self) -> Schema:
        return max(self.versions, key=lambda v: v.version)

    def added(self, old: int, new: int) -> list[str]:
        """Columns of the new version that the old one lacks."""
        by = {v.version: [c.name for c in v.columns] for v in self.versions}
        return [n for n in by[new] if n not in by[old]]


RULES = [
    ("event_id: 0 or 16 bytes", lambda: F.col("event_id").isNotNull() & ~F.length("event_id").isin(0, 16)),
    ("tenant_id: empty", lambda: F.col("tenant_id").isNull() | (F.col("tenant_id") == "")),
    ("user_id: missing", lambda: F.col("user_id").isNull()),
    ("event_time: not above 0", lambda: F.col("event_time").isNull() | (F.col("event_time") <= 0)),
    ("event_type: empty", lambda: F.col("event_type").isNull() | (F.col("event_type") == "")),
    ("payload: missing", lambda: F.col("payload").isNull()),
]


def checked(rows: DataFrame) -> DataFrame:
    """Event rows with `errors`: every rule that a row breaks, in order; empty for good rows."""
    return rows.withColumn("errors", F.filter(F.array(*(F.when(bad(), F.lit(name)) for name, bad in RULES)), lambda x: x.isNotNull()))


def sound(rows: DataFrame) -> DataFrame:
    """Event rows that break no rule, told without an array for each row."""
    for _, bad in RULES:
        rows = rows.where(~bad())
    return rows
