"""Session factory and settings that every job relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Settings under which results are defined: UTC time, text directory keys, adaptive plans.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str | None = None, app: str = "tidemark", **extra: str) -> SparkSession:
    """A session with SETTINGS; `extra` keys use `__` for dots. A running session is reused as it is."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, `spark.checkpoint.dir`; where that is unset, as in tests, a local one for this process. On a
    cluster, where machines can't see each other's folders, it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder or folder == "<undefined>":
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines share; the master is {master or 'unknown'}")
        folder = _LOCAL.setdefault("folder", "") or tempfile.mkdtemp(prefix="tidemark-")
        _LOCAL["folder"] = folder
    return folder.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """A new folder for a job's own files inside the shared one."""
    return f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
