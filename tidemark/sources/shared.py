"""Small files on a store that several writers share: created whole and only once, and read back."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole text, or return False if there is one already. Its text is written under another name first, and the
    name is then taken in one step: by a hard link on a local disk, elsewhere by a rename that refuses to overwrite. A reader never sees half
    a file, and a writer that dies leaves only a file that nobody looks at."""
    fs, target = _at(spark, path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs.mkdirs(target.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}.draft")
    out = fs.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            files = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, draft)]
            jvm.java.nio.file.Files.createLink(*files)
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
            none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs.Options, "Rename"), 0)
            context.rename(fs.makeQualified(draft), fs.makeQualified(target), none)
        return True
    except Py4JJavaError:
        if fs.exists(target):
            return False
        raise
    finally:
        fs.delete(draft, False)


def text_of(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    fs, p = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file, or a folder with all that is in it."""
    fs, p = _at(spark, path)
    fs.delete(p, True)
