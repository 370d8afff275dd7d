"""Small files and folders below the shared folder, through Spark's own file systems."""

from __future__ import annotations

import json
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession


@lru_cache(maxsize=4)
def _classes(jvm):
    """Path, FileContext and the options of a rename: each part of a name costs a call to the JVM, so they are looked up once."""
    fs = jvm.org.apache.hadoop.fs
    return fs.Path, fs.FileContext, getattr(fs, "Options$Rename")


def _at(spark: SparkSession, path: str):
    p = _classes(spark._jvm)[0](path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is missing."""
    p, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def replace_folder(spark: SparkSession, new: str, old: str) -> None:
    """Put the folder ``new`` in the place of ``old``, which goes if it is there."""
    a, fs = _at(spark, new)
    b, _ = _at(spark, old)
    fs.delete(b, True)
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"cannot rename {new} to {old}")


def put_json(spark: SparkSession, path: str, value, only_new: bool = False) -> None:
    """Write a small JSON file whole or not at all: a file of another name is renamed onto ``path``.

    ``only_new`` fails where the file is there already.
    """
    p, fs = _at(spark, path)
    own, _ = _at(spark, f"{p.getParent()}/.{p.getName()}-{uuid.uuid4().hex[:8]}")
    out = fs.create(own, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    # nothing to replace: a plain rename, which on a local disk starts no program to look at links
    if not only_new and not fs.exists(p) and fs.rename(own, p):
        return
    (_, files, how), conf = _classes(spark._jvm), spark.sparkContext._jsc.hadoopConfiguration()
    options = spark.sparkContext._gateway.new_array(how, 1)
    options[0] = how.NONE if only_new else how.OVERWRITE
    context = files.getFileContext(own.toUri(), conf)
    try:
        context.rename(context.makeQualified(own), context.makeQualified(p), options)
    except Exception:
        fs.delete(own, False)
        raise


def get_json(spark: SparkSession, path: str):
    """The value of a small JSON file, or None if it is missing."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if exists(spark, path) else None
