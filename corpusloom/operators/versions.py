"""Keyed tables in buckets, with versions: an update writes the buckets that it touches and moves a pointer."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.operators.memory import KEY, sparse_upsert
from corpusloom.runtime import small_join
from corpusloom.sources.files import get_json, names, put_json

POINTER = "current.json"


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in key]), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, root: str, key: list[str], buckets: int) -> dict[str, str]:
    """Write ``rows`` by bucket into a folder of their own; returns bucket -> folder below ``root``."""
    spark, own = rows.sparkSession, f"data/{uuid.uuid4().hex[:12]}"
    n = min(buckets, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    d = rows.withColumn("__bucket", bucket_of(key, buckets)).repartition(n, "__bucket").sortWithinPartitions("__bucket", *key)
    d.write.partitionBy("__bucket").parquet(f"{root}/{own}")
    return {x.split("=")[1]: f"{own}/{x}" for x in names(spark, f"{root}/{own}") if x.startswith("__bucket=")}


def create_table(rows: DataFrame, root: str, guard: dict, key: list[str] = KEY, buckets: int = 64) -> int:
    """Write version 0 of a table with one row for each ``key``; ``guard`` (checksum, shape, ...) is kept with it."""
    spark = rows.sparkSession
    meta = {"version": 0, "key": key, "buckets": buckets, "guard": guard, "schema": rows.schema.json(), "folders": _write(rows, root, key, buckets)}
    put_json(spark, f"{root}/versions/0.json", meta, only_new=True)
    put_json(spark, f"{root}/{POINTER}", {"version": 0})
    return 0


def table_version(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """What is recorded of a version, or of the current one."""
    if version is None:
        version = (get_json(spark, f"{root}/{POINTER}") or {"version": None})["version"]
    meta = get_json(spark, f"{root}/versions/{version}.json")
    if meta is None:
        raise FileNotFoundError(f"no version {version} of a table in {root}")
    return meta


def _read(spark: SparkSession, root: str, meta: dict, buckets: list[str]) -> DataFrame:
    schema = StructType.fromJson(json.loads(meta["schema"]))
    paths = [f"{root}/{meta['folders'][b]}" for b in buckets if b in meta["folders"]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, root: str, guard: dict | None = None, version: int | None = None) -> DataFrame:
    """Rows of a version (the current one); fails if its guard differs from ``guard``."""
    meta = table_version(spark, root, version)
    _agree(meta, guard)
    return _read(spark, root, meta, sorted(meta["folders"]))


def _agree(meta: dict, guard: dict | None) -> None:
    odd = sorted(k for k in guard if meta["guard"].get(k) != guard[k]) if guard else []
    if odd:
        raise ValueError(f"the table's {', '.join(odd)} differ; version {meta['version']} stays")


def update_table(spark: SparkSession, root: str, updates: DataFrame, guard: dict, merge: Callable[[DataFrame, DataFrame, list[str]], DataFrame] = sparse_upsert, new_guard: dict | None = None) -> int:
    """Apply keyed ``updates`` as the next version and return its number.

    Only the buckets that hold a key of ``updates`` are read, merged (``merge`` takes old rows, updates and
    the key) and written, into new folders; the next version names these and the old folders of all other
    buckets, whose files are not touched. The pointer moves last, so a reader sees the old version or the
    new one. If ``guard`` does not agree with the table nothing is written; of two updates of one version
    the second fails. Updates of keys that the table lacks do nothing, as ``merge`` decides.
    """
    meta = table_version(spark, root)
    _agree(meta, guard)
    key, buckets = meta["key"], meta["buckets"]
    touched = sorted(str(r["b"]) for r in updates.select(bucket_of(key, buckets).alias("b")).distinct().collect())  # at most one row a bucket
    touched = [b for b in touched if b in meta["folders"]]
    folders = dict(meta["folders"])
    if touched:
        folders |= _write(merge(_read(spark, root, meta, touched), updates, key), root, key, buckets)
    number = meta["version"] + 1
    put_json(spark, f"{root}/versions/{number}.json", meta | {"version": number, "folders": folders, "guard": new_guard or meta["guard"]}, only_new=True)
    put_json(spark, f"{root}/{POINTER}", {"version": number})
    return number


def store_by_key(rows: DataFrame, name: str, path: str, key: list[str] = KEY, buckets: int = 64) -> None:
    """Save ``rows`` as a table that Spark knows to be dealt by ``key``: joins on it move the other side only."""
    rows.write.bucketBy(buckets, *key).sortBy(*key).mode("overwrite").option("path", path).saveAsTable(name)


def gather_stored(addresses: DataFrame, name: str, key: list[str] = KEY) -> DataFrame:
    """``addresses`` with the columns of the stored table ``name``; missing rows are null.

    Each distinct row is looked up once, by a join that does not shuffle the table; where the rows found are
    few, addresses take them without a shuffle.
    """
    rows = addresses.select(*key).distinct().hint("merge").join(addresses.sparkSession.table(name).hint("merge"), key)
    return small_join(addresses, rows, key, "left")
