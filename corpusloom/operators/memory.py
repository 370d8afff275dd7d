"""Keyed vector tables: gather, features, sums, upserts and guarded versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrays import asum, bf16, each
from corpusloom.runtime import materialize, merge_join, small_join

KEY = ["order", "head", "row_id"]


def gather_rows(addresses: DataFrame, memory: DataFrame) -> DataFrame:
    """Addresses with their row's ``vec``; each distinct row is looked up once, missing rows are null.

    The rows that are addressed are found first; where they are few, addresses take them without a shuffle.
    """
    rows = merge_join(addresses.select(*KEY).distinct(), memory, KEY)
    return small_join(addresses, rows, KEY, "left")


def row_sets(batch: DataFrame, order: int) -> DataFrame:
    """Positions of a batch with ``rows`` in place of their addresses: those of one order, as (order, head, row_id, valid) in the order of heads."""
    rest = [n for n in batch.columns if n != "addresses"]
    return batch.select(*rest, F.sort_array(F.filter("addresses", lambda a: a["order"] == order)).alias("rows"))


def set_features(sets: DataFrame, memory: DataFrame, eps: float = 1e-6, heads: int | None = None, dim: int | None = None) -> DataFrame:
    """(rows, order, feature) of distinct ``rows`` as ``row_sets`` has them: places with equal rows have one feature.

    Vectors are gathered and scaled once for each set, however many places have it; rows that the memory lacks
    count only with ``heads`` and ``dim``, and a set that has none of its rows has no feature without them.
    """
    d = materialize(sets.select("rows").distinct(), "row-sets")
    a = d.select("rows", F.explode("rows").alias("a")).select("rows", "a.*")
    g = gather_rows(a, memory)
    return memory_features(g if heads and dim else g.where("vec IS NOT NULL"), ["rows"], eps, heads, dim)


def memory_features(gathered: DataFrame, place: list[str], eps: float = 1e-6, heads: int | None = None, dim: int | None = None) -> DataFrame:
    """(place, order, feature): heads' rows side by side, scaled to a root mean square of 1; zero if invalid.

    With ``heads`` and ``dim`` a feature is ``heads * dim`` wide whatever was found: a head that is missing
    at a place, or whose row is, is zeros there. Without them only the heads that are there count.
    """
    g = gathered.groupBy(*place, "order").agg(F.min("valid").alias("valid"), F.sort_array(F.collect_list(F.struct("head", "vec"))).alias("r"))
    if heads and dim:
        there = F.map_from_entries(F.filter("r", lambda x: x["vec"].isNotNull()))
        none = F.array_repeat(F.lit(0.0).cast("float"), dim)
        v = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: F.coalesce(F.try_element_at(there, h), none)))
    else:
        v = F.flatten(F.transform("r", lambda x: x["vec"]))
    g = g.select(*place, "order", "valid", v.alias("v"))
    mean = asum(F.transform("v", lambda x: x.cast("double") * x.cast("double"))) / F.size("v")
    g = g.withColumn("scale", F.when(F.col("valid"), 1 / F.sqrt(mean + eps)).otherwise(F.lit(0.0)))
    return g.select(*place, "order", F.zip_with("v", each(F.col("scale"), F.col("v")), lambda x, s: x.cast("double") * s).alias("feature"))


def vector_sum(fragments: DataFrame, key: list[str] = KEY) -> DataFrame:
    """One summed vector for each row; rows whose sum is zero throughout go. Sums are partial before the shuffle."""
    d = fragments.select(*key, F.posexplode("vec").alias("dim", "x")).groupBy(*key, "dim").agg(F.sum(F.col("x").cast("double")).alias("x"))
    g = d.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("r"))
    return g.select(*key, F.col("r.x").alias("vec")).where(F.exists("vec", lambda x: x != 0))


def sparse_upsert(base: DataFrame, updates: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Base rows plus their update, rounded as stored; rows without one stay as they are, bit by bit."""
    u = updates.select(*key, F.col("vec").alias("__u"))
    new = F.zip_with("vec", "__u", lambda a, b: bf16(a.cast("double") + b.cast("double")).cast("float"))
    return merge_join(base, u, key, "left").withColumn("vec", F.when(F.col("__u").isNull(), F.col("vec")).otherwise(new)).drop("__u")


def accumulate_apply(base: DataFrame, fragments: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Sum all fragments of a key first, then update it once."""
    return sparse_upsert(base, vector_sum(fragments, key), key)


def rounding_loss(base: DataFrame, updates: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(elements, lost, share): of updated elements, how many a rounded sum leaves as they were."""
    j = merge_join(base, updates.select(*key, F.col("vec").alias("__u")), key)
    pairs = F.zip_with("vec", "__u", lambda a, b: F.when(b != 0, (bf16(bf16(a) + b.cast("double")) == bf16(a)).cast("int")))
    d = j.select(F.explode(pairs).alias("same")).where("same IS NOT NULL")
    return d.agg(F.count(F.lit(1)).alias("elements"), F.coalesce(F.sum("same"), F.lit(0)).alias("lost")).withColumn("share", F.when(F.col("elements") > 0, F.col("lost") / F.col("elements")).otherwise(F.lit(0.0)))


def same_version(have: DataFrame, want: DataFrame, keys: list[str]) -> bool:
    """Whether the one-row manifests ``have`` and ``want`` agree on all ``keys`` (checksum, shape, ...)."""
    a, b = (x.select(*keys).limit(2).collect() for x in (have, want))
    return len(a) == len(b) == 1 and a[0] == b[0]


def guarded(rows: DataFrame, have: DataFrame, want: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` only if the manifests agree on ``keys``; else the job fails."""
    said = F.raise_error(F.lit(f"manifests differ in {', '.join(keys)}; rows are not loaded")).cast("boolean")
    return rows if same_version(have, want, keys) else rows.where(said)


def table_shape(memory: DataFrame) -> DataFrame:
    """(tables, rows, dims): number of tables and rows, and widths of the vectors, as a manifest holds them."""
    one = memory.agg(F.countDistinct("order", "head").alias("tables"), F.count(F.lit(1)).alias("rows"), F.sort_array(F.collect_set(F.size("vec"))).alias("dims"))
    return one.select("tables", "rows", F.array_join("dims", ",").alias("dims"))
