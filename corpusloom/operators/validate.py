"""Contracts: each returns rows with reasons, so that good rows and a quarantine can be split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.arrays import asum
from corpusloom.runtime import merge_join, small_join


def _reasons(*rules: tuple[str, Column]) -> Column:
    """Names of the rules whose condition holds (a null condition counts as holding)."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules]))


def split(rows: DataFrame, reasons: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with their reasons)."""
    return rows.where(F.size(reasons) == 0).drop(reasons), rows.where(F.size(reasons) > 0)


def fail_on_bad(rows: DataFrame, reasons: str = "reasons") -> DataFrame:
    """Rows as they are; the job fails at the first bad one."""
    said = F.raise_error(F.concat(F.lit("contract: "), F.array_join(reasons, ", ")))
    return rows.where(F.when(F.size(reasons) > 0, said.cast("boolean")).otherwise(F.lit(True))).drop(reasons)


def document_reasons(vocab: int, k: int | None = None) -> Column:
    """A document with tokens, topk_idx, topk_p and loss_mask: shapes, ranges, mass and mask values."""
    t = F.size("tokens")
    wide = (lambda a: F.size(a) != k) if k else (lambda a: F.size(a) < 0)
    return _reasons(
        ("empty", t <= 0),
        ("shape", (F.size("topk_idx") != t) | (F.size("topk_p") != t) | F.exists("topk_idx", wide) | F.exists("topk_p", wide) | F.exists(F.zip_with("topk_idx", "topk_p", lambda a, b: F.size(a) != F.size(b)), lambda x: x)),
        ("vocab", F.exists("tokens", lambda x: (x < 0) | (x >= vocab)) | F.exists(F.flatten("topk_idx"), lambda x: (x < 0) | (x >= vocab))),
        ("probability", F.exists(F.flatten("topk_p"), lambda p: (p < -1e-6) | (p > 1 + 1e-6))),
        ("sum above 1", F.exists("topk_p", lambda p: 1 - asum(p) < -1e-5)),
        ("mask", (F.size("loss_mask") != t) | F.exists("loss_mask", lambda m: ~m.isin(0, 1))),
    )


def dense_reasons(k: int) -> Column:
    """A dense score record: top-k arrays are exactly [t, k], log probabilities at most 0."""
    t = F.size("tokens")
    return _reasons(
        ("dense", (F.size("topk_idx") != t) | (F.size("topk_logprobs") != t) | F.exists("topk_idx", lambda a: F.size(a) != k) | F.exists("topk_logprobs", lambda a: F.size(a) != k)),
        ("logprobs", F.exists(F.flatten("topk_logprobs"), lambda x: x > 1e-6)),
    )


def bulk_reasons(k: int) -> Column:
    """A bulk position: the arrays are there and hold ``k`` values, the mask is 0 or 1."""
    return _reasons(("ids", F.coalesce(F.size("teacher_ids"), F.lit(-1)) != k), ("probs", F.coalesce(F.size("teacher_probs"), F.lit(-1)) != k), ("mask", ~F.col("loss_mask").isin(0, 1)))


def bulk_schema_faults(df: DataFrame, ddl: str) -> list[str]:
    """Columns of ``ddl`` that are missing or of another type."""
    have = dict(df.dtypes)
    want = dict(df.sparkSession.createDataFrame([], ddl).dtypes)
    return sorted(c for c, t in want.items() if have.get(c) != t)


def chunk_tiling(chunks: DataFrame, totals: DataFrame) -> DataFrame:
    """(file, faults): chunks that do not begin where the ones before end, are empty, or miss the total.

    A file with chunks and no positions, or with positions and no chunks, has a fault too.
    """
    order = Window.partitionBy("file").orderBy("chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    c = chunks.withColumn("due", F.coalesce(F.sum("length").over(before), F.lit(0)))
    per = c.groupBy("file").agg(F.sum(((F.col("start") != F.col("due")) | (F.col("length") < 1)).cast("long")).alias("bad"), F.sum("length").alias("sum"))
    both = merge_join(per, totals, "file", "full_outer")
    miss = (~F.col("sum").eqNullSafe(F.col("total"))).cast("long")
    return both.select("file", (F.coalesce("bad", F.lit(0)) + miss).alias("faults"))


def wrong_gold() -> Column:
    """If a position is unmasked and its first candidate is not the true token."""
    return (F.col("loss_mask") == 1) & (F.get("teacher_ids", F.lit(0)) != F.col("token"))


def gold_slot(bulk: DataFrame) -> DataFrame:
    """Unmasked positions whose first candidate is not the true token."""
    return bulk.where(wrong_gold())


def shard_reconcile(shards: DataFrame, manifest: DataFrame) -> DataFrame:
    """(shard_id, stored and stated tokens, documents and k, faulty documents, ok).

    A document is faulty if its arrays differ in length, or an unmasked position has another number of
    candidates than the manifest's ``k``. A shard that either side lacks is not ok.
    """
    stated = manifest.select("shard_id", "total_tokens", "num_documents", F.col("k").alias("k_stated"))
    t = F.size("tokens")
    lengths = F.array(*[F.size(n) for n in ("topk_idx", "topk_w", "tail_w", "loss_mask")])
    wide = F.array_distinct(F.filter(F.flatten(F.array(F.transform("topk_idx", F.size), F.transform("topk_w", F.size))), lambda n: n > 0))
    d = shards.select("shard_id", t.alias("t"), F.exists(lengths, lambda n: n != t).alias("uneven"), wide.alias("wide"))
    d = small_join(d, stated.select("shard_id", "k_stated"), "shard_id", "left")
    bad = F.col("uneven") | F.exists("wide", lambda n: ~n.eqNullSafe(F.col("k_stated")))
    s = d.groupBy("shard_id").agg(F.sum("t").alias("tokens_stored"), F.count(F.lit(1)).alias("docs_stored"), F.max(F.coalesce(F.array_max("wide"), F.lit(0))).alias("k_stored"), F.sum(bad.cast("long")).alias("docs_faulty"))
    j = merge_join(s, stated, "shard_id", "full_outer")
    ok = (F.col("tokens_stored") == F.col("total_tokens")) & (F.col("docs_stored") == F.col("num_documents")) & (F.col("docs_faulty") == 0)
    return j.withColumn("ok", F.coalesce(ok, F.lit(False)))


def mass_invariant(shards: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Per shard: positions, those whose mass and tail miss 1 by more than ``tolerance``, the largest miss."""
    off = F.transform(F.arrays_zip("topk_w", "tail_w"), lambda z: F.abs(asum(z["topk_w"]) + z["tail_w"].cast("double") - 1))
    d = shards.select("shard_id", F.explode(off).alias("off"))
    return d.groupBy("shard_id").agg(F.count(F.lit(1)).alias("positions"), F.sum((F.col("off") > tolerance).cast("long")).alias("violations"), F.max("off").alias("worst"))


def single_k(shards: DataFrame) -> DataFrame:
    """Per shard the numbers of candidates of its unmasked positions; more than one is a fault."""
    d = shards.select("shard_id", F.explode(F.transform("topk_idx", F.size)).alias("k")).where("k > 0")
    return d.groupBy("shard_id").agg(F.countDistinct("k").alias("n_k"), F.max("k").alias("k"))


def fold_lint(manifest: DataFrame, alpha: float) -> DataFrame:
    """Shards whose fold would be counted twice: the first fold version with a mixing weight below 1."""
    a = F.coalesce("alpha_override", F.lit(alpha))
    return manifest.where((F.col("fold_version") == "v1") & (a < 1)).select("shard_id", a.alias("alpha"))


def reconcile(left: DataFrame, right: DataFrame, key: str, allow_regex: str) -> DataFrame:
    """(key, status) of two sets of names: matched, unused (left alone), allowed-new or unfilled."""
    a = left.select(F.col(key).alias("k")).distinct().withColumn("l", F.lit(True))
    b = right.select(F.col(key).alias("k")).distinct().withColumn("r", F.lit(True))
    j = merge_join(a, b, "k", "full_outer")
    status = F.when(F.col("l") & F.col("r"), "matched").when(F.col("r").isNull(), "unused").when(F.col("k").rlike(allow_regex), "allowed-new").otherwise("unfilled")
    return j.select(F.col("k").alias(key), status.alias("status"))
