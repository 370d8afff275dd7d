"""Numbering, fixed-length windows, masks, steps and running measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.prefix import ordered_sums
from corpusloom.runtime import merge_join, small_join


def shift_chunks(bulk: DataFrame) -> DataFrame:
    """Bulk positions (predicting the token itself) to shard positions (predicting the next).

    Within each chunk a row takes the distribution of the row after it if that is unmasked; the last
    row, and those before masked ones, are empty and masked. Tokens stay.
    """
    nxt = F.lead(F.struct("teacher_ids", "teacher_probs", "loss_mask")).over(Window.partitionBy("file", "chunk").orderBy("pos"))
    d = bulk.withColumn("__n", nxt)
    has = F.coalesce(F.col("__n.loss_mask") == 1, F.lit(False))
    zero = lambda kind: F.transform(F.col("teacher_ids"), lambda _: F.lit(0).cast(kind))
    ids, probs = F.when(has, F.col("__n.teacher_ids")).otherwise(zero("int")), F.when(has, F.col("__n.teacher_probs")).otherwise(zero("float"))
    return d.select("file", "chunk", "pos", "token", ids.alias("topk_idx"), probs.alias("topk_p"), has.cast("tinyint").alias("loss_mask"))


def number_docs(docs: DataFrame, length: Column) -> DataFrame:
    """(shard_id, doc_id, local_doc, len, offset): dense numbers from 0 and exclusive sums within the shard.

    One small row for each document is dealt by ranges, so a shard of any size takes many tasks.
    """
    d = docs.select("shard_id", "doc_id", length.cast("bigint").alias("len"))
    n = ordered_sums(d, ["shard_id"], ["doc_id", "len"], ["len"], rank="local_doc")
    return n.select("shard_id", "doc_id", "local_doc", "len", F.col("len_before").alias("offset"))


def doc_offsets(docs: DataFrame) -> DataFrame:
    return number_docs(docs, F.size("tokens"))


def pack_windows(docs: DataFrame, length: int, partial: bool = False) -> DataFrame:
    """(shard_id, window_id, tokens, doc_ids, loss_mask): full windows of ``length`` over each shard.

    Only the offsets of documents are numbered in order; each document is then cut into the windows it
    overlaps, so that whole segments are shuffled, by (shard, window). The last, partial window of a
    shard goes unless ``partial``. The mask is off at the end of a document and of a window.
    """
    off = doc_offsets(docs).select("shard_id", "doc_id", "local_doc", "offset")
    d = merge_join(docs.select("shard_id", "doc_id", "tokens"), off, ["shard_id", "doc_id"]).where(F.size("tokens") > 0)
    first, last = F.expr(f"offset div {length}"), F.expr(f"(offset + size(tokens) - 1) div {length}")
    g = segments(d.withColumn("window_id", F.explode(F.sequence(first, last))), length)
    return g if partial else g.where(F.size("tokens") == length)


def segments(d: DataFrame, length: int) -> DataFrame:
    """Windows (shard_id, window_id, tokens, doc_ids, loss_mask) of documents with ``offset`` and a window that they overlap."""
    begin = F.greatest(F.lit(0), F.col("window_id") * length - F.col("offset"))
    end = F.least(F.size("tokens"), (F.col("window_id") + 1) * length - F.col("offset"))
    s = d.select("shard_id", "window_id", "local_doc", (F.col("offset") + begin).alias("at"), F.slice("tokens", (begin + 1).cast("int"), (end - begin).cast("int")).alias("tokens"))
    g = s.groupBy("shard_id", "window_id").agg(F.sort_array(F.collect_list(F.struct("at", "tokens", "local_doc"))).alias("seg"))
    docs = F.transform("seg", lambda x: F.array_repeat(x["local_doc"], F.size(x["tokens"])))
    # every overlap ends with a document's or a window's end: its last position is off
    on = F.transform("seg", lambda x: F.concat(F.array_repeat(F.lit(1).cast("tinyint"), F.size(x["tokens"]) - 1), F.array(F.lit(0).cast("tinyint"))))
    return g.select("shard_id", "window_id", F.flatten("seg.tokens").alias("tokens"), F.flatten(docs).alias("doc_ids"), F.flatten(on).alias("loss_mask"))


def boundary_mask(docs: DataFrame, length: int) -> DataFrame:
    """(shard_id, window_id, loss tokens): how many positions of each full window bear loss, without packing.

    A position bears none at the end of a document or a window, so no neighbour is looked at. A
    document tells for each window it overlaps how many of its positions do.
    """
    off = doc_offsets(docs)
    total = off.groupBy("shard_id").agg(F.sum("len").alias("total"))
    d = off.where("len > 0").withColumn("window_id", F.explode(F.expr(f"sequence(offset div {length}, (offset + len - 1) div {length})")))
    lo, hi = F.greatest("offset", F.col("window_id") * length), F.least(F.col("offset") + F.col("len"), (F.col("window_id") + 1) * length)
    # every overlap ends with a document's or a window's end: one position of it is off
    g = d.groupBy("shard_id", "window_id").agg(F.sum(hi - lo - 1).alias("loss_tokens"))
    full = merge_join(g, total, "shard_id").where((F.col("window_id") + 1) * length <= F.col("total"))
    return full.select("shard_id", "window_id", F.col("loss_tokens").cast("bigint").alias("loss_tokens"))


def shuffle_windows(windows: DataFrame, seed: int) -> DataFrame:
    """``windows`` (shard_id, window_id) with ``place``: a seeded order within each shard, the same every time."""
    key = F.md5(F.concat_ws("|", F.lit(seed), "shard_id", "window_id"))
    return ordered_sums(windows, ["shard_id"], [key, "window_id"], rank="place")


def assign_steps(windows: DataFrame, batch: int, accum: int) -> DataFrame:
    """``windows`` (shard_id, place) with global index, step and micro-batch.

    Bases of shards are prefix sums over one row for each shard, so no global sort is needed.
    """
    sizes = windows.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("shard_id").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("shard_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    per = batch * accum
    d = small_join(windows, base, "shard_id").withColumn("idx", (F.col("base") + F.col("place")).cast("bigint")).drop("base")
    return d.withColumns({"step": F.expr(f"idx div {per}"), "micro": F.expr(f"(idx % {per}) div {batch}")})


def resume_from(steps: DataFrame, step: int, batch: int, accum: int) -> DataFrame:
    """What is left of the epoch after ``step`` steps; exact modulo the epoch's length."""
    n = steps.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return steps.where(F.col("idx") >= (step * batch * accum) % max(1, n))


def ema_fold(values: Column, decay: float = 0.9) -> Column:
    """Moving average of an ordered array: begins with its first value."""
    first = F.get(values, F.lit(0)).cast("double")
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values), F.lit(1))), first, lambda e, x: decay * e + (1 - decay) * x.cast("double"))


def ema_by_key(rows: DataFrame, key: str, order: list[str], value: str, decay: float = 0.9) -> DataFrame:
    """(key, n, ema): the moving average over each key's rows in order, which begins with the first.

    The average is a sum of values with weights that depend on their ranks alone, so keys of any size
    are ranked by ranges and summed in parts.
    """
    d = ordered_sums(rows.select(key, *order, F.col(value).cast("double").alias("x")), [key], [*order, "x"], rank="r")
    n = merge_join(d, d.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("n")), F.col(key).eqNullSafe(F.col("__key")))
    weight = F.when(F.col("r") == 0, 1.0).otherwise(1 - decay) * F.pow(F.lit(decay), F.col("n") - 1 - F.col("r"))
    return n.groupBy(key).agg(F.first("n").alias("n"), F.sum(F.col("x") * weight).alias("ema"))
