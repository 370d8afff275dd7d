"""Teachers: counted bigrams, top-k of distributions, similarity scoring, external scorers, vocabularies."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.arrays import fp16, tail_mass
from corpusloom.functions.batches import cuts, lengths, offsets
from corpusloom.operators.prefix import ordered_sums
from corpusloom.runtime import materialize, merge_join, small_join
from corpusloom.schemas import SHARD


def pairs_of(tokens: Column) -> Column:
    """Neighbours (ctx, token) of an array."""
    n = F.size(tokens)
    return F.arrays_zip(F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("ctx"), F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("token"))


#: Ids below this are counted in a table of all their pairs; tokens of documents that are counted together.
PAIRED, PAIR_TOKENS = 2048, 1 << 21


def bigram_counts(docs: DataFrame) -> DataFrame:
    """(ctx, token, n): how often a token follows another within a document.

    A task counts pairs of ids below ``PAIRED`` in one table, others slice by slice, so only pairs that
    differ are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(PAIRED * PAIRED, np.int64)
        kind = None
        for batch in batches:
            lists = batch.column(0)
            sizes, kind = lengths(lists), lists.type.value_type
            for i, j in cuts(sizes, PAIR_TOKENS):
                flat = lists.slice(i, j - i).flatten()
                if len(flat) < 2:
                    continue
                inner = np.ones(len(flat) + 1, bool)
                inner[offsets(sizes[i:j])] = False
                inner = inner[1:-1]
                if not flat.null_count and pa.types.is_integer(kind):
                    ids = flat.to_numpy().astype(np.int64)
                    if 0 <= ids.min() and ids.max() < PAIRED:
                        table += np.bincount((ids[:-1] * PAIRED + ids[1:])[inner], minlength=len(table))
                        continue
                pairs = pa.table({"ctx": flat[:-1], "token": flat[1:]}).filter(pa.array(inner))
                counts = pairs.group_by(["ctx", "token"], use_threads=False).aggregate([([], "count_all")])
                yield from counts.rename_columns({"count_all": "n"}).select(["ctx", "token", "n"]).to_batches()
        at = np.nonzero(table)[0]
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at // PAIRED).cast(kind), pa.array(at % PAIRED).cast(kind), pa.array(table[at])], ["ctx", "token", "n"])

    kind = dict(docs.dtypes)["tokens"].removeprefix("array<")[:-1]
    return docs.select("tokens").mapInArrow(run, f"ctx {kind}, token {kind}, n bigint").groupBy("ctx", "token").agg(F.sum("n").alias("n"))


def topk_long(dist: DataFrame, ctx: str, token: str, p: str, k: int) -> DataFrame:
    """The ``k`` most probable rows of each context with their rank; ties go to the smaller token."""
    order = Window.partitionBy(ctx).orderBy(F.desc(p), F.asc(token))
    return dist.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def topk_array(ids: Column, probs: Column, k: int) -> Column:
    """The ``k`` largest of an array of probabilities as (p, id), descending; ties go to the smaller id."""
    rows = F.sort_array(F.zip_with(ids, probs, lambda i, p: F.struct((-p).alias("neg"), i.alias("id"))))
    return F.transform(F.slice(rows, 1, k), lambda r: F.struct((-r["neg"]).alias("p"), r["id"].alias("id")))


def bigram_teacher(docs: DataFrame, k: int) -> DataFrame:
    """(ctx, total, topk_idx, topk_p, tail): true shares of the ``k`` commonest successors of each token.

    Counts are partially aggregated before the shuffle; the rows are bounded by the vocabulary.
    """
    return count_teacher(bigram_counts(docs), k)


def count_teacher(counts: DataFrame, k: int) -> DataFrame:
    """The same from counts (ctx, token, n)."""
    by = Window.partitionBy("ctx")
    top = topk_long(counts.withColumn("total", F.sum("n").over(by)), "ctx", "token", "n", k)
    t = top.groupBy("ctx").agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("rank", "token", "n"))).alias("r"))
    t = t.select("ctx", "total", F.col("r.token").alias("topk_idx"), F.transform("r", lambda x: x["n"] / F.col("total")).alias("topk_p"))
    return t.withColumn("tail", tail_mass(F.col("topk_p")))


#: Ids below this, and a teacher of fewer rows and bytes, are looked up in place.
LOOKUP, LOOKUP_BYTES = 200_000, 16 << 20


def known_rows(teacher: DataFrame, width: Column, most: int = LOOKUP, most_bytes: int = LOOKUP_BYTES) -> list | None:
    """The rows of a teacher (ctx, ...) of ``width`` bytes each as text, if its ids lie below ``most`` and all bytes below ``most_bytes``."""
    n, low, high, wide = teacher.agg(F.count(F.lit(1)), F.min("ctx"), F.max("ctx"), F.coalesce(F.sum(width), F.lit(0))).first()
    return teacher.collect() if n == 0 or (n <= most and 0 <= low and high < most and wide + 5 * high <= most_bytes) else None


def teach(docs: DataFrame, teacher: DataFrame, most: int = LOOKUP, most_bytes: int = LOOKUP_BYTES) -> DataFrame:
    """Shard documents: each position gets its token's distribution over the next one.

    ``teacher`` has one row for each id of a vocabulary. If its ids lie below ``most``, and what it takes as
    text below ``most_bytes``, it is looked up in place, as a literal of its rows, and nothing is shuffled; a
    larger one is joined by merging.
    Positions without a distribution, and the last of each document, are masked. Tail mass comes from
    the exact probabilities; the stored ones are rounded to half precision.
    """
    t = teacher.select("ctx", F.col("topk_idx").alias("i"), F.transform("topk_p", lambda v: fp16(v).cast("float")).alias("w"), F.col("tail").cast("float").alias("t"))
    t = materialize(t, "teacher")
    known = known_rows(t, 40 * F.size("i") + 60, most, most_bytes)
    if known is not None:
        size = max((r["ctx"] for r in known), default=0) + 1

        def column(value: Callable, kind: str, unset: Column) -> Column:
            rows: list = [None] * size
            for r in known:
                rows[r["ctx"]] = value(r)
            # one text for each column, folded to a literal when the plan is optimised
            table = F.from_json(F.lit(json.dumps(rows)), f"array<{kind}>")
            return F.transform("tokens", lambda x, k: F.coalesce(F.when(k < F.size("tokens") - 1, F.get(table, x.cast("int"))), unset))

        return docs.select(
            "shard_id", "doc_id", "tokens",
            column(lambda r: r["i"], "array<bigint>", F.array().cast("array<bigint>")).alias("topk_idx"),
            column(lambda r: r["w"], "array<float>", F.array().cast("array<float>")).alias("topk_w"),
            column(lambda r: r["t"], "float", F.lit(1.0).cast("float")).alias("tail_w"),
            column(lambda r: 1, "tinyint", F.lit(0).cast("tinyint")).alias("loss_mask"),
        )
    else:
        p = docs.select("shard_id", "doc_id", F.size("tokens").alias("len"), F.posexplode("tokens").alias("pos", "token"))
        j = merge_join(p, t, F.col("token") == F.col("ctx"), "left")
        one = F.when(F.col("ctx").isNotNull() & (F.col("pos") < F.col("len") - 1), F.struct("i", "w", "t"))
        g = j.groupBy("shard_id", "doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "token", one.alias("r")))).alias("g"))
        found = g.select("shard_id", "doc_id", F.col("g.token").alias("tokens"), F.col("g.r").alias("r"))
    return found.select(
        "shard_id", "doc_id", "tokens",
        F.transform("r", lambda x: F.coalesce(x["i"], F.array().cast("array<bigint>"))).alias("topk_idx"),
        F.transform("r", lambda x: F.coalesce(x["w"], F.array().cast("array<float>"))).alias("topk_w"),
        F.transform("r", lambda x: F.coalesce(x["t"], F.lit(1.0).cast("float"))).alias("tail_w"),
        F.transform("r", lambda x: x.isNotNull().cast("tinyint")).alias("loss_mask"),
    )


#: Candidates of a slice take so many bytes as doubles; a slice is what a pass over the vectors has in memory.
SLICE_BYTES = 64 << 20
#: Vectors and candidates of one product of matrices.
TILE, BLOCK = 512, 4096


class TopState:
    """Softmax over candidates that come block after block: the largest score, the scaled sum and the ``k`` best.

    States of disjoint sets of candidates merge in any order; only their ties follow the order of columns.
    """

    def __init__(self, top: np.ndarray, total: np.ndarray, ids: np.ndarray, scores: np.ndarray):
        self.top, self.total, self.ids, self.scores = top, total, ids, scores

    @classmethod
    def empty(cls, n: int, k: int) -> TopState:
        return cls(np.full(n, -np.inf), np.zeros(n), np.full((n, k), -1, np.int64), np.full((n, k), -np.inf))

    def add(self, z: np.ndarray, ids: np.ndarray) -> None:
        """Take in scores ``z`` (row, candidate) of candidates ``ids``, which rise and follow those before."""
        top = np.maximum(self.top, z.max(1))
        scale = np.exp(np.where(np.isinf(self.top), -np.inf, self.top - top))
        self.total = self.total * scale + np.exp(z - top[:, None]).sum(1)
        self.top, k = top, self.ids.shape[1]
        scores = np.concatenate([self.scores, z], 1)
        names = np.concatenate([self.ids, np.broadcast_to(ids, z.shape)], 1)
        least = -np.partition(-scores, k - 1, 1)[:, k - 1 : k]
        over, tied = scores > least, scores == least
        # of those that tie for the last places the first stay
        take = over | (tied & (np.cumsum(tied, 1) <= k - over.sum(1, keepdims=True)))
        at = np.nonzero(take)[1].reshape(-1, k)
        rows = np.arange(len(at))[:, None]
        order = np.argsort(-scores[rows, at], 1, kind="stable")
        self.scores, self.ids = scores[rows, at][rows, order], names[rows, at][rows, order]


def similarity_topk(vectors: DataFrame, id_col: str, vec_col: str, candidates: DataFrame, k: int, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(id, topk_idx, topk_p, tail): softmax of dot products with any number of candidates, the ``k`` largest shares.

    ``candidates`` (cand_id, cand_vec) are ranked by id and cut into slices of ``slice_bytes``; each pass over
    the vectors has one slice in memory and folds it, block after block, into a state for each vector: the
    largest score, the scaled sum and the ``k`` best. No table of vectors and candidates is made. Ties go
    to the smaller id; of fewer than ``k`` candidates there are as many. A null vector has none.
    """
    spark = vectors.sparkSession
    c = candidates.select("cand_id", F.transform("cand_vec", lambda x: x.cast("double")).alias("cand_vec"))
    ranked = materialize(ordered_sums(c, [], ["cand_id"]), "candidates")
    n, width = ranked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("cand_vec")), F.lit(1))).first()
    per, keep = max(1, slice_bytes // (8 * max(1, width))), max(1, min(k, n))
    state = vectors.select(F.col(id_col).alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"), F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("total"), F.array_repeat(F.lit(-1).cast("long"), keep).alias("ids"), F.array_repeat(F.lit(float("-inf")), keep).alias("scores"))
    for start in range(0, n, per):
        part = ranked.where((F.col("rank") >= start) & (F.col("rank") < start + per)).select("rank", "cand_vec").toPandas().sort_values("rank")
        held = spark.sparkContext.broadcast((part["rank"].to_numpy(np.int64), np.stack(part["cand_vec"])))

        def fold(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ranks, matrix = held.value
            for b in batches:
                for at in range(0, len(b), TILE):
                    tile = b.iloc[at : at + TILE].copy()
                    here = tile["v"].notna()
                    if here.any():
                        t = tile[here]
                        s = TopState(t["top"].to_numpy(float), t["total"].to_numpy(float), np.stack(t["ids"]), np.stack(t["scores"]))
                        v = np.stack(t["v"])
                        for m in range(0, len(ranks), BLOCK):
                            s.add(v @ matrix[m : m + BLOCK].T, ranks[m : m + BLOCK])
                        t = t.assign(top=s.top, total=s.total, ids=list(s.ids), scores=list(s.scores))
                        tile = pd.concat([t, tile[~here]])
                    yield tile

        state = state.mapInPandas(fold, state.schema)
        if start + per < n:
            state = materialize(state, "similarity")
    z = F.filter(F.arrays_zip("ids", "scores"), lambda x: (x["ids"] >= 0) & F.col("v").isNotNull())
    top = state.select("id", F.transform(z, lambda x: x["ids"]).alias("r"), F.transform(z, lambda x: F.exp(x["scores"] - F.col("top")) / F.col("total")).alias("topk_p"))
    # ranks back to ids: a short list of the ranks that any vector has kept
    long = top.select("id", F.posexplode("r").alias("i", "rank"))
    named = merge_join(long, ranked.select("rank", "cand_id"), "rank").groupBy(F.col("id").alias("__id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "cand_id"))), lambda x: x["cand_id"]).alias("topk_idx"))
    d = merge_join(top, named, F.col("id").eqNullSafe(F.col("__id")), "left")
    none = F.array().cast(dict(named.dtypes)["topk_idx"])
    return d.select("id", F.coalesce("topk_idx", none).alias("topk_idx"), "topk_p", tail_mass(F.col("topk_p")).alias("tail"))


#: Tokens of the documents that a scorer gets at a time, unless one document has more.
SCORE_TOKENS = 1 << 16


def score_with(docs: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], most_tokens: int = SCORE_TOKENS) -> DataFrame:
    """Run an external scorer over batches of documents on the executors; it returns shard rows.

    A batch holds whole documents of ``most_tokens`` together, or a single longer one, so what a scorer makes
    of it is bounded however many documents come at once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            start = total = 0
            for k, n in enumerate(b["tokens"].map(lambda t: 0 if t is None else len(t))):
                if k > start and total + n > most_tokens:
                    yield scorer(b.iloc[start:k].reset_index(drop=True))
                    start, total = k, 0
                total += n
            if len(b):
                yield scorer(b.iloc[start:].reset_index(drop=True))

    return docs.mapInPandas(run, SHARD)


def vocab_build(words: DataFrame, most: int) -> DataFrame:
    """(token_id, text, n): the ``most`` commonest words, ids by falling count, then by word.

    The limit is the size of the vocabulary; it also bounds the single-partition numbering.
    """
    top = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return top.select((F.row_number().over(Window.orderBy(F.desc("n"), "word")) - 1).cast("bigint").alias("token_id"), F.col("word").alias("text"), "n")


def vocab_encode(words: DataFrame, vocab: DataFrame, unknown: int) -> DataFrame:
    """``words`` with ``token_id``; words outside the vocabulary (broadcast if small) get ``unknown``."""
    v = vocab.select("token_id", F.col("text").alias("__text"))
    return small_join(words, v, F.col("word") == F.col("__text"), "left").drop("__text").withColumn("token_id", F.coalesce("token_id", F.lit(unknown)))
