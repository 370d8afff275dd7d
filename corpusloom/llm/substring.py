"""Substring dedup: passages that an earlier document holds, found from anchors at a difference cover's positions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.runtime import Scratch, merge_join, small_join, spread, table

WINDOW = 50
#: Perfect difference sets: any two positions, moved by one same step below the period, both fall on a member.
COVERS = {31: (1, 5, 11, 24, 25, 27), 21: (3, 6, 7, 12, 14), 13: (0, 1, 3, 9), 7: (1, 2, 4), 3: (0, 1), 1: (0,)}
#: An anchor is at least this share of a window, so that few anchors are shared by chance.
LEAST_ANCHOR = 0.4
#: Words whose hash a worker remembers.
MEMO = 300_000


def cover_of(window: int) -> tuple[int, tuple[int, ...], int]:
    """(period, cover, anchor): the longest period that leaves anchors of ``LEAST_ANCHOR`` of a window.

    Two equal windows of ``window`` words hold, at one same distance below ``period`` from their starts,
    anchors of ``anchor`` words that both begin on the cover.
    """
    period = max(p for p in COVERS if p == 1 or window - p + 1 >= LEAST_ANCHOR * window)
    return period, COVERS[period], window - period + 1


def words_of(text: str | None) -> list[bytes]:
    """Words between spaces and U+0009 to U+000D; other blanks are parts of words."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


_BASES = (0x9E3779B97F4A7C1B, 0xC2B2AE3D27D4EB4D)  # odd, so that they have inverses modulo 2^64


class Windows:
    """64-bit hashes of all stretches of some words of a text, from prefix sums modulo 2^64."""

    def __init__(self):
        self.memo, self.powers = _Hashes(), {}

    def words(self, text: str | None) -> np.ndarray:
        w = words_of(text)
        return np.fromiter(map(self.memo.__getitem__, w), np.uint64, len(w))

    def _powers(self, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = self.powers.get(base, (np.ones(1, np.uint64),) * 2)
        if len(up) < n:
            m = max(n, 1 << 16)
            up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))
            self.powers[base] = (up, down)
        return up, down

    def hashes(self, x: np.ndarray, length: int, which: int = 0) -> np.ndarray:
        """Signed hashes of ``x[p : p + length]`` for every p; ``which`` picks one of two functions."""
        n = len(x)
        if n < length:
            return np.zeros(0, np.int64)
        up, down = self._powers(_BASES[which], n + 1)
        if which:
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(x * up[:n], out=sums[1:])
        h = (sums[length:] - sums[:-length]) * down[: n - length + 1]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(27))).view(np.int64)


def _emit(schema: str, rows: Callable, per: int = 1 << 18) -> Callable:
    """A mapInArrow function: ``rows(windows, doc_id, tag, text, more)`` gives arrays for each row, flushed at ``per`` values."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, held, size = Windows(), [], 0
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                got = rows(w, *row)
                if got is None or not len(got[0]):
                    continue
                held.append(got)
                size += len(got[0])
                if size >= per:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)

    return run


ANCHORS = "h long, doc_id long, tag long, pos int"
FOUND = "w1 long, w2 long, doc_id long, tag long, pos int"


def anchors_of(docs: DataFrame, window: int) -> DataFrame:
    """Anchors (h, doc_id, tag, pos) of documents (doc_id, tag, text) at the cover's positions."""
    period, cover, anchor = cover_of(window)
    on = np.isin(np.arange(period), cover)

    def rows(w: Windows, doc: int, tag: int, text: str):
        x = w.words(text)
        if len(x) < window:
            return None
        h = w.hashes(x, anchor)
        pos = np.flatnonzero(np.resize(on, len(h))).astype(np.int32)
        return h[pos], np.full(len(pos), doc), np.full(len(pos), tag), pos

    return docs.select("doc_id", "tag", "text").mapInArrow(_emit(ANCHORS, rows), ANCHORS)


def windows_at(docs: DataFrame, window: int) -> DataFrame:
    """Windows (w1, w2, doc_id, tag, pos) of (doc_id, tag, text, hits) that hold an anchor at one of ``hits``."""
    period = cover_of(window)[0]

    def rows(w: Windows, doc: int, tag: int, text: str, hits: list[int]):
        x = w.words(text)
        n = len(x) - window + 1
        if n < 1:
            return None
        # an anchor at i lies in the windows that begin at i - period + 1 to i
        edge, i = np.zeros(n + 1, np.int32), np.asarray(hits, np.int64)
        np.add.at(edge, np.clip(i - period + 1, 0, n), 1)
        np.add.at(edge, np.clip(i + 1, 0, n), -1)
        pos = np.flatnonzero(np.cumsum(edge[:-1])).astype(np.int32)
        return w.hashes(x, window)[pos], w.hashes(x, window, 1)[pos], np.full(len(pos), doc), np.full(len(pos), tag), pos

    return docs.select("doc_id", "tag", "text", "hits").mapInArrow(_emit(FOUND, rows), FOUND)


KEPT = "doc_id long, n_words long, n_removed long, kept string"


def cut_words(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of (doc_id, text, copy, cuts): words that a window at ``cuts`` covers go.

    A ``copy`` of a smaller document keeps nothing, if it has a window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, copy, cuts in zip(*[c.to_pylist() for c in b.columns]):
                w = words_of(text)
                n = len(w)
                if copy and n >= window:
                    w = []
                elif cuts:
                    edge, i = np.zeros(n + 1, np.int32), np.asarray(cuts, np.int64)
                    np.add.at(edge, i, 1)
                    np.add.at(edge, i + window, -1)
                    w = [w[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                out.append((doc, n, n - len(w), b" ".join(w).decode("utf-8", "surrogatepass")))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept"])

    return docs.select("doc_id", "text", "copy", "cuts").mapInArrow(run, KEPT)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of ``docs`` (doc_id, text): without passages of earlier documents.

    Words lie between spaces and U+0009 to U+000D. Each word goes that is covered by ``window`` consecutive
    words whose sequence also begins in a document with a smaller doc_id; what is left is joined by single
    spaces. Windows are judged on the input.

    Anchors are hashed only where a position modulo a period belongs to a difference cover (6 of 31 for
    windows of 50 words): two equal windows always hold a pair of equal anchors at one same offset, so an
    anchor that no two documents share leads to no window. Shared anchors are extended to all windows
    around them, which are compared by 128 bits: each window's smallest document is an aggregate, and no
    pair of documents is ever made, whatever the size of a group. Exact copies of a text are known from
    digests first and send no anchors. Texts move only for documents with a shared anchor.

    Null texts have no words. A null doc_id is smaller than none and larger than none: its rows lose
    nothing and cost others nothing. Rows with one doc_id are one document; each is cut by its own words.
    Equal rows stay equal. Empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tag", F.xxhash64("text"))
    whole = d.where("doc_id IS NOT NULL AND length(text) > 0")
    key = ["doc_id", "tag"]
    with Scratch(spark, owns=True) as s:
        ids = s.table(whole.select(*key, F.unhex(F.md5("text")).alias("digest")).distinct(), "substring-ids")
        many = ids.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
        copies = s.table(small_join(ids, s.table(many, "substring-many"), "digest").where("doc_id > first").select(*key), "substring-copies")
        firsts = small_join(whole, copies, key, "left_anti")
        anchors = s.table(anchors_of(firsts, window), "substring-anchors")
        shared = s.table(anchors.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h"), "substring-shared")
        hits = merge_join(anchors, shared, "h").groupBy(*key).agg(F.collect_set("pos").alias("hits"))
        hits = s.table(hits, "substring-hits")
        near = merge_join(small_join(firsts, hits.select(*key), key, "left_semi"), hits, key)
        found = s.table(windows_at(near, window), "substring-windows")
        first = found.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("w1", "w2", "first")
        cuts = merge_join(found, s.table(first, "substring-first"), ["w1", "w2"]).where("doc_id > first").groupBy(*key).agg(F.collect_set("pos").alias("cuts"))
        cuts = s.table(cuts, "substring-cuts")
        flags = copies.withColumn("copy", F.lit(True)).unionByName(cuts.select(*key, F.lit(False).alias("copy")))
        flagged = small_join(d, s.table(flags, "substring-flags"), key, "left")
        cut = merge_join(flagged.where("NOT copy"), cuts, key).select("doc_id", "text", "copy", "cuts")
        rest = flagged.where("copy IS NULL OR copy").select("doc_id", "text", "copy", F.lit(None).cast("array<int>").alias("cuts"))
        return s.result(cut_words(cut, window).unionByName(cut_words(rest, window)), "substring")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of 50 words or more that a smaller document holds."""
    out = remove_repeats(spread(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT rid, doc_id, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS h FROM d WHERE len(w) >= 50),
g AS (SELECT h, min(doc_id) AS first FROM p GROUP BY h),
c AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS j FROM p JOIN g USING (h) WHERE doc_id > first),
u AS (SELECT rid, doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
k AS (SELECT u.rid, count(*) AS n, count(c.j) AS gone, string_agg(word, ' ' ORDER BY j) FILTER (WHERE c.j IS NULL) AS kept FROM u LEFT JOIN c USING (rid, j) GROUP BY u.rid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)
"""
