"""Benchmark decontamination: a BM25 index of test items with block maxima, asked every passage."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.quality import rows_where
from corpusloom.operators.prefix import ordered_sums
from corpusloom.runtime import materialize, table

_WORD = re.compile(r"\w+")
#: Passages are ``3 * STRIDE`` words, one every ``STRIDE``; so any ``2 * STRIDE`` words lie within one.
STRIDE = 32
#: Items are indexed in entries of at most so many words, and in blocks of so many entries.
ENTRY_WORDS, BLOCK = 2 * STRIDE, 64
K1, B = 1.2, 0.75
#: An index holds at most so many items; more make further passes over the documents.
MAX_ITEMS = 20_000
#: Share of an item's question and of its answer that must stand near a passage.
AGREE, LEAST_PAIRS = 0.5, 0.25
HITS = "array<struct<item_id:long,word:int,score:double,question:double,answer:double>>"


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer: the last sentences or lines of five words or more in all.

    Where these are over half of the words, the answer is the last third.
    """
    parts = [w for w in (_WORD.findall(p.lower()) for p in re.split(r"(?<=[.!?])\s+|\n", text)) if w]
    words = [w for p in parts for w in p]
    n, k = 0, len(parts)
    while k and n < 5:
        k -= 1
        n += len(parts[k])
    if 2 * n > len(words):
        n = len(words) // 3
    return words[: len(words) - n], words[len(words) - n :]


def agreement(part: list[str], near: list[str]) -> float:
    """How much of ``part`` stands in ``near``: the mean share of its words, and of its neighbours in that order.

    Neighbours may have one word between them there, so a word put in breaks no pair, and a word that is
    lost breaks the two pairs it was in. Below ``LEAST_PAIRS`` the share of neighbours counts alone: the same
    words in another order agree no more than that. 1 for an empty part.
    """
    if not part:
        return 1.0
    words = set(near)
    found = sum(w in words for w in part) / len(part)
    if len(part) == 1:
        return found
    pairs = {*zip(near, near[1:]), *zip(near, near[2:])}
    ordered = sum(x in pairs for x in zip(part, part[1:])) / (len(part) - 1)
    return (found + ordered) / 2 if ordered >= LEAST_PAIRS else ordered


class Index:
    """Inverted index of items for block-max WAND. Impacts are shares of an entry's own score, that of its own text.

    Every term has its postings by entry, the largest impact of them all, and of each block of ``BLOCK``
    postings. Beside these stand the postings that a stretch of text is judged by as a whole: for each
    entry the terms of least impact, together at most ``spare``, are left out of them, for an entry reaches
    ``threshold`` only if its other terms reach ``threshold - spare``. All is held in arrays, so that an
    index built once goes to the tasks as it is.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float = 0.6, spare: float = 0.25):
        self.threshold = threshold
        self.items: list[tuple[int, list[str], list[str]]] = []
        entries: list[tuple[int, list[str]]] = []
        for item_id, text in items:
            q, a = split_item(text or "")
            words = q + a
            if not words:
                continue
            self.items.append((item_id, q, a))
            entries += [(len(self.items) - 1, words[k : k + ENTRY_WORDS]) for k in range(0, len(words), ENTRY_WORDS) if k == 0 or len(words) - k >= 8]
        self.owner = [e[0] for e in entries]
        df = Counter(w for _, words in entries for w in set(words))
        mean = sum(len(w) for _, w in entries) / max(1, len(entries))
        idf = {w: math.log(1 + (len(entries) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
        essential: dict[str, list[tuple[int, float]]] = {}
        every: dict[str, list[tuple[int, float]]] = {}
        need = np.zeros(len(entries))
        for e, (_, words) in enumerate(entries):
            raw = {w: idf[w] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(words) / mean)) for w, n in Counter(words).items()}
            own = sum(raw.values())
            impact = {w: x / own for w, x in raw.items()}
            left = 0.0
            for w, x in sorted(impact.items(), key=lambda wx: (wx[1], wx[0])):
                every.setdefault(w, []).append((e, x))
                if left + x <= spare:
                    left += x
                else:
                    essential.setdefault(w, []).append((e, x))
            need[e] = threshold - left - 1e-9
        # all postings, for the search of a passage
        self.posting = {w: k for k, w in enumerate(sorted(every))}
        lists = [every[w] for w in self.posting]
        self.list_from = np.cumsum([0, *map(len, lists)])
        self.list_entry = np.array([e for x in lists for e, _ in x], np.int32)
        self.list_impact = np.array([x for p in lists for _, x in p])
        self._lists: dict[int, tuple] = {}
        self.need = need
        self.term = {w: k for k, w in enumerate(sorted(essential))}
        posts = [(k, e // BLOCK, e, x) for w, k in self.term.items() for e, x in essential[w]]
        posts.sort()
        self.post_entry = np.array([p[2] for p in posts], np.int64)
        self.post_impact = np.array([p[3] for p in posts])
        blocks = [(p[0], p[1]) for p in posts]
        edge = [k for k in range(len(posts)) if k == 0 or blocks[k] != blocks[k - 1]]
        self.block_of = np.array([posts[k][1] for k in edge], np.int64)
        self.block_from = np.array([*edge, len(posts)], np.int64)
        self.block_max = np.array([self.post_impact[a:b].max() for a, b in zip(self.block_from, self.block_from[1:])])
        terms = np.array([posts[k][0] for k in edge], np.int64)
        self.term_from = np.searchsorted(terms, np.arange(len(self.term) + 1))
        self.block_need = np.array([need[k : k + BLOCK].min() for k in range(0, len(entries), BLOCK)])

    def postings(self, term: int) -> tuple[list[int], list[float], float, list[float], list[int]]:
        """Of a term: entries, impacts, the largest impact, and those and the last entries of its blocks."""
        got = self._lists.get(term)
        if got is None:
            a, b = self.list_from[term], self.list_from[term + 1]
            e, x = self.list_entry[a:b].tolist(), self.list_impact[a:b].tolist()
            cuts = range(0, len(e), BLOCK)
            got = self._lists[term] = (e, x, max(x), [max(x[k : k + BLOCK]) for k in cuts], [e[min(k + BLOCK, len(e)) - 1] for k in cuts])
        return got

    def wand(self, words: set[str]) -> list[tuple[int, float]]:
        """All (entry, score) of a passage's distinct words that reach the threshold, by block-max WAND.

        Cursors stand in the order of their entries. The pivot is the first entry that can reach the
        threshold by the largest impacts of the terms up to it; if it cannot by those of the blocks it lies
        in, the cursors skip to the end of the nearest block, else the entry is scored.
        """
        least, found = self.threshold - 1e-9, []
        cursors = []  # entry, place, and the term's postings
        for w in words:
            k = self.posting.get(w)
            if k is not None:
                p = self.postings(k)
                cursors.append([p[0][0], 0, p])
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[2][2]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            entry = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == entry:
                pivot += 1
            here = cursors[: pivot + 1]
            bound, end = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else 1 << 60
            for c in here:
                block = bisect_left(c[2][4], entry)
                if block < len(c[2][4]):
                    bound += c[2][3][block]
                    end = min(end, c[2][4][block] + 1)
            if bound < least:
                goal = max(end, entry + 1)
            elif here[0][0] == entry:
                score = math.fsum(c[2][1][c[1]] for c in here)
                if score >= least:
                    found.append((entry, score))
                goal = entry + 1
            else:
                goal = entry
            for c in here:
                if c[0] < goal:
                    c[1] = bisect_left(c[2][0], goal, c[1])
                    c[0] = c[2][0][c[1]] if c[1] < len(c[2][0]) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def passages(self, words: list[str]) -> list[int]:
        """Passages by number from -2 in which some entry's upper bound, by blocks of entries, reaches the threshold."""
        get = self.term.get
        terms = np.array([get(w, -1) for w in words], np.int64)
        at = np.flatnonzero(terms >= 0)
        if not len(at):
            return []
        t, stretch = terms[at], at // STRIDE
        # one of each term in a stretch
        keep = np.unique(t * (len(words) // STRIDE + 1) + stretch, return_index=True)[1]
        t, stretch = t[keep], stretch[keep]
        rows, k = _spread(self.term_from, t)
        blocks = self.block_of[rows]
        good = _windows(blocks, stretch[k], self.block_max[rows], self.block_need)
        if not good.any():
            return []
        rows, k = rows[good], k[good]
        posts, j = _spread(self.block_from, rows)
        entry, where, x = self.post_entry[posts], stretch[k][j], self.post_impact[posts]
        good = _windows(entry, where, x, self.need)
        return sorted({int(s) - d for s in where[good] for d in (0, 1, 2)})

    def search(self, text: str | None) -> list[tuple[int, int, float, float, float]]:
        """Verified hits (item, first word of its passage, score, shares of question and answer found)."""
        words = _WORD.findall(text.lower()) if text and self.items else []
        best: dict[int, tuple[int, int, float, float, float]] = {}
        for p in self.passages(words) if words else []:
            lo, hi = max(0, p * STRIDE), (p + 3) * STRIDE
            for entry, score in self.wand(set(words[lo:hi])):
                item_id, q, a = self.items[self.owner[entry]]
                if item_id in best and score <= best[item_id][2]:
                    continue
                near = words[max(0, lo - len(q) - len(a)) : hi + len(q) + len(a)]
                found = agreement(q, near), agreement(a, near)
                if min(found) >= AGREE:
                    best[item_id] = (item_id, lo, round(score, 9), round(found[0], 9), round(found[1], 9))
        return sorted(best.values())


def _spread(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places ``first[r] .. first[r + 1]`` of each row in turn, and the index of the row."""
    n = first[rows + 1] - first[rows]
    k = np.repeat(np.arange(len(rows)), n)
    return first[rows][k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n), k


def _windows(what: np.ndarray, stretch: np.ndarray, x: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which rows lie in some three stretches in a row where the sum for ``what`` reaches its need."""
    wide = int(stretch.max()) + 5
    keys, inv = np.unique(what * wide + stretch + 2, return_inverse=True)
    sums = np.bincount(inv, x, len(keys))

    def of(d: int) -> np.ndarray:
        k = np.minimum(np.searchsorted(keys, keys + d), len(keys) - 1)
        return np.where(keys[k] == keys + d, sums[k], 0.0)

    around = [of(d) for d in (-2, -1, 0, 1, 2)]
    top = np.maximum.reduce([around[k] + around[k + 1] + around[k + 2] for k in range(3)])
    return (top >= need[keys // wide])[inv]


def contamination(text: Column, index: Broadcast) -> Column:
    """Hits of one broadcast index of items in a whole text; null and empty texts have none."""

    @F.pandas_udf(HITS)
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = index.value
        for b in batches:
            yield pd.Series([[dict(zip(("item_id", "word", "score", "question", "answer"), h)) for h in held.search(t)] for t in b])

    return hits(text)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, max_items: int = MAX_ITEMS, text_col: str = "text", out: str = "__leaks") -> DataFrame:
    """Documents with all their columns and ``out``, the test items found in each.

    Every passage of every whole text asks the index for all items of at least ``threshold`` of an
    item's own BM25 score, by block-max WAND; an item is a hit if half of the words and neighbours of its
    question, and half of its answer's, are near the passage. An entry is at most ``ENTRY_WORDS`` words of
    an item; a last one of fewer than 8 words is left to the entry before, as the item's verification
    covers it. Of a text's passages those are searched whose bounds by blocks of entries, taken for all
    passages at once, reach the threshold for some entry: no other can hold a hit. Of passages with equal
    scores for an item the first is named.

    Items go to the tasks in indexes of at most ``max_items``, each built once and broadcast, dealt by ranks
    that Spark sums up; a benchmark of more takes one pass after the other, each written before the next,
    so that the driver and a task hold one index at a time. Nothing is shuffled but the items.

    Null texts and items have no hits; items with equal ids count separately, equal items once; repeated
    rows and null ids are searched one by one; without items the column holds empty arrays.
    """
    bench = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    n = bench.count()
    if n <= max_items:
        parts = [bench] if n else []
    else:
        ranked = materialize(ordered_sums(bench, [], ["item_id", "text"]), "bench-ranked")
        parts = [ranked.where(F.expr(f"rank div {max_items} = {k}")) for k in range(-(-n // max_items))]
    docs = docs.withColumn(out, F.array().cast(HITS))
    for k, part in enumerate(parts):
        items = [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()]  # at most max_items rows
        docs = docs.withColumn(out, F.concat(F.col(out), contamination(F.col(text_col), docs.sparkSession.sparkContext.broadcast(Index(items, threshold)))))
        if k + 1 < len(parts):
            docs = materialize(docs, "bench-pass")
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks: a row for each document and the test item found in it."""
    docs = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    # explode_outer: of explode the optimiser makes a filter that would search every text twice
    hits = docs.select("doc_id", F.explode_outer("__leaks").alias("h")).select("doc_id", F.inline(F.filter(F.array("h"), lambda h: h["item_id"].isNotNull())))
    return hits.select("doc_id", "item_id", "score", "question", "answer")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents in which no test item is found.

    Null and empty texts stay; repeated rows and null ids are judged one by one; an empty table stays
    empty, and without items all documents stay.
    """
    found = find_leaks(docs, table(spark, sf_dir, "benchmark")).withColumn("__clean", F.size("__leaks") == 0)
    return rows_where(found, "__clean", docs.columns)
