"""Toxicity: a linear classifier trained with a counterfactual penalty on swapped identity terms."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.runtime import materialize, table

#: Identity terms by kind; a counterfactual text has each swapped for the next of its kind.
IDENTITY = (
    ("men", "women"),
    ("man", "woman"),
    ("male", "female"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"),
    ("old", "young"),
    ("immigrant", "native"),
    ("immigrants", "natives"),
    ("deaf", "blind", "disabled"),
)
SWAP = {w: kind[(k + 1) % len(kind)] for kind in IDENTITY for k, w in enumerate(kind)}

_WORD = re.compile(r"[^\W\d_]+")
#: Training takes at most so many labelled rows, the first by a hash of the id.
SAMPLE = 24_000
FEATURES = 4096


def word_features(word: str) -> list[int]:
    """Signed 64-bit hashes of a word in lower case and of its beginnings of 3 to 6 letters."""
    import xxhash

    names = ["w" + word] + [f"p{word[:n]}" for n in (3, 4, 5, 6) if len(word) > n]
    return [xxhash.xxh64_intdigest(x.encode()) - (1 << 63) for x in names]


def text_words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def is_held_out(id_col: str = "doc_id"):
    """Rows whose crc32 of the id as text leaves 2 modulo 4; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(label, text) of a bounded sample of labelled rows outside the held-out part.

    Null labels do not count; a document with several labels is toxic if any says so.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    chosen = F.broadcast(known.withColumnRenamed("doc_id", "__id"))  # at most ``limit`` rows
    return docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("__id")).select("label", "text")


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, features: int = FEATURES, least_z: float = 4.5, penalty: float = 1.0, l2: float = 1e-4) -> tuple[float, dict[int, float]]:
    """Bias and weights by feature.

    Spark counts the documents that hold each feature by label and keeps the ``features`` with the
    largest two-proportion z of at least ``least_z``. A logistic regression over these minimises the
    log loss plus ``penalty`` times the mean squared change of the logit when identity terms are
    swapped. The sample is bounded, so the last step fits one machine. Without labelled rows of both
    kinds there are no weights, and the bias is that of the share of toxic rows. Of features with equal z
    the smaller hash is kept; rows that repeat a labelled id each count; without documents or labels the
    bias is that of one toxic row in ten.
    """

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [text_words(t) for t in b["text"]]
            swapped = [{SWAP.get(w, w) for w in ws} if ws & SWAP.keys() else None for ws in words]
            hashed = lambda ws: None if ws is None else sorted({f for w in ws for f in word_features(w)})
            yield pd.DataFrame({"label": b["label"].astype("int32"), "f": [hashed(x) for x in words], "g": [hashed(x) for x in swapped]})

    rows = materialize(training_rows(docs, labels, limit).mapInPandas(featured, "label int, f array<long>, g array<long>"), "toxic-sample")
    n = {int(r["label"] > 0): r["n"] for r in rows.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    prior = math.log((pos + 0.5) / (neg + 0.5)) if pos + neg else math.log(0.1 / 0.9)
    if not pos or not neg:
        return prior, {}
    by = rows.select((F.col("label") > 0).cast("int").alias("y"), F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n")).where("n >= 8")
    p, q, share = F.col("a") / pos, (F.col("n") - F.col("a")) / neg, F.col("n") / (pos + neg)
    z = F.abs(p - q) / F.sqrt(share * (1 - share) * (1 / pos + 1 / neg) + 1e-12)
    chosen = [r["f"] for r in by.withColumn("z", z).where(F.col("z") >= least_z).orderBy(F.desc("z"), "f").limit(features).collect()]
    if not chosen:
        return prior, {}
    place = {f: k for k, f in enumerate(chosen)}
    kept = F.array(*[F.lit(f) for f in chosen])
    small = rows.select((F.col("label") > 0).cast("int").alias("y"), F.array_intersect("f", kept).alias("f"), F.array_intersect("g", kept).alias("g")).collect()  # at most ``limit`` rows
    small.sort(key=lambda r: (r["y"], r["f"], r["g"] or []))  # sums in one order, whatever Spark's
    return _fit(small, place, prior, penalty, l2)


def _fit(rows: list, place: dict[int, int], prior: float, penalty: float, l2: float, steps: int = 400, rate: float = 0.05) -> tuple[float, dict[int, float]]:
    """Full-batch Adam over sparse rows."""
    y = np.array([r["y"] for r in rows], float)
    at = np.repeat(np.arange(len(rows)), [len(r["f"]) for r in rows])
    col = np.array([place[f] for r in rows for f in r["f"]], int)
    pairs = [(set(r["f"]), set(r["g"])) for r in rows if r["g"] is not None and set(r["g"]) != set(r["f"])]
    c_at = np.array([k for k, (f, g) in enumerate(pairs) for _ in f ^ g], int)
    c_col = np.array([place[x] for f, g in pairs for x in sorted(f ^ g)], int)
    c_sign = np.array([1.0 if x in f else -1.0 for f, g in pairs for x in sorted(f ^ g)], float)
    w, m, v = np.zeros(len(place) + 1), np.zeros(len(place) + 1), np.zeros(len(place) + 1)
    w[-1] = prior
    for t in range(1, steps + 1):
        logit = np.bincount(at, w[col], len(rows)) + w[-1]
        r = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(rows)
        g = np.append(np.bincount(col, r[at], len(place)), r.sum())
        g[:-1] += 2 * l2 * w[:-1]
        if pairs:
            change = np.bincount(c_at, c_sign * w[c_col], len(pairs))
            g[:-1] += np.bincount(c_col, 2 * penalty / len(pairs) * change[c_at] * c_sign, len(place))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return float(w[-1]), {f: float(w[k]) for f, k in place.items()}


class Scorer:
    """Scores texts; remembers at most ``cap`` words."""

    def __init__(self, bias: float, weights: dict[int, float], cap: int = 300_000):
        self.bias, self.weights, self.cap = bias, weights, cap
        self.dull: set[str] = set()
        self.telling: dict[str, tuple[int, ...]] = {}

    def score(self, text: str | None) -> float:
        found: set[int] = set()
        for w in text_words(text) - self.dull:
            f = self.telling.get(w)
            if f is None:
                f = tuple(x for x in word_features(w) if x in self.weights)
                if not f:
                    if len(self.dull) >= self.cap:
                        self.dull.clear()
                    self.dull.add(w)
                    continue
                if len(self.telling) >= self.cap:
                    self.telling.clear()
                self.telling[w] = f
            found.update(f)
        x = self.bias + sum(self.weights[f] for f in sorted(found))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def score_toxicity(docs: DataFrame, model: tuple[float, dict[int, float]], text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """Documents with all their columns and the score (0 to 1) of each whole text in ``out``.

    Null and empty texts get the score of the bias alone. Repeated rows are scored alike, so texts may tie;
    an empty table stays empty; a column of the name ``out`` is replaced, all others stay.
    """
    bias, weights = model

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = Scorer(bias, weights)
        for b in batches:
            yield pd.Series([s.score(t) for t in b], dtype="float64")

    return docs.withColumn(out, score(F.col(text_col)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score and prediction, from a model of rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))
