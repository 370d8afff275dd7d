"""Language ID: script ranges, per-word scores and a Viterbi path with a switching penalty."""

from __future__ import annotations

import re
import uuid
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.toxicity import is_held_out
from corpusloom.runtime import materialize, small_join, table

#: First code points of script ranges (Unicode blocks), in order; what lies between is the script before.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"),
    (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0x20000, "han"), (0x30000, "other"),
)
_FIRST = [a for a, _ in SCRIPTS]

#: Numerals and marks that ``\\w`` takes but that are no letters, besides decimal digits.
_NUMERALS = "".join(c for c in map(chr, range(0x20000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_WORD, _ALNUM = re.compile(f"[^\\W\\d_{_NUMERALS}]+"), re.compile(r"[^\W\d_]+")
#: Training takes at most so many documents for each language, the first by a hash of the id, and keeps
#: so many n-grams for each.
DOCS_PER_LANG, GRAMS_PER_LANG = 800, 20_000
#: Shares (of an n-gram in a language that has it) that a model holds at most, 6 bytes each: above 200 languages
#: each keeps fewer n-grams, its commonest, and no language goes.
MODEL_SHARES = 8_000_000
#: Scores of words times languages that a worker remembers, and that it works on at once.
MEMO_CELLS, CHUNK_CELLS = 40_000_000, 4_000_000
UNKNOWN = "und"


def pattern_of(text: str) -> re.Pattern:
    """The pattern of a text's words: runs of letters. Only texts with other numerals need the slower one."""
    return _ALNUM if "".join(_ALNUM.findall(text)).isalpha() else _WORD


def words_of(text: str) -> list[str]:
    words = _ALNUM.findall(text)
    return words if "".join(words).isalpha() else _WORD.findall(text)


def script_of(word: str) -> str:
    return SCRIPTS[bisect_right(_FIRST, ord(word[0])) - 1][1]


def word_grams(word: str) -> list[str]:
    """The word itself, and its letters in threes with its bounds marked."""
    w = f"^{word}$"
    return [f"={word}", *(w[k : k + 3] for k in range(len(w) - 2))]


def is_word(gram: str) -> bool:
    return gram[0] == "=" and len(gram) > 1


def train(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, grams_per_lang: int = GRAMS_PER_LANG, lang_col: str = "lang", most_shares: int = MODEL_SHARES) -> dict:
    """Per-language log shares of n-grams, prior shares and scripts, from rows that are not held out.

    Every language is in the model, however many there are: shares are held sparse, by n-gram, for the
    languages that have it, and ``floors`` stand for the others. ``docs_per_lang`` whole documents of each
    language are read, and ``grams_per_lang`` words and as many triples of letters of each are kept, so that
    there are at most ``most_shares`` in all. A language's documents are first thinned by a hash of their
    ids to some four times as many, in place; only these are ordered by it. The driver holds a row for each
    language, and the model. Rows with a null language, id or text are not used; repeated rows count once.
    """
    spark = docs.sparkSession
    known = docs.where(F.col(lang_col).isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~is_held_out()).select("doc_id", F.col(lang_col).alias("lang"))
    per = materialize(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang-counts")
    priors = {r["lang"]: r["n"] for r in per.collect()}
    if not priors:
        return {"langs": [], "prior": [], "grams": [], "scripts": {}}
    langs = sorted(priors)
    place = {x: k for k, x in enumerate(langs)}
    grams_per_lang = max(1, min(grams_per_lang, most_shares // (2 * len(langs))))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # a draw from 0 to 2 ** 20 - 1; rare languages keep all their documents
    draw = F.xxhash64("doc_id", F.lit(3)).bitwiseAND(F.lit((1 << 20) - 1))
    most = per.select("lang", F.least(F.lit(1 << 20), F.expr(f"{4 * docs_per_lang << 20}L div n")).alias("most"))
    thin = small_join(known, materialize(most, "lang-most"), "lang").where(draw < F.col("most"))
    ids = thin.dropDuplicates(["lang", "doc_id"]).withColumn("r", F.row_number().over(first)).where(F.col("r") <= docs_per_lang).select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang"))
    chosen = materialize(ids.groupBy("__id").agg(F.min("__lang").alias("__lang")), "lang-chosen")
    sample = small_join(docs.select("doc_id", "text"), chosen, F.col("doc_id") == F.col("__id")).select(F.col("__lang").alias("lang"), "text")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        for b in batches:
            for lang, part in b.groupby("lang"):
                words = Counter(w for t in part["text"] for w in words_of(t.lower()))
                grams: Counter = Counter()
                for w, n in words.items():
                    grams["#" + script_of(w)] += n * len(w)
                    for g in word_grams(w):
                        grams[g] += n
                yield pd.DataFrame({"lang": lang, "gram": list(grams), "n": list(grams.values())})

    counts = materialize(sample.mapInPandas(counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "lang-grams")
    kind = F.when(F.substring("gram", 1, 1) == "#", "s").when((F.substring("gram", 1, 1) == "=") & (F.char_length("gram") > 1), "w").otherwise(F.char_length("gram").cast("string"))
    counts = counts.withColumn("kind", kind)
    totals = {(r["lang"], r["kind"]): (r["n"], r["v"]) for r in counts.groupBy("lang", "kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    top = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "gram")
    kept = counts.withColumn("r", F.row_number().over(top)).where(F.col("r") <= grams_per_lang)
    scripts: dict[str, set[int]] = {}
    for r in kept.where("kind = 's'").collect():  # a row for each script of a language
        if r["n"] >= 0.01 * totals[r["lang"], "s"][0]:
            scripts.setdefault(r["gram"][1:], set()).add(place[r["lang"]])
    total = {k: np.array([totals.get((x, k), (0, 0))[0] + 1.0 for x in langs]) for k in ("w", "3")}
    floors = {k: np.log(0.5 / t) for k, t in total.items()}
    rows = kept.where("kind IN ('w', '3')").groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("lang", "n"))).alias("x")).orderBy("gram").toArrow()
    x = rows["x"].combine_chunks()
    at = np.array([place[k] for k in x.flatten().field("lang").to_pylist()], np.uint16 if len(langs) < 1 << 16 else np.uint32)
    n, offsets, grams = x.flatten().field("n").to_numpy(), np.asarray(x.offsets), rows["gram"].to_pylist()
    word = np.repeat(np.array(list(map(is_word, grams)), bool), np.diff(offsets))
    share = np.where(word, np.log((n + 0.5) / total["w"][at]) - floors["w"][at], np.log((n + 0.5) / total["3"][at]) - floors["3"][at])
    prior = np.log(np.array([priors[k] for k in langs]) / sum(priors.values()))
    return {"langs": langs, "prior": prior.tolist(), "grams": grams, "first": offsets, "at": at, "share": share.astype(np.float32), "floors": floors, "scripts": {k: sorted(v) for k, v in scripts.items()}}


def shares_of(model: dict, gram: str) -> np.ndarray | None:
    """Log shares of an n-gram by language; None if the model lacks it."""
    if gram not in model["grams"]:
        return None
    k = model["grams"].index(gram)
    out = model["floors"]["w" if is_word(gram) else "3"].copy()
    a, b = model["first"][k], model["first"][k + 1]
    out[model["at"][a:b]] += model["share"][a:b]
    return out


class Labeller:
    """Labels texts with a model; remembers at most ``cap`` words."""

    def __init__(self, model: dict, penalty: float = 12.0, cap: int = 300_000):
        self.langs, self.penalty = model["langs"], penalty
        self.prior = np.array(model["prior"])
        n = max(1, len(self.langs))
        self.cap, self.step = max(1000, min(cap, MEMO_CELLS // n)), max(1, min(50_000, CHUNK_CELLS // n))
        self.place = {g: k for k, g in enumerate(model["grams"])}
        none = np.zeros(0, np.int64)
        short = [g for g in self.place if not is_word(g)]
        keys = np.array([ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2]) for g in short] or [-1], np.int64)
        order = np.argsort(keys)
        self.triples, self.triple_at = keys[order], np.array([self.place[g] for g in short] or [0], np.int64)[order]
        self.first, self.at, self.share = model.get("first", np.zeros(1, np.int64)), model.get("at", none), model.get("share", none)
        self.floors = [model["floors"][k] if "floors" in model else np.zeros(n) for k in ("w", "3")]
        self.barred = {s: np.array([k not in allowed for k in range(n)]) for s, allowed in model["scripts"].items()}
        self.row: dict[str, int] = {}
        self.table, self.post, self.size = np.zeros((1024, n), np.float32), np.zeros((1024, n), np.float32), np.zeros(1024, np.int32)

    def _learn(self, words: list[str]) -> None:
        """Rows of new words: the mean log share of a word's n-grams by language, times how much it can tell.

        Languages outside the word's script are out; a script of no language says nothing.
        """
        if len(self.row) + len(words) > self.cap:
            self.row.clear()
        base = len(self.row)
        while base + len(words) > len(self.table):
            self.table, self.post, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.table, self.post, self.size))
        for k in range(0, len(words), self.step):
            self._score(words[k : k + self.step], base + k)
        self.size[base : base + len(words)] = [len(w) for w in words]
        self.row.update(zip(words, range(base, base + len(words))))

    def _score(self, words: list[str], base: int) -> None:
        n, wide = len(words), max(1, len(self.langs))
        low = [w.lower() for w in words]
        whole = np.fromiter(map(self.place.get, map("=".__add__, low), repeat(-1)), np.int64, n)
        # triples of letters as numbers, looked up all at once
        points = np.frombuffer(f"^{'$^'.join(low)}$".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, low), np.int64, n)
        begins = np.cumsum(sizes + 2) - sizes - 2
        owner = np.repeat(np.arange(n), sizes)
        p = np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(len(owner))
        triple = points[p] << 42 | points[p + 1] << 21 | points[p + 2]
        found = np.minimum(np.searchsorted(self.triples, triple), len(self.triples) - 1)
        known = self.triples[found] == triple
        at = np.concatenate([whole[whole >= 0], self.triple_at[found[known]]])
        owner = np.concatenate([np.flatnonzero(whole >= 0), owner[known]])
        counts, whole = np.bincount(owner, minlength=n), whole >= 0
        s = np.zeros((n, wide))
        if len(at):
            size = self.first[at + 1] - self.first[at]
            places = np.repeat(self.first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
            cell = np.repeat(owner, size) * wide + self.at[places]
            s = np.bincount(cell, self.share[places], n * wide).reshape(n, wide)
            s += whole[:, None] * self.floors[0] + (counts - whole)[:, None] * self.floors[1]
            c = np.maximum(counts, 1)[:, None]
            s = s / c * np.minimum(3.0, np.sqrt(c))
        script = np.searchsorted(_FIRST, points[begins + 1], "right") - 1
        for k in np.unique(script):
            rows = script == k
            barred = self.barred.get(SCRIPTS[k][1])
            if barred is None:
                s[rows] = 0.0
            else:
                part = s[rows]
                part = np.maximum(part - part[:, ~barred].max(axis=1, keepdims=True), -8.0)
                part[:, barred] = -8.0
                s[rows] = part
        x = np.exp(s - s.max(axis=1, keepdims=True))
        self.table[base : base + n], self.post[base : base + n] = s, x / x.sum(axis=1, keepdims=True)

    def rows(self, words: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.row.get, words, repeat(-1)), np.int64, len(words))
        for _ in range(2):  # the memo may start anew
            if (at >= 0).all():
                break
            self._learn(sorted({words[k] for k in np.flatnonzero(at < 0)}))
            at = np.fromiter(map(self.row.get, words, repeat(-1)), np.int64, len(words))
        return at

    def path(self, s: np.ndarray) -> np.ndarray:
        """The best language for each word: sum of scores less ``penalty`` for each switch.

        The best single language is the whole path if no stretch of words in another gains more over it
        than a switch costs, and no stretch at the beginning and one at the end do so together: ``k``
        stretches in others cost ``k`` switches, or ``k - 1`` where they hold both ends and nothing is
        left of the best. Only other texts go through the recursion.
        """
        p = self.penalty
        total = s.sum(axis=0) + self.prior
        best = int(np.argmax(total))
        gain = np.cumsum(s - s[:, best : best + 1], axis=0) + (self.prior - self.prior[best])
        low = np.minimum.accumulate(np.concatenate([np.minimum(0.0, self.prior - self.prior[best])[None, :], gain[:-1]]), axis=0)
        ends = gain.max() + max(0.0, float((gain[-1] - gain[:-1].min(axis=0)).max())) if len(s) > 1 else 0.0
        if float((gain - low).max()) <= p and ends <= p:
            return np.full(len(s), best)
        n, states = s.shape
        if states > 16:  # few states are faster one by one
            came, v, own = np.empty((n - 1, states), np.uint16 if states < 1 << 16 else np.uint32), s[0] + self.prior, np.arange(states)
            for k in range(1, n):
                at = int(v.argmax())
                least = v[at] - p
                came[k - 1] = np.where(v >= least, own, at)
                v = np.maximum(v, least) + s[k]
        else:
            back, own, v = array("H"), range(states), (s[0] + self.prior).tolist()
            for k in range(1, n, 20_000):
                for row in s[k : k + 20_000].tolist():
                    top = max(v)
                    least, at = top - p, v.index(top)
                    back.extend([i if x >= least else at for i, x in zip(own, v)])
                    v = [(x if x >= least else least) + y for x, y in zip(v, row)]
            came = np.frombuffer(back, np.uint16).reshape(n - 1, states)
        out = np.empty(n, np.int64)
        out[-1] = k = int(np.argmax(v))
        for t in range(n - 1, 0, -1):
            out[t - 1] = k = int(came[t - 1, k])
        return out

    def label(self, text: str | None) -> tuple[str, float, list[tuple[str, int, int]]]:
        """Language of most letters, its mean posterior share, and spans (language, start, end)."""
        words = words_of(text) if text and self.langs else []
        if not words:
            return UNKNOWN, 0.0, []
        pieces = []
        for k in range(0, len(words), self.step):
            at = self.rows(words[k : k + self.step])
            pieces.append((self.table[at], self.post[at], self.size[at]))
        s, post, length = (np.concatenate(x) if len(pieces) > 1 else x[0] for x in zip(*pieces))
        path = self.path(s.astype(np.float64))
        cuts = np.flatnonzero(np.diff(path)) + 1
        k = int(np.bincount(path, length, len(self.langs)).argmax())
        score = min(1.0, max(0.0, float(post[:, k] @ length / length.sum())))
        if not len(cuts):
            return self.langs[k], score, [(self.langs[k], text.index(words[0]), text.rindex(words[-1]) + len(words[-1]))]
        found, edges = list(pattern_of(text).finditer(text)), [0, *cuts.tolist(), len(path)]
        return self.langs[k], score, [(self.langs[path[a]], found[a].start(), found[b - 1].end()) for a, b in zip(edges, edges[1:])]


#: The labeller of a worker's last model.
_LABELLERS: dict[str, Labeller] = {}
LABEL = "struct<lang:string,score:double,spans:array<struct<lang:string,start:int,end:int>>>"


def label_languages(docs: DataFrame, model: dict, penalty: float = 12.0, text_col: str = "text", out: str = "language") -> DataFrame:
    """Documents with all their columns and ``out``: language, score (0 to 1) and spans of whole texts.

    Null texts and texts without letters are ``und`` with score 0, as are all texts if the model has
    no language. Spans are in code points, end exclusive. Of languages with equal letters, and of paths
    with equal scores, the first by name is taken; repeated rows are labelled alike; an empty table stays
    empty; a column of the name ``out`` is replaced.
    """
    spread, token = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # bounded by the parameters of train()

    @F.pandas_udf(LABEL)
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lab = _LABELLERS.get(token)
        if lab is None:  # kept over a worker's tasks
            _LABELLERS.clear()
            lab = _LABELLERS[token] = Labeller(spread.value, penalty)
        for b in batches:
            got = [lab.label(t) for t in b]
            yield pd.DataFrame({"lang": [g[0] for g in got], "score": [g[1] for g in got], "spans": [[{"lang": x, "start": a, "end": e} for x, a, e in g[2]] for g in got]})

    return docs.withColumn(out, label(F.col(text_col)))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, from a model of rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labelled = label_languages(docs.select("doc_id", "text"), train(docs))
    return labelled.select("doc_id", is_held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.size("language.spans").cast("long").alias("n_spans"))
