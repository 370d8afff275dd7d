"""Line dedup: a fixed-depth log-template tree over the lines and sentences of all documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.minhash import _GOLD, _WordHashes, mix
from corpusloom.llm.quality import SPACE, rows_where
from corpusloom.runtime import Scratch, materialize, merge_join, table

#: Leading tokens that lead to a leaf of the tree.
DEPTH = 8
#: Parts of a line's tokens behind the leading ones; a template may have one of them as a field.
PARTS = 3
#: Shorter lines are never dropped.
LEAST_TOKENS = 5
#: A template of ``DEPTH`` tokens or more recurs from two different texts on, a shorter one from three.
LONG_DOCS, LEAST_DOCS = 2, 3
#: Words of a run that recurs wherever it stands, and of the grams that stand for it.
RUN, GRAM = 16, 8

_WORD = re.compile("[^ \\t-\\r]+")


def segments_of(text: Column) -> Column:
    """Lines, and within them sentences, each with the mark and space or line end that closes it.

    Joined without a separator they are the text again. A control character marks their ends, which
    is faster than a pattern that looks back at every place; texts that hold it are split by pattern.
    """
    marked = text
    for end in (". ", "! ", "? ", "\n"):
        marked = F.replace(marked, F.lit(end), F.lit(end + "\x01"))
    return F.when(F.contains(text, F.lit("\x01")), F.split(text, r"(?<=[.!?] |\n)", -1)).otherwise(F.split(marked, "\x01", -1))


def tokens_of(segment: Column) -> Column:
    """Tokens of a segment, those with a digit as ``<*>``."""
    masked = F.when(segment.rlike("[0-9]"), F.regexp_replace(segment, "[^ \\t-\\r]*[0-9][^ \\t-\\r]*", "<*>")).otherwise(segment)
    return F.split(F.btrim(masked, F.lit(SPACE)), "[ \\t-\\r]+")


def part_hashes(tokens: Column, depth: int, parts: int) -> Column:
    """Hashes of the parts of the tokens behind the leading ``depth``, as even as can be; null for short lines."""
    n = F.size(tokens) - depth
    edge = lambda k: F.floor(n * k / parts).cast("int")
    one = lambda k: F.xxhash64(F.array_join(F.slice(tokens, edge(k) + (depth + 1), edge(k + 1) - edge(k)), " "))
    return F.when(n > 0, F.array(*[one(k) for k in range(parts)]))


def line_rows(docs: DataFrame, depth: int = DEPTH, least_tokens: int = LEAST_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc_id, seg, digest, long, parts) for each line or sentence of ``least_tokens`` or more.

    ``key`` is its leaf: the count of tokens, then the leading ones; ``long`` ones have ``depth`` tokens.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("digest"), F.posexplode(segments_of(F.col(text_col))).alias("seg", "line"))
    rows = src.select("doc_id", "digest", "seg", tokens_of(F.col("line")).alias("tokens")).where(F.size("tokens") >= least_tokens)
    leaf = F.xxhash64(F.size("tokens"), F.array_join(F.slice("tokens", 1, depth), " "))
    return rows.select(leaf.alias("key"), "doc_id", "seg", "digest", (F.size("tokens") >= depth).alias("long"), part_hashes(F.col("tokens"), depth, PARTS).alias("parts"))


def drop_recurring_lines(docs: DataFrame, depth: int = DEPTH, least_tokens: int = LEAST_TOKENS, least_docs: int = LEAST_DOCS, long_docs: int = LONG_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with all their columns and two more: ``__l_n`` segments and ``__l_dropped``, those dropped.

    A line or sentence goes down a tree of fixed depth: by its count of tokens, then by its leading
    ``depth`` tokens, where tokens with a digit are variable. Within a leaf, lines have a template in
    common that agree on all but one of three parts of the tokens behind; that part is its field. So
    at most a third of the tokens behind the leading ones are generalised, and lines that agree on
    their beginning alone share nothing. A template recurs if it is in ``least_docs`` documents of
    different texts, or in ``long_docs`` (2 or more) if it has ``depth`` tokens or more. Each recurring
    template stays at its first place (lowest id, then text and position); a line that is the first
    of none of its recurring templates is dropped.

    Null texts stay null; null ids come first; rows are met by id and text, so rows that repeat an id
    keep their own lines, and copies of a whole text count once and are treated alike; an empty table
    stays empty.
    """
    with Scratch(docs.sparkSession) as tmp:
        rows = tmp.table(line_rows(docs, depth, least_tokens, id_col, text_col), "line-all")
        # 1. leaves of two texts or more: one row for each leaf and task is shuffled
        shared = rows.groupBy("key").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("key")
        lines = merge_join(rows, tmp.table(shared, "line-shared"), "key")
        # 2. the templates of their lines, and of these the ones of enough texts with their first places
        part = F.col("parts")
        without = F.array(*[F.xxhash64("key", F.lit(k), *[F.get(part, F.lit(j)) for j in range(PARTS) if j != k]) for k in range(PARTS)])
        lines = tmp.table(lines.select("doc_id", "seg", "digest", "long", F.explode(F.when(part.isNull(), F.array("key")).otherwise(without)).alias("template")), "line-templates")
        texts = lines.groupBy("template", "long", "digest").agg(F.min(F.struct("doc_id", "digest", "seg")).alias("first"))
        often = texts.groupBy("template", "long").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first")).where(F.col("n") >= F.when(F.col("long"), long_docs).otherwise(least_docs))
        often = tmp.table(often.select("template", "first"), "line-often")
        # 3. places to drop, by document and text
        place = F.struct("doc_id", "digest", "seg")
        met = merge_join(lines, often, "template").groupBy("doc_id", "digest", "seg").agg(F.max(place.eqNullSafe(F.col("first"))).alias("stays"))
        drop = met.where("NOT stays").groupBy("doc_id", "digest").agg(F.collect_set("seg").alias("__l_segs"))
        drop = materialize(drop.withColumnsRenamed({"doc_id": "__l_id", "digest": "__l_digest"}), "line-drops")
    here = F.col(id_col).cast("long").eqNullSafe(F.col("__l_id")) & (F.xxhash64(text_col) == F.col("__l_digest"))
    out = merge_join(docs, drop, here, "left").drop("__l_id", "__l_digest")
    places = F.array_except(F.sequence(F.lit(0), F.size("__l_all") - 1), F.col("__l_set"))
    kept = F.transform(places, lambda i: F.get(F.col("__l_all"), i))
    out = out.withColumn("__l_set", F.coalesce("__l_segs", F.array().cast("array<int>"))).withColumn("__l_all", segments_of(F.col(text_col)))
    out = out.withColumn("__l_n", F.coalesce(F.greatest(F.size("__l_all"), F.lit(0)), F.lit(0)).cast("long")).withColumn("__l_dropped", F.size("__l_set").cast("long"))
    return out.withColumn(text_col, F.when(F.size("__l_set") == 0, F.col(text_col)).otherwise(F.array_join(kept, ""))).drop("__l_segs", "__l_set", "__l_all")


class Runs:
    """64-bit hashes of a text's runs of ``run`` words, and of the least gram within each."""

    def __init__(self, run: int = RUN, gram: int = GRAM):
        self.run, self.gram, self.memo = run, gram, _WordHashes()

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = _WORD.findall(text) if text else []
        n = len(words) - self.run + 1
        if n < 1:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        h = np.fromiter((self.memo[w.encode("utf-8", "surrogatepass")] for w in words), np.uint64, len(words))
        with np.errstate(over="ignore"):
            grams, runs = np.zeros(len(h) - self.gram + 1, np.uint64), np.zeros(n, np.uint64)
            for j in range(self.run):
                runs = runs * _GOLD + h[j : j + n]
                runs ^= runs >> np.uint64(29)
            for j in range(self.gram):
                grams = grams * _GOLD + h[j : j + len(grams)]
                grams ^= grams >> np.uint64(29)
            runs, grams = mix(runs), mix(grams)
        least = grams[:n].copy()
        for j in range(1, self.run - self.gram + 1):
            np.minimum(least, grams[j : j + n], out=least)
        return runs.view(np.int64), least.view(np.int64)


def without_runs(text: str, starts: list[int], run: int) -> str:
    """The text without the words of the runs that begin at ``starts``; a line end beside a run stays."""
    words = [m.span() for m in _WORD.finditer(text)]
    gone = np.zeros(len(words) + 1, np.int64)
    for k in starts:
        gone[k] += 1
        gone[k + run] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2)
    out, at = [], 0
    for a, b in edges.tolist():
        left = words[a - 1][1] if a else 0
        right = words[b][0] if b < len(words) else len(text)
        before, after = text[left : words[a][0]], text[words[b - 1][1] : right]
        out += [text[at:left], after if "\n" in after and "\n" not in before else before]
        at = right
    return "".join([*out, text[at:]])


def drop_recurring_runs(docs: DataFrame, run: int = RUN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with all their columns and ``__r_dropped``, the runs of words dropped from each.

    A run of ``run`` words that stands in two different texts, whatever surrounds it, stays at its first
    place (lowest id, then text and position) and is dropped at all others. Copies of a whole text count
    once and are treated alike. Equal runs have the same least gram, so first only these are shuffled,
    about one in five words; then every run whose gram is in two texts.

    Null texts stay null; rows are met by id and text, so repeated and null ids do no harm.
    """
    c = F.col
    src = docs.select(c(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("digest"), c(text_col).cast("string").alias("text"))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(run, gram)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                got = [np.unique(runs(t)[1]) for t in part.column(2).to_pylist()]
                at = pa.array(np.repeat(np.arange(len(got)), [len(g) for g in got]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(np.concatenate(got))], ["doc_id", "digest", "gram"])

    def shared_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(run, gram)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                keys, places, n = [], [], []
                for t, wanted in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    h, g = runs(t)
                    at = np.flatnonzero(np.isin(g, np.array(wanted, np.int64)))
                    keys.append(h[at])
                    places.append(at.astype(np.int32))
                    n.append(len(at))
                at = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), part.column(0).take(at), part.column(1).take(at), pa.array(np.concatenate(places))], ["key", "doc_id", "digest", "pos"])

    with Scratch(docs.sparkSession) as tmp:
        # 1. grams of two texts or more: one row for each gram and task is shuffled
        grams = tmp.table(src.mapInArrow(least, "doc_id long, digest long, gram long"), "run-grams")
        both = grams.groupBy("gram").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("gram")
        met = merge_join(grams, tmp.table(both, "run-shared"), "gram")
        met = tmp.table(met.groupBy("doc_id", "digest").agg(F.collect_set("gram").alias("grams")).withColumnsRenamed({"doc_id": "i", "digest": "d"}), "run-met")
        # 2. their runs, and of these the ones of two texts with their first place
        here = c("doc_id").eqNullSafe(c("i")) & (c("digest") == c("d"))
        rows = merge_join(src, met, here).select("doc_id", "digest", "text", "grams")
        rows = tmp.table(rows.mapInArrow(shared_runs, "key long, doc_id long, digest long, pos int"), "run-rows")
        first = rows.groupBy("key").agg(F.min("digest").alias("a"), F.max("digest").alias("b"), F.min(F.struct("doc_id", "digest", "pos")).alias("f")).where("a <> b")
        first = tmp.table(first.select("key", c("f.digest").alias("f_digest"), c("f.pos").alias("f_pos")), "run-first")
        # 3. places to drop, by document; a run that overlaps its own first place stays
        drop = merge_join(rows, first, "key").where((c("digest") != c("f_digest")) | (c("pos") >= c("f_pos") + run))
        drop = materialize(drop.groupBy("doc_id", "digest").agg(F.collect_set("pos").alias("__r_at")).withColumnsRenamed({"doc_id": "__r_id", "digest": "__r_digest"}), "run-drops")

    # only texts that lose runs are sent; for the others the column is null
    def without(texts: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or at is None else without_runs(t, at, run) for t, at in zip(texts, starts)], dtype=object)

    cut = F.pandas_udf(without, "string")
    out = merge_join(docs, drop, c(id_col).cast("long").eqNullSafe(c("__r_id")) & (F.xxhash64(text_col) == c("__r_digest")), "left")
    out = out.withColumn("__r_dropped", F.greatest(F.size("__r_at"), F.lit(0)).cast("long")).drop("__r_id", "__r_digest")
    return out.withColumn(text_col, F.when(c("__r_dropped") == 0, c(text_col)).otherwise(cut(F.when(c("__r_dropped") > 0, c(text_col)), c("__r_at")))).drop("__r_at")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's count of lines and sentences, how many were dropped, and a digest of what stays."""
    d = drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.col("__l_n").alias("n_lines"), F.col("__l_dropped").alias("n_dropped"), F.char_length("text").cast("long").alias("n_chars_kept"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without their recurring runs of words and lines; those left without a word go.

    Null, empty and blank texts, from which nothing was dropped, stay; repeated rows are treated alike;
    an empty table stays empty.
    """
    cut = materialize(drop_recurring_runs(docs), "run-cut")
    d = drop_recurring_lines(cut)
    flag = (F.col("__l_dropped") + F.col("__r_dropped") == 0) | F.col("text").rlike("[^ \\t-\\r]")
    return rows_where(d.withColumn("__l_stays", flag), "__l_stays", docs.columns)


#: The template is written as text here where the operator hashes it.
LINES_SQL = r"""
  SELECT doc_id, text, unnest(seg) AS line, generate_subscripts(seg, 1) - 1 AS seg FROM (
    SELECT doc_id, text, string_split(regexp_replace(text, '([.!?] |\n)', '\1' || chr(1), 'g'), chr(1)) AS seg FROM {docs})
"""
DEDUP_SQL = r"""
  l AS (""" + LINES_SQL + r"""),
  k AS (SELECT doc_id, text, seg, line, string_split_regex(trim(regexp_replace(line, '[^ \t-\r]*[0-9][^ \t-\r]*', '<*>', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[ \t-\r]+') AS tok FROM l),
  p AS (SELECT doc_id, text, seg, line, len(tok) AS n, tok, array_to_string(tok[1:8], ' ') AS head, [array_to_string(tok[9 + j * (len(tok) - 8) // 3 : 8 + (j + 1) * (len(tok) - 8) // 3], ' ') FOR j IN range(3)] AS part FROM k),
  t AS (SELECT doc_id, text, seg, n, unnest(CASE WHEN n > 8 THEN [n || ' ' || head || chr(1) || '_' || chr(1) || part[2] || chr(1) || part[3], n || ' ' || head || chr(1) || part[1] || chr(1) || '_' || chr(1) || part[3], n || ' ' || head || chr(1) || part[1] || chr(1) || part[2] || chr(1) || '_'] ELSE [n || ' ' || head] END) AS template FROM p WHERE n >= 5),
  often AS (SELECT template, min(row(doc_id, text, seg)) AS first FROM t GROUP BY template, n HAVING count(DISTINCT text) >= CASE WHEN n >= 8 THEN 2 ELSE 3 END),
  met AS (SELECT doc_id, text, seg, bool_or(row(doc_id, text, seg) = first) AS stays FROM t JOIN often USING (template) GROUP BY ALL),
  cut AS (SELECT l.doc_id, l.seg, l.line, NOT coalesce(stays, true) AS gone FROM l LEFT JOIN met ON met.doc_id IS NOT DISTINCT FROM l.doc_id AND met.text IS NOT DISTINCT FROM l.text AND met.seg = l.seg),
  deduped AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, '' ORDER BY seg) FILTER (WHERE NOT gone), '') AS text FROM cut GROUP BY doc_id)
"""  # fmt: skip
OP8_SQL = "WITH " + DEDUP_SQL.replace("{docs}", "documents") + "SELECT doc_id, n_lines, n_dropped, length(text) AS n_chars_kept, md5(text) AS text_md5 FROM deduped"
