"""Quality rules: native counts and a hashed n-gram log-likelihood ratio of every document."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.runtime import table

SPACE = " \t\n\x0b\f\r"
#: Hashed buckets of words and word pairs; the model is one long for each.
BUCKETS = 1 << 14
#: At most so many documents labelled good stand for the trusted target, chosen by a hash of the id.
TRUSTED = 20_000
#: A document is kept if its mean ratio is this or more, in millionths of a nat.
THRESHOLD = -100_000


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; none for null."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))


def beside(a: Column, b: Column, skip: int, n: Column) -> Column:
    """Hashes of the first ``n`` elements of ``a``, each with the element of ``b`` that is ``skip`` places on."""
    n = F.greatest(n, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, skip + 1, n), lambda x, y: F.xxhash64(x, y))


def buckets_of(words: Column, buckets: int) -> Column:
    """Hashed words and neighbouring pairs."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    two = F.transform(beside(words, words, 1, F.size(words) - 1), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    return F.concat(one, two)


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``__words`` and the counts n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Names begin with ``__q_``, so that they clash with no column of the documents.
    """
    c = F.col
    body = F.coalesce(c(text), F.lit(""))
    d = docs.withColumn("__q_words", words_of(c(text)))
    # windows of five words are hashed from hashes of one, two and four, and only where four words come twice
    n = F.size("__q_words")
    d = d.withColumn("__q_one", F.transform("__q_words", lambda w: F.xxhash64(w)))
    d = d.withColumn("__q_two", beside(c("__q_one"), c("__q_one"), 1, n - 1))
    d = d.withColumn("__q_four", beside(c("__q_two"), c("__q_two"), 2, n - 3))
    d = d.withColumn("__q_hashes", F.when(F.size(F.array_distinct("__q_four")) < F.size("__q_four"), beside(c("__q_four"), c("__q_one"), 4, n - 4)))
    # only texts in which a window comes twice go on to sort theirs
    d = d.withColumn("__q_sorted", F.when(F.size(F.array_distinct("__q_hashes")) < F.size("__q_hashes"), F.sort_array(F.transform("__q_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    nxt = F.slice("__q_sorted", 2, F.size("__q_sorted"))
    none = F.array().cast("array<int>")
    at = F.sort_array(F.array_distinct(F.flatten(F.zip_with("__q_sorted", nxt, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(none)))))
    d = d.withColumn("__q_at", F.when(c("__q_sorted").isNotNull(), at))
    step = F.zip_with("__q_at", F.slice("__q_at", 2, F.size("__q_at")), lambda a, b: F.least(F.lit(5), F.coalesce(b - a, F.lit(5))))
    covered = F.aggregate(step, F.lit(0).cast("long"), lambda s, x: s + x)
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    d = d.withColumn("__q_lines", lines)
    return d.withColumns({
        "__q_n_words": F.size("__q_words").cast("long"),
        "__q_word_chars": F.char_length(F.regexp_replace(body, "[ \\t-\\r]+", "")).cast("long"),
        "__q_n_symbols": F.char_length(F.regexp_replace(body, "[^#*$%&|<>]+", "")).cast("long"),
        "__q_n_dup_lines": (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"),
        "__q_n_repeat_words": F.coalesce(F.when(c("__q_at").isNotNull(), covered), F.lit(0)).cast("long"),
    })


def trusted_ids(labels: DataFrame, limit: int = TRUSTED) -> DataFrame:
    """Ids labelled quality 1 and never 0: at most ``limit``, the first by a hash of the id."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def ratio_model(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """For each bucket the log ratio of its share in trusted and in all documents, in millionths.

    Counts cover every document; shares are smoothed by one. Values are integers, so that sums depend
    on no order. ``trusted`` is bounded by its caller and broadcast; the model is ``buckets`` numbers.
    """
    flag = F.broadcast(trusted.select(F.col("doc_id").alias("__t_id"), F.lit(1).alias("__t")))
    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(flag, F.col("__id") == F.col("__t_id"), "left")
    grams = src.select("__t", F.explode(buckets_of(words_of(F.col("__text")), buckets)).alias("b"))
    raw, target = [0] * buckets, [0] * buckets
    for r in grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count("__t").alias("target")).collect():  # at most ``buckets`` rows
        raw[r["b"]], target[r["b"]] = r["raw"], r["target"]
    of_raw, of_target = sum(raw) + buckets, sum(target) + buckets
    return [round(1e6 * (math.log((t + 1) / of_target) - math.log((n + 1) / of_raw))) for n, t in zip(raw, target)]


def score_quality(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with all their columns and ``__q_`` columns: counts, base_failed, llr_sum, n_grams, kept.

    A document fails the base rules with fewer than 10 words, or if words in repeated 5-word windows
    are over a fifth. Else it is kept if the sum of its n-grams' ratios is at least ``threshold``
    millionths for each n-gram.

    Null texts have no words. Without trusted labels the ratios only smooth the corpus against a flat
    target; with no documents the result is empty. Repeated rows are scored one by one.
    """
    model = ratio_model(docs, trusted_ids(labels), buckets, id_col, text_col)
    d = base_counts(docs, text_col)
    # one literal: the text is folded to an array when the plan is optimised
    llr = F.split(F.lit(",".join(map(str, model))), ",").cast("array<bigint>")
    d = d.withColumn("__q_buckets", buckets_of(F.col("__q_words"), buckets))
    total = F.aggregate("__q_buckets", F.lit(0).cast("long"), lambda s, b: s + F.get(llr, b))
    d = d.withColumns({"__q_n_grams": F.size("__q_buckets").cast("long"), "__q_llr_sum": total})
    failed = (F.col("__q_n_words") < 10) | (100 * F.col("__q_n_repeat_words") > 20 * F.col("__q_n_words"))
    d = d.withColumn("__q_base_failed", failed)
    kept = ~F.col("__q_base_failed") & (F.col("__q_llr_sum") >= threshold * F.col("__q_n_grams"))
    return d.withColumn("__q_kept", kept).drop("__q_words", "__q_one", "__q_two", "__q_four", "__q_hashes", "__q_sorted", "__q_at", "__q_lines", "__q_buckets")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = score_quality(docs, table(spark, sf_dir, "labels"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_grams", "llr_sum")
    return s.select("doc_id", *[F.col(f"__q_{n}").alias(n) for n in names])


def rows_where(d: DataFrame, flag: str, columns: list[str]) -> DataFrame:
    """``columns`` of the rows whose ``flag`` is true.

    The optimiser copies a computed column into a filter on it, once for every reference, and filters
    share no common parts. A generator between the verdict and the filter keeps it computed once.
    """
    one = F.array(F.struct(F.col(flag).alias("__keep"), *[F.col(f"`{c}`") for c in columns]))
    return d.select(F.inline(F.filter(one, lambda r: r["__keep"]))).select(*[f"`{c}`" for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, with their own columns.

    Null, empty and short texts fail the base rules and go; repeated rows and null ids are judged one by
    one; an empty table stays empty.
    """
    return rows_where(score_quality(docs, table(spark, sf_dir, "labels")), "__q_kept", docs.columns)
