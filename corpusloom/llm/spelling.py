"""Spelling variants: words one edit apart, met by pairs of trie nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.prefix import ordered_sums
from corpusloom.runtime import Scratch, materialize, merge_join, small_join, spread, table

LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: Letters of a run: A to Z in either case, and U+00C0 to U+00FF.
LETTERS = "[A-Za-zÀ-ÿ]"
#: After A to Z are lower-cased, a word is of these many letters (26 and 64), which bounds what one pair of nodes can hold.
ALPHABET = 90
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Nodes of so few letters are met by most words: there are at most 1 + 90 + 90 ** 2, so they are broadcast.
SHALLOW = 2
MARK_EVERY = 199


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, mark_every: int = MARK_EVERY) -> DataFrame:
    """(word, n) of maximal runs of letters in ``docs`` (doc_id, text), lower-cased in A to Z.

    If ``mark_every`` divides h, the unsigned crc32 of ``<doc_id>:<run>``, the run loses its code point
    ``h % length``: a stated share of misspellings that do not depend on the order of rows. Counts are
    summed before the shuffle. A null doc_id is written as nothing, a null text has no words.
    """
    runs = F.explode(F.regexp_extract_all("text", F.lit(f"({LETTERS}{{{least_length},}})"), F.lit(1)))
    d = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), runs.alias("run"))
    d = d.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    d = d.withColumn("h", F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % mark_every == 0, cut).otherwise(F.col("run"))
    w = d.select(word.alias("word")).where(F.char_length("word") >= least_length)
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def trie_nodes(words: DataFrame, name: str) -> DataFrame:
    """(id, nodes): for each word of (id, word) the numbers of the trie nodes of its beginnings, from none of its letters to all.

    A node is a distinct beginning, numbered in code-point order over ranges. A node is looked up by its
    letters: short ones, of which the alphabet bounds the number, are broadcast, the rest merged.
    """
    ends = F.explode(F.sequence(F.lit(0), F.char_length("word")))
    parts = words.select("id", "word", ends.alias("i")).select("id", "i", F.substr("word", F.lit(1), F.col("i")).alias("part"))
    numbered = ordered_sums(parts.select("part").distinct(), [], ["part"], rank="node")
    numbered = materialize(numbered, name)
    short = F.char_length("part") <= SHALLOW
    low = parts.where(F.col("i") <= SHALLOW).join(numbered.where(short).hint("broadcast"), "part")
    high = merge_join(parts.where(F.col("i") > SHALLOW), numbered.where(~short), "part")
    rows = low.unionByName(high).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("i", "node"))).alias("r"))
    return rows.select("id", F.col("r.node").alias("nodes"))


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best_n, best_id): for each word of (id, word, n) that has words one edit away, how many and the commonest.

    Ids are numbered in code-point order; of equally common words the smaller id is the best. ``words``
    are distinct, of at most ``ALPHABET`` letters.

    For each place of a word, skipping its letter leaves a pair (node of the letters before, node of the
    reversed letters behind); each place between letters gives a pair without a skip. Words with one
    skipped pair differ in that letter; a skipped and a plain pair differ by one letter more. A pair holds
    at most one plain word and ``ALPHABET`` skipped ones, so a pair of nodes is a small group whatever
    the table's size. A letter of a run of equal ones is skipped at its first place only when it meets
    the plain word, so each neighbour counts once.
    """
    forward = trie_nodes(words, "spelling-forward")
    backward = trie_nodes(words.select("id", F.reverse("word").alias("word")), "spelling-backward")
    d = merge_join(merge_join(words, forward.withColumnRenamed("nodes", "p"), "id"), backward.withColumnRenamed("nodes", "s"), "id")
    letter = lambda i: F.substr(F.col("word"), i, F.lit(1))
    length = F.char_length("word")
    skips = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.struct(F.get("p", i).alias("a"), F.get("s", length - 1 - i).alias("b"), F.lit(True).alias("skip"), ((i == 0) | (letter(i) != letter(i + 1))).alias("first")))
    plain = F.transform(F.sequence(F.lit(0), length), lambda i: F.struct(F.get("p", i).alias("a"), F.get("s", length - i).alias("b"), F.lit(False).alias("skip"), F.lit(True).alias("first")))
    rows = d.select("id", "n", F.explode(F.concat(skips, plain)).alias("k")).select("id", "n", "k.*")
    groups = rows.groupBy("a", "b").agg(F.collect_list(F.struct("n", F.negative("id").alias("neg"), "skip", "first")).alias("g")).where(F.size("g") > 1)
    # of a skipped word near are the other skipped ones, and the plain one if it meets it; of the plain word those that meet it
    others = lambda x: F.filter("g", lambda y: (x["neg"] != y["neg"]) & (x["skip"] | y["skip"]) & (x["skip"] & y["skip"] | x["first"] & y["first"]))
    near = F.transform("g", lambda x: F.struct((-x["neg"]).alias("id"), F.transform(others(x), lambda y: F.struct(y["n"], y["neg"])).alias("o")))
    rows = groups.select(F.explode(near).alias("x")).where(F.size("x.o") > 0).select("x.id", F.size("x.o").alias("c"), F.array_max("x.o").alias("best"))
    g = rows.groupBy("id").agg(F.sum("c").alias("n_near"), F.max("best").alias("best"))
    return g.select("id", "n_near", F.col("best.n").alias("best_n"), (-F.col("best.neg")).alias("best_id"))


def roots_of(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root_id) of links (id, form_id): where following them ends. Pointers double each round, so a chain of k takes log k."""
    now = scratch.table(forms.select("id", F.col("form_id").alias("root_id")), "spelling-roots")
    while True:
        far = now.select(F.col("id").alias("root_id"), F.col("root_id").alias("far"))
        step = scratch.table(merge_join(now, far, "root_id", "left").select("id", F.coalesce("far", "root_id").alias("root_id"), F.col("far").isNotNull().alias("moved")), "spelling-roots")
        moved, now = step.where("moved").limit(1).count(), step.drop("moved")
        if not moved:
            return now


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, mark_every: int = MARK_EVERY) -> DataFrame:
    """(word, form, root, n, n_near, form_n): words of ``docs`` (doc_id, text) with the form that they vary.

    Words are counted by ``count_words``; two are near if they differ by one inserted, deleted or replaced
    code point. A word's form is its commonest near word (ties: the smallest in code-point order) if that
    is at least ``times`` as common, else null; its root is where forms end, the word itself without one.
    Counts grow along forms, so they never run in a circle.

    Null texts have no words; repeated rows count again; very long texts are read whole; an empty table
    gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    with Scratch(spark, owns=True) as s:
        counted = s.table(count_words(docs, least_length, least_count, mark_every), "spelling-counted")
        words = s.table(ordered_sums(counted, [], ["word"], rank="id"), "spelling-words")
        near = s.table(near_words(words), "spelling-near")
        w = merge_join(words, near, "id", "left").withColumn("form_id", F.when(F.col("best_n") >= times * F.col("n"), F.col("best_id")))
        w = s.table(w.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_id", F.when(F.col("form_id").isNotNull(), F.col("best_n")).alias("form_n")), "spelling-linked")
        linked = w.where("form_id IS NOT NULL")
        roots = roots_of(linked, s)
        named = lambda name: words.select(F.col("id").alias(f"{name}_id"), F.col("word").alias(name))
        with_form = merge_join(merge_join(linked, roots, "id"), named("form"), "form_id")
        with_root = merge_join(with_form, named("root"), "root_id").select("word", "form", "root", "n", "n_near", "form_n")
        rest = w.where("form_id IS NULL").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
        return s.result(with_root.unionByName(rest), "spelling")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling_variants(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


#: crc32 has no function in DuckDB: the usual table of 256 remainders, folded over the bytes of UTF-8.
CRC_SQL = """crc_steps(b, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM crc_steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS tab FROM crc_steps WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """The unsigned crc32 of text in code points below U+0800, within a query that joins ``crc``."""
    code = f"list_transform(string_split({text}, ''), lambda x: unicode(x))"
    octets = f"flatten(list_transform({code}, lambda x: CASE WHEN x < 128 THEN [x::BIGINT] ELSE [(192 + x // 64)::BIGINT, (128 + x % 64)::BIGINT] END))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda a, b: xor(tab[xor(a & 255, b) + 1], a >> 8)))"


OP11_SQL = f"""
WITH RECURSIVE {CRC_SQL},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{6,}}')), '{UPPER}', '{LOWER}') AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY 1, 2),
h AS (SELECT run, n, {crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM g, crc),
c AS (SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM c WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
s AS (SELECT word, n, unnest(range(length(word))) AS i FROM w),
k AS (SELECT word, n, i, word[:i] AS a, word[i + 2:] AS b FROM s),
p AS (SELECT DISTINCT x.word, y.word AS other FROM k x JOIN k y USING (i, a, b) WHERE x.word <> y.word
  UNION SELECT k.word, v.word FROM k JOIN w v ON v.word = k.a || k.b
  UNION SELECT v.word, k.word FROM k JOIN w v ON v.word = k.a || k.b),
b AS (SELECT p.word, count(*) AS n_near, max(o.n) AS most FROM p JOIN w o ON o.word = p.other GROUP BY p.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= 5 * w.n THEN most END AS form_n,
  CASE WHEN most >= 5 * w.n THEN (SELECT min(o.word) FROM p JOIN w o ON o.word = p.other WHERE p.word = w.word AND o.n = most) END AS form FROM w LEFT JOIN b USING (word)),
t(word, root) AS (SELECT word, word FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL)
SELECT word, form, t.root, n, n_near, form_n::BIGINT AS form_n FROM f JOIN t USING (word) WHERE t.root IN (SELECT word FROM f WHERE form IS NULL)
"""
