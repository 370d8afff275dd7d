"""Queries over sources, sinks, contracts, projections, packing and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import arrays as A
from corpusloom.operators import metrics as M
from corpusloom.operators import pack as P
from corpusloom.operators import scan as SC
from corpusloom.operators import score as S
from corpusloom.operators import sizing as Z
from corpusloom.operators import validate as V
from corpusloom.operators.prepare import VOCAB, token_docs, word_docs
from corpusloom.plans.registry import query
from corpusloom.plans.sql import OFFSETS, PLACED, SHARD, half
from corpusloom.runtime import Scratch, materialize, merge_join, new_dir, spread, table
from corpusloom.sources import convert as CV
from corpusloom.sources import npz as N
from corpusloom.sources import shards as H
from corpusloom.sources import text as X
from corpusloom.streaming import ema as SE
from corpusloom.streaming import ingest as SI

c, K, L = F.col, 4, 64
WD_SQL_ONLY = OFFSETS.rsplit(",\nod AS", 1)[0]


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    """Word documents, written once for a query that looks at them several times."""
    return materialize(token_docs(spread(table(spark, d, "documents"))), "word-docs")


def taught(spark: SparkSession, d: str) -> DataFrame:
    w = docs_of(spark, d)
    return S.teach(w, S.bigram_teacher(w, K))


def teaching(docs: DataFrame):
    """What teaches documents row by row, with the bigrams of ``docs``."""
    teacher = S.bigram_teacher(docs, K)
    return lambda dealt: S.teach(dealt, teacher)


def written_shards(spark: SparkSession, d: str, manifest=None) -> str:
    """The taught documents as shards with their manifest; tokens are dealt first and taught where they are written."""
    path, w = new_dir(spark, "shards"), docs_of(spark, d)
    H.write_shards(w, manifest or manifest_of, path, fill=teaching(w))
    return path


def manifest_of(shards: DataFrame, offsets: bool = False) -> DataFrame:
    """A manifest with provenance that depends on the shard's name, for the queries on it."""
    odd = F.ascii(F.substring("shard_id", -1, 1)) % 2 == 1
    return H.shard_manifest(shards, VOCAB, offsets, teacher_id="bigram", text_source="documents", fold_version=F.when(odd, "v1").otherwise("v2"), data_class=F.when(odd, "b").otherwise("a"), alpha_override=F.when(odd, 0.5))


MANIFEST_SQL = OFFSETS + """,
mf AS (SELECT shard_id, sum(len)::BIGINT AS total_tokens, count(*) AS num_documents, list(off ORDER BY local_doc) AS doc_offsets, list(len::BIGINT ORDER BY local_doc) AS doc_lengths,
  CASE WHEN unicode(shard_id[-1]) % 2 = 1 THEN 'v1' ELSE 'v2' END AS fold_version, CASE WHEN unicode(shard_id[-1]) % 2 = 1 THEN 'b' ELSE 'a' END AS data_class,
  CASE WHEN unicode(shard_id[-1]) % 2 = 1 THEN 0.5::DOUBLE END AS alpha_override FROM od GROUP BY shard_id)"""


# sources and sinks

@query("jsonl_source")
def jsonl_source(spark, d):
    path, w = new_dir(spark, "dense"), docs_of(spark, d)
    X.write_dense_json(w, S.bigram_teacher(w, K), path)
    return X.read_dense_json(spark, path).select("doc_id", F.size("tokens").alias("n"), F.aggregate("tokens", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("token_sum"), F.aggregate("topk_idx", F.lit(0), lambda s, x: s + F.size(x)).alias("candidates"))


JSONL_SQL = SHARD + "SELECT doc_id::VARCHAR AS doc_id, any_value(len)::INT AS n, sum(token)::BIGINT AS token_sum, sum(CASE WHEN lit THEN len(idx) ELSE 0 END)::INT AS candidates FROM sh GROUP BY doc_id"
query.sql("jsonl_source", "WITH " + JSONL_SQL)


@query("text_source", r"""SELECT len(w)::INT AS n_words, count(*) AS docs FROM (SELECT list_filter(string_split_regex(l, '[ \t\n\r\f]+'), lambda x: x <> '') AS w
  FROM (SELECT unnest(string_split_regex(text, '\r\n|\n|\r')) AS l FROM documents)) WHERE len(w) >= 2 GROUP BY 1""")
def text_source(spark, d):
    path = new_dir(spark, "text")
    table(spark, d, "documents").select("text").where("text IS NOT NULL").write.text(path)
    return X.read_text_corpus(spark, path).groupBy(F.size("words").alias("n_words")).agg(F.count(F.lit(1)).alias("docs"))


def bulk_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A bulk table from word documents: a file for each source and 64 documents, a chunk for each document.

    Row t predicts token t itself: slot 0 is the token, and the first row of a document is masked. The
    probabilities are the same for all positions, so no teacher is counted.
    """
    # tokens lie below VOCAB: they are dealt as integers, a file's documents together, as its bundle needs them
    file = F.concat("shard_id", F.lit("-"), F.expr("doc_id div 640"), F.lit(".npz")).alias("file")
    t = docs_of(spark, d).select(file, "doc_id", c("tokens").cast("array<int>").alias("tokens"))
    order = Window.partitionBy("file").orderBy("doc_id", "length")
    place = {"chunk": F.row_number().over(order) - 1, "start": F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")}
    sized = t.withColumn("length", F.size("tokens").cast("bigint"))
    off = sized.drop("tokens").withColumns(place)
    p = sized.withColumns(place).select("file", "chunk", "start", F.posexplode("tokens").alias("i", "token"))
    on = c("i") > 0
    ids = F.when(on, F.array(c("token"), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(-1), F.lit(0), F.lit(0)))
    probs = F.when(on, F.array(F.lit(0.5), F.lit(0.25), F.lit(0.125))).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).cast("array<float>")
    bulk = p.select("file", "chunk", (c("start") + c("i")).alias("pos"), c("token").cast("bigint").alias("token"), ids.alias("teacher_ids"), probs.alias("teacher_probs"), on.cast("tinyint").alias("loss_mask"))
    return bulk, off.select("file", "chunk", "start", "length")


def written_bundles(spark: SparkSession, d: str, alter=None) -> str:
    """The bulk table as bundles; what they are made from goes when they are written."""
    path = new_dir(spark, "npz")
    with Scratch(spark, owns=True):
        bulk, chunks = bulk_of(spark, d)
        materialize(N.write_npz(bulk.drop("chunk"), chunks, path, alter), "npz-written")
    return path


def odd_arrays(name: str, arrays: dict) -> dict:
    """Bundles with another type, without an array or with another shape, by the file's name."""
    kind = ord(name[3]) % 4
    if kind == 1:
        arrays["teacher_probs"] = arrays["teacher_probs"].astype("float64")
    elif kind == 2:
        del arrays["loss_mask"]
    elif kind == 3:
        arrays["tokens"], arrays["loss_mask"] = arrays["tokens"].repeat([2] + [1] * (len(arrays["tokens"]) - 1)), arrays["loss_mask"].astype("int32")
    return arrays


FILES_SQL = WD_SQL_ONLY + """, bf AS (SELECT shard_id || '-' || (doc_id // 640) || '.npz' AS file, doc_id, tokens FROM wd)"""


@query("npz_source", "WITH " + FILES_SQL + " SELECT file, sum(len(tokens))::BIGINT AS positions, sum(list_sum(tokens))::BIGINT AS token_sum, sum(len(tokens) - 1)::BIGINT AS unmasked FROM bf GROUP BY file")
def npz_source(spark, d):
    return N.read_npz(spark, written_bundles(spark, d)).groupBy("file").agg(F.count(F.lit(1)).alias("positions"), F.sum("token").alias("token_sum"), F.sum("loss_mask").alias("unmasked"))


@query("npz_headers", "WITH " + FILES_SQL + """, f AS (SELECT file, sum(len(tokens))::BIGINT AS n, count(*) AS chunks FROM bf GROUP BY file)
SELECT file, CASE unicode(file[4]) % 4 WHEN 1 THEN ['teacher_probs is <f8, not <f4'] WHEN 2 THEN ['missing loss_mask'] WHEN 3 THEN ['teacher_ids has shape [' || n || ', 3]', 'teacher_probs has shape [' || n || ', 3]', 'loss_mask is <i4, not |u1', 'loss_mask has shape [' || n || ']'] ELSE [] END AS faults FROM f""")
def npz_headers(spark, d):
    return N.bundle_faults(N.read_npz_headers(spark, written_bundles(spark, d, odd_arrays)))


@query("shard_open", "WITH " + SHARD + " SELECT shard_id, count(DISTINCT doc_id) AS docs, count(*) AS tokens, 4 AS k FROM sh GROUP BY shard_id")
def shard_open(spark, d):
    path = written_shards(spark, d)
    return H.open_shards(spark, path).groupBy("shard_id").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("tokens")).alias("tokens"), F.max("manifest_k").alias("k"))


@query("shard_union", "WITH " + SHARD + " SELECT shard_id, sum(CASE WHEN lit THEN least(len(idx), CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 2 END) ELSE 0 END)::BIGINT AS candidates FROM sh GROUP BY shard_id")
def shard_union(spark, d):
    w = docs_of(spark, d)
    two, fill = lambda x: F.slice(x, 1, 2), teaching(w)
    narrow = lambda dealt: fill(dealt).withColumns({n: F.transform(n, two) for n in ("topk_idx", "topk_w")})
    paths = new_dir(spark, "shards"), new_dir(spark, "shards")
    for k, path in enumerate(paths):
        H.write_shards(w.where(f"doc_id % 2 = {k}"), manifest_of, path, fill=narrow if k else fill)
    return H.open_shards(spark, *paths).groupBy("shard_id").agg(F.sum(F.size(F.flatten("topk_idx"))).alias("candidates"))


@query("shard_roundtrip", "WITH " + SHARD + ", f AS (SELECT shard_id, doc_id, pos, token, lit, tail, CASE WHEN lit THEN list_sum(list_transform(p, lambda x: " + half("x") + ")) ELSE 0 END AS w FROM sh) SELECT shard_id, doc_id, count(*)::INT AS n, sum(token * (pos + 1))::BIGINT AS token_check, sum(lit::INT)::BIGINT AS unmasked, round(sum(w), 6) AS w FROM f GROUP BY shard_id, doc_id")
def shard_roundtrip(spark, d):
    path = written_shards(spark, d)
    check = F.aggregate(F.transform("tokens", lambda x, i: x * (i + 1)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    mask = F.aggregate("loss_mask", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return H.read_shards(spark, path).select("shard_id", "doc_id", F.size("tokens").alias("n"), check.alias("token_check"), mask.alias("unmasked"), F.round(A.asum(F.flatten("topk_w")), 6).alias("w"))


@query("shard_manifest", "WITH " + MANIFEST_SQL + " SELECT shard_id, total_tokens, num_documents, doc_offsets, doc_lengths, fold_version, data_class, alpha_override FROM mf")
def shard_manifest(spark, d):
    return manifest_of(taught(spark, d), offsets=True).select("shard_id", "total_tokens", "num_documents", "doc_offsets", "doc_lengths", "fold_version", "data_class", "alpha_override")


@query("window_read", "WITH " + PLACED + f" SELECT shard_id, gpos // {L} AS window_id, list(token ORDER BY gpos) AS tokens, list(local_doc ORDER BY gpos) AS doc_ids FROM pl WHERE (gpos // {L} + 1) * {L} <= total AND gpos // {L} % 5 = 2 GROUP BY 1, 2")
def window_read(spark, d):
    path = written_shards(spark, d)
    fifth = H.all_windows(spark, path, L).where("window_id % 5 = 2")
    return H.read_windows(spark, path, fifth, L).select("shard_id", "window_id", "tokens", "doc_ids")


@query("manifest_scan", "WITH " + MANIFEST_SQL + " SELECT shard_id, total_tokens, num_documents, fold_version FROM mf")
def manifest_scan(spark, d):
    path = written_shards(spark, d)
    return H.read_manifests(spark, path).select("shard_id", "total_tokens", "num_documents", "fold_version")


@query("bulk_pending", "WITH " + FILES_SQL + ", b AS (SELECT DISTINCT file, unicode(file[4]) % 2 = 1 AS done FROM bf) SELECT CASE WHEN done THEN 'skipped' ELSE 'pending' END AS state, count(*) AS files FROM b GROUP BY 1")
def bulk_pending(spark, d):
    files = bulk_of(spark, d)[1].select("file").distinct()
    done = files.where(F.ascii(F.substring("file", 4, 1)) % 2 == 1)
    left = H.pending(files, done, "file").select(F.lit("pending").alias("state"))
    return left.union(done.select(F.lit("skipped").alias("state"))).groupBy("state").agg(F.count(F.lit(1)).alias("files"))


@query("bulk_convert", "WITH " + FILES_SQL + """, f AS (SELECT file, count(*) AS docs, sum(len(tokens))::BIGINT AS tokens, sum(list_sum(tokens[2:]))::BIGINT AS gold, unicode(file[4]) % 4 AS k FROM bf GROUP BY file)
SELECT file, CASE WHEN k = 0 THEN 'skipped' ELSE 'rejected' END AS state, CASE WHEN k = 0 THEN docs END AS docs, CASE WHEN k = 0 THEN tokens END AS tokens, CASE WHEN k = 0 THEN coalesce(gold, 0) END AS gold_sum FROM f""")
def bulk_convert(spark, d):
    path, out = written_bundles(spark, d, odd_arrays), new_dir(spark, "converted")
    CV.bulk_convert(spark, path, out, VOCAB, files_per_batch=3)
    report = CV.bulk_convert(spark, path, out, VOCAB).select("file", "state", "shard_id")  # what was converted is left alone
    if not CV.committed(spark, out):
        return report.select("file", "state", *[F.lit(None).cast("bigint").alias(n) for n in ("docs", "tokens", "gold_sum")])
    gold = F.aggregate(F.filter("topk_idx", lambda x: F.size(x) > 0), F.lit(0).cast("bigint"), lambda s, x: s + x[0])
    per = H.open_shards(spark, out).groupBy("shard_id").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("tokens")).cast("bigint").alias("tokens"), F.sum(gold).alias("gold_sum"))
    return merge_join(report, per, "shard_id", "left").select("file", "state", "docs", "tokens", "gold_sum")


@query("size_shards", """WITH RECURSIVE o AS (SELECT source AS shard_id, doc_id, strlen(text)::BIGINT AS bytes, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
g AS (SELECT shard_id, doc_id, bytes, r, bytes AS size, 0::BIGINT AS file_no FROM o WHERE r = 1
UNION ALL SELECT o.shard_id, o.doc_id, o.bytes, o.r, CASE WHEN g.size > 0 AND g.size + o.bytes > 100000 THEN o.bytes ELSE g.size + o.bytes END, CASE WHEN g.size > 0 AND g.size + o.bytes > 100000 THEN g.file_no + 1 ELSE g.file_no END FROM g JOIN o ON o.shard_id = g.shard_id AND o.r = g.r + 1)
SELECT shard_id, doc_id, bytes, file_no FROM g""")
def size_shards(spark, d):
    return Z.assign_files(table(spark, d, "documents").select(c("source").alias("shard_id"), "doc_id", F.octet_length("text").cast("bigint").alias("bytes")), 100_000)


@query("npy_export", "WITH " + OFFSETS + " SELECT shard_id, count(*) AS n_docs, sum(len)::BIGINT AS n_tokens FROM od GROUP BY shard_id")
def npy_export(spark, d):
    parts = materialize(N.export_npy(taught(spark, d), new_dir(spark, "npy"), 4096), "npy-written")
    return parts.groupBy("shard_id").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


# contracts

@query("validate_docs", "WITH " + SHARD + """, v AS (SELECT doc_id, max(token >= 900 OR coalesce(lit AND list_bool_or(list_transform(idx, lambda x: x >= 900)), false)) AS bad FROM sh GROUP BY doc_id)
SELECT CASE WHEN bad THEN 'vocab' ELSE '' END AS reasons, count(*) AS docs FROM v GROUP BY 1""")
def validate_docs(spark, d):
    t = taught(spark, d).withColumnRenamed("topk_w", "topk_p")
    return t.select(F.array_join(V.document_reasons(900), ",").alias("reasons")).groupBy("reasons").agg(F.count(F.lit(1)).alias("docs"))


@query("validate_dense", "WITH " + SHARD + """, v AS (SELECT doc_id, max(NOT lit OR len(idx) <> 4) AS bad FROM sh GROUP BY doc_id) SELECT CASE WHEN bad THEN 'dense' ELSE '' END AS reasons, count(*) AS docs FROM v GROUP BY 1""")
def validate_dense(spark, d):
    t = taught(spark, d).withColumn("topk_logprobs", F.transform("topk_w", lambda w: F.transform(w, lambda x: F.log(x.cast("double")))))
    return t.select(F.array_join(V.dense_reasons(K), ",").alias("reasons")).groupBy("reasons").agg(F.count(F.lit(1)).alias("docs"))


@query("validate_bulk", "WITH " + FILES_SQL + ", u AS (SELECT file, unnest(tokens) AS token FROM bf) SELECT file, count(*) FILTER (WHERE token % 7 NOT IN (3, 4, 5)) AS rows_ok, count(*) FILTER (WHERE token % 7 IN (3, 4, 5)) AS rows_bad FROM u GROUP BY file")
def validate_bulk(spark, d):
    # a missing candidate, no probabilities, a mask that is neither 0 nor 1
    fault = lambda k: c("token") % 7 == k
    bulk = bulk_of(spark, d)[0].withColumns({"teacher_ids": F.when(fault(3), F.slice("teacher_ids", 1, 2)).otherwise(c("teacher_ids")), "teacher_probs": F.when(~fault(4), c("teacher_probs")), "loss_mask": F.when(fault(5), F.lit(2)).otherwise(c("loss_mask"))})
    rows = bulk.withColumn("r", V.bulk_reasons(3))
    return rows.groupBy("file").agg(F.sum((F.size("r") == 0).cast("bigint")).alias("rows_ok"), F.sum((F.size("r") > 0).cast("bigint")).alias("rows_bad"))


@query("chunk_tiling", "WITH " + FILES_SQL + ", s AS (SELECT file, doc_id, row_number() OVER (PARTITION BY file ORDER BY doc_id) - 1 AS chunk FROM bf) SELECT file, CASE WHEN file LIKE '%1.npz' THEN 1 WHEN file LIKE '%2.npz' THEN sum(CASE WHEN chunk % 5 = 4 THEN 1 ELSE 0 END) + 1 ELSE sum(CASE WHEN chunk % 5 = 4 THEN 1 ELSE 0 END) END::BIGINT AS faults FROM s GROUP BY file")
def chunk_tiling(spark, d):
    bulk, chunks = bulk_of(spark, d)
    totals = bulk.groupBy("file").agg(F.count(F.lit(1)).alias("total"))
    moved = chunks.withColumn("start", F.when(c("chunk") % 5 == 4, c("start") + 1).otherwise(c("start")))
    # some files have lost all their chunks, others all their positions
    return V.chunk_tiling(moved.where("file NOT LIKE '%1.npz'"), totals.where("file NOT LIKE '%2.npz'"))


@query("gold_slot", "WITH " + FILES_SQL + ", u AS (SELECT file, unnest(range(len(tokens))) AS i, unnest(tokens) AS token FROM bf) SELECT file, count(*) AS wrong FROM u WHERE i > 0 AND token % 7 = 3 GROUP BY file")
def gold_slot(spark, d):
    bulk = bulk_of(spark, d)[0]
    wrong = bulk.withColumn("teacher_ids", F.when(c("token") % 7 == 3, F.transform("teacher_ids", lambda x: x + 1)).otherwise(c("teacher_ids")))
    return V.gold_slot(wrong).groupBy("file").agg(F.count(F.lit(1)).alias("wrong"))


@query("shard_reconcile", "WITH " + SHARD + """, ks AS (SELECT shard_id, max(CASE WHEN lit THEN len(idx) ELSE 0 END)::INT AS k FROM sh GROUP BY shard_id),
dc AS (SELECT shard_id, doc_id, any_value(k) AS k, count(*) AS len, doc_id % 5 = 3 OR bool_or(lit AND len(idx) <> k) AS bad FROM sh JOIN ks USING (shard_id) GROUP BY shard_id, doc_id)
SELECT shard_id, sum(len)::BIGINT AS tokens_stored, count(*) AS docs_stored, any_value(k) AS k_stored, count(*) FILTER (WHERE bad) AS docs_faulty, sum(len)::BIGINT + (unicode(shard_id[-1]) % 2)::INT AS total_tokens, count(*) AS num_documents, any_value(k) AS k_stated, unicode(shard_id[-1]) % 2 = 0 AND NOT bool_or(bad) AS ok FROM dc GROUP BY shard_id""")
def shard_reconcile(spark, d):
    t = materialize(taught(spark, d), "taught")
    m = manifest_of(t).withColumn("total_tokens", c("total_tokens") + (c("data_class") == "b").cast("bigint"))
    short = t.withColumn("tail_w", F.when(c("doc_id") % 5 == 3, F.slice("tail_w", 2, F.size("tail_w"))).otherwise(c("tail_w")))
    return V.shard_reconcile(short, m)


@query("mass_invariant", "WITH " + SHARD + ", f AS (SELECT shard_id, CASE WHEN lit THEN abs(list_sum(list_transform(p, lambda x: " + half("x") + ")) + tail::FLOAT::DOUBLE - 1) ELSE 0 END AS gap FROM sh) SELECT shard_id, count(*) AS positions, sum((gap > 0.001)::INT)::BIGINT AS violations, round(max(gap), 7) AS worst FROM f GROUP BY shard_id")
def mass_invariant(spark, d):
    return V.mass_invariant(taught(spark, d)).withColumn("worst", F.round("worst", 7))


@query("single_k", "WITH " + SHARD + " SELECT shard_id, count(DISTINCT len(idx)) AS n_k, max(len(idx))::INT AS k FROM sh WHERE lit GROUP BY shard_id")
def single_k(spark, d):
    return V.single_k(taught(spark, d))


@query("fold_lint", "WITH " + MANIFEST_SQL + " SELECT shard_id, alpha_override AS alpha FROM mf WHERE fold_version = 'v1'")
def fold_lint(spark, d):
    return V.fold_lint(manifest_of(taught(spark, d)), 1.0)


@query("reconcile", """SELECT coalesce(a.k, b.k) AS name, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'matched' WHEN b.k IS NULL THEN 'unused' WHEN regexp_matches(b.k, '7$') THEN 'allowed-new' ELSE 'unfilled' END AS status
FROM (SELECT DISTINCT p_brand || p_partkey % 50 AS k FROM part) a FULL JOIN (SELECT DISTINCT p_brand || (p_partkey + 3) % 53 AS k FROM part) b USING (k)""")
def reconcile(spark, d):
    p = table(spark, d, "part")
    name = lambda n: F.concat("p_brand", n.cast("string")).alias("name")
    return V.reconcile(p.select(name(c("p_partkey") % 50)), p.select(name((c("p_partkey") + 3) % 53)), "name", "7$")


# projections

@query("lp_to_prob", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: exp(-abs(x::DOUBLE)))), 6) AS s FROM embeddings")
def lp_to_prob(spark, d):
    lp = F.transform("embedding", lambda x: -F.abs(x))
    return table(spark, d, "embeddings").select("vec_id", F.round(A.asum(A.lp_to_prob(lp)), 6).alias("s"))


@query("tail_mass", "SELECT vec_id, round(greatest(0, least(1, 1 - list_sum(list_transform(embedding[1:8], lambda x: abs(x::DOUBLE))))), 6) AS tail FROM embeddings")
def tail_mass(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(A.tail_mass(F.transform(F.slice("embedding", 1, 8), F.abs)), 6).alias("tail"))


@query("fp16_round", "SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x = 0 THEN 0.0 ELSE sign(x::DOUBLE) * " + half("abs(x::DOUBLE)") + " END) AS h FROM embeddings")
def fp16_round(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", A.fp16).alias("h"))


@query("int8_blocks", """WITH b AS (SELECT vec_id, i, list_transform(embedding[i * 16 + 1 : i * 16 + 16], lambda x: x::DOUBLE) AS v FROM embeddings, range(4) t(i)),
s AS (SELECT *, greatest(list_max(list_transform(v, lambda x: abs(x))), 1e-12::DOUBLE) / 127 AS scale FROM b)
SELECT vec_id, i::INT AS block, round(scale, 9) AS scale, list_transform(v, lambda x: round_even(x / scale, 0)::INT) AS q FROM s""")
def int8_blocks(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(A.int8_blocks(c("embedding"), 16)).alias("block", "b"))
    return e.select("vec_id", "block", F.round("b.scale", 9).alias("scale"), c("b.q").alias("q"))


@query("gold_shift", "WITH " + WD_SQL_ONLY + " SELECT doc_id, list_concat(tokens[2:], tokens[1:1]) AS gold FROM wd")
def gold_shift(spark, d):
    return docs_of(spark, d).select("doc_id", A.gold_shift(c("tokens")).alias("gold"))


@query("truncate_docs", "WITH " + WD_SQL_ONLY + " SELECT doc_id, tokens[1:256] AS tokens FROM wd WHERE len(tokens) >= 2")
def truncate_docs(spark, d):
    return docs_of(spark, d).where(F.size("tokens") >= 2).select("doc_id", F.slice("tokens", 1, 256).alias("tokens"))


@query("last_mask", "WITH " + WD_SQL_ONLY + " SELECT doc_id, len(tokens)::INT AS n, len(tokens) - 1 AS unmasked FROM wd")
def last_mask(spark, d):
    return docs_of(spark, d).select("doc_id", F.size("tokens").alias("n"), F.aggregate(A.last_mask(c("tokens")), F.lit(0).cast("bigint"), lambda s, x: s + x).alias("unmasked"))


@query("slice_alpha", "WITH " + MANIFEST_SQL + f" SELECT shard_id, total_tokens // {L} AS windows, coalesce(alpha_override, 0.9::DOUBLE) AS alpha FROM mf WHERE total_tokens >= {L}")
def slice_alpha(spark, d):
    t = taught(spark, d)  # windows and the manifest's weights look at tokens only
    w = P.boundary_mask(t, L).select("shard_id", "window_id")
    return Z.slice_alpha(w, manifest_of(t), 0.9).groupBy("shard_id", "alpha").agg(F.count(F.lit(1)).alias("windows"))


@query("role_mask", r"""WITH t AS (SELECT conv_id, turn, role, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\f]+'), lambda w: w <> '') AS w FROM conversations)
SELECT conv_id, sum(len(w))::INT AS n, coalesce(sum(len(w)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS unmasked FROM t GROUP BY conv_id""")
def role_mask(spark, d):
    from corpusloom.operators.conversations import role_masks

    t = role_masks(table(spark, d, "conversations"))
    return t.select("conv_id", F.size("tokens").alias("n"), F.aggregate("loss_mask", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("unmasked"))


# packing

@query("npz_shift", "WITH " + FILES_SQL + " SELECT file, sum(len(tokens))::BIGINT AS positions, sum(len(tokens) - 1)::BIGINT AS unmasked, sum(list_sum(tokens[2:]))::BIGINT AS gold_sum FROM bf GROUP BY file")
def npz_shift(spark, d):
    s = P.shift_chunks(bulk_of(spark, d)[0])
    gold = F.when(c("loss_mask") == 1, F.get("topk_idx", F.lit(0)))
    return s.groupBy("file").agg(F.count(F.lit(1)).alias("positions"), F.sum("loss_mask").alias("unmasked"), F.sum(gold.cast("bigint")).alias("gold_sum"))


@query("doc_offsets", "WITH " + OFFSETS + " SELECT shard_id, doc_id, local_doc, len::BIGINT AS len, off AS \"offset\" FROM od")
def doc_offsets(spark, d):
    return P.doc_offsets(docs_of(spark, d))


@query("pack_windows", "WITH " + PLACED + f" SELECT shard_id, gpos // {L} AS window_id, list(token ORDER BY gpos) AS tokens, list(local_doc ORDER BY gpos) AS doc_ids FROM pl WHERE (gpos // {L} + 1) * {L} <= total GROUP BY 1, 2")
def pack_windows(spark, d):
    return P.pack_windows(docs_of(spark, d), L).select("shard_id", "window_id", "tokens", "doc_ids")


@query("loss_mask", "WITH " + PLACED + f" SELECT shard_id, gpos // {L} AS window_id, sum((pos < len - 1 AND gpos % {L} <> {L} - 1)::INT)::BIGINT AS loss_tokens FROM pl WHERE (gpos // {L} + 1) * {L} <= total GROUP BY 1, 2")
def loss_mask(spark, d):
    return P.boundary_mask(docs_of(spark, d), L)


@query("num_sequences", "WITH " + MANIFEST_SQL + f" SELECT sum(total_tokens // {L})::BIGINT AS sequences FROM mf")
def num_sequences(spark, d):
    return Z.num_sequences(manifest_of(taught(spark, d)), L)


def windows_of(spark: SparkSession, d: str) -> DataFrame:
    return P.boundary_mask(docs_of(spark, d), L)


@query("seeded_shuffle", "WITH " + PLACED + f" SELECT shard_id, window_id, loss_tokens, row_number() OVER (PARTITION BY shard_id ORDER BY md5('7|' || shard_id || '|' || window_id), window_id) - 1 AS place FROM (SELECT shard_id, gpos // {L} AS window_id, sum((pos < len - 1 AND gpos % {L} <> {L} - 1)::INT)::BIGINT AS loss_tokens FROM pl WHERE (gpos // {L} + 1) * {L} <= total GROUP BY 1, 2)")
def seeded_shuffle(spark, d):
    return P.shuffle_windows(windows_of(spark, d), 7)


STEPS_SQL = PLACED + f""",
wn AS (SELECT shard_id, total // {L} AS n FROM ot WHERE total >= {L}),
wi AS (SELECT shard_id, unnest(range(n)) AS window_id, coalesce(b, 0)::BIGINT AS base FROM (SELECT shard_id, n, sum(n) OVER (ORDER BY shard_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM wn)),
st AS (SELECT shard_id, window_id, base + window_id AS idx, (base + window_id) // 12 AS step, (base + window_id) % 12 // 4 AS micro FROM wi)"""


def steps_of(spark: SparkSession, d: str) -> DataFrame:
    return P.assign_steps(windows_of(spark, d).withColumn("place", c("window_id")), 4, 3)


@query("assign_steps", "WITH " + STEPS_SQL + " SELECT shard_id, window_id, idx, step, micro FROM st")
def assign_steps(spark, d):
    return steps_of(spark, d).select("shard_id", "window_id", "idx", "step", "micro")


@query("resume_cursor", "WITH " + STEPS_SQL + " SELECT shard_id, window_id, idx FROM st WHERE idx >= 1200 % (SELECT count(*) FROM st)")
def resume_cursor(spark, d):
    return P.resume_from(steps_of(spark, d), 100, 4, 3).select("shard_id", "window_id", "idx")


@query("token_ledger", "WITH " + STEPS_SQL + f""", lt AS (SELECT shard_id, gpos // {L} AS window_id, sum((pos < len - 1 AND gpos % {L} <> {L} - 1)::INT)::BIGINT AS loss_tokens FROM pl GROUP BY 1, 2),
e AS (SELECT step, count(*) * {L} AS tokens, sum(loss_tokens) AS loss_tokens FROM st JOIN lt USING (shard_id, window_id) GROUP BY step)
SELECT step, tokens, loss_tokens::BIGINT AS loss_tokens, sum(tokens) OVER (ORDER BY step)::BIGINT AS total_tokens, sum(loss_tokens) OVER (ORDER BY step)::BIGINT AS total_loss_tokens FROM e""")
def token_ledger(spark, d):
    per = steps_of(spark, d).groupBy("step").agg((F.count(F.lit(1)) * L).alias("tokens"), F.sum("loss_tokens").alias("loss_tokens"))
    return M.running_totals(per.withColumn("run", F.lit(0)), "run", "step", ["tokens", "loss_tokens"]).drop("run")


@query("interval_rate", "SELECT event_id, CASE WHEN lag(ts) OVER w IS NOT NULL THEN round(value / greatest(epoch(ts) - epoch(lag(ts) OVER w), 1e-6), 6) END AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def interval_rate(spark, d):
    e = table(spark, d, "events")
    r = M.interval_rate(e, "user_id", F.unix_micros(c("ts").cast("timestamp")) / 1e6, ["ts", "event_id"], c("value"))
    return r.select("event_id", F.round("rate", 6).alias("rate"))


@query("step_progress", """WITH RECURSIVE o AS (SELECT user_id, abs(value) * 0.371937::DOUBLE AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events),
g AS (SELECT user_id, r, n, x AS e FROM o WHERE r = 1 UNION ALL SELECT o.user_id, o.r, o.n, CASE WHEN o.r = 2 THEN o.x ELSE 0.9::DOUBLE * g.e + 0.1::DOUBLE * o.x END FROM g JOIN o ON o.user_id = g.user_id AND o.r = g.r + 1)
SELECT user_id, r AS step, round(100.0::DOUBLE * r / n, 6) AS percent, round(e * (n - r), 4) AS eta FROM g""")
def step_progress(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id")
    e = table(spark, d, "events").withColumns({"step": F.row_number().over(w.orderBy("ts", "event_id")).cast("bigint"), "steps": F.count(F.lit(1)).over(w), "seconds": F.abs("value") * 0.371937})
    p = M.step_progress(e, "user_id", "step", "steps", "seconds", reseed=True)
    return p.select("user_id", "step", F.round("percent", 6).alias("percent"), F.round("eta", 4).alias("eta"))


RUNNING_SQL = """WITH RECURSIVE o AS (SELECT user_id, event_id, CASE WHEN event_id % 11 <> 3 THEN value * 0.371937::DOUBLE END AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
g AS (SELECT user_id, event_id, r, x AS a, x AS b FROM o WHERE r = 1
UNION ALL SELECT o.user_id, o.event_id, o.r, CASE WHEN o.x IS NULL THEN g.a WHEN g.a IS NULL THEN o.x ELSE 0.99::DOUBLE * g.a + 0.01::DOUBLE * o.x END, CASE WHEN o.x IS NULL THEN g.b WHEN g.b IS NULL THEN o.x ELSE 0.999::DOUBLE * g.b + 0.001::DOUBLE * o.x END FROM g JOIN o ON o.user_id = g.user_id AND o.r = g.r + 1)
SELECT event_id, round(a, 6) AS slow, round(b, 6) AS slower FROM g"""


@query("running_average", RUNNING_SQL)
def running_average(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.when(c("event_id") % 11 != 3, c("value") * 0.371937).alias("x"))
    r = SC.running_average(e, "user_id", ["ts", "event_id"], "x", 0.99, out="slow")
    r = SC.running_average(r, "user_id", ["ts", "event_id"], "x", 0.999, out="slower")
    return r.select("event_id", F.round("slow", 6).alias("slow"), F.round("slower", 6).alias("slower"))


EMA_SQL = """WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
g AS (SELECT user_id, r, value AS e, value AS total FROM o WHERE r = 1 UNION ALL SELECT o.user_id, o.r, 0.9::DOUBLE * g.e + 0.1::DOUBLE * o.value, g.total + o.value FROM g JOIN o ON o.user_id = g.user_id AND o.r = g.r + 1)
SELECT user_id, r AS n, round(e, 6) AS ema{more} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r DESC) AS back FROM g) WHERE back = 1"""


@query("ema", EMA_SQL.format(more=""))
def ema(spark, d):
    return P.ema_by_key(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").withColumn("ema", F.round("ema", 6))


@query("first_n_docs", "WITH " + OFFSETS + " SELECT shard_id, doc_id FROM od WHERE local_doc < 3")
def first_n_docs(spark, d):
    return P.doc_offsets(docs_of(spark, d)).where(c("local_doc") < 3).select("shard_id", "doc_id")


@query("epoch_budget", "WITH " + MANIFEST_SQL + f" SELECT sum(total_tokens)::BIGINT AS tokens, sum(total_tokens // {L})::BIGINT AS windows, (sum(total_tokens // {L}) // 12)::BIGINT AS steps FROM mf")
def epoch_budget(spark, d):
    return Z.epoch_budget(manifest_of(taught(spark, d)), L, 4, 3)


@query("provenance", "WITH " + MANIFEST_SQL + " SELECT data_class, fold_version, count(*) AS shards, sum(num_documents)::BIGINT AS documents, sum(total_tokens)::BIGINT AS tokens FROM mf GROUP BY ALL")
def provenance(spark, d):
    return Z.provenance(manifest_of(taught(spark, d)), ["data_class", "fold_version"])


@query("parse_telemetry", "SELECT (event_id % 30)::BIGINT AS step, count(*) AS n, round(sum(round(value, 4)), 3) AS loss, min(date_trunc('second', ts)) AS first FROM events WHERE event_id % 10 <> 9 GROUP BY 1")
def parse_telemetry(spark, d):
    e = table(spark, d, "events")
    head = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] [INFO] "))
    line = F.format_string("step %d/30 (16.7%%) loss %.4f (ema 6.2) lr 3.00e-03", c("event_id") % 30, c("value"))
    lines = e.select(F.concat(head, F.when(c("event_id") % 10 == 9, F.lit("saved")).otherwise(line)).alias("value"))
    path = new_dir(spark, "log")
    lines.write.text(path)
    return M.parse_telemetry(spark.read.text(path)).groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("loss"), 3).alias("loss"), F.min("ts").alias("first"))


# streams

@query("stream_ingest", "WITH " + WD_SQL_ONLY + " SELECT shard_id, count(*) AS docs, sum(len(tokens))::BIGINT AS tokens FROM wd GROUP BY shard_id")
def stream_ingest(spark, d):
    landing, docs = new_dir(spark, "landing"), table(spark, d, "documents")
    docs.select("doc_id", "text", "source").write.parquet(landing)
    back = SI.ingest(spark, landing, "doc_id bigint, text string, source string", lambda b: word_docs(b).select("shard_id", "doc_id", "tokens"), new_dir(spark, "ingested"), new_dir(spark, "ingest-checkpoint"))
    return back.groupBy("shard_id").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("tokens")).alias("tokens"))


@query("stream_shards", "WITH " + WD_SQL_ONLY + " SELECT shard_id, count(*) AS docs, sum(len(tokens))::BIGINT AS tokens, sum(len(tokens))::BIGINT AS stated FROM wd GROUP BY shard_id")
def stream_shards(spark, d):
    landing, docs = new_dir(spark, "landing"), table(spark, d, "documents")
    docs.select("doc_id", "text", "source").write.parquet(landing)

    def convert(batch):
        return word_docs(batch).select("shard_id", "doc_id", "tokens")

    out = new_dir(spark, "stream-shards")
    paths = SI.ingest_shards(spark, landing, "doc_id bigint, text string, source string", convert, out, new_dir(spark, "ingest-checkpoint"), VOCAB, fill=teaching)
    got = H.open_shards(spark, *paths).groupBy("shard_id").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("tokens")).cast("bigint").alias("tokens"))
    return merge_join(got, H.read_manifests(spark, *paths).groupBy("shard_id").agg(F.sum("total_tokens").alias("stated")), "shard_id")


@query("stream_ema", EMA_SQL.format(more=", round(total, 3) AS total"))
def stream_ema(spark, d):
    landing, out = new_dir(spark, "events"), new_dir(spark, "ema")
    table(spark, d, "events").write.parquet(landing)
    stream = spark.readStream.schema(spark.read.parquet(landing).schema).parquet(landing)
    SI.run_available(SE.stream_ema(stream), out, new_dir(spark, "ema-checkpoint"))
    last = spark.read.parquet(out).where("late_id IS NULL").groupBy("user_id").agg(F.max_by(F.struct("n", "total", "ema"), "n").alias("s"))
    return last.select("user_id", c("s.n").alias("n"), F.round("s.ema", 6).alias("ema"), F.round("s.total", 3).alias("total"))


