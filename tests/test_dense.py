"""Dense score lines, tokens cut as bytes and counted pairs, each against the plain way."""

from __future__ import annotations

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.batches import cuts
from corpusloom.operators import prepare as R
from corpusloom.operators import score as S
from corpusloom.runtime import new_dir
from corpusloom.sources import text as X

ODD = ["a", "", None, " \t\n\r\f", "ärger é ñandú 日本 語 \U0001f600x x\U0001f600 \U0001f600", "a\x0bb c d e　f", "\n one\r\ntwo\x0cthree  four ", "naïve é ퟿ ", "x" * 300 + " y", "Ω"]


def plain_pairs(docs):
    return docs.select(F.explode(S.pairs_of(F.col("tokens"))).alias("p")).groupBy("p.ctx", "p.token").agg(F.count(F.lit(1)).alias("n"))


def test_tokens_cut_as_bytes_are_those_of_the_words(spark, monkeypatch):
    rows = [(k, t, None if k % 5 == 4 else f"s{k % 3}") for k, t in enumerate(ODD * 3)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(2)
    want = sorted(map(str, R.word_docs(d).select("shard_id", "doc_id", "tokens").collect()))
    for most in (R.TEXT_BYTES, 7):  # slices of many texts, and of about one
        monkeypatch.setattr(R, "TEXT_BYTES", most)
        assert sorted(map(str, R.token_docs(d).collect())) == want
    assert len(want) == 21 and R.token_docs(d.limit(0)).count() == 0


def test_slices_hold_all_rows_in_order():
    for sizes in ([], [0, 0], [5], [3, 3, 3, 9, 0, 1], [0, 100, 0, 1]):
        got = list(cuts(np.array(sizes, np.int64), 6))
        assert [k for i, j in got for k in range(i, j)] == list(range(len(sizes)))
        assert all(sum(sizes[i : j - 1]) < 6 for i, j in got)


@pytest.mark.parametrize("kind", ["bigint", "int"])
def test_pairs_are_counted_as_if_exploded(spark, kind):
    rows = [([1, 2, 1, 2, 2047],), ([],), (None,), ([7],), ([2048, 1, 2, 3],), ([-1, 2, -1, 2],), ([5, None, None, 5],), ([1, 2],), ([2**31 - 1] * 3,)]
    d = spark.createDataFrame(rows * 2, f"tokens array<{kind}>").repartition(3)
    for one in (d, d.where("size(tokens) = 2 or size(tokens) = 5"), d.limit(0)):
        got = S.bigram_counts(one)
        assert sorted(map(str, got.collect())) == sorted(map(str, plain_pairs(one).collect())) and got.dtypes == plain_pairs(one).dtypes


def test_dense_lines_are_those_of_taught_documents(spark, monkeypatch):
    rows = [("s", k, [(k * j * j) % 11 for j in range(k)]) for k in range(1, 30)] + [("s", 40, []), ("s", 41, None), ("s", 42, [3]), ("s", 43, [99, 3, 99, 5, 4])]
    w = spark.createDataFrame(rows, "shard_id string, doc_id bigint, tokens array<bigint>").repartition(2)
    rare = spark.createDataFrame([(12, 9, [1, 2], [1.0, 1e-12], 0.0), (5, 9, [4], [1 / 3], 2 / 3)], "ctx bigint, total bigint, topk_idx array<bigint>, topk_p array<double>, tail double")
    t = S.bigram_teacher(w.where("doc_id < 40"), 3).where("ctx not in (5, 12)").union(rare)
    taught = S.teach(w, t)
    plain = new_dir(spark, "dense-plain")
    taught.select(F.col("doc_id").cast("string").alias("doc_id"), "tokens", "topk_idx", F.transform("topk_w", lambda v: F.transform(v, lambda x: F.log(x).cast("float"))).alias("topk_logprobs"), "loss_mask").write.json(plain)
    want = sorted(map(str, X.read_dense_json(spark, plain).where("tokens is not null").collect()))
    assert len(want) == len(rows) - 1
    monkeypatch.setattr(X, "LINE_TOKENS", 20)
    monkeypatch.setattr(X, "FILE_DOCS", 4)
    path = new_dir(spark, "dense-test")
    X.write_dense_json(w, t, path)
    got = X.read_dense_json(spark, path)
    assert sorted(map(str, got.where("tokens is not null").collect())) == want and got.count() == len(rows)
    assert got.where("tokens is null").first()["doc_id"] == "41"
    files = glob.glob(path.removeprefix("file://") + "/part-*")
    assert len(files) >= len(rows) / 4 and all(f.endswith(".lz4") for f in files)
    path = new_dir(spark, "dense-joined")
    X.dense_lines(w, t, most=0).write.text(path)
    joined = X.read_dense_json(spark, path)
    assert sorted(map(str, joined.where("tokens is not null").collect())) == want and joined.count() == len(rows)
    # texts of a teacher without rows, and a document without an id
    none = X.dense_lines(w.where("doc_id = 42").withColumn("doc_id", F.lit(None).cast("bigint")), t.limit(0)).first()["value"]
    assert none == '{"doc_id":null,"tokens":[3],"topk_idx":[[]],"topk_logprobs":[[]],"loss_mask":[0]}'
