"""Rounding, hashing and array functions against NumPy and Python integers."""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import functions as F

from corpusloom.functions import arrays as A
from corpusloom.functions import hashing as H
from corpusloom.operators import address as D


def test_half_precision(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=500), 10.0 ** rng.uniform(-9, 4, 500), [0.0, 6e-8, 2.0**-14, 1.0]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", A.fp16(F.col("x")).alias("h"))
    for r in df.collect():
        assert r["h"] == float(np.float16(r["x"]))


def test_mul64_and_unsigned_modulus(spark):
    rng = np.random.default_rng(2)
    a = [int(v) for v in rng.integers(-(1 << 63), 1 << 63, 300)] + [0, -1, 1, -(1 << 63)]
    by = H.multiplier(2, 0)
    df = spark.createDataFrame([(v,) for v in a], "a bigint").select("a", H.mul64(F.col("a"), by).alias("m"), H.umod(F.col("a"), 4093).alias("u"))
    for r in df.collect():
        assert r["m"] == H.signed((r["a"] & H.MASK) * by)
        assert r["u"] == (r["a"] & H.MASK) % 4093


def test_ngram_address_equals_integers_and_order_matters(spark):
    def plain(ids, order, head, m):
        s = H.const64(order, head, "seed")
        for x in ids:
            s = ((s ^ ((x + H.GOLD) & H.MASK)) * H.multiplier(order, head)) & H.MASK
        return s % m

    rows = [(i, (i * 7) % 50, (i * 13) % 50) for i in range(60)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, c bigint")
    got = df.select("a", "b", "c", D.ngram_address([F.col(x) for x in "abc"], 3, 1, 4073).alias("x"), D.ngram_address([F.col(x) for x in "cba"], 3, 1, 4073).alias("y")).collect()
    assert all(r["x"] == plain([r["a"], r["b"], r["c"]], 3, 1, 4073) for r in got)
    assert any(r["x"] != r["y"] for r in got)


def test_unigram_address_is_one_to_one(spark):
    m = H.smallest_prime_at_least(1024)
    assert m == 1031
    df = spark.range(1024).select(D.unigram_address(F.col("id"), 0, m).alias("a"))
    assert df.distinct().count() == 1024


def test_canon_string_and_map(spark):
    rows = [(0, "Apple"), (1, "apple"), (2, "Ａpple"), (3, "ß"), (4, "ss"), (5, ""), (6, None)]
    v = spark.createDataFrame(rows, "token_id bigint, text string").withColumn("c", A.canon_string(F.col("text")))
    got = {r["token_id"]: (r["c"], r["canon_id"]) for r in D.canon_map(v, F.col("c")).collect()}
    assert got[2] == ("apple", 0) and got[1][1] == 0 and got[4][1] == 3 and got[6][0] is None
    assert all(c is None or c == unicodedata.normalize("NFKC", rows[i][1]).casefold() for i, (c, _) in got.items())


def test_int8_blocks_round_trip(spark):
    x = [float(v) for v in np.random.default_rng(3).normal(size=40)]
    df = spark.createDataFrame([(x,), ([],), (None,)], "v array<double>").select("v", A.int8_blocks(F.col("v"), 16).alias("b"))
    r, empty, null = df.select("b", A.dequantize(F.col("b")).alias("d")).collect()
    assert [len(b["q"]) for b in r["b"]] == [16, 16, 8]
    assert max(abs(a - b) for a, b in zip(x, r["d"])) < max(map(abs, x)) / 127
    assert empty["b"] is None and null["b"] is None


def test_softmax_and_tail(spark):
    r = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>").select(A.temp_softmax(F.col("v"), 2.0).alias("p"), A.tail_mass(F.array(F.lit(0.7), F.lit(0.2))).alias("t"), A.tail_mass(F.array(F.lit(0.9), F.lit(0.2))).alias("z")).first()
    e = np.exp(np.array([1, 2, 3]) / 2)
    assert np.allclose(r["p"], e / e.sum()) and abs(r["t"] - 0.1) < 1e-12 and r["z"] == 0
