"""Properties of the operators: boundaries, contracts, keyed updates, measures, sources and resumption."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusloom.functions import hashing as G
from corpusloom.operators import address as D
from corpusloom.operators import memory as Y
from corpusloom.operators import metrics as M
from corpusloom.operators import pack as P
from corpusloom.operators import score as S
from corpusloom.operators import sizing as Z
from corpusloom.operators import validate as V
from corpusloom.operators.prefix import ordered_sums
from corpusloom.runtime import new_dir
from corpusloom.sources import npz as N
from corpusloom.sources import shards as H
from corpusloom.sources import text as X
from corpusloom.streaming import ema as SE
from corpusloom.streaming import ingest as SI


def docs(spark, lengths, shard="s"):
    return spark.createDataFrame([(shard, i, list(range(100 * i, 100 * i + n))) for i, n in enumerate(lengths)], "shard_id string, doc_id bigint, tokens array<bigint>")


def test_windows_keep_order_and_mask_boundaries(spark):
    d = docs(spark, [10, 10])
    w = P.pack_windows(d, 16).collect()
    assert len(w) == 1 and w[0]["tokens"] == [*range(10), *range(100, 106)]
    assert [i for i, m in enumerate(w[0]["loss_mask"]) if not m] == [9, 15]
    assert P.boundary_mask(d, 16).first()["loss_tokens"] == sum(w[0]["loss_mask"])


def test_long_document_spans_windows(spark):
    w = sorted(P.pack_windows(docs(spark, [3, 40, 5]), 8).collect(), key=lambda r: r["window_id"])
    assert sum((r["tokens"] for r in w), []) == [*range(3), *range(100, 140), *range(200, 205)]


def test_shift_takes_the_next_row_within_a_chunk(spark):
    rows = [("f", 0, i, 10 + i, [10 + i, 1], [0.5, 0.25], int(i != 2)) for i in range(4)]
    b = spark.createDataFrame(rows, "file string, chunk int, pos bigint, token bigint, teacher_ids array<int>, teacher_probs array<float>, loss_mask tinyint")
    s = sorted(P.shift_chunks(b).collect(), key=lambda r: r["pos"])
    assert [r["loss_mask"] for r in s] == [1, 0, 1, 0]
    assert s[0]["topk_idx"] == [11, 1] and s[1]["topk_idx"] == [0, 0] and s[3]["topk_p"] == [0.0, 0.0]


def test_document_contract_names_reasons(spark):
    schema = "tokens array<bigint>, topk_idx array<array<bigint>>, topk_p array<array<double>>, loss_mask array<int>"
    rows = [([1, 2], [[1], [2]], [[0.5], [0.5]], [1, 0]), ([1], [[1, 2, 3]], [[0.4, 0.4, 0.4]], [1]), ([1, 2], [[1]], [[0.5]], [1, 1]), ([128256], [[1]], [[0.5]], [1]), ([1], [[1]], [[0.5]], [2]), ([], [], [], []), (None, None, None, None)]
    got = spark.createDataFrame(rows, schema).withColumn("reasons", V.document_reasons(128256))
    said = [r["reasons"] for r in got.collect()]
    assert said[0] == [] and said[1] == ["sum above 1"] and "shape" in said[2] and said[3] == ["vocab"] and said[4] == ["mask"] and "empty" in said[5] and said[6]
    good, bad = V.split(got)
    assert good.count() == 1 and bad.count() == 6
    with pytest.raises(PySparkException):
        V.fail_on_bad(got).collect()


def test_upsert_leaves_other_rows_bit_identical(spark):
    schema = "order int, head int, row_id bigint, vec array<float>"
    base = spark.createDataFrame([(1, 0, i, [float(np.float32(0.1 * i)), 1.0]) for i in range(10)], schema)
    frag = spark.createDataFrame([(1, 0, 5, [0.1, 0.0]), (1, 0, 5, [0.2, 0.0]), (1, 0, 7, [-0.4, 0.0]), (1, 0, 8, [0.0, 0.0])], schema)
    assert Y.vector_sum(frag).count() == 2
    new = {r["row_id"]: r["vec"] for r in Y.accumulate_apply(base, frag).collect()}
    old = {r["row_id"]: r["vec"] for r in base.collect()}
    assert all(new[i] == old[i] for i in old if i not in (5, 7))
    assert abs(new[5][0] - 0.8) < 0.01 and abs(new[7][0] - 0.3) < 0.01


def test_guard_refuses_other_versions(spark):
    rows, a, b = spark.range(3), spark.createDataFrame([("x",)], "v string"), spark.createDataFrame([("y",)], "v string")
    assert Y.guarded(rows, a, a, ["v"]).count() == 3
    with pytest.raises(PySparkException):
        Y.guarded(rows, a, b, ["v"]).collect()
    assert not Y.same_version(a.limit(0), a, ["v"])


def test_kd_loss_equals_numpy_and_masked_is_zero(spark):
    rng, n, v, k = np.random.default_rng(4), 20, 30, 4
    logp = np.log(rng.dirichlet(np.ones(v), n))
    idx = np.array([rng.choice(v, k, replace=False) for _ in range(n)])
    w, gold, mask = rng.dirichlet(np.ones(k), n) * 0.9, rng.integers(0, v, n), (np.arange(n) >= 5).astype(int)
    want = []
    for i in range(n):
        lp = logp[i, idx[i]]
        kd = -(w[i] * lp).sum() - 0.1 * np.log(max(1 - np.exp(lp).sum(), 1e-12))
        want.append(0.9 * kd - 0.1 * logp[i, gold[i]])
    t = [(i, [int(x) for x in idx[i]], [float(x) for x in w[i]], 0.1, int(gold[i]), int(mask[i])) for i in range(n)]
    teacher = spark.createDataFrame(t, "pos_id bigint, topk_idx array<bigint>, topk_w array<double>, tail_w double, gold bigint, loss_mask int")
    student = spark.createDataFrame([(i, j, float(logp[i, j])) for i in range(n) for j in range(v)], "pos_id bigint, token bigint, logprob double")
    r = M.kd_loss(teacher, student, 0.9).first()
    assert r["positions"] == 15 and abs(r["loss"] - np.mean([x for x, m in zip(want, mask) if m])) < 1e-9
    assert M.kd_loss(teacher.withColumn("loss_mask", F.lit(0)), student, 0.9).first()["loss"] == 0
    assert abs(M.kd_loss(teacher.withColumn("n", F.lit(3)), student, 0.9).first()["loss"] - r["loss"]) < 1e-12
    for temperature in (2.0, 1.5):
        z = logp / temperature
        z = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        hot = []
        for i in range(n):
            lp = z[i, idx[i]]
            hot.append(0.7 * (-(w[i] * lp).sum() - 0.1 * np.log(max(1 - np.exp(lp).sum(), 1e-12))) - 0.3 * z[i, gold[i]])
        got = M.kd_loss(teacher, student, 0.7, temperature).first()["loss"]
        assert abs(got - np.mean([x for x, m in zip(hot, mask) if m])) < 1e-9


def test_needle_tie_fails(spark):
    rows = [(64, 0.5, 900, -1.0, True), (64, 0.5, 1, -2.0, False), (64, 0.9, 900, -1.0, True), (64, 0.9, 1, -1.0, False)]
    got = {r["depth"]: r["success"] for r in M.needle_success(spark.createDataFrame(rows, "length int, depth double, token bigint, logprob double, is_needle boolean")).collect()}
    assert got == {0.5: True, 0.9: False}


def test_telemetry_lines(spark):
    lines = ["[2026-01-01 00:00:00] [INFO] step 5/30 (16.7%) loss 6.1234 (ema 6.2000) lr 3.00e-03", "header", "[2026-01-01 00:00:01] [INFO] saved"]
    r = M.parse_telemetry(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert len(r) == 1 and (r[0]["step"], r[0]["steps"], r[0]["loss"]) == (5, 30, 6.1234)


def test_greedy_files(spark):
    rows = spark.createDataFrame([("s", i, b) for i, b in enumerate([50, 40, 20, 200, 5, 0])], "shard_id string, doc_id bigint, bytes bigint")
    assert [r["file_no"] for r in sorted(Z.assign_files(rows, 100).collect(), key=lambda r: r["doc_id"])] == [0, 0, 1, 2, 3, 3]


def test_npz_round_trip(spark):
    rows = [("a.npz", i, i, [i, 1], [0.5, 0.25], 1) for i in range(9)] + [("b.npz", i, i, [i, 1], [0.5, 0.25], 0) for i in range(3)]
    bulk = spark.createDataFrame(rows, "file string, pos bigint, token bigint, teacher_ids array<int>, teacher_probs array<float>, loss_mask tinyint")
    chunks = spark.createDataFrame([("a.npz", 0, 0, 4), ("a.npz", 1, 4, 5), ("b.npz", 0, 0, 3)], "file string, chunk int, start bigint, length bigint")
    out = new_dir(spark, "npz-test")
    assert {r["file"]: r["n"] for r in N.write_npz(bulk, chunks, out).collect()} == {"a.npz": 9, "b.npz": 3}
    back = N.read_npz(spark, out)
    assert sorted(map(tuple, back.select("file", "pos", "token", "loss_mask").collect())) == sorted((r[0], r[1], r[2], r[5]) for r in rows)
    assert sorted(map(tuple, N.read_npz(spark, out, chunks=True).collect())) == sorted(map(tuple, chunks.collect()))


def test_malformed_json_fails_and_blank_lines_pass(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"doc_id": 1, "tokens": [1]}\n\n')
    assert X.read_dense_json(spark, str(tmp_path / "a.json")).first()["doc_id"] == "1"
    (tmp_path / "b.json").write_text('{"doc_id": 1, "tok\n')
    with pytest.raises(Exception, match="MALFORMED"):
        X.read_dense_json(spark, str(tmp_path / "b.json")).collect()


def test_shard_without_manifest_is_refused(spark):
    w = docs(spark, [6, 4]).withColumn("words", F.lit(None))
    t = S.teach(w, S.bigram_teacher(w, 2))
    path = new_dir(spark, "shards-test")
    H.write_shards(t, H.shard_manifest(t, 1000), path)
    assert H.open_shards(spark, path).count() == 2
    H.write_shards(t.withColumn("shard_id", F.lit("other")), H.shard_manifest(t, 1000), path)
    with pytest.raises(PySparkException):
        H.open_shards(spark, path).collect()


def test_addresses_of_existing_tables():
    # fixed values: the label of existing tables, and what their format makes of it
    label = "engram9b.v1"
    a, b = G.affine(0, 1031, label)
    assert (a, b % 1031) == (777, 587)
    assert b == 0x97415F3C079A42B0 and G.affine(1, 1031, label)[1] == 0xB7FCCD4942832E38


def test_addresses_are_one_to_one_and_equal_plain_integers(spark):
    rng = np.random.default_rng(11)
    tokens = [int(x) for x in rng.integers(0, 1024, 64)]
    moduli = {(1, 0): 1031, (2, 0): 4093, (2, 1): 4091, (3, 0): 4079}
    w = spark.createDataFrame([("s", 0, tokens)], "shard_id string, window_id bigint, tokens array<bigint>")
    got = {(r["pos"], r["order"], r["head"]): (r["row_id"], r["valid"]) for r in D.long_addresses(D.address_batch(w, moduli)).collect()}
    for (order, head), m in moduli.items():
        for pos in range(64):
            if order == 1:
                a, b = G.affine(head, m)
                want = (a * tokens[pos] + b) % m
            else:
                state = G.const64(order, head, "seed")
                for k in range(order - 1, -1, -1):
                    state = (state ^ (((tokens[pos - k] if pos >= k else 0) + G.GOLD) & G.MASK)) * G.multiplier(order, head) & G.MASK
                want = state % m
            assert got[pos, order, head] == (want, pos >= order - 1)
    one = spark.range(1024).select(D.unigram_address(F.col("id"), 0, 1031).alias("a")).distinct().count()
    assert one == 1024


def test_teacher_is_looked_up_or_joined_alike(spark):
    w = docs(spark, [12, 7, 1, 0])
    t = S.bigram_teacher(w.union(docs(spark, [9])), 3)
    one, two = (sorted(map(str, S.teach(w.where("size(tokens) > 0"), t, most).collect())) for most in (10_000, 0))
    assert one == two and len(one) == 3
    assert S.teach(w, t.limit(0)).where(F.exists("loss_mask", lambda m: m == 1)).count() == 0


def test_ranks_and_sums_of_one_hot_group(spark):
    d = spark.range(5000).select(F.when(F.col("id") % 50 == 0, F.lit("cold")).when(F.col("id") % 77 != 0, F.lit("hot")).alias("g"), F.xxhash64("id").alias("o"), (F.col("id") % 7).alias("v"))
    rows = sorted(map(tuple, d.collect()), key=lambda r: (r[0] or "", r[1]))
    want, n, at = [], {}, {}
    for g, o, v in rows:
        want.append((g, o, v, n.get(g, 0), at.get(g, 0)))
        n[g], at[g] = n.get(g, 0) + 1, at.get(g, 0) + v
    assert sorted(map(tuple, ordered_sums(d, ["g"], ["o"], ["v"]).collect()), key=lambda r: (r[0] or "", r[1])) == want
    assert sorted(r["rank"] for r in ordered_sums(d, [], ["o"]).collect()) == list(range(5000))
    assert ordered_sums(d.limit(0), ["g"], ["o"], ["v"]).count() == 0


def test_tiling_tells_of_files_that_one_side_lacks(spark):
    chunks = spark.createDataFrame([("a", 0, 0, 3), ("b", 0, 0, 2)], "file string, chunk int, start bigint, length bigint")
    totals = spark.createDataFrame([("a", 3), ("c", 4)], "file string, total bigint")
    assert {r["file"]: r["faults"] for r in V.chunk_tiling(chunks, totals).collect()} == {"a": 0, "b": 1, "c": 1}


def test_average_reseeds_at_the_second_step_and_forgets_long_ago(spark):
    rng = np.random.default_rng(12)
    x = rng.random(900)
    rows = spark.createDataFrame([("r", i + 1, 900, float(v)) for i, v in enumerate(x)], "run string, step bigint, steps bigint, seconds double")
    for reseed in (False, True):
        e, want = None, []
        for i, v in enumerate(x):
            e = v if e is None or (reseed and i == 1) else 0.9 * e + 0.1 * v
            want.append(e)
        got = sorted(M.step_progress(rows, "run", "step", "steps", "seconds", reseed).collect(), key=lambda r: r["step"])
        assert np.allclose([r["seconds_ema"] for r in got], want, atol=1e-12)
        assert got[449]["percent"] == 50.0 and got[-1]["eta"] == 0 and abs(got[9]["eta"] - 890 * want[9]) < 1e-6


def test_exported_parts_hold_each_shard_in_order(spark, tmp_path):
    w = docs(spark, [30, 50, 7, 40])
    parts = N.export_npy(S.teach(w, S.bigram_teacher(w, 2)), str(tmp_path), 64).collect()
    assert sum(p["n_docs"] for p in parts) == 4 and len(parts) == 2
    whole = np.concatenate([np.load(tmp_path / "s" / f"tokens-{k:05d}.npy") for k in sorted(p["part"] for p in parts)])
    assert whole.tolist() == [100 * i + j for i, n in enumerate((30, 50, 7, 40)) for j in range(n)]


def test_shards_of_several_folders_keep_their_own_k(spark):
    w, paths = docs(spark, [9, 6]), [new_dir(spark, "shards-test") for _ in range(2)]
    for k, path in zip((2, 1), paths):
        t = S.teach(w.withColumn("shard_id", F.lit(f"s{k}")), S.bigram_teacher(w, k))
        H.write_shards(t, H.shard_manifest(t, 1000, offsets=False), path)
    assert H.open_shards(spark, *paths).groupBy("shard_id").agg(F.count(F.lit(1)).alias("n")).count() == 2
    assert H.read_manifests(spark, *paths).first()["doc_offsets"] == []


def test_stream_resumes_as_if_never_stopped(spark):
    rows = [(i, f"2026-01-01 00:00:{i:02d}", i % 3, float(i)) for i in range(30)]
    e = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, value double").withColumn("ts", F.to_timestamp("ts"))
    landing, out, check = (new_dir(spark, x) for x in ("land", "out", "check"))
    for part in (e.where("event_id < 15"), e.where("event_id >= 15")):
        part.coalesce(1).write.mode("append").parquet(landing)
        SI.run_available(SE.stream_ema(spark.readStream.schema(e.schema).parquet(landing)), out, check)
    last = spark.read.parquet(out).groupBy("user_id").agg(F.max_by("ema", "n").alias("ema"), F.max("n").alias("n")).collect()
    want = {r["user_id"]: (r["n"], r["ema"]) for r in P.ema_by_key(e, "user_id", ["ts", "event_id"], "value").collect()}
    assert all(want[r["user_id"]][0] == r["n"] and abs(want[r["user_id"]][1] - r["ema"]) < 1e-9 for r in last)


def test_ingest_takes_each_file_once(spark):
    landing, out, check = (new_dir(spark, x) for x in ("land", "out", "check"))
    for k in range(2):
        spark.range(5 * k, 5 * k + 5).write.mode("append").parquet(landing)
        got = SI.ingest(spark, landing, "id bigint", lambda b: b, out, check)
    assert sorted(r["id"] for r in got.collect()) == list(range(10))


def test_shuffle_is_seeded_and_complete(spark):
    w = spark.range(50).select(F.lit("s").alias("shard_id"), F.col("id").alias("window_id"))
    one, two, other = (sorted((r["window_id"], r["place"]) for r in P.shuffle_windows(w, s).collect()) for s in (1, 1, 2))
    assert one == two != other and sorted(p for _, p in one) == list(range(50))
