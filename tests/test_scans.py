"""Scans and scores against plain loops: averages, files, similarities, ranks, overlaps."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import address as D
from corpusloom.operators import memory as Y
from corpusloom.operators import metrics as M
from corpusloom.operators import scan as SC
from corpusloom.operators import score as S
from corpusloom.operators import sizing as Z
from corpusloom.operators.prefix import ordered_lag
from corpusloom.runtime import Scratch, materialize, merge_join, new_dir, small_join


def averages(values, decay, reseed):
    out, e, seen = [], None, 0
    for x in values:
        if x is not None:
            seen += 1
            e = x if e is None or reseed and seen == 2 else decay * e + (1 - decay) * x
        out.append(e)
    return out


@pytest.mark.parametrize("decay, reseed", [(0.9, False), (0.9, True), (0.999, False), (0.999, True)])
def test_running_average_is_exact_for_any_decay(spark, decay, reseed):
    rng = random.Random(1)
    runs = {"hot": 3000, "two": 2, "one": 1, None: 7, "none": 0}
    values = {k: [None if rng.random() < 0.1 else rng.uniform(0, 9) for _ in range(n)] for k, n in runs.items()}
    values["nulls first"] = [None, None, 4.0, None, 2.0, 3.0]
    values["only nulls"] = [None, None]
    rows = [(k, i, x) for k, v in values.items() for i, x in enumerate(v)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "run string, step long, x double")
    got = {}
    for r in sorted(SC.running_average(df, "run", ["step"], "x", decay, reseed).collect(), key=lambda r: r["step"]):
        got.setdefault(r["run"], []).append(r["ema"])
    for k, v in values.items():
        for a, b in itertools.zip_longest(got.get(k, []), averages(v, decay, reseed)):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9), (k, a, b)


def test_averages_of_groups_that_begin_in_later_ranges(spark):
    rng = random.Random(3)
    for size in (1, 2, 3, 5):
        values = [rng.uniform(0, 9) for _ in range(40)]
        df = spark.createDataFrame([(i // size, i, x) for i, x in enumerate(values)], "run long, step long, x double")
        got = [r["ema"] for r in sorted(SC.running_average(df, "run", ["step"], "x", 0.5, True).collect(), key=lambda r: r["step"])]
        want = [y for k in range(0, 40, size) for y in averages(values[k : k + size], 0.5, True)]
        assert np.allclose(got, want)


def test_progress_of_a_long_run(spark):
    values = [float(i % 17) for i in range(3000)]
    df = spark.createDataFrame([("r", i + 1, 4000, x) for i, x in enumerate(values)], "run string, step long, steps long, seconds double")
    last = M.step_progress(df, "run", "step", "steps", "seconds", True, 0.999).where("step = 3000").first()
    want = averages(values, 0.999, True)[-1]
    assert abs(last["seconds_ema"] - want) < 1e-9 and abs(last["eta"] - 1000 * want) < 1e-6 and last["percent"] == 75
    assert M.step_progress(df.limit(0), "run", "step", "steps", "seconds").count() == 0


def test_rows_before_over_ranges(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.choice([None, 1, 2, 3])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i long, x long")
    last, want = {}, {}
    for g, i, x in rows:
        want[i] = last.get(g)
        last[g] = x
    assert {r["i"]: r["b"] for r in ordered_lag(df, ["g"], ["i"], "x", "b").collect()} == want


def greedy(sizes, limit, size=0):
    out, no = [], 0
    for b in sizes:
        if size and size + b > limit:
            size, no = 0, no + 1
        size += b
        out.append(no)
    return out, size


def test_composed_cells_are_the_greedy_rule():
    rng = random.Random(5)
    for _ in range(300):
        limit = rng.choice([1, 5, 10, 30])
        a, b, c = ([rng.choice([0, 1, 2, 3, 7, 12, 40]) for _ in range(rng.randint(1, 9))] for _ in range(3))
        cells = Z._composed(Z._composed(*(Z._stretch_cells(np.array(x), limit) for x in (a, b))), Z._stretch_cells(np.array(c), limit))
        for size in range(60):
            no, left = greedy(a + b + c, limit, size)
            assert Z._at(cells, size) == (no[-1], left)


def test_files_of_one_hot_shard(spark):
    rng = random.Random(7)
    sizes = {"hot": [rng.choice([0, 1, 5, 30, 99, 250]) for _ in range(2000)], "cold": [50] * 5, "one": [0], None: [60, 60]}
    rows = [(s, i, b) for s, v in sizes.items() for i, b in enumerate(v)]
    rng.shuffle(rows)
    got = {}
    for r in sorted(Z.assign_files(spark.createDataFrame(rows, "shard_id string, doc_id long, bytes long"), 200).collect(), key=lambda r: r["doc_id"]):
        got.setdefault(r["shard_id"], []).append(r["file_no"])
    assert got == {s: greedy(v, 200)[0] for s, v in sizes.items()}
    none = spark.createDataFrame([("a", 1, None), ("a", 2, 3)], "shard_id string, doc_id long, bytes long")
    assert sorted(r["bytes"] for r in Z.assign_files(none, 2).collect()) == [0, 3]
    assert Z.assign_files(none.limit(0), 2).count() == 0


def test_fifty_thousand_candidates_equal_a_full_softmax(spark):
    rng = np.random.default_rng(2)
    cand, vec = rng.normal(size=(50_000, 8)), rng.normal(size=(30, 8))
    cand[40_000:40_010] = cand[7]  # ties
    c = spark.createDataFrame([(int(i) * 3, x.tolist()) for i, x in enumerate(cand)], "cand_id long, cand_vec array<double>")
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vec)] + [(99, None)], "id long, v array<double>")
    z = vec @ cand.T
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    order = np.lexsort((np.broadcast_to(np.arange(50_000), z.shape), -z))[:, :12]
    for size in (64 << 20, 15_000 * 64):  # one slice, and several
        got = {r["id"]: r for r in S.similarity_topk(v, "id", "v", c, 12, size).collect()}
        assert got[99]["topk_idx"] == [] and got[99]["topk_p"] == [] and got[99]["tail"] == 1
        for i in range(30):
            assert got[i]["topk_idx"] == (order[i] * 3).tolist()
            assert np.allclose(got[i]["topk_p"], p[i, order[i]], atol=1e-12) and abs(got[i]["tail"] - (1 - p[i, order[i]].sum())) < 1e-9


def test_fewer_candidates_than_asked_for(spark):
    c = spark.createDataFrame([(5, [1.0, 0.0]), (2, [1.0, 0.0]), (9, [0.0, 1.0])], "cand_id int, cand_vec array<double>")
    v = spark.createDataFrame([(1, [1.0, 0.0])], "id int, v array<float>")
    r = S.similarity_topk(v, "id", "v", c, 8).first()
    assert r["topk_idx"] == [2, 5, 9] and abs(sum(r["topk_p"]) - 1) < 1e-12


def test_unique_rows_are_numbered_in_a_hot_batch(spark):
    rows = [("b", 1, 0, (i * 37) % 300) for i in range(900)]
    got = D.unique_inverse(spark.createDataFrame(rows, "shard_id string, order int, head int, row_id long"), ["shard_id"]).collect()
    rank = {x: k for k, x in enumerate(sorted({r[3] for r in rows}))}
    assert len(got) == 900 and all(r["inverse"] == rank[r["row_id"]] for r in got)


def test_overlap_of_heads_against_pairs(spark):
    rng = random.Random(4)
    rows = [(o, h, g, rng.randrange(60)) for o in (2, 3) for h in range(3) for g in range(80)]
    got = {(r["order"], r["head_a"], r["head_b"]): r for r in D.head_overlap(spark.createDataFrame(rows, "order int, head int, gram long, row_id long")).collect()}
    hit = {(o, h, g): sum(1 for a, b, _, y in rows if (a, b, y) == (o, h, x)) > 1 for o, h, g, x in rows}
    for o in (2, 3):
        for a, b in itertools.combinations(range(3), 2):
            r, ca, cb = got[o, a, b], *(sum(hit[o, h, g] for g in range(80)) for h in (a, b))
            both = sum(hit[o, a, g] and hit[o, b, g] for g in range(80))
            assert (r["grams"], r["collided_a"], r["collided_b"], r["both"]) == (80, ca, cb, both) and abs(r["chance"] - ca * cb / 80) < 1e-9


def test_features_are_as_wide_without_a_head(spark):
    rows = [(1, 1, 0, [3.0, 4.0], True), (1, 1, 1, None, True), (2, 1, 1, [1.0, 1.0], True), (3, 1, 0, [1.0, 1.0], False)]
    g = spark.createDataFrame(rows, "pos long, order int, head int, vec array<float>, valid boolean")
    f = {r["pos"]: r["feature"] for r in Y.memory_features(g, ["pos"], 0.0, heads=2, dim=2).collect()}
    assert np.allclose(f[1], np.array([3, 4, 0, 0]) / np.sqrt(25 / 4)) and np.allclose(f[2], np.array([0, 0, 1, 1]) / np.sqrt(0.5))
    assert f[3] == [0, 0, 0, 0]


def test_large_teachers_are_merged_by_bytes(spark):
    docs = spark.createDataFrame([("s", 1, [1, 2, 3, 1, 2])], "shard_id string, doc_id long, tokens array<bigint>")
    t = S.bigram_teacher(docs, 2)
    assert S.teach(docs, t).collect() == S.teach(docs, t, most_bytes=0).collect()


def test_small_side_is_judged_by_its_files(spark):
    a, b = spark.range(50), materialize(spark.range(40).withColumn("x", F.lit(1)), "side")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan(small_join(a, b, "id")) and "Broadcast" not in plan(small_join(a, b, "id", most_bytes=1))
    assert "Broadcast" not in plan(small_join(a, b, "id", most_rows=39))
    assert small_join(a, b.where("id < 7"), "id").count() == 7 == merge_join(a, b.where("id < 7"), "id").count()


def test_an_owning_scratch_deletes_what_it_saw_written(spark):
    with Scratch(spark, owns=True) as s:
        t = materialize(spark.range(5), "inner")
        out = s.result(t.where("id > 2"), "outer")
    assert out.count() == 2
    with pytest.raises(Exception):
        spark.read.parquet(t.inputFiles()[0]).count()


def plan_of(d) -> str:
    return d._jdf.queryExecution().executedPlan().toString()


def test_addresses_meet_ranks_and_shared_rows_without_a_shuffle(spark):
    a = spark.createDataFrame([("b", 1, 0, i % 7) for i in range(40)], "shard_id string, order int, head int, row_id long")
    assert "BroadcastHashJoin" in plan_of(D.unique_inverse(a, ["shard_id"]))
    grams = spark.createDataFrame([(2, h, g, g % 5) for h in range(2) for g in range(40)], "order int, head int, gram long, row_id long")
    assert plan_of(D.head_overlap(grams)).count("SortMergeJoin") == 0


def test_vectors_are_gathered_where_addresses_lie(spark):
    a = spark.createDataFrame([(i, 1, i % 2, i % 9) for i in range(60)], "pos long, order int, head int, row_id long")
    m = spark.createDataFrame([(1, h, r, [float(r), float(h)]) for h in range(2) for r in range(6)], "order int, head int, row_id long, vec array<float>")
    g = Y.gather_rows(a, m)
    assert "BroadcastHashJoin" in plan_of(g)
    got = {r["pos"]: r["vec"] for r in g.collect()}
    assert len(got) == 60 and all(got[i] == ([float(i % 9), float(i % 2)] if i % 9 < 6 else None) for i in range(60))


def test_features_of_sets_are_those_of_places(spark):
    m = spark.createDataFrame([(1, h, r, [r + 1.0, h + 2.0]) for h in range(2) for r in range(3)], "order int, head int, row_id long, vec array<float>")
    w = spark.createDataFrame([("s", 0, [1, 2, 1, 3, 2, 1])], "shard_id string, window_id long, tokens array<bigint>")
    b = D.address_batch(w, {(1, 0): 5, (1, 1): 5})
    place = ["shard_id", "window_id", "pos"]
    want = {r["pos"]: r["feature"] for r in Y.memory_features(Y.gather_rows(D.long_addresses(b), m).where("vec IS NOT NULL"), place).collect()}
    sets = Y.row_sets(b, 1)
    features = Y.set_features(sets, m)
    assert features.count() < len(want)
    got = {r["pos"]: r["feature"] for r in merge_join(sets, features, "rows").collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_distinct_grams_are_hashed_once(spark):
    moduli = {(1, 0): 7, (2, 0): 11, (2, 1): 13, (3, 0): 17}
    w = spark.createDataFrame([("s", 0, [1, 2, 1, 2, 1, 2]), ("t", 0, [1, 2, 5])], "shard_id string, window_id long, tokens array<bigint>")
    got = [(r["order"], r["head"], tuple(r["gram"]), r["row_id"]) for r in D.gram_addresses(w, moduli).collect()]
    want = {(r["order"], r["head"], tuple([r["c0"], r["c1"], r["c2"]][: r["order"]] + [0] * (3 - r["order"])), r["row_id"]) for r in D.long_addresses(D.address_batch(w, moduli)).collect()}
    assert len(got) == len(set(got)) and set(got) == want


def test_a_scorer_gets_few_tokens_at_a_time(spark):
    docs = spark.createDataFrame([("s", i, [i] * n) for i, n in enumerate([30, 30, 30, 500, 1, 1, 99])], "shard_id string, doc_id long, tokens array<bigint>").coalesce(1)

    def scorer(b):  # each row's tail says how many tokens came with it
        total = sum(map(len, b["tokens"]))
        return b.assign(topk_idx=[[]] * len(b), topk_w=[[]] * len(b), tail_w=[[float(total)]] * len(b), loss_mask=[[]] * len(b))

    got = {r["doc_id"]: r["tail_w"][0] for r in S.score_with(docs, scorer, most_tokens=100).collect()}
    assert got == {0: 90, 1: 90, 2: 90, 3: 500, 4: 2, 5: 2, 6: 99}


def test_what_is_counted_does_not_meet_by_batch(spark):
    a = spark.createDataFrame([(f"b{i % 3}", 1, 0, i % 11) for i in range(90)], "shard_id string, order int, head int, row_id long")
    path, seen = new_dir(spark, "touches"), []
    D.add_touches(path, a.where("shard_id = 'b0'"), ["shard_id"])
    whole, D.materialize = D.materialize, lambda d, name: seen.append(plan_of(d)) or whole(d, name)
    try:
        assert D.add_touches(path, a, ["shard_id"]) == 2 and D.add_touches(path, a, ["shard_id"]) == 0
    finally:
        D.materialize = whole
    assert seen and not any("SortMergeJoin" in p for p in seen)
    assert {r["row_id"]: r["touches"] for r in D.read_touches(spark, path).collect()} == dict.fromkeys(range(11), 3)
