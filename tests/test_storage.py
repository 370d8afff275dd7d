"""What is stored: bundles, conversion that is killed, versions, windows by random access, exports, counters, streams."""

from __future__ import annotations

import hashlib
import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusloom.functions.arrays import fp16
from corpusloom.operators import address as D
from corpusloom.operators import memory as Y
from corpusloom.operators import pack as P
from corpusloom.operators import score as S
from corpusloom.operators import versions as VT
from corpusloom.runtime import materialize, new_dir
from corpusloom.sources import convert as CV
from corpusloom.sources import npz as N
from corpusloom.sources import shards as H
from corpusloom.sources import text as X
from corpusloom.sources.files import get_json, names, put_json
from corpusloom.streaming import ema as SE
from corpusloom.streaming import ingest as SI

WORDS = 500


def arrays(lengths, k=3, seed=0):
    rng = np.random.default_rng(seed)
    n = sum(lengths)
    tokens = rng.integers(10, WORDS, n).astype("uint32")
    ids = rng.integers(0, 9, (n, k)).astype("int32")
    ids[:, 0] = tokens
    probs = np.tile(np.array([0.5, 0.25, 0.125], "float32")[:k], (n, 1))
    starts = np.cumsum([0, *lengths[:-1]]).astype("int64")
    mask = np.ones(n, "uint8")
    mask[starts] = 0
    ids[starts], probs[starts] = -1, 0
    return {"tokens": tokens, "teacher_ids": ids, "teacher_probs": probs, "loss_mask": mask, "chunk_start": starts, "chunk_length": np.array(lengths, "int64")}


def bundle(folder, name, lengths=(6, 5), change=None, save=np.savez, **kw):
    a = arrays(list(lengths), **kw)
    if change:
        change(a)
    save(Path(folder) / name, **a)
    return a


def odd_distributions(a):
    """Probabilities of all sizes, some that are no numbers, and masked rows within chunks."""
    rng = np.random.default_rng(9)
    n, k = a["teacher_ids"].shape
    p = (rng.random((n, k)) ** 9 / k).astype("float32")
    p[5], p[7], p[11], p[13] = 1e5, 65519.99, 3e-8, np.nan
    a["teacher_probs"], a["loss_mask"][rng.integers(0, n, 9)] = p, 0


def rows_of(spark, out):
    return sorted(map(str, H.open_shards(spark, out).collect()))


def test_large_bundles_are_split_and_read_alike(spark, tmp_path):
    a = bundle(tmp_path, "big.npz", [9000, 8000, 5000])
    bundle(tmp_path, "packed.npz", [40], save=np.savez_compressed, seed=2)
    one = N.read_npz(spark, str(tmp_path), files=["big.npz"])
    many = N.read_npz(spark, str(tmp_path), files=["big.npz"], split_bytes=100_000, columns=["pos", "token", "chunk", "loss_mask"])
    assert many.rdd.getNumPartitions() >= 3 and one.rdd.getNumPartitions() == 1
    got = sorted(many.collect(), key=lambda r: r["pos"])
    assert [r["token"] for r in got] == a["tokens"].tolist() and [r["loss_mask"] for r in got] == a["loss_mask"].tolist()
    assert [r["chunk"] for r in got] == [0] * 9000 + [1] * 8000 + [2] * 5000
    assert one.count() == 22000 and N.read_npz(spark, str(tmp_path)).count() == 22040


def test_bundles_are_written_compressed_from_packed_positions(spark, tmp_path):
    lengths, out = [900, 1100, 500], tmp_path / "written"
    want = {f"w{k}.npz": arrays(lengths, seed=k) for k in range(2)}
    rows = [(f, i, int(a["tokens"][i]), a["teacher_ids"][i].tolist(), a["teacher_probs"][i].tolist(), int(a["loss_mask"][i])) for f, a in want.items() for i in range(sum(lengths))]
    bulk = spark.createDataFrame(rows, "file string, pos long, token long, teacher_ids array<int>, teacher_probs array<float>, loss_mask tinyint")
    chunks = spark.createDataFrame([(f, k, int(a["chunk_start"][k]), n) for f, a in want.items() for k, n in enumerate(lengths)], "file string, chunk int, start long, length long")
    w = N.write_npz(bulk.repartition(3), chunks, str(out))  # positions of both files in any order
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan.split("Exchange hashpartitioning(file", 1)[1].split("Exchange hashpartitioning(file", 1)[0]
    assert sorted(map(tuple, w.collect())) == [("w0.npz", 2500), ("w1.npz", 2500)]
    for f, a in want.items():
        got = np.load(out / f, allow_pickle=False)
        assert set(got) == set(a) and all(got[c].dtype == a[c].dtype and (got[c] == a[c]).all() for c in a)
        assert os.path.getsize(out / f) < sum(x.nbytes for x in a.values()) / 3
    read = sorted(map(tuple, N.read_npz(spark, str(out)).select("file", "pos", "token", "teacher_ids", "teacher_probs", "loss_mask").collect()))
    assert read == sorted(rows)
    for odd in ((rows[0][0], 9999, 1, [1], [0.5], 1), (rows[0][0], 9999, None, [1, 2, 3], [0.5, 0.25, 0.125], 1)):
        with pytest.raises(PySparkException, match="w0.npz: (all positions need|token has nulls)"):
            N.write_npz(bulk.union(spark.createDataFrame([odd], bulk.schema)), chunks, new_dir(spark, "odd")).collect()


@pytest.mark.parametrize(
    "change, said",
    [
        (lambda a: a.update(tokens=a["tokens"].astype("float64") + 0.7), "tokens is <f8, not <u4"),
        (lambda a: a.update(loss_mask=a["loss_mask"].astype("int16") * 300), "loss_mask is <i2, not |u1"),
        (lambda a: a.update(teacher_probs=a["teacher_probs"].astype("float64")), "teacher_probs is <f8"),
        (lambda a: a.pop("teacher_ids"), "missing teacher_ids"),
        (lambda a: a.update(loss_mask=a["loss_mask"][:-1]), "loss_mask has shape [10]"),
        (lambda a: a.update(teacher_ids=a["teacher_ids"][:, :2]), "teacher_probs has shape [11, 3]"),
        (lambda a: a.update(teacher_ids=np.asfortranarray(a["teacher_ids"])), "teacher_ids is not in row order"),
        (lambda a: a.update(tokens=a["tokens"].astype(">u4")), "tokens is >u4"),
    ],
)
def test_bundles_of_other_types_are_refused_not_cast(spark, tmp_path, change, said):
    bundle(tmp_path, "bad.npz", change=change)
    faults = N.bundle_faults(N.read_npz_headers(spark, str(tmp_path))).first()["faults"]
    assert any(said in f for f in faults)
    with pytest.raises(PySparkException, match="bad.npz"):
        N.read_npz(spark, str(tmp_path)).collect()
    report = CV.bulk_convert(spark, str(tmp_path), new_dir(spark, "out"), WORDS).first()
    assert report["state"] == "rejected" and any(said in f for f in report["reasons"])


def test_conversion_moves_rows_within_chunks(spark, tmp_path):
    a = bundle(tmp_path, "b.npz", [10, 8, 5])
    out = new_dir(spark, "out")
    assert [r["state"] for r in CV.bulk_convert(spark, str(tmp_path), out, WORDS, teacher_id="t").collect()] == ["converted"]
    docs = sorted(H.open_shards(spark, out).collect(), key=lambda r: r["doc_id"])
    for d, s, n in zip(docs, a["chunk_start"], a["chunk_length"]):
        assert d["tokens"] == a["tokens"][s : s + n].tolist() and d["manifest_k"] == 3
        assert d["loss_mask"] == [1] * (n - 1) + [0] and sum(d["topk_idx"][-1]) == 0 == sum(d["topk_w"][-1])
        assert d["topk_idx"][:-1] == a["teacher_ids"][s + 1 : s + n].tolist()
        assert all(abs(sum(w) + t - 1) < 1e-3 for w, t in zip(d["topk_w"], d["tail_w"]))
    m = H.read_manifests(spark, out).first()
    assert (m["total_tokens"], m["num_documents"], m["fold_version"], m["teacher_id"]) == (23, 3, "v2", "t")


def test_bundles_are_converted_without_a_shuffle_or_a_copy(spark, tmp_path):
    bundle(tmp_path, "a.npz", [700, 1, 900, 40], k=10, seed=1, change=odd_distributions)
    bundle(tmp_path, "b.npz", [5000, 9000, 3, 8000], k=3, seed=2, change=odd_distributions)
    bundle(tmp_path, "c.npz", [300, 20], k=2, seed=3, save=np.savez_compressed)
    files = [f"{x}.npz" for x in "abc"]
    columns = ["file", "pos", "token", "teacher_ids", "teacher_probs", "loss_mask", "chunk"]
    s = P.shift_chunks(N.read_npz(spark, str(tmp_path), columns=columns))  # the same by a shuffle of positions
    tail = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.aggregate("topk_p", F.lit(0.0), lambda t, v: t + v.cast("double")))).cast("float")
    s = s.select("*", F.transform("topk_p", lambda p: fp16(p).cast("float")).alias("w"), tail.alias("tail"))
    g = s.groupBy("file", "chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "token", F.col("topk_idx").cast("array<bigint>").alias("i"), "w", "tail", "loss_mask"))).alias("r"))
    want = sorted(map(str, g.select(F.regexp_replace("file", "[.]npz$", "").alias("shard_id"), F.col("chunk").cast("long").alias("doc_id"), "r.token", "r.i", "r.w", "r.tail", "r.loss_mask").toDF(*H.SHARD.replace(",", "").split()[::2]).collect()))
    docs = CV.bundle_documents(spark, str(tmp_path), files)
    assert "Exchange" not in docs._jdf.queryExecution().executedPlan().toString() and sorted(map(str, docs.collect())) == want
    held = {r["file"]: r["n"] for r in N.read_npz_headers(spark, str(tmp_path)).groupBy("file").agg(F.sum("bytes").alias("n")).collect()}
    split = N.read_npz_documents(spark, str(tmp_path), held, split_bytes=held["b.npz"] // 3)
    assert split.rdd.getNumPartitions() == 4 and split.where("file = 'b.npz'").selectExpr("sum(size(tokens))", "count(*)").first() == (22003, 4)

    shared = new_dir(spark, "x").rsplit("/", 1)[0]
    out, there = new_dir(spark, "out"), set(names(spark, shared))
    assert {r["state"] for r in CV.bulk_convert(spark, str(tmp_path), out, WORDS).collect()} == {"converted"}
    assert sorted(map(str, H.read_shards(spark, out).select(docs.columns).collect())) == want and set(names(spark, shared)) - there == {out.rsplit("/", 1)[1]}


def test_contract_breaks_are_rejected_and_the_rest_converted(spark, tmp_path):
    bundle(tmp_path, "good.npz")
    bundle(tmp_path, "gold.npz", change=lambda a: a["teacher_ids"].__setitem__((3, 0), 1))
    bundle(tmp_path, "tile.npz", change=lambda a: a.update(chunk_length=a["chunk_length"] + 1))
    bundle(tmp_path, "mask.npz", change=lambda a: a["loss_mask"].__setitem__(2, 7))
    got = {r["file"]: (r["state"], r["reasons"]) for r in CV.bulk_convert(spark, str(tmp_path), new_dir(spark, "out"), WORDS).collect()}
    assert got["good.npz"] == ("converted", []) and {f for f, (s, _) in got.items() if s == "rejected"} == {"gold.npz", "tile.npz", "mask.npz"}
    assert "slot 0" in got["gold.npz"][1][0] and "tile" in got["tile.npz"][1][0] and "mask" in got["mask.npz"][1][0]


def test_a_killed_conversion_goes_on_with_the_same_shards(spark, tmp_path):
    for k in range(4):
        bundle(tmp_path, f"b{k}.npz", [7, 4 + k], seed=k)
    clean, out = new_dir(spark, "clean"), new_dir(spark, "killed")
    CV.bulk_convert(spark, str(tmp_path), clean, WORDS)

    def dies(spark, staged, out, shard, row):
        CV.replace_folder(spark, f"{staged}/shard_id={shard}", f"{out}/shards/shard_id={shard}")
        if shard == "b2":  # its rows are in place, its marker is not
            raise KeyboardInterrupt
        put_json(spark, f"{out}/manifest/{shard}.json", row)

    with pytest.raises(KeyboardInterrupt):
        CV.bulk_convert(spark, str(tmp_path), out, WORDS, commit=dies)
    assert CV.committed(spark, out) == {"b0", "b1"}
    again = {r["shard_id"]: r["state"] for r in CV.bulk_convert(spark, str(tmp_path), out, WORDS, files_per_batch=1).collect()}
    assert again == {"b0": "skipped", "b1": "skipped", "b2": "converted", "b3": "converted"}
    assert rows_of(spark, out) == rows_of(spark, clean)
    assert {r["state"] for r in CV.bulk_convert(spark, str(tmp_path), out, WORDS).collect()} == {"skipped"}


def memory(spark, n=200):
    return spark.createDataFrame([(1, i % 2, i // 2, [float(i), 1.0]) for i in range(n)], "order int, head int, row_id long, vec array<float>")


def digests(root):
    return {p: hashlib.sha256(Path(p).read_bytes()).hexdigest() for p in map(str, Path(root.removeprefix("file://")).rglob("*.parquet"))}


def test_updates_leave_untouched_buckets_byte_for_byte(spark):
    root, base = new_dir(spark, "versions"), memory(spark)
    VT.create_table(base, root, {"sha256": "x", "rows": 200}, buckets=16)
    before = digests(root)
    up = spark.createDataFrame([(1, 0, 3, [1.0, 1.0]), (1, 1, 9, [2.0, 0.0]), (1, 0, 10**6, [1.0, 1.0])], "order int, head int, row_id long, vec array<float>")
    assert VT.update_table(spark, root, up, {"sha256": "x"}) == 1
    after = digests(root)
    assert {p: h for p, h in after.items() if p in before} == before and 0 < len(after) - len(before) <= 3
    key = lambda d: sorted((r["head"], r["row_id"], tuple(r["vec"])) for r in d.collect())
    assert key(VT.read_table(spark, root)) == key(Y.sparse_upsert(base, up)) != key(base)
    assert key(VT.read_table(spark, root, version=0)) == key(base)
    old, new = (VT.table_version(spark, root, k)["folders"] for k in (0, 1))
    assert 0 < sum(old[b] != new[b] for b in old) <= 3


def test_a_refused_guard_changes_nothing(spark):
    root = new_dir(spark, "versions")
    VT.create_table(memory(spark), root, {"sha256": "x"}, buckets=4)
    before = digests(root)
    with pytest.raises(ValueError, match="sha256"):
        VT.update_table(spark, root, memory(spark, 4), {"sha256": "y"})
    with pytest.raises(ValueError, match="sha256"):
        VT.read_table(spark, root, {"sha256": "y"})
    assert digests(root) == before and VT.table_version(spark, root)["version"] == 0 and VT.read_table(spark, root).count() == 200


def test_of_two_updates_of_a_version_the_second_fails(spark):
    root = new_dir(spark, "versions")
    VT.create_table(memory(spark), root, {}, buckets=4)
    put_json(spark, f"{root}/versions/1.json", {"version": 1})  # another writer was first
    with pytest.raises(Exception):
        VT.update_table(spark, root, memory(spark, 4), {})
    assert VT.table_version(spark, root)["version"] == 0 and get_json(spark, f"{root}/versions/1.json") == {"version": 1}


def test_a_stored_memory_is_not_shuffled(spark):
    path = new_dir(spark, "stored")
    VT.store_by_key(memory(spark), "stored_memory", path, buckets=4)
    a = spark.createDataFrame([(1, 0, 3), (1, 1, 4), (1, 1, 4), (1, 0, 10**6)], "order int, head int, row_id long")
    g = VT.gather_stored(a, "stored_memory")
    plan = g._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert sorted((r["row_id"], r["vec"]) for r in g.collect()) == sorted((r["row_id"], r["vec"]) for r in Y.gather_rows(a, memory(spark)).collect())
    spark.sql("DROP TABLE stored_memory")


def shard_docs(spark, lengths, shard="s"):
    d = spark.createDataFrame([(shard, i, list(range(100 * i, 100 * i + n))) for i, n in enumerate(lengths)], "shard_id string, doc_id bigint, tokens array<bigint>")
    return S.teach(d, S.bigram_teacher(d, 2))


def test_windows_open_only_the_files_that_hold_them(spark):
    t, path = shard_docs(spark, [40] * 30), new_dir(spark, "windows")
    H.write_shards(t, H.shard_manifest(t, 4000), path, file_bytes=64 * 150)
    files = sorted(Path(f"{path}/shards".removeprefix("file://")).rglob("*.parquet"))
    assert len(files) >= 4
    want = spark.createDataFrame([("s", 0), ("s", 3), ("s", 999), ("t", 0)], "shard_id string, window_id long")
    every = {r["window_id"]: r for r in P.pack_windows(t, 32).collect()}
    for f in files:  # the last files are not what the windows need
        if any(r["first_doc"] > 8 and r["file"].endswith(f.name) for r in spark.read.parquet(f"{path}/index").collect()):
            f.write_bytes(b"broken")
            crc = f.with_name(f".{f.name}.crc")
            if crc.exists():
                os.remove(crc)
    got = {r["window_id"]: r for r in H.read_windows(spark, path, want, 32).collect()}
    assert got.keys() == {0, 3} and all(got[k] == every[k] for k in got)


def test_shards_take_as_many_files_as_their_bytes(spark):
    t, path = shard_docs(spark, [50] * 40), new_dir(spark, "files")
    H.write_shards(t, H.shard_manifest(t, 4000), path, file_bytes=64 * 200)
    index = spark.read.parquet(f"{path}/index").collect()
    assert len(index) >= 5
    spans = sorted((r["first_doc"], r["last_doc"]) for r in index)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_a_failed_export_leaves_nothing(spark, tmp_path):
    t = shard_docs(spark, [30, 50, 7, 40])
    said = F.when(F.col("doc_id") == 3, F.raise_error(F.lit("no")).cast("array<float>")).otherwise(F.col("tail_w"))
    with pytest.raises(Exception):
        N.export_npy(t.withColumn("tail_w", said), str(tmp_path / "bad"), 64)
    assert not list(Path(tmp_path / "bad").rglob("*.npy")) and not (tmp_path / "bad/parts.json").exists()
    assert N.export_npy(t, str(tmp_path / "good"), 64).count() == 2 and len(list((tmp_path / "good").rglob("*.npy"))) == 6


def test_touches_count_a_batch_once(spark):
    path = new_dir(spark, "touches")
    rows = [(b, 1, 0, r) for b, r in [("a", 1), ("a", 1), ("a", 2), ("b", 1), ("c", 5)]]
    a = spark.createDataFrame(rows, "batch string, order int, head int, row_id long")
    assert D.add_touches(path, a.where("batch = 'a'"), ["batch"]) == 1
    assert D.add_touches(path, a, ["batch"]) == 2 and D.add_touches(path, a, ["batch"]) == 0
    a.write.parquet(f"{path}/died/counts")  # a run that never got its marker
    assert {r["row_id"]: r["touches"] for r in D.read_touches(spark, path).collect()} == {1: 2, 2: 1, 5: 1}


def test_late_rows_go_aside(spark):
    rows = [(i, f"2026-01-01 00:00:{i:02d}", 1, float(i)) for i in range(20)]
    e = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, value double").withColumn("ts", F.to_timestamp("ts"))
    landing, out, check = (new_dir(spark, x) for x in ("land", "out", "check"))
    for part in (e.where("event_id < 10 AND event_id <> 4"), e.where("event_id >= 10 OR event_id = 4")):
        part.coalesce(1).write.mode("append").parquet(landing)
        SI.run_available(SE.stream_ema(spark.readStream.schema(e.schema).parquet(landing)), out, check)
    got = spark.read.parquet(out)
    assert [r["late_id"] for r in got.where("late_id IS NOT NULL").collect()] == [4]
    last = got.where("late_id IS NULL").orderBy(F.desc("n")).first()
    want = P.ema_by_key(e.where("event_id <> 4"), "user_id", ["ts", "event_id"], "value").first()
    assert last["n"] == 19 == want["n"] and abs(last["ema"] - want["ema"]) < 1e-9


def test_streamed_shards_carry_manifests(spark):
    landing, out, check = (new_dir(spark, x) for x in ("land", "out", "check"))
    convert = lambda b: S.teach(b, S.bigram_teacher(b, 2))
    for k in range(2):
        d = spark.createDataFrame([("s", k, [1, 2, 1, 2, 3])], "shard_id string, doc_id bigint, tokens array<bigint>")
        d.write.mode("append").parquet(landing)
        paths = SI.ingest_shards(spark, landing, "shard_id string, doc_id bigint, tokens array<bigint>", convert, out, check, 10)
    assert len(paths) == 2 and H.open_shards(spark, *paths).count() == 2
    assert sorted(r["total_tokens"] for r in H.read_manifests(spark, *paths).collect()) == [5, 5]


def test_lines_keep_their_order(spark, tmp_path):
    for name in ("b.txt", "a.txt"):
        (tmp_path / name).write_text("".join(f"{name} line {i}\n" for i in range(50)))
    d = X.read_text_corpus(spark, str(tmp_path))
    no = X.document_order(d)
    got = [r["text"] for r in d.join(no, ["path", "block", "at"]).orderBy("doc_no").collect()]
    assert got == [f"{n} line {i}" for n in ("a.txt", "b.txt") for i in range(50)]


def test_small_bundles_are_read_together(spark, tmp_path):
    for k in range(9):
        bundle(tmp_path, f"s{k}.npz", [7, 4 + k], seed=k)
    for d, rows in ((N.read_npz(spark, str(tmp_path)), sum(11 + k for k in range(9))), (N.read_npz(spark, str(tmp_path), chunks=True), 18), (N.read_npz_headers(spark, str(tmp_path)), 54)):
        assert d.rdd.getNumPartitions() == 1 and d.count() == rows
    assert N.bundle_faults(N.read_npz_headers(spark, str(tmp_path))).where(F.size("faults") == 0).count() == 9
    assert [len(p.pieces) for p in N._together([(str(k), 10) for k in range(7)], 30)] == [3, 3, 1]


def test_small_bundles_are_converted_together(spark, tmp_path, monkeypatch):
    sizes = {f"s{k}": 10 for k in range(7)}
    assert CV.batches_of(list(sizes), sizes, 2, 30) == [["s0", "s1", "s2"], ["s3", "s4", "s5"], ["s6"]]
    assert [len(b) for b in CV.batches_of(list(sizes), sizes, 4, 30)] == [4, 3] and CV.batches_of([], sizes, 2, 30) == []
    for k in range(4):
        bundle(tmp_path, f"b{k}.npz", [7, 4 + k], seed=k)
    asked, faults = [], CV.faults_of
    monkeypatch.setattr(CV, "faults_of", lambda spark, path, files: asked.append(files) or faults(spark, path, files))
    out, single = new_dir(spark, "together"), new_dir(spark, "single")
    CV.bulk_convert(spark, str(tmp_path), out, WORDS, files_per_batch=1)
    CV.bulk_convert(spark, str(tmp_path), single, WORDS, files_per_batch=1, batch_bytes=1)
    assert [len(a) for a in asked] == [4, 1, 1, 1, 1] and rows_of(spark, out) == rows_of(spark, single)


def test_documents_are_dealt_before_they_are_filled(spark):
    docs = spark.createDataFrame([("s", i, [1, 2, 3 + i % 4, 1]) for i in range(12)], "shard_id string, doc_id long, tokens array<bigint>")
    teacher = S.bigram_teacher(docs, 2)
    t, whole, filled = materialize(S.teach(docs, teacher), "taught"), new_dir(spark, "shards"), new_dir(spark, "shards")
    H.write_shards(t, H.shard_manifest(t, WORDS), whole, file_bytes=64 * 12)
    H.write_shards(docs, lambda written: H.shard_manifest(written, WORDS), filled, file_bytes=64 * 12, fill=lambda d: S.teach(d, teacher))
    assert rows_of(spark, whole) == rows_of(spark, filled) and H.read_manifests(spark, whole).drop("manifest_file").collect() == H.read_manifests(spark, filled).drop("manifest_file").collect()
    ends = [sorted((r["first_doc"], r["last_doc"]) for r in spark.read.parquet(f"{p}/index").collect()) for p in (whole, filled)]
    assert ends[0] == ends[1] and len(ends[0]) > 1


def test_json_is_put_anew_over_an_old_value_or_not_at_all(spark):
    path = f"{new_dir(spark, 'values')}/v.json"
    for value in (1, 2):
        put_json(spark, path, value)
        assert get_json(spark, path) == value
    with pytest.raises(Exception):
        put_json(spark, path, 3, only_new=True)
    assert get_json(spark, path) == 2 and names(spark, path.rsplit("/", 1)[0]) == ["v.json"]
