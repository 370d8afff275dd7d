"""Bulk conversion: scored bundles to shards, committed file by file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.validate import chunk_tiling, wrong_gold
from corpusloom.runtime import Scratch, discard, new_dir
from corpusloom.schemas import SHARD
from corpusloom.sources.files import names, put_json, replace_folder
from corpusloom.sources.npz import bundle_faults, list_npz, read_npz, read_npz_documents, read_npz_headers
from corpusloom.sources.shards import shard_manifest

#: Bundles are converted together until they have so many bytes.
BATCH_BYTES = 4 << 30
REPORT = "file string, shard_id string, state string, reasons array<string>"


def shard_of(file: str) -> str:
    return file.removesuffix(".npz")


def committed(spark: SparkSession, out: str) -> set[str]:
    """Shards of ``out`` whose manifest row is there: the others are unfinished and are written again."""
    return {n.removesuffix(".json") for n in names(spark, f"{out}/manifest") if n.endswith(".json") and not n.startswith(".")}


def bundle_documents(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    """Shard documents of sound bundles, together by bundle and in order; nothing is shuffled."""
    held = read_npz_headers(spark, path, files).groupBy("file").agg(F.sum("bytes").alias("held")).collect()  # one row for each of these files
    shard = F.regexp_replace("file", "[.]npz$", "").alias("shard_id")
    return read_npz_documents(spark, path, {r["file"]: r["held"] for r in held}).select(shard, F.col("chunk").cast("bigint").alias("doc_id"), "tokens", "topk_idx", "topk_w", "tail_w", "loss_mask")


def faults_of(spark: SparkSession, path: str, files: list[str]) -> dict[str, list[str]]:
    """What is wrong with each of ``files``: its headers first, then its chunks, gold slots and mask."""
    bad = {r["file"]: list(r["faults"]) for r in bundle_faults(read_npz_headers(spark, path, files)).where(F.size("faults") > 0).collect()}
    sound = [f for f in files if f not in bad]
    if not sound:
        return bad
    bulk = read_npz(spark, path, files=sound, columns=["file", "token", "teacher_ids", "loss_mask"])
    count = lambda bad: F.sum(bad.cast("long"))
    with Scratch(spark) as scratch:  # bundles are read once for all that is asked of their positions
        per = scratch.table(bulk.groupBy("file").agg(F.count(F.lit(1)).alias("total"), count(~F.col("loss_mask").isin(0, 1)).alias("odd"), count(wrong_gold()).alias("wrong")), "checked")
        tiling = chunk_tiling(read_npz(spark, path, chunks=True, files=sound), per.select("file", "total")).where("faults > 0").select("file", F.lit("chunks do not tile the positions").alias("why"))
        gold = per.where("wrong > 0").select("file", F.lit("slot 0 is not the token").alias("why"))
        mask = per.where("odd > 0").select("file", F.lit("the mask is neither 0 nor 1").alias("why"))
        for r in tiling.unionByName(gold).unionByName(mask).collect():  # at most three rows for each of these files
            bad.setdefault(r["file"], []).append(r["why"])
    return bad


def commit(spark: SparkSession, staged: str, out: str, shard: str, row: dict) -> None:
    """Move a shard's folder to its place, then write its manifest row: from then on the shard counts."""
    replace_folder(spark, f"{staged}/shard_id={shard}", f"{out}/shards/shard_id={shard}")
    put_json(spark, f"{out}/manifest/{shard}.json", row)


def batches_of(files: list[str], sizes: dict[str, int], least: int, batch_bytes: int) -> list[list[str]]:
    """``files`` in order, at least ``least`` together (the last ones excepted) and as many as ``batch_bytes`` hold."""
    out, now, held = [], [], 0
    for f in files:
        if len(now) >= least and held + sizes[f] > batch_bytes:
            out.append(now)
            now, held = [], 0
        now.append(f)
        held += sizes[f]
    return [*out, now] if now else out


def bulk_convert(spark: SparkSession, path: str, out: str, vocab_size: int, files_per_batch: int = 64, commit: Callable = commit, batch_bytes: int = BATCH_BYTES, **provenance) -> DataFrame:
    """Convert the bundles of ``path`` that ``out`` lacks to shards; returns (file, shard_id, state, reasons).

    A bundle is ``skipped`` if its manifest row is there, ``rejected`` with reasons if its arrays, chunks or
    gold slots break the contract, else ``converted``: checked, moved by one row within its chunks, and
    written as a shard of its name. Bundles are taken at least ``files_per_batch`` at a time, and small ones
    together up to ``batch_bytes``, so the number of jobs follows bytes and not files. Their shards are written
    to a folder aside as they are read, without a shuffle or another copy, and each is then moved to its place
    and marked by its manifest row, last and at once. A run that dies leaves shards without a row at worst; the
    next run writes these anew, with the same rows.
    """
    files, done = list_npz(spark, path), committed(spark, out)
    report = [(f, shard_of(f), "skipped", []) for f in files if shard_of(f) in done]
    pending = [f for f in files if shard_of(f) not in done]
    for batch in batches_of(pending, files, files_per_batch, batch_bytes):
        bad = faults_of(spark, path, batch)
        report += [(f, shard_of(f), "rejected", sorted(bad[f])) for f in batch if f in bad]
        good = [f for f in batch if f not in bad]
        if not good:
            continue
        staged = new_dir(spark, "convert")
        bundle_documents(spark, path, good).sortWithinPartitions("shard_id", "doc_id").write.partitionBy("shard_id").parquet(staged)
        rows = {r["shard_id"]: r.asDict() for r in shard_manifest(spark.read.schema(SHARD).parquet(staged), vocab_size, **provenance).collect()}  # one for each of these files
        there = set(names(spark, staged))
        for f in good:
            shard = shard_of(f)
            if f"shard_id={shard}" in there:
                commit(spark, staged, out, shard, rows[shard])
                report.append((f, shard, "converted", []))
            else:
                report.append((f, shard, "rejected", ["no positions"]))
        discard(spark, staged)
    return spark.createDataFrame(sorted(report), REPORT)
