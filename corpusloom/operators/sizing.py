"""Size-bounded files, budgets and roll-ups over manifests."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import materialize, merge_join, small_join


#: What a stretch of documents does to the size of the file that is open before it: for sizes up to ``upto``
#: (and above the cell before), ``starts`` new files begin, and the open file then has ``size`` bytes, or that
#: much more than before if ``more``.
CELLS = "array<struct<upto:long,starts:long,size:long,more:boolean>>"
_EVER = (1 << 63) - 1


def _jumps(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums, and for a file that begins at each document the one at which the next begins (or the end)."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    n = len(sizes)
    full = np.searchsorted(sums[1:], sums[:n] + limit, "right")
    some = np.searchsorted(sums, sums[:n], "right")  # a file of no bytes is never closed
    return sums, np.minimum(np.maximum(full, some), n)


def _stretch_cells(sizes: np.ndarray, limit: int) -> list[dict]:
    """Cells of consecutive documents, for every size that a file may have before them."""
    sums, jump = _jumps(sizes, limit)
    n = len(sizes)
    starts, last = np.ones(n + 1, np.int64), np.arange(n + 1)
    starts[n] = 0
    for j in range(n - 1, -1, -1):
        if jump[j] < n:
            starts[j], last[j] = starts[jump[j]] + 1, last[jump[j]]
    ends = lambda j: (int(starts[j]), int(sums[n] - sums[last[j]]), False) if j < n else (0, int(sums[n]), True)
    # no bytes before: the first document that would not fit beside earlier ones
    empty = max(int(np.searchsorted(sums[1:], limit, "right")), int(np.searchsorted(sums, 0, "right")))
    cells = [(0, *ends(min(empty, n)))]
    for j in range(n, -1, -1):
        upto = limit - int(sums[j]) if j else _EVER
        if upto > cells[-1][0]:
            cells.append((upto, *ends(j)))
    return _merged(cells)


def _merged(cells: list[tuple]) -> list[dict]:
    out: list[tuple] = []
    for c in cells:
        if out and out[-1][1:] == c[1:]:
            out[-1] = c
        else:
            out.append(c)
    return [dict(zip(("upto", "starts", "size", "more"), c)) for c in out]


def _at(cells: list[dict], size: int) -> tuple[int, int]:
    """(new files, size of the open file) behind a stretch."""
    c = cells[bisect.bisect_left(cells, size, key=lambda x: x["upto"])]
    return int(c["starts"]), int(c["size"]) + (size if c["more"] else 0)


def _composed(a: list[dict], b: list[dict]) -> list[dict]:
    """Cells of one stretch after another."""
    cells, low = [], -1
    for x in a:
        if not x["more"]:
            starts, size = _at(b, x["size"])
            cells.append((int(x["upto"]), int(x["starts"]) + starts, size, False))
        else:
            for y in b:
                upto = min(int(x["upto"]), int(y["upto"]) - int(x["size"]) if y["upto"] < _EVER else _EVER)
                if upto > low:
                    cells.append((upto, int(x["starts"]) + int(y["starts"]), int(y["size"]) + (int(x["size"]) if y["more"] else 0), bool(y["more"])))
                    low = upto
        low = int(x["upto"])
    return _merged(cells)


def assign_files(rows: DataFrame, limit: int) -> DataFrame:
    """(shard_id, doc_id, bytes, file_no) of (shard_id, doc_id, bytes): greedy in the order of ids.

    A new file begins when the next document would exceed ``limit`` and the file has bytes. The rule looks at
    one document after the other, yet a shard of any size takes many tasks: documents are dealt by ranges,
    and what a range does to each size that a file may have before it is a short list of cells, found with
    jumps from a file's first document to the next file's (binary searches in prefix sums). Lists of
    neighbouring ranges are composed two by two, up to one list for each shard; on the way back each
    range learns the size and the number of the file that it begins in. Null sizes are 0; equal ids are in
    the order of their sizes.
    """
    spark = rows.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = rows.select("shard_id", "doc_id", F.coalesce(F.col("bytes").cast("bigint"), F.lit(0)).alias("bytes"))
    ranges = materialize(d.repartitionByRange(n, "shard_id", "doc_id", "bytes").withColumn("node", F.spark_partition_id().cast("bigint")), "sized")

    def cells_of(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        sizes = part.sort_values(["doc_id", "bytes"])["bytes"].to_numpy(np.int64)
        return pd.DataFrame({"shard_id": [key[0]], "node": [key[1]], "cells": [_stretch_cells(sizes, limit)]})

    def compose(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([list(a) if b is None else _composed(list(a), list(b)) for a, b in zip(left, right)], dtype=object)

    def behind(cells: pd.Series, size: pd.Series, no: pd.Series) -> pd.DataFrame:
        got = [_at(list(x), int(s)) for x, s in zip(cells, size)]
        return pd.DataFrame({"size": [g[1] for g in got], "no": [int(k) + g[0] for k, g in zip(no, got)]})

    schema = f"shard_id string, node long, cells {CELLS}"
    levels = [materialize(ranges.groupBy("shard_id", "node").applyInPandas(cells_of, schema), "file-cells")]
    pair = F.pandas_udf(compose, CELLS)
    for _ in range((n - 1).bit_length()):
        two = levels[-1].groupBy("shard_id", F.expr("node div 2").alias("node")).agg(F.sort_array(F.collect_list(F.struct("node", "cells"))).alias("c"))
        levels.append(materialize(two.select("shard_id", "node", pair(F.get("c.cells", F.lit(0)), F.get("c.cells", F.lit(1))).alias("cells")), "file-cells"))
    entry = levels[-1].select(F.col("shard_id").alias("__s"), F.col("node").alias("__n"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("no"))
    step = F.pandas_udf(behind, "size long, no long")
    for low in reversed(levels[:-1]):
        # a range without a left neighbour begins as the pair does, one with it as that leaves the file
        j = merge_join(low, entry, F.col("shard_id").eqNullSafe(F.col("__s")) & (F.expr("node div 2") == F.col("__n")))
        other = j.select(F.col("shard_id").alias("__o"), (F.col("node") + 1).alias("__m"), step("cells", "size", "no").alias("behind")).where("__m % 2 = 1")
        j = merge_join(j.drop("cells"), other, F.col("shard_id").eqNullSafe(F.col("__o")) & (F.col("node") == F.col("__m")), "left")
        entry = materialize(j.select(F.col("shard_id").alias("__s"), F.col("node").alias("__n"), F.coalesce("behind.size", "size").alias("size"), F.coalesce("behind.no", "no").alias("no")), "file-entries")

    def number(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "bytes"])
        sizes, before = part["bytes"].to_numpy(np.int64), int(part["size"].iloc[0])
        sums, jump = _jumps(sizes, limit)
        new = np.zeros(len(sizes), np.int64)
        j = max(int(np.searchsorted(sums[1:], limit - before, "right")), 0 if before else int(np.searchsorted(sums, 0, "right")))
        while j < len(sizes):
            new[j], j = 1, int(jump[j])
        return part[["shard_id", "doc_id", "bytes"]].assign(file_no=part["no"] + np.cumsum(new))

    whole = merge_join(ranges, entry, F.col("shard_id").eqNullSafe(F.col("__s")) & (F.col("node") == F.col("__n"))).select("shard_id", "doc_id", "bytes", "node", "size", "no")
    return whole.groupBy("shard_id", "node").applyInPandas(number, "shard_id string, doc_id bigint, bytes bigint, file_no bigint")


def num_sequences(manifest: DataFrame, length: int) -> DataFrame:
    """Full windows of ``length`` over all shards."""
    return manifest.agg(F.coalesce(F.sum(F.floor(F.col("total_tokens") / length)), F.lit(0)).cast("bigint").alias("sequences"))


def epoch_budget(manifest: DataFrame, length: int, batch: int, accum: int) -> DataFrame:
    one = manifest.agg(F.sum("total_tokens").alias("tokens"), F.sum(F.floor(F.col("total_tokens") / length)).cast("bigint").alias("windows"))
    return one.withColumn("steps", F.expr(f"windows div {batch * accum}"))


def provenance(manifest: DataFrame, by: list[str]) -> DataFrame:
    return manifest.groupBy(*by).agg(F.count(F.lit(1)).alias("shards"), F.sum("num_documents").alias("documents"), F.sum("total_tokens").alias("tokens"))


def slice_alpha(windows: DataFrame, manifest: DataFrame, alpha: float) -> DataFrame:
    """Windows with their shard's own mixing weight, else the run's. One manifest row for each shard."""
    return small_join(windows, manifest.select("shard_id", "alpha_override"), "shard_id", "left").withColumn("alpha", F.coalesce("alpha_override", F.lit(alpha))).drop("alpha_override")
