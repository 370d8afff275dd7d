"""Running averages at every row of ordered groups of any size: a scan of affine maps in two levels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import materialize, merge_join


def affine_scan(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All prefixes of maps e -> a e + b, composed in the order of rows: each round reaches twice as far back."""
    a, b, step = a.copy(), b.copy(), 1
    while step < len(a):
        b[step:] += a[step:] * b[:-step]
        a[step:] = a[step:] * a[:-step]
        step *= 2
    return a, b


def _within_ranges(rows: DataFrame, group: str, value: str, decay: float) -> DataFrame:
    """Sorted ``rows`` with their partition (``__range``), values of the group so far in it (``__k``) and their average from 0 (``__b``)."""
    from pyspark import TaskContext
    from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, k, e = TaskContext.get().partitionId(), None, 0, 0.0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = batch.column(batch.schema.get_field_index(group)).dictionary_encode()
            code = np.asarray(key.indices.fill_null(-1))
            x = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype(float)
            has = np.asarray(batch.column(batch.schema.get_field_index(value)).is_valid())
            new = np.r_[True, code[1:] != code[:-1]]
            first = (key.dictionary[int(code[0])].as_py() if code[0] >= 0 else None,)
            new[0] = first != last
            at = np.flatnonzero(new)
            count = np.cumsum(has)
            base = np.zeros(n, np.int64)  # values of the batch before the row's group begins
            base[at] = np.r_[0, count][at]
            base = np.maximum.accumulate(base)
            a, b = affine_scan(np.where(new, 0.0, np.where(has, decay, 1.0)), np.where(has, (1 - decay) * np.where(has, x, 0.0), 0.0))
            head = int(at[0]) if len(at) else n  # rows of the group that an earlier batch began
            b[:head] += a[:head] * e
            ks = count - base
            ks[:head] += k
            last = (key.dictionary[int(code[-1])].as_py() if code[-1] >= 0 else None,)
            k, e = int(ks[-1]), float(b[-1])
            more = [pa.array(np.full(n, part, np.int32)), pa.array(ks.astype(np.int64)), pa.array(b)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "__range", "__k", "__b"])

    out = StructType(list(rows.schema.fields)).add("__range", IntegerType()).add("__k", LongType()).add("__b", DoubleType())
    return rows.mapInArrow(run, out)


def running_average(rows: DataFrame, group: str, order: list[str], value: str, decay: float = 0.9, reseed: bool = False, out: str = "ema") -> DataFrame:
    """``rows`` with ``out``: the moving average decay * e + (1 - decay) * x of ``value`` after each row of its group.

    The average begins with the group's first value, or anew with its second if ``reseed``; it is exact for
    any ``decay`` between 0 and 1. A null value leaves the average as it is, and before a group's first
    value it is null. Null groups are one group; put a tie breaker last in ``order``.

    A row is an affine map of the average before it, and maps compose. Rows are dealt by ranges of (group,
    order) and scanned as they stream by, from an average of 0; what a range does to its groups is one row
    for each, and those give the average that each range begins with: its share of a row's average is
    ``decay ** k`` after k values. So a group of any size takes many tasks, and no window looks back.
    """
    if not 0 < decay < 1:
        raise ValueError("decay must lie between 0 and 1")
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(group), *map(F.col, order)]
    dealt = rows.withColumn("__x", F.col(value).cast("double")).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    d = materialize(_within_ranges(dealt, group, "__x", decay), "scanned")
    has = F.col("__x").isNotNull()
    value_at = lambda k: F.max(F.when(has & (F.col("__k") == k), F.col("__x")))
    ends = d.groupBy(F.col(group).alias("__g"), F.col("__range").alias("__r")).agg(F.max("__k").alias("n"), F.max_by("__b", F.when(has, F.col("__k"))).alias("b"), value_at(1).alias("x1"), value_at(2).alias("x2"))

    def entries(parts: pd.Series) -> pd.Series:
        """For each range of a group: values before it, the average before it, and what its own values take for that average."""
        out = []
        for ranges in parts:
            e, before, got = None, 0, []
            for r in ranges:
                count, here = int(r["n"]), e
                if count and reseed and before == 0 and count > 1:
                    here = (r["x2"] - (1 - decay) * r["x1"]) / decay
                elif count and (before == 0 or reseed and before == 1):
                    here = r["x1"]
                got.append({"r": r["r"], "e": here, "last": e, "before": before})
                if count:
                    e = r["b"] + decay**count * here
                before += count
            out.append(got)
        return pd.Series(out, dtype=object)

    fold = F.pandas_udf(entries, "array<struct<r:int,e:double,last:double,before:long>>")
    per = ends.groupBy("__g").agg(F.sort_array(F.collect_list(F.struct(F.col("__r").alias("r"), "n", "b", "x1", "x2"))).alias("z"))  # at most one entry for each range
    starts = per.select("__g", F.explode(fold("z")).alias("s")).select("__g", F.col("s.r").alias("__r"), F.col("s.e").alias("__e"), F.col("s.last").alias("__last"), F.col("s.before").alias("__before"))
    j = merge_join(d, starts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__range") == F.col("__r")))
    whole = F.col("__b") + F.pow(F.lit(decay), F.col("__k")) * F.col("__e")
    first = F.coalesce(F.col("__x"), F.col("__b") / (1 - decay))
    now = F.when(F.col("__k") == 0, F.col("__last")).when(F.col("__before") + F.col("__k") == 1, first).otherwise(whole)
    return j.withColumn(out, now).select(*rows.columns, out)
