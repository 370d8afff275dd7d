"""Ranks and prefix sums of ordered groups of any size, in two levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.runtime import materialize, merge_join


def ordered_sums(rows: DataFrame, groups: list[str], order: list, sums: list[str] | tuple[str, ...] = (), rank: str = "rank") -> DataFrame:
    """``rows`` with ``rank`` (from 0) and, for each column of ``sums``, ``<name>_before`` (exclusive sum),
    within ``groups`` (may be none) in the order of ``order``.

    No task holds a group: rows are dealt by ranges of (groups, order), each range is summed, the sums
    of ranges before are taken over one row for each range and group, and ranks within a range are
    added. The dealt rows are written once, so that a lost executor cannot deal them anew. Rows that
    tie in ``order`` share a range; put a tie breaker last. ``rows`` should hold keys and numbers only;
    ``sums`` are whole numbers.
    """
    spark = rows.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(g) for g in groups]
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    dealt = materialize(rows.repartitionByRange(n, *keys, *order).withColumn("__range", F.spark_partition_id()), "ordered")
    per = dealt.groupBy(*groups, "__range").agg(F.count(F.lit(1)).alias("__n"), *[F.coalesce(F.sum(s), F.lit(0)).alias(f"__s_{s}") for s in sums])
    # one row for each range and group: a window of at most as many rows as there are ranges
    before = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1) if groups else Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(*[F.col(g).alias(f"__g_{g}") for g in groups], F.col("__range").alias("__r"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).cast("bigint").alias(f"__b{c}") for c in ("__n", *[f"__s_{s}" for s in sums])])
    within = Window.partitionBy(*groups, "__range").orderBy(*order)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    d = dealt.withColumns({"__k": F.row_number().over(within) - 1, **{f"__w_{s}": F.coalesce(F.sum(s).over(earlier), F.lit(0)) for s in sums}})
    same = F.col("__range") == F.col("__r")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    d = merge_join(d, base, same)
    out = {rank: (F.col("__k") + F.col("__b__n")).cast("bigint"), **{f"{s}_before": (F.col(f"__w_{s}") + F.col(f"__b__s_{s}")).cast("bigint") for s in sums}}
    return d.withColumns(out).select(*rows.columns, *out)


def ordered_lag(rows: DataFrame, groups: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``rows`` with ``out``: ``value`` of the row before within ``groups`` in the order of ``order``, null for the first.

    Rows are dealt by ranges; the first row of a range looks at the last one of the range before, of which
    there is one for each range and group. Put a tie breaker last in ``order``.
    """
    spark = rows.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(g) for g in [*groups, *order]]
    dealt = materialize(rows.repartitionByRange(n, *keys).withColumn("__range", F.spark_partition_id()), "ordered")
    last = F.max(F.struct(*[F.col(o).alias(f"o{k}") for k, o in enumerate(order)], F.col(value).alias("v")))
    ends = dealt.groupBy(*[F.col(g).alias(f"__g_{g}") for g in groups], F.col("__range").alias("__r")).agg(last.alias("last"))
    before = ends.withColumn("__before", F.lag("last.v").over(Window.partitionBy(*[f"__g_{g}" for g in groups]).orderBy("__r"))).drop("last")
    within = Window.partitionBy(*groups, "__range").orderBy(*order)
    d = dealt.withColumns({"__k": F.row_number().over(within), "__w": F.lag(value).over(within)})
    same = F.col("__range") == F.col("__r")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    return merge_join(d, before, same).withColumn(out, F.when(F.col("__k") == 1, F.col("__before")).otherwise(F.col("__w"))).select(*rows.columns, out)
