"""Role masks over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.prepare import token_of, words_of


def role_masks(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, tokens, loss_mask): turns in order; 1 at the tokens of the role that is learned."""
    t = turns.select("conv_id", "turn", "role", F.transform(words_of(F.col("text")), token_of).alias("t"))
    mask = F.transform("t", lambda _: F.coalesce(F.col("role") == learn, F.lit(False)).cast("tinyint"))
    g = t.withColumn("m", mask).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "t", "m"))).alias("r"))
    return g.select("conv_id", F.flatten("r.t").alias("tokens"), F.flatten("r.m").alias("loss_mask"))
