"""Measures over stored distributions and metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.prefix import ordered_lag, ordered_sums
from corpusloom.operators.scan import running_average
from corpusloom.runtime import merge_join


def kd_loss(teacher: DataFrame, student: DataFrame, alpha: float, temperature: float = 1.0) -> DataFrame:
    """(positions, loss): mean over unmasked positions of alpha * KD + (1 - alpha) * CE.

    ``teacher``: pos_id, topk_idx, topk_w, tail_w, gold, loss_mask, and ``n`` if a row stands for so many
    equal positions; ``student``: pos_id, token, logprob with a row for each listed candidate and the
    gold token. KD lumps what is outside the candidates: -sum w log p - tail * log(max(1 - sum p, 1e-12)).
    Another ``temperature`` than 1 needs a row for every token: log probabilities are divided by it
    and normalised anew. Without unmasked positions the loss is 0.
    """
    t = teacher.where("loss_mask = 1")
    t = t if "n" in t.columns else t.withColumn("n", F.lit(1))
    if temperature != 1.0:
        d = student.withColumn("z", F.col("logprob") / temperature)
        norm = d.groupBy("pos_id").agg(F.log(F.sum(F.exp("z"))).alias("norm"))
        student = merge_join(d, norm, "pos_id").select("pos_id", "token", (F.col("z") - F.col("norm")).alias("logprob"))
    long = t.select("pos_id", F.explode(F.arrays_zip("topk_idx", "topk_w")).alias("z")).select("pos_id", F.col("z.topk_idx").alias("token"), F.col("z.topk_w").alias("w"))
    per = merge_join(long, student, ["pos_id", "token"]).groupBy("pos_id").agg(F.sum(-F.col("w") * F.col("logprob")).alias("head"), F.sum(F.exp("logprob")).alias("p"))
    gold = merge_join(t.select("pos_id", F.col("gold").alias("token"), "tail_w", "n"), student, ["pos_id", "token"]).select("pos_id", "tail_w", "n", (-F.col("logprob")).alias("ce"))
    kd = F.col("head") - F.col("tail_w") * F.log(F.greatest(1 - F.col("p"), F.lit(1e-12)))
    d = merge_join(per, gold, "pos_id").select("n", (alpha * kd + (1 - alpha) * F.col("ce")).alias("x"))
    n = F.coalesce(F.sum("n"), F.lit(0)).cast("bigint")
    return d.agg(n.alias("positions"), (F.coalesce(F.sum(F.col("n") * F.col("x")), F.lit(0.0)) / F.greatest(n, F.lit(1))).alias("loss"))


def perplexity(nll: DataFrame, by: list[str]) -> DataFrame:
    """exp of the mean of ``nll`` over groups, weighted by ``n`` if there is one; groups without rows do not appear."""
    n = F.when(F.col("nll").isNotNull(), F.col("n") if "n" in nll.columns else F.lit(1))
    return nll.groupBy(*by).agg(F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("n"), F.exp(F.sum(F.col("nll") * n) / F.greatest(F.sum(n), F.lit(1))).alias("perplexity"))


def gold_ce_band(nll: DataFrame, doc: str, vocab: int) -> DataFrame:
    """(docs, ce, in_band): the mean over documents of their mean loss, and if it is below 0.75 ln V."""
    n = F.col("n") if "n" in nll.columns else F.lit(1)
    per = nll.groupBy(doc).agg((F.sum(F.col("nll") * n) / F.sum(n)).alias("m"))
    one = per.agg(F.count(F.lit(1)).alias("docs"), F.avg("m").alias("ce"))
    return one.withColumn("in_band", F.col("ce") < 0.75 * F.log(F.lit(float(vocab))))


def kl_divergence(student: DataFrame, teacher: DataFrame, weights: DataFrame) -> DataFrame:
    """(positions, kl): mean over positions of sum p_s (ln p_s - ln p_d).

    Both hold full distributions (ctx, token, p) of one support; ``weights`` (ctx, n) counts positions.
    """
    j = merge_join(student.select("ctx", "token", F.col("p").alias("ps")), teacher.select("ctx", "token", F.col("p").alias("pd")), ["ctx", "token"])
    per = merge_join(j.groupBy("ctx").agg(F.sum(F.col("ps") * (F.log("ps") - F.log("pd"))).alias("kl")), weights, "ctx")
    return per.agg(F.sum("n").alias("positions"), (F.sum(F.col("kl") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("kl"))


def entropy_far_mass(rows: DataFrame, bound: int) -> DataFrame:
    """(grp, entropy, far_mass) of (grp, query_pos, key_pos, p): means over queries of entropy and of the
    mass further back than ``bound``."""
    q = rows.groupBy("grp", "query_pos").agg(F.sum(-F.col("p") * F.log(F.col("p") + 1e-12)).alias("h"), F.sum(F.when(F.col("query_pos") - F.col("key_pos") > bound, F.col("p")).otherwise(0.0)).alias("far"))
    return q.groupBy("grp").agg(F.avg("h").alias("entropy"), F.avg("far").alias("far_mass"))


def needle_success(rows: DataFrame) -> DataFrame:
    """(length, depth, success) of (length, depth, token, logprob, is_needle): strictly above every other."""
    g = rows.groupBy("length", "depth").agg(F.max(F.when(F.col("is_needle"), F.col("logprob"))).alias("needle"), F.max(F.when(~F.col("is_needle"), F.col("logprob"))).alias("other"))
    return g.select("length", "depth", F.coalesce((F.col("needle") > F.col("other")) | (F.col("needle").isNotNull() & F.col("other").isNull()), F.lit(False)).alias("success"))


def needle_grid(success: DataFrame, depths: list) -> DataFrame:
    """One row for each length, a column for each depth."""
    return success.groupBy("length").pivot("depth", depths).agg(F.max(F.col("success").cast("int")))


def compare_tables(a: DataFrame, b: DataFrame, key: list[str], value: str, tolerance: float) -> DataFrame:
    """(matched, unmatched, max_abs, mean_abs, max_size, ok) of a numeric column of two tables."""
    j = a.select(*key, F.col(value).cast("double").alias("x")).join(b.select(*key, F.col(value).cast("double").alias("y")), key, "full_outer")
    d = F.abs(F.col("x") - F.col("y"))
    one = j.agg(F.count(d).alias("matched"), F.sum(F.when(d.isNull(), 1).otherwise(0)).alias("unmatched"), F.max(d).alias("max_abs"), F.avg(d).alias("mean_abs"), F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("max_size"))
    return one.withColumn("ok", F.coalesce((F.col("unmatched") == 0) & (F.col("max_abs") <= tolerance), F.lit(False)))


#: A line of the training log; fields as the log writes them.
STEP_LINE = r"^\[([^\]]+)\] \[(\w+)\] step (\d+)/(\d+) .*?loss ([-+0-9.eE]+)"


def parse_telemetry(lines: DataFrame) -> DataFrame:
    """(ts, level, step, steps, loss) of log lines with a step; other lines give no row."""
    g = lambda k: F.regexp_extract("value", STEP_LINE, k)
    rows = lines.where(F.col("value").rlike(STEP_LINE))
    return rows.select(F.to_timestamp(g(1), "yyyy-MM-dd HH:mm:ss").alias("ts"), g(2).alias("level"), g(3).try_cast("bigint").alias("step"), g(4).try_cast("bigint").alias("steps"), g(5).try_cast("double").alias("loss"))


def interval_rate(rows: DataFrame, key: str, ts: Column, order: list[str], amount: Column) -> DataFrame:
    """(rows with) ``rate``: amount over the seconds since the row before of the key, at least 1e-6."""
    d = ordered_lag(rows.withColumn("__t", ts), [key], order, "__t", "__last").withColumn("__d", F.col("__t") - F.col("__last"))
    return d.withColumn("rate", F.when(F.col("__d").isNotNull(), amount / F.greatest(F.col("__d"), F.lit(1e-6)))).drop("__t", "__d", "__last")


def step_progress(rows: DataFrame, run: str, step: str, steps: str, seconds: str, reseed: bool = False, decay: float = 0.9) -> DataFrame:
    """``rows`` with ``percent`` done, ``seconds_ema`` and ``eta``: the seconds that the steps left will take.

    The moving average begins with the run's first value, or anew with its second if ``reseed`` (a first step
    that compiles tells nothing). It is exact for any decay, and a run of any length takes many tasks.
    """
    d = running_average(rows, run, [step], seconds, decay, reseed, "seconds_ema").withColumn("percent", 100.0 * F.col(step) / F.col(steps))
    return d.withColumn("eta", F.greatest(F.col(steps) - F.col(step), F.lit(0)) * F.col("seconds_ema"))


def running_totals(per_step: DataFrame, run: str, step: str, columns: list[str]) -> DataFrame:
    """Running sums over a run's steps, of rows already summed by step; a run of any length takes many tasks."""
    d = ordered_sums(per_step, [run], [step], columns, rank="__rank")
    return d.select(*per_step.columns, *[(F.col(f"{c}_before") + F.col(c)).alias(f"total_{c}") for c in columns])
