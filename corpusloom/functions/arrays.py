"""Array, rounding and string functions over columns; native unless said otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def asum(x: Column) -> Column:
    """Sum of an array in double precision; 0 if empty."""
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))


def each(value: Column, x: Column) -> Column:
    """``value`` as often as ``x`` is long: within a lambda it would be computed anew for every element."""
    return F.array_repeat(value, F.greatest(F.size(x), F.lit(0)))


def lp_to_prob(logprobs: Column) -> Column:
    """Probabilities of natural-log probabilities."""
    return F.transform(logprobs, lambda v: F.exp(v.cast("double")))


def tail_mass(probs: Column) -> Column:
    """Mass outside the listed probabilities, between 0 and 1. It is never rebuilt from rounded values."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - asum(probs)))


def round_to(x: Column, mantissa: int, least_exponent: int) -> Column:
    """Round to a binary float of ``mantissa`` bits; half goes to even, small values are subnormal."""
    v = x.cast("double")
    e = F.greatest(F.floor(F.log2(F.abs(v))), F.lit(least_exponent))
    scale = F.pow(F.lit(2.0), F.lit(mantissa) - e)
    return F.when(v == 0, v).otherwise(F.rint(v * scale) / scale)


def fp16(x: Column) -> Column:
    """Half precision; values that round above 65504 are infinite."""
    v = x.cast("double")
    return F.when(F.abs(v) >= 65520, F.signum(v) * F.lit(float("inf"))).otherwise(round_to(x, 10, -14))


def bf16(x: Column) -> Column:
    return round_to(x, 7, -126)


def int8_blocks(values: Column, block: int) -> Column:
    """Blocks of an array as (scale, q): scale is the largest size over 127, q the nearest even byte."""
    v = F.transform(values, lambda x: x.cast("double"))
    starts = F.sequence(F.lit(0), F.ceil(F.size(values) / block).cast("int") - 1)
    cut = lambda i: F.slice(v, i * block + 1, block)
    scale = lambda b: F.greatest(F.array_max(F.transform(b, F.abs)), F.lit(1e-12)) / 127
    blocks = F.transform(starts, lambda i: F.struct(scale(cut(i)).alias("scale"), cut(i).alias("v")))
    done = F.transform(blocks, lambda b: F.struct(b["scale"].alias("scale"), F.transform(b["v"], lambda x: F.rint(x / b["scale"]).cast("int")).alias("q")))
    return F.when(F.size(values) > 0, done)


def dequantize(blocks: Column) -> Column:
    return F.flatten(F.transform(blocks, lambda b: F.transform(b["q"], lambda q: q * b["scale"])))


def gold_shift(tokens: Column) -> Column:
    """The next token at each place; the last place gets the first token and is masked elsewhere."""
    return F.concat(F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), F.slice(tokens, 1, 1))


def last_mask(tokens: Column) -> Column:
    """1 at all places but the last."""
    n = F.size(tokens)
    return F.transform(tokens, lambda _, i: (i < n - 1).cast("int"))


def temp_softmax(logits: Column, temperature: float) -> Column:
    """Softmax of logits over a temperature, shifted by the largest."""
    z = F.transform(logits, lambda v: v.cast("double") / temperature)
    shifted = F.zip_with(z, each(F.array_max(z), z), lambda v, top: F.exp(v - top))
    return F.zip_with(shifted, each(asum(shifted), shifted), lambda v, total: v / total)


def dot(a: Column, b: Column) -> Column:
    return asum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def canon_string(text: Column) -> Column:
    """Compatibility-composed, case-folded text. Spark has no such function, so this runs in Python over
    batches; apply it to distinct strings only."""

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())

    return fold(text)
