"""Canonical vocabularies, n-gram addresses, unique rows and touch counters."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.hashing import DOMAIN, GOLD, affine, const64, mul64, multiplier, signed, umod
from corpusloom.operators.prefix import ordered_sums
from corpusloom.runtime import materialize, merge_join, small_join
from corpusloom.sources.files import exists, names, put_json


def canon_map(vocab: DataFrame, canon: Column) -> DataFrame:
    """``vocab`` (token_id, text) with ``canon_id``: the smallest id of its canonical string."""
    return vocab.withColumn("__c", canon).withColumn("canon_id", F.min("token_id").over(Window.partitionBy("__c"))).drop("__c")


def canon_stats(canon: DataFrame, canon_text: Column) -> DataFrame:
    """(vocab, classes, merged, empty): ids, classes, ids merged away, size of the empty string's class."""
    one = canon.agg(F.count(F.lit(1)).alias("vocab"), F.countDistinct("canon_id").alias("classes"), F.sum((canon_text == "").cast("long")).alias("empty"))
    return one.select("vocab", "classes", (F.col("vocab") - F.col("classes")).alias("merged"), F.coalesce("empty", F.lit(0)).alias("empty"))


def canon_sha256(canon: DataFrame) -> DataFrame:
    """SHA-256 of the canonical ids as little-endian unsigned 32-bit integers, in the order of token ids.

    One row of four bytes for each id of a bounded vocabulary.
    """
    le = F.concat(*[F.substring(F.lpad(F.hex("canon_id"), 8, "0"), k, 2) for k in (7, 5, 3, 1)])
    rows = F.sort_array(F.collect_list(F.struct("token_id", le.alias("x"))))
    return canon.agg(F.sha2(F.unhex(F.array_join(F.transform(rows, lambda r: r["x"]), "")), 256).alias("sha256"))


def apply_canon(rows: DataFrame, canon: DataFrame, token: str) -> DataFrame:
    """``rows`` with ``canon_id`` of their token; the map is broadcast if it is small."""
    m = canon.select(F.col("token_id").alias("__t"), "canon_id")
    return small_join(rows, m, F.col(token) == F.col("__t"), "left").drop("__t")


def unigram_address(canon_id: Column, head: int, modulus: int, domain: str = DOMAIN) -> Column:
    """(A * c + B) mod M: one-to-one on ids below M."""
    a, b = affine(head, modulus, domain)
    return F.pmod(F.lit(a).cast("long") * canon_id + F.lit(b % modulus), F.lit(modulus).cast("long"))


def windowed(windows: DataFrame, orders: int) -> DataFrame:
    """(shard_id, window_id, pos, c0, c1, ...): positions of ``windows`` (tokens as canonical ids) with the
    ids before them, 0 where the window begins later.

    Contexts are taken by place from the window's own array; document ends are not looked at.
    """
    back = [F.col("tokens") if k == 0 else F.slice(F.concat(F.array_repeat(F.lit(0).cast("bigint"), k), F.col("tokens")), F.lit(1), F.size("tokens")) for k in range(orders)]
    z = F.arrays_zip(*[x.alias(f"c{k}") for k, x in enumerate(back)])
    return windows.select("shard_id", "window_id", F.posexplode(z).alias("pos", "z")).select("shard_id", "window_id", "pos", "z.*")


def ngram_address(ids: list[Column], order: int, head: int, modulus: int, domain: str = DOMAIN) -> Column:
    """Address of ``order`` ids, oldest first.

    state = (state xor (c + GOLD)) * mul modulo 2**64, from a seed; the row is the unsigned state
    modulo ``modulus``. The fold keeps the expression as small as one step of it.
    """
    seed, mul = signed(const64(order, head, "seed", domain)), multiplier(order, head, domain)
    return F.aggregate(F.array(*ids), F.lit(seed).cast("long"), lambda s, x: mul64(s.bitwiseXOR(x + F.lit(signed(GOLD))), mul), lambda s: umod(s, modulus))


def valid(pos: Column, order: int) -> Column:
    """An order is valid from the position within the window that has all of its ids."""
    return pos >= order - 1


def address_batch(windows: DataFrame, moduli: dict[tuple[int, int], int], domain: str = DOMAIN) -> DataFrame:
    """(shard_id, window_id, pos, c0, c1, ..., addresses): an array of (order, head, row_id, valid) for each position.

    """
    orders = max(o for o, _ in moduli)
    d = with_addresses(windowed(windows, orders), moduli, domain)
    return d.select("shard_id", "window_id", "pos", *[f"c{k}" for k in range(orders)], "addresses")


def with_addresses(d: DataFrame, moduli: dict[tuple[int, int], int], domain: str = DOMAIN) -> DataFrame:
    """Rows of ids (c0, c1, ...) with ``addresses``: an array of (order, head, row_id, valid); without ``pos`` all are valid.

    Each step of the hash is a column of its own projection, which compiles; the fold does not.
    """
    before, orders = d.columns, max(o for o, _ in moduli)
    many = sorted((o, h) for o, h in moduli if o > 1)
    d = d.withColumns({f"__s_{o}_{h}": F.lit(signed(const64(o, h, "seed", domain))).cast("long") for o, h in many})
    for k in range(orders - 1, -1, -1):
        now = [(o, h) for o, h in many if o > k]
        d = d.withColumns({f"__x_{o}_{h}": F.col(f"__s_{o}_{h}").bitwiseXOR(F.col(f"c{k}") + F.lit(signed(GOLD))) for o, h in now})
        d = d.withColumns({f"__s_{o}_{h}": mul64(F.col(f"__x_{o}_{h}"), multiplier(o, h, domain)) for o, h in now})
    rows = []
    for (order, head), m in sorted(moduli.items()):
        row = unigram_address(F.col("c0"), head, m, domain) if order == 1 else umod(F.col(f"__s_{order}_{head}"), m)
        rows.append(F.struct(F.lit(order).alias("order"), F.lit(head).alias("head"), row.alias("row_id"), (valid(F.col("pos"), order) if "pos" in before else F.lit(True)).alias("valid")))
    return d.select(*before, F.array(*rows).alias("addresses"))


def gram_addresses(windows: DataFrame, moduli: dict[tuple[int, int], int], domain: str = DOMAIN) -> DataFrame:
    """(order, head, gram, row_id) of the distinct n-grams of ``windows``; ``gram`` holds the ids, 0 beyond its order.

    Positions meet once, as distinct n-grams of the largest order and without heads; those of lower orders are
    taken from these, and only what is distinct is hashed.
    """
    orders = max(o for o, _ in moduli)
    ids = [f"c{k}" for k in range(orders)]
    longest = materialize(windowed(windows, orders).select(*ids).distinct(), "longest-grams")
    out = []
    for order in sorted({o for o, _ in moduli}):
        d = longest if order == orders else longest.select(*ids[:order]).distinct()
        d = d.select(*ids[:order], *[F.lit(0).cast("bigint").alias(n) for n in ids[order:]])
        a = with_addresses(d, {k: m for k, m in moduli.items() if k[0] == order}, domain)
        out.append(long_addresses(a).select("order", "head", F.struct(*ids).alias("gram"), "row_id"))
    return reduce(DataFrame.unionByName, out)


def long_addresses(batch: DataFrame) -> DataFrame:
    """A row for each address of a batch, with the other columns of its position.

    From a plain explode the optimiser makes a filter and writes the whole hash into it, step in step.
    """
    rest = [n for n in batch.columns if n != "addresses"]
    return batch.select(*rest, F.explode_outer("addresses").alias("a")).select(*rest, "a.*")


def unique_inverse(addresses: DataFrame, batch_key: list[str]) -> DataFrame:
    """Addresses with ``inverse``: the place of the row among the batch's distinct rows of the table.

    Distinct rows are ranked over ranges, so a batch of any size takes many tasks. Addresses meet the ranks
    where they lie, without a shuffle, unless there are very many.
    """
    keys = [*batch_key, "order", "head"]
    uniq = ordered_sums(addresses.select(*keys, "row_id").distinct(), keys, ["row_id"], rank="inverse")
    return small_join(addresses, uniq, [*keys, "row_id"])


def touch_counts(addresses: DataFrame, batch_key: list[str]) -> DataFrame:
    """(order, head, row_id, touches): batches that address a row, also at invalid positions."""
    return addresses.select(*batch_key, "order", "head", "row_id").distinct().groupBy("order", "head", "row_id").agg(F.count(F.lit(1)).alias("touches"))


def touch_histogram(touches: DataFrame) -> DataFrame:
    return touches.groupBy("order", "head").agg(F.count(F.lit(1)).alias("rows"), F.sum("touches").alias("touches"))


def collision_report(grams: DataFrame) -> DataFrame:
    """(order, head, grams, rows, collided): distinct n-grams, their rows, and n-grams that share one.

    ``grams`` holds distinct (order, head, gram, row_id).
    """
    per = grams.groupBy("order", "head", "row_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("order", "head").agg(F.sum("n").alias("grams"), F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("collided"))


def head_overlap(grams: DataFrame) -> DataFrame:
    """(order, head_a, head_b, grams, collided_a, collided_b, both, chance): whether heads collide apart.

    ``grams`` holds distinct (order, head, gram, row_id). A gram has a bit for each head of its order in
    which it shares its row with another gram; patterns of bits are counted, and pairs of heads are read
    off the few patterns. Rows that are shared, of which a table has at most as many as its modulus, are
    looked up without a shuffle of grams. ``chance`` is how many grams would collide in both if heads were independent.
    """
    shared = grams.groupBy("order", "head", "row_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("order", "head", "row_id", F.lit(True).alias("shared"))
    bit = F.when(F.col("shared"), F.expr("shiftleft(1L, cast(head AS INT))")).otherwise(F.lit(0).cast("long"))
    marked = small_join(grams, shared, ["order", "head", "row_id"], "left").groupBy("order", "gram").agg(F.sum(bit).alias("bits"))
    patterns = marked.groupBy("order", "bits").agg(F.count(F.lit(1)).alias("n"))
    heads = grams.select("order", "head").distinct()
    a, b = (heads.select("order", F.col("head").cast("int").alias(f"head_{x}")) for x in "ab")
    # a row for each two heads of an order, and one for each pattern of their bits
    pairs = small_join(small_join(patterns, a, "order"), b, "order").where("head_a < head_b")
    on = lambda h: F.expr(f"(shiftright(bits, {h}) & 1) = 1")
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    g = pairs.groupBy("order", "head_a", "head_b").agg(F.sum("n").alias("grams"), n(on("head_a")).alias("collided_a"), n(on("head_b")).alias("collided_b"), n(on("head_a") & on("head_b")).alias("both"))
    return g.withColumn("chance", F.col("collided_a") * F.col("collided_b") / F.col("grams"))


def add_touches(path: str, addresses: DataFrame, batch_key: list[str]) -> int:
    """Count the batches of ``addresses`` into the counters kept in ``path``, each batch once for ever.

    Batches that an earlier call has counted are left out, so a run that begins again adds nothing twice.
    Counts and the keys of their batches are written to a folder of their own, which counts from the moment
    that its marker is there; one without is ignored. Returns the number of batches added.
    """
    spark = addresses.sparkSession
    done = _touch_runs(spark, path)
    new = addresses.select(*batch_key, "order", "head", "row_id")
    if done:  # a batch is one key: to meet by it would put all its addresses into one task
        new = small_join(new.distinct(), spark.read.parquet(*[f"{path}/{r}/batches" for r in done]), batch_key, "left_anti")
    run = uuid.uuid4().hex[:12]
    distinct = materialize(new.distinct() if not done else new, "touches-new")
    distinct.select(*batch_key).distinct().write.parquet(f"{path}/{run}/batches")
    touch_counts(distinct, batch_key).write.parquet(f"{path}/{run}/counts")
    added = spark.read.parquet(f"{path}/{run}/batches").count()
    put_json(spark, f"{path}/{run}/done.json", {"batches": added})
    return added


def _touch_runs(spark: SparkSession, path: str) -> list[str]:
    return [r for r in names(spark, path) if exists(spark, f"{path}/{r}/done.json")]


def read_touches(spark: SparkSession, path: str) -> DataFrame:
    """(order, head, row_id, touches) of all batches that ``path`` has counted; runs are merged as they are read."""
    d = spark.read.parquet(*[f"{path}/{r}/counts" for r in _touch_runs(spark, path)])
    return d.groupBy("order", "head", "row_id").agg(F.sum("touches").alias("touches"))
