"""MinHash near-dedup: fast similarity sketches, banding, exact verification and components."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.runtime import Scratch, materialize, merge_join, table

#: Bands of rows. A pair of similarity 0.8 shares none of 32 bands of 4 with a chance of 5e-8.
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS

_U = np.uint64
#: Odd constants of the 64-bit finaliser (SplitMix64).
_M1, _M2, _GOLD = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


class _WordHashes(dict):
    """64-bit hashes of words; at most ``cap`` are kept."""

    cap = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.cap:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


class Shingler:
    """Sets of hashed shingles: sorted distinct 64-bit hashes of ``size`` neighbouring words."""

    def __init__(self, size: int):
        self.size, self.memo = size, _WordHashes()

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []  # of bytes: A-Z, and the six white-space characters
        if not words:
            return np.empty(0, _U)
        h = np.fromiter(map(self.memo.__getitem__, words), _U, len(words))
        k = min(self.size, len(h))
        n = len(h) - k + 1
        with np.errstate(over="ignore"):
            x = np.full(n, k, _U)
            for j in range(k):
                x = x * _GOLD + h[j : j + n]
                x ^= x >> _U(29)
            return np.unique(mix(x))


_SEEDS = mix((np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64)) * _GOLD)


def sketch(items: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketch of a set of 64-bit hashes: ``t`` values, equal with the chance of similarity.

    In each of up to ``t`` rounds every item gets a fresh hash, falls into one bin by it and leaves its
    value; earlier rounds have smaller values. In ``t`` more rounds, round ``t + b`` puts all items in
    bin ``b``, so that every bin fills. Rounds end once all bins are full, which takes one or two for
    sets much larger than ``t``.
    """
    full = np.iinfo(np.uint64).max
    out = np.full(t, full, _U)
    low = _U(54)  # the round in the upper bits, 54 bits of hash below
    step = max(1, 4096 // len(items))
    with np.errstate(over="ignore"):
        for r in range(0, t, step):
            rounds = np.arange(r, min(t, r + step))
            h = mix(items[None, :] ^ _SEEDS[rounds][:, None])
            bins = ((h >> _U(32)) * _U(t)) >> _U(32)
            np.minimum.at(out, bins.ravel().astype(np.int64), ((rounds.astype(np.uint64) << low)[:, None] | (mix(h) >> _U(10))).ravel())
            if not (out == full).any():
                return out
        for b in np.flatnonzero(out == full):
            out[b] = (_U(t + b) << low) | (mix(mix(items ^ _SEEDS[t + b])) >> _U(10)).min()
    return out


def band_keys(s: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash for each band of a sketch; the band's number is part of it."""
    rows = s.reshape(bands, -1)
    with np.errstate(over="ignore"):
        x = np.arange(1, bands + 1, dtype=np.uint64) * _GOLD
        for j in range(rows.shape[1]):
            x = mix(x ^ rows[:, j]) + _GOLD
    return x.view(np.int64)


SIGNATURE = "doc_id long, n long, bytes long, d1 long, d2 long, bands array<long>, sketch binary"


def signatures(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: set size, bytes of text, 128-bit digest of the set, band keys and the sketch's low bytes (none for an empty set)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        sets = Shingler(shingle)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = part.column(1).to_pylist()
                got = [sets(x) for x in texts]
                made = [sketch(x) if len(x) else None for x in got]
                digest = [np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), "<i8") for x in got]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column(0),
                    "n": pa.array([len(x) for x in got], pa.int64()),
                    "bytes": pa.array([len(x or b"") for x in texts], pa.int64()),
                    "d1": pa.array([int(d[0]) for d in digest], pa.int64()),
                    "d2": pa.array([int(d[1]) for d in digest], pa.int64()),
                    "bands": pa.array([[] if x is None else band_keys(x) for x in made], pa.list_(pa.int64())),
                    "sketch": pa.array([b"" if x is None else x.astype(np.uint8).tobytes() for x in made], pa.binary()),
                })

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(sign, SIGNATURE)


class _Sets:
    """Sets of texts by their digest, so that rows which share an id keep their own; the last ``cap`` bytes of texts are remembered."""

    def __init__(self, shingle: int, cap: int = 16 << 20):
        self.sets, self.cap, self.held, self.kept = Shingler(shingle), cap, 0, OrderedDict()

    def __call__(self, text: bytes | None) -> np.ndarray:
        import xxhash

        key = xxhash.xxh3_128_digest(text or b"")
        if key in self.kept:
            self.kept.move_to_end(key)
        else:
            self.kept[key] = (self.sets(text), len(text or b""))
            self.held += len(text or b"")
            while self.held > self.cap and len(self.kept) > 1:
                self.held -= self.kept.popitem(last=False)[1][1]
        return self.kept[key][0]


def verify(pairs: DataFrame, texts: DataFrame, shingle: int, least: tuple[int, int]) -> DataFrame:
    """Of pairs (a, b), those whose full sets have similarity ``least[0] / least[1]`` or more.

    An id with several texts links by any of them.
    """
    both = merge_join(pairs, texts.withColumnsRenamed({"doc_id": "a", "text": "ta"}), "a")
    both = merge_join(both, texts.withColumnsRenamed({"doc_id": "b", "text": "tb"}), "b").select("a", "b", "ta", "tb")
    num, den = least

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Sets(shingle)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                a, b, ta, tb = (c.to_pylist() for c in batch.slice(k, 256).columns)
                good = []
                for i, j, x, y in zip(a, b, ta, tb):
                    p, q = of(x), of(y)
                    same = len(np.intersect1d(p, q, assume_unique=True))
                    if same and den * same >= num * (len(p) + len(q) - same):
                        good.append((i, j))
                yield pa.RecordBatch.from_pydict({"a": pa.array([g[0] for g in good], pa.int64()), "b": pa.array([g[1] for g in good], pa.int64())})

    return both.mapInArrow(check, "a long, b long").distinct()


#: Members of a bucket that one block holds at most, and bytes of their texts on average; rows of a tile within it.
BLOCK, BLOCK_BYTES, TILE = 2048, 16 << 20, 256
#: Rows and bytes of texts that one call of Python takes on average.
CALL, CALL_BYTES = 4000, 32 << 20
#: Buckets of more than a block that are still in several components are asked for fresh centres first, at
#: most so many times.
LARGE, ROUNDS = BLOCK, 3


def intersections(p: list[np.ndarray], q: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of each set of ``p`` with each of ``q``, as products of 0/1 matrices."""
    out = np.zeros((len(p), len(q)), np.float32)
    x, y = np.concatenate(p), np.concatenate(q)
    both = np.intersect1d(x, y)
    at = [np.repeat(np.arange(len(z)), [len(v) for v in z]) for z in (p, q)]
    cols = []
    for v in (x, y):
        k = np.minimum(np.searchsorted(both, v), max(0, len(both) - 1))
        cols.append(np.where(both[k] == v, k, -1) if len(both) else np.full(len(v), -1))
    for c in range(0, len(both), width):
        mats = []
        for rows, col, n in zip(at, cols, (len(p), len(q))):
            m = np.zeros((n, min(width, len(both) - c)), np.float32)
            here = (col >= c) & (col < c + width)
            m[rows[here], col[here] - c] = 1
            mats.append(m)
        out += mats[0] @ mats[1].T
    return out


def least_agreement(least: tuple[int, int]) -> float:
    """Coordinates that two sketches share at least, six standard deviations below the mean at the threshold.

    A pair at the threshold falls below with a chance of about 1e-9.
    """
    p = least[0] / least[1]
    return COORDINATES * p - 6 * (COORDINATES * p * (1 - p)) ** 0.5


def compare_blocks(rest: DataFrame, sketches: DataFrame, texts: DataFrame, shingle: int, least: tuple[int, int], tmp: Scratch) -> DataFrame:
    """Links (a, b) between components of ``rest`` (key, rep, n, bytes, comp, big) whose members share a bucket.

    ``big`` members are those of a bucket's main component: they are compared with the others only.
    Members of either kind lie in blocks of at most about ``BLOCK`` members and ``BLOCK_BYTES``, by a
    hash of the id; each pair of blocks is taken apart from the others, so no task holds a large
    bucket. Sketches come first: only members near one of another component go on to their full
    sets. No pair leaves a task but a confirmed link.
    """
    kinds = rest.groupBy("key", "big").agg(F.count(F.lit(1)).alias("m"), F.sum("bytes").alias("s"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("s") / BLOCK_BYTES)).cast("int")
    sizes = kinds.groupBy("key").agg(F.coalesce(F.sum(F.when(F.col("big"), blocks)), F.lit(0)).cast("int").alias("nb"), F.coalesce(F.sum(F.when(~F.col("big"), blocks)), F.lit(0)).cast("int").alias("ns"))
    d = merge_join(rest, sizes, "key")
    # blocks 0 .. ns - 1 hold the others, blocks ns .. ns + nb - 1 those of the main component
    own = F.when(F.col("big"), F.col("ns") + F.pmod(F.xxhash64("rep", F.lit(11)), F.col("nb"))).otherwise(F.pmod(F.xxhash64("rep", F.lit(11)), F.col("ns"))).cast("int")
    d = d.withColumn("block", own)
    many = F.sequence(F.lit(0), F.when(F.col("big"), F.col("ns")).otherwise(F.col("ns") + F.col("nb")) - 1)
    pair = F.transform(many, lambda k: F.struct(F.least("block", k).alias("lo"), F.greatest("block", k).alias("hi")))
    d = d.where("ns > 0").select("key", "rep", "n", "bytes", "comp", "block", F.explode(pair).alias("p")).select("key", "rep", "n", "bytes", "comp", "block", "p.lo", "p.hi")
    d = merge_join(d, sketches, "rep")
    # many buckets go to one call; each pair of blocks keeps its rows together
    total = d.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    calls = F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(max(1, total["rows"] // CALL, total["bytes"] // CALL_BYTES)))
    (num, den), agree = least, least_agreement(least)

    def tiles(group: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of the rows of two tiles of a bucket, and which of their pairs are of different
        components and of sizes that allow a link."""
        key, lo, hi, block, n, comp = (group[x].to_numpy() for x in ("key", "lo", "hi", "block", "n", "comp"))
        order = np.lexsort((group["rep"].to_numpy(), comp, hi, lo, key))
        k, x, y = key[order], lo[order], hi[order]
        cuts = np.flatnonzero((k[1:] != k[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
        for at in np.split(order, cuts):
            one = lo[at[0]] == hi[at[0]]
            p = at if one else at[block[at] == lo[at[0]]]
            q = at if one else at[block[at] == hi[at[0]]]
            for i in range(0, len(p), TILE):
                for j in range(i if one else 0, len(q), TILE):
                    a, b = p[i : i + TILE], q[j : j + TILE]
                    na, nb = n[a][:, None], n[b][None, :]
                    may = (comp[a][:, None] != comp[b][None, :]) & (den * np.minimum(na, nb) >= num * np.maximum(na, nb))
                    if may.any():
                        yield a, b, may

    def sift(group: pd.DataFrame) -> pd.DataFrame:
        flat = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(len(group), -1)
        kept = np.zeros(len(group), bool)
        for a, b, may in tiles(group):
            x, y = flat[a], flat[b]
            for r in np.flatnonzero(may.any(axis=1)):
                near = np.flatnonzero(may[r])
                near = near[(x[r] == y[near]).sum(axis=1) >= agree]
                if len(near):
                    kept[a[r]] = True
                    kept[b[near]] = True
        return group.loc[kept, ["key", "lo", "hi", "block", "rep", "n", "comp"]]

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        of = _Sets(shingle, CALL_BYTES)
        text, comp = (group[x].to_numpy() for x in ("text", "comp"))
        found: set[tuple[int, int]] = set()
        for a, b, may in tiles(group):
            p, q = [of(text[i]) for i in a], [of(text[i]) for i in b]
            same = intersections(p, q).astype(np.int64)
            size = np.add.outer([len(x) for x in p], [len(x) for x in q])
            for x, y in np.argwhere(may & (same > 0) & (den * same >= num * (size - same))):
                u, v = int(comp[a[x]]), int(comp[b[y]])
                found.add((min(u, v), max(u, v)))
        return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    left = d.groupBy(calls.alias("call")).applyInPandas(sift, "key long, lo int, hi int, block int, rep long, n long, comp long")
    left = tmp.table(left, "dedup-sifted")
    left = merge_join(left, texts, F.col("rep") == F.col("doc_id")).drop("doc_id")
    return left.groupBy(calls.alias("call")).applyInPandas(compare, "a long, b long").distinct()


def components(links: DataFrame, tmp: Scratch, max_rounds: int = 60) -> DataFrame:
    """(id, component): smallest id reachable over links (a, b); only ids with a link.

    Large-star and small-star rounds: each turns every node's neighbours to the smallest id near it,
    until the links are stars. Rounds grow with the logarithm of the longest path. Each round's links
    are written to the shared folder, nothing comes to the driver but a count and a checksum.
    """
    e = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, last = tmp.table(e, "cc-links"), None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = merge_join(both.where("v > u"), least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = merge_join(large, least, F.col("u") == F.col("k"))
        e = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = tmp.table(e, "cc-round")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components: links were not stars after {max_rounds} rounds")
    return e.groupBy("u").agg(F.min("v").alias("component")).union(e.select("v").distinct().select("v", F.col("v").alias("component"))).toDF("id", "component")


def open_buckets(placed: DataFrame) -> DataFrame:
    """(key, m) of buckets whose members are in several components; of buckets with equal members one is enough."""
    mark = lambda k: F.bit_xor(F.xxhash64("rep", F.lit(k)))
    by = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m"), mark(1).alias("x"), mark(2).alias("y"))
    return by.where("lo <> hi").groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key", "m")


def with_main(rows: DataFrame) -> DataFrame:
    """``rows`` (key, comp, ...) with ``big``: whether ``comp`` is the component of most of the bucket's members."""
    per = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(F.max(F.struct("k", "comp")).alias("top"))
    return merge_join(rows, per.select("key", F.col("top.comp").alias("main")), "key").withColumn("big", F.col("comp") == F.col("main")).drop("main")


def near_duplicates(docs: DataFrame, shingle: int = 5, least: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links) and kept (its own component).

    Equal sets make one class with one representative, so copies are never paired. Representatives
    share a bucket where a band of their sketches agrees. In each bucket the members are linked to its
    smallest id; large buckets that this leaves in several components are asked for fresh centres
    outside their main component. What is still open is compared in blocks of bounded size, the main
    component with the others only; this yields links of components only. All links are confirmed on
    full sets.

    Null and empty texts have no shingles and no links. Rows with a null id have no component and are
    kept. Rows of one id are one document: each of its texts counts, its rows' links count together,
    and each row is returned. An empty table gives no rows. Intermediate tables are deleted.
    """
    c = F.col
    near = lambda x, y: least[1] * F.least(x, y) >= least[0] * F.greatest(x, y)  # noqa: E731  sizes alone rule the others out
    with Scratch(docs.sparkSession) as tmp:
        sig = tmp.table(signatures(docs, shingle, id_col, text_col), "dedup-signatures")
        real = sig.where("n > 0 AND doc_id IS NOT NULL")
        classes = tmp.table(real.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.max("bytes").alias("bytes"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "dedup-classes")
        keys = classes.select("rep", "n", "bytes", F.explode("bands").alias("key"))
        shared = keys.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("c"), F.max("rep").alias("last")).where("c.rep <> last")
        shared = tmp.table(shared.select("key", c("c.rep").alias("center"), c("c.n").alias("center_n")), "dedup-buckets")
        members = tmp.table(merge_join(keys, shared, "key"), "dedup-members")
        ids = members.select(c("rep").alias("id")).distinct()
        src = docs.select(c(id_col).cast("long").alias("doc_id"), c(text_col).cast("binary").alias("text"))
        texts = tmp.table(merge_join(src, ids, c("doc_id") == c("id"), "left_semi"), "dedup-texts")

        star = members.where((c("rep") != c("center")) & near(c("n"), c("center_n"))).select(c("center").alias("a"), c("rep").alias("b")).distinct()
        links = tmp.table(verify(star, texts, shingle, least), "dedup-links")
        comp = tmp.table(components(links, tmp), "dedup-components")
        place = lambda comp: merge_join(members, comp, c("rep") == c("id"), "left").withColumn("comp", F.coalesce("component", "rep")).drop("id", "component")
        placed = tmp.table(place(comp), "dedup-placed")
        opened = tmp.table(open_buckets(placed), "dedup-open")
        for k in range(ROUNDS):
            rows = tmp.table(with_main(merge_join(placed, opened.where(c("m") > LARGE), "key")), "dedup-large")
            if rows.isEmpty():
                break
            fresh = rows.where("NOT big").groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", F.lit(k)).alias("h"), "rep", "n", "comp")).alias("f"))
            fresh = fresh.select("key", c("f.rep").alias("a"), c("f.n").alias("fn"), c("f.comp").alias("fc"))
            pairs = merge_join(rows, fresh, "key").where((c("comp") != c("fc")) & near(c("n"), c("fn"))).select("a", c("rep").alias("b")).distinct()
            found = tmp.table(verify(pairs, texts, shingle, least), "dedup-fresh")
            if found.isEmpty():  # further centres pay no more than blocks do
                break
            links = tmp.table(links.union(found), "dedup-links")
            comp = tmp.table(components(links, tmp), "dedup-components")
            placed = tmp.table(place(comp), "dedup-placed")
            opened = tmp.table(open_buckets(placed), "dedup-open")
        # buckets still in several components: their members are compared in blocks
        rest = merge_join(placed.where("rep <> center").select("key", "rep", "n", "bytes", "comp"), opened.select("key"), "key")
        rest = tmp.table(with_main(tmp.table(rest, "dedup-rest")), "dedup-rest")
        more = tmp.table(compare_blocks(rest, classes.select("rep", "sketch"), texts, shingle, least, tmp), "dedup-more-links")
        joined = tmp.table(components(more, tmp), "dedup-joined").withColumnsRenamed({"id": "old", "component": "new"})
        comp = merge_join(comp, joined, c("component") == c("old"), "left").select("id", F.coalesce("new", "component").alias("component"))
        comp = tmp.table(comp.union(joined.select("old", "new")).groupBy("id").agg(F.min("component").alias("component")), "dedup-all-components")

        rep = merge_join(classes.select("d1", "d2", "rep"), comp, c("rep") == c("id"), "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
        out = merge_join(real.select("doc_id", "n", "d1", "d2"), rep, ["d1", "d2"]).select("doc_id", c("n").alias("n_shingles"), "component_id")
        alone = sig.where("n = 0 OR doc_id IS NULL").select("doc_id", c("n").alias("n_shingles"), c("doc_id").alias("component_id"))
        return tmp.result(out.union(alone).withColumn("kept", c("doc_id").eqNullSafe(c("component_id"))), "dedup-result")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates by three-word shingles at 0.85 over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, least=(85, 100))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near-duplicates (five words, 0.8) stays.

    Of rows that repeat an id and a text one stays; rows of one id with different texts are one document
    and stay or go together. Documents with a null id stay, as do null and empty texts; an empty table
    stays empty.
    """
    c = F.col
    d = near_duplicates(docs)
    gone = materialize(d.where("NOT kept").select(c("doc_id").alias("__gone")).distinct(), "dedup-gone")
    again = materialize(d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1 AND doc_id IS NOT NULL").select(c("doc_id").alias("__again")), "dedup-again")
    left = merge_join(docs.where("doc_id IS NOT NULL"), gone, c("doc_id") == c("__gone"), "left_anti")
    marked = merge_join(left, again, c("doc_id") == c("__again"), "left")
    order = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    once = marked.where("__again IS NOT NULL").withColumn("__k", F.row_number().over(order)).where("__k = 1")
    out = marked.where("__again IS NULL").select(*docs.columns).union(once.select(*docs.columns))
    return out.union(docs.where("doc_id IS NULL"))


#: Shingles are written as text here where the operator hashes them. Documents with one set make one
#: class, linked to its smallest id; classes are joined by their shingles.
OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) END)) AS s FROM w),
r AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
u AS (SELECT rep, n, unnest(s) AS g FROM r),
i AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) + any_value(b.n) AS n, count(*) AS same FROM u a JOIN u b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM i WHERE 100 * same >= 85 * (n - same)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(id, root) AS (SELECT rep, rep FROM r UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.id),
k AS (SELECT id, min(root) AS root FROM c GROUP BY id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(k.root, s.doc_id) AS component_id, coalesce(k.root, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN r ON r.s = s.s LEFT JOIN k ON k.id = r.rep
"""
