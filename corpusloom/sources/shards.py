"""Shards as Parquet partitions, with one manifest row for each."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.pack import doc_offsets, segments
from corpusloom.runtime import materialize, merge_join, small_join
from corpusloom.schemas import MANIFEST, SHARD

#: Provenance that a writer may set, with what it is if unset.
DEFAULTS = {"teacher_id": "", "quantization": "", "chat_template_version": "", "fold_version": "v2", "text_source": "", "logit_source": "", "data_class": "a", "alpha_override": None}


def shard_documents(shards: DataFrame) -> DataFrame:
    """(shard_id, doc_id, local_doc, len, offset): the manifest's offsets as rows, for shards of any size."""
    return doc_offsets(shards)


def shard_manifest(shards: DataFrame, vocab_size: int, offsets: bool = False, **provenance) -> DataFrame:
    """One row for each shard: counts, offsets and lengths in the order of documents, and provenance.

    With ``offsets`` a shard's offsets come as two arrays in its row, for shards that are small enough for
    that; else these are empty. ``write_shards`` keeps the offsets as rows beside the manifest.
    """
    unknown = provenance.keys() - DEFAULTS.keys()
    if unknown:
        raise ValueError(f"no such provenance: {sorted(unknown)}")
    k = F.max(F.coalesce(F.array_max(F.transform("topk_idx", F.size)), F.lit(0))).alias("k")
    m = shards.groupBy("shard_id").agg(F.sum(F.size("tokens").cast("bigint")).alias("total_tokens"), F.count(F.lit(1)).alias("num_documents"), k)
    if offsets:
        rows = F.sort_array(F.collect_list(F.struct("local_doc", "offset", "len")))
        m = merge_join(m, doc_offsets(shards).groupBy("shard_id").agg(rows.alias("r")), "shard_id")
    m = m.withColumns({"format_version": F.lit(1), "vocab_size": F.lit(vocab_size), "doc_offsets": F.col("r.offset") if offsets else F.array(), "doc_lengths": F.col("r.len") if offsets else F.array()})
    for name, unset in DEFAULTS.items():
        value = provenance.get(name, unset)
        m = m.withColumn(name, value if not isinstance(value, (str, float, int, type(None))) else F.lit(value))
    names = [c.split()[0] for c in MANIFEST.split(", ")]
    types = dict(c.split(" ", 1) for c in MANIFEST.split(", "))
    return m.select(*[F.col(n).cast(types[n]).alias(n) for n in names])


#: Bytes of a position as stored (token, candidates, tail and mask), and of one file, which is then about one row group.
TOKEN_BYTES, FILE_BYTES = 64, 128 << 20


def write_shards(shards: DataFrame, manifest: DataFrame | Callable[[DataFrame], DataFrame], path: str, file_bytes: int = FILE_BYTES, fill: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Write documents by shard, their offsets and an index of files, and last the manifest, which marks them as done.

    Documents are dealt by ranges of (shard, document), as many as their bytes need, so a large shard takes
    many tasks and a small one a single file, and each file holds documents that follow each other. ``fill``
    adds the missing columns to documents that are dealt already, so that only tokens are shuffled; it must
    work row by row. ``manifest`` may be a function of the shards as written, which then are made once.
    """
    spark = shards.sparkSession
    total = shards.agg(F.coalesce(F.sum(F.size("tokens").cast("long")), F.lit(0))).first()[0]
    n = max(1, -(-total * TOKEN_BYTES // file_bytes))
    dealt = shards.repartitionByRange(n, "shard_id", "doc_id").sortWithinPartitions("shard_id", "doc_id")
    (fill(dealt) if fill else dealt).write.mode("overwrite").partitionBy("shard_id").parquet(f"{path}/shards")
    written = spark.read.schema(SHARD).parquet(f"{path}/shards")
    index = written.groupBy("shard_id", F.col("_metadata.file_path").alias("file")).agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    index.write.mode("overwrite").parquet(f"{path}/index")
    shard_documents(written).write.mode("overwrite").parquet(f"{path}/offsets")
    (manifest(written) if callable(manifest) else manifest).write.mode("overwrite").json(f"{path}/manifest")


def all_windows(spark: SparkSession, path: str, length: int) -> DataFrame:
    """(shard_id, window_id) of all full windows of the shards in ``path``."""
    t = spark.read.parquet(f"{path}/offsets").groupBy("shard_id").agg(F.sum("len").alias("total")).where(F.col("total") >= length)
    return t.select("shard_id", F.explode(F.expr(f"sequence(0L, total div {length} - 1)")).alias("window_id"))


def read_windows(spark: SparkSession, path: str, windows: DataFrame, length: int) -> DataFrame:
    """(shard_id, window_id, tokens, doc_ids, loss_mask) of some ``windows`` (shard_id, window_id), by random access.

    Offsets tell which documents a window overlaps, and the index which files hold these; no other file is
    opened. Windows that are not there, or not full, give no row.
    """
    wanted = materialize(windows.select("shard_id", "window_id").distinct(), "windows-wanted")
    off = spark.read.parquet(f"{path}/offsets").where("len > 0")
    over = off.withColumn("window_id", F.explode(F.expr(f"sequence(offset div {length}, (offset + len - 1) div {length})")))
    parts = materialize(small_join(over, wanted, ["shard_id", "window_id"]), "windows-parts")
    index = spark.read.parquet(f"{path}/index").select(F.col("shard_id").alias("__s"), "file", "first_doc", "last_doc")
    hit = small_join(parts.select("shard_id", "doc_id").distinct(), index, (F.col("shard_id") == F.col("__s")) & F.col("doc_id").between(F.col("first_doc"), F.col("last_doc")))
    files = [r["file"] for r in hit.select("file").distinct().collect()]  # names of the files that the windows need
    reader = spark.read.schema(SHARD).option("basePath", f"{path}/shards")
    docs = (reader.parquet(*files) if files else spark.createDataFrame([], SHARD)).select("shard_id", "doc_id", "tokens")
    d = merge_join(docs, parts, ["shard_id", "doc_id"])
    w = segments(d, length)
    return w.where(F.size("tokens") == length)


def read_shards(spark: SparkSession, *paths: str) -> DataFrame:
    """Documents of all shards of several folders; their schema is fixed, the number of candidates may differ."""
    one = [spark.read.schema(SHARD).parquet(f"{p}/shards") for p in paths]
    return reduce(DataFrame.unionByName, one)


def read_manifests(spark: SparkSession, *paths: str) -> DataFrame:
    """Manifest rows of several folders with the file they are from; a missing fold version is the second."""
    d = spark.read.schema(MANIFEST).json([f"{p}/manifest" for p in paths]).withColumn("manifest_file", F.col("_metadata.file_path"))
    return d.withColumn("fold_version", F.coalesce("fold_version", F.lit("v2")))


def open_shards(spark: SparkSession, *paths: str) -> DataFrame:
    """Shard documents of several folders, each with its own manifest's ``k`` and ``vocab_size``.

    A shard without a manifest in its folder fails the job.
    """
    missing = F.raise_error(F.concat(F.lit("no manifest for shard "), F.col("shard_id"))).cast("boolean")

    def one(path: str) -> DataFrame:
        m = read_manifests(spark, path).select("shard_id", F.col("k").alias("manifest_k"), "vocab_size")
        d = small_join(read_shards(spark, path), m, "shard_id", "left")
        return d.where(F.when(F.col("manifest_k").isNull(), missing).otherwise(F.lit(True)))

    return reduce(DataFrame.unionByName, map(one, paths))


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs that no manifest names yet."""
    return merge_join(inputs, done.select(key).distinct(), key, "left_anti")
