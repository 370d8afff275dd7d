"""Landing-zone ingestion: each new file is converted once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.runtime import materialize
from corpusloom.sources.files import exists, names
from corpusloom.sources.shards import shard_manifest, write_shards


def ingest(spark: SparkSession, landing: str, schema: str, convert: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 1000) -> DataFrame:
    """Convert what is new in ``landing`` and return all that ``out`` holds.

    The checkpoint knows the files that are done. A micro-batch writes to a folder of its number, so
    one that runs again overwrites itself and adds nothing twice.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)

    def sink(batch: DataFrame, number: int) -> None:
        convert(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).withColumn("batch", F.col("batch").cast("bigint"))


def ingest_shards(spark: SparkSession, landing: str, schema: str, convert: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, vocab_size: int, files_per_batch: int = 1000, fill: Callable[[DataFrame], Callable[[DataFrame], DataFrame]] | None = None, **provenance) -> list[str]:
    """Convert what is new in ``landing`` to shards with their manifests; returns the folders of all micro-batches.

    A micro-batch is a folder of shards of its own, whose manifest is written last. One that runs again
    overwrites its folder; one without a manifest is not listed. ``fill`` makes of a micro-batch's converted
    documents what adds the rest of their columns row by row, as ``write_shards`` has it.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)

    def sink(batch: DataFrame, number: int) -> None:
        docs = materialize(convert(batch), "ingest")
        if docs.limit(1).count():
            write_shards(docs, lambda written: shard_manifest(written, vocab_size, **provenance), f"{out}/batch={number}", fill=fill(docs) if fill else None)

    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return [f"{out}/{b}" for b in names(spark, out) if exists(spark, f"{out}/{b}/manifest/_SUCCESS")]


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "update") -> None:
    """Drive a stream over what is there into ``out``, one folder for each micro-batch."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
