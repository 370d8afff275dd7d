"""Text and JSON-lines sources."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.arrays import fp16
from corpusloom.functions.batches import cuts, lengths, offsets
from corpusloom.operators.prefix import ordered_sums
from corpusloom.operators.prepare import words_of
from corpusloom.operators.score import LOOKUP, known_rows, teach
from corpusloom.runtime import materialize
from corpusloom.schemas import DENSE

#: Tokens of the lines that are put together at a time, unless one document has more; documents of a file of lines.
LINE_TOKENS, FILE_DOCS = 1 << 18, 4096


def read_dense_json(spark: SparkSession, path: str) -> DataFrame:
    """Dense score records; a malformed line fails the job, blank lines are skipped, the mask may be missing."""
    return spark.read.schema(DENSE).option("mode", "FAILFAST").json(path)


def dense_lines(docs: DataFrame, teacher: DataFrame, most: int = LOOKUP) -> DataFrame:
    """(value): a dense score record as a line of JSON for each document (doc_id, tokens), as ``teach`` scores it.

    A teacher that ``teach`` would look up becomes JSON row by row, once; lines are joined from these texts,
    so no logarithm is taken or written out for each position. A larger one is joined by ``teach``.
    """
    logs = lambda w: F.transform(w, lambda x: F.log(x).cast("float"))
    t = teacher.select("ctx", F.to_json("topk_idx").alias("i"), F.to_json(logs(F.transform("topk_p", lambda v: fp16(v).cast("float")))).alias("w"))
    known = known_rows(materialize(t, "teacher"), F.length("i") + F.length("w"), most)
    name = F.col("doc_id").cast("string").alias("doc_id")
    if known is None:
        if "shard_id" not in docs.columns:
            docs = docs.withColumn("shard_id", F.lit(None).cast("string"))
        filled = F.coalesce(F.size("tokens") > 0, F.lit(False))  # the join has no position of an empty document
        scored = teach(docs.where(filled), teacher, most).unionByName(teach(docs.where(~filled), teacher.limit(0)))
        return scored.select(F.to_json(F.struct(name, "tokens", "topk_idx", F.transform("topk_w", logs).alias("topk_logprobs"), "loss_mask")).alias("value"))
    size = max((r["ctx"] for r in known), default=-1) + 1
    rows = {r["ctx"]: (r["i"], r["w"], "1") for r in known}
    none = ("[]", "[]", "0")  # the last text stands for positions without a distribution
    held = docs.sparkSession.sparkContext.broadcast(list(zip(*[rows.get(k, none) for k in range(size)], none)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.array(column, pa.string()) for column in held.value]
        for batch in batches:
            lists = batch.column(1)
            sizes = lengths(lists)
            for i, j in cuts(sizes, LINE_TOKENS):
                part, at = lists.slice(i, j - i), offsets(sizes[i:j])
                flat = part.flatten()
                ids = pc.fill_null(flat, -1).to_numpy().astype(np.int64)
                ids = np.where((ids >= 0) & (ids < size), ids, size)
                ids[at[1:][sizes[i:j] > 0] - 1] = size
                where, ends = pa.array(ids), pa.array(at, pa.int32())
                texts = [pc.fill_null(flat.cast(pa.string()), "null"), *(x.take(where) for x in tables)]
                arrays = [pc.binary_join(pa.ListArray.from_arrays(ends, x), ",") for x in texts]
                arrays = [pc.if_else(part.is_null(), "null", pc.binary_join_element_wise("[", x, "]", "")) for x in arrays]
                heads = pc.utf8_slice_codeunits(batch.column(0).slice(i, j - i), 0, -1)
                names = (',"tokens":', ',"topk_idx":', ',"topk_logprobs":', ',"loss_mask":')
                line = pc.binary_join_element_wise(heads, *(x for pair in zip(names, arrays) for x in pair), "}", "")
                yield pa.RecordBatch.from_arrays([line], ["value"])

    head = F.to_json(F.struct(name), {"ignoreNullFields": "false"}).alias("head")
    return docs.select(head, "tokens").mapInArrow(run, "value string")


def write_dense_json(docs: DataFrame, teacher: DataFrame, path: str) -> None:
    """Write ``dense_lines`` as files of ``FILE_DOCS`` lines at most, compressed: such a file is read by one task."""
    dense_lines(docs, teacher).write.option("compression", "lz4").option("maxRecordsPerFile", FILE_DOCS).text(path)


def read_text_corpus(spark: SparkSession, path: str, by_line: bool = True, least_words: int = 2) -> DataFrame:
    """(path, block, at, text, words): a document for each line, or for each whole file; shorter ones go.

    Documents are in the order of (path, block, at): a file's lines come in blocks that begin at a byte of
    it, and rise within a block. ``document_order`` makes numbers of these keys.
    """
    d = spark.read.text(path, wholetext=not by_line).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    return d.withColumn("words", words_of(F.col("text"))).where(F.size("words") >= least_words)


def document_order(docs: DataFrame) -> DataFrame:
    """(path, block, at, doc_no) of ``read_text_corpus``: numbers from 0 over all files in order. Only keys are moved."""
    return ordered_sums(docs.select("path", "block", "at"), [], ["path", "block", "at"], rank="doc_no")
