"""Token-ID output: flat files of unsigned integers with 64-bit document offsets.

Layout below the output folder, one set for each range of documents in ascending id order:

* ``part-00000.tok``: token ids, ``uint16`` where the vocabulary fits, else ``uint32``, little-endian;
* ``part-00000.off``: ``int64`` token offsets within the part, one more than documents;
* ``part-00000.ids``: ``int64`` document ids (a null id is stored as the smallest ``int64``).

The manifest (one row for each part) holds their numbers of documents and tokens. Bases of the parts
are exclusive prefix sums over the manifest.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.encode import default_tokenizer, encoder
from corpusloom.runtime import materialize, new_dir, table

#: Null ids come first, so their number tells them from all others.
MANIFEST = "part int, path string, width int, n_docs long, n_null long, n_tokens long"
READ_BACK = "part int, row long, doc_id long, local_start long, n_tokens long, base long, ids binary"


def _fs(uri: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write_token_files(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Encode whole texts, append ``end_id`` to each, and write them in ascending id order.

    Documents are dealt by ranges of id (equal ids also by text, so that one id cannot fill a part);
    each task sorts its range and streams it into one set of files. A task writes under a name of its
    attempt and renames at the end, and its content is the same on every attempt, so lost executors
    and repeated tasks do no harm. Returns the manifest, read back from the shared folder.

    Null texts are empty; null ids come first; equal ids are ordered by text; an empty table gives an
    empty manifest. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    ranged = src.repartitionByRange(parts, F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie, "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        ctx = TaskContext.get()
        part, attempt = ctx.partitionId(), ctx.taskAttemptId()
        enc = encoder(tokenizer)
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        fs, root = _fs(out_dir)
        fs.create_dir(root, recursive=True)
        stem, own = f"{root}/part-{part:05d}", f"{root}/.part-{part:05d}-{attempt}"
        files = {x: fs.open_output_stream(f"{own}.{x}") for x in ("tok", "off", "ids")}
        end, at, n, n_null = struct.pack("<I", end_id), 0, 0, 0
        files["off"].write(struct.pack("<q", 0))
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                piece = batch.slice(k, 64)
                coded = [x + end for x in enc.encode(piece.column(1).to_pylist())]
                ids = np.asarray(piece.column(0).fill_null(0))
                n_null += piece.column(0).null_count
                ends = at + np.cumsum([len(x) // 4 for x in coded])
                files["tok"].write(np.frombuffer(b"".join(coded), "<u4").astype(f"<u{width}").tobytes())
                files["off"].write(ends.astype("<i8").tobytes())
                files["ids"].write(ids.astype("<i8").tobytes())
                at, n = int(ends[-1]), n + len(ids)
        for x, f in files.items():
            f.close()
            if n:
                fs.move(f"{own}.{x}", f"{stem}.{x}")
            else:
                fs.delete_file(f"{own}.{x}")
        if n:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{out_dir}/part-{part:05d}"], "width": pa.array([width], pa.int32()), "n_docs": [n], "n_null": [n_null], "n_tokens": [at]})

    return materialize(ranged.mapInArrow(write, MANIFEST), "token-manifest")


def with_bases(manifest: DataFrame) -> DataFrame:
    """Add ``base``: tokens of all parts before. One row for each part, so a single window is small."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Documents from the files: doc_id, start (tokens of all documents before), n_tokens, ids (bytes).

    ``ids`` are little-endian unsigned 32-bit integers whatever the width in the file. Local files are
    memory-mapped; others are read part by part through their file system.
    """
    # one row for each file; dealt to as many tasks
    files = with_bases(manifest)
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for m in batch.to_pylist():
                fs, stem = _fs(m["path"])

                def load(kind: str, dtype: str, fs=fs, stem=stem):
                    if fs.type_name == "local":
                        return np.memmap(f"{stem}.{kind}", dtype=dtype, mode="r")
                    with fs.open_input_file(f"{stem}.{kind}") as f:
                        return np.frombuffer(f.read(), dtype)

                off, ids, tok = load("off", "<i8"), load("ids", "<i8"), load("tok", f"<u{m['width']}")
                if len(off) != m["n_docs"] + 1 or len(tok) != m["n_tokens"]:
                    raise ValueError(f"{m['path']}: files and manifest disagree")
                for k in range(0, len(ids), 256):
                    e = min(k + 256, len(ids))
                    cut = [tok[off[i] : off[i + 1]].astype("<u4").tobytes() for i in range(k, e)]
                    start = np.asarray(off[k:e])
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array([m["part"]] * (e - k), pa.int32()),
                        "row": pa.array(range(k, e), pa.int64()),
                        "doc_id": pa.array(np.asarray(ids[k:e]), pa.int64(), mask=np.arange(k, e) < m["n_null"]),
                        "local_start": pa.array(start, pa.int64()),
                        "n_tokens": pa.array(np.asarray(off[k + 1 : e + 1]) - start, pa.int64()),
                        "base": pa.array([m["base"]] * (e - k), pa.int64()),
                        "ids": pa.array(cut, pa.binary()),
                    })

    rows = files.repartition(n).mapInArrow(read, READ_BACK)
    return rows.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def token_crc32(ids: bytes) -> int:
    return zlib.crc32(ids)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: their place in the token files and a checksum of what was read back."""
    manifest = write_token_files(table(spark, sf_dir, "documents"), new_dir(spark, "tokens"), default_tokenizer())
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
