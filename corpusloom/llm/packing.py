"""Cost-balanced packing of documents into training sequences."""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.encode import default_tokenizer, encoder
from corpusloom.runtime import table

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, cost double, ids binary"


def pack_group(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one group of documents.

    Whole stretches of ``capacity`` are sequences of their own. Of what is left, the longest goes
    first, to the sequence of lowest cost (``linear * n + quadratic * n * n`` over its pieces) that has
    room for it; where none has, it is cut to fill the one with most room. There are as many full
    sequences as the tokens fill, and the tokens over make sequences whose lengths are powers of two,
    which need no padding.
    """
    import numpy as np

    out, rest, n_seq = [], [], 0
    for d, n in enumerate(lengths):
        for s in range(0, n - n % capacity, capacity):
            out.append((d, s, capacity, n_seq, 0))
            n_seq += 1
        if n % capacity:
            rest.append((-(n % capacity), d, n - n % capacity))
    left = -sum(x[0] for x in rest)
    sizes = [capacity] * (left // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if (left % capacity) >> b & 1]
    room, cost, used = np.array(sizes, np.int64), np.zeros(len(sizes)), np.zeros(len(sizes), np.int64)
    heapq.heapify(rest)
    while rest:
        n, d, start = heapq.heappop(rest)
        n = -n
        fits = room >= n
        if fits.any():
            k = int(np.argmin(np.where(fits, cost, np.inf)))
        else:
            k = int(np.argmax(room))
            heapq.heappush(rest, (-(n - int(room[k])), d, start + int(room[k])))
            n = int(room[k])
        out.append((d, start, n, n_seq + k, int(used[k])))
        room[k] -= n
        used[k] += n
        cost[k] += linear * n + quadratic * n * n
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, linear: float = 1.0, quadratic: float = 1 / 2048, group_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, append ``end_id`` and pack them: one row for each piece, with its ids.

    Each input partition packs its documents in groups of about ``group_tokens`` tokens (one document
    at least), so memory is bounded, nothing is shuffled and a lost task only repeats its own partition.
    ``capacity`` must be a power of two. Sequences of ``capacity`` and of smaller powers of two hold no
    padding. ``sequence_id`` is the partition's number (upper bits) and a count within it.

    ``cost`` is the estimated attention cost of the piece. Null texts are empty (one end token); null
    and repeated ids are packed row by row; an empty table gives no rows. Other columns are not read.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = encoder(tokenizer), struct.pack("<I", end_id)
        base = TaskContext.get().partitionId() << 40
        ids: list[int | None] = []
        coded: list[bytes] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, base
            pieces = pack_group([len(x) // 4 for x in coded], capacity, linear, quadratic)
            size: dict[int, int] = {}
            for _, _, n, q, _ in pieces:
                size[q] = size.get(q, 0) + n
            for k in range(0, len(pieces), 2000):
                part = pieces[k : k + 2000]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([ids[p[0]] for p in part], pa.int64()),
                    "start": pa.array([p[1] for p in part], pa.int64()),
                    "length": pa.array([p[2] for p in part], pa.int64()),
                    "doc_tokens": pa.array([len(coded[p[0]]) // 4 for p in part], pa.int64()),
                    "sequence_id": pa.array([base + p[3] for p in part], pa.int64()),
                    "offset": pa.array([p[4] for p in part], pa.int64()),
                    "sequence_tokens": pa.array([size[p[3]] for p in part], pa.int64()),
                    "cost": pa.array([linear * p[2] + quadratic * p[2] * p[2] for p in part], pa.float64()),
                    "ids": pa.array([coded[p[0]][4 * p[1] : 4 * (p[1] + p[2])] for p in part], pa.binary()),
                })
            base += len(size)
            ids.clear()
            coded.clear()
            held = 0

        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                piece = batch.slice(k, 64)
                for i, x in zip(piece.column(0).to_pylist(), enc.encode(piece.column(1).to_pylist())):
                    ids.append(i)
                    coded.append(x + end)
                    held += len(coded[-1]) // 4
                    if held >= group_tokens:
                        yield from flush()
        if ids:
            yield from flush()

    return src.mapInArrow(pack, PIECES)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens; checksums of the pieces' ids."""
    pieces = pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "cost")
