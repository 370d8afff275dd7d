"""Bundles of NumPy arrays: a Python data source that reads them, and an export of shards as arrays."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from corpusloom.functions.batches import cuts, offsets
from corpusloom.operators.pack import doc_offsets
from corpusloom.runtime import merge_join
from corpusloom.schemas import BULK, CHUNKS


def _fs(uri: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


#: Arrays of a bundle with their exact types (fixed values of the format) and how their shape follows from
#: N positions, K candidates and C chunks.
ARRAYS = {
    "tokens": ("<u4", "N"),
    "teacher_ids": ("<i4", "NK"),
    "teacher_probs": ("<f4", "NK"),
    "loss_mask": ("|u1", "N"),
    "chunk_start": ("<i8", "C"),
    "chunk_length": ("<i8", "C"),
}
HEADERS = "file string, array string, dtype string, shape array<long>, in_order boolean, stored boolean, bytes long"
#: Rows of one batch, and bytes of positions from which a stored bundle is read by several tasks.
BATCH_ROWS, SPLIT_BYTES = 8192, 64 << 20
#: Documents of bundles as they are read, and bytes of arrays from which one task makes them: as rows they take several times as many.
DOCUMENTS = "file string, chunk int, tokens array<bigint>, topk_idx array<array<bigint>>, topk_w array<array<float>>, tail_w array<float>, loss_mask array<tinyint>"
DOCUMENT_BYTES = 32 << 20
#: Small bundles that one task reads, up to ``SPLIT_BYTES`` of them.
TASK_FILES = 64


class _Member:
    """One array of a bundle, read from its header on; of a stored member any rows by their place."""

    def __init__(self, f, bundle: zipfile.ZipFile, info: zipfile.ZipInfo):
        import numpy as np

        self.stored, self.bytes, self.name = info.compress_type == zipfile.ZIP_STORED, info.file_size, info.filename
        self.stream, start = bundle.open(info), 0
        if self.stored:  # the member's bytes lie in the file as they are, behind a local header with two texts
            f.seek(info.header_offset + 26)
            names = f.read(4)
            self.stream, start = f, info.header_offset + 30 + int.from_bytes(names[:2], "little") + int.from_bytes(names[2:], "little")
            f.seek(start)
        version = np.lib.format.read_magic(self.stream)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        self.shape, fortran, self.dtype = read(self.stream)
        self.in_order, self.data, self.end = not fortran or len(self.shape) < 2, self.stream.tell(), start + info.file_size

    def rows(self, low: int, high: int):
        """Rows ``low`` to ``high``: a stored member is sought, a compressed one read on."""
        import numpy as np

        width = self.dtype.itemsize * int(np.prod(self.shape[1:], dtype=np.int64))
        if self.data + high * width > self.end:
            raise ValueError(f"{self.name} ends before its row {high}")
        self.stream.seek(self.data + low * width)
        return np.frombuffer(self.stream.read((high - low) * width), self.dtype).reshape(high - low, *self.shape[1:])


def _members(f) -> dict[str, _Member]:
    """Arrays of an open bundle by name; only its directory and the arrays' headers are read."""
    z = zipfile.ZipFile(f)
    return {i.filename.removesuffix(".npy"): _Member(f, z, i) for i in z.infolist() if i.filename.endswith(".npy")}


def header_faults(arrays: dict[str, tuple[str, tuple[int, ...], bool]]) -> list[str]:
    """What is wrong with the (dtype, shape, in_order) of a bundle's arrays, by name."""
    faults, sizes = [], {}
    for name, (kind, dims) in ARRAYS.items():
        if name not in arrays:
            faults.append(f"missing {name}")
            continue
        dtype, shape, in_order = arrays[name]
        if dtype != kind:
            faults.append(f"{name} is {dtype}, not {kind}")
        if len(shape) != len(dims) or any(sizes.setdefault(d, n) != n for d, n in zip(dims, shape)):
            faults.append(f"{name} has shape {[int(x) for x in shape]}")
        elif "K" in dims and shape[-1] < 1:
            faults.append(f"{name} has no candidates")
        if not in_order:
            faults.append(f"{name} is not in row order")
    return faults


class _Piece:
    """A bundle, or a range of its positions."""

    def __init__(self, uri: str, low: int = 0, high: int | None = None):
        self.uri, self.low, self.high = uri, low, high


class _Part(InputPartition):
    """What one task reads: a piece of a large bundle, or some small bundles."""

    def __init__(self, *pieces: _Piece):
        self.pieces = pieces


def _together(uris: list[tuple[str, int]], most_bytes: int, most_files: int = TASK_FILES) -> list[_Part]:
    """Bundles in groups of at most so many files, and bytes unless one alone has more: a task for each would cost more than its file."""
    parts, now, held = [], [], 0
    for uri, size in uris:
        if now and (len(now) >= most_files or held + size > most_bytes):
            parts.append(_Part(*now))
            now, held = [], 0
        now.append(_Piece(uri))
        held += size
    return [*parts, _Part(*now)] if now else parts


class _Reader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.files = set(json.loads(options["files"])) if "files" in options else None
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def uris(self) -> list[tuple[str, int]]:
        """Bundles of the folder and their sizes."""
        import pyarrow.fs as pafs

        fs, root = _fs(self.path)
        scheme = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        files = sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(root, recursive=False)) if f.path.endswith(".npz"))
        return [(scheme + p, n) for p, n in files if self.files is None or p.rsplit("/", 1)[-1] in self.files]

    def partitions(self) -> list[InputPartition]:
        uris = self.uris()
        parts = _together([x for x in uris if x[1] <= self.split], self.split)
        for uri, size in uris:
            if size <= self.split:
                continue
            fs, path = _fs(uri)
            with fs.open_input_file(path) as f:  # a large bundle: its directory and headers tell if it can be split
                m = _members(f)
                whole = header_faults({k: (x.dtype.str, x.shape, x.in_order) for k, x in m.items()}) or not all(x.stored for x in m.values())
                n = 0 if whole else m["tokens"].shape[0]
            step = max(BATCH_ROWS, -(-n * self.split // size))
            parts += [_Part(_Piece(uri))] if whole else [_Part(_Piece(uri, k, min(n, k + step))) for k in range(0, n, step)]
        return parts

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for piece in partition.pieces if partition is not None else ():
            fs, path = _fs(piece.uri)
            name = path.rsplit("/", 1)[-1]
            with fs.open_input_file(path) as f:
                m = _members(f)
                faults = header_faults({k: (x.dtype.str, x.shape, x.in_order) for k, x in m.items()})
                if faults:
                    raise ValueError(f"{name}: {'; '.join(faults)}")
                yield from self.batches(name, m, piece)

    def batches(self, name: str, m: dict[str, _Member], part: _Piece) -> Iterator[pa.RecordBatch]:
        import numpy as np

        n = m["tokens"].shape[0]
        low, high = part.low, n if part.high is None else part.high
        starts = m["chunk_start"].rows(0, m["chunk_start"].shape[0]) if "chunk" in self.columns else None
        pairs = lambda k, kind: lambda a, e: pa.FixedSizeListArray.from_arrays(pa.array(m[k].rows(a, e).ravel(), kind), m[k].shape[1]).cast(pa.list_(kind))
        make = {
            "file": lambda a, e: pa.array([name] * (e - a)),
            "pos": lambda a, e: pa.array(np.arange(a, e), pa.int64()),
            "token": lambda a, e: pa.array(m["tokens"].rows(a, e).astype(np.int64)),
            "teacher_ids": pairs("teacher_ids", pa.int32()),
            "teacher_probs": pairs("teacher_probs", pa.float32()),
            # values above 127 do not fit the column: they stay as they are in the check and are refused here
            "loss_mask": lambda a, e: pa.array(m["loss_mask"].rows(a, e)).cast(pa.int8()),
            "chunk": lambda a, e: pa.array((np.searchsorted(starts, np.arange(a, e), "right") - 1).astype(np.int32)),
        }
        for a in range(low, high, BATCH_ROWS):
            e = min(high, a + BATCH_ROWS)
            yield pa.RecordBatch.from_arrays([make[c](a, e) for c in self.columns], names=self.columns)


class _DocumentReader(_Reader):
    """Reads documents: a chunk goes with the range that its first position lies in."""

    def __init__(self, options: dict, columns: list[str]):
        super().__init__(options, columns)
        self.held = json.loads(options["held"])
        self.files = self.held.keys()

    def uris(self) -> list[tuple[str, int]]:
        """Bundles and the bytes of their arrays, which a compressed file does not tell."""
        return [(u, self.held[u.rsplit("/", 1)[-1]]) for u, _ in super().uris()]

    def batches(self, name: str, m: dict[str, _Member], part: _Piece) -> Iterator[pa.RecordBatch]:
        import numpy as np

        n, k = m["teacher_ids"].shape
        starts, sizes = (m[x].rows(0, m[x].shape[0]) for x in ("chunk_start", "chunk_length"))
        if (sizes < 1).any() or (starts != np.cumsum(sizes) - sizes).any() or sizes.sum() != n:
            raise ValueError(f"{name}: chunks do not tile the positions")
        first, last = np.searchsorted(starts, [part.low, n if part.high is None else part.high])
        for i, j in cuts(sizes[first:last], BATCH_ROWS):
            at, long = starts[first + i : first + j], sizes[first + i : first + j]
            low, high = int(at[0]), int(at[-1] + long[-1])
            tokens, ids, probs, mask = (m[x].rows(low, high) for x in ("tokens", "teacher_ids", "teacher_probs", "loss_mask"))
            # a row takes what the row after it says of its own token, if that is unmasked and of the same chunk
            on = np.append(mask[1:] == 1, False)
            on[at + long - 1 - low] = False
            ids, probs = (np.where(on[:, None], np.roll(x, -1, 0), 0) for x in (ids, probs))
            mass = np.zeros(high - low)
            for c in range(k):
                mass += probs[:, c]
            with np.errstate(over="ignore"):
                half = probs.astype(np.float16).astype(np.float32)
            docs, rows = pa.array(offsets(long), pa.int32()), pa.array(np.arange(high - low + 1) * k, pa.int32())
            columns = {
                "file": pa.array([name] * len(at)),
                "chunk": pa.array(np.arange(first + i, first + j), pa.int32()),
                "tokens": pa.array(tokens, pa.int64()),
                "topk_idx": pa.ListArray.from_arrays(rows, pa.array(ids.ravel(), pa.int64())),
                "topk_w": pa.ListArray.from_arrays(rows, pa.array(half.ravel())),
                "tail_w": pa.array(np.fmax(0, np.fmin(1, 1 - mass)), pa.float32()),
                "loss_mask": pa.array(on.astype(np.int8)),
            }
            yield pa.RecordBatch.from_arrays([x if c in ("file", "chunk") else pa.ListArray.from_arrays(docs, x) for c, x in columns.items()], names=list(columns))


class _ChunkReader(_Reader):
    def partitions(self) -> list[InputPartition]:
        return _together(self.uris(), SPLIT_BYTES)

    def batches(self, name: str, m: dict[str, _Member], part: _Piece) -> Iterator[pa.RecordBatch]:
        s, n = (m[k].rows(0, m[k].shape[0]) for k in ("chunk_start", "chunk_length"))
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(s)), pa.array(range(len(s)), pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64())], names=["file", "chunk", "start", "length"])


class _HeaderReader(_ChunkReader):
    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for piece in partition.pieces if partition is not None else ():
            fs, path = _fs(piece.uri)
            with fs.open_input_file(path) as f:
                m, name = _members(f), path.rsplit("/", 1)[-1]
            rows += [(name, k, x.dtype.str, list(x.shape), x.in_order, x.stored, x.bytes) for k, x in m.items()] or [(name, None, None, None, None, None, None)]
        if not rows:
            return
        kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.bool_(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in HEADERS.split(", ")])


class NpzPositions(DataSource):
    """Scored positions of all ``.npz`` files of a folder, by ranges of positions where a file is large and stored."""

    @classmethod
    def name(cls) -> str:
        return "npz_positions"

    def schema(self) -> str:
        want = json.loads(self.options.get("columns", "null"))
        have = {c.split()[0]: c for c in f"{BULK}, chunk int".split(", ")}
        return ", ".join(have[c] for c in want) if want else BULK

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, schema.names)


class NpzChunks(DataSource):
    """Chunks of all ``.npz`` files of a folder."""

    @classmethod
    def name(cls) -> str:
        return "npz_chunks"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema) -> DataSourceReader:
        return _ChunkReader(self.options, schema.names)


class NpzDocuments(DataSource):
    """Shard documents of some ``.npz`` files of a folder, a document for each chunk."""

    @classmethod
    def name(cls) -> str:
        return "npz_documents"

    def schema(self) -> str:
        return DOCUMENTS

    def reader(self, schema) -> DataSourceReader:
        return _DocumentReader(self.options, schema.names)


class NpzHeaders(NpzChunks):
    """A row for each array of each ``.npz`` file: its type and shape as the file states them, without its values."""

    @classmethod
    def name(cls) -> str:
        return "npz_headers"

    def schema(self) -> str:
        return HEADERS

    def reader(self, schema) -> DataSourceReader:
        return _HeaderReader(self.options, schema.names)


def _load(spark: SparkSession, source: type[DataSource], path: str, files: list[str] | None = None, **options) -> DataFrame:
    spark.dataSource.register(source)
    r = spark.read.format(source.name()).option("path", path)
    for k, v in (options | ({} if files is None else {"files": json.dumps(files)})).items():
        r = r.option(k, v)
    return r.load()


def read_npz(spark: SparkSession, path: str, chunks: bool = False, files: list[str] | None = None, columns: list[str] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Positions (or chunks) of the bundles of a folder, or of some ``files`` of it.

    Types and shapes are taken from the arrays' own headers and must be the format's exactly: a bundle with
    others fails the job, nothing is cast. ``columns`` (those of BULK, and ``chunk``: the place of the
    position's chunk) are all that is read of a stored bundle; one of more than ``split_bytes`` is read by
    several tasks. Compressed bundles are read as a stream by one task each.
    """
    if chunks:
        return _load(spark, NpzChunks, path, files)
    return _load(spark, NpzPositions, path, files, splitBytes=split_bytes, **({"columns": json.dumps(columns)} if columns else {}))


def read_npz_documents(spark: SparkSession, path: str, held: dict[str, int], split_bytes: int = DOCUMENT_BYTES) -> DataFrame:
    """(file, chunk, tokens, topk_idx, topk_w, tail_w, loss_mask) of some bundles of a folder, whose chunks must tile them.

    Rows are moved by one within their chunks as they are read, so no position is shuffled: each takes the
    candidates of the row after it if that is unmasked, else zeros. Probabilities are kept in half precision;
    the tail is what they leave of 1 before that. ``held`` has the bundles' names and the bytes of their arrays,
    of which a task reads about ``split_bytes``.
    """
    return _load(spark, NpzDocuments, path, held=json.dumps(held), splitBytes=split_bytes)


def read_npz_headers(spark: SparkSession, path: str, files: list[str] | None = None) -> DataFrame:
    """(file, array, dtype, shape, in_order, stored, bytes) of every array of the bundles of a folder."""
    return _load(spark, NpzHeaders, path, files)


def list_npz(spark: SparkSession, path: str) -> dict[str, int]:
    """Names of the bundles of a folder, and their bytes."""
    return {u.rsplit("/", 1)[-1]: n for u, n in _Reader({"path": path}, []).uris()}


def bundle_faults(headers: DataFrame) -> DataFrame:
    """(file, faults) of ``read_npz_headers``: missing arrays, other types than the format's, shapes that do not agree."""

    def check(arrays: pd.Series) -> pd.Series:
        return pd.Series([header_faults({a["array"]: (a["dtype"], tuple(a["shape"]), a["in_order"]) for a in x if a["array"]}) for x in arrays], dtype=object)

    g = headers.groupBy("file").agg(F.collect_list(F.struct("array", "dtype", "shape", "in_order")).alias("a"))
    return g.select("file", F.pandas_udf(check, "array<string>")("a").alias("faults"))


#: Level of deflate in a bundle that is written: nearly what higher ones save, in a fraction of their time.
LEVEL = 1


def _save(out, arrays: dict) -> None:
    """A bundle as ``np.savez_compressed`` writes it, by ``LEVEL``."""
    import numpy as np

    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=LEVEL) as z:
        for name, values in arrays.items():
            with z.open(f"{name}.npy", "w", force_zip64=True) as f:
                np.lib.format.write_array(f, np.asanyarray(values), allow_pickle=False)


#: Columns of positions on their way to a bundle: type, and if there is one for each candidate.
MOVED = {"pos": ("<i8", False), "token": ("<u4", False), "teacher_ids": ("<i4", True), "teacher_probs": ("<f4", True), "loss_mask": ("|u1", False)}


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, n, k, data): neighbouring rows of a file in a batch as one compressed value, column after column."""
    import numpy as np
    import pyarrow.compute as pc

    def numbers(name: str, column: str, values: pa.Array):
        if values.null_count:
            raise ValueError(f"{name}: {column} has nulls")
        return values.to_numpy(zero_copy_only=False)

    for batch in batches:
        if not batch.num_rows:
            continue
        file = batch.column("file")
        code = file.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        edges = [0, *(np.nonzero(np.diff(code))[0] + 1).tolist(), batch.num_rows]
        out = []
        for i, j in zip(edges, edges[1:]):
            name, n, parts = file[i].as_py(), j - i, []
            widths = {w for c, (_, wide) in MOVED.items() if wide for w in pc.list_value_length(batch.column(c).slice(i, n)).unique().to_pylist()}
            if len(widths) != 1 or None in widths:
                raise ValueError(f"{name}: all positions need equally many candidates")
            for c, (kind, wide) in MOVED.items():
                values = batch.column(c).slice(i, n)
                x = numbers(name, c, values.flatten() if wide else values)
                # steps between places are all alike, and so are candidates of a rank more than those of a position
                x = np.diff(x, prepend=0) if c == "pos" else x.reshape(n, -1).T if wide else x
                parts.append(x.astype(kind).tobytes())
            out.append((name, n, *widths, pa.compress(b"".join(parts), "zstd", asbytes=True)))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["file", "n", "k", "data"])


def _unpack(packs: pa.Table) -> dict:
    """Columns of a file's positions in their order, from its packs in any order."""
    import numpy as np

    columns: dict[str, list] = {c: [] for c in MOVED}
    for n, k, data in zip(*(packs[c].to_pylist() for c in ("n", "k", "data"))):
        size = sum(np.dtype(kind).itemsize * (k if wide else 1) for kind, wide in MOVED.values())
        raw, at = pa.decompress(data, n * size, "zstd", asbytes=True), 0
        for c, (kind, wide) in MOVED.items():
            x = np.frombuffer(raw, kind, n * k if wide else n, at)
            at += x.nbytes
            columns[c].append(np.cumsum(x) if c == "pos" else x.reshape(k, n).T if wide else x)
    whole = {c: np.concatenate(x) for c, x in columns.items()}
    if (whole["pos"][1:] < whole["pos"][:-1]).any():
        order = np.argsort(whole["pos"], kind="stable")
        return {c: x[order] for c, x in whole.items()}
    return whole


def write_npz(bulk: DataFrame, chunks: DataFrame, out_dir: str, alter: Callable[[str, dict], dict] | None = None) -> DataFrame:
    """Write one compressed bundle for each file name; returns (file, n). A file must fit one task, as its format asks.

    Positions are packed where they are made, so what is shuffled is one compressed value for the neighbouring
    positions of a file and no rows. ``alter`` may change the arrays of a file before they are written.
    """
    packs = bulk.select("file", *MOVED).mapInArrow(_pack, "file string, n int, k int, data binary")
    both = packs.groupBy("file").cogroup(chunks.groupBy("file"))

    def write(rows: pa.Table, parts: pa.Table) -> pa.Table:
        import numpy as np

        if not rows.num_rows:
            return pa.table({"file": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        fs, root = _fs(out_dir)
        fs.create_dir(root, recursive=True)
        name, buffer, parts = rows["file"][0].as_py(), io.BytesIO(), parts.sort_by("chunk")
        if len(rows["k"].unique()) != 1:
            raise ValueError(f"{name}: all positions need equally many candidates")
        c = _unpack(rows)
        bounds = [parts[x].combine_chunks().to_numpy(zero_copy_only=False).astype("int64") for x in ("start", "length")]
        arrays = dict(zip(ARRAYS, [*(np.ascontiguousarray(c[x]) for x in ("token", "teacher_ids", "teacher_probs", "loss_mask")), *bounds]))
        _save(buffer, alter(name, arrays) if alter else arrays)
        with fs.open_output_stream(f"{root}/.{name}.part") as f:
            f.write(buffer.getbuffer())
        fs.move(f"{root}/.{name}.part", f"{root}/{name}")
        return pa.table({"file": pa.array([name]), "n": pa.array([len(c["pos"])], pa.int64())})

    return both.applyInArrow(write, "file string, n bigint")


#: Exported arrays and their types.
NPY = {"tokens": "uint32", "tail_w": "float32", "loss_mask": "uint8"}


@dataclass
class _Written(WriterCommitMessage):
    """Files of a task, as (own name, final name), and its parts."""

    files: list[tuple[str, str]]
    parts: list[tuple]


#: Tokens of one exported part, besides the rest of its last document.
PART_TOKENS = 1 << 20


class _NpyWriter(DataSourceArrowWriter):
    """Writes rows (shard_id, part, tokens, tail_w, loss_mask), together and in order by (shard_id, part), as ``.npy`` files.

    A task writes under names of its own; what the job's committed tasks wrote is renamed when all are done.
    """

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        import numpy as np

        fs, root = _fs(self.path)
        made, now, held = [], None, []

        def flush() -> None:
            if now is None:
                return
            shard, part = now
            fs.create_dir(f"{root}/{shard}", recursive=True)
            for k, (name, kind) in enumerate(NPY.items()):
                buffer = io.BytesIO()
                np.save(buffer, np.concatenate([np.asarray(x[k], kind) for x in held]))
                own = f"{root}/{shard}/.{name}-{part:05d}-{uuid.uuid4().hex[:8]}"
                with fs.open_output_stream(own) as f:
                    f.write(buffer.getvalue())
                made.append((own, f"{root}/{shard}/{name}-{part:05d}.npy"))
            parts.append((shard, part, len(held), sum(len(x[0]) for x in held)))

        parts: list[tuple] = []
        for b in iterator:
            lists = [b.column(c) for c in NPY]
            if any(x.null_count for x in lists):
                raise ValueError("a document without tokens, tail or mask cannot be exported")
            ends = [x.offsets.to_numpy() for x in lists]
            flat = [x.values.to_numpy(zero_copy_only=False) for x in lists]
            for i, (shard, part) in enumerate(zip(b.column("shard_id").to_pylist(), b.column("part").to_pylist())):
                arrays = [x[e[i] : e[i + 1]] for x, e in zip(flat, ends)]
                if (shard, part) != now:
                    flush()
                    now, held = (shard, part), []
                held.append(arrays)
        flush()
        return _Written(made, parts)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        for m in filter(None, messages):
            for own, final in m.files:
                fs.move(own, final)
        with fs.open_output_stream(f"{root}/.parts.json") as f:
            for m in filter(None, messages):
                f.write("".join(json.dumps(dict(zip(("shard_id", "part", "n_docs", "n_tokens"), p))) + "\n" for p in m.parts).encode())
        fs.move(f"{root}/.parts.json", f"{root}/parts.json")

    def abort(self, messages: list[_Written | None]) -> None:
        fs, _ = _fs(self.path)
        for m in filter(None, messages):
            for own, _ in m.files:
                fs.delete_file(own)


class NpyParts(DataSource):
    """The sink of ``export_npy``: arrays in parts, which appear together or not at all."""

    @classmethod
    def name(cls) -> str:
        return "npy_parts"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _NpyWriter(self.options)


def export_npy(shards: DataFrame, out_dir: str, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Write each shard's tokens, tail and mask as ``.npy`` parts, for a trainer that maps them.

    A shard is cut into parts of about ``part_tokens`` in the order of documents (``tokens-00000.npy``,
    ...), so a shard of any size is written by many tasks, each of which holds one part at a time. Files get
    their names when all tasks are done; a job that fails leaves none, and removes what its tasks wrote.
    Returns (shard_id, part, n_docs, n_tokens), which ``parts.json`` keeps.
    """
    spark = shards.sparkSession
    spark.dataSource.register(NpyParts)
    off = doc_offsets(shards).select("shard_id", "doc_id", "local_doc", F.expr(f"cast(offset div {part_tokens} as int)").alias("part"))
    d = merge_join(shards.select("shard_id", "doc_id", *NPY), off, ["shard_id", "doc_id"])
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = d.repartition(n, "shard_id", "part").sortWithinPartitions("shard_id", "part", "local_doc").select("shard_id", "part", *NPY)
    d.write.format("npy_parts").mode("append").option("path", out_dir).save()
    return spark.read.schema("shard_id string, part int, n_docs bigint, n_tokens bigint").json(f"{out_dir}/parts.json")
