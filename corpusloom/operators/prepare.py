"""Word documents: what the queries feed to the operators in place of a tokenizer's output."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.batches import cuts

#: Ids of ``token_of`` lie below this.
VOCAB = 997


def words_of(text: Column) -> Column:
    """Words between spaces, tabs and line ends; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\f"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \t\n\r\f]+"))


def token_of(word: Column) -> Column:
    """A small stand-in id of a word: from its first and last letter and its length."""
    first, last = F.ascii(word), F.ascii(F.substring(word, -1, 1))
    return ((first * 131 + last * 17 + F.char_length(word) * 7) % VOCAB).cast("bigint")


def word_docs(docs: DataFrame) -> DataFrame:
    """(shard_id, doc_id, words, tokens) for documents of one word or more; shards are sources."""
    # the filter looks at the text: one on the words would split it twice
    d = docs.where(F.col("text").rlike("[^ \t\n\r\f]")).select(F.col("source").alias("shard_id"), "doc_id", words_of(F.col("text")).alias("words"))
    return d.withColumn("tokens", F.transform("words", token_of))


#: Bytes of the texts that are looked at together, unless one text has more.
TEXT_BYTES = 4 << 20
_BLANK = np.isin(np.arange(256), [ord(x) for x in " \t\n\r\f"])


def _code_points(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points that begin at these bytes of UTF-8, behind which three more bytes can be read."""
    head = b[at]
    code = head.astype(np.int64)
    for low, high, more in ((0xC0, 0xDF, 1), (0xE0, 0xEF, 2), (0xF0, 0xFF, 3)):
        k = np.nonzero((head >= low) & (head <= high))[0]
        if len(k):
            v = b[at[k]].astype(np.int64) & (0x3F >> more)
            for i in range(1, more + 1):
                v = v << 6 | (b[at[k] + i] & 0x3F)
            code[k] = v
    return code


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``token_of`` of all words of texts, given as bytes and where each text begins: (tokens, where each list begins)."""
    word = ~_BLANK[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    filled = offsets[:-1] < offsets[1:]
    begin, end = offsets[:-1][filled], offsets[1:][filled] - 1
    first[begin], last[end] = word[begin], word[end]
    first, last = np.nonzero(first)[0], np.nonzero(last)[0]
    lead = (data & 0xC0) != 0x80
    seen = np.cumsum(lead)
    chars = seen[last] - seen[first] + 1
    for _ in range(3):
        last = last - ~lead[last]
    b = np.concatenate([data, np.zeros(3, np.uint8)])
    return (_code_points(b, first) * 131 + _code_points(b, last) * 17 + chars * 7) % VOCAB, np.searchsorted(first, offsets)


def token_docs(docs: DataFrame) -> DataFrame:
    """(shard_id, doc_id, tokens) of ``word_docs``, without the words: texts are cut as bytes, many at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2).cast(pa.large_string()).fill_null("")
            at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            for i, j in cuts(np.diff(at), TEXT_BYTES):
                tokens, begin = tokens_of(data[at[i] : at[j]], at[i : j + 1] - at[i])
                some = pa.array(np.diff(begin) > 0)
                lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(tokens, pa.int64()))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["shard_id", "doc_id", "tokens"]).filter(some)

    kinds = dict(docs.dtypes)
    return docs.select(F.col("source").alias("shard_id"), "doc_id", "text").mapInArrow(run, f"shard_id {kinds['source']}, doc_id {kinds['doc_id']}, tokens array<bigint>")


def positions(word_documents: DataFrame) -> DataFrame:
    """(shard_id, doc_id, pos, token)."""
    return word_documents.select("shard_id", "doc_id", F.posexplode("tokens").alias("pos", "token"))


#: The same in DuckDB: ``wd`` (shard_id, doc_id, words, tokens) and ``ps`` (shard_id, doc_id, pos, token).
WD_SQL = r"""wd AS (SELECT shard_id, doc_id, words, list_transform(words, lambda w: ((unicode(w[1]) * 131 + unicode(w[-1]) * 17 + length(w) * 7) % 997)::BIGINT) AS tokens
  FROM (SELECT source AS shard_id, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\f]+'), lambda w: w <> '') AS words FROM documents) WHERE len(words) > 0)"""
PS_SQL = WD_SQL + ", ps AS (SELECT shard_id, doc_id, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token FROM wd)"
