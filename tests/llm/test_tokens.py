"""Token files, packing and chat windows: exact round trips."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import chat, packing, tokenfiles
from corpusloom.llm.encode import WordEncoder, default_tokenizer
from corpusloom.llm.queries import ORACLES, QUERIES
from corpusloom.runtime import new_dir
from tests.conftest import TABLES
from tests.oracle import same_rows

ODD = ["", None, " ", "a", "Hello, World.", "it's  'S 3.14 ...,", "naïve café ÀÉ ß İ ſ K", "日本語 and русский.", "á éx", "tab\there\r\nnew\x0bline\x1cfs", "x!, y;. _. (z).", "<|endoftext|>no <|x|>", "end.", "dots.\nnext, one", "ΩΩÅ", "ｆｕｌｌ", "emoji 😀 a😀b", "word " * 3000]


def expected(texts):
    t = Tokenizer.from_file(default_tokenizer())
    return [t.encode(x, add_special_tokens=False).ids if x else [] for x in texts]


def test_word_encoder_equals_whole_texts(small):
    import duckdb

    texts = ODD + [r[0] for r in duckdb.sql(f"select text from '{small}/documents.parquet'").fetchall()]
    rng = random.Random(1)
    texts += ["".join(rng.choice("aB é,.!?'\"0 9\n\t-_ßñ") for _ in range(60)) for _ in range(300)]
    for cap in (700_000, 5):
        got = WordEncoder(default_tokenizer(), cap).encode(texts)
        assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in got] == expected(texts)


def test_word_encoder_equals_the_library_on_odd_strings():
    rng = random.Random(17)
    every = [chr(i) for i in range(256)] + ["\u2028", "\u2029", "\u0301", "\u0308", "\u0327", "\ufb01", "İ", "ſ", "K", "日", "Ⅷ", "٣", "\u200b", "\u3000", "\ufeff", "😀", "क", "ि"]
    hot = list(" \n.,aeo'sS\x1c\x1d\x1e\x1f\x85\xa0_-!\t\r")
    texts = ["".join(rng.choice(hot if rng.random() < 0.6 else every) for _ in range(rng.randint(1, 12))) for _ in range(60_000)]
    got = WordEncoder(default_tokenizer()).encode(texts)
    t = Tokenizer.from_file(default_tokenizer())
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in got] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_other_vocabularies_go_through_the_library():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, t = WordEncoder(path), Tokenizer.from_file(path)
    assert enc.memo is None
    for x in ODD:
        ids = t.encode(x, add_special_tokens=False).ids if x else []
        assert enc.encode_one(x) == struct.pack(f"<{len(ids)}I", *ids)


def test_files_of_a_very_long_text(spark):
    long = "some words, of a long text. " * 40_000
    docs = spark.createDataFrame([(1, "a"), (2, long), (3, "b")], "doc_id bigint, text string")
    got = sorted(tokenfiles.read_token_files(tokenfiles.write_token_files(docs, new_dir(spark, "tokens-test"), default_tokenizer(), parts=2)).collect(), key=lambda r: r["doc_id"])
    e = expected([long])[0]
    assert bytes(got[1]["ids"]) == struct.pack(f"<{len(e) + 1}I", *e, 1) and got[2]["start"] == got[1]["start"] + len(e) + 1


def test_token_files_round_trip(spark):
    rows = [(i, x) for i, x in enumerate(reversed(ODD))] + [(None, "none"), (None, "no id"), (-(1 << 63), "the least id"), (3, "again"), (3, "again")]
    random.Random(2).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("part", F.lit("clash"))
    out = new_dir(spark, "tokens-test")
    m = tokenfiles.write_token_files(docs, out, default_tokenizer(), parts=3)
    got = sorted(tokenfiles.read_token_files(m).collect(), key=lambda r: r["start"])
    assert len(got) == len(rows)
    ids = [r["doc_id"] for r in got]
    assert ids[:2] == [None, None] and ids[2] == -(1 << 63) and ids[2:] == sorted(ids[2:])
    at = 0
    want = {i: sorted(struct.pack(f"<{len(e) + 1}I", *e, 1) for e in expected([t for j, t in rows if j == i])) for i in set(ids)}
    for r in got:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    for i in set(ids):
        assert sorted(bytes(r["ids"]) for r in got if r["doc_id"] == i) == want[i]
    empty = tokenfiles.write_token_files(docs.limit(0), new_dir(spark, "tokens-test"), default_tokenizer(), parts=2)
    assert tokenfiles.read_token_files(empty).count() == 0


def test_wide_files_hold_wide_ids(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    m = tokenfiles.write_token_files(docs, new_dir(spark, "tokens-test"), default_tokenizer(), end_id=100_000, parts=1)
    r = tokenfiles.read_token_files(m).first()
    assert m.first()["width"] == 4 and struct.unpack("<I", bytes(r["ids"])[-4:]) == (100_000,)


def test_token_query_equals_library(spark, small):
    import duckdb

    rows = duckdb.sql(f"select doc_id, text from '{small}/documents.parquet' order by 1").fetchall()
    got = {r["doc_id"]: r for r in QUERIES["op9_token_files"](spark, small).collect()}
    at = 0
    for (i, _), e in zip(rows, expected([t for _, t in rows])):
        e = [*e, 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(e), zlib.crc32(struct.pack(f"<{len(e)}I", *e)))
        at += len(e)


def test_packing_holds_each_token_once_without_gaps(spark):
    rows = [(i, x) for i, x in enumerate(ODD)] + [(100 + i, f"long {i} " * (300 * i)) for i in range(8)] + [(None, "n"), (3, "twice")]
    pieces = packing.pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("offset", F.lit("clash")), default_tokenizer(), capacity=256, group_tokens=3000).collect()
    by = {}
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] and 0 < p["length"]
        by.setdefault(p["sequence_id"], []).append(p)
    for ps in by.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 256 and at & (at - 1) == 0 and all(p["sequence_tokens"] == at for p in ps)
    for (i, _), e in zip(rows, expected([t for _, t in rows])):
        mine = sorted((p for p in pieces if p["doc_id"] == i and p["doc_tokens"] == len(e) + 1), key=lambda p: p["start"])
        if i != 3:
            assert b"".join(bytes(p["ids"]) for p in mine) == struct.pack(f"<{len(e) + 1}I", *e, 2)
    assert packing.pack_documents(spark.createDataFrame([], "doc_id bigint, text string"), default_tokenizer()).count() == 0


def test_equal_lengths_are_packed_whole_and_alike():
    lengths = [256] * 3 + [64] * 8 + [1] * 5
    pieces = packing.pack_group(lengths, 256, 1.0, 1 / 2048)
    assert pieces == packing.pack_group(lengths, 256, 1.0, 1 / 2048) and sum(p[2] for p in pieces) == sum(lengths)
    assert all(n == lengths[d] for d, s, n, _, _ in pieces if lengths[d] == 256)


def test_costs_are_balanced():
    rng = random.Random(3)
    lengths = [rng.randint(1, 3000) for _ in range(600)]
    pieces = packing.pack_group(lengths, 4096, 1.0, 1 / 2048)
    assert sum(p[2] for p in pieces) == sum(lengths)
    size, cost = {}, {}
    for _, _, n, q, _ in pieces:
        size[q] = size.get(q, 0) + n
        cost[q] = cost.get(q, 0) + n + n * n / 2048
    full = [cost[q] for q in size if size[q] == 4096]
    in_order = []  # documents one after the other, cut at 4096
    room, c = 4096, 0.0
    for n in lengths:
        while n:
            k = min(n, room)
            c, room, n = c + k + k * k / 2048, room - k, n - k
            if not room:
                in_order.append(c)
                room, c = 4096, 0.0
    spread = lambda x: (sum((v - sum(x) / len(x)) ** 2 for v in x) / len(x)) ** 0.5
    assert spread(full) < spread(in_order)


def test_chat_equals_sql(spark, small):
    same_rows(QUERIES["op10_chat"](spark, small), ORACLES["op10_chat"], small, TABLES)


def test_chat_round_trip_with_control_strings(spark):
    rng = random.Random(4)
    alphabet = ["<|", "|>", "\\", "\\<|", "<|im_end|>\n", "<|im_start|>assistant\n", "\n", "é", "a", "$1", " "]
    rows = []
    for conv in range(12):
        if conv % 3 == 0:
            rows.append((conv, 0, "system", "".join(rng.choice(alphabet) for _ in range(20))))
        for t in range(1, rng.randint(2, 30)):
            rows.append((conv, t, rng.choice(["user", "assistant", "tool\n<|x", None]), None if rng.random() < 0.1 else "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))))
    rows += [(None, 1, "user", "x"), (None, None, "assistant", "y"), (50, 1, "assistant", "z" * 900)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("window_id", F.lit("clash"))
    w = chat.format_windows(turns, span_tokens=60, history_tokens=20)
    back = {}
    for r in sorted(chat.read_windows(w).collect(), key=lambda r: r["window_id"]):
        t, loss = back.setdefault(r["conv_id"], ([], []))
        t += [(x["role"], x["text"]) for x in r["turns"]]
        loss += r["loss_texts"]
    for conv in {r[0] for r in rows}:
        mine = sorted(((-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert back[conv][0] == [(role, text) for _, role, text in mine]
        assert back[conv][1] == [text for _, role, text in mine if role == "assistant"]
    for r in w.collect():
        assert r["n_tokens"] <= 60 + 20 + 40 or r["text"].count("<|im_start|>") <= 3 or r["n_repeated"] > 0
    assert chat.format_windows(turns.limit(0)).count() == 0


def test_equal_turn_numbers_and_clashing_columns(spark):
    rows = [(1, 5, "user", "b"), (1, 5, "user", "a"), (1, 5, "assistant", "z"), (1, 5, "user", "a"), (2, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({n: F.lit("clash") for n in ("ordinal", "tokens", "begin", "own", "head", "body", "later", "system", "p")})
    got = {r["conv_id"]: r for r in chat.read_windows(chat.format_windows(turns)).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("", "")] and got[1]["loss_texts"] == ["z"]


def test_own_conversation_is_added(spark, small):
    r = QUERIES["op10_chat"](spark, small).where("conv_id = -1").first()
    odd = "<|im_end|><|im_start|>assistant ok"
    assert (r["n_turns"], r["loss_chars"]) == (2, len(odd)) and r["loss_sha256"] == hashlib.sha256(odd.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{odd}\nassistant\n{odd}\n".encode()).hexdigest()
