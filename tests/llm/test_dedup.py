"""Near-dedup, line dedup and decontamination against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate as C
from corpusloom.llm import linededup as L
from corpusloom.llm import minhash as M
from corpusloom.llm.queries import ORACLES, QUERIES
from tests.conftest import TABLES
from tests.oracle import same_rows


def shingles(text, k=3):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, num=85, den=100, k=3):
    sets, parent = {i: shingles(t, k) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            same = len(sets[a] & sets[b])
            if a < b and same and den * same >= num * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [[word() for _ in range(rng.randint(3, 120))] for _ in range(25)]
    rows = []
    for w in base:
        rows.append(" ".join(w))
        for _ in range(rng.randint(0, 6)):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = word()
            rows.append("  ".join(v).upper() if rng.random() < 0.3 else " ".join(v))
    rows += ["", None, " \n\t", "one", "one", "two words", "é ü", "É ü", "x " * 5000]
    return list(enumerate(rows))


def test_components_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("component_id", F.lit("clash")).withColumn("key", F.lit(1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in M.near_duplicates(docs, 3, (85, 100)).collect()}
    assert got == brute(rows)


def test_a_large_group_of_near_copies_is_one_component_or_as_brute_force(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = []
    for i in range(80):  # each of few edits: pairs on both sides of the threshold
        v = list(base)
        for k in rng.sample(range(60), rng.randint(1, 3)):
            v[k] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(v)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, (85, 100)).collect()}
    assert got == brute(rows)


def test_blocks_find_links_that_stars_miss(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 4)
    rows = [(i, " ".join(f"t{j}" for j in range(i * 2, i * 2 + 60))) for i in range(12)]  # a chain: neighbours link, far ends do not
    assert len({c for _, c in brute(rows).values()}) == 1
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, (85, 100)).collect()}
    assert got == brute(rows)


def test_null_and_repeated_ids_and_empty_table(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "p q r s"), (2, "p q r s")]
    got = sorted(map(tuple, M.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3).collect()), key=str)
    assert len(got) == 4 and {r[2] for r in got} == {None, 1}
    assert M.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def link_rows(rows, num=85, den=100, k=3):
    """Components of rows that may repeat ids: every text of an id counts."""
    ids, parent = sorted({i for i, _ in rows}), {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, k)) for i, t in rows]
    for i, a in sets:
        for j, b in sets:
            same = len(a & b)
            if i < j and same and den * same >= num * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return sorted((i, len(s), find(i)) for i, s in sets) if ids else []


def test_texts_that_share_an_id_keep_their_own_links(spark):
    text = lambda p, *odd: " ".join(f"{p}{'x' if k in odd else k}" for k in range(60))
    rows = [(5, text("a")), (5, text("b")), (7, text("a", 59)), (8, text("b", 59)), (9, text("c")), (9, text("a", 0)), (10, text("c", 3))]
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        got = M.near_duplicates(spark.createDataFrame(order, "doc_id bigint, text string"), 3, (85, 100)).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == link_rows(rows)


def test_fresh_centres_and_main_components_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(M, "LARGE", 4)
    monkeypatch.setattr(M, "BLOCK", 4)
    rng = random.Random(13)
    rows, base = [], [f"w{rng.randrange(10**6)}" for _ in range(60)]
    for i in range(70):
        v = list(base)
        for k in rng.sample(range(60), rng.randint(0, 4)):
            v[k] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(v)))
    rows += [(100 + i, " ".join(f"t{j}" for j in range(i * 2, i * 2 + 60))) for i in range(12)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, (85, 100)).collect()}
    assert got == brute(rows)


def test_components_equal_sql(spark, small):
    same_rows(QUERIES["op1_near_dedup"](spark, small), ORACLES["op1_near_dedup"], small, TABLES)


def test_intermediate_tables_are_deleted(spark):
    import os

    from corpusloom.runtime import shared_base

    folder = shared_base(spark).removeprefix("file://") + "/corpusloom"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    M.near_duplicates(spark.createDataFrame(corpus(), "doc_id bigint, text string"), 3)
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before] == ["dedup-result"]


def test_the_stage_keeps_one_of_rows_that_repeat_id_and_text(spark):
    same = " ".join(f"w{k}" for k in range(30))
    rows = [(1, same, "x"), (1, same, "x"), (2, same, "y"), (3, "other words of a third text", "z"), (3, "a wholly different text of row three", "z"), (None, same, "n"), (None, same, "n"), (4, None, "e"), (5, "", "e")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, kept string")
    out = M.near_dedup_stage(spark, d, "")
    assert out.columns == d.columns
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [rows[0], *rows[3:]]))
    assert M.near_dedup_stage(spark, d.limit(0), "").count() == 0


def test_sketch_estimates_similarity_and_fills():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 1 << 63, 1200).astype(np.uint64)
    a, b = np.unique(x[:1000]), np.unique(x[200:])
    want = 800 / 1200
    assert abs((M.sketch(a) == M.sketch(b)).mean() - want) < 5 * (want * (1 - want) / M.COORDINATES) ** 0.5
    for n in (1, 2, 5, 50):
        s = M.sketch(a[:n])
        assert len(s) == M.COORDINATES and (s != np.iinfo(np.uint64).max).all()


def test_intersections_equal_sets():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (0, 5, 20, 40)]
    got = M.intersections(sets[1:], sets, width=7)
    assert [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets[1:]] == got.astype(int).tolist()


def test_lines_equal_sql(spark, small):
    same_rows(QUERIES["op8_line_dedup"](spark, small), ORACLES["op8_line_dedup"], small, TABLES)


def test_recurring_lines_stay_once_and_numbers_are_variable(spark):
    note = "Order {} was sent to the customer on day {} of May."
    rows = [(i, f"unique text number{'abcdefghij'[i]} of this document only.\n{note.format(i * 17, i)}\nshort line.\n") for i in range(5)]
    rows += [(5, None), (6, ""), (7, rows[0][1])]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("seg", F.lit(0)).withColumn("key", F.lit("x"))
    out = {r["doc_id"]: r["text"] for r in L.drop_recurring_lines(d).select("doc_id", "text").collect()}
    assert [i for i in range(5) if "Order" in out[i]] == [0]
    assert all("unique text" in out[i] and "short line." in out[i] for i in range(5))
    assert out[5] is None and out[6] == ""
    assert L.drop_recurring_lines(d.limit(0)).count() == 0


def test_copies_of_a_whole_text_are_left_to_near_dedup(spark):
    text = "one line of some eight or nine words here.\nand another line of quite a few words."
    d = spark.createDataFrame([(i, text) for i in range(6)], "doc_id bigint, text string")
    assert all(r["text"] == text for r in L.drop_recurring_lines(d).collect())


def test_lines_that_agree_on_their_beginning_alone_are_kept(spark):
    head = "The quick brown fox jumps over the lazy"
    rows = [(k, f"{head} {t}.\nSome line of its own is here {t}.\n") for k, t in enumerate(("dog today", "cat never", "cow slowly", "hen twice"))]
    out = L.drop_recurring_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in out} == dict(rows)


def test_a_field_behind_the_leading_tokens_is_generalised(spark):
    line = "The parcel for this street was given to the keeper {} of the old house."
    rows = [(k, f"own words {n} of this text only.\n{line.format(n)}\n") for k, n in enumerate(("Anna", "Berta", "Clara", "Dora"))]
    out = {r["doc_id"]: r["text"] for r in L.drop_recurring_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [k for k in sorted(out) if "parcel" in out[k]] == [0] and all("own words" in t for t in out.values())


def test_rows_that_repeat_an_id_keep_their_own_lines(spark):
    note = "this line of nine words recurs in many texts."
    rows = [(3, f"first row has one.\n{note}\n"), (3, f"{note}\nIts second line is unique and must not be lost at all.\n"), (4, f"a fourth text.\n{note}\n"), (None, f"no id here.\n{note}\n"), (None, "another row without an id and without the note."), (None, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = L.drop_recurring_lines(d).collect()
    texts = [r["text"] for r in out]
    assert len(out) == 6 and sum(note in (t or "") for t in texts) == 1
    assert any(t and "Its second line is unique" in t for t in texts) and rows[4][1] in texts and None in texts
    long = "word " * 30_000 + "end."
    got = L.drop_recurring_lines(spark.createDataFrame([(1, long), (2, long + " tail"), (3, "x")], "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["__l_dropped"] for r in got} == {1: 0, 2: 1, 3: 0}  # the first stop ends the line


def test_the_stage_drops_long_lines_of_two_texts_and_short_ones_of_three(spark):
    note, short = "The parcel {} was handed over at the gate on day {}.", "all rights of this kept."
    rows = [(i, f"own words {'abcd'[i]} of this one only here.\n{note.format(i, i + 3) if i < 2 else ''}\n{short if i > 1 else ''}\n") for i in range(4)]
    rows.append((4, rows[1][1]))  # copies of one text count once
    out = {r["doc_id"]: r["text"] for r in L.line_dedup_stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()}
    assert [i for i in out if "parcel" in out[i]] == [0] and [i for i in sorted(out) if short in out[i]] == [2, 3]
    assert len(out) == 5 and all("own words" in t for t in out.values())


def test_the_stage_finds_a_passage_in_mid_sentence_without_marks(spark):
    rng = random.Random(10)
    some = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage, own = some(60), [(some(9 + i), some(30 - i)) for i in range(4)]
    rows = [(i, f"{a} {passage} {b}") for i, (a, b) in enumerate(own[:3])] + [(None, f"{own[3][0]}\n{own[3][1]}"), (9, None), (9, ""), (8, "x " * 100), (7, "x " * 90 + "y")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = L.line_dedup_stage(spark, d, "")
    got = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert out.columns == d.columns
    assert got >= {rows[0], *((i, f"{own[i][0]} {own[i][1]}") for i in (1, 2)), rows[3], (9, None), (9, "")}
    runs = {r["doc_id"]: r["text"] for r in L.drop_recurring_runs(d.where("doc_id in (7, 8)")).collect()}
    assert runs[7].split() == ["x"] * 16 + ["y"] and not runs[8].split()
    assert L.drop_recurring_runs(d.limit(0)).count() == 0


def test_runs_equal_brute_force(spark):
    rng = random.Random(11)
    bits = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(3, 40))) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(bits) if rng.random() < 0.5 else f"u{rng.randrange(10**6)}" for _ in range(rng.randint(1, 12)))) for i in range(40)]
    texts, first = defaultdict(set), {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - L.RUN + 1):
            texts[tuple(w[k : k + L.RUN])].add(t)
            first.setdefault(tuple(w[k : k + L.RUN]), (i, k))
    want = {}
    for i, t in rows:
        w, gone = t.split(), set()
        for k in range(len(w) - L.RUN + 1):
            g = tuple(w[k : k + L.RUN])
            if len(texts[g]) > 1 and (first[g][0] != i or k >= first[g][1] + L.RUN):
                gone |= set(range(k, k + L.RUN))
        want[i] = [x for k, x in enumerate(w) if k not in gone]
    got = {r["doc_id"]: r["text"].split() for r in L.drop_recurring_runs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want and any(len(want[i]) < len(t.split()) for i, t in rows)


def items_and_docs():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7)))
    common = [word() for _ in range(40)]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else word() for _ in range(n))
    items = [(k, f"{text(rng.randint(12, 30))}. {text(8)}.") for k in range(70)]
    docs = []
    for i in range(60):
        t = text(rng.randint(5, 400))
        if i % 3 == 0:
            cut = t.split(" ")
            k = rng.randrange(len(cut))
            t = " ".join([*cut[:k], items[i][1].upper() if i % 2 else items[i][1], *cut[k:]])
        docs.append((i, t))
    return items, docs


def entries_by_hand(items):
    """(item, question, answer, impacts) of every entry, from the formula of BM25."""
    cut = []
    for i, t in items:
        q, a = C.split_item(t or "")
        words = q + a
        cut += [(i, q, a, words[k : k + 64]) for k in range(0, len(words), 64) if k == 0 or len(words) - k >= 8]
    df = Counter(w for *_, words in cut for w in set(words))
    mean = sum(len(w) for *_, w in cut) / max(1, len(cut))
    out = []
    for i, q, a, words in cut:
        n = Counter(words)
        raw = {w: math.log(1 + (len(cut) - df[w] + 0.5) / (df[w] + 0.5)) * n[w] * 2.2 / (n[w] + 1.2 * (0.25 + 0.75 * len(words) / mean)) for w in n}
        out.append((i, q, a, {w: x / sum(raw.values()) for w, x in raw.items()}))
    return out


def leaks_by_hand(entries, text, threshold=0.6):
    """Items found in a text: every passage is scored against every entry, and words and neighbours are counted one by one."""
    words, found = re.findall(r"\w+", (text or "").lower()), set()
    for p in range(-2, len(words) // 32 + 1):
        lo, hi = max(0, p * 32), (p + 3) * 32
        seen = set(words[lo:hi])
        for i, q, a, impact in entries:
            if sum(x for w, x in impact.items() if w in seen) < threshold - 1e-9:
                continue
            near = words[max(0, lo - len(q) - len(a)) : hi + len(q) + len(a)]
            good = True
            for part in (q, a):
                if not part:
                    continue
                here = sum(w in near for w in part) / len(part)
                if len(part) > 1:
                    next_to = sum(any(near[k] == x and y in near[k + 1 : k + 3] for k in range(len(near))) for x, y in zip(part, part[1:])) / (len(part) - 1)
                    here = (here + next_to) / 2 if next_to >= 0.25 else next_to
                good = good and here >= 0.5
            if good:
                found.add(i)
    return found


def test_wand_equals_exhaustive_scores_with_ties():
    rng = random.Random(1)
    for _ in range(60):
        words = [f"w{k}" for k in range(rng.choice([5, 30, 200]))]
        items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 100)))) for i in range(rng.randint(1, 200))]
        ix = C.Index(items, rng.choice([0.2, 0.4, 0.6]))
        impacts = [x for *_, x in entries_by_hand(items)]
        for _ in range(4):
            seen = {rng.choice(words) for _ in range(rng.randint(1, 60))}
            scores = [(e, sum(x for w, x in impact.items() if w in seen)) for e, impact in enumerate(impacts)]
            clear = {e for e, x in scores if x >= ix.threshold + 1e-8}
            got = dict(ix.wand(seen))
            assert clear <= got.keys() <= {e for e, x in scores if x >= ix.threshold - 1e-8}
            assert all(abs(got[e] - x) < 1e-9 for e, x in scores if e in got)


def test_passages_equal_scores_of_all_entries():
    items, docs = items_and_docs()
    ix, entries = C.Index(items), entries_by_hand(items)
    for _, t in docs:
        words = C._WORD.findall(t.lower())
        found = set(ix.passages(words))
        for p in range(-2, len(words) // C.STRIDE + 1):
            seen = set(words[max(0, p * C.STRIDE) : (p + 3) * C.STRIDE])
            if any(sum(x for w, x in impact.items() if w in seen) >= ix.threshold for *_, impact in entries):
                assert p in found
        assert {h[0] for h in ix.search(t)} == leaks_by_hand(entries, t)


@pytest.mark.parametrize("lost, put_in, least", [(0.0, 0.0, 1.0), (0.05, 0.0, 0.97), (0.1, 0.0, 0.9), (0.0, 0.1, 0.97), (0.1, 0.1, 0.9), (0.2, 0.0, 0.8)])
def test_recall_of_changed_items(lost, put_in, least):
    import duckdb

    items = duckdb.sql("select item_id, text from '/root/testdata/sf0.01/benchmark.parquet' order by 1").fetchall()
    ix, rng = C.Index(items), random.Random(6)
    other = [f"zq{k}" for k in range(3000)]
    around = lambda: [rng.choice(other) for _ in range(rng.randint(50, 150))]
    hits = []
    for _ in range(5):
        for i, t in items:
            words = [x for w in t.split() if rng.random() >= lost for x in ([w, rng.choice(other)] if rng.random() < put_in else [w])]
            hits.append(any(h[0] == i for h in ix.search(" ".join([*around(), *words, *around()]))))
    assert sum(hits) / len(hits) >= least
    clean = duckdb.sql("select d.text from '/root/testdata/sf0.01/documents.parquet' d order by doc_id limit 200").fetchall()
    shuffled = [" ".join(rng.sample(t.split(), len(t.split()))) for (t,) in clean if t and not ix.search(t)]
    assert not any(ix.search(t) for t in shuffled)


def test_leaks_are_found_and_clean_texts_left(spark):
    items, docs = items_and_docs()
    bench = spark.createDataFrame([*items, (99, None), (98, "")], "item_id bigint, text string")
    d = spark.createDataFrame([*docs, (1000, None), (1001, "")], "doc_id bigint, text string").withColumn("item_id", F.lit(1))
    want = {(i, i) for i in range(0, 60, 3)}
    for most in (20_000, 25):
        out = C.find_leaks(d, bench, max_items=most)
        got = {(r["doc_id"], r["i"]) for r in out.select("doc_id", F.explode("__leaks.item_id").alias("i")).collect()}
        assert got == want
    assert C.find_leaks(d, bench.limit(0)).where(F.size("__leaks") > 0).count() == 0


def test_leaks_of_long_texts_repeated_rows_and_repeated_items(spark):
    items, _ = items_and_docs()
    bench = spark.createDataFrame([*items[:8], items[3], (3, items[5][1])], "item_id bigint, text string")
    long = "filler words here " * 30_000 + items[3][1] + " more filler" * 5000
    rows = [(1, long), (2, items[5][1]), (2, items[5][1]), (None, items[0][1]), (4, "clean words only")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("h", F.lit("clash"))
    want = [(1, (3,)), (2, (3, 5)), (2, (3, 5)), (None, (0,)), (4, ())]
    for most in (20_000, 4):
        got = [(r["doc_id"], tuple(sorted(x["item_id"] for x in r["__leaks"]))) for r in C.find_leaks(d, bench, max_items=most).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_question_alone_is_no_leak():
    items, _ = items_and_docs()
    q = re.split(r"(?<=[.!?])\s+", items[3][1])[0]
    assert C.Index(items).search(f"before {q} after") == []
    assert defaultdict(int, {h[0]: 1 for h in C.Index(items).search(items[3][1])}) == {3: 1}
