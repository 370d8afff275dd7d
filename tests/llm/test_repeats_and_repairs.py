"""Spelling variants, substring dedup and conversation repair: SQL, brute force, odd rows and hot groups."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import repair as R
from corpusloom.llm import spelling as S
from corpusloom.llm import substring as U
from corpusloom.llm.queries import ORACLES, QUERIES
from tests.conftest import TABLES
from tests.oracle import same_rows


@pytest.mark.parametrize("name", ["op11_spelling", "op12_substring_dedup", "op13_repair"])
def test_query_equals_sql(spark, small, name):
    same_rows(QUERIES[name](spark, small), ORACLES[name], small, TABLES)


def near(a, b):
    """One code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def spelling_by_hand(rows, least_length=6, least_count=5):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least_length and k >= least_count}
    out = {}
    for w in n:
        others = sorted((-n[v], v) for v in n if near(w, v))
        form = others[0][1] if others and n[others[0][1]] >= 5 * n[w] else None
        out[w] = (form, n[w], len(others), n[form] if form else None)
    root = lambda w: root(out[w][0]) if out[w][0] else w
    return {w: (f, root(w), k, m, g) for w, (f, k, m, g) in out.items()}


def spelling_of(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spelling_equals_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        words = []
        for _ in range(120):
            w = "".join(rng.choice("aabé") for _ in range(rng.randint(5, 7)))
            words += [w.upper() if rng.random() < 0.1 else w] * rng.choice([1, 1, 2, 12])
        rows.append((i, rng.choice([" ", ", ", "1", "\u0178"]).join(words)))
    rows += [(7, None), (None, "ababab " * 9), (8, ""), (8, ""), (9, "École ÷×÷×÷×÷ " * 6), (10, "x" * 50_000), (11, "zzzzzz " * 40), (11, "zzzzzzz " * 6)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"word": F.lit("clash"), "n": F.lit(1), "id": F.lit(2)})
    want = spelling_by_hand(rows)
    assert spelling_of(S.spelling_variants(d)) == want and sum(m > 0 for *_, m, _ in want.values()) > 50
    assert S.spelling_variants(d.limit(0)).count() == 0


def test_roots_follow_long_chains(spark):
    # each word is near the next only, and five times as rare
    words = ["aaaaaaaa" [: 8 - k] + "bbbbbbbb"[:k] for k in range(7)]
    text = " ".join(" ".join([w] * 5 * 5**k) for k, w in enumerate(words))
    got = spelling_of(S.spelling_variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), mark_every=1 << 40))
    assert all(got[w][1] == words[-1] for w in words) and got[words[0]][0] == words[1] and got[words[-1]][0] is None


def test_equally_common_forms_go_by_code_points(spark):
    text = " ".join(["abcdef"] * 5 + ["abcdeg"] * 30 + ["abcdee"] * 30 + ["éabcdef"] * 30)
    got = spelling_of(S.spelling_variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), mark_every=1 << 40))
    assert got["abcdef"] == ("abcdee", "abcdee", 5, 3, 30)


def test_windows_share_anchors_at_one_offset():
    for window in (1, 2, 5, 13, 30, 50, 200):
        period, cover, anchor = U.cover_of(window)
        assert window == anchor + period - 1
        for a, b in itertools.product(range(period), repeat=2):
            assert any((a + k) % period in cover and (b + k) % period in cover for k in range(period))


def repeats_by_hand(rows, window):
    first = {}
    cut = [(i, re.findall("[^\\x20\\x09-\\x0d]+", t or "")) for i, t in rows]
    for i, w in cut:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if i is not None:
                first[g] = min(i, first.get(g, i))
    out = []
    for i, w in cut:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def passages(rng, n, words=400):
    word = lambda: f"w{rng.randrange(words)}"
    shared = [[word() for _ in range(rng.randint(5, 40))] for _ in range(12)]
    rows = []
    for i in range(n):
        t = []
        for _ in range(rng.randint(0, 4)):
            t += [word() for _ in range(rng.randint(0, 20))]
            if rng.random() < 0.7:
                p = rng.choice(shared)
                a = rng.randrange(len(p))
                t += p[a:] if rng.random() < 0.3 else p
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(t)))
    return rows


@pytest.mark.parametrize("window", [3, 9, 14])
def test_passages_equal_brute_force(spark, window):
    rng = random.Random(window)
    rows = passages(rng, 150)
    rows += [(200 + k, rows[k % 7][1]) for k in range(30)]  # copies of whole texts
    rows += [(3, rows[9][1]), (3, rows[3][1]), (None, rows[5][1]), (None, None), (400, None), (401, ""), (402, " \n"), (403, "a\u00a0b \u2003c " * 9), (404, "same " * 200), (405, "same " * 90)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"tag": F.lit(1), "pos": F.lit(2), "copy": F.lit(True), "first": F.lit("x")})
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in U.remove_repeats(d, window).collect()), key=str)
    assert got == repeats_by_hand(rows, window) and sum(x[2] for x in got) > 500
    assert U.remove_repeats(d.limit(0), window).count() == 0


def test_long_texts_with_a_hot_passage(spark):
    rng = random.Random(4)
    p = " ".join(f"p{k}" for k in range(70))
    rows = [(i, f"own{i} " * 3 + p + f" end{i}" * 4) for i in range(300)]
    rows.append((300, " ".join(f"q{rng.randrange(10**6)}" for _ in range(150_000)) + " " + p))
    got = {r["doc_id"]: r for r in U.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[0]["n_removed"] == 0 and all(got[i]["n_removed"] == 70 for i in range(1, 301))
    assert got[7]["kept"] == "own7 own7 own7 end7 end7 end7 end7" and got[300]["n_words"] == 150_070


def rows_by_hand(rows):
    """Rows with their faults, in order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
    seen, out = set(), []
    for turn, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def repair_by_hand(rows):
    """Least (cost, audit) with its rows, by trying every edit (at most two inserts in one place)."""
    now = {"start": [(0, "", "", [])]}
    after = {"start": "u", "s": "u", "u": "a", "a": "u"}
    role = {"u": "user", "a": "assistant"}
    for _, r, t, fault in rows:
        ways = []
        for q, paths in now.items():
            for cost, audit, _, lines in paths:
                for k in range(3):
                    c, a, p, l = cost, audit, q, list(lines)
                    for _ in range(k):
                        p = after[p]
                        c, a, l = c + 5, a + "I", [*l, f"{role[p]}:"]
                    ways.append((p, c + 2, a + "D", l))
                    if fault in ("blank", "duplicate"):
                        continue
                    c += 5 * (fault == "truncated")
                    if r[:1] == after[p] or r[:1] == "s" and p == "start":
                        ways.append((r[:1], c, a + "K", [*l, f"{r}:{t}"]))
                    ways.append((after[p], c + 1, a + "R", [*l, f"{role[after[p]]}:{t}"]))
        now = defaultdict(list)
        for q, c, a, l in ways:
            now[q].append((c, a, "", l))
        now = {q: [min(v)] for q, v in now.items()}
    ends = []
    for q, paths in now.items():
        for c, a, _, l in paths:
            more = {"start": [], "a": [], "u": ["assistant:"], "s": ["user:", "assistant:"]}[q]
            ends.append((c + 5 * len(more), a + "I" * len(more), [*l, *more]))
    return min(ends)


def report_by_hand(rows):
    f = rows_by_hand(rows)
    turns = [t for t, *_ in f if t is not None]
    count = lambda x: sum(r[3] == x for r in f)
    initials = [r[1][:1] for r in f]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, lines = repair_by_hand(f)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit), lines


def conversations(rng, n, longest):
    for c in range(n):
        for k in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""])
            yield c, rng.choice([k, k, k, k + 3, None]), role, rng.choice(["Yes.", "no", "Why?", " ", "", "So!\n", "and then", "a.b", "Ça va?", "x" * rng.randint(1, 4) + "."])


@pytest.mark.parametrize("segment", [1, 2, 5, 4096])
def test_repairs_equal_brute_force_whatever_the_segments(spark, segment):
    rows = list(conversations(random.Random(segment), 60, 9)) + [(None, 1, "user", "Hi."), (None, 2, "user", "Hi again."), (99, 0, "system", "Be kind.")]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"rank": F.lit(1), "segment": F.lit("x"), "look": F.lit(1)})
    report, out = R.repair_conversations(d, segment)
    by, lines = defaultdict(list), defaultdict(list)
    for c, *r in rows:
        by[c].append(tuple(r))
    for r in sorted(out.collect(), key=lambda r: (r["rank"], r["k"])):
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    got = {r["conv_id"]: tuple(r)[1:] for r in report.collect()}
    for c, x in by.items():
        want, text = report_by_hand(x)
        assert got[c] == want, (c, x)
        assert lines[c] == text
    assert got.keys() == by.keys()


def test_a_hot_conversation_spans_segments(spark):
    rng = random.Random(3)
    rows = [(1, k, rng.choice(["user", "assistant"]), rng.choice([f"text {k}.", f"text {k}", "again!"])) for k in range(3000)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    report, out = R.repair_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), 64)
    want, lines = report_by_hand([r[1:] for r in rows if r[0] == 1])
    assert tuple(report.where("conv_id = 1").first())[1:] == want
    sha = {r["conv_id"]: r["sha"] for r in R.digest_lines(out).collect()}
    assert sha["1"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_ranks_lead_along_the_least_audit():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 12)
        pattern = "".join(rng.choice("suax") + rng.choice("kktd") for _ in range(n))
        cost, arcs = R._nodes(pattern, R.AT_END)
        audits, exits = R.segment_paths(pattern, R.AT_END)
        for q in range(4):
            node, said = q, ""  # one letter leads to one node, so the least letter first is the least audit
            while node < 4 * n:
                k = int(np.flatnonzero(arcs.reshape(-1, 4)[node] >= 0)[0])
                node, said = int(arcs.reshape(-1, 4)[node, k]), said + "DIKR"[k]
            assert (audits[q], exits[q]) == (said, node - 4 * n)


def test_damage_by_rule_and_odd_tables(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in (1, None) for t in [*range(60), None]] + [(5, 1, None, None)]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        want += [(c, t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    assert sorted(map(tuple, R.damage(d).collect()), key=str) == sorted(want, key=str)
    report, out = R.repair_conversations(d.limit(0))
    assert report.count() == 0 == out.count()
