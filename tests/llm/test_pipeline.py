"""The pipeline's stages in order, each against brute force on what the one before kept."""

from __future__ import annotations

from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import linededup, quality
from corpusloom.runtime import materialize, table
from tests.llm.test_dedup import brute, entries_by_hand, leaks_by_hand
from tests.llm.test_text_models import WORD, bucket, counts


def quality_by_hand(rows, good):
    """Texts kept by the rules and the ratio, from plain counts."""
    raw, target, grams = [0] * quality.BUCKETS, [0] * quality.BUCKETS, []
    for i, t in rows:
        w = WORD.findall(t or "")
        grams.append([bucket(x) for x in w] + [bucket(a, b) for a, b in zip(w, w[1:])])
        for b in grams[-1]:
            raw[b] += 1
            target[b] += i in good
    import math

    r, t = sum(raw) + quality.BUCKETS, sum(target) + quality.BUCKETS
    llr = [round(1e6 * (math.log((y + 1) / t) - math.log((x + 1) / r))) for x, y in zip(raw, target)]
    kept = []
    for (i, text), g in zip(rows, grams):
        c = counts(text)
        if not (c[0] < 10 or 100 * c[4] > 20 * c[0]) and sum(llr[b] for b in g) >= quality.THRESHOLD * len(g):
            kept.append((i, text))
    return kept


def lines_by_hand(rows):
    """Runs of words, then lines by their templates, with dictionaries."""
    run = linededup.RUN
    texts, first = defaultdict(set), {}
    for i, t in sorted(rows):
        w = WORD.findall(t)
        for k in range(len(w) - run + 1):
            g = tuple(w[k : k + run])
            texts[g].add(t)
            first.setdefault(g, (i, t, k))
    cut = []
    for i, t in rows:
        w = WORD.findall(t)
        starts = [k for k in range(len(w) - run + 1) for g in [tuple(w[k : k + run])] if len(texts[g]) > 1 and (first[g][1] != t or k >= first[g][2] + run)]
        cut.append((i, linededup.without_runs(t, starts, run) if starts else t, bool(starts)))
    out, dropped = [], {}
    for (i, t), (_, u, _) in zip(rows, cut):
        dropped[i] = duckdb_lines(u)
    found, firsts = defaultdict(set), {}
    for i, u, _ in sorted(cut):
        for k, keys in dropped[i]:
            for key in keys:
                found[key].add(u)
                firsts.setdefault(key, (i, k))
    for i, u, gone_runs in cut:
        segs = segments(u)
        gone = set()
        for k, keys in dropped[i]:
            often = [key for key in keys if len(found[key]) >= (2 if key[0] >= 8 else 3)]
            # copies of one text are treated alike: its first place is a place of the text
            if often and not any(firsts[key] == (i, k) for key in often):
                gone.add(k)
        left = "".join(s for k, s in enumerate(segs) if k not in gone)
        if (not gone and not gone_runs) or WORD.search(left):
            out.append((i, left))
    return out


def segments(text):
    import re

    return re.split(r"(?<=[.!?] )|(?<=\n)", text)


def duckdb_lines(text):
    """(segment, templates) of a text's lines of five tokens or more."""
    import re

    out = []
    for k, s in enumerate(segments(text)):
        tok = ["<*>" if re.search("[0-9]", w) else w for w in WORD.findall(s)]
        if len(tok) >= 5:
            head, tail = tuple(tok[:8]), tok[8:]
            if not tail:
                out.append((k, [(len(tok), head)]))
                continue
            n = len(tail)
            parts = [tuple(tail[j * n // 3 : (j + 1) * n // 3]) for j in range(3)]
            out.append((k, [(len(tok), head, j, *(p for m, p in enumerate(parts) if m != j)) for j in range(3)]))
    return out


def test_stages_equal_brute_force(spark, small):
    docs = table(spark, small, "documents")
    columns, n = docs.columns, docs.count()
    labels = duckdb.sql(f"select doc_id, min(quality) from '{small}/labels.parquet' group by 1").fetchall()
    bench = duckdb.sql(f"select item_id, text from '{small}/benchmark.parquet' where text is not null order by 1, 2").fetchall()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = sorted((r["doc_id"], r["text"]) for r in docs.collect())
        docs = materialize(stage(spark, docs, small), f"test-stage-{k}")
        after = sorted((r["doc_id"], r["text"]) for r in docs.collect())
        assert docs.columns == columns
        if k == 0:
            assert after == quality_by_hand(before, {i for i, q in labels if q == 1})
        elif k == 1:
            assert after == lines_by_hand(before)
        elif k == 2:
            stays = {i for i, (_, c) in brute(before, 80, k=5).items() if i == c}
            assert after == [x for x in before if x[0] in stays]
        else:
            entries = entries_by_hand(bench)
            assert after == [x for x in before if not leaks_by_hand(entries, x[1])]
    kept = {r["doc_id"] for r in docs.collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {p["doc_id"] for p in pieces} == kept and 0 < len(kept) <= n
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"]


ODD = [(1, None), (1, None), (2, ""), (None, " \n"), (None, "some text of a row without an id, with words enough to be kept by the rules of length"), (3, "x " * 20_000), (4, "one"), (4, "one"), (5, "a line of more than nine words that stands twice in here.\n" * 2)]


def test_every_stage_takes_odd_rows_clashing_columns_and_an_empty_table(spark, small):
    clash = {x: F.lit("clash") for x in ("kept", "key", "digest", "seg", "long", "first", "template", "component_id", "h", "item_id", "words", "n")}
    d = spark.createDataFrame(ODD, "doc_id bigint, text string").withColumns({**clash, "lang": F.lit(None).cast("string")})
    rows = sorted(map(str, map(tuple, d.collect())))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, small)
        assert out.columns == d.columns, name
        if name in ("near_dedup", "decontamination"):
            want = rows if name == "decontamination" else sorted(set(rows))
            assert sorted(map(str, map(tuple, out.collect()))) == want
        assert stage(spark, d.limit(0), small).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, d, small).collect()
    assert sum(p["start"] == 0 for p in pieces) == len(ODD)
    assert corpus_pipeline.STAGES[-1][1](spark, d.limit(0), small).count() == 0


def test_no_stage_copies_an_expression_into_a_filter(spark, small):
    docs = table(spark, small, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plan = stage(spark, docs, small)._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.splitlines() if x.lstrip(" :+-").startswith("Filter") and ("split(" in x or "pythonUDF" in x)], name


def test_run_equals_stages(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
