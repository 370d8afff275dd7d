"""Conversation repair: cheapest edits by dynamic programming, the least of equal ones by ranks of doubled lengths."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.spelling import CRC_SQL, crc_sql
from corpusloom.operators.prefix import ordered_sums
from corpusloom.runtime import Scratch, merge_join, table

BLANK = "^[\\x20\\x09-\\x0D]*$"
#: Costs of the edits (fixed values); a truncated row that stays costs CUT more.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: Rows of one segment: the unit that a task works on.
SEGMENT = 4096
NEVER = 1 << 40
#: States are what was said last: nothing, the system, the user, the assistant. The next user or assistant
#: row leads to NEXT; a conversation may end in nothing or after the assistant, else rows are inserted.
NEXT = (2, 2, 3, 2)
SAID = "-sua"
AT_END = (0, 2 * INSERT, INSERT, 0)
END_AUDIT = ("", "II", "I", "")


def damage(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults by the unsigned crc32 of ``conv_id:turn``, modulo 20; nulls are one space.

    0 drops the row, 1 empties its text, 2 removes its ``.``, ``!`` and ``?``, 3 writes it twice, 4 sets role user.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    t = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return t.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _nodes(pattern: str, after: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Least costs from each node (row, state) to the end, and the targets of the optimal arcs by letter.

    ``pattern`` has two characters for each row: s, u, a or x for its role, and k, t or d for a row that may
    stay, one that is truncated, and one that must go. ``after`` are costs behind the last row, by state.
    Arcs lie in the order of their letters, D, I, K, R; a missing one has target -1.
    """
    n = len(pattern) // 2
    cost = np.full((n + 1, 4), NEVER, np.int64)
    cost[n] = after
    arcs = np.full((n + 1, 4, 4), -1, np.int64)
    for i in range(n - 1, -1, -1):
        role, fault = pattern[2 * i], pattern[2 * i + 1]
        extra = CUT if fault == "t" else 0
        ways = []
        for q in range(4):
            keep = 1 if role == "s" and q == 0 else NEXT[q] if role == SAID[NEXT[q]] else None
            way = {0: (DELETE + cost[i + 1, q], (i + 1) * 4 + q)}
            if fault != "d":
                way[3] = (REROLE + extra + cost[i + 1, NEXT[q]], (i + 1) * 4 + NEXT[q])
                if keep is not None:
                    way[2] = (extra + cost[i + 1, keep], (i + 1) * 4 + keep)
            ways.append(way)
            cost[i, q] = min(c for c, _ in way.values())
        for _ in range(2):  # at most two rows are inserted in one place: three would run in a circle
            for q in range(4):
                cost[i, q] = min(cost[i, q], INSERT + cost[i, NEXT[q]])
        for q, way in enumerate(ways):
            way[1] = (INSERT + cost[i, NEXT[q]], i * 4 + NEXT[q])
            for letter, (c, target) in way.items():
                if c == cost[i, q] < NEVER:
                    arcs[i, q, letter] = target
    return cost, arcs


def _least_paths(arcs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For every node the letter of its least audit, and pointers 1, 2, 4, ... letters ahead along it.

    Nodes are ranked by the first letter of their least audit, then by the first 2, 4, 8, ...: two ranks
    of a length, the node's own and that of the node it points to, give the rank of twice that length.
    Of a node's optimal arcs, each round takes those of the least letter whose targets have the least rank
    so far; ranks of whole audits leave one.
    """
    flat = arcs.reshape(-1, 4)
    nodes, own = np.arange(len(flat)), (flat >= 0).any(1)
    letters = np.where(flat >= 0, np.arange(4), 9)
    rank, length = np.where(own, letters.min(1) + 1, 0), 1
    while True:
        # the arc of the least letter, then of the least rank behind it
        key = letters * (len(flat) + 5) + np.where(flat >= 0, rank[flat], 0)
        pick = key.argmin(1)
        step = np.where(own, flat[nodes, pick], nodes)
        pointers = [step]
        for _ in range(length.bit_length() - 1):
            pointers.append(pointers[-1][pointers[-1]])
        if length >= len(flat):
            return np.where(own, letters[nodes, pick], -1), pointers
        rank = np.unique(rank * (len(flat) + 5) + rank[pointers[-1]], return_inverse=True)[1]
        length *= 2


def _walk(pointers: list[np.ndarray], start: int) -> np.ndarray:
    """All nodes from ``start`` on, the longest jumps first and then those between."""
    path = np.array([start])
    for p in reversed(pointers):
        path = np.stack([path, p[path]], 1).ravel()
    return path


def transfer(pattern: str) -> list[int]:
    """Least costs of a segment from each state before it to each behind it, 16 in a row."""
    by = [_nodes(pattern, tuple(0 if k == q else NEVER for k in range(4)))[0][0] for q in range(4)]
    return [min(int(by[k][q]), NEVER) for q in range(4) for k in range(4)]


def segment_paths(pattern: str, after: tuple[int, ...]) -> tuple[list[str], list[int]]:
    """By state before a segment: the least of its cheapest audits, and the state behind it."""
    n, arcs = len(pattern) // 2, _nodes(pattern, after)[1]
    letter, pointers = _least_paths(arcs)
    audits, exits = [], []
    for q in range(4):
        path = _walk(pointers, q)
        said = letter[path]
        end = int(np.argmax(said < 0))  # a node behind the last row has no arc
        audits.append("".join("DIKR"[k] for k in said[:end]))
        exits.append(int(path[end]) - 4 * n)
    return audits, exits


#: Short patterns recur, so their results are kept.
SHORT, KEEP = 64, 50_000
_short_transfer, _short_paths = lru_cache(KEEP)(transfer), lru_cache(KEEP)(segment_paths)


def edits_of(pattern: str, audit: str, state: int) -> list[str]:
    """What an audit does at each row: the initials inserted before it, then K, D or the initial it is given."""
    out, row, held = [], 0, ""
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            held += SAID[state]
            continue
        does = letter
        if letter == "K":
            state = 1 if pattern[2 * row] == "s" else NEXT[state]
        elif letter == "R":
            state = NEXT[state]
            does = SAID[state]
        out.append(held + does)
        row, held = row + 1, ""
    return out


def _transfers(patterns: pd.Series) -> pd.Series:
    return pd.Series([(_short_transfer if len(p) <= SHORT else transfer)(p) for p in patterns], dtype=object)


def _behind(matrices: pd.Series) -> pd.DataFrame:
    """From the matrices of a conversation's segments in order: its least cost, and the costs behind each segment by state."""
    out = []
    for ms in matrices:
        now, after = np.array(AT_END, np.int64), []
        for m in reversed(list(ms)):
            after.append(now.tolist())
            now = np.minimum((np.asarray(m).reshape(4, 4) + now).min(1), NEVER)
        out.append((int(now[0]), after[::-1]))
    return pd.DataFrame(out, columns=["cost", "after"])


def _paths(patterns: pd.Series, after: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(_short_paths if len(p) <= SHORT else segment_paths)(p, tuple(int(x) for x in a)) for p, a in zip(patterns, after)], columns=["audits", "exits"])


def _entries(exits: pd.Series) -> pd.Series:
    """The state before each segment and, last, the one behind them all."""

    def follow(segments) -> list[int]:
        states = [0]
        for e in segments:
            states.append(int(e[states[-1]]))
        return states

    return exits.map(follow)


def _edits(patterns: pd.Series, audits: pd.Series, states: pd.Series) -> pd.Series:
    return pd.Series([edits_of(p, a, s) for p, a, s in zip(patterns, audits, states)], dtype=object)


def _same(left: list[str], right: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def _faults(rows: DataFrame) -> DataFrame:
    """Ranked rows (conv_id, turn, role, digest, look, rank) with ``fault``: blank, duplicate, truncated or none."""
    first = rows.groupBy(F.col("conv_id").alias("__c"), F.col("role").alias("__r"), F.col("digest").alias("__d")).agg(F.min("rank").alias("__first"))
    d = merge_join(rows, first, _same(["conv_id", "role", "digest"], ["__c", "__r", "__d"])).drop("__c", "__r", "__d")
    fault = F.when(F.col("look") == "blank", "blank").when(F.col("rank") > F.col("__first"), "duplicate").otherwise(F.col("look"))
    return d.withColumn("fault", fault).drop("__first", "look")


def repair_conversations(turns: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """Cheapest repair of conversations ``turns`` (conv_id, turn, role, text): (report, rows).

    ``report`` has for each conversation gaps in its turns (ignoring nulls), rows that are blank, duplicate
    or truncated (a row's first fault counts), illegal neighbours (role initials other than su, ua and au),
    the least cost and the audit: the edits' initials in order. A row is kept (0), given the role user or
    assistant (1) or deleted (2; blank and duplicate rows must be); an empty user or assistant row is
    inserted anywhere (5); a truncated row that stays costs 5 more. The role initials left are none, or
    pairs of user and assistant, which one system row may precede. Of audits of equal cost the least in
    ASCII order is taken. ``rows`` (conv_id, rank, k, role, text) are the repaired turns in order.

    Rows are ranked over ranges, so a conversation may be of any size. Each segment of ``segment`` rows
    becomes a pattern of two characters a row, and a table of least costs between the four states before
    and behind it; from those come the costs behind each segment, so each finds its optimal arcs by itself.
    Nodes of optimal arcs are ranked by the first 1, 2, 4, ... letters of their least audits, and pointers
    doubled with them lead along the least path. Texts move twice, to meet their edits and in order.

    Null roles and texts are one space; null conv_ids are one conversation; null turns come first; rows of
    one turn are in the order of role, then of the text's MD5. Conversations without rows have none in
    the report. Empty texts are blank; other columns are not read.
    """
    spark = turns.sparkSession
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    src = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text")).withColumn("digest", F.md5("text"))
    c = F.col
    bare = F.rtrim("text", F.lit(" \t\n\x0b\f\r"))
    look = F.when(bare == "", "blank").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("none")
    with Scratch(spark, owns=True) as s:
        rows = ordered_sums(src.select("conv_id", "turn", "role", "digest", look.alias("look")), ["conv_id"], ["turn", "role", "digest"])
        rows = s.table(_faults(rows), "repair-rows")
        counts = rows.groupBy("conv_id", "turn").agg(*[F.sum((c("fault") == f).cast("long")).alias(f) for f in ("blank", "duplicate", "truncated")])
        span = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
        counts = counts.groupBy("conv_id").agg(span.alias("gaps"), *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])
        initial = F.left("role", F.lit(1))
        mark = F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("x"), F.when(c("fault").isin("blank", "duplicate"), "d").when(c("fault") == "truncated", "t").otherwise("k"))
        r = rows.select("conv_id", "rank", F.expr(f"rank div {segment}").alias("segment"), mark.alias("mark"))
        seg = r.groupBy("conv_id", "segment").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "mark"))), lambda x: x["mark"]), "").alias("pattern"))
        seg = s.table(seg.withColumn("m", F.pandas_udf(_transfers, "array<long>")("pattern")), "repair-segments")
        # one row for each segment of a conversation: costs behind it, then the state before it
        roles = F.regexp_replace("pattern", "(.).", "$1")
        inside = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.char_length(roles)), lambda i: F.substr(roles, i, F.lit(2))), lambda x: (F.char_length(x) == 2) & ~x.isin("su", "ua", "au")))
        chain = seg.select("conv_id", "segment", "m", inside.cast("long").alias("inside"), F.left(roles, F.lit(1)).alias("head"), F.right(roles, F.lit(1)).alias("tail"))
        chain = chain.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("segment", "m", "inside", "head", "tail"))).alias("z")).withColumn("b", F.pandas_udf(_behind, "cost long, after array<array<long>>")(c("z.m")))
        between = F.zip_with(F.slice("z", 1, F.size("z") - 1), F.slice("z", 2, F.size("z")), lambda a, b: F.concat(a["tail"], b["head"]))
        illegal = F.aggregate("z", F.lit(0).cast("long"), lambda t, x: t + x["inside"]) + F.size(F.filter(between, lambda x: ~x.isin("su", "ua", "au")))
        chain = s.table(chain.select("conv_id", illegal.alias("illegal"), c("b.cost").alias("cost"), c("z.segment").alias("segments"), c("b.after").alias("after")), "repair-costs")
        after = chain.select(c("conv_id").alias("__c"), F.explode(F.arrays_zip("segments", "after")).alias("x")).select("__c", c("x.segments").alias("__s"), "x.after")
        on = _same(["conv_id", "segment"], ["__c", "__s"])
        paths = s.table(merge_join(seg.drop("m"), after, on).withColumn("p", F.pandas_udf(_paths, "audits array<string>, exits array<int>")("pattern", "after")).select("conv_id", "segment", "pattern", "p.*"), "repair-paths")
        states = paths.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("segment", "exits"))).alias("z")).select("conv_id", c("z.segment").alias("segments"), F.pandas_udf(_entries, "array<int>")(c("z.exits")).alias("states"))
        states = s.table(states, "repair-states")
        entry = states.select(c("conv_id").alias("__c"), F.explode(F.arrays_zip("segments", F.slice("states", 1, F.size("segments")).alias("state"))).alias("x")).select("__c", c("x.segments").alias("__s"), "x.state")
        done = merge_join(paths, entry, on).select("conv_id", "segment", "pattern", "state", F.get("audits", c("state")).alias("audit"))
        done = s.table(done.withColumn("edits", F.pandas_udf(_edits, "array<string>")("pattern", "audit", "state")).drop("pattern"), "repair-audits")
        last = states.select("conv_id", F.element_at("states", -1).alias("state"), F.size("states").alias("n"))
        closing = F.get(F.array(*map(F.lit, END_AUDIT)), c("state"))
        audit = done.select("conv_id", "segment", "audit").unionByName(last.select("conv_id", c("n").cast("long").alias("segment"), closing.alias("audit")))
        audit = audit.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("segment", "audit"))), lambda x: x["audit"]), "").alias("audit"))
        by = lambda d, n: d.withColumnRenamed("conv_id", n)
        report = merge_join(merge_join(counts, by(chain.select("conv_id", "illegal", "cost"), "__a"), c("conv_id").eqNullSafe(c("__a"))), by(audit, "__b"), c("conv_id").eqNullSafe(c("__b")))
        report = s.result(report.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), "repair-report")
        acts = done.select("conv_id", "segment", F.posexplode("edits").alias("i", "edit")).where("edit <> 'D'").select(c("conv_id").alias("__c"), (c("segment") * segment + c("i")).alias("__k"), "edit")
        left = merge_join(rows, acts, _same(["conv_id", "rank"], ["__c", "__k"])).select("rank", "edit", c("conv_id").alias("__c"), c("turn").alias("__t"), c("role").alias("__r"), c("digest").alias("__d"))
        met = merge_join(src, left, _same(["conv_id", "turn", "role", "digest"], ["__c", "__t", "__r", "__d"]))
        name = lambda x: F.when(x == "u", "user").otherwise("assistant")
        does = F.right("edit", F.lit(1))
        said = F.when(does == "K", c("role")).otherwise(name(does))
        new = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
        inserted = F.transform(F.array_remove(F.split(F.expr("left(edit, length(edit) - 1)"), ""), ""), lambda x: new(name(x), F.lit("")))
        out = met.select("conv_id", "rank", F.posexplode(F.concat(inserted, F.array(new(said, c("text"))))).alias("k", "x")).select("conv_id", "rank", "k", "x.*")
        # rows that are equal in all are one: only the first of them can stay
        out = out.groupBy("conv_id", "rank", "k").agg(F.first("role").alias("role"), F.first("text").alias("text"))
        size = rows.groupBy("conv_id").agg((F.max("rank") + 1).alias("rank"))
        ends = merge_join(last, by(size, "__c"), c("conv_id").eqNullSafe(c("__c"))).select("conv_id", "rank", F.posexplode(F.transform(F.array_remove(F.split(F.get(F.array(F.lit(""), F.lit("ua"), F.lit("a"), F.lit("")), c("state")), ""), ""), name)).alias("k", "role"))
        return report, s.result(out.unionByName(ends.withColumn("text", F.lit(""))), "repair-rows")


def digest_lines(rows: DataFrame) -> DataFrame:
    """(conv_id, sha) of (conv_id, rank, k, role, text): SHA-256 over ``role:text`` lines in order, as they stream by."""
    import hashlib

    def run(batches):
        now, sha = None, None
        for b in batches:
            out = []
            for conv, role, text in zip(b["conv_id"], b["role"], b["text"]):
                if now is None or conv != now[0]:
                    if now:
                        out.append((now[0], sha.hexdigest()))
                    now, sha = (conv,), hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            yield pd.DataFrame(out, columns=["conv_id", "sha"])
        if now:
            yield pd.DataFrame([(now[0], sha.hexdigest())], columns=["conv_id", "sha"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = rows.withColumn("conv_id", c_str("conv_id"))
    return key.repartition(n, "conv_id").sortWithinPartitions("conv_id", "rank", "k").select("conv_id", "role", "text").mapInPandas(run, "conv_id string, sha string")


def c_str(name: str) -> Column:
    """A key that is never null: ids as text, and a space for null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by rule and repaired at the least cost."""
    turns = table(spark, sf_dir, "conversations")
    report, rows = repair_conversations(damage(turns))
    every = turns.select("conv_id").distinct().select("conv_id", c_str("conv_id").alias("key"))
    d = merge_join(every, report.withColumn("key", c_str("conv_id")).drop("conv_id"), "key", "left")
    d = merge_join(d, digest_lines(rows).withColumnRenamed("conv_id", "key"), "key", "left")
    zero = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return d.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


OP13_SQL = f"""
WITH RECURSIVE {CRC_SQL},
i AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM i, range(2) c(n) WHERE kind <> 0 AND (n = 0 OR kind = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS r FROM d),
x AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) AS seen, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY r) AS before FROM o),
f AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM x),
states(q, nxt, ini) AS (VALUES (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')),
one(q, t, ins, added, said) AS (SELECT q, q, 0, '', '' FROM states UNION ALL SELECT q, nxt, 5, 'I', CASE WHEN ini = 'u' THEN 'user:' ELSE 'assistant:' END FROM states
  UNION ALL SELECT a.q, b.nxt, 10, 'II', CASE WHEN a.ini = 'u' THEN 'user:' || chr(10) || 'assistant:' ELSE 'assistant:' || chr(10) || 'user:' END FROM states a JOIN states b ON b.q = a.nxt),
w AS (SELECT conv_id, r, q, t, ins + c AS cost, added || letter AS audit, concat_ws(chr(10), nullif(said, ''), line) AS lines FROM (
  SELECT f.conv_id, f.r, one.q, one.ins, one.added, one.said, s.q AS s, e.letter, f.role, f.text,
    CASE e.letter WHEN 'D' THEN s.q WHEN 'R' THEN s.nxt ELSE CASE WHEN f.ini = 's' AND s.q = 0 THEN 1 WHEN f.ini = s.ini THEN s.nxt END END AS t,
    CASE e.letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN e.letter <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END AS c,
    CASE e.letter WHEN 'K' THEN f.role || ':' || f.text WHEN 'R' THEN CASE WHEN s.ini = 'u' THEN 'user:' ELSE 'assistant:' END || f.text END AS line
  FROM f, one JOIN states s ON s.q = one.t, (VALUES ('D'), ('K'), ('R')) e(letter) WHERE e.letter = 'D' OR fault NOT IN ('blank', 'duplicate')) WHERE t IS NOT NULL),
g(conv_id, r, q, z) AS (SELECT DISTINCT conv_id, 0::BIGINT, 0, {{'cost': 0::BIGINT, 'audit': '', 'lines': NULL::VARCHAR}} FROM f
  UNION ALL SELECT w.conv_id, w.r, w.t, min({{'cost': (z.cost + w.cost)::BIGINT, 'audit': z.audit || w.audit, 'lines': nullif(concat_ws(chr(10), z.lines, nullif(w.lines, '')), '')}})
  FROM g JOIN w ON w.conv_id IS NOT DISTINCT FROM g.conv_id AND w.r = g.r + 1 AND w.q = g.q GROUP BY 1, 2, 3),
ends AS (SELECT conv_id, min({{'cost': (z.cost + CASE q WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END)::BIGINT, 'audit': z.audit || CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
  'lines': concat_ws(chr(10), z.lines, CASE q WHEN 1 THEN 'user:' || chr(10) || 'assistant:' WHEN 2 THEN 'assistant:' END)}}) AS z
  FROM g JOIN (SELECT conv_id AS c, max(r) AS n FROM f GROUP BY conv_id) ON c IS NOT DISTINCT FROM conv_id AND n = r GROUP BY conv_id),
k AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(ends.z.cost, 0)::BIGINT AS cost, coalesce(ends.z.audit, '') AS audit, sha256(coalesce(ends.z.lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM c.conv_id
"""
