"""DuckDB fragments that the queries' SQL shares."""

from __future__ import annotations

from corpusloom.operators.prepare import PS_SQL, WD_SQL

#: Bigram counts, the four commonest successors, and one teacher row for each context.
TEACHER = PS_SQL + """,
bc AS (SELECT ctx, token, count(*) AS n FROM (SELECT token AS ctx, lead(token) OVER (PARTITION BY shard_id, doc_id ORDER BY pos) AS token FROM ps) WHERE token IS NOT NULL GROUP BY ctx, token),
tk AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY ctx) AS total, row_number() OVER (PARTITION BY ctx ORDER BY n DESC, token) AS r FROM bc) WHERE r <= 4),
tch AS (SELECT ctx, any_value(total) AS total, list(token ORDER BY r) AS idx, list(n / total ORDER BY r) AS p, greatest(0, least(1, 1 - sum(n / total))) AS tail FROM tk GROUP BY ctx)"""
#: Positions of the taught shard; ``lit`` is true where there is a distribution.
SHARD = TEACHER + """,
sh AS (SELECT ps.shard_id, ps.doc_id, ps.pos, ps.token, len(wd.tokens) AS len, tch.idx, tch.p, tch.tail, coalesce(tch.ctx IS NOT NULL AND ps.pos < len(wd.tokens) - 1, false) AS lit
  FROM ps JOIN wd USING (shard_id, doc_id) LEFT JOIN tch ON tch.ctx = ps.token)"""
#: Numbered documents of each shard.
OFFSETS = WD_SQL + """,
od AS (SELECT shard_id, doc_id, tokens, row_number() OVER w - 1 AS local_doc, len(tokens) AS len, coalesce(sum(len(tokens)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  FROM wd WINDOW w AS (PARTITION BY shard_id ORDER BY doc_id))"""
#: Positions with their place in the shard, and the shard's length.
PLACED = OFFSETS + """,
ot AS (SELECT shard_id, sum(len)::BIGINT AS total FROM od GROUP BY shard_id),
op AS (SELECT shard_id, doc_id, local_doc, len, off, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token FROM od),
pl AS (SELECT op.*, off + pos AS gpos, total FROM op JOIN ot USING (shard_id))"""


def half(x: str) -> str:
    """Half-precision rounding of a positive number."""
    e = f"greatest(floor(log2({x})), -14)"
    return f"(round_even({x} * pow(2.0, 10 - {e}), 0) / pow(2.0, 10 - {e}))"


def brain(x: str) -> str:
    """Rounding to seven bits of mantissa; zero stays."""
    e = f"floor(log2(abs({x})))"
    return f"(CASE WHEN {x} = 0 THEN 0.0 ELSE round_even({x} * pow(2.0, 7 - {e}), 0) / pow(2.0, 7 - {e}) END)"
