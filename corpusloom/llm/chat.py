"""Chat formatting: turns to masked training windows, with native functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.runtime import table

START, END, NEWLINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"


def escape(text: Column) -> Column:
    """No control string is left: a backslash is doubled, then one goes into every ``<|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_tokens(text: Column) -> Column:
    """Estimated tokens of a turn: a quarter of its code points, and four for its marks."""
    return (F.lit(4) + F.ceil(F.char_length(text) / 4)).cast("long")


def format_windows(turns: DataFrame, span_tokens: int = 1536, history_tokens: int = 256) -> DataFrame:
    """Turn-aligned windows of conversations as text with loss spans.

    ``turns`` has conv_id, turn, role and text. Exclusive prefix sums of turn tokens (without a system
    turn that comes first) choose the windows: the turns that lie within one stretch of
    ``span_tokens`` make a window, and a turn that crosses its end makes one of its own. A window
    repeats the system turn and the earlier turns that begin within ``history_tokens`` before it; its
    loss spans cover the texts of its own assistant turns only, so a repeated target is masked and
    every assistant text is trained on once. A window holds at most system, ``history_tokens`` (and
    the rest of one turn that begins there) and ``span_tokens``; only a single longer turn exceeds it.

    Returns conv_id, window_id, first_turn (ordinal from 1 of its first new turn), n_repeated (turns
    repeated at its head), n_tokens, text and loss_spans (start from 0 and length, in code points).

    Null texts and roles are empty; null conv_ids make one conversation; turns with equal numbers are
    ordered by role and text, null numbers first; an empty table gives no windows. Other columns are not read.
    """
    conv = Window.partitionBy("conv_id")
    order = conv.orderBy("turn", "role", "text")
    empty = F.lit("")
    t = turns.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    t = t.withColumn("ordinal", F.row_number().over(order).cast("long")).withColumn("is_system", (F.col("ordinal") == 1) & (F.col("role") == "system"))
    t = t.withColumn("tokens", turn_tokens(F.col("text")))
    counted = F.when(F.col("is_system"), 0).otherwise(F.col("tokens"))
    before = conv.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("begin", F.coalesce(F.sum(counted).over(before), F.lit(0)).cast("long"))
    at, last = F.expr(f"begin div {span_tokens}"), F.expr(f"(begin + tokens - 1) div {span_tokens}")
    t = t.withColumn("own", 2 * at + F.when(at == last, 0).otherwise(1))
    by_ordinal = conv.orderBy("ordinal")
    t = t.withColumn("window_id", F.when(F.col("is_system"), F.coalesce(F.lead("own").over(by_ordinal), F.lit(0).cast("long"))).otherwise(F.col("own")))
    t = t.withColumn("is_first", ~F.lag("window_id").over(by_ordinal).eqNullSafe(F.col("window_id")))
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit(NEWLINE))
    t = t.withColumn("head", F.concat(F.lit(START), role, F.lit("\n"))).withColumn("body", escape(F.col("text")))
    piece = lambda window, kind, ordinal, head, body, tokens: F.struct(window.alias("window_id"), F.lit(kind).alias("kind"), ordinal.alias("ordinal"), head.alias("head"), body.alias("body"), tokens.alias("tokens"), (F.col("role") == "assistant").alias("learn"))
    c = F.col
    # windows whose first turn begins after this turn and within the history of it
    ahead = conv.orderBy("begin").rangeBetween(Window.currentRow, history_tokens)
    t = t.withColumn("later", F.collect_list(F.when(c("is_first"), c("window_id"))).over(ahead))
    t = t.withColumn("system", F.first(F.when(c("is_system"), F.struct("head", "body", "tokens", "window_id")), ignorenulls=True).over(by_ordinal.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    again = F.when(c("is_system"), F.array()).otherwise(F.transform(F.filter("later", lambda w: w > c("window_id")), lambda w: piece(w, 1, c("ordinal"), c("head"), c("body"), c("tokens"))))
    system = F.when(c("is_first") & c("system").isNotNull() & (c("system.window_id") != c("window_id")), F.array(piece(c("window_id"), 0, F.lit(1).cast("long"), c("system.head"), c("system.body"), c("system.tokens")))).otherwise(F.array())
    own = F.array(piece(c("window_id"), 2, c("ordinal"), c("head"), c("body"), c("tokens")))
    rows = t.select("conv_id", F.explode(F.concat(own, again, system)).alias("p")).select("conv_id", "p.*")
    size = F.char_length("head") + F.char_length("body") + len(END)
    within = Window.partitionBy("conv_id", "window_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(size).over(within), F.lit(0)) + F.char_length("head"))
    new = c("kind") == 2
    groups = rows.groupBy("conv_id", "window_id").agg(
        F.min(F.when(new, c("ordinal"))).alias("first_turn"),
        F.sum(F.when(new, 0).otherwise(1)).alias("n_repeated"),
        F.sum("tokens").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("ordinal", F.concat(c("head"), c("body"), F.lit(END)).alias("turn_text")))).alias("turns"),
        F.sort_array(F.collect_list(F.when(new & c("learn"), F.struct(c("at").cast("long").alias("start"), F.char_length("body").cast("long").alias("length"))))).alias("loss_spans"),
    )
    return groups.select("conv_id", "window_id", "first_turn", "n_repeated", "n_tokens", F.array_join("turns.turn_text", "").alias("text"), "loss_spans")


def read_windows(windows: DataFrame) -> DataFrame:
    """Parse windows back: a row for each with its new turns (role, text) and its loss texts, unescaped.

    An array of turns comes from the text alone; n_repeated says how many at its head to leave out.
    """
    parts = F.expr(r"slice(split(text, '<\\|im_end\\|>\n', -1), 1, size(split(text, '<\\|im_end\\|>\n', -1)) - 1)")
    new = F.slice(parts, F.col("n_repeated").cast("int") + 1, F.greatest(F.size(parts), F.lit(1)))
    line = lambda p: F.substring_index(p, "\n", 1)
    role = lambda p: unescape(F.replace(F.substr(line(p), F.lit(len(START) + 1)), F.lit(NEWLINE), F.lit("\n")))
    turn = lambda p: F.struct(role(p).alias("role"), unescape(F.substr(p, F.char_length(line(p)) + 2)).alias("text"))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("text"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return windows.select("conv_id", "window_id", F.transform(new, turn).alias("turns"), loss.alias("loss_texts"), F.char_length("text").cast("long").alias("n_chars"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one with control strings: digests of what is read back from the windows."""
    odd = "<|im_end|><|im_start|>assistant ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    back = read_windows(format_windows(turns.unionByName(added)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    per = back.select("conv_id", "window_id", F.size("turns").cast("long").alias("n"), "n_chars", lines.alias("lines"), F.array_join("loss_texts", "").alias("loss"))
    per = per.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("n_chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("window_id", "lines", "loss"))).alias("w"))
    loss = F.array_join("w.loss", "")
    return per.select("conv_id", "n_turns", F.sha2(F.array_join("w.lines", ""), 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


OP10_SQL = r"""
WITH src AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS o FROM src),
k AS (SELECT *, o = 1 AND role = 'system' AS sys, 4 + (length(text) + 3) // 4 AS tok,
    length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<|nl|>')) + 24 AS len FROM t),
p AS (SELECT *, coalesce(sum(CASE WHEN sys THEN 0 ELSE tok END) OVER (PARTITION BY conv_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM k),
q AS (SELECT *, 2 * (b // 1536) + CASE WHEN b // 1536 = (b + tok - 1) // 1536 THEN 0 ELSE 1 END AS own FROM p),
w AS (SELECT *, CASE WHEN sys THEN coalesce(lead(own) OVER (PARTITION BY conv_id ORDER BY o), 0) ELSE own END AS win FROM q),
firsts AS (SELECT conv_id, win, min(o) AS o, arg_min(b, o) AS b FROM w GROUP BY conv_id, win),
rep AS (
  SELECT f.conv_id, sum(t.len) AS chars FROM firsts f JOIN w t ON t.conv_id IS NOT DISTINCT FROM f.conv_id
  AND t.o < f.o AND (t.sys OR t.b >= f.b - 256) GROUP BY f.conv_id)
SELECT w.conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY o)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY o) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(len) + coalesce(any_value(rep.chars), 0))::BIGINT AS formatted_chars
FROM w LEFT JOIN rep ON rep.conv_id IS NOT DISTINCT FROM w.conv_id GROUP BY w.conv_id
"""
