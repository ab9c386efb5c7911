"""Chat formatting in budgeted windows, with DataFrame operations only.

A conversation's turns are formatted by a template, which marks each turn's role and escapes control strings
inside texts, reversibly. Prefix sums of turn tokens choose spans of whole turns; each span becomes a window: the
conversation's system turn first, then a limited history of earlier turns, then the span itself. The loss mask
covers the texts of the span's own assistant turns; a target that is repeated as history is masked, so each
assistant text is learned once.

A turn's tokens are those that the caller counts (a column of turns, which adds the marks'), or else the bytes of its
formatted text: no byte-level vocabulary makes more tokens than bytes, so a window never exceeds its budget under any of
them.

Spans: a turn of more than half the budget is long and starts a segment; among the other turns of a segment, a
turn belongs to span floor(prefix / step), where step is the budget less the segment's longest other turn. A span
of such turns never exceeds the budget; only a turn that is itself longer does, as its text is kept whole.

Nulls and the like: a null role is written as the empty role, a null text as the empty text; turns with a null
conv_id form one conversation; turns of equal number are ordered by role and text, repeated rows are turns of their
own; a conversation of any length is handled row by row, only a window is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, text_or_empty

BUDGET = 4096
HISTORY_TOKENS = 1024
HISTORY_TURNS = 2

#: What a turn is set in. No text holds "[" or "<" after escaping, so none holds a mark.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
_OTHER = ("[ROLE:", "]", "[/ROLE]")
_ESCAPES = [("\\", "\\0"), ("[", "\\1"), ("<", "\\2")]


def escaped(text: Column) -> Column:
    for raw, code in _ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for raw, code in reversed(_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def _opening(role: Column) -> Column:
    c = F.concat(F.lit(_OTHER[0]), F.replace(escaped(role), F.lit("]"), F.lit("\\3")), F.lit(_OTHER[1]))
    for name, (a, _) in MARKS.items():
        c = F.when(role == name, F.lit(a)).otherwise(c)
    return c


def _closing(role: Column) -> Column:
    c = F.lit(_OTHER[2])
    for name, (_, b) in MARKS.items():
        c = F.when(role == name, F.lit(b)).otherwise(c)
    return c


def windows(turns: DataFrame, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS, tokens: str | None = None) -> DataFrame:
    """turns (conv_id, turn, role, text) to windows: conv_id, window (from 0), text, n_tokens, and segments, an array of
    (turn_no, role, start, length, own, loss): where each turn's escaped text stands in the window's text (start
    from 1), whether the turn belongs to the window's span, and whether it is a target. tokens: a column of turns with
    the tokens of a turn as it is formatted; null counts as the bytes."""
    conv = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    known = F.col(tokens).cast("long") if tokens else F.lit(None).cast("long")
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text_or_empty().alias("text"), known.alias("known"))
    t = t.withColumn("no", F.row_number().over(conv).cast("long"))
    t = t.select("conv_id", "no", "role", _opening(F.col("role")).alias("open"), escaped(F.col("text")).alias("body"), _closing(F.col("role")).alias("close"), "known")
    t = t.withColumn("tokens", F.coalesce("known", (F.octet_length("open") + F.octet_length("body") + F.octet_length("close")).cast("long")))
    t = t.withColumn("keeps", (F.col("no") == 1) & (F.col("role") == "system"))
    by_no = W.partitionBy("conv_id").orderBy("no")
    room = F.lit(budget - history_tokens) - F.coalesce(F.max(F.when(F.col("keeps"), F.col("tokens"))).over(W.partitionBy("conv_id")), F.lit(0))
    t = t.withColumn("room", F.greatest(room, F.lit(budget // 4)))
    t = t.withColumn("long", (F.col("tokens") * 2 > F.col("room")).cast("int"))
    # a long turn is a segment, and so is what stands between two of them
    t = t.withColumn("segment", F.sum("long").over(by_no.rowsBetween(W.unboundedPreceding, 0)) * 2 - F.col("long"))
    segment = W.partitionBy("conv_id", "segment")
    t = t.withColumn("step", F.greatest(F.lit(1), F.col("room") - F.max("tokens").over(segment)))
    t = t.withColumn("prefix", F.coalesce(F.sum("tokens").over(segment.orderBy("no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("span", F.expr("prefix div step"))
    changed = F.coalesce(~(F.lag("span").over(by_no).eqNullSafe(F.col("span")) & F.lag("segment").over(by_no).eqNullSafe(F.col("segment"))), F.lit(True))
    t = t.withColumn("first", changed.cast("int"))
    t = t.withColumn("window", F.sum("first").over(by_no.rowsBetween(W.unboundedPreceding, 0)) - 1)
    t = t.withColumn("through", F.sum("tokens").over(by_no.rowsBetween(W.unboundedPreceding, 0)))
    # the later windows that repeat this turn: those that start within the next turns and tokens
    later = []
    for k in range(1, history_turns + 1):
        near = (F.lead("first", k).over(by_no) == 1) & (F.lead("through", k).over(by_no) - F.lead("tokens", k).over(by_no) - F.col("through") + F.col("tokens") <= history_tokens)
        later.append(F.when(near & ~F.col("keeps"), F.lead("window", k).over(by_no)))
    every = F.when(F.col("keeps"), F.sequence(F.lit(0).cast("long"), F.max("window").over(W.partitionBy("conv_id"))))
    into = F.coalesce(every, F.array_compact(F.array(F.col("window"), *later)))
    t = t.withColumn("into", into)
    t = t.select("conv_id", "no", "role", "open", "body", "close", "tokens", F.col("window").alias("own_window"), F.explode("into").alias("window"))
    part = F.struct("no", "role", "open", "body", "close", "tokens", (F.col("own_window") == F.col("window")).alias("own"))
    w = t.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    segments = F.aggregate(
        "parts",
        F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<struct<turn_no:bigint,role:string,start:bigint,length:bigint,own:boolean,loss:boolean>>").alias("found")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["open"]) + F.length(p["body"]) + F.length(p["close"])).cast("long").alias("at"),
            F.concat(
                a["found"],
                F.array(
                    F.struct(
                        p["no"].alias("turn_no"),
                        p["role"].alias("role"),
                        (a["at"] + F.length(p["open"])).cast("long").alias("start"),
                        F.length(p["body"]).cast("long").alias("length"),
                        p["own"].alias("own"),
                        (p["own"] & (p["role"] == "assistant")).alias("loss"),
                    )
                ),
            ).alias("found"),
        ),
        lambda a: a["found"],
    )
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["open"], p["body"], p["close"])), "")
    return w.select("conv_id", "window", text.alias("text"), F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["tokens"]).alias("n_tokens"), segments.alias("segments"))


def read_back(formatted: DataFrame) -> DataFrame:
    """For each window: conv_id, chars, and the turns of its own span as windows() was given them (turn_no, role,
    text, loss), from its text and segments."""

    def turn(s: Column) -> Column:
        text = unescaped(F.substring(F.col("text"), s["start"].cast("int"), s["length"].cast("int")))
        return F.struct(s["turn_no"].alias("turn_no"), s["role"].alias("role"), text.alias("text"), s["loss"].alias("loss"))

    return formatted.select("conv_id", F.length("text").cast("long").alias("chars"), F.transform(F.filter("segments", lambda s: s["own"]), turn).alias("turns"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    back = read_back(windows(turns.unionByName(extra))).groupBy("conv_id").agg(
        F.sort_array(F.flatten(F.collect_list("turns"))).alias("turns"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows")
    )
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return back.withColumn("loss_text", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )


ORACLE = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS no,
    replace(replace(replace(text, '\', '\0'), '[', '\1'), '<', '\2') AS body,
    CASE role WHEN 'system' THEN '[SYS]' WHEN 'user' THEN '[INST]' WHEN 'assistant' THEN '<s>'
      ELSE '[ROLE:' || replace(replace(replace(replace(role, '\', '\0'), '[', '\1'), '<', '\2'), ']', '\3') || ']' END AS a,
    CASE role WHEN 'system' THEN '[/SYS]' WHEN 'user' THEN '[/INST]' WHEN 'assistant' THEN '</s>' ELSE '[/ROLE]' END AS z
  FROM c),
n AS (SELECT *, octet_length(encode(a || body || z)) AS tokens, length(a || body || z) AS chars, no = 1 AND role = 'system' AS keeps FROM m),
r AS (SELECT *, greatest({BUDGET - HISTORY_TOKENS} - coalesce(max(CASE WHEN keeps THEN tokens END) OVER (PARTITION BY conv_id), 0), {BUDGET // 4}) AS room FROM n),
l AS (SELECT *, (tokens * 2 > room)::INT AS long FROM r),
g AS (SELECT *, sum(long) OVER (PARTITION BY conv_id ORDER BY no) * 2 - long AS segment FROM l),
p AS (
  SELECT *, greatest(1, room - max(tokens) OVER (PARTITION BY conv_id, segment)) AS step,
    sum(tokens) OVER (PARTITION BY conv_id, segment ORDER BY no) - tokens AS prefix FROM g),
s AS (SELECT *, (prefix // step)::BIGINT AS span FROM p),
f AS (
  SELECT *, (no = 1 OR lag(span) OVER o <> span OR lag(segment) OVER o <> segment)::INT AS first, sum(tokens) OVER o AS through FROM s
  WINDOW o AS (PARTITION BY conv_id ORDER BY no)),
w AS (
  SELECT *, sum(first) OVER (PARTITION BY conv_id) AS n_windows,
    {" + ".join(f"coalesce((lead(first, {k}) OVER o = 1 AND lead(through, {k}) OVER o - lead(tokens, {k}) OVER o - through + tokens <= {HISTORY_TOKENS})::INT, 0)" for k in range(1, HISTORY_TURNS + 1))} AS repeats
  FROM f WINDOW o AS (PARTITION BY conv_id ORDER BY no))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY no)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY no) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars * CASE WHEN keeps THEN n_windows ELSE 1 + repeats END)::BIGINT AS formatted_chars, max(n_windows)::BIGINT AS n_windows
FROM w GROUP BY conv_id"""
