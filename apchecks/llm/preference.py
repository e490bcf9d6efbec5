"""Preference formatting of chosen and rejected conversations, in DataFrame functions only.

A pair's longest common prefix of turns is rendered once as the prompt. What remains of each side is
rendered as its completion, with a mask of character spans: only the text of assistant turns and the
mark that ends it count for the loss, headers and other roles do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit("<|end|>\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def _spans(turns: Column) -> Column:
    """Spans (start, length, train) that cover the rendered turns without gaps."""
    parts = F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                F.struct(F.length(_header(t)).alias("length"), F.lit(False).alias("train")),
                F.struct(F.length(_body(t)).alias("length"), (t["role"] == TRAINED_ROLE).alias("train")),
            ),
        )
    )
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int,train:boolean>>)").alias("out"))
    return F.aggregate(
        parts,
        start,
        lambda acc, p: F.struct(
            (acc["at"] + p["length"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), p["length"].alias("length"), p["train"].alias("train")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def common_turns(chosen: Column, rejected: Column) -> Column:
    """The number of turns in which both conversations agree from the start."""
    both = F.least(F.size(chosen), F.size(rejected))
    differs = F.zip_with(F.slice(chosen, 1, both), F.slice(rejected, 1, both), lambda a, b: ~a.eqNullSafe(b))
    first = F.array_position(differs, True)
    return F.when(first == 0, both).otherwise(first - 1).cast("int")


def conversations_of(turns: DataFrame) -> DataFrame:
    """One row per conv_id of ``turns`` (conv_id, turn, role, text): its turns in order.

    Repeated rows count once. Ties in turn stand in the order of role and text; a null turn stands
    first; a null role is "user", a null text empty. Rows without a conv_id belong to no conversation.
    """
    clean = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.array_sort(F.collect_set(clean)).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def reply_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs for tables that hold no preferences: every conversation is a chosen one, and the last
    turn of the neighbour in its pair of ids (2i, 2i + 1) replaces its own in the rejected one.

    Without a neighbour the rejected conversation stops before the last turn.
    """
    id_ = F.col("conv_id").cast("long")
    own = conversations.select(id_.alias("conv_id"), id_.bitwiseXOR(F.lit(1)).alias("other"), F.col("turns").alias("chosen"))
    last = conversations.select(id_.alias("other"), F.slice("turns", -1, 1).alias("reply"))
    shorter = F.slice("chosen", F.lit(1), F.size("chosen") - 1)
    joined = own.join(last, "other", "left")
    empty = F.slice("chosen", 1, 0)
    return joined.select("conv_id", "chosen", F.concat(shorter, F.coalesce("reply", empty)).alias("rejected"))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Format ``pairs`` with columns chosen and rejected, arrays of (role, text).

    Adds prefix_turns, prompt, chosen_text, rejected_text, chosen_spans and rejected_spans; other
    columns stay. A null conversation counts as one without turns; a null role or text inside a turn
    as "user" and empty; equal conversations leave both completions empty; an empty table gives no
    rows.
    """
    empty = "cast(array() as array<struct<role:string,text:string>>)"

    def clean(name: str) -> Column:
        whole = F.coalesce(F.col(name), F.expr(empty))
        return F.transform(whole, lambda t: F.struct(F.coalesce(t["role"], F.lit("user")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))

    p = pairs.withColumns({"chosen": clean("chosen"), "rejected": clean("rejected")})
    p = p.withColumn("prefix_turns", common_turns(F.col("chosen"), F.col("rejected")))

    def rest(name: str) -> Column:
        return F.slice(F.col(name), F.col("prefix_turns") + 1, F.size(name))

    return p.withColumns(
        {
            "prompt": _render(F.slice("chosen", F.lit(1), F.col("prefix_turns"))),
            "chosen_text": _render(rest("chosen")),
            "rejected_text": _render(rest("rejected")),
            "chosen_spans": _spans(rest("chosen")),
            "rejected_spans": _spans(rest("rejected")),
        }
    )


def spans_text(spans: str) -> Column:
    """Spans as text, "start:length:train" with commas between."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["start"].cast("string"), s["length"].cast("string"), F.when(s["train"], "1").otherwise("0")),
        ),
        ",",
    )


#: DuckDB SQL of the query over the table ``conversations``.
ORACLE = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv_id
), p AS (
  SELECT a.conv_id, a.turns AS chosen,
         list_concat(a.turns[1:len(a.turns) - 1], CASE WHEN b.conv_id IS NULL THEN [] ELSE b.turns[len(b.turns):] END) AS rejected
  FROM c a LEFT JOIN c b ON b.conv_id = xor(a.conv_id, 1)
), q AS (
  SELECT *, (SELECT count(*) FROM range(1, least(len(chosen), len(rejected)) + 1) r(i)
             WHERE chosen[1:i] = rejected[1:i]) AS k FROM p
), s AS (
  SELECT conv_id, CAST(k AS INTEGER) AS prefix_turns, chosen[1:k] AS pre, chosen[k + 1:] AS cho, rejected[k + 1:] AS rej FROM q
)
SELECT conv_id, prefix_turns,
  coalesce(array_to_string(list_transform(pre, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS prompt,
  coalesce(array_to_string(list_transform(cho, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS chosen_text,
  coalesce(array_to_string(list_transform(rej, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS rejected_text,
  coalesce((SELECT string_agg(h || ':' || a || ':0,' || (h + a) || ':' || b || ':' || m, ',' ORDER BY i) FROM (
    SELECT i, len(cho[i].role) + 5 AS a, len(cho[i].text) + 8 AS b, CASE WHEN cho[i].role = 'assistant' THEN '1' ELSE '0' END AS m,
      coalesce(list_sum(list_transform(cho[1:i - 1], lambda t: len(t.role) + 5 + len(t.text) + 8)), 0)::BIGINT AS h
    FROM range(1, len(cho) + 1) r(i))), '') AS chosen_mask,
  coalesce((SELECT string_agg(h || ':' || a || ':0,' || (h + a) || ':' || b || ':' || m, ',' ORDER BY i) FROM (
    SELECT i, len(rej[i].role) + 5 AS a, len(rej[i].text) + 8 AS b, CASE WHEN rej[i].role = 'assistant' THEN '1' ELSE '0' END AS m,
      coalesce(list_sum(list_transform(rej[1:i - 1], lambda t: len(t.role) + 5 + len(t.text) + 8)), 0)::BIGINT AS h
    FROM range(1, len(rej) + 1) r(i))), '') AS rejected_mask
FROM s
"""
