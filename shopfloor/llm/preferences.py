"""Preference pairs as one prompt and two masked completions.

A pair has a chosen and a rejected conversation, each a set of turns. The
longest run of turns that both begin with (equal role and text) is rendered
once, as the prompt; what follows it on either side is rendered as that side's
completion. A completion's mask lists the character spans (start, length) to be
trained on: the texts of assistant turns with their end mark. Prompts are never
trained on.

A turn is rendered as ``<|im_start|>role``, a line break, its text,
``<|im_end|>`` and a line break. Turns are put in order by turn, role and text,
nulls first. Null roles and texts count as empty, and repeated turns are kept.
Turns without a pair id belong to no pair and are left out. A side without turns
has an empty prompt and completion, as has an empty table; equal sides are all
prompt. Other columns are not read.

Everything is DataFrame functions over one shuffle by pair. A conversation's
text is one value of the result, so one pair's turns do meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn.role, F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn.text, F.lit(CLOSE + "\n"))


def render(turns: Column) -> Column:
    """Text of an array of turns (role, text)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def trained_spans(turns: Column) -> Column:
    """Array of (start, length) of the assistant texts, end mark included, in ``render(turns)``."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        head, body = F.length(_head(turn)).cast("long"), F.length(_body(turn)).cast("long")
        # The line break after the end mark is not trained on.
        span = F.struct((state.at + head).alias("start"), (body - 1).alias("length"))
        return F.struct((state.at + head + body).alias("at"),
                        F.when(turn.role == "assistant", F.array_append(state.spans, span))
                        .otherwise(state.spans).alias("spans"))

    return F.aggregate(turns, zero, step, lambda state: state.spans)


def _side(turns: DataFrame, rejected: bool) -> DataFrame:
    return turns.where("pair_id IS NOT NULL").select(
        "pair_id", F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
        F.lit(rejected).alias("side"))


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row per pair from turns (pair_id, turn, role, text) of both sides."""
    def of(side: bool) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("side") == side, F.col("t"))))

    pairs = _side(chosen, False).union(_side(rejected, True)).groupBy("pair_id").agg(
        of(False).alias("c"), of(True).alias("r"))
    same = F.zip_with("c", "r", lambda x, y: F.coalesce((x.role == y.role) & (x.text == y.text), F.lit(False)))
    first_other = F.array_position(same, F.lit(False))
    common = F.when(first_other == 0, F.size("c")).otherwise(first_other - 1).cast("int")
    # The number of common turns decides three slices; cut them in a step of its own.
    cut = pairs.withColumn("prompt_turns", common).select(
        "pair_id", "prompt_turns", F.slice("c", F.lit(1), F.col("prompt_turns")).alias("p"),
        F.slice("c", F.col("prompt_turns") + 1, F.size("c") + 1).alias("c"),
        F.slice("r", F.col("prompt_turns") + 1, F.size("r") + 1).alias("r"))
    return cut.select("pair_id", "prompt_turns", render(F.col("p")).alias("prompt"),
                      render(F.col("c")).alias("chosen"), trained_spans(F.col("c")).alias("chosen_mask"),
                      render(F.col("r")).alias("rejected"), trained_spans(F.col("r")).alias("rejected_mask"))


def echo_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs from plain conversations: as they are, and with the last assistant turn echoing the turn before it.

    The window's partitioning by conversation serves the pairs' aggregation too.
    """
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    by_pair = Window.partitionBy("pair_id")
    ordered = by_pair.orderBy("turn", "role", "text")
    place = turns.withColumn("_n", F.row_number().over(ordered)).withColumn(
        "_before", F.coalesce(F.lag("text").over(ordered), F.lit("")))
    last = F.max(F.when(F.col("role") == "assistant", F.col("_n"))).over(by_pair)
    echoed = place.withColumn("_last", last).withColumn(
        "text", F.when(F.col("_n") == F.col("_last"), F.col("_before")).otherwise(F.col("text")))
    return turns, echoed.select("pair_id", F.col("_n").cast("long").alias("turn"), "role", "text")


def spans_text(mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda s: F.concat(s.start.cast("string"), F.lit("+"), s.length.cast("string"))), ",")


def digest(pairs: DataFrame) -> DataFrame:
    """The pairs with their masks as text."""
    return pairs.withColumn("chosen_mask", spans_text(F.col("chosen_mask"))).withColumn(
        "rejected_mask", spans_text(F.col("rejected_mask")))


# Turns and places are compared one by one, without arrays.
ECHO_SQL = """
WITH t AS (
  SELECT conv_id AS pair_id, role, coalesce(role, '') AS role_, coalesce(text, '') AS chosen_,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n,
         lag(coalesce(text, ''), 1, '') OVER (
           PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS before_
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT *, max(n) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id_) AS last_
      FROM (SELECT *, pair_id AS conv_id_ FROM t)),
s AS (SELECT pair_id, role_, n, chosen_, CASE WHEN n = last_ THEN before_ ELSE chosen_ END AS rejected_ FROM l),
d AS (SELECT *, coalesce(min(n) FILTER (WHERE chosen_ <> rejected_) OVER (PARTITION BY pair_id),
                         count(*) OVER (PARTITION BY pair_id) + 1) AS split FROM s),
r AS (SELECT *, '<|im_start|>' || role_ || chr(10) || chosen_ || '<|im_end|>' || chr(10) AS c,
             '<|im_start|>' || role_ || chr(10) || rejected_ || '<|im_end|>' || chr(10) AS j FROM d),
p AS (SELECT *, CASE WHEN n < split THEN 0 ELSE length(c) END AS lc, CASE WHEN n < split THEN 0 ELSE length(j) END AS lj
      FROM r),
q AS (SELECT *, sum(lc) OVER w - lc + 13 + length(role_) AS sc, sum(lj) OVER w - lj + 13 + length(role_) AS sj
      FROM p WINDOW w AS (PARTITION BY pair_id ORDER BY n))
SELECT pair_id, CAST(min(split) - 1 AS INTEGER) AS prompt_turns,
  coalesce(string_agg(c, '' ORDER BY n) FILTER (WHERE n < split), '') AS prompt,
  coalesce(string_agg(c, '' ORDER BY n) FILTER (WHERE n >= split), '') AS chosen,
  coalesce(string_agg(CAST(CAST(sc AS BIGINT) AS VARCHAR) || '+' || CAST(length(chosen_) + 10 AS VARCHAR), ',' ORDER BY n)
    FILTER (WHERE n >= split AND role_ = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(j, '' ORDER BY n) FILTER (WHERE n >= split), '') AS rejected,
  coalesce(string_agg(CAST(CAST(sj AS BIGINT) AS VARCHAR) || '+' || CAST(length(rejected_) + 10 AS VARCHAR), ',' ORDER BY n)
    FILTER (WHERE n >= split AND role_ = 'assistant'), '') AS rejected_mask
FROM q GROUP BY pair_id
"""
