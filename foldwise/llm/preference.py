"""Preference formatting: one prompt, two masked completions.

The chosen and the rejected conversation of a pair are compared turn by turn;
their longest common prefix of turns is rendered once as the prompt, the rest
of each is its completion. The loss mask of a completion is the list of
character ranges of assistant turns (start included, end excluded).

Defined results: turns are ordered by (turn, role, text), nulls first; a null
role is rendered as the empty role, a null text as empty; equal conversations
give two empty completions; a pair that lacks one side has an empty prefix; a
row without pair id belongs to the pair with the null id; repeated turns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foldwise.llm.words import quoted

ASSISTANT = "assistant"


def conversation(turns: DataFrame, pair: str, turn: str, role: str, text: str, out: str) -> DataFrame:
    """One row per conversation: its turns in order as an array of (role, text)."""
    row = F.struct(
        F.col(quoted(turn)).alias("turn"),
        F.coalesce(F.col(quoted(role)), F.lit("")).alias("role"),
        F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"),
    )
    ordered = F.array_sort(F.collect_list(row))
    return turns.groupBy(F.col(quoted(pair)).alias("pair_id")).agg(
        F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(out)
    )


def common_turns(a: Column, b: Column) -> Column:
    """Number of turns at the start that both arrays share."""
    least = F.least(F.size(a), F.size(b))
    differs = F.transform(
        F.arrays_zip(F.slice(a, 1, least).alias("a"), F.slice(b, 1, least).alias("b")), lambda t: t["a"] != t["b"]
    )
    place = F.array_position(differs, True)
    return F.when(place > 0, place - 1).otherwise(least.cast("long"))


def render(turns: Column) -> Column:
    """Each turn as a role line and its text, closed by an end mark."""
    return F.array_join(F.transform(turns, _turn), "")


def _turn(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))


def mask(turns: Column) -> Column:
    """Character ranges of the texts (with end mark) of assistant turns in the rendered turns."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state, t):
        start = state["at"] + F.length(t["role"]) + F.lit(5)
        end = start + F.length(t["text"]) + F.lit(7)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(t["role"] == ASSISTANT, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, zero, step, lambda state: state["spans"])


def format_preferences(
    chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per pair: prompt, and completion and mask of both sides."""
    a = conversation(chosen, pair, turn, role, text, "a")
    b = conversation(rejected, pair, turn, role, text, "b").withColumnRenamed("pair_id", "other_id")
    both = a.join(b, F.col("pair_id").eqNullSafe(F.col("other_id")), "full").select(
        F.coalesce("pair_id", "other_id").alias("pair_id"),
        *[F.coalesce(c, F.array().cast("array<struct<role:string,text:string>>")).alias(c) for c in "ab"],
    )
    n = F.col("n_prompt_turns").cast("int")
    rest = lambda side: F.slice(side, n + 1, F.greatest(F.size(side) - n, F.lit(0)))
    return (
        both.withColumn("n_prompt_turns", common_turns(F.col("a"), F.col("b")))
        .withColumns({"prompt_turns": F.slice("a", 1, n), "a": rest("a"), "b": rest("b")})
        .select(
            "pair_id",
            "n_prompt_turns",
            render(F.col("prompt_turns")).alias("prompt"),
            render(F.col("a")).alias("chosen"),
            mask(F.col("a")).alias("chosen_mask"),
            render(F.col("b")).alias("rejected"),
            mask(F.col("b")).alias("rejected_mask"),
        )
    )


def answers_of_the_next(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs from one table: the rejected side ends with the last turn of the next conversation.

    Pair ``c`` has conversation ``c`` as chosen side; the rejected one is the same, but for the
    last turn, which comes from conversation ``c + 1``. Where none follows there is no pair.
    """
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    ending = turns.join(last, "conv_id").filter(F.col("turn") == F.col("last"))
    other = ending.select((F.col("conv_id") - 1).alias("pair_id"), "role", "text")
    chosen = turns.join(last, "conv_id").withColumnRenamed("conv_id", "pair_id")
    paired = chosen.join(other.select("pair_id").distinct(), "pair_id", "left_semi")
    kept = paired.filter("turn < last").select("pair_id", "turn", "role", "text")
    swapped = other.join(last.withColumnRenamed("conv_id", "pair_id"), "pair_id").select(
        "pair_id", F.col("last").alias("turn"), "role", "text"
    )
    return paired.select("pair_id", "turn", "role", "text"), kept.unionByName(swapped)
