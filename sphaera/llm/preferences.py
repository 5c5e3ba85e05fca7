"""Chat formatting of preference pairs (DataFrame functions only).

A pair is two conversations, one chosen and one rejected. Their longest common
turn prefix (same role and text, turn after turn) is rendered once as the
prompt; what follows on either side is that side's completion, in which only
the assistant's turns are trained on. Turns stay rows throughout, so that a
conversation of any length is split over tasks: the sides are joined turn by
turn and a pair's first differing turn is a partial aggregate.

Defined cases: a null text is empty, a null role is ``user``; turns are ordered
by number, nulls first, then role and text, so repeated rows are turns of their
own; a pair with equal sides is all prompt and has no completion; a side
without turns has an empty prefix in common; a null pair identifier is a pair;
an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import with_global_index

TRAINED = "assistant"


def _clean(turns: DataFrame) -> DataFrame:
    """pair, side, turn, role, text with a number for equal turns."""
    t = turns.select(
        "pair", "side", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    again = Window.partitionBy("pair", "side", "turn").orderBy("role", "text")
    return t.withColumn("nth", F.row_number().over(again))


def render(role, text):
    """A turn in the chat template."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def preference_turns(turns: DataFrame) -> DataFrame:
    """From turns (pair, side 'chosen' or 'rejected', turn, role, text): one
    row per rendered turn: ``pair``, ``part`` (prompt, chosen, rejected),
    ``turn``, ``nth`` (order among equal turn numbers), ``rendered`` and
    ``train`` (false: masked)."""
    t = _clean(turns)
    a = t.filter("side = 'chosen'").select(
        F.col("pair").alias("a_pair"), F.col("turn").alias("a_turn"), F.col("nth").alias("a_nth"),
        F.col("role").alias("a_role"), F.col("text").alias("a_text"),
    )
    b = t.filter("side = 'rejected'").drop("side")
    same_place = (
        F.col("a_pair").eqNullSafe(F.col("pair")) & F.col("a_turn").eqNullSafe(F.col("turn")) & (F.col("a_nth") == F.col("nth"))
    )
    place = F.struct(F.coalesce("a_turn", "turn").alias("turn"), F.coalesce("a_nth", "nth").alias("nth"))
    both = a.join(b, same_place, "full").select(
        F.when(F.col("a_nth").isNotNull(), F.col("a_pair")).otherwise(F.col("pair")).alias("pair"), place.alias("place"),
        F.when(F.col("a_nth").isNotNull(), F.struct(F.col("a_role").alias("role"), F.col("a_text").alias("text"))).alias("chosen"),
        F.when(F.col("nth").isNotNull(), F.struct("role", "text")).alias("rejected"),
    )
    differs = F.when(~F.col("chosen").eqNullSafe(F.col("rejected")), F.col("place"))
    first = both.groupBy(F.col("pair").alias("f_pair")).agg(F.min(differs).alias("first"))
    j = both.join(first, both["pair"].eqNullSafe(first["f_pair"]))
    common = F.col("first").isNull() | (F.col("place") < F.col("first"))

    def part(name: str, side: str):
        turn = F.col(side)
        return F.struct(
            F.lit(name).alias("part"), turn["role"].alias("role"), turn["text"].alias("text"),
            ((turn["role"] == TRAINED) & F.lit(name != "prompt")).alias("train"),
        )

    parts = F.when(common, F.array(part("prompt", "chosen"))).otherwise(
        F.filter(F.array(part("chosen", "chosen"), part("rejected", "rejected")), lambda x: x["role"].isNotNull())
    )
    out = j.select("pair", "place", F.explode(parts).alias("p"))
    return out.select(
        "pair", F.col("p.part").alias("part"), F.col("place.turn").alias("turn"), F.col("place.nth").alias("nth"),
        render(F.col("p.role"), F.col("p.text")).alias("rendered"), F.col("p.train").alias("train"),
    )


def preference_examples(turns: DataFrame) -> DataFrame:
    """One row per pair for pairs that fit a row: ``prompt``, ``chosen``,
    ``rejected`` and, for the completions, the trained spans (code points)."""
    t = preference_turns(turns)
    whole = t.groupBy("pair", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "nth", "rendered", "train"))).alias("x"))
    text = F.array_join(F.transform("x", lambda s: s["rendered"]), "")
    none = F.array().cast("array<struct<start:int,end:int>>")
    spans = F.aggregate(
        "x", F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda s, x: F.struct(
            (s["at"] + F.length(x["rendered"])).alias("at"),
            F.when(
                x["train"],
                F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), (s["at"] + F.length(x["rendered"])).alias("end")))),
            ).otherwise(s["out"]).alias("out"),
        ),
        lambda s: s["out"],
    )
    w = whole.select("pair", "part", text.alias("text"), spans.alias("spans"))

    def of(part: str, col: str):
        return F.max(F.when(F.col("part") == part, F.col(col)))

    return w.groupBy("pair").agg(
        F.coalesce(of("prompt", "text"), F.lit("")).alias("prompt"),
        *[F.coalesce(of(p, "text"), F.lit("")).alias(p) for p in ("chosen", "rejected")],
        *[F.coalesce(of(p, "spans"), none).alias(f"{p}_train") for p in ("chosen", "rejected")],
    )


def pairs_from_conversations(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Preference pairs from single conversations: up to its last assistant
    turn a conversation is chosen; rejected is the same with that turn's text
    replaced by the last assistant text of the conversation with the next
    identifier that the table has (empty if there is none, or if that one has
    no assistant turn). Conversations without an assistant turn make no pair.
    Turns without a number have no place before or after the last answer and
    go, as do those without an identifier."""
    c = conversations.select(
        F.col(id_col).cast("long").alias("pair"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    answers = c.filter((F.col("role") == TRAINED) & F.col("turn").isNotNull() & F.col("pair").isNotNull())
    last = answers.groupBy("pair").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    numbers = with_global_index(c.select("pair").filter("pair is not null").distinct(), ["pair"], "at")
    before = numbers.select(F.col("pair").alias("o_pair"), (F.col("at") + 1).alias("o_at"))
    following = numbers.join(last, "pair").select("at", F.col("last.text").alias("o_text"))
    other = before.join(following, before["o_at"] == following["at"]).select("o_pair", "o_text")
    ends = last.join(other, last["pair"] == other["o_pair"], "left").select(
        F.col("pair").alias("e_pair"), F.col("last.turn").alias("e_turn"), F.coalesce("o_text", F.lit("")).alias("e_text")
    )
    t = c.join(ends, c["pair"] == ends["e_pair"]).filter("turn <= e_turn")
    replaced = (F.col("turn") == F.col("e_turn")) & (F.col("role") == TRAINED)
    chosen = t.select("pair", F.lit("chosen").alias("side"), "turn", "role", "text")
    rejected = t.select(
        "pair", F.lit("rejected").alias("side"), "turn", "role", F.when(replaced, F.col("e_text")).otherwise(F.col("text")).alias("text")
    )
    return chosen.unionByName(rejected)
