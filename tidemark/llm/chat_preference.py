"""Preference formatting: pairs of conversations as one prompt and two masked completions.

Turns are numbered within each conversation. The longest common prefix of a chosen and a rejected
conversation is found by joining them turn by turn: its length is the number of the first turn that
differs in role or text, less one. An equal pair keeps its last turn out of the prefix, so that there
is something to compare. The prefix is rendered once, as ``prompt``; what follows becomes the
``chosen`` and ``rejected`` completions. In completions the turns of ``TRAINED`` roles carry the loss;
everything else is masked.

The result has a row for each rendered turn, so a conversation of any length is spread and sorted by
Spark and never gathered: pair_id, part (prompt, chosen, rejected), pos (from 1 in the conversation),
role, rendered, begin and finish (code points within prompt + part, so that completions begin where
the prompt ends), train (loss or masked), chosen_id, rejected_id.

Where nobody has ranked answers, ``answers_swapped`` makes pairs: a conversation as it is, and its turns up to
its last answer with the last answer of its neighbour in that one's place (an empty one if that has none).
Both share all turns before that answer, so these make up the prompt; conversations without an answer make no
pair. ``neighbours`` takes the even and odd one of two conversations with following numbers instead.

Null roles render as ``unknown`` and null texts as empty; nulls compare equal to each other. Turns
with the same number are ordered by role and text, and repeated rows stay as they are. A conversation
without a partner gives no rows in ``format_pairs`` and is listed by ``unpaired``. Extra columns are
ignored and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only

TRAINED = ("assistant",)


def _numbered(turns: DataFrame) -> DataFrame:
    """Turns with their place ``pos`` in the conversation, from 1."""
    number = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return (
        only(turns, "conv_id", "turn", "role", "text")
        .where("conv_id is not null")
        .select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("pos", F.row_number().over(number).cast("long"))
    )


def neighbours(turns: DataFrame) -> DataFrame:
    """Pairs of conversations with neighbouring numbers: the even one is chosen, the odd rejected."""
    ids = only(turns, "conv_id").where("conv_id is not null").distinct()
    sides = ids.groupBy(F.shiftright("conv_id", 1).cast("long").alias("pair_id")).agg(
        F.max(F.when(F.pmod("conv_id", F.lit(2)) == 0, F.col("conv_id"))).alias("chosen_id"),
        F.max(F.when(F.pmod("conv_id", F.lit(2)) == 1, F.col("conv_id"))).alias("rejected_id"),
    )
    return sides


def answers_swapped(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (pair_id, chosen_id and rejected_id are all the conversation's id) and the turns of the rejected sides."""
    own = _numbered(turns)
    answers = own.where(F.col("role").isin(*TRAINED)).groupBy("conv_id").agg(F.max(F.struct("pos", "role", "text")).alias("a")).select("conv_id", "a.*")
    pairs = answers.select(F.col("conv_id").alias("pair_id"), F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"))
    before = own.join(answers.select("conv_id", F.col("pos").alias("end")), "conv_id").where("pos < end").select("conv_id", F.col("pos").alias("turn"), "role", "text")
    others = answers.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), "text")
    put = answers.select("conv_id", F.col("pos").alias("turn"), "role").join(others, "conv_id", "left").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    return pairs, before.unionByName(put)


def unpaired(pairs: DataFrame) -> DataFrame:
    return pairs.where("chosen_id is null or rejected_id is null")


def rendered(role, text):
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>\n"))


def format_pairs(turns: DataFrame, pairs: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """One row for each rendered turn of each complete pair; see the module. ``rejected`` holds the turns of
    rejected sides, if these aren't among ``turns``."""
    whole = only(pairs, "pair_id", "chosen_id", "rejected_id").where("chosen_id is not null and rejected_id is not null")
    sides = []
    for part, table in (("chosen", turns), ("rejected", turns if rejected is None else rejected)):
        of = _numbered(table).withColumnRenamed("conv_id", f"{part}_id")
        sides.append(whole.join(of, f"{part}_id").select("pair_id", "chosen_id", "rejected_id", F.lit(part).alias("part"), "pos", "role", "text"))
    own = sides[0].unionByName(sides[1])
    # The two sides of a place stand next to each other; they differ if there is one of them or two kinds.
    places = own.groupBy("pair_id", "pos").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("role", "text").alias("kinds"), F.max(F.col("part") == "chosen").alias("c"))
    prefix = places.groupBy("pair_id").agg(
        F.min(F.when((F.col("n") != 2) | (F.col("kinds") != 1), F.col("pos"))).alias("differ"), F.max("pos").alias("last")
    ).select("pair_id", (F.coalesce("differ", "last") - 1).alias("shared"))
    marked = own.join(prefix, "pair_id").withColumn("in_prompt", F.col("pos") <= F.col("shared"))
    kept = marked.where("not (in_prompt and part = 'rejected')").withColumn("text_out", rendered(F.col("role"), F.col("text")))
    # Lengths run on from the prompt into either completion.
    size = F.length("text_out")
    along = Window.partitionBy("pair_id").orderBy("pos", "part")
    run = along.rowsBetween(Window.unboundedPreceding, -1)
    before_prompt = F.coalesce(F.sum(F.when(F.col("in_prompt"), size)).over(run), F.lit(0))
    before = lambda part: F.coalesce(F.sum(F.when(~F.col("in_prompt") & (F.col("part") == part), size)).over(run), F.lit(0))
    begin = before_prompt + F.when(F.col("in_prompt"), F.lit(0)).when(F.col("part") == "chosen", before("chosen")).otherwise(before("rejected"))
    return kept.withColumn("begin", begin.cast("long")).select(
        "pair_id",
        F.when(F.col("in_prompt"), F.lit("prompt")).otherwise(F.col("part")).alias("part"),
        "pos", "role", F.col("text_out").alias("rendered"), "begin", (F.col("begin") + size).cast("long").alias("finish"),
        (~F.col("in_prompt") & F.col("role").isin(*TRAINED)).alias("train"), "chosen_id", "rejected_id",
    )
