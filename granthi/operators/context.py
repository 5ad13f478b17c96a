"""Conversation context: follow-up expansion and history blocks, without sorting a whole
conversation in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granthi import lexicons as lx
from granthi.functions.questions import needs_context
from granthi.functions.text import squeeze, strip_ws
from granthi.operators.ordering import BLOCK, last_before, running_sum


def expand_follow_ups(turns: DataFrame) -> DataFrame:
    """User turns with the retrieval query: a follow-up gets the previous user question in front."""
    asked = turns.withColumn(
        "_q", F.when((F.col("role") == "user") & (F.col("text") != ""), F.substring(
            squeeze(F.col("text")), 1, lx.PREVIOUS_QUESTION_CHARS))
    )
    carried = last_before(asked, "conv_id", "turn", "_q", "_last")
    follows = F.col("_last").isNotNull() & needs_context(F.col("text"))
    return carried.where(F.col("role") == "user").select(
        "conv_id", "turn", "text",
        F.when(follows, F.concat("_last", F.lit(" "), strip_ws(F.col("text"))))
        .otherwise(F.col("text")).alias("expanded"),
    )


def history_blocks(turns: DataFrame, messages: int = lx.HISTORY_MESSAGES,
                   chars: int = lx.HISTORY_CHARS) -> DataFrame:
    """The last non-empty turns before each turn, as one context text.

    Non-empty turns are numbered by a blocked running sum; each block of numbers also receives
    the last ``messages`` turns of the block before, so every window stays bounded.
    """
    counted = running_sum(
        turns.withColumn("_has", (F.col("text") != "").cast("int")), "conv_id", "turn", "_has", "_seq"
    ).withColumn("_blk", F.floor(F.col("_seq") / BLOCK))
    says = F.concat(
        F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "),
        F.substring(squeeze(F.col("text")), 1, chars),
    )
    said = counted.withColumn(
        "_say", F.when((F.col("_has") == 1), F.struct(
            "turn", (squeeze(F.col("text")) != "").alias("shown"), says.alias("says")))
    )
    own = said.select("conv_id", "turn", "_blk", "_say", F.lit(True).alias("_own"))
    halo = said.where(
        F.col("_say").isNotNull() & (F.col("_seq") % BLOCK >= BLOCK - messages)
    ).select("conv_id", "turn", (F.col("_blk") + 1).alias("_blk"), "_say", F.lit(False).alias("_own"))
    rows = own.unionByName(halo)
    # The numbered turns before this one: collect_list skips turns that say nothing.
    before = Window.partitionBy("conv_id", "_blk").orderBy("_n").rangeBetween(-messages, -1)
    number = Window.partitionBy("conv_id", "_blk").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("_n", F.count("_say").over(number))
    shown = F.transform(
        F.filter(F.sort_array(F.collect_list("_say").over(before)), lambda s: s["shown"]),
        lambda s: s["says"],
    )
    return (
        numbered.withColumn("_lines", shown).where("_own")
        .select("conv_id", "turn", F.when(
            F.size("_lines") > 0,
            F.concat(F.lit(lx.HISTORY_HEADER + "\n"), F.array_join("_lines", "\n"), F.lit("\n\n")),
        ).otherwise("").alias("history"))
    )
