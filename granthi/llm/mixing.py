"""Mixing sources to target weights with exact budgets, in DataFrame operations only.

Target words per source are filled like joined vessels: all sources rise in proportion to their weights, and a source
stops at ``cap`` times its own size. Within a source the documents are put in hash-random order. The order
is range-partitioned by leading digits of the key, so many ranges that each holds few documents; word counts
are summed per range, prefix sums run over the ranges of a source, and inside each range. So no task holds a
source, however large. Whole epochs take every document; the rest of a budget is cut in that order, the last
document in part, so that a source's taken words are its target rounded down.

Null texts have no words. Null sources are one source, put last. Rows with equal keys and sizes are interchangeable.
An empty table gives an empty result; sources without words get target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granthi.llm.common import WORD
from granthi.session import broadcast_if_small, materialise

ROWS_PER_RANGE = 4096
KEY_DIGITS = 7
MAX_RANGE_DIGITS = 7


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5,
                   cap: float = 2.0) -> DataFrame:
    """(source, rows, source_size, target) for ``sizes`` with one row per source (source, rows, source_size).

    Sources in code point order, null last, take the weights in turn. The level L at which the sum over sources of
    min(weight * L, cap * size) is ``share`` of all words is found by one running sum over the sources
    ordered by the level at which they are full.
    """
    place = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    full = F.col("source_size") * F.lit(cap)
    by_level = Window.orderBy("full_at", F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # At the first source that is not full, the rest of the words is shared by the weights from there on;
    # counted from a later source the level would come out lower.
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) \
        / F.sum("weight").over(after)
    return (
        sizes.withColumn("weight", weight).withColumn("most", full.cast("double"))
        .withColumn("full_at", F.col("most") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(every))
        .select("source", "rows", "source_size",
                F.coalesce(F.least(F.col("most"), F.col("weight") * F.col("level")), F.col("most")).alias("target"))
    )


def order_key(key: str, seed: str) -> Column:
    """Hash-random place of a document within its source: the same in every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def _cuts(docs: DataFrame, key: str, text: str, source: str, seed: str, targets: dict) -> DataFrame:
    """(key, source, order, size, source_size, target, epochs, last) per row; ``last`` are words of the cut epoch."""
    rows = materialise(docs.select(
        F.col(key), F.col(source).alias("source"), word_count(text).alias("size"),
        order_key(key, seed).alias("order")), "mix_sizes")
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    goal = source_targets(sizes, **targets)
    # As many leading hex digits as leave about ROWS_PER_RANGE documents of the source in a range.
    digits = F.least(F.lit(MAX_RANGE_DIGITS), F.ceil(
        F.log2(F.greatest(F.lit(1.0), F.col("rows") / F.lit(float(ROWS_PER_RANGE)))) / 4)).cast("int")
    per_source = broadcast_if_small(goal.withColumn("digits", digits).withColumnRenamed("source", "__s"))
    placed = (
        rows.join(per_source, F.col("source").eqNullSafe(F.col("__s"))).drop("__s", "rows")
        .withColumn("range", F.expr("substring(order, 1, digits)"))
    )
    ranges = placed.groupBy("source", "range").agg(F.sum("size").alias("range_words"))
    up_to = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(F.col("source").alias("__s"), F.col("range").alias("__r"),
                            F.coalesce(F.sum("range_words").over(up_to), F.lit(0)).alias("offset"))
    inside = (Window.partitionBy("source", "range").orderBy("order", key, "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    budget = F.floor(F.col("target") + F.lit(1e-6))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    left = budget - epochs * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("offset") - F.col("within")))
    return (
        placed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("__s")) & (F.col("range") == F.col("__r")))
        .select(F.col(key), "source", "order", "size", "source_size", "target", epochs.alias("epochs"), last.alias("last"))
    )


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        seed: str = "mix", **targets) -> DataFrame:
    """Per row: key, size, source_size, target, taken.

    ``taken`` counts the words that the mix takes of the document, repeats included; it is at most
    ``cap`` times the size. The text is read once: what is written and shuffled are a few numbers per document.
    """
    return _cuts(docs, key, text, source, seed, targets).select(
        key, "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("last")).cast("long").alias("taken"))


def repeat_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
                     seed: str = "mix", **targets) -> DataFrame:
    """The rows of ``docs``, each once per time that the mix takes it; one taken in part is taken whole.

    The cut of a source is one place in its order, so texts are not shuffled: they meet one row per source.
    """
    place = F.struct(F.col("order"), F.col(key).alias("key"))
    cuts = _cuts(docs, key, text, source, seed, targets).groupBy("source").agg(
        F.max("epochs").alias("__epochs"), F.max(F.when(F.col("last") > 0, place)).alias("__cut"))
    own = F.struct(order_key(key, seed).alias("order"), F.col(key).alias("key"))
    times = (F.col("__epochs") + F.coalesce(own <= F.col("__cut"), F.lit(False)).cast("long")).cast("int")
    return (
        docs.join(broadcast_if_small(cuts.withColumnRenamed("source", "__source")),
                  F.col(source).eqNullSafe(F.col("__source")))
        .withColumn("__times", times).filter("__times > 0")
        .withColumn("__time", F.explode(F.sequence(F.lit(1), F.col("__times"))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
