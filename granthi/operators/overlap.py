"""Long verbatim runs shared by two collections, found by equi-joining word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granthi import lexicons as lx
from granthi.functions.text import WS, split_words
from granthi.session import broadcast_if_small, materialise, settled

# So many openings are looked up inside the rows; with more, all shingles are joined.
LISTED_OPENINGS = 20_000


def _word_hashes(texts: DataFrame, key: str, n: int) -> DataFrame:
    return texts.select(key, F.transform(
        split_words(F.lower("text")), lambda w: F.xxhash64(w)).alias("w")).where(F.size("w") >= n)


def shingles(texts: DataFrame, key: str, n: int = lx.VERBATIM_WORDS) -> DataFrame:
    """Hash of every n-word window, lower-cased, with its 0-based start.

    Built from word hashes: the window hash reads n longs, not n strings.
    """
    words = _word_hashes(texts, key, n)
    starts = F.sequence(F.lit(0), F.size("w") - n)
    return words.select(key, F.posexplode(
        F.transform(starts, lambda i: F.xxhash64(F.slice(F.col("w"), i + 1, n)))
    ).alias("pos", "shingle"))


def _opening(n: int) -> str:
    """Hash of a window's first words at the place ``i``."""
    return f"xxhash64({', '.join(f'w[i + {j}]' for j in range(min(n, 4)))})"


def _known_shingles(texts: DataFrame, key: str, n: int, source: DataFrame, source_key: str) -> DataFrame:
    """The shingles of texts that ``source`` may have: a window is hashed only where the first words of one of its windows are.

    A short list of openings is looked up where the words lie, so that no other place becomes a row.
    """
    opening = _word_hashes(source, source_key, n).select(F.explode(F.expr(f"transform(sequence(0, size(w) - {n}), i -> {_opening(n)})")).alias("o"))
    listed = [r.o for r in opening.distinct().limit(LISTED_OPENINGS + 1).collect()]
    if not listed or len(listed) > LISTED_OPENINGS:
        return shingles(texts, key, n)
    # One text: a column expression per number would cost a call to the JVM each.
    wanted = ",".join(f"CAST({v} AS BIGINT)" for v in listed)
    found = F.expr(f"transform(filter(sequence(0, size(w) - {n}), i -> {_opening(n)} IN ({wanted})), "
                   f"i -> struct(i AS pos, xxhash64(slice(w, i + 1, {n})) AS shingle))")
    return settled(_word_hashes(texts, key, n)).select(key, F.inline(found))


def verbatim_runs(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                  n: int = lx.VERBATIM_WORDS) -> DataFrame:
    """Maximal runs of at least n equal words: keys, starts in both texts, length in words.

    Only the shingles that both sides hold survive the join; neighbours on the same diagonal
    are merged into islands, and the few islands are compared word by word against the texts,
    so a hash collision cannot appear as a run. Only texts with an island are read for that.
    """
    r = materialise(shingles(right, right_key, n).withColumnRenamed("pos", "right_pos"), "shingles")
    matched = _known_shingles(left, left_key, n, right, right_key).withColumnRenamed("pos", "left_pos").join(
        broadcast_if_small(r), "shingle"
    ).withColumn("diagonal", F.col("left_pos") - F.col("right_pos"))
    order = Window.partitionBy(left_key, right_key, "diagonal").orderBy("left_pos")
    islands = matched.withColumn("island", F.col("left_pos") - F.row_number().over(order))
    runs = islands.groupBy(left_key, right_key, "diagonal", "island").agg(
        F.min("left_pos").alias("left_start"), F.min("right_pos").alias("right_start"),
        (F.count(F.lit(1)) + n - 1).cast("int").alias("n_words"),
    ).select(left_key, right_key, "left_start", "right_start", "n_words")
    runs = materialise(runs, "runs")

    def words(df: DataFrame, key: str, name: str) -> DataFrame:
        held = df.join(broadcast_if_small(runs.select(key).distinct()), key, "left_semi")
        return held.select(key, split_words(F.lower("text")).alias(name))

    checked = runs.join(words(left, left_key, "lw"), left_key).join(words(right, right_key, "rw"), right_key)
    same = F.slice("lw", F.col("left_start") + 1, F.col("n_words")) == F.slice(
        "rw", F.col("right_start") + 1, F.col("n_words"))
    return checked.where(same).select(left_key, right_key, "left_start", "right_start", "n_words")


def redact_runs(texts: DataFrame, runs: DataFrame, key: str, clause: str) -> DataFrame:
    """Replace every covered word run by one placeholder that names its source clauses.

    ``runs`` is (key, left_start, n_words, clause). Spans of one text are merged first; they are
    bounded by the text's own length. White space outside the spans stays as it is, and a text without a
    run comes out unchanged with 0 spans.
    """
    spans = runs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(
        F.col("left_start").alias("a"), (F.col("left_start") + F.col("n_words")).alias("b"),
        F.array(F.col(clause)).alias("clauses"),
    ))).alias("spans"))
    empty = F.array().cast("array<struct<a:int,b:int,clauses:array<string>>>")
    merged = F.aggregate("spans", empty, lambda out, s: F.when(
        (F.size(out) > 0) & (s["a"] <= F.element_at(out, -1)["b"]),
        F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(
            F.element_at(out, -1)["a"].alias("a"),
            F.greatest(F.element_at(out, -1)["b"], s["b"]).alias("b"),
            F.array_union(F.element_at(out, -1)["clauses"], s["clauses"]).alias("clauses")))),
    ).otherwise(F.concat(out, F.array(F.struct(
        s["a"].alias("a"), s["b"].alias("b"), s["clauses"].alias("clauses"))))))
    # Words with the white space before them, so that joining them gives the text back.
    staged = texts.join(spans, key, "left").select(
        key, "text", F.regexp_extract_all("text", F.lit(f"[{WS}]*[^{WS}]+"), F.lit(0)).alias("w"),
        F.regexp_extract("text", f"[{WS}]*\\z", 0).alias("tail"), F.when(F.col("spans").isNotNull(), merged).alias("m"))
    # Text between the spans: each span contributes the words before it and its placeholder.
    pieces = F.transform("m", lambda s, i: F.concat(
        F.slice("w", F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("m"), i - 1)["b"]) + 1,
                s["a"] - F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("m"), i - 1)["b"])),
        F.array(F.concat(F.regexp_extract(F.element_at("w", s["a"] + 1), f"^[{WS}]*", 0), F.lit("[see "),
                         F.array_join(s["clauses"], ", "), F.lit("]"))),
    ))
    end = F.element_at("m", -1)["b"]
    rest = F.slice("w", end + 1, F.size("w") - end)
    redacted = F.concat(F.array_join(F.concat(F.flatten(pieces), rest), ""), F.col("tail"))
    return staged.select(
        key, F.when(F.col("m").isNull(), F.col("text")).otherwise(redacted).alias("redacted"),
        F.coalesce(F.size("m"), F.lit(0)).alias("spans"))
