"""Page cleaning and page status. Every page is judged inside its own row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granthi import lexicons as lx
from granthi.functions.gate import assess_line, assess_lines
from granthi.functions.text import split_lines, strip_ws
from granthi.session import settled


def explode_lines(pages: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """One row per line, numbered from 1."""
    return pages.select(*keys, F.posexplode(split_lines(F.col(raw))).alias("pos", "line")).select(
        *keys, (F.col("pos") + 1).alias("line_no"), "line"
    )


def judge_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Script, score, verdict and reason of each line."""
    return settled(lines.withColumn("_v", assess_line(F.col(line)))).select(*lines.columns, "_v.*")


def _histogram(values):
    """Counts per distinct value, ordered by value."""
    return F.map_from_entries(
        F.transform(
            F.sort_array(F.array_distinct(values)),
            lambda v: F.struct(v, F.size(F.filter(values, lambda w: w == v))),
        )
    )


def clean_pages(pages: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """Kept text, counts, drop ratio, reasons and scripts of each page; no shuffle."""
    lined = settled(pages.select(*keys, F.col(raw).alias("raw"), split_lines(F.col(raw)).alias("_lines")))
    judged = settled(lined.select(*keys, "raw", assess_lines(F.col("_lines")).alias("_l")))
    staged = judged.select(
        *keys, "raw",
        F.filter("_l", lambda x: x["verdict"] == "keep").alias("_kept"),
        F.filter("_l", lambda x: x["verdict"] == "reject").alias("_dropped"),
    )
    return settled(staged.select(
        *keys, "raw",
        F.array_join(F.transform("_kept", lambda x: x["stripped"]), "\n").alias("kept_text"),
        F.size("_kept").alias("kept_lines"),
        F.size("_dropped").alias("dropped_lines"),
        F.coalesce(
            F.try_divide(F.size("_dropped"), F.size("_kept") + F.size("_dropped")), F.lit(0.0)
        ).alias("drop_ratio"),
        F.transform("_dropped", lambda x: x["reason"]).alias("_reasons"),
        F.transform("_kept", lambda x: x["script"]).alias("_scripts"),
    )).select(
        *keys, "raw", "kept_text", "kept_lines", "dropped_lines", "drop_ratio",
        _histogram(F.col("_reasons")).alias("dropped_reasons"),
        _histogram(F.col("_scripts")).alias("scripts"),
    )


def with_page_status(cleaned: DataFrame, error: str | None = None) -> DataFrame:
    """Status cascade; text is kept for ok pages only, and blank pages carry no line counts."""
    raw_len = F.length(strip_ws(F.col("raw")))
    status = (
        F.when(raw_len == 0, "scanned")
        .when(raw_len < lx.MIN_PAGE_CHARS, "empty")
        .when(F.col("drop_ratio") > lx.MAX_PAGE_DROP_RATIO, "mostly_corrupt")
        .when(F.length(strip_ws(F.col("kept_text"))) < lx.MIN_PAGE_CHARS, "empty")
        .otherwise("ok")
    )
    blank = raw_len < lx.MIN_PAGE_CHARS
    if error is not None:
        failed = F.col(error).isNotNull()
        status = F.when(failed, F.concat(F.lit("error: "), F.col(error))).otherwise(status)
        blank = blank | failed
    empty_map = F.create_map().cast("map<string,int>")
    kept = [c for c in cleaned.columns if c not in (
        "raw", "kept_text", "kept_lines", "dropped_lines", "drop_ratio", "dropped_reasons", "scripts")]
    return settled(cleaned.select(
        *kept,
        status.alias("status"),
        F.when(status == "ok", F.col("kept_text")).otherwise("").alias("text"),
        F.when(blank, 0).otherwise(F.col("kept_lines")).alias("kept_lines"),
        F.when(blank, 0).otherwise(F.col("dropped_lines")).alias("dropped_lines"),
        F.when(blank, 1.0).otherwise(F.col("drop_ratio")).alias("drop_ratio"),
        F.when(blank, empty_map).otherwise(F.col("dropped_reasons")).alias("dropped_reasons"),
        F.when(blank, empty_map).otherwise(F.col("scripts")).alias("scripts"),
    ))


def drop_reasons(pages: DataFrame, key: str) -> DataFrame:
    """Lines dropped per document and reason, summed over its pages."""
    return (
        pages.select(key, F.explode("dropped_reasons").alias("reason", "n"))
        .groupBy(key, "reason").agg(F.sum("n").alias("lines"))
    )
