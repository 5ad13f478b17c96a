"""Sources: corpus paths, pages of a document, provenance log, tariff matrix, golden sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granthi import lexicons as lx
from granthi.functions.text import fix_mojibake, strip_ws, title_of
from granthi.session import spread

PROVENANCE_SCHEMA = T.StructType([
    T.StructField("filename", T.StringType()),
    T.StructField("source_url", T.StringType()),
])
TARIFF_SCHEMA = T.StructType([T.StructField(src, T.StringType()) for src, _ in lx.TARIFF_COLUMNS])
GOLDEN_SCHEMA = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("expect_doc", T.StringType()),
    T.StructField("note", T.StringType()),
    T.StructField("language", T.StringType()),
])
IDENTIFIER_GOLDEN_SCHEMA = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("expected_is_numbers", T.ArrayType(T.StringType())),
])
FULL_GOLDEN_SCHEMA = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("audience", T.StringType()),
    T.StructField("expected_intent", T.StringType()),
    T.StructField("expects_citation", T.BooleanType()),
    T.StructField("expects_refusal", T.BooleanType()),
])

# Tables whose rows cost enough that a single small file should feed all cores.
TEXT_TABLES = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def read_files(spark: SparkSession, root: str, glob: str = "*.txt") -> DataFrame:
    """Files below a folder as (relpath, text); Spark lists and reads them in parallel."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob).load(root)
    )
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^file:(//)?", "")
    path = F.regexp_replace("path", "^file:(//)?", "")
    return files.select(
        F.expr("1").alias("one"), path.alias("path"), base.alias("base"),
        F.col("content").cast("string").alias("text"), F.col("length").alias("size_bytes"),
    ).select(F.expr("substring(path, length(base) + 2)").alias("relpath"), "text", "size_bytes")


def with_path_parts(df: DataFrame, relpath: str = "relpath") -> DataFrame:
    """Category, subcategory, filename and title from the path; excluded folders dropped."""
    parts = F.split(F.col(relpath), "/")
    filename = F.element_at(parts, -1)
    return df.where(~F.element_at(parts, 1).isin(lx.EXCLUDED_TOP_DIRS)).select(
        *df.columns,
        F.element_at(parts, 1).alias("category"),
        F.when(F.size(parts) > 2, F.get(parts, 1)).otherwise("").alias("subcategory"),
        filename.alias("filename"),
        title_of(filename).alias("title"),
    )


def explode_pages(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per form-feed separated page, numbered from 1."""
    return docs.select(
        *keys, F.posexplode(F.split(F.col(text), "\f")).alias("pos", "raw")
    ).select(*keys, (F.col("pos") + 1).alias("page_number"), "raw")


def read_provenance_csv(spark: SparkSession, path: str) -> DataFrame:
    """The download log as raw rows with their line order: by file name, place in the file, and line.

    Partitions come in order of size when there are several files, so the running number alone is no order.
    """
    raw = spark.read.schema(PROVENANCE_SCHEMA).option("header", True).option("encoding", "UTF-8").csv(path)
    return raw.withColumn("line_id", F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line")))


def source_urls(log: DataFrame) -> DataFrame:
    """Latest non-empty URL per filename; the later line wins."""
    name, url = strip_ws(F.col("filename")), strip_ws(F.col("source_url"))
    return (
        log.select(name.alias("filename"), url.alias("source_url"), "line_id")
        .where((F.col("filename") != "") & (F.col("source_url") != ""))
        .groupBy("filename").agg(F.max_by("source_url", "line_id").alias("source_url"))
    )


def write_matrix(matrix: DataFrame, path: str) -> None:
    """Replace the whole code matrix."""
    matrix.write.mode("overwrite").parquet(path)


def write_meta(entries: DataFrame, path: str) -> None:
    """Append run metadata (key, value, ts); ``latest_meta`` reads the newest value of a key."""
    entries.select("key", "value", "ts").write.mode("append").parquet(path)


def load_tariff(raw: DataFrame) -> DataFrame:
    """Clean a raw matrix; a missing column is an error that names it."""
    missing = [src for src, _ in lx.TARIFF_COLUMNS if src not in raw.columns]
    if missing:
        raise ValueError(f"matrix lacks the columns {missing}")

    def cell(name: str):
        value = fix_mojibake(strip_ws(F.col(name).cast("string")))
        return F.when(value != "", value)

    cleaned = raw.select(*[cell(src).alias(dest) for src, dest in lx.TARIFF_COLUMNS])
    return cleaned.where(F.col("hsn_cd").isNotNull() & F.col("product").isNotNull())


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return golden_cases(spark.read.text(path))


def golden_cases(lines: DataFrame) -> DataFrame:
    """Retrieval golden set from JSON lines; blank and ``//`` lines are comments."""
    parsed = _json_lines(lines, GOLDEN_SCHEMA)
    return parsed.select(
        "question", "expect_doc",
        F.coalesce("note", F.lit("")).alias("note"),
        F.coalesce("language", F.lit("en")).alias("language"),
    )


def identifier_golden(lines: DataFrame) -> DataFrame:
    return _json_lines(lines, IDENTIFIER_GOLDEN_SCHEMA)


def full_golden(lines: DataFrame) -> DataFrame:
    return _json_lines(lines, FULL_GOLDEN_SCHEMA)


def _json_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    text = strip_ws(F.col("value"))
    return (
        lines.select(text.alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("//"))
        .select(F.from_json("value", schema).alias("r")).select("r.*")
    )


def latest_meta(entries: DataFrame) -> DataFrame:
    """Run metadata: the last write per key wins, of equal times the greatest value."""
    return entries.groupBy("key").agg(F.max(F.struct("ts", "value"))["value"].alias("value"))


def meta_value(entries: DataFrame, keys: DataFrame, default: str) -> DataFrame:
    """Values for the asked keys, the default where a key was never written."""
    return keys.join(latest_meta(entries), "key", "left").select(
        "key", F.coalesce("value", F.lit(default)).alias("value")
    )


def write_index(tables: dict[str, DataFrame], root: str) -> None:
    """Drop and rebuild the index, one Parquet table per entity.

    Postings are clustered by term so that a term lookup prunes files by its statistics.
    The tariff matrix is a table of its own and is not touched here.
    """
    for name, df in tables.items():
        writer = df
        if name == "postings":
            writer = df.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id")
        out = writer.write.mode("overwrite")
        if name == "documents":
            out = out.partitionBy("category")
        out.parquet(f"{root.rstrip('/')}/{name}")


def read_index(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """Tables of a written index."""
    return {name: spark.read.parquet(f"{root.rstrip('/')}/{name}") for name in names}


__all__ = [
    "explode_pages", "full_golden", "golden_cases", "identifier_golden", "latest_meta", "load_tariff",
    "meta_value", "read_files", "read_golden", "read_index", "read_provenance_csv", "source_urls", "table",
    "with_path_parts", "write_index", "write_matrix", "write_meta",
]
