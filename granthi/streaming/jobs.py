"""Incremental jobs with Structured Streaming.

Every sink writes a folder per micro-batch and overwrites it on a retry, so a batch that runs
again after a lost executor leaves the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from granthi import lexicons as lx
from granthi.operators.chunking import chunk_pages, number_chunks
from granthi.operators.index import Embedder, embed_missing
from granthi.operators.pages import clean_pages, with_page_status
from granthi.session import broadcast_if_small
from granthi.sources.corpus import explode_pages

CHUNK_SCHEMA = T.StructType([
    T.StructField("chunk_id", T.LongType()), T.StructField("sha256", T.StringType()),
    T.StructField("page_number", T.IntegerType()), T.StructField("ordinal", T.LongType()),
    T.StructField("text", T.StringType()), T.StructField("is_numbers", T.StringType()),
    T.StructField("gazette_refs", T.StringType()),
])
VECTOR_SCHEMA = "chunk_id bigint, embedding array<float>"
STATE_SCHEMA = "date date, admitted_calls bigint"


def _batch_dir(root: str, batch_id: int) -> str:
    return f"{root}/batch_id={batch_id}"


def _read_before(spark: SparkSession, root: str, batch_id: int, schema) -> DataFrame:
    """Rows of all earlier batches; the running batch's own earlier attempt is left out."""
    empty = spark.createDataFrame([], schema)
    if batch_id == 0:
        return empty
    typed = empty.schema.add("batch_id", "long")
    return spark.read.schema(typed).parquet(root).where(F.col("batch_id") < batch_id).drop("batch_id")


def ingest_documents(stream: DataFrame, out: str, checkpoint: str,
                     watermark: tuple[str, str] | None = None) -> StreamingQuery:
    """New texts: hash de-duplication, gate, chunking, append.

    With (event-time column, delay) the de-duplication state is bounded by a watermark;
    without, it grows with the number of distinct hashes.
    """
    hashed = stream.withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256))
    if watermark is None:
        unique = hashed.dropDuplicates(["sha256"])
    else:
        unique = hashed.withWatermark(*watermark).dropDuplicatesWithinWatermark(["sha256"])

    def append(batch: DataFrame, batch_id: int) -> None:
        # The batch holds de-duplication state, so it is evaluated once: chunks are staged
        # before the numbering reads them twice.
        pages = explode_pages(batch, ["sha256"])
        status = with_page_status(clean_pages(pages, ["sha256", "page_number"]))
        cut = chunk_pages(status, ["sha256"])
        staged = _batch_dir(f"{out}.staged", batch_id)
        cut.write.mode("overwrite").parquet(staged)
        chunks = number_chunks(batch.sparkSession.read.schema(cut.schema).parquet(staged), "sha256")
        chunks.select(*CHUNK_SCHEMA.fieldNames()).write.mode("overwrite").parquet(_batch_dir(out, batch_id))

    return (
        unique.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def embed_chunks(stream: DataFrame, out: str, checkpoint: str, embedder: Embedder | None = None,
                 dim: int = 64) -> StreamingQuery:
    """Vectors of chunks that no earlier batch has embedded."""
    def append(batch: DataFrame, batch_id: int) -> None:
        known = _read_before(batch.sparkSession, out, batch_id, VECTOR_SCHEMA)
        fresh = embed_missing(batch.dropDuplicates(["chunk_id"]), known, embedder, dim)
        fresh.write.mode("overwrite").parquet(_batch_dir(out, batch_id))

    return (
        stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def daily_usage(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Calls and tokens per day of event time; the watermark bounds the state, later calls of a closed day are dropped."""
    prompt = F.sum(F.greatest(F.col("prompt_tokens"), F.lit(0)))
    completion = F.sum(F.greatest(F.col("completion_tokens"), F.lit(0)))
    return (
        stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"))
        .agg(F.count(F.lit(1)).alias("calls"), prompt.alias("prompt_tokens"),
             completion.alias("completion_tokens"))
        .select(F.col("window.start").cast("date").alias("date"), "calls", "prompt_tokens",
                "completion_tokens", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"))
    )


def keep_latest(df: DataFrame, key: str, out: str, checkpoint: str) -> StreamingQuery:
    """Rows of an aggregation as they change, one folder per micro-batch: the open last day is there as well."""
    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_dir(out, batch_id))

    return (
        df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
        .outputMode("update").trigger(availableNow=True).start()
    )


def latest(spark: SparkSession, schema: T.StructType, key: str, out: str) -> DataFrame:
    """The newest row of each key that ``keep_latest`` has written."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(out)
    return rows.groupBy(key).agg(F.max_by(F.struct(*schema.fieldNames()), "batch_id").alias("r")).select("r.*")


def write_stream(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return (
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def admit_calls(stream: DataFrame, out: str, state: str, checkpoint: str,
                limit: int = lx.DAILY_CALL_LIMIT, keep_days: int = 2) -> StreamingQuery:
    """Cap admission per day across micro-batches, in arrival order of the batches.

    The state is a small table (date, admitted calls) per batch. Within a batch a call is
    admitted while its rank in the day fits what is left; only the first ``limit`` calls of a
    day are ranked, before the shuffle, so a hot day is no hot task. Days older than
    ``keep_days`` before the newest day leave the state, and later calls of those days are
    denied: the cap fails closed.
    """
    def decide(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        used = _read_before(spark, state, batch_id, STATE_SCHEMA) if batch_id == 0 else (
            spark.read.schema(STATE_SCHEMA).parquet(_batch_dir(state, batch_id - 1)))
        floor = used.agg(F.date_sub(F.max("date"), keep_days).alias("floor"))
        calls = batch.select(F.to_date("ts").alias("date"), "ts", "id")
        order = Window.partitionBy("date").orderBy("ts", "id")
        first = calls.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
        fits = (
            first.join(used, "date", "left").crossJoin(F.broadcast(floor))
            .where(F.col("floor").isNull() | (F.col("date") >= F.col("floor")))
            .where(F.col("n") <= F.lit(limit) - F.coalesce("admitted_calls", F.lit(0)))
        )
        last = fits.groupBy("date").agg(
            F.max(F.struct("ts", "id")).alias("last"), F.count(F.lit(1)).alias("now"))
        decided = calls.join(broadcast_if_small(last.select("date", "last")), "date", "left").select(
            "date", "ts", "id",
            F.coalesce(F.struct("ts", "id") <= F.col("last"), F.lit(False)).alias("admitted"),
        )
        decided.write.mode("overwrite").parquet(_batch_dir(out, batch_id))
        merged = (
            used.unionByName(last.select("date", F.col("now").alias("admitted_calls")))
            .groupBy("date").agg(F.sum("admitted_calls").alias("admitted_calls"))
        )
        newest = merged.agg(F.date_sub(F.max("date"), keep_days).alias("floor"))
        merged.crossJoin(F.broadcast(newest)).where(F.col("date") >= F.col("floor")).drop("floor") \
            .write.mode("overwrite").parquet(_batch_dir(state, batch_id))

    return (
        stream.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
