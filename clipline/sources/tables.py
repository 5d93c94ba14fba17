"""The given tables projected into the library's shapes.

A folder of parquet tables is read lazily; only the columns a query uses reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.transcript import pseudo_segments, pseudo_turn_segments, pseudo_words
from ..session import stay_in_place


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


DEAL_BYTES = 1 << 19  # of a table as Spark estimates it from its files; texts of that size hold some hundred thousand words


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` spread by ``keys`` over as many tasks as its size asks for.

    What is taken apart behind the shuffle is many times what was shuffled. Tasks that are put together by the bytes of the texts,
    or whose number stays the same as the input grows, sort more words than they hold in memory and spill them.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // DEAL_BYTES)), *keys)


TASK_BYTES = "8m"  # of shuffled rows, compressed; a task that sorts them several times over takes some hundred MB


def bounded_tasks(df: DataFrame) -> None:
    """Let the tasks behind a shuffle take no more as ``df`` grows, whatever ``spark.sql.shuffle.partitions`` says.

    For the whole session: shuffles start with a part per half MB of the table, and adaptive execution puts parts together up to ``TASK_BYTES``.
    """
    conf = df.sparkSession.conf
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(int(conf.get("spark.sql.shuffle.partitions")), -(-size // DEAL_BYTES))
    conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(parts))
    conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES)


def document_segments(spark: SparkSession, folder: str) -> DataFrame:
    """One video per document, one segment per sentence.

    The texts are spread by video before they are taken apart: a document is one row, so no key is large, the scan of
    a single file does not hold up the work, and no later window, grouping or join on the video moves words again.
    """
    stay_in_place(spark)
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("video_id"), "text")
    return pseudo_segments(dealt(docs, "video_id"))


def document_words(spark: SparkSession, folder: str) -> DataFrame:
    return pseudo_words(document_segments(spark, folder))


def conversation_segments(spark: SparkSession, folder: str) -> DataFrame:
    """One video per conversation, one segment per turn, the role as speaker."""
    turns = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("video_id"), F.col("turn").cast("int").alias("seg_id"), "text", F.col("role").alias("speaker")
    )
    return pseudo_turn_segments(turns)


def event_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Scored spans: one video per user, start in units of 20 minutes since the user's first event."""
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")
    first = events.groupBy("user_id").agg(F.min("ts").alias("__t0"))
    return events.join(first, "user_id").select(
        F.col("user_id").alias("video_id"),
        F.col("event_id").alias("candidate_id"),
        (F.timestamp_diff("MICROSECOND", F.col("__t0"), F.col("ts")) / F.lit(1e6) / F.lit(1200.0)).alias("start_s"),
        F.greatest("value", F.lit(5.0)).alias("length_s"),
        F.col("value").alias("score"),
        F.col("event_type").alias("speaker"),
        "ts",
    ).withColumn("end_s", F.col("start_s") + F.col("length_s"))


def benchmark_anchors(spark: SparkSession, folder: str, n: int = 5) -> DataFrame:
    """First and last words of each benchmark text as phrases to find."""
    t = tokens(F.col("text"))
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("anchor_id"),
        F.array_join(F.slice(t, 1, n), " ").alias("start_phrase"),
        F.array_join(F.slice(t, F.greatest(F.lit(1), F.size(t) - n + 1), n), " ").alias("end_phrase"),
    )


def label_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Review decisions: toxic documents are discarded, poor ones adjusted, others kept."""
    return table(spark, folder, "labels").select(
        F.col("doc_id").alias("video_id"),
        F.when(F.col("toxic") == 1, "discard").when(F.col("quality") == 0, "adjust").otherwise("keep").alias("decision"),
        F.when((F.col("toxic") == 0) & (F.col("quality") == 0), "start +2.0").alias("suggested_adjustment"),
    )


def embedding_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors with the label as speaker."""
    return table(spark, folder, "embeddings").select(
        "vec_id", F.col("label").cast("string").alias("speaker"), "label", "embedding"
    )


def part_catalog(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("track_id"), F.col("p_name").alias("title"), (F.col("p_size") * 10).alias("duration"),
        (F.col("p_retailprice") * 330).cast("bigint").alias("view_count"), F.lit(None).cast("string").alias("live_status"),
    )


def order_stage_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Stage records: one job per customer, one stage per order priority."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("job_id"), F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("updated_at"), F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("amount"),
    )


def event_job_log(spark: SparkSession, folder: str) -> DataFrame:
    """Job events: one job per user, the event type as stage."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("log_id"), F.col("event_type").alias("stage"),
        F.col("value").cast("int").alias("progress"), F.col("props").alias("message"), "ts",
    )
