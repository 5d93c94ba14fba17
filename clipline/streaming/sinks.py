"""Where streams put their rows: a Parquet folder that is updated by key, or only grows.

A batch of an updating stream becomes one version of its rows, ``batch=N``. Writing it again after a failure overwrites the same folder, so
a restart leaves each batch there once. The table is the newest version of each key; ``compact`` writes it out as a table of its own.
Nothing is gathered on the driver, and no state is kept in the stream for what the table holds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def upsert_stream(out: DataFrame, folder: str, reduce: Callable[[DataFrame], DataFrame] | None = None, mode: str = "update", **trigger) -> StreamingQuery:
    """Start ``out`` into ``folder``: each batch, after ``reduce``, is one version. State and progress are kept beside it; start again to go on.

    ``trigger`` is that of ``DataStreamWriter.trigger``; without it, what is there is read once.
    """
    shape = out if reduce is None else reduce(out.sparkSession.createDataFrame([], out.schema))
    # so that there is a table before the first batch
    out.sparkSession.createDataFrame([], shape.schema).write.mode("ignore").parquet(f"{folder}/table/batch=-1")

    def write(batch: DataFrame, n: int) -> None:
        (batch if reduce is None else reduce(batch)).write.mode("overwrite").parquet(f"{folder}/table/batch={n}")

    writer = out.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/progress")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def latest(spark: SparkSession, folder: str, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The newest row of each key: by ``order`` if given, then by batch."""
    rows = spark.read.parquet(f"{folder}/table")
    rest = [c for c in rows.columns if c not in {*keys, "batch"}]
    newest = F.max_by(F.struct(*rest), F.struct(*order, "batch")).alias("__row")
    return rows.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def compact(spark: SparkSession, folder: str, into: str, keys: Sequence[str], order: Sequence[str] = ()) -> None:
    """Write the table as version 0 of a new folder; a stream that goes on there starts with progress of its own."""
    latest(spark, folder, keys, order).write.mode("overwrite").parquet(f"{into}/table/batch=0")


def append_stream(out: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Start ``out``, of which each row comes once, into Parquet files of ``folder``."""
    writer = out.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/progress")
    return writer.trigger(**(trigger or {"availableNow": True})).start()
