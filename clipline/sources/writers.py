"""Writers: one text or JSON document per video or clip, written by the tasks that hold the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import minutes_text
from ..operators.captions import srt_cues
from ..operators.packaging import package_text
from ..operators.transcript import transcript_line


def plan_documents(plans: DataFrame) -> DataFrame:
    """The plan of each video as one JSON text; a plan holds the few clips kept per video."""
    row = F.struct("clip_index", *[c for c in plans.columns if c not in ("video_id", "clip_index")])
    return plans.groupBy("video_id").agg(F.to_json(F.sort_array(F.collect_list(row))).alias("value"))


def write_lines(rows: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], parts: bool = False) -> None:
    """A folder per key with its ``value`` lines in order, in one sorted pass over range-partitioned rows; ``read_lines`` numbers them again.

    A key is one file, streamed by one task whatever its size. With ``parts`` the ranges cut through keys as well, so a key with most of the
    rows becomes several files whose names follow the order. Writing again replaces the folder, a repeated task replaces its files.
    """
    by = [*keys, *order] if parts else [*keys]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*keys, *order)
    placed.select(*keys, "value").write.mode("overwrite").partitionBy(*keys).text(path)


def write_keyed_lines(rows: DataFrame, path: str, keys: Sequence[str], order: Sequence[str] = ()) -> None:
    """``write_lines`` for any number of keys: JSON lines of the keys, the order and ``value``, in as many files as there are tasks.

    A folder per key costs a file to make, to list and to open for each; here the number of files does not grow with the keys.
    ``readers.read_keyed_lines`` gives the lines that ``read_lines`` gives of the folders.
    """
    placed = rows.select(*keys, *order, "value").sortWithinPartitions(*keys, *order)
    placed.write.mode("overwrite").option("compression", "gzip").json(path)


def read_plan(spark: SparkSession, path: str, row: str, keyed: bool = False) -> DataFrame:
    """Rows of the plans that ``write_plan`` wrote (video_id as text); ``row`` is the schema of a plan's entry."""
    schema = spark.read.schema("value string, video_id string")
    docs = schema.json(path) if keyed else schema.text(path, wholetext=True)
    return docs.select("video_id", F.explode(F.from_json("value", f"array<struct<{row}>>")).alias("__e")).select("video_id", "__e.*")


def write_plan(plans: DataFrame, path: str, keyed: bool = False) -> None:
    """One folder per video with its plan document; ``keyed``: the documents as JSON lines, for any number of videos."""
    if keyed:
        write_keyed_lines(plan_documents(plans).withColumn("video_id", F.col("video_id").cast("string")), path, ["video_id"])
        return
    plan_documents(plans).write.mode("overwrite").partitionBy("video_id").text(path)


def write_srt(captions: DataFrame, path: str, keyed: bool = False) -> None:
    """One subtitle file per clip, in a folder per video and clip; a clip's cues pass as rows, not as one text.

    ``keyed``: the cues of all clips as JSON lines, for any number of clips.
    """
    write = write_keyed_lines if keyed else write_lines
    write(srt_cues(captions).withColumnRenamed("cue", "value"), path, ["video_id", "clip_name"], ["caption_no"])


def write_packages(plans: DataFrame, path: str) -> None:
    package_text(plans).withColumnRenamed("package", "value").write.mode("overwrite").partitionBy("video_id", "clip_name").text(path)


def window_lines(windows: DataFrame) -> DataFrame:
    """Header and timed lines of each transcript window as rows in reading order (video_id, window, line_no, value).

    windows: the output of ``transcript_windows``. Lines stay rows, so a window of any size is no single value.
    """
    speaker = F.col("speaker") if "speaker" in windows.columns else F.lit(None).cast("string")
    body = windows.select("video_id", "window", F.col("seg_id").cast("bigint").alias("line_no"), transcript_line(F.col("start_s"), F.col("end_s"), speaker, F.col("text")).alias("value"))
    head = windows.groupBy("video_id", "window").agg(F.min("window_start").alias("a"), F.max("window_end").alias("b")).select(
        "video_id", "window", F.lit(-1).cast("bigint").alias("line_no"),
        F.concat(F.lit("=== WINDOW "), (F.col("window") + 1).cast("string"), F.lit(": "), minutes_text(F.col("a")), F.lit(" -> "), minutes_text(F.col("b")), F.lit(" ===")).alias("value"),
    )
    return head.unionByName(body)


def write_transcript_windows(windows: DataFrame, path: str, keyed: bool = False) -> None:
    """One file per video and window, each in a folder of its own; ``keyed``: the lines of all windows as JSON lines, for any number of windows."""
    write = write_keyed_lines if keyed else write_lines
    write(window_lines(windows), path, ["video_id", "window"], ["line_no"])
