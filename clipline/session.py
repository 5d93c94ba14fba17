"""Session helpers: where to cut lineage, and defaults for local runs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; make a folder only in a local session that names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
    sc.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop the plan behind it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stay_in_place(spark: SparkSession) -> None:
    """Let joins on a key and more (a video and a time bucket) use rows that are spread by the key, as windows and groupings do anyway.

    For the whole session; it changes where rows are joined, never which.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def cut_lineage_in_place(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for rows spread by a bounded key: later windows, groupings and joins that include the key find them where they are.

    A plan that may still change while it runs does not say how its rows are spread, and what is read back would be shuffled
    again by every step. So this one job runs as planned.
    """
    conf, adaptive = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(adaptive)
    conf.set(adaptive, "false")
    try:
        return cut_lineage(df.select("*"))  # a new plan, made under this setting
    finally:
        conf.set(adaptive, before)


def cut_lineage_of(df: DataFrame, large: bool | None) -> DataFrame:
    """``cut_lineage``, in place if the caller knows that every key is bounded by one input row (``large=False``)."""
    return cut_lineage_in_place(df) if large is False else cut_lineage(df)


def local_session(cores: str = "*", app: str = "clipline", **conf: str) -> SparkSession:
    """A session for tests and local benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
