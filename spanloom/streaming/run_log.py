"""The run log as a stream: rows that arrive as files are judged counts, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.schemas import RUN_LOG, struct


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """New files of a log folder as they come."""
    return spark.readStream.schema(struct(RUN_LOG)).json(path).where("run_id is not null")


def append_stream(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch added to a log folder once, whatever fails in between."""
    return rows.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def label_counts(rows: DataFrame) -> DataFrame:
    """Running counts by run and label."""
    return rows.groupBy("run_id", "judge_label").agg(F.count("*").alias("n"))
