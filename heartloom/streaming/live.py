"""Candidates that arrive as files, summarised as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heartloom.operators.candidates import metrics
from heartloom.schemas import CANDIDATES


def candidate_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the candidates in Parquet files of a folder."""
    return spark.readStream.schema(CANDIDATES).parquet(path)


def live_metrics(stream: DataFrame) -> DataFrame:
    """The metrics of all candidates so far, for the complete output mode; the state is one row per cell."""
    return metrics(stream)


def frame_rates(frames: DataFrame, length: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Frames and share of valid frames by subject in event-time windows; windows close once the watermark passes.

    frames: subject, ts, valid. Frames later than the watermark are left out, as an open window would never be final.
    """
    held = frames.withWatermark("ts", late)
    return held.groupBy("subject", F.window("ts", length).alias("w")).agg(F.count("*").alias("n_frames"), F.avg(F.col("valid").cast("double")).alias("valid_frame_fraction")).select("subject", F.col("w.start").alias("start"), "n_frames", "valid_frame_fraction")
