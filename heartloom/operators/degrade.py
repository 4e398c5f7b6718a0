"""Controlled degradations: fewer frames a second, and a drifting region."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType

from heartloom.functions import gathered
from heartloom.operators.windows import window_rows
from heartloom.schemas import RATES


@pandas_udf(ArrayType(IntegerType()))
def pick_frames(times: pd.Series, start: pd.Series, end: pd.Series, fps: pd.Series) -> pd.Series:
    """``gathered.pick`` of each row's list of times."""
    return pd.Series([gathered.pick(np.asarray(t, float), *x) for t, *x in zip(times, start.tolist(), end.tolist(), fps.tolist(), strict=True)], dtype=object)


def downsample(windows: DataFrame, frames: DataFrame, fps: float) -> DataFrame:
    """(subject, window_id, frame_idx, time_sec, sel_seq) of the frames kept; frames: subject, frame_idx, time_sec.

    A frame's place within its window is fixed by time, then frame_idx; the choice starts anew in each window.
    """
    return downsample_all(windows, frames, {"": fps}).drop("condition")


def downsample_all(windows: DataFrame, frames: DataFrame, rates: dict[str, float]) -> DataFrame:
    """The same for several conditions and their rates (column condition), from one list of each window's frames."""
    held = windows.select("subject", "window_id", "start_time_sec", "end_time_sec")
    here = F.when(F.col("time_sec").isNotNull(), F.struct("frame_idx", "time_sec"))
    each = window_rows(held, frames.select("subject", "frame_idx", "time_sec"), ["subject"]).groupBy(*held.columns).agg(F.array_sort(F.collect_list(here)).alias("fs"))
    picked = lambda fps: pick_frames(F.col("fs.time_sec"), F.col("start_time_sec"), F.col("end_time_sec"), F.lit(float(fps)))
    each = each.withColumns({f"__{i}": picked(fps) for i, fps in enumerate(rates.values())})
    every = F.explode(F.array(*(F.struct(F.lit(name).alias("condition"), F.col(f"__{i}").alias("ks")) for i, name in enumerate(rates))))
    rows = each.select("subject", "window_id", "fs", every.alias("c")).select("subject", "window_id", "fs", "c.condition", F.posexplode("c.ks").alias("sel_seq", "k"))
    return rows.select("subject", "window_id", F.get("fs", F.col("k"))["frame_idx"].alias("frame_idx"), F.get("fs", F.col("k"))["time_sec"].alias("time_sec"), F.col("sel_seq").cast("bigint").alias("sel_seq"), "condition")


def drift(time: Column, width: Column, fraction: Column | float) -> tuple[Column, Column]:
    """Offsets in x and y of a figure of eight of ten seconds, scaled by face width and fraction."""
    fraction = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    phase = F.pmod(time, F.lit(10.0)) * (2 * math.pi / 10.0)
    return F.sin(phase) * width * fraction, F.sin(phase * 2) * 0.5 * width * fraction


def source_traces(original: DataFrame, shifted: DataFrame | None = None) -> DataFrame:
    """Long traces of the conditions that have frames of their own: the original and given traces of shifted regions.

    The original's shift is 0 and its retention 1 in every frame, with or without a face. shifted has a condition
    column and its own frames.
    """
    order = F.col("frame_idx").cast("bigint")
    plain = original.withColumns({"roi_shift_fraction": F.lit(0.0), "roi_shift_x_px": F.lit(0.0), "roi_shift_y_px": F.lit(0.0), "retention_ratio": F.lit(1.0), "condition": F.lit("original"), "sel_seq": order})
    return plain if shifted is None else plain.unionByName(shifted.withColumn("sel_seq", order).select(*plain.columns))


def condition_traces(windows: DataFrame, original: DataFrame, shifted: DataFrame | None = None) -> DataFrame:
    """Long traces of all conditions: those of ``source_traces``, and two lower frame rates of the original."""
    sources = source_traces(original, shifted)
    plain = source_traces(original)
    kept = downsample_all(windows, plain.select("subject", "frame_idx", "time_sec").distinct(), RATES)
    place = F.struct("condition", (F.col("window_id") * 1_000_000 + F.col("sel_seq")).alias("sel_seq"))
    uses = kept.groupBy("subject", "frame_idx").agg(F.collect_list(place).alias("uses"))  # as many as the rates and the windows a frame is in
    each = plain.drop("condition", "sel_seq").join(uses, ["subject", "frame_idx"]).withColumn("use", F.explode("uses"))
    return sources.unionByName(each.select("*", "use.condition", "use.sel_seq").select(*sources.columns))
