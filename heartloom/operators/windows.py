"""Tumbling windows, window joins and window quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heartloom.missing import fin, ratio
from heartloom.schemas import WINDOW_SEC


def tumbling_windows(samples: DataFrame, length: float = WINDOW_SEC) -> DataFrame:
    """(subject, window_id, start_time_sec, end_time_sec, sample_rate_hz): whole windows anchored at the first sample.

    The sample step is the median difference of times; a window that ends within a tenth of a step after the last
    sample's end still counts, and the rest of the recording is left out.
    """
    by = Window.partitionBy("subject").orderBy("i")
    steps = samples.withColumn("step", F.col("time_sec") - F.lag("time_sec").over(by))
    each = steps.groupBy("subject").agg(F.percentile("step", 0.5).alias("dt"), F.min_by("time_sec", "i").alias("first"), F.max_by("time_sec", "i").alias("last"), F.count("*").alias("n"))
    each = each.withColumn("n", F.when(F.col("n") < 3, F.raise_error(F.lit("ground truth has fewer than three samples"))).otherwise(F.col("n")))
    count = F.floor((F.col("last") + F.col("dt") - F.col("first") + F.col("dt") * 0.1) / length)
    rows = each.filter(F.col("n") >= 3).filter(count > 0).select("subject", "first", "dt", F.explode(F.sequence(F.lit(0), count.cast("int") - 1)).alias("k"))
    start = F.col("first") + F.col("k") * F.lit(length)
    return rows.select("subject", (F.col("k") + 1).cast("bigint").alias("window_id"), start.alias("start_time_sec"), (start + length).alias("end_time_sec"), ratio(F.lit(1.0), F.col("dt")).alias("sample_rate_hz"))


def window_rows(windows: DataFrame, rows: DataFrame, keys: list[str], length: float = WINDOW_SEC) -> DataFrame:
    """windows left-joined to the rows whose time is in [start, end) of the same keys, in one join.

    Time buckets of a window's length make an equi-key, so the range condition is tested on neighbours only and a
    long recording is spread over tasks. The exact bounds decide. A window has a row without time for each of its
    buckets that has nothing for it, so empty windows are there, and others may have such a row beside their own:
    aggregates that ignore missing values need no second look. ``in_windows`` leaves those rows out.
    """
    spread = windows.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start_time_sec") / length), F.floor(F.col("end_time_sec") / length))))
    w, r = spread.alias("w"), rows.withColumn("__b", F.floor(F.col("time_sec") / length)).alias("r")
    cond = (F.col("r.time_sec") >= F.col("w.start_time_sec")) & (F.col("r.time_sec") < F.col("w.end_time_sec"))
    for k in (*keys, "__b"):
        cond = cond & (F.col(f"w.{k}") == F.col(f"r.{k}"))
    return w.join(r, cond, "left").select(*(F.col(f"w.{c}") for c in windows.columns), *(F.col(f"r.{c}") for c in rows.columns if c not in windows.columns))


#: Windows up to this many are broadcast to their frames (about 50 MB); of more, both are shuffled.
FEW = 300_000


def frames_in(windows: DataFrame, rows: DataFrame, few: bool, length: float = WINDOW_SEC) -> DataFrame:
    """rows of the same subject whose time is in a window's [start, end), with the windows' columns; empty windows are left
    out. With ``few``, the windows are broadcast and no row is shuffled."""
    spread = windows.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start_time_sec") / length), F.floor(F.col("end_time_sec") / length))))
    joined = rows.withColumn("__b", F.floor(F.col("time_sec") / length)).join(F.broadcast(spread) if few else spread, ["subject", "__b"])
    return joined.filter((F.col("time_sec") >= F.col("start_time_sec")) & (F.col("time_sec") < F.col("end_time_sec"))).drop("__b")


def in_windows(windows: DataFrame, rows: DataFrame, keys: list[str], length: float = WINDOW_SEC) -> DataFrame:
    """The same with each window's rows alone, or one row without time where it has none."""
    joined = window_rows(windows, rows, keys, length)
    by = Window.partitionBy(*keys, "window_id")
    place = F.row_number().over(by.orderBy(F.col("time_sec").asc_nulls_last()))
    marked = joined.withColumns({"__n": F.count("time_sec").over(by), "__i": place})
    return marked.filter(F.col("time_sec").isNotNull() | ((F.col("__n") == 0) & (F.col("__i") == 1))).drop("__n", "__i")


def effective_rate(n: Column, first: Column, last: Column) -> Column:
    """(n - 1) / (last - first), NULL for fewer than two samples."""
    return F.when(n >= 2, ratio(n - 1, last - first))


def coverage(n: Column, rate: Column, length: Column) -> Column:
    """Frames against those expected at the rate, at most 1; 0 without a rate. Expected counts round half to even."""
    expected = F.bround(length * rate, 0)
    share = ratio(n, F.when(expected > 0, expected))
    return F.when(share > 1.0, 1.0).otherwise(F.coalesce(share, F.lit(0.0)))


def status(cover: Column, valid_fraction: Column, gap: Column) -> Column:
    """The first quality gate that fails, or ok."""
    return F.when(cover < 0.95, "low_video_coverage").when(valid_fraction < 0.80, "low_valid_fraction").when(gap > 0.50, "long_missing_gap").otherwise("ok")


def longest_gap(start: Column, times: Column, end: Column) -> Column:
    """The largest step of the valid times in order, the window's edges included."""
    points = F.concat(F.array(start), times, F.array(end))
    return F.array_max(F.zip_with(F.slice(points, F.lit(2), F.size(points) - 1), F.slice(points, F.lit(1), F.size(points) - 1), lambda b, a: b - a))


def window_quality(windows: DataFrame, frames: DataFrame, by: list[str]) -> DataFrame:
    """Quality, status and ordered samples of each window and group of ``by`` (subject, condition, roi).

    frames: one row per frame and region with sel_seq, the order that rates and gaps follow. windows must hold every
    group wanted, so a window without frames has its row too.
    """
    joined = window_rows(windows, frames, by)
    good = F.coalesce("valid", F.lit(False)) & fin("r").isNotNull() & fin("g").isNotNull() & fin("b").isNotNull()
    here = F.col("time_sec").isNotNull()
    sample = F.struct("sel_seq", "time_sec", F.when(good, F.col("r")).alias("r"), F.when(good, F.col("g")).alias("g"), F.when(good, F.col("b")).alias("b"), good.alias("good"), fin("brightness").alias("brightness"))
    keys = list(windows.columns)
    stats = joined.groupBy(*keys).agg(
        F.count_if(here).alias("n_frames"), F.min_by("time_sec", "sel_seq").alias("t0"), F.max_by("time_sec", "sel_seq").alias("t1"),
        F.coalesce(ratio(F.count_if(here & good), F.count_if(here)), F.lit(0.0)).alias("valid_frame_fraction"),
        *(F.avg(fin(c)).alias(f"mean_{c}") for c in ("face_area_ratio", "face_center_shift", "face_area_change", "overexposure_ratio")),
        F.stddev_pop(fin("brightness")).alias("brightness_std"), F.array_sort(F.collect_list(F.when(here, sample))).alias("samples"),
    )
    rate = effective_rate(F.col("n_frames"), F.col("t0"), F.col("t1"))
    # frame by frame, so that the last digit doesn't depend on how rows were dealt
    light = F.filter(F.col("samples.brightness"), lambda x: x.isNotNull())
    stats = stats.withColumn("mean_brightness", ratio(F.aggregate(light, F.lit(0.0), lambda s, x: s + x), F.size(light)))
    times = F.transform(F.filter("samples", lambda s: s["good"]), lambda s: s["time_sec"])
    stats = stats.withColumn("sample_rate_hz", rate).withColumn("max_missing_gap_sec", longest_gap(F.col("start_time_sec"), times, F.col("end_time_sec")))
    cover = coverage(F.col("n_frames"), F.col("sample_rate_hz"), F.col("end_time_sec") - F.col("start_time_sec"))
    return stats.withColumn("window_status", status(cover, F.col("valid_frame_fraction"), F.col("max_missing_gap_sec"))).drop("t0", "t1")


def sensor_corrected(hr: Column) -> Column:
    """Sensor values in (0, 42) have wrapped round and get 128 more."""
    return F.when((fin(hr) > 0) & (fin(hr) < 42), hr + 128.0).otherwise(fin(hr))


def carried(rows: DataFrame, keys: list[str], order: str, span: float, value: Column, name: str, ahead: bool = False) -> DataFrame:
    """rows with the column ``name``: the last value that is not null in an earlier row of the same keys (or, with
    ``ahead``, the first in a later one), by ``order``.

    A recording is cut into stretches of ``span`` units of the order. The last value of each stretch is found first, by a
    grouped maximum; one small row for each stretch carries it on, and each stretch is then filled on its own. So no
    task holds a recording. rows is read twice.
    """
    piece = F.floor(F.col(order) / span)
    held = rows.withColumns({"__piece": piece, "__value": F.struct(value.alias("v"))}).withColumn("__value", F.when(F.col("__value.v").isNotNull(), F.col("__value")))
    pick = F.min_by if ahead else F.max_by
    ends = held.filter("__value is not null").groupBy(*keys, "__piece").agg(pick("__value", order).alias("__end"))
    stretches = held.select(*keys, "__piece").distinct().join(ends, [*keys, "__piece"], "left")
    along = F.col("__piece").desc() if ahead else F.col("__piece")
    before = Window.partitionBy(*keys).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.select(*keys, "__piece", F.last("__end", ignorenulls=True).over(before).alias("__carry"))
    step = F.col(order).desc() if ahead else F.col(order)
    inside = Window.partitionBy(*keys, "__piece").orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    out = held.join(stretches, [*keys, "__piece"], "left").withColumn(name, F.coalesce(F.last("__value", ignorenulls=True).over(inside), F.col("__carry"))["v"])
    return out.select(*rows.columns, name)


#: Frames, and seconds, of the stretches in which a recording is filled.
STRETCH_FRAMES, STRETCH_SEC = 4096, 600.0


def motion_since_face(frames: DataFrame) -> DataFrame:
    """Shift of the face centre, by face width, and change of face area since the last frame with a face; 0 at first.

    frames: subject, frame_idx, landmark_valid, cx, cy, face_width_px, face_area_ratio.
    """
    face = F.col("landmark_valid")
    seen = F.when(face, F.struct(F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("face_area_ratio").alias("a")))
    out = carried(frames, ["subject"], "frame_idx", STRETCH_FRAMES, seen, "__last")
    shift = ratio(F.hypot(F.col("cx") - F.col("__last.x"), F.col("cy") - F.col("__last.y")), F.col("face_width_px"))
    change = ratio(F.abs(F.col("face_area_ratio") - F.col("__last.a")), F.col("__last.a"))
    first = F.col("__last").isNull()
    return out.withColumn("face_center_shift", F.when(face, F.when(first, 0.0).otherwise(shift))).withColumn("face_area_change", F.when(face, F.when(first, 0.0).otherwise(change))).drop("__last")


def fill_linear(rows: DataFrame, keys: list[str], time: str, value: str, good: str, span: float = STRETCH_SEC) -> DataFrame:
    """value interpolated linearly between good rows, the nearest good value beyond the ends; column ``filled``.

    span is the length of the stretches that are filled on their own; it changes no value.
    """
    point = F.when(F.col(good) & F.col(value).isNotNull(), F.struct(F.col(time).alias("t"), F.col(value).alias("v")))
    out = carried(carried(rows, keys, time, span, point, "__back"), keys, time, span, point, "__ahead", ahead=True)
    share = ratio(F.col(time) - F.col("__back.t"), F.col("__ahead.t") - F.col("__back.t"))
    mid = F.col("__back.v") + (F.col("__ahead.v") - F.col("__back.v")) * F.coalesce(share, F.lit(0.0))
    own = F.when(F.col(good), F.col(value))
    return out.withColumn("filled", F.coalesce(own, mid, F.col("__back.v"), F.col("__ahead.v"))).drop("__back", "__ahead")
