"""Reference windows, candidates, condition audits and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heartloom.functions import gathered, kernels
from heartloom.missing import fin, finite, ratio
from heartloom.operators.windows import FEW, effective_rate, frames_in, sensor_corrected, tumbling_windows, window_rows
from heartloom.schemas import AUDIT_KEY, CANDIDATES, CONDITIONS, METHODS, REFERENCE_WINDOWS, ROIS, condition_dim, roi_dim


def _ordered(df: DataFrame, schema: str) -> DataFrame:
    return df.select(*(F.col(x.split()[0]).cast(x.split()[1]) for x in schema.split(", ")))


def reference_windows(samples: DataFrame) -> DataFrame:
    """Contact-sensor windows (schema REFERENCE_WINDOWS) from samples (subject, i, time_sec, ppg, sensor_hr)."""
    windows = tumbling_windows(samples)
    each = window_rows(windows, samples, ["subject"]).groupBy(*windows.columns).agg(
        F.count("time_sec").alias("n_samples"), F.percentile(sensor_corrected(F.col("sensor_hr")), 0.5).alias("sensor_hr_bpm"),
        F.array_sort(F.collect_list(F.when(F.col("time_sec").isNotNull(), F.struct("i", "time_sec", "ppg")))).alias("s"),
    )
    out = each.withColumn("hr", kernels.contact_rate(F.col("s.time_sec"), F.col("s.ppg"))).select("*", "hr.*")
    apart = F.abs(F.col("time_hr_bpm") - F.col("frequency_hr_bpm"))
    out = out.withColumns({
        "window_center_time_sec": F.col("start_time_sec") + 5.0, "duration_sec": F.lit(10.0), "reference_hr_bpm": F.col("time_hr_bpm"), "time_frequency_diff_bpm": apart,
        "reference_sensor_diff_bpm": F.abs(F.col("time_hr_bpm") - F.col("sensor_hr_bpm")), "reference_valid": F.coalesce(apart <= 5.0, F.lit(False)),
    })
    return _ordered(out, REFERENCE_WINDOWS)


def method_agreement(df: DataFrame) -> DataFrame:
    """pos_chrom_diff_bpm: how far the two methods' rates lie apart in each subject, condition, window and region."""
    by = Window.partitionBy(*AUDIT_KEY)
    rate = lambda m: F.max(F.when(F.col("method") == m, F.col("rppg_hr_bpm"))).over(by)
    return df.withColumn("pos_chrom_diff_bpm", F.abs(rate("POS") - rate("CHROM")))


#: Windows of one task of the candidates; each has some thousands of frames in all conditions and regions.
WINDOWS = 300


def candidates(references: DataFrame, frames: DataFrame, conditions: list[str] | None = None, picked: dict[str, float] | None = None) -> DataFrame:
    """Candidates (schema CANDIDATES): a row for each reference window, condition, region and method.

    frames: long traces with condition and sel_seq. Windows without frames keep their rows. The kernels run once for
    each window and region that passes the quality gates; one whose rate is too low for the band has no estimate.
    picked: conditions without frames of their own, whose frames are picked from the original's (sel_seq its frame_idx)
    at those frames a second. references is read several times.

    Frames are shuffled once, to their window, as numbers alone; a window's conditions and regions are measured there.
    """
    names = [c for c, *_ in CONDITIONS if not conditions or c in conditions]
    picked = {c: fps for c, fps in (picked or {}).items() if c in names}
    sources = [c for c in names if c not in picked]
    sources += ["original"] if picked and "original" not in sources else []
    n = references.count()
    few = n <= FEW
    held = references.select("subject", "window_id", "start_time_sec", "end_time_sec")
    place = lambda c, values: F.array_position(F.array(*map(F.lit, values)), F.col(c)) - 1
    good = F.coalesce("valid", F.lit(False)) & fin("r").isNotNull() & fin("g").isNotNull() & fin("b").isNotNull()
    numbers = frames.filter(F.col("condition").isin(sources) & F.col("roi").isin(*ROIS)).select(
        "subject", (place("condition", sources) * len(ROIS) + place("roi", ROIS)).cast("int").alias("cell"), "sel_seq", F.col("time_sec").cast("double").alias("time_sec"),
        *(F.when(good, fin(c)).alias(c) for c in "rgb"), *(fin(c).alias(c) for c in gathered.MEANS),
    )
    rows = frames_in(held, numbers, few).unionByName(held.withColumn("cell", F.lit(-1)), allowMissingColumns=True)
    rows = rows.withColumn("__key", F.xxhash64("subject", "window_id")).select(*gathered.FRAMES)
    parts = max(references.sparkSession.sparkContext.defaultParallelism, -(-n // WINDOWS))
    q = rows.repartition(parts, "__key").sortWithinPartitions("__key").mapInArrow(gathered.measured(sources, names, picked), gathered.MEASURED)
    named = lambda m: F.struct(F.lit(m).alias("method"), *(F.col(f"{m.lower()}_{c}").alias(c) for c in kernels.RATE.names))
    apart = F.abs(F.col("pos_rppg_hr_bpm") - F.col("chrom_rppg_hr_bpm"))
    out = q.withColumns({"pos_chrom_diff_bpm": apart, "x": F.explode(F.array(*map(named, METHODS)))}).select("*", "x.*")
    known = references.select("subject", "window_id", "start_time_sec", "end_time_sec", "duration_sec", "reference_hr_bpm", "reference_valid")
    out = out.join(F.broadcast(known) if few else known, ["subject", "window_id"])
    error = fin("rppg_hr_bpm") - F.col("reference_hr_bpm")
    return _ordered(out.withColumns({"signed_error_bpm": error, "absolute_error_bpm": F.abs(error)}), CANDIDATES)


def condition_audit(references: DataFrame, frames: DataFrame, conditions: list[str] | None = None) -> DataFrame:
    """How strongly each condition degraded each window and region; empty windows have 0 frames and missing measures."""
    spark = references.sparkSession
    conds = condition_dim(spark)
    conds = conds.filter(F.col("condition").isin(conditions)) if conditions else conds
    grid = references.select("subject", "window_id", "start_time_sec", "end_time_sec").join(F.broadcast(conds.join(roi_dim(spark), F.lit(True))), F.lit(True))
    joined = window_rows(grid, frames, ["subject", "condition", "roi"])
    here = F.col("time_sec").isNotNull()
    shift = fin(ratio(F.hypot("roi_shift_x_px", "roi_shift_y_px"), F.col("face_width_px")))
    keep = fin("retention_ratio")
    checked = shift.isNotNull() & keep.isNotNull()
    out = joined.groupBy(*grid.columns).agg(
        F.count_if(here).alias("retained_frame_count"), effective_rate(F.count_if(here), F.min_by("time_sec", "sel_seq"), F.max_by("time_sec", "sel_seq")).alias("effective_fps"),
        F.avg(fin("roi_shift_fraction")).alias("roi_shift_fraction"), F.count_if(here & checked).alias("auditable_frame_count"),
        F.coalesce(ratio(F.count_if(here & checked), F.count_if(here)), F.lit(0.0)).alias("auditable_frame_fraction"), F.max(shift).alias("max_roi_shift_fraction"),
        F.avg(keep).alias("mean_roi_retention_ratio"), F.min(keep).alias("min_roi_retention_ratio"),
    )
    source = F.max(F.when(F.col("condition") == "original", F.col("retained_frame_count"))).over(Window.partitionBy("subject", "window_id", "roi"))
    return out.withColumn("source_frame_count", source).select(
        *AUDIT_KEY, "degradation_factor", "degradation_severity", "target_fps", "effective_fps", "source_frame_count", "retained_frame_count", "roi_shift_fraction",
        "auditable_frame_count", "auditable_frame_fraction", "max_roi_shift_fraction", "mean_roi_retention_ratio", "min_roi_retention_ratio",
    )


def available() -> F.Column:
    return F.coalesce((F.col("window_status") == "ok") & finite("rppg_hr_bpm"), F.lit(False))


def metrics(df: DataFrame) -> DataFrame:
    """Counts, availability and errors of each condition, method and region, in one grouped pass."""
    ok = F.col("reference_valid") & available()
    e = F.when(ok, F.col("signed_error_bpm"))
    out = df.filter("condition is not null and method is not null and roi is not null").groupBy("condition", "method", "roi").agg(
        F.count_if("reference_valid").alias("n_reference_windows"), F.count_if(ok).alias("n_evaluated_windows"),
        ratio(F.count_if(ok), F.count_if("reference_valid")).alias("availability_rate"), F.avg(F.abs(e)).alias("mae_bpm"), F.sqrt(F.avg(e * e)).alias("rmse_bpm"),
        F.avg(e).alias("bias_bpm"), F.avg((F.abs(e) <= 5.0).cast("double")).alias("within_5_bpm_rate"),
    )
    return out.orderBy("condition", "method", "roi")
