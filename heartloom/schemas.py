"""Table schemas, keys and protocol constants. Missing values are NULL throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REFERENCE_WINDOWS = (
    "subject string, window_id bigint, start_time_sec double, end_time_sec double, window_center_time_sec double, duration_sec double, n_samples bigint, "
    "sample_rate_hz double, reference_hr_bpm double, time_hr_bpm double, frequency_hr_bpm double, time_frequency_diff_bpm double, sensor_hr_bpm double, "
    "reference_sensor_diff_bpm double, reference_valid boolean"
)
FRAME_COLUMNS = (
    "frame_idx bigint, time_sec double, landmark_valid boolean, face_width_px double, face_area_ratio double, face_center_shift double, face_area_change double, "
    "roi_shift_fraction double, roi_shift_x_px double, roi_shift_y_px double"
)
#: Columns that each region has in the wide form, with their types.
ROI_COLUMNS = {"r_mean": "double", "g_mean": "double", "b_mean": "double", "n_pixels": "bigint", "brightness": "double", "overexposure_ratio": "double", "valid": "boolean", "retention_ratio": "double"}
ROIS = ("full_face_inner", "forehead", "cheeks_mean")
METHODS = ("POS", "CHROM")
#: condition, order, degradation factor, severity, target frames a second.
CONDITIONS = (
    ("original", 0, "none", 0.0, None), ("fps15", 1, "fps", 15.0, 15.0), ("fps10", 2, "fps", 10.0, 10.0),
    ("roi_shift_3", 3, "roi_shift", 0.03, None), ("roi_shift_5", 4, "roi_shift", 0.05, None),
)
#: Conditions that are picked from the original's frames, and their frames a second.
RATES = {name: fps for name, *_, fps in CONDITIONS if fps}
STATUSES = ("ok", "low_video_coverage", "low_valid_fraction", "long_missing_gap")
#: Long traces: a row for each frame and region.
TRACE_LONG = f"subject string, {FRAME_COLUMNS}, roi string, r double, g double, b double, n_pixels bigint, brightness double, overexposure_ratio double, valid boolean, retention_ratio double, sel_seq bigint"
WIDE_TRACE = FRAME_COLUMNS + "".join(f", {roi}_{c} {t}" for roi in ROIS for c, t in ROI_COLUMNS.items())
CANDIDATES = (
    "subject string, condition string, window_id bigint, start_time_sec double, end_time_sec double, duration_sec double, roi string, method string, "
    "reference_hr_bpm double, reference_valid boolean, window_status string, sample_rate_hz double, n_frames bigint, valid_frame_fraction double, "
    "max_missing_gap_sec double, mean_face_area_ratio double, mean_face_center_shift double, mean_face_area_change double, mean_brightness double, "
    "brightness_std double, mean_overexposure_ratio double, rppg_hr_bpm double, spectral_peak_fraction double, spectral_entropy double, rppg_signal_std double, "
    "signed_error_bpm double, absolute_error_bpm double, pos_chrom_diff_bpm double"
)
CANDIDATE_KEY = ["subject", "condition", "window_id", "roi", "method"]
AUDIT_KEY = ["subject", "condition", "window_id", "roi"]
PAIR_KEY = ["subject", "window_id", "roi", "method"]
QUALITY = ("valid_frame_fraction", "max_missing_gap_sec", "mean_brightness", "brightness_std", "mean_overexposure_ratio", "spectral_peak_fraction", "spectral_entropy", "pos_chrom_diff_bpm")
WINDOW_SEC = 10.0
BAND_HZ = (0.7, 4.0)
REPLICATES, SEED = 10_000, 20260815
FOLDS = 5
COVERAGES = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5)


def condition_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CONDITIONS), "condition string, condition_order int, degradation_factor string, degradation_severity double, target_fps double")


def roi_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, i) for i, r in enumerate(ROIS)], "roi string, roi_order int")


def method_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, i) for i, m in enumerate(METHODS)], "method string, method_order int")
