import hashlib
import math

import pytest
from pyspark.sql import functions as F

from heartloom.missing import ContractError
from heartloom.operators import candidates, degrade, validate
from heartloom.plans import jobs
from heartloom.sources import sinks, tables


def trace(spark, subjects=("subject1",), seconds=10, fs=30, bpm=72.0, shift=0.0):
    p, m = F.sin(2 * math.pi * bpm / 60 * F.col("time_sec")), F.sin(2 * math.pi * 0.15 * F.col("time_sec")) * 0.004
    rows = spark.range(int(seconds * fs)).select(F.col("id").alias("frame_idx"), (F.col("id") / fs).alias("time_sec"))
    rows = rows.crossJoin(spark.createDataFrame([(s,) for s in subjects], "subject string")).crossJoin(spark.createDataFrame([("full_face_inner",), ("forehead",), ("cheeks_mean",)], "roi string"))
    x, y = degrade.drift(F.col("time_sec"), F.lit(200.0), shift)
    return rows.withColumns({
        "landmark_valid": F.lit(True), "face_width_px": F.lit(200.0), "face_area_ratio": F.lit(0.1), "face_center_shift": F.lit(0.001), "face_area_change": F.lit(0.002), "roi_shift_fraction": F.lit(shift),
        "roi_shift_x_px": x, "roi_shift_y_px": y, "r": 180 * (1 + 0.003 * p + m), "g": 140 * (1 + 0.010 * p + m), "b": 120 * (1 + 0.005 * p + m), "n_pixels": F.lit(1000).cast("long"),
        "brightness": F.lit(140.0), "overexposure_ratio": F.lit(0.0), "valid": F.lit(True), "retention_ratio": F.lit(1.0 - shift), "sel_seq": F.col("frame_idx"),
    })


def references(spark, subjects=("subject1",)):
    return spark.createDataFrame([(s, 1, 0.0, 10.0, 5.0, 10.0, 300, 30.0, 72.0, 72.0, 72.0, 0.0, 72.0, 0.0, True) for s in subjects], tables.REFERENCE_WINDOWS)


def test_formal_run_and_its_manifest(spark, tmp_path):
    refs, original = references(spark), trace(spark)
    shifted = trace(spark, shift=0.03).withColumn("condition", F.lit("roi_shift_3")).unionByName(trace(spark, shift=0.05).withColumn("condition", F.lit("roi_shift_5")))
    out = f"{tmp_path}/run"
    manifest = jobs.formal_run(spark, refs, original, shifted, out, 1, 1)
    assert manifest["summary"]["candidate_count"] == 30 and manifest["summary"]["condition_audit_count"] == 15
    assert manifest["summary"]["candidate_status_counts"] == {"ok": 30}
    assert sinks.read_json(spark, f"{out}/run_manifest.json")["status"] == "completed"
    found = spark.read.parquet(f"{out}/degradation_candidates.parquet")
    assert found.filter("absolute_error_bpm < 0.5").count() == 30
    audit = {(r.condition, r.roi): r for r in spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/condition_audit.csv").collect()}
    assert audit["fps15", "forehead"].retained_frame_count == 150 and audit["roi_shift_5", "forehead"].max_roi_shift_fraction == pytest.approx(0.05, abs=1e-3)
    with pytest.raises(FileExistsError):
        jobs.formal_run(spark, refs, original, shifted, out, 1, 1)
    with pytest.raises(ContractError, match="protocol"):
        jobs.formal_run(spark, refs, original, shifted, f"{tmp_path}/bad", 42, 248)
    assert sinks.read_json(spark, f"{tmp_path}/bad/run_manifest.json")["error"]["type"] == "ContractError"
    for broken, message in ((found.withColumn("window_status", F.lit("low_valid_fraction")), "status"), (found.withColumn("roi", F.lit("nose")), "keys|grid"), (found.withColumn("signed_error_bpm", F.lit(9.0)), "errors")):
        with pytest.raises(ContractError, match=message):
            validate.validate(refs, broken, candidates.condition_audit(refs, degrade.condition_traces(refs, original, shifted)))


def test_empty_windows_keep_their_rows(spark):
    refs = references(spark).withColumns({"start_time_sec": F.lit(10.0), "end_time_sec": F.lit(20.0)})
    got = candidates.candidates(refs, trace(spark, seconds=1).withColumn("condition", F.lit("original")), ["original"]).collect()
    assert len(got) == 6 and {r.window_status for r in got} == {"low_video_coverage"}
    assert {r.n_frames for r in got} == {0} and all(r.sample_rate_hz is None and r.rppg_hr_bpm is None for r in got)


def test_references_from_contact_samples(spark):
    t = F.col("id") / 30.0
    s = spark.range(900).select(F.lit("subject1").alias("subject"), F.col("id").alias("i"), t.alias("time_sec"), F.sin(2 * math.pi * 1.2 * t).alias("ppg"), F.lit(120.0).alias("sensor_hr"))
    got = candidates.reference_windows(s).orderBy("window_id").collect()
    assert [r.start_time_sec for r in got] == [0.0, 10.0, 20.0]
    assert all(r.reference_valid and abs(r.time_hr_bpm - 72) < 0.5 and abs(r.frequency_hr_bpm - 72) < 0.5 and r.sensor_hr_bpm == 120 for r in got)


def test_files_on_disk(spark, tmp_path):
    for n in (10, 2, 1):
        folder = tmp_path / f"subject{n}"
        folder.mkdir()
        (folder / "vid.avi").write_bytes(b"")
        (folder / "ground_truth.txt").write_text("0.1 0.2 0.3\n\n72 73 74\n0.0 0.5 1.0\n")
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "vid.avi").write_bytes(b"")
    got = tables.discover_subjects(spark, str(tmp_path)).collect()
    assert [r.subject for r in got] == ["subject1", "subject2", "subject10"]
    truth = tables.load_ground_truth(spark, [r.ground_truth_path for r in got]).collect()
    assert {tuple(r.sensor_hr) for r in truth} == {(72.0, 73.0, 74.0)}
    (tmp_path / "bad.txt").write_text("0.1 0.2\n72\n0.0 0.5\n")
    with pytest.raises(Exception, match="equal lengths"):
        tables.load_ground_truth(spark, str(tmp_path / "bad.txt")).collect()
    assert tables.file_sha256(spark, str(tmp_path / "bad.txt")).first().sha256 == hashlib.sha256(b"0.1 0.2\n72\n0.0 0.5\n").hexdigest()


def test_traces_turn_long_and_wide(spark, tmp_path):
    long = trace(spark, seconds=1).drop("sel_seq")
    wide = tables.trace_wide(long)
    assert wide.count() == 30 and len(wide.columns) == 35
    sinks.write_csv(wide.drop("subject"), f"{tmp_path}/t")
    back = tables.trace_long(wide)
    assert back.select(*long.columns).exceptAll(long).count() == 0
