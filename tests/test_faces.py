import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heartloom.missing import ContractError
from heartloom.operators import degrade, faces
from heartloom.plans import jobs
from heartloom.schemas import ROIS
from heartloom.sources import sinks, tables


def test_landmarks_reach_the_frames_last_pixel(spark):
    marks = spark.createDataFrame([("s", 0, i, v, v) for i, v in enumerate((0.0, 0.5, 1.0))], "subject string, frame_idx long, landmark_id int, x double, y double")
    frames = spark.createDataFrame([("s", 0, 0.0, 101, 81), ("s", 1, 0.1, 101, 81)], "subject string, frame_idx long, time_sec double, width int, height int")
    assert [(r.x, r.y) for r in faces.landmark_pixels(marks, frames).orderBy("landmark_id").collect()] == [(0, 0), (50, 40), (100, 80)]
    got = {r.frame_idx: r for r in faces.face_geometry(frames, marks).collect()}
    assert got[0].face_width_px == 100 and got[0].face_area_ratio == pytest.approx(8000 / 8181) and got[0].face_center_shift == 0
    assert not got[1].landmark_valid and got[1].face_width_px is None and got[1].face_area_change is None
    assert faces.first_frames(frames, 1).count() == 1 and faces.first_frames(frames, None).count() == 2


FRAMES = "subject string, frame_idx long, time_sec double, width int, height int, raster binary, landmarks array<double>, regions array<struct<roi: string, runs: array<int>>>, present array<int>"


def frame(i, shape, colour=(40, 80, 255), marks=None, regions=None, present=None):
    raster = np.full((*shape, 3), colour, np.uint8).tobytes()
    return ("s", i, i / 10, shape[1], shape[0], raster, marks, [(roi, list(r)) for roi, r in regions.items()] if regions is not None else None, present)


def test_regions_move_as_one_and_are_clipped(spark):
    regions = {"full_face_inner": (2, 2, 3), "forehead": (4, 5, 6), "cheeks_mean": (0, 7, 8)}
    df = spark.createDataFrame([frame(0, (8, 8), regions=regions), frame(1, (8, 8), regions={"forehead": (4, 5, 6)}, present=[3, 0, 7])], FRAMES)
    got = {(r.frame_idx, r.roi): (r.n_pixels, r.retention_ratio) for r in faces.moved_regions(df, 2.0, -1.0).collect()}
    assert got == {(0, "full_face_inner"): (1, 0.0), (0, "forehead"): (1, 0.0), (0, "cheeks_mean"): (0, 0.0), (1, "forehead"): (0, 0.0)}


def test_masks_of_pixels_become_runs(spark):
    masks = spark.createDataFrame([("s", 0, "forehead", x, y) for x, y in ((3, 1), (4, 1), (6, 1), (0, 2))], "subject string, frame_idx long, roi string, x long, y long")
    (r,) = faces.encoded(masks).collect()
    assert r.regions[0].roi == "forehead" and sorted(zip(*[iter(r.regions[0].runs)] * 3)) == [(1, 3, 5), (1, 6, 7), (2, 0, 1)]


def test_traces_of_two_shifts_in_one_plan(spark):
    square = [v for y in range(30, 40) for v in (y, 30, 40)]
    regions = {ROIS[0]: square, ROIS[1]: square, ROIS[2]: (50, 0, 20)}
    df = spark.createDataFrame([frame(i, (100, 100), marks=None if i == 1 else [0.2, 0.2, 0.8, 0.8], regions=regions) for i in range(3)], FRAMES)
    got = {(r.frame_idx, r.roi, r.roi_shift_fraction): r for r in faces.frame_traces(df, [0.0, 0.05]).collect()}
    assert len(got) == 3 * 3 * 2
    still, moved = got[2, "forehead", 0.0], got[2, "forehead", 0.05]
    assert (still.r, still.g, still.b, still.n_pixels, still.valid, still.retention_ratio, still.overexposure_ratio) == (40, 80, 255, 100, True, 1.0, 1.0)
    assert still.brightness == pytest.approx(0.299 * 40 + 0.587 * 80 + 0.114 * 255)
    dx = math.sin(2 * math.pi * 0.2 / 10) * 59.4 * 0.05
    assert moved.roi_shift_x_px == pytest.approx(dx) and moved.retention_ratio == pytest.approx((10 - math.floor(dx + 0.5)) * (10 - math.floor(moved.roi_shift_y_px + 0.5)) / 100)
    few, none = got[0, "cheeks_mean", 0.0], got[1, "forehead", 0.0]
    assert few.n_pixels == 20 and not few.valid and few.r is None and none.n_pixels == 0 and not none.valid and none.roi_shift_x_px is None
    assert not none.landmark_valid and none.face_width_px is None and none.face_center_shift is None and still.face_center_shift == 0


def trace(spark, shift=0.0):
    p = F.sin(2 * math.pi * 1.2 * F.col("time_sec"))
    rows = spark.range(300).select(F.lit("subject1").alias("subject"), F.col("id").alias("frame_idx"), (F.col("id") / 30).alias("time_sec")).withColumn("roi", F.explode(F.array(*map(F.lit, ROIS))))
    x, y = degrade.drift(F.col("time_sec"), F.lit(200.0), shift)
    return rows.withColumns({
        "landmark_valid": F.lit(True), "face_width_px": F.lit(200.0), "face_area_ratio": F.lit(0.1), "face_center_shift": F.lit(0.001), "face_area_change": F.lit(0.002), "roi_shift_fraction": F.lit(shift),
        "roi_shift_x_px": x, "roi_shift_y_px": y, "r": 180 * (1 + 0.003 * p), "g": 140 * (1 + 0.010 * p), "b": 120 * (1 + 0.005 * p), "n_pixels": F.lit(1000).cast("long"),
        "brightness": F.lit(140.0), "overexposure_ratio": F.lit(0.0), "valid": F.lit(True), "retention_ratio": F.lit(1.0 - shift),
    })


def test_formal_run_from_folders_records_its_inputs(spark, tmp_path):
    data, base = tmp_path / "data", tmp_path / "base"
    (data / "subject1").mkdir(parents=True)
    (base / "traces").mkdir(parents=True)
    for name in ("vid.avi", "ground_truth.txt"):
        (data / "subject1" / name).touch()
    shifted = str(tmp_path / "shifted.parquet")
    trace(spark, 0.03).withColumn("condition", F.lit("roi_shift_3")).unionByName(trace(spark, 0.05).withColumn("condition", F.lit("roi_shift_5"))).write.parquet(shifted)
    run = lambda name: jobs.formal_run_from_folders(spark, str(data), str(tmp_path / "model"), str(base), shifted, str(tmp_path / name), 1, 1)
    said = lambda name: sinks.read_json(spark, f"{tmp_path}/{name}/run_manifest.json")

    with pytest.raises(ContractError, match="face model"):
        run("no_model")
    assert said("no_model")["status"] == "failed" and said("no_model")["inputs"]["dataset"]["subject_count"] == 1
    (tmp_path / "model").write_bytes(b"model")
    with pytest.raises(ContractError, match="reference table"):
        run("no_references")
    refs = spark.createDataFrame([("subject1", 1, 0.0, 10.0, 5.0, 10.0, 300, 30.0, 72.0, 72.0, 72.0, 0.0, 72.0, 0.0, True)], tables.REFERENCE_WINDOWS)
    refs.toPandas().to_csv(base / "reference_windows.csv", index=False)
    with pytest.raises(ContractError, match="trace is missing"):
        run("no_trace")
    tables.trace_wide(trace(spark)).drop("subject").toPandas()[[c.split()[0] for c in tables.WIDE_TRACE.split(", ")]].sort_values("frame_idx").to_csv(base / "traces" / "subject1.csv", index=False)
    done = run("done")
    assert done["summary"]["candidate_count"] == 30 and done["summary"]["candidate_status_counts"] == {"ok": 30}
    facts = said("done")
    assert facts["inputs"]["model"] == {"path": str(tmp_path / "model"), "size_bytes": 5, "sha256": hashlib.sha256(b"model").hexdigest()}
    assert facts["inputs"]["baseline"]["reference_sha256"] == hashlib.sha256((base / "reference_windows.csv").read_bytes()).hexdigest()
    assert set(facts["output_files"]) == {"degradation_candidates.parquet", "condition_audit.csv"} and facts["environment"]["spark"] == spark.version
    assert "operators/degrade.py" in facts["code"]["source_sha256"] and "commit" in facts["code"]
    (data / "subject2").mkdir()
    for name in ("vid.avi", "ground_truth.txt"):
        (data / "subject2" / name).touch()
    with pytest.raises(ContractError, match="subjects"):
        run("two")


def test_baseline_job_of_one_subject(spark, tmp_path):
    t = F.col("id") / 30.0
    samples = spark.range(900).select(F.explode(F.array(F.lit("subject1"), F.lit("subject2"))).alias("subject"), F.col("id").alias("i"), t.alias("time_sec"), F.sin(2 * math.pi * 1.2 * t).alias("ppg"), F.lit(72.0).alias("sensor_hr"))
    got = jobs.baseline(samples, trace(spark).withColumn("sel_seq", F.col("frame_idx")), f"{tmp_path}/out", ["subject1"])
    assert got == {"subjects": 1, "reference_windows": 3, "candidates": 18}
    read = tables.read_references(spark, f"{tmp_path}/out/reference_windows.csv")
    assert read.count() == 3 and spark.read.parquet(f"{tmp_path}/out/traces.parquet").count() == 900
