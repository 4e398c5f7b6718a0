"""Candidates measured where a window's frames lie, against the joins and column functions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heartloom import adapters
from heartloom.functions import gathered, kernels
from heartloom.operators import candidates, degrade, windows
from heartloom.schemas import CONDITIONS, METHODS, RATES, ROIS

SF = "/root/testdata/sf0.001"


def test_frames_are_shuffled_once(spark):
    """To their window; the windows are broadcast, and picked conditions make no rows."""
    refs = candidates.reference_windows(adapters.contact_samples(spark, SF)).persist()
    frames = degrade.source_traces(adapters.colour_traces(spark, SF))
    found = candidates.candidates(refs, frames, ["original", "fps15", "fps10"], RATES)
    plan = found._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert plan.count("hashpartitioning") == 1 and "SortMergeJoin" not in plan
    assert found.count() == refs.count() * 3 * len(ROIS) * len(METHODS)


def recordings(spark):
    """Two subjects of 25 and 12 s: jittered times, frames that come twice or in one region only, gaps, missing colours and
    invalid frames; the second has no frames in its last window."""
    rng = np.random.default_rng(5)
    rows = []
    for s, seconds, bpm in (("a", 25, 80), ("b", 12, 100)):
        for condition, noise in (("original", 0.0), ("roi_shift_3", 1e-3)):
            t = np.sort(np.arange(seconds * 30) / 30 + rng.uniform(0, 0.02, seconds * 30))
            p = np.sin(2 * np.pi * bpm / 60 * t)
            for k, roi in enumerate(ROIS):
                for i in range(len(t)):
                    if rng.random() < 0.01 * k or (k == 2 and 400 < i < 430) or (s == "b" and t[i] >= 10):
                        continue
                    r, g, b = (float(c * (1 + a * p[i] + noise * rng.normal())) for c, a in ((180, 0.003), (140, 0.010), (120, 0.005)))
                    row = (s, condition, roi, i, float(t[i]), r if rng.random() < 0.98 else None, g, float("nan") if rng.random() < 0.01 else b, bool(rng.random() < (0.75 if s == "b" and k == 1 else 0.97)), float(rng.uniform(90, 110)) if rng.random() < 0.9 else None)
                    rows += [row] * (2 if k == 1 and condition == "original" and i == 77 else 1)
    held = spark.createDataFrame(pd.DataFrame(rows, columns=["subject", "condition", "roi", "frame_idx", "time_sec", "r", "g", "b", "valid", "brightness"]).astype({"brightness": float, "r": float}))
    light = F.col("brightness")
    return held.withColumns({"sel_seq": F.col("frame_idx"), "overexposure_ratio": light / 100, "face_area_ratio": light / 200, "face_center_shift": light / 300, "face_area_change": light / 400})


@pytest.mark.parametrize("chunk", [1, 10**6])
@pytest.mark.parametrize("few", [0, 10**6])
def test_measures_equal_those_of_joins(spark, monkeypatch, chunk, few):
    monkeypatch.setattr(candidates, "FEW", few)
    monkeypatch.setattr(gathered, "CHUNK", chunk)
    frames = recordings(spark)
    refs = spark.createDataFrame([("a", 1, 0.0, 10.0), ("a", 2, 10.0, 20.0), ("b", 1, 0.0, 10.0), ("b", 2, 10.0, 20.0), ("c", 1, 0.0, 10.0)], "subject string, window_id long, start_time_sec double, end_time_sec double")
    refs = refs.withColumns({"duration_sec": F.lit(10.0), "reference_hr_bpm": F.lit(80.0), "reference_valid": F.lit(True)})
    original = frames.filter("condition = 'original'")
    kept = degrade.downsample_all(refs, original.select("subject", "frame_idx", "time_sec").distinct(), RATES)
    picked = original.drop("condition", "sel_seq").join(kept.drop("time_sec", "window_id"), ["subject", "frame_idx"])
    grid = refs.crossJoin(spark.createDataFrame([(c[0],) for c in CONDITIONS], "condition string")).crossJoin(spark.createDataFrame([(r,) for r in ROIS], "roi string"))
    q = windows.window_quality(grid, frames.unionByName(picked.select(*frames.columns)), ["subject", "condition", "roi"])
    q = q.withColumn("x", kernels.both_rates("window_status", "sample_rate_hz", "samples.time_sec", "samples.r", "samples.g", "samples.b"))
    keys = ["subject", "window_id", "condition", "roi"]
    own = ["n_frames", "window_status", "sample_rate_hz", "valid_frame_fraction", "max_missing_gap_sec", "brightness_std", *(f"mean_{c}" for c in gathered.MEANS)]
    want = q.select(*keys, *own, "x.*").toPandas().sort_values(keys, ignore_index=True)
    got = candidates.candidates(refs, frames, picked=RATES).toPandas()
    assert len(want) == 75 and len(got) == 150 and len(set(want.window_status)) == 4
    for method in METHODS:
        some = got[got.method == method].sort_values(keys, ignore_index=True)
        some = some.rename(columns={c: f"{method.lower()}_{c}" for c in kernels.RATE.names})
        cols = own + [f"{method.lower()}_{c}" for c in kernels.RATE.names]
        pd.testing.assert_frame_equal(some[keys + cols], want[keys + cols], check_dtype=False, rtol=1e-9)


def test_many_contact_signals_are_filtered_together(monkeypatch):
    from heartloom.functions import dsp

    calls, own = [], dsp.bandpass
    monkeypatch.setattr(dsp, "bandpass", lambda *a, **k: calls.append(len(a[0])) or own(*a, **k))
    t = np.arange(300) / 30
    signals = [np.sin(2 * np.pi * bpm / 60 * t) for bpm in range(50, 90)] + [np.zeros(2)]
    got = dsp.contact_rates([t] * 40 + [t[:2]], signals)
    assert calls == [40] and np.isnan(got[40]).all()
    assert np.abs(got[:40] - np.arange(50, 90)[:, None]).max() < 0.5
    alone = np.array([dsp.contact_rate(t, x) for x in signals[:40]])
    assert np.allclose(got[:40], alone, rtol=1e-12)
