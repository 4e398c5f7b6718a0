import math
import random

import pytest
from pyspark.sql import functions as F

from heartloom.missing import ContractError, fin, require_same_keys, require_unique
from heartloom.operators import degrade, windows


def samples(spark, n, fs=30.0, start=0.0, subject="subject1"):
    return spark.range(n).select(F.lit(subject).alias("subject"), F.col("id").alias("i"), (F.col("id") / fs + start).alias("time_sec"), F.lit(1.0).alias("ppg"), F.lit(72.0).alias("sensor_hr"))


def test_tumbling_windows_are_anchored_and_drop_the_tail(spark):
    got = windows.tumbling_windows(samples(spark, 30 * 25, start=3.2)).orderBy("window_id").collect()
    assert [(r.window_id, round(r.start_time_sec, 6), round(r.end_time_sec, 6)) for r in got] == [(1, 3.2, 13.2), (2, 13.2, 23.2)]
    assert windows.tumbling_windows(samples(spark, 30)).count() == 0


def test_too_few_samples_raise(spark):
    with pytest.raises(Exception, match="fewer than three"):
        windows.tumbling_windows(samples(spark, 2)).collect()


def test_range_join_is_half_open_and_keeps_empty_windows(spark):
    w = spark.createDataFrame([("s", 1, 0.0, 10.0), ("s", 2, 10.0, 20.0), ("s", 3, 50.0, 60.0)], "subject string, window_id long, start_time_sec double, end_time_sec double")
    rows = spark.createDataFrame([("s", 0.0), ("s", 9.999), ("s", 10.0), ("t", 5.0)], "subject string, time_sec double")
    got = windows.in_windows(w, rows, ["subject"]).groupBy("window_id").agg(F.count("time_sec").alias("n")).collect()
    assert {r.window_id: r.n for r in got} == {1: 2, 2: 1, 3: 0}


def test_fin_and_contracts(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r[0] for r in df.select(fin("x")).collect()] == [1.0, None, None, None]
    with pytest.raises(ContractError, match="repeated"):
        require_unique(df.union(df), ["x"], "t")
    with pytest.raises(ContractError, match="1 only on the left"):
        require_same_keys(spark.range(2), spark.range(1), ["id"], "t")


def test_sensor_wrap(spark):
    df = spark.createDataFrame([(2.0,), (41.9,), (42.0,), (0.0,), (None,)], "h double")
    assert [r[0] for r in df.select(windows.sensor_corrected(F.col("h"))).collect()] == [130.0, 169.9, 42.0, 0.0, None]


def greedy(times, start, end, fps):
    left, out = list(enumerate(times)), []
    for k in range(int(round((end - start) * fps))):
        if not left:
            break
        best = min(left, key=lambda x: (abs(x[1] - (start + k / fps)), x[0]))
        left.remove(best)
        out.append(best[0])
    return out


@pytest.mark.parametrize(("n", "fs", "fps", "end"), [(30, 30.0, 15.0, 1.0), (30, 30.0, 10.0, 1.0), (240, 23.976, 15.0, 10.0), (5, 10.0, 10.0, 1.0), (0, 30.0, 15.0, 1.0)])
def test_frames_are_picked_greedily(spark, n, fs, fps, end):
    times = [i / fs for i in range(n)]
    df = spark.createDataFrame([(times,)], "t array<double>")
    got = df.select(degrade.pick_frames(F.col("t"), F.lit(0.0), F.lit(end), F.lit(fps)).alias("x")).first().x
    assert got == greedy(times, 0.0, end, fps)


def test_jittery_frames_follow_the_order_of_picking(spark):
    times = [0.0, 0.31, 0.05, 0.9, 0.42, 0.41]
    df = spark.createDataFrame([(times,)], "t array<double>")
    got = df.select(degrade.pick_frames(F.col("t"), F.lit(0.0), F.lit(1.0), F.lit(10.0)).alias("x")).first().x
    assert got == greedy(times, 0.0, 1.0, 10.0)


def test_drift_is_periodic_and_as_wide_as_told(spark):
    x, y = degrade.drift(F.col("t"), F.lit(200.0), 0.05)
    got = spark.range(301).select((F.col("id") / 30).alias("t")).select(x.alias("x"), y.alias("y")).collect()
    radius = [math.hypot(r.x, r.y) / 200 for r in got]
    assert 0.0499 <= max(radius) <= 0.05 + 1e-9
    assert abs(got[0].x - got[-1].x) < 1e-9


def test_quality_gates(spark):
    w = spark.createDataFrame([("s", k, 0.0, 10.0, r) for k, r in ((1, "a"), (1, "b"), (1, "c"))], "subject string, window_id long, start_time_sec double, end_time_sec double, roi string")
    t = spark.range(300).select(F.lit("s").alias("subject"), F.col("id").alias("sel_seq"), (F.col("id") / 30).alias("time_sec"))
    valid = F.when(F.col("roi") == "b", ~((F.col("time_sec") >= 3) & (F.col("time_sec") < 4))).when(F.col("roi") == "c", F.lit(False)).otherwise(F.lit(True))
    one = F.lit(1.0)
    f = t.crossJoin(w.select("roi")).withColumns({"valid": valid, **{c: one for c in ("r", "g", "b", "brightness", "overexposure_ratio", "face_area_ratio", "face_center_shift", "face_area_change")}})
    got = {r.roi: r for r in windows.window_quality(w, f, ["subject", "roi"]).collect()}
    assert {k: r.window_status for k, r in got.items()} == {"a": "ok", "b": "long_missing_gap", "c": "low_valid_fraction"}
    assert got["c"].max_missing_gap_sec == 10.0 and got["a"].n_frames == 300
    assert got["b"].max_missing_gap_sec == pytest.approx(1.0 + 1 / 30)


def test_random_picks_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for c in range(200):
        times = [rng.choice([round(rng.uniform(0, 3), 2), rng.randint(0, 12) / 4]) for _ in range(rng.randint(0, 30))]
        rows.append((c, sorted(times) if c % 2 else times, float(rng.randint(1, 3)), float(rng.choice([1, 2, 4, 5, 10]))))
    df = spark.createDataFrame(rows, "c int, t array<double>, e double, f double")
    got = {r.c: r.x for r in df.select("c", degrade.pick_frames(F.col("t"), F.lit(0.0), F.col("e"), F.col("f")).alias("x")).collect()}
    assert got == {c: greedy(t, 0.0, e, f) for c, t, e, f in rows}


def test_carries_cross_stretches(spark):
    rng = random.Random(4)
    rows = [(s, i, rng.random() if rng.random() < 0.2 and not 30 <= i < 75 else None) for s in "ab" for i in range(100)] + [("c", i, None) for i in range(9)]
    df = spark.createDataFrame(rows, "s string, i long, v double")
    for ahead in (False, True):
        got = {(r.s, r.i): r.w for r in windows.carried(df, ["s"], "i", 7, F.col("v"), "w", ahead).collect()}
        assert len(got) == len(rows)
        for s in "abc":
            last = None
            for _, i, v in sorted((r for r in rows if r[0] == s), key=lambda r: -r[1] if ahead else r[1]):
                assert got[s, i] == last
                last = last if v is None else v
    filled = {span: sorted((r.s, r.i, r.filled) for r in windows.fill_linear(df.withColumn("g", F.col("v").isNotNull()), ["s"], "i", "v", "g", span).collect()) for span in (3.0, 1000.0)}
    assert filled[3.0] == filled[1000.0] and all(f is None for s, _, f in filled[3.0] if s == "c") and all(f is not None for s, _, f in filled[3.0] if s != "c")


def test_a_window_join_is_one_join(spark):
    w = spark.createDataFrame([("s", k, 10.0 * k, 10.0 * k + 10) for k in range(4)], "subject string, window_id long, start_time_sec double, end_time_sec double")
    r = spark.range(25).select(F.lit("s").alias("subject"), (F.col("id") * 0.5 + 3).alias("time_sec"))
    joined = windows.window_rows(w, r, ["subject"])
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert {x.window_id: x.n for x in joined.groupBy("window_id").agg(F.count("time_sec").alias("n")).collect()} == {0: 14, 1: 11, 2: 0, 3: 0}
    assert sorted((x.window_id, x.n) for x in windows.in_windows(w, r, ["subject"]).groupBy("window_id").agg(F.count("*").alias("n")).collect()) == [(0, 14), (1, 11), (2, 1), (3, 1)]
