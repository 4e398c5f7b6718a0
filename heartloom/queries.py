"""A query for each operator over the driver tables, and the SQL that its result is held against."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heartloom import adapters
from heartloom.adapters import DUCK_MICROS, FEATURES, OFF_GRID, RECORDING, TRACE
from heartloom.operators import bootstrap, candidates, degrade, faces, ranking, reliability, validate, windows
from heartloom.schemas import QUALITY, RATES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

C = f"WITH c AS MATERIALIZED ({FEATURES})"
T = f"WITH t AS MATERIALIZED ({TRACE.replace('{micros}', DUCK_MICROS)})"
OK = "window_status = 'ok' AND rppg_hr_bpm IS NOT NULL"
ROIS, METHODS = "('full_face_inner', 'forehead', 'cheeks_mean')", "('POS', 'CHROM')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded, so that the order of summation doesn't show; counts as 64-bit numbers."""
    kinds = {"double": lambda c: (F.round(F.col(c), digits) + 0.0), "int": lambda c: F.col(c).cast("bigint")}
    return df.select(*(kinds[t](c).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes))


@query(f"""{C} SELECT condition, method, roi, count(*) FILTER (reference_valid)::BIGINT AS n_reference_windows, count(*) FILTER (reference_valid AND {OK})::BIGINT AS n_evaluated_windows,
round(count(*) FILTER (reference_valid AND {OK}) / nullif(count(*) FILTER (reference_valid), 0)::DOUBLE, 6) AS availability_rate, round(avg(abs(signed_error_bpm)) FILTER (reference_valid AND {OK}), 6) AS mae_bpm,
round(sqrt(avg(signed_error_bpm * signed_error_bpm) FILTER (reference_valid AND {OK})), 6) AS rmse_bpm, round(avg(signed_error_bpm) FILTER (reference_valid AND {OK}), 6) AS bias_bpm,
round(avg((abs(signed_error_bpm) <= 5)::INT::DOUBLE) FILTER (reference_valid AND {OK}), 6) AS within_5_bpm_rate FROM c GROUP BY ALL""")
def condition_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(candidates.metrics(adapters.candidates(spark, sf_dir)))


@query(f"""{C}, p AS (SELECT subject, condition, window_id, roi, max(rppg_hr_bpm) FILTER (method = 'POS') AS a, max(rppg_hr_bpm) FILTER (method = 'CHROM') AS b FROM c GROUP BY ALL)
SELECT c.subject, c.condition, c.window_id, c.roi, c.method, round(abs(a - b), 6) AS pos_chrom_diff_bpm FROM c JOIN p USING (subject, condition, window_id, roi)""")
def method_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = adapters.candidates(spark, sf_dir).drop("pos_chrom_diff_bpm")
    return rounded(candidates.method_agreement(held).select("subject", "condition", "window_id", "roi", "method", "pos_chrom_diff_bpm"))


PAIRED = f"""{C}, o AS MATERIALIZED (SELECT subject, window_id, roi, method, reference_valid AS v, window_status AS so, rppg_hr_bpm AS ro, signed_error_bpm AS eo FROM c WHERE condition = 'original'),
q AS (SELECT d.condition, subject, window_id, roi, method, v, so, d.window_status AS sd, ro, d.rppg_hr_bpm AS rd, eo, d.signed_error_bpm AS ed FROM c d JOIN o USING (subject, window_id, roi, method) WHERE d.condition <> 'original')"""


@query(f"""WITH c AS (SELECT subject, window_id, roi, method, condition, window_status AS s, round(signed_error_bpm, 6) AS e FROM ({adapters.CANDIDATES}) z), o AS (SELECT subject, window_id, roi, method, s, e FROM c WHERE condition = 'original')
SELECT c.condition, subject, window_id, roi, method, o.s AS window_status_original, c.s AS window_status_degraded, o.e AS signed_error_bpm_original, c.e AS signed_error_bpm_degraded FROM c JOIN o USING (subject, window_id, roi, method) WHERE c.condition <> 'original'""")
def paired_degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = bootstrap.pair(adapters.outcomes(spark, sf_dir), check=False)
    return rounded(held.select("condition", "subject", "window_id", "roi", "method", "window_status_original", "window_status_degraded", "signed_error_bpm_original", "signed_error_bpm_degraded"))


BOTH = "v AND so = 'ok' AND sd = 'ok' AND ro IS NOT NULL AND rd IS NOT NULL"
STATS = PAIRED + f""", s AS (SELECT condition, roi, method, subject, count(*) FILTER ({BOTH})::BIGINT AS paired_n, count(*) FILTER (v)::BIGINT AS reference_n,
{", ".join(f'''coalesce(sum(abs({e})) FILTER ({BOTH}), 0) AS {s}_abs_sum, coalesce(sum({e} * {e}) FILTER ({BOTH}), 0) AS {s}_square_sum, coalesce(sum({e}) FILTER ({BOTH}), 0) AS {s}_error_sum,
count(*) FILTER ({BOTH} AND abs({e}) <= 5)::BIGINT AS {s}_within_5, count(*) FILTER (v AND {st} = 'ok' AND {r} IS NOT NULL)::BIGINT AS {s}_available''' for s, e, st, r in (("original", "eo", "so", "ro"), ("degraded", "ed", "sd", "rd")))}
FROM q GROUP BY ALL)"""


@query(STATS + " SELECT condition, roi, method, subject, paired_n, reference_n, " + ", ".join(f"round({s}_{k}, 6) AS {s}_{k}" if k.endswith("sum") else f"{s}_{k}" for s in ("original", "degraded") for k in ("abs_sum", "square_sum", "error_sum", "within_5", "available")) + " FROM s")
def subject_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bootstrap.subject_statistics(adapters.candidates(spark, sf_dir), check=False))


def _metric_sql(source: str, keys: str) -> str:
    parts = []
    for m, o, d, n, root in bootstrap.METRICS:
        f = (lambda x: f"sqrt({x})") if root else (lambda x: x)
        parts.append(f"SELECT {keys}, '{m}' AS metric, {n}::BIGINT AS n_observations, {f(f'{o} / nullif({n}, 0)::DOUBLE')} AS original_value, {f(f'{d} / nullif({n}, 0)::DOUBLE')} AS degraded_value FROM {source}")
    return " UNION ALL ".join(parts)


SUMS = "sum(paired_n) AS paired_n, sum(reference_n) AS reference_n, " + ", ".join(f"sum({s}_{k})::DOUBLE AS {s}_{k}" for s in ("original", "degraded") for k in ("abs_sum", "square_sum", "error_sum", "within_5", "available"))


@query(f"{STATS}, u AS (SELECT condition, roi, method, count(*)::BIGINT AS n_subjects, {SUMS} FROM s GROUP BY ALL), m AS ({_metric_sql('u', 'condition, roi, method, n_subjects')}) SELECT condition, roi, method, n_subjects, metric, n_observations, round(original_value, 6) AS original_value, round(degraded_value, 6) AS degraded_value, round(degraded_value - original_value, 6) AS delta FROM m")
def observed_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bootstrap.observed(bootstrap.subject_statistics(adapters.candidates(spark, sf_dir), check=False)))


def _weight_digits() -> str:
    """The protocol's weights, a word for each replicate with a character for each of the 42 subjects."""
    return " ".join("".join(chr(48 + w) for w in row) for row in bootstrap.weight_matrix(42).tolist())


MEASURES = ("paired_n", "reference_n", *(f"{s}_{k}" for s in ("original", "degraded") for k in ("abs_sum", "square_sum", "error_sum", "within_5", "available")))


@query(f"""{STATS}, n AS (SELECT subject, row_number() OVER (ORDER BY subject) - 1 AS j FROM (SELECT DISTINCT subject FROM s)), k AS (SELECT * FROM s JOIN n USING (subject)),
r AS MATERIALIZED (SELECT unnest(string_split('{_weight_digits()}', ' ')) AS ws, unnest(range({bootstrap.REPLICATES})) AS rep), w AS MATERIALIZED (SELECT rep, j, ascii(substr(ws, j::INT + 1, 1)) - 48 AS w FROM r, range(42) AS x(j)),
u AS (SELECT condition, roi, method, rep, {", ".join(f"sum({c} * w)::DOUBLE AS {c}" for c in MEASURES)} FROM k JOIN w USING (j) WHERE w > 0 GROUP BY ALL),
m AS ({_metric_sql('u', 'condition, roi, method, rep')})
SELECT condition, roi, method, metric, round(quantile_cont(degraded_value - original_value, 0.025), 6) AS ci_lower, round(quantile_cont(degraded_value - original_value, 0.975), 6) AS ci_upper FROM m GROUP BY ALL""")
def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bootstrap.degradation_bootstrap(adapters.candidates(spark, sf_dir), check=False)
    return rounded(out.select("condition", "roi", "method", "metric", "ci_lower", "ci_upper"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.trace(spark, sf_dir).select("subject", F.col("frame_idx").alias("i"), "time_sec", F.col("value").alias("ppg"), F.col("value").alias("sensor_hr"))


WINDOWS = T + """, d AS (SELECT subject, quantile_cont(step, 0.5) AS dt, min_by(time_sec, frame_idx) AS f, max_by(time_sec, frame_idx) AS l FROM (SELECT *, time_sec - lag(time_sec) OVER (PARTITION BY subject ORDER BY frame_idx) AS step FROM t) GROUP BY subject HAVING count(*) >= 3),
w AS MATERIALIZED (SELECT subject, k + 1 AS window_id, f + k * 10.0::DOUBLE AS start_time_sec, f + k * 10.0::DOUBLE + 10.0::DOUBLE AS end_time_sec, 1 / dt AS rate FROM (SELECT *, unnest(range(0, floor((l + dt - f + dt * 0.1::DOUBLE) / 10)::BIGINT)) AS k FROM d))"""


@query(WINDOWS + " SELECT subject, window_id::BIGINT AS window_id, round(start_time_sec, 6) AS start_time_sec, round(end_time_sec, 6) AS end_time_sec, round(rate, 6) AS sample_rate_hz FROM w")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.tumbling_windows(_samples(spark, sf_dir)))


@query(WINDOWS + " SELECT w.subject, w.window_id::BIGINT AS window_id, count(t.time_sec)::BIGINT AS n, round(sum(t.value), 6) AS total FROM w LEFT JOIN t ON t.subject = w.subject AND t.time_sec >= w.start_time_sec AND t.time_sec < w.end_time_sec GROUP BY ALL")
def window_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = adapters.trace(spark, sf_dir)
    held = windows.tumbling_windows(_samples(spark, sf_dir))
    return rounded(windows.in_windows(held, frames, ["subject"]).groupBy("subject", "window_id").agg(F.count("time_sec").alias("n"), F.sum("value").alias("total")))


@query(WINDOWS + """, j AS (SELECT w.subject, w.window_id, w.start_time_sec AS s, w.end_time_sec AS e, t.frame_idx AS i, t.time_sec AS x, t.value AS v, t.good AS g FROM w LEFT JOIN t ON t.subject = w.subject AND t.time_sec >= w.start_time_sec AND t.time_sec < w.end_time_sec),
q AS (SELECT subject, window_id, s, e, count(x) AS n, count(*) FILTER (g) AS ng, CASE WHEN count(x) >= 2 THEN (count(x) - 1) / nullif(max_by(x, i) - min_by(x, i), 0) END AS rate, avg(v) AS mean_brightness, stddev_pop(v) AS brightness_std, list(x ORDER BY i) FILTER (g) AS gs FROM j GROUP BY ALL),
z AS (SELECT *, list_concat([s], coalesce(gs, []), [e]) AS pts FROM q), y AS (SELECT *, list_max(list_transform(range(2, len(pts) + 1), lambda k: pts[k] - pts[k - 1])) AS gap, coalesce(ng / nullif(n, 0)::DOUBLE, 0) AS vf,
CASE WHEN round_even((e - s) * rate, 0) > 0 THEN least(1, n / round_even((e - s) * rate, 0)) ELSE 0 END AS cov FROM z)
SELECT subject, window_id::BIGINT AS window_id, n::BIGINT AS n_frames, round(rate, 6) AS sample_rate_hz, round(vf, 6) AS valid_frame_fraction, round(gap, 6) AS max_missing_gap_sec, round(mean_brightness, 6) AS mean_brightness, round(brightness_std, 6) AS brightness_std,
CASE WHEN coalesce(cov, 0) < 0.95::DOUBLE THEN 'low_video_coverage' WHEN vf < 0.8::DOUBLE THEN 'low_valid_fraction' WHEN gap > 0.5::DOUBLE THEN 'long_missing_gap' ELSE 'ok' END AS window_status FROM y""")
def window_quality_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    frames = adapters.trace(spark, sf_dir).select("subject", F.col("frame_idx").alias("sel_seq"), "time_sec", F.col("good").alias("valid"), v.alias("r"), v.alias("g"), v.alias("b"), v.alias("brightness"), v.alias("overexposure_ratio"), v.alias("face_area_ratio"), v.alias("face_center_shift"), v.alias("face_area_change"))
    out = windows.window_quality(windows.tumbling_windows(_samples(spark, sf_dir)).drop("sample_rate_hz"), frames, ["subject"])
    return rounded(out.select("subject", "window_id", "n_frames", "sample_rate_hz", "valid_frame_fraction", "max_missing_gap_sec", "mean_brightness", "brightness_std", "window_status"))


@query(T + """, o AS (SELECT subject, frame_idx, sin(2 * pi() * (time_sec % 10) / 10) * value * 0.05::DOUBLE AS x, 0.5::DOUBLE * sin(4 * pi() * (time_sec % 10) / 10) * value * 0.05::DOUBLE AS y, value AS w FROM t)
SELECT subject, count(*)::BIGINT AS frames, round(max(sqrt(x * x + y * y) / nullif(w, 0)), 6) AS max_shift, round(avg(x), 6) AS mean_x FROM o GROUP BY subject""")
def roi_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = degrade.drift(F.col("time_sec"), F.col("value"), 0.05)
    held = adapters.trace(spark, sf_dir).withColumns({"x": x, "y": y})
    return rounded(held.groupBy("subject").agg(F.count("*").alias("frames"), F.max(F.try_divide(F.hypot("x", "y"), F.col("value"))).alias("max_shift"), F.avg("x").alias("mean_x")))


@query(T + """, h AS (SELECT *, last_value(CASE WHEN good THEN value END IGNORE NULLS) OVER (PARTITION BY subject ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM t)
SELECT subject, frame_idx, CASE WHEN good THEN CASE WHEN p IS NULL THEN 0.0::DOUBLE ELSE round(abs(value - p) / nullif(p, 0), 6) END END AS face_area_change FROM h""")
def last_face_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    held = adapters.trace(spark, sf_dir).select("subject", "frame_idx", F.col("good").alias("landmark_valid"), v.alias("cx"), v.alias("cy"), v.alias("face_width_px"), v.alias("face_area_ratio"))
    return rounded(windows.motion_since_face(held).select("subject", "frame_idx", "face_area_change"))


@query(T + """, g AS (SELECT *, last_value(CASE WHEN good THEN time_sec END IGNORE NULLS) OVER b AS t0, last_value(CASE WHEN good THEN value END IGNORE NULLS) OVER b AS v0, first_value(CASE WHEN good THEN time_sec END IGNORE NULLS) OVER a AS t1, first_value(CASE WHEN good THEN value END IGNORE NULLS) OVER a AS v1
FROM t WINDOW b AS (PARTITION BY subject ORDER BY time_sec ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY subject ORDER BY time_sec ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT subject, frame_idx, round(coalesce(v0 + (v1 - v0) * coalesce((time_sec - t0) / nullif(t1 - t0, 0), 0), v0, v1), 5) AS filled FROM g""")
def linear_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.fill_linear(adapters.trace(spark, sf_dir), ["subject"], "time_sec", "value", "good").select("subject", "frame_idx", "filled"), 5)


@query(T + " SELECT subject, round(quantile_cont(CASE WHEN value > 0 AND value < 42 THEN value + 128 ELSE value END, 0.5), 6) AS sensor_hr_bpm FROM t GROUP BY subject")
def sensor_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(adapters.trace(spark, sf_dir).groupBy("subject").agg(F.percentile(windows.sensor_corrected(F.col("value")), 0.5).alias("sensor_hr_bpm")))


PICKS = WINDOWS.replace("WITH t", "WITH RECURSIVE t", 1) + """, g AS MATERIALIZED (SELECT w.subject, w.window_id, any_value(w.start_time_sec) AS s, list({'f': t.frame_idx, 't': t.time_sec} ORDER BY t.frame_idx) AS fs FROM w JOIN t ON t.subject = w.subject AND t.time_sec >= w.start_time_sec AND t.time_sec < w.end_time_sec GROUP BY ALL),
z AS (SELECT subject, window_id, s, fs, 0 AS k, []::BIGINT[] AS taken, NULL::BIGINT AS f FROM g
UNION ALL SELECT subject, window_id, s, fs, k + 1, list_append(taken, b), b FROM (SELECT *, list_sort(list_transform(list_filter(fs, lambda x: NOT list_contains(taken, x.f)), lambda x: {'d': abs(x.t - (s + k / 2.0::DOUBLE)), 'f': x.f}))[1].f AS b FROM z WHERE k < 20 AND len(taken) < len(fs)) q)
SELECT z.subject, z.window_id::BIGINT AS window_id, z.f AS frame_idx, round(t.time_sec, 6) AS time_sec, (z.k - 1)::BIGINT AS sel_seq FROM z JOIN t ON t.subject = z.subject AND t.frame_idx = z.f"""


@query(PICKS)
def downsample_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = windows.tumbling_windows(_samples(spark, sf_dir))
    return rounded(degrade.downsample(held, adapters.trace(spark, sf_dir), 2.0))


E_ = f"{C}, e AS MATERIALIZED (SELECT *, absolute_error_bpm > 5 AS unreliable FROM c WHERE reference_valid AND {OK}), n AS (SELECT subject, (row_number() OVER (ORDER BY substr(subject, 8)::INT, subject) - 1) AS j FROM (SELECT DISTINCT subject FROM e)), f AS MATERIALIZED (SELECT e.*, j, j % 5 AS fold FROM e JOIN n USING (subject))"


def _eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability.eligible(adapters.candidates(spark, sf_dir))


@query(f"{E_} SELECT DISTINCT subject, j::BIGINT AS subject_idx, fold::BIGINT AS fold FROM f")
def subject_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_eligible(spark, sf_dir).select("subject", "subject_idx", "fold").distinct())


@query(f"{E_}, g AS (SELECT fold, bool_or(unreliable) AND bool_or(NOT unreliable) AS b FROM f GROUP BY fold), a AS (SELECT count(*) FILTER (unreliable)::BIGINT AS events, count(DISTINCT subject) FILTER (unreliable)::BIGINT AS affected_subjects FROM f) SELECT events, affected_subjects, (SELECT bool_and(b) FROM g) AS both_classes, CASE WHEN events >= 100 AND affected_subjects >= 10 AND (SELECT bool_and(b) FROM g) THEN 'logistic' ELSE 'ridge' END AS route FROM a")
def route_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability.route_gate(_eligible(spark, sf_dir))


PARAMS = E_ + ", l AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT held, '{q}' AS feature, {q} AS x FROM f, range(5) AS h(held) WHERE held <> fold" for q in QUALITY) + "), md AS (SELECT held, feature, quantile_cont(x, 0.5) AS median FROM l GROUP BY ALL), pr AS (SELECT held, feature, max(median) AS median, avg(coalesce(x, median)) AS mean, stddev_pop(coalesce(x, median)) AS sd FROM l JOIN md USING (held, feature) GROUP BY ALL)"


@query(PARAMS + " SELECT held::BIGINT AS held, feature, round(median, 6) AS median, round(mean, 6) AS mean, round(CASE WHEN sd <= 1e-12 THEN 1 ELSE sd END, 6) AS scale FROM pr")
def fold_feature_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _eligible(spark, sf_dir).groupBy("window_id", "fold", *QUALITY).agg(F.count("*").cast("double").alias("n"))
    return rounded(reliability.fold_parameters(held))


@query(f"{E_}, x AS (SELECT held, [1::DOUBLE, (roi = 'forehead')::INT::DOUBLE, (roi = 'cheeks_mean')::INT::DOUBLE, (method = 'CHROM')::INT::DOUBLE] AS v, absolute_error_bpm AS y FROM f, range(5) AS h(held) WHERE held <> fold) SELECT held::BIGINT AS held, i::BIGINT AS i, j::BIGINT AS j, round(sum(v[i + 1] * v[j + 1]), 4) AS value FROM x, range(4) a(i), range(4) b(j) WHERE j >= i GROUP BY ALL UNION ALL SELECT held::BIGINT, i::BIGINT, -1::BIGINT, round(sum(v[i + 1] * y), 4) FROM x, range(4) a(i) GROUP BY ALL")
def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reliability.gram_matrix(_eligible(spark, sf_dir), "baseline"), 4)


def _ridge_sql() -> str:
    """Out-of-fold ridge predictions by normal equations: Gram sums by fold, solved by elimination, one column a step."""
    features = "".join(f", (coalesce({q}, {q}_md) - {q}_mn) / {q}_sc AS x{4 + i}" for i, q in enumerate(QUALITY))
    wide = ", ".join(f"max(CASE WHEN feature = '{q}' THEN {c} END) AS {q}_{n}" for q in QUALITY for c, n in (("median", "md"), ("mean", "mn"), ("CASE WHEN sd <= 1e-12 THEN 1 ELSE sd END", "sc")))
    width = 4 + len(QUALITY)
    sums = ", ".join([*(f"sum(x{i} * x{j}) AS g{i}_{j}" for i in range(width) for j in range(i, width)), *(f"sum(x{i} * y) AS b{i}" for i in range(width))])
    row = lambda i, n: "[" + ", ".join([*(f"g{min(i, j)}_{max(i, j)}" + (" + 1" if i == j and i else "") for j in range(n)), f"b{i}"]) + "]"
    system = lambda model, n: f"SELECT '{model}' AS model, held, {n} AS n, [{', '.join(row(i, n) for i in range(n))}] AS m FROM g"
    dot = lambda n, b: " + ".join(f"x{i} * {b}[{i + 1}][{n + 1}]" for i in range(n))
    return f"""{PARAMS.replace("WITH c AS", "WITH RECURSIVE c AS", 1)}, w AS (SELECT held, {wide} FROM pr GROUP BY held),
x AS MATERIALIZED (SELECT held, fold, subject, condition, window_id, roi, method, absolute_error_bpm AS y, 1::DOUBLE AS x0, (roi = 'forehead')::INT::DOUBLE AS x1, (roi = 'cheeks_mean')::INT::DOUBLE AS x2, (method = 'CHROM')::INT::DOUBLE AS x3{features} FROM f CROSS JOIN w),
g AS (SELECT held, {sums} FROM x WHERE held <> fold GROUP BY held),
s AS (SELECT model, held, n, 1 AS k, m FROM ({system("baseline", 4)} UNION ALL {system("quality", width)})
  UNION ALL SELECT model, held, n, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / r[k]) ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END) FROM s WHERE k <= n),
z AS (SELECT held, max(CASE WHEN model = 'baseline' THEN m END) AS u, max(CASE WHEN model = 'quality' THEN m END) AS v FROM s WHERE k = n + 1 GROUP BY held)
SELECT subject, condition, window_id, roi, method, round({dot(4, "u")}, 6) AS baseline_predicted, round({dot(width, "v")}, 6) AS quality_predicted FROM x JOIN z USING (held) WHERE held = fold"""


@query(_ridge_sql())
def ridge_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = reliability.out_of_fold(_eligible(spark, sf_dir), "ridge")
    return rounded(out.select("subject", "condition", "window_id", "roi", "method", "baseline_predicted", "quality_predicted"))


@query()
def logistic_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, coefficients = reliability.out_of_fold(_eligible(spark, sf_dir), "logistic")
    return rounded(reliability.coefficient_summary(coefficients), 5)


GROUPS = f"{E_}, g AS MATERIALIZED (SELECT method, round(absolute_error_bpm + window_id % 13, 3) AS risk, count(*)::DOUBLE AS total, sum((signed_error_bpm > 0)::INT)::DOUBLE AS positive FROM f GROUP BY ALL), r AS MATERIALIZED (SELECT *, sum(total) OVER (PARTITION BY method ORDER BY risk) - total AS bt, sum(positive) OVER (PARTITION BY method ORDER BY risk) - positive AS bp, sum(total) OVER (PARTITION BY method) AS w, sum(positive) OVER (PARTITION BY method) AS p FROM g)"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _eligible(spark, sf_dir).select("method", F.round(F.col("absolute_error_bpm") + F.col("window_id") % 13, 3).alias("score"), (F.col("signed_error_bpm") > 0).cast("int").alias("label"))
    return ranking.risk_groups(held, ["method"], "score", "label")


@query(GROUPS + " SELECT method, round(sum(positive * (bt - bp + (total - positive) * 0.5::DOUBLE)) / max(p * (w - p)), 6) AS roc_auc, round(sum(positive / p * ((p - bp) / (w - bt))), 6) AS aucpr, " + ", ".join(f"round(sum(least(greatest(greatest(1, floor(w * {c}::DOUBLE)) - bt, 0), total) * positive / total / greatest(1, floor(w * {c}::DOUBLE))), 6) AS error_{round(c * 100)}" for c in ranking.COVERAGES) + " FROM r GROUP BY method")
def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.rank_metrics(_ranked(spark, sf_dir).persist(), ["method"]))  # read once for cuts, totals and ranges


@query(f"{E_} SELECT method, round(avg((reference_hr_bpm / 100 - unreliable::INT) * (reference_hr_bpm / 100 - unreliable::INT)), 6) AS brier_score, round(avg(abs(reference_hr_bpm / 100 - unreliable::INT)), 6) AS mae_bpm, round(sqrt(avg((reference_hr_bpm / 100 - unreliable::INT) * (reference_hr_bpm / 100 - unreliable::INT))), 6) AS rmse_bpm FROM f GROUP BY method")
def fit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _eligible(spark, sf_dir).withColumn("score", F.col("reference_hr_bpm") / 100).withColumn("label", F.col("unreliable").cast("int"))
    return rounded(ranking.fit_metrics(held, ["method"], "score", "label"))


@query()
def reliability_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reliability.reliability(adapters.candidates(spark, sf_dir))[2], 4)


@query(f"{C} SELECT window_status, count(*)::BIGINT AS n FROM c GROUP BY ALL")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.status_counts(adapters.candidates(spark, sf_dir))


BROKEN = "(window_id * 7 + length(condition) + length(roi)) % 1000"


@query(f"""{C}, b AS (SELECT *, {BROKEN} AS k FROM c), n AS (SELECT count(*) FILTER (k = 1 OR k = 2 AND window_status = 'ok' OR k IN (3, 4) AND window_status <> 'ok')::BIGINT AS status, count(*) FILTER (k = 4)::BIGINT AS error, count(*) FILTER (k = 5)::BIGINT AS grid, count(*) FILTER (k = 6)::BIGINT AS reference FROM b)
SELECT 'status' AS contract, status AS violations FROM n UNION ALL SELECT 'error', error + (SELECT count(*) FROM b WHERE (k = 2 AND window_status = 'ok') OR (k = 3 AND window_status <> 'ok')) FROM n UNION ALL SELECT 'grid', grid FROM n UNION ALL SELECT 'reference', reference FROM n""")
def contract_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of each contract in candidates of which some are broken on purpose: an unknown status, an estimate gone or
    made up, a wrong error, a row gone, a reference that is not the canonical one."""
    whole = adapters.candidates(spark, sf_dir)  # made anew for each contract: the tables that it is made of are a thirtieth of it
    refs = whole.select("subject", "window_id", "reference_hr_bpm", "reference_valid").distinct()
    k = F.expr(BROKEN)
    hr = F.when((k == 2) & (F.col("window_status") == "ok"), F.lit(None)).when((k == 3) & (F.col("window_status") != "ok"), 61.5).otherwise(F.col("rppg_hr_bpm"))
    held = whole.filter(k != 5).withColumns({
        "rppg_hr_bpm": hr, "window_status": F.when(k == 1, "unknown").otherwise(F.col("window_status")),
        "signed_error_bpm": F.when(k == 4, F.coalesce("signed_error_bpm", F.lit(0.0)) + 1.0).otherwise(F.col("signed_error_bpm")),
    })
    moved = whole.withColumn("reference_hr_bpm", F.col("reference_hr_bpm") + F.when(k == 6, 1.0).otherwise(0.0))
    n = lambda name, df, rows: df.agg(rows.alias("violations")).select(F.lit(name).alias("contract"), "violations")
    # counted, not filtered: a filter would be pushed below the columns and spell their arithmetic out at each mention
    both = held.agg(F.count_if(validate.status_broken()).alias("status"), F.count_if(validate.error_broken()).alias("error"))
    both = both.select(F.explode(F.array(*(F.struct(F.lit(c).alias("contract"), F.col(c).alias("violations")) for c in ("status", "error")))).alias("e")).select("e.*")
    found = (both, n("grid", validate.missing_keys(refs, held), F.count("*")), n("reference", validate.reference_mismatches(refs, moved), F.coalesce(F.sum("n"), F.lit(0))))
    return reduce(DataFrame.unionByName, found)


RECORDED = f"WITH e AS ({RECORDING}), n AS (SELECT subject, max(bpm) AS bpm, max(frame_idx) + 1 AS frames FROM e GROUP BY subject), w AS (SELECT subject, bpm, unnest(range(1, (frames // 300)::BIGINT + 1)) AS window_id FROM n WHERE frames >= 3)"


@query(f"{RECORDED} SELECT subject, window_id::BIGINT AS window_id, 300::BIGINT AS n_samples, bpm AS sensor_hr_bpm, bpm AS time_hr_to_4, bpm AS frequency_hr_to_4, true AS reference_valid FROM w")
def reference_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heart rates of the contact signal, to the nearest 4 beats, where the recordings have their own."""
    out = candidates.reference_windows(adapters.contact_samples(spark, sf_dir))
    near = lambda c: (F.round(F.col(c) / 4) * 4).alias(c.replace("_bpm", "_to_4"))
    return rounded(out.select("subject", "window_id", "n_samples", "sensor_hr_bpm", near("time_hr_bpm"), near("frequency_hr_bpm"), "reference_valid"))


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.reference_windows(adapters.contact_samples(spark, sf_dir)).persist()


GRID = f"""{RECORDED}, g AS (SELECT w.*, c.condition, c.frames, c.fps, c.shift, r.roi FROM w, (VALUES ('original', 300, NULL, 0.0::DOUBLE), ('fps15', 150, 15.0::DOUBLE, 0.0), ('fps10', 100, 10.0, 0.0), ('roi_shift_3', 300, NULL, 0.03), ('roi_shift_5', 300, NULL, 0.05)) AS c(condition, frames, fps, shift),
(VALUES ('full_face_inner'), ('forehead'), ('cheeks_mean')) AS r(roi))"""


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = [adapters.colour_traces(spark, sf_dir, f).withColumn("condition", F.lit(f"roi_shift_{round(f * 100)}")) for f in (0.03, 0.05)]
    return shifted[0].unionByName(shifted[1])


@query(f"{GRID} SELECT subject, condition, window_id::BIGINT AS window_id, roi, m.method, 'ok' AS window_status, frames::BIGINT AS n_frames, bpm AS rppg_hr_to_4, bpm AS reference_hr_to_4, true AS close FROM g, (VALUES ('POS'), ('CHROM')) AS m(method)")
def pulse_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates of both methods in every condition and region, to the nearest 4 beats, where the recordings have their own."""
    refs = _references(spark, sf_dir)
    out = candidates.candidates(refs, degrade.source_traces(adapters.colour_traces(spark, sf_dir), _shifted(spark, sf_dir)), picked=RATES)
    near = lambda c: (F.round(F.col(c) / 4) * 4).alias(c.replace("_bpm", "_to_4"))
    return rounded(out.select("subject", "condition", "window_id", "roi", "method", "window_status", "n_frames", near("rppg_hr_bpm"), near("reference_hr_bpm"), (F.col("absolute_error_bpm") <= 1.0).alias("close")))


OFF = f"WITH e AS ({OFF_GRID}), n AS (SELECT subject, max(bpm) AS bpm, max(frame_idx) + 1 AS frames FROM e GROUP BY subject), w AS (SELECT subject, bpm, unnest(range(1, (frames // 300)::BIGINT + 1)) AS window_id FROM n WHERE frames >= 3)"


@query(f"""{OFF} SELECT subject, window_id::BIGINT AS window_id, r.roi, m.method, round(bpm, 6) AS true_bpm, true AS contact_time_within_half, true AS contact_frequency_within_half, true AS video_within_half, true AS peak_stands_out, true AS entropy_of_a_sine
FROM w, (VALUES ('full_face_inner'), ('forehead'), ('cheeks_mean')) AS r(roi), (VALUES ('POS'), ('CHROM')) AS m(method)""")
def off_grid_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All estimates of noisy recordings with fractional rates lie within half a beat of the recordings' own rate; the
    spectrum's peak holds most of the band's power, and its entropy is about that of a Hann-windowed sine (0.57)."""
    refs = candidates.reference_windows(adapters.contact_samples(spark, sf_dir, OFF_GRID)).persist()
    frames = adapters.colour_traces(spark, sf_dir, text=OFF_GRID).withColumn("condition", F.lit("original"))
    found = candidates.candidates(refs, frames, ["original"])
    own = adapters.recordings(spark, sf_dir, OFF_GRID).groupBy("subject").agg(F.max("bpm").alias("true_bpm"))
    near = lambda c: F.abs(F.col(c) - F.col("true_bpm")) <= 0.5
    out = found.join(refs.select("subject", "window_id", "time_hr_bpm", "frequency_hr_bpm"), ["subject", "window_id"]).join(own, "subject")
    return rounded(out.select(
        "subject", "window_id", "roi", "method", "true_bpm", near("time_hr_bpm").alias("contact_time_within_half"), near("frequency_hr_bpm").alias("contact_frequency_within_half"), near("rppg_hr_bpm").alias("video_within_half"),
        (F.col("spectral_peak_fraction") >= 0.85).alias("peak_stands_out"), F.col("spectral_entropy").between(0.55, 0.6).alias("entropy_of_a_sine"),
    ))


@query(f"""{GRID} SELECT subject, condition, window_id::BIGINT AS window_id, roi, fps AS target_fps, 300::BIGINT AS source_frame_count, frames::BIGINT AS retained_frame_count, frames::BIGINT AS auditable_frame_count, shift AS roi_shift_fraction,
round(shift, 2) AS max_roi_shift_fraction, round(1 - shift, 6) AS mean_roi_retention_ratio, round(1 - shift, 6) AS min_roi_retention_ratio FROM g""")
def condition_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _references(spark, sf_dir)
    out = candidates.condition_audit(refs, degrade.condition_traces(refs, adapters.colour_traces(spark, sf_dir), _shifted(spark, sf_dir)))
    kept = ("subject", "condition", "window_id", "roi", "target_fps", "source_frame_count", "retained_frame_count", "auditable_frame_count", "roi_shift_fraction", "mean_roi_retention_ratio", "min_roi_retention_ratio")
    return rounded(out.select(*kept, F.round("max_roi_shift_fraction", 2).alias("max_roi_shift_fraction")))


FACE = """SELECT 'subject' || CAST(l_suppkey % 3 AS STRING) AS subject, CAST(l_orderkey % 500 AS BIGINT) AS frame_idx, {n} AS x, {m} AS y, l_quantity, l_extendedprice, l_discount FROM lineitem"""
MARKS = FACE.format(n="l_quantity / 50e0", m="l_discount * 10e0")
PIXELS = f"SELECT subject, frame_idx, x, y, max(l_quantity * 5e0) AS r, max(floor(l_extendedprice / 300e0)) AS g, max(l_discount * 2500e0) AS b FROM ({FACE.format(n='l_partkey % 24', m='(l_orderkey + l_linenumber) % 20')}) z GROUP BY subject, frame_idx, x, y"


@query(f"""WITH m AS ({MARKS}), b AS (SELECT subject, frame_idx, min(x) * 100 AS x0, max(x) * 100 AS x1, min(y) * 80 AS y0, max(y) * 80 AS y1 FROM m GROUP BY ALL),
g AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, x1 - x0 AS w, (x1 - x0) * (y1 - y0) / 8181.0::DOUBLE AS a FROM b), p AS (SELECT *, lag(cx) OVER o AS px, lag(cy) OVER o AS py, lag(a) OVER o AS pa FROM g WINDOW o AS (PARTITION BY subject ORDER BY frame_idx))
SELECT subject, frame_idx, round(w, 6) AS face_width_px, round(a, 6) AS face_area_ratio, CASE WHEN px IS NULL THEN 0.0::DOUBLE WHEN w <> 0 THEN round(sqrt((cx - px) ** 2 + (cy - py) ** 2) / w, 6) END AS face_center_shift,
CASE WHEN px IS NULL THEN 0.0::DOUBLE WHEN pa <> 0 THEN round(abs(a - pa) / pa, 6) END AS face_area_change FROM p""")
def face_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = adapters.sql(spark, sf_dir, MARKS, "lineitem")
    frames = marks.select("subject", "frame_idx").distinct().withColumns({"time_sec": F.col("frame_idx") / 30.0, "width": F.lit(101), "height": F.lit(81)})
    return rounded(faces.face_geometry(frames, marks).select("subject", "frame_idx", "face_width_px", "face_area_ratio", "face_center_shift", "face_area_change"))


@query(f"""WITH p AS ({PIXELS}), k AS (SELECT *, CASE WHEN x < 12 THEN 'forehead' ELSE 'cheeks_mean' END AS roi FROM p), s AS (SELECT subject, frame_idx, roi, x + 2 AS x, y - 1 AS y FROM k WHERE x + 2 < 24 AND y - 1 >= 0),
c AS (SELECT s.subject, s.frame_idx, s.roi, count(*) AS n, avg(r) AS r, avg(g) AS g, avg(b) AS b, avg(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) AS l, avg((greatest(r, g, b) >= 250)::INT::DOUBLE) AS o FROM s JOIN p USING (subject, frame_idx, x, y) GROUP BY ALL),
t AS (SELECT k.subject, k.frame_idx, k.roi, round(count(s.x) / count(*)::DOUBLE, 6) AS retention_ratio FROM k LEFT JOIN s USING (subject, frame_idx, roi, x, y) GROUP BY ALL)
SELECT subject, frame_idx, roi, n::BIGINT AS n_pixels, n >= 50 AS valid, retention_ratio, {", ".join(f"CASE WHEN n >= 50 THEN round({a}, 6) END AS {b}" for a, b in (("r", "r"), ("g", "g"), ("b", "b"), ("l", "brightness"), ("o", "overexposure_ratio")))} FROM c JOIN t USING (subject, frame_idx, roi)""")
def shifted_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of regions that moved by 2.4 and -1.4 pixels in frames of 24 x 20, and what they keep."""
    pixels = adapters.sql(spark, sf_dir, PIXELS, "lineitem")
    masks = pixels.select("subject", "frame_idx", F.when(F.col("x") < 12, "forehead").otherwise("cheeks_mean").alias("roi"), "x", "y")
    frames = adapters.rasters(pixels, 24, 20).join(faces.encoded(masks), ["subject", "frame_idx"])
    return rounded(faces.moved_regions(frames, 2.4, -1.4).filter("n_pixels > 0"))
