import pytest

from heartloom import queries

SF = "/root/testdata/sf0.001"
FAST = ["condition_metrics", "subject_statistics", "observed_deltas", "tumbling_windows", "window_quality_status", "last_face_motion", "linear_gap_fill", "subject_folds", "rank_metrics", "fold_feature_params", "paired_degradation", "bootstrap_intervals", "contract_checks", "downsample_greedy", "reference_windows", "pulse_rates", "condition_audit", "face_geometry", "shifted_regions", "ridge_predictions", "off_grid_rates"]


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, duck, same, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = duck(queries.ORACLES[name], **{t: f"{SF}/{t}.parquet" for t in ("orders", "lineitem", "events")})
    same(got, want)
    assert len(got)
