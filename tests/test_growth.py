"""Work that grows with the tables: what is shuffled, held and made for each row."""

from pyspark.sql import functions as F

from heartloom import adapters
from heartloom.operators import bootstrap, reliability, validate
from heartloom.schemas import CANDIDATE_KEY

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_candidates_of_a_window_need_no_shuffle(spark):
    """Orders and lines are shuffled, not the thirty candidates of each order; these then lie together."""
    held = adapters.candidates(spark, SF)
    kept = held.groupBy("subject", "window_id", "roi", "method").agg(F.sum("signed_error_bpm"), F.sum("mean_brightness"))
    assert plan(kept).count("hashpartitioning") == 2


def test_missing_keys_equal_the_anti_join(spark):
    held = adapters.candidates(spark, SF)
    refs = held.select("subject", "window_id").distinct()
    some = held.filter("(window_id * 7 + length(condition) + length(roi)) % 50 <> 5 and window_id % 90 <> 3").withColumn("roi", F.when(F.col("window_id") % 97 == 1, "chin").otherwise(F.col("roi")))
    some = some.unionByName(some.limit(50))
    want = validate.grid(refs, True).join(some, CANDIDATE_KEY, "left_anti").select(*CANDIDATE_KEY)
    got = validate.missing_keys(refs, some).select(*CANDIDATE_KEY)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 0


def test_statistics_of_pairs_are_shuffled_as_sums_only(spark):
    stats = bootstrap.subject_statistics(adapters.candidates(spark, SF), check=False)
    assert plan(stats).count("hashpartitioning") == 2 and "SortMergeJoin" not in plan(stats)


def test_statistics_of_repeated_keys_are_those_of_their_pairs(spark):
    held = adapters.candidates(spark, SF).filter("window_id < 40")
    twice = held.unionByName(held.filter("window_id % 3 = 0 and condition <> 'fps10'")).filter("not (window_id = 7 and condition = 'original')")
    pairs = bootstrap.pair(twice, check=False).filter("reference_valid_original and window_status_original = 'ok' and window_status_degraded = 'ok'")
    want = pairs.groupBy("condition", "roi", "method", "subject").agg(F.count("*").alias("n"), F.round(F.sum(F.abs("signed_error_bpm_original")), 6).alias("o"), F.round(F.sum(F.abs("signed_error_bpm_degraded")), 6).alias("d"))
    got = bootstrap.subject_statistics(twice, check=False).filter("paired_n > 0").select("condition", "roi", "method", "subject", "paired_n", F.round("original_abs_sum", 6), F.round("degraded_abs_sum", 6))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rows_are_pooled_not_repeated(spark):
    """No row for each fold that a row trains, and one for the five conditions that share their features."""
    held = reliability.eligible(adapters.candidates(spark, SF))
    pool = reliability.pooled(held)
    assert plan(pool).count("hashpartitioning") == 2 and "Generate" not in plan(pool)
    n = pool.agg(F.sum("n").alias("n"), F.count("*").alias("rows")).first()
    assert n.n == held.count() and n.rows < 0.3 * n.n
