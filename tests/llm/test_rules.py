"""The cascade: a stable order by conditional rejection per cost, and no rule on rows already rejected."""

from pyspark.sql import functions as F

from heartloom.llm import quality_rules as q

SF = "/root/testdata/sf0.01"


def test_order_repeats_and_is_conditional(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    orders = [[c.name for c in q.calibrate(docs)] for _ in range(5)]
    assert all(x == orders[0] for x in orders) and sorted(orders[0]) == sorted(q.rules(q.measures(F.lit(""), q.words(F.lit("")))))
    assert [c.name for c in q.calibrate(docs.repartition(7))] == orders[0]
    # both reject the same rows: the second has nothing left to reject once the cheaper one has run
    rows = [(i, "# " * 30) for i in range(30)] + [(100 + i, "plain words that are all different from one to the next and so on until there are more than twenty of them") for i in range(30)]
    got = {c.name: c for c in q.calibrate(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got["symbols"].rejected == 0.5 and got["stutter"].rejected == 0 and got["repeats"].rejected == 0


def test_unreported_measures_stand_only_inside_the_verdict(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = q.judge(docs)._jdf.queryExecution().optimizedPlan().toString()
    head, rest = plan.split("kept#", 1)[0], plan.split("kept#", 1)[1]
    assert head.count("CASE WHEN") >= 1 and "[A-Z]" in head and "[A-Z]" not in rest
    assert head.index("base") < head.index("[A-Z]")


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, long, "x"), (3, long, "x"), (None, long + " y", "x")]
    got = q.judge(spark.createDataFrame(rows, "doc_id long, text string, words string")).collect()
    assert [r.kept for r in sorted(got, key=lambda r: r.n_words)] == [False, False, True, True, True]
    only = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert q.judge(only).first().base_failed and q.keep_passing(only).count() == 0
