from pyspark.sql import functions as F

from skeinflow.operators import appoint, graph

SEATS = [
    (1, "oil", "Peru", ["A", "A", "B"], []),
    (1, "oil", "Peru", [], ["C"]),
    (2, "gas", "Chad", ["A"], ["A"]),
    (3, "gas", "Chad", None, ["A", "C"]),
    (4, "", None, ["A"], ["C"]),
    (5, "oil", "Peru", ["B"], None),
]
KIND = "case long, sector string, respondent_state string, claimant_firms array<string>, respondent_firms array<string>"


def test_counsel_table_deals_seats_over_as_many_tasks_as_they_need(spark, monkeypatch):
    """The same table whatever the number of tasks, which grows with the seats; top values tie to the smallest."""
    df = spark.createDataFrame(SEATS, KIND)
    want = [("A", 3, 2, 4, "gas", "Chad"), ("B", 2, 0, 2, "oil", ""), ("C", 0, 3, 3, "", "Chad")]
    assert sorted(tuple(r) for r in appoint.counsel_table(df).collect()) == want
    monkeypatch.setattr(graph, "ROWS_OF_TASK", 1)
    assert sorted(tuple(r) for r in appoint.counsel_table(df).collect()) == want
    assert graph.spread(df, 6, "case").rdd.getNumPartitions() == 6
    plan = appoint.counsel_table(df)._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_seats_without_firms_give_no_rows(spark):
    df = spark.createDataFrame([(1, "oil", "Peru", None, None), (2, "oil", "Peru", [], [])], KIND)
    assert appoint.counsel_table(df).count() == 0
    assert appoint.counsel_table(df.where(F.lit(False))).count() == 0
