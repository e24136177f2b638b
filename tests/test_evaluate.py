"""Values per step, tags in first-seen order: nulls, ties, empty tables."""

from scorelake.operators import evaluate as E


def test_step_values_over_ranks(spark):
    rows = [("loss", 0, 1, 1.0, 1), ("loss", 0, 1, 4.0, 3), ("loss", 0, 1, None, 9), ("loss", 0, 1, 7.0, None), ("loss", 0, 2, None, 4), ("acc", 0, 1, 0.5, 0), (None, None, None, 2.0, 2)]
    df = spark.createDataFrame(rows, "series string, epoch int, step int, value double, n int")
    got = {(r.series, r.step): (r["mean"], r.n, r.ranks) for r in E.metric_steps(df).collect()}
    assert got == {("loss", 1): (3.25, 4, 2), ("loss", 2): (None, 0, 0), ("acc", 1): (None, 0, 1), (None, None): (2.0, 2, 1)}
    assert E.metric_steps(df.limit(0)).count() == 0


def test_tags_in_first_seen_order(spark):
    rows = [(5, "b", True), (3, "c", False), (3, "a", True), (9, "c", True), (1, None, False), (None, "d", True)]
    df = spark.createDataFrame(rows, "at int, tag string, correct boolean")
    got = {r.tag: (r.place, r.n_images, r.n_correct, r.accuracy) for r in E.task_accuracy_ordered(df, "at").collect()}
    # a tag without any arrival comes first, as nulls do; equal arrivals go by name
    assert got == {"d": (0, 1, 1, 1.0), None: (1, 1, 0, 0.0), "a": (2, 1, 1, 1.0), "c": (3, 2, 1, 0.5), "b": (4, 1, 1, 1.0)}
    assert E.task_accuracy_ordered(df.limit(0), "at").count() == 0
