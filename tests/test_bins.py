import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.operators import bins as B


def long_frame(spark, values, name="s"):
    return spark.createDataFrame([(name, None if v is None else float(v)) for v in values], "score_name string, value float")


def expected_edges(values, positions):
    v = np.unique(np.array(values, dtype="float32")).astype("float64")
    return np.quantile(v, positions).astype("float32")


@pytest.mark.parametrize("seed", [0, 1])
def test_quantiles_match_numpy_on_hard_values(spark, seed):
    rng = np.random.default_rng(seed)
    values = np.concatenate(
        [rng.normal(0, 1, 500), rng.normal(0, 1e-20, 200), rng.normal(0, 1e20, 200), [0.0, -0.0, 1e-45], np.repeat(0.25, 300)]
    ).astype("float32")
    spec = B.BinSpec(16)
    got = {r["i"]: r["edge"] for r in B.raw_edges(long_frame(spark, values), spec).collect()}
    want = expected_edges(values, spec.positions)
    assert np.allclose([got[i] for i in range(17)], want, rtol=1e-6, atol=0)


def test_null_and_nan_carry_no_value(spark):
    df = long_frame(spark, [None, float("nan"), 0.25, 0.5])
    row = B.raw_edges(df, B.BinSpec(2, "uniform")).where("i = 0").first()
    assert (row["n_distinct"], row["edge"]) == (2, 0.25)


def test_ends_are_forced_then_sorted(spark):
    df = long_frame(spark, [-0.5, -0.2, 0.3, 1.4, 1.9])
    edges = B.compute_bins(df, B.BinSpec(4)).first()["edges"]
    assert edges == pytest.approx([-0.2, 0.0, 0.3, 1.0, 1.4])


def test_single_value_gives_zero_and_one(spark):
    assert B.compute_bins(long_frame(spark, [0.4]), B.BinSpec(4)).first()["edges"] == pytest.approx([0.0, 0.4, 1.0])


def test_refined_positions_and_count():
    spec = B.BinSpec(8, "refined_quantile", refine_last=2, refine_factor=3)
    assert spec.actual == 12 and len(spec.positions) == 13
    assert spec.positions[:7] == [i / 8 for i in range(7)] and spec.positions[-1] == 1.0


def test_invalid_strategy():
    with pytest.raises(ValueError, match="quantile, uniform, refined_quantile"):
        B.BinSpec(4, "median")


def test_bucketise_is_right_closed_and_keeps_nan_apart(spark):
    edges = {"s": [0.0, 0.25, 0.5, 1.0]}
    values = [-1.0, -0.0, 0.0, 0.1, 0.25, 0.26, 0.5, 1.0, 1.5, float("inf"), float("-inf"), None, float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s float")
    got = [r["s_coherence"] for r in B.bucketise_scores(df, edges, ["s"], 3).orderBy("i").collect()]
    below = [0, 0, 0, 1, 1, 2, 2, 3, 4, 4, 0]
    assert got[:11] == [max(0, b - 1) / 2 for b in below]
    assert np.isnan(got[11]) and np.isnan(got[12])
    bins = [r["s_bin"] for r in B.bin_numbers(df, edges, ["s"]).orderBy("i").collect()]
    assert bins[:11] == [max(0, b - 1) for b in below] and bins[11:] == [None, None]


def test_missing_edges_policy(spark):
    df = spark.createDataFrame([(0.3, None)], "a double, b double")
    raw = B.bucketise_scores(df, {}, ["a", "b"], 4).first()
    zero = B.bucketise_scores(df, {}, ["a", "b"], 4, on_missing="zero").first()
    off = B.bucketise_scores(df, None, ["a", "b"], 4).first()
    assert raw["a_coherence"] == pytest.approx(0.3) and zero["a_coherence"] == 0.0 and off["a_coherence"] == pytest.approx(0.3)
    assert all(np.isnan(r["b_coherence"]) for r in (raw, zero, off))


def test_store_is_used_only_for_the_same_scores(spark, tmp_path):
    both = long_frame(spark, [0.1, 0.2, 0.9], "a").union(long_frame(spark, [0.3, 0.4, 0.5], "b"))
    config = B.BinsConfig(B.BinSpec(2), ("b", "a"))
    first = B.load_edges(B.load_or_compute_bins(both, config, str(tmp_path)))
    again = B.load_edges(B.load_or_compute_bins(long_frame(spark, [0.7], "a"), config, str(tmp_path)))
    assert first == again and set(first) == {"a", "b"}
    # the table under the same name no longer has the requested keys: computed anew
    long_frame(spark, [0.1], "a").select("score_name", F.array("value").alias("edges"), F.lit(2).alias("n_bins"), F.lit("quantile").alias("strategy")).write.mode("overwrite").parquet(f"{tmp_path}/{config.tag}")
    assert set(B.load_edges(B.load_or_compute_bins(both, config, str(tmp_path)))) == {"a", "b"}
    assert "syn0.5" in B.BinsConfig(B.BinSpec(2, "uniform"), ("a",), 0.5).tag
