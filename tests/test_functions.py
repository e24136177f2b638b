import math
import re

from hypothesis import given, settings, strategies as st
import pytest
from pyspark.sql import functions as F

from scorelake.functions import augment, captions, quality, scoring, targets, vectors
from scorelake.operators import evaluate, sampling, scores
from scorelake.schema import SCORES


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_captions(spark):
    text = "a ```py\ncode``` b `x` <image> c\n\n d  ```open <b>"
    row = one(
        spark, captions.clean_caption(F.lit("<PERSON> a<PERSON>")), captions.strip_fences(F.lit(text)),
        captions.file_stem(F.lit("a/b.c/x.y.jpg")), captions.file_stem(F.lit("k")), captions.label(F.lit("z" * 51)),
        captions.image_path(F.lit(7), F.lit(12)),
    )
    assert list(row) == [" a", "a b x c d", "x.y", "k", "z" * 50 + "...", "00007/samples/0012.png"]


@pytest.mark.parametrize(
    "w,h,clip,aes,kw,want",
    [
        (None, 10, 0.0, 0.0, {}, True),
        (10, 10, 0.9, 0.9, {}, False),
        (300, 300, None, 0.9, {}, False),
        (300, 300, 0.6, 0.9, {}, True),
        (300, 300, None, 0.9, {"clip_present": True}, False),
        (1, 1, None, None, {"has_json": False}, True),
        (300, 300, 0.9, 0.9, {"bad_json": True}, False),
    ],
)
def test_quality(spark, w, h, clip, aes, kw, want):
    lit = lambda v, t: F.lit(v).cast(t)
    flags = {k: F.lit(v) for k, v in kw.items()}
    c = quality.passes_quality(lit(w, "int"), lit(h, "int"), lit(clip, "double"), lit(aes, "double"), 256, 0.5, 0.0, **flags)
    assert one(spark, c)[0] is want


def test_missing_score_counts_as_zero_but_null_fails_even_at_zero(spark):
    c = [
        quality.passes_quality(F.lit(1), F.lit(1), F.lit(None).cast("double"), F.lit(1.0), clip_present=F.lit(p))
        for p in (False, True)
    ]
    assert list(one(spark, *c)) == [True, False]


def test_targets(spark):
    df = spark.createDataFrame([({"vqa_score": 0.2},), ({},)], "m map<string,double>")
    rows = targets.resolve_targets(df, "m", default=targets.NEGATIVE_DEFAULT).collect()
    assert rows[0]["vqa_score"] == 0.2 and rows[0]["clip_score"] == 0.0 and rows[1]["vqa_score"] == 0.0
    with pytest.raises(Exception, match="unknown reward keys: nope"):
        targets.resolve_targets(spark.createDataFrame([({"nope": 1.0},)], "m map<string,double>"), "m").collect()
    snapped = one(spark, *[targets.snap(F.lit(v)) for v in (0.0079, -1.0, 1.2, 0.5)])
    assert list(snapped) == [1 / 64, 0.0, 1.0, 0.5]
    with pytest.raises(KeyError, match="missing columns"):
        targets.require_columns(df, ["m", "x"])


@pytest.mark.parametrize("strategy,p", [("binomial", 0.9), ("binomial", 1.0), ("uniform", 0.0), ("none", 0.0)])
def test_reward_masks(spark, strategy, p):
    rows = spark.range(3000).select(augment.reward_mask("id", 7, strategy, p).alias("m")).collect()
    sums = [sum(r["m"]) for r in rows]
    assert min(sums) >= 1 and all(len(r["m"]) == 7 for r in rows)
    if p == 1.0:
        assert set(sums) == {1} and {r["m"].index(1) for r in rows} == set(range(7))
    if strategy == "uniform":
        assert set(sums) == set(range(1, 8)) and abs(sum(sums) / 3000 - 4) < 0.15
    with pytest.raises(ValueError):
        augment.reward_mask("id", 7, "other")


def test_swap_needs_the_twin(spark):
    df = spark.createDataFrame([(str(i), 0.1, 0.9 if i % 2 else None, 0.3) for i in range(200)], "key string, clip_score double, synthetic_clip_score double, e double")
    df = df.withColumn("s_e", F.lit(0.7))
    out = scoring.swap_synthetic(df, 1.0, names=["clip_score"], embedding=("e", "s_e")).collect()
    assert {(int(r["key"]) % 2, r["clip_score"], r["e"]) for r in out} == {(1, 0.9, 0.7), (0, 0.1, 0.7)}
    half = scoring.swap_synthetic(df, 0.5, names=["clip_score"], embedding=("e", "s_e")).collect()
    assert all((r["e"] == 0.7) == (r["clip_score"] == 0.9) for r in half if int(r["key"]) % 2)
    assert 60 < sum(r["e"] == 0.7 for r in half) < 140


def test_vectors(spark):
    zero, v = F.lit([0.0, 0.0]), F.lit([3.0, 4.0])
    assert one(spark, vectors.l2_normalise(zero), vectors.l2_normalise(v), vectors.l2_normalise(zero, 1e-6)) == ([0.0, 0.0], [0.6, 0.8], [0.0, 0.0])
    px = one(spark, *[vectors.to_uint8(F.lit(x)) for x in (-2.0, -1.0, 0.0, 1.0, 9.0)])
    assert list(px) == [0, 0, 127, 255, 255]
    t = F.lit([1.0, 2.0, 3.0])
    assert one(spark, vectors.pad(t, 2, F.lit(0.0)), vectors.pad(t, 5, F.lit(0.0)), vectors.pad_mask(t, 5)) == (
        [1.0, 2.0], [1.0, 2.0, 3.0, 0.0, 0.0], [True, True, True, False, False])
    draws = spark.range(20000).select(F.get(vectors.latent_sample(F.lit([5.0]), F.lit([2.0]), "id", "s"), F.lit(0)).alias("z"))
    m = draws.agg(F.avg("z"), F.stddev("z")).first()
    assert abs(m[0] - 5) < 0.05 and abs(m[1] - 2) < 0.05


def test_upsert_and_versions(spark):
    old = spark.createDataFrame([("a", 1.0, 5.0), ("b", 2.0, 6.0)], "key string, x double, y double")
    new = spark.createDataFrame([("b", 9.0, 0.5), ("c", 3.0, 0.7)], "key string, x double, z double")
    with pytest.raises(ValueError, match="shard"):
        scores.upsert_scores(old, new)
    s = F.lit("s").alias("shard")
    old, new = old.select(s, "*").unionByName(old.limit(0).select(s, "*")), new.select(s, "*")
    other = old.limit(1).withColumn("shard", F.lit("t"))  # the same key in another shard is another sample
    both = scores.upsert_scores(old.union(other), new).collect()
    assert {(r["shard"], r["key"]): r["x"] for r in both}["t", "a"] == 1.0 and len(both) == 4
    got = {r["key"]: (r["x"], r["y"], r["z"]) for r in both if r["shard"] == "s"}
    assert got == {"a": (1.0, 5.0, None), "b": (9.0, 6.0, 0.5), "c": (3.0, None, 0.7)}
    log = spark.createDataFrame([("a", 0, 1.0, None), ("a", 1, None, 2.0), ("a", 2, 3.0, None)], "key string, version int, x double, y double")
    assert tuple(scores.latest_scores(log, ["x", "y"], ["key"]).first()) == ("a", 3.0, 2.0)


def test_duplicate_captions_keep_the_first(spark):
    caps = spark.createDataFrame([("k.jpg", "s1", None, 0), ("k.jpg", "s2", "l2", 1)], "file_name string, short_caption string, long_caption string, line int")
    row = scores.resolve_captions(spark.createDataFrame([("a/k", "own")], "key string, txt string"), caps, "line").first()
    assert (row["short"], row["long"]) == ("s1", "own")


def test_summaries(spark):
    one_row = spark.createDataFrame([("f", "p", 0.5, None)], "filename string, prompt string, aesthetic double, extra double")
    rows = {r["scorer"]: r for r in evaluate.reward_summary(one_row).collect()}
    assert rows["aesthetic"]["std"] == 0.0 and rows["extra"]["n_missing"] == 1
    assert evaluate.scorer_columns(spark.createDataFrame([("f", 1.0, 2.0, 3.0)], "filename string, zed double, hpsv2 double, aesthetic double")) == ["aesthetic", "hpsv2", "zed"]
    filled = evaluate.nonfinite_fill(spark.createDataFrame([(math.inf,), (math.nan,), (None,), (2.0,)], "v double"), ["v"])
    assert [r["v"] for r in filled.collect()] == [0.0, 0.0, None, 2.0]


def test_size_estimate_shares(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("key"), "id")
    est = sampling.estimate_size(df, F.col("id") % 2 == 0, n=100_000)
    assert tuple(est.first()) == (1000, 500)
    roots = spark.createDataFrame([("a", 700), ("b", 300)], "root string, n_raw long")
    assert {r["root"]: r["estimate"] for r in sampling.estimate_per_root(est, roots).collect()} == {"a": 350, "b": 150}
    assert sampling.shard_cap(100, 30) == 4 and len(SCORES) == 7


def test_probability_is_checked():
    from scorelake.functions.hashing import chance

    with pytest.raises(ValueError):
        chance("key", "s", 1.5)


def test_brace_patterns(spark):
    from scorelake.plans.requests import expand_pattern

    def urls(text, weights=None):
        df = spark.createDataFrame([(text, weights)], "urls string, weights string")
        rows = expand_pattern(df, weights="weights" if weights else None).collect()
        rows.sort(key=lambda r: (r["part"], r["place"]))
        return [(r["url"], r["weight"]) for r in rows]

    assert urls("a{08..10}.tar::b", "1::2.5") == [("a08.tar", 1.0), ("a09.tar", 1.0), ("a10.tar", 1.0), ("b", 2.5)]
    assert [u for u, _ in urls("{x,y}/{1..3..2}{c..d}")] == [f"{p}/{n}{c}" for p in "xy" for n in "13" for c in "cd"]
    assert [u for u, _ in urls("{3..1}-{}")] == ["3-{}", "2-{}", "1-{}"]
    with pytest.raises(Exception, match="must match"):
        urls("a::b", "1")
    assert [u for u, _ in urls("{a,b{1..2}c,{x,y}}-{p,q}")] == [f"{h}-{t}" for h in ("a", "b1c", "b2c", "x", "y") for t in "pq"]
    assert [u for u, _ in urls(r"\{a,b\}{c\,d,e}")] == ["{a,b}c,d", "{a,b}e"]
    assert urls("{0..25000}") == [(str(n), None) for n in range(25001)]
    with pytest.raises(Exception, match="not closed"):
        urls("a{b,c")


def _expand(text):
    """Plain recursive expansion: first outermost group, its alternatives, then the rest."""
    depth, start = 0, None
    for i, ch in enumerate(text):
        if ch == "{":
            start = i if depth == 0 else start
            depth += 1
        elif ch == "}":
            depth -= 1
            if depth == 0:
                body, rest = text[start + 1 : i], _expand(text[i + 1 :])
                cuts, level = [-1], 0
                for j, c in enumerate(body):
                    level += (c == "{") - (c == "}")
                    cuts += [j] if c == "," and level == 0 else []
                run = re.fullmatch(r"(\d)\.\.(\d)", body)
                if run:
                    heads = [str(n) for n in range(int(run[1]), int(run[2]) + 1)]
                elif len(cuts) > 1:
                    heads = [h for a, b in zip(cuts, cuts[1:] + [len(body)]) for h in _expand(body[a + 1 : b])]
                else:
                    heads = ["{" + h + "}" for h in _expand(body)]
                return [text[:start] + h + r for h in heads for r in rest]
    return [text]


@settings(max_examples=300, deadline=None)
@given(st.recursive(
    st.sampled_from(["", "a", "b.", "{}", "{1..3}"]),
    lambda inner: st.lists(inner, min_size=1, max_size=3).map(lambda p: "{" + ",".join(p) + "}")
    | st.lists(inner, min_size=2, max_size=2).map("".join),
    max_leaves=8,
))
def test_brace_trees_equal_a_recursive_version(pattern):
    from scorelake.plans.patterns import parse, strings

    want = _expand(pattern)
    got = list(strings(pattern, 0, len(want) + 1))
    assert parse(pattern).size == len(want)
    assert [u for u, _ in got] == want
    assert sorted(got, key=lambda r: r[1]) == got
    assert [u for u, _ in strings(pattern, 3, 5)] == want[3:5]


def test_ragged_encoder(spark):
    import numpy as np

    from scorelake.operators.scoring_jobs import encode_text

    def make():
        return lambda texts: [np.array([[len(t), i] for i in range(len(t))]).reshape(-1, 2) for t in texts]

    df = spark.createDataFrame([("abc",), (None,), ("x",)], "t string")
    got = [r["e"] for r in df.select(encode_text(F.col("t"), make, 2).alias("e")).collect()]
    assert got == [[[3.0, 0.0], [3.0, 1.0]], [], [[1.0, 0.0]]]


def test_emitted_rows(spark):
    from scorelake.operators.emit import emit_columns

    df = spark.createDataFrame([("a", None, [1.0], 0.3, None), ("b", "<PERSON>t", None, 0.3, 0.1)], "key string, txt string, emb array<double>, clip_score double, vqa_score double")
    rows = emit_columns(df, ["clip_score", "vqa_score"], 3, {"clip_score": [0.0, 0.2, 1.0]}, arrays={"flan": "emb"}).collect()
    assert [(r["key"], r["text"], r["flan"], r["clip_score_coherence"]) for r in rows] == [("a", "", [1.0], 0.5)]
    assert math.isnan(rows[0]["vqa_score_coherence"])
    with pytest.raises(KeyError, match="vqa_score"):
        emit_columns(df.drop("vqa_score"), ["vqa_score"], 3)


def test_shifted_schedule(spark):
    rows = spark.range(5).select((F.col("id") / 4).alias("t")).select("t", vectors.linear_schedule(F.col("t"), shift=3.0).alias("v"), vectors.linear_schedule(F.col("t")).alias("w")).collect()
    for r in rows:
        v = 1.0 - r.t
        assert r.w == pytest.approx(max(v, 1e-9)) and r.v == pytest.approx(max(3 * v / (1 + 2 * v), 1e-9))


def test_mask_without_dropping_and_unknown_strategy(spark):
    assert one(spark, augment.reward_mask(F.lit("k"), 4, "none")).c0 == [1, 1, 1, 1]
    with pytest.raises(ValueError):
        augment.reward_mask(F.lit("k"), 4, "other")


def test_padding_calls_no_lambda_per_place(spark):
    t = F.array(F.lit(1.0), F.lit(2.0))
    length = 20_000
    mask = vectors.pad_mask(t, length)
    frame = spark.range(1).select(vectors.trim_to_mask(vectors.pad(t, length, F.lit(0.0)), mask).alias("t"), F.size(mask).alias("n"))
    plan = frame._jdf.queryExecution().analyzed().toString()
    assert "lambda" not in plan
    assert tuple(frame.first()) == ([1.0, 2.0], length)
    masks = spark.createDataFrame([([True, None, True],), ([False, None],), ([],), (None,)], "m array<boolean>")
    got = [r[0] for r in masks.select(vectors.trim_to_mask(F.array(*map(F.lit, (1, 2, 3))), F.col("m"))).collect()]
    assert got == [[1, 2], [], [], None]
    assert spark.range(1).select(vectors.pad_mask(F.lit(None).cast("array<int>"), 3)).first()[0] is None
