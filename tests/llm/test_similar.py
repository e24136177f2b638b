"""Near-duplicates by shingle similarity: recall and precision on planted pairs, dense groups, odd tables."""

import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.llm import similar


def _shingles(text, k=5):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def _jaccard(a, b):
    a, b = _shingles(a), _shingles(b)
    return len(a & b) / len(a | b)


def _words(rng, n):
    """Words as rare as in real text: a few very common, many rare."""
    return [f"w{int(rng.paretovariate(0.6))}" for _ in range(n)]


def _edited(rng, words, kind, n):
    words = list(words)
    if kind == "replace":
        for at in rng.sample(range(len(words)), n):
            words[at] = f"x{rng.randrange(10**6)}"
    elif kind == "delete":
        for at in sorted(rng.sample(range(len(words)), n), reverse=True):
            del words[at]
    elif kind == "tail":
        words += [f"x{rng.randrange(10**6)}" for _ in range(4 * n)]
    else:
        at = rng.randrange(len(words) - 4 * n)
        words[at : at + 4 * n] = [f"x{rng.randrange(10**6)}" for _ in range(4 * n)]
    return words


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(5)
    rows, pairs = [], []
    for i in range(1200):
        base = _words(rng, rng.randrange(80, 600))
        kind, n = rng.choice(["replace", "delete", "tail", "block"]), rng.randrange(1, 9)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(_edited(rng, base, kind, n)))]
        pairs.append((2 * i, 2 * i + 1, _jaccard(rows[-2][1], rows[-1][1])))
    return rows, pairs


def test_recall_and_precision_on_planted_pairs(spark, planted):
    rows, pairs = planted
    found = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [(a, b) for a, b, j in pairs if j >= 0.8]
    linked = [j for a, b, j in pairs if found[a] == found[b]]
    recall = sum(found[a] == found[b] for a, b in near) / len(near)
    print(f"pairs {len(near)}, recall {recall:.3f}, linked {len(linked)}, linked below 0.8: {sum(j < 0.8 for j in linked)}, least {min(linked):.3f}")
    for lo, hi in ((0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.01)):
        band = [(a, b) for a, b, j in pairs if lo <= j < hi]
        print(lo, len(band), sum(found[a] == found[b] for a, b in band) / max(1, len(band)))
    assert len(near) > 400 and recall >= 0.95
    assert min(linked) > 0.7 and sum(j >= 0.8 for j in linked) / len(linked) > 0.95
    # no text is linked to any but its partner
    assert all(found[a] in (a, b) and found[b] in (a, b) for a, b, _ in pairs)


def test_dense_group_of_different_texts_is_one_component(spark):
    rng = random.Random(6)
    base = _words(rng, 300)
    texts = [" ".join(_edited(rng, base, "replace", 2)) for _ in range(400)] + [" ".join(_words(rng, 200)) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = [r["component_id"] for r in similar.near_duplicates(df).orderBy("doc_id").collect()]
    assert ids[:400] == [0] * 400 and ids[400:] == list(range(400, 450))
    near = similar._neighbours(similar.signatures(df).select("node", "segments", "samples"))
    assert near.select("node", "leader").distinct().count() < 400 * 60  # stars, not all pairs


def test_components_equal_all_pairs(spark):
    """Chains: each text a few words from the last, so that the ends are far apart."""
    rng = random.Random(7)
    texts = []
    for _ in range(12):
        words = _words(rng, 250)
        for _ in range(6):
            texts.append(" ".join(words))
            words = _edited(rng, words, "replace", 2)
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if _jaccard(texts[a], texts[b]) >= 0.8 and root[a] != root[b]:
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    got = similar.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["component_id"] for r in got] == root


def test_odd_tables(spark):
    long = " ".join(f"v{i % 90001}" for i in range(400_000))
    rows = [
        (1, "Alpha beta gamma"), (2, "alpha  BETA\tgamma"), (3, None), (4, ""), (5, "  \n"), (6, "alpha beta delta"), (7, long),
        (8, long + " end"), (8, long + " end"), (None, "one"), (9, "one"), (None, None), (10, "one two"),
    ]
    clash = "doc_id long, text string"
    df = spark.createDataFrame(rows, clash).select("*", *(F.lit(i).alias(c) for i, c in enumerate(("node", "root", "segments", "sketch", "key", "copy", "row", "hash"))))
    ids = sorted(((r["doc_id"] or 0), r["component_id"]) for r in similar.near_duplicates(df).collect())
    assert ids == [(0, 3), (0, 9), (1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 6), (7, 7), (8, 7), (8, 7), (9, 9), (10, 10)]
    kept = similar.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 6, 7, 9, 10]
    assert {(r["node"], r["hash"]) for r in kept.collect()} == {(0, 7)}
    assert similar.keep_first(df.limit(0)).count() == 0


def test_one_digit_apart_shares_a_key(spark):
    rng = np.random.default_rng(3)
    part = [int(v) for v in rng.integers(0, 1 << 36, similar.SEGMENTS)]
    others = [int(v) for v in rng.integers(0, 1 << 36, similar.SEGMENTS)]
    others[5] = part[5] ^ (0xB << 8)
    far = list(others)
    far[5] ^= 1 << 30
    df = spark.createDataFrame([(part, others, far)], "a array<long>, b array<long>, c array<long>")
    row = df.select(*(similar._keys(F.col(c)).alias(c) for c in "abc")).first()
    assert len(set(row["a"])) == similar.SEGMENTS * similar.DIGITS
    assert len(set(row["a"]) & set(row["b"])) == 1 and not set(row["a"]) & set(row["c"])


def test_no_pair_at_the_threshold_is_left_out(spark, planted):
    rows, pairs = planted
    rng = random.Random(11)
    rows, base = list(rows), [f"c{i}" for i in range(400)]
    for i in range(60):  # a crowd around one text: many at 0.8 from one another, few from the first of their keys
        words = list(base)
        for at in rng.sample(range(0, 400, 5), rng.randrange(5, 14)):
            words[at] = f"y{i}_{at}"
        rows.append((5000 + i, " ".join(words)))
    rows += [(6000, " ".join(f"d{i}" for i in range(24))), (6001, " ".join(f"d{i}" for i in range(4, 28)))]  # 16 of 24
    rows += [(6002, " ".join(f"e{i}" for i in range(22))), (6003, " ".join(f"e{i}" for i in range(2, 24)))]  # 16 of 20, just 0.8
    found = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[a] == found[b] for a, b, j in pairs if j >= 0.8)
    crowd = [r for r in rows if 5000 <= r[0] < 6000]
    near = [(a[0], b[0]) for n, a in enumerate(crowd) for b in crowd[:n] if _jaccard(a[1], b[1]) >= 0.8]
    assert near and all(found[a] == found[b] for a, b in near)
    assert found[6002] == found[6003] and found[6000] != found[6001]


def test_exact_links_alone_equal_all_pairs(spark):
    rng = random.Random(12)
    rows = []
    for i in range(60):
        base = [f"v{rng.randrange(40)}" for _ in range(rng.randrange(1, 60))]
        rows.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            words = base[: len(base) - rng.randrange(4)] + [f"z{rng.randrange(3)}"] * rng.randrange(3)
            rows.append(" ".join(words) or "a")
    rows = sorted(set(rows))
    texts = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    number = {r["node"]: r["doc_id"] for r in similar.signatures(texts).collect()}
    none = spark.createDataFrame([], "node long, root long")
    got = {tuple(sorted((number[r["a"]], number[r["b"]]))) for r in similar.missing_links(similar.shingle_sets(texts), none).collect()}
    want = {(i, j) for j in range(len(rows)) for i in range(j) if _jaccard(rows[i], rows[j]) >= 0.8}
    assert got == want and len(want) > 20


def _shuffled(spark):
    """Bytes that the session has written to shuffles so far."""
    summaries = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(summaries.apply(i).totalShuffleWrite() for i in range(summaries.size()))


def test_exact_links_move_no_row_per_shingle(spark):
    rng = random.Random(13)
    texts = [" ".join(f"{rng.randrange(10**6)}" for _ in range(400)) for _ in range(1500)]
    texts += [t + " end" for t in texts[:20]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = similar.shingle_sets(similar.cut(df))
    none = spark.createDataFrame([], "node long, root long")
    before = _shuffled(spark)
    assert similar.missing_links(sets, none).count() == 20
    assert _shuffled(spark) - before < 2 * sum(map(len, texts))


def test_exact_links_do_not_depend_on_groups(spark):
    rng = random.Random(14)
    bases = [[f"v{rng.randrange(30)}" for _ in range(rng.randrange(20, 60))] for _ in range(80)]
    texts = sorted({" ".join(b[: len(b) - rng.randrange(4)] + ["z"] * rng.randrange(3)) for b in bases for _ in range(4)})
    sets = similar.cut(similar.shingle_sets(spark.createDataFrame([(t,) for t in texts + texts[:50]], "text string").repartition(6)))
    none = spark.createDataFrame([], "node long, root long")
    one, many = (sorted(map(tuple, similar.missing_links(sets, none, group_rows=g).collect())) for g in (10**6, 7))
    want = sum(_jaccard(a, b) >= 0.8 for i, a in enumerate(texts) for b in texts[:i])
    assert one == many and len(one) == len(set(one)) == want > 20


def test_shuffle_files_go_with_their_step(spark):
    dirs = [d for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    size = lambda: sum(f.stat().st_size for d in dirs for f in Path(d).rglob("*") if f.is_file())
    before, kept = size(), []
    for salt in range(3):
        kept.append(similar.cut(spark.range(400_000).select(F.xxhash64("id", F.lit(salt)).alias("k")).groupBy("k").count()))
    deadline = time.time() + 20
    while size() - before > 1 << 20 and time.time() < deadline:
        time.sleep(0.2)
    assert size() - before < 1 << 20 and all(df.count() == 400_000 for df in kept)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_a_shared_passage_alone_makes_no_candidates(spark):
    rng = random.Random(15)
    passage = [f"p{i}" for i in range(110)]
    texts = [" ".join(passage + [f"q{i}_{j}" for j in range(20)]) for i in range(300)]
    edited = [" ".join(_edited(rng, passage, "replace", 1)) for _ in range(40)]
    near = sum(_jaccard(a, b) >= 0.8 for i, a in enumerate(edited) for b in edited[:i])
    for rows, least, most in ((texts, 0, 0), (edited, near, 40 * 39 // 2)):
        df = spark.createDataFrame([(t,) for t in rows], "text string")
        keys = similar._rarest(similar.shingle_sets(df), 0.8, 50).withColumn("root", F.col("node"))
        assert keys.count() and keys.where("at >= n - ceil(0.8 * n) + 1").count() == 0
        assert least <= similar._candidates(keys, 0.8).count() <= most
