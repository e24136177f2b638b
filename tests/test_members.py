import random

import pytest

from scorelake.operators import shards


def plain_runs(names):
    """Start of each member's sample, scanning once."""
    out, prefix, seen, start = {}, None, set(), None
    for i, name in enumerate(names):
        if "." not in name:
            continue
        p, e = name.split(".", 1)
        e = e.lower()
        if p != prefix or e in seen:
            prefix, seen, start = p, set(), i
        seen.add(e)
        out[i] = start
    return out


@pytest.mark.parametrize("seed,chunk", [(0, 3), (1, 5), (2, 1), (3, 1000), (4, 2)])
def test_runs_with_repeats_across_chunks(spark, seed, chunk):
    rng = random.Random(seed)
    rows, want = [], {}
    for shard in ("s0", "s1"):
        names, key = [], 0
        for _ in range(120):
            key = key if rng.random() < 0.8 else rng.randrange(4)
            names.append(f"k{key}" + rng.choice([".jpg", ".JPG", ".txt", ".json", ".a.npy", "", ".txt"]))
        rows += [(shard, i, n) for i, n in enumerate(names)]
        want.update({(shard, i): s for i, s in plain_runs(names).items()})
    df = spark.createDataFrame(rows, "shard string, member_idx long, member string").repartition(5)
    got = shards.group_member_runs(df, chunk).collect()
    assert {(r["shard"], r["member_idx"]): r["sample_start"] for r in got} == want


def test_key_and_extension_split_at_the_first_dot(spark):
    df = spark.createDataFrame(
        [("s", 0, "a/b.x/c.txt", b"1"), ("s", 1, "plain", b"2"), ("s", 2, "k.emb.npy", b"3"), ("s", 3, "k.emb.npy", b"4"), ("s", 4, "k.jpg", b"5")],
        "shard string, member_idx long, member string, content binary",
    )
    rows = {r["key"]: r for r in shards.group_members(df, [".emb.npy"], [".jpg", ".x/c.txt"]).collect()}
    assert set(rows) == {"a/b", "k"}
    assert bytes(rows["k"]["emb.npy"]) == b"4" and rows["k"]["has_jpg"] and rows["a/b"]["has_x/c.txt"]
    assert [(r["shard"], r["nsamples"]) for r in shards.shard_table(df).collect()] == [("s", 2)]


def test_select_shards_checks(spark):
    ranges = spark.createDataFrame([(i,) for i in range(5)], "shard_idx long")
    def pick(request):
        found, beyond = shards.select_shards(ranges, shards.shard_intervals(request))
        return sorted(r[0] for r in found.collect()), beyond

    assert pick("3") == ([3], []) and pick("1, 9,4") == ([1, 4], [(9, 10)]) and pick("2-4") == ([2, 3, 4], []) and pick("3-5")[1] == [(3, 6)]
    for bad in ("3-2", "", "a", "-1", "1,,2"):
        with pytest.raises(ValueError):
            shards.shard_intervals(bad)
