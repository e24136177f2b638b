"""The schedule of the refilled buffer against a walk through all steps with the same draws; drawn replacement rows."""

import collections

import pytest

from scorelake.plans import buffers, epochs


@pytest.mark.parametrize("n, most, ranks", [(1, 5, 2), (17, 12, 3), (50, 500, 3), (101, 160, 2), (1000, 80, 8), (10, 1, 4)])
def test_sample_per_rank(spark, n, most, ranks):
    """Different rows within a rank, the stated number of them, other rows for other ranks."""
    got = collections.defaultdict(list)
    indexed = spark.range(n).selectExpr("id as idx", "concat('k', id) as key")
    for r in buffers.sample_per_rank(indexed, n, most, ranks, 5).collect():
        assert r["key"] == f"k{r.idx}"
        got[r["rank"]].append(r.idx)
    each = min(max(most // ranks, 1), n)
    assert sorted(got) == list(range(ranks)) and all(len(set(v)) == len(v) == each for v in got.values())
    if n == 1000:
        assert len({tuple(sorted(v)) for v in got.values()}) == ranks


def test_draws_per_rank_are_even(spark):
    """Each position is as likely: 400 ranks draw 20 of 97."""
    rows = buffers.sample_per_rank(spark.range(97).withColumnRenamed("id", "idx"), 97, 8000, 400, 1).groupBy("idx").count().collect()
    mean = 8000 / 97
    assert len(rows) == 97 and sum((r["count"] - mean) ** 2 for r in rows) / (mean * (1 - 20 / 97)) < 150
    assert buffers.sample_per_rank(spark.range(0).withColumnRenamed("id", "idx"), 0, 10, 2, 1).count() == 0


def draws(spark, steps, batch, buffer_batches, seed):
    df = spark.range(steps * batch).selectExpr(f"id div {batch} as step", f"id % {batch} as place")
    out = collections.defaultdict(dict)
    for r in buffers.drawn_slots(df, buffer_batches, batch, seed).collect():
        out[r.step][r.place] = r.slot
    return out


def walk(spark, n, batch, buffer_batches, seed, drain):
    """Batches of a buffer that is filled, drawn and refilled step by step; `drain` is the order of the slots at the end."""
    size = batch * buffer_batches
    held, nxt, out, step = {s: s for s in range(min(n, size))}, min(n, size), [], 0
    drawn = draws(spark, max(0, -(-(n - size) // batch)), batch, buffer_batches, seed)
    while nxt < n:
        out.append([held.pop(drawn[step][j]) for j in range(batch)])
        for j in range(batch):
            if nxt < n:
                held[drawn[step][j]] = nxt
                nxt += 1
        step += 1
    rest = [held[s] for s in drain if s in held]
    return out + [rest[i : i + batch] for i in range(0, len(rest) // batch * batch, batch)]


@pytest.mark.parametrize("n, batch, buffer_batches", [(0, 4, 2), (3, 4, 2), (8, 4, 2), (9, 4, 2), (101, 4, 3), (400, 5, 4), (64, 1, 7), (50, 7, 1), (1000, 16, 8)])
def test_schedule_is_the_walk(spark, n, batch, buffer_batches):
    from pyspark.sql import functions as F

    from scorelake.functions.hashing import hash_u

    order = [r.id for r in spark.range(batch * buffer_batches).orderBy(hash_u("id", "drain/3"), F.col("id")).collect()]
    want = walk(spark, n, batch, buffer_batches, 3, order)
    for steps_at_once in (1, 7, 1 << 17):
        got = {}
        for r in buffers.buffer_schedule(spark, n, batch, buffer_batches, 3, steps_at_once).collect():
            got[r.batch, r.place] = r.idx
        assert got == {(b, p): idx for b, rows in enumerate(want) for p, idx in enumerate(rows)}
    assert len(want) == n // batch


def test_draws_are_different_slots_and_even(spark):
    steps, batch, buffer_batches = 400, 16, 8
    drawn = draws(spark, steps, batch, buffer_batches, 1)
    counts, pairs = collections.Counter(), collections.Counter()
    for places in drawn.values():
        slots = list(places.values())
        assert len(set(slots)) == batch and all(0 <= s < batch * buffer_batches for s in slots)
        counts.update(slots)
        pairs.update((a, b) for a in slots for b in slots if a < b)
    # every slot is drawn about steps / buffer_batches times; every pair about as often as at random
    assert all(25 < counts[s] < 80 for s in range(batch * buffer_batches))
    share = batch * (batch - 1) / (batch * buffer_batches) / (batch * buffer_batches - 1)
    assert max(pairs.values()) < 5 * steps * share and len(pairs) > 0.97 * (128 * 127 / 2)
    # rows stay in the buffer for about buffer_batches steps on average
    rows = buffers.buffer_schedule(spark, 128 + steps * 16, batch, buffer_batches, 1).where("idx >= 128").selectExpr("avg(batch - (idx - 128) div 16) as w").first()
    assert 7 < rows.w < 9.5


def test_rows_keep_their_columns(spark):
    df = spark.range(100).selectExpr("id as pos", "id * 2 as slot", "'x' as got")
    out = buffers.refilled_buffer(df, 100, 8, 2, 5).collect()
    assert len(out) == 96 and all(r.slot == 2 * r.pos for r in out) and len({r.pos for r in out}) == 96
    with pytest.raises(ValueError):
        buffers.buffer_schedule(spark, 5, 0, 1, 1)


def test_scarce_good_rows_are_spread(spark):
    from pyspark.sql import functions as F

    # one shard with a single good row among 100,000, one with half of its rows good, one without any
    df = spark.range(100_000).selectExpr("'hot' as shard", "id as key", "id = 77 as fine", "'x' as g", "1 as copy")
    df = df.union(spark.range(2000).selectExpr("'even'", "200000 + id", "id % 2 = 0", "'y'", "2")).union(spark.range(50).selectExpr("'none'", "300000 + id", "false", "'z'", "3"))
    out = epochs.refill_drawn(df, F.col("fine"), 1, tries=10**7, per_copy=1000).cache()
    assert out.count() == 102_050 and out.where("shard = 'none' and use_key is not null").count() == 0
    assert out.where("shard = 'hot'").select("use_key").distinct().collect() == [(77,)]
    used = {r.use_key: r["count"] for r in out.where("shard = 'even' and not fine").groupBy("use_key").count().collect()}
    assert all(k % 2 == 0 for k in used) and 550 < len(used) < 710 and max(used.values()) < 10
    # with ten tries some rows find nothing: 0.5 ** 10 of one shard, nearly all of the other
    few = epochs.refill_drawn(df, F.col("fine"), 1, per_copy=1000)
    assert few.where("shard = 'even' and use_key is null").count() < 10 and few.where("shard = 'hot' and use_key is not null").count() < 100
    plan = epochs.refill_drawn(df, F.col("fine"), 1, per_copy=1000)._jdf.queryExecution().optimizedPlan().toString()
    assert "copy" in plan and epochs.refill_drawn(df.limit(0), F.col("fine"), 1).count() == 0
