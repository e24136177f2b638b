"""Epoch tables over an indexed corpus.

Orders come from hash uniforms, so positions are found per (shard, hash bucket) and lifted by small
offset tables; a shard that holds a third of the corpus is spread like the rest. Rank and batch
splits are arithmetic on the position and need no shuffle at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from scorelake.functions.hashing import hash_u
from scorelake.operators.ranks import (
    BROADCAST_ROWS,
    bucket_rank,
    hash_prefix_sums,
    hash_rank,
    ordered_index,
)
from scorelake.session import materialise


# Buckets per group for tables with one row per shard, which are short.
SHARD_BUCKETS = 64


def epoch_salt(purpose: str, seed: int, epoch: int) -> str:
    return f"{purpose}/{seed + epoch}"


def shuffle(df: DataFrame, seed: int, epoch: int, key: str = "key") -> DataFrame:
    """Whole-table order of one epoch as a position column."""
    return hash_rank(df, hash_u(key, epoch_salt("shuffle", seed, epoch)), [key])


def shuffle_shards(
    indexed: DataFrame, ranges: DataFrame, seed: int, epoch: int, shuffle_first: bool = False
) -> DataFrame:
    """Shards in random order, rows in random order inside them.

    The first epoch keeps the shard order unless `shuffle_first`.
    """
    if epoch == 0 and not shuffle_first:
        base = ranges.select("shard", F.col("lo").alias("base"))
    else:
        u = hash_u("shard", epoch_salt("shards", seed, epoch))
        base = hash_prefix_sums(ranges.select("shard", "nsamples"), u, ["shard"], {"base": "nsamples"}).drop("nsamples")
    rows = hash_u("key", epoch_salt("rows", seed, epoch))
    return hash_rank(indexed, rows, ["key"], group=["shard"], base=base, largest=_largest(ranges))


def _largest(ranges: DataFrame) -> int:
    """Rows of the largest shard; the table has one row per shard."""
    return ranges.agg(F.coalesce(F.max("nsamples"), F.lit(0))).first()[0]


def rank_split_ceil(idx: Column, n: Column, ranks: int) -> Column:
    """Rank of a row: ceil(n / ranks) rows each, the last one may be short."""
    return F.floor(idx / F.ceil(n / ranks))


def rank_split_floor(indexed: DataFrame, n: Column, ranks: int, start: int = 0) -> DataFrame:
    """floor(n / ranks) rows per rank, the tail is dropped; `start` skips rows already seen."""
    per = F.floor(n / ranks)
    rank, pos = F.floor(F.col("idx") / per), F.col("idx") % per
    return indexed.withColumn("rank", rank).withColumn("pos", pos).where(
        (F.col("rank") < ranks) & (F.col("pos") >= start)
    )


def rank_split_local(indexed: DataFrame, n: int, ranks: int, drop_last: bool = False) -> DataFrame:
    """Equal contiguous slices: cut to a multiple of `ranks`, or padded by wrapping from the head.

    A padded table repeats a row at idx + n, idx + 2n, ... while that is below the padded total.
    """
    if drop_last:
        total = n // ranks * ranks
        placed = indexed.where(F.col("idx") < total).withColumn("out_pos", F.col("idx"))
    else:
        total = -(-n // ranks) * ranks
        copies = F.sequence(F.col("idx"), F.lit(total - 1).cast("bigint"), F.lit(n).cast("bigint"))
        placed = indexed.withColumn("out_pos", F.explode(copies))
    per = max(total // ranks, 1)
    return placed.withColumn("rank", F.floor(F.col("out_pos") / per)).withColumn("pos", F.col("out_pos") % per)


def align(n: Column, world: int, batch: int) -> tuple[Column, Column]:
    """(rows per rank, rows in all): per rank floored to a multiple of the batch."""
    per_rank = F.floor(F.floor(n / world) / batch) * batch
    return per_rank, per_rank * world


def align_to(n: Column, multiple: int) -> Column:
    """Floor to a multiple; a size that would become zero stays as it is."""
    if multiple <= 0:
        return n
    floored = F.floor(n / multiple) * multiple
    return F.when(floored > 0, floored).otherwise(n)


def epoch_batches(n: Column, full_batch: int, workers: int, world: int) -> Column:
    """Batches of an epoch: ceil, and on several ranks rounded up to a multiple of the workers."""
    batches = F.ceil(n / full_batch)
    if world <= 1:
        return batches
    w = max(1, workers)
    return F.ceil(batches / w) * w


def chunked_shuffle(
    indexed: DataFrame,
    n: int,
    ranks: int,
    chunk_size: int,
    seed: int,
    epoch: int,
    shuffle_first: bool = False,
) -> DataFrame:
    """Each rank's contiguous rows in chunks; rows shuffled inside a chunk, chunks shuffled after epoch 0."""
    per = -(-n // ranks)
    placed = (
        indexed.withColumn("rank", F.floor(F.col("idx") / per))
        .withColumn("_lo", F.col("rank") * per)
        .withColumn("chunk", F.floor((F.col("idx") - F.col("_lo")) / chunk_size))
        .drop("_lo")
    )
    # sizes are arithmetic: every chunk is full except the last of its rank
    most = -(-per // chunk_size) if n else 0
    held = F.least(F.lit(chunk_size), F.least(F.lit(per), F.lit(n) - F.col("rank") * per) - F.col("chunk") * chunk_size)
    each = indexed.sparkSession.range(ranks * most).select(F.floor(F.col("id") / max(most, 1)).alias("rank"), (F.col("id") % max(most, 1)).alias("chunk"))
    chunks = each.withColumn("size", held).where(F.col("size") > 0)
    if epoch == 0 and not shuffle_first:
        base = chunks.select("rank", "chunk", (F.col("chunk") * chunk_size).alias("base"))
    else:
        u = hash_u(F.concat_ws("/", "rank", "chunk"), epoch_salt("chunks", seed, epoch))
        base = hash_prefix_sums(chunks, u, ["chunk"], {"base": "size"}, ["rank"], SHARD_BUCKETS).drop("size")
    rows = hash_u("idx", epoch_salt("chunk-rows", seed, epoch))
    return hash_rank(placed, rows, ["idx"], group=["rank", "chunk"], base=base, largest=chunk_size)


def buffer_shuffle(df: DataFrame, buffer: int, batch: int, seed: int, n: int, pos: str = "pos") -> DataFrame:
    """Bounded displacement: rows sorted by position plus a random share of the buffer.

    A row moves forward or back by less than the buffer. A short last batch is dropped.
    """
    keyed = df.withColumn("_k", F.col(pos) + hash_u(pos, f"buffer/{seed}") * buffer)
    width = max(buffer * 16, 1 << 20)
    bucket = F.floor(F.col("_k") / width)
    ranked = bucket_rank(keyed, bucket, ["_k", pos], name="out_pos").drop("_k")
    full = n // batch * batch
    return ranked.where(F.col("out_pos") < full).withColumn("batch", F.floor(F.col("out_pos") / batch))


def interleave_sources(shards: DataFrame, n_chunks: int) -> DataFrame:
    """(source, pos, ...) shard list -> out_pos: chunk 0 of every source, then chunk 1, ...

    Sources keep their first-seen order; a source with fewer shards than chunks leaves some empty.
    """
    listed = ordered_index(shards, ["source", "pos"], "_i")
    firsts = listed.groupBy("source").agg(
        F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_n"), F.min("pos").alias("_seen")
    )
    rn, size = F.col("_i") - F.col("_first"), F.greatest(F.floor(F.col("_n") / n_chunks), F.lit(1))
    chunk = F.least(F.floor(rn / size), F.lit(n_chunks - 1))
    chunked = listed.join(firsts, "source").withColumn("chunk", chunk)
    return ordered_index(chunked, ["chunk", "_seen", "pos"], "out_pos").drop("_i", "_first", "_n", "_seen")


def refill_rows(indexed: DataFrame, good: Column, seed: int, group: str = "shard") -> DataFrame:
    """Replace every bad row by a good row of its shard, spread evenly over a random order.

    Good rows stand for themselves; a shard without good rows yields rows with a NULL `use_key`.
    """
    flagged = indexed.withColumn("_ok", F.coalesce(good, F.lit(False)))
    draw = hash_u("key", f"refill/{seed}")
    counts = flagged.groupBy(group).agg(F.count_if("_ok").alias("_good")).withColumn("base", F.lit(0))
    fine = hash_rank(flagged.where("_ok").select(group, "key"), draw, ["key"], [group], name="_g")
    bad = hash_rank(flagged.where(~F.col("_ok")).drop("_ok"), draw, ["key"], [group], counts, name="_j")
    pick = fine.select(group, "_g", F.col("key").alias("use_key"))
    turn = F.when(F.col("_good") > 0, F.col("_j") % F.greatest(F.col("_good"), F.lit(1)))
    filled = bad.withColumn("_g", turn).join(pick, [group, "_g"], "left").drop("_j", "_good", "_g")
    kept = flagged.where("_ok").drop("_ok").withColumn("use_key", F.col("key"))
    return kept.unionByName(filled)


#: bad rows that may draw from one copy of a good row
DRAWS_PER_COPY = 4096


def refill_drawn(indexed: DataFrame, good: Column, seed: int, group: str = "shard", key: str = "key", tries: int = 10, per_copy: int = DRAWS_PER_COPY) -> DataFrame:
    """Replace every bad row by a random good row of its group: adds use_key.

    A row draws rows of its group until one is good, `tries` times at most; so it stays empty (NULL) with
    probability share of bad rows ** tries, else each good row is as likely. Where few good rows stand for
    many, each is copied so often that about `per_copy` rows meet a copy, and a bad row's key picks the
    copy: no join key is hot, and there are at most rows / per_copy copies beyond the good rows themselves.
    """
    flagged = indexed.select(F.struct(*(indexed[c] for c in indexed.columns)).alias("row"), indexed[group].alias("g"), indexed[key].alias("k"), F.coalesce(good, F.lit(False)).alias("ok"))
    counts = flagged.groupBy("g").agg(F.count_if("ok").alias("n_good"), F.count_if(~F.col("ok")).alias("n_bad"))
    counts = materialise(counts.withColumn("copies", F.greatest(F.ceil(F.col("n_bad") / (F.greatest("n_good", F.lit(1)) * per_copy)), F.lit(1))), "refill counts")
    small = F.broadcast if counts.count() <= BROADCAST_ROWS else lambda table: table
    fine = hash_rank(flagged.where("ok").select("g", "k"), hash_u("k", f"refill-rank/{seed}"), ["k"], ["g"], name="place")
    copied = fine.join(small(counts.select("g", "copies")), "g").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    bad = flagged.where(~F.col("ok")).join(small(counts.withColumnRenamed("g", "of")), F.col("g").eqNullSafe(F.col("of")))
    empty = hash_u("k", f"refill-empty/{seed}") < F.pow(F.col("n_bad") / (F.col("n_bad") + F.col("n_good")), F.lit(tries))
    place = F.when((F.col("n_good") > 0) & ~empty, F.floor(hash_u("k", f"refill-draw/{seed}") * F.col("n_good")))
    copy = F.floor(hash_u("k", f"refill-copy/{seed}") * F.col("copies"))
    asked = bad.select("row", "g", place.alias("place"), copy.alias("copy"))
    # rows that stay empty have no key to meet on and would gather in one task
    found = asked.where(F.col("place").isNotNull()).join(copied.select("g", "place", "copy", F.col("k").alias("use_key")), ["g", "place", "copy"])
    none = asked.where(F.col("place").isNull()).select("row", F.lit(None).cast(indexed.schema[key].dataType).alias("use_key"))
    kept = flagged.where("ok").select("row", F.col("k").alias("use_key"))
    return kept.unionByName(found.select("row", "use_key")).unionByName(none).select("row.*", "use_key")


def batch_rows(df: DataFrame, size: int, keep_partial: bool, group: str = "shard", order: str = "key") -> DataFrame:
    """Fixed-size batches in row order inside a group: adds batch and slot."""
    listed = ordered_index(df, [group, order], "_i")
    groups = listed.groupBy(group).agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_n"))
    pos = F.col("_i") - F.col("_first")
    out = listed.join(groups, group).withColumn("batch", F.floor(pos / size)).withColumn("slot", pos % size)
    if not keep_partial:
        out = out.where((F.col("batch") + 1) * size <= F.col("_n"))
    return out.drop("_i", "_first", "_n")


#: rounds of padding that one task opens at a time
ROUNDS_AT_ONCE = 1024


@dataclass(frozen=True)
class EpochShape:
    ranks: int
    workers: int
    batch: int
    seed: int = 0
    epoch: int = 0


def shard_exclusive(indexed: DataFrame, ranges: DataFrame, n_shards: int, shape: EpochShape) -> DataFrame:
    """Every worker reads its own shards; batches are dealt to the workers in turn.

    Ranks take contiguous shards (the last the rest); a rank shuffles its shards and deals them to
    workers contiguously (the last the rest). All ranks run the same number of rounds, that of the
    largest one. A worker out of full batches repeats its first rows to fill one; one without rows
    is left out. Output: (rank, worker, round, slot, out_pos, shard, key, idx).
    """
    workers, batch = shape.workers, shape.batch
    # one row per shard, used several times below: written once
    placed = materialise(_deal_shards(ranges, n_shards, shape), "dealt-shards")
    of_ranks = placed.groupBy("rank").agg(F.sum("nsamples").alias("rows"), F.max("nsamples").alias("largest"))
    rounds, largest = of_ranks.agg(F.max(F.floor(F.floor(F.col("rows") / workers) / batch)), F.coalesce(F.max("largest"), F.lit(0))).first()
    # position of a row among its worker's rows: start of its shard there + its place in the shard
    dealt = hash_rank(
        indexed.select("shard", "key", "idx"),
        hash_u("key", epoch_salt("plan-rows", shape.seed, shape.epoch)),
        ["key"],
        group=["shard"],
        base=placed.drop("nsamples"),
        largest=largest,
    ).withColumn("rounds", F.lit(rounds).cast("long"))
    pos, own_rounds = F.col("pos"), F.floor(F.col("L") / batch)
    # a row's place in a full batch, and its repeats in later rounds: slot i takes row i mod L
    full = F.when(
        pos < F.least(own_rounds, F.col("rounds")) * batch,
        F.struct(
            F.floor(pos / batch).alias("first"), F.floor(pos / batch).alias("last"),
            (pos % batch).alias("slot"), F.lit(batch).cast("bigint").alias("step"),
        ),
    )
    repeats = F.when(
        (pos < F.least(F.lit(batch), F.col("L"))) & (own_rounds < F.col("rounds")),
        F.struct(
            own_rounds.alias("first"), (F.col("rounds") - 1).alias("last"), pos.alias("slot"), F.col("L").alias("step")
        ),
    )
    once = dealt.withColumn("s", full).where(F.col("s").isNotNull()).withColumn("round", F.col("s.first")).withColumn("slot", F.col("s.slot"))
    # few rows may stand for many rounds: blocks of rounds are dealt to tasks before they are opened
    wide = dealt.withColumn("s", repeats).where(F.col("s").isNotNull())
    blocks = wide.withColumn("block", F.explode(F.sequence(F.floor(F.col("s.first") / ROUNDS_AT_ONCE), F.floor(F.col("s.last") / ROUNDS_AT_ONCE))))
    start, stop = F.col("block") * ROUNDS_AT_ONCE, (F.col("block") + 1) * ROUNDS_AT_ONCE - 1
    opened = blocks.repartition("shard", "key", "block").withColumn(
        "round", F.explode(F.sequence(F.greatest("s.first", start), F.least("s.last", stop)))
    )
    again = opened.withColumn("slot", F.explode(F.sequence(F.col("s.slot"), F.lit(batch - 1).cast("bigint"), F.col("s.step")))).drop("block")
    placed_rows = once.unionByName(again)
    out_pos = (F.col("round") * F.col("lanes") + F.col("lane")) * batch + F.col("slot")
    return placed_rows.select("rank", "worker", "round", "slot", out_pos.alias("out_pos"), "shard", "key", "idx")


def _deal_shards(ranges: DataFrame, n_shards: int, shape: EpochShape) -> DataFrame:
    """(shard, nsamples, rank, worker, base, L, lane, lanes) per shard.

    base: rows of earlier shards of the same worker; L: all rows of the worker; lane: the worker's
    number among the `lanes` workers of its rank that have rows.
    """
    ranks, workers = shape.ranks, shape.workers
    per_rank = n_shards // ranks
    rank = F.floor(F.col("shard_idx") / per_rank) if per_rank else F.lit(ranks - 1).cast("bigint")
    ranked = ranges.select("shard", "nsamples", F.least(rank, F.lit(ranks - 1)).alias("rank"))
    u = hash_u("shard", epoch_salt("plan-shards", shape.seed, shape.epoch))
    weights = {"srn": F.lit(1), "cum": F.col("nsamples")}
    listed = hash_prefix_sums(ranked, u, ["shard"], weights, ["rank"], SHARD_BUCKETS)

    of_rank = F.when(F.col("rank") < ranks - 1, F.lit(per_rank)).otherwise(F.lit(n_shards - (ranks - 1) * per_rank))
    per_worker, last = F.floor(of_rank / workers), F.lit(workers - 1)
    worker = F.when(per_worker == 0, last).otherwise(
        F.least(F.floor(F.col("srn") / F.greatest(per_worker, F.lit(1))), last)
    )
    dealt = listed.withColumn("worker", worker)
    # at most ranks x workers rows
    own = Window.partitionBy("rank")
    lanes = (
        dealt.groupBy("rank", "worker")
        .agg(F.min("cum").alias("start"), F.sum("nsamples").alias("L"))
        .withColumn("lane", F.row_number().over(own.orderBy("worker")) - 1)
        .withColumn("lanes", F.count(F.lit(1)).over(own))
    )
    return dealt.join(lanes, ["rank", "worker"]).select(
        "shard", "nsamples", "rank", "worker", (F.col("cum") - F.col("start")).alias("base"), "L", "lane", "lanes"
    )
