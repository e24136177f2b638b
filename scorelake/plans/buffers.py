"""The refilled shuffle buffer as a schedule: which input row leaves in which batch.

A buffer of `buffer_batches` batches is filled from the input. Each step draws one batch of different
slots at random and refills them with the next rows of the input, the drawn slot j with the j-th one.
When the input ends, what is left leaves in random order; rows beyond the last full batch are dropped.

A step's draw is a keyed permutation of the slots, so it is known without the steps before it. A row that
enters a slot at one step leaves at the slot's next draw: its batch is the next event of the same slot.
So the schedule is a lookup of neighbours per slot, in pieces of `STEPS_AT_ONCE` steps, and no task walks
the table or holds the buffer.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from scorelake.functions.hashing import hash_u

STEPS_AT_ONCE = 1 << 17
#: turns of the keyed permutation, first the row of a slot, then its column, and so on
TURNS = 5


def drawn_slots(draws: DataFrame, buffer_batches: int, batch: int, seed: int) -> DataFrame:
    """Adds `slot` to (step, place): the place-th drawn slot of a step; places are below the number of slots.

    Slots form `buffer_batches` rows of `batch` columns. Every turn shifts one coordinate by a hash of the
    step and the other coordinate, so all turns together permute the slots; the first `batch` images are
    the draw.
    """
    out = draws.withColumn("u", F.floor(F.col("place") / batch)).withColumn("v", F.col("place") % batch)
    for turn in range(TURNS):
        moved, fixed, size = ("u", "v", buffer_batches) if turn % 2 == 0 else ("v", "u", batch)
        shift = F.floor(hash_u(F.concat_ws("/", F.col("step").cast("string"), F.col(fixed).cast("string")), f"slot/{seed}/{turn}") * size)
        out = out.withColumn(moved, (F.col(moved) + shift) % size)
    return out.withColumn("slot", F.col("u") * batch + F.col("v")).drop("u", "v")


def sample_per_rank(indexed: DataFrame, n: int, max_samples: int, ranks: int, seed: int, pos: str = "idx") -> DataFrame:
    """Every rank draws max(max_samples // ranks, 1) different rows of all n (all rows, if fewer): adds rank.

    Ranks draw independently, so a row may go to several. Positions 0 .. n - 1 lie in a square whose cells a keyed
    permutation of the rank deals out; the few cells beyond n (less than a row of the square) are replaced by
    the next ones. Only the drawn positions are shuffled, with `indexed` (dense positions `pos`).
    """
    if ranks < 1:
        raise ValueError("at least one rank draws")
    if n == 0:
        return indexed.limit(0).withColumn("rank", F.lit(0).cast("long"))
    each = min(max(max_samples // ranks, 1), n)
    columns = math.isqrt(n - 1) + 1
    rows = -(-n // columns)
    places = each + rows * columns - n
    ids = indexed.sparkSession.range(ranks * places)
    draws = ids.select(F.floor(F.col("id") / places).alias("step"), (F.col("id") % places).alias("place"))
    drawn = drawn_slots(draws, rows, columns, seed)
    inside, first = F.col("slot") < n, F.col("place") < each
    # less than a row of the square per rank
    spare = drawn.where(inside & ~first).withColumn("nth", F.row_number().over(Window.partitionBy("step").orderBy("place")))
    short = drawn.where(~inside & first).groupBy("step").agg(F.count(F.lit(1)).alias("short"))
    filled = spare.join(short, "step").where(F.col("nth") <= F.col("short"))
    chosen = drawn.where(inside & first).select("step", "slot").unionByName(filled.select("step", "slot"))
    return indexed.join(chosen.select(F.col("step").alias("rank"), F.col("slot").alias(pos)), pos)


def buffer_schedule(spark: SparkSession, n: int, batch: int, buffer_batches: int, seed: int, steps_at_once: int = STEPS_AT_ONCE) -> DataFrame:
    """(idx, batch, place) of the rows 0 .. n - 1 that leave in full batches."""
    if batch < 1 or buffer_batches < 1 or n < 0:
        raise ValueError("batch and buffer_batches must be positive, n not negative")
    slots = batch * buffer_batches
    refilled = max(n - slots, 0)
    steps = -(-refilled // batch)  # the last refill may be short
    ids = spark.range(steps * batch)
    draws = drawn_slots(ids.select(F.floor(F.col("id") / batch).alias("step"), (F.col("id") % batch).alias("place")), buffer_batches, batch, seed)
    # what a slot gets when it is drawn; the slots that a short last refill leaves out stay empty
    got = F.when(F.col("step") * batch + F.col("place") < refilled, F.col("step") * batch + F.col("place") + slots)
    events = draws.withColumn("got", got).withColumn("piece", F.floor(F.col("step") / steps_at_once))
    first = spark.range(min(n, slots)).select(F.lit(-1).cast("long").alias("step"), F.lit(-1).cast("long").alias("place"), F.col("id").alias("slot"), F.col("id").alias("got"), F.lit(-1).cast("long").alias("piece"))
    both = events.select(*first.columns).unionByName(first)
    # the last event of a slot in earlier pieces: one row per slot and piece
    ends = both.groupBy("slot", "piece").agg(F.max_by(F.struct("got"), "step").alias("end"))
    carried = ends.select("slot", "piece", F.lag("end").over(Window.partitionBy("slot").orderBy("piece")).alias("carried"))
    before = F.lag(F.struct("got")).over(Window.partitionBy("slot", "piece").orderBy("step"))
    leaving = both.withColumn("before", before).join(carried, ["slot", "piece"]).where("step >= 0")
    during = leaving.select(F.coalesce("before", "carried")["got"].alias("idx"), F.col("step").alias("batch"), "place")
    # at most one row per slot of the buffer
    left = ends.groupBy("slot").agg(F.max_by("end", "piece")["got"].alias("idx")).where(F.col("idx").isNotNull())
    order = F.row_number().over(Window.orderBy(hash_u("slot", f"drain/{seed}"), "slot")) - 1
    drained = left.select("idx", order.cast("long").alias("at"))
    full = (n - steps * batch) // batch * batch
    after = drained.where(F.col("at") < full).select("idx", (F.floor(F.col("at") / batch) + steps).alias("batch"), (F.col("at") % batch).alias("place"))
    return during.unionByName(after)


def refilled_buffer(df: DataFrame, n: int, batch: int, buffer_batches: int, seed: int, pos: str = "pos") -> DataFrame:
    """Rows with dense positions 0 .. n - 1 in the order of a refilled shuffle buffer: adds batch and place.

    A position must occur once; rows of the dropped tail are left out.
    """
    schedule = buffer_schedule(df.sparkSession, n, batch, buffer_batches, seed)
    return df.join(schedule.withColumnRenamed("idx", pos), pos)
