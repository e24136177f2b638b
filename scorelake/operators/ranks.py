"""Dense positions and prefix sums over whole tables and over hot groups.

A window over a whole table, or over a group that may hold a third of it, would run in one task.
Two ways around that:

* `hash_rank`, `bucket_rank`, `bucket_prefix_sums`: rows are cut into buckets that are monotone in
  the sort key (for hash-ordered work: the leading part of the hash). Windows run per
  (group, bucket); a small table of bucket starts lifts the positions. Buckets are a pure function
  of the row, so any lost task can be recomputed. Only groups that are large are cut at all. The table
  of starts is joined on the keys the window has shuffled by; the list of large groups is broadcast
  after a look at its size.
* `ordered_index`: natural sort order. Range partitioning gives the buckets; the sorted table of keys
  is written once, because range bounds are sampled and must not be re-drawn. Wide rows only meet it.

Group columns must not be null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from scorelake.session import materialise

# The least number of hash buckets of a whole table; a larger table has more of them.
HASH_BUCKETS = 4096
# A group with more rows than this is cut; smaller ones are one bucket each.
ROWS_PER_BUCKET = 1_000_000
# A list of large groups with more rows than this is joined without a broadcast hint.
BROADCAST_ROWS = 200_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _starts(marked: DataFrame, sums: Mapping[str, Column], group: Sequence[str]) -> DataFrame:
    """`_off_*` at the start of every (group, bucket); the window sees one row per bucket of a group."""
    counts = marked.groupBy(*group, "_b").agg(*[c.cast("bigint").alias(f"_n_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = [
        F.coalesce(F.sum(f"_n_{n}").over(before), F.lit(0)).cast("bigint").alias(f"_off_{n}") for n in sums
    ]
    return counts.select(*group, "_b", *starts)


def bucket_prefix_sums(
    df: DataFrame,
    bucket: Column,
    order: Sequence[Column | str],
    weights: Mapping[str, Column | str],
    group: Sequence[str] = (),
) -> DataFrame:
    """Add one column per weight: its sum over all earlier rows of the same group (weight 1: a rank).

    Rows are shuffled once: the windows and the join with the starts share (group, bucket).
    """
    keys = [*group, "_b"]
    marked = df.withColumn("_b", bucket).withColumns(
        {f"_w_{n}": _col(w).cast("bigint") for n, w in weights.items()}
    )
    inside = (
        Window.partitionBy(*keys).orderBy(*map(_col, order)).rowsBetween(Window.unboundedPreceding, -1)
    )
    summed = marked.withColumns(
        {f"_in_{n}": F.coalesce(F.sum(f"_w_{n}").over(inside), F.lit(0)) for n in weights}
    ).join(_starts(marked, {n: F.sum(f"_w_{n}") for n in weights}, group), keys)
    scratch = [f"{p}_{n}" for n in weights for p in ("_w", "_in", "_off")]
    return summed.withColumns({n: F.col(f"_in_{n}") + F.col(f"_off_{n}") for n in weights}).drop("_b", *scratch)


def hash_prefix_sums(
    df: DataFrame,
    u: Column,
    tie: Sequence[Column | str],
    weights: Mapping[str, Column | str],
    group: Sequence[str] = (),
    buckets: int = HASH_BUCKETS,
) -> DataFrame:
    """`bucket_prefix_sums` for rows sorted by a uniform number `u`, ties by `tie`."""
    marked = df.withColumn("_u", u)
    bucket = F.floor(F.col("_u") * buckets).cast("int")
    return bucket_prefix_sums(marked, bucket, ["_u", *tie], weights, group).drop("_u")


def bucket_rank(
    df: DataFrame, bucket: Column, order: Sequence[Column | str], limit: int | None = None, name: str = "pos"
) -> DataFrame:
    """Add `name`: the 0-based position in the whole table, rows sorted by `order`.

    `bucket` must be monotone in `order`; the starts are joined by it.
    With `limit` only positions below it survive; rows of later buckets are dropped before any
    shuffle, so a cap of k costs about k rows.
    """
    marked = df.withColumn("_b", bucket)
    starts = _starts(marked, {"": F.count(F.lit(1))}, [])
    if limit is not None:
        last = starts.where(F.col("_off_") < limit).agg(F.max("_b")).scalar()
        marked = marked.where(F.col("_b") <= last)
    window = Window.partitionBy("_b").orderBy(*map(_col, order))
    ranked = marked.withColumn("_rn", F.row_number().over(window)).join(starts, "_b")
    ranked = ranked.withColumn(name, F.col("_rn") - 1 + F.col("_off_")).drop("_b", "_rn", "_off_")
    return ranked if limit is None else ranked.where(F.col(name) < limit)


def hash_rank(
    df: DataFrame,
    u: Column,
    tie: Sequence[Column | str],
    group: Sequence[str] = (),
    base: DataFrame | None = None,
    limit: int | None = None,
    name: str = "pos",
    rows_per_bucket: int = ROWS_PER_BUCKET,
    largest: int | None = None,
) -> DataFrame:
    """Add `name`: the 0-based position inside the group, rows sorted by a uniform number `u`.

    Ties go by `tie`. `base` (one row per group: group columns + `base`) is added to every row of
    its group, and any further columns of it come along. With `limit` only positions below it
    survive. `largest` is a bound on a group's rows that the caller knows; if no group is large, the
    input is read once and not counted.
    """
    marked = df.withColumn("_u", u)
    order = ["_u", *map(_col, tie)]
    if not group:
        if base is not None:
            raise ValueError("a base needs group columns")
        buckets = max(HASH_BUCKETS, -(-df.count() // ROWS_PER_BUCKET))
        bucket = F.floor(F.col("_u") * buckets).cast("int")
        return bucket_rank(marked, bucket, order, limit, name).drop("_u")
    if base is not None and limit is not None:
        raise ValueError("limit counts from the start of a group; it cannot follow a base")

    if largest is not None and largest <= rows_per_bucket:
        ranked = marked.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
        if limit is not None:
            ranked = ranked.where(F.col("_rn") <= limit)
        start = F.lit(0) if base is None else F.col("base")
        placed = (ranked if base is None else ranked.join(base, list(group))).withColumn(name, (F.col("_rn") - 1 + start).cast("long"))
        return placed.drop("_u", "_rn", *(["base"] if base is not None else []))

    keys = [*group, "_b"]
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_bucket)
    large = materialise(sizes.select(*group, F.ceil(F.col("_n") / rows_per_bucket).cast("int").alias("_k")), "large groups")
    n_large = large.count()
    small = F.broadcast if n_large <= BROADCAST_ROWS else lambda table: table
    marked = marked.join(small(large), list(group), "left").withColumn(
        "_b", F.floor(F.col("_u") * F.coalesce("_k", F.lit(1))).cast("int")
    )
    starts = _starts(marked.where(F.col("_k").isNotNull()), {"": F.count(F.lit(1))}, group)
    if limit is not None:
        last = starts.where(F.col("_off_") < limit).groupBy(*group).agg(F.max("_b").alias("_last"))
        marked = marked.join(small(last), list(group), "left")  # a row for each large group
        marked = marked.where(F.col("_last").isNull() | (F.col("_b") <= F.col("_last"))).drop("_last")

    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = marked.drop("_k").withColumn("_rn", F.row_number().over(window))
    if limit is not None:
        # a plain row-number filter, so that each task keeps at most `limit` rows before the shuffle
        ranked = ranked.where(F.col("_rn") <= limit)
    if base is None:
        ranked = ranked.join(starts, keys, "left")
        start = F.coalesce("_off_", F.lit(0))
    else:
        # one row per group and bucket, joined on the keys the window has already shuffled by
        cut = base.join(small(large), list(group), "left").withColumn(
            "_b", F.explode(F.sequence(F.lit(0), F.coalesce("_k", F.lit(1)) - 1))
        )
        lifted = cut.drop("_k").join(starts, keys, "left")
        ranked = ranked.join(lifted, keys)
        start = F.coalesce("_off_", F.lit(0)) + F.col("base")
    placed = ranked.withColumn(name, F.col("_rn") - 1 + start).drop("_u", "_b", "_rn", "_off_", "base")
    return placed if limit is None else placed.where(F.col(name) < limit)


def _variable(dtype: T.DataType) -> bool:
    """Whether values of the type have no fixed width."""
    return not isinstance(dtype, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.NullType))


def ordered_index(df: DataFrame, order: Sequence[Column | str], name: str = "idx") -> DataFrame:
    """Add `name`: the 0-based position in the natural order given by `order`.

    `order` should be unique per row; rows that tie go by a hash of their other columns (maps aside).
    Where all other columns have a fixed width, the rows themselves are range-partitioned and written once.
    Otherwise only the order columns are: the rows are shuffled once by them and take their positions
    from there, so a row's width never goes through the checkpoint. `df` is then read twice and must give
    the same rows both times. Order expressions (not names) always take the first way.
    """
    named = all(isinstance(c, str) for c in order)
    if not named or not any(_variable(f.dataType) for f in df.schema.fields if f.name not in order):
        return _written_index(df, order, name)
    starts = _written_index(df.select(*order), order, "_at").groupBy(F.struct(*order).alias("_k")).agg(F.min("_at").alias("_at"))
    rest = [f.name for f in df.schema.fields if f.name not in order and "map<" not in f.dataType.simpleString()]
    # window and join share the shuffle by _k
    ties = Window.partitionBy("_k").orderBy(F.xxhash64(*rest) if rest else F.lit(0))
    placed = df.withColumn("_k", F.struct(*order)).withColumn("_rn", F.row_number().over(ties)).join(starts, "_k")
    return placed.withColumn(name, F.col("_at") + F.col("_rn") - 1).drop("_k", "_rn", "_at")


def _written_index(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """`ordered_index` by writing the rows in range partitions."""
    order = [_col(c) for c in order]
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    placed = materialise(placed, "ordered")
    # monotonically_increasing_id = partition number in the upper bits, row number in the lower 33
    part, local = F.shiftrightunsigned("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    per_part = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per range partition
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        placed.withColumn("_p", part)
        .join(F.broadcast(starts), "_p")
        .withColumn(name, local + F.col("_off"))
        .drop("_id", "_p", "_off")
    )
