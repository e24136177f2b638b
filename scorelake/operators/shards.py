"""Members, samples, shards and global positions."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from scorelake.operators.ranks import BROADCAST_ROWS, ordered_index
from scorelake.schema import IMAGE_EXTENSIONS
from scorelake.session import materialise


def member_key(member: Column) -> Column:
    """Name up to its first dot; NULL when there is none."""
    return F.when(F.contains(member, F.lit(".")), F.substring_index(member, ".", 1))


def member_ext(member: Column) -> Column:
    """Rest of the name from the first dot on."""
    return F.substring(member, F.instr(member, ".").cast("int"), F.length(member))


def group_members(
    members: DataFrame, extensions: Sequence[str], presence: Sequence[str] = IMAGE_EXTENSIONS
) -> DataFrame:
    """One row per (shard, key): a column per wanted extension and a flag per `presence` extension.

    Each column keeps the last member of its extension. The aggregation state is one value per
    wanted extension, so a key that owns a third of all members needs no large group anywhere.
    """
    keyed = members.withColumn("key", member_key(F.col("member"))).where(F.col("key").isNotNull())
    keyed = keyed.withColumn("ext", member_ext(F.col("member")))
    wanted = keyed.where(F.col("ext").isin(*extensions, *presence))
    contents = [
        F.max_by(
            F.when(F.col("ext") == e, F.col("content")), F.when(F.col("ext") == e, F.col("member_idx"))
        ).alias(e.lstrip("."))
        for e in extensions
    ]
    flags = [F.bool_or(F.col("ext") == e).alias(f"has_{e.lstrip('.')}") for e in presence]
    return wanted.groupBy("shard", "key").agg(F.min("member_idx").alias("first_idx"), *contents, *flags)


def group_member_runs(members: DataFrame, chunk: int = 100_000) -> DataFrame:
    """Consecutive-run grouping: adds `sample_start`, the index of the first member of a row's sample.

    A sample ends when the prefix changes or its extension (lower case) comes again. The rule is a
    scan in archive order, so an archive is cut into chunks of `chunk` members: each is summarised
    once, the summaries are chained per archive (one row per chunk), and each chunk is then labelled
    from its true entry state. No task holds more than one chunk, or one row per chunk.
    """
    keyed = (
        members.select("shard", "member_idx", "member")
        .withColumn("prefix", member_key(F.col("member")))
        .where(F.col("prefix").isNotNull())
        .withColumn("ext", F.lower(member_ext(F.col("member"))))
        .withColumn("chunk", F.floor(F.col("member_idx") / chunk))
    )
    summaries = keyed.groupBy("shard", "chunk").applyInPandas(_summarise_chunk, _SUMMARY)
    entries = summaries.groupBy("shard").applyInPandas(_chain_chunks, _ENTRY)
    labelled = keyed.groupBy("shard", "chunk").cogroup(entries.groupBy("shard", "chunk"))
    return labelled.applyInPandas(_label_chunk, _LABELLED)


_SUMMARY = (
    "shard string, chunk long, first_prefix string, last_prefix string, lead_exts array<string>, "
    "cand_exit array<long>, open boolean, tail_rows array<long>, tail_exts array<string>"
)
_ENTRY = "shard string, chunk long, entry_start long, entry_exts array<string>"
_LABELLED = "shard string, member_idx long, member string, prefix string, ext string, sample_start long"


def _next_start(pdf: pd.DataFrame) -> np.ndarray:
    """For a sample that starts at row i of the chunk: the row where the following one starts."""
    n = len(pdf)
    change = (pdf["prefix"] != pdf["prefix"].shift()).to_numpy()
    run = np.cumsum(change)
    place = pd.Series(np.arange(n))
    same = place.groupby([run, pdf["ext"].to_numpy()]).shift(-1).fillna(n).to_numpy().astype(int)
    starts = np.append(np.flatnonzero(change), n)
    next_run = starts[np.searchsorted(starts, np.arange(n), side="right")]
    return np.minimum(np.minimum.accumulate(same[::-1])[::-1], next_run)


def _summarise_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("member_idx").reset_index(drop=True)
    n, rows, following = len(pdf), pdf["member_idx"].to_numpy(), _next_start(pdf)
    last = np.arange(n)  # start of the sample that is open at the end, by starting row
    for i in range(n - 1, -1, -1):
        if following[i] < n:
            last[i] = last[following[i]]
    lead = int(following[0])  # an open sample can reach this far at most
    candidates = last[: lead + 1]
    tail = int(candidates.min())
    return pd.DataFrame(
        {
            "shard": [pdf["shard"][0]],
            "chunk": [pdf["chunk"][0]],
            "first_prefix": [pdf["prefix"][0]],
            "last_prefix": [pdf["prefix"][n - 1]],
            "lead_exts": [pdf["ext"][:lead].tolist()],
            "cand_exit": [rows[candidates].tolist()],
            "open": [lead == n],
            "tail_rows": [rows[tail:].tolist()],
            "tail_exts": [pdf["ext"][tail:].tolist()],
        }
    )


def _restart(lead_exts: Sequence[str], seen: set[str]) -> int:
    """First row of the chunk that cannot join the open sample."""
    return next((i for i, e in enumerate(lead_exts) if e in seen), len(lead_exts))


def _chain_chunks(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("chunk")
    out, start, seen, prefix = [], None, set(), None
    for r in pdf.itertuples():
        joins = start is not None and prefix == r.first_prefix
        out.append((r.shard, r.chunk, start if joins else None, sorted(seen) if joins else []))
        at = _restart(r.lead_exts, seen) if joins else 0
        if joins and at == len(r.lead_exts) and r.open:
            seen = seen | set(r.lead_exts)  # the whole chunk belongs to the open sample
        else:
            start = int(r.cand_exit[at])
            seen = {e for row, e in zip(r.tail_rows, r.tail_exts) if row >= start}
        prefix = r.last_prefix
    frame = pd.DataFrame(out, columns=["shard", "chunk", "entry_start", "entry_exts"])
    return frame.astype({"entry_start": "Int64"})


def _label_chunk(pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("member_idx").reset_index(drop=True)
    n, rows, following = len(pdf), pdf["member_idx"].to_numpy(), _next_start(pdf)
    label = np.empty(n, dtype="int64")
    at = 0
    if not pd.isna(entry["entry_start"][0]):
        at = _restart(pdf["ext"][: int(following[0])], set(entry["entry_exts"][0]))
        label[:at] = int(entry["entry_start"][0])
    while at < n:
        label[at : following[at]] = rows[at]
        at = int(following[at])
    return pdf.assign(sample_start=label)[["shard", "member_idx", "member", "prefix", "ext", "sample_start"]]


def shard_table(members: DataFrame) -> DataFrame:
    """(shard, nsamples): distinct keys per shard; names without a dot do not count."""
    keyed = members.select("shard", member_key(F.col("member")).alias("key")).where(F.col("key").isNotNull())
    return keyed.distinct().groupBy("shard").agg(F.count(F.lit(1)).alias("nsamples"))


def global_index(samples: DataFrame, order: Sequence[str] = ("shard", "key")) -> DataFrame:
    """Every sample's position in the corpus: shards in order, samples in order inside them."""
    return ordered_index(samples, order, "idx")


def shard_ranges(indexed: DataFrame) -> DataFrame:
    """(shard, shard_idx, lo, hi, nsamples) of an indexed corpus; ranges are half open."""
    ranges = indexed.groupBy("shard").agg(F.min("idx").alias("lo"), (F.max("idx") + 1).alias("hi"))
    numbered = ordered_index(ranges, ["lo"], "shard_idx")
    return numbered.select("shard", "shard_idx", "lo", "hi", (F.col("hi") - F.col("lo")).alias("nsamples"))


def _pieces(lo: Column, hi: Column) -> Column:
    """[lo, hi) cut into aligned blocks [block << level, (block + 1) << level): at most two per level, none if empty.

    With u = ceil(lo / 2^level) and v = floor(hi / 2^level), a level gives u if it is odd and v - 1 if v is odd.
    """

    def at(level: Column) -> Column:
        u = -F.call_function("shiftright", -lo, level)
        v = F.call_function("shiftright", hi, level)

        def block(odd: Column, value: Column) -> Column:
            taken = (u < v) & (odd.bitwiseAND(F.lit(1)) == 1)
            return F.when(taken, F.struct(level.alias("level"), value.cast("long").alias("block")))

        return F.array(block(u, u), block(v, v - 1))

    lo, hi = lo.cast("long"), hi.cast("long")
    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(62)), at)), lambda x: x.isNotNull())


def stab(points: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str) -> DataFrame:
    """Every point with every half-open range that holds it, all columns of both sides.

    An equi-join on aligned blocks: a range of length n is at most 2 log2(n) rows, whatever its place, and a
    point is a row per level that occurs. A joined pair is always a hit and comes once, so neither wide
    ranges nor overlapping ones fill a bucket with rows that are dropped again. Empty and null ranges hold
    nothing, null points lie in none.
    """
    cut = ranges.withColumn("_piece", F.explode(_pieces(F.col(lo), F.col(hi))))
    blocks = cut.select("*", F.col("_piece.level").alias("_level"), F.col("_piece.block").alias("_block")).drop("_piece")
    # at most 63 rows, whatever the tables hold
    counts = {r["_level"]: r["count"] for r in blocks.groupBy("_level").count().collect()}
    levels = sorted(counts)
    # Spark takes the exploded blocks for as small as the ranges and would broadcast millions of them
    blocks = F.broadcast(blocks) if sum(counts.values()) <= BROADCAST_ROWS else blocks.hint("merge")
    wanted = F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")
    asked = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(wanted))
    asked = asked.withColumn("_block", F.call_function("shiftright", F.col(at).cast("long"), F.col("_level")))
    return asked.join(blocks, ["_level", "_block"]).drop("_level", "_block")


def locate(requests: DataFrame, ranges: DataFrame, idx: str = "idx") -> DataFrame:
    """Range join idx in [lo, hi) for ranges of any width; adds shard, shard_idx, local_idx."""
    hit = stab(requests, ranges.select("shard", "shard_idx", "lo", "hi"), idx, "lo", "hi")
    return hit.withColumn("local_idx", F.col(idx) - F.col("lo")).drop("lo", "hi")


def intersect_ranges(a: DataFrame, b: DataFrame) -> DataFrame:
    """Overlaps of two lists of half-open ranges (a_id, a_lo, a_hi) and (b_id, b_lo, b_hi).

    Two ranges overlap exactly if one holds the other's start: starts of b are looked up in a, and starts
    of a in what b holds after its own start, so that equal starts meet once.
    """
    a, b = (t.where(F.col(f"{n}_lo") < F.col(f"{n}_hi")) for t, n in ((a, "a"), (b, "b")))
    later = stab(b, a, "b_lo", "a_lo", "a_hi")
    tails = b.withColumn("_after", F.col("b_lo") + 1)
    earlier = stab(a, tails, "a_lo", "_after", "b_hi")
    ends = (F.greatest("a_lo", "b_lo").alias("lo"), F.least("a_hi", "b_hi").alias("hi"))
    return later.select("a_id", "b_id", *ends).union(earlier.select("a_id", "b_id", *ends))


def overlap_totals(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of `a` that overlap a range of `b`, with n, lo_sum, hi_min and hi_max over their overlaps.

    The totals of `intersect_ranges` per range of `a`, without its pairs: wide ranges against many short ones are
    a product. Both lists become one table of different end points in natural order, with running totals of the starts and
    ends of b. Of the b that overlap [lo, hi), starts before hi less ends up to lo are the number; the first end
    after lo and the last end of all that start before hi, cut at hi, are the least and largest end.
    """
    a, b = (t.where(F.col(f"{n}_lo") < F.col(f"{n}_hi")) for t, n in ((a, "a"), (b, "b")))
    long = lambda c: F.col(c).cast("long")
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    points = b.select(long("b_lo").alias("at"), one.alias("starts"), zero.alias("ends"), long("b_hi").alias("far"))
    points = points.union(b.select(long("b_hi"), zero, one, none))
    for side in ("a_lo", "a_hi"):
        points = points.union(a.select(long(side), zero, zero, none))
    points = points.groupBy("at").agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends"), F.max("far").alias("far"))
    placed = points.repartitionByRange("at").withColumn("_p", F.spark_partition_id())
    placed = placed.withColumn("sums", F.col("starts") * F.col("at").cast("decimal(19,0)"))
    placed = placed.withColumn("next", F.when(F.col("ends") > 0, F.col("at")))
    placed = materialise(placed.withColumn("sums", F.col("sums").cast("decimal(38,0)")), "end points")

    def running(rows: DataFrame, order: str, group: Sequence[str], ends_to: int) -> DataFrame:
        """Totals before a row (ends up to row `ends_to` from it) and the first end after it."""
        up = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        to = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, ends_to)
        down = Window.partitionBy(*group).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
        return rows.select(
            order, *group, F.coalesce(F.sum("starts").over(up), zero).alias("starts"), F.coalesce(F.sum("ends").over(to), zero).alias("ends"),
            F.coalesce(F.sum("sums").over(up), F.lit(0).cast("decimal(38,0)")).alias("sums"), F.max("far").over(up).alias("far"), F.min("next").over(down).alias("next"),
        )

    per_part = placed.groupBy("_p").agg(*(F.sum(c).alias(c) for c in ("starts", "ends", "sums")), F.max("far").alias("far"), F.min("next").alias("next"))
    # one row per range partition
    parts = running(per_part, "_p", [], -1).select("_p", *(F.col(c).alias(f"_{c}") for c in ("starts", "ends", "sums", "far", "next")))
    totals = running(placed, "at", ["_p"], 0).join(F.broadcast(parts), "_p").select(
        "at", *((F.col(c) + F.col(f"_{c}")).alias(c) for c in ("starts", "ends", "sums")),
        F.greatest("far", "_far").alias("far"), F.least("next", "_next").alias("next"),
    )
    low = totals.select(F.col("at").alias("a_lo"), *(F.col(c).alias(f"_{c}") for c in ("starts", "ends", "sums", "next")))
    high = totals.select(F.col("at").alias("a_hi"), F.col("starts").alias("_starts_hi"), F.col("sums").alias("_sums_hi"), "far")
    n = F.col("_starts_hi") - F.col("_ends")
    inside = F.col("_sums_hi") - F.col("_sums") + F.col("a_lo").cast("decimal(19,0)") * (F.col("_starts") - F.col("_ends"))
    found = a.join(low, "a_lo").join(high, "a_hi").where(n > 0)
    return found.select(
        *a.columns, n.alias("n"), inside.cast("long").alias("lo_sum"),
        F.least("a_hi", "_next").alias("hi_min"), F.least("a_hi", "far").alias("hi_max"),
    )


def shard_intervals(request: str) -> list[tuple[int, int]]:
    """'7', '0, 3, 5' or '2-9' (ends included), also mixed, as half-open intervals."""
    intervals = []
    for part in request.split(","):
        found = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", part)
        low = int(found[1]) if found else -1
        high = int(found[2] or low) if found else -1
        if not 0 <= low <= high:
            raise ValueError(f"{part.strip()!r} is neither a shard number nor a rising range of them")
        intervals.append((low, high + 1))
    return intervals


def select_shards(ranges: DataFrame, intervals: Sequence[tuple[int, int]]) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(shards whose index lies in an interval, the intervals that reach beyond the last shard).

    The caller says whether such an interval is an error; a list of single numbers usually skips it.
    """
    count = ranges.agg(F.coalesce(F.max("shard_idx") + 1, F.lit(0))).first()[0]
    beyond = [i for i in intervals if i[1] > count]
    idx, wanted = F.col("shard_idx"), F.lit(False)
    for low, high in intervals:
        wanted = wanted | ((idx >= low) & (idx < high))
    return ranges.where(wanted), beyond


def union_roots(roots: Sequence[DataFrame]) -> DataFrame:
    """Corpora one after the other; columns a root lacks are NULL."""
    if not roots:
        raise ValueError("no corpus given")
    out = None
    for i, root in enumerate(roots):
        tagged = root.withColumn("root_idx", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def verify_shards(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(shard, ok, problem): checksum and sample count must be the expected ones."""
    a = actual.select("shard", F.col("md5").alias("got_md5"), F.col("nsamples").alias("got_n"))
    joined = expected.join(a, "shard", "full")
    problem = (
        F.when(F.col("got_n").isNull(), "missing")
        .when(F.col("nsamples").isNull(), "unexpected")
        .when(F.col("got_md5") != F.col("md5"), "md5")
        .when(F.col("got_n") != F.col("nsamples"), "nsamples")
    )
    return joined.select("shard", problem.isNull().alias("ok"), problem.alias("problem"))
