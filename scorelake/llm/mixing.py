"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent, normalised. The exponent runs from
0 (all sources alike) to 1 (shares as they are); bisection finds the largest one whose weights reach
the target entropy, raised as far as the repetition limit asks: no source may be passed over more
than `repeats` times for the budget. A limit without an entropy gives the flattest mix it allows,
neither of them the shares as they are. Where no exponent reaches the entropy it is 0; where even the
shares repeat too often it is 1. Each round of the bisection is one aggregate over the source table
with `POINTS` exponents at once.

A source's part of the budget is realised as whole passes and one partial pass, each in a new random
order of its documents. Offsets in that sequence of tokens deal the documents to blocks of
`block_tokens`, so that every block holds the sources by their weights; within a block a random
order mixes them. A document that begins before its source's budget ends is taken.

Tokens are words (runs of other bytes than white space). A null source is a source of its own. A
null or empty text has no tokens and is placed like any other; a source without tokens has no weight
and is left out. Rows are told apart by id and text; repeated rows each take part. Extra columns are
left out by `mix`, kept by `realise`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from scorelake.session import materialise as cut


ENTROPY = 0.95
REPEATS = 2.0
BLOCK_TOKENS = 1_000_000
BROADCAST_SOURCES = 100_000
POINTS = 31
ROUNDS = 7
_WORD = r"[^\x20\x09-\x0D]+"
_HIGH = 1024
_BUCKET_ROWS = 256


@dataclass(frozen=True)
class Target:
    """entropy: share of the largest entropy, log(number of sources); repeats: passes over any source; budget: tokens, by default those of the input."""

    entropy: float | None = ENTROPY
    repeats: float | None = REPEATS
    budget: float | None = None


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def _order(doc_id: Column, text_hash: Column, turn: Column) -> Column:
    """60 random bits for a row in one pass."""
    name = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), text_hash, turn.cast("string"))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def measured(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, source_key, text_hash, n_tokens) per row."""
    return df.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), _source_key(F.col(source)).alias("source_key"),
        F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 16).alias("text_hash"),
        F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long").alias("n_tokens"),
    )


def exponent(sources: DataFrame, target: Target) -> float:
    """The temperature exponent for a table of (source_key, tokens > 0)."""
    count, total = sources.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    if not count or (target.entropy is None and target.repeats is None):
        return 1.0
    budget = target.budget if target.budget is not None else total
    share = F.log(F.col("tokens") / F.lit(float(total)))
    low, high = 0.0, 1.0
    for step in range(ROUNDS):
        points = [low + (high - low) * i / (POINTS + 1) for i in range(POINTS + 2)]
        sums = [F.sum(F.exp(F.lit(a) * share)) for a in points] + [F.sum(F.exp(F.lit(a) * share) * share) for a in points]
        row = sources.agg(*sums, F.min(share)).first()
        flat = []
        for a, z, e in zip(points, row[: len(points)], row[len(points) :]):
            entropy = math.log(z) - a * e / z
            passes = math.exp((a - 1.0) * row[-1]) / z * budget / total
            flat.append((target.entropy is not None and entropy >= target.entropy * math.log(count)) or (target.repeats is not None and passes > target.repeats))
        if step == 0 and flat[-1]:
            return 1.0
        if step == 0 and not flat[0]:
            return 0.0
        at = max(i for i, f in enumerate(flat) if f)
        low, high = points[at], points[min(at + 1, len(points) - 1)]
    return high


def weights(rows: DataFrame, target: Target = Target()) -> DataFrame:
    """(source_key, docs, tokens, weight, budget, passes, rest): whole passes, and tokens of the partial one."""
    sources = cut(rows.groupBy("source_key").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens")).where("tokens > 0"))
    power = exponent(sources, target)
    tempered = F.pow(F.col("tokens"), F.lit(power))
    total, scale = sources.agg(F.sum("tokens"), F.sum(tempered)).first()
    budget = float(target.budget if target.budget is not None else total or 0)
    shared = sources.withColumn("weight", tempered / F.lit(float(scale or 1.0))).withColumn("budget", F.col("weight") * F.lit(budget))
    return shared.withColumn("passes", F.floor(F.col("budget") / F.col("tokens"))).withColumn("rest", F.col("budget") - F.col("passes") * F.col("tokens"))


def mix(df: DataFrame, target: Target = Target(), block_tokens: int = BLOCK_TOKENS, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per occurrence: doc_id, source, n_tokens, weight, turn (pass number from 0), block and place (order in the block, from 1)."""
    rows = cut(measured(df, key, text, source))
    placed = _placed(rows, cut(weights(rows, target)), "sequence(0L, passes)")
    taken = placed.where(F.col("start") + F.col("turn") * F.col("tokens") < F.col("budget"))
    block = F.floor((F.col("start") + F.col("turn") * F.col("tokens")) / (F.col("weight") * F.lit(float(block_tokens))))
    # a block's rows are bounded by its tokens; texts without tokens come with their neighbours
    order = F.md5(F.concat_ws("#", F.lit("place"), F.col("h").cast("string")))
    place = F.row_number().over(Window.partitionBy("block").orderBy(order, "doc_id", "text_hash", "turn"))
    return taken.withColumn("block", block).withColumn("place", place).select("doc_id", "source", "n_tokens", "weight", "turn", "block", "place")


def _small(sources: DataFrame, most: int = BROADCAST_SOURCES) -> DataFrame:
    """A table of one row a source, broadcast if there are few; a plain join would gather the rows by source."""
    return F.broadcast(sources) if sources.count() <= most else sources


def _placed(rows: DataFrame, plan: DataFrame, turns: str) -> DataFrame:
    """Rows by pass with `start`, the tokens of the source before it in the random order of the pass.

    The order is cut twice by leading bits: 1,024 high buckets a source, and low ones of about 256
    rows, so no window holds more than those, however large a source is.
    """
    dealt = rows.join(_small(plan), "source_key").withColumn("turn", F.explode(F.expr(turns)))
    dealt = dealt.withColumn("h", _order(F.col("doc_id"), F.col("text_hash"), F.col("turn")))
    low_count = F.ceil(F.col("docs") / F.lit(_HIGH * _BUCKET_ROWS))
    dealt = dealt.withColumn("high", F.shiftright("h", 50)).withColumn("low", F.floor(F.shiftright("h", 30).bitwiseAND(F.lit((1 << 20) - 1)) * low_count / F.lit(1 << 20)))
    group, bucket = ["source_key", "turn"], ["source_key", "turn", "high", "low"]
    before = lambda by, order, name: F.coalesce(F.sum(name).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lows = dealt.groupBy(*bucket).agg(F.sum("n_tokens").alias("held"))
    highs = lows.groupBy(*group, "high").agg(F.sum("held").alias("held")).withColumn("from_high", before(group, ["high"], "held")).drop("held")
    starts = lows.withColumn("from_low", before([*group, "high"], ["low"], "held")).drop("held").join(highs, [*group, "high"])
    inside = dealt.withColumn("inside", before(bucket, ["h", "doc_id", "text_hash"], "n_tokens"))
    return inside.join(starts, bucket).withColumn("start", F.col("from_high") + F.col("from_low") + F.col("inside"))


def realise(df: DataFrame, target: Target = Target(), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of `df` as often as the mix takes them, all columns as they are, whatever their names.

    Only the partial pass depends on offsets; per source it ends at one place of the random order, so
    the texts meet a table of one row a source and are not shuffled.
    """
    rows = cut(measured(df, key, text, source))
    plan = cut(weights(rows, target))
    placed = _placed(rows, plan, "array(passes)").where("start < rest")
    ends = placed.groupBy("source_key").agg(F.max(F.struct("h", "doc_id", "text_hash")).alias("end"))
    limits = cut(plan.join(ends, "source_key", "left").select("source_key", "passes", "end"))
    text_hash = F.substring(F.md5(F.coalesce(df[text], F.lit(""))), 1, 16)
    whole = df.select(F.struct(*(df[c] for c in df.columns)).alias("row"), _source_key(df[source]).alias("source_key"), df[key].alias("doc_id"), text_hash.alias("text_hash"))
    joined = whole.join(_small(limits), "source_key")
    mine = F.struct(_order(F.col("doc_id"), F.col("text_hash"), F.col("passes")).alias("h"), "doc_id", "text_hash")
    copies = F.col("passes") + F.coalesce(mine <= F.col("end"), F.lit(False)).cast("int")
    return joined.select("row", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select("row.*")
