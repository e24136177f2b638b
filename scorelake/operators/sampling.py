"""Corpus size, sampling and value gathering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from scorelake.functions.hashing import hash_u
from scorelake.functions.scoring import swap_synthetic
from scorelake.operators.bins import to_long
from scorelake.operators.ranks import hash_rank
from scorelake.operators.shards import locate
from scorelake.schema import SCORES


def corpus_size(samples: DataFrame, keep: Column) -> DataFrame:
    """Exact number of rows that pass; a row whose test is NULL does not."""
    return samples.agg(F.count_if(keep).alias("n"))


def sample_n(df: DataFrame, n: int, seed: int = 0, key: str = "key") -> DataFrame:
    """n rows without replacement, the same ones for the same seed.

    Buckets of the hash past the n-th row are cut before the shuffle; nothing is merged in one task.
    """
    return hash_rank(df, hash_u(key, f"sample/{seed}"), [key], limit=n, name="_pos").drop("_pos")


def cap_per_shard(df: DataFrame, k: int, seed: int = 0, shard: str = "shard", key: str = "key") -> DataFrame:
    """At most k rows per shard, chosen by hash."""
    ranked = hash_rank(df, hash_u(key, f"cap/{seed}"), [key], group=[shard], limit=k, name="_pos")
    return ranked.drop("_pos")


def shard_cap(max_samples: int, n_shards: int) -> int:
    return max(1, max_samples // n_shards + 1)


def estimate_size(samples: DataFrame, keep: Column, n: int = 10_000, seed: int = 0) -> DataFrame:
    """floor(total * pass rate of n sampled rows); a row that cannot be judged counts as a fail."""
    passed = F.coalesce(keep, F.lit(False)).cast("double")
    rate = sample_n(samples, n, seed).agg(F.avg(passed)).scalar()
    total = samples.agg(F.count(F.lit(1)).alias("total"))
    return total.select("total", F.floor(F.col("total") * F.coalesce(rate, F.lit(0.0))).alias("estimate"))


def estimate_from_index(indexed: DataFrame, ranges: DataFrame, keep: Column, n: int = 10_000, seed: int = 0) -> DataFrame:
    """`estimate_size` for a corpus with a stored index: no counting, no hashing of keys, no shuffle.

    The total is the end of the last shard's range. Of its positions n are drawn by hash, repeats
    counted once, and located in their shards; a broadcast of these n rows at most picks them from
    `indexed` (shard, idx and what `keep` reads), of which a layout by shard reads only those shards.
    """
    total = ranges.agg(F.coalesce(F.max("hi"), F.lit(0))).first()[0]
    draws = ranges.sparkSession.range(n).select(F.floor(hash_u("id", f"estimate/{seed}") * total).alias("idx")).distinct()
    drawn = locate(draws, ranges).select("shard", "idx")
    passed = F.coalesce(keep, F.lit(False)).cast("double")
    rate = indexed.join(F.broadcast(drawn), ["shard", "idx"]).agg(F.avg(passed).alias("rate"))
    return rate.select(F.lit(total).cast("bigint").alias("total"), F.floor(total * F.coalesce("rate", F.lit(0.0))).alias("estimate"))


def estimate_per_root(estimate: DataFrame, roots: DataFrame) -> DataFrame:
    """Share of the whole estimate per root, by raw rows: roots(root, n_raw)."""
    whole = estimate.agg(F.max(F.struct("estimate", "total"))).scalar()
    share = whole["estimate"] * F.col("n_raw") / whole["total"]
    return roots.select("root", "n_raw", F.floor(share).alias("estimate"))


def gather_values(
    scores: DataFrame,
    max_samples: int = 100_000,
    p: float = 0.0,
    seed: int = 0,
    names: Sequence[str] = SCORES,
    n_shards: int | None = None,
) -> DataFrame:
    """Values the bins are computed on: capped rows per shard, one swap draw per row, capped values.

    Returns (score_name, key, value). A random draw per score settles which values a second cap keeps.
    """
    if n_shards is None:
        n_shards = scores.select("shard").distinct().count()
    cap = shard_cap(max_samples, n_shards)
    capped = cap_per_shard(scores, cap, seed)
    swapped = swap_synthetic(capped, p, seed, names)
    long = to_long(swapped, names, ["key"]).where(F.col("value").isNotNull() & ~F.isnan("value"))
    draw = hash_u(F.concat_ws("/", "key", "score_name"), f"values/{seed}")
    kept = hash_rank(long, draw, ["key"], group=["score_name"], limit=max_samples, name="_pos", largest=cap * n_shards)
    return kept.drop("_pos")
