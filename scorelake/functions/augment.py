"""Drop-out style columns: reward masks and condition dropping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from scorelake.functions.binding import let
from scorelake.functions.hashing import chance, hash_u


def _draws(key: Column | str, salt: str, k: int) -> Column:
    """array of k uniforms, one per reward."""
    return F.array(*[hash_u(key, f"{salt}/{i}") for i in range(k)])


def reward_mask(key: Column | str, k: int, strategy: str, p: float = 0.0, seed: int = 0) -> Column:
    """array<int> of length k with at least one 1.

    binomial: keep each with probability 1 - p, one at random if none is kept;
    uniform: drop m rewards at random, m uniform in 0..k-1; none: keep all.
    """
    if strategy == "none":
        return F.array_repeat(F.lit(1), k)
    salt = f"mask/{seed}"
    one = F.floor(hash_u(key, f"{salt}/pick") * k).cast("int")
    if strategy == "binomial":
        draws = F.transform(_draws(key, salt, k), lambda u: F.when(u < 1.0 - p, 1).otherwise(0))
        only = let(one, lambda place: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == place, 1).otherwise(0)))
        return let(draws, lambda kept: F.when(F.exists(kept, lambda x: x == 1), kept).otherwise(only))
    if strategy == "uniform":
        draws = F.transform(_draws(key, salt, k), lambda u, i: F.struct(u.alias("u"), i.alias("i")))
        # `one` is uniform in 0..k-1 as well: here it is the number of rewards to drop
        fate = F.struct(F.transform(F.array_sort(draws), lambda d: d["i"]).alias("order"), one.alias("drop"))
        places = F.sequence(F.lit(0), F.lit(k - 1))
        return let(fate, lambda f: F.transform(places, lambda i: F.when(F.array_position(f["order"], i) > f["drop"], 1).otherwise(0)))
    raise ValueError(f"drop-out strategy {strategy!r} is not binomial, uniform or none")


def condition_drop(
    df: DataFrame,
    p: float,
    coherence: Sequence[str],
    embedding: str | None = None,
    unconditional: Column | None = None,
    mask: str | None = None,
    key: str = "key",
    seed: int = 0,
) -> DataFrame:
    """With probability p a row loses its condition.

    The embedding becomes the unconditional one, the mask keeps only its first place, and all
    coherences become NaN.
    """
    drop = chance(key, f"drop/{seed}", p)
    out = {c: F.when(drop, F.lit(float("nan"))).otherwise(F.col(c)) for c in coherence}
    if embedding and unconditional is not None:
        # a longer unconditional embedding is cut to the row's own length
        out[embedding] = F.when(drop, F.slice(unconditional, F.lit(1), F.size(embedding))).otherwise(
            F.col(embedding)
        )
    if mask:
        out[mask] = F.when(drop, F.transform(F.col(mask), lambda _, i: i == 0)).otherwise(F.col(mask))
    return df.withColumns(out)
