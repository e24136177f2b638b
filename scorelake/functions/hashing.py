"""Deterministic randomness: a uniform number per (key, salt), the same on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash_u(key: Column | str, salt: str | Column) -> Column:
    """Uniform double in [0, 1) from the first 32 bits of md5(key|salt)."""
    key = F.col(key) if isinstance(key, str) else key
    salt = F.lit(salt) if isinstance(salt, str) else salt
    digest = F.md5(F.concat_ws("|", key.cast("string"), salt))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def chance(key: Column | str, salt: str, p: float) -> Column:
    """Bernoulli(p) per key."""
    if not 0.0 <= p <= 1.0:
        raise ValueError(f"probability {p} outside [0, 1]")
    return hash_u(key, salt) < F.lit(float(p))


def normal(key: Column | str, salt: str, index: Column) -> Column:
    """Standard normal per (key, element index): Box-Muller over two hash uniforms."""
    key = F.col(key) if isinstance(key, str) else key
    element = F.concat_ws("#", key.cast("string"), index.cast("string"))
    # 1 - u keeps the logarithm's argument above zero
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - hash_u(element, salt + "/r")))
    return radius * F.cos(F.lit(6.283185307179586) * hash_u(element, salt + "/a"))
