"""Embedding and latent columns: norms, similarities, padding, affine maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from scorelake.functions.binding import let
from scorelake.functions.hashing import normal
from scorelake.schema import LATENT_CHANNEL_BIAS, LATENT_CHANNEL_SCALE, LATENT_SCALE


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalise(v: Column, floor: float | None = None) -> Column:
    """Unit vector; a zero vector stays zero. With `floor`, the norm is at least that much."""
    n = norm(v)
    divisor = F.greatest(n, F.lit(floor)) if floor is not None else F.coalesce(F.nullif(n, F.lit(0.0)), F.lit(1.0))
    return let(divisor, lambda d: F.transform(v, lambda x: x.cast("double") / d))


def paired_similarity(image: Column, text: Column, scale: float = 1.0) -> Column:
    """Scaled dot product of a row's own two unit vectors (never the full matrix)."""
    return F.lit(float(scale)) * dot(l2_normalise(image), l2_normalise(text))


def affine_head(v: Column, weights: Sequence[float], bias: float) -> Column:
    """A linear head folded into one weight vector and one bias."""
    return dot(v, F.lit([float(w) for w in weights])) + F.lit(float(bias))


def pad(tokens: Column, length: int, zero: Column) -> Column:
    """First `length` tokens, filled up with `zero` tokens."""
    head = F.slice(tokens, 1, length)
    return F.concat(head, F.array_repeat(zero, F.lit(length) - F.size(head)))


def pad_mask(tokens: Column, length: int) -> Column:
    """True for the first min(n, length) places."""
    real = F.least(F.size(tokens), F.lit(length))
    mask = F.concat(F.array_repeat(F.lit(True), real), F.array_repeat(F.lit(False), F.lit(length) - real))
    return F.when(tokens.isNotNull(), mask)


def trim_to_mask(tokens: Column, mask: Column) -> Column:
    """Keep as many leading tokens as the mask has true entries."""
    # without a lambda, which would be called for every place; what is taken away are the true entries
    return F.slice(tokens, F.lit(1), F.size(mask) - F.size(F.array_remove(mask, F.lit(True))))


def latent_constants(channel_wise: bool) -> tuple[list[float], list[float]]:
    """(scale, shift) per channel, so that normalised = x * scale + shift."""
    if not channel_wise:
        return [1.0 / LATENT_SCALE] * 4, [0.0] * 4
    scale = [0.5 / s for s in LATENT_CHANNEL_SCALE]
    return scale, [-b * s for b, s in zip(LATENT_CHANNEL_BIAS, scale)]


def latent_normalise(latent: Column, channel_wise: bool = True) -> Column:
    """array<channel: array<number>> -> the same shape, scaled and shifted per channel."""
    scale, shift = latent_constants(channel_wise)
    s, b = F.lit(scale), F.lit(shift)
    return F.transform(latent, lambda ch, c: F.transform(ch, lambda x: x * F.get(s, c) + F.get(b, c)))


def latent_denormalise(latent: Column, channel_wise: bool = True) -> Column:
    scale, shift = latent_constants(channel_wise)
    s, b = F.lit(scale), F.lit(shift)
    return F.transform(latent, lambda ch, c: F.transform(ch, lambda x: (x - F.get(b, c)) / F.get(s, c)))


def latent_sample(mean: Column, std: Column, key: Column | str, salt: str) -> Column:
    """mean + std * N(0, 1) per element of a flat latent, the same draw for the same key."""
    pairs = F.arrays_zip(mean.alias("m"), std.alias("s"))
    return F.transform(pairs, lambda p, i: p["m"] + p["s"] * normal(key, salt, i))


def to_uint8(x: Column) -> Column:
    """[-1, 1] picture values -> 0..255, truncated."""
    unit = F.least(F.greatest(x * 0.5 + 0.5, F.lit(0.0)), F.lit(1.0))
    return F.when(x.isNotNull(), F.floor(unit * 255).cast("int"))


def nan_to_zero(x: Column) -> Column:
    return F.nanvl(x, F.lit(0.0))


def nan_fill(x: Column) -> Column:
    """NULL -> NaN, for emitted columns."""
    return F.coalesce(x.cast("double"), F.lit(float("nan")))


def linear_schedule(t: Column, start: float = 1.0, end: float = 0.0, floor: float = 1e-9, shift: float = 1.0) -> Column:
    """Straight line from start to end over t in [0, 1], never below `floor`.

    A `shift` above 1 bends it upwards: odds v / (1 - v) grow by that factor.
    """
    line = F.lit(start) + t * F.lit(end - start)
    if shift > 1:
        line = line * F.lit(shift) / (line * F.lit(shift - 1) + F.lit(1.0))
    return F.greatest(line, F.lit(floor))
