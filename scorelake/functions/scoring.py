"""Score columns: scaling, routing tables, synthetic swap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scorelake.functions.hashing import chance
from scorelake.schema import (
    AFFINE,
    IMAGE_REWARD_MEAN,
    IMAGE_REWARD_STD,
    SCORES,
    SYNTHETIC_CAPTION,
)


def normalise_score(name: str, raw: Column) -> Column:
    """Raw scorer output on the common scale."""
    if name not in AFFINE:
        raise ValueError(f"unknown score {name!r}")
    offset, divisor = AFFINE[name]
    return (raw.cast("double") + F.lit(offset)) / F.lit(divisor)


def standardise_image_reward(head: Column) -> Column:
    """Raw image-reward value from its unstandardised head."""
    return (head - F.lit(IMAGE_REWARD_MEAN)) / F.lit(IMAGE_REWARD_STD)


def routing_rows() -> list[tuple[str, str, str]]:
    """(score_name, output column, caption kind): which caption each output is computed on."""
    rows = []
    for name in SCORES:
        rows.append((name, name, "original"))
        rows.append((name, f"synthetic_{name}", SYNTHETIC_CAPTION[name]))
    return rows


def route_scores(captions: DataFrame, names: Sequence[str] = SCORES) -> DataFrame:
    """(key, original, long, short) -> one scoring request per output that needs a scorer.

    Copies need none: the synthetic aesthetic score repeats the original one.
    """
    unknown = [n for n in names if n not in SCORES]
    if unknown:
        raise ValueError(f"unknown scores {unknown}")
    requests = [r for r in routing_rows() if r[0] in names and r[2] != "copy"]
    entries = F.array(
        *[
            F.struct(
                F.lit(score).alias("score_name"),
                F.lit(output).alias("output"),
                F.lit(kind).alias("caption_kind"),
                F.col(kind).alias("caption"),
            )
            for score, output, kind in requests
        ]
    )
    return captions.select("key", F.inline(entries))


def routing_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(routing_rows(), "score_name string, output string, caption_kind string")


def swap_synthetic(
    df: DataFrame,
    p: float,
    seed: int = 0,
    names: Sequence[str] = SCORES,
    embedding: tuple[str, str] | None = None,
    key: str = "key",
) -> DataFrame:
    """One draw per key decides for the embedding and all scores alike.

    A score swaps where its synthetic twin is present; the embedding where both exist.
    """
    swap = chance(key, f"swap/{seed}", p)
    out = {
        n: F.when(swap & F.col(n).isNotNull(), F.coalesce(F.col(f"synthetic_{n}"), F.col(n))).otherwise(F.col(n))
        for n in names
    }
    if embedding:
        regular, twin = embedding
        out[regular] = F.when(
            swap & F.col(regular).isNotNull(), F.coalesce(F.col(twin), F.col(regular))
        ).otherwise(F.col(regular))
    return df.withColumns(out)
