"""Reward targets of a generation request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from scorelake.schema import SCORES

POSITIVE_DEFAULT, NEGATIVE_DEFAULT = 1.0, 0.0


def unknown_keys(requested: Column, trained: Sequence[str] = SCORES) -> Column:
    """Requested keys the model was not trained on, sorted."""
    return F.array_sort(F.array_except(F.map_keys(requested), F.lit(list(trained))))


def resolve_targets(
    df: DataFrame, requested: str, trained: Sequence[str] = SCORES, default: float = POSITIVE_DEFAULT
) -> DataFrame:
    """One column per trained key: its requested value, or the default.

    A row with an unknown key raises when it is evaluated.
    """
    unknown = unknown_keys(F.col(requested), trained)
    message = F.concat(F.lit("unknown reward keys: "), F.array_join(unknown, ", "))
    checked = F.when(F.size(unknown) == 0, F.col(requested)).otherwise(F.raise_error(message))
    values = {k: F.coalesce(F.try_element_at("_checked", F.lit(k)), F.lit(default)) for k in trained}
    return df.withColumn("_checked", checked).withColumns(values).drop("_checked")


def snap(value: Column, steps: int = 64) -> Column:
    """Nearest multiple of 1/steps inside [0, 1]."""
    snapped = F.least(F.greatest(F.round(value * steps) / steps, F.lit(0.0)), F.lit(1.0))
    return F.when(value.isNotNull(), snapped)


def variant_keys(scores: Sequence[str] = SCORES) -> Column:
    """array<struct(variant, keys)>: all, all but one, exactly one."""
    everything = F.lit(list(scores))
    rows = [F.struct(F.lit("all").alias("variant"), everything.alias("keys"))]
    for s in scores:
        rows.append(
            F.struct(F.lit(f"without_{s}").alias("variant"), F.array_remove(everything, s).alias("keys"))
        )
        rows.append(F.struct(F.lit(f"only_{s}").alias("variant"), F.array(F.lit(s)).alias("keys")))
    return F.array(*rows)


def require_columns(df: DataFrame, needed: Sequence[str]) -> DataFrame:
    """The needed columns, or an error naming what is missing and what is there."""
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise KeyError(f"missing columns {missing}; available: {df.columns}")
    return df.select(*needed)
