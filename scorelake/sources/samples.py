"""Archive members -> samples: decoding, typed metadata, rejected rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from scorelake.functions.quality import passes_quality
from scorelake.operators.shards import group_members
from scorelake.schema import IMAGE_EXTENSIONS, SAMPLE_JSON

_SIZES = ("width", "height")
_LOOSE_JSON = T.StructType([T.StructField(f.name, T.DoubleType() if f.name in _SIZES else f.dataType) for f in SAMPLE_JSON])


def read_samples(members: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """(shard, key, first_idx, txt, json text, has_image, extra columns) from member rows."""
    readable = members.where(F.col("error").isNull()) if "error" in members.columns else members
    grouped = group_members(readable, [".txt", ".json", *extra], IMAGE_EXTENSIONS)
    has_image = F.greatest(*[F.col(f"has_{e.lstrip('.')}") for e in IMAGE_EXTENSIONS])
    names = [e.lstrip(".") for e in extra]
    return grouped.select(
        "shard", "key", "first_idx",
        F.col("txt").cast("string").alias("txt"),
        F.col("json").cast("string").alias("json"),
        has_image.alias("has_image"),
        *[F.col(f"`{n}`") for n in names],
    )


def decode_json(samples: DataFrame) -> DataFrame:
    """Add `meta` (typed fields), `other` (all fields as variants) and `bad_json`: not one JSON object.

    Sizes may be written as any number and are rounded down; non-finite tokens are accepted.
    """
    text = F.col("json")
    parsed = samples.withColumns({"other": F.from_json(text, "map<string,variant>"), "meta": F.from_json(text, _LOOSE_JSON)})
    meta = F.col("meta")
    for size in _SIZES:
        value = F.col("meta")[size]
        meta = meta.withField(size, F.when(~F.isnan(value), F.floor(value)).try_cast("int"))
    bad = text.isNotNull() & F.col("other").isNull()
    return parsed.withColumns({"bad_json": bad, "meta": F.when(~bad, meta)})


def quality_of(decoded: DataFrame, min_size: int, min_clip: float, min_aesthetic: float):
    """The quality filter over decoded samples, telling a missing score from a null one."""

    def present(name: str):
        return F.map_contains_key(F.col("other"), F.lit(name))

    return passes_quality(
        F.col("meta.width"), F.col("meta.height"), F.col("meta.clip_score"), F.col("meta.aesthetic_score"),
        min_size, min_clip, min_aesthetic,
        has_json=F.col("json").isNotNull(),
        clip_present=F.coalesce(present("clip_score"), F.lit(False)),
        aesthetic_present=F.coalesce(present("aesthetic_score"), F.lit(False)),
        bad_json=F.col("bad_json"),
    )


def quarantine(decoded: DataFrame, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rejected rows with `reason`).

    With the member rows the samples came from, archives that could not be read (to their end) are
    rejected rows as well, one each, without a key.
    """
    reason = (
        F.when(F.col("bad_json"), "bad json")
        .when(F.col("txt").isNull(), "no caption")
        .when(~F.col("has_image"), "no image")
    )
    marked = decoded.withColumn("reason", reason)
    good, rejected = marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())
    if members is not None:
        broken = members.where(F.col("error").isNotNull()).select("shard", F.lit("unreadable archive").alias("reason"))
        rejected = rejected.unionByName(broken, allowMissingColumns=True)
    return good, rejected


def rejected_counts(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
