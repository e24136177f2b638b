"""Row filters: presence of image and caption, size and score thresholds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def has_image_and_caption(has_image: Column, text: Column) -> Column:
    return has_image & text.isNotNull()


def passes_quality(
    width: Column,
    height: Column,
    clip: Column,
    aesthetic: Column,
    min_size: int = 0,
    min_clip: float = 0.0,
    min_aesthetic: float = 0.0,
    has_json: Column | None = None,
    clip_present: Column | None = None,
    aesthetic_present: Column | None = None,
    bad_json: Column | None = None,
) -> Column:
    """Keep a row without JSON or without a size; else size and scores must reach the thresholds.

    A missing score counts as zero, a present null score (`*_present` true, value NULL) and
    undecodable JSON fail. Without the `*_present` flags a NULL score is taken as missing.
    """

    def reached(score: Column, present: Column | None, floor: float) -> Column:
        if present is None:
            return F.coalesce(score, F.lit(0.0)) >= F.lit(floor)
        return F.when(present, F.coalesce(score >= F.lit(floor), F.lit(False))).otherwise(F.lit(0.0 >= floor))

    verdict = F.when(width.isNull() | height.isNull(), F.lit(True)).otherwise(
        (width >= min_size)
        & (height >= min_size)
        & reached(clip, clip_present, min_clip)
        & reached(aesthetic, aesthetic_present, min_aesthetic)
    )
    if has_json is not None:
        verdict = F.when(~has_json, F.lit(True)).otherwise(verdict)
    if bad_json is not None:
        verdict = F.when(bad_json, F.lit(False)).otherwise(verdict)
    return verdict
