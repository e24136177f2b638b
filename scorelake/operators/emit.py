"""Training rows: the emitted columns of a sample."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from scorelake.functions.captions import clean_caption
from scorelake.functions.targets import require_columns
from scorelake.operators.bins import bucketise_scores


def emit_columns(
    samples: DataFrame,
    names: Sequence[str],
    n_bins: int,
    edges: Mapping[str, Sequence[float]] | None = None,
    image: str | None = None,
    text: str | None = "txt",
    arrays: Mapping[str, str] | None = None,
    keep: Sequence[str] = ("key",),
    on_missing: str = "raw",
) -> DataFrame:
    """(keep, image, text, arrays, one `{score}_coherence` per name).

    `arrays` maps output names (latent mean and deviation, embedding) to columns. A row that lacks
    the image or a wanted array is left out; a missing caption is empty text; a missing score is NaN.
    """
    arrays = dict(arrays or {})
    needed = [c for c in (image, *arrays.values()) if c]
    require_columns(samples, [*keep, *needed, *([text] if text else []), *names])
    rows = samples
    for column in needed:
        rows = rows.where(F.col(column).isNotNull())
    out = [F.col(k) for k in keep]
    if image:
        out.append(F.col(image).alias("image"))
    if text:
        out.append(clean_caption(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    out += [F.col(column).alias(name) for name, column in arrays.items()]
    binned = bucketise_scores(rows, edges, names, n_bins, on_missing)
    return binned.select(*out, *[f"{n}_coherence" for n in names])
