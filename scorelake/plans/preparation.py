"""The corpus preparation job: archives in, scored and enriched samples out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from scorelake.functions.captions import captions_from_json, clean_caption
from scorelake.functions.scoring import normalise_score, routing_rows
from scorelake.operators.scores import IDENTITY, require_identity, resolve_captions
from scorelake.operators.scoring_jobs import Switches, encode_text, score_columns
from scorelake.schema import SYNTHETIC_CAPTION


def with_captions(decoded: DataFrame, captions: DataFrame | None) -> DataFrame:
    """Add cleaned original, long and short captions: from the caption table, or from the JSON."""
    if captions is not None:
        return resolve_captions(decoded, captions)
    long, short = captions_from_json(
        F.col("txt"),
        F.col("meta.synthetic_caption"),
        F.col("meta.short_synthetic_caption"),
        F.col("meta.caption"),
        F.coalesce(F.map_contains_key(F.col("other"), F.lit("short_synthetic_caption")), F.lit(False)),
    )
    return decoded.select(
        "*", clean_caption(F.col("txt")).alias("original"), long.alias("long"), short.alias("short")
    )


def score_samples(captioned: DataFrame, scorers: Mapping[str, str], switches: Switches, image: str | None = None) -> DataFrame:
    """(shard, key, one column per output): every output computed on its sample's row and normalised.

    `scorers` maps a score to a registered scorer of (image, caption), or of the caption alone where
    no image column is named. All scorers run in one scan of the samples and one pass through Python.
    """
    require_identity(IDENTITY, samples=captioned)
    outputs, runs, kinds = {}, {}, []
    for score, output, kind in routing_rows():
        if score not in switches.scores or (output != score and not switches.synthetic):
            continue
        if kind == "copy":
            outputs[output] = F.col(score)
        else:
            runs[output] = (scorers[score], [image, kind] if image else [kind])
            kinds.append(kind)
            outputs[output] = normalise_score(score, F.col("_scored")[output])
    copies = [o for o in outputs if o.startswith("synthetic_") and SYNTHETIC_CAPTION[o.removeprefix("synthetic_")] == "copy"]
    if not runs:
        return captioned.select(*IDENTITY, *(c.alias(o) for o, c in outputs.items()))
    inputs = {n: F.col(n) for n in dict.fromkeys([*([image] if image else []), *kinds])}
    scored = captioned.select(*IDENTITY, score_columns(runs, inputs).alias("_scored"))
    scored = scored.select(*IDENTITY, *(c.alias(o) for o, c in outputs.items() if o not in copies))
    return scored.withColumns({o: outputs[o] for o in copies}).select(*IDENTITY, *outputs)


def encode_samples(captioned: DataFrame, switches: Switches, make_encoder, latents: Mapping[int, str] | None = None, batch_size: int = 64) -> DataFrame:
    """(shard, key, text and latent columns) that the switches ask for.

    `latents` names the column that a plug-in has filled for each image size.
    """
    columns = {}
    if switches.text:
        columns["text_embedding"] = encode_text(F.col("original"), make_encoder, batch_size=batch_size)
        if switches.synthetic:
            columns["synthetic_text_embedding"] = encode_text(F.col("long"), make_encoder, batch_size=batch_size)
    for size, on in ((256, switches.latents_256), (512, switches.latents_512)):
        if on:
            if not latents or size not in latents:
                raise ValueError(f"latents of size {size} are switched on but no column holds them")
            columns[f"latents_{size}"] = F.col(latents[size])
    return captioned.select(*IDENTITY, *(c.alias(n) for n, c in columns.items()))
