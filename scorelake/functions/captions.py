"""Caption text: cleaning, resolution from JSON fields or a lookup table, labels and ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PERSON_TAG = "<PERSON>"


def clean_caption(text: Column) -> Column:
    """Drop every person placeholder; whitespace stays as it is."""
    return F.replace(text, F.lit(PERSON_TAG), F.lit(""))


def strip_fences(text: Column) -> Column:
    """Plain text of a caption written by a chat model: no code fences, tags or backticks."""
    # Java's \s and \S are ASCII unless (?U) is given; captions use Unicode whitespace too
    steps = (
        (r"(?s)```.*?```", ""),
        (r"(?s)```.*", ""),
        (r"<[^>]+>", " "),
        (r"`", ""),
        (r"(?U)\s{2,}", " "),
        (r"(?U)^\s+|\s+$", ""),
    )
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def file_stem(path: Column) -> Column:
    """Last path part without its extension; a leading dot is not an extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=[^.])\.[^.]*$", "")


def captions_from_json(original: Column, long: Column, short: Column, caption: Column, has_short: Column | None = None) -> tuple[Column, Column]:
    """(long, short) captions from typed JSON fields, cleaned.

    `has_short` tells an absent short caption (falls to the JSON caption, then the original) from a
    present null (falls to the resolved long one); without it an absent field is assumed.
    """
    resolved_long = F.coalesce(long, original)
    resolved_short = F.coalesce(short, caption, original)
    if has_short is not None:
        resolved_short = F.when(has_short, F.coalesce(short, resolved_long)).otherwise(resolved_short)
    return clean_caption(resolved_long), clean_caption(F.coalesce(resolved_short, resolved_long))


def label(text: Column, width: int = 50) -> Column:
    """Shortened prompt for a panel title."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def image_path(prompt_idx: Column, sample_idx: Column) -> Column:
    """Where image `sample_idx` of prompt `prompt_idx` is written."""
    return F.format_string("%05d/samples/%04d.png", prompt_idx, sample_idx)
