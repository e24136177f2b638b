"""Score tables: caption lookup, upsert, merge into metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from scorelake.functions.binding import let
from scorelake.functions.captions import clean_caption, file_stem

#: a key is unique inside its shard only
IDENTITY = ("shard", "key")


def require_identity(keys: Sequence[str], **tables: DataFrame) -> None:
    for name, df in tables.items():
        lacking = [k for k in keys if k not in df.columns]
        if lacking:
            raise ValueError(f"the {name} table has no column {lacking[0]!r}; a sample is known by {', '.join(keys)}")


def dedupe_captions(captions: DataFrame, order: Column | str = "file_name") -> DataFrame:
    """(stem, short_caption, long_caption): the first row per stem; partial aggregation, no window."""
    pick = F.min_by(F.struct("short_caption", "long_caption"), order)
    return captions.groupBy(file_stem(F.col("file_name")).alias("stem")).agg(pick.alias("c")).select(
        "stem", "c.short_caption", "c.long_caption"
    )


def resolve_captions(samples: DataFrame, captions: DataFrame, order: Column | str = "file_name") -> DataFrame:
    """Left join by stem; a missing row or cell falls back to the sample's own text. Cleaned.

    No broadcast hint: the caption table grows with the corpus, Spark decides by its real size.
    """
    lookup = dedupe_captions(captions, order)
    joined = samples.withColumn("stem", file_stem(F.col("key"))).join(lookup, "stem", "left")
    return joined.select(
        *samples.columns,
        clean_caption(F.col("txt")).alias("original"),
        clean_caption(F.coalesce("long_caption", "txt")).alias("long"),
        clean_caption(F.coalesce("short_caption", "txt")).alias("short"),
    )


def upsert_scores(old: DataFrame, new: DataFrame, keys: Sequence[str] = IDENTITY) -> DataFrame:
    """Full outer join: new columns overwrite, old columns stay, new keys are added.

    Both tables hold one row per sample, so no key can be hot.
    """
    require_identity(keys, old=old, new=new)
    shared = [c for c in old.columns if c in new.columns and c not in keys]
    added = [c for c in new.columns if c not in old.columns]
    kept = [c for c in old.columns if c not in new.columns]
    o, n = old.alias("o"), new.alias("n")
    same = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    joined = o.join(n.withColumn("_new", F.lit(True)), same, "full")
    has_new = F.col("_new").isNotNull()
    return joined.select(
        *[F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys],
        *[F.col(f"o.{c}").alias(c) for c in kept],
        *[F.when(has_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in shared],
        *[F.col(f"n.{c}").alias(c) for c in added],
    )


def latest_scores(log: DataFrame, names: Sequence[str], keys: Sequence[str] = IDENTITY, version: str = "version") -> DataFrame:
    """Append-only log -> one row per sample, each score from its newest version that has it."""
    require_identity(keys, log=log)
    newest = [F.max_by(n, F.when(F.col(n).isNotNull(), F.col(version))).alias(n) for n in names]
    return log.groupBy(*keys).agg(*newest)


def attach_scores(samples: DataFrame, scores: DataFrame, keys: Sequence[str] = IDENTITY) -> DataFrame:
    """Left join; samples without scores stay."""
    require_identity(keys, samples=samples, scores=scores)
    return samples.join(scores, list(keys), "left")


def merge_scores_json(meta: Column, scores: Sequence[str]) -> Column:
    """map<string,string> metadata with the non-null score columns written over it; NULL counts as empty.

    Names with `caption` in them stay text. Other values are stored as numbers where they are
    numbers and left as they are where they are not.
    """
    names, values = [], []
    for name in scores:
        text = F.col(name).cast("string")
        if "caption" not in name:
            text = F.coalesce(text.try_cast("double").cast("string"), text)
        names.append(F.lit(name))
        values.append(text)
    pairs = F.arrays_zip(F.array(*names).alias("k"), F.array(*values).alias("v"))
    update = F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))
    return _written_over(meta, update, "map<string,string>")


def merge_typed(meta: Column, scores: Sequence[str]) -> Column:
    """`merge_scores_json` for map<string,variant> metadata: numbers stay numbers, other fields untouched."""
    values = []
    for name in scores:
        text = F.col(name).cast("string").cast("variant")
        number = F.col(name).cast("string").try_cast("double").cast("variant")
        values.append(text if "caption" in name else F.coalesce(number, text))
    entries = [F.struct(F.lit(n).alias("k"), v.alias("v"), F.col(n).isNotNull().alias("set")) for n, v in zip(scores, values)]
    given = F.filter(F.array(*entries), lambda e: e["set"])
    update = F.map_from_entries(F.transform(given, lambda e: F.struct(e["k"], e["v"])))
    return _written_over(meta, update, "map<string,variant>")


def _written_over(meta: Column, update: Column, kind: str) -> Column:
    known = F.coalesce(meta, F.map_from_arrays(F.array(), F.array()).cast(kind))
    return let(update, lambda new: F.map_concat(F.map_filter(known, lambda k, _: ~F.map_contains_key(new, k)), new))
