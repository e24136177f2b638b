"""Generation requests and shard lists from patterns and descriptors."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from scorelake.functions.captions import image_path
from scorelake.plans.patterns import parse, strings


def repeat_rows(df: DataFrame, n: int, name: str = "sample") -> DataFrame:
    """Every row n times, numbered from 0; a generator inside the row, no join."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def sample_requests(prompts: DataFrame, n: int, prompt_idx: str = "prompt_idx") -> DataFrame:
    """n image requests per prompt with their paths."""
    return repeat_rows(prompts, n).withColumn("path", image_path(F.col(prompt_idx), F.col("sample")))


def prompts_json(
    prompts: DataFrame,
    prompt: str = "Prompt",
    optional: Sequence[str] = ("Category", "Challenge", "Note"),
    keep: Sequence[str] = (),
) -> DataFrame:
    """One JSON object per prompt; optional fields in lower case, left out when NULL."""
    if prompt not in prompts.columns:
        raise ValueError(f"no column {prompt!r}; available: {prompts.columns}")
    fields = [F.col(prompt).alias("prompt")]
    fields += [F.col(c).alias(c.lower()) for c in optional if c in prompts.columns]
    return prompts.select(*keep, F.to_json(F.struct(*fields)).alias("json"))


def expand_pattern(
    patterns: DataFrame, pattern: str = "urls", weights: str | None = "weights", chunk: int = 10_000
) -> DataFrame:
    r"""`a{00..12}.tar::b{x,y}.tar` with weights `1::2` -> a row per URL with its component's weight.

    Brace groups: number runs (zero padding kept, optional step), letter runs, comma lists, any of them inside
    lists; any number of groups per component, the leftmost varying slowest; `\` takes a character literally.
    A component is parsed once and cut into chunks of its indices, which all tasks expand, so one pattern of
    many URLs is not one task's work. Adds part, place (choices met from left to right: the order inside the
    part), weight and url. A null pattern gives no row, unbalanced braces and a weight that is no number are errors.
    """
    parts = F.split(pattern, "::")
    if weights is None:
        paired = patterns.select("*", F.posexplode(parts).alias("part", "url")).withColumn(
            "weight", F.lit(None).cast("double")
        )
    else:
        w = F.split(weights, "::")
        message = F.concat(
            F.lit("components ("), F.size(parts), F.lit(") and weights ("), F.size(w), F.lit(") must match")
        )
        zipped = F.when(F.size(parts) == F.size(w), F.arrays_zip(parts.alias("u"), w.alias("w"))).otherwise(
            F.raise_error(message)
        )
        paired = (
            patterns.select("*", F.posexplode(zipped).alias("part", "_z"))
            .withColumn("url", F.col("_z.u"))
            .withColumn("weight", F.col("_z.w").cast("double"))
            .drop("_z")
        )
    sized = paired.withColumn("_n", _pattern_size("url"))
    last = F.floor((F.col("_n") - 1) / chunk)
    chunks = sized.where(F.col("_n") > 0).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    spread = chunks.repartition("part", "url", "_chunk")
    found = F.explode(_pattern_strings("url", F.col("_chunk") * chunk, (F.col("_chunk") + 1) * chunk)).alias("_s")
    kept = [c for c in spread.columns if c not in ("url", "_n", "_chunk")]
    return spread.select(*kept, found).select(*kept, F.col("_s.url").alias("url"), F.col("_s.place").alias("place"))


@F.pandas_udf(T.LongType())
def _pattern_size(pattern: pd.Series) -> pd.Series:
    return pattern.map(lambda p: 0 if p is None else parse(p).size).astype("int64")


_STRINGS = T.ArrayType(T.StructType().add("url", "string").add("place", T.ArrayType(T.IntegerType())))


@F.pandas_udf(_STRINGS)
def _pattern_strings(pattern: pd.Series, start: pd.Series, stop: pd.Series) -> pd.Series:
    return pd.Series(
        [[{"url": u, "place": c} for u, c in strings(*row)] for row in zip(pattern, start, stop)], dtype="object"
    )


_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)((?:[?#].*)?)$"


def _normal_path(path: Column) -> Column:
    """`a/./b/../c` -> `a/c`, folding one segment at a time."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            (p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)
        )
        .when((p == "..") & path.startswith("/"), acc)
        .otherwise(F.concat(acc, F.array(p))),
    )
    root = F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(root, F.array_join(folded, "/"))


def rebase_url(base: Column, url: Column) -> Column:
    """Relative URLs move below `base`; an absolute path wins; scheme and host are inherited."""

    def part(u: Column, i: int) -> Column:
        return F.regexp_extract(u, _URL, i)

    path = part(url, 3)
    base_path = part(base, 3)
    joined = F.when((base_path == "") | base_path.endswith("/"), F.concat(base_path, path)).otherwise(
        F.concat(base_path, F.lit("/"), path)
    )
    merged = F.when(path.startswith("/"), path).otherwise(_normal_path(joined))
    scheme = F.when(part(url, 1) != "", part(url, 1)).otherwise(part(base, 1))
    host = F.when(part(url, 2) != "", part(url, 2)).otherwise(part(base, 2))
    return F.when(base.isNull(), url).otherwise(
        F.concat(
            F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
            F.when(host != "", F.concat(F.lit("//"), host)).otherwise(F.lit("")),
            merged,
            part(url, 4),
        )
    )


def url_folder(url: Column) -> Column:
    """The URL without its last path part."""
    return F.concat(F.regexp_extract(url, r"^((?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?)", 1),
                    F.regexp_replace(F.regexp_extract(url, _URL, 3), r"/?[^/]*$", ""))


def flatten_descriptor(descriptors: DataFrame, remote: DataFrame | None = None, base: str | None = None) -> DataFrame:
    """Descriptor documents -> one row per shard (url, nsamples, weight, name, source_url, dataset).

    `remote(location, ...)` holds the descriptors that components point to by URL. Fields a shard
    already has win; a component's own weight wins over that of the file it points to. Faulty
    documents raise when they are read: wrong version, no shard list, a shard without URL or count,
    a component that points to a file which points on. `require_shards` rejects an empty result.
    """
    version = F.when(F.coalesce(F.col("wids_version") == 1, F.lit(False)), F.col("wids_version")).otherwise(
        F.raise_error(F.lit("dataset description must have wids_version 1"))
    )
    docs = descriptors.withColumn("wids_version", version).where(F.col("wids_version") == 1)
    own = docs.select(
        F.col("name").alias("_name"), F.col("weight").alias("_weight"), F.explode("shardlist").alias("s")
    ).select(
        rebase_url(F.lit(base).cast("string"), F.col("s.url")).alias("url"),
        "s.nsamples",
        F.coalesce("s.weight", "_weight").alias("weight"),
        F.coalesce("s.name", "_name").alias("name"),
        "s.source_url",
        "s.dataset",
    )
    parts = docs.select(F.explode("datasets").alias("c")).select("c.*")
    inline = parts.where(F.col("source_url").isNull())
    out = own.unionByName(_component_shards(inline, F.col("base")))
    if remote is not None:
        # one row per component and per referenced file: both are short lists
        onward = F.when(
            F.col("source_url").isNotNull(), F.raise_error(F.lit("a referenced descriptor refers to another one"))
        )
        fetched = remote.select(
            F.col("location").alias("source_url"), F.col("name").alias("r_name"), F.col("base").alias("r_base"),
            F.coalesce(onward, F.col("shardlist")).alias("r_list"),
        )
        linked = parts.where(F.col("source_url").isNotNull()).drop("name", "base", "shardlist")
        linked = linked.join(fetched, "source_url").select(
            "source_url", "weight", F.col("r_name").alias("name"), F.col("r_base").alias("base"),
            F.col("r_list").alias("shardlist"),
        )
        out = out.unionByName(
            _component_shards(linked, F.coalesce("base", url_folder(F.col("source_url"))))
        )
    faulty = F.col("url").isNull() | F.col("nsamples").isNull()
    checked = F.when(~faulty, F.col("url")).otherwise(F.raise_error(F.lit("a shard needs url and nsamples")))
    return out.withColumn("url", checked)


def require_shards(shardlist: DataFrame) -> DataFrame:
    if shardlist.isEmpty():
        raise ValueError("no shards found")
    return shardlist


def _component_shards(parts: DataFrame, base: Column) -> DataFrame:
    listed = F.when(F.col("shardlist").isNotNull(), F.col("shardlist")).otherwise(
        F.raise_error(F.lit("the descriptor lists no shards"))
    )
    return parts.select(
        base.alias("_base"), F.col("weight").alias("_weight"), F.col("name").alias("_name"),
        F.col("source_url").alias("_source"), F.explode(listed).alias("s"),
    ).select(
        rebase_url(F.col("_base"), F.col("s.url")).alias("url"),
        "s.nsamples",
        F.coalesce("s.weight", "_weight").alias("weight"),
        "s.name",
        F.coalesce("s.source_url", "_source").alias("source_url"),
        F.coalesce("s.dataset", "_name").alias("dataset"),
    )
