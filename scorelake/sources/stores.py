"""Stored results: enriched corpora, corpus sizes, finished scoring stages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scorelake.functions.vectors import trim_to_mask
from scorelake.operators.sampling import corpus_size
from scorelake.operators.scores import IDENTITY, attach_scores, merge_typed, require_identity
from scorelake.operators.shards import shard_table


def write_enriched(
    samples: DataFrame,
    scores: DataFrame,
    score_names: Sequence[str],
    path: str,
    embeddings: Sequence[tuple[str, str]] = (),
) -> None:
    """Decoded samples with scores merged into their JSON and embeddings trimmed to real tokens.

    Every field of the JSON keeps its type: `other` holds variants.

    `embeddings` lists (tokens column, mask column). One folder per input shard; rows are
    rebalanced by shard, so a large shard is written by several tasks.
    """
    require_identity(IDENTITY, scores=scores)
    joined = attach_scores(samples, scores.select(*IDENTITY, *score_names))
    merged = joined.withColumn("meta_map", merge_typed(F.col("other"), score_names)).drop(*score_names)
    for tokens, mask in embeddings:
        merged = merged.withColumn(tokens, trim_to_mask(F.col(tokens), F.col(mask))).drop(mask)
    out = merged.withColumn("json", F.to_json("meta_map")).drop("meta_map", "meta", "other", "bad_json")
    out.hint("rebalance", "shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def load_or_build_index(members: DataFrame, path: str) -> DataFrame:
    """Stored shard index (shard, nsamples) of a corpus, or one counted from member names and stored."""
    spark = members.sparkSession
    try:
        return spark.read.schema("shard string, nsamples long").parquet(path)
    except AnalysisException:
        shard_table(members).write.mode("overwrite").parquet(path)
        return spark.read.schema("shard string, nsamples long").parquet(path)


@dataclass(frozen=True)
class SizeKey:
    min_size: int
    min_clip: float
    min_aesthetic: float

    @property
    def tag(self) -> str:
        return f"size{self.min_size}_clip{self.min_clip}_aes{self.min_aesthetic}"


_SIZES = "root string, total_size long"


def stored_size(spark: SparkSession, store: str, key: SizeKey, roots: Sequence[str]) -> int | None:
    """Sum over roots, only if every root has a stored size."""
    try:
        rows = read_sizes(spark, store, key).where(F.col("root").isin(*roots))
        found = rows.agg(F.count("total_size"), F.sum("total_size")).first()
    except AnalysisException:
        return None  # nothing stored yet
    return int(found[1]) if found[0] == len(set(roots)) else None


def store_size(spark: SparkSession, store: str, key: SizeKey, root: str, size: int) -> None:
    store_sizes(spark.createDataFrame([(root, size)], _SIZES), store, key)


def store_sizes(sizes: DataFrame, store: str, key: SizeKey) -> None:
    """Append (root, total_size) rows."""
    sizes.select("root", F.col("total_size").cast("bigint").alias("total_size")).write.mode("append").parquet(
        f"{store}/{key.tag}"
    )


def read_sizes(spark: SparkSession, store: str, key: SizeKey) -> DataFrame:
    rows = spark.read.schema(_SIZES).parquet(f"{store}/{key.tag}")
    return rows.groupBy("root").agg(F.max("total_size").alias("total_size"))


def size_of(samples: DataFrame, keep: Column, store: str, key: SizeKey, root: str) -> int:
    """Stored filtered size of one root, or a count that is then stored."""
    known = stored_size(samples.sparkSession, store, key, [root])
    if known is not None:
        return known
    size = int(corpus_size(samples, keep).first()["n"])
    store_size(samples.sparkSession, store, key, root, size)
    return size


def flush_scores(values: DataFrame, scorer: str, store: str) -> None:
    """Write one scorer's (shard, key, value) rows, then mark it finished; a rerun replaces both."""
    require_identity(IDENTITY, values=values)
    values.select(*IDENTITY, "value").write.mode("overwrite").parquet(f"{store}/values/score_name={scorer}")
    done = values.sparkSession.createDataFrame([(scorer,)], "scorer string")
    done.write.mode("overwrite").parquet(f"{store}/done/{scorer}")


def finished_scorers(spark: SparkSession, store: str, names: Sequence[str]) -> list[str]:
    done = []
    for name in names:  # one tiny marker per scorer
        try:
            spark.read.schema("scorer string").parquet(f"{store}/done/{name}")
            done.append(name)
        except AnalysisException:
            pass
    return done


def read_flushed(spark: SparkSession, store: str, names: Sequence[str]) -> DataFrame:
    """(shard, key, score_name, value) of finished scorers only."""
    done = finished_scorers(spark, store, names)
    schema = "shard string, key string, value double, score_name string"
    if not done:
        return spark.createDataFrame([], schema)
    paths = [f"{store}/values/score_name={n}" for n in done]
    return spark.read.schema(schema).option("basePath", f"{store}/values").parquet(*paths)
