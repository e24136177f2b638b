"""Bin edges and bucketising (E1-E9) over derived scores and over whole price columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from scorelake.operators import bins as B
from scorelake.queries.fixtures import table, view
from scorelake.queries.registry import query
from scorelake.schema import SCORES
from scorelake.session import shared_folder

N = 64

# long form of the seven scores in the oracle
_LONG = (
    "long as ("
    + " union all ".join(
        f"select key, '{s}' as score_name, {s} as value from scores_v" for s in SCORES
    )
    + ")"
)
_Q = "[" + ",".join(repr(i / N) for i in range(N + 1)) + "]"


def _edges_ctes(positions: list[float], n_bins: int) -> str:
    """DuckDB: raw edges of every score, with the equal-width fallback."""
    q = "[" + ",".join(f"{p!r}::double" for p in positions) + "]"
    return f"""
dv as (select distinct score_name, value from long where value is not null and not isnan(value)),
st as (select score_name, count(*) as n_distinct, min(value)::double as lo_v, max(value)::double as hi_v,
         quantile_cont(value::double, {q}) as qs from dv group by score_name),
raw as (select score_name, n_distinct, i,
         (case when n_distinct < {n_bins + 1} then lo_v + (hi_v - lo_v) * (i::double / {float(n_bins)}::double)
               else qs[i + 1] end)::float as edge
       from st, range({n_bins + 1}) t(i))"""


_FINAL = """
fin as (select score_name, list_sort(list_distinct(list(case when i = {n} then 1.0::float when i = 0 then 0.0::float
          else edge end))) as edges from raw group by score_name),
bins as (select score_name, edges from fin where len(edges) >= 2)"""


def _long(spark: SparkSession, sf: str) -> DataFrame:
    return B.to_long(view(spark, sf, "scores_v"), SCORES, ["key"])


def _exploded(bins: DataFrame) -> DataFrame:
    return bins.select("score_name", F.posexplode("edges").alias("i", "edge")).select(
        "score_name",
        F.col("i").cast("long").alias("i"),
        F.round(F.col("edge").cast("double"), 6).alias("edge"),
    )


def _raw(df: DataFrame) -> DataFrame:
    return df.select(
        "score_name",
        "n_distinct",
        F.col("i").cast("long").alias("i"),
        F.round(F.col("edge").cast("double"), 6).alias("edge"),
    )


_RAW_OUT = "select score_name, n_distinct, i, round(edge::double, 6) as edge from raw"
_FIN_OUT = """select score_name, (g.i - 1) as i, round(edges[g.i]::double, 6) as edge
from bins, lateral (select unnest(range(1, len(edges) + 1)) as i) g"""

_QUANTILE = B.BinSpec(N)
_REFINED = B.BinSpec(N, "refined_quantile", refine_last=8, refine_factor=4)


@query(f"with {_LONG}, {_edges_ctes(_QUANTILE.positions, N)} {_RAW_OUT}")
def bins_quantile_edges(spark, sf):
    return _raw(B.raw_edges(_long(spark, sf), _QUANTILE))


@query(
    f"""with {_LONG}, st as (select score_name, count(distinct value) as n_distinct, min(value)::double as lo_v,
      max(value)::double as hi_v from long where value is not null and not isnan(value) group by score_name)
    select score_name, n_distinct, i, round((lo_v + (hi_v - lo_v) * (i::double / 64.0::double))::float::double, 6) as edge
    from st, range({N + 1}) t(i)"""
)
def bins_uniform_edges(spark, sf):
    return _raw(B.raw_edges(_long(spark, sf), B.BinSpec(N, "uniform")))


@query(f"with {_LONG}, {_edges_ctes(_REFINED.positions, _REFINED.actual)} {_RAW_OUT}")
def bins_refined_edges(spark, sf):
    return _raw(B.raw_edges(_long(spark, sf), _REFINED))


@query(f"with {_LONG}, {_edges_ctes(_QUANTILE.positions, N)}, {_FINAL.format(n=N)} {_FIN_OUT}")
def bins_finalise_edges(spark, sf):
    return _exploded(B.compute_bins(_long(spark, sf), _QUANTILE))


@query(f"with {_LONG}, {_edges_ctes(_QUANTILE.positions, N)}, {_FINAL.format(n=N)} {_FIN_OUT}")
def bins_stored_edges(spark, sf):
    """A store of six scores does not serve seven: their edges are computed anew, and then read without the scores."""
    config, root = B.BinsConfig(_QUANTILE, tuple(SCORES)), f"{shared_folder(spark).rstrip('/')}/bins-{uuid.uuid4().hex}"
    long = _long(spark, sf)
    B.compute_bins(long.where(F.col("score_name") != SCORES[0]), _QUANTILE).write.parquet(f"{root}/{config.tag}")
    B.load_or_compute_bins(long, config, root)
    return _exploded(B.load_or_compute_bins(long.limit(0), config, root))


_PRICE = "long as (select 'l_extendedprice' as score_name, l_extendedprice::float as value from lineitem)"


@query(f"with {_PRICE}, {_edges_ctes(_QUANTILE.positions, N)} {_RAW_OUT}")
def bins_price_edges(spark, sf):
    """Quantiles over a large column with values far outside [0, 1]."""
    prices = table(spark, sf, "lineitem").select(
        F.lit("l_extendedprice").alias("score_name"), F.col("l_extendedprice").alias("value")
    )
    return _raw(B.raw_edges(prices, _QUANTILE))


_FEW = "long as (select 'l_tax' as score_name, l_tax::float as value from lineitem)"


@query(f"with {_FEW}, {_edges_ctes(_QUANTILE.positions, N)}, {_FINAL.format(n=N)} {_FIN_OUT}")
def bins_fallback_uniform(spark, sf):
    """Fewer distinct values than edges: equal widths."""
    taxes = table(spark, sf, "lineitem").select(
        F.lit("l_tax").alias("score_name"), F.col("l_tax").alias("value")
    )
    return _exploded(B.compute_bins(taxes, _QUANTILE))


_BINNED = f"""with {_LONG}, {_edges_ctes(_QUANTILE.positions, N)}, {_FINAL.format(n=N)},
hit as (select key, l.score_name, value, len(list_filter(edges, lambda e: e < value)) as below
        from long l join bins b on l.score_name = b.score_name)"""


@query(
    f"""{_BINNED} select key, """
    + ", ".join(
        f"max(case when score_name = '{s}' then round((greatest(below - 1, 0) / 63.0::double)::float::double, 6) end) as {s}_coherence"
        for s in SCORES
    )
    + " from hit group by key"
)
def bucketise_scores(spark, sf):
    scores = view(spark, sf, "scores_v")
    edges = B.load_edges(B.compute_bins(B.to_long(scores, SCORES, ["key"]), _QUANTILE))
    out = B.bucketise_scores(scores, edges, SCORES, N)
    return out.select(
        "key", *[F.round(F.col(f"{s}_coherence").cast("double"), 6).alias(f"{s}_coherence") for s in SCORES]
    )


_REF_COHERENCE = f"""with {_LONG}, {_edges_ctes(_REFINED.positions, _REFINED.actual)}, {_FINAL.format(n=_REFINED.actual)},
hit as (select key, len(list_filter(edges, lambda e: e < value)) as below
        from long l join bins b on l.score_name = b.score_name where l.score_name = 'clip_score')"""


@query(
    f"""{_REF_COHERENCE} select h.key, round((greatest(below - 1, 0) / {float(_REFINED.actual - 1)}::double)::float::double, 6) as clip,
  round(vqa_score::double, 6) as vqa_raw, 0.0::double as vqa_zero from hit h join scores_v s on h.key = s.key"""
)
def bins_missing_policy(spark, sf):
    """Refined bins for one score; the other has none: its raw value, or zero."""
    names = ["clip_score", "vqa_score"]
    scores = view(spark, sf, "scores_v").select("key", *names)
    edges = B.load_edges(B.compute_bins(B.to_long(scores, names[:1], []), _REFINED))
    raw = B.bucketise_scores(scores, edges, names, _REFINED.actual).withColumnRenamed("vqa_score_coherence", "vqa_raw")
    both = B.bucketise_scores(raw, edges, ["vqa_score"], _REFINED.actual, on_missing="zero")
    out = {"clip": "clip_score_coherence", "vqa_raw": "vqa_raw", "vqa_zero": "vqa_score_coherence"}
    return both.select("key", *[F.round(F.col(c).cast("double"), 6).alias(n) for n, c in out.items()])


@query(
    f"{_BINNED} select score_name, greatest(below - 1, 0)::bigint as bin, count(*) as n from hit group by all"
)
def bin_histogram(spark, sf):
    """Flagship: scores -> distinct -> exact quantile edges -> bins -> rows per bin."""
    scores = view(spark, sf, "scores_v").select(*SCORES)
    edges = B.load_edges(B.compute_bins(B.to_long(scores, SCORES, []), _QUANTILE))
    binned = B.bin_numbers(scores, edges, SCORES).select(*[F.col(f"{s}_bin").alias(s) for s in SCORES])
    return (
        binned.unpivot([], list(SCORES), "score_name", "bin")
        .where(F.col("bin").isNotNull())
        .groupBy("score_name", F.col("bin").cast("long").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
