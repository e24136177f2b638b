"""Bin edges over the distinct values of each score, and bucketising by them.

`edges` is exact on the full corpus. Float32 values are cut into buckets that follow the float
format itself (1/128 octave, so at most ~66 k distinct values each, whatever the distribution);
only the buckets that contain a wanted quantile rank are sorted.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

STRATEGIES = ("quantile", "uniform", "refined_quantile")


@dataclass(frozen=True)
class BinSpec:
    n_bins: int = 64
    strategy: str = "quantile"
    refine_last: int = 0
    refine_factor: int = 1

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"bin strategy {self.strategy!r} is not one of {', '.join(STRATEGIES)}")
        if self.actual < 2:
            raise ValueError("at least two bins are needed")

    @property
    def actual(self) -> int:
        """Number of bins after refinement; also the divisor used when bucketising."""
        if self.strategy == "refined_quantile" and self.refine_last > 0:
            return self.n_bins - self.refine_last + self.refine_last * self.refine_factor
        return self.n_bins

    @property
    def positions(self) -> list[float]:
        """Quantile positions of the edges."""
        if self.strategy != "refined_quantile" or self.refine_last == 0:
            return [i / self.n_bins for i in range(self.n_bins + 1)]
        coarse = [i / self.n_bins for i in range(self.n_bins - self.refine_last + 1)]
        steps = self.refine_last * self.refine_factor
        start = (self.n_bins - self.refine_last) / self.n_bins
        return coarse + [start + i * (1.0 - start) / steps for i in range(1, steps + 1)]


def to_long(scores: DataFrame, names: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Wide scores -> (ids, score_name, value)."""
    return scores.select(*ids, *[F.col(n).cast("float").alias(n) for n in names]).unpivot(
        list(ids), list(names), "score_name", "value"
    )


def distinct_values(scores_long: DataFrame) -> DataFrame:
    """Distinct finite-or-infinite float32 values per score; NULL and NaN carry no value."""
    value = F.col("value").cast("float")
    return (
        scores_long.select("score_name", value.alias("value"))
        .where(F.col("score_name").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
        .distinct()
    )


_MAX_FLOAT = 3.4028234663852886e38


def _float_bucket(v: Column) -> Column:
    """Monotone bucket number of a float32: 128 steps per octave, signed, zero in the middle."""
    # infinities share the step after the largest finite one
    size = F.least(F.abs(v.cast("double")), F.lit(2.0**128))
    step = F.floor(F.log2(size) * 128).cast("int") + 20000
    # never NULL: a join on it then adds no filter of its own, and both uses of the distinct values
    # stay the same plan, so Spark shuffles them once
    return F.coalesce(F.when(v > 0, step).when(v < 0, -step), F.lit(0))


def _histogram(marked: DataFrame) -> DataFrame:
    """One row per (score, bucket) with the rank its values start at and the score's totals.

    Bounded by the float format (about 65 k buckets per score), whatever the size of the corpus.
    """
    counts = marked.groupBy("score_name", "_b").agg(
        F.count(F.lit(1)).alias("_n"), F.min("value").alias("_min"), F.max("value").alias("_max")
    )
    score = Window.partitionBy("score_name")
    before = score.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        "score_name",
        "_b",
        "_n",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(score).alias("n_distinct"),
        F.min("_min").over(score).cast("double").alias("lo_v"),
        F.max("_max").over(score).cast("double").alias("hi_v"),
    )


def raw_edges(scores_long: DataFrame, spec: BinSpec) -> DataFrame:
    """(score_name, n_distinct, i, edge) before the ends are forced; exact at any size.

    An edge at quantile q lies between the two order statistics around q * (n - 1). Each histogram
    bucket lists the edges that need one of its values; only such buckets are ranked.
    """
    # equal widths need finite ends: an infinite one counts as the largest float
    ends = [F.greatest(F.least(F.col(c), F.lit(_MAX_FLOAT)), F.lit(-_MAX_FLOAT)) for c in ("lo_v", "hi_v")]
    linear = ends[0] + (ends[1] - ends[0]) * (F.col("i") / F.lit(spec.actual))
    values = distinct_values(scores_long)
    if spec.strategy == "uniform":
        stats = values.groupBy("score_name").agg(
            F.count(F.lit(1)).alias("n_distinct"),
            F.min("value").cast("double").alias("lo_v"),
            F.max("value").cast("double").alias("hi_v"),
        )
        grid = stats.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(spec.actual))))
        return grid.select("score_name", "n_distinct", "i", linear.cast("float").alias("edge"))

    marked = values.withColumn("_b", _float_bucket(F.col("value")))
    top = F.col("n_distinct") - 1

    def want(q: Column, i: Column) -> Column:
        lo = F.floor(q * top)
        return F.struct(
            i.alias("i"), (q * top - lo).alias("part"), lo.alias("lo"), F.least(lo + 1, top).alias("hi")
        )

    def inside(rank: Column) -> Column:
        return (rank >= F.col("_off")) & (rank < F.col("_off") + F.col("_n"))

    positions = F.expr(f"array({', '.join(f'{q!r}D' for q in spec.positions)})")
    wants = F.filter(F.transform(positions, want), lambda w: inside(w["lo"]) | inside(w["hi"]))
    needed = _histogram(marked).withColumn("wants", wants).where(F.size("wants") > 0)

    bucket = Window.partitionBy("score_name", "_b").orderBy("value")
    # broadcast: at most two buckets per edge and score
    ranked = marked.join(F.broadcast(needed.drop("_n")), ["score_name", "_b"]).withColumn(
        "rank", F.row_number().over(bucket) - 1 + F.col("_off")
    )
    hits = F.filter("wants", lambda w: (w["lo"] == F.col("rank")) | (w["hi"] == F.col("rank")))
    found = ranked.select("score_name", "n_distinct", "lo_v", "hi_v", "rank", "value", F.inline(hits))
    v = F.col("value").cast("double")
    ends = found.groupBy("score_name", "n_distinct", "lo_v", "hi_v", "i", "part").agg(
        F.max(F.when(F.col("lo") == F.col("rank"), v)).alias("v_lo"),
        F.max(F.when(F.col("hi") == F.col("rank"), v)).alias("v_hi"),
    )
    between = F.col("v_lo") + F.col("part") * (F.col("v_hi") - F.col("v_lo"))
    # no arithmetic where it would be infinity less infinity
    whole = (F.col("part") == 0) | (F.col("v_lo") == F.col("v_hi")) | (F.col("v_lo") == F.lit(float("-inf")))
    quantile = F.when(whole, F.col("v_lo")).otherwise(between)
    # too few distinct values for the wanted number of edges: equal widths instead
    edge = F.when(F.col("n_distinct") < spec.actual + 1, linear).otherwise(quantile)
    return ends.select("score_name", "n_distinct", "i", edge.cast("float").alias("edge"))


def finalise_edges(edges: Column) -> Column:
    """Ends forced to 0 and 1, then sorted and distinct; NULL when fewer than two remain."""
    last = F.size(edges) - 1
    forced = F.transform(
        edges,
        lambda e, i: F.when(i == last, F.lit(1.0)).when(i == 0, F.lit(0.0)).otherwise(e).cast("float"),
    )
    clean = F.array_sort(F.array_distinct(forced))
    return F.when(F.size(clean) >= 2, clean)


def compute_bins(scores_long: DataFrame, spec: BinSpec) -> DataFrame:
    """bins(score_name, edges, n_bins, strategy); a score without two edges has no row."""
    per_score = raw_edges(scores_long, spec).groupBy("score_name").agg(
        F.array_sort(F.collect_list(F.struct("i", "edge"))).alias("pairs")
    )
    return per_score.select(
        "score_name",
        finalise_edges(F.col("pairs.edge")).alias("edges"),
        F.lit(spec.actual).alias("n_bins"),
        F.lit(spec.strategy).alias("strategy"),
    ).where(F.col("edges").isNotNull())


# Far above any number of scorers; a larger table is hardly a bins table.
MAX_SCORES = 1000


def load_edges(bins: DataFrame, max_scores: int = MAX_SCORES) -> dict[str, list[float]]:
    """Bring the bins table to the driver: one short edge list per score.

    A table of more than `max_scores` scores is an error; raise the bound for it on purpose.
    """
    rows = bins.select("score_name", "edges").limit(max_scores + 1).collect()
    if len(rows) > max_scores:
        raise ValueError(f"more than {max_scores} scores in the bins table")
    return {r["score_name"]: list(r["edges"]) for r in rows}


def edges_below(df: DataFrame, edges: Mapping[str, Sequence[float]], outputs: Mapping[str, str]) -> DataFrame:
    """Add `outputs[name]`: how many edges of score `name` lie strictly below its value.

    The built-in Bucketizer is left-closed, these bins are right-closed; on negated values and
    edges the two agree, and its binary search stays in the JVM. NULL and NaN give NULL.
    """
    names = [n for n in outputs if n in edges]
    finite = {n: [e for e in edges[n] if math.isfinite(e)] for n in names}
    # an infinite edge needs no search: +inf is below nothing, -inf below all but itself
    lowest = {n: sum(e == -math.inf for e in edges[n]) for n in names}
    negated = df.withColumns({f"_neg_{n}": F.lit(0.0) - F.col(n).cast("float").cast("double") for n in names})
    if names:
        infinity = float("inf")
        negated = Bucketizer(
            splitsArray=[[-infinity, *sorted({0.0 - e for e in finite[n]}), infinity] for n in names],
            inputCols=[f"_neg_{n}" for n in names],
            outputCols=[f"_idx_{n}" for n in names],
            handleInvalid="keep",
        ).transform(negated)
    missing = F.lit(None).cast("int")
    counted = negated.withColumns(
        {
            out: F.when(
                F.col(n).isNotNull() & ~F.isnan(n),
                F.lit(len(set(finite[n]))) - F.col(f"_idx_{n}").cast("int") + F.when(F.col(n) > -math.inf, lowest[n]).otherwise(0),
            )
            if n in edges
            else missing
            for n, out in outputs.items()
        }
    )
    return counted.drop(*[f"_neg_{n}" for n in names], *[f"_idx_{n}" for n in names])


def bin_numbers(df: DataFrame, edges: Mapping[str, Sequence[float]], names: Sequence[str]) -> DataFrame:
    """Add `{score}_bin`; a value equal to an edge belongs to the lower bin."""
    counted = edges_below(df, edges, {n: f"{n}_bin" for n in names})
    # greatest() skips NULL, so a missing score is kept apart
    return counted.withColumns(
        {f"{n}_bin": F.when(F.col(f"{n}_bin") > 0, F.col(f"{n}_bin") - 1).otherwise(F.col(f"{n}_bin")) for n in names}
    )


def bucketise_scores(
    scores: DataFrame,
    edges: Mapping[str, Sequence[float]] | None,
    names: Sequence[str],
    n_bins: int,
    on_missing: str = "raw",
) -> DataFrame:
    """Add `{score}_coherence`: edges strictly below the value, shifted to start at 0, over n_bins - 1.

    `on_missing` says what a score without edges gives: the raw value, or zero. Without any edges
    (None) binning is off and raw values pass through. NULL or NaN in gives NaN out.
    """
    if on_missing not in ("raw", "zero"):
        raise ValueError("on_missing is 'raw' or 'zero'")
    known = edges or {}
    counted = edges_below(scores, known, {n: f"_below_{n}" for n in names if n in known})
    nan = F.lit(float("nan"))

    def coherence(name: str) -> Column:
        v = F.col(name).cast("float").cast("double")
        if name in known:
            out = F.greatest(F.col(f"_below_{name}") - 1, F.lit(0)) / F.lit(float(n_bins - 1))
        elif edges is None or on_missing == "raw":
            out = v
        else:
            out = F.lit(0.0)
        return F.when(v.isNull() | F.isnan(v), nan).otherwise(out).cast("float")

    return counted.withColumns({f"{n}_coherence": coherence(n) for n in names}).drop(
        *[f"_below_{n}" for n in names]
    )


@dataclass(frozen=True)
class BinsConfig:
    """What identifies a stored bins table."""

    spec: BinSpec
    scores: tuple[str, ...]
    synthetic_prob: float = 0.0

    @property
    def tag(self) -> str:
        parts = [f"bins{self.spec.n_bins}", "-".join(sorted(self.scores))]
        if self.spec.strategy != "quantile":
            parts.append(self.spec.strategy)
        if self.spec.strategy == "refined_quantile":
            parts.append(f"last{self.spec.refine_last}x{self.spec.refine_factor}")
        if self.synthetic_prob > 0:
            parts.append(f"syn{self.synthetic_prob}")
        return "_".join(parts)


def covers(bins: DataFrame, scores: Sequence[str]) -> DataFrame:
    """One row `ok`: does the table hold exactly the requested scores?"""
    wanted = F.array_sort(F.array(*[F.lit(s) for s in scores]))
    return bins.agg((F.array_sort(F.collect_set("score_name")) == wanted).alias("ok"))


def load_or_compute_bins(scores_long: DataFrame, config: BinsConfig, root: str) -> DataFrame:
    """Stored bins if their key set is exactly the requested one, else computed and stored."""
    spark = scores_long.sparkSession
    path = f"{root.rstrip('/')}/{config.tag}"
    schema = "score_name string, edges array<float>, n_bins int, strategy string"
    try:
        stored = spark.read.schema(schema).parquet(path)
        if covers(stored, config.scores).first()["ok"]:
            return stored
    except AnalysisException:
        pass  # nothing stored yet
    chosen = scores_long.where(F.col("score_name").isin(*config.scores))
    compute_bins(chosen, config.spec).write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)
