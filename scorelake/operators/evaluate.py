"""Roll-ups of evaluation tables and metric monitoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from scorelake.operators.ranks import ordered_index
from scorelake.schema import EVAL_SCORERS


def scorer_columns(df: DataFrame) -> list[str]:
    """Known scorers in reporting order, then any other column that is not a name."""
    known = [c for c in EVAL_SCORERS if c in df.columns]
    return known + [c for c in df.columns if c not in {"filename", "prompt", *known}]


def _long(images: DataFrame, ids: Sequence[str]) -> DataFrame:
    names = scorer_columns(images)
    picked = images.select(*ids, *[F.col(n).cast("double").alias(n) for n in names])
    return picked.unpivot(list(ids), names, "scorer", "value")


def reward_summary(images: DataFrame) -> DataFrame:
    """Per scorer: mean, sample deviation, images, distinct prompts; missing values are counted apart."""
    prompts = images.select("prompt").distinct().agg(F.count(F.lit(1)).alias("n_prompts"))
    per_scorer = _long(images, []).groupBy("scorer").agg(
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.count(F.lit(1)).alias("n_images"),
        F.count_if(F.col("value").isNull()).alias("n_missing"),
    )
    # a scalar: distinct prompts are the same number for every scorer
    return per_scorer.withColumn("n_prompts", prompts.scalar())


def per_prompt_mean(images: DataFrame) -> DataFrame:
    """Per scorer: the mean over prompts of the mean over a prompt's images."""
    names = scorer_columns(images)
    per_prompt = images.groupBy("prompt").agg(*[F.avg(n).alias(n) for n in names])
    return _long(per_prompt, []).groupBy("scorer").agg(F.avg("value").alias("per_prompt_mean"))


def mean_scores(images: DataFrame) -> DataFrame:
    names = scorer_columns(images)
    return images.agg(*[F.avg(n).alias(n) for n in names], F.count(F.lit(1)).alias("n_images"))


def prompts_grid(outputs: DataFrame, k: int, arrival: str, value: str, prompt: str = "prompt") -> DataFrame:
    """Up to k outputs per prompt, in arrival order.

    The rank filter lets Spark keep only k rows per prompt in every task before it shuffles.
    """
    window = Window.partitionBy(prompt).orderBy(arrival)
    first = outputs.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= k)
    packed = first.groupBy(prompt).agg(F.array_sort(F.collect_list(F.struct("_rn", value))).alias("_g"))
    return packed.select(prompt, F.col(f"_g.{value}").alias("outputs"))


def task_accuracy(verdicts: DataFrame, tag: str = "tag") -> DataFrame:
    """Per tag: images, correct ones and their share; first-seen order is not kept by a table."""
    return verdicts.groupBy(tag).agg(
        F.count(F.lit(1)).alias("n_images"),
        F.sum(F.col("correct").cast("int")).alias("n_correct"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
    )


def task_accuracy_ordered(verdicts: DataFrame, arrival: str, tag: str = "tag") -> DataFrame:
    """`task_accuracy` with `place`: 0 for the tag that is seen first, by `arrival`; tags that tie go by name."""
    firsts = verdicts.groupBy(tag).agg(F.min(arrival).alias("_first"))
    # one row per tag
    places = ordered_index(firsts, ["_first", tag], "place").drop("_first")
    counted, at = task_accuracy(verdicts, tag), places.withColumnRenamed(tag, "_tag")
    return counted.join(at, F.col(tag).eqNullSafe(F.col("_tag"))).drop("_tag")


def task_overall(verdicts: DataFrame, tag: str = "tag", spec: str = "metadata") -> DataFrame:
    """One row: totals, share of correct images and specs, unweighted mean over tags.

    Verdicts are read once: counts per (tag, spec), then per tag and per spec in one grouping.
    """
    counts = verdicts.groupBy(F.col(tag).alias("_t"), F.col(spec).alias("_s")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("correct").cast("int")).alias("_c")
    )
    both = counts.groupingSets([[F.col("_t")], [F.col("_s")]], F.col("_t"), F.col("_s")).agg(
        F.grouping("_t").alias("_is_spec"), F.sum("_n").alias("_n"), F.sum("_c").alias("_c")
    )
    by_tag, by_spec = F.col("_is_spec") == 0, F.col("_is_spec") == 1
    n, c = F.sum(F.when(by_tag, F.col("_n"))), F.sum(F.when(by_tag, F.col("_c")))
    return both.agg(
        n.alias("n_images"),
        (c / n).alias("correct_images"),
        F.count_if(by_spec).alias("n_prompts"),
        F.avg(F.when(by_spec, (F.col("_c") > 0).cast("double"))).alias("correct_prompts"),
        F.avg(F.when(by_tag, F.col("_c") / F.col("_n"))).alias("overall"),
    )


def is_finite(c):
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def nonfinite_runs(metrics: DataFrame, k: int = 5, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Runs of consecutive non-finite values per series: start, length, and whether they alarm.

    Inside a run, position among all rows and position among the non-finite rows grow together, so
    their difference names the run. Both positions come from range-partitioned indexes: no window
    spans a series.
    """
    flagged = metrics.select("series", *order, is_finite(F.col("value")).alias("finite"))
    indexed = ordered_index(flagged, ["series", *order], "pos")
    bad = ordered_index(indexed.where(~F.col("finite")), ["series", "pos"], "bad_pos")
    runs = bad.groupBy("series", (F.col("pos") - F.col("bad_pos")).alias("run")).agg(
        F.min(F.struct(*order)).alias("first"),
        F.count(F.lit(1)).alias("length"),
    )
    return runs.select(
        "series", *[F.col(f"first.{c}").alias(f"start_{c}") for c in order], "length",
        (F.col("length") >= k).alias("alarm"),
    )


def nonfinite_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN and infinities -> 0; NULL stays."""
    return df.withColumns(
        {c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(F.col(c)) for c in columns}
    )


def nonfinite_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: how many NaN and how many infinite values; one aggregation over all columns."""
    flags = [
        F.struct(
            F.lit(c).alias("column"),
            F.count_if(F.isnan(c)).alias("n_nan"),
            F.count_if(F.abs(c) == float("inf")).alias("n_inf"),
        )
        for c in columns
    ]
    return df.agg(F.array(*flags).alias("r")).select(F.inline("r"))


def metric_steps(steps: DataFrame) -> DataFrame:
    """(series, epoch, step, mean, n, ranks): one value per step, batch-size weighted over the ranks that report one.

    A rank whose value or batch size is NULL does not count; a step without any has a NULL mean and n = 0.
    """
    counts = F.col("value").isNotNull() & F.col("n").isNotNull()
    n = F.coalesce(F.sum(F.when(counts, F.col("n"))), F.lit(0))
    return steps.groupBy("series", "epoch", "step").agg(
        F.try_divide(F.sum(F.when(counts, F.col("value") * F.col("n"))), n).alias("mean"), n.alias("n"), F.count_if(counts).alias("ranks")
    )


def metric_means(steps: DataFrame) -> DataFrame:
    """(series, epoch, value, n): batch-size weighted mean per series and epoch, over all ranks."""
    return steps.groupBy("series", "epoch").agg(
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("n")
    )
