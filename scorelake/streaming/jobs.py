"""Streams over newly arriving samples, scores and metrics.

Every sink write is keyed by the micro-batch number, so a batch that is replayed after a failure
replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from scorelake.functions.captions import clean_caption
from scorelake.functions.quality import has_image_and_caption
from scorelake.operators.bins import bucketise_scores
from scorelake.operators.evaluate import is_finite
from scorelake.operators.ranks import ordered_index
from scorelake.operators.scores import latest_scores
from scorelake.sources.samples import decode_json, read_samples


def _drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run over everything that has arrived, in as many micro-batches as needed."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.foreachBatch(sink).trigger(availableNow=True).start()


def _batch_table(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def stream_enrich(
    samples: DataFrame,
    edges: Mapping[str, Sequence[float]],
    names: Sequence[str],
    n_bins: int,
    keep: Column,
    out: str,
    checkpoint: str,
    score: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Arriving samples cleaned, scored, filtered and bucketised, appended to `out`.

    `score` adds the score columns to complete samples (a row-wise step such as `score_column` does);
    without it the samples bring them along. `keep` may read what it adds.
    """
    ready = samples.where(has_image_and_caption(F.col("has_image"), F.col("txt")))
    ready = ready.withColumn("txt", clean_caption(F.col("txt")))
    ready = (score(ready) if score else ready).where(keep)
    return _drain(bucketise_scores(ready, edges, names, n_bins), _batch_table(out), checkpoint)


def stream_archives(members: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Samples of archives as they arrive (`stream_members`), grouped and decoded, to `out`.

    An archive comes whole within one micro-batch, so its samples are complete there.
    """

    def write(batch: DataFrame, number: int) -> None:
        _batch_table(out)(decode_json(read_samples(batch)), number)

    return _drain(members, write, checkpoint)


def stream_upsert_scores(scores: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Arriving score rows appended as numbered versions; `latest_scores` over `out` is the table.

    Appending keeps a batch's cost in proportion to the batch; rewriting the table would not.
    """
    return _drain(scores, _batch_table(out), checkpoint)


def compact_versions(spark: SparkSession, out: str, schema: str, names: Sequence[str], into: str) -> DataFrame:
    """The log of `stream_upsert_scores` as a table of one row per sample, written to `into`.

    Read `into` beside the batches that came later; it stands for all versions it has seen, which may
    then be removed. A second call with another folder starts from the log again.
    """
    log = read_versions(spark, out, schema)
    newest = log.agg(F.max("version")).first()[0]
    latest_scores(log, names).withColumn("version", F.lit(newest)).write.mode("overwrite").parquet(into)
    return spark.read.schema(f"{schema}, version int").parquet(into)


def read_versions(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """The log of `stream_upsert_scores`: its rows with `version` = micro-batch number."""
    rows = spark.read.schema(f"{schema}, batch int").parquet(out)
    return rows.withColumnRenamed("batch", "version")


def stream_reward_summary(images: DataFrame, names: Sequence[str], out: str, checkpoint: str) -> StreamingQuery:
    """Running mean, deviation and count per scorer; every micro-batch writes the whole small table."""
    long = images.select(*[F.col(n).cast("double").alias(n) for n in names]).unpivot([], list(names), "scorer", "value")
    summary = long.groupBy("scorer").agg(
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.count("value").alias("n"),
    )
    return _drain(summary, _batch_table(out), checkpoint, mode="complete")


def read_summary(spark: SparkSession, out: str) -> DataFrame:
    """The newest table of `stream_reward_summary`."""
    rows = spark.read.schema("scorer string, mean double, std double, n long, batch int").parquet(out)
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).scalar()).drop("batch")


def stream_nonfinite_alarm(metrics: DataFrame, out: str, checkpoint: str, k: int = 5) -> StreamingQuery:
    """Alarm rows: the k-th non-finite value in a row of a series, also across micro-batches.

    State is one row per series: how many non-finite values its last batch ended with. Runs inside
    a batch come from range-partitioned positions, so a busy series is not one task's work.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        carried = None
        if number > 0:
            carried = spark.read.schema("series string, tail long").parquet(f"{out}/state/batch={number - 1}")
        alarms, state = alarm_step(batch, carried, k)
        alarms.write.mode("overwrite").parquet(f"{out}/alarms/batch={number}")
        state.write.mode("overwrite").parquet(f"{out}/state/batch={number}")

    return _drain(metrics, sink, checkpoint)


def alarm_step(batch: DataFrame, carried: DataFrame | None, k: int) -> tuple[DataFrame, DataFrame]:
    """(alarms, new state) of one batch of (series, ts, event_id, value) after state `carried`."""
    spark = batch.sparkSession
    if carried is None:
        carried = spark.createDataFrame([], "series string, tail long")
    flagged = batch.select("series", "ts", "event_id", is_finite(F.col("value")).alias("finite"))
    indexed = ordered_index(flagged, ["series", "ts", "event_id"], "pos")
    bounds = indexed.groupBy("series").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    bad = ordered_index(indexed.where(~F.col("finite")), ["series", "pos"], "bad_pos")
    named = bad.withColumn("run", F.col("pos") - F.col("bad_pos"))
    runs = named.groupBy("series", "run").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))
    # one row per series: where the batch starts and ends, and what came before
    context = bounds.join(carried, "series", "full").withColumn("tail", F.coalesce("tail", F.lit(0)))
    seen = runs.join(context, "series")
    before = F.when(F.col("start") == F.col("first"), F.col("tail")).otherwise(F.lit(0))
    at = F.greatest(F.col("start") + F.lit(k - 1) - before, F.col("start"))
    crossing = seen.where((before < k) & (at <= F.col("end"))).select("series", at.alias("pos"))
    alarms = crossing.join(indexed, ["series", "pos"]).select("series", "ts", "event_id")
    open_runs = seen.where(F.col("end") == F.col("last")).select(
        "series", (F.col("end") - F.col("start") + 1 + before).alias("open")
    )
    state = context.join(open_runs, "series", "left").select(
        "series",
        # a series without rows in this batch keeps its state
        F.when(F.col("last").isNull(), F.col("tail")).otherwise(F.coalesce("open", F.lit(0))).alias("tail"),
    )
    return alarms, state


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _mark_fields(stamp: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("folder", T.StringType()), *[T.StructField(n, stamp) for n in ("lo", "hi", "newest")]])


def _marks(spark: SparkSession, path: str, stamp: T.DataType) -> DataFrame:
    """Marks: folders of kept rows with the span of their event times, and the newest event time so far."""
    return spark.read.schema(_mark_fields(stamp)).parquet(path)


def _first_per_key(rows: DataFrame, keys: Sequence[str], event_time: str) -> DataFrame:
    """The oldest row of each key; rows without an event time come last, ties go by a hash of the row."""
    order = F.struct(F.col(event_time).isNull(), F.col(event_time), F.xxhash64(*rows.columns))
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def _unless_in(rows: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(seen, [rows[k].eqNullSafe(seen[k]) for k in keys], "left_anti")


def stream_dedupe(rows: DataFrame, keys: Sequence[str], event_time: str, delay: str, out: str, checkpoint: str) -> StreamingQuery:
    """First arrival per key, to `{out}/batch=N`; no row is dropped without trace.

    A key is remembered for `delay` (a SQL interval such as '1 hour') of event time around its rows:
    a batch is compared with the kept rows that are not older than its oldest row by more than that.
    Rows that lie behind the newest event time of earlier batches by more than `delay` go to
    `{out}_late/batch=N` as they are; `settle_late` compares them with all history. Rows without an
    event time are never late and are compared within their batch only.

    `{out}_marks/batch=N` is written last. It names the folders that a later batch may still have to be compared
    with (those that reach into the last two delays) and their spans of event time, so a batch reads one
    small table and these folders, however long the history is.
    """
    wait = F.expr(f"interval {delay}")
    schema, stamp, at = rows.schema, rows.schema[event_time].dataType, F.col(event_time)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marks, newest = None, None
        if number:
            marks = _marks(spark, f"{out}_marks/batch={number - 1}", stamp)
            newest = marks.agg(F.max("newest")).first()[0]
            settled = f"{out}_settled_marks/batch={number - 1}"
            if _exists(spark, settled):
                marks = marks.unionByName(_marks(spark, settled, stamp))
        behind = F.lit(False) if newest is None else F.coalesce(at < F.lit(newest) - wait, F.lit(False))
        lo, hi = batch.agg(F.min(F.when(~behind, at)), F.max(F.when(~behind, at))).first()
        fresh = _first_per_key(batch.where(~behind), keys, event_time)
        if marks is not None and lo is not None:
            near = [r[0] for r in marks.where(F.col("hi") >= F.lit(lo) - wait).select("folder").distinct().collect()]
            if near:
                kept = spark.read.schema(schema).parquet(*near).where(at >= F.lit(lo) - wait)
                fresh = _unless_in(fresh, kept.select(*keys), keys)
        _batch_table(out)(fresh.sortWithinPartitions(event_time), number)
        _batch_table(f"{out}_late")(batch.where(behind), number)
        newest = max((t for t in (newest, hi) if t is not None), default=None)
        own = [(f"{out}/batch={number}" if lo is not None else None, lo, hi, newest)]
        table = spark.createDataFrame(own, _mark_fields(stamp))
        if marks is not None and newest is not None:
            open_ = marks.where(F.col("folder").isNotNull() & (F.col("hi") >= F.lit(newest) - wait - wait))
            table = table.unionByName(open_.withColumn("newest", F.lit(newest).cast(stamp)))
        _batch_table(f"{out}_marks")(table.coalesce(1), number)

    return _drain(rows, write, checkpoint)


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches below `path`, ascending; none if there is no such folder."""
    if not _exists(spark, path):
        return []
    return sorted(r[0] for r in spark.read.schema("folder string, batch int").parquet(path).select("batch").distinct().collect())


def settle_late(spark: SparkSession, schema: T.StructType, keys: Sequence[str], event_time: str, out: str, within: str | None = None) -> None:
    """Late rows of `stream_dedupe` whose key was never kept, one per key, to `{out}_settled/batch=M`.

    M is the newest finished batch; late rows up to it that no earlier call has settled take part. They are compared
    with all kept and settled rows, of which only the keys are read. With `within` (a SQL interval) duplicates are
    known to lie at most that far apart, and only folders and rows near the span of the late ones are read.
    Later batches are compared with settled rows like with kept ones. Run it between two runs of the stream; a call
    that failed is repeated, its unfinished folder is not read. Rows without an event time are never late.
    """
    done, settled = _batches(spark, f"{out}_marks"), _batches(spark, f"{out}_settled_marks")
    if not done or (settled and settled[-1] >= done[-1]):
        return
    last, stamp, at = done[-1], schema[event_time].dataType, F.col(event_time)
    numbered = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])
    late = spark.read.schema(numbered).parquet(f"{out}_late").where(F.col("batch") <= last)
    late = late.where(F.col("batch") > (settled[-1] if settled else -1)).drop("batch")
    first = _first_per_key(late, keys, event_time)
    lo, hi = late.agg(F.min(at), F.max(at)).first()
    if lo is None:
        own: list = [(None, None, None, None)]
        _batch_table(f"{out}_settled")(first, last)
    else:
        if within is None:
            history = read_deduped(spark, schema, out, last)
        else:
            reach = F.expr(f"interval {within}")
            marks = _marks(spark, f"{out}_marks", stamp)
            marks = marks.unionByName(_marks(spark, f"{out}_settled_marks", stamp)) if settled else marks
            meets = (F.col("hi") >= F.lit(lo) - reach) & (F.col("lo") <= F.lit(hi) + reach)
            folders = [r[0] for r in marks.where(meets & F.col("folder").isNotNull()).select("folder").distinct().collect()]
            history = spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
            history = history.where(at.between(F.lit(lo) - reach, F.lit(hi) + reach))
        _batch_table(f"{out}_settled")(_unless_in(first, history.select(*keys), keys).sortWithinPartitions(event_time), last)
        own = [(f"{out}_settled/batch={last}", lo, hi, None)]
    _batch_table(f"{out}_settled_marks")(spark.createDataFrame(own, _mark_fields(stamp)).coalesce(1), last)


def read_deduped(spark: SparkSession, schema: T.StructType, out: str, last: int | None = None) -> DataFrame:
    """Kept and settled rows of finished batches (up to `last`): each key once after `settle_late`."""
    numbered = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])
    done, settled = _batches(spark, f"{out}_marks"), _batches(spark, f"{out}_settled_marks")
    if not done:
        return spark.createDataFrame([], schema)
    top = done[-1] if last is None else last
    rows = spark.read.schema(numbered).parquet(out).where(F.col("batch") <= top)
    if settled:
        more = spark.read.schema(numbered).parquet(f"{out}_settled")
        rows = rows.unionByName(more.where(F.col("batch").isin(settled)))
    return rows.drop("batch")
