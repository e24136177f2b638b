"""A score log in levels: arriving rows are appended, and folders are merged as they add up.

`{out}/level0-N` holds micro-batch N. When a level has `fanout` folders they are merged to one folder of
the next level, with one row per sample, so a row is written once per level and there are at most
`fanout - 1` folders of a level between batches. `{out}_manifest/batch=N`, written last, lists the folders that
make up the table after batch N; readers take one manifest and read what it lists. Merged folders stay
for `grace` more batches, so that a reader can finish, and are then removed together with old manifests.

A score is its newest version that is not null; where one batch brings several, the largest of them.
A batch without a manifest is done anew and replaces its folders, which no reader has seen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from scorelake.operators.scores import IDENTITY, require_identity
from scorelake.streaming.jobs import _batches, _drain

MANIFEST = "folder string, level int, version long, gone long"


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _stored(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("version", T.LongType())])


def _resolve(log: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    newest = [F.max_by(n, F.when(F.col(n).isNotNull(), F.struct("version", n))).alias(n) for n in names]
    return log.groupBy(*keys).agg(*newest)


def _entries(spark: SparkSession, out: str, number: int) -> list[tuple]:
    """Rows of one manifest: live folders and those that wait for their removal; a few per level."""
    return [tuple(r) for r in spark.read.schema(MANIFEST).parquet(f"{out}_manifest/batch={number}").collect()]


def stream_upsert_levels(
    scores: DataFrame, names: Sequence[str], out: str, checkpoint: str, fanout: int = 8, grace: int = 4, keys: Sequence[str] = IDENTITY
) -> StreamingQuery:
    """Arriving rows (keys and any of the scores) into the log at `out`; `read_levels` is the table."""
    require_identity(keys, scores=scores)
    if fanout < 2:
        raise ValueError("a level needs at least two folders before it is merged")
    arriving = scores.select(*keys, *names)
    schema = arriving.schema

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = _batches(spark, f"{out}_manifest")
        if number in done:
            return  # finished before; its folders may be in use
        entries = _entries(spark, out, number - 1) if number else []
        live, waiting = [e for e in entries if e[3] is None], [e for e in entries if e[3] is not None]
        batch.withColumn("version", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/level0-{number}")
        live.append((f"{out}/level0-{number}", 0, number, None))
        level = 0
        while len(full := [e for e in live if e[1] == level]) >= fanout:
            rows = spark.read.schema(_stored(schema)).parquet(*[e[0] for e in full])
            level, target = level + 1, f"{out}/level{level + 1}-{number}"
            _resolve(rows, names, keys).withColumn("version", F.lit(number).cast("long")).write.mode("overwrite").parquet(target)
            live = [*(e for e in live if e not in full), (target, level, number, None)]
            waiting += [(*e[:3], number) for e in full]
        for entry in waiting:
            if entry[3] <= number - grace:
                _remove(spark, entry[0])
        listed = live + [e for e in waiting if e[3] > number - grace]
        spark.createDataFrame(listed, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{out}_manifest/batch={number}")
        for old in done:
            if old < number - grace:
                _remove(spark, f"{out}_manifest/batch={old}")

    return _drain(arriving, write, checkpoint)


def read_levels(spark: SparkSession, schema: T.StructType, names: Sequence[str], out: str, keys: Sequence[str] = IDENTITY) -> DataFrame:
    """One row per sample as of the newest finished batch; `schema` is that of keys and scores.

    The folders are chosen now: batches that end later do not change the frame, and it can be read until `grace` more
    have ended.
    """
    done = _batches(spark, f"{out}_manifest")
    folders = [e[0] for e in _entries(spark, out, done[-1]) if e[3] is None] if done else []
    rows = spark.read.schema(_stored(schema)).parquet(*folders) if folders else spark.createDataFrame([], _stored(schema))
    return _resolve(rows, names, keys)
