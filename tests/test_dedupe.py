"""Streamed deduplication: late rows, settling, and what a batch reads."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from scorelake.streaming import jobs

SCHEMA = "event_id long, ts timestamp, note string"


def arrive(spark, path, rows):
    df = spark.createDataFrame([(i, None if m is None else f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00", n) for i, m, n in rows], "event_id long, t string, note string")
    df.select("event_id", F.to_timestamp("t").alias("ts"), "note").coalesce(1).write.mode("append").parquet(path)


def run(spark, path, out):
    stream = spark.readStream.schema(SCHEMA).parquet(path)
    jobs.stream_dedupe(stream, ["event_id"], "ts", "30 minutes", out, out + "-cp").awaitTermination()


def schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


def test_each_key_once_after_settling(spark, tmp_path):
    """Copies arrive in any batch, most of them late, null ids and extra columns included."""
    rng = random.Random(3)
    events = [(i if i else None, rng.randrange(0, 1200), f"n{i}") for i in range(120)]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for step in range(5):
        arrive(spark, path, rng.choices(events, k=70) + (events if step == 4 else []))
        run(spark, path, out)
        if step in (1, 2):
            jobs.settle_late(spark, schema(spark), ["event_id"], "ts", out, None if step == 1 else "1 minute")
            jobs.settle_late(spark, schema(spark), ["event_id"], "ts", out)  # nothing new: no change
    assert spark.read.parquet(out + "_late").count() > 0
    jobs.settle_late(spark, schema(spark), ["event_id"], "ts", out)
    got = jobs.read_deduped(spark, schema(spark), out).select("event_id", F.date_format("ts", "HH:mm"), "note").collect()
    want = [(i, f"{m // 60:02d}:{m % 60:02d}", n) for i, m, n in events]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_unfinished_settling_is_repeated(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(1, 600, "a"), (2, 610, "b")], [(3, 10, "c"), (1, 600, "a"), (3, 10, "c")]):
        arrive(spark, path, rows)
        run(spark, path, out)
    # a folder without a mark is the rest of a call that failed
    spark.createDataFrame([(99, None, "rest")], SCHEMA).write.parquet(out + "_settled/batch=0")
    assert jobs.read_deduped(spark, schema(spark), out).count() == 2
    jobs.settle_late(spark, schema(spark), ["event_id"], "ts", out, "1 minute")
    assert sorted(r.event_id for r in jobs.read_deduped(spark, schema(spark), out).collect()) == [1, 2, 3]


def test_batches_do_not_read_history(spark, tmp_path):
    """Folders that lie behind two delays may be unreadable; marks do not grow; a replayed batch replaces itself."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for step in range(6):
        arrive(spark, path, [(10 * step + j, 100 * step + j, "x") for j in range(5)] + [(10 * step, 100 * step, "x"), (None, None, "y")])
        run(spark, path, out)
        for old in range(step):
            for part in Path(out, f"batch={old}").glob("part-*"):
                part.write_bytes(b"not a table")
            for mark in Path(f"{out}_marks/batch={old}").glob("part-*") if old < step - 1 else []:
                mark.write_bytes(b"not a table")
    assert spark.read.parquet(f"{out}_marks/batch=5").count() == 1
    assert spark.read.parquet(f"{out}/batch=5").count() == 6
    # the last batch is lost before its commit and runs again, with a key of the batch before it
    (Path(out + "-cp") / "commits" / "5").unlink()
    (Path(out + "-cp") / "commits" / ".5.crc").unlink(missing_ok=True)
    run(spark, path, out)
    assert sorted(r.event_id for r in spark.read.parquet(f"{out}/batch=5").where("event_id is not null").collect()) == [50, 51, 52, 53, 54]
