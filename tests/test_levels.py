from pyspark.sql import functions as F
"""The levelled score log against a dictionary: any batch, snapshots, replays, number of folders."""

import random
from pathlib import Path

import pytest

from scorelake.streaming import levels

SCHEMA = "shard string, key string, a double, b double"
NAMES = ["a", "b"]


def folders(out):
    return [p for p in Path(out).iterdir() if p.name.startswith("level")]


def arrive(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, out, **kw):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    levels.stream_upsert_levels(stream, NAMES, out, out + "-cp", **kw).awaitTermination()


def read(spark, out):
    return levels.read_levels(spark, spark.createDataFrame([], SCHEMA).schema, NAMES, out)


def table(df):
    return {(r.shard, r["key"]): (r.a, r.b) for r in df.collect()}


def test_log_equals_a_dictionary(spark, tmp_path):
    rng, model = random.Random(5), {}
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    snapshot, before = None, None
    for n in range(14):
        rows = [(f"s{rng.randrange(2)}", f"k{rng.randrange(30)}", *(rng.choice([None, rng.random()]) for _ in NAMES)) for _ in range(25)]
        newest: dict = {}
        for s, k, *values in rows:  # several of one batch: the largest
            had = newest.get((s, k), (None, None))
            newest[s, k] = tuple(max((x for x in pair if x is not None), default=None) for pair in zip(had, values))
        for at, values in newest.items():
            model[at] = tuple(v if v is not None else o for v, o in zip(values, model.get(at, (None, None))))
        arrive(spark, path, rows)
        run(spark, path, out, fanout=3, grace=2)
        if n in (2, 8, 9, 13):
            assert table(read(spark, out)) == model
        if n == 7:
            snapshot, before = read(spark, out), dict(model)
        if n == 8:  # the ninth batch merges two levels; folders of the snapshot are still there
            assert table(snapshot) == before
    # at most two a level, three levels, and what waits for two batches
    assert len(folders(out)) <= 2 * 3 + 4
    assert len([p for p in Path(out + "_manifest").iterdir() if p.name.startswith("batch")]) <= 4


def test_a_batch_without_manifest_is_done_anew(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(2):
        arrive(spark, path, [("s", "k", float(n), None), ("s", f"k{n}", None, 1.0)])
        run(spark, path, out, fanout=2)
    want = {("s", "k"): (1.0, None), ("s", "k0"): (None, 1.0), ("s", "k1"): (None, 1.0)}
    assert table(read(spark, out)) == want

    def forget(*parts):
        for part in parts:
            for p in (Path(*part), Path(*part[:-1], f".{part[-1]}.crc")):
                p.unlink(missing_ok=True)

    forget((out + "-cp", "commits", "1"))  # finished, but not committed: nothing is touched
    stamps = {p: p.stat().st_mtime_ns for f in folders(out) for p in f.glob("part-*")}
    run(spark, path, out, fanout=2)
    assert {p: p.stat().st_mtime_ns for f in folders(out) for p in f.glob("part-*")} == stamps
    forget((out + "-cp", "commits", "1"), *((str(p.parent), p.name) for p in Path(out + "_manifest", "batch=1").glob("part-*")))
    assert table(read(spark, out)) == {("s", "k"): (0.0, None), ("s", "k0"): (None, 1.0)}
    run(spark, path, out, fanout=2)
    assert table(read(spark, out)) == want


def test_no_batches_and_wrong_parameters(spark, tmp_path):
    assert read(spark, str(tmp_path / "none")).count() == 0
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path))
    with pytest.raises(ValueError, match="two folders"):
        levels.stream_upsert_levels(stream, NAMES, "x", "y", fanout=1)


def test_number_of_micro_batches_does_not_grow_with_files(spark):
    from scorelake.queries import jobs as queries

    out = queries._folder(spark, "counted")
    rows = spark.range(0, 4000, 1, 12).select(F.col("id").cast("string").alias("key"))
    seen = []
    q = queries._as_stream(rows, "key").writeStream.option("checkpointLocation", out).trigger(availableNow=True)
    q.foreachBatch(lambda batch, number: seen.append(batch.count())).start().awaitTermination()
    assert sum(seen) == 4000 and len(seen) == 3
