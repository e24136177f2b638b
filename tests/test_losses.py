"""Ordinary but untidy inputs: nothing is lost, shifted or multiplied without a trace."""

import gc
import json
import math
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.operators import bins as B
from scorelake.operators import scores, scoring_jobs, verdicts
from scorelake.plans import epochs
from scorelake.session import materialise, shared_folder
from scorelake.sources import archives, samples, stores, tables
from scorelake.streaming import jobs


def archive(spark, folder, rows):
    df = spark.createDataFrame(rows, "shard string, key string, txt string, json string, jpg string")
    return archives.write_archives(df, str(folder), {".txt": "txt", ".json": "json", ".jpg": "jpg"})


def test_roots_with_equal_names(spark, tmp_path):
    for root in ("a", "b"):
        archive(spark, tmp_path / root, [("00000", "000001", f"caption {root}", '{"width": 1}', "x")]).collect()
    both = f"{tmp_path}/a {tmp_path}/b"
    members = archives.read_members(spark, both)
    back = samples.read_samples(members)
    assert sorted((r.shard[:2], r.txt) for r in back.collect()) == [("0/", "caption a"), ("1/", "caption b")]
    assert sorted(r.nsamples for r in stores.load_or_build_index(members, str(tmp_path / "index")).collect()) == [1, 1]
    assert archives.shard_digests(spark, both).select("shard").distinct().count() == 2
    rows = [(r.shard, r.key, 0.5) for r in back.collect()]
    table = spark.createDataFrame(rows, "shard string, key string, clip_score double")
    assert scores.attach_scores(back, table).count() == 2
    with pytest.raises(ValueError, match="shard"):
        scores.attach_scores(back, table.drop("shard"))


def test_unreadable_archive_is_counted(spark, tmp_path):
    archive(spark, tmp_path, [("00000", "k", "c", "{}", "x")]).collect()
    (tmp_path / "broken.tar").write_bytes(b"not an archive" * 100)
    members = archives.read_members(spark, str(tmp_path))
    good, rejected = samples.quarantine(samples.decode_json(samples.read_samples(members)), members)
    assert good.count() == 1
    assert {r.reason: r.n for r in samples.rejected_counts(rejected).collect()} == {"unreadable archive": 1}


def test_json_of_every_kind(spark):
    texts = ['{"width": 300.9, "height": 20}', "[1]", '{"clip_score": NaN, "width": 1e300}', '{"a":1', "", "3", None, '{"width": null}']
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "key string, json string")
    rows = samples.decode_json(df).select("bad_json", "meta.width", "meta.height", "meta.clip_score").collect()
    assert [r.bad_json for r in rows] == [False, True, False, True, True, True, False, False]
    assert (rows[0].width, rows[0].height) == (300, 20) and math.isnan(rows[2].clip_score) and rows[2].width is None


def test_metadata_keeps_its_types(spark, tmp_path):
    text = '{"width": 300.0, "tags": [{"n": 1}], "note": "5", "clip_score": 1, "flag": true, "none": null}'
    df = spark.createDataFrame([("s", "a", text), ("s", "b", None)], "shard string, key string, json string")
    table = spark.createDataFrame([("s", "a", 0.25, "0.5", "7"), ("s", "b", 0.75, "n/a", None)], "shard string, key string, clip_score double, vqa_score string, caption string")
    stores.write_enriched(samples.decode_json(df), table, ["clip_score", "vqa_score", "caption"], str(tmp_path / "out"))
    out = {r["key"]: json.loads(r["json"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out["a"] == {"width": 300, "tags": [{"n": 1}], "note": "5", "flag": True, "none": None, "clip_score": 0.25, "vqa_score": 0.5, "caption": "7"}
    assert out["b"] == {"clip_score": 0.75, "vqa_score": "n/a"}
    plain = spark.createDataFrame([(1.5,)], "clip_score double").select(scores.merge_scores_json(F.lit(None).cast("map<string,string>"), ["clip_score"]).alias("m"))
    assert plain.first()["m"] == {"clip_score": "1.5"}


def test_wide_captions_and_mixed_headers(spark, tmp_path):
    (tmp_path / "c.tsv").write_text('k.jpg\tshort\tmid\t"long\nand ""more"""\nj.jpg\ts\t\t\n')
    rows = {r.stem: (r.short_caption, r.long_caption) for r in tables.read_captions_tsv(spark, str(tmp_path / "c.tsv")).collect()}
    assert rows == {"k": ("short", 'long\nand "more"'), "j": ("s", None)}
    folder = tmp_path / "a folder"
    folder.mkdir()
    (folder / "1.csv").write_text("key,clip_score,aesthetic_score\n01,0.1,0.9\n")
    (folder / "2.csv").write_text('key,aesthetic_score,caption\n02,0.8,"two\nlines, one"\n')
    (folder / "3.csv").write_text("key,clip_score,aesthetic_score\n03,,0.7\n")
    got = {r.key: (r.clip_score, r.aesthetic_score, r.caption) for r in tables.read_scores_csv(spark, str(folder)).collect()}
    assert got == {"01": (0.1, 0.9, None), "02": (None, 0.8, "two\nlines, one"), "03": (None, 0.7, None)}


def test_prompt_folder_with_a_space(spark, tmp_path):
    for name in ("00000", "with space", "p%20q"):
        (tmp_path / "r s" / name / "samples").mkdir(parents=True)
        (tmp_path / "r s" / name / "samples" / "0000.png").write_bytes(b"x")
        (tmp_path / "r s" / name / "metadata.jsonl").write_text(json.dumps({"prompt": name}))
    found = tables.discover_images(spark, str(tmp_path / "r s")).collect()
    assert sorted((Path(r.filename.removeprefix("file:")).parts[-3], r.prompt) for r in found) == [(n, n) for n in ("00000", "p%20q", "with space")]
    assert tables.discover_images_strict(spark, str(tmp_path / "r s")).count() == 1


@pytest.mark.parametrize("strategy", ["quantile", "uniform"])
def test_infinite_and_extreme_scores(spark, strategy):
    tiny = float(np.nextafter(np.float32(0), np.float32(1)))
    values = [float("inf"), float("-inf"), tiny, -tiny, 0.0, -0.0, 3.4e38, -3.4e38, float("nan"), None, *(i / 40 for i in range(40))]
    long = spark.createDataFrame([("clip_score", str(i), v) for i, v in enumerate(values)], "score_name string, key string, value double")
    row = B.compute_bins(long, B.BinSpec(8, strategy)).first()
    edges = list(row.edges)
    assert edges == sorted(set(edges)) and not any(map(math.isnan, edges)) and {0.0, 1.0} <= set(edges)
    wide = spark.createDataFrame([(v,) for v in values], "clip_score double")
    for own in (edges, [float("-inf"), 0.0, 0.5, float("inf")]):
        counted = B.edges_below(wide, {"clip_score": own}, {"clip_score": "b"}).collect()
        for r in counted:
            v = None if r.clip_score is None or math.isnan(r.clip_score) else float(np.float32(r.clip_score))
            assert r.b == (None if v is None else sum(e < v for e in own)), (own, r)


def test_late_events_are_kept_apart(spark, tmp_path):
    schema, stamp = "event_id long, ts timestamp", lambda h: f"2024-01-0{1 + h // 24} {h % 24:02d}:00:00"
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[(1, 48), (2, 48), (1, 48)], [(2, 48), (3, 0)], [(4, 1), (5, 49), (1, 49)], [(6, 50), (3, 2), (7, None)]]
    for rows in batches:
        df = spark.createDataFrame([(i, None if h is None else stamp(h)) for i, h in rows], "event_id long, t string")
        df.select("event_id", F.to_timestamp("t").alias("ts")).write.mode("append").parquet(path)
        jobs.stream_dedupe(spark.readStream.schema(schema).parquet(path), ["event_id"], "ts", "2 hours", out, out + "-cp").awaitTermination()
    kept = sorted(r[0] for r in spark.read.parquet(out).select("event_id").collect())
    late = sorted(r[0] for r in spark.read.parquet(out + "_late").select("event_id").collect())
    assert kept == [1, 2, 5, 6, 7] and late == [3, 3, 4]


def test_unknown_classes_are_counted(spark):
    box = lambda c: (c, 0.0, 0.0, 1.0, 1.0, 0.9, "red")
    images = spark.createDataFrame([("i", [box(0), box(99), box(99), box(-1)])], "image_id string, boxes array<struct<class_id:int,x1:double,y1:double,x2:double,y2:double,score:double,color:string>>")
    assert verdicts.detections_long(images).count() == 1
    assert {r.class_id: r.n for r in verdicts.unknown_classes(images).collect()} == {99: 2, -1: 1}


def test_padding_of_a_skewed_epoch_is_spread(spark):
    rows = [("big", f"b{i}", i) for i in range(4000)] + [("s1", "x", 4000), ("s2", "y", 4001)]
    indexed = spark.createDataFrame(rows, "shard string, key string, idx long")
    ranges = spark.createDataFrame([("big", 0, 0, 4000, 4000), ("s1", 1, 4000, 4001, 1), ("s2", 2, 4001, 4002, 1)], "shard string, shard_idx long, lo long, hi long, nsamples long")
    plan = epochs.shard_exclusive(indexed, ranges, 3, epochs.EpochShape(ranks=3, workers=1, batch=2))
    counts = {r.rank: r.n for r in plan.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {0: 4000, 1: 4000, 2: 4000}
    assert plan.groupBy("rank", "round", "slot").count().where("count > 1").count() == 0


def test_checkpoints_go_with_their_frames(spark):
    folder = Path((spark.sparkContext.getCheckpointDir() or shared_folder(spark)).removeprefix("file:"))
    held = lambda: {p for p in folder.rglob("rdd-*") if p.is_dir()}
    frame = materialise(spark.range(1000), "probe")
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = held()
    assert before and frame.count() == 1000
    del frame
    for _ in range(40):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.25)
        if held() != before:
            break
    assert held() < before


def test_encoder_works_in_small_batches(spark):
    seen = []

    def make():
        def encode(texts):
            assert len(texts) <= 4
            return [np.ones((3, 2048), dtype="float32") * len(t) for t in texts]

        return encode

    df = spark.createDataFrame([("a" * (i % 5),) for i in range(30)], "text string").coalesce(1)
    out = df.select("text", scoring_jobs.encode_text(F.col("text"), make, batch_size=4).alias("e"))
    rows = out.select("text", F.size("e").alias("n"), F.size(F.get("e", F.lit(0))).alias("w"), F.get(F.get("e", F.lit(2)), F.lit(7)).alias("v")).collect()
    assert len(rows) == 30 and all((r.n, r.w, r.v) == (3, 2048, float(len(r.text))) for r in rows) and not seen
