"""Archives, text tables, image folders and stores on real files."""

import hashlib
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from scorelake.functions.vectors import pad, pad_mask
from scorelake.operators import scoring_jobs as K
from scorelake.operators import shards
from scorelake.plans import preparation
from scorelake.plans.requests import flatten_descriptor, require_shards
from scorelake.sources import archives, samples, stores, tables


def write_tar(path, members):
    with tarfile.open(path, "w") as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shards")
    for s in range(3):
        members = []
        for i in range(5):
            key = f"{s}{i:04d}"
            meta = {"width": 300 + i, "height": 400, "clip_score": 0.1 * i, "synthetic_caption": f"long {key}"}
            if i == 1:
                meta["aesthetic_score"] = None
            if i == 2:
                meta["short_synthetic_caption"] = None
            text = json.dumps(meta) if i != 4 else "{broken"
            members += [(f"{key}.jpg", b"J" * (i + 700)), (f"{key}.txt", f"<PERSON>cap {key}".encode()), (f"{key}.json", text.encode())]
        members.append(("README", b"no dot"))
        write_tar(folder / f"{s:05d}.tar", members)
    (folder / "00003.tar").write_bytes(b"this is not an archive" * 100)
    return folder


def test_members_and_splits(spark, root):
    whole = archives.read_members(spark, str(root))
    assert whole.rdd.getNumPartitions() == 4
    split = archives.read_members(spark, str(root), split_bytes=2000)
    assert split.rdd.getNumPartitions() > 8
    a = sorted((r["shard"], r["member_idx"], r["member"], bytes(r["content"])) for r in whole.where("error is null").collect())
    b = sorted((r["shard"], r["member_idx"], r["member"], bytes(r["content"])) for r in split.where("error is null").collect())
    assert a == b and len(a) == 48
    assert [r["shard"] for r in split.where("error is not null").collect()] == ["00003"]
    names = archives.read_members(spark, str(root), extensions=[".json"], names_only=True).where("error is null").collect()
    assert len(names) == 15 and all(r["content"] is None and r["member"].endswith(".json") for r in names)


def test_roots_in_order_and_missing(spark, root, tmp_path):
    write_tar(tmp_path / "z.tar", [("k.txt", b"x")])
    listed = archives.list_archives(f"{tmp_path} {root}")
    assert [p.rsplit("/", 1)[1] for p in listed] == ["z.tar", "00000.tar", "00001.tar", "00002.tar", "00003.tar"]
    with pytest.raises(FileNotFoundError):
        archives.list_archives(str(tmp_path / "none"))


def test_digests(spark, root):
    got = {r["shard"]: r["md5"] for r in archives.shard_digests(spark, str(root)).collect()}
    assert got == {p.stem: hashlib.md5(p.read_bytes()).hexdigest() for p in root.glob("*.tar")}
    expected = spark.createDataFrame(
        [("00000", got["00000"], 5), ("00001", "x", 5), ("00002", got["00002"], 6), ("00009", "y", 1)],
        "shard string, md5 string, nsamples long",
    )
    members = archives.read_members(spark, str(root), names_only=True).where("error is null")
    actual = archives.shard_digests(spark, str(root)).join(shards.shard_table(members), "shard")
    problems = {r["shard"]: r["problem"] for r in shards.verify_shards(actual, expected).collect()}
    assert problems == {"00000": None, "00001": "md5", "00002": "nsamples", "00009": "missing"}


def test_decode_quality_and_captions(spark, root):
    decoded = samples.decode_json(samples.read_samples(archives.read_members(spark, str(root), [".txt", ".json", ".jpg"])))
    assert decoded.count() == 15 and decoded.where("has_image").count() == 15
    good, rejected = samples.quarantine(decoded)
    assert good.count() == 12 and {r["reason"]: r["n"] for r in samples.rejected_counts(rejected).collect()} == {"bad json": 3}
    kept = decoded.where(samples.quality_of(decoded, 300, 0.0, 0.0)).where("shard = '00000'")
    assert sorted(r["key"] for r in kept.collect()) == ["00000", "00002", "00003"]  # 1: null score, 4: bad JSON
    captioned = {r["key"]: r for r in preparation.with_captions(good, None).where("shard = '00001'").collect()}
    assert captioned["10000"]["long"] == "long 10000" and captioned["10000"]["short"] == "cap 10000"
    assert captioned["10002"]["short"] == "long 10002" and captioned["10002"]["original"] == "cap 10002"


def test_preparation_end_to_end(spark, root, tmp_path):
    decoded = samples.decode_json(samples.read_samples(archives.read_members(spark, str(root), [".txt", ".json", ".jpg"])))
    good, _ = samples.quarantine(decoded)
    switches = K.Switches(scores=("clip_score", "aesthetic_score"))
    scorers = {s: "length_ratio" for s in switches.scores}
    scores = preparation.score_samples(preparation.with_captions(good, None), scorers, switches)
    row = scores.where("key = '00000'").first()
    assert row["clip_score"] == pytest.approx(len("cap 00000") / 1000 / 100)
    assert row["synthetic_clip_score"] == pytest.approx(len("long 00000") / 1000 / 100)
    assert row["synthetic_aesthetic_score"] == row["aesthetic_score"]
    tokens = F.array(F.lit(1.0), F.lit(2.0))
    padded = good.withColumn("emb", pad(tokens, 4, F.lit(0.0))).withColumn("mask", pad_mask(tokens, 4))
    stores.write_enriched(padded, scores, ["clip_score", "synthetic_clip_score"], str(tmp_path / "out"), [("emb", "mask")])
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 12 and back.first()["emb"] == [1.0, 2.0]
    meta = json.loads(back.where("key = '00000'").first()["json"])
    assert float(meta["clip_score"]) == pytest.approx(row["clip_score"]) and meta["width"] == 300


def test_text_tables(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("a/b/k1.jpg\tshort one\tlong one\nk2.x.png\t\tlong two\n")
    rows = {r["stem"]: r for r in tables.read_captions_tsv(spark, str(tmp_path / "c.tsv")).collect()}
    assert set(rows) == {"k1", "k2.x"} and rows["k2.x"]["short_caption"] is None and rows["k1"]["long_caption"] == "long one"
    (tmp_path / "m.csv").write_text('key,caption\n007,"a, b"\n')
    meta = tables.read_metadata_csv(spark, str(tmp_path / "m.csv")).first()
    assert meta["key"] == "007" and meta["caption"] == "a, b" and meta["vqa_score_coherence"] == 1.0
    (tmp_path / "s.csv").write_text("key,vqa_score,clip_score\n01,,0.5\n")
    score = tables.read_scores_csv(spark, str(tmp_path / "s.csv")).first()
    assert score["key"] == "01" and score["vqa_score"] is None and score["clip_score"] == 0.5
    (tmp_path / "p.tsv").write_text("Prompt\tCategory\tNote\na cat\tAnimals\t\n")
    tables.prompts_tsv_to_jsonl(spark, str(tmp_path / "p.tsv"), str(tmp_path / "p"))
    assert [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "p")).collect()] == [{"prompt": "a cat", "category": "Animals"}]
    (tmp_path / "j.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r["a"] for r in tables.read_jsonl(spark, str(tmp_path / "j.jsonl"), "a int").where("a is not null").collect()) == [1, 2]


def test_image_folders(spark, tmp_path):
    def folder(name, meta, files):
        (tmp_path / name / "samples").mkdir(parents=True)
        if meta is not None:
            (tmp_path / name / "metadata.jsonl").write_text(meta)
        for f in files:
            (tmp_path / name / "samples" / f).write_bytes(b"x")

    folder("00000", '{"prompt": "a"}\n{"prompt": "z"}', ["0000.png", "0001.JPG", "notes.txt"])
    folder("00001", None, ["0000.png"])
    folder("abc", '{"prompt": "b"}', ["0000.png", "x.webp"])
    folder("00002", "", ["0000.png"])
    found = {(r["filename"].split("/", 1)[1].split(tmp_path.name + "/")[1], r["prompt"]) for r in tables.discover_images(spark, str(tmp_path)).collect()}
    assert found == {("00000/samples/0000.png", "a"), ("00000/samples/0001.JPG", "a"), ("abc/samples/0000.png", "b"), ("abc/samples/x.webp", "b")}
    strict = {r["filename"].split(tmp_path.name + "/")[1] for r in tables.discover_images_strict(spark, str(tmp_path)).collect()}
    assert strict == {"00000/samples/0000.png"}  # an empty or absent specification judges nothing


def test_size_store_and_scorer_flush(spark, tmp_path):
    key = stores.SizeKey(256, 0.0, 0.0)
    df = spark.range(10)
    assert stores.size_of(df, F.col("id") > 3, str(tmp_path), key, "r1") == 6
    assert stores.size_of(df, F.col("id") > 8, str(tmp_path), key, "r1") == 6  # stored
    assert stores.stored_size(spark, str(tmp_path), key, ["r1", "r2"]) is None
    stores.store_size(spark, str(tmp_path), key, "r2", 4)
    assert stores.stored_size(spark, str(tmp_path), key, ["r1", "r2"]) == 10
    rows = spark.createDataFrame([("s", "k", "hello")], "shard string, key string, text string")
    store = str(tmp_path / "sc")
    K.apply_scorers(rows, ["length_ratio"], ["text"], store)
    again = K.apply_scorers(rows.limit(0), ["length_ratio", "vowel_share"], ["text"], store)
    assert [(r["score_name"], r["value"]) for r in again.collect()] == [("length_ratio", 0.005)]
    assert K.SCORERS.parse(" length_ratio, vowel_share ") == ["length_ratio", "vowel_share"]
    with pytest.raises(ValueError, match="nope"):
        K.SCORERS.parse("length_ratio,nope")
    with pytest.raises(ValueError, match="shard"):
        K.apply_scorers(rows.drop("shard"), ["length_ratio"], ["text"], store)


def test_descriptor(spark, tmp_path):
    main = {
        "wids_version": 1, "name": "top", "weight": 2.0,
        "shardlist": [{"url": "a.tar", "nsamples": 3}, {"url": "b.tar", "nsamples": 4, "weight": 9.0}],
        "datasets": [
            {"name": "in", "weight": 0.5, "base": "gs://bucket/dir/", "shardlist": [{"url": "../x/c.tar", "nsamples": 1}, {"url": "/abs/d.tar", "nsamples": 1}]},
            {"source_url": "http://host/sub/desc.json", "weight": 7.0},
        ],
    }
    remote = {"wids_version": 1, "name": "far", "weight": 1.0, "shardlist": [{"url": "e.tar", "nsamples": 5}, {"url": "ftp://other/f.tar?q=1", "nsamples": 6}]}
    (tmp_path / "d.json").write_text(json.dumps(main))
    (tmp_path / "r.json").write_text(json.dumps(remote))
    far = tables.read_descriptors(spark, str(tmp_path / "r.json")).withColumn("location", F.lit("http://host/sub/desc.json"))
    out = flatten_descriptor(tables.read_descriptors(spark, str(tmp_path / "d.json")), far, base="http://base/root")
    rows = {r["url"]: r for r in out.collect()}
    assert set(rows) == {"http://base/root/a.tar", "http://base/root/b.tar", "gs://bucket/x/c.tar", "gs://bucket/abs/d.tar", "http://host/sub/e.tar", "ftp://other/f.tar?q=1"}
    assert rows["http://base/root/a.tar"]["weight"] == 2.0 and rows["http://base/root/b.tar"]["weight"] == 9.0
    assert rows["http://base/root/a.tar"]["name"] == "top" and rows["gs://bucket/x/c.tar"]["dataset"] == "in"
    assert rows["http://host/sub/e.tar"]["weight"] == 7.0 and rows["http://host/sub/e.tar"]["dataset"] == "far"
    assert rows["http://host/sub/e.tar"]["source_url"] == "http://host/sub/desc.json"
    onward = far.withColumn("source_url", F.lit("http://elsewhere"))
    with pytest.raises(Exception, match="refers to another one"):
        flatten_descriptor(tables.read_descriptors(spark, str(tmp_path / "d.json")), onward).collect()
    (tmp_path / "faulty.json").write_text(json.dumps({"wids_version": 1, "shardlist": [{"url": "a"}]}))
    with pytest.raises(Exception, match="needs url and nsamples"):
        flatten_descriptor(tables.read_descriptors(spark, str(tmp_path / "faulty.json"))).collect()
    with pytest.raises(ValueError, match="no shards"):
        require_shards(out.limit(0))
    (tmp_path / "bad.json").write_text(json.dumps({"wids_version": 2, "shardlist": [{"url": "a", "nsamples": 1}]}))
    with pytest.raises(Exception, match="wids_version 1"):
        flatten_descriptor(tables.read_descriptors(spark, str(tmp_path / "bad.json"))).collect()
    (tmp_path / "wids-index.json").write_text(json.dumps({"wids_version": 1, "shardlist": [{"url": "a.tar", "nsamples": 3}, {"url": "b.tar", "nsamples": 4}]}))
    assert [tuple(r) for r in tables.read_shard_index(spark, str(tmp_path / "wids-index.json")).collect()] == [(0, "a.tar", 3), (1, "b.tar", 4)]


def test_written_archives_split_and_read_back(spark, tmp_path):
    rows = [(f"s{i % 2}", f"k{i:03d}", "t" * 3000, None if i % 3 else b"J") for i in range(60)]
    df = spark.createDataFrame(rows, "shard string, key string, txt string, jpg binary")
    index = archives.write_archives(df, str(tmp_path / "out"), {".jpg": "jpg", ".txt": "txt"}, max_bytes=40_000).collect()
    assert sum(r["nsamples"] for r in index) == 60 and len(index) >= 4
    assert not list((tmp_path / "out").glob(".*")) and len(list((tmp_path / "out").glob("*.tar"))) == len(index)
    back = samples.read_samples(archives.read_members(spark, str(tmp_path / "out")))
    got = {r["key"]: (r["txt"], r["has_image"], r["shard"][:2]) for r in back.collect()}
    assert got == {k: (t, j is not None, s) for s, k, t, j in rows}


def test_all_scorers_share_one_python_pass(spark):
    from scorelake.operators.scoring_jobs import Switches
    from scorelake.schema import SCORES

    rows = spark.createDataFrame([("s", "k", b"image 3", "abc", "abcd", None), ("s", "l", None, "a", "b", "c")], "shard string, key string, jpg binary, original string, long string, short string")
    scored = preparation.score_samples(rows, {n: "image_and_length" for n in SCORES}, Switches(), "jpg")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    alone = preparation.score_samples(rows, {"clip_score": "image_and_length"}, Switches(scores=("clip_score",)), "jpg")
    assert alone.columns == ["shard", "key", "clip_score", "synthetic_clip_score"]
    got = {r.key: r for r in scored.collect()}
    assert got["k"].vqa_score == pytest.approx(0.003 * 4 / 10) and got["l"].vqa_score is None
    assert {r.key: r.clip_score for r in alone.collect()}["k"] == got["k"].clip_score


def test_image_folders_are_listed_once_by_few_tasks_and_images_stay_closed(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"{i:05d}" / "samples").mkdir(parents=True)
        (tmp_path / f"{i:05d}" / "samples" / "0000.png").write_bytes(b"x" * 200)
        (tmp_path / f"{i:05d}" / "metadata.jsonl").write_text(f'{{"prompt": "p{i}"}}\n')
    context, largest = spark.sparkContext, "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(largest, "100")  # a longer file that is opened raises an error
    try:
        for number, discover in enumerate((tables.discover_images, tables.discover_images_strict)):
            context.setJobGroup(f"listing-{number}-{tmp_path.name}", "")
            found = discover(spark, str(tmp_path))
            tracker = context.statusTracker()
            jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(f"listing-{number}-{tmp_path.name}")]
            assert sum(tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds) <= 4 * context.defaultParallelism
            assert found.count() == 300 and found.distinct().count() == 300 and len(found.collect()) == 300
    finally:
        spark.conf.unset(largest)
        context.setLocalProperty("spark.jobGroup.id", None)
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism", None) is None
