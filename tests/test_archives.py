"""Slices from a header walk, archives as a stream, archives that appear all at once."""

import io
import tarfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scorelake.sources import archives


def write_tar(path, members, **options):
    with tarfile.open(path, "w", **options) as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type = tarfile.DIRTYPE
            else:
                info.size = len(data)
            tar.addfile(info, io.BytesIO(data or b""))


def inner_tar():
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as tar:
        for i in range(20):
            info = tarfile.TarInfo(f"inner{i}.txt")
            info.size = 5
            tar.addfile(info, io.BytesIO(b"inner"))
    return raw.getvalue()


MEMBERS = [(f"k{i:03d}.txt", bytes([i % 250]) * (i * 37 % 1500)) for i in range(80)] + [("folder", None), ("nested.tar", inner_tar()), ("n" * 180 + ".txt", b"long name"), ("é" * 90 + ".txt", b"pax"), ("empty.txt", b"")]


@pytest.mark.parametrize("kind", [tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
@pytest.mark.parametrize("split", [512, 3000, 20000])
def test_slices_are_the_archive(spark, tmp_path, kind, split):
    write_tar(tmp_path / "a.tar", MEMBERS, format=kind)
    (tmp_path / "b.tar").write_bytes((tmp_path / "a.tar").read_bytes()[:30_000])  # cut off inside a member
    whole = archives.read_members(spark, str(tmp_path)).collect()
    offsets = archives.member_offsets(spark, str(tmp_path), split)
    parts = archives.read_members(spark, str(tmp_path), offsets=offsets).collect()
    assert sorted(map(repr, parts)) == sorted(map(repr, whole)) and sum(r.error is not None for r in parts) == 1
    good = sorted((r.member_idx, r.member, bytes(r.content)) for r in parts if r.shard == "a")
    assert good == [(i, n, d) for i, (n, d) in enumerate(m for m in MEMBERS if m[1] is not None)]
    assert offsets.where("shard = 'a'").count() > 80_000 // (split + 5000)


def test_stored_offsets(spark, tmp_path):
    write_tar(tmp_path / "a.tar", MEMBERS)
    archives.member_offsets(spark, str(tmp_path), 4000).write.parquet(str(tmp_path / "offsets"))
    stored = spark.read.parquet(str(tmp_path / "offsets"))
    got = archives.read_members(spark, str(tmp_path), [".txt"], names_only=True, offsets=stored).collect()
    assert len(got) == 83 and all(r.content is None for r in got)


def test_headers_are_walked_once(tmp_path, monkeypatch):
    """Slices read their own headers and members only."""
    write_tar(tmp_path / "a.tar", MEMBERS)
    walked = []
    following = tarfile.TarInfo.fromtarfile.__func__
    monkeypatch.setattr(tarfile.TarInfo, "fromtarfile", classmethod(lambda cls, tar: walked.append(tar.offset) or following(cls, tar)))
    starts = archives.slice_starts(str(tmp_path / "a.tar"), 2000)
    once = len(walked)
    walked.clear()
    everything, ends = archives.Wanted([], False), [lo for lo, _ in starts[1:]] + [archives._END]
    rows = [r for (lo, first), hi in zip(starts, ends) for r in everything.members(archives.Slice("a", str(tmp_path / "a.tar"), lo, hi, first))]
    assert len(starts) > 20 and len(rows) == len(MEMBERS) - 1 and len(walked) <= once + 2 * len(starts)


def test_global_headers_are_one_slice(tmp_path):
    write_tar(tmp_path / "a.tar", MEMBERS, format=tarfile.PAX_FORMAT, pax_headers={"comment": "for all"})
    assert archives.slice_starts(str(tmp_path / "a.tar"), 512) == [(0, 0)]


def test_stream_reads_every_archive_once(spark, tmp_path):
    roots, out, seen, state = (tmp_path / n for n in ("roots", "out", "seen", "state"))
    roots.mkdir()

    def run():
        stream = archives.stream_members(spark, str(roots), str(seen), [".txt"])
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(state)).option("path", str(out)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted((r.shard, r.member) for r in spark.read.parquet(str(out)).select("shard", "member").collect()) if list(out.glob("*.parquet")) else []

    assert run() == []
    write_tar(roots / "b.tar", [("1.txt", b"x"), ("1.jpg", b"y")])
    assert run() == [("b", "1.txt")]
    write_tar(roots / "a.tar", [("2.txt", b"x")])
    (roots / ".c.tar.partial").write_bytes(b"not complete")
    assert run() == [("a", "2.txt"), ("b", "1.txt")] and run() == [("a", "2.txt"), ("b", "1.txt")]
    # a list that was written by a trigger that did not get further
    write_tar(roots / "d.tar", [("3.txt", b"x")])
    archives.ArchiveStream({"roots": str(roots), "seen": str(seen)}).latestOffset()
    assert run() == [("a", "2.txt"), ("b", "1.txt"), ("d", "3.txt")]


def samples(spark):
    return spark.range(60).selectExpr("concat('s', id % 5) as shard", "lpad(id, 4, '0') as key", "concat('text ', id) as txt", "if(id % 7 = 0, null, cast('b' as binary)) as jpg")


def test_archives_appear_all_at_once(spark, tmp_path):
    target = str(tmp_path / "target")
    archives.save_archives(samples(spark), target, {".txt": "txt", ".jpg": "jpg"})
    assert sorted(p.name for p in Path(target).iterdir()) == [f"s{i}.tar" for i in range(5)] and [p.name for p in tmp_path.iterdir()] == ["target"]
    back = archives.read_members(spark, target).collect()
    assert len(back) == 60 + 51 and {r.member[:4] for r in back if r.shard == "s3"} == {f"{i:04d}" for i in range(3, 60, 5)}
    with pytest.raises(Exception, match="exists"):
        archives.save_archives(samples(spark), target, {".txt": "txt"})
    archives.save_archives(samples(spark).where("shard = 's1'"), target, {".txt": "txt"}, overwrite=True)
    assert [p.name for p in Path(target).iterdir()] == ["s1.tar"]


def test_a_failed_job_shows_nothing(spark, tmp_path):
    broken = samples(spark).withColumn("txt", F.when(F.col("key") == "0033", F.raise_error(F.lit("bad row"))).otherwise(F.col("txt")))
    with pytest.raises(Exception, match="bad row"):
        archives.save_archives(broken, str(tmp_path / "target"), {".txt": "txt"})
    assert list(tmp_path.iterdir()) == []


def test_repeated_attempts_show_once(tmp_path):
    writer = archives.ArchiveWriter({"path": str(tmp_path / "target"), "members": '{".txt": "txt"}'}, False)
    writer.staging.mkdir()
    for attempt in (1, 2):  # two attempts of one task that both came to an end, and one that did not
        write_tar(writer.staging / f"s0@0-{attempt}.tar", [("k.txt", str(attempt).encode())])
    (writer.staging / ".s1@1-3.tar.3").write_bytes(b"half")
    writer.commit([archives.Written(["s0@0-2.tar"]), None])
    assert [p.name for p in (tmp_path / "target").iterdir()] == ["s0.tar"] and len(list(tmp_path.iterdir())) == 1
    with tarfile.open(tmp_path / "target" / "s0.tar") as tar:
        assert tar.extractfile("k.txt").read() == b"2"
    again = archives.ArchiveWriter({"path": str(tmp_path / "other"), "members": "{}"}, False)
    with pytest.raises(ValueError):
        again.commit([archives.Written(["s0@0-1.tar"]), archives.Written(["s0@1-2.tar"])])


def test_many_small_archives_share_tasks(spark, tmp_path):
    n = 300
    rows = spark.range(n).select(F.format_string("%04d", "id").alias("shard"), F.lit("k").alias("key"), F.col("id").cast("string").alias("txt"))
    archives.save_archives(rows, str(tmp_path / "a"), {".txt": "txt"})
    most = 4 * spark.sparkContext.defaultParallelism
    members = archives.read_members(spark, str(tmp_path / "a"))
    assert members.rdd.getNumPartitions() <= 2 * most
    assert sorted(int(bytes(r.content)) for r in members.collect()) == list(range(n))
    offsets = archives.member_offsets(spark, str(tmp_path / "a"), split_bytes=1)
    assert offsets.rdd.getNumPartitions() <= most
    sliced = archives.read_members(spark, str(tmp_path / "a"), offsets=offsets)
    assert sliced.rdd.getNumPartitions() <= most and sliced.count() == n
    digests = archives.shard_digests(spark, str(tmp_path / "a"))
    tasks = digests.select(F.spark_partition_id().alias("p")).distinct().count()
    assert 1 < tasks <= most and digests.count() == n  # neither one task for all nor one for each


def test_dealt_archives_keep_order_and_size():
    parts = [archives.Slice(str(i), str(i), 0, 1, 0) for i in range(100)]
    dealt = archives._dealt(parts, [archives.TASK_BYTES // 10] * 99 + [5 * archives.TASK_BYTES], 2)
    assert [p.shard for d in dealt for p in d.parts] == [str(i) for i in range(100)]
    assert len(dealt) == 11 and dealt[-1].parts == parts[-1:]
    assert archives._dealt([], [], 4) == []
    assert len(archives._dealt(parts, [0] * 100, 4)) == 1
