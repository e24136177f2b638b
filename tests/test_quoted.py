"""Quoted tables read by splits of any size against the reader that takes a file in one task."""

import random
import tempfile

import pytest
from pyspark.sql import types as T

from scorelake.sources import quoted, tables

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in "abcd"])


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def write(path, text):
    with open(path, "w", newline="") as f:
        f.write(text)


def cell(rng):
    body = "".join(rng.choice(["a", "b", "\n", "\r\n", "\t", ",", '""', "é", " ", '"" ']) for _ in range(rng.randrange(0, 12)))
    if rng.random() < 0.6:
        return f'"{body}"'
    return "".join(rng.choice('abc "é') for _ in range(rng.randrange(1, 6))).lstrip('" ') or ""


@pytest.mark.parametrize("split, sep", [(5, "\t"), (33, ","), (100, "\t"), (700, ","), (1 << 20, "\t")])
def test_any_split_gives_the_same_rows(spark, split, sep):
    rng, where = random.Random(split), folder()
    for f in range(2):
        lines = ["\n" if rng.random() < 0.05 else sep.join([f"r{f}_{i}", cell(rng), cell(rng), cell(rng)]) + "\n" for i in range(8 if split < 50 else 30)]
        write(f"{where}/t{f}.csv", "".join(lines))
    write(f"{where}/empty.csv", "")
    want = spark.read.schema(SCHEMA).csv(where, sep=sep, quote='"', escape='"', multiLine=True, lineSep="\n").collect()
    got = quoted.QuotedTable(spark, where, sep, split).cells(SCHEMA, False).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_states_are_joined_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(quoted, "BROADCAST_SPLITS", 0)
    rng, where = random.Random(3), folder()
    write(f"{where}/t.csv", "".join(",".join([f"r{i}", cell(rng), cell(rng), cell(rng)]) + "\n" for i in range(60)))
    want = spark.read.schema(SCHEMA).csv(where, escape='"', multiLine=True, lineSep="\n").collect()
    got = quoted.QuotedTable(spark, where, ",", 40).cells(SCHEMA, False).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_windows_line_ends_and_header(spark):
    where = folder()
    write(f"{where}/a.csv", 'key,caption\r\n007,"one\r\ntwo"\r\n"8","a ""b"", c"\r\n009,plain 5" pipe\r\n')
    write(f"{where}/b.csv", "key,caption\r\n")
    for split in (3, 10, 1 << 20):
        rows = {tuple(r)[:2] for r in tables.read_metadata_csv(spark, where, ["clip_score"], split_bytes=split).collect()}
        assert rows == {("007", "one\r\ntwo"), ("8", 'a "b", c'), ("009", 'plain 5" pipe')}


def test_one_record_over_many_splits(spark):
    where = folder()
    long = "\n".join(f"line {i} \"\"quoted\"\"" for i in range(500))
    write(f"{where}/a.csv", f'a,"{long}",c,d\nb,"x\ny",c,d\nopen,"to the end\nof the file')
    rows = {r.a: r.b for r in quoted.QuotedTable(spark, where, ",", 50).cells(SCHEMA, False).collect()}
    assert rows["a"] == long.replace('""', '"') and rows["b"] == "x\ny" and len(rows) == 3 and rows["open"].endswith("to the end\nof the file")
    # a header longer than a split
    write(f"{where}/b.csv", "\n\n" + ",".join(f'"name\n{i}"' for i in range(20)) + "\n" + ",".join(map(str, range(20))) + "\n")
    table = quoted.QuotedTable(spark, f"{where}/b.csv", ",", 30)
    assert quoted.split_cells(table.heads().first()["record"], ",") == [f"name\n{i}" for i in range(20)]


def test_headers_of_several_kinds(spark):
    where = folder()
    write(f"{where}/a.csv", 'key,clip_score,note\nk1,0.5,"x\ny"\nk2,,z\n')
    write(f"{where}/b.csv", '"note","key",vqa_score\nq,k3,1.25\n')
    for split in (4, 1 << 20):
        rows = {r.key: (r.clip_score, r.vqa_score, r.note) for r in tables.read_scores_csv(spark, where, split_bytes=split).collect()}
        assert rows == {"k1": (0.5, None, "x\ny"), "k2": (None, None, "z"), "k3": (None, 1.25, "q")}


def test_no_captions(spark):
    where = folder()
    write(f"{where}/a.tsv", "only one column\n")
    with pytest.raises(ValueError):
        tables.read_captions_tsv(spark, where)


def test_a_file_is_read_by_many_tasks(spark):
    where = folder()
    write(f"{where}/a.tsv", "".join(f'{i:06d}.jpg\t"short {i}"\t"long\n{i} ""x"""\n' for i in range(20000)))
    table = quoted.QuotedTable(spark, where, "\t", 64 << 10)
    assert table.lines.rdd.getNumPartitions() >= 8 and table.states.where("inside").count() > 0
    rows = tables.read_captions_tsv(spark, where, split_bytes=64 << 10)
    assert rows.where("stem = lpad(substring(short_caption, 7, 9), 6, '0') and long_caption = concat('long\n', substring(short_caption, 7, 9), ' \"x\"')").count() == 20000


def test_many_small_splits_share_tasks(spark, tmp_path):
    rows = [f'"k{i}","a ""q"" {i}\nb"' for i in range(4000)]
    (tmp_path / "t.csv").write_text("\n".join(rows) + "\n")
    table = quoted.QuotedTable(spark, str(tmp_path / "t.csv"), ",", 256)
    assert table.states.count() > 4 * spark.sparkContext.defaultParallelism
    assert table.lines.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted(r["record"] for r in table.records().collect()) == sorted(rows)
