"""Shard archives: a data source with one row per archive member, and a writer.

    spark.read.format("shard_members").option("roots", "/data/a /data/b").load()

Options: `roots` (space-separated folders of *.tar, or archives), `extensions` (comma list: other
members are skipped before their bytes are read), `names_only` (true: no bytes at all). A task reads
several archives, about TASK_BYTES in all, so many small archives are not as many tasks; `tasks` is the least number
of tasks where there are as many archives. `read_members` cuts archives larger than `split_bytes`: a walk over each archive's
headers gives the place and number of the first member of every slice (`member_offsets`), and slices
start there, so headers are walked once and no slice reads another's. The table can be stored and given
back to later reads.

The same source is a stream of archives as they arrive, see `ArchiveStream`; `shard_archives` is a
sink that shows all archives of a job or none, see `ArchiveWriter`.
"""

from __future__ import annotations

import io
import json
import logging
import os
import shutil
import tarfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from scorelake.schema import MEMBERS
from scorelake.session import materialise

FORMAT = "shard_members"
BATCH_ROWS, BATCH_BYTES = 1024, 32 << 20
#: what a task reads, where archives or slices are smaller
TASK_BYTES = 32 << 20
LEAST_TASKS = 32
_END = (1 << 63) - 1

_ARROW = pa.schema(
    [
        ("shard", pa.string()),
        ("member_idx", pa.int64()),
        ("member", pa.string()),
        ("size", pa.int64()),
        ("content", pa.binary()),
        ("error", pa.string()),
    ]
)
_SLICE_SCHEMA = pa.schema([("shard", pa.string()), ("path", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("first", pa.int64())])


@dataclass
class Slice(InputPartition):
    """Members of one archive whose header starts in [lo, hi); `first` is the number of the member at lo."""

    shard: str
    path: str
    lo: int
    hi: int
    first: int


@dataclass
class Slices(InputPartition):
    """What one task reads."""

    parts: list[Slice]


def _dealt(parts: Sequence[Slice], sizes: Sequence[int], least: int) -> list[Slices]:
    """Slices in order, in tasks of about TASK_BYTES, or less where that makes fewer than `least` tasks."""
    most = min(TASK_BYTES, sum(sizes) // least)
    dealt, held = [], 0
    for part, size in zip(parts, sizes):
        if not dealt or held + size > most:
            dealt.append(Slices([]))
            held = 0
        dealt[-1].parts.append(part)
        held += size
    return dealt


def _tasks(spark: SparkSession, size: int, pieces: int) -> int:
    """Tasks for `pieces` archives or slices of `size` bytes in all."""
    return max(1, min(pieces, max(-(-size // TASK_BYTES), 4 * spark.sparkContext.defaultParallelism)))


def list_archives(roots: str, empty: bool = False) -> list[str]:
    """Archives of all roots, roots in the given order, names sorted inside each; none at all is an error unless `empty`."""
    found: list[str] = []
    for root in roots.split():
        path = Path(root)
        found += [str(path)] if path.is_file() else sorted(str(p) for p in path.glob("*.tar"))
    if not found and not empty:
        raise FileNotFoundError(f"no .tar files in {roots!r}")
    return found


def shard_paths(roots: str, empty: bool = False) -> list[tuple[str, str]]:
    """(shard, path) of all archives. A shard is known by its file's name without the ending; where
    several roots are given, by 'number of the root/name', since roots may use the same names."""
    several = len(roots.split()) > 1
    named = []
    for number, root in enumerate(roots.split()):
        named += [(f"{number}/{Path(p).stem}" if several else Path(p).stem, p) for p in list_archives(root, empty)]
    if len({shard for shard, _ in named}) < len(named):
        raise ValueError(f"two archives of one root in {roots!r} have the same name")
    return named


class ShardMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return MEMBERS

    def reader(self, schema: StructType) -> DataSourceReader:
        return MemberReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ArchiveStream(self.options)


class Wanted:
    """Which members are read, and whether with their bytes."""

    def __init__(self, extensions: Sequence[str], names_only: bool) -> None:
        self.extensions = tuple(e.strip().lower() for e in extensions if e.strip())
        self.names_only = names_only

    @classmethod
    def of(cls, options: Mapping[str, str]) -> Wanted:
        return cls(options.get("extensions", "").split(","), options.get("names_only", "false").lower() == "true")

    def __call__(self, name: str) -> bool:
        if not self.extensions:
            return True
        dot = name.find(".")
        return dot >= 0 and name[dot:].lower() in self.extensions

    def batches(self, part: Slice) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for row in self.members(part):
            rows.append(row)
            held += len(row[4] or b"")
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def members(self, part: Slice) -> Iterator[tuple]:
        """The members of a slice; bytes of others are skipped by seeking."""
        shard, at, idx = part.shard, part.lo, part.first
        try:
            with open(part.path, "rb") as file:
                file.seek(part.lo)
                with tarfile.open(fileobj=file, mode="r:") as archive:
                    for info in archive:
                        at = info.offset
                        if at >= part.hi:
                            return
                        if not info.isfile():
                            continue
                        if self(info.name):
                            content = None if self.names_only else archive.extractfile(info).read()
                            yield shard, idx, info.name, info.size, content, None
                        idx += 1
        except (tarfile.TarError, OSError, EOFError) as problem:
            logging.getLogger(__name__).warning("skipping the rest of %s: %s", part.path, problem)
            if at < part.hi:  # only one slice reports it
                yield shard, None, None, None, None, f"{type(problem).__name__}: {problem}"


class MemberReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.roots, self.wanted = options["roots"], Wanted.of(options)
        self.least = int(options.get("tasks", LEAST_TASKS))

    def partitions(self) -> Sequence[InputPartition]:
        parts = [Slice(shard, path, 0, _END, 0) for shard, path in shard_paths(self.roots)]
        return _dealt(parts, [_size(part.path) for part in parts], self.least)

    def read(self, partition: Slices) -> Iterator[pa.RecordBatch]:
        for part in partition.parts:
            yield from self.wanted.batches(part)


class ArchiveStream(DataSourceStreamReader):
    """Archives as they arrive in `roots`, each read once, also after a restart.

    The offset is a number of lists. Whenever a trigger finds archives that no list names, they become the
    next list, written to the folder of option `seen` before the offset is given out; so a list is fixed
    before any of its archives is read, and a query that starts again finds the same lists. An archive must
    appear complete (renamed into place); one that is replaced under its name isn't read again.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.roots, self.wanted, self.seen = options["roots"], Wanted.of(options), Path(options["seen"])
        self.least = int(options.get("tasks", LEAST_TASKS))

    def initialOffset(self) -> dict:
        return {"lists": 0}

    def latestOffset(self) -> dict:
        self.seen.mkdir(parents=True, exist_ok=True)
        lists = self._lists()
        known = {path for n in range(1, lists + 1) for _, path in self._list(n)}
        fresh = [s for s in shard_paths(self.roots, empty=True) if s[1] not in known]
        if fresh:
            lists += 1
            partial = self.seen / f".{lists}.{os.getpid()}"
            partial.write_text(json.dumps(fresh))
            os.replace(partial, self.seen / f"{lists}.json")
        return {"lists": lists}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        named = [s for n in range(start["lists"] + 1, end["lists"] + 1) for s in self._list(n)]
        parts = [Slice(shard, path, 0, _END, 0) for shard, path in named]
        return _dealt(parts, [_size(part.path) for part in parts], self.least)

    def read(self, partition: Slices) -> Iterator[pa.RecordBatch]:
        for part in partition.parts:
            yield from self.wanted.batches(part)

    def _lists(self) -> int:
        return max((int(p.stem) for p in self.seen.glob("[0-9]*.json")), default=0)

    def _list(self, n: int) -> list:
        return json.loads((self.seen / f"{n}.json").read_text())


def _size(path: str) -> int:
    """0 for an archive that is gone, which its slice reports."""
    try:
        return os.path.getsize(path)
    except OSError:
        return 0


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(column, type=field.type) for column, field in zip(zip(*rows), _ARROW)]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def read_members(
    spark: SparkSession,
    roots: str,
    extensions: Sequence[str] = (),
    names_only: bool = False,
    split_bytes: int = 256 << 20,
    offsets: DataFrame | None = None,
) -> DataFrame:
    """One row per member. `offsets` is a table that `member_offsets` gave earlier for the same roots."""
    sizes = [_size(path) for _, path in shard_paths(roots, empty=offsets is not None)]
    if offsets is None and max(sizes) <= split_bytes:
        spark.dataSource.register(ShardMembers)
        source = spark.read.format(FORMAT).option("roots", roots).option("extensions", ",".join(extensions))
        source = source.option("tasks", 4 * spark.sparkContext.defaultParallelism)
        return source.option("names_only", str(names_only).lower()).load()
    pieces = sum(-(-size // split_bytes) for size in sizes) if offsets is None else offsets.count()
    slices = member_offsets(spark, roots, split_bytes) if offsets is None else offsets
    wanted = Wanted(extensions, names_only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from wanted.batches(Slice(**row))

    columns = slices.select("shard", "path", "lo", "hi", "first")
    return columns.repartition(_tasks(spark, sum(sizes), pieces)).mapInArrow(run, MEMBERS)


_SLICES = "shard string, path string, lo long, hi long, first long"


def member_offsets(spark: SparkSession, roots: str, split_bytes: int = 256 << 20) -> DataFrame:
    """(shard, path, lo, hi, first): slices of about `split_bytes` of every archive, each from a member's header on.

    One walk over an archive's headers, in one task; bytes of members are skipped. An archive
    with global extended headers, which count for all later members, is one slice. A broken archive is cut
    as far as it can be walked; its last slice meets the fault again and reports it.
    """
    named = shard_paths(roots)
    paths = spark.createDataFrame(named, "shard string, path string")
    paths = paths.repartition(_tasks(spark, sum(_size(path) for _, path in named), len(named)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                starts = slice_starts(row["path"], split_bytes)
                ends = [lo for lo, _ in starts[1:]] + [_END]
                rows = [{**row, "lo": lo, "hi": hi, "first": first} for (lo, first), hi in zip(starts, ends)]
                yield pa.RecordBatch.from_pylist(rows, schema=_SLICE_SCHEMA)

    return paths.mapInArrow(run, _SLICES)


def slice_starts(path: str, split_bytes: int) -> list[tuple[int, int]]:
    """(offset of a member's first header, number of the member) of every slice of an archive."""
    starts, idx = [(0, 0)], 0
    try:
        with tarfile.open(path, "r:") as archive:
            for info in archive:
                if archive.pax_headers:
                    return [(0, 0)]
                if info.offset - starts[-1][0] >= split_bytes:
                    starts.append((info.offset, idx))
                idx += info.isfile()
                archive.members = []  # the walk needs no list of all members
    except (tarfile.TarError, OSError, EOFError) as problem:
        logging.getLogger(__name__).warning("slices of %s end early: %s", path, problem)
    return starts


def stream_members(spark: SparkSession, roots: str, seen: str, extensions: Sequence[str] = (), names_only: bool = False) -> DataFrame:
    """A stream of the members of archives that arrive in `roots`; `seen` is a folder of its own for the lists of archives."""
    spark.dataSource.register(ShardMembers)
    source = spark.readStream.format(FORMAT).option("roots", roots).option("seen", seen)
    return source.option("extensions", ",".join(extensions)).option("names_only", str(names_only).lower()).load()


def shard_digests(spark: SparkSession, roots: str) -> DataFrame:
    """(shard, md5) of whole archive files, streamed through memory piece by piece in the tasks."""
    import hashlib

    import pandas as pd

    def digest(batches):
        for pdf in batches:
            for shard, path in zip(pdf["shard"], pdf["path"]):
                state = hashlib.md5()
                with open(path, "rb") as f:
                    while piece := f.read(8 << 20):
                        state.update(piece)
                yield pd.DataFrame({"shard": [shard], "md5": [state.hexdigest()]})

    named = shard_paths(roots)
    paths = spark.createDataFrame(named, "shard string, path string")
    # a number: by keys alone, adaptive execution puts the short list of paths into one task
    tasks = _tasks(spark, sum(_size(path) for _, path in named), len(named))
    return paths.repartition(tasks).mapInPandas(digest, "shard string, md5 string")


def write_archives(
    samples: DataFrame, folder: str, members: Mapping[str, str], max_bytes: int = 1 << 30
) -> DataFrame:
    """Samples (shard, key, member columns) -> archives of members `{key}{ext}`; returns their index.

    `members` maps an extension to a string or binary column; a NULL cell writes no member. Every
    task streams its rows into `{shard}-{task}-{number}.tar`, so a large shard becomes several
    archives. A file appears under its final name only when it is complete; a repeated task
    replaces its own files.
    """
    columns = list(members.values())
    rows = samples.select("shard", "key", *columns).hint("rebalance", "shard").sortWithinPartitions("shard", "key")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        out, number = None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is not None and (out.shard != row["shard"] or out.size > max_bytes):
                    yield out.close()
                    out = None
                if out is None:
                    name = f"{row['shard'].replace('/', '_')}-{context.partitionId():05d}-{number:03d}.tar"
                    out, number = _Archive(folder, name, row["shard"], context.taskAttemptId()), number + 1
                out.add(row["key"], {ext: row[c] for ext, c in members.items() if row[c] is not None})
        if out is not None:
            yield out.close()

    Path(folder).mkdir(parents=True, exist_ok=True)
    written = rows.mapInArrow(write, "url string, shard string, nsamples long, nbytes long")
    return materialise(written, "archives")


class _Archive:
    """One output archive of one task."""

    def __init__(self, folder: str, name: str, shard: str, attempt: int) -> None:
        self.final = Path(folder) / name
        self.partial = Path(folder) / f".{name}.{attempt}"
        self.tar = tarfile.open(self.partial, "w")
        self.shard, self.samples, self.size = shard, 0, 0

    def add(self, key: str, parts: Mapping[str, str | bytes]) -> None:
        for ext, content in parts.items():
            data = content.encode() if isinstance(content, str) else content
            info = tarfile.TarInfo(key + ext)
            info.size = len(data)
            self.tar.addfile(info, io.BytesIO(data))
            self.size += len(data)
        self.samples += 1

    def close(self) -> pa.RecordBatch:
        self.tar.close()
        os.replace(self.partial, self.final)
        values = {"url": str(self.final), "shard": self.shard, "nsamples": self.samples, "nbytes": self.size}
        return pa.RecordBatch.from_pylist([values])


SINK = "shard_archives"


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class ShardArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return SINK

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ArchiveWriter(self.options, overwrite)


class ArchiveWriter(DataSourceArrowWriter):
    """Rows (shard, key, member columns), sorted by shard in each task, to archives that appear all at once.

    Tasks write into a hidden folder beside the target, every attempt under names of its own. The commit
    removes what unsuccessful or doubled attempts left and renames the folder to the target; an abort
    removes it. So a failed job shows nothing, and a repeated task shows once.
    """

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.target, self.overwrite = Path(options["path"]), overwrite
        self.members = json.loads(options["members"])
        self.staging = self.target.with_name(f".{self.target.name}.{uuid.uuid4().hex}")
        if not overwrite and self.target.exists() and any(self.target.iterdir()):
            raise FileExistsError(f"{self.target} exists")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        self.staging.mkdir(parents=True, exist_ok=True)
        context = TaskContext.get()
        out, done = None, []
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or out.shard != row["shard"]:
                    if out is not None:
                        out.close()
                    name = f"{row['shard'].replace('/', '_')}@{context.partitionId()}-{context.taskAttemptId()}.tar"
                    out = _Archive(str(self.staging), name, row["shard"], context.taskAttemptId())
                    done.append(name)
                out.add(row["key"], {ext: row[c] for ext, c in self.members.items() if row[c] is not None})
        if out is not None:
            out.close()
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        names = [name for message in messages if message is not None for name in message.names]
        finals = {name: f"{name.rsplit('@', 1)[0]}.tar" for name in names}
        if len(set(finals.values())) < len(finals):
            raise ValueError("a shard was written by two tasks; write with save_archives")
        self.staging.mkdir(parents=True, exist_ok=True)
        for path in list(self.staging.iterdir()):
            if path.name not in finals:
                path.unlink()
            else:
                path.rename(self.staging / finals[path.name])
        if self.target.exists():
            if self.overwrite:
                shutil.rmtree(self.target)
            else:
                self.target.rmdir()  # an empty folder
        self.staging.rename(self.target)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


def save_archives(samples: DataFrame, folder: str, members: Mapping[str, str], overwrite: bool = False) -> None:
    """Samples (shard, key, member columns) to one archive `{shard}.tar` per shard, all of them or none.

    `members` is as in `write_archives`, which cuts large shards and shows archives one by one.
    """
    spark = samples.sparkSession
    spark.dataSource.register(ShardArchives)
    rows = samples.select("shard", "key", *dict.fromkeys(members.values())).repartition("shard").sortWithinPartitions("shard", "key")
    writer = rows.write.format(SINK).option("members", json.dumps(dict(members))).mode("overwrite" if overwrite else "append")
    writer.save(folder)
