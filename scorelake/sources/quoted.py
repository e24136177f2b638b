"""Quoted tables with line breaks inside cells, read by many tasks per file.

Spark's own multi-line reader takes a file in one task, because a split cannot know whether it starts
inside a quoted cell. Here the physical lines come from the splittable text reader, and two passes put
records together:

1. Every split runs its lines from both possible states, outside and inside a quoted cell, and
   reports the two end states: one narrow row per split. Composing these functions along a file gives
   each split's true start state; with two states that is the last constant function before it and the
   parity of the swapping ones since.
2. Every split joins its lines to records from its true state. A record that crosses splits leaves
   one piece in each; these pieces alone are grouped, one group per record.

Both passes must see the same splits, so the text relation belongs to a session of its own whose split
size is fixed and does not depend on the number of cores; see `_lines`.

Lines end with \\n or \\r\\n, quotes are doubled inside quoted cells, a quote inside an unquoted cell is
text. Blank lines between records are left out; a file that ends inside a quoted cell gives its rest as
one record. An empty file has no records.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from scorelake.session import materialise

SPLIT_BYTES = 128 << 20
#: what a task reads where splits are smaller
TASK_BYTES = 32 << 20
#: with more splits than this their states are joined by a shuffle in place of a broadcast (about 100 bytes each)
BROADCAST_SPLITS = 200_000


def _lines(spark: SparkSession, path: str | Sequence[str], split_bytes: int) -> DataFrame:
    """(file, block, line, value): physical lines in file order by (block, line).

    The number of cores enters Spark's split size through the session of the relation, so the relation is
    made in a session where it cannot; the view hands the analysed plan over to the caller's session.
    """
    fixed = spark.newSession()
    fixed.conf.set("spark.sql.files.minPartitionNum", "1")
    fixed.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    text = fixed.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    # many small splits share a task; a split stays whole and in order there
    splits = text.rdd.getNumPartitions()
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-splits * split_bytes // TASK_BYTES))
    text = text.coalesce(tasks) if splits > tasks else text
    name = f"lines_{uuid.uuid4().hex}"
    text.createGlobalTempView(name)
    lines = spark.table(f"global_temp.{name}")
    fixed.catalog.dropGlobalTempView(name)
    return lines.select("file", "block", F.monotonically_increasing_id().alias("line"), "value")


def inside_after(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted cell is open at the end of a line that starts outside or inside one."""
    at, opening = 0, sep + '"'
    if not inside:
        at = 1 if line.startswith('"') else line.find(opening) + 2
        if at == 1 and not line.startswith('"'):
            return False
    while True:
        close = line.find('"', at)
        if close < 0:
            return True
        if line.startswith('"', close + 1):
            at = close + 2
            continue
        following = line.find(opening, close + 1)
        if following < 0:
            return False
        at = following + 2


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The batch in parts of one split each."""
    file, block = batch.column(0), batch.column(1)
    start = 0
    while start < batch.num_rows:
        name, at = file[start].as_py(), block[start].as_py()
        same = pc.and_(pc.equal(file.slice(start), name), pc.equal(block.slice(start), at))
        stop = pc.index(same, False).as_py()
        stop = batch.num_rows if stop < 0 else start + stop
        yield name, at, batch.slice(start, stop - start)
        start = stop


def _scan(sep: str):
    """Per split: the state after its lines from either start, whether a cell that is open at its start closes
    in it, and the first record of a file if the split holds all of it."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("if_out", pa.bool_()), ("if_in", pa.bool_()), ("closes", pa.bool_()), ("head", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        for batch in batches:
            for name, at, part in _runs(batch):
                if held is None or (held["file"], held["block"]) != (name, at):
                    if held:
                        yield pa.RecordBatch.from_pylist([_report(held)], schema=schema)
                    held = {"file": name, "block": at, "if_out": False, "if_in": True, "closes": False, "lines": [], "done": at > 0}
                values = part.column(3)
                if not held["done"]:
                    for value in values.to_pylist():
                        held["lines"].append(value)
                        held["open"] = inside_after(value, held.get("open", False), sep)
                        if not held["open"] and value.strip("\r"):
                            held["done"] = True
                            break
                for value in values.filter(pc.match_substring(values, '"')).to_pylist():
                    held["if_out"], held["if_in"] = inside_after(value, held["if_out"], sep), inside_after(value, held["if_in"], sep)
                    held["closes"] |= not held["if_in"]
        if held:
            yield pa.RecordBatch.from_pylist([_report(held)], schema=schema)

    return run, "file string, block long, if_out boolean, if_in boolean, closes boolean, head string"


def _report(held: dict) -> dict:
    head = "\n".join(held["lines"]).lstrip("\r\n").removesuffix("\r") if held["lines"] and held["done"] else None
    return {**{n: held[n] for n in ("file", "block", "if_out", "if_in", "closes")}, "head": head}


def _states(scanned: DataFrame) -> DataFrame:
    """(file, block, inside, owner): a split's true start state, and the split in which a record that is open there began."""
    along = Window.partitionBy("file").orderBy("block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    swap = (F.col("if_out") & ~F.col("if_in")).cast("int")
    marked = scanned.withColumn("swaps", F.sum(swap).over(upto))
    fixed = F.when(F.col("if_out") == F.col("if_in"), F.struct(F.col("if_out").alias("value"), "swaps"))
    last = marked.withColumn("last", F.last(fixed, ignorenulls=True).over(before)).withColumn("so_far", F.coalesce(F.lag("swaps").over(along), F.lit(0)))
    flips = F.col("so_far") - F.coalesce(F.col("last.swaps"), F.lit(0))
    started = last.withColumn("inside", F.coalesce("last.value", F.lit(False)) != (flips % 2 == 1))
    begins = F.when(~F.col("inside") | F.col("closes"), F.col("block"))
    return started.select("file", "block", "inside", F.last(begins, ignorenulls=True).over(before).alias("owner"))


_PIECES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("first", pa.bool_()), ("record", pa.string())])
_PIECES_DDL = "file string, block long, part int, first boolean, record string"
_WHOLE, _HEAD, _TAIL = 0, 1, 2


def _join_lines(sep: str, wanted: Sequence[int]):
    """Lines (file, block, line, value, inside) to whole records, or to the pieces at a split's ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        for batch in batches:
            out: list[dict] = []
            for name, at, part in _runs(batch):
                if held is None or (held["file"], held["block"]) != (name, at):
                    if held:
                        _finish(held, out)
                    inside = part.column(4)[0].as_py()
                    held = {"file": name, "block": at, "inside": inside, "kind": _HEAD if inside else _WHOLE, "lines": [], "first": at == 0}
                _records(held, part.column(3), sep, out)
            yield _pieces(out, wanted)
        if held:
            out = []
            _finish(held, out)
            yield _pieces(out, wanted)

    return run


def _records(held: dict, values: pa.Array, sep: str, out: list[dict]) -> None:
    quoted = pc.match_substring(values, '"').to_pylist()
    for value, has_quote in zip(values.to_pylist(), quoted):
        held["lines"].append(value)
        if has_quote:
            held["inside"] = inside_after(value, held["inside"], sep)
        if not held["inside"]:
            _emit(held, held["kind"], True, out)
            held["kind"] = _WHOLE


def _emit(held: dict, kind: int, ended: bool, out: list[dict]) -> None:
    record, held["lines"] = "\n".join(held["lines"]), []
    if ended:
        record = record.removesuffix("\r")
    if record or kind != _WHOLE:
        out.append({"file": held["file"], "block": held["block"], "part": kind, "first": held["first"] and kind != _HEAD, "record": record})
        held["first"] = False


def _finish(held: dict, out: list[dict]) -> None:
    """What is open at the end of a split: a record that goes on in the next, or all of a split inside one."""
    if held["lines"]:
        _emit(held, _TAIL if held["kind"] == _WHOLE else _HEAD, False, out)


def _pieces(rows: list[dict], wanted: Sequence[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([r for r in rows if r["part"] in wanted], schema=_PIECES)


class QuotedTable:
    """The records of quoted tables below `path` (a path or several)."""

    def __init__(self, spark: SparkSession, path: str | Sequence[str], sep: str = ",", split_bytes: int = SPLIT_BYTES) -> None:
        self.sep, self.lines = sep, _lines(spark, path, split_bytes)
        run, schema = _scan(sep)
        self.scanned = materialise(self.lines.mapInArrow(run, schema), "quote states")
        self.states = materialise(_states(self.scanned), "split states")

    def heads(self) -> DataFrame:
        """(file, record): the first record of every file."""
        whole = self.scanned.where((F.col("block") == 0) & F.col("head").isNotNull()).select("file", F.col("head").alias("record"))
        missing = self.scanned.where(F.col("block") == 0).join(whole, "file", "left_anti")
        if missing.isEmpty():
            return whole
        return self.records().where("first").select("file", "record")  # a first record of more than a split, or a file that starts with blank lines

    def records(self) -> DataFrame:
        """(file, first, record): logical records, `first` for the first one of a file; line breaks inside cells are kept."""
        states = self.states.select("file", "block", "inside")
        if self.states.count() <= BROADCAST_SPLITS:
            lines = self.lines.join(F.broadcast(states), ["file", "block"])
        else:
            lines = self.lines.join(states, ["file", "block"]).sortWithinPartitions("file", "block", "line")
        lines = lines.select("file", "block", "line", "value", "inside")
        whole = lines.mapInArrow(_join_lines(self.sep, [_WHOLE]), _PIECES_DDL).select("file", "first", "record")
        crossing = self.states.where("inside")
        if crossing.isEmpty():
            # without a split inside a cell only a file's end can leave a piece
            ends = self.scanned.groupBy("file").agg(F.max_by("if_out", "block").alias("open")).where("open")
            if ends.isEmpty():
                return whole
        pieces = lines.mapInArrow(_join_lines(self.sep, [_HEAD, _TAIL]), _PIECES_DDL)
        begun = self.states.select("file", "block", F.col("owner").alias("before"))
        owned = pieces.join(begun, ["file", "block"]).withColumn("owner", F.when(F.col("part") == _TAIL, F.col("block")).otherwise(F.col("before")))
        parts = F.array_sort(F.collect_list(F.struct("block", "record")))
        joined = owned.groupBy("file", "owner").agg(F.bool_or("first").alias("first"), parts.alias("parts"))
        text = F.concat_ws("\n", F.col("parts.record"))
        return whole.unionByName(joined.select("file", "first", text.alias("record")))

    def cells(self, schema: T.StructType, header: bool) -> DataFrame:
        """The records as columns of `schema`, parsed by Spark; with `header` the first record of a file is no row."""
        rows = self.records().where(~F.col("first")) if header else self.records()
        return parse(rows, schema, self.sep)


def parse(rows: DataFrame, schema: T.StructType, sep: str) -> DataFrame:
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
    return rows.select(F.from_csv("record", fields, options).alias("r")).select("r.*")


def split_cells(record: str, sep: str) -> list[str]:
    """The cells of one record, for headers."""
    import csv
    import io

    return next(csv.reader(io.StringIO(record, newline=""), delimiter=sep), [])
