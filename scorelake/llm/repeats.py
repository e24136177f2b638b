"""Substring dedup by fixed-block anchors.

A window is `WINDOW` consecutive words. A window is removed if its words also start in a document of
smaller id; a word goes if a removed window covers it.

Any window contains a whole block of `BLOCK` words that starts at a multiple of `BLOCK` in its own
document (13 >= 2 * 7 - 1). These blocks are the index; every rolling run of `BLOCK` words of every
document probes it. A probe that meets a block of another document is an anchor, and so is that
block. Anchors are extended to the windows that hold them, those windows are compared exactly (96
bits of hash), and the covered ones merge into maximal repeats.

How it moves: documents go compressed to groups of about `group_rows` by the hash of their id. A
group sends each hash once, 32 bits of it beside its bucket, so a passage that every document holds
costs one entry a group, and gets back those that other groups share. Groups settle among themselves
what they hold twice. The second exchange does the same for the windows around anchors, each with
the group's smallest id. Copies of a whole word sequence are found beside the first exchange and take
no part in the second. Nothing but one group or one bucket is ever in a task's memory, and the
number of both grows with the rows.

Null texts have no words. Rows with a null id are neither removed from nor referred to. Rows of equal
id don't remove from each other. Extra columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from scorelake.llm.texts import ROWS, mix, shingles, word_hashes

WINDOW = 13
BLOCK = 7
GROUP_ROWS = 2000
_OTHER = np.uint64(0x5851F42D4C957F2D)
_LOW = np.uint64(0xFFFFFFFF)
_EMPTY = np.zeros(0, dtype=np.uint64)

_SENT = "bucket int, group_no int, kind int, a binary, b binary, c binary"
_BACK = "group_no int, bucket int, kind int, a binary, b binary"
_INDEX, _PROBES, _COPIES, _WINDOWS = 0, 1, 2, 3


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text", group_rows: int = GROUP_ROWS, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, removed ('start:end' in words, end exclusive) and kept_sha256; `kept` as well with `with_text`."""
    groups = max(1, -(-df.count() // group_rows))
    own = F.col(key).cast("long")
    spread = F.pmod(F.xxhash64(F.coalesce(own, F.xxhash64(text))), F.lit(groups)).cast("int")
    rows = df.select(spread.alias("group_no"), own.alias("doc_id"), F.col(text).alias("row_text"))
    docs = rows.mapInArrow(_compress, "group_no int, doc_id long, packed binary")

    def send_blocks(table: pa.Table) -> pa.Table:
        return _sent(table["group_no"][0].as_py(), _Group(table, groups).block_parts(), groups)

    def send_windows(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _sent(0, [], groups)
        return _sent(table["group_no"][0].as_py(), _Group(table, groups).window_parts(back), groups)

    def finish(table: pa.Table, back: pa.Table) -> pa.Table:
        return _Group(table, groups).result(back, with_text)

    by_group = docs.groupBy("group_no")
    shared = by_group.applyInArrow(send_blocks, _SENT).groupBy("bucket").applyInArrow(_meet, _BACK)
    covered = by_group.cogroup(shared.groupBy("group_no")).applyInArrow(send_windows, _SENT).groupBy("bucket").applyInArrow(_meet, _BACK)
    result = "doc_id long, n_words long, n_removed long, removed string, kept_sha256 string" + ", kept string" * with_text
    return by_group.cogroup(shared.union(covered).groupBy("group_no")).applyInArrow(finish, result).withColumnRenamed("doc_id", key)


def _compress(batches):
    small = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            packed = [small.compress((t.as_py() or "").encode()) for t in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, type=pa.binary())], names=["group_no", "doc_id", "packed"])


class _Group:
    """The documents of one group, their word hashes end to end."""

    def __init__(self, table: pa.Table, groups: int):
        self.groups = groups
        self.ids = table["doc_id"].to_pylist()
        self.packed = table["packed"]
        self.plain = zstandard.ZstdDecompressor()
        self.words = [word_hashes(self.text(i)) for i in range(len(self.ids))]
        self.usable = [i for i, d in enumerate(self.ids) if d is not None and self.words[i].size >= WINDOW]

    def text(self, i: int) -> bytes:
        return self.plain.decompress(self.packed[i].as_py())

    def sequences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each usable document: two hashes of its whole word sequence, and its id."""
        power = np.cumprod(np.full(max((self.words[i].size for i in self.usable), default=0), _OTHER, dtype=np.uint64))
        one = np.array([_whole(self.words[i], power) for i in self.usable], dtype=np.uint64)
        two = np.array([_whole(self.words[i] ^ _OTHER, power) for i in self.usable], dtype=np.uint64)
        return one, two, np.array([self.ids[i] for i in self.usable], dtype=np.int64)

    def block_parts(self) -> list[tuple]:
        if not self.usable:
            return []
        runs = [shingles(self.words[i], BLOCK, short=False) for i in self.usable]
        every = _distinct(np.concatenate(runs))
        indexed = np.zeros(every.size, dtype=bool)
        indexed[np.searchsorted(every, np.concatenate([r[::BLOCK] for r in runs]))] = True
        index, probes = every[indexed], every[~indexed]
        one, two, ids = self.sequences()
        first = _first_of(one, ids)
        low = lambda x: (x & _LOW).astype("<u4")
        return [(_INDEX, index, low(index)), (_PROBES, probes, low(probes)), (_COPIES, one[first], one[first], two[first], ids[first])]

    def late_copies(self, back: pa.Table) -> set[int]:
        """Documents whose word sequence a document of smaller id has as well."""
        one, two, ids = self.sequences()
        if not one.size:
            return set()
        elsewhere = _found(one, two, *_pairs(back, _COPIES, "<u8"))
        return {self.usable[j] for j in np.flatnonzero(elsewhere | (ids > _least(one, ids))).tolist()}

    def candidates(self, back: pa.Table, late: set[int]) -> tuple[np.ndarray, ...]:
        """Windows around anchors: place of the document, start, two hashes, id; in order of place."""
        live = [i for i in self.usable if i not in late]
        found: list[tuple] = []
        if live:
            runs = [shingles(self.words[i], BLOCK, short=False) for i in live]
            every = np.concatenate(runs)
            anchor = _member(_travelled(every, self.groups), _distinct(_shared(back))) | _twice(every, runs)
            reach, at = WINDOW - BLOCK + 1, 0
            for i, run in zip(live, runs):
                marks = np.concatenate([[0], np.cumsum(anchor[at : at + run.size])])
                at += run.size
                starts = np.flatnonzero(marks[reach:] > marks[:-reach])
                if starts.size:
                    words = self.words[i]
                    found.append((np.full(starts.size, i), starts, shingles(words, WINDOW)[starts], shingles(words ^ _OTHER, WINDOW)[starts] & _LOW, np.full(starts.size, self.ids[i], dtype=np.int64)))
        if not found:
            none = np.zeros(0, dtype=np.int64)
            return none, none, _EMPTY, _EMPTY, none
        return tuple(map(np.concatenate, zip(*found)))

    def window_parts(self, back: pa.Table) -> list[tuple]:
        _, _, one, two, ids = self.candidates(back, self.late_copies(back))
        first = _first_of(one, ids)
        return [(_WINDOWS, one[first], one[first], two[first].astype("<u4"), ids[first])]

    def result(self, back: pa.Table, with_text: bool) -> pa.Table:
        late = self.late_copies(back)
        place, start, one, two, ids = self.candidates(back, late)
        gone: dict[int, np.ndarray] = {}
        if place.size:
            covered = _found(one, two, *_pairs(back, _WINDOWS, "<u4")) | (ids > _least(one, ids))
            place, start = place[covered], start[covered]
            edges = np.flatnonzero(np.diff(place, prepend=-1, append=-1)) if place.size else []
            gone = {int(place[s]): start[s:e] for s, e in zip(edges[:-1], edges[1:])}
        out: dict[str, list] = {n: [] for n in ("doc_id", "n_words", "n_removed", "removed", "kept_sha256", "kept")}
        for i, doc_id in enumerate(self.ids):
            words = self.text(i).split()
            drop = np.zeros(len(words) + 1, dtype=np.int32)
            if i in late:
                drop[0] = 1
            elif i in gone:
                np.add.at(drop, gone[i], 1)
                np.add.at(drop, gone[i] + WINDOW, -1)
            drop = np.cumsum(drop)[:-1] > 0
            edges = np.flatnonzero(np.diff(drop.astype(np.int8), prepend=0, append=0))
            kept = b" ".join([w for w, d in zip(words, drop.tolist()) if not d] if edges.size else words)
            out["doc_id"].append(doc_id)
            out["n_words"].append(len(words))
            out["n_removed"].append(int(drop.sum()))
            out["removed"].append(",".join(f"{s}:{e}" for s, e in zip(edges[::2].tolist(), edges[1::2].tolist())))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept.decode() if with_text else None)
        kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "removed": pa.string(), "kept_sha256": pa.string()} | ({"kept": pa.string()} if with_text else {})
        return pa.table({n: pa.array(out[n], type=t) for n, t in kinds.items()})


def _whole(words: np.ndarray, power: np.ndarray) -> int:
    return int(mix(np.array([(mix(words) * power[: words.size]).sum(dtype=np.uint64)], dtype=np.uint64))[0])


def _distinct(value: np.ndarray) -> np.ndarray:
    """Sorted, each value once."""
    value = np.sort(value)
    return value[np.concatenate([[True], value[1:] != value[:-1]])] if value.size else value


def _member(value: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is among the sorted known ones."""
    if not known.size:
        return np.zeros(value.size, dtype=bool)
    return known[np.minimum(np.searchsorted(known, value), known.size - 1)] == value


def _twice(every: np.ndarray, runs: list[np.ndarray]) -> np.ndarray:
    """Whether two documents of the group have the run, and one of them as an indexed block."""
    owner = np.repeat(np.arange(len(runs)), [r.size for r in runs])
    order = np.argsort(every)
    value, holder = every[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    several = value[begin[np.minimum.reduceat(holder, begin) != np.maximum.reduceat(holder, begin)]]
    known = several[_member(several, _distinct(np.concatenate([r[::BLOCK] for r in runs])))]
    return _member(every, known)


def _first_of(value: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Where the smallest id of each value stands."""
    order = np.lexsort((ids, value))
    kept = value[order]
    return order[np.concatenate([[True], kept[1:] != kept[:-1]])] if order.size else order


def _least(value: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row the smallest id of its value."""
    first = _first_of(value, ids)
    return ids[first][np.searchsorted(value[first], value)]


def _found(one: np.ndarray, two: np.ndarray, known_one: np.ndarray, known_two: np.ndarray) -> np.ndarray:
    """Whether (one, two) is among the known pairs; within a group `one` alone tells values apart."""
    if not known_one.size:
        return np.zeros(one.size, dtype=bool)
    order = np.argsort(known_one)
    known_one, known_two = known_one[order], known_two[order]
    at = np.minimum(np.searchsorted(known_one, one), known_one.size - 1)
    return (known_one[at] == one) & (known_two[at] == two)


def _bucket(value: np.ndarray, buckets: int) -> np.ndarray:
    return ((value >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)


def _travelled(value: np.ndarray, buckets: int) -> np.ndarray:
    """What of a block's hash is sent: its bucket and the lowest 32 bits."""
    return (_bucket(value, buckets) << np.uint64(32)) | (value & _LOW)


def _sent(group_no: int, parts: list[tuple], buckets: int) -> pa.Table:
    """Rows by bucket of (kind, hash that chooses the bucket, up to three columns)."""
    rows: list[tuple] = []
    for kind, chooser, *columns in parts:
        bucket = _bucket(chooser, buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, columns = bucket[order], [c[order] for c in columns]
        edges = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1, append=-1)) if bucket.size else []
        for s, e in zip(edges[:-1], edges[1:]):
            rows.append((int(bucket[s]), group_no, kind, *(c[s:e].tobytes() for c in columns), *[None] * (3 - len(columns))))
    return _table(rows, ("bucket", "group_no", "kind", "a", "b", "c"))


def _table(rows: list[tuple], names: tuple) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.table({n: pa.array(c, type=pa.binary() if len(n) == 1 else pa.int32()) for n, c in zip(names, columns)})


def _read(table: pa.Table, kinds: tuple, name: str, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """One column of the rows of `kinds`, end to end, and the row each value is from."""
    rows = [i for i, k in enumerate(table["kind"].to_pylist()) if k in kinds]
    blobs = [table[name][i].as_py() for i in rows]
    sizes = [len(b) // np.dtype(dtype).itemsize for b in blobs]
    return np.frombuffer(b"".join(blobs), dtype=dtype), np.repeat(np.array(rows, dtype=np.int64), sizes)


def _shared(back: pa.Table) -> np.ndarray:
    low, row = _read(back, (_INDEX,), "a", "<u4")
    bucket = np.array(back["bucket"].to_pylist(), dtype=np.uint64)
    return (bucket[row] << np.uint64(32)) | low.astype(np.uint64)


def _pairs(back: pa.Table, kind: int, second: str) -> tuple[np.ndarray, np.ndarray]:
    return _read(back, (kind,), "a", "<u8")[0], _read(back, (kind,), "b", second)[0].astype(np.uint64)


def _meet(table: pa.Table) -> pa.Table:
    """What the groups that meet in one bucket share, back to each."""
    bucket = table["bucket"][0].as_py()
    group = np.array(table["group_no"].to_pylist(), dtype=np.int64)
    kind = np.array(table["kind"].to_pylist(), dtype=np.int64)
    rows: list[tuple] = []

    def answer(what: int, owner: np.ndarray, *columns: np.ndarray) -> None:
        order = np.argsort(owner, kind="stable")
        owner, columns = owner[order], [c[order] for c in columns]
        edges = np.flatnonzero(np.diff(owner, prepend=-1, append=-1)) if owner.size else []
        for s, e in zip(edges[:-1], edges[1:]):
            rows.append((int(owner[s]), bucket, what, *(c[s:e].tobytes() for c in columns), *[None] * (2 - len(columns))))

    low, row = _read(table, (_INDEX, _PROBES), "a", "<u4")
    if low.size:
        order = np.argsort(low, kind="stable")
        low, row = low[order], row[order]
        begin = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        sizes = np.diff(begin, append=low.size)
        shared = (sizes > 1) & np.logical_or.reduceat(kind[row] == _INDEX, begin)
        keep = np.repeat(shared, sizes)
        answer(_INDEX, group[row[keep]], low[keep])
    for what, second in ((_COPIES, "<u8"), (_WINDOWS, "<u4")):
        one, row = _read(table, (what,), "a", "<u8")
        if one.size:
            two, ids = _read(table, (what,), "b", second)[0], _read(table, (what,), "c", "<i8")[0]
            order = np.lexsort((ids, two, one))
            one, two, ids, row = one[order], two[order], ids[order], row[order]
            begin = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
            late = ids > np.repeat(ids[begin], np.diff(begin, append=ids.size))
            answer(what, group[row[late]], one[late], two[late])
    return _table(rows, ("group_no", "bucket", "kind", "a", "b"))
