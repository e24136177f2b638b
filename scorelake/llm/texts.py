"""Words and rolling hashes of texts inside Arrow tasks, in bounded pieces.

A word is a run of bytes other than space and \\x09-\\x0D. Hashes are 64 bits wide and the same in
every process: their constants come from a seeded generator.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PIECE = 1 << 20
ROWS = 256

_draw = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _draw.integers(0, 2**64, size=256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (two multiply-xorshift rounds)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def pieces(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """`data` cut before white space, in pieces of about `size` bytes (a longer word stays whole)."""
    start, n = 0, len(data)
    while n - start > size:
        tail = data[start + size : start + 2 * size]
        skip = len(tail.split(None, 1)[0]) if tail and not _SPACE[tail[0]] else 0
        cut = start + size + skip
        while cut < n and not _SPACE[data[cut]]:
            cut += 1
        yield data[start:cut]
        start = cut
    if start < n or n == 0:
        yield data[start:]


def word_hashes(data: bytes) -> np.ndarray:
    """One hash per word of `data`, in order."""
    found = [h for h in map(_piece_hashes, pieces(data)) if h.size]
    if not found:
        return np.zeros(0, dtype=np.uint64)
    return found[0] if len(found) == 1 else np.concatenate(found)


def _piece_hashes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    space = _SPACE[raw]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not starts.size:
        return np.zeros(0, dtype=np.uint64)
    raw, space, starts = raw[starts[0] :], space[starts[0] :], starts - starts[0]
    reach = np.diff(starts, append=raw.size)
    place = np.arange(raw.size) - np.repeat(starts, reach)
    power = np.cumprod(np.full(int(reach.max()), _STEP, dtype=np.uint64))
    value = _BYTE[raw] * power[place]
    value[space] = 0
    return mix(np.add.reduceat(value, starts))


def shingles(words: np.ndarray, k: int, short: bool = True) -> np.ndarray:
    """Hashes of the runs of k consecutive words; with `short`, fewer words make one run."""
    n = words.size
    if n < k:
        if not short or n == 0:
            return np.zeros(0, dtype=np.uint64)
        k = n
    total = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        total = total * _STEP + words[j : n - k + 1 + j]
    return mix(total)


def over_rows(df: DataFrame, columns: list[str], schema: str, rows: Callable[[dict[str, list]], dict[str, list]], at_once: int = ROWS) -> DataFrame:
    """`rows` over the listed columns, a few hundred rows at a time; one output row per input row.

    `rows` gets and returns lists by column name. Only `columns` leave the JVM.
    """
    kept = df.select(*columns)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)
                out = rows({c: part.column(i).to_pylist() for i, c in enumerate(columns)})
                yield pa.RecordBatch.from_arrays([out[c] if isinstance(out[c], pa.Array) else pa.array(out[c], type=_ARROW[t]) for c, t in zip(names, types)], names=names)

    types = [f.split()[1] for f in schema.split(", ")]
    return kept.mapInArrow(run, schema)


_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(),
    "binary": pa.binary(), "array<int>": pa.list_(pa.int32()),
}
