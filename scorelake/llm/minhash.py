"""Document fingerprints by one-permutation MinHash.

Shingles of five words are hashed once each; the hash picks one of `BINS` bins and the smallest rest
stays in it. An empty bin takes the value of the first filled bin in a random order of its own
(optimal densification: a bin's donor depends on the bin and on which bins are filled, not on its
neighbours). The lowest `WIDTH` bits of every value are packed and stored as base64. Two different
values agree in those bits by chance once in 2^WIDTH, which `likeness` takes off again.

A text of fewer than five words is one shingle. A text without words (null counts as empty) has the
fingerprint '': its likeness to another such text is 1, to any other 0. Fingerprints depend on words
only, so equal texts have equal fingerprints.

`with_edits` sets beside each document the one after it. Rows are ordered by doc_id, nulls last,
then by the text's xxhash64; repeated rows follow each other, and a table of one row follows itself. Ranges of doc_id come from bounded quantiles, texts
travel once and compressed, and the first row of a range is also sent to the range before it.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from scorelake.llm.texts import ROWS, mix, over_rows, shingles, word_hashes

SHINGLE_WORDS = 5
BINS = 512
WIDTH = 4
RANGE_ROWS = 1000
MAX_RANGES = 1 << 15
_REST = np.uint64(64 - 9)
#: bins that got one value from the same donor must not agree by the same chance
_SALT = np.random.Generator(np.random.PCG64(78)).integers(0, 2**64, size=BINS, dtype=np.uint64)


@functools.lru_cache(maxsize=1)
def _donor_order() -> tuple[np.ndarray, np.ndarray]:
    """asked[i, a]: the bin that bin i asks as its a-th, a random permutation; and the inverse, turn[i, j]."""
    asked = np.random.Generator(np.random.PCG64(77)).random((BINS, BINS)).argsort(axis=1)
    return asked.astype(np.int16), asked.argsort(axis=1).astype(np.int16)


def _donors(empty: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """For each empty bin the first filled one in its order."""
    asked, turn = _donor_order()
    if filled.size < BINS // 8:  # few to choose from: compare their turns
        return filled[turn[empty[:, None], filled].argmin(axis=1)]
    full = np.zeros(BINS, dtype=bool)
    full[filled] = True
    donor = asked[empty, 0].astype(np.int64)
    left, a = np.flatnonzero(~full[donor]), 1
    while left.size:
        donor[left] = asked[empty[left], a]
        left, a = left[~full[donor[left]]], a + 1
    return donor


def bins(words: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray | None:
    """Densified bin values of a document given its word hashes; None without words."""
    hashes = shingles(words, k)
    if not hashes.size:
        return None
    hashes = np.sort(hashes)  # by bin and value at once: the bin is in the highest bits
    place = (hashes >> _REST).astype(np.int64)
    first = np.ones(place.size, dtype=bool)
    first[1:] = place[1:] != place[:-1]
    filled, least = place[first], hashes[first]
    value = np.zeros(BINS, dtype=np.uint64)
    value[filled] = least
    if filled.size < BINS:
        full = np.zeros(BINS, dtype=bool)
        full[filled] = True
        empty = np.flatnonzero(~full)
        value[empty] = value[_donors(empty, filled)]
    return value


def pack(value: np.ndarray | None) -> str:
    """The low bits of all bins, two bins a byte, as base64."""
    if value is None:
        return ""
    low = (mix(value ^ _SALT) & np.uint64((1 << WIDTH) - 1)).astype(np.uint8)
    return base64.b64encode(low[0::2] << WIDTH | low[1::2]).decode()


def unpack(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), dtype=np.uint8)
    return np.stack([raw >> WIDTH, raw & ((1 << WIDTH) - 1)], axis=1).ravel()


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard likeness of two fingerprints, chance agreement taken off, in [0, 1]."""
    if not a or not b:
        return float(a == b)
    chance = 1.0 / (1 << WIDTH)
    agree = float((unpack(a) == unpack(b)).mean())
    return min(1.0, max(0.0, (agree - chance) / (1.0 - chance)))


def fingerprint(text: str | None) -> str:
    return pack(bins(word_hashes((text or "").encode())))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) per row."""
    narrow = df.select(F.col(key).alias("row_key"), F.col(text).alias("row_text"))
    rows = lambda c: {"row_key": c["row_key"], "fingerprint": [fingerprint(t) for t in c["row_text"]]}
    return over_rows(narrow, ["row_key", "row_text"], "row_key long, fingerprint string", rows).withColumnRenamed("row_key", key)


def range_starts(df: DataFrame, key: str, range_rows: int) -> list[int]:
    """First ids of ranges of about `range_rows` rows: the smallest id and quantiles, at most MAX_RANGES in all."""
    n, least = df.agg(F.count(key), F.min(key)).first()
    count = min(MAX_RANGES, max(1, -(-n // range_rows)))
    if count == 1:
        return [] if least is None else [least]
    parts = F.array(*(F.lit(i / count) for i in range(1, count)))
    return sorted({least, *df.agg(F.percentile_approx(key, parts, 4 * count)).first()[0]})


_SENT = "part int, role int, doc_id long, text_hash long, packed binary"
_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_OWN, _AHEAD, _WRAP = 0, 1, 2


def with_edits(df: DataFrame, key: str = "doc_id", text: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per row: its fingerprint, that of its edited text, and its likeness to both that and the next row's.

    The edited text has the last quarter of the code points (rounded down) replaced by as many of
    the next row's text from its start; the last row is followed by the first.
    """
    starts = range_starts(df, key, range_rows)
    last = max(0, len(starts) - 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                out: list[list] = [[], [], [], [], []]
                part = batch.slice(begin, ROWS)
                for row in zip(*(part.column(i).to_pylist() for i in range(3))):
                    number = last if row[0] is None else max(0, bisect_right(starts, row[0]) - 1)
                    places = [(number, _OWN)]
                    if starts and row[0] == starts[number]:
                        places.append((number - 1, _AHEAD) if number else (last, _WRAP))
                    packed = small.compress((row[2] or "").encode())
                    for place in places:
                        for column, value in zip(out, (*place, row[0], row[1], packed)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "role", "doc_id", "text_hash", "packed"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        before = None
        for row in _unpacked(batches):
            if before is not None and before[0] == row[0] and before[1] == _OWN:
                out.append(_compared(before, row))
                if len(out) == ROWS:
                    yield _as_batch(out)
                    out = []
            before = row
        if before is not None and before[1] == _OWN:  # rows of null ids only: the last has no first row to meet but itself
            out.append(_compared(before, before))
        if out:
            yield _as_batch(out)

    narrow = df.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("row_text"))
    sent = narrow.mapInArrow(send, _SENT)
    order = ["part", "role", F.col("doc_id").asc_nulls_last(), "text_hash"]
    return sent.repartition("part").sortWithinPartitions(*order).mapInArrow(compare, _ROW)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(part, role, doc_id, text, fingerprint) row by row."""
    plain = zstandard.ZstdDecompressor()
    for batch in batches:
        for i in range(batch.num_rows):
            part, role, doc_id, packed = (batch.column(c)[i].as_py() for c in (0, 1, 2, 4))
            text = plain.decompress(packed).decode()
            yield part, role, doc_id, text, fingerprint(text)


def _compared(row: tuple, after: tuple) -> tuple:
    text, mark = row[3], row[4]
    spare = len(text) // 4
    edited = text[: len(text) - spare] + after[3][:spare]
    changed = fingerprint(edited)
    return row[2], len(text), hashlib.sha256(edited.encode()).hexdigest(), mark, changed, likeness(mark, changed), likeness(mark, after[4])


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = [f.split()[0] for f in _ROW.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names=names)
