"""Packing tokenised texts into sequences of a fixed capacity by best-two-fit.

A text becomes its token ids and one end id; only a text with more than `capacity` of them is cut, into
full pieces and a rest. Sequences are filled one at a time: greedily with the longest piece that fits,
and if a gap stays, the shortest piece gives way to the two unpacked ones that fit the widened gap most
tightly, if they fit it better.

Pieces of one length are alike, so the filling runs on the table of counts by length, which has at most
`capacity` rows however long the corpus is. A filling that can be repeated is repeated as often as its
lengths last, which is what one sequence after the other would do; so the plan is a list of fillings
with multiplicities, a few rows per length. Each piece then finds its place from its length and its rank
among the pieces of this length. Ranks come from buckets of about the square root of a length's count,
so neither a bucket nor the list of buckets is large, even if one length holds a third of all pieces.

Texts are tokenised by units that the tokenizer never joins, and ids of short units are kept in a bounded
table per worker. In characters up to U+017F, which the tokenizer's normaliser only lower-cases, a unit
is a match of its split pattern. Anything else, and what may hold a special token, is a unit from white
space to white space that goes to the library as it is. Unknown units go there in batches joined by
spaces. Very long texts are read in spans that end before white space; a very long unit of the second
kind is cut where an ASCII letter or digit meets one of `.,;:/?&=_-`, also a safe place.

A null text counts as empty: one piece, the end id. Null keys and repeated rows are pieces like any
other; equal pieces may change places. An empty table gives no rows. Extra columns are left out by
`pieces`, and kept by `pack`, which refuses a table that already has its output names. A length that
is null, below 1 or over the capacity is an error in `pack`.
"""

from __future__ import annotations

import bisect
import functools
import re
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from scorelake.session import materialise as cut

CAPACITY = 4096
END_ID = 1
KEPT_UNITS = 250_000
SHORT_UNIT = 64
LONG_UNIT = 1 << 16
SPAN_CHARS = 1 << 18
ROWS = 256
_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?=[.,;:/?&=_-])")
_BREAK = re.compile(r"[\t-\r ]")
_OTHER = re.compile("[^\x00-\u012f\u0131-\u017f]")
_LETTERS = "a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_WHITE = "\t-\r \x85\xa0"
_WORD = re.compile(f"[{_LETTERS}]+|[{_NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^{_WHITE}{_LETTERS}{_NUMBERS}]+")
_RANK_BITS = 48


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --- texts to pieces


class Coder:
    """Token ids of texts as packed little-endian 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # plain units are lower-cased and split already, and each ends with one token that is marked as the last of a word
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last = np.zeros(self.plain.get_vocab_size(), dtype=bool)
        self.last[[i for t, i in self.plain.get_vocab().items() if t.endswith("</w>")]] = True
        # units met lately and before that: a unit that is met again moves up, the older half goes when the newer is full
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        chars = 0
        for i, text in enumerate(texts):
            for span in spans(text or ""):
                held.append((i, units(span)))
                chars += len(span)
                if chars > SPAN_CHARS:
                    self._code(held, out)
                    held, chars = [], 0
        self._code(held, out)
        return [b"".join(parts) for parts in out]

    def _code(self, held: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        if len(self.known) > KEPT_UNITS:
            self.known, self.older = {}, self.known
        new = [u for u in set().union(*(names for _, names in held)) if u not in self.known]
        self.known.update((u, self.older[u]) for u in new if u in self.older)
        new = [u for u in new if u not in self.known]
        fresh = {**dict(self._ask_plain([u for u in new if is_plain(u)])), **dict(self._ask([u for u in new if not is_plain(u)]))}
        self.known.update(fresh)
        for i, names in held:
            out[i].append(b"".join(map(self.known.__getitem__, names)))
        for unit in fresh:
            if len(unit) > SHORT_UNIT:
                del self.known[unit]

    def _ask_plain(self, names: list[str]) -> Iterator[tuple[str, bytes]]:
        for first in range(0, len(names), ROWS):
            some = names[first : first + ROWS]
            ids = np.array(self.plain.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            yield from _dealt(some, ids, np.flatnonzero(self.last[ids]) + 1)

    def _ask(self, names: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of other units: a token belongs to the unit that its place in the joined text lies in."""
        for first in range(0, len(names), ROWS):
            some = names[first : first + ROWS]
            coded = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            begins = np.cumsum([0, *(len(u) + 1 for u in some)])
            yield from _dealt(some, np.array(coded.ids, dtype="<u4"), np.searchsorted(np.array(coded.offsets, dtype=np.int64).reshape(-1, 2)[:, 0], begins[1:]))


def _dealt(names: list[str], ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple[str, bytes]]:
    raw, start = ids.tobytes(), 0
    for name, end in zip(names, (4 * ends).tolist(), strict=True):
        yield name, raw[start:end]
        start = end


def is_plain(text: str) -> bool:
    return "<|" not in text and _OTHER.search(text) is None


def spans(text: str) -> Iterator[str]:
    """`text` in spans that end before ASCII white space."""
    start = 0
    while len(text) - start > SPAN_CHARS:
        place = _BREAK.search(text, start + SPAN_CHARS)
        if place is None:
            break
        yield text[start : place.start()]
        start = place.start()
    yield text[start:] if start else text


def units(text: str) -> list[str]:
    """`text` in parts whose ids, one after the other, are those of the text."""
    if is_plain(text):
        return _WORD.findall(text.lower())
    found: list[str] = []
    for chunk in text.encode().split():
        chunk = chunk.decode()
        if is_plain(chunk):
            found += _WORD.findall(chunk.lower())
        else:
            found += _parts(chunk)
    return found


def _parts(chunk: str) -> Iterator[str]:
    start = 0
    while len(chunk) - start > LONG_UNIT:
        place = _SAFE.search(chunk, start + LONG_UNIT)
        if place is None:
            break
        yield chunk[start : place.start()]
        start = place.start()
    yield chunk[start:]


@functools.lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) per piece: its number, the ids of its text before it, its own ids.

    ids_crc32 is the checksum of the ids as little-endian 32-bit numbers; `with_ids=False` leaves the
    ids themselves in the task. The tokenizer file lies on every node.
    """
    path, end = tokenizer or default_tokenizer(), np.array([end_id], dtype="<u4").tobytes()
    kind = next(f.dataType for f in df.schema.fields if f.name == key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                yield _cut_up(part, [ids + end for ids in coder(path).encode(part.column(1).to_pylist())], capacity, with_ids)

    fields = [T.StructField(key, kind), T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32"))]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    return df.select(F.col(key), F.col(text)).mapInArrow(run, T.StructType(fields))


def _cut_up(part: pa.RecordBatch, coded: list[bytes], capacity: int, with_ids: bool) -> pa.RecordBatch:
    width = 4 * capacity
    owner, number, raw = [], [], []
    for i, ids in enumerate(coded):
        for n, at in enumerate(range(0, len(ids), width)):
            owner.append(i)
            number.append(n)
            raw.append(ids[at : at + width])
    columns = [
        part.column(0).take(pa.array(owner, type=pa.int64())), pa.array(number, type=pa.int32()), pa.array([n * capacity for n in number], type=pa.int64()),
        pa.array([len(r) // 4 for r in raw], type=pa.int64()), pa.array(list(map(zlib.crc32, raw)), type=pa.int64()),
    ]
    names = [part.schema.names[0], "piece", "start", "length", "ids_crc32"]
    if with_ids:
        columns.append(pa.array([np.frombuffer(r, dtype="<i4") for r in raw], type=pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names=names)


# --- the plan


def fillings(counts: Mapping[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: pieces}) in the order of filling: best-two-fit on counts by length."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths, plan = sorted(left), []
    while lengths:
        filling, gap, at = {}, capacity, len(lengths)
        while gap and (at := bisect.bisect_right(lengths, gap, 0, at)):
            longest = lengths[at - 1]
            filling[longest] = min(left[longest], gap // longest)
            gap -= filling[longest] * longest
            at -= 1
        shortest = min(filling)
        if gap and sum(filling.values()) > 1 and (pair := _tightest(lengths, left, filling, gap + shortest)) and sum(pair) > shortest:
            filling[shortest] -= 1
            for n in pair:
                filling[n] = filling.get(n, 0) + 1
            filling = {n: c for n, c in filling.items() if c}
        times = min(left[n] // c for n, c in filling.items())
        plan.append((times, filling))
        for n, c in filling.items():
            left[n] -= times * c
            if not left[n]:
                del left[n], lengths[bisect.bisect_left(lengths, n)]
    return plan


def _tightest(lengths: list[int], left: Mapping[int, int], filling: Mapping[int, int], room: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum within `room`; of equal sums the one with the longest piece."""
    free = [n for n in lengths[: bisect.bisect_left(lengths, room)] if left[n] > filling.get(n, 0)]
    if not free:
        return None
    spare = np.array([left[n] - filling.get(n, 0) for n in free])
    one = np.array(free)
    two = np.searchsorted(one, np.minimum(room - one, one), side="right") - 1
    two -= (two == np.arange(one.size)) & (spare < 2)
    total = np.where(two >= 0, one + one[two], -1)
    best = total.size - 1 - int(np.argmax(total[::-1]))
    return (int(one[best]), int(one[two[best]])) if total[best] > 0 else None


class Plan:
    """Places by length and rank: the m-th piece of a length lies in sequence and at offset of the last run that starts at or before it."""

    def __init__(self, counts: Mapping[int, int], capacity: int):
        runs, used, sequence = [], dict.fromkeys(counts, 0), 0
        for times, filling in fillings(counts, capacity):
            offset = 0
            for length in sorted(filling, reverse=True):
                each = filling[length]
                runs.append((length << _RANK_BITS | used[length], each, sequence, offset))
                used[length] += times * each
                offset += each * length
            sequence += times
        self.sequences = sequence
        self.first, self.each, self.sequence, self.offset = (np.array(c, dtype=np.int64) for c in (zip(*sorted(runs)) if runs else [()] * 4))

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = (length << _RANK_BITS) | rank
        run = np.searchsorted(self.first, code, side="right") - 1
        turn, turned = np.divmod(code - self.first[run], self.each[run])
        return self.sequence[run] + turn, self.offset[run] + turned * length


# --- packing


def pack(df: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """The rows of `df` with sequence_id and offset (long). `df` is written once; keep it narrow."""
    if taken := {"sequence_id", "offset"} & set(df.columns):
        raise ValueError(f"columns {sorted(taken)} exist")
    # the number is stored with its row, so it is the same in every later read
    rows = cut(df.select(F.struct(*(df[c] for c in df.columns)).alias("row"), df[length].cast("long").alias("length"), F.monotonically_increasing_id().alias("number")))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).limit(capacity + 1).collect()}
    if any(n is None or not 1 <= n <= capacity for n in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    plan = Plan(counts, capacity)
    buckets = rows.sparkSession.createDataFrame([(n, int(np.ceil(np.sqrt(c)))) for n, c in counts.items()], "length long, buckets int")
    dealt = rows.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("number"), "buckets")).drop("buckets")  # at most `capacity` rows
    held = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("length", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("number"))
    ranked = dealt.withColumn("inside", inside).join(starts, ["length", "bucket"]).select("row", "length", (F.col("before") + F.col("inside") - 1).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sequence, offset = plan.places(batch.column(1).to_numpy(), batch.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sequence), pa.array(offset)], names=["row", "sequence_id", "offset"])

    schema = T.StructType([rows.schema["row"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(run, schema).select("row.*", "sequence_id", "offset")


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """(sequence_id, ids, offsets): the token ids of each sequence of `pack(pieces(...))` and where its pieces begin."""
    held = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", F.col(ids).alias("ids")))).alias("parts"))
    return held.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), F.col("parts.offset").alias("offsets"))
