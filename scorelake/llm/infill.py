"""Fill-in-middle transformation, cut at token boundaries kept in a compressed set.

Tokens are runs of ASCII letters and single other characters. The places where tokens begin, and the
end of the text, form a set of integers that is kept by ranges of 65,536 positions: a sorted array of 16-bit
numbers, a bitmap of 1,024 words or a list of runs, whichever is smallest. Cumulative cardinalities
over the containers find the one that holds the m-th boundary; inside it a place in the array, a bit by
cumulative popcounts or a run by cumulative lengths gives the position. So both cuts are two lookups, and a
text of any length costs a bitmap at most per 65,536 characters.

Cuts and form come from the sha256 of `seed:` and the key in decimal, so a document is cut the same way
in every run. Form `plain` leaves the text as it is: for empty texts, for those that hold a marker, and
for a share of the rest. `psm` is marker, prefix, marker, suffix, marker, middle; `spm` has the suffix
first. `restored` gives the text back from output and form: the pieces hold no marker, and none can arise
where a piece meets one.

A null text counts as empty, a null key as an empty one. Repeated rows each come back; extra columns are
left out by `fill_in_middle`. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from scorelake.llm.texts import over_rows

SPAN_BITS = 16
SPAN = 1 << SPAN_BITS
PLAIN_FROM, SPM_BELOW = 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class ArrayPart:
    """Sorted 16-bit positions."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, place: int) -> int:
        return int(self.low[place])


class BitmapPart:
    """One bit per position and the set bits before each word of 64."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(SPAN, dtype=np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def select(self, place: int) -> int:
        word = int(np.searchsorted(self.before, place, side="right")) - 1
        value = int(self.words[word])
        for _ in range(place - int(self.before[word])):
            value &= value - 1
        return word * 64 + (value & -value).bit_length() - 1


class RunPart:
    """First positions of runs of consecutive positions, and the positions before each run."""

    def __init__(self, low: np.ndarray):
        starts = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        self.first, self.before = low[starts].astype(np.uint16), starts.astype(np.int32)

    def select(self, place: int) -> int:
        run = int(np.searchsorted(self.before, place, side="right")) - 1
        return int(self.first[run]) + place - int(self.before[run])


def part_of(low: np.ndarray) -> ArrayPart | BitmapPart | RunPart:
    """The smallest container: 2 bytes a position, 8 KiB, or 4 bytes a run."""
    runs = 1 + int(np.count_nonzero(np.diff(low) != 1))
    if 4 * runs < min(2 * low.size, SPAN // 8):
        return RunPart(low)
    return ArrayPart(low) if 2 * low.size <= SPAN // 8 else BitmapPart(low)


class PositionSet:
    """A set of positions, added in rising spans, with the m-th smallest by `select`."""

    def __init__(self) -> None:
        self.spans: list[int] = []
        self.parts: list[ArrayPart | BitmapPart | RunPart] = []
        self.upto: list[int] = []

    def add_span(self, span: int, low: np.ndarray) -> None:
        """The positions span * 65,536 + low, `low` sorted; spans come in rising order."""
        if low.size:
            self.spans.append(span)
            self.parts.append(part_of(low))
            self.upto.append(len(self) + low.size)

    def __len__(self) -> int:
        return self.upto[-1] if self.upto else 0

    def select(self, place: int) -> int:
        if not 0 <= place < len(self):
            raise IndexError(place)
        part = int(np.searchsorted(self.upto, place, side="right"))
        return (self.spans[part] << SPAN_BITS) + self.parts[part].select(place - (self.upto[part - 1] if part else 0))


def boundaries(text: str) -> PositionSet:
    """Where tokens begin, and the length of the text."""
    found, inside = PositionSet(), False
    for span, piece in enumerate(_spans(text)):
        code = np.frombuffer(piece.encode("utf-32-le"), dtype="<u4")
        letter = (((code | 0x20) - ord("a")) < 26) & (code < 128)
        follows = letter.copy()
        follows[1:] &= letter[:-1]
        follows[0] &= inside
        low = np.flatnonzero(~follows)
        inside = bool(letter[-1])
        if code.size < SPAN:
            low = np.append(low, code.size)
        found.add_span(span, low)
    if len(text) % SPAN == 0:
        found.add_span(len(text) >> SPAN_BITS, np.zeros(1, dtype=np.int64))
    return found


def _spans(text: str) -> Iterator[str]:
    for start in range(0, len(text), SPAN):
        yield text[start : start + SPAN]


def draws(key: object, seed: int = 1) -> list[int]:
    """The first four 32-bit numbers of the key's digest."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(key: object, text: str | None, seed: int = 1, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, prefix_chars, middle_chars, output) of one text."""
    text = text or ""
    places, (one, two, three, four) = boundaries(text), draws(key, seed)
    n = len(places) - 1
    if not text or three % 100 >= plain_from or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, last = (places.select(p) for p in sorted((one % (n + 1), two % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    if four % 100 < spm_below:
        return n, "spm", first, last - first, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", first, last - first, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) per row, in one pass."""

    def rows(columns):
        found = [transform(k, t, seed, plain_from, spm_below) for k, t in zip(columns["row_key"], columns["row_text"])]
        return {"row_key": columns["row_key"], **{name: [f[i] for f in found] for i, name in enumerate(("n", "form", "prefix_chars", "middle_chars", "output"))}}

    narrow = df.select(F.col(key).cast("long").alias("row_key"), F.col(text).alias("row_text"))
    result = over_rows(narrow, ["row_key", "row_text"], "row_key long, n long, form string, prefix_chars long, middle_chars long, output string", rows)
    return result.withColumnRenamed("row_key", key)


def restored(output: Column, form: Column) -> Column:
    """The text from output and form, by the first marker after each piece."""
    body = F.substring(output, len(PREFIX) + 1, F.length(output))

    def split(second: str) -> tuple[Column, Column, Column]:
        head = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(head) + len(second) + 1, F.length(body))
        mid = F.substring_index(rest, MIDDLE, 1)
        return head, mid, F.substring(rest, F.length(mid) + len(MIDDLE) + 1, F.length(rest))

    p_prefix, p_suffix, p_middle = split(SUFFIX)
    s_suffix, s_prefix, s_middle = split(PREFIX)
    return F.when(form == "plain", output).when(form == "psm", F.concat(p_prefix, p_middle, p_suffix)).otherwise(F.concat(s_prefix, s_middle, s_suffix))
