"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are cut where the split pattern always ends a match: after an ASCII letter or digit that
an ASCII character of another kind follows. No alternative of the pattern continues over such a
place and none looks back, so the parts give the ids of the whole text. A stretch without such a
place is encoded whole. A long run of white space is one match, but for its last character if text
follows; it goes to the library as a single piece, because the library's pattern engine runs out of
stack on it.

A null text counts as empty and has no tokens. Special tokens are ordinary text. Extra columns are
left out of the digests and kept by `encode` and `decode`, which refuse a name already taken.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F, types as T

from scorelake.llm.texts import over_rows

PART_CHARS = 1 << 16
LONG_SPACE = 4096
_WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_RUN = re.compile(_WHITE + "{" + str(LONG_SPACE) + ",}")
_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?=[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f])")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.lru_cache(maxsize=4)
def encoding(ranks: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of one rank file (lines of base64 token and rank), loaded once per worker."""
    with open(ranks, "rb") as f:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """`text` in parts of about `size` characters, cut at safe places only."""
    start = 0
    while len(text) - start > size:
        place = _SAFE.search(text, start + size)
        if place is None:
            break
        yield text[start : place.start()]
        start = place.start()
    yield text[start:] if start else text


def encode_text(coder: tiktoken.Encoding, text: str | None) -> list[int]:
    text, ids, start = text or "", [], 0
    for run in _RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += _encode_parts(coder, text[start : run.start()])
        ids += coder._encode_single_piece(text[run.start() : end])
        start = end
    return ids + _encode_parts(coder, text[start:])


def _encode_parts(coder: tiktoken.Encoding, text: str) -> list[int]:
    ids: list[int] = []
    for part in parts(text):
        ids += coder.encode_ordinary(part)
    return ids


def encode(df: DataFrame, text: str = "text", into: str = "token_ids", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """`df` with the token ids of a text column as array<int>. The rank file lies on every node."""
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()

    def ids_of(values: pa.Array) -> pa.Array:
        coder = encoding(ranks, pattern)
        return pa.array([encode_text(coder, v.as_py()) for v in values], type=pa.list_(pa.int32()))

    return _with_column(df, text, into, T.ArrayType(T.IntegerType()), ids_of)


def decode(df: DataFrame, ids: str = "token_ids", into: str = "decoded", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """`df` with the bytes of an id column; they need not be UTF-8. Null ids give no bytes; an unknown id is an error."""
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()

    def bytes_of(values: pa.Array) -> pa.Array:
        coder = encoding(ranks, pattern)
        return pa.array([coder.decode_bytes(v.as_py() or []) for v in values], type=pa.binary())

    return _with_column(df, ids, into, T.BinaryType(), bytes_of)


def encode_checked(df: DataFrame, text: str = "text", into: str = "token_ids", check: str = "exact", ranks: str | None = None, pattern: str | None = None, at_once: int = 256) -> DataFrame:
    """`df` with the token ids of a text column in its place, and whether they decode to its bytes.

    `encode` and `decode` in one pass: a task has one Python worker, and the text doesn't travel back.
    """
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()
    others = [c for c in df.columns if c != text]
    if {into, check} & {*others}:
        raise ValueError(f"column {into} or {check} exists")

    def run(batches):
        coder = encoding(ranks, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)
                texts = part.column(len(others)).to_pylist()
                ids = [encode_text(coder, t) for t in texts]
                exact = [coder.decode_bytes(i) == (t or "").encode() for i, t in zip(ids, texts)]
                columns = [*part.columns[:-1], pa.array(ids, type=pa.list_(pa.int32())), pa.array(exact, type=pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=[*others, into, check])

    kept = df.select(*others, text)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields[:-1], T.StructField(into, T.ArrayType(T.IntegerType())), T.StructField(check, T.BooleanType())]))


def _with_column(df: DataFrame, source: str, into: str, kind: T.DataType, fn, at_once: int = 256) -> DataFrame:
    if into in df.columns:
        raise ValueError(f"column {into} exists")
    place = df.columns.index(source)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)
                yield pa.RecordBatch.from_arrays([*part.columns, fn(part.column(place))], names=[*part.schema.names, into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, kind)]))


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per row: key, n_tokens, and digests of the ids and of the bytes decoded from them.

    `encode`, `decode` and the digests in one pass over the texts, so that no id array travels to
    the JVM and back.
    """
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()

    def rows(columns):
        coder = encoding(ranks, pattern)
        out: dict[str, list] = {"row_key": columns["row_key"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "exact": []}
        for value in columns["row_text"]:
            ids = encode_text(coder, value)
            raw = coder.decode_bytes(ids)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(raw).hexdigest())
            out["exact"].append(raw == (value or "").encode())
        return out

    narrow = df.select(F.col(key).alias("row_key"), F.col(text).alias("row_text"))
    result = over_rows(narrow, ["row_key", "row_text"], "row_key long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean", rows)
    return result.withColumnRenamed("row_key", key)
