"""SimHash near-duplicates by one-wildcard segment variants.

Fingerprints that differ in at most two bits are linked. A fingerprint is cut into two 32-bit
segments: of two differences, one segment holds at most one. Each segment is indexed whole and with
every single bit masked, an equality join on those 66 keys brings candidates together, and a bit
count verifies them.

A key that more than `crowd` fingerprints share is not joined with itself. Its fingerprints go the
exact way for dense groups: each is listed under itself and its 64 one-bit neighbours. Two
fingerprints differ in at most two bits exactly if they share such a listing, and a listing holds 65
different fingerprints at most, so a star per listing keeps every link without pairs.

Equal fingerprints are one node, so copies never multiply. Null and empty texts have the fingerprint
zero and are linked like any other. A component's id is its smallest doc_id (null ids are passed
over; a component of null ids has a null id). Repeated rows each come back; extra columns are left out.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from scorelake.llm.graph import components
from scorelake.llm.texts import over_rows, pieces
from scorelake.session import materialise as cut

SHINGLE_WORDS = 3
SEED = 42
CROWD = 8
_BITS = 64
_HALF = 32


def fingerprint(text: str | None, k: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of the k-word shingles, repeats counted."""
    counts, total, carried = np.zeros(_BITS, dtype=np.int64), 0, []
    for piece in pieces((text or "").encode().lower()):
        words = carried + piece.split()
        if len(words) >= k:
            runs = map(b" ".join, zip(*(words[j:] for j in range(k))))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(seed)), dtype="<u8", count=len(words) - k + 1)
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += hashes.size
            carried = words[-(k - 1) :] if k > 1 else []
        else:
            carried = words
    if not total:
        if not carried:
            return 0
        return int(np.array([xxhash.xxh64_intdigest(b" ".join(carried), seed)], dtype="<u8").view("<i8")[0])
    return int(np.packbits(2 * counts > total, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) per row; text_hash tells rows of one id apart."""

    def rows(columns):
        return {"doc_id": columns["doc_id"], "text_hash": columns["text_hash"], "fp": [fingerprint(t) for t in columns["row_text"]]}

    narrow = df.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("row_text"))
    return over_rows(narrow, ["doc_id", "text_hash", "row_text"], "doc_id long, text_hash long, fp long", rows)


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between different fingerprints of `fps` (fp, distinct) that give its components."""
    index = fps.select("fp", F.explode(F.array(*_variants(F.col("fp")))).alias("key"))
    shared = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(index.join(shared, "key").select("key", "fp", "n"))
    few = members.where(F.col("n") <= crowd).select("key", "fp")
    pairs = (
        few.select("key", F.col("fp").alias("a"))
        .join(few.select("key", F.col("fp").alias("b")), "key")
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))
        .select("a", "b")
    )
    dense = members.where(F.col("n") > crowd).select("fp").distinct()
    near = dense.select("fp", F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << p))) for p in range(_BITS)))).alias("place"))
    stars = near.select(F.min("fp").over(Window.partitionBy("place")).alias("a"), F.col("fp").alias("b")).where("a < b")
    return pairs.union(stars).distinct()


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _variants(fp: Column) -> list[Column]:
    segments = (F.shiftrightunsigned(fp, _HALF), fp.bitwiseAND(F.lit(0xFFFFFFFF)))
    keys = []
    for s, segment in enumerate(segments):
        for p in range(_HALF + 1):
            masked = segment if p == _HALF else segment.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << p)))
            keys.append(masked.bitwiseOR(F.lit((s * (_HALF + 1) + p) << _HALF)))
    return keys


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """Per row: doc_id, text_hash, fp, root (smallest fingerprint of the component) and component_id."""
    rows = cut(fingerprints(df, key, text))
    firsts = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(firsts.select("fp"), crowd)).withColumnRenamed("node", "fp")
    found = firsts.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = found.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(found.join(ids, "root").select("fp", "root", "component_id"), "fp")


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """The rows of `df` without near-duplicates: one row of each component stays, that of the smallest id.

    All columns come back as they are, whatever their names.
    """
    return one_of_each(df, near_duplicates(df, key, text, crowd), key, text)


def one_of_each(df: DataFrame, seen: DataFrame, key: str, text: str) -> DataFrame:
    """One row of `df` for each `root` of `seen` (doc_id, text_hash, root per row): that of the smallest id."""
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    first = seen.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.id").alias("first_id"), F.col("first.hash").alias("first_hash"))
    rows = df.select(F.struct(*(df[c] for c in df.columns)).alias("row"), df[key].alias("id"), F.xxhash64(df[text]).alias("hash"))
    same = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("hash") == F.col("first_hash"))
    copy = Window.partitionBy("id", "hash").orderBy("hash")
    return rows.join(first, same, "left_semi").withColumn("copy", F.row_number().over(copy)).where("copy = 1").select("row.*")
