"""Near-duplicates at a shingle similarity, found by SimHash segments with one wildcard.

Operator 3 links 64-bit fingerprints that differ in two bits, as its contract says; texts whose five-word
shingles are 80 % alike differ in far more. Here the same method has more bits and a check of the words:

* The fingerprint has 288 bits over the different two-word shingles of a text. A changed word touches
  two of these; scattered changes that leave a five-word similarity of 0.8 change about one bit in ten.
* It is cut into 8 segments of 9 hex digits. Each segment is indexed 9 times, with one digit deleted. Texts
  that differ in at most one digit of at least one segment share a key. A key keeps 32 bits, so chance
  partners per text are 2 for each 100 million texts; `SEGMENTS` and `DIGITS` set both.
* Alone this isn't enough: a replaced block or an added tail turns the whole fingerprint, one bit in seven at a
  similarity of 0.8, and of planted pairs 0.84 were found with 14 segments. So each text also has 10 sample keys, each of 4
  bins of operator 4's fingerprint of its five-word shingles: at 0.8 a pair shares one with a chance of 0.995, whatever the edit.
* Inside a key texts are sorted by a hash. Each is compared with the first of its key (a star, not all
  pairs), and with the one before it if their stars did not meet. A key is sorted, never collected.
* A pair counts if its estimated five-word similarity is at least `similarity` less SLACK. The estimate is
  operator 4's fingerprint (512 bins of 4 bits, 256 bytes, standard error 0.018 at 0.8), so a comparison moves
  bytes of a fixed number whatever the length of the texts.

What these keys and the estimate leave out is found exactly (`missing_links`). Shingles in order of how many texts
hold them, rarest first: two texts at `similarity` t or more share one of their first n - ceil(t n) + 1 of n. Texts of different
components that share one there are compared by their whole shingle sets, so every pair at t or more is linked.
Shingles don't move as rows: different texts go compressed to groups of about GROUP_ROWS, as in operator 6. A group sends each
shingle once, 32 bits of it and how many of its texts hold it, to the bucket of the shingle, and gets back the numbers of those
that several texts hold. Two shingles that agree in bucket and bits count together, which bends the order and nothing else. Only the
first shared shingles of each text become rows, and a group already linked makes no pairs.

A text is a node by its lower-cased words (A-Z), so copies that differ in white space or case never multiply. Null
and empty texts and those without words are one node, like any other copies. A text of fewer than five (two) words is one shingle
of all its words. A component's id is its smallest doc_id; repeated rows each come back.
"""

from __future__ import annotations

import base64
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from scorelake.llm import minhash
from scorelake.llm.graph import components
from scorelake.llm.simhash import one_of_each
from scorelake.llm.texts import ROWS, mix, over_rows, shingles, word_hashes
from scorelake.session import materialise

FEATURE_WORDS = 2
SEGMENTS = 8
DIGITS = 9
SAMPLES = 10
SAMPLE_BINS = 4
SIMILARITY = 0.8
SLACK = 0.02
GROUP_ROWS = 2000
_WIDTH = 4 * DIGITS
_LANES = np.random.Generator(np.random.PCG64(91)).integers(0, 2**64, size=-(-SEGMENTS * _WIDTH // 64), dtype=np.uint64)
_MARKS = np.random.Generator(np.random.PCG64(92)).integers(0, 2**64, size=SAMPLES, dtype=np.uint64)
_POWERS = 1 << np.arange(_WIDTH, dtype=np.int64)
_AT_ONCE = 1 << 14
_LOW = np.uint64(0xFFFFFFFF)
_MOST = (1 << 16) - 1

cut = partial(materialise, free=True)


def segments(words: np.ndarray) -> list[int]:
    """The segments of the wide SimHash of a text given its word hashes; zeros without words."""
    features = np.unique(shingles(words, FEATURE_WORDS))
    ones = np.zeros(64 * _LANES.size, dtype=np.int64)
    for start in range(0, features.size, _AT_ONCE):
        lanes = mix(features[start : start + _AT_ONCE, None] ^ _LANES)
        ones += np.unpackbits(lanes.view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
    bits = (2 * ones > features.size)[: SEGMENTS * _WIDTH].reshape(SEGMENTS, _WIDTH)
    return (bits @ _POWERS).tolist()


def samples(bins: np.ndarray | None) -> list[int]:
    """Sample keys of a text given its shingle bins, above all segment keys; none without words."""
    if bins is None:
        return []
    keys = _MARKS.copy()
    for column in bins[: SAMPLES * SAMPLE_BINS].reshape(SAMPLES, SAMPLE_BINS).T:
        keys = mix(keys ^ column)
    return (keys >> np.uint64(2) | np.uint64(1 << 62)).astype(np.int64).tolist()


def signature(text: str | None) -> tuple[int, list[int], list[int], bytes]:
    """(node, segments, samples, packed shingle fingerprint) of a text."""
    words = word_hashes((text or "").encode().lower())
    node = xxhash.xxh64_intdigest(words.tobytes())
    bins = minhash.bins(words)
    return node - (1 << 64) if node >> 63 else node, segments(words), samples(bins), base64.b64decode(minhash.pack(bins))


def signatures(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, node, segments, samples, sketch) per row; text_hash tells rows of one id apart."""

    def rows(columns):
        found = [signature(t) for t in columns["row_text"]]
        return {
            "doc_id": columns["doc_id"], "text_hash": columns["text_hash"], "node": [f[0] for f in found],
            "segments": pa.array([f[1] for f in found], type=pa.list_(pa.int64())),
            "samples": pa.array([f[2] for f in found], type=pa.list_(pa.int64())), "sketch": [f[3] for f in found],
        }

    narrow = df.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("row_text"))
    schema = "doc_id long, text_hash long, node long, segments array<long>, samples array<long>, sketch binary"
    return over_rows(narrow, ["doc_id", "text_hash", "row_text"], schema, rows)


def _keys(parts: Column) -> Column:
    """Every segment with every digit deleted, marked by which."""

    def variants(part: Column, number: Column) -> Column:
        return F.array(
            *(
                part.bitwiseAND(F.lit(((1 << _WIDTH) - 1) ^ (0xF << 4 * d))).bitwiseOR(
                    F.shiftleft((number * DIGITS + d).cast("long"), _WIDTH)
                )
                for d in range(DIGITS)
            )
        )

    return F.flatten(F.transform(parts, variants))


def _neighbours(nodes: DataFrame) -> DataFrame:
    """(node, leader, before): the first text of a shared key in the order of a hash, and the one before."""
    order = Window.partitionBy("key").orderBy(F.xxhash64("node"), "node")
    index = nodes.select("node", F.explode(F.concat(_keys(F.col("segments")), F.col("samples"))).alias("key"))
    placed = index.select("node", F.first("node").over(order).alias("leader"), F.lag("node").over(order).alias("before"))
    return cut(placed.where(F.col("before").isNotNull()).distinct())


def _verified(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose estimated shingle similarity is at least `least`."""
    left, right = (nodes.select(F.col("node").alias(n), F.col("sketch").alias(f"{n}_sketch")) for n in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "a_sketch", "b_sketch")
    chance = 1.0 / (1 << minhash.WIDTH)

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            other = a ^ b
            agree = ((other & 0x0F) == 0).sum(axis=1) + ((other & 0xF0) == 0).sum(axis=1)
            near = (agree / minhash.BINS - chance) / (1 - chance) >= least
            yield batch.select(["a", "b"]).filter(pa.array(near))

    # texts without words are one node and their sketch is empty; they have no similar text
    wordy = both.where((F.length("a_sketch") > 0) & (F.length("b_sketch") > 0))
    return wordy.mapInArrow(run, "a long, b long")


def _shingle_set(packed: bytes) -> np.ndarray:
    return np.unique(shingles(word_hashes(zstandard.decompress(packed)), minhash.SHINGLE_WORDS))


def shingle_sets(df: DataFrame, text: str = "text") -> DataFrame:
    """(node, packed): the different texts, compressed, whose five-word shingles `missing_links` compares.

    Texts without words are left out. A task gives each text once; copies that several tasks read stay.
    """

    def run(batches):
        small, seen = zstandard.ZstdCompressor(level=3), set()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                found = {}
                for t in batch.column(0).slice(start, ROWS):
                    data = (t.as_py() or "").encode().lower()
                    words = word_hashes(data)
                    node = xxhash.xxh64_intdigest(words.tobytes())
                    if words.size and node not in seen:
                        seen.add(node)
                        found[node - (1 << 64) if node >> 63 else node] = small.compress(data)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), type=pa.int64()), pa.array(list(found.values()), type=pa.binary())], names=["node", "packed"])

    return df.select(F.col(text).alias("row_text")).mapInArrow(run, "node long, packed binary")


def _places(value: np.ndarray, buckets: int) -> np.ndarray:
    """What of a shingle is sent: its bucket and, as the lower half, its lowest 32 bits."""
    bucket = ((value >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)
    return (bucket << np.uint64(32)) | (value & _LOW)


def _group_sets(table: pa.Table) -> dict[int, np.ndarray]:
    """node -> its sorted shingles, of the texts of one group; copies once."""
    packed = dict(zip(table["node"].to_pylist(), table["packed"].to_pylist()))
    return {node: _shingle_set(p) for node, p in packed.items()}


def _by_bucket(owner: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """(owner, bytes of each column) for every run of one owner."""
    edges = np.flatnonzero(np.diff(owner.astype(np.int64), prepend=-1, append=-1)) if owner.size else []
    return [(int(owner[s]), *(c[s:e].tobytes() for c in columns)) for s, e in zip(edges[:-1], edges[1:])]


def _meet(table: pa.Table) -> pa.Table:
    """For the shingles of one bucket that several texts hold: how many, back to each group that has them."""
    bucket = table["bucket"][0].as_py()
    blobs = table["low"].to_pylist()
    group = np.repeat(np.array(table["group_no"].to_pylist(), dtype=np.int64), [len(b) // 4 for b in blobs])
    low = np.frombuffer(b"".join(blobs), dtype="<u4")
    held = np.frombuffer(b"".join(table["more"].to_pylist()), dtype="<u2").astype(np.int64) + 1
    _, at = np.unique(low, return_inverse=True)
    texts = np.bincount(at, weights=held).astype(np.int64)[at]
    shared = texts > 1
    group, low, texts = group[shared], low[shared], np.minimum(texts[shared], _MOST).astype("<u2")
    order = np.argsort(group, kind="stable")
    rows = _by_bucket(group[order], low[order], texts[order])
    owner, low, texts = zip(*rows) if rows else ((), (), ())
    return pa.table({
        "group_no": pa.array(owner, type=pa.int32()), "bucket": pa.array([bucket] * len(owner), type=pa.int32()),
        "low": pa.array(low, type=pa.binary()), "texts": pa.array(texts, type=pa.binary()),
    })


def _rarest(sets: DataFrame, similarity: float, group_rows: int) -> DataFrame:
    """(node, n, at, s): of each text's n shingles, rarest first, those of the first n - ceil(similarity n) + 1 that other texts hold.

    `at` is the shingle's place in that order, from 0.
    """
    groups = max(1, -(-sets.count() // group_rows))
    by_group = sets.select(F.pmod("node", F.lit(groups)).cast("int").alias("group_no"), "node", "packed").groupBy("group_no")

    def send(table: pa.Table) -> pa.Table:
        found = list(_group_sets(table).values())
        place, held = np.unique(_places(np.concatenate(found), groups), return_counts=True)
        rows = _by_bucket(place >> np.uint64(32), (place & _LOW).astype("<u4"), (np.minimum(held, _MOST + 1) - 1).astype("<u2"))
        bucket, low, more = zip(*rows)
        return pa.table({
            "bucket": pa.array(bucket, type=pa.int32()), "group_no": pa.array([table["group_no"][0].as_py()] * len(bucket), type=pa.int32()),
            "low": pa.array(low, type=pa.binary()), "more": pa.array(more, type=pa.binary()),
        })

    def choose(table: pa.Table, back: pa.Table) -> pa.Table:
        lows = back["low"].to_pylist()
        place = np.repeat(np.array(back["bucket"].to_pylist(), dtype=np.uint64), [len(b) // 4 for b in lows]) << np.uint64(32)
        place |= np.frombuffer(b"".join(lows), dtype="<u4").astype(np.uint64)
        order = np.argsort(place)
        place, texts = place[order], np.frombuffer(b"".join(back["texts"].to_pylist()), dtype="<u2")[order]
        nodes, sizes, places, keys = [], [], [], []
        for node, own in _group_sets(table).items() if place.size else ():
            mine = _places(own, groups)
            at = np.minimum(np.searchsorted(place, mine), place.size - 1)
            shared = place[at] == mine
            # shingles of one text only are the rarest, so they stand first
            alone = int(own.size - shared.sum())
            taken = own.size - int(np.ceil(own.size * similarity - 1e-9)) + 1 - alone
            if taken > 0:
                first = own[shared][np.lexsort((own[shared], texts[at[shared]]))[:taken]]
                nodes.append(np.full(first.size, node, dtype=np.int64))
                sizes.append(np.full(first.size, own.size, dtype=np.int64))
                places.append(np.arange(alone, alone + first.size, dtype=np.int64))
                keys.append(first.view(np.int64))
        whole = [np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in (nodes, sizes, places, keys)]
        return pa.table(dict(zip(("node", "n", "at", "s"), whole)))

    back = by_group.applyInArrow(send, "bucket int, group_no int, low binary, more binary")
    back = back.groupBy("bucket").applyInArrow(_meet, "group_no int, bucket int, low binary, texts binary")
    return by_group.cogroup(back.groupBy("group_no")).applyInArrow(choose, "node long, n long, at long, s long")


def _candidates(keys: DataFrame, similarity: float) -> DataFrame:
    """(a, b): texts of different roots that share one of `keys` (`_rarest`, root) and may share enough after it.

    What two texts share stands, in both, from the first shingle they share on. So at that shingle both must have as
    many left as two texts at `similarity` share; a group whose texts have a passage in common and little else makes no pairs.
    """
    mixed = keys.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("s")
    keys = keys.join(mixed, "s", "left_semi")
    a, b = (keys.select("s", *(F.col(c).alias(f"{side}_{c}") for c in ("node", "n", "at", "root"))) for side in "ab")
    left = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    enough = left >= (F.col("a_n") + F.col("b_n")) * (similarity / (1 + similarity)) - 1e-9
    pairs = a.hint("merge").join(b, "s").where((F.col("a_root") < F.col("b_root")) & enough)
    return pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()


def missing_links(sets: DataFrame, roots: DataFrame, similarity: float = SIMILARITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b): every pair of texts of `sets` (`shingle_sets`) at `similarity` or more that `roots` (node, root) holds apart."""
    keys = _rarest(sets, similarity, group_rows)
    keys = cut(keys.join(roots, "node", "left").select("node", "n", "at", "s", F.coalesce("root", "node").alias("root")))
    pairs = cut(_candidates(keys, similarity))
    met = sets.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node", "left_semi")
    met = cut(met.dropDuplicates(["node"]))
    left, right = (met.select(F.col("node").alias(n), F.col("packed").alias(f"{n}_packed")) for n in "ab")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part, known = batch.slice(start, ROWS), {}
                for node, packed in ((0, 2), (1, 3)):
                    for n, p in zip(part.column(node).to_pylist(), part.column(packed)):
                        if n not in known:
                            known[n] = _shingle_set(p.as_py())
                near = []
                for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    common, n = np.intersect1d(known[a], known[b], assume_unique=True).size, known[a].size + known[b].size
                    near.append(common >= (n - common) * similarity - 1e-9)
                yield part.select(["a", "b"]).filter(pa.array(near, type=pa.bool_()))

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "a_packed", "b_packed")
    return both.mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, similarity: float = SIMILARITY, sets: DataFrame | None = None) -> DataFrame:
    """(node, root) of the texts of `nodes` (node, segments, samples, sketch; one row each) that have a similar one.

    With their shingle sets (`shingle_sets`) no pair at `similarity` or more is left out.
    """
    least = similarity - SLACK
    near = _neighbours(nodes)
    stars = near.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    linked = cut(_verified(stars, nodes, least))
    roots = cut(components(linked))
    root_of = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    chains = near.where("before <> leader").select(F.least("node", "before").alias("a"), F.greatest("node", "before").alias("b"))
    apart = chains.distinct().join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    apart = apart.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")
    more = cut(_verified(apart, nodes, least))
    if more.limit(1).count():
        linked = linked.union(more)
        roots = cut(components(linked))
    if sets is None:
        return roots
    rest = cut(missing_links(sets, roots, similarity))
    return components(linked.union(rest)) if rest.limit(1).count() else roots


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Per row: doc_id, text_hash, root (smallest node of the component) and component_id."""
    rows = cut(signatures(df, key, text))
    same = [F.first(c).alias(c) for c in ("segments", "samples", "sketch")]  # equal in all rows of a node
    nodes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), *same))
    roots = links(nodes, similarity, cut(shingle_sets(df, text)))
    found = nodes.select("node", "first_id").join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    ids = found.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.select("doc_id", "text_hash", "node").join(found.join(ids, "root").select("node", "root", "component_id"), "node").drop("node")


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `df` without near-duplicates: one row of each component stays, that of the smallest id.

    All columns come back as they are, whatever their names.
    """
    return one_of_each(df, near_duplicates(df, key, text, similarity), key, text)
