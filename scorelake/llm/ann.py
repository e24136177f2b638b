"""Approximate nearest neighbours by cosine with randomly rotated one-bit codes.

Unit vectors are centred on the corpus mean and turned by a random rotation; the signs of the turned
residual are its code, packed to bits. Beside it stand two scalars: the residual's length and its
inner product with its code's vertex. A query is turned the same way, unquantised. From packed bits
and scalars follow an unbiased estimate of each inner product and a bound on its error that holds
for each vector with high probability (`SIGMAS` standard deviations). Per query, the vectors of the
best estimates are computed exactly; every vector whose upper bound reaches the k-th of those is
computed as well. So the answer is exact but for bounds that fail.

Work is dealt by partition of the index: a partition holds `part_rows` vectors in memory and the
queries stream past it, so no side is broadcast and no pair leaves a task but each partition's best
k. Equal vectors are one index entry with their k + 1 smallest ids, which are all that can be among
k nearest; a hot vector thus costs one entry.

Ids and vectors must not be null; a vector that is empty, zero, or holds a null or non-finite
component takes no part, as query or candidate. Vectors of different length are not compared. Rows of
a query's own id are never its answers. A query without candidates has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from scorelake.session import materialise as cut


PART_ROWS = 4096
SIGMAS = 3.0
QUERIES_AT_ONCE = 128
_ROUNDING = 1e-5  # of the single-precision estimate


def usable(vector: Column) -> Column:
    wide = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(wide, lambda x: x != 0.0), F.lit(False))


class Codes:
    """One-bit codes of the vectors of one partition."""

    def __init__(self, vectors: np.ndarray, seed: int = 11):
        self.size, self.width = vectors.shape
        self.unit = vectors / norms(vectors)[:, None]
        self.centre = self.unit.mean(axis=0)
        self.rotation = rotation(self.width, seed)
        turned = (self.unit - self.centre) @ self.rotation
        self.length = np.sqrt((turned * turned).sum(axis=1))
        self.packed = np.packbits(turned > 0, axis=1)
        ends = np.abs(turned).sum(axis=1) / np.sqrt(self.width)
        self.agree = np.where(self.length > 0, ends / np.where(self.length > 0, self.length, 1.0), 1.0)
        self.spread = np.sqrt(np.maximum(0.0, 1.0 - self.agree**2) / self.agree**2 / max(1, self.width - 1))
        self.base = self.unit @ self.centre - self.centre @ self.centre

    def estimate(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of unit queries with every vector, and the standard deviation of the error."""
        shifted = (queries - self.centre) @ self.rotation
        bits = np.unpackbits(self.packed, axis=1, count=self.width).astype(np.float32)
        # the vertex has components of +-1/sqrt(width), so its product with q is (2 * sum over set bits - sum) / sqrt(width)
        vertex = (2.0 * (shifted.astype(np.float32) @ bits.T) - shifted.sum(axis=1, dtype=np.float32)[:, None]) / np.sqrt(self.width)
        guess = vertex / self.agree * self.length + (queries @ self.centre)[:, None] + self.base
        error = np.linalg.norm(shifted, axis=1)[:, None] * (self.length * self.spread)
        return guess, error


def norms(vectors: np.ndarray) -> np.ndarray:
    """Lengths that neither overflow nor vanish for extreme components."""
    top = np.abs(vectors).max(axis=1)
    return top * np.sqrt(((vectors / top[:, None]) ** 2).sum(axis=1))


def rotation(width: int, seed: int) -> np.ndarray:
    turn, upper = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((width, width)))
    return turn * np.sign(np.diag(upper))


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact cosines in double precision, each row summed on its own."""
    return (vectors / norms(vectors)[:, None] * (query / norms(query[None])[0])).sum(axis=1)


def nearest(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", part_rows: int = PART_ROWS, sigmas: float = SIGMAS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of every row that `is_query` picks."""
    rows = df.where(F.col(key).isNotNull() & usable(F.col(vector))).select(
        F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    # equal vectors: only the k + 1 smallest ids can be among k nearest that are not the query's own
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = rows.select("id", "vector").distinct().withColumn("place", place).where(F.col("place") <= k + 1)
    entries = cut(few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    parts = max(1, -(-entries.count() // part_rows))
    indexed = entries.select(F.pmod(F.xxhash64("vector"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), "ids", "vector")
    asking = rows.where("asks").select("id", "vector").distinct()
    asked = asking.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), F.array("id").alias("ids"), "vector")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {"part": None, "ids": [], "vectors": [], "codes": {}}
        for batch in batches:
            part, kind = (np.asarray(batch.column(i)) for i in (0, 1))
            ids, vectors = batch.column(2), batch.column(3)
            edges = np.flatnonzero(np.diff(part * 2 + kind, prepend=-1, append=-1))
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if part[s] != held["part"]:
                    held = {"part": part[s], "ids": [], "vectors": [], "codes": {}}
                if kind[s] == 0:
                    held["ids"] += ids.slice(s, e - s).to_pylist()
                    held["vectors"] += [np.asarray(v.values) for v in vectors.slice(s, e - s)]
                elif held["ids"]:
                    for b in range(s, e, QUERIES_AT_ONCE):
                        n = min(QUERIES_AT_ONCE, e - b)
                        yield from _answers(held, ids.slice(b, n).to_pylist(), [np.asarray(v.values) for v in vectors.slice(b, n)], k, sigmas)

    dealt = indexed.union(asked).repartition("part").sortWithinPartitions("part", "kind")
    best = dealt.mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _answers(held: dict, ids: list, vectors: list, k: int, sigmas: float) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for width in {v.size for v in vectors}:
        if width not in held["codes"]:
            places = [i for i, v in enumerate(held["vectors"]) if v.size == width]
            held["codes"][width] = (Codes(np.array([held["vectors"][i] for i in places])), places) if places else None
        if held["codes"][width] is None:
            continue
        codes, places = held["codes"][width]
        mine = [j for j, v in enumerate(vectors) if v.size == width]
        queries = np.array([vectors[j] for j in mine])
        queries /= norms(queries)[:, None]
        guess, error = codes.estimate(queries)
        reach = guess + sigmas * error + _ROUNDING
        # one entry may hold only the query's own id, so one more than k is computed first
        sure = min(k + 1, codes.size)
        for row, j in enumerate(mine):
            own = ids[j][0]
            first = np.argpartition(-guess[row], sure - 1)[:sure]
            exact = np.sort(codes.unit[first] @ queries[row])
            floor = exact[0] if sure > k else -np.inf
            chosen = np.flatnonzero(reach[row] >= floor)
            chosen = np.union1d(chosen, first)
            scores = (codes.unit[chosen] * queries[row]).sum(axis=1)
            found = [(-s, i) for s, c in zip(scores.tolist(), chosen.tolist()) if s >= floor - 1e-12 for i in held["ids"][places[c]] if i != own]
            out += [(own, i, -s) for s, i in sorted(found)[:k]]
    columns = list(zip(*out)) or [(), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])
