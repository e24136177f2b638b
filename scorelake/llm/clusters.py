"""Centroid clustering of integer vectors with a Walsh-Hadamard progressive search.

Components become floor(scale * x). Vectors and centroids go through the integer Walsh-Hadamard
transform, rows in order of their sign changes, so the leading coefficients are the coarse ones; squared
differences of all coefficients sum to `width` times the squared distance, exactly. Per vector the coarse
coefficients of every centroid are compared first. The leading centroid is finished and gives a bound;
a centroid whose partial sum is larger than the bound is strictly worse and goes, the others take up the
next finer coefficients until all are in. So every distance that decides is the exact one, and of equal
ones the smaller centroid number wins.

Centroids start as the vectors with the smallest sha256 of `salt` and the id. Every round is one pass
over the input's two columns: a task gives one row of sums per centroid, these are merged in about the
square root of their number of tasks, and the centroids go on as literals of the next pass. Nothing
else moves; only the last assignment (id, cluster, distance) is written, because its rows and its sums
are both wanted. The input should be a table or a checkpoint, since it is read once per round.

Vectors that are null, not `width` long, or hold a null or non-finite component take no part. Equal
vectors and repeated rows each count. A null id is clustered but starts no centroid. Fewer
than `k` vectors give as many centroids; a table without any gives no rows. Components too large for 64-bit
sums are computed with Python integers; a distance or inertia beyond a long is given as the largest
long. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from scorelake.session import materialise as cut

WIDTH, SCALE, CENTROIDS, ROUNDS, SALT = 64, 1024, 8, 10, "3:"
STEPS = (4, 16, 32)
ROWS = 4096
_LARGEST = (1 << 63) - 1


def transform(values: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of each row, coarse to fine."""
    n, width = values.shape
    out, half = values, 1
    while half < width:
        pairs = out.reshape(n, width // (2 * half), 2, half)
        out = np.concatenate((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, width)
        half *= 2
    return out[:, _coarse_first(width)]


def _coarse_first(width: int) -> np.ndarray:
    signs = np.array([[bin(i & j).count("1") & 1 for j in range(width)] for i in range(width)])
    return np.argsort(np.abs(np.diff(signs, axis=1)).sum(axis=1), kind="stable")


def whole(vectors: pa.Array, width: int = WIDTH, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """(places of the usable vectors, their integer components); Python integers where 64 bits may not do."""
    right = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False).to_numpy(zero_copy_only=False))
    flat = vectors.take(pa.array(right)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    good = np.isfinite(flat).all(axis=1)
    places, flat = right[good], flat[good]
    if not flat.size or np.abs(flat).max() * scale < safe(width):
        return places, np.floor(flat * scale).astype(np.int64)
    exact = [[_floor_times(x, scale) for x in row] for row in flat.tolist()]
    return places, np.array(exact, dtype=object).reshape(-1, width)


def safe(width: int) -> int:
    """Components up to this size keep every sum of squared coefficient differences under 2^63."""
    return 1 << ((62 - 3 * (width - 1).bit_length()) // 2 - 1)


def _floor_times(x: float, scale: int) -> int:
    over, under = x.as_integer_ratio()
    return over * scale // under


def search(values: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, exact squared distance) of each row; of equal distances the smaller number."""
    n, width = values.shape
    if values.dtype == object or centroids.dtype == object:
        values, centroids = values.astype(object), centroids.astype(object)
    rows, coded = transform(values), transform(centroids)
    part = np.stack([((rows[:, : STEPS[0]] - c[: STEPS[0]]) ** 2).sum(axis=1) for c in coded], axis=1)
    lead = np.argmin(part, axis=1)
    rest = rows[:, STEPS[0] :] - coded[lead, STEPS[0] :]
    bound = part[np.arange(n), lead] + (rest * rest).sum(axis=1)
    part[np.arange(n), lead] = bound
    row, centre = np.nonzero((part <= bound[:, None]) & (np.arange(len(coded)) != lead[:, None]))
    total = part[row, centre]
    for low, high in zip(STEPS, (*STEPS[1:], width)):
        step = rows[row, low:high] - coded[centre, low:high]
        total = total + (step * step).sum(axis=1)
        stays = total <= bound[row]
        row, centre, total = row[stays], centre[stays], total[stays]
    # what is left is finished: the least distance of a row, of equal ones the smallest centroid
    best, label = bound.copy(), lead.copy()
    order = np.lexsort((centre, total, row)) if total.dtype != object else np.array(sorted(range(row.size), key=lambda i: (row[i], total[i], centre[i])), dtype=np.int64)
    row, centre, total = row[order], centre[order], total[order]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    for_row, by, to = row[first], total[first], centre[first]
    nearer = ((by < best[for_row]) | ((by == best[for_row]) & (to < label[for_row]))).astype(bool)
    best[for_row[nearer]], label[for_row[nearer]] = by[nearer], to[nearer]
    return label, best // width


def _array(centroids: list[list[int]]) -> np.ndarray:
    wide = any(abs(x) >= safe(len(c)) for c in centroids for x in c)
    return np.array(centroids, dtype=object if wide else np.int64)


def _add(sums: dict[int, list], cluster: int, count: int, values: list[int]) -> None:
    held = sums.setdefault(cluster, [0, [0] * len(values)])
    held[0] += count
    held[1] = [a + b for a, b in zip(held[1], values)]


_SUMS = "cluster int, count long, sums array<string>"


def _sum_rows(sums: dict[int, list]) -> pa.RecordBatch:
    rows = [{"cluster": c, "count": n, "sums": list(map(str, v))} for c, (n, v) in sorted(sums.items())]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("cluster", pa.int32()), ("count", pa.int64()), ("sums", pa.list_(pa.string()))]))


def sums(df: DataFrame, centroids: list[list[int]], vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(cluster, count, sums): one row per task and centroid of the vectors nearest to it; sums as decimal strings."""
    coded, width = _array(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                _, values = whole(batch.column(0).slice(start, ROWS), width, scale)
                if len(values):
                    label, _ = search(values, coded)
                    for c in np.unique(label).tolist():
                        mine = values[label == c]
                        _add(held, c, len(mine), mine.sum(axis=0).tolist())
        if held:
            yield _sum_rows(held)

    return df.select(vector).mapInArrow(run, _SUMS)


def _merged(parts: DataFrame, tasks: int) -> dict[int, list]:
    """Sums by centroid; the rows of all tasks are merged in a few tasks before the driver adds up what these give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                _add(held, r["cluster"], r["count"], list(map(int, r["sums"])))
        if held:
            yield _sum_rows(held)

    few = parts.repartition(int(tasks**0.5)).mapInArrow(run, _SUMS) if tasks >= 64 else parts
    total: dict[int, list] = {}
    for r in few.collect():  # one row per centroid and merging task
        _add(total, r["cluster"], r["count"], list(map(int, r["sums"])))
    return total


def usable(df: DataFrame, vector: str = "embedding", width: int = WIDTH) -> DataFrame:
    good = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return df.where((F.size(vector) == width) & good)


def start(df: DataFrame, k: int = CENTROIDS, key: str = "vec_id", vector: str = "embedding", width: int = WIDTH, scale: int = SCALE, salt: str = SALT) -> list[list[int]]:
    """The k usable vectors of the smallest hash as integers, by hash; equal ids by their components."""
    hashed = usable(df, vector, width).where(F.col(key).isNotNull())
    digest = F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256)
    first = hashed.select(digest.alias("h"), F.col(vector).alias("v")).orderBy("h", "v").limit(k).collect()
    return [[_floor_times(float(x), scale) for x in r["v"]] for r in first]


def fit(df: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS, vector: str = "embedding", scale: int = SCALE) -> list[list[int]]:
    """Centroids after `rounds` of assignment and exact floor means; a centroid without vectors stays."""
    tasks = df.select(vector).rdd.getNumPartitions()
    for _ in range(rounds if centroids else 0):
        found = _merged(sums(df, centroids, vector, scale), tasks)
        centroids = [[s // found[c][0] for s in found[c][1]] if c in found else old for c, old in enumerate(centroids)]
    return centroids


def assign(df: DataFrame, centroids: list[list[int]], key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance) of every usable vector."""
    schema = "vec_id long, cluster int, distance long"
    if not centroids:
        return df.sparkSession.createDataFrame([], schema)
    coded, width = _array(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                places, values = whole(part.column(1), width, scale)
                if len(values):
                    label, distance = search(values, coded)
                    if distance.dtype == object:
                        distance = np.array([min(d, _LARGEST) for d in distance.tolist()], dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(places)), pa.array(label, type=pa.int32()), pa.array(distance, type=pa.int64())], names=["vec_id", "cluster", "distance"])

    return df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector)).mapInArrow(run, schema)


def cluster(df: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, key: str = "vec_id", vector: str = "embedding", width: int = WIDTH, scale: int = SCALE, salt: str = SALT) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector."""
    centroids = fit(df, start(df, k, key, vector, width, scale, salt), rounds, vector, scale)
    assigned = cut(assign(df, centroids, key, vector, scale))
    held = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    capped = lambda c: F.least(c, F.lit(_LARGEST).cast("decimal(38,0)")).cast("long")
    names = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    digests = df.sparkSession.createDataFrame(names, "cluster int, centroid_sha256 string")
    both = held.select("cluster", capped(F.col("s")).alias("cluster_inertia"), capped(F.sum("s").over(Window.partitionBy())).alias("inertia")).join(digests, "cluster")
    return assigned.join(F.broadcast(both), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
