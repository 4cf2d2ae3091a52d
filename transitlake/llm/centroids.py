"""Centroid clustering of integer vectors by scalar lookup tables.

A component x becomes the integer floor(scale * x). Distances are squared and
exact. Each round tabulates, for every dimension, the squared difference of
each occurring integer value to each centroid; the distance of a vector is a
gather from these tables and a sum over the dimensions (``Tables``). A batch
makes its own tables from the values that occur in it, so they are bounded by
the batch, not by the corpus, and no list of values is collected.

A round is one map: a task adds up its vectors by cluster and emits counts and
sums of at most k clusters. They are added by Spark; k * dimensions sums reach
the driver, whatever the input's size. Sums are split into limbs of 40 bits,
so they are exact for any finite component. The vectors are written once and
read again each round.

Starting centroids are the k vectors whose ids have the smallest hashes. An
emptied cluster keeps its centroid.

Defined cases: a null vector, one of another length, or one with a null or
non-finite component is left out; fewer than k vectors give fewer clusters;
ties between centroids go to the smaller number, ties between equal ids to the
smaller vector; a null id hashes after all others; rows that repeat an id are
vectors of their own; an empty table gives an empty result; components beyond
``LIMIT`` are computed with Python integers, and a distance or inertia beyond
a long is given as the largest long; other columns pass only in ``keep``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from transitlake.llm.common import cut

#: Integers of this size and above leave the tables of longs for Python integers.
LIMIT = 1 << 24
LARGEST = (1 << 63) - 1
_LIMB = 40


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): longs, or Python integers if one reaches ``LIMIT``."""
    if not len(x) or np.abs(x).max() < LIMIT / scale:
        return np.floor(x * scale).astype(np.int64)
    exact = [math.floor(v * scale) if abs(v) < 2 ** 52 else int(v) * scale for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


class Tables:
    """Squared difference of each value of each dimension to each centroid."""

    def __init__(self, q: np.ndarray, centroids: np.ndarray):
        self.index, self.table = [], []
        for d in range(q.shape[1]):
            values, index = np.unique(q[:, d], return_inverse=True)
            self.index.append(index)
            self.table.append((values[:, None] - centroids[:, d]) ** 2)

    def distances(self) -> np.ndarray:
        total = self.table[0][self.index[0]]
        for table, index in zip(self.table[1:], self.index[1:], strict=True):
            total = total + table[index]
        return total


def nearest(q: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each vector."""
    c = np.array(centroids, object)
    if q.dtype != object and max(abs(v) for row in centroids for v in row) < LIMIT:
        c = c.astype(np.int64)
    distance = Tables(q, c).distances()
    cluster = np.argmin(distance, axis=1)
    return cluster, distance[np.arange(len(q)), cluster]


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """(position, limb) pairs whose sum of limb * 2^(40 * position) is ``value``."""
    sign, value, at = (-1 if value < 0 else 1), abs(value), 0
    while value or not at:
        yield at, sign * (value & ((1 << _LIMB) - 1))
        value >>= _LIMB
        at += 1


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index("_x"))
    return np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _usable(rows: DataFrame, vector_col: str, dim: int, head: list) -> DataFrame:
    finite = F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return cut(rows.select(*head, F.col(vector_col).cast("array<double>").alias("_x"))
               .filter((F.size("_x") == dim) & finite))


def _start(rows: DataFrame, id_col: str, k: int, seed: int, scale: int) -> list[list[int]]:
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    first = rows.orderBy(key.asc_nulls_last(), "_x").limit(k).select("_x").collect()
    return [[int(v) for v in whole(np.array([r[0]], np.float64), scale)[0]] for r in first]


def _sums(rows: DataFrame, centroids: list[list[int]], dim: int, scale: int) -> list[list[int]]:
    """The centroids after one round."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    schema = "cluster int, d int, limb int, value long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        total = np.zeros((len(centres), dim + 1), object)
        for b in batches:
            if not b.num_rows:
                continue
            q = whole(_vectors(b, dim), scale)
            cluster, _ = nearest(q, centres)
            for c in np.unique(cluster):
                own = q[cluster == c]
                total[c, :dim] += own.sum(axis=0).astype(object)
                total[c, dim] += len(own)
        out = [(c, d, limb, value) for c in range(len(centres)) if total[c, dim]
               for d in range(dim + 1) for limb, value in _limbs(int(total[c, d]))]
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, types, strict=True)],
                                         ["cluster", "d", "limb", "value"])

    got = rows.select("_x").mapInArrow(run, schema).groupBy("cluster", "d", "limb").agg(F.sum("value")).collect()
    total = [[0] * (dim + 1) for _ in centroids]
    for c, d, limb, value in got:
        total[c][d] += value << (_LIMB * limb) if value >= 0 else -(-value << (_LIMB * limb))
    shared.unpersist()
    return [[s // row[dim] for s in row[:dim]] if row[dim] else old
            for row, old in zip(total, centroids, strict=True)]


def cluster(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, k: int = 16,
            rounds: int = 3, scale: int = 64, seed: int = 1, keep: list[str] | None = None,
            ) -> tuple[DataFrame, list[list[int]]]:
    """Id, kept columns, ``cluster`` and ``distance`` of each usable vector; the final centroids."""
    keep = keep or []
    spark = rows.sparkSession
    head = [F.col(c) for c in [id_col, *keep]]
    usable = _usable(rows, vector_col, dim, head)
    centroids = _start(usable, id_col, k, seed, scale)
    for _ in range(rounds if centroids else 0):
        centroids = _sums(usable, centroids, dim, scale)
    shared = spark.sparkContext.broadcast(centroids)
    schema = StructType([rows.schema[c] for c in [id_col, *keep]]
                        + [StructField("cluster", IntegerType()), StructField("distance", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            number, distance = nearest(whole(_vectors(b, dim), scale), shared.value)
            if distance.dtype == object:
                distance = np.array([min(int(v), LARGEST) for v in distance], np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(number.astype(np.int32)), pa.array(distance)],
                                             schema.names)

    return usable.mapInArrow(run, schema), centroids


def digest(centroid: list[int]) -> str:
    """Lower-case hex SHA-256 of the components in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def with_inertia(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``found`` with ``cluster_inertia``, ``inertia`` and ``centroid_sha256``; k rows pass through the driver."""
    spark = found.sparkSession
    found = cut(found)
    sums = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    whole_sum = min(sum(sums.values()), LARGEST)
    side = spark.createDataFrame([(c, min(s, LARGEST), whole_sum, digest(centroids[c])) for c, s in sums.items()],
                                 "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(side), "cluster").select(*found.columns, *side.columns[1:])
