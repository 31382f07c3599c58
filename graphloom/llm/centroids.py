"""Centroid clustering of integer vectors with Elkan's bounds.

Each vector keeps an upper bound of the distance to its centroid and lower bounds of those to all.
When centroids move, bounds move with them; a vector is compared with a centroid only if its bounds
and half the distance between the centroids leave it open.  Bounds are floats rounded outwards and a
comparison is skipped only where a bound is strictly smaller, so ties are seen; distances are exact
integers, and so are the sums that give the next centroids.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import drop_stored, scratch, stored, table

DIMENSIONS, SCALE, K, ROUNDS, SEED = 64, 1024, 8, 10, 3
# squared distances of vectors within this bound fit in a long
MOST = isqrt(((1 << 63) - 1) // DIMENSIONS) // 2
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def scaled(rows: DataFrame) -> DataFrame:
    """(vec_id, x): vectors of ``DIMENSIONS`` finite numbers, each times ``SCALE`` and floored."""
    e = F.col("embedding")
    fits = F.forall(e, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double")) <= MOST // SCALE), F.lit(False)))
    whole = rows.filter(e.isNotNull() & (F.size(e) == DIMENSIONS)).filter(fits)
    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda v: F.floor(v.cast("double") * SCALE).cast("long")).alias("x"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors of smallest seeded digests of their ids; ids on several rows go by their vectors."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(draw.alias("draw"), "x").orderBy(F.col("draw").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64).reshape(len(rows), DIMENSIONS)


def _up(v: np.ndarray) -> np.ndarray:
    return np.nextafter(v, np.inf)


def _down(v: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(v, -np.inf), 0)


def _root(squares: np.ndarray, away) -> np.ndarray:
    """Square roots of exact integers, which may be rounded twice on the way, moved outwards."""
    return away(away(np.sqrt(squares.astype(np.float64))))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Bounds:
    """What the centroids of a round say about distances: how far each moved, and half the way between each two."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.centroids = centroids
        k = len(centroids)
        self.moved = np.zeros(k) if before is None else _root(squared(centroids, before), _up)
        between = np.array([squared(centroids, c) for c in centroids]).reshape(k, k)
        self.half = _root(between, _down) / 2
        np.fill_diagonal(self.half, np.inf)

    def assign(self, x, cluster, upper, lower):
        """Nearest centroids, ties to the smaller number, with the bounds as they are then, and the number of distances computed.

        ``cluster`` -1 is a vector that has none yet; ``lower`` is changed in place.
        """
        done = 0
        fresh = cluster < 0
        if fresh.any():
            at = np.flatnonzero(fresh)
            squares = np.array([squared(x[at], c) for c in self.centroids]).T
            cluster[at] = squares.argmin(1)
            upper[at] = _root(squares.min(1), _up)
            lower[at] = _root(squares, _down)
            done += squares.size
        old = np.flatnonzero(~fresh)
        if not len(old):
            return done
        moved = self.moved
        lower[old] = np.maximum(_down(lower[old] - moved), 0)
        upper[old] = _up(upper[old] + np.where(moved > 0, moved, 0)[cluster[old]])
        open_ = old[upper[old] >= self.half.min(1)[cluster[old]]] if len(self.centroids) > 1 else old[:0]
        if not len(open_):
            return done
        # squares of own centroids, computed once a bound alone does not do
        near = np.full(len(x), -1, np.int64)
        for j in range(len(self.centroids)):
            own = cluster[open_]
            ask = open_[(own != j) & (upper[open_] >= lower[open_, j]) & (upper[open_] >= self.half[own, j])]
            loose = ask[near[ask] < 0]
            if len(loose):
                near[loose] = squared(x[loose], self.centroids[cluster[loose]])
                upper[loose] = _root(near[loose], _up)
                lower[loose, cluster[loose]] = _root(near[loose], _down)
                done += len(loose)
                ask = ask[(upper[ask] >= lower[ask, j]) & (upper[ask] >= self.half[cluster[ask], j])]
            if not len(ask):
                continue
            far = squared(x[ask], self.centroids[j])
            done += len(ask)
            lower[ask, j] = _root(far, _down)
            nearer = (far < near[ask]) | ((far == near[ask]) & (j < cluster[ask]))
            to = ask[nearer]
            cluster[to], near[to] = j, far[nearer]
            upper[to] = _root(far[nearer], _up)
        return done


_STATE = "vec_id long, x array<long>, cluster int, upper double, lower array<double>, members long, computed long"
_STATE_ARROW = pa.schema([("vec_id", pa.int64()), ("x", pa.list_(pa.int64())), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.list_(pa.float64())), ("members", pa.int64()), ("computed", pa.int64())])


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def _round_part(centroids: np.ndarray, before: np.ndarray | None):
    """Vectors with their state to the same after a round; at a task's end a row per cluster has the sum of its ``members``."""

    def run(batches):
        bounds, k = Bounds(centroids, before), len(centroids)
        sums, members, computed = np.zeros((k, DIMENSIONS), np.int64), np.zeros(k, np.int64), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column(1).flatten().to_numpy().reshape(n, DIMENSIONS)
            if before is None:
                cluster, upper, lower = np.full(n, -1, np.int32), np.zeros(n), np.zeros((n, k))
            else:
                cluster, upper = batch.column(2).to_numpy().copy(), batch.column(3).to_numpy().copy()
                lower = batch.column(4).flatten().to_numpy().reshape(n, k).copy()
            computed += bounds.assign(x, cluster, upper, lower)
            for j in range(k):
                own = cluster == j
                sums[j] += x[own].sum(0)
                members[j] += own.sum()
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(x), pa.array(cluster), pa.array(upper), _lists(lower), none, none], schema=_STATE_ARROW)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), _lists(sums), pa.array(np.arange(k, dtype=np.int32)), pa.nulls(k, pa.float64()), pa.nulls(k, pa.list_(pa.float64())), pa.array(members), pa.array([computed] + [0] * (k - 1), pa.int64())], schema=_STATE_ARROW)

    return run


def assigned(state: DataFrame, centroids: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """The stored state after a round against ``centroids``; ``before``: those of the round whose state it was."""
    return stored(state.mapInArrow(_round_part(centroids, before), _STATE), "centroid-state")


def next_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Exact floors of the mean of each cluster's vectors; a cluster without any stays."""
    # a row per task and cluster; decimals hold any number of vectors
    totals = state.filter("members > 0").groupBy("cluster").agg(F.sum("members").alias("n"), *(F.sum(F.col("x")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(DIMENSIONS)))
    out = centroids.copy()
    for r in totals.collect():
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(DIMENSIONS)]
    return out


def _final_part(centroids: np.ndarray):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x, cluster = batch.column(1).flatten().to_numpy().reshape(n, DIMENSIONS), batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(squared(x, centroids[cluster]))], names=["vec_id", "cluster", "distance"])

    return run


def cluster(rows: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Per usable row of ``rows`` (vec_id, embedding, any others): cluster, distance and inertias; stored.

    Vectors that are null, have other than ``DIMENSIONS`` components, or hold nulls, numbers that are
    not finite or beyond ``MOST / SCALE`` (squared distances of those need not fit in a long) take no
    part.  Rows of one vec_id, or without one, are vectors each; equal vectors may start centroids
    side by side, of which the smaller number gets all.  With fewer than ``k`` vectors there are as
    many centroids.  An inertia beyond a long is null.  An empty table gives an empty result.
    """
    with scratch() as keep:
        state = stored(scaled(rows), "centroid-vectors")
        centroids, before = first_centroids(state, k, seed), None
        if not len(centroids):
            return keep(stored(rows.sparkSession.createDataFrame([], RESULT), "clusters"))
        for i in range(rounds + 1):
            after = assigned(state, centroids, before)
            drop_stored(state)
            state = after.filter("members is null")
            state.stored_path = after.stored_path
            if i < rounds:
                before, centroids = centroids, next_centroids(after, centroids)
        named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
        done = stored(state.select("vec_id", "x", "cluster").mapInArrow(_final_part(centroids), "vec_id long, cluster int, distance long"), "centroid-distances")
        sums = {r["cluster"]: r["inertia"] for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
        long = lambda v: None if v >= 1 << 63 else int(v)
        total = long(sum(sums.values()))
        facts = rows.sparkSession.createDataFrame([(j, long(v), total, named[j]) for j, v in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        return keep(stored(done.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), "clusters"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))
