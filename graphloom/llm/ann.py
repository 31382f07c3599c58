"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard.

Rows are dealt into shards.  A shard's graph is flat arrays: the distinct vectors, for each layer its
nodes and their neighbours, and the ids of equal vectors.  It is built in waves: a wave of nodes
searches the layer in lockstep, each node picks diverse neighbours among what it found and its wave
mates, and reverse links are pruned the same way.  Graphs are stored; the query set is sent to them
in blocks of bounded size, one block after the other, each shard gives its best with exact distances,
and the shards' results are merged.

Every query visits every shard: sending queries to the nearest cells of a k-means partition only was
tried and finds too little where vectors do not cluster.  So shards grow with the table, to the size
that a task's memory allows, before they grow in number.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import scratch, stored, table

SHARD, SHARDS = 8192, 128  # vectors of a shard, until there are so many shards; then shards grow
SHARD_VALUES = 16_000_000  # numbers of a shard's vectors at most; then shards grow in number again
LINKS = 16  # neighbours in upper layers; the lowest has twice as many
EF_BUILD, EF = 64, 128  # beams; the one of a search widens with the root of a shard's size beyond ``SHARD``
WAVE = 256
STEP = 4  # nodes that a beam expands at a time
BLOCK_VALUES = 16_000_000  # numbers in a block of queries that is broadcast
EVERY = 100
K = 10


def _dist(x: np.ndarray, norms: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances (rows of ids to their row of q); ids of -1 are infinitely far."""
    d = norms[ids] - 2 * np.matmul(x[ids], q[:, :, None])[:, :, 0] + np.einsum("ij,ij->i", q, q)[:, None]
    d[ids < 0] = np.inf
    return d


def beam_search(x, norms, links, starts, q, ef):
    """(ids, distances), nearest first, of the best ``ef`` nodes each query meets; ``links`` (n, m), -1 for none."""
    b, rows = len(q), np.arange(len(q))[:, None]
    seen = np.zeros((b, len(x) + 1), bool)  # the last place is for -1
    seen[:, -1] = True
    ids = np.full((b, ef), -1, np.int32)
    ids[:, : starts.shape[1]] = starts
    d = _dist(x, norms, ids, q)
    seen[rows, ids] = True
    done = ids < 0
    while True:
        open_ = np.where(done, np.inf, d)
        pick = np.argpartition(open_, STEP, axis=1)[:, :STEP]
        live = np.isfinite(open_[rows, pick])
        act = live.any(1)
        if not act.any():
            break
        if not act.all():
            sub = np.flatnonzero(act)
        else:
            sub = np.arange(b)
        srows, p = sub[:, None], pick[sub]
        nodes = np.where(live[sub], ids[srows, p], -1)
        done[srows, p] = True
        new = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(sub), -1)
        new = np.sort(new, axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[seen[srows, new]] = -1
        seen[srows, new] = True
        dn = _dist(x, norms, new, q[sub])
        alld, allid = np.concatenate([d[sub], dn], 1), np.concatenate([ids[sub], new], 1)
        alldone = np.concatenate([done[sub], new < 0], 1)
        best = np.argpartition(alld, ef - 1, axis=1)[:, :ef]
        r = np.arange(len(sub))[:, None]
        d[sub], ids[sub], done[sub] = alld[r, best], allid[r, best], alldone[r, best] | ~np.isfinite(alld[r, best])
    order = np.argsort(d, axis=1, kind="stable")
    return ids[rows, order], d[rows, order]


def select(x, norms, q, cand, m):
    """Up to ``m`` diverse neighbours of each query among its candidates: nearer to it than to those chosen before; gaps go to the nearest left."""
    b = len(q)
    d = _dist(x, norms, cand, q)
    order = np.argsort(d, axis=1, kind="stable")
    cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
    v = x[cand]
    sq = norms[cand]
    between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    chosen = np.zeros(cand.shape, bool)
    nearest = np.full(cand.shape, np.inf, np.float32)  # of each candidate to the chosen
    for c in range(cand.shape[1]):
        take = (d[:, c] < nearest[:, c]) & np.isfinite(d[:, c]) & (chosen.sum(1) < m)
        chosen[:, c] = take
        nearest = np.where(take[:, None], np.minimum(nearest, between[:, :, c]), nearest)
    rank = np.argsort(np.where(chosen, 0, 1) * 1e9 + np.arange(cand.shape[1]) + np.where(np.isfinite(d), 0, 1e12), axis=1, kind="stable")[:, :m]
    out = np.take_along_axis(cand, rank, 1)
    out[~np.isfinite(np.take_along_axis(d, rank, 1))] = -1
    return out if out.shape[1] == m else np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)


def build_layer(x, norms, nodes, m, starts_of):
    """Neighbours (n, 2m or m) of ``nodes`` among themselves, by waves of insertions."""
    links = np.full((len(x), m), -1, np.int32)
    at, size = 0, 1
    while at < len(nodes):
        wave = nodes[at : at + size]
        mates = np.broadcast_to(wave, (len(wave), len(wave))).copy()
        np.fill_diagonal(mates, -1)
        if at:
            first = starts_of(x[wave])
            first = np.where(first >= 0, first, nodes[0])
            found, _ = beam_search(x, norms, links, first, x[wave], EF_BUILD)
            near = np.argsort(_dist(x, norms, mates, x[wave]), axis=1)[:, :LINKS]
            cand = np.concatenate([found, np.take_along_axis(mates, near, 1)], 1)
        else:
            cand = mates
        links[wave] = np.pad(got := select(x, norms, x[wave], cand, min(m, LINKS)), ((0, 0), (0, m - got.shape[1])), constant_values=-1)
        _link_back(x, norms, links, wave, m)
        at += len(wave)
        size = min(WAVE, max(1, at))
    return links


def _link_back(x, norms, links, wave, m):
    src = np.repeat(wave, links.shape[1])
    dst = links[wave].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    if not len(dst):
        return
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    targets, first, n = np.unique(dst, return_index=True, return_counts=True)
    extra = np.full((len(targets), n.max()), -1, np.int32)
    extra[np.repeat(np.arange(len(targets)), n), np.arange(len(dst)) - np.repeat(first, n)] = src
    have = links[targets]
    extra[(extra[:, :, None] == have[:, None, :]).any(2)] = -1
    both = np.concatenate([have, extra], 1)
    full = (both >= 0).sum(1) > m
    # the free places come last
    packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
    links[targets[~full]] = packed[~full][:, :m]
    for at in range(0, int(full.sum()), 512):
        t = np.flatnonzero(full)[at : at + 512]
        links[targets[t]] = select(x, norms, x[targets[t]], both[t], m)


class Graph:
    """One shard: distinct vectors, layers from the top down as (nodes, links), and the ids of each vector."""

    def __init__(self, x, layers, owners, ids):
        self.x, self.layers, self.owners, self.ids = x, layers, owners, ids
        self.norms = np.einsum("ij,ij->i", x, x)

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray) -> Graph:
        x, back = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, back.ravel()))
        rng = np.random.default_rng(len(x))
        level = np.minimum((-np.log(1 - rng.random(len(x))) / np.log(LINKS)).astype(int), 4)
        graph = cls(x, [], np.searchsorted(back.ravel()[order], np.arange(len(x) + 1)).astype(np.int64), ids[order])
        shuffled = rng.permutation(len(x)).astype(np.int32)
        for layer in range(int(level.max()), -1, -1):
            nodes = shuffled[level[shuffled] >= layer]
            graph.layers.append((nodes, build_layer(x, graph.norms, nodes, LINKS if layer else 2 * LINKS, lambda q: graph._down(q, len(graph.layers)))))  # noqa: B023
        return graph

    def _down(self, q: np.ndarray, layers: int) -> np.ndarray:
        """Entry points (b, 1..) for the layer below the first ``layers``; -1 if there are none above."""
        at = np.full((len(q), 1), -1, np.int32)
        for nodes, links in self.layers[:layers]:
            at = np.where(at >= 0, at, nodes[0])
            at = beam_search(self.x, self.norms, links, at, q, 8)[0][:, :4]
        return at

    def search(self, q: np.ndarray, ef: int) -> np.ndarray:
        at = self._down(q, len(self.layers) - 1)
        nodes, links = self.layers[-1]
        at = np.where(at >= 0, at, nodes[0])
        return beam_search(self.x, self.norms, links, at, q, max(ef, at.shape[1]))[0]

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, x=self.x, owners=self.owners, ids=self.ids, **{f"n{i}": n for i, (n, _) in enumerate(self.layers)}, **{f"l{i}": links for i, (_, links) in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Graph:
        z = np.load(io.BytesIO(raw))
        return cls(z["x"], [(z[f"n{i}"], z[f"l{i}"]) for i in range(sum(k[0] == "n" for k in z))], z["owners"], z["ids"])

    def nearest(self, query_ids: np.ndarray, q: np.ndarray, k: int):
        """(query_id, vec_id, exact distance) of each query's ``k`` best here, without the query's own id."""
        ef = int(EF * max(1.0, len(self.x) / SHARD) ** 0.5)
        for at in range(0, len(q), WAVE):
            part = q[at : at + WAVE]
            for query, own, found in zip(query_ids[at : at + WAVE].tolist(), part, self.search(part, ef), strict=True):
                found = found[found >= 0]
                d = np.sqrt(((self.x[found].astype(np.float64) - own.astype(np.float64)) ** 2).sum(1))
                out = []
                for i in np.argsort(d, kind="stable").tolist():
                    if len(out) > k and d[i] > out[k - 1][1]:
                        break
                    # ids of equal vectors are in order
                    held = self.ids[self.owners[found[i]] : self.owners[found[i] + 1]]
                    out += [(int(v), float(d[i])) for v in held[: k + 1] if v != query]
                    out.sort(key=lambda p: (p[1], p[0]))
                yield from ((query, v, dist) for v, dist in out[:k])


def _build_part(size: int):
    def run(batches):
        waiting: dict[int, list] = {}

        def shard(dim):
            rows = waiting.pop(dim)
            graph = Graph.build(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float32))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([graph.dump()], pa.binary())], names=["dim", "graph"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = v.values.to_numpy(zero_copy_only=False)
                rows = waiting.setdefault(len(v), [])
                rows.append((i, v))
                if len(rows) >= size:
                    yield shard(len(v))
        for dim in list(waiting):
            yield shard(dim)

    return run


def _search_part(queries, k):
    def run(batches):
        for batch in batches:
            for dim, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, q = queries.value.get(dim, (None, None))
                if ids is None:
                    continue
                rows = list(Graph.load(raw.as_py()).nearest(ids, q, k))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    return run


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose vector is not null, empty or zero and has only finite numbers."""
    ok = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("embedding", lambda v: v != 0)
    return rows.filter(F.col("embedding").isNotNull() & F.coalesce(ok, F.lit(False)) & F.col("vec_id").isNotNull())


def _vectors(rows: DataFrame) -> DataFrame:
    return usable(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")))


def shard_size(n: int, dim: int) -> int:
    return max(min(SHARD, SHARD_VALUES // dim), min(-(-n // SHARDS), SHARD_VALUES // dim), 1)


def index(rows: DataFrame) -> DataFrame:
    """The stored graphs (dim, graph) of all usable rows."""
    rows = _vectors(rows)
    n, dim = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    size = shard_size(n, dim)
    dealt = rows.repartition(max(1, -(-n // size)), F.xxhash64("vec_id", "embedding")).sortWithinPartitions("vec_id")
    return stored(dealt.mapInArrow(_build_part(2 * size), "dim int, graph binary"), "ann-graphs")


def search(graphs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found, ties to the smaller vec_id."""
    spark = queries.sparkSession
    asked = stored(_vectors(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "ann-queries")
    n, dim = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    blocks, found = max(1, -(-n * dim // BLOCK_VALUES)), None
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    for b in range(blocks):
        by_dim: dict[int, list] = {}
        for r in asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect():
            by_dim.setdefault(len(r["embedding"]), []).append((r["vec_id"], r["embedding"]))
        block = spark.sparkContext.broadcast({d: (np.array([i for i, _ in x], np.int64), np.array([v for _, v in x], np.float32)) for d, x in by_dim.items()})
        hits = graphs.mapInArrow(_search_part(block, k), "query_id long, vec_id long, score double")
        ranked = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        part = stored(ranked, "ann-block")
        block.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def nearest(rows: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """Nearest neighbours of the rows (vec_id, embedding, any others) whose vec_id ``every`` divides; stored.

    Rows with a null vec_id or a null, empty or zero vector, or one that holds nulls or numbers that
    are not finite, take no part.  Vectors are compared with those of their own length, long ones
    whole.  Rows that share the query's vec_id are its own; of a query id on several rows the least
    vector asks.  An empty table gives an empty result.
    """
    with scratch() as keep:
        found = search(index(rows), rows.filter(F.col("vec_id") % every == 0), k)
        return keep(found if hasattr(found, "stored_path") else stored(found, "ann"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
