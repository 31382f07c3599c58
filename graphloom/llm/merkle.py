"""Merkle manifest of a dataset: one tree per source, and one over the sources' roots.

Leaves are hashed where they are scanned; digests alone move.  A tree grows by events: a node's digest
reaches its parent with its index, a parent that holds as many children as the size of its level asks
is hashed and is itself an event for its own parent.  Tasks grow what their rows complete; parents
whose children lie in several tasks are the frontier, which ``combineByKey`` brings together, level
by level.  Each node keeps the digests of its children, and from these links, from the root down,
every leaf gets the siblings that prove it.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import crc_mod, scratch, stored, table

ARITY = 16
HELD_SPANS = 1_000_000  # counts per tree and task that a broadcast may hold; beyond, a shuffle join
TAMPERED = 5  # documents whose crc32 this divides are tampered with
NODE = "tree string, n long, level int, at long, digest string, children array<string>"
PARTIAL = "tree string, n long, level int, at long, spots array<int>, digests array<string>"
WAYS = "array<struct<left:string,right:string>>"  # the siblings on both sides, level by level, joined
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(*values: Column) -> Column:
    """Digest of values in order: ``-`` for a null, else the UTF-8 length, a colon and the value."""
    part = lambda v: F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(part, values)), 256)


def wanted(n: int, level: int, at: int) -> int:
    """Children of node ``at`` of a level above the leaves, in a tree of ``n`` leaves."""
    for _ in range(level - 1):
        n = -(-n // ARITY)
    return min(ARITY, n - at * ARITY)


def is_top(n: int, level: int) -> bool:
    """Whether a level is one node, the tree's root."""
    return n <= ARITY**level


class Frontier:
    """Parents that wait for children.  An event that completes one gives a node, and that an event above it."""

    def __init__(self):
        self.waiting: dict[tuple, dict[int, str]] = {}

    def event(self, tree, n: int, level: int, at: int, digest: str):
        """The nodes that the digest of node ``at`` of ``level`` completes, lowest first."""
        while not is_top(n, level):
            key = (tree, n, level + 1, at // ARITY)
            held = self.waiting.setdefault(key, {})
            held[at % ARITY] = digest
            if len(held) < wanted(n, level + 1, at // ARITY):
                return
            del self.waiting[key]
            level, at = level + 1, at // ARITY
            children = [held[i] for i in sorted(held)]
            digest = hashlib.sha256("".join(children).encode()).hexdigest()
            yield (tree, n, level, at, digest, children)


_GROWN = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("digest", pa.string()), ("children", pa.list_(pa.string())), ("spots", pa.list_(pa.int32()))])


def _grow_part(batches):
    """Leaves (tree, n, at, digest) to the nodes they complete here, and to partial parents, whose digest is null."""
    frontier = Frontier()
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        nodes = [node for tree, n, at, digest in zip(*columns, strict=True) for node in frontier.event(tree, n, 0, at, digest)]
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*zip(*nodes, strict=True), [None] * len(nodes)], _GROWN, strict=True)], schema=_GROWN)
    rest = [(*key, None, list(held.values()), list(held)) for key, held in frontier.waiting.items()]
    for i in range(0, len(rest), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rest[i : i + 10_000], strict=True), _GROWN, strict=True)], schema=_GROWN)


def _keyed(row):
    return (row["tree"], row["n"], row["level"], row["at"]), (row["spots"], row["children"])


def _joined(a: dict, b) -> dict:
    a.update(b if isinstance(b, dict) else zip(*b, strict=True))
    return a


def _settled(item):
    """A frontier parent as a node, if it is whole, and as the partial parent above it."""
    (tree, n, level, at), held = item
    if len(held) < wanted(n, level, at):
        yield (tree, n, level, at, None, list(held.values()), list(held))
        return
    children = [held[i] for i in sorted(held)]
    digest = hashlib.sha256("".join(children).encode()).hexdigest()
    yield (tree, n, level, at, digest, children, None)
    if not is_top(n, level):
        yield (tree, n, level + 1, at // ARITY, None, [digest], [at % ARITY])


def _place(key) -> int:
    return zlib.crc32(repr(key).encode())


def grow(leaves: DataFrame) -> DataFrame:
    """All nodes above leaves (tree, n, at, digest): (tree, n, level, at, digest, children); stored.

    ``n`` is the number of the tree's leaves, of which ``at`` numbers each from 0.
    """
    spark = leaves.sparkSession
    grown = stored(leaves.select("tree", "n", "at", "digest").mapInArrow(_grow_part, NODE + ", spots array<int>"), "merkle-grown")
    parts = [grown]
    while not (open_ := parts[-1].filter("digest is null")).isEmpty():
        # the lowest open level is whole after each round, as all children below it are nodes
        held = open_.rdd.map(_keyed).combineByKey(lambda v: dict(zip(*v, strict=True)), _joined, _joined, numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions")), partitionFunc=_place)
        parts.append(stored(spark.createDataFrame(held.flatMap(_settled), grown.schema, verifySchema=False), "merkle-frontier"))
    return reduce(DataFrame.unionByName, parts).filter("digest is not null").drop("spots")


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows`` with ``at``, each one's place in its tree by ``order``, and ``n``, the tree's size.

    One range shuffle sorts all rows, so a large tree spreads over tasks; places come from those in
    the task and from counts, one per tree and task.  The rows are stored sorted.
    """
    spot = F.monotonically_increasing_id()  # the task's number above its rows' numbers
    line = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("spot", spot)
    line = stored(line.withColumns({"part": F.shiftright("spot", 33), "spot": F.col("spot").bitwiseAND((1 << 33) - 1)}), "merkle-line")
    spans = line.groupBy(tree, "part").agg(F.min("spot").alias("first"), F.count(F.lit(1)).alias("rows"))
    own = Window.partitionBy(tree)
    before = F.coalesce(F.sum("rows").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = stored(spans.select(F.col(tree).alias("its"), F.col("part").alias("its_part"), (before - F.col("first")).alias("shift"), F.sum("rows").over(own).alias("n")), "merkle-spans")
    if spans.count() <= HELD_SPANS:
        spans = F.broadcast(spans)
    placed = line.join(spans, (F.col("part") == F.col("its_part")) & F.col(tree).eqNullSafe(F.col("its")))
    return placed.withColumn("at", F.col("spot") + F.col("shift")).drop("its", "its_part", "shift", "spot", "part")


def _way(children: Column, at: Column) -> Column:
    """The step of a proof at a child: its siblings' digests before and after it."""
    k = (at % ARITY).cast("int")
    return F.struct(F.array_join(F.slice(children, F.lit(1), k), "").alias("left"), F.array_join(F.slice(children, k + 2, F.lit(ARITY)), "").alias("right"))


def _parents(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("tree").alias("p_tree"), F.col("at").alias("p_at"), F.col("children").alias("p_children"), F.col("ways").alias("p_ways"), "top")


def _under(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """``rows`` (tree, at, any others) with the way from each to the root and its tree's ``top``, by their parents' links."""
    up = (F.expr(f"at div {ARITY}") == F.col("p_at")) & F.col("tree").eqNullSafe(F.col("p_tree"))
    ways = F.concat(F.array(_way(F.col("p_children"), F.col("at"))), F.col("p_ways"))
    return rows.join(_parents(parents), up).withColumn("ways", ways).drop("p_tree", "p_at", "p_children", "p_ways")


def ways(leaves: DataFrame, nodes: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """``leaves`` (tree, n, at, digest, any others) with ``ways``, the steps of their proofs, and ``top``, their tree's root.

    ``above`` (tree, ways) continues the ways beyond the trees' roots.
    """
    none = F.array().cast(WAYS)

    def tops(rows):
        rows = rows.withColumn("top", F.col("digest"))
        if above is None:
            return rows.withColumn("ways", none)
        return rows.join(above.select(F.col("tree").alias("its"), F.col("ways")), F.col("tree").eqNullSafe(F.col("its"))).drop("its")

    rows, last = tops(leaves.filter("n = 1")), nodes.agg(F.max("level")).first()[0]
    if last is None:
        return rows
    top = F.col("n") <= F.pow(F.lit(ARITY), F.col("level"))
    chain = None
    for level in range(last, 0, -1):
        own = nodes.filter(F.col("level") == level)
        begun = tops(own.filter(top))
        chain = stored(begun if chain is None else begun.unionByName(_under(own.filter(~top), chain)), "merkle-chain")
    return rows.unionByName(_under(leaves.filter("n > 1"), chain))


def folded(digest: Column, steps: Column) -> Column:
    """The root that a digest and its proof give."""
    return F.aggregate(steps, digest, lambda d, w: F.sha2(F.concat(w["left"], d, w["right"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, lang, n_chars, text, any others): leaf, subroot, root, proof and its check; stored.

    ``folded_root`` is recomputed from the leaf of the tampered row, where TAMPERED divides the crc32
    of doc_id, and else from the leaf.  A null is ``-`` in the leaf and an empty text ``0:``; texts
    count whole.  Rows without source are one tree, the first; rows without doc_id come first in
    their tree and are never tampered with.  Rows of one doc_id follow each other by leaf; rows alike
    in all columns have equal leaves, any order of which gives the same tree.  A leaf without siblings
    up to the root has the proof of an empty text.  An empty table gives an empty result.
    """
    with scratch() as keep:
        lowered = F.translate("text", _UPPER, _LOWER)
        columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
        leaves = docs.select("doc_id", F.col("source").alias("tree"), leaf(*columns, F.col("text")).alias("digest"), F.when(crc_mod("doc_id", TAMPERED) == 0, leaf(*columns, lowered)).alias("bad"), F.monotonically_increasing_id().alias("row"))
        leaves = stored(numbered(stored(leaves, "merkle-leaves"), "tree", "doc_id", "digest", "row").drop("row"), "merkle-numbered")
        nodes = grow(leaves)
        subroots = leaves.filter("n = 1").select(F.col("tree").alias("source"), "digest").unionByName(nodes.filter(F.col("n") <= F.pow(F.lit(ARITY), F.col("level"))).select(F.col("tree").alias("source"), "digest"))
        sources = stored(numbered(subroots.withColumn("tree", F.lit("")), "tree", "source"), "merkle-sources")
        roots = ways(sources, grow(sources))
        above = stored(roots.select(F.col("source").alias("tree"), "ways", F.col("top").alias("root")), "merkle-above")
        root = F.lit((above.select("root").first() or [None])[0]).cast("string")
        rows = ways(leaves, nodes, above)
        proof = F.sha2(F.array_join(F.transform("ways", lambda w: F.concat(w["left"], w["right"])), ""), 256)
        rows = rows.select("doc_id", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), root.alias("root"), proof.alias("proof_sha256"), folded(F.coalesce("bad", "digest"), F.col("ways")).alias("folded_root"))
        return keep(stored(rows.withColumn("verified", F.col("folded_root") == F.col("root")), "merkle"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))
