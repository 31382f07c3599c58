"""The property graph as two tables: nodes by (label, canonical_key), edges by both ends and type.

An upsert is one aggregation over what is stored and what comes.  Its state is first, last, best and
sum by ``seq``, which any grouping of batches gives alike: ``*_state`` makes it of rows, ``merged``
joins two of them, and ``nodes_of`` and ``edges_of`` read it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

NODE_KEY = ("label", "canonical_key")
EDGE_KEY = ("src_label", "src_key", "type", "dst_label", "dst_key")
EDGE_ENDS = ("src_key", "dst_key")
EDGE_LISTS = {"document": "documents", "page": "pages", "source_ref": "source_refs"}
EDGE_FOLDS = {"best": F.max, "flags": F.max, "source": F.min, "support_count": F.sum}
PAYLOAD = ("evidence", "confidence", "document", "page_start", "page_end", "page", "chunk_index", "source_ref")


Lists = tuple[str, ...]


@dataclass
class State:
    """One row per key, and for the list columns one per key and distinct value with the ``seq`` it came first at."""

    rows: DataFrame
    lists: DataFrame


def _first(c: str, blank: bool = False) -> Column:
    """The first value by ``seq`` that is given (and not empty), with its ``seq``."""
    given = F.col(c).isNotNull() & ((F.col(c) != "") if blank else F.lit(True))
    return F.min(F.when(given, F.struct("seq", F.col(c).alias("v"))))


def _values(rows: DataFrame, key: Lists, columns: Lists) -> DataFrame:
    """(key, which, v, at): each column's distinct values; a key with any number of mentions costs as many rows as it has values."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("which"), F.col(c).cast("string").alias("v")) for c in columns))).alias("p")
    rows = rows.select(*key, "seq", pairs).filter(F.col("p.v").isNotNull())
    return rows.groupBy(*key, F.col("p.which").alias("which"), F.col("p.v").alias("v")).agg(F.min("seq").alias("at"))


def _in_order(state: State, key: Lists, columns: dict[str, str]) -> DataFrame:
    """The state's rows with each list's values in the order in which they came."""
    listed = lambda which, name: F.transform(F.array_sort(F.collect_list(F.when(F.col("which") == which, F.struct("at", "v")))), lambda r: r["v"]).alias(name)
    lists = state.lists.groupBy(*key).agg(*(listed(w, n) for w, n in columns.items()))
    none = F.array().cast("array<string>")
    return state.rows.join(lists, list(key), "left").withColumns({n: F.coalesce(n, none) for n in columns.values()})


def merged_all(states: list[State], key: Lists) -> State:
    """States as one: least firsts, greatest bests, added support."""
    how = lambda c: F.sum(c) if c == "support_count" else F.max(c) if c in ("best", "flags") else F.min(c)
    rows = reduce(DataFrame.unionByName, (s.rows for s in states))
    lists = reduce(DataFrame.unionByName, (s.lists for s in states)).groupBy(*key, "which", "v").agg(F.min("at").alias("at"))
    return State(rows.groupBy(*key).agg(*(how(c).alias(c) for c in rows.columns if c not in key)), lists)


def merged(a: State, b: State, key: Lists) -> State:
    return merged_all([a, b], key)


def node_state(rows: DataFrame) -> State:
    """Of rows (label, canonical_key, seq, name, description, aliases, support_count, source, document, page); those without label or name go."""
    rows = rows.filter((F.coalesce("label", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != ""))
    support = F.sum(F.coalesce("support_count", F.lit(1)).cast("long")).alias("support_count")
    folded = rows.groupBy(*NODE_KEY).agg(_first("name").alias("name"), _first("description", blank=True).alias("description"), _first("source").alias("source"), _first("document").alias("document"), _first("page").alias("first_page"), support)
    named = rows.select(*NODE_KEY, F.col("seq").alias("of"), F.posexplode(F.coalesce("aliases", F.array().cast("array<string>"))).alias("place", "aliases"))
    return State(folded, _values(named.withColumn("seq", F.struct("of", "place")), NODE_KEY, ("aliases",)))


def nodes_of(state: State) -> DataFrame:
    whole = _in_order(state, NODE_KEY, {"aliases": "aliases"})
    return whole.select(*NODE_KEY, *(F.col(f"{c}.v").alias(c) for c in ("name", "description", "source", "document", "first_page")), "aliases", "support_count")


def upsert_nodes(rows: DataFrame) -> DataFrame:
    """Node mentions to nodes; aliases are distinct, in the order of their first mention by ``seq`` and place."""
    return nodes_of(node_state(rows))


def _edge_fold() -> tuple[Column, ...]:
    """The payload is that of the highest confidence, the latest of equals; flags are the latest."""
    best = F.max(F.struct("confidence", "seq", *(c for c in PAYLOAD if c != "confidence"))).alias("best")
    support = F.sum(F.coalesce("support_count", F.lit(1)).cast("long")).alias("support_count")
    return best, F.max(F.struct("seq", "quality_flags")).alias("flags"), _first("source").alias("source"), support


def edge_state(rows: DataFrame, lists: Lists = tuple(EDGE_LISTS)) -> State:
    """Of rows of edge keys, ``seq``, the payload, quality_flags, support_count and source."""
    return State(rows.groupBy(*EDGE_KEY).agg(*_edge_fold()), _values(rows, EDGE_KEY, lists))


def _edges(rows: DataFrame, *lists: str) -> DataFrame:
    return rows.select(*EDGE_KEY, *(f"best.{c}" for c in PAYLOAD), "flags.quality_flags", F.col("source.v").alias("source"), "support_count", *lists)


def edges_of(state: State) -> DataFrame:
    return _edges(_in_order(state, EDGE_KEY, EDGE_LISTS), *EDGE_LISTS.values())


def folded_edges(rows: DataFrame) -> DataFrame:
    """Edge mentions to edges without the lists of their documents, pages and source_refs."""
    return _edges(edge_state(rows).rows)


def upsert_edges(rows: DataFrame) -> DataFrame:
    """Edge mentions to edges, with the distinct documents, pages and source_refs of each in order.

    ``edges_of(edge_state(rows))`` for mentions that all are there: each is moved once, as it is, since few edges are mentioned
    twice.  An edge's mentions are first folded by where they are from, so that as many are held as it has places.
    """
    key = (*EDGE_ENDS, *(c for c in EDGE_KEY if c not in EDGE_ENDS))  # ends first: labels and types are few and sort poorly
    places = rows.repartition(*EDGE_ENDS).groupBy(*key, *EDGE_LISTS).agg(F.min("seq").alias("at"), *_edge_fold())
    whole = places.groupBy(*key).agg(*(how(c).alias(c) for c, how in EDGE_FOLDS.items()), F.collect_list(F.struct("at", *EDGE_LISTS)).alias("places"))

    def listed(c: str) -> Column:
        given = F.filter("places", lambda p: p[c].isNotNull())
        return F.array_distinct(F.transform(F.array_sort(F.transform(given, lambda p: F.struct(p["at"], p[c].cast("string").alias("v")))), lambda p: p["v"]))

    return _edges(whole.withColumns({name: listed(c) for c, name in EDGE_LISTS.items()}), *EDGE_LISTS.values())


def attached(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both are nodes; others go without a word."""
    ends = nodes.select("label", "canonical_key")
    for side in ("src", "dst"):
        edges = edges.join(ends.select(F.col("label").alias(f"{side}_label"), F.col("canonical_key").alias(f"{side}_key")), [f"{side}_label", f"{side}_key"], "left_semi")
    return edges


def written(rows: DataFrame, *ends: str) -> DataFrame:
    """(attempted, written): rows that come, and those whose ``ends`` (label, name, type) are all given, which alone are written."""
    given = reduce(lambda a, c: a & (F.coalesce(c, F.lit("")) != ""), ends, F.lit(True))
    return rows.agg(F.count(F.lit(1)).alias("attempted"), F.coalesce(F.sum(given.cast("long")), F.lit(0)).alias("written"))


def write_counted(mentions: DataFrame, path: str, kind: str) -> dict[str, int]:
    """Nodes or edges of their mentions, written to ``path``, and what one job saw of them.

    ``attempted`` mentions came, ``refused`` lacked what they need, ``merged`` met one that was there,
    ``written`` rows stand.  The counts are observed while the rows pass: nothing is read twice.
    """
    needs, upsert = {"nodes": (("label", "name"), upsert_nodes), "edges": (EDGE_KEY, upsert_edges)}[kind]
    given = reduce(lambda a, c: a & (F.coalesce(c, F.lit("")) != ""), needs, F.lit(True))
    came, stand = Observation(), Observation()
    seen = mentions.observe(came, F.count(F.lit(1)).alias("attempted"), F.count(F.when(given, 1)).alias("given"))
    upsert(seen.filter(given)).observe(stand, F.count(F.lit(1)).alias("written")).write.mode("overwrite").parquet(path)
    attempted, kept, written_ = came.get["attempted"], came.get["given"], stand.get["written"]
    return {"attempted": attempted, "refused": attempted - kept, "merged": kept - written_, "written": written_}


def write_unique(rows: DataFrame, path: str, *key: str) -> None:
    """Writes ``rows`` unless two have the same ``key``: then the job fails, names one, and nothing is there."""
    rest = [c for c in rows.columns if c not in key]
    name = F.concat_ws(", ", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in key))
    one = rows.groupBy(*key).agg(F.first(F.struct(*rest)).alias("__rest"), F.count(F.lit(1)).alias("__rows"))
    kept = F.when(F.col("__rows") == 1, F.col("__rest")).otherwise(F.raise_error(F.concat(F.lit("key is there more than once: "), name)).cast(one.schema["__rest"].dataType))
    one.select(*key, kept.alias("__rest")).select(*key, *(f"__rest.{c}" for c in rest)).write.mode("errorifexists").parquet(path)


def chunk_tables(chunks: DataFrame, *order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, documents, links): chunk rows by id (``source::index``), the last by ``order`` counts; documents by id; which chunk is of which."""
    rows = chunks.withColumn("id", F.concat_ws("::", "source", F.col("index").cast("string"))).withColumn("seq", F.struct(*order))
    kept = upsert_last(rows, "id").drop(*(c for c in order if c not in chunks.columns))
    docs = upsert_last(rows.select(F.col("document").alias("id"), F.col("document").alias("name"), "source", "seq"), "id")
    return kept, docs, kept.select(F.col("id").alias("chunk"), F.col("document"))


def upsert_last(rows: DataFrame, *key: str) -> DataFrame:
    """The last row by ``seq`` of each key: chunks and documents are simply set."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "seq").alias("r")).select(*key, *(f"r.{c}" for c in rest))


def scan(edges: DataFrame, nodes: DataFrame, least: float = 0.70) -> DataFrame:
    """Edges of enough confidence (none counts as 1) with the names of their ends, which must have names."""
    named = nodes.filter(F.col("name").isNotNull())
    for side, name in (("src", "source_name"), ("dst", "target_name")):
        edges = edges.join(named.select(F.col("label").alias(f"{side}_label"), F.col("canonical_key").alias(f"{side}_key"), F.col("name").alias(name)), [f"{side}_label", f"{side}_key"])
    return edges.filter(F.coalesce("confidence", F.lit(1.0)) >= least)



def scan_order() -> tuple[Column, ...]:
    """The scan's order: support, confidence, then the key, so that it is total."""
    return (F.desc("support_count"), F.desc(F.coalesce("confidence", F.lit(1.0))), F.asc("src_key"), F.asc("type"), F.asc("dst_key"))


def violations(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that more than one row has: what a uniqueness constraint would refuse."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def backfilled(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("canonical_key", F.coalesce("canonical_key", "name"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge meets."""
    met = edges.select(F.col("src_label").alias("label"), F.col("src_key").alias("canonical_key")).union(edges.select("dst_label", "dst_key"))
    return nodes.join(met, list(NODE_KEY), "left_anti")


def without(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after the nodes ``gone`` (label, canonical_key) are removed with their edges."""
    left = nodes.join(gone, list(NODE_KEY), "left_anti")
    for side in ("src", "dst"):
        edges = edges.join(gone.select(F.col("label").alias(f"{side}_label"), F.col("canonical_key").alias(f"{side}_key")), [f"{side}_label", f"{side}_key"], "left_anti")
    return left, edges
