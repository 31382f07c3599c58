"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

Documents of equal shingle sets are one class.  The classes' signatures are cut into bands; each
bucket gets a centre, the class that meets most others, and each member is verified against the
centre on full sets, so a bucket of n members costs n comparisons.  Members that the components
found so far leave apart from their centre are then matched with all of the centre's group, block by
block, by how their sets differ from the centre's: that gives exact intersections without the texts,
and only links come out.  All links are verified on full sets; none that the bands find is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import drop_stored, hot_join, scratch, stored, table, words

WIDTH = 5  # words of a shingle
PERCENT = 85  # least 100 * intersection / union
M, BANDS = 64, 16  # signature length; a band has M / BANDS values
SALTS = 256  # tasks that the members of one centre spread over
HELD_IDS = 2_000_000  # ids that a broadcast may hold; beyond, a shuffle join
LEVEL_BITS = 26  # a signature value is its level and 26 random bits

BLOCK, BLOCK_TOKENS = 1024, 500_000  # strays of a block or members of a slice, and their differences

_U = np.uint64
LACK = _U(0x5851F42D4C957F2D)  # marks a shingle that the centre has and the member lacks


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; of the whole sequence if it is shorter."""
    own = words(text)
    if not own:
        return np.empty(0, _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, own), _U, len(own))
    n = max(1, len(h) - width + 1)
    acc = np.full(n, len(h) if len(h) < width else width, _U)
    for i in range(min(width, len(h))):
        acc = _mix(acc * _U(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(acc)


def superminhash(elements: np.ndarray, doc: np.ndarray, n_docs: int, m: int = M) -> np.ndarray:
    """Signatures (n_docs, m) of the sets given as flat elements with their document.

    Level j holds the j-th step of every element's random permutation: a value that orders by level
    first.  A document whose places are all filled up to level j gains nothing from later levels, so
    its elements stop there.
    """
    sig = np.full(n_docs * m, 0xFFFFFFFF, np.uint32)
    live, perm = np.arange(len(elements)), None
    for j in range(m):
        e, d = elements[live], doc[live]
        x = _mix(e + _U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = (j + (((x & _U(0xFFFFFFFF)) * _U(m - j)) >> _U(32))).astype(np.int64)
        value = (x >> _U(64 - LEVEL_BITS)).astype(np.uint32) | np.uint32(j << LEVEL_BITS)
        if perm is None:
            place = k
        else:
            rows = np.arange(len(live))
            place = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
            perm[rows, j] = place
        np.minimum.at(sig, d * m + place, value)
        if j == m - 1:
            break
        open_ = sig.reshape(n_docs, m).max(1) >= np.uint32((j + 1) << LEVEL_BITS) if j < 63 else None
        stay = open_[d]
        if not stay.any():
            break
        if perm is None:
            perm = np.tile(np.arange(m, dtype=np.uint8), (int(stay.sum()), 1))
            first, rows = k[stay], np.arange(int(stay.sum()))
            perm[rows, first], perm[:, 0] = 0, first.astype(np.uint8)
        else:
            perm = perm[stay]
        live = live[stay]
    return sig.reshape(n_docs, m)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(documents, bands) bucket keys; the band's number is part of its key."""
    rows = sig.reshape(len(sig), bands, -1).astype(_U)
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=_U), rows.shape[:2]).copy()
    for i in range(rows.shape[2]):
        acc = _mix(acc * _U(0x9E3779B97F4A7C15) + rows[:, :, i])
    return acc.view(np.int64)


def _signature_part(batches):
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        at = 0
        while at < len(texts):
            sets, size, first = [], 0, at
            while at < len(texts) and size < 150_000 and len(sets) < 2000:
                sets.append(shingles(texts[at]))
                size += len(sets[-1])
                at += 1
            lens = np.array([len(s) for s in sets])
            sig = superminhash(np.concatenate(sets), np.repeat(np.arange(len(sets)), lens), len(sets))
            keys = band_keys(sig)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, len(sets)), pa.array(lens, pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([k.tolist() if n else None for k, n in zip(keys, lens, strict=True)], pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "keys"],
            )


def _verify_part(percent: int):
    """Over rows sorted by centre, salt and role: each member against its centre, and where the two differ."""

    def run(batches):
        out: list = []
        centre, sets = None, []
        for batch in batches:
            for c, salt, role, rep, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                own = shingles(text)
                if role == 0:
                    if centre != (c, salt):
                        centre, sets = (c, salt), []
                    sets.append(own)
                    continue
                if centre != (c, salt):
                    raise ValueError(f"no text of centre {c}")
                for hub in sets:
                    shared = np.isin(own, hub, assume_unique=True)
                    inter = int(shared.sum())
                    linked = 100 * inter >= percent * (len(own) + len(hub) - inter)
                    lacks = np.setdiff1d(hub, own, assume_unique=True) ^ LACK
                    out.append((rep, c, len(own), linked, np.sort(np.concatenate([own[~shared], lacks]).view(np.int64))))
                if len(out) >= 1000:
                    yield _verified(out)
        if out:
            yield _verified(out)

    return run


def _verified(out: list) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True))
    out.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())), strict=True)], names=["rep", "center", "n", "linked", "diff"])


def _verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(rep, center, n, linked, diff) of the pairs (rep, center); a centre's members are spread over salts."""
    pairs = pairs.select("rep", "center", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int").alias("salt"))
    members = pairs.join(texts.withColumnRenamed("doc_id", "rep"), "rep").select("center", "salt", F.lit(1).alias("role"), "rep", "text")
    hubs = pairs.groupBy("center", "salt").agg(F.lit(0).alias("role")).join(texts.withColumnRenamed("doc_id", "center"), "center").select("center", "salt", "role", F.col("center").alias("rep"), "text")
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = members.unionByName(hubs).repartition(n, "center", "salt").sortWithinPartitions("center", "salt", "role")
    return rows.mapInArrow(_verify_part(percent), "rep long, center long, n long, linked boolean, diff array<long>")


def _union_part(batches):
    """Union-find over a task's edges; a forest of stars comes out."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def stars():
        nodes = [x for x in parent if find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 1_000_000:
            yield stars()
            parent.clear()
    if parent:
        yield stars()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over the edges (u, v), for nodes other than their own root.

    Union-find within each task, then alternating large-star and small-star steps until the stars stay.
    """
    at = stored(edges.select("u", "v").filter("u <> v").mapInArrow(_union_part, "u long, v long"), "cc")
    mark = None
    while True:
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = down.join(down.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e")).select(F.col("e.a").alias("u"), F.col("e.b").alias("v"))
        new = stored(small.filter("u <> v").distinct(), "cc")
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        drop_stored(at)
        at = new
        if tuple(now) == mark and now[0] == now[2]:
            return at.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(now)


def _ties(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (u, v) between the classes of rows that share a doc_id: such rows are one document."""
    repeated = signed.filter("digest is not null and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("doc_id")
    own = signed.filter("digest is not null").join(repeated, "doc_id").select("doc_id", "digest", "n_shingles").distinct().join(classes, ["digest", "n_shingles"]).select("doc_id", "rep")
    return own.join(own.groupBy("doc_id").agg(F.min("rep").alias("v")), "doc_id").filter("rep <> v").select(F.col("rep").alias("u"), "v").distinct()


def _links(signed: DataFrame, docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame | None:
    """(node, root) over class representatives, or None if nothing links two."""
    ties = stored(_ties(signed, classes), "nd-ties")
    reps = stored(signed.filter("digest is not null and doc_id is not null").groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")).select("rep", "keys"), "nd-reps")
    rows = reps.select("rep", F.explode("keys").alias("key")).distinct()
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    full = stored(rows.join(buckets, "key"), "nd-full")
    known = full.groupBy("rep").agg(F.sum("size").alias("known"))
    full = stored(full.join(known, "rep").select("key", "rep", "known"), "nd-known")
    centres = full.groupBy("key").agg(F.max(F.struct(F.col("known"), -F.col("rep"))).alias("top"), F.count(F.lit(1)).alias("size")).select("key", (-F.col("top.col2")).alias("center"), F.col("top.known").alias("fame"), "size")
    pairs = stored(hot_join(full, centres, "key", "size").filter("rep <> center").select("rep", "center", "fame").distinct(), "nd-pairs")
    if pairs.isEmpty():
        return None if ties.isEmpty() else components(ties)
    ids = stored(pairs.select(F.explode(F.array("rep", "center")).alias("doc_id")).distinct(), "nd-ids")
    texts = stored(docs.select("doc_id", "text").join(F.broadcast(ids) if ids.count() <= HELD_IDS else ids, "doc_id"), "nd-texts")
    stars = stored(_verify(pairs, texts, percent), "nd-stars")
    links = stars.filter("linked").select(F.col("rep").alias("u"), F.col("center").alias("v")).unionByName(ties)
    root = stored(components(links), "nd-roots")
    more = stored(_inner_links(stars, pairs, root, percent), "nd-more")
    return root if more.isEmpty() else components(links.unionByName(more))


def _block_part(percent: int):
    """Over rows sorted by centre, block and role: the block's strays (role 0), then each member against all of them.

    Sets are known by their differences from the centre, and sets differ from each other exactly
    where those differ.  Links that join components not yet joined in the block come out.
    """

    def run(batches):
        at, block, index = None, [], None
        out: list = []

        def links(row):
            rep, n, own, main, diff = row
            tokens, ptr, owners, sizes, ns, roots, mains, reps, find, parent = index
            pos = np.minimum(np.searchsorted(tokens, diff), len(tokens) - 1)
            pos = pos[tokens[pos] == diff]
            lens = ptr[pos + 1] - ptr[pos]
            places = np.repeat(ptr[pos] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
            shared = np.bincount(owners[places], minlength=len(ns))
            apart = sizes + len(diff) - 2 * shared
            inter2 = ns + n - apart  # twice the intersection
            ok = 100 * inter2 >= percent * (2 * (ns + n) - inter2)
            ok &= (roots != own) & ((mains != main) | (mains == at[0]))
            for i in np.flatnonzero(ok).tolist():
                x, y = find(own), find(int(roots[i]))
                if x != y:
                    parent[x] = y
                    out.append((rep, int(reps[i])))

        def indexed():
            sizes = np.array([len(r[4]) for r in block])
            flat, owner = np.concatenate([r[4] for r in block]), np.repeat(np.arange(len(block)), sizes)
            order = np.argsort(flat, kind="stable")
            tokens, first = np.unique(flat[order], return_index=True)
            parent: dict = {}

            def find(x):
                while parent.setdefault(x, x) != x:
                    x = parent[x]
                return x

            ints = lambda k: np.array([r[k] for r in block], np.int64)
            return tokens, np.append(first, len(flat)), owner[order], sizes, ints(1), ints(2), ints(3), ints(0), find, parent

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns[:-1]]
            for c, b, role, rep, n, own, main, diff in zip(*cols, batch.columns[-1], strict=True):
                row = (rep, n, own, main, diff.values.to_numpy())
                if at != (c, b):
                    at, block, index = (c, b), [], None
                if role == 0:
                    block.append(row)
                elif block:
                    index = index or indexed()
                    links(row)
                if len(out) > 10_000:
                    yield _pairs_batch(out)
        if out:
            yield _pairs_batch(out)

    return run


def _pairs_batch(out: list) -> pa.RecordBatch:
    u, v = zip(*out, strict=True)
    out.clear()
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _inner_links(stars: DataFrame, pairs: DataFrame, root: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between members of a centre's group that the components ``root`` leave apart.

    Strays, the members outside their centre's component, are the queries, in blocks of bounded
    size, against all members, in slices of bounded size.  Of the groups that hold both ends, their main centre's looks at a pair.
    """
    rooted = lambda df, c, name: df.join(root.select(F.col("node").alias(c), F.col("root").alias(name)), c, "left").withColumn(name, F.coalesce(name, c))
    main = pairs.groupBy("rep").agg((-F.max(F.struct("fame", -F.col("center")))["col2"]).alias("main"))
    hubs = rooted(stars.groupBy("center").agg(F.count(F.lit(1)).alias("size")), "center", "hub")
    members = stored(rooted(stars.select("rep", "center", "n", "diff").join(main, "rep"), "rep", "own"), "nd-own")
    members = stored(hot_join(members, hubs, "center", "size"), "nd-members")
    stray = F.col("own") != F.col("hub")
    parts = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_TOKENS)).cast("int")
    grid = members.groupBy("center").agg(parts(F.count(F.when(stray, 1)), F.sum(F.when(stray, F.size("diff")))).alias("blocks"), parts(F.count(F.lit(1)), F.sum(F.size("diff"))).alias("slices"), F.count(F.lit(1)).alias("size"))
    members = hot_join(members, grid.filter("blocks > 0"), "center", "size")
    tail = ("rep", "n", "own", "main", "diff")
    own = lambda k: F.pmod(F.xxhash64("rep"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    # each block of strays meets each slice of members in a task of its own
    strays = members.filter(stray).withColumn("slice", every("slices")).select("center", (own("blocks") * F.col("slices") + F.col("slice")).alias("block"), F.lit(0).alias("role"), *tail)
    all_ = members.withColumn("b", every("blocks")).select("center", (F.col("b") * F.col("slices") + own("slices")).alias("block"), F.lit(1).alias("role"), *tail)
    n = int(stars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = strays.unionByName(all_).repartition(n, "center", "block").sortWithinPartitions("center", "block", "role")
    return rows.mapInArrow(_block_part(percent), "u long, v long")


def near_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, any others): doc_id, n_shingles, component_id, kept; stored.

    Texts without words have an empty set and link with nothing.  Texts of any length are taken
    whole.  Rows of one doc_id count as one document with the links of each of them: all get its
    component.  Equal texts are one class, so copies cost nothing.  Rows without doc_id stand alone:
    component_id null, kept true.  An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scratch() as keep:
        signed = stored(docs.mapInArrow(_signature_part, "doc_id long, n_shingles long, digest binary, keys array<long>"), "nd-signed")
        classes = signed.filter("digest is not null and doc_id is not null").groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"))
        root = _links(signed, docs, classes, percent)
        if root is not None:
            classes = classes.join(root.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("rep", F.coalesce("root", "rep")).drop("root")
        # a set that many documents share is one class with one row here, and many on the other side
        one = classes.select(F.struct("digest", "n_shingles").alias("class"), "rep", "size")
        rows = signed.select("doc_id", "n_shingles", F.when(F.col("digest").isNotNull() & F.col("doc_id").isNotNull(), F.struct("digest", "n_shingles")).alias("class"))
        none = rows.filter("class is null").withColumn("rep", F.lit(None).cast("long"))
        rows = hot_join(rows.filter("class is not null"), one, "class", "size").unionByName(none)
        # a row without words has no class; its doc_id may have one by another row
        empty = none.filter("doc_id is not null").select("doc_id").distinct()
        other = rows.filter("class is not null").select("doc_id", "rep").join(empty, "doc_id").groupBy("doc_id").agg(F.min("rep").alias("other"))
        found = rows.join(other, "doc_id", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "other", "doc_id")))
        return keep(stored(found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")), "near-dedup"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
