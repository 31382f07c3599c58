"""WARC archives, centroid clusters and Merkle manifests against SQL, brute force and damage done on purpose."""

import gzip
import hashlib
import random
import zlib
from math import floor

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import centroids, merkle, warc
from graphloom.llm.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_warc", "op12_centroids", "op13_merkle"])
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries()[name](spark, SF)
    rel = con.execute(oracle_sql()[name])
    columns = sorted(d[0] for d in rel.description)
    assert columns == sorted(got.columns)
    want = sorted(tuple(dict(zip([d[0] for d in rel.description], r, strict=True))[c] for c in columns) for r in rel.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == want


# --- archives

PAGES = "page_id long, url string, html string, digest string, first long, archive string"
BIG = "<p>" + "é" * 100_000


def page_rows():
    same, small = "<p>" + "x" * 200, "tiny"
    rows = [(1, "http://a/1", same), (2, "http://a/ 2\r\nX-Page-ID: 9", same), (3, None, small), (4, "", small), (5, "u", None), (6, "u", ""), (7, "u", BIG), (7, "u", BIG), (8, "u", "WARC/1.1\r\nfake\r\n\r\n" * 20), (None, "u", same), (9, "u", BIG)]
    return [(*r, "d", 1, "a") for r in rows]


def test_pages_come_back(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), PAGES).repartition(3)
    got = warc.archive(pages, f"file://{tmp_path}/a").collect()
    full = lambda t: (t or "").encode()
    want = []
    for i, _, html, *_ in page_rows():
        firsts = [j for j, _, h, *_ in page_rows() if h == html and j is not None]
        revisit = len(full(html)) >= 100 and i != min(firsts, default=i)
        want.append((i, len(full(html)), hashlib.sha256(full(html)).hexdigest(), "revisit" if revisit else "response", min(firsts) if revisit else None))
    key = lambda r: (r[0] is None, r)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=key) == sorted(want, key=key)
    assert {r["page_id"]: r["target_uri"] for r in got}[2] == "http://a/%202%0D%0AX-Page-ID:%209"
    back = warc.read(spark, f"file://{tmp_path}/a").filter("record_type = 'response'").select("page_id", F.col("payload").cast("string").alias("t")).collect()
    texts = {i: h or "" for i, _, h, *_ in page_rows()}
    assert all(r["t"] == texts[r["page_id"]] for r in back)
    # any reader of concatenated members reads the files
    assert sum(gzip.decompress(f.read_bytes()).count(b"\r\nWARC-Record-ID") for f in tmp_path.glob("a/*/*.txt")) == len(got)
    assert warc.archive(spark.createDataFrame([], PAGES)).count() == 0


def test_many_repeated_payloads_join_by_shuffle(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", f"page {i % 7} " * 40 if i % 3 else "hot " * 40) for i in range(300)], "page_id long, url string, html string")
    want = sorted(map(tuple, warc.archive(pages).collect()))
    monkeypatch.setattr(warc, "HELD_DIGESTS", 0)
    monkeypatch.setattr(warc, "HOT", 50)
    assert sorted(map(tuple, warc.archive(pages).collect())) == want


def records(n, plain=False):
    raws = [warc.record(i, f"http://h/{i}", (f"payload {i} " * (i % 50 + 1)).encode(), hashlib.sha256((f"payload {i} " * (i % 50 + 1)).encode()).hexdigest(), None) for i in range(n)]
    return raws if plain else [warc.member(r) for r in raws]


def found(content):
    out = list(warc.salvage(content))
    return [int(r[3]["x-page-id"]) for r in out if r[0] == "record"], [r[1:] for r in out if r[0] == "gap"]


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("seed", range(6))
def test_salvage_of_random_damage(plain, seed):
    """Every record that the damage does not touch is recovered, and the gaps cover what it touches.

    Headers of plain records have no checksum, so there the damage is in blocks.
    """
    rng, parts = random.Random(seed), records(60, plain)
    starts = np.cumsum([0, *map(len, parts)])
    content = bytearray(b"".join(parts))
    hit = set()
    for _ in range(5):
        at = rng.randrange(len(content) - 40)
        for i in range(at, at + rng.randrange(1, 40)):
            own = int(np.searchsorted(starts, i, "right") - 1)
            if not plain or starts[own] + parts[own].find(warc.END) + 4 <= i < starts[own + 1] - 4:
                content[i] ^= rng.randrange(1, 256)
                hit.add(own)
    ids, gaps = found(bytes(content))
    assert set(ids) >= set(range(60)) - hit and ids == sorted(set(ids))
    lost = set(range(60)) - set(ids)
    assert all(any(a <= starts[i] and b >= starts[i + 1] - len(warc.END) for a, b, _ in gaps) for i in lost)
    assert all(b > a and reason for a, b, reason in gaps)


def test_salvage_of_cuts_and_insertions():
    parts = records(10)
    whole = b"".join(parts)
    assert found(whole) == (list(range(10)), [])
    ids, gaps = found(whole[:-3])
    assert ids == list(range(9)) and gaps == [(len(whole) - len(parts[-1]), len(whole) - 3, "member cut short")]
    junk = b"\x1f\x8b\x08junk WARC/1.1\r\n more"
    ids, gaps = found(parts[0] + junk + b"".join(parts[1:]))
    assert ids == list(range(10)) and [(a, b) for a, b, _ in gaps] == [(len(parts[0]), len(parts[0]) + len(junk))]
    ids, gaps = found(b"".join(parts[:3]) + parts[3][20:] + b"".join(parts[4:]))
    assert ids == [0, 1, 2, 4, 5, 6, 7, 8, 9] and len(gaps) == 1
    assert found(b"") == ([], []) and found(b"nothing here")[1] == [(0, 12, "no record")]
    # plain and packed records mix, and one member may hold several records
    both = records(4, True)
    assert found(both[0] + warc.member(both[1] + both[2]) + warc.EMPTY_MEMBER + both[3]) == ([0, 1, 2, 3], [])


def test_salvage_by_spark(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"text {i} " * 60) for i in range(200)], "page_id long, url string, html string").repartition(2)
    warc.write(pages, f"file://{tmp_path}/a")
    file = max(tmp_path.glob("a/*/*.txt"), key=lambda f: f.stat().st_size)
    raw = bytearray(file.read_bytes())
    for i in range(len(raw) // 2, len(raw) // 2 + 30):
        raw[i] ^= 0x5A
    file.write_bytes(raw)
    for crc in tmp_path.glob("a/*/.*.crc"):
        crc.unlink()
    got = warc.read(spark, f"file://{tmp_path}/a")
    gaps = got.filter("kind = 'gap'").collect()
    assert len(gaps) == 1 and gaps[0]["start"] <= len(raw) // 2 < gaps[0]["end"]
    assert 197 <= got.filter("kind = 'record'").count() <= 199


# --- clusters

VECTORS = "vec_id long, embedding array<double>, cluster int, x string, distance long"


def by_hand(rows, k=8, rounds=10, seed=3):
    kept = [(i, [floor(1024 * v) for v in e]) for i, e in rows if e is not None and len(e) == 64 and all(v is not None and np.isfinite(v) for v in e)]
    draw = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "")
    c = [list(x) for _, x in sorted(kept, key=lambda r: (draw(r[0]), r[1]))[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        for j in range(len(c)):
            mine = [x for (_, x), o in zip(kept, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    return sorted(((i, *near(x)[::-1]) for i, x in kept), key=str), c


def vectors(kind):
    rng = np.random.default_rng(5)
    if kind == "ties":  # few distinct points on a lattice: equal distances abound
        return [(i, [float(v) for v in rng.integers(0, 2, 64) * (np.arange(64) < 3)]) for i in range(150)]
    if kind == "large":
        return [(i, [float(v) for v in rng.normal(size=64) * 40_000]) for i in range(60)]
    if kind == "few":
        return [(i, [float(i)] * 64) for i in range(3)]
    e = [0.5] * 64
    return [(1, e), (1, e), (None, [0.1] * 64), (2, None), (3, [1.0] * 63), (4, [float("nan")] * 64), (5, [float("inf")] + [0.0] * 63), (6, [None] + [0.0] * 63), (7, []), (8, [-0.0001] * 64), *((i, [float(v) for v in rng.normal(size=64)]) for i in range(20, 60))]


@pytest.mark.parametrize("kind", ["ties", "large", "few", "odd"])
def test_clusters_equal_brute_force(spark, kind):
    rows = vectors(kind)
    frame = spark.createDataFrame([(i, e, 9, "x", 8) for i, e in rows], VECTORS).repartition(3)
    got = centroids.cluster(frame).collect()
    want, c = by_hand(rows)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=str) == want
    total = sum(w[2] for w in want)
    for r in got:
        assert r["inertia"] == total and r["cluster_inertia"] == sum(w[2] for w in want if w[1] == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, c[r["cluster"]])).encode()).hexdigest()


def test_no_vectors(spark):
    assert centroids.cluster(spark.createDataFrame([], VECTORS)).count() == 0
    assert centroids.cluster(spark.createDataFrame([(1, [1.0], 1, "x", 1)], VECTORS)).count() == 0


def test_bounds_spare_distances():
    """On vectors in groups most distances are skipped, and assignments are those of all distances."""
    rng = np.random.default_rng(1)
    x = (rng.integers(0, 8, 4000)[:, None] * 1000 + rng.normal(size=(4000, 64)) * 30).astype(np.int64)
    c, before = x[:8].copy(), None
    cluster, upper, lower = np.full(4000, -1, np.int32), np.zeros(4000), np.zeros((4000, 8))
    done = 0
    for i in range(11):
        used = centroids.Bounds(c, before).assign(x, cluster, upper, lower)
        done += used if i else 0
        squares = np.array([centroids.squared(x, m) for m in c]).T
        assert (cluster == squares.argmin(1)).all()
        assert (upper**2 >= squares.min(1)).all() and (lower**2 <= squares).all()
        before, c = c, np.array([x[cluster == j].sum(0) // max((cluster == j).sum(), 1) if (cluster == j).any() else c[j] for j in range(8)])
    assert done < 0.35 * 10 * 4000 * 8


# --- trees

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, n long, at long, digest string, top string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(i, text, lang, source, n):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def proofs_of(leaves):
    steps, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for i, o in enumerate(at):
            run = nodes[o // 16 * 16 : o // 16 * 16 + 16]
            steps[i].append((run[: o % 16], run[o % 16 + 1 :]))
            at[i] = o // 16
        nodes = [digest(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], steps


def manifest_of(rows):
    lower = lambda t: t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r))) for s in sources}
    trees = {s: proofs_of([leaf_of(*r) for r in own[s]]) for s in sources}
    root, above = proofs_of([trees[s][0] for s in sources])
    out = []
    for s, up in zip(sources, above, strict=True):
        for r, way in zip(own[s], trees[s][1], strict=True):
            way = way + up
            fold = leaf_of(r[0], lower(r[1]), *r[2:]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf_of(*r)
            for a, b in way:
                fold = digest(*a, fold, *b)
            out.append((r[0], leaf_of(*r), trees[s][0], root, digest(*(d for a, b in way for d in a + b)), fold, fold == root))
    return out


@pytest.mark.parametrize("kind", ["sizes", "one", "odd", "sources"])
def test_manifest_equals_brute_force(spark, kind):
    word = lambda i: f"Some Text {i}"
    if kind == "sizes":  # lone leaves, full and broken runs, three levels, in few and many tasks
        rows = [(j * 10_000 + i, word(i), "en", f"s{j}", 5) for j, n in enumerate((1, 2, 16, 17, 256, 257, 700)) for i in range(n)]
    elif kind == "one":
        rows = [(3, "A", None, None, None)]
    elif kind == "odd":
        rows = [(1, None, "en", "a", 1), (1, None, "en", "a", 1), (1, "B", "en", "a", 1), (None, "C", "en", None, 1), (2, "", None, "", 0), (4, "É" * 90_000 + "Q", "x", "", 3), (5, "日本", "ja", "é", 2), *((9, "same", "en", "z", 4) for _ in range(40))]
    else:
        rows = [(i, word(i), "en", f"source {i % 300}", 1) for i in range(600)]
    frame = spark.createDataFrame([(*r, "t", 1, 2, "d", "p") for r in rows], DOCS).repartition(7)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted((tuple(r) for r in merkle.manifest(frame).collect()), key=key)
    assert got == sorted(manifest_of(rows), key=key)


def test_empty_manifest(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_spans_join_by_shuffle(spark, monkeypatch):
    rows = [(i, f"t{i}", "en", f"s{i % 3}", 1) for i in range(100)]
    frame = spark.createDataFrame([(*r, "t", 1, 2, "d", "p") for r in rows], DOCS)
    monkeypatch.setattr(merkle, "HELD_SPANS", 0)
    assert sorted(tuple(r) for r in merkle.manifest(frame).collect()) == sorted(manifest_of(rows))
