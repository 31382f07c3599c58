"""Document fingerprints: a canonical exact digest.

Texts are folded (NFKC, case, white space), hashed with 128-bit xxh3, and the documents of equal
digests are compared byte for byte.  Should two different folded texts ever share a digest, the
digest is widened by another seed and the comparison made again, until equal digests mean equal
folded texts.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import drop_stored, scratch, stored, table

HELD_DIGESTS = 1_000_000  # repeated digests that are sent to all tasks (8 bytes each); more are joined
RANGES_A_PARTITION = 3


def fold(text: str) -> str:
    """NFKC, case folding, NFKC again (folding may undo it), white-space runs to one blank, none at the ends."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).casefold()
        text = unicodedata.normalize("NFKC", text)
    else:
        text = text.lower()
    return " ".join(text.split())


def digest(folded: bytes, lanes: int) -> str:
    return "".join(xxhash.xxh3_128_hexdigest(folded, seed=i) for i in range(lanes))


def likeness(a: str, b: str) -> float:
    """Exact digests are alike or not."""
    return float(a == b)


def _folded(text: str | None) -> bytes:
    return fold(text or "").encode("utf-8", "replace")


def _range_of(ids: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """Ranges from 1 in rising doc_id; null doc_ids, the last in descending order, are range 0."""
    valid = ids.is_valid().to_numpy(zero_copy_only=False)
    return np.where(valid, np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right") + 1, 0)


def _ranges(bounds):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_range_of(b.column(0), bounds).astype(np.int32))], names=["doc_id", "rng"])

    return run


def _dealt(bounds, carry_to: dict):
    """Rows with their range; the first rows of a range go to the range before it as well, as ``carried``."""

    def run(batches):
        for b in batches:
            rng = _range_of(b.column(0), bounds).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rng), pa.array(np.zeros(len(rng), bool))], names=["doc_id", "text", "rng", "carried"])
            at = [(i, to) for i, (r, d) in enumerate(zip(rng.tolist(), b.column(0).to_pylist(), strict=True)) if (to := carry_to.get((r, d))) is not None]
            if at:
                rows = b.take(pa.array([i for i, _ in at]))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([to for _, to in at], pa.int32()), pa.array(np.ones(len(at), bool))], names=["doc_id", "text", "rng", "carried"])

    return run


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, clash boolean"


def _edit_part(hashed):
    """Over rows sorted by range, carried and descending doc_id: each row with the one after it."""

    def run(batches):
        out: list = []

        def made(row, after):
            (_, doc, text), text_after = row, after
            n = len(text)
            k = n // 3
            edited = text[: n - k] + text_after[:k]
            own, new, then = (_folded(x) for x in (text, edited, text_after))
            a, b, c = hashed(own), hashed(new), hashed(then)
            clash = (a == b) != (own == new) or (a == c) != (own == then)
            return (doc, n, hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), a, b, likeness(a, b), likeness(a, c), clash)

        def flush():
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True)], names=[x.split()[0] for x in OUT.split(", ")])

        last, done = None, None
        for b in batches:
            for doc, text, rng, carried in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = text or ""
                if last is not None and last[0] == rng:
                    out.append(made(last, text))
                elif last is not None:
                    raise ValueError(f"range {last[0]} has no row after its last")
                if carried or done == rng:
                    last, done = None, rng  # of several carried rows the first counts
                else:
                    last = (rng, doc, text)
                if len(out) >= 2000:
                    yield flush()
        if last is not None:
            raise ValueError(f"range {last[0]} has no row after its last")
        if out:
            yield flush()

    return run


def _repeated_part(hashed, held):
    """(digest, folded) of the rows whose digest's first 60 bits are in the sorted array ``held``; all rows if None."""

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column(0).to_pylist():
                folded = _folded(text)
                d = hashed(folded)
                if held is not None:
                    key = int(d[:15], 16)
                    at = np.searchsorted(held.value, key)
                    if at == len(held.value) or held.value[at] != key:
                        continue
                rows.append((d, folded))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["fingerprint", "folded"])

    return run


def _edits(docs: DataFrame, hashed) -> DataFrame:
    """OUT rows; whole texts move once, to ranges of doc_id."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) * RANGES_A_PARTITION
    ids = docs.select("doc_id")
    quantiles = ids.filter(F.col("doc_id").isNotNull()).agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0]
    bounds = np.array(sorted(set(quantiles or [])), np.int64)
    firsts = {r["rng"]: r["first"] for r in ids.mapInArrow(_ranges(bounds), "doc_id long, rng int").groupBy("rng").agg(F.max("doc_id").alias("first")).collect()}
    order = sorted(firsts)
    # descending: the range below follows; the lowest range is followed by the highest
    carry_to = {(r, firsts[r]): order[(i + 1) % len(order)] for i, r in enumerate(order)}
    dealt = docs.mapInArrow(_dealt(bounds, carry_to), "doc_id long, text string, rng int, carried boolean")
    dealt = dealt.repartition(n, "rng").sortWithinPartitions("rng", "carried", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    return dealt.select("doc_id", "text", "rng", "carried").mapInArrow(_edit_part(hashed), OUT)


def _conflict(docs: DataFrame, prints: DataFrame, hashed) -> bool:
    """Whether different folded texts of ``docs`` share a fingerprint: bytes are compared within equal digests."""
    spark = docs.sparkSession
    repeated = stored(prints.groupBy("fingerprint").count().filter("count > 1").select("fingerprint"), "fp-repeated")
    n = repeated.count()
    if not n:
        return False
    if n <= HELD_DIGESTS:
        keys = repeated.select(F.conv(F.substring("fingerprint", 1, 15), 16, 10).cast("long").alias("k")).toArrow()["k"].to_numpy()
        held = spark.sparkContext.broadcast(np.unique(keys))
        rows = docs.select("text").mapInArrow(_repeated_part(hashed, held), "fingerprint string, folded binary")
    else:
        rows = docs.select("text").mapInArrow(_repeated_part(hashed, None), "fingerprint string, folded binary").join(repeated, "fingerprint", "left_semi")
    texts = rows.groupBy("fingerprint", "folded").agg(F.lit(1).alias("one"))
    return bool(texts.groupBy("fingerprint").count().filter("count > 1").limit(1).count())


def fingerprints(docs: DataFrame, hash_with=digest) -> DataFrame:
    """Fingerprint of every text and of its edited text (its last third replaced by the next document's start).

    Null text counts as empty; texts of any length are taken whole.  The next document is the one
    with the next smaller doc_id (null doc_ids last, rows of one doc_id in the order of a hash of
    their texts, then of the texts); after the last comes the first, so a single document follows
    itself.  An empty table gives an empty result.  The result is stored.
    """
    docs, lanes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), 1
    with scratch() as keep:
        while True:
            hashed = _with_lanes(hash_with, lanes)
            out = stored(_edits(docs, hashed), "fp-rows")
            if out.filter("clash").isEmpty() and not _conflict(docs, out.select("fingerprint"), hashed):
                return keep(out).drop("clash")
            drop_stored(out)
            lanes += 1


def _with_lanes(hash_with, lanes):
    return lambda folded: hash_with(folded, lanes)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
