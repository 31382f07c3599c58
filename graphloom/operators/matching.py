"""Many patterns in many texts: Aho-Corasick automata over shards of the patterns, built once and kept as rows.

An automaton reads a text once, whatever its number of patterns, and whatever they have in common.
Which side moves is the caller's: texts stream past automata (``in_texts``), or, where patterns are
the large side, automata stream past texts (``in_few_texts``).
"""

from __future__ import annotations

import pickle

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.tables import written

SHARD_CHARACTERS = 2_000_000  # of patterns in an automaton, but for one that is longer
ROUND_BYTES = 128 << 20  # of automata that tasks hold at a time
ROUND_CHARACTERS = 16_000_000  # of texts that tasks hold at a time
_BUILT = "characters long, automaton binary"


def _build_part(batches):
    automaton, size = ahocorasick.Automaton(), 0

    def dumped():
        automaton.make_automaton()
        return pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([pickle.dumps(automaton)], pa.binary())], names=["characters", "automaton"])

    for batch in batches:
        for pattern in batch.column(0).to_pylist():
            automaton.add_word(pattern, pattern)
            size += len(pattern)
            if size >= SHARD_CHARACTERS:
                yield dumped()
                automaton, size = ahocorasick.Automaton(), 0
    if size:
        yield dumped()


def automata(patterns: DataFrame, path: str | None = None) -> DataFrame:
    """(characters, automaton) of ``patterns``, one column of texts; stored, under ``path`` if given.

    Null and empty patterns are none; repeated ones count once.  They are dealt by a hash, so those of
    one prefix spread, and each task makes automata of as many as ``SHARD_CHARACTERS`` allow.
    """
    column = patterns.columns[0]
    rows = patterns.select(F.col(column).cast("string").alias("pattern")).filter("pattern <> ''").distinct()
    return written(rows.mapInArrow(_build_part, _BUILT), path, "automata")


def _rounds(rows: DataFrame, size: str, most: int):
    """``rows`` in blocks, collected: each of about ``most`` by ``size``, and of one row at least."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-total // most))
    if blocks == 1:
        yield rows.collect()
        return
    for b in range(blocks):
        yield rows.filter(F.pmod(F.xxhash64(*rows.columns), F.lit(blocks)) == b).collect()


def _batch(ids, patterns, id_type):
    return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(patterns, pa.string())], names=["id", "pattern"])


def _stream_part(held):
    def run(batches):
        shards = [pickle.loads(a) for a in held.value]  # noqa: S301 - made by this module
        for batch in batches:
            ids, found = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {p for shard in shards for _, p in shard.iter(text)} if text else ()
                ids += [i] * len(own)
                found += own
            yield _batch(ids, found, batch.schema.field(0).type)

    return run


def _none(texts: DataFrame, schema: str) -> DataFrame:
    return texts.sparkSession.createDataFrame([], schema)


def _schema(texts: DataFrame) -> str:
    return f"id {texts.schema[0].dataType.simpleString()}, pattern string"


def in_texts(texts: DataFrame, shards: DataFrame) -> DataFrame:
    """(id, pattern): the patterns that each of ``texts`` (its columns are an id and a text) holds, each once.

    Tasks hold automata of ``ROUND_BYTES`` at most, or one; more come in rounds over the texts.
    """
    found, context = None, texts.sparkSession.sparkContext
    for block in _rounds(shards.withColumn("bytes", F.octet_length("automaton")), "bytes", ROUND_BYTES):
        if block:
            part = texts.mapInArrow(_stream_part(context.broadcast([bytes(r["automaton"]) for r in block])), _schema(texts))
            found = part if found is None else found.unionByName(part)
    return _none(texts, _schema(texts)) if found is None else found


def _held_part(held, id_type):
    def run(batches):
        texts = held.value
        for batch in batches:
            for raw in batch.column(batch.schema.get_field_index("automaton")).to_pylist():
                shard, ids, found = pickle.loads(raw), [], []  # noqa: S301 - made by this module
                for i, text in texts:
                    own = {p for _, p in shard.iter(text)}
                    ids += [i] * len(own)
                    found += own
                yield _batch(ids, found, id_type)

    return run


def in_few_texts(texts: DataFrame, shards: DataFrame) -> DataFrame:
    """As ``in_texts``, for texts that are few and short beside the patterns: automata stream past blocks of texts."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows, found, context = texts.toDF("id", "text").filter("text <> ''").withColumn("size", F.length("text") + 1), None, texts.sparkSession.sparkContext
    for block in _rounds(rows, "size", ROUND_CHARACTERS):
        if block:
            held = context.broadcast([(r["id"], r["text"]) for r in block])
            part = shards.mapInArrow(_held_part(held, to_arrow_type(texts.schema[0].dataType)), _schema(texts))
            found = part if found is None else found.unionByName(part)
    return _none(texts, _schema(texts)) if found is None else found
