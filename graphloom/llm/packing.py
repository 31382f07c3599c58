"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents.

Rows are dealt to tasks and ordered within them by a seeded hash, so a task holds a random part of
the documents and a rerun the same one.  It packs them group by group (a group is closed by a token
budget, so memory does not grow with the input).
Within a group, stretches of ``LENGTH`` ids become sequences of their own and the rests are packed
first-fit decreasing.  The emptiest bins are then cut up to fill the gaps of the others; what is
left over goes into the task's next group, and at the task's end into sequences whose sizes are
powers of two.  Nothing is padded that way.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import scratch, stored, table

LENGTH = 4096
END_ID = 2
GROUP_TOKENS = 4_000_000  # ids of a group; bounds a task's memory
SEED = 23
KEPT_CHUNKS = 200_000  # encoded chunks a worker remembers; others are encoded again
KEPT_PARTS = 600_000  # encoded words a worker remembers
TOKENIZER = "word_bpe_49k.json"
END_BYTES = np.array([END_ID], "<u4").tobytes()
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_ENCODERS: dict = {}


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) if b in shown else chr(0x100 + i) for i, b in enumerate(sorted(range(256), key=lambda b: (b in shown, b)))} | {b: chr(b) for b in shown}


class ChunkEncoder:
    """Ids of whole texts by way of their blank-separated chunks.

    The vocabulary's pre-tokenizer drops white space and no token or normalisation crosses it, so a
    text's ids are those of its chunks; chunks met before are looked up.  Chunks of ASCII and
    Latin-1 letters are already in normal form: they are cut into words here and the words go to the
    vocabulary's merges; other chunks go through the whole tokenizer.
    """

    PLAIN = re.compile(r"[\x21-\x7E\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")
    # the vocabulary's own pre-tokens, for those letters
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[^a-z0-9\u00DF-\u00F6\u00F8-\u00FF]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.chunks: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> ChunkEncoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _part(self, part: str) -> bytes:
        spelt = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.merge(spelt)]).tobytes()
        if len(self.parts) < KEPT_PARTS:
            self.parts[part] = ids
        return ids

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if self.PLAIN.fullmatch(text) and "<|" not in text:
            get = self.parts.get
            ids = b"".join([get(p) or self._part(p) for p in self.PARTS.findall(text.lower())])
        else:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.chunks) < KEPT_CHUNKS:
            self.chunks[chunk] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text, followed by ``END_ID``."""
        get, slow = self.chunks.get, self._chunk
        ids = [i if (i := get(c)) is not None else slow(c) for c in (text or "").encode("utf-8", "replace").split()]
        ids.append(END_BYTES)
        return np.frombuffer(b"".join(ids), "<u4")


class Tournament:
    """Bins' free room in a complete binary tree whose nodes hold the larger of their children."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.tree = [room] * (2 * self.leaves)

    def take(self, size: int) -> int:
        """The first bin with room for ``size``, after placing it there."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        tree[node] -= size
        at = node
        while at > 1:
            at //= 2
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
        return node - self.leaves


def first_fit_decreasing(sizes: list[int], room: int) -> list[list[int]]:
    """Bins of indices into ``sizes``; larger first, ties by index, each in the first bin that has room."""
    tree, bins = Tournament(len(sizes), room), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = tree.take(sizes[i])
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
    return bins


# a piece: (doc_id, doc_tokens, start, ids)
def _split(piece, n):
    doc, total, start, ids = piece
    return (doc, total, start, ids[:n]), (doc, total, start + n, ids[n:])


def pack_group(pieces: list) -> tuple[list[list], list]:
    """Full sequences of pieces, and the pieces left over (fewer than ``LENGTH`` ids together)."""
    bins = [[pieces[i] for i in b] for b in first_fit_decreasing([len(p[3]) for p in pieces], LENGTH)]
    fill = lambda b: sum(len(p[3]) for p in b)
    bins.sort(key=fill, reverse=True)
    whole = sum(map(fill, bins)) // LENGTH
    full, loose = bins[:whole], [p for b in bins[whole:] for p in b][::-1]
    for b in full:
        gap = LENGTH - fill(b)
        while gap:
            piece = loose.pop()
            if len(piece[3]) > gap:
                piece, rest = _split(piece, gap)
                loose.append(rest)
            b.append(piece)
            gap -= len(piece[3])
    return full, loose


def power_sequences(pieces: list) -> list[list]:
    """The pieces cut into sequences whose sizes are falling powers of two."""
    out, loose, left = [], pieces[::-1], sum(len(p[3]) for p in pieces)
    while left:
        size = gap = 1 << (left.bit_length() - 1)
        out.append([])
        while gap:
            piece = loose.pop()
            if len(piece[3]) > gap:
                piece, rest = _split(piece, gap)
                loose.append(rest)
            out[-1].append(piece)
            gap -= len(piece[3])
        left -= size
    return out


def _pack_part(path: str):
    def run(batches):
        encoder = ChunkEncoder.of(path)
        sequence = TaskContext.get().partitionId() << 40
        loose: list = []
        held = 0

        def rows(sequences):
            nonlocal sequence
            cols: list[list] = [[] for _ in range(7)]
            for seq in sequences:
                offset = 0
                for doc, total, start, ids in seq:
                    for col, x in zip(cols, (doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset), strict=True):
                        col.append(x)
                    offset += len(ids)
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            docs = batch.column(0).to_pylist()
            column = batch.column(1)
            for at in range(0, len(docs), 256):
                full = []
                for doc, text in zip(docs[at : at + 256], column.slice(at, 256).to_pylist(), strict=True):
                    ids = encoder.encode(text)
                    n = len(ids)
                    cut = n - n % LENGTH
                    full += [[(doc, n, s, ids[s : s + LENGTH])] for s in range(0, cut, LENGTH)]
                    if cut < n:
                        loose.append((doc, n, cut, ids[cut:].copy()))
                        held += n - cut
                    if len(full) > 4096:
                        yield rows(full)
                        full = []
                if full:
                    yield rows(full)
                if held >= GROUP_TOKENS:
                    full, loose = pack_group(loose)
                    held = sum(len(p[3]) for p in loose)
                    yield rows(full)
        if loose:
            full, loose = pack_group(loose)
            yield rows(full + power_sequences(loose))

    return run


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text, any others) in sequences of at most ``LENGTH`` ids; stored.

    Null and empty texts are the end id alone.  Texts of any length are encoded whole and cut.
    Repeated rows are packed each, and as they are alike their order does not matter.  A null doc_id
    stays null.  An empty table gives an empty result.  Packing depends on the number of shuffle
    partitions, not on which machine runs a task.  ``tokenizer``: path of the vocabulary file, the
    same on every machine.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("doc_id", "text", F.xxhash64(F.lit(SEED), "doc_id", "text").alias("deal")).repartition(n, "deal").sortWithinPartitions("deal", "doc_id")
    with scratch() as keep:
        return keep(stored(dealt.select("doc_id", "text").mapInArrow(_pack_part(path), SCHEMA), "packed"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
