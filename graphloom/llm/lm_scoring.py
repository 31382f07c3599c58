"""LM scoring: a log-bilinear neural model, trained in numpy by noise-contrastive estimation.

Outputs of the network are the most frequent training words, one class for each group of the
remaining words (grouped by a checksum of their first bytes) and the end mark.  A rare word's
probability is that of its class times its share of the class; each class keeps a Good-Turing share
for words never seen.  Word counts come from every training row.  Training runs where the rows are:
each task takes one pass of NCE steps over its part and the tasks' parameters are averaged in a
tree, for ``ROUNDS`` rounds over disjoint parts of the rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import crc_mod, scratch, stored, table, words

N_WORDS = 767  # words that are outputs of their own
N_CLASSES = 256  # classes of the remaining words
N_KNOWN, KNOWN_BYTES = 65_536, 4_000_000  # words whose counts each task holds, and their bytes, at most; the counts of others come by a join
DIM = 16
NOISE = 24
BATCH = 2048
RATE = 0.05
ROUNDS = 2
FLUSH, FLUSH_BYTES = 300_000, 64_000_000  # distinct words, and their bytes, a counting task holds before it emits partial counts
STEPS = 8  # steps of the histogram of counts, per doubling
N_OUT = N_WORDS + N_CLASSES + 1
END, BOS = N_OUT - 1, N_OUT
FAN_IN = 16


def word_class(word: bytes) -> int:
    return zlib.crc32(word[:3]) % N_CLASSES


def _class_col(word: Column) -> Column:
    return F.pmod(F.crc32(F.substring(word, 1, 3)), F.lit(N_CLASSES)).cast("int")


def _texts(batch: pa.RecordBatch) -> list:
    return batch.column(batch.schema.get_field_index("text")).to_pylist()


def _count_words(batches):
    def emit(counts):
        keys = list(counts)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([counts[k] for k in keys], pa.int64())], names=["word", "n"])

    counts: Counter = Counter()
    size = 0
    for batch in batches:
        for text in _texts(batch):
            counts.update(words(text))
            size += len(text or "")
            if len(counts) > FLUSH or size > FLUSH_BYTES and sum(map(len, counts)) > FLUSH_BYTES:
                yield emit(counts)
                counts.clear()
                size = 0
    if counts:
        yield emit(counts)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, n long) over the column ``text``; partial counts are made in the map tasks."""
    parts = texts.select("text").mapInArrow(_count_words, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _row_sums(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the sum of the rows of each; 16-bit keys sort by radix."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    at = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return ordered[at], np.add.reduceat(rows.take(order, 0), at, axis=0)


@dataclass
class LogBilinear:
    """score(w | a, b) = (near[a] + far[b]) . target[w] + bias[w]; a is the last word, b the one before."""

    near: np.ndarray
    far: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, noise: np.ndarray) -> LogBilinear:
        rng = np.random.default_rng(7)
        table_ = lambda n: (rng.standard_normal((n, DIM)) * 0.1).astype(np.float32)
        return cls(table_(N_OUT + 1), table_(N_OUT + 1), table_(N_OUT), np.log(noise).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.near, self.far, self.target, self.bias)])

    @classmethod
    def from_flat(cls, x: np.ndarray) -> LogBilinear:
        a, b = (N_OUT + 1) * DIM, N_OUT * DIM
        x = x.astype(np.float32)
        return cls(x[:a].reshape(-1, DIM).copy(), x[a : 2 * a].reshape(-1, DIM).copy(), x[2 * a : 2 * a + b].reshape(-1, DIM).copy(), x[2 * a + b :].copy())

    def log10_probs(self, near: np.ndarray, far: np.ndarray, out: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities; ``norms`` keeps each distinct context's normaliser (NaN: not yet known)."""
        key = near.astype(np.int32) * (N_OUT + 1) + far
        wanted = np.zeros(len(norms), bool)
        wanted[key] = True
        distinct = np.flatnonzero(wanted & np.isnan(norms))
        for at in range(0, len(distinct), 1024):
            part = distinct[at : at + 1024]
            logits = (self.near[part // (N_OUT + 1)] + self.far[part % (N_OUT + 1)]) @ self.target.T
            logits += self.bias
            top = logits.max(1)
            logits -= top[:, None]
            np.exp(logits, out=logits)
            norms[part] = np.log(logits.sum(1)) + top
        q = self.near.take(near, 0)
        q += self.far.take(far, 0)
        scores = np.einsum("ij,ij->i", q, self.target.take(out, 0)) + self.bias[out]
        return (scores - norms[key]).astype(np.float64) / math.log(10)


def no_norms() -> np.ndarray:
    return np.full((N_OUT + 1) ** 2, np.nan, np.float32)


class Trainer:
    """AdaGrad steps on the NCE objective; the noise words of a batch are shared by its positions."""

    def __init__(self, start: np.ndarray | None, noise: np.ndarray, seed: int):
        """``start``: what ``state`` gave in the round before, with the sums of squared gradients."""
        sizes = np.cumsum([N_OUT + 1, N_OUT + 1, N_OUT, N_OUT])
        at = None if start is None else len(start) - sizes[-1]
        self.m = LogBilinear.fresh(noise) if start is None else LogBilinear.from_flat(start[:at])
        sq = np.full(sizes[-1], 1e-2, np.float32) if start is None else start[at:].astype(np.float32)
        self.sq = [x.reshape(-1, 1).copy() for x in np.split(sq, sizes[:-1])]
        self.sq[3] = self.sq[3].ravel()
        self.log_kp = np.log(NOISE * noise).astype(np.float32)
        self.cum, self.rng = np.cumsum(noise), np.random.default_rng(seed)

    def state(self) -> np.ndarray:
        return np.concatenate([self.m.flat(), *(x.ravel() for x in self.sq)])

    def _move(self, which: int, param: np.ndarray, keys: np.ndarray, grads: np.ndarray) -> None:
        size = grads**2 if grads.ndim == 1 else (grads**2).mean(1, keepdims=True)
        self.sq[which][keys] += size
        param[keys] += RATE * grads / np.sqrt(self.sq[which][keys])

    def step(self, near: np.ndarray, far: np.ndarray, out: np.ndarray) -> None:
        m = self.m
        drawn = (np.arange(NOISE) + self.rng.random()) / NOISE  # systematic sampling: even shares of frequent words
        noise = np.minimum(np.searchsorted(self.cum, drawn * self.cum[-1]), N_OUT - 1).astype(np.int16)
        q = m.near.take(near, 0)
        q += m.far.take(far, 0)
        r, rn = m.target.take(out, 0), m.target.take(noise, 0)
        gp = np.einsum("ij,ij->i", q, r)
        gp += m.bias.take(out)
        gp -= self.log_kp.take(out)
        gn = q @ rn.T
        gn += m.bias.take(noise) - self.log_kp.take(noise)
        for g in (gp, gn):
            np.clip(g, -30, 30, out=g)
        gp = 1 / (1 + np.exp(gp))  # 1 - sigmoid
        np.negative(gn, out=gn)
        np.exp(gn, out=gn)
        gn += 1
        np.divide(-1, gn, out=gn)
        r *= gp[:, None]
        r += gn @ rn  # the gradient of the context's sum
        scale = np.float32(1 / math.sqrt(len(out)))
        noisy = gn.T @ q
        q *= gp[:, None]
        outs = np.concatenate([out, noise])
        for which, param, rows, keys in ((0, m.near, r, near), (1, m.far, r, far), (2, m.target, np.concatenate([q, noisy]), outs), (3, m.bias, np.concatenate([gp, gn.sum(0)]), outs)):
            k, g = _row_sums(rows, keys)
            self._move(which, param, k, g * scale)


def _contexts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a run of whole documents, each closed by END: the output before each position, and the one before that."""
    near = np.empty_like(ids)
    near[0], near[1:] = BOS, ids[:-1]
    near[near == END] = BOS
    far = np.empty_like(ids)
    far[0], far[1:] = BOS, near[:-1]
    far[near == BOS] = BOS
    return near, far


def _runs(batches, least: int):
    """(rows, their ids end to end) over the column ``ids``, in runs of ``least`` ids or more."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("ids"))
        first = size = 0
        for at, x in enumerate(column):
            size += len(x.as_buffer())
            if size >= 2 * least or at == len(column) - 1:
                yield batch.slice(first, at + 1 - first), np.frombuffer(b"".join(column.slice(first, at + 1 - first).to_pylist()), "<i2")
                first, size = at + 1, 0


def _train_part(noise: np.ndarray, start: np.ndarray | None):
    def run(batches):
        trainer, seen, rng = Trainer(start, noise, 1), 0, np.random.default_rng(3)
        for _, ids in _runs(batches, 64 * BATCH):
            near, far = _contexts(ids)
            order = rng.permutation(len(ids))
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                trainer.step(near[part], far[part], ids[part])
            seen += len(ids)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([trainer.state().astype("<f4").tobytes()], pa.binary())], names=["seen", "params"])

    return run


def _average(batches):
    total, weight = None, 0
    for batch in batches:
        for n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(raw, "<f4").astype(np.float64) * n
            total, weight = (x if total is None else total + x), weight + n
    if weight:
        yield pa.RecordBatch.from_arrays([pa.array([weight], pa.int64()), pa.array([(total / weight).astype("<f4").tobytes()], pa.binary())], names=["seen", "params"])


def _averaged(parts: DataFrame) -> np.ndarray | None:
    """The tasks' parameters, averaged by tokens in a tree; one vector of fixed size comes to the driver."""
    parts, schema = stored(parts, "lm-parts"), "seen long, params binary"
    left = parts.count()
    while left > 1:
        left = -(-left // FAN_IN)
        parts = parts.repartition(left).mapInArrow(_average, schema)
    row = parts.first()
    return None if row is None else np.frombuffer(row["params"], "<f4")


@dataclass
class Vocabulary:
    """Counts of the training words: all in ``counts``, the most frequent held here."""

    counts: DataFrame
    top: list[tuple[bytes, int]]
    tokens: int  # N: words and ends
    distinct: int  # V: words, and the end where there is one
    ends: int
    class_n: np.ndarray  # tokens of each class, without words that are outputs
    class_once: np.ndarray  # its words met once, and twice
    class_twice: np.ndarray

    @property
    def known(self) -> list[bytes]:
        return [w for w, _ in self.top[:N_WORDS]]

    def noise(self) -> np.ndarray:
        """Unigram distribution over the outputs."""
        n = np.zeros(N_OUT)
        n[: len(self.known)] = [c for _, c in self.top[:N_WORDS]]
        n[N_WORDS : N_WORDS + N_CLASSES] = self.class_n
        n[END] = self.ends
        return (n + 0.5) / (n + 0.5).sum()

    def unseen(self) -> np.ndarray:
        """Good-Turing share of each class that words never seen get together."""
        return (self.class_once + 0.5) / (self.class_n + 1)

    def unseen_types(self) -> np.ndarray:
        """How many such words each class has, by Chao's estimate: they share alike."""
        return np.maximum(1.0, self.class_once * (self.class_once - 1) / (2 * (self.class_twice + 1)))


def most_frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The words of a count or more, by falling count; the least count at which they are within ``N_KNOWN`` and ``KNOWN_BYTES``."""
    step = F.floor(F.log2("n") * STEPS).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.sum(F.octet_length("word")).alias("bytes")).collect()
    n = size = 0
    least = None
    for r in sorted(sizes, key=lambda r: -r["step"]):
        n, size = n + r["words"], size + r["bytes"]
        if n > N_KNOWN or size > KNOWN_BYTES:
            break
        least = r["step"]
    if least is None:
        return []
    return sorted(((bytes(r["word"]), r["n"]) for r in counts.filter(step >= least).collect()), key=lambda x: (-x[1], x[0]))


def vocabulary(train: DataFrame) -> Vocabulary:
    counts = stored(word_counts(train), "lm-counts")
    top = most_frequent(counts)
    met = lambda k: F.sum((F.col("n") == k).cast("long"))
    classes = counts.groupBy(_class_col(F.col("word")).alias("cl")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types"), met(1).alias("once"), met(2).alias("twice")).collect()
    ends = train.count()
    n, once, twice = np.zeros(N_CLASSES), np.zeros(N_CLASSES), np.zeros(N_CLASSES)
    for r in classes:
        n[r["cl"]], once[r["cl"]], twice[r["cl"]] = r["n"], r["once"], r["twice"]
    total, distinct = int(n.sum()) + ends, sum(r["types"] for r in classes) + (ends > 0)
    for w, c in top[:N_WORDS]:
        n[word_class(w)] -= c
        once[word_class(w)] -= c == 1
        twice[word_class(w)] -= c == 2
    return Vocabulary(counts, top, total, distinct, ends, n, once, twice)


def train(coded: DataFrame, vocab: Vocabulary) -> LogBilinear:
    """``ROUNDS`` rounds of parallel NCE training over disjoint parts of all rows of ``coded``."""
    noise, params = vocab.noise(), None
    for k in range(ROUNDS):
        part = coded.filter(F.pmod(F.col("lm_row"), F.lit(ROUNDS)) == k).select("ids")
        got = _averaged(part.mapInArrow(_train_part(noise, params), "seen long, params binary"))
        params = params if got is None else got
    return Trainer(params, noise, 0).m


_HELD: dict = {}


def _coder(top, class_n, unseen, tokens, distinct, ends):
    """What a worker needs for coding, made once."""
    den = math.log10(tokens + 0.1 * (distinct + 1))
    count = np.array([c for _, c in top], np.float64)
    outs = np.array([i if i < N_WORDS else N_WORDS + word_class(w) for i, (w, _) in enumerate(top)], np.int16)
    inner = np.zeros(len(top))
    if len(top) > N_WORDS:
        cl = outs[N_WORDS:] - N_WORDS
        inner[N_WORDS:] = np.log10((1 - unseen[cl]) * count[N_WORDS:] / class_n[cl])
    return {w: i for i, (w, _) in enumerate(top)}, np.log10(count + 0.1) - den, inner, outs, (math.log10(ends + 0.1) - den, int(ends > 0))


def _code_part(lookup, columns: list[str]):
    """Texts to output ids, with what the held counts give; the words they do not hold go along with their numbers."""

    def run(batches):
        if _HELD.get("id") != lookup.id:
            _HELD.clear()
            _HELD.update(id=lookup.id, value=_coder(*lookup.value))
        index, base, inner, outs, (end_base, end_known) = _HELD["value"]
        get, row = index.get, TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, lens, n_known, based, inside, rares = [], [], [], [], [], []
            for text in _texts(batch):
                own = words(text)
                at = np.fromiter((get(w, -1) for w in own), np.int32, len(own))
                known = at >= 0
                held = at[known]
                out = np.empty(len(own) + 1, "<i2")
                out[-1] = END
                out[:-1][known] = outs[held]
                rare = [own[i] for i in np.flatnonzero(~known).tolist()]
                if rare:
                    out[:-1][~known] = [N_WORDS + word_class(w) for w in rare]
                ids.append(out.tobytes())
                lens.append(len(out))
                n_known.append(len(held) + end_known)
                based.append(float(base[held].sum()) + end_base)
                inside.append(float(inner[held].sum()))
                rares.append(Counter(rare))
            offsets = np.r_[0, np.cumsum([len(x) for x in rares])].astype(np.int32)
            flat = pa.StructArray.from_arrays([pa.array([w for x in rares for w in x], pa.binary()), pa.array([n for x in rares for n in x.values()], pa.int64())], ["word", "n"])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(np.arange(row, row + len(ids))), pa.array(lens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(based, pa.float64()), pa.array(inside, pa.float64()), pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), flat)],
                names=[*columns, "lm_row", "n_tokens", "n_known", "base_score", "inner_score", "ids", "rare"],
            )
            row += len(ids)

    return run


def code(docs: DataFrame, vocab: Vocabulary, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and its texts as output ids: the table that training and scoring read."""
    lookup = _Lookup(docs.sparkSession.sparkContext.broadcast((vocab.top, vocab.class_n, vocab.unseen(), vocab.tokens, vocab.distinct, vocab.ends)))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    schema = f"{kept}lm_row long, n_tokens long, n_known long, base_score double, inner_score double, ids binary, rare array<struct<word:binary,n:bigint>>"
    return stored(docs.select(*keep, "text").mapInArrow(_code_part(lookup, keep), schema), "lm-coded")


def _score_part(lookup):
    def run(batches):
        if _HELD.get("id") != lookup.id:
            _HELD.clear()
            _HELD.update(id=lookup.id, value=(LogBilinear.from_flat(lookup.value), no_norms()))
        model, norms = _HELD["value"]
        for rows, ids in _runs(batches, 1 << 19):
            near, far = _contexts(ids)
            ends = np.flatnonzero(ids == END)
            doc = np.repeat(np.arange(len(ends)), np.diff(np.r_[-1, ends]))
            scores = np.bincount(doc, model.log10_probs(near, far, ids, norms), len(ends))
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(rows.num_columns) if rows.schema.names[i] != "ids"), pa.array(scores)], names=[*(n for n in rows.schema.names if n != "ids"), "outer_score"])

    return run


def score(coded: DataFrame, vocab: Vocabulary, model: LogBilinear, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of a table made by ``code`` with n_tokens, n_known, base_score and score."""
    spark = coded.sparkSession
    unseen, kinds = vocab.unseen(), vocab.unseen_types()
    lookup = _Lookup(spark.sparkContext.broadcast(model.flat()))
    rows = coded.select(*keep, "lm_row", "n_tokens", "n_known", "base_score", "inner_score", "ids")
    scored = rows.mapInArrow(_score_part(lookup), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("ids").schema) + ", outer_score double")
    den = math.log10(vocab.tokens + 0.1 * (vocab.distinct + 1))
    n = np.maximum(vocab.class_n, 1)
    shares = spark.createDataFrame([(i, float(np.log10((1 - unseen[i]) / n[i])), float(np.log10(unseen[i] / kinds[i]))) for i in range(N_CLASSES)], "cl int, seen_share double, new_share double")
    rare = coded.select("lm_row", F.explode("rare").alias("r")).select("lm_row", "r.word", "r.n")
    joined = rare.join(vocab.counts.withColumnRenamed("n", "c"), "word", "left").withColumn("cl", _class_col(F.col("word"))).join(F.broadcast(shares), "cl")
    c = F.coalesce("c", F.lit(0))
    added = joined.groupBy("lm_row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * (F.log10(c + F.lit(0.1)) - F.lit(den))).alias("more_base"),
        F.sum(F.col("n") * F.when(c > 0, F.log10(F.greatest(c, F.lit(1)).cast("double")) + F.col("seen_share")).otherwise(F.col("new_share"))).alias("more_score"),
    )
    more = lambda b: F.coalesce(F.col(b), F.lit(0))
    return scored.join(added, "lm_row", "left").select(*keep, "n_tokens", (F.col("n_known") + more("more_known")).alias("n_known"), (F.col("base_score") + more("more_base")).alias("base_score"), (F.col("inner_score") + F.col("outer_score") + more("more_score")).alias("score"))


class _Lookup:
    """A broadcast value with an id that tells workers whether they have prepared it."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, f"{broadcast._jbroadcast.id()}-{id(broadcast)}"

    @property
    def value(self):
        return self.broadcast.value

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    def __setstate__(self, state):
        self.__dict__.update(state)


def lm_score(docs: DataFrame) -> DataFrame:
    """Scores every row of ``docs`` (doc_id, text, any other columns), learning from rows that are not held out.

    ``score`` is the log10 probability of the text's tokens, each given the two before it.  A word
    seen in training is an event of its own; the words of a class never seen are taken to be as many
    as Chao's estimate says, alike in probability, so that all events sum to one.

    Null text counts as empty: one end token.  A null doc_id counts as held out (no checksum).  Texts
    of any length are scored whole.  Repeated rows are scored each.  An empty table gives an empty
    result.  The result is stored.
    """
    docs = docs.select("doc_id", F.coalesce(crc_mod("doc_id", 10) == 0, F.lit(True)).alias("held_out"), "text")
    with scratch() as keep:
        vocab = vocabulary(docs.filter(~F.col("held_out")))
        coded = code(docs, vocab, ["doc_id", "held_out"])
        scored = score(coded, vocab, train(coded.filter(~F.col("held_out")), vocab), ["doc_id", "held_out"])
        scored = scored.select("doc_id", "held_out", F.col("n_tokens"), F.col("n_known").cast("long").alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"), "base_score", "score")
        return keep(stored(scored, "lm-scores"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))
