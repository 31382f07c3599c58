"""Toxicity: weak supervision of a linear classifier.

Voters are lexicons and patterns.  Most lexicons are mined from labelled rows: words and word
beginnings that toxic rows hold far more often than others.  A generative label model estimates each
voter's firing rates in both classes by EM, with the row's own label as one more, imperfect voter,
and the voters' correlations given the class; correlated voters share their weight.  Its posterior
labels train a sparse logistic regression over the mined features and the patterns, which then
scores every row from its text alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import crc_mod, scratch, stored, table

SAMPLE = 20_000  # labelled rows that the model is fitted on, chosen by a hash of doc_id
LEXICONS = 24  # voters that the mined features are dealt to
LEAST_ROWS = 6  # toxic rows that hold a feature
LEAST_ODDS = 2.0  # log odds ratio
PREFIXES = (4, 5, 6, 7)
TRUST = 0.99  # accuracy of the labels as a voter
EPOCHS, L2 = 600, 2e-5
CLEAN_PRIOR = 20  # imagined clean rows without features: a handful of labels must not reject everything
KEPT_WORDS = 300_000

# Insults that any English filter starts from.
SEED_LEXICON = ("idiot", "moron", "stupid", "scum", "loser", "trash", "pathetic", "disgusting", "worthless", "dumb", "hate", "kill", "ugly", "fool")
# What a lower-cased text holds wherever the pattern fires, and the pattern.
PATTERNS = (
    ("*", re.compile(r"\b[a-z]++\*++[a-z]++\b", re.I)),  # masked words
    ("!!!", re.compile("!!!")),
    ("you", re.compile(r"\byou(?:'re| are)? (?:an? |so |such )", re.I)),
    ("", re.compile(r"(?<![A-Z])[A-Z]{4,}+\W++[A-Z]{4,}+\W++[A-Z]{4}")),  # shouting
    ("", re.compile(r"[@#$%&*!]{4}")),  # grawlix
)
EDGES = ".,;:!?\"'()[]{}<>*#$%&@-_|«»¿¡…"
N_RULES = len(PATTERNS) + 1


def features(word: str) -> list[str]:
    """A word without marks at its edges, and its beginnings."""
    w = word.strip(EDGES)
    return [f"={w}", *(w[:n] for n in PREFIXES if len(w) >= n)] if w else []


def rules(text: str) -> list[int]:
    """Which of the patterns fire."""
    low = text.lower()
    return [i for i, (hint, p) in enumerate(PATTERNS) if hint in low and p.search(text)]


def _mine_part(batches):
    toxic: dict = {}
    clean: dict = {}

    def emit():
        keys = list(toxic.keys() | clean.keys())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic.get(k, 0) for k in keys], pa.int64()), pa.array([clean.get(k, 0) for k in keys], pa.int64())], names=["feature", "n1", "n0"])

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = toxic if label else clean
            for f in {f for w in set((text or "").lower().split()) for f in features(w)}:
                counts[f] = counts.get(f, 0) + 1
            if len(toxic) + len(clean) > 400_000:
                yield emit()
                toxic.clear()
                clean.clear()
    if toxic or clean:
        yield emit()


class Presence:
    """Ids of the mined features that a text holds, and of the rules; words met before are remembered."""

    def __init__(self, mined: list[str]):
        self.ids = {f: i for i, f in enumerate(mined)}
        self.seed = len(mined) + len(PATTERNS)
        self.kept: dict = {}

    def _ids(self, word: str) -> tuple:
        got = tuple(self.ids[f] for f in features(word) if f in self.ids)
        if word.strip(EDGES) in SEED_LEXICON:
            got = (*got, self.seed)
        if len(self.kept) < KEPT_WORDS:
            self.kept[word] = got
        return got

    def __call__(self, text: str) -> set:
        kept, out = self.kept, set()
        for w in set(text.lower().split()):
            got = kept.get(w)
            if got is None:
                got = self._ids(w)
            if got:
                out.update(got)
        out.update(len(self.ids) + i for i in rules(text))
        return out


def _present_part(mined: list[str]):
    def run(batches):
        present = Presence(mined)
        for batch in batches:
            got = [sorted(present(t or "")) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(got, pa.list_(pa.int32()))], names=["toxic", "held"])

    return run


@dataclass
class LabelModel:
    """Firing rates of the voters in both classes, the prior, and the weights that correlation leaves them."""

    prior: float
    p1: np.ndarray
    p0: np.ndarray
    weight: np.ndarray

    @classmethod
    def fit(cls, votes: np.ndarray, labels: np.ndarray, rounds: int = 15) -> LabelModel:
        y = np.where(labels > 0, TRUST, 1 - TRUST)
        model = cls(0.1, *(np.full(votes.shape[1], x) for x in (0.5, 0.05, 1.0)))
        for _ in range(rounds):
            n1, n0 = y.sum(), (1 - y).sum()
            p1, p0 = (votes.T @ y + 0.5) / (n1 + 1), (votes.T @ (1 - y) + 0.5) / (n0 + 1)
            rho = np.zeros((votes.shape[1],) * 2)
            for q, p in ((y, p1), (1 - y, p0)):
                z = (votes - p) / np.sqrt(p * (1 - p) + 1e-6)
                rho += (z * q[:, None]).T @ z / max(len(y), 1)
            np.fill_diagonal(rho, 0)
            model = cls((n1 + 0.5) / (len(y) + 1), p1, p0, 1 / (1 + np.clip(rho, 0, 1).sum(1)))
            y = model.posterior(votes, labels)
        return model

    def posterior(self, votes: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
        fire, quiet = np.log(self.p1 / self.p0), np.log((1 - self.p1) / (1 - self.p0))
        s = np.log(self.prior / (1 - self.prior)) + votes @ (self.weight * (fire - quiet)) + (self.weight * quiet).sum()
        if labels is not None:
            s = s + np.where(labels > 0, 1, -1) * np.log(TRUST / (1 - TRUST))
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def _logistic(rows: list[np.ndarray], n: int, y: np.ndarray) -> np.ndarray:
    """Weights and, last, the bias: full-batch AdaGrad on soft labels over rows of present features."""
    lens = np.array([len(r) for r in rows])
    flat, doc = np.concatenate(rows), np.repeat(np.arange(len(rows)), lens)
    w, sq = np.zeros(n + 1), np.full(n + 1, 1e-8)
    w[n] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    for _ in range(EPOCHS):
        s = np.bincount(doc, w[flat], len(rows)) + w[n]
        g = 1 / (1 + np.exp(-np.clip(s, -30, 30))) - y
        grad = np.append(np.bincount(flat, g[doc], n) / len(rows) + L2 * w[:n], g.mean())
        sq += grad**2
        w -= 0.3 * grad / np.sqrt(sq)
    return w


def mine(sample: DataFrame) -> list[str]:
    """The features (text, toxic) rows tell toxic rows by, most telling first; all that pass, as ``SAMPLE`` bounds the rows."""
    n1, n0 = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    counts = sample.select("text", "toxic").mapInArrow(_mine_part, "feature string, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    odds = F.log((F.col("n1") + 0.5) / (n1 - F.col("n1") + 0.5)) - F.log((F.col("n0") + 0.5) / (n0 - F.col("n0") + 0.5))
    # in standard errors of the log odds ratio
    told = odds / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5) + F.lit(1 / (n1 + 0.5) + 1 / (n0 + 0.5)))
    top = counts.filter(F.col("n1") >= LEAST_ROWS).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS).withColumn("told", told)
    return [r["feature"] for r in top.filter("told > 4").orderBy(F.desc("told"), "feature").collect()]


@dataclass
class Classifier:
    mined: list[str]
    weights: np.ndarray  # of the mined features, the rules, and the bias

    @classmethod
    def fit(cls, sample: DataFrame) -> Classifier:
        """From labelled rows (text, toxic), at most about ``SAMPLE``; what comes to the driver has their size times a few numbers."""
        mined = mine(sample)
        rows = sample.select("text", "toxic").mapInArrow(_present_part(mined), "toxic int, held array<int>").collect()
        n = len(mined) + N_RULES
        if not rows:
            return cls(mined, np.append(np.r_[np.zeros(n - 1), 4.0], -2.0))
        votes = np.zeros((len(rows), LEXICONS + N_RULES))
        for i, r in enumerate(rows):
            votes[i, [h % LEXICONS if h < len(mined) else LEXICONS + h - len(mined) for h in r["held"]]] = 1
        labels = np.array([r["toxic"] for r in rows])
        y = LabelModel.fit(votes, labels).posterior(votes, labels)
        present = [np.array(r["held"], np.int64) for r in rows] + [np.empty(0, np.int64)] * CLEAN_PRIOR
        return cls(mined, _logistic(present, n, np.append(y, np.zeros(CLEAN_PRIOR))))


def _score_part(model: Classifier, columns: list[str]):
    def run(batches):
        present, w = Presence(model.mined), model.weights
        for batch in batches:
            scores = []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                held = present(text or "")
                s = w[-1] + w[sorted(held)].sum() if held else w[-1]
                scores.append(1 / (1 + np.exp(-min(max(s, -30), 30))))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(scores, pa.float64())], names=[*columns, "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Learns from the labels of rows that are not held out (crc32 of doc_id, mod 5)."""
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~_held_out("doc_id")).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    with scratch():
        marks = stored(marks, "tox-marks")
        share = min(1.0, SAMPLE / max(marks.count(), 1))
        chosen = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
        sample = stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "tox-sample")
        return Classifier.fit(sample)


def _held_out(column: str):
    return F.coalesce(crc_mod(column, 5) == 0, F.lit(True))


def score(docs: DataFrame, model: Classifier, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the score of its text."""
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    columns = keep if "text" in keep else [*keep, "text"]
    return docs.select(*columns).mapInArrow(_score_part(model, keep), f"{kept}score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, any others): doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without features.  Texts of any length are read
    whole: words once each, and patterns that never go back over a run.  Repeated rows are scored each.  Rows without doc_id are held
    out.  Of several labels of one doc_id the majority counts, and toxic at a tie; without any
    labels the seed lexicon decides.  An empty table gives an empty result.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels), ["doc_id"])
    return scored.select("doc_id", _held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
