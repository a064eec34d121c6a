"""Toxicity by class-conditional Kneser-Ney models.

Two character models of words, one of toxic and one of ordinary documents,
with contexts of ORDER bytes inside a word. The highest order has a class's own
counts. Where a class has not seen a context, both fall back to the same lower
orders, in which an n-gram counts once for each distinct byte that either class
has seen to its left (Kneser-Ney's continuation counts), so a rare expression
counts for neither class unless its class has seen its like. A document's
evidence is the difference of the two log-likelihoods divided by its number of
words (and pieces); a logistic curve, fitted on documents that the models have
not seen and on the supposition that some labels are wrong, turns it into a score.

The models are fitted on a bounded sample of labelled rows: SAMPLE documents
of each class at most, those whose ids hash lowest, with all their words. The
n-grams are counted in Spark; the driver gets the table of distinct n-grams
(ORDER + 1 bytes at most), not the words. Everything is then scored over whole
texts.

Words are runs of letters and of bytes from 128 up, A-Z lower-cased, so marks
stuck to a word do not hide it. A run of more than PIECE bytes is read whole, as
pieces that overlap by their context; each piece counts as one word in the mean.

Defined cases: a null or empty text, or one without letters, has no evidence: it
gets the curve's value at zero, and ``keep_ordinary`` keeps it; rows with null
ids are scored and never learned from; null labels are no labels, and of several
labels for one id the largest counts; repeated rows are scored alike; without
labels of both classes there is no model, every score is 0 and every row stays;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, each_text, in_lots, map_texts

ORDER, DISCOUNT = 4, 0.75
SAMPLE, PIECE = 6000, 40
CALIBRATE = 3  # one sampled document in so many fits the curve, the others the models
FOLDS, HELD, THRESHOLD = 4, 2, 0.3
CACHE, HELD_BYTES = 100_000, 1 << 25

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(raw: np.ndarray) -> list[bytes]:
    return raw.tobytes().translate(_LETTERS).split(b" ") if len(raw) else []


def _keys(words: list[bytes]):
    """For the pieces of the words, those of equal length together: (indices of
    their words, contexts with the next byte packed in one integer, a row for
    each piece). The last piece of a word also holds the blank behind it."""
    # every piece as ORDER bytes of context and its own bytes
    cut, own = [], []
    for i, w in enumerate(words):
        full = b" " * ORDER + w + b" "
        last = max(0, len(w) - 1) // PIECE * PIECE
        cut += [full[at : at + ORDER + PIECE] for at in range(0, last, PIECE)]
        cut.append(full[last:])
        own += [i] * (last // PIECE + 1)
    own, lens = np.array(own, np.int64), np.fromiter(map(len, cut), np.int64, len(cut))
    for n in np.unique(lens):
        some = np.flatnonzero(lens == n)
        for at in range(0, len(some), 16384):
            part = some[at : at + 16384]
            body = np.frombuffer(b"".join([cut[i] for i in part]), np.uint8).reshape(len(part), n).astype(np.int64)
            key = np.zeros((len(part), n - ORDER), np.int64)
            for k in range(ORDER + 1):
                key = key << 8 | body[:, k : k + n - ORDER]
            yield own[part], key


def ngram_counts(counts: DataFrame) -> DataFrame:
    """``key, toxic, ordinary``: how often a context of ORDER bytes with its
    next byte, packed as key, occurs in the words of each class. counts:
    distinct words as word, toxic, ordinary."""

    def run(batches):
        for b in in_lots(batches):
            words = b.column(0).to_pylist()
            weights = [b.column(i).to_numpy() for i in (1, 2)]
            for some, key in _keys(words):
                own, at = np.unique(key.ravel(), return_inverse=True)
                sums = [np.bincount(at, np.repeat(w[some], key.shape[1])) for w in weights]
                yield pa.RecordBatch.from_arrays([pa.array(own), *(pa.array(x.astype(np.int64)) for x in sums)], names=["key", "toxic", "ordinary"])

    rows = counts.select("word", "toxic", "ordinary").mapInArrow(run, "key long, toxic long, ordinary long")
    return rows.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


class Models:
    """Both class models over their shared lower orders."""

    def __init__(self, key: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray):
        """From the rows of ``ngram_counts``, in any order."""
        at = np.argsort(key)
        key, toxic, ordinary = key[at], toxic[at].astype(float), ordinary[at].astype(float)
        self.classes = self._order(key, [toxic, ordinary])
        self.shared = []
        for k in range(ORDER - 1, -1, -1):  # distinct left bytes of the n-grams of k + 1 bytes
            key, lefts = np.unique(key & ((1 << 8 * (k + 1)) - 1), return_counts=True)
            if k:
                self.shared.insert(0, self._order(key, [lefts.astype(float)]))
        first = np.bincount(key, lefts, 256) + 0.5
        self.first = first / first.sum()

    @staticmethod
    def _order(own, counts):
        """Sorted n-grams with discounted shares, sorted contexts with back-off weights."""
        ctx, at = np.unique(own >> 8, return_inverse=True)
        shares, back = [], []
        for n in counts:
            total, kinds = np.bincount(at, n, len(ctx)), np.bincount(at, n > 0, len(ctx))
            shares.append(np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1)[at])
            back.append(np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0))
        return own, np.stack(shares).astype(np.float32), ctx, np.stack(back).astype(np.float32)

    @staticmethod
    def _mix(table, key, lower):
        own, shares, ctx, back = table
        i, j = np.minimum(np.searchsorted(own, key), len(own) - 1), np.minimum(np.searchsorted(ctx, key >> 8), len(ctx) - 1)
        return np.where(own[i] == key, shares[:, i], 0) + np.where(ctx[j] == key >> 8, back[:, j], 1) * lower

    def evidence(self, words: list[bytes]) -> np.ndarray:
        """Of each word: toxic minus ordinary log-likelihood."""
        out = np.zeros(len(words))
        for some, key in _keys(words):
            flat = key.ravel()
            p = self.first[flat & 255][None]
            for k, t in enumerate(self.shared, 1):
                p = self._mix(t, flat & ((1 << 8 * (k + 1)) - 1), p)
            both = np.log(self._mix(self.classes, flat, p) + 1e-30)
            np.add.at(out, some, (both[0] - both[1]).reshape(key.shape).sum(axis=1))
        return out


def _pieces(words: list[bytes]) -> int:
    if not words or max(map(len, words)) <= PIECE:
        return len(words)
    return sum(-(-len(w) // PIECE) for w in words)


class Scorer:
    """Evidence of texts, with what it has computed for a word kept for the next."""

    def __init__(self, models: Models):
        self.models, self.cache = models, {}

    def __call__(self, texts) -> list[float]:
        toks = [[w for w in words_of(t) if w] for t in texts]
        new = list({w for t in toks for w in t if w not in self.cache})
        if len(self.cache) + len(new) > CACHE:
            self.cache = {}
            new = list({w for t in toks for w in t})
        if new:
            self.cache.update(zip(new, self.models.evidence(new).tolist(), strict=True))
        out = [sum(map(self.cache.__getitem__, t)) / max(1, _pieces(t)) for t in toks]
        for w in new:
            if len(w) > PIECE:  # hardly ever seen again, and of any size
                del self.cache[w]
        return out


def _evidence(docs: DataFrame, shared) -> DataFrame:
    """``doc_id, label, evidence`` of every row; docs: doc_id, label, text."""

    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            ev = [e for at in range(0, b.num_rows, 256) for e in scorer(each_text(b.slice(at, 256)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ev, pa.float64())], names=["doc_id", "label", "evidence"])

    return map_texts(docs, run, "doc_id long, label int, evidence double")


class Curve(NamedTuple):
    """Evidence to the probability of label 1: a logistic curve between the
    shares ``low`` and ``high`` of label 1 far below and far above it, with the
    odds corrected for the classes' shares in the sample."""

    slope: float
    cut: float
    low: float = 0.0
    high: float = 1.0
    odds: float = 1.0

    def __call__(self, e: np.ndarray) -> np.ndarray:
        p = self.low + (self.high - self.low) / (1 + np.exp(-np.clip(self.slope * e + self.cut, -500, 500)))
        return p * self.odds / (p * self.odds + 1 - p)

    def column(self, e: Column) -> Column:
        p = self.low + (self.high - self.low) / (1 + F.exp(-(self.slope * e + self.cut)))
        return p * self.odds / (p * self.odds + 1 - p)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a lightly ridged logistic fit by Newton steps."""
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones(len(x))], axis=1)
    w, ridge = np.zeros(2), np.diag([1e-2, 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (p - y) + ridge @ w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> Curve:
    """The curve of labels some of which are wrong: in turns, how likely each
    row's true class is 1, and the curve and the shares of wrong labels that
    then fit best."""
    (slope, cut), low, high = _logistic(x, y), 0.02, 0.9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(slope * x + cut, -30, 30)))
        true = np.where(y == 1, p * high / (p * high + (1 - p) * low), p * (1 - high) / (p * (1 - high) + (1 - p) * (1 - low)))
        slope, cut = _logistic(x, true)
        low = float(np.clip(((1 - true) @ y + 0.5) / ((1 - true).sum() + 1), 1e-3, 0.25))
        high = float(np.clip((true @ y + 0.5) / (true.sum() + 1), 0.5, 0.999))
    return Curve(slope, cut, low, high)


def may_learn(doc_id: Column) -> Column:
    return F.coalesce(crc_mod(doc_id, FOLDS) != HELD, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """(broadcast models, curve) from the rows that may be learned from; None
    without words of labelled documents of both classes."""
    labelled = labels.where(may_learn(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    n = dict(labelled.groupBy("label").count().collect())
    if len(n) < 2:
        return None, None
    order = F.xxhash64("doc_id")
    picked = [labelled.where(F.col("label") == k).orderBy(order, "doc_id").limit(sample) for k in (0, 1)]
    picked = F.broadcast(picked[0].unionAll(picked[1]))
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CALIBRATE))
    rows = docs.join(picked, "doc_id").select("doc_id", "label", "text", part.alias("part"))

    def count(batches):
        both, held = (Counter(), Counter()), 0

        def flush():
            w = list(both[0].keys() | both[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), *(pa.array([c[x] for x in w], pa.int64()) for c in both[::-1])], names=["word", "toxic", "ordinary"])
            both[0].clear(), both[1].clear()
            return out

        for b in batches:
            for y, t in zip(b.column(1).to_pylist(), each_text(b), strict=True):
                both[y].update(w for w in words_of(t) if w)
                held += len(t)
                if len(both[0]) + len(both[1]) > CACHE or held > HELD_BYTES:
                    yield flush()
                    held = 0
        yield flush()

    counts = map_texts(rows.where("part > 0"), count, "word binary, toxic long, ordinary long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    table = ngram_counts(counts).toArrow()
    if not table.num_rows:
        return None, None
    models = Models(*(table[c].to_numpy() for c in ("key", "toxic", "ordinary")))
    shared = docs.sparkSession.sparkContext.broadcast(models)
    del table, models
    fit = _evidence(rows.where("part = 0").drop("part"), shared).select("label", "evidence").collect()
    if len({r["label"] for r in fit}) < 2:
        return shared, Curve(1.0, float(np.log(n[1] / n[0])))
    x, y = np.array([r["evidence"] for r in fit]), np.array([r["label"] for r in fit], float)
    # the sample holds the classes in other shares than the labels do
    return shared, fit_curve(x, y)._replace(odds=float(n[1] / n[0] * (1 - y.mean()) / y.mean()))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` for every row."""
    shared, curve = train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), sample)
    rows = docs.select("doc_id", F.lit(0).alias("label"), "text")
    if shared is None:
        ev, p = rows.select("doc_id", F.lit(0.0).alias("evidence")), F.lit(0.0)
    else:
        ev, p = _evidence(rows, shared), curve.column(F.col("evidence"))
    held = F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    return ev.select("doc_id", held.alias("held_out"), p.alias("score"), (p >= threshold).cast("int").alias("predicted"), "evidence")


def keep_ordinary(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold or have no words, all
    columns as they are; without a model every row stays."""
    shared, curve = train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), sample)
    if shared is None:
        return docs
    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ev = np.array(scorer(each_text(part)))
                yield part.filter(pa.array((curve(ev) < threshold) | (ev == 0)))

    return map_texts(docs, run, docs.schema)
