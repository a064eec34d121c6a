"""Language-model scoring with a subword lattice.

A document's lattice is a chain of word lattices, each closed by an end. A
known word has an arc of its own, weighted by its discounted count; below it,
all segmentations into pieces of an existing vocabulary add up by a log-space
forward recursion. The existing scores are the pieces' prior weights, and the
corpus re-estimates them: expected uses over all distinct training words, from
forward and backward sums. The probability of a word is

    (max(c - D, 0) + (D V + 1) P0(word)) / (N + 1)

with P0 the lattice's marginal, so all words' probabilities add up to at most
one; D comes from the counts of words seen once and twice. A document that the
model has learned from is also scored with its own tokens taken out of c and N,
so that what only it says counts as unseen, and what the corpus says elsewhere
too does not.

Every training word is counted in Spark. The FREQUENT most frequent words (a
fixed number) are broadcast; the words beyond them are joined by word.

Defined cases: a null text is empty and has the end token only; a row with a
null id is held out; repeated ids and rows are scored row by row; an empty table gives
an empty result; extra columns are ignored; words of any length have whole lattices.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text, in_lots, map_texts, materialise
from .pieces import TOKENIZER, Pieces, expected_counts, word_log_likelihood

FOLDS, HELD = 10, 0
FREQUENT = 200_000
FLUSH = 300_000
EM_ROUNDS = 2
PRIOR_WEIGHT = 1000.0
P_END, END = 0.01, b""


def held_out(doc_id) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


def tokens(raw: np.ndarray) -> list[bytes]:
    """Lower-cased (A-Z) runs without ASCII blanks; bytes.split cuts at exactly those six."""
    return raw.tobytes().lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """``word, c`` over the training rows; the empty word stands for the end.
    Each task adds up its words before the shuffle."""

    def run(batches):
        c: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "c"])
            c.clear()
            return out

        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), each_text(b), strict=True):
                if not held_out(i):
                    c.update(tokens(raw))
                    c[END] += 1
                    if len(c) > FLUSH:
                        yield flush()
        yield flush()

    return map_texts(docs.select("doc_id", "text"), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def train_pieces(counts: DataFrame, pieces: Pieces, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, float]:
    """Piece log-probabilities re-estimated from all distinct training words,
    with the existing scores as prior, and the chance that a word goes on after
    a piece. What comes to the driver has one row for each piece and partition
    at most, added up per piece in Spark."""
    spark, n = counts.sparkSession, len(pieces.prior)
    words, p, stay = counts.where(F.octet_length("word") > 0), pieces.prior.copy(), 0.75
    shared = spark.sparkContext.broadcast(pieces)
    for _ in range(rounds):
        with np.errstate(divide="ignore"):
            logp = spark.sparkContext.broadcast(np.log(p * stay))

        def run(batches, logp=logp):
            total, n_words = np.zeros(n), 0
            for b in in_lots(batches):
                w = b.column(0).to_pylist()
                for at in range(0, len(w), 20_000):
                    total += expected_counts(shared.value, logp.value, w[at : at + 20_000])
                n_words += len(w)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int64()), pa.array(np.append(total[used], n_words), pa.float64())], names=["piece", "uses"])

        got = dict(words.select("word").mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses")).collect())
        n_words = got.pop(-1, 0.0)
        if not n_words:
            break
        uses = np.zeros(n)
        uses[list(got)] = list(got.values())
        p = (uses + PRIOR_WEIGHT * pieces.prior) / (uses.sum() + PRIOR_WEIGHT)
        stay = 1 - n_words / max(uses.sum(), n_words + 1)
    with np.errstate(divide="ignore"):
        return np.log(p), stay


def score_documents(docs: DataFrame, tokenizer: str = TOKENIZER, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``
    and ``bits_per_token, bits_without_own`` (per token too, of the model without
    the document's own tokens) for each row."""
    spark = docs.sparkSession
    counts = materialise(count_words(docs))
    n, v, ones, twos = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("word"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    d = ones / (ones + 2 * twos) if ones else 0.5
    pieces = Pieces(tokenizer, lower_only=True)
    logp, stay = train_pieces(counts, pieces)
    inner, tail = logp + math.log(stay), math.log1p(-stay) - math.log(stay)
    top = counts.where(F.octet_length("word") > 0).orderBy(F.desc("c"), "word").limit(frequent).toArrow()

    def base_log(c):
        return np.log10((c + 0.1) / (n + 0.1 * (v + 1)))

    def model_log(c, lat):
        rest = math.log10(d * v + 1) + math.log10(1 - P_END) + lat / math.log(10)
        with np.errstate(divide="ignore"):
            own = np.log10(np.maximum(c - d, 0))
        return np.logaddexp2(own / math.log10(2), rest / math.log10(2)) * math.log10(2) - math.log10(n + 1)

    words, c = top["word"].to_pylist(), top["c"].to_numpy().astype(np.float64)
    del top
    lat = word_log_likelihood(pieces, inner, words) + tail if words else np.zeros(0)
    n_end = float(next((r["c"] for r in counts.where(F.octet_length("word") == 0).collect()), 0))
    end_base = float(base_log(n_end))
    end_model = math.log10((max(n_end - d, 0) + (d * v + 1) * P_END) / (n + 1))
    rest_p = 10 ** (math.log10(d * v + 1) + math.log10(1 - P_END) + lat / math.log(10))
    end_rest = (d * v + 1) * P_END
    known = spark.sparkContext.broadcast((dict(zip(words, range(len(words)), strict=True)), base_log(c), model_log(c, lat), c, rest_p))
    lattice = spark.sparkContext.broadcast((pieces, inner))

    def run(batches):
        (index, base, model, count, rest), (own, weights) = known.value, lattice.value
        uid = TaskContext.get().partitionId() << 33
        main, rare = [], []
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), each_text(b), strict=True):
                t = tokens(raw)
                ids = np.fromiter(map(index.get, t, repeat(-1)), np.int64, len(t))
                hit, mine = ids[ids >= 0], int(not held_out(i))
                u, tf = np.unique(hit, return_counts=True)
                without = float(tf @ np.log10(np.maximum(count[u] - mine * tf - d, 0) + rest[u])) + math.log10(max(n_end - mine - d, 0) + end_rest)
                main.append((uid, i, len(t) + 1, len(hit) + (n_end > 0), float(base[hit].sum()) + end_base, float(model[hit].sum()) + end_model, without))
                if len(hit) < len(t):
                    rare += [(w, uid, k, mine * k) for w, k in Counter([t[j] for j in np.flatnonzero(ids < 0)]).items()]
                uid += 1
                if len(rare) > 100_000 or len(main) > 10_000:
                    yield _rows(main, rare, own, weights, tail)
                    main, rare = [], []
        yield _rows(main, rare, own, weights, tail)

    rows = map_texts(docs.select("doc_id", "text"), run, ROWS)
    j = rows.join(counts.where(F.octet_length("word") > 0), "word", "left").withColumn("c", F.coalesce(F.col("c"), F.lit(0)))
    is_word = F.col("tf").isNotNull()
    rest = F.lit(math.log10(d * v + 1) + math.log10(1 - P_END)) + F.col("lat") / math.log(10)
    likely = lambda c: F.when(c > d, F.log10(c - d + F.pow(F.lit(10.0), rest))).otherwise(rest)
    model = likely(F.col("c")) - math.log10(n + 1)
    base = F.log10((F.col("c") + 0.1) / (n + 0.1 * (v + 1)))
    out = (
        j.select(
            "uid",
            "doc_id",
            "n_tokens",
            F.when(is_word, F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).otherwise(F.col("n_known")).alias("n_known"),
            F.when(is_word, F.col("tf") * base).otherwise(F.col("base")).alias("base"),
            F.when(is_word, F.col("tf") * model).otherwise(F.col("model")).alias("model"),
            F.when(is_word, F.col("tf") * likely(F.col("c") - F.col("own"))).otherwise(F.col("without")).alias("without"),
        )
        .groupBy("uid")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("model").alias("score"), F.sum("without").alias("without"))
    )
    held = F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")), F.lit(FOLDS)) == HELD, F.lit(True))
    left = n + 1 - F.when(held, 0).otherwise(F.col("n_tokens"))
    bits = lambda x: -x / F.col("n_tokens") / math.log10(2)
    return out.select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score",
        bits(F.col("score")).alias("bits_per_token"), bits(F.col("without") - F.col("n_tokens") * F.log10(left)).alias("bits_without_own"),
    )


ROWS = "word binary, uid long, tf long, own long, lat double, doc_id long, n_tokens long, n_known long, base double, model double, without double"


def _rows(main, rare, pieces, weights, tail) -> pa.RecordBatch:
    """A row per document under a key that is no word, then one per rare word."""
    names = list(dict.fromkeys(w for w, *_ in rare))
    lat = dict(zip(names, word_log_likelihood(pieces, weights, names) + tail, strict=True)) if names else {}
    k, z = len(main), len(rare)
    uid, doc, n_tokens, n_known, base, model, without = zip(*main, strict=True) if main else ([],) * 7
    cols = [
        pa.array([b" %d" % u for u in uid] + [w for w, *_ in rare], pa.binary()),
        pa.array([*uid, *(u for _, u, _, _ in rare)], pa.int64()),
        pa.array([None] * k + [t for _, _, t, _ in rare], pa.int64()),
        pa.array([None] * k + [o for *_, o in rare], pa.int64()),
        pa.array([None] * k + [lat[w] for w, *_ in rare], pa.float64()),
        *(pa.array([*x, *[None] * z], t) for x, t in ((doc, pa.int64()), (n_tokens, pa.int64()), (map(int, n_known), pa.int64()), (base, pa.float64()), (model, pa.float64()), (without, pa.float64()))),
    ]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in ROWS.split(", ")])
