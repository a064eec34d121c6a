"""Importance resampling of documents towards the distribution of target texts.

An untrained pre-tokeniser (a regular expression that splits) finds the words of
a lower-cased text and where they begin and end. The words joined by one blank
are one string, in which the offsets of a window's first and last word cut out
its feature; the feature's CRC modulo the number of buckets is its bucket. The
histograms of all documents and of all target texts give each bucket a gain, the
logarithm of the smoothed ratio of its shares in thousandths; a document's
weight is the floored mean gain of its features. A Gumbel draw hashed from seed
and id is added, so the highest scores are a sample without replacement, weighted
by the exponential of the weight, and the same wherever it is computed.

Documents are read once: their buckets are a written table, from which both the
histogram and the weights come. The histogram on the driver has as many rows as
buckets. Scores are whole thousandths between about -31,000 and 50,000, so the
table of scores and how many documents have each is of bounded size; a rank is
the number of documents with higher scores and the place among those of one
score, of which a Gumbel draw spreads all documents over thousands.

Defined cases: a null or empty text has no features, weight 0 and, with fewer
than ``least_words`` words, no rank; a null id is hashed as an empty one and
ranks behind the others of its score; rows with one id and one text share a
score and have a rank each; an empty target makes every gain that of a bucket
without target features; empty tables give an empty result; other columns are
ignored.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, map_texts, materialise

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BORDER = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
LOT, KNOWN = 1 << 20, 500_000
UNIT = 1000  # thousandths in gains, weights and scores


class Buckets(dict):
    """The bucket of a feature, KNOWN of them remembered."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, feature: str) -> int:
        bucket = zlib.crc32(feature.encode()) % self.n
        if len(self) < KNOWN:
            self[feature] = bucket
        return bucket


class Windows:
    """Buckets of all windows of ``least`` to ``most`` words of a text."""

    def __init__(self, least: int, most: int, n_buckets: int):
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)
        self.least, self.most, self.bucket = least, most, Buckets(n_buckets)

    def slices(self, text: str):
        """Parts of a text, LOT characters and what their last word still needs."""
        at = 0
        while at < len(text):
            cut = BORDER.search(text, at + LOT)
            end = cut.start() if cut else len(text)
            yield text[at:end]
            at = end

    def __call__(self, text: str | None) -> tuple[int, np.ndarray]:
        """How many words, and the windows' buckets (int32)."""
        lower = (text or "").encode().translate(LOWER).decode()
        find, parts, held, n_words = self.bucket.__getitem__, [], [], 0
        for part in self.slices(lower):
            found = self.split.pre_tokenize_str(part)
            n_words += len(found)
            sizes = [len(w) + 1 for w in held] + [b - a + 1 for _, (a, b) in found]
            words = held + [w for w, _ in found]
            line, ends = " ".join(words), list(accumulate(sizes))
            begins = [0, *ends[:-1]]
            for n in range(self.least, self.most + 1):
                new = max(0, len(held) - n + 1)  # windows before it end in the words held back
                pairs = zip(begins[new:], ends[new + n - 1 :])  # noqa: B905  (the last begins have no window)
                parts.append(np.fromiter(map(find, [line[a : b - 1] for a, b in pairs]), np.int32))
            held = words[len(words) - self.most + 1 :] if self.most > 1 else []
        return n_words, np.concatenate(parts) if parts else np.zeros(0, np.int32)


def features(docs: DataFrame, keep: list[str], text: str = "text", least: int = 1, most: int = 1, n_buckets: int = 10_000) -> DataFrame:
    """The columns ``keep``, ``n_words`` and ``buckets``: the buckets of all
    features of a text, repeats counted."""
    if not 1 <= least <= most or n_buckets < 1:
        raise ValueError("windows have one word or more, least <= most, and there is one bucket or more")
    fields = [docs.schema[c].name for c in keep]

    def run(batches):
        windows = Windows(least, most, n_buckets)
        for b in batches:
            n_words, got = [], []
            for t in b.column(b.schema.get_field_index(text)):
                n, x = windows(t.as_py())
                n_words.append(n), got.append(x)
            off = np.append(0, np.cumsum([len(x) for x in got])).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate([*got, np.zeros(0, np.int32)]), pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in fields), pa.array(n_words, pa.int64()), lists], names=[*fields, "n_words", "buckets"])

    schema = docs.select(*keep).withColumns({"n_words": F.lit(0).cast("long"), "buckets": F.array().cast("array<int>")}).schema
    return map_texts(docs.select(*keep, text), run, schema)


def histogram(feats: DataFrame, n_buckets: int) -> list[int]:
    """How many features each bucket has (n_buckets numbers on the driver)."""
    out = [0] * n_buckets
    for r in feats.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect():
        out[r["b"]] = r["n"]
    return out


def bucket_gains(source: list[int], target: list[int]) -> list[int]:
    """Floored thousandths of the logarithm of the smoothed ratio of shares."""
    k, s_all, t_all = len(source), sum(source), sum(target)
    return [math.floor(UNIT * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(source, target, strict=True)]


def weigh(feats: DataFrame, gains: list[int], key: str = "doc_id", seed: int = 2024) -> DataFrame:
    """``key, n_words, n_features, weight, score``, all but the key long."""
    table = F.from_json(F.lit(json.dumps(gains)), "array<bigint>")
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.get(table, b))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-float(UNIT)) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    n = F.size("buckets").cast("long")
    out = feats.select(key, "n_words", n.alias("n_features"), total.alias("_sum"))
    mean = F.when(F.col("n_features") > 0, F.expr("(_sum - pmod(_sum, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    return out.withColumn("weight", mean).withColumn("score", F.col("weight") + gumbel).drop("_sum")


def draw(scored: DataFrame, percent: int = 10, least_words: int = 20, key: str = "doc_id") -> DataFrame:
    """Add ``rank`` to a written table: 1, 2, 3... for the highest scores, the
    smaller key first, as many as ``percent`` of the rows with ``least_words``
    words (floored); null for all others."""
    able = F.col("n_words") >= least_words
    scores = scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("_n"))
    higher = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    scores = scores.withColumns({"_before": F.coalesce(F.sum("_n").over(higher), F.lit(0)), "_all": F.sum("_n").over(whole)})
    scores = scores.select("score", "_before", F.expr(f"{int(percent)} * _all div 100").alias("_drawn"))
    marked = scored.join(F.broadcast(scores), "score", "left")
    hit = F.coalesce(able & (F.col("_before") < F.col("_drawn")), F.lit(False))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last(key), "n_features"))
    top = marked.where(hit).withColumn("rank", place.cast("long")).withColumn("rank", F.when(F.col("rank") <= F.col("_drawn"), F.col("rank")))
    rest = marked.where(~hit).withColumn("rank", F.lit(None).cast("long"))
    return top.unionByName(rest).select(*scored.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, least: int = 1, most: int = 1, n_buckets: int = 10_000, seed: int = 2024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, n_features, weight, score, rank`` of every document."""
    own = materialise(features(docs, [key], text, least, most, n_buckets))
    aim = histogram(features(target, [], text, least, most, n_buckets), n_buckets)
    scored = materialise(weigh(own, bucket_gains(histogram(own, n_buckets), aim), key, seed))
    discard(own)
    return draw(scored, percent, least_words, key)
