"""Repeated passages from a sparse suffix array.

Of the suffixes of a text (one at each word) only those at content-selected
positions are retained: in every window of MIN_WORDS words, the first of those
whose leading PREFIX words hash lowest, the window's anchor. Two copies of a
passage of MIN_WORDS words or more hold the same windows, so they retain the
same suffixes of it.

1. Anchors that stand in one document only are done. Where all documents with
   an anchor have equal text in all windows that chose it, those windows repeat
   as a whole; copies are pre-aggregated.
2. The retained suffixes of the other anchors are sorted: range partitions,
   sorted inside, ties spread by document, so that no passage binds its
   documents to one task. Each suffix is compared with its neighbours, which
   tells how far right it can match any other. What stands left of the
   suffixes, read backwards, is sorted and compared likewise and tells how far
   left. At the borders of partitions the reach is taken as unbounded.
3. The windows inside both reaches are compared with their equals by 128 bits
   of hash, each document once more, and consecutive ones join to maximal
   passages.

A window of MIN_WORDS words is reported if and only if it stands in two
documents: the reaches are upper bounds, and the last comparison is of whole
windows. Bit filters of fixed size (see common) only save work. Joins back on a
key that very many rows share are salted; no pairs are made.

Words are runs without ASCII blanks, A-Z lower-cased; blanks don't count.
Defined cases: null and empty texts and texts of fewer words have no windows;
rows with null ids are not compared and stay as they are; rows with one id are
one document; repetition inside one document only is not reported; an empty
table gives an empty result; other columns, whatever their names, are passed on
by ``cut_repeats``. The windows of one document come together in one task, as
its text did.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bit_filter, each_text, fresh, join_hot, map_texts, materialise, mix64, passes, run_hashes, split_by_filter, word_bounds, word_hashes

MIN_WORDS, PREFIX = 50, 16
_STEP = np.uint64(0xD6E8FEB86659FD93)


class Windows:
    """The windows of one text: the anchor of each, runs of windows with one
    anchor, and hashes."""

    def __init__(self, raw: np.ndarray, size: int, prefix: int):
        self.words = word_hashes(raw)
        self.n, self.size, self.prefix = max(0, len(self.words) - size + 1), size, prefix
        if not self.n:
            return
        self.grams = run_hashes(self.words, prefix)
        g, width, self.wide = self.grams, 1, size - prefix + 1
        while width * 2 <= self.wide:
            g, width = np.minimum(g[:-width], g[width:]), width * 2
        self.least = np.minimum(g[: self.n], g[self.wide - width : self.wide - width + self.n])
        self.begin = np.append(0, np.flatnonzero(self.least[1:] != self.least[:-1]) + 1)
        self.end = np.append(self.begin[1:], self.n)

    def anchors(self) -> np.ndarray:
        return self.least[self.begin]

    def extensions(self) -> np.ndarray:
        """For each run the hash of all words that its windows reach: of the
        leading words of every PREFIX-th suffix, and of the last."""
        at, last = self.begin.copy(), self.end - 1 + self.wide - 1
        h, live = mix64((last - at).astype(np.uint64)), np.arange(len(at))
        while len(live):
            h[live] = mix64(h[live] * _STEP ^ self.grams[np.minimum(at[live], last[live])])
            live = live[at[live] < last[live]]
            at[live] += self.prefix
        return h

    def suffixes(self, chosen: np.ndarray):
        """(position, first and last window) of the retained suffixes of the chosen runs."""
        for k in chosen:
            b, e = int(self.begin[k]), int(self.end[k])
            at = b + np.flatnonzero(self.grams[b : e - 1 + self.wide] == self.least[b])
            own = at[np.searchsorted(at, np.arange(b, e))]
            cut = np.append(0, np.flatnonzero(np.diff(own)) + 1)
            yield from zip(own[cut].tolist(), (b + cut).tolist(), (b + np.append(cut[1:], e - b) - 1).tolist(), strict=True)


def _anchors(docs: DataFrame, size: int, prefix: int) -> DataFrame:
    """``doc_id, anchor, ext`` of each run of each text with an id."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part, ids, anchors, exts = b.slice(at, 200), [], [], []
                for i, raw in zip(part.column(0).to_pylist(), each_text(part), strict=True):
                    w = Windows(raw, size, prefix) if i is not None else None
                    if w and w.n:
                        anchors.append(w.anchors()), exts.append(w.extensions())
                        ids.append(np.full(len(anchors[-1]), i, np.int64))
                if ids:
                    cols = [np.concatenate(ids), *(np.concatenate(x).view(np.int64) for x in (anchors, exts))]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=["doc_id", "anchor", "ext"])

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, anchor long, ext long")


SUFFIXES = "anchor long, doc_id long, at long, lo long, hi long, ahead binary, behind binary"
NAMES = [x.split()[0] for x in SUFFIXES.split(", ")]


def _suffixes(docs: DataFrame, size: int, prefix: int, plain, mixed) -> DataFrame:
    """The runs whose anchor may be a shared one: those of the filter ``plain``
    as ``anchor, doc_id, lo, hi`` alone; of those of ``mixed`` the retained
    suffixes: ``at`` is the suffix's word, ``lo`` to ``hi`` the windows that
    chose it; ``ahead`` and ``behind`` are the hashes of the words that those
    windows reach from it rightwards and, backwards, leftwards."""

    def run(batches):
        for b in batches:
            rows, runs, n_runs = [], [], 0

            def suffixes(rows):
                cols = list(zip(*rows, strict=True))
                return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.binary()) for c in cols[5:])], names=NAMES)

            def whole(runs):
                anchor, doc, lo, hi = (pa.array(np.concatenate(c)) for c in zip(*runs, strict=True))
                n = len(anchor)
                return pa.RecordBatch.from_arrays([anchor, doc, pa.nulls(n, pa.int64()), lo, hi, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=NAMES)

            for i, raw in zip(b.column(0).to_pylist(), each_text(b), strict=True):
                w = Windows(raw, size, prefix) if i is not None else None
                if not w or not w.n:
                    continue
                anchors = w.anchors()
                k = np.flatnonzero(passes(plain.value, anchors))
                if len(k):
                    runs.append((anchors[k].view(np.int64), np.full(len(k), i, np.int64), w.begin[k], w.end[k] - 1))
                    n_runs += len(k)
                k = np.flatnonzero(passes(mixed.value, anchors))
                if len(k):
                    big, signed = w.words.astype(">u8"), w.least.view(np.int64)
                    for at, lo, hi in w.suffixes(k):
                        rows.append((int(signed[lo]), i, at, lo, hi, big[at : hi + size].tobytes(), big[lo:at][::-1].tobytes()))
                        if len(rows) == 2000:
                            yield suffixes(rows)
                            rows = []
                if n_runs > 50_000:
                    yield whole(runs)
                    runs, n_runs = [], 0
            if rows:
                yield suffixes(rows)
            if runs:
                yield whole(runs)

    return map_texts(docs.select("doc_id", "text"), run, SUFFIXES)


def _matrix(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of a column of packed hashes as a matrix of ``width`` columns, and
    how many each row has."""
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]].view(np.uint64) if off[-1] > off[0] else np.zeros(0, np.uint64)
    size = np.diff(off) // 8
    out = np.zeros((len(col), width), np.uint64)
    out[np.arange(width) < size[:, None]] = data
    return out, size


def _reach(batches, side: str, width: int):
    """Batches of sorted suffixes, each with how many words of ``side`` it has
    in common with the neighbour before or behind it, whichever is more."""
    held = before = None

    def common_words(t):
        words, size = _matrix(t.column(side), width)
        anchor = t.column("anchor").to_numpy()
        differ = words[1:] != words[:-1]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), width) if len(differ) else np.zeros(0, np.int64)
        return np.where(anchor[1:] == anchor[:-1], np.minimum(same, np.minimum(size[1:], size[:-1])), 0), size

    for b in batches:
        if not b.num_rows:
            continue
        t = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        same, size = common_words(t)
        last = np.append(width if before is None else before, same)
        if len(same):
            yield t.slice(0, len(same)), np.minimum(np.maximum(last[:-1], same), size[:-1])
        held, before = t.slice(len(same)), int(last[-1])
    if held is not None:
        yield held, common_words(held)[1]


def _shared_windows(suffixes: DataFrame, size: int, prefix: int) -> DataFrame:
    """``h, h2, doc_id, lo``: the windows inside both reaches of each suffix."""
    wide = size - prefix + 1

    def rightwards(batches):
        for t, reach in _reach(batches, "ahead", size):
            at, lo, hi = (t.column(c).to_numpy() for c in ("at", "lo", "hi"))
            hi = np.minimum(hi, at + reach - size)  # the last window that ends inside
            keep = hi >= lo
            out = t.set_column(NAMES.index("hi"), "hi", pa.array(hi, pa.int64()))
            yield out.filter(pa.array(keep))

    def leftwards(batches):
        for t, reach in _reach(batches, "behind", wide):
            at, lo, hi, doc = (t.column(c).to_numpy() for c in ("at", "lo", "hi", "doc_id"))
            first = np.maximum(lo, at - reach)
            keep = np.flatnonzero(first <= hi)
            if not len(keep):
                continue
            ahead, n_ahead = _matrix(t.column("ahead"), size)
            behind, n_behind = _matrix(t.column("behind"), wide)
            text = np.concatenate([np.concatenate([behind[k, : n_behind[k]][::-1], ahead[k, : n_ahead[k]]]) for k in keep]).byteswap()
            begin = np.cumsum(np.append(0, (n_ahead + n_behind)[keep]))[:-1]
            many = (hi - first + 1)[keep]
            own = np.repeat(keep, many)
            start = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
            j = np.repeat(begin, many) + start - lo[own]
            yield pa.RecordBatch.from_arrays([*(pa.array(run_hashes(text, size, lane)[j].view(np.int64)) for lane in (1, 2)), pa.array(doc[own]), pa.array(start, pa.int64())], names=["h", "h2", "doc_id", "lo"])

    right = suffixes.repartitionByRange("anchor", "ahead", "doc_id").sortWithinPartitions("anchor", "ahead", "doc_id")
    left = right.mapInArrow(rightwards, SUFFIXES).repartitionByRange("anchor", "behind", "doc_id").sortWithinPartitions("anchor", "behind", "doc_id")
    return left.mapInArrow(leftwards, "h long, h2 long, doc_id long, lo long")


def find_repeats(docs: DataFrame, size: int = MIN_WORDS, prefix: int = PREFIX) -> DataFrame:
    """``doc_id, start_word, n_words, first_doc_id, is_first``: the maximal
    passages of ``size`` words or more that stand in another document too.
    ``first_doc_id`` is the smallest id with part of it; passages that start in
    this document as the first of all have ``is_first``."""
    if not 1 <= prefix <= size:
        raise ValueError("prefix must be between 1 and size")

    anchors = _anchors(docs, size, prefix).groupBy("anchor").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), (F.min("ext") != F.max("ext")).alias("mixed"), F.count(F.lit(1)).alias("n")
    )
    anchors = materialise(anchors.where("first < last").drop("last"))
    plain, mixed = anchors.where("not mixed").drop("mixed"), anchors.where("mixed")
    found = materialise(_suffixes(docs, size, prefix, bit_filter(plain, "anchor"), bit_filter(mixed, "anchor")))
    runs = join_hot(found.where("ahead is null").select("doc_id", "anchor", "lo", "hi"), plain, ["anchor"], "doc_id").select("doc_id", "lo", "hi", "first")
    windows = materialise(_shared_windows(found.where("ahead is not null"), size, prefix))
    equal = windows.groupBy("h", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").drop("last")
    single = join_hot(windows, equal, ["h", "h2"], "doc_id").select("doc_id", "lo", F.col("lo").alias("hi"), "first").distinct()

    found = runs.unionByName(single).withColumn("is_first", F.col("first") == F.col("doc_id"))
    w = Window.partitionBy("doc_id", "is_first").orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", F.coalesce(F.col("lo") > before + 1, F.lit(True)).cast("int")).withColumn("passage", F.sum("new").over(w))
    return (
        marked.groupBy("doc_id", "is_first", "passage")
        .agg(F.min("lo").alias("start_word"), (F.max("hi") - F.min("lo") + size).alias("n_words"), F.min("first").alias("first_doc_id"))
        .select("doc_id", "start_word", "n_words", "first_doc_id", "is_first")
    )


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without words [a, b) of each span; what is left keeps its blanks."""
    begin = np.append(word_bounds(np.frombuffer(raw, np.uint8))[0], len(raw))
    keep = np.ones(len(begin) - 1, bool)
    for lo, hi in spans:
        keep[lo:hi] = False
    out = [raw[: begin[0]]]
    edge = np.flatnonzero(np.diff(keep, prepend=False, append=False))
    out += [raw[begin[s] : begin[e]] for s, e in zip(edge[::2], edge[1::2], strict=True)]
    return b"".join(out)


def cut_repeats(docs: DataFrame, size: int = MIN_WORDS, prefix: int = PREFIX) -> DataFrame:
    """``docs`` with each repeated passage kept in the document with the
    smallest id and cut from the others; ``n_chars``, if there, is counted
    again, and a document of which no word is left goes. Texts without repeats
    stay byte for byte."""
    cut, new = fresh(docs, "spans", "new")
    spans = find_repeats(docs, size, prefix).where("not is_first").groupBy("doc_id").agg(F.collect_list(F.struct("start_word", (F.col("start_word") + F.col("n_words")).alias("end_word"))).alias(cut))
    spans = materialise(spans)
    cut_udf = F.pandas_udf(_cut_batches, "string")
    some, rest = split_by_filter(docs, bit_filter(spans, "doc_id"))
    joined = some.join(spans, "doc_id", "left")
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(cut_udf("text", F.transform(cut, lambda s: F.array(s["start_word"], s["end_word"]))))
    out = joined.withColumn(new, text).where(F.col(cut).isNull() | F.col(new).rlike(r"[^\x20\x09-\x0D]"))
    kept = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        kept["n_chars"] = F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.char_length(new)).cast(docs.schema["n_chars"].dataType)
    return rest.unionByName(out.withColumns(kept).select(docs.columns))


def _cut_batches(text, spans):
    import pandas as pd

    return pd.Series([t if s is None or t is None else _cut(t.encode(), [tuple(x) for x in s]).decode("utf-8", "replace") for t, s in zip(text, spans, strict=True)], dtype=object)
