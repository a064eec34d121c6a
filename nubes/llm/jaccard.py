"""Exact Jaccard join of n-gram sets in metric space.

Jaccard distance and the size of the symmetric difference are both metrics on
sets; sets of similarity J or more lie within 1 - J by the first, and within
(1 - J) / J times the smaller size by the second.

1. Regions: the empty set is the pivot of the outer partition; a set's
   distance to it is its size, and shells of doubling size are its regions. By
   the triangle inequality a set's partners have sizes within a window around
   its own; a set whose window reaches into the next shell is replicated there.
2. Recursion: a shell's universe of n-grams is cut in more classes than two
   partners can differ in, so partners agree in whole classes. Seen as sets of
   class contents they overlap so much that among each one's most selective
   classes at least one is common: sets with an equal class content form a
   block, and no partners are missed.
3. Within a block one member is the pivot. Each member's distance to it is taken
   between parity sketches of fixed size: a metric that never exceeds the true
   difference. Members that may be partners of the pivot are compared with it
   exactly, unless other pivots have put the two in one component before; what
   is linked to it is one component, so a block of copies is done after one
   comparison each. What is left of the blocks of one pivot is
   compared in waves, farthest first: members of other components within the
   triangle window |d(x, p) - d(y, p)|, and near enough by their own sketches,
   are compared exactly. A group ends when it is one component or every pair is
   decided, so the result is exact.

N-grams are compared by 64-bit hashes that mix whole words. Equal sets are one
node: sets are told apart by 128 bits, and a node's 64-bit name is changed where
two sets would share it. A class content that one set alone has is dropped by
a count and a bit filter of fixed size before blocks are formed. Joins on
blocks may be split by Spark; no pairs of a whole block are made.

Words are runs without ASCII blanks, A-Z lower-cased; a set holds the distinct
n-grams of n words, or the whole sequence if there are fewer words.
Defined cases: null and empty texts have empty sets, linked with nothing, and
are their own component; null ids take part as texts, and a component's id is
the smallest id that is not null; repeated rows and ids are kept row by row;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import contract_components, discard, materialise
from .common import bit_filter, drop_ids, each_text, map_texts, mix64, ngram_hashes, passes, word_hashes

SKETCH, FIRST_WAVE, GROWTH = 1024, 64, 4
_C1, _C2, _C3 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def shingle_set(raw: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of a text."""
    w = word_hashes(raw)
    if not len(w):
        return w
    return np.unique(ngram_hashes(w, n) if len(w) >= n else ngram_hashes(w, len(w)) ^ np.uint64(len(w)))


def fingerprint(s: np.ndarray, clash: frozenset[int] = frozenset()) -> tuple[int, int]:
    """(name, check) of a set, 64 bits each; a name in ``clash`` is replaced by
    one that the check takes part in."""
    sums = np.array([mix64(s).sum(dtype=np.uint64), mix64(s ^ _C3).sum(dtype=np.uint64)])
    name, check = mix64(sums + np.uint64(len(s))).view(np.int64).tolist()
    if name in clash:
        name = int(mix64(np.array([name ^ check], np.int64).view(np.uint64)).view(np.int64)[0])
    return name, check


class Seen:
    """A table of fixed size of the names a task met last: repeats that it
    remembers are spared, others go on to the exact steps."""

    SIZE = 1 << 16

    def __init__(self):
        self.names = np.arange(1, self.SIZE + 1)  # no name has another's place

    def __call__(self, name: int) -> bool:
        at = name & (self.SIZE - 1)
        if self.names[at] == name:
            return True
        self.names[at] = name
        return False


class Regions:
    """Shells and classes for similarity ``percent`` / 100."""

    def __init__(self, percent: int):
        if not 50 < percent <= 100:
            raise ValueError("percent must be above 50")
        self.t = percent

    def shells(self, size: int) -> list[int]:
        c = size.bit_length() - 1
        return [c, c + 1] if 100 * size // self.t >= 2 << c else [c]

    def differ(self, shell: int) -> int:
        """The most elements in which partners can differ if the larger lies in the shell."""
        return 2 * ((2 << shell) - 1) * (100 - self.t) // (100 + self.t)

    def contents(self, s: np.ndarray) -> np.ndarray:
        """Hashes of the class contents under which a set is found."""
        out = []
        v, pick = mix64(s * _C1), mix64(s ^ _C2)
        for c in self.shells(len(s)):
            most = self.differ(c)
            k = most + 1 + most // 3
            cls = (pick % np.uint64(k)).astype(np.int64)
            order = np.argsort(cls, kind="stable")
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v[order], dtype=np.uint64)])
            cut = np.searchsorted(cls[order], np.arange(k + 1))
            size = np.diff(cut)
            token = mix64((sums[cut[1:]] - sums[cut[:-1]]) + np.arange(k, dtype=np.uint64) * _C2 + size.astype(np.uint64) * _C3 + np.uint64(c + 1))
            keep = min(most, (100 - self.t) * len(s) // self.t) + 1
            out.append(token[np.lexsort((token, -size))[:keep]])
        return np.concatenate(out)


def _sets(docs: DataFrame, n: int, clash: frozenset[int]) -> DataFrame:
    """``doc_id, fp, check, n_shingles`` of each row; fp is null for empty sets."""

    def run(batches):
        for b in batches:
            fp, check, size = [], [], []
            for raw in each_text(b):
                s = shingle_set(raw, n)
                one = fingerprint(s, clash) if len(s) else (None, None)
                fp.append(one[0]), check.append(one[1]), size.append(len(s))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (fp, check, size))], names=["doc_id", "fp", "check", "n_shingles"])

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, fp long, check long, n_shingles long")


def _named_sets(docs: DataFrame, n: int) -> tuple[DataFrame, frozenset[int]]:
    """The rows of _sets, and the names that two sets would share: as good as
    none, a handful among 10^10 sets."""
    clash: frozenset[int] = frozenset()
    while True:
        rows = materialise(_sets(docs, n, clash))
        twice = rows.groupBy("fp").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo < hi")
        new = {r["fp"] for r in twice.collect()}
        if not new:
            return rows.drop("check"), clash
        discard(rows)
        clash |= new


def _contents(docs: DataFrame, n: int, regions: Regions, clash: frozenset[int], keep=None) -> DataFrame:
    """``content, fp`` of each set, equal sets once a task; with ``keep``
    only contents that pass the bit filter."""

    def run(batches):
        seen = Seen()
        for b in batches:
            toks, fps, rows = [], [], 0

            def flush(toks, fps):
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(toks).view(np.int64)), pa.array(np.repeat(np.array(fps, np.int64), list(map(len, toks))))], names=["content", "fp"])

            for raw in each_text(b):
                s = shingle_set(raw, n)
                if not len(s):
                    continue
                fp = fingerprint(s, clash)[0]
                if seen(fp):
                    continue
                t = regions.contents(s)
                if keep is not None:
                    t = t[passes(keep.value, t)]
                if len(t):
                    toks.append(t), fps.append(fp)
                    rows += len(t)
                if rows > 200_000:
                    yield flush(toks, fps)
                    toks, fps, rows = [], [], 0
            if toks:
                yield flush(toks, fps)

    return map_texts(docs.select("doc_id", "text"), run, "content long, fp long")


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """SKETCH parities: an element flips the one its hash picks. Two sketches
    never differ in more parities than their sets in elements, and hardly in
    fewer while those are few."""
    at = (mix64(s ^ _C3) % np.uint64(SKETCH)).astype(np.int64)
    odd = (np.bincount(at, minlength=SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def _shingles_of(docs: DataFrame, n: int, wanted: DataFrame, clash: frozenset[int]) -> DataFrame:
    """``fp, shingles, sketch`` for the fingerprints in ``wanted``, read from the texts."""
    keep = bit_filter(wanted, "fp")
    longs = pa.list_(pa.int64())

    def run(batches):
        seen = Seen()
        for b in batches:
            fps, sets, sketches = [], [], []
            for raw in each_text(b):
                s = shingle_set(raw, n)
                fp = fingerprint(s, clash)[0] if len(s) else None
                if fp is None or seen(fp) or not passes(keep.value, np.array([fp], np.int64).view(np.uint64))[0]:
                    continue
                fps.append(fp), sets.append(s.view(np.int64)), sketches.append(parity_sketch(s))
                if len(fps) >= 200:
                    yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(sets, longs), pa.array(sketches, longs)], names=["fp", "shingles", "sketch"])
                    fps, sets, sketches = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(sets, longs), pa.array(sketches, longs)], names=["fp", "shingles", "sketch"])

    rows = map_texts(docs.select("doc_id", "text"), run, "fp long, shingles array<long>, sketch array<long>")
    return rows.groupBy("fp").agg(F.first("shingles").alias("shingles"), F.first("sketch").alias("sketch"))


def _apart(a: str, b: str):
    """In how many parities two sketches differ."""
    return sum(F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(SKETCH // 64))


def _may_differ(sa: str, sb: str, percent: int):
    """The most elements in which partners of these sizes can differ."""
    return F.floor((F.col(sa) + F.col(sb)) * (100 - percent) / (100 + percent))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of fingerprints that are linked, exactly."""
    one = pairs.join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("sb")), "b")
    two = one.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("sa")), "a")
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    linked = two.select("a", "b", both.alias("inter"), (F.size("sa") + F.size("sb")).cast("long").alias("total"))
    return materialise(linked.where(F.col("inter") * 100 >= (F.col("total") - F.col("inter")) * percent).select("a", "b"))


def _more_labels(labels: DataFrame, new: DataFrame) -> DataFrame:
    """Written: ``labels`` (node, label: its component's smallest node) with the
    links ``new`` too. Only the components that they join are searched, each as
    one node, so a link is read once however many links come later."""
    ends = new
    for c in "ab":
        ends = ends.join(labels.select(F.col("node").alias(c), F.col("label").alias("l" + c)), c, "left").withColumn("l" + c, F.coalesce("l" + c, c))
    between = materialise(ends.select("la", "lb").where("la <> lb").distinct())
    up = contract_components(between, "la", "lb")
    single = up.join(labels.select("node"), "node", "left_anti")  # was in no component yet
    old = labels.join(up.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left")
    out = materialise(old.select("node", F.coalesce("top", "label").alias("label")).unionByName(single.select("node", "label")))
    discard(between, up, labels)
    return out


def _link_to_pivots(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Written: the labels of the components that the pairs (a: pivot, b, dist)
    join, as far as they are links. A set has many pivots, and where most
    sets are near copies nearly all these pairs are links: so each set is
    compared with its nearest pivot, then one pair for each two components,
    then the pairs that are still between components."""
    first = pairs.groupBy("b").agg(F.min_by("a", F.struct("dist", "a")).alias("a")).select("a", "b")
    done = materialise(first)
    links = _verify(done, sets, percent)
    labels = contract_components(links)
    discard(links)
    for one_each in (True, False):
        rest = pairs.join(done, ["a", "b"], "left_anti")
        for c in "ab":
            rest = rest.join(labels.select(F.col("node").alias(c), F.col("label").alias("l" + c)), c, "left").withColumn("l" + c, F.coalesce("l" + c, c))
        rest = rest.where("la <> lb")
        if one_each:
            rest = rest.groupBy(F.least("la", "lb").alias("u"), F.greatest("la", "lb").alias("v")).agg(F.min(F.struct("dist", "a", "b")).alias("p")).select("p.*")
        rest = materialise(rest.select("a", "b"))
        if not rest.limit(1).count():
            discard(rest)
            break
        new = _verify(rest, sets, percent)
        if new.limit(1).count():
            labels = _more_labels(labels, new)
        tested = materialise(done.unionAll(rest))
        discard(new, rest, done)
        done = tested
    discard(done)
    return labels


def link_components(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows of _sets, ``fp, label`` of the sets that have links)."""
    regions = Regions(percent)
    rows, clash = _named_sets(docs, n)
    shared = _contents(docs, n, regions, clash).groupBy("content").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi")
    shared = materialise(shared.select("content"))
    blocks = materialise(_contents(docs, n, regions, clash, bit_filter(shared, "content")).select("content", "fp").distinct())
    # the pivot of a block is its smallest fingerprint; single members drop out
    pivots = blocks.groupBy("content").agg(F.min("fp").alias("pivot"), F.max("fp").alias("last")).where("pivot < last").select("content", "pivot")
    member = materialise(blocks.join(pivots, "content"))
    discard(shared, blocks)
    wanted = materialise(member.select("fp").distinct())
    sets = materialise(_shingles_of(docs, n, wanted, clash))
    discard(wanted)
    brief = sets.select("fp", F.size("shingles").alias("size"), "sketch")

    # distances to the pivots, in the sketches' metric
    pairs = member.where("fp <> pivot").select("pivot", "fp").distinct()
    far = pairs.join(brief, "fp").join(brief.select(F.col("fp").alias("pivot"), F.col("size").alias("psize"), F.col("sketch").alias("psketch")), "pivot")
    far = materialise(far.select("pivot", "fp", _apart("sketch", "psketch").alias("dist"), _may_differ("size", "psize", percent).alias("most")))
    labels = _link_to_pivots(far.where("dist <= most").select(F.col("pivot").alias("a"), F.col("fp").alias("b"), "dist"), sets, percent)

    # the blocks of one pivot are one group from here on, so that two sets meet
    # once for a pivot and not once for each class content they share
    order = Window.partitionBy("pivot").orderBy(F.desc("dist"), "fp")
    left = materialise(_open_groups(far.select("pivot", "fp", "dist"), labels).drop("label").withColumn("rank", F.row_number().over(order)))
    top, upto = left.agg(F.max("rank")).first()[0] or 0, 0
    while upto < top:
        low, upto = upto, max(FIRST_WAVE, GROWTH * upto)
        now = _open_groups(left.where(F.col("rank") > low), labels).join(brief, "fp")
        side = lambda t: now.select("pivot", *(F.col(c).alias(c[:2] + t) for c in ("fp", "size", "sketch", "dist", "rank", "label")))  # noqa: E731, B023
        x, y = side("a").where(F.col("raa") <= upto), side("b")
        most = _may_differ("sia", "sib", percent)
        window = (F.col("raa") < F.col("rab")) & (F.col("laa") != F.col("lab")) & (F.abs(F.col("dia") - F.col("dib")) <= most)
        near = x.join(y, "pivot").where(window & (_apart("ska", "skb") <= most))
        near = materialise(near.select(F.least("fpa", "fpb").alias("a"), F.greatest("fpa", "fpb").alias("b")).distinct())
        if near.limit(1).count():
            new = _verify(near, sets, percent)
            if new.limit(1).count():
                labels = _more_labels(labels, new)
            discard(new)
        discard(near)
    discard(member, sets, far, left)
    return rows, labels.withColumnRenamed("node", "fp")


def _open_groups(member: DataFrame, labels: DataFrame) -> DataFrame:
    """The members (pivot, fp, ...) of groups that are not yet one component,
    with labels."""
    m = member.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    many = m.groupBy("pivot").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("pivot")
    return m.join(many, "pivot", "left_semi")


def components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``."""
    rows, labels = link_components(docs, n, percent)
    r = rows.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = r.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return r.join(least, "label", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents that have their component's smallest id; rows with null
    ids and texts without words stay."""
    return drop_ids(docs, materialise(components(docs, n, percent).where("doc_id <> component_id").select("doc_id").distinct()))
