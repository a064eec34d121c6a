"""Benchmark decontamination with SimHash windows (DataFrame and SQL only).

For each benchmark item of n words, windows of n words of a document are
compared with it. A window's multiset of word shingles gives a 64-bit SimHash;
windows and items with equal values in one of 22 blocks of bits meet, so every
pair within RADIUS = 21 bits is found (22 blocks, 21 differing bits: one block
agrees); of these the exact weighted Jaccard similarity (shingle multiplicities
as weights) decides.

Which windows need a fingerprint: if a window of similarity >= t does not begin
with a shingle of the item, moving it right by one loses nothing in common and
gains no difference, so the best windows begin with one; and at least a share t
of the item's shingles must be in it. Both tests are lossless. They are made
inside the row against a bit set of all the benchmark's shingles, a constant of
at most 1 MB whatever the benchmark's size, so one scan serves all items and a
document is never shuffled. What passes is joined with tables of the items'
shingles and block values, which Spark broadcasts while they are small.

Two multisets with Jaccard 0.8 have cosine 0.89, so on average 9.7 of 64 bits
differ with a deviation of 2.9: a radius of 21 lies four deviations out.

Words are runs without ASCII blanks, lower-cased; a shingle has K words, an
item of fewer words is one shingle. Defined cases: null and empty texts and
items have no shingles and match nothing; a row with a null id is compared and
reported under null, and never removed by ``decontaminate``; rows with one id
are one document, items with one id, or none, one item of several texts;
empty tables give an empty result; other columns are ignored or passed on.
"""

from __future__ import annotations

import json
import struct
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K, SIMILARITY = 5, 0.8
RADIUS, BLOCKS = 21, 22
MOST_BITS = 1 << 23
_LOW_BITS = 0x1249249249249249  # the lowest bit of each block of three


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words of a text, in order."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(hashes: str, k: int) -> Column:
    """Hashes of the runs of k words; ``hashes`` names a column of word hashes."""
    at = ", ".join(f"get({hashes}, i + {j})" for j in range(k))
    return F.expr(f"CASE WHEN size({hashes}) >= {k} THEN transform(sequence(0, size({hashes}) - {k}), i -> xxhash64({at})) ELSE cast(array() AS array<bigint>) END")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; a column that a lambda
    uses is otherwise written into it and computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def simhash(name: str) -> Column:
    """64-bit SimHash of a column of shingle hashes: sixteen sums of four
    16-bit counters each, then the majority of each bit."""
    lanes = ", ".join(f"aggregate({name}, 0L, (a, h) -> a + (shiftrightunsigned(h, {k}) & 281479271743489L))" for k in range(16))
    bit = f"CASE WHEN 2 * (shiftrightunsigned(get(lanes, cast(b % 16 AS int)), cast(16 * (b div 16) AS int)) & 65535L) > size({name}) THEN shiftleft(1L, b) ELSE 0L END"
    return F.expr(f"get(transform(array(array({lanes})), lanes -> aggregate(sequence(0, 63), 0L, (a, b) -> a | {bit})), 0)")


def in_blocks(name: str) -> Column:
    """array of struct<block, value, fp> of a column's fingerprint."""
    return let(
        simhash(name),
        lambda fp: F.transform(
            F.sequence(F.lit(0), F.lit(BLOCKS - 1)),
            lambda b: F.struct(b.alias("block"), F.call_function("shiftrightunsigned", fp, b * 3).bitwiseAND(F.lit(7).cast("long")).alias("value"), fp.alias("fp")),
        ),
    )


def _items(benchmark: DataFrame) -> DataFrame:
    """``item, item_id, k, ish`` (shingles) and ``m`` (how many); ``item`` tells
    texts of one id apart."""
    base = benchmark.select(F.xxhash64("item_id", "text").alias("item"), "item_id", word_hashes(F.col("text")).alias("iw")).where("size(iw) > 0").dropDuplicates(["item"])
    parts = []
    for k in range(1, K + 1):
        own = base.where(F.size("iw") >= K) if k == K else base.where(F.size("iw") == k)
        parts.append(own.select("item", "item_id", F.lit(k).alias("k"), shingles("iw", k).alias("ish")))
    return reduce(DataFrame.unionByName, parts).withColumn("m", F.size("ish"))


def _known(items: DataFrame, n: int):
    """A test for columns: may a hash be a shingle of the items? A bit set of 64
    bits for each of the ``n`` shingles, MOST_BITS at most, as one constant."""
    bits = min(MOST_BITS, max(1 << 15, 1 << (64 * n).bit_length()))
    at = items.select(F.explode("ish").alias("h")).select((F.pmod("h", F.lit(bits)) + 1).alias("i"))
    rows = at.groupBy(F.expr("bitmap_bucket_number(i)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(i))").alias("m")).collect()
    whole = bytearray(bits // 8)  # rows of 4 KB
    for r in rows:
        whole[(r["b"] - 1) * 4096 : (r["b"] - 1) * 4096 + len(r["m"])] = r["m"]
    longs = F.from_json(F.lit(json.dumps(struct.unpack(f"<{bits // 64}q", whole))), "array<bigint>")

    def test(h: Column) -> Column:
        word = F.get(longs, F.shiftright(F.pmod(h, F.lit(bits)), 6).cast("int"))
        return F.call_function("bit_get", word, F.pmod(h, F.lit(64)).cast("int")) == 1

    return test


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, similarity``: the best window
    (the first of them) for each document and item that match."""
    items = _items(benchmark)
    kinds = items.groupBy("k").agg(F.sum("m").alias("n"), F.min("m").alias("least"), F.max("m").alias("most")).orderBy("k").collect()
    if not kinds:
        own = [(c, docs.schema["doc_id"].dataType if c == "doc_id" else benchmark.schema["item_id"].dataType) for c in ("doc_id", "item_id")]
        empty = docs.sparkSession.createDataFrame([], "start_word long, n_words long, similarity double")
        return empty.select(*(F.lit(None).cast(t).alias(c) for c, t in own), "*")
    known = {r["k"]: _known(items.where(F.col("k") == r["k"]), r["n"]) for r in kinds}

    def starts(r):
        """Windows of the longest item's length at each start that may count."""
        k, test, need = r["k"], known[r["k"]], -(-r["least"] * similarity // 1)

        def of(sh):
            at = F.filter(F.sequence(F.lit(0), F.size(sh) - 1), lambda i: test(F.get(sh, i)))
            win = F.transform(at, lambda i: F.struct(F.lit(k).alias("k"), i.alias("pos"), F.slice(sh, i + 1, r["most"]).alias("win")))
            return F.filter(win, lambda x: F.size(F.filter(x["win"], test)) >= need)

        none = F.array().cast("array<struct<k:int,pos:int,win:array<bigint>>>")
        return let(shingles("w", k), lambda sh: F.when(F.size(sh) > 0, of(sh)).otherwise(none))

    hashed = docs.select("doc_id", word_hashes(F.col("text")).alias("w"))
    found = hashed.select("doc_id", F.explode_outer(F.concat(*map(starts, kinds))).alias("x")).where("x is not null").select("doc_id", "x.*")

    sizes = items.select("k", F.explode("ish").alias("h"), "m").distinct()
    w = found.withColumn("h", F.get("win", F.lit(0))).join(sizes, ["k", "h"]).select("doc_id", "k", "pos", "m", F.slice("win", 1, F.col("m")).alias("win"))
    hits = F.lit(0)
    for k, test in known.items():
        hits = F.when(F.col("k") == k, F.size(F.filter("win", test))).otherwise(hits)
    w = w.where(hits >= F.ceil(F.col("m") * similarity))

    left = w.select("*", F.explode(in_blocks("win")).alias("x")).select("doc_id", "k", "pos", "m", "win", "x.*")
    right = items.select("item", "k", "m", F.explode(in_blocks("ish")).alias("y")).select("item", "k", "m", "y.block", "y.value", F.col("y.fp").alias("ifp"))
    pairs = left.join(right, ["k", "m", "block", "value"])
    differ = F.col("fp").bitwiseXOR(F.col("ifp"))
    # of the blocks that agree, the lowest stands for the pair
    equal = let(differ, lambda x: F.bitwise_not(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2))).bitwiseAND(F.lit(_LOW_BITS)))
    pairs = pairs.where((F.bit_count(differ) <= RADIUS) & (equal.bitwiseAND(F.expr("~shiftleft(-1L, 3 * block)")) == 0))
    pairs = pairs.select("doc_id", "k", "pos", "win", "item").join(items.select("item", "item_id", "ish"), "item")
    both = F.expr("aggregate(array_distinct(ish), 0, (a, h) -> a + least(size(filter(ish, y -> y = h)), size(filter(win, y -> y = h))))")
    alike = let(both, lambda n: n / (F.size("ish") + F.size("win") - n))
    alike = pairs.withColumn("similarity", alike).where(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", (-F.col("pos")).alias("left"), (F.size("win") + F.col("k") - 1).alias("n_words"))).alias("b")
    out = alike.groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", (-F.col("b.left")).cast("long").alias("start_word"), F.col("b.n_words").cast("long").alias("n_words"), F.col("b.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents in which no item is found; rows with null ids stay."""
    leaks = find_leaks(docs, benchmark, similarity).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)
