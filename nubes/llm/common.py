"""Shared helpers: table access, materialisation in the shared folder, and
vectorised word hashing over Arrow buffers."""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import discard, materialise, work_dir  # noqa: F401

SPACES = b" \t\n\x0b\x0c\r"
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col, n: int):
    """crc32 of the id as text, modulo ``n``; null ids give null."""
    return F.pmod(F.crc32(F.encode(col.cast("string"), "utf-8")), F.lit(n))


BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def map_texts(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` for rows that hold whole texts: Arrow
    batches have BATCH_ROWS rows unless the session sets another number, and a
    task gives its free memory back, since Python workers live on."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_KEY) == "10000":
        conf.set(BATCH_KEY, str(BATCH_ROWS))

    def tidy(batches):
        yield from run(batches)
        release()

    return df.mapInArrow(tidy, schema)


def in_lots(batches, rows: int = 20_000):
    """Batches of small rows put together to ``rows`` rows or more, so that array
    operations are worth their overhead."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def release() -> None:
    """Return what Arrow's pool and the C library hold unused to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


# ---------------------------------------------------------------- hashing

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


LONG_WORD = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of one UTF-8 buffer (maximal runs without the
    six ASCII blanks, A-Z lower-cased), in order.

    A word is read in steps of eight bytes, each mixed into its hash before the
    next, so words that differ in the order or pairing of letters do not meet
    as they do in a polynomial; words beyond LONG_WORD bytes go through
    BLAKE2b. Buffers beyond SLICE_BYTES are cut at blanks, so memory does not
    grow with the text.
    """
    n = len(raw)
    if n <= SLICE_BYTES:
        return _slice_hashes(raw)
    out, at = [], 0
    while at < n:
        end = min(n, at + SLICE_BYTES)
        if end < n:
            blank = np.flatnonzero(_IS_SPACE[raw[at:end]])
            if len(blank):
                end = at + int(blank[-1]) + 1
            else:
                more = np.flatnonzero(_IS_SPACE[raw[end:]])
                end = end + int(more[0]) + 1 if len(more) else n
        out.append(_slice_hashes(raw[at:end]))
        at = end
    return np.concatenate(out)


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a buffer begin and end."""
    edge = np.flatnonzero(np.diff(~_IS_SPACE[raw], prepend=False, append=False))
    return edge[::2], edge[1::2]


def _slice_hashes(raw: np.ndarray) -> np.ndarray:
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64)
    s, e = word_bounds(raw)
    low = np.zeros(n + 8, np.uint8)
    low[:n] = _LOWER[raw]
    eight = np.ndarray(n + 1, "<u8", low.data, strides=(1,))
    size = e - s
    h = mix64(size.astype(np.uint64))
    live = np.flatnonzero(size <= LONG_WORD)
    for at in range(0, LONG_WORD, 8):
        if at:
            live = live[size[live] > at]
        if not len(live):
            break
        h[live] = mix64(h[live] ^ (eight[s[live] + at] & _KEEP[np.minimum(size[live] - at, 8)]))
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(low[s[i] : e[i]], digest_size=8).digest(), "little")
    return h


def each_text(batch: pa.RecordBatch, col: str = "text"):
    """The bytes of each text as uint8 arrays without a copy; null: empty."""
    arr = batch.column(batch.schema.get_field_index(col))
    if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type):
        kind = np.int64
    else:
        kind = np.int32
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], kind)[arr.offset : arr.offset + len(arr) + 1] if bufs[1] else np.zeros(len(arr) + 1, kind)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] else np.zeros(0, np.uint8)
    valid = arr.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(arr)):
        yield data[off[i] : off[i + 1]] if valid[i] else data[:0]


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` consecutive words, a few at most; empty if
    there are fewer."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(m, n, np.uint64)
    for i in range(n):
        h = h * _GOLD + words[i : i + m]
    return mix64(h)


def run_hashes(words: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """As ngram_hashes for long runs: hashes of 1, 2, 4, ... words are put
    together, so the cost grows with the logarithm of ``n``. Another ``lane``
    gives independent hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h, width, at, out = mix64(words ^ np.uint64(lane)), 1, 0, None
    while True:
        if n & width:
            part = h[at : at + m]
            out = part if out is None else mix64(out * _M1 ^ part)
            at += width
        if 2 * width > n:
            return out
        h = mix64(h[:-width] * _M2 ^ h[width:])
        width *= 2


# ------------------------------------------------------ bounded bit filters

LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28


def bit_filter(df: DataFrame, col: str):
    """A broadcast bit set of the hashes in ``col``: 16 bits for each row of
    ``df`` (a written table, as it is read twice), at least 8 KB and never more than 32 MB. It only spares work: members
    always pass, the others that pass are removed by the exact joins that follow."""
    n = df.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n).bit_length()))
    idx = F.pmod(F.col(col), F.lit(bits)) + 1
    rows = (
        df.select(idx.alias("i"))
        .groupBy(F.expr("bitmap_bucket_number(i)").alias("b"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(i))").alias("m"))
        .collect()
    )  # at most bits / 32768 rows of 4 KB
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        m = np.frombuffer(bytes(r["m"]), np.uint8)
        at = (r["b"] - 1) * 4096
        out[at : at + len(m)] = m
    return df.sparkSession.sparkContext.broadcast(out)


def passes(bitset: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the uint64 hashes may be members."""
    i = hashes & np.uint64(len(bitset) * 8 - 1)
    return (bitset[(i >> np.uint64(3)).astype(np.int64)] >> (i & np.uint64(7)).astype(np.uint8)) & 1 == 1


def may_have(bitset, col: str):
    """A column: may the long ``col`` be a member? Null is none."""

    @F.pandas_udf("boolean")
    def maybe(ids):
        import pandas as pd

        ok = ids.notna().to_numpy()
        return pd.Series(ok & passes(bitset.value, ids.fillna(0).to_numpy().astype(np.int64).view(np.uint64)))

    return maybe(F.col(col).cast("long"))


HOT, SPREAD, FEW = 5000, 64, 100_000


def join_hot(rows: DataFrame, keys: DataFrame, on: list[str], by: str, count: str = "n") -> DataFrame:
    """Inner join of many ``rows`` with unique ``keys``, whose ``count`` says how
    many rows each has. Keys with more than HOT rows are repeated SPREAD times,
    and their rows spread over the copies by the hash of ``by``, so that no key
    binds its rows to one task. on[0] is a long. Up to FEW hot keys are
    broadcast to mark the rows, more than that go into a bit filter."""
    hot = keys.where(F.col(count) > HOT).select(on[0]).distinct()
    keys, n_hot = keys.drop(count), hot.count()
    if not n_hot:
        return rows.join(keys, on)
    mark, salt = fresh(rows, "mark", "salt")
    if n_hot <= FEW:
        marked = F.broadcast(hot.withColumn(mark, F.lit(True)))
        rows, keys = (t.join(marked, on[0], "left") for t in (rows, keys))
    else:
        bits = bit_filter(hot, on[0])
        rows, keys = (t.withColumn(mark, may_have(bits, on[0])) for t in (rows, keys))
    hit = F.coalesce(F.col(mark), F.lit(False))
    left = rows.withColumn(salt, F.when(hit, F.pmod(F.xxhash64(by), F.lit(SPREAD))).otherwise(0)).drop(mark)
    right = keys.withColumn(salt, F.explode(F.when(hit, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0))).cast("array<long>"))).drop(mark)
    return left.join(right, [*on, salt]).drop(salt)


def split_by_filter(docs: DataFrame, bitset, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be a member, rows whose key is none); null keys are
    none. Only the first part then has to be shuffled for an exact join."""

    hit = may_have(bitset, key)
    return docs.where(hit), docs.where(~hit)


def drop_ids(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without the ids in ``gone`` (a written table of one id column)."""
    some, rest = split_by_filter(docs, bit_filter(gone, key), key)
    return rest.unionByName(some.join(gone, key, "left_anti").select(docs.columns))
