"""SentencePiece encoding by forward filtering and backward sampling, and its
exact inverse.

Each chunk's lattice is filtered forward once; then every occurrence of the
chunk draws its own segmentation backwards, piece by piece, from the exact
posterior. The draws come from a counter hash of (seed, row key, chunk number,
step), so a row's segmentation depends on its key and text alone, wherever and
however often it is computed. Pieces are read as bytes with the word mark as a
blank, and a word mark that stands in a text is spelled with byte pieces, so
decoding returns each text byte for byte.

Defined cases: a null text is empty and gives no ids; a null key draws as key
0, a key that is no integer by its hash as text; equal keys with equal texts
draw the same; an empty table gives an empty result; all other columns are
passed on, but one that has the name of the added column is replaced. Chunks are
blanks with the bytes without white space that follow, or one other white space,
of any length. Texts are handled in slices of SLICE bytes that end before a
chunk, so memory grows with the longest chunk only.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text, map_texts, mix64
from .pieces import CHUNK_BYTES, TOKENIZER, Pieces, blocks_of, by_length, long_forward

CHUNK = re.compile(rb" +[^\s]*|[^\s]+|\s")
CHUNK_END = re.compile(rb"[^ ](?= )|[\t\n\x0b\x0c\r]")
SLICE = 1 << 20
SEED = 20240101


class Sampler:
    """Samples segmentations of lists of chunks. ``sharpness`` is the power of
    the piece probabilities: larger values favour likely segmentations."""

    def __init__(self, pieces: Pieces, seed: int = SEED, sharpness: float = 0.5):
        p = np.maximum(pieces.prior, 1e-12) ** sharpness
        self.pieces, self.p = pieces, np.append(p / p.max(), 0.0)
        self.seed = np.uint64(seed)

    def draw(self, chunks: list[bytes], key: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all chunks in order, and how many each chunk got."""
        index: dict[bytes, int] = {}
        which = np.fromiter([index.setdefault(c, len(index)) for c in chunks], np.int64, len(chunks))
        words = list(index)
        order = np.argsort(which, kind="stable")
        begin = np.searchsorted(which[order], np.arange(len(words) + 1))
        stream = mix64(mix64(key ^ self.seed) + number)
        at, ids = [], []
        long = {i for i, c in enumerate(words) if len(c) > CHUNK_BYTES}
        for i in long:
            for occ in order[begin[i] : begin[i + 1]]:
                got, ends = self._draw_long(words[i], stream[occ])
                ids.append(got), at.append((int(occ) << 32) + ends)
        for some, rows in by_length([b"" if i in long else c for i, c in enumerate(words)]):
            w, n = rows.shape
            size = begin[some + 1] - begin[some]
            own = np.repeat(np.arange(w), size)
            occ = order[np.repeat(begin[some], size) + np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)]
            cum, table = self._filter(rows)
            end, step = np.full(len(own), n), np.uint64(0)
            while len(own):
                c = cum[own, end]
                u = (mix64(stream[occ] + step) >> np.uint64(11)).astype(np.float64) * 2.0**-53
                m = (c <= (u * c[:, -1])[:, None]).sum(axis=1)
                ids.append(table[own, end, m])
                end = end - m - 1
                at.append((occ << 32) + end)
                live = end > 0
                own, occ, end, step = own[live], occ[live], end[live], step + np.uint64(1)
        if not at:
            return np.zeros(0, np.int32), np.zeros(len(chunks), np.int64)
        at, ids = np.concatenate(at), np.concatenate(ids)
        o = np.argsort(at, kind="stable")
        return ids[o], np.bincount(at >> 32, minlength=len(chunks))

    def _draw_long(self, chunk: bytes, stream: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """As draw, for one occurrence of a long chunk: ids and where they begin."""
        log, end, step, ids, begin = long_forward(self.pieces, chunk, self.p[:-1]), len(chunk), np.uint64(0), [], []
        for at, table, w in blocks_of(self.pieces, chunk, self.p[:-1], reverse=True):
            while end > at:
                m = np.arange(1, min(len(w[0]), end) + 1)
                c = np.cumsum(w[end - 1 - at, : len(m)] * np.exp(log[end - m] - log[end]))
                u = float(mix64(np.array([stream + step]))[0] >> np.uint64(11)) * 2.0**-53
                k = min(int((c <= u * c[-1]).sum()), len(m) - 1)
                ids.append(table[end - 1 - at, k])
                end, step = end - k - 1, step + np.uint64(1)
                begin.append(end)
        return np.array(ids, np.int32), np.array(begin, np.int64)

    def _filter(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward filtering. For each row and border, running sums over the
        length of the last piece of its posterior weight, and the piece ids."""
        w, n = rows.shape
        ids, alpha = self.pieces.match(rows), np.zeros((w, n + 1))
        depth = len(ids)
        weight, table = np.zeros((w, n + 1, depth)), np.full((w, n + 1, depth), -1, np.int32)
        alpha[:, 0] = 1
        for m, i in enumerate(ids):
            if i is not None:
                table[:, m + 1 :, m] = i
        for e in range(1, n + 1):
            k = min(depth, e)
            weight[:, e, :k] = self.p[table[:, e, :k]] * alpha[:, e - k : e][:, ::-1]
            alpha[:, e] = weight[:, e].sum(axis=1)
        return np.cumsum(weight, axis=2), table


def _key(k) -> int:
    """A row key as 64 bits."""
    if k is None or isinstance(k, int):
        return (k or 0) & (1 << 64) - 1
    return int.from_bytes(hashlib.blake2b(str(k).encode(), digest_size=8).digest(), "little")


def _slices(raw: np.ndarray):
    """Parts of a text, each of SLICE bytes and what its last chunk still needs."""
    text, at = raw.tobytes(), 0
    while at < len(text):
        cut = CHUNK_END.search(text, at + SLICE)
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


def _encode(sampler: Sampler, keys: list, texts) -> list[np.ndarray]:
    """Ids for each text; texts share vectorised draws in groups of SLICE bytes."""
    out: list[list[np.ndarray]] = []
    chunks, key, number, owner, size = [], [], [], [], 0

    def flush():
        nonlocal size
        if chunks:
            lens = np.fromiter(map(len, chunks), np.int64, len(chunks))
            flat = [c for part in chunks for c in part]
            ids, counts = sampler.draw(flat, np.repeat(np.array(key, np.uint64), lens), np.concatenate([np.arange(s, s + n, dtype=np.uint64) for s, n in zip(number, lens, strict=True)]))
            ends = np.cumsum(counts)
            cut = np.append(0, np.cumsum(lens))
            for j, o in enumerate(owner):
                lo, hi = (ends[cut[j] - 1] if cut[j] else 0), (ends[cut[j + 1] - 1] if cut[j + 1] else 0)
                out[o].append(ids[lo:hi])
        chunks.clear(), key.clear(), number.clear(), owner.clear()
        size = 0

    for i, (k, raw) in enumerate(zip(keys, texts, strict=True)):
        out.append([])
        seen = 0
        for part in _slices(raw):
            found = CHUNK.findall(part)
            chunks.append(found), key.append(_key(k)), number.append(seen), owner.append(i)
            seen, size = seen + len(found), size + len(part)
            if size >= SLICE:
                flush()
    flush()
    return [np.concatenate(x) if len(x) > 1 else x[0] if x else np.zeros(0, np.int32) for x in out]


def encode_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, seed: int = SEED, sharpness: float = 0.5, ids: str = "piece_ids", drop_text: bool = False) -> DataFrame:
    """Pass all columns on and add the sampled ids (array<int>)."""
    shared = docs.sparkSession.sparkContext.broadcast(Sampler(Pieces(tokenizer), seed, sharpness))
    kept = [c for c in docs.columns if c != ids and not (drop_text and c == text)]
    fields = [docs.schema[c].name for c in kept]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                keys = part.column(part.schema.get_field_index(key)).to_pylist()
                got = _encode(shared.value, keys, each_text(part, text))
                off = np.append(0, np.cumsum([len(x) for x in got])).astype(np.int32)
                arr = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(got) if got else np.zeros(0, np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in fields), arr], names=[*fields, ids])

    schema = docs.select(*kept).withColumn(ids, F.array().cast("array<int>")).schema
    return map_texts(docs, run, schema)


def decode_pieces(df: DataFrame, ids: str = "piece_ids", text: str = "decoded", tokenizer: str = TOKENIZER) -> DataFrame:
    """Pass all columns on and add the decoded text. A null id list gives null."""
    shared = df.sparkSession.sparkContext.broadcast(Pieces(tokenizer).raw)
    kept = [c for c in df.columns if c != text]

    def run(batches):
        raw = np.array(shared.value, object)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                got = [None if x is None else b"".join(raw[x]) for x in part.column(part.schema.get_field_index(ids)).to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), pa.array(got, pa.binary()).cast(pa.string())], names=[*kept, text])

    return map_texts(df, run, df.select(*kept).withColumn(text, F.lit("")).schema)
