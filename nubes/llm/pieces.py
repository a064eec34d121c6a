"""Lattices over an existing subword vocabulary.

The vocabulary is a SentencePiece model file; its pieces and scores are used as
they are, nothing is trained on it. A chunk (a word with its blank) has a
lattice with a node at every byte border and an edge for every piece that
matches there, a byte piece standing in where no one-byte piece matches; no
lattice is cut. Chunks of equal length are handled together as numpy matrices,
so the cost of an edge is that of an array element; a chunk of more than
CHUNK_BYTES bytes is handled by itself along its length, in blocks of BLOCK
bytes whose edges are all that is held beside two numbers a border.
"""

from __future__ import annotations

import numpy as np

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK_BYTES = 48
_K = np.uint64(0x100000001B3)
_SHIFT = np.uint64(44)
ROWS = 2048
BLOCK = 1 << 14


class Pieces:
    """The pieces of a model file as bytes (the word mark as a blank), with
    prior probabilities from their scores.

    A merge-rank vocabulary has scores 0, -1, -2, ...: ranks, not
    log-probabilities. Rank r then weighs 1 / (r + 10), Zipf's law. Scores that
    are not ranks are taken as natural log-probabilities.
    """

    def __init__(self, path: str = TOKENIZER, lower_only: bool = False):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.raw: list[bytes] = [b""] * n
        score, self.byte_id = np.full(n, -np.inf), np.full(256, -1, np.int32)
        by_len: dict[int, dict[bytes, int]] = {}
        for i in range(n):
            if sp.is_byte(i):
                v = int(sp.id_to_piece(i)[3:5], 16)
                self.raw[i], self.byte_id[v] = bytes([v]), i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                b = sp.id_to_piece(i).replace("▁", " ").encode()
                self.raw[i] = b
                if not (lower_only and b != b.lower()):
                    by_len.setdefault(len(b), {})[b] = i
                    score[i] = sp.get_score(i)
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary needs byte pieces, else texts can be lost")
        used = np.isfinite(score)
        ranks = bool(np.all(score[used] == np.rint(score[used])))
        p = np.zeros(n)
        p[used] = 1.0 / (10 - score[used]) if ranks else np.exp(score[used])
        p /= p.sum()
        p[self.byte_id] += 0.1 * p[used].min()
        self.prior = p / p.sum()
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.seen = np.zeros(1 << 20, bool)
        self.longest = max(by_len, default=1)
        for m, d in by_len.items():
            mat = np.frombuffer(b"".join(d), np.uint8).reshape(-1, m)
            key = np.zeros(len(mat), np.uint64)
            for j in range(m):
                key = key * _K + (mat[:, j].astype(np.uint64) + np.uint64(1))
            key = key ^ (key << np.uint64(29))
            o = np.argsort(key)
            self.tables[m] = (key[o], np.fromiter(d.values(), np.int32, len(d))[o])
            self.seen[(key >> _SHIFT).astype(np.int64)] = True

    def match(self, rows: np.ndarray) -> list[np.ndarray | None]:
        """For each length m the piece ids at each start, -1 for none; None for
        a length of which nothing matches."""
        w, n = rows.shape
        key, out = np.zeros((w, n), np.uint64), []
        wide = rows.astype(np.uint64) + np.uint64(1)
        for m in range(1, min(self.longest, n) + 1):
            key = key[:, : n - m + 1] * _K + wide[:, m - 1 :]
            ids = None
            if m in self.tables:
                mixed = key ^ (key << np.uint64(29))
                at = np.nonzero(self.seen[(mixed >> _SHIFT).astype(np.int64)])
                keys, own = self.tables[m]
                k = mixed[at]
                j = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                hit = keys[j] == k
                if hit.any():
                    ids = np.full(key.shape, -1, np.int32)
                    ids[at] = np.where(hit, own[j], -1)
            if m == 1:
                ids = self.byte_id[rows] if ids is None else np.where(ids < 0, self.byte_id[rows], ids)
            out.append(ids)
        while out and out[-1] is None:
            out.pop()
        return out


def by_length(chunks: list[bytes]):
    """(indices, byte matrix) for chunks of equal length, ROWS at most at once."""
    lens = np.fromiter(map(len, chunks), np.int64, len(chunks))
    order = np.argsort(lens, kind="stable")
    cut = np.flatnonzero(np.diff(lens[order])) + 1
    for part in np.split(order, cut):
        n = int(lens[part[0]]) if len(part) else 0
        for at in range(0, len(part), ROWS) if n else ():
            some = part[at : at + ROWS]
            yield some, np.frombuffer(b"".join([chunks[i] for i in some]), np.uint8).reshape(len(some), n)


def _logsum(terms: list[np.ndarray]) -> np.ndarray:
    t = np.stack(terms)
    top = t.max(axis=0)
    return top + np.log(np.exp(t - top).sum(axis=0))


def log_edges(ids: list[np.ndarray | None], logp: np.ndarray) -> list[np.ndarray | None]:
    return [None if i is None else np.where(i >= 0, logp[i], -np.inf) for i in ids]


def forward(edges: list[np.ndarray | None], n: int) -> np.ndarray:
    """Log-space forward recursion: at each border the log of the summed weight
    of all segmentations of what lies before it."""
    a = np.zeros((len(edges[0]), n + 1))
    for e in range(1, n + 1):
        a[:, e] = _logsum([a[:, e - m] + x[:, e - m] for m, x in enumerate(edges[:e], 1) if x is not None])
    return a


def backward(edges: list[np.ndarray | None], n: int) -> np.ndarray:
    b = np.zeros((len(edges[0]), n + 1))
    for s in range(n - 1, -1, -1):
        b[:, s] = _logsum([x[:, s] + b[:, s + m] for m, x in enumerate(edges[: n - s], 1) if x is not None])
    return b


def blocks_of(pieces: Pieces, chunk: bytes, weight: np.ndarray, reverse: bool = False):
    """(begin, ids, weights) for the borders of a long chunk, BLOCK at once:
    column m - 1 of row i is the piece of m bytes that ends at border
    begin + i + 1, or -1 with weight 0."""
    raw, n, depth = np.frombuffer(chunk, np.uint8), len(chunk), pieces.longest
    weight = np.append(weight, 0.0)
    for at in sorted(range(0, n, BLOCK), reverse=reverse):
        end, back = min(n, at + BLOCK), max(0, at - depth)
        ids = np.full((end - at, depth), -1, np.int32)
        for m, x in enumerate(pieces.match(raw[back:end][None]), 1):
            if x is not None:
                own = x[0][max(0, at + 1 - m - back) :]
                ids[end - at - len(own) :, m - 1] = own
        yield at, ids, weight[ids]


def long_forward(pieces: Pieces, chunk: bytes, weight: np.ndarray) -> np.ndarray:
    """As ``forward`` for one long chunk; ``weight`` are no logs. The last sums
    are carried from block to block, scaled at each border."""
    depth, out, log = pieces.longest, np.zeros(len(chunk) + 1), 0.0
    last = np.zeros(depth)  # of the borders before, the nearest first, over exp(log)
    last[0] = 1.0
    for at, _, w in blocks_of(pieces, chunk, weight):
        for i in range(len(w)):
            z = float(w[i] @ last)
            log += np.log(z)
            last[1:] = last[:-1] / z
            last[0] = 1.0
            out[at + i + 1] = log
    return out


def long_backward(pieces: Pieces, chunk: bytes, weight: np.ndarray) -> np.ndarray:
    n, depth, log = len(chunk), pieces.longest, 0.0
    out, ahead = np.zeros(n + 1), np.zeros(depth)  # ahead[m]: what edges that start m bytes before the border add up to
    z = 1.0
    for at, _, w in blocks_of(pieces, chunk, weight, reverse=True):
        for e in range(at + len(w), at, -1):
            ahead += w[e - 1 - at]  # edges ending here; this border has 1 after scaling
            z = float(ahead[0])
            log += np.log(z)
            ahead[:-1] = ahead[1:] / z
            ahead[-1] = 0.0
            out[e - 1] = log
    return out


def split_words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the words that go through matrices, and of the long ones."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    return np.flatnonzero(lens < CHUNK_BYTES), np.flatnonzero(lens >= CHUNK_BYTES)


def word_log_likelihood(pieces: Pieces, logp: np.ndarray, words: list[bytes]) -> np.ndarray:
    """For each word, a blank before it, the log of the summed weight of all its
    segmentations."""
    short, long = split_words(words)
    chunks, out = [b" " + words[i] for i in short], np.zeros(len(words))
    for at, rows in by_length(chunks):
        out[short[at]] = forward(log_edges(pieces.match(rows), logp), rows.shape[1])[:, -1]
    for i in long:
        out[i] = long_forward(pieces, b" " + words[i], np.exp(logp))[-1]
    return out


def expected_counts(pieces: Pieces, logp: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Expected uses of each piece over the words' segmentations, each word once."""
    short, long = split_words(words)
    total = np.zeros(len(logp))
    for _, rows in by_length([b" " + words[i] for i in short]):
        ids, n = pieces.match(rows), rows.shape[1]
        edges = log_edges(ids, logp)
        a, b = forward(edges, n), backward(edges, n)
        for m, (i, e) in enumerate(zip(ids, edges, strict=True), 1):
            if i is not None:
                ok = i >= 0
                post = np.exp(a[:, : n - m + 1] + e + b[:, m:] - a[:, -1:])
                total += np.bincount(i[ok], post[ok], len(total))
    for i in long:
        chunk, weight = b" " + words[i], np.exp(logp)
        a, b = long_forward(pieces, chunk, weight), long_backward(pieces, chunk, weight)
        for at, ids, w in blocks_of(pieces, chunk, weight):
            row, col = np.nonzero((ids >= 0) & (w > 0))
            e, m = at + row + 1, col + 1
            post = np.exp(a[e - m] + np.log(w[row, col]) + b[e] - a[-1])
            total += np.bincount(ids[row, col], post, len(total))
    return total
