"""Byte-level BPE: encoding with a segment tree over adjacent pairs, and decoding.

The leaves of a tree stand for the symbols of one word and hold the rank of the
merge of each symbol with its right neighbour, the position in the low bits, so
the minimum at the root is the leftmost of the lowest-ranked merges. A merge
changes three leaves, whose paths to the root are mended; it ends when no pair
at the root is mergeable. Words of equal length share numpy trees, a row each,
and take their merges together; words of more than LONG bytes have a tree of
their own, so a word of n bytes costs n log n. Each distinct word is encoded
once a lot and remembered, KNOWN of them at most.

The vocabulary is a ``tokenizers`` file, used as it is. Words come from the
byte-level pattern; a text with characters that have no category in this
Python's Unicode tables is split by ``tokenizers``, whose tables may differ from
those of ``regex``. Long texts are split where a blank follows a character
that is no white space, where no word can reach across.

Defined cases: a null text is empty and gives no ids; strings of special tokens
in a text are these tokens (``special=False``: plain text); a null list of ids
decodes to null; ids beyond the vocabulary decode to nothing, bytes that are no
UTF-8 to U+FFFD; equal rows give equal rows, an empty table an empty one; all
other columns are passed on, but one that has the name of the added column is
replaced.
"""

from __future__ import annotations

import json
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

# The byte-level pattern and its alphabet, which stands for bytes
# in vocabulary files: printable characters for themselves, the other bytes in
# order from U+0100.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

LONG, ROWS, KNOWN, LOT = 128, 4096, 200_000, 1 << 20
WIDTHS = (4, 8, 12, 16, 24, 32, 64, LONG)
PLACE = 40  # bits of a position below the rank
NONE = np.int64(2**63 - 1)


def byte_alphabet() -> dict[str, int]:
    """Which byte each character of a byte-level vocabulary stands for."""
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


def _unassigned() -> np.ndarray:
    """For each code point, whether this Python knows no category of it."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


class Lexicon:
    """Ids of words seen lately, KNOWN of them at most between two lots."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def learn(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Add new words, whose ids follow each other."""
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])
        self.begin = np.append(self.begin, self.begin[-1] + np.cumsum(sizes))

    def new(self, lot: list[list[str]]) -> list[str]:
        """The words of a lot that are not known."""
        if len(self.index) > KNOWN:
            self.forget()
        return list(set().union(*lot).difference(self.index))

    def places(self, words: list[str]) -> np.ndarray:
        """The numbers of words that are all known."""
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def ids(self, which: np.ndarray) -> np.ndarray:
        """The ids of words by their numbers, in order."""
        first, size = self.begin[which], self.begin[which + 1] - self.begin[which]
        end = np.cumsum(size)
        return self.flat[np.repeat(first - end + size, size) + np.arange(end[-1] if len(end) else 0)]


class ByteBpe:
    """A byte-level BPE vocabulary, its words known so far, and both directions."""

    def __init__(self, path: str, special: bool = True):
        with open(path, encoding="utf-8") as f:
            self.spec = f.read()
        self.special = special
        self._load()

    def __getstate__(self):
        return {"spec": self.spec, "special": self.special}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._load()

    def _load(self) -> None:
        import regex

        spec, alphabet = json.loads(self.spec), byte_alphabet()
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [k for k in ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "ignore_merges", "byte_fallback") if model.get(k)]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or odd:
            raise ValueError("the vocabulary must be a byte-level BPE without normaliser, prefix space or word marks")
        vocab, added = model["vocab"], spec.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take in neighbouring text are not supported")
        self.raw = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in added)]))
        for token, i in vocab.items():
            self.raw[i] = bytes(alphabet[c] for c in token)
        for t in added:
            self.raw[t["id"]] = t["content"].encode()
        self.tokens = np.array(self.raw, object)
        self.byte_id = np.full(256, -1, np.int64)
        for c, b in alphabet.items():
            self.byte_id[b] = vocab.get(c, -1)
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary needs a token for each byte, else texts can be lost")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        code = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank_of = np.argsort(code, kind="stable")
        self.codes = code[self.rank_of]
        self.added = {t["content"]: t["id"] for t in added} if self.special else {}
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.words, self.border, self.odd = regex.compile(PATTERN), regex.compile(r"(?<=\S)(?= )"), _unassigned()
        self._library = self._ranks = None
        self.known = Lexicon()

    # ------------------------------------------------------------------ words

    def _keys(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaves: the rank of the pairs' merges above their positions; none for
        pairs without merge and for symbols below zero."""
        code = a << 32 | b
        i = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = (self.codes[i] == code) & (a >= 0) & (b >= 0)
        return np.where(hit, self.rank_of[i].astype(np.int64) << PLACE | at, NONE)

    def _merge_rows(self, rows: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
        """Ids of words, a row of bytes each, of all of the row or of ``size``
        bytes; -1 behind a word and where a symbol went into the one before it."""
        w, n = rows.shape
        leaves = 1 << (n - 1).bit_length()
        sym = np.full((w, n + 1), -1, np.int64)
        sym[:, :n] = self.byte_id[rows]
        here = np.arange(n)
        if size is not None:
            sym[:, :n][here[None, :] >= size[:, None]] = -1
        after, before = np.tile(here + 1, (w, 1)), np.tile(np.arange(-1, n), (w, 1))
        tree = np.full((w, 2 * leaves), NONE)
        tree[:, leaves : leaves + n] = self._keys(sym[:, :n], sym[:, 1:], here[None, :])
        level = leaves
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            top = tree[live, 1]
            p = top & ((1 << PLACE) - 1)
            q, b = after[live, p], before[live, p]
            r, left = after[live, q], np.where(b < 0, p, b)
            sym[live, p], sym[live, q] = self.made[top >> PLACE], -1
            after[live, p], before[live, r] = r, p
            own = self._keys(sym[live, p], sym[live, r], p)
            tree[live, leaves + q], tree[live, leaves + p] = NONE, own
            tree[live, leaves + left] = np.where(b < 0, own, self._keys(sym[live, left], sym[live, p], left))
            at = np.stack([p, q, left]) + leaves
            for _ in range(leaves.bit_length() - 1):
                at >>= 1
                tree[live, at] = np.minimum(tree[live, 2 * at], tree[live, 2 * at + 1])
            live = live[tree[live, 1] != NONE]
        return sym[:, :n]

    def _merge_long(self, word: bytes) -> list[int]:
        """As _merge_rows for one word, in plain lists."""
        if self._ranks is None:
            self._ranks = dict(zip(self.codes.tolist(), self.rank_of.tolist(), strict=True))
        ranks, made, none, place = self._ranks, self.made, int(NONE), (1 << PLACE) - 1
        sym, n = self.byte_id[np.frombuffer(word, np.uint8)].tolist(), len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        leaves = 1 << (n - 1).bit_length()
        tree = [none] * (2 * leaves)

        def leaf(i: int, j: int) -> int:
            rank = ranks.get(sym[i] << 32 | sym[j]) if j < n else None
            return none if rank is None else rank << PLACE | i

        for i in range(n):
            tree[leaves + i] = leaf(i, i + 1)
        for i in range(leaves - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        while (top := tree[1]) != none:
            p = top & place
            q, b = after[p], before[p]
            r = after[q]
            sym[p], sym[q], after[p] = int(made[top >> PLACE]), -1, r
            if r < n:
                before[r] = p
            for i, v in ((q, none), (p, leaf(p, r)), *([(b, leaf(b, p))] if b >= 0 else [])):
                i += leaves
                tree[i] = v
                while i > 1:
                    i >>= 1
                    least = min(tree[2 * i], tree[2 * i + 1])
                    if tree[i] == least:
                        break
                    tree[i] = least
        return [s for s in sym if s >= 0]

    def _learn(self, words: list[str]) -> None:
        """Encode words that are not known yet and remember their ids."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        ids, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        order = np.argsort(size, kind="stable")
        for n, low in zip(WIDTHS, (0, *WIDTHS), strict=False):  # words share trees of a width
            some = order[np.searchsorted(size[order], low, "right") : np.searchsorted(size[order], n, "right")]
            for lot in np.split(some, range(ROWS, len(some), ROWS)) if len(some) else ():
                got = self._merge_rows(np.frombuffer(b"".join([raw[i].ljust(n, b"\0") for i in lot]), np.uint8).reshape(len(lot), n), size[lot])
                kept = got >= 0
                ids.append(got[kept]), sizes.append(kept.sum(axis=1))
        for i in order[np.searchsorted(size[order], LONG, "right") :]:
            ids.append(np.array(self._merge_long(raw[i]), np.int64)), sizes.append(np.array([len(ids[-1])]))
        self.known.learn([words[i] for i in order], np.concatenate(ids), np.concatenate(sizes))

    # ------------------------------------------------------------------ texts

    def _split(self, text: str) -> list[str]:
        if text.isascii() or not self.odd[np.frombuffer(text.encode("utf-32-le"), "<u4")].any():
            return self.words.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.spec).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def _parts(self, text: str):
        """(plain text, id of the special token after it or None), in order."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            yield text[at : m.start()], self.added[m.group()]
            at = m.end()
        yield text[at:], None

    def _slices(self, text: str):
        at = 0
        while len(text) - at > LOT and (m := self.border.search(text, at + LOT)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids (uint32) of each text."""
        out, lot, owner, chars = [[] for _ in texts], [], [], 0

        def flush():
            nonlocal chars
            if new := self.known.new(lot):
                self._learn(new)
            for words, i in zip(lot, owner, strict=True):
                out[i].append(self.known.ids(self.known.places(words)))
            lot.clear(), owner.clear()
            chars = 0

        for i, text in enumerate(texts):
            for plain, token in self._parts(text or ""):
                for part in self._slices(plain):
                    if part:
                        lot.append(self._split(part)), owner.append(i)
                        chars += len(part)
                    if chars > LOT:
                        flush()
                if token is not None:
                    flush()
                    out[i].append(np.array([token], np.uint32))
        flush()
        return [np.concatenate(x) if len(x) > 1 else x[0] if x else np.zeros(0, np.uint32) for x in out]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids' tokens."""
        ids = np.asarray(ids)
        return b"".join(self.tokens[ids[(ids >= 0) & (ids < len(self.tokens))]])


# ------------------------------------------------------------------- operators


def encode_bpe(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "token_ids", special: bool = True, packed: bool = False, drop_text: bool = False) -> DataFrame:
    """Pass all columns on and add the ids of the text: array<int>, or with
    ``packed`` little-endian 32-bit integers in one binary value."""
    shared = docs.sparkSession.sparkContext.broadcast(ByteBpe(tokenizer, special))
    kept = [docs.schema[c].name for c in docs.columns if c != ids and not (drop_text and c == text)]

    def run(batches):
        for b in batches:
            got = shared.value.encode(b.column(b.schema.get_field_index(text)).to_pylist())
            if packed:
                arr = pa.array([x.astype("<u4").tobytes() for x in got], pa.binary())
            else:
                off = np.append(0, np.cumsum([len(x) for x in got])).astype(np.int32)
                arr = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate([*got, np.zeros(0, np.uint32)]).astype(np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), arr], names=[*kept, ids])

    return map_texts(docs, run, docs.select(*kept).withColumn(ids, F.lit(b"") if packed else F.array().cast("array<int>")).schema)


def decode_bpe(df: DataFrame, tokenizer: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """Pass all columns on and add the decoded text; the ids may be packed."""
    shared = df.sparkSession.sparkContext.broadcast(ByteBpe(tokenizer))
    packed = df.schema[ids].dataType.simpleString() == "binary"
    kept = [c for c in df.columns if c != text]

    def run(batches):
        bpe = shared.value
        for b in batches:
            got = []
            for x in b.column(b.schema.get_field_index(ids)):
                if x.is_valid:
                    v = np.frombuffer(x.as_buffer(), "<u4") if packed else x.values.drop_null().to_numpy(zero_copy_only=False)
                    got.append(bpe.decode(v).decode("utf-8", "replace"))
                else:
                    got.append(None)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(got, pa.string())], names=[*kept, text])

    return map_texts(df, run, df.select(*kept).withColumn(text, F.lit(None).cast("string")).schema)
