"""Alignment of two tokenizers' tokens over the same bytes.

A text with a blank before it is encoded by a byte-level BPE (side A) and by a
SentencePiece model that adds that blank itself (side B). In each batch, keyed
by document, an as-of join gives for each token start of one side the token of
the other side that covers it; the union of both directions is the overlaps.
Overlaps that end together are the links, and their ends cut both sides into
groups. Long texts are cut where a blank follows a character that is no white
space: A's words end there, and so do B's pieces if none holds a blank behind
another character, so both sides have a common end.

Over the corpus, links are counted by their pair of ids. The pairs that have at
least one in COMMON links, COMMON of them at most, are broadcast; a document's
links with other pairs are looked up by a join, and as none of those pairs has
more than that share of the links, none of its keys is hot.

Defined cases: a null or empty text, and one whose tokens of either side don't
join to the blank and the text again (a word mark of side B in the text, say), has no
tokens: zeros and an empty string of groups; null ids stay null; rows with one
id are told apart; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ByteBpe, Lexicon
from .common import discard, map_texts, materialise, release

LOT, COMMON = 1 << 19, 1 << 18
MARK = "▁"
# ends where a blank follows a character that is no white space
CHUNK = r"\s*\S+(?:[^\S ]\s*\S+)*(?:[^\S ]\s*\Z)?|\s+"


class PieceModel:
    """A SentencePiece model with byte fallback: ids of texts and the bytes of
    its ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.proto = f.read()
        self._load()

    def __getstate__(self):
        return {"proto": self.proto}

    def __setstate__(self, state):
        self.proto = state["proto"]
        self._load()

    def _load(self) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=self.proto)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.raw = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        #: pieces end where a blank begins, and a blank is added before a text
        #: pieces end where a blank begins, and a blank is added before a text
        self.ends_at_blanks = not any(MARK in p.lstrip(MARK) for p in pieces) and self.model.encode("a", out_type=str)[0].startswith(MARK)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.model.encode(texts, num_threads=1)]


class Side:
    """One side's tokens of a lot: ids, units (parts of texts), starts and ends
    as positions in the lot."""

    def __init__(self, ids: list[np.ndarray], sizes: np.ndarray, base: np.ndarray):
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ids = np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64)
        self.unit = np.repeat(np.arange(len(ids)), count)
        self.first = np.append(0, np.cumsum(count))
        end = np.cumsum(sizes[self.ids])
        before = np.append(0, end)[self.first[:-1]]
        self.end = end - np.repeat(before - base, count)
        self.start = self.end - sizes[self.ids]

    def frame(self, name: str) -> pd.DataFrame:
        """Starts are keyed by document: they count on from its base, where both
        sides have a start, so none meets a token of another document."""
        return pd.DataFrame({"at": self.start, name: np.arange(len(self.ids))})


def overlaps(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Positions of tokens that overlap, ordered by both."""
    fa, fb = a.frame("a"), b.frame("b")
    covers = pd.merge_asof(fa, fb, on="at")  # A's starts in B's tokens
    inside = pd.merge_asof(fb, fa, on="at")  # B's starts in A's tokens
    inside = inside[a.start[inside["a"].to_numpy()] != inside["at"].to_numpy()]  # common starts are there already
    a_at, b_at = (np.concatenate([covers[c].to_numpy(), inside[c].to_numpy()]) for c in "ab")
    order = np.argsort(a_at + b_at, kind="stable")  # overlaps go up on both sides
    return a_at[order], b_at[order]


class Aligner:
    def __init__(self, bpe: str, pieces: str):
        self.bpe, self.pieces = ByteBpe(bpe, special=False), PieceModel(pieces)
        self._start()

    def _start(self) -> None:
        import regex

        self._shown, self.chunk, self.known = None, regex.compile(CHUNK), (Lexicon(), Lexicon())

    def __getstate__(self):
        return {"bpe": self.bpe, "pieces": self.pieces}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def _tables(self):
        if self._shown is None:
            raw = [np.array(x, object) for x in (self.bpe.raw, self.pieces.raw)]
            sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in raw]
            shown = [[np.array([f"{i}{c}" for i in range(len(x))], object) for c in ends] for x, ends in zip(raw, (",|", ",;"), strict=True)]
            self._shown = raw, sizes, shown
        return self._shown

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks on both sides and remember their ids. Chunks that begin
        with a blank and end with no white space are encoded as one text, which
        is cut at their ends: no token of either side reaches across."""
        plain = [c for c in chunks if c[0] == " " and not c[-1].isspace()]
        odd = sorted(set(chunks).difference(plain))
        text, ends = "".join(plain), np.cumsum([len(c.encode()) for c in plain])
        for known, sizes, encode, cut in zip(self.known, self._tables()[1], (self.bpe.encode, self.pieces.encode), (0, 1), strict=True):
            ids = [encode([text[cut:]])[0].astype(np.int64)] if plain else []
            at = np.append(0, np.searchsorted(np.cumsum(sizes[ids[0]]), ends) + 1) if plain else np.zeros(1, np.int64)
            if plain and (at[-1] != len(ids[0]) or int(sizes[ids[0]].sum()) != ends[-1]):  # side B changed a character: one by one
                ids, at = [x.astype(np.int64) for x in encode([c[cut:] for c in plain])], None
            count = [np.diff(at) if at is not None else np.array([len(x) for x in ids], np.int64)]
            more = encode([c[cut:] for c in odd]) if odd else []
            if cut and " " in odd:  # the added blank alone
                more[odd.index(" ")] = encode(["a "])[0][1:]
            count.append(np.array([len(x) for x in more], np.int64))
            known.learn(plain + odd, np.concatenate([*ids, *more, np.zeros(0, np.int64)]), np.concatenate(count))

    def encode(self, parts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Both sides' ids of parts with a blank before them; where pieces end
        before blanks, each distinct chunk of a lot is encoded once."""
        if not self.pieces.ends_at_blanks:
            return self.bpe.encode([" " + p for p in parts]), self.pieces.encode(parts)
        lot, (a, b) = [self.chunk.findall(" " + p) for p in parts], self.known
        new = a.new(lot)
        if not a.index:
            b.forget()
        if new:
            self._learn(new)
        where = [a.places(words) for words in lot]
        return [a.ids(w) for w in where], [b.ids(w) for w in where]

    def slices(self, text: str):
        """Parts that end before a blank, each without the blank before it."""
        at = 0
        while self.pieces.ends_at_blanks and len(text) - at > LOT and (m := self.bpe.border.search(text, at + LOT)):
            yield text[at : m.start()]
            at = m.start() + 1
        yield text[at:]

    def align(self, parts: list[str]):
        """For each part: (n_a, n_b, n_overlaps, groups, link codes), or None if
        a side's tokens don't join to the part again."""
        raw, sizes, shown = self._tables()
        want = [b" " + p.encode() for p in parts]
        ids = self.encode(parts)
        # A's words are cut from the text and merges keep their bytes, so its length tells
        ok = [int(sizes[0][ids[0][i]].sum()) == len(w) and b"".join(raw[1][ids[1][i]]) == w for i, w in enumerate(want)]
        used = [i for i, good in enumerate(ok) if good]
        base = np.cumsum([0, *(len(want[i]) for i in used)])[:-1]
        a, b = (Side([x[i] for i in used], s, base) for x, s in zip(ids, sizes, strict=True))
        ia, ib = overlaps(a, b)
        n_over = np.bincount(a.unit[ia], minlength=len(used))
        same = a.end[ia] == b.end[ib]
        la, lb = ia[same], ib[same]  # the last tokens of the groups, in order
        codes = a.ids[la] << 32 | b.ids[lb]
        # the groups as text: A's tokens of a group, then B's
        line = np.empty(len(a.ids) + len(b.ids), object)
        ends_a, ends_b = np.append(0, la + 1), np.append(0, lb + 1)
        at_a = np.arange(len(a.ids)) + np.repeat(ends_b[:-1], np.diff(ends_a))
        at_b = np.arange(len(b.ids)) + np.repeat(ends_a[1:], np.diff(ends_b))
        for side, at, last, (more, end) in ((a, at_a, la, shown[0]), (b, at_b, lb, shown[1])):
            line[at] = more[side.ids]
            line[at[last]] = end[side.ids[last]]
        cut = np.searchsorted(a.unit[la], np.arange(len(used) + 1))
        out = [None] * len(parts)
        for k, i in enumerate(used):
            lo, hi = a.first[k] + b.first[k], a.first[k + 1] + b.first[k + 1]
            out[i] = (int(a.first[k + 1] - a.first[k]), int(b.first[k + 1] - b.first[k]), int(n_over[k]), "".join(line[lo:hi])[:-1], codes[cut[k] : cut[k + 1]])
        return out

    def texts(self, texts: list[str | None]) -> list[tuple]:
        """As align for whole texts; those without tokens give zeros."""
        found, lot, owner, chars = [[] for _ in texts], [], [], 0

        def flush():
            nonlocal chars
            for i, x in zip(owner, self.align(lot) if lot else (), strict=True):
                found[i].append(x)
            lot.clear(), owner.clear()
            chars = 0

        for i, text in enumerate(texts):
            for part in self.slices(text) if text else ():
                lot.append(part), owner.append(i)
                chars += len(part)
                if chars > LOT:
                    flush()
        flush()
        none = (0, 0, 0, "", np.zeros(0, np.int64))
        whole = lambda x: (*(sum(p[k] for p in x) for k in range(3)), ";".join(p[3] for p in x), np.concatenate([p[4] for p in x]))
        return [none if not x or None in x else x[0] if len(x) == 1 else whole(x) for x in found]


def align_tokens(docs: DataFrame, bpe: str, pieces: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``; ``n_a, n_b, n_overlaps, n_groups``; ``groups`` as
    text, ``a1,a2|b1;a3|b2,b3`` with ids in order; and ``links``, for each group
    A's id * 2^32 + B's id."""
    shared = docs.sparkSession.sparkContext.broadcast(Aligner(bpe, pieces))
    fields = [docs.schema[c].name for c in keep]
    added = ["n_a", "n_b", "n_overlaps", "n_groups", "groups", "links"]

    def run(batches):
        for b in batches:
            got = shared.value.texts(b.column(b.schema.get_field_index(text)).to_pylist())
            size = [len(x[4]) for x in got]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32), pa.int32()), pa.array(np.concatenate([*(x[4] for x in got), np.zeros(0, np.int64)]), pa.int64()))
            counts = [pa.array([x[k] for x in got], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in fields), *counts, pa.array(size, pa.int64()), pa.array([x[3] for x in got], pa.string()), lists], names=[*fields, *added])
            del got, lists, counts
            release()  # what a batch needed for a short while

    zero = F.lit(0).cast("long")
    schema = docs.select(*keep).withColumns({c: zero for c in added[:4]} | {"groups": F.lit(""), "links": F.array().cast("array<long>")}).schema
    return map_texts(docs.select(*keep, text), run, schema)


def link_counts(links: DataFrame, code: str = "links") -> DataFrame:
    """A written table ``link, n, best``: each pair of ids, how many links hold
    it, and whether no pair of its B id has more."""
    counts = materialise(links.select(F.explode(code).alias("link")).groupBy("link").agg(F.count(F.lit(1)).alias("n")))
    b = F.col("link").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    out = materialise(counts.withColumn("b", b).join(most, "b").select("link", "n", (F.col("n") == F.col("most")).alias("best")))
    discard(counts)
    return out


def score_links(aligned: DataFrame) -> DataFrame:
    """A table of align_tokens, with ``n_links, n_best`` (links whose count is
    the highest of their B id) and ``count_sum`` (of the links' counts) for
    ``links``."""
    rows = materialise(aligned.withColumn("_row", F.monotonically_increasing_id()))
    pairs = link_counts(rows)
    total = pairs.agg(F.sum("n").alias("n")).collect()[0]["n"] or 0
    top = pairs.where(F.col("n") * COMMON >= total).toArrow()  # COMMON rows at most, as their counts add up to the total
    order = np.argsort(top["link"].to_numpy(), kind="stable")
    known = [np.append(top[c].to_numpy(zero_copy_only=False)[order].astype(np.int64), last) for c, last in (("link", -1), ("n", 0), ("best", 0))]
    shared = rows.sparkSession.sparkContext.broadcast(known)
    kept = [c for c in rows.columns if c != "links"]

    def run(batches):
        link, n, best = shared.value
        for b in batches:
            lists = b.column(b.schema.get_field_index("links"))
            codes, off = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
            at = np.minimum(np.searchsorted(link[:-1], codes), len(link) - 1)
            hit = link[at] == codes
            sums = [np.diff(np.append(0, np.cumsum(np.where(hit, x, 0)))[off]) for x in (best[at], n[at])]
            left = np.append(0, np.cumsum(~hit))[off].astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(codes[~hit], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(np.diff(off), pa.int64()), *(pa.array(x, pa.int64()) for x in sums), rest], names=[*kept, "n_links", "n_best", "count_sum", "_rest"])

    zero = F.lit(0).cast("long")
    schema = rows.select(*kept).withColumns({"n_links": zero, "n_best": zero, "count_sum": zero, "_rest": F.array().cast("array<long>")}).schema
    scored = materialise(map_texts(rows, run, schema))
    discard(rows)
    rare = scored.select("_row", F.explode("_rest").alias("link")).groupBy("_row", "link").agg(F.count(F.lit(1)).alias("k"))
    more = rare.join(pairs, "link").groupBy("_row").agg(F.sum(F.col("k") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("_best"))
    out = scored.join(more, "_row", "left")
    return out.withColumns({"n_best": F.col("n_best") + F.coalesce("_best", zero), "count_sum": F.col("count_sum") + F.coalesce("_sum", zero)}).drop("_row", "_rest", "_sum", "_best")
