"""Operators 11 to 13 against their libraries and brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
from nubes.llm import align, bpe, queries, resample  # noqa: E402

BYTE, PIECE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, token_ids string, n_a string, score string, rank string"
TEXTS = [
    (1, "The quick brown fox, don't you   think?\n\n  Yes!\t"),
    (2, None),
    (3, ""),
    (4, "special <|endoftext|> inside<|endoftext|>"),
    (5, "漢字かな交じり文 naïve café  　 ՘ \U0001f600 mark ▁ here"),
    (6, "aaaa" * 300 + " " + "ab" * 40),
    (7, "The quick brown fox, don't you   think?\n\n  Yes!\t"),
    (None, "null id words " * 12),
    (8, " ".join(f"word{i % 17}" for i in range(3000))),
    (9, " "),
]


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "x", "y", "z", "s", "r") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBpe(BYTE)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab '\n漢é1!", max_size=300) | st.lists(st.sampled_from(["<|endoftext|>", " the", "'ll", "\r\n", "\x1c", "12", "  "]), max_size=20).map("".join))
def test_bpe_equals_the_library(coder, library, text):
    ids = coder.encode([text])[0]
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert coder.decode(ids).decode() == text == library.decode(ids.tolist(), skip_special_tokens=False)


def test_bpe_long_words_and_slices(coder, library, monkeypatch):
    for text in ("xyz" * 2000, "e" * bpe.LONG, "e" * (bpe.LONG + 1), "aé" * 700 + "!" * 300):
        assert coder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "LOT", 40)
    monkeypatch.setattr(bpe, "KNOWN", 5)
    texts = [t for _, t in TEXTS]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_bpe_merges_leftmost_lowest_first(coder):
    """Against the rule itself: the leftmost pair of the lowest rank, again and again."""
    ranks = dict(zip(coder.codes.tolist(), coder.rank_of.tolist(), strict=True))
    rng = np.random.default_rng(0)
    for size in (2, 3, 7, 33, 150):
        word = bytes(rng.choice(np.frombuffer(b"theinaorsal", np.uint8), size))
        sym = [int(coder.byte_id[b]) for b in word]
        while True:
            found = [(ranks[a << 32 | b], i) for i, (a, b) in enumerate(zip(sym, sym[1:], strict=False)) if a << 32 | b in ranks]
            if not found:
                break
            rank, i = min(found)
            sym[i : i + 2] = [int(coder.made[rank])]
        rows = coder._merge_rows(np.frombuffer(word, np.uint8)[None, :])[0]
        assert rows[rows >= 0].tolist() == sym == coder._merge_long(word)


def test_bpe_operator_cases(spark, library):
    docs = frame(spark)
    out = bpe.encode_bpe(docs, BYTE)
    assert set(out.columns) == set(docs.columns)
    back = bpe.decode_bpe(out, BYTE).collect()
    assert len(back) == len(TEXTS)
    for r in back:
        assert r.token_ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    plain = {r.doc_id: r.token_ids for r in bpe.encode_bpe(docs, BYTE, special=False).collect()}
    assert 50256 not in plain[4] and bpe.encode_bpe(docs.limit(0), BYTE).count() == 0
    odd = spark.createDataFrame([(1, [262, 99999, -3, 50256]), (2, None), (3, [126]), (4, [])], "k long, token_ids array<int>")
    got = {r.k: r.decoded for r in bpe.decode_bpe(odd, BYTE).collect()}
    assert got == {1: " the<|endoftext|>", 2: None, 3: library.decode([126], skip_special_tokens=False), 4: ""}
    with pytest.raises(ValueError, match="byte-level"):
        bpe.ByteBpe(P.path("word_bpe_49k.json"))


def stored(spark, tmp_path, rows=TEXTS, items=("The quick fox", "words words")):
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_bpe_query(spark, tmp_path, library):
    got = sorted(map(tuple, queries.op13_bpe(spark, stored(spark, tmp_path)).collect()), key=str)
    want = []
    for i, t in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def aligned(rows):
    """Brute force: tokens by the libraries, common ends by sets."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    alphabet, name = bpe.byte_alphabet(), {i: t for t, i in a.get_vocab().items()}
    links, out = [], []
    for i, t in rows:
        want = (" " + (t or "")).encode()
        ia, ib = a.encode(" " + (t or ""), add_special_tokens=False).ids, b.encode(t or "")
        ta = [bytes(alphabet[c] for c in name[x]) for x in ia]
        tb = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ib]
        if not t or b"".join(ta) != want or b"".join(tb) != want:
            out.append((i, 0, 0, 0, "", 0)), links.append([])
            continue
        ea, eb = np.cumsum([len(x) for x in ta]), np.cumsum([len(x) for x in tb])
        spans = [[(e - len(x), e) for e, x in zip(end, tok, strict=True)] for end, tok in ((ea, ta), (eb, tb))]
        over = sum(x[0] < y[1] and y[0] < x[1] for x in spans[0] for y in spans[1]) if len(ta) < 300 else None
        groups, link, la, lb = [], [], 0, 0
        for end in sorted(set(ea) & set(eb)):
            ka, kb = int(np.searchsorted(ea, end)) + 1, int(np.searchsorted(eb, end)) + 1
            groups.append(",".join(map(str, ia[la:ka])) + "|" + ",".join(map(str, ib[lb:kb])))
            link.append((ia[ka - 1], ib[kb - 1]))
            la, lb = ka, kb
        out.append((i, len(ia), len(ib), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), over)), links.append(link)
    count = collections.Counter(x for link in links for x in link)
    best = collections.Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(o[0], o[1], o[2], o[3], len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), o[4], o[5]) for o, x in zip(out, links, strict=True)]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_against_brute_force(spark, tmp_path, monkeypatch, small):
    rows = [*TEXTS, (10, "▁"), (11, "tab\tand <s> ▂ 漢"), (12, "x" * 400)]
    if small:  # few pairs broadcast, the others joined; long texts in slices, also by direct calls
        monkeypatch.setattr(align, "COMMON", 8)
        monkeypatch.setattr(align, "LOT", 60)
        coder = align.Aligner(BYTE, PIECE)
        cut = coder.texts([t for _, t in rows])
        monkeypatch.setattr(align, "LOT", 1 << 19)
        assert [(x[:4], x[4].tolist()) for x in coder.texts([t for _, t in rows])] == [(x[:4], x[4].tolist()) for x in cut]
    got = sorted((tuple(r) for r in queries.op11_align(spark, stored(spark, tmp_path, rows)).collect()), key=str)
    want = sorted(aligned(rows), key=str)
    assert [g[:8] for g in got] == [w[:8] for w in want]
    assert all(w[8] is None or g[8] == w[8] for g, w in zip(got, want, strict=True))


def test_alignment_of_nothing(spark, tmp_path):
    assert queries.op11_align(spark, stored(spark, tmp_path, [])).count() == 0


def drawn(rows, items, least=1, most=1, n=10_000, percent=10, least_words=20):
    def feats(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % n for k in range(least, most + 1) for i in range(len(w) - k + 1)]

    own = [(i, *feats(t)) for i, t in rows]
    s, t = collections.Counter(b for x in own for b in x[2]), collections.Counter(b for x in items for b in feats(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + n) / ((s[b] + 1) * (sum(t.values()) + n)))) for b in range(n)]
    out = []
    for i, words, x in own:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in x) // len(x) if x else 0
        out.append([i, words, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


MANY = [*TEXTS, *((100 + i, " ".join(f"Wörd{(i * j) % 29} X{i % 3}" for j in range(1, 5 + i % 40))) for i in range(120))]


def test_resampling_against_brute_force(spark, tmp_path):
    items = ["The quick fox word3 x1", "wörd7 wörd8 WÖRD8", ""]
    got = queries.op12_resample(spark, stored(spark, tmp_path, MANY, items)).collect()
    want = drawn(MANY, items)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got), key=str) == sorted(((r[0], *r[2:]) for r in want), key=str)
    assert sum(r["rank"] is not None for r in got) == sum(r[1] >= 20 for r in want) * 10 // 100 > 3


def test_resampling_windows_slices_and_cases(spark, monkeypatch):
    items = ["word1 word2 word3", "x1 wörd2"]
    docs, aim = frame(spark, MANY), spark.createDataFrame([(t,) for t in items], "text string")
    got = resample.resample(docs, aim, percent=25, least_words=5, least=1, most=3, n_buckets=64).collect()
    assert sorted(map(tuple, got), key=str) == drawn(MANY, items, 1, 3, 64, 25, 5)
    whole = resample.Windows(1, 3, 1000)
    monkeypatch.setattr(resample, "LOT", 7)
    for _, t in MANY:
        assert sorted(resample.Windows(1, 3, 1000)(t)[1]) == sorted(whole(t)[1])
    monkeypatch.setattr(resample, "LOT", 1 << 20)
    assert resample.resample(docs.limit(0), aim).count() == 0
    assert resample.resample(docs, aim.limit(0)).count() == len(MANY)
    with pytest.raises(ValueError, match="least <= most"):
        resample.resample(docs, aim, least=2)
