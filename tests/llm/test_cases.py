"""Defined cases of the operators: clashing names, hashes of structured words,
long words, empty tables, repeated rows."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nubes.llm import chat, common, decontaminate, jaccard, lmscore, media, pieces, repeats, segment, sharding, warc

TEXTS = "doc_id long, text string"


def alternating(n, a="a", b="b"):
    """The Thue-Morse sequence of n letters, and its twin."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return [(a, b)[x] for x in bits], [(b, a)[x] for x in bits]


# ------------------------------------------------------------------ hashes


def test_structured_words_have_different_hashes(spark):
    for n in (64, 1024, 4096):
        x, y = ("".join(w) for w in alternating(n))
        h = common.word_hashes(np.frombuffer(f"{x} {y}".encode(), np.uint8))
        assert h[0] != h[1]
        rows = spark.createDataFrame([(1, x), (2, y)], TEXTS)
        assert {(r.doc_id, r.component_id) for r in jaccard.components(rows, 3, 90).collect()} == {(1, 1), (2, 2)}


def test_structured_passages_are_told_apart(spark):
    x, y = (" ".join(w) for w in alternating(4096, "left", "right"))
    shared = " ".join(f"s{i}" for i in range(60))
    rows = spark.createDataFrame([(1, f"{x} {shared}"), (2, f"{y} {shared}"), (3, None), (4, "a b")], TEXTS)
    got = set()
    for r in repeats.find_repeats(rows).collect():
        got |= {(r.doc_id, s) for s in range(r.start_word, r.start_word + r.n_words - 49)}
    words = {1: f"{x} {shared}".split(), 2: f"{y} {shared}".split()}
    windows = {i: {tuple(w[s : s + 50]) for s in range(len(w) - 49)} for i, w in words.items()}
    assert got == {(i, s) for i, w in words.items() for s in range(len(w) - 49) if tuple(w[s : s + 50]) in windows[3 - i]}


def test_words_of_every_length_and_case():
    raw = b"Abc abc ABC" + b"".join(b" " + b"x" * n + b" " + b"X" * n for n in range(1, 70))
    h = common.word_hashes(np.frombuffer(raw, np.uint8))
    assert h[0] == h[1] == h[2] and (h[3::2] == h[4::2]).all() and len(set(h.tolist())) == 70


def test_sets_that_would_share_a_name_are_told_apart(spark, monkeypatch):
    plain = jaccard.fingerprint

    def narrow(s, clash=frozenset()):
        name, check = plain(s)
        return (name & 1, check) if name & 1 not in clash else (name, check)

    monkeypatch.setattr(jaccard, "fingerprint", narrow)
    texts = [f"{a} {b} {a}{b} x y z" for a in "abc" for b in "de"]
    rows = spark.createDataFrame([(i, texts[i % 6]) for i in range(12)], TEXTS)
    assert {(r.doc_id, r.component_id) for r in jaccard.components(rows, 3, 90).collect()} == {(i, i % 6) for i in range(12)}


# ------------------------------------------------------------------ 1, chat


def test_no_control_string_survives(spark):
    control = ["<|reserved_special_token_0|>", "<|EOT|>", "<|im-end|>", "<start_of_turn>", "<unk>", "[SYSTEM_PROMPT]", "<\uff5cbegin\u2581of\u2581sentence\uff5c>", "</s>", "[INST]", "<|im_start|>user", "\\<[n", "[n"]
    rows = [(1, i, "a\nb" if i == 3 else "assistant", t) for i, t in enumerate(control)] + [(1, 0, "assistant", control[0])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"parts": chat.text_part(F.col("text")), "content": F.lit("own"), "start": F.lit(0)})
    r = chat.format_chat(df).select("formatted", "loss_spans", chat.parse_chat(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    body = r.formatted.replace(chat.START, "").replace(chat.END, "")
    assert not any(c in body for c in control[:10])
    want = sorted(((t, role, x) for _, t, role, x in rows), key=lambda v: (v[0], v[1]))
    assert [(x.role, x.text) for x in r.turns] == [(role, x) for _, role, x in want]
    assert r.loss == "".join(x for _, role, x in want if role == "assistant")
    at = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
    assert [t.replace("\\\\", "\0").replace("\\", "").replace("\0", "\\") for t in at] == [x for _, role, x in want if role == "assistant"]


def test_a_null_conversation_and_many_turns(spark):
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    r = chat.format_chat(rows.withColumn("parts", chat.text_part(F.col("text")))).select("conv_id", F.size("loss_spans").alias("n"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(r) == 1 and r[0].conv_id is None and r[0].n == 1500 and r[0].loss == "".join(f"t{i}" for i in range(1, 3000, 2))


# ------------------------------------------------------------------ 2 and 5, lattices


def test_long_words_have_whole_lattices(monkeypatch):
    p = pieces.Pieces()
    with np.errstate(divide="ignore"):
        logp = np.log(p.prior)
    thai = "\u0e01\u0e32\u0e23\u0e17\u0e14\u0e2a\u0e2d\u0e1a" * 6
    words = [("x" * 100).encode(), thai.encode(), "\u0443\u043d\u0438\u0432\u0435\u0440\u0441\u0438\u0442\u0435\u0442\u0430".encode() * 4, b"short"]
    a, e = pieces.word_log_likelihood(p, logp, words), pieces.expected_counts(p, logp, words)
    monkeypatch.setattr(pieces, "CHUNK_BYTES", 10_000)
    assert np.allclose(a, pieces.word_log_likelihood(p, logp, words)) and np.allclose(e, pieces.expected_counts(p, logp, words))
    monkeypatch.setattr(pieces, "CHUNK_BYTES", 2)
    monkeypatch.setattr(pieces, "BLOCK", 7)
    assert np.allclose(a, pieces.word_log_likelihood(p, logp, words)) and np.allclose(e, pieces.expected_counts(p, logp, words))


def test_the_longest_piece_is_used(monkeypatch):
    p = pieces.Pieces()
    longest = max((b for i, b in enumerate(p.raw) if len(b) == p.longest and i > 258), key=len)
    assert p.longest > 16 and longest.startswith(b" ")
    for cut in (48, 2):
        monkeypatch.setattr(segment, "CHUNK_BYTES", cut)
        ids = [segment._encode(segment.Sampler(p, sharpness=0.05), [k], [np.frombuffer(longest, np.uint8)])[0] for k in range(400)]
        assert any(len(x) == 1 and p.raw[x[0]] == longest for x in ids)


def test_samples_do_not_depend_on_the_path_or_the_slices(monkeypatch):
    s = segment.Sampler(pieces.Pieces())
    text = np.frombuffer(("  two  blanks\tand\n\nlines " + "noblanks" * 20 + " \u0442\u0435\u043a\u0441\u0442 end ") .encode() * 3, np.uint8)
    want = segment._encode(s, [7], [text])[0]
    monkeypatch.setattr(segment, "SLICE", 16)
    assert (segment._encode(s, [7], [text])[0] == want).all()
    monkeypatch.setattr(segment, "CHUNK_BYTES", 3)
    assert (segment._encode(s, [7], [text])[0] == want).all()


def test_pieces_of_a_text_over_a_megabyte_and_odd_keys(spark):
    long = "word " * 220_000 + "x" * 5000
    df = spark.createDataFrame([("k1", long, [1], "was"), (None, None, None, "there")], "doc_id string, text string, piece_ids array<int>, decoded string")
    out = segment.encode_pieces(df)
    assert out.columns == ["doc_id", "text", "decoded", "piece_ids"]
    back = {r.doc_id: r for r in segment.decode_pieces(out).collect()}
    assert back["k1"].decoded == long and back[None].decoded == "" and back[None].piece_ids == []


def test_score_equals_brute_force(spark):
    texts = ["the cat sat", "the dog sat on the mat", "a cat", "", None, "Zyx the", "the " * 5, "q" * 60]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "the cat")]
    got = {(r.doc_id): (r.score, -r.bits_without_own * r.n_tokens * math.log10(2)) for r in lmscore.score_documents(spark.createDataFrame(rows, TEXTS), frequent=3).collect()}
    c = Counter()
    for i, t in rows:
        if not lmscore.held_out(i):
            c.update([*(t or "").encode().lower().split(), b""])
    n, v = sum(c.values()), len(c)
    ones, twos = (sum(x == k for x in c.values()) for k in (1, 2))
    d = ones / (ones + 2 * twos) if ones else 0.5
    p = pieces.Pieces(lower_only=True)
    ids = {b: i for i, b in enumerate(p.raw) if p.prior[i] > 0 and i > 258}

    def edges(w):
        for e in range(1, len(w) + 1):
            for s in range(max(0, e - p.longest), e):
                if w[s:e] in ids or e - s == 1:
                    yield s, e, ids.get(w[s:e], p.byte_id[w[s]])

    def sums(w, weight):
        a, b = [1.0] + [0.0] * len(w), [0.0] * len(w) + [1.0]
        for s, e, i in edges(w):
            a[e] += a[s] * weight[i]
        for s, e, i in sorted(edges(w), reverse=True):
            b[s] += b[e] * weight[i]
        return a, b

    known, weight, stay = [w for w in c if w], p.prior, 0.75
    for _ in range(lmscore.EM_ROUNDS):
        uses = np.zeros(len(weight))
        for w in known:
            a, b = sums(b" " + w, weight * stay)
            for s, e, i in edges(b" " + w):
                uses[i] += a[s] * weight[i] * stay * b[e] / a[-1]
        weight = (uses + lmscore.PRIOR_WEIGHT * p.prior) / (uses.sum() + lmscore.PRIOR_WEIGHT)
        stay = 1 - len(known) / max(uses.sum(), len(known) + 1)
    rest = d * v + 1

    def word(w, own):
        p0 = lmscore.P_END if not w else (1 - lmscore.P_END) * sums(b" " + w, weight * stay)[0][-1] * (1 - stay) / stay
        return math.log10((max(c[w] - own[w] - d, 0) + rest * p0) / (n + 1 - sum(own.values())))

    for i, t in rows:
        toks = [*(t or "").encode().lower().split(), b""]
        for k, own in enumerate((Counter(), Counter() if lmscore.held_out(i) else Counter(toks))):
            want = sum(word(w, own) for w in toks)
            assert abs(got[i][k] - want) < 1e-6 * abs(want), (i, k, got[i], want)


# ------------------------------------------------------------------ 3, 4


def test_placement_replaces_columns_of_its_names(spark):
    t = sharding.fill_table(["a", "b", "c"], 101)
    df = spark.createDataFrame([(1, "x", 5, 9), (None, "y", 6, 9)], "shard long, place string, slot int, Slot2 int")
    out = sharding.assign_shards(df, "shard", {"shard": t})
    assert sorted(out.columns) == ["Slot2", "place", "shard", "slot"]
    assert all(t[r.slot] == r.shard for r in out.collect()) and out.count() == 2
    assert sharding.assign_shards(df.limit(0), "shard", {"shard": t}).count() == 0


def test_documents_are_stored_and_read_back(spark, tmp_path):
    texts = [(1, "a"), (1, "a"), (None, None), (2, "long " * 300_000), (3, "\u00e9" * 1000)]
    df = spark.createDataFrame(texts, TEXTS).withColumns({"media": F.lit(1), "tiles": F.lit(2), "n_bytes": F.lit("z")})
    stored = media.store(df, str(tmp_path / "m"))
    for r in stored.collect():
        image = media.decode(r.media)
        small = np.rint(media.area_resize(image, 16, 16))
        for t in r.tiles:
            assert (media.read_tile(t.npy) == small[8 * t.tile_row : 8 * t.tile_row + 8, 8 * t.tile_col : 8 * t.tile_col + 8]).all()
        assert len(r.tiles) == 4 and r.dhash == media.difference_hash(image)
    got = Counter((r.doc_id, r.n_bytes, r.payload_sha256) for r in media.media_features(stored).collect())
    want = Counter()
    for i, t in texts:
        b = (t or "").encode()
        want[i, len(b), hashlib.sha256(b + b"\xff" * (-len(b) % 576 if b else 576)).hexdigest()] += 1
    assert got == want
    assert media.media_features(media.store(df.limit(0), str(tmp_path / "none"))).count() == 0


# ------------------------------------------------------------------ 6, 7, 8


def test_cut_passes_columns_of_any_name_on(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"one {passage}", "s1", "n1"), (2, f"two  {passage} end", "s2", "n2"), (3, None, None, None), (None, passage, "s", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, new string")
    out = repeats.cut_repeats(df)
    assert out.columns == df.columns
    assert {tuple(r) for r in out.collect()} == {rows[0], (2, "two  end", "s2", "n2"), rows[2], rows[3]}


def test_repeats_over_many_partitions_and_a_hot_passage(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 20)
    rng = np.random.default_rng(2)
    some = lambda n: " ".join(f"v{i}" for i in rng.integers(0, 10**6, n))
    passage, variant = some(57), some(30)
    texts = [f"{some(20)} {passage} {some(15)}" for _ in range(60)] + [f"{some(9)} {passage[:200]} {variant} {some(4)}" for _ in range(40)] + [some(90) for _ in range(30)] + [f"x {passage}"] * 30
    rows = spark.createDataFrame(list(enumerate(texts)), TEXTS).repartition(9)
    seen, want = {}, set()
    for i, t in enumerate(texts):
        w = t.split()
        for s in range(len(w) - 49):
            seen.setdefault(tuple(w[s : s + 50]), set()).add(i)
    for i, t in enumerate(texts):
        w = t.split()
        want |= {(i, s, min(k) == i) for s in range(len(w) - 49) if len(k := seen[tuple(w[s : s + 50])]) > 1}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {(r.doc_id, s, r.is_first) for r in repeats.find_repeats(rows).collect() for s in range(r.start_word, r.start_word + r.n_words - 49)}
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_leaks_near_the_threshold(spark):
    """Recall of the SimHash blocks on windows of similarity 0.8 to 0.85."""
    rng = np.random.default_rng(8)
    items, docs, want = [], [], set()
    for i in range(120):
        w = [f"u{k}" for k in rng.integers(0, 10**6, 60)]
        items.append((i, " ".join(w)))
        for at in rng.choice(np.arange(5, 55), 1):
            w[at] = "changed"
        docs.append((i, " ".join([*(f"y{k}" for k in rng.integers(0, 10**6, 20)), *w])))
        a, b = ({tuple(x[j : j + 5]) for j in range(56)} for x in (items[-1][1].split(), w))
        if len(a & b) >= 0.8 * len(a | b):
            want.add((i, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(docs, TEXTS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 90 and got == want


def test_null_and_repeated_items(spark):
    text = " ".join(f"t{i}" for i in range(30))
    bench = spark.createDataFrame([(None, text), (1, text), (1, text), (2, None)], "item_id long, text string")
    docs = spark.createDataFrame([(5, f"a {text}"), (5, "b"), (None, text)], TEXTS)
    assert sorted((str(r.doc_id), str(r.item_id), r.start_word) for r in decontaminate.find_leaks(docs, bench).collect()) == [("5", "1", 1), ("5", "None", 1), ("None", "1", 0), ("None", "None", 0)]
    assert decontaminate.decontaminate(docs, bench).collect() == [(None, text)]
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0


# ------------------------------------------------------------------ 10


def test_one_page_id_with_two_payloads(spark, tmp_path):
    big, other = "<p>" + "b" * 300, "<p>" + "o" * 300
    rows = [(1, big), (3, "tiny"), (3, big), (3, other), (4, other), (4, big), (4, big), (None, big), (9, "m" * 9000)]
    df = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    parsed = warc.read_arc(warc.pages_to_arc(df))
    index = warc.payload_index(parsed)
    warc.write_warc(warc.mark_revisits(parsed, index), str(tmp_path / "w"), index, 16_000)
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(spark, str(tmp_path / "w")).collect())
    assert got == Counter([(1, 303, "response", None), (3, 4, "response", None), (3, 303, "revisit", 1), (3, 303, "response", None), (4, 303, "revisit", 3), (4, 303, "revisit", 1), (4, 303, "revisit", 1), (None, 303, "response", None), (9, 9000, "response", None)])
    none = warc.read_arc(warc.pages_to_arc(df.limit(0)))
    index = warc.payload_index(none)
    warc.write_warc(warc.mark_revisits(none, index), str(tmp_path / "none"), index)
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


def test_crc_of_ids():
    assert zlib.crc32(b"20") % 10 == zlib.crc32(str(20).encode()) % 10
    with pytest.raises(ValueError):
        repeats.find_repeats(None, 3, 4)


def test_near_copies_are_not_compared_with_every_pivot(spark, monkeypatch):
    """A group of near copies, whose sets have many pivots: about as many pairs
    are compared and kept as there are sets."""
    words = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(k, " ".join(words[:k] + [f"x{k}"] + words[k + 1 :])) for k in range(0, 300, 2)], "doc_id long, text string")
    sizes = []

    def counted(pairs, *a, f=jaccard._verify):
        sizes.append(pairs.count())
        return f(pairs, *a)

    monkeypatch.setattr(jaccard, "_verify", counted)
    assert {(r.doc_id, r.component_id) for r in jaccard.components(docs, 3, 90).collect()} == {(k, 0) for k in range(0, 300, 2)}
    assert sizes[0] < 150 and sum(sizes) < 2 * 150


def test_later_links_are_searched_between_components_only(spark, monkeypatch):
    """A star's links are searched once; what comes later joins components."""
    searched = []

    def counted(edges, *a, f=jaccard.contract_components):
        searched.append(edges.count())
        return f(edges, *a)

    monkeypatch.setattr(jaccard, "contract_components", counted)
    labels = jaccard.contract_components(spark.range(1, 500).selectExpr("0L AS a", "id AS b").unionAll(spark.createDataFrame([(600, 601)], "a long, b long")))
    new = spark.createDataFrame([(3, 4), (7, 600), (9, 601), (700, 701), (701, 499), (-5, 800)], "a long, b long")
    got = {r.node: r.label for r in jaccard._more_labels(labels, new).collect()}
    assert got == {k: 0 for k in [*range(500), 600, 601, 700, 701]} | {-5: -5, 800: -5} and searched == [500, 4]
