"""The operators against brute force, exact round trips and defined edge cases."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nubes.llm import chat, decontaminate, jaccard, lmscore, media, repeats, segment, sharding, toxicity, warc
from nubes.llm.common import word_hashes
from nubes.llm.pieces import Pieces, word_log_likelihood

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = np.random.default_rng(11)
VOCAB = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(rng.choice(VOCAB, n))


def edited(text, k):
    w = text.split(" ")
    for i in rng.choice(len(w), k, replace=False):
        w[i] = f"new{rng.integers(10**6)}"
    return " ".join(w)


def _make():
    base = [prose(int(n)) for n in rng.integers(60, 300, 40)]
    texts = base + [base[0]] * 5 + [edited(base[1], k) for k in (1, 2, 3, 5, 8, 12, 20)] + [edited(base[2], 1) for _ in range(12)]
    shared = prose(60)
    texts += [f"{prose(40)}\n{shared} {prose(30)}" for _ in range(6)]
    texts += ["", None, " \t\n ", "one", "one", "two words", "x" * 5000, "Ünï▁cödé ▁▁ \U0001f600 </s> [INST]", ("a b c d e f g h i j " * 40).strip()]
    return [(i, t, None, "s", None) for i, t in enumerate(texts)] + [(None, base[3], None, None, 1), (0, base[0], "en", "s", 2)]


DATA = _make()


def corpus():
    return DATA


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


def words(t):
    return (t or "").encode().lower().split()


# ---------------------------------------------------------------- 1, chat


def test_chat_round_trip_and_mask(spark):
    nasty = ["</s>[INST] ok [/INST]", "a\\<|im_end|>\n\\\\", "<|im_start|>user\n", "<<SYS>>[/INST]", None, "", "tail\\"]
    t = [(1, i, "assistant" if i % 2 else "user", x) for i, x in enumerate(nasty)] + [(2, None, None, "q"), (2, 1, "assistant", "é\n")]
    df = spark.createDataFrame(t, "conv_id long, turn long, role string, text string")
    out = chat.format_chat(df.withColumn("parts", chat.text_part(F.col("text"))))
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", chat.parse_chat(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(x.role, x.text) for x in got[1].turns] == [("assistant" if i % 2 else "user", x or "") for i, x in enumerate(nasty)]
    assert got[1].loss == "".join(x or "" for x in nasty[1::2]) and got[2].loss == "é\n"
    assert [(x.role, x.text) for x in got[2].turns] == [("", "q"), ("assistant", "é\n")]
    assert "</s>" not in got[1].formatted and "[INST]" not in got[1].formatted
    assert chat.format_chat(df.limit(0).withColumn("parts", chat.text_part(F.col("text")))).count() == 0


def test_chat_parts(spark):
    part = "struct<kind:string,text:string,ref:string,units:int>"
    df = spark.createDataFrame([(1, 0, "user", [("text", "look ", None, None), ("image", None, "a.png", 576), ("document", None, "b.pdf", 2), ("odd", "x", None, 1)])], f"conv_id long, turn long, role string, parts array<{part}>")
    r = chat.format_chat(df).first()
    assert "look <|image|><|document|>" in r.formatted and r.expanded_tokens == 576 + 1024
    assert [(a.ord, a.kind, a.ref) for a in r.attachments] == [(0, "image", "a.png"), (1, "document", "b.pdf")]


# ---------------------------------------------------------------- 2, scoring


def test_lattice_sums_all_segmentations():
    p = Pieces(lower_only=True)
    with np.errstate(divide="ignore"):
        logp = np.log(p.prior)
    ids = {b: i for i, b in enumerate(p.raw) if np.isfinite(logp[i]) and i > 258}

    def brute(w):
        total = [1.0] + [0.0] * len(w)
        for e in range(1, len(w) + 1):
            for s in range(max(0, e - 16), e):
                piece = w[s:e]
                if piece in ids and piece == piece.lower():
                    total[e] += total[s] * p.prior[ids[piece]]
                elif e - s == 1:
                    total[e] += total[s] * p.prior[p.byte_id[piece[0]]]
        return math.log(total[-1])

    some = [b"the", b"nation", b"zq", "é".encode(), b"thintion"]
    assert np.allclose(word_log_likelihood(p, logp, some), [brute(b" " + w) for w in some])


def test_scores_and_base(docs):
    got = lmscore.score_documents(docs, frequent=20).collect()
    data = corpus()
    c = Counter()
    for i, t, *_ in data:
        if not lmscore.held_out(i):
            c.update([*words(t), b""])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, *_ in data:
        toks = [*words(t), b""]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks)
        want[(i, i is None or zlib.crc32(str(i).encode()) % 10 == 0, len(toks), sum(c[w] > 0 for w in toks), n, round(base, 6))] += 1
    assert want == Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert all(r.score < 0 for r in got)
    same = lmscore.score_documents(docs, frequent=100_000).collect()
    assert Counter((r.doc_id, round(r.score, 6)) for r in got) == Counter((r.doc_id, round(r.score, 6)) for r in same)
    assert lmscore.score_documents(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- 3, sharding


def test_table_is_filled_in_turns():
    names = [f"s{i}" for i in range(7)]
    t = sharding.fill_table(names, 1009)
    pref = []
    for s in names:
        d = hashlib.sha256(s.encode()).digest()
        o, k = int.from_bytes(d[:8], "big") % 1009, int.from_bytes(d[8:16], "big") % 1008 + 1
        pref.append([(o + j * k) % 1009 for j in range(1009)])
    want, pos = {}, [0] * 7
    while len(want) < 1009:
        for i in range(7):
            if len(want) == 1009:
                break
            while pref[i][pos[i]] in want:
                pos[i] += 1
            want[pref[i][pos[i]]] = i
    assert [want[i] for i in range(1009)] == t.tolist()
    assert np.bincount(t).max() - np.bincount(t).min() <= 1
    less = sharding.fill_table(names[:-1], 1009)
    assert (t[t != 6] != less[t != 6]).mean() < 0.25
    assert np.bincount(sharding.fill_table(["a", "b"], 1009, [3, 1]))[0] > 750
    with pytest.raises(ValueError):
        sharding.fill_table(names, 1000)


def test_placement(spark, docs, tmp_path):
    t = sharding.fill_table(["a", "b", "c"])
    out = sharding.assign_shards(docs, "doc_id", {"shard": t})
    assert out.count() == docs.count()
    assert all(t[r.slot] == r.shard for r in out.collect())
    hot = spark.range(1000).select(F.lit(1).alias("k"), "id")
    assert sharding.assign_shards(hot, "k", {"shard": t}, salt="id", spread=50).select("slot").distinct().count() > 30
    sharding.write_sharded(out, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()


# ---------------------------------------------------------------- 4, media


def test_codecs_and_resize(spark):
    a = rng.integers(0, 256, (10, 7, 3)).astype(np.uint8)
    assert (media.decode(media.encode_netpbm(a)) == a).all() and (media.decode(media.encode_bmp(a)) == a).all()
    assert media.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 1, 0], [1, 0, 1]]
    assert media.decode(b"P2 2 1 9 3 9").tolist() == [[3, 9]]
    assert media.decode(b"P4 9 1\n\xff\x80").tolist() == [[0] * 9]
    big = np.kron(rng.integers(0, 256, (4, 5)), np.ones((6, 6)))
    assert np.allclose(media.area_resize(big, 4, 5), big[::6, ::6])
    x = rng.uniform(0, 255, (7, 11))
    fine = np.kron(x, np.ones((3, 4)))
    assert np.allclose(media.area_resize(x, 3, 4), fine.reshape(3, 7, 4, 11).mean(axis=(1, 3)))
    df = spark.createDataFrame([(1, bytearray(media.encode_netpbm(a))), (2, bytearray(b"junk")), (3, None)], "k long, m binary")
    r = media.media_tiles(df, "k", "m", 16, 16).collect()
    assert sum(x.k == 1 for x in r) == 4 and all(x.npy is None for x in r if x.k > 1)


def test_document_store(docs):
    got = media.media_features(media.documents_as_media(docs)).collect()
    want = Counter()
    for i, t, *_ in corpus():
        b = (t or "").encode()
        p = b + b"\xff" * (-len(b) % 576 if b else 576)
        want[(i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))] += 1
    assert want == Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got)
    by = defaultdict(set)
    for r in got:
        by[r.payload_sha256].add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by.values())


# ---------------------------------------------------------------- 5, pieces


def test_segmentation_is_lossless_and_repeatable(docs):
    out = segment.encode_pieces(docs)
    back = segment.decode_pieces(out).collect()
    assert all(r.decoded == (r.text or "") for r in back) and back[0].lang is None
    again = {(r.doc_id, r.text): r.piece_ids for r in segment.encode_pieces(docs.repartition(7)).collect()}
    assert all(again[(r.doc_id, r.text)] == r.piece_ids for r in back)
    other = {(r.doc_id, r.text): r.piece_ids for r in segment.encode_pieces(docs, seed=5).collect()}
    assert any(other[(r.doc_id, r.text)] != r.piece_ids for r in back)
    assert segment.encode_pieces(docs.limit(0)).count() == 0


def test_samples_follow_the_posterior():
    p = Pieces()
    s = segment.Sampler(p, sharpness=1.0)
    n = 20000
    ids, counts = s.draw([b" nation"] * n, np.arange(n, dtype=np.uint64), np.zeros(n, np.uint64))
    got = Counter(map(tuple, np.split(ids, np.cumsum(counts)[:-1])))

    def weight(t):
        return math.prod(s.p[i] for i in t)

    known = {b: i for i, b in enumerate(p.raw) if i > 258}

    def all_of(w):
        if not w:
            yield ()
        for k in range(1, len(w) + 1):
            if w[:k] in known:
                for rest in all_of(w[k:]):
                    yield (known[w[:k]], *rest)

    total = sum(map(weight, all_of(b" nation")))
    for t, c in got.most_common(5):
        assert abs(c / n - weight(t) / total) < 0.02


# ---------------------------------------------------------------- 6, repeats


def brute_windows(data, size):
    seen = defaultdict(set)
    for i, t, *_ in data:
        w = words(t)
        for s in range(len(w) - size + 1):
            if i is not None:
                seen[tuple(w[s : s + size])].add(i)
    out = set()
    for i, t, *_ in data:
        w = words(t)
        for s in range(len(w) - size + 1):
            k = seen[tuple(w[s : s + size])]
            if i is not None and len(k) > 1:
                out.add((i, s, min(k) == i))
    return out


def test_repeats_equal_brute_force(docs):
    got = set()
    for r in repeats.find_repeats(docs).collect():
        got |= {(r.doc_id, s, r.is_first) for s in range(r.start_word, r.start_word + r.n_words - 49)}
    assert got == brute_windows(corpus(), 50)
    small = set()
    for r in repeats.find_repeats(docs, 12, 4).collect():
        small |= {(r.doc_id, s, r.is_first) for s in range(r.start_word, r.start_word + r.n_words - 11)}
    assert small == brute_windows(corpus(), 12)
    assert repeats.find_repeats(docs.limit(0)).count() == 0


def test_cut_keeps_first_copy_and_clean_texts(docs):
    out = [(r.doc_id, r.text) for r in repeats.cut_repeats(docs).collect()]
    marked = brute_windows(corpus(), 50)
    dirty = {i for i, _, first in marked if not first}
    for i, t, *_ in corpus():
        if i not in dirty:
            assert (i, t) in out
    left = brute_windows([(i, t) for i, t in out], 50)
    assert not {x for x in left if not x[2]}


# ---------------------------------------------------------------- 7, decontamination


def test_leaks_equal_brute_force(spark, docs):
    data = corpus()
    items = [(1, prose(30)), (2, " ".join(words(data[5][1])[i].decode() for i in range(10, 40))), (3, edited(" ".join(data[7][1].split()[:50]), 1)), (4, ""), (5, None), (6, "one"), (7, "two words"), (8, prose(9))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in decontaminate.find_leaks(docs, bench).collect()}

    def grams(w, k):
        return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]

    want = set()
    for j, b in items:
        w = (b or "").lower().split()
        k = min(5, len(w))
        item = Counter(grams(w, k)) if w else Counter()
        m = sum(item.values())
        for i in {d[0] for d in data}:
            best = 0
            for d in data:
                if d[0] == i and m:
                    g = grams((d[1] or "").lower().split(), k)
                    for s in range(len(g)):
                        a = Counter(g[s : s + m])
                        both = sum((a & item).values())
                        best = max(best, both / (sum(a.values()) + m - both))
            if best >= 0.8:
                want.add((i, j, round(best, 9)))
    assert got == want and any(j == 2 for _, j, _ in got)
    kept = {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()}
    assert kept == {d[0] for d in data} - {i for i, _, _ in want if i is not None}
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


# ---------------------------------------------------------------- 8, join


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_components_equal_brute_force(docs, n, percent):
    data = corpus()
    sets = []
    for i, t, *_ in data:
        w = words(t)
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    label = list(range(len(data)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for a, d in enumerate(data):
        least[find(a)].append(d[0])
    want = Counter((d[0], len(sets[a]), min([i for i in least[find(a)] if i is not None], default=None)) for a, d in enumerate(data))
    assert want == Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(docs, n, percent).collect())
    assert jaccard.components(docs.limit(0), n, percent).count() == 0


def test_partners_share_a_content():
    for percent, n in ((90, 300), (80, 300), (80, 7), (90, 12)):
        r = jaccard.Regions(percent)
        for _ in range(60):
            s = np.unique(rng.integers(1, 2**62, n).astype(np.uint64))
            gone = rng.integers(0, len(s) * (100 - percent) // 100 + 1)
            other = np.unique(np.concatenate([s[gone:], rng.integers(1, 2**62, rng.integers(0, 9)).astype(np.uint64)]))
            both = len(np.intersect1d(s, other))
            if 100 * both >= percent * (len(s) + len(other) - both):
                assert len(np.intersect1d(r.contents(s), r.contents(other)))


# ---------------------------------------------------------------- 9, toxicity


def test_toxicity_on_held_out_rows(spark):
    bad = ["idiotic", "idiots", "scummy", "morons"]
    data, lab = [], []
    for i in range(600):
        w, y = prose(60).split(), int(i % 3 == 0)
        if y:
            for j in rng.choice(60, 5, replace=False):
                w[j] = bad[rng.integers(4)] + "!!"
        data.append((i, " ".join(w))), lab.append((i, 1, y))
    data += [(None, "idiotic"), (9999, None), (9998, "")]
    lab += [(None, 0, 1), (9999, None, None), (5, 1, None)]
    d, y = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(lab, "doc_id long, quality int, toxic int")
    got = toxicity.score(d, y).collect()
    truth = {i: t for i, _, t in lab[:600]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    kept = toxicity.keep_ordinary(d, y)
    assert kept.columns == d.columns and kept.count() == sum(1 - r.predicted or not r.evidence for r in got)
    for one in (y.limit(0), y.where("toxic = 1"), y.where("toxic = 0")):
        assert toxicity.score(d, one).where("predicted = 1 or score > 0").count() == 0
        assert toxicity.keep_ordinary(d, one).count() == len(data)
    half = y.where("doc_id < 60 and (toxic = 1 or doc_id % 3 = 1)")
    assert {r.text for r in toxicity.keep_ordinary(d, half).where("doc_id in (9998, 9999)").collect()} == {None, ""}
    assert toxicity.score(d.limit(0), y).count() == 0 and toxicity.keep_ordinary(d.limit(0), y).count() == 0
    twice = toxicity.score(d.unionAll(d), y).where("doc_id = 3").collect()
    assert len(twice) == 2 and twice[0] == twice[1]


def test_toxicity_models_count_every_word(spark):
    n = 2000
    words = spark.range(n).select(F.concat(F.lit("w"), F.col("id").cast("string")).cast("binary").alias("word"), (F.col("id") % 2).alias("toxic"), F.lit(3).cast("long").alias("ordinary"))
    words = words.unionAll(spark.createDataFrame([(bytearray(b"zzz"), 0, 1), (bytearray("été".encode()), 5, 0)], words.schema))
    got = {r.key: (r.toxic, r.ordinary) for r in toxicity.ngram_counts(words).collect()}
    want = defaultdict(lambda: [0, 0])
    for w, t, o in [(f"w{i}".encode(), i % 2, 3) for i in range(n)] + [(b"zzz", 0, 1), ("été".encode(), 5, 0)]:
        full = b"    " + w + b" "
        for i in range(4, len(full)):
            c = want[int.from_bytes(full[i - 4 : i + 1])]
            c[0] += t
            c[1] += o
    assert got == {k: tuple(v) for k, v in want.items()}


def test_toxicity_models_are_kneser_ney(spark):
    toxic, ordinary = ["idiot", "idiotic", "moron", "été"], ["idle", "idea", "more", "moral", "étage"]
    rows = [(bytearray(w.encode()), i + 1, 0) for i, w in enumerate(toxic)] + [(bytearray(w.encode()), 0, 2) for w in ordinary]
    t = toxicity.ngram_counts(spark.createDataFrame(rows, "word binary, toxic long, ordinary long")).toArrow()
    models = toxicity.Models(*(t[c].to_numpy() for c in ("key", "toxic", "ordinary")))
    grams = lambda w: [(b"    " + w + b" ")[i - 4 : i + 1] for i in range(4, len(w) + 5)]
    counts = [Counter(), Counter()]
    for w, a, b in rows:
        for g in grams(bytes(w)):
            counts[0][g] += a
            counts[1][g] += b
    kinds = {5: {g for c in counts for g, n in c.items() if n}}
    for k in (4, 3, 2, 1):
        kinds[k] = {g[1:] for g in kinds[k + 1]}
    lefts = {k: Counter(g[1:] for g in kinds[k + 1]) for k in (4, 3, 2, 1)}

    def p(g, c):
        if len(g) == 1:
            return (lefts[1][g] + 0.5) / (sum(lefts[1].values()) + 128)
        own = c if len(g) == 5 else lefts[len(g)]
        of = {x: n for x, n in own.items() if n and x[:-1] == g[:-1]}
        total = sum(of.values())
        if not total:
            return p(g[1:], c)
        return max(of.get(g, 0) - 0.75, 0) / total + 0.75 * len(of) / total * p(g[1:], c)

    some = [w.encode() for w in ("idiot", "ideal", "more", "moronic", "zebra", "été")]
    want = [sum(math.log(p(g, counts[0])) - math.log(p(g, counts[1])) for g in grams(w)) for w in some]
    assert np.allclose(models.evidence(some), want, atol=1e-4)


def test_toxicity_learns_from_words_seen_once(spark):
    # 270,000 different words to learn from, each seen once; the toxic ones come last in byte order
    word = lambda i: f"{i:06d}".translate(str.maketrans("0123456789", "abcdefghij"))
    data, truth = [], {}
    for i in range(600):
        w = [word((i * 900 + j) * 314_159 % 540_000) for j in range(900)]
        truth[i] = int(i % 3 == 0)
        data.append((i, " ".join(w + ["zork" + x for x in w[: 400 * truth[i]]])))
    d = spark.createDataFrame(data, "doc_id long, text string")
    y = spark.createDataFrame([(i, 1, t) for i, t in truth.items()], "doc_id long, quality int, toxic int")
    held = toxicity.score(d, y).where("held_out").collect()
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_toxicity_reads_long_runs_to_their_end(spark):
    # one run without blanks a text; what tells the classes apart starts after byte 100
    data, truth = [], {}
    for i in range(400):
        w, truth[i] = prose(60).split(), i % 2
        w[40:50] = ["idiotic" if truth[i] else "lovely"] * 10
        data.append((i, "é".join(w)))
    d = spark.createDataFrame(data, "doc_id long, text string")
    y = spark.createDataFrame([(i, 1, t) for i, t in truth.items()], "doc_id long, quality int, toxic int")
    held = toxicity.score(d, y).where("held_out").collect()
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    words = [b"", b"a", b"b" * 40, b"c" * 41, bytes(range(128, 250)) * 3]
    got = Counter((int(i), int(k)) for own, key in toxicity._keys(words) for i, row in zip(own, key, strict=True) for k in row)
    assert got == Counter((i, int.from_bytes((b"    " + w + b" ")[j : j + 5])) for i, w in enumerate(words) for j in range(len(w) + 1))


# ---------------------------------------------------------------- 10, archives


def test_arc_versions_and_round_trip(spark, tmp_path):
    page = "<p>" + "x" * 200 + "\r\n\r\nWARC/1.1\n</p>"
    data = [(5, "http://a b/", page), (2, None, page), (9, "u", page), (3, "u", "small"), (4, "u", "small"), (7, "u", None), (8, "u", ""), (None, "u", page), (2, None, page)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    parsed = warc.read_arc(warc.pages_to_arc(df))
    index = warc.payload_index(parsed)
    warc.write_warc(warc.mark_revisits(parsed, index), str(tmp_path / "w"), index, 4000)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(spark, str(tmp_path / "w")).collect())
    want = Counter()
    for i, _, h in data:
        b = (h or "").encode()
        again = len(b) >= 100 and i is not None and i > 2
        want[(i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", 2 if again else None)] += 1
    assert got == want
    for v in (1, 2):
        blob = warc.version_block(v) + warc.arc_record(v, "http://x/", b"a\nb") + warc.arc_record(v, "http://y/", b"")
        assert [(r["URL"], r["payload"]) for r in warc.parse_arc(blob)] == [("http://x/", b"a\nb"), ("http://y/", b"")]
        with pytest.raises(ValueError):
            list(warc.parse_arc(blob[:-3]))


def test_word_hashes_do_not_depend_on_slices(monkeypatch):
    from nubes.llm import common

    raw = np.frombuffer((" ".join(prose(50) for _ in range(40)) + " " + "y" * 3000).encode(), np.uint8)
    whole = word_hashes(raw)
    monkeypatch.setattr(common, "SLICE_BYTES", 700)
    assert (word_hashes(raw) == whole).all() and len(whole) == 2001


# ---------------------------------------------------------------- the pipeline


def test_pipeline_stages_keep_columns_and_clean_rows(spark, docs, tmp_path):
    import corpus_pipeline as c

    data = corpus()
    spark.createDataFrame(data, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    leak = " ".join(data[9][1].split()[5:30])
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, f in c.STAGES[:-1]:
        out = f(spark, d, str(tmp_path))
        assert out.columns == d.columns, name
        if name == "toxicity":
            assert out.count() == d.count()
        if name == "decontaminate":
            assert {r.doc_id for r in d.collect()} - {r.doc_id for r in out.collect()} == {9}
        d = out
    final = Counter(r.doc_id for r in c.run(spark, str(tmp_path)).collect())
    assert final[10] and 9 not in final and not set(final) & {40, 41, 42, 43, 44}
    silent = {i for i, t, *_ in data if not (t or "").strip()}
    assert silent <= set(final) and final[None] == 1 and final[0] == 2
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert c.run(spark, str(tmp_path / "none")).count() == 0
