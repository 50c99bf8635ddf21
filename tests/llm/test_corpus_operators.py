import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from packetloom.llm import boosting, decontaminate, filters, gif, html_text, jaccard_join, language_id, line_dedup, mixing, pii, quality, token_counts

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def make(spark, texts, **more):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


# ---- mixing


def test_mix_hits_targets_and_is_the_same_again(spark):
    r = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join("w" for _ in range(r.randint(0, 40))), "en", r.choice("abbbbbc") if i % 50 else None) for i in range(3000)], "doc_id long, text string, lang string, source string")
    a = {x.doc_id: x for x in mixing.op1_mixing(docs).collect()}
    b = {x.doc_id: x for x in mixing.op1_mixing(docs.repartition(7)).collect()}
    assert a == b and len(a) == 3000
    by = {}
    for row in docs.collect():
        x = a[row.doc_id]
        assert x.size == len(WORD.findall(row.text)) and 0 <= x.taken <= 3 * x.size and (x.size == 0 or x.taken % x.size == 0)
        t = by.setdefault(row.source, [0, 0, x.target, x.source_size])
        t[0] += x.size
        t[1] += x.taken
    total = sum(t[0] for t in by.values())
    assert abs(sum(t[2] for t in by.values()) - total) < 1e-6 * total
    for size, taken, target, said in by.values():
        assert size == said and target <= 3 * size + 1e-6 and abs(taken - target) <= 40
    free = [(t[2], w) for t, w in zip([by[k] for k in sorted(k for k in by if k is not None)] + [by[None]], (5, 2, 1, 5)) if t[2] < 3 * t[3] - 1e-6]
    assert max(t / w for t, w in free) - min(t / w for t, w in free) < 1e-6


def test_mix_prefers_better_documents(spark):
    docs = spark.createDataFrame([(i, "word " * 10 if i % 2 else "$$$$ " * 10, "en", "a" if i < 2000 else "b") for i in range(4000)], "doc_id long, text string, lang string, source string")
    rows = mixing.mix(docs, mixing.n_words(mixing.F.col("text")), mixing.quality_weight(mixing.F.col("text"))).where("source = 'b'").collect()
    extra = {odd: sum(r.copies for r in rows if r.doc_id % 2 == odd) for odd in (0, 1)}
    assert extra[1] > 1.5 * extra[0] > 0


def test_mix_odd_and_empty(odd, nothing):
    rows = mixing.op1_mixing(odd).collect()
    assert len(rows) == odd.count() and all(r.taken == 0 for r in rows if r.size == 0)
    assert mixing.op1_mixing(nothing).collect() == []


# ---- PII


def brute_spans(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda m: re.sub("[^0-9]", "", m)
    fits = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": lambda m: 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m)), "phone": lambda m: 9 <= len(digits(m)) <= 15}
    return {k: [m.span() for m in re.finditer(p, text) if fits[k](m[0])] for k, p in patterns.items()}


def test_pii_base_spans_match_the_patterns():
    r = random.Random(2)
    samples = ["a@b.c", "a@b@c.d", "x.y@z", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.1", "4111 1111 1111 1111", "+1 (017) 555-7713", "..@a.b-c.d", "0001.2.3.004"]
    samples += ["".join(r.choice("a.@-1+ 239%(") for _ in range(r.randint(0, 60))) for _ in range(20000)]
    for s in samples:
        assert pii.base_spans(s) == brute_spans(s), s


def test_pii_model_adds_and_keeps(spark):
    text = 'api token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" mail a.b@c.de or +1 (017) 555-7713; iban DE89370400440532013000 and the verylongwordwithoutanyspacesatall'
    row = pii.find_pii(make(spark, [text]), redacted=True).first()
    kinds = {x.split(":")[0]: x for x in row.spans.split(",")}
    assert {"email", "phone", "secret", "iban"} <= set(kinds) and row.n_email == row.n_phone == 1 and row.n_more == 2
    assert "<secret>" in row.redacted and "verylongword" in row.redacted
    base = ",".join(f"{k}:{s}:{e}" for k in pii.BASE for s, e in brute_spans(text)[k])
    assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_pii_trees_on_examples_they_have_not_seen():
    trees, thresholds = pii.model()
    x, y = pii._examples(99, 800)
    p = trees.probability(x)
    chosen = p >= np.array([thresholds[pii.KINDS[int(k)]] for k in x[:, 0]])
    assert (y[chosen] > 0).mean() > 0.95 and chosen[y > 0].mean() > 0.85
    assert abs(p.mean() - y.mean()) < 0.05


def test_boosting_fits_a_rule():
    x = np.random.default_rng(0).random((600, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = boosting.BoostedTrees(rounds=30).fit(x[:400], y[:400]).calibrate(x[400:500], y[400:500])
    assert ((trees.probability(x[500:]) > 0.5) == (y[500:] > 0)).mean() > 0.9


@pytest.mark.parametrize("n", [40, 128, 129, 300, 2000])
def test_pii_long_tokens_are_secrets(n):
    r = random.Random(n)
    token = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    text = f"some words and the token: {token} and more"
    assert pii.spans(text, *pii.model())["secret"] == [(26, 26 + n)]
    assert pii.redact(text, pii.spans(text, *pii.model())) == "some words and the token: <secret> and more"


def test_pii_proposes_addresses_of_letters_only():
    assert ("ipv6", 7, 46) in pii.proposals("server abcd:efab:cdef:abcd:efab:cdef:abcd:efab")


def test_pii_odd_and_empty(odd, nothing):
    rows = pii.op2_pii(odd).collect()
    assert len(rows) == odd.count() and [r.n_card for r in rows if r.doc_id == 9] == [1]
    assert pii.op2_pii(nothing).collect() == []


# ---- GIF


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000, 16384, 16448, 70000])
def test_gif_round_trip(n):
    r = random.Random(n)
    for raw in (r.randbytes(n), (b"some words again and again " * 4000)[:n], b"a" * n):
        payload = gif.padded(raw)
        frames = gif.decode(gif.encode(payload))
        assert gif.payload_of(frames) == payload and len(payload) % 64 == 0 < len(payload)
        assert sum(f.histogram()[0].sum() for f in frames) >= len(payload)


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_lzw_round_trip(bits):
    r = random.Random(bits)
    for n in (0, 1, 10, 9000, 40000):
        data = bytes(r.choice((r.randrange(1 << bits), 1)) for _ in range(n))
        assert gif.lzw_decode(gif.lzw_encode(data, bits), bits, n) == data


def picture(frames, size=(2, 2), palette=bytes((0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255))):
    out = b"GIF89a" + bytes((size[0], 0, size[1], 0, 0xF1, 0, 0)) + palette
    for left, top, w, h, pixels, disposal, transparent, delay, interlaced in frames:
        flags = disposal << 2 | (transparent is not None)
        out += bytes((0x21, 0xF9, 4, flags, delay, 0, transparent or 0, 0, 0x2C, left, 0, top, 0, w, 0, h, 0, 64 * interlaced, 2))
        stream = gif.lzw_encode(bytes(pixels), 2)
        out += bytes((len(stream),)) + stream + b"\0"
    return out + b"\x3b"


def test_gif_transparency_disposal_and_time():
    media = picture([(0, 0, 2, 2, [1, 1, 1, 1], 1, None, 5, 0), (0, 0, 2, 1, [2, 3], 2, 3, 7, 0), (1, 1, 1, 1, [2], 3, None, 9, 0), (0, 0, 1, 1, [3], 0, None, 1, 0)])
    a, b, c, d = gif.decode(media)
    red, green, blue, clear = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert a.canvas.tolist() == [[red, red], [red, red]]
    assert b.canvas.tolist() == [[green, red], [red, red]] and b.delay_cs == 7
    assert c.canvas.tolist() == [[clear, clear], [red, green]]
    assert d.canvas.tolist() == [[blue, clear], [red, red]]
    assert d.histogram()[0].sum() == 3


def test_gif_interlaced_and_broken():
    rows = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, 6, step)]
    (f,) = gif.decode(picture([(0, 0, 1, 6, [y % 4 for y in rows], 0, None, 0, 1)], size=(1, 6)))
    assert f.indices[:, 0].tolist() == [0, 1, 2, 3, 0, 1]
    good = gif.encode(gif.padded(b"abc"))
    for bad in (b"", good[:20], good[:-1], b"GIF89a" + bytes(7) + b"\x99"):
        with pytest.raises(gif.BadGif):
            gif.decode(bad)


def test_gif_query(odd, nothing, spark):
    texts = {i: r.text or "" for i, r in enumerate(odd.collect())}
    for r, text in zip(gif.op3_gif(odd.coalesce(1)).collect(), texts.values()):
        payload = gif.padded(text.encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = gif.encode(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert gif.op3_gif(nothing).collect() == []
    frames = gif.store_frames(make(spark, ["x" * 40000])).collect()
    assert [f.at_cs for f in frames] == [0, 10, 20] and sum(sum(f.histogram) for f in frames) >= 40000


# ---- Jaccard join


def brute_components(rows, shingle, percent):
    sets = []
    for _, text in rows:
        w = re.findall("[^\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def near_copies(seed, n):
    """Bases of many sizes, chains of edits near the threshold, copies, and texts that share a long passage only."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    texts = []
    while len(texts) < n:
        base = [r.choice(vocabulary) for _ in range(r.choice((1, 2, 3, 5, 12, 30, 31, 32, 80, 200, 400)))]
        if r.random() < 0.3:
            base += passage
        texts.append(" ".join(base))
        for _ in range(r.choice((0, 0, 1, 4, 9))):
            if r.random() < 0.8:
                for _ in range(r.randint(0, max(1, len(base) // 60))):
                    base[r.randrange(len(base))] = r.choice(vocabulary)
            texts.append((" ".join(base)).upper() if r.random() < 0.1 else " ".join(base))
    return texts[:n]


@pytest.mark.parametrize(("shingle", "percent"), [(3, 90), (5, 80)])
def test_join_matches_brute_force(spark, shingle, percent):
    texts = near_copies(percent, 500) + [None, "", " \n"]
    r = random.Random(5)
    ids = r.sample(range(10**6), len(texts))
    rows = list(zip(ids, texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.similarity_join(docs, shingle, percent).collect()}
    assert got == brute_components(rows, shingle, percent)


def random_pairs(seed, n):
    g = np.random.default_rng(seed)
    fresh = lambda k: g.integers(0, 2**63, k).astype(np.uint64)
    for _ in range(n):
        size = int(g.integers(1, 150))
        both = fresh(size)
        yield tuple(np.unique(np.concatenate((both, fresh(int(g.integers(0, size // 4 + 1)))))) for _ in "ab")


@pytest.mark.parametrize("percent", [80, 90])
def test_blocks_lose_no_pair(percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "COUNTERS", 1 << 10)
    levels = np.random.default_rng(1).integers(0, 3, 1 << 10).astype(np.uint8)
    n_alike = 0
    for a, b in random_pairs(3, 1500):
        a, b = sorted((a, b), key=len)
        common = len(np.intersect1d(a, b))
        alike = 100 * common >= percent * (len(a) + len(b) - common)
        assert jaccard_join.alike(a, b, percent) == jaccard_join.alike(b, a, percent) == alike
        if alike:
            n_alike += 1
            (low, n_low), (high, _) = (jaccard_join.prefix(x, levels, percent) for x in (a, b))
            assert set(low[:n_low].tolist()) & set(high.tolist())
    assert n_alike > 200


@pytest.mark.parametrize("percent", [80, 90])
def test_sets_that_share_single_shingles_do_not_meet(percent):
    """Of a set's tokens hardly any is in another set, if no two are alike, though each shingle is in ten sets and nothing tells which are common."""
    g = np.random.default_rng(7)
    levels = np.zeros(jaccard_join.COUNTERS, np.uint8)
    universe = g.integers(0, 2**63, 60_000).astype(np.uint64)
    tokens = np.concatenate([np.unique(jaccard_join.prefix(np.sort(g.choice(universe, 300, replace=False)), levels, percent)[0]) for _ in range(2000)])
    _, times = np.unique(tokens, return_counts=True)
    assert times[times > 1].sum() < len(tokens) / 100


def test_counters_of_a_task_are_small():
    """Two tasks of an executor hold theirs at once, beside what the pipeline's other stages left."""
    assert jaccard_join.COUNTERS * np.dtype(np.uint32).itemsize <= 16 << 20
    counts = np.random.default_rng(1).integers(0, 2, jaccard_join.COUNTERS).astype(np.uint32)
    parts = {k: jaccard_join._unpacked_counts(blob) for k, blob in jaccard_join._packed_counts(counts)}
    assert (np.concatenate([parts[k] for k in range(jaccard_join.CHUNKS)]) == counts).all()


@pytest.mark.parametrize("percent", [50, 80, 90, 99, 100])
def test_alike_sets_of_any_size_share_a_token(percent):
    """Pairs as far apart as they may be, of small sizes and over the limits of size ranges."""
    g = np.random.default_rng(percent)
    levels = g.integers(0, 200, jaccard_join.COUNTERS).astype(np.uint8)
    sizes = [*range(1, 40), *(int(x) for x in g.integers(40, 3000, 60))]
    for n in sizes:
        for more in {n, 100 * n // percent, int(g.integers(n, 100 * n // percent + 1))}:
            common = -(-percent * (n + more) // (100 + percent))
            if common <= n:
                both, a, b = (g.integers(0, 2**63, k).astype(np.uint64) for k in (common, n - common, more - common))
                a, b = np.unique(np.concatenate((both, a))), np.unique(np.concatenate((both, b)))
                (low, n_low), (high, _) = (jaccard_join.prefix(x, levels, percent) for x in (a, b))
                assert jaccard_join.alike(a, b, percent) and set(low[:n_low].tolist()) & set(high.tolist())


def test_signature_tree_joins_all_that_is_alike():
    r = np.random.default_rng(4)
    sets = []
    for _ in range(40):
        base = r.integers(0, 2**63, int(r.choice((5, 60, 120, 700)))).astype(np.uint64)
        for _ in range(6):
            keep = base[r.random(len(base)) > r.choice((0.01, 0.05, 0.3))]
            sets.append(np.unique(np.concatenate((keep, r.integers(0, 2**63, 1).astype(np.uint64)))))
    alike = lambda i, j: jaccard_join.alike(sets[i], sets[j], 90)
    tried = []
    tree = jaccard_join.SignatureTree([len(x) for x in sets], [jaccard_join.bitmap(x) for x in sets], 90)
    links = list(tree.join(lambda i, j: tried.append((i, j)) or alike(i, j)))
    assert all(alike(i, j) for i, j in links) and len(tried) < len(sets) ** 2 / 20
    for i in range(len(sets)):
        for j in range(i):
            assert not alike(i, j) or tree.find(i) == tree.find(j)
    # Sets that are united beforehand are not tried again.
    again = jaccard_join.SignatureTree([len(x) for x in sets], [jaccard_join.bitmap(x) for x in sets], 90, [tree.find(i) for i in range(len(sets))])
    assert list(again.join(alike)) == []


def test_bitmaps_fold_into_shorter_ones():
    h = np.unique(np.random.default_rng(2).integers(0, 2**63, 900).astype(np.uint64))
    bits = jaccard_join.bitmap(h)
    assert len(bits) * 64 == 2048
    some = jaccard_join.bitmap(h[:300])
    assert not (some & ~jaccard_join._folded(bits, len(some))).any()
    assert not (jaccard_join.bitmap(h[:500]) & ~bits[:16] & ~bits[16:]).any()


@pytest.mark.parametrize("segment", [1, 7, 64, 1 << 20])
def test_words_are_hashed_as_they_are_split(segment):
    r = random.Random(segment)
    by_word = {}
    for _ in range(200):
        text = "".join(r.choice("aAbB \n\t\x0b\u00e9\u6f22\x1c\x85") for _ in range(r.randint(0, 150)))
        own = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        hashes = jaccard_join.word_hashes(text.encode(), segment).tolist()
        assert len(own) == len(hashes) and all(by_word.setdefault(w, h) == h for w, h in zip(own, hashes))
    assert len(set(by_word.values())) == len(by_word) > 100
    texts = ["", "x " * 10, " ", "one", *("".join(r.choice("ab \n") for _ in range(r.randint(0, 40))) for _ in range(50))]
    assert all((a == jaccard_join.shingles(t, 3)).all() for t, a in zip(texts, jaccard_join.all_shingles(texts, 3), strict=True))


@pytest.mark.parametrize(("most_sets", "most_bytes"), [(4, 1 << 20), (100, 2000)])
def test_join_of_groups_that_are_cut_in_cells(spark, most_sets, most_bytes):
    """Groups beyond a cell: near copies of one text, a chain in which only neighbours are alike, and sets that share a passage only."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    base = [r.choice(words) for _ in range(60)]
    texts = [" ".join(base[:i] + ["other%d" % i] + base[i + 1 :]) for i in range(60)]
    chain = [r.choice(words) for _ in range(200)]
    texts += [" ".join(chain[2 * i : 2 * i + 100]) for i in range(50)]
    texts += [" ".join(base[:30] + [r.choice(words) for _ in range(40)]) for _ in range(40)]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    got = jaccard_join.similarity_join(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, most_sets, most_bytes).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute_components(rows, 5, 80)


def test_join_odd_and_empty(odd, nothing):
    rows = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.op4_jaccard_join(odd).collect()}
    assert (1, 0, 1) in rows and (2, 0, 2) in rows and (3, 0, 3) in rows and (4, 1, 4) in rows and (6, 7, 5) in rows and (5, 7, 5) in rows
    assert {r[2] for r in rows if r[0] is None} == {None}
    assert jaccard_join.op4_jaccard_join(nothing).collect() == []


# ---- language


LANGS = {"en": "the and of that with this from have are was", "fr": "le la les des une est dans pour que qui", "de": "der die und das ist nicht ein mit von auf"}


def language_docs(spark, n=300):
    r = random.Random(7)
    rows = []
    for i in range(n):
        lang = r.choice(sorted(LANGS))
        rows.append((i, " ".join(r.choice(LANGS[lang].split()) for _ in range(r.randint(5, 60))), lang, f"host-{lang}{r.randint(0, 3)}"))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_language_of_text_and_host(spark):
    rows, docs = language_docs(spark)
    got = {r.doc_id: r for r in language_id.op5_language_id(docs).collect()}
    assert sum(got[i].language == lang for i, _, lang, _ in rows) >= 298 and all(r.accepted for r in got.values())
    model = language_id.fit_text_model(language_id.of_documents(docs).select(language_id.F.col("id").alias("doc_id"), "text", "declared"))
    extra = spark.createDataFrame([(1000 + i, "xyz", None, None, f"host-{lang}0", f"host-{lang}") for i, lang in enumerate(sorted(LANGS))] + [(2000, "12 34 --", "en", None, "host-en0", "host-en")], "id long, text string, declared string, suffix string, host string, domain string")
    out = {r.id: r for r in language_id.identify(language_id.of_documents(docs).unionByName(extra), model).collect()}
    assert [out[1000 + i].language for i in range(3)] == sorted(LANGS)  # the host decides where the text says nothing
    assert out[2000].language is None and not out[2000].accepted


def test_long_texts_are_counted_in_segments(monkeypatch):
    text = "The quick brown fox, é and 12 others, jumped over some Dogs.\n\n" * 40 + "x" * 300
    model = language_id.TextModel(["a", "b"], np.random.default_rng(3).integers(0, 50, (language_id.BUCKETS, 2)))
    whole = np.bincount(language_id.trigrams(text), minlength=language_id.BUCKETS)
    lp, n, fits = model.score(text)
    for size in (1, 7, 100, 2500):
        monkeypatch.setattr(language_id, "SEGMENT", size)
        assert (language_id.trigram_counts(text) == whole).all()
        got = model.score(text)
        assert np.allclose(got[0], lp, rtol=1e-12) and got[1:] == (n, fits)
    assert language_id.trigram_counts("").sum() == len(language_id.trigrams(""))


def test_language_of_pages(spark):
    body = "the and of that with this from have are was " * 5
    pages = spark.createDataFrame([(1, "https://a.example.de/x", f'<html lang="en"><script>le la les</script><p>{body}</p></html>'), (2, None, None), (3, "http://b.example.fr:80/", f"<HTML LANG=fr>{LANGS['fr'] * 5}")], "page_id long, url string, html string")
    got = {r.page_id: r for r in language_id.op5_pages(pages).collect()}
    assert got[1].language == "en" and got[3].language == "fr" and got[2].language is None and not got[2].accepted


def test_every_declared_language_is_known(spark):
    r = random.Random(12)
    rare = {f"r{i:02d}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for i in range(70)}
    rows = [(i, " ".join(r.choice(LANGS["en"].split()) for _ in range(40)), "en", "a0") for i in range(6000)]
    rows += [(10_000 + 3 * i + k, " ".join(r.choice(words) for _ in range(40)), lang, "a0") for i, (lang, words) in enumerate(rare.items()) for k in range(3)]
    rows += [(20_000, " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(40)), None, "a0")]
    got = {x.doc_id: x for x in language_id.op5_language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].language == lang and got[i].accepted for i, _, lang, _ in rows[:-1])
    assert not got[20_000].accepted  # text in no language is not drawn to a rare one


def test_language_odd_and_empty(odd, nothing):
    rows = language_id.op5_language_id(odd).collect()
    assert len(rows) == odd.count() and not any(r.accepted for r in rows if r.doc_id in (1, 2, 3))
    assert language_id.op5_language_id(nothing).collect() == []


# ---- token counts


def test_edits_count_like_a_new_text():
    known = token_counts.pre_tokens(token_counts.RANKS)
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice("ab '\nll  1s.é") for _ in range(r.randint(0, 1500)))
        tree = token_counts.TokenTree(text, known)
        for _ in range(4):
            a = r.randint(0, len(text))
            b = min(len(text), a + r.choice((0, 1, 3, 50, 700)))
            new = "".join(r.choice("ab '\nll  1s.") for _ in range(r.choice((0, 1, 4, 900))))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert tree.text() == text and len(tree) == len(known.encoding.encode_ordinary(text))
            assert [t for leaf in tree.leaves for t in leaf] == known.split(text)


def test_an_edit_encodes_little():
    known = token_counts.pre_tokens(token_counts.RANKS)
    tree = token_counts.TokenTree("some words and more " * 5000, known)
    tree.edit(50_000, 50_004, "other")
    assert tree.encoded < 10 and len(tree) == len(known.encoding.encode_ordinary(tree.text()))


def test_token_query(spark, odd, nothing):
    known = token_counts.pre_tokens(token_counts.RANKS)
    texts = ["call 5551234 or 99 now", "no numbers", "12345 6789\n0000"]
    for r, text in zip(token_counts.op6_token_counts(make(spark, texts).coalesce(1)).collect(), texts):
        assert r.n_tokens == len(known.encoding.encode_ordinary(text))
        assert r.n_tokens_edited == len(known.encoding.encode_ordinary(re.sub("[0-9]{4,}", "<num>", text)))
    assert token_counts.op6_token_counts(odd).count() == odd.count()
    assert token_counts.op6_token_counts(nothing).collect() == []


# ---- quality


def test_quality_on_rows_held_out(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        good = r.random() < 0.7
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(r.randint(5, 80))]
        rows.append((i, " ".join(words) if good else " ".join(f"{w.upper()}!!" for w in words)))
        labels.append((i, int(good), 0))
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.op7_quality(docs, table).collect()
    truth = {i: q for i, q, _ in labels}
    for x in got:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and x.predicted == int(x.score >= 0.3)
    held = [x for x in got if x.held_out]
    assert len(held) > 80 and sum(x.predicted == truth[x.doc_id] for x in held) / len(held) > 0.97
    # Labels of held-out rows change nothing.
    other = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels], table.schema)
    assert {x.doc_id: x.score for x in quality.op7_quality(docs, other).collect()} == {x.doc_id: x.score for x in got}


def test_word_vectors_come_from_all_documents(spark):
    texts = [(1, "alpha beta gamma"), (2, "delta epsilon delta zeta"), (3, "one"), (4, None)] + [(10 + i, f"word{i} of many") for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    vectors, _ = quality.fit(docs, labels)
    places, signs = quality.index_vectors()
    index = np.zeros((quality.BUCKETS, quality.DIM))
    index[np.arange(quality.BUCKETS)[:, None], places] = signs
    expected = np.zeros_like(index)
    for _, text in texts:
        own, shape = quality.buckets((text or "").split())
        for i in range(len(own) if len(own) > 1 else 0):
            expected[own[i]] += index[shape[i]]
            for j in (i - 1, i + 1):
                if 0 <= j < len(own):
                    expected[own[i]] += index[own[j]]
                    expected[shape[i]] += index[shape[j]]
    expected = index + expected / np.maximum(np.linalg.norm(expected, axis=1, keepdims=True), 1e-6)
    assert np.allclose(vectors, expected, atol=1e-5)
    unlabelled = quality.buckets(["epsilon"])[0][0]
    assert not np.allclose(vectors[unlabelled], index[unlabelled])


def test_quality_odd_and_empty(odd, nothing, spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, None), (None, 1, 1), (7, None, 0), (5, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.op7_quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.op7_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.op7_quality(nothing, labels).collect() == []


# ---- HTML

PAGE = """<!DOCTYPE html><html lang=en><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><p>Site name</p></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><div class="cookie-notice"><p>We use cookies, yes.</p></div>
<!-- <p>hidden</p> --><article class="post"><header class="entry-header"><h1>The &amp;  title</h1></header><p>First <b>para</b>graph,&nbsp;here.<p>Second one.<br>Same block.
<div class="ad"><p>Buy now</p></div><table><tr><td>cell one<td>cell two</table><form><p>Name <input name=x></p></form><aside><p>Aside.</p></aside>
<section id="comments"><p>A reader says this.</p></section></article><div id="sidebar"><p>Side.</p></div><footer>&copy; us</footer></body></html>"""


def test_html_keeps_the_article():
    assert html_text.main_text(PAGE).split("\n") == ["The & title", "First paragraph, here.", "Second one. Same block.", "cell one", "cell two"]


def test_html_without_article_uses_path_ratios():
    text = [f"A sentence with words, number {i}, and some more of them. It goes on." for i in range(6)]
    page = "<body><div class=x>" + "".join(f"<p>{t}</p>" for t in text) + "</div><div>" + "".join(f"<span><a href=/{i}>link {i}</a></span>" for i in range(9)) + "</div></body>"
    assert html_text.main_text(page).split("\n") == text


LONG = "A sentence with words, and some more of them; it goes on. " * 10


def test_html_open_head_ends_with_the_first_element_or_text():
    for rest in ("<body><p>Some words, here.</p>", "<p>Some words, here.", "<div>Some words, here.</div>", "Some words, here."):
        assert html_text.main_text(f"<html><head><title>T</title><meta charset=utf-8><script>x()</script>{rest}") == "Some words, here."


def test_html_ratios_decide_within_main():
    page = f"<body><main><div><h1>Title</h1></div><div><p>{LONG}</p><p>{LONG}</p><ul><li>short</li></ul></div><div>Posted today</div><div><a href=/a>one</a> <a href=/b>two</a></div></main></body>"
    assert html_text.main_text(page).split("\n") == ["Title", LONG.strip(), LONG.strip(), "short"]


def test_html_keeps_references_in_an_article():
    page = f"<body><article><h1>Title</h1><p>{LONG}</p><p>Short one.</p><div><table><tr><td>1<td>2</table></div><section><h2>References</h2><ul><li><a href=/a>first source</a></li><li><a href=/b>second source</a></li></ul></section></article></body>"
    assert html_text.main_text(page).split("\n") == ["Title", LONG.strip(), "Short one.", "1", "2", "References", "first source", "second source"]


def test_html_keeps_short_items_beside_paragraphs_without_article():
    page = f"<body><ul><li><a href=/h>home</a></li></ul><div><h2>Head</h2><p>{LONG}</p><ul><li>one</li><li>two</li></ul><table><tr><td>3<td>4</table><ol><li><a href=/r>source</a></li></ol></div><div>Site info</div></body>"
    assert html_text.main_text(page).split("\n") == ["Head", LONG.strip(), "one", "two", "3", "4", "source"]


def test_html_needs_no_article_tag():
    """The same texts where the page does not mark its article: what decides is ratios and marks of other elements."""
    for page in (PAGE, f"<body><nav><a href=/>home</a></nav><main><h1>Title</h1><p>{LONG}</p><ul><li>one</li></ul><p>{LONG}</p></main><footer>us</footer></body>"):
        plain = re.sub(r"(</?)(article|main)\b", r"\1div", page).replace('<header class="entry-header">', "<div>").replace("</h1></header>", "</h1></div>")
        assert html_text.main_text(plain) == html_text.main_text(page)


@pytest.mark.parametrize("page", ["<a " * 10**6, "<div>" * 100_000 + "x", '<a ">"' * 50_000, "<a '>\"x" * 50_000, "<b>" + "<div>" * 20_000 + "</b>" * 20_000, "<!-- " * 200_000, "</x" * 200_000, '<a x="' * 200_000 + ">", "<script>" * 100_000])
def test_html_reads_any_page_in_one_pass(page):
    begun = time.process_time()
    assert isinstance(html_text.main_text(page), str)
    assert time.process_time() - begun < 20


def test_html_paths_score_as_ratios_of_their_blocks():
    """path_scores against the same sums done plainly on paths as lists of tags."""
    page = f"<body><div><p>{LONG}</p><p>Short.</p><div><a href=/>{'link ' * 9}</a></div><ul><li>a, b</li><li>c</li></ul></div><div><p>Else, here.</p></div></body>"
    found, paths = html_text.blocks(page)

    def tags(p):
        return (*tags(paths.parent[p]), paths.tag[p]) if p else ()

    assert [tags(b.path)[1:] for b in found] == [("div", "p"), ("div", "p"), ("div", "div"), ("div", "ul", "li"), ("div", "ul", "li"), ("div", "p")]
    scores = {tags(p): x for p, x in html_text.path_scores(found, paths).items()}
    by = {}
    for b in found:
        by.setdefault(tags(b.path), []).append(b)
    raw = {}
    for p, own in by.items():
        chars, marks, links = sum(len(b.text()) for b in own), sum(b.text().count(",") + b.text().count(".") + b.text().count(";") for b in own), sum(b.links for b in own)
        raw[p] = np.log1p(chars / len(own)) * max(0, 1 - links / chars) * (1 + np.log1p(marks / len(own)))
    order = list(by)
    for i, p in enumerate(order):
        near = [raw[q] for q in order[max(0, i - 1) : i + 2] if q[:-1] == p[:-1]]
        assert scores[p] == pytest.approx(0.5 * raw[p] + 0.5 * sum(near) / len(near))


def test_html_odd_tables(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t", 5), (1, "u", PAGE, "t", 5), (None, None, None, None, None), (2, "v", "<p>" + "word " * 100_000, "t", 1)], "page_id long, url string, html string, text string, n_chars long")
    rows = html_text.op8_html(pages).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in rows) == sorted([("1", len(html_text.main_text(PAGE)))] * 2 + [("None", 0), ("2", 499_999)])


@pytest.mark.parametrize("page", ["", "<", "<p", "no tags", "<p>a<p", "</p></div>x", "<script>never closed", "<!-- never closed", "&#xfffffff; &bogus;", "<a href='>'>q</a>", "<p>" * 3000 + "deep"])
def test_html_never_breaks(page):
    assert isinstance(html_text.main_text(page), str)


def test_html_query(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "v", "<p>x</p>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.op8_html(pages).collect()}
    assert got[2].text == "" and got[2].n_chars == 0 and got[1].n_chars == len(got[1].text) and got[None].text == "x"
    assert html_text.op8_html(pages.limit(0)).collect() == []


# ---- lines


def brute_lines(rows):
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(strip))
    docs = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                docs.setdefault(key(line), set()).add(-1 if d is None else d)
    out = []
    for d, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if len(docs.get(key(x), ())) < 5 or max(docs[key(x)]) == (-1 if d is None else d)]
        out.append((-1 if d is None else d, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def line_rows():
    """Shared lines in several spellings; rows that are repeated, ids with several texts, rows without an id."""
    r = random.Random(4)
    pool = ["A long line that many documents share, number %d." % i for i in range(12)] + ["short"] + ["é" * 40, "É" * 40, "x" * 39, "", "  "]
    text = lambda: "\n".join(r.choice(("", " ", "\t")) + (x.upper() if r.random() < 0.2 else x) + r.choice(("", "\r", " ")) for x in r.choices(pool, k=r.randint(0, 8)))
    rows = [(i * 3, text()) for i in range(80)] + [(1, None), (2, "")]
    alone = "This line is in four documents only, however often they come."
    rows += [(d, alone) for d in (300, 301, 302, 303) for _ in range(4)] + [(304, text()), (304, text())]
    five = "This line is in four documents and in some without an id at all."
    return rows + [(d, five) for d in (310, 311, 312, 313)] + [(None, five), (None, f"{five}\nmore"), (None, None)]


def test_lines_match_brute_force(spark):
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.op9_line_dedup(docs).collect()
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.n_lines, x.n_dropped, x.kept_sha256) for x in got) == brute_lines(rows)


def test_line_sql_matches_brute_force():
    import duckdb
    import pandas as pd

    rows = line_rows()
    documents = pd.DataFrame({"doc_id": pd.array([d for d, _ in rows], "Int64"), "text": [t for _, t in rows]})  # noqa: F841
    got = duckdb.sql(line_dedup.SQL).fetchall()
    assert sorted((-1 if d is None else d, *rest) for d, *rest in got) == brute_lines(rows)


def test_runs_compact_and_find_what_is_new(spark):
    line = lambda i: f"This is line number {i:04d}, and it is long enough to count."
    runs = line_dedup.LineRuns(spark, fanout=3)
    for b in range(7):
        batch = spark.createDataFrame([(100 * b + i, line(i + 5 * b)) for i in range(10)], "doc_id long, text string")
        new = runs.unseen(batch)
        assert new.count() == (10 if b == 0 else 5)
        runs.add(batch)
    assert sorted(level for level, _ in runs.runs) == [0, 1, 1]
    assert sum(runs._run(name).count() for _, name in runs.runs) == 40  # a hash is in one run only
    merged = runs.merged()
    assert merged.count() == 40 and merged.agg({"n_docs": "sum"}).first()[0] == 70
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = runs.unseen(spark.createDataFrame([(1, line(1))], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1  # the batch moves, the runs do not
    runs.drop()


def test_lines_odd_and_empty(odd, nothing):
    out = line_dedup.drop_repeated_lines(odd)
    assert out.columns == [*odd.columns, "n_lines", "kept_lines"] and out.count() == odd.count()
    clash = odd.withColumn("n_lines", odd.text).withColumn("h2", odd.text).withColumn("is_new", odd.text)
    out = line_dedup.drop_repeated_lines(clash)
    assert out.columns == [*odd.columns, "h2", "is_new", "n_lines", "kept_lines"] and out.count() == odd.count()
    assert line_dedup.op9_line_dedup(nothing).collect() == []


def test_line_plan_is_native(spark):
    plan = line_dedup.op9_line_dedup(make(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


# ---- decontamination


ITEM = "If a farmer sells 12 apples for 3 dollars each on market day how much money does the farmer take home in the evening"


def bench(spark):
    return spark.createDataFrame([(1, ITEM), (2, "Short one."), (3, None), (4, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho")], "item_id long, text string")


def test_templates_find_passages_and_new_numbers(spark):
    filler = "some quite different words that nobody asked for in this place "
    texts = [
        filler * 3 + ITEM + " " + filler, filler * 4, ITEM.upper().replace(" ", "!! "), filler + ITEM.replace("12", "47").replace("3 dollars", "9 euros") + filler,
        filler + " ".join(ITEM.split()[:14]), "Short one.", None, "", filler + "alpha beta gamma delta epsilon zeta eta theta but then something else",
    ]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.op10_decontaminate(make(spark, texts), bench(spark)).collect()}
    assert {k for k in got} == {(0, 1), (2, 1), (3, 1), (4, 1), (5, 2)}
    assert got[3, 1].n_reworded > 0 and got[0, 1].n_reworded == 0 and got[0, 1].n_windows == got[0, 1].item_windows


def test_slots_must_be_consistent():
    fits = lambda found: decontaminate.consistent(found, {})
    assert list(fits([(0, "47", "12"), (1, "47", "12"), (2, "48", "12")])[0]) == [0, 1]
    assert fits([(0, "", ""), (1, "", ""), (3, "", "")])[:2] == ({0: False, 1: False, 3: False}, 3)
    assert fits([(0, "5\n6", "4\n4"), (1, "5\n5", "4\n4")])[0] == {1: True}  # one value can't stand for two
    assert decontaminate.best_match([[(0, "48", "12"), (1, "48", "12")], [(i, "12", "12") for i in range(5)]]) == (5, 5, 0)
    assert decontaminate.best_match([[(0, "", ""), (1, "", "")], [(5, "", ""), (6, "", ""), (7, "", "")]]) == (5, 3, 0)  # words put in between


def test_an_earlier_partial_quote_takes_nothing_away(spark):
    filler = "some quite different words that nobody asked for in this place "
    early = " ".join(ITEM.replace("12", "99").split()[:14])
    texts = [filler + early + " " + filler + ITEM + " " + filler, filler + " ".join([ITEM] * 30), filler + " ".join(ITEM.split()[:11]) + " indeed and truly " + " ".join(ITEM.split()[11:])]
    got = {r.doc_id: r for r in decontaminate.matches(make(spark, texts), bench(spark)).collect()}
    assert all(got[i].n_windows == got[i].longest_run == got[i].item_windows and got[i].n_reworded == 0 for i in (0, 1))
    assert got[2].longest_run < got[2].n_windows < got[2].item_windows  # both parts count


def test_matches_equal_brute_force(spark):
    """The same windows compared one by one, without hashes sent, filters or joins."""
    r = random.Random(6)
    words = "the farmer sells apples pears to every town near river and takes money home each day because it rains".split()
    sentence = lambda n: " ".join(r.choice(words) if r.random() < 0.85 else r.choice(("12", "Paris", "7", "km", "3")) for _ in range(n))
    items = [(i, sentence(r.choice((4, 7, 12, 30)))) for i in range(12)] + [(None, sentence(15)), (50, None), (51, "...")]
    docs = [(i, sentence(30) + " " + " ".join(r.choice(items)[1] or "" for _ in range(r.randint(0, 3))) + " " + sentence(10)) for i in range(60)] + [(None, items[3][1]), (90, None), (91, "")]
    docs += [(100 + i, sentence(8) + " " + text.replace("12", "13").replace("Paris", "Rome")) for i, text in items[:12]]
    expected = {}
    for item, text in items:
        codes, kind, own, plain = decontaminate.template(text or "")
        width = min(decontaminate.WINDOW, len(codes))
        hashes, at = decontaminate.windows(codes, kind)
        rows = [(h, p, decontaminate.slots(own, kind, p, width), width, False) for h, p in zip(hashes, at)]
        if width < decontaminate.WINDOW or not len(at):
            rows += [(h, p, "", width, True) for p, h in enumerate(decontaminate.exact_windows(plain))]
        for doc, body in docs:
            codes, kind, own, plain = decontaminate.template(body or "")
            places = {}
            for h, p, s, width, exact in rows:
                if width > len(codes):
                    continue
                if exact:
                    found = [(q, "") for q in np.flatnonzero(decontaminate.exact_windows(plain, width) == h)[:1]]
                else:
                    hs, qs, second = decontaminate.with_sentence_starts(codes, kind, plain, width)
                    found = [(q, decontaminate.slots(own, kind, q + int(x), width - int(x))) for g, q, x in zip(hs, qs, second) if g == h]
                    if width < decontaminate.WINDOW:
                        found = [(q, t) for q, t in found if len(set(zip(t.split("\n"), s.split("\n")))) == len(set(s.split("\n"))) and t.count("\n") == s.count("\n")]
                for q, t in found:
                    places.setdefault(q - p, set()).add((int(p), t, s))
            if places:
                distinct = {}
                for offset in sorted(places):
                    distinct.setdefault(tuple(sorted(places[offset])), offset)
                expected[doc, item] = (*decontaminate.best_match([list(f) for f in distinct]), len({p for _, p, *_ in rows}))
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id): (x.n_windows, x.longest_run, x.n_reworded, x.item_windows) for x in got} == expected and len(expected) > 60


def test_short_items_are_found_in_long_documents(spark):
    filler = "some quite different words that nobody asked for in this place. "
    sums, town, seven = "What is 12 + 34 * 56 - 78?", "Paris Lyon 7 km 8 km Rome 9 km Oslo", "the farmer sells 5 apples and 5"
    items = spark.createDataFrame([(1, "Short one."), (2, sums), (3, town), (4, seven)], "item_id long, text string")
    texts = [
        filler * 2 + "a short one, " + filler, filler + sums + " " + filler * 2, filler + sums.replace("34", "35") + filler, filler + town + " " + filler, filler + town.replace("7", "6") + " " + filler,
        filler + "Then the farmer sells 6 apples and 6 " + filler, filler + "then the farmer sells 6 apples and 7 " + filler, filler + seven.replace("5", "4", 1) + " " + filler + seven, filler * 4, "one short", "short ONE",
    ]
    found = decontaminate.matches(make(spark, texts), items)
    got = {(r.doc_id, r.item_id): r for r in found.where(decontaminate.contaminated(found)).collect()}
    assert set(got) == {(0, 1), (1, 2), (3, 3), (5, 4), (7, 4), (10, 1)}
    assert got[5, 4].n_reworded == 1 and got[7, 4].n_reworded == 0 and all(r.n_windows <= r.item_windows for r in got.values())


def test_decontamination_odd_and_empty(odd, nothing, spark):
    assert decontaminate.op10_decontaminate(odd, bench(spark)).collect() == []
    assert decontaminate.op10_decontaminate(nothing, bench(spark)).collect() == []
    assert decontaminate.op10_decontaminate(odd, bench(spark).limit(0)).collect() == []
    clash = bench(spark).selectExpr("item_id", "text", "'x' AS hash", "'y' AS doc_id").unionByName(spark.createDataFrame([(None, ITEM, "x", "y"), (1, ITEM, "x", "y")], "item_id long, text string, hash string, doc_id string"))
    docs = spark.createDataFrame([(None, ITEM, 1), (7, ITEM, 2), (7, ITEM, 2)], "doc_id long, text string, offset int")
    assert sorted((str(r.doc_id), str(r.item_id)) for r in decontaminate.op10_decontaminate(docs, clash).collect()) == [("7", "1"), ("7", "None"), ("None", "1"), ("None", "None")]


def test_bloom_filters_lose_nothing(spark):
    own = [3 * i - 10**6 for i in range(5000)]
    bits = filters.bloom_filter(spark.createDataFrame([(x,) for x in own], "x long"))
    assert filters.passes(np.array(own), bits).all() and filters.passes(np.array([x + 1 for x in own]), bits).mean() < 0.02
    assert not filters.passes(np.array(own), filters.bloom_filter(spark.createDataFrame([], "x long"))).any()
