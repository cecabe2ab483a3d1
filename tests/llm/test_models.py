"""Language, quality, token counts, media, packing, nearest neighbours."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from folioframe.llm import hash_forest, langid, media, packing, quality, wordpiece


def read(spark, data, name):
    return spark.read.parquet(f"{data}/{name}.parquet")


# ---- language ---------------------------------------------------------------------------


def test_language_on_held_out_rows(spark, data):
    docs = read(spark, data, "documents")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_rows(spark, odd):
    names = ["de", "en"]
    model = langid.train(["der die und"] * 4 + ["the of and"] * 4, ["de"] * 4 + ["en"] * 4, epochs=1)
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.predict(odd, model).collect()}
    assert {i for i, p in got if p == "und"} == {1, 2, 6}
    assert all(p in names for i, p in got if i in (3, 4, 7))
    assert {r["lang_pred"] for r in langid.predict(odd, None).collect()} == {"und"}
    kept = langid.known_language(odd, model, 0.0)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {None, 3, 4, 5, 7}
    assert langid.identify(odd.limit(0)).collect() == []


def test_windows_cover_all_bytes():
    data = bytes(random.Random(1).choices(range(97, 123), k=1000))
    w = langid.windows_of(data)
    step = langid.WINDOW - max(langid.WIDTHS) + 1
    assert b"".join(bytes(x[:step]) for x in w[:-1]) + bytes(w[-1]) == data.ljust(step * (len(w) - 1) + langid.WINDOW)


def test_peaks_against_a_plain_convolution():
    model = langid.train(["der die und das ist"] * 3 + ["the of and is that"] * 3, ["de"] * 3 + ["en"] * 3, epochs=1)
    text = ("Der Mann and the \n woman é漢 " * 30).encode()
    want = []
    for w in langid.windows_of(text):
        rows = []
        for f in model.filters:
            width = len(f)
            places = [[sum(float(f[k][w[at + k]][c]) for k in range(width)) for c in range(langid.FILTERS)] for at in range(len(w) - width + 1)]
            rows += [max(p[c] for p in places) for c in range(langid.FILTERS)]
        want.append(rows)
    assert np.allclose(model.peaks(langid.windows_of(text)), want, atol=1e-4)
    h = np.maximum(np.array(want) + model.bias, 0) @ model.weight + model.offset
    e = np.exp(h.mean(axis=0) - h.mean(axis=0).max())
    assert np.allclose(langid.shares(model, text), e / e.sum(), atol=1e-4)


def test_every_language_is_learned(spark):
    """More languages than any round number: each has letters of its own."""
    rows = []
    for n in range(70):
        a, b = chr(0x4E00 + 97 * n), chr(0x4E00 + 97 * n + 31)
        rows += [(n * 100 + i, f"{a}{b} {b}{a}{a} " * 6, f"l{n:02}") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.languages) == 70


# ---- quality ----------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark, data):
    docs, labels = read(spark, data, "documents"), read(spark, data, "labels")
    got = quality.classify(docs, labels).join(labels, "doc_id").collect()
    held = [(r["score"], r["quality"]) for r in got if r["held_out"]]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([a > b for a in good for b in bad]) >= 0.95
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in got)


@pytest.mark.parametrize("share", [0.15, 0.5, 0.85])
def test_class_prior_from_positives_and_unlabelled(share):
    """Two kinds of rows that overlap, of a known mixture; no row is known to be of the second kind."""
    rng = np.random.default_rng(2)
    n = int(4000 * share)
    positive = rng.normal(0, 1, (1500, 12)) + 0.8
    unlabelled = np.concatenate([rng.normal(0, 1, (n, 12)) + 0.8, rng.normal(0, 1, (4000 - n, 12)) - 0.3])
    assert abs(quality.class_prior(positive, unlabelled) - share) < 0.08


def test_quality_reads_no_bad_labels(spark, data):
    docs, labels = read(spark, data, "documents"), read(spark, data, "labels")
    with_bad, without = (quality.fit(docs, x) for x in (labels, labels.filter("quality = 1")))
    assert np.array_equal(with_bad.hidden, without.hidden)


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (3, 0, 0), (7, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd, labels).collect()
    assert len(got) == 9 and all(0 <= r["score"] <= 1 for r in got)
    same = {r["score"] for r in got if r["doc_id"] in (4, 5)}
    assert len(same) == 1
    assert {r["score"] for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(odd.limit(0), labels).collect() == []


# ---- token counts -------------------------------------------------------------------------


def greedy(word, vocabulary):
    n = at = 0
    while at < len(word):
        at = next(j for j in range(len(word), at, -1) if word[at:j] in vocabulary or j == at + 1)
        n += 1
    return n


def test_automaton_against_greedy():
    rng = random.Random(5)
    for _ in range(60):
        vocabulary = {bytes(rng.choices(b"abc", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 25))}
        automaton = wordpiece.Automaton(vocabulary)
        for _ in range(40):
            word = bytes(rng.choices(b"abcd", k=rng.randint(0, 25)))
            assert automaton.count(word) == greedy(word, vocabulary)


def test_token_counts(spark, odd):
    vocabulary = set(wordpiece.read_vocabulary(wordpiece.default_vocabulary()))
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in wordpiece.token_counts(odd).collect()}
    assert got[1] == got[2] == got[6] == (0, 0)
    assert got[3] == (30000, 30000)
    words = "é ß 漢字 𝒳".encode().split()
    assert got[7] == (4, sum(greedy(b" " + w, vocabulary) for w in words))
    assert wordpiece.token_counts(odd.limit(0)).collect() == []


# ---- media ------------------------------------------------------------------------------


def test_png_round_trip():
    for n in (1, 192, 193, 5000):
        payload = media.padded(bytes(random.Random(n).randbytes(n)))
        png = media.to_png(payload)
        assert len(payload) % 192 == 0 and media.from_png(png).tobytes() == payload
        with pytest.raises(ValueError):
            media.from_png(png[:40] + bytes([png[40] ^ 1]) + png[41:])


def test_sequences_keep_order_and_captions():
    page = '<p>One <b>two</b></p><script>no</script><figure><img src="a"><img src="b"><figcaption>Cap &amp; tion</figcaption></figure><p>three<img src="c" alt="alt">four'
    got = [(x["pos"], x["kind"], x["text"] or x["ref"], x["caption"]) for x in media.parse_html(page)]
    assert got == [(0, "text", "One two", None), (1, "media", "a", "Cap & tion"), (2, "media", "b", "Cap & tion"), (3, "text", "three", None), (4, "media", "c", "alt"), (5, "text", "four", None)]
    assert media.parse_html(None) == media.parse_html("") == []


def test_unresolved_references_stay(spark):
    pages = spark.createDataFrame([(1, '<p>x</p><img src="k">'), (2, '<img src="gone">'), (3, None)], "page_id long, html string")
    store = spark.createDataFrame([("k", 5)], "digest string, size int")
    got = sorted((r["page_id"], r["pos"], r["ref"], r["size"]) for r in media.resolved(media.sequences(pages, "page_id"), "page_id", store).collect() if r["kind"] == "media")
    assert got == [(1, 1, "k", 5), (2, 0, "gone", None)]


def test_documents_as_media(odd):
    """Every column against values that are made from the texts here."""
    got = media.documents_as_media(odd).collect()
    assert len(got) == 9
    want = {r["doc_id"]: (r["text"] or "").encode() for r in odd.collect()}
    for r in got:
        text = want[r["doc_id"]]
        payload = text + b" " * (192 if not text else -len(text) % 192)
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(text), len(payload), zlib.crc32(payload[-16:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        png = media.to_png(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(png), hashlib.sha256(png).hexdigest())
        channels = [list(payload[c::3]) for c in range(3)]
        means = [sum(c) / len(c) for c in channels]
        sds = [math.sqrt(max(0, sum(v * v for v in c) / len(c) - m * m)) for c, m in zip(channels, means, strict=True)]
        parts = dict(x.split("=") for x in r["feature"].split(";"))
        assert [float(x) for x in parts["mean"].split(",")] == pytest.approx(means, abs=1e-3)
        assert [float(x) for x in parts["sd"].split(",")] == pytest.approx(sds, abs=1e-3)
        assert [int(x) for x in parts["hist"].split(",")] == [sum(b >> 4 == k for b in payload) for k in range(16)]
        name = "without id" if r["doc_id"] is None else r["doc_id"]
        assert r["pos"] % 2 == 1 and r["caption"] == f"Document {name} of {len(text)} bytes"
    assert len({r["feature"] for r in got if r["doc_id"] in (4, 5)}) == 1
    assert media.documents_as_media(odd.limit(0)).collect() == []


def test_pages_interleave_several_references(spark, data):
    """Raw pages with references and paragraphs added: order, captions and payloads of all of them; other references stay unresolved."""
    pages = [(r["page_id"], r["html"]) for r in read(spark, data, "pages").select("page_id", "html").collect()]
    pages = [(i, (h or "") + "".join(f'<p>para {k} of {i}</p><figure><img src="d{(i + k) % 7}"><figcaption>cap {k}</figcaption></figure>' for k in range(3))) for i, h in pages]
    store = spark.createDataFrame([(f"d{k}", 10 * k, "clash", 9) for k in range(6)], "digest string, size int, caption string, pos int")
    df = spark.createDataFrame(pages, "page_id long, html string")
    got = {}
    for r in media.resolved(media.sequences(df, "page_id"), "page_id", store).collect():
        got.setdefault(r["page_id"], []).append(r)
    assert len(got) == len(pages)
    for i, _ in pages:
        rows = sorted(got[i], key=lambda r: r["pos"])
        assert [r["pos"] for r in rows] == list(range(len(rows)))
        tail = [(r["kind"], r["text"] or r["ref"], r["caption"], r["size"]) for r in rows[-6:]]
        want = []
        for k in range(3):
            d = (i + k) % 7
            want += [("text", f"para {k} of {i}", None, None), ("media", f"d{d}", f"cap {k}", 10 * d if d < 6 else None)]
        assert tail == want


# ---- packing ------------------------------------------------------------------------------


def test_ids_are_those_of_the_tokenizer(spark, data):
    """The whole table and odd texts, against the tokenizer library as it is."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r["text"] or "" for r in read(spark, data, "documents").select("text").collect()]
    texts += ["", " ", "\n", "a \n b", "a\n\nb", "  two  spaces ", "tab\tand\r\nend\n", "it's we'll 'twas", "é漢字𝒳\u200bx", "\u00a0nbsp a b", "a ", "\na", "<|endoftext|>", "x<|endoftext|> y", "１２ 3½", " \x1c\x85 z"]
    ids = packing.encoder(packing.default_ranks()).document_ids
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids(text), "<u4").tolist() == want.ids, repr(text[:80])


def test_sequences_are_few(spark, data):
    """No packing has fewer sequences than the pieces' tokens fill, nor than pieces of over half a sequence; one more is allowed for."""
    rows = packing.pack_documents(read(spark, data, "documents")).select("length", "sequence_id").collect()
    least = max(-(-sum(r["length"] for r in rows) // packing.CAPACITY), sum(2 * r["length"] > packing.CAPACITY for r in rows))
    assert least <= len({r["sequence_id"] for r in rows}) <= least + 1


def test_special_token_has_its_id(docs_of):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>\ny", "<|endoftext|><|endoftext|>", " <|endoftext|>  z\n", "a  b<|endoftext|>  c", "<|endoftext", "no such token", ""]
    rows = packing.pieces(docs_of(list(enumerate(texts))), with_ids=True).collect()
    for text, row in zip(texts, sorted(rows, key=lambda r: r["doc_id"]), strict=True):
        assert row["ids"] == tokenizer.encode(text, add_special_tokens=False).ids + [packing.END_ID], repr(text)


def test_plan_is_feasible_and_full():
    rng = random.Random(6)
    for n, capacity in ((1, 10), (40, 10), (500, 64), (300, 2048)):
        lengths = [rng.randint(1, capacity) for _ in range(n)]
        counts = {x: lengths.count(x) for x in set(lengths)}
        bins = packing.plan(counts, capacity)
        used = {}
        for times, chosen in bins:
            assert sum(x * k for x, k in chosen.items()) <= capacity
            for x, k in chosen.items():
                used[x] = used.get(x, 0) + k * times
        assert used == counts
        total = sum(t for t, _ in bins)
        assert total <= max(math.ceil(sum(lengths) / capacity), sum(x > capacity / 2 for x in lengths)) * 1.1 + 1


def test_fullest_against_brute_force():
    from itertools import product

    rng = random.Random(7)
    for _ in range(80):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(4)}
        room = rng.randint(0, 30)
        best = max(s for s in (sum(x * k for x, k in zip(counts, ks, strict=True)) for ks in product(*(range(n + 1) for n in counts.values()))) if s <= room)
        used = packing.fullest(counts, room)
        assert sum(x * k for x, k in used.items()) == best and all(k <= counts[x] for x, k in used.items())


def test_packing(odd):
    rows = packing.pack_documents(odd, capacity=64, with_ids=True).collect()
    by_doc, bins = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by_doc[4]) == 2 and len({r["sequence_id"] for r in by_doc[1] + by_doc[2]}) >= 1
    long = sorted(by_doc[3], key=lambda r: r["piece"])
    assert [r["piece"] for r in long] == list(range(len(long))) and {r["length"] for r in long[1:]} == {64}
    assert sum(r["length"] for r in long) == long[-1]["start"] + long[-1]["length"] == 30002
    assert packing.pack_documents(odd.limit(0)).collect() == []


# ---- nearest neighbours -----------------------------------------------------------------------


def test_forest_against_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, 16)) * rng.uniform(0.5, 2, (600, 1))
    x[50:90] = x[50] / np.linalg.norm(x[50]) * 1.01 * np.linalg.norm(x, axis=1).max()  # copies, longer than all others
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in hash_forest.nearest(df, df.filter("vec_id % 20 = 0"), k=10, least=100, shard=150, chunk=9).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 600, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(600), -np.round(s, 12)))[:10]
        found = [v for _, v, _ in sorted(got[q])]
        assert [n for n, _, _ in sorted(got[q])] == list(range(1, 11))
        assert np.allclose([c for _, _, c in sorted(got[q])], s[found])
        hits += len(set(found) & set(want.tolist()))
    assert hits >= 0.9 * 300
    assert [v for _, v, _ in sorted(got[60])] == [v for v in range(50, 90) if v != 60][:10]


def test_forest_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [0.5, 0.5]), (6, [0.5, 0.5]), (None, [1.0, 1.0]), (20, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, hash_forest.nearest(df, df.filter("vec_id % 20 = 0")).collect()))
    assert got == [(0, 1, 6, 0.5), (0, 2, 20, 0.0), (20, 1, 6, 1.0), (20, 2, 0, 0.0)]
    assert hash_forest.nearest(df.limit(0), df.limit(0)).collect() == []


def test_forest_ties_go_to_the_smaller_id(spark):
    """One query, and unit vectors that all have the same product with it."""
    rows = [(0, [1.0] * 32)] + [(i, [1.0 if j == (i * 7) % 32 else 0.0 for j in range(31)] + [0.0 if (i * 7) % 32 < 31 else 1.0]) for i in range(1, 33)]
    rows = [(i, v, "x", 0.1) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, members string, score double")
    got = hash_forest.nearest(df, df.filter("vec_id = 0"), k=7, least=33, shard=10).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, 1.0) for i in range(1, 8)]


def test_forest_descends_to_the_longest_prefix_and_ascends():
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((300, 12)), rng.standard_normal((9, 12))
    forest = hash_forest.Forest(x, trees=6)
    text = lambda h: f"{int(h) & (1 << hash_forest.BITS) - 1:0{hash_forest.BITS}b}"
    longest = float(np.sqrt((x * x).sum(axis=1).max()))
    held = hash_forest.hash_strings(x, longest, forest.directions)
    asks = hash_forest.hash_strings(q, 0.0, forest.directions)

    def common(a, b):
        return next((i for i, (s, t) in enumerate(zip(text(a), text(b), strict=True)) if s != t), hash_forest.BITS)

    lengths = np.array([[[common(asks[i, t], held[j, t]) for j in range(300)] for t in range(6)] for i in range(9)])
    assert (forest.descend(asks) == lengths.max(axis=2)).all()
    for want in (1, 40, 500, 1800):
        found = forest.candidates(q, want)
        for i in range(9):
            depth = next(d for d in range(hash_forest.BITS, -1, -1) if (lengths[i] >= d).sum() >= want)
            assert (found[i] == (lengths[i] >= depth).any(axis=0)).all()


@pytest.mark.parametrize("n", [500, 2000, 10_000])
def test_forest_recall(spark, n):
    """Unit vectors without any structure, the hardest case: recall and the share of pairs scored, with the default forest."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got, step = {}, n // 50
    for r in hash_forest.nearest(df, df.filter(f"vec_id % {step} = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for i in range(0, n, step):
        s = x @ x[i]
        s[i] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & got[i])
    assert hits >= 0.9 * 20 * 50
    if n < 10_000:
        return
    scored = hash_forest.Forest(x[:8192]).candidates(x[::200], 0.4 * 8192).mean()
    assert scored <= 0.45
