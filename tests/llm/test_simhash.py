import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioframe.llm import simhash


def brute(text, words=4):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, fps, bits=4):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    seen = list(root)
    for i, a in enumerate(seen):
        for b in seen[:i]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    least = {}
    for i, f in zip(ids, fps, strict=True):
        r = find(f)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [least.get(find(f)) for f in fps]


def test_golay_decodes_within_three_bits():
    rng = random.Random(1)
    for _ in range(200):
        w = rng.getrandbits(23)
        i = int(simhash.decode(np.array([w]))[0])
        code = next(c for c in [i << 11 | r for r in range(2048)] if simhash._HIGH[c >> 11] ^ (c & 0x7FF) == 0)
        assert (code ^ w).bit_count() <= 3


def test_keys_meet_within_four_bits():
    rng = random.Random(2)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        row, key = simhash.golay_keys(np.array([a, b], np.uint64).view(np.int64))
        assert set(key[row == 0]) & set(key[row == 1])


def test_against_brute_force(spark, docs_of):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        w = [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))]
        rows.append((i, " ".join(w)))
        if i % 3 == 0 and len(w) > 20:
            w[rng.randrange(len(w))] = "Other"
            rows.append((100 + i, "\t".join(w)))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(rows)).collect()}
    fps = [brute(t) for _, t in rows]
    want = groups([i for i, _ in rows], fps)
    assert [got[i]["fingerprint"] for i, _ in rows] == [f"{f:016x}" for f in fps]
    assert [got[i]["component_id"] for i, _ in rows] == want


def test_large_groups_are_dealt_in_blocks(spark):
    rng = random.Random(4)
    fps = {0}
    while len(fps) < 120:  # a dense cloud around 0
        f = 0
        for bit in rng.sample(range(64), rng.randint(1, 5)):
            f ^= 1 << bit
        fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), block=8)
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    want = groups(signed, list(fps))
    assert [roots.get(f, f) for f in signed] == want


def test_odd_rows(odd):
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(odd).collect()))
    assert [(i, c) for n, i, c in got if not n] == [(1, 1), (2, 1), (3, 3), (4, 4), (4, 4), (5, 4), (6, 1), (7, 7)]
    assert [c for n, _, c in got if n] == [None]
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 7]
    assert simhash.near_duplicates(odd.limit(0)).collect() == []
    assert simhash.one_of_each(odd.limit(0)).collect() == []


def test_long_texts_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 50)
    assert simhash.fingerprint(text) == whole == brute(text.decode())


def five_words(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_similar_texts_against_brute_force(spark, docs_of, monkeypatch):
    """Copies of similarity about 0.8, which differ in more than four bits; whole and in pairs of blocks."""
    rng = random.Random(11)
    rows = [(900, ""), (901, None), (902, "one two"), (903, "One  two")]
    for i in range(40):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(30, 300))]
        rows.append((i, " ".join(w)))
        for c in range(2):
            v = list(w)
            for _ in range(max(1, len(w) // rng.choice((50, 60, 70)))):
                v[rng.randrange(len(v))] = "other"
            rows.append((100 * (c + 1) + i, " ".join(v)))
    sets = [five_words(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    border = 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or len(x & y) >= 0.8 * len(x | y):
                border += x != y and len(x & y) < 0.9 * len(x | y) and (brute(rows[i][1]) ^ brute(rows[j][1])).bit_count() > 4
                root[find(i)] = find(j)
    assert border >= 20
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    want = {doc: least[find(i)] for i, (doc, _) in enumerate(rows)}
    docs = docs_of(rows)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(docs).collect()} == want
    kept = simhash.one_of_each(docs, words=5, similarity=0.8)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    monkeypatch.setattr(simhash, "TEXTS", 1)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(docs).collect()} == want
    # Everything in one group of candidates: most of it is left after the first block, and meets every block.
    monkeypatch.setattr(simhash, "TEXTS", 40)
    monkeypatch.setattr(simhash, "_verified", lambda keyed, *_: keyed.select(F.min("check0").over(Window.partitionBy(F.lit(0))).alias("a"), F.col("check0").alias("b")).distinct())
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(docs).collect()} == want
    assert simhash.similar_texts(docs.limit(0)).collect() == []


def test_each_text_of_an_id_is_judged_by_itself(docs_of):
    a, b, c = "the first text of all with its words", "a second text that is like no other one", "one more that stands alone in here"
    docs = docs_of([(1, a), (1, b), (2, b), (2, c), (3, a), (3, a)])
    for by in ({}, {"words": 5, "similarity": 0.8}):
        got = sorted((r["doc_id"], r["text"]) for r in simhash.one_of_each(docs, **by).collect())
        assert got == sorted([(1, a), (1, b), (2, c)])


def long_bits(text):
    """SimHash sums of the set of five-word shingles, bit by bit, for the bits of the check and of the segments."""
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in five_words(text)]
    out, most = [], (1 << 64) - 1
    for flip, factor, mix in zip(simhash._FLIPS.tolist(), simhash._FACTORS.tolist(), simhash._MIX.tolist(), strict=True):
        xs = [(x ^ flip) * factor & most for x in h]
        xs = [(x ^ x >> 32) * mix & most for x in xs]
        xs = [x ^ x >> 29 for x in xs]
        # Byte by byte from the lowest, bits of a byte from the highest.
        out += [sum(1 if x >> 8 * (b // 8) + 7 - b % 8 & 1 else -1 for x in xs) for b in range(64)]
    return np.array(out)


def test_soft_decoding_gives_the_nearest_codewords():
    rng = np.random.default_rng(6)
    sums = rng.integers(-300, 300, (40, 23))
    index, loss = simhash.soft_decode(sums, 4)
    for s, found, less in zip(sums, index, loss, strict=True):
        agree = []
        for i in range(4096):
            code = i << 11 | int(simhash._HIGH[i])
            assert int(simhash.decode(np.array([code]))[0]) == i
            agree.append(sum(int(x) if code >> b & 1 else -int(x) for b, x in enumerate(s)))
        best = sorted(range(4096), key=lambda i: (-agree[i], i))[:4]
        assert found.tolist() == best and less.tolist() == [agree[best[0]] - agree[i] for i in best]


def test_candidates_of_similar_texts_have_golay_keys_of_their_simhash(docs_of):
    """Each key joins codewords that two segments of the long SimHash decode to, written apart from the operator."""
    rng = random.Random(7)
    texts = ["one two three", *(" ".join(f"W{rng.randrange(900)}" for _ in range(n)) for n in (8, 60, 700))]
    rows = simhash._sets(docs_of([*enumerate(texts), (8, ""), (9, None)]), 5).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 6 and got[8]["keys"] == got[9]["keys"] == [] and got[8]["fp"] == got[9]["fp"] == 0
    for i, text in enumerate(texts):
        sums = long_bits(text)
        bits = np.packbits(sums[:256] > 0).view(np.int64).tolist()
        assert [got[i][f"check{k}"] for k in range(4)] == bits
        index, loss = simhash.soft_decode(sums[256:][: 14 * 23].reshape(14, 23), 8)
        want = []
        for band in range(7):
            a, b = 2 * band, 2 * band + 1
            joint = sorted((loss[a, x] + loss[b, y], x, y) for x in range(8) for y in range(8))[:16]
            want += [band << 24 | int(index[a, x]) << 12 | int(index[b, y]) for _, x, y in joint]
        assert got[i]["keys"] == want


def test_keys_of_sets_of_similarity_08_meet():
    rng = np.random.default_rng(8)
    some = lambda n: rng.integers(0, 1 << 64, n, np.uint64)
    for shared, more, other, n in ((4, 0, 1, 1500), (8, 1, 1, 1500), (80, 10, 10, 1500)):
        sums = [[simhash.bit_sums(np.r_[c, some(k)]) for k in (more, other)] for c in (some(shared) for _ in range(n))]
        a, b = (np.stack(x) for x in zip(*sums, strict=True))
        met = [len({k >> 24 for k in set(x) & set(y)}) for x, y in zip(simhash.soft_keys(a).tolist(), simhash.soft_keys(b).tolist(), strict=True)]
        apart = ((a[:, :256] > 0) != (b[:, :256] > 0)).sum(axis=1)
        assert np.mean(met) / simhash.BANDS > 0.75
        assert sum(m == 0 or d > simhash.CHECK_BITS for m, d in zip(met, apart, strict=True)) <= 1


def test_bits_of_unrelated_sets_stay_apart():
    """The share of unrelated pairs that the check lets pass is too small to meet one here: 2 x 10^7 pairs, 10^-9 each."""
    rng = np.random.default_rng(12)
    words = [np.packbits(simhash.bit_sums(rng.integers(0, 1 << 64, n, np.uint64))[:256] > 0).view(np.int64) for n in rng.integers(5, 60, 6000)]
    words = np.stack(words)
    closest = min(int(simhash._bits(words[i + 1 :], words[i]).min()) for i in range(len(words) - 1))
    assert closest > simhash.CHECK_BITS


def test_large_groups_of_two_words_are_dealt_in_blocks(spark):
    """Fingerprints of 128 bits under one key: two far clouds, whole and in blocks; those with the same first word are one node."""
    rng = random.Random(9)
    fps = set()
    for centre in (0, (1 << 128) - 1) * 60:
        for bit in rng.sample(range(128), rng.randint(1, 6)):
            centre ^= 1 << bit
        fps.add(centre)
    least = {f: f >> 64 for f in fps}
    for _ in fps:  # the smallest first word that links reach
        for f in fps:
            least[f] = min(least[g] for g in fps if (f ^ g).bit_count() <= 8 or f >> 64 == g >> 64)
    want = {}
    for f in fps:
        want.setdefault(least[f], set()).add(f >> 64)
    assert 2 <= len(want) and len({f >> 64 for f in fps}) < len(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keyed = spark.createDataFrame([(5, signed(f >> 64), signed(f & (1 << 64) - 1)) for f in fps], "key int, x long, y long")
    for block in (8, 1000):
        roots = {r["node"]: r["root"] for r in simhash.components(simhash._verified(keyed, 8, block)).collect()}
        got = {}
        for f in fps:
            got.setdefault(roots.get(signed(f >> 64), signed(f >> 64)), set()).add(f >> 64)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_similar_texts_of_equal_check_bits(docs_of):
    """Long texts that differ in a word mostly share all check bits; no similarity under 0.8 is taken."""
    rng = random.Random(10)
    w = [f"w{rng.randrange(9000)}" for _ in range(6000)]
    rows = [(i, " ".join([*w[:i], "other", *w[i + 1 :]])) for i in range(0, 6000, 1000)]
    docs = docs_of(rows)
    assert {r["component_id"] for r in simhash.similar_texts(docs).collect()} == {0}
    with pytest.raises(ValueError):
        simhash.similar_texts(docs, 5, 0.7)
