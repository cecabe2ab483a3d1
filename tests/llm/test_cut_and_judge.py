"""Periodic runs, fill-in-middle and quality rules against literal brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.llm import infilling, periodic, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain_runs(w, least=12):
    out = []
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            part = w[s : i + p]
            if len(part) >= max(least, 2 * p) and not any(all(part[k] == part[k + q] for k in range(len(part) - q)) for q in range(1, p)):
                out.append((s, len(part), p))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


# ---- periodic runs ------------------------------------------------------------------


@pytest.mark.parametrize("shared", [16, 4096])
def test_runs_are_those_of_brute_force(monkeypatch, shared):
    monkeypatch.setattr(periodic, "SHARED", shared)
    monkeypatch.setattr(periodic, "_GRID", [])
    rng = random.Random(shared)
    for _ in range(400):
        n = rng.randrange(0, 120)
        w = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(n)]
        for _ in range(rng.randrange(3)):
            a, p, m = rng.randrange(n + 1), rng.randrange(1, 20), rng.randrange(60)
            for i in range(a + p, min(n, a + p + m)):
                w[i] = w[i - p]
        assert periodic.runs(np.array(w, np.int64)) == plain_runs(w)


def test_runs_of_long_sequences():
    assert periodic.runs(np.zeros(50000, np.int64)) == [(0, 50000, 1)]
    assert periodic.runs(np.arange(50000) % 7) == [(0, 50000, 7)]
    long = np.arange(60000)
    long[20000:] = long[10000 + np.arange(40000) % 10000]
    assert periodic.runs(long) == [(10000, 50000, 10000)]
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    assert periodic.runs(np.array(b)) == plain_runs(b)


def plain_row(doc_id, text):
    w = WORD.findall(text or "")
    if doc_id is not None and w and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = plain_runs(w)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    s, n, p = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    return (doc_id, len(found), s, n, p, n and 1000 * n // p, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_query_on_odd_and_planted_rows(docs_of):
    rng = random.Random(3)
    some = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choice("ab cd ef gh ü 漢".split()) for _ in range(rng.randrange(90)))) for i in range(150)]
    odd = [(None, "x " * 20), (7, None), (8, ""), (9, " \t\n\x0b\x0c\r "), (10, "same same " * 9), (10, "same same " * 9), (12, "    " * 8)]
    docs = docs_of(some + odd)
    found = periodic.digested(periodic.collapsed(periodic.planted(docs)))
    assert sorted(map(tuple, found.collect()), key=str) == sorted([plain_row(*r) for r in some + odd], key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and t for i, t in some)
    assert periodic.digested(periodic.collapsed(periodic.planted(docs.limit(0)))).count() == 0


def test_collapsed_texts_and_spans(docs_of):
    row = periodic.collapsed(docs_of([(1, "start " + "a b c\n" * 5 + "end")])).first()
    assert [tuple(r) for r in row.runs] == [(1, 15, 3)] and row.collapsed == "start a b c end"


# ---- fill-in-middle -----------------------------------------------------------------


def plain_form(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(k in text for k in infilling.MARKS) or h[2] % 100 >= rate:
        return (doc_id, len(units), "plain", None, None, text)
    if h[3] % 100 < spm:
        return (doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


ODD_TEXTS = ["one\ntwo\n\nthree", "no end", "\n", "\n\n\n", "é\r\n漢字\n𝒳", "has <S> inside\nx", "<\nS>\n<P\n>", "<M\n<P", "quote ' and % and {p}\n{x}", "a\x00b\nc", "long line " * 3000 + "\n" + "x\n" * 5000]


@pytest.mark.parametrize("seed,rate,spm", [(7, 100, 50), (1, 60, 0), (2, 0, 50), (3, 100, 100)])
def test_fill_in_middle_and_back(docs_of, seed, rate, spm):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS * 4)] + [(None, "null id\nhas two lines"), (5, None), (6, ""), (6, ""), (-3, "minus\nthree\n")]
    docs = docs_of(rows).repartition(3)
    found = infilling.fill_in_middle(docs, seed, rate, spm, restore=True)
    want = [plain_form(*r, seed, rate, spm) for r in rows]
    assert sorted((tuple(r)[:6] for r in found.collect()), key=str) == sorted(want, key=str)
    assert sorted(r.restored for r in found.collect()) == sorted(t or "" for _, t in rows)
    digests = infilling.checked(docs, seed, rate, spm).select("output_sha256", "restored_sha256").collect()
    assert sorted(map(tuple, digests)) == sorted((sha(w[5]), sha(t or "")) for w, (_, t) in zip(want, rows, strict=True))


def test_fill_in_middle_of_nothing_and_bad_rates(docs_of):
    assert infilling.checked(docs_of([(1, "x")]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        infilling.fill_in_middle(docs_of([(1, "x")]), rate=101)


def test_slices_hold_a_bounded_number_of_bytes():
    import pyarrow as pa

    from folioframe.llm.common import slices

    batch = pa.record_batch([pa.array(["a" * 5, None, "b" * 4, "c" * 30, "", "d"])], names=["text"])
    parts = [p.column(0).to_pylist() for p in slices(batch, 0, 10)]
    assert parts == [["a" * 5, None, "b" * 4], ["c" * 30, "", "d"]] or sum(parts, []) == batch.column(0).to_pylist()
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= 40 for p in parts)


# ---- quality rules ------------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(again), failed


def test_counts_are_those_of_brute_force(docs_of):
    rng = random.Random(5)
    some = [(i, "".join(rng.choice(["a", "b ", "ü\t", "# ", "c\n", "x y\n", "漢 ", "\n"]) for _ in range(rng.randrange(200)))) for i in range(120)]
    odd = [(None, "w " * 60), (1, None), (2, ""), (3, " \n\x0b"), (4, "a b c a b c a b"), (4, "a b c a b c a b"), (5, "𝒳| <é>\n" * 40), (6, " ".join(f"w{i}" for i in range(3000)) + " w0 w1 w2")]
    found = rules.counted(docs_of(some + odd)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(i, *plain_counts(t)) for i, t in some + odd], key=str)


def test_colliding_hashes_change_nothing(spark, monkeypatch):
    words = "a b c d a b c x y z a b c".split()
    rows = spark.createDataFrame([(words,)], "w array<string>")
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    assert rows.select(rules.repeated_words(F.col("w"))).first()[0] == 9


GOOD = " ".join(f"Clean{chr(97 + i % 26)} prose number{i // 26}words" for i in range(40)) + "."
BAD = {
    "word_length": " ".join(f"{'x' * 30}{i}" for i in range(60)),
    "symbols": " ".join(f"word{i} #" for i in range(60)),
    "repeated_lines": "\n".join(["the very same line of some text"] * 2 + [f"other line{i} of text{i} {'abc'[i % 3] * 4}{i}" for i in range(12)] + [f"again line{i % 4}" for i in range(40)]),
    "bullets": "\n".join(f"- item{i} of list{i}" for i in range(30)),
    "ellipses": "\n".join(f"item{i} of list{i} goes on{i}..." for i in range(30)),
    "letters": " ".join(f"{i}{i + 1}{i}" for i in range(100)),
    "shouted_marks": " ".join(f"buy{i}!!" for i in range(60)),
    "capitals": " ".join(f"SHOUT{chr(65 + i % 26)}ING WORD{i}" for i in range(60)),
    "placeholder": GOOD + " Lorem Ipsum",
}


def test_each_rule_rejects_its_case_and_leaves_clean_text(docs_of):
    docs = docs_of([(0, GOOD), *[(i + 1, t) for i, t in enumerate(BAD.values())], (99, "short"), (None, None)])
    found = {r.doc_id: r for r in rules.judged(docs).collect()}
    assert found[0].kept and found[0].rejected_by is None
    assert not any(r.kept for i, r in found.items() if i != 0)
    assert found[99].rejected_by == found[None].rejected_by == "base"
    alone = rules.counted(docs)
    by = {r.name: {x.doc_id for x in alone.filter(r.rejects()).collect()} for r in rules.RULES}
    for i, name in enumerate(BAD):
        assert i + 1 in by[name] and 0 not in by[name]


def test_order_follows_rejections_per_cost_and_never_the_verdict(docs_of):
    many = [(i, BAD["placeholder"]) for i in range(30)] + [(100 + i, BAD["symbols"]) for i in range(5)] + [(200 + i, GOOD) for i in range(5)]
    docs = docs_of(many)
    order = [r.name for r in rules.ordered(docs)]
    assert order[0] == "symbols" and order[1] == "placeholder"  # 5 of 40 for 8 bytes, then 30 of 35 for their texts
    assert sorted(order) == sorted(r.name for r in rules.RULES)
    one, other = (rules.judged(docs, rs).select("doc_id", "kept").collect() for rs in (rules.RULES, rules.RULES[::-1]))
    assert sorted(one) == sorted(other) and sum(r.kept for r in one) == 5


def test_rules_of_a_sample_and_of_nothing(docs_of):
    docs = docs_of([(i, GOOD + f" {i}") for i in range(300)])
    assert 0 < rules._sample(docs, 50).count() < 300 and rules._sample(docs, 300).count() == 300
    assert rules.judged(docs.limit(0)).count() == 0
