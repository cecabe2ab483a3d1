"""Each stage of the pipeline against brute force: on a small table with odd rows among it, and on the one before it."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioframe.llm import langid, packing

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# ---- brute force ----------------------------------------------------------------------


def lines_left(rows):
    """The texts (by doc_id, each once) less recurring lines; written apart from the operator."""
    seen, leaves = [], {}
    for doc, text in rows.items():
        for at, raw in enumerate((text or "").split("\n")):
            tokens = WORDS.findall(raw)
            if text is None or not tokens:
                continue
            own, masked = " ".join(tokens), ["<*>" if re.search("[0-9]", t) else t for t in tokens]
            line = " ".join(masked)
            plain = line.count("<*>") * 2 <= len(tokens)
            leaf = (len(tokens), *masked[:4])
            seen.append((doc, at, own, line, plain, leaf))
            if len(tokens) > 4:
                leaves.setdefault(leaf, []).append((doc, tuple(masked), line if plain else own, plain))
    template = {}
    for leaf, found in leaves.items():
        if len({x[0] for x in found}) < 2 or len({x[2] for x in found}) < 2 or not any(x[3] for x in found):
            continue
        different = {x[1] for x in found}
        for masked in different:
            cut = [t if i < 4 or sum(o[i] == t for o in different) > 1 else "<*>" for i, t in enumerate(masked)]
            lone = sum(c == "<*>" and t != "<*>" or (i >= 4 and t == "<*>" and sum(o[i] == t for o in different) == 1) for i, (c, t) in enumerate(zip(cut, masked, strict=True)))
            made = " ".join(cut)
            if made != " ".join(masked) and lone <= 0.3 * leaf[0] and made.count("<*>") <= 0.3 * leaf[0]:
                template[" ".join(masked)] = made
    keys = {}
    for doc, at, own, line, plain, _ in seen:
        keys.setdefault(("template", template.get(line, line)) if plain else ("own", own), []).append((doc, at))
    gone = set()
    for places in keys.values():
        if len({d for d, _ in places}) > 1:
            gone |= set(sorted(places)[1:])
    return {doc: text if text is None else "\n".join(x for at, x in enumerate(text.split("\n")) if (doc, at) not in gone) for doc, text in rows.items()}


def groups_of(rows):
    """doc_id -> smallest doc_id of its group: texts that share 0.8 of their five-word shingles."""
    sets = {}
    for doc, text in rows.items():
        w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(rows)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or len(x & y) >= 0.8 * len(x | y) - 1e-9:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: find(d) for d in ids}


def mixed(rows):
    """(doc_id, text) of the mix for rows (doc_id, text, source), each source cut to the word in the order of md5 keys."""
    size = lambda t: len(WORDS.findall(t or ""))
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    weight, left, open_, target = {s: 1 + i % 3 for i, s in enumerate(sources)}, sum(total.values()), set(sources), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] >= 3 * total[s]]
        if not over:
            target |= {s: share * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 3 * total[s]
            left -= target[s]
            open_.remove(s)
    out = []
    for s in sources:
        budget = int(target[s] + 1e-9)
        own = sorted((hashlib.md5(f"{d}\n{t or ''}".encode()).hexdigest(), d, t) for d, t, x in rows if x == s)
        for _ in range(4):
            for _, d, t in own:
                n = size(t)
                if n and budget > 0:
                    ends = [m.end() for m in WORDS.finditer(t)]
                    out.append((d, t if n <= budget else t[: ends[budget - 1]]))
                    budget -= min(n, budget)
        out += [(d, t) for _, d, t in own if not size(t)]
    return sorted(out, key=repr)


# ---- stages ---------------------------------------------------------------------------

ODD = [
    (900_001, None, "en", "web"),
    (900_002, "", None, None),
    (900_003, "The very long text goes on and on. " * 9000, "en", "web"),
    (900_004, "Same text in two rows of the table, word for word and mark for mark.", "en", None),
    (900_005, "Same text in two rows of the table, word for word and mark for mark.", "en", "web"),
    (900_006, "12 34 56 78\n\n \t\n", "und", ""),
]


@pytest.fixture(scope="module")
def docs(spark, data):
    """The documents, odd rows, and columns whose names clash with those of results."""
    rows = spark.read.parquet(f"{data}/documents.parquet")
    odd = spark.createDataFrame([(*r, len(r[1] or "")) for r in ODD], rows.schema)
    return corpus_pipeline.materialize(rows.unionByName(odd).select("*", F.lit(7).alias("size"), F.lit("x").alias("fp"), F.lit(0.5).alias("score")), "start")


def test_stages(spark, data, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near", "mix", "pack"]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, data), name)
        rows = out.collect()
        if name == "pack":
            import public_tokenizers
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            want = []
            for r in docs.collect():
                ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
                first = (len(ids) - 1) % packing.CAPACITY + 1
                cuts = [0, *range(first, len(ids) + 1, packing.CAPACITY)]
                want += [(r["doc_id"], i, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
            bins = {}
            for r in rows:
                bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            for parts in bins.values():
                ends = [0, *(a + n for a, n in sorted(parts))]
                assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= packing.CAPACITY
            break
        assert out.dtypes == docs.dtypes
        after = {r["doc_id"]: r["text"] for r in rows}
        if name == "language":
            model = langid.fit(docs)
            keep = {r["doc_id"] for r in langid.predict(docs, model).collect() if r["lang_pred"] != "und" and r["score"] >= langid.LEAST_SCORE}
            assert set(after) == keep and not keep & {900_001, 900_002, 900_006} and {900_003, 900_004, 900_005} <= keep
            assert all(after[d] == before[d] for d in after) and len(after) >= 0.99 * (len(before) - 3)
        elif name == "lines":
            assert after == lines_left(before) and after != before
            assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] != before[r["doc_id"]])
        elif name == "near":
            group = groups_of(before)
            assert len(rows) == len(after) and set(after) == set(group.values()) and len(after) < len(before)
            assert all(after[d] == before[d] for d in after)
        elif name == "mix":
            assert sorted(((r["doc_id"], r["text"]) for r in rows), key=repr) == mixed([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
        docs, before = out, after


def test_repeated_rows_and_ids(spark, data, docs):
    """Rows that are there twice, and two texts under one id, pass all stages; each stage keeps its columns."""
    some = docs.filter("doc_id < 40")
    table = corpus_pipeline.materialize(some.unionByName(some.filter("doc_id < 10")).unionByName(some.filter("doc_id = 3").withColumn("text", F.lit("Another text that stands under the same id as one before."))), "repeated")
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, table, data), name)
        assert out.count() > 0
        if name != "pack":
            assert out.dtypes == table.dtypes
        if name == "near":
            n = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
            assert max(n.values()) <= 2
        table = out


def test_empty(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
    assert docs.collect() == []
