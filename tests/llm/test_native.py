"""Line dedup, mixing, chat formatting."""

import hashlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from folioframe.llm import mixing, reply_trees, templates


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_templates_generalise_fields(docs_of):
    docs = docs_of([
        (1, "user logged in from the town of Ulm today\nown line number one here"),
        (2, "user logged in from the town of Bonn today\nanother line that stays"),
        (3, "user logged in from the town of Ulm today\nvisit 12 of 2024"),
        (4, "visit 77 of 1999\nshort"),
        (5, "The quick brown fox jumps\nThe quick brown fox runs off"),
    ])
    got = texts(templates.drop_recurring_lines(docs))
    assert got[1] == "user logged in from the town of Ulm today\nown line number one here"
    assert got[2] == "another line that stays"
    assert got[3] == "visit 12 of 2024"
    assert got[4] == "short"
    assert got[5] == "The quick brown fox jumps\nThe quick brown fox runs off"


def test_lines_odd_rows(odd):
    out = templates.drop_recurring_lines(odd)
    rows = out.collect()
    assert len(rows) == 9
    by = {(r["doc_id"], r["n_dropped"]): r for r in rows}
    assert by[(1, 0)]["text"] is None and by[(1, 0)]["n_lines"] == 0
    assert by[(2, 0)]["text"] == "" and by[(6, 0)]["text"] == "\n\n \t"
    assert by[(5, 1)]["text"] == "" and by[(4, 0)]["text"] == "same text of five words"
    assert by[(None, 0)]["text"] == "alone here"
    assert templates.drop_recurring_lines(odd.limit(0)).collect() == []


def test_min_docs(docs_of):
    docs = docs_of([(1, "a b"), (2, "a b"), (3, "c d"), (4, "c d"), (5, "c d")])
    got = texts(templates.drop_recurring_lines(docs, min_docs=3))
    assert got == {1: "a b", 2: "a b", 3: "c d", 4: "", 5: ""}


def fill(sizes):
    """Targets by resharing what is above three times a source's size until none is."""
    weights, left, open_, target = [1 + i % 3 for i in range(len(sizes))], Fraction(sum(sizes)), set(range(len(sizes))), {}
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w >= 3 * sizes[i]}
        if not over:
            target |= {i: left * weights[i] / w for i in open_}
            break
        target |= {i: Fraction(3 * sizes[i]) for i in over}
        left -= sum(target[i] for i in over)
        open_ -= over
    return [float(target[i]) for i in range(len(sizes))]


@pytest.mark.parametrize("sizes", [[10, 1, 1], [0, 5, 7, 100], [3], [1, 1, 1, 1, 1000]])
def test_targets_match_resharing(spark, sizes):
    rows = [(f"s{i}", n) for i, n in enumerate(sizes)]
    got = mixing.source_targets(spark.createDataFrame(rows, "source string, source_size long")).orderBy("source").collect()
    assert [r["target"] for r in got] == pytest.approx(fill(sizes))


def test_mix_is_exact_and_repeatable(docs_of):
    rows = [(i, " ".join(["w"] * (i % 17)), None if i % 4 == 3 else f"s{i % 4}") for i in range(200)]
    docs = docs_of(rows)
    got = sorted(map(tuple, mixing.mix(docs).drop("mix_key").collect()), key=str)
    assert got == sorted(map(tuple, mixing.mix(docs.repartition(7)).drop("mix_key").collect()), key=str)
    taken, target = {}, {}
    for r in mixing.mix(docs).collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert all(target[s] - 1 < taken[s] <= target[s] for s in taken)
    words = mixing.mixed_documents(docs).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
    assert {r["source"]: r["n"] for r in words.collect()} == taken


def test_mix_odd_rows(odd):
    got = mixing.mix(odd).collect()
    assert len(got) == 9 and sum(r["taken"] for r in got) == sum(r["size"] for r in got)
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns and out.count() == 9
    assert mixing.mix(odd.limit(0)).collect() == [] and mixing.mixed_documents(odd.limit(0)).collect() == []


TREE = "tree long, node long, parent long, role string, text string, score double"


def test_best_branch(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "a<b> [x] &lt;", 0.9), (1, 4, 3, "user", None, 0.0), (2, 7, 99, "user", "lone", None)]
    made = reply_trees.format_trees(spark.createDataFrame(rows, TREE), branches=2)
    back = {(r["tree"], r["leaf"]): r for r in reply_trees.read_back(made).collect()}
    assert set(back) == {(1, 2), (1, 4), (2, 7)}
    assert [(t["role"], t["text"]) for t in back[(1, 4)]["turns"]] == [("user", "q"), ("assistant", "a<b> [x] &lt;"), ("user", "")]
    assert back[(1, 4)]["loss_text"] == "a<b> [x] &lt;"
    best = reply_trees.format_trees(spark.createDataFrame(rows, TREE)).collect()
    assert {(r["tree"], r["leaf"]) for r in best} == {(1, 4), (2, 7)}


def test_long_chain_and_circle(spark):
    chain = [(1, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(37)]
    got = reply_trees.read_back(reply_trees.format_trees(spark.createDataFrame(chain, TREE))).first()
    assert [t["text"] for t in got["turns"]] == [str(i) for i in range(37)]
    circle = [(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0)]
    with pytest.raises(ValueError):
        reply_trees.best_paths(spark.createDataFrame(circle, TREE))


def test_conversations(spark):
    rows = [(5, 0, "user", "<|turn|>é"), (5, 1, "assistant", "𝒳 </s>"), (5, 1, "assistant", "𝒳 </s>"), (6, None, None, None), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    got = {r["conv_id"]: r for r in reply_trees.check_conversations(df).collect()}
    assert set(got) == {5, 6} and got[5]["n_turns"] == 3 and got[5]["loss_chars"] == 12
    assert got[5]["loss_sha256"] == hashlib.sha256("𝒳 </s>𝒳 </s>".encode()).hexdigest()
    assert got[6]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest()
    assert reply_trees.check_conversations(df.limit(0)).collect() == []


def test_masked_and_generalised_lines_are_one_template(docs_of):
    docs = docs_of([
        (1, "error at node in worker7 now"),
        (2, "error at node in Alpha now"),
        (3, "error at node in Beta now"),
        (4, "error at node in worker9 now"),
    ])
    assert texts(templates.drop_recurring_lines(docs)) == {1: "error at node in worker7 now", 2: "", 3: "", 4: ""}
    assert texts(templates.drop_recurring_lines(docs.filter("doc_id < 3"))) == {1: "error at node in worker7 now", 2: ""}


def test_copies_of_lines_of_digits_go(docs_of):
    docs = docs_of([(1, "12 34 56 total\nown"), (2, "12 34  56 total\nother"), (3, "12 34 57 total"), (4, "12 34 56 total\n12 34 56 total")])
    assert texts(templates.drop_recurring_lines(docs)) == {1: "12 34 56 total\nown", 2: "other", 3: "12 34 57 total", 4: ""}


def test_line_dedup_may_take_the_first_too(docs_of):
    docs = docs_of([(1, "a b\nown one"), (2, "a b"), (3, "c d")])
    assert texts(templates.drop_recurring_lines(docs, keep_first=False)) == {1: "own one", 2: "", 3: "c d"}


def test_one_text_of_many_lines_takes_seconds(docs_of):
    """Work is linear in the lines of a text: 50,000 lines of 1 MB in one row."""
    import time

    long = "\n".join(f"line {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)} says" for i in range(50_000))
    docs = docs_of([(1, long), (2, long)])
    began = time.time()
    got = texts(templates.drop_recurring_lines(docs))
    assert got[1] == long and got[2] == "" and time.time() - began < 60


def test_mix_counts_equal_rows_by_source(docs_of):
    """The same (doc_id, text) in several sources: each source gives what the mix takes of it."""
    rows = [(i, f"w{i} " * (1 + i % 7), s) for i in range(60) for s in ("a", "b", None)] + [(i, f"w{i} " * (1 + i % 7), "a") for i in range(20)]
    docs = docs_of(rows)
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    found = mixing.mixed_documents(docs).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()
    assert {r["source"]: r["n"] for r in found} == taken and taken["a"] < taken["b"]


def test_branch_ties_and_long_texts(spark):
    """Tied branches go to the smaller leaf, one of them with a very long text; all branches where asked for."""
    long = "x<[&" * 300_000
    rows = [(1, 1, None, "user", "q", 0.5), (1, 5, 1, "assistant", long, 1.0), (1, 3, 1, "assistant", "b", 1.0), (1, 4, 3, "user", "c", -1.0), (1, 6, 3, "assistant", "d", 0.0)]
    nodes = spark.createDataFrame(rows, TREE)
    got = {r["leaf"]: r for r in reply_trees.read_back(reply_trees.format_trees(nodes, branches=2)).collect()}
    assert set(got) == {5, 6} and got[5]["loss_text"] == long and [t["text"] for t in got[6]["turns"]] == ["q", "b", "d"]
    assert [r["leaf"] for r in reply_trees.format_trees(nodes).collect()] == [5]
    assert {r["leaf"] for r in reply_trees.format_trees(nodes, branches=None).collect()} == {4, 5, 6}


def test_paths_against_brute_force(spark):
    import random

    rng = random.Random(12)
    rows, parents = [], {}
    for tree in range(12):
        for node in range(rng.randint(1, 40)):
            up = rng.choice([None, *range(node)]) if node else None
            parents[(tree, node)] = up
            rows.append((tree, node, up, "user", "t", rng.choice((0.0, 0.5, 1.0))))
    scores = {(r[0], r[1]): r[5] for r in rows}
    inner = {(t, p) for (t, _), p in parents.items() if p is not None}
    want = set()
    for tree in range(12):
        ways = []
        for t, leaf in parents:
            if t == tree and (t, leaf) not in inner:
                way, at = [], leaf
                while at is not None:
                    way.append(at)
                    at = parents[(t, at)]
                ways.append((-sum(scores[(t, n)] for n in way), leaf, way))
        for _, leaf, way in sorted(ways)[:2]:
            want |= {(tree, leaf, n, i) for i, n in enumerate(way)}
    got = reply_trees.best_paths(spark.createDataFrame(rows, TREE), branches=2).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_intermediate_tables_can_be_cleaned_up(spark):
    from folioframe.llm import common

    kept = common.materialize(spark.range(3), "some")
    assert kept.count() == 3 and common.clean_up(spark)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(kept.inputFiles()[0])
