"""Chat formatting of reply trees, with DataFrame functions only.

A tree's messages know their parents. Self-joins double the reach of an
ancestor table in each round, so after log2(depth) rounds every message knows
the sum of the scores on its way to the root. Branches are ranked by it, the paths of the chosen
ones are enumerated by the same tables, longest jumps first, and each path
is formatted as one conversation: marked turns, texts in which no control
string can occur, and the spans of the assistant's texts as loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

START, BREAK, END = "<|turn|>", "<|says|>", "<|done|>"
#: Strings that stand for themselves in no text, in the order in which they are escaped; undone in the other order.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    """Text without ``<`` and ``[``, so without any control string; :func:`unescaped` gives it back."""
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def _jumps(ids: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (tree, node, above) of ancestors 1, 2, 4, ... steps up, and (tree, node, score) with the scores summed from each node to its root.

    Each round joins the table with itself, which doubles its reach.
    """
    ids = materialize(ids, "ids")
    largest = ids.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    known = ids.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.lit(True).alias("there"))
    parent = F.when(F.col("parent") != F.col("node"), F.col("parent"))
    state = ids.select("tree", "node", parent.alias("above"), "score").join(known, (F.col("tree") == F.col("t")) & (F.col("above") == F.col("n")), "left")
    state = materialize(state.select("tree", "node", F.when(F.col("there"), F.col("above")).alias("above"), "score"), "state")
    tables, done = [], [state.filter("above is null").select("tree", "node", "score")]
    while True:
        hops = state.filter("above is not null")
        if hops.isEmpty():
            break
        if 1 << len(tables) > largest:
            raise ValueError("a message is its own ancestor")
        tables.append(hops.select("tree", "node", "above"))
        ends = done[0]
        for more in done[1:]:
            ends = ends.unionByName(more)
        further = hops.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("above").alias("top"), F.col("score").alias("more"))
        further = further.unionByName(ends.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.lit(None).cast(hops.schema["above"].dataType).alias("top"), F.col("score").alias("more")))
        state = hops.join(further, (F.col("tree") == F.col("t")) & (F.col("above") == F.col("n")))
        state = materialize(state.select("tree", "node", F.col("top").alias("above"), (F.col("score") + F.col("more")).alias("score")), "state")
        done.append(state.filter("above is null").select("tree", "node", "score"))
    scores = done[0]
    for more in done[1:]:
        scores = scores.unionByName(more)
    return tables, scores


def best_paths(ids: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, node, up): each node on the way from a chosen leaf (up = 0) to its root.

    ``ids`` has tree, node, parent (null, the node itself or one that is
    not there: a root) and score. The ``branches`` best leaves of each tree are
    chosen, by the sum of the scores on their path, ties by the smaller leaf;
    None chooses all. Only their paths are enumerated. Parents that go round in a circle raise ValueError.
    """
    tables, scores = _jumps(ids)
    leaves = scores
    if tables:
        leaves = scores.join(tables[0].select("tree", F.col("above").alias("node")).distinct(), ["tree", "node"], "left_anti")
    if branches is not None:
        best = Window.partitionBy("tree").orderBy(F.desc("score"), "node")
        leaves = leaves.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= branches)
    found = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in range(len(tables) - 1, -1, -1):
        found = materialize(found, "paths")
        step = tables[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "above")
        higher = found.join(step, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n")))
        found = found.unionByName(higher.select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up")))
    return materialize(found, "paths")


def format_paths(steps: DataFrame, texts: DataFrame) -> DataFrame:
    """(tree, leaf, formatted, loss): each path as one conversation.

    ``steps`` has tree, leaf, up, role and key, ``texts`` tree, key and text,
    equal keys of a tree having equal texts. Null roles and texts are empty. loss has the
    spans (start, length) of the assistant's texts in code points from 1.
    Texts are shipped once: steps and texts of a tree come together, each step
    takes the text that is sorted before it, and the paths are put together in the same place.
    """
    none = F.lit(None)
    rows = texts.select("tree", "key", "text", none.cast(steps.schema["leaf"].dataType).alias("leaf"), none.cast("long").alias("up"), none.cast("string").alias("role"))
    rows = rows.unionByName(steps.select("tree", "key", none.cast("string").alias("text"), "leaf", "up", "role")).repartition("tree")
    so_far = Window.partitionBy("tree", "key").orderBy(F.col("leaf").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("text", F.coalesce(F.first("text", ignorenulls=True).over(so_far), F.lit(""))).filter("leaf is not null")
    role = F.coalesce("role", F.lit(""))
    rows = rows.select("tree", "leaf", "up", role.alias("role"), F.concat(F.lit(START), escaped(role), F.lit(BREAK)).alias("head"), escaped(F.col("text")).alias("body"))
    size = F.length("head") + F.length("body") + len(END)
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head") + 1
    span = F.when(F.col("role") == LOSS_ROLE, F.struct(at.cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    turns = F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("no"), "piece", "span")))
    made = rows.select("tree", "leaf", "up", F.concat("head", "body", F.lit(END)).alias("piece"), span.alias("span"))
    made = made.groupBy("tree", "leaf").agg(turns.alias("turns"))
    loss = F.filter(F.col("turns.span"), lambda s: s.isNotNull())
    return made.select("tree", "leaf", F.array_join("turns.piece", "").alias("formatted"), loss.alias("loss"))


def format_trees(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, formatted, loss): the ``branches`` best paths of each tree as conversations.

    ``nodes`` has tree, node, parent, role, text and score, (tree, node) being
    unique and both set. A branch's score is the sum over its nodes (null: 0);
    ties go to the smaller leaf. See :func:`best_paths` and :func:`format_paths`.
    """
    ids = nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    roles = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role")
    steps = best_paths(ids, branches).join(roles, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n")))
    return format_paths(steps.select("tree", "leaf", "up", "role", F.col("node").alias("key")), nodes.select("tree", F.col("node").alias("key"), "text"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(tree, leaf, turns, loss_text, formatted): roles and texts of formatted conversations, and the text under the mask."""
    pieces = F.filter(F.split("formatted", r"<\|turn\|>"), lambda x: x != "")
    turn = lambda x: F.struct(
        unescaped(F.substring_index(x, BREAK, 1)).alias("role"),
        unescaped(F.substring_index(F.substring_index(x, BREAK, -1), END, 1)).alias("text"),
    )
    under = F.transform("loss", lambda s: F.substring(F.col("formatted"), s["start"].cast("int"), s["length"].cast("int")))
    return formatted.select("tree", "leaf", F.transform(pieces, turn).alias("turns"), unescaped(F.array_join(under, "")).alias("loss_text"), "formatted")


def _keyed(rows: DataFrame) -> DataFrame:
    """(tree, key, turn, role, text): the key stands for turn, role and text; rows without conv_id go."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.md5(F.concat_ws("\n", F.coalesce(F.col("turn").cast("string"), F.lit("null")), role, text).cast("binary"))
    return rows.filter("conv_id is not null").select(F.col("conv_id").alias("tree"), key.alias("key"), "turn", "role", "text")


def conversation_nodes(rows: DataFrame) -> DataFrame:
    """(tree, node, parent, role, score, key): linear conversations as trees, without the texts.

    Rows by (turn, role, key) are a chain; null turns come last.
    """
    order = Window.partitionBy("tree").orderBy(F.col("turn").isNull(), "turn", "role", "key")
    rows = _keyed(rows).select("tree", "role", "key", F.row_number().over(order).cast("long").alias("node"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", F.lit(0.0).alias("score"), "key")


def format_conversations(rows: DataFrame) -> DataFrame:
    """(tree, leaf, formatted, loss): rows conv_id, turn, role and text, each conversation a chain of replies."""
    nodes = materialize(conversation_nodes(rows), "nodes")
    about = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "key")
    steps = best_paths(nodes.select("tree", "node", "parent", "score")).join(about, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n")))
    return format_paths(steps.select("tree", "leaf", "up", "role", "key"), _keyed(rows).select("tree", "key", "text"))


def check_conversations(rows: DataFrame) -> DataFrame:
    """Rows conv_id, turn, role, text, formatted and read back: a row of digests for each conversation.

    Repeated rows and turns are turns of their own; rows without conv_id belong
    to no conversation and go. No rows give none.
    """
    made = read_back(format_conversations(rows))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
