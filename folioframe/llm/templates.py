"""Line dedup by a log-template tree, with DataFrame functions only.

A line's tokens are its parts between white space; a token with a digit is a
variable field and becomes ``<*>``. The tree has a fixed depth: a leaf holds
the lines with the same number of tokens and the same leading tokens. In a
leaf, a later position is a constant of a line if another line of the leaf has
the same token there, and a variable field otherwise; a line that keeps enough
constants has the generalised line as its template. Templates that recur in
several documents are dropped, but for their first line (or that too).

Lines and templates are known by 96 bits of hash: among 10^12 lines the chance
that any two different ones are taken for one is below 1 in 100,000.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, materialize

FIELD = "<*>"
#: Leading tokens that a leaf's lines share.
DEPTH = 4
#: Least share of constant tokens in a template with variable fields.
SIMILARITY = 0.7
#: Documents from which a template recurs.
MIN_DOCS = 2
#: Bits of a map of hashes; it has 1 MB whatever the input.
MAP_BITS = 1 << 23


def _with(df: DataFrame, **made: Column) -> DataFrame:
    """``df`` and columns that are computed once, however often filters and joins above use them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def spaced(line: Column) -> Column:
    """The line's tokens joined by single spaces; empty if it has none."""
    odd = F.contains(line, F.lit("  "))
    for mark in "\t\v\f\r":
        odd = odd | F.contains(line, F.lit(mark))
    return F.trim(F.when(odd, F.regexp_replace(line, r"[\x09-\x0D ]+", " ")).otherwise(line))


def masked(plain: Column) -> Column:
    """A line of :func:`spaced` with ``<*>`` for the tokens with a digit."""
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, "[^ 0-9]*+[0-9][^ ]*+", FIELD)).otherwise(plain)


def _tokens(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _fields(line: Column) -> Column:
    left = F.octet_length(F.replace(line, F.lit(FIELD), F.lit("")))
    return F.when(F.contains(line, F.lit(FIELD)), (F.octet_length(line) - left) / len(FIELD)).otherwise(0)


def _leaf(n: Column, masked_line: Column) -> Column:
    return F.xxhash64(n, F.substring_index(masked_line, " ", DEPTH))


def _own_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, line_no, own, n): the lines that have tokens, spaced; th stands for the text, n is the number of tokens."""
    rows = docs.filter("doc_id is not null and text is not null").select("doc_id", "text")
    rows = _with(rows, th=F.xxhash64("text")).select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    rows = _with(rows, own=spaced(F.col("raw"))).filter("own <> ''")
    return _with(rows.select("doc_id", "th", "line_no", "own"), n=_tokens(F.col("own")))


def _occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, th, line_no, n, leaf, lh, lx, plain): every line with its leaf and its 96 bits.

    A line of which more than half are fields says nothing (plain is false); it is known unmasked, by its copies only.
    """
    lines = _with(_own_lines(docs), line=masked(F.col("own")))
    lines = _with(lines, leaf=_leaf(F.col("n"), F.col("line")), plain=_fields(F.col("line")) * 2 <= F.col("n"))
    lines = _with(lines, known=F.when(F.col("plain"), F.col("line")).otherwise(F.col("own")), tree=F.when(F.col("plain"), F.col("leaf")).otherwise(0))
    return lines.select("doc_id", "th", "line_no", "n", "leaf", F.xxhash64("tree", "known").alias("lh"), F.hash("known").alias("lx"), "plain")


def _marked(rows: DataFrame, hashes: DataFrame, name: str) -> DataFrame:
    """The rows whose hash ``name`` may be among ``hashes``: all that are, and few others while the map has room for them."""
    word, bit = F.shiftright(F.col(name).bitwiseAND(MAP_BITS - 1), 6), F.col(name).bitwiseAND(63).cast("int")
    words = hashes.select(word.alias("__w"), bit.alias("__b")).groupBy("__w").agg(F.expr("bit_or(shiftleft(1L, __b))").alias("__bits"))
    found = _with(rows, __w=word, __b=bit).join(F.broadcast(words), "__w").filter(F.expr("getbit(__bits, __b) = 1"))
    return found.drop("__w", "__b", "__bits")


def _generalised(docs: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(lh, lx, k, kx): for the lines that another template stands for; a line that equals a template has its hashes already."""
    leaves = occurrences.filter(F.col("n") > DEPTH).groupBy("leaf")
    leaves = leaves.agg(F.min("doc_id").alias("d"), F.max("doc_id").alias("e"), F.min("lh").alias("l"), F.max("lh").alias("m"), F.bool_or("plain").alias("plain"))
    leaves = materialize(leaves.filter("d <> e and l <> m and plain").select("leaf"), "leaves")
    # These lines are cut again from the documents; only the leading tokens are masked to see whether a line is one of them.
    lines = _own_lines(docs).filter(F.col("n") > DEPTH)
    lines = _with(lines, leaf=_leaf(F.col("n"), masked(F.substring_index("own", " ", DEPTH)))).select("leaf", "own", "n")
    # An inner join: a semi join would be moved before the map's, and shuffle every line.
    lines = _marked(lines, leaves, "leaf").select("leaf", "n", masked(F.col("own")).alias("line")).join(leaves, "leaf").distinct()
    lines = materialize(lines.select("leaf", "n", "line", F.xxhash64("leaf", "line").alias("lh"), F.hash("line").alias("lx")), "candidates")
    tokens = lines.select("leaf", "lh", "lx", F.posexplode(F.slice(F.split("line", " "), DEPTH + 1, 1 << 30)).alias("pos", "token"))
    tokens = tokens.select("lh", "lx", "pos", F.xxhash64("leaf", "pos", "token").alias("t"), F.hash("pos", "token").alias("u"))
    # A token that no other line of the leaf has at its place is a field; its group names its only line and place, so no join goes back to it.
    alone = tokens.groupBy("t", "u").agg(F.count("*").alias("lines"), F.min("lh").alias("lh"), F.min("lx").alias("lx"), F.min("pos").alias("pos")).filter("lines = 1")
    fields = alone.groupBy("lh", "lx").agg(F.collect_set("pos").alias("fields"))
    made = lines.join(fields, ["lh", "lx"]).filter(F.size("fields") <= (1 - SIMILARITY) * F.col("n"))
    word = F.transform(F.split("line", " "), lambda x, i: F.when(F.array_contains("fields", i - DEPTH), F.lit(FIELD)).otherwise(x))
    made = _with(made, template=F.array_join(word, " "))
    enough = _fields(F.col("template")) <= (1 - SIMILARITY) * F.col("n")
    return made.filter((F.col("template") != F.col("line")) & enough).select("lh", "lx", F.xxhash64("leaf", "template").alias("k"), F.hash("template").alias("kx"))


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = True) -> DataFrame:
    """(doc_id, th, lines): the numbers (from 0) of the lines that go, for each document that loses any."""
    occurrences = materialize(_occurrences(docs), "lines")
    # One row for each different line, then for each template: the documents it is in, as far as they matter.
    seen = [F.count("*").alias("__n"), F.min("doc_id").alias("d"), F.max("doc_id").alias("e")]
    if min_docs > 2:
        once = occurrences.groupBy("lh", "lx", "doc_id").agg(F.count("*").alias("__n"))
        seen[0] = F.sum("__n").alias("__n")
    else:
        once = occurrences
    lines = once.groupBy("lh", "lx").agg(*seen).join(_generalised(docs, occurrences), ["lh", "lx"], "left")
    lines = materialize(lines.select("lh", "lx", F.coalesce("k", "lh").alias("k"), F.coalesce("kx", "lx").alias("kx"), "d", "e", "__n"), "templates")
    recurring = lines.groupBy("k", "kx").agg(F.min("d").alias("first"), F.max("e").alias("last"), F.count("*").alias("__n"))
    recurring = recurring.filter("first <> last" if min_docs > 1 else "true").select("k", "kx", "first", "__n")
    if min_docs > 2:
        of = once.join(lines.select("lh", "lx", "k", "kx"), ["lh", "lx"]).select("k", "kx", "doc_id").distinct()
        of = of.groupBy("k", "kx").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs)
        recurring = recurring.join(of.select("k", "kx"), ["k", "kx"])
    lines = join_hot(lines.withColumnRenamed("__n", "times"), materialize(recurring, "recurring"), ["k", "kx"], spread=F.col("lh"))
    lines = lines.filter("first is not null").select("lh", "lx", "k", "kx", "first", F.col("times").alias("__n"))
    lines = materialize(lines, "recurring_lines")
    found = join_hot(_marked(occurrences.select("doc_id", "th", "line_no", "lh", "lx"), lines.select("lh"), "lh"), lines, ["lh", "lx"], spread=F.xxhash64("th", "line_no"))
    found = found.filter("first is not null")
    gone = found
    if keep_first:
        order = Window.partitionBy("k", "kx").orderBy("th", "line_no")
        again = found.filter("doc_id = first").withColumn("r", F.rank().over(order)).filter("r > 1")  # equal rows tie
        gone = found.filter("doc_id <> first").select("doc_id", "th", "line_no").unionByName(again.select("doc_id", "th", "line_no"))
    return gone.groupBy("doc_id", "th").agg(F.collect_set("line_no").alias("lines"))


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = True) -> DataFrame:
    """Every row of ``docs`` with its text less the recurring lines, and n_lines and n_dropped.

    A line goes if its template occurs in ``min_docs`` or more doc_ids and it
    is not the template's first line by (doc_id, text, line); without
    ``keep_first`` the first goes too. Lines of
    which more than half holds digits are their own templates, unmasked, so
    only copies of them go. Lines without tokens stay. A text may become empty; its row stays. Null texts stay null with no lines; rows
    without doc_id stay as they are and don't count. Rows with equal doc_id
    count as one document; equal rows lose the same lines. No rows give none.
    """
    names = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    gone = dropped_lines(docs, min_docs, keep_first).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("lines").alias("__lines"))
    rows = docs.select(*names, "text", F.xxhash64("text").alias("__h"))
    # The lines' numbers are a small part of the texts: they are hashed, and the texts pass by without being sorted.
    gone = gone.hint("shuffle_hash")
    rows = rows.join(gone, (rows["doc_id"] == gone["__id"]) & (rows["__h"] == gone["__th"]), "left")
    rows = _with(rows, __cut=F.when(F.col("__lines").isNotNull(), F.split("text", "\n")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__cut") - 1), F.col("__lines"))
    left = F.array_join(F.transform(kept, lambda i: F.get("__cut", i)), "\n")
    text = F.when(F.col("__lines").isNull(), F.col("text")).otherwise(left)
    n = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    return rows.select(*names, text.alias("text"), n.alias("n_lines"), F.coalesce(F.size("__lines"), F.lit(0)).alias("n_dropped"))
