"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Counts of words, symbols, repeated lines and repeated word windows are array
and string expressions of a row. Rules over them, and rules that read the text
again, form one ``CASE`` whose branches stop at the first rule that rejects. A
bounded sample tells what share of documents each combination of rules rejects
and how many bytes each rule reads; the rule that rejects most of what the rules
before it leave, for its cost, comes next. The order changes the work, never the
verdict.

Repeated windows are found inside a row: hashes of all windows, each with its
position in its low bits, are sorted as longs, windows whose neighbour has the
same high bits are candidates, and these are sorted by their words, so hashes
that collide change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import let

#: ASCII white space, and what separates words.
SPACE = " \t\n\x0b\x0c\r"
SEPARATOR = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Words of a window whose repeats count.
WINDOW = 3
#: Documents of the sample that orders the rules, about.
SAMPLE = 2000


@dataclass(frozen=True)
class Rule:
    """A rule by name: ``rejects`` makes its condition from the row's columns, ``cost`` the bytes that it reads (times passes)."""

    name: str
    rejects: Callable[[], Column]
    cost: Callable[[], Column]


def _count(pattern: str) -> Column:
    return F.regexp_count("text", F.lit(pattern))


def _lines_like(pattern: str) -> Column:
    return F.size(F.filter("lines", lambda x: x.rlike(pattern)))


def _reads(passes: int) -> Callable[[], Column]:
    return lambda: F.octet_length("text") * passes


def _small() -> Column:
    return F.lit(8)


#: The rules in no particular order: bounds as published for web text (mean length of words, symbols a word, share of
#: lines that repeat, start with a bullet or end in an ellipsis, words with a letter, placeholder text), and shouting.
RULES = (
    Rule("word_length", lambda: (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 10 * F.col("n_words")), _small),
    Rule("symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words"), _small),
    Rule("repeated_lines", lambda: 10 * F.col("n_dup_lines") > 3 * F.size("lines"), _small),
    Rule("bullets", lambda: 10 * _lines_like("^[\\x20\\x09-\\x0D]*[-*•‣▪·]") > 9 * F.size("lines"), _reads(1)),
    Rule("ellipses", lambda: 10 * _lines_like("(?:\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$") > 3 * F.size("lines"), _reads(2)),
    Rule("letters", lambda: 10 * _count(r"[^\x20\x09-\x0D\p{L}]*+\p{L}[^\x20\x09-\x0D]*+") < 8 * F.col("n_words"), _reads(4)),
    Rule("shouted_marks", lambda: 10 * _count("[!?]{2,}") > F.col("n_words"), _reads(2)),
    Rule("capitals", lambda: 10 * _count(r"\p{Lu}") > 4 * _count(r"\p{L}"), _reads(6)),
    Rule("placeholder", lambda: F.contains(F.lower("text"), F.lit("lorem ipsum")), _reads(2)),
)


# ---- counts -----------------------------------------------------------------------


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SEPARATOR))


def _neighbours(rows: Column, key: Callable[[Column], Column]) -> Column:
    """The elements of a sorted array whose neighbour on either side has the same key."""
    same = lambda x, i: F.coalesce(key(x) == key(F.get(rows, i + 1)), F.lit(False)) | F.coalesce(key(x) == key(F.get(rows, i - 1)), F.lit(False))
    return F.filter(rows, same)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many of the words stand in a window of consecutive words that the array has at least twice."""
    n = F.greatest(F.size(words) - (window - 1), F.lit(0))
    bits = F.length(F.bin(F.size(words))).cast("int")
    shift = lambda name, x: F.call_function(name, x, bits)
    at = lambda p: [F.get(words, p + k) for k in range(window)]
    packed = F.transform(F.slice(words, F.lit(1), n), lambda w, i: shift("shiftleft", F.xxhash64(*at(i))).bitwiseOR(i.cast("long")))

    def exact(found: Column) -> Column:
        position = lambda v: v.bitwiseAND(shift("shiftleft", F.lit(1).cast("long")) - 1).cast("int")
        rows = F.transform(found, lambda v: let(position(v), lambda p: F.struct(F.array(*at(p)).alias("w"), p.alias("p"))))
        return let(F.sort_array(rows), lambda r: F.sort_array(F.transform(_neighbours(r, lambda x: x["w"]), lambda x: x["p"])))

    def covered(places: Column) -> Column:
        fresh = F.transform(places, lambda p, i: F.least(F.lit(window), p - F.coalesce(F.get(places, i - 1), p - window)))
        return F.aggregate(fresh, F.lit(0).cast("long"), lambda a, x: a + x)

    candidates = let(F.sort_array(packed), lambda s: _neighbours(s, lambda v: shift("shiftright", v)))
    return let(candidates, lambda c: F.when(F.size(c) == 0, F.lit(0).cast("long")).otherwise(let(exact(c), covered)))


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lines, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed): a row for each row of ``docs``.

    lines are the lines that have a word. A null text is empty; a text without words fails the base as it has under 50.
    Each value is computed once, however many rules use it.
    """
    once = lambda df, **made: df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    has_word = lambda x: F.btrim(x, F.lit(SPACE)) != ""
    rows = once(rows, words=_words(F.col("text")), lines=F.filter(F.split("text", "\n"), has_word))
    without = lambda marks: F.length(F.translate("text", marks, "")).cast("long")
    rows = once(
        rows,
        n_words=F.size("words").cast("long"),
        word_chars=without(SPACE),
        n_symbols=F.length("text") - without(SYMBOLS),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        n_repeat_words=repeated_words(F.col("words")),
    )
    return rows.drop("words").withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


# ---- the cascade ------------------------------------------------------------------


def _sample(docs: DataFrame, size: int) -> DataFrame:
    """About ``size`` rows of ``docs``, all if it has no more; by hash, so reruns sample the same rows."""
    n = docs.count()
    if n <= size:
        return docs
    return docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(size / n * (1 << 30)))


def ordered(docs: DataFrame, rules: Sequence[Rule] = RULES, size: int = SAMPLE) -> list[Rule]:
    """The rules by rejections per cost, each judged on the sampled documents that those before it leave.

    The sample comes to the driver as one row for each combination of rules that reject a document together: its
    number of documents and its sums of costs, so no more rows than ``size``. Equal rules keep their given order.
    """
    rows = counted(_sample(docs, size)).filter(~F.col("base_failed"))
    failed = reduce(lambda a, b: a.bitwiseOR(b), [F.when(r.rejects(), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(rules)], F.lit(0))
    costs = [F.sum(r.cost()).alias(f"c{i}") for i, r in enumerate(rules)]
    seen = rows.withColumn("failed", failed).groupBy("failed").agg(F.count("*").alias("n"), *costs).collect()
    left, out = list(range(len(rules))), []
    while left:
        gain = {i: sum(r["n"] for r in seen if r["failed"] >> i & 1) / max(1, sum(r[f"c{i}"] for r in seen)) for i in left}
        # Where nothing is left to reject, the cheaper rule goes first: all documents that pass meet all rules.
        best = max(left, key=lambda i: (gain[i], -sum(r[f"c{i}"] for r in seen)))
        out.append(rules[best])
        left.remove(best)
        seen = [r for r in seen if not r["failed"] >> best & 1]
    return out


def rejected_by(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects a row of :func:`counted`, null if none does; later rules are not evaluated."""
    cascade = F.when(F.col("base_failed"), "base")
    for rule in rules:
        cascade = cascade.when(rule.rejects(), rule.name)
    return cascade


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, size: int = SAMPLE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by): a row for each row of ``docs``.

    kept is false if the base or any rule rejects; which of several rules rejected_by names depends on the order that
    the sample gave. Null texts are empty and fail the base, null doc_ids stay, repeated rows are judged alike, an
    empty table gives no rows; other columns of ``docs`` are ignored.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = counted(docs).select("doc_id", *names, rejected_by(ordered(docs, rules, size)).alias("rejected_by"))
    return rows.select("doc_id", *names, F.col("rejected_by").isNull().alias("kept"), "rejected_by")
