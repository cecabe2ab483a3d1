"""Text: cleaning, checks, language, similarity."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CleanText
from . import let

# Typographic marks and what replaces them, for all languages and for single ones.
REPLACEMENTS = {"\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2013": "-", "\u2014": "-", "\u00a0": " ", "\u2009": " "}
REPLACEMENTS_OF = {"de": {"\u201e": '"'}, "fr": {"\u00ab": '"', "\u00bb": '"'}}
# Letters that speak for a language.
MARKS = {"de": "äöüÄÖÜß", "fr": "èêàùçÈÀÇ", "es": "áíóúñÁÍÓÚÑ"}
# Characters of no width.
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"

CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
EDGES = r"[\x09-\x0D\x20\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def normalized(text: Column, form: str = "NFC") -> Column:
    """Unicode normal form; Spark has none built in, so this is the one Arrow step of cleaning."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize(form, x))

    return run(text)


def replaced(text: Column, pairs: dict[str, str]) -> Column:
    """Each key by its value, longest keys (in bytes) first, then in code point order."""
    for key in sorted((k for k in pairs if k), key=lambda k: (-len(k.encode()), k)):
        text = F.replace(text, F.lit(key), F.lit(pairs[key]))
    return text


def clean(text: Column, cfg: CleanText | None = None) -> Column:
    """Normal form, no zero-width and control characters, replacements, single spaces, no space at the ends, in this order."""
    cfg = cfg or CleanText()
    form = cfg.form or "NFC"
    if form in ("NFC", "NFKC", "NFD", "NFKD"):
        text = normalized(text, form)
    if cfg.strip_zero_width:
        text = F.translate(text, ZERO_WIDTH, "")
    if cfg.strip_control:
        text = F.regexp_replace(text, CONTROL, "")
    pairs = dict(cfg.replacements) if cfg.replacements is not None else REPLACEMENTS | REPLACEMENTS_OF.get(cfg.language.lower(), {}) if cfg.language else {}
    text = replaced(text, pairs)
    if cfg.collapse:
        text = F.regexp_replace(text, r"[\x09\x0A\x0C\x0D ]+", " ")
    if cfg.trim:
        text = F.regexp_replace(text, f"^{EDGES}|{EDGES}$", "")
    return text


def _count(text: Column, characters: str) -> Column:
    """How many characters of a class the text has: runs of it are cut out, which makes one string and no list of matches."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{characters}+", ""))


def is_valid(text: Column) -> Column:
    """Under a twentieth of control characters and over three tenths of letters and digits; an empty text is valid."""
    n = F.length(text)
    known = _count(text, r"[\p{L}\p{Nd}]")
    return (n == 0) | ((_count(text, CONTROL) / n < 0.05) & (known / n > 0.3))


def language(text: Column) -> Column:
    """de, fr or es by the strict majority of their marks, en if over 80 of 100 letters are ASCII (rounded down), else empty.

    One pass leaves the letters and a second those outside ASCII, which are few; all marks are among them.
    """

    def decide(letters: Column, other: Column) -> Column:
        de, fr, es = (F.length(other) - F.length(F.translate(other, m, "")) for m in MARKS.values())
        found = F.when((de > fr) & (de > es), "de").when((fr > de) & (fr > es), "fr").when((es > de) & (es > fr), "es")
        found = found.when(F.floor((F.length(letters) - F.length(other)) * 100 / F.length(letters)) > 80, "en").otherwise("")
        return F.when(F.length(letters) > 0, found).otherwise("")

    return let(F.regexp_replace(text, r"[^\p{L}]+", ""), lambda x: let(F.regexp_replace(x, "[A-Za-z]+", ""), lambda y: decide(x, y)))


def in_charset(text: Column, characters: str) -> Column:
    """The characters of the text that are in the set; an empty set leaves the text."""
    if not characters:
        return text
    kept = F.filter(F.split(text, ""), lambda c: F.instr(F.lit(characters), c) > 0)
    return F.array_join(F.filter(kept, lambda c: c != ""), "")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x09-\x0D ]+"), lambda w: w != "")


def _matched(x: Column, y: Column, each_once: bool) -> Column:
    """How many words of y are in x; ``each_once``: each word of x serves one of y. One sort of both, then one pass."""
    tagged = lambda words, side: F.transform(words, lambda w: F.struct(w.alias("w"), F.lit(side).alias("side")))
    start = F.struct(F.lit(None).cast("string").alias("w"), F.lit(0).alias("left"), F.lit(0).alias("n"))

    def step(a: Column, e: Column) -> Column:
        left = F.when(a["w"] == e["w"], a["left"]).otherwise(0)
        hit = (e["side"] == 1) & (left > 0)
        more = F.when(e["side"] == 0, left + 1).when(hit, left - int(each_once)).otherwise(left)
        return F.struct(e["w"].alias("w"), more.alias("left"), (a["n"] + hit.cast("int")).alias("n"))

    return F.aggregate(F.sort_array(F.concat(tagged(x, 0), tagged(y, 1))), start, step, lambda a: a["n"])


def similarity_of_words(x: Column, y: Column) -> Column:
    """:func:`similarity` of two texts' words."""

    def found(common: Column) -> Column:
        rest = F.size(x) + F.size(y) - common
        return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).when(rest == 0, 1.0).otherwise(common / rest)

    return let(_matched(x, y, False), found)


def similarity(a: Column, b: Column) -> Column:
    """Words of b that a has (repeats count) over all words but those; 1 for two empty texts, 0 for one."""
    return let(words(a), lambda x: let(words(b), lambda y: similarity_of_words(x, y)))


def included(part: Column, whole: Column) -> Column:
    """Whether a text, trimmed, occurs in another, whatever the case."""
    return F.contains(F.lower(whole), F.lower(F.regexp_replace(part, f"^{EDGES}|{EDGES}$", "")))


def character_accuracy(found: Column, expected: Column) -> Column:
    """1 - edit distance / longer length of the trimmed lower-case texts; 1 for two empty ones."""
    a, b = F.lower(F.trim(found)), F.lower(F.trim(expected))
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def word_accuracy(rows: DataFrame, key: str, found: str, expected: str) -> DataFrame:
    """(key, war): expected words that are found (each as often as it is there) over expected words; 1 if none is expected."""
    war = lambda x, y: F.when(F.size(y) == 0, 1.0).otherwise(_matched(x, y, True) / F.size(y))
    return rows.select(key, let(words(F.col(found)), lambda x: let(words(F.col(expected)), lambda y: war(x, y))).alias("war"))


def quality(text: Column, width: Column, height: Column) -> dict[str, Column]:
    """score, has_text, searchable and density (bytes per 1000 square points) of a page's text."""
    plain = F.coalesce(text, F.lit(""))
    has = plain.rlike(f"[^{EDGES[1:-2]}]")
    n, word = F.octet_length(plain), r"[^\x09-\x0D ]+"
    density = F.when(width * height > 0, n / (width * height) * 1000).otherwise(0.0)
    score = F.lit(0.4) + F.when(density > 0.1, 0.3).otherwise(0.0)
    score = score + F.when(plain.rlike(rf"(?:{word}[\x09-\x0D ]+){{5}}{word}"), 0.2).otherwise(0.0)  # over five words
    score = score + F.when(_count(plain, "[A-Za-z0-9]") / n >= 0.5, 0.1).otherwise(0.0)
    return {"score": F.when(has, F.least(score, F.lit(1.0))).otherwise(0.0), "has_text": has, "searchable": has & plain.rlike(word), "density": density}


def hex_colour(text: Column) -> Column:
    """(r, g, b) of six hexadecimal digits, a # before them or not; null for other texts."""
    digits = F.regexp_extract(text, "^#?([0-9A-Fa-f]{6})$", 1)
    part = lambda i: F.conv(F.substring(digits, i, 2), 16, 10).cast("int")
    return F.when(digits != "", F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def memory_size(text: Column) -> Column:
    """Bytes of sizes like ``1.5 GB`` (B, KB, MB, GB, TB by 1024; no unit: bytes); null for other texts."""
    plain = F.upper(F.regexp_replace(text, " ", ""))
    number, unit = F.regexp_extract(plain, r"^([0-9]+(?:\.[0-9]+)?)([KMGT]?B)?$", 1), F.regexp_extract(plain, r"([KMGT]?)B?$", 1)
    power = F.when(unit == "K", 1).when(unit == "M", 2).when(unit == "G", 3).when(unit == "T", 4).otherwise(0)
    return F.when(number != "", F.floor(number.try_cast("double") * F.pow(F.lit(1024.0), power)).cast("long"))


def valid_language(code: Column) -> Column:
    """Up to ten of a-z, 0-9, _ and -."""
    return code.rlike("^[a-z0-9_-]{1,10}$")


def valid_path(path: Column) -> Column:
    """Up to 500 characters, without ``..`` and line ends."""
    return (F.length(path) <= 500) & ~F.contains(path, F.lit("..")) & ~path.rlike("[\r\n]")


def client_key(forwarded: Column, real: Column, remote: Column) -> Column:
    """First hop of a forwarding list, else the real address, else the host part of the peer."""
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    host = F.regexp_replace(F.regexp_replace(remote, r":[0-9]+$", ""), r"^\[|\]$", "")
    return F.coalesce(some(F.split_part(forwarded, F.lit(","), F.lit(1))), some(real), host)
