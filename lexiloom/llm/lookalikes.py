"""One consistent form for text that looks the same but is stored with different characters.

Each token is resolved to the set of scripts that can write all of its characters (the intersection of the scripts of
the look-alike class of each character). Tokens whose own scripts don't intersect are mixed; tokens that lie wholly in
one script and can be written wholly in another are whole-script confusable. Every token is then spelt in the first
script that can write all of it; a token no script can write is spelt by the first member of each class. Before that,
what shows nothing is removed, wide and narrow forms are made plain and all kinds of space are one space; after it, the
text is composed (NFC). Case, accents, signs, superscripts and digits are never merged.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Scripts in the order in which a spelling is preferred.
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Coptic", "Lisu")

# Letters that share a glyph, as Latin, Cyrillic, Greek, Armenian member ("" where there is none),
# then further characters of the same look. Taken from the public Unicode confusables, without those whose glyphs
# a reader can tell apart in common fonts.
CLASSES: tuple[tuple[str, str, str, str, str], ...] = (
    ("a", "а", "", "", "ɑ"),
    ("c", "с", "ϲ", "", "ⅽ"),
    ("d", "ԁ", "", "", "ⅾ"),
    ("e", "е", "", "", ""),
    ("g", "", "", "", "ɡ"),
    ("h", "һ", "", "հ", ""),
    ("i", "і", "", "", "ⅰ"),
    ("j", "ј", "ϳ", "", ""),
    ("l", "ӏ", "", "", "ⅼ"),
    ("m", "", "", "", "ⅿ"),
    ("o", "о", "ο", "օ", ""),
    ("p", "р", "", "", ""),
    ("q", "ԛ", "", "", ""),
    ("s", "ѕ", "", "", ""),
    ("u", "", "", "ս", ""),
    ("v", "ѵ", "ν", "", "ⅴ"),
    ("w", "ԝ", "", "", ""),
    ("x", "х", "", "", "ⅹ"),
    ("y", "у", "", "", ""),
    ("ə", "ә", "", "", ""),
    ("æ", "ӕ", "", "", ""),
    ("A", "А", "Α", "", ""),
    ("B", "В", "Β", "", ""),
    ("C", "С", "Ϲ", "", "Ⅽ"),
    ("D", "", "", "", "Ⅾ"),
    ("E", "Е", "Ε", "", ""),
    ("G", "Ԍ", "", "", ""),
    ("H", "Н", "Η", "", ""),
    ("I", "І", "Ι", "", "ⅠӀ"),
    ("J", "Ј", "Ϳ", "", ""),
    ("K", "К", "Κ", "", "K"),
    ("L", "", "", "", "Ⅼ"),
    ("M", "М", "Μ", "", "Ⅿ"),
    ("N", "", "Ν", "", ""),
    ("O", "О", "Ο", "Օ", ""),
    ("P", "Р", "Ρ", "", ""),
    ("Q", "Ԛ", "", "", ""),
    ("S", "Ѕ", "", "Տ", ""),
    ("T", "Т", "Τ", "", ""),
    ("U", "", "", "Ս", ""),
    ("V", "Ѵ", "", "", "Ⅴ"),
    ("W", "Ԝ", "", "", ""),
    ("X", "Х", "Χ", "", "Ⅹ"),
    ("Y", "Ү", "Υ", "", ""),
    ("Z", "", "Ζ", "", ""),
    ("Æ", "Ӕ", "", "", ""),
    ("F", "", "", "", ""),
    ("R", "", "", "", ""),
    ("", "Г", "Γ", "", ""),
    ("", "П", "Π", "", ""),
    ("", "Ф", "Φ", "", ""),
)

# Letters of further scripts that share a glyph with the Latin letter after them.
FURTHER = {
    "Cherokee": "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᏃZ",
    "Coptic": "ⲟo ⲞO ⲢP ⲣp ⲤC ⲥc ⲎH ⲒI ⲔK ⲘM ⲚN ⲦT ⲨY",
    "Lisu": "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU",
}
#: Ranges of letters that are others side by side (ligatures, digraphs, Roman numerals) or one other (micro sign): they look as
#: their compatibility decomposition. The ligatures with a long s and other symbol variants look different and stay out.
SIDE_BY_SIDE = ((0xB5, 0xB5), (0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2160, 0x217F), (0xFB00, 0xFB04))


def _rows() -> tuple[tuple[str, ...], ...]:
    """The classes over all scripts: a member for each of ``SCRIPTS``, then the further characters."""
    member = {script: {pair[1]: pair[0] for pair in pairs.split()} for script, pairs in FURTHER.items()}
    return tuple((*row[:4], *(member[s].get(row[0], "") for s in SCRIPTS[4:]), row[4]) for row in CLASSES)


ROWS = _rows()
_SHAPES = {chr(c): unicodedata.normalize("NFKC", chr(c)) for first, last in SIDE_BY_SIDE for c in range(first, last + 1)}

# Signs that share a glyph with the first of their group.
SIGNS = {"‐": "-", "‑": "-", "ʼ": "’", ";": ";", "·": "·", "․": "."}

_CLASS_OF = {ch: row for row in ROWS for part in row for ch in part}
#: Characters without a glyph besides those of category Cf: fillers, selectors, joiners.
_SHOWS_NOTHING = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
_SPACES = re.compile(r"[^\S ]+|  +")
_TOKEN = re.compile(r"[^ \-]+")
_PLAIN = re.compile(r"[\x21-\x7e]+(?: [\x21-\x7e]+)*")


def script_of(ch: str) -> str | None:
    """The script of a letter as its Unicode name begins; ``None`` for what belongs to all scripts (digits, signs, marks)."""
    if not unicodedata.category(ch).startswith("L"):
        return None
    return unicodedata.name(ch, "").split(" ", 1)[0].capitalize() or None


def resolve(token: str) -> tuple[set[str] | None, set[str] | None, str]:
    """``(own scripts, possible scripts, spelling)`` of a decomposed token; ``None`` for all scripts.

    The own scripts are the intersection over the characters as they stand, the possible ones over their classes.
    """
    own: set[str] | None = None
    possible: set[str] | None = None
    for ch in token:
        row, script = _CLASS_OF.get(ch), script_of(ch)
        if row is None and script is None:
            continue
        here = {script} if script else set(SCRIPTS)
        could = here if row is None else {s for s, member in zip(SCRIPTS, row) if member}
        own = here if own is None else own & here
        possible = could if possible is None else possible & could
    chosen = next((i for i, s in enumerate(SCRIPTS) if possible and s in possible), None)

    def spelt(ch: str) -> str:
        row = _CLASS_OF.get(ch)
        if row is None:
            return ch
        return row[chosen] if chosen is not None else next(m for m in row if m)

    return own, possible, "".join(map(spelt, token))


def _plain_char(ch: str) -> str:
    if ch in SIGNS:
        return SIGNS[ch]
    kind = unicodedata.category(ch)
    if ord(ch) in _SHOWS_NOTHING or kind == "Cf" or kind == "Cc" and not ch.isspace():
        return ""
    if ch in _SHAPES:
        return _SHAPES[ch]
    shape = unicodedata.decomposition(ch)
    return unicodedata.normalize("NFKC", ch) if shape.startswith(("<wide>", "<narrow>")) else ch


def consistent_form(text: str | None) -> str | None:
    """The one form of all texts that look like ``text``. Null stays null; a text that shows nothing becomes empty."""
    if text is None or _PLAIN.fullmatch(text):
        return text
    shown = "".join(map(_plain_char, text))
    shown = unicodedata.normalize("NFD", _SPACES.sub(" ", shown).strip())
    return unicodedata.normalize("NFC", _TOKEN.sub(lambda m: resolve(m[0])[2], shown))


def confusable_kind(text: str | None) -> str | None:
    """``mixed`` if a token mixes scripts, ``whole`` if one lies wholly in a script and could lie in another, else null."""
    kinds = set()
    shown = unicodedata.normalize("NFD", "".join(map(_plain_char, text or "")))
    for token in _TOKEN.findall(shown):
        own, possible, _ = resolve(token)
        if own is not None and not own:
            kinds.add("mixed")
        elif own and possible and possible - own and own & set(SCRIPTS):
            kinds.add("whole")
    return "mixed" if "mixed" in kinds else "whole" if kinds else None


@F.pandas_udf(T.StringType())
def consistent_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(consistent_form, na_action="ignore")


@F.pandas_udf(T.StringType())
def confusable_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(confusable_kind, na_action="ignore")


def with_consistent_form(df: DataFrame, value: str, out: str = "consistent") -> DataFrame:
    """``df`` with the consistent form of a column. Plain ASCII is its own form and never leaves the JVM."""
    # A mask over printable ASCII with single inner spaces; everything else goes through Python.
    plain = F.col(value).rlike("^[\\x21-\\x7e]+( [\\x21-\\x7e]+)*$")
    return df.withColumn(out, F.when(plain, F.col(value)).otherwise(consistent_udf(F.when(~plain, F.col(value)))))


def distinct_values(columns: dict[str, DataFrame]) -> DataFrame:
    """``(src_field, value, consistent)``: each distinct non-null value of each one-column frame."""
    rows = None
    for name, df in columns.items():
        one = df.select(F.lit(name).alias("src_field"), F.col(df.columns[0]).alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    return with_consistent_form(rows.filter("value IS NOT NULL").distinct(), "value")


def look_classes(values: DataFrame) -> DataFrame:
    """``(src_field, value, consistent, n_values)``: each value that looks like another one of its field, with its class.

    The class is the consistent form; ``n_values`` is how many different values share it. A row a value: the pairs of a class
    are not made. ``values`` is what ``distinct_values`` gives; the sizes are sums of partial counts, so a form that very
    many values share is no hot group before the join, which the adaptive skew join splits.
    """
    sizes = values.groupBy("src_field", "consistent").agg(F.count("*").alias("n_values")).filter("n_values > 1")
    return values.join(sizes, ["src_field", "consistent"]).select("src_field", "value", "consistent", "n_values")


def look_alike_pairs(values: DataFrame) -> DataFrame:
    """``(src_field, value_a, value_b)``: every pair of different values of a field with the same consistent form.

    ``values`` is what ``distinct_values`` gives. Of two values with one form at most one is that form itself, so the
    join runs from the changed values, a small part of all, to all values of the same form; values without a partner
    meet no row. Every pair is wanted by the statement of the problem, so the number of rows is that of the result.
    An empty table gives no rows, repeated rows count once.
    """
    changed = values.filter("value <> consistent").select("src_field", "consistent", F.col("value").alias("_c"))
    met = changed.join(values, ["src_field", "consistent"]).filter("_c <> value")
    return met.select("src_field", F.least("_c", "value").alias("value_a"), F.greatest("_c", "value").alias("value_b")).distinct()
