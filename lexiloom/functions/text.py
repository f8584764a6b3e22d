"""Search keys and text expressions, all inside the JVM unless a name ends in ``_udf``."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters without a decomposition that the index key spells out.
EXPANSIONS = {
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i", "ŋ": "ng", "ſ": "s",
    "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff",
}

# Phonetic replacements of each language, in the order in which they apply.
FUZZY_PROFILES: dict[str, tuple[tuple[str, str], ...]] = {
    "es": (
        ("ch", "8"), ("qu", "k"), ("gue", "ge"), ("gui", "gi"), ("h", ""), ("ll", "y"), ("v", "b"), ("z", "s"),
        ("ce", "se"), ("ci", "si"), ("c", "k"), ("y", "i"), ("x", "s"), ("w", "b"), ("8", "ch"),
    ),
    "en": (
        ("ck", "k"), ("ph", "f"), ("wh", "w"), ("kn", "n"), ("wr", "r"), ("gh", ""), ("qu", "kw"), ("ce", "se"),
        ("ci", "si"), ("cy", "si"), ("c", "k"), ("x", "ks"), ("y", "i"),
    ),
    "de": (("sch", "s"), ("ck", "k"), ("ph", "f"), ("th", "t"), ("dt", "t"), ("v", "f"), ("w", "v"), ("z", "ts"), ("y", "i")),
}


@lru_cache(maxsize=1)
def _base_letters() -> tuple[str, str]:
    """Composed letters and the base letters they decompose to, by the rule of canonical decomposition."""
    composed, base = [], []
    for cp in (*range(0xC0, 0x2000), *range(0x2C60, 0x2E00), *range(0xA640, 0xA800)):
        ch = chr(cp)
        parts = [c for c in unicodedata.normalize("NFD", ch) if not unicodedata.category(c).startswith("M")]
        if len(parts) == 1 and parts[0] != ch:
            composed.append(ch)
            base.append(parts[0])
    return "".join(composed), "".join(base)


def norm(text: Column) -> Column:
    """The index key: lower case, letters spelt out and without marks, letters and digits only, single spaces.

    Everything else separates words. Null stays null; a text without letters or digits becomes empty.
    """
    key = F.lower(text)
    for letter, spelt in EXPANSIONS.items():
        key = F.replace(key, F.lit(letter), F.lit(spelt))
    key = F.regexp_replace(F.translate(key, *_base_letters()), "\\p{M}+", "")
    return F.trim(F.regexp_replace(key, "[^\\p{L}\\p{Nd}]+", " "))


def fuzzy(key: Column, lang: Column) -> Column:
    """The typo-tolerant key of a ``norm`` key: phonetic replacements of its language, then doubled letters made one."""

    def folded(profile: str) -> Column:
        out = key
        for source, target in FUZZY_PROFILES[profile]:
            out = F.replace(out, F.lit(source), F.lit(target))
        return out

    out = key
    for profile in FUZZY_PROFILES:
        out = F.when(lang == profile, folded(profile)).otherwise(out)
    return F.trim(F.regexp_replace(F.regexp_replace(out, "(\\p{L})\\1+", "$1"), " +", " "))


def fold_gloss(gloss: Column) -> Column:
    """A gloss as two sources would agree on it: case folded, white space of ASCII collapsed, end punctuation off.

    Accents stay; the text is taken as composed already. Folding is lower case plus the letters that it leaves apart.
    """
    low = F.replace(F.translate(F.lower(F.trim(gloss)), "ςſ", "σs"), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(F.regexp_replace(low, "[ \\t\\n\\r\\f\\u000b]+", " "), "^[ .;:,]+|[ .;:,]+$", "")


def sanitize(text: Column) -> Column:
    """A value fit for one tagged line: no tab, line break or unit separator, single spaces, null if nothing is left."""
    flat = F.regexp_replace(F.replace(text, F.lit("\x1f"), F.lit("")), "\\s+", " ")
    return F.nullif(F.trim(flat), F.lit(""))


def stable_uid(lang: Column, headword: Column, pos: Column, sense_key: Column) -> Column:
    """The logical id: 63 bits of SHA-256 over language, headword, part of speech and sense key."""
    text = F.concat_ws("\x1f", lang, headword, F.lower(F.trim(F.coalesce(pos, F.lit("")))), F.coalesce(sense_key, F.lit("")))
    word = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.floor(word / F.lit(2)).cast("bigint")


def sense_code(uid: Column, gloss: Column) -> Column:
    """The name of a sense: 12 hex digits of SHA-256 over the entry's uid and its folded gloss."""
    return F.substring(F.sha2(F.concat(uid.cast("string"), F.lit("\x1f"), fold_gloss(gloss)), 256), 1, 12)


def ellipsize(text: Column, width: int = 48) -> Column:
    """At most ``width`` characters, cut at the last space if that lies past the middle, with an ellipsis."""
    head = F.substring(text, 1, width)
    at = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, " ") > 0) & (at > width // 2), F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.regexp_replace(cut, "[ ,;:]+$", ""), F.lit("…")))


def upper_bound(prefix: str) -> str | None:
    """The smallest text greater than every text that begins with ``prefix``; ``None`` if there is none.

    Surrogate code points are stepped over, so the bound is always a valid text.
    """
    points = [ord(c) for c in prefix]
    while points:
        last = points.pop()
        if last < 0x10FFFF:
            step = last + 1
            return "".join(map(chr, points)) + chr(0xE000 if 0xD800 <= step <= 0xDFFF else step)
    return None


def osa_distance(a: str, b: str, most: int = 2) -> int:
    """Optimal string alignment distance (edits and swaps of neighbours), ``most + 1`` beyond ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        above, row2 = row, [i]
        for j, cb in enumerate(b, 1):
            cost = min(above[j] + 1, row2[-1] + 1, above[j - 1] + (ca != cb))
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                cost = min(cost, before[j - 2] + 1)
            row2.append(cost)
        if min(row2) > most and min(above) > most:
            return most + 1
        before, row = above, row2
    return min(row[-1], most + 1)


@F.pandas_udf(T.IntegerType())
def osa_distance_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """``osa_distance`` of two columns with its cutoff of 2; null where either is null."""
    for left, right in batches:
        yield pd.Series([None if a is None or b is None else osa_distance(a, b) for a, b in zip(left, right)], dtype="Int32")


# Twins of the expressions in SQL, for the checks against another engine.


def norm_sql(text: str) -> str:
    key = f"lower({text})"
    for letter, spelt in EXPANSIONS.items():
        key = f"replace({key}, '{letter}', '{spelt}')"
    return f"trim(regexp_replace(strip_accents({key}), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'))"


def fuzzy_sql(key: str, lang: str) -> str:
    def folded(profile: str) -> str:
        out = key
        for source, target in FUZZY_PROFILES[profile]:
            out = f"replace({out}, '{source}', '{target}')"
        return out

    chosen = f"CASE {lang} " + " ".join(f"WHEN '{p}' THEN {folded(p)}" for p in FUZZY_PROFILES) + f" ELSE {key} END"
    single = f"array_to_string(list_filter(string_split({chosen}, ''), lambda c, i: i = 1 OR c <> string_split({chosen}, '')[i - 1] OR NOT regexp_full_match(c, '\\p{{L}}')), '')"
    return f"trim(regexp_replace({single}, ' +', ' ', 'g'))"


def fold_gloss_sql(gloss: str) -> str:
    low = f"replace(translate(lower(trim({gloss})), 'ςſ', 'σs'), 'ß', 'ss')"
    spaced = f"regexp_replace({low}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')"
    return f"regexp_replace({spaced}, '^[ .;:,]+|[ .;:,]+$', '', 'g')"


def stable_uid_sql(lang: str, headword: str, pos: str, sense_key: str) -> str:
    text = f"concat({lang}, chr(31), {headword}, chr(31), lower(trim(coalesce({pos}, ''))), chr(31), coalesce({sense_key}, ''))"
    return f"CAST(concat('0x', substr(sha256({text}), 1, 16))::UBIGINT >> 1 AS BIGINT)"


def sense_code_sql(uid: str, gloss: str) -> str:
    return f"substr(sha256(concat({uid}, chr(31), {fold_gloss_sql(gloss)})), 1, 12)"
