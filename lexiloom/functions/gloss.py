"""Words inside a gloss: where they stand, which of them are the translations, and codes and dates of packs."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions.text import EXPANSIONS

# Fixed value: the shape of a pack's id.
PACK_ID = "^[a-z]{2}-((core|main|full)|(def|tr)-[a-z0-9]{2,8}(-[a-z0-9]{1,16})*)$"


@lru_cache(maxsize=65536)
def _key_of(ch: str) -> str:
    """What one character gives to a key; empty for what separates words and for marks."""
    low = "".join(EXPANSIONS.get(c, c) for c in ch.lower())
    return "".join(c for c in unicodedata.normalize("NFD", low) if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd")


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """``(start, end, key)`` of the words of a text, in code points. A character is of a word if it gives something to its key."""
    out, begin, key = [], -1, ""
    for i, ch in enumerate(text or ""):
        part = _key_of(ch)
        if part:
            begin, key = (i, part) if begin < 0 else (begin, key + part)
        elif begin >= 0:
            out.append((begin, i, key))
            begin, key = -1, ""
    if begin >= 0:
        out.append((begin, len(text or ""), key))
    return out


def heads(text: str | None, terms: list[str] | None) -> list[tuple[int, int, str, str]]:
    """``(start, end, term, key)`` of each term whose words stand in a row in the text; an infinitive's ``to`` is skipped."""
    words, out = spans(text), []
    for term in terms if terms is not None else ():
        wanted = [k for _, _, k in spans(term)]
        at = next((i for i in range(len(words) - len(wanted) + 1) if [w[2] for w in words[i : i + len(wanted)]] == wanted), None)
        if wanted and at is not None:
            skip = int(len(wanted) > 1 and wanted[0] == "to")
            out.append((words[at + skip][0], words[at + len(wanted) - 1][1], term, " ".join(wanted[skip:])))
    return out


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("key", T.StringType())])


@F.pandas_udf(T.ArrayType(_SPAN))
def spans_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"start": a, "end": b, "key": k} for a, b, k in spans(t)])


def pack_id_valid(pack_id: Column) -> Column:
    return F.coalesce(pack_id.rlike(PACK_ID), F.lit(False))


def version_stamp(at: Column) -> Column:
    """The version of a pack that is built at a time: year to minute as one number."""
    return F.date_format(at, "yyyyMMddHHmm").cast("bigint")


def version_date(version: Column) -> Column:
    """The day of a version of either width; null where it is none."""
    day = F.when(version.between(10_000_101, 99_991_231), version).when(version.between(100_001_010_000, 999_912_312_359), F.floor(version / 10_000))
    return F.try_to_timestamp(day.cast("string"), F.lit("yyyyMMdd")).cast("date")


def translation_ref(term: Column, sense: Column) -> Column:
    """A term with the code of the sense it points to; both parts are cleaned, so a source can't forge a reference."""
    clean = lambda c: F.nullif(F.trim(F.regexp_replace(F.replace(c, F.lit("\x1f"), F.lit("")), "\\s+", " ")), F.lit(""))
    return F.when(clean(sense).isNull(), clean(term)).otherwise(F.concat(clean(term), F.lit("\x1f"), clean(sense)))


def split_ref(value: Column) -> Column:
    """``struct<term, sense>`` of a written reference; without a code the sense is null."""
    at = F.instr(value, "\x1f")
    return F.struct(
        F.when(at > 0, F.substring(value, F.lit(1), at - 1)).otherwise(value).alias("term"),
        F.when(at > 0, F.nullif(F.substring(value, at + 1, F.length(value)), F.lit(""))).alias("sense"),
    )
