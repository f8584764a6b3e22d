"""The tagged text of an entry: packing, parsing, rendering, and what is derived from it.

A body is lines of a one-letter tag, a tab and a value. ``S`` opens a sense and the lines after it belong to it; ``C``
names the source of the example right above it; ``W`` belongs to the word wherever it stands. Lines of another shape and
unknown tags are skipped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions.text import fold_gloss, sanitize

# The tags, by what they hold.
WORD_TAGS = {"P": "pos", "W": "word_translation", "I": "pronunciation", "H": "syllables", "M": "etymology", "F": "form"}
SENSE_TAGS = {"U": "label", "E": "example", "C": "citation", "T": "translation", "Y": "synonym", "A": "antonym", "R": "related"}
_RAW = -15


@F.pandas_udf(T.StringType())
def inflate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The text of a raw-deflate payload; null for null and for what is damaged."""

    def one(data: bytes | None) -> str | None:
        try:
            return None if data is None else zlib.decompress(bytes(data), _RAW).decode("utf-8")
        except (zlib.error, UnicodeDecodeError):
            return None

    for payloads in batches:
        yield payloads.map(one)


@F.pandas_udf(T.BinaryType())
def deflate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The raw-deflate payload of a text, at the highest level; null for null."""

    def one(text: str | None) -> bytes | None:
        if text is None:
            return None
        packer = zlib.compressobj(9, zlib.DEFLATED, _RAW)
        return packer.compress(text.encode("utf-8")) + packer.flush()

    for texts in batches:
        yield texts.map(one)


def body_lines(df: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """``(key, line, tag, value, sense)``: the lines of each body; ``sense`` counts from 1 and is 0 before the first.

    An entry's body is one row already, so its lines are numbered inside the row and no shuffle is needed: the sense of a
    line is the number of ``S`` lines up to it.
    """
    lines = F.transform(F.split(body, "\n"), lambda x: F.struct(F.substring(x, 1, 1).alias("tag"), F.regexp_extract(x, "^.\\t(.+)$", 1).alias("value")))
    good = F.filter(lines, lambda x: x["value"] != "")
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("s"), F.array().cast("array<struct<line:int,tag:string,value:string,sense:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        sense = acc["s"] + F.when(x["tag"] == "S", 1).otherwise(0)
        one = F.struct((acc["n"] + 1).alias("line"), x["tag"].alias("tag"), x["value"].alias("value"), sense.alias("sense"))
        return F.struct((acc["n"] + 1).alias("n"), sense.alias("s"), F.concat(acc["out"], F.array(one)).alias("out"))

    numbered = F.aggregate(good, start, step, lambda acc: acc["out"])
    return df.filter(F.col(body).isNotNull()).select(F.col(key), F.explode(numbered).alias("_l")).select(key, "_l.*")


def parse_senses(df: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """``(key, sense, gloss, labels, examples, translations, synonyms, antonyms, related)``, one row a sense.

    ``examples`` are structs of text and ref; a citation that doesn't directly follow an example is dropped.
    """
    lines = body_lines(df, key, body)
    by_line = Window.partitionBy(key).orderBy("line")
    cited = lines.withColumn("_ref", F.when((F.lead("tag").over(by_line) == "C") & (F.col("tag") == "E"), F.lead("value").over(by_line))).filter("sense > 0 AND tag NOT IN ('C', 'W')")

    def values(tag: str) -> Column:
        found = F.sort_array(F.collect_list(F.when(F.col("tag") == tag, F.struct("line", "value", "_ref"))))
        return F.transform(found, lambda x: F.struct(x["value"].alias("text"), x["_ref"].alias("ref"))) if tag == "E" else F.transform(found, lambda x: x["value"])

    names = {"labels": "U", "examples": "E", "translations": "T", "synonyms": "Y", "antonyms": "A", "related": "R"}
    gloss = F.max(F.when(F.col("tag") == "S", F.col("value")))
    return cited.groupBy(key, "sense").agg(gloss.alias("gloss"), *[values(t).alias(n) for n, t in names.items()])


def merge_duplicate_senses(senses: DataFrame, key: str = "id") -> DataFrame:
    """The senses of an entry whose folded glosses agree made one, at the place and with the wording of the first.

    Attachments are joined in the order of first appearance, each once.
    """
    lists = [n for n in ("labels", "examples", "translations", "synonyms", "antonyms", "related") if n in senses.columns]


    def joined_up(name: str) -> Column:
        in_order = F.sort_array(F.collect_list(F.struct("sense", name)))
        return F.array_distinct(F.flatten(F.transform(in_order, lambda x: x[name]))).alias(name)

    folded = senses.withColumn("_f", fold_gloss(F.col("gloss")))
    return folded.groupBy(key, "_f").agg(F.min(F.struct("sense", "gloss")).alias("_m"), *map(joined_up, lists)).select(key, "_m.sense", "_m.gloss", *lists)


def render_senses(senses: DataFrame, key: str = "id") -> DataFrame:
    """``(key, body)``: the tagged text of parsed senses, the inverse of ``parse_senses`` on what it keeps."""

    def lines(column: str, tag: str) -> Column:
        return F.transform(F.filter(F.transform(column, sanitize), lambda x: x.isNotNull()), lambda x: F.concat(F.lit(tag + "\t"), x))

    quoted = F.flatten(
        F.transform("examples", lambda e: F.when(sanitize(e["text"]).isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(F.concat(F.lit("E\t"), sanitize(e["text"])), F.concat(F.lit("C\t"), sanitize(e["ref"]))))))
    )
    one = F.concat(F.array(F.concat(F.lit("S\t"), sanitize(F.col("gloss")))), lines("labels", "U"), quoted, lines("translations", "T"), lines("synonyms", "Y"), lines("antonyms", "A"), lines("related", "R"))
    rows = senses.filter(sanitize(F.col("gloss")).isNotNull()).select(key, "sense", F.array_join(one, "\n").alias("_b"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("sense", "_b"))), lambda x: x["_b"])
    return rows.groupBy(key).agg(F.concat(F.array_join(ordered, "\n"), F.lit("\n")).alias("body"))


def admits_sentence(body: Column) -> Column:
    """One sense and no example: only then a corpus sentence may be shown under it."""
    return (F.regexp_count(body, F.lit("(?m)^S\\t.")) == 1) & (F.regexp_count(body, F.lit("(?m)^E\\t.")) == 0)


def search_text(senses: DataFrame, key: str = "id") -> DataFrame:
    """``(key, fts_body)``: glosses, examples, translations and synonyms of an entry; not antonyms, related words, sources."""
    parts = F.concat(F.array("gloss"), F.transform("examples", lambda e: e["text"]), "translations", "synonyms")
    one = senses.select(key, "sense", F.array_join(parts, " ").alias("_t"))
    return one.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sense", "_t"))), lambda x: x["_t"]), " ").alias("fts_body"))


def word_lines(df: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """``(key, pos, pronunciation, syllables, etymology, word_translations, forms)``: what a body says of the word.

    Of single values the first stands; ``forms`` are structs of key and form, lines without the colon are skipped.
    """
    lines = F.transform(F.split(body, "\n"), lambda x: F.struct(F.substring(x, 1, 1).alias("tag"), F.regexp_extract(x, "^.\\t(.+)$", 1).alias("value")))

    def of(tag: str) -> Column:
        return F.transform(F.filter(lines, lambda x: (x["tag"] == tag) & (x["value"] != "")), lambda x: x["value"])

    def first(tag: str) -> Column:
        return F.try_element_at(of(tag), F.lit(1))

    pairs = F.transform(F.filter(of("F"), lambda v: v.rlike("^[^:]+:.+")), lambda v: F.struct(F.regexp_extract(v, "^([^:]+):", 1).alias("key"), F.regexp_extract(v, "^[^:]+:(.+)$", 1).alias("form")))
    return df.select(
        key, first("P").alias("pos"), first("I").alias("pronunciation"), first("H").alias("syllables"), first("M").alias("etymology"), of("W").alias("word_translations"), pairs.alias("forms")
    )


def glued_examples(entries: DataFrame, examples: DataFrame, body: str = "body") -> DataFrame:
    """``entries`` whose body got the example of its headword and part of speech, where it has one sense and no example."""
    e = examples.select(F.col("headword").alias("_h"), F.col("pos").alias("_p"), sanitize(F.col("example")).alias("_x"))
    joined = entries.join(e, (F.col("headword") == F.col("_h")) & F.col("pos").eqNullSafe(F.col("_p")), "left")
    fits = admits_sentence(F.col(body)) & F.col("_x").isNotNull()
    line = F.concat(F.lit("\nE\t"), F.col("_x"))
    glued = F.when(fits, F.concat(F.regexp_extract(body, "(?s)^(.*?(?:^|\\n)S\\t[^\\n]*(?:\\nU\\t[^\\n]*)*)", 1), line, F.regexp_extract(body, "(?s)^.*?(?:^|\\n)S\\t[^\\n]*(?:\\nU\\t[^\\n]*)*(.*)$", 1)))
    return joined.withColumn(body, F.coalesce(glued, F.col(body))).drop("_h", "_p", "_x")


def compression_dictionary(bodies: DataFrame, body: str = "body", size: int = 32 * 1024, sample: int = 4000) -> bytes:
    """A preset dictionary for deflate: frequent sequences of words, the most frequent last, then the tail of a sample.

    The sample is the ``sample`` bodies of smallest hash, so it is the same on every run; what reaches the driver is that
    sample and as many sequences as fit in half the dictionary.
    """
    from lexiloom.operators.tiers import word_ngrams

    picked = bodies.select(F.col(body).alias("_b")).filter("_b IS NOT NULL").orderBy(F.xxhash64("_b"), "_b").limit(sample)
    half = size // 2
    found = word_ngrams(picked, "_b").filter("n > 1").orderBy(F.col("n").desc(), F.length("ngram").desc(), "ngram").limit(half // 4)
    chosen, total = [], 0
    for row in found.collect():  # at most half // 4 rows, since no sequence is shorter than four bytes with its space
        phrase = (row.ngram + " ").encode("utf-8")
        if total + len(phrase) <= half:
            chosen.append(phrase)
            total += len(phrase)
    tail = "".join(r._b for r in picked.collect()).encode("utf-8")[-half:]
    return b"".join(reversed(chosen)) + tail
