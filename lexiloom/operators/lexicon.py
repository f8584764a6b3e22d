"""Building the tables of a pack: keys, identities, ranks, caps, sentences and the merge of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators.ordered import grouped_places


def translation_keys(key: Column) -> Column:
    """The search keys of a translation: the whole phrase and, if it has several words, each of them; none for an empty or null one."""
    words = F.split(key, " ")
    every = F.when(F.size(words) > 1, F.array_distinct(F.concat(F.array(key), words))).otherwise(F.array(key))
    return F.filter(every, lambda k: k != "")


def capped(pairs: DataFrame, group: str, rank: str, item: str, cap: int) -> DataFrame:
    """The first ``cap`` pairs of each group by rank, then item, with ``place`` from 1.

    The limit is taken in each map task before the shuffle, so a group of any size sends ``cap`` rows a task.
    """
    w = Window.partitionBy(group).orderBy(rank, item)
    return pairs.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= cap)


def colliding(df: DataFrame, key: str, shown: Column) -> DataFrame:
    """``(key, n, examples)``: values of a key that several rows share, with up to five of what they are."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(shown)).alias("_e")).filter("n > 1").select(key, "n", F.array_join(F.slice("_e", 1, 5), ", ").alias("examples"))


def homographs(df: DataFrame, *by: str, key: str = "id") -> DataFrame:
    """``df`` with ``n_homographs`` and ``sense_key``: the place among the rows that agree in ``by``, empty if there is one.

    Counts come from a reduction that is joined back and places from ``grouped_places``, since a window over a word with
    very many rows would hold them all.
    """
    counts = df.groupBy(*by).agg(F.count("*").alias("n_homographs"))
    same = None
    for c in by:
        one = F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        same = one if same is None else same & one
    placed = grouped_places(df, by, [key], "_place")
    joined = placed.alias("l").join(counts.alias("r"), same).select("l.*", "r.n_homographs")
    return joined.withColumn("sense_key", F.when(F.col("n_homographs") > 1, F.col("_place").cast("string")).otherwise("")).drop("_place")


def unique_reach(sentences: DataFrame, entry: DataFrame, form: DataFrame) -> DataFrame:
    """``(frase_id, entry_id)``: sentences whose word leads to exactly one entry, as headword or form.

    Only then may the sentence stand under it; a word of two entries says nothing about which of them is meant.
    """
    keys = entry.select("norm", F.col("id").alias("entry_id")).unionByName(form.select("norm", "entry_id"))
    single = keys.filter("norm IS NOT NULL").groupBy("norm").agg(F.min("entry_id").alias("entry_id"), F.max("entry_id").alias("_x")).filter("entry_id = _x").drop("_x")
    return sentences.filter("norm IS NOT NULL").select("frase_id", "norm").join(single, "norm").select("frase_id", "entry_id")


def merged_source(first: DataFrame, second: DataFrame, order: str) -> DataFrame:
    """``first`` and those rows of ``second`` whose headword and part of speech it lacks, the earliest of each in ``order``."""
    keys = first.select(F.col("headword").alias("_h"), F.col("pos").alias("_p")).distinct()
    new = second.join(keys, F.col("headword").eqNullSafe(F.col("_h")) & F.col("pos").eqNullSafe(F.col("_p")), "left_anti")
    w = Window.partitionBy("headword", "pos").orderBy(order)
    return first.unionByName(new.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n"))


def reverse_index(pairs: DataFrame, key: str, members: list[str], limit: int = 8) -> DataFrame:
    """``(key, equivalents)``: the ``limit`` best members of each key in their order, as an array.

    Only the rows that survive the cap are collected, so an array never grows with its key.
    """
    w = Window.partitionBy(key).orderBy(*[F.col(m).asc_nulls_first() for m in members])
    kept = pairs.select(key, *members).distinct().withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit)
    return kept.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", *members))), lambda x: x["headword"]).alias("equivalents"))


def kept_participles(entry: DataFrame, form: DataFrame, endings: str) -> DataFrame:
    """Ids of verbs and adjectives with a participle's ending whose key is a form of another entry that is a verb."""
    could = entry.filter(F.col("norm").rlike(endings)).select("id", "norm")
    verbs = entry.filter(F.lower("pos").startswith("verb") | F.lower("pos").startswith("глаг")).select(F.col("id").alias("_v"))
    reached = form.join(verbs, F.col("entry_id") == F.col("_v")).select(F.col("norm").alias("_n"), "_v")
    return could.join(reached, (F.col("norm") == F.col("_n")) & (F.col("id") != F.col("_v")), "left_semi").select("id")


def richest(df: DataFrame, groups: list[str], size: Column, key: str = "id") -> DataFrame:
    """The largest row of each group, at a tie the one of the smallest key."""
    return df.groupBy(*groups).agg(F.min(F.struct((-size).alias("s"), F.col(key).alias("k"))).alias("_m")).select(*groups, F.col("_m.k").alias(key))


def expanded_keys(trans: DataFrame, inflections: DataFrame) -> DataFrame:
    """``(norm, entry_id)``: translation keys and the inflected forms of each (``inflections``: ``norm, forms``)."""
    more = trans.join(inflections, "norm").select(F.explode("forms").alias("norm"), "entry_id")
    return trans.select("norm", "entry_id").unionByName(more).distinct()


def both_directions(entries: DataFrame, trans: DataFrame, limit: int = 8) -> DataFrame:
    """``(direction, headword, pos, rank, equivalents)``: the entries as they are, and one for each of their translations.

    A reverse entry has the rank and part of speech of its best equivalent and lists the ``limit`` best; it says how a word
    is put in the other language and has no senses of its own.
    """
    pairs = trans.withColumnRenamed("norm", "key").join(entries.select("id", "headword", "pos", "rank"), F.col("entry_id") == F.col("id"))
    best = pairs.groupBy("key").agg(F.min(F.struct("rank", "headword", "pos")).alias("_b"))
    reverse = reverse_index(pairs, "key", ["rank", "headword", "pos"], limit).join(best, "key")
    forward = entries.select(F.lit("forward").alias("direction"), "headword", "pos", "rank", F.array().cast("array<string>").alias("equivalents"))
    return forward.unionByName(reverse.select(F.lit("reverse").alias("direction"), F.col("key").alias("headword"), "_b.pos", "_b.rank", "equivalents"))


def most_used(words: DataFrame, word: str, n: int) -> DataFrame:
    """The ``n`` most frequent words with their counts, ties by word."""
    return words.groupBy(word).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), word).limit(n)
