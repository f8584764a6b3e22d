"""The search cascade over a table of queries: prefix, inflected form, translation, near spelling, definition text.

A query table has ``query_id``, ``q`` (a ``norm`` key) and optionally ``q_lang``; a result has one row a suggestion:
``query_id, entry_id, headword, pos, match_kind, score``. Nothing is collected and no query is a job of its own. A query
without text finds nothing; a null ``q_lang`` searches all languages. Every order is total, so results don't depend on
partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import osa_distance_udf
from lexiloom.session import durable

PREFIX, INFLECTED, TRANSLATION, FUZZY, DEFINITION = range(5)
#: Rows fetched for each row wanted, before rows of one headword and part of speech are made one.
OVERFETCH = 3
#: The near-spelling rung runs for queries with fewer entries than this.
FUZZY_TRIGGER = 5
FUZZY_PREFIX, FUZZY_CANDIDATES, FUZZY_RESULTS, FUZZY_DISTANCE = 4, 200, 10, 2
#: Longest prefix that is used as a join key; the rest of a longer query is compared on the joined rows.
KEY_LENGTH = 4
BM25_K1, BM25_B = 1.2, 0.75
#: Up to so many different queries, some ten MB, are given to every task of a definition search; more are joined.
FEW_SETS = 50_000
RESULT = ["query_id", "entry_id", "headword", "pos", "match_kind", "score"]


def prefix_join(queries: DataFrame, query: str, rows: DataFrame, text: str) -> DataFrame:
    """Pairs of a query and a row whose ``text`` begins with it: an equi-join on short prefixes, the rest compared.

    Each row is given once for each length up to ``KEY_LENGTH``, so no range join is planned; the lengths that no query
    has meet nothing. A query of one letter meets as many rows as begin with it, and its rows are spread over the join's
    tasks by the adaptive skew join before the top is taken.
    """
    keyed_q = queries.filter(F.length(query) > 0).withColumn("_k", F.least(F.length(query), F.lit(KEY_LENGTH))).withColumn("_key", F.substring(F.col(query), F.lit(1), F.col("_k")))
    lengths = F.sequence(F.lit(1), F.least(F.lit(KEY_LENGTH), F.length(text)))
    keyed = rows.filter(F.length(text) > 0).select("*", F.explode(lengths).alias("_k")).withColumn("_key", F.substring(F.col(text), F.lit(1), F.col("_k")))
    return keyed_q.join(keyed, ["_k", "_key"]).filter(F.col(text).startswith(F.col(query))).drop("_k", "_key")


def _in_lang(queries: DataFrame) -> Column:
    return (F.col("q_lang").isNull() | (F.col("q_lang") == F.col("lang"))) if "q_lang" in queries.columns else F.lit(True)


def _top(rows: DataFrame, n: int, *order: Column, place: str = "_p") -> DataFrame:
    return rows.withColumn(place, F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col(place) <= n)


def first_of_word(rows: DataFrame, *order: Column) -> DataFrame:
    """The first row of each query, headword and part of speech; a null part of speech is one of its own."""
    w = Window.partitionBy("query_id", "headword", "pos").orderBy(*order)
    return rows.withColumn("_w", F.row_number().over(w)).filter("_w = 1").drop("_w")


def prefix_rung(queries: DataFrame, entry: DataFrame, limit: int = 30) -> DataFrame:
    """Headwords that begin with the query: the exact key first, then by rank, then by key."""
    met = prefix_join(queries, "q", entry, "norm").filter(_in_lang(queries))
    order = [F.when(F.col("norm") == F.col("q"), 0).otherwise(1), F.col("rank"), F.col("norm"), F.col("headword"), F.col("pos").asc_nulls_first(), F.col("lang"), F.col("id")]
    fetched = _top(met, limit * OVERFETCH, *order).withColumn("score", F.col("_p") - 1)
    kept = _top(first_of_word(fetched, F.col("_p")).drop("_p"), limit, F.col("score"))
    return kept.select("query_id", F.col("id").alias("entry_id"), "headword", "pos", F.lit(PREFIX).alias("match_kind"), "score")


def inflected_rung(queries: DataFrame, form: DataFrame, entry: DataFrame, limit: int = 30) -> DataFrame:
    """Entries one of whose forms is the query, by rank."""
    keys = form.select(F.col("norm").alias("q"), F.col("entry_id").alias("id")).distinct()
    met = queries.join(keys, "q").join(entry, "id").filter(_in_lang(queries))
    return _ranked(met, limit, INFLECTED)


def translation_rung(queries: DataFrame, trans: DataFrame, entry: DataFrame, limit: int = 30) -> DataFrame:
    """Entries with a translation that begins with the query, once each, by rank."""
    keys = trans.filter("entry_id IS NOT NULL").select(F.col("norm").alias("_tnorm"), F.col("entry_id").alias("id")).distinct()
    met = prefix_join(queries, "q", keys, "_tnorm").drop("_tnorm").distinct().join(entry, "id").filter(_in_lang(queries))
    return _ranked(met, limit, TRANSLATION)


def _ranked(met: DataFrame, limit: int, kind: int) -> DataFrame:
    top = _top(met, limit, F.col("rank"), F.col("id")).withColumn("score", F.col("_p") - 1)
    return top.select("query_id", F.col("id").alias("entry_id"), "headword", "pos", F.lit(kind).alias("match_kind"), "score")


def fuzzy_rung(queries: DataFrame, entry: DataFrame) -> DataFrame:
    """Near spellings: the first 200 entries whose ``fuzzy`` key shares four letters, of these the ten nearest within two
    edits of the query. ``queries`` needs ``q_fuzzy`` as well."""
    short = queries.withColumn("_fp", F.substring("q_fuzzy", 1, FUZZY_PREFIX))
    near = prefix_join(short, "_fp", entry, "fuzzy").filter(_in_lang(queries))
    fetched = _top(near, FUZZY_CANDIDATES, F.col("fuzzy"), F.col("norm"), F.col("id")).drop("_p")
    # The JVM's edit distance, in which a swap costs two, is never more than twice this one, and sifts before Python.
    sifted = fetched.filter((F.abs(F.length("q") - F.length("norm")) <= FUZZY_DISTANCE) & (F.levenshtein("q", "norm") <= 2 * FUZZY_DISTANCE))
    measured = sifted.withColumn("score", osa_distance_udf("q", "norm")).filter(F.col("score") <= FUZZY_DISTANCE)
    top = _top(measured, FUZZY_RESULTS, F.col("score"), F.col("fuzzy"), F.col("norm"), F.col("id"))
    return top.select("query_id", F.col("id").alias("entry_id"), "headword", "pos", F.lit(FUZZY).alias("match_kind"), "score")


def cascade(rungs: list[DataFrame], limit: int = 30) -> DataFrame:
    """The rungs in order made one list: a rung counts only for queries whose rungs before it found too few entries.

    The second and third run below ``limit`` entries, the fourth below ``FUZZY_TRIGGER``. Of an entry the better rung
    stands; of equal headword and part of speech the first row. ``place`` counts from 0.
    """
    rows = rungs[0].select(RESULT)
    for rung in rungs[1:]:
        rows = rows.unionByName(rung.select(RESULT))
    best = rows.groupBy("query_id", "entry_id").agg(F.min(F.struct("match_kind", "score", "headword", "pos")).alias("_b")).select("query_id", "entry_id", "_b.*")
    # A query has at most limit rows a rung, so the counts are over bounded lists. Gates close for good: an entry counts
    # at its best rung, and a rung that is shut implies that all later ones are.
    per = Window.partitionBy("query_id")
    n = [F.sum(F.when(F.col("match_kind") == k, 1).otherwise(0)).over(per) for k in (PREFIX, INFLECTED, TRANSLATION)]
    gated = best.withColumns({"_n0": n[0], "_n1": n[0] + n[1], "_n2": n[0] + n[1] + n[2]})
    open_ = (
        F.when(F.col("match_kind") == INFLECTED, F.col("_n0") < limit)
        .when(F.col("match_kind") == TRANSLATION, F.col("_n1") < limit)
        .when(F.col("match_kind") == FUZZY, F.col("_n2") < FUZZY_TRIGGER)
        .otherwise(True)
    )
    order = [F.col("match_kind"), F.col("score"), F.col("entry_id")]
    kept = _top(first_of_word(gated.filter(open_), *order), limit, *order, place="place")
    return kept.select(*RESULT, (F.col("place") - 1).alias("place"))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(term, entry_id, tf, n_terms)``: an inverted index of a column of ``norm`` keys."""
    terms = docs.select(F.col(key).alias("entry_id"), F.split(F.col(text), " ").alias("_t")).filter(F.element_at("_t", 1) != "")
    each = terms.select("entry_id", F.size("_t").alias("n_terms"), F.explode("_t").alias("term"))
    return each.groupBy("term", "entry_id", "n_terms").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, index: DataFrame, limit: int = 30) -> DataFrame:
    """As ``bm25_texts``, over what ``postings`` gives."""
    terms = F.flatten(F.collect_list(F.expr("array_repeat(term, CAST(tf AS INT))")))
    return _bm25(queries, index.groupBy("entry_id").agg(F.first("n_terms").alias("n_terms"), terms.alias("_t")), limit)


def bm25_texts(queries: DataFrame, docs: DataFrame, key: str, text: str, limit: int = 30) -> DataFrame:
    """``(query_id, entry_id, relevance, place)``: entries that hold all words of a query, the most relevant first.

    ``docs`` has a row an entry and is read several times; ``text`` is a ``norm`` key. Words that half of all entries hold,
    or more, weigh next to nothing but must occur. Relevance is rounded to nine places, so that an order of addition
    doesn't decide a tie.
    """
    terms = docs.select(F.col(key).alias("entry_id"), F.split(F.col(text), " ").alias("_t")).filter(F.element_at("_t", 1) != "")
    return _bm25(queries, terms.select("entry_id", F.size("_t").alias("n_terms"), "_t"), limit)


def _bm25(queries: DataFrame, texts: DataFrame, limit: int) -> DataFrame:
    """The search over ``(entry_id, n_terms, _t)``, ``_t`` being the words of an entry as often as they occur.

    Queries of the same words have the same answer, which is found once for all of them. No text is shuffled for it unless
    more than ``FEW_SETS`` different ones are asked.
    """
    total = texts.agg(F.count("*").alias("n"), F.avg("n_terms").alias("mean")).collect()[0]  # one row
    words = F.sort_array(F.array_distinct(F.split("q", " ")))
    asked = queries.filter(F.length("q") > 0).select("query_id", F.array_join(words, " ").alias("_set"))
    each = asked.select("_set").distinct().select("_set", F.explode(F.split("_set", " ")).alias("term"))
    once = texts.select("entry_id", "n_terms", "_t", F.explode(F.array_distinct("_t")).alias("term"))
    idf = F.log((F.lit(total["n"]) - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    df = once.groupBy("term").agg(F.count("*").alias("_df")).withColumn("_weight", F.when(idf > 0, idf).otherwise(F.lit(1e-6)))
    sets = each.join(df, "term", "left").groupBy("_set").agg(F.sort_array(F.collect_list(F.struct("_df", "term", "_weight"))).alias("_words"), F.count("_df").alias("_known"))
    # Only entries of its rarest word can hold all words of a set, so a frequent word is looked up in those alone.
    sets = durable(sets.filter("_known = size(_words)").select("_set", "_words", F.col("_words.term").alias("_terms"), F.col("_words")[0]["term"].alias("term")))
    met = once.join(F.broadcast(sets) if sets.count() <= FEW_SETS else sets, "term").filter(F.size(F.array_intersect("_terms", "_t")) == F.size("_terms"))

    def part(word: Column) -> Column:
        tf = F.size(F.filter("_t", lambda t: t == word["term"]))
        return word["_weight"] * tf * (BM25_K1 + 1) / (tf + F.lit(BM25_K1) * (F.lit(1 - BM25_B) + F.lit(BM25_B) * F.col("n_terms") / F.lit(total["mean"] or 1.0)))

    scored = met.select("_set", "entry_id", F.round(F.aggregate("_words", F.lit(0.0), lambda sum_, word: sum_ + part(word)), 9).alias("relevance"))
    per_set = Window.partitionBy("_set").orderBy(F.col("relevance").desc(), "entry_id")
    top = scored.withColumn("place", F.row_number().over(per_set)).filter(F.col("place") <= limit)
    return asked.join(top, "_set").select("query_id", "entry_id", "relevance", (F.col("place") - 1).alias("place"))


def resolve(keys: DataFrame, form: DataFrame, entry: DataFrame, key: str = "norm") -> DataFrame:
    """``(key, entry_id, via)``: the best entry of each key, as a headword if there is one, else as an inflected form."""
    wanted = keys.filter(F.length(key) > 0).select(F.col(key).alias("_key")).distinct()
    lemma_order = [F.col("rank"), F.col("headword"), F.col("pos").asc_nulls_first(), F.col("lang"), F.col("id")]
    as_lemma = wanted.join(entry, F.col("_key") == F.col("norm")).withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy(*lemma_order))).filter("_r = 1").select("_key", F.col("id").alias("entry_id"), F.lit("lemma").alias("via"))
    rest = wanted.join(as_lemma.select("_key"), "_key", "left_anti")
    pairs = form.select(F.col("norm").alias("_key"), F.col("entry_id").alias("id")).distinct()
    as_form = rest.join(pairs, "_key").join(entry.select("id", "rank"), "id").groupBy("_key").agg(F.min(F.struct("rank", "id")).alias("_m")).select("_key", F.col("_m.id").alias("entry_id"), F.lit("form").alias("via"))
    return as_lemma.unionByName(as_form).withColumnRenamed("_key", key)


def coverage_band(query: Column, headword: Column) -> Column:
    """How much of the headword has been typed: 0 for nearly all of it to 3."""
    share = F.length(query) / F.length(headword)
    return F.when(F.length(headword) == 0, 3).when(share >= 0.85, 0).when(share >= 0.60, 1).when(share >= 0.40, 2).otherwise(3)


def merge_packs(rows: DataFrame, limit: int = 30) -> DataFrame:
    """The lists of several packs as one, definitions before translations.

    ``rows``: ``query_id, query, pack_id, entry_id, headword, pos, match_kind, score, has_frequency, active, by_frequency,
    bilingual``. Each part keeps the first row of a headword and part of speech in the total order below; a translation
    whose word is among the definitions falls out, so that a word is shown once.
    """
    is_prefix = F.col("match_kind") == PREFIX
    band = coverage_band(F.col("query"), F.col("headword"))
    exact = F.lower("query") == F.lower("headword")
    proper = F.col("pos").isin("name", "proper noun") & ~(exact | (band == 0))
    order = [
        F.col("match_kind"),
        F.when(is_prefix & F.coalesce(proper, F.lit(False)), 1).otherwise(0),
        F.when(is_prefix & ~F.col("has_frequency"), 1).otherwise(0),
        F.when(is_prefix, band).otherwise(0),
        F.when(F.col("active"), 0).otherwise(1),
        F.col("score"),
        F.when(F.col("by_frequency"), 0).otherwise(1),
        F.col("headword"),
        F.col("pack_id"),
        F.col("entry_id"),
    ]
    section = F.when(F.col("bilingual"), 1).otherwise(0)
    # Sections in order, and only the first row of a word: a translation whose word a definition shows loses here.
    word = Window.partitionBy("query_id", "headword", "pos").orderBy(section, *order)
    first = rows.withColumn("_w", F.row_number().over(word)).filter("_w = 1")
    kept = _top(first, limit, section, *order, place="place")
    return kept.select("query_id", "pack_id", "entry_id", "headword", "pos", "match_kind", "score", (F.col("place") - 1).alias("place"))
