"""Search queries over the pack tables: every entry whose id is divisible by 20 is a query, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import text as X
from lexiloom.operators import search as S
from lexiloom.plans import pack
from lexiloom.session import durable

LIMIT = 30
PREFIX_LENGTH = 3
#: What the probe of an empty search counts to, and more than any list has.
PROBE_LIMIT, EVERY = 9, 2**31 - 1
PROBE_LETTERS = 4


def q2_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headwords by prefix, for queries of three letters."""
    return S.prefix_rung(pack.queries(spark, sf_dir, PREFIX_LENGTH), pack.entry(spark, sf_dir), LIMIT)


def q3_inflected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by inflected form; queries are the forms of every entry whose id is divisible by 20."""
    forms = pack.form(spark, sf_dir).filter("entry_id % 20 = 0")
    queries = forms.select(F.col("norm").alias("query_id"), F.col("norm").alias("q")).distinct()
    return S.inflected_rung(queries, pack.form(spark, sf_dir), pack.entry(spark, sf_dir), LIMIT)


def q4_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by prefix of a translation; queries are four letters of the keys that lead to ids divisible by 20."""
    queries = pack.trans(spark, sf_dir).filter("entry_id % 20 = 0").select(F.substring("norm", 1, 4).alias("q")).distinct()
    return S.translation_rung(queries.withColumn("query_id", F.col("q")), pack.trans(spark, sf_dir), pack.entry(spark, sf_dir), LIMIT)


def q5_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near spellings of queries with two letters exchanged."""
    return S.fuzzy_rung(pack.typo_queries(spark, sf_dir), pack.entry(spark, sf_dir))


def _suggest(spark: SparkSession, sf_dir: str, queries: DataFrame, fuzzy: bool) -> DataFrame:
    entry, form, trans = pack.entry(spark, sf_dir), pack.form(spark, sf_dir), pack.trans(spark, sf_dir)
    rungs = [S.prefix_rung(queries, entry, LIMIT), S.inflected_rung(queries, form, entry, LIMIT), S.translation_rung(queries, trans, entry, LIMIT)]
    return S.cascade(rungs + ([S.fuzzy_rung(queries, entry)] if fuzzy else []), LIMIT)


def q1_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade without its last rung, for queries of five letters in their own language."""
    return _suggest(spark, sf_dir, pack.queries(spark, sf_dir, 5), fuzzy=False)


def q1_suggest_misspelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cascade, for misspelt queries."""
    return _suggest(spark, sf_dir, pack.typo_queries(spark, sf_dir), fuzzy=True)


def _definition_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.postings(pack.staging(spark, sf_dir).select("id", X.norm(F.col("fts_body")).alias("words")), "id", "words")


def q6_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions by their words: queries are two words of the definition of every entry whose id is divisible by 20."""
    texts = durable(pack.staging(spark, sf_dir).select("id", X.norm(F.col("fts_body")).alias("words")))
    queries = texts.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.array_join(F.slice(F.split("words", " "), -2, 2), " ").alias("q")).filter(F.size(F.split("q", " ")) == 2)
    return S.bm25_texts(queries, texts, "id", "words", LIMIT)


def agg26_bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What relevance rests on: entries, mean length, and entries and occurrences of each word."""
    index = _definition_index(spark, sf_dir)
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def q7_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by id with their decoded payload."""
    from lexiloom.operators.payload import inflate

    rows = pack.entry(spark, sf_dir, payload=True).filter("id % 20 = 0")
    return rows.select("id", "headword", "pos", inflate(F.col("payload")).alias("body"))


def q8_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the definitions resolved to its best entry, headwords before forms."""
    words = F.explode(F.split(X.norm(F.col("fts_body")), " "))
    keys = pack.staging(spark, sf_dir).select(words.alias("norm")).union(pack.form(spark, sf_dir).filter("entry_id % 20 = 0").select("norm"))
    return S.resolve(keys, pack.form(spark, sf_dir), pack.entry(spark, sf_dir))


def q9_entry_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id of an entry by key and uid, as a link from another pack finds it."""
    wanted = pack.staging(spark, sf_dir).filter("id % 20 = 0").select("norm", "uid").distinct()
    return wanted.join(pack.entry(spark, sf_dir).select("norm", "uid", "id"), ["norm", "uid"])


def q10_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line under a headword: its first gloss, shortened; a mark where there is none."""
    gloss = F.regexp_extract("body", "(?m)^S\\t(.+)$", 1)
    text = F.when(gloss == "", F.lit(None)).otherwise(gloss)
    return pack.staging(spark, sf_dir).select("id", "headword", F.coalesce(X.ellipsize(text), F.lit("-")).alias("preview"))


def _two_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix results of two packs: the odd and the even ids, the even ones being bilingual and by richness."""
    entry, queries = pack.entry(spark, sf_dir), pack.queries(spark, sf_dir, 4).drop("q_lang")
    rows = None
    for name, rest in (("main", 1), ("extra", 0)):
        found = S.prefix_rung(queries, entry.filter(F.col("id") % 2 == rest), LIMIT)
        one = found.select("*", F.lit(name).alias("pack_id"), F.lit(rest == 1).alias("active"), F.lit(rest == 1).alias("by_frequency"), F.lit(rest == 0).alias("bilingual"))
        rows = one if rows is None else rows.unionByName(one)
    ranks = entry.select(F.col("id").alias("entry_id"), (F.col("rank") < 500).alias("has_frequency"))
    return rows.join(ranks, "entry_id").join(queries.select("query_id", F.col("q").alias("query")), "query_id")


def q12_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of two packs merged."""
    return S.merge_packs(_two_packs(spark, sf_dir), LIMIT)


def q13_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries for which no row of their own language is exact or nearly typed out, so other languages are asked."""
    queries = pack.queries(spark, sf_dir, 6)
    own = S.prefix_rung(queries, pack.entry(spark, sf_dir), LIMIT).join(queries.select("query_id", "q"), "query_id")
    enough = own.filter((F.lower("q") == F.lower("headword")) | (S.coverage_band(F.col("q"), F.col("headword")) == 0)).select("query_id").distinct()
    return queries.select("query_id", "q").join(enough.withColumn("_e", F.lit(True)), "query_id", "left").select("query_id", "q", F.col("_e").isNull().alias("needs_fallback"))


def q19_visit_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved visits (staging rows) found again in the pack: as they were, moved to another id, or missing."""
    visits = pack.staging(spark, sf_dir).select(F.col("id").alias("visit_id"), "uid", "norm")
    entry = pack.entry(spark, sf_dir).select("id", "uid", "norm")
    by_id = entry.select(F.col("id").alias("_i"), F.col("uid").alias("_iu"))
    by_uid = entry.groupBy("uid").agg(F.min("id").alias("_u"))
    by_norm = entry.groupBy("norm").agg(F.min("id").alias("_n"))
    joined = visits.join(by_id, (F.col("visit_id") == F.col("_i")) & (F.col("uid") == F.col("_iu")), "left").join(by_uid, "uid", "left").join(by_norm, "norm", "left")
    state = F.when(F.col("_i").isNotNull(), "direct").when(F.coalesce("_u", "_n").isNotNull(), "relocated").otherwise("missing")
    return joined.select("visit_id", state.alias("state"), F.coalesce("_i", "_u", "_n").alias("entry_id"))


def empty_probe(queries: DataFrame, entry: DataFrame, form: DataFrame, trans: DataFrame, definitions: DataFrame) -> DataFrame:
    """``(query_id, n_definitions, n_other)`` of the queries that the whole cascade answers nothing in their language.

    The definitions of their language that hold all their words, and what the whole cascade finds in each other language
    for the uncut query, both counted to ``PROBE_LIMIT``. ``definitions`` has ``id, lang, words``. A query without text is
    not probed.
    """
    queries = queries.select("query_id", "q", "q_lang", X.fuzzy(F.col("q"), F.col("q_lang")).alias("q_fuzzy")).filter("q <> ''")
    # The cascade is empty where every rung is, so the dear last one is asked only for what the others left over.
    cheap = S.prefix_rung(queries, entry, 1).unionByName(S.inflected_rung(queries, form, entry, 1)).unionByName(S.translation_rung(queries, trans, entry, 1))
    left = durable(queries.join(cheap.select("query_id").distinct(), "query_id", "left_anti"))
    empty = durable(left.join(S.fuzzy_rung(left, entry).select("query_id").distinct(), "query_id", "left_anti"))
    langs = [r.lang for r in entry.select("lang").filter("lang IS NOT NULL").distinct().collect()]  # a row a language
    each = empty.select("query_id", "q", "q_lang", F.explode(F.array(*map(F.lit, langs)).cast("array<string>")).alias("_l")).filter("_l <> q_lang")
    asked = durable(each.select(F.struct("query_id", "_l").alias("query_id"), "q", F.col("_l").alias("q_lang"), X.fuzzy(F.col("q"), F.col("_l")).alias("q_fuzzy")))
    rungs = [S.prefix_rung(asked, entry, PROBE_LIMIT), S.inflected_rung(asked, form, entry, PROBE_LIMIT), S.translation_rung(asked, trans, entry, PROBE_LIMIT), S.fuzzy_rung(asked, entry)]
    other = S.cascade(rungs, PROBE_LIMIT).groupBy(F.col("query_id.query_id").alias("query_id")).agg(F.count("*").alias("n_other"))
    # All that match are taken before the language is looked at, so that no other language's use up the limit.
    held = S.bm25_texts(empty, definitions, "id", "words", EVERY).join(definitions.select(F.col("id").alias("entry_id"), "lang"), "entry_id").join(empty.select("query_id", "q_lang"), "query_id")
    defined = held.filter("q_lang IS NULL OR q_lang = lang").groupBy("query_id").agg(F.count("*").alias("n_definitions"))
    capped = [F.least(F.coalesce(c, F.lit(0)), F.lit(PROBE_LIMIT)).cast("bigint").alias(c) for c in ("n_definitions", "n_other")]
    return empty.select("query_id").join(defined, "query_id", "left").join(other, "query_id", "left").select("query_id", *capped)


def short_probe(queries: DataFrame, entry: DataFrame) -> DataFrame:
    """``(query_id, n_other)`` of the queries that no headword of their language begins with.

    The entries of all languages that begin with the first four letters, counted to ``PROBE_LIMIT``. An empty text begins
    every headword; a query without a language has none in it.
    """
    begins = F.explode(F.sequence(F.lit(0), F.length("norm"))).alias("_n")
    prefixes = entry.filter("norm IS NOT NULL").select("lang", "norm", begins).groupBy(F.expr("substring(norm, 1, _n)").alias("_p"), "lang").agg(F.count("*").alias("n"))
    asked = queries.select("query_id", "q", "q_lang")
    met = prefixes.join(asked.select(F.col("q").alias("_p"), F.col("q_lang").alias("lang")).distinct(), ["_p", "lang"], "left_semi")
    empty = asked.join(met.select(F.col("_p").alias("q"), F.col("lang").alias("q_lang")), ["q", "q_lang"], "left_anti").select("query_id", F.substring("q", 1, PROBE_LETTERS).alias("_p"))
    others = prefixes.filter(F.length("_p") <= PROBE_LETTERS).groupBy("_p").agg(F.sum("n").alias("n"))
    return empty.join(others, "_p", "left").select("query_id", F.least(F.coalesce("n", F.lit(0)), F.lit(PROBE_LIMIT)).cast("bigint").alias("n_other"))


def q20_empty_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For misspelt queries that begin no headword of their language: how many entries begin with their first letters, counted to nine."""
    return short_probe(pack.typo_queries(spark, sf_dir), durable(pack.entry(spark, sf_dir)))


def q20_whole_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For queries without a result in their language: how many definitions and how many entries of other languages have one, counted to nine."""
    definitions = durable(pack.staging(spark, sf_dir).select("id", "lang", X.norm(F.col("fts_body")).alias("words")))
    return empty_probe(pack.typo_queries(spark, sf_dir), durable(pack.entry(spark, sf_dir)), pack.form(spark, sf_dir), pack.trans(spark, sf_dir), definitions)


_PREFIX_SQL = """
met AS (SELECT q.query_id, q.q, e.* FROM {queries} q JOIN {entry} e ON starts_with(e.norm, q.q) AND length(q.q) > 0 {lang}),
fetched AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN norm = q THEN 0 ELSE 1 END, rank, norm, headword, pos NULLS FIRST, lang, id) - 1 AS score FROM met) WHERE score < 90),
word AS (SELECT *, row_number() OVER (PARTITION BY query_id, headword, pos ORDER BY score) AS w FROM fetched),
prefix_rung AS (SELECT query_id, id AS entry_id, headword, pos, 0 AS match_kind, CAST(score AS INT) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score) AS p FROM word WHERE w = 1) WHERE p <= 30)
"""
_OWN_LANG = "AND q.q_lang = e.lang"


def _prefix_sql(length: int, lang: bool = True) -> str:
    return f"WITH {pack.SQL}, {pack.queries_sql(length)}, {_PREFIX_SQL.format(queries='query', entry='pack_entry', lang=_OWN_LANG if lang else '')}"


_RANKED_SQL = """
SELECT query_id, id AS entry_id, headword, pos, {kind} AS match_kind, CAST(p - 1 AS INT) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, id) AS p FROM {met}) WHERE p <= 30
"""

_BM25 = f"""
WITH {pack.SQL},
text AS (SELECT id, {X.norm_sql('fts_body')} AS words FROM pack_staging),
occurrence AS (SELECT id AS entry_id, unnest(string_split(words, ' ')) AS term, len(string_split(words, ' ')) AS n_terms FROM text WHERE words <> ''),
posting AS (SELECT term, entry_id, n_terms, count(*) AS tf FROM occurrence GROUP BY ALL)
"""

_TYPO = f"""typo AS (SELECT id AS query_id, {X.norm_sql("concat(substr(norm, 1, 5), substr(norm, 7, 1), substr(norm, 6, 1), substr(norm, 8))")} AS q, lang AS q_lang, fuzzy AS q_fuzzy
  FROM pack_entry WHERE id % 20 = 0 AND length(norm) >= 7)"""

QUERIES = {
    f.__name__: f
    for f in (q1_suggest, q1_suggest_misspelt, q2_prefix, q3_inflected, q4_translation, q5_fuzzy, q6_definitions, agg26_bm25_stats, q7_entry, q8_resolve, q9_entry_id, q10_previews, q12_merge, q13_fallback, q19_visit_target, q20_empty_probe, q20_whole_probe)
}

ORACLES = {
    "q2_prefix": _prefix_sql(PREFIX_LENGTH) + "SELECT * FROM prefix_rung",
    "q3_inflected": f"""WITH {pack.SQL},
query AS (SELECT DISTINCT norm AS query_id, norm AS q FROM pack_form WHERE entry_id % 20 = 0),
met AS (SELECT q.query_id, e.* FROM query q JOIN pack_form f ON f.norm = q.q JOIN pack_entry e ON e.id = f.entry_id)
{_RANKED_SQL.format(kind=1, met='met')}""",
    "q4_translation": f"""WITH {pack.SQL},
query AS (SELECT DISTINCT substr(norm, 1, 4) AS query_id, substr(norm, 1, 4) AS q FROM pack_trans WHERE entry_id % 20 = 0),
met AS (SELECT q.query_id, e.* FROM (SELECT DISTINCT query_id, entry_id FROM query JOIN pack_trans ON starts_with(norm, q) AND length(q) > 0) q JOIN pack_entry e ON e.id = q.entry_id)
{_RANKED_SQL.format(kind=2, met='met')}""",
    "q1_suggest": _prefix_sql(5)
    + f""",
inflected_met AS (SELECT q.query_id, e.* FROM query q JOIN pack_form f ON f.norm = q.q JOIN pack_entry e ON e.id = f.entry_id WHERE e.lang = q.q_lang),
inflected_rung AS ({_RANKED_SQL.format(kind=1, met='inflected_met')}),
trans_met AS (SELECT q.query_id, e.* FROM (SELECT DISTINCT query_id, q_lang, entry_id FROM query JOIN pack_trans ON starts_with(norm, q) AND length(q) > 0) q JOIN pack_entry e ON e.id = q.entry_id WHERE e.lang = q.q_lang),
trans_rung AS ({_RANKED_SQL.format(kind=2, met='trans_met')}),
rung AS (SELECT * FROM prefix_rung UNION ALL SELECT * FROM inflected_rung UNION ALL SELECT * FROM trans_rung),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, entry_id ORDER BY match_kind, score) AS b FROM rung) WHERE b = 1),
counted AS (SELECT *, sum(CASE WHEN match_kind = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS n0,
  sum(CASE WHEN match_kind <= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS n1 FROM best),
gated AS (SELECT * FROM counted WHERE match_kind = 0 OR (match_kind = 1 AND n0 < 30) OR (match_kind = 2 AND n1 < 30)),
unique_word AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, headword, pos ORDER BY match_kind, score, entry_id) AS uw FROM gated) WHERE uw = 1)
SELECT query_id, entry_id, headword, pos, match_kind, score, CAST(p - 1 AS INT) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY match_kind, score, entry_id) AS p FROM unique_word) WHERE p <= 30""",
    "q20_empty_probe": f"""WITH {pack.SQL}, {_TYPO},
empty AS (SELECT query_id, substr(q, 1, 4) AS q FROM typo t WHERE NOT EXISTS (SELECT 1 FROM pack_entry e WHERE starts_with(e.norm, t.q) AND e.lang = t.q_lang))
SELECT query_id, CAST(least(9, (SELECT count(*) FROM pack_entry e WHERE starts_with(e.norm, empty.q))) AS BIGINT) AS n_other FROM empty""",
    "q6_definitions": _BM25
    + f""",
query AS (SELECT id AS query_id, list_reverse(list_reverse(string_split(words, ' '))[1:2]) AS terms FROM text WHERE id % 20 = 0 AND len(string_split(words, ' ')) >= 2),
query_word AS (SELECT query_id, unnest(list_distinct(terms)) AS term, len(list_distinct(terms)) AS n_words FROM query),
total AS (SELECT count(*) AS n, avg(n_terms) AS mean FROM (SELECT DISTINCT entry_id, n_terms FROM posting)),
frequency AS (SELECT term, count(*) AS df FROM posting GROUP BY term),
weighted AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS weight FROM frequency, total),
scored AS (SELECT query_id, entry_id, any_value(n_words) AS n_words, count(*) AS got,
  round(sum(weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_terms / mean))), 9) AS relevance
  FROM query_word JOIN weighted USING (term) JOIN posting USING (term), total GROUP BY query_id, entry_id)
SELECT query_id, entry_id, relevance, CAST(p - 1 AS INT) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, entry_id) AS p FROM scored WHERE got = n_words) WHERE p <= 30""",
    "agg26_bm25_stats": _BM25 + "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM posting GROUP BY term",
    "q8_resolve": f"""WITH {pack.SQL},
key AS (SELECT DISTINCT unnest(string_split({X.norm_sql('fts_body')}, ' ')) AS norm FROM pack_staging UNION SELECT norm FROM pack_form WHERE entry_id % 20 = 0),
wanted AS (SELECT DISTINCT norm FROM key WHERE norm <> ''),
lemma AS (SELECT norm, id AS entry_id, 'lemma' AS via FROM (SELECT w.norm, e.id, row_number() OVER (PARTITION BY w.norm ORDER BY rank, headword, pos NULLS FIRST, lang, id) AS r FROM wanted w JOIN pack_entry e ON e.norm = w.norm) WHERE r = 1),
inflected AS (SELECT norm, id AS entry_id, 'form' AS via FROM (SELECT w.norm, e.id, row_number() OVER (PARTITION BY w.norm ORDER BY rank, e.id) AS r FROM wanted w JOIN pack_form f ON f.norm = w.norm JOIN pack_entry e ON e.id = f.entry_id WHERE w.norm NOT IN (SELECT norm FROM lemma)) WHERE r = 1)
SELECT * FROM lemma UNION ALL SELECT * FROM inflected""",
    "q9_entry_id": f"WITH {pack.SQL} SELECT w.norm, w.uid, e.id FROM (SELECT DISTINCT norm, uid FROM pack_staging WHERE id % 20 = 0) w JOIN pack_entry e ON e.norm = w.norm AND e.uid = w.uid",
    "q10_previews": f"""WITH {pack.SQL},
gloss AS (SELECT id, headword, nullif(regexp_extract(body, '(?m)^S\\t(.+)$', 1), '') AS g FROM pack_staging),
head AS (SELECT *, substr(g, 1, 48) AS h FROM gloss),
cut AS (SELECT *, length(h) - instr(reverse(h), ' ') AS cut_at FROM head)
SELECT id, headword, coalesce(CASE WHEN length(g) <= 48 THEN g
  ELSE concat(regexp_replace(CASE WHEN instr(h, ' ') > 0 AND cut_at > 24 THEN substr(h, 1, cut_at) ELSE h END, '[ ,;:]+$', ''), '…') END, '-') AS preview FROM cut""",
    "q12_merge": f"""WITH {pack.SQL}, {pack.queries_sql(4)},
met AS (SELECT q.query_id, q.q, e.id % 2 = 1 AS active, e.* FROM query q JOIN pack_entry e ON starts_with(e.norm, q.q) AND length(q.q) > 0),
fetched AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, active ORDER BY CASE WHEN norm = q THEN 0 ELSE 1 END, rank, norm, headword, pos NULLS FIRST, lang, id) - 1 AS score FROM met) WHERE score < 90),
word AS (SELECT *, row_number() OVER (PARTITION BY query_id, active, headword, pos ORDER BY score) AS w FROM fetched),
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, active ORDER BY score) AS p FROM word WHERE w = 1) WHERE p <= 30),
keyed AS (SELECT *, CASE WHEN active THEN 'main' ELSE 'extra' END AS pack_id, CASE WHEN active THEN 0 ELSE 1 END AS section,
  CASE WHEN length(headword) = 0 THEN 3 WHEN length(q) / length(headword) >= 0.85 THEN 0 WHEN length(q) / length(headword) >= 0.6 THEN 1 WHEN length(q) / length(headword) >= 0.4 THEN 2 ELSE 3 END AS band FROM own),
placed AS (SELECT *, CASE WHEN coalesce(pos IN ('name', 'proper noun'), false) AND NOT (lower(q) = lower(headword) OR band = 0) THEN 1 ELSE 0 END AS proper FROM keyed),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, headword, pos ORDER BY section, proper, CASE WHEN rank < 500 THEN 0 ELSE 1 END, band, section, score, section, headword, pack_id, id) AS f FROM placed) WHERE f = 1)
SELECT query_id, pack_id, id AS entry_id, headword, pos, 0 AS match_kind, CAST(score AS INT) AS score, CAST(n - 1 AS INT) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY section, proper, CASE WHEN rank < 500 THEN 0 ELSE 1 END, band, section, score, section, headword, pack_id, id) AS n FROM first) WHERE n <= 30""",
    "q13_fallback": _prefix_sql(6)
    + """SELECT q.query_id, q.q, NOT EXISTS (SELECT 1 FROM prefix_rung r WHERE r.query_id = q.query_id AND (lower(q.q) = lower(r.headword) OR length(q.q) / length(r.headword) >= 0.85)) AS needs_fallback FROM query q""",
    "q19_visit_target": f"""WITH {pack.SQL},
joined AS (SELECT s.id AS visit_id, d.id AS i, (SELECT min(id) FROM pack_entry e WHERE e.uid = s.uid) AS u, (SELECT min(id) FROM pack_entry e WHERE e.norm = s.norm) AS n
  FROM pack_staging s LEFT JOIN pack_entry d ON d.id = s.id AND d.uid = s.uid)
SELECT visit_id, CASE WHEN i IS NOT NULL THEN 'direct' WHEN coalesce(u, n) IS NOT NULL THEN 'relocated' ELSE 'missing' END AS state, coalesce(i, u, n) AS entry_id FROM joined""",
}
