"""Queries over words inside glosses, word-level lines, both directions of a bilingual pack, and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import gloss as G
from lexiloom.functions import text as X
from lexiloom.operators import lexicon as L
from lexiloom.operators import payload as B
from lexiloom.operators import search as S
from lexiloom.plans import pack
from lexiloom.session import table


def _glosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.staging(spark, sf_dir).select("id", F.explode(F.regexp_extract_all("body", F.lit("(?m)^S\\t(.+)$"), 1)).alias("gloss")).distinct()


def str17_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words each gloss has, and how many letters their keys."""
    words = G.spans_udf("gloss")
    rows = _glosses(spark, sf_dir).select("id", "gloss", words.alias("w"))
    return rows.select("id", "gloss", F.size("w").alias("n_words"), F.array_join(F.transform("w", lambda x: x["key"]), " ").alias("keys"))


def q21_tappable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of glosses, examples and relations that lead somewhere, with the entry each leads to."""
    texts = pack.staging(spark, sf_dir).select(F.explode(F.regexp_extract_all("body", F.lit("(?m)^[SETYAR]\\t(.+)$"), 1)).alias("gloss")).distinct()
    words = texts.select(F.explode(G.spans_udf("gloss")).alias("w")).select(F.col("w.key").alias("norm")).distinct()
    return S.resolve(words, pack.form(spark, sf_dir), pack.entry(spark, sf_dir))


def q28_bidirectional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions of the pack."""
    rows = L.both_directions(pack.entry(spark, sf_dir), pack.trans(spark, sf_dir))
    return rows.select("direction", "headword", "pos", "rank", F.array_join("equivalents", "|").alias("equivalents"))


def join19_expanded_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translation keys with the forms of those that are headwords themselves."""
    from lexiloom.sources.dumps import inflections

    return L.expanded_keys(pack.trans(spark, sf_dir), inflections(pack.form(spark, sf_dir), pack.entry(spark, sf_dir)))


def join12_glued_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of one sense without example that got the shortest sentence of their key."""
    sentences = pack.sentences(spark, sf_dir).filter("norm IS NOT NULL").groupBy("norm").agg(F.min(F.struct(F.length("texto").alias("n"), "texto")).alias("_m"))
    rows = pack.staging(spark, sf_dir)
    examples = rows.select("headword", "pos", "norm").distinct().join(sentences, "norm").groupBy("headword", "pos").agg(F.min("_m.texto").alias("example"))
    return B.glued_examples(rows, examples).select("id", "body")


def top10_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred most used words of the documents."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(X.norm(F.col("text")), " ")).alias("word")).filter("word <> ''")
    return L.most_used(words, "word", 100)


def pay3_word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What bodies say of the word itself."""
    rows = B.word_lines(pack.staging(spark, sf_dir))
    return rows.select("id", "pos", "pronunciation", F.size("word_translations").alias("n_translations"), F.size("forms").alias("n_forms"))


def pay5_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations that point to a sense, written and split again."""
    gloss = F.regexp_extract("body", "(?m)^S\\t(.+)$", 1)
    rows = pack.staging(spark, sf_dir).select("id", G.translation_ref(F.col("headword"), X.sense_code(F.col("uid"), gloss)).alias("ref"))
    return rows.select("id", G.split_ref(F.col("ref")).alias("r")).select("id", "r.term", "r.sense")


def dat1_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day of each snapshot's version, and the version a pack of its last row would get."""
    rows = table(spark, sf_dir, "entry_snapshot").groupBy("data_version").agg(F.max("loaded_at").alias("_l"))
    return rows.select("data_version", G.version_date(F.col("data_version")).alias("day"), G.version_stamp(F.col("_l")).alias("stamp"))


_WITH = f"WITH {pack.SQL}"
_GLOSS = "gloss AS (SELECT DISTINCT id, unnest(regexp_extract_all(body, '(?m)^S\\t(.+)$', 1)) AS gloss FROM pack_staging)"

QUERIES = {f.__name__: f for f in (str17_tokens, q21_tappable, q28_bidirectional, join19_expanded_keys, join12_glued_examples, top10_corpus, pay3_word_lines, pay5_references, dat1_versions)}

ORACLES = {
    "str17_tokens": f"{_WITH}, {_GLOSS}, keyed AS (SELECT *, {X.norm_sql('gloss')} AS keys FROM gloss) SELECT id, gloss, CAST(len(list_filter(string_split(keys, ' '), lambda w: w <> '')) AS INT) AS n_words, keys FROM keyed",
    "q21_tappable": f"""{_WITH}, gloss AS (SELECT DISTINCT unnest(regexp_extract_all(body, '(?m)^[SETYAR]\\t(.+)$', 1)) AS gloss FROM pack_staging),
wanted AS (SELECT DISTINCT norm FROM (SELECT unnest(string_split({X.norm_sql('gloss')}, ' ')) AS norm FROM gloss) WHERE norm <> ''),
lemma AS (SELECT norm, id AS entry_id, 'lemma' AS via FROM (SELECT w.norm, e.id, row_number() OVER (PARTITION BY w.norm ORDER BY rank, headword, pos NULLS FIRST, lang, id) AS r FROM wanted w JOIN pack_entry e ON e.norm = w.norm) WHERE r = 1),
inflected AS (SELECT norm, id AS entry_id, 'form' AS via FROM (SELECT w.norm, e.id, row_number() OVER (PARTITION BY w.norm ORDER BY rank, e.id) AS r FROM wanted w JOIN pack_form f ON f.norm = w.norm JOIN pack_entry e ON e.id = f.entry_id WHERE w.norm NOT IN (SELECT norm FROM lemma)) WHERE r = 1)
SELECT * FROM lemma UNION ALL SELECT * FROM inflected""",
    "q28_bidirectional": f"""{_WITH}, member AS (SELECT DISTINCT t.norm AS key, rank, headword, pos FROM pack_trans t JOIN pack_entry e ON e.id = t.entry_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank, headword, pos NULLS FIRST) AS n FROM member)
SELECT 'forward' AS direction, headword, pos, rank, '' AS equivalents FROM pack_entry UNION ALL
SELECT 'reverse', key, max(CASE WHEN n = 1 THEN pos END), max(CASE WHEN n = 1 THEN rank END), string_agg(headword, '|' ORDER BY n) FROM placed WHERE n <= 8 GROUP BY key""",
    "join19_expanded_keys": f"""{_WITH}, pair AS (SELECT DISTINCT e.norm, f.norm AS form FROM pack_form f JOIN pack_entry e ON e.id = f.entry_id WHERE NOT contains(f.norm, ' ') AND NOT regexp_matches(f.norm, '[0-9]') AND f.norm <> e.norm)
SELECT norm, entry_id FROM pack_trans UNION SELECT p.form, t.entry_id FROM pack_trans t JOIN pair p ON p.norm = t.norm""",
    "top10_corpus": f"SELECT word, count(*) AS n FROM (SELECT unnest(string_split({X.norm_sql('text')}, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 100",
    "pay3_word_lines": f"{_WITH} SELECT id, nullif(regexp_extract(body, '(?m)^P\\t(.+)$', 1), '') AS pos, CAST(NULL AS VARCHAR) AS pronunciation, 0 AS n_translations, 0 AS n_forms FROM pack_staging",
    "pay5_references": f"{_WITH} SELECT id, trim(regexp_replace(headword, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS term, {X.sense_code_sql('uid', 'regexp_extract(body, ' + chr(39) + '(?m)^S' + chr(92) + 't(.+)$' + chr(39) + ', 1)')} AS sense FROM pack_staging",
    "dat1_versions": "SELECT data_version, CAST(strptime(CAST(data_version // 10000 AS VARCHAR), '%Y%m%d') AS DATE) AS day, CAST(strftime(max(loaded_at), '%Y%m%d%H%M') AS BIGINT) AS stamp FROM entry_snapshot GROUP BY data_version",
}
