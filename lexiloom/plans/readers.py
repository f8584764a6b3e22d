"""Readers of source formats: whole test tables written out in a format and read back, and a few short files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import records as R
from lexiloom.functions import text as X
from lexiloom.session import ensure_checkpoint_dir, table
from lexiloom.sources import dumps

_ONE_LINE = "[\\r\\n]"


def _written(spark: SparkSession, lines: DataFrame, name: str) -> str:
    """The path of a new text file set with one line a row."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    lines.write.text(path)
    return path


def _lines(spark: SparkSession, text: str, name: str) -> str:
    return _written(spark, spark.createDataFrame([(text,)], "value string").coalesce(1), name)


def src4_wikidata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexemes served one a line: each Spanish headword and part of speech of the entries is one."""
    rows = table(spark, sf_dir, "entry").filter("lang = 'es'").groupBy("headword", "pos").agg(F.min("uid").alias("uid"))
    said = lambda v: F.create_map(F.lit("es"), F.struct(F.lit("es").alias("language"), v.alias("value")))
    lexeme = F.struct(
        F.concat(F.lit("L"), "uid").alias("id"), F.lit("Q1321").alias("language"), F.lit("Q1084").alias("lexicalCategory"), said(F.col("headword")).alias("lemmas"),
        F.array(F.struct(F.lit("s").alias("id"), said(F.col("headword")).alias("glosses"))).alias("senses"),
    )
    path = _written(spark, rows.select(F.concat(F.to_json(lexeme), F.lit(",")).alias("value")), "lexemes")
    return dumps.wikidata_lexemes(spark, path).select("headword", "pos", "rank", "sense_key", F.size("glosses").alias("n_glosses"), F.size("forms").alias("n_forms"))


def _tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "staging_trans").filter(F.col("norm").isNotNull() & F.col("entry_id").isNotNull() & ~F.col("norm").rlike("[\\r\\n\\t]"))
    return dumps.omw_tab(spark, _written(spark, rows.select(F.concat("entry_id", F.lit("-n\tspa:lemma\t"), "norm").alias("value")), "tab"))


def src7_omw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wordnet's tab file: the translation keys as lemmas, their entries as synsets."""
    return _tab(spark, sf_dir)


def src6_thesaurus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synonyms of the lemmas of exactly one synset."""
    return dumps.thesaurus(_tab(spark, sf_dir).distinct()).select("lemma", F.array_join("synonyms", "|").alias("synonyms"))


def src8_tatoeba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spanish sentences of 10 to 60 characters of a sentence file."""
    rows = table(spark, sf_dir, "frase").filter(F.col("texto").isNotNull() & ~F.col("texto").rlike(_ONE_LINE))
    path = _written(spark, rows.select(F.concat_ws("\t", F.col("frase_id").cast("string"), "lang", "texto").alias("value")), "sentences")
    return dumps.tatoeba(spark, path, lang="es", shortest=10, longest=60)


def _headwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "staging").filter(F.col("headword").isNotNull() & ~F.col("headword").rlike(_ONE_LINE))


def src9_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of words and counts; headwords of several words are lines of another shape."""
    return dumps.frequency_list(spark, _written(spark, _headwords(spark, sf_dir).select(F.concat("headword", F.lit(" "), "rank").alias("value")), "frequencies"))


def src10_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of how many know a word; every seventh share is unreadable."""
    share = F.when(F.col("rank") % 7 == 0, F.lit("?")).otherwise((F.col("rank") / 8).cast("string"))
    path = f"{ensure_checkpoint_dir(spark)}/prevalence-{uuid.uuid4().hex}"
    table(spark, sf_dir, "staging").filter(F.col("norm").rlike("^[a-z]+$")).select(F.col("norm").alias("spelling"), F.col("rank").alias("count_total"), share.alias("percent_total")).write.option("header", True).csv(path)
    return dumps.prevalence(spark, path)


def src15_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key-value rows of each pack as one map, here the nations of a region."""
    meta = dumps.manifest(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("pack_id"), F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value")))
    return meta.select("pack_id", F.explode("meta").alias("key", "value"))


def src16_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue in which some packs lack address or digest and some a name."""
    key = F.col("s_suppkey")
    pack = F.struct(
        F.concat(F.lit("pack-"), key).alias("pack_id"), F.when(key % 3 != 0, F.col("s_name")).alias("name"), F.when(key % 5 != 0, F.lit("u")).alias("url"),
        F.when(key % 7 == 0, F.lit("")).otherwise(F.lit("s")).alias("sha256"), F.when(key % 2 == 0, key).alias("entry_count"),
    )
    document = table(spark, sf_dir, "supplier").agg(F.to_json(F.struct(F.lit(1).alias("catalog_version"), F.collect_list(pack).alias("packs"))).alias("value"))
    return dumps.catalog(spark, _written(spark, document, "catalog")).select("pack_id", "name", "entry_count", F.size("langs").alias("n_langs"))


def src17_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a pack must hold, some of them in the full one only."""
    return dumps.required_words(spark, _lines(spark, "# nota\nuno\n#! solo el pack completo\ndos\ntres\n\ncuatro\n# otra\n\n#! solo el pack completo\ncinco", "required"))


def src21_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different keys of a list of words."""
    return dumps.vocabulary(table(spark, sf_dir, "staging"), "headword")


def agg9_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of counts as one; the first one's stands."""
    counts = lambda name: table(spark, sf_dir, name).filter("norm IS NOT NULL").groupBy(F.col("norm").alias("word")).agg(F.count("*").alias("n"))
    return dumps.combined_frequencies(counts("form"), counts("trans"))


def win5_word_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of the stretch of equal neighbours, here of customers by their segment."""
    return dumps.word_groups(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment")


CITED = (
    ("J. R. R. Tolkien. El Señor de los Anillos. Página 3. 1954.", "es", "J. R. R. Tolkien. El Señor de los Anillos"),
    ("1897, Richard Marsh, The Beetle:", "en", "1897, Richard Marsh"), ("1901, “Of Men, and Mice”, X, Y", "en", "1901, “Of Men, and Mice”"),
    ("“Sin cerrar. Autor. Obra", "es", "Sin cerrar. Autor"), ("solo:", "en", "solo"),
)
GLOSSED = (
    ("to run, to jog", "to run|run|to jog|jog"), ("house (building); home", "house|home"), ("a kind of house", ""), ("of, from the house", ""),
    ("one, very long phrase here, etc.", ""), ("indicates possession", ""), ("native or inhabitant of Chile", ""),
)


def str11_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two fields of a source that are shown."""
    return spark.createDataFrame([c[:2] for c in CITED], "ref string, lang string").select("ref", R.citation(F.col("ref"), F.col("lang")).alias("citation"))


def str14_gloss_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of a gloss in another language."""
    return spark.createDataFrame([(g,) for g, _ in GLOSSED], "gloss string").select("gloss", F.array_join(R.gloss_terms(F.col("gloss")), "|").alias("terms"))


QUERIES = {
    f.__name__: f
    for f in (src4_wikidata, src6_thesaurus, src7_omw, src8_tatoeba, src9_frequencies, src10_prevalence, src15_manifest, src16_catalog, src17_required, src21_vocabulary, agg9_combined, win5_word_groups, str11_citation, str14_gloss_terms)
}


def _values(rows: tuple, *names: str) -> str:
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) t({', '.join(names)})"


_TAB = "tab AS (SELECT DISTINCT trim(norm) AS lemma, concat(entry_id, '-n') AS synset FROM staging_trans WHERE norm IS NOT NULL AND entry_id IS NOT NULL AND NOT regexp_matches(norm, '[\\r\\n\\t]') AND trim(norm) <> '')"

ORACLES = {
    "src4_wikidata": f"""WITH k AS (SELECT trim(headword) AS headword, concat('L', uid) AS id FROM (SELECT headword, pos, min(uid) AS uid FROM entry WHERE lang = 'es' GROUP BY ALL)
  WHERE trim(coalesce(headword, '')) <> '' AND len(string_split_regex(trim(headword), '\\s+')) <= {dumps.MAX_WORDS_IN_LEMMA})
SELECT headword, 'noun' AS pos, CAST(997 AS INTEGER) AS rank, CASE WHEN count(*) OVER (PARTITION BY headword) > 1 THEN id END AS sense_key, CAST(1 AS INTEGER) AS n_glosses, CAST(0 AS INTEGER) AS n_forms FROM k""",
    "src6_thesaurus": f"""WITH {_TAB}, one AS (SELECT lemma, min(synset) AS synset FROM tab GROUP BY lemma HAVING count(DISTINCT synset) = 1),
keyed AS (SELECT lemma, {X.norm_sql('lemma')} AS k FROM (SELECT DISTINCT lemma FROM tab)),
pair AS (SELECT DISTINCT o.lemma, t.lemma AS other, a.k AS a, b.k AS b FROM one o JOIN tab t ON t.synset = o.synset AND t.lemma <> o.lemma JOIN keyed a ON a.lemma = o.lemma JOIN keyed b ON b.lemma = t.lemma),
kept AS (SELECT *, row_number() OVER (PARTITION BY lemma ORDER BY other) AS n FROM pair WHERE a <> b AND NOT (least(length(a), length(b)) >= 4 AND abs(length(a) - length(b)) <= 3
  AND CASE WHEN length(a) <= length(b) THEN starts_with(b, a) ELSE starts_with(a, b) END))
SELECT lemma, string_agg(other, '|' ORDER BY other) AS synonyms FROM kept WHERE n <= 4 GROUP BY lemma""",
    "src7_omw": "SELECT trim(norm) AS lemma, 'noun' AS pos, concat(entry_id, '-n') AS synset FROM staging_trans WHERE norm IS NOT NULL AND entry_id IS NOT NULL AND NOT regexp_matches(norm, '[\\r\\n\\t]') AND trim(norm) <> ''",
    "src8_tatoeba": "SELECT frase_id, lang, trim(texto) AS texto FROM frase WHERE frase_id IS NOT NULL AND lang = 'es' AND NOT regexp_matches(texto, '[\\r\\n]') AND length(trim(texto)) BETWEEN 10 AND 60",
    "src9_frequencies": """WITH f AS (SELECT string_split_regex(trim(concat(headword, ' ', rank)), '\\s+') AS f FROM staging WHERE headword IS NOT NULL AND rank IS NOT NULL AND NOT regexp_matches(headword, '[\\r\\n]'))
SELECT lower(f[1]) AS word, CAST(sum(CAST(f[2] AS BIGINT)) AS BIGINT) AS n FROM f WHERE len(f) = 2 GROUP BY ALL""",
    "src10_prevalence": "SELECT norm AS word, max(rank / 8) AS known FROM staging WHERE regexp_matches(norm, '^[a-z]+$') AND rank % 7 <> 0 GROUP BY norm",
    "src15_manifest": "SELECT n_regionkey AS pack_id, n_name AS key, CAST(n_nationkey AS VARCHAR) AS value FROM nation",
    "src16_catalog": """SELECT concat('pack-', s_suppkey) AS pack_id, CASE WHEN s_suppkey % 3 <> 0 THEN s_name ELSE concat('pack-', s_suppkey) END AS name,
  CAST(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE 0 END AS BIGINT) AS entry_count, CAST(0 AS INTEGER) AS n_langs FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0""",
    "src21_vocabulary": f"SELECT DISTINCT {X.norm_sql('headword')} AS norm FROM staging WHERE {X.norm_sql('headword')} <> ''",
    "src17_required": "SELECT * FROM (VALUES ('uno', true), ('dos', false), ('tres', false), ('cuatro', true), ('cinco', false)) t(word, every_tier)",
    "agg9_combined": """WITH a AS (SELECT norm AS word, count(*) AS n FROM form WHERE norm IS NOT NULL GROUP BY norm), b AS (SELECT norm AS word, count(*) AS n FROM trans WHERE norm IS NOT NULL GROUP BY norm)
SELECT coalesce(a.word, b.word) AS word, coalesce(a.n, b.n) AS n FROM a FULL OUTER JOIN b ON a.word = b.word""",
    "win5_word_groups": """SELECT c_custkey, c_mktsegment, CAST(sum(new) OVER (ORDER BY c_custkey) AS BIGINT) AS word_group FROM (
  SELECT c_custkey, c_mktsegment, CASE WHEN lag(c_mktsegment) OVER (ORDER BY c_custkey) = c_mktsegment THEN 0 ELSE 1 END AS new FROM customer)""",
    "str11_citation": _values(tuple((ref, cited) for ref, _, cited in CITED), "ref", "citation"),
    "str14_gloss_terms": _values(GLOSSED, "gloss", "terms"),
}
