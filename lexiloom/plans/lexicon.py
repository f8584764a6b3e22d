"""Queries of the pack builder: keys, identities, ranks, caps, sentences, source merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import text as X
from lexiloom.operators import lexicon as L
from lexiloom.operators import rank as R
from lexiloom.plans import pack
from lexiloom.session import table

PARTICIPLE = "(ado|ido|ed|ing|ant|ando|endo)$"
TRANS_CAP = 50


def str1_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index key of every headword and document."""
    heads = pack.entry(spark, sf_dir).select(F.lit("entry").alias("origin"), "id", F.col("headword").alias("t"))
    docs = table(spark, sf_dir, "documents").select(F.lit("documents"), "doc_id", "text")
    return heads.union(docs).select("origin", "id", X.norm(F.col("t")).alias("key"))


def str2_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typo-tolerant key of every headword, by the profile of its language."""
    return pack.entry(spark, sf_dir).select("id", "lang", X.fuzzy(X.norm(F.col("headword")), F.col("lang")).alias("fuzzy_key"))


def str4_fold_gloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glosses as two sources would agree on them."""
    glosses = F.regexp_extract_all("body", F.lit("(?m)^S\\t(.*)$"), 1)
    rows = pack.staging(spark, sf_dir).select("id", F.explode(glosses).alias("gloss"))
    return rows.select("id", X.fold_gloss(F.col("gloss")).alias("folded")).distinct()


def str6_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of each key to its misspelling; an exchange of neighbours is one edit."""
    rows = pack.typo_queries(spark, sf_dir).join(pack.entry(spark, sf_dir).select(F.col("id").alias("query_id"), "norm"), "query_id")
    return rows.select("query_id", X.osa_distance_udf("q", "norm").alias("distance"))


def str7_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one line each."""
    return table(spark, sf_dir, "documents").select("doc_id", X.sanitize(F.col("text")).alias("line"))


def str15_translation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of translations: the phrase and each of its words."""
    return pack.trans(spark, sf_dir).select("entry_id", F.explode(L.translation_keys(X.norm(F.col("norm")))).alias("key")).distinct()


def str16_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of sentences by the corpus rule: runs of letters, as written."""
    return pack.sentences(spark, sf_dir).select("frase_id", F.size(F.regexp_extract_all("texto", F.lit("(\\p{L}+)"), 1)).alias("n_words"))


def str19_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms that are a variant of their headword: one begins with the other, at least four letters, at most three more."""
    rows = pack.form(spark, sf_dir).withColumnRenamed("norm", "form_norm").join(pack.entry(spark, sf_dir).select("id", "norm"), F.col("entry_id") == F.col("id"))
    short, long = F.least(F.length("norm"), F.length("form_norm")), F.greatest(F.length("norm"), F.length("form_norm"))
    begins = F.col("form_norm").startswith(F.col("norm")) | F.col("norm").startswith(F.col("form_norm"))
    return rows.filter(begins & (short >= 4) & (long - short <= 3)).select("entry_id", "form_norm", "norm")


def hsh1_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logical id of every entry, recomputed."""
    return pack.entry(spark, sf_dir).select("id", X.stable_uid(F.col("lang"), F.col("headword"), F.col("pos"), F.lit("")).alias("uid"))


def hsh2_sense_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every first sense."""
    gloss = F.regexp_extract("body", "(?m)^S\\t(.+)$", 1)
    return pack.staging(spark, sf_dir).select("id", X.sense_code(F.col("uid"), gloss).alias("code"))


def agg2_uid_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recomputed ids that several entries share, with their headwords."""
    rows = pack.entry(spark, sf_dir).withColumn("new_uid", X.stable_uid(F.col("lang"), F.col("headword"), F.col("pos"), F.lit("")))
    return L.colliding(rows, "new_uid", F.col("headword"))


def agg6_homographs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that share headword and part of speech, with the key that parts them."""
    rows = L.homographs(pack.entry(spark, sf_dir).select("id", "headword", "pos"), "headword", "pos")
    return rows.select("id", "n_homographs", "sense_key")


def agg8_zipf_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency of every word of the documents, on the Zipf scale and as a rank."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(X.norm(F.col("text")), " ")).alias("word")).filter("word <> ''")
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t")).collect()[0].t or 1  # one number
    scaled = counts.withColumn("zipf", F.round(R.zipf(F.col("n"), F.lit(float(total))), 9))
    return scaled.select("word", "n", "zipf", R.frequency_rank(F.col("zipf")).alias("rank"))


def mth2_richness_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank by richness: three for a sense, one for an example, one for each form up to eighty."""
    forms = pack.form(spark, sf_dir).groupBy("entry_id").agg(F.count("*").alias("n_forms"))
    rows = pack.staging(spark, sf_dir).join(forms, F.col("id") == F.col("entry_id"), "left")
    count = lambda tag: F.regexp_count("body", F.lit(f"(?m)^{tag}\\t."))
    score = count("S") * 12 + count("E") * 3 + F.least(F.coalesce("n_forms", F.lit(0)), F.lit(80))
    return rows.select("id", score.cast("int").alias("score"), R.richness_rank(score, F.lower("pos") == "name").alias("rank"))


def win1_trans_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most fifty entries for a translation key, by rank."""
    pairs = table(spark, sf_dir, "staging_trans").filter("norm IS NOT NULL").select("norm", "entry_id").distinct()
    ranked = pairs.join(pack.staging(spark, sf_dir).select("id", "rank"), F.col("entry_id") == F.col("id"))
    return L.capped(ranked, "norm", "rank", "entry_id", TRANS_CAP).select("norm", "entry_id", "place")


def agg15_richest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry with the longest body of each headword and tier."""
    rows = pack.staging(spark, sf_dir).filter("discover IS NOT NULL")
    return L.richest(rows, ["headword", "discover"], F.length("body"))


def join7_kept_participle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that look like participles and are forms of a verb."""
    return L.kept_participles(pack.entry(spark, sf_dir), pack.form(spark, sf_dir), PARTICIPLE)


def join8_unique_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that belong to one entry only."""
    return L.unique_reach(pack.sentences(spark, sf_dir), pack.entry(spark, sf_dir), pack.form(spark, sf_dir))


def join9_trans_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of each rank band, of the pairs whose entry is being built."""
    pairs = table(spark, sf_dir, "staging_trans").filter("norm IS NOT NULL").select("norm", "entry_id").distinct()
    rows = pairs.join(pack.staging(spark, sf_dir).select("id", "rank"), F.col("entry_id") == F.col("id"))
    return rows.groupBy((F.floor(F.col("rank") / 500)).cast("int").alias("band")).agg(F.count("*").alias("n_pairs"))


def join10_merge_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd ids as the first source, even ids as the second."""
    rows = pack.entry(spark, sf_dir).select("id", "headword", "pos")
    return L.merged_source(rows.filter("id % 2 = 1"), rows.filter("id % 2 = 0"), "id")


def join20_reverse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each translation key its eight best headwords."""
    rows = pack.trans(spark, sf_dir).withColumnRenamed("norm", "key").join(pack.entry(spark, sf_dir), F.col("entry_id") == F.col("id"))
    return L.reverse_index(rows, "key", ["rank", "headword", "pos"]).select("key", F.array_join("equivalents", "|").alias("equivalents"))


def join13_uid_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the live pack and of the pack being built, joined by logical id."""
    live = pack.entry(spark, sf_dir).select("uid", F.col("rank").alias("rank_live"))
    built = pack.staging(spark, sf_dir).select("uid", F.col("rank").alias("rank_built"))
    return live.join(built, "uid").select("uid", "rank_live", "rank_built").distinct()


def agg12_sentence_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many sentences each key occurs."""
    words = F.array_distinct(F.filter(F.split(X.norm(F.col("texto")), " "), lambda w: w != ""))
    return pack.sentences(spark, sf_dir).select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n_sentences"))


def agg13_lower_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by the share of their occurrences in lower case, those that are mostly so (a half at least)."""
    words = pack.sentences(spark, sf_dir).select(F.explode(F.regexp_extract_all("texto", F.lit("(\\p{L}+)"), 1)).alias("w"))
    share = F.avg(F.when(F.col("w") == F.lower("w"), 1.0).otherwise(0.0))
    return words.groupBy(F.lower("w").alias("word")).agg(F.round(share, 9).alias("lower_share")).filter("lower_share >= 0.5")


def agg14_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest sentence kept for each word, by length, then text."""
    rows = pack.sentences(spark, sf_dir).filter("norm IS NOT NULL")
    return rows.groupBy("norm").agg(F.min(F.struct(F.length("texto").alias("n"), "texto")).alias("_m")).select("norm", F.col("_m.texto").alias("texto"))


def flt6_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose headword's hash is divisible by 16."""
    word = F.conv(F.substring(F.sha2("headword", 256), 1, 8), 16, 10).cast("bigint")
    return pack.entry(spark, sf_dir).filter(word % 16 == 0).select("id", "headword")


def flt7_stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh id, as the payload check samples."""
    return pack.entry(spark, sf_dir).filter("(id - 1) % 7 = 0").select("id")


def flt8_short_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headwords of at most three words."""
    return pack.entry(spark, sf_dir).filter(F.size(F.split(F.trim("headword"), "\\s+")) <= 3).select("id", "headword")


def flt14_drop_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why rows of the raw entry table don't reach the pack, counted."""
    reason = (
        F.when(F.col("removed_at").isNotNull(), "removed")
        .when(F.size(F.split(F.trim("headword"), "\\s+")) > 3, "too many words")
        .when(F.col("pos").isNull(), "no part of speech")
        .otherwise("kept")
    )
    return table(spark, sf_dir, "entry").groupBy(reason.alias("reason")).agg(F.count("*").alias("n_rows"))


_GLOSS = "regexp_extract(body, '(?m)^S\\t(.+)$', 1)"
_COUNT = "len(regexp_extract_all(body, '(?m)^{}\\t.'))"
_WITH = f"WITH {pack.SQL}"
_PAIR = "pair AS (SELECT DISTINCT norm, entry_id FROM staging_trans WHERE norm IS NOT NULL)"

QUERIES = {
    f.__name__: f
    for f in (str1_norm, str2_fuzzy, str4_fold_gloss, str6_edit_distance, str7_sanitize, str15_translation_keys, str16_words, str19_variant, hsh1_uid, hsh2_sense_code, agg2_uid_collisions, agg6_homographs, agg8_zipf_rank, mth2_richness_rank, win1_trans_cap, agg15_richest, join7_kept_participle, join8_unique_sentence, join9_trans_rank, join10_merge_source, join13_uid_packs, join20_reverse_index, agg12_sentence_freq, agg13_lower_ratio, agg14_shortest, flt6_hash_sample, flt7_stride_sample, flt8_short_lemmas, flt14_drop_ledger)
}

ORACLES = {
    "str1_norm": f"{_WITH} SELECT 'entry' AS origin, id, {X.norm_sql('headword')} AS key FROM pack_entry UNION ALL SELECT 'documents', doc_id, {X.norm_sql('text')} FROM documents",
    "str2_fuzzy": f"{_WITH}, keyed AS (SELECT id, lang, {X.norm_sql('headword')} AS k FROM pack_entry) SELECT id, lang, {X.fuzzy_sql('k', 'lang')} AS fuzzy_key FROM keyed",
    "str4_fold_gloss": f"{_WITH}, line AS (SELECT id, unnest(string_split(body, chr(10))) AS l FROM pack_staging) SELECT DISTINCT id, {X.fold_gloss_sql('substr(l, 3)')} AS folded FROM line WHERE starts_with(l, concat('S', chr(9)))",
    "str7_sanitize": "SELECT doc_id, nullif(trim(regexp_replace(replace(text, chr(31), ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), '') AS line FROM documents",
    "str15_translation_keys": f"{_WITH}, keyed AS (SELECT entry_id, {X.norm_sql('norm')} AS k FROM pack_trans) SELECT DISTINCT entry_id, key FROM (SELECT entry_id, k AS key FROM keyed UNION ALL SELECT entry_id, unnest(string_split(k, ' ')) FROM keyed) WHERE key <> ''",
    "str16_words": f"{_WITH} SELECT frase_id, CAST(len(regexp_extract_all(texto, '\\p{{L}}+')) AS INT) AS n_words FROM sentence",
    "str19_variant": f"""{_WITH} SELECT f.entry_id, f.norm AS form_norm, e.norm FROM pack_form f JOIN pack_entry e ON e.id = f.entry_id
WHERE (starts_with(f.norm, e.norm) OR starts_with(e.norm, f.norm)) AND least(length(f.norm), length(e.norm)) >= 4 AND abs(length(f.norm) - length(e.norm)) <= 3""",
    "hsh1_uid": f"{_WITH} SELECT id, {X.stable_uid_sql('lang', 'headword', 'pos', chr(39) * 2)} AS uid FROM pack_entry",
    "hsh2_sense_code": f"{_WITH} SELECT id, {X.sense_code_sql('uid', _GLOSS)} AS code FROM pack_staging",
    "agg2_uid_collisions": f"""{_WITH}, keyed AS (SELECT {X.stable_uid_sql('lang', 'headword', 'pos', chr(39) * 2)} AS new_uid, headword FROM pack_entry)
SELECT new_uid, count(*) AS n, array_to_string(list_sort(list(DISTINCT headword))[1:5], ', ') AS examples FROM keyed GROUP BY new_uid HAVING count(*) > 1""",
    "agg6_homographs": f"""{_WITH} SELECT id, count(*) OVER (PARTITION BY headword, pos) AS n_homographs,
CASE WHEN count(*) OVER (PARTITION BY headword, pos) > 1 THEN CAST(row_number() OVER (PARTITION BY headword, pos ORDER BY id) - 1 AS VARCHAR) ELSE '' END AS sense_key FROM pack_entry""",
    "agg8_zipf_rank": f"""WITH word AS (SELECT unnest(string_split({X.norm_sql('text')}, ' ')) AS word FROM documents),
counted AS (SELECT word, count(*) AS n FROM word WHERE word <> '' GROUP BY word),
scaled AS (SELECT word, n, round(log10(n / CAST((SELECT sum(n) FROM counted) AS DOUBLE) * 1e9), 9) AS zipf FROM counted)
SELECT word, n, zipf, CAST(greatest(0, 499 - CAST(round_even(zipf * 70, 0) AS INT)) AS INT) AS rank FROM scaled""",
    "mth2_richness_rank": f"""{_WITH}, forms AS (SELECT entry_id, count(*) AS n FROM pack_form GROUP BY entry_id),
scored AS (SELECT id, pos, CAST({_COUNT.format('S')} * 12 + {_COUNT.format('E')} * 3 + least(coalesce(n, 0), 80) AS INT) AS score FROM pack_staging LEFT JOIN forms ON id = entry_id)
SELECT id, score, CAST(500 + greatest(0, 1000 - score) // 2 + CASE WHEN lower(pos) = 'name' THEN 1000 ELSE 0 END AS INT) AS rank FROM scored""",
    "win1_trans_cap": f"""{_WITH}, {_PAIR} SELECT norm, entry_id, CAST(place AS INT) AS place FROM (
  SELECT p.norm, entry_id, row_number() OVER (PARTITION BY p.norm ORDER BY rank, entry_id) AS place FROM pair p JOIN pack_staging s ON s.id = entry_id) WHERE place <= {TRANS_CAP}""",
    "agg15_richest": f"{_WITH} SELECT headword, discover, id FROM (SELECT *, row_number() OVER (PARTITION BY headword, discover ORDER BY length(body) DESC, id) AS r FROM pack_staging WHERE discover IS NOT NULL) WHERE r = 1",
    "join7_kept_participle": f"""{_WITH} SELECT id FROM pack_entry e WHERE regexp_matches(norm, '{PARTICIPLE}') AND EXISTS (
  SELECT 1 FROM pack_form f JOIN pack_entry v ON v.id = f.entry_id WHERE f.norm = e.norm AND v.id <> e.id AND (starts_with(lower(v.pos), 'verb') OR starts_with(lower(v.pos), 'глаг')))""",
    "join8_unique_sentence": f"""{_WITH}, reach AS (SELECT norm, id FROM pack_entry UNION ALL SELECT norm, entry_id FROM pack_form),
single AS (SELECT norm, min(id) AS entry_id FROM reach WHERE norm IS NOT NULL GROUP BY norm HAVING count(DISTINCT id) = 1)
SELECT frase_id, entry_id FROM sentence JOIN single USING (norm)""",
    "join9_trans_rank": f"{_WITH}, {_PAIR} SELECT CAST(rank // 500 AS INT) AS band, count(*) AS n_pairs FROM pair JOIN pack_staging s ON s.id = entry_id GROUP BY ALL",
    "join10_merge_source": f"""{_WITH} SELECT id, headword, pos FROM pack_entry WHERE id % 2 = 1 UNION ALL
SELECT id, headword, pos FROM (SELECT *, row_number() OVER (PARTITION BY headword, pos ORDER BY id) AS n FROM pack_entry b WHERE id % 2 = 0 AND NOT EXISTS (
  SELECT 1 FROM pack_entry a WHERE a.id % 2 = 1 AND a.headword IS NOT DISTINCT FROM b.headword AND a.pos IS NOT DISTINCT FROM b.pos)) WHERE n = 1""",
    "join13_uid_packs": f"{_WITH} SELECT DISTINCT uid, a.rank AS rank_live, b.rank AS rank_built FROM pack_entry a JOIN pack_staging b USING (uid)",
    "join20_reverse_index": f"""{_WITH}, member AS (SELECT DISTINCT t.norm AS key, rank, headword, pos FROM pack_trans t JOIN pack_entry e ON e.id = t.entry_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank, headword, pos NULLS FIRST) AS n FROM member)
SELECT key, string_agg(headword, '|' ORDER BY n) AS equivalents FROM placed WHERE n <= 8 GROUP BY key""",
    "agg12_sentence_freq": f"{_WITH} SELECT word, count(*) AS n_sentences FROM (SELECT DISTINCT frase_id, unnest(string_split({X.norm_sql('texto')}, ' ')) AS word FROM sentence) WHERE word <> '' GROUP BY word",
    "agg13_lower_ratio": f"""{_WITH}, word AS (SELECT unnest(regexp_extract_all(texto, '\\p{{L}}+')) AS w FROM sentence)
SELECT lower(w) AS word, round(avg(CASE WHEN w = lower(w) THEN 1.0 ELSE 0.0 END), 9) AS lower_share FROM word GROUP BY lower(w) HAVING avg(CASE WHEN w = lower(w) THEN 1.0 ELSE 0.0 END) >= 0.5""",
    "agg14_shortest": f"{_WITH} SELECT norm, texto FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY length(texto), texto) AS n FROM sentence WHERE norm IS NOT NULL) WHERE n = 1",
    "flt6_hash_sample": f"{_WITH} SELECT id, headword FROM pack_entry WHERE concat('0x', substr(sha256(headword), 1, 8))::UBIGINT % 16 = 0",
    "flt7_stride_sample": f"{_WITH} SELECT id FROM pack_entry WHERE (id - 1) % 7 = 0",
    "flt8_short_lemmas": f"{_WITH} SELECT id, headword FROM pack_entry WHERE len(regexp_split_to_array(trim(headword), '\\s+')) <= 3",
    "flt14_drop_ledger": """SELECT CASE WHEN removed_at IS NOT NULL THEN 'removed' WHEN len(regexp_split_to_array(trim(headword), '\\s+')) > 3 THEN 'too many words' WHEN pos IS NULL THEN 'no part of speech' ELSE 'kept' END AS reason, count(*) AS n_rows FROM entry GROUP BY ALL""",
}
