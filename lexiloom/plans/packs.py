"""Queries over payloads, tiers, pools, pack choice, visits and the quality of a pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as X
from lexiloom.operators import discover as D
from lexiloom.operators import packs as P
from lexiloom.operators import payload as B
from lexiloom.operators import quality, tiers
from lexiloom.plans import pack
from lexiloom.plans.lexicon import PARTICIPLE
from lexiloom.session import durable, table

BUDGET = 20_000.0
BOUNDARY = 500
DAYS = [f"2026-01-{d:02d}" for d in range(1, 8)]


# Payloads


def pay1_render_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies parsed and rendered again: does the text of the senses come out as it was?"""
    rows = pack.staging(spark, sf_dir)
    rendered = B.render_senses(B.parse_senses(rows)).withColumnRenamed("body", "_r")
    senses = F.array_join(F.filter(F.split("body", "\n"), lambda x: x.rlike("^[SE]\t.") | x.rlike("^Y\t.")), "\n")
    joined = rows.join(rendered, "id", "left")
    return joined.select("id", (F.concat(senses, F.lit("\n")) == F.coalesce("_r", F.lit("\n"))).alias("same"))


def pay2_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each body by tag, and how many senses they belong to."""
    lines = B.body_lines(pack.staging(spark, sf_dir))
    return lines.groupBy("id", "tag").agg(F.count("*").alias("n_lines"), F.count_distinct("sense").alias("n_senses"))


def pay2_inflate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of the raw entry table decoded and packed again: lines, and whether the text survives."""
    rows = table(spark, sf_dir, "entry").select("id", "loaded_at", B.inflate(F.col("payload")).alias("body"))
    back = rows.withColumn("_again", B.inflate(B.deflate(F.col("body"))))
    return back.select("id", F.size(F.filter(F.split("body", "\n"), lambda x: x != "")).alias("n_lines"), (F.col("body") == F.col("_again")).alias("same")).distinct()


def pay4_merge_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Senses of an entry after those with one folded gloss became one."""
    merged = B.merge_duplicate_senses(B.parse_senses(pack.staging(spark, sf_dir)))
    return merged.groupBy("id").agg(F.count("*").alias("n_senses"), F.sum(F.size("examples")).cast("bigint").alias("n_examples"), F.sum(F.size("synonyms")).cast("bigint").alias("n_synonyms"))


def pay6_fts_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text a definition search reads."""
    return B.search_text(B.parse_senses(pack.staging(spark, sf_dir)))


def flt19_admits_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries under which a corpus sentence may stand."""
    return pack.staging(spark, sf_dir).filter(B.admits_sentence(F.col("body"))).select("id")


def thesaurus(single: DataFrame, every: DataFrame, keys: DataFrame, form: DataFrame, most: int = 4, salts: int = 32) -> DataFrame:
    """``(id, term, place)``: for each entry of ``single`` the first ``most`` other terms of its keys by rank, none its own form.

    Keys of any size count whole, without their pairs being made: of a key an entry needs only the first ``most`` terms
    and one more for each of the key's terms that it may not take, so it looks up that many places and no others.
    """
    held = keys.join(every.select(F.col("id").alias("entry_id"), F.col("norm").alias("term"), "rank"), "entry_id").filter("key IS NOT NULL AND term <> ''")
    terms = durable(held.groupBy("key", "term").agg(F.min("rank").alias("_rank")))
    mine = keys.join(single.select(F.col("id").alias("entry_id"), "norm"), "entry_id").filter("key IS NOT NULL AND norm IS NOT NULL").select("key", F.col("entry_id").alias("id"), "norm").distinct()
    forms = form.select(F.col("entry_id").alias("id"), F.col("norm").alias("term"))
    barred = forms.join(single.select("id"), "id", "left_semi").unionByName(single.select("id", F.col("norm").alias("term"))).distinct()
    hit = mine.select("key", "id").join(barred, "id").join(terms.select("key", "term"), ["key", "term"]).groupBy("key", "id").agg(F.count("*").alias("_n"))
    wanted = durable(mine.select("key", "id").join(hit, ["key", "id"], "left").select("key", "id", (F.lit(most) + F.coalesce("_n", F.lit(0))).cast("int").alias("_n")))
    # Places in two stages, so that a key of very many terms is ranked by several tasks.
    order = [F.col("_rank").asc_nulls_last(), F.col("term")]
    depth = terms.join(wanted.groupBy("key").agg(F.max("_n").alias("_n")), "key").withColumn("_salt", F.pmod(F.xxhash64("term"), F.lit(salts)))
    heads = depth.withColumn("_p", F.row_number().over(Window.partitionBy("key", "_salt").orderBy(*order))).filter("_p <= _n")
    places = heads.withColumn("_p", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter("_p <= _n").select("key", "_p", "term", "_rank")
    looked = wanted.select("key", "id", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_p")).join(places, ["key", "_p"])
    kept = looked.groupBy("id", "term").agg(F.min("_rank").alias("_rank")).join(barred, ["id", "term"], "left_anti")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(*order))).filter(F.col("place") <= most).select("id", "term", "place")


def pay7_thesaurus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synonyms to add to entries of one sense: the other entries of its translation keys, up to four, none its own form."""
    every = pack.staging(spark, sf_dir)
    single = every.filter(F.regexp_count("body", F.lit("(?m)^S\\t.")) == 1).select("id", "norm")
    return thesaurus(single, every, pack.trans(spark, sf_dir).withColumnRenamed("norm", "key"), pack.form(spark, sf_dir))


# Tiers


def _lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the pack with their cost, best rank, count in the sentences and, as share of speakers, a stated stand-in."""
    rows = pack.entry(spark, sf_dir, payload=True).groupBy("norm").agg(F.sum(F.octet_length("payload")).alias("cost"), F.min("rank").alias("best_rank"))
    known = F.when(F.col("best_rank") % 10 == 0, F.lit(90.0) - F.col("best_rank") / 100)
    return rows.join(_frequencies(spark, sf_dir), "norm", "left").withColumn("known", known)


def _frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.explode(F.filter(F.split(X.norm(F.col("texto")), " "), lambda w: w != ""))
    return pack.sentences(spark, sf_dir).select(words.alias("norm")).groupBy("norm").agg(F.count("*").alias("n"))


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = _frequencies(spark, sf_dir).agg(F.sum("n").alias("t")).collect()[0].t or 0  # one number
    ordered, order = tiers.entry_order(_lemmas(spark, sf_dir), float(total))
    return tiers.within_budget(ordered, order, F.col("cost"), BUDGET)


def win6_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lemmas that a budget of payload bytes lets in, with their place and the running total."""
    return _vocabulary(spark, sf_dir).select("norm", "band", "place", "running")


def top9_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lemmas by band of the order of entry."""
    total = _frequencies(spark, sf_dir).agg(F.sum("n").alias("t")).collect()[0].t or 0  # one number
    ordered, _ = tiers.entry_order(_lemmas(spark, sf_dir), float(total))
    return ordered.groupBy("band").agg(F.count("*").alias("n_lemmas"), F.sum("cost").alias("cost"))


def agg10_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the running and of the distinct words of the sentences the budgeted tier holds."""
    return tiers.coverage(_vocabulary(spark, sf_dir), _frequencies(spark, sf_dir))


def _tier(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    vocabulary = durable(_vocabulary(spark, sf_dir).select("norm"))
    return tiers.derive(vocabulary, pack.entry(spark, sf_dir), pack.form(spark, sf_dir), pack.trans(spark, sf_dir), _discover(spark, sf_dir))


def q24_derive_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of the tier with their new ids."""
    return _tier(spark, sf_dir)["entry"].select("id", "uid", "headword", "norm")


def q24_derive_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and translations of the tier, by new id."""
    made = _tier(spark, sf_dir)
    return made["form"].select(F.lit("form").alias("ref_table"), "norm", "entry_id").unionByName(made["trans"].select(F.lit("trans").alias("ref_table"), "norm", "entry_id"))


def agg22_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each tag in the pack and in its even half."""
    lines = B.body_lines(pack.staging(spark, sf_dir))
    return lines.groupBy("tag").agg(F.count("*").alias("n_all"), F.sum(F.when(F.col("id") % 2 == 0, 1).otherwise(0)).alias("n_half"))


def agg18_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of two to four words of the bodies that occur at least five times: material for a compression dictionary."""
    return tiers.word_ngrams(pack.staging(spark, sf_dir), "fts_body").filter("n >= 5")


def agg20_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the ranks of the live pack and of the one being built agree."""
    live = pack.entry(spark, sf_dir).groupBy("uid").agg(F.min("rank").alias("a"))
    built = pack.staging(spark, sf_dir).groupBy("uid").agg(F.max(F.length("body") + F.col("rank")).alias("b"))
    return tiers.spearman(live.join(built, "uid"), "a", "b")


def q30_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a control whose values are turned by half, and how many of the first 200 both share."""
    live = pack.entry(spark, sf_dir).groupBy("uid").agg(F.min("rank").alias("a"))
    built = pack.staging(spark, sf_dir).groupBy("uid").agg(F.max(F.length("body") + F.col("rank")).alias("b"))
    both = durable(live.join(built, "uid"))
    control = both.select("uid", "a").join(tiers.rotated(both, "uid", "b"), "uid")
    first = lambda c: both.orderBy(c, "uid").limit(200).select("uid")
    shared = first("a").join(first("b"), "uid").agg(F.count("*").alias("top_shared"))
    rows = tiers.spearman(both, "a", "b").select(F.lit("rho").alias("measure"), F.col("rho").alias("value"))
    rows = rows.unionByName(tiers.spearman(control, "a", "b").select(F.lit("control").alias("measure"), F.col("rho").alias("value")))
    return rows.unionByName(shared.select(F.lit("top_shared").alias("measure"), F.col("top_shared").cast("double").alias("value")))


# Pools


def _discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.discover_rows(pack.staging(spark, sf_dir), pack.form(spark, sf_dir), BOUNDARY, PARTICIPLE)


def q27_discover_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the pools."""
    return _discover(spark, sf_dir)


def q11_discover_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes of the pools."""
    return D.pools(_discover(spark, sf_dir))


def q15_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty rows of a tier, with the first ten of each pool seen already."""
    rows = durable(_discover(spark, sf_dir))
    return D.draw(rows, rows.filter("seq < 10"), tier=2, seed=20260101)


def q16_word_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word for each day of a week."""
    entry = pack.entry(spark, sf_dir)
    return D.words_of_days(spark, entry, DAYS, "es-core", entry.agg(F.max("id").alias("m")).collect()[0].m or 0)


def q17_tier_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word of a tier for each day of a week."""
    return D.tier_words(spark, durable(_discover(spark, sf_dir)), DAYS, "es-core", tier=1)


# Packs and visits, over the driver's other tables


def _packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as packs: a name for each two nations, a version, and for some a pack they are part of."""
    rows = table(spark, sf_dir, "supplier")
    pack_id = F.concat(F.lit("pack-"), (F.col("s_nationkey")).cast("string"))
    subset = F.when(F.col("s_nationkey") % 3 == 0, F.concat(F.lit("pack-"), (F.col("s_nationkey") + 1).cast("string")))
    return rows.select(pack_id.alias("pack_id"), F.col("s_suppkey").alias("data_version"), subset.alias("subset_of"))


def q22_pack_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packs a search asks."""
    return P.packs_to_query(_packs(spark, sf_dir))


def q23_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of packs against the installed ones."""
    catalog = table(spark, sf_dir, "nation").select(F.concat(F.lit("pack-"), F.col("n_nationkey").cast("string")).alias("pack_id"), (F.col("n_nationkey") * 4).cast("bigint").alias("data_version"), (4 - F.when(F.col("n_nationkey") % 7 == 0, 1).otherwise(0)).alias("schema_version"), F.lit(2).alias("norm_version"))
    return P.classified(catalog, _packs(spark, sf_dir).filter("data_version % 2 = 0"), quality.SCHEMA_VERSION, quality.NORM_VERSION)


def top12_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 25 different pages of each user."""
    views = table(spark, sf_dir, "events").filter("event_type = 'view'").withColumn("page", F.pmod(F.col("event_id"), F.lit(40)))
    return P.history(views, "user_id", "page", "ts", "event_id")


def top13_favorites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages marked an odd number of times."""
    clicks = table(spark, sf_dir, "events").filter("event_type = 'click'").withColumn("page", F.pmod(F.col("event_id"), F.lit(10)))
    return P.toggled(clicks, "user_id", "page", "ts")


def agg21_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the cascade by rung."""
    from lexiloom.plans.search import q1_suggest

    return q1_suggest(spark, sf_dir).groupBy("match_kind").agg(F.count("*").alias("n"))


def src18_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits written as text and read again."""
    rows = pack.entry(spark, sf_dir).select(F.lit("es-core").alias("pack_id"), F.col("id").alias("entry_id"), "headword", "pos", F.lit(None).cast("string").alias("gloss"), "lang", "uid")
    return P.parsed_visits(P.visit_lines(rows)).select("entry_id", "headword", "pos", "lang", "uid")


# Quality


def dq_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the pack that fail each check."""
    return quality.report(pack.entry(spark, sf_dir), pack.form(spark, sf_dir), pack.trans(spark, sf_dir), _discover(spark, sf_dir), pack.staging(spark, sf_dir))


def dq16_key_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled entries whose keys can't be recomputed."""
    return quality.key_sample(pack.entry(spark, sf_dir), 5)


def dq8_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required words (those of the sentences) that neither a headword nor a form reaches."""
    wanted = pack.sentences(spark, sf_dir).filter("norm IS NOT NULL").select(X.norm(F.col("norm")).alias("norm")).distinct()
    known = pack.entry(spark, sf_dir).select("norm").unionByName(pack.form(spark, sf_dir).select("norm"))
    return wanted.join(known, "norm", "left_anti")


_WITH = f"WITH {pack.SQL}"
_FREQ = f"frequency AS (SELECT norm, count(*) AS n FROM (SELECT unnest(string_split({X.norm_sql('texto')}, ' ')) AS norm FROM sentence) WHERE norm <> '' GROUP BY norm)"
_LEMMA = f"""{_FREQ},
lemma AS (SELECT e.norm, sum(octet_length(payload)) AS cost, min(rank) AS best_rank FROM pack_entry e GROUP BY e.norm),
known AS (SELECT l.*, coalesce(n, 0) AS n, CASE WHEN best_rank % 10 = 0 THEN 90.0 - best_rank / 100 ELSE 0 END AS known FROM lemma l LEFT JOIN frequency USING (norm)),
banded AS (SELECT *, CASE WHEN n > 0 AND n >= (SELECT sum(n) FROM frequency) * 100.0 / 1e9 THEN 0 WHEN known >= 50 THEN 1 WHEN n > 0 THEN 2 ELSE 3 END AS band FROM known),
ordered AS (SELECT *, row_number() OVER w - 1 AS place, CAST(sum(cost) OVER w AS BIGINT) AS running FROM banded
  WINDOW w AS (ORDER BY band, CASE band WHEN 1 THEN -known WHEN 3 THEN best_rank ELSE -n END, CASE band WHEN 1 THEN -n ELSE 0 END, norm)),
vocabulary AS (SELECT norm, band, place, running FROM ordered WHERE running <= {BUDGET:.0f} OR place = 0)"""
_LINE = "line AS (SELECT id, l[1] AS tag FROM (SELECT id, unnest(string_split(body, chr(10))) AS l FROM pack_staging) WHERE regexp_matches(l, '^.\\t.+'))"
_DISCOVER = f"""participle AS (SELECT id FROM pack_staging e WHERE regexp_matches(norm, '{PARTICIPLE}') AND EXISTS (
  SELECT 1 FROM pack_form f JOIN pack_staging v ON v.id = f.entry_id WHERE f.norm = e.norm AND v.id <> e.id AND (starts_with(lower(v.pos), 'verb') OR starts_with(lower(v.pos), 'глаг')))),
candidate AS (SELECT * FROM pack_staging WHERE discover IS NOT NULL AND id NOT IN (SELECT id FROM participle)),
uncommon AS (SELECT * FROM candidate WHERE discover = 0 OR headword NOT IN (SELECT headword FROM candidate WHERE discover = 0)),
best AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY headword, discover ORDER BY length(body) DESC, id) AS r FROM pack_staging WHERE discover IS NOT NULL) WHERE r = 1),
pool AS (SELECT discover AS tier, CASE WHEN regexp_matches(lower(pos), '^(noun|sust|subst|nom|сущ|ουσ)') THEN 0 WHEN regexp_matches(lower(pos), '^(verb|глаг|ρήμα)') THEN 1 ELSE 2 END AS pos_code, id AS entry_id
  FROM uncommon WHERE rank >= {BOUNDARY} OR id IN (SELECT id FROM best)),
pools AS (SELECT tier, pos_code, CAST(row_number() OVER (PARTITION BY tier, pos_code ORDER BY entry_id) - 1 AS INT) AS seq, entry_id FROM pool)"""
_RANKS = """live AS (SELECT uid, min(rank) AS a FROM pack_entry GROUP BY uid), built AS (SELECT uid, max(length(body) + rank) AS b FROM pack_staging GROUP BY uid),
both_ranks AS (SELECT * FROM live JOIN built USING (uid)),
ranked AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM both_ranks)"""
_PACKS = "pack AS (SELECT concat('pack-', s_nationkey) AS pack_id, s_suppkey AS data_version, CASE WHEN s_nationkey % 3 = 0 THEN concat('pack-', s_nationkey + 1) END AS subset_of FROM supplier)"
_KEYS_BAD = f"{X.norm_sql('headword')} <> norm"

QUERIES = {
    f.__name__: f
    for f in (pay1_render_parse, pay2_parse, pay2_inflate, pay4_merge_senses, pay6_fts_body, pay7_thesaurus, flt19_admits_sentence, win6_budget, top9_order, agg10_coverage, q24_derive_tier, q24_derive_forms, agg22_channels, agg18_ngrams, agg20_spearman, q30_calibration, q27_discover_filters, q11_discover_pools, q15_draw, q16_word_of_day, q17_tier_word, q22_pack_selection, q23_catalog, top12_history, top13_favorites, agg21_kind_counts, src18_visits, dq_report, dq16_key_sample, dq8_vocabulary)
}

ORACLES = {
    "pay1_render_parse": f"{_WITH} SELECT id, true AS same FROM pack_staging",
    "pay2_parse": f"""{_WITH}, raw AS (SELECT id, unnest(string_split(body, chr(10))) AS l, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM pack_staging),
good AS (SELECT id, i, l[1] AS tag, sum(CASE WHEN l[1] = 'S' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS sense FROM raw WHERE regexp_matches(l, '^.\\t.+'))
SELECT id, tag, count(*) AS n_lines, count(DISTINCT sense) AS n_senses FROM good GROUP BY ALL""",
    "pay4_merge_senses": f"""{_WITH}, raw AS (SELECT id, unnest(string_split(body, chr(10))) AS l, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM pack_staging),
good AS (SELECT id, l[1] AS tag, substr(l, 3) AS v, sum(CASE WHEN l[1] = 'S' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS sense FROM raw WHERE regexp_matches(l, '^.\\t.+')),
gloss AS (SELECT id, sense, {X.fold_gloss_sql('v')} AS f FROM good WHERE tag = 'S'),
held AS (SELECT DISTINCT g.id, f, tag, v FROM good d JOIN gloss g USING (id, sense) WHERE tag IN ('E', 'Y'))
SELECT id, (SELECT count(DISTINCT f) FROM gloss g WHERE g.id = s.id) AS n_senses, (SELECT count(*) FROM held h WHERE h.id = s.id AND tag = 'E') AS n_examples,
  (SELECT count(*) FROM held h WHERE h.id = s.id AND tag = 'Y') AS n_synonyms FROM (SELECT DISTINCT id FROM gloss) s""",
    "pay6_fts_body": f"""{_WITH}, raw AS (SELECT id, unnest(string_split(body, chr(10))) AS l, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM pack_staging),
good AS (SELECT id, i, l[1] AS tag, substr(l, 3) AS v, sum(CASE WHEN l[1] = 'S' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS sense FROM raw WHERE regexp_matches(l, '^.\\t.+'))
SELECT id, string_agg(v, ' ' ORDER BY sense, CASE tag WHEN 'S' THEN 0 WHEN 'E' THEN 1 WHEN 'T' THEN 2 ELSE 3 END, i) AS fts_body FROM good WHERE sense > 0 AND tag IN ('S', 'E', 'T', 'Y') GROUP BY id""",
    "pay7_thesaurus": f"""{_WITH}, reach AS (SELECT norm AS key, entry_id FROM pack_trans),
single AS (SELECT id, norm FROM pack_staging WHERE len(regexp_extract_all(body, '(?m)^S\\t.')) = 1),
pair AS (SELECT s.id, o.norm AS term, min(o.rank) AS r FROM reach a JOIN single s ON s.id = a.entry_id JOIN reach b ON b.key = a.key JOIN pack_staging o ON o.id = b.entry_id WHERE o.norm <> s.norm AND o.norm <> '' GROUP BY ALL)
SELECT id, term, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r, term) AS place FROM pair p WHERE NOT EXISTS (SELECT 1 FROM pack_form f WHERE f.norm = p.term AND f.entry_id = p.id)) WHERE place <= 4""",
    "flt19_admits_sentence": f"{_WITH} SELECT id FROM pack_staging WHERE len(regexp_extract_all(body, '(?m)^S\\t.')) = 1 AND len(regexp_extract_all(body, '(?m)^E\\t.')) = 0",
    "win6_budget": f"{_WITH}, {_LEMMA} SELECT norm, band, place, running FROM vocabulary",
    "top9_order": f"{_WITH}, {_LEMMA} SELECT band, count(*) AS n_lemmas, CAST(sum(cost) AS BIGINT) AS cost FROM banded GROUP BY band",
    "agg10_coverage": f"""{_WITH}, {_LEMMA} SELECT round(sum(CASE WHEN v.norm IS NOT NULL THEN n ELSE 0 END) / sum(n) * 100, 6) AS tokens, round(count(v.norm) / count(*) * 100, 6) AS lemmas
FROM frequency f LEFT JOIN vocabulary v USING (norm)""",
    "q24_derive_tier": f"{_WITH}, {_LEMMA} SELECT row_number() OVER (ORDER BY id) AS id, uid, headword, norm FROM pack_entry WHERE norm IN (SELECT norm FROM vocabulary)",
    "q24_derive_forms": f"""{_WITH}, {_LEMMA}, made AS (SELECT id AS old, row_number() OVER (ORDER BY id) AS new FROM pack_entry WHERE norm IN (SELECT norm FROM vocabulary))
SELECT 'form' AS ref_table, norm, new AS entry_id FROM pack_form JOIN made ON old = entry_id UNION ALL SELECT 'trans', norm, new FROM pack_trans JOIN made ON old = entry_id""",
    "agg22_channels": f"{_WITH}, {_LINE} SELECT tag, count(*) AS n_all, CAST(sum(CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_half FROM line GROUP BY tag",
    "agg18_ngrams": f"""{_WITH}, word AS (SELECT id, list_filter(regexp_split_to_array(fts_body, '\\s+'), lambda w: w <> '') AS w FROM pack_staging),
start AS (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS s FROM (SELECT w, unnest([2, 3, 4]) AS n FROM word))
SELECT array_to_string(w[s : s + n - 1], ' ') AS ngram, count(*) AS n FROM start GROUP BY ngram HAVING count(*) >= 5""",
    "agg20_spearman": f"{_WITH}, {_RANKS} SELECT round(corr(ra, rb), 6) AS rho, count(*) AS n FROM ranked",
    "q27_discover_filters": f"{_WITH}, {_DISCOVER} SELECT * FROM pools",
    "q11_discover_pools": f"{_WITH}, {_DISCOVER} SELECT tier, pos_code, max(seq) + 1 AS size, max(seq) + 1 = count(*) AS dense FROM pools GROUP BY ALL",
    "q22_pack_selection": f"""WITH {_PACKS}, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pack_id ORDER BY data_version DESC) AS v FROM pack) WHERE v = 1),
absorbing AS (SELECT pack_id FROM newest WHERE subset_of IS NULL OR subset_of NOT IN (SELECT pack_id FROM newest))
SELECT pack_id, data_version, subset_of FROM newest WHERE subset_of IS NULL OR subset_of NOT IN (SELECT pack_id FROM absorbing)""",
    "q23_catalog": f"""WITH {_PACKS}, installed AS (SELECT pack_id, max(data_version) AS local_version FROM pack WHERE data_version % 2 = 0 GROUP BY pack_id),
catalog AS (SELECT concat('pack-', n_nationkey) AS pack_id, CAST(n_nationkey * 4 AS BIGINT) AS data_version, CAST(4 - CASE WHEN n_nationkey % 7 = 0 THEN 1 ELSE 0 END AS INT) AS schema_version, 2 AS norm_version FROM nation)
SELECT c.*, local_version, CASE WHEN schema_version <> 4 OR norm_version <> 2 THEN 'needs newer reader' WHEN local_version IS NULL THEN 'download' WHEN data_version > local_version THEN 'update' ELSE 'installed' END AS status
FROM catalog c LEFT JOIN installed USING (pack_id)""",
    "top12_history": """WITH view AS (SELECT user_id, event_id % 40 AS page, ts, event_id FROM events WHERE event_type = 'view'),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, page ORDER BY ts DESC, event_id DESC) AS l FROM view) WHERE l = 1)
SELECT user_id, page, ts, CAST(p - 1 AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM last) WHERE p <= 25""",
    "top13_favorites": "SELECT user_id, event_id % 10 AS page, max(ts) AS ts FROM events WHERE event_type = 'click' GROUP BY user_id, event_id % 10 HAVING count(*) % 2 = 1",
    "src18_visits": f"{_WITH} SELECT id AS entry_id, headword, pos, lang, uid FROM pack_entry WHERE headword <> ''",
    "dq16_key_sample": f"{_WITH} SELECT id FROM pack_entry WHERE (id - 1) % 5 = 0 AND ({_KEYS_BAD} OR {X.fuzzy_sql('norm', 'lang')} <> fuzzy)",
    "dq8_vocabulary": f"{_WITH} SELECT DISTINCT {X.norm_sql('norm')} AS norm FROM sentence WHERE norm IS NOT NULL AND {X.norm_sql('norm')} NOT IN (SELECT norm FROM pack_entry UNION ALL SELECT norm FROM pack_form)",
    "dq_report": f"""{_WITH}, {_DISCOVER}
SELECT 'entry without key' AS "check", count(*) AS n_bad FROM pack_entry WHERE coalesce(norm, '') = ''
UNION ALL SELECT 'entry without fuzzy key', count(*) FROM pack_entry WHERE coalesce(fuzzy, '') = ''
UNION ALL SELECT 'entry key differs from headword', count(*) FROM pack_entry WHERE {_KEYS_BAD}
UNION ALL SELECT 'fuzzy key differs from key', count(*) FROM pack_entry WHERE {X.fuzzy_sql('norm', 'lang')} <> fuzzy
UNION ALL SELECT 'uid not positive', count(*) FROM pack_entry WHERE uid <= 0
UNION ALL SELECT 'form without entry', count(*) FROM pack_form WHERE entry_id IS NULL OR entry_id NOT IN (SELECT id FROM pack_entry)
UNION ALL SELECT 'translation without entry', count(*) FROM pack_trans WHERE entry_id NOT IN (SELECT id FROM pack_entry)
UNION ALL SELECT 'form key not normal', count(*) FROM pack_form WHERE {X.norm_sql('norm')} <> norm
UNION ALL SELECT 'uid shared', count(*) FROM (SELECT uid FROM pack_entry GROUP BY uid HAVING count(*) > 1)
UNION ALL SELECT 'pool with holes', count(*) FROM (SELECT 1 FROM pools GROUP BY tier, pos_code HAVING max(seq) + 1 <> count(*))
UNION ALL SELECT 'pool entry missing', count(*) FROM pools WHERE entry_id NOT IN (SELECT id FROM pack_staging)
UNION ALL SELECT 'body without sense', count(*) FROM pack_staging WHERE NOT regexp_matches(coalesce(body, ''), '(?m)^S\\t.')
UNION ALL SELECT 'citation without example', 0
UNION ALL SELECT 'unknown tag', count(*) FROM pack_staging WHERE regexp_matches(coalesce(body, ''), '(?m)^[^PWIHMFSUECTYAR\\n]\\t')""",
}
