"""Queries of the training-data problems (1, 2, 5, 6, 8, 9, 10), over the whole tables, and their SQL twins."""

from __future__ import annotations

import unicodedata
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm import leakage, lookalikes, mojibake, packing, sampling, term_counts, topn
from lexiloom.session import ensure_checkpoint_dir, table

#: Share of the records first seen in an epoch, by the first epoch of each step: lowered as the collection grows.
ENTRY_RATES = {"2025-01": 0.30, "2025-07": 0.20, "2026-01": 0.10}
SNAPSHOT_RATE = 0.25
SAMPLE_KEY = ["uid", "headword"]


def _shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a written table beside the checkpoints."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def p1_entry_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries chosen by the rate of the month in which they were first loaded.

    The ledger is made of all months but the last, then extended by the last as a new delivery, as a pipeline would.
    """
    rows = table(spark, sf_dir, "entry").select(*SAMPLE_KEY, F.date_format("loaded_at", "yyyy-MM").alias("epoch"))
    last = rows.agg(F.max("epoch").alias("m")).collect()[0].m or ""
    ledger = sampling.Ledger(spark, _shared_folder(spark, "ledger"), SAMPLE_KEY)
    ledger.begin(rows.filter(F.col("epoch").isNull() | (F.col("epoch") < last)), "epoch", ENTRY_RATES, 0.0)
    ledger.extend(rows.filter(F.col("epoch") == last), last, next((ENTRY_RATES[s] for s in sorted(ENTRY_RATES, reverse=True) if last >= s), 0.0))
    return sampling.choose(ledger.records(), SAMPLE_KEY).select(*SAMPLE_KEY, "first_epoch", "rate")


def p1_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What any right sample holds to: no record twice, every chosen one in the table, and shares near the rates, by first epoch.

    ``share_off`` tells whether the share of an epoch with at least 200 records is further from its rate than five
    standard deviations.
    """
    chosen = p1_entry_sample(spark, sf_dir).withColumn("_c", F.lit(1))
    firsts = sampling.first_seen(table(spark, sf_dir, "entry").select(*SAMPLE_KEY, F.date_format("loaded_at", "yyyy-MM").alias("epoch")), SAMPLE_KEY, "epoch", ENTRY_RATES, 0.0)
    on = [F.col(f"f.{c}").eqNullSafe(F.col(f"s.{c}")) for c in SAMPLE_KEY]
    both = firsts.alias("f").join(chosen.alias("s"), on[0] & on[1], "full_outer")
    sums = both.groupBy(F.coalesce("f.first_epoch", "s.first_epoch").alias("first_epoch")).agg(
        F.count("f.rate").alias("n_records"), F.count("_c").alias("_n"), F.count_distinct("s.uid", "s.headword").alias("_d"),
        F.sum(F.when(F.col("f.rate").isNull() | (F.col("f.rate") != F.col("s.rate")), 1).otherwise(0)).alias("n_wrong"), F.max("f.rate").alias("_r"),
    )
    off = F.abs(F.col("_n") - F.col("n_records") * F.col("_r")) > 5 * F.sqrt(F.col("n_records") * F.col("_r") * (1 - F.col("_r")))
    return sums.select("first_epoch", "n_records", (F.col("_n") - F.col("_d")).alias("n_twice"), "n_wrong", (off & (F.col("n_records") >= 200)).alias("share_off"))


def p1_snapshot_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen records of each snapshot; a record chosen once is in the sample of every later snapshot that holds it."""
    rows = table(spark, sf_dir, "entry_snapshot").select("data_version", *SAMPLE_KEY).distinct()
    ledger = sampling.first_seen(rows.withColumn("epoch", F.col("data_version").cast("string")), SAMPLE_KEY, "epoch", {}, SNAPSHOT_RATE)
    chosen = sampling.choose(ledger, SAMPLE_KEY).select(*[F.col(c).alias(f"_{c}") for c in SAMPLE_KEY])
    same = F.col("uid").eqNullSafe(F.col("_uid")) & F.col("headword").eqNullSafe(F.col("_headword"))
    return rows.join(chosen, same, "left_semi")


def _written_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.distinct_values(
        {f"{t}.{c}": table(spark, sf_dir, t).select(c) for t, c in (("entry", "headword"), ("entry", "norm"), ("form", "norm"))}
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different values of a field that look the same."""
    return lookalikes.look_alike_pairs(_written_values(spark, sf_dir))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value that looks like another one of its field, with how many share its look."""
    return lookalikes.look_classes(_written_values(spark, sf_dir)).select("src_field", "value", "n_values")


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every value that is stored otherwise, with the kind of confusable it is."""
    changed = _written_values(spark, sf_dir).filter("value <> consistent")
    return changed.select("src_field", "value", "consistent", lookalikes.confusable_udf("value").alias("confusable"))


def _counted(spark: SparkSession, sf_dir: str) -> tuple[term_counts.TermCounts, int]:
    """The counts after a first delivery of all months but the last and a second one of the last, and the number of records."""
    rows = table(spark, sf_dir, "frase").select("frase_id", "norm", "texto", "loaded_at", F.date_format("loaded_at", "yyyy-MM").alias("_month"))
    last = rows.agg(F.max("_month").alias("m")).collect()[0].m or ""
    store = term_counts.TermCounts(spark, _shared_folder(spark, "counts"))
    before = term_counts.latest_records(rows.filter(F.col("_month").isNull() | (F.col("_month") < last)))
    store.apply(term_counts.term_rows(before, "frase_id", "frase.norm", "frase.texto"))
    delivered = term_counts.latest_records(rows.filter(F.col("_month") == last))
    moved = term_counts.signed_records(before, delivered)
    store.apply(term_counts.term_rows(moved, "frase_id", "frase.norm", "frase.texto", sign=F.col("sign")))
    n_records = rows.agg(F.count_distinct("frase_id").alias("n")).collect()[0].n
    return store, n_records


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that are too rare or too common to serve."""
    store, n_records = _counted(spark, sf_dir)
    return term_counts.marked(store.counts(), n_records).filter("mark IS NOT NULL").select("src_field", "term", "mark")


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and records of every term."""
    store, _ = _counted(spark, sf_dir)
    return store.counts()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten entries of lowest rank of every translation key."""
    loaded_last = F.max(F.struct("loaded_at", (-F.col("rank")).alias("_r"))).alias("_m")
    staging = table(spark, sf_dir, "staging").filter("id IS NOT NULL").groupBy("id").agg(loaded_last).select("id", (-F.col("_m._r")).alias("rank"))
    keys = table(spark, sf_dir, "staging_trans").filter("norm IS NOT NULL AND entry_id IS NOT NULL").select("norm", "entry_id")
    return topn.top_n(keys.join(staging, F.col("entry_id") == F.col("id")), "norm", "entry_id", "rank").select("norm", "entry_id")


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in containers of 2,048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What any right packing holds to, over all containers: nothing above capacity or overlapping, no token lost or twice, few containers.

    ``n_cut_short`` counts texts that are cut although they fit; ``wasteful`` is true if the containers are more than one
    in a hundred above the least number that holds the tokens.
    """
    capacity = 2048
    packed = packing.pack(table(spark, sf_dir, "documents"), capacity=capacity)
    held = packed.filter("n_tokens > 0")
    before = F.max(F.col("container_offset") + F.col("n_tokens")).over(Window.partitionBy("container_id").orderBy("container_offset").rowsBetween(Window.unboundedPreceding, -1))
    boxes = held.withColumn("_overlap", (F.coalesce(before, F.lit(0)) > F.col("container_offset")).cast("int")).groupBy("container_id").agg(
        F.sum("n_tokens").alias("_n"), F.max(F.col("container_offset") + F.col("n_tokens")).alias("_end"), F.sum("_overlap").alias("_o")
    )
    of_boxes = boxes.agg(
        F.sum(((F.col("_n") > capacity) | (F.col("_end") > capacity)).cast("int")).alias("n_overfull"), F.sum("_o").alias("n_overlaps"),
        (F.count("*") > 1 + 1.01 * F.ceil(F.sum("_n") / capacity)).alias("wasteful"),
    )
    texts = packed.groupBy("doc_id").agg(F.count("*").alias("_p"), F.sum("n_tokens").alias("_n"), F.max("token_to").alias("_to"))
    of_texts = texts.agg(
        F.count("*").alias("n_texts"), F.sum((F.col("_n") != F.col("_to")).cast("int")).alias("n_with_lost_tokens"),
        F.sum(((F.col("_p") > 1) & (F.col("_n") <= capacity)).cast("int")).alias("n_cut_short"),
    )
    both = of_boxes.withColumn("_k", F.lit(1)).join(of_texts.withColumn("_k", F.lit(1)), "_k")  # one row each
    return both.select("n_texts", "n_overfull", "n_overlaps", "wasteful", "n_with_lost_tokens", "n_cut_short")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold twelve consecutive words of a test item."""
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item")).select("doc_id", "item_id")


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each leaked item the documents and passages that give it away."""
    found = leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.sum("n_passages").alias("n_passages"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents garbled by a wrong decoding."""
    return mojibake.garbled_keys(table(spark, sf_dir, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled documents with their text restored as far as nothing was lost."""
    return mojibake.find_garbled(table(spark, sf_dir, "documents")).select("doc_id", "chains", "n_words", "lossless", "restored")


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _looks_like_sql(column: str) -> str:
    """The look of a value in SQL: the first member of each look-alike class, plain width and spaces, nothing invisible."""
    pairs = {ch: next(m for m in row if m) for row in lookalikes.ROWS for part in row for ch in part}
    pairs |= lookalikes.SIGNS | {chr(c): " " for c in (0xA0, 0x2007, 0x2009, 0x200A, 0x202F, 0x205F, 0x3000)}
    pairs |= {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF01, 0xFF5F)}
    pairs = {a: b for a, b in pairs.items() if a != b and len(b) == 1}
    hidden = "[\\x{00AD}\\x{034F}\\x{180E}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{FE00}-\\x{FE0F}\\x{FEFF}]"
    shown = f"translate(regexp_replace({column}, '{hidden}', '', 'g'), {_literal(''.join(pairs))}, {_literal(''.join(pairs.values()))})"
    return f"nfc_normalize(trim(regexp_replace({shown}, ' +', ' ', 'g')))"


_P5 = """
WITH latest AS (SELECT frase_id, norm, texto FROM (
    SELECT *, row_number() OVER (PARTITION BY frase_id ORDER BY loaded_at DESC) AS rn FROM frase WHERE frase_id IS NOT NULL) WHERE rn = 1),
occurrence AS (
  SELECT 'frase.norm' AS src_field, norm AS term, frase_id FROM latest WHERE norm IS NOT NULL
  UNION ALL
  SELECT 'frase.texto', lower(unnest(regexp_extract_all(nfc_normalize(texto), '\\p{L}+'))), frase_id FROM latest),
counted AS (SELECT src_field, term, count(*) AS n_occurrences, count(DISTINCT frase_id) AS n_records FROM occurrence GROUP BY ALL)
"""

_P9 = """
WITH doc AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(nfc_normalize(regexp_replace(text, '[\\x{00AD}\\x{200B}-\\x{200F}\\x{2060}\\x{FEFF}]', '', 'g')))), '[\\p{L}\\p{N}]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(strip_accents(lower(nfc_normalize(regexp_replace(text, '[\\x{00AD}\\x{200B}-\\x{200F}\\x{2060}\\x{FEFF}]', '', 'g')))), '[\\p{L}\\p{N}]+') AS w FROM eval_item),
doc_passage AS (SELECT doc_id, hash(w[i : i + 11]) AS h, w[i : i + 11] AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM doc WHERE len(w) >= 12)),
item_passage AS (SELECT item_id, hash(w[i : i + 11]) AS h, w[i : i + 11] AS p FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM item WHERE len(w) >= 12)),
found AS (SELECT DISTINCT d.doc_id, i.item_id, i.p FROM doc_passage d JOIN item_passage i ON d.h = i.h AND d.p = i.p)
"""

_VALUES = """
WITH shown AS (
  SELECT 'entry.headword' AS src_field, headword AS v, {h} AS look FROM (SELECT DISTINCT headword FROM entry WHERE headword IS NOT NULL)
  UNION ALL SELECT 'entry.norm', norm, {n} FROM (SELECT DISTINCT norm FROM entry WHERE norm IS NOT NULL)
  UNION ALL SELECT 'form.norm', norm, {n} FROM (SELECT DISTINCT norm FROM form WHERE norm IS NOT NULL))
"""

QUERIES = {
    f.__name__: f
    for f in (p1_entry_sample, p1_snapshot_sample, p1_invariants, p2_found, p2_classes, p2_forms, p5_found, p5_counts, p6_found, p8_packed, p8_invariants, p9_found, p9_items, p10_found, p10_restored)
}

ORACLES = {
    "p1_invariants": """
SELECT first_epoch, count(*) AS n_records, CAST(0 AS BIGINT) AS n_twice, CAST(0 AS BIGINT) AS n_wrong, false AS share_off
FROM (SELECT uid, headword, min(strftime(loaded_at, '%Y-%m')) AS first_epoch FROM entry GROUP BY uid, headword) GROUP BY first_epoch""",
    "p8_invariants": """
SELECT count(DISTINCT doc_id) AS n_texts, CAST(0 AS BIGINT) AS n_overfull, CAST(0 AS BIGINT) AS n_overlaps, false AS wasteful,
  CAST(0 AS BIGINT) AS n_with_lost_tokens, CAST(0 AS BIGINT) AS n_cut_short FROM documents""",
    "p2_found": _VALUES.format(h=_looks_like_sql("headword"), n=_looks_like_sql("norm"))
    + "SELECT a.src_field, a.v AS value_a, b.v AS value_b FROM shown a JOIN shown b ON a.src_field = b.src_field AND a.look = b.look AND a.v < b.v",
    "p2_classes": _VALUES.format(h=_looks_like_sql("headword"), n=_looks_like_sql("norm"))
    + "SELECT src_field, v AS value, n_values FROM (SELECT *, count(*) OVER (PARTITION BY src_field, look) AS n_values FROM shown) WHERE n_values > 1",
    "p5_found": _P5
    + """SELECT src_field, term, CASE WHEN n_records < 3 THEN 'rare' ELSE 'common' END AS mark
FROM counted WHERE n_records < 3 OR n_records > 0.05 * (SELECT count(*) FROM latest)""",
    "p5_counts": _P5 + "SELECT src_field, term, n_occurrences, n_records FROM counted",
    "p6_found": """
WITH latest AS (SELECT id, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, rank) AS rn FROM staging WHERE id IS NOT NULL) WHERE rn = 1),
pair AS (SELECT DISTINCT t.norm, t.entry_id, s.rank FROM staging_trans t JOIN latest s ON s.id = t.entry_id WHERE t.norm IS NOT NULL)
SELECT norm, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY rank NULLS LAST, entry_id) AS rn FROM pair) WHERE rn <= 10""",
    "p9_found": _P9 + "SELECT DISTINCT doc_id, item_id FROM found",
    "p9_items": _P9 + "SELECT item_id, count(DISTINCT doc_id) AS n_docs, CAST(count(*) AS BIGINT) AS n_passages FROM found GROUP BY item_id",
}
