"""Record readers over the raw dictionary dump table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.sources import dumps
from lexiloom.session import table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dumps.wiktionary(table(spark, sf_dir, "wikt_raw"), "raw_json", "es", translations_to="en", keep=("rec_id",))


def src1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staging records of the dump."""
    rows = _records(spark, sf_dir)
    return rows.select("rec_id", "headword", "pos", "norm", "rank", F.size("senses").alias("n_senses"), F.size("forms").alias("n_forms"), "etymology", "pronunciation", "syllables").distinct()


def src2_inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms that form pages declare for their lemmas."""
    return dumps.inbound_forms(dumps.parsed_records(table(spark, sf_dir, "wikt_raw"), "raw_json")).select("lemma", F.array_join("forms", "|").alias("forms"))


def src3_bilingual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that glosses give when they are read as translations."""
    return dumps.bilingual_terms(_records(spark, sf_dir), "rec_id")


def src11_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of records with one sense."""
    return dumps.single_sense_examples(table(spark, sf_dir, "wikt_raw"), "raw_json")


def src12_inflections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of each headword key."""
    from lexiloom.plans import pack

    return dumps.inflections(pack.form(spark, sf_dir), pack.entry(spark, sf_dir)).select("norm", F.array_join("forms", "|").alias("forms"))


def arr2_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Senses by label."""
    labels = _records(spark, sf_dir).select("rec_id", F.explode("senses").alias("s")).select(F.explode("s.labels").alias("label"))
    return labels.groupBy("label").agg(F.count("*").alias("n_senses"))


QUERIES = {f.__name__: f for f in (src1_records, src2_inbound, src3_bilingual, src11_examples, src12_inflections, arr2_labels)}

ORACLES: dict[str, str] = {
    "src12_inflections": """WITH live AS (SELECT id, norm FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, uid DESC, lang DESC, headword DESC, norm DESC) AS rn FROM entry WHERE removed_at IS NULL AND id IS NOT NULL) WHERE rn = 1),
pair AS (SELECT DISTINCT l.norm, f.norm AS form FROM form f JOIN live l ON l.id = f.entry_id WHERE NOT contains(f.norm, ' ') AND NOT regexp_matches(f.norm, '[0-9]') AND f.norm <> l.norm)
SELECT norm, string_agg(form, '|' ORDER BY form) AS forms FROM pair GROUP BY norm""",
}
