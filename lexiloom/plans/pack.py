"""The tables of a pack as the queries see them, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.text import norm
from lexiloom.session import table

_COLUMNS = ["uid", "lang", "headword", "norm", "fuzzy", "pos", "rank"]


def entry(spark: SparkSession, sf_dir: str, payload: bool = False) -> DataFrame:
    """The live entries, one row an id: of repeated rows the one loaded last."""
    columns = _COLUMNS + ["payload"] * payload
    live = table(spark, sf_dir, "entry").filter("removed_at IS NULL AND id IS NOT NULL")
    return live.groupBy("id").agg(F.max(F.struct("loaded_at", *columns)).alias("_m")).select("id", *[F.col(f"_m.{c}").alias(c) for c in columns])


def form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "form").select("norm", "entry_id").distinct()


def trans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "trans").filter("entry_id IS NOT NULL").select("norm", "entry_id").distinct()


def staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each entry that is being built: the one loaded last, at a tie the lowest rank."""
    columns = ["uid", "lang", "headword", "norm", "fuzzy", "pos", "body", "fts_body", "discover"]
    held = F.struct("loaded_at", (-F.col("rank")).alias("_r"), *columns)
    rows = table(spark, sf_dir, "staging").filter("id IS NOT NULL").groupBy("id").agg(F.max(held).alias("_m"))
    return rows.select("id", (-F.col("_m._r")).alias("rank"), *[F.col(f"_m.{c}").alias(c) for c in columns])


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a sentence."""
    rows = table(spark, sf_dir, "frase").filter("frase_id IS NOT NULL")
    return rows.groupBy("frase_id").agg(F.max(F.struct("loaded_at", "lang", "norm", "texto")).alias("_m")).select("frase_id", "_m.lang", "_m.norm", "_m.texto")


def queries(spark: SparkSession, sf_dir: str, length: int | None = None) -> DataFrame:
    """The search queries: the key of every entry whose id is divisible by 20, cut to ``length`` characters."""
    rows = entry(spark, sf_dir).filter("id % 20 = 0")
    q = F.col("norm") if length is None else F.substring("norm", 1, length)
    return rows.select(F.col("id").alias("query_id"), q.alias("q"), F.col("lang").alias("q_lang"), F.col("fuzzy").alias("q_fuzzy"))


def typo_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt queries: the sixth and seventh letter of a key changed places."""
    q = F.concat(F.substring("norm", 1, 5), F.substring("norm", 7, 1), F.substring("norm", 6, 1), F.expr("substring(norm, 8)"))
    rows = entry(spark, sf_dir).filter("id % 20 = 0").filter(F.length("norm") >= 7)
    return rows.select(F.col("id").alias("query_id"), norm(q).alias("q"), F.col("lang").alias("q_lang"), F.col("fuzzy").alias("q_fuzzy"))


SQL = """
pack_entry AS (SELECT id, uid, lang, headword, norm, fuzzy, pos, rank, payload FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, uid DESC, lang DESC, headword DESC, norm DESC, fuzzy DESC, pos DESC NULLS LAST, rank DESC) AS rn
  FROM entry WHERE removed_at IS NULL AND id IS NOT NULL) WHERE rn = 1),
pack_form AS (SELECT DISTINCT norm, entry_id FROM form),
pack_trans AS (SELECT DISTINCT norm, entry_id FROM trans WHERE entry_id IS NOT NULL),
pack_staging AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, rank) AS rn FROM staging WHERE id IS NOT NULL) WHERE rn = 1),
sentence AS (SELECT frase_id, lang, norm, texto FROM (
  SELECT *, row_number() OVER (PARTITION BY frase_id ORDER BY loaded_at DESC, lang DESC, norm DESC NULLS LAST, texto DESC) AS rn FROM frase WHERE frase_id IS NOT NULL) WHERE rn = 1)
"""


def queries_sql(length: int | None = None) -> str:
    q = "norm" if length is None else f"substr(norm, 1, {length})"
    return f"query AS (SELECT id AS query_id, {q} AS q, lang AS q_lang, fuzzy AS q_fuzzy FROM pack_entry WHERE id % 20 = 0)"
