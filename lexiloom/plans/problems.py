"""Queries of the general data problems (3, 4, 7), over the whole tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators import nested, orphans, snapshots
from lexiloom.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node below a record, by path, out of the tables the variants are routed to."""
    nodes = nested.variant_tables(table(spark, sf_dir, "wikt_raw")).supertype()
    return nodes.filter("kind <> 'record'").select("rec_id", "node_path").distinct()


def p3_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each typed table, with how many of them find their parent's row through the link."""
    tables = nested.variant_tables(table(spark, sf_dir, "wikt_raw"))
    parents = tables.supertype().select("rec_id", F.col("node_path").alias("parent_path"), F.lit(1).alias("_hit"))
    return (
        tables.supertype().join(parents, ["rec_id", "parent_path"], "left")
        .groupBy("kind", "variant")
        .agg(F.count("*").alias("n_rows"), F.count("parent_path").alias("n_with_parent"), F.count("_hit").alias("n_linked"))
    )


def p3_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every node of the typed tables, read table by table."""
    tables = nested.variant_tables(table(spark, sf_dir, "wikt_raw"))
    out = None
    for kind, variants in nested.VARIANTS.items():
        for variant in variants:
            if variant != "list":
                rows = tables.subtype(kind, variant).select("rec_id", "node_path", F.lit(kind).alias("kind"), F.col(nested.TEXT_FIELD[kind]).alias("text"))
                out = rows if out is None else out.unionByName(rows)
    return out


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each snapshot added, removed and changed against the one before."""
    return snapshots.snapshot_changes(table(spark, sf_dir, "entry_snapshot"))


def p4_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of each kind by snapshot."""
    return p4_found(spark, sf_dir).groupBy("data_version", "change_kind").agg(F.count("*").alias("n_uids"))


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    form, trans = (
        table(spark, sf_dir, t).select(F.lit(t).alias("ref_table"), "norm", "entry_id", "loaded_at") for t in ("form", "trans")
    )
    return form.unionByName(trans)


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orphans.orphan_references(_references(spark, sf_dir), table(spark, sf_dir, "entry"))
    return rows.withColumn("load_month", F.date_format("loaded_at", "yyyy-MM"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of form and trans whose entry isn't live when they are loaded."""
    return _orphans(spark, sf_dir).select("ref_table", "norm", "entry_id", "load_month").distinct()


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan rows by table, month and reason; repeated rows count each time."""
    return _orphans(spark, sf_dir).groupBy("ref_table", "load_month", "orphan_reason").agg(F.count("*").alias("n_rows"))


_P4 = """
WITH latest AS (
  SELECT data_version, uid, headword, payload FROM (
    SELECT *, row_number() OVER (PARTITION BY data_version, uid ORDER BY loaded_at DESC) AS rn FROM entry_snapshot) WHERE rn = 1),
versions AS (SELECT data_version, lead(data_version) OVER (ORDER BY data_version) AS following FROM (SELECT DISTINCT data_version FROM latest)),
before AS (SELECT v.following AS data_version, l.uid, l.headword, l.payload FROM latest l JOIN versions v USING (data_version) WHERE v.following IS NOT NULL),
after AS (SELECT * FROM latest WHERE data_version > (SELECT min(data_version) FROM latest)),
changes AS (
  SELECT coalesce(a.data_version, b.data_version) AS data_version, coalesce(a.uid, b.uid) AS uid,
    CASE WHEN b.data_version IS NULL THEN 'added' WHEN a.data_version IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
  FROM after a FULL OUTER JOIN before b ON a.data_version = b.data_version AND a.uid = b.uid
  WHERE a.data_version IS NULL OR b.data_version IS NULL OR a.headword IS DISTINCT FROM b.headword OR a.payload IS DISTINCT FROM b.payload)
"""

_P7 = """
WITH refs AS (
  SELECT 'form' AS ref_table, norm, entry_id, loaded_at FROM form UNION ALL SELECT 'trans', norm, entry_id, loaded_at FROM trans),
orphan AS (
  SELECT * FROM refs r WHERE entry_id IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM entry e WHERE e.id = r.entry_id AND e.loaded_at <= r.loaded_at AND (e.removed_at IS NULL OR r.loaded_at < e.removed_at)))
"""

_MEMBERS = "CASE json_type({0}) WHEN 'ARRAY' THEN json_extract({0}, '$[*]') WHEN 'NULL' THEN [] ELSE [{0}] END"


def _level(name: str, parent: str, field: str, kind: str) -> str:
    """A table of the nodes of one nested place. Null members and blank strings are no nodes."""
    held = f"m -> '$.{field}'"
    members = _MEMBERS.format(held)
    return f"""{name} AS (SELECT rec_id, up AS parent_path, concat(up, CASE WHEN up = '' THEN '' ELSE '/' END, '{field}/', CAST(place - 1 AS VARCHAR)) AS node_path, '{kind}' AS kind, lone, m FROM (
  SELECT rec_id, node_path AS up, json_type({held}) <> 'ARRAY' AS lone, unnest({members}) AS m, generate_subscripts({members}, 1) AS place FROM {parent})
  WHERE json_type(m) <> 'NULL' AND NOT (json_type(m) = 'VARCHAR' AND trim(m ->> '$') = ''))"""


def _p3_sql(last: str) -> str:
    places = [
        ("forms", "record", "forms", "form"), ("form_tags", "forms", "tags", "tag"), ("sense", "record", "senses", "sense"), ("gloss", "sense", "glosses", "gloss"),
        ("sense_tags", "sense", "tags", "tag"), ("example", "sense", "examples", "example"), ("example_tags", "example", "tags", "tag"),
        ("synonym", "sense", "synonyms", "synonym"), ("synonym_tags", "synonym", "tags", "tag"),
    ]
    levels = ",\n".join(_level(*p) for p in places)
    union = " UNION ALL ".join(f"SELECT * FROM {p[0]}" for p in places)
    return f"""WITH record AS (SELECT DISTINCT rec_id, CAST(NULL AS VARCHAR) AS parent_path, '' AS node_path, 'record' AS kind, false AS lone, CAST(raw_json AS JSON) AS m
  FROM (SELECT * FROM wikt_raw WHERE json_valid(raw_json)) WHERE json_type(raw_json) = 'OBJECT'),
{levels},
node AS ({union})
{last}"""


_P3_TABLES = """, every AS (SELECT * FROM node UNION ALL SELECT * FROM record),
below AS (SELECT rec_id, parent_path AS node_path, bool_or(lone) AS any_lone FROM node GROUP BY ALL),
shaped AS (SELECT DISTINCT e.rec_id, e.node_path, e.parent_path, e.kind, CASE json_type(m) WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN
    CASE WHEN any_lone THEN 'loose' WHEN any_lone IS NOT NULL THEN 'branch' ELSE 'leaf' END ELSE 'text' END AS variant
  FROM every e LEFT JOIN below b ON e.rec_id = b.rec_id AND e.node_path = b.node_path)
SELECT s.kind, s.variant, count(*) AS n_rows, count(s.parent_path) AS n_with_parent, count(p.node_path) AS n_linked
FROM shaped s LEFT JOIN (SELECT DISTINCT rec_id, node_path FROM every) p ON s.rec_id = p.rec_id AND s.parent_path = p.node_path GROUP BY ALL"""

_P3_CONTENTS = """, every AS (SELECT * FROM node UNION ALL SELECT * FROM record)
SELECT DISTINCT rec_id, node_path, kind, CASE WHEN json_type(m) = 'OBJECT' THEN m ->> CASE kind WHEN 'record' THEN '$.word' WHEN 'form' THEN '$.form'
  WHEN 'example' THEN '$.text' WHEN 'synonym' THEN '$.word' WHEN 'gloss' THEN '$.text' WHEN 'tag' THEN '$.name' ELSE '$.gloss' END ELSE m ->> '$' END AS text
FROM every WHERE json_type(m) <> 'ARRAY'"""

QUERIES = {f.__name__: f for f in (p3_found, p3_tables, p3_contents, p4_found, p4_summary, p7_found, p7_report)}

ORACLES = {
    "p3_found": _p3_sql("SELECT DISTINCT rec_id, node_path FROM node"),
    "p3_tables": _p3_sql("") + _P3_TABLES,
    "p3_contents": _p3_sql("") + _P3_CONTENTS,
    "p4_found": _P4 + "SELECT data_version, uid, change_kind FROM changes",
    "p4_summary": _P4 + "SELECT data_version, change_kind, count(*) AS n_uids FROM changes GROUP BY ALL",
    "p7_found": _P7 + "SELECT DISTINCT ref_table, norm, entry_id, strftime(loaded_at, '%Y-%m') AS load_month FROM orphan",
    "p7_report": _P7
    + """, first_seen AS (SELECT id, min(loaded_at) AS first_at FROM entry GROUP BY id)
SELECT ref_table, strftime(loaded_at, '%Y-%m') AS load_month,
  CASE WHEN first_at IS NULL THEN 'never' WHEN loaded_at < first_at THEN 'before' ELSE 'removed' END AS orphan_reason, count(*) AS n_rows
FROM orphan LEFT JOIN first_seen ON id = entry_id GROUP BY ALL""",
}
