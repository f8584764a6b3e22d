"""Checks of a finished pack. Each gives rows ``(check, n_bad)``; a sound pack has 0 everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as X

# The keys a manifest must have.
REQUIRED_META = ("schema_version", "pack_id", "name", "kind", "langs", "fuzzy_profiles", "norm_version", "payload_codec", "data_version", "entry_count", "sources")
SCHEMA_VERSION, NORM_VERSION, CODEC = 4, 2, "deflate-v2"


def _counted(name: str, bad: DataFrame) -> DataFrame:
    return bad.agg(F.count("*").alias("n_bad")).select(F.lit(name).alias("check"), "n_bad")


def report(entry: DataFrame, form: DataFrame, trans: DataFrame, discover: DataFrame, staging: DataFrame) -> DataFrame:
    """The row-level checks, one row each."""
    ids = entry.select(F.col("id").alias("_id"))
    orphan = lambda df: df.join(ids, F.col("entry_id") == F.col("_id"), "left_anti")
    flags: dict[str, Column] = {
        "entry without key": F.coalesce(F.col("norm"), F.lit("")) == "",
        "entry without fuzzy key": F.coalesce(F.col("fuzzy"), F.lit("")) == "",
        "entry key differs from headword": X.norm(F.col("headword")) != F.col("norm"),
        "fuzzy key differs from key": X.fuzzy(F.col("norm"), F.col("lang")) != F.col("fuzzy"),
        "uid not positive": F.col("uid") <= 0,
    }
    # One pass over the entries for all flags, then one row a flag.
    sums = entry.agg(*[F.sum(F.when(c, 1).otherwise(0)).cast("bigint").alias(n) for n, c in flags.items()])
    out = sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias("n_bad")) for n in flags])).alias("_c")).select("_c.*")
    text = F.coalesce(F.col("body"), F.lit(""))
    rest = {
        "form without entry": orphan(form),
        "translation without entry": orphan(trans),
        "form key not normal": form.filter(X.norm(F.col("norm")) != F.col("norm")),
        "uid shared": entry.groupBy("uid").agg(F.count("*").alias("n")).filter("n > 1"),
        "pool with holes": discover.groupBy("tier", "pos_code").agg((F.max("seq") + 1).alias("a"), F.count("*").alias("b")).filter("a <> b"),
        "pool entry missing": discover.join(staging.select(F.col("id").alias("_id")), F.col("entry_id") == F.col("_id"), "left_anti"),
        "body without sense": staging.filter(~text.rlike("(?m)^S\\t.")),
        "citation without example": staging.filter(text.rlike("(?m)^(?!E\\t).*\\nC\\t")),
        "unknown tag": staging.filter(text.rlike("(?m)^[^PWIHMFSUECTYAR\\n]\\t")),
    }
    for name, bad in rest.items():
        out = out.unionByName(_counted(name, bad))
    return out


def rejection(meta: DataFrame) -> DataFrame:
    """``(pack_id, reason)``: the first reason for which a reader refuses a pack, null for a sound one.

    ``meta``: ``pack_id, key, value``. The manifest is turned into a map a pack, so any key may be missing.
    """
    packs = meta.groupBy("pack_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("key", "value")))).alias("m"))
    value = lambda k: F.try_element_at("m", F.lit(k))
    number = lambda k, kind: F.trim(value(k)).try_cast(kind)
    listed = lambda k: F.filter(F.transform(F.split(F.coalesce(value(k), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    missing = None
    for k in REQUIRED_META:
        missing = value(k).isNull() if missing is None else missing | value(k).isNull()
    sources = F.filter(F.split(F.coalesce(value("sources"), F.lit("")), "\n"), lambda s: s != "")
    reason = (
        F.when(number("schema_version", "int").isNull(), "metadata")
        .when(number("schema_version", "int") != SCHEMA_VERSION, "schema version")
        .when(missing, "metadata")
        .when(number("norm_version", "int").isNull() | number("entry_count", "int").isNull() | number("data_version", "bigint").isNull(), "metadata")
        .when(F.size(listed("langs")) == 0, "metadata")
        .when(F.size(listed("langs")) != F.size(listed("fuzzy_profiles")), "metadata")
        .when(number("norm_version", "int") != NORM_VERSION, "norm version")
        .when(value("payload_codec") != CODEC, "payload codec")
        .when((F.size(sources) == 0) | F.exists(sources, lambda s: F.trim(F.coalesce(F.get(F.split(s, "\t"), F.lit(3)), F.lit(""))) == ""), "license")
    )
    return packs.select("pack_id", reason.alias("reason"))


def key_sample(entry: DataFrame, step: int) -> DataFrame:
    """Sampled entries whose stored keys aren't what their headword gives."""
    rows = entry.filter((F.col("id") - 1) % step == 0)
    return rows.filter((X.norm(F.col("headword")) != F.col("norm")) | (X.fuzzy(F.col("norm"), F.col("lang")) != F.col("fuzzy"))).select("id")
