"""Writing and reading whole packs as folders of Parquet tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The column each table is sorted by inside its files, so that a lookup skips row groups by their bounds.
LOOKUP = {"entry": "norm", "form": "norm", "trans": "norm", "discover": "tier", "posting": "term", "meta": "key"}
TIERS = ("core", "main", "full")


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where, jvm


def write_pack(tables: dict[str, DataFrame], path: str, files: int | None = None) -> None:
    """Writes the tables under a temporary name and renames the folder when all are complete.

    A run that fails leaves no pack: what it wrote is removed and what was at ``path`` stays.
    """
    spark = next(iter(tables.values())).sparkSession
    work = f"{path}.{uuid.uuid4().hex}.tmp"
    system, here, jvm = _filesystem(spark, work)
    try:
        for name, df in tables.items():
            key = LOOKUP.get(name, df.columns[0])
            spread = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
            spread.sortWithinPartitions(key).write.parquet(f"{work}/{name}")
        there = jvm.org.apache.hadoop.fs.Path(path)
        if system.exists(there):
            system.delete(there, True)
        if not system.rename(here, there):
            raise OSError(f"can't rename {work}")
    except BaseException:
        system.delete(here, True)
        raise


def read_pack(spark: SparkSession, path: str, names: tuple[str, ...] = ("entry", "form", "trans")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def upsert_meta(meta: DataFrame, changes: dict[str, str]) -> DataFrame:
    """``(key, value)`` with some values replaced or added, sorted by key."""
    new = meta.sparkSession.createDataFrame(sorted(changes.items()), "key string, value string")
    return meta.join(new.select("key"), "key", "left_anti").select("key", "value").unionByName(new).orderBy("key")


def catalog_rows(packs: DataFrame) -> DataFrame:
    """One row for each pack that can be published: it has a tier or joins two languages."""
    return packs.filter(F.col("tier").isin(*TIERS) | (F.col("kind") == "bilingual")).orderBy("pack_id")


def name_with_tier(name, tier) -> F.Column:
    """A pack's name with exactly one suffix of its tier."""
    bare = F.trim(F.regexp_replace(name, "( \\((core|main|full)\\))+$", ""))
    return F.when(tier.isin(*TIERS), F.concat(bare, F.lit(" ("), tier, F.lit(")"))).otherwise(name)


def repaired(meta: DataFrame) -> DataFrame:
    """``(key, value)`` with the name carrying its tier once; where that changes something, ``data_version`` goes up by one.

    A manifest is a few dozen keys, so it is mended on the driver.
    """
    held = {r.key: r.value for r in meta.select("key", "value").collect()}
    one = meta.sparkSession.createDataFrame([(held.get("name"), held.get("tier"))], "name string, tier string")
    name = one.select(name_with_tier(F.col("name"), F.col("tier")).alias("n")).collect()[0].n
    if name is not None and name != held.get("name"):
        held["name"] = name
        if (held.get("data_version") or "").strip().isdigit():
            held["data_version"] = str(int(held["data_version"]) + 1)
    return meta.sparkSession.createDataFrame(sorted(held.items()), "key string, value string")
