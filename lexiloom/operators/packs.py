"""Many packs: which to ask, which to offer; what a reader has visited."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HISTORY = 25
SEPARATOR = "\x1f"


def packs_to_query(packs: DataFrame) -> DataFrame:
    """The newest version of each pack, without those that are a subset of a present pack which is itself no such subset.

    ``packs``: ``pack_id, data_version, subset_of`` and more. Of two packs that claim to be parts of each other both stay.
    """
    newest = packs.withColumn("_v", F.row_number().over(Window.partitionBy("pack_id").orderBy(F.col("data_version").desc()))).filter("_v = 1").drop("_v")
    present = newest.select(F.col("pack_id").alias("_id"))
    inside = newest.join(present, F.col("subset_of") == F.col("_id"), "left_semi").select("pack_id")
    absorbing = newest.join(inside, "pack_id", "left_anti").select(F.col("pack_id").alias("_id"))
    return newest.join(absorbing, F.col("subset_of") == F.col("_id"), "left_anti")


def classified(catalog: DataFrame, installed: DataFrame, schema_version: int, norm_version: int) -> DataFrame:
    """``catalog`` with ``status``: ``download``, ``update``, ``installed``, or ``needs newer reader`` for other versions."""
    own = installed.groupBy("pack_id").agg(F.max("data_version").alias("_local"))
    opens = (F.col("schema_version") == schema_version) & (F.col("norm_version") == norm_version)
    status = F.when(~F.coalesce(opens, F.lit(False)), "needs newer reader").when(F.col("_local").isNull(), "download").when(F.col("data_version") > F.col("_local"), "update").otherwise("installed")
    return catalog.join(own, "pack_id", "left").withColumn("status", status).withColumnRenamed("_local", "local_version")


def history(visits: DataFrame, user: str, item: str, at: str, tie: str, size: int = HISTORY) -> DataFrame:
    """``(user, item, at, place)``: the last ``size`` different items of each user, the latest first.

    Visits of an item are reduced to the last one before the shuffle, so one that is visited without end costs a row.
    """
    last = visits.groupBy(user, item).agg(F.max(F.struct(at, tie)).alias("_l")).select(user, item, F.col(f"_l.{at}").alias(at), F.col(f"_l.{tie}").alias(tie))
    w = Window.partitionBy(user).orderBy(F.col(at).desc(), F.col(tie).desc())
    return last.withColumn("place", F.row_number().over(w) - 1).filter(F.col("place") < size).select(user, item, at, "place")


def toggled(marks: DataFrame, user: str, item: str, at: str) -> DataFrame:
    """Items that were marked an odd number of times, with the time of the last mark."""
    return marks.groupBy(user, item).agg(F.count("*").alias("_n"), F.max(at).alias(at)).filter("_n % 2 = 1").select(user, item, at)


def visit_lines(visits: DataFrame) -> DataFrame:
    """Visits as text: seven fields with a unit separator."""
    fields = ["pack_id", "entry_id", "headword", "pos", "gloss", "lang", "uid"]
    return visits.select(F.concat_ws(SEPARATOR, *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]).alias("value"))


def parsed_visits(lines: DataFrame, value: str = "value") -> DataFrame:
    """The visits of a text; lines of fewer than four fields, without pack, headword or a number as id are left out."""
    f = F.split(F.col(value), SEPARATOR)
    part = lambda i: F.nullif(F.get(f, i), F.lit(""))
    rows = lines.filter(F.size(f) >= 4).select(part(0).alias("pack_id"), part(1).try_cast("bigint").alias("entry_id"), part(2).alias("headword"), part(3).alias("pos"), part(4).alias("gloss"), part(5).alias("lang"), part(6).try_cast("bigint").alias("uid"))
    return rows.filter("pack_id IS NOT NULL AND entry_id IS NOT NULL AND headword IS NOT NULL")
