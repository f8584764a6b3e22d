"""The N best items of every group, also where one group holds much of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n(items: DataFrame, group: str, item: str, score: str, n: int = 10, salts: int = 32, ascending: bool = True) -> DataFrame:
    """``(group, item, score, place)``: the first ``n`` distinct items of each group by score, then item.

    Two-stage salted ranking: items are hashed into ``salts`` subgroups of their group and the first ``n`` of each
    subgroup are kept; the survivors, at most ``salts * n`` of a group, are ranked again. A group of any size is thus
    spread over ``salts`` tasks. Repeats of an item are reduced to its best score before the shuffle, and because the
    salt comes from the item they share a subgroup.

    Defined cases: rows with a null group or item are left out; a null score comes after every other; ties go to the
    smaller item; a group of fewer items gives all of them; other columns are ignored; an empty table gives no rows.
    """
    best = F.min("_s") if ascending else F.max("_s")  # both skip nulls, so an item is without score only if all its rows are
    rows = (
        items.select(F.col(group).alias("_g"), F.col(item).alias("_i"), F.col(score).alias("_s"))
        .filter("_g IS NOT NULL AND _i IS NOT NULL")
        .groupBy("_g", "_i")
        .agg(best.alias("_s"))
        .withColumn("_salt", F.pmod(F.xxhash64("_i"), F.lit(salts)))
    )
    by = [F.col("_s").asc_nulls_last() if ascending else F.col("_s").desc_nulls_last(), F.col("_i").asc()]
    survivors = rows.withColumn("_p", F.row_number().over(Window.partitionBy("_g", "_salt").orderBy(*by))).filter(F.col("_p") <= n)
    placed = survivors.withColumn("_p", F.row_number().over(Window.partitionBy("_g").orderBy(*by))).filter(F.col("_p") <= n)
    return placed.select(F.col("_g").alias(group), F.col("_i").alias(item), F.col("_s").alias(score), F.col("_p").alias("place"))
