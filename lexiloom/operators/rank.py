"""Ranks of entries: by frequency where there is one, else by richness of the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.ordered import with_running


def zipf(count: Column, total: Column) -> Column:
    """Occurrences per billion on a scale of powers of ten."""
    return F.log10(count / total * F.lit(1e9))


def frequency_rank(zipf_value: Column) -> Column:
    """0 to 499, lower is more common; halves go to the even number."""
    return F.greatest(F.lit(0), F.lit(499) - F.bround(zipf_value * 70).cast("int"))


def richness_rank(score: Column, proper_noun: Column | None = None) -> Column:
    """500 to 1000 by richness of the page, 1000 more for a proper noun."""
    value = F.lit(500) + F.floor(F.greatest(F.lit(0), F.lit(1000) - score.cast("int")) / 2).cast("int")
    return value if proper_noun is None else value + F.when(proper_noun, 1000).otherwise(0)


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with the rank of a value, ties sharing their mean place.

    Places come from the running counts of the distinct values, taken range by range, so neither a value that many rows
    share nor many different values meet in one task.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("_c"))
    placed = with_running(counts, [F.col(value).asc_nulls_first()], {"_upto": F.col("_c")}, place="_place")
    places = placed.select(F.col(value).alias("_v"), (F.col("_upto") - (F.col("_c") - 1) / 2).alias(out))
    return df.join(places, F.col(value).eqNullSafe(F.col("_v"))).drop("_v")
