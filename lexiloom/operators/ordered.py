"""Places and running totals over a whole table in a total order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import durable


def with_running(df: DataFrame, order: Sequence[Column], totals: dict[str, Column], place: str = "place") -> DataFrame:
    """``df`` with ``place`` (from 0) and the running total of each of ``totals`` up to and with each row.

    The table is cut into ranges of the order, each range is totalled, the totals of the ranges before are added, and
    inside a range the rows are counted on. ``order`` must be total; ranges keep equal keys together. The ranges are
    written once, since another cut on a second reading would not add up. Null amounts count as 0.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = durable(df.withColumns({f"_t_{n}": F.coalesce(c, F.lit(0)) for n, c in totals.items()}).repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    # One row a range: the only unpartitioned window is over these.
    sums = cut.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(f"_t_{n}").alias(f"_s_{n}") for n in totals])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_n", *(f"_s_{n}" for n in totals))])
    inside = Window.partitionBy("_range").orderBy(*order)
    rows = cut.join(F.broadcast(base), "_range")  # as many rows as ranges
    running = {n: F.col(f"_s_{n}") + F.sum(f"_t_{n}").over(inside.rowsBetween(Window.unboundedPreceding, 0)) for n in totals}
    return rows.withColumns({place: (F.col("_n") + F.row_number().over(inside) - 1).cast("bigint")} | running).drop("_range", "_n", *[f"_t_{n}" for n in totals], *[f"_s_{n}" for n in totals])


def grouped_places(df: DataFrame, groups: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """``df`` with dense places from 0 inside each group, in a total order.

    Places over the whole table minus the first place of the group: a group that holds a third of all rows is counted by
    as many tasks as its rows need. A null is a group of its own.
    """
    keys = [F.col(g).asc_nulls_first() for g in groups]
    placed = with_running(df, [*keys, *[F.col(o).asc_nulls_first() for o in order]], {}, place="_place")
    firsts = placed.groupBy(*groups).agg(F.min("_place").alias("_first"))
    same = None
    for g in groups:
        one = F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}"))
        same = one if same is None else same & one
    joined = placed.alias("l").join(firsts.alias("r"), same)
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("l._place") - F.col("r._first")).cast("int").alias(out))
