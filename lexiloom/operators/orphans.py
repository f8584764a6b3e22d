"""References to records that don't exist, never existed, or exist only at another time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import durable

#: A block of the run index holds two to this power ids: a reference is compared with the runs of its block only. Blocks
#: are found by shifting, which is exact for every bigint, also negative ones.
BLOCK_BITS = 6
#: Lives in one row of the run index; an id with more has further rows, each for a stretch of time.
LIVES_IN_ROW = 64


def merged_lives(parents: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """``(id, f, t)``: the disjoint lives of each id, from ``f`` (included) to ``t`` (excluded; null: still live).

    Overlapping and touching lives are merged. Rows with a null id or a null start, and lives that end before they
    begin, say nothing about any time and are left out.
    """
    far = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    lives = (
        parents.select(F.col(key).cast("bigint").alias("id"), F.col(start).cast("timestamp_ntz").alias("f"), F.coalesce(F.col(end).cast("timestamp_ntz"), far).alias("t"))
        .filter("id IS NOT NULL AND f IS NOT NULL AND f < t")
        .groupBy("id", "f")
        .agg(F.max("t").alias("t"))
    )
    by_start = Window.partitionBy("id").orderBy("f")
    reach = F.max("t").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum("_new").over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    return (
        lives.withColumn("_new", F.when(F.col("f") <= reach, 0).otherwise(1))
        .withColumn("_island", island)
        .groupBy("id", "_island")
        .agg(F.min("f").alias("f"), F.max("t").alias("t"))
        .select("id", "f", F.when(F.col("t") < far, F.col("t")).alias("t"))
    )


def key_runs(lives: DataFrame, lives_in_row: int = LIVES_IN_ROW) -> DataFrame:
    """``(block, s, e, upto, since, until, lives)``: the runs of consecutive ids of each block that share the same lives.

    A run holds the ids from ``s`` to ``e``, their lives at most ``lives_in_row`` a row: the first row of a run is in force at
    any time before ``until``, a later one from ``since`` on (nulls: no bound). So at any time an id has exactly one row.
    ``upto`` is for first rows the last id before the next run of the block (the last id of the block for its last run), so
    that exactly one run starts at or before an id, and for later rows ``e``.
    """
    numbered = lives.withColumn("_c", F.floor((F.row_number().over(Window.partitionBy("id").orderBy("f")) - 1) / lives_in_row))
    per_row = numbered.groupBy("id", "_c").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("lives"))
    following = F.lead("lives").over(Window.partitionBy("id").orderBy("_c"))[0]["f"]
    per_row = per_row.select(F.shiftright("id", BLOCK_BITS).alias("block"), "id", "_c", F.when(F.col("_c") > 0, F.col("lives")[0]["f"]).alias("since"), following.alias("until"), "lives")
    by_id = Window.partitionBy("block", "_c").orderBy("id")
    same = (F.col("id") == F.lag("id").over(by_id) + 1) & F.col("lives").eqNullSafe(F.lag("lives").over(by_id)) & F.col("until").eqNullSafe(F.lag("until").over(by_id))
    runs = (
        per_row.withColumn("_new", F.when(same, 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(by_id.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("block", "_c", "_run")
        .agg(F.min("id").alias("s"), F.max("id").alias("e"), F.first("since").alias("since"), F.first("until").alias("until"), F.first("lives").alias("lives"))
    )
    next_run = F.lead("s").over(Window.partitionBy("block", "_c").orderBy("s"))
    reach = F.coalesce(next_run - 1, F.shiftleft("block", BLOCK_BITS).bitwiseOR(F.lit(2**BLOCK_BITS - 1)))
    return runs.select("block", "s", "e", F.when(F.col("_c") > 0, F.col("e")).otherwise(reach).alias("upto"), "since", "until", "lives")


def orphan_references(
    refs: DataFrame, parents: DataFrame, ref_key: str = "entry_id", ref_time: str = "loaded_at", key: str = "id", start: str = "loaded_at", end: str = "removed_at"
) -> DataFrame:
    """The rows of ``refs`` whose key names no parent that is live at the row's own time, with why.

    Method: the sorted integer keys of the parents are compressed into contiguous runs (``key_runs``); each reference is
    matched as-of to the run that starts at or before its key and is reported if its key lies beyond the run's end, or
    if no life of that run holds its time. Runs are cut at block borders, so the as-of match is an equi-join on the block
    with the run's reach as residual, which at most one run meets; a block that holds a third of all references is split
    by the adaptive skew join, since the side that is split carries no state. The run index is written once. An id that
    was removed and added again very often has several rows in it, of which the reference's time picks one.

    All columns of ``refs`` come back, plus ``orphan_reason``: ``never`` (no row of the parent has that id),
    ``before`` (it came only later) or ``removed``. Rows with a null key refer to nothing and are left out; a null time
    is live at no time. Repeated rows come back as often as they occur. Without parents every reference is ``never``;
    without references there are no rows.
    """
    own = refs.columns
    lives = merged_lives(parents, key, start, end)
    runs = durable(key_runs(lives))
    packed = refs.filter(F.col(ref_key).isNotNull()).select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col(ref_key).cast("bigint").alias("_id"), F.col(ref_time).cast("timestamp_ntz").alias("_at")
    ).withColumn("_block", F.shiftright("_id", BLOCK_BITS))
    in_force = (runs["since"].isNull() | (runs["since"] <= packed["_at"])) & (
        runs["until"].isNull() | (packed["_id"] > runs["e"]) | (runs["since"].isNull() & packed["_at"].isNull()) | (packed["_at"] < runs["until"])
    )
    asof = (packed["_block"] == runs["block"]) & (runs["s"] <= packed["_id"]) & (packed["_id"] <= runs["upto"]) & in_force
    matched = packed.join(runs, asof, "left").select("_row", "_id", "_at", "e", "since", "lives")
    beyond = F.col("e").isNull() | (F.col("_id") > F.col("e"))
    live = F.coalesce(F.exists("lives", lambda x: (x["f"] <= F.col("_at")) & (x["t"].isNull() | (F.col("_at") < x["t"]))), F.lit(False))
    reason = F.when(beyond, "never").when(F.col("since").isNull() & (F.col("_at") < F.col("lives")[0]["f"]), "before").otherwise("removed")
    found = matched.filter(beyond | ~live).select("_row", reason.alias("_why"))
    return found.select("_row.*", F.col("_why").alias("orphan_reason"))
