"""Changes between consecutive full snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical_row_hash(columns: Sequence[Column]) -> Column:
    """SHA-256 over ``columns``, 32 bytes; null is a value of its own and column borders count.

    Each column is hashed by itself first, so ("ab", "c") and ("a", "bc") differ, and a null can't collide with
    any text.
    """
    each = [F.coalesce(F.sha2(c.cast("binary"), 256), F.lit("null")) for c in columns]
    return F.unhex(F.sha2(F.concat_ws("|", *each), 256))


def snapshot_changes(
    df: DataFrame, version: str = "data_version", key: str = "uid", compared: Sequence[str] = ("headword", "payload"), loaded: str = "loaded_at"
) -> DataFrame:
    """``(version, key, change_kind)`` for every snapshot after the first, against the one just before.

    Method: full outer join on the key, comparing canonical row hashes; a missing side is an addition or a removal,
    unequal hashes are a change. Only 32 bytes of hash a row are shuffled, never the payload, and rows of one key and
    version are reduced before the shuffle, so a key that repeats without end costs one row a task.

    Defined cases: of several rows of a key in a snapshot the one loaded last stands (null load times lose, at a tie the
    greatest hash); a null key is one key of its own; rows with a null version belong to no snapshot and are left out;
    null differs from any value; other columns, whatever their names, don't count; an empty table gives no rows.
    """
    rows = df.filter(F.col(version).isNotNull()).select(
        F.col(version).alias("_v"), F.col(key).alias("_k"), F.col(loaded).alias("_t"), canonical_row_hash([F.col(c) for c in compared]).alias("_h")
    )
    latest = rows.groupBy("_v", "_k").agg(F.max(F.struct("_t", "_h")).alias("_m")).select("_v", "_k", F.col("_m._h").alias("_h"))
    # One row per delivered snapshot: the only unpartitioned window, over the list of versions and never over records.
    order = Window.orderBy("_v")
    versions = rows.select("_v").distinct().select("_v", F.lead("_v").over(order).alias("_next"), F.lag("_v").over(order).alias("_prev"))
    before = latest.join(versions.filter("_next IS NOT NULL").select("_v", "_next"), "_v").select(
        F.col("_next").alias("_bv"), F.col("_k").alias("_bk"), F.col("_h").alias("_bh")
    )
    after = latest.join(versions.filter("_prev IS NOT NULL").select("_v"), "_v", "left_semi")
    joined = after.join(before, (F.col("_v") == F.col("_bv")) & F.col("_k").eqNullSafe(F.col("_bk")), "full_outer")
    kind = (
        F.when(F.col("_bv").isNull(), "added").when(F.col("_v").isNull(), "removed").when(F.col("_h") != F.col("_bh"), "changed")
    )
    return joined.select(
        F.coalesce("_v", "_bv").alias(version), F.when(F.col("_v").isNull(), F.col("_bk")).otherwise(F.col("_k")).alias(key), kind.alias("change_kind")
    ).filter(F.col("change_kind").isNotNull())
