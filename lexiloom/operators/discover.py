"""Pools of words to come across: filters over a whole pack, draws without repetition, the word of a day."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.operators.lexicon import kept_participles, richest
from lexiloom.operators.ordered import grouped_places

COMMON = 0
DRAW = 20
CANDIDATES = 96
RANK_FLOOR = 150
CATEGORY_PASS, TIER_PASS = -1, -2
# Parts of speech that are no word of a day, and the four that take turns.
EXCLUDED = ("name", "proper noun", "prefix", "suffix", "abbrev", "num")
ROTATION = ("noun", "verb", "adj", "adv")
# Fixed values of FNV-1a (64 bits) and of the splitmix64 finalizer.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_64 = (1 << 64) - 1


def day_seed(date: str, pack_id: str, turn: int) -> int:
    """The signed 64-bit seed of a date, pack and pass."""
    h = FNV_BASIS
    for unit in (*map(ord, date), 0x7C, *map(ord, pack_id), turn & _64):
        h = ((h ^ unit) * FNV_PRIME) & _64
    h = ((h ^ (h >> 30)) * MIX_1) & _64
    h = ((h ^ (h >> 27)) * MIX_2) & _64
    h ^= h >> 31
    return h - (1 << 64) if h >> 63 else h


@F.pandas_udf(T.LongType())
def day_seed_udf(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for dates, packs, turns in batches:
        yield pd.Series([day_seed(d, p, int(t)) for d, p, t in zip(dates, packs, turns)], dtype="int64")


def discover_rows(staging: DataFrame, form: DataFrame, boundary: int | None, endings: str) -> DataFrame:
    """``(tier, pos_code, seq, entry_id)``: the pools of a pack.

    Left out: participles that are forms of another verb; every row but those of the common tier for a headword that is
    common; and, below the rank ``boundary`` where a rank belongs to the word's surface, all but the richest entry of a
    headword and tier. ``seq`` is dense, so a pool's size is its largest ``seq`` plus one.
    """
    rows = staging.filter("discover IS NOT NULL")
    rows = rows.join(kept_participles(staging, form, endings), "id", "left_anti")
    common = rows.filter(F.col("discover") == COMMON).select("headword").distinct()
    rows = rows.filter(F.col("discover") == COMMON).unionByName(rows.filter(F.col("discover") != COMMON).join(common, "headword", "left_anti"))
    if boundary is not None:
        best = richest(staging.filter("discover IS NOT NULL"), ["headword", "discover"], F.length("body")).select("id", F.lit(True).alias("_best"))
        rows = rows.join(best, "id", "left").filter((F.col("rank") >= boundary) | F.col("_best")).drop("_best")
    coded = rows.withColumn("pos_code", F.when(F.lower("pos").rlike("^(noun|sust|subst|nom|сущ|ουσ)"), 0).when(F.lower("pos").rlike("^(verb|глаг|ρήμα)"), 1).otherwise(2))
    slim = coded.select(F.col("discover").alias("tier"), "pos_code", F.col("id").alias("entry_id"))
    # There are few pools and all of them are large, so their places are counted over ranges and not by pool.
    return grouped_places(slim, ["tier", "pos_code"], ["entry_id"], "seq").select("tier", "pos_code", "seq", "entry_id")


def pools(discover: DataFrame) -> DataFrame:
    """``(tier, pos_code, size, dense)``: the pools' sizes, and whether their ``seq`` has no holes."""
    sized = discover.groupBy("tier", "pos_code").agg((F.max("seq") + 1).alias("size"), F.count("*").alias("_n"))
    return sized.select("tier", "pos_code", "size", (F.col("size") == F.col("_n")).alias("dense"))


def draw(discover: DataFrame, seen: DataFrame, tier: int, seed: int, size: int = DRAW) -> DataFrame:
    """``(tier, pos_code, seq, entry_id, restarted)``: ``size`` rows of a tier without repetition, unseen ones first.

    The order is a hash of the row and the seed, so a draw is repeatable, and it is one top-k over the pool. Seen rows
    come only when the unseen ones don't fill the draw; ``restarted`` says that they did.
    """
    mark = seen.select("tier", "pos_code", "seq").distinct().withColumn("_seen", F.lit(1))
    rows = discover.filter(F.col("tier") == tier).join(mark, ["tier", "pos_code", "seq"], "left")
    picked = rows.orderBy(F.coalesce("_seen", F.lit(0)), F.xxhash64(F.lit(seed), "tier", "pos_code", "seq"), "pos_code", "seq").limit(size)
    return picked.select("tier", "pos_code", "seq", "entry_id", (F.coalesce("_seen", F.lit(0)) == 1).alias("restarted"))


def words_of_days(spark: SparkSession, entry: DataFrame, dates: Sequence[str], pack_id: str, entry_count: int, by_frequency: bool = False) -> DataFrame:
    """``(date, entry_id, headword, pos, rank)``: one word a day.

    Each date draws ``CANDIDATES`` ids; the best rank wins in this order of preference: the category of the day (packs
    ranked by richness only), any admissible word, one below the rank floor (packs ranked by frequency), any word.
    """
    if entry_count <= 0 or not dates:
        return spark.createDataFrame([], "date string, entry_id bigint, headword string, pos string, rank int")
    turns = spark.createDataFrame([(d, t) for d in dates for t in range(CATEGORY_PASS, CANDIDATES)], "date string, turn int")
    seeded = turns.withColumn("_seed", day_seed_udf("date", F.lit(pack_id), "turn"))
    category = seeded.filter(F.col("turn") == CATEGORY_PASS).select("date", F.element_at(F.array(*map(F.lit, ROTATION)), (F.pmod("_seed", F.lit(len(ROTATION))) + 1).cast("int")).alias("_category"))
    ids = seeded.filter("turn >= 0").select("date", "turn", (F.pmod("_seed", F.lit(entry_count)) + 1).alias("id"))
    met = ids.join(entry.select("id", "headword", "pos", "rank"), "id").join(category, "date")
    floor = RANK_FLOOR if by_frequency else 0
    excluded = F.coalesce(F.col("pos").isin(*EXCLUDED), F.lit(False))
    wanted = F.lit(not by_frequency) & (F.col("pos") == F.col("_category"))
    preference = F.when(excluded, 3).when(F.col("rank") < floor, 2).when(F.coalesce(wanted, F.lit(False)), 0).otherwise(1)
    best = met.groupBy("date").agg(F.min(F.struct(preference.alias("p"), "rank", "turn", "id", "headword", "pos")).alias("_m"))
    return best.select("date", F.col("_m.id").alias("entry_id"), "_m.headword", "_m.pos", "_m.rank")


def tier_words(spark: SparkSession, discover: DataFrame, dates: Sequence[str], pack_id: str, tier: int) -> DataFrame:
    """``(date, tier, pos_code, seq, entry_id)``: one row of a tier a day; a pool is drawn as often as it is large."""
    sizes = pools(discover).filter(F.col("tier") == tier)
    upto = Window.partitionBy("tier").orderBy("pos_code").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sizes.select("tier", "pos_code", "size", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("_from"), F.sum("size").over(Window.partitionBy("tier")).alias("_total"))
    days = spark.createDataFrame([(d, tier) for d in dates], "date string, tier int").withColumn("_seed", day_seed_udf("date", F.lit(pack_id), F.lit(TIER_PASS)))
    drawn = days.join(ranges, "tier").withColumn("_k", F.pmod("_seed", "_total") - F.col("_from")).filter((F.col("_k") >= 0) & (F.col("_k") < F.col("size")))
    return drawn.select("date", "tier", "pos_code", F.col("_k").cast("int").alias("seq")).join(discover, ["tier", "pos_code", "seq"])
