"""Tiers of a pack: the part of it that a budget allows, how much of what people read it covers, and its integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.ordered import grouped_places, with_running
from lexiloom.operators.rank import average_rank

#: Zipf value from which frequency alone decides the order of entry.
FREQUENCY_DECIDES = 2.0
#: Share of speakers from which a word counts as known.
KNOWN_BY_MOST = 50.0


def entry_order(lemmas: DataFrame, total: float) -> tuple[DataFrame, list[Column]]:
    """``lemmas`` with its ``band`` and the total order in which they enter a tier, most deserving first.

    ``lemmas``: ``norm, cost, best_rank, n`` (count in a corpus, may be null) and ``known`` (share of speakers, may be null).
    Bands: 0 frequent, 1 known to most, 2 any count, 3 nothing but the richness of the page.
    """
    n, known = F.coalesce("n", F.lit(0)), F.coalesce("known", F.lit(0.0))
    threshold = total * 10**FREQUENCY_DECIDES / 1e9
    band = F.when((n > 0) & (n >= F.lit(threshold)), 0).when(known >= KNOWN_BY_MOST, 1).when(n > 0, 2).otherwise(3)
    out = lemmas.withColumn("band", band)
    first = F.when(F.col("band") == 1, -known).when(F.col("band") == 3, F.col("best_rank").cast("double")).otherwise(-n.cast("double"))
    return out, [F.col("band"), first, F.when(F.col("band") == 1, -n).otherwise(0), F.col("norm")]


def within_budget(lemmas: DataFrame, order: list[Column], cost: Column, budget: float) -> DataFrame:
    """The lemmas before the first one that would overflow the budget; the first always gets in.

    Costs are positive, so the running total says where to stop. It is computed range by range (``with_running``).
    """
    rows = with_running(lemmas, order, {"running": cost}, place="place")
    return rows.filter((F.col("running") <= F.lit(budget)) | (F.col("place") == 0))


def coverage(vocabulary: DataFrame, frequencies: DataFrame) -> DataFrame:
    """One row: the percentage of running words (``tokens``) and of distinct words (``lemmas``) that the vocabulary holds."""
    flagged = frequencies.join(vocabulary.select("norm").distinct().withColumn("_in", F.lit(1)), "norm", "left")
    inside = F.sum(F.when(F.col("_in") == 1, F.col("n")).otherwise(0))
    return flagged.agg(F.round(inside / F.sum("n") * 100, 6).alias("tokens"), F.round(F.count("_in") / F.count("*") * 100, 6).alias("lemmas"))


def derive(vocabulary: DataFrame, entry: DataFrame, form: DataFrame, trans: DataFrame, discover: DataFrame) -> dict[str, DataFrame]:
    """The tables of a tier: what belongs to the vocabulary, with new dense ids in the order of the old ones.

    A lemma gets in with all its homographs or not at all. ``uid`` is copied, never made anew.
    """
    kept = entry.join(vocabulary.select("norm").distinct(), "norm", "left_semi")
    ids = with_running(kept.select("id"), [F.col("id")], {}, place="_p").select(F.col("id").alias("_old"), (F.col("_p") + 1).alias("_new"))
    renamed = lambda df: df.join(ids, F.col("entry_id") == F.col("_old")).drop("_old", "entry_id").withColumnRenamed("_new", "entry_id")
    return {
        "entry": kept.join(ids, F.col("id") == F.col("_old")).drop("_old", "id").withColumnRenamed("_new", "id"),
        "form": renamed(form),
        "trans": renamed(trans),
        "discover": grouped_places(renamed(discover.drop("seq")), ["tier", "pos_code"], ["entry_id"], "seq"),
    }


def next_budget(budget: float, size: float, target: float, low: float | None, high: float | None) -> float:
    """The budget to try after one that gave ``size``: the middle of what brackets the target, else in proportion."""
    if low is not None and high is not None:
        return (low + high) / 2
    return budget * target / max(size, 1e-9)


def budget_in_range(measure, low_size: float, high_size: float, start: float, rounds: int = 8) -> tuple[float, float]:
    """``(budget, size)`` whose tier's size falls between two bounds, aiming at their middle, in at most ``rounds`` tries.

    ``measure`` builds a tier for a budget and gives its size; each call is a job of its own and nothing else is kept.
    """
    target, low, high, budget = (low_size + high_size) / 2, None, None, start
    size = measure(budget)
    for _ in range(rounds - 1):
        if low_size <= size <= high_size:
            break
        low, high = (budget, high) if size < target else (low, budget)
        budget = next_budget(budget, size, target, low, high)
        size = measure(budget)
    return budget, size


def spearman(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: ``rho`` of two columns with mean ranks at ties, and ``n``."""
    ranked = average_rank(average_rank(pairs, a, "_ra"), b, "_rb")
    return ranked.agg(F.round(F.corr("_ra", "_rb"), 6).alias("rho"), F.count("*").alias("n"))


def rotated(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, value)`` with the values turned by half the table in the order of the key: the same data, unrelated."""
    placed = with_running(pairs.select(key, value), [F.col(key)], {}, place="_p")
    n = placed.count()
    half = n // 2
    return placed.select(key, "_p").join(placed.select(F.pmod(F.col("_p") - half, F.lit(max(n, 1))).alias("_p"), value), "_p").select(key, value)


def word_ngrams(texts: DataFrame, text: str, low: int = 2, high: int = 4) -> DataFrame:
    """``(ngram, n)``: sequences of ``low`` to ``high`` words and how often they occur."""
    words = texts.select(F.filter(F.split(text, "\\s+"), lambda w: w != "").alias("_w"))
    sized = words.select("_w", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("_n")).filter(F.size("_w") >= F.col("_n"))
    starts = sized.select("_w", "_n", F.explode(F.sequence(F.lit(1), F.size("_w") - F.col("_n") + 1)).alias("_s"))
    return starts.select(F.array_join(F.slice("_w", F.col("_s"), F.col("_n")), " ").alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n"))


def channel_counts(lines: DataFrame) -> DataFrame:
    """``(tag, n)``: lines of each tag; a tier must not lose one that its pack has."""
    return lines.groupBy("tag").agg(F.count("*").alias("n"))
