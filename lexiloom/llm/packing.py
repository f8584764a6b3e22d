"""Packing texts of varying length into containers of fixed capacity.

What is packed is the histogram of lengths, never the texts: it has at most ``capacity`` rows whatever the size of the
corpus, so the plan is made on the driver and the texts are then dealt out to it by rank, without meeting each other.

Exact-complement hashing: the single, pair and triple sums of the available lengths are indexed; a container is opened
with the longest piece left and closed by the single, pair or triple that exactly fills the gap, as often as the counts
of all its lengths allow. Gaps too wide for three pieces are first filled with the longest piece that leaves a gap again;
gaps without exact complement are filled best-fit.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.session import durable, spread

#: Where the public vocabularies lie; a parameter of ``token_lengths``.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the published split pattern of the byte-level BPE vocabularies.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of one length that are ranked in one task; longer lists are spread over more salts.
RANK_ROWS = 500_000

_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a vocabulary file, made once in each worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_lengths(df: DataFrame, text: str, out: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with the number of tokens of each whole text; null counts as empty. Only a number leaves Python."""

    @F.pandas_udf(T.IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(vocabulary)
        for texts in batches:
            yield pd.Series([0 if t is None else len(own.encode_ordinary(t)) for t in texts], dtype="int32")

    return df.withColumn(out, count(F.col(text)))


class ComplementIndex:
    """Counts of lengths with the questions "which one, two or three available lengths sum to exactly this?"."""

    def __init__(self, counts: Mapping[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.capacity = capacity
        #: pair sum -> the larger members that made it when last looked at; entries are checked before use.
        self.pair_hint: dict[int, int] = {}

    def longest(self, at_most: int) -> int:
        found = np.flatnonzero(self.left[: at_most + 1])
        return int(found[-1]) if len(found) else 0

    def pair(self, total: int, without: int = 0) -> tuple[int, int] | None:
        """The pair with the longest larger member; ``without`` is a length of which one piece is spoken for."""
        if total < 2:
            return None
        have = self.left[: total].copy()
        if 0 < without < total:
            have[without] -= 1
        hint = self.pair_hint.get(total)
        if hint is not None and have[hint] > 0 and have[total - hint] > (hint == total - hint):
            return hint, total - hint
        larger = np.arange(total - 1, (total - 1) // 2, -1)
        larger = larger[larger >= total - larger]
        fits = (have[larger] > 0) & (have[total - larger] > (larger == total - larger))
        where = np.flatnonzero(fits)
        if not len(where):
            return None
        a = int(larger[where[0]])
        self.pair_hint[total] = a
        return a, total - a

    def exact(self, total: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that sum to ``total``, fewest and longest first."""
        if self.left[total] > 0:
            return (total,)
        two = self.pair(total)
        if two:
            return two
        for a in np.flatnonzero(self.left[: total - 1])[::-1]:
            if a * 3 < total:
                break
            two = self.pair(total - int(a), without=int(a))
            if two:
                return (int(a), *two)
        return None


def plan_containers(counts: Mapping[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths in a container, number of such containers)`` for a histogram of lengths from 1 to ``capacity``.

    Every piece is used once and no container holds more than ``capacity``. A pattern is repeated until one of its
    lengths ``l`` has fewer pieces left than it needs, at most ``capacity / l``; so the number of patterns is bounded by
    the sum of ``1 + capacity / l``, whether there are a few texts or billions.
    """
    index = ComplementIndex(counts, capacity)
    plan: list[tuple[tuple[int, ...], int]] = []
    while True:
        first = index.longest(capacity)
        if not first:
            return plan
        pieces = [first]
        index.left[first] -= 1
        gap = capacity - first
        while gap:
            three = index.longest(gap)
            # A complement of three can't close a gap wider than three of the longest piece that fits.
            closing = index.exact(gap) if three and gap <= 3 * three else None
            chosen = closing or ((three,) if three else ())
            if not chosen:
                break
            for length in chosen:
                index.left[length] -= 1
            pieces += chosen
            gap -= sum(chosen)
        lengths, used = np.unique(pieces, return_counts=True)
        times = 1 + int((index.left[lengths] // used).min())
        index.left[lengths] -= used * (times - 1)
        plan.append((tuple(sorted(pieces, reverse=True)), times))


def slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, first_rank, end_rank, copies, first_container, offset)``: which ranks of a length go where."""
    taken: dict[int, int] = {}
    out, container = [], 0
    for pieces, times in plan:
        offset = 0
        for length in sorted(set(pieces), reverse=True):
            copies = pieces.count(length)
            begin = taken.get(length, 0)
            out.append((length, begin, begin + copies * times, copies, container, offset))
            taken[length] = begin + copies * times
            offset += copies * length
        container += times
    return out


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(key, piece, token_from, token_to, n_tokens, container_id, container_offset)``: every text, dealt to containers.

    A text of up to ``capacity`` tokens is one piece; a longer one is cut into full containers and a rest, which is packed
    like any other. An empty or null text has no tokens and takes no room: it is one piece of 0 tokens in a container
    chosen by its key. Which of several texts of one length comes where follows from a hash of the key, so reruns agree;
    rows that repeat a key are separate texts.

    A length that a third of all texts share is ranked in as many salts as it needs: counts per length and salt give
    each salt its first rank. Nothing is collected but the histogram (at most ``capacity`` rows a salt).
    """
    spark = df.sparkSession
    sized = durable(token_lengths(spread(df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))), "_text", "_n", vocabulary).select("_key", "_n"))
    cut = F.floor((F.greatest(F.col("_n"), F.lit(1)) - 1) / capacity).cast("int")
    pieces = sized.select("_key", "_n", F.explode(F.sequence(F.lit(0), cut)).alias("_piece")).withColumn("_len", F.least(F.lit(capacity), F.col("_n") - F.col("_piece") * capacity).cast("int"))
    histogram = {r._len: r.n for r in pieces.groupBy("_len").agg(F.count("*").alias("n")).collect()}
    histogram.pop(0, None)
    plan = plan_containers(histogram, capacity)
    containers = max(1, sum(times for _, times in plan))
    # Salts by length, from the histogram: a bounded table that holds a row a length and salt.
    widths = [(length, max(1, -(-n // RANK_ROWS))) for length, n in sorted(histogram.items())]
    salted = pieces.filter("_len > 0").join(F.broadcast(_frame(spark, widths, "_len int, _salts int")), "_len")
    order = F.xxhash64("_key", "_piece")
    salted = salted.withColumn("_h", order).withColumn("_salt", F.pmod(F.shiftright("_h", 32), F.col("_salts")).cast("int"))
    sizes = salted.groupBy("_len", "_salt").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("_len").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("_len", "_salt", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    ranked = salted.withColumn("_r", F.row_number().over(Window.partitionBy("_len", "_salt").orderBy("_h", "_key", "_piece")) - 1)
    ranked = ranked.join(firsts, ["_len", "_salt"]).withColumn("_rank", F.col("_base") + F.col("_r"))
    # The plan's slots: at most one row for each pattern and length in it, both bounded by the capacity.
    table = _frame(spark, slots(plan), "_len int, _begin bigint, _end bigint, _copies bigint, _container bigint, _offset bigint")
    per_length = table.groupBy("_len").agg(F.sort_array(F.collect_list(F.struct("_begin", "_end", "_copies", "_container", "_offset"))).alias("_slots"))
    placed = ranked.join(F.broadcast(per_length), "_len").withColumn("_slot", F.element_at(F.filter("_slots", lambda s: s["_begin"] <= F.col("_rank")), -1))
    step = F.col("_rank") - F.col("_slot._begin")
    full = placed.select(
        "_key", "_piece", "_len",
        (F.col("_slot._container") + F.floor(step / F.col("_slot._copies"))).cast("bigint").alias("_at"),
        (F.col("_slot._offset") + (step % F.col("_slot._copies")) * F.col("_len")).cast("int").alias("_off"),
    )
    none = pieces.filter("_len = 0").select("_key", "_piece", "_len", F.pmod(F.xxhash64("_key"), F.lit(containers)).cast("bigint").alias("_at"), F.lit(0).alias("_off"))
    start = (F.col("_piece") * capacity).cast("int")
    return full.unionByName(none).select(
        F.col("_key").alias(key), F.col("_piece").alias("piece"), start.alias("token_from"), (start + F.col("_len")).alias("token_to"), F.col("_len").alias("n_tokens"),
        F.col("_at").alias("container_id"), F.col("_off").alias("container_offset"),
    )


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
