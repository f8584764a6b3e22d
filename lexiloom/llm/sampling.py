"""A reproducible sample that only ever grows.

Epoch-rate selection. A record's first-seen epoch is kept in a ledger together with the rate that was in force in that
epoch, and never changes again. A counter-based generator keyed by the identifier gives the record's draw; the record is
chosen if its draw lies below its own frozen rate. So reruns, other partitionings and repeated rows choose the same
records, and records that come later can lower the rate only for themselves.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the published generator Threefry-2x32 (20 rounds): rotations, key parity constant.
ROTATIONS = (13, 15, 26, 6, 17, 29, 16, 24)
PARITY = 0x1BD11BDA
MASK = 0xFFFFFFFF


def threefry2x32(key: tuple[Column, Column], counter: tuple[int, int]) -> Column:
    """64 random bits, as a struct of two 32-bit words, from a two-word key and a counter.

    Words are non-negative bigints below 2**32. The rounds are a fold over their constants, so the expression has the
    size of one round, is evaluated in the JVM and can be pushed about by the optimizer without growing.
    """
    add = lambda a, b: (a + b).bitwiseAND(F.lit(MASK))
    long = lambda v: F.lit(v).cast("bigint")

    def mixed(k: Column) -> Column:
        ks = [k["k0"], k["k1"], long(PARITY).bitwiseXOR(k["k0"]).bitwiseXOR(k["k1"])]
        rounds = []
        for r in range(20):
            s = r // 4 + 1
            after = (ks[s % 3], add(ks[(s + 1) % 3], long(s))) if r % 4 == 3 else (long(0), long(0))
            rounds.append(F.struct(F.lit(ROTATIONS[r % 8]).alias("left"), F.lit(32 - ROTATIONS[r % 8]).alias("right"), after[0].alias("a"), after[1].alias("b")))
        start = F.struct(add(long(counter[0]), ks[0]).alias("hi"), add(long(counter[1]), ks[1]).alias("lo"))

        def one(x: Column, r: Column) -> Column:
            sum_ = add(x["hi"], x["lo"])
            turned = F.call_function("shiftleft", x["lo"], r["left"]).bitwiseAND(F.lit(MASK)).bitwiseOR(F.call_function("shiftrightunsigned", x["lo"], r["right"]))
            return F.struct(add(sum_, r["a"]).alias("hi"), add(turned.bitwiseXOR(sum_), r["b"]).alias("lo"))

        return F.aggregate(F.array(*rounds), start, one)

    # The array of one binds the key words to a variable, so what computes them is evaluated once.
    return F.element_at(F.transform(F.array(F.struct(key[0].alias("k0"), key[1].alias("k1"))), mixed), 1)


def with_draw(df: DataFrame, identifiers: Sequence[str], seed: int = 0, draw: str = "draw") -> DataFrame:
    """``df`` with ``draw`` in [0, 1): 53 bits of the generator keyed by the identifier columns, counter ``(seed, 0)``.

    The key is the first 64 bits of SHA-256 over the identifiers, in which a null is a value of its own.
    """
    each = [F.coalesce(F.sha2(F.col(c).cast("string").cast("binary"), 256), F.lit("null")) for c in identifiers]
    digest = F.sha2(F.concat_ws("|", *each), 256)
    words = F.transform(F.array(digest), lambda d: F.struct(_word(d, 1).alias("k0"), _word(d, 9).alias("k1")))
    bits = F.transform(words, lambda w: threefry2x32((w["k0"], w["k1"]), (seed & MASK, 0)))
    value = F.transform(bits, lambda b: (b["hi"] * F.lit(2**21) + F.shiftrightunsigned(b["lo"], 11)) / F.lit(float(2**53)))
    return df.withColumn(draw, F.element_at(value, 1))


def _word(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")


def rate_of(epoch: Column, rates: Mapping[str, float], default: float) -> Column:
    """The rate in force in an epoch: of the latest step of ``rates`` (first epoch -> rate) not after it, else ``default``.

    A null epoch sorts before every other.
    """
    value = F.lit(float(default))
    for start in sorted(rates):
        value = F.when(epoch >= F.lit(start), F.lit(float(rates[start]))).otherwise(value)
    return value


def first_seen(df: DataFrame, identifiers: Sequence[str], epoch: str, rates: Mapping[str, float], default: float) -> DataFrame:
    """A new ledger from a whole history: ``(*identifiers, first_epoch, rate)``, one row for each record.

    Rows of one record are reduced to the earliest epoch before the shuffle, so a record that repeats without end costs
    a row a task. Records with null identifiers are records like others; a record whose epochs are all null has the
    default rate; other columns are ignored; an empty table gives an empty ledger.
    """
    ids = [F.col(c) for c in identifiers]
    ledger = df.groupBy(*ids).agg(F.min(epoch).alias("first_epoch"))
    return ledger.withColumn("rate", rate_of(F.col("first_epoch"), rates, default))


def extend_ledger(ledger: DataFrame, batch: DataFrame, identifiers: Sequence[str], epoch: str, rate: float) -> DataFrame:
    """The ledger rows that a new delivery adds: its records the ledger doesn't hold, with this epoch and its rate.

    Append them to the stored ledger; nothing that is in it is rewritten, also if the delivery repeats old records.
    """
    fresh = batch.select(*identifiers).distinct().alias("b")
    held = ledger.select(*identifiers).alias("l")
    same = None
    for c in identifiers:
        one = F.col(f"b.{c}").eqNullSafe(F.col(f"l.{c}"))
        same = one if same is None else same & one
    return fresh.join(held, same, "left_anti").select(*identifiers, F.lit(epoch).alias("first_epoch"), F.lit(float(rate)).alias("rate"))


class Ledger:
    """A ledger in a folder, one subfolder a delivery; a delivery that is run again writes over its own subfolder only.

    So a retry, also in another session and after later deliveries, adds nothing twice and changes no other record.
    """

    def __init__(self, spark: SparkSession, path: str, identifiers: Sequence[str]):
        self.spark, self.path, self.identifiers = spark, path, list(identifiers)

    def _schema(self, df: DataFrame) -> T.StructType:
        ids = [T.StructField(c, df.schema[c].dataType) for c in self.identifiers]
        return T.StructType([*ids, T.StructField("first_epoch", T.StringType()), T.StructField("rate", T.DoubleType()), T.StructField("delivery", T.StringType())])

    def begin(self, history: DataFrame, epoch: str, rates: Mapping[str, float], default: float) -> None:
        """The first delivery: a whole history, each record with the rate of its first epoch."""
        self._write(first_seen(history, self.identifiers, epoch, rates, default), "history")

    def extend(self, batch: DataFrame, epoch: str, rate: float) -> None:
        """A later delivery: its records that no other delivery holds, with its epoch and rate."""
        others = self.spark.read.schema(self._schema(batch)).parquet(self.path).filter(F.col("delivery") != self._name(epoch))
        self._write(extend_ledger(others, batch, self.identifiers, epoch, rate), self._name(epoch))

    def records(self) -> DataFrame:
        """``(*identifiers, first_epoch, rate)`` of every record."""
        return self.spark.read.parquet(self.path).select(*self.identifiers, "first_epoch", "rate")

    @staticmethod
    def _name(epoch: str) -> str:
        return f"epoch {epoch}"

    def _write(self, rows: DataFrame, delivery: str) -> None:
        rows.withColumn("first_epoch", F.col("first_epoch").cast("string")).write.mode("overwrite").parquet(f"{self.path}/delivery={delivery}")


def choose(ledger: DataFrame, identifiers: Sequence[str], seed: int = 0) -> DataFrame:
    """The chosen records of a ledger, with ``first_epoch``, ``rate`` and ``draw``: a narrow step without shuffle."""
    return with_draw(ledger, identifiers, seed).filter(F.col("draw") < F.col("rate"))
