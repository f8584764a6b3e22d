"""How often every distinct term occurs and in how many records, kept up to date by signed deltas.

The counts live in a table partitioned by a hash of the term. A delivery is compared with the records already counted;
only what was added, changed or deleted becomes signed changes (+ for the new content, - for the old), which are reduced
to one row a term and merged into the partitions they touch. Cost follows the delivery, not the collection.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.session import durable

#: Terms of one bucket of the stored counts: a task's worth of rows.
TERMS_IN_BUCKET = 1_000_000
COUNT_SCHEMA = "src_field string, term string, n_occurrences bigint, n_records bigint"


@F.pandas_udf(T.StringType())
def compose(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFC of each text; null stays null. Spark has no such function."""
    for texts in batches:
        yield texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def composed(text: Column) -> Column:
    """NFC of a column; texts without characters beyond Latin-1, which are composed by definition, stay in the JVM."""
    plain = text.rlike("^[\\x00-\\xff]*$")
    return F.when(plain, text).otherwise(compose(F.when(~plain, text)))


def words(text: Column) -> Column:
    """The unbroken runs of letters of a composed text, in lower case; empty for null."""
    return F.transform(F.coalesce(F.regexp_extract_all(text, F.lit("(\\p{L}+)"), 1), F.array()), F.lower)


def term_rows(records: DataFrame, key: str, value_field: str, text_field: str, value: str = "norm", text: str = "texto", sign: Column | None = None) -> DataFrame:
    """``(src_field, term, d_occurrences, d_records)``: one row a term of each record, times ``sign``.

    Occurrences and records are both sums of rows of a record, so one map-side reduction serves both and no distinct count
    is needed.

    Defined cases: a null value is no term, an empty one is the empty term; a null or empty text has no words; a text of
    any length is read whole; columns other than the named ones are ignored; an empty table gives no rows.
    """
    sign = F.lit(1) if sign is None else sign
    base = records.select(F.col(value).alias("_value"), words(composed(F.col(text))).alias("_words"), sign.cast("bigint").alias("_sign"))
    whole = base.filter("_value IS NOT NULL").select(F.lit(value_field).alias("src_field"), F.col("_value").alias("term"), F.col("_sign").alias("d_occurrences"), F.col("_sign").alias("d_records"))
    # A word gives an occurrence each time and a record once; both meet in the same map-side reduction.
    every = F.transform("_words", lambda w: F.struct(w.alias("term"), F.lit(1).cast("bigint").alias("o"), F.lit(0).cast("bigint").alias("r")))
    once = F.transform(F.array_distinct("_words"), lambda w: F.struct(w.alias("term"), F.lit(0).cast("bigint").alias("o"), F.lit(1).cast("bigint").alias("r")))
    inside = base.select(F.explode(F.concat(every, once)).alias("_t"), "_sign").select(
        F.lit(text_field).alias("src_field"), F.col("_t.term").alias("term"), (F.col("_t.o") * F.col("_sign")).alias("d_occurrences"), (F.col("_t.r") * F.col("_sign")).alias("d_records")
    )
    return whole.unionByName(inside)


def latest_records(rows: DataFrame, key: str = "frase_id", content: tuple[str, ...] = ("norm", "texto"), loaded: str = "loaded_at") -> DataFrame:
    """One row for each record, of the delivery loaded last; at a tie the greatest content. Rows with a null key are no records."""
    held = F.struct(F.col(loaded), *[F.col(c) for c in content])
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(held).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in content])


def signed_records(before: DataFrame, after: DataFrame, key: str = "frase_id", content: tuple[str, ...] = ("norm", "texto"), deletes: bool = False) -> DataFrame:
    """``(key, *content, sign)``: what a delivery takes away from the counted records and what it adds.

    ``before`` are the records counted so far, ``after`` the delivered ones, both with one row a key. A record of equal
    content gives nothing; a changed one gives its old content with -1 and its new one with +1. With ``deletes`` the
    delivery is complete, so a record that is missing from it gives -1.
    """
    old = before.select(F.col(key).alias("_ok"), F.struct(*content).alias("_old"))
    new = after.select(F.col(key).alias("_nk"), F.struct(*content).alias("_new"))
    both = old.join(new, F.col("_ok") == F.col("_nk"), "full_outer" if deletes else "right")
    moved = both.filter(F.col("_ok").isNull() | F.col("_nk").isNull() | ~F.col("_old").eqNullSafe(F.col("_new")))
    minus = F.when(F.col("_ok").isNotNull(), F.struct(F.col("_ok").alias("k"), F.col("_old").alias("c"), F.lit(-1).alias("sign")))
    plus = F.when(F.col("_nk").isNotNull(), F.struct(F.col("_nk").alias("k"), F.col("_new").alias("c"), F.lit(1).alias("sign")))
    one = moved.select(F.explode(F.array_compact(F.array(minus, plus))).alias("_s"))
    return one.select(F.col("_s.k").alias(key), *[F.col(f"_s.c.{c}").alias(c) for c in content], F.col("_s.sign").alias("sign"))


class TermCounts:
    """Counts of terms in a folder that later sessions take up again.

    ``data/v=V/bucket=B`` holds the terms of a bucket as version V left them, ``manifest/v=V`` a row a bucket with the
    version in force and the number of buckets. A version is in force once its manifest is complete, which is written last
    (the success marker of its folder says so): a run that is lost before leaves the last complete version in force, and the
    next run writes over what it left. ``apply`` rewrites only the buckets that a delivery touches.

    ``buckets`` counts for a new folder only; by default there is one for each ``TERMS_IN_BUCKET`` terms of the first
    delivery. ``rebucket`` changes it. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.version, self.buckets = spark, path, 0, buckets
        self.manifest: dict[int, int] = {}
        complete = [v for v in self._versions("manifest") if self._exists(f"{path}/manifest/v={v}/_SUCCESS")]
        if complete:
            self.version = max(complete)
            rows = spark.read.schema("bucket int, version int, buckets int").parquet(f"{path}/manifest/v={self.version}").collect()  # a row a bucket
            self.buckets = rows[0].buckets
            self.manifest = {r.bucket: r.version for r in rows if r.bucket >= 0}

    def _system(self, path: str):
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        folder, system = self._system(path)
        return system.exists(folder)

    def _numbered(self, path: str, name: str) -> list[int]:
        """The numbers of the folders ``name=number`` in a folder."""
        folder, system = self._system(path)
        if not system.exists(folder):
            return []
        names = [f.getPath().getName() for f in system.listStatus(folder)]
        return [int(n.removeprefix(f"{name}=")) for n in names if n.startswith(f"{name}=")]

    def _versions(self, part: str) -> list[int]:
        return self._numbered(f"{self.path}/{part}", "v")

    def counts(self) -> DataFrame:
        """``(src_field, term, n_occurrences, n_records)`` of all terms."""
        return self._read(sorted(self.manifest))

    def _read(self, buckets: list[int]) -> DataFrame:
        at = [f"{self.path}/data/v={self.manifest[b]}/bucket={b}" for b in buckets]
        if not at:
            return self.spark.createDataFrame([], COUNT_SCHEMA)
        return self.spark.read.schema(COUNT_SCHEMA).parquet(*at)

    def _commit(self, kept: DataFrame, touched: list[int]) -> None:
        """Writes the rows of the touched buckets as a new version and puts it in force."""
        version = self.version + 1
        # Several tasks share a bucket where there are fewer buckets than tasks; each then writes a file of it.
        tasks = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        salt = F.pmod(F.shiftright(F.xxhash64("src_field", "term"), 40), F.lit(max(1, tasks // len(touched)))).cast("int")
        spread = kept.withColumn("_salt", salt).repartition(min(tasks, len(touched) * max(1, tasks // len(touched))), "bucket", "_salt").drop("_salt")
        spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={version}")
        # A bucket that lost all its terms has no folder.
        written = self._numbered(f"{self.path}/data/v={version}", "bucket")
        manifest = {b: v for b, v in self.manifest.items() if b not in set(touched)} | {b: version for b in written}
        rows = [(b, v, self.buckets) for b, v in sorted(manifest.items())] or [(-1, 0, self.buckets)]
        self.spark.createDataFrame(rows, "bucket int, version int, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={version}")
        self.version, self.manifest = version, manifest

    def _with_bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("src_field", "term"), F.lit(self.buckets)).cast("int"))

    def apply(self, signed_terms: DataFrame) -> None:
        """Merges signed rows as ``term_rows`` gives them; terms whose counts come to nothing leave the table."""
        sums = [F.sum(f"d_{n}").alias(f"n_{n}") for n in ("occurrences", "records")]
        some = "n_occurrences <> 0 OR n_records <> 0"
        delta = durable(signed_terms.groupBy("src_field", "term").agg(*sums).filter(some))
        if self.buckets is None:
            self.buckets = max(1, -(-delta.count() // TERMS_IN_BUCKET))
        delta = self._with_bucket(delta)
        touched = list(range(self.buckets)) if not self.manifest else sorted(r.bucket for r in delta.select("bucket").distinct().collect())
        if not touched or not self.manifest and delta.isEmpty():
            return
        if not self.manifest:
            return self._commit(delta, touched)
        stored = self._with_bucket(self._read([b for b in touched if b in self.manifest]))
        merged = stored.unionByName(delta).groupBy("bucket", "src_field", "term").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records"))
        self._commit(merged.filter(some), touched)

    def rebucket(self, buckets: int) -> None:
        """Rewrites the whole table in another number of buckets."""
        before = durable(self.counts())
        self.buckets, self.manifest = buckets, {}
        self._commit(self._with_bucket(before), list(range(buckets)))


def marked(counts: DataFrame, n_records: int, rare_below: int = 3, common_share: float = 0.05) -> DataFrame:
    """``counts`` with ``mark``: ``rare`` in fewer than ``rare_below`` records, ``common`` in more than that share of all, else null."""
    many = F.col("n_records") > F.lit(n_records) * F.lit(common_share)
    return counts.withColumn("mark", F.when(F.col("n_records") < rare_below, "rare").when(many, "common"))
