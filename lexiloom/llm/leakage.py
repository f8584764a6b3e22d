"""Evaluation texts that stand, wholly or partly, in corpus documents.

Prefix-filtered set join on word shingles. A passage of ``WINDOW`` words is the set of its ``WINDOW - SHINGLE + 1``
consecutive shingles, all of which a document must hold; so any one of them is necessary, and the rarest in the corpus is
the prefix that is joined. The place of the shingle in its passage and in the document bounds where the passage can
begin, and the words of that stretch are compared one by one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.session import durable, spread

WINDOW = 12
SHINGLE = 5
#: Bits of the filter that the corpus is read through, as a power of two: 16 MB in every worker, whatever the items. More item
#: shingles let more of the corpus through to the join, which is exact.
FILTER_BITS = 27

_WORDS = re.compile(r"[^\W_]+")
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(SHINGLE)], dtype=np.uint64)


@lru_cache(maxsize=4096)
def _shown(ch: str) -> str:
    """A character without what the comparison ignores: marks and signs that show nothing."""
    return "" if unicodedata.category(ch) in ("Mn", "Me", "Mc", "Cf") else ch


def plain_words(text: str | None) -> list[str]:
    """The runs of letters and digits, whatever their case, accents and width."""
    if not text:
        return []
    if not text.isascii():
        text = "".join(map(_shown, unicodedata.normalize("NFKD", text)))
        text = unicodedata.normalize("NFKD", text.casefold())
        if not text.isascii():
            text = "".join(map(_shown, text))
    return _WORDS.findall(text.casefold())


@lru_cache(maxsize=100_000)
def _word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def shingles(words: list[str]) -> np.ndarray:
    """The hash of each run of ``SHINGLE`` words, by the place of its first word."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    each = np.fromiter(map(_word_hash, words), dtype=np.uint64, count=len(words))
    out = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        out += each[k : k + n] * _POWERS[k]
    return out.view(np.int64)


_ITEM_SCHEMA = [("item_at", T.IntegerType()), ("hashes", T.ArrayType(T.LongType())), ("words", T.ArrayType(T.StringType()))]


def item_windows(items: DataFrame, key: str, text: str) -> DataFrame:
    """``(_item, item_at, hashes, words)``: every passage of ``WINDOW`` words of every item. Shorter items have none."""
    schema = T.StructType([T.StructField("_item", items.schema[key].dataType)] + [T.StructField(n, t) for n, t in _ITEM_SCHEMA])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = plain_words(one)
                hashes = shingles(words)
                n = len(words) - WINDOW + 1
                if n > 0:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([k] * n, batch.schema.field(0).type),
                            pa.array(range(n), pa.int32()),
                            pa.array([hashes[i : i + WINDOW - SHINGLE + 1] for i in range(n)], pa.list_(pa.int64())),
                            pa.array([words[i : i + WINDOW] for i in range(n)], pa.list_(pa.string())),
                        ],
                        schema.names,
                    )

    return items.select(F.col(key), F.col(text)).filter(F.col(text).isNotNull()).mapInArrow(cut, schema)


def shingle_filter(windows: DataFrame, bits: int) -> np.ndarray:
    """Which residues of a shingle's hash occur in the items, as ``2**bits`` bits: what reaches the driver is bounded by that."""
    residue = F.pmod(F.col("hash"), F.lit(1 << bits))
    words = (
        windows.select(F.explode("hashes").alias("hash"))
        .groupBy(F.shiftright(residue, 6).alias("at"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), residue.bitwiseAND(F.lit(63)).cast("int"))).alias("word"))
        .toPandas()
    )
    out = np.zeros(max(1, (1 << bits) >> 6), dtype=np.int64)
    out[words["at"].to_numpy(dtype=np.int64)] = words["word"].to_numpy(dtype=np.int64)
    return out.view(np.uint64)


def corpus_hits(docs: DataFrame, key: str, text: str, wanted: np.ndarray) -> DataFrame:
    """``(_doc, hash, n, at_word, words)`` in one narrow pass over the corpus.

    ``wanted`` is a ``shingle_filter``; what passes it without being wanted meets no row of the join that follows. Rows
    without document count the documents of a batch that hold such a shingle (``n``). Rows with document are the shingles
    in a stretch of at least ``WINDOW - SHINGLE + 1`` consecutive ones, which every passage
    makes, with the words around them that a passage could reach and the place
    ``at_word`` of the shingle among these.
    """
    schema = T.StructType([T.StructField("_doc", docs.schema[key].dataType), T.StructField("hash", T.LongType()), T.StructField("n", T.LongType()), T.StructField("at_word", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType()))])
    held = docs.sparkSession.sparkContext.broadcast(wanted)
    need = WINDOW - SHINGLE + 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        mask = np.uint64(len(known) * 64 - 1)
        for batch in batches:
            key_type = batch.schema.field(0).type
            in_batch: list[np.ndarray] = []
            rows: list[tuple] = []

            def flush() -> pa.RecordBatch:
                columns = list(zip(*rows)) or [()] * 5
                out = pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.list_(pa.string()))], schema.names)
                rows.clear()
                return out

            for k, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = plain_words(one)
                hashes = shingles(words)
                if not len(hashes):
                    continue
                residue = hashes.view(np.uint64) & mask
                hit = (known[residue >> np.uint64(6)] >> (residue & np.uint64(63)) & np.uint64(1)).astype(bool)
                if not hit.any():
                    continue
                in_batch.append(np.unique(hashes[hit]))
                # Lengths of the stretches of consecutive hits; a passage lies within one of at least ``need``.
                edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                for begin, end in zip(edges[::2], edges[1::2]):
                    if end - begin >= need:
                        for at in range(begin, end):
                            left = max(begin, at - need + 1)
                            rows.append((k, int(hashes[at]), None, int(at - left), words[left : at + WINDOW]))
                            if len(rows) >= 5_000:
                                yield flush()
            if in_batch:
                values, counts = np.unique(np.concatenate(in_batch), return_counts=True)
                rows += [(None, int(h), int(n), None, None) for h, n in zip(values, counts)]
            if rows:
                yield flush()

    rows = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text")).filter("_text IS NOT NULL AND _doc IS NOT NULL")
    return spread(rows).mapInArrow(scan, schema)


def leaked_items(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_key, item_key, n_passages)``: each document with each item of which it holds a passage of ``WINDOW`` words.

    ``n_passages`` is the number of different passages of the item found. The corpus is read once for any number of items,
    through a filter of fixed size. Documents and items with null key or text, and items of fewer words than a passage,
    give no rows; repeated rows and several items with one text each give what they hold; other columns don't matter.
    """
    windows = durable(item_windows(items, item_key, item_text).filter("_item IS NOT NULL"))
    hits = durable(corpus_hits(docs, doc_key, doc_text, shingle_filter(windows, FILTER_BITS)))
    found = _verified(hits, windows)
    return found.groupBy("_doc", "_item").agg(F.count_distinct("item_at").alias("n_passages")).select(F.col("_doc").alias(doc_key), F.col("_item").alias(item_key), "n_passages")


def _verified(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """``(_doc, _item, item_at)``: joins each passage's rarest shingle with the corpus and compares the words."""
    rarity = hits.filter("_doc IS NULL").groupBy("hash").agg(F.sum("n").alias("df"))
    placed = windows.select("_item", "item_at", "words", F.posexplode("hashes").alias("offset", "hash"))
    # A shingle the corpus doesn't hold can't be joined: such a passage is nowhere, and its prefix meets no row.
    ranked = placed.join(rarity, "hash", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    prefix = ranked.groupBy("_item", "item_at").agg(F.min(F.struct("df", "hash", "offset")).alias("_p"), F.first("words").alias("item_words"))
    prefix = prefix.select("_item", "item_at", "item_words", F.col("_p.hash").alias("hash"), F.col("_p.offset").alias("offset")).filter(F.col("_p.df") > 0)
    places = hits.filter("_doc IS NOT NULL").select("_doc", "hash", "at_word", F.col("words").alias("doc_words")).distinct()
    begin = F.col("at_word") - F.col("offset")
    # Positional bounds: the passage must begin at or after the first word kept, and all of its words must be there.
    fits = (begin >= 0) & (begin + WINDOW <= F.size("doc_words"))
    same = F.slice("doc_words", F.greatest(begin, F.lit(0)) + 1, WINDOW) == F.col("item_words")
    return places.join(prefix, "hash").filter(fits & same).select("_doc", "_item", "item_at")
