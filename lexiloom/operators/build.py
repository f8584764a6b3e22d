"""From staging records to the tables of a pack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as X
from lexiloom.operators import lexicon as L
from lexiloom.operators import payload as B
from lexiloom.operators.ordered import with_running
from lexiloom.operators.search import postings
from lexiloom.session import durable

TRANS_CAP = 50


def build_pack(records: DataFrame, meta: dict[str, str], trans_cap: int = TRANS_CAP) -> dict[str, DataFrame]:
    """``entry form trans posting meta`` of a pack.

    ``records``: ``headword, pos, lang, rank, senses (struct<gloss, labels, examples<text, ref>, translations, synonyms,
    antonyms, related>), forms, translations``. Records that share headword and part of speech are told apart by their
    place; entries get dense ids by rank, headword, part of speech and that place. Records without a sense that shows
    anything are left out, the same record delivered twice counts once. Staging is written once, since every table reads it.
    """
    source = records.filter(F.length(X.norm(F.col("headword"))) > 0).withColumn("_all", F.to_json(F.struct("senses", "forms", "translations")))
    rows = source.groupBy("lang", "headword", "pos", "_all").agg(F.min("rank").alias("rank"), F.first("senses").alias("senses"), F.first("forms").alias("forms"), F.first("translations").alias("translations"))
    keyed = L.homographs(rows, "lang", "headword", "pos", key="_all")
    placed = with_running(keyed, [F.col("rank"), F.col("headword"), F.col("pos").asc_nulls_first(), F.col("lang"), F.col("sense_key"), F.col("_all")], {}, place="_p")
    key = X.norm(F.col("headword"))
    staged = placed.select(
        (F.col("_p") + 1).alias("id"), X.stable_uid(F.col("lang"), F.col("headword"), F.col("pos"), F.col("sense_key")).alias("uid"), "lang", "headword", key.alias("norm"),
        X.fuzzy(key, F.col("lang")).alias("fuzzy"), "pos", "rank", "senses", "forms", "translations",
    )
    senses = staged.select("id", F.posexplode("senses").alias("sense", "s")).select("id", "sense", "s.*")
    bodies = B.render_senses(B.merge_duplicate_senses(senses))
    texts = B.search_text(senses).select("id", "fts_body")
    staging = durable(staged.join(bodies, "id").join(texts, "id"))
    shared = L.colliding(staging, "uid", F.col("headword")).limit(5).collect()
    if shared:
        raise ValueError(f"entries share an id: {', '.join(r.examples for r in shared)}")
    form = staging.select(F.explode(F.transform("forms", X.norm)).alias("norm"), F.col("id").alias("entry_id"), F.col("norm").alias("_own")).filter("norm <> '' AND norm <> _own").select("norm", "entry_id").distinct()
    terms = staging.select(F.explode("translations").alias("_t"), F.col("id").alias("entry_id"), "rank").select(F.explode(L.translation_keys(X.norm(F.col("_t")))).alias("norm"), "entry_id", "rank").distinct()
    entry = staging.select("id", "uid", "lang", "headword", "norm", "fuzzy", "pos", "rank", B.deflate(F.col("body")).alias("payload"))
    held = meta | {"entry_count": str(staging.count())}
    return {
        "entry": entry,
        "form": form,
        "trans": L.capped(terms, "norm", "rank", "entry_id", trans_cap).select("norm", "entry_id"),
        "posting": postings(staging.select("id", X.norm(F.col("fts_body")).alias("_w")), "id", "_w"),
        "meta": records.sparkSession.createDataFrame(sorted(held.items()), "key string, value string"),
    }
