"""A pack from a dump to a search, end to end."""

import json

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import build, search
from lexiloom.operators import payload as B
from lexiloom.sources import dumps, packs

DUMP = [
    {"word": "correr", "pos": "verb", "senses": [{"glosses": ["Ir deprisa."]}, {"glosses": ["ir deprisa"]}, {"glosses": ["Fluir"]}], "forms": [{"form": "corriendo"}, {"form": "corrí"}], "translations": [{"word": "to run", "code": "en"}]},
    {"word": "banco", "pos": "noun", "senses": [{"glosses": ["Asiento"]}], "translations": [{"word": "bench", "code": "en"}]},
    {"word": "banco", "pos": "noun", "senses": [{"glosses": ["Entidad de crédito"]}], "translations": [{"word": "bank", "code": "en"}]},
    {"word": "banco", "pos": "noun", "senses": [{"glosses": ["Asiento"]}], "translations": [{"word": "bench", "code": "en"}]},
    {"word": "!!!", "pos": "intj", "senses": [{"glosses": ["x"]}]},
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    lines = spark.createDataFrame([(json.dumps(r),) for r in DUMP], "raw string")
    records = dumps.wiktionary(lines, "raw", "es", "en").withColumn("translations", F.array_union(F.flatten(F.transform("senses", lambda s: s["translations"])), "word_translations"))
    path = str(tmp_path_factory.mktemp("pack") / "es-core")
    packs.write_pack(build.build_pack(records, {"pack_id": "es-core", "tier": "core"}), path, files=1)
    return packs.read_pack(spark, path, ("entry", "form", "trans", "posting", "meta"))


def test_tables(tables):
    rows = tables["entry"].orderBy("id").collect()
    assert [r.id for r in rows] == [1, 2, 3] and len({r.uid for r in rows}) == 3
    assert sorted((r.headword, r.norm, r.fuzzy) for r in rows) == [("banco", "banco", "banko"), ("banco", "banco", "banko"), ("correr", "correr", "korer")]
    bodies = {r.headword: r.body for r in tables["entry"].filter("headword = 'correr'").select("headword", B.inflate("payload").alias("body")).collect()}
    assert bodies == {"correr": "S\tIr deprisa.\nS\tFluir\n"}
    ids = {r.norm: r.id for r in rows}
    assert {tuple(r) for r in tables["form"].collect()} == {("corriendo", ids["correr"]), ("corri", ids["correr"])}
    assert {r.norm for r in tables["trans"].collect()} == {"to run", "to", "run", "bench", "bank"}
    assert {r.key: r.value for r in tables["meta"].collect()} == {"pack_id": "es-core", "tier": "core", "entry_count": "3"}


def test_searching_the_pack(spark, tables):
    q = spark.createDataFrame([("a", "corriendo"), ("b", "ban"), ("c", "run")], "query_id string, q string")
    rungs = [search.prefix_rung(q, tables["entry"]), search.inflected_rung(q, tables["form"], tables["entry"]), search.translation_rung(q, tables["trans"], tables["entry"])]
    rows = search.cascade(rungs).collect()
    assert sorted((r.query_id, r.headword, r.match_kind) for r in rows) == [("a", "correr", 1), ("b", "banco", 0), ("c", "correr", 2)]
    found = search.bm25(spark.createDataFrame([("d", "credito")], "query_id string, q string"), tables["posting"]).collect()
    assert [r.query_id for r in found] == ["d"]
