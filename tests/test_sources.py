"""Dump readers, sinks and streams on small files written here."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import records as R
from lexiloom.sources import dumps, packs

WIKT = [
    {"word": "casa", "pos": "noun", "lang_code": "es", "senses": [
        {"glosses": ["Edificio", "Edificio para vivir.₁^([cita requerida])"], "sense_index": "1", "tags": ["colloquial", "Chile"], "examples": [{"text": " Mi casa. ", "ref": "J. R. R. Tolkien. El Señor de los Anillos. 1954."}, {"text": "otra"}]},
        {"glosses": ["Familia"], "sense_index": "2", "hypernyms": [{"word": "grupo"}, {"word": "Appendix:Casa"}]},
        {"glosses": ["forma"], "tags": ["form-of"], "form_of": [{"word": "casar"}]}],
     "synonyms": [{"word": "hogar", "sense_index": "1-2"}, {"word": "vivienda", "sense_index": "1"}, {"word": "sin índice"}],
     "translations": [{"word": "house", "code": "en", "sense_index": "1"}, {"word": "home", "lang_code": "en"}, {"word": "maison", "code": "fr", "sense_index": "1"}],
     "forms": [{"form": "casas", "tags": ["plural"]}, {"form": "x", "tags": ["table-tags"]}, {"form": "más casa"}, {"form": "casa"}],
     "sounds": [{}, {"ipa": "/ˈkasa/"}], "hyphenations": [{"parts": ["ca", "sa"]}], "etymology_texts": ["Etymology tree", "* Del latín casa.", "== Notas =="]},
    {"word": "casas", "pos": "verb", "senses": [{"glosses": ["forma de casar"], "tags": ["form-of"], "form_of": [{"word": "casar"}]}]},
    {"word": "casar", "pos": "verb", "senses": [{"glosses": ["Unir"], "related": [{"word": "boda"}], "synonyms": [{"word": "unir"}]}], "related": [{"word": "casado"}, {"word": "boda"}]},
    {"word": "una de más de tres", "pos": "phrase", "senses": [{"glosses": ["x"]}]},
    {"word": "vacía", "pos": "noun", "senses": []},
]


@pytest.fixture(scope="module")
def wikt(spark):
    return spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(WIKT)] + [(90, '{"word": "cut'), (91, None)], "rec_id int, raw string")


def test_wiktionary_records(wikt):
    rows = {r.headword: r for r in dumps.wiktionary(wikt, "raw", "es", "en", keep=("rec_id",)).collect()}
    assert set(rows) == {"casa", "casar"}
    casa = rows["casa"]
    assert [s.gloss for s in casa.senses] == ["Edificio para vivir.", "Familia"]
    assert casa.senses[0].synonyms == ["hogar", "vivienda"] and casa.senses[1].synonyms == ["hogar"]
    assert casa.senses[0].translations == ["house"] and casa.word_translations == ["home"]
    assert casa.senses[0].labels == ["colloquial", "chile"] and [e.text for e in casa.senses[0].examples] == ["Mi casa."]
    assert casa.senses[1].related == ["grupo"] and casa.forms == ["casas"]
    assert (casa.pronunciation, casa.syllables, casa.etymology) == ("ˈkasa", "ca·sa", "Del latín casa.")
    assert [(d.key, d.form) for d in casa.display_forms] == [("pl", "casas")]
    # A record of one sense takes what the entry says; forms that other pages declare come along.
    assert rows["casar"].senses[0].related == ["boda", "casado"] and rows["casar"].forms == ["casas"]
    assert 500 <= casa.rank < rows["casar"].rank <= 1000


def test_sense_numbers(spark):
    cases = {"1": ["1"], "1-3": ["1", "2", "3"], "1,3; 5": ["1", "3", "5"], "1b": [], "3-1": [], "": [], "1-99": [], None: []}
    df = spark.createDataFrame([(k,) for k in cases], "i string")
    assert {r.i: r.n for r in df.select("i", R.sense_numbers(F.col("i")).alias("n")).collect()} == cases


def test_inbound_and_examples(spark, wikt):
    found = dumps.inbound_forms(dumps.parsed_records(wikt, "raw")).collect()
    assert [(r.lemma, r.forms) for r in found] == [("casar", ["casas"])]
    cut = [{"word": "vamos", "pos": "verb", "senses": [{"glosses": [g], "tags": ["form-of"], "form_of": [{"word": "bien"}, {"word": "mal"}]}]} for g in ("Forma de bien, mal.", "Forma de mal y bien")]
    pages = spark.createDataFrame([(json.dumps(x),) for x in cut], "raw string")
    assert {(r.lemma, tuple(r.forms)) for r in dumps.inbound_forms(dumps.parsed_records(pages, "raw")).collect()} == {("bien, mal", ("vamos",)), ("bien", ("vamos",)), ("mal", ("vamos",))}
    lines = [{"word": "a", "pos": "noun", "lang_code": "es", "senses": [{"glosses": ["g"], "examples": [{"text": "nota"}, {"text": "uso", "type": "example", "english": "use"}]}]}, {"word": "b", "lang_code": "es", "senses": [{}, {}]}]
    df = spark.createDataFrame([(json.dumps(x),) for x in lines], "raw string")
    assert [tuple(r) for r in dumps.single_sense_examples(df, "raw").collect()] == [("a", "noun", "uso")]


@pytest.mark.parametrize(
    "ref, lang, want",
    [
        ("J. R. R. Tolkien. El Señor de los Anillos. Página 3. 1954.", "es", "J. R. R. Tolkien. El Señor de los Anillos"),
        ("1897, Richard Marsh, The Beetle:", "en", "1897, Richard Marsh"),
        ("1901, “Of Men, and Mice”, X, Y", "en", "1901, “Of Men, and Mice”"),
        ("“Sin cerrar. Autor. Obra", "es", "Sin cerrar. Autor"), ("(X, Y", "en", "X, Y"), (". A. B. Pérez. Obra (t. 2. p. 31). Resto", "es", "A. B. Pérez. Obra (t. 2. p. 31)"),
        ("Uno (a, b, c", "en", "Uno (a, b, c"), ("x" * 9000 + ", y, z", "en", "x" * 9000 + ", y"), ("   ", "en", None), ("", "es", None), (None, "en", None), ("Autor, Obra", "pt", None), ("solo:", "en", "solo"),
    ],
)
def test_citations(spark, ref, lang, want):
    df = spark.createDataFrame([(ref, lang)], "ref string, lang string")
    assert df.select(R.citation(F.col("ref"), F.col("lang")).alias("c")).collect()[0].c == want


@pytest.mark.parametrize(
    "gloss, want",
    [
        ("to run, to jog", ["to run", "run", "to jog", "jog"]), ("house (building); home", ["house", "home"]), ("a kind of house", []),
        ("of, from the house", []), ("something big", []), ("native or inhabitant of Chile", []), ("one, very long phrase here, etc.", []),
        ("indicates possession", []), ("of the", []), ("", []), (None, []),
    ],
)
def test_gloss_terms(spark, gloss, want):
    df = spark.createDataFrame([(gloss,)], "g string")
    row = df.select(R.gloss_terms(F.col("g")).alias("t"), R.gloss_terms(F.col("g"), for_search=False).alias("shown")).collect()[0]
    assert row.t == want and set(row.shown) <= set(want)


def test_word_groups(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate("aabbbaac")], "line bigint, word string")
    rows = sorted((r.line, r.word_group) for r in dumps.word_groups(df, "line", "word").collect())
    assert [g for _, g in rows] == [1, 1, 2, 2, 2, 3, 3, 4]


def test_text_lists(spark, tmp_path):
    def file(name, text):
        path = str(tmp_path / name)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        return path

    freq = dumps.frequency_list(spark, file("f.txt", "Casa 10\ncasa 5\nmal\nuna dos 3\nx 1a\n"))
    assert [tuple(r) for r in freq.collect()] == [("casa", 15)]
    known = dumps.prevalence(spark, file("p.csv", "spelling,count_total,percent_total\ncasa,3,98.5\ncasa,3,97\n,1,2\nx,1,?\n"))
    assert [tuple(r) for r in known.collect()] == [("casa", 98.5)]
    tat = dumps.tatoeba(spark, file("t.tsv", "1\tspa\tHola \"tú\".\n2\teng\tHi\nbad\n3\tspa\tLarga larga\tcon tab\n"), lang="spa", longest=12)
    assert [tuple(r) for r in tat.collect()] == [(1, "spa", 'Hola "tú".')]
    tab = dumps.omw_tab(spark, file("o.tab", "# c\n1-n\tspa:lemma\tcasa\n1-n\tspa:lemma\thogar\n1-n\tspa:def\tx\n2-v\tspa:lemma\tir\n"))
    assert {tuple(r) for r in tab.collect()} == {("casa", "noun", "1-n"), ("hogar", "noun", "1-n"), ("ir", "verb", "2-v")}
    syn = {r.lemma: r.synonyms for r in dumps.thesaurus(tab).collect()}
    assert syn == {"casa": ["hogar"], "hogar": ["casa"]}
    words = dumps.required_words(spark, file("c.txt", "# c\nuno\n#! solo el pack completo\ndos\n\ntres\n"))
    assert {tuple(r) for r in words.collect()} == {("uno", True), ("dos", False), ("tres", True)}
    cat = dumps.catalog(spark, file("c.json", json.dumps({"catalog_version": 1, "packs": [{"pack_id": "a", "url": "u", "sha256": "s"}, {"pack_id": "b"}]})))
    assert [(r.pack_id, r.name, r.entry_count) for r in cat.collect()] == [("a", "a", 0)]
    a = spark.createDataFrame([("x", 1), ("y", 2)], "word string, n bigint")
    b = spark.createDataFrame([("y", 9), ("z", 3)], "word string, n bigint")
    assert {tuple(r) for r in dumps.combined_frequencies(a, b).collect()} == {("x", 1), ("y", 2), ("z", 3)}


def test_wikidata(spark, tmp_path):
    def lexeme(i, lemma, cat="Q1084", gloss="g", lang="Q1321"):
        return json.dumps({"id": i, "language": lang, "lexicalCategory": cat, "lemmas": {"es": {"language": "es", "value": lemma}}, "senses": [{"id": "s", "glosses": {"es": {"language": "es", "value": gloss}}}], "forms": [{"id": "f", "representations": {"es": {"language": "es", "value": lemma + "s"}}}]})

    lines = ["[", lexeme("L1", "casa") + ",", lexeme("L2", "casa") + ",", "{broken", lexeme("L3", "ir", "Q24905") + ",", lexeme("L4", "go", lang="Q1860") + ",", lexeme("L5", "nada", gloss=""), "]"]
    path = str(tmp_path / "w.json.gz")
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.write("\n".join(lines))
    rows = {(r.headword, r.pos, r.sense_key, r.rank, tuple(r.forms)) for r in dumps.wikidata_lexemes(spark, path).collect()}
    assert rows == {("casa", "noun", "L1", 996, ("casas",)), ("casa", "noun", "L2", 996, ("casas",)), ("ir", "verb", None, 996, ("irs",))}


LMF = """<LexicalResource><Lexicon id="x">
<LexicalEntry id="e1"><Lemma writtenForm="hot" partOfSpeech="a"/><Form writtenForm="hotter"/><Sense id="s1" synset="y1"><SenseRelation relType="antonym" target="s3"/></Sense></LexicalEntry>
<LexicalEntry id="e2"><Lemma writtenForm="torrid" partOfSpeech="a"/><Sense id="s2" synset="y1"/></LexicalEntry>
<LexicalEntry id="e3"><Lemma writtenForm="cold" partOfSpeech="a"/><Sense id="s3" synset="y2"/><Sense id="s4" synset="y3"/></LexicalEntry>
<Synset id="y1"><Definition>of high heat</Definition><Example>a hot day</Example><Example>other</Example></Synset>
<Synset id="y2"><Definition>of low heat</Definition></Synset><Synset id="y3"><Definition>unfriendly</Definition></Synset>
</Lexicon></LexicalResource>"""


def test_wordnet(spark, tmp_path):
    path = str(tmp_path / "wn.xml")
    with open(path, "w") as f:
        f.write(LMF)
    lmf = dumps.wordnet_lmf(spark, path)
    syn = {r.lemma: (r.synonyms, r.antonyms) for r in dumps.thesaurus(lmf["lexical"]).collect()}
    assert syn == {"hot": (["torrid"], ["cold"]), "torrid": (["hot"], [])}
    rows = {r.headword: r for r in dumps.wordnet_records(lmf).collect()}
    assert rows["hot"].rank == 1000 - (12 + 3 + 1) and rows["hot"].senses[0].examples == ["a hot day"] and rows["hot"].senses[0].synonyms == ["torrid"]
    assert len(rows["cold"].senses) == 2 and rows["cold"].rank == 1000 - 24


def test_pack_is_written_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "pack")
    entry = spark.createDataFrame([(1, "b"), (2, "a")], "id bigint, norm string")
    packs.write_pack({"entry": entry}, path, files=1)
    assert [r.norm for r in packs.read_pack(spark, path, ("entry",))["entry"].collect()] == ["a", "b"]
    bad = entry.select("id", F.raise_error(F.lit("no")).alias("norm"))
    with pytest.raises(Exception):
        packs.write_pack({"entry": entry, "form": bad}, path)
    assert packs.read_pack(spark, path, ("entry",))["entry"].count() == 2 and os.listdir(tmp_path) == ["pack"]


def test_meta_and_names(spark):
    meta = spark.createDataFrame([("name", "Español (core) (full)"), ("tier", "core"), ("data_version", "202601010000")], "key string, value string")
    assert {r.key: r.value for r in packs.repaired(meta).collect()} == {"name": "Español (core)", "tier": "core", "data_version": "202601010001"}
    assert {r.key: r.value for r in packs.repaired(packs.repaired(meta)).collect()}["data_version"] == "202601010001"
    assert [(r.key, r.value) for r in packs.upsert_meta(meta, {"tier": "main", "a": "b"}).collect()] == [("a", "b"), ("data_version", "202601010000"), ("name", "Español (core) (full)"), ("tier", "main")]
    cat = spark.createDataFrame([("b", "core", "mono"), ("a", None, "bilingual"), ("c", None, "mono")], "pack_id string, tier string, kind string")
    assert [r.pack_id for r in packs.catalog_rows(cat).collect()] == ["a", "b"]
    assert dumps.manifest(meta.withColumn("pack_id", F.lit("p"))).collect()[0].meta["tier"] == "core"
