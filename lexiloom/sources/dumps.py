"""Readers of lexical dumps. Each gives a DataFrame and reads nothing on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.functions import records as R
from lexiloom.functions.text import norm

MAX_WORDS_IN_LEMMA = 3
# Lexical categories of Wikidata and part-of-speech codes of WordNet.
WIKIDATA_POS = {
    "Q1084": "noun", "Q34698": "adj", "Q24905": "verb", "Q29888377": "noun", "Q380057": "adv", "Q10976085": "verb", "Q5978303": "adv",
    "Q147276": "name", "Q12734432": "adj", "Q102047": "suffix", "Q134830": "prefix", "Q83034": "intj", "Q187931": "phrase",
    "Q102786": "abbrev", "Q1298743": "conj", "Q4833830": "prep", "Q36224": "pron", "Q103184": "num", "Q161873": "det",
}
WORDNET_POS = {"n": "noun", "v": "verb", "a": "adj", "s": "adj", "r": "adv", "c": "conj", "p": "prep"}


def _lookup(table: dict[str, str], key) -> F.Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


# Wiktionary


def parsed_records(lines: DataFrame, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(*keep, r)``: the JSON records of a column of lines as a struct; lines that aren't whole objects are left out."""
    parsed = lines.select(*keep, F.from_json(text, R.RECORD_SCHEMA, {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.filter(F.trim(F.coalesce("r.word", F.lit(""))) != "")


def inbound_forms(records: DataFrame) -> DataFrame:
    """``(lemma, forms)``: what form pages say about other words.

    A dump cuts a lemma that holds a comma into several targets; where the gloss ends in all targets of a sense joined by
    commas, they are one lemma again.
    """
    pages = records.filter(R.is_form_page(F.col("r.senses"))).select(F.col("r.word").alias("form"), F.explode("r.senses").alias("s"))
    named = pages.select("form", R.filled(F.transform(R.present(F.col("s.form_of")), lambda w: w["word"])).alias("_l"), F.coalesce(F.try_element_at(R.filled(F.col("s.glosses")), F.lit(-1)), F.lit("")).alias("_g"))
    whole = F.array_join("_l", ", ")
    ends = (F.size("_l") > 1) & F.regexp_replace("_g", "[.:;\\s]+$", "").endswith(whole)
    targets = named.select("form", F.explode(F.when(ends, F.array(whole)).otherwise(F.col("_l"))).alias("lemma"))
    return targets.filter("lemma <> form").groupBy("lemma").agg(F.array_sort(F.collect_set("form")).alias("forms"))


def wiktionary(lines: DataFrame, text: str, lang: str, translations_to: str | None = None, proper_nouns: str = "included", keep: tuple[str, ...] = ()) -> DataFrame:
    """The staging records of a Wiktionary dump: one row for each record that is an entry.

    ``proper_nouns`` is ``included``, ``definitions-only`` or ``lexical-only`` (a signal of at least five). Lemmas of four
    and more words, form pages and records that show nothing are left out. Forms that other pages declare are joined by
    headword. ``keep`` are columns of ``lines`` that go along.
    """
    rows = parsed_records(lines, text, keep)
    r, language = F.col("r"), F.lit(lang)
    entries = rows.select(*keep, "r", R.senses(r, language, translations_to).alias("senses")).filter(F.size(F.split(F.trim("r.word"), "\\s+")) <= MAX_WORDS_IN_LEMMA)
    shows = (F.size("senses") > 0) | (~R.is_form_page(F.col("r.senses")) & (R.etymology(r).isNotNull() | R.pronunciation(r).isNotNull() | (F.size(R.forms(r)) > 0)))
    kept = entries.filter(shows)
    if proper_nouns == "lexical-only":
        kept = kept.filter(~F.coalesce(F.col("r.pos") == "name", F.lit(False)) | (R.lexical_signal(r) >= 5))
    elif proper_nouns == "definitions-only":
        kept = kept.filter(~F.coalesce(F.col("r.pos") == "name", F.lit(False)) | (F.size("senses") > 0))
    n_examples = F.aggregate("senses", F.lit(0), lambda a, s: a + F.size(s["examples"]))
    shown = F.flatten(F.transform("senses", lambda s: s["translations"]))
    free = R.word_translations(F.col("r.translations"), F.col("r.word"), translations_to, shown) if translations_to else F.array().cast("array<string>")
    out = kept.select(
        *keep, F.trim("r.word").alias("headword"), F.col("r.pos").alias("pos"), F.lit(lang).alias("lang"), norm(F.col("r.word")).alias("norm"), "senses",
        R.forms(r).alias("_forms"), R.principal_parts(r).alias("display_forms"), R.pronunciation(r).alias("pronunciation"), R.syllables(r).alias("syllables"),
        R.etymology(r).alias("etymology"), free.alias("word_translations"), R.page_rank(r, F.size("senses"), n_examples, lang).alias("rank"),
    )
    inbound = inbound_forms(rows).select(F.col("lemma").alias("headword"), F.col("forms").alias("_inbound"))
    joined = out.join(inbound, "headword", "left")
    return joined.withColumn("forms", F.array_union("_forms", F.coalesce("_inbound", F.array().cast("array<string>")))).drop("_forms", "_inbound")


def word_groups(lines: DataFrame, order: str, word: str) -> DataFrame:
    """``lines`` with ``word_group``: consecutive lines of one word share a number. ``order`` is the line's place in its file.

    Islands are found inside ranges of the order, so the whole file never passes through one task; a group that crosses a
    border keeps one number because a range hands its last word on.
    """
    from lexiloom.operators.ordered import with_running
    from lexiloom.session import durable

    before = durable(lines.select(order, word)).select((F.col(order) + 1).alias(order), F.col(word).alias("_before"))
    marked = lines.join(before, order, "left").withColumn("_new", F.when(F.col("_before").eqNullSafe(F.col(word)), 0).otherwise(1))
    return with_running(marked, [F.col(order)], {"word_group": F.col("_new")}, place="_p").drop("_p", "_before", "_new")


def bilingual_terms(records: DataFrame, *keep: str) -> DataFrame:
    """``(*keep, term)``: the terms that the glosses of records in another language give, each once a record."""
    glosses = records.select(*keep, F.explode(F.transform("senses", lambda s: s["gloss"])).alias("_g"))
    terms = glosses.select(*keep, R.gloss_terms(F.col("_g")).alias("_t"))
    return terms.select(*keep, F.explode("_t").alias("term")).distinct()


def single_sense_examples(lines: DataFrame, text: str, lang_code: str = "es", longest: int = 90) -> DataFrame:
    """``(headword, pos, example)``: the first short translated example of records with exactly one sense."""
    rows = parsed_records(lines, text).filter((F.col("r.lang_code") == lang_code) & (F.size(R.present(F.col("r.senses"))) == 1))
    uses = F.filter(R.present(F.get("r.senses", F.lit(0))["examples"]), lambda e: e["type"].isin("example", "quotation") & (F.trim(F.coalesce(e["english"], F.lit(""))) != "") & (F.trim(F.coalesce(e["text"], F.lit(""))) != "") & (F.length(F.trim(e["text"])) <= longest))
    found = rows.select(F.col("r.word").alias("headword"), F.col("r.pos").alias("pos"), F.trim(F.try_element_at(uses, F.lit(1))["text"]).alias("example"))
    return found.filter("example IS NOT NULL").groupBy("headword", "pos").agg(F.min("example").alias("example"))


# Wikidata, WordNet


def wikidata_lexemes(spark: SparkSession, path: str, language: str = "Q1321", lang: str = "es") -> DataFrame:
    """Lexemes of one language from the JSON array that is served one entity a line; damaged lines are skipped."""
    value = "map<string,struct<language:string,value:string>>"
    schema = f"id string, language string, lexicalCategory string, lemmas {value}, senses array<struct<id:string,glosses:{value}>>, forms array<struct<id:string,representations:{value}>>"
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), ",$", "").alias("v")).filter("v NOT IN ('', '[', ']')")
    x = lines.select(F.from_json("v", schema).alias("x")).filter(F.col("x.language") == language)
    of = lambda m: F.trim(F.coalesce(F.try_element_at(m, F.lit(lang))["value"], F.lit("")))
    lemma = of(F.col("x.lemmas"))
    glosses = F.slice(F.filter(F.transform(R.present(F.col("x.senses")), lambda s: of(s["glosses"])), lambda g: g != ""), 1, 8)
    forms = F.array_distinct(F.filter(F.transform(R.present(F.col("x.forms")), lambda f: of(f["representations"])), lambda f: (f != "") & (f != lemma)))
    rows = x.select(F.col("x.id").alias("lexeme"), lemma.alias("headword"), _lookup(WIKIDATA_POS, F.col("x.lexicalCategory")).alias("pos"), glosses.alias("glosses"), forms.alias("forms"))
    kept = rows.filter((F.col("headword") != "") & (F.size("glosses") > 0) & (F.size(F.split("headword", "\\s+")) <= MAX_WORDS_IN_LEMMA))
    rank = F.greatest(F.lit(0), F.lit(1000) - (F.size("glosses") * 3 + F.least(F.size("forms"), F.lit(80))))
    twins = kept.groupBy("headword", "pos").agg(F.count("*").alias("_n"))
    keyed = kept.alias("k").join(twins.alias("t"), (F.col("k.headword") == F.col("t.headword")) & F.col("k.pos").eqNullSafe(F.col("t.pos"))).select("k.*", "_n")
    return keyed.select("headword", "pos", "glosses", "forms", rank.cast("int").alias("rank"), F.when(F.col("_n") > 1, F.col("lexeme")).alias("sense_key"))


def wordnet_lmf(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``lexical`` (lemma, pos, sense, synset, antonym senses) and ``synset`` (synset, definition, examples) of WN-LMF XML."""
    entry = spark.read.format("xml").option("rowTag", "LexicalEntry").option("attributePrefix", "_").schema(
        "_id string, Lemma struct<_writtenForm:string,_partOfSpeech:string>, Form array<struct<_writtenForm:string>>, Sense array<struct<_id:string,_synset:string,SenseRelation:array<struct<_relType:string,_target:string>>>>"
    ).load(path)
    synset = spark.read.format("xml").option("rowTag", "Synset").option("attributePrefix", "_").schema("_id string, Definition array<string>, Example array<string>").load(path)
    lexical = entry.select(F.col("Lemma._writtenForm").alias("lemma"), _lookup(WORDNET_POS, F.col("Lemma._partOfSpeech")).alias("pos"), F.transform(R.present(F.col("Form")), lambda f: f["_writtenForm"]).alias("forms"), F.explode("Sense").alias("s"))
    opposites = F.transform(F.filter(R.present(F.col("s.SenseRelation")), lambda r: r["_relType"] == "antonym"), lambda r: r["_target"])
    return {
        "lexical": lexical.select("lemma", "pos", "forms", F.col("s._id").alias("sense"), F.col("s._synset").alias("synset"), opposites.alias("antonym_senses")),
        "synset": synset.select(F.col("_id").alias("synset"), F.trim(F.try_element_at("Definition", F.lit(1))).alias("definition"), F.slice(R.filled(F.col("Example")), 1, 1).alias("examples")),
    }


def wordnet_records(lmf: dict[str, DataFrame]) -> DataFrame:
    """``(headword, pos, senses, forms, rank)`` of a wordnet: definitions of the synsets, up to four synonyms for each sense."""
    joined = lmf["lexical"].join(lmf["synset"], "synset").filter("definition IS NOT NULL AND definition <> ''")
    members = lmf["lexical"].groupBy("synset").agg(F.array_sort(F.collect_set("lemma")).alias("_members"))
    one = joined.join(members, "synset").select("lemma", "pos", "forms", F.struct("sense", F.col("definition").alias("gloss"), "examples", F.slice(F.array_remove("_members", F.col("lemma")), 1, 4).alias("synonyms")).alias("_s"))
    rows = one.groupBy(F.col("lemma").alias("headword"), "pos").agg(F.array_sort(F.collect_list("_s")).alias("senses"), F.array_distinct(F.flatten(F.collect_list("forms"))).alias("forms"))
    n_examples = F.aggregate("senses", F.lit(0), lambda a, s: a + F.size(s["examples"]))
    return rows.withColumn("rank", F.greatest(F.lit(0), F.lit(1000) - (F.size("senses") * 12 + n_examples * 3 + F.least(F.size("forms"), F.lit(8)))).cast("int"))


def _siblings(single: DataFrame, members: DataFrame) -> DataFrame:
    """Up to four synonyms of lemmas of one synset, without variants of the lemma itself."""
    pairs = single.join(members.select("synset", F.col("lemma").alias("other")).distinct(), "synset").filter("other <> lemma")
    a, b = norm(F.col("lemma")), norm(F.col("other"))
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    variant = (F.length(short) >= 4) & long.startswith(short) & (F.length(long) - F.length(short) <= 3)
    kept = pairs.filter(~variant & (a != b)).withColumn("_n", F.row_number().over(Window.partitionBy("lemma", "pos").orderBy("other"))).filter("_n <= 4")
    return kept.groupBy("lemma", "pos").agg(F.array_sort(F.collect_list("other")).alias("synonyms"))


def thesaurus(lexical: DataFrame) -> DataFrame:
    """``(lemma, pos, synonyms, antonyms)``: synonyms only for lemmas of exactly one synset, antonyms sense by sense."""
    reach = lexical.groupBy("lemma", "pos").agg(F.min("synset").alias("synset"), F.max("synset").alias("_x")).filter("synset = _x").drop("_x")
    synonyms = _siblings(reach, lexical)
    if "antonym_senses" not in lexical.columns:
        return synonyms.withColumn("antonyms", F.array().cast("array<string>"))
    targets = lexical.select(F.col("sense").alias("_t"), F.col("lemma").alias("_opposite"))
    opposite = lexical.select("lemma", "pos", F.explode("antonym_senses").alias("_t")).join(targets, "_t").filter("_opposite <> lemma")
    antonyms = opposite.groupBy("lemma", "pos").agg(F.slice(F.array_sort(F.collect_set("_opposite")), 1, 4).alias("antonyms"))
    empty = F.array().cast("array<string>")
    s, a = synonyms.alias("s"), antonyms.alias("a")
    both = s.join(a, (F.col("s.lemma") == F.col("a.lemma")) & F.col("s.pos").eqNullSafe(F.col("a.pos")), "full_outer")
    return both.select(F.coalesce("s.lemma", "a.lemma").alias("lemma"), F.coalesce("s.pos", "a.pos").alias("pos"), F.coalesce("synonyms", empty).alias("synonyms"), F.coalesce("antonyms", empty).alias("antonyms"))


def omw_tab(spark: SparkSession, path: str) -> DataFrame:
    """``(lemma, pos, synset)`` of a three-column tab file; comments and other relations are left out."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#")).filter(F.size(f) >= 3).select(F.get(f, F.lit(0)).alias("synset"), F.get(f, F.lit(1)).alias("kind"), F.trim(F.get(f, F.lit(2))).alias("lemma"))
    return rows.filter(F.col("kind").endswith("lemma") & (F.col("lemma") != "")).select("lemma", _lookup(WORDNET_POS, F.substring("synset", -1, 1)).alias("pos"), "synset").filter("pos IS NOT NULL")


# Corpora and lists


def tatoeba(spark: SparkSession, path: str, lang: str | None = None, shortest: int | None = None, longest: int | None = None) -> DataFrame:
    """``(frase_id, lang, texto)`` of a sentence file, optionally of one language and of some lengths."""
    f = F.split("value", "\t", 3)
    rows = spark.read.text(path).filter(F.size(f) == 3).select(F.get(f, F.lit(0)).try_cast("bigint").alias("frase_id"), F.get(f, F.lit(1)).alias("lang"), F.trim(F.get(f, F.lit(2))).alias("texto"))
    rows = rows.filter("frase_id IS NOT NULL AND texto <> ''")
    if lang is not None:
        rows = rows.filter(F.col("lang") == lang)
    if shortest is not None:
        rows = rows.filter(F.length("texto") >= shortest)
    return rows if longest is None else rows.filter(F.length("texto") <= longest)


def frequency_list(spark: SparkSession, path: str) -> DataFrame:
    """``(word, n)`` of a list of words and counts, by lower case; lines of another shape are skipped, repeats summed."""
    f = F.split(F.trim("value"), "\\s+")
    rows = spark.read.text(path).filter(F.size(f) == 2).select(F.lower(F.get(f, F.lit(0))).alias("word"), F.get(f, F.lit(1)).alias("_n")).filter(F.col("_n").rlike("^\\d+$"))
    return rows.groupBy("word").agg(F.sum(F.col("_n").cast("bigint")).alias("n"))


def combined_frequencies(first: DataFrame, filler: DataFrame) -> DataFrame:
    """Two lists as one; the first one's count stands."""
    return first.withColumnRenamed("n", "_a").join(filler.withColumnRenamed("n", "_b"), "word", "full_outer").select("word", F.coalesce("_a", "_b").alias("n"))


def prevalence(spark: SparkSession, path: str) -> DataFrame:
    """``(word, known)``: the share of speakers who know a word; blank and unreadable rows are skipped, the highest stands."""
    rows = spark.read.option("header", True).csv(path).select(F.trim(F.lower("spelling")).alias("word"), F.col("percent_total").try_cast("double").alias("known"))
    return rows.filter("word <> '' AND known IS NOT NULL").groupBy("word").agg(F.max("known").alias("known"))


def required_words(spark: SparkSession, path: str, directive: str = "#! solo el pack completo") -> DataFrame:
    """``(word, every_tier)``: a directive holds for the words after it up to the next blank line; ``#`` begins a comment.

    The file is a short list kept by hand and is read as one text, so its state needs no order of rows.
    """
    groups = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "\\n\\s*\\n")).alias("g"))
    lines = groups.select(F.transform(F.split("g", "\\n"), lambda x: F.trim(x)).alias("l"))
    at = F.array_position("l", directive)
    numbered = lines.select(F.posexplode("l").alias("i", "word"), at.alias("_at"))
    return numbered.filter("word <> ''").filter(~F.col("word").startswith("#")).select("word", (~((F.col("_at") > 0) & (F.col("i") + 1 > F.col("_at")))).alias("every_tier"))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """The packs of a catalogue; those without id, address or digest are left out, other fields have defaults."""
    schema = "catalog_version int, packs array<struct<pack_id:string,name:string,description:string,langs:array<string>,kind:string,tier:string,entry_count:bigint,data_version:bigint,schema_version:int,norm_version:int,license:string,url:string,bytes:bigint,sha256:string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("packs").alias("p")).select("p.*")
    kept = rows.filter("coalesce(pack_id, '') <> '' AND coalesce(url, '') <> '' AND coalesce(sha256, '') <> ''")
    return kept.withColumns({"name": F.coalesce("name", "pack_id"), "langs": F.coalesce("langs", F.array().cast("array<string>")), "entry_count": F.coalesce("entry_count", F.lit(0)), "data_version": F.coalesce("data_version", F.lit(0))})


def vocabulary(lines: DataFrame, value: str) -> DataFrame:
    """The distinct keys of a list of words."""
    return lines.select(norm(F.col(value)).alias("norm")).filter("norm <> ''").distinct()


def inflections(form: DataFrame, entry: DataFrame) -> DataFrame:
    """``(norm, forms)``: forms of one word of each headword key, without those that hold digits or equal the key."""
    joined = form.withColumnRenamed("norm", "form").join(entry.select("id", "norm"), F.col("entry_id") == F.col("id"))
    kept = joined.filter(~F.col("form").contains(" ") & ~F.col("form").rlike("\\d") & (F.col("form") != F.col("norm")))
    return kept.groupBy("norm").agg(F.array_sort(F.collect_set("form")).alias("forms"))


def manifest(meta: DataFrame) -> DataFrame:
    """The key-value rows of each pack as one map."""
    return meta.groupBy("pack_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("meta"))
