"""Words in glosses, references, versions, glued examples and the compression dictionary."""

import zlib

from pyspark.sql import functions as F

from lexiloom.functions import gloss as G
from lexiloom.operators import lexicon
from lexiloom.operators import payload as B


def test_spans():
    assert G.spans("El ﬁn, l'été—2x") == [(0, 2, "el"), (3, 5, "fin"), (7, 8, "l"), (9, 12, "ete"), (13, 15, "2x")]
    assert G.spans("") == G.spans(None) == G.spans(" — ") == []
    assert G.spans("Straße") == [(0, 6, "strasse")] and len(G.spans("a " * 50000)) == 50000


def test_heads():
    text = "Moverse deprisa: to run fast, Run!"
    assert G.heads(text, ["to run", "fast", "walk", ""]) == [(20, 23, "to run", "run"), (24, 28, "fast", "fast")]
    assert G.heads(text, None) == []


def test_references_versions_and_ids(spark):
    df = spark.createDataFrame([("ho\x1fuse", "ab12"), ("casa ", None), (" ", "x"), (None, None)], "t string, s string")
    refs = df.select(G.translation_ref(F.col("t"), F.col("s")).alias("r"))
    assert [(r.x.term, r.x.sense) if r.x else None for r in refs.select(G.split_ref(F.col("r")).alias("x")).collect()] == [("house", "ab12"), ("casa", None), (None, None), (None, None)]
    days = spark.createDataFrame([(202609211912,), (20260920,), (20261399,), (7,), (None,)], "v bigint").select(G.version_date(F.col("v")).alias("d")).collect()
    assert [str(r.d) for r in days] == ["2026-09-21", "2026-09-20", "None", "None", "None"]
    ids = spark.createDataFrame([("es-core",), ("es-def-wikc-tat",), ("es-en",), ("ES-core",), (None,)], "p string").select(G.pack_id_valid(F.col("p")).alias("o")).collect()
    assert [r.o for r in ids] == [True, True, False, False, False]


def test_glued_examples(spark):
    rows = [("a", "noun", "P\tnoun\nS\tuno\nU\tslang\nY\tb\n"), ("a", None, "S\tuno\n"), ("b", "noun", "S\tuno\nS\tdos\n"), ("c", "noun", "S\tuno\nE\tya\n")]
    entries = spark.createDataFrame(rows, "headword string, pos string, body string")
    examples = spark.createDataFrame([("a", "noun", "ej\templo"), ("a", None, "nulo"), ("b", "noun", "x"), ("c", "noun", "x")], "headword string, pos string, example string")
    got = {(r.headword, r.pos): r.body for r in B.glued_examples(entries, examples).collect()}
    assert got == {("a", "noun"): "P\tnoun\nS\tuno\nU\tslang\nE\tej emplo\nY\tb\n", ("a", None): "S\tuno\nE\tnulo\n", ("b", "noun"): rows[2][2], ("c", "noun"): rows[3][2]}


def test_word_lines(spark):
    body = "P\tnoun\nI\tkasa\nI\totra\nH\tca·sa\nM\tlat.\nF\tpl:casas\nF\tsolo\nW\thouse\nS\tx\n"
    r = B.word_lines(spark.createDataFrame([(1, body), (2, "")], "id int, body string")).orderBy("id").collect()
    assert (r[0].pos, r[0].pronunciation, r[0].syllables, r[0].etymology, r[0].word_translations) == ("noun", "kasa", "ca·sa", "lat.", ["house"])
    assert [(f.key, f.form) for f in r[0].forms] == [("pl", "casas")] and r[1].pos is None


def test_compression_dictionary_helps(spark):
    bodies = [f"P\tnoun\nS\tParte {w} de la casa donde se apoya el techo\nE\tMi tía vio la casa {w}.\n" for w in "roja azul verde vieja nueva alta baja".split() for _ in range(3)]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    made = B.compression_dictionary(df, size=512)
    assert made == B.compression_dictionary(df.repartition(3), size=512) and 0 < len(made) <= 512

    def packed(text, preset=None):
        c = zlib.compressobj(9, zlib.DEFLATED, -15, zdict=preset) if preset else zlib.compressobj(9, zlib.DEFLATED, -15)
        return len(c.compress(text.encode()) + c.flush())

    assert sum(packed(b, made) for b in bodies) < 0.5 * sum(packed(b) for b in bodies)


def test_both_directions(spark):
    entries = spark.createDataFrame([(1, "perro", "noun", 5), (2, "can", "noun", 50), (3, "correr", "verb", 7)], "id int, headword string, pos string, rank int")
    trans = spark.createDataFrame([("dog", 1), ("dog", 2), ("run", 3), ("run", 3), ("gone", 9)], "norm string, entry_id int")
    rows = lexicon.both_directions(entries, trans).filter("direction = 'reverse'").collect()
    assert {(r.headword, r.pos, r.rank, tuple(r.equivalents)) for r in rows} == {("dog", "noun", 5, ("perro", "can")), ("run", "verb", 7, ("correr",))}
    forms = spark.createDataFrame([("dog", ["dogs"])], "norm string, forms array<string>")
    assert {tuple(r) for r in lexicon.expanded_keys(trans, forms).collect()} == {("dog", 1), ("dog", 2), ("run", 3), ("gone", 9), ("dogs", 1), ("dogs", 2)}
