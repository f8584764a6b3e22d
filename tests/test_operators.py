"""Text keys, search, payloads, tiers, pools, packs and quality: vectors, edge cases, brute-force twins."""

import random
import unicodedata
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as X
from lexiloom.operators import discover, lexicon, ordered, packs, quality, rank, search, tiers
from lexiloom.operators import payload as B
from lexiloom.plans import packs as plan_packs
from lexiloom.plans import search as plan_search
from lexiloom.streaming import queries as stream

# Own vectors, in the form (text, key).
NORM = [
    ("Correr", "correr"), ("ÁRBOL", "arbol"), ("Straße", "strasse"), ("ÆON", "aeon"), ("Łódź", "lodz"), ("ﬁn", "fin"), ("self-made", "self made"),
    ("Saint-Étienne", "saint etienne"), ("e²", "e"), ("COVID-19", "covid 19"), ("!!!", ""), ("", ""), ("нож", "нож"), ("Ёлка", "елка"), ("ά β", "α β"),
    ("ó", "o"), ("a b", "a b"), ("中文", "中文"), ("  x  y ", "x y"), (None, None),
]
FUZZY = [("es", "chico", "chiko"), ("es", "queso", "keso"), ("es", "cerrar", "serar"), ("es", "vaca", "baka"), ("es", "hola", "ola"), ("es", "guerra", "gera"), ("en", "knight", "nit"), ("en", "phone", "fone"), ("en", "city", "siti"), ("de", "schule", "sule"), ("de", "zwei", "tsvei"), ("fr", "belle", "bele"), ("es", "1000", "1000")]


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.o for r in df.select("i", expression(F.col("t")).alias("o")).orderBy("i").collect()]


def test_norm_vectors(spark):
    assert column(spark, [t for t, _ in NORM], X.norm) == [k for _, k in NORM]


def test_norm_drops_every_mark(spark):
    rng = random.Random(1)
    texts = ["".join(chr(rng.choice([rng.randrange(0x41, 0x250), rng.randrange(0x370, 0x460), rng.randrange(0x1E00, 0x2000)])) for _ in range(12)) for _ in range(400)]
    for key in column(spark, texts, X.norm):
        assert not any(unicodedata.category(c).startswith("M") for c in unicodedata.normalize("NFD", key)), key


def test_fuzzy_vectors(spark):
    df = spark.createDataFrame(FUZZY, "l string, t string, want string")
    assert all(r.got == r.want for r in df.select("want", X.fuzzy(X.norm(F.col("t")), F.col("l")).alias("got")).collect())


def test_published_sense_code(spark):
    got = spark.createDataFrame([(1, "casa"), (1, " Casa. ")], "u bigint, g string").select(X.sense_code(F.col("u"), F.col("g")).alias("c")).collect()
    assert {r.c for r in got} == {"8ec316909e48"}


def test_upper_bound():
    assert X.upper_bound("ab") == "ac" and X.upper_bound("a\U0010ffff") == "b" and X.upper_bound("퟿") == ""
    assert X.upper_bound("\U0010ffff") is None and X.upper_bound("") is None
    rng = random.Random(2)
    for _ in range(500):
        a, b = ("".join(rng.choice("abz\U0010ffff") for _ in range(rng.randrange(1, 4))) for _ in range(2))
        top = X.upper_bound(a)
        assert b.startswith(a) == (a <= b and (top is None or b < top)) or top is None


def plain_osa(a, b):
    d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_edit_distance():
    assert X.osa_distance("ca", "abc", 5) == 3 and X.osa_distance("casa", "caas") == 1 and X.osa_distance("", "") == 0
    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 7))) for _ in range(2))
        assert X.osa_distance(a, b) == min(plain_osa(a, b), 3), (a, b)


def test_ellipsize_and_sanitize(spark):
    long = "una definición bastante larga que no cabe en la fila, de ningún modo"
    out = column(spark, ["corta", long, "x" * 60, None], X.ellipsize)
    assert out == ["corta", "una definición bastante larga que no cabe en la…", "x" * 48 + "…", None]
    assert column(spark, ["a\tb\r\nc", " ", "\x1f", None, "x" * 100000], X.sanitize) == ["a b c", None, None, None, "x" * 100000]


# Search

ENTRIES = [
    (1, "es", "Perro", "perro", "pero", "noun", 10), (2, "es", "perro", "perro", "pero", "verb", 5), (3, "es", "per", "per", "per", None, 900), (4, "es", "perla", "perla", "perla", "noun", 7),
    (5, "en", "perk", "perk", "perk", "noun", 1), (6, "es", "correr", "correr", "korer", "verb", 3), (7, "es", "perro", "perro", "pero", "verb", 50), (8, "es", "gato", "gato", "gato", "noun", 9),
]


@pytest.fixture(scope="module")
def pack(spark):
    entry = spark.createDataFrame([(*e, "clash") for e in ENTRIES], "id bigint, lang string, headword string, norm string, fuzzy string, pos string, rank int, q string").drop("q")
    form = spark.createDataFrame([("corriendo", 6), ("perros", 1), ("perros", 1), ("perros", 2), (None, 3), ("x", None)], "norm string, entry_id bigint")
    trans = spark.createDataFrame([("dog", 1), ("dog walker", 1), ("dogged", 2), (None, 4), ("run", None)], "norm string, entry_id bigint")
    return entry, form, trans


def ask(spark, rows):
    return spark.createDataFrame([(str(i), q, lang, q) for i, (q, lang) in enumerate(rows)], "query_id string, q string, q_lang string, q_fuzzy string")


def test_prefix_rung(spark, pack):
    found = search.prefix_rung(ask(spark, [("per", "es"), ("per", None), ("", "es"), (None, "es"), ("perro perro perro", "es")]), pack[0], 3).collect()
    assert [r.entry_id for r in sorted(found, key=lambda r: r.score) if r.query_id == "0"] == [3, 2, 4]
    assert [r.entry_id for r in sorted(found, key=lambda r: r.score) if r.query_id == "1"] == [3, 5, 2]
    assert {r.query_id for r in found} == {"0", "1"}


def test_cascade_gates(spark, pack):
    entry, form, trans = pack
    q = ask(spark, [("corriendo", "es"), ("dog", "es"), ("perr", "es"), ("grato", "es")])
    q = q.withColumn("q_fuzzy", F.when(F.col("q") == "grato", "gato").otherwise(F.col("q_fuzzy")))
    rungs = [search.prefix_rung(q, entry), search.inflected_rung(q, form, entry), search.translation_rung(q, trans, entry), search.fuzzy_rung(q, entry)]
    rows = search.cascade(rungs, 30).collect()
    got = {(r.query_id, r.place): (r.entry_id, r.match_kind) for r in rows}
    assert got[("0", 0)] == (6, search.INFLECTED) and got[("3", 0)] == (8, search.FUZZY)
    assert [got[("1", i)] for i in range(2)] == [(2, search.TRANSLATION), (1, search.TRANSLATION)]
    # perro (verb) is there once, by its better row.
    assert sum(r.query_id == "2" and r.headword == "perro" for r in rows) == 1


def test_resolve_prefers_headwords(spark, pack):
    keys = spark.createDataFrame([("perro",), ("perros",), ("nada",), ("",), (None,), ("perro",)], "norm string")
    rows = {r.norm: (r.entry_id, r.via) for r in search.resolve(keys, pack[1], pack[0]).collect()}
    assert rows == {"perro": (2, "lemma"), "perros": (2, "form")}


def test_bm25_needs_every_word_and_favours_short_texts(spark):
    docs = spark.createDataFrame([(1, "gato negro"), (2, "gato negro muy grande"), (3, "gato"), (4, ""), (5, None), (6, "perro blanco"), (7, "pez")], "id bigint, t string")
    index = search.postings(docs, "id", "t")
    q = spark.createDataFrame([("a", "gato negro"), ("b", "gato gato"), ("c", ""), ("d", "nada")], "query_id string, q string")
    rows = search.bm25(q, index).collect()
    assert [r.entry_id for r in sorted(rows, key=lambda r: r.place) if r.query_id == "a"] == [1, 2]
    assert [r.entry_id for r in sorted(rows, key=lambda r: r.place) if r.query_id == "b"] == [3, 1, 2]
    assert {r.query_id for r in rows} == {"a", "b"}


def _most_rows(df) -> int:
    """The most rows that a step of the plan of ``df`` gives when it runs."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        todo += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        rows = node.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
    return most


def test_bm25_answers_equal_queries_once(spark):
    """Rows between are no product of queries and entries, and each of the equal queries has its whole list."""
    docs = spark.range(200).selectExpr("id", "CASE WHEN id < 150 THEN concat('red fox', repeat(' den', CAST(id % 7 AS INT))) ELSE 'blue den' END AS t")
    queries = spark.range(400).selectExpr("id AS query_id", "CASE WHEN id % 2 = 0 THEN 'fox red' ELSE 'red fox red' END AS q")
    found = search.bm25(queries, search.postings(docs, "id", "t"), 5)
    assert _most_rows(found) <= 400 * 5
    lists = {}
    for r in found.collect():
        lists.setdefault(r.query_id, []).append((r.place, r.entry_id))
    assert len(lists) == 400 and {tuple(sorted(found)) for found in lists.values()} == {tuple(enumerate((0, 7, 14, 21, 28)))}
    assert sorted(search.bm25_texts(queries, docs, "id", "t", 5).collect()) == sorted(found.collect())


def test_merge_shows_a_word_once_definitions_first(spark):
    schema = "query_id int, query string, pack_id string, entry_id bigint, headword string, pos string, match_kind int, score int, has_frequency boolean, active boolean, by_frequency boolean, bilingual boolean"
    rows = [
        (1, "cas", "es", 1, "casa", "noun", 0, 1, True, True, True, False), (1, "cas", "es-en", 9, "casa", "noun", 0, 0, True, True, True, True),
        (1, "cas", "es-en", 8, "casar", "verb", 0, 2, True, True, True, True), (1, "cas", "es", 2, "Cas", "name", 0, 5, True, True, True, False),
        (1, "cas", "wd", 3, "casa", "noun", 0, 0, False, True, False, False), (1, "cas", "es", 4, "Casandra", "name", 0, 0, True, True, True, False),
        (1, "cas", "es", 5, "caso", None, 1, 0, False, True, True, False),
    ]
    out = search.merge_packs(spark.createDataFrame(rows, schema)).orderBy("place").collect()
    assert [r.entry_id for r in out] == [2, 1, 4, 5, 8]


# Payloads


def test_parse_and_render(spark):
    body = "P\tnoun\nW\thouse\nS\tuno\nU\tcolloquial\nE\tejemplo\nC\tautor\nE\totro\nT\tx\nC\tsuelta\nY\ts1\nY\ts1\nS\tUno.\nE\tejemplo dos\nA\tno\nbad\nZ\tzz\nS\t\n"
    df = spark.createDataFrame([(1, body, "c"), (2, "", "c"), (3, None, "c"), (4, "E\tsin acepción\n", "c")], "id bigint, body string, line string")
    senses = B.parse_senses(df).orderBy("sense").collect()
    assert [(s.gloss, [(e.text, e.ref) for e in s.examples], s.synonyms, s.antonyms, s.labels) for s in senses] == [
        ("uno", [("ejemplo", "autor"), ("otro", None)], ["s1", "s1"], [], ["colloquial"]), ("Uno.", [("ejemplo dos", None)], [], ["no"], []),
    ]
    merged = B.merge_duplicate_senses(B.parse_senses(df)).collect()
    assert [(m.gloss, len(m.examples), m.synonyms, m.antonyms) for m in merged] == [("uno", 3, ["s1"], ["no"])]
    assert B.render_senses(B.parse_senses(df)).collect()[0].body == "S\tuno\nU\tcolloquial\nE\tejemplo\nC\tautor\nE\totro\nT\tx\nY\ts1\nY\ts1\nS\tUno.\nE\tejemplo dos\nA\tno\n"
    assert B.search_text(B.parse_senses(df)).collect()[0].fts_body == "uno ejemplo otro x s1 s1 Uno. ejemplo dos"


def test_codec_round_trip(spark):
    texts = ["", "S\tá\n", "x" * 200000, None]
    assert column(spark, texts, lambda c: B.inflate(B.deflate(c))) == texts
    assert spark.createDataFrame([(bytearray(b"\xff\x00broken"),)], "p binary").select(B.inflate("p").alias("o")).collect()[0].o is None


# Ordered totals, ranks, tiers


def test_running_totals_over_ranges(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(9)) for i in rng.sample(range(10000), 700)]
    out = ordered.with_running(spark.createDataFrame(rows, "k int, c int"), [F.col("k")], {"s": F.col("c")}).orderBy("k").collect()
    total = 0
    for place, (r, (k, c)) in enumerate(zip(out, sorted(rows))):
        total += c
        assert (r.k, r.place, r.s) == (k, place, total)
    assert ordered.with_running(spark.createDataFrame([], "k int, c int"), [F.col("k")], {"s": F.col("c")}).count() == 0


def test_budget_always_takes_one_and_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([("a", 50, 1), ("b", 10, 2), ("c", 100, 3), ("d", 1, 4)], "norm string, cost int, r int")
    take = lambda budget: [r.norm for r in tiers.within_budget(df, [F.col("r")], F.col("cost"), budget).orderBy("place").collect()]
    assert take(70) == ["a", "b"] and take(5) == ["a"] and take(1000) == ["a", "b", "c", "d"]
    assert tiers.within_budget(df.limit(0), [F.col("r")], F.col("cost"), 9).count() == 0


def test_entry_order_bands(spark):
    rows = [("rare", 1, 900, 1, None), ("known", 1, 800, 2, 98.0), ("frequent", 1, 700, 500, None), ("plain", 1, 3, None, None), ("rich", 1, 2, None, 10.0)]
    df, order = tiers.entry_order(spark.createDataFrame(rows, "norm string, cost int, best_rank int, n bigint, known double"), 1e9)
    assert [r.norm for r in df.orderBy(*order).collect()] == ["frequent", "known", "rare", "rich", "plain"]


def test_budget_search():
    calls = []
    budget, size = tiers.budget_in_range(lambda b: calls.append(b) or b * 1.7 + 3, 90, 110, 10)
    assert 90 <= size <= 110 and len(calls) <= 8


def test_spearman_with_ties(spark):
    a = [(i, i // 3, (i * 7) % 5) for i in range(60)]
    df = spark.createDataFrame(a, "k int, x int, y int")
    import pandas as pd

    want = pd.DataFrame(a, columns=["k", "x", "y"])
    assert tiers.spearman(df, "x", "y").collect()[0].rho == pytest.approx(want.x.rank().corr(want.y.rank()), abs=1e-6)
    assert sorted(r.x for r in tiers.rotated(df, "k", "x").collect()) == sorted(x for _, x, _ in a)


def test_rank_values(spark):
    df = spark.createDataFrame([(0.0,), (3.5,), (7.2,), (0.05,)], "z double")
    assert [r.r for r in df.select(rank.frequency_rank(F.col("z")).alias("r")).collect()] == [499, 254, 0, 495]


def test_caps_and_indexes(spark):
    pairs = spark.createDataFrame([("k", i, "w", i % 3) for i in range(100)] + [("one", 1, "w", 0)], "norm string, entry_id int, headword string, rank int")
    assert lexicon.capped(pairs, "norm", "rank", "entry_id", 5).filter("norm = 'k'").count() == 5
    assert {r.norm: len(r.equivalents) for r in lexicon.reverse_index(pairs, "norm", ["rank", "headword"]).collect()} == {"k": 3, "one": 1}
    assert column(spark, ["to run", "a", "", None], lexicon.translation_keys) == [["to run", "to", "run"], ["a"], [], []]


def test_unique_reach(spark, pack):
    frase = spark.createDataFrame([(1, "gato"), (2, "perro"), (3, "corriendo"), (4, None), (5, "nada")], "frase_id int, norm string")
    assert {tuple(r) for r in lexicon.unique_reach(frase, pack[0], pack[1].filter("entry_id IS NOT NULL")).collect()} == {(1, 8), (3, 6)}


# Pools, packs, quality


def test_day_seed_is_fixed():
    assert discover.day_seed("2026-01-01", "es", 0) != discover.day_seed("2026-01-02", "es", 0)
    assert -(2**63) <= discover.day_seed("x", "y", -2) < 2**63
    assert len({discover.day_seed("2026-01-01", "es", t) % 1000 for t in range(96)}) > 80


def test_draw_prefers_unseen_and_repeats(spark):
    rows = spark.createDataFrame([(1, p, s, p * 100 + s) for p in (0, 1) for s in range(20)], "tier int, pos_code int, seq int, entry_id int")
    none = rows.limit(0)
    a = [r.entry_id for r in discover.draw(rows, none, 1, 7).collect()]
    assert a == [r.entry_id for r in discover.draw(rows.repartition(5), none, 1, 7).collect()] and len(set(a)) == 20
    b = discover.draw(rows, rows.filter(F.col("entry_id").isin(a)), 1, 7).collect()
    assert not {r.entry_id for r in b} & set(a) and not any(r.restarted for r in b)
    c = discover.draw(rows, rows.filter("seq < 15"), 1, 7).collect()
    assert len(c) == 20 and sum(r.restarted for r in c) == 10
    assert discover.draw(rows, none, 9, 7).count() == 0


def test_words_of_days(spark, pack):
    days = ["2026-01-01", "2026-01-02"]
    rows = discover.words_of_days(spark, pack[0], days, "es", 8).collect()
    assert sorted(r.date for r in rows) == days
    assert discover.words_of_days(spark, pack[0], days, "es", 0).count() == 0


def test_pack_choice(spark):
    rows = [("full", 3, None), ("full", 2, None), ("core", 5, "full"), ("a", 1, "b"), ("b", 1, "a"), ("lone", 1, "absent")]
    got = {(r.pack_id, r.data_version) for r in packs.packs_to_query(spark.createDataFrame(rows, "pack_id string, data_version int, subset_of string")).collect()}
    assert got == {("full", 3), ("a", 1), ("b", 1), ("lone", 1)}


def test_visits_round_trip(spark):
    lines = spark.createDataFrame([("p\x1f1\x1fcasa\x1f",), ("p\x1fx\x1fcasa\x1f",), ("short",), ("\x1f1\x1fcasa\x1f",), ("p\x1f2\x1fir\x1fverb\x1fg\x1fes\x1f77",)], "value string")
    rows = packs.parsed_visits(lines)
    assert {(r.entry_id, r.pos, r.uid) for r in rows.collect()} == {(1, None, None), (2, "verb", 77)}
    assert packs.parsed_visits(packs.visit_lines(rows)).count() == 2


def test_rejection_reasons(spark):
    good = {"schema_version": "4", "pack_id": "p", "name": "n", "kind": "mono", "langs": "es", "fuzzy_profiles": "es", "norm_version": "2", "payload_codec": "deflate-v2", "data_version": "202609211432", "entry_count": "3", "sources": "main\tWiki\tu\tCC\tl"}
    cases = {"good": ({}, None), "schema": ({"schema_version": "3"}, "schema version"), "text": ({"schema_version": "x"}, "metadata"), "gone": ({"name": None}, "metadata"), "langs": ({"langs": "es, en"}, "metadata"), "norm": ({"norm_version": "1"}, "norm version"), "codec": ({"payload_codec": "z"}, "payload codec"), "license": ({"sources": "main\tWiki\tu\t \tl"}, "license"), "none": ({"sources": ""}, "license")}
    rows = [(name, k, v) for name, (change, _) in cases.items() for k, v in (good | change).items() if v is not None]
    got = {r.pack_id: r.reason for r in quality.rejection(spark.createDataFrame(rows, "pack_id string, key string, value string")).collect()}
    assert got == {name: reason for name, (_, reason) in cases.items()}


def test_quality_report_finds_injected_faults(spark):
    entry = spark.createDataFrame([(1, 5, "es", "Árbol", "arbol", "arbol"), (2, 5, "es", "Vaca", "vaca", "vaca"), (3, -1, "es", "x", "", "")], "id bigint, uid bigint, lang string, headword string, norm string, fuzzy string")
    form = spark.createDataFrame([("arboles", 1), ("Árboles", 1), ("z", 99)], "norm string, entry_id bigint")
    pools = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 2, 77)], "tier int, pos_code int, seq int, entry_id bigint")
    staging = spark.createDataFrame([(1, "S\tok\n"), (2, "P\tnoun\n"), (3, "S\ta\nT\tb\nC\tc\n"), (4, "S\ta\nQ\tb\n"), (5, None)], "id bigint, body string")
    found = {r["check"]: r.n_bad for r in quality.report(entry, form, form, pools, staging).collect()}
    assert found == {
        "entry without key": 1, "entry without fuzzy key": 1, "entry key differs from headword": 1, "fuzzy key differs from key": 1, "uid not positive": 1, "form without entry": 1,
        "translation without entry": 1, "form key not normal": 1, "uid shared": 1, "pool with holes": 1, "pool entry missing": 1, "body without sense": 2, "citation without example": 1, "unknown tag": 1,
    }


# Streams


def test_debounce_on_a_stream_equals_the_table(spark, tmp_path):
    rows = [(u, f"q{i}", i * step) for u, step in ((1, 0.05), (2, 0.5)) for i in range(6)]
    df = spark.createDataFrame(rows, "user_id int, text string, s double").select("user_id", "text", F.timestamp_seconds(F.col("s") + 1_750_000_000).alias("ts"))
    want = sorted((r.user_id, r.text) for r in stream.settled(df, "user_id", "text").collect())
    assert want == [(1, "q5")] + [(2, f"q{i}") for i in range(6)]
    path = str(tmp_path / "in")
    late = df.filter("user_id = 1").limit(1).select(F.lit(9).alias("user_id"), F.lit("z").alias("text"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"))
    df.unionByName(late).coalesce(1).write.parquet(path)
    live = stream.settled(stream.keystrokes(spark, path, "user_id int, text string, ts timestamp"), "user_id", "text")
    got = []
    stream.per_batch(live, lambda b, n: got.extend((r.user_id, r.text) for r in b.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(g for g in got if g[0] != 9) == want


# Plans


def test_prefix_search_plans_no_nested_loop_and_prunes_columns(spark, sf_dir):
    from lexiloom.plans import search as plans

    text = plans.q2_prefix(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text and "payload" not in text


def test_every_registered_query_has_unique_name_and_known_oracle():
    from lexiloom.plans import registry

    assert set(registry.oracles()) <= set(registry.queries()) and len(registry.queries()) > 80


def test_thesaurus_takes_keys_of_any_size(spark):
    """Against all pairs: a key of hundreds of entries, forms and equal keys that bar its head, two keys of one entry."""
    rng = random.Random(11)
    entries = [(i, f"w{rng.randrange(200)}" if i % 50 else "", rng.randrange(40)) for i in range(300)]
    keys = [("hot", i) for i in range(300)] + [(f"k{rng.randrange(30)}", i) for i in range(300)] + [("alone", 7), ("gone", 999)]
    norms = {i: n for i, n, _ in entries}
    form = [(n, i) for i in range(0, 300, 2) for n in sorted({n for _, n, r in entries if r < 20})] + [("w1", 1), ("w2", 1)]
    barred, single, want = set(form), [i for i in range(300) if i % 3], set()
    for i in single:
        best = {}
        for key in {k for k, e in keys if e == i}:
            for other in {e for k, e in keys if k == key and e in norms}:
                term, rank = norms[other], entries[other][2]
                if term and term != norms[i] and (term, i) not in barred:
                    best[term] = min(best.get(term, rank), rank)
        want |= {(i, t, p) for p, (t, _) in enumerate(sorted(best.items(), key=lambda x: (x[1], x[0]))[:4], 1)}
    every = spark.createDataFrame(entries, "id bigint, norm string, rank int")
    found = plan_packs.thesaurus(every.filter("id % 3 <> 0"), every, spark.createDataFrame(keys, "key string, entry_id bigint"), spark.createDataFrame(form, "norm string, entry_id bigint"))
    assert {tuple(r) for r in found.collect()} == want and len(want) > 700


def test_thesaurus_query_keeps_a_key_of_twenty_entries(spark, tmp_path):
    columns = "id bigint, loaded_at timestamp, rank int, uid bigint, lang string, headword string, norm string, fuzzy string, pos string, body string, fts_body string, discover int"
    rows = [(i, datetime(2025, 1, 1), i, i, "es", f"w{i:02}", f"w{i:02}", f"w{i:02}", None, "S\tx\n", "x", None) for i in range(20)]
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/staging.parquet")
    spark.createDataFrame([("hot", i) for i in range(20)], "norm string, entry_id bigint").write.parquet(f"{tmp_path}/trans.parquet")
    spark.createDataFrame([("w01", 0)], "norm string, entry_id bigint").write.parquet(f"{tmp_path}/form.parquet")
    found = {(r.id, r.place): r.term for r in plan_packs.pay7_thesaurus(spark, str(tmp_path)).collect()}
    assert len(found) == 80 and [found[0, p] for p in range(1, 5)] == ["w02", "w03", "w04", "w05"] and found[19, 1] == "w00"


def test_empty_probe_asks_the_whole_cascade(spark):
    """A form, a translation and a near spelling are answers; another language's prefix of four letters is none."""
    entries = [(1, "es", "correr"), (2, "es", "perro"), (3, "es", "camino"), (4, "en", "library"), (5, "es", "libretaz"), (6, "fr", "librarian")] + [(10 + i, "en", f"zzzzzz{i:02}") for i in range(12)]
    entry = spark.createDataFrame([(i, la, n, n, n, "noun", i) for i, la, n in entries], "id bigint, lang string, headword string, norm string, fuzzy string, pos string, rank int")
    entry = entry.withColumn("fuzzy", X.fuzzy(F.col("norm"), F.col("lang")))
    form, trans = spark.createDataFrame([("corriendo", 1), ("librar", 4)], "norm string, entry_id bigint"), spark.createDataFrame([("hound", 2), ("libraryx", 5)], "norm string, entry_id bigint")
    asked = [(1, "corriendo", "es"), (2, "hound", "es"), (3, "camion", "es"), (4, "librray", "es"), (5, "zzzzzz", "es"), (6, "libreria", "el"), (7, "nada", "es"), (8, "", "es"), (9, "librarian", "es")]
    queries = spark.createDataFrame(asked, "query_id bigint, q string, q_lang string").withColumn("q_fuzzy", F.lit("wrong"))
    texts = [(1, "es", "nada de nada"), (2, "en", "nada"), (3, "es", "no hay zzzzzz")] + [(20 + i, "es", "librarian aqui") for i in range(11)]
    definitions = spark.createDataFrame(texts, "id bigint, lang string, words string")
    found = {r.query_id: (r.n_definitions, r.n_other) for r in plan_search.empty_probe(queries, entry, form, trans, definitions).collect()}
    assert found == {4: (0, 1), 5: (1, 9), 6: (0, 1), 7: (1, 0), 9: (9, 1)}, found


def test_short_probe_agrees_with_its_sql_on_odd_rows(spark, tmp_path):
    """No language, keys of blanks, marks or one letter, a long key, repeated rows; the columns are those of the SQL too."""
    columns = "id bigint, uid bigint, lang string, headword string, norm string, fuzzy string, pos string, rank int, payload binary, loaded_at timestamp, removed_at timestamp"
    keys = ["perezoso", "perezoso", "pereozso y mas", "       ", "a b c d e f", "á´´´´´´", "zzzzaabc", "x" * 5 + "yz" + "w" * 300, "x" * 5 + "zy" + "w" * 300, "libro", "", None] + [f"zzzz{i}" for i in range(12)]
    rows = [(20 * (i + 1), i, lang, k, k, k, "noun", i, None, datetime(2024, 1, 1 + again), None) for i, k in enumerate(keys) for lang in [("es", "en", None)[i % 3]] for again in range(1 + i % 2)]
    rows += [(7, 7, "es", "pereozso", "pereozso", "pereozso", None, 1, None, datetime(2024, 1, 1), None), (None, 8, "es", "zzzz", "zzzz", "zzzz", None, 1, None, datetime(2024, 1, 1), None)]
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/entry.parquet")
    empty = {"form": "norm string, entry_id bigint", "trans": "norm string, entry_id bigint", "staging": f"{columns}, body string", "frase": "frase_id bigint, lang string, norm string, texto string, loaded_at timestamp"}
    con = duckdb.connect()
    for name, schema in empty.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("entry", *empty):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = con.execute(plan_search.ORACLES["q20_empty_probe"])
    found = plan_search.q20_empty_probe(spark, str(tmp_path))
    assert found.columns == [c[0] for c in want.description]
    expected = sorted(want.fetchall())
    assert sorted(map(tuple, found.collect())) == expected and len(expected) > 5 and {n for _, n in expected} > {9}
