"""Snapshots, orphan references and nested records: edge cases and brute-force twins."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import nested, orphans, snapshots

T0 = datetime(2025, 1, 1)


def at(day):
    return T0 + timedelta(days=day)


SNAP = "data_version bigint, uid bigint, headword string, payload binary, loaded_at timestamp_ntz, _v string, change_kind string"


def changes(spark, rows):
    df = spark.createDataFrame([(v, u, h, p, t, "x", "y") for v, u, h, p, t in rows], SNAP)
    out = snapshots.snapshot_changes(df)
    return sorted(map(tuple, out.collect()), key=repr)


def test_snapshot_kinds_nulls_repeats_and_late_rows(spark):
    rows = [
        (1, 1, "a", b"p", at(0)), (1, 2, "b", b"p", at(0)), (1, 3, None, None, at(0)), (1, None, "n", b"x", at(0)),
        (2, 1, "a", b"p", at(1)), (2, 1, "a", b"p", at(1)), (2, 3, None, b"", at(1)), (2, 4, "d", None, at(1)), (2, None, "n", b"x", at(1)),
        (5, 1, "old", b"p", at(2)), (5, 1, "a", b"p", at(9)), (5, 4, "d", None, at(2)), (5, 3, None, b"", at(2)),
        (None, 9, "z", b"z", at(2)),
    ]
    assert changes(spark, rows) == sorted([(2, 2, "removed"), (2, 3, "changed"), (2, 4, "added"), (5, None, "removed")], key=repr)


def test_snapshot_column_borders_count(spark):
    assert changes(spark, [(1, 1, "ab", b"c", at(0)), (2, 1, "a", b"bc", at(0))]) == [(2, 1, "changed")]


def test_snapshot_empty_and_single(spark):
    assert changes(spark, []) == []
    assert changes(spark, [(1, 1, "a", b"p", at(0))]) == []


def test_snapshot_tie_is_defined(spark):
    a = changes(spark, [(1, 1, "a", b"p", at(0)), (2, 1, "x", b"p", at(1)), (2, 1, "a", b"p", at(1))])
    b = changes(spark, [(1, 1, "a", b"p", at(0)), (2, 1, "a", b"p", at(1)), (2, 1, "x", b"p", at(1))])
    assert a == b


def brute_orphans(refs, parents):
    out = []
    for name, key, t in refs:
        if key is None:
            continue
        lives = [(f, e) for i, f, e in parents if i == key and f is not None]
        if t is None or not any(f <= t and (e is None or t < e) for f, e in lives):
            out.append((name, key, t))
    return sorted(out, key=repr)


def spark_orphans(spark, refs, parents):
    r = spark.createDataFrame([(n, k, t, "clash", 1) for n, k, t in refs], "norm string, entry_id bigint, loaded_at timestamp_ntz, runs string, block int")
    p = spark.createDataFrame([(i, f, e, "x") for i, f, e in parents], "id bigint, loaded_at timestamp_ntz, removed_at timestamp_ntz, norm string")
    return sorted([tuple(x) for x in orphans.orphan_references(r, p).select("norm", "entry_id", "loaded_at").collect()], key=repr)


def test_orphans_against_brute_force(spark):
    rng = random.Random(5)
    parents = []
    for i in list(range(1, 60)) + list(range(250, 262)) + [2**40, -7, 2**63 - 1, 2**63 - 2, -(2**63)]:
        day = rng.randrange(5)
        for _ in range(rng.choice([1, 1, 1, 2, 3])):
            end = day + rng.randrange(1, 6)
            open_end = rng.random() < 0.3
            parents.append((i, at(day), None if open_end else at(end)))
            day = end + rng.randrange(0, 3)
            if open_end:
                break
    parents += [(5, at(3), at(2)), (None, at(0), None), (6, None, None)] + parents[:4]
    refs = [(f"k{n}", rng.choice([*range(-70, 65), *range(248, 265), 2**40, 2**63 - 1, 2**63 - 3, -(2**63), 2**62 + 1, None]), at(rng.randrange(20))) for n in range(600)]
    refs += [("null time", 1, None), ("twice", 999, at(1)), ("twice", 999, at(1))]
    assert spark_orphans(spark, refs, parents) == brute_orphans(refs, parents)


@pytest.mark.parametrize("in_row", [1, 3, 64, 10**6])
def test_orphans_of_an_id_with_very_many_lives(spark, monkeypatch, in_row):
    """However many lives a row of the index holds, the rows found are the same."""
    runs = orphans.key_runs
    monkeypatch.setattr(orphans, "key_runs", lambda lives: runs(lives, in_row))
    parents = [(7, at(2 * n), at(2 * n + 1)) for n in range(75)] + [(7, at(500), None), (8, at(0), None), (9, at(0), at(2)), (9, at(4), at(6)), (10, at(0), at(2)), (10, at(4), at(6))]
    refs = [(f"k{n}", 7, at(n)) for n in range(160)] + [("open", 7, at(600)), ("gap", 7, at(450)), ("early", 7, at(-5)), ("ok", 8, at(3)), ("none", 7, None), ("eleven", 11, at(5)), ("six", 6, at(400))]
    refs += [(f"m{n}", i, at(n)) for i in (9, 10) for n in range(-1, 9)]
    assert spark_orphans(spark, refs, parents) == brute_orphans(refs, parents)


def test_orphans_reasons_and_empty_tables(spark):
    r = spark.createDataFrame([("a", 1, at(0)), ("b", 1, at(9)), ("c", 2, at(1))], "norm string, entry_id bigint, loaded_at timestamp_ntz")
    p = spark.createDataFrame([(1, at(3), at(5))], "id bigint, loaded_at timestamp_ntz, removed_at timestamp_ntz")
    assert {x.norm: x.orphan_reason for x in orphans.orphan_references(r, p).collect()} == {"a": "before", "b": "removed", "c": "never"}
    assert orphans.orphan_references(r, p.limit(0)).count() == 3
    assert orphans.orphan_references(r.limit(0), p).count() == 0


def test_runs_are_contiguous(spark):
    p = spark.createDataFrame([(i, at(0), None) for i in (*range(1, 101), *range(200, 300))], "id bigint, loaded_at timestamp_ntz, removed_at timestamp_ntz")
    runs = orphans.key_runs(orphans.merged_lives(p, "id", "loaded_at", "removed_at")).collect()
    assert sorted((r.s, r.e, r.upto) for r in runs) == [(1, 63, 63), (64, 100, 127), (200, 255, 255), (256, 299, 319)]


RECORD = {
    "word": "x",
    "forms": [{"form": "xs", "tags": ["plural", "  ", None]}, None, "bare", " ", {}],
    "senses": {"glosses": "one", "tags": ["t"], "examples": [{"text": "e", "tags": "lone"}, None], "synonyms": [{}, {"word": "s", "tags": ["a", "", "b"]}]},
}


def paths(spark, texts):
    df = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "rec_id bigint, kind string, raw_json string")
    return {(r.rec_id, r.node_path) for r in nested.variant_tables(df).supertype().filter("kind <> 'record'").select("rec_id", "node_path").collect()}


def test_nested_places(spark):
    assert {p for _, p in paths(spark, [json.dumps(RECORD)])} == {
        "forms/0", "forms/0/tags/0", "forms/2", "forms/4", "senses/0", "senses/0/glosses/0", "senses/0/tags/0",
        "senses/0/examples/0", "senses/0/examples/0/tags/0", "senses/0/synonyms/0", "senses/0/synonyms/1",
        "senses/0/synonyms/1/tags/0", "senses/0/synonyms/1/tags/2",
    }


def test_nested_texts_without_nodes(spark):
    whole = json.dumps(RECORD)
    assert paths(spark, [whole[:-1], "", None, "null", "[]", "3", '{"forms": null, "senses": ""}', "{" * 100000]) == set()


def test_nested_repeats_links_and_variants(spark):
    df = spark.createDataFrame([(1, json.dumps(RECORD)), (1, json.dumps(RECORD, indent=2, sort_keys=True))], "rec_id bigint, raw_json string")
    tables = nested.variant_tables(df)
    nodes = tables.supertype().collect()
    assert len(nodes) == len({r.node_path for r in nodes}) == 14
    parents = {r.node_path for r in nodes}
    assert all(r.parent_path in parents for r in nodes if r.kind != "record")
    assert {(r.node_path, r.variant) for r in nodes} >= {("", "loose"), ("senses/0", "loose"), ("forms/0", "branch"), ("forms/4", "leaf"), ("forms/2", "text"), ("senses/0/examples/0", "loose")}
    held = {(k, v): tables.subtype(k, v).collect() for k, variants in nested.VARIANTS.items() for v in variants}
    assert sorted((k, v, r.node_path) for (k, v), rows in held.items() for r in rows) == sorted((r.kind, r.variant, r.node_path) for r in nodes)
    with pytest.raises(ValueError):
        tables.subtype("record", "text")


def test_nested_loses_no_field(spark):
    record = {"word": "w", "pos": None, "lang": "L", "sounds": [{"ipa": "x"}], "forms": [{"form": "f", "roman": 3, "extra": {"a": [1]}}, ["in", ["list"]]], "senses": [{"glosses": [{"text": "g", "why": "so"}], "tags": [{"name": "t", "n": 1}], "id": "s1"}]}
    texts = [json.dumps(record)[:-1] + ', "n": ' + "7" * 5000 + "}", '{"word": NaN, "forms": ["a"]}', '{"forms": [Infinity]}']
    tables = nested.variant_tables(spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "rec_id bigint, raw_json string, kind string"))
    one = lambda kind, variant: tables.subtype(kind, variant).collect()[0].asDict()
    root = one("record", "branch")
    assert (root["word"], root["pos"], root["lang"]) == ("w", None, "L") and json.loads(root["extra"]["sounds"]) == record["sounds"] and len(root["extra"]["n"]) == 5000
    form = one("form", "leaf")
    assert (form["form"], form["roman"], json.loads(form["extra"]["extra"])) == ("f", "3", {"a": [1]})
    assert json.loads(one("form", "list")["form"]) == ["in", ["list"]]
    assert one("gloss", "leaf")["extra"] == {"why": "so"} and one("tag", "leaf")["extra"] == {"n": "1"} and one("sense", "branch")["id"] == "s1"
    assert {r.rec_id for r in tables.supertype().collect()} == {0}


def test_nested_very_long_record(spark):
    big = json.dumps({"forms": [{"form": str(i), "tags": ["a"]} for i in range(30000)]})
    df = spark.createDataFrame([(1, big)], "rec_id bigint, raw_json string")
    assert nested.node_table(df).agg(F.count("*")).collect()[0][0] == 60001


def test_registered_queries_run(spark, sf_dir):
    from lexiloom.plans import problems

    for name, query in problems.QUERIES.items():
        assert query(spark, sf_dir).count() > 0, name
