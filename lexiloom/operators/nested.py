"""Deeply nested dictionary records as related flat tables.

Each JSON text is parsed once and walked bottom-up by a tree automaton: every value gets a state from its own kind and the
states of its members, and the state decides the variant it is stored as. Each variant of each kind is routed to a typed
table of its own; the keys, places and parent links they all share make up the supertype.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.session import ensure_checkpoint_dir

#: The grammar: kind of node -> its nested arrays, as field -> kind of their members.
GRAMMAR: dict[str, dict[str, str]] = {
    "record": {"forms": "form", "senses": "sense"},
    "form": {"tags": "tag"},
    "sense": {"glosses": "gloss", "tags": "tag", "examples": "example", "synonyms": "synonym"},
    "example": {"tags": "tag"},
    "synonym": {"tags": "tag"},
    "gloss": {},
    "tag": {},
}
#: The field of an object that holds its text, by kind.
TEXT_FIELD = {"record": "word", "form": "form", "example": "text", "synonym": "word", "gloss": "text", "tag": "name", "sense": "gloss"}
#: Further fields of objects that have a column of their own; all others are kept together as JSON in ``extra``.
TYPED_FIELDS = {"record": ("pos", "lang", "lang_code"), "form": ("roman",), "example": ("ref", "type"), "synonym": ("sense",), "sense": ("id",), "gloss": (), "tag": ()}
#: The variants an automaton's state can end in. Objects: ``leaf`` without nested nodes, ``branch`` with some, ``loose`` with a
#: lone value in the place of a nested array. Others: ``text`` for a bare value, ``list`` for an array inside an array.
VARIANTS = {kind: ("leaf", "branch", "loose") if kind == "record" else ("leaf", "branch", "loose", "text", "list") if GRAMMAR[kind] else ("leaf", "text", "list") for kind in GRAMMAR}

NODE_FIELDS = {
    "node_path": T.StringType(), "parent_path": T.StringType(), "kind": T.StringType(), "variant": T.StringType(), "place": T.IntegerType(),
    "depth": T.IntegerType(), "text": T.StringType(), "fields": T.StringType(),
}
#: Rows of one Arrow batch that leaves the parser.
BATCH_NODES = 20_000
ROOT = ""


def classify(value: object, states: dict[str, str]) -> str | None:
    """The automaton's transition: the variant of a value, from its own shape and the states of its arrays.

    ``None`` for what is no node: null, blank text.
    """
    if value is None or isinstance(value, str) and not value.strip():
        return None
    if isinstance(value, list):
        return "list"
    if not isinstance(value, dict):
        return "text"
    if "lone" in states.values():
        return "loose"
    return "branch" if "some" in states.values() else "leaf"


def _whole(digits: str) -> int | str:
    """An integer; one that is longer than JSON readers take keeps its digits as a text."""
    return int(digits) if len(digits) < 500 else digits


def _no_number(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _scalar(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def record_nodes(text: str | None) -> list[tuple]:
    """All nodes of one JSON text, the record first and children after their parents; empty if it is no complete JSON object."""
    if text is None:
        return []
    try:
        record = json.loads(text, parse_constant=_no_number, parse_int=_whole)
    except (ValueError, RecursionError):
        return []
    if not isinstance(record, dict):
        return []
    out: list[tuple] = [()]
    states = _walk(record, "record", ROOT, 0, out)
    out[0] = (ROOT, None, "record", classify(record, states), 0, 0, *_contents(record, "record"))
    return out


def _contents(value: object, kind: str) -> tuple[str | None, str | None]:
    """``(text, other fields as JSON)`` of a node; what is stored as nodes of its own is left out, all else is kept."""
    if not isinstance(value, dict):
        return _scalar(value), None
    nested = GRAMMAR[kind]
    rest = {k: v for k, v in value.items() if k not in nested and k != TEXT_FIELD[kind]}
    return _scalar(value.get(TEXT_FIELD[kind])), json.dumps(rest, ensure_ascii=False, sort_keys=True) if rest else None


def _walk(value: dict, kind: str, path: str, depth: int, out: list[tuple]) -> dict[str, str]:
    """Adds the nodes below ``value`` to ``out`` and gives the state of each of its nested places."""
    states: dict[str, str] = {}
    for field, child_kind in GRAMMAR[kind].items():
        held = value.get(field)
        lone = held is not None and not isinstance(held, list)
        members = [held] if lone else held or []
        found = False
        for place, member in enumerate(members):
            at = len(out)
            node = f"{path}/{field}/{place}" if path else f"{field}/{place}"
            out.append(())  # the place of the node, before its children; its variant is known after them
            below = _walk(member, child_kind, node, depth + 1, out) if isinstance(member, dict) else {}
            variant = classify(member, below)
            if variant is None:
                del out[at:]
                continue
            found = True
            out[at] = (node, path, child_kind, variant, place, depth + 1, *_contents(member, child_kind))
        states[field] = "none" if not found else "lone" if lone else "some"
    return states


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) batches to (key, node...) batches of bounded size."""
    types = [pa.int32() if isinstance(t, T.IntegerType) else pa.string() for t in NODE_FIELDS.values()]

    def emit(keys: list, nodes: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array([n[i] for n in nodes], t) for i, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([pa.array(keys, key_type), *columns], ["_k", *NODE_FIELDS])

    for batch in batches:
        keys, nodes = [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = record_nodes(text)
            keys += [key] * len(found)
            nodes += found
            if len(nodes) >= BATCH_NODES:
                yield emit(keys, nodes, batch.schema.field(0).type)
                keys, nodes = [], []
        if nodes:
            yield emit(keys, nodes, batch.schema.field(0).type)


def node_table(df: DataFrame, key: str = "rec_id", text: str = "raw_json") -> DataFrame:
    """One row for each distinct node of each record, the record itself (path ``""``) among them, all kinds in one frame.

    A record that is delivered again, written differently but with the same content, gives the same rows once. Null
    members and blank strings are no nodes but keep their place; any object is a node, also an empty one; a lone value
    instead of an array is its member 0; a list inside an array is a node of variant ``list`` that keeps its members as
    JSON. Texts that are null, cut off, no JSON object, or nested deeper than the parser can go (some thousand levels) have no nodes; ``NaN`` and ``Infinity`` are no JSON.
    Columns of ``df`` other than the two named are ignored. Nothing is grouped by record, so a record of any size is only
    ever one row of one task.
    """
    # Equal texts are parsed once; the parse is a narrow step whose rows leave Python as flat Arrow batches.
    texts = df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).filter("_t IS NOT NULL").distinct()
    schema = T.StructType([T.StructField("_k", texts.schema["_k"].dataType)] + [T.StructField(n, t) for n, t in NODE_FIELDS.items()])
    return texts.mapInArrow(_parse_batches, schema).distinct().withColumnRenamed("_k", key)


class VariantTables:
    """The typed tables of a collection: one for each variant of each kind, routed to a folder of its own in one parse.

    ``path/kind=K/variant=V`` holds the rows of a variant, so reading one reads nothing of the others; the whole folder is
    the supertype. Children join to parents on ``(key, parent_path) = (key, node_path)``.
    """

    def __init__(self, df: DataFrame, path: str, key: str = "rec_id", text: str = "raw_json"):
        self.spark, self.path, self.key = df.sparkSession, path, key
        nodes = node_table(df, key, text)
        self.schema = nodes.schema
        nodes.write.mode("overwrite").partitionBy("kind", "variant").parquet(path)

    def supertype(self) -> DataFrame:
        """``(key, node_path, parent_path, kind, variant, place, depth)`` of every node."""
        return self._all().select(self.key, "node_path", "parent_path", "kind", "variant", "place", "depth")

    def _all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def subtype(self, kind: str, variant: str) -> DataFrame:
        """The typed table of a variant: the common keys, then the columns of its kind as far as the variant has them.

        Bare values have a text only; objects have their typed fields and, in ``extra``, all other fields as JSON.
        """
        if variant not in VARIANTS[kind]:
            raise ValueError(f"{kind} has no variant {variant}")
        rows = self._all().filter((F.col("kind") == kind) & (F.col("variant") == variant))
        own = [F.col("text").alias(TEXT_FIELD[kind])]
        if variant not in ("text", "list"):
            typed = TYPED_FIELDS[kind]
            own += [F.get_json_object("fields", f"$.{name}").alias(name) for name in typed]
            own.append(self._extra(typed))
        return rows.select(self.key, "node_path", "parent_path", "place", *own)

    @staticmethod
    def _extra(typed: tuple[str, ...]) -> Column:
        """The fields without a column, as a map of JSON texts; null if there is none."""
        every = F.from_json("fields", "map<string,string>")
        rest = F.map_filter(every, lambda name, _: ~name.isin(*typed)) if typed else every
        return F.when(F.size(rest) > 0, rest).alias("extra")


def variant_tables(df: DataFrame, key: str = "rec_id", text: str = "raw_json") -> VariantTables:
    """``VariantTables`` in a new folder beside the checkpoints."""
    return VariantTables(df, f"{ensure_checkpoint_dir(df.sparkSession)}/nested-{uuid.uuid4().hex}", key, text)
