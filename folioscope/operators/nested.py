"""Nested OCR responses into related flat tables.

A bottom-up tree automaton reads every JSON value once. The state of an object is its *shape* (canonical keys with the
states below them), and with a state go the kinds of object that it can be (blocks, lines, cells, ...: it has a key of the
kind, and the lists in it hold objects that can be of the kind's children) and its typed columns. States run upwards and
know nothing of where an object stands; the walk down then accepts an object in a list if its state can be of the list's
kind. Every (kind, shape) is a *variant* with a subtype table of its own, typed by its state; an object that its list
does not accept keeps its place in a variant of its own. All variants of a kind share the supertype's columns:
(response_id, path) as key and parent_path as link, so that blocks, lines, tables, cells, items, taxes and structured
fields join back to their parents. Columns of a supertype are typed, all other attributes stay in ``more``.

Defined results: a null, blank, truncated or otherwise unreadable payload gives no rows; a payload or a part that is
itself JSON in a string is read through; an object where a list belongs is element 0; an object whose keys are all
indexes is the list in delivered order; nulls in lists keep their place and give no row; keys count in any spelling
(``structuredFields``, ``structured_fields``); repeated deliveries give equal rows, which count once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (table, list key in canonical spelling, table of its elements, spelling in paths); "" is the record itself.
GRAMMAR: dict[str, list[tuple[tuple[str, ...], str]]] = {
    "record": [
        (("layout", "blocks"), "blocks"),
        (("layout", "tables"), "tables"),
        (("fields", "items"), "items"),
        (("structured_fields",), "structured_fields"),
    ],
    "blocks": [(("lines",), "lines")],
    "tables": [(("cells",), "cells")],
    "items": [(("taxes",), "taxes")],
}
WRAPPERS = ("result", "response", "data")
NODE_SCHEMA = "response_id BIGINT, path STRING, parent_path STRING, node_table STRING, accepted BOOLEAN, ordinal INT, shape STRING, columns STRING, attributes STRING"
#: Keys that make an object one of a kind; a kind's child lists are those of GRAMMAR.
KEYS: dict[str, frozenset[str]] = {
    "blocks": frozenset({"block_id", "type", "text", "lines"}), "lines": frozenset({"line_number", "text", "confidence", "bbox", "language"}), "tables": frozenset({"table_id", "rows", "cols", "headers", "cells"}),
    "cells": frozenset({"row", "col", "text"}), "items": frozenset({"description", "quantity", "unit_price", "taxes"}), "taxes": frozenset({"code", "amount"}),
    "structured_fields": frozenset({"label", "value", "field_name", "confidence", "is_valid"}),
}
EVERY = frozenset(KEYS)
#: Types of columns by the state of their value.
TYPES = {"s": "STRING", "b": "BOOLEAN", "n": "DOUBLE", "0": "STRING"}

#: Typed columns of each subtype table, from the common attributes.
SUBTYPES: dict[str, dict[str, str]] = {
    "blocks": {"block_id": "INT", "type": "STRING", "text": "STRING"},
    "lines": {"line_number": "INT", "text": "STRING", "confidence": "DOUBLE", "language": "STRING"},
    "tables": {"table_id": "INT", "rows": "INT", "cols": "INT"},
    "cells": {"row": "INT", "col": "INT", "text": "STRING"},
    "items": {"description": "STRING", "quantity": "DOUBLE", "unit_price": "STRING"},
    "taxes": {"code": "STRING", "amount": "STRING"},
    "structured_fields": {"label": "STRING", "value": "STRING", "field_name": "STRING", "confidence": "DOUBLE", "is_valid": "BOOLEAN"},
}


@lru_cache(100_000)
def canonical(key: str) -> str:
    """``lineNumber``, ``Line-Number`` and ``line_number`` are one key."""
    out = []
    for i, c in enumerate(key.strip()):
        if c.isupper() and i and key[i - 1].islower():
            out.append("_")
        out.append("_" if c in " -." else c.lower())
    return "".join(out)


def read_json(value: object) -> object:
    """``value`` with JSON in strings read through, as often as it is wrapped; None if it cannot be read."""
    while isinstance(value, str):
        if value[:1] not in '{["' and value.lstrip()[:1] not in ("{", "[", '"'):
            return None
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return None
    return value


def child(node: object, key: str) -> object:
    """The part of an object under ``key`` in any spelling, the exact one first."""
    if not isinstance(node, dict):
        return None
    if key in node:
        return node[key]
    return next((v for k, v in node.items() if canonical(k) == key), None)


def elements(value: object) -> list:
    """A list as delivered, from a list, an index-keyed object or an object standing alone."""
    value = read_json(value) if isinstance(value, str) else value
    if isinstance(value, dict):
        return list(value.values()) if value and all(k.isdecimal() for k in value) else [value]
    return value if isinstance(value, list) else []


class States:
    """The automaton's states met so far: for each word of keys and states below, its name, kinds and columns."""

    def __init__(self) -> None:
        self.names: dict[tuple, str] = {}
        self.kinds: dict[str, frozenset[str]] = dict.fromkeys("sbn0", EVERY)
        self.columns: dict[str, str] = {}

    def of(self, node: object) -> str:
        """The state of a value: equal for values of the same structure."""
        if isinstance(node, dict):
            word = ("{", *sorted((canonical(k), self.of(v)) for k, v in node.items()))
        elif isinstance(node, list):
            word = ("[", *sorted({self.of(v) for v in node}))
        else:
            return {str: "s", bool: "b", int: "n", float: "n", type(None): "0"}[type(node)]
        if word not in self.names:
            self._add(word)
        return self.names[word]

    def _add(self, word: tuple) -> None:
        name = self.names[word] = hashlib.md5(repr(word).encode()).hexdigest()[:12]
        if word[0] == "[":  # of the kinds that all its elements can be
            self.kinds[name] = EVERY.intersection(*(self.kinds[e] for e in word[1:]))
            return
        below = dict(word[1:])
        lists = {kind: [(keys[0], child) for keys, child in GRAMMAR.get(kind, ()) if keys[0] in below] for kind in KEYS}
        fits = {kind for kind, keys in KEYS.items() if keys & below.keys() and all(child in self.kinds[below[k]] for k, child in lists[kind])}
        if below and all(k.isdecimal() for k in below):  # an index-keyed list
            fits |= EVERY.intersection(*(self.kinds[e] for e in below.values()))
        self.kinds[name] = frozenset(fits)
        self.columns[name] = ", ".join(f"{k} {TYPES.get(e, 'STRING')}" for k, e in word[1:] if e != "0")


def nodes(payload: str | None, states: States) -> Iterator[tuple]:
    """(path, parent_path, table, accepted, ordinal, shape, columns, attributes) of every object in the lists of GRAMMAR."""
    record = read_json(payload)
    for wrapper in WRAPPERS:
        inner = child(record, wrapper)
        inner = read_json(inner) if isinstance(inner, str) else inner
        if isinstance(inner, dict) and child(record, "layout") is None and child(record, "fields") is None:
            record = inner
    stack = [("", "record", record)]
    while stack:
        path, kind, node = stack.pop()
        for keys, table in GRAMMAR.get(kind, ()):
            value = node
            for key in keys:
                value = child(read_json(value) if isinstance(value, str) else value, key)
            for i, element in enumerate(elements(value)):
                element = read_json(element) if isinstance(element, str) else element
                if not isinstance(element, dict):
                    continue
                at = f"{path}.{'.'.join(keys)}[{i}]".lstrip(".")
                flat = {canonical(k): v if isinstance(v, (str, int, float, bool)) else json.dumps(v, ensure_ascii=False) for k, v in element.items() if v is not None}
                state = states.of(element)
                yield at, path, table, table in states.kinds[state], i, state, states.columns[state], json.dumps(flat, ensure_ascii=False)
                stack.append((at, table, element))


def response_nodes(responses: DataFrame, key: str = "response_id", payload: str = "payload") -> DataFrame:
    """Every object of the nested lists with table, shape, parent link and attributes; payloads never leave their task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states = States()
        for batch in batches:
            if len(states.names) > 100_000:  # states are named anew when met again, and alike
                states = States()
            rows = []
            for rid, text in zip(batch[key], batch[payload]):
                try:
                    rows += [(rid, *row) for row in nodes(text, states)]
                except RecursionError:
                    continue
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])

    return responses.select(F.col(key).cast("bigint").alias(key), payload).where(f"{payload} IS NOT NULL AND {key} IS NOT NULL").mapInPandas(run, NODE_SCHEMA)


def subtype(found: DataFrame, table: str) -> DataFrame:
    """All variants of one kind under their supertype: key, parent link, shape, the columns of SUBTYPES, and in ``more`` all
    other attributes as JSON, null without any."""
    wanted = SUBTYPES[table]
    parsed = F.from_json("attributes", "MAP<STRING,STRING>")

    def typed(name: str, kind: str) -> Column:
        raw = F.col("attrs")[name]
        return raw.alias(name) if kind == "STRING" else raw.try_cast(kind).alias(name)

    rest = F.map_filter("attrs", lambda k, v: ~k.isin(*wanted))
    more = F.when(F.size(rest) > 0, F.to_json(rest)).alias("more")
    rows = found.where(F.col("node_table") == table).withColumn("attrs", parsed)
    return rows.select("response_id", "path", "parent_path", "ordinal", "shape", "accepted", *(typed(n, k) for n, k in wanted.items()), more).distinct()


def variants(found: DataFrame) -> DataFrame:
    """(node_table, shape, accepted, columns, objects) of every variant; an object delivered twice counts once."""
    return found.dropDuplicates(["response_id", "path"]).groupBy("node_table", "shape", "accepted", "columns").agg(F.count("*").alias("objects"))


def variant(found: DataFrame, table: str, shape: str, columns: str) -> DataFrame:
    """The subtype table of one variant: the supertype's key and link, and the variant's own columns with their types."""
    rows = found.where((F.col("node_table") == table) & (F.col("shape") == shape)).withColumn("_a", F.from_json("attributes", columns))
    return rows.select("response_id", "path", "parent_path", "ordinal", "_a.*").distinct()


def write_variants(found: DataFrame, path: str) -> None:
    """Every variant into a directory of its own (node_table=.../shape=...), in one pass; ``variant`` reads one typed."""
    found.dropDuplicates(["response_id", "path"]).write.mode("overwrite").partitionBy("node_table", "shape").parquet(path)
