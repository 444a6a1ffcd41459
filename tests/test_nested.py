import json

from folioscope.operators import nested as N

RECORD = {
    "layout": {"blocks": [{"block_id": 1, "lines": {"line_number": 1}}, None, {"blockId": 2, "lines": [{"text": "a"}, None, {"text": "b"}]}], "tables": {"0": {"cells": [{"row": 0}]}, "1": {"cells": []}}},
    "fields": {"items": {"description": "x", "taxes": [{"code": "A"}]}}, "structuredFields": [{"label": "L", "isValid": True}],
}
PATHS = {
    "layout.blocks[0]", "layout.blocks[0].lines[0]", "layout.blocks[2]", "layout.blocks[2].lines[0]", "layout.blocks[2].lines[2]", "layout.tables[0]", "layout.tables[0].cells[0]", "layout.tables[1]", "fields.items[0]",
    "fields.items[0].taxes[0]", "structured_fields[0]",
}


def paths(payload):
    return {n[0] for n in N.nodes(payload, N.States())}


def test_spellings_wrappers_and_strings():
    assert paths(json.dumps(RECORD)) == PATHS
    assert paths(json.dumps(json.dumps(RECORD))) == PATHS
    assert paths(json.dumps({"page_number": 1, "result": RECORD})) == PATHS
    assert paths(json.dumps(RECORD | {"layout": json.dumps(RECORD["layout"])})) == PATHS


def test_unreadable():
    for bad in (None, "", "  ", "null", "{}", "[]", "7", '"x"', json.dumps(RECORD)[:-20], "[" * 5000, '{"layout": null, "fields": 3}'):
        assert paths(bad) == set()


def test_shapes_depend_on_structure_only():
    states = N.States()
    a, b, c = states.of({"x": 1, "yZ": ["a"]}), states.of({"y_z": ["b", "c"], "x": 2.5}), states.of({"x": "1", "yZ": ["a"]})
    assert a == b != c


def test_states_say_what_an_object_can_be():
    states = N.States()
    kinds = lambda o: states.kinds[states.of(o)]
    assert kinds({"text": "a"}) == {"blocks", "lines", "cells"} and kinds({"row": 1, "text": "a"}) >= {"cells"} and kinds({"odd": 1}) == set()
    assert "blocks" in kinds({"block_id": 1, "lines": [{"text": "a"}, None]}) and "blocks" not in kinds({"block_id": 1, "lines": [{"code": "A", "amount": 2}]})
    assert "items" in kinds({"description": "d", "taxes": {"0": {"code": "A"}}}) and "blocks" in kinds({"lines": []})
    odd = json.dumps({"layout": {"blocks": [{"odd": 1}, {"block_id": 2}]}})
    assert [(n[0], n[3]) for n in N.nodes(odd, states)] == [("layout.blocks[0]", False), ("layout.blocks[1]", True)]


def test_tables(spark):
    rows = [(1, json.dumps(RECORD), "z"), (1, json.dumps(RECORD), "z"), (2, None, "z"), (3, "{", "z"), (None, json.dumps(RECORD), "z")]
    found = N.response_nodes(spark.createDataFrame(rows, "response_id BIGINT, payload STRING, path STRING"))
    assert {r.path for r in found.collect()} == PATHS and found.select("response_id").distinct().count() == 1
    lines = {r.path: (r.parent_path, r.text) for r in N.subtype(found, "lines").collect()}
    assert lines["layout.blocks[2].lines[2]"] == ("layout.blocks[2]", "b") and len(lines) == 3
    assert N.subtype(found, "structured_fields").first().is_valid is True
    assert N.response_nodes(spark.createDataFrame([], "response_id BIGINT, payload STRING")).count() == 0


def test_variants_keep_every_attribute(spark, tmp_path):
    rows = [(1, json.dumps({"layout": {"tables": [{"table_id": 1, "headers": ["a"], "odd": True}, {"table_id": 2}]}}))]
    found = N.response_nodes(spark.createDataFrame(rows, "response_id BIGINT, payload STRING"))
    more = {r.path: r.more for r in N.subtype(found, "tables").collect()}
    assert json.loads(more["layout.tables[0]"]) == {"headers": '["a"]', "odd": "true"} and more["layout.tables[1]"] is None
    listed = {r.columns: r for r in N.variants(found).collect()}
    assert set(listed) == {"headers STRING, odd BOOLEAN, table_id DOUBLE", "table_id DOUBLE"}
    first = listed["headers STRING, odd BOOLEAN, table_id DOUBLE"]
    N.write_variants(found, str(tmp_path / "v"))
    for source in (found, spark.read.parquet(str(tmp_path / "v"))):
        row = N.variant(source, "tables", first["shape"], first["columns"]).first()
        assert (row.path, row.headers, row.odd, row.table_id) == ("layout.tables[0]", '["a"]', True, 1.0)
