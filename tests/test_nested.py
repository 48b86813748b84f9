import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexicarta.functions.jsonevents import Unreadable, events
from lexicarta.operators import nested
from tests.conftest import rows

LISTS, WRAPPERS = ("images", "boxes", "tables"), ("wrapped",)


def rebuild(text):
    """The value that the events describe."""
    stack, keys, root = [], [], []
    def put(v):
        if not stack:
            root.append(v)
        elif isinstance(stack[-1], dict):
            stack[-1][keys.pop()] = v
        else:
            stack[-1].append(v)
    for kind, value in events(text):
        if kind in "{[":
            put(new := {} if kind == "{" else [])
            stack.append(new)
        elif kind in "}]":
            stack.pop()
        elif kind == "key":
            keys.append(value)
        else:
            put({"string": lambda: value, "number": lambda: json.loads(value), "bool": lambda: value == "true", "null": lambda: None}[kind]())
    return root[0]


VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(VALUES, st.sampled_from([None, 1]))
def test_events_rebuild_what_json_reads(value, indent):
    assert rebuild(json.dumps(value, indent=indent)) == value
    assert rebuild(json.dumps(value, ensure_ascii=False)) == value


@settings(max_examples=150, deadline=None)
@given(VALUES, st.integers(0, 60))
def test_truncated_texts_are_read_like_json_reads_them(value, size):
    text = json.dumps(value)[:size]
    try:
        json.loads(text)
    except ValueError:
        with pytest.raises(Unreadable):
            list(events(text))
    else:
        list(events(text))


@pytest.mark.parametrize("text", ["", "[1,]", "{,}", '{"a"}', '{"a":1,}', "[1 2]", "]", '{"a":1}}', "nul", "01", '"\t"', "[1]x", '{1:2}', "{]"])
def test_broken_texts(text):
    with pytest.raises(Unreadable):
        list(events(text))


def children(text):
    return {(g, o) for g, o, p, k, _ in nested.record_triples(text, LISTS, WRAPPERS) if p == "" and k != "null" and g.endswith("[]")}


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (None, set()),
        ("", set()),
        ("null", set()),
        ('{"images": [{"a": 1}, null, {}]}', {("images[]", (0,)), ("images[]", (2,))}),
        ('{"images": {"a": 1}}', {("images[]", (0,))}),
        ('{"images": "[{\\"a\\": 1}, null]"}', {("images[]", (0,))}),
        ('{"images": "{\\"a\\": 1}"}', {("images[]", (0,))}),
        ('{"images": "[{\\"a\\": 1"}', set()),
        ('{"tables": "| a | b |"}', {("tables[]", (0,))}),
        ('{"tables": ""}', set()),
        ('{"tables": "null"}', set()),
        (json.dumps(json.dumps({"boxes": [1]})), {("boxes[]", (0,))}),
        ('{"wrapped": {"boxes": [1, 2]}, "by": "x"}', {("boxes[]", (0,)), ("boxes[]", (1,))}),
        ('﻿ {"boxes": [1]}\n', {("boxes[]", (0,))}),
        ('{"boxes": [1], "images": [', set()),
        ('{"Images": [{"box": [5, 6]}]}', {("images[]", (0,)), ("images[].box[]", (0, 0)), ("images[].box[]", (0, 1))}),
        ("[[1], [2]]", {("[]", (0,)), ("[]", (1,)), ("[][]", (0, 0)), ("[][]", (1, 0))}),
    ],
)
def test_children(text, found):
    assert children(text) == found


def test_tables_keep_parent_links(spark):
    data = [
        (1, json.dumps({"pages": 2, "images": [{"w": 1, "box": [1.5, 2]}, None, {"w": "x", "extra": {"deep": True}}]})),
        (2, None), (3, "{"), (4, "{}"), (5, json.dumps({"images": []})), (6, "null"), (7, '"text"'),
    ]
    df = spark.createDataFrame(data, "record_id bigint, value string").selectExpr("record_id", "value", "1 as grp", "2 as path")  # clashing names
    triples = nested.to_triples(df, "record_id", "value", LISTS)
    images = nested.child_table(triples, "images[]", ["w", "extra.deep"])
    assert rows(images, "record_id", "parent_ordinals", "pos", "w", "extra_deep") == [(1, [], 0, "1", None), (1, [], 2, "x", "true")]
    boxes = nested.child_table(triples, "images[].box[]", [])
    assert rows(boxes, "record_id", "parent_ordinals", "pos", "value") == [(1, [0], 0, "1.5"), (1, [0], 1, "2")]
    assert rows(nested.record_table(triples, ["pages"]), "record_id", "pages") == [(1, "2")]


def test_no_records(spark):
    df = spark.createDataFrame([], "id bigint, j string")
    assert nested.child_table(nested.to_triples(df, "id", "j"), "a[]", ["b"]).count() == 0


def test_null_and_repeated_ids_stay_apart(spark):
    data = [(None, '{"xs": [1, 2]}'), (None, '{"xs": [3, 4]}'), (7, '{"xs": [5, 6]}'), (7, '{"xs": [5, 6]}'), (8, None)]
    triples = nested.to_triples(spark.createDataFrame(data, "id bigint, j string").withColumn("record_row", F.lit(1)), "id", "j", ["xs"])
    found = nested.child_table(triples, "xs[]", [])
    assert rows(found, "record_id", "pos", "value") == sorted([(7, 0, "5"), (7, 0, "5"), (7, 1, "6"), (7, 1, "6"), (None, 0, "1"), (None, 1, "2"), (None, 0, "3"), (None, 1, "4")], key=repr)
    assert found.select("record_row").distinct().count() == 4


def test_texts_in_texts_are_opened_as_deep_as_they_go(spark):
    text = '[1, 2]'
    for _ in range(9):
        text = json.dumps(text)
    df = spark.createDataFrame([(1, '{"xs": %s}' % text)], "id bigint, j string")
    assert rows(nested.child_table(nested.to_triples(df, "id", "j", ["xs"]), "xs[]", []), "pos", "value") == [(0, "1"), (1, "2")]
