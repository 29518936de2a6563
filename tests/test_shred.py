import json
import random

import numpy as np
import pyarrow as pa
import pytest

from lodestone.operators.shred import LIST, VALUE, Leaves, Shape, as_list, children, levels_of_list, parsed, places, shred_array, shred_json

NAMES = frozenset(["conditions", "steps", "additives", "properties"])


def walked(value, path, names):
    """The non-null elements of the lists in ``names``, by plain recursion."""
    out = []

    def items(name, value):
        for i, item in enumerate(as_list(value)):
            item = parsed(item) if isinstance(item, str) else item
            if item is not None:
                out.append(f"{name}[{i}]")
            down(f"{name}[{i}]", item)

    def down(name, value):
        if isinstance(value, dict):
            for k, v in value.items():
                if k in names:
                    items(f"{name}.{k}", v)
                elif isinstance(v, (dict, list)):
                    down(f"{name}.{k}", v)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                down(f"{name}[{i}]", v)

    down(path, value)
    return sorted(out)


def record(draw, depth=0):
    """A random record; any name can hold a list, an object or a plain value."""
    out = {}
    for name in draw.sample(["conditions", "steps", "additives", "properties", "carrier", "note"], draw.randint(0, 4)):
        one = lambda: draw.choice([None, "text", 5, record(draw, depth + 1) if depth < 3 else None, [] if depth < 2 else None])
        out[name] = draw.choice([one(), one(), [one() for _ in range(draw.randint(0, 3))], json.dumps([one() for _ in range(2)])])
    return out


def paths(records):
    out = [[] for _ in records]
    for row in children(records, NAMES, "extracted"):
        out[row[0]].append(row[2])
    return [sorted(p) for p in out]


def test_same_elements_as_recursion():
    draw = random.Random(8)
    records = [record(draw) for _ in range(600)]
    assert paths(records) == [walked(r, "extracted", NAMES) for r in records]
    for r in records[:200]:
        assert paths([r]) == [walked(r, "extracted", NAMES)], r


@pytest.mark.parametrize(
    "made, expected",
    [
        ({"conditions": [{"carrier": {"x": 1}}, {"carrier": [{"properties": ["p"]}]}]}, ["extracted.conditions[0]", "extracted.conditions[1]", "extracted.conditions[1].carrier[0].properties[0]"]),
        ({"conditions": [{"note": "plain"}, {"note": [{"steps": "a"}, {"steps": [None, "b"]}]}]}, ["extracted.conditions[0]", "extracted.conditions[1]", "extracted.conditions[1].note[0].steps[0]", "extracted.conditions[1].note[1].steps[1]"]),
        ({"conditions": [{}, None, [], {"steps": []}]}, ["extracted.conditions[0]", "extracted.conditions[2]", "extracted.conditions[3]"]),
        ({"note": None, "steps": None}, []),
    ],
)
def test_mixed_shapes_keep_their_places(made, expected):
    assert paths([made]) == [expected] and paths([{}, made, None, {"conditions": 1}])[1] == expected


def test_levels_of_leaf_columns():
    names = frozenset(["steps", "additives"])
    records = [{"steps": [{"t": 1, "additives": ["a", None]}, {"additives": []}, None]}, {}, {"steps": []}]
    shape = Shape()
    for r in records:
        shape.observe(r, names)
    leaves = Leaves(shape, names)
    for r in records:
        leaves.add(r)
    own, t, inner = (leaves.columns[p] for p in (("steps", LIST, VALUE), ("steps", LIST, "t", VALUE), ("steps", LIST, "additives", LIST, VALUE)))
    assert own[:2] == ([0, 1, 1, 0, 0], [3, 3, 2, 0, 1]) and t == ([0, 1, 1, 0, 0], [5, 3, 2, 0, 1], [1, None, None, None, None])
    assert inner == ([0, 2, 1, 1, 0, 0], [7, 5, 4, 2, 0, 1], ["a", None, None, None, None, None])
    numbers, index = places(np.array(inner[0]), 2)
    assert numbers.tolist() == [0, 0, 0, 0, 1, 2] and [i.tolist() for i in index] == [[0, 0, 1, 2, 0, 0], [0, 1, 0, 0, 0, 0]]


def test_levels_of_native_lists():
    reps, defs, row = levels_of_list(pa.array([["a", None], None, [], ["b"]]).slice(0, 4))
    assert (reps.tolist(), defs.tolist(), row.tolist()) == ([0, 1, 0, 0, 0], [2, 1, 0, 0, 2], [0, 1, -1, -1, 2])
    reps, defs, row = levels_of_list(pa.array([["x"], ["a", "b"], []]).slice(1, 2))
    assert (reps.tolist(), defs.tolist(), row.tolist()) == ([0, 1, 0], [2, 2, 0], [1, 2, -1])


def test_parents_and_fields():
    rows = {r[2]: r for r in children([{"conditions": [None, {"name": "a", "steps": [{"x": {"y": 1.50}, "ok": True}, "soak"]}]}], NAMES, "e")}
    assert rows["e.conditions[1]"][3:5] == (None, 1) and rows["e.conditions[1].steps[0]"][3] == "e.conditions[1]" and rows["e.conditions[1].steps[0]"][1] == "e.conditions[].steps[]"
    assert sorted(rows["e.conditions[1].steps[0]"][5]) == [("ok", "true"), ("x.y", "1.5")] and rows["e.conditions[1].steps[1]"][5] == [("value", "soak")]
    top = {r[2]: r for r in children([[{"additives": "t"}], {"additives": []}, "text"], frozenset(["candidates", "additives"]), "candidates")}
    assert set(top) == {"candidates[0]", "candidates[0].additives[0]"}


def test_rows(spark):
    rows = [(1, '{"additives": ["a", null, "b"]}', 0), (1, '{"additives": ["a", null, "b"]}', 1), (2, None, 0), (3, "", 0), (4, "{broken", 0), (5, "[]", 0), (6, '"text"', 0), (7, '[{"additives": {"name": "n"}}]', 0), (8, json.dumps({"note": "x" * 100000, "additives": "t"}), 0)]
    df = spark.createDataFrame(rows, "k int, j string, pos int")
    got = sorted((r.k, r.child_path) for r in shred_json(df, "k", "j", ["additives"]).collect())
    assert got == [(1, "j.additives[0]"), (1, "j.additives[2]"), (7, "j[0].additives[0]"), (8, "j.additives[0]")]
    assert shred_json(df.limit(0), "k", "j", ["additives"]).count() == 0
    lists = spark.createDataFrame([(1, [("a", 1.0), None, (None, 2.0)]), (2, None), (3, [])], "k int, m array<struct<name string, value double>>")
    assert sorted((r.child_path, str(r.fields)) for r in shred_array(lists, "k", "m").collect()) == [("m[0]", "{'name': 'a', 'value': '1.0'}"), ("m[2]", "{'value': '2.0'}")]
