"""Columnar shredding of nested records into flat child tables.

A batch of records is written as leaf columns. Each leaf path has one sequence of entries, and an
entry a repetition level (which list of the path goes on; 0 is a new record), a definition level (how
much of the path is there) and a value. Whatever is missing still has its entry, at the level of its
deepest ancestor that is there. The child table of a list is then put together from the sequences of
the leaves below it: levels give the record, the places and whether there is an element; the objects
are not looked at again.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHILD_SCHEMA = [("table_path", T.StringType()), ("child_path", T.StringType()), ("parent_path", T.StringType()), ("pos", T.IntegerType()), ("fields", T.MapType(T.StringType(), T.StringType()))]
#: Marks in a path: a list, and the end of a plain value or of a list's own leaf. They are no texts, so no name is one.
LIST, VALUE = ("list",), ("value",)


class Spelled(str):
    """A number as it is spelled in the JSON text."""


def parsed(value):
    """``value``, or what it holds if it is a text that is a JSON list or object; itself if it isn't JSON. Numbers keep their spelling."""
    if isinstance(value, str) and value.lstrip()[:1] in ("[", "{"):
        try:
            return json.loads(value, parse_float=Spelled, parse_int=Spelled)
        except (ValueError, RecursionError):
            return value
    return value


def as_list(value) -> list:
    """A list however it is stored: as such, as JSON text, or as the single element in its place."""
    value = parsed(value)
    return value if isinstance(value, list) else [] if value is None else [value]


class Shape:
    """What is found at a path over all records of a batch: members by name, elements of a list, plain values.

    A name that holds an object in one record and a list in another has both shapes, and so two
    groups of leaves: each record is missing in one of them. A leaf of ``[]`` is the list's own: it
    tells places and elements even where no element has anything in it.
    """

    def __init__(self):
        self.members: dict[str, Shape] = {}
        self.elements: Shape | None = None
        self.plain = False

    def observe(self, value, repeated: frozenset[str]) -> None:
        """Adds the shape of ``value``; the members in ``repeated`` are lists however they are stored."""
        pending = [(self, value)]
        while pending:
            shape, value = pending.pop()
            if isinstance(value, dict):
                for name, inner in value.items():
                    if inner is not None:
                        pending.append((shape.members.setdefault(name, Shape()), as_list(inner) if name in repeated else inner))
            elif isinstance(value, list):
                shape.elements = shape.elements or Shape()
                pending += [(shape.elements, parsed(item)) for item in value if item is not None]
            elif value is not None:
                shape.plain = True

    def leaves(self, path: tuple = ()) -> list[tuple]:
        """The leaf paths below: names, :data:`LIST` marks, and :data:`VALUE` at the end of a plain value or of a list's own leaf."""
        out = [path + (VALUE,)] if self.plain or path[-1:] == (LIST,) else []
        for name, inner in self.members.items():
            out += inner.leaves(path + (name,))
        return out + (self.elements.leaves(path + (LIST,)) if self.elements else [])


class Leaves:
    """The leaf columns of a batch: for each leaf path its repetition levels, definition levels and values."""

    def __init__(self, shape: Shape, repeated: frozenset[str]):
        self.repeated = repeated
        self.columns: dict[tuple, tuple[list[int], list[int], list]] = {path: ([], [], []) for path in shape.leaves()}
        self.steps = self._steps(shape, ())

    def _steps(self, shape: Shape, path: tuple) -> tuple:
        """(own leaf or None, [(name, steps)], steps of the elements or None, all leaves at and below)."""
        below = [p for p in self.columns if p[: len(path)] == path]
        return (self.columns.get(path + (VALUE,)), [(n, self._steps(s, path + (n,))) for n, s in shape.members.items()], self._steps(shape.elements, path + (LIST,)) if shape.elements else None, [self.columns[p] for p in below])

    def add(self, record) -> None:
        self._write(self.steps, record, 0, 0, 0)

    @staticmethod
    def _missing(steps: tuple, rep: int, level: int) -> None:
        for reps, defs, values in steps[3]:
            reps.append(rep)
            defs.append(level)
            values.append(None)

    def _write(self, steps: tuple, value, rep: int, level: int, depth: int) -> None:
        """The entries of ``value`` (not None), whose path is there up to ``level``, below ``depth`` lists."""
        own, members, elements, _ = steps
        if own is not None:
            own[0].append(rep)
            own[1].append(level + (not isinstance(value, (dict, list))))
            own[2].append(None if isinstance(value, (dict, list)) else value)
        for name, inner in members:
            found = value.get(name) if isinstance(value, dict) else None
            if found is None:
                self._missing(inner, rep, level)
            else:
                self._write(inner, as_list(found) if name in self.repeated else found, rep, level + 1, depth)
        if elements is not None:
            items = value if isinstance(value, list) else ()
            if not items:
                self._missing(elements, rep, level)
            for place, item in enumerate(items):
                at = rep if place == 0 else depth + 1
                if item is None:
                    self._missing(elements, at, level + 1)
                else:
                    self._write(elements, parsed(item), at, level + 2, depth + 1)


def levels_of_list(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(repetition levels, definition levels, row of the values for each entry or -1) of the own leaf of a native list column, from its offsets."""
    lengths = np.where(np.asarray(column.is_valid()), np.diff(column.offsets.to_numpy()), 0)
    entries = np.maximum(lengths, 1)
    first = np.concatenate([[0], np.cumsum(entries)[:-1]]).astype(np.int64) if len(entries) else np.zeros(0, np.int64)
    reps = np.ones(int(entries.sum()), np.int64)
    reps[first] = 0
    place = np.arange(len(reps)) - np.repeat(first, entries)
    row = np.where(np.repeat(lengths, entries) > 0, np.repeat(column.offsets.to_numpy()[:-1], entries) + place, -1)
    there = np.asarray(column.values.is_valid())
    return reps, np.where(row < 0, 0, np.where(there[row] if len(there) else False, 2, 1)), row


def places(reps: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(record of each entry, its index in each of the ``depth`` lists of the path), from repetition levels alone."""
    out = []
    for level in range(1, depth + 1):
        steps = np.cumsum(reps == level)
        start = np.maximum.accumulate(np.where(reps < level, np.arange(len(reps)), 0)) if len(reps) else np.zeros(0, np.int64)
        out.append(steps - steps[start])
    return np.cumsum(reps == 0) - 1, out


def _spelled(path: tuple, indices: list[np.ndarray], rows: np.ndarray) -> list[str]:
    """``path`` for each of ``rows`` with its list marks filled in: a, [], b and 3 give a[3].b."""
    depth, out = 0, [""] * len(rows)
    for step in path:
        if step == LIST:
            text = [f"[{i}]" for i in indices[depth][rows].tolist()]
            depth += 1
            out = [a + b for a, b in zip(out, text)]
        else:
            out = [f"{a}.{step}" if a else step for a in out]
    return out


def table_of(columns: dict[tuple, tuple], path: tuple, root: tuple, with_fields: bool = True) -> tuple:
    """(records, table path, child paths, parent paths, positions, fields) of the list at ``path``, which ends with :data:`LIST`.

    The leaves below ``path`` without another list in between have one entry for each entry of the
    list's own leaf; those with a list in between belong to a deeper table.
    """
    reps, defs, values = columns[path + (VALUE,)]
    reps, defs = np.asarray(reps, np.int64), np.asarray(defs, np.int64)
    level, depth = sum(2 if s == LIST else 1 for s in path), path.count(LIST)
    record, indices = places(reps, depth)
    rows = np.flatnonzero(defs >= level)
    children = _spelled(root + path, indices, rows)
    outer = len(path) - 1 - path[-2::-1].index(LIST) if LIST in path[:-1] else 0
    parents = _spelled(root + path[:outer], indices, rows) if outer else [None] * len(rows)
    fields: list = [None] * len(rows)
    if with_fields:
        fields = [[] for _ in rows]
        for leaf, (_, _, found) in columns.items():
            inner = leaf[len(path) : -1]
            if leaf[: len(path)] == path and LIST not in inner:
                name = ".".join(inner) or "value"
                for at, row in enumerate(rows.tolist()):
                    if found[row] is not None:
                        fields[at].append((name, written(found[row])))
    return record[rows], "".join("[]" if s == LIST else f".{s}" if i else s for i, s in enumerate(root + path)), children, parents, indices[-1][rows], fields


def written(value) -> str:
    """A plain value as text: texts as they are, numbers as they are spelled, true and false."""
    return str(value) if isinstance(value, str) else json.dumps(value)


def children(records: list, repeated: frozenset[str], root: str, with_fields: bool = True) -> list[tuple]:
    """(record number, table_path, child_path, parent_path, pos, fields) of each non-null element of the lists in ``repeated``, by table.

    A record that is a list is one of ``root``'s name: its elements have rows if ``root`` is in ``repeated``.
    """
    shape = Shape()
    ready = [as_list(r) if root in repeated else parsed(r) for r in records]
    for r in ready:
        shape.observe(r, repeated)
    leaves = Leaves(shape, repeated)
    for r in ready:
        if r is None:
            leaves._missing(leaves.steps, 0, 0)
        else:
            leaves.add(r)
    out = []
    for leaf in leaves.columns:
        path = leaf[:-1]
        if path[-1:] == (LIST,) and ((root,) + path)[-2] in repeated:
            record, table, *rest = table_of(leaves.columns, path, (root,), with_fields)
            out += [(r, table, *row) for r, *row in zip(record.tolist(), *rest)]
    return out


def _result(keys: pa.Array, rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()))
    arrays = [keys.take(pa.array([r[0] for r in rows], pa.int64()))]
    return pa.RecordBatch.from_arrays(arrays + [pa.array([r[i + 1] for r in rows], kind) for i, kind in enumerate(kinds)], names=["k", *names])


def _shredded(own: DataFrame, key: str, work) -> DataFrame:
    columns = [n for n, _ in CHILD_SCHEMA]
    made = own.mapInArrow(work, T.StructType([T.StructField("k", own.schema["k"].dataType), *[T.StructField(n, t) for n, t in CHILD_SCHEMA]]))
    return made.dropDuplicates(["k", "child_path"]).select(F.col("k").alias(key), *columns)


def shred_json(df: DataFrame, key: str, column: str, repeated: list[str], root: str | None = None, with_fields: bool = True) -> DataFrame:
    """(``key``, table_path, child_path, parent_path, pos, fields): the child tables of a JSON column, one row a non-null element.

    ``repeated`` names the lists; each is one at any depth however it is stored (a list, JSON text, a
    single object or text as element 0). A list under another name is a list where it is one, and has
    places in the paths below it but no table. ``parent_path`` is the enclosing element, null below
    the root. Null elements keep their place and give no row. ``fields``: the plain members of an
    element, those of its objects by dotted names, as texts; ``value`` if the element itself is plain.
    Null, blank and malformed JSON and plain values give no rows. Repeated input rows count once, by
    ``key`` and path. Other columns are ignored; an empty table gives no rows.
    """
    names = frozenset(repeated)
    base = root if root is not None else column
    own = df.select(F.col(key).alias("k"), F.col(column).alias("j")).where(F.col("j").isNotNull())

    def work(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                records = [parsed(parsed(_unquoted(t))) for t in batch.column(1).to_pylist()]
                records = [r if isinstance(r, (dict, list)) else None for r in records]
                yield _result(batch.column(0), children(records, names, base, with_fields), [n for n, _ in CHILD_SCHEMA])

    return _shredded(own, key, work)


def _unquoted(text: str):
    """A JSON text that is itself a JSON string: what it holds."""
    if text.lstrip()[:1] == '"':
        try:
            return json.loads(text)
        except ValueError:
            return None
    return text


def shred_array(df: DataFrame, key: str, column: str, with_fields: bool = True) -> DataFrame:
    """:func:`shred_json` for a native list of structs or values: its levels come from the offsets of the list column; same columns and cases."""
    own = df.select(F.col(key).alias("k"), F.col(column).alias("items"))

    def work(batches):
        for batch in batches:
            items = batch.column(1)
            reps, defs, row = levels_of_list(items)
            pick = pa.array(np.where(row < 0, 0, row), mask=row < 0)
            plain = not pa.types.is_struct(items.values.type)
            found = lambda values: [None if v is None else v if isinstance(v, str) else repr(v) if isinstance(v, float) else json.dumps(v) for v in values.take(pick).to_pylist()]
            columns: dict[tuple, tuple] = {(LIST, VALUE): (reps, defs, found(items.values) if plain and with_fields else [None] * len(reps))}
            if with_fields and not plain:
                for i in range(items.values.type.num_fields):
                    columns[(LIST, items.values.type.field(i).name, VALUE)] = (reps, defs, found(items.values.field(i)))
            record, table, *rest = table_of(columns, (LIST,), (column,), with_fields)
            yield _result(batch.column(0), [(r, table, *rows) for r, *rows in zip(record.tolist(), *rest)], [n for n, _ in CHILD_SCHEMA])

    return _shredded(own, key, work)
