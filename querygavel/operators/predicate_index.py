"""Count the classes under many conditions over one table in one scan.

A condition that compares columns with constants only asks where a value lies among its constants. The constants of all
conditions are sorted by column; a row becomes its class and, for each column, the *cell* its value falls into: between
two constants, on one, or null. Rows of equal cells are counted once for all conditions, and the counts are then handed
out to the conditions that hold for the cells. So the scan does not grow with the number of conditions.

Spark parses, analyses and folds the conditions; here the analysed expressions are only read.
"""

from __future__ import annotations

import bisect
import datetime
import decimal
import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.classic.column import Column as ClassicColumn

from querygavel.functions.text import quoted

#: Combinations of cells that conditions over several columns may share, and conditions of one chunk over one column.
CELLS, CONDITIONS = 1 << 16, 20_000
#: Conditions that are analysed by one call.
ANALYSED_TOGETHER = 200

# Kleene's logic: false, unknown, true. And is the least, or the greatest.
FALSE, UNKNOWN, TRUE = 0, 1, 2

# Comparisons and what they become when the constant stands on the left.
COMPARISONS = {
    "EqualTo": ("=", "="),
    "EqualNullSafe": ("<=>", "<=>"),
    "LessThan": ("<", ">"),
    "LessThanOrEqual": ("<=", ">="),
    "GreaterThan": (">", "<"),
    "GreaterThanOrEqual": (">=", "<="),
}
# Widths of whole numbers in decimal digits.
WHOLE = {"byte": 3, "short": 5, "integer": 10, "long": 19}


class NotIndexable(Exception):
    """The condition does more than compare columns with constants."""


@dataclass(frozen=True)
class Key:
    """A column as it is compared: its name and the type that it is widened to."""

    name: str
    kind: str


@dataclass(frozen=True)
class Atom:
    """``key op value``; an operator of None asks whether the key is null."""

    key: Key
    op: str | None
    value: object = None


@dataclass(frozen=True)
class Node:
    """and, or, not of others, or a constant."""

    kind: str
    children: tuple = ()
    value: int = UNKNOWN


def column_of(table: DataFrame, expression) -> Column:
    """A column from an expression that Spark has parsed."""
    return ClassicColumn(table.sparkSession._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))


def analysed(table: DataFrame, conditions: Sequence[str | Column]) -> list[list[dict] | None]:
    """The analysed expression of each condition as Spark's list of nodes; None where there is none.

    Conditions, all texts or all columns, are analysed together; when one is wrong, halves are tried apart.
    """
    if not conditions:
        return []
    texts = isinstance(conditions[0], str)
    try:
        chosen = table.selectExpr(*[f"(\n{c}\n)" for c in conditions]) if texts else table.select(*conditions)
        plan = chosen._jdf.queryExecution().analyzed()
        top = json.loads(folded(table, plan).toJSON())[0]
        if not top["class"].endswith(".Project") or len(top["projectList"]) != len(conditions):
            raise NotIndexable
        return top["projectList"]
    except (AnalysisException, NotIndexable):
        if len(conditions) == 1:
            return [None]
        middle = len(conditions) // 2
        return analysed(table, conditions[:middle]) + analysed(table, conditions[middle:])


def folded(table: DataFrame, plan):
    """A plan whose constant parts are constants."""
    return table.sparkSession._jvm.org.apache.spark.sql.catalyst.optimizer.ConstantFolding.apply(plan)


def filtered_table(result: DataFrame, label_col: str, zone: str) -> tuple[str | None, Node | Atom | None]:
    """The view that a plan only filters and selects columns of, and the condition; None for any other plan.

    The columns of the result are the view's own, so each row of the view that the condition holds for is one row of
    the result, and the label is the view's label.
    """
    node = folded(result, result._jdf.queryExecution().analyzed())
    conditions, output = [], node.outputSet()
    try:
        while True:
            kind = node.getClass().getSimpleName()
            if kind == "View":
                break
            if kind == "Filter":
                conditions.append(node.condition())
            elif kind not in ("Project", "SubqueryAlias"):
                return None, None
            node = node.children().apply(0)
        own = node.outputSet()
        if not output.subsetOf(own) or not all(c.references().subsetOf(own) for c in conditions):
            return None, None
        trees = tuple(condition_tree(json.loads(c.toJSON()), zone) for c in conditions)
    except NotIndexable:
        return None, None
    tree = trees[0] if len(trees) == 1 else Node("and", (Node("constant", (), TRUE), *trees))
    return node.desc().identifier().table().lower(), tree


def condition_tree(nodes: list[dict], zone: str) -> Node | Atom:
    """Atoms under and, or, not, from Spark's list of nodes in pre-order."""
    tree, end = _read(nodes, 0, zone, None)
    if end != len(nodes):
        raise NotIndexable
    return _truth(tree)


def _read(nodes: list[dict], i: int, zone: str, common):
    """The tree that starts at node i, and where the next one starts."""
    node = nodes[i]
    name, n = node["class"].rsplit(".", 1)[-1], node["num-children"]
    if name == "CommonExpressionRef":
        if common is None:
            raise NotIndexable
        return common, i + 1
    if name == "Literal":
        return _constant(node, zone), i + 1
    if name == "AttributeReference":
        return Key(node["name"], _plain(node["dataType"])), i + 1
    if name == "With" and n == 2:
        # The definition comes after the expression that refers to it.
        definition = nodes[_skip(nodes, i + 1)]
        if not definition["class"].endswith(".CommonExpressionDef"):
            raise NotIndexable
        shared, end = _read(nodes, _skip(nodes, i + 1) + 1, zone, None)
        if not isinstance(shared, Key):
            raise NotIndexable
        tree, _ = _read(nodes, i + 1, zone, shared)
        return tree, end
    children, end = [], i + 1
    for _ in range(n):
        child, end = _read(nodes, end, zone, common)
        children.append(child)
    return _joined(name, node, children), end


def _skip(nodes: list[dict], i: int) -> int:
    """Where the tree that starts at node i ends."""
    left = 1
    while left:
        left += nodes[i]["num-children"] - 1
        i += 1
    return i


def _joined(name: str, node: dict, children: list):
    if name in ("Alias", "Between") and len(children) == 1:
        return children[0]
    if name == "Cast":
        return _widened(children[0], _plain(node["dataType"]))
    if name in ("And", "Or", "Not"):
        return Node(name.lower(), tuple(_truth(c) for c in children))
    if name in ("IsNull", "IsNotNull") and isinstance(children[0], Key):
        atom = Atom(children[0], None)
        return atom if name == "IsNull" else Node("not", (atom,))
    if name in COMPARISONS:
        left, right = children
        if isinstance(left, Key) and isinstance(right, _Value):
            return _compared(left, COMPARISONS[name][0], right)
        if isinstance(right, Key) and isinstance(left, _Value):
            return _compared(right, COMPARISONS[name][1], left)
    if name == "In" and isinstance(children[0], Key) and all(isinstance(c, _Value) for c in children[1:]):
        return Node("or", tuple(_compared(children[0], "=", c) for c in children[1:]))
    raise NotIndexable


@dataclass(frozen=True)
class _Value:
    kind: str
    value: object


def _truth(tree):
    if isinstance(tree, _Value) and tree.kind == "boolean":
        return Node("constant", (), UNKNOWN if tree.value is None else TRUE if tree.value else FALSE)
    if isinstance(tree, Key) and tree.kind == "boolean":
        return Atom(tree, "=", True)
    if isinstance(tree, Node | Atom):
        return tree
    raise NotIndexable


def _compared(key: Key, op: str, constant: _Value) -> Node | Atom:
    if constant.kind != key.kind:
        raise NotIndexable
    if constant.value is None:
        return Atom(key, None) if op == "<=>" else Node("constant")
    return Atom(key, op, constant.value)


def _plain(kind) -> str:
    known = kind in (*WHOLE, "float", "double", "boolean", "date", "timestamp", "timestamp_ntz", "string")
    if not isinstance(kind, str) or not (known or kind.startswith("decimal(")):
        raise NotIndexable
    return kind


def _widened(child, kind: str):
    """A column widened to a type that holds all its values, so that no row can fail."""
    if not isinstance(child, Key):
        raise NotIndexable
    wide = child.kind == kind
    if child.kind in WHOLE:
        wide = wide or WHOLE.get(kind, 0) > WHOLE[child.kind] or kind in ("float", "double") or _digits(kind)[0] >= WHOLE[child.kind]
    elif child.kind == "float":
        wide = wide or kind == "double"
    elif child.kind.startswith("decimal("):
        wide = wide or all(new >= old for new, old in zip(_digits(kind), _digits(child.kind), strict=True))
    if not wide:
        raise NotIndexable
    return Key(child.name, kind)


def _digits(kind: str) -> tuple[int, int]:
    """Digits before and after the point of a decimal type; none of another type."""
    if not kind.startswith("decimal("):
        return -1, -1
    precision, scale = map(int, kind[len("decimal(") : -1].split(","))
    return precision - scale, scale


def _constant(node: dict, zone: str) -> _Value:
    kind, text = _plain(node["dataType"]), node.get("value")
    if text is None:
        return _Value(kind, None)
    try:
        if kind in WHOLE:
            return _Value(kind, int(text))
        if kind in ("float", "double"):
            return _Value(kind, float(np.float32(text)) if kind == "float" else float(text))
        if kind == "boolean":
            return _Value(kind, {"true": True, "false": False}[text])
        if kind == "string":
            return _Value(kind, text)
        if kind.startswith("decimal("):
            return _Value(kind, decimal.Decimal(text))
        if text.lstrip("-").isdigit():
            return _Value(kind, int(text))  # days or microseconds since 1970
        if kind == "date":
            return _Value(kind, (datetime.date.fromisoformat(text) - datetime.date(1970, 1, 1)).days)
        if kind == "timestamp" and zone not in ("UTC", "Etc/UTC", "Z", "GMT"):
            raise NotIndexable
        since = datetime.datetime.fromisoformat(text) - datetime.datetime(1970, 1, 1)
        return _Value(kind, since // datetime.timedelta(microseconds=1))
    except (ValueError, KeyError, TypeError, decimal.InvalidOperation) as error:
        raise NotIndexable from error


def atoms(tree: Node | Atom) -> Iterator[Atom]:
    if isinstance(tree, Atom):
        yield tree
    else:
        for child in tree.children:
            yield from atoms(child)


def _order(value: object):
    """Spark's order: NaN is the largest number and equals itself."""
    return (1, 0.0) if isinstance(value, float) and math.isnan(value) else (0, value)


class Breakpoints:
    """The sorted constants of a column. Cell 2i + 1 is the i-th constant, 2i lies before it, the last one is null."""

    def __init__(self, values: set):
        self.values = sorted({_order(v): v for v in values}.values(), key=_order)
        self.place = {_order(v): i for i, v in enumerate(self.values)}
        self.null = 2 * len(self.values) + 1
        self.size = self.null + 1

    def cell_of(self, value: object) -> int:
        return 2 * self.place[_order(value)] + 1

    def cells(self, column: pa.Array) -> np.ndarray:
        """The cell of each value of an Arrow column."""
        kind = column.type
        if pa.types.is_date32(kind):
            column = column.cast(pa.int32())
        elif pa.types.is_timestamp(kind):
            column = column.cast(pa.int64())
        elif pa.types.is_boolean(kind):
            column = column.cast(pa.int8())
        empty = column.is_null().to_numpy(zero_copy_only=False)
        if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
            known = column.fill_null(0).to_numpy(zero_copy_only=False)
            wide = np.float64 if pa.types.is_floating(column.type) else np.int64
            found = self._numbers(known.astype(wide), np.array(self.values, wide))
        else:
            encoded = column.dictionary_encode()
            places = np.array([*map(self._one, encoded.dictionary.to_pylist()), self.null])
            found = places[encoded.indices.fill_null(len(places) - 1).to_numpy(zero_copy_only=False)]
        return np.where(empty, self.null, found)

    def _numbers(self, known: np.ndarray, values: np.ndarray) -> np.ndarray:
        at = np.searchsorted(values, known, "left")
        if not len(values):
            return at
        hit = values[np.minimum(at, len(values) - 1)]
        same = (at < len(values)) & ((hit == known) | ((hit != hit) & (known != known)))
        return 2 * at + same

    def _one(self, value: object) -> int:
        at = bisect.bisect_left(self.values, value)
        return 2 * at + (at < len(self.values) and self.values[at] == value)


class Chunk:
    """Conditions over the same columns; a row's cells in all of them are one number."""

    def __init__(self, keys: tuple[Key, ...], conditions: list[tuple[str, Node | Atom]]):
        self.keys, self.conditions = keys, conditions
        self.points = {
            key: Breakpoints({a.value for _, tree in conditions for a in atoms(tree) if a.key == key and a.op}) for key in keys
        }
        self.size = math.prod(p.size for p in self.points.values())

    def codes(self, cells: dict[Key, np.ndarray], maps: dict[Key, np.ndarray], rows: int) -> np.ndarray:
        code = np.zeros(rows, np.int64)
        for key in self.keys:
            code = code * self.points[key].size + maps[key][cells[key]]
        return code

    def maps(self, points: dict[Key, Breakpoints]) -> dict[Key, np.ndarray]:
        """For each cell among all constants of a column, its cell among those of this chunk."""
        out = {}
        for key in self.keys:
            own, every = self.points[key], points[key]
            known = np.array([v in own.place for v in map(_order, every.values)], bool)
            before = np.concatenate([[0], np.cumsum(known)])
            cell = np.empty(every.size, np.int64)
            cell[0::2][: len(before)] = 2 * before
            cell[1::2][: len(known)] = 2 * before[:-1] + known
            cell[every.null] = own.null
            out[key] = cell
        return out

    def holds(self, code: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
        """For each condition, which of the given cells it holds for."""
        cells = {}
        for key in reversed(self.keys):
            code, cells[key] = np.divmod(code, self.points[key].size)
        n = len(code)
        for name, tree in self.conditions:
            yield name, np.broadcast_to(self._value(tree, cells), n) == TRUE

    def _value(self, tree: Node | Atom, cells: dict[Key, np.ndarray]):
        if isinstance(tree, Atom):
            return self._atom(tree, cells[tree.key])
        if tree.kind == "constant":
            return np.int8(tree.value)
        values = [self._value(child, cells) for child in tree.children]
        if tree.kind == "not":
            return TRUE - values[0]
        out = values[0]
        for value in values[1:]:
            out = np.minimum(out, value) if tree.kind == "and" else np.maximum(out, value)
        return out

    def _atom(self, atom: Atom, cell: np.ndarray) -> np.ndarray:
        points = self.points[atom.key]
        empty = cell == points.null
        if atom.op is None:
            return np.where(empty, TRUE, FALSE)
        at = points.cell_of(atom.value)
        hit = {
            "=": cell == at, "<=>": cell == at, "<": cell < at, "<=": cell <= at, ">": cell > at, ">=": cell >= at
        }[atom.op]
        return np.where(empty, FALSE if atom.op == "<=>" else UNKNOWN, np.where(hit, TRUE, FALSE))


def chunks(conditions: Sequence[tuple[str, Node | Atom]]) -> tuple[list[Chunk], list[str]]:
    """Conditions by their columns, and the names of those that have too many cells even alone."""
    by_keys: dict[tuple[Key, ...], list] = {}
    for name, tree in conditions:
        keys = tuple(sorted({a.key for a in atoms(tree)}, key=lambda k: (k.name, k.kind)))
        by_keys.setdefault(keys, []).append((name, tree))
    out, refused = [], []
    for keys, group in by_keys.items():
        held, values = [], {key: set() for key in keys}
        for name, tree in group:
            own = {key: {_order(a.value) for a in atoms(tree) if a.key == key and a.op} for key in keys}
            if len(keys) > 1 and math.prod(2 * len(v) + 2 for v in own.values()) > CELLS:
                refused.append(name)
                continue
            more = {key: values[key] | own[key] for key in keys}
            over = len(keys) > 1 and math.prod(2 * len(v) + 2 for v in more.values()) > CELLS
            if held and (over or len(held) >= CONDITIONS):
                out.append(Chunk(keys, held))
                held, more = [], own
            held.append((name, tree))
            values = more
        if held:
            out.append(Chunk(keys, held))
    return out, refused


def indexable_label(table: DataFrame, label_col: str) -> bool:
    """Whether the table has one column of that name, of a type that can be a group."""
    try:
        kind = table.select(F.col(quoted(label_col))).schema[0].dataType
    except AnalysisException:
        return False
    return isinstance(kind, T.AtomicType)


_COUNTED = "chunk int, class string, code bigint, n bigint"
_EXPANDED = "query_key string, class string, n bigint"


def count_indexed(table: DataFrame, parts: Sequence[Chunk], label_col: str) -> DataFrame:
    """``query_key, class, is_text, n`` of all conditions of all chunks, by one scan of ``table``.

    Tasks count equal (class, cells) themselves; what is shuffled is at most a count for each class, chunk and occupied
    cell and task. A chunk's counts of one class are then handed out to its conditions.
    """
    parts = list(parts)
    keys = sorted({key for part in parts for key in part.keys}, key=lambda k: (k.name, k.kind))
    points = {key: Breakpoints({v for part in parts if key in part.points for v in part.points[key].values}) for key in keys}
    label = F.col(quoted(label_col))
    text = table.select(label).schema[0].dataType
    columns = [F.col(quoted(key.name)).cast(_SQL_TYPE.get(key.kind, key.kind)).alias(f"key{i}") for i, key in enumerate(keys)]
    # Grouping makes one of both zeros; as texts they would differ.
    label = label + F.lit(0).cast(text) if isinstance(text, T.FractionalType) else label
    rows = table.select(label.cast("string").alias("class"), *columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [part.maps(points) for part in parts]
        numbers: dict[str | None, int] = {}
        held, size = [[] for _ in parts], 0
        for batch in batches:
            classes = batch.column(0).dictionary_encode()
            names = np.array([numbers.setdefault(name, len(numbers)) for name in [*classes.dictionary.to_pylist(), None]])
            of_row = names[classes.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False)]
            cells = {key: points[key].cells(batch.column(i + 1)) for i, key in enumerate(keys)}
            for number, part in enumerate(parts):
                held[number].append(_summed(of_row * part.size + part.codes(cells, maps[number], len(of_row)), None))
                size += len(held[number][-1][0])
            if size >= HELD:
                held = [[_summed(*map(np.concatenate, zip(*one, strict=True)))] for one in held]
                size = sum(len(one[0][0]) for one in held)
            if size >= HELD // 2:
                yield from _counted(parts, held, numbers)
                numbers, held, size = {}, [[] for _ in parts], 0
        yield from _counted(parts, held, numbers)

    def expand(group: pa.Table) -> pa.Table:
        part, name = parts[group.column("chunk")[0].as_py()], group.column("class")[0].as_py()
        n = group.column("n").to_numpy()
        found = [(key, int(n[holds].sum())) for key, holds in part.holds(group.column("code").to_numpy())]
        found = [(key, total) for key, total in found if total]
        return pa.table(
            {
                "query_key": pa.array([key for key, _ in found], pa.string()),
                "class": pa.array([name] * len(found), pa.string()),
                "n": pa.array([total for _, total in found], pa.int64()),
            }
        )

    cells = rows.mapInArrow(count, _COUNTED).groupBy("chunk", "class", "code").agg(F.sum("n").alias("n"))
    expanded = cells.groupBy("chunk", "class").applyInArrow(expand, _EXPANDED)
    return expanded.select("query_key", "class", F.lit(isinstance(text, T.StringType)).alias("is_text"), "n")


# Names of types in casts, where they differ.
_SQL_TYPE = {"byte": "tinyint", "short": "smallint", "integer": "int", "long": "bigint"}


#: Counts that a task holds before it adds up equal ones.
HELD = 1 << 19


def _summed(codes: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Different codes and the sums of their counts (each 1 where there are none)."""
    if counts is None:
        return np.unique(codes, return_counts=True)
    found, place = np.unique(codes, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, place, counts)
    return found, total


def _counted(parts: Sequence[Chunk], held: list[list], numbers: dict[str | None, int]) -> Iterator[pa.RecordBatch]:
    names = pa.array(list(numbers), pa.string())
    for number, (part, one) in enumerate(zip(parts, held, strict=True)):
        if not one:
            continue
        found, total = _summed(*map(np.concatenate, zip(*one, strict=True)))
        of_row, code = np.divmod(found, part.size)
        columns = [pa.array(np.full(len(found), number, np.int32)), names.take(pa.array(of_row)), pa.array(code), pa.array(total)]
        yield pa.RecordBatch.from_arrays(columns, ["chunk", "class", "code", "n"])
