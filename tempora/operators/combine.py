"""User-defined mergeable aggregates: create, add, merge, extract.

A :class:`Combiner` works on columns of states, one state per key, so a batch is one call however
many keys it has. Each task folds its rows into one state per key and sends only these; with more
keys than ``MAX_KEYS`` it sends what it has and starts anew, which bounds its memory. States meet
in two levels: first by (key, salt), where the salt deals a key's tasks out over ``FANOUT``
groups, then by key, so a key that every task has is merged by many tasks and the last merge
reads at most ``FANOUT`` states. Both levels stream sorted rows and hold the states of one batch.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MAX_KEYS = 100_000
FANOUT = 64
SALT = "_salt"

State = dict[str, np.ndarray]
Values = dict[str, pa.Array]


class Combiner(ABC):
    """States are numpy columns by the names of ``state``; ``state`` and ``result`` give their Spark types."""

    state: dict[str, str]
    result: dict[str, str]

    @abstractmethod
    def create(self, n: int) -> State:
        """``n`` neutral states."""

    @abstractmethod
    def add(self, state: State, group: np.ndarray, values: Values) -> None:
        """Fold input rows into ``state`` in place; ``group`` is each row's state."""

    @abstractmethod
    def merge(self, state: State, group: np.ndarray, other: State) -> None:
        """Fold other states into ``state`` in place; the order of calls must not matter."""

    @abstractmethod
    def extract(self, state: State) -> dict[str, np.ndarray]:
        """Result columns; a masked value is NULL."""


def present(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Doubles of a column and which of them are neither NULL nor NaN."""
    x = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    return x, ~np.isnan(x)


class Sum(Combiner):
    """Sum of the first input; NULL if it has no value."""

    state, result = {"total": "double", "n": "long"}, {"total": "double"}

    def create(self, n):
        return {"total": np.zeros(n), "n": np.zeros(n, np.int64)}

    def add(self, state, group, values):
        x, ok = present(next(iter(values.values())))
        np.add.at(state["total"], group[ok], x[ok])
        np.add.at(state["n"], group[ok], 1)

    def merge(self, state, group, other):
        for c in ("total", "n"):
            np.add.at(state[c], group, other[c])

    def extract(self, state):
        return {"total": np.ma.array(state["total"], mask=state["n"] == 0)}


class MeanCount(Sum):
    """Mean and number of the values that are not missing."""

    result = {"mean": "double", "count": "long"}

    def extract(self, state):
        n = state["n"]
        return {"mean": np.ma.array(state["total"] / np.maximum(n, 1), mask=n == 0), "count": n}


class MeanStd(Combiner):
    """Mean and sample deviation from central moments; a single value has deviation 0."""

    state = {"n": "long", "mean": "double", "m2": "double"}
    result = {"mean": "double", "std": "double", "n": "long"}

    def create(self, n):
        return {"n": np.zeros(n, np.int64), "mean": np.zeros(n), "m2": np.zeros(n)}

    def add(self, state, group, values):
        x, ok = present(next(iter(values.values())))
        g, x = group[ok], x[ok]
        size = len(state["n"])
        n = np.bincount(g, minlength=size)
        mean = np.bincount(g, x, minlength=size) / np.maximum(n, 1)
        m2 = np.bincount(g, (x - mean[g]) ** 2, minlength=size)
        self._join(state, {"n": n, "mean": mean, "m2": m2})

    def merge(self, state, group, other):
        size = len(state["n"])
        n = np.bincount(group, other["n"], minlength=size).astype(np.int64)
        mean = np.bincount(group, other["n"] * other["mean"], minlength=size) / np.maximum(n, 1)
        m2 = np.bincount(group, other["m2"] + other["n"] * (other["mean"] - mean[group]) ** 2, minlength=size)
        self._join(state, {"n": n, "mean": mean, "m2": m2})

    @staticmethod
    def _join(a, b):
        n = a["n"] + b["n"]
        gap, some = b["mean"] - a["mean"], np.maximum(n, 1)
        a["m2"] += b["m2"] + gap**2 * a["n"] * b["n"] / some
        a["mean"] += gap * b["n"] / some
        a["n"][:] = n

    def extract(self, state):
        n = state["n"]
        std = np.sqrt(state["m2"] / np.maximum(n - 1, 1))
        return {"mean": np.ma.array(state["mean"], mask=n == 0), "std": np.ma.array(np.where(n > 1, std, 0.0), mask=n == 0), "n": n}


class _Keyed:
    """States of the keys seen so far; a key is a row of the key columns."""

    def __init__(self, combiner: Combiner, keys: list[str]):
        self.combiner, self.keys = combiner, keys
        self.slots: dict[tuple, int] = {}
        self.state = combiner.create(0)

    def groups(self, batch: pa.RecordBatch) -> np.ndarray:
        """Slot of every row; unseen keys get new neutral states."""
        code = np.zeros(batch.num_rows, np.int64)
        for c in self.keys:
            column = batch.column(c).dictionary_encode(null_encoding="encode")
            own = column.indices.to_numpy(zero_copy_only=False)
            _, code = np.unique(code * (len(column.dictionary) + 1) + own, return_inverse=True)
        _, first, group = np.unique(code, return_index=True, return_inverse=True)
        names = batch.select(self.keys).take(pa.array(first)).to_pylist()
        at = [self.slots.setdefault(tuple(r.values()), len(self.slots)) for r in names]
        fresh = len(self.slots) - len(next(iter(self.state.values())))
        if fresh:
            more = self.combiner.create(fresh)
            self.state = {c: np.concatenate([v, more[c]]) for c, v in self.state.items()}
        return np.array(at, np.int64)[group]

    def drain(self, columns: dict[str, np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
        names = list(zip(*self.slots, strict=True)) if self.slots else [()] * len(self.keys)
        arrays = [pa.array(list(names[self.keys.index(f.name)]), f.type) if f.name in self.keys else _column(columns[f.name], f.type) for f in schema]
        self.slots, self.state = {}, self.combiner.create(0)
        return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    if isinstance(values, np.ma.MaskedArray):
        return pa.array(values.data.tolist(), kind, mask=np.ma.getmaskarray(values))
    return pa.array(values.tolist() if values.dtype == object else values, kind)


def _partials(batches: Iterator[pa.RecordBatch], combiner: Combiner, keys: list[str], inputs: list[str], most: int, schema: pa.Schema, fanout: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    salt = TaskContext.get().partitionId() % fanout
    held = _Keyed(combiner, keys)

    def send() -> pa.RecordBatch:
        return held.drain(held.state | {SALT: np.full(len(held.slots), salt, np.int32)}, schema)

    for b in batches:
        if not b.num_rows:
            continue
        group = held.groups(b)
        combiner.add(held.state, group, {c: b.column(c) for c in inputs})
        if len(held.slots) > most:
            yield send()
    if held.slots:
        yield send()


def _merged(batches: Iterator[pa.RecordBatch], combiner: Combiner, keys: list[str], schema: pa.Schema, last: bool) -> Iterator[pa.RecordBatch]:
    """Merge neighbouring rows of one key in a partition sorted by key; the last key of a batch stays open."""
    by = keys if last else [*keys, SALT]
    held = _Keyed(combiner, by)

    def merge(part: pa.RecordBatch) -> None:
        group = held.groups(part)
        other = {c: _numpy(part.column(c)) for c in combiner.state}
        combiner.merge(held.state, group, other)

    def send() -> pa.RecordBatch:
        return held.drain(combiner.extract(held.state) if last else held.state, schema)

    for b in batches:
        if not b.num_rows:
            continue
        merge(b)
        if len(held.slots) > 1:
            yield from _all_but(held, b.slice(b.num_rows - 1, 1).select(by).to_pylist()[0], combiner, schema, last)
    if held.slots:
        yield send()


def _all_but(held: _Keyed, end: dict, combiner: Combiner, schema: pa.Schema, last: bool) -> Iterator[pa.RecordBatch]:
    """Send every state but that of the key which may go on."""
    key = tuple(end.values())
    at = held.slots[key]
    stays = {c: v[at : at + 1].copy() for c, v in held.state.items()}
    keep = np.arange(len(held.slots)) != at
    held.slots = {k: i for i, k in enumerate(k for k, i in held.slots.items() if i != at)}
    rest = {c: v[keep] for c, v in held.state.items()}
    if held.slots:
        yield held.drain(combiner.extract(rest) if last else rest, schema)
    held.slots, held.state = {key: 0}, stays


def _numpy(column: pa.Array) -> np.ndarray:
    if pa.types.is_nested(column.type) or pa.types.is_binary(column.type) or pa.types.is_string(column.type):
        out = np.empty(len(column), object)
        out[:] = column.to_pylist()
        return out
    return column.to_numpy(zero_copy_only=False)


def _schema(df: DataFrame, keys: list[str], columns: dict[str, str]) -> T.StructType:
    fields = [T.StructField(k, df.schema[k].dataType) for k in keys]
    return T.StructType(fields + [T.StructField(c, T.StructType.fromDDL(f"x {t}")["x"].dataType) for c, t in columns.items()])


def partials(df: DataFrame, keys: list[str], combiner: Combiner, inputs: list[str], fanout: int = FANOUT) -> DataFrame:
    """One row of keys, salt and state per (task, key)."""
    schema = _schema(df, keys, {SALT: "int", **combiner.state})
    arrow, most = to_arrow_schema(schema), MAX_KEYS
    return df.select(*keys, *inputs).mapInArrow(lambda it: _partials(it, combiner, keys, inputs, most, arrow, fanout), schema)


def combine_per_key(df: DataFrame, keys: list[str], combiner: Combiner, inputs: list[str], fanout: int = FANOUT) -> DataFrame:
    """Result of ``combiner`` over the ``inputs`` of every key; NULL keys are keys."""
    states = partials(df, keys, combiner, inputs, fanout)
    arrow = to_arrow_schema(states.schema)
    salted = states.repartition(*keys, SALT).sortWithinPartitions(*keys, SALT)
    joined = salted.mapInArrow(lambda it: _merged(it, combiner, keys, arrow, False), states.schema)
    result = _schema(df, keys, combiner.result)
    arrow_result = to_arrow_schema(result)
    return joined.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda it: _merged(it, combiner, keys, arrow_result, True), result)


def combine_globally(df: DataFrame, combiner: Combiner, inputs: list[str]) -> DataFrame:
    """The same over all rows: one row, also for an empty table."""
    one = df.withColumn("_all", F.lit(0))
    zero = df.sparkSession.range(1).select(F.lit(0).alias("_all"))
    return zero.join(combine_per_key(one, ["_all"], combiner, inputs), "_all", "left").drop("_all")
