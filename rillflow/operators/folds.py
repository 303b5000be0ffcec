"""Folds over a key's rows in order, one row at a time: no key is ever held as a whole."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

FLUSH = 20_000


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str], n_keys: int) -> Iterator[tuple[tuple, tuple]]:
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            yield row[:n_keys], row[n_keys:]


def _packed(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        cols = list(zip(*held, strict=True)) if held else [[] for _ in schema]
        held.clear()
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= FLUSH:
            yield batch()
    yield batch()


def fold(df: DataFrame, keys: list[str], order: list[str], values: list[str], schema: T.StructType, make: Callable) -> DataFrame:
    """``make(key)`` gives an object whose ``row(*values)`` is called for each row of the key in ``order``, and whose
    ``end()`` is called after the last; both return rows of ``schema``. Its state is all that a task holds."""
    arrow, columns = to_arrow_schema(schema), [*keys, *values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            key = state = None
            for own, row in _runs(batches, columns, len(keys)):
                if state is None or own != key:
                    if state is not None:
                        yield from state.end()
                    key, state = own, make(own)
                yield from state.row(*row)
            if state is not None:
                yield from state.end()

        return _packed(rows(), arrow)

    ordered = df.select(*dict.fromkeys([*columns, *order])).repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.select(*dict.fromkeys(columns)).mapInArrow(run, schema)


class Accumulator:
    """A user's own aggregate: an empty state, a row added, two states merged, the result."""

    def create(self):
        raise NotImplementedError

    def add(self, state, *values):
        raise NotImplementedError

    def merge(self, a, b):
        raise NotImplementedError

    def result(self, state):
        raise NotImplementedError


def accumulate(df: DataFrame, keys: list[str], values: list[str], accumulator: Accumulator, result: T.StructField, held: int = 50_000) -> DataFrame:
    """``accumulator`` over each key, with the result as a column: partial states in every task, merged after an exchange.

    A task holds at most ``held`` keys' states at a time and sends them on when there are more; so a frequent key costs
    the exchange a state a task, not its rows.
    """
    key_fields = [df.schema[k] for k in keys]
    partial = T.StructType([*key_fields, T.StructField("_state", T.BinaryType())])
    final = T.StructType([*key_fields, result])
    partial_arrow, columns = to_arrow_schema(partial), [*keys, *values]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            states: dict = {}
            for key, row in _runs(batches, columns, len(keys)):
                if key not in states:
                    if len(states) >= held:
                        yield from ((*k, pickle.dumps(s)) for k, s in states.items())
                        states.clear()
                    states[key] = accumulator.create()
                states[key] = accumulator.add(states[key], *row)
            yield from ((*k, pickle.dumps(s)) for k, s in states.items())

        return _packed(rows(), partial_arrow)

    class Merge:
        def __init__(self, key):
            self.key, self.state = key, None

        def row(self, state):
            new = pickle.loads(state)
            self.state = new if self.state is None else accumulator.merge(self.state, new)
            return ()

        def end(self):
            return [(*self.key, accumulator.result(self.state))]

    return fold(df.select(*columns).mapInArrow(add, partial), keys, [], ["_state"], final, Merge)
