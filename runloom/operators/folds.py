"""Folds over keyed rows in order that hold one batch and what the open item needs, however many rows a key has."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

KINDS = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}


def _same(a: tuple, b: tuple) -> bool:
    return all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))


def fold_sorted(
    df: DataFrame, keys: list[str], order: list[str | Column],
    step: Callable[[Any, dict[str, list]], tuple[list[tuple], Any]], finish: Callable[[Any], list[tuple]], output: dict[str, str],
) -> DataFrame:
    """keys and ``output`` of each key's rows, folded along ``order``.

    ``step`` takes the state (None at a key's start) and a piece of the key's columns, and returns the rows that are done
    and the state; ``finish`` returns the rows left at a key's end.  ``output`` names the type of each column, or the column
    of ``df`` that has it.  A key's rows go through one task in time, as each decision needs the one before, but never lie
    in its memory together: Spark sorts the partitions, and spills.
    """
    at = [df.columns.index(k) for k in keys]
    names, kinds = list(df.columns), [df.schema[k].dataType.simpleString() for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, types = None, None, []

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [*keys, *output])

        for batch in batches:
            if not batch.num_rows:
                continue
            types = types or [batch.schema.types[i] for i in at] + [KINDS.get(t) or batch.schema.types[names.index(t)] for t in output.values()]
            new = np.zeros(batch.num_rows, bool)
            for i in at:
                codes = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            columns = {c: batch.column(i).to_pylist() for i, c in enumerate(names)}
            rows = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                here = tuple(columns[k][a] for k in keys)
                if key is not None and not _same(here, key):
                    rows += [(*key, *r) for r in finish(state)]
                    state = None
                key = here
                done, state = step(state, {c: v[a:b] for c, v in columns.items()})
                rows += [(*key, *r) for r in done]
            if rows:
                yield made(rows)
        if key is not None and (rows := [(*key, *r) for r in finish(state)]):
            yield made(rows)

    schema = [f"`{k}` {t}" for k, t in zip(keys, kinds, strict=True)] + [f"`{c}` {t if t in KINDS else df.schema[t].dataType.simpleString()}" for c, t in output.items()]
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, ", ".join(schema))
