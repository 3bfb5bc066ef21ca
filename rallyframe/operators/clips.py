"""Ordered work on clips: rows of a clip go to one task in frame order.

The unit of state is a clip, and clips run in parallel. A fold gets a clip's rows as one pandas frame, sorted
by frame; per-row code is a small step on a few numbers. What it gives goes back as Arrow columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def _whole_clips(df: DataFrame, keys: list[str], order: list[Column], worked: Callable[[pa.Table, np.ndarray], Iterable[pa.RecordBatch]], schema: str, rows: int, columns: list[str] | None = None) -> DataFrame:
    """`worked` takes sorted rows of several whole clips and where each begins, about `rows` at a time; a longer clip comes alone.
    `columns`: those that it needs, if others only tell the order."""

    def clips(table: pa.Table) -> np.ndarray:
        return np.flatnonzero(np.diff(table.select(keys).to_pandas().groupby(keys, sort=False, dropna=False).ngroup().to_numpy(), prepend=-1))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < rows:
                continue
            table = pa.Table.from_batches(held)
            first = clips(table)
            cut = int(first[-1])  # the last clip may go on
            if cut:
                yield from worked(table.slice(0, cut), first[:-1])
            held = table.slice(cut).to_batches()
            n = table.num_rows - cut
        if n:
            table = pa.Table.from_batches(held)
            yield from worked(table, clips(table))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*columns or df.columns).mapInArrow(run, schema)


def per_clip(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[pd.DataFrame], Iterable[tuple[Any, ...]]], schema: str, rows: int = 20_000) -> DataFrame:
    """`fold` takes a clip's sorted rows and gives rows of `schema` behind the keys. Clips are handed to Python many at a time, as
    most are short and each hand-over costs milliseconds."""
    kinds = dict(df.dtypes)
    full = ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema])
    fields = [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(full)]

    def batch(table: pa.Table, first: list[int], out: list[tuple]) -> pa.RecordBatch:
        own = [table.column(k).take(pa.array(first)).combine_chunks() for k in keys]
        values = [pa.array(c, kind, from_pandas=True) for c, (_, kind) in zip(zip(*out, strict=True), fields[len(keys) :], strict=True)]
        return pa.RecordBatch.from_arrays([*own, *values], [name for name, _ in fields])

    def worked(table: pa.Table, first: np.ndarray) -> Iterable[pa.RecordBatch]:
        # whole numbers and flags with nulls turn into other types in pandas, in the clips that have them: these are turned one by one
        exact = any(c.null_count and (pa.types.is_integer(c.type) or pa.types.is_boolean(c.type)) for c in table.columns)
        pdf = None if exact else table.to_pandas()
        of: list[int] = []
        out: list[tuple] = []
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), table.num_rows], strict=True):
            clip = table.slice(lo, hi - lo).to_pandas() if exact else pdf.iloc[lo:hi].reset_index(drop=True)
            out += fold(clip)
            of += [lo] * (len(out) - len(of))
            if len(out) >= rows:
                yield batch(table, of, out)
                of, out = [], []
        if out:
            yield batch(table, of, out)

    return _whole_clips(df, keys, [F.col(c).asc_nulls_last() for c in order], worked, full, rows)


def many_clips(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[pd.DataFrame, np.ndarray], Iterable[tuple[np.ndarray, pd.DataFrame]]], schema: str, rows: int = 100_000) -> DataFrame:
    """Several whole clips at a time, so that `fold` can step them together. It takes their sorted rows and each row's clip (0, 1, ...),
    and gives tables of `schema` with the clip of each row. A longer clip comes alone."""
    kinds = dict(df.dtypes)
    full = ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema])
    fields = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(full)])

    def worked(table: pa.Table, first: np.ndarray) -> Iterable[pa.RecordBatch]:
        clip = np.repeat(np.arange(len(first)), np.diff(first, append=table.num_rows))
        for which, out in fold(table.to_pandas(), clip):
            if len(out):
                own = [table.column(k).take(pa.array(first[which])) for k in keys]
                values = [pa.array(out[f.name], f.type, from_pandas=True) for f in list(fields)[len(keys) :]]
                yield from pa.Table.from_arrays([*own, *values], schema=fields).to_batches()

    return _whole_clips(df, keys, [F.col(c) for c in order], worked, full, rows)


def picked_rows(df: DataFrame, keys: list[str], order: list[str], columns: list[str], carry: list[str], fold: Callable[[pd.DataFrame, np.ndarray], tuple[np.ndarray, pd.DataFrame]], schema: str, rows: int = 100_000) -> DataFrame:
    """The rows that `fold` picks: their keys, `carry` as it is, and new columns of `schema`. It takes the `columns` of the sorted rows of
    several whole clips and each row's clip (0, 1, ...), and gives the numbers of the picked rows and their new columns."""
    kinds, own = dict(df.dtypes), [*keys, *carry]
    full = ", ".join([*(f"`{c}` {kinds[c]}" for c in own), schema])
    new = [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema)]

    def worked(table: pa.Table, first: np.ndarray) -> Iterable[pa.RecordBatch]:
        which, out = fold(table.select(columns).to_pandas(), np.repeat(np.arange(len(first)), np.diff(first, append=table.num_rows)))
        if len(which):
            values = [pa.array(out[name], kind, from_pandas=True) for name, kind in new]
            yield from pa.Table.from_arrays([*table.select(own).take(pa.array(which)).columns, *values], [*own, *(name for name, _ in new)]).to_batches()

    return _whole_clips(df, keys, [F.col(c) for c in order], worked, full, rows, list(dict.fromkeys([*own, *columns])))


def stretches(frames: pd.Series) -> list[tuple[int, int, int]]:
    """(frame, first, past the last) of each run of equal values of a sorted column."""
    values = frames.to_numpy()
    edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else np.zeros(1, int)
    return [(int(values[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def none(x: Any) -> Any:
    """Null for NaN."""
    return None if x is None or x != x else x
