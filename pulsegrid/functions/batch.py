"""Arrow batch wrapper: array columns become [windows, samples] matrices.

The kernel sees only equal-length, fully finite rows; every other row and
every row on which the kernel fails keeps its place with NULL results. Numeric
results become Arrow arrays without a Python step per element.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def _by_length(columns: list[pa.Array]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Yield (row numbers, matrices) per array length, complete rows only."""
    lengths = []
    for c in columns:
        n = np.diff(c.offsets.to_numpy())
        lengths.append(np.where(np.asarray(c.is_valid()), n, -1))
    same = np.all([x == lengths[0] for x in lengths], axis=0) & (lengths[0] > 0)
    for size in np.unique(lengths[0][same]):
        rows = np.flatnonzero(same & (lengths[0] == size))
        take = pa.array(rows)
        mats = [c.take(take).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), size)
                for c in columns]
        ok = np.all([np.isfinite(m).all(axis=1) for m in mats], axis=0)
        if ok.any():
            yield rows[ok], [m[ok] for m in mats]


def job(inputs: list[str], kernel: Callable, outputs: str, **params) -> tuple:
    """One kernel call: ``kernel(*matrices, **params)`` returns one sequence per output field,
    each with one entry per row: numbers (NaN becomes NULL), or lists for array fields."""
    return inputs, kernel, T.StructType.fromDDL(outputs).fields, params


ROWS = 1024          # rows a kernel sees at once


def apply_kernels(df: DataFrame, jobs: list[tuple]) -> DataFrame:
    """Append the columns of several kernels in one Arrow pass over ``df``; a kernel may read the columns of those before it.

    A kernel keeps a few spectra or lag products per row, far more than the row, so a batch is passed in parts of ``ROWS``.
    """
    added = [f for _, _, fields, _ in jobs for f in fields]
    schema = T.StructType(df.schema.fields + added)
    arrow = to_arrow_schema(schema)
    width = len(df.columns)

    def run(batches):
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows or 1, ROWS)):
            extra, known = [], dict(zip(batch.schema.names, batch.columns))
            for inputs, kernel, fields, params in jobs:
                cols = [_plain_list(known[c]) for c in inputs] if batch.num_rows else []
                done = [part for rows, mats in (_by_length(cols) if cols else ()) for part in _results(kernel, rows, mats, params)]
                kinds = [arrow.field(width + len(extra) + k).type for k in range(len(fields))]
                new = [_column([(rows, values[k]) for rows, values in done], kind, batch.num_rows) for k, kind in enumerate(kinds)]
                extra += new
                known |= zip((f.name for f in fields), new)
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=arrow.names)

    return df.mapInArrow(run, schema)


FAILURES = (ArithmeticError, ValueError, LookupError, TypeError, np.linalg.LinAlgError)


def _results(kernel: Callable, rows: np.ndarray, mats: list[np.ndarray], params: dict) -> list[tuple[np.ndarray, list]]:
    """Results of a group of rows; if the kernel fails on it, of each row on which it does not fail alone."""
    try:
        return [(rows, list(kernel(*mats, **params)))]
    except FAILURES:
        if len(rows) == 1:
            return []
    half = len(rows) // 2
    return [r for cut in (slice(0, half), slice(half, None)) for r in _results(kernel, rows[cut], [m[cut] for m in mats], params)]


def _column(parts: list[tuple[np.ndarray, object]], kind: pa.DataType, size: int) -> pa.Array:
    """One output column: the groups' values at their rows, NULL elsewhere."""
    place = np.full(size, -1)
    at = 0
    for rows, _ in parts:
        place[rows] = np.arange(at, at + len(rows))
        at += len(rows)
    values = pa.concat_arrays([_values(v, kind, len(rows)) for rows, v in parts]) if parts else pa.nulls(0, kind)
    return values.take(pa.array(np.maximum(place, 0), mask=place < 0))


def _values(v, kind: pa.DataType, size: int) -> pa.Array:
    if isinstance(v, np.ndarray) and v.dtype.kind in "fiub":
        flat = v.ravel()
        if v.ndim == 1:
            return _numbers(flat, kind)
        if v.ndim == 2 and pa.types.is_list(kind):
            return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, v.shape[1], dtype=np.int32)), _numbers(flat, kind.value_type)).cast(kind)
    return pa.array([_clean(x) for x in v], type=kind)


def _numbers(flat: np.ndarray, kind: pa.DataType) -> pa.Array:
    missing = ~np.isfinite(flat) if flat.dtype.kind == "f" else None
    if missing is not None and not pa.types.is_floating(kind):
        flat = np.where(missing, 0, flat)
    return pa.array(flat, mask=missing).cast(kind)


def apply_kernel(df: DataFrame, inputs: list[str], kernel: Callable, outputs: str, **params) -> DataFrame:
    """Append one kernel's columns to every row of ``df``."""
    return apply_kernels(df, [job(inputs, kernel, outputs, **params)])


def _plain_list(c):
    if isinstance(c, pa.ChunkedArray):
        c = c.combine_chunks()
    return pa.concat_arrays([c])  # re-bases sliced offsets


def _clean(v):
    if v is None or isinstance(v, (bool, np.bool_, str)):
        return None if v is None else (v if isinstance(v, str) else bool(v))
    if isinstance(v, (list, tuple, np.ndarray)):
        return [_clean(x) for x in v]
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, dict):
        return {k: _clean(x) for k, x in v.items()}
    return float(v) if np.isfinite(v) else None
