"""Applying a function of one Arrow batch to a DataFrame, a few megabytes of text at a time."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulsegrid.llm.words import CHUNK_BYTES, chunks


def map_text(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: T.StructType | str, text: str = "text",
             limit: int = CHUNK_BYTES) -> DataFrame:
    """``fn`` gets slices of about ``limit`` bytes of ``text`` (never part of a row) and returns columns by name."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text, limit):
                got = fn(part)
                yield pa.RecordBatch.from_arrays([cell(got[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def cell(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    if isinstance(values, np.ndarray) and values.dtype == np.uint64:
        values = values.view(np.int64)
    return pa.array(values, kind)


def rows_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch (null: empty)."""
    return [x or "" for x in batch.column(column).to_pylist()]
