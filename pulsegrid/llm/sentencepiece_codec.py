"""Operator 3: SentencePiece encoding and decoding of whole texts through the prefix table of ``pieces``."""
from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pulsegrid.llm.arrow import map_text, rows_of
from pulsegrid.llm.pieces import pieces
from pulsegrid.llm.registry import query, table

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", ids: str = "ids", limit: int = 1 << 20) -> DataFrame:
    """``docs`` with the ids of each whole text, the end id last. A null or empty text has only the end id.

    A column that is already called ``ids`` is replaced. One pass, no shuffle; each row stands alone, about ``limit`` bytes of text are encoded at once.
    """
    docs = docs.drop(ids)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batch):
        own = pieces(model)
        end = np.array([own.end], np.int32)
        parts = [own.ids(t).astype(np.int32) for t in rows_of(batch, text)]
        offsets = np.cumsum([0, *(len(p) + 1 for p in parts)], dtype=np.int32)
        values = np.concatenate([x for p in parts for x in (p, end)]) if parts else end[:0]
        return dict(zip(batch.schema.names, batch.columns)) | {ids: pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))}

    return map_text(docs, run, schema, text, limit)


def decode(docs: DataFrame, model: str = MODEL, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of each id list (null: null); broken byte sequences become replacement characters."""
    docs = docs.drop(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(text, T.StringType())])

    @F.pandas_udf("string")
    def back(column):
        own = pieces(model)
        return column.map(lambda x: None if x is None else own.decode(list(x)))

    return docs.withColumn(text, back(ids)).select(schema.fieldNames())


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per row: doc_id, number of ids, hash of the ids and of the text decoded from them (null text: empty)."""
    def run(batch):
        own = pieces(model)
        got = [own.digests(t) for t in rows_of(batch)]
        return {"doc_id": batch.column("doc_id"), "n_tokens": [x[0] for x in got], "ids_sha256": [x[1] for x in got], "decoded_sha256": [x[2] for x in got]}

    return map_text(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op3_sentencepiece_codec")
def op3(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))
