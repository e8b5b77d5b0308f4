"""Operator 2: I-Match fingerprints.

The lexicon holds the terms (lower-cased words, as 64-bit hashes) whose share of documents lies in a band, that is whose inverse document
frequency does. A fingerprint hashes, for each of several randomised subsets of the lexicon, the sorted distinct terms that a text
has in the subset. Subsets take from a quarter to a five-hundredth of the lexicon: large ones change with any edit, small ones survive
edits of half a text, so the share of equal hashes falls with the amount of change. A subset that has no term of either text says
nothing and does not count.

The band bounds the lexicon: each of its terms is in ``LOW`` of the documents, so there are at most (mean number of distinct
words) / LOW. The count is checked against ``MOST_TERMS`` before it is broadcast.

Defined cases: null and empty texts have no words and an empty fingerprint (all "-"), alike only with each other (likeness 1); a text with
fewer than ``LEAST_TERMS`` lexicon terms is hashed over all its terms; equal texts have equal fingerprints.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.arrow import map_text
from pulsegrid.llm.registry import query, table
from pulsegrid.llm.words import CHUNK_BYTES, LOWER, U, Words, mix, text_bytes
from pulsegrid.session import checkpointed

LOW, HIGH = 0.002, 0.1
MOST_TERMS = 8_000_000
LEAST_TERMS = 6
RATES = [4] * 6 + [16] * 10 + [64] * 16 + [128] * 12 + [256] * 12 + [512] * 8        # one in so many terms, per subset
SEEDS = mix(np.arange(1, len(RATES) + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


def distinct_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of each row's distinct terms, sorted."""
    data, offsets = text_bytes(column)
    words = Words(LOWER[data], offsets)
    term = words.hashes()
    order = np.lexsort((term, words.row))
    row, term = words.row[order], term[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
    return row[new], term[new]


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted terms within the band of document shares. Counts combine per batch, per task and then by term."""
    def run(batch):
        term, n = np.unique(distinct_terms(batch.column("text"))[1], return_counts=True)
        return {"term": term, "n": n}

    total = docs.count()
    if not total:
        return np.zeros(0, np.uint64)
    counted = map_text(docs.select("text"), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    band = checkpointed(counted.where(F.col("n").between(max(2, low * total), high * total)).select("term"))
    if (size := band.count()) > MOST_TERMS:
        raise ValueError(f"{size} terms lie in the band; raise its lower end")
    return np.sort(np.array([r[0] for r in band.collect()], np.int64).view(np.uint64))


class Printer:
    """Fingerprints of a column of texts as a matrix: one row per text, one 32-bit hash per subset (0: no term)."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.first = np.zeros(1 << 20, bool)
        self.first[terms >> U(44)] = True

    def known(self, term: np.ndarray) -> np.ndarray:
        out = self.first[term >> U(44)]
        some = np.flatnonzero(out)
        if len(some):
            at = np.minimum(np.searchsorted(self.terms, term[some]), len(self.terms) - 1)
            out[some] = self.terms[at] == term[some]
        return out

    def __call__(self, column: pa.Array) -> np.ndarray:
        row, term = distinct_terms(column)
        known = self.known(term)
        few = np.bincount(row[known], minlength=len(column)) < LEAST_TERMS
        keep = known | few[row]
        row, term = row[keep], term[keep]
        out = np.zeros((len(column), len(RATES)), np.uint32)
        for k, (rate, seed) in enumerate(zip(RATES, SEEDS)):
            mine = mix(term ^ seed)
            some = mine < U(2 ** 64 // rate)
            r, h = row[some], mine[some]
            if not len(r):
                continue
            begin = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            nth = np.arange(len(r)) - np.repeat(begin, np.diff(np.append(begin, len(r))))       # place in the sorted terms
            total = np.add.reduceat(mix(h + nth.astype(np.uint64) * U(0x9E3779B97F4A7C15)), begin)
            out[r[begin], k] = np.maximum((mix(total) >> U(32)).astype(np.uint32), 1)
        return out


def as_text(prints: np.ndarray) -> list[str]:
    return ["".join(f"{x:08x}" if x else "-" for x in row) for row in prints.tolist()]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal hashes among the subsets with a term in either text; two empty fingerprints are alike."""
    told = (a > 0) | (b > 0)
    n = told.sum(axis=1)
    return np.where(n > 0, ((a == b) & told).sum(axis=1) / np.maximum(n, 1), 1.0)


def fingerprints(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """doc_id and fingerprint of every text, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    return map_text(docs.select("doc_id", "text"), lambda b: {"doc_id": b.column("doc_id"), "fingerprint": as_text(Printer(shared.value)(b.column("text")))},
                    "doc_id long, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt by ranges of doc_id, in descending order inside each range, every range followed by a copy of the first row of the
    next one (the last range by the first row of all), marked ``_copy``. One shuffle of the texts; null ids come last.

    Only range bounds and one id per range pass the driver.
    """
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.coalesce("doc_id", F.lit(-2 ** 63))
    keyed = docs.select("doc_id", "text").withColumns({"_o": order, "_t": F.xxhash64("text")})
    bounds = np.array(sorted(set(keyed.approxQuantile("_o", [k / parts for k in range(1, parts)], 0.25 / parts))))

    @F.pandas_udf("int")
    def part(values: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(bounds, values.to_numpy(float), side="left")).astype("int32")

    keyed = keyed.withColumn("_part", part("_o"))
    heads = sorted(keyed.groupBy("_part").agg(F.max(F.struct("_o", "_t")).alias("m")).select("_part", "m.*").collect())
    copies = [(h[0], h[1], h[2], heads[k - 1][0]) for k, h in enumerate(heads)]
    small = F.broadcast(spark.createDataFrame(copies, "_p int, _po long, _pt long, _to int"))          # one row for each range
    head = (F.col("_part") == F.col("_p")) & (F.col("_o") == F.col("_po")) & (F.col("_t") == F.col("_pt"))
    both = keyed.join(small, head, "left").withColumn("_copy", F.explode(F.when(F.col("_p").isNull(), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    dealt = both.withColumn("_part", F.when(F.col("_copy"), F.col("_to")).otherwise(F.col("_part"))).drop("_p", "_po", "_pt", "_to")
    return dealt.repartition(parts // 4, "_part").sortWithinPartitions("_part", "_copy", F.desc("_o"), F.desc("_t"))


def edited(text: str, after: str) -> str:
    """``text`` with its second half replaced by as much of the beginning of ``after``."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """Fingerprint of each text, of its edited text and the likeness to that and to the next document's."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType.fromDDL(COMPARED)
    arrow = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        printer, rows, size = Printer(shared.value), [], 0

        def flush(rows):
            """All rows but the last, each with the row behind it."""
            texts = [r[1] for r in rows]
            mine = [k for k, r in enumerate(rows[:-1]) if not r[2]]
            changed = [edited(texts[k], texts[k + 1]) for k in mine]
            own, other = printer(pa.array(texts, pa.large_string())), printer(pa.array(changed, pa.large_string()))
            at = np.array(mine, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((
                [rows[k][0] for k in mine], [len(texts[k]) for k in mine], [hashlib.sha256(t.encode()).hexdigest() for t in changed],
                as_text(own[at]), as_text(other), likeness(own[at], other), likeness(own[at], own[at + 1])), arrow)], schema=arrow)

        for batch in batches:
            for r in zip(batch.column(0).to_pylist(), (t or "" for t in batch.column(1).to_pylist()), batch.column(2).to_pylist()):
                rows.append(r)
                size += len(r[1])
                if size > CHUNK_BYTES // 2 and len(rows) > 1:
                    yield flush(rows)
                    rows, size = rows[-1:], len(r[1])
        if len(rows) > 1:
            yield flush(rows)

    return with_next(docs).select("doc_id", "text", "_copy").mapInArrow(run, schema)


@query("op2_imatch")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return compare_with_next(docs, lexicon(docs))
