"""Operator 7: toxicity by a factorization machine over hashed terms.

Terms are the lower-cased words of a text and their beginnings of three to six bytes, hashed into 2^22 buckets; a document holds a
bucket or not. The machine adds a bias, a weight for each held bucket and, for each pair of held buckets, the inner product of their
factors, so that two terms can mean more together than apart. The pair sum costs no pairs: it is half of (sum of factors) squared
minus the sum of squared factors.

Fitted on at most ``SAMPLE`` labelled documents, chosen by a hash of their id, so the driver holds a bounded amount whatever the size
of the input; only buckets whose presence goes with the label beyond chance take part. Every document is scored, in one pass.
Defined cases: a null or empty text scores by the bias alone; without labels of both kinds every score is the share of label 1
(0 without labels); a label with a null id or value is ignored, of repeated labels the largest counts; label, language, source and
id are never inputs of a score.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pulsegrid.llm.arrow import map_text
from pulsegrid.llm.registry import query, table
from pulsegrid.llm.words import LOWER, U, Words, chunks, span_hashes, text_bytes

SAMPLE = 10_000
BUCKET_BITS = 22
PREFIXES = (3, 4, 5, 6)
FACTORS, STEPS, RATE, SHRINK = 8, 250, 0.05, 2e-4
EVIDENCE = 25.0            # least likelihood-ratio statistic of a bucket
WEIGHT = 4.0               # of a row with label 1
MOST_BUCKETS = 8192
STAGE_BYTES = 1 << 20      # text scored at once where whole rows go through the task
EDGE = np.zeros(256, bool)
EDGE[list(b".,;:!?\"'()[]{}|*#")] = True


@dataclass
class Machine:
    buckets: np.ndarray     # sorted
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def raw(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        """Sum for each row, from its held terms (positions in ``buckets``)."""
        out = self.bias + np.bincount(row, self.weight[term], rows)
        for f in self.factor.T:
            v = f[term]
            out += 0.5 * (np.bincount(row, v, rows) ** 2 - np.bincount(row, v * v, rows))
        return out


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capital letters of the Latin-1 range in lower case."""
    out = LOWER[data]
    if len(data):
        after = np.flatnonzero(data[:-1] == 0xC3) + 1
        capital = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
        out[capital] += 0x20
    return out


def held(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) pairs without repeats; ``keep`` marks the buckets wanted."""
    words = Words(lowered(data), offsets)
    starts, ends = words.starts.copy(), words.ends.copy()
    for _ in range(4):                                  # up to four marks on either side of a word
        starts[(ends - starts > 1) & EDGE[words.data[np.minimum(starts, len(data) - 1)]]] += 1
        ends[(ends - starts > 1) & EDGE[words.data[ends - 1]]] -= 1
    found = []
    for length in (0, *PREFIXES):
        longer = np.flatnonzero(ends - starts > length) if length else np.arange(len(starts))
        stop = starts[longer] + length if length else ends
        h = (span_hashes(words.data, starts[longer], stop) ^ U(length * 0x9E3779B97F4A7C15 & (2 ** 64 - 1))) >> U(64 - BUCKET_BITS)
        row = words.row[longer]
        if keep is not None:
            some = keep[h]
            h, row = h[some], row[some]
        found.append((row.astype(np.uint64) << U(BUCKET_BITS)) | h)
    both = np.unique(np.concatenate(found))
    return (both >> U(BUCKET_BITS)).astype(np.int64), (both & U((1 << BUCKET_BITS) - 1)).astype(np.int64)


def learnable(doc_id: str = "doc_id"):
    """Rows whose label may be learned from: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int):
    """Held buckets of the sampled labelled documents, as one packed array per document, at most ``sample`` rows."""
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learnable())
              .groupBy("doc_id").agg(F.max(label).alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")        # at most ``sample`` ids

    def run(batch):
        row, bucket = held(*text_bytes(batch.column("text")))
        cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
        packed = bucket.astype(np.int32)
        return {"_label": batch.column("_label"), "held": [packed[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]}

    return map_text(some, run, "_label int, held binary").limit(sample).collect()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Machine:
    got = sorted(training_rows(docs, labels, label, sample), key=lambda r: (r["_label"], bytes(r["held"])))     # the same sums whatever order rows arrive in
    y = np.array([r["_label"] for r in got], float)
    none = np.zeros(0)
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 0.0
        return Machine(none.astype(np.int64), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), none, np.zeros((0, FACTORS)))
    sets = [np.frombuffer(r["held"], np.int32) for r in got]
    row, bucket = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets]), np.concatenate(sets)
    buckets = select(bucket, y[row], y)
    wanted = np.zeros(1 << BUCKET_BITS, bool)
    wanted[buckets] = True
    known = wanted[bucket]
    return train(buckets, row[known].astype(np.int64), np.searchsorted(buckets, bucket[known]), y)


def select(bucket: np.ndarray, label: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Buckets whose presence and the label depend on each other, by the likelihood-ratio statistic of the two-by-two table."""
    size = 1 << BUCKET_BITS
    seen = np.bincount(bucket, minlength=size).astype(float)
    hit = np.bincount(bucket, label, size)
    some = np.flatnonzero(seen >= 3)
    n, n1, a, s = len(y), y.sum(), hit[some], seen[some]
    cells = [(a, s * n1 / n), (s - a, s * (n - n1) / n), (n1 - a, (n - s) * n1 / n), (n - n1 - s + a, (n - s) * (n - n1) / n)]
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * sum(np.where(o > 0, o * np.log(o / e), 0) for o, e in cells)
    best = some[np.argsort(-g, kind="stable")][:MOST_BUCKETS]
    return np.sort(best[np.sort(-g)[:len(best)] <= -EVIDENCE])


def train(buckets: np.ndarray, row: np.ndarray, term: np.ndarray, y: np.ndarray) -> Machine:
    """Logistic loss with shrinkage, adaptive full-batch steps."""
    rng = np.random.default_rng(7)
    n, m = len(y), len(buckets)
    cost = np.where(y > 0, WEIGHT, 1.0)
    cost /= cost.sum()
    flat = np.concatenate([[np.log(y.mean() / (1 - y.mean()))], np.zeros(m), rng.normal(0, 0.05, m * FACTORS)])
    mean, square = np.zeros_like(flat), np.zeros_like(flat)
    for step in range(1, STEPS + 1):
        machine = Machine(buckets, flat[0], flat[1:m + 1], flat[m + 1:].reshape(m, FACTORS))
        error = (1 / (1 + np.exp(-np.clip(machine.raw(row, term, n), -30, 30))) - y) * cost
        slope = np.empty_like(flat)
        slope[0] = error.sum()
        slope[1:m + 1] = np.bincount(term, error[row], m)
        for k, f in enumerate(machine.factor.T):
            v = f[term]
            sums = np.bincount(row, v, n)
            slope[m + 1 + k::FACTORS] = np.bincount(term, error[row] * (sums[row] - v), m)
        slope[1:] += SHRINK * flat[1:]
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope ** 2
        flat = flat - RATE * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-9)
    return Machine(buckets, float(flat[0]), flat[1:m + 1].copy(), flat[m + 1:].reshape(m, FACTORS).copy())


def scored(docs: DataFrame, machine: Machine, score: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1; a column of that name is replaced."""
    docs = docs.drop(score)
    shared = docs.sparkSession.sparkContext.broadcast(machine)          # at most MOST_BUCKETS rows of weights

    def run(batch):
        own = shared.value
        keep = np.zeros(1 << BUCKET_BITS, bool)
        keep[own.buckets] = True
        row, bucket = held(*text_bytes(batch.column("text")), keep)
        raw = own.raw(row, np.searchsorted(own.buckets, bucket), batch.num_rows)
        return dict(zip(batch.schema.names, batch.columns)) | {score: 1 / (1 + np.exp(-np.clip(raw, -30, 30)))}

    return map_text(docs, run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def below(docs: DataFrame, machine: Machine, limit: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score below ``limit``, with the columns they have. Others are dropped in the task that scores them."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)          # at most MOST_BUCKETS rows of weights

    def run(batches):
        own = shared.value
        keep = np.zeros(1 << BUCKET_BITS, bool)
        keep[own.buckets] = True
        for batch in batches:
            for part in chunks(batch, "text", STAGE_BYTES):
                row, bucket = held(*text_bytes(part.column("text")), keep)
                raw = own.raw(row, np.searchsorted(own.buckets, bucket), part.num_rows)
                yield part.filter(pa.array(1 / (1 + np.exp(-np.clip(raw, -30, 30))) < limit))

    return docs.mapInArrow(run, docs.schema)


@query("op7_toxicity_machine")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
