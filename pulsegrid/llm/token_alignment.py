"""Operator 13: alignment of two tokenizers over the same bytes by divide and conquer at shared cuts.

Both encodings of a text spell the same bytes. A place where a token of each ends is a shared cut; what lies between two neighbouring cuts is a
group. An interval is taken at the middle of its first tokenizer's tokens: the end nearest to the middle that bisecting the second one's ends
also finds becomes a cut, and both halves go on by themselves. An interval without one is a group. All intervals of a batch
of texts take each step together, so a step is a handful of array operations.

How often two ids end together over all texts is counted by Spark; every text is then scored against those counts.
"""
from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.arrow import map_text, rows_of
from pulsegrid.llm.registry import query, table
from pulsegrid.session import checkpointed

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WIDE = 1 << 20                   # a pair of ids is one number: id of the first tokenizer * WIDE + id of the second
MOST_SHARED = 4_000_000          # pairs whose counts are broadcast (24 bytes each); beyond, texts and counts are joined
MOST_HELD = 1_000_000            # distinct pairs a task holds before it hands their counts on
CHUNK = 1 << 20                  # bytes of text aligned at once


def byte_of_sign() -> dict[str, int]:
    """Byte of each sign of a byte-level vocabulary: printable Latin bytes stand for themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level tokenizer file: ids of a text and the bytes of each id. No special tokens: their strings are plain text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        special = {t["content"] for t in whole["added_tokens"]}
        sign = byte_of_sign()
        self.bytes = {i: bytes(sign[c] for c in t) for t, i in whole["model"]["vocab"].items() if t not in special}
        self.coder = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.coder.encode_ordinary(t) for t in texts]


class Pieces:
    """A piece model: ids of a text (the model itself puts a blank before it) and the bytes of each id."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        self.bytes = {i: bytes([int(m.id_to_piece(i)[1:-1], 16)]) if m.is_byte(i) else b"" if m.is_control(i) else m.id_to_piece(i).replace("▁", " ").encode()
                      for i in range(m.get_piece_size())}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def opened(kind: type, path: str):
    """One set of tables per Python worker, with the byte length of each id."""
    own = kind(path)
    own.length = np.zeros(max(own.bytes) + 1, np.int64)
    own.length[list(own.bytes)] = [len(b) for b in own.bytes.values()]
    return own


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Places in ``ends_a`` (ascending) that ``ends_b`` (ascending) has too. ``first[i]:last[i]`` are the tokens of text i in ``ends_a``;
    both encodings of a text end together, so its last token is a cut from the start.

    Each round halves every interval: candidates are tried outwards from its middle until one is found by bisection or none is left.
    """
    cut = np.zeros(len(ends_a), bool)
    cut[last[last > first] - 1] = True
    low, high = first, last - 1                                         # the last token of an interval is a cut already
    while len(low := low[keep := low < high]):
        high = high[keep]
        middle = (low + high) >> 1
        found = np.full(len(low), -1)
        open_, step = np.arange(len(low)), 0
        while len(open_):
            away = (step + 1) >> 1
            place = middle[open_] + (away if step & 1 else -away)
            inside = (place >= low[open_]) & (place < high[open_])
            probe = ends_a[np.where(inside, place, 0)]
            at = np.searchsorted(ends_b, probe)
            hit = inside & (ends_b[np.minimum(at, len(ends_b) - 1)] == probe)
            found[open_[hit]] = place[hit]
            left = (middle[open_] - away >= low[open_]) | (middle[open_] + away < high[open_])
            open_, step = open_[~hit & left], step + 1
        halved = found >= 0                                             # the others are groups: nothing shared inside
        cut[found[halved]] = True
        low, high = np.concatenate([low[halved], found[halved] + 1]), np.concatenate([found[halved], high[halved]])
    return cut


class Aligned:
    """Alignment of a batch of texts: ids of both tokenizers, rows, and which of them end a group."""

    def __init__(self, texts: list[str], a, b):
        ids_a, ids_b = a.encode([" " + t for t in texts]), b.encode(texts)
        for r, t in enumerate(texts):
            if not t or not self._same(" " + t, ids_a[r], ids_b[r], a.bytes, b.bytes):
                ids_a[r], ids_b[r] = [], []
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        self.a, self.b = (np.array([i for x in ids for i in x], np.int64) for ids in (ids_a, ids_b))
        last = np.cumsum(self.n_a)
        ends_a, ends_b = np.cumsum(a.length[self.a]), np.cumsum(b.length[self.b])
        self.cut_a = shared_cuts(ends_a, ends_b, last - self.n_a, last) if len(ends_a) else np.zeros(0, bool)
        self.cut_b = np.zeros(len(ends_b), bool)
        self.cut_b[np.searchsorted(ends_b, ends_a[self.cut_a])] = True
        self.row_a, self.row_b = (np.repeat(np.arange(len(texts)), n) for n in (self.n_a, self.n_b))
        self.n_groups = np.bincount(self.row_a[self.cut_a], minlength=len(texts))

    @staticmethod
    def _same(text: str, ids_a: list[int], ids_b: list[int], bytes_a: dict, bytes_b: dict) -> bool:
        raw = text.encode()
        return b"".join([bytes_b[i] for i in ids_b]) == raw and b"".join([bytes_a[i] for i in ids_a]) == raw

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Row and id pair of every link: one per group, as one token of each tokenizer ends there."""
        return self.row_a[self.cut_a], self.a[self.cut_a] * WIDE + self.b[self.cut_b]

    def spelled(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` per row: ids of each group in order, groups in order."""
        group_a = np.cumsum(self.cut_a) - self.cut_a
        group_b = np.cumsum(self.cut_b) - self.cut_b
        place = np.concatenate([np.arange(len(self.a)) + np.searchsorted(group_b, group_a),              # a's tokens before the same group of b
                                np.arange(len(self.b)) + np.searchsorted(group_a, group_b, "right")])
        last_of_row = np.zeros(len(self.b), bool)
        last_of_row[np.cumsum(self.n_b)[self.n_b > 0] - 1] = True
        sign = np.concatenate([np.where(self.cut_a, 1, 0), np.where(last_of_row, 3, np.where(self.cut_b, 2, 0))])
        token = np.empty(len(place), np.int64)
        token[place] = np.concatenate([self.a, self.b]) * 4 + sign
        names = _names()
        known = names.get
        parts = [known(k) or names.setdefault(k, f"{k >> 2}{',|;'[k & 3] if k & 3 < 3 else ''}") for k in token.tolist()]
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(parts[s:e]) for s, e in zip([0, *ends], ends)]


@lru_cache(maxsize=1)
def _names() -> dict[int, str]:
    return {}


SCHEMA = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def align(docs: DataFrame, first: str = BYTE_BPE, second: str = PIECES, text: str = "text", groups: bool = False) -> DataFrame:
    """One row per document: ``row`` (all columns of the document but the text, packed, so no name clashes), tokens of both, groups, links, hash of the groups, and
    the distinct linked id pairs with their numbers. ``groups=True`` adds the groups themselves as text.

    Null and empty texts, and texts whose encodings do not spell a blank and the text, have no tokens: zeros, no pairs and an empty string.
    Each row stands alone; texts are aligned whole, about a megabyte at once or one text if it is longer. No shuffle.
    """
    packed = docs.select(F.struct(*[c for c in docs.columns if c != text]).alias("row"), F.col(text).alias("text"))
    schema = f"row {packed.schema['row'].dataType.simpleString()}, {SCHEMA}" + (", groups string" if groups else "")

    def run(batch: pa.RecordBatch) -> dict:
        own = Aligned(rows_of(batch), opened(ByteLevel, first), opened(Pieces, second))
        spelled = own.spelled()
        row, pair = own.links()
        order = np.lexsort((pair, row))
        row, pair = row[order], pair[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])
        at = np.flatnonzero(new)
        offsets = pa.array(np.searchsorted(row[at], np.arange(batch.num_rows + 1)).astype(np.int32))
        return {"row": batch.column("row"), "n_a": own.n_a, "n_b": own.n_b, "n_groups": own.n_groups, "n_links": own.n_groups,
                "groups_sha256": [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in spelled], "groups": spelled,
                "pairs": pa.ListArray.from_arrays(offsets, pa.array(pair[at])),
                "times": pa.ListArray.from_arrays(offsets, pa.array(np.diff(np.append(at, len(row))).astype(np.int32)))}

    return map_text(packed, run, schema, limit=CHUNK)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Links per id pair over all documents, and whether no other partner of its second id has more. Tasks hand on sums of up to ``MOST_HELD`` pairs."""
    def sums(batches):
        held_pairs, held_times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            pair = np.concatenate([held_pairs, batch.column("pairs").flatten().to_numpy(zero_copy_only=False)])
            held_pairs, at = np.unique(pair, return_inverse=True)
            held_times = np.bincount(at, np.concatenate([held_times, batch.column("times").flatten().to_numpy(zero_copy_only=False)]), len(held_pairs)).astype(np.int64)
            if len(held_pairs) > MOST_HELD:
                yield pa.RecordBatch.from_arrays([pa.array(held_pairs), pa.array(held_times)], ["pair", "n"])
                held_pairs, held_times = held_pairs[:0], held_times[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held_pairs), pa.array(held_times)], ["pair", "n"])

    counted = checkpointed(aligned.select("pairs", "times").mapInArrow(sums, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    most = counted.groupBy((F.col("pair") % WIDE).alias("second")).agg(F.max("n").alias("most"))
    return checkpointed(counted.join(most, counted["pair"] % WIDE == most["second"]).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def scored(aligned: DataFrame, counts: DataFrame, most_shared: int = MOST_SHARED) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum`` in place of its pairs. Counts of up to ``most_shared`` pairs are broadcast, more are joined."""
    rest = [c for c in aligned.columns if c not in ("pairs", "times")]
    if counts.count() > most_shared:
        numbered = checkpointed(aligned.withColumn("_at", F.monotonically_increasing_id()))
        each = numbered.select("_at", F.explode(F.arrays_zip("pairs", "times")).alias("_p")).select("_at", F.col("_p.pairs").alias("pair"), F.col("_p.times").alias("_t"))
        total = each.join(counts, "pair").groupBy("_at").agg(F.sum(F.when(F.col("best"), F.col("_t")).otherwise(0)).alias("n_best"), F.sum(F.col("_t") * F.col("n")).alias("count_sum"))
        return numbered.join(total, "_at", "left").select(*rest, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")])
    known = counts.toPandas().sort_values("pair")
    shared = aligned.sparkSession.sparkContext.broadcast((known["pair"].to_numpy(np.int64), known["n"].to_numpy(np.int64), known["best"].to_numpy(bool)))

    @F.pandas_udf("n_best long, count_sum long")
    def score(pairs: pd.Series, times: pd.Series) -> pd.DataFrame:
        key, n, best = shared.value
        size = pairs.map(len).to_numpy(np.int64)
        out = np.zeros((2, len(pairs)), np.int64)
        if size.sum():
            at = np.searchsorted(key, np.concatenate(pairs.to_list()))
            t = np.concatenate(times.to_list()).astype(np.int64)
            whole = np.stack([np.cumsum(t * best[at]), np.cumsum(t * n[at])])
            ends = np.cumsum(size)
            whole = np.concatenate([np.zeros((2, 1), np.int64), whole], 1)
            out = whole[:, ends] - whole[:, ends - size]
        return pd.DataFrame({"n_best": out[0], "count_sum": out[1]})

    return aligned.withColumn("_s", score("pairs", "times")).select(*rest, "_s.n_best", "_s.count_sum")


@query("op13_token_alignment")
def op13(spark, sf_dir):
    aligned = checkpointed(align(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return scored(aligned, pair_counts(aligned)).select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
