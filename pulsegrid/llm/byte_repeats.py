"""Operator 5: repeated byte strings by sharded suffix arrays.

A window is ``width`` bytes of one document. Its anchor is the smallest hash of its ``gram``-byte strings, so equal windows have equal
anchors; consecutive windows with one anchor form a stretch. Equal stretches collapse by content; one place of each supplies its bytes. Stretches of one anchor go to one
shard, where a suffix array is built by induced sorting (``suffixes``) over the stretches joined by separators; a window is repeated if
the permuted common prefix with its neighbour in the order, on either side, spans it. A window lies in exactly one stretch, so a
match is always between two different places, in one document or in two.

Sound at any size and skew: an anchor that occurs once is dropped at the scan by a bit map of fixed size; copies collapse before they
meet; an anchor with more than ``MOST_STRETCHES`` different stretches is dealt over several shards, each of which reports one hash for
each class of equal windows that its array finds, packed by parts of the hashes; a part of all shards finds the classes that they share.
Shards hold about ``SHARD_BYTES``.

Defined cases: null and empty texts have no bytes and lose none; rows equal in doc_id and text are two occurrences, and both get the
one result; a null doc_id is an id like any other.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.arrow import map_text
from pulsegrid.llm.registry import query, table
from pulsegrid.llm.seeds import KEY, covered, with_spans
from pulsegrid.llm.slots import maybe, slots, within
from pulsegrid.llm.suffixes import common_prefixes, suffix_array
from pulsegrid.llm.words import U, combine, mix, sequence_hashes, sliding_min, text_bytes
from pulsegrid.session import checkpointed

WIDTH, GRAM = 200, 64
SHARD_BYTES, MOST_STRETCHES = 1 << 19, 4096
READ_BYTES = 1 << 20
BYTE = mix(np.arange(1, 257, dtype=np.uint64))
STEP = 0x9E3779B97F4A7C15 | 3
BACK = pow(STEP, -1, 2 ** 64)


def rolling(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every ``gram`` consecutive bytes, from running sums of a polynomial modulo 2^64."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up = np.full(len(data), U(STEP))
    up[0] = 1
    np.cumprod(up, out=up)
    up *= BYTE[data]
    np.cumsum(up, out=up)
    down = np.full(n, U(BACK))
    down[0] = 1
    np.cumprod(down, out=down)
    total = up[gram - 1:].copy()
    total[1:] -= up[:n - 1]
    total *= down
    return mix(total)


class Stretches:
    """Runs of windows of one row with one anchor value: row, first window (byte in the batch), windows, anchor, whether the anchor
    stands in the run twice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int, gram: int):
        grams = rolling(data, gram)
        reach = width - gram + 1
        bits = U(max(1, int(len(grams)).bit_length()))
        marked = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        place = (sliding_min(marked, reach) & ((U(1) << bits) - U(1))).astype(np.int64) if len(grams) >= reach else np.zeros(0, np.int64)
        last = np.repeat(offsets[1:] - width, np.diff(offsets))[:len(place)]
        at = np.flatnonzero(np.arange(len(place)) <= last)
        place = place[at]
        value = grams[place] if len(at) else np.zeros(0, np.uint64)
        new = np.ones(len(at), bool)
        new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        self.start, self.count, self.anchor = at[first], np.diff(np.append(first, len(at))), value[first]
        self.twice = place[first] != place[first + self.count - 1]
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.data, self.offsets, self.width = data, offsets, width

    def occurrence(self, rows: np.ndarray) -> np.ndarray:
        """Hash of each run's place: row hash and first byte."""
        return combine(rows[self.row], (self.start - self.offsets[self.row]).astype(np.uint64)) if len(self.start) else np.zeros(0, np.uint64)

    def content(self, k: int) -> bytes:
        return self.data[self.start[k]:self.start[k] + self.count[k] + self.width - 1].tobytes()


def found_in(batch: pa.RecordBatch, width: int, gram: int) -> Stretches:
    return Stretches(*text_bytes(batch.column("text")), width, gram)


def content_hash(content: bytes) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(content)


def signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def anchor_counts(docs: DataFrame, width: int, gram: int) -> DataFrame:
    def run(batch):
        s = found_in(batch, width, gram)
        anchor, which = np.unique(s.anchor, return_inverse=True)
        return {"_anchor": anchor, "_n": np.bincount(which, 1 + s.twice, len(anchor)).astype(np.int64)}

    return map_text(docs.select("text"), run, "_anchor long, _n long", limit=READ_BYTES).groupBy("_anchor").agg(F.sum("_n").alias("_n"))


def row_hashes(batch: pa.RecordBatch) -> np.ndarray:
    return combine(batch.column("_id").fill_null(-1).to_numpy().view(np.uint64), batch.column("_text").to_numpy().view(np.uint64))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), "text")


def stretches(docs: DataFrame, repeated, width: int, gram: int) -> DataFrame:
    def run(batch):
        s = found_in(batch, width, gram)
        some = np.flatnonzero(within(repeated, s.anchor)) if len(s.anchor) else np.zeros(0, np.int64)
        rows = pa.array(s.row[some])
        return {"_id": batch.column("_id").take(rows), "_text": batch.column("_text").take(rows), "_at": s.start[some] - s.offsets[s.row[some]],
                "_windows": s.count[some] * 2 + s.twice[some], "_anchor": s.anchor[some], "_place": s.occurrence(row_hashes(batch))[some],
                "_content": signed([content_hash(s.content(k)) for k in some.tolist()])}

    return map_text(keyed(docs), run, "_id long, _text long, _at int, _windows int, _anchor long, _place long, _content long", limit=READ_BYTES)


def contents(docs: DataFrame, chosen, width: int, gram: int) -> DataFrame:
    """The stretches at the chosen places with their bytes; a place is one document's, so nothing has to be merged."""
    def run(batch):
        s = found_in(batch, width, gram)
        some = np.flatnonzero(within(chosen, s.occurrence(row_hashes(batch)))) if len(s.anchor) else np.zeros(0, np.int64)
        parts = [s.content(k) for k in some.tolist()]
        return {"_anchor": s.anchor[some], "_content": signed([content_hash(p) for p in parts]), "_bytes": parts}

    return map_text(keyed(docs), run, "_anchor long, _content long, _bytes binary", limit=READ_BYTES)


REPEATS = "_anchor long, _content long, _runs array<long>, _part int, _told binary"
TOLD = np.dtype([("window", "<u8"), ("content", "<i8"), ("nth", "<i4"), ("alone", "?")])
PARTS = 8                    # parts for each shard of a dealt anchor


def packed(nth: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Runs of windows as numbers: the first window above 32 bits, the number of windows below."""
    return (nth.astype(np.int64) << 32) + n


def by_group(values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Groups that occur and the values of each; ``group`` is sorted."""
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    return group[first], np.split(values, first[1:]) if len(first) else []


def runs_of(stretch: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Stretches with windows, and the maximal runs of each; windows come sorted by stretch and place."""
    new = np.ones(len(nth), bool)
    new[1:] = (nth[1:] != nth[:-1] + 1) | (stretch[1:] != stretch[:-1])
    first = np.flatnonzero(new)
    return by_group(packed(nth[first], np.diff(np.append(first, len(nth)))), stretch[first])


def shard_repeats(rows: pd.DataFrame, width: int) -> pd.DataFrame:
    """Repeated windows of a shard: a row of runs per stretch. Of dealt anchors also one hash for each class of equal windows, with whether the
    window is alone here; those are packed, a row for each part of the hashes, so that no row is made per window."""
    rows = rows.drop_duplicates(["_anchor", "_content"]).reset_index(drop=True)       # rows that stand twice
    parts = rows["_bytes"].tolist()
    length = np.array([len(p) for p in parts])
    begin = np.cumsum(length + 1) - (length + 1)
    joined = np.frombuffer(b"\x00".join(parts) + b"\x00\x00", np.uint8).astype(np.int64) + 2
    joined[begin + length] = 1                                            # separators below all bytes, the end mark below them
    joined[-1] = 0
    order = suffix_array(joined)
    prefix = common_prefixes(joined, order)
    ordered = prefix[order]
    again = np.zeros(len(joined), bool)
    again[order] = (ordered >= width) | np.append(ordered[1:] >= width, False)
    stretch = np.repeat(np.arange(len(parts)), length + 1)
    nth = np.arange(len(joined) - 1) - begin[stretch]
    window = nth <= length[stretch] - width
    at = np.flatnonzero(again[:-1] & window)
    some, runs = runs_of(stretch[at], nth[at])
    anchor, content = rows["_anchor"].to_numpy(np.int64), rows["_content"].to_numpy(np.int64)
    out = [pd.DataFrame({"_anchor": anchor[some], "_content": content[some], "_runs": pd.Series(runs, dtype=object), "_part": pd.array([None] * len(some), "Int32"), "_told": None})]
    salts = rows["_salts"].to_numpy(np.int64)
    if (salts > 1).any():
        head = np.zeros(len(joined), bool)
        head[order] = ordered < width                                       # first of each class in the order
        at = np.flatnonzero(window & (salts > 1)[stretch] & head[:-1])
        told = np.zeros(len(at), TOLD)
        told["window"], told["content"] = sequence_hashes(mix(joined.astype(np.uint64)), width)[at], content[stretch[at]]
        told["nth"], told["alone"] = nth[at], ~again[at]
        part = (told["window"] % (salts[stretch[at]] * PARTS).astype(np.uint64)).astype(np.int64)
        _, which = np.unique(anchor[stretch[at]], return_inverse=True)
        sort = np.lexsort((part, which))
        _, each = by_group(sort, which[sort] * (int(part.max(initial=0)) + 1) + part[sort])
        one = np.array([g[0] for g in each], np.int64)
        out.append(pd.DataFrame({"_anchor": anchor[stretch[at[one]]], "_content": pd.array([None] * len(each), "Int64"), "_runs": None,
                                 "_part": part[one].astype(np.int32), "_told": pd.Series([told[g].tobytes() for g in each], dtype=object)}))
    return pd.concat([d.astype({"_content": "Int64", "_part": "Int32"}) for d in out], ignore_index=True)


def shared_windows(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Of one part of an anchor's classes: windows alone in their shard whose class another shard has too, a row of runs per stretch."""
    told = np.frombuffer(b"".join(rows["_told"]), TOLD)
    _, which, count = np.unique(told["window"], return_inverse=True, return_counts=True)
    hit = told[(count[which] > 1) & told["alone"]]
    hit = hit[np.lexsort((hit["nth"], hit["content"]))]
    content, runs = runs_of(hit["content"], hit["nth"])
    return pd.DataFrame({"_anchor": np.full(len(content), key[0]), "_content": content, "_runs": pd.Series(runs, dtype=object)})


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, most: int = MOST_STRETCHES) -> DataFrame:
    """Per document with repeated windows: ``_spans``, an array of (first byte, bytes)."""
    counts = anchor_counts(docs, width, gram)
    found = checkpointed(stretches(docs, slots(counts.where("_n > 1"), "_anchor"), width, gram))
    # ``_windows`` counts twice the windows, plus one if the anchor stands in the stretch twice.
    each = checkpointed(found.groupBy("_anchor", "_content").agg(F.count("*").alias("_copies"), F.max("_windows").alias("_windows"), F.min("_place").alias("_place")))
    twice = (F.col("_windows") % 2 == 1) & (F.col("_copies") == 1)
    # An array is needed where a stretch that stands once may hold windows of another, or the same window twice.
    anchors = checkpointed(each.groupBy("_anchor").agg(F.count("*").alias("_k"), F.min("_copies").alias("_least"), F.max(twice).alias("_twice"),
                                                       F.sum(F.shiftright("_windows", 1) + (width - 1)).alias("_bytes")).where("(_k > 1 and _least = 1) or _twice"))
    size = anchors.agg(F.sum("_bytes")).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    crowded = checkpointed(anchors.where(F.col("_k") > most).select("_anchor", F.ceil(F.col("_k") / most).cast("int").alias("_salts")))
    parts = contents(docs, slots(each.join(anchors, "_anchor", "left_semi"), "_place"), width, gram)
    parts = parts.join(crowded, "_anchor", "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    shard = F.pmod(F.xxhash64("_anchor", F.pmod("_content", F.col("_salts"))), F.lit(shards))
    sorted_ = checkpointed(parts.groupBy(shard.alias("_shard")).applyInPandas(lambda rows: shard_repeats(rows, width), REPEATS))
    # The other members of a class that is not alone in its shard are among the runs already.
    across = sorted_.where("_part is not null").groupBy("_anchor", "_part").applyInPandas(shared_windows, "_anchor long, _content long, _runs array<long>")
    once = sorted_.where("_part is null").select("_anchor", "_content", "_runs").union(across)
    # A stretch's runs meet in one row before any join, so that no join makes a row per window.
    once = once.groupBy("_anchor", "_content").agg(F.flatten(F.collect_list("_runs")).alias("_runs"))
    whole = each.where("_copies > 1").select("_anchor", "_content", F.array(F.shiftright("_windows", 1).cast("long")).alias("_runs"))
    repeats = checkpointed(whole.union(once.join(whole.select("_anchor", "_content"), ["_anchor", "_content"], "left_anti")))
    # Only stretches that may have runs are shuffled once more. A span is a run moved by the stretch's place.
    pair = F.xxhash64("_anchor", "_content")
    some = found.select(*KEY, "_at", "_anchor", "_content").where(maybe(slots(repeats.select(pair.alias("_pair")), "_pair"), pair))
    span = F.shiftleft(F.col("_at").cast("long"), 32) + F.lit(width - 1)
    spans = some.join(repeats, ["_anchor", "_content"]).select(*KEY, F.transform("_runs", lambda r: r + span).alias("_runs")).groupBy(*KEY).agg(F.flatten(F.collect_list("_runs")).alias("_runs"))
    return spans.select(*KEY, F.transform("_runs", lambda r: F.struct(F.shiftright(r, 32).cast("int").alias("at"), r.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("n"))).alias("_spans"))


def dedup_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, **parameters) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and hash of the kept bytes of every document."""
    both = with_spans(docs, checkpointed(repeated_spans(docs, width, gram, **parameters)))

    def run(batch):
        data, offsets = text_bytes(batch.column("text"))
        spans, gone, runs, kept = batch.column("_spans"), [], [], []
        for k, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
            own = data[a:b]
            if spans[k].is_valid:
                mark = covered(spans, k, b - a)
                gone.append(int(mark.sum()))
                runs.append(int(mark[:1].sum() + (mark[1:] & ~mark[:-1]).sum()))
                own = own[~mark]
            else:
                gone.append(0)
                runs.append(0)
            kept.append(hashlib.sha256(own.tobytes()).hexdigest())
        return {"doc_id": batch.column("doc_id"), "n_bytes": np.diff(offsets), "n_removed": gone, "n_spans": runs, "kept_sha256": kept}

    return map_text(both, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


@query("op5_suffix_arrays", oracle="""
    with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
    s as (select doc_id, unnest(range(0, greatest(length(x) // 2 - 199, 0))) as i, x from d),
    h as (select doc_id, i, md5(substr(x, 2 * i + 1, 400)) as win from s),
    m as (select win from h group by win having count(*) > 1),
    hit as (select doc_id, i from h semi join m using (win)),
    edge as (select doc_id, i, i - lag(i) over (partition by doc_id order by i) as step from hit),
    runs as (select doc_id, i, sum(case when step <= 200 then 0 else 1 end) over (partition by doc_id order by i) as run from edge),
    span as (select doc_id, run, min(i) as a, max(i) + 200 as b from runs group by 1, 2),
    keep as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as k0, a as k1 from span
      union all select d.doc_id, coalesce(max(b), 0), length(x) // 2 from d left join span using (doc_id) group by d.doc_id, x),
    kept as (select k.doc_id, string_agg(substr(x, 2 * k0 + 1, 2 * (k1 - k0)), '' order by k0) as y from keep k join d using (doc_id) group by 1),
    n as (select doc_id, count(*) as n from span group by 1)
    select d.doc_id, (length(x) // 2)::bigint as n_bytes, ((length(x) - length(y)) // 2)::bigint as n_removed, coalesce(n.n, 0)::bigint as n_spans,
      sha256(unhex(y)) as kept_sha256 from d join kept using (doc_id) left join n using (doc_id)""")
def op5(spark, sf_dir):
    return dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
