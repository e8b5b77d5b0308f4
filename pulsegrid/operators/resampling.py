"""Bootstrap over subjects: all draws at once as vectors, sums that combine before their shuffle, exact pooled quantiles.

A subject's weight in a draw is a Poisson(1) count from a hash of both, so no draw is ever shuffled: a task turns each of its subjects into
one vector of counts, multiplies what the subject contributes by it, and hands on one vector per key. Rows of subjects times draws never exist.
"""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsegrid.operators.carry import spread
from pulsegrid.session import checkpointed

DRAWS, SEED = 2000, 42
#: Cumulative shares of the counts 0, 1, ... in units of 2^-24: a digest holds ten draws of 24 bits.
SHARES = [int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2 ** 24) for k in range(10)]
MOST_KEYS = 4096            # vectors a task holds before it hands them on
ENTRIES = 1024              # contributions multiplied at once
REGION = 50_000             # values per key that one task takes for the exact end of a quantile


def counts(subjects: list[str], draws: int = DRAWS, seed: int = SEED) -> np.ndarray:
    """Counts of each subject in each draw, one row per subject."""
    digest, head = hashlib.sha256, [f"{seed}:{b}:".encode() for b in range(-(-draws // 10))]
    raw = b"".join([digest(h + s).digest() for s in map(str.encode, subjects) for h in head])
    part = np.frombuffer(raw, np.uint8).reshape(-1, 32)[:, :30].reshape(len(subjects), -1, 3)[:, :draws].astype(np.int32)
    return np.searchsorted(np.array(SHARES, np.int32), part[..., 0] << 16 | part[..., 1] << 8 | part[..., 2], side="right").astype(np.float64)


def counts_sql(subject: str) -> str:
    """The same count as SQL for a column ``draw``."""
    h = f"cast('0x' || substr(sha256('{SEED}:' || (draw // 10) || ':' || {subject}), 1 + 6 * (draw % 10), 6) as bigint)"
    return " + ".join(f"({h} >= {c})::int" for c in SHARES)


def weighted_sums(cells: DataFrame, draws: int = DRAWS) -> DataFrame:
    """(key, k, sums): per draw the sum of ``v`` times the subject's count over (subject, key, k, v) rows. ``subject`` and ``key`` are texts."""
    packed = spread(cells.where("v is not null").groupBy("subject").agg(F.collect_list(F.struct("key", "k", "v")).alias("c")), "subject")

    def rows(held: dict):
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.string()), pa.array([x[1] for x in held], pa.int64()),
                                          pa.array([x.tobytes() for x in held.values()], pa.binary())], ["key", "k", "sums"])

    def partial(batches):
        held: dict = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                weight = counts(part.column("subject").to_pylist(), draws)
                cell = part.column("c").flatten()
                names = cell.field("key").dictionary_encode()
                code = names.indices.to_numpy(zero_copy_only=False).astype(np.int64) << 32 | cell.field("k").to_numpy(zero_copy_only=False)
                value = cell.field("v").to_numpy(zero_copy_only=False)
                of = np.repeat(np.arange(part.num_rows), part.column("c").value_lengths().to_numpy(zero_copy_only=False))
                order = np.argsort(code, kind="stable")
                for at in range(0, len(order), ENTRIES):
                    some = order[at:at + ENTRIES]
                    first = np.flatnonzero(np.diff(code[some], prepend=-1))
                    sums = np.add.reduceat(weight[of[some]] * value[some, None], first, axis=0)
                    for c, s in zip(code[some][first].tolist(), sums):
                        name = (names.dictionary[c >> 32].as_py(), c & 0xFFFFFFFF)
                        held[name] = held[name] + s if name in held else s
                    if len(held) > MOST_KEYS:
                        yield from rows(held)
                        held = {}
        yield from rows(held)

    def whole(name: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": [name[0]], "k": [name[1]], "sums": [sum(map(np.frombuffer, pdf["sums"]))]})

    return packed.mapInArrow(partial, "key string, k long, sums binary").groupBy("key", "k").applyInPandas(whole, "key string, k long, sums array<double>")


def interval(per_draw: np.ndarray, low: float = 2.5, high: float = 97.5) -> tuple[float, float]:
    """Percentile interval over the draws that have a value."""
    known = per_draw[np.isfinite(per_draw)]
    return tuple(np.percentile(known, [low, high])) if len(known) else (np.nan, np.nan)


def pooled_quantiles(values: DataFrame, probs: dict[str, float], draws: int = DRAWS, bins: int = 64, region: int = REGION) -> DataFrame:
    """(key, name, per_draw): exact quantiles, interpolated between order statistics, of all values of a key in every draw, each value taken as
    often as its subject (null where a draw takes none). ``values``: (subject, key, x).

    Values fall into bins whose borders are approximate quantiles; the weighted bin counts of a draw tell which bin holds its ranks. Bins that
    no draw needs are done; the rest is binned again until at most ``region`` values of a key are left, which one task sorts. Any borders
    give the same result: they decide how much is left only, and each parts at least one value from the others of its bin.
    """
    values = checkpointed(values.where("x is not null").select(F.col("subject").cast("string").alias("subject"), F.col("key").cast("string").alias("key"), F.col("x").cast("double").alias("x")))
    left = values.withColumn("cell", F.lit(0).cast("long"))
    wanted, done, base = None, None, 0                         # wanted: cell and rank inside it of every draw, as arrays per (key, name, side)
    while True:
        size = left.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if wanted is not None and size <= region:
            return _finish(left.unionByName(done), wanted, probs, draws)
        base += 1 << 32                                        # numbers of cells never come twice
        cut = [i / bins for i in range(1, bins)] if wanted is None else [i / 16 for i in range(1, 16)]
        borders = left.groupBy("key", "cell").agg(F.array_distinct(F.percentile_approx("x", cut, 10_000)).alias("borders"))
        placed = left.join(F.broadcast(checkpointed(borders)) if wanted is None else checkpointed(borders), ["key", "cell"])
        # even places are the values between two borders, odd ones the values equal to a border: a tied value ends alone in its bin
        below = F.size(F.filter("borders", lambda b: b < F.col("x")))
        placed = checkpointed(placed.select("subject", "key", "cell", "x", (below * 2 + F.array_contains("borders", F.col("x")).cast("int")).cast("long").alias("place")))
        numbers = placed.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("cell", "place"))).alias("bin"))
        numbers = checkpointed(numbers.select("key", F.posexplode("bin").alias("next", "b")).select("key", "b.cell", "b.place", F.col("next").cast("long").alias("next")))
        named = placed.join(numbers, ["key", "cell", "place"]).select("subject", "key", "x", "cell", "next")
        sums = weighted_sums(named.groupBy("subject", "key", F.col("next").alias("k")).agg(F.count("*").cast("double").alias("v")), draws)
        cells = named.groupBy("key", F.col("next").alias("k")).agg(F.first("cell").alias("cell"), F.min("x").alias("low"), F.max("x").alias("high"))
        wanted = checkpointed(_locate(sums.join(cells, ["key", "k"]), wanted, probs, draws, base))
        alive = wanted.select("key", F.explode("cells").alias("cell")).distinct()
        left = checkpointed(named.select("subject", "key", "x", (F.col("next") + base).alias("cell")).join(alive, ["key", "cell"], "left_semi"))
        tied = checkpointed(cells.where("low = high").select("key", (F.col("k") + base).alias("cell")))
        # a bin of one value is settled: one row of it is enough for the end
        settled = left.join(tied, ["key", "cell"], "left_semi").groupBy("key", "cell").agg(F.min("x").alias("x"))
        settled = checkpointed(settled.select(F.lit(None).cast("string").alias("subject"), "key", "x", "cell"))
        done = settled if done is None else done.unionByName(settled)
        left = left.join(tied, ["key", "cell"], "left_anti")


def _locate(sums: DataFrame, wanted: DataFrame | None, probs: dict[str, float], draws: int, base: int) -> DataFrame:
    """(key, name, cells, ranks, share): per quantile and neighbour the bin of each draw and the rank inside it."""
    def first(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", ignore_index=True)
        total = np.cumsum(np.stack(pdf["sums"].to_list()), axis=0)
        out = []
        for name, q in probs.items():
            at = np.maximum(total[-1] - 1, 0) * q
            for side, rank in (("low", np.floor(at)), ("high", np.ceil(at))):
                out.append((key[0], name, side, *_bin(total, pdf["k"].to_numpy() + base, rank), at - np.floor(at), total[-1] > 0))
        return pd.DataFrame(out, columns=["key", "name", "side", "cells", "ranks", "share", "known"])

    schema = "key string, name string, side string, cells array<long>, ranks array<double>, share array<double>, known array<boolean>"
    if wanted is None:
        return sums.groupBy("key").applyInPandas(first, schema)

    def again(key: tuple, pdf: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return old                                         # all its cells are settled
        pdf = pdf.sort_values("k", ignore_index=True)
        weight, cell = np.stack(pdf["sums"].to_list()), pdf["cell"].to_numpy()
        out = old.copy()
        for i in range(len(out)):
            cells, ranks = (np.array(out.at[i, c]) for c in ("cells", "ranks"))
            for c in np.unique(cells):
                inside = np.flatnonzero(cell == c)
                if len(inside):
                    d = np.flatnonzero(cells == c)
                    found, rest = _bin(np.cumsum(weight[inside][:, d], axis=0), pdf["k"].to_numpy()[inside] + base, ranks[d])
                    cells[d], ranks[d] = found, rest
            out.at[i, "cells"], out.at[i, "ranks"] = cells, ranks
        return out

    return sums.groupBy("key").cogroup(wanted.groupBy("key")).applyInPandas(again, schema)


def _bin(total: np.ndarray, number: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bin whose running count exceeds the rank, per draw, and the rank from its beginning."""
    at = np.minimum((total <= rank).sum(axis=0), len(total) - 1)
    before = np.where(at > 0, total[np.maximum(at - 1, 0), np.arange(total.shape[1])], 0)
    return number[at], rank - before


def _finish(left: DataFrame, wanted: DataFrame, probs: dict[str, float], draws: int) -> DataFrame:
    def end(key: tuple, pdf: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cell", "x"], ignore_index=True)
        found = {(n, s): np.full(draws, np.nan) for n, s in zip(want["name"], want["side"])}
        cells, ranks = np.stack(want["cells"].to_list()), np.stack(want["ranks"].to_list())
        for c, part in pdf.groupby("cell"):
            x, here = part["x"].to_numpy(), cells == c
            at, before = np.zeros(cells.shape, int), np.zeros(draws)
            if not part["subject"].isna().any() and x[0] != x[-1]:
                for start in range(0, len(x), ENTRIES):        # running counts a stretch of values at a time
                    total = before + np.cumsum(counts(part["subject"].to_list()[start:start + ENTRIES], draws), axis=0)
                    for i in range(len(want)):
                        d = np.flatnonzero(here[i])
                        at[i, d] += (total[:, d] <= ranks[i, d]).sum(axis=0)
                    before = total[-1]
            for i in range(len(want)):
                found[want["name"].iloc[i], want["side"].iloc[i]][here[i]] = x[np.minimum(at[i][here[i]], len(x) - 1)]
        out = []
        for name in probs:
            row = want[(want["name"] == name) & (want["side"] == "low")].iloc[0]
            low, high = found[name, "low"], found[name, "high"]
            out.append((key[0], name, np.where(np.array(row["known"], bool), low + (high - low) * np.array(row["share"]), np.nan)))
        return pd.DataFrame(out, columns=["key", "name", "per_draw"])

    return left.groupBy("key").cogroup(wanted.groupBy("key")).applyInPandas(end, "key string, name string, per_draw array<double>")
