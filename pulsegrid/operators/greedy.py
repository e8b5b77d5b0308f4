"""Earliest-first choice of non-overlapping windows of one length, split by time."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pulsegrid.operators.carry import spread

SLACK = 1e-9


def _jumps(start: np.ndarray, length: float) -> np.ndarray:
    """For each window the next one the greedy choice would take (or the array length)."""
    return np.searchsorted(start, start + length - SLACK, side="left")


def nonoverlapping(windows: DataFrame, key: str, length: float, bucket_sec: float) -> DataFrame:
    """Mark the chosen windows; ``windows`` has (key, start_sec, ...), starts distinct per key.

    The choice inside a time bucket depends only on where the previous choice ended.
    Each bucket first tabulates, for the windows near its border, where a chain
    entering there would leave the bucket. Chains run together after a few windows, so
    a table has one row for each way out, with the last window that takes it. These few
    rows are walked per key, then every bucket makes its own choice from its known entry.
    """
    w = windows.withColumn("_b", F.floor(F.col("start_sec") / bucket_sec))
    key_type = dict(windows.dtypes)[key]

    def tabulate(pdf: pd.DataFrame) -> pd.DataFrame:
        start = np.sort(pdf["start_sec"].to_numpy())
        nxt, leave = _jumps(start, length), start + length
        for i in range(len(start) - 1, -1, -1):
            if nxt[i] < len(start):
                leave[i] = leave[nxt[i]]
        border = pdf["_b"].iloc[0] * bucket_sec + length
        near = np.searchsorted(start, border) + 1
        keep = np.append(leave[1:] != leave[:-1], True) & (np.arange(len(start)) < near)
        keep[min(near, len(start)) - 1] = True
        return pd.DataFrame({key: pdf[key].iloc[0], "_b": pdf["_b"].iloc[0], "start_sec": start[keep], "leave": leave[keep]})

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        out, end = [], -np.inf
        for b, part in pdf.sort_values(["_b", "start_sec"]).groupby("_b", sort=True):
            ok = part[part["start_sec"] >= end - SLACK]
            if len(ok):
                out.append((pdf[key].iloc[0], b, end))
                end = ok["leave"].iloc[0]
        return pd.DataFrame(out, columns=[key, "_b", "entry"])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start_sec")
        start = pdf["start_sec"].to_numpy()
        nxt, chosen = _jumps(start, length), np.zeros(len(start), bool)
        i = np.searchsorted(start, pdf["entry"].iloc[0] - SLACK) if pd.notna(pdf["entry"].iloc[0]) else len(start)
        while i < len(start):
            chosen[i] = True
            i = nxt[i]
        return pdf.assign(chosen=chosen).drop(columns=["_b", "entry"])

    small = w.select(key, "_b", "start_sec")
    table = spread(small, key, "_b").groupBy(key, "_b").applyInPandas(tabulate, f"{key} {key_type}, _b long, start_sec double, leave double")
    entry = spread(table, key).groupBy(key).applyInPandas(walk, f"{key} {key_type}, _b long, entry double")
    fields = ", ".join(f"{n} {t}" for n, t in windows.dtypes)
    return spread(w.join(entry, [key, "_b"], "left"), key, "_b").groupBy(key, "_b").applyInPandas(choose, fields + ", chosen boolean")
