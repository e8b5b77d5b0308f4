"""Frame-by-frame clock choice, split into index blocks with an exact hand-over."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pulsegrid.operators.carry import spread, with_running


def _walk(index: np.ndarray, raw: np.ndarray, period: float, last: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Times and container flags from the last accepted time (None before the first frame)."""
    t, used = np.empty(len(raw)), np.zeros(len(raw), bool)
    for n, (i, r) in enumerate(zip(index, raw)):
        used[n] = np.isfinite(r) and r >= 0 and (last is None or r > last)
        t[n] = last = r if used[n] else (last + period if last is not None else i * period)
    return t, used


def sequential_clock(frames: DataFrame, key: str, index: str, raw: str, period: float, block: int) -> DataFrame:
    """Accept the container time when it increases, otherwise previous + ``period``; the source is kept per row.

    Measured against the nominal line (time minus index * period) a block forgets its entry
    as soon as one container time is accepted. Only the leading record highs of a block,
    up to the first above everything seen before, can be that frame; their exits are
    tabulated, the tables are walked per key, and each block is then replayed.
    """
    kind = dict(frames.dtypes)[key]
    d = frames.withColumns({"_b": F.floor(F.col(index) / block), "_v": F.col(raw) - F.col(index) * period})
    top = d.groupBy(key, "_b").agg(F.max("_v").alias("_m"))
    top = with_running(top.withColumn("_one", F.floor(F.col("_b") / 65536)), [key], "_one", ["_b"], inclusive=False, seen=(F.col("_m"), "max"))
    d = d.join(top.select(key, "_b", "seen"), [key, "_b"])

    def tabulate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        i, r = pdf[index].to_numpy(), pdf[raw].to_numpy(float)
        v = np.where(np.isfinite(r) & (r >= 0), r - i * period, -np.inf)
        limit = pdf["seen"].iloc[0]
        limit = np.inf if pd.isna(limit) else limit - period
        rows, best = [], -np.inf
        for n in range(len(v)):
            if v[n] > best:
                best = v[n]
                t, _ = _walk(i[n + 1:], r[n + 1:], period, r[n])
                leave = t[-1] if len(t) else r[n]
                rows.append((pdf[key].iloc[0], pdf["_b"].iloc[0], v[n], leave - i[-1] * period))
                if best > limit or not np.isfinite(limit):
                    break
        rows.append((pdf[key].iloc[0], pdf["_b"].iloc[0], np.inf, np.nan))      # nothing accepted: the entry passes through
        return pd.DataFrame(rows, columns=[key, "_b", "_v", "leave"])

    def hand_over(pdf: pd.DataFrame) -> pd.DataFrame:
        out, u = [], None
        for b, part in pdf.sort_values(["_b", "_v"]).groupby("_b", sort=True):
            out.append((pdf[key].iloc[0], b, u))
            hit = part[np.isfinite(part["_v"])] if u is None else part[(part["_v"] > u - period) & np.isfinite(part["_v"])]
            if len(hit):
                u = hit["leave"].iloc[0]
            elif u is None:
                u = 0.0
        return pd.DataFrame(out, columns=[key, "_b", "entry"])

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        i = pdf[index].to_numpy()
        u = pdf["entry"].iloc[0]
        t, used = _walk(i, pdf[raw].to_numpy(float), period, None if pd.isna(u) else u + (i[0] - 1) * period)
        return pd.DataFrame({key: pdf[key], index: i, "t": t, "source": np.where(used, "container", "nominal_fallback")})

    small = d.select(key, "_b", index, raw, "seen")
    table = spread(small, key, "_b").groupBy(key, "_b").applyInPandas(tabulate, f"{key} {kind}, _b long, _v double, leave double")
    entry = spread(table, key).groupBy(key).applyInPandas(hand_over, f"{key} {kind}, _b long, entry double")
    return spread(d.select(key, "_b", index, raw).join(entry, [key, "_b"]), key, "_b").groupBy(key, "_b").applyInPandas(
        replay, f"{key} {kind}, {index} long, t double, source string")
