"""Regression baselines from mergeable normal equations."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def moments(x: list[Column], y: list[Column]) -> dict[str, Column]:
    """Sums that determine every linear fit of the y on the x: count, sums, products."""
    out = {"n": F.count(F.lit(1)).cast("double")}
    for i, a in enumerate(x):
        out[f"s{i}"] = F.sum(a)
        for j in range(i, len(x)):
            out[f"p{i}_{j}"] = F.sum(a * x[j])
        for t, b in enumerate(y):
            out[f"c{i}_{t}"] = F.sum(a * b)
    for t, b in enumerate(y):
        out[f"t{t}"] = F.sum(b)
    return out


def solve(sums, features: int, targets: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Ridge weights and intercepts on standardized features (population SD, flat columns scale 1), for one row of sums or a table of them."""
    column = lambda name: np.asarray(sums[name], float)
    n = column("n")
    s = np.stack([column(f"s{i}") for i in range(features)], -1)
    p = np.stack([np.stack([column(f"p{min(i, j)}_{max(i, j)}") for j in range(features)], -1) for i in range(features)], -2)
    c = np.stack([np.stack([column(f"c{i}_{t}") for t in range(targets)], -1) for i in range(features)], -2)
    t = np.stack([column(f"t{t}") for t in range(targets)], -1)
    mean = s / n[..., None]
    cov = p - s[..., :, None] * mean[..., None, :]
    sd = np.sqrt(np.clip(np.diagonal(cov, axis1=-2, axis2=-1) / n[..., None], 0, None))
    sd = np.where(sd < 1e-12, 1.0, sd)
    z = cov / (sd[..., :, None] * sd[..., None, :])
    w = np.linalg.solve(z + alpha * np.eye(features), (c - mean[..., :, None] * t[..., None, :]) / sd[..., None]) / sd[..., None]
    return w, t / n[..., None] - (mean[..., None, :] @ w)[..., 0, :]


def leave_one_out(folds: DataFrame, features: int, targets: int, alpha: float) -> DataFrame:
    """Weights per (subject, feature set) from leave-one-out sums; a batch's systems of one size are solved together."""
    fields = ", ".join([f"w{i}_{t} double" for i in range(features) for t in range(targets)] + [f"b{t} double" for t in range(targets)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            w, b = np.zeros((len(pdf), features, targets)), np.zeros((len(pdf), targets))
            for used in pdf["used"].unique():
                rows = np.flatnonzero(pdf["used"] == used)
                w[rows, :used], b[rows] = solve(pdf.iloc[rows], int(used), targets, alpha)
            names = [f.split()[0] for f in fields.split(", ")]
            values = pd.DataFrame(np.hstack([w.reshape(len(pdf), -1), b]), columns=names)
            yield pd.concat([pdf[["subject", "feature_set"]].reset_index(drop=True), values], axis=1)

    return folds.mapInPandas(run, f"subject long, feature_set string, {fields}")
