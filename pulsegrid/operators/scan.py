"""Recurrences along runs of any length, exact at any block size.

A recursive filter moves a small state through a run: state' = A state + B x. Over a block of n samples that is an affine map, A^n and what the
block adds from a zero state. Blocks are mapped on their own, the maps are composed along the run, one small row per block, and every
block is filtered again from the state it really starts with. Nothing is cut off and nothing overlaps.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions import kernels as kn
from pulsegrid.session import checkpointed

STEP = 64                   # samples that one matrix product advances


class Recurrence:
    """State space of a cascade of sections, with the matrices that advance many rows ``STEP`` samples at a time."""

    def __init__(self, sections):
        self.a, b, c, d = kn._state_space(sections)
        power = [np.eye(len(self.a))]
        for _ in range(STEP):
            power.append(self.a @ power[-1])
        impulse = np.concatenate([d.ravel(), [(c @ power[k] @ b).item() for k in range(STEP - 1)]])
        i, j = np.indices((STEP, STEP))
        self.respond = np.where(i >= j, impulse[np.maximum(i - j, 0)], 0.0)
        self.observe = np.vstack([c @ power[k] for k in range(STEP)])
        self.drive = np.hstack([power[STEP - 1 - k] @ b for k in range(STEP)])
        self.power = power
        self.steady = np.linalg.solve(np.eye(len(self.a)) - self.a, b).ravel()

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs of all rows and the states after them."""
        out = np.empty_like(x)
        for s in range(0, x.shape[1], STEP):
            u = x[:, s:s + STEP]
            n = u.shape[1]
            out[:, s:s + n] = u @ self.respond[:n, :n].T + state @ self.observe[:n].T
            state = state @ self.power[n].T + u @ self.drive[:, STEP - n:].T
        return out, state


def _extended(x: np.ndarray, first: bool, last: bool, edge: int) -> np.ndarray:
    """Rows with the odd extension of ``edge`` samples where they begin or end a run."""
    head = [2 * x[:, :1] - x[:, edge:0:-1]] if first else []
    tail = [2 * x[:, -1:] - x[:, -2:-edge - 2:-1]] if last else []
    return np.hstack([*head, x, *tail])


def filter_runs(df: DataFrame, group: list[str], column: str, name: str, sections, edge: int, block: int = 8192) -> DataFrame:
    """Zero-phase filter of every run (rows: group, ``j`` from 0 in the run, ``run_size``, ``k``, column): (group, ``k``, ``j``, name).

    A run begins and ends with its odd extension of ``edge`` samples and the steady state of its outermost value, as in one pass over it. A run
    of at most ``edge`` samples, or with a missing value, has no output. Runs of one block take one step; longer ones are filtered block
    by block from composed states, forwards and then backwards. The last block takes the rest of the run, so none is shorter than ``block``.
    """
    if block <= edge:
        raise ValueError("a block has to be longer than the extension")
    blocks = F.greatest(F.lit(1), F.floor(F.col("run_size") / block))
    d = df.withColumns({"_blocks": blocks, "_block": F.least(F.floor(F.col("j") / block), blocks - 1)})
    d = d.groupBy(*group, "_blocks", "_block").agg(F.array_sort(F.collect_list(F.struct("j", column, "k"))).alias("_s"))
    d = checkpointed(d.select(*group, "_blocks", "_block", F.col(f"_s.{column}").alias("x"), F.col("_s.k").alias("k"), F.col("_s.j").alias("j")))
    types = dict(d.dtypes)
    fields = ", ".join(f"{g} {types[g]}" for g in group)
    rec = Recurrence(sections)
    by = [*group, "_block"]
    width = len(rec.a)

    def alike(pdf: pd.DataFrame):
        """Rows of one length and one kind of ends, as a matrix."""
        first, last = pdf["_block"] == 0, pdf["_block"] == pdf["_blocks"] - 1
        for (n, head, tail), rows in pdf.groupby([pdf["x"].map(len), first, last]):
            x = np.stack([np.array(v, float) for v in rows["x"]])
            yield rows, (_extended(x, head, tail, edge) if n > edge else x), head, tail, n > edge

    def result(rows, y):
        n = y.shape[1]
        flat = {g: np.repeat(rows[g].to_numpy(), n) for g in group}
        return pd.DataFrame({**flat, "k": np.concatenate(rows["k"].to_list()), "j": np.concatenate(rows["j"].to_list()), name: y.ravel()})

    def inner(y, head, tail):
        return y[:, edge * head:y.shape[1] - edge * tail]

    def at_once(batches):
        for pdf in batches:
            for rows, u, head, tail, enough in alike(pdf):
                if enough:
                    y = rec.run(u, rec.steady * u[:, :1])[0][:, ::-1]
                    y = inner(rec.run(y, rec.steady * y[:, :1])[0][:, ::-1], head, tail)
                else:
                    y = np.full(u.shape, np.nan)
                yield result(rows, y)

    def forwards(pdf_rows, u, head):
        return rec.run(u, np.stack(pdf_rows["_in"].to_list()))[0]

    def mapped(batches):
        """What each block adds from a zero state, its length with extensions, and the state a run begins with."""
        for pdf in batches:
            for rows, u, head, tail, _ in alike(pdf):
                yield states(rows, u, head)

    def mapped_back(batches):
        for pdf in batches:
            for rows, u, head, tail, _ in alike(pdf):
                yield states(rows, forwards(rows, u, head)[:, ::-1], tail)

    def states(rows, u, begins):
        adds = rec.run(u, np.zeros((len(u), width)))[1]
        start = rec.steady * u[:, :1] if begins else np.full((len(u), width), np.nan)
        return pd.DataFrame({**{c: rows[c].to_numpy() for c in by}, "n": u.shape[1], "adds": list(adds), "start": list(start)})

    def composed(backwards: bool):
        def compose(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_block", ascending=not backwards, ignore_index=True)
            state, powers, out = np.array(pdf["start"].iloc[0], float), {}, []
            for n, adds in zip(pdf["n"], pdf["adds"]):
                out.append(state)
                if n not in powers:
                    powers[n] = np.linalg.matrix_power(rec.a, int(n))
                state = powers[n] @ state + np.array(adds, float)
            return pd.DataFrame({**{c: pdf[c] for c in by}, "_back" if backwards else "_in": out})
        return compose

    def finished(batches):
        for pdf in batches:
            for rows, u, head, tail, _ in alike(pdf):
                y = rec.run(forwards(rows, u, head)[:, ::-1], np.stack(rows["_back"].to_list()))[0][:, ::-1]
                yield result(rows, inner(y, head, tail))

    out_schema, small = f"{fields}, k long, j long, {name} double", f"{fields}, _block long, n int, adds array<double>, start array<double>"
    one = d.where("_blocks = 1").mapInPandas(at_once, out_schema)
    long = d.where("_blocks > 1")
    into = checkpointed(long.mapInPandas(mapped, small).groupBy(*group).applyInPandas(composed(False), f"{fields}, _block long, _in array<double>"))
    placed = long.join(into, by)
    back = placed.mapInPandas(mapped_back, small).groupBy(*group).applyInPandas(composed(True), f"{fields}, _block long, _back array<double>")
    many = placed.join(checkpointed(back), by).mapInPandas(finished, out_schema)
    both = one.unionByName(many)
    return both.withColumn(name, F.when(~F.isnan(name), F.col(name)))


# ---- splines ----------------------------------------------------------------

def _moments(t: np.ndarray, x: np.ndarray, left: bool, right: bool) -> np.ndarray:
    """Second derivatives of a block's own samples as (p, q, r): p + q * the one before the block + r * the one behind it.

    ``t`` and ``x`` hold one sample more on each side that has a neighbour; where there is none the run ends and its derivative is zero.
    """
    h = np.diff(t)
    n = len(t) - left - right
    low, main, up, rhs = np.zeros(n), np.ones(n), np.zeros(n), np.zeros((n, 3))
    inside = np.arange(len(t))[1:-1]
    own = inside - left
    slope = np.diff(x) / h
    low[own], main[own], up[own] = h[inside - 1], 2 * (h[inside - 1] + h[inside]), h[inside]
    rhs[own, 0] = 6 * (slope[inside] - slope[inside - 1])
    if left:
        rhs[0, 1] = -low[0]
    if right:
        rhs[-1, 2] = -up[-1]
    for i in range(1, n):
        f = low[i] / main[i - 1]
        main[i] -= f * up[i - 1]
        rhs[i] -= f * rhs[i - 1]
    rhs[-1] /= main[-1]
    for i in range(n - 2, -1, -1):
        rhs[i] = (rhs[i] - up[i] * rhs[i + 1]) / main[i]
    return rhs


def _borders(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives before and behind each block of a run, from every block's first and last (p, q, r): forward elimination and substitution.

    Going forwards, the last derivative of a block becomes u + v * the first one of the next block, with the same for its own first.
    """
    n = len(first)
    u, v, fu, fv = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    before_u = before_v = 0.0                           # the last derivative of the block before: before_u + before_v * own first
    for b in range(n):
        (p, q, r), (lp, lq, lr) = first[b], last[b]
        scale = 1 / (1 - q * before_v)                  # first = p + q (before_u + before_v first) + r next
        fu[b], fv[b] = (p + q * before_u) * scale, r * scale
        u[b] = lp + lq * (before_u + before_v * fu[b])
        v[b] = lr + lq * before_v * fv[b]
        before_u, before_v = u[b], v[b]
    behind, before, nxt = np.zeros(n), np.zeros(n), 0.0
    for b in range(n - 1, -1, -1):
        behind[b] = nxt
        nxt = fu[b] + fv[b] * nxt
    for b in range(1, n):
        before[b] = u[b - 1] + v[b - 1] * behind[b - 1]
    return before, behind


def spline_borders(blocks: DataFrame, group: list[str]) -> DataFrame:
    """(group, ``block``, ``before``, ``behind``) of blocks (``kt``, ``kx`` with their neighbours, ``left``, ``right``): blocks are eliminated on their
    own, and the small system of their borders is solved along each run, one row per block."""
    types = dict(blocks.dtypes)
    fields = ", ".join(f"{g} {types[g]}" for g in group) + ", block long"
    by = [*group, "block"]

    def eliminate(batches):
        for pdf in batches:
            ends = [_moments(np.array(t, float), np.array(x, float), a, b)[[0, -1]].ravel() for t, x, a, b in zip(pdf["kt"], pdf["kx"], pdf["left"], pdf["right"])]
            yield pd.DataFrame({**{c: pdf[c] for c in by}, "ends": ends})

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ignore_index=True)
        ends = np.stack(pdf["ends"].to_list())
        before, behind = _borders(ends[:, :3], ends[:, 3:])
        return pd.DataFrame({**{c: pdf[c] for c in by}, "before": before, "behind": behind})

    return blocks.mapInPandas(eliminate, f"{fields}, ends array<double>").groupBy(*group).applyInPandas(solve, f"{fields}, before double, behind double")


def spline_moments(t: np.ndarray, x: np.ndarray, left: bool, right: bool, before: float, behind: float) -> np.ndarray:
    """Second derivatives of a block's own samples."""
    return _moments(t, x, left, right) @ [1.0, before, behind]


def spline_at(t: np.ndarray, x: np.ndarray, left: bool, right: bool, before: float, behind: float, at: np.ndarray) -> np.ndarray:
    """The spline of a block at places between its first and its last sample, neighbours included."""
    m = spline_moments(t, x, left, right, before, behind)
    m = np.concatenate([[before] if left else [], m, [behind] if right else []])
    h = np.diff(t)
    k = np.clip(np.searchsorted(t, at, side="right") - 1, 0, len(t) - 2)
    a, b = t[k + 1] - at, at - t[k]
    return (m[k] * a ** 3 + m[k + 1] * b ** 3) / (6 * h[k]) + (x[k] / h[k] - m[k] * h[k] / 6) * a + (x[k + 1] / h[k] - m[k + 1] * h[k] / 6) * b
