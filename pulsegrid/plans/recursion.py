"""Checking SQL for recursive filters: the difference equations of a cascade, one sample per step of a recursive query."""
from __future__ import annotations

from pulsegrid.functions.kernels import bandpass_sections


def _pass(name: str, source: str, sections) -> str:
    """CTE ``name`` (key, n, i, o): source (key, n, u) run through the sections from the steady state of its first sample.

    A section with numerator g, 0, -g has no gain at rest, so only the first one starts from a state that is not zero.
    """
    gain = [float(num[0]) for num, _ in sections]
    state = [f"z{s}{k}" for s in range(len(sections)) for k in (1, 2)]
    start = [f"{-gain[0]!r} * u[1] as z01", f"{-gain[0]!r} * u[1] as z02", *[f"0e0 as {z}" for z in state[2:]]]
    value, step = "u[i + 1]", []
    for s, (_, den) in enumerate(sections):
        out = f"({gain[s]!r} * {value} + z{s}1)"
        step += [f"z{s}2 - ({float(den[1])!r}) * {out}", f"{-gain[s]!r} * {value} - ({float(den[2])!r}) * {out}"]
        value = out
    return (f"{name} as (select key, n, u, 0 as i, {', '.join(start)}, cast(null as double) as o from {source} union all\n"
            f"   select key, n, u, i + 1, {', '.join(step)}, {value} from {name} where i < len(u))")


def zero_phase_sql(name: str, source: str, fs: float, low: float, high: float, order: int = 3) -> str:
    """CTEs ending in ``name`` (key, y): the centred list x of ``source`` (key, x) filtered forwards and backwards with its odd extension."""
    sections, edge = bandpass_sections(low, high, fs, order), 3 * (2 * order + 1)
    return f"""{name}_e as (select key, len(x) as n, list_transform(list_reverse(x[2:{edge + 1}]), lambda v: 2 * x[1] - v) || x ||
   list_transform(list_reverse(x[len(x) - {edge}:len(x) - 1]), lambda v: 2 * x[len(x)] - v) as u from {source} where len(x) > {edge}),
 {_pass(name + '_f', name + '_e', sections)},
 {name}_r as (select key, n, list(o order by i desc) as u from {name}_f where i > 0 group by 1, 2),
 {_pass(name + '_b', name + '_r', sections)},
 {name} as (select key, (list(o order by i desc))[{edge + 1}:any_value(n) + {edge}] as y from {name}_b where i > 0 group by key)"""


def runs_sql(name: str, samples: str, fs: float, low: float, high: float, least: int, edge: int) -> str:
    """CTEs ending in ``name`` (recording, run, j, n, good, signal): runs of the valid rows of ``samples`` (recording, k, ok, v), filtered and blanked."""
    return f"""{name}_l as (select *, k - row_number() over (partition by recording order by k) as island from {samples} where ok),
 {name}_g as (select recording, min(k) as run, count(*) as n, list(v order by k) as v from {name}_l group by recording, island),
 {name}_s as (select {{'r': recording, 'k': run}} as key, list_transform(v, lambda a: a - list_avg(v)) as x from {name}_g where n >= {least} and n > {2 * edge}),
 {zero_phase_sql(name + '_z', name + '_s', fs, low, high)},
 {name} as (select g.recording, g.run, unnest(range(0, g.n)) as j, g.n, z.y is not null as good, z.y from {name}_g g left join {name}_z z on z.key = {{'r': g.recording, 'k': g.run}})"""
