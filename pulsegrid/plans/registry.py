"""Registry of runnable queries and the SQL that checks them."""
from __future__ import annotations

from collections.abc import Callable
from textwrap import dedent

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

# Shared sub-selects of the checking SQL, spelled independently of the Spark plans.
TRACE = """trace as (select user_id as recording, event_id, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6 as t,
  "value" as x, event_type <> 'error' as valid, event_type from events)"""
CUFF = """cuff as (select user_id as recording, event_id,
  (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6 as start_sec,
  case when "value" >= 5 then (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6 + "value" * 60e0 end as end_sec,
  "value" from events where event_type = 'purchase')"""
GRID = """bounds as (select recording, min(t) as t0, max(t) as t1 from trace group by 1),
grid as (select recording, k, t0 + k / (1 / 3600e0) as t from
  (select recording, t0, unnest(range(0, cast(floor((t1 - t0) * (1 / 3600e0) + 1e-8) as bigint) + 1)) as k from bounds))"""
RESAMPLED = """good as (select recording, t, x from trace where valid),
lastgood as (select recording, max(t) as tl from good group by 1),
nb as (select g.recording, g.k, g.t, l.t as lt, l.x as lx, r.t as rt, r.x as rx, z.tl from grid g
  asof left join good l on g.recording = l.recording and g.t > l.t
  asof left join good r on g.recording = r.recording and g.t <= r.t
  left join lastgood z on g.recording = z.recording),
uniform as (select recording, k, t,
  case when rt - t <= 1e-8 then rx when rt is null and t - lt <= 1e-8 then lx
       when rt - lt <= 86400e0 + 1e-8 then lx * (1 - (t - lt) / (rt - lt)) + rx * ((t - lt) / (rt - lt)) end as x,
  coalesce(not (rt - t <= 1e-8) and rt - lt <= 86400e0 + 1e-8, false) as imputed from nb)"""
COLOUR = """colour as (select l_suppkey as recording, l_shipdate, l_orderkey, l_linenumber, l_quantity as r,
  l_extendedprice / 942.4777960769379e0 as g, l_tax * 100e0 + 1e0 as b, l_discount as discount, l_returnflag as flag,
  datediff('day', date '1992-01-01', cast(l_shipdate as date)) as "day",
  row_number() over (partition by l_suppkey order by cast(l_shipdate as date), l_orderkey, l_linenumber, l_quantity,
  l_extendedprice / 942.4777960769379e0) - 1 as i from lineitem),
cw as (select *, i // 64 as window_index, i % 64 as pos, count(*) over (partition by recording, i // 64) as n from colour)"""
WAVES = """w as (select vec_id, label as subject, generate_subscripts(embedding, 1) - 1 as i,
  cast(unnest(embedding) as double) as x from embeddings)"""
PAIRS = WAVES + """,
p as (select a.vec_id, a.subject, a.i, a.x, b.x as y from w a join w b on b.vec_id = a.vec_id + 1 and b.i = a.i)"""
EVAL = """ev as (select o_orderkey, o_custkey as subject, o_orderpriority as method,
  datediff('day', date '1992-01-01', cast(o_orderdate as date)) as start_day,
  case when o_orderstatus <> 'P' then o_totalprice / 942.4777960769379e0 end as pred, ref, o_orderstatus as status
  from orders left join (select l_orderkey, sum(l_extendedprice * (1 - l_discount)) / 942.4777960769379e0 as ref
  from lineitem group by 1) on l_orderkey = o_orderkey)"""


def R(expr: str, digits: int = 6) -> str:
    """SQL twin of ``cols.rnd``."""
    return f"(case when isfinite(cast({expr} as double)) then round(cast({expr} as double), {digits}) + 0.0 end)"


def unrounded(key: str) -> str:
    """The checking SQL of another query without its output rounding, for use as a sub-select."""
    return ORACLES[key].replace(", 6) + 0.0 end)", ", 15) + 0.0 end)")


def query(key: str, oracle: str | None = None):
    def register(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = fn
        if oracle:
            ORACLES[key] = dedent(oracle).strip()
        return fn
    return register
