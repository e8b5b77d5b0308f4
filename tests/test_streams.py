"""Keyed streams in event-time order: any order of files, any session."""
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.plans.streams import folded
from pulsegrid.streaming import operators as so
from pulsegrid.streaming.replay import EVENTS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """A day of a hot user and two others in twelve files whose rows and order have nothing to do with time."""
    folder = str(tmp_path_factory.mktemp("events"))
    r = random.Random(3)
    rows = [(k, 60.0 * k, (0, 0, 0, 1, 2)[k % 5], r.choice(["click", "view", "error"]), r.random() * 60) for k in range(1200)]
    df = spark.createDataFrame([(k, t, u, e, v, '{"k": %d}' % (k % 7)) for k, t, u, e, v in rows], "event_id long, t double, user_id long, event_type string, value double, props string")
    df = df.select("event_id", F.timestamp_seconds(F.lit(1704067200) + F.col("t")).cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props")
    df.select([c.split()[0] for c in EVENTS.split(", ")]).repartition(12, F.rand(5)).write.parquet(f"{folder}/events.parquet")
    return folder, rows


def expected_motion(rows, gap):
    last, out = {}, {}
    for k, t, u, e, v in rows:
        out[k] = None
        if e != "error":
            if u in last and t - last[u][0] <= gap:
                out[k] = ((v - last[u][1]) ** 2 + (k % 7 - last[u][2]) ** 2) ** .5 / (t - last[u][0]) * 3600
            last[u] = (t, v, k % 7)
    return out


@pytest.mark.parametrize("files, bucket, gap", [(1, 3600.0, 200.0), (None, 3600.0, 200.0), (1, 86400.0, 1e6), (5, 600.0, 700.0)])
def test_files_in_any_order(spark, shuffled, files, bucket, gap):
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")       # the session sets nothing
    folder, rows = shuffled
    got = folded(spark, folder, so.Motion(gap, bucket), "user_id long, event_id long, motion_per_hour double", "t-motion", delay="2 days", files_per_trigger=files).collect()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
    want = expected_motion(rows, gap)
    assert sorted(r["event_id"] for r in got) == sorted(want)
    for r in got:
        assert r["motion_per_hour"] == (None if want[r["event_id"]] is None else pytest.approx(want[r["event_id"]])), r


def test_lock_and_clock_in_any_order(spark, shuffled):
    folder, rows = shuffled
    one = {f: {r["event_id"]: r["outcome"] for r in folded(spark, folder, so.IdentityLock(30.0, 3600.0), "user_id long, event_id long, outcome string", "t-lock", "2 days", f).collect()} for f in (1, None)}
    assert one[1] == one[None] and len(one[1]) == len(rows)
    assert one[1][0] == "accepted" and set(one[1].values()) == {"accepted", "hand_not_detected", "hand_tracking_jump"}
    got = {r["event_id"]: (r["t"], r["source"]) for r in folded(spark, folder, so.FallbackClock(600.0, 3600.0), "user_id long, event_id long, t double, source string", "t-clock", "2 days", 1).collect()}
    last, n = {}, {}
    for k, t, u, e, v in rows:
        good = e != "error" and (u not in last or t > last[u])
        last[u] = t if good else last[u] + 600.0 if u in last else n.get(u, 0) * 600.0
        n[u] = n.get(u, 0) + 1
        assert got[k] == (last[u], "container" if good else "nominal_fallback")


def test_state_outlives_every_bucket_that_can_need_it():
    """State last seen at 1100 s may serve rows up to 1800 s, so it goes when the bucket of 1800 s has been folded, at 2400 s."""
    p = so.Motion(700.0, 600.0)
    assert [p._expiry(ms) for ms in (0, 499_999, 500_000, 1_099_999, 1_100_000)] == [1_200_000, 1_200_000, 1_800_000, 1_800_000, 2_400_000]


def test_backfill_rewrites_touched_days_only(spark, tmp_path):
    events = spark.createDataFrame([(1, 0, 1.0), (1, 0, 3.0), (1, 1, 5.0), (2, 0, 7.0)], "user_id long, day long, value double").withColumn("ts", F.timestamp_seconds(F.col("day") * 86400 + 60))
    table = str(tmp_path / "table")
    start = spark.createDataFrame([(1, 1, 1.0, True, 0, 0), (2, 1, 7.5, True, 0, 0), (1, 1, 5.5, True, 0, 1)], "user_id long, samples long, mean_value double, live boolean, late_rows long, day long")
    start.write.partitionBy("day").parquet(table)
    untouched = sorted(f.name for f in (tmp_path / "table" / "day=1").iterdir())
    late = so.late_rows(events, "1970-01-02T00:00:00.000Z").where("user_id = 1 and value = 3")
    so.backfill(spark, table, events, late)
    got = {(r["user_id"], r["day"]): (r["samples"], r["mean_value"], r["live"], r["late_rows"]) for r in spark.read.parquet(table).collect()}
    assert got == {(1, 0): (2, 2.0, False, 1), (2, 0): (1, 7.5, True, 0), (1, 1): (1, 5.5, True, 0)}
    assert untouched == sorted(f.name for f in (tmp_path / "table" / "day=1").iterdir())


class Memory:
    """State variables of one key, with a count of the calls to them."""

    def __init__(self):
        self.calls, self.timers, self.maps = 0, set(), []

    def getMapState(self, name, *_):
        self.maps.append(Variable(self, {}))
        return self.maps[-1]

    def getValueState(self, name, *_):
        return Variable(self, {})

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class Variable:
    def __init__(self, memory, d):
        self.memory, self.d = memory, d

    def _do(self, value=None):
        self.memory.calls += 1
        return value

    def exists(self): return self._do(0 in self.d)  # noqa: E704
    def get(self): return self._do(self.d[0])  # noqa: E704
    def update(self, v): self._do(self.d.__setitem__(0, v))  # noqa: E704
    def clear(self): self._do(self.d.clear())  # noqa: E704
    def getValue(self, k): return self._do(self.d.get(k))  # noqa: E704
    def updateValue(self, k, v): self._do(self.d.__setitem__(k, v))  # noqa: E704
    def removeKey(self, k): self._do(self.d.pop(k))  # noqa: E704


class At:
    def __init__(self, now): self.now = now  # noqa: E704
    def getExpiryTimeInMs(self): return self.now  # noqa: E704
    getCurrentWatermarkInMs = getExpiryTimeInMs


def drain(processor, memory, until):
    import pandas as pd
    out = []
    while due := sorted(x for x in memory.timers if x <= until):
        memory.timers.discard(due[0])
        now = At(due[0])
        now.getCurrentWatermarkInMs = lambda: until
        out += list(processor.handleExpiredTimer((1,), now, now))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"event_id": []})


@pytest.mark.parametrize("per_day, days", [(2, 60), (500, 3), (40, 10)])
def test_state_is_touched_by_key_and_not_by_bucket(per_day, days):
    import pandas as pd
    day, n = 86_400_000, per_day * days
    r = random.Random(7)
    at = sorted(r.randrange(days * day) for _ in range(n))
    pdf = pd.DataFrame({"at": at, "t": [v / 1000 for v in at], "event_id": range(n), "x": [r.random() for _ in at], "y": [1.0] * n, "valid": [r.random() > .2 for _ in at]})
    whole, _ = so.Motion(86400.0).fold(1, pdf, None)
    p, memory = so.Motion(86400.0), Memory()
    p.init(memory)
    shuffled = pdf.sample(frac=1, random_state=1)
    p.handleInputRows((1,), iter([shuffled.iloc[:n // 2], shuffled.iloc[n // 2:]]), None)
    half = drain(p, memory, days // 2 * day + 5)
    assert sorted(half["event_id"]) == [k for k in range(n) if at[k] < days // 2 * day]          # passed buckets come out, later ones wait
    rest = drain(p, memory, 10_000 * day)
    got = pd.concat([half, rest], ignore_index=True)
    assert list(got["event_id"]) == list(range(n))
    pd.testing.assert_series_equal(got["motion_per_hour"], whole["motion_per_hour"])
    assert not memory.maps[0].d
    if per_day == 2:
        assert memory.calls < 2 * days                    # a few calls an entry; bucket by bucket they were over 8 a day


def test_window_status_does_not_follow_the_order_of_rows(spark):
    """A spread equal to the mean went over it with some orders of addition; a spread around zero was not flagged."""
    import itertools
    rows, user = [], 0
    for p in itertools.islice(itertools.permutations([24.23] * 4 + [0.0] * 4), 0, 40320, 101):
        rows += [(user, 60 * k, v) for k, v in enumerate(p)]
        user += 1
    rows += [(-1, 0, 3.5), (-1, 60, -3.5), (-2, 0, 0.0)]
    e = spark.createDataFrame(rows, "user_id long, s long, value double").select("user_id", F.timestamp_seconds(F.lit(1704067200) + F.col("s")).alias("ts"), "value", F.lit(True).alias("valid"))
    out = so.window_quality(e, "1 day", "1 day", "1 hour").collect()
    assert {(r.status, r.mean_value) for r in out if r.user_id >= 0} == {("good", 12.115)}
    assert {(r.user_id, r.status, r.reasons) for r in out if r.user_id < 0} == {(-1, "uncertain", "illumination_variation"), (-2, "invalid", "flat_signal|illumination_variation")}
