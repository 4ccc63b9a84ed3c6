"""Feature reconstruction: the reference fixture, edges of the checks, and
the point-in-time operator against a brute-force loop."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import types as T

from helpers import OBS_TS, metrics_df, metrics_rows, obs_df
from tidemark.operators.features import reconstruct
from tidemark.operators.pit import AsOf, Rolling, point_in_time
from tidemark.schemas import FEATURE_ORDER, HOUR_US, MINUTE_US


def test_reference_fixture_values(spark):
    m = metrics_df(spark, metrics_rows())
    o = obs_df(spark, [("station_1", OBS_TS), ("station_2", OBS_TS), ("station_9", OBS_TS)])
    rows = {r["station_id"]: r.asDict() for r in reconstruct(o, m).collect()}
    s1, s2 = rows["station_1"], rows["station_2"]
    assert s1["outcome"] == "ok" and s2["outcome"] == "ok"
    assert rows["station_9"]["outcome"] == "not_found"
    assert s1["snapshot_source_ts"] == OBS_TS
    for name in ["ft_bikes_available", "ft_bikes_available_lag_15m", "ft_bikes_available_lag_30m",
                 "ft_bikes_available_lag_60m", "ft_bikes_available_lag_24h", "ft_avg_bikes_60m",
                 "ft_min_bikes_60m", "ft_max_bikes_60m", "ft_avg_bikes_24h", "ft_min_bikes_24h",
                 "ft_max_bikes_24h"]:
        assert s1[name] == 10.0 and s2[name] == 5.0, name
    assert s1["ft_docks_available"] == 10.0 and s2["ft_docks_available"] == 15.0
    assert s1["ft_availability_ratio"] == 0.5 and s2["ft_avg_ratio_60m"] == 0.25
    assert s1["ft_low_avail_freq_24h"] == 0.0
    # 2025-06-01 is a Sunday: day 0, weekend.
    assert (s1["ft_hour_of_day"], s1["ft_day_of_week"], s1["ft_is_weekend"]) == (12, 0, 1)
    assert s1["ft_capacity"] == 20.0
    assert s2["ft_pct_bikes_of_capacity"] == 0.25 and s2["ft_pct_docks_of_capacity"] == 0.75
    assert s1["ft_bikes_delta_60m"] == 0.0


def test_column_order_is_the_contract(spark):
    m = metrics_df(spark, metrics_rows(minutes=10))
    o = obs_df(spark, [("station_1", OBS_TS)])
    cols = reconstruct(o, m).columns
    assert cols == ["station_id", "obs_ts", "snapshot_source_ts", *FEATURE_ORDER, "outcome"]


def test_staleness_edge_and_domain(spark):
    base = datetime(2025, 6, 1, 11, 0)
    rows = [("a", base, base, 8.0, 12.0, 20.0, 0.4, 0, 1, base),
            ("low", base, base, 1.0, 3.0, 4.0, 0.25, 0, 1, base),
            ("five", base, base, 1.0, 4.0, 5.0, 0.2, 0, 1, base),
            ("nullcap", base, base, None, None, None, None, 0, 1, base)]
    m = metrics_df(spark, rows)
    o = obs_df(spark, [("a", base + timedelta(minutes=15)),          # exactly 15 min: passes
                       ("a", base + timedelta(minutes=15, microseconds=1)),  # stale
                       ("a", base - timedelta(microseconds=1)),       # nothing at or before
                       ("low", base), ("five", base), ("nullcap", base)])
    got = {(r["station_id"], r["obs_ts"]): r["outcome"] for r in reconstruct(o, m).collect()}
    assert got[("a", base + timedelta(minutes=15))] == "ok"
    assert got[("a", base + timedelta(minutes=15, microseconds=1))] == "stale"
    assert got[("a", base - timedelta(microseconds=1))] == "not_found"
    assert got[("low", base)] == "domain_violation"
    assert got[("five", base)] == "ok"      # exactly 5.0 passes
    assert got[("nullcap", base)] == "ok"   # NULL capacity is not out of domain; NULL row still wins


def test_duplicate_obs_points_keep_their_payload(spark):
    m = metrics_df(spark, metrics_rows(minutes=30))
    schema = T.StructType([T.StructField("request_id", T.LongType()),
                           T.StructField("station_id", T.StringType()),
                           T.StructField("obs_ts", T.TimestampNTZType())])
    o = spark.createDataFrame([(1, "station_1", OBS_TS), (2, "station_1", OBS_TS), (3, None, OBS_TS)], schema)
    got = sorted((r["request_id"], r["outcome"]) for r in reconstruct(o, m).collect())
    assert got == [(1, "ok"), (2, "ok"), (3, "not_found")]


def _brute(left, right, asof, rolling):
    out = {}
    for lid, key, t in left:
        res = {}
        cand = [r for r in right if r[0] == key]
        for a in asof:
            ok = [r for r in cand if r[1] <= t - a.lag_us]
            res[a.name] = max(ok, key=lambda r: (r[1], r[2], r[3])) if ok else None
        for ro in rolling:
            vals = [r[3] for r in cand if t - ro.width_us <= r[1] <= t and r[3] is not None]
            if ro.fn == "avg":
                res[ro.name] = sum(vals) / len(vals) if vals else None
            elif ro.fn == "min":
                res[ro.name] = min(vals) if vals else None
            elif ro.fn == "max":
                res[ro.name] = max(vals) if vals else None
            elif ro.fn == "count":
                res[ro.name] = len(vals)
            else:
                res[ro.name] = sum(vals) if vals else None
        out[lid] = res
    return out


@pytest.mark.parametrize("seed,rows_per_slice,max_bc", [
    (1, 1_000_000, 1_000_000),  # no hot bucket: no slice table
    (2, 3, 1_000_000),          # hot buckets, broadcast slice table
    (3, 1, 1_000_000),          # every bucket with two rows is hot
    (4, 2, 0),                  # hot buckets, shuffle-joined slice table
])
def test_point_in_time_matches_brute_force(spark, seed, rows_per_slice, max_bc):
    rnd = random.Random(seed)
    epoch = datetime(1970, 1, 1)
    t0 = int((datetime(2024, 1, 1) - epoch).total_seconds() * 1e6)
    span = 6 * 24 * HOUR_US
    right = []
    for key in ["k0", "k1", "k2"]:
        for _ in range(rnd.randint(5, 60)):
            t = t0 + rnd.randrange(span)
            if key == "k2" and t < t0 + 3 * 24 * HOUR_US:
                continue  # a gap longer than two day buckets
            right.append((key, t, rnd.randint(0, 3), rnd.choice([None, round(rnd.uniform(0, 50), 2)])))
    # exact ties on time
    right += [(r[0], r[1], r[2] + 1, 7.5) for r in right[:5]]
    left = [(i, rnd.choice(["k0", "k1", "k2", "k3"]), t0 + rnd.randrange(span + 2 * 24 * HOUR_US))
            for i in range(150)]
    left += [(1000 + i, r[0], r[1]) for i, r in enumerate(right[:10])]  # on a right time

    to_ts = lambda us: epoch + timedelta(microseconds=us)
    L = spark.createDataFrame([(i, k, to_ts(t)) for i, k, t in left],
                              "lid long, key string, t timestamp_ntz")
    R = spark.createDataFrame([(k, to_ts(t), e, v) for k, t, e, v in right],
                              "key string, rt timestamp_ntz, tb int, v double")
    asof = [AsOf("snap", ("rt", "tb", "v"), 0), AsOf("lag90", ("rt", "tb", "v"), 90 * MINUTE_US),
            AsOf("lag24", ("rt", "tb", "v"), 24 * HOUR_US)]
    rolling = [Rolling("avg60", "avg", "v", 60 * MINUTE_US), Rolling("min24", "min", "v", 24 * HOUR_US),
               Rolling("max24", "max", "v", 24 * HOUR_US), Rolling("sum3h", "sum", "v", 3 * HOUR_US),
               Rolling("avg24", "avg", "v", 24 * HOUR_US), Rolling("sum24", "sum", "v", 24 * HOUR_US),
               Rolling("cnt24", "count", "v", 24 * HOUR_US)]
    got = point_in_time(L, R, key="key", left_time="t", right_time="rt", asof=asof, rolling=rolling,
                        tiebreak=("tb",), rows_per_slice=rows_per_slice,
                        max_broadcast_buckets=max_bc).collect()
    want = _brute(left, right, asof, rolling)
    assert len(got) == len(left)
    for row in got:
        w = want[row["lid"]]
        for a in asof:
            exp = w[a.name]
            s = row[a.name]
            if exp is None:
                assert s is None, (row["lid"], a.name)
            else:
                assert s is not None and s["rt"] == to_ts(exp[1]) and s["tb"] == exp[2] and s["v"] == exp[3], \
                    (row["lid"], a.name, s, exp)
        for ro in rolling:
            exp, val = w[ro.name], row[ro.name]
            if exp is None:
                assert val is None, (row["lid"], ro.name, val)
            else:
                assert val == pytest.approx(exp, rel=1e-12, abs=1e-9), (row["lid"], ro.name)


def test_as_of_on_window_end_is_stricter(spark):
    """Keyed on window_start (default) the minute still open at obs_ts is used;
    keyed on window_end only finished minutes are."""
    m = metrics_df(spark, metrics_rows(stations=(("s", 10.0),), minutes=3))
    o = obs_df(spark, [("s", OBS_TS)])
    start = reconstruct(o, m).collect()[0]
    end = reconstruct(o, m, as_of_column="window_end").collect()[0]
    assert start["snapshot_source_ts"] == OBS_TS
    assert end["snapshot_source_ts"] == OBS_TS - timedelta(minutes=1)


def test_left_payload_of_any_type_is_carried(spark):
    m = metrics_df(spark, metrics_rows(stations=(("s", 10.0),), minutes=5))
    o = spark.createDataFrame([("s", OBS_TS, {"a": 1}, [1, 2])],
                              "station_id string, obs_ts timestamp_ntz, tags map<string,int>, ids array<int>")
    r = reconstruct(o, m).collect()[0]
    assert r["tags"] == {"a": 1} and r["ids"] == [1, 2] and r["outcome"] == "ok"


def test_salted_slices_equal_plain_plan_on_the_given_tables(spark):
    """Every bucket hot (tiny rows_per_slice) gives the same features as the
    unsalted plan, on the shared sf0.01 tables."""
    from tidemark.plans.common import Inputs
    i = Inputs(spark, "/root/testdata/sf0.01")
    plain = reconstruct(i.obs, i.metrics)
    salted = reconstruct(i.obs, i.metrics, rows_per_slice=5)
    assert plain.count() == salted.count()
    assert plain.exceptAll(salted).count() == 0 and salted.exceptAll(plain).count() == 0


def test_frames_of_many_panes_equal_brute_force(spark):
    """Widths of 2, 7 and 14 panes of five minutes: every function, gaps, equal times, NULL values, exact edges."""
    minute = 60_000_000
    rng = random.Random(12)
    t0 = datetime(2025, 1, 1)
    right = [(rng.choice("ab"), t0 + timedelta(seconds=rng.choice([30, 60]) * rng.randint(0, 700)), rng.choice([None, float(rng.randint(-9, 9))]))
             for _ in range(260)]
    right += [("c", t0 + timedelta(minutes=5 * k), float(k)) for k in (0, 1, 14, 15, 28, 60)]
    left = [(k, t0 + timedelta(seconds=s)) for k in "abcd" for s in [*(rng.randint(-600, 30_000) for _ in range(60)), 0, 300, 4200, 4201, 8400]]
    widths = {"10": 10, "35": 35, "70": 70}
    rolling = [Rolling(f"{fn}_{name}", fn, "v", w * minute) for name, w in widths.items() for fn in ("avg", "min", "max", "sum", "count")]
    out = point_in_time(spark.createDataFrame(left, "k string, t timestamp_ntz"), spark.createDataFrame(right, "k string, at timestamp_ntz, v double"),
                        key="k", left_time="t", right_time="at", rolling=rolling, bucket_us=70 * minute)
    for r in out.collect():
        for name, w in widths.items():
            vs = [v for k, at, v in right if k == r["k"] and r["t"] - timedelta(minutes=w) <= at <= r["t"] and v is not None]
            assert r[f"count_{name}"] == len(vs)
            want = (sum(vs) / len(vs), min(vs), max(vs), sum(vs)) if vs else (None,) * 4
            assert all(g == x or abs(g - x) < 1e-9 for g, x in zip((r[f"{f}_{name}"] for f in ("avg", "min", "max", "sum")), want)), (r, name, want)


def test_plan_has_growing_frames_alone_and_runs_nothing_early(spark):
    m = metrics_df(spark, metrics_rows(minutes=90))
    o = obs_df(spark, [("station_1", OBS_TS)])
    spark.sparkContext.setJobGroup("features", "")
    plan = reconstruct(o, m)._jdf.queryExecution().optimizedPlan().toString()
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("features")) == []
    spark.sparkContext.setJobGroup("after", "")
    frames = plan.split("specifiedwindowframe(")[1:]
    assert frames and all(f.startswith("RangeFrame, unboundedpreceding$()") for f in frames)
