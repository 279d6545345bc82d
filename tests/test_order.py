"""Ranks by ranges, and what is found without sorting a whole station, against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import inventory as I
from gaugeflow.operators import stats as S
from gaugeflow.operators.order import numbered
from gaugeflow.sources import states


def test_ranks_of_groups(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), i, rng.random()) for i in range(3000)]
    got = numbered(spark.createDataFrame(rows, "g string, i int, v double"), ["v", "i"], ["g"]).collect()
    for g in ("a", "b", "hot", None):
        own = sorted((r["v"], r["i"]) for r in got if r["g"] == g)
        assert [(r["v"], r["i"]) for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])] == own
        assert sorted(r["rank"] for r in got if r["g"] == g) == list(range(len(own)))
        assert {r["group_rows"] for r in got if r["g"] == g} == {len(own)}


def test_ranks_of_all(spark):
    got = numbered(spark.createDataFrame([(x,) for x in (3, 1, None, 2)], "v int"), ["v"]).collect()
    assert {(r["v"], r["rank"], r["group_rows"]) for r in got} == {(None, 0, 4), (1, 1, 4), (2, 2, 4), (3, 3, 4)}
    assert numbered(spark.createDataFrame([], "v int"), ["v"]).count() == 0


def points(seed, n=2500):
    """A station with most of all points, few others, repeated instants, and long gaps."""
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([rng.randint(0, 40 * 86_400), rng.randint(0, 300) * 3600, rng.randint(0, 3) * 10**8]), rng.choice([1.0, 2.0, rng.random(), None])) for _ in range(n)] + [("one", 5, 1.0)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "station_id string, s long, value double").select("station_id", F.timestamp_seconds("s").alias("ts"), "value").repartition(5)


def seconds(df, *cols):
    return df.withColumns({c: F.unix_seconds(c) for c in cols})


@pytest.mark.parametrize("seed", range(2))
def test_gaps_across_days(spark, seed):
    rows, now = points(seed), 38 * 86_400 * 100
    want = {}
    for s in {r[0] for r in rows}:
        times = sorted(t for x, t, _ in rows if x == s)
        gaps = [(b - a) / 3600 for a, b in zip(times, times[1:], strict=False) if (b - a) / 3600 > (9 if b < now - 365 * 86_400 else 1.5)]
        want[s] = (len(gaps), max(gaps, default=None))
    got = S.gap_counts(frame(spark, rows), str(dt.datetime.fromtimestamp(now, dt.UTC).replace(tzinfo=None)))
    near = lambda d: {s: (n, h and round(h, 6)) for s, (n, h) in d.items()}
    assert near({r["station_id"]: (r["gaps"], r["longest_h"]) for r in got.collect()}) == near(want)


@pytest.mark.parametrize("seed", range(2))
def test_columns_tile_the_points(spark, seed):
    rows, k = [r for r in points(seed) if r[2] is not None], 100
    got = {(r["station_id"], r["col"]): (r["lo"], r["hi"]) for r in S.downsample(frame(spark, rows), k).collect()}
    for s in {r[0] for r in rows}:
        own = [v for _, v in sorted((t, v) for x, t, v in rows if x == s)]
        for c in range(k):
            part = own[c * len(own) // k : (c + 1) * len(own) // k] if len(own) > k else [own[c * len(own) // k]]
            assert got[s, c] == (min(part), max(part)), (s, c)


def test_thinned_points_are_the_earliest(spark):
    rows, now = points(3), 45 * 86_400
    got = seconds(S.thin(frame(spark, rows), "1970-02-15 00:00:00"), "ts")
    want = {}
    for s, t, v in rows:
        tier = 0 if t >= now - 16 * 86_400 else 1
        key = (s, tier, t if tier == 0 else t // 3600)
        want[key] = min(want.get(key, (t, v)), (t, v), key=lambda p: (p[0], p[1] is not None, p[1] or 0))
    assert sorted(((r["station_id"], r["ts"], r["value"]) for r in got.collect()), key=str) == sorted(((k[0], *p) for k, p in want.items()), key=str)


def test_last_value_before_across_days(spark):
    live, history = points(4, 400), [r for r in points(5, 300) if r[0] is not None]
    got = seconds(I.nearest_before(frame(spark, live), frame(spark, history)), "ts").collect()
    want = []
    for s, t, v in live:
        near = [(u, w) for x, u, w in history if x == s and u <= t and w is not None]
        want.append((s, t, v, max(near)[1] if near else None))
    assert sorted(((r["station_id"], r["ts"], r["value"], r["base"]) for r in got), key=str) == sorted(want, key=str)


def test_scores_from_counts_kept_a_year_at_a_time(spark, tmp_path):
    rng = random.Random(6)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(900)]
    means = spark.createDataFrame([(s, d, float(rng.randint(0, 40))) for s in ("a", "b") for d in days if s == "a" or d.day < 2], "station_id string, day date, mean double")
    live = spark.createDataFrame([("a", 7.0, 1), ("a", -1.0, 2), ("a", 99.0, 3), ("a", None, 1), ("b", 1.0, 1), ("c", 1.0, 1)], "station_id string, value double, month int")
    clim, path = S.climatology(means, 2022), str(tmp_path / "counts")
    for year in (2020, 2021, 2022):
        states.commit(spark, path, {"": S.value_counts(means).where(F.col("year") == year)}, {"": "year"}, {"": ["station_id", "mean"]})
    assert states.current(spark, path)["tables"][""]["parts"] == {"2020": "version=00000001", "2021": "version=00000002", "2022": "version=00000003"}
    whole, kept = (sorted(map(tuple, df.collect())) for df in (S.score_unusual(live, means, clim), S.score_counts(live, states.read(spark, path), clim)))
    assert whole == kept
    own = [r["mean"] for r in means.where("station_id = 'a'").collect()]
    assert [(r[1], r[3], r[5]) for r in whole] == [(v, int(100 * sum(m <= v for m in own) / len(own) + 0.5), 3) for v in (-1.0, 7.0, 99.0)]
