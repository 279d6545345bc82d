"""Nearest history value on either side, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import inventory as I

from .test_operators import frame, one

SCHEMA = "station_id string, ts timestamp, value double"


def plain(live, history, tolerance):
    out = []
    for s, t, v in live:
        near = [(abs(t - u), -u, w) for x, u, w in history if x == s and t is not None and u is not None and w is not None and abs(t - u) <= tolerance]
        off, u, w = min(near, default=(None, None, None))
        out.append((s, t, v, w, None if u is None else -u))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_nearest_within(spark, seed):
    """A hot station, ties before and after, repeated instants, nulls, and points on the borders of spans."""
    rng = random.Random(seed)
    make = lambda n: [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([rng.randint(0, 400) * 900, rng.randint(0, 30) * 7200, None]), rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(n)]
    live, history = make(300), make(200)
    df = lambda rows: frame(spark, "station_id string, s long, value double", *rows).select("station_id", F.timestamp_seconds("s").alias("ts"), "value")
    got = I.nearest_within(df(live), df(history), 2)
    back = [(r["station_id"], r["t"], r["value"], r["base"], r["b"]) for r in got.select("*", F.unix_seconds("ts").alias("t"), F.unix_seconds("base_ts").alias("b")).collect()]
    want = plain(live, [h for h in history if h[0] is not None], 7200)
    assert sorted((x for x in back if x[0] is not None), key=str) == [x for x in want if x[0] is not None]
    assert len(back) == len(live)


def test_nearest_of_nothing(spark):
    live = frame(spark, SCHEMA).unionByName(frame(spark, "station_id string, ts string, value double", ("s", "2024-01-01", 1.0)).withColumn("ts", F.to_timestamp("ts")))
    assert one(I.nearest_within(live, frame(spark, SCHEMA), 2), "station_id", "base") == [("s", None)]
    assert I.nearest_within(frame(spark, SCHEMA), live, 2).count() == 0
