"""Source mixing: apportionment against a queue of quotients, targets against a plain loop, and what a mix takes."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import mixing


def plain_targets(sizes, weights, repeats):
    """By the rule itself: cap who is above, share the rest anew until none is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        own = {s: left * w[s] / sum(w[r] for r in rest) for s in rest}
        above = [s for s in rest if own[s] >= repeats * sizes[s]]
        if not above or not total:
            return {**fixed, **own}
        fixed |= {s: repeats * sizes[s] for s in above}


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 7, 100, 5000, 40_000]) for i in range(12)} | {None: 50, "é": 3, "\U0001f600": 900, "Z": 10}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = plain_targets(sizes, (5, 2, 1), 3)
    assert {r["source"]: r["target"] for r in got} == pytest.approx(want)
    assert [r["source"] for r in sorted(got, key=lambda r: r["source_no"])] == sorted(sizes, key=lambda s: (s is None, s or ""))
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_targets_of_nothing(spark):
    assert mixing.targets(spark.createDataFrame([], "source string, source_size long")).count() == 0
    got = mixing.targets(spark.createDataFrame([("a", 0), (None, 0)], "source string, source_size long")).collect()
    assert {r["target"] for r in got} == {0.0}


def plain_seats(votes, seats):
    """Highest quotients by 1, 3, 5, ..., one at a time; ties to the lesser number."""
    got = [0] * len(votes)
    queue = [(-v, i) for i, v in enumerate(votes) if v > 0]
    heapq.heapify(queue)
    for _ in range(seats if queue else 0):
        _, i = heapq.heappop(queue)
        got[i] += 1
        heapq.heappush(queue, (-votes[i] / (2 * got[i] + 1), i))
    return got


def test_highest_quotients(spark):
    rng = random.Random(2)
    cases = [([rng.choice([rng.random() * 1000, rng.random(), 3.0]) for _ in range(rng.randint(1, 40))], rng.randint(0, 500)) for _ in range(25)] + [([1.0] * 30, 7), ([0.0, 0.0], 0), ([5.0], 9), ([1e-9, 1e9], 3)]
    rows = [(g, v, 1, seats, i) for g, (votes, seats) in enumerate(cases) for i, v in enumerate(votes)]
    got = {(r["g"], r["tie"]): (r["quota"], r["extra"]) for r in mixing.sainte_lague(spark.createDataFrame(rows, "g int, votes double, many int, seats int, tie int"), "g").collect()}
    for g, (votes, seats) in enumerate(cases):
        assert [got[g, i][0] for i in range(len(votes))] == plain_seats(votes, seats)
        assert not any(got[g, i][1] for i in range(len(votes)))


def test_equal_parties_are_one_row(spark):
    """Classes of equal parties: the same seats as each alone, with those of the torn class open."""
    votes = [4.0] * 50 + [7.0] * 20 + [1.0] * 3
    for seats in (0, 1, 33, 100, 1000):
        rows = [(0, 4.0, 50, seats, 1), (0, 7.0, 20, seats, 2), (0, 1.0, 3, seats, 3)]
        got = {r["tie"]: r for r in mixing.sainte_lague(spark.createDataFrame(rows, "g int, votes double, many int, seats int, tie int"), "g").collect()}
        assert sum(got[t]["quota"] * n + got[t]["extra"] for t, n in ((1, 50), (2, 20), (3, 3))) == seats
        plain = plain_seats(votes, seats)
        for t, part in ((1, plain[:50]), (2, plain[50:70]), (3, plain[70:])):
            assert sorted(part) == [got[t]["quota"]] * (len(part) - got[t]["extra"]) + [got[t]["quota"] + 1] * got[t]["extra"]


SCHEMA = "doc_id long, text string, source string, words int, target string, first int"


def some_docs(rng, n=600):
    text = lambda k: " \n".join(f"w{rng.randint(0, 99)}" for _ in range(k))
    rows = [(i, text(rng.choice([0, 1, 3, 50, 300])), rng.choice(["hot", "hot", "b", "c", "d", None]), 1, "x", 2) for i in range(n)]
    return rows + [(n, text(20_000), "b", 1, "x", 2), (None, "a b", "b", 0, "", 0), (n + 1, None, "d", 0, "", 0), (5, "a b c", "z", 0, "", 0), (5, "a b c", "z", 0, "", 0), (n + 2, " \t ", "none", 0, "", 0)]


def of(df):
    return df.select("doc_id", "source", "size", "source_size", "target", mixing.taken(F.col("pieces")).alias("taken"), "pieces")


def test_mix_meets_its_targets(spark):
    rows = some_docs(random.Random(3))
    got = of(mixing.mix(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == len(rows)
    assert sorted(r["size"] for r in got) == sorted(len((t or "").split()) for _, t, *_ in rows)
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = plain_targets(sizes, (5, 2, 1), 3)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {sizes[s]}
        assert own[0]["target"] == pytest.approx(want[s])
        assert abs(sum(r["taken"] for r in own) - want[s]) <= max(33, 0.003 * want[s])
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        ends = [0, *(x for p in r["pieces"] for x in (p["start"], p["end"])), r["size"]]
        assert ends == sorted(ends)
        assert all(1 <= p["times"] <= 3 for p in r["pieces"])


def test_reruns_agree_however_rows_lie(spark):
    rows = some_docs(random.Random(4), 200)
    runs = [sorted(map(str, of(mixing.mix(spark.createDataFrame(r, SCHEMA).repartition(n))).collect())) for r, n in ((rows, 1), (rows[::-1], 7))]
    assert runs[0] == runs[1]
    other = sorted(map(str, of(mixing.mix(spark.createDataFrame(rows, SCHEMA), seed=12)).collect()))
    assert other != runs[0]


def test_a_capped_source_comes_whole_thrice(spark):
    rows = [(i, "a b c d e", "a", 0, "", 0) for i in range(3)] + [(9, "w " * 2000, "b", 0, "", 0)]
    got = of(mixing.mix(spark.createDataFrame(rows, SCHEMA))).collect()
    assert {(r["taken"], r["target"]) for r in got if r["source"] == "a"} == {(15, 45.0)}


def test_empty_tables_and_drawn_texts(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r["taken"] for r in of(mixing.mix(spark.createDataFrame([(1, None, None, 0, "", 0), (2, "", "a", 0, "", 0)], SCHEMA))).collect()} == {0}
    df = spark.sql("SELECT 'a  b\tc d' AS text, array(named_struct('start', 0L, 'end', 1L, 'times', 2L), named_struct('start', 2L, 'end', 4L, 'times', 1L)) AS pieces")
    assert df.select(mixing.drawn(F.col("text"), F.col("pieces")).alias("t")).first()["t"] == ["a", "a", "c d"]
