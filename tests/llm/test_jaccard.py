"""The n-gram Jaccard join against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import common
from gaugeflow.llm import jaccard as J

from .brute import components


def brute(rows, size, up, down):
    return sorted(components(rows, size, up, down), key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def corpus(seed, groups, copies, edits):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice((1, 2, 3, 20, 60, 120)))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), rng.choice(" \n\t").join(own).upper() if rng.random() < 0.2 else " ".join(own)))
    return rows + [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, " \n"), (len(rows) + 3, rows[0][1]), (5, rows[5][1]), (None, rows[7][1])]


@pytest.mark.parametrize(("size", "up", "copies", "edits"), [(3, 90, 6, 3), (5, 80, 6, 3)])
def test_against_all_pairs(docs, size, up, copies, edits):
    rows = corpus(size, 12, copies, edits)
    assert got(J.jaccard_components(docs(*rows), size, up, 100)) == brute(rows, size, up, 100)


def test_big_group_with_salted_buckets(docs, monkeypatch):
    rows = corpus(9, 2, 60, 2)
    whole = J._prefixes
    monkeypatch.setattr(J, "_prefixes", lambda *a: whole(*a, split_from=16, split_into=4))
    assert got(J.jaccard_components(docs(*rows), 3, 90, 100)) == brute(rows, 3, 90, 100)


def test_hot_tokens_with_one_class_in_a_salt(spark, monkeypatch):
    base = " ".join(f"w{i}" for i in range(60))
    salt = lambda t: J.class_of(J.shingles(t, 3)) % 2
    pair = [next(t for t in (f"{base} v{i}" for i in range(100)) if salt(t) == k) for k in (0, 1)]
    rows = [(i, pair[i % 2]) for i in range(40)]
    whole = J._prefixes
    monkeypatch.setattr(J, "_prefixes", lambda *a: whole(*a, split_from=16, split_into=2))
    # A copy of both in each of 20 tasks: all shingles are hot, and each salt has one class.
    table = spark.createDataFrame(spark.sparkContext.parallelize(rows, 20), "doc_id long, text string")
    assert got(J.jaccard_components(table, 3, 90, 100)) == brute(rows, 3, 90, 100)


def test_hot_groups_are_dealt_out(docs, monkeypatch):
    rows = corpus(11, 3, 40, 2) + [(9000 + i, "one and the same text of them all") for i in range(30)]
    whole, seen = common.hot_keys, []

    def hot(df, key, **_):
        found = whole(df, key, least=3)
        seen.append((key, found is not None))
        return found

    monkeypatch.setattr(J, "hot_keys", hot)
    assert got(J.jaccard_components(docs(*rows), 3, 90, 100)) == brute(rows, 3, 90, 100)
    assert {k for k, there in seen if there} >= {"root", "class", "token"}


def test_join_hot_is_a_join(spark):
    rows = spark.createDataFrame([(i % 3 if i % 7 else None, i) for i in range(60)], "k int, i int")
    other = spark.createDataFrame([(0, "a"), (1, "b"), (5, "c")], "k int, v string")
    hot = common.hot_keys(rows, "k", least=3)
    assert sorted(r[0] for r in hot.collect()) == [0, 1, 2] and common.hot_keys(rows, "k") is None
    for how in ("left", "inner"):
        want = sorted(map(str, rows.join(other, "k", how).select("k", "i", "v").collect()))
        for h in (hot, None):
            assert sorted(map(str, common.join_hot(rows, other, "k", F.col("i"), h, how).select("k", "i", "v").collect())) == want


def test_empty_table(docs, spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one(docs):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(4, text), (2, text + " more"), (2, text + " more"), (9, None), (9, None), (7, "alone it stands here now")]
    kept = J.keep_one(docs(*rows))
    assert kept.columns == ["doc_id", "text", "token", "n"]
    assert sorted((r["doc_id"] for r in kept.collect())) == [2, 7, 9, 9]
    odd = docs((None, text), (3, text), (None, "only nulls have these words"), (None, "only nulls have these words")).withColumnsRenamed({"token": "__class", "n": "__id"})
    kept = J.keep_one(odd)
    assert kept.columns == ["doc_id", "text", "__class", "__id"] and sorted((str(r["doc_id"]), r["__class"]) for r in kept.collect()) == [("3", "x"), ("None", "x")]
    assert J.keep_one(odd.limit(0)).count() == 0


def test_suffix_filter_keeps_what_links():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(rng.integers(0, 400, 80).astype("u8"))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 400, 8).astype("u8")]))
        differ = len(a) + len(b) - 2 * len(np.intersect1d(a, b))
        assert not J.suffix_reject(a, b, differ)


def test_hub_of_many_near_copies(docs):
    """A hub with so many pairs that they are dealt out to many tasks."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:-1], f"x{i}"])) for i in range(1300)] + [(5000, "quite another text of its own")]
    found = J.jaccard_components(docs(*rows)).select("doc_id", "component_id")
    assert sorted(map(tuple, found.collect())) == [(i, 0) for i in range(1300)] + [(5000, 5000)]
