"""The conversation trie against plain dictionaries, over one shard and many."""

import hashlib
import random
import re
import zlib

import pytest

from gaugeflow.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth string, shard int, h int"


def rebuilt(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def plain(rows):
    convs, nodes = rebuilt(rows), {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(path))
        up = min(nodes[path[:-1]]) if path else None
        out.append((min(members), len(path), up, len(members), sum(len(p) == len(path) + 1 for p in below), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def of(spark, rows, **sizes):
    convs = P.shared_openings(P.conversations_of(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)))
    return sorted((tuple(r) for r in P.trie(convs, **sizes).select(*P.OUT).collect()), key=str)


def dialogues(seed, n=150):
    """Few distinct turns, so many shared prefixes; a third of all are copies of one; one is long."""
    rng, rows = random.Random(seed), []
    for c in range(n):
        turns = [("user", "hello there"), ("bot", "same to you"), ("user", "bye")] if c % 3 == 0 else [(rng.choice(["user", "bot", None]), rng.choice(["a", "b c", "", None, "d\x1ce f"])) for _ in range(rng.randint(1, 6))]
        rows += [(c, t, *x) for t, x in enumerate(turns)]
    rows += [(n + 7, t, "user", f"t{t % 3}") for t in range(120)] + [(n + 27, t, "user", f"t{t % 3}") for t in range(90)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{}, {"turns_per_shard": 40}, {"turns_per_shard": 5, "most_shards": 64}])
def test_trie(spark, sizes):
    rows = dialogues(1)
    assert of(spark, rows, **sizes) == plain(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (40, None, "user", "null turn first"), (40, 1, "bot", "b"), (40, 1, "bot", "a"), (41, 0, None, None), (42, 3, "us", "er"), (43, 3, "use", "r"), (60, 0, "a", "b"), (60, 0, "a", "b"), (2_000_000_007, 0, "long", "w " * 30_000)]
    for sizes in ({}, {"turns_per_shard": 1}):
        assert of(spark, rows, **sizes) == plain(rows)


def test_turnless_conversations_and_none(spark):
    # 23 has h > 1 own turn and no conversation 20 to open with, so nothing is left of it.
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 1)
    rows = [(c, 0, "user", "gone"), (0, 0, "user", "stays")]
    assert of(spark, rows) == plain(rows)
    assert any(r[1] == 0 and r[7] == hashlib.sha256(str(c).encode()).hexdigest() for r in of(spark, rows))
    assert of(spark, []) == []


def test_copies_lie_in_many_shards(spark):
    """A path with most of all conversations is parted by their ids, and its digest is still that of all in order."""
    rows = [(c, t, "u", f"turn {t}") for c in range(20, 400) for t in range(3)]
    convs = P.conversations_of(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA))
    paths = convs.selectExpr("conv_id", "unhex(array_join(transform(turns, t -> t.h), '')) AS path", "transform(turns, t -> t.w) AS words").cache()
    cuts = P.splitters(paths, 8)
    assert len({p for p, _ in cuts}) == 1
    assert len(cuts) == 7
    parts = P.shard_nodes(paths, cuts, P.skeleton_of(cuts), chunk=10)
    assert parts.where("shard = -1 and seq = 0").count() == 8
    assert parts.where("shard >= 0").count() == 0
    assert of(spark, rows, turns_per_shard=100) == plain(rows)
