"""Prefix trie of conversations by the splitter skeleton.

A conversation's path is its turns' digests, 16 bytes each, one after the
other, so that paths in byte order keep every node's members together.
Splitters, drawn from a sample, cut the order of (path, conversation) into
shards. A node whose members a splitter parts is a prefix of that splitter's
path; all such prefixes, the skeleton, are sent to all tasks. A shard in order
finishes every other node in one run with a stack, and gives partial sums for
the skeleton's, which are then reduced.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need, written
from .mixing import words_of

WIDTH = 16
NODES = "shard int, seq long, parent_shard int, parent_seq long, conv_id long, depth int, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends_sha256 string, ids string, place long"
OUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversations_of(turns: DataFrame) -> DataFrame:
    """``conv_id, turns`` (array of ``h``, the digest of role and text in hex,
    and ``w``, the words of the text) of rows (``conv_id, turn, role, text``),
    by turn, null first, equal ones by digest. Only digests and counts are
    shuffled. Null roles and texts are empty; rows without ``conv_id`` drop."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = need(turns, "conv_id", "turn", "role", "text").where("conv_id is not null")
    one = F.struct("turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("h"), words_of(text).alias("w"))
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return own.select("conv_id", F.transform("ts", lambda t: F.struct(t["h"].alias("h"), t["w"].alias("w"))).alias("turns"))


def shared_openings(convs: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """Conversations rebuilt: c begins with the first h turns of conversation
    c - c % ``every`` (fewer if it has fewer, none if there is none), h being
    crc32(c in decimal) % (``most`` + 1), and goes on with its own after its
    first h."""
    heads = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    rows = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h).join(heads, "base", "left")
    opening = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.lit(0), F.size("turns") - F.col("h")))
    return rows.select("conv_id", F.concat(opening, rest).alias("turns"))


def _path(turns: Column) -> Column:
    return F.unhex(F.array_join(F.transform(turns, lambda t: t["h"]), ""))


def splitters(paths: DataFrame, shards: int, per_shard: int = 16) -> list[tuple[bytes, int]]:
    """At most ``shards`` - 1 pairs (path, conv_id) in order that part the turns
    of ``paths`` into about equal shares, by a sample of some ``per_shard``
    conversations a shard, drawn by the hash of their id."""
    every = max(1, paths.count() // (shards * per_shard))
    drawn = paths.where(F.pmod(F.xxhash64("conv_id"), F.lit(every)) == 0).select("path", "conv_id").collect()
    sample = sorted((bytes(r["path"]), r["conv_id"]) for r in drawn)
    weights, total, out = [len(p) // WIDTH + 1 for p, _ in sample], 0, []
    step = sum(weights) / shards
    for pair, w in zip(sample, weights, strict=True):
        total += w
        if total >= step * (len(out) + 1) and len(out) < shards - 1:
            out.append(pair)
    return out


def skeleton_of(cuts: list[tuple[bytes, int]]) -> dict[bytes, int]:
    """Every prefix of the splitters' paths, the root among them, numbered in order of depth."""
    found = {p[: k * WIDTH] for p, _ in cuts for k in range(len(p) // WIDTH + 1)} | {b""}
    return {p: i for i, p in enumerate(sorted(found, key=lambda p: (len(p), p)))}


class _Node:
    __slots__ = ("children", "ends", "first", "held", "ids", "leaves", "n", "place", "saved", "seq", "skeleton", "words")

    def __init__(self, seq: int, skeleton: int, words: int):
        self.seq, self.skeleton, self.words = seq, skeleton, words
        self.n = self.children = self.leaves = self.saved = self.place = 0
        self.first: int | None = None
        self.ends, self.ids, self.held = None, [], False


class _Shard:
    """One run over a shard's conversations in order; ``rows`` gathers what is finished."""

    def __init__(self, shard: int, skeleton: dict[bytes, int], chunk: int):
        self.shard, self.skeleton, self.chunk = shard, skeleton, chunk
        self.rows: list[tuple] = []
        self.path, self.seq = b"", 0
        self.stack = [_Node(0, 0, 0)]

    def add(self, path: bytes, conv: int, words) -> None:
        depth, same, most = len(path) // WIDTH, 0, min(len(path), len(self.path)) // WIDTH
        while same < most and path[same * WIDTH : (same + 1) * WIDTH] == self.path[same * WIDTH : (same + 1) * WIDTH]:
            same += 1
        self.close(same)
        for k in range(same, depth):
            self.seq += 1
            # Below a node that isn't in the skeleton nothing is.
            at = self.skeleton.get(path[: (k + 1) * WIDTH], -1) if self.stack[-1].skeleton >= 0 else -1
            self.stack.append(_Node(self.seq, at, int(words[k])))
        self.path, node = path, self.stack[-1]
        node.n += 1
        node.first = conv if node.first is None else min(node.first, conv)
        if node.skeleton >= 0:
            node.ids.append(str(conv))
            if len(node.ids) >= self.chunk:
                self.flush(node)
        else:
            if node.ends is None:
                node.ends = hashlib.sha256()
            else:
                node.ends.update(b",")
            node.ends.update(str(conv).encode())

    def flush(self, node: _Node) -> None:
        """Ids of conversations that end at a node of the skeleton, in order."""
        if node.ids:
            self.rows.append((-2, node.skeleton, self.shard, -1, None, None, None, None, None, None, None, None, ",".join(node.ids), node.place))
            node.place, node.ids = node.place + 1, []

    def close(self, depth: int) -> None:
        """Finish all nodes deeper than ``depth``."""
        while len(self.stack) - 1 > depth:
            at, node = len(self.stack) - 1, self.stack.pop()
            up = self.stack[-1]
            up.n += node.n
            up.first = node.first if up.first is None else min(up.first, node.first)
            if node.skeleton >= 0:
                self.part(node, at)
                continue
            leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.words
            up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
            ends = (node.ends or hashlib.sha256()).hexdigest()
            parent = (-1, up.skeleton) if up.skeleton >= 0 else (self.shard, up.seq)
            self.rows.append((self.shard, node.seq, *parent, node.first, at, node.n, node.children, leaves, saved, node.words, ends, None, None))

    def part(self, node: _Node, depth: int) -> None:
        """A skeleton node's sums in this shard; its skeleton children aren't in them, but for members."""
        self.flush(node)
        self.rows.append((-1, node.skeleton, None, None, node.first, depth, node.n, node.children, node.leaves, node.saved, node.words, None, None, None))

    def end(self) -> None:
        self.close(0)
        if self.stack[0].n:
            self.part(self.stack[0], 0)


def shard_nodes(paths: DataFrame, cuts: list[tuple[bytes, int]], skeleton: dict[bytes, int], chunk: int = 1000) -> DataFrame:
    """Rows of all shards: finished nodes, parts of the skeleton's (shard -1),
    and ids that end at those (shard -2). A task holds one path's nodes and a
    batch of rows, whatever its shard's size."""
    spark = paths.sparkSession
    sent = spark.sparkContext.broadcast((cuts, skeleton))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = zip(pdf["path"], pdf["conv_id"], strict=True)
            yield pdf.assign(shard=pd.Series([bisect.bisect_left(sent.value[0], (bytes(p), c)) for p, c in pairs], dtype="int32"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: _Shard | None = None
        names = [c.split()[0] for c in NODES.split(", ")]

        def out(rows: list) -> pd.DataFrame:
            frame = pd.DataFrame(rows, columns=names, dtype=object)
            rows.clear()
            return frame

        for pdf in batches:
            for shard, path, conv, words in zip(pdf["shard"], pdf["path"], pdf["conv_id"], pdf["words"], strict=True):
                if at is None or at.shard != shard:
                    if at is not None:
                        at.end()
                        yield out(at.rows)
                    at = _Shard(int(shard), sent.value[1], chunk)
                at.add(bytes(path), int(conv), words)
                if len(at.rows) > 10_000:
                    yield out(at.rows)
        if at is not None:
            at.end()
            yield out(at.rows)

    dealt = paths.mapInPandas(deal, "conv_id long, path binary, words array<long>, shard int")
    laid = dealt.repartitionByRange(len(cuts) + 1, "shard").sortWithinPartitions("shard", "path", "conv_id")
    return laid.mapInPandas(run, NODES)


def _digests(ids: DataFrame) -> DataFrame:
    """``seq, ends_sha256`` of runs of ids: a node's runs in order, through one running digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq, digest = None, None
        for pdf in batches:
            done = []
            for s, text in zip(pdf["seq"], pdf["ids"], strict=True):
                if s != seq:
                    if digest is not None:
                        done.append((seq, digest.hexdigest()))
                    seq, digest = s, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.encode())
            yield pd.DataFrame(done, columns=["seq", "ends_sha256"])
        if digest is not None:
            yield pd.DataFrame([(seq, digest.hexdigest())], columns=["seq", "ends_sha256"])

    # Ids of a node come by shard and then by place: (path, conv_id) in order.
    rows = ids.select("seq", "parent_shard", "place", "ids").repartition("seq").sortWithinPartitions("seq", "parent_shard", "place")
    return rows.mapInPandas(run, "seq long, ends_sha256 string")


def _reduced(parts: DataFrame, skeleton: dict[bytes, int]) -> DataFrame:
    """The skeleton's nodes from their parts: sums over shards, and from the deepest up what their skeleton children have."""
    spark, paths = parts.sparkSession, list(skeleton)
    sums = parts.groupBy("seq").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("words").alias("words"))
    # At most one row a prefix of a splitter.
    by = {r["seq"]: r.asDict() for r in sums.collect()}
    for k in sorted(by, reverse=True):
        node, up = by[k], by.get(skeleton[paths[k][:-WIDTH]]) if k else None
        node["n_leaves"] = node["n_leaves"] or 1
        node["saved_tokens"] += (node["n_convs"] - 1) * node["words"]
        node["parent_conv_id"] = up["conv_id"] if up else None
        if up:
            up["n_children"] += 1
            up["n_leaves"] += node["n_leaves"]
            up["saved_tokens"] += node["saved_tokens"]
    names = ("seq", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    rows = [(*(n[c] for c in names), len(paths[k]) // WIDTH) for k, n in by.items()]
    return spark.createDataFrame(rows, ", ".join(f"{c} long" for c in (*names, "depth")))


def trie(convs: DataFrame, turns_per_shard: int = 2000, most_shards: int = 512) -> DataFrame:
    """One row a node of the trie of ``convs`` (``conv_id, turns`` as of
    ``conversations_of``; ids are unique): ``conv_id`` (least member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (over the subtree, (members - 1) times the words of the
    last turn) and ``ends_sha256`` of the ids that end there.

    A shard has about ``turns_per_shard`` turns, more where ``most_shards``
    shards aren't enough; so the skeleton has at most ``most_shards`` times the
    longest splitter's turns. Equal paths are parted by their ids, so a path
    of any number of copies lies in as many shards as it fills. A conversation
    is a row (24 bytes a turn), which must fit a task.

    A conversation without turns ends at the root. An empty table gives none.
    """
    words = F.transform("turns", lambda t: t["w"])
    paths = written(convs.select("conv_id", _path(F.col("turns")).alias("path"), words.alias("words")), "paths")
    n = paths.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    cuts = splitters(paths, max(1, min(most_shards, -(-n // turns_per_shard))))
    skeleton = skeleton_of(cuts)
    nodes = written(shard_nodes(paths, cuts, skeleton), "trie")
    top = written(_reduced(nodes.where("shard = -1"), skeleton), "skeleton")
    own = nodes.where("shard >= 0")
    # The skeleton's size is bounded by the splitters'; other parents lie in their children's shard.
    under_top = own.where("parent_shard = -1").join(F.broadcast(top.select(F.col("seq").alias("parent_seq"), F.col("conv_id").alias("parent_conv_id"))), "parent_seq")
    parents = own.where("n_children > 0").select(F.col("shard").alias("parent_shard"), F.col("seq").alias("parent_seq"), F.col("conv_id").alias("parent_conv_id"))
    inner = own.where("parent_shard >= 0").join(parents, ["parent_shard", "parent_seq"])
    ends = _digests(nodes.where("shard = -2"))
    nothing = F.lit(hashlib.sha256().hexdigest())
    upper = top.join(ends, "seq", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
    cols = [F.col("depth").cast("long").alias("depth") if c == "depth" else F.col(c) for c in OUT]
    return under_top.select(cols).unionByName(inner.select(cols)).unionByName(upper.select(cols))
