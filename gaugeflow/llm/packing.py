"""Best-fit packing by exact-complement hashing.

Only the histogram of piece lengths (one count a length, so at most
``capacity`` numbers, whatever the input) decides how sequences are filled:

1. exact complements: for each length, longest first, the single, pair and
   triple sums that fill its gap to the last token are looked up in an index of
   sums, and each makes as many sequences as the counts allow;
2. best fit: what is left goes, longest first, into the smallest gap that
   still holds it, many equal sequences at a time.

Exact fills of the longest pieces can use up short ones that the middle lengths
need. So plans are made with combinations of up to three, two, one and no
lengths, and the one with the fewest sequences is used, the first of those
that tie: never one with more than plain best fit, which is the last.

The plan says which rank within its length goes to which sequence and offset;
its size depends on ``capacity`` alone, so it is sent to all tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import need, tidy, written
from .encoding import encode


class Sums:
    """Which one, two or three lengths make a sum, under counts that only fall.

    ``pairs[s]`` is the number of pairs of lengths still available that sum to
    ``s``: the hash from sum to pairs, kept as counts since a pair's members
    follow from the sum and one of them. A triple is a length and a pair of
    what it leaves, so its index is the pairs' at ``s`` less that length.
    """

    def __init__(self, count: np.ndarray):
        self.count, self.live = count, count > 0
        lengths = np.flatnonzero(self.live)
        self.pairs = np.zeros(2 * len(count), np.int64)
        for x in lengths:
            np.add.at(self.pairs, x + lengths[lengths >= x], 1)

    def take(self, lengths: list[int], times: int) -> None:
        for x in lengths:
            self.count[x] -= times
        for x in set(lengths):
            if not self.count[x]:
                self.pairs[x + np.flatnonzero(self.live)] -= 1
                self.live[x] = False

    def times(self, lengths: list[int]) -> int:
        """How often the counts allow this combination."""
        return min(int(self.count[x]) // lengths.count(x) for x in set(lengths))

    def two(self, total: int, under: int) -> Iterator[list[int]]:
        """Pairs that sum to ``total``, members at most ``under``, larger first."""
        if self.pairs[total]:
            larger = np.arange((total + 1) // 2, min(total, under + 1))
            for a in larger[self.live[larger] & self.live[total - larger]][::-1].tolist():
                yield [a, total - a]

    def of(self, total: int, most: int = 3) -> Iterator[list[int]]:
        """All combinations of one to ``most`` lengths (three at most) that sum
        to ``total``, fewer and larger ones first. Some may have run out when
        they come."""
        if self.live[total] and most > 0:
            yield [total]
        if most > 1:
            yield from self.two(total, total)
        if most < 3:
            return
        first = np.arange(total - 2, (total - 1) // 3, -1)
        for a in first[self.live[first] & (self.pairs[total - first] > 0)].tolist():
            if self.live[a]:
                for rest in self.two(total - a, a):
                    yield [a, *rest]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences) for all pieces: the
    first plan of the fewest sequences, see above."""
    return min((plan_with(histogram, capacity, most) for most in (3, 2, 1, 0)), key=lambda made: sum(n for _, n in made))


def plan_with(histogram: dict[int, int], capacity: int, most: int) -> list[tuple[list[int], int]]:
    """A plan whose exact fills add up to ``most`` lengths to the longest one; 0 is plain best fit."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] += n
    made = [([capacity], int(count[capacity]))] if count[capacity] else []
    count[capacity] = 0
    sums = Sums(count)
    for length in range(capacity - 1, 0, -1) if most else ():
        if not count[length]:
            continue
        for rest in sums.of(capacity - length, most):
            whole = [length, *rest]
            if times := sums.times(whole):
                sums.take(whole, times)
                made.append((whole, times))
                if not count[length]:
                    break
    gaps: list[int] = []
    open_: dict[int, list[tuple[list[int], int]]] = defaultdict(list)

    def keep(lengths: list[int], times: int) -> None:
        gap = capacity - sum(lengths)
        if not open_[gap]:
            insort(gaps, gap)
        open_[gap].append((lengths, times))

    for length in range(capacity - 1, 0, -1):
        left = int(count[length])
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                if left >= each:
                    keep([length] * each, left // each)
                if left % each:
                    keep([length] * (left % each), 1)
                break
            gap = gaps[at]
            lengths, times = open_[gap].pop()
            if not open_[gap]:
                gaps.pop(at)
            # The gap that got one is now the smallest that holds the next of its length, until it is too small.
            each = min(gap // length, left)
            used = min(times, left // each)
            if used < times:
                keep(lengths, times - used)
            keep(lengths + [length] * each, used)
            left -= used * each
    return made + [x for group in open_.values() for x in group]


def intervals(sequences: list[tuple[list[int], int]]) -> pd.DataFrame:
    """Rows (length, first rank, sequence of that rank, offset), in order."""
    rows, cursor, first = [], defaultdict(int), 0
    for lengths, times in sequences:
        offset = 0
        for x in lengths:
            rows.append((x, cursor[x], first, offset))
            cursor[x] += times
            offset += x
        first += times
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "offset"]).sort_values(["length", "rank"], ignore_index=True)


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, with_ids: bool = False, markers: bool = False) -> DataFrame:
    """One row a piece: ``doc_id, piece, start, length, ids_crc32`` (and ``ids``),
    with the number of the task that made it."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        for pdf in batches:
            rows = []
            for key, ids in zip(pdf["doc_id"].tolist(), encode(pdf["text"].tolist(), tokenizer_path, markers), strict=True):
                ids = np.append(ids.astype("<u4"), np.uint32(end_id))
                start, piece = 0, 0
                stop = len(ids) % capacity or capacity
                while start < len(ids):
                    own = ids[start:stop]
                    rows.append((None if key is None or key != key else int(key), piece, start, len(own), zlib.crc32(own), part, *([own.astype(np.int64)] if with_ids else [])))
                    start, stop, piece = stop, stop + capacity, piece + 1
            frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", *["ids"] * with_ids])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    keyed = need(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("string"))
    return keyed.mapInPandas(tidy(cut), "doc_id long, piece int, start long, length long, ids_crc32 long, part int" + ", ids array<long>" * with_ids)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048, with_ids: bool = False, markers: bool = False) -> DataFrame:
    """Pack all of ``docs`` into few sequences of at most ``capacity`` ids.

    Returns one row a piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset`` and, with ``with_ids``, ``ids``.

    Null text counts as empty and is a piece of just the end id; null and
    repeated keys are kept, each row a document of its own; extra columns are
    ignored; an empty table gives no rows. Only documents longer than
    ``capacity`` are cut; their first piece takes what doesn't fill a sequence.
    ``markers``: as of ``MemoEncoder``.

    Ranks within a length come from counts by (task, length) and a numbering
    within these, so a length that a third of all pieces have is ranked by as
    many tasks as made them. These counts grow with the tasks and are joined by
    a shuffle; only the plan, bounded by ``capacity``, is sent to all tasks.
    """
    spark = docs.sparkSession
    pieces = written(cut_pieces(docs, tokenizer_path, end_id, capacity, with_ids, markers), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = written(by_part, "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = intervals(plan(histogram, capacity))
    key = (steps["length"].to_numpy(np.int64) << 44) + steps["rank"].to_numpy(np.int64)
    sent = spark.sparkContext.broadcast((key, steps["sequence"].to_numpy(np.int64), steps["offset"].to_numpy(np.int64)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    own = Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("own", F.row_number().over(own) - 1).join(bases.hint("merge"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("own"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, sequences, offsets = sent.value
        for pdf in batches:
            rank = pdf["rank"].to_numpy(np.int64)
            at = np.searchsorted(keys, (pdf["length"].to_numpy(np.int64) << 44) + rank, side="right") - 1
            pdf["sequence_id"] = sequences[at] + (rank - (keys[at] & (1 << 44) - 1))
            pdf["offset"] = offsets[at]
            pdf["doc_id"] = pd.array(pdf["doc_id"], "string").astype("Int64")
            yield pdf.drop(columns=["rank"])

    cols = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    shape = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids + ", sequence_id long, offset long"
    return ranked.select(F.col("doc_id").cast("string").alias("doc_id"), *cols[1:], "rank").mapInPandas(tidy(place), shape)
