"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to words, and words to numbers; every window of an item is
a sequence of these, so it matches whole words only. Each text is scanned once
(once a block of a larger benchmark), and the places of hits are carried back
from the words to the characters of the original text.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from contextlib import AbstractContextManager
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, discard, need, tidy, written

#: Bytes that are no part of a word once A-Z are lower case: all ASCII but digits and a-z.
_TO_SPACE = bytes(b if b >= 0x80 or chr(b).isdigit() or "a" <= chr(b) <= "z" else 32 for b in range(256))
#: Bytes of benchmark text a block. An automaton takes some 45 times as much (350 MB were measured for 8.1 MB of rare words).
MAX_BYTES = 8 << 20


def byte_words(text: str | None) -> list[bytes]:
    """The words of ``text``, lower-cased in A-Z, as UTF-8; Unicode's other spaces are word characters."""
    return text.encode().lower().translate(_TO_SPACE).split() if text else []


def words_of(text: str | None) -> list[str]:
    """``byte_words`` as strings."""
    return [w.decode() for w in byte_words(text)]


def cut(text: str | None, size: int, most: int) -> Iterator[str]:
    """Runs of the words of ``text`` of about ``most`` bytes, which overlap so that they have its windows."""
    words, start, end, weight = byte_words(text), 0, 0, 0
    while end < len(words):
        weight += len(words[end]) + 1
        end += 1
        if weight >= most and end - start >= size and end < len(words):
            yield b" ".join(words[start:end]).decode()
            start = end - size + 1
            weight = sum(len(w) + 1 for w in words[start:end])
    if words:
        yield b" ".join(words[start:]).decode()


def _blocks(benchmark: DataFrame, size: int, max_bytes: int) -> Iterator[tuple[tuple[str, str], ...]]:
    """The items in blocks of about ``max_bytes`` of text; longer items are cut. One empty block if there are none.

    Items come to the driver a partition at a time, so it never holds them all."""
    items = need(benchmark, "item_id", "text").where("item_id is not null and text is not null")
    block, weight = set(), 0
    for r in items.toLocalIterator():
        for run in cut(r["text"], size, max_bytes):
            n = len(run.encode())
            if block and weight + n > max_bytes:
                yield tuple(sorted(block))
                block, weight = set(), 0
            block.add((str(r["item_id"]), run))
            weight += n
    yield tuple(sorted(block))


class Machine:
    """An automaton in flat arrays, over the numbers of a block's distinct words (from 1; 0 is any other word).

    States are the distinct starts of windows, numbered by length, then by their own start and last word; so one sorted
    array of (start << 32 | word) holds all edges, and a state's place there is its number. State 0 is the empty start.
    A state has 16 bytes, and a word of an item has at most ``size`` states."""

    #: Words a segment: texts are cut into these, and all segments of a batch take their steps together.
    SEGMENT = 128

    def __init__(self, items: tuple[tuple[str, str], ...], size: int):
        self.size, self.numbers = size, {}
        numbers, ids = self.numbers, [np.zeros(0, np.int32)]
        for _, text in items:
            ids.append(np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in byte_words(text)), np.int32))
        self.names = [item for item, _ in items]
        self._states(np.concatenate(ids), np.array([len(x) for x in ids[1:]], np.int64))
        self._fails()

    def _states(self, words: np.ndarray, n: np.ndarray) -> None:
        """Edges of the windows of items of ``n`` words each, and which items have the window that ends in a state."""
        count = np.where(n >= self.size, n - self.size + 1, np.minimum(n, 1))
        item = np.repeat(np.arange(len(n)), count)
        at = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(np.cumsum(n) - n, count)
        length = np.minimum(n, self.size)[item]
        state, edges, self.levels = np.zeros(len(at), np.int64), [np.array([-1])], [0, 1]
        for depth in range(self.size):
            on = np.flatnonzero(length > depth)
            edge, place = np.unique(state[on] << 32 | words[at[on] + depth], return_inverse=True)
            state[on] = self.levels[-1] + place
            edges.append(edge)
            self.levels.append(self.levels[-1] + len(edge))
        self.edges = np.concatenate(edges)
        # items with equal ids, or a window twice in one, are one pair
        pairs = np.unique(state << 32 | item)
        self.ends, self.first = np.unique(pairs >> 32, return_index=True)
        self.first = np.append(self.first, len(pairs))
        self.items = (pairs & 0xFFFFFFFF).astype(np.int32)

    def _fails(self) -> None:
        """Each state's longest proper suffix that is a state, and its longest suffix (itself included) that is a whole window."""
        self.root = np.zeros(len(self.numbers) + 1, np.int32)
        self.root[self.edges[1 : self.levels[2]]] = np.arange(1, self.levels[2])
        self.fail, self.last = np.zeros((2, len(self.edges)), np.int32)
        self.last[self.ends] = self.ends
        for start, end in zip(self.levels[1:], self.levels[2:]):
            if start > 1:
                edge = self.edges[start:end]
                self.fail[start:end] = self.step(self.fail[edge >> 32], (edge & 0xFFFFFFFF).astype(np.int32))
            last = self.last[start:end]
            self.last[start:end] = np.where(last > 0, last, self.last[self.fail[start:end]])

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states after ``word``: along the edge, or the edge of the longest suffix that has one."""
        out = self.root[word]
        # A word that isn't in the block leads to the empty start at once.
        live = np.flatnonzero((state > 0) & (word > 0))
        state = state[live]
        while len(live):
            edge = state.astype(np.int64) << 32 | word[live]
            to = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
            found = self.edges[to] == edge
            out[live[found]] = to[found]
            state = self.fail[state[~found]]
            live = live[~found][state > 0]
            state = state[state > 0]
        return out

    def states(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of words before each text (and in all), and the state after each word.

        A state spans at most ``size`` words, so a segment starts as many words less one before its own first."""
        ids = [np.fromiter(map(self.numbers.get, byte_words(t), repeat(0)), np.int32) for t in texts]
        before = np.cumsum([0, *map(len, ids)])
        words = np.concatenate([np.zeros(0, np.int32), *ids])
        parts = -(-np.diff(before) // self.SEGMENT)
        of = np.repeat(np.arange(len(texts)), parts)
        own = before[of] + (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * self.SEGMENT
        start, end = np.maximum(before[of], own - self.size + 1), np.minimum(before[of + 1], own + self.SEGMENT)
        order = np.argsort(start - end, kind="stable")
        own, start, end = own[order], start[order], end[order]
        longest = end - start
        out, state = np.zeros(len(words), np.int32), np.zeros(len(own), np.int32)
        for t in range(int(longest[0]) if len(longest) else 0):
            active = int(np.searchsorted(-longest, -t))
            at = start[:active] + t
            state = self.step(state[:active], words[at])
            mine = at >= own[:active]
            out[at[mine]] = state[mine]
        return before, out

    def scan(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """Of each text the number of words, merged intervals of hit words, items hit."""
        before, states = self.states(texts)
        spans, own = defaultdict(list), defaultdict(set)
        window = self.last[states]
        at = np.flatnonzero(window)
        window = window[at]
        while len(at):
            length = np.searchsorted(self.levels, window, "right") - 1
            text = np.searchsorted(before, at, "right") - 1
            for i, a, k in zip(text.tolist(), (at - before[text]).tolist(), length.tolist(), strict=True):
                spans[i].append((a - k + 1, a + 1))
            for i, e in np.unique(np.column_stack([text, np.searchsorted(self.ends, window)]), axis=0).tolist():
                own[i].update(self.names[x] for x in self.items[self.first[e] : self.first[e + 1]])
            window = self.last[self.fail[window]]
            at = at[window > 0]
            window = window[window > 0]
        return [(int(n), merge(spans[i]) if i in spans else [], own[i] if i in own else set()) for i, n in enumerate(np.diff(before))]

    def hits(self, texts: list[str | None]) -> np.ndarray:
        """Whether any window occurs, of each text."""
        before, states = self.states(texts)
        found = np.concatenate([[0], np.cumsum(self.last[states] > 0)])[before]
        return np.diff(found) > 0


#: The worker's last automaton; it goes before the next one is made.
_MADE = Kept(Machine, most=1)


def automaton(items: tuple[tuple[str, str], ...], size: int) -> AbstractContextManager[Machine]:
    return _MADE.use(items, size)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of intervals, ascending; those that touch become one."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [tuple(m) for m in merged]


def original_spans(text: str, intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character places (end exclusive) of intervals of words in ``text``."""
    chars = np.frombuffer(text.encode("utf-32-le"), "<u4")
    in_word = (chars >= 0x80) | ((chars >= 48) & (chars < 58)) | ((chars | 32 >= 97) & (chars | 32 < 123))
    edges = np.diff(np.concatenate([[0], in_word.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return [(int(starts[a]), int(ends[b - 1])) for a, b in intervals]


_SHAPE = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string"


def _row(text: str | None, n: int, intervals: list[tuple[int, int]], own: set[str]) -> tuple:
    places = ",".join(f"{a}:{b}" for a, b in original_spans(text, intervals)) if intervals else ""
    return n, sum(b - a for a, b in intervals), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(intervals), places


def _frame(ids: pd.Series, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])
    out.insert(0, "doc_id", ids.astype("Int64"))
    return out


def mark(docs: DataFrame, benchmark: DataFrame, size: int = 10, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Hits of ``benchmark`` (``item_id, text``) in ``docs`` (``doc_id, text``).

    Returns ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and
    ``spans``, the hits' places in the original text as ``start:end``, comma
    joined. A row of ``docs`` gives a row, repeated or null keys too. Null and
    wordless texts have no words, hits or items. Items without words or without
    an ``item_id`` match nothing; items with equal texts count each. Extra
    columns are ignored; an empty benchmark marks nothing.

    The benchmark is cut into blocks of about ``max_bytes`` of text, and all
    texts are scanned once a block. One block is sent to the tasks as it is;
    with more of them ``docs`` is written with row numbers, each block's hits
    are written by row, and a row's spans and items are united.
    """
    blocks = _blocks(benchmark, size, max_bytes)
    first, second = next(blocks), next(blocks, None)
    keyed = need(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("string"))
    if second is not None:
        return _mark_blocks(keyed, chain([first, second], blocks), size)
    sent = docs.sparkSession.sparkContext.broadcast(first)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            with automaton(sent.value, size) as machine:
                out = _frame(pdf["doc_id"], [_row(t, *found) for t, found in zip(pdf["text"].tolist(), machine.scan(pdf["text"].tolist()), strict=True)])
            yield out

    return written(keyed.mapInPandas(tidy(each), _SHAPE), "marks")


def _mark_blocks(keyed: DataFrame, blocks: Iterator[tuple], size: int) -> DataFrame:
    spark = keyed.sparkSession
    numbered = written(keyed.withColumn("row", F.monotonically_increasing_id()), "marked-texts")

    def hits(sent):
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                with automaton(sent.value, size) as machine:
                    found = [(r, *x) for r, x in zip(pdf["row"], machine.scan(pdf["text"].tolist()), strict=True)]
                yield pd.DataFrame([(r, [x for span in spans for x in span], sorted(own)) for r, _, spans, own in found if spans], columns=["row", "at", "own"])

        return each

    parts = []
    for block in blocks:
        sent = spark.sparkContext.broadcast(block)
        parts.append(written(numbered.select("row", "text").mapInPandas(tidy(hits(sent)), "row long, at array<int>, own array<string>"), "block-hits"))
        sent.unpersist()
    of_row = reduce(DataFrame.union, parts).groupBy("row").agg(F.flatten(F.collect_list("at")).alias("at"), F.array_distinct(F.flatten(F.collect_list("own"))).alias("own"))

    def unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, at, own in zip(pdf["text"].tolist(), pdf["at"], pdf["own"], strict=True):
                at, own = ([], []) if at is None else (at, own)
                rows.append(_row(text, len(byte_words(text)), merge([(int(a), int(b)) for a, b in zip(at[::2], at[1::2], strict=True)]), set(own)))
            yield _frame(pdf["doc_id"], rows)

    return numbered.join(of_row, "row", "left").select("doc_id", "text", "at", "own").mapInPandas(tidy(unite), _SHAPE)


def remove(docs: DataFrame, benchmark: DataFrame, size: int = 10, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``docs`` without the contaminated ones, with their own columns. With
    more than one block of items, what each leaves is written for the next."""

    def cleaner(sent):
        @F.pandas_udf("boolean")
        def clean(texts: pd.Series) -> pd.Series:
            with automaton(sent.value, size) as machine:
                return pd.Series(~machine.hits(texts.tolist()))

        return clean(F.col("text"))

    spark, kept = docs.sparkSession, None
    blocks = _blocks(benchmark, size, max_bytes)
    block = next(blocks)
    while block is not None:
        sent, after = spark.sparkContext.broadcast(block), next(blocks, None)
        left = docs.where(cleaner(sent))
        if after is not None:
            left = written(left, "clean-of-block")
            sent.unpersist()
            if kept is not None:
                discard(spark, kept)
            kept = left
        docs, block = left, after
    return docs
