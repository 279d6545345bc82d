"""Token files and packing against the tokenizers library itself."""

import random
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from functools import lru_cache
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from gaugeflow.llm import encoding, packing, token_files
from gaugeflow.llm.encoding import MemoEncoder

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["a  b", "a \n b", " x", "x ", "\n\n foo  bar\t baz", "  ", "", "it's  don't 'll", "\x1c a \x85b", "12 345 !? ...", "é ́a", "<|endoftext|> hi", "ΑΣ ΑΣ.", "　 c", " x  y", "a" * 3000]


@lru_cache
def library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def direct(path, text):
    return library(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_memo_gives_the_library_s_ids(path):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab'sé \n\t.,1　") for _ in range(40)) for _ in range(300)]
    enc = MemoEncoder(path, memo=50)
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        assert ids.tolist() == direct(path, text), repr(text)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_markers_give_the_library_s_default_ids(path):
    default = Tokenizer.from_file(path)
    texts = [*ODD, "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|startoftext|>\n y", "<|ENDOFTEXT|> <|endoftext"]
    for text, ids in zip(texts, MemoEncoder(path, markers=True).encode(texts), strict=True):
        assert ids.tolist() == default.encode(text, add_special_tokens=False).ids, repr(text)
    assert default.token_to_id("<|endoftext|>") in MemoEncoder(path, markers=True).encode(["a <|endoftext|> b"])[0]


def test_files_and_packing_take_markers(docs):
    texts = ["a <|endoftext|> b", "plain words"]
    for path, rows in ((WORD, token_files.read_token_files(token_files.write_token_files(docs(*enumerate(texts)), WORD, 1, markers=True))), (BYTE, packing.pack(docs(*enumerate(texts)), BYTE, 1, 64, with_ids=True, markers=True))):
        assert {r["doc_id"]: r["ids"] for r in rows.collect()} == {i: [*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n in (1, 5, 300, 2000):
        ends = np.cumsum(rng.integers(0, 50, n))
        ef = token_files.EliasFano.of(ends, int(ends[-1]))
        assert [ef.select(i) for i in range(n)] == ends.tolist()


def test_token_files_round_trip(docs):
    rows = [(i * 7 % 50, t) for i, t in enumerate(ODD + ["word " * 500] * 20)] + [(None, "null id"), (3, None), (3, None)]
    manifest = token_files.write_token_files(docs(*rows), WORD, end_id=1, segment_ids=700)
    back = token_files.read_token_files(manifest).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    back.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in back] == [r[0] for r in order]
    at = 0
    for (_, text), r in zip(order, back, strict=True):
        ids = [*direct(WORD, text or ""), 1]
        assert (r["start"], r["n_tokens"], r["ids"]) == (at, len(ids), ids) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4"))
        at += len(ids)
    assert manifest.count() > 1


def test_keys_of_a_file():
    for keys in ([None, None, -(2**63), -5, -5, 0, 7, 2**63 - 1], [None], [3], list(range(-1000, 1000)), [0] * 600):
        arrays = [np.arange(k % 4, dtype="<u2") for k in range(len(keys))]
        seg = token_files.Segment(token_files.segment(1, 2, keys, arrays, np.dtype("<u2")))
        assert [seg.key(i) for i in range(seg.n)] == keys
        assert all(seg.ids(i).tolist() == a.tolist() for i, a in enumerate(arrays))
    # Two bits and what a key's share of the range takes, not 64.
    seg = token_files.segment(0, 0, list(range(10_000)), [np.zeros(0, "<u2")] * 10_000, np.dtype("<u2"))
    assert len(seg) < 10_000


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read_token_files(token_files.write_token_files(none, WORD, 1)).count() == 0
    assert packing.pack(none, BYTE).count() == 0


def test_cut_token_file_is_refused():
    data = token_files.segment(0, 0, [1], [np.array([1, 2], "<u2")], np.dtype("<u2"))
    with pytest.raises(ValueError):
        token_files.Segment(data[:-1])


def test_plan_places_all_and_is_tight():
    rng = np.random.default_rng(2)
    for n in (1, 40, 3000):
        lengths = np.clip(rng.lognormal(5, 1, n).astype(int), 1, 512)
        histogram = {int(a): int(b) for a, b in zip(*np.unique(lengths, return_counts=True), strict=True)}
        made, used = packing.plan(histogram, 512), {}
        for own, times in made:
            assert sum(own) <= 512 and times > 0
            for x in own:
                used[x] = used.get(x, 0) + times
        assert used == histogram
        assert sum(t for _, t in made) <= -(-int(lengths.sum()) // 512) * 1.05 + 2


def brute_fills(histogram, capacity):
    """Whether an exact fill of one to four lengths is left that holds a given length."""
    own = sorted(x for x, n in histogram.items() if n > 0)
    return {tuple(sorted(c)) for k in (2, 3, 4) for c in combinations_with_replacement(own, k) if sum(c) == capacity and all(histogram[x] >= c.count(x) for x in c)}


def test_exact_fills_are_used_up():
    rng = random.Random(12)
    for _ in range(60):
        histogram = {x: rng.randint(1, 4) for x in rng.sample(range(1, 24), rng.randint(2, 12))}
        made, left = packing.plan_with(histogram, 24, 3), dict(histogram)
        for own, times in made:
            if sum(own) == 24 and len(own) <= 4:
                for x in own:
                    left[x] -= times
        # Residuals may fill a sequence too, but no combination is left that the index could have filled.
        assert not brute_fills(left, 24), (histogram, made)


def test_sums_are_all_combinations():
    rng = random.Random(13)
    for _ in range(40):
        count = np.array([0, *(rng.choice((0, 0, 1, 2, 3)) for _ in range(20))])
        sums = packing.Sums(count.copy())
        for total in range(1, 21):
            there = [x for x in range(1, 21) if count[x]]
            want = {c for k in (1, 2, 3) for c in combinations_with_replacement(there, k) if sum(c) == total}
            found = [tuple(sorted(c)) for c in sums.of(total)]
            assert len(found) == len(set(found)) and set(found) == want
            for c in found:
                assert sums.times(list(c)) == min(count[x] // c.count(x) for x in c)


def test_packing(docs):
    rng = random.Random(4)
    rows = [(i, " ".join("word" for _ in range(rng.choice((0, 3, 30, 63, 64, 65, 200))))) for i in range(120)] + [(5, "again"), (None, "null"), (None, None)]
    got = packing.pack(docs(*rows), BYTE, end_id=0, capacity=64, with_ids=True).collect()
    by_sequence, by_doc = {}, {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4")) and r["length"] == len(r["ids"]) <= 64
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    for i in [x for x in range(120) if x != 5]:
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [t for r in own for t in r["ids"]] == [*direct(BYTE, rows[i][1]), 0]
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert [r["length"] for r in own[1:]] == [64] * (len(own) - 1)
    assert len(by_doc[5]) >= 2 and len(by_doc[None]) == 2


def best_fit(histogram, capacity):
    """Sequences of plain best-fit decreasing, one piece at a time."""
    gaps, made = [], 0
    for x in sorted((length for length, n in histogram.items() for _ in range(n)), reverse=True):
        at = bisect_left(gaps, x)
        made += at == len(gaps)
        insort(gaps, (capacity if at == len(gaps) else gaps.pop(at)) - x)
    return made


def test_plan_is_never_worse_than_best_fit():
    rng = random.Random(8)
    cases = [
        {x: rng.randint(1, 3) for x in range(1, 2048)}, {x: rng.randint(1, 20) for x in range(1, 2048)}, Counter(rng.randint(1, 2047) for _ in range(700)), Counter(rng.randint(500, 1500) for _ in range(9000)),
        Counter(min(2048, 1 + int(rng.expovariate(1 / 300))) for _ in range(9000)), *[Counter(rng.randint(1, 60) for _ in range(rng.randint(1, 90))) for _ in range(60)],
    ]
    for histogram in cases:
        capacity = 2048 if max(histogram) > 60 else 60
        made, used = packing.plan(histogram, capacity), Counter()
        for lengths, times in made:
            assert sum(lengths) <= capacity
            for x in lengths:
                used[x] += times
        assert used == Counter(histogram)
        assert sum(n for _, n in made) <= best_fit(histogram, capacity)
        assert sum(n for _, n in packing.plan_with(histogram, capacity, 0)) == best_fit(histogram, capacity)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_a_memo_keeps_no_long_pieces(path):
    """Texts without spaces are encoded whole each time: the memo's bytes stay bounded, and ids are the library's."""
    rng = random.Random(9)
    texts = ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(400)) for _ in range(60)] + ["a" * 47 + " " + "b" * 48 + " " + "c" * 49 + "," + "d" * 60]
    enc = MemoEncoder(path, memo=50)
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        assert ids.tolist() == direct(path, text)
    kept = [p for m in (enc.first, enc.rest) for d in (m, m.old, m.words) for p in d]
    assert max(map(len, kept), default=0) <= 48
    assert sum(len(p.encode()) for p in kept) < 50_000


def test_ascii_words_are_those_of_the_files_pattern():
    rng = random.Random(23)
    plain, whole = re.compile(encoding.ASCII_LEVEL, re.ASCII).findall, regex.compile(encoding.BYTE_LEVEL).findall
    every, few = [chr(i) for i in range(128)], " a'stdl1.\n\t\r-\x1c\x1f\x0b\x0c"
    for i in range(20000):
        text = "".join(rng.choices(every if i % 2 else few, k=rng.randint(0, 12)))
        assert plain(text) == whole(text), text
