"""Token-id files with Elias-Fano document boundaries.

A file holds the ids of consecutive documents back to back and, instead of a
64-bit offset a document, the document ends in Elias-Fano form: the low bits
of each end packed side by side, the high bits in unary in one bit vector. A
sample of every 256th one's place makes ``select`` short, so any document's
place is found without unpacking the rest. Document keys ascend too, so they
have the same form, less the file's first key; no 64-bit table is stored.

File layout (little endian): magic ``GFEFTOK2``; partition u32, sequence u32,
documents u64, null keys u64 (they come first), first key i64, ids u64, bytes
an id u8, low bits of ends u8 and of keys u8, then seven section lengths u64
and the sections: ids; low bits, high bits, select samples u32 of the ends;
the same three of the keys.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import need, new_path, tidy, written
from .encoding import encode, id_type
from .files import put

MAGIC = b"GFEFTOK2"
HEAD = struct.Struct("<8sIIQQqQBBB7Q")
SAMPLE = 256


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """The ``width`` low bits of each value, least first, side by side."""
    if not width or not len(values):
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


class EliasFano:
    """A non-decreasing sequence ``ends`` of n numbers below or at ``total``."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, ends: np.ndarray, total: int) -> EliasFano:
        n = len(ends)
        width = max(0, (total // n).bit_length() - 1) if n else 0
        ends = ends.astype(np.uint64)
        places = (ends >> np.uint64(width)).astype(np.int64) + np.arange(n)
        ones = np.zeros((int(places[-1]) + 1 if n else 0) + 7 & ~7, np.uint8)
        ones[places] = 1
        return cls(n, width, pack_bits(ends, width), np.packbits(ones, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """The i-th number: from the nearest sample on, count ones by the byte."""
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at // 8
        word = self.high[byte] >> at % 8 << at % 8
        while (ones := word.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        low = 0
        if self.low_bits:
            first = i * self.low_bits
            chunk = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8], "little")
            low = chunk >> first % 8 & (1 << self.low_bits) - 1
        return (place - i << self.low_bits) + low


def segment(partition: int, sequence: int, keys: list, arrays: list[np.ndarray], dtype: np.dtype) -> bytes:
    """One file's bytes. Keys ascend, nulls first."""
    ends = np.cumsum([len(a) for a in arrays], dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    there = [k for k in keys if k is not None]
    first = there[0] if there else 0
    ef, named = EliasFano.of(ends, total), EliasFano.of(np.array([k - first for k in there], np.uint64), there[-1] - first if there else 0)
    parts = [np.concatenate(arrays).astype(dtype).tobytes() if arrays else b"", ef.low, ef.high, ef.samples.tobytes(), named.low, named.high, named.samples.tobytes()]
    head = HEAD.pack(MAGIC, partition, sequence, len(keys), len(keys) - len(there), first, total, dtype.itemsize, ef.low_bits, named.low_bits, *map(len, parts))
    return head + b"".join(parts)


class Segment:
    """A file read back. A document's place is found by ``select``: its ids are
    those between the end before it and its own."""

    def __init__(self, data: bytes):
        magic, self.partition, self.sequence, self.n, self.nulls, self.first, self.total, width, end_bits, key_bits, *lengths = HEAD.unpack_from(data)
        if magic != MAGIC or HEAD.size + sum(lengths) != len(data):
            raise ValueError("not a token file, or one cut short")
        at, parts = HEAD.size, []
        for length in lengths:
            parts.append(data[at : at + length])
            at += length
        self.tokens = np.frombuffer(parts[0], f"<u{width}")
        self.ends = EliasFano(self.n, end_bits, parts[1], parts[2], np.frombuffer(parts[3], "<u4"))
        self.named = EliasFano(self.n - self.nulls, key_bits, parts[4], parts[5], np.frombuffer(parts[6], "<u4"))

    def key(self, i: int) -> int | None:
        return None if i < self.nulls else self.first + self.named.select(i - self.nulls)

    def bounds(self, i: int) -> tuple[int, int]:
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        start, end = self.bounds(i)
        return self.tokens[start:end]


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, segment_ids: int = 4_000_000, markers: bool = False) -> DataFrame:
    """Encode ``text`` of ``docs`` and write token files in ascending ``doc_id``.

    Returns the manifest: one row a file with ``partition``, ``sequence``,
    ``n_docs``, ``n_ids``, ``uri`` and ``base`` (ids in all files before it).

    Null text counts as empty and yields just the end id; null keys come first;
    equal keys are all kept, ordered by text; extra columns are ignored; an
    empty table gives no file. A long document is never cut; one larger than
    ``segment_ids`` gets a file of its own. A repeated task writes the same
    names, so retries leave one copy. ``markers``: as of ``MemoEncoder``.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, small = TaskContext.get().partitionId(), 0, id_type(tokenizer_path)
        dtype = np.dtype("<u4") if end_id >= 1 << 8 * small.itemsize else small
        keys, arrays, held = [], [], 0

        def flush() -> pd.DataFrame:
            uri = f"{folder}/part-{part:06d}-{seq:06d}.eft"
            put(uri, segment(part, seq, keys, arrays, dtype))
            return pd.DataFrame({"partition": [part], "sequence": [seq], "n_docs": [len(keys)], "n_ids": [held], "uri": [uri]})

        for pdf in batches:
            for key, ids in zip(pdf["doc_id"].tolist(), encode(pdf["text"].tolist(), tokenizer_path, markers), strict=True):
                if keys and held + len(ids) >= segment_ids:
                    yield flush()
                    keys, arrays, held, seq = [], [], 0, seq + 1
                keys.append(None if key is None or key != key else int(key))
                arrays.append(np.append(ids.astype(dtype), np.array([end_id], dtype)))
                held += len(ids) + 1
        if keys:
            yield flush()

    ordered = need(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered = ordered.withColumn("doc_id", F.col("doc_id").cast("string"))
    manifest = written(ordered.mapInPandas(tidy(write), "partition int, sequence int, n_docs long, n_ids long, uri string"), "token-manifest")
    # One number a write task goes to the driver; the rest of the sum stays in Spark.
    totals = sorted((r["partition"], r["n"]) for r in manifest.groupBy("partition").agg(F.sum("n_ids").alias("n")).collect())
    before, sums = 0, []
    for part, n in totals:
        sums.append((part, before))
        before += n
    bases = spark.createDataFrame(sums, "partition int, part_base long")
    within = Window.partitionBy("partition").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("earlier", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(bases, "partition").select("partition", "sequence", "n_docs", "n_ids", "uri", (F.col("part_base") + F.col("earlier")).alias("base"))


def read_token_files(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """The documents of the files: ``doc_id``, ``start``, ``n_tokens``,
    ``ids_crc32`` and, if asked for, ``ids``, each found by ``select``. Files
    are opened where the task runs; no file's bytes are shuffled."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri, base in zip(pdf["uri"], pdf["base"], strict=True):
                store, path = pafs.FileSystem.from_uri(uri)
                with store.open_input_stream(path, compression=None) as f:
                    seg = Segment(f.read())
                for first in range(0, seg.n, 1000):
                    docs = range(first, min(seg.n, first + 1000))
                    places = [seg.bounds(i) for i in docs]
                    ids = [seg.tokens[a:b].astype("<u4") for a, b in places]
                    out = {"doc_id": pd.array([seg.key(i) for i in docs], "Int64"), "start": [a + base for a, _ in places], "n_tokens": [b - a for a, b in places], "ids_crc32": [zlib.crc32(x) for x in ids]}
                    yield pd.DataFrame(out | ({"ids": [x.astype(np.int64) for x in ids]} if with_ids else {}))

    tasks = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("uri", "base").repartition(tasks).mapInPandas(tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
