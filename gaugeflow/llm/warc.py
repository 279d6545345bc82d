"""Zstandard web archives: a dictionary frame, then one frame a record.

Files start with a skippable frame that holds the dictionary; each record is a
frame of its own, so a reader can start at any record's place. The reader
loads the dictionary, finds each frame's end from its block headers, decodes
it, and checks the record's version line, headers and lengths.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, join_hot, need, new_path, tidy, written
from .files import put

#: Fixed values of the format.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
#: Signs that a URI holds as they are, besides letters and digits.
_URI = "%:/?#[]@!$&'()*+,;=-._~"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BadArchive(ValueError):
    """An archive that breaks the format."""


def make_dictionary(samples: list[bytes], size: int = 32_768) -> bytes:
    """A dictionary from a bounded sample; raw content where training can't."""
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:].ljust(8)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode(), b"", b""]
    return b"\r\n".join(lines) + block + b"\r\n\r\n"


def archive(records: list[bytes], dictionary: bytes) -> bytes:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=3)
    compress = zstandard.ZstdCompressor(level=3, dict_data=data, write_checksum=True).compress
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)), dictionary, *map(compress, records)])


def frame_end(data: bytes, at: int) -> int:
    """Where the frame that starts at ``at`` ends."""
    if len(data) < at + 5 or struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise BadArchive(f"no frame at byte {at}")
    checksum = data[at + 4] >> 2 & 1
    at += zstandard.frame_header_size(data[at : at + 18])
    while True:
        if at + 3 > len(data):
            raise BadArchive("a frame is cut short")
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    if (at := at + 4 * checksum) > len(data):
        raise BadArchive("a frame is cut short")
    return at


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record; lengths are checked."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if first != VERSION or not gap:
        raise BadArchive("a record doesn't start with its version and headers")
    headers = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise BadArchive(f"not a header: {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise BadArchive(f"a record has no {name}")
    length = headers["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadArchive(f"a record's length isn't {length}")
    return headers, rest[:-4]


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, one frame each."""
    if len(data) < 8:
        raise BadArchive("no dictionary frame")
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC or len(data) < 8 + size:
        raise BadArchive("no whole dictionary frame at the start")
    dictionary = data[8 : 8 + size]
    if dictionary[:4] == struct.pack("<I", FRAME_MAGIC):
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    decode, at = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)), 8 + size
    while at < len(data):
        if len(data) >= at + 8 and 0x184D2A50 <= struct.unpack_from("<I", data, at)[0] <= 0x184D2A5F:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        end = frame_end(data, at)
        try:
            raw = decode.decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise BadArchive(f"the frame at byte {at} can't be decoded: {e}") from e
        yield parse(raw)
        at = end


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 1000, archive_bytes: int = 8 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) as archives; returns their
    ``uri`` and ``n_records``.

    Of pages with equal payloads of at least ``least_bytes``, the one of the
    greatest ``page_id`` is a response and others revisit it; null html is an
    empty payload, a null id is never revisited nor revisits; rows with the
    greatest id twice are responses both. Extra columns are ignored; an empty
    table gives no archive. Names follow from the task, so a retried task
    replaces its own files. What no URI can hold is percent-encoded in the
    target's header, and once more, reversibly, in a header of its own.
    """
    folder = folder or new_path(pages.sparkSession, "archives")
    own = need(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"),
    ).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    twice = own.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    # A digest may be that of most pages, so only ids are joined by it, salted. Payloads move once, by their page's id.
    slim = own.where(F.octet_length("html") >= least_bytes).select("page_id", "digest").where("page_id is not null").distinct()
    slim = written(slim, "page-digests")
    found = join_hot(slim, twice, "digest", F.col("page_id"), hot_keys(slim, "digest"))
    refers = found.where(F.col("page_id") < F.col("first")).select("page_id", "digest", F.col("first").cast("string").alias("refers"))
    known = own.where("page_id is not null").join(refers, ["page_id", "digest"], "left")
    sent = known.unionByName(own.where("page_id is null").withColumn("refers", F.lit(None).cast("string")))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, held, raws = TaskContext.get().partitionId(), 0, 0, []
        dictionary = None

        def flush() -> pd.DataFrame:
            nonlocal dictionary
            if dictionary is None:
                dictionary = make_dictionary([r[:16_384] for r in raws[:200]])
            uri = f"{folder}/part-{part:06d}-{seq:06d}.warc.zst"
            put(uri, archive(raws, dictionary))
            return pd.DataFrame({"uri": [uri], "n_records": [len(raws)]})

        for pdf in batches:
            for page, url, html, digest, refers in zip(*(pdf[c].tolist() for c in ("page", "url", "html", "digest", "refers")), strict=True):
                payload = html.encode()
                headers = [
                    ("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"), ("WARC-Date", date),
                    ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload))), ("X-Page", page or ""),
                ]
                if url is not None:
                    headers.append(("WARC-Target-URI", quote(url, safe=_URI)))
                    if url != headers[-1][1]:
                        headers.append(("X-Target", quote(url, safe=_URI.replace("%", ""))))
                if refers:
                    headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers}')}>"), ("X-Refers-To-Page", refers)]
                raw = record(headers, b"" if refers else payload)
                raws.append(raw)
                held += len(raw)
                if held >= archive_bytes:
                    yield flush()
                    raws, held, seq = [], 0, seq + 1
        if raws:
            yield flush()

    named = sent.select(F.col("page_id").cast("string").alias("page"), "url", "html", "digest", "refers")
    return written(named.mapInPandas(tidy(write), "uri string, n_records long"), "archive-list")


def read_archives(files: DataFrame) -> DataFrame:
    """The records of ``files`` (``path, content``, as the binaryFile source
    gives them): ``page_id, url, record_type, refers_to, payload_bytes,
    payload_digest, payload``.

    Lengths are checked for all records, and digests for those that carry
    their payload; a broken archive fails with ``BadArchive``.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                for headers, block in records(bytes(content)):
                    kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha1:")
                    size = int(headers.get("x-payload-length", len(block)))
                    if kind != "revisit" and (size != len(block) or digest and digest != hashlib.sha1(block).hexdigest()):
                        raise BadArchive(f"the payload of {headers['warc-record-id']} isn't what its headers say")
                    page, refers = headers.get("x-page"), headers.get("x-refers-to-page")
                    url = unquote(headers["x-target"]) if "x-target" in headers else headers.get("warc-target-uri")
                    rows.append((int(page) if page else None, url, kind, int(refers) if refers else None, size, digest, block))
                    if len(rows) >= 500:
                        yield frame(rows)
                        rows = []
                yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
        for c in ("page_id", "refers_to", "payload_bytes"):
            out[c] = pd.array(out[c].tolist(), "Int64")
        return out

    return files.select("content").mapInPandas(tidy(read), "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` and read the archives back; see the two above."""
    spark = pages.sparkSession
    folder = new_path(spark, "archives")
    if not write_archives(pages, folder).limit(1).count():
        return spark.createDataFrame([], "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")
    return read_archives(spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.zst").load(folder))
