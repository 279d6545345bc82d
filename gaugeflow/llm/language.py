"""Language identification by compression.

Each language gets a raw-content zstandard dictionary made of its frequent
words. All blocks of a text are compressed with each; the language whose dictionary makes it
smallest is predicted, and a narrow margin marks the prediction as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import need, tidy, written

_LEVEL = 6
#: Bytes compressed at once: a long text's own words would else serve it as well as a dictionary's.
_BLOCK = 1000


def fit(labelled: DataFrame, docs_each: int = 2000, dictionary_bytes: int = 1 << 14) -> dict[str, bytes]:
    """language -> dictionary, from ``text`` and ``lang`` of ``labelled``.

    Learns from a bounded sample: at most ``docs_each`` distinct texts a
    language (those of least hash, so the same for any partitioning and any
    number of copies). Of their words, the ones that save most (bytes times
    count) are kept up to ``dictionary_bytes``, the most saving last, where
    matches cost least; words that come once only fill what is left. Null
    languages and texts teach nothing, copies no more than one of them; a
    language with any words has a dictionary; no rows give no languages.
    """
    known = need(labelled, "text", "lang").where("lang is not null and text is not null").select("text", F.col("lang").alias("language"))
    known = known.withColumn("h", F.xxhash64("text"))
    # One count of distinct texts a language comes to the driver. A share of the hash space that holds about as many as are
    # wanted is cut out where the text is read, so only the sample's texts are shuffled, each once a task.
    counts = {r["language"]: r["n"] for r in known.select("language", "h").distinct().groupBy("language").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    shares = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, 1.2 * docs_each / n)])
    near = known.where(F.col("h").cast("double") / 2.0**64 + 0.5 <= shares[F.col("language")])
    sample = near.dropDuplicates(["language", "h"]).withColumn("k", F.row_number().over(Window.partitionBy("language").orderBy("h", "text"))).where(F.col("k") <= docs_each)
    words = sample.select("language", F.explode(F.split("text", r"\s+")).alias("w")).where("w <> ''").groupBy("language", "w").agg(F.count("*").alias("n"))
    best = words.withColumn("gain", F.col("n") * (F.octet_length("w") + 1)).withColumn("size", F.octet_length("w") + 1)
    order = Window.partitionBy("language").orderBy(F.col("n") == 1, F.desc("gain"), "w").rowsBetween(Window.unboundedPreceding, 0)
    taken = best.withColumn("total", F.sum("size").over(order)).where(F.col("total") <= dictionary_bytes)
    by_language: dict[str, list] = {}
    for r in taken.select("language", "w", "n", "gain").collect():
        by_language.setdefault(r["language"], []).append((r["n"] > 1, r["gain"], r["w"]))
    out = {k: " ".join(w for *_, w in sorted(v)).encode() + b" " for k, v in by_language.items()}
    for language in counts:
        out.setdefault(language, b" ")
    return dict(sorted(out.items()))


@lru_cache(maxsize=4)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...]):
    out = []
    for language, content in dictionaries:
        data = zstandard.ZstdCompressionDict(content if len(content) >= 8 else content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=_LEVEL)
        out.append((language, zstandard.ZstdCompressor(level=_LEVEL, dict_data=data, write_checksum=False, write_content_size=False)))
    return out


_LETTER = re.compile(r"[^\W\d_]")


def classify(text: str | None, compressors, margin: float) -> tuple[str, float, bool]:
    """Predicted language, score, whether the margin is too narrow.

    The score weighs each language by two to the power of minus its size in
    bits, a quarter of them counted, as repeated words aren't independent."""
    if not text or not compressors or not (_LETTER.search(text) and any(map(str.isalpha, text))):
        return "und", 0.0, True
    data = text.encode()
    blocks = [data[i : i + _BLOCK] for i in range(0, len(data), _BLOCK)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), language) for language, c in compressors)
    least = sizes[0][0]
    weights = [2.0 ** -min(60.0, 2.0 * (s - least)) for s, _ in sizes]
    narrow = len(sizes) > 1 and (sizes[1][0] - least) < margin * len(data)
    return sizes[0][1], weights[0] / sum(weights), narrow


def predict(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = 0.01) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text``): ``doc_id``, ``lang_pred``,
    ``score`` in 0..1 and ``rejected`` (best and second best differ by less
    than ``margin`` of the text's bytes).

    Null texts and texts without a letter are ``und`` with score 0, as are all
    texts if no language was learned. Ties go to the language that sorts
    first and are always rejected. Extra columns, a ``lang`` among them, are
    ignored; repeated and null ids give a row each; an empty table gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tuple(dictionaries.items()))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compressors = _compressors(sent.value)
        for pdf in batches:
            out = pd.DataFrame([classify(t, compressors, margin) for t in pdf["text"].tolist()], columns=["lang_pred", "score", "rejected"])
            out.insert(0, "doc_id", pd.array(pdf["doc_id"], "string").astype("Int64"))
            yield out

    keyed = need(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("string"))
    return written(keyed.mapInPandas(tidy(each), "doc_id long, lang_pred string, score double, rejected boolean"), "languages")


def is_held_out(doc_id) -> Column:
    """Fold 0 of 5 by the id's crc32; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
