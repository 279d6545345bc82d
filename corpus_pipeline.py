"""A corpus pipeline of five stages over ``documents``.

Texts that the quality rules reject go; of near duplicates (five-word shingles,
similarity of 0.8) one stays; texts with benchmark passages go; secrets are
replaced; what is left is packed into sequences. Each stage works on all that
the one before it kept, and is written before the next reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gaugeflow.llm import decontaminate, jaccard, packing, quality, secrets
from gaugeflow.llm.common import discard, small_batches, table, written


@small_batches
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the rules reject go, null and empty ones among them; see ``quality.keep_good``."""
    return quality.keep_good(docs)


@small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row of least id stays, and so do wordless texts; see ``jaccard.keep_one``."""
    return jaccard.keep_one(docs, size=5, up=80, down=100)


@small_batches
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold a window of an item go, all others stay; see ``decontaminate.remove``."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"), size=10)


@small_batches
def secret_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay, with secrets replaced in ``text``; see ``secrets.redact``."""
    return secrets.redact(docs)


@small_batches
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a document, with its place in a sequence; see ``packing.pack``."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048, markers=True)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("secret scans", secret_strings),
    ("best-fit packing", sequences),
]

#: No SQL expresses the vote model, the randomness tests or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table is deleted once the next one has read it."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(spark, *before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
