"""Token totals kept by signed deltas.

Events insert, delete or revise a document's count under a tokenizer version.
A batch of events becomes additive deltas by source, language and version,
which are added to the totals. A rollup's folder holds numbered states: the
totals, and the ids of the batches in them. A state counts from the moment its
list of ids is there, which is one file and so appears at once; a commit that
breaks off before leaves the state before it in force. A batch whose id is
listed changes nothing when it comes again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.sources.scratch import remove

from .common import need
from .encoding import encode

KEYS = ["source", "lang", "tokenizer"]
_TOTALS = "source string, lang string, tokenizer string, docs long, tokens long"


def count_tokens(docs: DataFrame, text: str, tokenizers: dict[str, str], markers: bool = True) -> DataFrame:
    """``docs`` with a column ``n_<version>`` for each tokenizer: the number of
    ids that the file gives for the whole of the column ``text``, null for a
    null text. Columns of any other name stay as they are."""

    def counter(path: str):
        @F.pandas_udf("long")
        def count(texts: pd.Series) -> pd.Series:
            ids = encode(texts.tolist(), path, markers)
            return pd.Series([None if t is None else len(x) for t, x in zip(texts.tolist(), ids, strict=True)], dtype="Int64")

        return count

    return docs.withColumns({f"n_{version}": counter(path)(F.col(f"`{text}`")) for version, path in sorted(tokenizers.items())})


def deltas(events: DataFrame) -> DataFrame:
    """``source, lang, tokenizer, docs, tokens`` of ``events`` (``source, lang,
    tokenizer, kind, n_tokens, was_tokens``).

    ``insert`` adds a document and its tokens, ``delete`` takes away a document
    and ``was_tokens``, ``revise`` adds ``n_tokens - was_tokens``. Null counts
    are 0, null keys form groups of their own, an unknown kind fails; other
    columns are ignored. Summing before the shuffle leaves a row a key and
    task, however large one source is.
    """
    events = need(events, *KEYS, "kind", "n_tokens", "was_tokens")
    kind, now, was = F.col("kind"), F.coalesce("n_tokens", F.lit(0)), F.coalesce("was_tokens", F.lit(0))
    unknown = F.raise_error(F.concat(F.lit("not a kind of event: "), F.coalesce(kind, F.lit("null"))))
    docs = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(unknown.cast("int"))
    tokens = F.when(kind == "insert", now).when(kind == "delete", -was).otherwise(now - was)
    return events.groupBy(*KEYS).agg(F.sum(docs.cast("long")).alias("docs"), F.sum(tokens).cast("long").alias("tokens"))


def _state(spark: SparkSession, folder: str) -> tuple[int, DataFrame, DataFrame]:
    """Number, totals and batch ids of the state in force; 0 and empty ones before the first commit."""
    try:
        ids = spark.read.schema("batch string, state int").parquet(f"{folder}/batches")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, spark.createDataFrame([], _TOTALS), spark.createDataFrame([], "batch string")
    at = ids.agg(F.max("state").alias("n")).first()["n"]
    return at, spark.read.schema(_TOTALS).parquet(f"{folder}/totals/state={at}"), ids.where(F.col("state") == at).select("batch")


def commit(folder: str, batch_id: str, events: DataFrame) -> bool:
    """Add a batch to the totals; False, and nothing done, if ``batch_id`` is
    in them already. Ids are any strings. One writer a folder at a time.

    A state is as large as its keys and batch ids; those before the last two
    are deleted, so that a reader of the one just replaced can end."""
    spark = events.sparkSession
    at, totals_, batches = _state(spark, folder)
    if batches.where(F.col("batch") == batch_id).limit(1).count():
        return False
    both = totals_.unionByName(deltas(events)).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    both.write.mode("overwrite").parquet(f"{folder}/totals/state={at + 1}")
    ids = batches.unionByName(spark.createDataFrame([(batch_id,)], "batch string"))
    ids.coalesce(1).write.mode("overwrite").parquet(f"{folder}/batches/state={at + 1}")
    if at > 1:
        remove(spark, f"{folder}/batches/state={at - 1}", f"{folder}/totals/state={at - 1}")
    return True


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """The totals in force: ``source, lang, tokenizer, docs, tokens``; keys whose
    documents are all gone are left out, and a folder without commits has none."""
    return _state(spark, folder)[1].where("docs <> 0 or tokens <> 0")


def committed(spark: SparkSession, folder: str) -> Iterator[str]:
    """The ids of the batches in the totals, sorted."""
    return (r["batch"] for r in _state(spark, folder)[2].orderBy("batch").toLocalIterator())
