"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import wraps
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.sources.scratch import new_path, remove, shared_dir

__all__ = ["Kept", "discard", "hot_keys", "join_hot", "need", "new_path", "shared_dir", "small_batches", "table", "tidy", "written"]

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Hand memory that is free within this process back to the system, where the C library can."""
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(each: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``each`` of a task's batches; at its end the worker gives back what it took, before it waits for the next task."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from each(batches)
        finally:
            give_back()

    return run


class Kept:
    """What a Python worker makes once and uses for many batches and tasks.

    It is dropped when it hasn't been used for some seconds: Spark keeps idle
    workers, and beside the next stage's they would hold memory for nothing.
    At most ``most`` objects are held; another one drops them first.
    """

    def __init__(self, make: Callable[..., Any], most: int = 4, seconds: float = 4.0):
        self.make, self.most, self.seconds = make, most, seconds
        self.held: dict[tuple, Any] = {}
        self.lock, self.used, self.watched = threading.Lock(), 0.0, False

    @contextmanager
    def use(self, *key) -> Iterator[Any]:
        with self.lock:
            if key not in self.held:
                if len(self.held) >= self.most:
                    self.held.clear()
                self.held[key] = self.make(*key)
            if not self.watched:
                self.watched = True
                threading.Thread(target=self._watch, daemon=True).start()
            try:
                yield self.held[key]
            finally:
                self.used = time.monotonic()

    def _watch(self) -> None:
        while True:
            time.sleep(self.seconds)
            with self.lock:
                if time.monotonic() - self.used >= self.seconds:
                    self.held.clear()
                    self.watched = False
                    give_back()
                    return


@contextmanager
def _small_batches(spark: SparkSession, rows: int = 1000):
    """Python gets fewer rows at once than by default, as texts are long; the session's own setting comes back."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def small_batches(job: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``job(spark, ...)`` in a session that sends few rows at once to Python.

    For the jobs of an application, which own their session: what they return
    is computed after they have returned. Operators leave it as it is."""

    @wraps(job)
    def run(spark: SparkSession, *args) -> DataFrame:
        spark.conf.set(_BATCH, "1000")
        return job(spark, *args)

    return run


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: it cuts the lineage, and losing
    an executor costs only the tasks that ran there.

    What an operator returns may read such a table, so the last ones of a run
    stay, in the application's own folder below ``spark.checkpoint.dir``."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with _small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once nothing reads them any more,
    and let Spark's cleaner drop the shuffle files of steps that are done: it
    does so when the driver's objects of these steps are collected, which a
    driver with free memory puts off."""
    remove(spark, *(t.written_at for t in tables))
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def need(df: DataFrame, *cols: str) -> DataFrame:
    """Just ``cols``, so that other columns of any name can't clash."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def hot_keys(rows: DataFrame, key: str, parts: int = 5000, least: int = 1000) -> DataFrame | None:
    """Keys that have more than one in ``parts`` of all rows, and more than
    ``least``: so fewer than ``parts`` of them, whatever the input. None if no
    key does. ``rows`` is read twice, so it should be a written table."""
    most = max(rows.count() / parts, least)
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most)
    found = [(r[0],) for r in counts.select(key).collect()]
    return rows.sparkSession.createDataFrame(found, rows.select(key).schema) if found else None


def join_hot(rows: DataFrame, other: DataFrame, key: str, by: Column, hot: DataFrame | None, how: str = "left") -> DataFrame:
    """``rows`` joined with ``other`` where the keys in ``hot`` (of
    ``hot_keys``) have very many of ``rows``.

    Their rows are dealt out by the hash of ``by``, and their rows of ``other``
    are repeated for each share; no other key has more rows than a task can
    hold. Only the bounded list ``hot`` is broadcast. Rows with a null key join
    nothing, and in a left join stay where they are.
    """
    shares = 64
    there = rows.where(F.col(key).isNotNull())
    if hot is None:
        joined = there.join(other, key, how)
    else:
        hot = F.broadcast(hot.withColumn("__hot", F.lit(True)))
        share = F.when(F.col("__hot"), F.pmod(F.xxhash64(by), F.lit(shares))).otherwise(0).cast("int")
        all_ = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(shares - 1))).otherwise(F.array(F.lit(0)))
        left = there.join(hot, key, "left").withColumn("__share", share).drop("__hot")
        right = other.join(hot, key, "left").withColumn("__share", F.explode(all_)).drop("__hot")
        joined = left.join(right, [key, "__share"], how).drop("__share")
    return joined.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True) if how == "left" else joined
