"""Ranks over rows of any number: no task sorts a whole group, and none the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import new_path, once


def numbered(rows: DataFrame, order: list[Column | str], group: list[str] | None = None, at: str | None = None, parts: int = 0, few: bool = False) -> DataFrame:
    """``rows`` with ``rank``, from 0, in the given order, and ``group_rows``; within ``group``, if there is one.

    Rows are dealt out by ranges of (group, order), so that a group of any size
    lies in as many tasks as its rows ask for. A row's place in its range,
    with the rows of the ranges before it, is its rank among all; less the
    least rank of its group, its rank there. Per range and group only a count and a place are
    gathered. The ordered rows lie at ``at``, or else in the shared folder. Rows that tie take ranks in any order. Null groups are groups.
    There are ``parts`` ranges, or as many as the session has shuffle partitions. With ``few`` the groups are few
    enough to go to all tasks, so that the rows aren't shuffled once more by group.
    """
    spark, group = rows.sparkSession, list(group or [])
    keys = [*(F.col(g).asc_nulls_first() for g in group), *(F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in order)]
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__range", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    path = at or new_path(spark, "ordered")
    laid.write.parquet(path)
    laid = spark.read.schema(laid.schema).parquet(path)
    # As many rows as there are ranges and groups: a group that goes on in the next range has one there too.
    held = once(laid.groupBy("__range", *group).agg(F.count("*").alias("n"), F.min("__at").alias("at")), "ranges")
    counts = held.groupBy("__range").agg(F.sum("n").alias("n"))
    before = counts.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("__before"))
    placed = laid.join(before, "__range").withColumn("rank", F.col("__at") + F.col("__before")).drop("__range", "__at", "__before")
    if not group:
        return placed.crossJoin(counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("group_rows")))
    firsts = held.join(before, "__range").groupBy(*group).agg(F.min(F.col("at") + F.col("__before")).alias("__first"), F.sum("n").alias("group_rows")).withColumnsRenamed({g: f"__g_{g}" for g in group})
    same = [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in group]
    joined = placed.join(F.broadcast(firsts) if few else firsts, same)
    return joined.withColumn("rank", F.col("rank") - F.col("__first")).drop("__first", *[f"__g_{g}" for g in group])
