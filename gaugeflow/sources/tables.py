"""Tables on disk: upserts that rewrite only touched partitions, guards, and
compaction of small files. Each change is one new state (see ``states``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.daily import KEY, drop_empty_years, merge_extremes
from ..operators.inventory import apply_snapshot, expired
from . import states
from .scratch import exists, new_path


def read_or_none(spark: SparkSession, path: str, table: str = "") -> DataFrame | None:
    """The table (of several in a folder, that of the name) in its newest
    state, or as Spark alone wrote it; None if there is none yet. Any other
    failure is raised, so an unreadable table is never started anew."""
    if (found := states.read(spark, path, table)) is not None:
        return found
    at = f"{path}/{table}" if table else path
    return spark.read.parquet(at) if exists(spark, at) else None


def read_table(spark: SparkSession, path: str, table: str = "") -> DataFrame:
    """As ``read_or_none``, but a missing table fails."""
    if (found := read_or_none(spark, path, table)) is None:
        raise FileNotFoundError(f"there is no table {table} at {path}")
    return found


_ORDER = ("station_id", "river", "doy", "month", "day")


def order_of(df: DataFrame, by: str | None) -> list[str]:
    """The columns that order the rows of a partition of ``by``."""
    return [c for c in _ORDER if c in df.columns and c != by]


def replace_partitions(df: DataFrame, path: str, by: str, file_rows: int = states.FILE_ROWS) -> None:
    """Overwrite the partitions that ``df`` has rows of, and no others, at
    once. ``df`` may read ``path`` itself."""
    states.commit(df.sparkSession, path, {"": df}, {"": by}, {"": order_of(df, by)}, file_rows=file_rows)


def upsert_daily(spark: SparkSession, path: str, fresh: DataFrame) -> None:
    """Merge fresh daily extremes into the table partitioned by year. Only years
    that ``fresh`` has are read and rewritten; station-years without a reading
    are skipped."""
    with states.aside(fresh.select(*KEY, "min_v", "max_v")) as fresh:
        if not fresh.where("min_v is null").isEmpty():  # only then a station-year can be without a reading
            fresh = drop_empty_years(fresh)
        old = read_or_none(spark, path)
        if old is not None:
            years = [r["year"] for r in fresh.select("year").distinct().collect()]
            fresh = merge_extremes(old.where(F.col("year").isin(years)).select(*KEY, "min_v", "max_v"), fresh)
        replace_partitions(fresh, path, "year")


def write_snapshot(spark: SparkSession, path: str, capture: DataFrame) -> None:
    """Put a capture into the table partitioned by month (``month`` as yyyy-MM).
    A table that can't be read, has another shape, or has days in a month's
    partition that aren't the month's, fails and stays as it is."""
    with states.aside(capture.select("station_id", "n", "w", "day", "value", "tidal")) as capture:
        old = read_or_none(spark, path)
        rows = capture
        if old is not None:
            if missing := {"station_id", "n", "w", "day", "value", "tidal", "month"} - set(old.columns):
                raise ValueError(f"the snapshot table lacks {sorted(missing)}")
            months = [r[0] for r in capture.select(F.date_format("day", "yyyy-MM")).distinct().collect()]
            old = old.withColumn("month", F.col("month").cast("string")).where(F.col("month").isin(months))
            if odd := old.where(~F.date_format("day", "yyyy-MM").eqNullSafe(F.col("month"))).first():
                raise ValueError(f"the snapshot of {odd['month']} has a day {odd['day']}")
            rows = apply_snapshot(old.drop("month"), capture)
        replace_partitions(rows.withColumn("month", F.date_format("day", "yyyy-MM")), path, "month")


def prune_snapshot(spark: SparkSession, path: str, reference: str, most_months: int) -> list[str]:
    """Drop the months of a snapshot table that ``expired`` names, and return
    them. Whole partitions leave the state; no row is read or rewritten."""
    state = states.current(spark, path)
    months = sorted(state["tables"][""]["parts"]) if state else []
    known = spark.createDataFrame([(m, *map(int, m.split("-"))) for m in months], "month string, y int, m int")
    gone = sorted(r["month"] for r in expired(known, reference, most_months).collect())
    if gone:
        states.commit(spark, path, {}, {"": "month"}, drop={"": gone})
    return gone


def overview(monthly: DataFrame) -> DataFrame:
    """One row a river: ``from_year`` (the least of all rivers) and from then on
    all months' ``v`` and ``diff`` as arrays, null where there is none. Rivers
    and years are few."""
    span = monthly.agg(F.min("year").alias("from_year"), F.max("year").alias("to_year"))
    months = F.transform(F.sequence(F.lit(0), (F.col("to_year") - F.col("from_year") + 1) * 12 - 1), lambda i: F.struct((F.col("from_year") + F.floor(i / 12)).cast("int").alias("y"), (i % 12 + 1).cast("int").alias("m")))
    key, cell = F.struct(F.col("year").cast("int").alias("y"), F.col("month").cast("int").alias("m")), F.struct("v", "diff")
    cells = monthly.groupBy("river").agg(F.map_from_entries(F.collect_list(F.struct(key, cell))).alias("cells")).crossJoin(F.broadcast(span))
    row = F.transform(months, lambda k: F.try_element_at("cells", k))
    return cells.select("river", "from_year", row.alias("row")).select("river", "from_year", F.col("row.v").alias("v"), F.col("row.diff").alias("diff"))


def rebuild_totals(daily: DataFrame, monthly: DataFrame, path: str, units: DataFrame | None = None) -> None:
    """All years' totals, their overview, and the units beside them, as one new
    state: readers have either all old tables or all new ones. The same input
    gives the same files."""
    with states.aside(monthly) as monthly:
        tables = {"daily": daily, "monthly": monthly, "overview": overview(monthly)}
        if units is not None:
            tables["units"] = units.select("station_id", "unit")
        _commit_totals(daily.sparkSession, path, tables, replace=True)


def _commit_totals(spark: SparkSession, path: str, tables: dict[str, DataFrame], replace: bool = False) -> None:
    by = {"daily": "year", "monthly": "year"}
    states.commit(spark, path, tables, by, {n: order_of(df, by.get(n)) for n, df in tables.items()}, replace)


def append_totals(spark: SparkSession, daily: DataFrame, monthly: DataFrame, path: str, year: int, rivers: DataFrame | None = None) -> bool:
    """Rewrite one year's totals and the overview, as one new state. Without a
    table all years are built, and False is returned.

    ``daily`` and ``monthly`` are frames of all years; of these, only the year
    is computed where there is a table. Cells that the old partition has and
    the new frame lacks are written as nulls: a reader sees that they were
    there. A table from before there was ``diff`` gets it, as nulls in other
    years. ``rivers`` (``river``) have all the year's months too, though the
    table and the frames may lack them."""
    if (old := read_or_none(spark, path, "monthly")) is None:
        rebuild_totals(daily, monthly, path)
        return False
    known = old.select("river").union(monthly.where(F.col("year") == year).select("river"))
    months = (known if rivers is None else known.union(rivers.select("river"))).distinct().select("river", F.lit(year).alias("year"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    grid = months.join(monthly.where(F.col("year") == year), ["river", "year", "month"], "left")
    if "diff" not in old.columns:
        old = old.withColumn("diff", F.lit(None).cast(dict(grid.dtypes)["diff"]))
    stale = read_or_none(spark, path, "daily").where(F.col("year") == year).select("river", "year", "doy")
    new = daily.where(F.col("year") == year)
    cells = stale.unionByName(new.select("river", "year", "doy")).distinct().join(new, ["river", "year", "doy"], "left")
    with states.aside(grid) as grid:
        whole = old.where(F.col("year") != year).select(grid.columns).unionByName(grid)
        _commit_totals(spark, path, {"daily": cells, "monthly": grid, "overview": overview(whole)})
    return True


def compact_years(spark: SparkSession, path: str, out: str, schema: str = "station_id STRING, y INT, min ARRAY<DOUBLE>, max ARRAY<DOUBLE>", lines: bool = False, named: bool = False) -> DataFrame:
    """Fold per-year JSON files into one sorted bundle table; a station with a
    malformed file is left out whole. Returns ``station_id, file, ok``; inputs
    stay where they are. The station is the file's folder, its name or
    ``station_id=`` and its name. With ``lines`` a file has a year a line.
    With ``named`` the year comes after the line's station and a tab, so that
    few files hold many stations: a malformed line spoils its station alone,
    and so does one without a tab, whose station is all of the line."""
    if named:
        line, tab = F.col("value"), F.instr("value", "\t")
        rows = spark.read.option("recursiveFileLookup", True).text(path).where(F.trim("value") != "").withColumn("file", F.input_file_name())
        text = F.when(tab > 0, F.substring(line, tab + 1, F.length(line))).otherwise("")
        parsed = F.from_json(text, schema + ", _corrupt_record STRING", {"columnNameOfCorruptRecord": "_corrupt_record"})
        raw = rows.select("file", F.when(tab > 0, F.substring(line, F.lit(1), tab - 1)).otherwise(line).alias("folder"), parsed.alias("j")).select("file", "folder", "j.*")
    else:
        raw = spark.read.schema(schema + ", _corrupt_record STRING").option("multiLine", not lines).option("recursiveFileLookup", True).json(path)
        raw = raw.withColumn("file", F.input_file_name()).withColumn("folder", F.regexp_replace(F.element_at(F.split("file", "/"), -2), "^station_id=", ""))
    report = new_path(spark, "compacted")
    with states.aside(raw.withColumn("ok", F.col("_corrupt_record").isNull() & F.col("y").isNotNull())) as copy:
        bad = copy.where("not ok").select("folder").distinct()
        fine = copy.join(bad, "folder", "left_anti").select(F.col("folder").alias("station_id"), "y", "min", "max")
        fine.repartition("station_id").sortWithinPartitions("station_id", "y").write.mode("overwrite").parquet(out)
        copy.groupBy(F.col("folder").alias("station_id"), "file").agg(F.min("ok").alias("ok")).write.parquet(report)
    return spark.read.parquet(report)
