"""Readers and shapes of the input formats, and their export."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import fold_name, plausible
from ..operators.river import resolve_names
from .scratch import once

CATALOGUE = """uuid STRING, shortname STRING, km DOUBLE, latitude DOUBLE, longitude DOUBLE, water STRUCT<shortname: STRING>,
 timeseries ARRAY<STRUCT<shortname: STRING, unit: STRING, gaugeZero: STRUCT<value: DOUBLE>,
 currentMeasurement: STRUCT<timestamp: STRING, value: DOUBLE, stateMnwMhw: STRING>,
 characteristicValues: ARRAY<STRUCT<shortname: STRING, value: DOUBLE, unit: STRING, occurrences: ARRAY<STRING>, timespanEnd: STRING>>>>"""
OBSERVATIONS = "Succesvol BOOLEAN, Foutmelding STRING, WaarnemingenLijst ARRAY<STRUCT<MetingenLijst: ARRAY<STRUCT<Tijdstip: STRING, Meetwaarde: STRUCT<Waarde_Numeriek: DOUBLE>>>>>"
MEASUREMENTS = "array<struct<timestamp: string, value: double>>"


def read_catalogue(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The catalogue's stations: a JSON array a file, or with ``lines`` one a line."""
    return spark.read.schema(CATALOGUE).option("multiLine", not lines).json(path)


def _series(name: str) -> Column:
    return F.get(F.filter("timeseries", lambda s: s["shortname"] == name), F.lit(0))


def stations_of(catalogue: DataFrame) -> DataFrame:
    """Stations that have a ``W`` series: value null if not finite, missing
    water an empty name."""
    w = catalogue.withColumn("s", _series("W")).where("s is not null")
    value = F.col("s.currentMeasurement.value")
    return w.select("uuid", F.coalesce("shortname", F.lit("")).alias("n"), F.coalesce("water.shortname", F.lit("")).alias("w"), F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value).alias("value"), F.col("s.currentMeasurement.stateMnwMhw").alias("state"), "km", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


def units_of(catalogue: DataFrame) -> DataFrame:
    """Unit of each station's ``W`` series; stations without one drop."""
    return catalogue.withColumn("s", _series("W")).where("s is not null").select(F.col("uuid").alias("station_id"), F.col("s.unit").alias("unit"))


def marks_of(catalogue: DataFrame) -> DataFrame:
    """Whether a station is tidal by its marks, and its mean low and high water."""
    w = catalogue.withColumn("cv", F.coalesce(_series("W")["characteristicValues"], F.expr("array()")))

    def mark(name: str) -> Column:
        return F.get(F.filter("cv", lambda x: x["shortname"] == name), F.lit(0))["value"]

    return w.select(F.col("uuid").alias("station_id"), F.exists("cv", lambda x: x["shortname"] == "MThw").alias("tidal"), mark("MNW").alias("mnw"), mark("MHW").alias("mhw"))


def repair_json(text: Column) -> Column:
    """A bare ``-`` value becomes null and ``-.87`` becomes ``-0.87``."""
    return F.regexp_replace(F.regexp_replace(text, r"(:\s*)-(\s*[,}\]])", "$1null$2"), r"([:\[,]\s*-?)\.(\d)", "$10.$2")


def parse_measurements(text: Column) -> Column:
    """Readings of a JSON text; repaired only if it can't be read as it is."""
    strict = F.from_json(text, MEASUREMENTS)
    return F.coalesce(strict, F.from_json(repair_json(text), MEASUREMENTS))


def measurements_of(raw: DataFrame) -> DataFrame:
    """Readings of rows (``station_id, body``) of JSON text."""
    rows = raw.select("station_id", F.explode(parse_measurements(F.col("body"))).alias("m"))
    return rows.select("station_id", F.try_to_timestamp(F.col("m.timestamp")).alias("ts"), F.col("m.value").alias("value")).where("ts is not null and value is not null")


def read_measurements(spark: SparkSession, path: str, stream: bool = False, named: bool = False) -> DataFrame:
    """Readings of a folder of JSON arrays, one a line, in a subfolder a station
    (``station_id=...``) or, with ``named``, after the line's station and a tab,
    so that few files hold many stations; as a stream, with ``stream``, files as
    they come."""
    source = spark.readStream if stream else spark.read
    if named:
        line, tab = F.col("value"), F.instr("value", "\t")
        raw = source.text(path).where(tab > 0)
        return measurements_of(raw.select(F.substring(line, F.lit(1), tab - 1).alias("station_id"), F.substring(line, tab + 1, F.length(line)).alias("body")))
    raw = source.schema("value STRING, station_id STRING").text(path)
    return measurements_of(raw.select("station_id", F.col("value").alias("body")))


def ingest_zip(files: DataFrame) -> DataFrame:
    """``path, entry, body, error`` of archives (``path, content``) with one JSON
    entry each. A bad archive gets an error and no body; the job goes on."""

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        name = next(n for n in z.namelist() if n.endswith(".json"))
                        rows.append((path, name, z.read(name).decode(), None))
                except (zipfile.BadZipFile, StopIteration, UnicodeDecodeError, RuntimeError, NotImplementedError, EOFError) as e:
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "entry", "body", "error"])

    return files.select("path", "content").mapInPandas(unzip, "path string, entry string, body string, error string")


def station_from_file_name(path: Column) -> Column:
    """The folded station part of ``...-name-W-2024....json``."""
    return fold_name(F.regexp_extract(path, r"([^/\-]+)-W-\d{4}", 1), False)


def with_station(files: DataFrame, names: DataFrame, fallback: str | None = None, by: str = "entry") -> DataFrame:
    """``files`` with the ``station`` that the name in column ``by`` means, in
    either fold; ``fallback`` where it means none. Files are computed once,
    into a table of which the look-up reads the names alone."""
    named = once(files.withColumn("q", station_from_file_name(F.col(by))), "named")
    known = resolve_names(named.where("q <> ''").select("q").distinct(), names)
    return named.join(known, "q", "left").withColumn("station", F.coalesce("name", F.lit(fallback).cast("string"))).drop("q", "name")


def flatten_observations(raw: DataFrame) -> DataFrame:
    """Readings of partner answers (``station_id`` beside the answer's fields);
    a failed answer raises its message, an empty one has no rows."""
    failed = F.raise_error(F.coalesce("Foutmelding", F.lit("the request failed")))
    lists = F.when(F.coalesce("Succesvol", F.lit(True)), F.col("WaarnemingenLijst")).otherwise(failed)
    rows = raw.select("station_id", F.explode(lists).alias("l")).select("station_id", F.explode("l.MetingenLijst").alias("m"))
    return rows.select("station_id", F.try_to_timestamp(F.col("m.Tijdstip")).alias("ts"), F.col("m.Meetwaarde.Waarde_Numeriek").alias("value"))


def explode_bundle(bundles: DataFrame) -> DataFrame:
    """Rows of bundles (``station_id, y, min, max``): days with both extremes.
    Short or missing arrays give fewer rows, a null year none."""
    rows = bundles.where("y is not null").select("station_id", "y", F.posexplode(F.arrays_zip("min", "max")))
    out = rows.where("col.min is not null and col.max is not null").select("station_id", F.col("y").cast("int").alias("year"), F.col("pos").alias("doy"), F.col("col.min").alias("min_v"), F.col("col.max").alias("max_v"))
    return out.select("station_id", "year", "doy", F.date_add(F.make_date("year", F.lit(1), F.lit(1)), F.col("doy")).alias("day"), "min_v", "max_v")


def to_bundle(daily: DataFrame) -> DataFrame:
    """Dense arrays a station and year; a year's days are at most 366."""
    by_year = daily.groupBy("station_id", F.col("year").alias("y")).agg(F.map_from_entries(F.collect_list(F.struct("doy", F.struct("min_v", "max_v")))).alias("m"))
    days = F.sequence(F.lit(0), F.dayofyear(F.make_date("y", F.lit(12), F.lit(31))) - 1)

    def dense(field: str) -> Column:
        return F.transform(days, lambda i: F.try_element_at("m", i)[field])

    return by_year.select("station_id", "y", dense("min_v").alias("min"), dense("max_v").alias("max"))


SHARD = "map<string,struct<n:string,w:string,t:int,v:array<double>>>"


def to_shards(snapshot: DataFrame, shares: int = 64) -> DataFrame:
    """Month shards of snapshots (``station_id, n, w, day, value, tidal``): the
    stations of a month with an array of its days, in ``shares`` rows by the
    hash of the station, so that none holds all."""
    month = snapshot.groupBy("station_id", F.year("day").alias("y"), F.month("day").alias("m")).agg(
        F.max_by("n", "day").alias("n"), F.max_by("w", "day").alias("w"), F.max(F.col("tidal").cast("int")).alias("t"), F.map_from_entries(F.collect_list(F.struct(F.day("day"), "value"))).alias("d"),
    )
    days = F.sequence(F.lit(1), F.day(F.last_day(F.make_date("y", "m", F.lit(1)))))
    one = F.struct("n", "w", "t", F.transform(days, lambda i: F.try_element_at("d", i)).alias("v"))
    rows = month.select("y", "m", F.pmod(F.xxhash64("station_id"), F.lit(shares)).alias("share"), F.struct(F.col("station_id").cast("string"), one).alias("s"))
    return rows.groupBy("y", "m", "share").agg(F.map_from_entries(F.collect_list("s")).cast(SHARD).alias("stations"))


def explode_shard(shards: DataFrame, year: int) -> DataFrame:
    """Rows of month shards (``y, m, stations``); shards of other years are
    ignored."""
    rows = shards.where(F.col("y") == year).select("y", "m", F.explode("stations").alias("station_id", "s"))
    return rows.select("station_id", "s.n", "s.w", F.coalesce(F.col("s.t") == 1, F.lit(False)).alias("tidal"), F.posexplode("s.v").alias("pos", "value"), "y", "m").select("station_id", "n", "w", F.date_add(F.make_date("y", "m", F.lit(1)), F.col("pos")).alias("day"), "value", "tidal")


def import_points(text: DataFrame, existing: DataFrame) -> DataFrame:
    """New valid points of archives (``body``: station -> [[ms, value], ...])
    that ``existing`` lacks. Names are upper-cased; what isn't a list of pairs
    gives nothing."""
    rows = text.select(F.explode(F.from_json("body", "map<string,array<array<double>>>")).alias("k", "ps")).select(F.upper("k").alias("station_id"), F.explode("ps").alias("p"))
    fine = rows.where((F.size("p") == 2) & F.get("p", F.lit(0)).isNotNull() & plausible(F.get("p", F.lit(1)), -1e12, 1e12))
    new = fine.select("station_id", F.timestamp_millis(F.get("p", F.lit(0)).cast("long")).alias("ts"), F.get("p", F.lit(1)).alias("value")).dropDuplicates(["station_id", "ts"])
    return new.join(existing, ["station_id", "ts"], "left_anti")


def export_points(points: DataFrame) -> DataFrame:
    """JSON texts of a station's points by time, one a calendar year: readers
    of the format take a station's texts together, and none grows with the
    archive's age."""
    one = points.groupBy("station_id", F.year("ts").alias("y")).agg(F.sort_array(F.collect_list(F.array(F.unix_millis(F.col("ts").cast("timestamp")).cast("double"), F.col("value")))).alias("ps"))
    return one.select("station_id", F.to_json(F.create_map("station_id", "ps")).alias("body"))
