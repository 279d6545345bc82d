"""Ingest by pieces: what one request or file gave, read or failed on its own.

A piece (``station_id, code, year, file``: what it is for and where it came
from; any may be null) has ``points`` and, if it couldn't be read, an
``error``. No piece's failure ends the others. ``outcome`` writes readings,
failures and empty pieces in one pass over the pieces; ``ledger`` keeps the
failures that no later run has mended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .formats import OBSERVATIONS, ingest_zip, parse_measurements

KEY = ["station_id", "code", "year", "file"]
PIECE = [*KEY, "points", "error"]
POINTS = "array<struct<ts: timestamp, value: double>>"


def _piece(rows: DataFrame) -> DataFrame:
    have = set(rows.columns)
    kinds = {"code": "string", "year": "int", "file": "string"}
    return rows.select("station_id", *[F.col(c) if c in have else F.lit(None).cast(k).alias(c) for c, k in kinds.items()], "points", "error")


def answers_of(raw: DataFrame) -> DataFrame:
    """Pieces of partner answers (``station_id, code, year, status, body``).

    Status 204 is an empty answer, another one than 200 a failure. A body fails
    if it is missing or isn't the expected JSON, or if it doesn't say that the
    request succeeded: then with the message in it. Observations without a
    readable time or a value are left out."""
    parsed = F.from_json("body", f"{OBSERVATIONS}, _corrupt_record STRING", {"columnNameOfCorruptRecord": "_corrupt_record"})
    rows = raw.withColumn("a", parsed)
    empty = F.col("status") == 204
    error = (
        F.when(empty, None).when(F.col("status") != 200, F.concat(F.lit("status "), F.col("status").cast("string"))).when(F.col("body").isNull(), "no body")
        .when(F.col("a").isNull() | F.col("a._corrupt_record").isNotNull(), "the body can't be read")
        .when(~F.coalesce("a.Succesvol", F.lit(False)), F.coalesce("a.Foutmelding", F.lit("the request failed")))
    )
    each = F.flatten(F.transform(F.coalesce("a.WaarnemingenLijst", F.array().cast("array<struct<MetingenLijst: array<struct<Tijdstip: string, Meetwaarde: struct<Waarde_Numeriek: double>>>>>")), lambda w: F.coalesce(w["MetingenLijst"], F.array().cast("array<struct<Tijdstip: string, Meetwaarde: struct<Waarde_Numeriek: double>>>"))))
    points = F.transform(each, lambda m: F.struct(F.try_to_timestamp(m["Tijdstip"]).alias("ts"), m["Meetwaarde"]["Waarde_Numeriek"].alias("value")))
    read = F.filter(points, lambda p: p["ts"].isNotNull() & p["value"].isNotNull())
    return _piece(rows.withColumn("error", error).withColumn("points", F.when(F.col("error").isNull() & ~F.coalesce(empty, F.lit(False)), read).otherwise(F.array().cast(POINTS))))


def bodies_of(raw: DataFrame) -> DataFrame:
    """Pieces of JSON texts of readings (``station_id, body``, and ``error`` if
    the text couldn't be had), read leniently. A text that isn't a list of
    readings even after its repair is a failure."""
    known = F.col("error") if "error" in raw.columns else F.lit(None).cast("string")
    rows = raw.withColumn("m", parse_measurements(F.col("body"))).withColumn("error", F.coalesce(known, F.when(F.col("m").isNull(), "the body can't be read")))
    points = F.transform("m", lambda m: F.struct(F.try_to_timestamp(m["timestamp"]).alias("ts"), m["value"].alias("value")))
    read = F.filter(points, lambda p: p["ts"].isNotNull() & p["value"].isNotNull())
    return _piece(rows.withColumn("points", F.when(F.col("error").isNull(), read).otherwise(F.array().cast(POINTS))))


def archives_of(files: DataFrame) -> DataFrame:
    """Pieces of ZIP archives (``station_id, path, content``), one JSON entry each; a broken archive is a failure of its file."""
    read = ingest_zip(files).withColumnRenamed("path", "file")
    names = files.select("station_id", F.col("path").alias("file"))
    return bodies_of(read.join(names, "file"))


class Counts:
    """Counters that Spark takes along in the one pass that writes an outcome."""

    def __init__(self):
        self._seen = Observation()

    def on(self, pieces: DataFrame) -> DataFrame:
        failed = F.col("error").isNotNull()
        return pieces.observe(self._seen, F.count(F.lit(1)).alias("pieces"), F.count_if(failed).alias("failed"), F.count_if(~failed & (F.size("points") == 0)).alias("empty"), F.coalesce(F.sum(F.size("points")), F.lit(0)).cast("long").alias("points"))

    def get(self) -> dict[str, int]:
        """Once the pass has run."""
        return self._seen.get


def sorted_out(pieces: DataFrame, path: str, counts: Counts | None = None) -> dict[str, DataFrame]:
    """``outcome``'s ``readings``, ``failures`` and ``empty``, and as ``good`` the
    keys of the pieces that gave readings. The pass over ``pieces`` writes them
    to ``path`` by kind, a piece a row: what asks for keys alone then reads no
    points, and none is laid out with its piece's key beside it."""
    pieces = pieces.select(PIECE) if counts is None else counts.on(pieces.select(PIECE))
    kind = F.when(F.col("error").isNotNull(), "failure").when(F.size("points") > 0, "reading").otherwise("empty")
    rows = pieces.select(*KEY, F.col("points").cast(POINTS).alias("points"), "error", kind.alias("kind"))
    rows.write.partitionBy("kind").parquet(path)
    back = pieces.sparkSession.read.schema(rows.schema).parquet(path)
    of = lambda k: back.where(F.col("kind") == k)
    readings = of("reading").select(*KEY, F.explode("points").alias("p")).select(*KEY, "p.ts", "p.value")
    return {"readings": readings, "failures": of("failure").select(*KEY, "error").distinct(), "empty": of("empty").select(KEY).distinct(), "good": of("reading").select(KEY).distinct()}


def outcome(pieces: DataFrame, path: str, counts: Counts | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Readings (key of the piece, ``ts, value``), failures (key, ``error``)
    and the keys of empty pieces, all from one pass over ``pieces``, which
    writes them to ``path``. Pieces that came twice give their readings
    twice: extremes merge alike."""
    found = sorted_out(pieces, path, counts)
    return found["readings"], found["failures"], found["empty"]


def ledger(before: DataFrame | None, readings: DataFrame, failures: DataFrame, empty: DataFrame) -> DataFrame:
    """Open failures (key, ``error, attempts``) after a run: those before it
    whose pieces it has not mended (by readings, or by an empty answer), with
    one more attempt and the newest message where it failed again, and its own
    new ones. A run repeated with the same pieces only counts attempts. Of the
    readings only the keys are looked at: those of their pieces serve as well."""
    now = failures.groupBy(KEY).agg(F.min("error").alias("error"))
    if before is None:
        return now.withColumn("attempts", F.lit(1).cast("long"))
    names = {c: f"n_{c}" for c in KEY}
    fresh = now.withColumnsRenamed(names).withColumnRenamed("error", "n_error")
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    mended = readings.select(KEY).unionByName(empty.select(KEY)).distinct().withColumnsRenamed(names)
    both = before.join(mended, same, "left_anti").join(fresh, same, "full")
    out = [F.coalesce(F.col(n), F.col(c)).alias(c) for c, n in names.items()]
    return both.select(*out, F.coalesce("n_error", "error").alias("error"), (F.coalesce("attempts", F.lit(0)) + F.when(F.col("n_error").isNotNull(), 1).otherwise(0)).cast("long").alias("attempts"))
