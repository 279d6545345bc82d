"""Stations along a river, names, and positions near its axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import fold_name, state


def river_profile(stations: DataFrame) -> DataFrame:
    """Elevation of the water: gauge zero plus W / 100, by km. Stations without
    km or W drop, and those without elevation unless their state is flagged."""
    s = stations.withColumn("state", state(F.col("state"))).where("km is not null and w is not null")
    return s.withColumn("elevation", F.col("gauge_zero") + F.col("w") / 100).where("elevation is not null or state <> 'normal'").orderBy("river", "km", "station_id")


def condition_flags(latest: DataFrame) -> DataFrame:
    """Independent flags from W, its marks, trend an hour and water temperature."""
    no = F.lit(False)
    return latest.select(
        "station_id", F.coalesce(F.col("w") < F.col("mnw"), no).alias("drought"), F.coalesce(F.col("w") > F.col("mhw"), no).alias("flood"),
        F.coalesce(F.col("trend") >= 2, no).alias("fast_rising"), F.coalesce(F.col("water_temp") <= 0.5, no).alias("frozen"),
    )


def trouble_list(flags: DataFrame, shown: int = 8) -> DataFrame:
    """Flagged stations, the first few by id, and how many more there are."""
    marked = flags.where("drought or flood or fast_rising or frozen")
    total = marked.agg(F.count("*").alias("total"))
    first = marked.orderBy("station_id").limit(shown)
    return first.crossJoin(F.broadcast(total)).withColumn("more", F.greatest(F.lit(0), F.col("total") - shown)).drop("total")


def neighbours(stations: DataFrame) -> DataFrame:
    """Each station with the next one down the river's km, and the slope of the
    water surface between them (m a km)."""
    own = Window.partitionBy("river").orderBy("km", "station_id")
    nxt = stations.where("km is not null").select("river", "station_id", "km", "elevation", F.lead("station_id").over(own).alias("next_id"), F.lead("km").over(own).alias("next_km"), F.lead("elevation").over(own).alias("next_elevation"))
    gap = F.nullif(F.col("next_km") - F.col("km"), F.lit(0.0))
    return nxt.where("next_id is not null").select("river", "station_id", "next_id", (F.col("next_km") - F.col("km")).alias("distance"), ((F.col("next_elevation") - F.col("elevation")) / gap).alias("slope"))


def rivers_overview(stations: DataFrame) -> DataFrame:
    """Gauges of a river, and the centroid of those with a place."""
    there = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return stations.groupBy("river").agg(F.count("*").alias("n"), F.avg(F.when(there, F.col("lat"))).alias("lat"), F.avg(F.when(there, F.col("lon"))).alias("lon"))


def scaled(cells: DataFrame) -> DataFrame:
    """Values of a station (``station_id, day, value``) on its own range; a flat
    station sits in the middle, gaps stay null."""
    own = Window.partitionBy("station_id")
    low, high = F.min("value").over(own), F.max("value").over(own)
    return cells.withColumn("scaled", F.when(F.col("value").isNotNull(), F.coalesce((F.col("value") - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.5))))


def leading_crop(cells: DataFrame, share: float = 0.5) -> DataFrame:
    """First day (0-based from the least) on which ``share`` of the stations or
    more, half if not given, have data; 0 if there is none."""
    rows = cells.agg(F.count_distinct("station_id").alias("stations"), F.min("day").alias("day0"))
    days = cells.groupBy("day").agg(F.count("value").alias("n")).crossJoin(F.broadcast(rows)).where(F.col("n") >= share * F.col("stations"))
    return days.agg(F.coalesce(F.min(F.date_diff("day", "day0")), F.lit(0)).alias("first"))


def window_days(mids: DataFrame, first: str, n: int) -> DataFrame:
    """Daily mids laid into ``n`` days from ``first``, over year boundaries, with
    nulls for gaps."""
    days = mids.select("station_id").distinct().select("station_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).withColumn("day", F.date_add(F.lit(first).cast("date"), F.col("i")))
    return days.join(mids.select("station_id", "day", F.col("mid").alias("value")), ["station_id", "day"], "left")


def sample_stations(stations: DataFrame, most: int = 24) -> DataFrame:
    """At most ``most`` stations a river, evenly by km rank, with the total."""
    own = Window.partitionBy("river")
    ranked = stations.withColumn("i", F.row_number().over(own.orderBy(F.col("km").asc_nulls_last(), "station_id")) - 1).withColumn("total", F.count("*").over(own))
    slot = F.floor(F.col("i") * most / F.col("total"))
    before = F.floor((F.col("i") - 1) * most / F.col("total"))
    return ranked.where((F.col("total") <= most) | (F.col("i") == 0) | (slot != before)).drop("i")


def record_years(marks: DataFrame) -> DataFrame:
    """Per mark (``station_id, shortname, value, occurrences, timespan_end``)
    the year of its newest occurrence, or else the end of its time span."""
    newest = F.year(F.array_max(F.transform("occurrences", lambda x: F.to_date(F.substring(x, 1, 10)))))
    return marks.select("station_id", "shortname", "value", F.coalesce(newest, F.year(F.to_date(F.substring("timespan_end", 1, 10)))).alias("record_year"))


def resolve_names(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Per query (``q``) the known name: an exact match, else of either fold,
    umlauts as pairs first; null if unknown."""
    def variants(df: DataFrame, col: str) -> DataFrame:
        folds = [(F.upper(F.col(col)), 0), (fold_name(F.col(col)), 1), (fold_name(F.col(col), False), 2)]
        return df.select(col, F.explode(F.array(*[F.struct(f.alias("fold"), F.lit(i).alias("rank")) for f, i in folds])).alias("v")).select(col, "v.fold", "v.rank")

    q = variants(queries.select("q").distinct(), "q").withColumnRenamed("rank", "q_rank")
    hit = q.join(variants(names.select("name").distinct(), "name"), "fold").groupBy("q").agg(F.min_by("name", F.struct(F.col("q_rank") + F.col("rank"), "name")).alias("name"))
    return queries.join(hit, "q", "left")


def search_names(queries: DataFrame, names: DataFrame) -> DataFrame:
    """All names that contain the folded query. Names are a small dimension
    table; only queries that match none exactly come here."""
    q = queries.select("q", fold_name(F.col("q")).alias("q_fold"), fold_name(F.col("q"), False).alias("q_bare"))
    n = names.select("name", "kind", fold_name(F.col("name")).alias("fold"), fold_name(F.col("name"), False).alias("bare"))
    return q.join(n, F.contains("fold", "q_fold") | F.contains("bare", "q_bare")).select("q", "name", "kind")


def lookup(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Per query (``q``): ``name``, ``kind`` and ``candidates``. A name that
    ``resolve_names`` knows is meant; else the only one that contains the
    query; with several ``name`` is null and they are counted."""
    exact = resolve_names(queries.select("q").distinct(), names.select("name"))
    known = exact.where("name is not null").join(names, "name").groupBy("q").agg(F.min(F.struct("name", "kind")).alias("b"), F.lit(1).alias("candidates"))
    open_ = exact.where("name is null").select("q")
    found = search_names(open_, names).groupBy("q").agg(F.count("*").alias("candidates"), F.min(F.struct("name", "kind")).alias("b"))
    fuzzy = found.select("q", F.when(F.col("candidates") == 1, F.col("b")).alias("b"), "candidates")
    hit = known.select("q", "b", F.col("candidates").cast("long").alias("candidates")).unionByName(fuzzy)
    return queries.join(hit, "q", "left").select("q", "b.name", "b.kind", F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"))


def _cell(most_km: float) -> float:
    """Degrees of a grid cell."""
    return most_km / 111.0 * 4


def _clip(t: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))


def axis_cells(axis: DataFrame, most_km: float) -> DataFrame:
    """Segments between neighbouring stations of a river, a row for each grid
    cell (``cx, cy``) that has a point within ``most_km`` of it, or may have.
    Stations of equal km follow each other by ``station_id``, if there is one,
    and by place, so that the same stations always give the same segments."""
    own = Window.partitionBy("river").orderBy("km", *[c for c in ("station_id", "lat", "lon") if c in axis.columns])
    seg = axis.where("lat is not null and lon is not null and km is not null").select("river", "km", "lat", "lon", F.lead("km").over(own).alias("km2"), F.lead("lat").over(own).alias("lat2"), F.lead("lon").over(own).alias("lon2")).where("km2 is not null")
    cell, pad = _cell(most_km), most_km / 111.0
    wide = F.lit(pad) / F.greatest(F.cos(F.radians(F.greatest(F.abs("lat"), F.abs("lat2")) + pad)), F.lit(0.01))

    def reach(a: Column, b: Column, more: Column) -> Column:
        return F.sequence(F.floor((F.least(a, b) - more) / cell), F.floor((F.greatest(a, b) + more) / cell))

    columns = seg.withColumn("wide", wide).withColumn("cx", F.explode(reach(F.col("lon"), F.col("lon2"), F.col("wide"))))
    # The part of the segment from which a point of this column of cells may be reached, as shares of its length.
    across = F.nullif(F.col("lon2") - F.col("lon"), F.lit(0.0))
    ends = [(F.col("cx") * cell - F.col("wide") - F.col("lon")) / across, ((F.col("cx") + 1) * cell + F.col("wide") - F.col("lon")) / across]
    first, last = _clip(F.coalesce(F.least(*ends), F.lit(0.0))), _clip(F.coalesce(F.greatest(*ends), F.lit(1.0)))
    rise = F.col("lat2") - F.col("lat")
    return columns.withColumn("cy", F.explode(reach(F.col("lat") + first * rise, F.col("lat") + last * rise, F.lit(pad))))


def near_axis(positions: DataFrame, axis: DataFrame, most_km: float = 2.0) -> DataFrame:
    """Positions (``pos_id, lat, lon``) within ``most_km`` of the polyline of a
    river's stations (``river, km, lat, lon``), with river, distance and
    projected km of the nearest segment (to six places; ties go to the river
    that sorts first).

    Segments are laid into the grid cells that lie within that distance of
    them, so a long one takes as many as its length asks for, whatever its
    direction. A position is joined with the segments of its own cell, as one
    array, and compared with them within its row: there is no aggregate over
    positions, which may be a stream. Positions without a place have no row.
    """
    by_cell = axis_cells(axis, most_km).groupBy("cx", "cy").agg(F.collect_list(F.struct("river", "km", "lat", "lon", "km2", "lat2", "lon2")).alias("segments"))

    cell = _cell(most_km)
    pos = positions.select("pos_id", F.col("lat").alias("y"), F.col("lon").alias("x")).withColumn("cy", F.floor(F.col("y") / cell)).withColumn("cx", F.floor(F.col("x") / cell))
    kx = F.cos(F.radians("y")) * 111.32

    def at(s: Column) -> Column:
        dx, dy = (s["lon2"] - s["lon"]) * kx, (s["lat2"] - s["lat"]) * 111.32
        px, py = (F.col("x") - s["lon"]) * kx, (F.col("y") - s["lat"]) * 111.32
        t = _clip(F.coalesce((px * dx + py * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0)))
        return F.struct(F.sqrt(F.pow(px - t * dx, 2) + F.pow(py - t * dy, 2)).alias("distance"), s["river"].alias("river"), (s["km"] + t * (s["km2"] - s["km"])).alias("km"))

    near = F.filter(F.transform("segments", at), lambda c: c["distance"] <= most_km)
    best = F.array_min(F.transform(near, lambda c: F.struct(F.round(c["distance"], 6).alias("distance"), c["river"].alias("river"), F.round(c["km"], 6).alias("km"))))
    return pos.join(by_cell, ["cx", "cy"]).select("pos_id", best.alias("b")).where("b is not null").select("pos_id", "b.river", "b.km", "b.distance")
