"""Tables in states: failures at every step, cleaning, and files that only depend on rows."""

import pytest

from gaugeflow.operators import totals as T
from gaugeflow.plans import queries as Q
from gaugeflow.sources import states
from gaugeflow.sources import tables as B

from .compare import rows
from .conftest import SF
from .test_operators import daily


def failing(monkeypatch, at):
    """The ``at``-th of the steps of a commit (a table's files, the pointer, the cleaning) fails."""
    steps = {"n": 0}

    def broken(f):
        def run(*a, **k):
            steps["n"] += 1
            if steps["n"] == at:
                raise OSError("the disk is gone")
            return f(*a, **k)

        return run

    for name in ("_put", "_point", "clean"):
        monkeypatch.setattr(states, name, broken(getattr(states, name)))


@pytest.mark.parametrize("at", range(1, 7))
def test_a_rebuild_that_fails_leaves_all_tables(spark, tmp_path, monkeypatch, at):
    raw, units, path = Q.raw_totals(spark, SF), Q.stations(spark, SF), str(tmp_path / "totals")
    first, second = raw.where("year < 1997"), raw.where("year > 1994")
    B.rebuild_totals(T.river_daily(first), T.river_monthly(first), path, units)
    before = {n: rows(B.read_table(spark, path, n)) for n in ("daily", "monthly", "overview", "units")}
    with monkeypatch.context() as m:
        failing(m, at)
        with pytest.raises(OSError, match="the disk"):
            B.rebuild_totals(T.river_daily(second), T.river_monthly(second), path, units.limit(3))
    after = {n: rows(B.read_table(spark, path, n)) for n in before}
    if at <= 5:  # four tables and the pointer
        assert after == before
        B.rebuild_totals(T.river_daily(second), T.river_monthly(second), path, units.limit(3))
        after = {n: rows(B.read_table(spark, path, n)) for n in before}
    cols = sorted(T.river_monthly(raw).columns)
    assert after["monthly"] == rows(T.river_monthly(second).select(cols))
    assert len(after["units"][1]) == 3


@pytest.mark.parametrize("at", [1, 2, 3])
def test_an_upsert_that_fails_can_be_repeated(spark, tmp_path, monkeypatch, at):
    path = str(tmp_path / "daily")
    B.upsert_daily(spark, path, daily(spark, ("s", "2023-01-01", 5.0, 6.0), ("s", "2024-01-01", 5.0, 6.0)))
    before, fresh = rows(B.read_table(spark, path)), daily(spark, ("s", "2024-01-01", 1.0, 9.0))
    with monkeypatch.context() as m:
        failing(m, at)
        with pytest.raises(OSError):
            B.upsert_daily(spark, path, fresh)
    if at < 3:
        assert rows(B.read_table(spark, path)) == before
    B.upsert_daily(spark, path, fresh)
    assert {(r["year"], r["min_v"], r["max_v"]) for r in B.read_table(spark, path).collect()} == {(2023, 5.0, 6.0), (2024, 1.0, 9.0)}
    assert not [p for p in tmp_path.rglob("*aside*")]


def test_readers_keep_the_state_they_opened(spark, tmp_path):
    path = str(tmp_path / "daily")
    B.upsert_daily(spark, path, daily(spark, ("s", "2024-01-01", 5.0, 6.0)))
    opened = B.read_table(spark, path)
    B.upsert_daily(spark, path, daily(spark, ("s", "2024-01-01", 1.0, 9.0)))
    assert opened.first()["min_v"] == 5.0
    B.upsert_daily(spark, path, daily(spark, ("s", "2024-01-02", 1.0, 9.0)))
    assert len(list((tmp_path / "daily").glob("version=*"))) == 2  # of three, the oldest is gone
    assert len(list((tmp_path / "daily/_states").glob("*.json"))) == 2


def test_two_writers_of_one_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "daily")
    B.upsert_daily(spark, path, daily(spark, ("s", "2024-01-01", 5.0, 6.0)))
    state = states.current(spark, path)
    with pytest.raises(RuntimeError, match="another run"):
        states._point(spark, path, state)
    (tmp_path / "daily/_states/00000009.json").write_text("{rubbish")
    with pytest.raises(ValueError):  # never taken for an empty table
        B.upsert_daily(spark, path, daily(spark, ("s", "2024-01-01", 5.0, 6.0)))


def test_files_depend_on_rows_alone(spark, tmp_path):
    df = daily(spark, *[(f"s{i % 7}", f"202{i % 3}-01-{i % 28 + 1:02d}", float(i), float(i + 1)) for i in range(84)])
    files = []
    for n, parts in ((1, 1), (2, 6)):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(n * 3))
        states.commit(spark, str(tmp_path / str(n)), {"": df.repartition(parts)}, {"": "year"}, {"": ["station_id", "doy"]}, file_rows=5)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        files.append([(str(p.relative_to(tmp_path / str(n))), p.read_bytes()) for p in sorted((tmp_path / str(n)).rglob("rows-*.parquet"))])
    assert files[0] == files[1]
    assert len(files[0]) == sum(-(-len([1 for i in range(84) if i % 3 == y]) // 5) for y in range(3))


def test_pruned_months_leave_the_table(spark, tmp_path):
    path = str(tmp_path / "snap")
    rows_ = [("a", "A", "R", f"2026-{m:02d}-03", 1.0, False) for m in (5, 6, 7, 8)]
    shot = spark.createDataFrame(rows_, "station_id string, n string, w string, day string, value double, tidal boolean").withColumn("day", Q.F.to_date("day"))
    B.write_snapshot(spark, path, shot)
    assert B.prune_snapshot(spark, path, "2026-08-20", 0) == []
    assert B.prune_snapshot(spark, path, "2026-08-20", 1) == ["2026-05", "2026-06"]
    assert {r["month"] for r in B.read_table(spark, path).collect()} == {"2026-07", "2026-08"}
    assert B.prune_snapshot(spark, path, "2026-08-20", 1) == []
    assert B.prune_snapshot(spark, str(tmp_path / "none"), "2026-08-20", 1) == []


def test_a_file_that_cannot_be_moved_fails_the_commit(spark, tmp_path, monkeypatch):
    """A file that stays where it is must not go with its draft, and no state may name what isn't there."""
    path, hadoop = str(tmp_path / "daily"), states._hadoop

    class Stuck:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def rename(self, start, end):
            return False if end.getName().startswith("rows-") else self.fs.rename(start, end)

    def stuck(*a):
        fs, make = hadoop(*a)
        return Stuck(fs), make

    df = daily(spark, ("s", "2024-01-01", 1.0, 9.0))
    with monkeypatch.context() as m:
        m.setattr(states, "_hadoop", stuck)
        with pytest.raises(RuntimeError, match="moved"):
            states.commit(spark, path, {"": df}, {"": "year"}, {"": ["station_id", "doy"]})
    assert states.current(spark, path) is None
    states.commit(spark, path, {"": df}, {"": "year"}, {"": ["station_id", "doy"]})
    assert rows(B.read_table(spark, path)) == rows(df.select(sorted(df.columns)))


def test_a_frame_that_is_held_is_not_copied_again(spark, tmp_path, monkeypatch):
    """A merged table is computed into files by the job; its commit reads these, and writes only the table's own."""
    df = daily(spark, *[(f"s{i}", f"202{i % 3}-01-01", 1.0, 9.0) for i in range(12)])
    with states.aside(df) as held, monkeypatch.context() as m:
        m.setattr(states, "aside", None)
        states.commit(spark, str(tmp_path / "daily"), {"": held}, {"": "year"}, {"": ["station_id", "doy"]}, file_rows=2)
    assert rows(states.read(spark, str(tmp_path / "daily"))) == rows(df)
    assert len(list((tmp_path / "daily").rglob("rows-*.parquet"))) == 6
