"""Tables in numbered states: what readers see changes whole, or not at all.

A folder holds one table, or several that change together. Each commit writes
the partitions that it touches into folders of its own (``version=N``), and
then one small file, ``_states/N.json``, that names for every partition of
every table the version in force. Until that file is there, readers have the
state before; a commit that fails leaves nothing but a folder that nobody
reads, which the next commit overwrites. One writer at a time: a commit onto
a state that is no longer the newest fails.

Rows are laid out by their rank in the table's order, a fixed number a file,
and files are named by their place. So the same rows give the same files, by
name and byte, whatever the number of tasks that wrote them.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager, nullcontext
from urllib.parse import unquote
from weakref import WeakSet

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.order import numbered
from .scratch import new_path, remove

#: Rows of a file, which one task sorts and writes; and those for which a task more is worth its start, where files are smaller.
FILE_ROWS, TASK_ROWS = 1_000_000, 250_000
_NULL = "__HIVE_DEFAULT_PARTITION__"


def _hadoop(spark: SparkSession, path: str):
    """Spark's file system for ``path``, and its class of paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, make = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(make(path))) if fs.exists(make(path)) else []


def current(spark: SparkSession, path: str) -> dict | None:
    """The newest state (``n``, ``tables``: per name ``by``, ``schema``,
    ``parts``), or None if there is none. One that can't be read fails."""
    numbers = [n for n in _names(spark, f"{path}/_states") if n.endswith(".json")]
    if not numbers:
        return None
    return json.loads("".join(r[0] for r in spark.read.text(f"{path}/_states/{numbers[-1]}", wholetext=True).collect()))


def _point(spark: SparkSession, path: str, state: dict) -> None:
    """Make ``state`` the one in force: its file is written aside and moved to its name whole."""
    fs, make = _hadoop(spark, path)
    end, draft = make(f"{path}/_states/{state['n']:08d}.json"), make(f"{path}/_states/.{state['n']:08d}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
    out.close()
    if fs.exists(end) or not fs.rename(draft, end):
        raise RuntimeError(f"{path}: state {state['n']} was written by another run")


def _root(path: str, table: str) -> str:
    return f"{path}/{table}" if table else path


def _folder(root: str, version: str, by: str | None, part: str) -> str:
    return "/".join(x for x in (root, version, f"{by}={part}" if by else "") if x)


def read(spark: SparkSession, path: str, table: str = "") -> DataFrame | None:
    """A table as of the newest state; None if there is no state, or it lacks
    the table. Later commits don't change what the frame reads until the one
    after the next cleans up."""
    state = current(spark, path)
    if state is None or table not in state["tables"]:
        return None
    own, root = state["tables"][table], _root(path, table)
    schema = T.StructType.fromJson(own["schema"])
    plain = [p for p, v in own["parts"].items() if not v]
    versioned = [(p, v) for p, v in own["parts"].items() if v]
    out = None
    for paths, extra in (([_folder(root, v, own["by"], p) for p, v in versioned], [T.StructField("version", T.StringType())]), ([_folder(root, "", own["by"], p) for p in plain], [])):
        if paths:
            some = spark.read.schema(T.StructType([*schema.fields, *extra])).option("basePath", root).parquet(*paths).select(*schema.names)
            out = some if out is None else out.unionByName(some)
    return spark.createDataFrame([], schema) if out is None else out


#: Frames of ``aside``, which needn't be computed once again.
_held: WeakSet[DataFrame] = WeakSet()


@contextmanager
def aside(df: DataFrame):
    """``df`` computed once into a table of its own, which goes when the block ends, however it does."""
    spark, at = df.sparkSession, new_path(df.sparkSession, "aside")
    try:
        df.write.parquet(at)
        _held.add(copy := spark.read.schema(df.schema).parquet(at))
        yield copy
    finally:
        remove(spark, at)


def _put(df: DataFrame, folder: str, by: str | None, order: list[str], file_rows: int) -> list[str]:
    """Write ``df`` into ``folder`` in files of ``file_rows`` rows by rank in
    ``order``, and in ``by``'s partitions; returns the partitions' names.

    Spark writes into a draft within the folder, from where each file is moved
    to its name: the driver takes one step a file, and one for all the rest."""
    spark, ordered, draft = df.sparkSession, new_path(df.sparkSession, "ordered"), f"{folder}/_draft"
    keys = [by, "__file"] if by else ["__file"]
    fs, make = _hadoop(spark, folder)
    fs.delete(make(folder), True)
    try:
        with nullcontext(df) if df in _held else aside(df) as copy:
            groups = copy.groupBy(by) if by else copy.groupBy()
            most, files, n = (x or 0 for x in groups.agg(F.count("*").alias("n")).agg(F.max("n"), F.sum(F.ceil(F.col("n") / file_rows)), F.sum("n")).first())
            # At least a task a file, so that its rows don't grow with the table, and more while they are few, so that hardly two
            # files meet in one; of small files a task has several.
            least = int(spark.conf.get("spark.sql.shuffle.partitions"))
            tasks = max(1, min(files if files > 64 else 4 * files, max(least, n // TASK_ROWS, 64)))
            if most <= file_rows:  # all ranks fall into file 0
                filed = copy.withColumn("__file", F.lit(0).cast("long"))
            else:
                filed = numbered(copy, order, [by] if by else None, at=ordered, parts=max(least, n // FILE_ROWS), few=True).drop("group_rows").withColumn("__file", F.floor(F.col("rank") / file_rows)).drop("rank")
            # Nobody reads the draft, so tasks may move their files themselves: the driver has no list of them to go through.
            filed.repartition(tasks, *keys).sortWithinPartitions(*keys, *order).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(*keys).parquet(draft)
    finally:
        remove(spark, ordered)
    written = spark.read.schema(df.schema).option("recursiveFileLookup", True).parquet(draft).inputFiles()
    groups: dict[tuple[str, int], list[str]] = {}
    for at in written:
        *part, number, file = unquote(at).rpartition("/_draft/")[2].split("/")
        groups.setdefault(("/".join(part), int(number.partition("=")[2])), []).append(file)
    parts = sorted({part for part, _ in groups}) if by else [""]
    for part in parts:
        fs.mkdirs(make(f"{folder}/{part}".rstrip("/")))

    def name(group: tuple[str, int]) -> None:
        part, number = group
        for k, file in enumerate(sorted(groups[group])):  # one, unless a task was cut by the session's own limit of rows a file
            start, end = "/".join(x for x in (draft, part, f"__file={number}", file) if x), "/".join(x for x in (folder, part, f"rows-{number:06d}-{k:02d}.parquet") if x)
            if not fs.rename(make(start), make(end)):
                raise RuntimeError(f"{start} couldn't be moved to {end}")

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(name, groups))
    fs.delete(make(draft), True)
    return [p.partition("=")[2] for p in parts]


def _plain_parts(spark: SparkSession, root: str, by: str | None) -> dict[str, str]:
    """Partitions of a table that Spark wrote without states."""
    return {n.partition("=")[2]: "" for n in _names(spark, root) if by and n.startswith(f"{by}=")}


def commit(spark: SparkSession, path: str, tables: dict[str, DataFrame], by: dict[str, str] | None = None, order: dict[str, list[str]] | None = None, replace: bool = False, drop: dict[str, Iterable[str]] | None = None, file_rows: int = FILE_ROWS, keep: int = 1) -> int:
    """Make one new state of ``path``; returns its number.

    Each of ``tables`` (by name; "" for a folder of one table) replaces the
    partitions of its column in ``by`` that it has rows of, or, with
    ``replace`` or without a column, the whole table; partitions named in
    ``drop`` go. Tables that aren't named stay. ``order``: columns that no two
    rows of a partition share, the order of its rows. Frames may read the
    folder's present state. A folder written by Spark alone, without states,
    is taken over partition by partition. ``keep`` older states stay readable."""
    by, order, drop = by or {}, order or {}, drop or {}
    old = current(spark, path)
    state = {"n": (old["n"] if old else 0) + 1, "tables": dict(old["tables"]) if old else {}}
    version = f"version={state['n']:08d}"
    for name in dict.fromkeys([*tables, *drop]):
        root, column, before = _root(path, name), by.get(name), state["tables"].get(name)
        column = column or (before["by"] if before else None)
        parts = {} if (replace and name in tables) or column is None else dict(before["parts"]) if before else _plain_parts(spark, root, column)
        schema = before["schema"] if before else None
        if name in tables:
            df = tables[name]
            fields = [f for f in df.schema.fields if f.name != column] + [f for f in df.schema.fields if f.name == column]
            schema = json.loads(T.StructType([T.StructField(f.name, f.dataType) for f in fields]).json())
            parts |= {p: version for p in _put(df, f"{root}/{version}", column, order.get(name) or [c for c in df.columns if c != column], file_rows)}
        for p in drop.get(name, ()):
            parts.pop(str(p), None)
        if schema is None:
            continue
        state["tables"][name] = {"by": column, "schema": schema, "parts": parts}
    _point(spark, path, state)
    clean(spark, path, keep)
    return state["n"]


def clean(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete states but the newest and ``keep`` before it, and folders that
    none of these names. Whatever is interrupted is done by the next call."""
    fs, make = _hadoop(spark, path)
    numbers = [n for n in _names(spark, f"{path}/_states") if n.endswith(".json")]
    kept = [json.loads("".join(r[0] for r in spark.read.text(f"{path}/_states/{n}", wholetext=True).collect())) for n in numbers[-1 - keep :]]
    for n in numbers[: -1 - keep]:
        fs.delete(make(f"{path}/_states/{n}"), False)
    used = {_folder(_root(path, name), v, t["by"], p) for s in kept for name, t in s["tables"].items() for p, v in t["parts"].items()}
    for name in {name for s in kept for name in s["tables"]}:
        root = _root(path, name)
        column = next(s["tables"][name]["by"] for s in reversed(kept) if name in s["tables"])
        for folder in _names(spark, root):
            if folder.startswith("version="):
                inner = [f"{root}/{folder}/{p}" for p in _names(spark, f"{root}/{folder}") if p.startswith(f"{column}=")] if column else [f"{root}/{folder}"]
                for at in inner:
                    if at not in used:
                        fs.delete(make(at), True)
                if column and not any(u.startswith(f"{root}/{folder}/") for u in used):
                    fs.delete(make(f"{root}/{folder}"), True)
            elif column and folder.startswith(f"{column}=") and f"{root}/{folder}" not in used:
                fs.delete(make(f"{root}/{folder}"), True)
