"""Versioned tables that are committed together.

A root folder holds several tables (silver, the gold state, both gold tables, the audit).
Every load writes its rows into folders of its own, partitioned by year, and touches
nothing that stands:

    <root>/silver/load=5f0c.../YEAR_DATE=2023-01-01/part-*.parquet
    <root>/_snapshots/000007.json

A snapshot is one small file that names, for every table, the folders that make up each
year. It is created last, and only if its number is still free, so readers see all tables
of one load or none, a run that fails between two writes leaves the last snapshot as it
was, and of two loads that run at once the later one to commit fails. A folder is found
through its snapshot only; what failed runs left behind is removed by ``expire``.

Rows without a valid year share no year, so a new load cannot replace "its" year there:
their folders are kept by load name, and a load replaces those of its own name only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.expr import ident
from .sinks import PARTITION_COLUMN, write_table

SNAPSHOTS = "_snapshots"
UNDATED = "__HIVE_DEFAULT_PARTITION__"


class ConcurrentCommit(RuntimeError):
    """Another load committed its snapshot first; this one must start again from it."""


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    p, fs = _path(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def _create(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file that must not exist yet."""
    p, fs = _path(spark, path)
    try:
        out = fs.create(p, False)
    except Exception as e:  # the Java exception's class is only in the message
        if fs.exists(p):
            raise ConcurrentCommit(path) from e
        raise
    try:
        out.write(text.encode())
    finally:
        out.close()


def _read(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


@dataclass
class Snapshot:
    """What readers of a root see: per table, year (or UNDATED) and load name the folders."""

    number: int = 0
    load: str = ""
    last_batch: int | None = None
    tables: dict[str, dict[str, dict[str, list[str]]]] = field(default_factory=dict)

    def folders(self, table: str, years: set[str] | None = None) -> list[str]:
        kept = self.tables.get(table, {})
        return [f for year in sorted(kept) if years is None or year in years for fs in kept[year].values() for f in fs]

    def years(self, table: str) -> set[str]:
        return set(self.tables.get(table, {}))


def snapshot_numbers(spark: SparkSession, root: str) -> list[int]:
    return [int(n[:-5]) for n in _names(spark, f"{root}/{SNAPSHOTS}") if n.endswith(".json") and n[:-5].isdigit()]


def load_snapshot(spark: SparkSession, root: str, number: int | None = None) -> Snapshot | None:
    """The snapshot of that number, or the latest; None where there is none."""
    for n in [number] if number is not None else reversed(snapshot_numbers(spark, root)):
        try:
            got = json.loads(_read(spark, f"{root}/{SNAPSHOTS}/{n:06d}.json"))
        except ValueError:  # being written, or its writer was lost while writing
            continue
        return Snapshot(n, got["load"], got["last_batch"], got["tables"])
    return None


def read_folders(spark: SparkSession, root: str, table: str, folders: list[str], schema: T.StructType) -> DataFrame:
    """The rows of a table's folders with its contract, years as the partition column."""
    if not folders:
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).option("basePath", f"{root}/{table}").parquet(*[f"{root}/{f}" for f in folders])
    return df.selectExpr(*[ident(f.name) for f in schema.fields])


def read_snapshot(spark: SparkSession, root: str, table: str, schema: T.StructType, number: int | None = None) -> DataFrame:
    """A table as the latest snapshot (or the one given) has it."""
    snapshot = load_snapshot(spark, root, number)
    if snapshot is None:
        raise FileNotFoundError(f"no snapshot in {root}")
    return read_folders(spark, root, table, snapshot.folders(table), schema)


class Load:
    """One load: writes folders, then commits them as the next snapshot.

    ``replace`` says what the load's rows are to the years they touch: "all" (the tables
    hold nothing else afterwards), "years" (they replace the years present in the load, and
    undated rows of a load of the same name), "add" (they join what is there).
    """

    def __init__(self, spark: SparkSession, root: str, name: str, replace: str = "all"):
        if replace not in ("all", "years", "add"):
            raise ValueError(f"unknown way to replace: {replace}")
        self.spark, self.root, self.name, self.replace = spark, root, name, replace
        # Even a load that replaces all takes the number after the one it has seen.
        self.before = load_snapshot(spark, root) or Snapshot(max(snapshot_numbers(spark, root), default=0))
        self.folder = f"load={uuid.uuid4().hex[:16]}"
        old = {} if replace == "all" else self.before.tables
        self.tables = {t: {y: dict(loads) for y, loads in years.items()} for t, years in old.items()}

    def write(self, table: str, df: DataFrame, cluster_by: list[str] | None = None, replace: str | None = None, touched: set[str] | None = None, **options) -> set[str]:
        """Writes the load's rows of a table; returns its years. Years of ``touched`` that
        got no rows become empty. Undated rows are replaced as a whole only if ``touched``
        names them; else only those of loads of this name are."""
        path = f"{self.root}/{table}/{self.folder}"
        write_table(df, path, cluster_by=cluster_by, **options)
        prefix = f"{PARTITION_COLUMN}="
        years = {n.removeprefix(prefix): f"{table}/{self.folder}/{n}" for n in _names(self.spark, path) if n.startswith(prefix)}
        kept = self.tables.setdefault(table, {})
        how = replace or self.replace
        if how != "add":
            for year in set(years) | (touched or set()):
                if year == UNDATED and UNDATED not in (touched or set()):
                    kept.get(year, {}).pop(self.name, None)
                else:
                    kept.pop(year, None)
        for year, folder in years.items():
            kept.setdefault(year, {}).setdefault(self.name, []).append(folder)
        return set(years)

    def write_history(self, table: str, df: DataFrame) -> str:
        """Writes an unpartitioned table of which every load's rows stay; a load of the same
        name replaces its own. Returns the folder's path."""
        path = f"{self.root}/{table}/{self.folder}"
        write_table(df, path, partition_by=None)
        kept = self.tables.setdefault(table, {k: dict(v) for k, v in self.before.tables.get(table, {}).items()})
        kept.setdefault("", {})[self.name] = [f"{table}/{self.folder}"]
        return path

    def read(self, table: str, schema: T.StructType, years: set[str] | None = None) -> DataFrame:
        """A table as it will stand once this load is committed."""
        return read_folders(self.spark, self.root, table, Snapshot(tables=self.tables).folders(table, years), schema)

    def commit(self, last_batch: int | None = None) -> int:
        number = self.before.number + 1
        body = {"load": self.name, "last_batch": last_batch if last_batch is not None else self.before.last_batch, "tables": self.tables}
        _create(self.spark, f"{self.root}/{SNAPSHOTS}/{number:06d}.json", json.dumps(body))
        return number


def _unused(spark: SparkSession, root: str, tables: set[str], used: set[str]) -> Iterator[str]:
    for table in sorted(tables):
        for load in _names(spark, f"{root}/{table}"):
            if load.startswith("load=") and not any(f == f"{table}/{load}" or f.startswith(f"{table}/{load}/") for f in used):
                yield f"{root}/{table}/{load}"


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Drops all but the last ``keep`` snapshots and the folders that none of them names.

    To be run while no load is being written: a load's folders are named by no snapshot
    until it is committed. Returns the folders deleted.
    """
    if keep < 1:
        raise ValueError("at least one snapshot stays")
    numbers = snapshot_numbers(spark, root)
    kept = [s for n in numbers[-keep:] if (s := load_snapshot(spark, root, n))]
    tables = {t for n in numbers if (s := load_snapshot(spark, root, n)) for t in s.tables}
    for n in numbers[:-keep]:  # readers of the newest ones lose nothing if this stops half-way
        p, fs = _path(spark, f"{root}/{SNAPSHOTS}/{n:06d}.json")
        fs.delete(p, False)
    used = {f for s in kept for t in s.tables for f in s.folders(t)}
    gone = list(_unused(spark, root, tables, used))
    for folder in gone:
        p, fs = _path(spark, folder)
        fs.delete(p, True)
    return gone
