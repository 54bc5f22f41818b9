"""Incremental bronze load with Structured Streaming, and its ledger.

A file-stream query run with ``trigger(availableNow=True)`` takes new JSON Lines files of
the landing folder: each run drains whatever arrived since the last one, and the
checkpoint records which files were taken. Every micro-batch is written by
``foreachBatch`` as a folder of its own, partitioned by drop and year, and then entered in
the ledger. A batch that is run again after a failure replaces its own folder and its own
ledger entry, and readers see a batch only once the ledger has it, so a failure at any
point neither loses nor repeats a row.

    <bronze>/rows/_batch=7/_drop=2024-02/_year=2023/part-*.parquet
    <bronze>/ledger/_batch=7/part-*.parquet        one row per drop of the batch

A file stream does not re-read a path it has seen, even if rewritten, so every drop needs
a new name. A drop is what stands directly in the landing folder: a folder with any number
of part files, or one file. The ledger gives every drop its arrival sequence: by batch,
within a batch by the time of its files, and where that is equal by name, numbers in names
compared as numbers. A drop that is taken in several batches keeps its first sequence. The
ledger also says which years each drop touches, so a job resolves only those. If a record
is sent again, the ``newest_drop`` view keeps, per record key, all rows of the newest drop
that has it and no others.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contracts import BRONZE_COLUMNS, CORRUPT_RECORD, bronze_schema
from ..functions.expr import ident, select_names, to_long_sql

DROP_TIME = "_drop_time"
DROP_FILE = "_drop_file"
DROP = "_drop"
BATCH = "_batch"
YEAR_KEY = "_year"  # the row's year as a number; NULL where silver's YEAR_DATE is NULL
SEQUENCE = "_sequence"
# A record's identity across drops: one provider (or roll-up), category, level,
# year type and year.
RECORD_KEY = ["PRVDR_ID", "STATE", "SRVC_CTGRY", "SMRY_CTGRY", "YEAR_TYPE", "YEAR"]


def landing_stream(
    spark: SparkSession,
    landing_dir: str,
    max_files_per_trigger: int | None = None,
    archive_dir: str | None = None,
) -> DataFrame:
    """Landing files as a stream of bronze rows with their drop's file and time.

    With ``archive_dir`` every file is moved there once its batch is committed
    (``cleanSource=archive``). The source lists the landing folder on every
    trigger, so without archiving that listing grows with every drop ever
    received. The archive folder must lie outside the landing folder.
    """
    reader = (
        spark.readStream.schema(bronze_schema(with_corrupt_record=True))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT_RECORD)
    )
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if archive_dir:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive_dir)
    # Part files lie in a folder per drop; names like "drop=1" are no partitions.
    src = reader.option("recursiveFileLookup", "true").json(landing_dir)
    inside = re.escape(re.sub(r"^[a-z0-9]+:/*", "/", landing_dir).strip("/"))
    return src.selectExpr(
        *[ident(c) for c in BRONZE_COLUMNS],
        ident(CORRUPT_RECORD),
        f"_metadata.file_modification_time AS {DROP_TIME}",
        f"_metadata.file_path AS {DROP_FILE}",
    ).withColumn(DROP, F.coalesce(F.nullif(F.regexp_extract(F.url_decode(DROP_FILE), f"{inside}/+([^/]+)", 1), F.lit("")), DROP_FILE))


def _rows_dir(bronze_dir: str) -> str:
    return f"{bronze_dir}/rows"


def _ledger_dir(bronze_dir: str) -> str:
    return f"{bronze_dir}/ledger"


LEDGER_SCHEMA = f"{DROP} string, {SEQUENCE} long, n_rows long, n_corrupt long, arrived timestamp, years array<int>, undated boolean"
_DROPS_OF_A_BATCH = 1 << 20


def natural(name: str) -> list:
    """A sort key of names in which runs of digits count as numbers ("drop-9" before "drop-10")."""
    parts = re.split(r"(\d+)", name)
    return [[int(p), p] if i % 2 else p for i, p in enumerate(parts)]


def _batch_writer(bronze_dir: str, counted: Callable[[int], None]) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function: the batch's rows, then its ledger entry."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        year = to_long_sql("YEAR")
        rows = batch.withColumn(YEAR_KEY, F.expr(f"CASE WHEN {year} BETWEEN 1 AND 9999 THEN CAST({year} AS INT) END"))
        path = f"{_rows_dir(bronze_dir)}/{BATCH}={batch_id}"
        rows.write.mode("overwrite").partitionBy(DROP, YEAR_KEY).parquet(path)
        # The entry comes from the written rows, so the landing files are parsed once. One
        # row per drop and year of the batch reaches the driver, which holds the batch's
        # list of files already.
        written = (
            spark.read.schema(f"{CORRUPT_RECORD} string, {DROP_TIME} timestamp, {DROP} string, {YEAR_KEY} int")
            .parquet(path)
            .groupBy(DROP, YEAR_KEY)
            .agg(F.count(F.lit(1)).alias("n"), F.count(CORRUPT_RECORD).alias("bad"), F.min(DROP_TIME).alias("arrived"))
            .collect()
        )
        drops: dict[str, list] = {}
        for r in written:
            drops.setdefault(r[DROP], []).append(r)
        order = sorted(drops, key=lambda d: (min(r["arrived"] for r in drops[d]), natural(d)))
        entries = [
            (
                name,
                batch_id * _DROPS_OF_A_BATCH + at,
                sum(r["n"] for r in drops[name]),
                sum(r["bad"] for r in drops[name]),
                min(r["arrived"] for r in drops[name]),
                sorted(r[YEAR_KEY] for r in drops[name] if r[YEAR_KEY] is not None),
                any(r[YEAR_KEY] is None and r["n"] > r["bad"] for r in drops[name]),
            )
            for at, name in enumerate(order)
        ]
        if entries:
            entry = spark.createDataFrame(entries, LEDGER_SCHEMA).coalesce(1)
            entry.write.mode("overwrite").parquet(f"{_ledger_dir(bronze_dir)}/{BATCH}={batch_id}")
        counted(sum(e[2] for e in entries))

    return write


def load_available(
    spark: SparkSession,
    landing_dir: str,
    bronze_dir: str,
    checkpoint_dir: str,
    max_files_per_trigger: int | None = None,
    archive_dir: str | None = None,
) -> int:
    """Drain every new landing file into the bronze table; returns rows appended.

    With ``max_files_per_trigger`` a large backlog is taken in several bounded
    micro-batches (each committed to the ledger and the checkpoint) instead
    of one huge one. Readers of the table see only batches that the ledger has. With
    ``archive_dir`` loaded files are moved out of the landing folder.
    """
    counts: list[int] = []
    query = (
        landing_stream(spark, landing_dir, max_files_per_trigger, archive_dir)
        .writeStream.foreachBatch(_batch_writer(bronze_dir, counts.append))
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return sum(counts)


def start_continuous_load(
    spark: SparkSession,
    landing_dir: str,
    bronze_dir: str,
    checkpoint_dir: str,
    every: str = "1 minute",
    max_files_per_trigger: int | None = None,
    archive_dir: str | None = None,
    on_batch: Callable[[int], None] | None = None,
):
    """Keep loading: a micro-batch every ``every`` picks up files that arrived since
    the last one (the always-on form of ``load_available``). Returns the query.

    ``on_batch(rows)`` is called after each batch is in the ledger: with
    ``plans.job.run_arrivals`` it carries every arrival on to silver and gold.
    """
    return (
        landing_stream(spark, landing_dir, max_files_per_trigger, archive_dir)
        .writeStream.foreachBatch(_batch_writer(bronze_dir, on_batch or (lambda rows: None)))
        .option("checkpointLocation", checkpoint_dir)
        .trigger(processingTime=every)
        .start()
    )


def read_ledger(spark: SparkSession, bronze_dir: str) -> DataFrame:
    """The ledger: (_batch, _drop, _sequence, n_rows, n_corrupt, arrived, years, undated)
    per drop and batch, empty before the first load."""
    try:
        return spark.read.schema(f"{LEDGER_SCHEMA}, {BATCH} long").parquet(_ledger_dir(bronze_dir))
    except AnalysisException:  # nothing loaded yet
        return spark.createDataFrame([], f"{LEDGER_SCHEMA}, {BATCH} long")


@dataclass
class Arrivals:
    """What the ledger's batches after some batch bring: the last batch, the years touched
    (a few numbers) and whether undated rows are among them."""

    last_batch: int | None
    years: list[int]
    undated: bool
    rows: int


def arrivals(spark: SparkSession, bronze_dir: str, after_batch: int | None) -> Arrivals:
    new = read_ledger(spark, bronze_dir)
    if after_batch is not None:
        new = new.where(F.col(BATCH) > after_batch)
    seen = new.agg(
        F.max(BATCH).alias("last"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("years")))).alias("years"),
        F.coalesce(F.bool_or("undated"), F.lit(False)).alias("undated"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n"),
    ).first()
    return Arrivals(seen["last"], list(seen["years"] or []), seen["undated"], seen["n"])


def read_loaded(spark: SparkSession, bronze_dir: str) -> DataFrame:
    """The streamed bronze table: every drop's rows that the ledger has, with the drop's
    columns and its arrival sequence."""
    schema = bronze_schema(with_corrupt_record=True).add(DROP_TIME, "timestamp").add(DROP_FILE, "string")
    schema = schema.add(BATCH, "long").add(DROP, "string").add(YEAR_KEY, "integer")
    ledger = read_ledger(spark, bronze_dir)
    try:
        rows = spark.read.schema(schema).parquet(_rows_dir(bronze_dir))
    except AnalysisException:  # nothing loaded yet
        rows = spark.createDataFrame([], schema)
    first = ledger.groupBy(F.col(DROP).alias("_d")).agg(F.min(SEQUENCE).alias(SEQUENCE))
    entries = ledger.select(F.col(BATCH).alias("_b"), F.col(DROP).alias("_d")).join(first, "_d")
    return rows.join(entries, (F.col(BATCH) == F.col("_b")) & (F.col(DROP) == F.col("_d"))).drop("_b", "_d")


def _of_years(rows: DataFrame, years: list, undated: bool) -> DataFrame:
    """Rows of the given years; by the partition column where the table has it."""
    if YEAR_KEY in rows.columns:
        which = F.col(YEAR_KEY).isin([int(y) for y in years])
        return rows.where(which | F.col(YEAR_KEY).isNull() if undated else which)
    which = F.col("YEAR").isin([str(y) for y in years])
    return rows.where(which | F.expr(to_long_sql("YEAR")).isNull() if undated else which)


def _name_order(loaded: DataFrame) -> DataFrame:
    """Each drop's place among the names (one row per drop), digits compared as numbers."""
    padded = F.regexp_replace(F.regexp_replace("_name", r"(\d+)", "0" * 24 + "$1"), r"0*(\d{24,}?)(?!\d)", "$1")
    names = loaded.select(F.col(DROP).cast("string").alias("_name")).distinct()
    return names.select("_name", F.row_number().over(Window.orderBy(padded, "_name")).cast("long").alias("_order"))


def newest_drop(loaded: DataFrame, years: list | None = None, by: str = "name", undated: bool = False) -> DataFrame:
    """Per record key, all rows of the newest drop that has it (bronze columns).

    ``by="arrival"`` takes the ledger's sequence, ``by="name"`` the order of the drops'
    names with numbers compared as numbers. The newest one per key is a ``max`` of numbers:
    a hash aggregate, partial in each task, joined back on the key; AQE's skew-join
    splitting handles a key with very many rows. With ``years`` (those that new drops
    touch; ``undated`` adds rows without a valid year) only their rows are read and
    resolved: a record's year is part of its key.
    """
    good = loaded.where(F.col(CORRUPT_RECORD).isNull())
    if years is not None:
        good = _of_years(good, years, undated)
    if by == "arrival":
        good = good.withColumn("_order", F.col(SEQUENCE))
    elif by == "name":
        good = good.join(_name_order(loaded), F.col(DROP).cast("string") == F.col("_name"))
    else:
        raise ValueError(f"unknown order of drops: {by}")
    latest = good.groupBy(*RECORD_KEY).agg(F.max("_order").alias("_latest"))
    side = {k: f"_k{i}" for i, k in enumerate(RECORD_KEY)}
    latest = latest.selectExpr(*[f"{ident(k)} AS {side[k]}" for k in RECORD_KEY], "_latest")
    cond = " AND ".join([f"{ident(k)} <=> {side[k]}" for k in RECORD_KEY] + ["_order = _latest"])
    return select_names(good.join(latest, F.expr(cond), "left_semi"), BRONZE_COLUMNS)


def resends(loaded: DataFrame, after_batch: int, years: list, undated: bool) -> bool:
    """Whether a record that arrived after ``after_batch`` was there before, among the rows of
    the given years. Distinct keys are compared; one row is fetched at most."""
    good = _of_years(loaded.where(F.col(CORRUPT_RECORD).isNull()), years, undated)
    seen = good.groupBy(*RECORD_KEY).agg(F.min(BATCH).alias("first"), F.max(BATCH).alias("last"))
    return not seen.where((F.col("first") <= after_batch) & (F.col("last") > after_batch)).isEmpty()


def rows_after(loaded: DataFrame, after_batch: int) -> DataFrame:
    """The good rows that arrived after ``after_batch`` (bronze columns)."""
    return select_names(loaded.where(F.col(CORRUPT_RECORD).isNull() & (F.col(BATCH) > after_batch)), BRONZE_COLUMNS)


def corrupt_lines(loaded: DataFrame) -> DataFrame:
    """Landing lines that did not parse, with the file they came from."""
    return loaded.where(F.col(CORRUPT_RECORD).isNotNull()).select(CORRUPT_RECORD, DROP_FILE, DROP_TIME)

