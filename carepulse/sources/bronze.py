"""Bronze sources and the JSON Lines landing sink.

The raw data arrives as JSON Lines, one flat object per row, one data set per
year. Everything is read as text with an explicit schema (no inference pass
over the data) plus ``_corrupt_record``, so a malformed line can go to a quarantine table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import BRONZE_COLUMNS, CORRUPT_RECORD, bronze_schema
from ..functions.expr import ident, select_names


# Spark refuses a raw JSON scan that needs the corrupt-record column alone, as a count
# of good or bad lines does; this condition (always true) names a second column.
_ALSO = f"length(concat_ws('', {BRONZE_COLUMNS[0]})) >= 0"


def read_bronze(spark: SparkSession, source: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Scan a bronze table: a path (``fmt`` = parquet, json, orc, ...) or, with
    ``fmt='table'``, a catalog table name. Other connectors take their options."""
    if fmt == "table":
        return spark.read.options(**options).table(source)
    if fmt == "json":
        return read_landing(spark, [source], **options)
    return spark.read.format(fmt).options(**options).load(source)


def read_landing(spark: SparkSession, paths: list[str], keep_corrupt: bool = False, **options: str) -> DataFrame:
    """Read JSON Lines landing files as all-text bronze (a multi-path read is a bag union).

    A field missing from a file is NULL. A line that does not parse is no bronze row
    (as in the stream); with ``keep_corrupt`` it is a row whose only non-NULL cell is
    ``_corrupt_record``. ``corrupt_landing_lines`` gives those lines with their file.
    """
    df = (
        spark.read.schema(bronze_schema(with_corrupt_record=True))
        .options(**options)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT_RECORD)
        .json(paths)
    )
    return df if keep_corrupt else select_names(df.where(f"{CORRUPT_RECORD} IS NULL AND {_ALSO}"), BRONZE_COLUMNS)


def corrupt_landing_lines(spark: SparkSession, paths: list[str], **options: str) -> DataFrame:
    """(_corrupt_record, file) of the landing lines that did not parse, for a quarantine table."""
    df = read_landing(spark, paths, keep_corrupt=True, **options).select("*", F.col("_metadata.file_path").alias("file"))
    return df.where(f"{CORRUPT_RECORD} IS NOT NULL AND {_ALSO}").select(CORRUPT_RECORD, "file")


RESCUED = "_rescued"
EXTRA_FIELDS = "_extra_fields"
SOURCE_FILE = "_source_file"


def read_landing_rescued(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Bronze rows of landing files with ``_extra_fields`` (the names of fields outside the
    contract), ``_rescued`` (where there are any, the whole line as a Variant, else NULL)
    and the file they came from.

    A field that the source adds or renames is thus kept with its value and type, nested or
    not. Lines that do not parse are no rows, as in ``read_landing``. Each line is read
    once and parsed twice, for the contract's columns and for the names of its fields.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT_RECORD}
    known = ", ".join(f"'{c}'" for c in BRONZE_COLUMNS)
    parsed = (
        spark.read.text(paths)
        .select("value", F.col("_metadata.file_path").alias(SOURCE_FILE))
        .where("trim(value) <> ''")
        .select(F.from_json("value", bronze_schema(with_corrupt_record=True), options).alias("r"), SOURCE_FILE, "value")
        .where(f"r.{CORRUPT_RECORD} IS NULL")
    )
    named = parsed.selectExpr("*", f"array_except(json_object_keys(value), array({known})) AS {EXTRA_FIELDS}")
    return named.selectExpr(
        *[f"r.{ident(c)} AS {ident(c)}" for c in BRONZE_COLUMNS],
        EXTRA_FIELDS,
        f"CASE WHEN size({EXTRA_FIELDS}) > 0 THEN parse_json(value) END AS {RESCUED}",
        SOURCE_FILE,
    )


def drift_report(rescued: DataFrame) -> DataFrame:
    """(field, kind, source_file, n_rows) of the fields outside the contract ("extra"), and of
    the contract's fields that a file never has ("missing").

    One aggregate over the rows that have such fields, one over all; both are partial in
    each task, and a file has a row per field at most.
    """
    extra = (
        rescued.where(f"size({EXTRA_FIELDS}) > 0")
        .selectExpr(SOURCE_FILE, f"explode({EXTRA_FIELDS}) AS field")
        .groupBy("field", SOURCE_FILE)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .selectExpr("field", "'extra' AS kind", f"{SOURCE_FILE} AS source_file", "n_rows")
    )
    counts = rescued.groupBy(SOURCE_FILE).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(F.col(c)).alias(c) for c in BRONZE_COLUMNS])
    pairs = ", ".join(f"'{c}', {ident(c)}" for c in BRONZE_COLUMNS)
    missing = (
        counts.selectExpr(SOURCE_FILE, "n_rows", f"stack({len(BRONZE_COLUMNS)}, {pairs}) AS (field, n)")
        .where("n = 0")
        .selectExpr("field", "'missing' AS kind", f"{SOURCE_FILE} AS source_file", "n_rows")
    )
    return extra.unionByName(missing)


def write_landing(df: DataFrame, path: str, partition_by: str | None = None) -> str:
    """Write rows as JSON Lines (many part files, one object per line)."""
    writer = df.write.mode("overwrite").option("compression", "none")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.json(path)
    return path


def union_years(frames: list[DataFrame]) -> DataFrame:
    """Append yearly data sets (UNION ALL by column name); columns a year lacks are NULL."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.select(*[(F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c)) for c in BRONZE_COLUMNS])
