"""Table sinks and contract-ordered scans for silver and gold.

Tables are partitioned by ``YEAR_DATE``, so a read that names a year touches only its
files. Rows are rebalanced by the partition column before the write: AQE merges small
years into few files and splits large ones over many tasks. Within a task rows are
sorted by the read-side filter columns. A table is a path, or with ``table`` a named
table of the session's catalog; the file format and the writer's options are free.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.expr import ident

PARTITION_COLUMN = "YEAR_DATE"


def write_table(
    df: DataFrame,
    path: str | None,
    cluster_by: list[str] | None = None,
    partition_by: str | None = PARTITION_COLUMN,
    dynamic_overwrite: bool = False,
    table: str | None = None,
    fmt: str = "parquet",
    observe: Callable[[DataFrame], DataFrame] | None = None,
    **options: str,
) -> str:
    """Overwrite ``path`` (or the named ``table``) with ``df``; ``dynamic_overwrite``
    replaces only the years present. ``observe`` is applied to the rows as they are
    written, behind the last exchange."""
    out = df.hint("rebalance", partition_by) if partition_by else df
    if cluster_by:
        out = out.sortWithinPartitions(*([partition_by] if partition_by else []), *cluster_by)
    if observe:
        out = observe(out)
    writer = out.write.format(fmt).mode("overwrite").options(**options).option(
        "partitionOverwriteMode", "dynamic" if dynamic_overwrite else "static"
    )
    if partition_by:
        writer = writer.partitionBy(partition_by)
    spark = df.sparkSession
    if table and dynamic_overwrite and spark.catalog.tableExists(table):
        # insertInto takes no write mode of its own, so the years go to the table's folder.
        rows = spark.sql("DESCRIBE TABLE EXTENDED IDENTIFIER(:t)", args={"t": table}).where("col_name = 'Location'").collect()
        writer.save(rows[0]["data_type"])
        spark.sql("ALTER TABLE IDENTIFIER(:t) RECOVER PARTITIONS", args={"t": table})
        spark.catalog.refreshTable(table)
        return table
    if table:
        (writer.option("path", path) if path else writer).saveAsTable(table)
        return table
    writer.save(path)
    return path


def read_table(
    spark: SparkSession, path: str | None, schema: T.StructType, table: str | None = None, fmt: str = "parquet", **options: str
) -> DataFrame:
    """Scan a written table with its contract schema, columns back in contract order.

    ``partitionBy`` moves the partition column to the end on read; the explicit
    schema keeps its type (DATE) and the final select restores the order. A named
    table brings its own schema. A table of the job's output root is read as its latest
    snapshot has it.
    """
    if path and not table:
        from .snapshots import load_snapshot, read_snapshot

        root, _, name = path.rstrip("/").rpartition("/")
        snapshot = load_snapshot(spark, root) if root else None
        if snapshot and name in snapshot.tables:
            return read_snapshot(spark, root, name, schema, snapshot.number)
    if table:
        df = spark.read.options(**options).table(table)
    else:
        df = spark.read.format(fmt).schema(schema).options(**options).load(path)
    return df.selectExpr(*[ident(f.name) for f in schema.fields])


def write_bucketed(df: DataFrame, table: str, bucket_by: list[str], buckets: int, partition_by: str | None = PARTITION_COLUMN, path: str | None = None) -> str:
    """Overwrite the named catalog table with ``df``, bucketed and sorted by ``bucket_by``.

    Rows are dealt to the buckets' hash before the write, so a bucket of a partition is one
    file. Aggregations and joins by ``bucket_by`` (or more columns) read their buckets in
    place: no exchange. A key with very many rows makes one large bucket, so bucket by a
    key whose groups are small against a partition, like the provider.
    """
    out = df.repartition(buckets, *bucket_by)
    writer = out.write.format("parquet").mode("overwrite").bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return table


def is_empty(df: DataFrame) -> bool:
    """True when the frame has no rows (reads at most one row)."""
    return df.isEmpty()
