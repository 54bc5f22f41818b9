"""The batch job: bronze -> silver -> gold provider + gold state, committed together.

The raw table is scanned and typed once: silver is written, and the gold state (summed
parts of every measure by provider key, see ``operators.gold``) is aggregated from it.
Both gold tables are finished from that state, which is much smaller than silver. All
tables of a load, its audit included, become visible at once (``sources.snapshots``).

    python -m carepulse.plans.job --bronze PATH [--format parquet|json|table] --out ROOT
    python -m carepulse.plans.job --bronze PATH --out ROOT --dynamic-overwrite   # replace the years of this input
    python -m carepulse.plans.job --bronze PATH --out ROOT --add                 # records that were not there before
    python -m carepulse.plans.job --bronze STREAMED --incremental --out ROOT     # what the ledger has since the last run
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..contracts import gold_provider_schema, gold_state_schema, silver_schema
from ..operators.gold import finish_gold_provider, finish_gold_state, gold_parts_schema, gold_state_parts, merge_gold_states
from ..operators.serve import episode_sketches
from ..operators.silver import CELLS, audit_metrics, audit_of_metrics, build_silver_with_cells
from ..sources.bronze import corrupt_landing_lines, drift_report, read_bronze, read_landing_rescued
from ..sources.sinks import read_table, write_bucketed
from ..sources.snapshots import UNDATED, Load, load_snapshot, read_folders, read_snapshot
from ..streaming.incremental import BATCH, arrivals, corrupt_lines, newest_drop, read_loaded, resends


# Settings for a large run, applied by the job's entry point only where the
# submitter set nothing: start shuffles wide and let AQE coalesce them (AQE can
# merge small partitions but not split a stage that started with too few), size
# scan splits and shuffle partitions to fit executor memory, and split skewed
# join partitions at run time.
SCALE_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "512m",
}


def settings_to_apply(explicit: set[str]) -> dict[str, str]:
    """The scale defaults the submitter did not set explicitly."""
    return {k: v for k, v in SCALE_DEFAULTS.items() if k not in explicit}


TABLES = ("silver", "gold_parts", "gold_provider", "gold_state", "gold_sketches")
_SILVER_ORDER = ["summary_category", "provider_state", "service_category"]
_GOLD_ORDER = ["service_category", "provider_state"]


def run_job(
    spark: SparkSession,
    bronze: DataFrame,
    out_root: str,
    dynamic_overwrite: bool = False,
    quarantine: DataFrame | None = None,
    load: str | None = None,
    add: bool = False,
    touched: set[str] | None = None,
    last_batch: int | None = None,
    drift: DataFrame | None = None,
) -> dict:
    """One load: silver, the gold state, both gold tables and the audit, as the next snapshot
    of ``out_root``; returns their paths (the audit's, and the quarantine's, is this load's).

    By default the tables hold this load only. With ``dynamic_overwrite`` it replaces the
    years it has rows of (and those of ``touched``, as partition values); with ``add`` its
    rows are records that were not there before: they join silver, and their gold state is
    merged with that of their years, so silver written earlier is not read. Rows without a
    valid year replace those of the load of the same name (``load``; by default the plan's
    hash), of all loads if ``touched`` names them. ``quarantine`` holds lines that did not
    parse, ``drift`` a report of fields outside the contract. If anything fails, what readers see stays as it was.
    """
    if add and dynamic_overwrite:
        raise ValueError("a load either adds records or replaces years")
    name = load if load is not None else f"plan-{bronze.semanticHash()}"
    run = Load(spark, out_root, name, "add" if add else "years" if dynamic_overwrite else "all")
    audited = Observation()
    years = run.write(
        "silver",
        build_silver_with_cells(bronze),
        cluster_by=_SILVER_ORDER,
        touched=touched,
        observe=lambda rows: rows.observe(audited, *audit_metrics()).drop(CELLS),
    )
    own = read_folders(spark, out_root, "silver", [f"silver/{run.folder}/YEAR_DATE={y}" for y in sorted(years)], silver_schema())
    changed = years | (touched or set())
    if add:
        # Untouched years are not read, nor are earlier rows of the touched ones.
        earlier = run.read("gold_parts", gold_parts_schema(), years)
        parts = merge_gold_states(gold_state_parts(own).unionByName(earlier))
    elif UNDATED in years and dynamic_overwrite:
        # Undated rows of other loads count into the same groups.
        undated = run.read("silver", silver_schema(), {UNDATED})
        parts = gold_state_parts(own.where("YEAR_DATE IS NOT NULL").unionByName(undated))
    else:
        parts = gold_state_parts(own)
    run.write("gold_parts", parts, cluster_by=_GOLD_ORDER, replace="years", touched=changed)
    state = run.read("gold_parts", gold_parts_schema(), changed)
    for table, finish in (("gold_provider", finish_gold_provider), ("gold_state", finish_gold_state)):
        run.write(table, finish(state), cluster_by=_GOLD_ORDER, replace="years", touched=changed)
    run.write("gold_sketches", episode_sketches(run.read("gold_provider", gold_provider_schema(), changed)), replace="years", touched=changed)
    paths = {table: f"{out_root}/{table}" for table in TABLES}
    # Taken while silver was written; of a load without rows nothing was observed.
    paths["audit"] = run.write_history("audit", audit_of_metrics(spark, audited.get if years else {}))
    if drift is not None:
        paths["drift"] = run.write_history("drift", drift)
    if quarantine is not None:
        paths["quarantine"] = run.write_history("quarantine", quarantine)
    run.commit(last_batch)
    return paths


def run_arrivals(spark: SparkSession, streamed: str, out_root: str) -> dict | None:
    """Carries the streamed table's drops that arrived since the last snapshot on to silver
    and gold; None if there are none.

    Only the years that the ledger names are read. If no record of theirs was there before,
    the new rows are added and their gold state merged; else these years are resolved anew
    (the newest arrival of each record counts) and replaced.
    """
    before = load_snapshot(spark, out_root)
    after = before.last_batch if before else None
    news = arrivals(spark, streamed, after)
    if news.last_batch is None:
        return None
    loaded = read_loaded(spark, streamed).where(F.col(BATCH) <= news.last_batch)
    name = f"batches to {news.last_batch}"
    if after is None:
        return run_job(spark, newest_drop(loaded, by="arrival"), out_root, quarantine=corrupt_lines(loaded), load=name, last_batch=news.last_batch)
    new = loaded.where(F.col(BATCH) > after)
    bad = corrupt_lines(new)
    if not resends(loaded, after, news.years, news.undated):
        rows = newest_drop(new, by="arrival")
        return run_job(spark, rows, out_root, quarantine=bad, load=name, add=True, last_batch=news.last_batch)
    rows = newest_drop(loaded, years=news.years, by="arrival", undated=news.undated)
    touched = {f"{y:04d}-01-01" for y in news.years} | ({UNDATED} if news.undated else set())
    return run_job(spark, rows, out_root, True, bad, load=name, touched=touched, last_batch=news.last_batch)


def audit_history(spark: SparkSession, out_root: str) -> DataFrame:
    """The audits of all loads that the latest snapshot has, with the load's name."""
    snapshot = load_snapshot(spark, out_root)
    audits = snapshot.tables["audit"][""]
    name_of = F.create_map(*[F.lit(x) for n, f in audits.items() for x in (f[0].split("load=")[1], n)])
    paths = [f"{out_root}/{f}" for fs in audits.values() for f in fs]
    rows = spark.read.option("basePath", f"{out_root}/audit").parquet(*paths)
    return rows.withColumn("load_name", name_of[F.col("load").cast("string")]).drop("load")


def publish(spark: SparkSession, out_root: str, database: str, buckets: int, prefix: str = "") -> list[str]:
    """The latest snapshot's tables as named catalog tables: silver and gold provider
    bucketed by provider, gold state by state. Returns their names."""
    made = []
    for table, schema, keys in (
        ("silver", silver_schema(), ["provider_id"]),
        ("gold_provider", gold_provider_schema(), ["provider_id"]),
        ("gold_state", gold_state_schema(), ["provider_state"]),
    ):
        made.append(write_bucketed(read_snapshot(spark, out_root, table, schema), f"{database}.{prefix}{table}", keys, buckets))
    return made


def read_gold(spark: SparkSession, paths: dict) -> tuple[DataFrame, DataFrame]:
    """(gold provider, gold state) read back with their contracts, in contract column order."""
    return (
        read_table(spark, paths["gold_provider"], gold_provider_schema()),
        read_table(spark, paths["gold_state"], gold_state_schema()),
    )


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--bronze", required=True)
    ap.add_argument("--format", default="parquet")
    ap.add_argument("--option", action="append", default=[], metavar="KEY=VALUE", help="an option of the input's reader")
    ap.add_argument("--incremental", action="store_true", help="--bronze is a streamed table: take what arrived since the last run")
    ap.add_argument("--out", required=True)
    ap.add_argument("--dynamic-overwrite", action="store_true", help="replace only the years present")
    ap.add_argument("--add", action="store_true", help="the input's records were not there before: merge them")
    ap.add_argument("--load", help="name of the load (its undated rows replace those of the same name); default: the input")
    ap.add_argument("--database", help="also publish the tables as named, bucketed tables of this database")
    ap.add_argument("--buckets", type=int, default=200)
    ap.add_argument("--prefix", default="", help="of the published tables' names")
    ap.add_argument("--drift", action="store_true", help="report fields outside the contract of a json input")
    args = ap.parse_args(argv)
    joined = SparkSession.getActiveSession()
    spark = SparkSession.builder.appName("carepulse-job").getOrCreate()
    if joined is None:  # a session of our own; one we joined keeps its settings
        explicit = {k for k, _ in spark.sparkContext.getConf().getAll()}
        for key, value in settings_to_apply(explicit).items():
            spark.conf.set(key, value)
    options = dict(o.split("=", 1) for o in args.option)
    out = args.out.rstrip("/")
    if args.incremental:
        paths = run_arrivals(spark, args.bronze, out)
    else:
        bronze = read_bronze(spark, args.bronze, args.format, **options)
        quarantine = corrupt_landing_lines(spark, [args.bronze], **options) if args.format == "json" else None
        drift = drift_report(read_landing_rescued(spark, [args.bronze])) if args.drift and args.format == "json" else None
        paths = run_job(spark, bronze, out, args.dynamic_overwrite, quarantine, load=args.load or args.bronze, add=args.add, drift=drift)
    print(paths or "nothing new")
    if args.database and paths:
        print(publish(spark, out, args.database, args.buckets, args.prefix))


if __name__ == "__main__":
    main()
