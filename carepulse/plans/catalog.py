"""Registered queries (Spark) and their DuckDB oracle statements.

Every query starts from the shared test tables: the bronze analog is derived by
Spark from them and written once per application (like the landing load), the
job then writes silver and gold, and the read-side queries scan those tables.
Writes go under the session's shared checkpoint folder.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contracts import (
    BRONZE_COLUMNS,
    GOLD_PROVIDER_BANDS,
    GOLD_PROVIDER_KEYS,
    GOLD_PROVIDER_RATIOS,
    PROVIDER_READ_COLUMNS,
    STATE_READ_COLUMNS,
    TOP_N,
    TOP_TABLE_COLUMNS,
    ZERO_FILL_COLUMNS,
    gold_provider_schema,
    gold_sketches_schema,
    gold_state_schema,
    silver_schema,
)
from ..functions.expr import aliased, ident, select_names, wide_sum_long_sql
from ..functions.sql import register_sql_functions, register_table_functions
from ..operators import serve
from ..operators.gold import (
    build_gold_provider,
    build_gold_state,
    finish_gold_provider,
    finish_gold_state,
    gold_provider_base,
    gold_state_parts,
    merge_gold_states,
)
from ..operators.silver import build_silver, provider_level, suppression_audit
from ..session import app_key, run_dir
from ..sources.bronze import drift_report, read_bronze, read_landing, read_landing_rescued, write_landing
from ..sources.fixtures import write_bronze_from_test_tables
from ..sources.sinks import read_table, write_bucketed
from ..sources.snapshots import read_snapshot
from ..streaming.incremental import load_available, newest_drop, read_ledger, read_loaded
from . import oracle as O
from .job import audit_history, read_gold, run_arrivals, run_job

# Slice parameters of the dashboard-style reads (present at every test scale).
YEAR = 1998
CATEGORY = "SNF"
STATE = "NATION_19"
# Years before this one are landed without the COPD column (an older file layout).
LEGACY_LAYOUT_BEFORE = 1996
# The split year of the incremental load is sent twice (see ``arrived``).
SPLIT_YEAR = 1998

_prepared: dict[tuple, dict] = {}
_lock = threading.Lock()


def prepared(spark: SparkSession, sf_dir: str) -> dict:
    """Bronze, silver and gold tables for ``sf_dir``, written once per application."""
    key = (app_key(spark), sf_dir)
    with _lock:
        if key not in _prepared:
            root = run_dir(spark, "tables")
            bronze_path = f"{root}/bronze"
            write_bronze_from_test_tables(spark, sf_dir, bronze_path)
            paths = run_job(spark, read_bronze(spark, bronze_path), root)
            paths["bronze"] = bronze_path
            _prepared[key] = paths
        return _prepared[key]


def bronze(spark, sf_dir) -> DataFrame:
    return select_names(read_bronze(spark, prepared(spark, sf_dir)["bronze"]), BRONZE_COLUMNS)


def silver(spark, sf_dir) -> DataFrame:
    """Silver computed from the bronze scan (the F1-F6 projection itself)."""
    return build_silver(bronze(spark, sf_dir))


def silver_table(spark, sf_dir) -> DataFrame:
    """The written silver table, as the job's gold builds read it (pruned Parquet columns)."""
    return read_table(spark, prepared(spark, sf_dir)["silver"], silver_schema())


def gold(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return read_gold(spark, prepared(spark, sf_dir))


# ------------------------------------------------------------------ the queries
def q_bronze_scan(spark, sf_dir):
    return bronze(spark, sf_dir)


def q_silver_typed(spark, sf_dir):
    return silver(spark, sf_dir)


def q_silver_suppression_audit(spark, sf_dir):
    # Valid counts come from the written silver table, so no cell is parsed twice.
    return suppression_audit(bronze(spark, sf_dir), silver_table(spark, sf_dir))


def q_provider_level_rows(spark, sf_dir):
    return provider_level(silver_table(spark, sf_dir))


def q_gold_provider_base(spark, sf_dir):
    return gold_provider_base(silver_table(spark, sf_dir))


def q_gold_provider_ratios(spark, sf_dir):
    return select_names(
        build_gold_provider(silver_table(spark, sf_dir)), GOLD_PROVIDER_KEYS + [r for r, _, _ in GOLD_PROVIDER_RATIOS]
    )


_BAND_INPUTS = ["avg_bene_risk_score", "avg_dual_pct", "avg_rural_pct"]


def q_gold_provider_bands(spark, sf_dir):
    return select_names(
        build_gold_provider(silver_table(spark, sf_dir)), GOLD_PROVIDER_KEYS + _BAND_INPUTS + GOLD_PROVIDER_BANDS
    )


def q_gold_provider_metrics(spark, sf_dir):
    return build_gold_provider(silver_table(spark, sf_dir))


def q_gold_state_summary(spark, sf_dir):
    return build_gold_state(silver_table(spark, sf_dir))


def q_state_summary_read(spark, sf_dir):
    _, gs = gold(spark, sf_dir)
    return serve.load_state_summary(gs, YEAR, CATEGORY)


def q_empty_slice_check(spark, sf_dir):
    """The dashboard's empty-result check, for a slice with rows and one without: each
    reads one row of its pruned slice at most."""
    _, gs = gold(spark, sf_dir)
    checks = [
        serve.load_state_summary(gs, YEAR, category).limit(1).selectExpr(f"'{category}' AS slice", "CAST(count(1) = 0 AS INT) AS is_empty")
        for category in (CATEGORY, "NONE")
    ]
    return checks[0].union(checks[1])


def q_job_audit(spark, sf_dir):
    """The audit table that the job writes beside silver and gold."""
    return spark.read.parquet(prepared(spark, sf_dir)["audit"])


def _view(df: DataFrame, prefix: str) -> str:
    """Register ``df`` under a fresh temporary view name (safe for concurrent callers)."""
    name = f"{prefix}_{uuid.uuid4().hex[:12]}"
    df.createOrReplaceTempView(name)
    return name


def q_state_summary_read_sql(spark, sf_dir):
    _, gs = gold(spark, sf_dir)
    return serve.load_state_summary_sql(spark, _view(gs, "carepulse_gold_state"), YEAR, CATEGORY)


def q_provider_read_one_state(spark, sf_dir):
    gp, _ = gold(spark, sf_dir)
    return serve.load_provider_metrics(gp, YEAR, STATE, CATEGORY)


def q_provider_read_all_states(spark, sf_dir):
    gp, _ = gold(spark, sf_dir)
    return serve.zero_fill(serve.load_provider_data(gp, YEAR, CATEGORY))


def q_national_kpis(spark, sf_dir):
    _, gs = gold(spark, sf_dir)
    return serve.national_kpis(gs)


def q_state_kpis(spark, sf_dir):
    gp, _ = gold(spark, sf_dir)
    return serve.state_kpis(gp)


def q_episodes_box_by_risk(spark, sf_dir):
    gp, _ = gold(spark, sf_dir)
    return serve.episodes_box_by_risk(gp)


def q_state_list(spark, sf_dir):
    _, gs = gold(spark, sf_dir)
    return serve.state_list(gs)


def q_states_ranked(spark, sf_dir):
    _, gs = gold(spark, sf_dir)
    return serve.states_ranked(gs)


def q_top_providers_one_state(spark, sf_dir):
    gp, _ = gold(spark, sf_dir)
    return serve.chart_order(serve.top_providers_of_slice(serve.load_provider_metrics(gp, YEAR, STATE, CATEGORY)))


def q_top_providers_zero_filled(spark, sf_dir):
    gp, _ = gold(spark, sf_dir)
    rows = serve.zero_fill(serve.load_provider_data(gp, YEAR, CATEGORY)).where(F.col("provider_state") == STATE)
    return serve.chart_order(serve.top_providers_of_slice(rows))


def q_top_providers_every_state(spark, sf_dir):
    gp, _ = gold(spark, sf_dir)
    return serve.top_providers(gp)


def q_silver_roundtrip(spark, sf_dir):
    return read_table(spark, prepared(spark, sf_dir)["silver"], silver_schema())


def q_jsonl_roundtrip(spark, sf_dir):
    path = f"{run_dir(spark, 'jsonl')}/landing"
    write_landing(bronze(spark, sf_dir), path)
    return read_landing(spark, [path])


def q_multi_year_union(spark, sf_dir):
    """Each year lands as its own JSON Lines data set; older years lack one column.
    The data sets are read back together as one bag union."""
    root = f"{run_dir(spark, 'years')}/landing"
    b = bronze(spark, sf_dir)
    legacy = f"try_cast(`YEAR` AS INT) < {LEGACY_LAYOUT_BEFORE}"
    drops = b.selectExpr(
        *[
            (aliased(f"CASE WHEN NOT ({legacy}) THEN {ident(c)} END", c) if c == "BENE_CC_PH_COPD_V2_PCT" else ident(c))
            for c in BRONZE_COLUMNS
        ],
        "`YEAR` AS landing_year",
    )
    write_landing(drops, root, partition_by="landing_year")
    # Every yearly data set under the landing root, read together (a glob, so no
    # list of years has to come back to the driver).
    return read_landing(spark, [f"{root}/landing_year=*"])


def arrived(spark: SparkSession, sf_dir: str) -> dict:
    """A streamed table and the tables carried on from it, once per application.

    Three drops arrive one after the other, each written by Spark as several part files:
    the years up to SPLIT_YEAR with wrong service days in that year; the later years (all
    records new, so they are merged); SPLIT_YEAR again, rightly (resolved anew). The names
    say nothing about the order.
    """
    key = (app_key(spark), sf_dir, "arrived")
    all_rows = bronze(spark, sf_dir)
    with _lock:
        if key not in _prepared:
            root = run_dir(spark, "stream")
            landing, table, ckpt, out = (f"{root}/{d}" for d in ("landing", "bronze", "checkpoint", "tables"))
            year = F.col("YEAR").try_cast("int")
            wrong = F.when(year == SPLIT_YEAR, F.lit("1")).otherwise(F.col("TOT_SRVC_DAYS"))
            drops = [
                ("drop-9", all_rows.where(year <= SPLIT_YEAR).withColumn("TOT_SRVC_DAYS", wrong)),
                ("drop-10", all_rows.where(year > SPLIT_YEAR)),
                ("again", all_rows.where(year == SPLIT_YEAR)),
            ]
            for name, rows in drops:
                # As many part files as bronze has splits: no shuffle, and no limit to the tasks.
                rows.write.option("compression", "gzip").json(f"{landing}/{name}")
                load_available(spark, landing, table, ckpt)
                run_arrivals(spark, table, out)
            _prepared[key] = {"bronze": table, "out": out}
        return _prepared[key]


def q_incremental_bronze(spark, sf_dir):
    """The drops as landed, resolved by arrival: the record sent last counts, and none twice."""
    return newest_drop(read_loaded(spark, arrived(spark, sf_dir)["bronze"]), by="arrival")


def q_load_ledger(spark, sf_dir):
    """The ledger of the drops: the order of arrival, rows and years touched."""
    ledger = read_ledger(spark, arrived(spark, sf_dir)["bronze"])
    return ledger.select(
        F.col("_drop").alias("drop_name"),
        F.dense_rank().over(Window.orderBy("_sequence")).cast("long").alias("arrival"),
        "n_rows",
        "n_corrupt",
        F.array_join(F.col("years").cast("array<string>"), ",").alias("years"),
        F.col("undated").cast("int").alias("undated"),
    )


def q_arrivals_gold_provider(spark, sf_dir):
    """Gold provider after the drops were carried on one by one (added, merged, replaced)."""
    return read_snapshot(spark, arrived(spark, sf_dir)["out"], "gold_provider", gold_provider_schema())


def q_arrivals_gold_state(spark, sf_dir):
    return read_snapshot(spark, arrived(spark, sf_dir)["out"], "gold_state", gold_state_schema())


def q_arrivals_audit_history(spark, sf_dir):
    """The audits of all three loads, by the ledger batch they end with."""
    return audit_history(spark, arrived(spark, sf_dir)["out"])


def _merged_state(spark, sf_dir):
    """The gold state merged from the states of the fiscal and the calendar rows."""
    rows = silver_table(spark, sf_dir)
    parts = [gold_state_parts(rows.where(c)) for c in ("YEAR_TYPE = 'FY'", "YEAR_TYPE IS DISTINCT FROM 'FY'")]
    return merge_gold_states(parts[0].unionByName(parts[1]))


def q_merged_gold_provider(spark, sf_dir):
    return finish_gold_provider(_merged_state(spark, sf_dir))


def q_merged_gold_state(spark, sf_dir):
    return finish_gold_state(_merged_state(spark, sf_dir))


def q_sql_function_ratio(spark, sf_dir):
    register_sql_functions(spark)
    _, gs = gold(spark, sf_dir)
    view = _view(gs, "carepulse_gold_state")
    return spark.sql(
        f"""
        SELECT `YEAR`, service_category, provider_state,
               safe_div(total_medicare_payment_amt, total_distinct_benes) AS pay_per_bene_sql,
               kpi_div(total_medicare_payment_amt, total_service_days) AS pay_per_service_day_kpi
        FROM {view}
        """
    )


SKETCH_BOX_KEYS = ["service_category", "provider_state", "risk_band"]


def q_episodes_box_all_years(spark, sf_dir):
    """The box summary over all years, from the stored sketches of the slices."""
    sketches = read_table(spark, prepared(spark, sf_dir)["gold_sketches"], gold_sketches_schema())
    return serve.episodes_box_of_sketches(sketches, SKETCH_BOX_KEYS)


def q_provider_read_selections(spark, sf_dir):
    """Provider rows of many slices at once; the slices are read from a table."""
    gp, gs = gold(spark, sf_dir)
    return serve.load_slices(gp, gs.where(_SELECTION).select("YEAR", "service_category", "provider_state"), PROVIDER_READ_COLUMNS)


def q_state_read_selections(spark, sf_dir):
    """State summary rows of whole (year, category) slices that hold one state's low payments."""
    _, gs = gold(spark, sf_dir)
    return serve.load_slices(gs, gs.where(_SELECTION).select("YEAR", "service_category"), STATE_READ_COLUMNS)


_SELECTION = f"`YEAR` >= {YEAR} AND provider_state = '{STATE}' AND service_category <> 'HH'"


def _table_functions(spark, sf_dir):
    gp, gs = gold(spark, sf_dir)
    register_sql_functions(spark)
    register_table_functions(spark, _view(gp, "carepulse_gold_provider"), _view(gs, "carepulse_gold_state"))


def q_sql_top_slice(spark, sf_dir):
    """Top providers of every state of one slice through the SQL table function, with the
    bands recomputed by the scalar ones."""
    _table_functions(spark, sf_dir)
    return spark.sql(
        f"SELECT t.provider_id, t.pay_rank, t.pay_per_bene, t.risk_band, risk_band(t.avg_bene_risk_score) AS risk_band_sql "
        f"FROM top_slice({YEAR}L, '{CATEGORY}', NULL, {TOP_N}) t"
    )


def q_sql_state_slice(spark, sf_dir):
    _table_functions(spark, sf_dir)
    return spark.sql(f"SELECT * FROM state_slice({YEAR}L, '{CATEGORY}')")


def q_sql_provider_slice(spark, sf_dir):
    _table_functions(spark, sf_dir)
    return spark.sql(f"SELECT * FROM provider_slice({YEAR}L, '{CATEGORY}', '{STATE}')")


# Fields that the landed rows bear beside the contract, from DRIFT_YEAR on.
DRIFT_YEAR = 1999


def q_landing_drift(spark, sf_dir):
    """Rows of later years bear a new field, and one field under a new name; the rescued
    values and the report's counts per field."""
    root = f"{run_dir(spark, 'drift')}/landing"
    later = f"try_cast(`YEAR` AS INT) >= {DRIFT_YEAR}"
    cols = [c for c in BRONZE_COLUMNS if c != "PRVDR_CITY"]
    landed = bronze(spark, sf_dir).selectExpr(
        *[ident(c) for c in cols],
        f"CASE WHEN NOT ({later}) THEN PRVDR_CITY END AS PRVDR_CITY",
        f"CASE WHEN {later} THEN PRVDR_CITY END AS PRVDR_TOWN",
        f"CASE WHEN {later} THEN named_struct('open', TOT_EPSD_STAY_CNT) END AS BEDS",
    )
    write_landing(landed, root)
    rescued = read_landing_rescued(spark, [root])
    values = rescued.groupBy(
        "YEAR", F.expr("variant_get(_rescued, '$.PRVDR_TOWN', 'string') AS town")
    ).agg(F.count(F.lit(1)).alias("n"), F.expr("coalesce(sum(variant_get(_rescued, '$.BEDS.open', 'bigint')), 0L) AS beds"))
    fields = drift_report(rescued).where("kind = 'extra'").groupBy("field").agg(F.sum("n_rows").alias("n"))
    return values.selectExpr("'value' AS kind", "`YEAR` AS name", "town", "n", "beds").unionByName(
        fields.selectExpr("'field' AS kind", "field AS name", "CAST(NULL AS STRING) AS town", "n", "0L AS beds")
    )


def q_bucketed_provider_totals(spark, sf_dir):
    """Silver as a bucketed catalog table, aggregated by provider without an exchange."""
    key = (app_key(spark), sf_dir, "bucketed")
    out = prepared(spark, sf_dir)["silver"].rpartition("/")[0]
    with _lock:
        if key not in _prepared:
            name = f"carepulse_silver_{uuid.uuid4().hex[:12]}"
            rows = read_table(spark, f"{out}/silver", silver_schema())
            write_bucketed(rows, name, ["provider_id"], 8, path=f"{run_dir(spark, 'bucketed')}/silver")
            _prepared[key] = {"table": name}
        name = _prepared[key]["table"]
    rows = provider_level(read_table(spark, None, silver_schema(), table=name))
    return rows.groupBy("provider_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.expr(f"{wide_sum_long_sql('total_service_days')} AS total_service_days")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "bronze_scan": q_bronze_scan,
    "silver_typed": q_silver_typed,
    "silver_suppression_audit": q_silver_suppression_audit,
    "provider_level_rows": q_provider_level_rows,
    "gold_provider_base": q_gold_provider_base,
    "gold_provider_ratios": q_gold_provider_ratios,
    "gold_provider_bands": q_gold_provider_bands,
    "gold_provider_metrics": q_gold_provider_metrics,
    "gold_state_summary": q_gold_state_summary,
    "state_summary_read": q_state_summary_read,
    "state_summary_read_sql": q_state_summary_read_sql,
    "empty_slice_check": q_empty_slice_check,
    "job_audit": q_job_audit,
    "provider_read_one_state": q_provider_read_one_state,
    "provider_read_all_states": q_provider_read_all_states,
    "national_kpis": q_national_kpis,
    "state_kpis": q_state_kpis,
    "episodes_box_by_risk": q_episodes_box_by_risk,
    "state_list": q_state_list,
    "states_ranked": q_states_ranked,
    "top_providers_one_state": q_top_providers_one_state,
    "top_providers_zero_filled": q_top_providers_zero_filled,
    "top_providers_every_state": q_top_providers_every_state,
    "silver_roundtrip": q_silver_roundtrip,
    "jsonl_roundtrip": q_jsonl_roundtrip,
    "multi_year_union": q_multi_year_union,
    "incremental_bronze": q_incremental_bronze,
    "load_ledger": q_load_ledger,
    "arrivals_gold_provider": q_arrivals_gold_provider,
    "arrivals_gold_state": q_arrivals_gold_state,
    "arrivals_audit_history": q_arrivals_audit_history,
    "merged_gold_provider": q_merged_gold_provider,
    "merged_gold_state": q_merged_gold_state,
    "sql_function_ratio": q_sql_function_ratio,
    "episodes_box_all_years": q_episodes_box_all_years,
    "provider_read_selections": q_provider_read_selections,
    "state_read_selections": q_state_read_selections,
    "sql_top_slice": q_sql_top_slice,
    "sql_state_slice": q_sql_state_slice,
    "sql_provider_slice": q_sql_provider_slice,
    "landing_drift": q_landing_drift,
    "bucketed_provider_totals": q_bucketed_provider_totals,
}


# ------------------------------------------------------------------- the oracle
def _kpis_sql(src: str, keys: list[str]) -> str:
    k = O.cols(keys)
    return f"""SELECT {k},
  coalesce(CAST(sum(CAST(total_medicare_payment_amt AS DECIMAL(38,4))) AS DOUBLE), 0) AS total_medicare_payment_amt,
  coalesce({O.long_sum_sql("total_distinct_benes")}, 0) AS total_distinct_benes,
  coalesce({O.long_sum_sql("total_service_days")}, 0) AS total_service_days,
  coalesce(CAST(sum(CAST(total_medicare_payment_amt AS DECIMAL(38,4))) AS DOUBLE)
           / NULLIF(CAST({O.long_sum_sql("total_distinct_benes")} AS DOUBLE), 0), 0) AS avg_pay_per_bene,
  coalesce(CAST(sum(CAST(total_medicare_payment_amt AS DECIMAL(38,4))) AS DOUBLE)
           / NULLIF(CAST({O.long_sum_sql("total_service_days")} AS DOUBLE), 0), 0) AS avg_pay_per_service_day
FROM {src} GROUP BY {k}"""


def _zero_filled_select(columns: list[str]) -> str:
    fill = set(ZERO_FILL_COLUMNS)
    return ", ".join(
        f"coalesce(TRY_CAST({O.q(c)} AS DOUBLE), 0) AS {O.q(c)}" if c in fill else O.q(c) for c in columns
    )


_TOP_KEYS = ["YEAR", "service_category", "provider_state"]
_TOP_ORDER = "pay_per_bene DESC NULLS LAST, provider_id ASC NULLS LAST, provider_name ASC NULLS LAST"


def _top_sql(src: str) -> str:
    return (
        f"SELECT {O.cols(_TOP_KEYS + TOP_TABLE_COLUMNS)}, pay_rank FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY {O.cols(_TOP_KEYS)} ORDER BY {_TOP_ORDER}) AS pay_rank "
        f"FROM {src}) t WHERE pay_rank <= {TOP_N}"
    )


_SLICE = f"\"YEAR\" = {YEAR} AND service_category = '{CATEGORY}'"
_BOX_KEYS = ["YEAR", "service_category", "provider_state", "risk_band"]


def _box_sql() -> str:
    k = O.cols(_BOX_KEYS)
    join = " AND ".join(f"v.{O.q(c)} IS NOT DISTINCT FROM f.{O.q(c)}" for c in _BOX_KEYS)
    inside = "(v.x >= f.lf AND v.x <= f.uf)"

    def quantile(p: float) -> str:
        """Linear between neighbours by definition: low + (high - low) * fraction (an
        engine's own quantile function may round the last digit another way)."""
        at = f"({p} * (n - 1))::DOUBLE"
        low, high = (f"xs[CAST({f}({at}) AS BIGINT) + 1]" for f in ("floor", "ceil"))
        return f"{low} + ({high} - {low}) * ({at} - floor({at}))"

    return f""", bx_v AS (SELECT {k}, coalesce(TRY_CAST(episodes_per_bene AS DOUBLE), 0) AS x FROM gold_provider),
bx_l AS (SELECT {k}, count(x) AS n, list(x ORDER BY x) AS xs FROM bx_v GROUP BY {k}),
bx_q AS (
  SELECT {k}, n, xs[1] AS "min", {quantile(0.25)} AS q1, {quantile(0.5)} AS median, {quantile(0.75)} AS q3, xs[n] AS "max"
  FROM bx_l),
bx_f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM bx_q)
SELECT {", ".join(f"f.{O.q(c)}" for c in _BOX_KEYS)}, f.n, f."min", f.q1, f.median, f.q3, f."max",
  min(v.x) FILTER (WHERE {inside}) AS lower_whisker,
  max(v.x) FILTER (WHERE {inside}) AS upper_whisker,
  count(*) FILTER (WHERE NOT {inside}) AS n_outliers
FROM bx_f f JOIN bx_v v ON {join}
GROUP BY {", ".join(f"f.{O.q(c)}" for c in _BOX_KEYS)}, f.n, f."min", f.q1, f.median, f.q3, f."max\""""


def _sketched_box_oracle() -> str:
    """Quantiles as the least value with at least that share at or below it."""
    k = O.cols(SKETCH_BOX_KEYS)
    q = {p: f"xs[CAST(greatest(ceil({p} * n), 1) AS BIGINT)]" for p in (0.25, 0.5, 0.75)}
    return O.with_all("").rstrip() + f""", bx_l AS (
  SELECT {k}, count(*) AS n, list(x ORDER BY x) AS xs
  FROM (SELECT {k}, coalesce(TRY_CAST(episodes_per_bene AS DOUBLE), 0) AS x FROM gold_provider) t GROUP BY {k}),
bx_q AS (SELECT *, {q[0.25]} AS q1, {q[0.5]} AS median, {q[0.75]} AS q3 FROM bx_l),
bx_f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM bx_q)
SELECT {k}, n, xs[1] AS "min", q1, median, q3, xs[n] AS "max", lower_fence, upper_fence FROM bx_f"""


def _box_oracle() -> str:
    # The box CTEs extend the shared WITH list.
    full = O.with_all("")
    return full.rstrip() + _box_sql()


def _multi_year_sql() -> str:
    cols = ", ".join(
        f"CASE WHEN TRY_CAST(\"YEAR\" AS INTEGER) < {LEGACY_LAYOUT_BEFORE} THEN NULL ELSE {c} END AS {c}"
        if c == "BENE_CC_PH_COPD_V2_PCT"
        else O.q(c)
        for c in BRONZE_COLUMNS
    )
    return O.with_all(f"SELECT {cols} FROM bronze")


def oracle_statements() -> dict[str, str]:
    w = O.with_all
    keys_ratios = O.cols(GOLD_PROVIDER_KEYS + [r for r, _, _ in GOLD_PROVIDER_RATIOS])
    keys_bands = O.cols(GOLD_PROVIDER_KEYS + _BAND_INPUTS + GOLD_PROVIDER_BANDS)
    one_state = f"{_SLICE} AND provider_state = '{STATE}'"
    return {
        "bronze_scan": w("SELECT * FROM bronze"),
        "silver_typed": w("SELECT * FROM silver"),
        "silver_suppression_audit": O.audit_sql(),
        "job_audit": O.audit_sql(),
        "empty_slice_check": w(
            " UNION ALL ".join(
                f"SELECT '{c}' AS slice, CAST(count(*) = 0 AS INTEGER) AS is_empty FROM "
                f"(SELECT 1 FROM gold_state WHERE \"YEAR\" = {YEAR} AND service_category = '{c}' LIMIT 1)"
                for c in (CATEGORY, "NONE")
            )
        ),
        "provider_level_rows": w("SELECT * FROM silver WHERE summary_category = 'PROVIDER'"),
        "gold_provider_base": w("SELECT * FROM gp_base"),
        "gold_provider_ratios": w(f"SELECT {keys_ratios} FROM gold_provider"),
        "gold_provider_bands": w(f"SELECT {keys_bands} FROM gold_provider"),
        "gold_provider_metrics": w(f"SELECT {O.GOLD_PROVIDER_COLS} FROM gold_provider"),
        "gold_state_summary": w(f"SELECT {O.GOLD_STATE_COLS} FROM gold_state"),
        "state_summary_read": w(f"SELECT {O.cols(STATE_READ_COLUMNS)} FROM gold_state WHERE {_SLICE}"),
        "state_summary_read_sql": w(f"SELECT {O.cols(STATE_READ_COLUMNS)} FROM gold_state WHERE {_SLICE}"),
        "provider_read_one_state": w(f"SELECT {O.cols(PROVIDER_READ_COLUMNS)} FROM gold_provider WHERE {one_state}"),
        "provider_read_all_states": w(
            f"SELECT {_zero_filled_select(PROVIDER_READ_COLUMNS)} FROM gold_provider WHERE {_SLICE}"
        ),
        "national_kpis": w(_kpis_sql("gold_state", ["YEAR", "service_category"])),
        "state_kpis": w(_kpis_sql("gold_provider", ["YEAR", "service_category", "provider_state"])),
        "episodes_box_by_risk": _box_oracle(),
        "state_list": w('SELECT DISTINCT "YEAR", service_category, provider_state FROM gold_state'),
        "states_ranked": w(
            f"SELECT {O.cols(STATE_READ_COLUMNS)}, row_number() OVER (PARTITION BY \"YEAR\", service_category "
            "ORDER BY pay_per_bene DESC NULLS LAST, provider_state ASC NULLS LAST) AS pay_rank FROM gold_state"
        ),
        "top_providers_one_state": w(_top_sql(f"(SELECT * FROM gold_provider WHERE {one_state})")),
        "top_providers_zero_filled": w(
            _top_sql(
                f"(SELECT {_zero_filled_select(PROVIDER_READ_COLUMNS)} FROM gold_provider WHERE {one_state})"
            )
        ),
        "top_providers_every_state": w(_top_sql("gold_provider")),
        "silver_roundtrip": w("SELECT * FROM silver"),
        "jsonl_roundtrip": w("SELECT * FROM bronze"),
        "multi_year_union": _multi_year_sql(),
        "incremental_bronze": w("SELECT * FROM bronze"),
        "load_ledger": w(
            "SELECT drop_name, CAST(arrival AS BIGINT) AS arrival, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_corrupt, "
            "string_agg(DISTINCT \"YEAR\", ',' ORDER BY \"YEAR\") AS years, 0 AS undated FROM bronze JOIN "
            f"(VALUES ('drop-9', 1, 0, {SPLIT_YEAR}), ('drop-10', 2, {SPLIT_YEAR + 1}, 9999), ('again', 3, {SPLIT_YEAR}, {SPLIT_YEAR})) "
            'd(drop_name, arrival, lo, hi) ON TRY_CAST("YEAR" AS INTEGER) BETWEEN lo AND hi GROUP BY 1, 2'
        ),
        "arrivals_gold_provider": w(f"SELECT {O.GOLD_PROVIDER_COLS} FROM gold_provider"),
        "arrivals_gold_state": w(f"SELECT {O.GOLD_STATE_COLS} FROM gold_state"),
        "arrivals_audit_history": O.audit_sql(
            [
                ("batches to 0", f'TRY_CAST("YEAR" AS INTEGER) <= {SPLIT_YEAR}', f'TRY_CAST("YEAR" AS INTEGER) = {SPLIT_YEAR}'),
                ("batches to 1", f'TRY_CAST("YEAR" AS INTEGER) > {SPLIT_YEAR}', "false"),
                ("batches to 2", f'TRY_CAST("YEAR" AS INTEGER) = {SPLIT_YEAR}', "false"),
            ]
        ),
        "episodes_box_all_years": _sketched_box_oracle(),
        "provider_read_selections": w(f"SELECT {O.cols(PROVIDER_READ_COLUMNS)} FROM gold_provider WHERE {_SELECTION.replace('`', chr(34))}"),
        "state_read_selections": w(
            f'SELECT {O.cols(STATE_READ_COLUMNS)} FROM gold_state WHERE ("YEAR", service_category) IN '
            f"""(SELECT ("YEAR", service_category) FROM gold_state WHERE {_SELECTION.replace('`', '"')})"""
        ),
        "sql_top_slice": w(
            "SELECT provider_id, pay_rank, pay_per_bene, risk_band, risk_band AS risk_band_sql FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY provider_state ORDER BY {_TOP_ORDER}) AS pay_rank FROM gold_provider WHERE {_SLICE}) t "
            f"WHERE pay_rank <= {TOP_N}"
        ),
        "sql_state_slice": w(f"SELECT {O.cols(STATE_READ_COLUMNS)} FROM gold_state WHERE {_SLICE}"),
        "sql_provider_slice": w(f"SELECT {O.cols(PROVIDER_READ_COLUMNS)} FROM gold_provider WHERE {one_state}"),
        "landing_drift": w(
            f"""SELECT 'value' AS kind, "YEAR" AS name, CASE WHEN later THEN PRVDR_CITY END AS town, count(*) AS n,
  CAST(coalesce(sum(CASE WHEN later THEN CAST(TOT_EPSD_STAY_CNT AS BIGINT) END), 0) AS BIGINT) AS beds
FROM (SELECT *, TRY_CAST("YEAR" AS INTEGER) >= {DRIFT_YEAR} AS later FROM bronze) t GROUP BY 1, 2, 3
UNION ALL SELECT 'field', f, NULL, count(*), 0 FROM bronze, (VALUES ('PRVDR_TOWN'), ('BEDS')) v(f)
WHERE TRY_CAST("YEAR" AS INTEGER) >= {DRIFT_YEAR} GROUP BY f"""
        ),
        "bucketed_provider_totals": w(
            f"SELECT provider_id, count(*) AS n_rows, {O.long_sum_sql('total_service_days')} AS total_service_days "
            "FROM silver WHERE summary_category = 'PROVIDER' GROUP BY provider_id"
        ),
        "merged_gold_provider": w(f"SELECT {O.GOLD_PROVIDER_COLS} FROM gold_provider"),
        "merged_gold_state": w(f"SELECT {O.GOLD_STATE_COLS} FROM gold_state"),
        "sql_function_ratio": w(
            'SELECT "YEAR", service_category, provider_state, '
            f"{O.safe_div_sql('total_medicare_payment_amt', 'total_distinct_benes')} AS pay_per_bene_sql, "
            f"coalesce({O.safe_div_sql('total_medicare_payment_amt', 'total_service_days')}, 0) "
            "AS pay_per_service_day_kpi FROM gold_state"
        ),
    }


__all__ = ["QUERIES", "oracle_statements", "prepared", "bronze", "silver", "silver_table", "gold"]
