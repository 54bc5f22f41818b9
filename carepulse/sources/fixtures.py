"""A bronze-shaped table derived, by Spark, from the shared test tables.

The source data (annual provider utilisation files) is not available here, so the
raw table is synthesised from ``lineitem``, ``orders``, ``supplier`` and ``nation``:
one PROVIDER row per supplier x order year x return flag x line status, plus one
roll-up row per state x category x year (a summary level the gold builds must
drop). Suppressed cells (``*``) appear by rule, so every NULL path is exercised.
All work is joins and aggregations, so it grows with the input tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import BRONZE_COLUMNS, PROVIDER_LEVEL, SILVER_MAPPING

STATE_LEVEL = "STATE"  # summary level of the added roll-up rows
_SPECIAL = {"BENE_AVG_RISK_SCRE", "BENE_DUAL_PCT", "BENE_RRL_PCT"}
# The 18 percentage columns filled by the generic rule, in contract order.
GENERIC_PCT_COLUMNS = [raw for raw, _, kind in SILVER_MAPPING if kind == "pct" and raw not in _SPECIAL]
_IDS = ["PRVDR_ID", "PRVDR_NAME", "PRVDR_CITY", "PRVDR_ZIP"]
_STATE_KEYS = ["STATE", "SRVC_CTGRY", "YEAR"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _units_text(units: str, places: int = 4) -> str:
    """Integer units of 10**-places as decimal text ('1234.5600' for 4 places)."""
    return f"CAST(CAST(CAST({units} AS DECIMAL(38,0)) / {10**places} AS DECIMAL(38,{places})) AS STRING)"


def _suppress(cond: str, value: str) -> str:
    """The marker when ``cond`` holds, else the value as text."""
    return f"CASE WHEN {cond} THEN '*' ELSE CAST({value} AS STRING) END"


def provider_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PROVIDER-level bronze rows, all columns text."""
    # Money in fixed-point integers: price in cents, discount and tax in
    # hundredths, so each product is an exact count of 1/10000 units (the price
    # alone of 1/100 units) and the sums are exact `long` sums (a decimal(28,4)
    # sum buffer is much slower). They are rounded before the shuffles (whole
    # doubles pack well) and become `long` where they are summed.
    units = {"cents": "l_extendedprice", "disc": "l_discount", "tax": "l_tax"}
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_suppkey").alias("sk"), "l_quantity",
        F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"),
        *[F.rint(F.col(c) * 100).alias(name) for name, c in units.items()],
    )
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").alias("y")
    )
    cents, disc, tax = (F.col(name).cast("bigint") for name in units)
    # The order lines are shuffled twice at any size: for the join (a hash table of a
    # partition's orders, no sort of the lines) and by group. Both steps of the distinct
    # count stay in the group's partition.
    group = ["sk", "y", "rf", "ls"]
    lines = (
        li.join(orders.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(*group, "o_custkey", "l_quantity", *units)
        .repartition(*group)
    )
    per_customer = lines.groupBy(*group, "o_custkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("l_quantity").alias("qty"),
        F.sum(cents * (100 - disc)).alias("pay"),
        F.sum(cents * (100 - tax)).alias("std"),
        F.sum(cents * (100 + tax)).alias("chg"),
        F.sum(cents).alias("alw"),
    )
    per_group = per_customer.groupBy(*group).agg(
        F.count("o_custkey").alias("n_cust"), *[F.sum(c).alias(c) for c in ("n", "qty", "pay", "std", "chg", "alw")]
    )
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    dims = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    g = per_group.join(dims, F.col("sk") == F.col("s_suppkey"))

    o3 = "CASE WHEN ls = 'O' THEN 3 ELSE 0 END"
    cols = {
        "PRVDR_ID": "lpad(CAST(s_suppkey AS STRING), 6, '0')",
        "PRVDR_NAME": "s_name",
        "PRVDR_CITY": "concat('CITY_', CAST(s_nationkey AS STRING))",
        "PRVDR_ZIP": "lpad(CAST(s_suppkey AS STRING), 5, '0')",
        # Five states, so that a state has far more providers than a top-10 shows.
        "STATE": "concat('NATION_', CAST(15 + s_nationkey % 5 AS STRING))",
        "SRVC_CTGRY": "CASE WHEN rf = 'N' THEN 'SNF' WHEN rf = 'A' THEN 'HH' ELSE 'HOSPICE' END",
        "SMRY_CTGRY": f"'{PROVIDER_LEVEL}'",
        "YEAR_TYPE": "CASE WHEN ls = 'O' THEN 'CY' ELSE 'FY' END",
        "YEAR": "CAST(y AS STRING)",
        # Two counts of 6e18 in one group do not fit a long.
        "TOT_SRVC_DAYS": "CASE WHEN s_suppkey % 41 = 7 AND y = 1997 THEN '6000000000000000000' WHEN (s_suppkey + y) % 17 = 0 THEN '0' ELSE CAST(CAST(qty AS BIGINT) AS STRING) END",
        "TOT_EPSD_STAY_CNT": "CAST(n AS STRING)",
        # Missing and negative ratios, and cells that do not parse.
        "BENE_DSTNCT_CNT": "CASE WHEN (s_suppkey + 2 * y) % 29 = 0 THEN '0' ELSE CAST(n_cust AS STRING) END",
        "TOT_MDCR_PYMT_AMT": f"CASE WHEN (s_suppkey + y) % 31 = 0 THEN concat('-', {_units_text('pay')}) ELSE {_units_text('pay')} END",
        "TOT_MDCR_STDZD_PYMT_AMT": _units_text("std"),
        "TOT_CHRG_AMT": f"CASE WHEN (s_suppkey + y) % 23 = 0 THEN 'n/a' ELSE {_units_text('chg')} END",
        "TOT_ALOWD_AMT": _units_text("alw", places=2),
        "BENE_AVG_RISK_SCRE": _suppress("n < 11", "CAST(0.6BD + (s_suppkey % 7) * 0.5BD AS DECIMAL(6,2))"),
        "BENE_DUAL_PCT": _suppress("n < 11 OR (s_suppkey + y) % 11 = 0", f"(s_suppkey * 37 + {o3}) % 100"),
        "BENE_RRL_PCT": _suppress("(s_suppkey + y) % 13 = 0", f"(s_nationkey * 41 + y + {o3}) % 100"),
    }
    # The generic columns by one function of their number: written out, they would make a
    # method too large for the JIT.
    generic = _suppress("(s_suppkey + y + i) % 19 = 0", f"(s_suppkey * (7 + 2 * i) + y * (i + 1) + {o3}) % 100")
    for i, raw in enumerate(GENERIC_PCT_COLUMNS):
        cols[raw] = f"generic[{i}]"
    cells = g.selectExpr("*", f"transform(sequence(0, {len(GENERIC_PCT_COLUMNS) - 1}), i -> {generic}) AS generic")
    return cells.selectExpr(*[f"{cols[c]} AS {c}" for c in BRONZE_COLUMNS])


def state_rows(provider: DataFrame) -> DataFrame:
    """One roll-up row per state x category x year: ids empty, other cells the text max."""
    measured = [c for c in BRONZE_COLUMNS if c not in _IDS + _STATE_KEYS + ["SMRY_CTGRY"]]
    agg = provider.groupBy(*_STATE_KEYS).agg(*[F.expr(f"max({c}) AS {c}") for c in measured])
    extra = {c: "''" for c in _IDS}
    extra["SMRY_CTGRY"] = f"'{STATE_LEVEL}'"
    return agg.selectExpr(*[(f"{extra[c]} AS {c}" if c in extra else c) for c in BRONZE_COLUMNS])


def bronze_from_test_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full bronze analog: PROVIDER rows plus STATE roll-up rows (bag union).

    As one plan the roll-up branch recomputes the provider rows; use
    ``write_bronze_from_test_tables`` to materialise it without that.
    """
    provider = provider_rows(spark, sf_dir)
    return provider.unionByName(state_rows(provider))


def write_bronze_from_test_tables(spark: SparkSession, sf_dir: str, path: str) -> str:
    """Write the bronze analog as Parquet: PROVIDER rows once, then the roll-up rows
    computed from the written table and appended (no recomputation of the join)."""
    provider_rows(spark, sf_dir).write.mode("overwrite").parquet(path)
    written = spark.read.parquet(path)
    state_rows(written).write.mode("append").parquet(path)
    return path
