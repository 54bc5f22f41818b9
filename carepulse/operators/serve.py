"""Read-side operators over the gold tables (the dashboard's questions).

The source pages load one (year, category[, state]) slice into pandas and then
filter, sum, sort and head it. Here each question is a DataFrame plan: the slice
predicates reach the Parquet scan (partition pruning on ``YEAR_DATE`` plus
pushed filters), and the batch forms answer every state / year at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import PROVIDER_READ_COLUMNS, STATE_READ_COLUMNS, TOP_N, TOP_TABLE_COLUMNS, ZERO_FILL_COLUMNS
from ..functions.expr import Sql, aliased, exact_sum_double_sql, ident, kpi_div_sql, select_names, wide_sum_long_sql, year_date_sql
from .quantiles import box_summary
from .sketches import box_of_sketches, merge_sketches, sketch_values


# ----------------------------------------------------------------- slice scans
def _slice_filter(year: int, service_category: str, state: str | None = None) -> Column:
    """Equality predicates of one slice, as bound literals (no text splicing).

    YEAR alone does not prune partitions; the equivalent YEAR_DATE predicate does.
    """
    cond = (
        (F.col("YEAR") == F.lit(int(year)))
        & (F.col("YEAR_DATE") == F.expr(year_date_sql(Sql(str(int(year))))))
        & (F.col("service_category") == F.lit(service_category))
    )
    if state is not None:
        cond = cond & (F.col("provider_state") == F.lit(state))
    return cond


def load_state_summary(gold_state: DataFrame, year: int, service_category: str) -> DataFrame:
    """State summary rows of one year and category (15 columns)."""
    return select_names(gold_state.where(_slice_filter(year, service_category)), STATE_READ_COLUMNS)


def load_provider_metrics(gold_provider: DataFrame, year: int, state: str, service_category: str) -> DataFrame:
    """Provider rows of one year, state and category (31 columns)."""
    return select_names(gold_provider.where(_slice_filter(year, service_category, state)), PROVIDER_READ_COLUMNS)


def load_provider_data(gold_provider: DataFrame, year: int, service_category: str) -> DataFrame:
    """Provider rows of one year and category, every state (31 columns)."""
    return select_names(gold_provider.where(_slice_filter(year, service_category)), PROVIDER_READ_COLUMNS)


def load_slices(gold: DataFrame, selections: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of many slices at once: those of ``gold`` whose (YEAR, service_category, and
    provider_state where ``selections`` has it) are among ``selections``.

    The selections' years reach the scan at run time (dynamic partition pruning on
    YEAR_DATE), as the years of one slice do at planning time. The result is the union of
    the single reads: a slice selected twice counts once, NULL selects nothing.
    """
    keys = ["YEAR", "service_category"] + (["provider_state"] if "provider_state" in selections.columns else [])
    # Years outside the calendar have no partition; the condition also marks the selections
    # as selective, without which the optimizer doesn't prune by them.
    wanted = selections.where("`YEAR` BETWEEN 1 AND 9999").selectExpr(*[f"{ident(k)} AS {ident('_' + k)}" for k in keys]).distinct()
    wanted = wanted.selectExpr("*", aliased(year_date_sql("_YEAR"), "_YEAR_DATE"))
    cond = " AND ".join(f"{ident(k)} = {ident('_' + k)}" for k in ["YEAR_DATE", *keys])
    return select_names(gold.join(wanted, F.expr(cond), "left_semi"), columns)


def zero_fill(df: DataFrame, columns: list[str] = ZERO_FILL_COLUMNS) -> DataFrame:
    """Coerce the measure columns to double; NULL or non-numeric becomes 0."""
    fill = set(columns)
    return df.selectExpr(
        *[
            (aliased(f"coalesce(try_cast({ident(c)} AS DOUBLE), 0.0D)", c) if c in fill else ident(c))
            for c in df.columns
        ]
    )


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Coerce columns to double without filling: non-numeric values become NULL."""
    fill = set(columns)
    return df.selectExpr(
        *[(aliased(f"try_cast({ident(c)} AS DOUBLE)", c) if c in fill else ident(c)) for c in df.columns]
    )


def load_state_summary_sql(spark, table: str, year: int, service_category: str) -> DataFrame:
    """The state summary slice as parameterised SQL (named markers, no string splicing)."""
    cols = ", ".join(f"`{c}`" for c in STATE_READ_COLUMNS)
    return spark.sql(
        f"SELECT {cols} FROM IDENTIFIER(:t) WHERE `YEAR` = :year AND service_category = :svc "
        f"AND `YEAR_DATE` = {year_date_sql(Sql(str(int(year))))}",
        args={"t": table, "year": int(year), "svc": service_category},
    )


# ------------------------------------------------------------------------ KPIs
def kpis(df: DataFrame, keys: list[str]) -> DataFrame:
    """Total payment, beneficiaries and service days, and the two per-unit KPIs.

    A sum over no values is 0 and a KPI with a zero denominator is 0, as on the
    dashboard (unlike the gold ratios, which are NULL there). A count beyond the range of
    a long is the largest long, here as in the gold tables.
    """
    agg = df.groupBy(*keys).agg(
        F.expr(
            aliased(f"coalesce({exact_sum_double_sql('total_medicare_payment_amt')}, 0.0D)", "total_medicare_payment_amt")
        ),
        *[F.expr(aliased(f"coalesce({wide_sum_long_sql(Sql(f'CAST({ident(c)} AS BIGINT)'))}, 0L)", c)) for c in ("total_distinct_benes", "total_service_days")],
    )
    return agg.selectExpr(
        "*",
        aliased(kpi_div_sql("total_medicare_payment_amt", "total_distinct_benes"), "avg_pay_per_bene"),
        aliased(kpi_div_sql("total_medicare_payment_amt", "total_service_days"), "avg_pay_per_service_day"),
    )


def national_kpis(gold_state: DataFrame) -> DataFrame:
    """National KPIs for every (year, category), from the state summary."""
    return kpis(gold_state, ["YEAR", "service_category"])


def state_kpis(gold_provider: DataFrame) -> DataFrame:
    """Per-state KPIs for every (year, category, state), from provider rows."""
    return kpis(gold_provider, ["YEAR", "service_category", "provider_state"])


# ---------------------------------------------------------- lists and rankings
def state_list(gold: DataFrame, keys: list[str] = ["YEAR", "service_category"]) -> DataFrame:
    """Sorted distinct states of every (year, category)."""
    return (
        gold.select(*keys, "provider_state")
        .distinct()
        .orderBy(*[F.col(k).asc_nulls_last() for k in keys], F.col("provider_state").asc_nulls_last())
    )


def states_ranked(gold_state: DataFrame) -> DataFrame:
    """States of each (year, category) by payment per beneficiary, highest first,
    missing values last, with an explicit rank column."""
    w = Window.partitionBy("YEAR", "service_category").orderBy(
        F.col("pay_per_bene").desc_nulls_last(), F.col("provider_state").asc_nulls_last()
    )
    coerced = coerce_numeric(select_names(gold_state, STATE_READ_COLUMNS), ["pay_per_bene", "total_medicare_payment_amt"])
    return coerced.select("*", F.row_number().over(w).cast("bigint").alias("pay_rank"))


def top_order() -> list[Column]:
    """Highest payment per beneficiary first, missing last; ties by provider id, name."""
    return [
        F.col("pay_per_bene").desc_nulls_last(),
        F.col("provider_id").asc_nulls_last(),
        F.col("provider_name").asc_nulls_last(),
    ]


def top_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank_col: str = "rank") -> DataFrame:
    """The first ``n`` rows of every group under ``order`` (ties broken by the order list).

    ``row_number() <= n`` lets Catalyst insert a partial per-task group limit
    before the shuffle, so each task sends at most ``n`` rows per group: a hot
    group never ships its full size to one task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def top_providers(df: DataFrame, n: int = TOP_N) -> DataFrame:
    """Top ``n`` providers by payment per beneficiary for every (year, category, state),
    in the top-table projection, with the rank; chart order is ascending."""
    keys = ["YEAR", "service_category", "provider_state"]
    top = top_n_per_group(df, keys, top_order(), n, "pay_rank")
    # The cast comes after the filter, so the limit still reaches below the shuffle.
    return top.selectExpr(*[ident(c) for c in keys + TOP_TABLE_COLUMNS], "CAST(pay_rank AS BIGINT) AS pay_rank")


def top_providers_of_slice(df: DataFrame, n: int = TOP_N) -> DataFrame:
    """``top_providers`` for the rows of one (year, category, state): a plain top-k
    (TakeOrderedAndProject), ranked afterwards over the ``n`` rows that are left."""
    keys = ["YEAR", "service_category", "provider_state"]
    top = df.orderBy(*top_order()).limit(n)
    ranked = top.withColumn("pay_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*top_order())).cast("bigint"))
    return select_names(ranked, keys + TOP_TABLE_COLUMNS + ["pay_rank"])


def chart_order(df: DataFrame) -> DataFrame:
    """Ascending payment per beneficiary (missing last), as the bar chart draws it."""
    return df.orderBy(F.col("pay_per_bene").asc_nulls_last(), F.col("pay_rank").desc())


def episodes_box_by_risk(provider_rows: DataFrame) -> DataFrame:
    """Distribution of episodes per beneficiary by risk band, per (year, category, state),
    over the zero-filled provider rows (as the provider page plots them)."""
    keys = ["YEAR", "service_category", "provider_state", "risk_band"]
    return box_summary(zero_fill(provider_rows, ["episodes_per_bene"]), keys, "episodes_per_bene")


SKETCH_KEYS = ["YEAR", "YEAR_DATE", "service_category", "provider_state", "risk_band"]


def episode_sketches(provider_rows: DataFrame) -> DataFrame:
    """One sketch of the zero-filled episodes per beneficiary for every slice and risk band,
    to be stored beside the gold tables."""
    return sketch_values(zero_fill(provider_rows, ["episodes_per_bene"]), SKETCH_KEYS, "episodes_per_bene")


def episodes_box_of_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The distribution by risk band over any coarser grouping of the slices (``keys``), from
    their sketches alone."""
    return box_of_sketches(merge_sketches(sketches, keys), keys)
