"""The column macros as temporary SQL functions, for users who write SQL.

The bodies are the same SQL templates the DataFrame code uses (``functions.expr``),
so each rule is still written once. SQL functions are inlined by the analyzer into
ordinary expressions, so a query that calls ``safe_div(a, b)`` plans exactly like
one that spells the expression out.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .expr import Sql, dual_share_band_sql, ident, kpi_div_sql, pct_sql, risk_band_sql, rural_mix_band_sql, safe_div_sql, to_long_sql, wide_sum_long_sql, year_date_sql

_FUNCTIONS = {
    "safe_div": f"(num DOUBLE, den DOUBLE) RETURNS DOUBLE RETURN {safe_div_sql('num', 'den')}",
    "kpi_div": f"(num DOUBLE, den DOUBLE) RETURNS DOUBLE RETURN {kpi_div_sql('num', 'den')}",
    "pct": f"(raw STRING) RETURNS DOUBLE RETURN {pct_sql('raw')}",
    "whole": f"(raw STRING) RETURNS BIGINT RETURN {to_long_sql('raw')}",
    "risk_band": f"(score DOUBLE) RETURNS STRING RETURN {risk_band_sql('score')}",
    "dual_share_band": f"(share DOUBLE) RETURNS STRING RETURN {dual_share_band_sql('share')}",
    "rural_mix_band": f"(share DOUBLE) RETURNS STRING RETURN {rural_mix_band_sql('share')}",
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create (or replace) the temporary SQL functions; returns their names."""
    for name, body in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(_FUNCTIONS)


def _columns(df_schema, names: list[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in df_schema.fields}
    return ", ".join(f"{ident(n)} {types[n]}" for n in names)


def register_table_functions(spark: SparkSession, gold_provider: str, gold_state: str) -> list[str]:
    """SQL functions that return tables, over the views (or tables) of those names:

    - ``state_slice(year, category)``: the state summary of one slice,
    - ``provider_slice(year, category, state)``: provider rows of one slice, of all states
      where ``state`` is NULL,
    - ``top_slice(year, category, state, n)``: the n providers with the highest payment per
      beneficiary in each state, with their rank,
    - ``national_kpi(year, category)``: beneficiaries, service days and states of a slice.

    They are inlined: their arguments reach the scan as pushed and partition filters.
    """
    from ..contracts import PROVIDER_READ_COLUMNS, STATE_READ_COLUMNS, TOP_TABLE_COLUMNS

    of = {name: spark.table(name).schema for name in (gold_provider, gold_state)}
    date = year_date_sql(Sql("f_year"))

    def where(fn: str, state: bool = False) -> str:
        cond = f"`YEAR` = {fn}.f_year AND `YEAR_DATE` = {date} AND service_category = {fn}.f_category"
        return cond + (f" AND ({fn}.f_state IS NULL OR provider_state = {fn}.f_state)" if state else "")

    order = "pay_per_bene DESC NULLS LAST, provider_id ASC NULLS LAST, provider_name ASC NULLS LAST"
    slice_args, state_arg = "f_year BIGINT, f_category STRING", "f_state STRING"
    columns = {n: ", ".join(ident(c) for c in cs) for n, cs in (("s", STATE_READ_COLUMNS), ("p", PROVIDER_READ_COLUMNS), ("t", TOP_TABLE_COLUMNS))}
    made = {
        "state_slice": f"({slice_args}) RETURNS TABLE({_columns(of[gold_state], STATE_READ_COLUMNS)}) "
        f"RETURN SELECT {columns['s']} FROM {gold_state} WHERE {where('state_slice')}",
        "provider_slice": f"({slice_args}, {state_arg}) RETURNS TABLE({_columns(of[gold_provider], PROVIDER_READ_COLUMNS)}) "
        f"RETURN SELECT {columns['p']} FROM {gold_provider} WHERE {where('provider_slice', True)}",
        "top_slice": f"({slice_args}, {state_arg}, f_n INT) RETURNS TABLE({_columns(of[gold_provider], TOP_TABLE_COLUMNS)}, pay_rank BIGINT) "
        f"RETURN SELECT {columns['t']}, CAST(r AS BIGINT) FROM (SELECT *, row_number() OVER (PARTITION BY provider_state ORDER BY {order}) AS r "
        f"FROM {gold_provider} WHERE {where('top_slice', True)}) WHERE r <= top_slice.f_n",
        "national_kpi": f"({slice_args}) RETURNS TABLE(total_distinct_benes BIGINT, total_service_days BIGINT, n_states BIGINT) "
        f"RETURN SELECT {wide_sum_long_sql('total_distinct_benes')}, {wide_sum_long_sql('total_service_days')}, count(1) "
        f"FROM {gold_state} WHERE {where('national_kpi')}",
    }
    for name, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(made)
