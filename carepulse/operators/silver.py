"""Bronze -> silver: one projection that types, renames and cleans every column.

Plus the suppression audit: per numeric column, how many cells were suppressed,
malformed, NULL or valid, so the lenient casts never hide bad input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import NUMERIC_BRONZE_COLUMNS, PROVIDER_LEVEL, SILVER_MAPPING
from ..functions.expr import (
    SUPPRESSED,
    aliased,
    as_text_sql,
    finite_sql,
    ident,
    to_long_sql,
    try_double_sql,
    year_date_sql,
)

_CONVERT = {"text": as_text_sql, "long": to_long_sql, "money": try_double_sql, "pct": try_double_sql}


def _typed_exprs() -> list[str]:
    """First projection: each bronze column cast once (text, long, or raw double)."""
    return [aliased(_CONVERT[kind](raw), silver) for raw, silver, kind in SILVER_MAPPING]


def _clean_exprs() -> list[str]:
    """Second projection: NaN/infinite doubles to NULL, YEAR_DATE from YEAR."""
    out = []
    for _, silver, kind in SILVER_MAPPING:
        out.append(aliased(finite_sql(silver), silver) if kind in ("money", "pct") else ident(silver))
        if silver == "YEAR":
            out.append(aliased(year_date_sql("YEAR"), "YEAR_DATE"))
    return out


def build_silver(bronze: DataFrame) -> DataFrame:
    """The 38-column silver table.

    Two projections (Catalyst keeps them apart because the casts are not cheap to
    repeat, and whole-stage codegen fuses them into one pipeline): every cell is
    parsed exactly once, and the per-column generated code stays small enough
    for the JIT.
    """
    return bronze.selectExpr(*_typed_exprs()).selectExpr(*_clean_exprs())


CELLS = "__cells"


def build_silver_with_cells(bronze: DataFrame) -> DataFrame:
    """Silver with a long that holds two bits for each numeric bronze cell: 0 if it is NULL,
    1 if suppressed, 2 otherwise. With it the audit can be taken from silver rows alone."""
    texts = ", ".join(as_text_sql(raw) for raw in reversed(NUMERIC_BRONZE_COLUMNS))
    kind = f"CASE WHEN x IS NULL THEN 0L WHEN x = '{SUPPRESSED}' THEN 1L ELSE 2L END"
    # One function over the cells: a term per column makes a method too large for the JIT.
    typed = bronze.selectExpr(*_typed_exprs(), aliased(f"aggregate(array({texts}), 0L, (bits, x) -> shiftleft(bits, 2) | {kind})", CELLS))
    return typed.selectExpr(*_clean_exprs(), CELLS)


def audit_metrics() -> list[Column]:
    """Aggregates over ``build_silver_with_cells`` for an ``Observation``: the audit is taken
    while the rows are written, so bronze is neither read nor resolved a second time.

    Observe the rows behind the last exchange: what runs in the writing stage is counted
    once per partition, also when tasks are run again.
    """
    silver_of = {raw: name for raw, name, _ in SILVER_MAPPING}
    out = [F.expr("count(1) AS n_rows")]
    for i, raw in enumerate(NUMERIC_BRONZE_COLUMNS):
        cell = f"(shiftright({CELLS}, {2 * i}) & 3L)"
        out += [F.expr(f"count_if({cell} = {k}) AS c{i}_{part}") for k, part in ((0, "null"), (1, "supp"))]
        out.append(F.expr(f"count({ident(silver_of[raw])}) AS c{i}_valid"))
    return out


def audit_of_metrics(spark: SparkSession, got: dict) -> DataFrame:
    """The audit table from the observed numbers (one row per numeric column)."""
    silver_of = {raw: name for raw, name, _ in SILVER_MAPPING}
    rows = []
    for i, raw in enumerate(NUMERIC_BRONZE_COLUMNS):
        n, null, supp, valid = (int(got.get(k) or 0) for k in ("n_rows", f"c{i}_null", f"c{i}_supp", f"c{i}_valid"))
        rows.append((raw, silver_of[raw], n, null, supp, n - null - supp - valid, valid))
    counts = ", ".join(f"{c} long" for c in ("n_rows", "n_null", "n_suppressed", "n_bad", "n_valid"))
    return spark.createDataFrame(rows, f"source_column string, silver_column string, {counts}").coalesce(1)


def provider_level(silver: DataFrame) -> DataFrame:
    """Rows at provider summary level; the only rows the gold tables aggregate."""
    return silver.where(f"summary_category = '{PROVIDER_LEVEL}'")


def suppression_audit(bronze: DataFrame, silver: DataFrame | None = None) -> DataFrame:
    """Per numeric bronze column: rows, NULL, suppressed, malformed and valid cells.

    One wide aggregate in a single pass (partial aggregation per task, one small
    row to the final stage), then the one-row result is unpivoted. A cell is
    'suppressed' when it is the marker, 'bad' when it is neither NULL, the marker
    nor a value the silver conversion accepts. The four classes are exclusive, so
    'bad' is derived from the other three: that keeps the aggregate at 88 fields,
    under the whole-stage codegen field limit (100), instead of 117.

    Given ``silver`` (the table built from this same ``bronze``), the valid counts
    are ``count`` over its columns, and bronze is only tested for NULL and the
    marker: no cell is parsed a second time. Parsing is what the silver build
    spends its time on, so this halves the audit's work. The two one-row partial
    results are added up through a union, not joined.
    """
    kinds = {raw: kind for raw, _, kind in SILVER_MAPPING}
    silver_of = {raw: name for raw, name, _ in SILVER_MAPPING}
    cols = ["n_rows"] + [f"c{i}_{part}" for i in range(len(NUMERIC_BRONZE_COLUMNS)) for part in ("null", "supp", "valid")]
    if silver is None:
        parsed = bronze.selectExpr(
            *[aliased(as_text_sql(raw), f"t{i}") for i, raw in enumerate(NUMERIC_BRONZE_COLUMNS)],
            *[
                aliased(to_long_sql(raw) if kinds[raw] == "long" else try_double_sql(raw), f"v{i}")
                for i, raw in enumerate(NUMERIC_BRONZE_COLUMNS)
            ],
        )
        aggs = ["count(1) AS n_rows"]
        for i, raw in enumerate(NUMERIC_BRONZE_COLUMNS):
            value = f"v{i}" if kinds[raw] == "long" else finite_sql(f"v{i}")
            aggs += [
                f"count_if(t{i} IS NULL) AS c{i}_null",
                f"count_if(t{i} = '{SUPPRESSED}') AS c{i}_supp",
                f"count_if(({value}) IS NOT NULL) AS c{i}_valid",
            ]
        wide = parsed.selectExpr(*aggs)  # aggregate functions only: one global aggregate
    else:
        raw_aggs = ["count(1) AS n_rows"]
        silver_aggs = ["0L AS n_rows"]
        for i, raw in enumerate(NUMERIC_BRONZE_COLUMNS):
            text = as_text_sql(raw)
            raw_aggs += [
                f"count_if({text} IS NULL) AS c{i}_null",
                f"count_if({text} = '{SUPPRESSED}') AS c{i}_supp",
                f"0L AS c{i}_valid",
            ]
            silver_aggs += [f"0L AS c{i}_null", f"0L AS c{i}_supp", f"count({ident(silver_of[raw])}) AS c{i}_valid"]
        both = bronze.selectExpr(*raw_aggs).unionByName(silver.selectExpr(*silver_aggs))
        wide = both.selectExpr(*[f"sum({c}) AS {c}" for c in cols])
    rows = ", ".join(
        f"'{raw}', '{silver_of[raw]}', c{i}_null, c{i}_supp, "
        f"n_rows - c{i}_null - c{i}_supp - c{i}_valid, c{i}_valid"
        for i, raw in enumerate(NUMERIC_BRONZE_COLUMNS)
    )
    return wide.selectExpr(
        "n_rows",
        f"stack({len(NUMERIC_BRONZE_COLUMNS)}, {rows}) "
        "AS (source_column, silver_column, n_null, n_suppressed, n_bad, n_valid)",
    ).select("source_column", "silver_column", "n_rows", "n_null", "n_suppressed", "n_bad", "n_valid")
