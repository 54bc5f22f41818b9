"""DuckDB SQL text for the correctness oracle.

Each registered query has an equivalent SQL statement over the raw test tables
(``lineitem orders supplier nation`` as views). The statements are written
independently of the Spark plans: measures, ratios, thresholds and scales are stated
here once more. Shared steps are CTEs assembled here. Only the column names of the
raw and typed tables come from the contracts.
"""

from __future__ import annotations

from ..contracts import BRONZE_COLUMNS, NUMERIC_BRONZE_COLUMNS, SILVER_MAPPING, gold_provider_columns, gold_state_columns
from ..sources.fixtures import GENERIC_PCT_COLUMNS

# --- fixed values: the oracle's own statement of the definitions, not taken from the library ---
PROVIDER_KEYS = ["YEAR", "YEAR_DATE", "provider_id", "provider_name", "provider_state", "service_category", "summary_category"]
# (output, kind, silver column)
PROVIDER_MEASURES = [
    ("total_service_days", "sum_long", "total_service_days"),
    ("total_episode_stays", "sum_long", "total_episode_stays"),
    ("total_distinct_benes", "sum_long", "distinct_beneficiaries"),
    ("total_medicare_payment_amt", "sum_money", "total_medicare_payment_amt"),
    ("total_medicare_std_payment_amt", "sum_money", "total_medicare_standardized_payment_amt"),
    ("total_charge_amt", "sum_money", "total_charge_amt"),
    ("total_allowed_amt", "sum_money", "total_allowed_amt"),
    ("avg_bene_age", "avg", "bene_avg_age"),
    ("avg_bene_risk_score", "avg", "bene_avg_risk_score"),
    ("avg_dual_pct", "avg", "bene_dual_pct"),
    ("avg_rural_pct", "avg", "bene_rural_pct"),
    ("avg_female_pct", "avg", "bene_female_pct"),
    ("avg_diabetes_pct", "avg", "bene_diabetes_pct"),
    ("avg_hypertension_pct", "avg", "bene_hypertension_pct"),
    ("avg_heart_failure_pct", "avg", "bene_heart_failure_pct"),
    ("avg_copd_pct", "avg", "bene_copd_pct"),
]
# (output, numerator, denominator)
PROVIDER_RATIOS = [
    ("pay_per_bene", "total_medicare_payment_amt", "total_distinct_benes"),
    ("pay_per_service_day", "total_medicare_payment_amt", "total_service_days"),
    ("charge_per_bene", "total_charge_amt", "total_distinct_benes"),
    ("allowed_per_bene", "total_allowed_amt", "total_distinct_benes"),
    ("payment_to_charge_ratio", "total_medicare_payment_amt", "total_charge_amt"),
    ("allowed_to_charge_ratio", "total_allowed_amt", "total_charge_amt"),
    ("episodes_per_bene", "total_episode_stays", "total_distinct_benes"),
]
STATE_KEYS = ["YEAR", "YEAR_DATE", "provider_state", "service_category"]
STATE_MEASURES = [
    ("total_medicare_payment_amt", "sum_money", "total_medicare_payment_amt"),
    ("total_charge_amt", "sum_money", "total_charge_amt"),
    ("total_distinct_benes", "sum_long", "distinct_beneficiaries"),
    ("total_service_days", "sum_long", "total_service_days"),
    ("avg_bene_risk_score", "avg", "bene_avg_risk_score"),
    ("avg_dual_pct", "avg", "bene_dual_pct"),
    ("avg_rural_pct", "avg", "bene_rural_pct"),
]
STATE_RATIOS = [
    ("pay_per_bene", "total_medicare_payment_amt", "total_distinct_benes"),
    ("pay_per_service_day", "total_medicare_payment_amt", "total_service_days"),
    ("charge_per_bene", "total_charge_amt", "total_distinct_benes"),
    ("payment_to_charge_ratio", "total_medicare_payment_amt", "total_charge_amt"),
]
MONEY = "DECIMAL(38,4)"
AVERAGE = "DECIMAL(38,8)"
# --- end of fixed values ---


def q(name: str) -> str:
    return f'"{name}"'


# ---------------------------------------------------------------- bronze analog
def _supp(cond: str, value: str) -> str:
    return f"CASE WHEN {cond} THEN '*' ELSE CAST({value} AS VARCHAR) END"


def bronze_ctes() -> str:
    generic = ",\n    ".join(
        f"{_supp(f'(s_suppkey + y + {i}) % 19 = 0', f'(s_suppkey * {7 + 2 * i} + y * {i + 1} + o3) % 100')} AS {raw}"
        for i, raw in enumerate(GENERIC_PCT_COLUMNS)
    )
    state_cols = []
    for c in BRONZE_COLUMNS:
        if c in ("PRVDR_ID", "PRVDR_NAME", "PRVDR_CITY", "PRVDR_ZIP"):
            state_cols.append(f"'' AS {c}")
        elif c == "SMRY_CTGRY":
            state_cols.append("'STATE' AS SMRY_CTGRY")
        elif c in ("STATE", "SRVC_CTGRY", "YEAR"):
            state_cols.append(q(c) if c == "YEAR" else c)
        else:
            state_cols.append(f"max({c}) AS {c}")
    return f"""
fx_pg AS (
  SELECT l.l_suppkey AS sk, year(o.o_orderdate) AS y, l.l_returnflag AS rf, l.l_linestatus AS ls,
    count(*) AS n, count(DISTINCT o.o_custkey) AS n_cust, sum(l.l_quantity) AS qty,
    sum(CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2)))) AS pay,
    sum(CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_tax AS DECIMAL(4,2)))) AS std,
    sum(CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 + CAST(l.l_tax AS DECIMAL(4,2)))) AS chg,
    sum(CAST(l.l_extendedprice AS DECIMAL(12,2))) AS alw
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  GROUP BY 1, 2, 3, 4
),
fx_g AS (
  SELECT p.*, s.s_suppkey, s.s_name, s.s_nationkey, nt.n_name,
         CASE WHEN p.ls = 'O' THEN 3 ELSE 0 END AS o3
  FROM fx_pg p JOIN supplier s ON p.sk = s.s_suppkey JOIN nation nt ON s.s_nationkey = nt.n_nationkey
),
fx_prov AS (
  SELECT
    lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS PRVDR_ID,
    s_name AS PRVDR_NAME,
    'CITY_' || CAST(s_nationkey AS VARCHAR) AS PRVDR_CITY,
    lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS PRVDR_ZIP,
    'NATION_' || CAST(15 + s_nationkey % 5 AS VARCHAR) AS STATE,
    CASE WHEN rf = 'N' THEN 'SNF' WHEN rf = 'A' THEN 'HH' ELSE 'HOSPICE' END AS SRVC_CTGRY,
    'PROVIDER' AS SMRY_CTGRY,
    CASE WHEN ls = 'O' THEN 'CY' ELSE 'FY' END AS YEAR_TYPE,
    CAST(y AS VARCHAR) AS "YEAR",
    CASE WHEN s_suppkey % 41 = 7 AND y = 1997 THEN '6000000000000000000' WHEN (s_suppkey + y) % 17 = 0 THEN '0' ELSE CAST(CAST(qty AS BIGINT) AS VARCHAR) END AS TOT_SRVC_DAYS,
    CAST(n AS VARCHAR) AS TOT_EPSD_STAY_CNT,
    CASE WHEN (s_suppkey + 2 * y) % 29 = 0 THEN '0' ELSE CAST(n_cust AS VARCHAR) END AS BENE_DSTNCT_CNT,
    CASE WHEN (s_suppkey + y) % 31 = 0 THEN '-' || CAST(pay AS VARCHAR) ELSE CAST(pay AS VARCHAR) END AS TOT_MDCR_PYMT_AMT,
    CAST(std AS VARCHAR) AS TOT_MDCR_STDZD_PYMT_AMT,
    CASE WHEN (s_suppkey + y) % 23 = 0 THEN 'n/a' ELSE CAST(chg AS VARCHAR) END AS TOT_CHRG_AMT,
    CAST(alw AS VARCHAR) AS TOT_ALOWD_AMT,
    {_supp('n < 11', 'CAST(0.6 + (s_suppkey % 7) * 0.5 AS DECIMAL(6,2))')} AS BENE_AVG_RISK_SCRE,
    {_supp('n < 11 OR (s_suppkey + y) % 11 = 0', '(s_suppkey * 37 + o3) % 100')} AS BENE_DUAL_PCT,
    {_supp('(s_suppkey + y) % 13 = 0', '(s_nationkey * 41 + y + o3) % 100')} AS BENE_RRL_PCT,
    {generic}
  FROM fx_g
),
fx_state AS (
  SELECT {", ".join(state_cols)}
  FROM fx_prov GROUP BY STATE, SRVC_CTGRY, "YEAR"
),
bronze AS (
  SELECT {", ".join(q(c) for c in BRONZE_COLUMNS)} FROM fx_prov
  UNION ALL
  SELECT {", ".join(q(c) for c in BRONZE_COLUMNS)} FROM fx_state
)"""


# ---------------------------------------------------------------------- silver
def to_double_sql(x: str) -> str:
    d = f"TRY_CAST({x} AS DOUBLE)"
    return f"CASE WHEN abs({d}) < 'inf'::DOUBLE THEN {d} END"


def to_long_sql(x: str) -> str:
    return f"TRY_CAST(trunc(TRY_CAST({x} AS DECIMAL(38,6))) AS BIGINT)"


def pct_sql(x: str) -> str:
    return to_double_sql(f"NULLIF(CAST({x} AS VARCHAR), '*')")


def silver_select(src: str = "bronze") -> str:
    parts = []
    for raw, silver, kind in SILVER_MAPPING:
        x = f"CAST({q(raw)} AS VARCHAR)"
        if kind == "text":
            parts.append(f"{x} AS {q(silver)}")
        elif kind == "long":
            parts.append(f"{to_long_sql(x)} AS {q(silver)}")
            if silver == "YEAR":
                y = to_long_sql(x)
                parts.append(
                    f"CASE WHEN {y} BETWEEN 1 AND 9999 THEN make_date(CAST({y} AS INTEGER), 1, 1) END AS YEAR_DATE"
                )
        elif kind == "money":
            parts.append(f"{to_double_sql(x)} AS {q(silver)}")
        else:
            parts.append(f"{pct_sql(x)} AS {q(silver)}")
    return "SELECT\n  " + ",\n  ".join(parts) + f"\nFROM {src}"


# ------------------------------------------------------------------------ gold
def long_sum_sql(x: str) -> str:
    """The exact sum; beyond the range of a BIGINT the nearest end of it."""
    return f"CASE WHEN sum({x}) IS NOT NULL THEN CAST(least(greatest(sum({x}), -9223372036854775808), 9223372036854775807) AS BIGINT) END"


def _measure_sql(kind: str, src: str) -> str:
    if kind == "sum_long":
        return long_sum_sql(q(src))
    if kind == "sum_money":
        return f"CAST(sum(CAST({q(src)} AS {MONEY})) AS DOUBLE)"
    if kind == "avg":
        return (
            f"CAST(sum(CAST({q(src)} AS {AVERAGE})) AS DOUBLE) / NULLIF(count({q(src)}), 0)"
        )
    raise ValueError(kind)


def safe_div_sql(num: str, den: str) -> str:
    return f"CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0)"


def bands_sql() -> list[str]:
    r, d, u = "avg_bene_risk_score", "avg_dual_pct", "avg_rural_pct"
    return [
        f"CASE WHEN {r} IS NULL THEN 'UNKNOWN' WHEN {r} < 1.5 THEN 'LOW_RISK' "
        f"WHEN {r} < 3.0 THEN 'MEDIUM_RISK' ELSE 'HIGH_RISK' END AS risk_band",
        f"CASE WHEN {d} IS NULL THEN 'UNKNOWN' WHEN {d} < 25 THEN 'LOW_DUAL' "
        f"WHEN {d} < 50 THEN 'MEDIUM_DUAL' WHEN {d} < 75 THEN 'HIGH_DUAL' "
        "ELSE 'VERY_HIGH_DUAL' END AS dual_share_band",
        f"CASE WHEN {u} IS NULL THEN 'UNKNOWN' WHEN {u} >= 50 THEN 'RURAL_DOMINANT' "
        f"WHEN {u} >= 20 THEN 'MIXED' ELSE 'URBAN_DOMINANT' END AS rural_mix_band",
    ]


def _agg_sql(keys, measures, src="silver") -> str:
    cols = [q(k) for k in keys] + [f"{_measure_sql(kind, s)} AS {q(out)}" for out, kind, s in measures]
    return (
        f"SELECT {', '.join(cols)} FROM {src} WHERE summary_category = 'PROVIDER' "
        f"GROUP BY {', '.join(q(k) for k in keys)}"
    )


def gold_ctes() -> str:
    p_ratios = ", ".join(f"{safe_div_sql(n, d)} AS {o}" for o, n, d in PROVIDER_RATIOS)
    s_ratios = ", ".join(f"{safe_div_sql(n, d)} AS {o}" for o, n, d in STATE_RATIOS)
    return f"""
gp_base AS ({_agg_sql(PROVIDER_KEYS, PROVIDER_MEASURES)}),
gp_ratios AS (SELECT *, {p_ratios} FROM gp_base),
gold_provider AS (SELECT *, {", ".join(bands_sql())} FROM gp_ratios),
gs_base AS ({_agg_sql(STATE_KEYS, STATE_MEASURES)}),
gold_state AS (SELECT *, {s_ratios} FROM gs_base)"""


def with_all(body: str) -> str:
    """Prefix a statement with every CTE (bronze, silver, gold); DuckDB drops unused ones."""
    return f"WITH {bronze_ctes()},\nsilver AS (\n{silver_select()}\n),{gold_ctes()}\n{body}"


def cols(names: list[str]) -> str:
    return ", ".join(q(c) for c in names)


GOLD_PROVIDER_COLS = cols(gold_provider_columns())
GOLD_STATE_COLS = cols(gold_state_columns())


def audit_sql(loads: list[tuple[str, str, str]] | None = None) -> str:
    """The audit of all rows; or of each (name, rows of the load, rows whose service days
    were sent as '1')."""
    kinds = {raw: kind for raw, _, kind in SILVER_MAPPING}
    silver_of = {raw: silver for raw, silver, _ in SILVER_MAPPING}
    parts = []
    for name, rows, wrong in loads or [(None, "true", "false")]:
        for raw in NUMERIC_BRONZE_COLUMNS:
            x = f"CAST({q(raw)} AS VARCHAR)"
            if raw == "TOT_SRVC_DAYS" and wrong != "false":
                x = f"(CASE WHEN {wrong} THEN '1' ELSE {x} END)"
            good = f"({(to_long_sql if kinds[raw] == 'long' else to_double_sql)(x)} IS NOT NULL)"
            supp = f"({x} = '*')"
            parts.append(
                f"SELECT {f'{chr(39)}{name}{chr(39)} AS load_name, ' if name else ''}'{raw}' AS source_column, '{silver_of[raw]}' AS silver_column, "
                f"count(*) AS n_rows, count(*) FILTER (WHERE {x} IS NULL) AS n_null, "
                f"count(*) FILTER (WHERE {supp}) AS n_suppressed, "
                f"count(*) FILTER (WHERE {x} IS NOT NULL AND NOT {supp} AND NOT {good}) AS n_bad, "
                f"count(*) FILTER (WHERE {good}) AS n_valid FROM bronze WHERE {rows}"
            )
    return with_all("\nUNION ALL\n".join(parts))
