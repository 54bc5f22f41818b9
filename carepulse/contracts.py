"""Table contracts: bronze (raw text), silver (typed), gold provider and gold state.

Each contract is an explicit ``StructType`` whose field metadata carries a short
comment, so the schema travels with the data when written to Parquet.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Raw (bronze) column -> silver column -> conversion kind. These names and their
# pairing must equal the source data set's published columns, in source order.
#   text  : kept as text (ids are cast to string so leading zeros survive)
#   long  : whole-number count
#   money : amount, double
#   pct   : average or percentage; the text "*" (suppressed cell) becomes NULL
SILVER_MAPPING: list[tuple[str, str, str]] = [
    ("PRVDR_ID", "provider_id", "text"),
    ("PRVDR_NAME", "provider_name", "text"),
    ("PRVDR_CITY", "provider_city", "text"),
    ("PRVDR_ZIP", "provider_zip", "text"),
    ("STATE", "provider_state", "text"),
    ("SRVC_CTGRY", "service_category", "text"),
    ("SMRY_CTGRY", "summary_category", "text"),
    ("YEAR_TYPE", "YEAR_TYPE", "text"),
    ("YEAR", "YEAR", "long"),
    ("TOT_SRVC_DAYS", "total_service_days", "long"),
    ("TOT_EPSD_STAY_CNT", "total_episode_stays", "long"),
    ("BENE_DSTNCT_CNT", "distinct_beneficiaries", "long"),
    ("TOT_MDCR_PYMT_AMT", "total_medicare_payment_amt", "money"),
    ("TOT_MDCR_STDZD_PYMT_AMT", "total_medicare_standardized_payment_amt", "money"),
    ("TOT_CHRG_AMT", "total_charge_amt", "money"),
    ("TOT_ALOWD_AMT", "total_allowed_amt", "money"),
    ("BENE_AVG_AGE", "bene_avg_age", "pct"),
    ("BENE_AVG_RISK_SCRE", "bene_avg_risk_score", "pct"),
    ("BENE_FEML_PCT", "bene_female_pct", "pct"),
    ("BENE_MALE_PCT", "bene_male_pct", "pct"),
    ("BENE_DUAL_PCT", "bene_dual_pct", "pct"),
    ("BENE_RRL_PCT", "bene_rural_pct", "pct"),
    ("BENE_RACE_WHT_PCT", "bene_race_white_pct", "pct"),
    ("BENE_RACE_BLACK_PCT", "bene_race_black_pct", "pct"),
    ("BENE_RACE_HSPNC_PCT", "bene_race_hispanic_pct", "pct"),
    ("BENE_RACE_API_PCT", "bene_race_api_pct", "pct"),
    ("BENE_RACE_NATIND_PCT", "bene_race_natind_pct", "pct"),
    ("BENE_RACE_OTHR_PCT", "bene_race_other_pct", "pct"),
    ("BENE_RACE_UNK_PCT", "bene_race_unknown_pct", "pct"),
    ("PRMRY_DX_RSPSYSTM_PCT", "dx_resp_system_pct", "pct"),
    ("PRMRY_DX_NERVSYSTM_PCT", "dx_nervous_system_pct", "pct"),
    ("PRMRY_DX_DIGSYSTM_PCT", "dx_dig_system_pct", "pct"),
    ("PRMRY_DX_MNTBEHNEUDIS_PCT", "dx_mental_behavior_pct", "pct"),
    ("BENE_CC_PH_DIABETES_V2_PCT", "bene_diabetes_pct", "pct"),
    ("BENE_CC_PH_HYPERTENSION_V2_PCT", "bene_hypertension_pct", "pct"),
    ("BENE_CC_PH_HF_NONIHD_V2_PCT", "bene_heart_failure_pct", "pct"),
    ("BENE_CC_PH_COPD_V2_PCT", "bene_copd_pct", "pct"),
]

# Summary level that marks one provider's row (other levels are roll-ups).
PROVIDER_LEVEL = "PROVIDER"

# Gold provider table: grouping keys, then (output, aggregate, silver input).
GOLD_PROVIDER_KEYS = [
    "YEAR",
    "YEAR_DATE",
    "provider_id",
    "provider_name",
    "provider_state",
    "service_category",
    "summary_category",
]
GOLD_PROVIDER_MEASURES: list[tuple[str, str, str]] = [
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
# (output, numerator, denominator), all over gold provider columns.
GOLD_PROVIDER_RATIOS: list[tuple[str, str, str]] = [
    ("pay_per_bene", "total_medicare_payment_amt", "total_distinct_benes"),
    ("pay_per_service_day", "total_medicare_payment_amt", "total_service_days"),
    ("charge_per_bene", "total_charge_amt", "total_distinct_benes"),
    ("allowed_per_bene", "total_allowed_amt", "total_distinct_benes"),
    ("payment_to_charge_ratio", "total_medicare_payment_amt", "total_charge_amt"),
    ("allowed_to_charge_ratio", "total_allowed_amt", "total_charge_amt"),
    ("episodes_per_bene", "total_episode_stays", "total_distinct_benes"),
]
GOLD_PROVIDER_BANDS = ["risk_band", "dual_share_band", "rural_mix_band"]

GOLD_STATE_KEYS = ["YEAR", "YEAR_DATE", "provider_state", "service_category"]
GOLD_STATE_MEASURES: list[tuple[str, str, str]] = [
    ("total_medicare_payment_amt", "sum_money", "total_medicare_payment_amt"),
    ("total_charge_amt", "sum_money", "total_charge_amt"),
    ("total_distinct_benes", "sum_long", "distinct_beneficiaries"),
    ("total_service_days", "sum_long", "total_service_days"),
    ("avg_bene_risk_score", "avg", "bene_avg_risk_score"),
    ("avg_dual_pct", "avg", "bene_dual_pct"),
    ("avg_rural_pct", "avg", "bene_rural_pct"),
]
GOLD_STATE_RATIOS: list[tuple[str, str, str]] = [
    ("pay_per_bene", "total_medicare_payment_amt", "total_distinct_benes"),
    ("pay_per_service_day", "total_medicare_payment_amt", "total_service_days"),
    ("charge_per_bene", "total_charge_amt", "total_distinct_benes"),
    ("payment_to_charge_ratio", "total_medicare_payment_amt", "total_charge_amt"),
]

# Columns the read side selects from the gold tables (state page, provider pages).
STATE_READ_COLUMNS = [
    "provider_state",
    "service_category",
    "YEAR",
    "YEAR_DATE",
    "total_medicare_payment_amt",
    "total_charge_amt",
    "total_distinct_benes",
    "total_service_days",
    "avg_bene_risk_score",
    "avg_dual_pct",
    "avg_rural_pct",
    "pay_per_bene",
    "pay_per_service_day",
    "charge_per_bene",
    "payment_to_charge_ratio",
]
PROVIDER_READ_COLUMNS = [
    "provider_id",
    "provider_name",
    "provider_state",
    "service_category",
    "YEAR",
    "YEAR_DATE",
    "total_distinct_benes",
    "total_service_days",
    "total_episode_stays",
    "total_medicare_payment_amt",
    "total_charge_amt",
    "total_allowed_amt",
    "pay_per_bene",
    "pay_per_service_day",
    "charge_per_bene",
    "allowed_per_bene",
    "payment_to_charge_ratio",
    "allowed_to_charge_ratio",
    "episodes_per_bene",
    "avg_bene_age",
    "avg_bene_risk_score",
    "avg_dual_pct",
    "avg_rural_pct",
    "avg_female_pct",
    "avg_diabetes_pct",
    "avg_hypertension_pct",
    "avg_heart_failure_pct",
    "avg_copd_pct",
    "risk_band",
    "dual_share_band",
    "rural_mix_band",
]
# Columns the provider page coerces to numbers and zero-fills.
ZERO_FILL_COLUMNS = [
    "total_service_days",
    "total_episode_stays",
    "total_distinct_benes",
    "total_medicare_payment_amt",
    "total_charge_amt",
    "total_allowed_amt",
    "pay_per_bene",
    "pay_per_service_day",
    "charge_per_bene",
    "allowed_per_bene",
    "payment_to_charge_ratio",
    "allowed_to_charge_ratio",
    "episodes_per_bene",
    "avg_bene_age",
    "avg_bene_risk_score",
    "avg_dual_pct",
    "avg_rural_pct",
    "avg_female_pct",
    "avg_diabetes_pct",
    "avg_hypertension_pct",
    "avg_heart_failure_pct",
    "avg_copd_pct",
]
# Columns of the top-providers table.
TOP_TABLE_COLUMNS = [
    "provider_name",
    "provider_id",
    "pay_per_bene",
    "pay_per_service_day",
    "payment_to_charge_ratio",
    "episodes_per_bene",
    "avg_bene_risk_score",
    "risk_band",
    "dual_share_band",
    "rural_mix_band",
]
TOP_N = 10
# --- end of fixed values ----------------------------------------------------

BRONZE_COLUMNS = [raw for raw, _, _ in SILVER_MAPPING]
NUMERIC_BRONZE_COLUMNS = [raw for raw, _, kind in SILVER_MAPPING if kind != "text"]
CORRUPT_RECORD = "_corrupt_record"

_SILVER_TYPES = {
    "text": T.StringType(),
    "long": T.LongType(),
    "money": T.DoubleType(),
    "pct": T.DoubleType(),
}


def _field(name: str, dtype: T.DataType, comment: str) -> T.StructField:
    return T.StructField(name, dtype, True, {"comment": comment})


def bronze_schema(with_corrupt_record: bool = False) -> T.StructType:
    """All-text raw schema; optionally with a column that keeps unparsable lines."""
    fields = [_field(raw, T.StringType(), f"raw text of {silver}") for raw, silver, _ in SILVER_MAPPING]
    if with_corrupt_record:
        fields.append(_field(CORRUPT_RECORD, T.StringType(), "text of a line that did not parse"))
    return T.StructType(fields)


def silver_schema() -> T.StructType:
    fields = []
    for raw, silver, kind in SILVER_MAPPING:
        fields.append(_field(silver, _SILVER_TYPES[kind], f"from {raw} ({kind})"))
        if silver == "YEAR":
            fields.append(_field("YEAR_DATE", T.DateType(), "first day of YEAR; partition column"))
    return T.StructType(fields)


SILVER_COLUMNS = silver_schema().fieldNames()


def gold_provider_columns() -> list[str]:
    return (
        GOLD_PROVIDER_KEYS
        + [m for m, _, _ in GOLD_PROVIDER_MEASURES]
        + [r for r, _, _ in GOLD_PROVIDER_RATIOS]
        + GOLD_PROVIDER_BANDS
    )


def gold_state_columns() -> list[str]:
    return GOLD_STATE_KEYS + [m for m, _, _ in GOLD_STATE_MEASURES] + [r for r, _, _ in GOLD_STATE_RATIOS]


_KEY_TYPES = {"YEAR": T.LongType(), "YEAR_DATE": T.DateType()}
_MEASURE_TYPES = {"sum_long": T.LongType(), "sum_money": T.DoubleType(), "avg": T.DoubleType()}


def _gold_schema(keys, measures, ratios, bands) -> T.StructType:
    fields = [_field(k, _KEY_TYPES.get(k, T.StringType()), "grouping key") for k in keys]
    fields += [_field(out, _MEASURE_TYPES[kind], f"{kind} of silver {src}") for out, kind, src in measures]
    fields += [_field(out, T.DoubleType(), f"{num} / {den}; NULL if the denominator is 0 or NULL") for out, num, den in ratios]
    fields += [_field(b, T.StringType(), "band of the matching average") for b in bands]
    return T.StructType(fields)


def gold_provider_schema() -> T.StructType:
    """provider_year_metrics: 7 keys, 7 sums, 9 averages, 7 ratios, 3 bands."""
    return _gold_schema(GOLD_PROVIDER_KEYS, GOLD_PROVIDER_MEASURES, GOLD_PROVIDER_RATIOS, GOLD_PROVIDER_BANDS)


def gold_state_schema() -> T.StructType:
    """state_year_summary: 4 keys, 4 sums, 3 averages, 4 ratios."""
    return _gold_schema(GOLD_STATE_KEYS, GOLD_STATE_MEASURES, GOLD_STATE_RATIOS, [])


def gold_sketches_schema() -> T.StructType:
    """Sketches of episodes per beneficiary: one per slice and risk band."""
    keys = ["YEAR", "YEAR_DATE", "service_category", "provider_state", "risk_band"]
    fields = [_field(k, _KEY_TYPES.get(k, T.StringType()), "grouping key") for k in keys]
    stats = [("n", T.LongType()), ("min", T.DoubleType()), ("max", T.DoubleType()), ("sketch", T.BinaryType())]
    return T.StructType(fields + [_field(n, t, "of the zero-filled episodes per beneficiary") for n, t in stats])
