"""Hand-written edge rows: the cases an oracle over generated data does not reach."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from carepulse.contracts import BRONZE_COLUMNS
from carepulse.operators.gold import build_gold_provider, build_gold_state
from carepulse.operators.serve import kpis
from carepulse.operators.silver import build_silver, suppression_audit

from .conftest import bronze_df, bronze_row


def _silver_one(spark, **cells):
    return build_silver(bronze_df(spark, [bronze_row(**cells)])).collect()[0]


def test_suppressed_cells_become_null(spark):
    r = _silver_one(spark, BENE_FEML_PCT="*", TOT_SRVC_DAYS="*", TOT_CHRG_AMT="*")
    assert r.bene_female_pct is None
    assert r.total_service_days is None
    assert r.total_charge_amt is None


def test_malformed_numbers_become_null_and_are_audited(spark):
    rows = [
        bronze_row(BENE_MALE_PCT=v, TOT_EPSD_STAY_CNT=v, TOT_ALOWD_AMT=v)
        for v in ["", "abc", "1,234", None, "*", "12.5"]
    ]
    silver = build_silver(bronze_df(spark, rows)).collect()
    assert [r.bene_male_pct for r in silver] == [None, None, None, None, None, 12.5]
    assert [r.total_episode_stays for r in silver] == [None, None, None, None, None, 12]
    audit = {r.source_column: r for r in suppression_audit(bronze_df(spark, rows)).collect()}
    for col in ["BENE_MALE_PCT", "TOT_EPSD_STAY_CNT", "TOT_ALOWD_AMT"]:
        a = audit[col]
        assert (a.n_rows, a.n_null, a.n_suppressed, a.n_bad, a.n_valid) == (6, 1, 1, 3, 1), col
    assert audit["YEAR"].n_valid == 6


def test_audit_from_silver_equals_audit_from_bronze(spark):
    cells = ["", "abc", "1,234", None, "*", "12.5", "NaN", "Infinity", "-3", "12.7", "1e3"]
    rows = [
        bronze_row(BENE_MALE_PCT=v, TOT_EPSD_STAY_CNT=v, TOT_ALOWD_AMT=v, YEAR=(v if i % 2 else "2023"))
        for i, v in enumerate(cells)
    ]
    bronze = bronze_df(spark, rows)
    by_parsing = sorted(map(tuple, suppression_audit(bronze).collect()))
    by_silver = sorted(map(tuple, suppression_audit(bronze, build_silver(bronze)).collect()))
    assert by_parsing == by_silver
    assert len(by_silver) == 29


def test_count_text_truncates_like_legacy_cast(spark):
    got = [
        _silver_one(spark, TOT_SRVC_DAYS=v).total_service_days
        for v in ["25.0", "12.7", "-12.7", " 7 ", "1e3"]
    ]
    assert got == [25, 12, -12, 7, 1000]


def test_nan_and_infinity_become_null_and_bands_unknown(spark):
    rows = [
        bronze_row(BENE_AVG_RISK_SCRE="NaN", BENE_DUAL_PCT="Infinity", BENE_RRL_PCT="-Infinity"),
        bronze_row(BENE_AVG_RISK_SCRE="inf", BENE_DUAL_PCT="1e999", BENE_RRL_PCT="-1e999"),
    ]
    silver = build_silver(bronze_df(spark, rows))
    for r in silver.collect():
        assert r.bene_avg_risk_score is None and r.bene_dual_pct is None and r.bene_rural_pct is None
    g = build_gold_provider(silver).collect()
    assert len(g) == 1
    assert (g[0].risk_band, g[0].dual_share_band, g[0].rural_mix_band) == ("UNKNOWN",) * 3


def test_number_text_follows_spark_parsing(spark):
    # A type suffix parses as a number (as Spark's own cast reads it); a count does not.
    r = _silver_one(spark, BENE_FEML_PCT="12d", TOT_SRVC_DAYS="12d", BENE_MALE_PCT=" 4.5 ")
    assert (r.bene_female_pct, r.total_service_days, r.bene_male_pct) == (12.0, None, 4.5)


def test_null_and_bad_year(spark):
    for v in [None, "20x"]:
        r = _silver_one(spark, YEAR=v)
        assert r.YEAR is None and r.YEAR_DATE is None
    r = _silver_one(spark, YEAR="2021")
    assert r.YEAR == 2021 and r.YEAR_DATE == dt.date(2021, 1, 1)


def test_numeric_typed_bronze_column_does_not_fail(spark):
    # A bronze source with an inferred numeric type: the '*' test must not raise under ANSI.
    df = bronze_df(spark, [bronze_row()]).withColumn("BENE_FEML_PCT", F.lit(55.5).cast(T.DoubleType()))
    r = build_silver(df).collect()[0]
    assert r.bene_female_pct == 55.5


def test_leading_zeros_kept(spark):
    r = _silver_one(spark, PRVDR_ID="000042", PRVDR_ZIP="02110")
    assert (r.provider_id, r.provider_zip) == ("000042", "02110")


def test_zero_and_null_denominators(spark):
    rows = [
        bronze_row(PRVDR_ID="1", BENE_DSTNCT_CNT="0", TOT_SRVC_DAYS="*", TOT_CHRG_AMT="0"),
    ]
    g = build_gold_provider(build_silver(bronze_df(spark, rows))).collect()[0]
    assert g.pay_per_bene is None and g.pay_per_service_day is None and g.payment_to_charge_ratio is None
    k = kpis(build_gold_provider(build_silver(bronze_df(spark, rows))), ["YEAR"]).collect()[0]
    assert k.avg_pay_per_bene == 0.0 and k.avg_pay_per_service_day == 0.0
    assert k.total_service_days == 0


def test_band_thresholds(spark):
    cases = [
        ("1.5", "25", "20", ("MEDIUM_RISK", "MEDIUM_DUAL", "MIXED")),
        ("3.0", "50", "50", ("HIGH_RISK", "HIGH_DUAL", "RURAL_DOMINANT")),
        ("1.49", "75", "19.99", ("LOW_RISK", "VERY_HIGH_DUAL", "URBAN_DOMINANT")),
        ("2.99", "24.9", "49.9", ("MEDIUM_RISK", "LOW_DUAL", "MIXED")),
    ]
    rows = [
        bronze_row(PRVDR_ID=str(i), BENE_AVG_RISK_SCRE=r, BENE_DUAL_PCT=d, BENE_RRL_PCT=u)
        for i, (r, d, u, _) in enumerate(cases)
    ]
    got = {
        r.provider_id: (r.risk_band, r.dual_share_band, r.rural_mix_band)
        for r in build_gold_provider(build_silver(bronze_df(spark, rows))).collect()
    }
    for i, (_, _, _, want) in enumerate(cases):
        assert got[str(i)] == want


def test_other_summary_levels_excluded(spark):
    rows = [bronze_row(), bronze_row(SMRY_CTGRY="STATE"), bronze_row(SMRY_CTGRY=None)]
    silver = build_silver(bronze_df(spark, rows))
    assert build_gold_provider(silver).count() == 1
    assert build_gold_state(silver).collect()[0].total_service_days == 10


def test_renamed_provider_gives_two_rows(spark):
    rows = [bronze_row(PRVDR_NAME="Old Name"), bronze_row(PRVDR_NAME="New Name")]
    assert build_gold_provider(build_silver(bronze_df(spark, rows))).count() == 2


def test_null_state_is_one_group(spark):
    rows = [bronze_row(PRVDR_ID="1", STATE=None), bronze_row(PRVDR_ID="2", STATE=None), bronze_row(PRVDR_ID="3")]
    states = build_gold_state(build_silver(bronze_df(spark, rows))).collect()
    assert sorted((r.provider_state or "", r.total_service_days) for r in states) == [("", 20), ("MA", 10)]


def test_averages_are_unweighted_and_sums_exact(spark):
    rows = [
        bronze_row(YEAR_TYPE="CY", BENE_AVG_RISK_SCRE="1.0", TOT_MDCR_PYMT_AMT="0.1", BENE_DSTNCT_CNT="1"),
        bronze_row(YEAR_TYPE="FY", BENE_AVG_RISK_SCRE="2.0", TOT_MDCR_PYMT_AMT="0.2", BENE_DSTNCT_CNT="100"),
        bronze_row(YEAR_TYPE="XX", BENE_AVG_RISK_SCRE="*", TOT_MDCR_PYMT_AMT="*", BENE_DSTNCT_CNT="*"),
    ]
    g = build_gold_provider(build_silver(bronze_df(spark, rows))).collect()[0]
    assert g.avg_bene_risk_score == 1.5  # NULL skipped, not weighted by beneficiaries
    assert g.total_medicare_payment_amt == 0.3  # exact decimal sum, not 0.30000000000000004
    assert g.total_distinct_benes == 101


def test_bronze_contract_has_37_text_columns():
    from carepulse.contracts import bronze_schema, gold_provider_columns, gold_state_columns, silver_schema

    assert len(BRONZE_COLUMNS) == 37
    assert all(isinstance(f.dataType, T.StringType) for f in bronze_schema().fields)
    assert len(silver_schema().fields) == 38
    assert len(gold_provider_columns()) == 33
    assert len(gold_state_columns()) == 15


def test_gold_builds_match_their_contracts(spark):
    from carepulse.contracts import gold_provider_schema, gold_state_schema

    silver = build_silver(bronze_df(spark, [bronze_row()]))
    def shape(schema):
        return [(f.name, f.dataType.simpleString()) for f in schema.fields]
    assert shape(build_gold_provider(silver).schema) == shape(gold_provider_schema())
    assert shape(build_gold_state(silver).schema) == shape(gold_state_schema())
