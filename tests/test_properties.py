"""Properties of the gold tables on the derived test data."""

import pytest
from pyspark.sql import functions as F

from carepulse.contracts import GOLD_PROVIDER_RATIOS
from carepulse.plans import catalog

from .conftest import SMOKE_DIR

KEYS = ["YEAR", "provider_state", "service_category"]


@pytest.fixture(scope="module")
def gold(spark):
    return catalog.gold(spark, SMOKE_DIR)


def test_state_sums_equal_sum_of_provider_sums(gold):
    gp, gs = gold
    measures = ["total_distinct_benes", "total_service_days", "total_medicare_payment_amt", "total_charge_amt"]
    from_providers = gp.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in measures])
    a = {tuple(r[k] for k in KEYS): r for r in from_providers.collect()}
    b = {tuple(r[k] for k in KEYS): r for r in gs.collect()}
    assert a.keys() == b.keys()
    for key, r in a.items():
        for m in measures:
            assert r[m] == pytest.approx(b[key][m], rel=1e-9), (key, m)


def test_every_provider_row_has_exactly_one_value_per_band(gold):
    gp, _ = gold
    bad = gp.where(
        F.col("risk_band").isNull() | F.col("dual_share_band").isNull() | F.col("rural_mix_band").isNull()
    )
    assert bad.count() == 0


def test_ratio_times_denominator_is_numerator(gold):
    gp, _ = gold
    for out, num, den in GOLD_PROVIDER_RATIOS:
        rows = gp.where(F.col(out).isNotNull()).select(out, num, den).collect()
        assert rows, out
        for r in rows:
            assert r[out] * r[den] == pytest.approx(r[num], rel=1e-9), out
        # NULL exactly when the denominator is 0 or NULL, or no cell of the numerator parsed.
        nulls = gp.where(F.col(out).isNull() & F.col(num).isNotNull() & (F.col(den) != 0)).count()
        assert nulls == 0, out
