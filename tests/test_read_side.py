"""Read-side operators: ordering, zero fill, top-N, exact quantiles against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from carepulse.operators.quantiles import box_summary, exact_quantiles
from carepulse.operators.serve import chart_order, top_providers, zero_fill
from carepulse.sources.sinks import is_empty


def _providers(spark, pays):
    rows = [
        (2023, "SNF", "MA", f"{i:03d}", f"P{i}", p, 1.0, 0.5, 1.0, 2.0, "LOW_RISK", "LOW_DUAL", "MIXED")
        for i, p in enumerate(pays)
    ]
    schema = (
        "YEAR long, service_category string, provider_state string, provider_id string, provider_name string, "
        "pay_per_bene double, pay_per_service_day double, payment_to_charge_ratio double, episodes_per_bene double, "
        "avg_bene_risk_score double, risk_band string, dual_share_band string, rural_mix_band string"
    )
    return spark.createDataFrame(rows, schema)


def test_top_n_nulls_last_and_stable_ties(spark):
    df = _providers(spark, [5.0, None, 7.0, 5.0, -1.0])
    got = [(r.provider_id, r.pay_rank) for r in top_providers(df).orderBy("pay_rank").collect()]
    assert got == [("002", 1), ("000", 2), ("003", 3), ("004", 4), ("001", 5)]


def test_top_n_zero_filled_ranks_null_with_zero_above_negative(spark):
    df = zero_fill(_providers(spark, [None, -3.0, 2.0]), ["pay_per_bene"])
    got = [(r.provider_id, r.pay_per_bene) for r in top_providers(df).orderBy("pay_rank").collect()]
    assert got == [("002", 2.0), ("000", 0.0), ("001", -3.0)]


def test_top_n_limits_each_group(spark):
    df = _providers(spark, [float(i) for i in range(25)])
    other = df.withColumn("provider_state", F.lit("RI")).where(F.col("pay_per_bene") < 4)
    top = top_providers(df.unionByName(other))
    counts = {r.provider_state: r["count"] for r in top.groupBy("provider_state").count().collect()}
    assert counts == {"MA": 10, "RI": 4}
    best = [r.pay_per_bene for r in top.where(F.col("provider_state") == "MA").orderBy("pay_rank").collect()]
    assert best == [float(i) for i in range(24, 14, -1)]


def test_chart_order_is_ascending_nulls_last(spark):
    df = _providers(spark, [3.0, None, 1.0])
    got = [r.pay_per_bene for r in chart_order(top_providers(df)).collect()]
    assert got == [1.0, 3.0, None]


def test_is_empty(spark):
    df = _providers(spark, [1.0])
    assert not is_empty(df)
    assert is_empty(df.where(F.col("pay_per_bene") > 10))


def _brute(values, p):
    return float(np.quantile(np.array(values, dtype=float), p, method="linear"))


@pytest.mark.parametrize("n_partitions", [1, 3, 16])
def test_exact_quantiles_match_brute_force_on_skewed_groups(spark, n_partitions):
    rnd = random.Random(7)
    rows = []
    # One hot group with a third of all rows, spread by range partitioning.
    rows += [("hot", rnd.choice([0.0, 1.5, rnd.random() * 100])) for _ in range(1500)]
    for g in range(30):
        rows += [(f"g{g}", rnd.random() * 10) for _ in range(rnd.randint(1, 100))]
    rows += [(None, 4.0), (None, 2.0), ("g0", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p90": 0.9}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs, n_partitions=n_partitions).collect()}
    by_key = {}
    for k, v in rows:
        if v is not None:
            by_key.setdefault(k, []).append(v)
    assert set(got) == set(by_key)
    for k, vals in by_key.items():
        r = got[k]
        assert r.n == len(vals)
        assert r["min"] == min(vals) and r["max"] == max(vals)
        for name, p in probs.items():
            assert r[name] == pytest.approx(_brute(vals, p), rel=1e-12, abs=1e-12), (k, name)


def test_box_summary_whiskers(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([("a", v) for v in vals], "k string, v double")
    r = box_summary(df, ["k"], "v").collect()[0]
    assert (r.q1, r.median, r.q3) == (2.0, 3.0, 4.0)
    assert (r.lower_whisker, r.upper_whisker, r.n_outliers) == (1.0, 4.0, 1)


def test_repeated_value_run_is_split_across_partitions(spark):
    from carepulse.operators.quantiles import ordered_values

    # A third of all rows are the same (group, value) pair.
    rows = [("hot", 0.0)] * 3000 + [(f"g{i % 50}", float(i)) for i in range(6000)]
    df = spark.createDataFrame(rows, "k string, v double")
    ordered = ordered_values(df, ["k"], "v", n_partitions=12)
    per_part = ordered.where("k = 'hot'").groupBy("_pid").count().collect()
    assert len(per_part) >= 3
    assert max(r["count"] for r in per_part) < 3000
    q = exact_quantiles(df, ["k"], "v", {"median": 0.5}, n_partitions=12).where("k = 'hot'").collect()[0]
    assert (q.n, q.median) == (3000, 0.0)
