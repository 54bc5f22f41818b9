"""Many slices at once, mergeable quantile sketches, SQL table functions, drifting fields, bucketed tables."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from carepulse.contracts import PROVIDER_READ_COLUMNS, gold_provider_schema, silver_schema
from carepulse.functions.sql import register_sql_functions, register_table_functions
from carepulse.operators import serve
from carepulse.operators.sketches import box_of_sketches, merge_sketches, sketch_values
from carepulse.plans import catalog
from carepulse.plans.job import main, read_gold, run_job
from carepulse.sources.bronze import drift_report, read_landing_rescued
from carepulse.sources.sinks import read_table

from .conftest import SMOKE_DIR, bronze_df, bronze_row
from .test_plans import _formatted


@pytest.fixture()
def gold(spark, tmp_dir):
    rows = [
        bronze_row(PRVDR_ID=f"{i:03d}", YEAR=str(2019 + i % 4), STATE=("MA", "RI", "CT")[i % 3], SRVC_CTGRY=("SNF", "HH")[i % 2], TOT_MDCR_PYMT_AMT=str(i * 10))
        for i in range(120)
    ]
    return read_gold(spark, run_job(spark, bronze_df(spark, rows + [bronze_row(YEAR="bad")]), os.path.join(tmp_dir, "out")))


def bag(df):
    return sorted(map(str, df.collect()))


# ------------------------------------------------------------- many selections
def test_selections_equal_the_union_of_single_reads(spark, gold):
    gp, _ = gold
    picks = [(2020, "HH", "MA"), (2021, "SNF", "RI"), (2020, "HH", "MA"), (1900, "SNF", "MA"), (None, "SNF", "MA"), (2019, None, "MA"), (99999, "SNF", "CT")]
    selections = spark.createDataFrame(picks, "YEAR long, service_category string, provider_state string")
    got = bag(serve.load_slices(gp, selections, PROVIDER_READ_COLUMNS))
    single = [serve.load_provider_metrics(gp, y, s, c) for y, c, s in ((2020, "HH", "MA"), (2021, "SNF", "RI"))]
    assert got == bag(single[0].unionByName(single[1])) and got
    whole = serve.load_slices(gp, selections.drop("provider_state"), PROVIDER_READ_COLUMNS)
    single = [serve.load_provider_data(gp, y, c) for y, c in ((2020, "HH"), (2021, "SNF"))]
    assert bag(whole) == bag(single[0].unionByName(single[1]))
    assert serve.load_slices(gp, selections.limit(0), PROVIDER_READ_COLUMNS).count() == 0


@pytest.mark.parametrize("name", ["provider_read_selections", "state_read_selections"])
def test_selections_prune_partitions_at_run_time(spark, name):
    plan = _formatted(catalog.QUERIES[name](spark, SMOKE_DIR))
    assert "dynamicpruningexpression(YEAR_DATE" in plan.replace(" ", "")


# ------------------------------------------------------------------- sketches
def test_sketches_of_few_values_are_exact_and_merge(spark):
    rng = random.Random(1)
    values = [(y, round(rng.gauss(10, 4), 3)) for y in range(5) for _ in range(300)] + [(9, None)]
    df = spark.createDataFrame(values, "y int, v double")
    merged = merge_sketches(sketch_values(df, ["y"], "v"), [])
    row = box_of_sketches(merged, []).first()
    xs = sorted(v for _, v in values if v is not None)
    at = lambda p: xs[max(1, -(-len(xs) * int(p * 100) // 100)) - 1]
    assert (row["n"], row["min"], row["q1"], row["median"], row["q3"], row["max"]) == (1500, xs[0], at(0.25), at(0.5), at(0.75), xs[-1])
    assert sketch_values(df, ["y"], "v").where("y = 9").count() == 0
    assert box_of_sketches(sketch_values(df.limit(0), ["y"], "v"), ["y"]).count() == 0


def test_rank_error_of_large_slices_is_within_the_bound(spark):
    k = 200
    df = spark.range(0, 300_000, 1, 6).selectExpr("id % 3 AS g", "pow(rand(7), 3) * 1000 - 20 AS v")
    merged = merge_sketches(sketch_values(df.withColumn("part", F.expr("spark_partition_id()")), ["g", "part"], "v", k), ["g"])
    boxes = {r["g"]: r for r in box_of_sketches(merged, ["g"]).collect()}
    ranks = df.groupBy("g").agg(F.count("v").alias("n"), *[F.sum(F.when(F.col("v") <= F.create_map(*[x for g, b in boxes.items() for x in (F.lit(g), F.lit(b[q]))])[F.col("g")], 1).otherwise(0)).alias(q) for q in ("q1", "median", "q3")])
    for r in ranks.collect():
        for q, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            assert abs(r[q] / r["n"] - p) < 2.3 / k**0.9, (q, r)
        assert boxes[r["g"]]["n"] == r["n"] == 100_000


def test_multi_year_box_reads_sketches_and_sorts_nothing(spark):
    plan = _formatted(catalog.QUERIES["episodes_box_all_years"](spark, SMOKE_DIR))
    assert "gold_sketches" in plan and "Sort " not in plan and "Window" not in plan and "gold_provider" not in plan


# --------------------------------------------------------- SQL table functions
def test_table_functions_are_inlined_down_to_the_scan(spark):
    for name in ("sql_state_slice", "sql_provider_slice", "sql_top_slice"):
        plan = _formatted(catalog.QUERIES[name](spark, SMOKE_DIR))
        assert "(YEAR_DATE" in plan.split("PartitionFilters: [")[1].split("]\n")[0], name
        assert "EqualTo(service_category,SNF)" in plan, name
    assert "EqualTo(provider_state,NATION_19)" in _formatted(catalog.QUERIES["sql_provider_slice"](spark, SMOKE_DIR))


def test_table_functions_against_the_dataframe_reads(spark, gold):
    gp, gs = gold
    gp.createOrReplaceTempView("fn_gp"), gs.createOrReplaceTempView("fn_gs")
    register_sql_functions(spark)
    assert register_table_functions(spark, "fn_gp", "fn_gs") == ["state_slice", "provider_slice", "top_slice", "national_kpi"]
    assert bag(spark.sql("SELECT * FROM state_slice(2020L, 'HH')")) == bag(serve.load_state_summary(gs, 2020, "HH"))
    assert bag(spark.sql("SELECT * FROM provider_slice(2020L, 'HH', 'RI')")) == bag(serve.load_provider_metrics(gp, 2020, "RI", "HH"))
    assert bag(spark.sql("SELECT * FROM provider_slice(2020L, 'HH', NULL)")) == bag(serve.load_provider_data(gp, 2020, "HH"))
    top = spark.sql("SELECT provider_id FROM top_slice(2020L, 'HH', 'RI', 2) ORDER BY pay_rank").collect()
    want = serve.top_providers_of_slice(serve.load_provider_metrics(gp, 2020, "RI", "HH"), 2).orderBy("pay_rank").collect()
    assert [r.provider_id for r in top] == [r.provider_id for r in want]
    kpi = spark.sql("SELECT * FROM national_kpi(2020L, 'HH')").first()
    both = serve.kpis(serve.load_state_summary(gs, 2020, "HH"), ["YEAR"]).first()
    assert (kpi.total_distinct_benes, kpi.total_service_days) == (both.total_distinct_benes, both.total_service_days)
    bands = spark.sql("SELECT risk_band(1.5D) r, risk_band(NULL) u, dual_share_band(75D) d, rural_mix_band(20D) m, whole('12.7') w").first()
    assert tuple(bands) == ("MEDIUM_RISK", "UNKNOWN", "VERY_HIGH_DUAL", "MIXED", 12)


# ------------------------------------------------------------- drifting fields
def test_fields_outside_the_contract_are_kept_and_reported(spark, tmp_dir):
    landing, out = os.path.join(tmp_dir, "landing"), os.path.join(tmp_dir, "out")
    os.makedirs(landing)
    renamed = {("CITY" if k == "PRVDR_CITY" else k): v for k, v in bronze_row(PRVDR_ID="2").items()}
    lines = {
        "a.json": [json.dumps(bronze_row()), "{broken", ""],
        "b.json": [json.dumps(renamed | {"BEDS": {"n": 12, "kinds": ["x", None]}}), json.dumps(renamed | {"BEDS": None, "STATE": 5})],
    }
    for name, text in lines.items():
        with open(os.path.join(landing, name), "w") as f:
            f.write("\n".join(text) + "\n")
    rescued = read_landing_rescued(spark, [landing])
    got = rescued.selectExpr("PRVDR_ID", "STATE", "PRVDR_CITY", "variant_get(_rescued, '$.CITY', 'string') c", "variant_get(_rescued, '$.BEDS.n', 'int') n", "_rescued IS NULL AS clean")
    assert sorted(map(tuple, got.collect()), key=str) == [("000123", "MA", "Springfield", None, None, True), ("2", "5", None, "Springfield", None, False), ("2", "MA", None, "Springfield", 12, False)]
    report = sorted((r.field, r.kind, os.path.basename(r.source_file), r.n_rows) for r in drift_report(rescued).collect())
    assert report == [("BEDS", "extra", "b.json", 2), ("CITY", "extra", "b.json", 2), ("PRVDR_CITY", "missing", "b.json", 2)]
    main(["--bronze", landing, "--format", "json", "--out", out, "--drift"])
    assert spark.read.parquet(f"{out}/drift").count() == 3
    assert read_table(spark, f"{out}/silver", silver_schema()).count() == 3


# ------------------------------------------------------------- bucketed tables
def test_aggregation_by_the_bucket_column_needs_no_exchange(spark):
    plan = _formatted(catalog.QUERIES["bucketed_provider_totals"](spark, SMOKE_DIR))
    assert "Exchange" not in plan and "Bucketed: true" in plan


def test_job_publishes_named_bucketed_tables(spark, tmp_dir):
    landing, out = os.path.join(tmp_dir, "bronze"), os.path.join(tmp_dir, "out")
    bronze_df(spark, [bronze_row(PRVDR_ID=str(i)) for i in range(20)]).write.parquet(landing)
    prefix = f"t{os.path.basename(tmp_dir).replace('-', '_')}_"
    try:
        main(["--bronze", landing, "--out", out, "--database", "default", "--buckets", "4", "--prefix", prefix])
        named = read_table(spark, None, gold_provider_schema(), table=f"default.{prefix}gold_provider")
        assert bag(named) == bag(read_gold(spark, {t: f"{out}/{t}" for t in ("gold_provider", "gold_state")})[0])
        silver = read_table(spark, None, silver_schema(), table=f"default.{prefix}silver")
        joined = silver.groupBy("provider_id", "YEAR").count().join(named, ["provider_id", "YEAR"])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert "Exchange" not in _formatted(silver.groupBy("provider_id").count()) and joined.count() == 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in ("silver", "gold_provider", "gold_state"):
            spark.sql(f"DROP TABLE IF EXISTS default.{prefix}{t}")
