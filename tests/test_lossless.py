"""Nothing is lost: sums of any finite cell, drops of several files, partial reruns, bad lines, named tables."""

import json
import os
import random

from pyspark.sql import functions as F

from carepulse.contracts import CORRUPT_RECORD, gold_state_schema, silver_schema
from carepulse.functions.expr import exact_avg, exact_sum_double
from carepulse.operators import serve
from carepulse.operators.gold import build_gold_state
from carepulse.operators.silver import build_silver, suppression_audit
from carepulse.plans.job import main, read_gold, run_job
from carepulse.sources.bronze import read_bronze, read_landing
from carepulse.sources.sinks import read_table, write_table
from carepulse.streaming.incremental import load_available, newest_drop, read_loaded

from .conftest import bronze_df, bronze_row


def summed(spark, cells, scale=4):
    df = spark.createDataFrame([(float(c),) for c in cells], "x double").repartition(3)
    return df.agg(exact_sum_double("x", scale).alias("s")).first()["s"]


def test_sums_of_every_finite_cell(spark):
    assert summed(spark, [1e20, 1.5]) == 1e20
    assert summed(spark, [5e18, 5e18]) == 1e19
    assert summed(spark, [1e308, -1e308, 0.25]) in (0.25, 0.0)
    assert abs(summed(spark, [0.00001] * 10) - 0.0001) < 1e-15
    assert summed(spark, [0.1] * 10 + [-0.3, 2.2]) == 2.9
    assert summed(spark, [123456789.1234, -0.0004, 7e9 + 0.5]) == 7123456789.623
    rng = random.Random(1)
    cells = [round(rng.uniform(-1e6, 1e9), 4) for _ in range(3000)]
    want = float(sum(int(round(c * 10**4)) for c in cells)) / 1e4
    assert {summed(spark, sorted(cells, key=lambda _: rng.random())) for _ in range(3)} == {want}
    df = spark.createDataFrame([(1e200,), (None,), (3e200,)], "x double")
    assert df.agg(exact_avg("x").alias("a")).first()["a"] == 2e200


def test_a_huge_cell_does_not_fail_the_job(spark, tmp_dir):
    rows = [bronze_row(TOT_CHRG_AMT="1e20"), bronze_row(PRVDR_ID="2", TOT_CHRG_AMT="5", BENE_AVG_RISK_SCRE="1e19")]
    gold_provider, gold_state = read_gold(spark, run_job(spark, bronze_df(spark, rows), tmp_dir))
    assert gold_state.first()["total_charge_amt"] == 1e20 and gold_provider.count() == 2
    kpi = serve.national_kpis(gold_state).first()
    assert kpi["total_medicare_payment_amt"] == 20.0


def drop(landing, name, rows, files=1):
    folder = os.path.join(landing, name)
    os.makedirs(folder)
    for i in range(files):
        with open(os.path.join(folder, f"part-{i}.json"), "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows[i::files])


def test_a_drop_of_several_files_is_one_drop_and_names_order_drops(spark, tmp_dir):
    landing, table, ckpt = (os.path.join(tmp_dir, d) for d in ("landing", "bronze", "ckpt"))
    twice = [bronze_row(PRVDR_NAME="old"), bronze_row(PRVDR_NAME="new")]
    drop(landing, "2024-02", twice, files=2)
    drop(landing, "2024-01", [bronze_row(PRVDR_NAME="older"), bronze_row(PRVDR_ID="9", PRVDR_NAME="only here")])
    # All files carry one stamp, as where a store keeps seconds; the later name still wins.
    for folder, _, names in os.walk(landing):
        for n in names:
            os.utime(os.path.join(folder, n), (1_700_000_000, 1_700_000_000))
    assert load_available(spark, landing, table, ckpt) == 4
    drop(landing, "2023-12", [bronze_row(PRVDR_NAME="late but old")])
    assert load_available(spark, landing, table, ckpt) == 1
    loaded = read_loaded(spark, table)
    assert sorted(r.PRVDR_NAME for r in newest_drop(loaded).collect()) == ["new", "old", "only here"]
    assert newest_drop(loaded, years=["1999"]).count() == 0
    assert sorted(r.PRVDR_NAME for r in newest_drop(loaded, years=["2023"]).collect()) == ["new", "old", "only here"]


def test_rows_of_more_batches_than_progress_keeps(spark, tmp_dir):
    landing, table, ckpt = (os.path.join(tmp_dir, d) for d in ("landing", "bronze", "ckpt"))
    for i in range(104):
        drop(landing, f"d{i:04d}", [bronze_row(PRVDR_ID=str(i))])
    assert load_available(spark, landing, table, ckpt, max_files_per_trigger=1) == 104
    assert read_loaded(spark, table).count() == 104


def test_job_over_the_streamed_table_counts_a_resent_record_once(spark, tmp_dir):
    landing, table, ckpt, out = (os.path.join(tmp_dir, d) for d in ("landing", "bronze", "ckpt", "out"))
    drop(landing, "d1", [bronze_row(TOT_SRVC_DAYS="5")])
    with open(os.path.join(landing, "d1", "bad.json"), "w") as f:
        f.write("no json\n")
    drop(landing, "d2", [bronze_row(TOT_SRVC_DAYS="7")])
    load_available(spark, landing, table, ckpt)
    main(["--bronze", table, "--incremental", "--out", out])
    _, gold_state = read_gold(spark, {k: f"{out}/{k}" for k in ("gold_provider", "gold_state")})
    assert [r.total_service_days for r in gold_state.collect()] == [7]
    assert [r[CORRUPT_RECORD] for r in spark.read.parquet(f"{out}/quarantine").collect()] == ["no json"]


def test_bad_lines_are_no_rows_and_go_to_quarantine(spark, tmp_dir):
    landing, out = os.path.join(tmp_dir, "landing"), os.path.join(tmp_dir, "out")
    drop(landing, "d1", [bronze_row()])
    with open(os.path.join(landing, "d1", "bad.json"), "w") as f:
        f.write("{broken\n")
    path = os.path.join(landing, "d1")
    assert read_landing(spark, [path]).count() == read_bronze(spark, path, "json").count() == 1
    main(["--bronze", path, "--format", "json", "--option", "encoding=UTF-8", "--out", out])
    assert spark.read.parquet(f"{out}/silver").count() == 1
    bad = spark.read.parquet(f"{out}/quarantine").collect()
    assert [r[CORRUPT_RECORD] for r in bad] == ["{broken"] and bad[0]["file"].endswith("bad.json")


def test_partial_rerun_keeps_earlier_undated_rows_and_audits_itself(spark, tmp_dir):
    first = [bronze_row(PRVDR_ID="A", YEAR="n/a"), bronze_row(PRVDR_ID="A", YEAR="2021"), bronze_row(PRVDR_ID="C", YEAR="2022")]
    again = bronze_df(spark, [bronze_row(PRVDR_ID="B", YEAR="bad"), bronze_row(PRVDR_ID="D", YEAR="2022", TOT_CHRG_AMT="x1", BENE_DUAL_PCT="*")])
    run_job(spark, bronze_df(spark, first), tmp_dir)
    for _ in range(2):  # running a load again changes nothing
        paths = run_job(spark, again, tmp_dir, dynamic_overwrite=True)
        silver = read_table(spark, paths["silver"], silver_schema()).collect()
        assert sorted((r.provider_id, r.YEAR) for r in silver if r.YEAR is not None) == [("A", 2021), ("D", 2022)]
        assert sorted(r.provider_id for r in silver if r.YEAR is None) == ["A", "B"]
        gold_provider, _ = read_gold(spark, paths)
        assert sorted(r.provider_id for r in gold_provider.collect()) == ["A", "A", "B", "D"]
        audit = sorted(map(tuple, spark.read.parquet(paths["audit"]).collect()))
        assert audit == sorted(map(tuple, suppression_audit(again).collect()))
        assert all(n >= 0 for r in audit for n in r[2:])


def test_named_tables(spark, tmp_dir):
    silver = build_silver(bronze_df(spark, [bronze_row(YEAR="2022"), bronze_row(YEAR="2023")]))
    name, path = f"gold_state_{os.path.basename(tmp_dir).replace('-', '_')}", os.path.join(tmp_dir, "t")
    try:
        write_table(build_gold_state(silver), path, table=name)
        back = read_table(spark, None, gold_state_schema(), table=name)
        assert sorted(map(str, back.collect())) == sorted(map(str, build_gold_state(silver).collect()))
        changed = build_silver(bronze_df(spark, [bronze_row(YEAR="2023", TOT_SRVC_DAYS="99")]))
        write_table(build_gold_state(changed), path, table=name, dynamic_overwrite=True)
        back = read_table(spark, None, gold_state_schema(), table=name)
        assert {r.YEAR: r.total_service_days for r in back.collect()} == {2022: 10, 2023: 99}
        got = serve.load_state_summary_sql(spark, name, 2023, "SNF")
        assert [r.total_service_days for r in got.collect()] == [99]
        assert serve.load_state_summary_sql(spark, name, 99999, "SNF").count() == 0
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_other_formats(spark, tmp_dir):
    silver = build_silver(bronze_df(spark, [bronze_row()]))
    path = write_table(silver, os.path.join(tmp_dir, "orc"), fmt="orc", compression="zlib")
    assert read_table(spark, path, silver_schema(), fmt="orc").collect() == silver.collect()


def test_one_slice_is_a_plain_top_k(spark, tmp_dir):
    rows = [bronze_row(PRVDR_ID=f"{i:03d}", TOT_MDCR_PYMT_AMT=str((i * 7) % 40), BENE_DSTNCT_CNT="10" if i % 9 else "0") for i in range(40)]
    gold_provider, _ = read_gold(spark, run_job(spark, bronze_df(spark, rows), tmp_dir))
    one = serve.load_provider_metrics(gold_provider, 2023, "MA", "SNF")
    top = serve.top_providers_of_slice(one)
    assert sorted(map(str, top.collect())) == sorted(map(str, serve.top_providers(one).collect()))
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()
    filled = serve.top_providers_of_slice(serve.zero_fill(one).where(F.col("pay_per_bene") <= 0))
    assert filled.count() == 5


def test_a_year_is_written_to_few_files(spark, tmp_dir):
    rows = [bronze_row(PRVDR_ID=str(i), YEAR=str(2015 + i % 5)) for i in range(200)]
    path = write_table(build_silver(bronze_df(spark, rows).repartition(8)), os.path.join(tmp_dir, "s"))
    for d in os.listdir(path):
        if d.startswith("YEAR_DATE="):
            assert len([f for f in os.listdir(os.path.join(path, d)) if f.endswith(".parquet")]) == 1
