"""Sources and sinks: JSON Lines landing, multi-year union, partitioned tables, the stream."""

import os

from pyspark.sql import functions as F

from carepulse.contracts import BRONZE_COLUMNS, CORRUPT_RECORD, silver_schema
from carepulse.operators.silver import build_silver
from carepulse.plans.job import read_gold, run_job
from carepulse.sources.bronze import read_landing, union_years
from carepulse.sources.sinks import read_table, write_table
from carepulse.streaming.incremental import corrupt_lines, load_available, newest_drop, read_loaded

from .conftest import bronze_df, bronze_row


def test_jsonl_bad_line_kept_and_missing_field_null(spark, tmp_dir):
    path = os.path.join(tmp_dir, "drop.jsonl")
    with open(path, "w") as f:
        f.write('{"PRVDR_ID": "000001", "YEAR": "2023", "BENE_DUAL_PCT": "*"}\n')
        f.write("{this is not json\n")
        f.write('{"PRVDR_ID": "000002", "YEAR": 2022}\n')
    df = read_landing(spark, [path], keep_corrupt=True).orderBy(F.col("PRVDR_ID").asc_nulls_last())
    rows = df.collect()
    assert len(rows) == 3
    assert rows[0].PRVDR_ID == "000001" and rows[0].BENE_DUAL_PCT == "*" and rows[0].STATE is None
    assert rows[1].PRVDR_ID == "000002" and rows[1].YEAR == "2022"  # a JSON number read as text
    assert rows[2].PRVDR_ID is None and rows[2][CORRUPT_RECORD] == "{this is not json"


def test_union_years_fills_missing_columns(spark):
    a = bronze_df(spark, [bronze_row(YEAR="2020")]).drop("BENE_CC_PH_COPD_V2_PCT")
    b = bronze_df(spark, [bronze_row(YEAR="2021")])
    out = union_years([a, b])
    assert out.columns == BRONZE_COLUMNS
    got = {r.YEAR: r.BENE_CC_PH_COPD_V2_PCT for r in out.collect()}
    assert got == {"2020": None, "2021": "10"}


def test_partitioned_table_roundtrip_keeps_contract_order(spark, tmp_dir):
    silver = build_silver(bronze_df(spark, [bronze_row(YEAR="2020"), bronze_row(YEAR="2021"), bronze_row(YEAR=None)]))
    path = os.path.join(tmp_dir, "silver")
    write_table(silver, path)
    back = read_table(spark, path, silver_schema())
    assert back.columns == silver.columns
    assert sorted(map(str, back.collect())) == sorted(map(str, silver.collect()))
    dirs = sorted(d for d in os.listdir(path) if d.startswith("YEAR_DATE="))
    assert dirs == ["YEAR_DATE=2020-01-01", "YEAR_DATE=2021-01-01", "YEAR_DATE=__HIVE_DEFAULT_PARTITION__"]


def test_dynamic_overwrite_replaces_only_present_years(spark, tmp_dir):
    root = os.path.join(tmp_dir, "out")
    first = bronze_df(spark, [bronze_row(YEAR="2020"), bronze_row(YEAR="2021")])
    run_job(spark, first, root)
    again = bronze_df(spark, [bronze_row(YEAR="2021", TOT_SRVC_DAYS="99")])
    paths = run_job(spark, again, root, dynamic_overwrite=True)
    gp, gs = read_gold(spark, paths)
    state_rows, n_providers = gs.collect(), gp.count()
    assert {r.YEAR: r.total_service_days for r in state_rows} == {2020: 10, 2021: 99}
    # Running the same partial load twice gives the same tables (idempotent).
    run_job(spark, again, root, dynamic_overwrite=True)
    gp2, gs2 = read_gold(spark, paths)
    assert sorted(map(str, gs2.collect())) == sorted(map(str, state_rows))
    assert gp2.count() == n_providers == 2


def test_stream_reads_new_paths_not_rewritten_ones(spark, tmp_dir):
    landing, table, ckpt = (os.path.join(tmp_dir, d) for d in ("landing", "bronze", "ckpt"))
    os.makedirs(landing)
    first = os.path.join(landing, "drop-1.jsonl")
    with open(first, "w") as f:
        f.write('{"PRVDR_ID": "000001", "STATE": "MA", "SRVC_CTGRY": "SNF", "SMRY_CTGRY": "PROVIDER", '
                '"YEAR_TYPE": "CY", "YEAR": "2023", "TOT_SRVC_DAYS": "5"}\n')
        f.write("not json\n")
    assert load_available(spark, landing, table, ckpt) == 2
    # Rewriting the same path is not picked up again.
    with open(first, "w") as f:
        f.write('{"PRVDR_ID": "000001", "YEAR": "2023", "TOT_SRVC_DAYS": "6"}\n')
    assert load_available(spark, landing, table, ckpt) == 0
    # A new path is, and its copy of the record replaces the older drop's.
    with open(os.path.join(landing, "drop-2.jsonl"), "w") as f:
        f.write('{"PRVDR_ID": "000001", "STATE": "MA", "SRVC_CTGRY": "SNF", "SMRY_CTGRY": "PROVIDER", '
                '"YEAR_TYPE": "CY", "YEAR": "2023", "TOT_SRVC_DAYS": "7"}\n')
    assert load_available(spark, landing, table, ckpt) == 1
    loaded = read_loaded(spark, table)
    assert loaded.count() == 3
    assert [r.TOT_SRVC_DAYS for r in newest_drop(loaded).collect()] == ["7"]
    assert [r[CORRUPT_RECORD] for r in corrupt_lines(loaded).collect()] == ["not json"]


def test_job_cli_from_jsonl_landing(spark, tmp_dir, capsys):
    from carepulse.plans.job import main
    from carepulse.sources.bronze import write_landing

    landing = os.path.join(tmp_dir, "landing")
    rows = [bronze_row(PRVDR_ID="1", YEAR="2022"), bronze_row(PRVDR_ID="2", YEAR="2023", STATE="RI")]
    write_landing(bronze_df(spark, rows), landing)
    out = os.path.join(tmp_dir, "warehouse")
    main(["--bronze", landing, "--format", "json", "--out", out])
    gp, gs = read_gold(spark, {k: f"{out}/{k}" for k in ("silver", "gold_provider", "gold_state")})
    assert sorted((r.YEAR, r.provider_state) for r in gs.collect()) == [(2022, "MA"), (2023, "RI")]
    assert gp.count() == 2
    assert "gold_state" in capsys.readouterr().out
    # The job joined this session, so it left the session's settings alone.
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) is None


def test_continuous_load_picks_up_new_files(spark, tmp_dir):
    from carepulse.streaming.incremental import start_continuous_load

    landing, table, ckpt = (os.path.join(tmp_dir, d) for d in ("landing", "bronze", "ckpt"))
    os.makedirs(landing)
    with open(os.path.join(landing, "a.jsonl"), "w") as f:
        f.write('{"PRVDR_ID": "1", "YEAR": "2023"}\n')
    q = start_continuous_load(spark, landing, table, ckpt, every="1 second")
    try:
        q.processAllAvailable()
        with open(os.path.join(landing, "b.jsonl"), "w") as f:
            f.write('{"PRVDR_ID": "2", "YEAR": "2023"}\n')
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r.PRVDR_ID for r in read_loaded(spark, table).collect()) == ["1", "2"]


def test_backlog_drained_in_bounded_batches(spark, tmp_dir):
    landing, table, ckpt = (os.path.join(tmp_dir, d) for d in ("landing", "bronze", "ckpt"))
    os.makedirs(landing)
    for i in range(3):
        with open(os.path.join(landing, f"drop-{i}.jsonl"), "w") as f:
            f.write(f'{{"PRVDR_ID": "{i}", "YEAR": "2023"}}\n')
    assert load_available(spark, landing, table, ckpt, max_files_per_trigger=1) == 3
    assert sorted(r.PRVDR_ID for r in read_loaded(spark, table).collect()) == ["0", "1", "2"]
    assert len([f for f in os.listdir(os.path.join(ckpt, "commits")) if not f.startswith(".")]) == 3


def test_report_pages(spark, tmp_dir, capsys):
    from carepulse.plans.report import main as report_main
    from carepulse.plans.report import provider_page, state_page

    rows = [
        bronze_row(PRVDR_ID="1", YEAR="2023", TOT_MDCR_PYMT_AMT="100", BENE_DSTNCT_CNT="10"),
        bronze_row(PRVDR_ID="2", YEAR="2023", TOT_MDCR_PYMT_AMT="300", BENE_DSTNCT_CNT="10"),
        bronze_row(PRVDR_ID="3", YEAR="2023", STATE="RI", TOT_MDCR_PYMT_AMT="50", BENE_DSTNCT_CNT="0"),
    ]
    root = os.path.join(tmp_dir, "wh")
    paths = run_job(spark, bronze_df(spark, rows), root)
    gp, gs = read_gold(spark, paths)
    sp = state_page(gs, 2023, "SNF")
    k = sp["national_kpis"].collect()[0]
    assert (k.total_medicare_payment_amt, k.total_distinct_benes, k.avg_pay_per_bene) == (450.0, 20, 22.5)
    assert [r.provider_state for r in sp["states_by_pay_per_bene"].collect()] == ["MA", "RI"]
    pp = provider_page(gp, 2023, "SNF", "MA")
    assert [r.provider_id for r in pp["top_providers"].collect()] == ["2", "1"]
    assert pp["state_kpis"].collect()[0].avg_pay_per_bene == 20.0
    report_main(["--tables", root, "--year", "2023", "--state", "MA"])
    out = capsys.readouterr().out
    assert "== top_providers" in out and "== episodes_by_risk_band" in out


def test_loaded_files_are_archived_out_of_the_landing_folder(spark, tmp_dir):
    import time

    landing, table, ckpt, archive = (os.path.join(tmp_dir, d) for d in ("landing", "bronze", "ckpt", "archive"))
    os.makedirs(landing)
    for i in range(2):
        with open(os.path.join(landing, f"drop-{i}.jsonl"), "w") as f:
            f.write(f'{{"PRVDR_ID": "{i}", "YEAR": "2023"}}\n')
    assert load_available(spark, landing, table, ckpt, max_files_per_trigger=1, archive_dir=archive) == 2

    def archived():
        return {f for _, _, files in os.walk(archive) for f in files if f.endswith(".jsonl")}

    # A batch's files are moved (by a background cleaner) once the next batch
    # starts: the first batch's drop leaves now, the last one on the next run.
    deadline = time.time() + 30
    while time.time() < deadline and not archived():
        time.sleep(0.2)
    moved = archived()
    assert len(moved) == 1
    assert not moved & set(os.listdir(landing))
    assert sorted(r.PRVDR_ID for r in read_loaded(spark, table).collect()) == ["0", "1"]
