"""Loads that are committed together, merged gold state, arrivals through the ledger, wide sums."""

import json
import os

import pytest
from pyspark.sql import functions as F

from carepulse.contracts import gold_provider_schema, gold_state_schema, silver_schema
from carepulse.operators import serve
from carepulse.operators.gold import build_gold_provider, build_gold_state, finish_gold_provider, finish_gold_state, gold_state_parts, merge_gold_states
from carepulse.operators.silver import build_silver, suppression_audit
from carepulse.plans import job
from carepulse.plans.job import audit_history, read_gold, run_arrivals, run_job
from carepulse.sources.snapshots import ConcurrentCommit, Load, expire, load_snapshot, read_snapshot, snapshot_numbers
from carepulse.streaming.incremental import arrivals, load_available, newest_drop, read_ledger, read_loaded

from .conftest import bronze_df, bronze_row

LONG_MAX = 2**63 - 1


def bag(df):
    return sorted(map(str, df.collect()))


def tables(spark, root):
    return {t: bag(read_snapshot(spark, root, t, s)) for t, s in (("silver", silver_schema()), ("gold_provider", gold_provider_schema()), ("gold_state", gold_state_schema()))}


def rebuilt(spark, rows):
    silver = build_silver(bronze_df(spark, rows))
    return {"silver": bag(silver), "gold_provider": bag(build_gold_provider(silver)), "gold_state": bag(build_gold_state(silver))}


def mixed_rows(years, start=0, n=30):
    return [
        bronze_row(
            PRVDR_ID=f"{start + i % 7:03d}", YEAR=years[i % len(years)], STATE="MA" if i % 3 else "RI", TOT_SRVC_DAYS=str(start + i),
            TOT_MDCR_PYMT_AMT=f"{(start + i) * 7.0625:.4f}", BENE_AVG_RISK_SCRE="*" if i % 5 == 0 else f"{0.1 * i:.2f}", YEAR_TYPE=f"T{start + i}",
        )
        for i in range(n)
    ]


# ------------------------------------------------------------------- wide sums
def test_counts_beyond_a_long_are_the_largest_long(spark, tmp_dir):
    big = str(6 * 10**18)
    rows = [bronze_row(TOT_SRVC_DAYS=big), bronze_row(TOT_SRVC_DAYS=big, YEAR_TYPE="FY"), bronze_row(PRVDR_ID="2", TOT_SRVC_DAYS="-" + big, STATE="RI")]
    rows += [bronze_row(PRVDR_ID="2", TOT_SRVC_DAYS="-" + big, STATE="RI", YEAR_TYPE="FY"), bronze_row(PRVDR_ID="3", STATE="CT", TOT_SRVC_DAYS=None)]
    rows += [bronze_row(PRVDR_ID="4", STATE="NH", TOT_SRVC_DAYS=x) for x in (big, "-" + big, "17")]
    gold_provider, gold_state = read_gold(spark, run_job(spark, bronze_df(spark, rows), tmp_dir))
    want = {"MA": LONG_MAX, "RI": -(2**63), "CT": None, "NH": 17}
    assert {r.provider_state: r.total_service_days for r in gold_state.collect()} == want
    assert {r.provider_state: r.total_service_days for r in gold_provider.collect()} == want
    kpi = serve.national_kpis(gold_state).first()
    assert kpi.total_service_days == LONG_MAX - 2**63 + 17
    two = spark.createDataFrame([(2023, "SNF", 1.0, x, 1) for x in (LONG_MAX, LONG_MAX)], "YEAR long, service_category string, total_medicare_payment_amt double, total_service_days long, total_distinct_benes long")
    assert serve.kpis(two, ["YEAR"]).first().total_service_days == LONG_MAX


def test_units_of_averages_in_two_limbs(spark):
    silver = build_silver(bronze_df(spark, [bronze_row(BENE_AVG_AGE=a) for a in ("-0.49999999", "0.49999999", "70.00000001", "-3.5")]))
    assert build_gold_state(silver).count() == 1
    assert build_gold_provider(silver).first().avg_bene_age == 66.50000001 / 4


# ------------------------------------------------------------ mergeable state
def test_states_of_any_split_merge_to_the_whole(spark):
    rows = mixed_rows(["2021", "2022", "bad"], n=90) + [bronze_row(TOT_SRVC_DAYS=str(6 * 10**18), YEAR_TYPE=f"x{i}") for i in range(3)]
    silver = build_silver(bronze_df(spark, rows))
    parts = None
    for i in range(3):
        one = gold_state_parts(build_silver(bronze_df(spark, rows[i::3])))
        parts = one if parts is None else parts.unionByName(one)
    merged = merge_gold_states(parts)
    assert bag(finish_gold_provider(merged)) == bag(build_gold_provider(silver))
    assert bag(finish_gold_state(merged)) == bag(build_gold_state(silver))
    assert finish_gold_state(merged).schema.simpleString() == build_gold_state(silver).schema.simpleString()


def test_added_records_merge_without_reading_earlier_silver(spark, tmp_dir):
    first, second = mixed_rows(["2021", "2022", "x"]), mixed_rows(["2022", "2023", "x"], start=100)
    run_job(spark, bronze_df(spark, first), tmp_dir, load="one")
    old = load_snapshot(spark, tmp_dir)
    for folder in old.folders("silver"):  # earlier silver is not needed any more
        for f in os.listdir(os.path.join(tmp_dir, folder)):
            if f.endswith(".parquet"):
                os.rename(os.path.join(tmp_dir, folder, f), os.path.join(tmp_dir, folder, f"_{f}"))
    run_job(spark, bronze_df(spark, second), tmp_dir, load="two", add=True)
    for folder in old.folders("silver"):
        for f in os.listdir(os.path.join(tmp_dir, folder)):
            if f.startswith("_part"):
                os.rename(os.path.join(tmp_dir, folder, f), os.path.join(tmp_dir, folder, f[1:]))
    assert tables(spark, tmp_dir) == rebuilt(spark, first + second)
    new = load_snapshot(spark, tmp_dir)
    assert new.tables["gold_provider"]["2021-01-01"] == old.tables["gold_provider"]["2021-01-01"]
    assert new.tables["gold_provider"]["2022-01-01"] != old.tables["gold_provider"]["2022-01-01"]


# ------------------------------------------------------------------ snapshots
@pytest.mark.parametrize("fails", ["gold_state_parts", "finish_gold_provider", "finish_gold_state", "audit_of_metrics"])
def test_a_run_that_fails_between_writes_changes_nothing(spark, tmp_dir, monkeypatch, fails):
    run_job(spark, bronze_df(spark, mixed_rows(["2021"])), tmp_dir, load="one")
    before, audit = tables(spark, tmp_dir), bag(audit_history(spark, tmp_dir))

    def broken(*args, **kwargs):
        raise RuntimeError("lost")

    again = bronze_df(spark, mixed_rows(["2021", "2022"], start=50))
    with monkeypatch.context() as m:
        m.setattr(job, fails, broken)
        with pytest.raises(RuntimeError, match="lost"):
            run_job(spark, again, tmp_dir, load="two", dynamic_overwrite=True)
    assert tables(spark, tmp_dir) == before and bag(audit_history(spark, tmp_dir)) == audit
    run_job(spark, again, tmp_dir, load="two", dynamic_overwrite=True)
    assert tables(spark, tmp_dir) == rebuilt(spark, mixed_rows(["2021", "2022"], start=50))
    gone = expire(spark, tmp_dir, keep=1)
    assert gone and snapshot_numbers(spark, tmp_dir) == [2]
    assert tables(spark, tmp_dir) == rebuilt(spark, mixed_rows(["2021", "2022"], start=50))
    assert expire(spark, tmp_dir, keep=1) == []


def test_an_unfinished_snapshot_file_is_not_read(spark, tmp_dir):
    run_job(spark, bronze_df(spark, mixed_rows(["2021"])), tmp_dir, load="one")
    before = tables(spark, tmp_dir)
    with open(os.path.join(tmp_dir, "_snapshots", "000002.json"), "w") as f:
        f.write('{"load": "two", "tab')
    assert tables(spark, tmp_dir) == before


def test_of_two_loads_at_once_the_later_commit_fails(spark, tmp_dir):
    run_job(spark, bronze_df(spark, mixed_rows(["2021"])), tmp_dir, load="one")
    a, b = Load(spark, tmp_dir, "a", "years"), Load(spark, tmp_dir, "b", "years")
    a.write("silver", build_silver(bronze_df(spark, mixed_rows(["2022"]))))
    b.write("silver", build_silver(bronze_df(spark, mixed_rows(["2023"]))))
    a.commit()
    with pytest.raises(ConcurrentCommit):
        b.commit()
    assert {r.YEAR for r in read_snapshot(spark, tmp_dir, "silver", silver_schema()).collect()} == {2021, 2022}


def test_equal_undated_rows_of_two_loads_stay_two_and_a_rerun_replaces_its_own(spark, tmp_dir):
    rows = bronze_df(spark, [bronze_row(YEAR="n/a", TOT_SRVC_DAYS="3")])
    run_job(spark, rows, tmp_dir, load="one")
    for _ in range(2):
        run_job(spark, rows, tmp_dir, load="two", dynamic_overwrite=True)
        _, gold_state = read_gold(spark, {t: f"{tmp_dir}/{t}" for t in ("gold_provider", "gold_state")})
        assert [r.total_service_days for r in gold_state.collect()] == [6]
        assert read_snapshot(spark, tmp_dir, "silver", silver_schema()).count() == 2


def test_audits_of_all_loads_stay(spark, tmp_dir):
    one, two = bronze_df(spark, [bronze_row(TOT_CHRG_AMT="x")]), bronze_df(spark, [bronze_row(YEAR="2022", BENE_DUAL_PCT="*")])
    run_job(spark, one, tmp_dir, load="one")
    for _ in range(2):
        run_job(spark, two, tmp_dir, load="two", dynamic_overwrite=True)
    history = audit_history(spark, tmp_dir)
    for name, bronze in (("one", one), ("two", two)):
        assert bag(history.where(F.col("load_name") == name).drop("load_name")) == bag(suppression_audit(bronze))


def test_the_audit_is_taken_in_the_writing_stage(spark, tmp_dir):
    """Behind the exchange, so tasks that run again are not counted again; and from one read of bronze."""
    from carepulse.operators.silver import CELLS, audit_metrics, build_silver_with_cells
    from pyspark.sql import Observation

    plan = build_silver_with_cells(bronze_df(spark, [bronze_row()])).hint("rebalance", "YEAR_DATE").observe(Observation(), *audit_metrics()).drop(CELLS)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.index("CollectMetrics") < text.index("Exchange")
    rows = [bronze_row(TOT_CHRG_AMT=c, BENE_DUAL_PCT=p) for c, p in ((None, "*"), ("", "12"), ("*", "x"), ("5", None), ("NaN", "1e400"))]
    paths = run_job(spark, bronze_df(spark, rows), tmp_dir)
    assert bag(spark.read.parquet(paths["audit"])) == bag(suppression_audit(bronze_df(spark, rows)))


def test_a_load_without_rows(spark, tmp_dir):
    paths = run_job(spark, bronze_df(spark, []), tmp_dir, load="none")
    assert tables(spark, tmp_dir) == {"silver": [], "gold_provider": [], "gold_state": []}
    assert {r.n_rows for r in spark.read.parquet(paths["audit"]).collect()} == {0}


# ------------------------------------------------------- arrivals by the ledger
def drop(landing, name, rows):
    os.makedirs(os.path.join(landing, name))
    with open(os.path.join(landing, name, "part.json"), "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)


@pytest.fixture()
def arriving(spark, tmp_dir):
    """arrive(name, rows) lands a drop, loads it and carries it on; returns the service days by year."""
    landing, table, ckpt, out = (os.path.join(tmp_dir, d) for d in ("landing", "bronze", "ckpt", "out"))

    def arrive(*drops):
        for name, rows in drops:
            drop(landing, name, rows)
        load_available(spark, landing, table, ckpt)
        arrive.paths = run_arrivals(spark, table, out)
        return {r.YEAR: r.total_service_days for r in read_snapshot(spark, out, "gold_state", gold_state_schema()).collect()}

    arrive.table, arrive.out = table, out
    return arrive


def test_the_later_arrival_counts_whatever_its_name(spark, arriving):
    assert arriving(("drop-9", [bronze_row(TOT_SRVC_DAYS="5"), bronze_row(YEAR="n/a", TOT_SRVC_DAYS="5")])) == {2023: 5, None: 5}
    # An undated record sent again counts once; a name that sorts first is still newer.
    assert arriving(("drop-10", [bronze_row(TOT_SRVC_DAYS="7"), bronze_row(YEAR="n/a", TOT_SRVC_DAYS="7")])) == {2023: 7, None: 7}
    assert arriving(("a", [bronze_row(TOT_SRVC_DAYS="8")])) == {2023: 8, None: 7}
    assert run_arrivals(spark, arriving.table, arriving.out) is None
    by_name = newest_drop(read_loaded(spark, arriving.table)).where("YEAR = '2023'").collect()
    assert [r.TOT_SRVC_DAYS for r in by_name] == ["7"]  # "a", "drop-9", "drop-10"
    ledger = read_ledger(spark, arriving.table).orderBy("_sequence").collect()
    assert [(r["_drop"], r["n_rows"], r["years"], r["undated"]) for r in ledger] == [("drop-9", 2, [2023], True), ("drop-10", 2, [2023], True), ("a", 1, [2023], False)]


def test_drops_of_one_batch_are_ordered_by_time_then_by_natural_name(spark, tmp_dir):
    landing, table, ckpt = (os.path.join(tmp_dir, d) for d in ("landing", "bronze", "ckpt"))
    for name in ("drop-10", "drop-9", "early"):
        drop(landing, name, [bronze_row(TOT_SRVC_DAYS=name)])
        os.utime(os.path.join(landing, name, "part.json"), (1_600_000_000 if name == "early" else 1_700_000_000,) * 2)
    load_available(spark, landing, table, ckpt)
    assert [r["_drop"] for r in read_ledger(spark, table).orderBy("_sequence").collect()] == ["early", "drop-9", "drop-10"]
    assert [r.TOT_SRVC_DAYS for r in newest_drop(read_loaded(spark, table), by="arrival").collect()] == ["drop-10"]


def test_arrivals_touch_their_years_only(spark, arriving):
    arriving(("one", mixed_rows(["2020", "2021", "2022"])))
    first = load_snapshot(spark, arriving.out)
    # New records of 2022 and 2023 are added: no earlier folder of any year is replaced.
    arriving(("two", mixed_rows(["2022", "2023"], start=200)))
    second = load_snapshot(spark, arriving.out)
    assert set(first.folders("silver")) < set(second.folders("silver"))
    # A record sent again: just its year is resolved anew.
    again = mixed_rows(["2021"], n=1) + mixed_rows(["2021"], start=300)
    again[0] = dict(mixed_rows(["2020", "2021", "2022"])[1], TOT_SRVC_DAYS="4000")
    news = arrivals(spark, arriving.table, second.last_batch)
    assert (news.last_batch, news.years) == (None, [])
    arriving(("three", again))
    third = load_snapshot(spark, arriving.out)
    for year in ("2020-01-01", "2022-01-01", "2023-01-01"):
        assert all(third.tables[t][year] == second.tables[t][year] for t in ("silver", "gold_provider", "gold_state"))
    assert third.tables["silver"]["2021-01-01"] != second.tables["silver"]["2021-01-01"]
    rows = [r for r in mixed_rows(["2020", "2021", "2022"]) if r["YEAR_TYPE"] != "T1"] + mixed_rows(["2022", "2023"], start=200) + again
    assert tables(spark, arriving.out) == rebuilt(spark, rows)


def test_a_batch_run_again_is_not_doubled_and_one_without_entry_not_seen(spark, tmp_dir):
    from carepulse.streaming.incremental import _batch_writer, landing_stream

    landing, table, ckpt = (os.path.join(tmp_dir, d) for d in ("landing", "bronze", "ckpt"))
    drop(landing, "d1", [bronze_row()])
    load_available(spark, landing, table, ckpt)
    static = spark.read.schema(landing_stream(spark, landing).schema).parquet(f"{table}/rows/_batch=0")
    again = static.checkpoint()
    _batch_writer(table, lambda n: None)(again, 0)
    assert read_loaded(spark, table).count() == read_ledger(spark, table).count() == 1
    again.withColumn("_year", F.lit(2023)).write.partitionBy("_drop", "_year").parquet(f"{table}/rows/_batch=7")
    assert read_loaded(spark, table).count() == 1


def test_plan_of_touched_years_prunes_bronze_and_has_no_window(spark, arriving):
    arriving(("one", mixed_rows(["2020", "2021"])))
    plan = newest_drop(read_loaded(spark, arriving.table), years=[2021], by="arrival", undated=True)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "_year" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "Window" not in plan
