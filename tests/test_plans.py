"""Plan shape: pushdown, pruning, partial aggregation, no Python in the hot path."""

import contextlib
import io

import pytest

from carepulse.plans import catalog

from .conftest import SMOKE_DIR


def _formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_python_udfs(spark, name):
    plan = _formatted(catalog.QUERIES[name](spark, SMOKE_DIR))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert node not in plan, (name, node)


def test_slice_read_prunes_partitions_and_pushes_filters(spark):
    plan = _formatted(catalog.QUERIES["provider_read_one_state"](spark, SMOKE_DIR))
    assert "PartitionFilters: [isnotnull(YEAR_DATE" in plan and "(YEAR_DATE" in plan
    assert "EqualTo(provider_state,NATION_19)" in plan
    assert "EqualTo(service_category,SNF)" in plan


def test_gold_reads_only_needed_columns(spark):
    plan = _formatted(catalog.QUERIES["state_summary_read"](spark, SMOKE_DIR))
    read_schemas = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert read_schemas and all("total_charge_amt" in s for s in read_schemas)
    plan = _formatted(catalog.QUERIES["national_kpis"](spark, SMOKE_DIR))
    read_schemas = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert read_schemas and all("avg_rural_pct" not in s for s in read_schemas)


def test_gold_aggregation_is_partial_then_final(spark):
    plan = _formatted(catalog.QUERIES["gold_state_summary"](spark, SMOKE_DIR))
    assert plan.count("HashAggregate") >= 2
    assert "partial_sum" in plan


def test_top_n_limits_before_shuffle(spark):
    plan = _formatted(catalog.QUERIES["top_providers_every_state"](spark, SMOKE_DIR))
    tree = plan.split("\n\n")[0]
    # Partial limit below the exchange (the tree prints parents first), final above it.
    lines = [line.strip(" +-:") for line in tree.splitlines()]
    order = [line.split(" (")[0] for line in lines if line]
    assert order.index("Exchange") < max(i for i, n in enumerate(order) if n == "WindowGroupLimit")
    assert ", 10, Partial" in plan and ", 10, Final" in plan


def test_gold_build_prunes_silver_and_pushes_provider_filter(spark):
    plan = _formatted(catalog.QUERIES["gold_state_summary"](spark, SMOKE_DIR))
    assert "EqualTo(summary_category,PROVIDER)" in plan
    read = [line for line in plan.splitlines() if line.startswith("ReadSchema")]
    assert len(read) == 1
    assert "bene_female_pct" not in read[0] and "provider_city" not in read[0]
    assert "total_charge_amt" in read[0]


# Spark has no generated code for from_json, which reads the drifting landing lines.
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - {"landing_drift"}))
def test_hot_operators_are_whole_stage_codegen(spark, name):
    # The static plan (AQE off) shows codegen stage ids; a node without one runs
    # row by row through the interpreter (e.g. an aggregate over 100 fields).
    df = catalog.QUERIES[name](spark, SMOKE_DIR)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _formatted(df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    heads = [line for line in plan.splitlines() if line.startswith("(")]
    hot = [h for h in heads if h.split(" ")[1] in ("HashAggregate", "Project", "Filter", "BroadcastHashJoin")]
    assert all("[codegen id" in h for h in hot), (name, [h for h in hot if "[codegen id" not in h])


def test_registered_audit_parses_no_cell_twice(spark):
    # Valid counts come from silver's columns; bronze is only tested for NULL and '*'.
    plan = _formatted(catalog.QUERIES["silver_suppression_audit"](spark, SMOKE_DIR)).lower()
    assert " as double)" not in plan and "decimal(38,6)" not in plan
    assert "count(" in plan and "total_medicare_payment_amt" in plan


def test_order_lines_are_shuffled_twice_at_any_size(spark):
    """For the join and by group; the distinct customers are counted without a shuffle of their own."""
    from carepulse.sources.fixtures import provider_rows

    plan = provider_rows(spark, SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert not [x for x in exchanges if "o_custkey" in x.split("hashpartitioning(")[1].split("), ")[0]]
    assert len([x for x in exchanges if "l_returnflag" in x or "rf#" in x]) == 1


def test_wide_projections_stay_small_enough_for_the_jit(spark):
    """Methods over 8000 bytes of bytecode are never compiled by the JIT."""
    from carepulse.contracts import bronze_schema
    from carepulse.operators.silver import build_silver_with_cells
    from carepulse.sources.fixtures import provider_rows

    codegen = spark._jvm.org.apache.spark.sql.execution.debug.package
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan has no generated code before it runs
    try:
        bronze = spark.createDataFrame([], bronze_schema()).repartition(2)
        for df in (build_silver_with_cells(bronze), provider_rows(spark, SMOKE_DIR)):
            stages = codegen.codegenStringSeq(df._jdf.queryExecution().executedPlan())
            sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.length())]
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_landed_drops_are_compressed_part_files(spark):
    import pathlib

    landing = pathlib.Path(catalog.arrived(spark, SMOKE_DIR)["bronze"].removeprefix("file:")).parent / "landing"
    for drop in landing.iterdir():
        files = [f.name for f in drop.iterdir() if f.name.startswith("part-")]
        assert files and all(f.endswith(".json.gz") for f in files)
