"""The dashboard's questions for one selection, from the gold tables the job wrote.

    python -m carepulse.plans.report --tables ROOT --year 2023 [--category SNF] [--state XX]

Prints the state page (national KPIs, states by payment per beneficiary) and,
with ``--state``, the provider page (state KPIs, top providers, episodes per
beneficiary by risk band). Every answer is a Spark plan over the gold tables with
the selection pushed into the scan; only the small final results are collected.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from ..contracts import TOP_N
from ..operators import serve
from ..sources.sinks import is_empty
from .job import read_gold


def state_page(gold_state: DataFrame, year: int, category: str) -> dict[str, DataFrame]:
    """National KPIs and the state ranking for one (year, category)."""
    states = serve.load_state_summary(gold_state, year, category)
    return {
        "national_kpis": serve.kpis(states, ["YEAR", "service_category"]),
        "states_by_pay_per_bene": serve.states_ranked(states).orderBy("pay_rank"),
        "state_list": serve.state_list(states),
    }


def provider_page(gold_provider: DataFrame, year: int, category: str, state: str) -> dict[str, DataFrame]:
    """State KPIs, top providers and the risk-band box summary for one state."""
    rows = serve.load_provider_metrics(gold_provider, year, state, category)
    filled = serve.zero_fill(rows)
    return {
        "state_kpis": serve.kpis(filled, ["YEAR", "service_category", "provider_state"]),
        "top_providers": serve.top_providers_of_slice(rows, TOP_N).orderBy("pay_rank"),
        "providers": filled.orderBy(*serve.top_order()),
        "top_providers_zero_filled": serve.top_providers_of_slice(filled, TOP_N).orderBy("pay_rank"),
        "episodes_by_risk_band": serve.episodes_box_by_risk(rows).orderBy("risk_band"),
    }


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--tables", required=True, help="output root of carepulse.plans.job")
    ap.add_argument("--year", type=int, required=True)
    ap.add_argument("--category", default="SNF")
    ap.add_argument("--state")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName("carepulse-report").getOrCreate()
    root = args.tables.rstrip("/")
    gold_provider, gold_state = read_gold(
        spark, {k: f"{root}/{k}" for k in ("silver", "gold_provider", "gold_state")}
    )
    pages = state_page(gold_state, args.year, args.category)
    if is_empty(pages["states_by_pay_per_bene"]):
        print("No data for this selection.")
        return
    if args.state:
        pages.update(provider_page(gold_provider, args.year, args.category, args.state))
    for title, df in pages.items():
        print(f"== {title}")
        df.show(n=df.count(), truncate=False)
    if not args.state:
        print("Add --state with one of the listed states for the provider page.")


if __name__ == "__main__":
    main()
