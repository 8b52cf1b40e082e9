from __future__ import annotations

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import queries as registered
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
# A few of every family; the whole list is compared by tools/check.py.
COMPARED = [
    "ohlcv_bars", "spread_vol_momentum", "asof_forward_strict", "asof_slotted", "snapshot_diff", "build_events",
    "override_patch", "flow_pressure", "event_study", "features", "trades_all", "backtest_ledger", "metrics_by_strategy",
    "bootstrap_ci", "claims_gate", "caar_path", "membership_backtest", "forced_flow_score", "review_calendar",
    "next_effective", "registry_priority", "announcement_candidates", "rule_extraction", "stream_daily_bars",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("blocked", ["tidemark.llm", "corpus_pipeline", "zstandard"])
def test_without_the_text_part_the_rest_still_imports(blocked):
    code = (
        f"import sys; sys.modules[{blocked!r}] = None; import __spark_entry__ as e;"
        "assert not [q for q in e.queries() if q == 'pipeline' or q.startswith('op1')], 'text queries';"
        "assert 'event_study' in e.queries() and 'event_study' in e.oracle_sql()"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__))


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(df.columns)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows_of(columns, res.fetchall())


@pytest.mark.parametrize(
    "name", ["event_study", "backtest_ledger", "forced_flow_score", "caar_path", "metrics_by_strategy", "announcement_candidates"]
)
def test_plans_stay_in_the_jvm_and_never_pair_everything(spark, name):
    df = registered.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


def test_narrow_query_reads_narrow_columns(spark):
    df = registered.queries()["next_quarterly"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderdate:timestamp_ntz>" in plan
