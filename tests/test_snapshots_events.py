from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from conftest import make_bars
from pyspark.sql import functions as F

from tidemark.functions.scalars import stable_id
from tidemark.operators import events, registry, snapshots
from tidemark.schemas import ANNOUNCEMENTS, HOLDINGS, REGISTRY, conform
from tidemark.sources import holdings_files, tables

D1, D2, D3 = dt.date(2024, 1, 1), dt.date(2024, 2, 1), dt.date(2024, 3, 1)


def holdings(spark, rows):
    """(product, date, ticker, name, weight, shares)"""
    return spark.createDataFrame(
        [(p, d, t, n, None, w, s, None, "manual") for p, d, t, n, w, s in rows], HOLDINGS
    )


def changes(df):
    return {(r["as_of_date"], r["constituent_ticker"] or r["constituent_name"]): r for r in df.collect()}


def test_all_change_types(spark):
    h = holdings(
        spark,
        [
            ("ETF", D1, "PDN", "Paladin", 0.10, 100.0), ("ETF", D1, "BOE", "Boss", 0.05, 50.0),
            ("ETF", D1, "SAME", "Same", 0.02, 10.0), ("ETF", D1, "TRIM", "Trim", 0.04, 90.0),
            ("ETF", D2, "PDN", "Paladin", 0.15, 150.0), ("ETF", D2, "DYL", "Deep", 0.03, 30.0),
            ("ETF", D2, "SAME", "Same", 0.02, 10.0), ("ETF", D2, "TRIM", "Trim", 0.04, 80.0),
        ],
    )
    got = {t: r["change_type"] for (_, t), r in changes(snapshots.diff_history(h, include_unchanged=True)).items()}
    assert got == {
        "PDN": "WEIGHT_INCREASE", "DYL": "NEW_POSITION", "BOE": "DELETED", "SAME": "UNCHANGED", "TRIM": "WEIGHT_DECREASE",
    }
    rows = changes(snapshots.diff_history(h))
    assert (D2, "SAME") not in rows
    assert rows[(D2, "PDN")]["shares_delta"] == 50.0
    assert rows[(D2, "DYL")]["weight_delta"] == pytest.approx(0.03)
    assert rows[(D2, "BOE")]["shares_delta"] == -50.0 and rows[(D2, "BOE")]["new_weight"] is None


def test_first_snapshot_is_silent_and_gaps_reopen(spark):
    h = holdings(
        spark,
        [("E", D1, "A", "a", 0.5, 1.0), ("E", D2, "B", "b", 0.5, 1.0), ("E", D3, "A", "a", 0.5, 2.0), ("E", D3, "B", "b", 0.5, 1.0)],
    )
    got = {k: r["change_type"] for k, r in changes(snapshots.diff_history(h)).items()}
    assert got == {(D2, "A"): "DELETED", (D2, "B"): "NEW_POSITION", (D3, "A"): "NEW_POSITION"}
    last = {k: r["change_type"] for k, r in changes(snapshots.diff_history(h, latest_only=True)).items()}
    assert last == {(D3, "A"): "NEW_POSITION"}


def test_duplicate_lines_are_summed_and_names_stand_in(spark):
    h = holdings(
        spark,
        [
            ("E", D1, "A", "a", 0.1, 1.0), ("E", D1, "A", "a", 0.2, 2.0), ("E", D1, None, "Cash fund", None, None),
            ("E", D1, None, "cash Fund", None, None), ("E", D1, None, None, 0.1, 1.0),
        ],
    )
    got = {r["constituent_key"]: (r["weight_pct"], r["shares"]) for r in snapshots.collapse_constituents(h).collect()}
    assert got["A"] == (pytest.approx(0.3), 3.0)
    assert got["CASH FUND"] == (None, None)
    assert set(got) == {"A", "CASH FUND"}
    compat = {r["constituent_key"]: r["shares"] for r in snapshots.collapse_constituents(h, compat=True).collect()}
    assert compat["CASH FUND"] == 0.0


def test_products_with_history(spark):
    h = holdings(spark, [("E", D1, "A", "a", 1.0, 1.0), ("E", D2, "A", "a", 1.0, 1.0), ("F", D1, "A", "a", 1.0, 1.0)])
    assert [r["product_ticker"] for r in snapshots.products_with_history(h).collect()] == ["E"]


def test_net_accumulation(spark):
    h = holdings(
        spark,
        [
            ("E", D1, "PDN.AX", "p", 0.1, 100.0), ("E", D2, "PDN.AX", "p", 0.2, 400.0), ("F", D1, "PDN AU", "p", 0.1, 50.0),
            ("F", D2, "PDN AU", "p", 0.1, 20.0), ("F", D1, "RIO LN", "r", 0.1, 5.0), ("F", D2, "RIO LN", "r", 0.1, 50.0),
        ],
    )
    row = snapshots.net_accumulation(h, make_bars(spark, [1.0] * 10, volume=90.0)).collect()
    assert len(row) == 1
    assert row[0]["net_shares"] == 270.0 and row[0]["n_etfs_trading"] == 2 and row[0]["etfs"] == ["E", "F"]
    assert row[0]["buy_days_of_volume"] == pytest.approx(3.0)


def _registry(spark, rows):
    return conform(spark.createDataFrame(rows, "product_ticker string, product_name string, aum double"), REGISTRY)


def test_new_position_becomes_one_event(spark):
    h = holdings(
        spark, [("E", D1, "BHP.AX", "BHP", 1.0, 5.0), ("E", D2, "BHP.AX", "BHP", 1.0, 5.0), ("E", D2, "PDN.AX", "Paladin", 0.02, 7.0)]
    )
    e = events.events_from_holdings(h, _registry(spark, [("e", "Fund E", 1e6)])).collect()
    assert [(r["asx_ticker"], r["event_type"], r["etf_index_name"]) for r in e] == [
        ("PDN.AX", "ETF_HOLDINGS_NEW_POSITION", "Fund E")
    ]
    assert e[0]["aum"] == 1e6 and e[0]["effective_date"] is None and e[0]["announcement_date"] == D2
    text = f"holdings|E|PDN.AX|ETF_HOLDINGS_NEW_POSITION|{D2}"
    assert e[0]["event_id"] == hashlib.sha1(text.encode()).hexdigest()[:12]


def _announcements(spark, rows):
    return spark.createDataFrame(rows, ANNOUNCEMENTS)


ANN = ("S&P", "Big 200", "DRO.AX", "Drone", "ADD", D1, D2, "http://x", 0.95, False)


def test_announcement_event_and_stable_ids(spark):
    a = _announcements(spark, [ANN, ("S&P", "Big 200", "XYZ.AX", "X", "REMOVAL", D1, D2, None, 0.9, True)])
    rows = {r["asx_ticker"]: r for r in events.events_from_announcements(a).collect()}
    assert rows["DRO.AX"]["event_type"] == "OFFICIAL_INDEX_ADD"
    assert rows["XYZ.AX"]["event_type"] == "OFFICIAL_INDEX_DELETE" and rows["XYZ.AX"]["notes"] == "needs_verification"
    again = {r["asx_ticker"]: r["event_id"] for r in events.events_from_announcements(a.repartition(3)).collect()}
    assert again == {k: r["event_id"] for k, r in rows.items()} and len(set(again.values())) == 2


def test_union_keeps_one_row_per_id_from_the_first_source(spark):
    first = events.events_from_announcements(_announcements(spark, [ANN, ANN, ANN]))
    custom = first.withColumn("company_name", F.lit("other"))
    out = events.union_events([first, custom]).collect()
    assert [r["company_name"] for r in out] == ["Drone"]


def test_custom_events_get_id_and_type(spark):
    raw = spark.createDataFrame(
        [("", "LYC.AX", None, D1), ("given", "PDN.AX", "REBALANCE", D1)],
        "event_id string, asx_ticker string, event_type string, announcement_date date",
    )
    rows = {r["asx_ticker"]: r for r in events.events_from_custom(raw).collect()}
    assert rows["PDN.AX"]["event_id"] == "given" and rows["PDN.AX"]["source_type"] == "custom_manual"
    assert rows["LYC.AX"]["event_type"] == "CUSTOM_MANUAL_EVENT" and len(rows["LYC.AX"]["event_id"]) == 12


def test_overrides_patch_cells_and_later_rows_win(spark):
    e = events.events_from_announcements(_announcements(spark, [ANN]))
    eid = e.first()["event_id"]
    o = spark.createDataFrame(
        [(eid, D3, 0.1, None, 1), (eid, None, 0.2, "seen", 2), ("other", D1, 0.3, None, 3)],
        "event_id string, effective_date date, confidence_score double, notes string, line int",
    )
    row = events.apply_overrides(e, o, "line").collect()
    assert len(row) == 1
    assert (row[0]["effective_date"], row[0]["confidence_score"], row[0]["notes"]) == (D3, 0.2, "seen")


def test_stable_id_joins_null_as_empty(spark):
    got = spark.range(1).select(stable_id(F.lit("a"), F.lit(None).cast("string"), F.lit(3))).first()[0]
    assert got == hashlib.sha1(b"a||3").hexdigest()[:12]


# ------------------------------------------------------------------ registry
def test_seed_schema_and_scores(spark):
    seeds = registry.seed_registry(spark)
    assert seeds.columns == REGISTRY.fieldNames()
    built = registry.build_registry([seeds])
    assert built.count() == 43
    low, high = built.agg(F.min("confidence_score"), F.max("confidence_score")).first()
    assert 0 <= low <= high <= 1


def test_richer_rows_score_higher_and_manual_wins(spark):
    rich = conform(
        spark.createDataFrame(
            [("urnm", "Uranium Miners", "Sprott", "http://m", 1e9, "manual", "etf")],
            "product_ticker string, product_name string, issuer string, holdings_url string, aum double, source string, record_type string",
        ),
        REGISTRY,
    )
    built = {r["product_ticker"]: r for r in registry.build_registry([rich, registry.seed_registry(spark)]).collect()}
    assert built["URNM"]["source"] == "manual" and built["URNM"]["confidence_score"] == pytest.approx(0.55)
    assert built["URNM"]["confidence_score"] > built["URA"]["confidence_score"]
    assert len(built) == 43


def test_discovery_takes_the_first_theme(spark):
    funds = spark.createDataFrame(
        [("AAA", "Global Uranium and Gold Mining", 1.0), ("BBB", "Plain", None), ("", "none", None)],
        "etf string, etf_name string, aum double",
    )
    got = {r["product_ticker"]: r["theme"] for r in registry.discover_funds(funds).collect()}
    assert got == {"AAA": "uranium", "BBB": None}


def test_acquisition(spark):
    h = holdings(spark, [("A", D1, "X", "x", 1.0, 1.0), ("B", D1, "X", "x", 1.0, 1.0)])
    vendor = holdings(spark, [("A", D1, "Y", "y", 1.0, 1.0)]).withColumn("source", F.lit("fmp"))
    got = {(r["product_ticker"], r["constituent_ticker"]) for r in tables.acquire([h, vendor]).collect()}
    assert got == {("A", "Y"), ("B", "X")}
    reg = spark.createDataFrame([("etf", "A"), ("etf", "B"), ("etf", "TODO:x"), ("index", "C")], "record_type string, product_ticker string")
    gaps = tables.acquisition_gaps(reg, h.unionByName(vendor)).collect()
    assert [r["product_ticker"] for r in gaps] == ["B"]


def test_alias_frame_is_normalised(spark):
    raw = spark.createDataFrame(
        [("pdn ", "Paladin", "12.5%", "1000", "1,234.5"), ("BOE", " Boss", "8.0", None, None), (None, None, "79.5", "1", "1")],
        ["Ticker", "Name", "Weight (%)", "Shares", "Market Value"],
    )
    rows = {r["constituent_ticker"]: r for r in holdings_files.normalise_holdings(raw, "urnm", "2024-01-01", "manual").collect()}
    assert rows["PDN"]["weight_pct"] == pytest.approx(0.125) and rows["BOE"]["weight_pct"] == pytest.approx(0.08)
    assert rows["PDN"]["product_ticker"] == "URNM" and rows["PDN"]["market_value"] == 1234.5
    assert len(rows) == 2
