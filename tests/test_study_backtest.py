from __future__ import annotations

import pytest
from conftest import RAMP, business_days, event_row, make_bars, make_events
from pyspark.sql import functions as F

from tidemark.functions.costs import CostModel
from tidemark.operators import backtest, features, flow, strategies

DAYS = business_days("2023-01-02", 60)


def _study(spark, **over):
    bars = make_bars(spark, RAMP, opens={31: 1.005})
    e = make_events(
        spark, [event_row(announcement_date=DAYS[30], detected_date=DAYS[30], effective_date=DAYS[40], **over)]
    )
    return flow.enrich_events(e, bars)


def test_underreaction_scenario(spark):
    row = _study(spark).first()
    assert row["immediate_reaction"] == pytest.approx(0.005)
    assert row["delayed_return"] > 0.08
    assert row["underreaction_score"] > 5
    assert row["tradeable_flag"] is True
    assert row["es_next_open_to_effective"] is not None and row["es_eff_close_plus10"] is not None
    assert row["entry_date"] == DAYS[31] and row["eff_is_reached"] is True


def test_score_needs_a_flow(spark):
    assert _study(spark).first()["delayed_flow_opportunity_score"] is None
    row = _study(spark, shares_delta=2_000_000.0).first()
    assert row["estimated_buy_sell_dollars"] == pytest.approx(2_000_000.0)
    assert row["flow_pressure"] == pytest.approx(2.0)
    assert row["delayed_flow_opportunity_score"] > 0


def test_score_formula(spark):
    df = spark.createDataFrame(
        [(2.0, 0.6, 1.0, 0.8, 1.0, 0.005), (None, 0.6, 1.0, 0.8, 1.0, 0.005), (2.0, None, None, 0.8, None, 0.04)],
        "flow_pressure double, prob_real double, prob_not_complete double, liquidity_tightness double, "
        "expected_remaining_flow double, immediate_reaction double",
    )
    got = [r[0] for r in df.select(flow.opportunity_score()).collect()]
    assert got[0] == pytest.approx(0.96)
    assert got[1] is None
    assert got[2] == pytest.approx(2.0 * 0.5 * 0.8 / 4.0)


def test_sells_are_negative_and_weights_are_the_fallback(spark):
    bars = make_bars(spark, RAMP)
    when = {"announcement_date": DAYS[30], "detected_date": DAYS[30]}
    e = make_events(
        spark,
        [
            event_row(event_id="a", event_type="ETF_HOLDINGS_WEIGHT_DECREASE", shares_delta=-500.0, **when),
            event_row(event_id="b", weight_delta=0.01, aum=1000.0, **when),
            event_row(event_id="c", **when),
            event_row(event_id="d", asx_ticker="ZZZ.AX", shares_delta=5.0, weight_delta=0.01, aum=1000.0, **when),
        ],
    )
    got = {r["event_id"]: r for r in flow.estimate_flows(flow.attach_bars(e, bars)).collect()}
    assert got["a"]["estimated_buy_sell_dollars"] == pytest.approx(-500.0)
    assert got["b"]["estimated_buy_sell_dollars"] == pytest.approx(10.0)
    assert got["c"]["estimated_buy_sell_dollars"] is None and got["c"]["flow_estimable"] is False
    assert got["d"]["estimated_buy_sell_dollars"] == pytest.approx(10.0) and got["d"]["flow_pressure"] is None


def test_remaining_flow_decays_over_a_week(spark):
    bars = make_bars(spark, RAMP)
    e = make_events(spark, [event_row(announcement_date=DAYS[30], detected_date=DAYS[30], shares_delta=1.0)])
    attached = flow.attach_bars(e, bars)
    for days, expected in ((0, 1.0), (3, 1 - 3 / 7), (7, 0.0), (30, 0.0)):
        import datetime as dt

        as_of = str(DAYS[30] + dt.timedelta(days=days))
        row = flow.estimate_flows(attached, as_of).first()
        assert row["expected_remaining_flow"] == pytest.approx(expected)


def _trade(spark, event_id="EV1", symbol="PDN.AX", exit_spec="effective", hold=25, entry="next_open"):
    return spark.createDataFrame(
        [("S", event_id, symbol, 1, entry, exit_spec, hold, "S")],
        "strategy string, event_id string, asx_ticker string, direction int, entry_ref string, exit_spec string, "
        "max_hold_days int, selection_notes string",
    )


def _event(spark, **over):
    base = {"announcement_date": DAYS[30], "detected_date": DAYS[30], "effective_date": DAYS[40]}
    return make_events(spark, [event_row(**{**base, **over})])


def test_ledger_of_the_ramp(spark):
    row = backtest.backtest_trades(_trade(spark), _event(spark), make_bars(spark, RAMP)).first()
    assert row["rejected"] is False and row["reject_reason"] == ""
    assert row["gross_return"] > 0.09
    assert row["net_return"] < row["gross_return"] and row["harsh_net_return"] < row["net_return"]
    assert row["exposure_days"] == 9 and row["direction"] == 1


@pytest.mark.parametrize(
    ("over", "trade", "reason"),
    [
        ({}, {"event_id": "NOPE"}, "no_event_or_symbol"),
        ({"asx_ticker": "ZZZ.AX"}, {"symbol": "ZZZ.AX"}, "no_prices"),
        ({"announcement_date": DAYS[0].replace(year=2020)}, {}, "no_bar_at_announcement"),
        ({"announcement_date": DAYS[59]}, {}, "no_entry_bar"),
        ({"announcement_date": DAYS[55], "effective_date": DAYS[58]}, {"exit_spec": "eff_close_plus:5"}, "no_exit_bar"),
    ],
)
def test_rejections_are_kept_with_their_reason(spark, over, trade, reason):
    ledger = backtest.backtest_trades(_trade(spark, **trade), _event(spark, **over), make_bars(spark, RAMP))
    row = ledger.first()
    assert (row["rejected"], row["reject_reason"]) == (True, reason)
    assert row["net_return"] is None


def test_no_liquidity(spark):
    bars = make_bars(spark, RAMP, volume=0.0)
    assert backtest.backtest_trades(_trade(spark), _event(spark), bars).first()["reject_reason"] == "no_liquidity"


@pytest.mark.parametrize(
    ("spec", "effective", "hold", "days"),
    [
        ("effective", DAYS[40], 25, 9),
        ("eff_close_plus:3", DAYS[40], 25, 12),
        ("plus:5", DAYS[40], 25, 5),
        ("effective", None, 7, 7),
        ("effective", DAYS[20], 10, 10),
        ("effective", DAYS[20], 100, 28),
    ],
)
def test_exit_rules(spark, spec, effective, hold, days):
    trades = _trade(spark, exit_spec=spec, hold=hold)
    row = backtest.backtest_trades(trades, _event(spark, effective_date=effective), make_bars(spark, RAMP)).first()
    assert row["exposure_days"] == days


# Published rows: (daily value, gross) -> participation, round-trip bps, net, harsh net.
COST_ROWS = [
    (1267897.5742857142, 0.05911330049261099, 0.07887072428454802, 223.74144856509602, 0.03673915563610139, 0.01596501077959178),
    (4421173.282857142, 0.038596491228070295, 0.022618430358236474, 111.23686071647295, 0.027472805156423002, 0.017949119084775707),
]


@pytest.mark.parametrize("row", COST_ROWS)
def test_cost_model_against_published_rows(spark, row):
    adv, gross, part, bps, net, harsh_net = row
    costs = CostModel()
    got = spark.range(1).select(
        costs.breakdown(F.lit(100000.0), F.lit(adv)).alias("c"),
        costs.breakdown(F.lit(100000.0), F.lit(adv), True).alias("h"),
    ).first()
    assert got["c"]["participation"] == pytest.approx(part)
    assert got["c"]["round_trip_bps"] == pytest.approx(bps, abs=1e-6)
    assert gross - got["c"]["round_trip_bps"] / 1e4 == pytest.approx(net)
    assert gross - got["h"]["round_trip_bps"] / 1e4 == pytest.approx(harsh_net)


def test_costs_without_liquidity(spark):
    got = spark.range(1).select(CostModel().breakdown(F.lit(1e5), F.lit(None).cast("double")).alias("c")).first()["c"]
    assert got["round_trip_bps"] is None and got["capped"] is True and got["executable_value"] == 0.0


def test_strategies_read_unknown_as_pass_or_fail(spark):
    schema = (
        "event_id string, asx_ticker string, event_type string, source_type string, immediate_reaction double, "
        "flow_pressure double, confidence_score double, new_weight double, adv_dollars double, market_cap double, "
        "source_obscurity_score double, stack_count int, tradeable_flag boolean"
    )
    add = "OFFICIAL_INDEX_ADD"
    rows = [
        ("all_null", "A", add, "announcement", None, None, None, None, None, None, None, None, True),
        ("strong", "A", add, "holdings_diff", 0.01, 2.0, 0.9, 0.01, 5e5, 1e8, 0.8, 2, True),
        ("big_move", "A", add, "holdings_diff", -0.5, 2.0, 0.9, 0.01, 5e5, 1e8, 0.8, 1, True),
        ("untradeable", "A", add, "holdings_diff", 0.01, 2.0, 0.9, 0.01, 5e5, 1e8, 0.8, 2, None),
        ("sell", "A", "OFFICIAL_INDEX_DELETE", "holdings_diff", 0.01, 2.0, 0.9, 0.01, 5e5, 1e8, 0.8, 2, True),
    ]
    e = spark.createDataFrame(rows, schema)

    def picked(name):
        return sorted(r["event_id"] for r in strategies.generate_trades(e, [strategies.strategy(name)]).collect())

    assert picked("DelayedAnnouncementReaction") == ["all_null", "strong"]
    assert picked("HighFlowLowLiquidity") == ["big_move", "strong"]
    assert picked("HoldingsDiffSignal") == ["strong"]
    assert picked("RebalanceCalendarTrade") == ["big_move", "strong"]
    assert picked("MultiETFStackedFlow") == ["strong"]
    assert picked("ForgottenSmallCapAdd") == ["all_null", "strong"]
    for empty in ("MethodologyChangeAnticipation", "ThematicIndexPrediction", "EffectiveDateFade"):
        assert picked(empty) == []


def test_labels(spark):
    e = spark.createDataFrame(
        [("a", 0.01, 0.02, True), ("b", 0.05, 0.001, True), ("c", None, None, None), ("d", 0.0, 0.02, None)],
        "event_id string, immediate_reaction double, delayed_return double, tradeable_flag boolean",
    )
    got = {r["event_id"]: tuple(r)[1:] for r in features.labels(e).collect()}
    assert got["a"] == (1, 1, 0.02, 1)
    assert got["b"] == (0, 0, 0.001, 0)
    assert got["c"] == (None, None, None, None)
    assert got["d"] == (1, 1, 0.02, 0)


def test_stack_count_window_and_compat(spark):
    when = lambda i: {"announcement_date": DAYS[i], "detected_date": DAYS[i]}
    e = make_events(
        spark,
        [
            event_row(event_id="a", product_ticker="F1", **when(0)),
            event_row(event_id="b", product_ticker="F1", **when(5)),
            event_row(event_id="c", product_ticker="F2", **when(10)),
            event_row(event_id="d", product_ticker="F3", **when(50)),
        ],
    )
    got = {r["event_id"]: r["stack_count"] for r in strategies.with_stack_count(e).collect()}
    assert got == {"a": 1, "b": 1, "c": 2, "d": 1}
    compat = {r["event_id"]: r["stack_count"] for r in strategies.with_stack_count(e, compat=True).collect()}
    assert set(compat.values()) == {4}
