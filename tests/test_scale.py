"""Plans and settings that keep the growth of the large queries in proportion to their input."""

from __future__ import annotations

import contextlib

import pytest
from conftest import RAMP, business_days, event_row, make_bars, make_events

from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import (
    asof, backtest, bars as bar_ops, diagnostics, events as event_ops, features, flow, learning, membership, snapshots, strategies, sweep,
)
from tidemark.plans import pipeline
from tidemark.plans.queries import Lab

DAYS = business_days("2023-01-02", 60)


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanged(df, column):
    """Shuffles of a plan whose rows carry a column."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    nodes = [part.strip().split("\n") for part in text.split("\n\n")]
    return [n for n in nodes if ") Exchange" in n[0] and any(f"{column}#" in line for line in n if line.startswith("Input"))]


def test_enrichment_moves_event_rows_once(spark, no_broadcast):
    bars = make_bars(spark, RAMP).unionByName(make_bars(spark, RAMP[::-1], symbol="BOE.AX"))
    rows = [
        event_row(event_id=f"E{i}", asx_ticker=("PDN.AX", "BOE.AX", "ZZZ.AX", None)[i % 4], provider=f"P{i}",
                  announcement_date=DAYS[i] if i % 5 else None, effective_date=DAYS[i + 7] if i % 3 else None)
        for i in range(40)
    ]
    e = make_events(spark, rows)
    priced = flow.priced_points(e, bars)
    plain = pipeline.build_and_enrich(e, bars, priced=priced)
    with session.joins_in_place(spark):
        found = pipeline.look_up(e, bars, priced=priced, rows=e.repartition(5, "asx_ticker"))
        out = pipeline.measure(found)
        assert len(exchanged(out, "provider")) == 1
        got = sorted(map(str, out.select(*plain.columns).collect()))
    assert got == sorted(map(str, plain.collect())) and len(got) == 40
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_shuffle_partitions_follow_the_input(spark):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    with contextlib.ExitStack() as undo:
        undo.callback(spark.conf.unset, name)
        undo.callback(spark.conf.unset, "spark.sql.adaptive.advisoryPartitionSizeInBytes")
        assert session.spread(spark, 1 << 30) == 512 and spark.conf.get(name) == "512"
        assert session.spread(spark, 1000) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_stored_points_equal_lazy_ones_and_move_packs_once(spark, no_broadcast):
    bars = make_bars(spark, RAMP).unionByName(make_bars(spark, RAMP[::-1], symbol="BOE.AX", start="2021-12-20"))
    rows = [(s, DAYS[i]) for i in range(0, 60, 3) for s in ("PDN.AX", "BOE.AX", "ZZZ.AX")] + [(None, DAYS[0]), ("PDN.AX", None)]
    left = spark.createDataFrame(rows, "symbol string, day date")
    payload = {"date": "bar_date", "close": "bar_close"}
    for forward in (False, True):
        args = (left, bars, "symbol", "day", "date", payload)
        lazy = asof.asof_join(*args, forward=forward, strict=True).collect()
        assert sorted(map(str, asof.asof_join(*args, forward=forward, strict=True, stored=True).collect())) == sorted(map(str, lazy))
    packs = session.durable(asof.pack(bars, "symbol", "date"), "packs")
    with session.joins_in_place(spark):
        hits = asof.resolve_points(left, packs, "symbol", "day", "date", payload)
        assert len(exchanged(hits, "__rows")) <= 2


def test_no_leg_is_shuffled_by_a_missing_start(spark):
    bars = make_bars(spark, RAMP)
    changes = spark.createDataFrame(
        [("Large 500", "US", a, "PDN.AX", DAYS[i]) for a in ("ADD", "DEL") for i in (2, 30)],
        "index_name string, market string, action string, ticker string, effective_date date",
    )
    bench = bars.select(F.lit("US").alias("market"), "date", "close")
    legs = membership.membership_legs(changes, bars, bench)
    # the calendar is joined to the changes, before one row becomes up to nine
    assert not exchanged(legs, "leg") and "start#" not in legs._sc._jvm.PythonSQLUtils.explainString(legs._jdf.queryExecution(), "formatted")
    found = {(r["strategy"], r["exit_date"]): r["gross_return"] for r in legs.collect()}
    # the stock is its own benchmark: no excess return
    assert found["S1x_ADD_excess_T-5", DAYS[30]] == pytest.approx(0.0)
    assert ("S1x_ADD_excess_T-5", DAYS[2]) not in found and len(found) == 14


def test_folds_are_fitted_side_by_side_with_the_same_scores(spark, monkeypatch):
    rows = [(f"E{i:03d}", float(i % 7), float((i * 5) % 11), i % 7 > 2, DAYS[i % 60]) for i in range(90)]
    data = spark.createDataFrame(rows, "event_id string, market_cap double, volatility double, y boolean, announcement_date date")
    target = F.when(F.col("event_id").endswith("3"), ~F.col("y")).otherwise(F.col("y")).cast("int")
    args = (
        data.select("event_id", "market_cap", "volatility"), data.select("event_id", target.alias("label_delayed_positive")),
        data.select("event_id", "announcement_date"),
    )
    together = learning.train_classifier(*args, rounds=3, folds=2)
    monkeypatch.setattr(learning, "FITS_AT_ONCE", 1)
    alone = learning.train_classifier(*args, rounds=3, folds=2)
    assert together["scores"] == pytest.approx(alone["scores"]) and len(alone["scores"]) == 2
    assert together["model"].stages[-1].getNumTrees == 3


def test_tasks_stay_small_after_merging(spark):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    with contextlib.ExitStack() as undo:
        undo.callback(spark.conf.unset, name)
        undo.callback(spark.conf.unset, "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
        session.spread(spark, 1 << 30)
        assert int(spark.conf.get(name).rstrip("b")) <= 16 << 20


def explained(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_long_look_back_reads_short_stretches_with_equal_values(spark):
    closes = [1.0 + (i * 37 % 11) / 100 for i in range(200)]
    closes[20], closes[70], closes[150] = 1e9, 0.0, float("nan")
    bars = make_bars(spark, closes).withColumn("volume", F.when(F.dayofmonth("date") > 4, F.col("volume") + F.dayofyear("date")))
    bars = bars.withColumn("dollar_volume", F.when(F.dayofmonth("date") != 9, F.col("close") * F.col("volume")))
    short = make_bars(spark, RAMP[:2], symbol="BOE.AX")
    numbered = bar_ops.with_positions(bars.unionByName(short))
    out = bar_ops.with_trailing(numbered)
    text = explained(out)
    assert "-20" in text and "-62" not in text
    last = bar_ops.trailing(63)
    plain = out.withColumns({
        "v_dollars": F.avg(bar_ops.traded_value()).over(last), "v_shares": F.avg("volume").over(last),
        "v_dev": F.when(F.col("bar_no") >= 5, F.stddev_samp("daily_return").over(last) * F.sqrt(F.lit(252.0))),
    })
    rows = plain.collect()
    assert len(rows) == 202
    for r in rows:
        for mine, theirs in (("adv_dollars", "v_dollars"), ("adv_shares", "v_shares"), ("volatility", "v_dev")):
            assert (r[mine] is None) == (r[theirs] is None), (mine, r)
            if r[mine] is not None:
                assert r[mine] == pytest.approx(r[theirs], rel=1e-9, nan_ok=True), (mine, r)


def test_trades_read_their_bars_from_one_written_table(spark, no_broadcast):
    bars = make_bars(spark, RAMP)
    e = make_events(spark, [event_row(event_id=f"E{i}", announcement_date=DAYS[i], effective_date=DAYS[i + 7]) for i in range(25, 40)])
    trades = e.select(
        F.lit("S").alias("strategy"), "event_id", "asx_ticker", F.lit(1).alias("direction"), F.lit("next_open").alias("entry_ref"),
        F.lit("effective").alias("exit_spec"), F.lit(30).alias("max_hold_days"),
    )
    out = backtest.backtest_trades(trades, e, bars)
    text = explained(out)
    assert "trade-bars" in text and "avg(" not in text and "-20" not in text
    wide = backtest.backtest_trades(trades, flow.attach_bars(e, bars).withColumn("market_cap", F.lit(None).cast("double")), bars)
    got = sorted(map(str, out.collect()))
    assert got == sorted(map(str, wide.collect())) and len(got) == 15 and "rejected=False" in got[0]


def shuffled(df):
    """All shuffles of a plan that carry rows of the written tables or of the input."""
    return [line for line in explained(df).split("\n") if ") Exchange" in line]


def test_stages_by_stock_meet_without_a_shuffle(spark, no_broadcast):
    lab = Lab(spark, "/root/testdata/sf0.001")
    with contextlib.ExitStack() as undo:
        undo.callback(spark.conf.unset, "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
        undo.callback(spark.conf.unset, "spark.sql.adaptive.advisoryPartitionSizeInBytes")
        assert not shuffled(bar_ops.with_trailing(lab.bars()))
        found, enriched = lab.lazy_looked_up(), lab.enriched()
        with session.joins_in_place(spark):
            assert not exchanged(found, "event_id") and not exchanged(found, "a_close") and not exchanged(found, "bar_no")
            assert not shuffled(backtest.run_strategies(enriched, lab.bars()))
        plain = sorted(map(str, lab.lazy_events().collect()))
        assert sorted(map(str, lab.events().collect())) == plain
        assert sorted(map(str, lab.bars().collect())) == sorted(map(str, lab.lazy_bars().collect()))
        context = pipeline.look_up(lab.lazy_events(), lab.lazy_bars(), lab.market_caps(), lab.profiles())
        assert lab.looked_up().count() == len(plain)
        assert sorted(map(str, lab.looked_up().collect())) == sorted(map(str, context.select(*lab.looked_up().columns).collect()))


def test_events_by_stock_keep_the_survivors_of_ids_with_several_stocks(spark):
    first = make_events(spark, [
        event_row(event_id=i, asx_ticker=t, provider=p)
        for i, t, p in [("A", "PDN.AX", "P1"), ("A", "BOE.AX", "P2"), ("B", None, "P3"), ("B", "PDN.AX", "P4"),
                        (None, "PDN.AX", "P5"), (None, None, "P6"), ("C", "BOE.AX", "P8"), ("C", "BOE.AX", "P7"), ("D", None, "P9")]
    ])
    second = make_events(spark, [
        event_row(event_id=i, asx_ticker=t, provider="AA")
        for i, t in [("A", "AAA.AX"), ("C", "AAA.AX"), ("D", None), ("E", "BOE.AX"), ("E", "AAA.AX"), ("F", "PDN.AX")]
    ])
    writes = []

    def write(df):
        writes.append(df)
        return session.durable_by(df, "dealt", "asx_ticker", 3)

    for parts, passes in (([first, second], 2), ([first.where("event_id = 'C'"), second.where("event_id = 'F'")], 1)):
        del writes[:]
        plain = sorted(map(str, event_ops.union_events(parts).collect()))
        assert sorted(map(str, event_ops.union_events_by_stock(parts, write, 3).collect())) == plain and len(writes) == passes


def test_holdings_lines_move_once_for_their_windows(spark, no_broadcast):
    rows = [("F1", DAYS[d], t, "n", None, 0.1 * d, 1.0 * d, None, "manual") for d in (1, 20, 40) for t in ("A", "B", "C")[: 3 - d // 20]]
    h = spark.createDataFrame(
        rows, "product_ticker string, as_of_date date, constituent_ticker string, constituent_name string, exchange string, "
        "weight_pct double, shares double, market_value double, source string",
    )
    lines = snapshots.collapse_constituents(h, together=True)
    history = lines.withColumn("n", F.count(F.lit(1)).over(bar_ops.W.partitionBy("product_ticker", "constituent_key")))
    assert len(exchanged(history, "constituent_key")) == 1
    assert sorted(map(str, lines.collect())) == sorted(map(str, snapshots.collapse_constituents(h).collect()))
    assert snapshots.diff_history(h).count() == 5


def test_event_rows_are_made_where_their_sources_lie(spark):
    lab = Lab(spark, "/root/testdata/sf0.001")
    with contextlib.ExitStack() as undo:
        undo.callback(spark.conf.unset, "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
        undo.callback(spark.conf.unset, "spark.sql.adaptive.advisoryPartitionSizeInBytes")
        stacked = event_ops._stacked(lab._event_parts_by_stock()).repartition(lab.parts, "asx_ticker")
        out = event_ops._survivors(stacked, "asx_ticker")
        assert not exchanged(out, "event_id") and not exchanged(out, "constituent_key") and len(shuffled(out)) == 2
        assert sorted(map(str, lab.holdings().select("product_ticker", "as_of_date", "constituent_ticker", "shares").collect())) == sorted(
            map(str, lab.lazy_holdings().select("product_ticker", "as_of_date", "constituent_ticker", "shares").collect()))


def test_lines_dealt_by_stock_keep_their_events(spark):
    names = [("ABC AU", "x"), ("ASX:ABC", "x"), ("abc.ax", "x"), ("", "abc au"), (None, "ABC.AX"), ("nan", "XYZ.AX"), ("XYZ LN", "y"), ("NAN", None), ("QQ-AU", None)]
    rows = [
        (f, DAYS[d], t, n, e, 0.1 + 0.01 * d * (i + 1), 10.0 * i + d, None, "manual")
        for f in ("F1", "F2") for d in (1, 20, 40) for i, (t, n) in enumerate(names) for e in (None, "ASX", "LSE") if (i + d) % 4
    ]
    h = spark.createDataFrame(
        rows, "product_ticker string, as_of_date date, constituent_ticker string, constituent_name string, exchange string, "
        "weight_pct double, shares double, market_value double, source string",
    )
    registry = spark.createDataFrame(
        [("F1", "MSCI", "I", "Fund 1", "B", "T", 1.0, 2.0, 0.5)],
        "product_ticker string, index_provider string, issuer string, product_name string, benchmark_index_name string, theme string, "
        "aum double, number_of_holdings double, confidence_score double",
    )
    dealt = h.withColumn(snapshots.DEALT, snapshots.dealt_by())
    dates = snapshots.snapshot_dates(h)
    plain = sorted(map(str, event_ops.events_from_holdings(h, registry).collect()))
    assert sorted(map(str, event_ops.events_from_holdings(dealt, registry, dates=dates).collect())) == plain and len(plain) == 8
    diff = sorted(map(str, snapshots.diff_history(h).collect()))
    assert sorted(map(str, snapshots.diff_history(dealt).drop(snapshots.DEALT).collect())) == diff


def test_bars_are_stored_without_what_follows_from_other_columns(spark):
    rows = [("A", DAYS[0], 1.0, 1.0, 1.0, 1.0, 5.0), ("A", DAYS[1], 1.0, 3.0, 0.5, 2.0, 5.0), ("A", DAYS[2], 1.0, 1.0, 1.0, None, None),
            ("B", DAYS[0], None, 2.0, 2.0, 2.0, 1.0), ("B", DAYS[1], None, None, None, None, 1.0), (None, DAYS[3], float("nan"), float("nan"), 1.0, 1.0, 2.0)]
    bars = bar_ops.fill_bar_columns(spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double"))
    stored = bar_ops.to_store(bars)
    assert not {"adj_close", "vwap", "dollar_volume"} & set(stored.columns) and stored.where("one_price and high is not null").isEmpty()
    back = bar_ops.from_store(stored)
    assert back.columns == bars.columns and sorted(map(str, back.collect())) == sorted(map(str, bars.collect()))


def test_packs_do_not_move_for_the_window_of_points_by_key(spark, no_broadcast):
    bars = session.durable_by(make_bars(spark, RAMP).unionByName(make_bars(spark, RAMP[::-1], symbol="BOE.AX", start="2021-12-20")), "dealt-bars", "symbol", 4)
    rows = [(s, DAYS[i]) for i in range(0, 60, 3) for s in ("PDN.AX", "BOE.AX", "ZZZ.AX")]
    points = session.durable_by(spark.createDataFrame(rows, "symbol string, day date"), "dealt-points", "symbol", 4)
    with session.joins_in_place(spark):
        # as events look their bars up: under another name of the key
        renamed = bars.withColumnRenamed("symbol", "asx_ticker"), points.withColumnRenamed("symbol", "asx_ticker")
        hits = asof.resolve_points(renamed[1], renamed[0], "asx_ticker", "day", "date", {"date": "bar_date", "close": "bar_close"}, known=True)
        assert not shuffled(hits)
        assert hits.count() == 40 and hits.where("bar_date > day").isEmpty()


def test_lookups_store_no_wide_row_besides_the_looked_up_events(spark, no_broadcast):
    lab = Lab(spark, "/root/testdata/sf0.001")
    with contextlib.ExitStack() as undo:
        undo.callback(spark.conf.unset, "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
        undo.callback(spark.conf.unset, "spark.sql.adaptive.advisoryPartitionSizeInBytes")
        found = lab.lazy_looked_up()
        assert lab.event_days().columns == ["asx_ticker", "look_date", "bar_date"] and "notes" not in found.columns
        assert "event_bars" not in explained(found)
        # a date or a stock that is missing meets nothing but the counts of its stock
        rows = [event_row(event_id=f"E{i}", asx_ticker=t, announcement_date=d, effective_date=DAYS[40], product_ticker=p)
                for i, (t, d, p) in enumerate([("PDN.AX", DAYS[30], "F"), ("PDN.AX", None, "F"), (None, DAYS[30], "F"), ("ZZZ.AX", DAYS[30], None), ("PDN.AX", DAYS[31], "G"), (None, None, "G")])]
        e, bars = make_events(spark, rows), make_bars(spark, RAMP)
        caps = spark.createDataFrame([("PDN.AX", DAYS[3], 7.0)], "symbol string, date date, market_cap double")
        profiles = spark.createDataFrame([("PDN.AX", "s", "i", 9.0)], "symbol string, sector string, industry string, market_cap double")
        plain = pipeline.look_up(e, bars, caps, profiles)
        facts = features.stock_day_facts(e, caps, strategies.stock_stacks(e))
        known = features.attach_facts(e.withColumn("ref_date", flow.reference_date()), facts, profiles)
        out = flow.attach_bars_by_day(known, bars, flow.bar_days(e, bars))
        assert sorted(map(str, out.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
        assert set(out.columns) == set(plain.columns) and out.count() == 6


def test_trials_find_their_exits_in_place(spark, no_broadcast, monkeypatch):
    lab, plans = Lab(spark, "/root/testdata/sf0.001"), {}

    def written(df, name="stage"):
        plans[name] = shuffled(df)
        return session.durable(df, name)

    monkeypatch.setattr(sweep, "durable", written)
    with contextlib.ExitStack() as undo:
        undo.callback(spark.conf.unset, "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
        undo.callback(spark.conf.unset, "spark.sql.adaptive.advisoryPartitionSizeInBytes")
        enriched, bars = lab.enriched(), lab.bars()
        monkeypatch.setattr(sweep, "bootstrap_ci", lambda ledger, keys: ledger.groupBy(*keys).agg(F.lit(0.0).alias("ci_low"), F.lit(0.0).alias("ci_high")))

        def rounded(df):
            # sums of doubles differ in the last digit by the order of their rows
            return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())

        placed = rounded(sweep.first_round(enriched, bars, by_stock=True))
        assert not plans["trials"] and len(placed) == 4
        assert placed == rounded(sweep.first_round(enriched, bars)) and plans["trials"]


def test_ids_are_counted_apart_from_the_means(spark, no_broadcast):
    e = make_events(spark, [event_row(event_id=i, provider=p) for i, p in [("A", "P"), ("A", "P"), ("B", "P"), ("B", "Q"), (None, "Q"), (None, "R"), ("C", None)]])
    e = e.withColumns({c: F.when(F.col("event_id") != "B", F.lit(2.0)).otherwise(F.lit(5.0)) for c in (
        "immediate_reaction", "delayed_return", "underreaction_score", "delayed_flow_opportunity_score")})
    out = diagnostics.inefficiency(e, "provider")
    moved = exchanged(out, "event_id")
    assert moved and not any("sum#" in line for node in moved for line in node if line.startswith("Input"))
    assert {r["provider"]: (r["n_events"], r["avg_delayed_return"], r["median_delayed_return"]) for r in out.collect()} == {
        "P": (2, 3.0, 2.0), "Q": (1, 5.0, 5.0), "R": (0, 5.0, 5.0)}
