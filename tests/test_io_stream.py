from __future__ import annotations

import datetime as dt
import json
import os

import pytest
from conftest import RAMP, business_days, event_row, make_bars, make_events
from pyspark.sql import functions as F

from tidemark.operators import learning, registry, screens, sweep
from tidemark.operators.flow import enrich_events
from tidemark.operators.features import with_features
from tidemark.operators.strategies import with_stack_count
from tidemark.schemas import BARS, HOLDINGS, MEMBERSHIP_CHANGES, conform
from tidemark.session import durable, shared_dir
from tidemark.sources import holdings_files, payloads, tables
from tidemark.streaming import jobs


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_manual_snapshots_with_different_headers(spark, tmp_path):
    _write(tmp_path / "urnm" / "2024-01-31.csv", "Ticker,Name,Weight (%),Shares\nPDN,\"Paladin, Ltd\",12.5%,100\nBOE,Boss,8.0,50\n")
    _write(tmp_path / "urnm" / "20240229.csv", "Security Name,ASX Code,% of net assets,Market Value\nPaladin,pdn,0.15,\"1,000\"\n,,,\n")
    _write(tmp_path / "urnm" / "_TEMPLATE.csv", "Ticker,Name\nX,Y\n")
    _write(tmp_path / "gdx" / "notes.csv", "Ticker,Name\nX,Y\n")
    _write(tmp_path / "gdx" / "31-01-2024.csv", "exchange,constituent_ticker,weight_pct,shares\nASX,NST,0.5,7\n")
    rows = holdings_files.read_manual_snapshots(spark, str(tmp_path)).collect()
    got = {(r["product_ticker"], str(r["as_of_date"]), r["constituent_ticker"]): r for r in rows}
    assert set(got) == {
        ("URNM", "2024-01-31", "PDN"), ("URNM", "2024-01-31", "BOE"), ("URNM", "2024-02-29", "PDN"), ("GDX", "2024-01-31", "NST"),
    }
    first = got[("URNM", "2024-01-31", "PDN")]
    assert first["constituent_name"] == "Paladin, Ltd" and first["weight_pct"] == pytest.approx(0.125) and first["shares"] == 100.0
    assert got[("URNM", "2024-02-29", "PDN")]["weight_pct"] == pytest.approx(0.15)
    assert got[("URNM", "2024-02-29", "PDN")]["market_value"] == 1000.0
    assert got[("GDX", "2024-01-31", "NST")]["exchange"] == "ASX"


def test_downloads_skip_junk_above_the_header(spark, tmp_path):
    _write(tmp_path / "LIT.csv", "Fund holdings\nAs of 1 Jan\n\nTicker,Name,Weight\nPLS,Pilbara,4.5\nMIN,Min Res,3.5\n")
    _write(tmp_path / "URA.csv", "Ticker,Name,Weight\nPDN,Paladin,0.5\nBOE,Boss,0.4\n")
    rows = holdings_files.read_downloads(spark, f"{tmp_path}/*.csv", "2024-01-01").collect()
    got = {(r["product_ticker"], r["constituent_ticker"]): r["weight_pct"] for r in rows}
    assert got == {
        ("LIT", "PLS"): pytest.approx(0.045), ("LIT", "MIN"): pytest.approx(0.035),
        ("URA", "PDN"): pytest.approx(0.5), ("URA", "BOE"): pytest.approx(0.4),
    }


def test_payloads(spark, tmp_path):
    bars = [{"symbol": "A", "date": "2024-01-02", "open": 1, "high": 3, "low": 1, "close": 2, "volume": 10},
            {"symbol": "A", "date": None, "open": 1, "high": 3, "low": 1, "close": 2, "volume": 10}]
    (tmp_path / "bars.json").write_text(json.dumps(bars))
    rows = payloads.bars_from_payload(payloads.read_payload(spark, f"{tmp_path}/bars.json")).collect()
    assert len(rows) == 1
    assert (rows[0]["adj_close"], rows[0]["vwap"], rows[0]["dollar_volume"]) == (2.0, 2.0, 20.0)
    (tmp_path / "prof.json").write_text(json.dumps([{"symbol": "A", "mktCap": 5.0, "exchangeShortName": "ASX", "volAvg": 7}]))
    p = payloads.profiles_from_payload(payloads.read_payload(spark, f"{tmp_path}/prof.json")).first()
    assert (p["market_cap"], p["exchange"], p["avg_volume"], p["sector"]) == (5.0, "ASX", 7.0, None)
    (tmp_path / "caps.json").write_text(json.dumps([{"symbol": "A", "date": f"2024-01-0{i}", "marketCap": i} for i in range(1, 6)]))
    caps = payloads.market_caps_from_payload(payloads.read_payload(spark, f"{tmp_path}/caps.json"), 2).collect()
    assert sorted(r["market_cap"] for r in caps) == [4.0, 5.0]
    (tmp_path / "chg.json").write_text(json.dumps([
        {"date": "2024-03-01", "symbol": "new", "removedTicker": "old", "reason": "r"}, {"date": "2024-04-01", "symbol": "", "removedTicker": "gone"},
        {"date": "bad", "symbol": "x"}]))
    ch = payloads.changes_from_payload(payloads.read_payload(spark, f"{tmp_path}/chg.json"), "I")
    assert ch.schema.fieldNames() == MEMBERSHIP_CHANGES.fieldNames()
    assert {(r["action"], r["ticker"]) for r in ch.collect()} == {("ADD", "NEW"), ("DEL", "OLD"), ("DEL", "GONE")}
    (tmp_path / "hold.json").write_text(json.dumps([{"etf": "E", "asset": "X", "weightPercentage": 1.5, "sharesNumber": 2, "marketValue": 3}]))
    h = payloads.fund_holdings_from_payload(payloads.read_payload(spark, f"{tmp_path}/hold.json")).first()
    assert (h["weight_pct"], h["shares"], h["market_value"]) == (1.5, 2.0, 3.0)
    (tmp_path / "list.json").write_text(json.dumps([{"symbol": "e.ax", "name": "E"}, {"symbol": "f", "name": "F"}]))
    (tmp_path / "info.json").write_text(json.dumps([{"symbol": "E.AX", "assetsUnderManagement": 9.0}]))
    funds = payloads.funds_from_payload(
        payloads.read_payload(spark, f"{tmp_path}/list.json"), payloads.read_payload(spark, f"{tmp_path}/info.json")
    )
    assert {(r["etf"], r["aum"]) for r in funds.collect()} == {("E.AX", 9.0), ("F", None)}
    assert [r["etf"] for r in payloads.listed_funds(funds).collect()] == ["E.AX"]


def test_snapshot_store_replaces_only_its_partitions(spark, tmp_path):
    def lines(product, day, shares):
        return spark.createDataFrame([(product, day, "X", "x", None, 1.0, shares, None, "manual")], HOLDINGS)

    path, d1, d2 = str(tmp_path / "snaps"), dt.date(2024, 1, 1), dt.date(2024, 2, 1)
    tables.save_snapshots(lines("A", d1, 1.0).unionByName(lines("B", d1, 2.0)), path)
    tables.save_snapshots(lines("A", d1, 5.0).unionByName(lines("A", d2, 6.0)), path)
    got = {(r["product_ticker"], r["as_of_date"]): r["shares"] for r in tables.read_snapshots(spark, path).collect()}
    assert got == {("A", d1): 5.0, ("B", d1): 2.0, ("A", d2): 6.0}
    one = tables.read_snapshots(spark, path, "A")
    assert one.count() == 2
    assert "PartitionFilters: [isnotnull(product_ticker" in one._jdf.queryExecution().toString()


def test_bars_store_prunes_years(spark, tmp_path):
    bars = make_bars(spark, [1.0] * 300)
    path = tables.write_bars(bars, str(tmp_path / "bars"))
    part = tables.read_bars(spark, path, "2024-01-01", "2024-01-31")
    assert part.columns == BARS.fieldNames() and part.agg(F.min("date")).first()[0] == dt.date(2024, 1, 1)
    assert "PartitionFilters: [isnotnull(year" in part._jdf.queryExecution().toString()


def test_manual_inputs(spark, tmp_path):
    _write(tmp_path / "ann" / "a.csv", "provider,index,ticker,company_name,change,ann_date,eff_date\nS&P,I,DRO,Drone,Added,2026-06-06,20 Jun 2026\n")
    _write(tmp_path / "ann" / "_TEMPLATE.csv", "provider,index,ticker,company_name,change,ann_date,eff_date\nT,I,TTT,t,ADD,2026-01-01,2026-01-02\n")
    rows = tables.read_announcements(spark, str(tmp_path / "ann")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["asx_ticker"], r["action"], str(r["effective_date"]), r["confidence"], r["needs_verification"]) == (
        "DRO.AX", "ADD", "2026-06-20", 0.9, False,
    )
    _write(tmp_path / "reg" / "etf_registry" / "x.csv", "product_ticker,aum,rebalance_months,asx_exposure_flag\nurnm,1700000000,\"6,12\",True\n")
    _write(tmp_path / "reg" / "index_registry" / "y.csv", "product_ticker,benchmark_index_name\nINDEX:M,M Index\n")
    manual = tables.read_manual_registry(spark, str(tmp_path / "reg"))
    got = {r["product_ticker"]: r for r in manual.collect()}
    assert got["urnm"]["rebalance_months"] == [6, 12] and got["urnm"]["record_type"] == "etf" and got["urnm"]["source"] == "manual"
    assert got["INDEX:M"]["record_type"] == "index"
    built = registry.build_registry([registry.seed_registry(spark), manual])
    paths = tables.save_registry(built, str(tmp_path / "out"))
    assert set(paths) == {"etf_registry", "index_registry", "asx_exposed_indices"}
    assert tables.read_registry(spark, str(tmp_path / "out")).count() == 44
    _write(tmp_path / "ovr.csv", "event_id,effective_date,confidence_score,tradeable_flag,notes\nabc,2026-06-20,0.95,True,ok\n")
    o = tables.read_overrides(spark, str(tmp_path / "ovr.csv")).first()
    assert (str(o["effective_date"]), o["confidence_score"], o["tradeable_flag"]) == ("2026-06-20", 0.95, True)
    _write(tmp_path / "cust.csv", "event_id,asx_ticker,announcement_date,_product_ticker\n,LYC.AX,2026-05-15,REMX\n")
    c = tables.read_custom_events(spark, str(tmp_path / "cust.csv")).first()
    assert (str(c["announcement_date"]), c["product_ticker"]) == ("2026-05-15", "REMX")


@pytest.fixture(scope="module")
def enriched(spark):
    days = business_days("2023-01-02", 60)
    bars = durable(make_bars(spark, RAMP), "bars").select(*BARS.fieldNames())
    rows = [
        event_row(event_id=f"{i:03d}", announcement_date=days[20 + i % 12], detected_date=days[20 + i % 12],
                  effective_date=days[40 + i % 3], shares_delta=1e6 * (1 + i % 3), provider="S&P" if i % 2 else "Small",
                  theme="t")
        for i in range(24)
    ]
    e = make_events(spark, rows)
    out = with_stack_count(with_features(enrich_events(e, bars)))
    return durable(out, "enriched"), bars


def test_reports(spark, enriched, tmp_path):
    from tidemark.operators.backtest import run_strategies

    events, bars = enriched
    ledger = durable(run_strategies(events, bars), "ledger")
    paths = tables.write_reports(events, ledger, str(tmp_path), "2023-02-01")
    back = {n: spark.read.option("header", True).csv(p) for n, p in paths.items()}
    assert set(back) == {
        "discovered_events", "delayed_reaction_events", "strategy_scoreboard", "provider_inefficiency_ranking",
        "theme_inefficiency_ranking", "top_current_watchlist",
    }
    assert back["discovered_events"].count() == 24 and "ref_date" not in back["discovered_events"].columns
    assert back["provider_inefficiency_ranking"].count() == 2
    tables.write_ledger(ledger, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/ledger").count() == ledger.count()


def test_any_number_of_headers_is_one_branch(spark, tmp_path):
    for k in range(12):
        names = [f"extra{k}", "Ticker " if k % 2 else "symbol", "ACTION", "ann_date"] + (["confidence"] if k % 3 == 0 else [])
        cells = [f"x{k}", f"A{k:02d}", "Added", "2024-01-02"] + (["0.4"] if k % 3 == 0 else [])
        text = "\n" * (k % 2) + ",".join(names) + "\r\n\n" + ",".join(cells) + "\n" + ",".join([f'"x,{k}"', f'"A{k:02d}"', ""]) + "\n"
        (tmp_path / f"f{k}.csv").write_text(("\ufeff" if k == 0 else "") + text)
    (tmp_path / "_TEMPLATE.csv").write_text("ticker,action\nZZZ,ADD\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "only_header.csv").write_text("ticker,action\n")
    out = tables.read_announcements(spark, str(tmp_path))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("Union") == 0 and "Join" in plan
    rows = {(r["asx_ticker"], r["action"]): r for r in out.collect()}
    assert len(rows) == 24
    for k in range(12):
        first, second = rows[f"A{k:02d}.AX", "ADD"], next(r for (t, a), r in rows.items() if t == f"A{k:02d}.AX" and a != "ADD")
        assert first["announcement_date"] == dt.date(2024, 1, 2) and second["announcement_date"] is None
        assert first["confidence"] == (0.4 if k % 3 == 0 else tables.DEFAULT_ANNOUNCEMENT_CONFIDENCE)
        assert second["confidence"] == (None if k % 3 == 0 else tables.DEFAULT_ANNOUNCEMENT_CONFIDENCE)


def test_research_loop(spark, enriched, tmp_path):
    events, bars = enriched
    for sequential in (False, True):
        out = sweep.research_loop(
            events, bars, max_rounds=2, sequential=sequential,
            log=lambda rows: tables.append_trials(spark, rows, str(tmp_path / "trials")),
        )
        assert out["best"]["objective"] >= out["history"][0]["objective"]
        assert out["trials"][0]["outcome"] == "kept" and len(out["trials"]) >= 4
    assert spark.read.parquet(str(tmp_path / "trials")).count() >= 8


def test_research_history_is_the_loop(spark, enriched):
    events, bars = enriched
    table = [tuple(r) for r in sweep.research_history(events, bars, max_rounds=2).collect()]
    trials = sweep.research_loop(events, bars, max_rounds=2)["trials"]
    assert [(r, adopted) for r, _, _, _, adopted in table] == [(t["iteration"], t["outcome"] != "rejected") for t in trials]
    assert [x[3] for x in table] == pytest.approx([t["objective"] for t in trials])


def test_greedy_walk_adopts_and_stops():
    sets = sweep._lattice({"max_immediate_reaction_pct": 0.03, "min_flow_pressure": 0.5}, 5)
    assert len(sets) == 36 and sets[(2, 0, 0)]["max_immediate_reaction_pct"] == 0.0147 and sets[(0, 1, 1)]["exit"] == "eff_close_plus5"
    value = {s: (9, 0.1 * min(s[0], 2) + 0.05 * s[2]) for s in sets}
    walk = sweep._walk(value, 5)
    assert [(r, t) for r, t, _, _, adopted in walk if adopted] == [(0, "baseline"), (1, "tighter reaction"), (2, "tighter reaction"), (3, "later exit")]
    assert walk[-1][0] == 4 and len(walk) == 13
    assert len(sweep._walk({s: (9, 1.0 * sum(s)) for s in sets}, 5)) == 16


def test_models_refuse_small_or_flat_data(spark):
    f = spark.createDataFrame([(str(i), float(i)) for i in range(10)], "event_id string, mom_1m double")
    y = spark.createDataFrame([(str(i), i % 2, float(i)) for i in range(10)],
                              "event_id string, label_delayed_positive int, label_delayed_return double")
    d = spark.createDataFrame([(str(i), dt.date(2024, 1, 1 + i)) for i in range(10)], "event_id string, announcement_date date")
    assert learning.train_classifier(f, y, d)["trained"] is False
    assert learning.train_regressor(f, y, d)["reason"] == learning.TOO_FEW_ROWS


def test_models_learn_in_time_order(spark):
    n = 120
    f = spark.createDataFrame(
        [(f"{i:03d}", float(i % 7), None, "a" if i % 3 else None) for i in range(n)],
        "event_id string, mom_1m double, mom_12m double, sector string",
    )
    y = spark.createDataFrame(
        [(f"{i:03d}", int(i % 7 > 3), float(i % 7)) for i in range(n)],
        "event_id string, label_delayed_positive int, label_delayed_return double",
    )
    d = spark.createDataFrame([(f"{i:03d}", dt.date(2024, 1, 1) + dt.timedelta(days=i)) for i in range(n)],
                              "event_id string, announcement_date date")
    clf = learning.train_classifier(f, y, d, rounds=3, folds=2)
    assert clf["trained"] and clf["n"] == n and clf["cv_auc_mean"] > 0.9
    reg = learning.train_regressor(f, y, d, rounds=3, folds=2)
    assert reg["trained"] and reg["cv_mae"] < 2.0


def test_candidate_dataset(spark):
    e = spark.createDataFrame([("A.AX", "OFFICIAL_INDEX_ADD"), ("B.AX", "OFFICIAL_INDEX_DELETE")], "asx_ticker string, event_type string")
    assert learning.candidate_dataset(e)["ready"] is False
    u = spark.createDataFrame([("A.AX",), ("C.AX",)], "asx_ticker string")
    rows = learning.candidate_dataset(e, u, exclude_added=True)["data"].collect()
    assert {(r["asx_ticker"], r["is_added"]) for r in rows} == {("A.AX", 1), ("C.AX", 0)}


# ------------------------------------------------------------------ streaming
def _lines(spark, rows):
    return spark.createDataFrame([(p, d, t, t, None, w, s, None, "manual") for p, d, t, w, s in rows], HOLDINGS)


def test_snapshot_stream_equals_batch_diff(spark, tmp_path):
    from tidemark.operators.snapshots import diff_history

    days = [dt.date(2024, m, 1) for m in (1, 2, 3, 4)]
    landed = str(tmp_path / "in")
    batches = [
        [("E", days[0], "A", 0.5, 1.0), ("E", days[0], "B", 0.5, 1.0)],
        [("E", days[1], "A", 0.6, 2.0), ("F", days[1], "A", 1.0, 9.0)],
        [("E", days[2], "A", 0.6, 2.0), ("E", days[2], "C", 0.4, 4.0), ("E", days[3], "C", 0.4, 5.0)],
    ]
    for rows in batches:
        _lines(spark, rows).coalesce(1).write.mode("append").parquet(landed)
        jobs.snapshot_changes(
            jobs.read_stream(spark, landed, HOLDINGS), str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "ck")
        ).awaitTermination()
    keys = ["product_ticker", "as_of_date", "constituent_ticker", "change_type", "shares_delta"]
    got = spark.read.parquet(f"{tmp_path}/out/changes").select(keys).collect()
    want = diff_history(_lines(spark, [r for b in batches for r in b])).select(keys).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) == 5
    _lines(spark, [("E", days[1], "Z", 0.1, 1.0)]).coalesce(1).write.mode("append").parquet(landed)
    jobs.snapshot_changes(
        jobs.read_stream(spark, landed, HOLDINGS), str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "ck")
    ).awaitTermination()
    late = spark.read.parquet(f"{tmp_path}/out/late").collect()
    assert [(r["constituent_ticker"], r["as_of_date"]) for r in late] == [("Z", days[1])]
    assert spark.read.parquet(f"{tmp_path}/out/changes").count() == 5


def test_bars_and_dedup_streams(spark, tmp_path):
    ts = dt.datetime(2024, 1, 1, 10)
    rows = [(i % 3, ts + dt.timedelta(hours=i), 7, float(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "event_id int, ts timestamp, user_id int, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), df.schema)
    jobs.append_rows(jobs.distinct_events(stream, "ts", "event_id"), str(tmp_path / "d"), str(tmp_path / "dc")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "d")).count() == 3
    bars = jobs.bars_from_stream(stream, "ts", "user_id", "value")
    jobs.upsert_batches(bars, str(tmp_path / "b"), str(tmp_path / "bc")).awaitTermination()
    row = jobs.latest_rows(spark, str(tmp_path / "b"), ["symbol", "date"]).collect()
    assert len(row) == 1 and (row[0]["open"], row[0]["close"], row[0]["volume"]) == (0.0, 5.0, 6.0)


def test_a_replay_of_any_age_gives_no_second_row(spark, tmp_path):
    schema = "event_id int, ts timestamp, v int"
    day = dt.datetime(2024, 1, 1)
    landed, out = str(tmp_path / "in"), str(tmp_path / "out")
    deliveries = [
        [(1, day, 1), (2, day, 1), (1, day + dt.timedelta(hours=1), 2)],
        [(3, day + dt.timedelta(days=29), 1)],
        [(1, day, 1), (4, day + dt.timedelta(days=30), 1), (2, day + dt.timedelta(days=40), 9), (None, day, 1)],
    ]
    for rows in deliveries:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landed)
        jobs.accept_once(jobs.read_stream(spark, landed, schema), out, str(tmp_path / "ck"), "ts", "event_id").awaitTermination()
    got = sorted((r["event_id"], r["v"], r["batch"]) for r in spark.read.parquet(f"{out}/accepted").collect())
    assert got == [(1, 1, "main-0"), (2, 1, "main-0"), (3, 1, "main-1"), (4, 1, "main-2")]
    # a batch that is run again accepts the same rows
    replay = jobs.read_stream(spark, landed, schema)
    jobs.accept_once(replay, out, str(tmp_path / "ck2"), "ts", "event_id", "second").awaitTermination()
    assert spark.read.parquet(f"{out}/accepted").count() == 4


def test_state_logs_are_compacted(spark, tmp_path):
    landed, path = str(tmp_path / "in"), str(tmp_path / "log")
    schema = "k int, v int"
    expected = {}
    for n in range(7):
        rows = [(n % 3, n), (10 + n, n)]
        expected |= dict(rows)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landed)
        stream = jobs.read_stream(spark, landed, schema)
        jobs.upsert_batches(stream, path, str(tmp_path / "ck"), "append", ["k"], compact_every=3).awaitTermination()
        latest = jobs.latest_rows(spark, path, ["k"])
        assert {r["k"]: r["v"] for r in latest.collect()} == expected
        read = jobs._versions(spark, path).select(F.input_file_name()).distinct().collect()
        assert len({r[0].rsplit("/", 1)[0] for r in read}) <= 3
        assert spark.read.parquet(f"{path}/delta/version={n}").count() == 2  # a batch writes its own rows


def test_snapshot_state_from_any_batch(spark, tmp_path):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=n) for n in range(8)]
    results = []
    for every in (2, 100):
        landed, out, state, check = (str(tmp_path / f"{x}{every}") for x in ("in", "out", "state", "ck"))
        for n, day in enumerate(days):
            rows = [("EF"[n % 2], day, "A", 1.0, float(n)), ("EF"[n % 2], day, "BCD"[n % 3], 1.0, 1.0)]
            _lines(spark, rows).coalesce(1).write.mode("append").parquet(landed)
            jobs.snapshot_changes(jobs.read_stream(spark, landed, HOLDINGS), out, state, check, compact_every=every).awaitTermination()
            assert spark.read.parquet(f"{state}/v{n}").select("product_ticker").distinct().count() == 1
        changes = spark.read.parquet(f"{out}/changes").select("product_ticker", "as_of_date", "constituent_ticker", "change_type")
        results.append(sorted(map(tuple, changes.collect())))
    assert results[0] == results[1] and len(results[0]) > 10
    assert jobs._state_before(spark, str(tmp_path / "state2"), 8, 2).count() == 4


def test_watchlist_stream(spark, enriched, tmp_path):
    events, _ = enriched
    path = str(tmp_path / "in")
    events.coalesce(1).write.parquet(path)
    opened = {r["event_id"] for r in screens.watchlist(events).collect()}
    closed = min(opened)
    events.where(F.col("event_id") == closed).withColumn("tradeable_flag", F.lit(False)).coalesce(1).write.mode("append").parquet(path)
    stream = jobs.read_stream(spark, path, events.schema, files_per_batch=1)
    jobs.trailing_watchlist(stream, str(tmp_path / "w"), str(tmp_path / "wc")).awaitTermination()
    got = {r["event_id"] for r in jobs.current_watchlist(spark, str(tmp_path / "w")).collect()}
    assert got == opened - {closed}


def test_a_lost_state_stops_the_stream(spark, tmp_path):
    from pyspark.errors import StreamingQueryException

    lines = [("A", "2024-01-01", "X", 1.0), ("A", "2024-02-01", "X", 2.0)]
    rows = spark.createDataFrame(lines, "product_ticker string, d string, constituent_ticker string, shares double")
    rows = conform(rows.withColumn("as_of_date", F.to_date("d")), HOLDINGS)
    path, out, state, check = (str(tmp_path / x) for x in ("in", "out", "state", "check"))
    rows.where("as_of_date = date '2024-01-01'").coalesce(1).write.parquet(path)

    def once():
        jobs.snapshot_changes(jobs.read_stream(spark, path, HOLDINGS), out, state, check).awaitTermination()

    once()
    os.rename(f"{state}/v0", f"{state}/gone")
    rows.where("as_of_date = date '2024-02-01'").coalesce(1).write.mode("append").parquet(path)
    with pytest.raises(StreamingQueryException):
        once()
    os.rename(f"{state}/gone", f"{state}/v0")
    once()
    assert [r["change_type"] for r in spark.read.parquet(f"{out}/changes").collect()] == ["WEIGHT_INCREASE"] or spark.read.parquet(f"{out}/changes").count() == 1


def test_each_file_has_its_own_header(spark, tmp_path):
    _write(
        tmp_path / "ann" / "a.csv",
        "provider,index_name,ticker,company_name,action,announcement_date,effective_date\nP1,I1,BHP,Big,ADD,2024-01-02,2024-01-20\n",
    )
    _write(tmp_path / "ann" / "b.csv", "ticker,action,index,provider,date,effective_date\nCSL,REMOVE,I2,P2,2024-02-03,2024-02-20\n")
    _write(tmp_path / "ann" / "_TEMPLATE.csv", "ticker,action\nXXX,ADD\n")
    got = {r["asx_ticker"]: r for r in tables.read_announcements(spark, str(tmp_path / "ann")).collect()}
    assert set(got) == {"BHP.AX", "CSL.AX"}
    assert (got["CSL.AX"]["provider"], got["CSL.AX"]["index_name"], str(got["CSL.AX"]["announcement_date"])) == ("P2", "I2", "2024-02-03")
    assert got["BHP.AX"]["provider"] == "P1" and str(got["BHP.AX"]["effective_date"]) == "2024-01-20"


def test_lines_that_do_not_fit_are_returned(spark, tmp_path):
    _write(tmp_path / "t.csv", "a,b,c\n1,2,3\n4,5\n6,7,8,9\n")
    path = str(tmp_path / "t.csv")
    assert tables.read_csv(spark, path).count() == 3
    assert sorted(r["line"] for r in tables.csv_rejects(spark, path).collect()) == ["4,5", "6,7,8,9"]


def test_shared_dir_reads_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
