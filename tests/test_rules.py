from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, text
from tidemark.functions.scalars import any_date, bucketise, tightness
from tidemark.functions.tickers import constituent_symbol, looks_like_asx, normalise_asx, vendor_symbol
from tidemark.operators import calendars, membership, screens

TICKERS = {
    "PDN AU Equity": "PDN.AX", "ASX:PDN": "PDN.AX", "PDN.AX": "PDN.AX", "PDN-AU": "PDN.AX", "PDN:AU": "PDN.AX",
    "pdn au": "PDN.AX", "PDN  AU": "PDN.AX", "29M.AX": "29M.AX", "PDN CDI": "PDN.AX", "AX:BHP": "BHP.AX",
    "RIO LN": None, "CASH": None, "": None, None: None, "NEM US": None, "TOOLONG": None, "A": None, "AB C": "ABC.AX",
    "BHP.AT": "BHP.AX", ".AU": None, "BHP/AU": None, "PDN": "PDN.AX",
}


def test_ticker_normaliser(spark):
    df = spark.createDataFrame([(k,) for k in TICKERS], "t string")
    got = {r["t"]: r["n"] for r in df.select("t", normalise_asx("t").alias("n")).collect()}
    assert got == TICKERS


def test_constituent_mapping_needs_context(spark):
    cases = [
        ("PDN", None, None), ("PDN", "ASX", "PDN.AX"), ("PDN", "NYSE", None), ("PDN AU", None, "PDN.AX"),
        ("PDN.AX", "NYSE", "PDN.AX"), ("RIO LN", None, None), ("PDN", "Australian Securities Exchange", "PDN.AX"),
        ("ASX:PDN", None, "PDN.AX"),
    ]
    df = spark.createDataFrame(cases, "t string, e string, want string")
    for r in df.select("want", constituent_symbol("t", "e").alias("got")).collect():
        assert r["got"] == r["want"]
    assert df.where(looks_like_asx("t", "e")).count() == 3


def test_vendor_symbol(spark):
    cases = [("BHP.AX", None, "BHP.AX"), ("BHP", "AU000000BHP4", "BHP.AX"), ("BHP", "US1", None), ("TOOLONGX", "AU1", None),
             ("NST.L", "AU1", "NST.AX")]
    df = spark.createDataFrame(cases, "a string, i string, want string")
    for r in df.select("want", vendor_symbol("a", "i").alias("got")).collect():
        assert r["got"] == r["want"]


def test_dates_and_buckets(spark):
    cases = [("2026-06-20", dt.date(2026, 6, 20)), ("20260620", dt.date(2026, 6, 20)), ("20-06-2026", dt.date(2026, 6, 20)),
             ("20 Jun 2026", dt.date(2026, 6, 20)), ("n/a", None), (None, None), ("2026-02-30", None)]
    df = spark.createDataFrame(cases, "t string, want date")
    for r in df.select("want", any_date("t").alias("got")).collect():
        assert r["got"] == r["want"]
    b = bucketise(F.col("x"), [0.0, 1.0, 2.0], ["a", "b"])
    rows = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.1,), (2.0,), (2.1,), (None,)], "x double").select(b).collect()
    assert [r[0] for r in rows] == [None, "a", "a", "b", "b", None, None]
    t = spark.createDataFrame([(None,), (0.0,), (5e6,)], "x double").select(tightness("x")).collect()
    assert [r[0] for r in t] == [0.0, 1.0, 0.5]


def _python_days_before(day: dt.date, n: int) -> dt.date:
    while n > 0:
        day -= dt.timedelta(days=1)
        n -= day.weekday() < 5
    return day


def test_business_days_before_matches_stepping(spark):
    start = dt.date(2024, 2, 20)
    cases = [(start + dt.timedelta(days=i), n) for i in range(21) for n in range(0, 16)]
    df = spark.createDataFrame(cases, "d date, n int")
    for r in df.select("d", "n", dates.business_days_before(F.col("d"), F.col("n")).alias("got")).collect():
        assert r["got"] == _python_days_before(r["d"], r["n"]), (r["d"], r["n"])


def test_month_rules(spark):
    first = F.make_date(F.lit(2026), F.col("id").cast("int"), F.lit(1))
    rows = spark.range(1, 13).select(
        first.alias("f"), dates.third_friday(first).alias("t"), dates.last_business_day(first).alias("l"),
        dates.first_business_day(first).alias("b"),
    ).collect()
    for r in rows:
        days = [r["f"] + dt.timedelta(days=i) for i in range(31)]
        days = [d for d in days if d.month == r["f"].month]
        assert r["t"] == [d for d in days if d.weekday() == 4][2]
        weekdays = [d for d in days if d.weekday() < 5]
        assert (r["l"], r["b"]) == (weekdays[-1], weekdays[0])


# Published next dates as of 2026-06-23: fund -> (effective, days until, watch from).
NEXT_DATES = {
    "URA": ("2026-08-03", 41, "2026-07-27"),
    "LIT": ("2026-08-03", 41, "2026-07-27"),
    "GDXJ": ("2026-09-21", 90, "2026-09-16"),
    "URNJ": ("2026-12-21", 181, "2026-12-15"),
    "COPX": ("2026-11-02", 132, "2026-10-26"),
}


def test_rebalance_calendar(spark):
    rows = {r["etf"]: r for r in calendars.rebalance_calendar(spark, "2026-06-23").collect()}
    assert len(rows) == 11
    for etf, (day, days, watch) in NEXT_DATES.items():
        assert (str(rows[etf]["next_effective"]), rows[etf]["days_until"], str(rows[etf]["watch_pro_forma_from"])) == (
            day, days, watch,
        )


def test_review_calendar(spark):
    rows = calendars.generate_calendar(spark, 2026, 2026).collect()
    assert len(rows) == 12
    sep = {r["family"]: r for r in rows if r["review_label"] == "2026-Q3"}
    assert str(sep["S&P/ASX"]["effective_date"]) == "2026-09-18" and str(sep["S&P/ASX"]["announcement_date_est"]) == "2026-09-04"
    assert str(sep["FTSE Russell"]["announcement_date_est"]) == "2026-09-04"
    soon = calendars.upcoming(spark, "2026-12-01", 30).collect()
    assert {str(r["effective_date"]) for r in soon} == {"2026-12-18"}


# ------------------------------------------------------------------ text
def test_announcement_text(spark):
    docs = spark.createDataFrame(
        [
            (1, "Intro\nDRO will be added to the list effective 20 Jun 2026. Bye DRO"),
            (2, "Deletion of ASX: ABC and XYZ on 2026-07-01"),
            (3, "Nothing here about PDN"),
            (4, "Added value: CSL and CSL again. Added value: CSL"),
        ],
        "doc_id int, text string",
    )
    got = {(r["doc_id"], r["asx_ticker"], r["action"], str(r["announcement_date"]), r["confidence"])
           for r in text.announcement_candidates(docs, "doc_id", "text").collect()}
    assert got == {
        (1, "DRO.AX", "ADD", "2026-06-20", 0.2), (2, "ABC.AX", "DELETE", "2026-07-01", 0.2),
        (2, "XYZ.AX", "DELETE", "2026-07-01", 0.2), (4, "CSL.AX", "ADD", "None", 0.2),
    }


def test_methodology_rules(spark):
    docs = spark.createDataFrame(
        [(1, "Constituents are capped at 8%. The index is rebalanced quarterly."), (2, None), (3, "Liquidity of A$ 2.5 million")],
        "doc_id int, text string",
    )
    rows = {r["doc_id"]: r for r in text.methodology_rules(docs, "doc_id", "text").collect()}
    assert rows[1]["max_weight_rules"] == "capped 8%" and rows[1]["rebalance_frequency"] == "rebalanced quarterly"
    assert rows[1]["liquidity_rules"] is None and rows[2]["chars_extracted"] == 0
    assert rows[3]["liquidity_rules"] == "Liquidity A$ 2.5 million"


def test_page_mentions(spark):
    html = (
        '<p>Tracks the Solid Gold Index daily</p><a href="/f/Holdings_1.CSV">x</a>'
        '<a href="/about.html">y</a><p>the MVIS Gold Benchmark</p><a href="/f/Holdings_1.CSV">z</a>'
    )
    rows = text.page_mentions(spark.createDataFrame([(1, html)], "p int, h string"), "p", "h").collect()
    assert sorted((r["kind"], r["value"]) for r in rows) == [
        ("benchmark", "Tracks the Solid Gold Index"), ("benchmark", "the MVIS Gold Benchmark"),
        ("holdings_link", "/f/Holdings_1.CSV"),
    ]


def test_page_mentions_equal_the_plain_pattern(spark):
    """Searching only the stretches finds exactly what the pattern finds in the page."""
    pages = [
        "a index", "The Index of INDEX things & benchmark. Index!", "x" * 80 + " Index " + "y" * 10 + " indices",
        "Über Größe Index|Gold_Index/Silver.Benchmark", "ab Index cd Benchmark ef<Index>gh Indices", "",
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "p int, h string")
    plain = df.select("p", F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all("h", F.lit(text.BENCHMARK_NAME), F.lit(1)), F.trim))).alias("value"))
    got = text.page_mentions(df, "p", "h").where("kind = 'benchmark'").select("p", "value")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


# ------------------------------------------------------------------ screens
def test_size_rule(spark):
    watch = spark.createDataFrame([("a.ax",), ("B.AX",), ("C.AX",), ("D.AX",)], "asx_ticker string")
    prof = spark.createDataFrame(
        [("A.AX", "A", 100e6), ("B.AX", "B", 9869e6), ("C.AX", "C", 3594e6), ("D.AX", "D", None)],
        "symbol string, company_name string, market_cap double",
    )
    held = spark.createDataFrame([("C.AX",)], "asx_ticker string")
    got = {r["asx_ticker"]: (r["already_held"], r["fits_size_rule"], r["candidate"])
           for r in screens.size_rule_candidates(watch, prof, held).collect()}
    assert got == {"A.AX": (False, True, True), "B.AX": (False, False, False), "C.AX": (True, True, False)}


def test_ownership_map_golden_formula(spark):
    """Shares over shares outstanding and over a fifth of daily shares."""
    from conftest import make_bars

    edges = spark.createDataFrame(
        [("URNJ", "BKY.AX", None, "Berkeley", 1.0, 12289834.0, 4741381.78), ("URNM", "USD.AX", None, "Cash", 1.0, 1.0, 1.0),
         ("URNM", "URNJ.AX", None, "Fund in fund", 1.0, 1.0, 1.0)],
        "etf string, asset string, isin string, name string, weight_pct double, shares double, market_value double",
    )
    funds = spark.createDataFrame([("URNJ", "u", 1e9), ("URNM", "n", None), ("URNJ.AX", "l", None)], "etf string, etf_name string, aum double")
    bars = make_bars(spark, [0.55] * 70, symbol="BKY.AX", volume=100211.41269841269)
    prof = spark.createDataFrame([("BKY.AX", 446293143.6363636 * 0.55, 0.55)], "symbol string, market_cap double, price double")
    row = screens.forced_ownership_map(edges, funds, bars, prof).where("asx_ticker = 'BKY.AX'").first()
    assert row["etf_pct_of_shares_out"] == pytest.approx(0.027537581912783465)
    assert row["days_to_exit_at_100pct_adv"] == pytest.approx(122.63906544244003)
    assert row["days_to_exit_at_20pct_adv"] == pytest.approx(613.1953272122001)
    kept = screens.universal_ownership_map(edges, funds, bars, prof).collect()
    assert [r["asx_ticker"] for r in kept] == ["BKY.AX"]
    assert kept[0]["inflow5_usd"] == pytest.approx(0.01 * 1e9 * 0.05)


def test_fund_list_keeps_the_first_names_before_the_shuffle(spark):
    rows = [(f"F{k % 40:02d}", f"S{k % 3}.AX", "n", 1.0, 2.0, 3.0) for k in range(400)] + [("A", "S9.AX", "n", 1.0, 2.0, 3.0)]
    edges = spark.createDataFrame(rows, "etf string, asx_ticker string, name string, shares double, market_value double, inflow5_usd double")
    out = screens.ownership(edges.repartition(5), 12)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    whole = {r["asx_ticker"]: r for r in screens.ownership(edges).collect()}
    for r in out.collect():
        full = whole[r["asx_ticker"]]
        assert r["etfs"] == full["etfs"][:12] and r["n_etfs"] == full["n_etfs"] == len(full["etfs"])
        assert r["etf_value_usd"] == full["etf_value_usd"]


def test_rebounds_read_nothing_after_the_day(spark):
    from conftest import business_days, make_bars

    days = business_days("2023-01-02", 60)
    bars = make_bars(spark, [1.0 + 0.01 * i for i in range(60)], symbol="X")
    ch = spark.createDataFrame([("I", "US", "DEL", "X", days[30]), ("I", "US", "DEL", "X", days[2])],
                               "index_name string, market string, action string, ticker string, effective_date date")
    rows = screens.deletion_rebounds(ch, bars, str(days[36])).collect()
    assert len(rows) == 1
    assert (rows[0]["bars_since_effective"], rows[0]["days_left_in_window"], rows[0]["live"]) == (6, 4, True)
    assert rows[0]["ret_since_effective_pct"] == pytest.approx(round(100 * (1.36 / 1.30 - 1), 2))


# ------------------------------------------------------------------ membership studies
def test_caar_path_of_a_single_jump(spark):
    from conftest import business_days, make_bars

    closes = [10.0] * 50 + [11.0] * 50
    days = business_days("2023-01-02", 100)
    bars = make_bars(spark, closes, symbol="X").unionByName(make_bars(spark, closes[:60], symbol="SHORT"))
    bench = spark.createDataFrame([(d, 5.0) for d in days], "date date, close double")
    ch = spark.createDataFrame(
        [("ADD", "X", days[50]), ("ADD", "X", days[50]), ("ADD", "SHORT", days[55]), ("DEL", "X", days[10])],
        "action string, ticker string, effective_date date",
    )
    rows = {(r["action"], r["day_rel_effective"]): r for r in membership.caar_path(ch, bars, bench).collect()}
    assert {a for a, _ in rows} == {"ADD"} and len(rows) == 41
    assert rows[("ADD", -1)]["caar_pct"] == pytest.approx(0.0) and rows[("ADD", 0)]["caar_pct"] == pytest.approx(10.0)
    assert rows[("ADD", 20)]["caar_pct"] == pytest.approx(10.0) and rows[("ADD", 0)]["n_events"] == 2


def test_membership_legs(spark):
    from conftest import business_days, make_bars

    closes = [10.0 * 1.01**i for i in range(60)]
    days = business_days("2023-01-02", 60)
    bars = make_bars(spark, closes, symbol="X")
    bench = spark.createDataFrame([("US", d, 5.0 * 1.002**i) for i, d in enumerate(days)], "market string, date date, close double")
    ch = spark.createDataFrame(
        [("I", "US", "ADD", "X", days[40]), ("I", "US", "DEL", "X", days[45]), ("I", "US", "ADD", "X", days[2]), ("I", "US", "ADD", "NONE", days[40])],
        "index_name string, market string, action string, ticker string, effective_date date",
    )
    rows = membership.membership_legs(ch, bars, bench).collect()
    by = {(r["strategy"], r["exit_date"]): r for r in rows}
    assert by[("S1_ADD_runup_T-5", days[40])]["gross_return"] == pytest.approx(1.01**5 - 1)
    assert by[("S1x_ADD_excess_T-5", days[40])]["gross_return"] == pytest.approx(1.01**5 - 1.002**5)
    assert by[("S1_ADD_runup_T-5", days[40])]["net_return"] == pytest.approx(1.01**5 - 1 - 0.001)
    assert by[("S3_DEL_short_eff_+10", days[45])]["gross_return"] == pytest.approx(-(1.01**10 - 1))
    assert by[("S4_DEL_long_eff_+10", days[45])]["harsh_net_return"] == pytest.approx(1.01**10 - 1 - 0.003)
    assert ("S1_ADD_runup_T-5", days[2]) not in by and ("S1_ADD_runup_T-1", days[2]) in by
    first_adv = 1e6 * closes[0]
    assert by[("S1_ADD_runup_T-1", days[2])]["adv_dollars"] == pytest.approx(first_adv)
    assert all(r["asx_ticker"] == "X" for r in rows)
