from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import business_days, make_bars
from pyspark.sql import functions as F

from tidemark.operators import asof, bars as bar_ops, flow

DAY0 = dt.date(2023, 1, 2)


@pytest.fixture(scope="module")
def facts(spark):
    rng = random.Random(5)
    rows = set()
    for key in ("A", "B", "C"):
        for _ in range(40):
            rows.add((key, DAY0 + dt.timedelta(days=rng.randrange(120))))
    rows = [(k, d, i) for i, (k, d) in enumerate(sorted(rows))]
    points = [(i, rng.choice("ABCD"), DAY0 + dt.timedelta(days=rng.randrange(-10, 140))) for i in range(300)]
    # One key and day owns a third of all points.
    points += [(300 + i, "A", DAY0 + dt.timedelta(days=50)) for i in range(150)]
    points.append((999, "A", None))
    left = spark.createDataFrame(points, "id int, key string, t date")
    right = spark.createDataFrame(rows, "key string, d date, v int")
    return left, right, points, rows


def brute(points, rows, forward, strict):
    out = {}
    for i, k, t in points:
        best = None
        for rk, d, v in rows:
            if rk != k or t is None:
                continue
            ok = (d > t if strict else d >= t) if forward else (d < t if strict else d <= t)
            if ok and (best is None or (d < best[0] if forward else d > best[0])):
                best = (d, v)
        out[i] = None if best is None else best[1]
    return out


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("sliced", [False, True])
def test_matches_brute_force(facts, forward, strict, sliced):
    left, right, points, rows = facts
    slot = F.trunc("__ts", "month") if sliced else None
    out = asof.asof_join(left, right, "key", "t", "d", ["v"], forward=forward, strict=strict, slot=slot)
    got = {r["id"]: r["v"] for r in out.collect()}
    assert got == brute(points, rows, forward, strict)


def test_unknown_key_and_null_date_stay_null(facts):
    left, right, points, _ = facts
    out = asof.asof_join(left, right, "key", "t", "d", ["v"])
    assert out.count() == len(points)
    assert out.where((F.col("key") == "D") & F.col("v").isNotNull()).count() == 0
    assert out.where(F.col("t").isNull() & F.col("v").isNotNull()).count() == 0


def test_shift_and_return_between(spark):
    bars = make_bars(spark, [1.001**i for i in range(120)])
    days = business_days("2023-01-02", 120)
    left = spark.createDataFrame([("PDN.AX", days[40], days[60])], "symbol string, a date, b date")
    row = asof.return_between(left, bars, "symbol", "a", "b", "ret").first()
    assert row["ret"] == pytest.approx(1.001**20 - 1)
    positioned = bar_ops.with_positions(bars)
    moved = asof.shift_bars(left, positioned, "symbol", "a", F.lit(-3), {"date": "m"}).first()
    assert moved["m"] == days[37]
    out_of_range = asof.shift_bars(left, positioned, "symbol", "b", F.lit(100), {"date": "m"}).first()
    assert out_of_range["m"] is None


@pytest.mark.parametrize("cut", [30, 64, 90, 119])
def test_trailing_columns_ignore_the_future(spark, cut):
    """Cutting later bars changes no value on or before the cut."""
    rng = random.Random(cut)
    closes = [10.0]
    for _ in range(149):
        closes.append(closes[-1] * (1 + rng.uniform(-0.03, 0.03)))
    bars = make_bars(spark, closes)
    last = business_days("2023-01-02", 150)[cut]
    columns = ["date", "bar_no", "adv_dollars", "adv_shares", "spread_proxy_bps", "volatility", "volume_shock",
               *bar_ops.MOMENTUM_BARS]
    full = bar_ops.with_trailing(bars).where(F.col("date") <= F.lit(last)).select(columns)
    short = bar_ops.with_trailing(bar_ops.truncate_bars(bars, str(last))).select(columns)
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, short.collect()))


def test_trailing_values(spark):
    closes = [1.0 + 0.01 * i for i in range(100)]
    bars = make_bars(spark, closes)
    rows = {r["bar_no"]: r for r in bar_ops.with_trailing(bars).collect()}
    tail = [c * 1e6 for c in closes[100 - 63:]]
    assert rows[100]["adv_dollars"] == pytest.approx(sum(tail) / 63)
    assert rows[100]["mom_1m"] == pytest.approx(closes[99] / closes[78] - 1)
    assert rows[4]["volatility"] is None and rows[5]["volatility"] is not None
    assert rows[4]["volume_shock"] is None and rows[5]["volume_shock"] == pytest.approx(1.0)
    assert rows[21]["mom_1m"] is None and rows[22]["mom_1m"] is not None


def test_entry_adv_is_the_next_bars_adv(spark):
    bars = make_bars(spark, [1.0 + 0.01 * i for i in range(80)])
    rows = {r["bar_no"]: r for r in flow.study_bars(bars).collect()}
    for n in (1, 40, 62, 63, 64, 79):
        assert rows[n]["entry_adv_dollars"] == pytest.approx(rows[n + 1]["adv_dollars"])
    assert rows[80]["entry_adv_dollars"] is None
