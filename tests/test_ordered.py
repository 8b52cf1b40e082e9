from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import diagnostics, ordered, resample


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    n = 2000
    value = rng.normal(0, 0.05, n).round(4)
    value[rng.random(n) < 0.33] = 0.0125  # a third of all rows share one value
    return pd.DataFrame(
        {
            "id": [f"{i:04d}" for i in rng.permutation(n)],
            "g": rng.choice(["a", "b", None], n, p=[0.7, 0.2, 0.1]),
            "v": np.where(rng.random(n) < 0.05, np.nan, value),
            "w": rng.lognormal(3, 4, n),
            "d": pd.to_datetime("2020-01-01") + pd.to_timedelta(rng.integers(0, 40, n), unit="D"),
        }
    )


@pytest.fixture(scope="module")
def frame(spark, sample):
    df = spark.createDataFrame(sample.assign(d=sample.d.dt.date))
    from tidemark.functions.scalars import clean

    return df.withColumn("v", clean("v")).repartition(7)


def test_quantiles_match_numpy(frame, sample):
    probs = (0.025, 0.3, 0.5, 0.975)
    got = {
        (r["g"], r["measure"], r["prob"]): r["quantile"]
        for r in ordered.grouped_quantiles(frame, ["g"], ["v", "w"], probs).collect()
    }
    for g, part in sample.groupby("g", dropna=False):
        key = None if pd.isna(g) else g
        for c in ("v", "w"):
            for p in probs:
                assert got[(key, c, p)] == pytest.approx(part[c].quantile(p), rel=1e-12, abs=1e-15)


def test_quantile_of_one_and_two_values(spark):
    df = spark.createDataFrame([("x", 3.0), ("y", 1.0), ("y", -2.0)], "g string, v double")
    got = {r["g"]: r["m"] for r in ordered.grouped_medians(df, ["g"], {"v": "m"}).collect()}
    assert got == {"x": 3.0, "y": -0.5}


def test_percentile_ranks_match_pandas(frame, sample):
    got = {(r["id"], r["measure"]): r["pct_rank"] for r in ordered.percentile_ranks(frame, "id", ["v", "w"]).collect()}
    for c in ("v", "w"):
        expected = sample.set_index("id")[c].rank(pct=True).dropna()
        for i, p in expected.items():
            assert got[(i, c)] == pytest.approx(p)
    assert len(got) == sample[["v", "w"]].notna().sum().sum()


def test_mean_rank_skips_missing(frame, sample):
    got = {r["id"]: r["score"] for r in ordered.mean_rank(frame, "id", ["v", "w"], "score").collect()}
    expected = sample.set_index("id")[["v", "w"]].rank(pct=True).mean(axis=1)
    for i, p in expected.items():
        assert got[i] == pytest.approx(p)


def test_drawdown_matches_sequential_compounding(frame, sample):
    got = {r["g"]: r["max_drawdown"] for r in ordered.max_drawdown(frame, ["g"], "v", "d", "id").collect()}
    for g, part in sample.dropna(subset=["v"]).sort_values(["d", "id"]).groupby("g", dropna=False):
        equity = (1 + part.v).cumprod()
        assert got[None if pd.isna(g) else g] == pytest.approx((equity / equity.cummax() - 1).min())


def test_a_total_loss_and_a_long_curve_have_a_drawdown(spark):
    rows = [("ruin", k, f"r{k}", r) for k, r in enumerate((0.1, -1.2, -1.5, 0.3))]
    rows += [("long", k, f"l{k:05d}", 3.0 if k != 1500 else -0.5) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, n int, id string, v double").withColumn("d", F.date_add(F.lit("2024-01-01"), F.col("n")))
    got = {r["g"]: r["max_drawdown"] for r in ordered.max_drawdown(df, ["g"], "v", "d", "id").collect()}
    assert got == {"ruin": -1.0, "long": pytest.approx(-0.5)}


def test_positions_are_the_sorted_order(frame, sample):
    rows = ordered.ordered_positions(frame, ["g"], "d", "id").collect()
    got = {r["id"]: (r["pos"], r["n_seq"]) for r in rows}
    for _, part in sample.sort_values(["d", "id"]).groupby("g", dropna=False):
        for pos, i in enumerate(part.id):
            assert got[i] == (pos, len(part))


def test_results_do_not_depend_on_partitioning(spark, frame):
    def run():
        q = ordered.grouped_quantiles(frame, ["g"], ["v"]).collect()
        d = ordered.max_drawdown(frame, ["g"], "v", "d", "id").collect()
        return sorted(map(str, q)), sorted(map(str, d))

    before = run()
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        assert run() == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_bucket_keeps_the_order(spark):
    rng = random.Random(1)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 12) for _ in range(500)] + [0.0, -0.0, 1.0, -1.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", ordered.magnitude_bucket("v").alias("b")).collect()
    rows.sort(key=lambda r: r["v"])
    assert all(x["b"] <= y["b"] for x, y in zip(rows, rows[1:]))


def _ledger(spark, returns, strategy="S"):
    import datetime as dt

    rows = [
        (strategy, f"{i:05x}", dt.date(2020, 1, 1) + dt.timedelta(days=i % 50), float(r), float(r) - 0.001, False, 5,
         float(r) * 1e5, 0.05, False, float(r) + 0.01)
        for i, r in enumerate(returns)
    ]
    return spark.createDataFrame(
        rows,
        "strategy string, event_id string, exit_date date, net_return double, harsh_net_return double, rejected boolean, "
        "exposure_days int, pnl_net double, participation double, capped boolean, gross_return double",
    )


@pytest.mark.parametrize("n", [12, 150, 900])
def test_bootstrap_interval_is_close_to_the_plain_one(spark, n):
    returns = np.random.default_rng(n).normal(0.01, 0.05, n)
    got = diagnostics.bootstrap_ci(_ledger(spark, returns), ["strategy"]).first()
    rng = np.random.default_rng(7)
    means = [rng.choice(returns, n).mean() for _ in range(2000)]
    low, high = np.percentile(means, [2.5, 97.5])
    width = high - low
    assert abs(got["ci_low"] - low) < 0.15 * width and abs(got["ci_high"] - high) < 0.15 * width


def test_bootstrap_needs_three_trades(spark):
    assert diagnostics.bootstrap_ci(_ledger(spark, [0.1, 0.2]), ["strategy"]).count() == 0


def test_metrics_against_pandas(spark):
    returns = np.random.default_rng(9).normal(0.01, 0.05, 301)
    m = diagnostics.compute_metrics(_ledger(spark, returns)).first()
    r = pd.Series(returns)
    assert m["n_trades"] == 301
    assert m["avg_return"] == pytest.approx(r.mean()) and m["median_return"] == pytest.approx(r.median())
    assert m["hit_rate"] == pytest.approx((r > 0).mean())
    assert m["payoff_ratio"] == pytest.approx(r[r > 0].mean() / abs(r[r < 0].mean()))
    assert m["total_pnl_net"] == pytest.approx(r.sum() * 1e5)


def test_claims_gate(spark):
    good = diagnostics.claims_gate(_ledger(spark, [0.02 + 0.001 * (i % 5) for i in range(40)])).first()
    assert good["claim_alpha"] is True and good["oos_positive"] is True
    bad = diagnostics.claims_gate(_ledger(spark, [-0.01] * 40)).first()
    assert bad["claim_alpha"] is False and bad["survives_costs"] is False
    one = diagnostics.claims_gate(_ledger(spark, [0.5] + [0.001] * 20)).first()
    assert one["no_single_trade_dominates"] is False and one["claim_alpha"] is False
    few = diagnostics.claims_gate(_ledger(spark, [0.01, 0.02, 0.01])).first()
    assert few["enough_events"] is False and few["oos_positive"] is None


@pytest.mark.parametrize("limit", [1, 7, 60])
def test_quantiles_narrow_large_ranges(spark, monkeypatch, limit):
    monkeypatch.setattr(ordered, "MAX_RANGE", limit)
    monkeypatch.setattr(ordered, "CELLS", 4)
    rng = np.random.default_rng(3)
    # crowded around one value, ties, both signs, an outlier
    values = np.concatenate([100 + rng.normal(0, 1e-3, 400), np.full(50, 100.0), -rng.random(30), [1e12, 0.0, 100.00000001]])
    df = spark.createDataFrame([("a" if i % 3 else None, float(v)) for i, v in enumerate(values)], "g string, v double")
    probs = (0.0, 0.1, 0.5, 0.77, 1.0)
    got = {(r["g"], r["prob"]): r["quantile"] for r in ordered.grouped_quantiles(df, ["g"], ["v"], probs).collect()}
    frame = df.toPandas()
    for g in ("a", None):
        mine = frame[frame.g.isna() if g is None else frame.g == g].v
        for p in probs:
            assert got[g, p] == pytest.approx(mine.quantile(p), rel=1e-12)


def test_only_values_of_wanted_ranges_are_shuffled(spark, tmp_path):
    path = str(tmp_path / "values")
    spark.range(200_000).select((F.col("id") % 3).alias("g"), F.exp(F.rand(5) * 20).alias("v")).write.parquet(path)
    df = spark.read.parquet(path)
    out = ordered.grouped_quantiles(df, ["g"], ["v"])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan()

    def shuffled(node) -> list[int]:
        found = []
        if node.nodeName() == "AdaptiveSparkPlan":
            return shuffled(node.executedPlan())
        if "QueryStage" in node.nodeName():
            return shuffled(node.plan())
        if node.nodeName() == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        for i in range(children.size()):
            found += shuffled(children.apply(i))
        return found

    # three buckets of some 5,100 hold the medians
    assert shuffled(plan) and max(shuffled(plan)) < 1000


@pytest.mark.parametrize("bits,fan_in", [(1, 2), (3, 4), (16, 1024)])
def test_drawdown_and_positions_of_any_segments(spark, monkeypatch, bits, fan_in):
    monkeypatch.setattr(ordered, "SEGMENT_BITS", bits)
    monkeypatch.setattr(ordered, "FAN_IN", fan_in)
    rng = np.random.default_rng(4)
    rows = [(["a", None, "b"][i % 7 % 3], dt.date(2024, 1, 1) + dt.timedelta(days=int(rng.integers(0, 20))), f"e{i:04d}", float(rng.normal(0.001, 0.05))) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, d date, id string, v double").repartition(5)
    got = {r["g"]: r["max_drawdown"] for r in ordered.max_drawdown(df, ["g"], "v", "d", "id").collect()}
    places = {(r["g"], r["id"]): (r["pos"], r["n_seq"]) for r in ordered.ordered_positions(df, ["g"], "d", "id").collect()}
    for g in ("a", None, "b"):
        mine = sorted((d, i, v) for h, d, i, v in rows if h == g)
        curve = np.cumprod([1 + v for _, _, v in mine])
        assert got[g] == pytest.approx((curve / np.maximum.accumulate(curve) - 1).min(), abs=1e-12)
        assert [places[g, i] for _, i, _ in mine] == [(k, len(mine)) for k in range(len(mine))]


@pytest.mark.parametrize("k", [1, 2, 40, 1000])
def test_a_value_that_occurs_k_times_draws_poisson_k(k):
    drawn = resample.weights(np.arange(400) * 7_654_321, np.full(400, k), 2000, 7)
    assert drawn.mean() == pytest.approx(k, rel=0.01)
    assert drawn.var() == pytest.approx(k, rel=0.03)
    assert np.corrcoef(drawn[:50])[np.triu_indices(50, 1)].__abs__().max() < 0.12


def test_bootstrap_rows_are_not_multiplied(spark):
    rows = [("a" if i % 2 else None, float(v)) for i, v in enumerate(np.random.default_rng(2).normal(0, 1, 60).round(1))] + [("a", None), ("b", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    means = resample.bootstrap_means(df, ["g"], "v", 50, 7, 3)
    assert "explode(sequence" not in means._jdf.queryExecution().toString().lower()
    got = {(r["g"], r["replicate"]): r["boot_mean"] for r in means.collect()}
    assert len(got) == 100
    for g in ("a", None):
        values, counts = np.unique([v for h, v in rows if h == g and v is not None], return_counts=True)
        drawn = resample.weights(np.floor(values * 1e9 + 0.5).astype(np.int64), counts, 50, 7)
        expected = (values @ drawn) / drawn.sum(axis=0)
        assert [got[g, r] for r in range(50)] == pytest.approx(expected.tolist())
