"""Index membership studies: legs, abnormal-return path, review windows (BT6, BT7, RS6-RS8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import first_friday
from ..functions.scalars import nonzero, simple_return, stable_id
from ..schemas import LEDGER_COLUMNS
from ..session import durable
from .asof import asof_join
from .bars import at, by_symbol, traded_value, with_positions

CAPITAL = 100_000.0
LAGS = (5, 3, 1)
DRIFT = 10
# Flat round-trip cost in basis points per market, base and stressed.
COST_RT_BPS = {"US": 10.0, "ASX": 40.0}
COST_RT_BPS_HARSH = {"US": 30.0, "ASX": 100.0}


def collect_changes(changes: DataFrame, cutoff: str = "2005-01-01", details: bool = False) -> DataFrame:
    """BT7, ST3, FL9: dated additions and deletions, each once.

    ``details`` adds the security's name and the reason; of several the smallest is kept.
    """
    keys = ["index_name", "market", "action", "ticker", "effective_date"]
    dated = changes.where(
        (F.col("effective_date") >= F.lit(cutoff).cast("date")) & (F.coalesce("ticker", F.lit("")) != "")
    )
    if not details:
        return dated.select(*keys).distinct()
    return dated.groupBy(*keys).agg(F.min("security").alias("security"), F.min("reason").alias("reason"))


def _market_cost(costs: dict[str, float]):
    out = F.lit(None).cast("double")
    for market, bps in costs.items():
        out = F.when(F.col("market") == market, F.lit(bps / 1e4)).otherwise(out)
    return out


def benchmark_calendar(benchmark: DataFrame, bars: DataFrame) -> DataFrame:
    """JN6: benchmark close on/before every trading day of any stock, per market.

    One row per market and calendar day, whatever the number of events.
    """
    days = bars.select("date").distinct()
    markets = benchmark.select("market").distinct()
    # A market has as many points as there are days; both tables are calendar-sized.
    points = (
        benchmark.select("market", "date")
        .unionByName(
            days.select(
                F.explode(F.array(*[F.lit(m) for m in COST_RT_BPS])).alias("market"), "date"
            ).join(markets, "market", "left_semi")
        )
        .distinct()
    )
    return asof_join(points, benchmark, "market", "date", "date", {"close": "bench_close"})


def membership_legs(changes: DataFrame, bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """BT6: ledger of run-up, market-excess, post-drift and deletion legs at flat costs.

    Liquidity is read six bars before the effective bar, so the event does not colour it.
    """
    before = by_symbol().rowsBetween(-(63 + 5), -6)
    first = F.first(traded_value()).over(by_symbol().rowsBetween(W.unboundedPreceding, 0))
    wide = (
        with_positions(bars)
        .withColumns(
            {
                **{f"close_m{k}": at("close", -k) for k in LAGS},
                **{f"date_m{k}": at("date", -k) for k in LAGS},
                "close_p10": at("close", DRIFT),
                "adv_before": F.when(F.col("bar_no") > 6, F.avg(traded_value()).over(before)).otherwise(
                    first
                ),
            }
        )
        .withColumnRenamed("symbol", "ticker")
        .withColumn("eff_date", F.col("date"))
    )
    payload = [
        "eff_date", "close", "close_p10", "adv_before", *[f"close_m{k}" for k in LAGS],
        *[f"date_m{k}" for k in LAGS],
    ]
    e = asof_join(changes, wide, "ticker", "effective_date", "date", payload, stored=True).where(
        F.col("close").isNotNull()
    )
    # Two rows a trading day, whatever the number of stocks. Joined before the legs are listed: only
    # some legs have a start, and all rows without one would share one join key.
    calendar = durable(benchmark_calendar(benchmark, bars), "calendar")
    for day, name in (("eff_date", "__b"), *((f"date_m{k}", f"__b{k}") for k in LAGS)):
        side = calendar.select("market", F.col("date").alias(day), F.col("bench_close").alias(name))
        e = e.join(side, ["market", day], "left")

    def leg(name, gross, side, exposure):
        return F.struct(
            F.lit(name).alias("strategy"),
            gross.alias("gross"),
            F.lit(side).alias("direction"),
            F.lit(exposure).alias("exposure"),
        )

    added = F.col("action") == "ADD"
    deleted = F.col("action") == "DEL"
    drift = nonzero("close_p10") / nonzero("close") - 1.0
    legs = []
    for k in LAGS:
        run = F.when(added, F.col("close") / nonzero(f"close_m{k}") - 1.0)
        legs.append(leg(f"S1_ADD_runup_T-{k}", run, 1, k))
        legs.append(leg(f"S1x_ADD_excess_T-{k}", run - simple_return(f"__b{k}", "__b"), 1, k))
    legs.append(leg("S2_ADD_postdrift_eff_+10", F.when(added, drift), 1, DRIFT))
    legs.append(leg("S3_DEL_short_eff_+10", F.when(deleted, drift), -1, DRIFT))
    legs.append(leg("S4_DEL_long_eff_+10", F.when(deleted, drift), 1, DRIFT))
    rows = (
        e.withColumn("leg", F.explode(F.array(*legs)))
        .where(F.col("leg.gross").isNotNull())
        .select("*", "leg.*")
    )
    signed = F.col("direction") * F.col("gross")
    net = signed - _market_cost(COST_RT_BPS)
    out = rows.select(
        "strategy",
        stable_id("strategy", "ticker", "effective_date").alias("event_id"),
        F.col("ticker").alias("asx_ticker"),
        "direction",
        F.lit(None).cast("date").alias("entry_date"),
        F.lit(None).cast("double").alias("entry_price"),
        F.col("effective_date").alias("exit_date"),
        F.lit(None).cast("double").alias("exit_price"),
        signed.alias("gross_return"),
        F.col("adv_before").alias("adv_dollars"),
        F.lit(0.0).alias("participation"),
        F.lit(False).alias("capped"),
        F.lit(None).cast("double").alias("executable_value"),
        F.lit(None).cast("double").alias("cost_bps_roundtrip"),
        net.alias("net_return"),
        (signed - _market_cost(COST_RT_BPS_HARSH)).alias("harsh_net_return"),
        F.col("exposure").cast("long").alias("exposure_days"),
        F.lit(CAPITAL).alias("capital"),
        (net * CAPITAL).alias("pnl_net"),
        F.lit(False).alias("rejected"),
        F.lit("").alias("reject_reason"),
        F.year("effective_date").alias("year"),
        F.col("index_name").alias("theme"),
        F.col("market").alias("provider"),
        F.lit(None).cast("double").alias("market_cap"),
    )
    return out.select(*LEDGER_COLUMNS)


def caar_path(
    changes: DataFrame,
    bars: DataFrame,
    benchmark: DataFrame,
    pre: int = 20,
    post: int = 20,
    strict_benchmark: bool = False,
) -> DataFrame:
    """RS6, AG18, WN10: cumulative average abnormal return around the effective bar.

    Only events with the whole window count. ``benchmark`` is one (date, close) series; a
    day it lacks takes the last value inside the event's window. The first day has no
    benchmark return and stays raw unless ``strict_benchmark`` drops it.
    """
    width = pre + post + 1
    positioned = with_positions(bars)
    dated = asof_join(changes, positioned.withColumnRenamed("symbol", "ticker"), "ticker", "effective_date", "date", ["bar_no", "n_bars"])
    # Events that share stock and bar have the same path: price it once, weight it.
    windows = (
        dated.where((F.col("bar_no") > pre + 1) & (F.col("bar_no") + post <= F.col("n_bars")))
        .groupBy("action", "ticker", "bar_no")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    stretches = bar_stretches(positioned, benchmark, pre, post)
    here = (F.col("ticker") == F.col("__t")) & (F.floor(F.col("bar_no") / STRETCH) == F.col("__stretch"))
    begin = (F.col("bar_no") - pre - F.col("__bars")[0]["bar_no"] + 1).cast("int")
    path = windows.join(stretches, here).select("action", "n", F.slice("__bars", begin, F.lit(width)).alias("path"))
    path = path.withColumn("ab", _abnormal(F.col("path"), strict_benchmark))
    # One sum and one weight for each day of the window: the paths are added element by element.
    known = [F.col("ab")[k].isNotNull() for k in range(width)]
    sums = [F.sum(F.col("ab")[k] * F.col("n")).alias(f"s{k}") for k in range(width)]
    weights = [F.sum(F.when(known[k], F.col("n"))).alias(f"w{k}") for k in range(width)]
    days = F.array(
        *[
            F.struct(
                F.lit(k - pre).alias("day_rel_effective"),
                (F.col(f"s{k}") / nonzero(f"w{k}")).alias("mean_abnormal"),
                F.col(f"w{k}").alias("n_events"),
            )
            for k in range(width)
        ]
    )
    daily = path.groupBy("action").agg(*sums, *weights).select("action", F.explode(days).alias("d")).select("action", "d.*")
    running = W.partitionBy("action").orderBy("day_rel_effective").rowsBetween(W.unboundedPreceding, 0)
    return daily.select(
        "action",
        "day_rel_effective",
        (F.sum(F.coalesce("mean_abnormal", F.lit(0.0))).over(running) * 100.0).alias("caar_pct"),
        "n_events",
    )


# Bars of a stretch, without those it shares with its neighbours.
STRETCH = 256


def bar_stretches(positioned: DataFrame, benchmark: DataFrame, pre: int, post: int) -> DataFrame:
    """Arrays of (bar_no, stock_return, bench) by symbol and stretch of ``STRETCH`` bar numbers.

    A stretch also has the ``pre`` bars before and the ``post`` bars after it, so the window of any
    of its bars is a slice of one row.
    """
    number = F.col("bar_no")
    stretches = F.array_distinct(F.array(*[F.floor(c / STRETCH) for c in (number - post, number, number + pre)]))
    side = benchmark.select(F.col("date").alias("__day"), F.col("close").alias("bench"))
    return (
        positioned.withColumn("stock_return", simple_return(at("close", -1), "close"))
        .join(side, F.col("date") == F.col("__day"), "left")
        .select(F.col("symbol").alias("__t"), F.explode(stretches).alias("__stretch"), F.struct("bar_no", "stock_return", "bench").alias("bar"))
        .groupBy("__t", "__stretch")
        .agg(F.sort_array(F.collect_list("bar")).alias("__bars"))
    )


def _abnormal(path: Column, strict: bool) -> Column:
    """Return of each bar of a path minus the benchmark's, which lacking days carry on."""
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<double>").alias("out"))

    def step(state: Column, bar: Column) -> Column:
        bench = F.coalesce(bar["bench"], state["last"])
        market = simple_return(state["last"], bench)
        value = bar["stock_return"] - (market if strict else F.coalesce(market, F.lit(0.0)))
        return F.struct(bench.alias("last"), F.concat(state["out"], F.array(value)).alias("out"))

    return F.aggregate(path, start, step, lambda s: s["out"])


def review_windows(changes: DataFrame, bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """RS7: returns before, into and after a review, raw and minus one benchmark series."""
    wide = (
        with_positions(bars)
        .withColumns(
            {
                **{f"c_m{k}": at("close", -k) for k in (15, 5)},
                **{f"c_p{k}": at("close", k) for k in (5, 10)},
                "d_m5": at("date", -5),
                "d_p10": at("date", 10),
                "d_0": F.col("date"),
            }
        )
        .withColumnRenamed("symbol", "ticker")
    )
    payload = ["bar_no", "n_bars", "close", "c_m15", "c_m5", "c_p5", "c_p10", "d_m5", "d_0", "d_p10"]
    e = asof_join(changes, wide, "ticker", "effective_date", "date", payload).where(
        (F.col("bar_no") >= 17) & (F.col("bar_no") + 10 <= F.col("n_bars"))
    )
    one = benchmark.select(F.lit("ASX").alias("market"), "date", "close")
    calendar = benchmark_calendar(one, bars).select("date", "bench_close")

    def bench(df: DataFrame, day: str, name: str) -> DataFrame:
        side = calendar.select(F.col("date").alias(day), F.col("bench_close").alias(name))
        return df.join(side, day, "left")

    for day, name in (("d_m5", "b_m5"), ("d_0", "b_0"), ("d_p10", "b_p10")):
        e = bench(e, day, name)

    def market(a: str, b: str):
        return F.coalesce(simple_return(a, b), F.lit(0.0))

    front = simple_return("c_m5", "close")
    later = simple_return("close", "c_p10")
    return e.select(
        "ticker",
        "index_name",
        "action",
        "effective_date",
        simple_return("c_m15", "c_m5").alias("pre_announcement"),
        front.alias("front_run"),
        (front - market("b_m5", "b_0")).alias("abnormal_front_run"),
        simple_return("close", "c_p5").alias("after_5"),
        later.alias("after_10"),
        (later - market("b_0", "b_p10")).alias("abnormal_after_10"),
    )


def inclusion_events(changes: DataFrame, source: str = "membership") -> DataFrame:
    """RS8: official additions with the announcement put on the month's first Friday."""
    announced = first_friday(F.trunc("effective_date", "month"))
    return changes.where(F.col("action") == "ADD").select(
        stable_id(F.lit(source), "index_name", "ticker", "effective_date").alias("event_id"),
        F.lit("announcement").alias("source_type"),
        F.col("index_name").alias("provider"),
        F.col("index_name").alias("etf_index_name"),
        F.col("ticker").alias("asx_ticker"),
        F.lit("OFFICIAL_INDEX_ADD").alias("event_type"),
        announced.alias("announcement_date"),
        announced.alias("detected_date"),
        "effective_date",
        F.lit(0.95).alias("confidence_score"),
    )
