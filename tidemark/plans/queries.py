"""Registered queries: every operator over the star-schema tables of one folder.

Stages are written once per session and folder and shared by the queries behind them, as
the daily routine stores its bars, snapshots, events and ledger.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.costs import CostModel
from ..functions.scalars import any_date, nonzero, safe_div, simple_return, stable_id, tightness
from ..functions.tickers import constituent_symbol, looks_like_asx, normalise_asx
from ..operators import (
    asof,
    backtest,
    bars as bar_ops,
    calendars,
    diagnostics,
    events as event_ops,
    features as feature_ops,
    flow,
    learning,
    membership,
    ordered,
    registry as registry_ops,
    screens,
    snapshots,
    strategies as strat,
    sweep,
)
from ..session import durable, durable_by, joins_in_place, scratch_path, spread, tune
from ..sources import tables
from ..sources.adapters import StarSchema
from ..streaming import jobs
from . import landed, pipeline

Query = Callable[[SparkSession, str], DataFrame]
# Written stages by (application, folder, name), with the version of the folder they are made of.
_STAGES: dict[tuple[str, str, str], tuple[int, DataFrame]] = {}

# The day the forward-looking screens are run, inside the data's range.
AS_OF = "2000-06-30"
TRADED = [
    "DelayedAnnouncementReaction",
    "HighFlowLowLiquidity",
    "HoldingsDiffSignal",
    "RebalanceCalendarTrade",
    "MultiETFStackedFlow",
    "ForgottenSmallCapAdd",
]


# Event columns that neither a lookup nor a measure reads: only the stored events have them.
NOT_MEASURED = ["notes", "source_url_or_file", "old_weight", "company_name", "etf_index_name", "benchmark", "issuer"]


class Lab(StarSchema):
    """Domain tables plus the written pipeline stages."""

    @cached_property
    def _files(self) -> tuple[int, int]:
        """A hash of the folder's files, their sizes and times, and their bytes: no file is opened for it."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
        seen = files.load(self.path).select(F.xxhash64("path", "length", "modificationTime").alias("h"), "length")
        row = seen.agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("v"), F.sum("length").alias("n")).first()
        return int(row["v"] or 0), int(row["n"] or 0)

    @property
    def version(self) -> int:
        return self._files[0]

    @property
    def input_bytes(self) -> int:
        return self._files[1]

    def _once(
        self, name: str, build: Callable[[], object], write: Callable[[object, str], DataFrame] = durable
    ) -> DataFrame:
        """A stage, written again when the folder's files have changed."""
        key = (self.spark.sparkContext.applicationId, self.path, name)
        if key not in _STAGES or _STAGES[key][0] != self.version:
            _STAGES[key] = (self.version, write(build(), name))
        return _STAGES[key][1]

    @cached_property
    def parts(self) -> int:
        """Buckets of all stages by stock."""
        return spread(self.spark, self.input_bytes)

    def _by_stock(self, name: str, build: Callable[[], DataFrame], key: str = "asx_ticker") -> DataFrame:
        """A stage in buckets by stock: windows and lookups by stock find its rows in place."""
        return self._once(name, build, lambda df, name: durable_by(df, name, key, self.parts))

    def bars(self) -> DataFrame:
        # ticks move by stock, and so do not move again as bars; what follows from other columns is not stored
        stored = self._by_stock("bars", lambda: bar_ops.to_store(self.bars_of(self.ticks().repartition(self.parts, "symbol"))), "symbol")
        return bar_ops.from_store(stored)

    def lazy_bars(self) -> DataFrame:
        return super().bars()

    def packed_bars(self) -> DataFrame:
        return self._once("packed-bars", lambda: asof.pack(self.bars(), "symbol", "date", ["date", "close"]))

    def holdings(self) -> DataFrame:
        return self.dealt_holdings().drop(snapshots.DEALT)

    def dealt_holdings(self) -> DataFrame:
        """Lines move by stock; a fund's total, and not its lines, moves by fund."""
        return self._by_stock(
            "holdings", lambda: self.holdings_of(self.lines_by_stock(self.parts), durable(self.fund_values(), "fund-values")), snapshots.DEALT
        )

    def snapshot_dates(self) -> DataFrame:
        return self._once("snapshot-dates", lambda: snapshots.snapshot_dates(self.holdings()))

    def lazy_holdings(self) -> DataFrame:
        return super().holdings()

    def _event_sources(self) -> list[DataFrame]:
        return [self.holdings(), self.registry(), self.announcements(), self.custom_events()]

    def lazy_events(self) -> DataFrame:
        return event_ops.build_events(*self._event_sources())

    def events(self) -> DataFrame:
        def write(df: DataFrame, name: str) -> DataFrame:
            return durable_by(df, name, "asx_ticker", self.parts)

        def union(parts: list[DataFrame], name: str) -> DataFrame:
            return event_ops.union_events_by_stock(parts, lambda df: write(df, name), self.parts)

        return self._once("events", self._event_parts_by_stock, union)

    def _event_parts_by_stock(self) -> list[DataFrame]:
        """Events made where their holdings lines, orders and sign-ups lie: no event row moves."""
        return event_ops.event_parts(
            self.dealt_holdings(),
            durable(self.registry(), "registry"),
            self.announcements_of(self.announced_orders().repartition(self.parts, "symbol")),
            self.custom_events_of(self.signups().repartition(self.parts, "symbol")),
            dates=self.snapshot_dates(),
        )

    def event_bars(self) -> DataFrame:
        events, bars = self.events(), self.bars()
        with joins_in_place(self.spark):
            return self._by_stock("event-bars", lambda: flow.priced_points(events, bars))

    def lazy_looked_up(self) -> DataFrame:
        """Every lookup goes to the events where they lie, out of the bars there: no wide row moves or is stored for it."""
        dated = self.events().drop(*NOT_MEASURED).withColumn("ref_date", flow.reference_date())
        known = feature_ops.attach_facts(dated, self.stock_days(), self.profiles())
        return flow.attach_bars_by_day(known, self.bars(), self.event_days())

    def event_days(self) -> DataFrame:
        events, bars = self.events(), self.bars()
        with joins_in_place(self.spark):
            return self._by_stock("event-days", lambda: flow.bar_days(events, bars))

    def stock_days(self) -> DataFrame:
        events, caps = self.events(), self.market_caps_of(self.order_values().repartition(self.parts, "symbol"))
        with joins_in_place(self.spark):
            stacks = self._by_stock("stack-days", lambda: strat.stock_stacks(events))
            return self._by_stock("stock-days", lambda: feature_ops.stock_day_facts(events, caps, stacks))

    def looked_up(self) -> DataFrame:
        found = self.lazy_looked_up()
        with joins_in_place(self.spark):
            return self._by_stock("looked-up", lambda: found)

    def enriched(self) -> DataFrame:
        """What follows from the lookups row by row is not stored."""
        return pipeline.measure(self.looked_up())

    def ledger(self) -> DataFrame:
        # trades meet the bars of their exit in place; readers group by strategy, not by stock
        enriched, bars = self.enriched(), self.bars()
        with joins_in_place(self.spark):
            return self._once("ledger", lambda: backtest.run_strategies(enriched, bars))

    def lazy_legs(self) -> DataFrame:
        return membership.membership_legs(
            membership.collect_changes(self.membership_changes(), "1995-01-01"),
            self.bars(),
            self.benchmark_bars(),
        )

    def legs(self) -> DataFrame:
        return self._once("legs", self.lazy_legs)

    def overrides(self) -> DataFrame:
        """Patches for every 50th order's announcement, two rows for some ids."""
        o = self.announcements().where(F.col("source_url").rlike("(00|50)$"))
        ids = event_ops.events_from_announcements(o).select("event_id", "source_url_or_file")
        number = F.split_part("source_url_or_file", F.lit(":"), F.lit(2)).cast("long")
        return ids.select(
            "event_id",
            F.when(number % 100 == 0, F.lit("1999-12-31").cast("date")).alias("effective_date"),
            (F.lit(0.5) + (number % 4) / 10.0).alias("confidence_score"),
            F.when(number % 200 == 50, F.lit("confirmed")).alias("notes"),
            number.alias("line_no"),
        )


def _r(c: Column | str, digits: int = 6) -> Column:
    """Rounding any engine repeats: floor arithmetic, with near ties pushed upwards."""
    scale = F.lit(float(10**digits))
    return F.floor((F.col(c) if isinstance(c, str) else c) * scale + 0.50001) / scale


def _rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.select(
        *[_r(c, digits[c]).alias(c) if c in digits else F.col(f"`{c}`") for c in df.columns]
    )


def _lab(spark: SparkSession, path: str) -> Lab:
    lab = Lab(tune(spark), path)
    spread(spark, lab.input_bytes)
    return lab


# ------------------------------------------------------------------ bars and as-of
def ohlcv_bars(s: Lab) -> DataFrame:
    return _rounded(
        s.lazy_bars(),
        {c: 6 for c in ("open", "high", "low", "close", "adj_close", "vwap")} | {"dollar_volume": 3},
    )


def adv_trailing(s: Lab) -> DataFrame:
    return bar_ops.with_trailing(s.bars()).select(
        "symbol", "date", F.col("bar_no").cast("long").alias("bar_no"), "n_bars",
        _r("adv_dollars", 3).alias("adv_dollars"), _r("adv_shares", 6).alias("adv_shares"),
    )


def spread_vol_momentum(s: Lab) -> DataFrame:
    cols = ["spread_proxy_bps", "volatility", "volume_shock", *bar_ops.MOMENTUM_BARS]
    return bar_ops.with_trailing(s.bars()).select("symbol", "date", *[_r(c, 5).alias(c) for c in cols])


def latest_bars(s: Lab) -> DataFrame:
    return bar_ops.latest_bars(s.bars()).select(
        "symbol", "date", _r("close").alias("close"), _r("adv_dollars", 3).alias("adv_dollars"),
        "n_bars",
    )


def tradeable_bars(s: Lab) -> DataFrame:
    return bar_ops.with_trailing(s.bars()).select(
        "symbol", "date",
        bar_ops.tradeable(F.col("close"), F.col("adv_dollars")).alias("tradeable"),
        _r(tightness("adv_dollars"), 6).alias("tightness"),
    )


def _orders(s: Lab) -> DataFrame:
    return s.announcements().select(
        "source_url", F.col("asx_ticker").alias("symbol"), "announcement_date", "effective_date"
    )


def _asof_query(forward: bool, strict: bool) -> Callable[[Lab], DataFrame]:
    def run(s: Lab) -> DataFrame:
        out = asof.asof_join(
            _orders(s), s.packed_bars(), "symbol", "announcement_date", "date",
            {"date": "bar_date", "close": "bar_close"}, forward=forward, strict=strict, stored=True,
        )
        return out.select(
            "source_url", "symbol", "announcement_date", "bar_date", _r("bar_close").alias("bar_close")
        )

    return run


def asof_slotted(s: Lab) -> DataFrame:
    """The backward as-of with a hot key's packs split by month."""
    out = asof.asof_join(
        _orders(s), s.bars(), "symbol", "announcement_date", "date",
        {"date": "bar_date", "close": "bar_close"}, slot=F.trunc("__ts", "month"),
    )
    return out.select(
        "source_url", "symbol", "announcement_date", "bar_date", _r("bar_close").alias("bar_close")
    )


def shift_bars(s: Lab) -> DataFrame:
    out = asof.shift_bars(
        _orders(s), s.packed_bars(), "symbol", "announcement_date", F.lit(5),
        {"date": "shifted_date", "close": "shifted_close"},
    )
    return out.select(
        "source_url", "symbol", "shifted_date", _r("shifted_close").alias("shifted_close")
    )


def return_between(s: Lab) -> DataFrame:
    out = asof.return_between(
        _orders(s), s.packed_bars(), "symbol", "announcement_date", "effective_date", "ret"
    )
    return out.select("source_url", "symbol", _r("ret").alias("ret"))


def market_excess_return(s: Lab) -> DataFrame:
    rows = _orders(s).withColumn("market", F.lit("ASX"))
    out = asof.benchmark_return(
        rows, s.benchmark_bars(), "market", "announcement_date", "effective_date", "bench", stored=True
    )
    dates = ("announcement_date", "effective_date")
    out = asof.asof_pair(out, s.packed_bars(), "symbol", dates, "close", ("p0", "p1"), stored=True)
    return out.select(
        "source_url", _r("bench").alias("bench_return"),
        _r(simple_return("p0", "p1") - F.col("bench")).alias("excess_return"),
    )


def market_cap_asof(s: Lab) -> DataFrame:
    out = feature_ops.attach_fundamentals(
        _orders(s).withColumnsRenamed({"symbol": "asx_ticker", "announcement_date": "ref_date"}),
        s.market_caps(), s.profiles(), allow_current_profile=True,
    )
    return out.select("source_url", "asx_ticker", _r("market_cap", 2).alias("market_cap"), "sector", "industry")


# ------------------------------------------------------------------ snapshots and events
def snapshot_collapse(s: Lab) -> DataFrame:
    out = snapshots.collapse_constituents(s.lazy_holdings())
    return out.select(
        "product_ticker", "as_of_date", "constituent_key", "constituent_name",
        _r("weight_pct", 8).alias("weight_pct"), "shares",
    )


def snapshot_dates(s: Lab) -> DataFrame:
    return snapshots.snapshot_dates(s.holdings()).select(
        "product_ticker", "as_of_date", F.col("snap_no").cast("long").alias("snap_no"), "prev_date", "n_snaps"
    )


def snapshot_diff(s: Lab) -> DataFrame:
    d = snapshots.diff_history(s.holdings())
    return _rounded(d.drop("exchange"), {c: 8 for c in ("old_weight", "new_weight", "weight_delta")})


_EVENT_KEYS = [
    "event_id", "source_type", "provider", "etf_index_name", "asx_ticker", "event_type",
    "announcement_date", "effective_date",
]


def holdings_events(s: Lab) -> DataFrame:
    e = event_ops.events_from_holdings(s.holdings(), s.registry())
    return e.select(
        *_EVENT_KEYS, "shares_delta", _r("weight_delta", 8).alias("weight_delta"), _r("aum", 2).alias("aum"),
        "theme", "confidence_score",
    )


def announcement_events(s: Lab) -> DataFrame:
    e = event_ops.events_from_announcements(s.announcements())
    return e.select(*_EVENT_KEYS, _r("confidence_score").alias("confidence_score"), "notes", "source_url_or_file")


def custom_events(s: Lab) -> DataFrame:
    return event_ops.events_from_custom(s.custom_events()).select(*_EVENT_KEYS, "confidence_score")


def build_events(s: Lab) -> DataFrame:
    return s.lazy_events().select(
        *_EVENT_KEYS, "company_name", _r("confidence_score").alias("confidence_score"), "shares_delta"
    )


def override_patch(s: Lab) -> DataFrame:
    base = event_ops.union_events([event_ops.events_from_announcements(s.announcements())])
    out = event_ops.apply_overrides(base, s.overrides(), "line_no")
    return out.select("event_id", "effective_date", _r("confidence_score").alias("confidence_score"), "notes")


def event_counts(s: Lab) -> DataFrame:
    return event_ops.event_counts(s.events(), "source_type", "event_type")


def events_per_ticker_top(s: Lab) -> DataFrame:
    counts = feature_ops.events_per_ticker(s.events())
    return counts.orderBy(F.desc("n_events"), "asx_ticker").limit(15)


def accumulation(s: Lab) -> DataFrame:
    out = snapshots.net_accumulation(s.holdings(), s.bars())
    return out.select(
        "asx_ticker", "net_shares", "n_etfs_trading", F.array_join("etfs", ",").alias("etfs"), "window_to",
        _r("adv_shares_63d").alias("adv_shares_63d"), _r("buy_days_of_volume").alias("buy_days_of_volume"),
    )


def stack_counts(s: Lab) -> DataFrame:
    e = strat.with_stack_count(s.events(), base=s.events())
    return e.select("event_id", "asx_ticker", F.col("stack_count").cast("long").alias("stack_count"))


# ------------------------------------------------------------------ flow, study, features
def flow_pressure(s: Lab) -> DataFrame:
    e = flow.estimate_flows(flow.attach_bars(s.events(), s.bars(), s.event_bars()), AS_OF)
    return e.select(
        "event_id", _r("estimated_buy_sell_dollars", 3).alias("estimated_buy_sell_dollars"),
        _r("adv_dollars", 3).alias("adv_dollars"), _r("flow_pressure").alias("flow_pressure"),
        _r("prob_real").alias("prob_real"), _r("liquidity_tightness").alias("liquidity_tightness"),
        _r("expected_remaining_flow").alias("expected_remaining_flow"), "flow_estimable",
    )


def event_study(s: Lab) -> DataFrame:
    e = flow.enrich_events(s.events(), s.bars(), priced=s.event_bars())
    wanted = [*flow.STUDY_COLUMNS, "immediate_reaction", "delayed_return", "underreaction_score"]
    return e.select(
        "event_id", "entry_date", *[_r(f"`{c}`", 5).alias(c.replace("-", "m")) for c in wanted],
        "tradeable_flag", "eff_is_reached",
    )


def opportunity_score(s: Lab) -> DataFrame:
    return s.enriched().where(F.col("delayed_flow_opportunity_score").isNotNull()).select(
        "event_id", "asx_ticker", _r("delayed_flow_opportunity_score").alias("score")
    )


_BIG = {"market_cap": 2, "adv_dollars": 3, "dollar_volume": 3, "fund_aum": 2, "expected_buy_dollars": 3}


def features(s: Lab) -> DataFrame:
    f = feature_ops.feature_matrix(s.enriched())
    digits = {c: 5 for c, k in f.dtypes if k == "double"} | _BIG
    out = _rounded(f, digits).drop("prior_index_membership", "news_coverage_score")
    return out.withColumn("days_to_effective", F.col("days_to_effective").cast("long"))


def labels(s: Lab) -> DataFrame:
    out = feature_ops.labels(s.enriched())
    return _rounded(out, {"label_delayed_return": 5})


def study_summary(s: Lab) -> DataFrame:
    out = diagnostics.column_summary(s.enriched(), flow.STUDY_COLUMNS)
    return out.select(
        "measure", _r("mean", 5).alias("mean"), _r("median", 5).alias("median"), "n_positive", "n"
    )


def _trades(names: list[str]) -> Callable[[Lab], DataFrame]:
    def run(s: Lab) -> DataFrame:
        return strat.generate_trades(s.enriched(), [strat.strategy(n) for n in names])

    return run


# ------------------------------------------------------------------ ledger and diagnostics
_LEDGER_DIGITS = {
    "entry_price": 5, "exit_price": 5, "gross_return": 6, "adv_dollars": 3, "participation": 6,
    "executable_value": 2, "cost_bps_roundtrip": 4, "net_return": 6, "harsh_net_return": 6,
    "pnl_net": 2, "market_cap": 2,
}


def backtest_ledger(s: Lab) -> DataFrame:
    return _rounded(s.ledger(), _LEDGER_DIGITS)


def cost_model(s: Lab) -> DataFrame:
    costs = CostModel()
    b = bar_ops.with_trailing(s.bars())
    return b.select(
        "symbol", "date",
        costs.breakdown(F.lit(100000.0), "adv_dollars").alias("c"),
        costs.breakdown(F.lit(100000.0), "adv_dollars", True).alias("h"),
    ).select(
        "symbol", "date", _r("c.participation").alias("participation"), _r("c.round_trip_bps", 4).alias("base_bps"),
        _r("h.round_trip_bps", 4).alias("harsh_bps"), F.col("c.capped").alias("capped"),
    )


def _metric_digits(df: DataFrame) -> DataFrame:
    digits = {c: 6 for c, k in df.dtypes if k == "double"} | {"total_pnl_net": 0, "max_drawdown": 5}
    return _rounded(df, digits)


def metrics_by_strategy(s: Lab) -> DataFrame:
    return _metric_digits(diagnostics.compute_metrics(s.ledger(), ["strategy"]))


def max_drawdown(s: Lab) -> DataFrame:
    """Of the executed trades, in order of exit."""
    ex = backtest.executed(s.ledger())
    return _rounded(ordered.max_drawdown(ex, ["strategy"], "net_return", "exit_date", "event_id"), {"max_drawdown": 5})


def bootstrap_ci(s: Lab) -> DataFrame:
    return _rounded(
        diagnostics.bootstrap_ci(s.ledger(), ["strategy"]), {"ci_low": 6, "ci_high": 6}
    )


def breakdown_buckets(s: Lab) -> DataFrame:
    return _metric_digits(diagnostics.breakdowns(s.ledger(), s.enriched()))


def claims_gate(s: Lab) -> DataFrame:
    return _rounded(
        diagnostics.claims_gate(s.ledger(), ["strategy"]), {"ci_low": 6, "ci_high": 6}
    )


def _inefficiency(by: str) -> Callable[[Lab], DataFrame]:
    def run(s: Lab) -> DataFrame:
        out = diagnostics.inefficiency(s.enriched(), by)
        return _rounded(out, {c: 6 for c, k in out.dtypes if k == "double"})

    return run


def strategy_summary(s: Lab) -> DataFrame:
    legs = s.legs().withColumn("event_id", F.concat_ws(":", "event_id", "theme"))
    return diagnostics.strategy_summary(legs)


def run_up_breakdowns(s: Lab) -> DataFrame:
    return diagnostics.run_up_breakdowns(s.legs())


# ------------------------------------------------------------------ membership studies
def membership_backtest(s: Lab) -> DataFrame:
    out = s.lazy_legs().select(
        "strategy", "event_id", "asx_ticker", "direction", "gross_return", "net_return",
        "harsh_net_return", "adv_dollars", "exposure_days", "exit_date", "year", "theme", "provider",
    )
    return _rounded(
        out, {"gross_return": 6, "net_return": 6, "harsh_net_return": 6, "adv_dollars": 3}
    )


def caar_path(s: Lab) -> DataFrame:
    bench = s.benchmark_bars().where(F.col("market") == "US").select("date", "close")
    out = membership.caar_path(
        membership.collect_changes(s.membership_changes(), "1995-01-01"), s.bars(), bench
    )
    return out.select(
        "action", "day_rel_effective", _r("caar_pct", 4).alias("caar_pct"), "n_events"
    )


def review_windows(s: Lab) -> DataFrame:
    bench = s.benchmark_bars().where(F.col("market") == "US").select("date", "close")
    out = membership.review_windows(
        membership.collect_changes(s.membership_changes(), "1995-01-01"), s.bars(), bench
    )
    return _rounded(out, {c: 5 for c, k in out.dtypes if k == "double"})


def inclusion_study(s: Lab) -> DataFrame:
    changes = membership.collect_changes(s.membership_changes(), "1995-01-01")
    e = membership.inclusion_events(changes).dropDuplicates(["event_id"])
    trades = e.select(
        F.lit("IndexInclusionDrift").alias("strategy"), "event_id", "asx_ticker",
        F.lit(1).alias("direction"), F.lit("next_open").alias("entry_ref"),
        F.lit("effective").alias("exit_spec"), F.lit(30).alias("max_hold_days"),
    )
    out = backtest.backtest_trades(trades, e, s.bars())
    return _rounded(out.drop("theme", "market_cap"), _LEDGER_DIGITS)


# ------------------------------------------------------------------ screens
def _own(s: Lab):
    return s.fund_holdings(), s.funds(), s.bars(), s.profiles()


def ownership_map(s: Lab) -> DataFrame:
    out = screens.forced_ownership_map(*_own(s)).withColumn("etfs", F.array_join("etfs", ","))
    return _rounded(
        out,
        {"etf_value_usd": 2, "last_close_aud": 5, "adv_shares_63d": 5, "adv_dollars_63d": 3,
         "shares_outstanding": 2, "etf_pct_of_shares_out": 9, "days_to_exit_at_100pct_adv": 5,
         "days_to_exit_at_20pct_adv": 5},
    )


def _flow_table(df: DataFrame) -> DataFrame:
    out = df.withColumn("etfs", F.array_join("etfs", ",")).drop("company")
    return _rounded(
        out,
        {"etf_value_usd": 2, "inflow5_usd": 2, "last_close_aud": 5, "adv_shares_63d": 5,
         "adv_dollars_63d": 3, "shares_outstanding": 2, "etf_pct_float": 9,
         "days_to_exit_20pct_adv": 5, "inflow5_buy_days": 5, "forced_flow_score": 6},
    )


def forced_flow_score(s: Lab) -> DataFrame:
    return _flow_table(screens.forced_flow_scores(*_own(s)))


def universal_map(s: Lab) -> DataFrame:
    """Stocks only: no cash lines, no funds held by funds; the first twelve holders by name."""
    out = screens.universal_ownership_map(s.vendor_lines(), s.listed_funds(), s.bars(), s.profiles(), list_limit=12)
    return _flow_table(out)


def fund_universe(s: Lab) -> DataFrame:
    return screens.fund_universe(s.fund_holdings(), s.funds(), s.bars())


def deletion_rebounds(s: Lab) -> DataFrame:
    changes = membership.collect_changes(s.membership_changes(), "1995-01-01", details=True)
    return screens.deletion_rebounds(changes, s.bars(), AS_OF)


def not_rallied(s: Lab) -> DataFrame:
    return screens.not_rallied(screens.forced_flow_scores(*_own(s)), s.bars()).drop("company")


def size_rule_candidates(s: Lab) -> DataFrame:
    watch = s.announcements().select("asx_ticker")
    held = screens.holding_edges(s.fund_holdings(), s.funds()).where(
        F.col("etf").isin("BRAND#1", "BRAND#2", "BRAND#3")
    )
    return screens.size_rule_candidates(watch, s.profiles(), held)


def watchlist(s: Lab) -> DataFrame:
    return screens.watchlist(s.enriched(), AS_OF).select(
        "event_id", "asx_ticker", "event_type", "effective_date",
        _r("delayed_flow_opportunity_score").alias("score"),
    )


# ------------------------------------------------------------------ calendars
def review_calendar(s: Lab) -> DataFrame:
    years = s.table("orders").select(F.year("o_orderdate").alias("year")).distinct()
    return calendars.review_calendar(years)


def next_effective(s: Lab) -> DataFrame:
    """Each fund's schedule looked up from each of its snapshot dates."""
    number = F.regexp_extract("product_ticker", r"(\d+)", 1).cast("int")
    snaps = snapshots.snapshot_dates(s.holdings()).select(
        "product_ticker",
        "as_of_date",
        F.when(number % 3 == 0, F.array(*[F.lit(m) for m in (2, 8)]))
        .when(number % 3 == 1, F.array(*[F.lit(m) for m in (3, 6, 9, 12)]))
        .otherwise(F.array(*[F.lit(m) for m in (6, 12)]))
        .alias("months"),
        F.when(number % 3 == 0, "month_start").otherwise("3rd_friday").alias("rule"),
        (F.lit(5) + number % 4).cast("int").alias("lead"),
    )
    return calendars.next_effective(snaps, F.col("as_of_date"), ["product_ticker"])


def next_quarterly(s: Lab) -> DataFrame:
    days = s.table("orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("day", calendars.next_quarterly(F.col("day")).alias("next_review"))


# ------------------------------------------------------------------ registry and tickers
def registry_confidence(s: Lab) -> DataFrame:
    return s.registry().select("product_ticker", "source", "confidence_score")


def registry_priority(s: Lab) -> DataFrame:
    rows = s.registry_rows()
    funds = s.funds()
    discovered = registry_ops.discover_funds(
        funds, {"small": {"keywords": ["#1"]}, "other": {"keywords": ["#2"]}}
    )
    seeds = rows.select("product_ticker", F.lit("seed").alias("source"), F.lit("etf").alias("record_type"))
    out = registry_ops.build_registry([seeds, discovered, rows])
    return out.select(
        "product_ticker", "record_type", "product_name", "issuer", "theme", "source", _r("aum", 2).alias("aum"),
        "confidence_score",
    )


def registry_coverage(s: Lab) -> DataFrame:
    out = registry_ops.registry_coverage(s.registry())
    return _rounded(out, {c: 6 for c, k in out.dtypes if k == "double"})


def ticker_normalise(s: Lab) -> DataFrame:
    t = s.holdings().select("constituent_ticker").distinct()
    return t.select(
        "constituent_ticker",
        normalise_asx("constituent_ticker").alias("normalised"),
        looks_like_asx("constituent_ticker").alias("looks_asx"),
        constituent_symbol("constituent_ticker").alias("symbol"),
    )


def price_universe(s: Lab) -> DataFrame:
    watch = s.profiles().select(F.col("symbol").alias("asx_ticker"))
    return tables.price_universe(watch, s.events())


def valid_symbols(s: Lab) -> DataFrame:
    e = s.events().select("event_id", "asx_ticker")
    return tables.valid_symbols(e, s.profiles())


def acquisition_gaps(s: Lab) -> DataFrame:
    delivered = s.holdings().where(F.col("product_ticker").rlike("[02468]$")).withColumn(
        "source", F.lit("fmp")
    )
    return tables.acquisition_gaps(s.registry(), delivered)


def percentile_ranks(s: Lab) -> DataFrame:
    c = s.table("customer").select("c_custkey", "c_acctbal", "c_nationkey")
    out = ordered.percentile_ranks(c, "c_custkey", ["c_acctbal", "c_nationkey"])
    return _rounded(out, {"pct_rank": 9})


def grouped_quantiles(s: Lab) -> DataFrame:
    out = ordered.grouped_quantiles(
        s.table("lineitem"), ["l_returnflag"], ["l_extendedprice", "l_quantity"], (0.025, 0.5, 0.975)
    )
    return _rounded(out, {"quantile": 6})


def date_parsing(s: Lab) -> DataFrame:
    day = F.to_date("o_orderdate")
    forms = [
        F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "yyyyMMdd"), F.date_format(day, "dd-MM-yyyy"),
        F.lit("n/a"),
    ]
    spelled = F.element_at(F.array(*forms), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return s.table("orders").select(
        "o_orderkey", any_date(spelled).alias("parsed"),
        stable_id(F.lit("order"), "o_orderkey", day, F.lit(None).cast("string")).alias("order_id"),
    )


# ------------------------------------------------------------------ text
def _notices(s: Lab) -> DataFrame:
    """Whole documents with an index notice appended, worded by document number."""
    d, n = s.table("documents"), F.col("doc_id")
    code = F.format_string("%03d", (n % 900).cast("int"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (n % 365).cast("int")).cast("string")
    notice = (
        F.when(n % 4 == 0, F.concat(F.lit("\nASX:"), code, F.lit(" will be added to the list effective "), day, F.lit("\n")))
        .when(n % 4 == 1, F.concat(F.lit("\nRemoval of "), code, F.lit(" and the deletion of ABX on "), day, F.lit(". Bye")))
        .when(n % 4 == 2, F.concat(F.lit("\nThe review considers inclusion of "), code, F.lit(" QXZ9 soon")))
        .otherwise(F.lit("\nNothing to report"))
    )
    return d.select("doc_id", F.concat(F.coalesce("text", F.lit("")), notice).alias("text"))


def announcement_candidates(s: Lab) -> DataFrame:
    return tx.announcement_candidates(_notices(s), "doc_id", "text")


def rule_extraction(s: Lab) -> DataFrame:
    d, n = s.table("documents"), F.col("doc_id")
    rules = F.concat(
        F.lit("\nConstituents are capped at "), (n % 20 + 1).cast("string"), F.lit("%. "),
        F.when(n % 2 == 0, "The index is rebalanced quarterly. ").otherwise("Rebalancing happens semi-annually. "),
        F.when(n % 3 == 0, "Reconstitution is annually done. ").otherwise(""),
        F.when(n % 5 == 0, "Free-float adjusted weights. ").otherwise("An equal-weighted index. "),
        F.lit("Market capitalisation above US$"), (n % 90 + 10).cast("string"), F.lit(" million. "),
        F.lit("Average daily value traded of $"), (n % 9 + 1).cast("string"), F.lit(" million."),
    )
    docs = d.select("doc_id", F.concat(F.coalesce("text", F.lit("")), rules).alias("text"))
    return tx.methodology_rules(docs, "doc_id", "text")


def page_links(s: Lab) -> DataFrame:
    n = F.col("page_id")
    extra = F.concat(
        F.lit('<p>[Tracks the Metals '), (n % 7).cast("string"), F.lit(' Index]</p><a href="/files/holdings-'),
        n.cast("string"), F.lit('.csv">h</a><a href="/x/constituents.json">c</a>'),
    )
    pages = s.table("pages").select("page_id", F.concat("html", extra).alias("html"))
    return tx.page_mentions(pages, "page_id", "html")


def page_text(s: Lab) -> DataFrame:
    p = s.table("pages").select("page_id", tx.strip_tags("html").alias("plain"))
    return p.select("page_id", F.length("plain").cast("long").alias("n_chars"), F.md5("plain").alias("digest"))


# ------------------------------------------------------------------ research and models
def param_sweep(s: Lab) -> DataFrame:
    out = sweep.first_round(s.enriched(), s.bars(), by_stock=True)
    return _rounded(out, {"avg_net": 6, "avg_harsh": 6, "objective": 6})


def research_history(s: Lab) -> DataFrame:
    """All rounds with adoption and stop; objectives compared to six decimals as printed."""
    return _rounded(sweep.research_history(s.enriched(), s.bars(), by_stock=True), {"objective": 6})


def gbt_cv(s: Lab) -> DataFrame:
    """Expanding-window scores, one row for each fold."""
    e = s.enriched()
    out = learning.train_classifier(feature_ops.feature_matrix(e), feature_ops.labels(e), e)
    rows = [(i, float(v)) for i, v in enumerate(out.get("scores", []))]
    return s.spark.createDataFrame(rows, "fold int, auc double")


def candidate_dataset(s: Lab) -> DataFrame:
    universe = s.profiles().select(F.col("symbol").alias("asx_ticker"))
    data = learning.candidate_dataset(
        s.events().select("event_id", "asx_ticker", "event_type"), universe
    )["data"]
    return data.groupBy("is_added").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("asx_ticker").alias("n_stocks")
    )


# ------------------------------------------------------------------ streaming
def _stream(s: Lab) -> DataFrame:
    schema = s.table("events").schema
    return jobs.read_stream(s.spark, s.path, schema, "events.parquet").withColumn(
        "ts", F.col("ts").cast("timestamp")
    )


def stream_daily_bars(s: Lab) -> DataFrame:
    path = scratch_path(s.spark, "stream-bars")
    ticks = _stream(s).where(F.col("event_type") == "purchase")
    bars = jobs.bars_from_stream(ticks, "ts", "user_id", "value")
    jobs.upsert_batches(bars, f"{path}/out", f"{path}/check", keys=["symbol", "date"]).awaitTermination()
    out = jobs.latest_rows(s.spark, f"{path}/out", ["symbol", "date"])
    return out.select("symbol", "date", "open", "high", "low", "close", "volume")


def stream_distinct_events(s: Lab) -> DataFrame:
    """Every event twice in one delivery, and all of them again in a later one."""
    path = scratch_path(s.spark, "stream-events")
    for delivery in ("first", "replay"):
        replayed = _stream(s).select("event_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
        jobs.accept_once(replayed, path, f"{path}/check-{delivery}", "ts", "event_id", delivery).awaitTermination()
    out = s.spark.read.parquet(f"{path}/accepted")
    return out.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n_events"))


def stream_snapshot_changes(s: Lab) -> DataFrame:
    """Snapshots land as files and are diffed against the stored last one."""
    path = scratch_path(s.spark, "stream-holdings")
    tables.write_parquet(s.holdings(), f"{path}/landed")
    stream = jobs.read_stream(s.spark, f"{path}/landed", s.holdings().schema)
    jobs.snapshot_changes(stream, f"{path}/out", f"{path}/state", f"{path}/check").awaitTermination()
    changes = s.spark.read.parquet(f"{path}/out/changes")
    return changes.groupBy("product_ticker", "change_type").agg(
        F.count(F.lit(1)).alias("n_changes"), F.sum("shares_delta").alias("net_shares")
    )


def stream_watchlist(s: Lab) -> DataFrame:
    path = scratch_path(s.spark, "stream-watch")
    e = s.enriched().select(
        "event_id", "asx_ticker", "effective_date", "tradeable_flag", "delayed_flow_opportunity_score"
    )
    # Two deliveries: every event still tradeable, then the events as they are, some closed.
    for k, delivery in enumerate((e.withColumn("tradeable_flag", F.lit(True)), e)):
        delivery.write.parquet(f"{path}/landed/d{k}")
        stream = jobs.read_stream(s.spark, f"{path}/landed/*", e.schema)
        jobs.trailing_watchlist(stream, f"{path}/out", f"{path}/check").awaitTermination()
    out = jobs.current_watchlist(s.spark, f"{path}/out", AS_OF)
    return out.select(
        "event_id", "asx_ticker", "effective_date", _r("delayed_flow_opportunity_score").alias("score")
    )


_RUN: dict[str, Callable[[Lab], DataFrame]] = {
    "ohlcv_bars": ohlcv_bars,
    "adv_trailing": adv_trailing,
    "spread_vol_momentum": spread_vol_momentum,
    "latest_bars": latest_bars,
    "tradeable_bars": tradeable_bars,
    "asof_backward": _asof_query(False, False),
    "asof_backward_strict": _asof_query(False, True),
    "asof_forward": _asof_query(True, False),
    "asof_forward_strict": _asof_query(True, True),
    "asof_slotted": asof_slotted,
    "shift_bars": shift_bars,
    "return_between": return_between,
    "market_excess_return": market_excess_return,
    "market_cap_asof": market_cap_asof,
    "snapshot_collapse": snapshot_collapse,
    "snapshot_dates": snapshot_dates,
    "snapshot_diff": snapshot_diff,
    "holdings_events": holdings_events,
    "announcement_events": announcement_events,
    "custom_events": custom_events,
    "build_events": build_events,
    "override_patch": override_patch,
    "event_counts": event_counts,
    "events_per_ticker_top": events_per_ticker_top,
    "accumulation": accumulation,
    "stack_counts": stack_counts,
    "flow_pressure": flow_pressure,
    "event_study": event_study,
    "opportunity_score": opportunity_score,
    "features": features,
    "labels": labels,
    "study_summary": study_summary,
    **{f"trades_{n}": _trades([n]) for n in TRADED},
    "trades_all": _trades(TRADED),
    "backtest_ledger": backtest_ledger,
    "cost_model": cost_model,
    "metrics_by_strategy": metrics_by_strategy,
    "max_drawdown": max_drawdown,
    "bootstrap_ci": bootstrap_ci,
    "breakdown_buckets": breakdown_buckets,
    "claims_gate": claims_gate,
    "provider_inefficiency": _inefficiency("provider"),
    "theme_inefficiency": _inefficiency("theme"),
    "strategy_summary": strategy_summary,
    "run_up_breakdowns": run_up_breakdowns,
    "membership_backtest": membership_backtest,
    "caar_path": caar_path,
    "review_windows": review_windows,
    "inclusion_study": inclusion_study,
    "ownership_map": ownership_map,
    "forced_flow_score": forced_flow_score,
    "universal_map": universal_map,
    "fund_universe": fund_universe,
    "deletion_rebounds": deletion_rebounds,
    "not_rallied": not_rallied,
    "size_rule_candidates": size_rule_candidates,
    "watchlist": watchlist,
    "review_calendar": review_calendar,
    "next_effective": next_effective,
    "next_quarterly": next_quarterly,
    "registry_confidence": registry_confidence,
    "registry_priority": registry_priority,
    "registry_coverage": registry_coverage,
    "ticker_normalise": ticker_normalise,
    "price_universe": price_universe,
    "valid_symbols": valid_symbols,
    "acquisition_gaps": acquisition_gaps,
    "percentile_ranks": percentile_ranks,
    "grouped_quantiles": grouped_quantiles,
    "date_parsing": date_parsing,
    "announcement_candidates": announcement_candidates,
    "rule_extraction": rule_extraction,
    "page_links": page_links,
    "page_text": page_text,
    "param_sweep": param_sweep,
    "research_history": research_history,
    "gbt_cv": gbt_cv,
    "candidate_dataset": candidate_dataset,
    "stream_daily_bars": stream_daily_bars,
    "stream_distinct_events": stream_distinct_events,
    "stream_snapshot_changes": stream_snapshot_changes,
    "stream_watchlist": stream_watchlist,
}


def queries() -> dict[str, Query]:
    def bind(run: Callable[[Lab], DataFrame]) -> Query:
        return lambda spark, path: run(_lab(spark, path))

    def compared(run: Callable[[Lab], DataFrame]) -> Callable[[Lab], DataFrame]:
        return lambda lab: _rounded(run(lab), landed.DIGITS)

    out = {name: bind(run) for name, run in _RUN.items()}
    return out | {name: bind(compared(run)) for name, run in landed.QUERIES.items()}


def flagship(spark: SparkSession, path: str) -> DataFrame:
    """The strongest delayed reactions: bars, as-of study and score in one lazy plan."""
    s = _lab(spark, path)
    e = flow.enrich_events(event_ops.events_from_announcements(s.announcements()), s.bars())
    score = safe_div("delayed_return", nonzero(F.greatest(F.abs("immediate_reaction"), F.lit(flow.REACTION_FLOOR))))
    return (
        e.where(F.col("tradeable_flag"))
        .select(
            "event_id", "asx_ticker", "event_type", "announcement_date", "effective_date", "entry_date",
            _r("immediate_reaction").alias("immediate_reaction"), _r("delayed_return").alias("delayed_return"),
            _r(score).alias("underreaction_score"),
        )
        .orderBy(F.desc_nulls_last("underreaction_score"), "event_id")
        .limit(50)
    )
