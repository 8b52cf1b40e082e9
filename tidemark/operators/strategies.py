"""Strategies as declarative predicates that turn events into trade specs (SG0-SG9)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import STRATEGY_PARAMS
from ..functions.scalars import BUY_TYPES, direction, passes

# Configuration labels of entries and exits.
ENTRY_LABELS = {"detected_next_open": "next_open"}
EXIT_LABELS = {
    "effective_open": "effective",
    "eff_close_plus1": "eff_close_plus:1",
    "eff_close_plus3": "eff_close_plus:3",
    "eff_close_plus5": "eff_close_plus:5",
    "eff_close_plus10": "eff_close_plus:10",
    "plus3": "plus:3",
    "plus5": "plus:5",
    "plus10": "plus:10",
}
DEFAULT_MAX_HOLD = 30

# Columns predicates may read; an absent one counts as unknown (SC25).
READ_COLUMNS = {
    "source_type": "string",
    "immediate_reaction": "double",
    "flow_pressure": "double",
    "confidence_score": "double",
    "new_weight": "double",
    "adv_dollars": "double",
    "market_cap": "double",
    "source_obscurity_score": "double",
    "stack_count": "long",
    "tradeable_flag": "boolean",
}

Predicate = Callable[[dict], Column]


def is_buy() -> Column:
    return F.col("event_type").isin(*BUY_TYPES)


def _at_most(c: Column, limit: float) -> Column:
    return passes(c <= F.lit(float(limit)), c)


def _at_least(c: Column, limit: float) -> Column:
    return passes(c >= F.lit(float(limit)), c)


def _delayed_reaction(p: dict) -> Column:
    return (
        is_buy()
        & _at_most(F.abs("immediate_reaction"), p.get("max_immediate_reaction_pct", 0.03))
        & _at_least(F.col("flow_pressure"), p.get("min_flow_pressure", 0.5))
        & _at_least(F.col("confidence_score"), p.get("min_confidence", 0.4))
    )


def _high_flow(p: dict) -> Column:
    return (
        is_buy()
        & (F.col("flow_pressure") >= F.lit(float(p.get("min_flow_pressure", 1.0))))
        & _at_most(F.col("adv_dollars"), p.get("max_adv_dollars", 2_000_000))
    )


def _holdings_signal(p: dict) -> Column:
    return (
        (F.col("source_type") == "holdings_diff")
        & is_buy()
        & _at_least(F.col("new_weight"), p.get("min_new_weight_pct", 0.001))
        & _at_most(F.abs("immediate_reaction"), p.get("max_immediate_reaction_pct", 0.04))
    )


def _methodology(p: dict) -> Column:
    return F.col("event_type").isin("METHODOLOGY_CHANGE", "BENCHMARK_CHANGE")


def _nothing(p: dict) -> Column:
    return F.lit(False)


def _calendar(p: dict) -> Column:
    return F.col("event_type").isin("REBALANCE", "RECONSTITUTION", "OFFICIAL_INDEX_ADD") & (
        F.col("confidence_score") >= F.lit(float(p.get("min_confidence", 0.7)))
    )


def _stacked(p: dict) -> Column:
    return is_buy() & (F.col("stack_count") >= F.lit(int(p.get("min_products", 2))))


def _small_cap(p: dict) -> Column:
    return (
        is_buy()
        & _at_most(F.col("adv_dollars"), p.get("max_adv_dollars", 1_000_000))
        & _at_most(F.col("market_cap"), p.get("max_market_cap", 500_000_000))
        & _at_most(F.abs("immediate_reaction"), p.get("max_immediate_reaction_pct", 0.02))
        & _at_least(F.col("flow_pressure"), p.get("min_flow_pressure", 0.75))
        & _at_least(F.col("source_obscurity_score"), p.get("min_source_obscurity", 0.5))
    )


@dataclass(frozen=True)
class Strategy:
    """A named predicate with its entry, exit and holding limit: the extension point."""

    name: str
    predicate: Predicate
    params: dict = field(default_factory=dict)
    emits: bool = True

    def with_params(self, **overrides) -> Strategy:
        return Strategy(self.name, self.predicate, {**self.params, **overrides}, self.emits)

    @property
    def enabled(self) -> bool:
        return bool(self.params.get("enabled", False))

    @property
    def entry_ref(self) -> str:
        label = self.params.get("entry") or "next_open"
        return ENTRY_LABELS.get(label, label)

    @property
    def exit_spec(self) -> str:
        label = self.params.get("exit") or "effective"
        return EXIT_LABELS.get(label, label)

    @property
    def max_hold_days(self) -> int:
        return int(self.params.get("max_hold_days", DEFAULT_MAX_HOLD))

    def mask(self) -> Column:
        """Selected, tradeable and with a direction; unknown counts as no."""
        chosen = self.predicate(self.params) if self.emits else F.lit(False)
        tradeable = F.coalesce("tradeable_flag", F.lit(False))
        return F.coalesce(chosen & tradeable & (direction("event_type") != 0), F.lit(False))

    def spec(self) -> Column:
        return F.struct(
            F.lit(self.name).alias("strategy"),
            F.lit(self.entry_ref).alias("entry_ref"),
            F.lit(self.exit_spec).alias("exit_spec"),
            F.lit(self.max_hold_days).alias("max_hold_days"),
            F.lit(self.name).alias("selection_notes"),
        )


_PREDICATES: dict[str, Predicate] = {
    "DelayedAnnouncementReaction": _delayed_reaction,
    "HighFlowLowLiquidity": _high_flow,
    "HoldingsDiffSignal": _holdings_signal,
    "MethodologyChangeAnticipation": _methodology,
    "ThematicIndexPrediction": _nothing,
    "RebalanceCalendarTrade": _calendar,
    "EffectiveDateFade": _nothing,
    "MultiETFStackedFlow": _stacked,
    "ForgottenSmallCapAdd": _small_cap,
}


def strategy(name: str, **overrides) -> Strategy:
    base = STRATEGY_PARAMS.get(name, {})
    return Strategy(name, _PREDICATES[name], {**base, **overrides}, name != "EffectiveDateFade")


def enabled_strategies() -> list[Strategy]:
    return [s for s in map(strategy, _PREDICATES) if s.enabled]


def fund_coverage(events: DataFrame, window_days: int) -> DataFrame:
    """Distinct funds per (stock, day) whose last event there is at most ``window_days`` old.

    Days on which a fund covers a stock form intervals; each interval adds one at its
    first day and takes it back after its last, so the count is a running sum of daily
    changes. Nothing is repeated per day of the window, the running sum has one row per
    stock and day, and a fund's history on a stock is bounded by the calendar.
    """
    seen = events.select("asx_ticker", "__day", "__source").distinct()
    history = W.partitionBy("asx_ticker", "__source").orderBy("__day")
    previous, following = F.lag("__day").over(history), F.lead("__day").over(history)
    opens = previous.isNull() | (previous < F.date_sub("__day", window_days))
    closes = following.isNull() | (following > F.date_add("__day", window_days))
    marks = F.array(
        F.struct(F.col("__day").alias("day"), F.when(F.col("__opens"), 1).otherwise(0).alias("change")),
        F.struct(
            F.when(F.col("__closes"), F.date_add("__day", window_days + 1)).alias("day"),
            F.lit(-1).alias("change"),
        ),
    )
    daily = (
        seen.withColumn("__opens", opens)
        .withColumn("__closes", closes)
        .select("asx_ticker", F.explode(marks).alias("m"))
        .where(F.col("m.day").isNotNull())
        .groupBy("asx_ticker", F.col("m.day").alias("__day"))
        .agg(F.sum("m.change").alias("__change"))
    )
    running = W.partitionBy("asx_ticker").orderBy("__day").rowsBetween(W.unboundedPreceding, 0)
    return daily.select("asx_ticker", "__day", F.sum("__change").over(running).alias("stack_count"))


def stock_stacks(events: DataFrame, window_days: int = 30) -> DataFrame:
    """``fund_coverage`` of events by their reference date; an event without a fund counts by itself."""
    day, source = F.coalesce("announcement_date", "detected_date"), F.coalesce("product_ticker", "event_id")
    counted = events.withColumn("__day", day).withColumn("__source", source)
    return fund_coverage(counted.where(F.col("__day").isNotNull()), window_days)


def with_stack_count(
    events: DataFrame,
    window_days: int = 30,
    compat: bool = False,
    base: DataFrame | None = None,
) -> DataFrame:
    """AG6 for stacked flow: how many funds pile into a stock.

    By default distinct funds (events without a fund count by themselves) with a
    reference date in the trailing ``window_days``; ``compat`` counts all events of the
    stock. ``base`` is the event table to count from when ``events`` is an expensive plan.
    """
    source_events = events if base is None else base
    if compat:
        counts = source_events.groupBy("asx_ticker").agg(
            F.countDistinct("event_id").alias("stack_count")
        )
        return events.join(counts, "asx_ticker", "left")
    counts = stock_stacks(source_events, window_days)
    if "ref_date" in events.columns:
        return events.join(counts.withColumnRenamed("__day", "ref_date"), ["asx_ticker", "ref_date"], "left")
    dated = events.withColumn("__day", F.coalesce("announcement_date", "detected_date"))
    return dated.join(counts, ["asx_ticker", "__day"], "left").drop("__day")


def generate_trades(
    events: DataFrame, strategies: list[Strategy], carry: list[str] | None = None
) -> DataFrame:
    """SG0: one trade spec per event and strategy that selects it, in one pass.

    Every strategy is an array slot of the same row, so the events are read once.
    ``carry`` keeps event columns on the trades, which saves joining them back.
    """
    if not strategies:
        raise ValueError("no strategies given")
    events = events.withColumns(
        {c: F.lit(None).cast(k) for c, k in READ_COLUMNS.items() if c not in events.columns}
    )
    slots = F.filter(
        F.array(*[F.when(s.mask(), s.spec()) for s in strategies]), lambda t: t.isNotNull()
    )
    return events.withColumn("__t", F.explode(slots)).select(
        "__t.strategy",
        "event_id",
        "asx_ticker",
        direction("event_type").alias("direction"),
        "__t.entry_ref",
        "__t.exit_spec",
        "__t.max_hold_days",
        "__t.selection_notes",
        *(carry or []),
    )
