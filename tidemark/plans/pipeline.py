"""End-to-end plans: base events, enrichment, ledger (EV9, entries 1 and 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.backtest import run_strategies
from ..operators.features import attach_lookups, feature_columns
from ..operators.flow import attach_bars, measure_events
from ..operators.strategies import Strategy, with_stack_count


def build_and_enrich(
    base_events: DataFrame,
    bars: DataFrame,
    market_caps: DataFrame | None = None,
    profiles: DataFrame | None = None,
    as_of: str | None = None,
    compat: bool = False,
    priced: DataFrame | None = None,
) -> DataFrame:
    """EV9: flow, study, features and stack counts on top of the base events.

    ``base_events`` should be a written table (see ``durable``): it is read once for the
    rows, once for the as-of points and once for each per-stock count. ``priced`` is
    ``flow.priced_points`` of them as a written table.
    """
    found = look_up(base_events, bars, market_caps, profiles, compat, priced)
    return measure(found, as_of)


def look_up(
    base_events: DataFrame,
    bars: DataFrame,
    market_caps: DataFrame | None = None,
    profiles: DataFrame | None = None,
    compat: bool = False,
    priced: DataFrame | None = None,
    rows: DataFrame | None = None,
) -> DataFrame:
    """All joins of the enrichment: bars of both dates, market cap, profile and counts by stock.

    ``rows`` are the base events dealt in another way, e.g. by stock; points and counts still
    read ``base_events``.
    """
    out = attach_bars(base_events if rows is None else rows, bars, priced)
    out = attach_lookups(out, market_caps, profiles, base=base_events)
    return with_stack_count(out, compat=compat, base=base_events)


def measure(found: DataFrame, as_of: str | None = None) -> DataFrame:
    """All columns of the enrichment that follow from the looked-up ones, row by row."""
    return feature_columns(measure_events(found, as_of))


def ledger(
    base_events: DataFrame,
    bars: DataFrame,
    market_caps: DataFrame | None = None,
    profiles: DataFrame | None = None,
    strategies: list[Strategy] | None = None,
) -> DataFrame:
    """Entry 2: the stacked ledger of all enabled strategies."""
    events = build_and_enrich(base_events, bars, market_caps, profiles)
    return run_strategies(events, bars, strategies)
