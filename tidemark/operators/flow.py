"""Flow sizing and event study on one pair of as-of lookups (FE1-FE4, RS1-RS5).

All offsets an event needs are computed as columns of the bar it resolves to, so an event
is joined with the bars twice (announcement and effective date) whatever it measures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import SELL_TYPES, clip01, nonzero, safe_div, tightness, window_return
from .asof import resolve_points
from .bars import (
    MOMENTUM_BARS,
    at,
    tradeable,
    with_trailing,
)

DELAYED_HORIZON = 10
# Smallest denominator of the under-reaction ratio, and the implementation
# window of five trading days in calendar days.
REACTION_FLOOR = 0.005
IMPLEMENTATION_CALENDAR_DAYS = 7

STUDY_COLUMNS = [
    "es_pre_ann_-20_-1",
    "es_ann_close_to_next_open",
    "es_ann_close_to_next_close",
    "es_next_open_to_plus3",
    "es_next_open_to_effective",
    "es_effective_open_to_close",
    "es_eff_close_plus1",
    "es_eff_close_plus3",
    "es_eff_close_plus5",
    "es_eff_close_plus10",
]


def reference_date() -> Column:
    return F.coalesce("announcement_date", "detected_date")


def study_bars(bars: DataFrame) -> DataFrame:
    """Bars with every offset the study, the features and the backtest read."""
    return with_trailing(bars).withColumns(
        {
            "close_m20": at("close", -20),
            "close_m1": at("close", -1),
            "next_date": at("date", 1),
            "next_open": at("open", 1),
            "next_close": at("close", 1),
            "next_vwap": at("vwap", 1),
            "close_p1": at("close", 1),
            "close_p3": at("close", 3),
            "close_p5": at("close", 5),
            "close_p10": at("close", DELAYED_HORIZON),
            "entry_adv_dollars": at("adv_dollars", 1),
        }
    )


ANN_PAYLOAD = [
    "bar_no", "n_bars", "close", "close_m20", "close_m1", "next_date", "next_open", "next_close",
    "next_vwap", "close_p3", "close_p10", "adv_dollars", "entry_adv_dollars", "dollar_volume",
    "spread_proxy_bps", "volatility", "volume_shock", *MOMENTUM_BARS,
]
EFF_PAYLOAD = [
    "bar_no", "n_bars", "date", "open", "close", "close_p1", "close_p3", "close_p5", "close_p10",
]


def priced_points(
    events: DataFrame, bars: DataFrame, columns: list[str] | None = None, days: list[Column] | None = None
) -> DataFrame:
    """The bar of every (symbol, date) that an event looks at, with all columns both roles need.

    Both dates of all events are resolved together: distinct (symbol, date) points and the
    bare bar dates pass one window, and the wide bar columns join the resolved points, not
    the events. Points of symbols without any bar are not there. ``columns`` are the bar columns
    wanted, where not all are, and ``days`` the dates.
    """
    columns = columns or list(dict.fromkeys([*ANN_PAYLOAD, *EFF_PAYLOAD]))
    same_bar = (F.col("asx_ticker") == F.col("__s")) & (F.col("bar_date") == F.col("__d"))
    matched = bar_days(events, bars, days)
    return matched.join(_wide_bars(bars, columns), same_bar, "left").select("asx_ticker", "look_date", *columns)


def _wide_bars(bars: DataFrame, columns: list[str]) -> DataFrame:
    wide = study_bars(bars).withColumnsRenamed({"symbol": "__s", "date": "__d"})
    return wide.withColumn("date", F.col("__d")).select("__s", "__d", *columns)


def bar_days(events: DataFrame, bars: DataFrame, days: list[Column] | None = None) -> DataFrame:
    """The date of the bar of every (symbol, date) that an event looks at, without its columns."""
    days = [reference_date(), F.col("effective_date")] if days is None else days
    points = events.select("asx_ticker", (days[0] if len(days) == 1 else F.explode(F.array(*days))).alias("look_date"))
    dates = bars.select(F.col("symbol").alias("asx_ticker"), "date")
    return resolve_points(points, dates, "asx_ticker", "look_date", "date", {"date": "bar_date"}, known=True)


def attach_bars_by_day(events: DataFrame, bars: DataFrame, days: DataFrame) -> DataFrame:
    """``attach_bars`` with ``bar_days`` of the same events as a written table: no wide row is written for it.

    The sides that are hashed have one row for a stock and day, which the calendar bounds; events are
    sorted once, by their announcement bar.
    """

    def dated(out: DataFrame, day: str, *flags: Column) -> DataFrame:
        side = days.select(F.col("asx_ticker").alias("__sym"), F.col("look_date").alias("__day"), "bar_date", *flags)
        match = (F.col("asx_ticker") == F.col("__sym")) & (F.col(day) == F.col("__day"))
        return out.join(side.hint("shuffle_hash"), match, "left").drop("__sym", "__day")

    def priced(out: DataFrame, prefix: str, columns: list[str], hashed: bool) -> DataFrame:
        side = _wide_bars(bars, columns).withColumnsRenamed({c: f"{prefix}{c}" for c in columns})
        match = (F.col("asx_ticker") == F.col("__s")) & (F.col("bar_date") == F.col("__d"))
        return out.join(side.hint("shuffle_hash") if hashed else side, match, "left").drop("__s", "__d", "bar_date")

    out = events if "ref_date" in events.columns else events.withColumn("ref_date", reference_date())
    out = priced(dated(out, "effective_date"), "e_", EFF_PAYLOAD, True)
    return priced(dated(out, "ref_date", F.lit(True).alias("a_listed")), "a_", ANN_PAYLOAD, False)


def attach_bars(events: DataFrame, bars: DataFrame, priced: DataFrame | None = None) -> DataFrame:
    """Add ``a_*`` (announcement bar) and ``e_*`` (effective bar) columns to events.

    ``priced`` is ``priced_points`` of the same events as a written table: it is read once for
    each role, and the bar windows run once. Without it each role resolves its own dates, with
    the bar columns it reads. ``a_listed`` tells a symbol without bars from one whose first bar is later.
    """

    def role(prefix: str, columns: list[str], day: Column) -> DataFrame:
        found = priced_points(events, bars, columns, [day]) if priced is None else priced
        return found.select(
            F.col("asx_ticker").alias("__sym"),
            F.col("look_date").alias("__day"),
            *[F.col(c).alias(f"{prefix}{c}") for c in columns if c in found.columns],
        )

    def on(day: str):
        return (F.col("asx_ticker") == F.col("__sym")) & (F.col(day) == F.col("__day"))

    announced = role("a_", ANN_PAYLOAD, reference_date()).withColumn("a_listed", F.lit(True))
    out = events.withColumn("ref_date", reference_date())
    # by reference date last: later lookups by it find the rows sorted
    out = out.join(role("e_", EFF_PAYLOAD, F.col("effective_date")), on("effective_date"), "left").drop("__sym", "__day")
    return out.join(announced, on("ref_date"), "left").drop("__sym", "__day")


def estimate_flows(events: DataFrame, as_of: str | None = None) -> DataFrame:
    """FE1-FE4 on events with attached bars.

    A share change times the reference close, else a weight change times the fund's
    assets, else unknown; sells are negative.
    """
    has_bar = F.col("a_bar_no").isNotNull()
    by_shares = F.col("shares_delta") * F.col("a_close")
    by_weight = F.col("weight_delta") * F.col("aum")
    size = F.abs(F.coalesce(by_shares, by_weight))
    signed = F.when(F.col("event_type").isin(*SELL_TYPES), -size).otherwise(size)
    adv = F.when(has_bar, F.col("a_adv_dollars"))
    confidence = clip01("confidence_score")
    remaining: Column = F.lit(1.0)
    if as_of is not None:
        elapsed = F.datediff(
            F.lit(as_of).cast("date"), F.coalesce("detected_date", "announcement_date")
        )
        decayed = clip01(1.0 - elapsed / F.lit(float(IMPLEMENTATION_CALENDAR_DAYS)))
        remaining = F.when(elapsed.isNotNull(), decayed).otherwise(1.0)
    return events.withColumns(
        {
            "estimated_buy_sell_dollars": signed,
            "adv_dollars": adv,
            "flow_pressure": safe_div(size, adv),
            "reference_price": F.col("a_close"),
            "prob_real": F.when(confidence == 0, 0.5).otherwise(confidence),
            "liquidity_tightness": tightness(adv),
            "expected_remaining_flow": remaining,
            "prob_not_complete": remaining,
            "flow_estimable": size.isNotNull(),
        }
    )


def study_events(events: DataFrame, min_price: float = 0.02, min_adv: float = 50_000.0) -> DataFrame:
    """RS1-RS3: ten windows, headline reactions and the entry bar."""
    next_open = F.when(F.col("a_bar_no").isNotNull(), F.col("a_next_open"))
    # Announcement windows also need the announcement close itself to be usable.
    needs_ann = nonzero("a_close").isNotNull()
    # Without an announcement bar nothing is measured, also not around the effective date.
    measured = F.col("a_bar_no").isNotNull()

    def eff(window: Column) -> Column:
        return F.when(measured, window)

    windows = {
        "es_pre_ann_-20_-1": F.when(needs_ann, window_return("a_close_m20", "a_close_m1")),
        "es_ann_close_to_next_open": window_return("a_close", "a_next_open"),
        "es_ann_close_to_next_close": window_return("a_close", "a_next_close"),
        "es_next_open_to_plus3": window_return("a_next_open", "a_close_p3"),
        "es_next_open_to_effective": eff(window_return("a_next_open", "e_close")),
        "es_effective_open_to_close": eff(window_return("e_open", "e_close")),
        **{
            f"es_eff_close_plus{n}": eff(window_return("e_close", f"e_close_p{n}"))
            for n in (1, 3, 5, 10)
        },
    }
    out = events.withColumns(windows)
    immediate = F.col("es_ann_close_to_next_open")
    delayed = F.coalesce(
        F.col("es_next_open_to_effective"), window_return("a_next_open", "a_close_p10")
    )
    floor = F.greatest(F.abs(F.coalesce(immediate, F.lit(0.0))), F.lit(REACTION_FLOOR))
    return out.withColumns(
        {
            "immediate_reaction": immediate,
            "delayed_return": delayed,
            "underreaction_score": delayed / floor,
            "entry_date": F.col("a_next_date"),
            "entry_open": next_open,
            "tradeable_flag": tradeable(
                F.col("a_next_close"), F.col("a_entry_adv_dollars"), min_price, min_adv
            ),
            "eff_is_reached": F.when(
                F.col("effective_date").isNotNull() & F.col("e_bar_no").isNotNull(),
                (F.col("e_bar_no") < F.col("e_n_bars"))
                | (F.col("e_date") == F.col("effective_date")),
            ),
        }
    )


def opportunity_score() -> Column:
    """RS4: pressure x P(real) x P(not complete) x tightness x remaining, damped by the
    immediate move in percent; unknown without a flow pressure."""
    p_real = F.coalesce(nonzero("prob_real"), F.lit(0.5))
    open_flow = F.coalesce("prob_not_complete", F.lit(1.0))
    remaining = F.greatest(F.lit(0.0), F.coalesce("expected_remaining_flow", F.lit(1.0)))
    damp = F.greatest(F.lit(1.0), F.abs(F.coalesce("immediate_reaction", F.lit(0.0))) * 100.0)
    tight = F.coalesce("liquidity_tightness", F.lit(0.0))
    return F.abs("flow_pressure") * p_real * open_flow * tight * remaining / damp


def enrich_events(
    events: DataFrame, bars: DataFrame, as_of: str | None = None, priced: DataFrame | None = None
) -> DataFrame:
    """Flow fields, study windows and opportunity score of every event (FE4, RS5)."""
    return measure_events(attach_bars(events, bars, priced), as_of)


def measure_events(events: DataFrame, as_of: str | None = None) -> DataFrame:
    """The same of events with attached bars: columns of one row only."""
    sized = estimate_flows(events, as_of)
    return study_events(sized).withColumn("delayed_flow_opportunity_score", opportunity_score())
