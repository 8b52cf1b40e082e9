"""Trade resolution against bars, costs and the ledger (BT1-BT5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.costs import CostModel, net_return
from ..schemas import LEDGER_COLUMNS
from ..session import durable, joins_in_place
from .asof import at_position
from .bars import with_positions
from .flow import attach_bars, priced_points
from .strategies import Strategy, enabled_strategies, generate_trades

CAPITAL = 100_000.0


# What resolving a trade reads from its event.
EVENT_CONTEXT = [
    "a_listed", "a_bar_no", "a_n_bars", "a_next_date", "a_next_open", "a_next_close", "a_next_vwap",
    "a_entry_adv_dollars", "e_bar_no", "theme", "provider", "market_cap",
]


def _with_context(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Events that carry the bar columns and every context column."""
    source = events
    if "a_bar_no" not in events.columns:
        # the bars of both dates once, with what a trade reads only; all lookups are by stock
        read = list(dict.fromkeys(c[2:] for c in EVENT_CONTEXT if c[:2] in ("a_", "e_") and c != "a_listed"))
        with joins_in_place(events.sparkSession):
            priced = durable(priced_points(events, bars, read), "trade-bars")
        source = attach_bars(events, bars, priced)
    for name in ("theme", "provider"):
        if name not in source.columns:
            source = source.withColumn(name, F.lit(None).cast("string"))
    if "market_cap" not in source.columns:
        source = source.withColumn("market_cap", F.lit(None).cast("double"))
    return source


def backtest_trades(
    trades: DataFrame,
    events: DataFrame,
    bars: DataFrame,
    costs: CostModel | None = None,
    capital: float = CAPITAL,
) -> DataFrame:
    """BT1: every given trade as an executed or rejected ledger row (JN12)."""
    meta = _with_context(events, bars).select(
        F.col("event_id").alias("__id"), F.lit(True).alias("has_event"), *EVENT_CONTEXT
    )
    joined = trades.join(meta, F.col("event_id") == F.col("__id"), "left").withColumn(
        "has_event", F.coalesce("has_event", F.lit(False))
    )
    return resolve_trades(joined, bars, costs, capital)


def resolve_trades(
    t: DataFrame, bars: DataFrame, costs: CostModel | None = None, capital: float = CAPITAL
) -> DataFrame:
    """Price trades that carry their event context; exit bars come by an equi-join on
    (symbol, bar_no), so a hot symbol spreads over its positions."""
    costs = costs or CostModel()
    entry_pos = F.col("a_bar_no") + 1
    priced = (
        F.when(F.col("entry_ref") == "next_close", F.col("a_next_close"))
        .when(F.col("entry_ref") == "vwap_proxy", F.col("a_next_vwap"))
        .otherwise(F.col("a_next_open"))
    )
    hold_end = entry_pos + F.col("max_hold_days")
    kind = F.split_part("exit_spec", F.lit(":"), F.lit(1))
    offset = F.try_element_at(F.split("exit_spec", ":"), F.lit(2)).try_cast("int")
    planned = (
        F.when(kind == "plus", entry_pos + offset)
        .when(F.col("e_bar_no").isNull(), hold_end)
        .when(kind == "eff_close_plus", F.col("e_bar_no") + offset)
        .otherwise(F.col("e_bar_no"))
    )
    # An exit that does not follow the entry is replaced by the holding limit.
    exit_pos = F.when(planned > entry_pos, planned).otherwise(F.least(hold_end, F.col("a_n_bars")))
    t = t.withColumns({"__entry_pos": entry_pos, "entry_price": priced, "__exit_pos": exit_pos})

    positioned = with_positions(bars.select("symbol", "date", "close"))
    t = at_position(
        t, positioned, "asx_ticker", "__exit_pos", {"close": "exit_price", "date": "exit_date"}
    )
    t = t.withColumn("__cost", costs.breakdown(F.lit(capital), "a_entry_adv_dollars")).withColumn(
        "__harsh", costs.breakdown(F.lit(capital), "a_entry_adv_dollars", harsh=True)
    )
    no_symbol = F.coalesce("asx_ticker", F.lit("")) == ""
    reason = (
        F.when(~F.col("has_event") | no_symbol, "no_event_or_symbol")
        .when(~F.coalesce("a_listed", F.lit(False)), "no_prices")
        .when(F.col("a_bar_no").isNull(), "no_bar_at_announcement")
        .when(F.coalesce(F.col("entry_price") <= 0, F.lit(True)), "no_entry_bar")
        .when(F.col("exit_price").isNull(), "no_exit_bar")
        .when(F.col("__cost.round_trip_bps").isNull(), "no_liquidity")
        .otherwise("")
    )
    t = t.withColumn("reject_reason", reason).withColumn("rejected", F.col("reject_reason") != "")
    t = t.withColumn(
        "gross_return",
        F.col("direction") * (F.col("exit_price") / F.col("entry_price") - 1.0),
    )

    def done(c):
        return F.when(~F.col("rejected"), c)

    net = net_return("gross_return", "__cost.round_trip_bps")
    has_event = F.col("has_event") & ~no_symbol
    out = t.select(
        "strategy",
        "event_id",
        "asx_ticker",
        "direction",
        done(F.col("a_next_date")).alias("entry_date"),
        done(F.col("entry_price")).alias("entry_price"),
        done(F.col("exit_date")).alias("exit_date"),
        done(F.col("exit_price")).alias("exit_price"),
        done(F.col("gross_return")).alias("gross_return"),
        done(F.col("a_entry_adv_dollars")).alias("adv_dollars"),
        done(F.col("__cost.participation")).alias("participation"),
        done(F.col("__cost.capped")).alias("capped"),
        done(F.col("__cost.executable_value")).alias("executable_value"),
        done(F.col("__cost.round_trip_bps")).alias("cost_bps_roundtrip"),
        done(net).alias("net_return"),
        done(net_return("gross_return", "__harsh.round_trip_bps")).alias("harsh_net_return"),
        done((F.col("__exit_pos") - F.col("__entry_pos")).cast("long")).alias("exposure_days"),
        F.lit(capital).alias("capital"),
        done(net * F.lit(capital)).alias("pnl_net"),
        "rejected",
        "reject_reason",
        done(F.year("a_next_date")).alias("year"),
        F.when(has_event, F.col("theme")).alias("theme"),
        F.when(has_event, F.col("provider")).alias("provider"),
        F.when(has_event, F.col("market_cap")).alias("market_cap"),
    )
    return out.select(*LEDGER_COLUMNS)


def run_strategies(
    events: DataFrame, bars: DataFrame, strategies: list[Strategy] | None = None, **kwargs
) -> DataFrame:
    """BT5: trades of all strategies resolved together: one as-of pass, one exit join."""
    chosen = enabled_strategies() if strategies is None else strategies
    context = _with_context(events, bars).withColumn("has_event", F.lit(True))
    trades = generate_trades(context, chosen, ["has_event", *EVENT_CONTEXT])
    return resolve_trades(trades, bars, **kwargs)


def executed(ledger: DataFrame) -> DataFrame:
    """FL4: an unknown rejection flag counts as rejected."""
    return ledger.where(~F.coalesce("rejected", F.lit(True)))
