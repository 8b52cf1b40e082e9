"""Point-in-time feature matrix and labels (FT1, FT2, LB1, SC19, AG6, JN8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.costs import CostModel
from .asof import asof_join
from .bars import MOMENTUM_BARS
from .flow import reference_date

# Providers whose changes everybody watches, and obscurity by source.
MAJOR_PROVIDERS = ("S&P", "MSCI", "FTSE", "DOW", "NASDAQ", "RUSSELL")
MAJOR_OBSCURITY, HOLDINGS_OBSCURITY, OTHER_OBSCURITY = 0.15, 0.75, 0.5

FEATURE_COLUMNS = [
    "market_cap", "adv_dollars", "dollar_volume", "spread_proxy_bps", "volatility", "mom_1m",
    "mom_3m", "mom_6m", "mom_12m", "recent_runup_1m", "volume_shock", "sector", "industry", "theme",
    "fund_aum", "number_of_holdings", "expected_buy_dollars", "flow_pressure",
    "n_products_holding", "peer_inclusion_count", "prior_index_membership", "immediate_reaction",
    "days_to_effective", "source_obscurity_score", "news_coverage_score",
]
LABEL_COLUMNS = [
    "label_underreaction", "label_delayed_positive", "label_delayed_return", "label_tradeable_winner",
]


def source_obscurity() -> Column:
    """SC19: 0 for a widely covered index change, 1 for an obscure one."""
    provider = F.upper(F.coalesce("provider", F.lit("")))
    base = (
        F.when(provider.rlike("|".join(MAJOR_PROVIDERS)), MAJOR_OBSCURITY)
        .when(F.col("source_type") == "holdings_diff", HOLDINGS_OBSCURITY)
        .otherwise(OTHER_OBSCURITY)
    )
    doubt = F.least(F.lit(1.0), base + 0.2 * (1.0 - F.col("confidence_score")))
    return F.round(F.coalesce(F.when(F.col("confidence_score").isNotNull(), doubt), base), 3)


def events_per_ticker(events: DataFrame) -> DataFrame:
    """AG6, AG22: distinct events per stock."""
    return events.groupBy("asx_ticker").agg(F.countDistinct("event_id").alias("n_events"))


def attach_fundamentals(
    events: DataFrame,
    market_caps: DataFrame | None,
    profiles: DataFrame | None,
    allow_current_profile: bool = False,
    base: DataFrame | None = None,
) -> DataFrame:
    """JN8: market cap known at the reference date, sector and industry.

    Today's profile value is not known at the event date, so it fills a missing market
    cap only when ``allow_current_profile`` asks for the looser reading.
    """
    out = events
    if "ref_date" not in out.columns:
        out = out.withColumn("ref_date", reference_date())
    if market_caps is not None:
        caps = market_caps.withColumnRenamed("symbol", "asx_ticker")
        points = None if base is None else base.withColumn("ref_date", reference_date())
        out = asof_join(
            out, caps, "asx_ticker", "ref_date", "date", ["market_cap"], points=points
        )
    else:
        out = out.withColumn("market_cap", F.lit(None).cast("double"))
    if profiles is None:
        return out.withColumns(
            {c: F.lit(None).cast("string") for c in ("sector", "industry")}
        )
    side = profiles.select(
        F.col("symbol").alias("asx_ticker"), "sector", "industry",
        F.col("market_cap").alias("__profile_cap"),
    )
    out = out.join(side, "asx_ticker", "left")
    if allow_current_profile:
        out = out.withColumn("market_cap", F.coalesce("market_cap", "__profile_cap"))
    return out.drop("__profile_cap")


def with_features(
    enriched: DataFrame,
    market_caps: DataFrame | None = None,
    profiles: DataFrame | None = None,
    allow_current_profile: bool = False,
    base: DataFrame | None = None,
) -> DataFrame:
    """Events plus the 25 feature columns; price features are as of the reference date.

    ``base`` is the event table ``enriched`` was made from: lookups and counts read it
    instead of running the enrichment once more.
    """
    return feature_columns(attach_lookups(enriched, market_caps, profiles, allow_current_profile, base))


def attach_lookups(
    events: DataFrame,
    market_caps: DataFrame | None = None,
    profiles: DataFrame | None = None,
    allow_current_profile: bool = False,
    base: DataFrame | None = None,
) -> DataFrame:
    """What the features join: fundamentals, and ``n_stock_events``, the events of the stock."""
    source = events if base is None else base
    counts = events_per_ticker(source).withColumnRenamed("n_events", "n_stock_events")
    out = attach_fundamentals(events, market_caps, profiles, allow_current_profile, base)
    return out.join(counts, "asx_ticker", "left")


def stock_day_facts(events: DataFrame, market_caps: DataFrame, stacks: DataFrame) -> DataFrame:
    """Market cap, ``n_stock_events`` and stack count of every (stock, reference date) of the events.

    ``stacks`` is ``strategies.stock_stacks`` of them as a written table.
    """
    points = events.select("asx_ticker", reference_date().alias("ref_date")).distinct()
    out = attach_lookups(points, market_caps, base=events).drop("sector", "industry")
    return out.join(stacks.withColumnRenamed("__day", "ref_date").hint("shuffle_hash"), ["asx_ticker", "ref_date"], "left")


def attach_facts(events: DataFrame, facts: DataFrame, profiles: DataFrame) -> DataFrame:
    """``stock_day_facts`` as a written table, and the profiles, on events with a reference date."""
    side = facts.withColumnsRenamed({"asx_ticker": "__sym", "ref_date": "__day"})
    # an event without a date has the counts of its stock
    same = (F.col("asx_ticker") == F.col("__sym")) & F.col("ref_date").eqNullSafe(F.col("__day"))
    out = events.join(side.hint("shuffle_hash"), same, "left").drop("__sym", "__day")
    return attach_fundamentals(out.withColumnRenamed("market_cap", "__cap"), None, profiles).drop("market_cap").withColumnRenamed("__cap", "market_cap")


def feature_columns(events: DataFrame) -> DataFrame:
    """The feature columns of measured events with lookups, row by row."""
    known = F.when(F.col("asx_ticker").isNotNull(), F.coalesce("n_stock_events", F.lit(1)))
    return events.withColumns(
        {
            "dollar_volume": F.col("a_dollar_volume"),
            "spread_proxy_bps": F.col("a_spread_proxy_bps"),
            "volatility": F.col("a_volatility"),
            **{m: F.col(f"a_{m}") for m in MOMENTUM_BARS},
            "recent_runup_1m": F.col("a_mom_1m"),
            "volume_shock": F.col("a_volume_shock"),
            "fund_aum": F.col("aum"),
            "number_of_holdings": F.col("n_holdings"),
            "expected_buy_dollars": F.col("estimated_buy_sell_dollars"),
            "n_products_holding": known,
            "peer_inclusion_count": known,
            "prior_index_membership": F.lit(None).cast("double"),
            "days_to_effective": F.datediff(
                "effective_date", F.coalesce("entry_date", reference_date())
            ),
            "source_obscurity_score": source_obscurity(),
            "news_coverage_score": F.lit(None).cast("double"),
        }
    ).drop("n_stock_events")


def feature_matrix(events_with_features: DataFrame) -> DataFrame:
    return events_with_features.select("event_id", *FEATURE_COLUMNS)


def labels(
    events: DataFrame, immediate_threshold: float = 0.03, drift_hurdle: float | None = None
) -> DataFrame:
    """LB1: under-reaction, cost-beating drift, raw drift, tradeable winner."""
    hurdle = CostModel().drift_hurdle() if drift_hurdle is None else drift_hurdle
    imm, drift = F.col("immediate_reaction"), F.col("delayed_return")
    beats = drift > F.lit(hurdle)
    tradeable = F.coalesce("tradeable_flag", F.lit(False))

    def flag(known: Column, hit: Column) -> Column:
        return F.when(known.isNotNull(), hit.cast("int"))

    return events.select(
        "event_id",
        flag(imm, F.abs(imm) <= immediate_threshold).alias("label_underreaction"),
        flag(drift, beats).alias("label_delayed_positive"),
        drift.alias("label_delayed_return"),
        flag(drift, tradeable & beats).alias("label_tradeable_winner"),
    )
