"""Table schemas shared by readers, operators and sinks."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _F, _B, _L, _I = (
    T.StringType(),
    T.DateType(),
    T.DoubleType(),
    T.BooleanType(),
    T.LongType(),
    T.IntegerType(),
)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


BARS = _table(
    symbol=_S, date=_D, open=_F, high=_F, low=_F, close=_F, adj_close=_F, volume=_F, vwap=_F,
    dollar_volume=_F,
)
HOLDINGS = _table(
    product_ticker=_S, as_of_date=_D, constituent_ticker=_S, constituent_name=_S, exchange=_S,
    weight_pct=_F, shares=_F, market_value=_F, source=_S,
)
DIFF_COLUMNS = [
    "product_ticker", "prev_date", "as_of_date", "constituent_ticker", "constituent_name",
    "exchange", "change_type", "old_weight", "new_weight", "weight_delta", "old_shares",
    "new_shares", "shares_delta",
]
ANNOUNCEMENTS = _table(
    provider=_S, index_name=_S, asx_ticker=_S, company_name=_S, action=_S, announcement_date=_D,
    effective_date=_D, source_url=_S, confidence=_F, needs_verification=_B,
)
EVENTS = _table(
    event_id=_S, source_type=_S, provider=_S, issuer=_S, etf_index_name=_S, benchmark=_S,
    asx_ticker=_S, company_name=_S, event_type=_S, announcement_date=_D, detected_date=_D,
    effective_date=_D, old_weight=_F, new_weight=_F, estimated_buy_sell_dollars=_F, adv_dollars=_F,
    flow_pressure=_F, immediate_reaction=_F, delayed_return=_F, underreaction_score=_F,
    tradeable_flag=_B, confidence_score=_F, source_url_or_file=_S, notes=_S,
)
EVENT_HELPERS = _table(
    product_ticker=_S, shares_delta=_F, weight_delta=_F, aum=_F, theme=_S, n_holdings=_F
)
# Base events carry the identifying columns and helpers; measures are added later.
EVENT_MEASURES = (
    "estimated_buy_sell_dollars", "adv_dollars", "flow_pressure", "immediate_reaction",
    "delayed_return", "underreaction_score", "tradeable_flag",
)
BASE_EVENTS = T.StructType(
    [f for f in EVENTS.fields if f.name not in EVENT_MEASURES] + EVENT_HELPERS.fields
)
CANONICAL_EVENT_OUTPUT = [*EVENTS.fieldNames(), "delayed_flow_opportunity_score"]
REGISTRY = _table(
    record_type=_S, product_ticker=_S, product_name=_S, issuer=_S, exchange=_S,
    benchmark_index_name=_S, index_provider=_S, theme=_S, region=_S, methodology_url=_S,
    holdings_url=_S, holdings_file_type=_S, holdings_update_frequency=_S, rebalance_frequency=_S,
    reconstitution_frequency=_S, rebalance_months=T.ArrayType(_I), announcement_source=_S, aum=_F,
    management_fee=_F, number_of_holdings=_F, max_weight_rules=_S, liquidity_rules=_S,
    market_cap_rules=_S, weighting_scheme=_S, asx_exposure_flag=_B, current_asx_holdings_count=_F,
    historical_data_available_flag=_B, source=_S, confidence_score=_F,
)
TRADE_COLUMNS = [
    "strategy", "event_id", "asx_ticker", "direction", "entry_ref", "exit_spec", "max_hold_days",
    "selection_notes",
]
LEDGER_COLUMNS = [
    "strategy", "event_id", "asx_ticker", "direction", "entry_date", "entry_price", "exit_date",
    "exit_price", "gross_return", "adv_dollars", "participation", "capped", "executable_value",
    "cost_bps_roundtrip", "net_return", "harsh_net_return", "exposure_days", "capital", "pnl_net",
    "rejected", "reject_reason", "year", "theme", "provider", "market_cap",
]
PROFILES = _table(
    symbol=_S, company_name=_S, sector=_S, industry=_S, market_cap=_F, price=_F, exchange=_S,
    currency=_S, country=_S, is_etf=_B, is_active=_B, avg_volume=_F,
)
MARKET_CAP_HISTORY = _table(symbol=_S, date=_D, market_cap=_F)
FUND_HOLDINGS = _table(
    etf=_S, asset=_S, isin=_S, name=_S, weight_pct=_F, shares=_F, market_value=_F
)
FUNDS = _table(etf=_S, etf_name=_S, aum=_F)
MEMBERSHIP_CHANGES = _table(
    index_name=_S, market=_S, action=_S, ticker=_S, effective_date=_D, security=_S, reason=_S
)
TRIAL_LOG = _table(
    iteration=_I, timestamp=_S, hypothesis=_S, outcome=_S, objective=_F, best_before=_F, n_trades=_I, claim_alpha=_B
)


def empty(spark, schema: T.StructType):
    return spark.createDataFrame([], schema)


def conform(df, schema: T.StructType):
    """Select the schema's columns in order, casting, with NULL for absent ones."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
