"""Ownership maps and trade screens (SN1-SN8, AG2-AG4, SO2-SO5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import (
    inflow_dollars,
    millions,
    nonzero,
    percent,
    safe_div,
    shares_outstanding,
    simple_return,
)
from ..functions.tickers import is_cash_line, vendor_symbol
from ..session import durable
from .asof import asof_join
from .bars import latest_bars, truncate_bars, with_positions
from .ordered import mean_rank

# Daily volume share a fund may trade, thin-name limit, rebound window and
# how far back deletions are looked for, momentum limit, size rule and currency rate.
EXIT_SHARE = 0.2
THIN_ADV = 2_000_000.0
REBOUND_BARS, REBOUND_LOOKBACK_DAYS = 10, 35
NOT_RALLIED_PERCENT = 3.0
MIN_BARS_FOR_MOMENTUM = 70
SIZE_RULE_USD = (30e6, 3e9)
AUD_USD = 0.66
RANK_BASIS = ["etf_pct_float", "days_to_exit_20pct_adv", "inflow5_buy_days", "n_etfs"]


def holding_edges(fund_holdings: DataFrame, funds: DataFrame, stocks_only: bool = False) -> DataFrame:
    """SC8, FL8: local holdings as (fund, stock) edges with the fund's assets.

    ``stocks_only`` also drops cash lines and holdings that are funds themselves.
    """
    edges = fund_holdings.withColumn("asx_ticker", vendor_symbol("asset", "isin")).where(
        F.col("asx_ticker").isNotNull()
    )
    if stocks_only:
        edges = edges.where(~is_cash_line("asx_ticker")).join(
            funds.select(F.col("etf").alias("asx_ticker")).distinct(), "asx_ticker", "left_anti"
        )
    return edges.join(funds.select("etf", "aum"), "etf", "left").withColumn(
        "inflow5_usd", inflow_dollars("weight_pct", "aum")
    )


def ownership(edges: DataFrame, list_limit: int | None = None) -> DataFrame:
    """AG2, AG3: funds, shares, value and inflow per stock.

    Edges are first reduced per (stock, fund), so the fund list holds each fund once and
    is bounded by the fund universe. With a limit only the first names of each stock leave a
    task: the engine keeps that many rows a stock before the shuffle, and again after it.
    """
    per_fund = edges.groupBy("asx_ticker", "etf").agg(
        F.min("name").alias("company"),
        F.sum("shares").alias("shares"),
        F.sum("market_value").alias("market_value"),
        F.sum("inflow5_usd").alias("inflow5_usd"),
    )
    listed_all = F.sort_array(F.collect_list("etf")).alias("etfs")

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0.0))

    sums = per_fund.groupBy("asx_ticker").agg(
        F.min("company").alias("company"),
        F.count(F.lit(1)).alias("n_etfs"),
        *([listed_all] if list_limit is None else []),
        total("shares").alias("etf_shares"),
        total("market_value").alias("etf_value_usd"),
        total("inflow5_usd").alias("inflow5_usd"),
    )
    if list_limit is None:
        return sums
    place = F.row_number().over(W.partitionBy("asx_ticker").orderBy("etf"))
    first = per_fund.select("asx_ticker", "etf", place.alias("__place")).where(F.col("__place") <= list_limit)
    return sums.join(first.groupBy("asx_ticker").agg(listed_all), "asx_ticker")


def with_market(owned: DataFrame, bars: DataFrame, profiles: DataFrame) -> DataFrame:
    """JN16: latest close, trailing liquidity and shares outstanding per stock."""
    last = latest_bars(bars).select(
        F.col("symbol").alias("asx_ticker"),
        F.col("close").alias("last_close_aud"),
        F.col("adv_shares").alias("adv_shares_63d"),
        F.col("adv_dollars").alias("adv_dollars_63d"),
    )
    size = profiles.select(
        F.col("symbol").alias("asx_ticker"),
        shares_outstanding("market_cap", "price").alias("shares_outstanding"),
    )
    return owned.join(last, "asx_ticker", "left").join(size, "asx_ticker", "left")


def forced_ownership_map(
    fund_holdings: DataFrame, funds: DataFrame, bars: DataFrame, profiles: DataFrame
) -> DataFrame:
    """SN1: value held, share of the company and days to exit at all or a fifth of ADV."""
    out = with_market(ownership(holding_edges(fund_holdings, funds)), bars, profiles)
    return out.withColumns(
        {
            "etf_pct_of_shares_out": safe_div("etf_shares", "shares_outstanding"),
            "days_to_exit_at_100pct_adv": safe_div("etf_shares", "adv_shares_63d"),
            "days_to_exit_at_20pct_adv": safe_div(
                "etf_shares", F.lit(EXIT_SHARE) * F.col("adv_shares_63d")
            ),
        }
    ).drop("inflow5_usd")


def forced_flow_scores(
    fund_holdings: DataFrame,
    funds: DataFrame,
    bars: DataFrame,
    profiles: DataFrame,
    stocks_only: bool = False,
    list_limit: int | None = None,
) -> DataFrame:
    """SN2 (SN3 with ``stocks_only`` and a list limit): rank-blended forced-flow score.

    Ranking reads the measures several times, so the per-stock table is written once.
    """
    owned = ownership(holding_edges(fund_holdings, funds, stocks_only), list_limit)
    out = with_market(owned, bars, profiles).withColumns(
        {
            "etf_pct_float": safe_div("etf_shares", "shares_outstanding"),
            "days_to_exit_20pct_adv": safe_div(
                "etf_shares", F.lit(EXIT_SHARE) * F.col("adv_shares_63d")
            ),
            "inflow5_buy_days": safe_div("inflow5_usd", "adv_dollars_63d"),
        }
    )
    return mean_rank(
        durable(out, "stock-flow"), "asx_ticker", RANK_BASIS, "forced_flow_score"
    )


def universal_ownership_map(
    fund_holdings: DataFrame,
    funds: DataFrame,
    bars: DataFrame,
    profiles: DataFrame,
    list_limit: int | None = None,
) -> DataFrame:
    """SN3: every fund, stocks only; all holding funds are listed unless a limit is given."""
    return forced_flow_scores(fund_holdings, funds, bars, profiles, True, list_limit)


def fund_universe(fund_holdings: DataFrame, funds: DataFrame, bars: DataFrame) -> DataFrame:
    """SN4, AG4, JN17: local and thin holdings per fund; funds without any keep zero."""
    liquidity = latest_bars(bars).select(
        F.col("symbol").alias("asx_ticker"), F.col("adv_dollars").alias("adv")
    )
    edges = holding_edges(fund_holdings, funds).join(liquidity, "asx_ticker", "left")
    counts = edges.groupBy("etf").agg(
        F.count(F.lit(1)).alias("n_asx"),
        F.countDistinct(F.when(F.col("adv") < THIN_ADV, F.col("asx_ticker"))).alias("n_thin_asx"),
    )
    return funds.join(counts, "etf", "left").select(
        "etf",
        "etf_name",
        millions("aum", 1).alias("aum_musd"),
        F.coalesce("n_asx", F.lit(0)).alias("n_asx"),
        F.coalesce("n_thin_asx", F.lit(0)).alias("n_thin_asx"),
    )


def deletion_rebounds(changes: DataFrame, bars: DataFrame, as_of: str) -> DataFrame:
    """SN5, WN16: recent index deletions and what is left of their rebound window.

    ``changes`` are membership rows, with ``security`` and ``reason`` where they are known;
    bars after ``as_of`` are not read. Live windows first, the longest remaining ahead.
    """
    for name in ("security", "reason"):
        if name not in changes.columns:
            changes = changes.withColumn(name, F.lit(None).cast("string"))
    day = F.lit(as_of).cast("date")
    recent = changes.where(
        (F.col("action") == "DEL")
        & F.col("effective_date").between(F.date_sub(day, REBOUND_LOOKBACK_DAYS), day)
    )
    known = with_positions(truncate_bars(bars, as_of)).withColumnRenamed("symbol", "ticker")
    found = asof_join(
        recent, known, "ticker", "effective_date", "date",
        {"close": "eff_close", "bar_no": "bar_no", "n_bars": "n_bars"},
    ).where(F.col("eff_close").isNotNull())
    last = known.where(F.col("bar_no") == F.col("n_bars")).select(
        "ticker", F.col("close").alias("last_close")
    )
    since = F.col("n_bars") - F.col("bar_no")
    out = found.join(last, "ticker").select(
        "ticker",
        "index_name",
        F.col("security").alias("removed_security"),
        "effective_date",
        since.alias("bars_since_effective"),
        F.greatest(F.lit(0).cast("long"), F.lit(REBOUND_BARS) - since).alias("days_left_in_window"),
        percent(simple_return("eff_close", "last_close"), 2).alias("ret_since_effective_pct"),
        "reason",
        (since <= REBOUND_BARS).alias("live"),
    )
    return out.orderBy(F.desc("live"), F.desc("days_left_in_window"), "ticker", "index_name", "effective_date")


def not_rallied(scored: DataFrame, bars: DataFrame, pool: int = 60, top_n: int = 25) -> DataFrame:
    """SN6, FL11, SO5: the strongest forced flow whose price has not moved yet."""
    strongest = scored.orderBy(F.desc_nulls_last("forced_flow_score"), "asx_ticker").limit(pool)
    last = latest_bars(bars).where(F.col("n_bars") >= MIN_BARS_FOR_MOMENTUM).select(
        F.col("symbol").alias("asx_ticker"),
        percent("mom_1m", 1).alias("mom_1m_pct"),
        percent("mom_3m", 1).alias("mom_3m_pct"),
    )
    out = strongest.join(last, "asx_ticker").select(
        "asx_ticker",
        "company",
        "n_etfs",
        percent("etf_pct_float", 1).alias("etf_pct_float_pct"),
        F.bround("days_to_exit_20pct_adv", 0).alias("days_to_exit_20pct_adv"),
        millions("adv_dollars_63d", 2).alias("adv_musd"),
        "mom_1m_pct",
        "mom_3m_pct",
        F.bround("forced_flow_score", 3).alias("forced_flow_score"),
        F.coalesce(F.col("mom_1m_pct") <= NOT_RALLIED_PERCENT, F.lit(False)).alias("not_rallied"),
    )
    return out.orderBy(
        F.desc("not_rallied"), F.desc_nulls_last("forced_flow_score"), "asx_ticker"
    ).limit(top_n)


def size_rule_candidates(
    watch: DataFrame, profiles: DataFrame, held: DataFrame, rate: float = AUD_USD
) -> DataFrame:
    """SN7, FL13, JN18: watched stocks inside the size rule that no fund holds yet."""
    already = held.select("asx_ticker").distinct().withColumn("__held", F.lit(True))
    size = profiles.select(
        F.col("symbol").alias("asx_ticker"),
        F.col("company_name").alias("company"),
        nonzero("market_cap").alias("__cap"),
    ).where(F.col("__cap").isNotNull())
    low, high = SIZE_RULE_USD
    in_range = (F.col("__cap") * rate).between(low, high)
    is_held = F.coalesce("__held", F.lit(False))
    return (
        watch.select(F.upper("asx_ticker").alias("asx_ticker"))
        .distinct()
        .join(size, "asx_ticker")
        .join(already, "asx_ticker", "left")
        .select(
            "asx_ticker",
            "company",
            F.bround(F.col("__cap") / 1e6, 0).alias("mcap_aud_m"),
            is_held.alias("already_held"),
            in_range.alias("fits_size_rule"),
            (~is_held & in_range).alias("candidate"),
        )
        .orderBy(F.desc("candidate"), F.desc("mcap_aud_m"), "asx_ticker")
    )


def open_opportunities(events: DataFrame, as_of: str | None = None) -> DataFrame:
    """FL6: tradeable, scored and not yet effective."""
    out = events.where(
        F.coalesce("tradeable_flag", F.lit(False))
        & F.col("delayed_flow_opportunity_score").isNotNull()
    )
    if as_of is not None:
        day = F.lit(as_of).cast("date")
        out = out.where(F.col("effective_date").isNull() | (F.col("effective_date") >= day))
    return out


def watchlist(events: DataFrame, as_of: str | None = None, top_n: int = 50) -> DataFrame:
    """SN8, SO2: the best open opportunities."""
    return open_opportunities(events, as_of).orderBy(
        F.desc("delayed_flow_opportunity_score"), "event_id"
    ).limit(top_n)
