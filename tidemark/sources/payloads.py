"""Landed vendor JSON payloads to domain tables (IO13-IO17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import any_date, clean
from ..operators.bars import fill_bar_columns
from ..schemas import (
    BARS,
    FUND_HOLDINGS,
    FUNDS,
    MARKET_CAP_HISTORY,
    MEMBERSHIP_CHANGES,
    PROFILES,
    conform,
)


def read_payload(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """IO4: JSON arrays or lines of records."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def _field(df: DataFrame, *names: str) -> Column:
    """First of several spellings that is present and not NULL."""
    have = [F.col(f"`{n}`") for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None)


def _number(df: DataFrame, *names: str) -> Column:
    return clean(_field(df, *names).try_cast("double"))


def bars_from_payload(raw: DataFrame) -> DataFrame:
    """IO13: rename, parse dates, drop undated rows, default the derivable columns."""
    picked = raw.select(
        _field(raw, "symbol").cast("string").alias("symbol"),
        any_date(_field(raw, "date")).alias("date"),
        *[_number(raw, c).alias(c) for c in ("open", "high", "low", "close")],
        _number(raw, "adjClose", "adj_close").alias("adj_close"),
        _number(raw, "volume").alias("volume"),
        _number(raw, "vwap").alias("vwap"),
    )
    return conform(fill_bar_columns(picked), BARS)


def profiles_from_payload(raw: DataFrame) -> DataFrame:
    """IO14: company profiles with the older field names as fallbacks."""
    return conform(
        raw.select(
            _field(raw, "symbol").alias("symbol"),
            _field(raw, "companyName").alias("company_name"),
            _field(raw, "sector").alias("sector"),
            _field(raw, "industry").alias("industry"),
            _number(raw, "marketCap", "mktCap").alias("market_cap"),
            _number(raw, "price").alias("price"),
            _field(raw, "exchange", "exchangeShortName").alias("exchange"),
            _field(raw, "currency").alias("currency"),
            _field(raw, "country").alias("country"),
            _field(raw, "isEtf").alias("is_etf"),
            _field(raw, "isActivelyTrading").alias("is_active"),
            _number(raw, "averageVolume", "volAvg").alias("avg_volume"),
        ),
        PROFILES,
    )


def market_caps_from_payload(raw: DataFrame, newest: int | None = None) -> DataFrame:
    """IO15: dated market caps; all of them, or the newest ``newest`` per symbol if asked for."""
    out = conform(
        raw.select(
            _field(raw, "symbol").alias("symbol"),
            any_date(_field(raw, "date")).alias("date"),
            _number(raw, "marketCap", "market_cap").alias("market_cap"),
        ),
        MARKET_CAP_HISTORY,
    ).where(F.col("date").isNotNull())
    if newest is None:
        return out
    order = W.partitionBy("symbol").orderBy(F.desc("date"))
    return out.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= newest).drop("__n")


def fund_holdings_from_payload(raw: DataFrame) -> DataFrame:
    """IO16: current fund holdings."""
    return conform(
        raw.select(
            _field(raw, "etf", "symbol").alias("etf"),
            _field(raw, "asset").alias("asset"),
            _field(raw, "isin").alias("isin"),
            _field(raw, "name").alias("name"),
            _number(raw, "weightPercentage", "weight_pct").alias("weight_pct"),
            _number(raw, "sharesNumber", "shares").alias("shares"),
            _number(raw, "marketValue", "market_value").alias("market_value"),
        ),
        FUND_HOLDINGS,
    )


def funds_from_payload(fund_list: DataFrame, fund_info: DataFrame | None = None) -> DataFrame:
    """IO17, ST5: the fund list with assets from the fund info payload."""
    funds = fund_list.select(
        F.upper(_field(fund_list, "symbol")).alias("etf"), _field(fund_list, "name").alias("etf_name")
    )
    if fund_info is None:
        return conform(funds, FUNDS)
    info = fund_info.groupBy(F.upper(_field(fund_info, "symbol")).alias("etf")).agg(
        F.max(_number(fund_info, "assetsUnderManagement", "aum")).alias("aum")
    )
    return conform(funds.join(info, "etf", "left"), FUNDS)


def listed_funds(funds: DataFrame, suffix: str = ".AX") -> DataFrame:
    return funds.where(F.col("etf").endswith(suffix))


def changes_from_payload(raw: DataFrame, index_name: str, market: str = "US") -> DataFrame:
    """IO17: a membership row yields an addition, a deletion, or both."""
    rows = F.array(
        F.struct(
            F.lit("ADD").alias("action"),
            F.upper(F.trim(_field(raw, "symbol").cast("string"))).alias("ticker"),
            _field(raw, "addedSecurity").cast("string").alias("security"),
        ),
        F.struct(
            F.lit("DEL").alias("action"),
            F.upper(F.trim(_field(raw, "removedTicker").cast("string"))).alias("ticker"),
            _field(raw, "removedSecurity").cast("string").alias("security"),
        ),
    )
    day = F.try_to_timestamp(F.left(_field(raw, "date").cast("string"), F.lit(10)), F.lit("yyyy-MM-dd"))
    return conform(
        raw.select(
            F.lit(index_name).alias("index_name"),
            F.lit(market).alias("market"),
            day.cast("date").alias("effective_date"),
            _field(raw, "reason").alias("reason"),
            F.explode(rows).alias("r"),
        )
        .select("*", "r.*")
        .where(F.col("effective_date").isNotNull() & (F.coalesce("ticker", F.lit("")) != "")),
        MEMBERSHIP_CHANGES,
    )
