"""Registered queries that land the given tables as files and read them back.

Each writes to a fresh folder of the shared folder through the sinks, and reads through the
sources, so that both ends are compared with the tables the files came from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diagnostics
from ..schemas import BARS
from ..session import scratch_path
from ..sources import payloads, tables

FIRST, LAST = "1995-06-01", "1997-03-31"


def csv_bars(lab) -> DataFrame:
    """IO1, IO2: bars through CSV."""
    path = tables.write_csv(lab.lazy_bars(), scratch_path(lab.spark, "csv-bars"))
    return tables.read_csv(lab.spark, path, BARS)


def json_bars(lab) -> DataFrame:
    """IO4, IO13: bars as a vendor's JSON records."""
    records = lab.lazy_bars().withColumnRenamed("adj_close", "adjClose").drop("dollar_volume")
    path = tables.write_json(records, scratch_path(lab.spark, "json-bars"))
    return payloads.bars_from_payload(tables.read_json(lab.spark, path, multi_line=False))


def bars_between(lab) -> DataFrame:
    """IO11: a date range of the bars stored by year."""
    path = tables.write_bars(lab.lazy_bars(), scratch_path(lab.spark, "bars-by-year"))
    return tables.read_bars(lab.spark, path, FIRST, LAST)


def saved_snapshots(lab) -> DataFrame:
    """IO5, IO6: snapshots by product and date; one date arrives a second time and replaces itself."""
    path = scratch_path(lab.spark, "snapshots")
    tables.save_snapshots(lab.lazy_holdings(), path)
    tables.save_snapshots(lab.lazy_holdings().where(F.col("as_of_date") == F.lit("1996-12-31").cast("date")), path)
    out = tables.read_snapshots(lab.spark, path)
    return out.select("product_ticker", "as_of_date", "constituent_ticker", "constituent_name", "weight_pct", "shares", "market_value")


def payload_profiles(lab) -> DataFrame:
    """IO14: profiles under a vendor's field names."""
    raw = lab.profiles().select(
        "symbol", F.col("company_name").alias("companyName"), "sector", "industry", F.col("market_cap").alias("mktCap"), "price",
        F.col("exchange").alias("exchangeShortName"), "country",
    )
    path = tables.write_json(raw, scratch_path(lab.spark, "profiles"))
    out = payloads.profiles_from_payload(tables.read_json(lab.spark, path, multi_line=False))
    return out.select("symbol", "company_name", "sector", "industry", "market_cap", "price")


def payload_market_caps(lab) -> DataFrame:
    """IO15: the whole history of market caps."""
    raw = lab.market_caps().withColumnRenamed("market_cap", "marketCap")
    path = tables.write_json(raw, scratch_path(lab.spark, "caps"))
    return payloads.market_caps_from_payload(tables.read_json(lab.spark, path, multi_line=False))


def payload_fund_holdings(lab) -> DataFrame:
    """IO16: fund holdings under a vendor's field names."""
    raw = lab.fund_holdings().withColumnsRenamed(
        {"weight_pct": "weightPercentage", "shares": "sharesNumber", "market_value": "marketValue"}
    )
    path = tables.write_json(raw, scratch_path(lab.spark, "fund-holdings"))
    out = payloads.fund_holdings_from_payload(tables.read_json(lab.spark, path, multi_line=False))
    return out.select("etf", "asset", "isin", "name", "weight_pct", "shares", "market_value")


def payload_changes(lab) -> DataFrame:
    """IO17: an addition and a deletion of one index and day share a record."""
    sides = lab.membership_changes().groupBy("index_name", "effective_date", "ticker").agg(
        F.max(F.when(F.col("action") == "ADD", F.col("ticker"))).alias("symbol"),
        F.max(F.when(F.col("action") == "DEL", F.col("ticker"))).alias("removedTicker"),
    )
    raw = sides.select(F.col("effective_date").cast("string").alias("date"), "symbol", "removedTicker", F.col("index_name").alias("reason"))
    path = tables.write_json(raw, scratch_path(lab.spark, "changes"))
    out = payloads.changes_from_payload(tables.read_json(lab.spark, path, multi_line=False), "All")
    return out.select("reason", "action", "ticker", "effective_date")


def announcement_files(lab) -> DataFrame:
    """IO20, SC23, SC24: announcements in files of two different headers."""
    path = scratch_path(lab.spark, "announcements")
    rows = lab.announcements()
    even = F.col("confidence") >= 0.6
    first = rows.where(even).select(
        "provider", "index_name", F.col("asx_ticker").alias("ticker"), "company_name", "action", "announcement_date", "effective_date", "source_url",
    )
    second = rows.where(~even).select(
        F.col("asx_ticker").alias("symbol"), F.col("action").alias("change"), F.col("index_name").alias("index"), F.col("announcement_date").alias("date"),
        F.col("source_url").alias("url"), F.col("effective_date").alias("eff_date"), "confidence",
    )
    for part in (first, second):
        part.write.mode("append").option("header", True).csv(path)
    out = tables.read_announcements(lab.spark, path)
    return out.select("provider", "index_name", "asx_ticker", "company_name", "announcement_date", "effective_date", "source_url", "confidence")


def saved_registry(lab) -> DataFrame:
    """IO19, IO22: the registry through its two report files."""
    path = scratch_path(lab.spark, "registry")
    tables.save_registry(lab.registry(), path)
    return tables.read_registry(lab.spark, path).select("product_ticker", "record_type", "product_name", "source", "aum", "confidence_score")


def manual_registry(lab) -> DataFrame:
    """IO18: the registry as hand-kept files, funds and indices under headers of their own."""
    path = scratch_path(lab.spark, "manual-registry")
    rows = lab.registry_rows()
    funds = rows.select(
        "aum", "product_ticker", "product_name", "issuer", "theme", F.lit("3, 6,x,12").alias("rebalance_months"), "asx_exposure_flag", F.lit("ignored").alias("remark"),
    )
    indices = rows.where("benchmark_index_name is not null").select(
        F.col("benchmark_index_name").alias("product_name"), F.col("product_ticker").alias("Product_Ticker"),
        F.when(F.col("aum").isNotNull(), F.lit("benchmark")).alias("record_type"), F.concat(F.lit('a "quoted", '), "theme").alias("theme"),
    )
    for part, sub in ((funds, "etf_registry"), (indices, "index_registry")):
        part.write.option("header", True).option("escape", '"').csv(f"{path}/{sub}")
    out = tables.read_manual_registry(lab.spark, path)
    return out.select(
        "record_type", "product_ticker", "product_name", "issuer", "theme", "aum", "asx_exposure_flag", "source",
        F.concat_ws(",", F.col("rebalance_months").cast("array<string>")).alias("months"),
    )


def hand_entered_events(lab) -> DataFrame:
    """IO21: custom events and overrides kept as files, patched on the events they name."""
    path = scratch_path(lab.spark, "hand-entered")
    patches = lab.overrides().groupBy("event_id").agg(F.max("effective_date").alias("effective_date"), F.max("notes").alias("notes"))
    tables.write_csv(patches.select("event_id", F.date_format("effective_date", "dd/MM/yyyy").alias("effective_date"), "notes"), path)
    return tables.read_overrides(lab.spark, path).select("event_id", "effective_date", "notes")


def scoreboard(lab) -> DataFrame:
    """AG13: strategies by mean return, with their place."""
    board = diagnostics.scoreboard(lab.ledger())
    return board.select("strategy", "n_trades", "avg_return")


QUERIES = {
    f.__name__: f
    for f in (
        csv_bars, json_bars, bars_between, saved_snapshots, payload_profiles, payload_market_caps, payload_fund_holdings, payload_changes,
        announcement_files, saved_registry, manual_registry, hand_entered_events, scoreboard,
    )
}
# Digits the compared columns are rounded to.
DIGITS = {c: 6 for c in ("open", "high", "low", "close", "adj_close", "vwap", "avg_return", "market_cap", "price", "confidence_score")} | {
    "dollar_volume": 3, "weight_pct": 8, "aum": 2, "market_value": 2, "confidence": 6,
}
