"""Domain tables derived from the star-schema test tables.

Suppliers play stocks, brands play funds, order lines play ticks and holdings, orders
play index announcements. A stock's code is its supplier key plus ten.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import clean
from ..operators.bars import bars_from_ticks
from ..operators.registry import with_confidence
from ..operators.snapshots import DEALT, dealt_by
from ..schemas import ANNOUNCEMENTS, MARKET_CAP_HISTORY, PROFILES, REGISTRY, conform

# Index providers given to brands and customer-number spacing per stock.
PROVIDERS = ("S&P Dow Jones Indices", "MSCI", "MarketVector", "Solactive")
CUSTOMERS_PER_STOCK = 15
UNLISTED_EVERY = 97


def stock_code(supplier_key: Column) -> Column:
    return (supplier_key + 10).cast("string")


def stock_symbol(supplier_key: Column) -> Column:
    return F.concat(stock_code(supplier_key), F.lit(".AX"))


def _spelled(supplier_key: Column) -> Column:
    """A stock's code in one of several vendor spellings."""
    code, form = stock_code(supplier_key), supplier_key % 6
    return (
        F.when(form == 0, F.concat(code, F.lit(".AX")))
        .when(form == 1, F.concat(code, F.lit(" AU")))
        .when(form == 2, F.concat(F.lit("ASX:"), code))
        .when(form == 3, F.concat(code, F.lit("-AU")))
        .when(form == 4, F.concat(code, F.lit(" AU Equity")))
        .otherwise(F.concat(code, F.lit(" LN")))
    )


def _stock_name(supplier_key: Column) -> Column:
    return F.concat(F.lit("Stock "), supplier_key.cast("string"))


def _order_symbol() -> Column:
    """Stock of an order; every 97th customer trades an unlisted one."""
    customer = F.col("o_custkey")
    listed = stock_symbol(F.floor(customer / CUSTOMERS_PER_STOCK).cast("long"))
    return F.when(customer % UNLISTED_EVERY == 0, F.lit("ZZZ.AX")).otherwise(listed)


@dataclass(frozen=True)
class StarSchema:
    """Lazy accessors of one scale-factor folder."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def ticks(self) -> DataFrame:
        return self.table("lineitem").select(
            stock_symbol(F.col("l_suppkey")).alias("symbol"),
            F.to_date("l_shipdate").alias("day"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            "l_quantity",
            "l_orderkey",
            "l_linenumber",
        )

    def bars(self) -> DataFrame:
        return self.bars_of(self.ticks())

    def bars_of(self, ticks: DataFrame) -> DataFrame:
        return bars_from_ticks(
            ticks, "symbol", F.col("day"), "price", F.col("l_quantity"), ["l_orderkey", "l_linenumber"]
        )

    def benchmark_bars(self) -> DataFrame:
        """Market average close per day, for both markets of the membership study."""
        daily = self.bars().groupBy("date").agg(F.avg("close").alias("close"))
        return daily.select(
            F.explode(F.array(F.lit("US"), F.lit("ASX"))).alias("market"), "date", "close"
        )

    def fund_lines(self) -> DataFrame:
        """Order lines as trades of their brand, dated to the end of the quarter."""
        return (
            self.table("lineitem")
            .join(self.table("part").select("p_partkey", "p_brand"), F.expr("l_partkey = p_partkey"))
            .select(
                F.col("p_brand").alias("product_ticker"),
                F.last_day(
                    F.add_months(F.trunc("l_shipdate", "quarter"), 2)
                ).alias("as_of_date"),
                "l_suppkey",
                "l_quantity",
                "l_extendedprice",
            )
        )

    def _held(self) -> DataFrame:
        """Quarter-end position of every (brand, supplier) and its brand's total."""
        held = self.fund_lines().groupBy("product_ticker", "as_of_date", "l_suppkey").agg(
            F.sum("l_quantity").alias("shares"), F.sum("l_extendedprice").alias("market_value")
        )
        of_fund = Window.partitionBy("product_ticker", "as_of_date")
        return held.withColumn("fund_value", F.sum("market_value").over(of_fund))

    def holdings(self) -> DataFrame:
        """Quarter-end snapshots; tickers come in several vendor spellings."""
        return self._snapshots(self._held())

    def fund_values(self) -> DataFrame:
        """Total of every brand and quarter."""
        return self.fund_lines().groupBy("product_ticker", "as_of_date").agg(F.sum("l_extendedprice").alias("fund_value"))

    def lines_by_stock(self, parts: int) -> DataFrame:
        """``fund_lines`` dealt by the stock of their holdings line."""
        key = F.col("l_suppkey")
        return self.fund_lines().withColumn(DEALT, dealt_by(_spelled(key), _stock_name(key))).repartition(parts, DEALT)

    def holdings_of(self, lines: DataFrame, values: DataFrame) -> DataFrame:
        """``holdings`` of lines dealt by stock, which stay there; ``values`` are the written ``fund_values``."""
        held = lines.groupBy(DEALT, "product_ticker", "as_of_date", "l_suppkey").agg(
            F.sum("l_quantity").alias("shares"), F.sum("l_extendedprice").alias("market_value")
        )
        of_fund = values.select(F.col("product_ticker").alias("__fund"), F.col("as_of_date").alias("__day"), "fund_value")
        same = F.col("product_ticker").eqNullSafe(F.col("__fund")) & F.col("as_of_date").eqNullSafe(F.col("__day"))
        return self._snapshots(held.join(of_fund, same, "left"), DEALT)

    def _snapshots(self, held: DataFrame, *kept: str) -> DataFrame:
        return held.select(
            *kept,
            F.upper("product_ticker").alias("product_ticker"),
            "as_of_date",
            _spelled(F.col("l_suppkey")).alias("constituent_ticker"),
            _stock_name(F.col("l_suppkey")).alias("constituent_name"),
            F.lit(None).cast("string").alias("exchange"),
            (F.col("market_value") / F.col("fund_value")).alias("weight_pct"),
            "shares",
            "market_value",
            F.lit("manual").alias("source"),
        )

    def registry_rows(self) -> DataFrame:
        """Unscored registry rows, one per brand."""
        number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
        brands = self.table("part").groupBy("p_brand").agg(
            (F.sum("p_retailprice") * 10000.0).alias("aum"),
            F.min("p_type").alias("theme"),
            F.count(F.lit(1)).cast("double").alias("number_of_holdings"),
        )
        providers = F.array(*[F.lit(p) for p in PROVIDERS])
        return conform(
            brands.select(
                F.lit("etf").alias("record_type"),
                F.upper("p_brand").alias("product_ticker"),
                F.concat(F.col("p_brand"), F.lit(" Fund")).alias("product_name"),
                F.when(number % 2 == 0, F.lit("Issuer A")).alias("issuer"),
                F.when(number % 3 == 0, F.concat(F.col("p_brand"), F.lit(" Index"))).alias(
                    "benchmark_index_name"
                ),
                F.try_element_at(providers, number % 4 + 1).alias("index_provider"),
                "theme",
                F.when(number % 5 == 0, F.lit(None)).otherwise(F.col("aum")).alias("aum"),
                "number_of_holdings",
                (number % 2 == 1).alias("asx_exposure_flag"),
                F.when(number % 3 == 1, "manual").when(number % 3 == 2, "discovery").otherwise("seed").alias(
                    "source"
                ),
            ),
            REGISTRY,
        )

    def registry(self) -> DataFrame:
        return with_confidence(self.registry_rows())

    def announced_orders(self) -> DataFrame:
        """What announcements are made of."""
        return self.table("orders").select(
            "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").alias("day"), _order_symbol().alias("symbol")
        )

    def announcements(self) -> DataFrame:
        return self.announcements_of(self.announced_orders())

    def announcements_of(self, orders: DataFrame) -> DataFrame:
        o = orders
        announced = F.col("day")
        effective = F.date_add(announced, (10 + F.col("o_orderkey") % 11).cast("int"))
        return conform(
            o.select(
                F.col("o_orderpriority").alias("provider"),
                F.concat(F.lit("Index "), F.substring("o_orderpriority", 1, 1)).alias("index_name"),
                F.col("symbol").alias("asx_ticker"),
                F.concat(F.lit("Company "), F.col("o_custkey").cast("string")).alias("company_name"),
                F.when(F.col("o_orderstatus") == "F", "ADD")
                .when(F.col("o_orderstatus") == "O", "DELETE")
                .otherwise("RECONSTITUTION")
                .alias("action"),
                announced.alias("announcement_date"),
                F.when(F.col("o_orderkey") % 7 != 0, effective).alias("effective_date"),
                F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("source_url"),
                (0.3 + (F.col("o_orderkey") % 7) / 10.0).alias("confidence"),
                (F.col("o_orderkey") % 5 == 0).alias("needs_verification"),
            ),
            ANNOUNCEMENTS,
        )

    def signups(self) -> DataFrame:
        """What custom events are made of."""
        e = self.table("events").where(F.col("event_type") == "signup")
        return e.select("event_type", stock_symbol(F.col("user_id")).alias("symbol"), F.add_months(F.to_date("ts"), -300).alias("day"))

    def custom_events(self) -> DataFrame:
        return self.custom_events_of(self.signups())

    def custom_events_of(self, signups: DataFrame) -> DataFrame:
        """High-value events of the click stream, entered by hand without an id."""
        return signups.select(
            F.lit(None).cast("string").alias("event_id"),
            F.lit("MarketVector").alias("provider"),
            F.col("event_type").alias("notes"),
            F.col("symbol").alias("asx_ticker"),
            F.col("day").alias("announcement_date"),
            F.col("day").alias("detected_date"),
            F.date_add("day", 9).alias("effective_date"),
            F.lit(0.8).alias("confidence_score"),
        ).distinct()

    def profiles(self) -> DataFrame:
        s = self.table("supplier")
        n = self.table("nation")
        r = self.table("region")
        joined = s.join(n, s.s_nationkey == n.n_nationkey, "left").join(
            r, n.n_regionkey == r.r_regionkey, "left"
        )
        return conform(
            joined.select(
                stock_symbol(F.col("s_suppkey")).alias("symbol"),
                F.col("s_name").alias("company_name"),
                F.col("r_name").alias("sector"),
                F.col("n_name").alias("industry"),
                (F.abs(clean("s_acctbal")) * 100000.0).alias("market_cap"),
                (1.0 + F.col("s_suppkey") % 50).cast("double").alias("price"),
                F.lit("ASX").alias("exchange"),
                F.col("n_name").alias("country"),
            ),
            PROFILES,
        )

    def order_values(self) -> DataFrame:
        return (
            self.table("orders")
            .select(
                _order_symbol().alias("symbol"), F.to_date("o_orderdate").alias("date"), "o_totalprice"
            )
            .where(F.col("symbol") != "ZZZ.AX")
        )

    def market_caps(self) -> DataFrame:
        return self.market_caps_of(self.order_values())

    def market_caps_of(self, values: DataFrame) -> DataFrame:
        caps = values.groupBy("symbol", "date").agg((F.max("o_totalprice") * 2000.0).alias("market_cap"))
        return conform(caps, MARKET_CAP_HISTORY)

    def membership_changes(self) -> DataFrame:
        """Index additions and deletions out of the F and O orders, an index for each priority."""
        o = self.table("orders").where(F.col("o_orderstatus").isin("F", "O"))
        priority = F.substring("o_orderpriority", 1, 1)
        name = (
            F.when(priority == "1", "Large 500")
            .when(priority == "2", "Growth 100")
            .when(priority == "3", "Local 200")
            .when(priority == "4", "Small 600")
            .otherwise("Local 300")
        )
        return o.select(
            name.alias("index_name"),
            F.when(priority.isin("3", "5"), "ASX").otherwise("US").alias("market"),
            F.when(F.col("o_orderstatus") == "F", "ADD").otherwise("DEL").alias("action"),
            _order_symbol().alias("ticker"),
            F.to_date("o_orderdate").alias("effective_date"),
            F.concat(F.lit("Security "), _order_symbol()).alias("security"),
            F.concat(F.lit("priority "), priority).alias("reason"),
        ).distinct()

    def fund_holdings(self) -> DataFrame:
        """Current vendor holdings: the latest snapshot of each fund, weights in percent."""
        h = self._held()
        last = h.groupBy("product_ticker").agg(F.max("as_of_date").alias("as_of_date"))
        code, number = stock_code(F.col("l_suppkey")), F.col("l_suppkey") + 10
        return h.join(last, ["product_ticker", "as_of_date"]).select(
            F.upper("product_ticker").alias("etf"),
            F.when(number % 2 == 0, F.concat(code, F.lit(".AX"))).otherwise(code).alias("asset"),
            F.when(number % 7 == 0, F.lit("GB000")).otherwise(F.concat(F.lit("AU000"), code)).alias("isin"),
            F.concat(F.lit("Stock "), F.col("l_suppkey").cast("string")).alias("name"),
            (F.col("market_value") / F.col("fund_value") * 100.0).alias("weight_pct"),
            "shares",
            "market_value",
        )

    def vendor_lines(self) -> DataFrame:
        """Vendor holdings as delivered: with a cash line for each fund, a hundredth of its value."""
        held = self.fund_holdings()
        cash = held.groupBy("etf").agg((F.sum("market_value") / 100.0).alias("value")).select(
            "etf", F.lit("USD.AX").alias("asset"), F.lit(None).cast("string").alias("isin"), F.lit("Cash").alias("name"),
            F.lit(1.0).alias("weight_pct"), F.col("value").alias("shares"), F.col("value").alias("market_value"),
        )
        return held.unionByName(cash)

    def listed_funds(self) -> DataFrame:
        """All funds, and every 25th stock as a fund that is listed itself and held by others."""
        listed = self.table("supplier").where(F.col("s_suppkey") % 25 == 0).select(
            stock_symbol(F.col("s_suppkey")).alias("etf"), F.col("s_name").alias("etf_name"), F.lit(None).cast("double").alias("aum")
        )
        return self.funds().unionByName(listed)

    def funds(self) -> DataFrame:
        return self.registry_rows().select(
            F.col("product_ticker").alias("etf"), F.col("product_name").alias("etf_name"), "aum"
        )
