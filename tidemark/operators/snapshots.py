"""Dated fund holdings: collapse, consecutive diffs, net accumulation (AG1, EV1-3, FE5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import col, safe_div
from ..functions.tickers import constituent_symbol, normalise_asx
from ..schemas import DIFF_COLUMNS
from .bars import latest_bars

# Fixed value: absolute weight moves up to one basis point are noise.
WEIGHT_EPS = 1e-4

# Column of holdings that lie by stock, see ``dealt_by``.
DEALT = "dealt_by"


def _constituent_key(ticker: Column | str = "constituent_ticker", name: Column | str = "constituent_name") -> Column:
    ticker, name = F.coalesce(col(ticker), F.lit("")), F.upper(F.coalesce(col(name), F.lit("")))
    return F.when(ticker.isin("", "nan", "NAN"), name).otherwise(ticker)


def dealt_by(ticker: Column | str = "constituent_ticker", name: Column | str = "constituent_name") -> Column:
    """The stock of a line, or its constituent key where that is no ticker: all lines of one key have one value.

    A mapped line's symbol is this value, so its events lie where its lines do.
    """
    key = _constituent_key(ticker, name)
    return F.coalesce(normalise_asx(key), key)


def collapse_constituents(holdings: DataFrame, compat: bool = False, together: bool = False) -> DataFrame:
    """AG1: one row per (product, date, constituent key), weights and shares summed.

    A sum over missing values only stays NULL; ``compat`` turns it into 0. ``together`` moves lines by
    (product, constituent key), for windows over their dates that then need no shuffle of their own.
    Lines with a ``dealt_by`` column keep it and stay where they lie by it.
    """
    ex = ["exchange"] if "exchange" in holdings.columns else []
    sums = {c: F.sum(c) for c in ("weight_pct", "shares")}
    if compat:
        sums = {c: F.coalesce(s, F.lit(0.0)) for c, s in sums.items()}
    keyed = holdings.withColumn("constituent_key", _constituent_key()).where(F.col("constituent_key") != "")
    dealt = [c for c in (DEALT,) if c in holdings.columns]
    if together and not dealt:
        keyed = keyed.repartition("product_ticker", "constituent_key")
    # min instead of first: the survivor must not depend on task order.
    return (
        keyed.groupBy(*dealt, "product_ticker", "as_of_date", "constituent_key")
        .agg(
            *[F.min(c).alias(c) for c in ["constituent_ticker", "constituent_name", *ex]],
            *[s.alias(c) for c, s in sums.items()],
        )
    )


def snapshot_dates(holdings: DataFrame) -> DataFrame:
    """IO6: distinct (product, date) with snapshot number and previous date.

    Distinct before the window: a product has one row per snapshot here.
    """
    order = W.partitionBy("product_ticker").orderBy("as_of_date")
    return (
        holdings.select("product_ticker", "as_of_date")
        .distinct()
        .withColumn("snap_no", F.row_number().over(order))
        .withColumn("prev_date", F.lag("as_of_date").over(order))
        .withColumn("next_date", F.lead("as_of_date").over(order))
        .withColumn("n_snaps", F.count(F.lit(1)).over(W.partitionBy("product_ticker")))
    )


def products_with_history(holdings: DataFrame) -> DataFrame:
    """IO7: products with at least two snapshots."""
    return (
        holdings.groupBy("product_ticker")
        .agg(F.countDistinct("as_of_date").alias("n_snapshots"))
        .where(F.col("n_snapshots") >= 2)
    )


def _classify(df: DataFrame, weight_eps: float) -> DataFrame:
    """Change type and deltas of a row that carries the old and the new side."""
    dw = F.col("new_weight") - F.col("old_weight")
    ds = F.col("new_shares") - F.col("old_shares")
    move = F.coalesce(dw, F.lit(0.0))
    trade = F.coalesce(ds, F.lit(0.0))
    change = (
        F.when(F.col("in_new") & ~F.col("in_old"), "NEW_POSITION")
        .when(F.col("in_old") & ~F.col("in_new"), "DELETED")
        .when(move > weight_eps, "WEIGHT_INCREASE")
        .when(move < -weight_eps, "WEIGHT_DECREASE")
        .when(trade > 0, "WEIGHT_INCREASE")
        .when(trade < 0, "WEIGHT_DECREASE")
        .otherwise("UNCHANGED")
    )

    def delta(both, new: str, old: str):
        return F.coalesce(
            both,
            F.when(F.col("change_type") == "NEW_POSITION", F.col(new)).when(
                F.col("change_type") == "DELETED", -F.col(old)
            ),
        )

    return (
        df.withColumn("change_type", change)
        .withColumn("weight_delta", delta(dw, "new_weight", "old_weight"))
        .withColumn("shares_delta", delta(ds, "new_shares", "old_shares"))
    )


def diff_history(
    holdings: DataFrame,
    weight_eps: float = WEIGHT_EPS,
    include_unchanged: bool = False,
    latest_only: bool = False,
    compat: bool = False,
    dates: DataFrame | None = None,
) -> DataFrame:
    """EV1-EV3: changes between every consecutive snapshot pair of every product.

    Set-wise over all pairs: the history of one (product, constituent) is read in one
    window, bounded by the product's snapshots. A line compares with its own previous
    line when that belongs to the snapshot just before, and leaves a DELETED record when
    the next snapshot lacks it. The first snapshot has no pair and emits nothing.
    ``dates`` is ``snapshot_dates`` of the holdings as a written table: its size is known, so lines
    need not move for it. A ``dealt_by`` column of the holdings stays on the records.
    """
    dealt = [c for c in (DEALT,) if c in holdings.columns]
    lines = collapse_constituents(holdings, compat, together=True)
    if "exchange" not in lines.columns:
        lines = lines.withColumn("exchange", F.lit(None).cast("string"))
    dates = snapshot_dates(holdings) if dates is None else dates
    if latest_only:
        dates = dates.where(F.col("snap_no") >= F.col("n_snaps") - 1).withColumn(
            "prev_date", F.when(F.col("snap_no") == F.col("n_snaps"), F.col("prev_date"))
        )
    history = W.partitionBy(*dealt, "product_ticker", "constituent_key").orderBy("snap_no")
    dated = (
        lines.join(dates, ["product_ticker", "as_of_date"])
        .withColumn("in_old", F.coalesce(F.lag("snap_no").over(history) == F.col("snap_no") - 1, F.lit(False)))
        .withColumn("stays", F.coalesce(F.lead("snap_no").over(history) == F.col("snap_no") + 1, F.lit(False)))
        .withColumn("before_weight", F.lag("weight_pct").over(history))
        .withColumn("before_shares", F.lag("shares").over(history))
    )

    def record(keep, prev_date, as_of_date, in_new, in_old, old_w, new_w, old_s, new_s):
        return F.when(
            keep,
            F.struct(
                prev_date.alias("prev_date"), as_of_date.alias("as_of_date"),
                in_new.alias("in_new"), in_old.alias("in_old"),
                old_w.alias("old_weight"), new_w.alias("new_weight"),
                old_s.alias("old_shares"), new_s.alias("new_shares"),
            ),
        )

    none = F.lit(None).cast("double")
    weight, shares = F.col("weight_pct"), F.col("shares")
    records = F.array(
        record(
            F.col("prev_date").isNotNull(), F.col("prev_date"), F.col("as_of_date"),
            F.lit(True), F.col("in_old"),
            F.when(F.col("in_old"), F.col("before_weight")), weight,
            F.when(F.col("in_old"), F.col("before_shares")), shares,
        ),
        record(
            F.col("next_date").isNotNull() & ~F.col("stays"), F.col("as_of_date"), F.col("next_date"),
            F.lit(False), F.lit(True), weight, none, shares, none,
        ),
    )
    paired = dated.withColumn(
        "r", F.explode(F.filter(records, lambda r: r.isNotNull()))
    ).select(
        *dealt, "product_ticker", "constituent_ticker", "constituent_name", "exchange", "r.*"
    )
    out = _classify(paired, weight_eps).select(*dealt, *DIFF_COLUMNS)
    return out if include_unchanged else out.where(F.col("change_type") != "UNCHANGED")


def diff_snapshots(
    prev: DataFrame, curr: DataFrame, weight_eps: float = WEIGHT_EPS, include_unchanged: bool = False
) -> DataFrame:
    """EV1 for two given snapshots of the same product(s)."""
    return diff_history(prev.unionByName(curr), weight_eps, include_unchanged)


def net_accumulation(holdings: DataFrame, bars: DataFrame) -> DataFrame:
    """FE5: net share change per stock over each fund's latest pair, in days of volume."""
    changes = (
        diff_history(holdings, latest_only=True)
        .withColumn("asx_ticker", constituent_symbol("constituent_ticker"))
        .where(F.col("asx_ticker").isNotNull() & F.col("shares_delta").isNotNull())
    )
    # One row per (stock, fund) first: the fund list is bounded by the fund universe.
    per_fund = changes.groupBy("asx_ticker", "product_ticker").agg(
        F.sum("shares_delta").alias("shares_delta"), F.max("as_of_date").alias("window_to")
    )
    per_stock = per_fund.groupBy("asx_ticker").agg(
        F.sum("shares_delta").alias("net_shares"),
        F.count(F.lit(1)).alias("n_etfs_trading"),
        F.sort_array(F.collect_list("product_ticker")).alias("etfs"),
        F.max("window_to").alias("window_to"),
    )
    liquidity = latest_bars(bars).select(
        F.col("symbol").alias("asx_ticker"), F.col("adv_shares").alias("adv_shares_63d")
    )
    return per_stock.join(liquidity, "asx_ticker", "left").withColumn(
        "buy_days_of_volume", safe_div("net_shares", "adv_shares_63d")
    )
