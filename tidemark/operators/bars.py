"""Daily bars: construction from ticks and every fixed-offset or trailing column.

One row per (symbol, date), so a symbol's window group is bounded by its number of
trading days however many ticks stand behind it; ticks are reduced by a partially
aggregated ``groupBy`` first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import nonzero, safe_div, simple_return

SPREAD_BARS = 21
ADV_BARS = 3 * SPREAD_BARS
MIN_BARS = 5
MOMENTUM_BARS = {"mom_1m": 21, "mom_3m": 63, "mom_6m": 126, "mom_12m": 252}


def by_symbol():
    return W.partitionBy("symbol").orderBy("date")


def trailing(n: int):
    return by_symbol().rowsBetween(-(n - 1), 0)


def traded_value() -> Column:
    return F.coalesce(F.col("dollar_volume"), F.col("close") * F.col("volume"))


def bars_from_ticks(
    ticks: DataFrame, symbol: str, date: Column, price: str, volume: Column, order: list[str]
) -> DataFrame:
    """OHLCV bars; ``order`` is the tick order inside a day (IO13, SS2 batch form)."""
    seq = F.struct(*order, price)
    daily = ticks.groupBy(F.col(symbol).alias("symbol"), date.alias("date")).agg(
        F.min_by(price, seq).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, seq).alias("close"),
        F.sum(volume).alias("volume"),
    )
    return fill_bar_columns(daily)


def fill_bar_columns(bars: DataFrame) -> DataFrame:
    """Default the derivable bar columns and fix the column order."""
    have = set(bars.columns)

    def given(name: str, fallback: Column) -> Column:
        return F.coalesce(F.col(name), fallback) if name in have else fallback

    return bars.where(F.col("date").isNotNull()).select(
        "symbol",
        "date",
        "open",
        "high",
        "low",
        "close",
        given("adj_close", F.col("close")).alias("adj_close"),
        "volume",
        given("vwap", (F.col("high") + F.col("low") + F.col("close")) / 3.0).alias("vwap"),
        (F.col("close") * F.col("volume")).alias("dollar_volume"),
    )


# Prices that a day of one price has once.
_REPEATED = ("high", "low", "close")


def to_store(bars: DataFrame) -> DataFrame:
    """Bars without the columns that ``fill_bar_columns`` derives; a day of one price keeps it once."""
    one = F.lit(True)
    for c in _REPEATED:
        one = one & F.col(c).eqNullSafe(F.col("open"))
    flagged = bars.withColumn("one_price", one)
    return flagged.select(
        "symbol", "date", "open", *[F.when(~F.col("one_price"), F.col(c)).alias(c) for c in _REPEATED], "volume", "one_price"
    )


def from_store(stored: DataFrame) -> DataFrame:
    """The bars that ``to_store`` was given, their derived columns computed again."""
    prices = {c: F.when(F.col("one_price"), F.col("open")).otherwise(F.col(c)) for c in _REPEATED}
    return fill_bar_columns(stored.withColumns(prices).drop("one_price"))


def with_positions(bars: DataFrame) -> DataFrame:
    """W0: 1-based trading-day position and the symbol's number of bars."""
    return bars.withColumn("bar_no", F.row_number().over(by_symbol())).withColumn(
        "n_bars", F.count(F.lit(1)).over(W.partitionBy("symbol"))
    )


def at(name: str, offset: int) -> Column:
    """Value of a column ``offset`` bars away (negative looks back)."""
    if offset == 0:
        return F.col(name)
    shifted = F.lead(name, offset) if offset > 0 else F.lag(name, -offset)
    return shifted.over(by_symbol())


def _sums(values: dict[str, Column]) -> dict[str, Column]:
    """Sum, known values and squared deviations of each column over the last ``SPREAD_BARS`` bars."""
    out = {}
    for name, value in values.items():
        recent = trailing(SPREAD_BARS)
        out[f"__{name}_s"] = F.coalesce(F.sum(value).over(recent), F.lit(0.0))
        out[f"__{name}_n"] = F.count(value).over(recent)
        out[f"__{name}_v"] = F.coalesce(F.var_pop(value).over(recent), F.lit(0.0)) * F.col(f"__{name}_n")
    return out


def _thirds(names: list[str]) -> dict[str, Column]:
    """The same sums one and two stretches of ``SPREAD_BARS`` bars back; zero before the first bar."""
    return {
        f"__{name}_{kind}{k}": F.coalesce(at(f"__{name}_{kind}", -k * SPREAD_BARS), F.lit(0))
        for name in names for kind in ("s", "n", "v") for k in (1, 2)
    }


def _total(name: str, kind: str) -> Column:
    """Over the last ``ADV_BARS`` bars: three stretches next to each other."""
    return F.col(f"__{name}_{kind}2") + F.col(f"__{name}_{kind}1") + F.col(f"__{name}_{kind}")


def _mean(name: str) -> Column:
    return _total(name, "s") / nonzero(_total(name, "n"))


def _deviation(name: str) -> Column:
    """Sample deviation from the stretches' own: nothing is subtracted from a longer sum."""
    n, mean = _total(name, "n"), _mean(name)

    def apart(k: str) -> Column:
        count = F.col(f"__{name}_n{k}")
        own = F.col(f"__{name}_s{k}") / nonzero(count) - mean
        return F.coalesce(count * own * own, F.lit(0.0))

    squares = _total(name, "v") + apart("") + apart("1") + apart("2")
    return F.when(n > 1, F.sqrt(squares / (n - 1)))


def momentum(bars_back: int) -> Column:
    return simple_return(at("close", -bars_back), "close")


def tradeable(close: Column, adv: Column, min_price: float = 0.02, min_adv: float = 50_000.0) -> Column:
    """FL1: priced and liquid enough; unknown counts as no."""
    return F.coalesce((close >= min_price) & (adv >= min_adv), F.lit(False))


def with_trailing(bars: DataFrame) -> DataFrame:
    """WN1-WN6 and W0 over one shuffle and one sort per symbol.

    Bars that already carry positions keep them.
    """
    positioned = bars if "bar_no" in bars.columns else with_positions(bars)
    relative = (F.col("high") - F.col("low")) / nonzero("close")
    out = positioned.withColumns(
        {
            "daily_return": simple_return(at("close", -1), "close"),
            **{name: momentum(k) for name, k in MOMENTUM_BARS.items()},
            "__traded": traded_value(),
            "__relative": relative,
        }
    )
    values = {"traded": F.col("__traded"), "volume": F.col("volume"), "return": F.col("daily_return")}
    # Three stretches make the long look-back, so a bar reads 21 earlier ones, not 63.
    out = out.withColumns(_sums(values) | {"__spread": F.avg("__relative").over(trailing(SPREAD_BARS))})
    out = out.withColumns(_thirds(list(values)))
    enough = F.col("bar_no") >= MIN_BARS
    out = out.withColumns({"adv_dollars": _mean("traded"), "adv_shares": _mean("volume"), "__deviation": _deviation("return")})
    return out.select(
        *positioned.columns, "daily_return", "adv_dollars", "adv_shares",
        (F.col("__spread") * F.lit(0.25 * 10000.0)).alias("spread_proxy_bps"), *MOMENTUM_BARS,
        F.when(enough, safe_div("volume", "adv_shares")).alias("volume_shock"),
        F.when(enough, F.col("__deviation") * F.sqrt(F.lit(252.0))).alias("volatility"),
    )


def latest_bars(bars: DataFrame) -> DataFrame:
    """WN8: the last bar of every symbol with its trailing liquidity and momentum.

    Only the bars the longest look-back reaches are kept before the trailing columns.
    """
    newest = W.partitionBy("symbol").orderBy(F.desc("date"))
    reach = max(ADV_BARS, *MOMENTUM_BARS.values()) + 1
    recent = (
        bars.withColumn("__back", F.row_number().over(newest))
        .withColumn("n_bars", F.count(F.lit(1)).over(W.partitionBy("symbol")))
        .where(F.col("__back") <= reach)
        .withColumn("bar_no", F.col("n_bars") - F.col("__back") + 1)
        .drop("__back")
    )
    return with_trailing(recent).where(F.col("bar_no") == F.col("n_bars"))


def select_bars(
    bars: DataFrame,
    symbols: DataFrame | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """IO11, IO12: bars of a symbol table and an inclusive date range."""
    out = bars
    if start is not None:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.where(F.col("date") <= F.lit(end).cast("date"))
    return out if symbols is None else out.join(symbols.select("symbol"), "symbol", "left_semi")


def truncate_bars(bars: DataFrame, last_day: str) -> DataFrame:
    """What was knowable at the end of ``last_day``."""
    return select_bars(bars, end=last_day)
