"""Ledger diagnostics: metrics, drawdown, bootstrap, breakdowns, gate (AG7-AG17, DG1).

The ledger should be a written table; every function reads it a few times. Nothing here
orders or collects a whole strategy in one task, see ``ordered``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bucketise, nonzero, percent
from ..session import durable
from .backtest import executed
from .ordered import grouped_medians, grouped_quantiles, join_groups, max_drawdown, ordered_positions
from .resample import bootstrap_means

N_BOOT = 2000
SEED = 7
ALPHA = 0.05
MIN_RESAMPLED = 3

# Bucket edges and labels of the breakdown dimensions.
BUCKETS: dict[str, tuple[str, list[float], list[str]]] = {
    "market_cap_bucket": (
        "market_cap", [-1.0, 1e8, 5e8, 2e9, 1e11], ["<100m", "100-500m", "500m-2b", ">2b"],
    ),
    "liquidity_bucket": (
        "adv_dollars", [-1.0, 2.5e5, 1e6, 5e6, 1e12], ["<250k", "250k-1m", "1-5m", ">5m"],
    ),
    "immediate_reaction_bucket": (
        "immediate_reaction", [-1e-9, 0.005, 0.02, 0.05, 1.0], ["<0.5%", "0.5-2%", "2-5%", ">5%"],
    ),
    "flow_pressure_bucket": (
        "flow_pressure", [-1e-9, 0.5, 1.0, 3.0, 1e9], ["<0.5x", "0.5-1x", "1-3x", ">3x"],
    ),
}
DIMENSIONS = ["year", "theme", "provider", "strategy", *BUCKETS]
LIQUIDITY_MILLIONS = ([0.0, 5.0, 20.0, 50.0, 150.0, 1e9], ["<$5m", "$5-20m", "$20-50m", "$50-150m", ">$150m"])


def _grouped(
    df: DataFrame, keys: list[str], body: Callable[[DataFrame, list[str]], DataFrame]
) -> DataFrame:
    """Run a grouped body; without keys the whole table is the one group."""
    if keys:
        return body(df, keys)
    return body(df.withColumn("__all", F.lit(1)), ["__all"]).drop("__all")


def compute_metrics(
    ledger: DataFrame, keys: list[str] | None = None, return_col: str = "net_return"
) -> DataFrame:
    """AG7: sixteen measures of the executed trades per group."""

    def body(ex: DataFrame, by: list[str]) -> DataFrame:
        r = F.col(return_col)
        loss = F.avg(F.when(r < 0, r))
        base = ex.groupBy(*by).agg(
            F.count(r).alias("n_trades"),
            F.avg(r).alias("avg_return"),
            F.avg(F.when(r.isNotNull(), (r > 0).cast("double"))).alias("hit_rate"),
            (F.avg(F.when(r > 0, r)) / nonzero(F.abs(loss))).alias("payoff_ratio"),
            F.min(r).alias("worst_trade"),
            F.max(r).alias("best_trade"),
            F.avg("exposure_days").alias("avg_exposure_days"),
            F.sum("exposure_days").cast("double").alias("total_exposure_days"),
            F.avg("gross_return").alias("avg_gross_return"),
            F.avg("harsh_net_return").alias("avg_return_after_harsh_costs"),
            F.sum("pnl_net").alias("total_pnl_net"),
            F.avg(F.coalesce("capped", F.lit(False)).cast("double")).alias("pct_capped"),
        )
        medians = grouped_medians(
            ex, by, {return_col: "median_return", "participation": "median_participation"}
        )
        falls = max_drawdown(ex, by, return_col, "exit_date", "event_id")
        out = join_groups(join_groups(base, medians, by), falls, by)
        return out.withColumn("avg_return_after_costs", F.col("avg_return")).select(
            *by, "n_trades", "avg_return", "median_return", "hit_rate", "payoff_ratio", "worst_trade",
            "best_trade", "max_drawdown", "avg_exposure_days", "total_exposure_days",
            "avg_gross_return", "avg_return_after_costs", "avg_return_after_harsh_costs",
            "total_pnl_net", "median_participation", "pct_capped",
        )

    return _grouped(executed(ledger), list(keys or []), body)


def scoreboard(ledger: DataFrame) -> DataFrame:
    """AG13: strategies by mean return."""
    return compute_metrics(ledger, ["strategy"]).orderBy(F.desc("avg_return"), "strategy")


def bootstrap_ci(
    ledger: DataFrame,
    keys: list[str] | None = None,
    value: str = "net_return",
    n_boot: int = N_BOOT,
    alpha: float = ALPHA,
    seed: int = SEED,
) -> DataFrame:
    """AG9: percentile interval of the mean; groups below three trades have none."""

    def body(ex: DataFrame, by: list[str]) -> DataFrame:
        means = bootstrap_means(ex, by, value, n_boot, seed, MIN_RESAMPLED)
        # At most n_boot values per group reach the percentile.
        q = means.groupBy(*by).agg(
            F.percentile("boot_mean", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q")
        )
        return q.select(*by, F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))

    return _grouped(executed(ledger), list(keys or []), body)


def with_dimensions(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """JN13, AG11: executed trades with the derived bucket columns."""
    side = events.select("event_id", "immediate_reaction", "flow_pressure")
    df = executed(ledger).join(side, "event_id", "left")
    for name, (source, edges, labels) in BUCKETS.items():
        c = F.abs(source) if source == "immediate_reaction" else F.col(source)
        df = df.withColumn(name, bucketise(c, edges, labels))
    return df


def breakdowns(
    ledger: DataFrame, events: DataFrame, dimensions: list[str] | None = None
) -> DataFrame:
    """AG10: metrics per (dimension, bucket), all dimensions from one pass."""
    measures = [
        "event_id", "strategy", "exit_date", "net_return", "gross_return", "harsh_net_return",
        "exposure_days", "pnl_net", "participation", "capped", "rejected",
    ]
    wanted = list(dict.fromkeys([*measures, *(dimensions or DIMENSIONS)]))
    # read several times, each time with all dimensions of a row side by side
    df = durable(with_dimensions(ledger, events).select(*wanted), "dimensions")
    slots = F.array(
        *[
            F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("bucket"))
            for d in dimensions or DIMENSIONS
        ]
    )
    long = df.select(*measures, F.explode(slots).alias("__s")).select(
        *measures, "__s.dimension", "__s.bucket"
    )
    # The same event can be traded by several strategies inside one bucket.
    long = long.where(F.col("bucket").isNotNull()).withColumn(
        "event_id", F.concat_ws(":", "event_id", "strategy")
    )
    return compute_metrics(long, ["dimension", "bucket"])


def breakdown(ledger: DataFrame, events: DataFrame, by: str) -> DataFrame:
    """AG10 for one dimension, largest bucket first."""
    return (
        breakdowns(ledger, events, [by])
        .drop("dimension")
        .withColumnRenamed("bucket", by)
        .orderBy(F.desc("n_trades"), by)
    )


def claims_gate(
    ledger: DataFrame,
    keys: list[str] | None = None,
    min_trades: int = 5,
    single_trade_max_share: float = 0.5,
    interval: DataFrame | None = None,
) -> DataFrame:
    """AG12, AG23, WN17: the checks a result must pass before it may be called an edge.

    ``interval`` is the ledger's ``bootstrap_ci`` by the same keys, where it is at hand.
    """

    def body(ex: DataFrame, by: list[str]) -> DataFrame:
        gains = F.sum(F.when(F.col("pnl_net") > 0, F.col("pnl_net")).otherwise(0.0))
        base = ex.groupBy(*by).agg(
            (F.avg("net_return") > 0).alias("survives_costs"),
            (F.avg("harsh_net_return") > 0).alias("survives_harsh_costs"),
            (F.count("net_return") >= min_trades).alias("enough_events"),
            (F.countDistinct("event_id") >= 2).alias("multi_event"),
            F.coalesce(
                (gains <= 0) | (F.max("pnl_net") / nonzero(gains) <= single_trade_max_share),
                F.lit(False),
            ).alias("no_single_trade_dominates"),
            (F.avg(F.coalesce("capped", F.lit(False)).cast("double")) < 0.5).alias("liquidity_ok"),
        )
        cut = F.floor(F.col("n_seq") * 0.7)
        late = F.when(F.col("pos") >= cut, F.col("net_return"))
        walk = ordered_positions(ex, by, "exit_date", "event_id").groupBy(*by).agg(
            F.when(
                (F.max(cut) >= 2) & (F.max(F.col("n_seq") - cut) >= 2), F.avg(late) > 0
            ).alias("oos_positive")
        )
        out = join_groups(base, walk, by)
        checks = [
            "survives_costs", "survives_harsh_costs", "enough_events", "multi_event",
            "no_single_trade_dominates", "liquidity_ok",
        ]
        known = bootstrap_ci(ex, by) if interval is None else interval
        out = join_groups(out, known, by).withColumn(
            "bootstrap_ci_positive", F.coalesce(F.col("ci_low") > 0, F.lit(False))
        )
        checks.append("bootstrap_ci_positive")
        verdict = F.coalesce("oos_positive", F.lit(True))
        for c in checks:
            verdict = verdict & F.coalesce(c, F.lit(False))
        return out.withColumn("claim_alpha", verdict)

    return _grouped(executed(ledger), list(keys or []), body)


def strategy_summary(ledger: DataFrame) -> DataFrame:
    """AG15: means after costs, median, hit rate, t statistic, interval and verdict."""
    by = ["strategy"]
    ex = executed(ledger)
    net = F.col("net_return")
    base = ex.groupBy(*by).agg(
        F.count(net).alias("n"),
        percent(F.avg("gross_return"), 3).alias("avg_gross_pct"),
        percent(F.avg(net), 3).alias("avg_net_pct"),
        percent(F.avg("harsh_net_return"), 3).alias("avg_harsh_pct"),
        F.bround(F.avg((net > 0).cast("double")), 3).alias("hit_rate"),
        F.bround(
            F.when(
                F.count(net) > 2,
                F.avg(net) / nonzero(F.stddev_samp(net) / F.sqrt(F.count(net))),
            ),
            2,
        ).alias("t_stat"),
    )
    median = grouped_medians(ex, by, {"net_return": "m"}).select(
        "strategy", percent("m", 3).alias("median_net_pct")
    )
    out = join_groups(base, median, by)
    interval = durable(bootstrap_ci(ledger, by), "interval")
    ci = interval.select(
        "strategy",
        percent("ci_low", 3).alias("ci95_net_low_pct"),
        percent("ci_high", 3).alias("ci95_net_high_pct"),
    )
    gate = claims_gate(ledger, by, interval=interval).select("strategy", "claim_alpha")
    return join_groups(join_groups(out, ci, by), gate, by)


def grouped_hits(ledger: DataFrame, by: str) -> DataFrame:
    """AG16: number, mean net percent and hit rate per value of a column."""
    net = F.col("net_return")
    return (
        executed(ledger)
        .where(F.col(by).isNotNull())
        .groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            percent(F.avg(net), 3).alias("avg_net_pct"),
            F.bround(F.avg((net > 0).cast("double")), 3).alias("hit"),
        )
    )


def run_up_breakdowns(ledger: DataFrame, strategy: str = "S1_ADD_runup_T-5") -> DataFrame:
    """AG16 by index, year and liquidity of one strategy, in one scan."""
    legs = executed(ledger).where(F.col("strategy") == strategy)
    edges, labels = LIQUIDITY_MILLIONS
    slots = F.array(
        F.struct(F.lit("index").alias("dimension"), F.col("theme").alias("bucket")),
        F.struct(F.lit("year").alias("dimension"), F.col("year").cast("string").alias("bucket")),
        F.struct(
            F.lit("liquidity").alias("dimension"),
            bucketise(F.col("adv_dollars") / 1e6, edges, labels).alias("bucket"),
        ),
    )
    net = F.col("net_return")
    return (
        legs.select("net_return", F.explode(slots).alias("s"))
        .where(F.col("s.bucket").isNotNull())
        .groupBy(F.col("s.dimension").alias("dimension"), F.col("s.bucket").alias("bucket"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            percent(F.avg(net), 3).alias("avg_net_pct"),
            F.bround(F.avg((net > 0).cast("double")), 3).alias("hit"),
        )
    )


def inefficiency(events: DataFrame, by: str) -> DataFrame:
    """AG14: how slowly prices react, per provider or theme."""
    known = events.where(F.col(by).isNotNull())
    base = known.groupBy(by).agg(
        F.avg("immediate_reaction").alias("avg_immediate_reaction"),
        F.avg("delayed_return").alias("avg_delayed_return"),
        F.avg("underreaction_score").alias("avg_underreaction_score"),
        F.avg("delayed_flow_opportunity_score").alias("avg_opportunity_score"),
    )
    # apart, so that ids do not move with the sums of the means
    counts = known.groupBy(by).agg(F.countDistinct("event_id").alias("n_events"))
    median = grouped_medians(known, [by], {"delayed_return": "median_delayed_return"})
    out = join_groups(join_groups(counts, base, [by]), median, [by])
    return out.orderBy(F.desc_nulls_last("avg_opportunity_score"), by)


def column_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """AG17, AG21: mean, median, positives and count of each measure."""
    slots = F.array(
        *[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in columns]
    )
    long = df.select(F.explode(slots).alias("s")).where(F.col("s.v").isNotNull())
    base = long.groupBy(F.col("s.measure").alias("measure")).agg(
        F.avg("s.v").alias("mean"),
        F.sum((F.col("s.v") > 0).cast("long")).alias("n_positive"),
        F.count(F.lit(1)).alias("n"),
    )
    median = grouped_quantiles(df, [], columns).select("measure", F.col("quantile").alias("median"))
    return base.join(median, "measure", "left")
