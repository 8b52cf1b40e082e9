"""Product registry: scoring, priority merge, discovery (RG1-RG3, SC18, IO29)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import THEMES
from ..schemas import REGISTRY, conform

# Weight of each known attribute, trust order of the sources.
CONFIDENCE_WEIGHTS = {
    "product_name": 0.10,
    "issuer": 0.10,
    "benchmark_index_name": 0.10,
    "index_provider": 0.05,
    "methodology_url": 0.10,
    "holdings_url": 0.15,
    "rebalance_frequency": 0.05,
    "number_of_holdings": 0.05,
    "aum": 0.05,
    "historical_data_available_flag": 0.10,
    "current_asx_holdings_count": 0.15,
}
MANUAL_BONUS = 0.15
SEED_CEILING = 0.45
SOURCE_TRUST = {"manual": 3, "discovery": 2, "seed": 1}


def _present(name: str) -> Column:
    text = F.trim(F.col(name).cast("string"))
    return F.coalesce((text != "") & (F.lower(text) != "nan"), F.lit(False))


def confidence() -> Column:
    """SC18: completeness of a registry row, adjusted for who supplied it."""
    base = F.lit(0.0)
    for name, weight in CONFIDENCE_WEIGHTS.items():
        base = base + F.when(_present(name), F.lit(weight)).otherwise(0.0)
    return F.round(
        F.when(F.col("source") == "manual", F.least(F.lit(1.0), base + MANUAL_BONUS))
        .when(F.col("source") == "seed", F.least(base, F.lit(SEED_CEILING)))
        .otherwise(base),
        3,
    )


def with_confidence(registry: DataFrame) -> DataFrame:
    return registry.withColumn("confidence_score", confidence())


def seed_registry(spark: SparkSession, themes: dict = THEMES) -> DataFrame:
    """IO29: one low-trust row per fund named by a theme."""
    rows = [
        ("etf", product.upper(), theme, "manual", True, "seed")
        for theme, spec in themes.items()
        for product in spec["products"]
    ]
    schema = (
        "record_type string, product_ticker string, theme string, holdings_file_type string, "
        "asx_exposure_flag boolean, source string"
    )
    return conform(spark.createDataFrame(rows, schema), REGISTRY)


def build_registry(parts: list[DataFrame]) -> DataFrame:
    """RG1, WN13: the most trusted source of a product wins; later loads win ties.

    A partially aggregated maximum picks the row, so copies of one product are reduced
    before they are shuffled.
    """
    stacked = reduce(
        lambda a, b: a.unionByName(b),
        [conform(p, REGISTRY).withColumn("__load", F.lit(i)) for i, p in enumerate(parts)],
    )
    trust = F.lit(0)
    for source, rank in SOURCE_TRUST.items():
        trust = F.when(F.col("source") == source, rank).otherwise(trust)
    columns = [c for c in REGISTRY.fieldNames() if c != "product_ticker"]
    best = (
        stacked.withColumn("product_ticker", F.upper(F.trim("product_ticker")))
        .groupBy("product_ticker")
        .agg(F.max(F.struct(trust.alias("__trust"), "__load", *columns)).alias("r"))
    )
    rows = best.select("product_ticker", *[F.col(f"r.{c}").alias(c) for c in columns])
    return with_confidence(rows.select(*REGISTRY.fieldNames()))


def discover_funds(funds: DataFrame, themes: dict = THEMES) -> DataFrame:
    """RG2: landed fund list as discovery rows, tagged with the first theme whose keyword
    the fund name contains.

    Themes are configuration, so the keyword test is one expression, not a join.
    """
    name = F.lower("etf_name")
    theme = F.lit(None).cast("string")
    for label, spec in reversed(list(themes.items())):
        hit = reduce(
            lambda a, b: a | b, [F.contains(name, F.lit(k.lower())) for k in spec["keywords"]]
        )
        theme = F.when(hit, label).otherwise(theme)
    return conform(
        funds.where(F.coalesce("etf", F.lit("")) != "").select(
            F.lit("etf").alias("record_type"),
            F.upper("etf").alias("product_ticker"),
            F.col("etf_name").alias("product_name"),
            theme.alias("theme"),
            F.lit("csv").alias("holdings_file_type"),
            F.lit("discovery").alias("source"),
            "aum",
        ),
        REGISTRY,
    )


def discover_benchmarks(mentions: DataFrame, page_id: str) -> DataFrame:
    """Benchmark names found on issuer pages as index rows with a stable id."""
    from ..functions.scalars import stable_id

    issuer = F.col(page_id).cast("string")
    return conform(
        mentions.where(F.col("kind") == "benchmark").select(
            F.lit("index").alias("record_type"),
            F.concat(F.lit("BENCH:"), issuer, F.lit(":"), stable_id("value")).alias(
                "product_ticker"
            ),
            issuer.alias("issuer"),
            F.col("value").alias("benchmark_index_name"),
            F.lit("discovery").alias("source"),
        ),
        REGISTRY,
    )


def discover(*parts: DataFrame) -> DataFrame:
    """RG3: all discovery sources stacked."""
    return reduce(lambda a, b: a.unionByName(b), [conform(p, REGISTRY) for p in parts])


def registry_splits(registry: DataFrame) -> dict[str, DataFrame]:
    """IO22, FL14: funds, indices and locally exposed products."""
    return {
        "etf_registry": registry.where(F.col("record_type") == "etf"),
        "index_registry": registry.where(F.col("record_type") == "index"),
        "asx_exposed_indices": registry.where(F.coalesce("asx_exposure_flag", F.lit(False))),
    }


def registry_coverage(registry: DataFrame) -> DataFrame:
    """AG20: distribution of the confidence score per record type and source."""
    score = F.col("confidence_score")
    return registry.groupBy("record_type", "source").agg(
        F.count(F.lit(1)).alias("n_products"),
        F.avg(score).alias("avg_confidence"),
        F.stddev_samp(score).alias("std_confidence"),
        F.min(score).alias("min_confidence"),
        *[F.percentile(score, F.lit(q / 100)).alias(f"q{q}_confidence") for q in (25, 50, 75)],
        F.max(score).alias("max_confidence"),
    )
