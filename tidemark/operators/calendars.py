"""Review calendars and rebalance schedules (CA4-CA8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SCHEDULES
from ..functions.dates import (
    business_days_before,
    first_business_day,
    first_friday,
    last_business_day,
    month_start,
    third_friday,
)

QUARTERS = (3, 6, 9, 12)
# Semi-annual and quarterly review labels by month, notice in business days.
MSCI_REVIEWS = {2: "QIR-Feb", 5: "SAIR-May", 8: "QIR-Aug", 11: "SAIR-Nov"}
FTSE_NOTICE, MSCI_NOTICE = 10, 9


def _review(family: str, kind: str, label: Column, announced: Column, effective: Column) -> Column:
    return F.struct(
        F.lit(family).alias("family"),
        F.lit(kind).alias("event_type"),
        label.alias("review_label"),
        announced.alias("announcement_date_est"),
        effective.alias("effective_date"),
    )


def review_calendar(years: DataFrame, year: str = "year") -> DataFrame:
    """CA4, CA5: every scheduled review of the given years (one row per year in)."""
    y = F.col(year)
    reviews = []
    for m in QUARTERS:
        start = month_start(y, m)
        label = F.concat(y.cast("string"), F.lit(f"-Q{m // 3}"))
        effective = third_friday(start)
        reviews.append(_review("S&P/ASX", "REBALANCE", label, first_friday(start), effective))
        reviews.append(
            _review(
                "FTSE Russell", "RECONSTITUTION", label,
                business_days_before(effective, FTSE_NOTICE), effective,
            )
        )
    for m, name in MSCI_REVIEWS.items():
        effective = last_business_day(month_start(y, m))
        reviews.append(
            _review(
                "MSCI", "RECONSTITUTION", F.concat(y.cast("string"), F.lit(f"-{name}")),
                business_days_before(effective, MSCI_NOTICE), effective,
            )
        )
    return years.select(F.explode(F.array(*reviews)).alias("r")).select("r.*")


def generate_calendar(spark: SparkSession, start_year: int, end_year: int) -> DataFrame:
    years = spark.range(start_year, end_year + 1).select(F.col("id").cast("int").alias("year"))
    return review_calendar(years).orderBy("effective_date", "family", "review_label")


def upcoming(spark: SparkSession, as_of: str, horizon_days: int = 120) -> DataFrame:
    """CA6: reviews effective within the horizon of an explicit date."""
    day = F.lit(as_of).cast("date")
    year = int(as_of[:4])
    return generate_calendar(spark, year, year + 1).where(
        F.col("effective_date").between(day, F.date_add(day, horizon_days))
    )


def schedule_table(spark: SparkSession, schedules=SCHEDULES) -> DataFrame:
    return spark.createDataFrame(
        schedules, "etf string, months array<int>, rule string, lead int"
    )


def next_effective(schedules: DataFrame, as_of: Column, keys: list[str]) -> DataFrame:
    """CA7: next effective date per schedule row and day, days until, and watch date.

    Candidate months of this and the next year are array slots of the same row, so no
    join and no shuffle is needed.
    """

    def effective(year: Column, month: Column) -> Column:
        start = F.make_date(year, month, F.lit(1))
        return F.when(F.col("rule") == "3rd_friday", F.date_add(third_friday(start), 3)).otherwise(
            first_business_day(start)
        )

    dated = schedules.withColumn("as_of", as_of)
    candidates = F.concat(
        F.transform("months", lambda m: effective(F.year("as_of"), m)),
        F.transform("months", lambda m: effective(F.year("as_of") + 1, m)),
    )
    soonest = F.array_min(F.filter(candidates, lambda d: d >= F.col("as_of")))
    out = dated.withColumn("next_effective", soonest)
    return out.select(
        *keys,
        "as_of",
        "next_effective",
        F.datediff("next_effective", "as_of").alias("days_until"),
        F.date_sub("next_effective", F.col("lead")).alias("watch_pro_forma_from"),
    )


def rebalance_calendar(spark: SparkSession, as_of: str) -> DataFrame:
    """CA7 over the configured schedules, soonest first."""
    day = F.lit(as_of).cast("date")
    return next_effective(schedule_table(spark), day, ["etf", "rule"]).orderBy("days_until", "etf")


def next_quarterly(day: Column) -> Column:
    """CA8: first quarterly third Friday on or after a date."""
    slots = [third_friday(month_start(F.year(day), m)) for m in QUARTERS]
    slots.append(third_friday(month_start(F.year(day) + 1, QUARTERS[0])))
    return F.array_min(F.filter(F.array(*slots), lambda d: d >= day))
