from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession

from tidemark.schemas import BARS
from tidemark.session import tune


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


def business_days(start: str, n: int) -> list[dt.date]:
    day, out = dt.date.fromisoformat(start), []
    while len(out) < n:
        if day.weekday() < 5:
            out.append(day)
        day += dt.timedelta(days=1)
    return out


def make_bars(spark, closes, symbol="PDN.AX", start="2023-01-02", volume=1_000_000.0, opens=None):
    """Bars on business days; opens default to the previous close."""
    rows, previous = [], closes[0]
    for i, (day, close) in enumerate(zip(business_days(start, len(closes)), closes)):
        first = (opens or {}).get(i, previous)
        high, low = max(first, close) * 1.01, min(first, close) * 0.99
        rows.append(
            (symbol, day, first, high, low, close, close, volume, (high + low + close) / 3, close * volume)
        )
        previous = close
    return spark.createDataFrame(rows, BARS)


RAMP = [1.0] * 31 + [1.0 + 0.01 * i for i in range(1, 11)] + [1.10] * 19


def event_row(**over):
    base = {
        "event_id": "EV1", "source_type": "announcement", "provider": "S&P", "asx_ticker": "PDN.AX",
        "event_type": "OFFICIAL_INDEX_ADD", "confidence_score": 0.8, "product_ticker": None,
        "shares_delta": None, "weight_delta": None, "aum": None, "theme": None, "n_holdings": None,
        "announcement_date": None, "detected_date": None, "effective_date": None,
    }
    return {**base, **over}


EVENT_SCHEMA = (
    "event_id string, source_type string, provider string, asx_ticker string, event_type string, "
    "confidence_score double, product_ticker string, shares_delta double, weight_delta double, aum double, "
    "theme string, n_holdings double, announcement_date date, detected_date date, effective_date date"
)


def make_events(spark, rows):
    names = [c.strip().split(" ")[0] for c in EVENT_SCHEMA.split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], EVENT_SCHEMA)
