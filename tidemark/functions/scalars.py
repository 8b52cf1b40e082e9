"""Scalar rules shared by the operators (SC9-SC13, SC15, SC20, SC21, SC26-SC28)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Event types that mean a forced buyer, and forced sellers.
BUY_TYPES = (
    "OFFICIAL_INDEX_ADD",
    "ETF_HOLDINGS_NEW_POSITION",
    "ETF_HOLDINGS_WEIGHT_INCREASE",
    "RECONSTITUTION",
    "REBALANCE",
    "CUSTOM_MANUAL_EVENT",
)
SELL_TYPES = ("OFFICIAL_INDEX_DELETE", "ETF_HOLDINGS_WEIGHT_DECREASE")

# How a holdings change is named as an event.
CHANGE_EVENT_TYPES = {
    "NEW_POSITION": "ETF_HOLDINGS_NEW_POSITION",
    "WEIGHT_INCREASE": "ETF_HOLDINGS_WEIGHT_INCREASE",
    "WEIGHT_DECREASE": "ETF_HOLDINGS_WEIGHT_DECREASE",
}

# Spellings of an index action.
ACTION_SYNONYMS = {
    "ADDED": "ADD",
    "ADDITION": "ADD",
    "INCLUDE": "ADD",
    "INCLUSION": "ADD",
    "DELETED": "DELETE",
    "DELETION": "DELETE",
    "REMOVE": "DELETE",
    "REMOVAL": "DELETE",
}

DATE_FORMATS = ("yyyy-MM-dd", "yyyyMMdd", "dd-MM-yyyy", "dd/MM/yyyy", "d MMM yyyy", "d MMMM yyyy")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """NaN -> NULL, so averages skip it."""
    c = col(c)
    return F.when(F.isnan(c), None).otherwise(c)


def nonzero(c: Column | str) -> Column:
    """A zero price, volume or denominator counts as missing."""
    c = col(c)
    return F.when(c != 0, c)


def safe_div(num: Column | str, den: Column | str, default: float | None = None) -> Column:
    out = col(num) / nonzero(den)
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def simple_return(start: Column | str, end: Column | str) -> Column:
    return col(end) / nonzero(start) - F.lit(1.0)


def window_return(start: Column | str, end: Column | str) -> Column:
    """Return between two prices where either being zero also voids the window."""
    return nonzero(end) / nonzero(start) - F.lit(1.0)


def clip01(c: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(col(c).cast("double"), F.lit(0.0))))


def stable_id(*parts: Column | str, length: int = 12) -> Column:
    """Leading hex digits of the SHA-1 of the pipe-joined parts; NULL joins as empty."""
    texts = [F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha1(F.concat_ws("|", *texts)), 1, length)


def lit_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def action_name(c: Column | str) -> Column:
    token = F.upper(F.trim(col(c)))
    return F.coalesce(F.try_element_at(lit_map(ACTION_SYNONYMS), token), token)


def change_event_type(c: Column | str) -> Column:
    return F.try_element_at(lit_map(CHANGE_EVENT_TYPES), col(c))


def action_event_type(c: Column | str) -> Column:
    return (
        F.when(col(c) == "ADD", "OFFICIAL_INDEX_ADD")
        .when(col(c) == "DELETE", "OFFICIAL_INDEX_DELETE")
        .otherwise("RECONSTITUTION")
    )


def direction(event_type: Column | str) -> Column:
    return F.when(col(event_type).isin(*BUY_TYPES), 1).otherwise(0)


def any_date(c: Column | str) -> Column:
    """Best-effort date: the first format that parses, else NULL."""
    text = F.trim(col(c).cast("string"))
    parsed = [F.try_to_timestamp(text, F.lit(f)).cast("date") for f in DATE_FORMATS]
    return F.coalesce(*parsed, F.try_to_timestamp(text).cast("date"))


def tightness(adv_dollars: Column | str, reference: float = 5_000_000.0) -> Column:
    """Liquidity tightness in [0, 1]: thin names near 1, unknown liquidity 0."""
    a = col(adv_dollars)
    return (
        F.when(a.isNull(), 0.0).when(a <= 0, 1.0).otherwise(F.lit(reference) / (F.lit(reference) + a))
    )


def shares_outstanding(market_cap: Column | str, price: Column | str) -> Column:
    return nonzero(market_cap) / nonzero(price)


def inflow_dollars(weight_percent: Column | str, aum: Column | str, inflow: float = 0.05) -> Column:
    """Dollars a holding attracts when its fund takes ``inflow`` of its AUM."""
    return col(weight_percent) / 100.0 * col(aum) * F.lit(inflow)


def passes(predicate: Column, c: Column) -> Column:
    """A filter that unknown values pass."""
    return predicate | c.isNull()


def percent(c: Column | str, digits: int = 2) -> Column:
    """Presentation percent, half-even like the published tables."""
    return F.bround(col(c) * 100.0, digits)


def millions(c: Column | str, digits: int = 2) -> Column:
    return F.bround(col(c) / 1e6, digits)


def bucketise(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed buckets ``(a, b]``; out of range is NULL."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges[:-1], edges[1:], labels, strict=True))):
        out = F.when((c > low) & (c <= high), label).otherwise(out)
    return out
