"""Flow events from every source, deduplicated and patched (EV4-EV8, ST1, ST2, JN15)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import action_event_type, action_name, change_event_type, stable_id
from ..functions.tickers import tag_constituents
from ..schemas import BASE_EVENTS, conform
from ..session import durable
from .snapshots import DEALT, diff_history


def events_from_holdings(
    holdings: DataFrame, registry: DataFrame, compat: bool = False, dates: DataFrame | None = None
) -> DataFrame:
    """EV4: one event per mapped constituent that was added or resized.

    The holdings file is the public signal, so its date is both announcement and
    detection; there is no effective date. Deletions have no event type. Holdings that
    lie by stock (``dealt_by``) give events that do; ``dates`` as in ``diff_history``.
    """
    changes = (
        tag_constituents(diff_history(holdings, compat=compat, dates=dates))
        .withColumn("event_type", change_event_type("change_type"))
        .where(F.col("is_asx") & F.col("event_type").isNotNull())
    )
    product = F.upper("product_ticker")
    meta = registry.select(
        F.upper("product_ticker").alias("product"),
        F.col("index_provider").alias("provider"),
        "issuer",
        F.col("product_name").alias("meta_name"),
        F.col("benchmark_index_name").alias("benchmark"),
        "theme",
        "aum",
        F.col("number_of_holdings").alias("n_holdings"),
        "confidence_score",
    )
    joined = changes.withColumn("product", product).join(meta, "product", "left")
    # of a mapped line both are equal
    stock = DEALT if DEALT in changes.columns else "asx_symbol"
    return conform(
        joined.select(
            stable_id(
                F.lit("holdings"), "product_ticker", "asx_symbol", "event_type", "as_of_date"
            ).alias("event_id"),
            F.lit("holdings_diff").alias("source_type"),
            "provider",
            "issuer",
            F.coalesce("meta_name", "product_ticker").alias("etf_index_name"),
            "benchmark",
            F.col(stock).alias("asx_ticker"),
            F.col("constituent_name").alias("company_name"),
            "event_type",
            F.col("as_of_date").alias("announcement_date"),
            F.col("as_of_date").alias("detected_date"),
            "old_weight",
            "new_weight",
            "confidence_score",
            F.concat(F.lit("holdings_snapshot:"), F.col("product_ticker")).alias(
                "source_url_or_file"
            ),
            F.concat(
                F.lit("shares_delta="),
                F.coalesce(F.col("shares_delta").cast("string"), F.lit("")),
                F.lit("; weight_delta="),
                F.coalesce(F.col("weight_delta").cast("string"), F.lit("")),
            ).alias("notes"),
            F.col("product").alias("product_ticker"),
            "shares_delta",
            "weight_delta",
            "aum",
            "theme",
            "n_holdings",
        ),
        BASE_EVENTS,
    )


def events_from_announcements(announcements: DataFrame) -> DataFrame:
    """EV5: official additions, deletions and other index actions."""
    a = announcements.withColumn("event_type", action_event_type(action_name("action")))
    return conform(
        a.select(
            stable_id(
                F.lit("ann"), "provider", "index_name", "asx_ticker", "event_type",
                "announcement_date",
            ).alias("event_id"),
            F.lit("announcement").alias("source_type"),
            "provider",
            F.col("index_name").alias("etf_index_name"),
            F.col("index_name").alias("benchmark"),
            "asx_ticker",
            "company_name",
            "event_type",
            "announcement_date",
            F.col("announcement_date").alias("detected_date"),
            "effective_date",
            F.col("confidence").alias("confidence_score"),
            F.col("source_url").alias("source_url_or_file"),
            F.when(F.coalesce("needs_verification", F.lit(False)), "needs_verification")
            .otherwise("")
            .alias("notes"),
        ),
        BASE_EVENTS,
    )


def events_from_custom(custom: DataFrame) -> DataFrame:
    """EV6: hand-entered events; a blank id is derived, a blank type defaulted."""
    base = conform(custom, BASE_EVENTS)
    typed = base.withColumn(
        "event_type", F.coalesce("event_type", F.lit("CUSTOM_MANUAL_EVENT"))
    ).withColumn("source_type", F.lit("custom_manual"))
    derived = stable_id(F.lit("custom"), "asx_ticker", "event_type", "announcement_date")
    blank = F.coalesce(F.col("event_id"), F.lit("")) == ""
    return typed.withColumn("event_id", F.when(blank, derived).otherwise(F.col("event_id")))


def union_events(parts: list[DataFrame]) -> DataFrame:
    """ST1, ST2: stack the sources; the earliest listed source keeps a shared id.

    The survivor of a shared id is the smallest row by (source order, all columns), found
    by a partially aggregated minimum instead of a window, so copies of one id never meet
    in one task unreduced.
    """
    return _survivors(_stacked(parts)).select(*parts[0].columns)


def _stacked(parts: list[DataFrame]) -> DataFrame:
    if not parts:
        raise ValueError("no event sources given")
    ranked = [p.withColumn("__source", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def _survivors(stacked: DataFrame, *within: str) -> DataFrame:
    """The smallest row by (source order, all columns) of every event id, ``within`` the values of other columns."""
    columns = [c for c in stacked.columns if c not in ("__source", "event_id")]
    rows = stacked.groupBy(*within, "event_id").agg(F.min(F.struct("__source", *columns)).alias("__row"))
    rest = [c for c in stacked.columns if c not in within and c != "event_id"]
    return rows.select("event_id", *within, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*stacked.columns)


def union_events_by_stock(parts: list[DataFrame], write: Callable[[DataFrame], DataFrame], partitions: int) -> DataFrame:
    """``union_events`` as a table dealt by stock, whose wide rows move once, not by id and by stock.

    Parts that lie so already, in as many partitions, do not move at all. The survivors of each (stock, id) are written first. Only ids that lie with several stocks, found by
    hashes of ids, are decided among them then; most tables have none, and the written one is the result.
    """
    dealt = _stacked(parts).repartition(partitions, "asx_ticker")
    stored = write(_survivors(dealt, "asx_ticker"))
    hashed = stored.select(F.xxhash64("event_id").alias("__h"))
    shared = durable(hashed.groupBy("__h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__h"), "shared-ids")
    if shared.isEmpty():
        return stored.select(*parts[0].columns)
    # two ids of one hash are only decided once more
    mine = F.xxhash64("event_id") == F.col("__h")
    rest = stored.join(shared, mine, "left_anti")
    decided = _survivors(stored.join(shared, mine, "left_semi"))
    return write(rest.unionByName(decided)).select(*parts[0].columns)


def apply_overrides(events: DataFrame, overrides: DataFrame, order: str | None = None) -> DataFrame:
    """EV8: non-null override cells replace event cells; the latest row wins per cell.

    ``order`` is the column that says which of several rows for one id is later.
    """
    patched = [c for c in overrides.columns if c in events.columns and c != "event_id"]
    if not patched:
        return events
    if order is None:
        latest = [F.max(c).alias(f"__o_{c}") for c in patched]
    else:
        latest = [
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__o_{c}")
            for c in patched
        ]
    patch = overrides.groupBy("event_id").agg(*latest)
    joined = events.join(patch, "event_id", "left")
    return joined.select(
        *[
            F.coalesce(F.col(f"__o_{c}").cast(events.schema[c].dataType), F.col(c)).alias(c)
            if c in patched
            else F.col(c)
            for c in events.columns
        ]
    )


def build_events(
    holdings: DataFrame | None = None,
    registry: DataFrame | None = None,
    announcements: DataFrame | None = None,
    custom: DataFrame | None = None,
    overrides: DataFrame | None = None,
    override_order: str | None = None,
    compat: bool = False,
) -> DataFrame:
    """EV7: base events before any price enrichment."""
    events = union_events(event_parts(holdings, registry, announcements, custom, compat))
    return events if overrides is None else apply_overrides(events, overrides, override_order)


def event_parts(
    holdings: DataFrame | None = None,
    registry: DataFrame | None = None,
    announcements: DataFrame | None = None,
    custom: DataFrame | None = None,
    compat: bool = False,
    dates: DataFrame | None = None,
) -> list[DataFrame]:
    """Events of every given source, in the order that decides shared ids."""
    parts = []
    if holdings is not None and registry is not None:
        parts.append(events_from_holdings(holdings, registry, compat, dates))
    if announcements is not None:
        parts.append(events_from_announcements(announcements))
    if custom is not None:
        parts.append(events_from_custom(custom))
    return parts


def event_counts(events: DataFrame, *by: str) -> DataFrame:
    """AG19: number of events per combination of columns."""
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n_events"))
