"""Landed tables in and report tables out (IO1-IO7, IO11, IO18-IO28)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import action_name, any_date
from ..functions.tickers import normalise_asx
from ..operators.diagnostics import inefficiency, scoreboard
from ..operators.registry import registry_splits
from ..operators.screens import watchlist
from ..schemas import (
    ANNOUNCEMENTS,
    CANONICAL_EVENT_OUTPUT,
    EVENTS,
    HOLDINGS,
    REGISTRY,
    TRIAL_LOG,
    conform,
)
from .holdings_files import split_line

# Header spellings of announcement files.
ANNOUNCEMENT_ALIASES = {
    "provider": ("provider", "index_provider"),
    "index_name": ("index_name", "index", "benchmark"),
    "asx_ticker": ("asx_ticker", "ticker", "symbol"),
    "company_name": ("company_name", "name"),
    "action": ("action", "change", "event"),
    "announcement_date": ("announcement_date", "ann_date", "date"),
    "effective_date": ("effective_date", "eff_date"),
    "source_url": ("source_url", "source", "url"),
    "confidence": ("confidence",),
    "needs_verification": ("needs_verification",),
}
DEFAULT_ANNOUNCEMENT_CONFIDENCE = 0.9
# Ids of registry rows that stand for a missing product.
PLACEHOLDER_PREFIXES = ("TODO:", "BENCH:", "PROVIDER:")
ACQUISITION_ORDER = ("manual", "fmp", "download")


CORRUPT = "_corrupt_record"


def _csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None) -> DataFrame:
    """Every line of the files, with the ones that do not fit the columns also as they are."""
    reader = spark.read.option("header", True)
    wanted = schema or reader.csv(path).schema
    marked = T.StructType([*wanted.fields, T.StructField(CORRUPT, T.StringType())])
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(marked).csv(path)


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """IO1. Without a schema every column is text; types are set by the normalisers.

    The files share one header. No line is dropped: cells that cannot be read, or are not
    there, are NULL, and ``csv_rejects`` returns the lines concerned.
    """
    return _csv(spark, path, schema).drop(CORRUPT)


def csv_rejects(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """(path, line) of the lines ``read_csv`` could not read whole."""
    # Every column is asked for: the reader checks a line only against the columns it must give.
    cells = F.to_json(F.struct("*"))
    rows = _csv(spark, path, schema).select(F.col("_metadata.file_path").alias("path"), F.col(CORRUPT).alias("line"), cells.alias("cells"))
    return rows.where(F.col("line").isNotNull() & F.col("cells").isNotNull()).drop("cells")


def read_lines_by_header(spark: SparkSession, path: str) -> DataFrame:
    """Hand-kept files whose headers differ: (path, cells), one row a line.

    ``cells`` maps the names of the file's own header, in lower case, to the line's cells; empty cells
    are NULL. Lines and headers meet in a join on the file, so any number of files and
    headers is one branch of the plan, and the lines of a large file stay spread. Templates
    and blank lines are skipped; of columns with one name the first counts.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.regexp_replace("value", "^\ufeff", "").alias("value"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("no")).alias("at"),
    )
    name = F.element_at(F.split("path", "/"), -1)
    lines = lines.where((F.trim("value") != "") & ~name.startswith("_TEMPLATE"))
    heads = lines.groupBy(F.col("path").alias("__path")).agg(F.min_by("value", "at").alias("head"), F.min("at").alias("first"))
    header = F.transform(split_line(F.col("head")), lambda h: F.lower(F.trim(h)))
    heads = heads.select("__path", "first", header.alias("header"))
    body = lines.join(heads, F.col("path") == F.col("__path")).where(F.col("at") != F.col("first"))
    row = body.select("path", "header", split_line(F.col("value")).alias("row"))
    cells = F.transform("header", lambda h, i: F.struct(h.alias("name"), F.nullif(F.get("row", i), F.lit("")).alias("cell"), i.alias("i")))
    own = F.filter(cells, lambda c: F.array_position(F.col("header"), c["name"]) == c["i"] + 1)
    pairs = F.transform(own, lambda c: F.struct(c["name"].alias("key"), c["cell"].alias("value")))
    return row.select("path", F.map_from_entries(pairs).alias("cells"))


def cell(names: tuple[str, ...], cells: str = "cells") -> Column:
    """The cell under the first of the names that the line's header has."""
    out = F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(F.map_contains_key(cells, F.lit(name)), F.element_at(cells, F.lit(name))).otherwise(out)
    return out


def _flat(df: DataFrame) -> DataFrame:
    """CSV has no arrays: lists become comma-joined text."""
    return df.select(
        *[
            F.concat_ws(",", F.transform(f.name, lambda x: x.cast("string"))).alias(f.name)
            if isinstance(f.dataType, T.ArrayType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    """IO2. Report tables may ask for one file; everything else keeps its partitions."""
    out = _flat(df)
    (out.coalesce(1) if single_file else out).write.mode("overwrite").option("header", True).csv(path)
    return path


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """IO3"""
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """IO3"""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def read_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """IO4"""
    return spark.read.option("multiLine", multi_line).json(path)


def write_json(df: DataFrame, path: str) -> str:
    """IO4"""
    df.write.mode("overwrite").json(path)
    return path


# ------------------------------------------------------------------ bars and snapshots
def write_bars(bars: DataFrame, path: str) -> str:
    """Bars by year, sorted by symbol and date inside files, so symbol filters skip."""
    (
        bars.withColumn("year", F.year("date"))
        .repartition("year", "symbol")
        .sortWithinPartitions("symbol", "date")
        .write.mode("overwrite")
        .partitionBy("year")
        .parquet(path)
    )
    return path


def read_bars(
    spark: SparkSession, path: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """IO11: a date range prunes year folders before row groups are skipped."""
    bars = spark.read.parquet(path)
    if start is not None:
        bars = bars.where((F.col("year") >= int(start[:4])) & (F.col("date") >= F.lit(start).cast("date")))
    if end is not None:
        bars = bars.where((F.col("year") <= int(end[:4])) & (F.col("date") <= F.lit(end).cast("date")))
    return bars.drop("year")


def save_snapshots(holdings: DataFrame, path: str) -> str:
    """IO5: replaces exactly the (product, date) partitions it carries; each has one file,
    however many tasks hold its lines."""
    (
        conform(holdings, HOLDINGS)
        .repartition("product_ticker", "as_of_date")
        .sortWithinPartitions("product_ticker", "as_of_date", "constituent_ticker")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("product_ticker", "as_of_date")
        .parquet(path)
    )
    return path


def read_snapshots(spark: SparkSession, path: str, product: str | None = None) -> DataFrame:
    """IO6: one product prunes to its folder."""
    out = spark.read.schema(HOLDINGS).parquet(path)
    return conform(out if product is None else out.where(F.col("product_ticker") == product), HOLDINGS)


# ------------------------------------------------------------------ manual inputs
def read_manual_registry(spark: SparkSession, folder: str) -> DataFrame:
    """IO18: the two registry folders stacked, each line by its file's header; the folder gives
    the default type."""
    lines = read_lines_by_header(spark, f"{folder}/*_registry/*.csv")
    sub = F.element_at(F.split("path", "/"), -2)
    kind = F.when(sub == "etf_registry", F.lit("etf")).otherwise(F.lit("index"))
    named = lines.where(sub.isin("etf_registry", "index_registry")).select(
        kind.alias("__kind"), *[cell((f.name,)).alias(f.name) for f in REGISTRY.fields]
    )
    typed = registry_from_text(named.withColumn("record_type", F.coalesce("record_type", "__kind")))
    return typed.withColumn("source", F.lit("manual"))


def registry_from_text(raw: DataFrame) -> DataFrame:
    """Registry rows read as text: months to an array, numbers and flags typed."""
    out = raw
    if "rebalance_months" in raw.columns and not isinstance(
        raw.schema["rebalance_months"].dataType, T.ArrayType
    ):
        months = F.transform(F.split("rebalance_months", ","), lambda m: F.trim(m).try_cast("int"))
        out = out.withColumn("rebalance_months", F.filter(months, lambda m: m.isNotNull()))
    for field in REGISTRY.fields:
        if field.name in out.columns and not isinstance(field.dataType, T.ArrayType):
            out = out.withColumn(field.name, F.col(field.name).try_cast(field.dataType))
    return conform(out, REGISTRY)


def read_registry(spark: SparkSession, folder: str) -> DataFrame:
    """IO19: the two saved registry tables as one."""
    parts = [
        registry_from_text(read_csv(spark, f"{folder}/{n}.csv")) for n in ("etf_registry", "index_registry")
    ]
    return parts[0].unionByName(parts[1])


def _announcements(rows: DataFrame, text: Callable[[str], Column], has: Callable[[str], Column]) -> DataFrame:
    """SC23, SC24: canonical tickers, dates and actions of columns found under their aliases."""
    return conform(
        rows.select(
            text("provider").alias("provider"),
            text("index_name").alias("index_name"),
            normalise_asx(text("asx_ticker")).alias("asx_ticker"),
            text("company_name").alias("company_name"),
            action_name(text("action")).alias("action"),
            any_date(text("announcement_date")).alias("announcement_date"),
            any_date(text("effective_date")).alias("effective_date"),
            text("source_url").alias("source_url"),
            F.when(has("confidence"), text("confidence").try_cast("double")).otherwise(F.lit(DEFAULT_ANNOUNCEMENT_CONFIDENCE)).alias("confidence"),
            F.when(has("needs_verification"), text("needs_verification").try_cast("boolean")).otherwise(F.lit(False)).alias("needs_verification"),
        ),
        ANNOUNCEMENTS,
    )


def normalise_announcements(raw: DataFrame) -> DataFrame:
    """SC23, SC24 for a frame with any of the aliased columns."""
    lowered = {c.lower().strip(): c for c in raw.columns}

    def pick(name: str) -> str | None:
        return next((lowered[a] for a in ANNOUNCEMENT_ALIASES[name] if a in lowered), None)

    def text(name: str) -> Column:
        found = pick(name)
        return (F.lit(None) if found is None else F.col(f"`{found}`")).cast("string")

    return _announcements(raw, text, lambda name: F.lit(pick(name) is not None))


def read_announcements(spark: SparkSession, folder: str) -> DataFrame:
    """IO20: announcement CSVs, each line by its file's header; templates are skipped."""

    def has(name: str) -> Column:
        return reduce(lambda a, b: a | b, [F.map_contains_key("cells", F.lit(a)) for a in ANNOUNCEMENT_ALIASES[name]])

    lines = read_lines_by_header(spark, f"{folder}/*.csv")
    return _announcements(lines, lambda name: cell(ANNOUNCEMENT_ALIASES[name]), has)


def read_custom_events(spark: SparkSession, path: str) -> DataFrame:
    """IO21: hand-entered events; ``_product_ticker`` becomes ``product_ticker``."""
    raw = read_csv(spark, path).withColumnsRenamed(
        {"_product_ticker": "product_ticker", "_theme": "theme", "_aum": "aum"}
    )
    for name in ("announcement_date", "detected_date", "effective_date"):
        if name in raw.columns:
            raw = raw.withColumn(name, any_date(name))
    return raw


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """IO21: per-event cell overrides, typed like the events they patch."""
    raw = read_csv(spark, path)
    kinds = {f.name: f.dataType for f in EVENTS.fields}
    return raw.select(
        *[
            (any_date(c) if isinstance(kinds.get(c), T.DateType) else F.col(c).try_cast(kinds.get(c, T.StringType()))).alias(c)
            for c in raw.columns
        ]
    )


# ------------------------------------------------------------------ acquisition
def acquire(landed: list[DataFrame]) -> DataFrame:
    """IO27: holdings of all sources; a later source in the order replaces a (product,
    date) that an earlier one delivered, as saving a snapshot again does."""
    stacked = reduce(lambda a, b: a.unionByName(b), [conform(d, HOLDINGS) for d in landed])
    rank = F.lit(-1)
    for i, name in enumerate(ACQUISITION_ORDER):
        rank = F.when(F.col("source") == name, i).otherwise(rank)
    ranked = stacked.withColumn("__rank", rank)
    keys = ["product_ticker", "as_of_date"]
    best = ranked.groupBy(*keys).agg(F.max("__rank").alias("__rank"))
    return ranked.join(best, [*keys, "__rank"], "left_semi").drop("__rank")


def acquisition_gaps(registry: DataFrame, holdings: DataFrame) -> DataFrame:
    """IO27, ST7: funds of the registry that no source delivered."""
    product = F.upper("product_ticker")
    placeholder = reduce(lambda a, b: a | b, [product.startswith(p) for p in PLACEHOLDER_PREFIXES])
    wanted = registry.where((F.col("record_type") == "etf") & ~placeholder).select(
        product.alias("product_ticker")
    )
    delivered = holdings.where(F.col("source") != "manual").select("product_ticker").distinct()
    return wanted.join(delivered, "product_ticker", "left_anti")


def acquisition_summary(holdings: DataFrame) -> DataFrame:
    """IO27: snapshots per source."""
    return (
        holdings.select("source", "product_ticker", "as_of_date")
        .distinct()
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_snapshots"))
    )


def price_universe(watch: DataFrame, events: DataFrame) -> DataFrame:
    """IO28: watched symbols and every event's symbol, canonical and distinct."""
    both = watch.select("asx_ticker").union(events.select("asx_ticker"))
    return (
        both.select(normalise_asx("asx_ticker").alias("symbol"))
        .where(F.col("symbol").isNotNull())
        .distinct()
    )


def valid_symbols(df: DataFrame, listed: DataFrame, column: str = "asx_ticker") -> DataFrame:
    """FL7: keep symbols of the listed universe; an empty universe accepts everything.

    Emptiness is one existence probe, not a count.
    """
    known = listed.where(F.upper("symbol").endswith(".AX")).select(F.upper("symbol").alias("__s"))
    if known.isEmpty():
        return df
    return df.join(known.distinct(), F.upper(column) == F.col("__s"), "left_semi")


# ------------------------------------------------------------------ sinks
def save_registry(registry: DataFrame, folder: str) -> dict[str, str]:
    """IO22"""
    return {n: write_csv(df, f"{folder}/{n}.csv") for n, df in registry_splits(registry).items()}


def canonical_events(events: DataFrame) -> DataFrame:
    have = set(events.columns)
    return events.select(*[c for c in CANONICAL_EVENT_OUTPUT if c in have])


def scored_events(events: DataFrame) -> DataFrame:
    """FL5, SO2: scored events, best first."""
    return canonical_events(
        events.where(F.col("delayed_flow_opportunity_score").isNotNull())
    ).orderBy(F.desc("delayed_flow_opportunity_score"), "event_id")


def write_events(events: DataFrame, folder: str) -> dict[str, str]:
    """IO23"""
    return {
        "discovered_events": write_csv(canonical_events(events), f"{folder}/discovered_events"),
        "delayed_reaction_events": write_csv(scored_events(events), f"{folder}/delayed_reaction_events"),
    }


def write_ledger(ledger: DataFrame, folder: str) -> str:
    """IO24: the ledger as parquet by strategy."""
    return write_parquet(ledger, f"{folder}/ledger", ["strategy"])


def append_trials(spark: SparkSession, records: list[dict], path: str) -> None:
    """IO26: trial records of one research run, appended."""
    rows = [tuple(r.get(f) for f in TRIAL_LOG.fieldNames()) for r in records]
    spark.createDataFrame(rows, TRIAL_LOG).coalesce(1).write.mode("append").parquet(path)


def write_reports(
    events: DataFrame, ledger: DataFrame, folder: str, as_of: str | None = None
) -> dict[str, str]:
    """IO25: every report table. ``events`` and ``ledger`` should be written tables."""
    paths = write_events(events, folder)
    reports = {
        "strategy_scoreboard": scoreboard(ledger),
        "provider_inefficiency_ranking": inefficiency(events, "provider"),
        "theme_inefficiency_ranking": inefficiency(events, "theme"),
        "top_current_watchlist": canonical_events(watchlist(events, as_of)),
    }
    for name, df in reports.items():
        paths[name] = write_csv(df, f"{folder}/{name}", single_file=True)
    return paths
