"""Order statistics that never gather a group in one task.

Medians, percentile ranks, drawdowns and positions all need a total order. Percentile ranks cut
every group into contiguous buckets by a rule on the row itself; quantiles count by such buckets
first and order only the values of those that hold a wanted rank. Drawdowns and positions lay the
rows out in order over ranges and put together what each range says about itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import col, nonzero
from ..session import durable

_PER_OCTAVE = 256
_ZERO_SHIFT = 1100 * _PER_OCTAVE


def magnitude_bucket(value: Column | str) -> Column:
    """Order-preserving integer: sign and 256 steps per power of two of the magnitude.

    At most about 1.1 million distinct buckets exist for doubles, about 7,000 between
    1e-4 and 1e4 with both signs.
    """
    v = col(value).cast("double")
    step = (F.floor(F.log2(F.abs(v)) * _PER_OCTAVE) + _ZERO_SHIFT).cast("long")
    return F.when(v > 0, step).when(v < 0, -step).when(v == 0, F.lit(0).cast("long"))


def _keyed(df: DataFrame, keys: list[str]) -> Column:
    """Null-safe join condition on the group keys, right side prefixed ``__j_``."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__j_{k}"))
    return cond


def _attach(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"__j_{k}" for k in keys})
    return left.join(renamed, _keyed(left, keys), how).drop(*[f"__j_{k}" for k in keys])


def _unpivot(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value"))
            for c in columns
        ]
    )
    return (
        df.select(*ids, F.explode(pairs).alias("__p"))
        .select(*ids, "__p.measure", "__p.value")
        .where(F.col("value").isNotNull())
    )


def _value_counts(long: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct values with counts; partial aggregation collapses ties on the map side."""
    return (
        long.groupBy(*keys, "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("__bucket", magnitude_bucket("value"))
    )


def _bucket_offsets(counts: DataFrame, keys: list[str]) -> DataFrame:
    order = W.partitionBy(*keys).orderBy("__bucket")
    return (
        counts.groupBy(*keys, "__bucket")
        .agg(F.sum("n").alias("in_bucket"))
        .withColumn(
            "before",
            F.coalesce(F.sum("in_bucket").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        )
        .withColumn("total", F.sum("in_bucket").over(W.partitionBy(*keys)))
    )


# Rows of one wanted range that are put in order at last; a larger range is narrowed again.
MAX_RANGE, CELLS = 1 << 20, 1 << 12
_CELL = ["__cell"]


def _targets(probs: tuple[float, ...]) -> Column:
    """The two ranks next to each quantile, with their shares of it."""
    out = []
    for p in probs:
        h = (F.col("__total") - 1) * F.lit(float(p))
        low = F.floor(h)
        share = h - low
        for rank, w in ((low, 1.0 - share), (F.least(low + 1, F.col("__total") - 1), share)):
            out.append(F.struct(F.lit(float(p)).alias("prob"), rank.alias("rank"), w.alias("w")))
    return F.array(*out)


def _wanted(rows: DataFrame, keys: list[str], probs: tuple[float, ...] | None) -> DataFrame:
    """Of all cells of the rows, those with a wanted rank: least and largest value, number, rows before.

    Only counts by cell are shuffled, combined on the map side first. ``probs`` is given for the
    first narrowing; later ones find ``__targets`` and ``__before`` on the rows.
    """
    known = [] if probs else [F.first("__targets").alias("__targets"), F.first("__before").alias("__start")]
    group = keys if probs else [*keys, "__outer"]
    cells = rows.groupBy(*group, *_CELL).agg(
        F.count(F.lit(1)).alias("__n"), F.min("value").alias("__low"), F.max("value").alias("__high"), *known
    )
    order = W.partitionBy(*group).orderBy(*_CELL).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__n").over(order), F.lit(0))
    cells = cells.withColumn("__before", before if probs else before + F.col("__start"))
    if probs:
        cells = cells.withColumn("__total", F.sum("__n").over(W.partitionBy(*group))).withColumn("__targets", _targets(probs))
    here = F.filter(
        "__targets", lambda t: (t["rank"] >= F.col("__before")) & (t["rank"] < F.col("__before") + F.col("__n"))
    )
    found = cells.withColumn("__targets", here).where(F.size("__targets") > 0)
    return found.select(*group, *_CELL, "__n", "__low", "__high", "__before", "__targets")


def grouped_quantiles(
    df: DataFrame, keys: list[str], columns: list[str], probs: tuple[float, ...] = (0.5,)
) -> DataFrame:
    """Exact linearly interpolated quantiles: keys, measure, prob, quantile (AG7, AG9).

    Selection in passes. The first counts values by ``magnitude_bucket`` and keeps the few buckets
    that hold a wanted rank; the second shuffles the values of these buckets only. A bucket of more
    than ``MAX_RANGE`` different-valued rows is cut into equal cells between its least and largest
    value, as often as needed, before its values are put in order.
    """
    group = [*keys, "measure"]
    rows = _unpivot(df, keys, columns).withColumn("__cell", magnitude_bucket("value"))
    wanted = durable(_wanted(rows, group, probs), "ranks")
    while wanted.where((F.col("__n") > MAX_RANGE) & (F.col("__low") < F.col("__high"))).limit(1).count():
        inside = _attach(rows, wanted.drop("__n"), [*group, *_CELL])
        width = nonzero(F.col("__high") - F.col("__low"))
        share = F.coalesce((F.col("value") - F.col("__low")) / width, F.lit(0.0))
        # the cell it was in keeps apart the ranges of one group
        rows = inside.withColumn("__outer", F.col("__cell")).withColumn("__cell", F.floor(share * F.lit(float(CELLS))))
        narrowed = durable(_wanted(rows, group, None), "ranks")
        both = F.struct("__outer", "__cell")
        rows = rows.drop("__low", "__high", "__before", "__targets").withColumn("__cell", both).drop("__outer")
        wanted = narrowed.withColumn("__cell", both).drop("__outer")
    inside = _attach(rows.select(*group, "__cell", "value"), wanted, [*group, *_CELL])
    counts = inside.groupBy(*group, "__cell", "value").agg(
        F.count(F.lit(1)).alias("__n"), F.first("__before").alias("__before"), F.first("__targets").alias("__targets")
    )
    upto = W.partitionBy(*group, "__cell").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    hits = (
        counts.withColumn("__end", F.col("__before") + F.sum("__n").over(upto))
        .withColumn("t", F.explode("__targets"))
        .where((F.col("t.rank") >= F.col("__end") - F.col("__n")) & (F.col("t.rank") < F.col("__end")))
    )
    return hits.groupBy(*group, F.col("t.prob").alias("prob")).agg(
        F.sum(F.col("t.w") * F.col("value")).alias("quantile")
    )


def grouped_medians(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """One row per group with the exact median of each column under its new name."""
    q = grouped_quantiles(df, keys, list(columns))
    return q.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("measure") == c, F.col("quantile"))).alias(n)
            for c, n in columns.items()
        ]
    )


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Null-safe join of two per-group tables."""
    return _attach(left, right, keys, how)


def percentile_ranks(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """WN11: average-tie rank over the non-null count: row_id, measure, pct_rank."""
    long = _unpivot(df, [row_id], columns)
    counts = _value_counts(long, ["measure"])
    offsets = _bucket_offsets(counts, ["measure"])
    inside = _attach(counts, offsets, ["measure", "__bucket"])
    earlier = (
        W.partitionBy("measure", "__bucket").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    )
    ranked = inside.select(
        "measure",
        "value",
        (
            (
                F.col("before")
                + F.coalesce(F.sum("n").over(earlier), F.lit(0))
                + (F.col("n") + 1) / 2.0
            )
            / F.col("total")
        ).alias("pct_rank"),
    )
    return long.join(ranked, ["measure", "value"]).select(row_id, "measure", "pct_rank")


def mean_rank(df: DataFrame, row_id: str, columns: list[str], name: str) -> DataFrame:
    """WN12: mean of the available percentile ranks of each row."""
    ranks = percentile_ranks(df, row_id, columns)
    # Adding rank by rank in column order keeps the sum independent of shuffle order.
    by_measure = ranks.groupBy(row_id).agg(
        *[
            F.max(F.when(F.col("measure") == c, F.col("pct_rank"))).alias(f"__r{i}")
            for i, c in enumerate(columns)
        ]
    )
    total, known = F.lit(0.0), F.lit(0)
    for i in range(len(columns)):
        total = total + F.coalesce(F.col(f"__r{i}"), F.lit(0.0))
        known = known + F.col(f"__r{i}").isNotNull().cast("int")
    return df.join(by_measure, row_id, "left").withColumn(
        name, F.when(known > 0, total / known)
    ).drop(*[f"__r{i}" for i in range(len(columns))])


# Rows of a segment: what one window orders, whatever the size of a group.
SEGMENT_BITS = 16
SEGMENT = 1 << SEGMENT_BITS
# Segments that are merged at a time.
FAN_IN = 1024
_PART_BITS = 33  # row ids have the number of their part above these bits


def _sequence(df: DataFrame, keys: list[str], day: str, row_id: str, kept: list[str]) -> DataFrame:
    """The rows in (keys, day, id) order as a written table; ``__row`` rises along it.

    Rows are dealt by ranges of the whole order, so a group of any size is spread over the parts.
    """
    order = [F.asc_nulls_first(c) for c in (*keys, day, row_id)]
    columns = list(dict.fromkeys([*keys, day, row_id, *kept]))
    placed = df.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order)
    return durable(placed.withColumn("__row", F.monotonically_increasing_id()), "sequence")


def ordered_positions(df: DataFrame, keys: list[str], day: str, row_id: str) -> DataFrame:
    """0-based ``pos`` and ``n_seq`` of every row in its group's (day, id) order.

    A group's rows lie side by side in each part, so a row's place is its distance from the first one
    plus the rows of the parts before: one row for each part and group.
    """
    rows = _sequence(df, keys, day, row_id, df.columns).withColumn("__part", F.shiftright("__row", _PART_BITS))
    parts = rows.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    before = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    placed = parts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    placed = placed.withColumn("n_seq", F.sum("__n").over(W.partitionBy(*keys))).drop("__n")
    pos = F.col("__row") - F.col("__first") + F.col("__before")
    return _attach(rows, placed, [*keys, "__part"]).withColumn("pos", pos).drop("__row", "__part", "__first", "__before")


def _merge(a: Column, b: Column) -> Column:
    """The summary of two neighbouring stretches of a curve, each from its own start."""
    shifted_low = a["growth"] + b["low"]
    return F.struct(
        (a["growth"] + b["growth"]).alias("growth"),
        F.greatest(a["high"], a["growth"] + b["high"]).alias("high"),
        F.least(a["low"], shifted_low).alias("low"),
        F.least(a["fall"], b["fall"], shifted_low - a["high"]).alias("fall"),
        (a["ruined"] | b["ruined"]).alias("ruined"),
    )


def _merge_runs(stretches: DataFrame, keys: list[str], place: Column) -> DataFrame:
    """Merge the stretches (__place, __s) of each group that share ``place``, in their order."""
    runs = stretches.groupBy(*keys, place.alias("__run")).agg(
        F.sort_array(F.collect_list(F.struct("__place", "__s"))).alias("__list")
    )
    rest = F.slice("__list", 2, F.size("__list"))
    merged = F.aggregate(rest, F.col("__list")[0]["__s"], lambda a, b: _merge(a, b["__s"]))
    return runs.select(*keys, F.col("__run").alias("__place"), merged.alias("__s"))


def max_drawdown(df: DataFrame, keys: list[str], ret: str, day: str, row_id: str) -> DataFrame:
    """AG8: worst fall of the compounded curve from its running peak, per group.

    Each segment of at most ``SEGMENT`` rows is summarised on its own: its growth, highest and
    lowest point and worst fall. The summaries of neighbours merge into one of the same kind, up a
    tree of about ``FAN_IN`` at a time, so no task orders more rows than a segment or merges more
    than a few thousand summaries, however long a group is.

    Growth is summed in logarithms, so a long curve neither overflows nor vanishes. A return of
    -100 % or less leaves nothing to compound: the fall of such a group is total, -1.
    """
    rows = _sequence(df.where(F.col(ret).isNotNull()), keys, day, row_id, [ret])
    rows = rows.withColumn("__place", F.shiftright("__row", SEGMENT_BITS))
    inside = W.partitionBy(*keys, "__place").orderBy("__row").rowsBetween(W.unboundedPreceding, 0)
    growth = F.when(F.col(ret) > -1, F.log1p(F.col(ret))).otherwise(0.0)
    curve = rows.select(*keys, "__place", "__row", F.col(ret).alias("__r"), F.sum(growth).over(inside).alias("__c"))
    curve = curve.withColumn("__fall", F.col("__c") - F.max("__c").over(inside))
    summary = F.struct(
        F.max_by("__c", "__row").alias("growth"), F.max("__c").alias("high"), F.min("__c").alias("low"),
        F.min("__fall").alias("fall"), (F.min("__r") <= -1).alias("ruined"),
    )
    stretches = curve.groupBy(*keys, "__place").agg(summary.alias("__s"))
    place, bits = F.col("__place"), _PART_BITS - SEGMENT_BITS
    # segments of a part, then parts: numbers of segments have gaps between parts
    segment = place.bitwiseAND(F.lit((1 << bits) - 1))
    stretches = _merge_runs(stretches, keys, place - segment + F.floor(segment / FAN_IN))
    for above in (F.shiftright(place, bits), F.floor(place / FAN_IN), F.floor(place / FAN_IN), F.lit(0).cast("long")):
        stretches = _merge_runs(stretches, keys, above)
    fall = F.when(F.col("__s.ruined"), F.lit(-1.0)).otherwise(F.exp("__s.fall") - 1.0)
    return stretches.select(*keys, fall.alias("max_drawdown"))
