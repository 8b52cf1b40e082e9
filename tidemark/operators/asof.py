"""As-of joins on a key and an ordered column (JN1-JN6, JN8).

The right side is packed: one row per key and year holds its rows as arrays in time order, so
nothing orders all of its rows. The lookup points are reduced to their distinct (key, time)
pairs and join the one pack of their year; built-in array functions find the neighbour by
bisection. Where it lies in another year, the pack carries it: only packs are windowed, a few
rows a key. The left rows come back by an equi-join on (key, time), which spreads a hot key
over its dates and leaves the rest to AQE's skew split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from ..functions.scalars import simple_return
from ..session import durable, joins_in_place

_TS, _ROW, _SLOT, _TIMES, _ROWS, _BASE = "__ts", "__row", "__slot", "__times", "__rows", "__base"
YEAR_BITS, SLOT_BITS = 9, 24  # steps of the bisection: a year of days, or any slot


def pack(right: DataFrame, by: str | list[str], ts: str, columns: list[str] | None = None, slot: Column | None = None) -> DataFrame:
    """Rows of ``right`` as arrays in time order, one pack per key and slot (a year of ``ts``).

    ``(by, ts)`` must be unique, so a pack of days has at most 366. A table of packs may take the
    place of ``right`` in every function of this module; written once, it serves many lookups.
    """
    keys = [by] if isinstance(by, str) else list(by)
    held = [c for c in dict.fromkeys(columns or right.columns) if c not in keys]
    entry = F.struct(F.col(ts).alias(_TS), F.struct(*held).alias(_ROW))
    known = right.where(F.col(ts).isNotNull()).withColumn(_TS, F.col(ts))
    slots = (F.year(_TS) if slot is None else slot).alias(_SLOT)
    packs = known.groupBy(*keys, slots).agg(F.sort_array(F.collect_list(entry)).alias("__pack"))
    return packs.select(*keys, _SLOT, F.col(f"__pack.{_TS}").alias(_TIMES), F.col(f"__pack.{_ROW}").alias(_ROWS))


def with_base(packs: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the number of rows in earlier packs of the key."""
    earlier = W.partitionBy(*keys).orderBy(_SLOT).rowsBetween(W.unboundedPreceding, -1)
    return packs.withColumn(_BASE, F.coalesce(F.sum(F.size(_TIMES)).over(earlier), F.lit(0)))


def _count_until(strict: bool, bits: int) -> Column:
    """Entries of the pack before ``__ts``, or up to it: bisection in steps of powers of two."""
    size, steps = F.coalesce(F.size(_TIMES), F.lit(0)), F.array(*[F.lit(1 << b) for b in reversed(range(bits))])

    def step(k: Column, width: Column) -> Column:
        time = F.get(_TIMES, k + width - 1)
        before = time < F.col(_TS) if strict else time <= F.col(_TS)
        return F.when((k + width <= size) & before, k + width).otherwise(k)

    return F.aggregate(steps, F.lit(0), step)


def resolve_points(
    points: DataFrame,
    right: DataFrame,
    by: str | list[str],
    point_ts: str,
    right_ts: str,
    payload: dict[str, str] | list[str],
    *,
    forward: bool = False,
    strict: bool = False,
    slot: Column | None = None,
    known: bool = False,
) -> DataFrame:
    """Distinct (by, point_ts) points with the payload of their neighbouring right row.

    Unresolved points are left out, unless ``known`` keeps those whose key occurs in
    ``right``. See ``asof_join`` for the other arguments.
    """
    keys = [by] if isinstance(by, str) else list(by)
    names = payload if isinstance(payload, dict) else {c: c for c in payload}
    packs = right
    if _TIMES not in right.columns:
        packs = pack(right, keys, right_ts, list(dict.fromkeys([right_ts, *names])), slot)
    days = isinstance(packs.schema[_TIMES].dataType.elementType, DateType) and slot is None
    wanted = points.where(F.col(point_ts).isNotNull()).select(*keys, F.col(point_ts).alias(_TS)).distinct()
    wanted = wanted.withColumn(_SLOT, F.year(_TS) if slot is None else slot)
    # a pack for every slot that is asked for, with the neighbour from outside of it
    packs = packs.select(*keys, _SLOT, _TIMES, _ROWS)
    asked = wanted.select(*keys, _SLOT).distinct()
    asked = asked.select("*", *[F.lit(None).cast(packs.schema[c].dataType).alias(c) for c in (_TIMES, _ROWS)])
    # not a full join: its rows count as unordered, and the packs would move again for the window
    held = [F.first(c, ignorenulls=True).alias(c) for c in (_TIMES, _ROWS)]
    filled = packs.unionByName(asked).groupBy(*keys, _SLOT).agg(*held)
    order = W.partitionBy(*keys).orderBy(_SLOT)
    if forward:
        edge = F.first(F.get(_ROWS, F.lit(0)), ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing))
    else:
        edge = F.last(F.element_at(_ROWS, -1), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    filled = filled.withColumn("__edge", edge)
    if known:
        filled = filled.withColumn("__known", F.max(F.col(_ROWS).isNotNull()).over(W.partitionBy(*keys)))
    hits = wanted.join(filled, [*keys, _SLOT])
    # forward and strict look behind the equal times, as backward and not strict does
    place = _count_until(forward != strict, YEAR_BITS if days else SLOT_BITS)
    hits = hits.withColumn("__place", place)
    inside = F.get(_ROWS, F.col("__place") if forward else F.col("__place") - 1)
    hits = hits.withColumn(_ROW, F.coalesce(inside, F.col("__edge")))
    hits = hits.where(F.col("__known") if known else F.col(_ROW).isNotNull())
    return hits.select(
        *keys,
        F.col(_TS).alias(point_ts),
        *[F.col(f"{_ROW}.{c}").alias(n) for c, n in names.items()],
    )


def stored_points(points: DataFrame, right: DataFrame, by: str | list[str], *args, **kwargs) -> DataFrame:
    """``resolve_points`` as a written table, its packs moved once: by key, for window and joins alike.

    With ``slot`` a key's packs and points are not bounded by a calendar: they stay spread by slot.
    """
    hits = resolve_points(points, right, by, *args, **kwargs)
    if kwargs.get("slot") is not None:
        return durable(hits, "points")
    with joins_in_place(points.sparkSession):
        return durable(hits, "points")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: str | list[str],
    left_ts: str,
    right_ts: str,
    payload: dict[str, str] | list[str],
    *,
    forward: bool = False,
    strict: bool = False,
    slot: Column | None = None,
    points: DataFrame | None = None,
    stored: bool = False,
) -> DataFrame:
    """``left`` plus the payload of the last right row at or before ``left_ts``.

    ``forward`` takes the first row at or after; ``strict`` excludes equal times.
    ``payload`` maps right columns to output names. ``right`` has unique ``(by, right_ts)`` or is
    a table of packs. ``slot`` (an expression over ``__ts``, e.g. its month) makes smaller packs of
    a key whose right rows are not bounded by a calendar. ``points`` supplies the lookup
    points ``(by, left_ts)`` when a cheaper plan than ``left`` has them. ``stored`` writes the
    resolved points first, see ``stored_points``.
    """
    keys = [by] if isinstance(by, str) else list(by)
    names = payload if isinstance(payload, dict) else {c: c for c in payload}
    source = left if points is None else points
    hits = (stored_points if stored else resolve_points)(
        source, right, keys, left_ts, right_ts, names, forward=forward, strict=strict, slot=slot
    )
    side = hits.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col(left_ts).alias(_TS),
        *names.values(),
    )
    match = F.col(left_ts) == F.col(_TS)
    for i, k in enumerate(keys):
        match = match & (F.col(k) == F.col(f"__k{i}"))
    return left.join(side, match, "left").drop(_TS, *[f"__k{i}" for i in range(len(keys))])


def shift_bars(
    left: DataFrame, bars: DataFrame, by: str, ts: str, offset: Column, payload: dict[str, str]
) -> DataFrame:
    """JN4: the bar ``offset`` trading days from the bar on or after ``ts``.

    ``bars`` has (symbol, date) rows, or their packs. A bar's number is the number of bars in
    earlier packs and its place in its own.
    """
    packs = bars if _TIMES in bars.columns else pack(bars, "symbol", "date", ["date", *payload])
    numbered = with_base(packs, ["symbol"]).select("symbol", _BASE, F.posexplode(_ROWS).alias("__at", _ROW))
    number = (F.col(_BASE) + F.col("__at") + 1).alias("bar_no")
    numbered = numbered.select("symbol", number, F.col(f"{_ROW}.date").alias("date"), *[F.col(f"{_ROW}.{c}") for c in payload if c != "date"])
    points = left.select(F.col(by).alias("symbol"), F.col(ts).alias("__from"))
    found = resolve_points(points, packs, "symbol", "__from", "date", {"date": "__day"}, forward=True)
    # the number of the found bar, then the bar that many further on
    found = found.join(numbered.select(F.col("symbol").alias("__s"), F.col("date").alias("__d"), F.col("bar_no").alias("__no")), (F.col("symbol") == F.col("__s")) & (F.col("__day") == F.col("__d")))
    found = found.select(F.col("symbol").alias("__s"), "__from", "__no")
    out = left.join(found, (F.col(by) == F.col("__s")) & (F.col(ts) == F.col("__from")), "left").drop("__s", "__from")
    return at_position(out.withColumn("__no", F.col("__no") + offset), numbered, by, "__no", payload).drop("__no")


def at_position(
    left: DataFrame, bars: DataFrame, by: str, position: str, payload: dict[str, str]
) -> DataFrame:
    """The bar at a trading-day position, by equi-join on (symbol, bar_no)."""
    side = bars.select(
        F.col("symbol").alias("__sym"),
        F.col("bar_no").alias("__pos"),
        *[F.col(c).alias(n) for c, n in payload.items()],
    )
    match = (F.col(by) == F.col("__sym")) & (F.col(position) == F.col("__pos"))
    return left.join(side, match, "left").drop("__sym", "__pos")


def return_between(
    left: DataFrame,
    bars: DataFrame,
    by: str,
    start: str,
    end: str,
    name: str,
    from_field: str = "close",
    to_field: str = "close",
) -> DataFrame:
    """JN5: return from the bar on/after ``start`` to the bar on/before ``end``."""
    out = asof_join(left, bars, by, start, "date", {from_field: "__p0"}, forward=True)
    out = asof_join(out, bars, by, end, "date", {to_field: "__p1"})
    return out.withColumn(name, simple_return("__p0", "__p1")).drop("__p0", "__p1")


def asof_pair(
    left: DataFrame, right: DataFrame, by: str, dates: tuple[str, str], column: str, names: tuple[str, str],
    stored: bool = False,
) -> DataFrame:
    """A column of ``right`` (by, date) on or before each of two dates of a row.

    The points of both dates pass one window; the resolved points are joined once for each.
    """
    points = left.select(by, F.explode(F.array(*dates)).alias("__look"))
    hits = (stored_points if stored else resolve_points)(points, right, by, "__look", "date", {column: "__value"})
    out = left
    for day, name in zip(dates, names):
        side = hits.select(F.col(by).alias("__by"), F.col("__look"), F.col("__value").alias(name))
        match = (F.col(by) == F.col("__by")) & (F.col(day) == F.col("__look"))
        out = out.join(side, match, "left").drop("__by", "__look")
    return out


def benchmark_return(
    left: DataFrame, benchmark: DataFrame, market: str, start: str, end: str, name: str, stored: bool = False
) -> DataFrame:
    """JN6: benchmark return between the bars on/before both dates of the row.

    ``benchmark`` has (market, date, close): one row per market and trading day.
    """
    side = benchmark.withColumnRenamed("market", market)
    out = asof_pair(left, side, market, (start, end), "close", ("__b0", "__b1"), stored)
    return out.withColumn(name, simple_return("__b0", "__b1")).drop("__b0", "__b1")
