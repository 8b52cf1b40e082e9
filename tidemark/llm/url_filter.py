"""URL filters with dated lists, by built-in functions only.

A list is a log of dated entries that add or remove a pattern: a domain ("example.com", which
also covers its sub-domains) or a host with the first parts of a path ("example.com/a/b"). The
entries of a pattern become validity intervals, from an addition to the removal after it. A
capture is looked up under every pattern it could match, as of the day it was fetched: it meets
an entry when the interval holds that day; each (pattern, day) that occurs is resolved once, by an
as-of join with the starts of the intervals. Of the active entries the longest pattern decides,
on equal length an allowing one, then the first list by name.

Captures are numbered once in a written narrow table; only lookups that meet an entry go on to the
decision. A pattern with very many captures is a skewed join key, which the engine splits; a
pattern's entries are first reduced to one a day.

Defined cases: a null, empty or malformed URL, or a null day, meets nothing and is not blocked.
Host names are compared in lower case without a final dot; port, user, query and fragment do not
count. Entries without list, pattern, action or date are left out; repeated entries count once; of several
entries of one pattern on a day removal holds, and it takes effect on that day. Repeated captures
each keep their row. An empty list blocks nothing; an empty table gives no rows. Extra columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import text as tx

ADD, REMOVE = "add", "remove"
_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    """Host of a URL in lower case, empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _AUTHORITY, 1)), r"\.$", "")


def path_parts(url: Column) -> Column:
    """The parts of a URL's path that are not empty."""
    return F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), _PATH, 1), "/"), lambda p: p != "")


def intervals(entries: DataFrame) -> DataFrame:
    """(list_name, allows, pattern, valid_from, valid_to): to is the day of removal, null while active."""
    keys = ["list_name", "allows", "pattern"]
    known = entries.where("list_name is not null and pattern is not null and entry_date is not null and action in ('add', 'remove')")
    known = known.select("list_name", F.coalesce("allows", F.lit(False)).alias("allows"), F.lower("pattern").alias("pattern"), "entry_date", "action")
    daily = known.groupBy(*keys, "entry_date").agg(F.max("action").alias("action"))  # "remove" is the larger
    following = F.lead("entry_date").over(Window.partitionBy(*keys).orderBy("entry_date"))
    return daily.withColumn("valid_to", following).where(F.col("action") == ADD).select(*keys, F.col("entry_date").alias("valid_from"), "valid_to")


def patterns_of(name: Column, parts: Column, depth: Column) -> Column:
    """Every pattern that a host and its path can match: its domains, and paths down to ``depth`` parts."""
    labels = F.split(name, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    taken = F.least(F.size(parts), depth)
    paths = F.transform(
        F.when(taken > 0, F.sequence(F.lit(1), taken)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(name, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")),
    )
    return F.when(name == "", F.array().cast("array<string>")).otherwise(F.concat(domains, paths))


def active_on(days: DataFrame, valid: DataFrame) -> DataFrame:
    """(listed, day, list_name, allows): the entries that hold a pattern on each of its (pattern, day)s.

    An as-of join: the days asked for, each once for a list that has the pattern at all, follow the
    starts of that list's intervals in time, and each takes the last start before or on it. It is
    active if that interval has not ended by then. A window has a pattern's days and starts only,
    so a list that changed often costs its changes once, not once for each capture.
    """
    keys = ["list_name", "allows", "pattern"]
    points = days.distinct().join(valid.select(*keys).distinct(), "pattern").select(*keys, "day", F.lit(None).cast("date").alias("since"), F.lit(None).cast("date").alias("until"))
    starts = valid.select(*keys, F.col("valid_from").alias("day"), F.col("valid_from").alias("since"), F.col("valid_to").alias("until"))
    order = Window.partitionBy(*keys).orderBy("day", F.col("since").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("since").isNotNull(), F.struct("since", "until")), ignorenulls=True).over(order)
    met = starts.unionByName(points).withColumn("last", last).where(F.col("since").isNull() & F.col("last").isNotNull())
    held = met.where(F.col("last.until").isNull() | (F.col("day") < F.col("last.until")))
    return held.select(F.col("pattern").alias("listed"), "day", "list_name", "allows")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, fetched_on, blocked, and the deciding list_name and pattern with n_active entries.

    ``captures``: page_id, url, fetched_on. ``entries``: list_name, allows, pattern, action, entry_date.
    """
    numbered = captures.select(F.monotonically_increasing_id().alias("row"), "page_id", F.col("url"), "fetched_on")
    numbered = tx.durable(numbered.select("row", "page_id", "fetched_on", host("url").alias("host"), path_parts("url").alias("parts")), "captures")
    valid = tx.durable(intervals(entries), "intervals")
    deepest = valid.agg(F.coalesce(F.max(F.size(F.split("pattern", "/")) - 1), F.lit(0)).alias("depth")).first()["depth"]
    lookups = numbered.where("fetched_on is not null").select(
        "row", "fetched_on", F.explode(F.array_distinct(patterns_of(F.col("host"), F.col("parts"), F.lit(deepest)))).alias("pattern")
    )
    active = lookups.join(active_on(lookups.select("pattern", F.col("fetched_on").alias("day")), valid), (lookups["pattern"] == F.col("listed")) & (lookups["fetched_on"] == F.col("day")))
    # longest pattern, then allowing, then the first list: the maximum, with names in falling order
    best = F.min(F.struct((-F.length("pattern")).alias("size"), (~F.col("allows")).alias("blocks"), "list_name", "pattern"))
    decided = active.groupBy("row").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
    return numbered.join(decided, "row", "left").select(
        "page_id", "fetched_on", F.coalesce("best.blocks", F.lit(False)).alias("blocked"),
        F.col("best.list_name").alias("list_name"), F.col("best.pattern").alias("pattern"), F.coalesce("n", F.lit(0)).cast("long").alias("n_active"),
    )


# The registered query has no crawl log and no published lists, so both follow from ``pages``:
# days from the page number, and entries from the hosts and paths that occur.
FIRST_DAY, DAYS = "2024-01-01", 730


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures with a day of fetching."""
    day = F.pmod(F.col("page_id") * 7919, F.lit(DAYS)).cast("int")
    return pages.select("page_id", "url", F.date_add(F.to_date(F.lit(FIRST_DAY)), day).alias("fetched_on"))


def _day(key: Column, salt: str, span: int) -> Column:
    """A day number below ``span`` from a hash of a text."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key)), 1, 6), 16, 10).cast("int") % span


def entries_of(pages: DataFrame) -> DataFrame:
    """List entries on the hosts and paths of the pages.

    ``subjects``: domains whose name holds a betting, pharmacy or adult word are added, removed
    and added again. ``hosts``: every fifth host is added, half of those removed later. ``paths``:
    on other hosts some first path parts are added. ``trusted`` allows some listed hosts for a while.
    """
    name = host(F.col("url"))
    hosts = pages.select(name.alias("host")).where("host <> ''").distinct()
    domain = F.regexp_replace("host", r"^(www|m|blog)\.", "")
    first = F.to_date(F.lit(FIRST_DAY))

    def entry(rows: DataFrame, list_name: str, pattern: Column, action: str, day: Column, allows: bool = False) -> DataFrame:
        return rows.select(
            F.lit(list_name).alias("list_name"), F.lit(allows).alias("allows"), pattern.alias("pattern"),
            F.lit(action).alias("action"), F.date_add(first, day).alias("entry_date"),
        )

    subjects = hosts.where(F.col("host").rlike("casino|bets|pills|adult")).select(domain.alias("host")).distinct()
    one, two, three = (_day(F.col("host"), salt, span) for salt, span in (("a", 200), ("b", 200), ("c", 200)))
    fifth = hosts.where(_day(F.col("host"), "d", 5) == 0)
    trusted = hosts.where(_day(F.col("host"), "e", 7) == 0)
    parts = pages.select(name.alias("host"), F.get(path_parts(F.col("url")), 0).alias("part")).where("host <> '' and part is not null").distinct()
    paths = parts.select(F.concat("host", F.lit("/"), "part").alias("pattern")).where(_day(F.col("pattern"), "f", 4) == 0)
    out = [
        entry(subjects, "subjects", F.col("host"), ADD, one),
        entry(subjects, "subjects", F.col("host"), REMOVE, one + two + 1),
        entry(subjects, "subjects", F.col("host"), ADD, one + two + three + 2),
        entry(fifth, "hosts", F.col("host"), ADD, one),
        entry(fifth.where(_day(F.col("host"), "g", 2) == 0), "hosts", F.col("host"), REMOVE, one + two),
        entry(paths, "paths", F.col("pattern"), ADD, _day(F.col("pattern"), "a", 500)),
        entry(trusted, "trusted", F.col("host"), ADD, one, True),
        entry(trusted, "trusted", F.col("host"), REMOVE, one + three + 1, True),
    ]
    entries = out[0]
    for more in out[1:]:
        entries = entries.unionByName(more)
    return entries
