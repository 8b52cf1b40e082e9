"""Text extraction rules over document tables (TX1-TX5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import any_date, col
from .tickers import normalise_asx

# Wording of index announcements.
ADD_WORDS = r"(?iU)\b(add(?:ed|ition)?|inclu(?:de|sion)|join)\b"
DELETE_WORDS = r"(?iU)\b(delet(?:e|ion)|remov(?:e|al)|exclu(?:de|sion))\b"
CODE_TOKEN = r"(?U)\b(?:ASX[:\s]+)?([A-Z0-9]{3})\b"
DATE_TOKEN = (
    r"(?iU)\b(\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{4}"
    r"|\d{4}-\d{2}-\d{2})\b"
)

# Wording of index methodology rules, with the number of groups each has.
METHODOLOGY_RULES = {
    "max_weight_rules": (
        r"(?iU)(cap(?:ped)?|maximum weight|max(?:imum)? individual)[^.\n]{0,60}?(\d{1,2}(?:\.\d+)?\s?%)",
        2,
    ),
    "rebalance_frequency": (
        r"(?iU)(rebalanc\w+)[^.\n]{0,40}?"
        r"(quarterly|semi[- ]annually|semi[- ]annual|annually|monthly|daily)",
        2,
    ),
    "reconstitution_frequency": (
        r"(?iU)(reconstitut\w+|index review)[^.\n]{0,40}?"
        r"(quarterly|semi[- ]annually|semi[- ]annual|annually|monthly)",
        2,
    ),
    "weighting_scheme": (
        r"(?iU)(market[- ]capitali[sz]ation[- ]weighted|free[- ]float[- ]adjusted|equal[- ]weighted"
        r"|modified market cap|liquidity[- ]weighted|fundamentally weighted)",
        1,
    ),
    "market_cap_rules": (
        r"(?iU)(market capitali[sz]ation)[^.\n]{0,60}?"
        r"((?:US\$|A\$|\$|USD|AUD)?\s?\d[\d,.]*\s?(?:million|billion|m|bn))",
        2,
    ),
    "liquidity_rules": (
        r"(?iU)(average daily (?:value|volume) traded|adv|liquidity)[^.\n]{0,60}?"
        r"((?:US\$|A\$|\$)?\s?\d[\d,.]*\s?(?:million|m|thousand|k)?)",
        2,
    ),
}

# A rule can only match where one of these lower-case stretches occurs.
RULE_ANCHORS = {
    "max_weight_rules": ("cap", "max"),
    "rebalance_frequency": ("rebalanc",),
    "reconstitution_frequency": ("reconstitut", "index review"),
    "weighting_scheme": ("weighted", "adjusted", "modified market cap"),
    "market_cap_rules": ("market capitali",),
    "liquidity_rules": ("average daily", "adv", "liquidity"),
}

# Link and benchmark wording on fund pages.
BENCHMARK_NAME = r"(?iU)([A-Z][\w&/. ]{3,60}?(?:Index|Indices|Benchmark))"
BENCHMARK_ANCHORS = ("index", "indices", "benchmark")
# Characters a benchmark name may hold: a match never leaves a run of them.
NAME_BREAK = r"(?U)[^\w&/. ]+"
HOLDINGS_LINK = r'(?iU)href="([^"]+(?:holding|constituent)[^"]*\.(?:csv|xlsx|xls|json))"'


def _folded(text: Column) -> Column:
    """Lower case, with the two letters that only case-insensitive matching equates."""
    return F.translate(F.lower(text), "ſı", "si")


def _mentions(folded: Column, anchors: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(folded, F.lit(a)) for a in anchors])


def strip_tags(html: Column | str) -> Column:
    return F.regexp_replace(col(html), "<[^>]+>", " ")


def first_date(text: Column | str) -> Column:
    """The first date token of the text that is a real date."""
    tokens = F.regexp_extract_all(col(text), F.lit(DATE_TOKEN), F.lit(1))
    tidy = F.transform(
        tokens, lambda t: any_date(F.regexp_replace(F.replace(t, F.lit("."), F.lit("")), r"\s+", " "))
    )
    return F.try_element_at(F.filter(tidy, lambda d: d.isNotNull()), F.lit(1))


def announcement_candidates(
    docs: DataFrame, doc_id: str, text: str, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Low-confidence add/delete candidates of every document, distinct.

    One row per sentence line, then one per code token; the whole text is read.
    """
    lines = docs.select(
        doc_id,
        *carry,
        first_date(text).alias("announcement_date"),
        F.explode(F.split(F.col(text), r"[\n.]")).alias("line"),
    )
    is_add = F.col("line").rlike(ADD_WORDS)
    tokens = (
        lines.where(is_add | F.col("line").rlike(DELETE_WORDS))
        .withColumn("action", F.when(is_add, "ADD").otherwise("DELETE"))
        .withColumn(
            "token", F.explode(F.regexp_extract_all("line", F.lit(CODE_TOKEN), F.lit(1)))
        )
    )
    return (
        tokens.withColumn("asx_ticker", normalise_asx("token"))
        .where(F.col("asx_ticker").isNotNull())
        .select(
            doc_id,
            *carry,
            "asx_ticker",
            "action",
            "announcement_date",
            F.lit(None).cast("date").alias("effective_date"),
            F.lit(0.2).alias("confidence"),
            F.lit(True).alias("needs_verification"),
        )
        .distinct()
    )


def _groups(hit: Column, pattern: str, groups: int) -> Column:
    """Groups of an already matched stretch, joined by a space."""
    parts = [F.nullif(F.regexp_extract(hit, pattern, g), F.lit("")) for g in range(1, groups + 1)]
    return F.nullif(F.trim(F.concat_ws(" ", *parts)), F.lit(""))


def methodology_rules(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """First match of each rule, groups joined by a space, and the length read.

    The text is searched once per rule; groups are taken from the short match.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    folded = docs.select(doc_id, body.alias("body"), _folded(body).alias("folded"))
    hits = folded.select(
        doc_id,
        *[
            F.when(
                _mentions(F.col("folded"), RULE_ANCHORS[name]), F.regexp_extract("body", p, 0)
            ).alias(name)
            for name, (p, _) in METHODOLOGY_RULES.items()
        ],
        F.length("body").cast("long").alias("chars_extracted"),
    )
    return hits.select(
        doc_id,
        *[_groups(F.col(n), p, g).alias(n) for n, (p, g) in METHODOLOGY_RULES.items()],
        "chars_extracted",
    )


def page_mentions(
    pages: DataFrame, page_id: str, html: str, per_page: int | None = None
) -> DataFrame:
    """Benchmark names and holdings links of every page: distinct and sorted.

    ``per_page`` keeps the first so many of a page, if asked for. Names are only searched in the short stretches of name characters that mention one
    of the closing words, which keeps the scan linear in the page.
    """
    stretches = F.filter(
        F.split(F.col(html), NAME_BREAK), lambda x: _mentions(_folded(x), BENCHMARK_ANCHORS)
    )
    names = F.flatten(
        F.transform(stretches, lambda x: F.regexp_extract_all(x, F.lit(BENCHMARK_NAME), F.lit(1)))
    )
    links = F.regexp_extract_all(F.col(html), F.lit(HOLDINGS_LINK), F.lit(1))

    def found(hits: Column) -> Column:
        tidy = F.array_distinct(F.transform(hits, F.trim))
        ordered = F.array_sort(tidy)
        return ordered if per_page is None else F.slice(ordered, 1, per_page)

    kinds = F.array(
        F.struct(F.lit("benchmark").alias("kind"), found(names).alias("values")),
        F.struct(F.lit("holdings_link").alias("kind"), found(links).alias("values")),
    )
    return (
        pages.select(page_id, F.explode(kinds).alias("k"))
        .select(page_id, "k.kind", F.explode("k.values").alias("value"))
    )
