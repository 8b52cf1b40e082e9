"""Secret scans with built-in functions only.

Three base kinds are plain patterns. The entropy scan adds spans the patterns miss: candidate
strings of one character class, over which a window of ``WINDOW`` characters slides. The window
keeps a count for each character of the class and the sum of c log2 c over the counts; a step
changes two counts and two terms. Terms are whole numbers (``SCALE`` units a bit), so every
engine gets the same sum. The allow list takes known stretches (placeholders, alphabets, dates)
out of a candidate, and names made of lower-case words whole; what is left between the stretches is
judged part by part. A candidate is a span when a part that no base span holds has a window at
the threshold of the part's class, or holds a run of upper hex that reaches that class's threshold.

Positions follow from the lengths of the matches and of the text between them, in code points.

Defined cases: a null or empty text has no spans. Rows are independent: repeated rows give
repeated results and a null doc_id stays null. An empty table gives no rows. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 20
SCALE = 1 << 20
KINDS = ("assign", "access", "hex", "entropy")
SPANS = "array<struct<start:int,kind:int,stop:int>>"
ASSIGN_WORD, VALUE = "(?i:password|passwd|secret|token|api_?key)", "[A-Za-z0-9+/_.=-]"
# name: pattern, what must be found for the pattern to be tried, group and least length of it
BASE = {
    "assign": (rf"""{ASSIGN_WORD}["']?\x20*[:=]\x20*["']?({VALUE}+)""", rf"""{ASSIGN_WORD}["']?\x20*[:=]""", 1, 12),
    "access": (r"AKIA[A-Z0-9]+", r"AKIA", 0, 18),
    "hex": (r"[0-9a-f]{16,}", r"(?<![0-9a-f])[0-9a-f]{16}", 0, 16),  # runs are maximal, so shorter ones never take part
}


@dataclass(frozen=True)
class CharacterClass:
    """Strings wholly of these characters and matching ``needs``; threshold in bits a character."""

    name: str
    alphabet: str
    needs: str
    bits: float


_UPPER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
CLASSES = (
    CharacterClass("lower hex", _DIGITS + "abcdef", r"^(?=.*[a-f])(?=.*[0-9])[0-9a-f]+$", 3.0),
    CharacterClass("upper hex", _DIGITS + "ABCDEF", r"^(?=.*[A-F])(?=.*[0-9])[0-9A-F]+$", 3.0),
    CharacterClass("base 64", _UPPER + _UPPER.lower() + _DIGITS + "+/_-", r"^(?=.*[A-Za-z])(?=.*[0-9])[A-Za-z0-9+/_-]+$", 3.7),
    CharacterClass("letters", _UPPER + _UPPER.lower(), r"^(?=.*[a-z].*[A-Z].*[a-z].*[A-Z])[A-Za-z]+$", 4.0),
)
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{WINDOW},}}"
# Runs inside a part of a wider class, such as a key after a word and "_". Lower hex runs are base spans already.
RUN, RUN_CLASS = rf"[0-9A-F]{{{WINDOW},}}", CLASSES[1]
# Stretches that are no part of a key: placeholders, alphabets in order, checksums of nothing, dates.
ALLOWED = (
    r"(?i:example|sample|dummy|placeholder|changeme|redacted|x{6,}|0{8,}|0123456789|123456789a|abcdefghijk)"
    r"|d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709|e3b0c44298fc1c149afbf4c8996fb924"
    r"|[0-9]{4}-[0-9]{2}-[0-9]{2}"
)
# Whole candidates that are names: lower-case words, at most a number at the end.
NAME = r"^([a-z]+[/_-])+[a-z]+[0-9]{0,4}$"


def term(count: int) -> int:
    """c log2 c in whole units."""
    return round(count * log2(count) * SCALE) if count else 0


def _located(text: Column, pattern: str, guard: str, group: int, least: int, kind: int) -> Column:
    """Spans of the matches whose group has at least ``least`` characters.

    One pass marks the matches; ``text`` has no zero characters (see ``scan``), so they part matches
    and gaps, which then alternate.
    """
    able = text.rlike(guard)
    empty = F.array().cast("array<string>")
    pieces = F.when(able, F.split(F.regexp_replace(text, f"({pattern})", "\x00$1\x00"), "\x00", -1)).otherwise(empty)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("match"), F.array().cast(SPANS).alias("spans"))

    def step(state: Column, piece: Column) -> Column:
        begin, stop = state["at"], state["at"] + F.length(piece)
        span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop")))
        value = F.regexp_extract(piece, pattern, group) if group else piece
        found = state["match"] & (F.length(value) >= least)
        return F.struct(stop.alias("at"), (~state["match"]).alias("match"), F.when(found, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(pieces, start, step, lambda s: s["spans"])


def best_window(candidate: Column) -> Column:
    """Most entropy of any window of a candidate, in units a window.

    A step adds the next character and drops the oldest: the counts of these two in the window are
    all that changes in the sum.
    """
    terms = F.array(*[F.lit(term(c)).cast("long") for c in range(WINDOW + 2)])
    whole = F.lit(term(WINDOW)).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("long").alias("best"))

    def count(window: Column, c: Column) -> Column:
        return F.length(window) - F.length(F.replace(window, c, F.lit("")))

    def step(s: Column, i: Column) -> Column:
        c = F.substring(candidate, i, F.lit(1))
        full = i > WINDOW
        # the characters between the one that goes and the one that comes
        between = F.when(full, F.substring(candidate, i - WINDOW + 1, F.lit(WINDOW - 1))).otherwise(F.substring(candidate, F.lit(1), i - 1))
        gone = F.when(full, F.substring(candidate, i - WINDOW, F.lit(1)))
        n_in, n_out = count(between, c), count(between, gone)
        dropped = F.when(full, F.get(terms, n_out + 1) - F.get(terms, n_out)).otherwise(F.lit(0).cast("long"))
        total = s["sum"] - dropped + F.get(terms, n_in + 1) - F.get(terms, n_in)
        best = F.when(i >= WINDOW, F.greatest(s["best"], whole - total)).otherwise(s["best"])
        return F.struct(total.alias("sum"), best.alias("best"))

    return F.aggregate(F.sequence(F.lit(1), F.length(candidate)), start, step, lambda s: s["best"])


def _reaches(candidate: Column, c: CharacterClass) -> Column:
    """Whether a candidate of this class has a window at the class's threshold."""
    return best_window(candidate) >= round(c.bits * WINDOW * SCALE)


def _held(base: Column, start: Column, stop: Column) -> Column:
    """Whether a base span holds this range."""
    return F.exists(base, lambda b: (b["start"] <= start) & (b["stop"] >= stop))


def high_entropy(candidate: Column, at: Column, base: Column) -> Column:
    """Whether a part of the candidate between allowed stretches, not held by a base span, is random
    by its class or by a run inside it; ``at`` is the candidate's place in the text."""

    def random_run(part: Column, place: Column, span: Column) -> Column:
        run = F.substring(part, span["start"] + 1, span["stop"] - span["start"])
        return ~_held(base, place + span["start"], place + span["stop"]) & run.rlike(RUN_CLASS.needs) & _reaches(run, RUN_CLASS)

    def random_part(span: Column) -> Column:
        part, place = F.substring(candidate, span["start"] + 1, span["stop"] - span["start"]), at + span["start"]
        verdict = F.lit(False)
        for c in reversed(CLASSES):
            verdict = F.when(part.rlike(c.needs), _reaches(part, c)).otherwise(verdict)
        runs = _located(part, RUN, RUN, 0, WINDOW, len(BASE))
        long = span["stop"] - span["start"] >= WINDOW
        return long & ~_held(base, place, at + span["stop"]) & (verdict | F.exists(runs, lambda r: random_run(part, place, r)))

    taken = _located(candidate, ALLOWED, ALLOWED, 0, 1, len(BASE))
    begins = F.concat(F.array(F.lit(0)), F.transform(taken, lambda s: s["stop"]))
    ends = F.concat(F.transform(taken, lambda s: s["start"]), F.array(F.length(candidate)))
    parts = F.arrays_zip(begins.alias("start"), ends.alias("stop"))
    return ~candidate.rlike(NAME) & F.exists(parts, random_part)


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, ``base`` and ``added``: arrays of (start, kind, stop) in order; ``text`` as it was searched."""
    # a zero character is in no pattern and marks matches later, so another one takes its place
    text = F.coalesce("text", F.lit(""))
    zero, other = F.lit("\x00"), F.lit("\x01")
    out = documents.select("doc_id", F.when(F.contains(text, zero), F.replace(text, zero, other)).otherwise(text).alias("text"))
    out = out.withColumns({f"found_{name}": _located(F.col("text"), *BASE[name], kind) for kind, name in enumerate(BASE)})
    out = out.withColumn("base", F.array_sort(F.concat(*[f"found_{name}" for name in BASE])))
    out = out.withColumn("candidates", _located(F.col("text"), CANDIDATE, rf"(?<![A-Za-z0-9+/_-]){CANDIDATE}", 0, WINDOW, len(BASE)))

    def is_new(span: Column) -> Column:
        candidate = F.substring("text", span["start"] + 1, span["stop"] - span["start"])
        return ~_held(F.col("base"), span["start"], span["stop"]) & high_entropy(candidate, span["start"], F.col("base"))

    return out.withColumn("added", F.filter("candidates", is_new)).drop("candidates")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))))


def report(documents: DataFrame) -> DataFrame:
    """Counts of each kind, a hash of the base spans and all spans of each document."""
    found = scan(documents)
    return found.select(
        "doc_id",
        *[F.size(f"found_{name}").cast("long").alias(f"n_{name}") for name in BASE],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_entropy"),
    )


def mask(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span's text replaced by a mark; other columns stay as they are,
    but ``n_chars``, where there is one, follows the new text. Null texts stay null."""
    names = documents.columns
    packed = documents.select(F.struct(*names).alias("doc_id"), "text")
    found = scan(packed).withColumns({"all": F.array_sort(F.concat("base", "added")), "text": F.col("doc_id.text")})
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, span: Column) -> Column:
        fresh = span["start"] >= s["at"]
        before = F.substring("text", s["at"] + 1, span["start"] - s["at"])
        return F.struct(
            F.greatest(s["at"], span["stop"]).alias("at"),
            F.when(fresh, F.concat(s["out"], before, F.lit(mark))).otherwise(s["out"]).alias("out"),
        )

    masked = F.aggregate("all", start, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    clean = F.when(F.size("all") > 0, masked).otherwise(F.col("doc_id.text"))
    out = found.select(F.col("doc_id").alias("row"), clean.alias("clean"))
    new = {"text": F.col("clean")} | ({"n_chars": F.when(F.col("clean").isNull(), F.col("row.n_chars")).otherwise(F.length("clean")).cast("long")} if "n_chars" in names else {})
    return out.select(*[(new[n] if n in new else F.col(f"row.{n}")).alias(n) for n in names])
