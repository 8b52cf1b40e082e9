"""Quality rules as a bitmask ledger.

Every rule is evaluated once. The ledger keeps the measurements and one bit for each failed
rule; policies are versioned masks over those bits, so a new policy, or an ablation of one,
never reads a text again.

Defined cases: a null or empty text has no words and all its measurements are 0 (it fails
``few_words``). Rows are independent, so repeated rows give repeated results; a null doc_id
stays null. An empty table gives an empty ledger. Only ``doc_id`` and ``text`` are read, so
other columns of any name do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx

WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha_words"]
LEDGER_SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
# Bytes that make a word count as one with a letter: ASCII letters and any non-ASCII byte.
LETTER = np.zeros(256, bool)
LETTER[ord("a") : ord("z") + 1] = LETTER[ord("A") : ord("Z") + 1] = LETTER[128:] = True


@dataclass(frozen=True)
class Rule:
    """A named failure condition over the measurements; its place in ``RULES`` is its bit."""

    name: str
    fails: Column


def rules() -> list[Rule]:
    """All rules, in the order of their bits. Conditions are integer arithmetic only."""
    c = F.col
    return [
        Rule("few_words", c("n_words") < 20),
        Rule("repeated_windows", 100 * c("n_repeat_words") > 30 * c("n_words")),
        Rule("symbols", 100 * c("n_symbols") > 15 * c("n_words")),
        Rule("duplicate_lines", (c("n_lines") >= 4) & (100 * c("n_dup_lines") > 40 * c("n_lines"))),
        Rule("short_words", 10 * c("word_chars") < 20 * c("n_words")),
        Rule("long_words", 10 * c("word_chars") > 160 * c("n_words")),
        Rule("few_letters", 100 * c("n_alpha_words") < 60 * c("n_words")),
        Rule("many_words", c("n_words") > 100_000),
    ]


# Versioned policies: the names of the rules a document must not fail.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "v2": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words", "few_letters"),
}
CURRENT = "v2"


def mask_of(policy: str) -> int:
    """The bits of a policy."""
    names = [r.name for r in rules()]
    return sum(1 << names.index(name) for name in POLICIES[policy])


def _repeat_words(words: np.ndarray) -> int:
    """Words inside 8-word windows that occur at least twice; ``words``: hashes of one document."""
    windows = tx.window_hashes(words, WINDOW)
    if len(windows) < 2:
        return 0
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(windows, twice))
    cover = np.zeros(len(words) + 1, np.int64)
    cover[starts] += 1
    np.subtract.at(cover, np.minimum(starts + WINDOW, len(words)), 1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def _lines(raw: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(lines), len(lines) - len(set(lines))


def _measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    raw, offsets = tx.buffers(batch.column(1))
    words = tx.hash_words(raw, offsets)

    def per_row(flags: np.ndarray) -> np.ndarray:  # counts of a row: differences of running counts
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    points = per_row(~tx.SPACE[raw] & ((raw & 0xC0) != 0x80))
    letters = np.concatenate([[0], np.cumsum(LETTER[raw], dtype=np.int64)])
    with_letter = np.concatenate([[0], np.cumsum(letters[words.end] > letters[words.begin])])
    texts = [raw[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
    lines = [_lines(t) for t in texts]
    repeats = [_repeat_words(words.hashes[0][a:b]) for a, b in zip(words.row[:-1], words.row[1:])]
    return tx.batch(
        [
            tx.ids_of(batch.column(0)), np.diff(words.row), points, per_row(SYMBOL[raw]),
            pa.array([x[1] for x in lines], pa.int64()), pa.array(repeats, pa.int64()),
            pa.array([x[0] for x in lines], pa.int64()), np.diff(with_letter[words.row]),
        ],
        ["doc_id", *MEASURES],
    )


def _bits() -> Column:
    bits = F.lit(0).cast("long")
    for bit, rule in enumerate(rules()):
        bits = bits.bitwiseOR(F.when(rule.fails, F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, the measurements and ``failed_bits`` of all rules."""
    measured = tx.arrow_map(documents.select("doc_id", "text"), _measure, LEDGER_SCHEMA)
    return measured.withColumn("failed_bits", _bits())


def stored_ledger(documents: DataFrame) -> DataFrame:
    """The ledger as a written table: policies and ablations then read no text."""
    return tx.durable(ledger(documents), "quality-ledger")


def apply_policy(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Add ``base_failed`` and ``kept`` under a policy; reads the ledger only."""
    base, mask = mask_of("base"), mask_of(policy) | mask_of("base")
    failed = F.col("failed_bits")
    return entries.withColumns({
        "base_failed": failed.bitwiseAND(F.lit(base)) != 0,
        "kept": failed.bitwiseAND(F.lit(mask)) == 0,
    })


def ablations(entries: DataFrame) -> DataFrame:
    """For each policy and rule of it: documents failing the rule, and those only it rejects.

    The ledger is first reduced to a count per bit pattern (at most 2^rules rows, combined
    before the shuffle); everything else is bitwise arithmetic on those patterns.
    """
    patterns = entries.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    names = [r.name for r in rules()]
    cases = F.array(*[
        F.struct(
            F.lit(policy).alias("policy"), F.lit(name).alias("rule"),
            F.lit(1 << names.index(name)).cast("long").alias("bit"), F.lit(mask_of(policy)).cast("long").alias("mask"),
        )
        for policy, chosen in POLICIES.items() for name in chosen
    ])
    hit = F.col("failed_bits").bitwiseAND(F.col("c.mask"))
    return (
        patterns.select("failed_bits", "n", F.explode(cases).alias("c"))
        .groupBy("c.policy", "c.rule")
        .agg(
            F.sum(F.when(F.col("failed_bits").bitwiseAND(F.col("c.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(hit == F.col("c.bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
            F.sum(F.when(hit == 0, F.col("n")).otherwise(0)).alias("n_kept"),
        )
    )


def policy_bits(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Bits failed by any and by all documents of each group, by bitwise aggregation."""
    return entries.groupBy(*keys).agg(
        F.bit_or("failed_bits").alias("any_failed"), F.bit_and("failed_bits").alias("all_failed"), F.count(F.lit(1)).alias("n"),
    )


def verdicts(documents: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Ledger with the verdict of one policy."""
    return apply_policy(ledger(documents), policy)


def explained(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """A stored ledger with the verdicts of a policy and what leaving a rule out would change.

    ``sole_rule`` is the only rule of the policy a document fails, if it is just one, and
    ``n_kept_without`` the documents the policy would keep without that rule.
    """
    mask = mask_of(policy)
    failed = F.col("failed_bits").bitwiseAND(F.lit(mask))
    sole = F.lit(None).cast("string")
    for bit, rule in enumerate(rules()):
        if mask >> bit & 1:
            sole = F.when(failed == 1 << bit, F.lit(rule.name)).otherwise(sole)
    # a row for each rule of one policy
    effects = ablations(entries).where(F.col("policy") == policy).select(
        F.col("rule").alias("sole_rule"), (F.col("n_kept") + F.col("n_only_this")).alias("n_kept_without")
    )
    return apply_policy(entries, policy).withColumn("sole_rule", sole).join(F.broadcast(effects), "sole_rule", "left")


def kept_documents(documents: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents a policy keeps, with all their columns, in one pass."""
    names = documents.columns
    row_type = documents.select(F.struct(*names).alias("row")).schema["row"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row = batch.column(0)
        measured = _measure(tx.batch([pa.nulls(len(row), pa.int64()), row.field(names.index("text"))], ["doc_id", "text"]))
        return tx.batch([row, *[measured.column(m) for m in MEASURES]], ["row", *MEASURES])

    schema = f"row {row_type}, " + ", ".join(f"{m} long" for m in MEASURES)
    measured = tx.arrow_map(documents.select(F.struct(*names).alias("row")), run, schema)
    return apply_policy(measured.withColumn("failed_bits", _bits()), policy).where("kept").select("row.*")
