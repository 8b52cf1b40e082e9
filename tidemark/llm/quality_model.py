"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A document is a sparse vector of hashed words (logarithm of the count, unit length), measures of
its structure and its recorded length. The score is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

which weighs every pair of features through ``RANK`` factors in time linear in the features.

It is fitted on at most ``SAMPLE`` labelled documents, taken in the order of a hash of doc_id;
scoring covers every document whole. The weights are a fixed ``FEATURES`` x (RANK + 1) table
that goes to every task. Labels, language, source and doc_id are never features.

Defined cases: a null or empty text has no words, only zero measures, and gets the score of
those. A null ``n_chars`` counts as 0. Rows are independent: repeated rows give repeated results,
a null doc_id stays null (and is never in the sample). Null or other labels than 0 and 1 are left
out; of contradicting labels of one document the smallest holds. Without any labelled document
every score is 0.5. An empty table gives no rows. Columns other than ``doc_id``, ``text`` and
``n_chars`` are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import quality_rules
from tidemark.llm import text as tx

WORD_BITS = 16
SAMPLE = 8192
RANK = 8
EPOCHS, BATCH, RATE, DECAY = 12, 32, 0.05, 1e-4
CUT = 0.7
STRUCTURE = (
    "words", "word_length", "symbols", "repeated", "dup_lines", "line_length", "letters", "upper", "digits", "distinct", "stops", "recorded",
)
FEATURES = (1 << WORD_BITS) + len(STRUCTURE)

_UPPER, _DIGIT, _STOP = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_STOP[list(b".!?")] = True


@dataclass
class Rows:
    """Sparse rows: features ``index[at[i]:at[i + 1]]`` with their values."""

    at: np.ndarray
    index: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def sums(self, per_feature: np.ndarray) -> np.ndarray:
        """Sum over each row; every row has its structure features, so none is empty."""
        return np.add.reduceat(per_feature, self.at[:-1], axis=0)

    def take(self, which: np.ndarray) -> Rows:
        sizes = np.diff(self.at)[which]
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.at[which], sizes)
        return Rows(np.concatenate([[0], np.cumsum(sizes)]), self.index[inside], self.value[inside])


def features(texts: pa.Array, n_chars: pa.Array) -> Rows:
    """Feature rows of a batch."""
    raw, offsets = tx.buffers(texts)
    words = tx.hash_words(raw, offsets)
    n_rows, n_words = len(texts), np.diff(words.row)
    row = np.repeat(np.arange(n_rows), n_words)
    code, count = np.unique((row << WORD_BITS) | (words.hashes[0] >> np.uint64(64 - WORD_BITS)).astype(np.int64), return_counts=True)
    of_row = code >> WORD_BITS
    weight = np.log1p(count)
    norm = np.sqrt(np.bincount(of_row, weight**2, n_rows))
    weight = weight / norm[of_row]
    measured = quality_rules._measure(tx.batch([pa.nulls(n_rows, pa.int64()), texts], ["doc_id", "text"]))
    m = {name: measured.column(name).to_numpy().astype(float) for name in quality_rules.MEASURES}

    def counted(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags[raw], dtype=np.int64)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    per_word = 1 / np.maximum(n_words, 1)
    per_char = 1 / np.maximum(m["word_chars"], 1)
    recorded = np.array(n_chars.cast(pa.int64()).fill_null(0)).astype(float)
    structure = np.stack([
        np.log1p(n_words) / 10, np.minimum(m["word_chars"] * per_word / 10, 2), np.minimum(m["n_symbols"] * per_word, 2),
        m["n_repeat_words"] * per_word, m["n_dup_lines"] / np.maximum(m["n_lines"], 1), np.log1p(n_words / np.maximum(m["n_lines"], 1)) / 5,
        m["n_alpha_words"] * per_word, counted(_UPPER) * per_char * 5, counted(_DIGIT) * per_char * 5,
        np.bincount(of_row, minlength=n_rows) * per_word, np.minimum(counted(_STOP) * per_word * 5, 2), np.log1p(np.maximum(recorded, 0)) / 12,
    ], axis=1)
    # words of a row first, its structure after them
    k = len(STRUCTURE)
    sizes = np.bincount(of_row, minlength=n_rows)
    at = np.concatenate([[0], np.cumsum(sizes + k)])
    index, value = np.zeros(at[-1], np.int64), np.zeros(at[-1])
    place = np.arange(len(code)) + of_row * k
    index[place], value[place] = code & ((1 << WORD_BITS) - 1), weight
    tail = (at[1:, None] - k + np.arange(k)[None, :]).ravel()
    index[tail], value[tail] = np.tile((1 << WORD_BITS) + np.arange(k), n_rows), structure.ravel()
    return Rows(at, index, value)


@dataclass
class Machine:
    """Bias, weights and factors."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def margin(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Margins, and the factor sums that the gradient needs as well."""
        scaled = self.factor[rows.index] * rows.value[:, None]
        sums = rows.sums(scaled)
        pairs = 0.5 * ((sums**2).sum(axis=1) - rows.sums((scaled**2).sum(axis=1)))
        return self.bias + rows.sums(self.weight[rows.index] * rows.value) + pairs, sums

    def score(self, rows: Rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows)[0], -40, 40)))


def fit(rows: Rows, labels: np.ndarray, seed: int = 11) -> Machine:
    """Logistic loss by AdaGrad over small batches; deterministic for given rows."""
    rng = np.random.default_rng(seed)
    machine = Machine(0.0, np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, RANK)))
    if not len(rows):
        return Machine(0.0, np.zeros(FEATURES), np.zeros((FEATURES, RANK)))
    seen_w, seen_v, seen_b = np.full(FEATURES, 1e-6), np.full((FEATURES, RANK), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), BATCH):
            chosen = order[a : a + BATCH]
            part = rows.take(chosen)
            margin, sums = machine.margin(part)
            slope = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - labels[chosen]) / len(chosen)
            each = np.repeat(slope, np.diff(part.at))
            total = np.repeat(sums, np.diff(part.at), axis=0)
            used, place = np.unique(part.index, return_inverse=True)
            grad_w = np.bincount(place, each * part.value, len(used)) + DECAY * machine.weight[used]
            pull = (each * part.value)[:, None] * (total - machine.factor[part.index] * part.value[:, None])
            grad_v = np.stack([np.bincount(place, pull[:, f], len(used)) for f in range(RANK)], axis=1) + DECAY * machine.factor[used]
            seen_w[used] += grad_w**2
            seen_v[used] += grad_v**2
            seen_b += slope.sum() ** 2
            machine.weight[used] -= RATE * grad_w / np.sqrt(seen_w[used])
            machine.factor[used] -= RATE * grad_v / np.sqrt(seen_v[used])
            machine.bias -= RATE * slope.sum() / np.sqrt(seen_b)
    return machine


def held_out() -> object:
    """Whether a document is kept from learning."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _columns(documents: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("long") if "n_chars" in documents.columns else F.lit(None).cast("long")
    return documents.select("doc_id", "text", n_chars.alias("n_chars"))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` labelled documents outside the held-out fold."""
    labelled = (
        labels.select("doc_id", F.col("quality").alias("label")).where("doc_id is not null and label in (0, 1)")
        .where(~held_out()).groupBy("doc_id").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    chosen = _columns(documents).join(F.broadcast(labelled), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text", "n_chars").limit(sample)

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = features(batch.column(1), batch.column(2))
        parts = [(rows.index[a:b].tolist(), rows.value[a:b].tolist()) for a, b in zip(rows.at[:-1], rows.at[1:])]
        return tx.batch([batch.column(0), batch.column(3).cast(pa.int32()), pa.array([p[0] for p in parts], pa.list_(pa.int32())), pa.array([p[1] for p in parts], pa.list_(pa.float32()))], ["doc_id", "label", "index", "value"])

    table = tx.arrow_map(chosen, vectors, "doc_id long, label int, index array<int>, value array<float>").toArrow()
    table = table.combine_chunks().sort_by("doc_id")
    index, value = table.column("index").combine_chunks(), table.column("value").combine_chunks()
    sizes = np.array([len(x) for x in index], np.int64) if len(table) else np.zeros(0, np.int64)
    rows = Rows(np.concatenate([[0], np.cumsum(sizes)]), index.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy().astype(float))
    return fit(rows, table.column("label").to_numpy().astype(float))


def score(documents: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(Machine(machine.bias, machine.weight.astype(np.float32), machine.factor.astype(np.float32)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = shared.value.score(features(batch.column(1), batch.column(2)))
        return tx.batch([tx.ids_of(batch.column(0)), pa.array(found.astype(float))], ["doc_id", "score"])

    return tx.arrow_map(_columns(documents), run, "doc_id long, score double")


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a machine fitted on the labelled ones."""
    scored = score(documents, train(documents, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
