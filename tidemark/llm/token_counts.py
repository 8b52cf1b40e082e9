"""Token counts of a unigram tokenizer by a Viterbi pass that keeps no path.

An Aho-Corasick automaton over the vocabulary lists the pieces that end at each character, the
longest first. The pass carries, for each place in a word, the best score and the number of
pieces of the path that has it. Ties follow the tokenizers library's unigram model: a later
start replaces an earlier one only with a strictly better score; a character without a piece of
its own may be an unknown piece at the least score minus 10, and neighbouring unknown pieces of
the best path count as one.

A text is cut before each blank as the library's "metaspace" step does, so words are
independent: each distinct word is counted once in a worker and looked up afterwards.

The vocabulary are the pieces of a public tokenizer file in rank order, with the logarithm of a
Zipf share as score.

Defined cases: a null or empty text has no tokens. Rows are independent: repeated rows give
repeated results and a null doc_id stays null. An empty table gives no rows. Only ``doc_id`` and
``text`` are read. A single word of any length is one pass over it with a place for each
character.
"""

from __future__ import annotations

from math import log

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import text as tx
from tidemark.llm.encoders import Memo

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
WORDS = 600_000  # words in a generation of a worker's memory


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores; the unknown piece is first. Control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    total = sum(1 / rank for rank in range(2, len(pieces) + 2))
    return [("<unk>", 0.0)] + [(piece, -log((k + 2) * total)) for k, piece in enumerate(pieces)]


class Counter:
    """Counts the tokens of texts."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces[1:]:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.words = Memo(self.word, WORDS)

    def word(self, word: str) -> int:
        """Pieces of the best path over one word, its leading blank mark included."""
        n = len(word)
        best: list[float | None] = [None] * (n + 1)
        best[0] = 0.0
        count, unknown = [0] * (n + 1), [False] * (n + 1)
        at = 0  # places up to here are settled but for the unknown piece

        def settle(upto: int) -> None:
            """Offer the unknown piece at each place no single character piece has reached."""
            nonlocal at
            while at < upto:
                at += 1
                if not single[at]:
                    score = best[at - 1] + self.unknown
                    if best[at] is None or score > best[at]:
                        best[at], count[at], unknown[at] = score, count[at - 1] + (not unknown[at - 1]), True

        single = bytearray(n + 1)
        for end, (size, score) in self.automaton.iter(word):
            end += 1
            if end - 1 > at:
                settle(end - 1)
            if size == 1:
                single[end] = 1
            total = best[end - size] + score
            if best[end] is None or total > best[end]:
                best[end], count[end], unknown[end] = total, count[end - size] + 1, False
        settle(n)
        return count[n]

    def text(self, text: str | None) -> int:
        """Tokens of a whole text; only the blank itself is a word boundary."""
        if not text:
            return 0
        marked = text.replace(" ", BLANK)
        if marked[0] != BLANK:
            marked = BLANK + marked
        return sum(map(self.words.__getitem__, marked.split(BLANK)[1:]))


_LOADED: dict[str, Counter] = {}


def load(path: str) -> Counter:
    """The worker's counter for a vocabulary file."""
    if path not in _LOADED:
        counter = Counter(vocabulary(path))
        plain = counter.word
        counter.words = Memo(lambda w: plain(BLANK + w), WORDS)
        _LOADED[path] = counter
    return _LOADED[path]


def token_counts(documents: DataFrame, path: str) -> DataFrame:
    """doc_id and n_tokens of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = load(path)
        counter.words.age()
        counts = [counter.text(t) for t in batch.column(1).to_pylist()]
        return tx.batch([tx.ids_of(batch.column(0)), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return tx.arrow_map(documents.select("doc_id", "text"), run, "doc_id long, n_tokens long")
