"""Byte-level BPE from a rank file: encoding with a rank queue, and decoding.

A text is split by the vocabulary's pattern; each match is either a token itself or starts as its
single bytes, and the adjacent pair of the lowest rank, leftmost first, is merged until none has
a rank. The pairs wait in buckets, one for each rank, that hold places of a linked list of
tokens. Three levels of 64-bit words tell which buckets hold anything: the lowest set bit of each
level leads to the next rank in three steps, however many ranks there are. A merge changes the
pairs on both sides and leaves their old entries behind; an entry whose pair has another rank by
now is stale and skipped. So a match of n bytes takes about n log n steps, also one of millions.

All new matches of a batch share one list and one queue, as no pair reaches across two matches.
Matches that come again are looked up.

Defined cases: a null or empty text has no ids and no bytes. Repeated rows and null ids are
documents of their own. An empty table gives no rows. Special tokens are plain text. Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import base64
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm import encoders
from tidemark.llm import text as tx

CACHE_LIMIT = 500_000  # strings in a generation of a worker's cache; two are kept
CACHED_LENGTH = 64  # longer strings are encoded each time
WORD, SHIFT = 64, 6  # bits of a bitmap word
# Fixed value: the pattern of byte-level vocabularies, for which ``encoders`` has a faster form over
# texts of common characters.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ENCODED_SCHEMA, DECODED_SCHEMA = "doc_id long, ids array<int>", "doc_id long, ids array<int>, decoded binary"


class RankQueue:
    """Buckets of places by rank under a bitmap of three levels."""

    def __init__(self, n_ranks: int) -> None:
        words = -(-n_ranks // WORD)
        self.low = [0] * words  # a bit for each rank
        self.mid = [0] * -(-words // WORD)  # a bit for each word of ``low``
        self.top = 0  # a bit for each word of ``mid``
        self.buckets: list[list[int] | None] = [None] * (words * WORD)

    def fill(self, rank: int, places: list[int]) -> None:
        """Add a bucket for a rank that has none."""
        self.buckets[rank] = places
        word, above = rank >> SHIFT, rank >> 2 * SHIFT
        self.low[word] |= 1 << (rank & WORD - 1)
        self.mid[above] |= 1 << (word & WORD - 1)
        self.top |= 1 << above

    def push(self, rank: int, place: int) -> None:
        bucket = self.buckets[rank]
        if bucket is None:
            self.fill(rank, [place])
        else:
            bucket.append(place)

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank and its places, leftmost first."""
        above = (self.top & -self.top).bit_length() - 1
        bits = self.mid[above]
        word = above << SHIFT | (bits & -bits).bit_length() - 1
        bits = self.low[word]
        rank = word << SHIFT | (bits & -bits).bit_length() - 1
        self.low[word] = bits = bits & bits - 1
        if not bits:
            self.mid[above] = bits = self.mid[above] & self.mid[above] - 1
            if not bits:
                self.top &= self.top - 1
        places, self.buckets[rank] = self.buckets[rank], None
        places.sort()
        return rank, places


class Recent(dict):
    """Values of the strings met lately; a full generation becomes the older one."""

    def __init__(self) -> None:
        self.older: dict = {}

    def age(self) -> None:
        if len(self) > CACHE_LIMIT:
            self.older = dict(self)
            self.clear()

    def learn(self, new: set[str], compute) -> list[str]:
        """Make the strings ready; returns those that neither generation had."""
        out = []
        for s in new:
            value = self.older.get(s)
            if value is None:
                out.append(s)
            else:
                self[s] = value
        self.update(zip(out, compute(out)))
        return out

    def forget_long(self, strings: list[str]) -> None:
        for s in strings:
            if len(s) > CACHED_LENGTH:
                del self[s]


class Vocabulary:
    """A rank file and the pattern that splits texts before the merges."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.use({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)})
        self.pattern, self._split = pattern, regex.compile(pattern)
        self._common = encoders._SPLIT["byte"] if pattern == BYTE_LEVEL else None
        self.matches, self.stand_ins = Recent(), {}

    def use(self, ranks: dict[bytes, int]) -> None:
        """Tables of the ranks: what each pair of tokens merges to."""
        self.ranks, self.token = ranks, {rank: token for token, rank in ranks.items()}
        self.queue = RankQueue(max(self.token) + 1)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # for each token, what it makes with the token behind it
        self.pairs: list[dict[int, int]] = [{} for _ in range(max(self.token) + 1)]
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left][right] = rank
        byte = self.byte.tolist()
        self.byte_pair = np.array([self.pairs[a].get(b, -1) for a in byte for b in byte], np.int64)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """32-bit ids of each match, starting from its bytes."""
        n = sum(map(len, pieces))
        ends = np.cumsum([len(p) for p in pieces], dtype=np.int64)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        first = np.full(n, -1)
        first[:-1] = self.byte_pair[raw[:-1].astype(np.int64) << 8 | raw[1:]]
        first[ends - 1] = -1
        back = np.arange(-1, n)
        back[0] = back[ends] = -1
        due = first.tolist()  # rank of the pair that starts at a place
        before = back.tolist()  # the token before, -1 at the start of a match
        follow = list(range(1, n + 1))  # where the next token starts
        token = self.byte[raw].tolist()
        alive = bytearray(b"\1") * n
        queue, pairs = self.queue, self.pairs
        buckets, fill, pop = queue.buckets, queue.fill, queue.pop
        some = np.flatnonzero(first >= 0)
        some = some[np.argsort(first[some], kind="stable")]
        present, at = np.unique(first[some], return_index=True)
        for rank, places in zip(present.tolist(), np.split(some, at[1:])):
            fill(rank, places.tolist())
        while queue.top:
            rank, places = pop()
            behind = pairs[rank].get
            for at, i in enumerate(places):
                if due[i] != rank:
                    continue  # stale
                lower = False
                j = follow[i]
                k = follow[i] = follow[j]
                token[i] = rank
                alive[j] = 0
                due[j] = due[i] = -1
                if before[k] >= 0:
                    before[k] = i
                    found = behind(token[k])
                    if found is not None:
                        due[i] = found
                        bucket = buckets[found]
                        if bucket is None:
                            fill(found, [i])
                        else:
                            bucket.append(i)
                        lower = found < rank
                h = before[i]
                if h >= 0:
                    found = pairs[token[h]].get(rank)
                    if found is None:
                        due[h] = -1
                    else:
                        due[h] = found
                        bucket = buckets[found]
                        if bucket is None:
                            fill(found, [h])
                        else:
                            bucket.append(h)
                        lower = lower or found < rank
                if lower:  # that pair comes before the rest of this bucket
                    for place in places[at + 1 :]:
                        queue.push(rank, place)
                    break
        kept = np.frombuffer(alive, np.uint8)
        ids = np.array(token, np.int32)[kept == 1].tobytes()
        until = (4 * np.cumsum(kept, dtype=np.int64)[ends - 1]).tolist()
        return [ids[a:b] for a, b in zip([0, *until], until)]

    def encode_matches(self, matches: list[str]) -> list[bytes]:
        """32-bit ids of each match of the pattern."""
        raw = [m.encode() for m in matches]
        whole = list(map(self.ranks.get, raw))
        left = [p for p, rank in zip(raw, whole) if rank is None]
        merged = iter(self.merge(left) if left else ())
        return [next(merged) if rank is None else rank.to_bytes(4, "little") for rank in whole]

    def split(self, text: str) -> list[str]:
        """Matches of the pattern as the library finds them.

        The library's character tables are of another Unicode version than those here. A character
        without a category here is asked for there, and one of the same class stands in for it.
        """
        if self._common and not encoders._UNCOMMON.search(text):
            return self._common(text)
        doubtful = set() if text.isascii() else {c for c in text if unicodedata.category(c) == "Cn"}
        if not doubtful:
            return self._split.findall(text)
        for c in doubtful - self.stand_ins.keys():
            self.stand_ins[c] = self._stand_in(c)
        shadow = text.translate({ord(c): self.stand_ins[c] for c in doubtful})
        return [text[m.start() : m.end()] for m in self._split.finditer(shadow)]

    def _stand_in(self, c: str) -> str:
        import tiktoken

        for probe in "x1":  # one token exactly if both are of one match
            ranks = {bytes([b]): b for b in range(256)} | {(probe + c).encode(): 256}
            if tiktoken.Encoding("probe", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(probe + c) == [256]:
                return probe
        return "!"

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """32-bit ids of each whole text; null is empty."""
        self.matches.age()
        get = self.matches.get
        split = [self.split(t) if t else [] for t in texts]
        found = [list(map(get, matches)) for matches in split]
        new = {m for matches, ids in zip(split, found) if None in ids for m, x in zip(matches, ids) if x is None}
        fresh = self.matches.learn(new, self.encode_matches)
        out = [
            b"".join([get(m) if x is None else x for m, x in zip(matches, ids)] if None in ids else ids)
            for matches, ids in zip(split, found)
        ]
        self.matches.forget_long(fresh)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_LOADED: dict[tuple[str, str], Vocabulary] = {}


def load(path: str, pattern: str) -> Vocabulary:
    """The worker's copy of a vocabulary."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Vocabulary(path, pattern)
    return _LOADED[path, pattern]


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """``ids`` of each whole text, as an array."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = load(path, pattern).encode(batch.column(1).to_pylist())
        offsets = np.zeros(len(found) + 1, np.int32)
        np.cumsum([len(x) // 4 for x in found], out=offsets[1:])
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))
        return tx.batch([tx.ids_of(batch.column(0)), ids], ["doc_id", "ids"])

    return tx.arrow_map(documents.select("doc_id", "text"), run, ENCODED_SCHEMA)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``decoded``, the bytes the ids stand for; null ids are none."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocabulary = load(path, pattern)
        texts = [vocabulary.decode(ids.values.tolist()) if ids.is_valid else b"" for ids in batch.column(1)]
        return tx.batch([*batch.columns, pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return tx.arrow_map(encoded.select("doc_id", "ids"), run, DECODED_SCHEMA)
