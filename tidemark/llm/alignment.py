"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

Both tokenizations of a text end at the same byte. The byte offsets at which tokens of both end
cut them into groups; every token A of a group is linked to every token B of it. The sorted ends
of both sides are merged by merge path: diagonals of the (A, B) grid at equal distances are searched
by bisection for the point where the merge crosses them, so all pieces between two diagonals have
the same number of ends, whatever the texts look like. Each piece is merged on its own and emits
its overlaps (token A, token B, whether both end there); an end pair that a diagonal separates is
put together when the pieces are stitched, and running sums of the common ends number the groups.
The texts of a batch follow each other on one line of bytes, as their ends are common ends.

Tasks cut their documents into chunks of bounded size. A chunk sends one row for each distinct
pair of ids with the number of its documents that have it, not one for each document; Spark adds
them up over all chunks, and each chunk gets back the totals of its own pairs. Documents keep
places in their chunk's list of pairs. The highest count of each id of A is one row an id, so
that table is no larger than the vocabulary.

Defined cases: a null or empty text, and one whose tokens do not give its bytes back, has no
tokens. Repeated rows and null ids are documents of their own. An empty table gives no rows.
Strings of special tokens are plain text. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import encoders
from tidemark.llm import text as tx
from tidemark.llm.token_files import decode_values, encode_values

PIECE = 1 << 16  # ends merged at a time
TEXT_BYTES = 1 << 22  # bytes of text aligned together, unless one document has more
CHUNK_TOKENS = 1 << 22  # A tokens of a chunk, unless one document has more
SMALL = 64  # groups of more links are counted by distinct ids
B_BITS = 16
ALIGNED_SCHEMA = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, places binary, times binary, pair long, n long"
RESULT_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


class PlainBytes(encoders.PieceEncoder):
    """Byte-level ids of texts that start with one blank; special tokens are plain text."""

    def __init__(self, path: str) -> None:
        super().__init__(path, "byte")
        self.tokenizer.encode_special_tokens = True
        letter = {c: b for b, c in enumerate(encoders._LETTER)}
        names = sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])
        self.bytes_of = [bytes(letter[c] for c in name) for name, _ in names]

    def _piece(self, piece: str) -> bytes:
        return self.whole(piece) if encoders._UNCOMMON.search(piece) else self._common(piece)

    def _encode(self, text: str) -> bytes:
        if not encoders._UNCOMMON.search(text):
            return self._common(text)
        if encoders._ODD_FOR_BYTES.search(text[1:]):
            return self.whole(text)
        # cut before each blank and line feed, each piece keeping its own
        return b"".join(map(self.pieces.__getitem__, text.replace("\n", "\x01\n").replace(" ", "\x01 ").split("\x01")))


class Pieces:
    """Sentence pieces of texts. No piece has a blank behind another character, so the text is
    encoded run by run, each run some blanks and what follows them; the library adds the first."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in names) or len(names) > 1 << B_BITS:
            raise ValueError("pieces with inner blanks, or more than 65,536")
        byte = re.compile("<0x([0-9A-F]{2})>").fullmatch
        self.bytes_of = [bytes([int(m[1], 16)]) if (m := byte(p)) else p.replace("▁", " ").encode() for p in names]
        self.blank = self.model.piece_to_id("▁")
        self.runs = encoders.Memo(self._run, encoders.CACHE_LIMIT["byte"])

    def _run(self, run: str) -> bytes:
        return array("H", self.model.encode(run, num_threads=1) if run else [self.blank]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 16-bit ids of texts that are not empty."""
        self.runs.age()
        out = []
        for text in texts:
            runs = text.split(" ")
            if "" in runs:  # blanks at an end or next to each other
                runs = [r[1:] for r in re.findall(" +[^ ]*", " " + text)]
            out.append(b"".join(map(self.runs.__getitem__, runs)))
        return out


_LOADED: dict[tuple[str, str], tuple[PlainBytes, Pieces]] = {}


def load(a: str, b: str) -> tuple[PlainBytes, Pieces]:
    """The worker's encoders for a pair of tokenizer files."""
    if (a, b) not in _LOADED:
        _LOADED[a, b] = PlainBytes(a), Pieces(b)
    return _LOADED[a, b]


# merge path


def split_points(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """Ends of A before each diagonal in the merge of both; an end of A comes before an equal one of B."""
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (low < high).any():
        active = low < high
        middle = (low + high) // 2
        here = middle[active]
        after = np.zeros(len(low), bool)
        after[active] = a[here] <= b[diagonals[active] - 1 - here]
        low, high = np.where(after, middle + 1, low), np.where(active & ~after, middle, high)
    return low


def merge_piece(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps (token A, token B, both end here) of one piece, in order, from its own ends."""
    mine, other = a[i0:i1], b[j0:j1]
    j_of_a = np.searchsorted(other, mine, "left")
    i_of_b = np.searchsorted(mine, other, "right")
    n = len(mine) + len(other)
    first, second = np.empty(n, np.int64), np.empty(n, np.int64)
    both, real = np.zeros(n, bool), np.ones(n, bool)
    at_a, at_b = np.arange(len(mine)) + j_of_a, np.arange(len(other)) + i_of_b
    first[at_a], second[at_a] = i0 + np.arange(len(mine)), j0 + j_of_a
    first[at_b], second[at_b] = i0 + i_of_b, j0 + np.arange(len(other))
    if len(mine) and len(other):
        both[at_a] = other[np.minimum(j_of_a, len(other) - 1)] == mine  # false behind the last end of B
        real[at_b] = (i_of_b == 0) | (mine[i_of_b - 1] != other)  # an end of B that A had already
    return first[real], second[real], both[real]


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps of two rising lists of ends with the same last end: pieces of equal work, stitched."""
    total = len(a) + len(b)
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    diagonals = np.append(np.arange(0, total, piece), total)
    i = split_points(a, b, diagonals)
    j = diagonals - i
    found = [merge_piece(a, b, *map(int, cut)) for cut in zip(i[:-1], i[1:], j[:-1], j[1:])]
    for k in range(1, len(found)):
        # the diagonal went between an end of A and the equal one of B
        if i[k] and j[k] < len(b) and a[i[k] - 1] == b[j[k]]:
            found[k - 1][2][-1] = True
            found[k] = tuple(x[1:] for x in found[k])
    return tuple(np.concatenate([f[c] for f in found]) for c in range(3))


class Aligned:
    """Groups and links of the tokens of some documents, in document order.

    ``a`` and ``b`` are ids of all documents, ``a_row`` and ``b_row`` where those of each document begin.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, a_row: np.ndarray, b_row: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> None:
        self.a, self.b, self.a_row, self.b_row = a, b, a_row, b_row
        first, second, both = overlaps(np.cumsum(a_size[a]), np.cumsum(b_size[b]))
        group = np.cumsum(both) - both
        self.a_group, self.b_group = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        self.a_group[first], self.b_group[second] = group, group
        total = int(both.sum())
        self.in_a, self.in_b = np.bincount(self.a_group, minlength=total), np.bincount(self.b_group, minlength=total)
        # documents end with a group; one without tokens has none
        ends = np.append(self.a_group, total)
        self.row = ends[a_row]
        self.links = np.concatenate([[0], np.cumsum(self.in_a * self.in_b)])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (document, A id, B id) in order, with the number of links: rows, pairs, times."""
        row_of_group = np.repeat(np.arange(len(self.row) - 1), np.diff(self.row)).astype(np.uint64)
        small = self.in_a * self.in_b <= SMALL
        b_first = np.concatenate([[0], np.cumsum(self.in_b)])
        of = np.flatnonzero(small[self.a_group])
        group = self.a_group[of]
        width = self.in_b[group]
        begin = np.cumsum(width) - width
        partner = np.repeat(b_first[group] - begin, width) + np.arange(int(width.sum()))
        head = row_of_group[group] << np.uint64(32) | self.a[of].astype(np.uint64) << np.uint64(B_BITS)
        keys = np.sort(np.repeat(head, width) | self.b[partner].astype(np.uint64))
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        times = np.diff(np.append(at, len(keys)))
        keys = keys[at]
        if not small.all():
            keys, times = self._with_large(np.flatnonzero(~small), row_of_group, b_first, keys, times)
        return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), times

    def _with_large(self, groups, row_of_group, b_first, keys, times):
        """Adds groups of many links: distinct ids on both sides, their numbers multiplied."""
        a_first = np.concatenate([[0], np.cumsum(self.in_a)])
        all_keys, all_times = [keys], [times]
        for g in groups.tolist():
            ids_a, n_a = np.unique(self.a[a_first[g] : a_first[g + 1]], return_counts=True)
            ids_b, n_b = np.unique(self.b[b_first[g] : b_first[g + 1]], return_counts=True)
            heads = row_of_group[g] << np.uint64(32) | ids_a.astype(np.uint64) << np.uint64(B_BITS)
            all_keys.append((heads[:, None] | ids_b.astype(np.uint64)).ravel())
            all_times.append((n_a[:, None] * n_b).ravel())
        joined, weight = np.concatenate(all_keys), np.concatenate(all_times)
        order = np.argsort(joined, kind="stable")
        joined, weight = joined[order], weight[order]
        at = np.flatnonzero(np.concatenate([[True], joined[1:] != joined[:-1]]))
        return joined[at], np.add.reduceat(weight, at)

    def texts(self) -> list[bytes]:
        """The groups of each document: ``a1,a2|b1;a3|b2,b3``."""
        if not len(self.a):
            return [b""] * (len(self.row) - 1)
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        b_before = np.concatenate([[0], np.cumsum(self.in_b)])[:-1]
        a_until = np.cumsum(self.in_a)
        at_a = np.arange(len(self.a)) + b_before[self.a_group]
        at_b = np.arange(len(self.b)) + a_until[self.b_group]
        last_a = np.append(self.a_group[1:] != self.a_group[:-1], True)
        last_b = np.append(self.b_group[1:] != self.b_group[:-1], True)
        codes[at_a] = self.a * 3 + last_a  # "," or "|"
        codes[at_b] = self.b * 3 + 2 * last_b  # "," or ";"
        cuts = (self.a_row + self.b_row).tolist()
        pieces = list(map(_marked().__getitem__, codes.tolist()))
        return [b"".join(pieces[x:y])[:-1] for x, y in zip(cuts[:-1], cuts[1:])]


_MARKED: list[bytes] = []


def _marked() -> list[bytes]:
    """Decimal ids with the mark that follows them."""
    if not _MARKED:
        _MARKED.extend(f"{i}{mark}".encode() for i in range(1 << 16) for mark in ",|;")
    return _MARKED


class _Chunk:
    """Documents of one chunk until it is closed."""

    def __init__(self, number: int) -> None:
        self.number, self.tokens = number, 0
        self.parts: list[tuple[pa.Array, list[np.ndarray], list, np.ndarray, np.ndarray, np.ndarray]] = []

    def close(self) -> Iterator[pa.RecordBatch]:
        """Document rows with places in the chunk's list of pairs, then the list."""
        lists = [np.unique(p[4], return_counts=True) for p in self.parts]
        every = np.concatenate([x for x, _ in lists])
        pairs, at = np.unique(every, return_inverse=True)
        counts = np.bincount(at, np.concatenate([n for _, n in lists]), len(pairs)).astype(np.int64)
        for ids, measures, groups, rows, of_pairs, times in self.parts:
            n = len(ids)
            cuts = np.searchsorted(rows, np.arange(n + 1))
            place = np.searchsorted(pairs, of_pairs)
            packed, repeated = [], []
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                packed.append((y - x).to_bytes(4, "little") + encode_values(np.diff(place[x:y], prepend=0)))
                repeated.append(encode_values(times[x:y]))
            none = pa.nulls(n, pa.int64())
            columns = [pa.array(np.full(n, self.number)), ids, *map(pa.array, measures), pa.array(groups, pa.string()), pa.array(packed, pa.binary()), pa.array(repeated, pa.binary()), none, none]
            yield tx.batch(columns, _ALIGNED)
        for x in range(0, len(pairs), 1 << 16):
            some, n = pairs[x : x + (1 << 16)], counts[x : x + (1 << 16)]
            none = [pa.nulls(len(some), t) for t in [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary()]]
            yield tx.batch([pa.array(np.full(len(some), self.number)), *none, pa.array(some), pa.array(n)], _ALIGNED)


_ALIGNED = [c.split()[0] for c in ALIGNED_SCHEMA.split(", ")]


def tokens(texts: list[str | None], a: PlainBytes, b: Pieces) -> tuple[list[bytes], list[bytes]]:
    """16-bit ids on both sides; none where the tokens of a side do not give the text back."""
    full = [k for k, t in enumerate(texts) if t]
    spaced = [" " + texts[k] for k in full]
    out_a, out_b = [b""] * len(texts), [b""] * len(texts)
    for k, text, of_a, of_b in zip(full, spaced, a.encode(spaced), b.encode([texts[k] for k in full])):
        raw = text.encode()
        if all(b"".join(map(x.bytes_of.__getitem__, memoryview(ids).cast("H"))) == raw for x, ids in ((a, of_a), (b, of_b))):
            out_a[k], out_b[k] = of_a, of_b
    return out_a, out_b


def align(documents: DataFrame, a: str, b: str, with_groups: bool = True, chunk_tokens: int = CHUNK_TOKENS, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """Chunks of aligned documents, and the distinct pairs of each chunk; see ``ALIGNED_SCHEMA``.

    ``groups`` is the text of the groups, or its SHA-256 (empty without tokens).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_a, of_b = load(a, b)
        a_size, b_size = (np.array([len(t) for t in x.bytes_of], np.int64) for x in (of_a, of_b))
        base = TaskContext.get().partitionId() << 32
        chunk = _Chunk(base)
        for batch in batches:
            ids, texts = tx.ids_of(batch.column(0)), batch.column(1).to_pylist()
            begin = held = 0
            for k in range(1, len(texts) + 1):
                held += len(texts[k - 1] or "")
                if k < len(texts) and held < text_bytes:
                    continue
                found_a, found_b = tokens(texts[begin:k], of_a, of_b)
                a_row, b_row = (np.concatenate([[0], np.cumsum([len(x) // 2 for x in f])]) for f in (found_a, found_b))
                flat_a, flat_b = (np.frombuffer(b"".join(f), "<u2").astype(np.int64) for f in (found_a, found_b))
                it = Aligned(flat_a, flat_b, a_row, b_row, a_size, b_size)
                measures = [np.diff(x) for x in (a_row, b_row, it.row, it.links[it.row])]
                groups = it.texts()
                groups = [g.decode() for g in groups] if with_groups else [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
                chunk.parts.append((ids.slice(begin, k - begin), measures, groups, *it.pairs()))
                chunk.tokens += len(flat_a)
                begin, held = k, 0
                if chunk.tokens >= chunk_tokens:
                    yield from chunk.close()
                    chunk = _Chunk(chunk.number + 1)
        if chunk.parts:
            yield from chunk.close()

    return documents.select("doc_id", "text").mapInArrow(run, ALIGNED_SCHEMA)


def corpus_counts(aligned: DataFrame) -> DataFrame:
    """(chunk, pair, total, best): documents of the corpus with a pair, and whether none of its A id has more."""
    listed = aligned.where("pair is not null").select("chunk", "pair", "n")
    totals = tx.durable(listed.withColumn("total", F.sum("n").over(Window.partitionBy("pair"))).drop("n"), "pair-totals")
    a_id = F.shiftright("pair", B_BITS)
    # one row for each id of A: no more than the vocabulary has
    most = totals.groupBy(a_id.alias("a")).agg(F.max("total").alias("most"))
    found = totals.join(F.broadcast(most), a_id == F.col("a"))
    return found.select("chunk", "pair", "total", (F.col("total") == F.col("most")).alias("best"))


def score(aligned: DataFrame) -> DataFrame:
    """Each document's measures with ``n_best`` and ``count_sum``. ``aligned`` is a written table."""
    names = [c.split()[0] for c in RESULT_SCHEMA.split(", ")]

    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        order = np.argsort(counts.column("pair").to_numpy())
        total = counts.column("total").to_numpy()[order]
        best = counts.column("best").to_numpy(zero_copy_only=False)[order]
        n_best, count_sum = [], []
        for places, times in zip(docs.column("places").to_pylist(), docs.column("times").to_pylist()):
            n = int.from_bytes(places[:4], "little")
            place = np.cumsum(decode_values(places, n, 4).astype(np.int64))
            number = decode_values(times, n).astype(np.int64)
            n_best.append(int(number[best[place]].sum()))
            count_sum.append(int((number * total[place]).sum()))
        columns = {c: docs.column(c) for c in names if c in docs.column_names} | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
        return pa.table([columns[c] for c in names], names=names)

    docs = aligned.where("pair is null").drop("pair", "n")
    return docs.groupBy("chunk").cogroup(corpus_counts(aligned).groupBy("chunk")).applyInArrow(run, RESULT_SCHEMA)


def align_documents(documents: DataFrame, a: str, b: str, with_groups: bool = True) -> DataFrame:
    """Groups, links and corpus counts of all documents."""
    return score(tx.durable(align(documents, a, b, with_groups), "aligned"))
