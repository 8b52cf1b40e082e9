"""Byte-level BPE, the Merkle manifest and token alignment against the libraries and brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tidemark.llm import alignment, byte_bpe, merkle, queries
from tidemark.llm import text as tx

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
RNG = random.Random(11)
PARTS = [
    "the", " of", "ing ", "a", "B", "1", "22", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "​", "﻿", "\x00", "\x01", "é", "ß", "日本",
    "🙂", "!", ".,", "'s", "'ll", "<|endoftext|>", "<s>", "<0x41>", "▁", "՘", "Ᲊ", "\U00010d40", "\U000323b0", "x" * 40,
]


def jumble(n: int) -> str:
    return "".join(RNG.choice(PARTS) for _ in range(RNG.randint(1, n)))


TEXTS = [None, "", " ", "\n", "one", " two  three ", "x" * 30_000, "ab" * 5_000, "日本" * 3_000, " " * 500 + "y", *(jumble(30) for _ in range(150))]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(4, "one"), (4, "one"), (4, "other"), (None, "one"), (None, None), (None, "two")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, `index` int, tree string, pair int, chunk string, root string"


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward rows with extra columns whose names the operators use themselves; one hot source."""
    tx.prepare(spark)
    source = [None, "", "hot", "hot", "hot", "é", "src1", "src10", "src2"]
    rows = [(i, t, ["de", None][k % 2], source[k % 9] if k % 3 else "hot", None if k % 5 == 0 else k, "x", 1, "x", 1, "x", "x") for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, str(x)) for x in r))


# byte-level BPE


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def ids_of(raw: bytes) -> list[int]:
    return np.frombuffer(raw, np.int32).tolist()


def test_ids_are_those_of_the_library_and_decode_to_the_text(spark, docs, vocabulary, library):
    coded = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    got = order((r.doc_id, r.ids, bytes(r.decoded)) for r in coded.collect())
    assert got == order((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in ROWS)


@given(st.text(alphabet=st.sampled_from("abcdeht 1'\n\té日"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_every_short_text_has_the_library_ids(vocabulary, library, text):
    assert ids_of(vocabulary.encode([text])[0]) == library.encode_ordinary(text)


def test_characters_of_another_unicode_version_split_as_in_the_library(vocabulary, library):
    import unicodedata

    import regex

    letters = regex.findall(r"[\p{L}\p{N}]", "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000))
    doubtful = [c for c in letters if unicodedata.category(c) == "Cn"]
    for c in RNG.sample(doubtful, min(40, len(doubtful))):
        for text in (f"x{c}", f"1{c}2", f"a {c}b!{c}"):
            assert ids_of(vocabulary.encode([text])[0]) == library.encode_ordinary(text), hex(ord(c))


def test_a_long_match_takes_seconds_not_hours(vocabulary, library):
    text = "".join(RNG.choice("abcde") for _ in range(300_000))
    assert ids_of(vocabulary.encode([text])[0]) == library.encode_ordinary(text)


def test_rank_queue_gives_ranks_in_order():
    queue = byte_bpe.RankQueue(50_000)
    pushed = [(RNG.randrange(50_000), RNG.randrange(1000)) for _ in range(3000)]
    for rank, place in pushed:
        queue.push(rank, place)
    out = []
    while queue.top:
        rank, places = queue.pop()
        out += [(rank, p) for p in places]
    assert out == sorted(pushed)
    assert not any(queue.low) and not any(queue.mid)


def test_a_lower_rank_that_a_merge_makes_goes_first():
    # "b"+"c" (rank 256) makes "a"+"bc" (257) and that "abc"+"d" (258); "x"+"y" (300) waits
    import tiktoken

    for _trial in range(50):
        letters = "abcd"
        made = {bytes([b]): b for b in range(256)}
        while len(made) < 290:
            made.setdefault("".join(RNG.choice(letters) for _ in range(RNG.randint(2, 4))).encode(), len(made))
        own = byte_bpe.Vocabulary.__new__(byte_bpe.Vocabulary)
        own.use(made)
        library = tiktoken.Encoding("any", pat_str=public_tokenizers.PATTERN, mergeable_ranks=made, special_tokens={})
        words = ["".join(RNG.choice(letters) for _ in range(RNG.randint(1, 30))) for _ in range(40)]
        assert [ids_of(x) for x in own.encode_matches(words)] == [library.encode_ordinary(w) for w in words]


# Merkle manifest


def digest_of(*values) -> str:
    parts = ("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def hashed(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def brute_tree(leaves: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and the siblings of each leaf level by level."""
    proofs: list[list[tuple[str, str]]] = [[] for _ in leaves]
    level, spans = list(leaves), [[k] for k in range(len(leaves))]
    while len(level) > 1:
        for k, span in enumerate(spans):
            a = k // 16 * 16
            for leaf in span:
                proofs[leaf].append(("".join(level[a:k]), "".join(level[k + 1 : a + 16])))
        spans = [sum(spans[a : a + 16], []) for a in range(0, len(level), 16)]
        level = [hashed(*level[a : a + 16]) for a in range(0, len(level), 16)]
    return level[0], proofs


def manifest_rows(docs, carried=""):
    leaves = docs.select("doc_id", "source", merkle.leaf_digest(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))).alias("digest"))
    proofs = merkle.prove(merkle.build(leaves, "source", "doc_id", carried))
    return order((r.key, r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in proofs.collect())


def brute_manifest(rows):
    trees = collections.defaultdict(list)
    for r in rows:
        trees[r.source].append((r.doc_id, digest_of(r.doc_id, r.source, r.lang, r.n_chars, r.text)))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for leaves in trees.values():
        leaves.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    built = [brute_tree([d for _, d in trees[n]]) for n in names]
    root, upper = brute_tree([b[0] for b in built])
    return order((key, leaf, b[0], root, proof + up) for n, b, up in zip(names, built, upper) for (key, leaf), proof in zip(trees[n], b[1]))


def test_manifest_equals_brute_force(docs):
    assert manifest_rows(docs) == brute_manifest(docs.collect())


@pytest.mark.parametrize("n", [1, 2, 16, 17, 255, 256, 257, 4097])
def test_trees_of_every_shape(spark, n):
    wide = spark.range(n).select(F.col("id").alias("doc_id"), *(F.lit(None).cast("string").alias(c) for c in ("source", "lang", "text")), F.col("id").alias("n_chars"))
    assert manifest_rows(wide) == brute_manifest(wide.collect())


def test_many_small_trees(spark):
    many = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 300).alias("source"), F.lit("x").alias("lang"), F.lit(None).cast("string").alias("text"), F.col("id").alias("n_chars"))
    assert manifest_rows(many) == brute_manifest(many.collect())


def test_an_empty_dataset_has_no_proofs(empty):
    assert manifest_rows(empty) == []


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 31, 33, 255, 256])
def test_positions_are_those_of_the_append_log(n):
    builder = merkle.LogBuilder()
    leaves = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(n)]
    for leaf in leaves:
        builder.append(leaf)
    levels = len(merkle.level_sizes(n)) - 1
    log = builder.finish(levels)
    digests, level, places = leaves, 0, []
    while True:
        at = merkle.position(level, np.arange(len(digests)), n).tolist()
        assert [log[p * 64 : p * 64 + 64] for p in at] == digests
        places += at
        if len(digests) == 1:
            break
        digests, level = [hashed(*digests[a : a + 16]) for a in range(0, len(digests), 16)], level + 1
    assert sorted(places) == list(range(len(log) // 64))


def test_tampered_texts_fail_and_others_verify(spark, docs):
    for r in queries.op12_merkle_manifest(spark, SF).collect():
        if zlib.crc32(str(r.doc_id).encode()) % 5:
            assert r.verified and r.folded_root == r.root


# alignment


def brute_alignment(rows, measure_counts=True):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = SentencePieceProcessor(model_file=B)
    of_a, of_b = alignment.load(A, B)
    out, links = [], []
    for doc, text in rows:
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        bytes_a, bytes_b = [of_a.bytes_of[x] for x in a], [of_b.bytes_of[x] for x in b]
        raw = (" " + (text or "")).encode()
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            a, b, bytes_a, bytes_b = [], [], [], []
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        times = collections.Counter()
        for x, y in groups:
            for p, n in collections.Counter(x).items():
                for q, m in collections.Counter(y).items():
                    times[p, q] += n * m
        links.append(times)
        line = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((doc, len(a), len(b), len(groups), sum(times.values()), line))
    count = collections.Counter(p for times in links for p in times)
    most = collections.defaultdict(int)
    for (p, _), n in count.items():
        most[p] = max(most[p], n)
    return order(
        (*row[:5], sum(n for p, n in times.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in times.items()), row[5])
        for row, times in zip(out, links)
    )


def test_alignment_equals_brute_force(docs):
    assert order(alignment.align_documents(docs, A, B).collect()) == brute_alignment(ROWS)


def test_chunks_of_any_size_give_the_same(docs, monkeypatch):
    # the limits reach the workers as arguments
    small = tx.durable(alignment.align(docs, A, B, chunk_tokens=200, text_bytes=50), "aligned")
    assert small.select("chunk").distinct().count() > 5
    assert order(alignment.score(small).collect()) == brute_alignment(ROWS)


def test_links_of_large_groups_and_small_ones_agree(monkeypatch):
    of_a, of_b = alignment.load(A, B)
    texts = [t for t in TEXTS if t and "▁" not in t] + ["", None]
    found_a, found_b = alignment.tokens(texts, of_a, of_b)
    rows = [np.concatenate([[0], np.cumsum([len(x) // 2 for x in f])]) for f in (found_a, found_b)]
    flat = [np.frombuffer(b"".join(f), "<u2").astype(np.int64) for f in (found_a, found_b)]
    sizes = [np.array([len(t) for t in x.bytes_of], np.int64) for x in (of_a, of_b)]
    it = alignment.Aligned(*flat, *rows, *sizes)
    expected = [x.tolist() for x in it.pairs()]
    for small in (0, 1, 3):
        monkeypatch.setattr(alignment, "SMALL", small)
        assert [x.tolist() for x in it.pairs()] == expected


@given(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.lists(st.integers(1, 4), min_size=1, max_size=40), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_pieces_of_any_size_give_the_same_overlaps(a, b, piece):
    end = max(sum(a), sum(b)) + 1
    ends_a, ends_b = np.append(np.cumsum(a), end), np.append(np.cumsum(b), end)
    expected, i, j = [], 0, 0
    while i < len(ends_a):
        both = ends_a[i] == ends_b[j]
        expected.append((i, j, bool(both)))
        i, j = i + int(ends_a[i] <= ends_b[j]), j + int(both or ends_b[j] < ends_a[i])
    assert list(zip(*(x.tolist() for x in alignment.overlaps(ends_a, ends_b, piece)))) == expected


def test_diagonals_cut_equal_work():
    a, b = np.arange(1, 1001) * 7, np.arange(1, 3501) * 2
    diagonals = np.arange(0, len(a) + len(b) + 1, 500)
    i = alignment.split_points(a, b, diagonals)
    merged = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
    assert i.tolist() == [sum(side == 0 for _, side in merged[:d]) for d in diagonals.tolist()]


def test_empty_tables_and_queries(spark, empty):
    assert byte_bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    assert alignment.align_documents(empty, A, B).count() == 0
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_token_alignment(spark, SF)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.columns == columns
    expected = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in brute_alignment(texts)]
    assert order(got.collect()) == order(expected)
