"""Cases that once crashed, stalled or gave two answers."""

from __future__ import annotations

import collections
import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, substrings
from tidemark.llm import text as tx

RNG = random.Random(3)


def slow_tiles(a, b, shortest):
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < shortest:
            return out
        free_a[i : i + n] = free_b[j : j + n] = [False] * n
        out.append((i, j, n))


@pytest.mark.parametrize("letters,shortest", [(2, 2), (3, 2), (5, 1), (30, 2)])
def test_tiles_are_those_of_brute_force(letters, shortest):
    code = tx.mix(np.arange(1, letters + 1, dtype=np.uint64))
    for _ in range(60):
        a, b = (code[[RNG.randrange(letters) for _ in range(RNG.randint(0, 40))]] if RNG.random() < 0.95 else code[:0] for _ in range(2))
        assert decontaminate.tile(a, b, shortest) == slow_tiles(a.tolist(), b.tolist(), shortest)


@pytest.mark.parametrize("n,m", [(20_000, 400), (20_000, 20_000), (3_200, 400)])
def test_equal_tokens_take_no_time(n, m):
    one = np.full(1, 12345678901234567, np.uint64)
    start = time.perf_counter()
    tiles = decontaminate.tile(np.repeat(one, n), np.repeat(one, m))
    assert time.perf_counter() - start < 1
    assert sum(k for _, _, k in tiles) == m


def test_both_paths_agree_on_clashing_and_empty_items(spark):
    passage = "one two three four five six seven"
    items = [(5, passage), (5, ""), (5, "alpha beta gamma delta epsilon zeta eta theta"), (6, ""), (7, None), (None, passage), (8, passage), (8, "!!!")]
    docs = [(1, passage), (2, f"x {passage} y"), (3, ""), (4, None), (None, "alpha beta gamma delta epsilon zeta eta theta"), (6, "nothing of it"), (1, passage)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")

    def rows(limit):
        found = decontaminate.check(table, bench, broadcast_bytes=limit).collect()
        return sorted(((r.doc_id, r.contaminated, r.item_id, r.coverage, r.item_ids) for r in found), key=str)

    assert rows(0) == rows(1 << 20)
    assert (1, True, 5, 1.0, [5, 8]) in rows(0)
    kept = [sorted(map(str, decontaminate.clean(table, bench, broadcast_bytes=limit).collect())) for limit in (0, 1 << 20)]
    assert kept[0] == kept[1] and len(kept[0]) == 3


def test_null_ids_whose_texts_have_one_hash_keep_their_own_words(spark):
    tx.prepare(spark)
    shared = [f"w{k}" for k in range(20)]
    text = F.concat(F.lit(" ".join(shared) + " "), F.sha1(F.col("id").cast("string")))
    many = spark.range(400_000).select(text.alias("text"))
    pair = many.groupBy(F.hash("text")).agg(F.collect_list("text").alias("t")).where(F.size("t") > 1).first()["t"][:2]
    longer = f"{pair[0]} " + " ".join(f"v{k}" for k in range(30))
    # one is short of words where the other is cut
    rows = [(1, " ".join(shared)), (None, pair[0]), (None, pair[1]), (None, longer), (None, None), (2, longer), (2, longer)]
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())

    def slow(doc, text):
        words = (text or "").split()
        earlier = {tuple(w[k : k + 13]) for d, t in rows if d is not None and (doc is None or d < doc) and t for w in [t.split()] for k in range(len(w) - 12)}
        gone = {p for k in range(len(words) - 12) if tuple(words[k : k + 13]) in earlier for p in range(k, k + 13)}
        kept = " ".join(w for p, w in enumerate(words) if p not in gone)
        return doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()

    assert got == collections.Counter(slow(*r) for r in rows)
