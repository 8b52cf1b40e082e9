"""The pipeline's stages against brute force, each on what the one before it kept."""

from __future__ import annotations

import collections
import re
import zlib

import numpy as np
import pytest
from test_operators import RNG, classes, spans_of, words

import corpus_pipeline
from tidemark.llm import decontaminate, encoders, packing, queries, text as tx

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = [(k, " ".join("b%dx%d" % (k, j) for j in range(30))) for k in range(3)]


def prose(n: int) -> str:
    return " ".join(RNG.choice(["the", "of", "ist", "été", "ing"]) + str(RNG.randint(0, 60)) for _ in range(n))


def documents():
    rows, base = [], [prose(70).split() for _ in range(3)]
    for k in range(30):
        w = list(base[k % 3])
        for _ in range(RNG.randint(0, 3)):
            w[RNG.randrange(len(w))] = "edit%d" % RNG.randrange(1000)
        rows.append(" ".join(w))
    rows += [prose(60) for _ in range(10)] + [rows[0], rows[7], "short text", "", None]
    rows += ["same words again and again here now then " * 20, " ".join(w + " ###" for w in prose(40).split())]
    moved = ITEMS[1][1].split()
    rows += [prose(30) + " " + ITEMS[0][1], prose(30) + " " + " ".join(moved[15:] + ["and"] + moved[:15]), prose(30) + " " + " ".join(moved[:10])]
    rows += [prose(25) + ' token = "0123456789abcdefghij" ' + prose(10), prose(1500)]
    out = [(k, t, "en", "s%d" % (k % 3), None if t is None else len(t)) for k, t in enumerate(rows)]
    return out + [(3, rows[3], "en", "s0", len(rows[3])), (None, prose(50), "en", None, 1)]


def kept_by_rules(rows):
    out = []
    for row in rows:
        t = row[1] or ""
        w = words(t)
        runs = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        often = collections.Counter(runs)
        covered = {p for k, run in enumerate(runs) if often[run] > 1 for p in range(k, k + 8)}
        lines = [x for x in t.split("\n") if words(x)]
        lettered = sum(bool(re.search("[A-Za-z]|[^\x00-\x7f]", x)) for x in w)
        chars = sum(map(len, w))
        bad = (
            len(w) < 20, 100 * len(covered) > 30 * len(w), 100 * len(re.findall(r"[#*$%&|<>]", t)) > 15 * len(w),
            len(lines) >= 4 and 100 * (len(lines) - len(set(lines))) > 40 * len(lines), 10 * chars < 20 * len(w), 10 * chars > 160 * len(w),
            100 * lettered < 60 * len(w),
        )
        if not any(bad):
            out.append(row)
    return out


def one_of_each(rows):
    known = classes([r[:2] for r in rows])
    seen, out = set(), []
    for row in rows:
        if row[0] is None or not words(row[1]):
            out.append(row)
        elif known[tuple(words(row[1]))][0] == row[0] and row[0] not in seen:
            seen.add(row[0])
            out.append(row)
    return out


def covered(text, item):
    """Greedy tiling the slow way: the longest unmarked common run, until none has five tokens."""
    a, b = ([x.lower() for x in re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", t)] for t in (text, item))
    free_a, free_b = [True] * len(a), [True] * len(b)
    total = 0
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
        if n < decontaminate.SEED:
            return total / len(b)
        free_a[i : i + n] = free_b[j : j + n] = [False] * n
        total += n


def masked(text):
    out, at = "", 0
    for a, _, b in spans_of(text)[1]:
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    tx.prepare(spark)
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(documents(), COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_each_stage_against_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    slow = [
        kept_by_rules, one_of_each,
        lambda some: [r for r in some if all(covered(r[1] or "", t) < decontaminate.COVERAGE for _, t in ITEMS)],
        lambda some: [(i, masked(t), lang, source, len(masked(t))) if t is not None else (i, t, lang, source, n) for i, t, lang, source, n in some],
    ]
    for (name, stage), brute in zip(corpus_pipeline.STAGES, slow):
        docs = tx.durable(stage(spark, docs, folder), "stage")
        expected = brute(rows)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert order(tuple(r) for r in docs.collect()) == order(expected), name
        assert expected != rows, name  # every stage has something to do
        rows = expected
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    tokenizer = encoders.PieceEncoder(queries.tokenizer_file("byte_bpe_50k.json"), "byte").tokenizer
    expected = []
    for row in rows:
        ids, at = tokenizer.encode(row[1] or "", add_special_tokens=False).ids + [0], 0
        for k, n in enumerate(packing.cut_lengths(len(ids))):
            expected.append((row[0], k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at += n
    assert order(tuple(r)[:5] for r in packed) == order(expected)
    sequences = collections.defaultdict(list)
    for r in packed:
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in sequences.values():
        ends = np.cumsum([n for _, n in sorted(spans)])
        assert [a for a, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= packing.CAPACITY
    assert len(sequences) == packing.lower_bound(np.array([r.length for r in packed]))


def test_run_is_its_stages(spark, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "secret scan", "packing"]
    got = queries.pipeline(spark, folder)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 10


def test_empty_documents(spark, folder, tmp_path):
    path = str(tmp_path)
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
