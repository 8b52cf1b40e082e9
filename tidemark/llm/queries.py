"""Registered queries of the text operators and their SQL counterparts."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alignment, byte_bpe, decontaminate, jaccard, merkle, packing, quality_model, quality_rules, secret_scan, substrings, token_counts, token_files, url_filter
from tidemark.llm import text as tx


SQL: dict[str, str] = {}

# Words, then 8-word windows counted inside each document; a word is repeated when it lies in
# a window that occurs at least twice.
SQL["op9_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), starts AS (
  SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8
), windows AS (
  SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS win FROM starts
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT rid, count(*) AS n_repeat_words
  FROM (SELECT DISTINCT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')))::BIGINT AS n_alpha_words
  FROM w LEFT JOIN covered USING (rid)
), f AS (
  SELECT *,
    CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 15 * n_words THEN 4 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN 10 * word_chars < 20 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 10 * word_chars > 160 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_alpha_words < 60 * n_words THEN 64 ELSE 0 END
    + CASE WHEN n_words > 100000 THEN 128 ELSE 0 END AS bits
  FROM m
), patterns AS (
  SELECT bits & 127 AS p, count(*) AS n FROM f GROUP BY 1
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (bits & 3) <> 0 AS base_failed, (bits & 127) = 0 AS kept, bits::BIGINT AS failed_bits,
  CASE p WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'symbols' WHEN 8 THEN 'duplicate_lines'
    WHEN 16 THEN 'short_words' WHEN 32 THEN 'long_words' WHEN 64 THEN 'few_letters' END AS sole_rule,
  CASE WHEN p IN (1, 2, 4, 8, 16, 32, 64) THEN n + (SELECT coalesce(sum(n), 0) FROM patterns WHERE p = 0) END::BIGINT AS n_kept_without
FROM f JOIN patterns ON p = bits & 127
"""

# Every 13-word window of every document against the smallest document that has it.
SQL["op3_substring_dedup"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT rid, doc_id, i, array_to_string(words[i:i + 12], ' ') AS win
  FROM (SELECT rid, doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d WHERE len(words) >= 13)
), later AS (
  SELECT rid, i FROM (SELECT rid, i, doc_id, min(doc_id) OVER (PARTITION BY win) AS least FROM windows) WHERE doc_id > least
), gone AS (
  SELECT rid, list(p) AS ps FROM (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS p FROM later) GROUP BY rid
), positions AS (
  SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM d
), kept AS (
  SELECT a.rid, string_agg(a.word, ' ' ORDER BY a.p) AS txt, count(*) AS n
  FROM positions a LEFT JOIN (SELECT rid, unnest(ps) AS p FROM gone) g ON a.rid = g.rid AND a.p = g.p
  WHERE g.p IS NULL GROUP BY a.rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(txt, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

# Exact Jaccard of every pair of texts that share a shingle, then reachability over the links.
SQL["op6_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), texts AS (
  SELECT words, min(doc_id) AS rep, count(*) AS copies FROM d WHERE len(words) > 0 GROUP BY words
), s AS (
  SELECT DISTINCT rep, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT rep, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM texts)
), n AS (
  SELECT rep, count(*) AS n FROM s GROUP BY rep
), common AS (
  SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.rep < b.rep GROUP BY a.rep, b.rep
), half AS (
  SELECT a, b FROM common JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE 5 * c >= 4 * (x.n + y.n - c)
), link AS (
  SELECT a, b FROM half UNION ALL SELECT b, a FROM half
), reach(rep, root) AS (
  SELECT rep, rep FROM texts UNION SELECT link.b, reach.root FROM reach JOIN link ON reach.rep = link.a
), class AS (
  SELECT rep, min(root) AS class_id FROM reach GROUP BY rep
), counts AS (
  SELECT a AS rep, count(*) AS n_text, sum(copies) AS n_docs FROM link JOIN texts ON texts.rep = b GROUP BY a
)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(t.rep, doc_id) AS copy_of, coalesce(copies, 1)::BIGINT AS n_copies,
  (coalesce(copies, 1) - 1 + coalesce(n_docs, 0))::BIGINT AS n_links, coalesce(n_text, 0)::BIGINT AS n_text_links
FROM d LEFT JOIN texts t ON d.words = t.words LEFT JOIN class USING (rep) LEFT JOIN counts USING (rep)
"""


def _span_sql(kind: int, pattern: str, group: int, least: int) -> str:
    """Spans of one pattern as (rid, start, kind, stop), with the piece itself."""
    p = pattern.replace("'", "''")
    return f"""
  SELECT rid, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS start,
    {kind} AS kind, found[i] AS piece
  FROM (SELECT rid, regexp_extract_all(text, '{p}', 0) AS found, regexp_extract_all(text, '{p}', {group}) AS vals,
          regexp_split_to_array(text, '{p}') AS gaps, unnest(range(1, len(found) + 1)) AS i FROM d) q
  WHERE length(vals[i]) >= {least}"""


def _secret_sql() -> str:
    """The base patterns, then every window of each part of the remaining candidates counted afresh."""
    s = secret_scan
    base = " UNION ALL ".join(_span_sql(k, p, g, n) for k, (p, _, g, n) in enumerate(s.BASE.values()))
    candidates = _span_sql(len(s.BASE), s.CANDIDATE, 0, s.WINDOW)
    # RE2 has no look-ahead: what a class needs is asked for one by one
    letters = "regexp_matches(part, '[a-z].*[A-Z].*[a-z].*[A-Z]')"
    asked = ("regexp_matches(part, '[a-f]') AND regexp_matches(part, '[0-9]')", "regexp_matches(part, '[A-F]') AND regexp_matches(part, '[0-9]')",
             "regexp_matches(part, '[A-Za-z]') AND regexp_matches(part, '[0-9]')", letters)
    units = [round(c.bits * s.WINDOW * s.SCALE) for c in s.CLASSES]
    classes = " ".join(
        f"WHEN regexp_full_match(part, '{run}') AND {some} THEN {least}"
        for run, some, least in zip(("[0-9a-f]+", "[0-9A-F]+", "[A-Za-z0-9+/_-]+", "[A-Za-z]+"), asked, units)
    )

    def pieces(source: str, text: str, pattern: str, which: str) -> str:
        """Rows (rid, start, stop, a, part): the matches inside a text, or the gaps between them, with their places."""
        lengths = "coalesce(list_sum(list_transform({0}, lambda x: length(x))), 0)"
        before = f"{lengths.format('gaps[1:i' + ('' if which == 'found' else ' - 1') + ']')} + {lengths.format('found[1:i - 1]')}"
        return f"""
  SELECT rid, start, stop, place + {before} AS a, {which}[i] AS part
  FROM (SELECT *, regexp_split_to_array({text}, '{pattern}') AS gaps, regexp_extract_all({text}, '{pattern}', 0) AS found,
          unnest(range(1, len({which}) + 1)) AS i FROM {source}) q"""

    held = "EXISTS (SELECT 1 FROM base b WHERE b.rid = c.rid AND b.start <= c.a AND b.stop >= c.a + length(c.part))"
    terms = "[" + ", ".join(str(s.term(c)) for c in range(s.WINDOW + 1)) + "]"
    names = "[" + ", ".join(f"'{k}'" for k in s.KINDS) + "]"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), base AS (SELECT rid, start::BIGINT AS start, kind, (start + length(piece))::BIGINT AS stop FROM ({base})),
candidates AS (
  SELECT rid, start::BIGINT AS start, start::BIGINT AS place, (start + length(piece))::BIGINT AS stop, piece
  FROM ({candidates}) c WHERE NOT regexp_matches(piece, '{s.NAME}')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = c.rid AND b.start <= c.start AND b.stop >= c.start + length(piece))
), parts AS (
  SELECT *, a AS place FROM ({pieces("candidates", "piece", s.ALLOWED, "gaps")}) c WHERE length(part) >= {s.WINDOW} AND NOT {held}
), runs AS (
  SELECT * FROM ({pieces("parts", "part", s.RUN, "found")}) c WHERE NOT {held}
), fresh AS (
  SELECT rid, start, stop, a, part, CASE {classes} END AS least FROM parts
  UNION ALL SELECT rid, start, stop, a, part, {units[1]} FROM runs WHERE {asked[1]}
), windows AS (
  SELECT rid, start, stop, a, length(part) AS size, least, i, unnest(string_split(substring(part, i, {s.WINDOW}), '')) AS ch
  FROM (SELECT *, unnest(range(1, length(part) - {s.WINDOW - 2})) AS i FROM fresh WHERE least IS NOT NULL)
), counted AS (
  SELECT rid, start, stop, a, size, least, i, ({terms})[count(*) + 1] AS t FROM windows GROUP BY rid, start, stop, a, size, least, i, ch
), added AS (
  SELECT DISTINCT rid, start, {len(s.BASE)} AS kind, stop
  FROM (SELECT rid, start, stop, a, size, least, i, {s.term(s.WINDOW)} - sum(t) AS h FROM counted GROUP BY ALL) WHERE h >= least
), every_span AS (SELECT * FROM base UNION ALL SELECT * FROM added),
base_text AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(concat(({names})[kind + 1], ':', start, ':', stop), ',' ORDER BY start, kind) AS line FROM base GROUP BY rid
), all_text AS (
  SELECT rid, count(*) FILTER (kind = {len(s.BASE)}) AS n_entropy,
    string_agg(concat(({names})[kind + 1], ':', start, ':', stop), ',' ORDER BY start, kind) AS line FROM every_span GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(b.line, '')) AS base_sha256, coalesce(a.line, '') AS spans, coalesce(n_entropy, 0)::BIGINT AS n_entropy
FROM d LEFT JOIN base_text b USING (rid) LEFT JOIN all_text a USING (rid)
"""


SQL["op8_secret_scan"] = _secret_sql()

# Entries from the pages' hosts and paths, their intervals, and an as-of join in plain SQL.
SQL["op1_url_filter"] = r"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id,
    DATE '2024-01-01' + ((page_id * 7919) % 730)::INT AS fetched_on,
    regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '[.]$', '') AS host,
    list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts
  FROM pages
), hosts AS (
  SELECT DISTINCT host, regexp_replace(host, '^(www|m|blog)[.]', '') AS domain FROM p WHERE host <> ''
), n(pattern, kind) AS (
  SELECT DISTINCT domain, 'subject' FROM hosts WHERE regexp_matches(host, 'casino|bets|pills|adult')
  UNION ALL SELECT host, 'host' FROM (SELECT DISTINCT host FROM hosts)
  UNION ALL SELECT DISTINCT concat(host, '/', parts[1]), 'path' FROM p WHERE host <> '' AND len(parts) > 0
), h AS (
  SELECT pattern, kind,
    ('0x' || substring(md5('a' || pattern), 1, 6))::BIGINT % 200 AS a, ('0x' || substring(md5('b' || pattern), 1, 6))::BIGINT % 200 AS b,
    ('0x' || substring(md5('c' || pattern), 1, 6))::BIGINT % 200 AS c, ('0x' || substring(md5('d' || pattern), 1, 6))::BIGINT % 5 AS d,
    ('0x' || substring(md5('e' || pattern), 1, 6))::BIGINT % 7 AS e, ('0x' || substring(md5('f' || pattern), 1, 6))::BIGINT % 4 AS f,
    ('0x' || substring(md5('g' || pattern), 1, 6))::BIGINT % 2 AS g, ('0x' || substring(md5('a' || pattern), 1, 6))::BIGINT % 500 AS a500
  FROM n
), entries(list_name, allows, pattern, action, day) AS (
  SELECT 'subjects', false, pattern, 'add', a FROM h WHERE kind = 'subject'
  UNION ALL SELECT 'subjects', false, pattern, 'remove', a + b + 1 FROM h WHERE kind = 'subject'
  UNION ALL SELECT 'subjects', false, pattern, 'add', a + b + c + 2 FROM h WHERE kind = 'subject'
  UNION ALL SELECT 'hosts', false, pattern, 'add', a FROM h WHERE kind = 'host' AND d = 0
  UNION ALL SELECT 'hosts', false, pattern, 'remove', a + b FROM h WHERE kind = 'host' AND d = 0 AND g = 0
  UNION ALL SELECT 'paths', false, pattern, 'add', a500 FROM h WHERE kind = 'path' AND f = 0
  UNION ALL SELECT 'trusted', true, pattern, 'add', a FROM h WHERE kind = 'host' AND e = 0
  UNION ALL SELECT 'trusted', true, pattern, 'remove', a + c + 1 FROM h WHERE kind = 'host' AND e = 0
), daily AS (
  SELECT list_name, allows, lower(pattern) AS pattern, DATE '2024-01-01' + day::INT AS entry_date, max(action) AS action FROM entries GROUP BY ALL
), valid AS (
  SELECT * FROM (SELECT *, lead(entry_date) OVER (PARTITION BY list_name, allows, pattern ORDER BY entry_date) AS valid_to FROM daily) WHERE action = 'add'
), lookups AS (
  SELECT rid, fetched_on, array_to_string(string_split(host, '.')[i:], '.') AS pattern
  FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM p WHERE host <> '')
  UNION SELECT rid, fetched_on, concat(host, '/', parts[1]) FROM p WHERE host <> '' AND len(parts) > 0
), active AS (
  SELECT rid, list_name, allows, pattern,
    row_number() OVER (PARTITION BY rid ORDER BY length(pattern) DESC, allows DESC, list_name, pattern) AS k, count(*) OVER (PARTITION BY rid) AS n
  FROM lookups JOIN valid USING (pattern) WHERE fetched_on >= entry_date AND (valid_to IS NULL OR fetched_on < valid_to)
)
SELECT page_id, fetched_on, coalesce(NOT allows, false) AS blocked, list_name, pattern, coalesce(n, 0)::BIGINT AS n_active
FROM p LEFT JOIN (SELECT * FROM active WHERE k = 1) USING (rid)
"""



def _levels_sql(name: str, levels: int) -> str:
    """From {name}0 (tree, idx, n, h): nodes of the levels above, and the siblings of each node."""
    out = []
    for k in range(levels):
        run = f"OVER (PARTITION BY tree, idx // 16 ORDER BY idx ROWS BETWEEN "
        out.append(f"""{name}{k + 1} AS (
  SELECT tree, idx // 16 AS idx, (n + 15) // 16 AS n, sha256(string_agg(h, '' ORDER BY idx)) AS h FROM {name}{k} WHERE n > 1 GROUP BY tree, idx // 16, n
), {name}_step{k} AS (
  SELECT tree, idx, coalesce(string_agg(h, '') {run}UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(h, '') {run}1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM {name}{k} WHERE n > 1
)""")
    every = " UNION ALL ".join(f"SELECT tree, h FROM {name}{k} WHERE n = 1" for k in range(levels + 1))
    return ", ".join([*out, f"{name}_root AS ({every})"])


def _fold_sql(start: str, name: str, levels: int, out: str) -> str:
    """Walk up: the table ``start`` has (tree, idx, node, proof) of each row, and so has ``out``."""
    steps, last = [], start
    for k in range(levels):
        steps.append(f"""{out}_at{k} AS (
  SELECT x.* REPLACE (CASE WHEN s.tree IS NULL THEN node ELSE sha256(concat(before, node, after)) END AS node, concat(proof, before, after) AS proof)
  FROM {last} x LEFT JOIN {name}_step{k} s ON s.tree = x.tree AND s.idx = x.idx // {16**k}
)""")
        last = f"{out}_at{k}"
    return ", ".join([*steps, f"{out} AS (SELECT * FROM {last})"])


def _merkle_sql(levels: int = 8) -> str:
    """Level by level: enough levels for 16 ** 8 leaves a tree; finished trees stop growing."""
    table = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ 0xEDB88320 * (b & 1)
        table.append(b)

    def digest(text: str) -> str:
        parts = (f"coalesce(concat(strlen({f}::VARCHAR), ':', {f}::VARCHAR), '-')" for f in ("doc_id", "source", "lang", "n_chars", text))
        return f"sha256(concat({', '.join(parts)}))"

    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH d AS (
  SELECT *, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda c, x: xor(({table}::BIGINT[])[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {digest("text")} AS leaf,
    CASE WHEN crc % 5 = 0 THEN {digest(f"translate(text, '{letters}', '{letters.lower()}')")} ELSE {digest("text")} END AS presented
  FROM d
), s0 AS (
  SELECT *, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, presented) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), {_levels_sql("s", levels)}, t0 AS (
  SELECT '' AS tree, tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM s_root
), {_levels_sql("t", levels)}, lower_walk AS (
  SELECT doc_id, leaf, tree, idx, presented AS node, '' AS proof FROM s0
), {_fold_sql("lower_walk", "s", levels, "lower_end")}, upper_walk AS (
  SELECT doc_id, leaf, t0.h AS subroot, '' AS tree, t0.idx AS idx, node, proof FROM lower_end x JOIN t0 ON t0.name = x.tree
), {_fold_sql("upper_walk", "t", levels, "upper_end")}
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = r.h AS verified
FROM upper_end JOIN t_root r USING (tree)
"""


SQL["op12_merkle_manifest"] = _merkle_sql()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table, with the settings the operators need."""
    return tx.prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(url_filter.captures_of(pages), url_filter.entries_of(pages))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), "word", end_id=1)
    return token_files.read(spark, folder)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.check(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), "byte", end_id=0)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = quality_rules.stored_ledger(table(spark, sf_dir, "documents"))
    return quality_rules.explained(stored).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits", "sole_rule", "n_kept_without",
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    decimal = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")

    def digest(text: Column) -> Column:
        return merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = docs.select("doc_id", "source", digest(F.col("text")).alias("digest"), F.when(tampered, digest(lowered)).alias("presented"))
    proofs = merkle.prove(merkle.build(leaves, "source", "doc_id", "presented string"), "presented string")
    folded = proofs.withColumn("folded_root", merkle.fold(F.coalesce("presented", "leaf"), F.col("proof")))
    return folded.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.align_documents(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"), with_groups=False).withColumnRenamed("groups", "groups_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this module in turn

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query for each operator and the pipeline."""
    return {
        "op1_url_filter": op1_url_filter,
        "op2_token_files": op2_token_files,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_quality_model": op4_quality_model,
        "op5_decontamination": op5_decontamination,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_secret_scan": op8_secret_scan,
        "op9_quality_rules": op9_quality_rules,
        "op10_token_counts": op10_token_counts,
        "op11_byte_bpe": op11_byte_bpe,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_token_alignment": op13_token_alignment,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    """SQL over the same tables, where SQL can express the operator."""
    return dict(SQL)
