"""Quality rules: coverage of a text by duplicated word n-grams and lines, found with rolling hashes in numpy."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.arrow import mapped, mix, sums
from tessera.llm.common import table

_WORD = re.compile("[^\x20\x09-\x0d]+")
_SYMBOL = re.compile(r"[#*$%&|<>]+")
#: n-gram lengths and the greatest share (in per cent of word characters) that duplicated n-grams may cover.
LIMITS = {5: 35, 8: 30, 12: 25}
#: The same for characters in lines equal to an earlier line, of all characters in lines.
LINE_LIMIT = 30
LEAST_WORDS, REPEAT_LIMIT = 20, 30
_BASE = 0x9E6D62D06F6A9A9B

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_chars_5 long, dup_chars_8 long, dup_chars_12 long, dup_line_chars long, line_chars long"


def rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash modulo 2^64 of the n codes from each position (positions whose window ends past the array: none)."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        total = total * np.uint64(_BASE) + codes[k : k + size]
    return total


def repeated(ids: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Whether each word lies in an n-word window that its document holds twice or more.

    Windows with equal rolling hashes count as equal once their words are compared: hash collisions cost time only.
    """
    covered = np.zeros(len(ids), dtype=bool)
    size = len(ids) - n + 1
    if size <= 1:
        return covered
    whole = doc[n - 1 :] == doc[:size]
    starts = np.flatnonzero(whole)
    hashes = (rolling(mix(ids), n) ^ mix(doc[:size]))[starts]
    order = np.argsort(hashes, kind="stable")
    h, s = hashes[order], starts[order]
    same = h[1:] == h[:-1]
    a, b = s[:-1][same], s[1:][same]
    true = doc[a] == doc[b]
    for k in range(n):
        true &= ids[a + k] == ids[b + k]
    flag = np.zeros(size, dtype=bool)
    if true.all():
        flag[a] = flag[b] = True
    else:  # windows that differ share a hash: group these by their words
        seen: dict[tuple, list[int]] = {}
        for at in np.unique(np.concatenate([a, b])):
            seen.setdefault((doc[at], *ids[at : at + n]), []).append(at)
        for group in seen.values():
            if len(group) > 1:
                flag[group] = True
    steps = np.zeros(len(ids) + 1, dtype=np.int64)
    marked = np.flatnonzero(flag)
    np.add.at(steps, marked, 1)
    np.add.at(steps, marked + n, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """The counts of SCHEMA for each text (empty text: all zero, base_failed)."""
    words = [_WORD.findall(t) for t in texts]
    count = np.fromiter(map(len, words), dtype=np.int64, count=len(texts))
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for ws in words for w in ws), dtype=np.int64, count=int(count.sum()))
    size = np.fromiter(map(len, known), dtype=np.int64, count=len(known))
    chars = size[ids] if len(ids) else ids
    doc = np.repeat(np.arange(len(texts)), count)
    out = {"n_words": count, "word_chars": sums(chars, count), "n_symbols": np.array([sum(map(len, _SYMBOL.findall(t))) for t in texts], dtype=np.int64)}
    dup_lines, dup_chars, line_chars = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
    for i, text in enumerate(texts):
        seen: set[str] = set()
        for line in text.split("\n"):
            if _WORD.search(line):
                line_chars[i] += len(line)
                if line in seen:
                    dup_lines[i] += 1
                    dup_chars[i] += len(line)
                seen.add(line)
    out |= {"n_dup_lines": dup_lines, "dup_line_chars": dup_chars, "line_chars": line_chars}
    kept = 100 * dup_chars <= LINE_LIMIT * line_chars
    for n, limit in LIMITS.items():
        inside = repeated(ids, doc, n)
        out[f"dup_chars_{n}"] = sums(np.where(inside, chars, 0), count)
        kept &= 100 * out[f"dup_chars_{n}"] <= limit * out["word_chars"]
        if n == 8:
            out["n_repeat_words"] = sums(inside.astype(np.int64), count)
    out["base_failed"] = (count < LEAST_WORDS) | (100 * out["n_repeat_words"] > REPEAT_LIMIT * count)
    out["kept"] = kept & ~out["base_failed"]
    return out


def quality(docs: DataFrame) -> DataFrame:
    """docs (text, any other columns) with the columns of SCHEMA, which replace columns of the same names.

    A null or empty text has zero counts and fails (under LEAST_WORDS words). Repeated rows and ties are judged alike,
    each row by its own text; memory is bounded by the longest text, no shuffle takes place.
    """

    def work(_: pa.RecordBatch, texts: list[str]) -> dict[str, pa.Array]:
        return {k: pa.array(v) for k, v in measure(texts).items()}

    return mapped(docs, "text", work, SCHEMA)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict."""
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def _window(n: int) -> str:
    return f"array_agg(w) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS l{n}"


OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM l),
g AS (SELECT r, p, w, {", ".join(map(_window, LIMITS))} FROM w),
f AS (SELECT r, p, w, {", ".join(f"CASE WHEN len(l{n}) = {n} AND count(*) OVER (PARTITION BY r, l{n}) > 1 THEN 1 ELSE 0 END AS f{n}" for n in LIMITS)} FROM g),
c AS (SELECT r, w, {", ".join(f"max(f{n}) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in LIMITS)} FROM f),
s AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, sum(c8) AS n_repeat_words, {", ".join(f"sum(c{n} * length(w)) AS dup_chars_{n}" for n in LIMITS)} FROM c GROUP BY r),
t AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM d),
u AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY p) AS k FROM t WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
v AS (SELECT r, count(*) FILTER (WHERE k > 1) AS n_dup_lines, coalesce(sum(length(line)) FILTER (WHERE k > 1), 0) AS dup_line_chars, sum(length(line)) AS line_chars FROM u GROUP BY r),
a AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars, coalesce(line_chars, 0) AS line_chars,
  {", ".join(f"coalesce(dup_chars_{n}, 0) AS dup_chars_{n}" for n in LIMITS)}
  FROM d LEFT JOIN s USING (r) LEFT JOIN v USING (r)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_LIMIT} * n_words AS base_failed FROM a)
SELECT doc_id, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", "line_chars", *(f"dup_chars_{n}" for n in LIMITS)))},
  base_failed, NOT base_failed AND 100 * dup_line_chars <= {LINE_LIMIT} * line_chars AND {" AND ".join(f"100 * dup_chars_{n} <= {v} * word_chars" for n, v in LIMITS.items())} AS kept
FROM b
"""
