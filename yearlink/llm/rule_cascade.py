"""Operator 3, quality rules as a short-circuit cascade.

Every rule's cost (seconds of a task) and selectivity (share of texts that
it rejects) are measured on a sample; the rules then run in descending order
of rejections per second, each only on the texts that are still in.  As a
text is kept if no rule rejects it, the order changes the time, never the
result.  The sample is a bounded number of random rows (``sample_rows``), as
it only sets the order; the rules run over every whole text.

Defined cases: a null text has no words, like an empty one.  Each row is
judged alone, so repeated rows and null ids need nothing special.  An empty
table gives an empty table (the rules then run as listed).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yearlink.llm import common as C
from yearlink.llm import docstats as D


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[D.Stats], np.ndarray]


BASE = (
    Rule("too_short", lambda s: s.n_words < 20),
    Rule("repeated_windows", lambda s: 100 * s.repeated_words > 30 * s.n_words),
)
RULES = (
    *BASE,
    Rule("symbols", lambda s: 10 * s.symbols > 3 * s.n_words),
    Rule("capitals", lambda s: 2 * s.count(D.UPPER) > s.word_chars),
    Rule("shouting", lambda s: 2 * s.count(D.MARK) > s.n_words),
    Rule("word_length", lambda s: (s.word_chars < 2 * s.n_words) | (s.word_chars > 15 * s.n_words)),
    Rule("stuttering", lambda s: 100 * s.same_as_previous > 20 * s.n_words),
    Rule("duplicate_lines", lambda s: 2 * s.duplicate_lines > s.n_lines),
)
REPORTED = {
    "n_words": lambda s: s.n_words,
    "word_chars": lambda s: s.word_chars,
    "n_symbols": lambda s: s.symbols,
    "n_dup_lines": lambda s: s.duplicate_lines,
    "n_repeat_words": lambda s: s.repeated_words,
}


def _measure(rules: tuple[Rule, ...]):
    def run(batches):
        for b in C.slices(batches, "text", rows=500):
            names, cost, out = [], [], []
            for r in rules:
                stats = D.Stats(b.column(0))
                began = time.thread_time()
                out.append(int(r.rejects(stats).sum()))
                cost.append(time.thread_time() - began)
                names.append(r.name)
            seen = pa.array([b.num_rows] * len(names), pa.int64())
            yield pa.record_batch(
                [pa.array(names), pa.array(cost), pa.array(out, pa.int64()), seen], names=["name", "cost", "rejected", "seen"]
            )

    return run


def plan(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> tuple[Rule, ...]:
    """The rules by rejections per second of task time on a sample."""
    rows = docs.select(F.col(text_col).alias("text"))
    total = rows.count()
    if not total:
        return rules
    some = rows.sample(min(1.0, 1.5 * sample_rows / total), seed=1).limit(sample_rows)
    found = some.mapInArrow(_measure(rules), "name string, cost double, rejected long, seen long")
    found = found.groupBy("name").agg(F.sum("cost").alias("cost"), F.sum("rejected").alias("rejected")).collect()
    worth = {r["name"]: r["rejected"] / max(r["cost"], 1e-9) for r in found}
    return tuple(sorted(rules, key=lambda r: -worth.get(r.name, 0.0)))


def kept_by(stats: D.Stats, rules: tuple[Rule, ...]) -> np.ndarray:
    """Which texts no rule rejects; each rule sees only the texts still in."""
    rows, now = np.arange(stats.n), stats
    for rule in rules:
        if not len(rows):
            break
        stay = ~rule.rejects(now)
        if stay.all():
            continue
        # a narrower batch has to compute its statistics anew: only if it pays
        now = now.only(np.flatnonzero(stay)) if stay.mean() < 0.7 else _View(now, np.flatnonzero(stay))
        rows = rows[stay]
    kept = np.zeros(stats.n, bool)
    kept[rows] = True
    return kept


class _View:
    """Statistics of some rows of a batch, taken from the whole batch's."""

    def __init__(self, stats, rows: np.ndarray):
        self._stats, self._rows, self.n = stats, rows, len(rows)

    def __getattr__(self, name):
        return getattr(self._stats, name)[self._rows]

    def count(self, table):
        return self._stats.count(table)[self._rows]

    def only(self, rows: np.ndarray):
        return self._stats.only(self._rows[rows])


def judged(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
    sample_rows: int = 1000,
) -> DataFrame:
    """Per document: doc_id, the statistics of ``REPORTED``, base_failed, kept."""
    C.prepare(docs.sparkSession)
    ordered = plan(docs, text_col, rules, sample_rows)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in C.slices(batches, "text"):
            stats = D.Stats(b.column(1))
            made = [pa.array(f(stats).astype(np.int64)) for f in REPORTED.values()]
            failed = np.zeros(stats.n, bool)
            for r in BASE:
                failed |= r.rejects(stats)
            kept = kept_by(stats, ordered) & ~failed
            made = [b.column(0), *made, pa.array(failed), pa.array(kept)]
            yield pa.record_batch(made, names=["doc_id", *REPORTED, "base_failed", "kept"])

    longs = ", ".join(f"{k} long" for k in REPORTED)
    return plain.mapInArrow(run, f"doc_id long, {longs}, base_failed boolean, kept boolean")


_SPLIT = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, {_SPLIT} AS w FROM documents),
word AS (SELECT k, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
per_word AS (
  SELECT k, count(*) AS n_words, sum(length(word)) AS word_chars,
         count(*) FILTER (WHERE word = before) AS stutter
  FROM (SELECT k, word, lag(word) OVER (PARTITION BY k ORDER BY i) AS before FROM word) GROUP BY k),
win AS (SELECT k, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda j: list_slice(w, j, j + 7))) AS g
        FROM d WHERE len(w) >= 8),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM win) WHERE c > 1),
covered AS (SELECT k, count(DISTINCT i + o) AS n_repeat_words FROM twice, range(0, 8) AS r(o) GROUP BY k),
line AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d),
per_line AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
             FROM line WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY k),
s AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, coalesce(stutter, 0) AS stutter,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals,
         length(regexp_replace(text, '[^!?]', '', 'g')) AS marks
  FROM d LEFT JOIN per_word USING (k) LEFT JOIN per_line USING (k) LEFT JOIN covered USING (k)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 2 * capitals > word_chars OR 2 * marks > n_words
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * stutter > 20 * n_words
            OR 2 * n_dup_lines > n_lines) AS kept
FROM b
"""
