"""License scans: ordered signature rules over whole texts, in SQL functions.

A text that holds none of the gate words is only counted.  The others are
written as words with their numbers (`` the=0  mit=1 ``), so that a match tells
its own place.  A rule's pattern runs only if its keyword is among the words.
Overlapping detections are resolved in two sweeps along the text:

* containment: a detection goes if one of its own or a better class holds its
  whole interval (of equal intervals of a class the earlier rule stays);
* priority: a detection goes if one of a better class overlaps it.

Both look at all detections, also at those that go, so the order of the sweeps
does not matter.  Base phrases are kept always and suppress nothing.

No shuffle, no Python: one pass over the table.  A sweep is linear in the
detections of a text; its marks are gathered in pieces.

Defined results: a null or empty text has 0 words and no detection; repeated
rows give a row each; null ids stay null; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yearlink.llm.license_rules import GATES, RULES, SHORT

BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
_BASE_CONFIDENCE = 0.75
_GAP = "\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F"  # no word character, before lower-casing
_WORD = f"[^{_GAP}]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PIECE = 256


def _pattern(words: str) -> str:
    """A rule's pattern over numbered words."""
    return " " + words.replace(" ", "=[0-9]+  ").replace("_", "[^ =]+") + "=[0-9]+ "


def rules() -> list[tuple[int, int, str, float, str, str]]:
    """(number, class, label, confidence, keyword, pattern); class 0: base."""
    out = [(i, 0, label, _BASE_CONFIDENCE, f" {words.split()[0]}=", _pattern(words)) for i, (label, words) in enumerate(BASE)]
    for line in RULES.strip().splitlines():
        cls, label, confidence, keyword, words = line.split(" | ")
        out.append((len(out), int(cls), label, float(confidence), f" {keyword}=", _pattern(words)))
    return out


def _rule_array() -> str:
    rows = ", ".join(
        f"named_struct('rule', {i}, 'class', {c}, 'label', '{label}', 'confidence', {conf}D, 'key', '{key}', 'pattern', '{p}')"
        for i, c, label, conf, key, p in rules()
    )
    return f"array({rows})"


def worth_a_look(text: Column) -> Column:
    """Whether a text holds a gate word."""
    low = F.lower(text)
    found = low.contains(GATES[0])
    for g in GATES[1:]:
        found = found | low.contains(g)
    return found | text.rlike(f"(?i)(?:^|[{_GAP}])(?:{'|'.join(SHORT)})(?:[{_GAP}]|$)")


def _sweep(spans: str, best: str, hides: str, move: str) -> str:
    """Walk along ``spans`` with ``best`` (a number for each class) and mark
    each span; marks are gathered in pieces of bounded size."""
    span = "struct<start:int,back:int,class:int,rule:int,label:string,confidence:double,hidden:boolean>"
    mark = (
        "named_struct('start', d.start, 'back', d.back, 'class', d.class, 'rule', d.rule, 'label', d.label, "
        f"'confidence', d.confidence, 'hidden', {hides})"
    )
    grown = f"array_append(s.open, {mark})"
    return (
        f"aggregate({spans}, named_struct('best', {best}, 'done', cast(array() as array<array<{span}>>), 'open', cast(array() as array<{span}>)), "
        f"(s, d) -> named_struct('best', transform(s.best, (v, i) -> if(i + 1 >= d.class, {move}, v)), "
        f"'done', if(size(s.open) >= {_PIECE - 1}, array_append(s.done, {grown}), s.done), "
        f"'open', if(size(s.open) >= {_PIECE - 1}, cast(array() as array<{span}>), {grown})), "
        "s -> concat(flatten(s.done), s.open))"
    )


def detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id as ``doc_id``, n_words, ``base`` and ``found``: arrays
    of (start, end, rule, label, confidence) with word numbers from 0, both
    included, of the base phrases and of the method's detections that stay."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    look = worth_a_look(F.col("text"))
    words = f"regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), r'{_WORD}', 0)"
    numbered = f"concat(' ', array_join(transform({words}, (w, i) -> concat(w, '=', i)), '  '), ' ')"
    norm = rows.select("doc_id", F.expr(f"regexp_count(text, r'{_WORD}')").cast("long").alias("n_words"), F.when(look, F.expr(numbered)).alias("norm"))
    hits = (
        "flatten(transform(filter({rules}, r -> contains(norm, r.key)), r -> transform(regexp_extract_all(norm, r.pattern, 0), "
        "m -> named_struct('start', int(regexp_extract(m, '=([0-9]+)', 1)), 'back', -int(regexp_extract(m, '=([0-9]+) $', 1)), "
        "'class', r.class, 'rule', r.rule, 'label', r.label, 'confidence', r.confidence))))"
    ).format(rules=_rule_array())
    hits = norm.select("doc_id", "n_words", F.when(F.col("norm").isNotNull(), F.expr(hits)).alias("hits"))
    split = hits.select(
        "doc_id",
        "n_words",
        F.expr("filter(hits, h -> h.class = 0)").alias("base"),
        F.expr("array_sort(filter(hits, h -> h.class > 0))").alias("hits"),
    )
    # forward: best[c] is the largest end of classes up to c + 1 so far
    held = "(s.best[d.class - 1] >= -d.back or (d.class > 1 and s.best[greatest(d.class, 2) - 2] >= d.start))"
    forward = _sweep("hits", "array(-1, -1, -1, -1)", held, "greatest(v, -d.back)")
    # backward: best[c] is the next start of classes up to c + 1
    met = "(d.hidden or (d.class > 1 and s.best[greatest(d.class, 2) - 2] <= -d.back))"
    far = "2147483647"
    back = _sweep("reverse(marked)", f"array({far}, {far}, {far}, {far})", met, "least(v, d.start)")
    marked = split.select("doc_id", "n_words", "base", F.expr(forward).alias("marked"))
    marked = marked.select("doc_id", "n_words", "base", F.expr(back).alias("marked"))
    shape = "h -> named_struct('start', h.start, 'end', -h.back, 'rule', h.rule, 'label', h.label, 'confidence', h.confidence)"
    none = "cast(array() as array<struct<start:int,end:int,rule:int,label:string,confidence:double>>)"
    return marked.select(
        "doc_id",
        "n_words",
        F.expr(f"coalesce(transform(base, {shape}), {none})").alias("base"),
        F.expr(f"coalesce(transform(filter(reverse(marked), h -> not h.hidden), {shape}), {none})").alias("found"),
    )


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest per row: n_words, n_base, first_word, last_word, base_labels,
    labels and score, the largest confidence of what stays (0 without any)."""
    found = detections(docs, id_col, text_col)
    joined = "array_join(array_sort(array_distinct(transform({}, h -> h.label))), ',')"
    both = "concat(base, found)"
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.expr("array_min(transform(base, h -> h.start))").cast("long").alias("first_word"),
        F.expr("array_max(transform(base, h -> h.start))").cast("long").alias("last_word"),
        F.expr(joined.format("base")).alias("base_labels"),
        F.expr(joined.format(both)).alias("labels"),
        F.expr(f"coalesce(array_max(transform({both}, h -> h.confidence)), 0D)").alias("score"),
    )


_VALUES = ", ".join(f"({i}, {c}, '{label}', {conf}, '{key}', '{p}')" for i, c, label, conf, key, p in rules())
SQL = f"""
WITH rule(rule, class, label, confidence, key, pattern) AS (VALUES {_VALUES}),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT k, ' ' || array_to_string(list_transform(w, lambda x, i: x || '=' || (i - 1)), '  ') || ' ' AS t FROM d),
hit AS (SELECT k, class, rule, label, confidence, unnest(regexp_extract_all(t, pattern)) AS m FROM t JOIN rule ON contains(t, key)),
span AS (SELECT k, class, rule, label, confidence::DOUBLE AS confidence, regexp_extract(m, '=([0-9]+)', 1)::BIGINT AS a,
                regexp_extract(m, '=([0-9]+) $', 1)::BIGINT AS z FROM hit),
kept AS (SELECT * FROM span d WHERE class = 0 OR NOT EXISTS (
    SELECT 1 FROM span e WHERE e.k = d.k AND e.class > 0 AND
        ((e.class <= d.class AND e.a <= d.a AND e.z >= d.z AND (e.a < d.a OR e.z > d.z OR e.class < d.class OR e.rule < d.rule))
         OR (e.class < d.class AND e.a <= d.z AND e.z >= d.a)))),
per AS (SELECT k, count(*) FILTER (class = 0) AS n_base, min(a) FILTER (class = 0) AS first_word, max(a) FILTER (class = 0) AS last_word,
               string_agg(DISTINCT label, ',' ORDER BY label) FILTER (class = 0) AS base_labels,
               string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(confidence) AS score FROM kept GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN per USING (k)
"""
