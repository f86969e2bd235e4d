"""Operator 10, benchmark decontamination by template canonicalisation.

Texts become sequences of tokens: words without edge punctuation in lower
case, where numbers, units and names give way to typed placeholders (<num>,
<unit>, <name>).  "It takes 12 km" and "It takes 7.5 miles" are then the same
template.  A text has three readings, and each is matched with the same
reading of the items:

* *named*: a name is a capitalised word inside a sentence;
* *wide*: a capitalised word that opens a sentence is a name as well, so that
  changed names are seen there and a question may be quoted anywhere;
* *folded*: no word is a name, so that a copy in other letters is the same.

Line ends are white space like any other: text may be wrapped anywhere.

1. *Template windows.*  From every token of all items and of every whole
   document the shortest window of at least ``window`` tokens and ``literals``
   real words, hashed: where numbers, units and names are dense, the window is
   longer.  An item with fewer than ``window`` tokens is one window if it has
   ``literals`` real words.  Every ``window`` tokens in a row with fewer real
   words are also hashed with what their slots stand for, so that text with
   hardly a word in it is found as it stands.
2. *Hash join.*  The items' windows are hashed once and sent to the tasks,
   which probe them with the windows of each batch of documents.  Only
   ``BLOCK`` windows (a few MB) are sent at a time; a larger benchmark is
   joined block by block (blocks of whole items), so the broadcast is
   bounded whatever its size.
3. *Slot consistency.*  A hit of a document with an item is extended to both
   sides as long as the templates are equal: that is a passage.  Along a passage the slot values have to map one to one
   (the same number always to the same number, and so on), or the passage is
   cut there and only its consistent parts count.
   A document is contaminated by an item if a consistent passage has at least
   ``least`` tokens, or the whole item.

Defined cases: null and empty texts, of either side, match nothing; so does
an item with fewer than ``literals`` real words and ``window`` tokens.  Repeated rows give repeated
results (documents) or the same result (items).  Null ids: such a document is
reported with a null id and stays in ``clean``; an item without an id is not
used.  An empty benchmark or table finds nothing.
"""

from __future__ import annotations

import copy
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yearlink.llm import common as C
from yearlink.llm.common import U64

WINDOW, LITERALS, LEAST = 8, 5, 10
BLOCK = 200_000  # windows of the benchmark sent to the tasks at a time

UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre"
    " kilometres mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes ml l liter liters"
    " litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year"
    " years cent cents dollar dollars euro euros usd eur gbp percent degree degrees mph kmh kph hz khz mhz ghz kb mb gb tb v w kw"
    " j kj n pa".split()
)
NUM, UNIT, NAME = "<num>", "<unit>", "<name>"
_SLOTS = (NUM, UNIT, NAME)
_EDGE = ".,;:!?\"'()[]{}«»„“”‘’…#*&|<>~_="
_NUMBER = re.compile(r"([$€£]?)([+-]?\d[\d.,:/]*)([%°a-zA-Z€$£]*)")
_PLAIN = re.compile(rb"[a-z]+")


def template(text: str | None) -> tuple[list[str], list[str]]:
    """Tokens of a text as named and, for placeholders, what they stand for."""
    return _template(text)[:2]


def _template(text: str | None) -> tuple[list[str], list[str], list[int]]:
    """The template and the places of capitalised words that open a sentence."""
    tokens, values, opening = [], [], []
    fresh = True  # at the start of a sentence
    for raw in (text or "").encode().split():
        if not fresh and _PLAIN.fullmatch(raw):
            word = raw.decode()
            if word in UNITS and tokens[-1] == NUM:
                tokens.append(UNIT)
            else:
                tokens.append(word)
            values.append(word)
            continue
        raw = raw.decode()
        word = raw.strip(_EDGE)
        if word:
            m = _NUMBER.fullmatch(word) if word[0] in "$€£+-0123456789" else None
            if m:
                if m[1]:
                    tokens.append(UNIT)
                    values.append(m[1])
                tokens.append(NUM)
                values.append(m[2].rstrip(".,:/"))
                if m[3]:
                    tokens.append(UNIT)
                    values.append(m[3].lower())
            else:
                low = word.lower()
                if low in UNITS and tokens and tokens[-1] == NUM:
                    tokens.append(UNIT)
                elif word[0].isupper() and not word.isupper():
                    if fresh:
                        opening.append(len(tokens))
                    tokens.append(low if fresh else NAME)
                else:
                    tokens.append(low)
                values.append(low)
        fresh = raw[-1] in ".!?:"
    return tokens, values, opening


class Templates:
    """Templates of a batch of texts: token hashes, all in one array."""

    def __init__(self, texts: list[str | None]):
        parts = [_template(t) for t in texts]
        self.tokens = [p[0] for p in parts]
        self.values = [p[1] for p in parts]
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.lengths)))
        flat = [t for p in self.tokens for t in p]
        self.hash = _hashes(flat)
        slots = {C.tokenize(pa.array([s])).hash[0] for s in _SLOTS}
        self.literal = ~np.isin(self.hash, np.array(sorted(slots), U64))
        self.words = np.concatenate(([0], np.cumsum(self.literal)))
        self.doc = np.repeat(np.arange(len(texts)), self.lengths)
        self.opening = np.array([f + i for f, p in zip(self.first.tolist(), parts, strict=False) for i in p[2]], np.int64)
        self.changed, self.to, self._made = np.empty(0, np.int64), [], {}

    def wide(self) -> Templates:
        return self._reading(self.opening, [NAME] * len(self.opening))

    def folded(self) -> Templates:
        at = np.flatnonzero(self.hash == _hashes([NAME])[0])
        of = self.doc[at]
        return self._reading(at, [self.values[d][i] for d, i in zip(of.tolist(), (at - self.first[of]).tolist(), strict=True)])

    def _reading(self, at: np.ndarray, tokens: list[str]) -> Templates:
        """The same texts with other tokens at the places ``at``."""
        other = copy.copy(self)
        other.changed, other.to, other._made = at, tokens, {}
        other.hash, other.literal = self.hash.copy(), self.literal.copy()
        other.hash[at] = _hashes(tokens)
        other.literal[at] = ~self.literal[at]
        other.words = np.concatenate(([0], np.cumsum(other.literal)))
        return other

    def sequence(self, d: int) -> list[str]:
        """Tokens of text ``d`` in this reading."""
        if d not in self._made:
            lo, hi = np.searchsorted(self.changed, self.first[d : d + 2])
            made = list(self.tokens[d]) if lo < hi else self.tokens[d]
            for at, token in zip(self.changed[lo:hi].tolist(), self.to[lo:hi], strict=True):
                made[at - int(self.first[d])] = token
            self._made[d] = made
        return self._made[d]

    def windows(self, k: int, literals: int):
        """Start, length and hash of the windows of ``k`` tokens with enough words."""
        at = self._starts(k, literals, True)
        return at, np.full(len(at), k), self._sums(k)[at] if len(at) else np.empty(0, U64)

    def _starts(self, k: int, literals: int, rich: bool) -> np.ndarray:
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.int64)
        enough = self.words[k:] - self.words[:-k] >= min(literals, k)
        return np.flatnonzero((self.doc[:n] == self.doc[k - 1 :]) & (enough if rich else ~enough))

    def _sums(self, k: int) -> np.ndarray:
        n = len(self.hash) - k + 1
        h = np.zeros(n, U64)
        for j in range(k):
            h = h * C._STEP + self.hash[j : j + n]
        return C.mix(h + U64(k))

    def poor_windows(self, k: int, literals: int):
        """The windows of ``k`` tokens with fewer words, hashed as they stand."""
        at = self._starts(k, literals, False)
        if not len(at):
            return at, at, np.empty(0, U64)
        covered = np.zeros(len(self.hash) + 1, np.int64)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + k, -1)
        slot = np.flatnonzero((np.cumsum(covered[:-1]) > 0) & ~self.literal)
        of, place = self.doc[slot].tolist(), (slot - self.first[self.doc[slot]]).tolist()
        exact = self.hash.copy()  # where a slot is, with what stands there
        exact[slot] = C.mix(exact[slot] * C._STEP + _hashes([self.values[d][i] for d, i in zip(of, place, strict=True)]))
        h = np.zeros(len(at), U64)
        for j in range(k):
            h = h * C._STEP + exact[at + j]
        return at, np.full(len(at), k), C.mix(C.mix(h) + U64(k))

    def long_windows(self, k: int, literals: int):
        """Windows longer than ``k``, from each token to the ``literals``-th
        word after it in its text."""
        at = self._starts(k, literals, False)
        words = np.flatnonzero(self.literal)
        last = np.searchsorted(words, at) + literals - 1  # of the words
        at, last = at[last < len(words)], last[last < len(words)]
        end = words[last] + 1
        inside = end <= self.first[self.doc[at] + 1]
        at, end = at[inside], end[inside]
        if not len(at):
            return at, at, np.empty(0, U64)
        # sums of hash * STEP^place, moved back to the window's start
        up, down = _step_powers(len(self.hash))
        total = np.concatenate((np.zeros(1, U64), np.cumsum(self.hash * up, dtype=U64)))
        return at, end - at, C.mix((total[end] - total[at]) * down[at] + (end - at).astype(U64))


def _hashes(tokens: list[str]) -> np.ndarray:
    return C.tokenize(pa.array([" ".join(tokens)], pa.large_string())).hash


_pow = [np.ones(1, U64), np.ones(1, U64)]


def _step_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        for i, base in enumerate((int(C._STEP), pow(int(C._STEP), -1, 1 << 64))):
            p = np.full(1 << (n - 1).bit_length(), U64(base))
            p[0] = 1
            _pow[i] = np.cumprod(p, dtype=U64)
    return _pow[0][:n], _pow[1][:n]


READINGS = (lambda texts: texts, Templates.wide, Templates.folded)


class Benchmark:
    """Window hashes of some items in one reading, sorted, with where each comes from."""

    def __init__(self, items: list[tuple[int, str | None]], window: int, literals: int, reading=READINGS[0]):
        self.ids = [i for i, _ in items]
        self.text = reading(Templates([t for _, t in items]))
        self.short = sorted({int(n) for n in self.text.lengths if literals <= n < window})
        found = list(_probes(self.text, window, literals))
        for k in self.short:  # the whole of a short item
            at, _, h = self.text.windows(k, literals)
            whole = self.text.lengths[self.text.doc[at]] == k
            found.append((at[whole], None, h[whole]))
        self.at = np.concatenate([f[0] for f in found])
        self.hash = np.concatenate([f[2] for f in found])
        order = np.argsort(self.hash, kind="stable")
        self.at, self.hash = self.at[order], self.hash[order]


def _probes(text: Templates, window: int, literals: int, short: list[int] | tuple = ()):
    """All windows of some texts, a kind at a time."""
    yield text.windows(window, literals)
    yield text.long_windows(window, literals)
    yield text.poor_windows(window, literals)
    for k in short:
        yield text.windows(k, literals)


def _passages(docs: Templates, bench: Benchmark, window: int, literals: int):
    """(document, item, first token in each, length) of the longest equal
    templates around the hits, on one diagonal each."""
    runs: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    for at, size, h in _probes(docs, window, literals, bench.short):
        lo = np.searchsorted(bench.hash, h, "left")
        hit = np.flatnonzero((lo < len(bench.hash)) & (bench.hash[np.minimum(lo, len(bench.hash) - 1)] == h))
        hi = np.searchsorted(bench.hash, h[hit], "right")
        # a kind of window gives its hits in ascending places
        last: dict[tuple[int, int, int], int] = {}
        for i, k, a, b in zip(at[hit].tolist(), size[hit].tolist(), lo[hit].tolist(), hi.tolist(), strict=True):
            d = int(docs.doc[i])
            p = i - int(docs.first[d])
            for q in bench.at[a:b].tolist():
                item = int(bench.text.doc[q])
                q -= int(bench.text.first[item])
                key = d, item, p - q
                if p + k <= last.get(key, 0):
                    continue  # inside the passage before
                x, y = docs.sequence(d), bench.text.sequence(item)
                start, end = p, p + k
                if end - (p - q) > len(y) or x[p:end] != y[q : q + k]:
                    continue  # another text with the same hash
                while start and start > p - q and x[start - 1] == y[start - 1 - (p - q)]:
                    start -= 1
                while end < len(x) and end - (p - q) < len(y) and x[end] == y[end - (p - q)]:
                    end += 1
                last[key] = end
                runs.setdefault(key, []).append((start, end))
    for (d, item, shift), found in runs.items():
        for p, e in dict.fromkeys(found):
            yield d, item, p, p - shift, e - p


def consistent_length(doc_tokens, doc_values, item_tokens, item_values) -> int:
    """Longest stretch of two equal templates whose slot values map one to one."""
    best = start = i = 0
    ahead: dict = {}
    back: dict = {}
    while i < len(doc_tokens):
        kind = item_tokens[i]
        if kind in _SLOTS:
            x, y = (kind, item_values[i]), (kind, doc_values[i])
            if ahead.get(x, (y,))[0] != y or back.get(y, (x,))[0] != x:
                best = max(best, i - start)
                # go on after the last place where the clashing values stood
                start = 1 + max(ahead[x][1] if x in ahead else -1, back[y][1] if y in back else -1)
                ahead = {k: v for k, v in ahead.items() if v[1] >= start}
                back = {k: v for k, v in back.items() if v[1] >= start}
                continue
            ahead[x], back[y] = (y, i), (x, i)
        i += 1
    return max(best, i - start)


def _find(benches: list[Benchmark], window: int, literals: int, least: int):
    """``benches``: the items in each of ``READINGS``."""

    def run(batches):
        for b in C.slices(batches, "text", size=1 << 20):
            ids = b.column(0).to_pylist()
            texts = Templates(b.column(1).to_pylist())
            best: dict[tuple[int, int], int] = {}
            for reading, bench in zip(READINGS, benches, strict=True):
                docs = reading(texts)
                for d, item, p, q, n in _passages(docs, bench, window, literals):
                    same = consistent_length(
                        docs.sequence(d)[p : p + n],
                        docs.values[d][p : p + n],
                        bench.text.sequence(item)[q : q + n],
                        bench.text.values[item][q : q + n],
                    )
                    if same >= min(least, int(bench.text.lengths[item])):
                        key = d, bench.ids[item]
                        best[key] = max(best.get(key, 0), same)
            rows = [(ids[d], item, n) for (d, item), n in sorted(best.items())]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "n_tokens"])

    return run


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    literals: int = LITERALS,
    least: int = LEAST,
) -> DataFrame:
    """One row for each document and item it leaks: doc_id, item_id, n_tokens
    (tokens of the longest consistent passage)."""
    spark = docs.sparkSession
    C.prepare(spark)
    schema = "doc_id long, item_id long, n_tokens long"
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    items = items.where("item_id is not null and text is not null").distinct()
    # whole items in blocks of about BLOCK words; one block is at the driver at a time
    size = items.agg(F.sum(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")))).first()[0] or 0
    blocks = -(-size // BLOCK)
    out = None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        pairs = [(r["item_id"], r["text"]) for r in part]
        benches = [Benchmark(pairs, window, literals, reading) for reading in READINGS]
        if not any(len(b.hash) for b in benches):
            continue
        found = plain.mapInArrow(_find(benches, window, literals, least), schema)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that leak no item, all columns as they were."""
    bad = leaks(docs, benchmark, id_col, text_col, **how).where("doc_id is not null")
    return C.without(docs, bad.select("doc_id").distinct(), id_col)
