"""F4 in Catalyst: the Indel ratio without a Python worker.

The same bit-parallel recurrence as :mod:`yearlink.functions.indel`, written
with array functions.  Bits are kept in words of 62, so that ``v + u + carry``
never leaves a signed 64-bit number (ANSI arithmetic would fail) and the carry
is what lies above; a text of any length takes as many words as it needs.

Array lambdas are interpreted row by row, so this form is for plans that must
not start Python workers and for few pairs; the Arrow form does many at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from yearlink.functions.text import norm_desc

WORD = 62
FULL = (1 << WORD) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once (inside lambdas Spark
    does not share common expressions)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def _masks(chars: Column, alphabet: Column) -> Column:
    """For each character of the alphabet the words of its positions."""

    def word(c: Column, w: Column) -> Column:
        # the last character of the word first: it ends as the highest bit
        part = F.reverse(F.slice(chars, w * WORD + 1, WORD))
        return F.aggregate(part, _long(0), lambda acc, x: acc * 2 + (x == c).cast("bigint"))

    words = F.sequence(F.lit(0), F.floor((F.size(chars) - 1) / WORD).cast("int"))
    return F.transform(alphabet, lambda c: F.transform(words, lambda w: word(c, w)))


def _advance(v: Column, m: Column) -> Column:
    """One character of the other text: all words of ``v``, carries upwards."""

    def word(acc: Column, i: Column) -> Column:
        vw, mw = F.get(v, i), F.get(m, i)
        total = vw + vw.bitwiseAND(mw) + acc["carry"]
        return _let(
            total,
            lambda s: F.struct(
                F.shiftright(s, WORD).alias("carry"),
                F.concat(acc["done"], F.array(s.bitwiseAND(_long(FULL)).bitwiseOR(vw.bitwiseAND(F.bitwise_not(mw))))).alias("done"),
            ),
        )

    start = F.struct(_long(0).alias("carry"), F.array().cast("array<bigint>").alias("done"))
    return F.aggregate(F.sequence(F.lit(0), F.size(v) - 1), start, word, lambda acc: acc["done"])


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, in code points."""
    swap = F.length(a) > F.length(b)  # the shorter text has the bits
    short, long = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)

    def ones(chars: Column, masks: Column, steps: Column) -> Column:
        """Bits still set after all steps, among those of a character."""
        n = F.size(chars)
        # one word: no carries to pass on
        small = F.aggregate(
            steps,
            _long(FULL),
            lambda v, i: _let(
                F.get(F.get(masks, i), F.lit(0)),
                lambda m: (v + v.bitwiseAND(m)).bitwiseAND(_long(FULL)).bitwiseOR(v.bitwiseAND(F.bitwise_not(m))),
            ),
            lambda v: F.bit_count(v.bitwiseAND(F.call_function("shiftleft", _long(1), n) - 1)),
        )
        size = F.floor((n - 1) / WORD).cast("int") + 1
        last = F.call_function("shiftleft", _long(1), n - (size - 1) * WORD) - 1
        large = F.aggregate(
            steps,
            F.array_repeat(_long(FULL), size),
            lambda v, i: _let(F.get(masks, i), lambda m: _advance(v, m)),
            lambda v: F.aggregate(
                v, F.struct(F.lit(0).alias("at"), F.lit(0).alias("n")),
                lambda acc, x: F.struct(
                    (acc["at"] + 1).alias("at"),
                    (acc["n"] + F.bit_count(F.when(acc["at"] == size - 1, x.bitwiseAND(last)).otherwise(x))).alias("n"),
                ),
                lambda acc: acc["n"],
            ),
        )
        return F.when(n <= WORD, small).otherwise(large)

    def count(chars: Column) -> Column:
        return _let(
            F.array_distinct(chars),
            lambda alphabet: _let(
                # characters of the other text that the shorter one has
                F.filter(F.transform(F.split(long, ""), lambda c: F.array_position(alphabet, c).cast("int") - 1), lambda i: i >= 0),
                lambda steps: _let(_masks(chars, alphabet), lambda masks: F.size(chars) - ones(chars, masks, steps)),
            ),
        )

    return F.when(F.length(short) == 0, F.lit(0)).when(short.isNotNull() & long.isNotNull(), _let(F.split(short, ""), count))


def indel_expr(a, b, strip: bool = True, guard: bool = True) -> Column:
    """Column form of F4 in Catalyst; the same variants as
    :func:`yearlink.functions.indel.indel`."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    x, y = (norm_desc(a), norm_desc(b)) if strip else (F.lower(a), F.lower(b))

    def ratio(t: Column) -> Column:
        total = F.length(t["x"]) + F.length(t["y"])
        return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * lcs_length(t["x"], t["y"]) / total)

    score = _let(F.struct(x.alias("x"), y.alias("y")), ratio)
    if guard:
        return F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), F.lit(0.0)).otherwise(score)
    return F.when(a.isNotNull() & b.isNotNull(), score)
