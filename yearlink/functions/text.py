"""Scalar text functions as JVM-side Column expressions.

All of these stay inside whole-stage codegen; the only Python scalar in the
engine is the Indel ratio (``yearlink.functions.indel``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java regex: with (?U) the class \s is Unicode white space, which is what
# Python's str.split()/str.strip() use (U+001C..U+001F excepted).
_WS = r"(?U)\s+"
_OUTER_WS = r"(?U)^\s+|\s+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Python ``str.strip()``: remove outer Unicode white space."""
    return F.regexp_replace(_c(x), _OUTER_WS, "")


def norm_desc(x) -> Column:
    """``strip().lower()``."""
    return F.lower(strip(x))


def text_key(x) -> Column:
    """32 hex digits (half of the SHA-256) that stand for a text in joins and
    shuffles; NULL for NULL.  :func:`norm_desc` leaves a key as it is."""
    return F.substring(F.sha2(_c(x), 256), 1, 32)


def tokens(x) -> Column:
    """``set(lower().split())`` as a distinct string array."""
    parts = F.split(F.lower(_c(x)), _WS)
    return F.array_distinct(F.filter(parts, lambda t: t != F.lit("")))


def jaccard(a_tokens, b_tokens) -> Column:
    """|a & b| / |a | b|; 0 when either set is empty (or NULL)."""
    a, b = _c(a_tokens), _c(b_tokens)
    na = F.coalesce(F.size(a), F.lit(0))
    nb = F.coalesce(F.size(b), F.lit(0))
    inter = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when((na <= 0) | (nb <= 0), F.lit(0.0)).otherwise(inter / union)


def indel_upper_bound(len_a, len_b) -> Column:
    """Upper bound of the Indel ratio from lengths: 2*min/(sum); 0/0 -> 1."""
    la, lb = _c(len_a), _c(len_b)
    tot = la + lb
    return F.when(tot == 0, F.lit(1.0)).otherwise(F.least(la, lb) * 2.0 / tot)


def combined(cos, jac, lev, alpha: float = 0.7, beta: float = 0.2, gamma: float = 0.1) -> Column:
    """F8: alpha*cos + beta*jac + gamma*lev (left-associative, as in SQL)."""
    return F.lit(float(alpha)) * _c(cos) + F.lit(float(beta)) * _c(jac) + F.lit(float(gamma)) * _c(lev)


def slug(x) -> Column:
    """lower, keep letters/digits/space, first 40, strip, space -> '_'."""
    kept = F.regexp_replace(F.lower(_c(x)), r"[^\p{L}\p{N} ]", "")
    return F.replace(strip(F.substring(kept, 1, 40)), F.lit(" "), F.lit("_"))


def uniq_key(year, item_id, code, description) -> Column:
    """trimmed code when non-blank, else ``{year}_{row}_{slug}``."""
    trimmed = strip(_c(code))
    fallback = F.concat_ws("_", _c(year).cast("string"), _c(item_id).cast("string"), slug(description))
    return F.when(trimmed.isNotNull() & (trimmed != ""), trimmed).otherwise(fallback)


def clean_code(code, year, min_year: int = 1989) -> Column:
    """F11 value part: from ``min_year`` on, drop a trailing '.0' of a code
    longer than 8 chars, then left-pad a 7-char code with one '0'.

    Rows whose cleaned code has 10+ chars are removed by
    :func:`yearlink.operators.cleaning.clean_codes` (a row filter, not a value).
    """
    c, y = _c(code).cast("string"), _c(year)
    no_float = F.when((F.length(c) > 8) & c.endswith(".0"), c.substr(F.lit(1), F.length(c) - 2)).otherwise(c)
    padded = F.when(F.length(no_float) == 7, F.concat(F.lit("0"), no_float)).otherwise(no_float)
    return F.when(y >= min_year, padded).otherwise(c)


def clean_code_keep(code, year, min_year: int = 1989) -> Column:
    """F11 row predicate: False for rows the cleaner drops (length >= 10 after
    the '.0' strip, from ``min_year`` on).  NULL codes are kept."""
    c, y = _c(code).cast("string"), _c(year)
    no_float = F.when((F.length(c) > 8) & c.endswith(".0"), c.substr(F.lit(1), F.length(c) - 2)).otherwise(c)
    too_long = (y >= min_year) & (F.coalesce(F.length(no_float), F.lit(0)) >= 10)
    return ~too_long


def prefix2(code) -> Column:
    """first two characters when the code has at least two, else NULL."""
    c = _c(code)
    return F.when(F.length(c) >= 2, F.substring(c, 1, 2))


def pad2(code) -> Column:
    """left-pad a one-character value with '0'; longer values unchanged."""
    c = _c(code)
    return F.when(F.length(c) == 1, F.concat(F.lit("0"), c)).otherwise(c)


def code_length(code) -> Column:
    """string length of the code."""
    return F.length(_c(code))


def round_report(x, digits: int) -> Column:
    """Python ``round`` (half-even)."""
    return F.bround(_c(x), digits)
