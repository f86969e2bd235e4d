"""S10 over C1/C2: chains kept up to date when editions grow, arrive or go.

A chain only runs towards later editions, so what a changed year pair can
alter lies upstream of it.  Both updates split the edges at the latest
changed pair, resolve the upstream part again, and take the rest from the
last result, which is also where the upstream chains enter it.  Year filters
reach the partition columns of a pair sink, so of the edges only the upstream
folders are read, and only their results need to be written again
(:func:`yearlink.sources.io.sink_pairs`).

``changed`` lists ``(year_n, year_n1)`` of every pair that was written again,
is new or was dropped since ``previous`` was made; a pair left out of it must
have the same rows as then.  Without a changed pair ``previous`` is returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yearlink.functions.text import norm_desc
from yearlink.plans.chain import _best_edge, chain_by_code, chain_by_description


def changed_pairs(before: DataFrame, now: DataFrame) -> DataFrame:
    """Pairs whose edges differ between two tables of edges, from a count and
    two sums of row hashes for each pair (one aggregate for each table)."""

    def digest(edges: DataFrame) -> DataFrame:
        h = F.xxhash64(*sorted(edges.columns))
        # 32-bit halves: their sums stay exact, and a pair of equal sums in
        # both halves with an equal count is taken for unchanged
        return edges.groupBy("year_n", "year_n1").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("low"),
            F.sum(F.shiftrightunsigned(h, 32)).alias("high"),
        )

    a, b = digest(before), digest(now)
    j = a.alias("a").join(b.alias("b"), ["year_n", "year_n1"], "full_outer")
    same = F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.low").eqNullSafe(F.col("b.low")) & F.col("a.high").eqNullSafe(F.col("b.high"))
    return j.filter(~same).select("year_n", "year_n1")


def _last(changed: DataFrame, column: str) -> int | None:
    return changed.agg(F.max(column)).first()[0]  # one number


def update_by_description(
    edges: DataFrame, previous: DataFrame, changed: DataFrame, anchor_year: int = 2023, with_path: bool = False
) -> DataFrame:
    """C2 (and C4) after a change: equal to ``chain_by_description(edges)``.

    ``previous`` is the last result (with ``path`` if ``with_path``).  A row
    depends on nodes of its own target year and later, so rows with a
    ``year_n`` beyond the last changed one stay as they are.
    """
    last = _last(changed, "year_n")
    if last is None:
        return previous
    stay = previous.filter(F.col("year_n") > last)
    again = edges.filter(F.col("year_n") <= last)
    # where upstream chains enter: nodes of the editions that they point to,
    # each with the result of its preferred out-edge
    entered = again.filter(F.col("year_n1") > last).select(F.col("year_n1").alias("ny")).distinct()
    got = ["mapped_2023_code", "mapped_2023_description", "hops", *(["path"] if with_path else [])]
    nodes = (
        stay.select(F.col("year_n").alias("ny"), norm_desc("description_n").alias("nd"), "combined", "row_id", *got)
        .filter(F.col("nd").isNotNull())
        .join(entered, "ny", "left_semi")
        .groupBy("ny", "nd")
        .agg(F.max_by(F.struct(*got), _best_edge()).alias("_e"))
        .filter(F.col("_e.hops").isNotNull())
        .select(
            "ny", "nd", F.col("_e.mapped_2023_code").alias("ac"), F.col("_e.mapped_2023_description").alias("ad"),
            F.col("_e.hops").alias("hops"), *([F.col("_e.path").alias("path")] if with_path else []),
        )
    )
    done = chain_by_description(again, anchor_year, with_path, resolved=nodes)
    return stay.select(*done.columns).unionByName(done)


def update_by_code(edges: DataFrame, previous: DataFrame, changed: DataFrame, anchor_year: int = 2023) -> DataFrame:
    """C1 after a change: equal to ``chain_by_code(edges, with_seed=True)``.

    ``previous`` is the last result with its ``anchor``.  The row that stands
    for a node is chosen among all rows of one target year, so the split is by
    ``year_n1``: rows beyond the last changed one stay as they are, and those
    that were reached hand their anchors on.
    """
    last = _last(changed, "year_n1")
    if last is None:
        return previous
    stay = previous.filter(F.col("year_n1") > last)
    again = edges.filter(F.col("year_n1") <= last)
    reached = stay.filter((F.col("year_n") <= last) & F.col("anchor").isNotNull()).select("year_n", "code_n", "anchor")
    done = chain_by_code(again, anchor_year, with_seed=True, reached=reached)
    return stay.select(*done.columns).unionByName(done)
