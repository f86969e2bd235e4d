"""Chaining yearly edges to the anchor edition (C1-C4) and two-way
reconciliation (J11).

Both closures are pointer doubling: each round is one self-join of a table
whose size is linear in the edges, and the number of rounds is
``ceil(log2(longest chain))`` (7 for 95 year pairs).  Every round's result is
cut from its lineage with a reliable ``checkpoint()`` into the session's
checkpoint folder, so a lost executor recomputes one round, not the chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yearlink.functions.text import norm_desc, text_key
from yearlink.session import checkpoint_table

MAX_ROUNDS = 40  # 2**40 hops: far beyond any calendar


def _cut(df: DataFrame) -> DataFrame:
    return checkpoint_table(df)


# --------------------------------------------------------------------- C2
def _hop() -> Column:
    return F.struct(F.col("year_n1").alias("year"), F.col("code_n1").alias("code"), F.col("combined").alias("score"))


def _best_edge() -> Column:
    """The order in which C2 prefers the out-edges of one node."""
    return F.struct(F.coalesce(F.col("combined").isNotNull(), F.lit(False)), F.col("combined"), F.col("row_id"))


def chain_by_description(
    edges: DataFrame, anchor_year: int = 2023, with_path: bool = False, resolved: DataFrame | None = None
) -> DataFrame:
    """Map every forward edge (N -> N1) to its anchor-year item by
    following description nodes ``(year, strip().lower() text)``.

    A row whose target year is the anchor maps to its own target.  Otherwise
    it takes the mapping of the out-edge leaving its target node.  A node with
    several out-edges (repeated text in a year) uses the one with the highest
    ``combined``, then the highest ``row_id`` (reported by
    :func:`ambiguous_nodes`).  Rows that never reach the anchor stay NULL.
    Adds ``mapped_2023_code, mapped_2023_description, hops``.  ``with_path``
    also adds C4's ``path``: the hops in order, each with the year and code it
    leads to and its score.  Doubling joins the hop lists end to end, so a list
    is never longer than the number of editions.  ``resolved`` gives nodes that
    are settled already (``ny, nd, ac, ad, hops`` and ``path``, see
    :mod:`yearlink.plans.chain_update`); ``edges`` must not leave them.

    Nodes travel as (year, :func:`text_key`).  The description columns may hold
    keys of the normalised texts themselves; ``mapped_2023_description`` is one
    of them then.
    """
    e = edges.withColumn("_dn", text_key(norm_desc("description_n"))).withColumn("_dn1", text_key(norm_desc("description_n1")))
    text = F.when(F.col("year_n1") == anchor_year, F.col("description_n1")).alias("description_n1")
    # one out-edge per node: highest combined (NULL lowest), then highest
    # row_id.  An aggregate (map-side partial max_by), not a window, so a
    # description repeated by a third of all rows never lands in one sort.
    chosen = (
        e.filter(F.col("_dn").isNotNull())
        .groupBy("year_n", "_dn")
        .agg(F.max_by(F.struct("year_n1", "_dn1", "code_n1", text, "combined"), _best_edge()).alias("_e"))
    )
    out = (
        chosen.select("year_n", "_dn", "_e.*")
        .select(
            F.col("year_n").alias("ny"),
            F.col("_dn").alias("nd"),
            F.when(F.col("year_n1") != anchor_year, F.col("year_n1")).alias("py"),
            F.when(F.col("year_n1") != anchor_year, F.col("_dn1")).alias("pd"),
            F.when(F.col("year_n1") == anchor_year, F.col("code_n1")).alias("ac"),
            F.col("description_n1").alias("ad"),
            (F.col("year_n1") == anchor_year).alias("done"),
            F.lit(1).alias("hops"),
            *([F.array(_hop()).alias("path")] if with_path else []),
        )
    )
    if resolved is not None:
        out = out.unionByName(
            resolved.withColumn("nd", text_key("nd")).withColumn("py", F.lit(None).cast("int")).withColumn("pd", F.lit(None).cast("string")).withColumn("done", F.lit(True))
        )
    state = _cut(out)
    for _ in range(MAX_ROUNDS):
        # only rows with a pointer are joined: finished ones would all meet on
        # the NULL key
        live = ~F.col("done") & F.col("py").isNotNull() & F.col("pd").isNotNull()
        pending = state.filter(live)
        if pending.isEmpty():
            break
        t = state.select(
            F.col("ny").alias("ty"), F.col("nd").alias("td"),
            F.col("py").alias("tpy"), F.col("pd").alias("tpd"),
            F.col("ac").alias("tac"), F.col("ad").alias("tad"),
            F.col("done").alias("tdone"), F.col("hops").alias("thops"),
            *([F.col("path").alias("tpath")] if with_path else []),
        )
        j = pending.join(t, (pending["py"] == t["ty"]) & (pending["pd"] == t["td"]), "left")
        found = F.col("ty").isNotNull()
        moved = j.select(
            "ny",
            "nd",
            F.when(found & ~F.col("tdone"), F.col("tpy")).alias("py"),
            F.when(found & ~F.col("tdone"), F.col("tpd")).alias("pd"),
            F.when(found & F.col("tdone"), F.col("tac")).alias("ac"),
            F.when(found & F.col("tdone"), F.col("tad")).alias("ad"),
            (found & F.col("tdone")).alias("done"),
            F.when(found, F.col("hops") + F.col("thops")).otherwise(F.col("hops")).alias("hops"),
            *([F.when(found, F.concat("path", "tpath")).otherwise(F.col("path")).alias("path")] if with_path else []),
        )
        state = _cut(state.filter(~live).unionByName(moved))
    ends = state.filter("done").select(
        F.col("ny").alias("_ty"), F.col("nd").alias("_td"), F.col("ac").alias("_ac"), F.col("ad").alias("_ad"),
        F.col("hops").alias("_hops"),
        *([F.col("path").alias("_path")] if with_path else []),
    )
    seed = F.col("year_n1") == anchor_year
    joined = e.join(ends, (~seed) & (e["year_n1"] == ends["_ty"]) & (e["_dn1"] == ends["_td"]), "left")
    return joined.select(
        *[c for c in edges.columns],
        F.when(seed, F.col("code_n1")).otherwise(F.col("_ac")).alias("mapped_2023_code"),
        F.when(seed, F.col("description_n1")).otherwise(F.col("_ad")).alias("mapped_2023_description"),
        F.when(seed, F.lit(1)).when(F.col("_ty").isNotNull(), F.col("_hops") + 1).alias("hops"),
        *([F.when(seed, F.array(_hop())).when(F.col("_ty").isNotNull(), F.concat(F.array(_hop()), "_path")).alias("path")] if with_path else []),
    )


def ambiguous_nodes(edges: DataFrame) -> DataFrame:
    """C2 note: description nodes with out-edges to different targets."""
    e = edges.select(
        "year_n", norm_desc("description_n").alias("desc_n"), "year_n1", norm_desc("description_n1").alias("desc_n1")
    ).filter(F.col("desc_n").isNotNull())
    return (
        e.groupBy("year_n", "desc_n")
        .agg(F.count_distinct("desc_n1").alias("n_targets"), F.count(F.lit(1)).alias("n_rows"))
        .filter(F.col("n_targets") > 1)
    )


# --------------------------------------------------------------------- C1
def chain_by_code(
    edges: DataFrame, anchor_year: int = 2023, with_seed: bool = False, reached: DataFrame | None = None
) -> DataFrame:
    """Walk reverse edges back from every anchor-year row by code.

    Node = ``(year_n1, code_n1)``; only the last row (max ``row_id``) of a
    node is retained.  A row is reached if it is a seed (``year_n1 =
    anchor``) or the retained row of a node that is the source ``(year_n,
    code_n)`` of a reached row; it takes the anchor of the latest seed (max
    ``row_id``) that reaches it.  NULL codes never link.
    The latest seed of every row is closed by doubling the jump pointer.
    ``with_seed`` adds that seed and its target as ``anchor``: ``row_id, code,
    description``.  ``reached`` (``year_n, code_n, anchor``) are rows reached
    already that are not among ``edges``; they hand their anchors on to them.
    """
    rows = edges.select("row_id", "year_n", "code_n", "year_n1", "code_n1", "description_n1")
    retained = (
        rows.filter(F.col("code_n1").isNotNull())
        .groupBy(F.col("year_n1").alias("year_n"), F.col("code_n1").alias("code_n"))
        .agg(F.max("row_id").alias("dst"))
    )
    jump = (
        rows.filter(F.col("code_n").isNotNull())
        .join(retained, ["year_n", "code_n"])
        .select(F.col("row_id").alias("src"), "dst")
    )
    jump = _cut(jump)
    # The jump is single-valued, so seeds that meet on a row stay together and
    # only the latest of them matters: one (row, seed) pair for each row.
    seeds = rows.filter(F.col("year_n1") == anchor_year).select(
        F.col("row_id").alias("seed"), F.struct("row_id", F.col("code_n1").alias("code"), F.col("description_n1").alias("description")).alias("anchor")
    )
    start = seeds.select("seed", F.col("seed").alias("r"))
    if reached is not None:
        handed = reached.filter(F.col("code_n").isNotNull()).join(retained, ["year_n", "code_n"])
        handed = _cut(handed.groupBy("dst").agg(F.max_by("anchor", F.col("anchor.row_id")).alias("anchor")))
        start = start.unionByName(handed.select(F.col("anchor.row_id").alias("seed"), F.col("dst").alias("r")))
        start = start.groupBy("r").agg(F.max("seed").alias("seed")).select("seed", "r")
        # one row for each seed that enters, with its target
        seeds = seeds.unionByName(handed.select(F.col("anchor.row_id").alias("seed"), "anchor"))
        seeds = seeds.groupBy("seed").agg(F.any_value("anchor").alias("anchor"))
    reach = _cut(start)
    # reach holds the latest seed within 2^k jumps of every row; the pointer
    # jumps 2^k rows, so one join reaches twice as far.
    for _ in range(MAX_ROUNDS):
        if jump.isEmpty():
            break
        new = reach.join(jump, reach["r"] == jump["src"]).select("seed", F.col("dst").alias("r"))
        reach = _cut(reach.unionByName(new).groupBy("r").agg(F.max("seed").alias("seed")).select("seed", "r"))
        jump = _cut(
            jump.alias("a")
            .join(jump.alias("b"), F.col("a.dst") == F.col("b.src"))
            .select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        )
    best = reach.join(seeds, "seed").select("r", "anchor")
    out = edges.join(best, edges["row_id"] == best["r"], "left")
    return out.select(
        *edges.columns,
        F.col("anchor.code").alias("mapped_2023_code"),
        F.col("anchor.description").alias("mapped_2023_description"),
        *(["anchor"] if with_seed else []),
    )
