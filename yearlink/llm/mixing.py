"""Operator 5, mixing sources to target weights (DataFrame operations only).

1. *Temperature.*  A source with the token share p gets the weight p^t / sum.
   t = 1 keeps the shares, t = 0 makes all sources equal; in between, entropy
   falls and the number of times the smallest source repeats falls as t rises.
   The exponent is found on a grid of 2^-24 by bisection, six halvings in one
   aggregation over the table of sources (63 trial exponents at once, four
   rounds): the largest t whose entropy is at least ``entropy`` times that of
   equal weights, or, if some source would then repeat more than ``repeats``
   times, the smallest t that repeats no source more often.
2. *Budget.*  A source's quota is its weight times the token budget (the
   tokens of the table by default), in whole passes over the source and a
   rest.
3. *Block permutations.*  A source is dealt into blocks of about
   ``block_tokens`` tokens by a hash of the doc_id.  Every pass orders the
   blocks, and the documents of a block, by hashes of the seed, the pass and
   the block or document.  The last pass stops where the rest is used up: the
   blocks before that point go in whole, the block at it up to the last
   document that still fits.

A hot source is only many blocks: documents are sorted inside a block, and
just one number for each block is summed up along a source.  The driver sees
63 numbers in each round of the search.  Texts are read once, to count words.

Defined cases: a null source is a source of its own.  A null text has no
tokens; documents without tokens ride along in their block.  A source without
tokens gets nothing.  Null ids share one block and sort first.  Repeated rows
are separate rows: each is used as often as its source asks for.  An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yearlink.llm import common as C

ENTROPY, REPEATS, BLOCK_TOKENS, SEED = 0.95, 4.0, 100_000, 17
GRID = 1 << 24
_ROUND = 64


def _hash(*parts) -> Column:
    """A 60-bit hash of the parts, the same in any SQL engine with md5."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("none")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def count_tokens(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(C.WORD_RE)), F.lit(0)).cast("long")


def _largest(shares: DataFrame, holds: Column) -> int | None:
    """Largest grid point at which ``holds``; it holds up to some point and
    not beyond.  ``shares`` has a row for each source with its share p."""
    if not shares.select(F.lit(1)).head(1):
        return None
    lo, step = 0, GRID  # the point is in [lo, lo + step]
    while step > 1:
        step //= _ROUND
        trial = F.explode(F.sequence(F.lit(lo), F.lit(min(lo + _ROUND * step, GRID)), F.lit(step))).alias("k")
        power = F.pow("p", F.col("k") / GRID)
        sums = shares.select("*", trial).groupBy("k").agg(
            F.sum(power).alias("z"),
            F.sum(power * F.log("p")).alias("zl"),
            F.max(F.col("worth") * F.pow("p", F.col("k") / GRID - 1)).alias("most"),
            F.count("*").alias("n"),
        )
        found = sums.where(holds).agg(F.max("k")).first()[0]
        if found is None:
            return None
        lo = int(found)
        if lo == GRID:
            break
    return lo


def exponent(sources: DataFrame, budget: int, entropy: float = ENTROPY, repeats: float = REPEATS) -> float:
    """The temperature exponent for a table of sources (``tokens``)."""
    positive = sources.where("tokens > 0")
    total = positive.agg(F.sum("tokens")).first()[0] or 1
    shares = positive.select((F.col("tokens") / F.lit(total)).alias("p"), F.lit(float(budget) / total).alias("worth"))
    t = F.col("k") / GRID
    high = F.log("z") - t * F.col("zl") / F.col("z") >= entropy * F.log("n") - 1e-12
    even = _largest(shares, high)
    even = 0 if even is None else even
    too_often = F.col("most") / F.col("z") > repeats  # the smallest source repeats most
    limit = _largest(shares, too_often)
    limit = 0 if limit is None else min(limit + 1, GRID)
    return max(even, limit) / GRID


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    budget: int | None = None,
    entropy: float = ENTROPY,
    repeats: float = REPEATS,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = SEED,
) -> DataFrame:
    """One row for each use of a document: doc_id, source, n_tokens, epoch
    (pass over the source, from 0), block_rank (place of its block in the
    pass), place (in its block, from 1), weight (of its source)."""
    C.prepare(docs.sparkSession)
    light = C.shared_table(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("none")).alias("key"),
            count_tokens(text_col).alias("n_tokens"),
        ),
        "mixing-tokens",
    )
    sources = C.shared_table(light.groupBy("key").agg(F.sum("n_tokens").alias("tokens")), "mixing-sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    t = exponent(sources, budget, entropy, repeats)
    z = sources.where("tokens > 0").agg(F.sum(F.pow(F.col("tokens") / F.lit(max(total, 1)), F.lit(t)))).first()[0] or 1.0
    weight = F.round(F.pow(F.col("tokens") / F.lit(max(total, 1)), F.lit(t)) / F.lit(z), 9)
    quota = F.floor(F.col("weight") * F.lit(float(budget)) + 0.5).cast("long")
    plan = (
        sources.where("tokens > 0")
        .withColumn("weight", weight)
        .withColumn("quota", quota)
        .select(
            "key",
            "weight",
            F.expr("quota div tokens").cast("int").alias("passes"),
            F.expr("quota % tokens").alias("rest"),
            F.expr(f"(tokens + {block_tokens - 1}) div {block_tokens}").alias("blocks"),
        )
    )
    dealt = light.join(plan, "key").withColumn("block", F.pmod(_hash(F.lit(seed), F.col("doc_id")), F.col("blocks")))

    block_rank = _hash(F.lit(seed), F.col("key"), F.col("epoch"), F.col("block"))
    along = Window.partitionBy("key", "epoch").orderBy(block_rank, "block")
    blocks = dealt.groupBy("key", "block", "passes").agg(F.sum("n_tokens").alias("tokens"))
    blocks = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes")))).select(
        "key",
        "block",
        "epoch",
        F.row_number().over(along).alias("block_rank"),
        (F.sum("tokens").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")).alias("before"),
    )
    uses = dealt.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes")))).join(blocks, ["key", "block", "epoch"])
    inside = Window.partitionBy("key", "block", "epoch").orderBy(
        _hash(F.lit(seed), F.col("epoch"), F.col("doc_id")), "doc_id", "n_tokens"
    )
    used = F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        uses.select("*", F.row_number().over(inside).alias("place"), (F.col("before") + used).alias("used"))
        .where("epoch < passes or used <= rest")
        .select("doc_id", "source", "n_tokens", "epoch", "block_rank", "place", "weight")
    )


def _h(*parts: str) -> str:
    text = " || ':' || ".join(f"coalesce({p}::VARCHAR, 'none')" for p in parts)
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


SQL = f"""
WITH RECURSIVE light AS (
  SELECT doc_id, source, coalesce('=' || source, 'none') AS key,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens
  FROM documents),
sources AS (SELECT key, sum(n_tokens)::BIGINT AS tokens FROM light GROUP BY key HAVING sum(n_tokens) > 0),
total AS (SELECT sum(tokens)::BIGINT AS total FROM sources),
p AS (SELECT list(tokens / total::DOUBLE) AS p FROM sources, total),
-- 24 halvings for each of the two conditions
even(i, lo, hi) AS (
  SELECT 0, 0::BIGINT, {GRID + 1}::BIGINT
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, mid, ln(z) - mid / {GRID}.0::DOUBLE * zl / z >= {ENTROPY} * ln(n) - 1e-12 AS ok FROM (
      SELECT i, lo, hi, (lo + hi) // 2 AS mid, len(p) AS n,
             list_sum(list_transform(p, lambda x: pow(x, ((lo + hi) // 2) / {GRID}.0::DOUBLE))) AS z,
             list_sum(list_transform(p, lambda x: pow(x, ((lo + hi) // 2) / {GRID}.0::DOUBLE) * ln(x))) AS zl
      FROM even, p WHERE hi - lo > 1))),
often(i, lo, hi) AS (
  SELECT 0, -1::BIGINT, {GRID + 1}::BIGINT
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, (lo + hi) // 2 AS mid,
           list_max(list_transform(p, lambda x: pow(x, ((lo + hi) // 2) / {GRID}.0::DOUBLE - 1)))
           / list_sum(list_transform(p, lambda x: pow(x, ((lo + hi) // 2) / {GRID}.0::DOUBLE))) > {REPEATS} AS ok
    FROM often, p WHERE hi - lo > 1)),
t AS (SELECT greatest((SELECT max(lo) FROM even), least((SELECT max(lo) FROM often) + 1, {GRID})) / {GRID}.0::DOUBLE AS t),
weighted AS (
  SELECT key, tokens, round(pow(tokens / total::DOUBLE, t) / sum(pow(tokens / total::DOUBLE, t)) OVER (), 9) AS weight, total
  FROM sources, total, t),
plan AS (
  SELECT key, weight, floor(weight * total + 0.5)::BIGINT // tokens AS passes, floor(weight * total + 0.5)::BIGINT % tokens AS rest,
         (tokens + {BLOCK_TOKENS - 1}) // {BLOCK_TOKENS} AS blocks
  FROM weighted),
dealt AS (SELECT light.*, weight, passes, rest, {_h(str(SEED), 'doc_id')} % blocks AS block FROM light JOIN plan USING (key)),
uses AS (SELECT *, unnest(range(0, passes + 1)) AS epoch FROM dealt),
sums AS (SELECT key, epoch, block, sum(n_tokens) AS tokens, {_h(str(SEED), 'key', 'epoch', 'block')} AS h FROM uses GROUP BY key, epoch, block),
ranked AS (
  SELECT key, epoch, block, row_number() OVER w AS block_rank, sum(tokens) OVER w - tokens AS before FROM sums
  WINDOW w AS (PARTITION BY key, epoch ORDER BY h, block ROWS UNBOUNDED PRECEDING)),
placed AS (
  SELECT *, row_number() OVER w AS place, before + sum(n_tokens) OVER w AS used
  FROM (SELECT uses.*, block_rank, before, {_h(str(SEED), 'epoch', 'doc_id')} AS h FROM uses JOIN ranked USING (key, epoch, block))
  WINDOW w AS (PARTITION BY key, epoch, block ORDER BY h, doc_id, n_tokens ROWS UNBOUNDED PRECEDING))
SELECT doc_id, source, n_tokens, epoch::INTEGER AS epoch, block_rank::INTEGER AS block_rank, place::INTEGER AS place, weight
FROM placed WHERE epoch < passes OR used <= rest
"""
