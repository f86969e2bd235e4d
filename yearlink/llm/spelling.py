"""Spelling variant grouping: words one edit apart, by dynamic programming down
a sorted vocabulary.

The vocabulary is sorted and dealt into blocks of neighbouring words.  A block
is scanned for all its queries at once: words that share a prefix share the
rows of the edit matrix up to their longest common prefix, a row is a band of
three cells (one edit), and a range of words whose shared prefix is already
more than one edit away is skipped.  A scan starts below the first letters, so
an edit among those is found in a second vocabulary of reversed words: two
words of seven or more letters that differ by one edit share their first three
letters or their last four.  Queries go only to the blocks whose own common
prefix is within one edit, so words with a very common beginning do not meet
all blocks that hold it.  A block answers with one row for a query (count and
best word), never with pairs.

Defined results: a null or empty text has no words; a null doc_id counts as an
empty string in the typing noise; repeated rows count once each; an empty table
gives no rows; extra columns are not read.  Ties for the largest n go to the
word that is smallest in code-point order.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yearlink.llm import common as C

RUN = "[A-Za-z\\u00C0-\\u00FF]"
LEAST_LETTERS = 7
HEAD, TAIL = 3, 4  # letters shared at the start, or else at the end
BLOCK = 50_000  # words of a block, about
_QUERIES = 8192  # scanned together
_FOUND = "word string, n_near long, best_n long, best string"


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_n: int = 2, noise: int = 31) -> DataFrame:
    """word, n: lower-cased (A-Z) runs of letters with at least seven letters
    and ``least_n`` occurrences.  Of runs whose crc32 with the doc_id is a
    multiple of ``noise`` one letter is deleted first."""
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.expr(f"regexp_extract_all(`{text_col}`, '{RUN}{{{LEAST_LETTERS},}}', 0)")).alias("run"),
    )
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = runs.select("id", F.translate("run", upper, upper.lower()).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    cut = F.expr("concat(left(run, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
    words = hashed.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


class Letters:
    """Words as one buffer, a byte for a letter (code points up to 255)."""

    def __init__(self, words: list[str]):
        self.buf = np.frombuffer("".join(words).encode("latin-1") + b"\0", np.uint8)
        self.size = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def at(self, i: np.ndarray, place) -> np.ndarray:
        """Letter at ``place`` of word ``i``; some letter where it has none."""
        return self.buf[np.clip(self.start[i] + place, 0, len(self.buf) - 1)]

    def heads(self, k: int) -> np.ndarray:
        cols = [self.at(np.arange(len(self.size)), j) for j in range(k)]
        return np.ascontiguousarray(np.stack(cols, 1)).view(f"S{k}").reshape(-1)

    def shared(self) -> np.ndarray:
        """Longest common prefix of each word with the one before it."""
        out = np.full(len(self.size), -1, np.int64)
        alive, depth = np.arange(1, len(self.size)), 0
        while len(alive):
            out[alive] = depth
            more = (self.size[alive] > depth) & (self.size[alive - 1] > depth)
            alive = alive[more & (self.at(alive, depth) == self.at(alive - 1, depth))]
            depth += 1
        return out


def next_row(row, c, query: Letters, q, depth: int):
    """The band of the row ``depth + 1`` from that of ``depth`` for the list
    letter ``c``: cells for query prefixes of depth, depth + 1, depth + 2."""
    a, b, e = row
    size = query.size[q]
    r0 = np.minimum(a + (query.at(q, depth - 1) != c), b + 1)
    r0 = np.where(size >= depth, r0, 2)
    r1 = np.minimum(np.minimum(b + (query.at(q, depth) != c), e + 1), r0 + 1)
    r1 = np.where(size >= depth + 1, r1, 2)
    r2 = np.minimum(e + (query.at(q, depth + 1) != c), r1 + 1)
    r2 = np.where(size >= depth + 2, r2, 2)
    return np.minimum(r0, 2), np.minimum(r1, 2), np.minimum(r2, 2)


def scan(words: Letters, lcp: np.ndarray, query: Letters, share: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) indexes of all pairs that share their first ``share``
    letters and differ by exactly one edit.  ``words`` is sorted."""
    heads = words.heads(share)
    mine = query.heads(share)
    lo, hi = np.searchsorted(heads, mine, "left"), np.searchsorted(heads, mine, "right")
    q = np.flatnonzero(lo < hi)
    lo, hi = lo[q], hi[q]
    row = tuple(np.full(len(q), v, np.int64) for v in (1, 0, 1))
    depth, found = share, []
    while len(q):
        # ranges of the list words by their first depth + 1 letters; a word
        # that ends here is the first range of its parent
        begin = np.flatnonzero(lcp <= depth)
        first, last = np.searchsorted(begin, lo), np.searchsorted(begin, hi)
        times = last - first
        up = np.repeat(np.arange(len(q)), times)
        child = np.arange(len(up)) - np.repeat(np.cumsum(times) - times, times) + first[up]
        head = begin[child]
        tail = np.append(begin, len(lcp))[child + 1]
        q, row = q[up], tuple(r[up] for r in row)
        ends = words.size[head] == depth
        cell = query.size[q] - depth
        far = np.where(cell == -1, row[0], np.where(cell == 0, row[1], np.where(cell == 1, row[2], 2)))
        hit = ends & (far == 1)
        found.append((q[hit], head[hit]))
        go = ~ends
        q, head, tail, row = q[go], head[go], tail[go], tuple(r[go] for r in row)
        row = next_row(row, words.at(head, depth), query, q, depth)
        near = np.minimum(np.minimum(row[0], row[1]), row[2]) <= 1
        q, lo, hi, row = q[near], head[near], tail[near], tuple(r[near] for r in row)
        depth += 1
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _best(words: list[str], n: np.ndarray, queries: list[str], back: bool) -> pa.Table:
    """Near words of the queries among ``words`` (both reversed if ``back``)."""
    order = sorted(range(len(words)), key=words.__getitem__)
    words, n = [words[i] for i in order], n[order]
    plain = [w[::-1] for w in words] if back else words
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=plain.__getitem__)] = np.arange(len(words))
    letters = Letters(words)
    lcp = letters.shared()
    out: dict[str, list] = {"word": [], "n_near": [], "best_n": [], "best": []}
    for i in range(0, len(queries), _QUERIES):
        some = queries[i : i + _QUERIES]
        query = Letters(some)
        q, w = scan(letters, lcp, query, TAIL if back else HEAD)
        if back:  # pairs with the same first letters are those of the other scan
            other = np.zeros(len(q), bool)
            for j in range(1, HEAD + 1):
                other |= query.at(q, query.size[q] - j) != letters.at(w, letters.size[w] - j)
            q, w = q[other], w[other]
        if not len(q):
            continue
        by = np.lexsort((rank[w], -n[w], q))
        q, w = q[by], w[by]
        at = C.group_starts(q)
        out["word"] += [some[k][::-1] if back else some[k] for k in q[at].tolist()]
        out["n_near"] += np.diff(np.append(at, len(q))).tolist()
        out["best_n"] += n[w[at]].tolist()
        out["best"] += [plain[k] for k in w[at].tolist()]
    types = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.table([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))


def may_hold(key: str, prefix: str, share: int) -> bool:
    """Whether a word that begins with ``prefix`` can be within one edit of
    ``key``, which has the same first ``share`` letters."""
    query = Letters([key])
    row, q = tuple(np.array([v]) for v in (1, 0, 1)), np.array([0])
    for depth in range(share, len(prefix)):
        row = next_row(row, ord(prefix[depth]), query, q, depth)
        if min(int(r[0]) for r in row) > 1:
            return False
    return True


def _router(index: list[tuple[int, str, str]], share: int):
    """Deals queries to blocks; ``index`` has (block, first, last) in order."""
    lasts, firsts = [x[2][:share] for x in index], [x[1][:share] for x in index]
    common = []
    for _, first, last in index:
        k = 0
        while k < min(len(first), len(last)) and first[k] == last[k]:
            k += 1
        common.append(first[:k])

    def deal(batches):
        for b in batches:
            keys, where, take = b.column(0).to_pylist(), [], []
            for i, key in enumerate(keys):
                lo, hi = bisect_left(lasts, key[:share]), bisect_right(firsts, key[:share])
                for k in range(lo, hi):
                    if hi - lo == 1 or len(common[k]) <= share or may_hold(key, common[k], share):
                        where.append(index[k][0])
                        take.append(i)
            yield pa.record_batch([pa.array(where, pa.int32()), b.column(0).take(pa.array(take, pa.int64()))], names=["block", "key"])

    return deal


def _near(words: DataFrame, blocks: int, back: bool) -> DataFrame:
    key = F.reverse("word") if back else F.col("word")
    dealt = words.select(key.alias("key"), "n").repartitionByRange(blocks, "key")
    held = C.shared_table(dealt.withColumn("block", F.spark_partition_id()), "vocabulary")
    ends = held.groupBy("block").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    index = sorted((tuple(r) for r in ends.collect()), key=lambda r: r[1])  # a row for each 50,000 words
    routed = held.select("key").mapInArrow(_router(index, TAIL if back else HEAD), "block int, key string")

    def scanned(held: pa.Table, asked: pa.Table) -> pa.Table:
        n = held.column("n").to_numpy()
        return _best(held.column("key").to_pylist(), n, asked.column("key").to_pylist(), back)

    return held.groupBy("block").cogroup(routed.groupBy("block")).applyInArrow(scanned, _FOUND)


def _roots(forms: DataFrame, most_n: int, ratio: int) -> DataFrame:
    """word, root: each step multiplies n by ``ratio`` at least, so the longest
    chain, and with it the number of doublings, follows from the largest n."""
    chain, n = 1, max(2, most_n) // 2
    while n >= ratio:
        chain, n = chain + 1, n // ratio
    reach = C.shared_table(forms.select("word", F.col("form").alias("root")), "forms")
    step = 1
    while step < chain:
        on = reach.select(F.col("word").alias("root"), F.col("root").alias("further"))
        reach = C.shared_table(
            reach.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "forms"
        )
        step *= 2
    return reach


def variant_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = 10) -> DataFrame:
    """Per word: n, the number of near words, its form (the near word of
    largest n, if that is ``ratio`` times its own), the form's n, and the root
    at the end of its forms."""
    C.prepare(docs.sparkSession)
    words = C.shared_table(vocabulary(docs, id_col, text_col), "words")
    size, most = words.agg(F.count("*"), F.max("n")).first()
    blocks = max(1, -(-size // BLOCK))
    found = _near(words, blocks, False).union(_near(words, blocks, True))
    first = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best"))).alias("top")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first)
    better = F.when(-F.col("top.m") >= ratio * F.col("n"), True)
    table = C.shared_table(
        words.join(best, "word", "left").select(
            "word",
            F.when(better, F.col("top.best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(better, -F.col("top.m")).alias("form_n"),
        ),
        "near",
    )
    roots = _roots(table.where("form is not null"), most or 0, ratio)
    out = table.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = """
WITH RECURSIVE bit AS (
    SELECT i, 0 AS k, i AS v FROM range(256) AS r(i)
    UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bit WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bit WHERE k = 8),
run AS (SELECT coalesce(doc_id::VARCHAR, '') AS id,
               translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{00C0}-\\x{00FF}]+')),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
times AS (SELECT id, run, count(*) AS m FROM run WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, m, xor(list_reduce(
               [4294967295] || flatten(list_transform(string_split(id || ':' || run, ''),
                   lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c) - 64]::BIGINT[] END)),
               lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM times, crc),
word AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word,
                sum(m)::BIGINT AS n FROM hashed GROUP BY 1),
vocab AS (SELECT * FROM word WHERE length(word) >= 7 AND n >= 2),
del AS (SELECT word, n, unnest(range(length(word))) AS i, unnest(list_transform(range(length(word)),
               lambda j: left(word, j::INT) || substr(word, j::INT + 2))) AS d FROM vocab),
pair AS (SELECT a.word, b.word AS other, b.n AS m FROM del a JOIN del b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM vocab a JOIN del b ON a.word = b.d
         UNION SELECT a.word, b.word, b.n FROM del a JOIN vocab b ON a.d = b.word),
near AS (SELECT word, count(*) AS n_near, max(m) AS m FROM pair GROUP BY word),
form AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN m END AS form_n,
                CASE WHEN m >= 10 * n THEN (SELECT min(other) FROM pair p WHERE p.word = v.word AND p.m = near.m) END AS form
         FROM vocab v LEFT JOIN near USING (word)),
walk AS (SELECT word, word AS here, 0 AS k FROM form
         UNION ALL SELECT w.word, f.form, k + 1 FROM walk w JOIN form f ON f.word = w.here WHERE f.form IS NOT NULL),
root AS (SELECT word, arg_max(here, k) AS root FROM walk GROUP BY word)
SELECT word, form, root, n::BIGINT AS n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM form JOIN root USING (word)
"""
