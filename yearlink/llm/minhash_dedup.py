"""Operator 6, near-duplicates by SuperMinHash.

1. *Signatures.*  Every element of a document's shingle set walks through its
   own random permutation of the signature slots; in step j it offers j plus
   a random fraction to slot p[j], and each slot keeps the smallest offer.
   The ranks are correlated (every element gives each slot a different j),
   so the estimate varies less than plain MinHash, and an element stops as
   soon as j exceeds the largest whole part left in the signature.  A batch
   of documents runs the steps together in numpy.
2. *Exact copies.*  Documents with the same set (128-bit digest) are one
   class, shown by its smallest doc_id; only classes go on.
3. *Banding.*  ``bands`` bands of ``rows`` slots.  In a bucket every member
   is compared with one head (drawn by a hash of band and id, so that the
   heads of a large group differ from band to band): linear in the bucket.
4. *Verification* on the full sets of shingle hashes (64 bit), linked if
   100 * intersection >= threshold * union.
5. *Union-find grouping* of the links (``components``).
6. A bucket may still hold several components.  All members outside its
   largest one are then compared with all members, in tiles of two blocks and
   only across components, so that no link between different texts of a
   bucket is lost; a tile gives a spanning forest.

At the production setting (32 bands of 5) a pair at the threshold 0.85 is
missed with probability 7e-9, at 0.8 with 3e-6.

Hot groups: exact copies collapse in step 2 with map-side aggregation; the
members of a head are salted into groups of ``GROUP``; tiles are bounded by
``BLOCK``.  Nothing is collected to the driver but one row for each round.

Defined cases: a text without words (or null) has an empty set and is linked
with nothing.  Fewer words than ``shingle`` are one shingle.  Rows without a
doc_id are linked with nothing: component_id is null and they are kept.
Repeated rows share their doc_id and so their component.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yearlink.llm import common as C
from yearlink.llm.common import U64
from yearlink.llm.components import UnionFind, components

GROUP = 256  # members compared with one copy of a head
BLOCK = 256  # members on one side of a tile
ELEMENTS = 200_000  # shingles on one side of a tile, on average
_FRACTION = 44  # bits of the random fraction below the whole part


def shingle_sets(texts, k: int) -> list[np.ndarray]:
    """For each text the sorted different hashes of its shingles."""
    words = C.tokenize(texts, lower=True)
    n_words = np.diff(words.first)
    at, h = words.windows(k)
    doc = words.doc[at]
    for short in range(1, k):
        few, hs = words.windows(short)
        whole = n_words[words.doc[few]] == short
        if whole.any():
            doc, h = np.concatenate((doc, words.doc[few[whole]])), np.concatenate((h, hs[whole]))
    order = np.argsort(doc, kind="stable")
    h, cut = h[order], np.searchsorted(doc[order], np.arange(len(n_words) + 1))
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        s = np.sort(h[a:b])
        out.append(s[C.group_starts(s)])
    return out


def super_minhash(sets: list[np.ndarray], m: int, block: int = 1 << 16) -> np.ndarray:
    """Signatures (len(sets) x m): whole part j above ``_FRACTION`` random bits."""
    sig = np.full((len(sets), m), U64(m) << U64(_FRACTION), U64)
    sizes = np.array([len(s) for s in sets])
    i = 0
    while i < len(sets):
        j = max(i + 1, int(np.searchsorted(np.cumsum(sizes[i:]), block, "right")) + i)
        elems = np.concatenate(sets[i:j]) if j > i + 1 else sets[i]
        doc = np.repeat(np.arange(i, j), sizes[i:j])
        for lo in range(0, len(elems), block):
            _offer(sig, elems[lo : lo + block], doc[lo : lo + block], m)
        i = j
    return sig


def _offer(sig: np.ndarray, elems: np.ndarray, doc: np.ndarray, m: int) -> None:
    flat = sig.reshape(-1)
    perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(elems), 1))
    rows = np.arange(len(elems))
    for j in range(m):
        docs = np.unique(doc[rows])
        largest = np.zeros(len(sig), np.int64)
        largest[docs] = (sig[docs].max(axis=1) >> U64(_FRACTION)).astype(np.int64)
        rows = rows[largest[doc[rows]] >= j]
        if not len(rows):
            return
        x = C.mix(elems[rows] + U64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        k = j + ((x & U64(0xFFFFF)) * U64(m - j) >> U64(20)).astype(np.int64)
        slot = perm[rows, k]
        perm[rows, k] = perm[rows, j]
        np.minimum.at(flat, doc[rows] * m + slot, (U64(j) << U64(_FRACTION)) | (x >> U64(20)))


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    n, m = sig.shape
    parts = sig.reshape(n, m // rows, rows)
    h = np.broadcast_to(np.arange(m // rows, dtype=U64) + U64(1), (n, m // rows))
    for j in range(rows):
        h = C.mix(h + parts[:, :, j])
    return h


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _describe(shingle: int, bands: int, rows: int):
    def run(batches):
        for b in C.slices(batches, "text", rows=1024, size=1 << 20):
            sets = shingle_sets(b.column(1), shingle)
            keys = _signed(band_keys(super_minhash(sets, bands * rows), rows))
            ids = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]
            ids = np.array(ids, np.int64).reshape(-1, 2)
            flat = pa.array(keys.reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), flat)
            size = pa.array([len(s) for s in sets], pa.int64())
            yield pa.record_batch(
                [b.column(0), size, pa.array(ids[:, 0]), pa.array(ids[:, 1]), lists],
                names=["doc_id", "n", "set_a", "set_b", "bands"],
            )

    return run


class _Compared:
    """Sets laid out for comparing any set with many others: elements are
    numbered once, then a comparison is a lookup and a sum for each set."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        self.ends = np.cumsum(self.sizes)
        values, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(values), np.int32)

    def linked(self, i: int, others: slice, threshold: int) -> np.ndarray:
        """Which of the sets in the slice are linked with set ``i``."""
        begin = self.ends - self.sizes
        mine = self.flat[begin[i] : self.ends[i]]
        self.mark[mine] = 1
        first = begin[others][0]
        both = np.add.reduceat(self.mark[self.flat[first : self.ends[others][-1]]], begin[others] - first)
        self.mark[mine] = 0
        return 100 * both >= threshold * (self.sizes[others] + self.sizes[i] - both)


def _check_heads(shingle: int, threshold: int):
    def run(table: pa.Table) -> pa.Table:
        ids, head = table.column("doc_id").to_numpy(), table.column("head")[0].as_py()
        sets = shingle_sets(table.column("text"), shingle)
        mine = [i for i, d in enumerate(ids) if d == head]
        rest = [i for i, d in enumerate(ids) if d != head and len(sets[i])]
        found = np.empty(0, np.int64)
        if mine and rest:
            laid = _Compared([sets[mine[0]], *(sets[i] for i in rest)])
            found = ids[rest][laid.linked(0, slice(1, None), threshold)]
        return pa.table({"a": pa.array(found, pa.int64()), "b": pa.array(np.full(len(found), head), pa.int64())})

    return run


def _check_tile(shingle: int, threshold: int):
    def run(table: pa.Table) -> pa.Table:
        ids, comp = table.column("doc_id").to_pylist(), table.column("comp").to_pylist()
        odd = table.column("odd").to_pylist()
        sets = shingle_sets(table.column("text"), shingle)
        uf, out = UnionFind(), []
        some = [i for i in range(len(ids)) if len(sets[i])]
        left, right = [i for i in some if odd[i]], [i for i in some if not odd[i]]
        if left and right and len(set(comp)) > 1:
            laid = _Compared([sets[i] for i in left + right])
            others = slice(len(left), None)
            for at, i in enumerate(left):
                if all(uf.find(comp[i]) == uf.find(comp[j]) for j in right):
                    continue
                for hit in np.flatnonzero(laid.linked(at, others, threshold)):
                    j = right[hit]
                    if uf.union(comp[i], comp[j]):
                        out.append((ids[i], ids[j]))
        cols = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(cols[:, 0]), "b": pa.array(cols[:, 1])})

    return run


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    threshold: int = 85,
    bands: int = 32,
    rows: int = 5,
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    C.prepare(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n long, set_a long, set_b long, bands array<long>"
    described = C.shared_table(plain.mapInArrow(_describe(shingle, bands, rows), schema), "minhash-sets")
    linkable = described.where("n > 0 and doc_id is not null")

    classes = linkable.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "n", "bands")).alias("r"))
    banded = classes.select("r.doc_id", "r.n", F.explode("r.bands").alias("band"))
    heads = banded.groupBy("band").agg(
        F.min_by("doc_id", F.xxhash64("band", "doc_id")).alias("head"), F.count("*").alias("size")
    )
    members = C.shared_table(banded.join(heads.where("size > 1"), "band"), "minhash-members")
    texts = C.shared_table(plain.join(members.select("doc_id").distinct(), "doc_id", "left_semi"), "minhash-texts")

    pairs = members.where("doc_id <> head").select("doc_id", "head").distinct()
    groups = pairs.groupBy("head").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part")
    rows_in = (
        pairs.join(groups, "head")
        .select("doc_id", "head", part)
        .union(groups.select(F.col("head"), F.col("head"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    )
    found = rows_in.join(texts, "doc_id").groupBy("head", "part").applyInArrow(_check_heads(shingle, threshold), "a long, b long")
    links = C.shared_table(found, "minhash-links")
    first = components(links)

    open_rows = members.where("size > 2").join(first, F.col("doc_id") == F.col("node"), "left").select(
        "band", "doc_id", "n", "size", F.coalesce("component", "doc_id").alias("comp")
    )
    parts = open_rows.groupBy("band", "size", "comp").agg(
        F.count("*").alias("c"), F.sum("n").alias("n"), F.sum(F.xxhash64("doc_id") % (1 << 40)).alias("who")
    )
    mixed = (
        parts.groupBy("band", "size")
        .agg(
            F.count("*").alias("comps"),
            F.max_by("comp", "c").alias("main"),
            F.max("c").alias("c"),
            F.sum("n").alias("n"),
            F.sum("who").alias("who"),
        )
        .where("comps > 1")
        .groupBy("size", "who", "main")
        .agg(F.min("band").alias("band"), F.max("c").alias("c"), F.max("n").alias("n"))
        .withColumn("each", F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(F.lit(ELEMENTS) * F.col("size") / F.col("n")))))
        .select("band", "main", F.ceil(F.col("size") / F.col("each")).cast("int").alias("all_blocks"),
                F.ceil((F.col("size") - F.col("c")) / F.col("each")).cast("int").alias("odd_blocks"))
    )
    placed = open_rows.join(mixed, "band")

    def dealt(rows: DataFrame, own: str, other: str, left: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col(own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        i, j = (mine.alias("i"), every.alias("j")) if left else (every.alias("i"), mine.alias("j"))
        return rows.select("band", "doc_id", "comp", F.lit(left).alias("odd"), i, j)

    tiles = dealt(placed.where("comp <> main"), "odd_blocks", "all_blocks", True).union(
        dealt(placed, "all_blocks", "odd_blocks", False).select("band", "doc_id", "comp", "odd", "i", "j")
    )
    more = tiles.join(texts, "doc_id").groupBy("band", "i", "j").applyInArrow(_check_tile(shingle, threshold), "a long, b long")
    labels = components(links.union(more))

    named = (
        linkable.groupBy("set_a", "set_b")
        .agg(F.min("doc_id").alias("class"))
        .join(labels, F.col("class") == F.col("node"), "left")
        .select("set_a", "set_b", F.coalesce("component", "class").alias("component_id"))
    )
    grouped = linkable.join(named, ["set_a", "set_b"], "left").select("doc_id", "n", "component_id")
    alone = described.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return grouped.union(alone).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its group, all
    columns as they were."""
    gone = near_duplicates(docs, id_col, text_col, **how).where("not kept").select("doc_id").distinct()
    return C.without(docs, gone, id_col)


SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda j: list_slice(w, j, j + 2))
                                        WHEN len(w) > 0 THEN [w] ELSE [] END) AS e FROM d),
x AS (SELECT doc_id, unnest(e) AS e FROM s WHERE doc_id IS NOT NULL),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b
         WHERE 100 * n >= 85 * (len(p.e) + len(q.e) - n)),
way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM way UNION SELECT r.a, w.b FROM reach r JOIN way w ON w.a = r.b),
label AS (SELECT a AS doc_id, min(b) AS component FROM reach GROUP BY a)
SELECT doc_id, len(e)::BIGINT AS n_shingles, least(doc_id, component) AS component_id,
       coalesce(doc_id = least(doc_id, component), true) AS kept
FROM s LEFT JOIN label USING (doc_id)
"""  # for tables whose rows differ in doc_id
