"""Operator 8, language-model scoring from a log-frequency Bloom filter.

Counts.  Every batch of training documents gives its different words and
word pairs with their counts, packed by hash range; the owner of a range adds
them up.  All words and pairs of all training documents are counted.

Filter.  A count becomes a level: 1 to 4 as they are, then steps of a factor
``STEP``.  An n-gram of level q is put into one Bloom filter q times, as
(n-gram, 1) to (n-gram, q); reading it back probes (n-gram, 1), (n-gram, 2),
... until one is missing.  The filter grows with the corpus: ``BITS_EACH`` bits
an entry, ``bits`` at least, and all n-grams go in, those seen once too.  It is
never in one place: the owner of a hash range fills and probes the segments of
its range.

Lookup.  Documents are dealt into chunks; every chunk asks the owners for its
different words and pairs.  The answers (levels, and exact counts of the words)
meet the chunk again and become the levels of each document's tokens, which
are stored.  Weights and scores are then computed from the levels alone.
Nothing of vocabulary size is broadcast or goes through the driver.

Probability.  P(w | v) = (1 - a) P1(w) + a c(vw) / c(v) with
P1(w) = (c(w) + 1) / (N + V + 1), all counts as probed.  The weight a depends
on the level of c(v) and on whether the pair before was found.  It is the
maximum-likelihood weight (EM) for all training tokens with their own
occurrence taken out of the counts; EM sees a histogram of the ratio of the
two estimates, a few hundred numbers.

Base score.  From the exact counts of all words.

Defined cases: a null or empty text has one token, its end.  Rows without a
doc_id never teach; held_out is null for them.  Without training documents N
and V are 0 and every token has the base score 0.  Repeated rows are counted
as often as they are there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yearlink.llm import common as C
from yearlink.llm.common import CHUNK, U64

BITS = 1 << 27  # least size of the filter
BITS_EACH = 11  # bits of the filter for an entry
PROBES = 6
STEP = 1.25
SEGMENTS = 256  # parts of the filter, by the n-gram's hash
PAIR_BITS = 48  # of a pair's hash
LEVELS = 128
END = C.mix(np.array([2], U64))[0]
PIECE = 1 << 20  # keys probed, or tokens scored, at once
_COUNTS = "bucket int, kind int, keys binary, counts binary, stats array<long>"


def level(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: exact to 4, then logarithmic."""
    c = np.maximum(counts, 1).astype(float)
    high = 4 + np.floor(np.log(np.maximum(c / 4, 1)) / np.log(STEP) + 1e-9)
    return np.minimum(np.where(counts <= 4, counts, high), LEVELS - 1).astype(np.int64)


def decoded() -> np.ndarray:
    """The count a level stands for: the middle of its range."""
    q = np.arange(LEVELS, dtype=float)
    return np.where(q <= 4, q, 4 * STEP ** (q - 4) * (1 + STEP) / 2)


def tokens(words: C.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes (an end after each text), their texts, and pair hashes
    (each token with the one before; the end stands before the first)."""
    n = len(words.first) - 1
    at = words.first[1:] + np.arange(n)
    token = np.empty(len(words.hash) + n, U64)
    is_end = np.zeros(len(token), bool)
    is_end[at] = True
    token[is_end] = END
    token[~is_end] = words.hash
    doc = np.repeat(np.arange(n), np.diff(words.first) + 1)
    before = np.concatenate((np.array([END], U64), token[:-1]))
    return token, doc, C.mix(before * C._STEP + token) >> U64(64 - PAIR_BITS)


def _uniques(values: np.ndarray):
    """Different values ascending, how often each, and their places."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    starts = C.group_starts(v)
    counts = np.diff(np.append(starts, len(v)))
    place = np.empty(len(v), np.int64)
    place[order] = np.repeat(np.arange(len(starts)), counts)
    return v[starts], counts, place


def _count(buckets: int):
    def run(batches):
        for b in C.slices(batches, "text"):
            token, _, pair = tokens(C.tokenize(b.column(0), lower=True))
            out = []
            for kind, values, bits in ((1, token, 64), (2, pair, PAIR_BITS)):
                keys, counts, _ = _uniques(values)
                cut = C.bounds(keys, buckets, bits)
                for k in np.flatnonzero(np.diff(cut)):
                    s = slice(cut[k], cut[k + 1])
                    out.append((int(k), kind, C.pack_sorted(keys[s]), C.pack(counts[s].astype(U64)), None))
            yield _rows(out)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    return pa.record_batch(
        [pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["bucket", "kind", "keys", "counts", "stats"]
    )


def _add_up(batches):
    """Owner of a hash range: the sums of its words and pairs.  stats: tokens,
    then the number of n-grams by level."""
    parts: dict[int, list] = {1: [], 2: []}
    bucket = None
    for b in batches:
        bucket = b.column(0)[0].as_py() if b.num_rows else bucket
        for kind, keys, counts in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            parts[kind].append((C.unpack_sorted(keys), C.unpack(counts)))
    out = []
    for kind, found in parts.items():
        if not found:
            continue
        keys, counts = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        found.clear()
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order].astype(np.int64)
        starts = C.group_starts(keys)
        keys, counts = keys[starts], np.add.reduceat(counts, starts)
        stats = [int(counts.sum()), *np.bincount(level(counts), minlength=LEVELS).tolist()]
        out.append((bucket, kind, C.pack_sorted(keys), C.pack(counts.astype(U64)), stats))
    yield _rows(out)


def cutoffs(by_level: dict[int, np.ndarray], capacity: int) -> dict[int, int]:
    """Lowest level of each order that goes into a filter of that many entries.
    For a filter of a given size only; ``scored`` sizes its filter to hold all."""
    cut = {1: 1, 2: 2}

    def entries(k):
        q = np.arange(LEVELS)
        return int((by_level[k] * q)[cut[k] :].sum())

    while sum(entries(k) for k in cut) > capacity:
        k = max(cut, key=entries)
        cut[k] += 1
    return cut


class BloomFilter:
    """``BITS`` bits in ``SEGMENTS`` parts; the hash of an n-gram names its part."""

    def __init__(self, data: np.ndarray | None = None, bits: int = BITS):
        self.part = bits // SEGMENTS
        self.data = np.zeros(bits // 8, np.uint8) if data is None else data

    def _places(self, keys: np.ndarray, q: np.ndarray, probe: int) -> np.ndarray:
        inside = keys & U64((1 << 56) - 1)
        h = C.mix(inside + (q.astype(U64) * U64(PROBES) + U64(probe + 1)) * U64(0x9E3779B97F4A7C15))
        return ((keys >> U64(56)) * U64(self.part) + (h % U64(self.part))).astype(np.int64)

    def insert(self, keys: np.ndarray, levels: np.ndarray) -> None:
        keys = np.repeat(keys, levels)
        q = np.arange(len(keys)) - np.repeat(np.cumsum(levels) - levels, levels) + 1
        for probe in range(PROBES):
            at = self._places(keys, q, probe)
            np.bitwise_or.at(self.data, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels of the n-grams by repeated membership probes; 0 if absent."""
        out = np.zeros(len(keys), np.int64)
        alive = np.arange(len(keys))
        for q in range(1, LEVELS):
            for probe in range(PROBES):
                at = self._places(keys[alive], np.array([q]), probe)
                alive = alive[(self.data[at >> 3] >> (at & 7)) & 1 == 1]
            if not len(alive):
                break
            out[alive] = q
        return out


def filter_key(kind: int, keys: np.ndarray) -> np.ndarray:
    """Key of an n-gram in the filter; keeps the order of hash ranges."""
    if kind == 1:
        return keys
    keys = keys << U64(64 - PAIR_BITS)
    return keys | (C.mix(keys + U64(2)) & U64((1 << (64 - PAIR_BITS)) - 1))


def _fill(cut: dict[int, int], bits: int):
    """Parts of the filter from the counts of one task's hash ranges."""

    def run(batches):
        for b in batches:
            for kind, keys, counts in zip(*(b.column(i).to_pylist() for i in (0, 1, 2)), strict=True):
                keys, q = filter_key(kind, C.unpack_sorted(keys)), level(C.unpack(counts).astype(np.int64))
                keys, q = keys[q >= cut[kind]], q[q >= cut[kind]]
                part = keys >> U64(56)
                for s in np.unique(part):
                    mine = part == s
                    f = BloomFilter(np.zeros(bits // 8 // SEGMENTS, np.uint8), bits)
                    inside, mine_q = keys[mine] & U64((1 << 56) - 1), q[mine]
                    for i in range(0, len(inside), PIECE // 8):
                        f.insert(inside[i : i + PIECE // 8], mine_q[i : i + PIECE // 8])
                    yield pa.record_batch(
                        [pa.array([int(s)], pa.int32()), pa.array([f.data.tobytes()])], names=["part", "data"]
                    )

    return run


class Owned:
    """The segments of the filter for one hash range, out of ``buckets``."""

    def __init__(self, bucket: int, buckets: int, bits: int):
        self.low = (bucket << 64) // buckets >> 56
        high = min(((bucket + 1) << 64) // buckets >> 56, SEGMENTS - 1)
        self.size = bits // 8 // SEGMENTS
        self.filter = BloomFilter(np.zeros((high - self.low + 1) * self.size, np.uint8), bits)
        self._put = _fill({1: 1, 2: 1}, bits)

    def insert(self, known: pa.RecordBatch) -> None:
        for b in self._put(iter([known])):
            at = (b.column(0)[0].as_py() - self.low) * self.size
            self.filter.data[at : at + self.size] |= np.frombuffer(b.column(1)[0].as_py(), np.uint8)

    def levels(self, kind: int, keys: np.ndarray) -> np.ndarray:
        return self.filter.levels(filter_key(kind, keys) - U64(self.low << 56))


class Model:
    """N, V and the weights of the pair estimate."""

    CLASSES = 16
    BINS = 160

    def __init__(self, n: int, v: int):
        self.n, self.v = n, v
        self.weights = np.full(2 * self.CLASSES, 0.1)

    def estimates(self, q1: np.ndarray, q2: np.ndarray, sizes: np.ndarray, own: int):
        """P1, pair estimate and weight class of each token, from the levels of
        the words and pairs of documents with so many tokens; ``own`` is 1 to
        take the token's own occurrence out of the counts."""
        worth = decoded()
        last = np.cumsum(sizes) - 1
        start = last + 1 - sizes
        qv = np.concatenate(([0], q1[:-1]))
        qv[start] = q1[last]  # the end stands before the first token
        c1, c2, cv = np.maximum(worth[q1] - own, 0), np.maximum(worth[q2] - own, 0), np.maximum(worth[qv] - own, 1)
        found = c2 > 0
        found_before = np.concatenate(([False], found[:-1]))
        found_before[start] = False
        p1 = (c1 + 1) / (self.n + self.v + 1)
        p2 = np.minimum(c2 / cv, 1.0)
        return p1, p2, found_before * self.CLASSES + np.minimum(qv // 3, self.CLASSES - 1)

    def histogram(self, q1, q2, sizes) -> np.ndarray:
        """Number of tokens by weight class and by the ratio of the estimates."""
        p1, p2, k = self.estimates(q1, q2, sizes, own=1)
        ratio = np.where(p2 > 0, np.clip(4 * np.log2(np.maximum(p2, 1e-300) / p1) + 40, 1, self.BINS - 1), 0)
        return np.bincount(k * self.BINS + ratio.astype(np.int64), minlength=2 * self.CLASSES * self.BINS)

    def fit_weights(self, histogram: np.ndarray) -> None:
        counts = histogram.reshape(2 * self.CLASSES, self.BINS).astype(float)
        ratio = 2.0 ** ((np.arange(self.BINS) + 0.5 - 40) / 4)
        ratio[0] = 0
        a = np.full(len(counts), 0.3)
        counts[:, 0] += 1  # one token that the pair did not foretell
        for _ in range(100):
            share = a[:, None] * ratio / ((1 - a[:, None]) + a[:, None] * ratio)
            a = (counts * share).sum(axis=1) / counts.sum(axis=1)
        self.weights = np.clip(a, 1e-4, 0.95)

    def scores(self, q1, q2, sizes) -> np.ndarray:
        p1, p2, k = self.estimates(q1, q2, sizes, own=0)
        a = self.weights[k]
        return np.bincount(np.repeat(np.arange(len(sizes)), sizes), np.log10((1 - a) * p1 + a * p2), minlength=len(sizes))


def counted(texts: DataFrame, bits: int = BITS) -> tuple[DataFrame, int, int, int]:
    """Table of the counts of ``texts`` (column text), N, V and the bits of a
    filter with room for all n-grams."""
    n = C.partitions(texts.sparkSession)
    sums = texts.mapInArrow(_count(n), _COUNTS).repartitionById(n, F.col("bucket")).mapInArrow(_add_up, _COUNTS)
    counts = C.shared_table(sums, "lm-counts")
    by_level, total = {1: np.zeros(LEVELS, np.int64), 2: np.zeros(LEVELS, np.int64)}, 0
    sums = counts.select("kind", F.posexplode("stats").alias("at", "x")).groupBy("kind", "at").agg(F.sum("x").alias("x"))
    for r in sums.collect():  # two rows of LEVELS numbers
        if r["at"]:
            by_level[r["kind"]][r["at"] - 1] = r["x"]
        elif r["kind"] == 1:
            total = r["x"]
    return counts, total, int(by_level[1].sum()), filter_bits(by_level, bits)


def filter_bits(by_level: dict[int, np.ndarray], least: int) -> int:
    """Bits of a filter that holds every level of every n-gram, in whole bytes
    for each segment."""
    entries = sum(int((x * np.arange(LEVELS)).sum()) for x in by_level.values())
    return -(-max(least, BITS_EACH * entries) // (8 * SEGMENTS)) * 8 * SEGMENTS


def _ask(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        token, _, pair = tokens(C.tokenize(table.column("text"), lower=True))
        chunk = table.column(CHUNK)[0].as_py()
        lines = [[chunk, k, None, None, None] for k in range(buckets)]
        for kind, values, bits in ((1, token, 64), (2, pair, PAIR_BITS)):
            keys = np.unique(values)
            cut = C.bounds(keys, buckets, bits)
            for k in np.flatnonzero(np.diff(cut)):
                lines[k][1 + kind] = C.pack_sorted(keys[cut[k] : cut[k + 1]])
        cols = zip(*(x for x in lines if x[2] or x[3]), strict=True)
        return pa.table([pa.array(c, t) for c, t in zip(cols, _LINES.values(), strict=True)], names=list(_LINES))

    return run


# a chunk's words and pairs of a hash range, or (with counts) one of the two as known
_LINES = {CHUNK: pa.int32(), "bucket": pa.int32(), "words": pa.binary(), "pairs": pa.binary(), "counts": pa.binary()}


def _answer(buckets: int, bits: int):
    """Owner of a hash range: for every asking chunk the levels of its words
    and pairs, and the counts of its words."""

    def run(batches):
        vocabulary, known, asked, bucket = (np.empty(0, U64), np.empty(0, np.int64)), [], [], None
        for b in batches:
            for chunk, bucket, words, pairs, counts in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if chunk >= 0:
                    asked.append((chunk, words, pairs))
                    continue
                known.append((2 if words is None else 1, pairs if words is None else words, counts))
                if words is not None:
                    vocabulary = C.unpack_sorted(words), C.unpack(counts).astype(np.int64)
        if bucket is None:
            return
        mine = Owned(bucket, buckets, bits)
        while known:
            kind, keys, counts = known.pop()
            mine.insert(
                pa.record_batch([pa.array([kind], pa.int32()), pa.array([keys]), pa.array([counts])], names=["kind", "keys", "counts"])
            )
        some, size = [], 0
        for i, (chunk, *both) in enumerate(asked):
            some.append((chunk, *(np.empty(0, U64) if x is None else C.unpack_sorted(x) for x in both)))
            size += len(some[-1][1]) + len(some[-1][2])
            if size < PIECE and i + 1 < len(asked):
                continue
            out = [pa.array([x[0] for x in some], pa.int32()), pa.array([bucket] * len(some), pa.int32())]
            for kind in (1, 2):  # what several chunks ask for is probed once
                keys, _, place = _uniques(np.concatenate([x[kind] for x in some]))
                end = np.cumsum([len(x[kind]) for x in some])[:-1]
                out.append(pa.array([C.pack(x) for x in np.split(mine.levels(kind, keys)[place], end)], pa.binary()))
                if kind == 1:
                    counts = np.zeros(len(keys), np.int64)
                    if len(vocabulary[0]):
                        at = np.minimum(np.searchsorted(vocabulary[0], keys), len(vocabulary[0]) - 1)
                        counts = np.where(vocabulary[0][at] == keys, vocabulary[1][at], 0)
                    exact = pa.array([C.pack(x) for x in np.split(counts[place], end)], pa.binary())
            yield pa.record_batch([*out, exact], names=[CHUNK, "bucket", "words", "pairs", "counts"])
            some, size = [], 0

    return run


def _pack_levels(q1: np.ndarray, q2: np.ndarray) -> bytes:
    return C._codec()[0].compress(np.concatenate((q1, q2)).astype(np.uint8).tobytes())


def _unpack_levels(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levels of words and of pairs, and the number of tokens of each document."""
    parts = [np.frombuffer(C._codec()[1].decompress(x), np.uint8) for x in data]
    q1 = np.concatenate([p[: len(p) // 2] for p in parts]).astype(np.int64)
    q2 = np.concatenate([p[len(p) // 2 :] for p in parts]).astype(np.int64)
    return q1, q2, np.array([len(p) // 2 for p in parts], np.int64)


def _pieces(batches):
    """Batches cut so that each holds at most ``PIECE`` tokens, or one row."""
    for b in batches:
        ends = np.cumsum(b.column(b.schema.get_field_index("n_tokens")).to_numpy())
        i = 0
        while i < b.num_rows:
            before = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, before + PIECE, "right")))
            yield b.slice(i, j - i)
            i = j


def scored(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, bits: int = BITS
) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10 probabilities)."""
    spark = docs.sparkSession
    C.prepare(spark)
    n = C.partitions(spark)
    plain = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        (C.crc_mod(id_col, folds) == held).alias("held_out"),
    )
    counts, total, distinct, bits = counted(plain.where("not held_out").select("text"), bits)

    def levels(key, d: pa.Table, a: pa.Table) -> pa.Table:
        if not d.num_rows:
            return pa.table({k: pa.array([], t) for k, t in _LOOKED_UP.items()})
        token, doc, pair = tokens(C.tokenize(d.column("text"), lower=True))
        answers = list(zip(*(a.column(k).to_pylist() for k in ("bucket", "words", "pairs", "counts")), strict=True))
        q = {}
        for kind, values, width in ((1, token, 64), (2, pair, PAIR_BITS)):
            keys, _, place = _uniques(values)
            cut = C.bounds(keys, n, width)
            found, c = np.zeros(len(keys), np.int64), np.zeros(len(keys))
            for bucket, *packed, exact in answers:
                found[cut[bucket] : cut[bucket + 1]] = C.unpack(packed[kind - 1]).astype(np.int64)
                if kind == 1:
                    c[cut[bucket] : cut[bucket + 1]] = C.unpack(exact).astype(np.int64)
            q[kind] = found[place]
            if kind == 1:
                c1 = c[place]
        sizes = np.bincount(doc, minlength=d.num_rows)
        ends = np.cumsum(sizes)
        return pa.table(
            {
                "doc_id": d.column("doc_id"),
                "held_out": d.column("held_out"),
                "n_tokens": pa.array(sizes),
                "n_known": pa.array(np.bincount(doc[c1 > 0], minlength=d.num_rows)),
                "base_score": pa.array(np.bincount(doc, np.log10((c1 + 1) / (total + distinct + 1)), minlength=d.num_rows)),
                "levels": pa.array(
                    [_pack_levels(q[1][e - s : e], q[2][e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)], pa.binary()
                ),
            }
        )

    # both uses of ``dealt`` read all its columns, so that it is dealt out once
    dealt = C.chunked(plain, "doc_id", "text")
    lines = f"{CHUNK} int, bucket int, words binary, pairs binary, counts binary"
    asked = dealt.groupBy(CHUNK).applyInArrow(_ask(n), lines)
    words, pairs = (F.when(F.col("kind") == k, F.col("keys")).alias(name) for k, name in ((1, "words"), (2, "pairs")))
    known = counts.select(F.lit(-1).alias(CHUNK), "bucket", words, pairs, "counts")
    answers = asked.union(known).repartitionById(n, F.col("bucket"))
    answers = answers.mapInArrow(_answer(n, bits), lines)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, levels binary"
    looked_up = C.shared_table(dealt.groupBy(CHUNK).cogroup(answers.groupBy(CHUNK)).applyInArrow(levels, schema), "lm-levels")
    model = Model(total, distinct)

    def histogram(batches):
        seen = np.zeros(2 * Model.CLASSES * Model.BINS, np.int64)
        for b in _pieces(batches):
            seen += model.histogram(*_unpack_levels(b.column(1).to_pylist()))
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(at), pa.array(seen[at])], names=["at", "x"])

    taught = looked_up.where("not held_out").select("n_tokens", "levels")
    seen = np.zeros(2 * Model.CLASSES * Model.BINS)
    for r in taught.mapInArrow(histogram, "at long, x long").groupBy("at").agg(F.sum("x").alias("x")).collect():
        seen[r["at"]] = r["x"]
    model.fit_weights(seen)

    def score(batches):
        for b in _pieces(batches):
            scores = model.scores(*_unpack_levels(b.column(5).to_pylist()))
            made = [*b.columns[:4], pa.array(np.full(b.num_rows, total, np.int64)), b.column(4), pa.array(scores)]
            yield pa.record_batch(made, names=list(_SCORED))

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return looked_up.mapInArrow(score, schema)


_LOOKED_UP = {
    "doc_id": pa.int64(),
    "held_out": pa.bool_(),
    "n_tokens": pa.int64(),
    "n_known": pa.int64(),
    "base_score": pa.float64(),
    "levels": pa.binary(),
}
_SCORED = {
    "doc_id": pa.int64(),
    "held_out": pa.bool_(),
    "n_tokens": pa.int64(),
    "n_known": pa.int64(),
    "train_tokens": pa.int64(),
    "base_score": pa.float64(),
    "score": pa.float64(),
}
