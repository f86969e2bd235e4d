"""Phrase collocation mining: mergeable Misra-Gries summaries per hash
partition find the frequent n-grams, a second pass counts them exactly.

1. Texts are dealt into chunks.  A chunk sends its n-grams (one to ``LONGEST``
   words inside a piece, hashed with the language) and their counts as one
   packed run to each hash partition.
2. The owner of a partition adds up the mass N of its runs and merges them in a
   Misra-Gries summary of N // threshold counters.  Each merge subtracts the
   largest count that has no place from all counters, so what an n-gram lost is
   at most N / (capacity + 1), less than the threshold: every n-gram that
   occurs ``threshold`` times keeps a counter.  Those whose counter plus the
   amount subtracted stays below the threshold go.  The owner tells each chunk
   which of its n-grams survive, a bit for each.
3. A chunk counts the survivors in its texts again and sends phrase texts with
   counts; their sums are exact (hashes only choose what is counted; inside a
   chunk of 4 MB equal 64-bit hashes count as equal phrases).

Hashes have 16 bits more than the table has bytes, so their runs stay short at
any size; two n-grams with one hash only survive together.  Chunks and
partitions both follow the size of the table.

Defined results: a null text is empty, a null language is ``und``; repeated
rows count once each and are folded before the shuffle; a text without words
adds nothing; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from yearlink.llm import common as C
from yearlink.llm.common import CHUNK, U64

LONGEST = 4
CHUNK_SIZE = 4_000_000  # characters
RANGE_SIZE = 16_000_000  # characters of text for each hash partition
_CUT = np.zeros(256, bool)
_CUT[[10, 11, 12, 13, *b".,;:!?"]] = True
_BREAK = _CUT.copy()
_BREAK[[9, 32]] = True
_CUT_RE = re.compile(r"[.,;:!?\x0A-\x0D]")
_LONG_TEXT = 1_000_000
_ENTRY = f"{CHUNK} int, bucket int, n int, mass long, keys binary, times binary"
_ANSWER = f"{CHUNK} int, bucket int, n int, kept binary"
_COUNT = "lang string, words int, phrase string, f long"
_NAMES = ["lang", "text", "times"]


def _slices_of(text: str):
    """The text, or a very long one cut between pieces."""
    while len(text) > _LONG_TEXT:
        m = _CUT_RE.search(text, _LONG_TEXT)
        if m is None:
            break
        yield text[: m.end()]
        text = text[m.end() :]
    yield text


def _fold(batches):
    """Equal (lang, text) rows of a batch as one row with their number."""
    for b in C.slices(batches, "text"):
        seen = Counter(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        rows = [(lang, part, m) for (lang, text), m in seen.items() for part in _slices_of(text)]
        cols = list(zip(*rows, strict=True))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], names=_NAMES)


class Grams:
    """n-grams of a chunk: first word, length in words, hash (with language),
    and how often their text occurs."""

    def __init__(self, langs: list[str], texts, times: np.ndarray, longest: int):
        data, offs = C.raw_bytes(texts)
        n = len(data)
        self.buf = C._LOWER[data]
        word = ~_BREAK[data]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        self.start = np.flatnonzero(word & (~before | edge[:n]))
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        piece = np.cumsum(_CUT[data] | edge[:n], dtype=np.int64)[self.start]
        doc = np.searchsorted(offs, self.start, "right") - 1
        self.doc = doc
        del word, before, after
        h = C.span_hashes(data, self.start, self.end, lower=True)
        salts = {lang: C.span_hashes(b := np.frombuffer(lang.encode() + b"\0", np.uint8), np.array([0]), np.array([len(b)]))[0] for lang in set(langs)}
        salt = np.array([salts[x] for x in langs], U64)[doc] if len(langs) else np.empty(0, U64)
        at, length, keys = [], [], []
        run = np.zeros(len(h), U64)
        for k in range(1, longest + 1):
            m = max(0, len(h) - k + 1)
            run = run[:m] * C._STEP + h[k - 1 : k - 1 + m]
            ok = np.flatnonzero(piece[:m] == piece[k - 1 : k - 1 + m])
            at.append(ok)
            length.append(np.full(len(ok), k, np.int8))
            keys.append(C.mix((run[ok] + U64(k)) ^ salt[ok]))
        self.at, self.length, self.key = np.concatenate(at), np.concatenate(length), np.concatenate(keys)
        self.times = times

    def weights(self) -> np.ndarray:
        return self.times[self.doc[self.at]]

    def phrase(self, at: np.ndarray, length: np.ndarray) -> list[str]:
        """Texts of n-grams, words joined by one space."""
        raw = self.buf.tobytes()
        plain = np.ones(len(self.start), bool)  # one space before the word
        plain[1:] = (self.start[1:] - self.end[:-1] == 1) & (self.buf[self.start[1:] - 1] == 32)
        odd = np.cumsum(~plain)
        last = at + length - 1
        simple = odd[last] == odd[at]
        out = []
        for s, e, i, j, easy in zip(
            self.start[at].tolist(), self.end[last].tolist(), at.tolist(), last.tolist(), simple.tolist(), strict=True
        ):
            if easy:
                out.append(raw[s:e].decode())
            else:
                spans = zip(self.start[i : j + 1].tolist(), self.end[i : j + 1].tolist(), strict=True)
                out.append(b" ".join(raw[a:b] for a, b in spans).decode())
        return out


def _grams(t: pa.Table, longest: int) -> Grams:
    return Grams(t.column("lang").to_pylist(), t.column("text"), t.column("times").to_numpy(), longest)


def _totals(keys: np.ndarray, counts: np.ndarray | None):
    """Ascending distinct keys and the sums of their counts (None: one each)."""
    if counts is None:
        keys = np.sort(keys)
        first = C.group_starts(keys)
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = C.group_starts(keys)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else np.empty(0, np.int64)


def _run(t: pa.Table, buckets: int, bits: int, longest: int) -> pa.Table:
    g = _grams(t, longest)
    every_one = bool((g.times == 1).all())
    keys, counts = _totals(g.key >> U64(64 - bits), None if every_one else g.weights())
    cut = C.bounds(keys, buckets, bits)
    rows = []
    for b in range(buckets):
        s = slice(cut[b], cut[b + 1])
        if s.stop > s.start:
            rows.append((b, int(s.stop - s.start), int(counts[s].sum()), C.pack_sorted(keys[s]), C.pack(counts[s])))
    cols = list(zip(*rows, strict=True)) or [()] * 5
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    chunk = pa.array([t.column(CHUNK)[0].as_py()] * len(rows), pa.int32())
    return pa.table([chunk, *(pa.array(c, y) for c, y in zip(cols, types, strict=True))], names=[CHUNK, "bucket", "n", "mass", "keys", "times"])


class Summary:
    """Misra-Gries summary: at most ``capacity`` counters; ``lost`` is what any
    key has lost at most.  Merging keeps lost < mass / capacity."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.empty(0, U64), np.empty(0, np.int64)
        self._held: list[tuple[np.ndarray, np.ndarray]] = []
        self._waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._held.append((keys, counts))
        self._waiting += len(keys)
        if self._waiting > max(4 * self.capacity, 1 << 18):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self._held)])
        counts = np.concatenate([self.counts, *(c for _, c in self._held)])
        self._held, self._waiting = [], 0
        self.keys, self.counts = _totals(keys, counts)
        if len(self.keys) > self.capacity:
            cut = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            left = self.counts - cut
            self.keys, self.counts = self.keys[left > 0], left[left > 0]
            self.lost += cut

    def frequent(self, threshold: int) -> np.ndarray:
        """Ascending keys that may occur ``threshold`` times: a superset."""
        self.merge()
        return self.keys[self.counts + self.lost >= threshold]


def _member(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(among, keys)
    return among[np.minimum(at, len(among) - 1)] == keys


def _survivors(rows: list[dict], threshold: int):
    mass = sum(r["mass"] for r in rows)
    summary = Summary(mass // threshold)
    for r in rows:
        summary.add(C.unpack_sorted(r["keys"]), C.unpack(r["times"]).astype(np.int64))
    alive = summary.frequent(threshold)
    for r in rows:
        bits = _member(C.unpack_sorted(r["keys"]), alive)
        if bits.any():
            yield r[CHUNK], r["bucket"], r["n"], C.pack_bits(bits)


def _owner(threshold: int):
    """Runs arrive sorted by hash partition; one partition is held at a time."""

    def answer(batches):
        rows: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if rows and r["bucket"] != rows[0]["bucket"]:
                    yield _answers(rows, threshold)
                    rows = []
                rows.append(r)
        if rows:
            yield _answers(rows, threshold)

    return answer


def _answers(rows: list[dict], threshold: int) -> pa.RecordBatch:
    cols = list(zip(*_survivors(rows, threshold), strict=True)) or [()] * 4
    types = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.record_batch([pa.array(c, y) for c, y in zip(cols, types, strict=True)], names=[CHUNK, "bucket", "n", "kept"])


def _recount(t: pa.Table, kept: pa.Table, buckets: int, bits: int, longest: int) -> pa.Table:
    """Exact counts in the chunk's texts of the phrases that survive, and all
    word occurrences of each language (as phrases of no words)."""
    g = _grams(t, longest)
    short = g.key >> U64(64 - bits)
    order = np.argsort(short, kind="stable")
    first = C.group_starts(short[order])
    keys = short[order[first]]
    sizes = np.diff(np.append(first, len(order)))
    cut = C.bounds(keys, buckets, bits)
    flag = np.zeros(len(keys), bool)
    for r in kept.to_pylist():
        s = slice(cut[r["bucket"]], cut[r["bucket"] + 1])
        if s.stop - s.start != r["n"]:
            raise ValueError("a chunk changed between the passes")
        flag[s] = C.unpack_bits(r["kept"], r["n"])
    mine = order[np.repeat(flag, sizes)]
    mine = mine[np.argsort(g.key[mine], kind="stable")]
    head = C.group_starts(g.key[mine])
    weight = g.times[g.doc[g.at[mine]]]
    f = np.add.reduceat(weight, head) if len(head) else np.empty(0, np.int64)
    one = mine[head]
    langs = t.column("lang").to_pylist()
    texts = g.phrase(g.at[one], g.length[one])
    per_doc = np.bincount(g.doc, minlength=t.num_rows) * g.times
    total: Counter = Counter()
    for lang, m in zip(langs, per_doc.tolist(), strict=True):
        total[lang] += m
    return pa.table(
        {
            "lang": pa.array([langs[i] for i in g.doc[g.at[one]].tolist()] + list(total), pa.string()),
            "words": pa.array(g.length[one].tolist() + [0] * len(total), pa.int32()),
            "phrase": pa.array(texts + [""] * len(total), pa.string()),
            "f": pa.array(f.tolist() + list(total.values()), pa.int64()),
        }
    )


def frequent_phrases(docs: DataFrame, threshold: int = 30, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, words, phrase, f: every phrase of one to ``longest`` words that
    occurs ``threshold`` times in its language, and for each language a row of
    no words with all its word occurrences."""
    spark = docs.sparkSession
    C.prepare(spark)
    n = C.partitions(spark)
    plain = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text is not null")
    total = plain.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    chunks, buckets = max(3 * n, -(-total // CHUNK_SIZE)), max(n, -(-total // RANGE_SIZE))
    bits = min(64, max(32, 16 + int(total).bit_length()))
    folded = plain.mapInArrow(_fold, "lang string, text string, times long")
    dealt = folded.withColumn(CHUNK, F.pmod(F.xxhash64("lang", "text"), F.lit(chunks)).cast("int")).repartition(n, CHUNK)

    def run(t: pa.Table) -> pa.Table:
        return _run(t, buckets, bits, longest)

    def recount(t: pa.Table, kept: pa.Table) -> pa.Table:
        return _recount(t, kept, buckets, bits, longest)

    runs = dealt.groupBy(CHUNK).applyInArrow(run, _ENTRY)
    owned = runs.repartitionById(n, F.col("bucket") % n).sortWithinPartitions("bucket", CHUNK)
    kept = owned.mapInArrow(_owner(threshold), _ANSWER)
    local = dealt.groupBy(CHUNK).cogroup(kept.groupBy(CHUNK)).applyInArrow(recount, _COUNT)
    counts = local.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return counts.where((F.col("f") >= threshold) | (F.col("words") == 0))


def _big(col: str):
    return F.col(col).cast("decimal(20,0)")


def _scored(phrases: DataFrame) -> DataFrame:
    """Candidates of two or more words with a, l, r and score of their
    lowest-scoring cut."""
    k = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = phrases.where("words >= 2").select("lang", "phrase", F.col("f").alias("a"), k)
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("rest", F.expr("substring(phrase, length(head) + 2)"))
    left = phrases.where("words >= 1").select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    right = left.select("lang", F.col("head").alias("rest"), F.col("l").alias("r"))
    both = cuts.join(left, ["lang", "head"]).join(right, ["lang", "rest"])
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return both.groupBy("lang", "phrase", "a").agg(least).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _covered(phrases: DataFrame, longest: int) -> DataFrame:
    """lang, phrase, most: for phrases inside longer candidates, the largest
    count of those."""
    w = F.split("phrase", " ")
    inner = [
        F.when((F.col("words") >= i + m - 1) & (F.col("words") > m), F.array_join(F.slice(w, i, m), " "))
        for m in range(2, longest)
        for i in range(1, longest - m + 2)
    ]
    subs = phrases.where("words >= 3").select("lang", F.explode(F.array_compact(F.array(*inner))).alias("phrase"), "f")
    return subs.groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, threshold: int = 30, top: int = 2000, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's ``top`` phrases by score: lang, rank, phrase, a (its
    count), l and r (counts of the two parts of the cut), n (all words), score."""
    phrases = C.shared_table(frequent_phrases(docs, threshold, longest, lang_col, text_col), "phrases")
    scored = _scored(phrases).join(_covered(phrases, longest), ["lang", "phrase"], "left")
    free = scored.where(F.col("most").isNull() | (_big("most") * 100 < _big("a") * 80)).drop("most")
    held = C.shared_table(free.withColumn("step", F.expr("score div 1000")), "scored")
    # scores reach 1,000,000: at most 1,001 steps a language tell from which
    # one on the rows have to be ranked
    steps = held.groupBy("lang", "step").count()
    above = F.sum("count").over(Window.partitionBy("lang").orderBy(F.col("step").desc()))
    least = steps.withColumn("above", above).groupBy("lang").agg(F.max(F.when(F.col("above") >= top, F.col("step"))).alias("least"))
    high = held.join(least, "lang").where(F.coalesce(F.col("step") >= F.col("least"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = high.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    words = phrases.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = """
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM piece),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
gram AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g
         FROM w, range(1, 5) AS r(k), unnest(range(1, len(w) - k + 2)) AS u(i)),
f AS (SELECT lang, k, g, count(*)::BIGINT AS f FROM gram GROUP BY ALL HAVING count(*) >= 30),
cut AS (SELECT c.lang, c.k AS words, c.g, c.f AS a, j, array_to_string(string_split(c.g, ' ')[:j], ' ') AS head,
               array_to_string(string_split(c.g, ' ')[j + 1:], ' ') AS rest
        FROM f c, range(1, 4) AS r(j) WHERE c.k >= 2 AND j < c.k),
part AS (SELECT c.*, x.f AS l, y.f AS r, (2000000 * a::HUGEINT) // (x.f + y.f) AS score
         FROM cut c JOIN f x ON x.lang = c.lang AND x.g = head JOIN f y ON y.lang = c.lang AND y.g = rest),
best AS (SELECT lang, words, g, a, arg_min(l, score * 10 + j) AS l, arg_min(r, score * 10 + j) AS r, min(score) AS score
         FROM part GROUP BY lang, words, g, a),
free AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.lang = b.lang AND o.k > b.words AND o.k >= 3
             AND contains(' ' || o.g || ' ', ' ' || b.g || ' ') AND 100::HUGEINT * o.f >= 80::HUGEINT * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank FROM free)
SELECT lang, rank, g AS phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
