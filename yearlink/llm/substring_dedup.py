"""Operator 7, substring dedup by fixed-block anchors.

A window of ``window`` (13) words that is a copy of a window of another text
holds a whole block of ``block`` (7) words that starts at a multiple of
``block`` there, as 2 * 7 - 1 <= 13.  So:

1. *Index and probe.*  Every text gives its non-overlapping blocks (the
   index) and all its rolling windows of 7 words (the probes).  Each chunk
   of documents adds them up first: one entry for each different hash, with
   the smallest doc_id that has it as a block and the largest that probes
   it.  Entries go to the task that owns their hash range.  A hash is *live*
   if a block of a smaller doc_id meets a probe of a larger one.
2. *Extend.*  Every window of 13 words around a live anchor goes, with its
   64-bit hash and smallest and largest doc_id in the chunk, to the owner of
   its hash, which answers with the smallest doc_id of all.
3. *Remove.*  A word goes if a window over it starts in a smaller doc_id.
   Overlapping windows add up to the maximal repeats.

Entries cross the shuffles packed (a sorted run of hashes for each chunk and
hash range).  A window that a third of all texts share is one entry for each
chunk, and all passes take whole texts.  Nothing goes through the driver but
the total text length.  The dealt documents are shuffled once; the three
passes reuse that exchange.

Defined cases: a null text has no words.  A null doc_id is never the smaller
one and such rows lose words to all rows with an id.  Rows with the same
doc_id do not remove each other's words.  A text under 13 words keeps all.
Extra columns are ignored, or carried whole by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yearlink.llm import common as C
from yearlink.llm.common import CHUNK, U64

BITS = 44  # of an anchor's hash; a chance hit only costs the check of a window
_ENTRY = f"{CHUNK} int, bucket int, n int, keys binary, has binary, low binary, high binary"
_ANSWER = f"{CHUNK} int, bucket int, at binary, low binary"


def _runs(hashes: np.ndarray, ids: np.ndarray, block: np.ndarray | None):
    """For each different hash, ascending: smallest id (where ``block`` holds,
    else over all), largest id, and the place of each input hash in the list."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    starts = C.group_starts(h)
    if not len(starts):
        return h, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    d = ids[order]
    high = np.maximum.reduceat(d, starts)
    if block is not None:
        d = np.where(block[order], d, C.NO_ID)
    low = np.minimum.reduceat(d, starts)
    place = np.empty(len(h), np.int64)
    place[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(h))))
    return h[starts], low, high, place


def _pack_ids(ids: np.ndarray) -> bytes:
    """Ids as a short list of different values and places in it."""
    values, place = np.unique(ids, return_inverse=True)
    a, b = C.pack_sorted(values.astype(U64)), C.pack(place.astype(U64))
    return len(a).to_bytes(4, "little") + a + b


def _unpack_ids(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    return C.unpack_sorted(data[4 : 4 + n]).astype(np.int64)[C.unpack(data[4 + n :]).astype(np.int64)]


def _entries(chunk: int, keys, low, high, buckets: int, bits: int, rank=None) -> pa.Table:
    cut = C.bounds(keys, buckets, bits)
    out = {k: [] for k in ("chunk", "bucket", "n", "keys", "has", "low", "high")}
    for b in np.flatnonzero(np.diff(cut)):
        s = slice(cut[b], cut[b + 1])
        has = low[s] != C.NO_ID
        for k, v in (
            ("chunk", chunk),
            ("bucket", int(b)),
            ("n", int(cut[b + 1] - cut[b])),
            ("keys", C.pack_sorted(keys[s])),
            ("has", C.pack_bits(has) if rank is None else C.pack_sorted(rank[s].astype(U64))),
            ("low", _pack_ids(low[s][has] if rank is None else low[s])),
            ("high", _pack_ids(high[s])),
        ):
            out[k].append(v)
    types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    names = (CHUNK, "bucket", "n", "keys", "has", "low", "high")
    return pa.table([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=names)


def _anchors(words, ids, block: int):
    at, h = words.windows(block)
    h = h >> U64(64 - BITS)
    return (at, *_runs(h, ids[words.doc[at]], words.pos[at] % block == 0))


def _index_and_probe(table: pa.Table, buckets: int, block: int) -> pa.Table:
    words = C.tokenize(table.column("text"))
    _, keys, low, high, _ = _anchors(words, C.ids_of(table.column("doc_id")), block)
    return _entries(table.column(CHUNK)[0].as_py(), keys, low, high, buckets, BITS)


def _join_anchors(batches):
    """Owner of a hash range: the live hashes of each chunk, as bits."""
    rows = [r for b in batches for r in b.to_pylist()]
    if not rows:
        return
    keys, low, high = [], [], []
    for r in rows:
        has = C.unpack_bits(r["has"], r["n"])
        some = np.full(r["n"], C.NO_ID, np.int64)
        if has.any():
            some[has] = _unpack_ids(r["low"])
        keys.append(C.unpack_sorted(r["keys"]))
        low.append(some)
        high.append(_unpack_ids(r["high"]))
    _, least, _, place = _runs(np.concatenate(keys), np.concatenate(low), None)
    _, _, most, _ = _runs(np.concatenate(keys), np.concatenate(high), None)
    live = (least < most)[place]
    at = 0
    out = []
    for r in rows:
        bits = live[at : at + r["n"]]
        at += r["n"]
        if bits.any():
            out.append((r[CHUNK], r["bucket"], C.pack_bits(bits), b""))
    yield _answers(out)


def _answers(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    names = (CHUNK, "bucket", "at", "low")
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def _extend(docs: pa.Table, live: pa.Table, buckets: int, block: int, window: int) -> pa.Table:
    empty = np.empty(0, np.int64)
    if not docs.num_rows or not live.num_rows:
        return _entries(0, np.empty(0, U64), empty, empty, buckets, 64, empty)
    words, ids = C.tokenize(docs.column("text")), C.ids_of(docs.column("doc_id"))
    at, keys, _, _, place = _anchors(words, ids, block)
    hot = np.zeros(len(keys), bool)
    cut = C.bounds(keys, buckets, BITS)
    for r in live.to_pylist():
        s = slice(cut[r["bucket"]], cut[r["bucket"] + 1])
        hot[s] = C.unpack_bits(r["at"], s.stop - s.start)
    count = np.zeros(len(words.hash) + 1, np.int64)
    count[1:][at] = hot[place]
    count = np.cumsum(count)
    at, h = words.windows(window)
    keys, low, high, place = _runs(h, ids[words.doc[at]], None)
    near = count[at + window - block + 1] > count[at]
    chosen = np.zeros(len(keys), bool)
    chosen[place[near]] = True
    rank = np.flatnonzero(chosen)
    return _entries(docs.column(CHUNK)[0].as_py(), keys[rank], low[rank], high[rank], buckets, 64, rank)


def _first_owner(batches):
    """Owner of a hash range: for each chunk the windows that also start in a
    document smaller than the chunk's largest, and the smallest such id."""
    rows = [r for b in batches for r in b.to_pylist()]
    if not rows:
        return
    keys = [C.unpack_sorted(r["keys"]) for r in rows]
    low = [_unpack_ids(r["low"]) for r in rows]
    _, least, _, place = _runs(np.concatenate(keys), np.concatenate(low), None)
    least = least[place]
    at, out = 0, []
    for r in rows:
        mine = least[at : at + r["n"]]
        at += r["n"]
        hit = mine < _unpack_ids(r["high"])
        if hit.any():
            ranks = C.unpack_sorted(r["has"])[hit]
            out.append((r[CHUNK], r["bucket"], C.pack_sorted(ranks), _pack_ids(mine[hit])))
    yield _answers(out)


def removed_words(docs: pa.Table, answers: pa.Table, window: int):
    """Words of the chunk and whether each is removed."""
    words = C.tokenize(docs.column("text"))
    gone = np.zeros(len(words.hash) + 1, np.int64)
    if answers.num_rows and len(words.hash):
        ids = C.ids_of(docs.column("doc_id"))
        at, h = words.windows(window)
        keys, _, _, place = _runs(h, ids[words.doc[at]], None)
        least = np.full(len(keys), C.NO_ID, np.int64)
        for r in answers.to_pylist():
            least[C.unpack_sorted(r["at"]).astype(np.int64)] = _unpack_ids(r["low"])
        at = at[least[place] < ids[words.doc[at]]]
        np.add.at(gone, at, 1)
        np.subtract.at(gone, at + window, 1)
    return words, np.cumsum(gone[:-1]) > 0


def _kept(words, gone: np.ndarray):
    """For each text: its words and those kept, as bytes."""
    raw = words.buf.tobytes()
    for i in range(len(words.offsets) - 1):
        a, b = words.first[i], words.first[i + 1]
        all_words = raw[words.offsets[i] : words.offsets[i + 1]].split()
        dropped = gone[a:b]
        yield all_words, all_words if not dropped.any() else list(compress(all_words, ~dropped))


def _digest(docs: pa.Table, answers: pa.Table, window: int) -> pa.Table:
    out = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": []}
    if docs.num_rows:
        words, gone = removed_words(docs, answers, window)
        out["doc_id"] = docs.column("doc_id")
        for every, kept in _kept(words, gone):
            out["n_words"].append(len(every))
            out["n_removed"].append(len(every) - len(kept))
            out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    cols = [v if isinstance(v, pa.ChunkedArray) else pa.array(v, t) for v, t in zip(out.values(), types, strict=True)]
    return pa.table(cols, names=list(out))


def _rewrite(docs: pa.Table, answers: pa.Table, window: int) -> pa.Table:
    texts = docs.column("text").to_pylist()
    if docs.num_rows:
        words, gone = removed_words(docs, answers, window)
        for i, (every, kept) in enumerate(_kept(words, gone)):
            if len(kept) < len(every):
                texts[i] = b" ".join(kept).decode()
    return pa.table([docs.column("row"), pa.array(texts, pa.string())], names=["row", "text"])


def _passes(dealt: DataFrame, window: int, block: int):
    spark = dealt.sparkSession
    n = C.partitions(spark)
    if window < 2 * block - 1:
        raise ValueError("a window has to hold a whole block: window >= 2 * block - 1")
    plain = dealt.select("doc_id", "text", CHUNK)

    def probe(t: pa.Table) -> pa.Table:
        return _index_and_probe(t, n, block)

    def extend(key, d: pa.Table, a: pa.Table) -> pa.Table:
        return _extend(d, a, n, block, window)

    entries = plain.groupBy(CHUNK).applyInArrow(probe, _ENTRY)
    live = entries.repartitionById(n, F.col("bucket")).mapInArrow(_join_anchors, _ANSWER)
    around = plain.groupBy(CHUNK).cogroup(live.groupBy(CHUNK)).applyInArrow(extend, _ENTRY)
    return around.repartitionById(n, F.col("bucket")).mapInArrow(_first_owner, _ANSWER)


def repeat_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, block: int = 7) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (the kept words
    joined by one space)."""
    C.prepare(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = C.chunked(plain, "doc_id", "text")

    def digest(key, d: pa.Table, a: pa.Table) -> pa.Table:
        return _digest(d, a, window)

    owners = _passes(dealt, window, block)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return dealt.groupBy(CHUNK).cogroup(owners.groupBy(CHUNK)).applyInArrow(digest, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, block: int = 7) -> DataFrame:
    """The same rows and columns; a text that lost words holds its kept words
    joined by one space, any other is as it was."""
    C.prepare(docs.sparkSession)
    plain = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.struct(*[C.column(c).alias(c) for c in docs.columns if c != text_col]).alias("row"),
    )
    dealt = C.chunked(plain, "doc_id", "text")

    def rewrite(key, d: pa.Table, a: pa.Table) -> pa.Table:
        return _rewrite(d, a, window)

    owners = _passes(dealt, window, block)
    schema = T.StructType([dealt.schema["row"], T.StructField("text", T.StringType())])
    out = dealt.groupBy(CHUNK).cogroup(owners.groupBy(CHUNK)).applyInArrow(rewrite, schema)
    return out.select(*[F.col("text").alias(text_col) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


SQL = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id,
                  list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT k, doc_id, unnest(range(1, len(w) - 11)) AS i,
               unnest(list_transform(range(1, len(w) - 11), lambda j: list_slice(w, j, j + 12))) AS g FROM d WHERE len(w) >= 13),
owner AS (SELECT g, min(doc_id) AS least FROM win GROUP BY g),
gone AS (SELECT DISTINCT k, i + o AS i FROM win JOIN owner USING (g), range(0, 13) AS r(o)
         WHERE least < doc_id OR (doc_id IS NULL AND least IS NOT NULL)),
word AS (SELECT k, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT k, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (k, i) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (k)
"""
