"""Helpers shared by the operators of this subpackage.

* ``tokenize``: words of whole texts of an Arrow batch as arrays (numpy), with
  memory bounded by the batch, not by the longest text.
* ``pack`` / ``unpack``: integer arrays as compressed bytes, so that millions
  of hashes cross a shuffle as a few rows.
* ``chunked``: documents dealt into chunks by a hash of their content; the
  same rows always form the same chunk, so a lost task can be run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yearlink.session import ensure_checkpoint_dir, ship_package

U64 = np.uint64
NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id: never the smaller one
WORD_RE = "[^\\x20\\x09-\\x0D]+"  # a word: no ASCII white space
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PIECE = (1 << 18) - 64  # bytes hashed at once

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=U64)
_BASE = int(_rng.integers(0, 1 << 62)) * 4 + 1
_STEP = U64(int(_rng.integers(0, 1 << 62)) * 4 + 1)


def prepare(spark: SparkSession) -> None:
    """Shared checkpoint folder and the package on the workers."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: cuts the lineage, keeps column pruning, survives lost executors."""
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(col: str, k: int) -> Column:
    """crc32 of the column's text modulo ``k``; null for a null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % k


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all bits depend on all bits."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(29))
    h = h * U64(0x9E3779B97F4A7C15)
    return h ^ (h >> U64(32))


_pow = [np.array([1], U64), np.array([1], U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in ((0, _BASE), (1, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, U64(base))
            p[0] = 1
            _pow[k] = np.cumprod(p, dtype=U64)
    return _pow[0], _pow[1]


class Words:
    """Words of a batch of texts: per word its text (``doc``), hash, byte span
    in ``buf`` (``start``, ``end``) and place in the text (``pos``); per text
    the index of its first word (``first``, one longer than the batch)."""

    __slots__ = ("buf", "offsets", "start", "end", "doc", "first", "pos", "hash")

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index and hash of every window of ``k`` words inside one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, U64)
        h = np.zeros(n, U64)
        for j in range(k):
            h = h * _STEP + self.hash[j : j + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, mix(h[at] + U64(k))


def raw_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    arr = texts.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    if not len(arr):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bufs = arr.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(bufs[2], np.uint8)[offs[0] : offs[-1]] if bufs[2] is not None else np.empty(0, np.uint8)
    return data, offs - offs[0]


def tokenize(texts, lower: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of whole texts; ``lower`` maps A-Z first."""
    data, offs = raw_bytes(texts)
    w = Words()
    w.buf, w.offsets = data, offs
    n = len(data)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = word[:-1]
    w.start = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = word[1:]
    w.end = np.flatnonzero(word & (~after | edge[1:])) + 1
    del word, before, after, edge
    w.first = np.searchsorted(w.start, offs)
    counts = np.diff(w.first)
    w.doc = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), counts)
    w.pos = np.arange(len(w.start), dtype=np.int64) - np.repeat(w.first[:-1], counts)
    w.hash = span_hashes(data, w.start, w.end, lower)
    return w


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of ascending byte spans that do not overlap."""
    out = np.empty(len(start), U64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _PIECE, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        up, down = _powers(hi - lo + 1)
        part = data[lo:hi]
        if lower:
            part = _LOWER[part]
        total = np.empty(hi - lo + 1, U64)
        total[0] = 0
        np.cumsum(_BYTE[part] * up[: hi - lo], out=total[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U64))
        i = j
    return out


_zc, _zd = None, None


def _codec():
    global _zc, _zd
    if _zc is None:
        _zc, _zd = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    return _zc, _zd


def pack(values: np.ndarray) -> bytes:
    """Integers as bytes, byte plane by byte plane, compressed."""
    v = np.ascontiguousarray(values).astype(U64, copy=False)
    return _codec()[0].compress(np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(_codec()[1].decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view(U64)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending integers, as their differences."""
    v = values.astype(U64, copy=False)
    return pack(np.diff(v, prepend=U64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=U64)


def pack_bits(flags: np.ndarray) -> bytes:
    return _codec()[0].compress(np.packbits(flags).tobytes())


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(_codec()[1].decompress(data), np.uint8), count=n).astype(bool)


def bounds(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each bucket's share of the ascending ``bits``-wide keys starts."""
    edges = np.array([-(-(b << bits) // buckets) for b in range(buckets)], dtype=U64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


def slices(batches: Iterator[pa.RecordBatch], column: str, rows: int = 4096, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds at most ``size`` bytes of the column, or
    one row: bounds the memory of what follows, whatever Spark sends."""
    for b in batches:
        at = b.schema.get_field_index(column)
        offs = raw_bytes(b.column(at))[1]
        i = 0
        while i < b.num_rows:
            j = min(i + rows, max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1))
            yield b.slice(i, j - i)
            i = j


def column(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is not in the one column of ``ids``; a
    null id stays.  No column name of ``docs`` gets in the way."""
    name = "_llm_out"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return docs.join(ids.toDF(name), column(id_col).cast("long") == F.col(name), "left_anti")


CHUNK = "_llm_chunk"


def chunked(docs: DataFrame, id_col: str, text_col: str, target: int = 4_000_000) -> DataFrame:
    """Add the chunk number and deal the rows out by it.  Chunks hold about
    ``target`` characters (or one text); their number follows the size of the
    table, which one scan of the text lengths gives."""
    spark = docs.sparkSession
    n = partitions(spark)
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    chunks = max(3 * n, -(-total // target))
    key = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(chunks)).cast("int")
    return docs.withColumn(CHUNK, key).repartition(n, CHUNK)


def ids_of(column) -> np.ndarray:
    """doc_id values as int64; null becomes ``NO_ID``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.int64()).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
