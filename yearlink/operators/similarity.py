"""Tiled exact cosine top-k join (J2/T2, J5, Q1/Q4 share it).

``left`` and ``right`` are keyed by a low-cardinality group key (a year
pair, a hierarchy level, a constant for search).  Inside a key every left
row is compared with every right row -- that is the operator's definition --
but the work is cut into tiles ``(key, left block, right block)`` whose
block counts grow with the size of the key's two sides.  One task therefore
never holds more than ``left_block x right_block`` pairs, whatever the skew
between keys.  The per-key size table (one row per key value) is what gets
broadcast; the rows themselves are shuffled to their tiles.

``method='block'``: an Arrow cogroup does one float64 matrix product per
tile and emits only its local top-k (plus ties within the quantisation
margin).  ``method='expr'``: Catalyst alone, no Python worker.  Every pair's
cosine is one generated expression over numbers in columns, and pairs below a
bound known from part of the right rows leave before they are sorted.
Either way the final per-row top-k is a ``row_number()`` window that Spark
plans as a partial ``WindowGroupLimit`` before the shuffle.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from yearlink.functions.vectors import SCORE_DIGITS, cosine, quantise
from yearlink.session import parquet_table, ship_package


def _dense(col, n: int) -> np.ndarray:
    """list<float> Arrow column -> dense float64 [n, d]; NULL -> zero row."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if n == 0:
        return np.zeros((0, 0))
    lengths = arr.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    d = int(lengths.max()) if len(lengths) else 0
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if arr.null_count == 0 and (lengths == d).all():
        return flat.reshape(n, d)
    out = np.zeros((n, d))
    pos = 0
    for i, ln in enumerate(lengths):
        out[i, :ln] = flat[pos : pos + ln]
        pos += ln
    return out


# Budget of one tile for exact Jaccard (multiply-adds of the dense part plus
# ten for each pair of the sparse part); above it bounds from token counts are
# used, which prune less and as exactly.
_JACCARD_BUDGET = 6e10
_SPARSE_PAIRS = 1 << 20
# Numbers in the 0/1 matrices of a dense step, and token sets a side holds.
_DENSE_CELLS = 1 << 24
_SETS_HELD = 1 << 13


def _list_codes(col):
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return arr.flatten().to_numpy(zero_copy_only=False), arr.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


def _intersections(qrow, qcode, crow, ccode, nq: int, nc: int, v: int):
    """Common tokens of every (query, candidate) pair, or None above budget.
    Tokens of one side only are left out; common ones go through a matrix
    product, rare ones through their lists of rows."""
    qn, cn = np.bincount(qcode, minlength=v), np.bincount(ccode, minlength=v)
    work = qn.astype(np.float64) * cn
    dense = work * 64 > nq * nc
    sparse = (work > 0) & ~dense
    n_dense = int(dense.sum())
    if n_dense * nq * nc + 10 * work[sparse].sum() > _JACCARD_BUDGET:
        return None
    inter = np.zeros((nq, nc), np.float32)
    place = np.cumsum(dense) - 1
    step = max(1, _DENSE_CELLS // (nq + nc))
    for at in range(0, n_dense, step):
        width = min(step, n_dense - at)
        sides = []
        for row, code, n in ((qrow, qcode, nq), (crow, ccode, nc)):
            mine = dense[code] & (place[code] >= at) & (place[code] < at + width)
            m = np.zeros((n, width), np.float32)
            m[row[mine], place[code[mine]] - at] = 1.0
            sides.append(m)
        inter += sides[0] @ sides[1].T
    qs, cs = sparse[qcode], sparse[ccode]
    qrow, qcode, crow, ccode = qrow[qs], qcode[qs], crow[cs], ccode[cs]
    by = np.argsort(ccode, kind="stable")
    crow = crow[by]
    first = np.cumsum(np.bincount(ccode, minlength=v)) - np.bincount(ccode, minlength=v)
    times = cn[qcode]
    ends = np.cumsum(times)
    at = 0
    while at < len(qcode):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _SPARSE_PAIRS, "right")))
        t = times[at:to]
        seq = np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t)
        cell = np.repeat(qrow[at:to], t) * nc + crow[np.repeat(first[qcode[at:to]], t) + seq]
        hit, n = np.unique(cell, return_counts=True)
        inter.reshape(-1)[hit] += n
        at = to
    return inter.astype(np.float64)


def _jaccard_matrix(qtok, ctok, tq, tc):
    """Exact Jaccard of every (query, candidate) pair of a tile, or None when
    that is too much work (counts in float32 are exact below 2^24)."""
    qflat, qlen = _list_codes(qtok)
    cflat, clen = _list_codes(ctok)
    codes, uniq = pd.factorize(np.concatenate([qflat, cflat]))
    nq, nc = len(qlen), len(clen)
    if not len(uniq):
        return np.zeros((nq, nc))
    rows_q, rows_c = np.repeat(np.arange(nq), qlen), np.repeat(np.arange(nc), clen)
    inter = _intersections(rows_q, codes[: len(qflat)], rows_c, codes[len(qflat) :], nq, nc, len(uniq))
    if inter is None:
        return None
    union = np.add.outer(tq, tc) - inter
    ok = (np.outer(tq, tc) > 0) & (union > 0)
    return np.divide(inter, union, out=np.zeros_like(inter), where=ok)


# A tile is worked through in steps of this many (left, right) rows, so that the
# score matrix of a worker stays at a few ten MB whatever the size of the tile.
_STEP = (1024, 4096)
# float32 cosines sort out the pairs; those that remain get their float64 value.
_EPS32 = 2.0 ** -23
# Up to this k rows of equal vectors are compared as one row.
_CLASS_K = 32
# Vectors of one side of a tile in bytes (float32), and rows a tile may return.
_TILE_BYTES = 64 << 20
_TILE_OUT = 1 << 22


class _Side:
    """One side of a tile: vectors and norms, and unit vectors in float32."""

    def __init__(self, table: pa.Table):
        self.table, self.n = table, table.num_rows
        self.vec, self.norm = _dense32(table.column("_vec"), self.n), np.nan_to_num(
            table.column("_norm").to_numpy(zero_copy_only=False).astype(np.float64)
        )
        self._sets: dict[int, frozenset] = {}
        self.unit = self.vec
        # a vector without a usable norm has cosine 0 with all
        self.ok = (self.norm > 0) & np.isfinite(self.norm)

    def widen(self, d: int) -> None:
        if self.vec.shape[1] != d:
            self.vec = np.pad(self.vec, ((0, 0), (0, d - self.vec.shape[1])))
        self.unit = np.empty(self.vec.shape, np.float32)
        for at in range(0, self.n, 4096):
            rows = slice(at, at + 4096)
            ok = self.ok[rows, None]
            self.unit[rows] = np.divide(self.vec[rows], self.norm[rows, None], out=np.zeros(self.vec[rows].shape), where=ok)

    def tokens(self, codes: np.ndarray, ends: np.ndarray, i: int) -> frozenset:
        if i not in self._sets:
            if len(self._sets) >= _SETS_HELD:
                self._sets.clear()
            self._sets[i] = frozenset(codes[ends[i - 1] if i else 0 : ends[i]].tolist())
        return self._sets[i]


def _dense32(col, n: int) -> np.ndarray:
    """As :func:`_dense`, floats kept as they are."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if n and arr.null_count == 0 and arr.type.value_type == pa.float32():
        lengths = arr.value_lengths().to_numpy(zero_copy_only=False)
        flat = arr.flatten()
        if (lengths == lengths[0]).all() and flat.null_count == 0:
            return flat.to_numpy(zero_copy_only=False).reshape(n, int(lengths[0]))
    return _dense(col, n)


def _sides_of(left: pa.Table, right: pa.Table) -> tuple[_Side, _Side, float]:
    """Both sides of a tile and how far a float32 cosine can be off."""
    q, c = _Side(left), _Side(right)
    d = max(q.vec.shape[1], c.vec.shape[1])
    q.widen(d)
    c.widen(d)
    return q, c, 2.0 * (d + 8) * _EPS32


def _pair_cosines(q: _Side, c: _Side, qi: np.ndarray, ci: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """float64 cosines of single pairs."""
    out = np.zeros(len(qi))
    for at in range(0, len(qi), step):
        x, y = qi[at : at + step], ci[at : at + step]
        dots = np.einsum("ij,ij->i", q.vec[x].astype(np.float64), c.vec[y].astype(np.float64))
        den = q.norm[x] * c.norm[y]
        ok = q.ok[x] & c.ok[y] & (den > 0)
        out[at : at + step] = np.divide(dots, den, out=np.zeros_like(dots), where=ok)
    return out


def _ranked(qi: np.ndarray, cos: np.ndarray, ids: np.ndarray, k: int, n: int, margin: float):
    """(places, kth): which pairs can be among the ``k`` best of their query,
    those that may tie after quantisation too, and each query's k-th best (-inf
    where there are fewer).  Of exactly equal cosines the lowest ids come first."""
    by = np.lexsort((ids, -cos, qi))
    q = qi[by]
    first = np.searchsorted(q, np.arange(n))
    rank = np.arange(len(by)) - first[q]
    kth = np.full(n, -np.inf)
    at = by[rank == k - 1]
    kth[qi[at]] = cos[at]
    c = cos[by]
    return by[(rank < k) | ((c >= kth[q] - margin) & (c < kth[q]))], kth


def _cells(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a matrix, by one flat pass."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def _best_pairs(q: _Side, c: _Side, slack: float, k: int):
    """Yields (qi, ci, cos) for steps of queries: all pairs of the tile that can
    be among their query's ``k`` best by (cosine, lower id)."""
    margin = 10.0 ** (-SCORE_DIGITS + 1)
    ids = c.table.column("_low" if "_low" in c.table.column_names else "_rid").to_numpy(zero_copy_only=False)
    low = np.argsort(ids, kind="stable")[:k]  # for queries with cosine 0 to all
    for q0 in range(0, q.n, _STEP[0]):
        rows = np.arange(q0, min(q0 + _STEP[0], q.n))
        blank = rows[~q.ok[rows]]
        rows = rows[q.ok[rows]]
        n = len(rows)
        qi = ci = np.empty(0, np.int64)
        cos, kth = np.empty(0), np.full(n, -np.inf)
        steps = range(0, c.n if n else 0, _STEP[1])
        unit = q.unit[rows]
        if k > _CLASS_K and c.n > k:  # many to rank: their bound first, in a round of its own
            best = np.empty((n, 0), np.float32)
            for c0 in steps:
                best = np.concatenate([best, unit @ c.unit[c0 : c0 + _STEP[1]].T], axis=1)
                if best.shape[1] > k:
                    best = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k :]
            kth = best.min(axis=1).astype(np.float64) - slack
        for c0 in steps:
            sims = unit @ c.unit[c0 : c0 + _STEP[1]].T
            bound = kth
            if np.isneginf(kth).any() and sims.shape[1] > k:
                here = sims.max(axis=1) if k == 1 else np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]
                bound = np.maximum(kth, here.astype(np.float64) - slack)
            hit_q, hit_c = _cells(sims >= (bound - slack - margin).astype(np.float32)[:, None])
            if len(hit_q):
                qi, ci = np.concatenate([qi, hit_q]), np.concatenate([ci, hit_c + c0])
                cos = np.concatenate([cos, _pair_cosines(q, c, rows[hit_q], hit_c + c0)])
            if k <= _CLASS_K and len(hit_q) or len(qi) > _TILE_OUT or c0 == steps[-1]:
                kept, exact = _ranked(qi, cos, ids[ci], k, n, margin)
                qi, ci, cos, kth = qi[kept], ci[kept], cos[kept], np.maximum(kth, exact)
        yield (
            np.concatenate([rows[qi], np.repeat(blank, len(low))]),
            np.concatenate([ci, np.tile(low, len(blank))]),
            np.concatenate([cos, np.zeros(len(blank) * len(low))]),
        )


def _keys_of(key, names: list[str], types: list, n: int) -> dict:
    """The group key as columns of ``n`` rows."""
    scalars = (pa.scalar(v.as_py() if hasattr(v, "as_py") else v, t) for v, t in zip(key, types))
    return {c: pa.repeat(v, n) for c, v in zip(names, scalars)}


class _Tokens:
    """Token sets of both sides as codes; the sets of single rows are made when
    a pair asks for them."""

    def __init__(self, q: _Side, c: _Side):
        self.q, self.c = q, c
        cols = [t.table.column("_tok") for t in (q, c)]
        cols = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in cols]
        self.ends = [np.cumsum(x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) for x in cols]
        flat = [x.flatten() for x in cols]
        codes = pa.concat_arrays(flat).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        self.codes = codes[: len(flat[0])], codes[len(flat[0]) :]

    def jaccard(self, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
        out = np.zeros(len(qi))
        for at, (i, j) in enumerate(zip(qi.tolist(), ci.tolist())):
            x, y = self.q.tokens(self.codes[0], self.ends[0], i), self.c.tokens(self.codes[1], self.ends[1], j)
            if x and y:
                both = len(x & y)
                out[at] = both / (len(x) + len(y) - both)
        return out


def _counts(side: _Side, name: str) -> np.ndarray:
    return side.table.column(name).to_numpy(zero_copy_only=False).astype(np.float64)


def _room(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Indel ratio that texts of these lengths can reach."""
    return np.divide(2.0 * np.minimum(a, b), a + b, out=np.ones_like(a), where=a + b > 0)


# Nearest pairs of a query that seed its bound.
_SEEDS = 8


def _seed_fn(key_names: list[str], key_types: list, spec: dict):
    """A query's nearest classes in a tile: lowest id, rows and blended score
    (without the Indel term)."""
    a, b = spec["alpha"], spec["beta"]

    def fn(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0))]
        if left.num_rows and right.num_rows:
            q, c, slack = _sides_of(left, right)
            tokens = _Tokens(q, c)
            for qi, ci, cos in _best_pairs(q, c, slack, _SEEDS):
                found.append((qi, ci, cos, a * cos + b * tokens.jaccard(qi, ci) - 1e-8))
        qi, ci, cos, score = (np.concatenate(x) for x in zip(*found))
        rows = _list_codes(right.column("_ids"))[1].astype(np.int64)
        cols = _keys_of(key, key_names, key_types, len(qi))
        cols.update(
            l_id=left.column("_lid").to_numpy(zero_copy_only=False)[qi],
            r_id=right.column("_rid").to_numpy(zero_copy_only=False)[ci],
            cos=cos, score=score, n=rows[ci],
        )
        return pa.table(cols)

    return fn


def _bounded_fn(k: int, key_names: list[str], key_types: list, spec: dict):
    """The pairs of a tile that can still win given the bound of their query,
    no more than its ``k`` nearest of them, and per query (r_id null) how many
    rows are near enough in cosine to be ranked before a winner.  The cosine
    sorts out pairs first, then token counts and lengths, then the exact
    Jaccard of those left."""
    a, b, g = spec["alpha"], spec["beta"], spec["gamma"]
    margin = 10.0 ** (-SCORE_DIGITS + 1)

    def fn(key, left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows if right.num_rows else 0
        near = np.zeros(n, np.int64)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0), np.empty(0))]
        l_ids = left.column("_lid").to_numpy(zero_copy_only=False)[:n]
        r_ids = right.column("_rid").to_numpy(zero_copy_only=False)
        if n:
            q, c, slack = _sides_of(left, right)
            tokens = _Tokens(q, c)
            lb = left.column("_lb").to_numpy(zero_copy_only=False)
            tq, tc, lq, lc = _counts(q, "_ntok"), _counts(c, "_ntok"), _counts(q, "_nlen"), _counts(c, "_nlen")
            weight = _list_codes(right.column("_ids"))[1].astype(np.float64)
            # queries with cosine 0 to all are ranked by id alone
            late = np.ones(c.n, bool)
            late[np.argsort(r_ids, kind="stable")[:k]] = False
            for q0 in range(0, n, _STEP[0]):
                rows = slice(q0, q0 + _STEP[0])
                floor = (lb[rows] - b - g - 2e-8 - 1e-6)[:, None] - abs(a) * slack
                here = [found[0]]
                for c0 in range(0, c.n, _STEP[1]):
                    cos = q.unit[rows] @ c.unit[c0 : c0 + _STEP[1]].T
                    qi, ci = _cells(np.float32(a) * cos >= floor.astype(np.float32))
                    near[rows] += np.bincount(qi, weight[ci + c0], cos.shape[0]).astype(np.int64)
                    rough = cos[qi, ci].astype(np.float64)
                    qi, ci = qi + q0, ci + c0
                    room = _room(lq[qi], lc[ci])
                    most, least = np.maximum(tq[qi], tc[ci]), np.minimum(tq[qi], tc[ci])
                    j_ub = np.divide(least, most, out=np.zeros_like(most), where=most > 0)
                    can = a * rough + abs(a) * slack + b * j_ub + g * room + 2e-8 >= lb[qi]
                    can &= q.ok[qi] | ~late[ci]
                    qi, ci, room = qi[can], ci[can], room[can]
                    sure = _pair_cosines(q, c, qi, ci)
                    jac = None
                    if len(qi) * 64 > cos.size:  # many: all at once, if the tokens allow it
                        x, y = left.slice(q0, cos.shape[0]), right.slice(c0, cos.shape[1])
                        jac = _jaccard_matrix(x.column("_tok"), y.column("_tok"), tq[rows], tc[c0 : c0 + _STEP[1]])
                        jac = None if jac is None else jac[qi - q0, ci - c0]
                    if jac is None:
                        jac = tokens.jaccard(qi, ci)
                    can = a * sure + b * jac + g * room + 1e-8 >= lb[qi]
                    here.append(tuple(x[can] for x in (qi, ci, sure, jac, g * room)))
                here = tuple(np.concatenate(x) for x in zip(*here))
                kept, _ = _ranked(here[0] - q0, here[2], r_ids[here[1]], k, min(_STEP[0], n - q0), margin)
                found.append(tuple(x[kept] for x in here))
        qi, ci, cos, jac, most = (np.concatenate(x) for x in zip(*found))
        cols = _keys_of(key, key_names, key_types, len(qi) + n)
        pairs = {
            "r_id": pa.array(r_ids[ci], pa.int64()),
            "cos": pa.array(cos, pa.float64()),
            "jac": pa.array(jac, pa.float64()),
            "most": pa.array(most, pa.float64()),
        }
        cols.update(
            l_id=pa.array(np.concatenate([l_ids[qi], l_ids]), pa.int64()),
            **{c: pa.chunked_array([v, pa.nulls(n, v.type)]) for c, v in pairs.items()},
            near=pa.array(np.concatenate([np.zeros(len(qi), np.int64), near]), pa.int64()),
        )
        return pa.table(cols)

    return fn


def _nano(cos: np.ndarray) -> np.ndarray:
    """Cosines in units of the last ranked decimal, rounded as Spark rounds."""
    x = cos * 10.0**SCORE_DIGITS
    out = np.rint(x).astype(np.int64)
    for i in np.flatnonzero(np.abs(np.abs(x - np.trunc(x)) - 0.5) < 1e-5):
        out[i] = int(Decimal(repr(float(cos[i]))).scaleb(SCORE_DIGITS).to_integral_value(ROUND_HALF_UP))
    return out


def _rank_fn(key_names: list[str], key_types: list):
    """For each asked pair of a query (``_sc`` cosines, falling, and ``_si``
    lowest ids) how many rows of the tile come before it by (cosine, id)."""

    def fn(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            left = left.slice(0, 0)
        sc, each = _list_codes(left.column("_sc"))
        si = _list_codes(left.column("_si"))[0]
        owner = np.repeat(np.arange(left.num_rows), each)
        ends = np.cumsum(each)
        before = np.zeros(len(sc), np.int64)
        if left.num_rows:
            q, c, slack = _sides_of(left, right)
            ids, many = _list_codes(right.column("_ids"))
            last = np.cumsum(many)
            spot = (owner.astype(np.int64) << 33) - sc
            least = sc[ends - 1]
            above = np.zeros(len(sc) + 1)
            for q0 in range(0, q.n, _STEP[0] // 4):
                rows = np.arange(q0, min(q0 + _STEP[0] // 4, q.n))
                rows = rows[q.ok[rows]]
                floor = (least[rows] / 10.0**SCORE_DIGITS - slack - 1e-6).astype(np.float32)[:, None]
                for c0 in range(0, c.n if len(rows) else 0, _STEP[1]):
                    qi, ci = _cells(q.unit[rows] @ c.unit[c0 : c0 + _STEP[1]].T >= floor)
                    qi, ci = rows[qi], ci + c0
                    cell = (qi << 33) - _nano(_pair_cosines(q, c, qi, ci))
                    lo, hi = np.searchsorted(spot, cell, "left"), np.searchsorted(spot, cell, "right")
                    over = hi < ends[qi]  # nearer than the pair at hi and all after it
                    above += np.bincount(hi[over], many[ci[over]], len(above))
                    tied = hi > lo
                    times = (hi - lo)[tied]
                    cj = np.repeat(ci[tied], times)
                    at = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo[tied], times)
                    one = many[cj] == 1
                    np.add.at(before, at[one], ids[last[cj[one]] - 1] < si[at[one]])
                    for s, j in zip(at[~one].tolist(), cj[~one].tolist()):
                        before[s] += np.searchsorted(ids[last[j] - many[j] : last[j]], si[s])
            run = np.cumsum(above[:-1])
            first = ends - each
            before += (run - np.repeat(run[first] - above[first], each)).astype(np.int64)
            none = ~q.ok[owner]  # cosine 0 to all: in the order of the ids
            before[none] = np.searchsorted(np.sort(ids), si[none])
        cols = _keys_of(key, key_names, key_types, len(sc))
        cols.update(l_id=left.column("_lid").to_numpy(zero_copy_only=False)[owner], r_id=si, before=before)
        return pa.table(cols)

    return fn


def _top_fn(k: int, key_names: list[str], key_types: list):
    """The local top-k of a tile (with all that may tie after quantisation)."""

    def fn(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if left.num_rows and right.num_rows:
            q, c, slack = _sides_of(left, right)
            found += list(_best_pairs(q, c, slack, k))
        qi, ci, cos = (np.concatenate(x) for x in zip(*found))
        cols = _keys_of(key, key_names, key_types, len(qi))
        cols.update(
            l_id=pa.array(left.column("_lid").to_numpy(zero_copy_only=False)[qi], pa.int64()),
            r_id=pa.array(right.column("_rid").to_numpy(zero_copy_only=False)[ci], pa.int64()),
            cos=pa.array(cos, pa.float64()),
        )
        return pa.table(cols)

    return fn


def cosine_topk(
    left: DataFrame,
    right: DataFrame,
    key: list[str],
    k: int,
    left_id: str,
    right_id: str,
    vec: str = "embedding",
    norm: str = "norm",
    method: str = "block",
    left_block: int = 1024,
    right_block: int = 4096,
    prune: dict | None = None,
) -> DataFrame:
    """Top-k right rows per (key, left row) by cosine; ties -> lower right id.

    Returns ``key..., l_id, r_id, cos`` (cos quantised).  ``norm`` columns
    must hold the vectors' L2 norms (precomputed once per row).

    ``prune`` (block path; ``{alpha, beta, gamma, tokens, ntok, nlen}``
    column names for both sides) adds each pair's ``jac`` and ``most`` (what
    the Indel term can add) and drops top-k rows that provably cannot win the
    matcher's blended score, see :func:`_bounded_topk`.  With ``ids`` a right
    row stands for several of equal vector and text: the column holds their
    ids, rising, ``k + 1`` at most; all of them count in the cut after ``k``
    rows, the lowest (``right_id``) is returned.
    """
    if method not in ("block", "expr"):
        raise ValueError("method must be 'block' or 'expr'")
    extra = []
    # the winner of a top 1 needs no bounds: nothing could be pruned before it
    if prune is not None and method == "block" and k > 1:
        extra = [F.col(prune["tokens"]).alias("_tok"), F.col(prune["ntok"]).alias("_ntok"), F.col(prune["nlen"]).alias("_nlen")]
    else:
        prune = None
    l = left.select(*key, F.col(left_id).cast("long").alias("_lid"), F.col(vec).alias("_vec"), F.col(norm).alias("_norm"), *extra)
    r = right.select(
        *key, F.col(right_id).cast("long").alias("_rid"), F.col(vec).alias("_vec"), F.col(norm).alias("_norm"), *extra,
        *([F.col(prune["ids"]) if prune.get("ids") else F.array(F.col(right_id).cast("long"))] if prune is not None else []),
    )
    ship_package(left.sparkSession)
    if prune is not None:
        r = r.withColumnRenamed(r.columns[-1], "_ids")
        return _bounded_topk(l, r, _sizes(l, r, key), key, k, left_block, right_block, prune)
    if k <= _CLASS_K:
        return _topk_by_vector(l, r, key, k, method, left_block, right_block)
    scored = _scored(l, r, _sizes(l, r, key), key, k, method, left_block, right_block)
    # the literal bound plans a partial WindowGroupLimit before the shuffle
    w = Window.partitionBy(*key, "l_id").orderBy(F.desc("cos"), F.asc("r_id"))
    return scored.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k).drop("_rk")


def _sizes(l: DataFrame, r: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both sides per key value (editions, levels, one constant)."""
    nl = l.groupBy(*key).agg(F.count(F.lit(1)).alias("_nl"), F.max(F.size("_vec")).alias("_wide"))
    nr = r.groupBy(*key).agg(F.count(F.lit(1)).alias("_nr"))
    return nl.join(nr, key)


def _tile_rows(sizes: DataFrame, left_block: int, right_block: int, l: DataFrame, k: int) -> tuple[int, int]:
    """Rows of a tile's sides.  A row is shuffled once for each block of the
    other side, so tiles are as large as memory and an even load allow: two
    for each shuffle partition, never smaller than the given blocks."""
    pairs, wide, _ = _extent(sizes)
    n_parts = int(l.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fits = _TILE_BYTES // (4 * max(int(wide or 1), 1)) // (4 if "_tok" in l.columns else 1)
    side = int(min(fits, ((pairs or 0) / (2 * n_parts)) ** 0.5))
    return max(left_block, min(side, _TILE_OUT // k)), max(right_block, side)


def _extent(sizes: DataFrame) -> tuple:
    """Pairs of all groups, the widest left vector, most right rows of a group."""
    return tuple(sizes.agg(F.sum(F.col("_nl").cast("double") * F.col("_nr")), F.max("_wide"), F.max("_nr")).first())


def _block_plan(sizes: DataFrame, key: list[str], left_rows: int, right_rows: int) -> DataFrame:
    # one row per key value: broadcast
    return F.broadcast(
        sizes.select(
            *key,
            F.greatest(F.lit(1), F.ceil(F.col("_nl") / left_rows)).cast("int").alias("_bl"),
            F.greatest(F.lit(1), F.ceil(F.col("_nr") / right_rows)).cast("int").alias("_br"),
        )
    )


def _key_types(l: DataFrame, key: list[str]) -> tuple[list, str]:
    fields = {f.name: f.dataType for f in l.schema.fields}
    return [to_arrow_type(fields[c]) for c in key], "".join(f"{c} {fields[c].simpleString()}, " for c in key)


def _scored(l, r, sizes, key, k, method, left_block, right_block) -> DataFrame:
    """``key..., l_id, r_id, cos`` of the pairs that tiles return."""
    if method == "expr":
        return _scored_expr(l, r, sizes, key, k, left_block, right_block)
    plan = _block_plan(sizes, key, *_tile_rows(sizes, left_block, right_block, l, k))
    lt, rt = _tiles(l, r, plan, key)
    tile = [*key, "_tl", "_tr"]
    types, keys_ddl = _key_types(l, key)
    fn = _top_fn(k, list(key), types)
    pairs = lt.groupBy(*tile).cogroup(rt.groupBy(*tile)).applyInArrow(fn, f"{keys_ddl}l_id long, r_id long, cos double")
    return pairs.withColumn("cos", quantise("cos"))


# A pair costs more in Catalyst than in a matrix product: smaller tiles, dealt
# more evenly.
_EXPR_TILES = 8
_EXPR_ROWS = 64
# Terms of one sum of the generated dot product.
_TERMS = 64


def _numbers(side: DataFrame, mark: str, wide: int) -> DataFrame:
    """Vectors as columns of numbers that are never null (``<mark>0``...).
    ``<mark>len`` is the length; a vector with a null in it equals no other in
    length, as its dot products are null."""
    # as text: a call for each number and side would take seconds
    length = f"CASE WHEN exists(_vec, x -> x IS NULL) THEN {-1 if mark == '_q' else -2} ELSE size(_vec) END AS {mark}len"
    number = [f"coalesce(CAST(get(_vec, {i}) AS DOUBLE), 0D) AS {mark}{i}" for i in range(wide)]
    kept = [f"`{c}`" for c in side.columns if c not in ("_vec", "_norm")]
    return side.selectExpr(*kept, f"_norm AS {mark}norm", length, *number)


def _raw_cosine(wide: int):
    """:func:`cosine` of a pair of :func:`_numbers` rows, before it is rounded.
    The dot product is written out: generated code in place of lambdas that
    are interpreted for each number of each pair."""
    sums = [" + ".join(["0D", *(f"_q{i} * _c{i}" for i in range(at, min(at + _TERMS, wide)))]) for at in range(0, wide, _TERMS)]
    dot = " + ".join(f"({x})" for x in sums) or "0D"
    return F.expr(f"coalesce(CASE WHEN _qnorm * _cnorm > 0 AND _qlen = _clen THEN ({dot}) / (_qnorm * _cnorm) END, 0D)")


def _scored_expr(l, r, sizes, key, k, left_block, right_block) -> DataFrame:
    """The pairs of a Catalyst-only top-k, no less than the ``k`` best of each
    left row.  The cosine of every pair is computed.  A bound sorts out most
    of them before they are rounded, shuffled and sorted: the k-th highest of
    the maxima of ``4 k`` disjoint groups of right rows, taken from a part of
    the right side (see :func:`_every`)."""
    pairs, wide, most = _extent(sizes)
    wide = max(int(wide or 0), 0)
    n_parts = int(l.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    even = int(((pairs or 0) / (_EXPR_TILES * n_parts)) ** 0.5)
    fits = max(1, _TILE_BYTES // (8 * max(wide, 1)))
    plan = _block_plan(sizes, key, *(min(fits, max(even, min(block, _EXPR_ROWS))) for block in (left_block, right_block)))
    tile = [*key, "_tl", "_tr"]
    raw = _raw_cosine(wide)

    def scored(lt: DataFrame, rt: DataFrame) -> DataFrame:
        q = _numbers(lt, "_q", wide).withColumnRenamed("_lid", "l_id")
        return q.join(_numbers(rt, "_c", wide).withColumnRenamed("_rid", "r_id"), tile)

    bounded = l.withColumn("_bound", F.lit(None).cast("double"))
    every = _every(F.col("_nr"), k)
    if (most or 0) >= 100 * k:
        part = r.join(F.broadcast(sizes.select(*key, every.alias("_every"))), key)
        part = part.filter((F.col("_every") > 1) & (F.pmod(F.xxhash64("_rid", F.lit(1)), F.col("_every")) == 0)).drop("_every")
        group = F.pmod(F.xxhash64("_rid", F.lit(2)), F.lit(4 * k)).alias("_g")
        lt, rt = _tiles(l, part, plan.withColumn("_br", F.lit(1)), key)
        best = scored(lt, rt.withColumn("_g", group)).groupBy(*tile, "l_id", "_g").agg(F.max(raw).alias("_m"))
        w = Window.partitionBy(*tile, "l_id").orderBy(F.desc("_m"))
        best = best.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") == k)
        best = best.select(*key, F.col("l_id").alias("_lid"), F.col("_m").alias("_bound"))
        bounded = l.join(best, [*key, "_lid"], "left")
    near = scored(*_tiles(bounded, r, plan, key)).select(*key, "l_id", "r_id", "_bound", raw.alias("cos"))
    near = near.filter(F.col("_bound").isNull() | (F.col("cos") >= F.col("_bound") - 10.0 ** (-SCORE_DIGITS + 1)))
    return near.select(*key, "l_id", "r_id", quantise("cos").alias("cos"))


def _every(n, k: int):
    """One of how many right rows is read for the bound: about ``0.8 sqrt(k n)``
    of ``n``, which weighs their pairs (aggregated, so dearer) against the pairs
    that the bound leaves.  One of one means none: too few to bound anything."""
    return F.when(n >= 100 * k, F.floor(F.sqrt(n / F.lit(float(k))) * 1.25)).otherwise(1)


def _vector_classes(side: DataFrame, key: list[str], mark: str, name: str) -> tuple[DataFrame, DataFrame]:
    """The distinct (key, vector, norm) with a number ``<mark>``, and each row's
    id with its number.  Rows are joined on a hash and then compared: as a key of
    a sort a vector would be made comparable anew for each comparison."""
    side = side.withColumn("_h", F.xxhash64("_vec"))
    classes = side.select(*key, "_h", "_vec", "_norm").distinct()
    # numbered and written once: the number must not change between readers
    classes = parquet_table(classes.withColumn(mark, F.monotonically_increasing_id()), name)
    theirs = classes.select(*[F.col(c).alias(f"_k_{c}") for c in [*key, "_h", "_vec", "_norm"]], F.col(mark).alias("_c"))
    same = (F.col("_h") == F.col("_k__h")) & F.col("_norm").eqNullSafe(F.col("_k__norm"))
    for c in key:
        same = same & (F.col(c) == F.col(f"_k_{c}"))
    none = F.col("_vec").isNull() | F.col("_k__vec").isNull()
    same = same & F.when(none, F.col("_vec").isNull() & F.col("_k__vec").isNull()).otherwise(F.col("_vec") == F.col("_k__vec"))
    return classes.drop("_h"), side.join(theirs, same).select(*key, mark, "_c")


def _topk_by_vector(l: DataFrame, r: DataFrame, key: list[str], k: int, method: str, left_block: int, right_block: int) -> DataFrame:
    """Top-k where rows of equal vectors are compared once.  On the right a
    class of equal vectors is known by its lowest ids, no more than ``k`` of
    them: a class outside the first ``k`` by (cosine, lowest id) has ``k`` rows
    before all of its own.  On the left all rows of a class get its result."""
    rc, members = _vector_classes(r, key, "_rid", "right-vectors")
    lc, of = _vector_classes(l, key, "_lid", "left-vectors")
    by = Window.partitionBy(*key, "_c").orderBy("_rid")
    members = members.withColumn("_m", F.row_number().over(by)).filter(F.col("_m") <= k)
    members = members.groupBy(*key, F.col("_c").alias("r_id")).agg(F.array_sort(F.collect_list("_rid")).alias("_ids"), F.min("_rid").alias("_low"))
    ids = parquet_table(members, "right-ids")
    if method == "block":  # its tiles cut ties by the lowest id
        rc = rc.join(ids.select(*key, F.col("r_id").alias("_rid"), "_low"), [*key, "_rid"])
    pairs = _scored(lc, rc, _sizes(lc, rc, key), key, k, method, left_block, right_block)
    first = Window.partitionBy(*key, "l_id")
    # a tile's rows are few for each class: cut by cosine (ties stay) before ids are joined
    near = pairs.withColumn("_rk", F.rank().over(first.orderBy(F.desc("cos")))).filter(F.col("_rk") <= k).drop("_rk")
    near = near.join(ids, [*key, "r_id"]).withColumn("_rk", F.row_number().over(first.orderBy(F.desc("cos"), F.asc("_low")))).filter(F.col("_rk") <= k)
    top = near.select(*key, "l_id", "cos", F.explode("_ids").alias("r_id"))
    top = top.withColumn("_rk", F.row_number().over(first.orderBy(F.desc("cos"), F.asc("r_id")))).filter(F.col("_rk") <= k)
    top = top.select(*[F.col(c).alias(f"_k_{c}") for c in key], F.col("l_id").alias("_c"), "r_id", "cos")
    of = of.select(*key, F.col("_lid").alias("l_id"), F.col("_c").alias("_lc"))
    out = of.join(top, F.col("_lc") == F.col("_c")).select(*key, "l_id", "r_id", "cos")
    # ids on the left may repeat: the k best are those of the id
    w = Window.partitionBy(*key, "l_id").orderBy(F.desc("cos"), F.asc("r_id"))
    return out.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k).drop("_rk")


def _tiles(l: DataFrame, r: DataFrame, plan: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt to their tiles.  Tiles are CPU-heavy but small in
    bytes: AQE would coalesce their shuffle into a few tasks.  An explicit
    partition count (the cluster's shuffle parallelism) keeps one tile per task
    slot; the cogroups reuse this partitioning, so no further exchange comes."""
    n_parts = int(l.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lt = l.join(plan, key).select(
        *l.columns,
        F.pmod(F.xxhash64("_lid"), F.col("_bl")).cast("int").alias("_tl"),
        F.explode(F.sequence(F.lit(0), F.col("_br") - 1)).alias("_tr"),
    )
    rt = r.join(plan, key).select(
        *r.columns,
        F.explode(F.sequence(F.lit(0), F.col("_bl") - 1)).alias("_tl"),
        F.pmod(F.xxhash64("_rid"), F.col("_br")).cast("int").alias("_tr"),
    )
    tile = [*key, "_tl", "_tr"]
    return lt.repartition(n_parts, *tile), rt.repartition(n_parts, *tile)


def _bounded_topk(l: DataFrame, r: DataFrame, sizes: DataFrame, key: list[str], k: int, left_block: int, right_block: int, prune: dict) -> DataFrame:
    """The pairs of the top-k that can win, found by a bound that travels
    between the tiles (threshold algorithm).

    A seed round finds for each query a blended score it surely has in its top
    ``k``.  The second round emits only pairs that can reach it, and counts
    the rows whose cosine alone would allow it.  With no more than ``k`` of
    those, every pair that can win is among the top ``k`` whatever the others
    are, and the query is settled.  For the other queries a third round counts
    the rows that come before each of the pairs left.  Vectors are shuffled to
    the tiles, scores are not, nor the ``k`` nearest rows of a query."""
    tile = [*key, "_tl", "_tr"]
    types, keys_ddl = _key_types(l, key)
    plan = _block_plan(sizes, key, *_tile_rows(sizes, left_block, right_block, l, 1))
    lt, rt = _tiles(l, r, plan, key)
    right = rt.groupBy(*tile)
    seeds = lt.groupBy(*tile).cogroup(right).applyInArrow(
        _seed_fn(list(key), types, prune), keys_ddl + "l_id long, r_id long, cos double, score double, n long"
    )
    # surely in the top k: one of the nearest classes overall, and fewer than k rows before it
    w = Window.partitionBy(*key, "l_id").orderBy(F.desc("cos"), F.asc("r_id"))
    seeds = seeds.withColumn("cos", quantise("cos")).withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= _SEEDS)
    past = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seeds = seeds.withColumn("_past", past).where(F.col("_past") < k)
    best = seeds.groupBy(*key, F.col("l_id").alias("_lid")).agg(F.max("score").alias("_lb"))
    bounded, _ = _tiles(l.join(best, [*key, "_lid"]), r, plan, key)
    pairs = bounded.groupBy(*tile).cogroup(right).applyInArrow(
        _bounded_fn(k, list(key), types, prune), keys_ddl + "l_id long, r_id long, cos double, jac double, most double, near long"
    )
    pairs = parquet_table(pairs, "bounded-pairs")
    near = pairs.where("r_id is null").groupBy(*key, "l_id").agg(F.sum("near").alias("near"))
    open_ids = near.where(F.col("near") > k).select(*key, "l_id")
    left_over = pairs.where("r_id is not null").select(*key, "l_id", "r_id", quantise("cos").alias("cos"), "jac", "most")
    settled = left_over.join(open_ids, [*key, "l_id"], "left_anti")
    if not open_ids.limit(1).count():
        return settled
    asked = left_over.join(open_ids, [*key, "l_id"], "left_semi")
    asked = asked.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k).drop("_rk")
    nano = F.round(F.col("cos") * 10.0**SCORE_DIGITS).cast("long")
    wanted = asked.select(*key, "l_id", "r_id", nano.alias("c")).distinct().groupBy(*key, F.col("l_id").alias("_lid")).agg(
        F.sort_array(F.collect_list(F.struct("c", "r_id")), asc=False).alias("_s")
    )
    vectors = l.select(*key, "_lid", "_vec", "_norm").join(wanted.select(*key, "_lid", F.col("_s.c").alias("_sc"), F.col("_s.r_id").alias("_si")), [*key, "_lid"])
    lo, ro = _tiles(vectors, r.select(*key, "_rid", "_vec", "_norm", "_ids"), plan, key)
    ranks = lo.groupBy(*tile).cogroup(ro.groupBy(*tile)).applyInArrow(_rank_fn(list(key), types), keys_ddl + "l_id long, r_id long, before long")
    inside = ranks.groupBy(*key, "l_id", "r_id").agg(F.sum("before").alias("before")).where(F.col("before") < k).drop("before")
    return settled.unionByName(asked.join(inside, [*key, "l_id", "r_id"], "left_semi"))


def _scan_fn(ids: np.ndarray, vecs: np.ndarray, norms: np.ndarray, k: int, rows: int = 4096):
    margin = 10.0 ** (-SCORE_DIGITS + 1)

    def fn(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                cv = _dense(pa.chunked_array([b.column(1)]), b.num_rows)
                d = max(cv.shape[1], vecs.shape[1])
                qv = np.pad(vecs, ((0, 0), (0, d - vecs.shape[1])))
                cv = np.pad(cv, ((0, 0), (0, d - cv.shape[1])))
                den = np.outer(norms, np.nan_to_num(b.column(2).to_numpy(zero_copy_only=False).astype(np.float64)))
                dots = qv @ cv.T
                cos = np.divide(dots, den, out=np.zeros_like(dots), where=den > 0)
                n = b.num_rows
                # ties after quantisation stay; the exact cut is made in Spark
                keep = cos >= np.partition(cos, n - k, axis=1)[:, n - k][:, None] - margin if n > k else np.ones(cos.shape, bool)
                qi, ci = np.nonzero(keep)
                r_ids = b.column(0).to_numpy(zero_copy_only=False)
                yield pa.record_batch([pa.array(ids[qi]), pa.array(r_ids[ci]), pa.array(cos[qi, ci])], names=["l_id", "r_id", "cos"])

    return fn


def cosine_topk_scan(left: DataFrame, right: DataFrame, k: int, left_id: str, right_id: str, most: int = 2048) -> DataFrame | None:
    """:func:`cosine_topk` of one group for at most ``most`` left rows, which
    travel with the tasks: the right side is scored where it lies and only its
    top rows are shuffled.  None if there are more left rows than that."""
    few = left.select(F.col(left_id).cast("long"), "embedding", "norm").limit(most + 1).collect()
    if len(few) > most or not few:
        return None
    width = max(len(r[1] or ()) for r in few)
    vecs = np.zeros((len(few), width))
    for i, r in enumerate(few):
        vecs[i, : len(r[1] or ())] = r[1] or ()
    norms = np.nan_to_num(np.array([np.nan if r[2] is None else r[2] for r in few], np.float64))
    ship_package(left.sparkSession)
    side = right.select(F.col(right_id).cast("long").alias("_rid"), "embedding", "norm")
    scored = side.mapInArrow(_scan_fn(np.array([r[0] for r in few], np.int64), vecs, norms, k), "l_id long, r_id long, cos double")
    w = Window.partitionBy("l_id").orderBy(F.desc("cos"), F.asc("r_id"))
    return scored.withColumn("cos", quantise("cos")).withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k).drop("_rk")
