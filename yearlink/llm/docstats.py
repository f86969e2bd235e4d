"""Statistics of whole texts, a batch at a time in numpy.

Each is computed when first asked for and kept for the batch, so that a
cascade of rules pays only for what it looks at.  ``only`` narrows the batch
to some of its texts.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa

from yearlink.llm import common as C
from yearlink.llm.common import U64


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[list(chars)] = 1
    return t


SYMBOL = _table(b"#*$%&|<>")
UPPER = _table(bytes(range(65, 91)))
LETTER = _table(bytes([*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]))  # non-ASCII: the first byte counts
DIGIT = _table(b"0123456789")
MARK = _table(b"!?")
POINT = _table(b".,;:!?")
FIRST_BYTE = 1 - _table(bytes(range(0x80, 0xC0)))


class Stats:
    """Statistics of one Arrow column of texts; null counts as empty."""

    def __init__(self, texts):
        self.texts = texts
        self.n = len(texts)

    def only(self, rows: np.ndarray) -> Stats:
        return Stats(self.texts.take(pa.array(rows)))

    def _per_text(self, flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self._offsets[1:]] - total[self._offsets[:-1]]

    @cached_property
    def words(self) -> C.Words:
        return C.tokenize(self.texts)

    @cached_property
    def _raw(self):
        return C.raw_bytes(self.texts)

    @property
    def _data(self):
        return self._raw[0]

    @property
    def _offsets(self):
        return self._raw[1]

    def count(self, table: np.ndarray) -> np.ndarray:
        return self._per_text(table[self._data])

    @cached_property
    def chars(self) -> np.ndarray:
        return self.count(FIRST_BYTE)

    @cached_property
    def symbols(self) -> np.ndarray:
        return self.count(SYMBOL)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words.first)

    @cached_property
    def word_chars(self) -> np.ndarray:
        """Code points in words: all but the ASCII white space."""
        return self.chars - self.count(C._SPACE.astype(np.uint8))

    def _times(self, hashes: np.ndarray, doc: np.ndarray):
        """Order of the hashes by text, and where each run of equals starts."""
        key = C.mix(hashes ^ C.mix(doc.astype(U64) + U64(1)))
        order = np.argsort(key, kind="stable")
        return order, C.group_starts(key[order])

    @cached_property
    def distinct_words(self) -> np.ndarray:
        w = self.words
        order, starts = self._times(w.hash, w.doc)
        return np.bincount(w.doc[order[starts]], minlength=self.n)

    @cached_property
    def same_as_previous(self) -> np.ndarray:
        w = self.words
        same = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        return np.bincount(w.doc[1:][same], minlength=self.n)

    @cached_property
    def _lines(self):
        """Text and hash of every \\n-split line that has a word."""
        data, offs = self._raw
        w = self.words
        if not len(w.start):
            return np.empty(0, np.int64), np.empty(0, U64)
        cuts = np.unique(np.concatenate((np.flatnonzero(data == 10) + 1, offs)))
        line = np.searchsorted(cuts, w.start, "right") - 1
        first = C.group_starts(line)
        start = cuts[line[first]]
        nxt = np.append(cuts, len(data))[line[first] + 1]
        end = np.where(data[nxt - 1] == 10, nxt - 1, nxt)
        return w.doc[first], C.span_hashes(data, start, end)

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self._lines[0], minlength=self.n)

    @cached_property
    def duplicate_lines(self) -> np.ndarray:
        doc, h = self._lines
        order, starts = self._times(h, doc)
        return self.n_lines - np.bincount(doc[order[starts]], minlength=self.n)

    @cached_property
    def repeated_words(self) -> np.ndarray:
        """Words inside a window of 8 words that the text has twice or more."""
        w = self.words
        at, h = w.windows(8)
        order, starts = self._times(h, w.doc[at])
        sizes = np.diff(np.append(starts, len(h)))
        twice = at[order[np.repeat(sizes > 1, sizes)]]
        cover = np.zeros(len(w.hash) + 1, np.int64)
        cover[twice] += 1
        np.subtract.at(cover, twice + 8, 1)
        return np.bincount(w.doc[np.cumsum(cover[:-1]) > 0], minlength=self.n)
