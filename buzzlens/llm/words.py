"""Words of Arrow text columns as numpy arrays.

A word is a maximal run of bytes other than space, tab, LF, VT, FF and CR, which
in UTF-8 is the same as ``[^\\x20\\x09-\\x0D]+`` on characters. Whole batches are
split and hashed with array operations; no Python object is made per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


BASE = np.uint64(0x9E3779B97F4A7C15)
LOWEST = np.array([256**k - 1 for k in range(9)], np.uint64)  # masks of the first k bytes
# Multipliers of two independent window hashes.
ROLLS = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD1342543DE82EF95))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all bits (a bijection of 64-bit numbers)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text or binary column and the offset of each row in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(at):
        at = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """Words of several documents: word ``k`` is ``data[start[k]:end[k]]`` in ``doc[k]``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # first word of each document, and the number of words at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        # The eight bytes from every place on, as one number.
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eights = np.ndarray((len(self.data) + 1,), "<u8", padded, 0, (1,))
        total = length.astype(np.uint64)
        active = np.arange(len(length))
        for k in range(0, int(length.max()), 8):
            active = active[length[active] > k] if k else active
            left = np.minimum(length[active] - k, 8)
            total[active] = mixed(total[active] * BASE + (eights[self.start[active] + k] & LOWEST[left]))
        return total

    def window_starts(self, size: int) -> np.ndarray:
        """Words at which a run of ``size`` words of one document starts."""
        n = max(0, len(self.doc) - size + 1)
        return np.flatnonzero(self.doc[:n] == self.doc[len(self.doc) - n :])


def window_hashes(hashed: np.ndarray, at: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of the ``size`` words from each of ``at``; ``which`` picks one of two hashes."""
    n = len(hashed) - size + 1
    if n <= 0 or not len(at):
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, lift in enumerate(powers(ROLLS[which], size)):
        total += hashed[k : k + n] * lift
    return mixed(total[at])


def split_words(column: pa.Array | pa.ChunkedArray) -> Words:
    """Words of each text of ``column``."""
    data, offsets = text_buffers(column)
    inside = ~_IS_SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    before[edges] = False  # a document's first byte starts a word whatever came before it
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[(offsets[1:] - 1)[np.diff(offsets) > 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, offsets, start, end, doc, first)


def kept_texts(words: Words, keep: np.ndarray) -> pa.Array:
    """Each document's words marked in ``keep``, joined by one space."""
    data = words.data.copy()
    chosen = np.flatnonzero(keep)
    doc, size = words.doc[chosen], words.end[chosen] - words.start[chosen]
    followed = np.zeros(len(chosen), bool)
    followed[:-1] = doc[:-1] == doc[1:]  # another kept word follows: there is a space to use
    data[words.end[chosen[followed]]] = SPACES[0]
    size += followed
    # Byte numbers of all kept words and their spaces, one after another.
    stop = np.cumsum(size)
    lead = np.ones(int(stop[-1]) if len(stop) else 0, np.int32)
    if len(stop):
        begin = words.start[chosen]
        lead[0] = begin[0]
        lead[stop[:-1]] = begin[1:] - (begin[:-1] + size[:-1]) + 1
    ends = np.concatenate([[0], stop])[np.searchsorted(chosen, words.first)]
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(),
        len(ends) - 1,
        [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[np.cumsum(lead, dtype=np.int64)])],
    )
