"""Whole Arrow batches of texts as numpy arrays of words and word hashes, without a Python step per word.

A text is its UTF-8 bytes. Words are maximal runs of bytes that aren't separators and never cross rows. The hash of a
word is a polynomial over a random table of its bytes, finished by a 64-bit mixer; folding A-Z is a matter of the table.
Polynomials modulo 2^64 can agree for unequal words of a thousand letters or more whatever the base, so words of over
LONG bytes are hashed by BLAKE2. Null texts count as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
M1, M2, M3 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
BASE = U(0x2545F4914F6CDD1D)
#: Bytes of text that are worked on at a time; a longer text is a piece of its own.
PIECE = 1 << 20
#: Bytes up to which a word's hash is a polynomial.
LONG = 64
_FOLD = {True: bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)), False: bytes(range(256))}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher: a bijection of 64-bit values."""
    x = (x ^ (x >> U(30))) * M1
    x = (x ^ (x >> U(27))) * M2
    return x ^ (x >> U(31))


def _byte_table(fold: bool) -> np.ndarray:
    t = mix((np.arange(256, dtype=U) + U(1)) * M3)
    if fold:
        t[65:91] = t[97:123]
    return t


def _separators(spare: str) -> np.ndarray:
    sep = np.zeros(256, bool)
    if spare == "space":  # space, tab, line ends, vertical tab, form feed
        sep[[32, *range(9, 14)]] = True
    else:  # all of ASCII but letters and digits
        sep[:128] = True
        for a, b in ((48, 58), (65, 91), (97, 123)):
            sep[a:b] = False
    return sep


TABLES = {fold: _byte_table(fold) for fold in (False, True)}
SEPARATORS = {kind: _separators(kind) for kind in ("space", "alnum")}
_powers = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 64)
        _powers = np.concatenate([np.ones(1, U), np.cumprod(np.full(size, BASE, U))])
    return _powers


class Words(NamedTuple):
    row: int  # first row of the piece in its batch
    rows: int
    buf: np.ndarray  # uint8
    offs: np.ndarray  # rows + 1 byte offsets into buf
    start: np.ndarray  # of words, bytes
    end: np.ndarray
    doc: np.ndarray  # row of each word, from the piece's first
    hash: np.ndarray  # uint64
    first: np.ndarray  # rows + 1: the words of row i are first[i]:first[i+1]


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array and the rows' offsets."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
        empty = ""
    else:
        col = col.cast(pa.large_binary())
        empty = b""
    if col.null_count:
        col = col.fill_null(empty)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def words_of(buf: np.ndarray, offs: np.ndarray, fold: bool, sep: str = "space", row: int = 0) -> Words:
    n, rows = len(buf), len(offs) - 1
    gap = SEPARATORS[sep][buf]
    before, after = np.empty(n, bool), np.empty(n, bool)
    if n:
        before[0] = after[-1] = True
        before[1:], after[:-1] = gap[:-1], gap[1:]
        inner = offs[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        before[inner] = True
        after[inner - 1] = True
    solid = ~gap
    start, end = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    doc = np.searchsorted(offs, start, side="right") - 1
    if len(start):
        x = TABLES[fold][buf]
        x[gap] = 0
        lengths = np.diff(np.append(start, n))
        at = np.arange(start[0], n) - np.repeat(start, lengths)
        at[gap[start[0] :]] = 0
        x = x[start[0] :]
        x *= powers(int(at.max()) + 1)[at]
        h = mix(np.add.reduceat(x, start - start[0]) + (end - start).astype(U) * M3)
        for i in np.flatnonzero(end - start > LONG):
            h[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes().translate(_FOLD[fold]), digest_size=8).digest(), "little")
    else:
        h = np.zeros(0, U)
    first = np.searchsorted(doc, np.arange(rows + 1))
    return Words(row, rows, buf, offs, start, end, doc, h, first)


def words(col: pa.Array, fold: bool, sep: str = "space", piece: int = PIECE) -> Iterator[Words]:
    """The words of a column, in pieces of whole rows."""
    buf, offs = text_buffers(col)
    lo, rows = 0, len(offs) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + piece, side="right")) - 1)
        hi = min(hi, rows)
        yield words_of(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], fold, sep, lo)
        lo = hi


def joined(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """An ordered combination of two arrays of hashes."""
    return mix(a * M3 + (b ^ (b >> U(29))) * BASE + U(salt))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, built by doubling: position i covers i..i+k-1. Runs may cross rows; see inside()."""
    if len(h) < k:
        return np.zeros(0, U)
    size, x = 1, h
    while 2 * size <= k:
        x = joined(x[:-size], x[size:], size)
        size *= 2
    if size < k:  # two overlapping runs cover the rest
        x = joined(x[: len(h) - k + 1], x[k - size : k - size + len(h) - k + 1], k)
    return x


def inside(doc: np.ndarray, k: int) -> np.ndarray:
    """Which runs of k words stay within one row."""
    return doc[: len(doc) - k + 1] == doc[k - 1 :] if len(doc) >= k else np.zeros(0, bool)


def ints(x: np.ndarray) -> pa.Array:
    """uint64 hashes as Spark's bigint."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
