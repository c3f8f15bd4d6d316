"""Byte-level BPE encoding and decoding by a public rank file.

A text is split by a pattern; each match is encoded by itself. A match of n bytes starts as n single-byte tokens. A
segment tree over its byte positions holds at each leaf the rank of the pair that starts there (none: a sentinel above
all ranks) and at each inner node the smaller of its two children, the left one if they tie; its root is the leftmost
pair of least rank. A merge joins the pair's two tokens and makes three point updates (the pair before, the pair at the
merge, the dead position), each logarithmic in n. Matches of up to 64 bytes, nearly all, are encoded many at a time:
their trees are the rows of one array and all rows merge in step. Longer ones have a tree of their own.

Each distinct match is encoded once as long as a worker's cache of bounded size has it. Nothing is shuffled.

Defined cases: null and empty texts give no ids and empty bytes; decoding takes any list of known ids, an unknown id is
an error; further columns are kept or ignored as the caller selects; very long matches (no spaces at all) cost
n log n.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, table, tidy
from .vectext import text_buffers

#: Distinct matches that a worker's cache holds before it starts anew.
CACHE = 150_000
#: Matches of up to so many bytes are encoded in step.
IN_STEP = 64
NONE = np.int64(1) << 40


class Ranks:
    """The tables of one vocabulary."""

    def __init__(self, lines: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
        self.bytes_of = {i: t for t, i in self.rank.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        keys, values = [], []
        for token, i in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(i)
        order = np.argsort(keys)
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]
        self.cache: dict[str, tuple[int, ...]] = {}

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank (and so id) of each pair, or NONE."""
        key = (left << 32) | right
        if not len(self.keys):  # a vocabulary of bytes alone
            return np.full(np.shape(key), NONE)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def encode_long(self, data: bytes) -> list[int]:
        n = len(data)
        ids = self.byte_id[np.frombuffer(data, np.uint8)].tolist()
        size = 1 << max(1, (n - 1).bit_length())
        none = int(NONE)
        tree = [(none, 0)] * (2 * size)  # (rank, position): tuples compare by rank, then leftmost
        first = np.array(ids, np.int64)
        for i, r in enumerate(self.pairs(first[:-1], first[1:]).tolist()):
            tree[size + i] = (r, i)
        join, rank_of = self.bytes_of, self.rank

        def get(pair: tuple[int, int], default: int) -> int:
            return rank_of.get(join[pair[0]] + join[pair[1]], default)

        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a <= b else b

        def update(i: int, rank: int) -> None:
            k = size + i
            tree[k] = (rank, i)
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                tree[k] = a if a <= b else b
                k >>= 1

        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (top := tree[1])[0] < none:
            rank, i = top
            j = after[i]
            ids[i] = rank
            k = after[i] = after[j]
            ids[j] = -1
            update(j, none)
            if k < n:
                before[k] = i
                update(i, get((rank, ids[k]), none))
            else:
                update(i, none)
            if (h := before[i]) >= 0:
                update(h, get((ids[h], rank), none))
        return [x for x in ids if x >= 0]

    def encode_in_step(self, data: list[bytes]) -> list[tuple[int, ...]]:
        """Matches of 2 to `size` bytes, one tree a row."""
        n = np.array([len(x) for x in data])
        size = 1 << max(1, int(n.max() - 1).bit_length())
        rows = len(data)
        at = np.arange(size)
        raw = np.zeros((rows, size), np.uint8)
        raw[at < n[:, None]] = np.frombuffer(b"".join(data), np.uint8)
        ids = self.byte_id[raw]
        ids[at >= n[:, None]] = -1
        after = np.broadcast_to(at + 1, (rows, size)).copy()
        before = np.broadcast_to(at - 1, (rows, size)).copy()
        # a node is rank * size + position: the smaller one has the lower rank, or is further to the left
        tree = np.full((rows, 2 * size), NONE * size, np.int64)
        live = at[:-1] < n[:, None] - 1
        r = np.full((rows, size - 1), NONE, np.int64)
        r[live] = self.pairs(ids[:, :-1][live], ids[:, 1:][live])
        tree[:, size : 2 * size - 1] = np.where(r < NONE, r * size + at[:-1], NONE * size)
        w = size
        while w > 1:
            tree[:, w // 2 : w] = np.minimum(tree[:, w : 2 * w : 2], tree[:, w + 1 : 2 * w : 2])
            w //= 2

        def update(row: np.ndarray, i: np.ndarray, rank: np.ndarray) -> None:
            k = i + size
            tree[row, k] = np.where(rank < NONE, rank * size + i, NONE * size)
            while k[0] > 1:  # all leaves have one depth
                k = k >> 1
                tree[row, k] = np.minimum(tree[row, 2 * k], tree[row, 2 * k + 1])

        row = np.flatnonzero(tree[:, 1] < NONE * size)
        while len(row):
            top = tree[row, 1]
            rank, i = top // size, top % size
            j = after[row, i]
            k = after[row, j]
            ids[row, i] = rank
            ids[row, j] = -1
            after[row, i] = k
            update(row, j, np.full(len(row), NONE))
            inner = k < n[row]
            nr, ni, nk = row[inner], i[inner], k[inner]
            before[nr, nk] = ni
            right = np.full(len(row), NONE)
            right[inner] = self.pairs(rank[inner], ids[nr, nk])
            update(row, i, right)
            h = before[row, i]
            has = h >= 0
            if has.any():
                hr, hh = row[has], h[has]
                update(hr, hh, self.pairs(ids[hr, hh], rank[has]))
            row = row[tree[row, 1] < NONE * size]
        kept = ids >= 0
        flat, counts = ids[kept].tolist(), kept.sum(1).tolist()
        out, a = [], 0
        for c in counts:
            out.append(tuple(flat[a : a + c]))
            a += c
        return out

    def learn(self, matches: set[str]) -> None:
        """Puts the ids of new matches into the cache."""
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for m in matches:
            data = m.encode()
            whole = self.rank.get(data)  # a match that is a token is that token, whatever its merges
            if whole is not None:
                self.cache[m] = (whole,)
            elif len(data) > IN_STEP:
                self.cache[m] = tuple(self.encode_long(data))
            else:
                groups.setdefault((len(data) - 1).bit_length(), []).append((m, data))
        for group in groups.values():
            for a in range(0, len(group), 8192):
                part = group[a : a + 8192]
                self.cache.update(zip((m for m, _ in part), self.encode_in_step([d for _, d in part]), strict=True))

    def know(self, matches: set[str]) -> None:
        """All of matches are in the cache afterwards."""
        new = matches.difference(self.cache)
        if new:
            if len(self.cache) + len(new) > CACHE:
                self.cache.clear()
                new = matches
            self.learn(new)

    def encode(self, matches: list[str], known: bool = False) -> list[int]:
        if not known:
            self.know(set(matches))
        return list(chain.from_iterable(map(self.cache.__getitem__, matches)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


#: Bytes that a rank file may have, since every executor gets it.
MOST_BYTES = 64 << 20
_loaded: dict[str, Ranks] = {}


def ranks(shipped: tuple[str, Broadcast]) -> Ranks:
    """The vocabulary, loaded once a worker and told apart by its content."""
    digest, data = shipped
    if digest not in _loaded:
        _loaded.clear()
        _loaded[digest] = Ranks(data.value)
    return _loaded[digest]


@cache
def splitter(pattern: str):
    import regex

    return regex.compile(pattern).findall


def groups(texts: pa.Array, size: int = 1 << 20) -> Iterator[int]:
    """Ends of runs of rows that hold about `size` bytes, a row at least."""
    offs = text_buffers(texts)[1]
    lo = 0
    while lo < len(texts):
        lo = min(len(texts), max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, side="right")) - 1))
        yield lo


def ship(spark: SparkSession, path: str) -> tuple[str, Broadcast]:
    """A rank file for the executors; its size is that of a vocabulary, whatever the corpus."""
    bounded_batches(spark)
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"a rank file has at most {MOST_BYTES} bytes")
    return hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data)


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text", decode: bool = True, ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each row; with ids also the ids as token_ids array<int>."""
    shipped = ship(docs.sparkSession, vocabulary)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, split = ranks(shipped), splitter(pattern)
        for b in batches:
            lo = 0
            for hi in groups(b.column(1)):  # matches of a few rows are learnt together, their ids live no longer
                keys, texts = b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo)
                lo = hi
                parts = [split(t or "") for t in texts.to_pylist()]
                r.know(set(chain.from_iterable(parts)))
                counts, shas, decoded, lists = [], [], [], []
                for part in parts:
                    got = r.encode(part, known=True)
                    counts.append(len(got))
                    shas.append(hashlib.sha256(" ".join(map(r.text_of.__getitem__, got)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(r.decode(got)).hexdigest() if decode else None)
                    if ids:
                        lists.append(np.array(got, np.int32))
                cols = [keys, pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
                yield pa.record_batch([*cols, *([pa.array(lists, pa.list_(pa.int32()))] if ids else [])], schema.split("|"))

    schema = "|".join([key, "n_tokens", "ids_sha256", "decoded_sha256", *(["token_ids"] if ids else [])])
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids)


def decode_ids(rows: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """(key, data binary): the bytes of each list of ids; null lists give empty bytes."""
    shipped = ship(rows.sparkSession, vocabulary)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(shipped)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([r.decode(x.as_py() or []) for x in b.column(1)], pa.binary())], [key, "data"])

    return rows.select(key, ids).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, data binary")


VOCABULARY = "byte_bpe_50k.tiktoken"


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
