"""Removal of repeated passages by level-wise doubling.

A window is `window` consecutive words of a document. A word goes if a window that covers it has a word sequence that
also starts in a document with a smaller id; windows are judged on the input.

Levels: runs of `seed` words first. Of the runs within each window only the one with the least hash is looked at (equal
windows pick equal runs), so about 2 in window - seed + 2 positions of the corpus become rows. Runs that occur in two
documents at least survive; windows around survivors alone are extended to runs of twice the length, and so on, until the
length is that of the window or nothing survives. The last level takes every window around a survivor and finds the
smallest document of each.

What is shuffled: the picked runs (hash, id) twice, each text once compressed, then only texts with survivors, and
(hash, id) of windows around survivors twice. Minima are aggregated before shuffles, so a passage that a third of all
documents share is one row a task there; the joins that bring survivors back to documents are plain equality joins that
adaptive execution splits. Lists are gathered by document and are no longer than the document. Hashes have 64 bits:
among n candidate windows about n^2 / 2^65 pairs are taken for equal though they differ.

Defined cases: null and empty texts have no words and keep nothing (the hash of no bytes); a null id is smaller than none
and larger than none, so its document is kept whole and removes nothing; rows that share an id count as one document for
"smaller" and are cleaned each by itself; documents shorter than a window are kept; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .vectext import Words, inside, ints, mix, windows, words

WINDOW = 50
SEED = 25


def least(x: np.ndarray, k: int) -> np.ndarray:
    """Minima of all runs of k values, by doubling."""
    size = 1
    while 2 * size <= k:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (k - size)], x[k - size :]) if size < k else x


def picked(w: Words, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of windows within a row, hash of the picked run of `length` words in each)."""
    if len(w.doc) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(inside(w.doc, window))
    # mixed again: what is least must not depend on what the hash of a run means
    runs = windows(w.hash, length)
    return at, least(mix(runs + np.uint64(length)), window - length + 1)[at]


def _distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs without repeats. Neighbouring windows mostly pick the same run."""
    if not len(h):
        return doc, h
    new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
    doc, h = doc[new], h[new]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
    return doc[new], h[new]


def _first_level(length: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in words(b.column(1), False):
                at, h = picked(w, length, window)
                doc, h = _distinct(w.doc[at], h)
                yield pa.record_batch([ints(h), b.column(0).take(pa.array(doc + w.row))], ["h", "id"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.record_batch([b.column(0), pa.array([z.compress((t.as_py() or "").encode()) for t in b.column(1)], pa.binary())], ["id", "z"])


def _unpacked(b: pa.RecordBatch) -> Iterator[tuple[int, int, pa.Array]]:
    """(lo, hi, texts) of slices of a batch of compressed texts."""
    z = zstandard.ZstdDecompressor()
    for lo in range(0, b.num_rows, 256):
        rows = b.column("z").slice(lo, 256)
        yield lo, lo + len(rows), pa.array([z.decompress(x.as_py()) for x in rows], pa.large_binary())


def _around(w: Words, lists: pa.Array, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, rows) of the windows whose picked run is in the row's list."""
    at, h = picked(w, length, window)
    doc = w.doc[at]
    keep = np.zeros(len(at), bool)
    first = np.searchsorted(doc, np.arange(w.rows + 1))
    for i in range(w.rows):
        a, e = first[i], first[i + 1]
        if e > a:
            found = np.asarray(lists[w.row + i].values, dtype=np.int64).view(np.uint64)
            keep[a:e] = np.isin(h[a:e], found)
    return at[keep], doc[keep]


def _next_level(before: int, length: int, window: int):
    """Rows (h, id): picked runs of the next length, or hashes of whole windows at the last level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in _unpacked(b):
                lists = b.column("found").slice(lo, hi - lo)
                for w in words(texts, False):
                    at, doc = _around(w, lists, before, window)
                    if length == window:
                        h = windows(w.hash, window)[at] if len(at) else np.zeros(0, np.uint64)
                    else:
                        every, g = picked(w, length, window)
                        h = g[np.searchsorted(every, at)]
                    doc, h = _distinct(doc, h)
                    yield pa.record_batch([ints(h), b.column("id").take(pa.array(doc + w.row + lo))], ["h", "id"])

    return run


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words the windows at starts cover."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + window, n), -1)
    return np.cumsum(d[:-1]) > 0


def _cleaned(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in _unpacked(b):
                gone, kept, sha, own_sha = [], [], [], []
                lists = b.column("gone").slice(lo, hi - lo)
                for w in words(texts, False):
                    h = windows(w.hash, window)
                    for i in range(w.rows):
                        a, e = int(w.first[i]), int(w.first[i + 1])
                        own = h[a : max(a, e - window + 1)]
                        bad = np.asarray(lists[w.row + i].values, dtype=np.int64).view(np.uint64)
                        out = covered(e - a, np.flatnonzero(np.isin(own, bad)), window)
                        raw = texts[w.row + i].as_py()
                        own_sha.append(hashlib.sha256(raw).digest()[:16])
                        parts = raw.split()
                        text = b" ".join([parts[k] for k in np.flatnonzero(~out)])
                        gone.append(int(out.sum()))
                        kept.append(text)
                        sha.append(hashlib.sha256(text).hexdigest())
                yield pa.record_batch([b.column("id").slice(lo, hi - lo), pa.array(own_sha, pa.binary()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())],
                                      ["id", "sha", "n_removed", "kept_sha256", "kept"])

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, sha, own = [], [], []
        for t in b.column(1):
            raw = (t.as_py() or "").encode()
            parts = raw.split()
            n.append(len(parts))
            sha.append(hashlib.sha256(b" ".join(parts)).hexdigest())
            own.append(hashlib.sha256(raw).digest()[:16])
        yield pa.record_batch([b.column(0), pa.array(own, pa.binary()), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["id", "sha", "n_words", "whole_sha256"])


def repeated(rows: DataFrame) -> DataFrame:
    """(h, low): hashes that two ids at least have, with the smallest. Stored, so that both sides of a join with it are
    plain exchanges, of which adaptive execution splits the one with a passage that very many documents share."""
    return stored(rows.groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("h", "low"), "repeated")


def lengths(seed: int, window: int) -> list[int]:
    out = [seed]
    while 2 * out[-1] < window:
        out.append(2 * out[-1])
    return [*out, window] if out[-1] < window else out


def removals(docs: DataFrame, window: int = WINDOW, seed: int = SEED, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts with survivors as (id, z), removals as (id, gone): the hashes of windows that go from a document)."""
    if not 1 <= seed < window:
        raise ValueError("a seed is shorter than the window")
    d = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null")
    kind = d.schema["id"].dataType.simpleString()
    levels = lengths(seed, window)
    rows = d.mapInArrow(_first_level(levels[0], window), f"h bigint, id {kind}")
    # a text travels once, compressed; its own hash tells rows apart that share an id
    packed = d.mapInArrow(_packed, f"id {kind}, z binary")
    texts = None
    for before, length in zip(levels, levels[1:], strict=False):
        found = rows.join(repeated(rows), "h").groupBy("id").agg(F.collect_set("h").alias("found"))
        texts = stored((packed if texts is None else texts.drop("found")).join(found, "id"), "texts")
        rows = texts.mapInArrow(_next_level(before, length, window), f"h bigint, id {kind}")
    gone = rows.join(repeated(rows), "h").where("id > low").groupBy("id").agg(F.collect_set("h").alias("gone"))
    return texts.select("id", "z"), gone


def deduplicate(docs: DataFrame, window: int = WINDOW, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept_sha256, kept) of each row; kept, the remaining words as UTF-8 joined by one space,
    is null where nothing was removed."""
    d = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    whole = d.mapInArrow(_whole, f"id {kind}, sha binary, n_words bigint, whole_sha256 string")
    texts, gone = removals(docs, window, seed, key, text)
    changed = texts.join(gone, "id").mapInArrow(_cleaned(window), f"id {kind}, sha binary, n_removed bigint, kept_sha256 string, kept binary").dropDuplicates(["id", "sha"])
    return whole.join(changed, ["id", "sha"], "left").select(
        F.col("id").alias(key), "n_words", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"), "kept")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP6_SQL = """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i + 49], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w)),
low as (select k, min(doc_id) as m from win group by k),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as j from win join low using (k) where m < doc_id),
word as (select doc_id, unnest(ws) as x, unnest(range(1, len(ws) + 1)) as j from w),
kept as (select word.doc_id, string_agg(x, ' ' order by word.j) as t, count(*) as n
         from word left join gone on gone.doc_id = word.doc_id and gone.j = word.j where gone.j is null group by word.doc_id)
select w.doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept on w.doc_id = kept.doc_id
"""


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """The definition itself, for tests with distinct ids."""
    first: dict[tuple[bytes, ...], int] = {}
    split = {i: (t or "").encode().split() for i, t in rows}
    for i, w in split.items():
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            first[s] = min(first.get(s, i), i)
    out = {}
    for i, w in split.items():
        bad = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                bad.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in bad)
        out[i] = (len(w), len(bad), hashlib.sha256(kept).hexdigest())
    return out
