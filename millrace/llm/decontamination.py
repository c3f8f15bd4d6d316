"""Benchmark decontamination by spaced seeds.

Tokens are runs of letters and digits (A-Z folded, all bytes beyond ASCII are letters), so case and punctuation don't
matter. The rule: a document holds an item if, in some alignment of both, WINDOW consecutive tokens of the item (all of a
shorter one) agree in at least NUM / DEN; tokens beyond the document's ends agree with nothing. Items of fewer than `least`
tokens are no evidence and match nothing.

A seed is a window of tokens seen through a mask that ignores some positions. A window of n tokens may differ in e = n -
ceil(NUM n / DEN) of them. It is cut into blocks, e + 2 of them where e is above 0, and each mask keeps two: whichever e
tokens differ, one mask at least sees none of them, so every alignment that the rule accepts has a seed. Documents are
framed by EDGE tokens that agree with nothing, so windows that reach over their ends have seeds, too. Items of WINDOW
tokens or more are looked up by all their windows, shorter ones by the one of their own length. Hashes of benchmark
windows are joined with hashes of training windows; each hit fixes an alignment, which is verified by the rule.

The scan of the corpus keeps what may hit: a bitmap of fixed size over the benchmark's hashes is broadcast, and if these
are no more than EXACT_ROWS also the hashes themselves; the join that follows is exact in any case. Hits of a document
that lie close together share one row with the tokens around them, so a leaked passage is shuffled once, and documents
without hits never. A passage that very many documents hold is one hash with many rows: the benchmark's side of the join
has it once an item, and adaptive execution splits the other side.

Defined cases: null and empty texts have no tokens; items of equal token sequences are verified once and reported each;
rows of the corpus with one id are reported as one document; a null id is reported as null; an empty corpus or benchmark
gives an empty result; further columns are ignored. Long texts are looked at whole.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import among, row_key, stored, table, tidy
from .vectext import Words, inside, ints, joined, words

U = np.uint64
#: Tokens of a window, and the share of them that must agree.
WINDOW = 13
NUM, DEN = 4, 5
LEAST = 2
#: Tokens that a window may differ in, and reach over an end of a document by.
EDGE = WINDOW - -(-NUM * WINDOW // DEN)
NOTHING = U(0)
BITS = 1 << 26
EXACT_ROWS = 2_000_000


def seeds(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Masked hashes of all windows of len(mask) tokens."""
    n = len(h) - len(mask) + 1
    if n < 1:
        return np.zeros(0, U)
    at = [i for i, c in enumerate(mask) if c == "1"]
    x = h[at[0] : at[0] + n]
    for i in at[1:]:
        x = joined(x, h[i : i + n], salt)
    return x


def masks(n: int) -> list[str]:
    """Masks of windows of n tokens; 1 is a position that counts."""
    e = n - -(-NUM * n // DEN)
    if not e:
        return ["1" * n]
    cuts = [n * i // (e + 2) for i in range(e + 3)]
    return ["".join(("1" if i in kept else "0") * (cuts[i + 1] - cuts[i]) for i in range(e + 2)) for kept in combinations(range(e + 2), 2)]


def span_hashes(h: np.ndarray, span: int) -> list[np.ndarray]:
    """Hashes of all windows of a length, by mask."""
    return [seeds(h, mask, 0x100 * span + i) for i, mask in enumerate(masks(span))]


def framed(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, doc, first) of a piece whose documents have EDGE tokens before and after them."""
    first = w.first + 2 * EDGE * np.arange(len(w.first))
    h = np.full(int(first[-1]), NOTHING)
    h[np.arange(len(w.hash)) + EDGE * (2 * w.doc + 1)] = w.hash
    return h, np.repeat(np.arange(w.rows), np.diff(first)), first


def _window_hashes(h: np.ndarray, doc: np.ndarray, spans: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(positions, hashes, length) by length and mask."""
    for span in spans:
        at = np.flatnonzero(inside(doc, span))
        for x in span_hashes(h, span) if len(at) else ():
            yield at, x[at], span


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for w in words(b.column(1), True, "alnum"):
            cuts = [w.hash[w.first[i] : w.first[i + 1]] for i in range(w.rows)]
            yield pa.record_batch([b.column(0).slice(w.row, w.rows), pa.array([c.tobytes() for c in cuts], pa.binary()), pa.array([len(c) for c in cuts], pa.int32())], ["item_id", "tokens", "m"])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for item, tokens in zip(b.column("item").to_pylist(), b.column("tokens").to_pylist(), strict=True):
            h = np.frombuffer(tokens, U)
            found = span_hashes(h, min(WINDOW, len(h)))
            yield pa.record_batch([ints(np.concatenate(found)), pa.array([item] * sum(map(len, found)), pa.int64()), pa.array(np.concatenate([np.arange(len(x)) for x in found]), pa.int64())], ["h", "item", "pos"])


def _scan(bits, exact, spans: list[int]):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, known = bits.value, exact.value
        mask = U(BITS - 1)
        for b in batches:
            for w in words(b.column(1), True, "alnum"):
                pos, hit, size = [], [], []
                tokens, row, first = framed(w)
                for at, h, m in _window_hashes(tokens, row, spans):
                    bit = h & mask
                    ok = np.flatnonzero((bitmap[(bit >> U(6)).astype(np.int64)] >> (bit & U(63))) & U(1))
                    if known is not None and len(ok):
                        ok = ok[known[np.minimum(np.searchsorted(known, h[ok]), len(known) - 1)] == h[ok]] if len(known) else ok[:0]
                    pos.append(at[ok])
                    hit.append(h[ok])
                    size.append(np.full(len(ok), m))
                if not sum(map(len, pos)):
                    continue
                pos, hit, size = np.concatenate(pos), np.concatenate(hit), np.concatenate(size)
                order = np.argsort(pos, kind="stable")
                pos, hit, size = pos[order], hit[order], size[order]
                doc = row[pos]
                # hits whose surroundings touch share a row
                new = np.append(True, (doc[1:] != doc[:-1]) | (pos[1:] - pos[:-1] > 3 * WINDOW))
                start = np.flatnonzero(new)
                end = np.append(start[1:], len(pos))
                low = np.maximum(first[doc[start]], pos[start] - WINDOW)
                high = np.minimum(first[doc[start] + 1], np.maximum.reduceat(pos + size, start) + WINDOW)
                yield pa.record_batch([
                    b.column(0).take(pa.array(doc[start] + w.row)), pa.array([uuid.uuid4().hex for _ in start]),
                    pa.array(low - first[doc[start]] - EDGE, pa.int64()), pa.array([tokens[x:y].tobytes() for x, y in zip(low, high, strict=True)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.append(start, end[-1]), pa.int32()), pa.StructArray.from_arrays([ints(hit), pa.array(pos - np.repeat(low, end - start), pa.int64())], ["h", "pos"])),
                ], ["id", "part", "start", "tokens", "hits"])

    return run


def best_window(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int, int]:
    """(agreeing tokens in the best window, its length, its start in doc, agreeing tokens in all) where item token k is
    aligned with doc token k + shift. Tokens beyond either end agree with nothing."""
    m = len(item)
    size = min(WINDOW, m)
    k = np.arange(m) + shift
    ok = (k >= 0) & (k < len(doc))
    same = np.zeros(m, np.int64)
    same[ok] = doc[k[ok]] == item[ok]
    sums = np.cumsum(np.append(0, same))
    runs = sums[size:] - sums[:-size]
    at = int(runs.argmax())
    return int(runs[at]), size, at + shift, int(same.sum())


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for x in b.select(["id", "item", "start", "tokens", "shift", "item_tokens"]).to_pylist():
            got, size, at, every = best_window(np.frombuffer(x["tokens"], U), np.frombuffer(x["item_tokens"], U), x["shift"])
            if DEN * got >= NUM * size:
                rows.append((x["id"], x["item"], got, size, every, max(0, at + x["start"])))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.record_batch([pa.array(cols[0], b.schema.field("id").type), *(pa.array(c, pa.int64()) for c in cols[1:])], ["id", "item", "matched", "window", "n_matched", "position"])


def bitmap_of(hashes: DataFrame) -> np.ndarray:
    """BITS bits; at most BITS / 64 rows of 12 bytes reach the driver, as Arrow."""
    rows = hashes.select(F.expr(f"cast(h & {BITS - 1} as int)").alias("x")).select(F.shiftright("x", 6).alias("w"), F.expr("shiftleft(1L, x & 63)").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return out.view(U)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, item_key, matched, window, n_matched, position): a row for each document and each item that it holds;
    `matched` of `window` tokens agree in the best window, which begins at token `position` of the document (0 if before
    it); `n_matched` tokens of the item agree in that alignment."""
    spark = docs.sparkSession
    items = stored(benchmark.select(F.col(item_key).cast("bigint").alias("item_id"), item_text).mapInArrow(_items, "item_id bigint, tokens binary, m int"), "items")
    once = items.where(F.col("m") >= max(1, least)).groupBy("tokens").agg(F.min("item_id").alias("item"), F.first("m").alias("m"))
    once = stored(once, "item-sequences")
    tests = stored(once.mapInArrow(_item_seeds, "h bigint, item bigint, pos bigint"), "item-seeds")
    # lengths of items, a long one counting as WINDOW: at most WINDOW rows
    spans = sorted(r["m"] for r in once.select(F.least("m", F.lit(WINDOW)).alias("m")).distinct().collect())
    bits = spark.sparkContext.broadcast(bitmap_of(tests))
    few = tests.count() <= EXACT_ROWS
    exact = spark.sparkContext.broadcast(np.unique(tests.select("h").toArrow().column("h").to_numpy().view(U)) if few else None)
    d = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    parts = stored(d.mapInArrow(_scan(bits, exact, spans), f"id {kind}, part string, start bigint, tokens binary, hits array<struct<h:bigint,pos:bigint>>"), "parts")
    hits = parts.select("part", F.explode("hits").alias("x")).select("part", F.col("x.h").alias("h"), F.col("x.pos").alias("at"))
    aligned = hits.join(tests, "h").select("part", "item", (F.col("at") - F.col("pos")).alias("shift")).distinct()
    pairs = aligned.join(parts.select("part", "id", "start", "tokens"), "part").join(once.select("item", F.col("tokens").alias("item_tokens")), "item")
    found = pairs.mapInArrow(_verify, f"id {kind}, item bigint, matched bigint, window bigint, n_matched bigint, position bigint")
    best = found.groupBy("id", "item").agg(F.max(F.struct("matched", "n_matched", -F.col("position"), "window")).alias("x"))
    best = best.select("id", "item", F.col("x.matched").alias("matched"), F.col("x.window").alias("window"), F.col("x.n_matched").alias("n_matched"), (-F.col("x.col3")).alias("position"))
    same = items.join(once.select("tokens", "item"), "tokens").select("item", "item_id")
    return best.join(same, "item").select(F.col("id").alias(key), F.col("item_id").alias(item_key), "matched", "window", "n_matched", "position")


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without contaminated rows; each row is judged by its own text, whatever id it shares or lacks."""
    keyed = docs.select(row_key(key, text).alias("row"), F.col(text).alias("text"))
    return among(docs, contaminated(keyed, benchmark, "row", "text"), key, text)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokens_of(text: str | None) -> list[bytes]:
    raw = (text or "").encode().lower()
    return bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in raw).split()


OP1_SQL = """
with t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents),
u as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from benchmark),
dt as (select doc_id, unnest(ws) as w, unnest(range(len(ws))) as p from t),
it as (select item_id, len(ws) as m, least(13, len(ws)) as size, unnest(ws) as w, unnest(range(len(ws))) as k from u where len(ws) >= 2),
same as (select doc_id, item_id, m, size, p - k as shift, list(k) as ks, count(*) as n_matched from dt join it using (w) group by doc_id, item_id, m, size, p - k),
win as (select *, unnest(range(m - size + 1)) as a from same where 5 * n_matched >= 4 * size),
runs as (select doc_id, item_id, size, shift, a, n_matched, len([k for k in ks if k >= a and k < a + size]) as matched from win),
best as (select *, row_number() over (partition by doc_id, item_id, shift order by matched desc, a) as r from runs),
one as (select *, greatest(0, a + shift) as position, row_number() over (partition by doc_id, item_id order by matched desc, n_matched desc, greatest(0, a + shift)) as q from best where r = 1 and 5 * matched >= 4 * size)
select doc_id, item_id, matched, size as "window", n_matched, position from one where q = 1
"""


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], least: int = LEAST) -> set[tuple[int, int]]:
    """(doc, item) of every alignment that the rule accepts, for tests."""
    out = set()
    for i, t in docs:
        d = tokens_of(t)
        places: dict[bytes, list[int]] = {}
        for p, w in enumerate(d):
            places.setdefault(w, []).append(p)
        for j, u in items:
            x = tokens_of(u)
            m, size = len(x), min(WINDOW, len(x))
            if m < max(1, least):
                continue
            agree = Counter(p - k for k, w in enumerate(x) for p in places.get(w, ()))
            for shift in (s for s, n in agree.items() if DEN * n >= NUM * size):
                same = [0 <= k + shift < len(d) and d[k + shift] == x[k] for k in range(m)]
                if any(DEN * sum(same[a : a + size]) >= NUM * size for a in range(m - size + 1)):
                    out.add((i, j))
                    break
    return out
