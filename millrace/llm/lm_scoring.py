"""LM scoring with a weighted backoff automaton over word trigrams.

Model. Tokens are words (A-Z folded) and one end a text. Root arcs weigh log10 u(w), u(w) = (c(w) + 0.5) / (N + 0.5 (V +
1)). A word that was seen, and the beginning of texts, is a state, and so is a pair of words that was seen. A state h has
an arc for each word w seen after it, of weight log10((1 - b) c(h w) / c(h)), and a failure arc of weight log10 b, from a
pair to its second word and from a word or the beginning to the root. An arc leads to the state of the last two words. A
text is read in one left-to-right traversal that carries the state: it takes the state's arc for the next word, or the
failure arc and asks again, and adds up weights. What follows a state has a probability of one at most in sum: words with
an arc of their own take nothing of what the failure arc hands down.

b depends on how often a state was left (BUCKETS powers of two) and on its length. It is the share of training tokens
whose state has no arc for them once the token's own occurrence is left out of all counts: the b that makes the training
texts likeliest so. Weights are sums of logarithms of counts and of b and 1 - b, so a traversal adds up the former and
counts how often each of the latter was used; b is known when all texts have been read, and scores follow without
reading them again. No table is pruned, whatever its size.

Distribution. No executor, let alone the driver, holds the model. Each task packs its texts into blocks of BLOCK_BYTES. A
first pass gives the distinct n-grams of each block with their training counts, as sorted hashes cut by their top bits into
shards; a shard adds up the counts of its n-grams over all blocks, and returns to each block the totals of that block's
n-grams alone, in the block's order, so no hash travels back. A second pass joins blocks with totals, builds the part of
the automaton that the block can reach, and walks it. Only pieces of a block that hold an n-gram travel: there are no more
of them than n-grams of blocks, and of these no more than tokens, so what travels is linear in the input. Counts of a
frequent word are added within its block before they travel, so no task holds more than its shard's or its block's
n-grams. Words are told apart by 64 bits, pairs and triples by log2 of the input's bytes and 20 more (64 at most), so that
about one lookup in a million may see another one's count too.

Defined cases: null and empty texts are one end token; a null id is neither held out nor left out of training; equal rows
score alike; an empty table gives an empty result; without training texts every token is unknown (N and V are 0); further
columns are ignored; a text longer than a block is a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod5, dropped, input_bytes, stored, table, tidy
from .vectext import joined, mix, text_buffers, words

U = np.uint64
BEGIN, END = U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)
#: Classes of states by the power of two of how often they were left; the last takes what is beyond.
BUCKETS = 15
#: Lengths of states that have a failure arc.
LENGTHS = (1, 2)
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 2 << 20
#: Tokens that a lane of a traversal reads at most.
LANE = 512


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (block, ids, train, sizes, z) of texts of about BLOCK_BYTES."""
    z = zstandard.ZstdCompressor(level=3)
    made = 0
    held: list[tuple[pa.Array, pa.Array, np.ndarray, bytes]] = []
    size = 0

    def block() -> pa.RecordBatch:
        ids, train = (pa.concat_arrays([h[k] for h in held]) for k in (0, 1))
        sizes = pa.array(np.concatenate([h[2] for h in held]), pa.int64())
        rows = pa.array([0, len(ids)], pa.int32())
        number = pa.array([TaskContext.get().partitionId() << 32 | made], pa.int64())
        data = pa.array([z.compress(b"".join(h[3] for h in held))], pa.binary())
        return pa.record_batch([number, *(pa.ListArray.from_arrays(rows, c) for c in (ids, train, sizes)), data], ["block", "ids", "train", "sizes", "z"])

    for b in batches:
        buf, offs = text_buffers(b.column(2))
        lo = 0
        while lo < b.num_rows:
            hi = min(b.num_rows, max(lo + 1, int(np.searchsorted(offs, offs[lo] + BLOCK_BYTES - size, side="right")) - 1))
            held.append((b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), np.diff(offs[lo : hi + 1]), buf[offs[lo] : offs[hi]].tobytes()))
            size += int(offs[hi] - offs[lo])
            lo = hi
            if size >= BLOCK_BYTES or lo < b.num_rows:
                yield block()
                made, size = made + 1, 0
                held.clear()
    if held:
        yield block()


_BLOCK = "block bigint, ids array<bigint>, train array<boolean>, sizes array<bigint>, z binary"


class Tokens:
    """Tokens of all texts of a block, each text followed by its end, and its distinct n-grams by length: sorted keys, and
    for each token the place of the n-gram that it ends. A text's first token ends no triple."""

    def __init__(self, sizes: np.ndarray, data: bytes, bits: int):
        offs = np.append(0, np.cumsum(sizes))
        col = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data)])
        token, doc = [], []
        for w in words(col, True):
            counts = np.diff(w.first) + 1
            h = np.empty(len(w.hash) + w.rows, U)
            is_end = np.zeros(len(h), bool)
            is_end[np.cumsum(counts) - 1] = True
            h[is_end], h[~is_end] = END, w.hash
            token.append(h)
            doc.append(np.repeat(np.arange(w.row, w.row + w.rows), counts))
        t, self.doc, self.rows = np.concatenate(token), np.concatenate(doc), len(sizes)
        self.first = np.append(True, self.doc[1:] != self.doc[:-1])
        before = np.where(self.first, BEGIN, np.roll(t, 1))
        self.end = t == END
        cut = U(64 - bits)
        pair = joined(before, t, 2)
        triple = joined(np.roll(pair, 1), t, 3)[~self.first]
        self.keys, at = zip(*(np.unique(x, return_inverse=True) for x in (mix(t), pair >> cut, triple >> cut)), strict=True)
        self.word, self.pair = at[0], at[1]
        self.triple = np.full(len(t), -1, np.int64)
        self.triple[~self.first] = at[2]

    @classmethod
    def of(cls, row: dict, bits: int) -> Tokens:
        return cls(np.asarray(row["sizes"], np.int64), zstandard.ZstdDecompressor().decompress(row["z"]), bits)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte of all: what is zero in most of them takes no room."""
    steps = np.diff(keys, prepend=U(0)).view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.T).tobytes())


def unpacked_keys(z: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U).ravel(), dtype=U)


def _columns(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(types), types, strict=True)], names)


_CELL = "block bigint, length int, shard bigint, keys binary, counts binary"


def _count(shards: int, bits: int):
    """The cells (block, length of n-gram, shard) of blocks that hold an n-gram."""
    power = int(math.log2(shards))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for row in b.to_pylist():
                x = Tokens.of(row, bits)
                train = np.asarray(row["train"], bool)[x.doc]
                for n, (keys, at) in enumerate(zip(x.keys, (x.word, x.pair, x.triple), strict=True), 1):
                    counts = np.bincount(at[train & (at >= 0)], minlength=len(keys)).astype(np.uint32)
                    shard = (keys >> U((64 if n == 1 else bits) - power)).astype(np.int64)
                    cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(keys) else np.zeros(0, np.int64)
                    end = np.append(cut[1:], len(keys))
                    rows = [(row["block"], n, int(shard[a]), packed_keys(keys[a:e]), z.compress(counts[a:e].tobytes())) for a, e in zip(cut, end, strict=False)]
                    yield _columns(rows, [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()], ["block", "length", "shard", "keys", "counts"])

    return run


_TOTAL = "block bigint, length int, shard bigint, totals binary, types bigint, tokens bigint"


def _add(t: pa.Table) -> pa.Table:
    """Totals of a shard, cut and ordered as the cells of its blocks; its types and tokens are named once."""
    zd, zc = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    parts = [unpacked_keys(k.as_py()) for k in t.column("keys")]
    counts = np.concatenate([np.frombuffer(zd.decompress(c.as_py()), np.uint32) for c in t.column("counts")])
    keys, at = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(at, counts, len(keys)).astype(np.int64)  # exact below 2^53
    every, ends = total[at], np.cumsum([len(p) for p in parts])
    out = []
    for e, p in zip(ends, parts, strict=True):
        own = every[e - len(p) : e]
        out.append(zc.compress(own.astype(np.uint32 if own.max() < 2**32 else np.uint64).tobytes()) + (b"4" if own.max() < 2**32 else b"8"))
    once = lambda v: pa.array([v] + [0] * (t.num_rows - 1), pa.int64())
    return pa.table([*(t.column(c) for c in ("block", "length", "shard")), pa.array(out, pa.binary()), once(int((total > 0).sum())), once(int(total.sum()))], ["block", "length", "shard", "totals", "types", "tokens"])


def _totals(t: pa.Table, length: int) -> np.ndarray:
    z = zstandard.ZstdDecompressor()
    rows = sorted((s, c) for n, s, c in zip(*(t.column(c).to_pylist() for c in ("length", "shard", "totals")), strict=True) if n == length)
    cells = [np.frombuffer(z.decompress(c[:-1]), np.uint32 if c[-1:] == b"4" else np.uint64).astype(np.int64) for _, c in rows]
    return np.concatenate(cells) if cells else np.zeros(0, np.int64)


def bucket(count: np.ndarray) -> np.ndarray:
    """The class of a state that was left so often; 0 for one or none."""
    return np.minimum(np.frexp(np.maximum(count, 1).astype(np.float64))[1] - 1, BUCKETS - 1)


class Automaton:
    """The part of the automaton that a block's tokens reach. State 0 is the root, 1 the beginning of texts, then come the
    block's words, then its pairs of words. Arcs are named by the n-gram that they complete."""

    def __init__(self, x: Tokens, totals: tuple[np.ndarray, ...], n: int, types: int):
        one, two, three = totals
        self.one, self.two, self.three = one, two, three
        self.denominator = n + 0.5 * (types + 1)
        self.begin, self.words = 1, 2
        self.pairs = self.words + len(one)
        later = np.flatnonzero(~x.first)
        # what the pairs and triples of the block consist of, read off any token that completes them
        last, start = np.zeros(len(two), np.int64), np.full(len(two), self.begin)
        last[x.pair] = x.word
        start[x.pair[later]] = self.words + x.word[later - 1]
        head, tail = np.zeros(len(three), np.int64), np.zeros(len(three), np.int64)
        head[x.triple[later]], tail[x.triple[later]] = x.pair[later - 1], x.pair[later]
        # how often a state was left: a text is begun as often as one ends
        ends = int(one[x.word[x.end][0]]) if x.end.any() else 0
        self.left = np.concatenate([[n, ends], one, two])
        self.fail = np.concatenate([[0, 0], np.zeros(len(one), np.int64), self.words + last])
        # arcs: the state that they leave, their weight without 1 - b, the state that they enter
        self.root_weight = np.log10((one + 0.5) / self.denominator)
        self.root_to = np.where(one > 0, self.words + np.arange(len(one)), 0)
        self.from2, self.to2 = start, self.pairs + np.arange(len(two))
        self.from3, self.to3 = self.pairs + head, self.pairs + tail
        share = lambda c, state: np.log10(np.maximum(c, 1) / np.maximum(self.left[state], 1))
        self.weight2, self.weight3 = share(two, self.from2), share(three, self.from3)

    def known(self, x: Tokens, at: np.ndarray) -> np.ndarray:
        """The state after the tokens at `at`: the last two words if they are a state, else the last, else the root."""
        pair, word = x.pair[at], x.word[at]
        return np.where(self.two[pair] > 0, self.to2[pair], self.root_to[word])

    def walk(self, x: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """By text: the sum of weights but for b, and how often each b was taken (1) and left (0), by length and bucket.

        All texts are read at once, a token of each a step. Long ones are cut into lanes; a lane that begins inside a
        text begins in the state that the two tokens before it lead to.
        """
        n = len(x.word)
        begins = np.flatnonzero(x.first)
        sizes = np.diff(np.append(begins, n))
        cuts = -(-sizes // LANE)
        lane = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        start = np.repeat(begins, cuts) + lane * LANE
        length = np.minimum(LANE, np.repeat(sizes, cuts) - lane * LANE)
        order = np.argsort(-length, kind="stable")
        start, length, lane = start[order], length[order], lane[order]
        state = np.where(lane > 0, self.known(x, start - 1), self.begin if self.left[self.begin] else 0)
        weight = np.zeros(n)
        use = np.full((len(LENGTHS), n), -1, np.int16)
        shortest = np.sort(length)
        for t in range(int(length[0]) if len(length) else 0):
            active = len(length) - int(np.searchsorted(shortest, t, side="right"))
            at, s = start[:active] + t, state[:active]
            word, pair, triple = x.word[at], x.pair[at], x.triple[at]
            # the state's own arc, or down the failure arc to the last word and on to the root
            long = s >= self.pairs
            hit3 = long & (triple >= 0)
            hit3[hit3] = (self.three[triple[hit3]] > 0) & (self.from3[triple[hit3]] == s[hit3])
            use[1, at[long]] = 2 * bucket(self.left[s[long]]) + ~hit3[long]
            s = np.where(long & ~hit3, self.fail[s], s)
            short = (s > 0) & ~hit3
            hit2 = short & (self.two[pair] > 0) & (self.from2[pair] == s)
            use[0, at[short]] = 2 * bucket(self.left[s[short]]) + ~hit2[short]
            weight[at] = np.where(hit3, self.weight3[triple], np.where(hit2, self.weight2[pair], self.root_weight[word])) if len(self.weight3) else np.where(hit2, self.weight2[pair], self.root_weight[word])
            state[:active] = np.where(hit3, self.to3[triple], np.where(hit2, self.to2[pair], self.root_to[word])) if len(self.to3) else np.where(hit2, self.to2[pair], self.root_to[word])
        return np.bincount(x.doc, weight, x.rows), self._used(use, x.doc, x.rows)

    @staticmethod
    def _used(use: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        out = np.zeros((rows, len(use), 2 * BUCKETS), np.int64)
        for k, u in enumerate(use):
            at = np.flatnonzero(u >= 0)
            out[:, k] = np.bincount(row[at] * 2 * BUCKETS + u[at], minlength=rows * 2 * BUCKETS).reshape(rows, -1)
        return out.reshape(rows, -1)

    def left_out(self, x: Tokens, train: np.ndarray) -> np.ndarray:
        """How often training tokens take and leave each b in an automaton without their own occurrence."""
        at = np.flatnonzero(train[x.doc])
        first = x.first[at]
        pair, triple = x.pair[at], x.triple[at]
        use = np.full((len(LENGTHS), len(at)), -1, np.int16)
        before = np.where(first, 0, at - 1)
        left3 = np.where(first, 0, self.two[x.pair[before]] - 1)
        hit3 = ~first & (left3 > 0)
        hit3[hit3] = self.three[triple[hit3]] > 1
        use[1] = np.where(left3 > 0, 2 * bucket(left3) + ~hit3, -1)
        left2 = np.where(first, self.left[self.begin], self.one[x.word[before]]) - 1
        use[0] = np.where((left2 > 0) & ~hit3, 2 * bucket(left2) + (self.two[pair] <= 1), -1)
        return self._used(use, np.zeros(len(at), np.int64), 1)[0]


_WALKED = "id bigint, n_tokens bigint, n_known bigint, base_score double, weight double, used array<bigint>, held array<bigint>"


def _walk(n: int, types: int, bits: int):
    width = 2 * BUCKETS * len(LENGTHS)

    def run(blocks: pa.Table, totals: pa.Table) -> pa.Table:
        names = ["id", "n_tokens", "n_known", "base_score", "weight", "used", "held"]
        (row,) = blocks.to_pylist()
        x = Tokens.of(row, bits)
        a = Automaton(x, tuple(_totals(totals, k) for k in (1, 2, 3)), n, types)
        weight, used = a.walk(x)
        held = a.left_out(x, np.asarray(row["train"], bool))
        size = np.bincount(x.doc, minlength=x.rows)
        known = np.bincount(x.doc, a.one[x.word] > 0, x.rows).astype(np.int64)
        base = np.bincount(x.doc, a.root_weight[x.word], x.rows)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(x.rows + 1) * width, pa.int32()), pa.array(used.ravel()))
        sums = pa.array([held.tolist()] + [None] * (x.rows - 1), pa.list_(pa.int64()))
        return pa.table([pa.array(row["ids"], pa.int64()), pa.array(size), pa.array(known), pa.array(base), pa.array(weight), lists, sums], names)

    return run


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score, shares) of each row; the rows where `train` holds are
    learnt; shares are the values of b, by length of the state and bucket."""
    size = input_bytes(docs)
    shards = 1 << max(4, (size // SHARD_BYTES).bit_length())
    bits = min(64, max(48, size.bit_length() + 20))
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text"))
    blocks = stored(rows.mapInArrow(_pack, _BLOCK), "blocks")
    counted = blocks.mapInArrow(_count(shards, bits), _CELL)
    totals = stored(counted.groupBy("length", "shard").applyInArrow(_add, _TOTAL), "totals")
    known = totals.where("length = 1").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).first()
    n_types, n_tokens = known["types"] or 0, known["tokens"] or 0
    joined_blocks = blocks.groupBy("block").cogroup(totals.drop("types", "tokens").groupBy("block"))
    walked = stored(joined_blocks.applyInArrow(_walk(n_tokens, n_types, bits), _WALKED), "walked")
    dropped(blocks, totals)
    width = 2 * BUCKETS * len(LENGTHS)
    held = walked.where("held is not null").agg(*(F.sum(F.col("held")[i]) for i in range(width))).first()
    shares = [((held[i + 1] or 0) + 0.5) / ((held[i] or 0) + (held[i + 1] or 0) + 1.0) for i in range(0, width, 2)]
    logs = F.array(*(F.lit(math.log10(x)) for b in shares for x in (1 - b, b)))
    total = F.aggregate(F.zip_with("used", logs, lambda n, w: n * w), F.col("weight"), lambda a, x: a + x)
    return walked.select(F.col("id").alias(key), "n_tokens", "n_known", F.lit(n_tokens).cast("bigint").alias("train_tokens"), "base_score", total.alias("score"), F.array(*map(F.lit, shares)).alias("shares"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = score(table(spark, sf_dir, "documents"), crc_mod5() != 1)
    return s.select("doc_id", (crc_mod5() == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: The columns that SQL can express, for tests.
OP7_BASE_SQL = """
with t as (select doc_id, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), ' ') as ws, held_out
           from (select *, {held_out} as held_out from documents)),
w as (select doc_id, held_out, unnest(ws) as w from t),
c as (select w, count(*) as c from w where not held_out group by w),
s as (select sum(c) as n, count(*) as v from c)
select doc_id, any_value(held_out) as held_out, count(*) as n_tokens, count(c) as n_known, any_value(s.n) as train_tokens, sum(log10((coalesce(c, 0) + 0.5) / (s.n + 0.5 * (s.v + 1)))) as base_score
from w left join c using (w), s group by doc_id
"""


def brute_force(rows: list[tuple[int, str | None]]) -> tuple[dict[int, tuple[int, int, float, float]], list[float]]:
    """(id -> (tokens, known, base, score), shares) by an explicit automaton over tuples of words; trains as the query."""
    import zlib

    cut = {i: (t or "").encode().lower().split() + [None] for i, t in rows}
    train = {i for i in cut if zlib.crc32(str(i).encode()) % 5 != 1}
    arcs: dict[tuple, dict] = {}  # state -> word -> count; a state is the last words, 0 stands for the beginning

    def contexts(w: list, k: int) -> list[tuple]:
        return [(0,)] if k == 0 else [(0, w[0]), (w[0],)] if k == 1 else [(w[k - 2], w[k - 1]), (w[k - 1],)]

    for i in train:
        for k, x in enumerate(cut[i]):
            for h in [*contexts(cut[i], k), ()]:
                arcs.setdefault(h, {})
                arcs[h][x] = arcs[h].get(x, 0) + 1
    n, types = sum(arcs.get((), {}).values()), len(arcs.get((), {}))
    of = lambda h, own: sum(arcs.get(h, {}).values()) - own
    slot = lambda h, left: (len(h) - 1) * BUCKETS + min(left.bit_length() - 1, BUCKETS - 1)
    taken, failed = [0.0] * (BUCKETS * 2), [0.0] * (BUCKETS * 2)
    for i in train:
        for k, x in enumerate(cut[i]):
            for h in contexts(cut[i], k):
                left = of(h, 1)
                if left <= 0:
                    continue
                if arcs[h][x] > 1:
                    taken[slot(h, left)] += 1
                    break
                failed[slot(h, left)] += 1
    shares = [(f + 0.5) / (t + f + 1) for t, f in zip(taken, failed, strict=True)]
    root = lambda x: math.log10((arcs.get((), {}).get(x, 0) + 0.5) / (n + 0.5 * (types + 1)))
    out = {}
    for i, w in cut.items():
        total = 0.0
        for k, x in enumerate(w):
            for h in contexts(w, k):
                left = of(h, 0)
                if left <= 0:
                    continue
                if x in arcs[h]:
                    total += math.log10((1 - shares[slot(h, left)]) * arcs[h][x] / left)
                    break
                total += math.log10(shares[slot(h, left)])
            else:
                total += root(x)
        out[i] = (len(w), sum(x in arcs.get((), {}) for x in w), sum(map(root, w)), total)
    return out, shares
