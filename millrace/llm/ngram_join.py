"""N-gram Jaccard join: all pairs of documents whose sets of word n-grams are similar, and their connected groups.

A document's set: its distinct runs of k words (A-Z folded); with fewer words, the whole sequence as one; without words
it is empty and linked with nothing. Two documents link when den * |A and B| >= num * |A or B|, checked on whole sets of
64-bit hashes. Equal sets are one node from the start, so copies cost nothing further.

1. Shards. Two linked sets share a member among the first n - ceil(num n / den) + 1 of each in any one order of all
   n-grams; those members are keys. The order puts n-grams that are common in the corpus last. How common is read off
   a count sketch of SLOTS counters over all documents: of fixed size, and only an order, so its errors cost time, never
   a link. Keys that one node alone has are dropped after a partial aggregation, and so are rows of keys at which no size
   of a partner leaves enough for a link: where the first common key of a link is, the smaller set has twice num / (num +
   den) of itself to come. Of keys with the very same nodes the first in the order stays.
2. Count vectors. Each set's members are hashed into GROUPS groups; the group counts are a point. The sum of coordinate
   minima of two points is no less than their overlap. Pairs are held against counts in about as many groups as a set
   has members before the sets themselves are fetched.
3. Stars. In each shard the node of most common n-grams leads. Both members of a shard of two, and each other node with
   the leader that it shares most shards with, are verified if the bound suffices, and give components. In a large group
   of near copies these connect nearly all.
4. R-tree. Shards of three members or more of different components are joined: an R-tree over the count vectors, whose
   nodes hold coordinate maxima and the range of sizes, is asked for each member's partners of another component. A pair
   is handed on by the shard of its first common key alone, and only if what follows that key in both orders is enough
   for a link. k sets that are near each other and not linked share many keys, each with other members; a row names the
   LAST keys before its own, and goes no further where each partner has met it at one of those, so that few of their
   shards are left. Shards of more than BLOCK members are cut into blocks, and every pair of blocks is one bounded group; those
   of the component that most members are of have blocks of their own, which aren't paired with each other, so a shard of
   k members of one component and a few others costs about k. Surviving pairs are verified.
5. Components of the links so far, and the smallest doc_id of each. Steps 3 and 4 look at no pair that is connected
   already, so they give all components, but not yet all links.
6. All links. A link never leaves its component, so every pair of a component of three or more nodes is compared on its
   whole sets. Components are cut into tiles of at most about TILE sets and TILE_MEMBERS hashes a side; each set travels
   once a tile, not once a pair, and a tile's overlaps are one product of matrices. A tile hands on sums a node: how many
   documents it is linked with. `links_of` hands on the pairs themselves, of which k near copies can have k^2 / 2.

Verification fetches sets of the documents in pairs alone, by a scan that asks a bitmap of fixed size first and an exact
join after; step 6 uses the sets that were fetched. `groups` ends after step 5. k nodes of a component cost k^2 / 2
products in step 6, in blocks, and so do k members of one shard that are near each other and yet in k components.

Defined cases: null text is empty and has no link; a null doc_id is a document of its own that never is the smallest (its component's
id is null if it holds no other); rows that share an id stay rows; an empty table gives an empty result; very long texts
have long sets; further columns are ignored. doc_id is an integer.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import among, dropped, pieces, row_key, stored, table, tidy
from .components import components
from .vectext import Words, ints, mix, windows, words

U = np.uint64
SLOTS = 1 << 20
GROUPS = 128
#: Counts are bytes; one at its ceiling bounds nothing.
CEILING = 255
BLOCK = 256
BITS = 1 << 23
LEAF, FAN = 16, 8
#: Sets and hashes of one side of a tile, and columns of a matrix that is multiplied at once.
TILE, TILE_MEMBERS, COLUMNS = 256, 1 << 20, 4096
#: Keys before its own that a row of a shard names, to tell whether a pair has met already; more meet twice, no harm.
BEFORE = 64
#: As many of them travel with every row, to leave most shards of near sets out before counts are fetched.
LAST = 8


def sets_of(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct n-grams of a piece, sorted."""
    h = windows(w.hash, k)
    out, sizes = [], np.zeros(w.rows, np.int64)
    first = w.first.tolist()
    for i in range(w.rows):  # a small sort a row is faster than one of all rows
        a, e = first[i], first[i + 1]
        m = e - a
        if m == 0:
            continue
        if m < k:
            x = mix(windows(w.hash[a:e], m) + U(0x1000 * m))
        else:
            x = np.sort(h[a : e - k + 1])
            if m > k:
                x = x[np.append(True, x[1:] != x[:-1])]
        out.append(x)
        sizes[i] = len(x)
    return np.repeat(np.arange(w.rows), sizes), np.concatenate(out) if out else np.zeros(0, U)


def _nodes(doc: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, n, node): where each row's set begins, its size, and the identity of the set."""
    first = np.searchsorted(doc, np.arange(rows + 1))
    n = np.diff(first)
    total = np.zeros(rows, U)
    full = np.flatnonzero(n)
    if len(full):
        total[full] = np.add.reduceat(mix(h ^ U(0x5851F42D4C957F2D)), first[full])
    return first, n, mix(total + n.astype(U))


def _sketch(k: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.uint32)
        for b in batches:
            for w in words(b.column(0), True):
                counts += np.bincount((sets_of(w, k)[1] >> U(44)).astype(np.int64), minlength=SLOTS).astype(np.uint32)
        parts = counts.reshape(16, -1)
        pid = TaskContext.get().partitionId()
        z = zstandard.ZstdCompressor(level=1)
        yield pa.record_batch([pa.array(range(16), pa.int32()), pa.array([pid // 256] * 16, pa.int32()), pa.array([z.compress(p.tobytes()) for p in parts], pa.binary())], ["part", "salt", "counts"])

    return run


def _summed(t: pa.Table) -> pa.Table:
    z = zstandard.ZstdDecompressor()
    total = np.zeros(SLOTS // 16, np.uint64)
    for x in t.column("counts"):
        total += np.frombuffer(z.decompress(x.as_py()), np.uint32)
    total = np.minimum(total, 2**32 - 1).astype(np.uint32)
    return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "counts": pa.array([zstandard.ZstdCompressor(level=1).compress(total.tobytes())], pa.binary())})


def commonness(texts: DataFrame, k: int) -> np.ndarray:
    """SLOTS levels (uint8): 0 up to twice the mean count, then a level for each doubling. Fixed in size."""
    parts = texts.mapInArrow(_sketch(k), "part int, salt int, counts binary").groupBy("part", "salt").applyInArrow(_summed, "part int, counts binary").groupBy("part").applyInArrow(_summed, "part int, counts binary")
    counts = np.zeros(SLOTS, np.uint32)
    z = zstandard.ZstdDecompressor()
    for r in parts.collect():  # 16 rows
        counts[r["part"] * (SLOTS // 16) : (r["part"] + 1) * (SLOTS // 16)] = np.frombuffer(z.decompress(bytes(r["counts"])), np.uint32)
    mean = max(1.0, counts.mean())
    return np.floor(np.log2(np.maximum(1.0, counts / mean))).astype(np.uint8)  # below 33


def _profiles(k: int, num: int, den: int, levels):
    """Rows (id, row, node, n, score, vec, fine, keys) of documents; empty ones have a null node."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for b in batches:
            for w in words(b.column(1), True):
                doc, h = sets_of(w, k)
                first, n, node = _nodes(doc, h, w.rows)
                rank = level[(h >> U(44)).astype(np.int64)]
                keep = np.where(n > 0, n - (num * n + den - 1) // den + 1, 0)
                cut = first.tolist()
                # a key's upper bits are its n-gram's level, so keys have the order of all n-grams
                key = (rank.astype(U) << U(57)) | (h >> U(7))
                heads = [np.sort(key[a:e])[:m] for a, e, m in zip(cut, cut[1:], keep.tolist(), strict=False)]
                keys = np.concatenate(heads) if heads else key
                ends = np.concatenate([[0], np.cumsum(keep)])
                score = np.bincount(doc, rank, w.rows).astype(np.int64)
                every = [counts(h[a:e]) for a, e in zip(cut, cut[1:], strict=False)]
                vec = [folded(c, groups_for(int(m))).tobytes() for c, m in zip(every, n, strict=True)]
                fine = [c.tobytes() for c in every]
                yield pa.record_batch([
                    b.column(0).slice(w.row, w.rows), b.column(2).slice(w.row, w.rows), pa.array(node.view(np.int64), mask=n == 0), pa.array(n, pa.int64()), pa.array(score),
                    pa.array(vec, pa.binary()), pa.array(fine, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ints(keys))], ["id", "row", "node", "n", "score", "vec", "fine", "keys"])

    return run


def bound_ok(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether two sets can be linked: by their sizes, and by the sum of minima of their group counts. A count that is
    at its ceiling bounds nothing."""
    lap = np.minimum(a, b).sum(-1, dtype=np.int64)
    lap = np.where((np.maximum(a, b) == CEILING).any(-1), np.minimum(na, nb), lap)
    return (lap * (num + den) >= num * (na + nb)) & (np.minimum(na, nb) * den >= np.maximum(na, nb) * num)


class CountTree:
    """An R-tree over group counts. A node holds the maxima of its points and the least and greatest size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, num: int, den: int):
        # sort-tile: slabs by size, within a slab by the coordinate that varies most
        slab = max(LEAF, int(np.ceil(np.sqrt(len(points) * LEAF))))
        order = np.argsort(sizes, kind="stable")
        spread = int(points.astype(np.float64).var(0).argmax())
        order = np.concatenate([(o := order[i : i + slab])[np.argsort(points[o, spread], kind="stable")] for i in range(0, len(order), slab)]) if len(points) else order
        self.order, self.points, self.sizes, self.num, self.den = order, points, sizes, num, den
        self.levels = []
        cut = [(i, min(i + LEAF, len(order))) for i in range(0, len(order), LEAF)]
        top = [points[order[a:e]].max(0) for a, e in cut]
        lo, hi = [sizes[order[a:e]].min() for a, e in cut], [sizes[order[a:e]].max() for a, e in cut]
        self.cut = cut
        while True:
            self.levels.append((np.array(top), np.array(lo), np.array(hi)))
            if len(top) <= FAN:
                break
            groups = range(0, len(top), FAN)
            top, lo, hi = [np.max(top[i : i + FAN], 0) for i in groups], [min(lo[i : i + FAN]) for i in groups], [max(hi[i : i + FAN]) for i in groups]

    def near(self, point: np.ndarray, size: int) -> np.ndarray:
        """Positions of the points whose bound with this one suffices."""
        at = np.arange(len(self.levels[-1][1]))
        for k in range(len(self.levels) - 1, -1, -1):
            top, lo, hi = (x[at] for x in self.levels[k])
            lap = np.minimum(top, point).sum(1, dtype=np.int64)
            lap = np.where(((top == CEILING) | (point == CEILING)).any(1), size, lap)
            # the smallest size that a partner in this node can have asks for the least overlap
            least = np.maximum(lo, -(-size * self.num // self.den))
            at = at[(lap * (self.num + self.den) >= self.num * (size + least)) & (hi * self.den >= size * self.num) & (lo * self.num <= size * self.den)]
            if k:
                at = (at[:, None] * FAN + np.arange(FAN)).ravel()
                at = at[at < len(self.levels[k - 1][1])]
        found = np.concatenate([self.order[slice(*self.cut[i])] for i in at]) if len(at) else np.zeros(0, np.int64)
        return found[bound_ok(self.points[found], point, self.sizes[found], np.full(len(found), size), self.num, self.den)]


def groups_for(n: int) -> int:
    """Groups of a set of n members in shards: a power of two of about n / 8 or more, so that the counts of unrelated
    sets differ by more than linked ones may, however long they are."""
    return max(GROUPS, 1 << max(0, -(-n // 8) - 1).bit_length())


def folded(a: np.ndarray, groups: int) -> np.ndarray:
    """Counts in fewer groups; what reaches the ceiling stays there."""
    return a if len(a) <= groups else np.minimum(a.reshape(-1, groups).sum(0, dtype=np.int64), CEILING).astype(np.uint8)


def counts(h: np.ndarray) -> np.ndarray:
    """Fine counts of a set: about as many groups as members, a power of two."""
    groups = max(GROUPS, 1 << max(0, len(h).bit_length() - 1))
    return np.minimum(np.bincount((h & U(groups - 1)).astype(np.int64), minlength=groups), CEILING).astype(np.uint8)


def fine_ok(a: np.ndarray, b: np.ndarray, na: int, nb: int, num: int, den: int) -> bool:
    """bound_ok for fine counts, the longer of which is folded to the length of the shorter."""
    if min(na, nb) * den < max(na, nb) * num:
        return False
    if a.max() == CEILING or b.max() == CEILING:
        return True
    n = min(len(a), len(b))
    a, b = (x.reshape(-1, n).sum(0, dtype=np.int64) for x in (a, b))
    return int(np.minimum(a, b).sum()) * (num + den) >= num * (na + nb)


def _bounded(num: int, den: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [
                fine_ok(np.frombuffer(x.as_py(), np.uint8), np.frombuffer(y.as_py(), np.uint8), na, nb, num, den)
                for x, y, na, nb in zip(b.column("va"), b.column("vb"), b.column("na").to_pylist(), b.column("nb").to_pylist(), strict=True)
            ]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows that are sorted by keys as batches of whole groups, with where each group begins and the last ends."""
    held: list[pa.RecordBatch] = []

    def cuts(b: pa.RecordBatch) -> np.ndarray:
        ids = np.stack([b.column(c).to_numpy() for c in keys])
        return np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1

    def out() -> tuple[pa.RecordBatch, np.ndarray]:
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()
        return b, np.concatenate([[0], cuts(b), [b.num_rows]])

    for b in batches:
        if not b.num_rows:
            continue
        if held and any(held[-1].column(c)[-1] != b.column(c)[0] for c in keys):
            yield out()
        inner = cuts(b)
        if len(inner):
            held.append(b.slice(0, inner[-1]))
            yield out()
            held.append(b.slice(inner[-1]))
        else:
            held.append(b)
    if held:
        yield out()


def _padded(lists: pa.Array) -> np.ndarray:
    """Lists of at most LAST keys as rows of a matrix, filled up with -1; keys are never negative."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.full((len(lists), LAST), -1)
    out[np.arange(LAST) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _promising(num: int, den: int):
    """Of rows sorted by (key, i, j), each group of which is one or two blocks, those with a partner of another component
    that sizes and what follows the key in both allow, and that isn't known to share an earlier key."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, cuts in _whole_groups(batches, ("key", "i", "j")):
            comp, n, pos, side, same = (g.column(c).to_numpy(zero_copy_only=False) for c in ("comp", "n", "pos", "side", "same"))
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            rest = n - pos
            last = _padded(g.column("last"))
            keep = np.zeros(len(n), bool)
            width = np.diff(cuts)
            for k in np.flatnonzero(width > LEAF):
                a, e = int(cuts[k]), int(cuts[k + 1])
                for lo in range(a, e, BLOCK):
                    x, y = np.nonzero(fits(comp, n, rest, side, same, np.arange(lo, min(lo + BLOCK, e))[:, None], np.arange(a, e)))
                    keep[lo + x[fresh(last, lo + x, a + y)]] = True
            of, end = np.repeat(width, width), np.repeat(cuts[1:], width)
            for d in range(1, min(LEAF, int(width.max()))):
                x = np.flatnonzero((of <= LEAF) & (np.arange(len(of)) + d < end))
                x = x[fits(comp, n, rest, side, same, x, x + d)]
                x = x[fresh(last, x, x + d)]
                keep[x] = keep[x + d] = True
            yield g.filter(pa.array(keep))

    def fresh(last: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        met = np.zeros(len(x), bool)
        for c in range(LAST):
            own = last[x, c]
            met |= (own >= 0) & (own[:, None] == last[y]).any(1)
        return ~met

    def fits(comp, n, rest, side, same, x, y) -> np.ndarray:  # noqa: ANN001
        return (
            (comp[x] != comp[y]) & (same[x] | (side[x] != side[y]))
            & (np.minimum(rest[x], rest[y]) * (num + den) >= num * (n[x] + n[y])) & (np.minimum(n[x], n[y]) * den >= np.maximum(n[x], n[y]) * num))

    return run


def _shards(num: int, den: int):
    """Pairs (a, b) of different components from rows sorted by (key, i, j), each group of which is one or two blocks."""

    def join(g: pa.RecordBatch, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node, comp, n, pos, side, same = (g.column(c).to_numpy(zero_copy_only=False) for c in ("node", "comp", "n", "pos", "side", "same"))
        n = n.astype(np.int64)
        rest = n - pos  # members from this key on
        vec: dict[int, np.ndarray] = {}
        point = lambda i: vec[i] if i in vec else vec.setdefault(i, np.frombuffer(g.column("vec")[i].as_py(), np.uint8))
        met: dict[int, frozenset] = {}
        before = lambda i: met[i] if i in met else met.setdefault(i, frozenset(g.column("before")[i].as_py()))

        def asked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            ok = (comp[x] != comp[y]) & (same[x] | (side[x] != side[y])) & (np.minimum(rest[x], rest[y]) * (num + den) >= num * (n[x] + n[y]))
            ok[ok] = [before(i).isdisjoint(before(j)) for i, j in zip(x[ok].tolist(), y[ok].tolist(), strict=True)]
            return ok

        found: list[tuple[np.ndarray, np.ndarray]] = []
        # groups that are no larger than a leaf: all pairs of rows at each distance at once, counts of what is left
        width = np.diff(cuts)
        of = np.repeat(width, width)
        end = np.repeat(cuts[1:], width)
        for d in range(1, min(LEAF, int(width.max()))):
            x = np.flatnonzero((of <= LEAF) & (np.arange(len(of)) + d < end))
            y = x + d
            ok = np.minimum(n[x], n[y]) * den >= np.maximum(n[x], n[y]) * num
            x, y = x[ok], y[ok]
            ok = asked(x, y)
            x, y = x[ok], y[ok]
            ok = np.array([fine_ok(point(i), point(j), int(n[i]), int(n[j]), num, den) for i, j in zip(x.tolist(), y.tolist(), strict=True)], bool)
            found.append((x[ok], y[ok]))
        for a in np.flatnonzero(width > LEAF):
            rows = np.arange(cuts[a], cuts[a + 1])
            kinds, times = np.unique(comp[rows], return_counts=True)
            main = comp[rows] == kinds[times.argmax()]
            size = np.array([len(point(i)) for i in rows.tolist()])
            for groups in np.unique(size):  # each pair at the length of its shorter counts
                at = np.flatnonzero(size >= groups)
                points = np.stack([folded(point(i), int(groups)) for i in rows[at].tolist()])
                sizes, own, inner = n[rows[at]], size[at] == groups, main[at]
                tree = CountTree(points, sizes, num, den)
                # one of a pair isn't of the component that most are of: whichever are fewer ask
                few = len(at) - int(inner.sum()) < int(own.sum())
                for i in np.flatnonzero(~inner if few else own):
                    y = tree.near(points[i], int(sizes[i]))
                    y = y[(own[i] | own[y]) & (inner[y] | (y > i)) if few else (y > i) | ~own[y]]
                    x, y = np.full(len(y), rows[at[i]]), rows[at[y]]
                    ok = asked(x, y)
                    found.append((x[ok], y[ok]))
        x, y = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        return np.minimum(node[x], node[y]), np.maximum(node[x], node[y])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, cuts in _whole_groups(batches, ("key", "i", "j")):
            a, b = join(g, cuts)
            if len(a):
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _bitmap(codes: DataFrame) -> np.ndarray:
    """A bitmap of BITS bits in which each code's bit is set; at most BITS / 64 rows reach the driver."""
    at = F.pmod(F.col("code"), F.lit(BITS))
    rows = codes.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(code, {BITS}) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    out = np.zeros(BITS // 64, np.int64)
    for r in rows:
        out[r["w"]] = r["b"]
    return out.view(np.uint64)


def _code(node: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return mix(node ^ mix(ids.view(U)))


def _wanted_sets(k: int, bitmap):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for b in batches:
            ids = b.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            for w in words(b.column(1), True):
                doc, h = sets_of(w, k)
                first, n, node = _nodes(doc, h, w.rows)
                code = _code(node, ids[w.row : w.row + w.rows])
                at = code.view(np.int64) % BITS  # as Spark's pmod
                rows = np.flatnonzero((bits[at >> 6] >> (at & 63).astype(U)) & U(1) & (n > 0))
                yield pa.record_batch([ints(code[rows]), pa.array([h[first[i] : first[i + 1]].tobytes() for i in rows], pa.binary())], ["code", "members"])

    return run


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([b.column(0), ints(_code(b.column(0).to_numpy().view(U), b.column(1).to_numpy()))], ["node", "code"])


def _linked(num: int, den: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                s, t = np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(den * both >= num * (len(s) + len(t) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The number of common members of each two sets."""
    m = len(sets)
    h = np.concatenate(sets)
    order = np.argsort(h, kind="stable")
    h, row = h[order], np.repeat(np.arange(m), [len(s) for s in sets])[order]
    col = np.cumsum(np.append(True, h[1:] != h[:-1])) - 1
    common = np.bincount(col) > 1
    keep = common[col]
    row, col = row[keep], (np.cumsum(common) - 1)[col[keep]]
    out = np.zeros((m, m), np.int64)
    for at in range(0, int(common.sum()), COLUMNS):
        a, e = np.searchsorted(col, [at, at + COLUMNS])
        x = np.zeros((m, COLUMNS), np.float32)  # sums of up to COLUMNS ones are exact
        x[row[a:e], col[a:e] - at] = 1
        out += (x @ x.T).astype(np.int64)
    return out


def _tiles(num: int, den: int, pairs: bool):
    """From rows sorted by (component, i, j), each group of which is one or two blocks of a component: all links (a, b), or
    (node, near), how many documents of other nodes of the tile it is linked with."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in (b.slice(a, e - a) for b, cuts in _whole_groups(batches, ("component", "i", "j")) for a, e in zip(cuts, cuts[1:], strict=False)):
            node, side, same, copies = (g.column(c).to_numpy(zero_copy_only=False) for c in ("node", "side", "same", "copies"))
            sets = [np.frombuffer(s.as_py(), U) for s in g.column("members")]
            size = np.array([len(s) for s in sets])
            both = overlaps(sets)
            ok = den * both >= num * (size[:, None] + size - both)
            np.fill_diagonal(ok, False)
            if not same[0]:
                ok &= side[:, None] != side
            if pairs:
                x, y = np.nonzero(np.triu(ok))
                yield pa.record_batch([pa.array(np.minimum(node[x], node[y]), pa.int64()), pa.array(np.maximum(node[x], node[y]), pa.int64())], ["a", "b"])
            else:
                yield pa.record_batch([pa.array(node, pa.int64()), pa.array(ok @ copies, pa.int64())], ["node", "near"])

    return run


def _dealt(m: DataFrame, least: Column, partners: Column) -> DataFrame:
    """Rows with their block `side`, once for each pair (i, j) of blocks that theirs is in."""
    kept = m.columns
    others = F.explode(F.sequence(F.lit(0), partners - 1)).alias("o")
    m = m.select(*kept, least.cast("int").alias("side"), others)
    return m.select(*kept, "side", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), (F.col("side") == F.col("o")).alias("same"))


def _blocks(c: Column) -> Column:
    return F.ceil(c / BLOCK).cast("int")


def _side(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("node"), F.greatest(blocks, F.lit(1)))


class Joined(NamedTuple):
    nodes: DataFrame  # (id, row, node, n)
    links: DataFrame  # (a, b), enough to connect each component; all links of a component of two
    components: DataFrame  # (node, component)
    sets: DataFrame  # (node, members) of every node in a component
    scratch: list[DataFrame]  # stored tables that hold the above


def joined(docs: DataFrame, k: int, num: int, den: int) -> Joined:
    """Steps 1 to 5 for docs (id, text)."""
    if not 0 < num <= den or k < 1:
        raise ValueError("similarity is num / den, above 0 and up to 1")
    spark = docs.sparkSession
    levels = spark.sparkContext.broadcast(commonness(docs.select("text"), k))
    p = stored(docs.select("id", "text", row_key("id", "text").alias("row")).mapInArrow(_profiles(k, num, den, levels), "id bigint, row bigint, node bigint, n bigint, score bigint, vec binary, fine binary, keys array<bigint>"), "profiles")
    # the score travels with each key: to fetch it later for the leaders' sake would be a join with all rows of shards
    rows = p.where("node is not null").select("node", F.col("n").cast("int").alias("n"), "score", F.posexplode("keys").alias("pos", "key"))
    # what a join's small side was aggregated to is stored first: both sides are then plain exchanges, which adaptive
    # execution can split where a key is hot
    rest, size = (F.col("n") - F.col("pos")).cast("bigint"), F.col("n").cast("bigint")
    smaller = F.when(rest * (num + den) >= 2 * num * size, size)  # sizes of those that can be the smaller of a link
    shared = rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.min(smaller).alias("least"), F.max(smaller).alias("most"))
    shared = stored(shared.where("lo < hi and least is not null").select("key", "least", "most"), "shared")
    every = rows.join(shared, "key").where((rest * (num + den) >= num * (size + F.col("least"))) & (F.col("most") * den >= num * size))
    every = stored(every.select(*rows.columns).distinct(), "members")
    # near copies share many keys: of the keys with the very same members the first is enough
    alike = every.groupBy("key").agg(F.bit_xor(F.xxhash64("node")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("s2"), F.count("*").alias("c"))
    alike = stored(alike.where("c > 1").groupBy("s1", "s2", "c").agg(F.min("key").alias("key")).select("key", "c"), "alike")
    last = F.collect_list("key").over(Window.partitionBy("node").orderBy("key", "pos").rowsBetween(-LAST, -1))
    members = stored(every.join(alike, "key").withColumn("last", last), "members")
    found = members.select("node").distinct()
    node = stored(p.where("node is not null").join(found, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("vec").alias("vec"), F.first("fine").alias("fine")), "nodes")
    ids = stored(p.select("id", "row", "node", "n"), "ids")
    dropped(p, shared, every, alike)
    point = lambda c, v: node.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col(v).alias(f"v{c}"))
    bounded = lambda pairs, v: pairs.join(point("a", v), "a").join(point("b", v), "b").mapInArrow(_bounded(num, den), "a bigint, b bigint")

    def verified(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links among the pairs, and the sets that they were checked on."""
        first = stored(pairs, "bounded")
        pairs = stored(bounded(first, "fine"), "pairs")
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        codes = stored(node.join(ends, "node", "left_semi").select("node", F.coalesce("id", F.lit(-(2**63))).alias("id")).mapInArrow(_codes, "node bigint, code bigint"), "codes")
        bitmap = spark.sparkContext.broadcast(_bitmap(codes))
        sets = docs.select("id", "text").mapInArrow(_wanted_sets(k, bitmap), "code bigint, members binary")
        # rows that share id and text have one code
        sets = stored(codes.join(sets, "code").groupBy("node").agg(F.first("members").alias("members")), "sets")
        s = lambda c: sets.select(F.col("node").alias(c), F.col("members").alias(f"s{c}"))
        links = stored(pairs.join(s("a"), "a").join(s("b"), "b").mapInArrow(_linked(num, den), "a bigint, b bigint"), "links")
        dropped(first, pairs, codes)
        return links, sets

    leader = stored(members.groupBy("key").agg(F.min(F.struct(-F.col("score"), F.col("node").alias("node")))["node"].alias("a")), "leader")
    led = members.select("key", "c", F.col("node").alias("b")).join(leader, "key").where("a <> b")
    # of larger shards each node takes the leader that it shares most with: the others' pairs, if still open, follow below
    most = led.where("c > 2").groupBy("a", "b").agg(F.count("*").alias("k")).groupBy("b").agg(F.max(F.struct("k", "a"))["a"].alias("a"))
    stars = stored(led.where("c = 2").select("a", "b").union(most.select("a", "b")).distinct(), "stars")
    links, sets = verified(bounded(stars, "vec"))
    comp = stored(components(links), "components")
    # of two members the only pair was a star
    m = stored(members.where("c > 2").join(comp, "node", "left").select("key", "node", "n", "pos", "last", F.coalesce("component", "node").alias("comp")), "placed")
    parts = stored(m.groupBy("key", "comp").agg(F.count("*").alias("c")), "parts")
    open_keys = parts.groupBy("key").agg(F.sum("c").alias("c"), F.max(F.struct("c", "comp")).alias("most"), F.count("*").alias("comps")).where("comps > 1")
    large = F.col("c") > BLOCK
    open_keys = stored(open_keys.select("key", F.when(large, F.col("most.comp")).alias("main"), F.when(large, _blocks(F.col("most.c"))).otherwise(0).alias("main_blocks"), F.when(large, _blocks(F.col("c") - F.col("most.c"))).otherwise(1).alias("blocks"), "c"), "open")
    # how many rows the blocks have in all, so that a task has a bounded number
    dealt = open_keys.agg(F.sum(F.col("c") * (F.col("main_blocks") + F.col("blocks")))).first()[0] or 0
    own = stored(members.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("own")), "own")
    m = m.join(open_keys.drop("c"), "key")
    main = F.col("comp").eqNullSafe(F.col("main"))
    m = _dealt(m, F.when(main, F.col("blocks") + _side(F.col("main_blocks"))).otherwise(_side(F.col("blocks"))), F.when(main, F.col("blocks")).otherwise(F.col("blocks") + F.col("main_blocks")))
    # by sizes and positions first: counts and keys of a node travel only where it may have a partner
    block = ("key", "i", "j")
    grouped = lambda df, rows: df.repartition(pieces(spark, rows, 64 * BLOCK), *block).sortWithinPartitions(*block)
    m = grouped(m.select(*block, "same", "side", "node", "comp", "n", "pos", "last"), dealt)
    m = stored(m.mapInArrow(_promising(num, den), m.schema).drop("last"), "promising")
    earlier = F.filter("own", lambda x: x < F.col("key"))
    full = m.join(own, "node").withColumn("before", F.slice(earlier, F.greatest(F.lit(1), F.size(earlier) - BEFORE + 1), BEFORE)).drop("own")
    full = full.join(node.select("node", "vec"), "node")
    pairs = grouped(full, m.count()).mapInArrow(_shards(num, den), "a bigint, b bigint").distinct()
    more, more_sets = verified(pairs)
    dropped(members, leader, stars, comp, parts, open_keys, own, m)
    every_link = stored(links.union(more), "links")
    comp = stored(components(every_link), "components")
    # every node of a link had its set fetched
    inner = sets.union(more_sets.join(sets.select("node"), "node", "left_anti")).join(comp.select("node"), "node", "left_semi")
    held = stored(inner, "sets")
    dropped(links, more, sets, more_sets, node)
    return Joined(ids, every_link, comp, held, [ids, every_link, comp, held])


def _inner(j: Joined, num: int, den: int, copies: DataFrame, pairs: bool) -> DataFrame:
    """Step 6 for components of three or more nodes."""
    spark = j.nodes.sparkSession
    sized = j.components.join(j.sets.select("node", F.length("members").alias("bytes")), "node")
    sized = sized.groupBy("component").agg(F.count("*").alias("c"), F.sum("bytes").alias("bytes")).where("c > 2")
    blocks = F.ceil(F.greatest(F.col("c") / TILE, F.col("bytes") / (8 * TILE_MEMBERS))).cast("int")
    sized = stored(sized.select("component", "c", F.least(blocks, F.col("c").cast("int")).alias("blocks")), "sized")
    dealt = sized.agg(F.sum(F.col("c") * F.col("blocks"))).first()[0] or 0
    tiles = j.components.join(sized.drop("c"), "component")
    tiles = _dealt(tiles, _side(F.col("blocks")), F.col("blocks")).join(copies, "node").join(j.sets, "node")
    tiles = tiles.repartition(pieces(spark, dealt, 4 * TILE), "component", "i", "j").sortWithinPartitions("component", "i", "j")
    return tiles.mapInArrow(_tiles(num, den, pairs), "a bigint, b bigint" if pairs else "node bigint, near bigint")


def _pairs_of_two(j: Joined) -> DataFrame:
    two = j.components.groupBy("component").agg(F.count("*").alias("c"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("c = 2")
    return two.select(F.col("lo").alias("a"), F.col("hi").alias("b"))


def _copies(nodes: DataFrame) -> DataFrame:
    return stored(nodes.where("node is not null").groupBy("node").agg(F.count("*").alias("copies")), "copies")


def links_of(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(nodes as (id, node, n), all links as (a, b), a < b, between nodes) of docs (id, text)."""
    j = joined(docs, k, num, den)
    links = stored(_pairs_of_two(j).union(_inner(j, num, den, _copies(j.nodes), True)), "all-links")
    return j.nodes.select("id", "node", "n"), links


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))


def _labelled(j: Joined, key: str) -> DataFrame:
    """(key, node, n_shingles, component_id) of each row."""
    p = j.nodes.join(j.components, "node", "left").select("id", "node", "n", F.coalesce("component", "node").alias("c"))
    p = stored(p, "placed")
    low = stored(p.where("c is not null").groupBy("c").agg(F.min("id").alias("low")), "low")
    return p.join(low, "c", "left").select(F.col("id").alias(key), "node", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("low")).alias("component_id"))


def groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of each row: the set's size and the smallest id that links reach."""
    j = joined(_documents(docs, key, text), k, num, den)
    out = _labelled(j, key).drop("node")
    dropped(*j.scratch)
    return out


def deduplicated(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, unchanged, but of each group that links connect one alone: that of the smallest id, of several with
    that id the one with the least row_key, of those with equal texts any. Rows without words stay."""
    j = joined(_documents(docs, key, text), k, num, den)
    p = stored(j.nodes.where("node is not null").join(j.components, "node", "left").select("id", "row", F.coalesce("component", "node").alias("c")), "placed")
    dropped(*j.scratch)
    first = stored(p.groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))["row"].alias("first"), F.count("*").alias("rows")).where("rows > 1"), "first")
    kept = among(docs, p.join(first, "c").where("row <> first"), key, text)
    again = stored(p.groupBy("row").agg(F.count("*").alias("rows")).where("rows > 1").join(first.select(F.col("first").alias("row")), "row", "left_semi"), "again")
    if again.isEmpty():
        return kept
    return among(kept, again, key, text).unionByName(among(kept, again, key, text, "left_semi").dropDuplicates([key, text]))


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, n_links) of each row: as groups(), and how many other rows are linked with it,
    copies among them."""
    j = joined(_documents(docs, key, text), k, num, den)
    copies = _copies(j.nodes)
    two = _pairs_of_two(j)
    two = two.select(F.col("a").alias("node"), F.col("b").alias("other")).union(two.select("b", "a"))
    two = two.join(copies.select(F.col("node").alias("other"), F.col("copies").alias("near")), "other").select("node", "near")
    near = stored(two.union(_inner(j, num, den, copies, False)).groupBy("node").agg(F.sum("near").alias("near")), "near")
    p = _labelled(j, key)
    dropped(*j.scratch)
    n_links = F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("near", F.lit(0))
    return p.join(copies, "node", "left").join(near, "node", "left").select(key, "n_shingles", "component_id", n_links.alias("n_links"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), 3, 90, 100).select("doc_id", "n_shingles", "component_id", "n_links")


OP8_SQL = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) >= 3 then [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]
                                          when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
laps as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
link as (select a, b from laps join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 90 * (x.n + y.n - i)),
reach(doc_id, c) as (select doc_id, doc_id from w union select link.b, reach.c from reach join link on link.a = reach.doc_id),
near as (select a, count(*) as n_links from link group by a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, min(c) as component_id, coalesce(n_links, 0) as n_links
from w left join n on n.doc_id = w.doc_id left join near on near.a = w.doc_id join reach on reach.doc_id = w.doc_id group by w.doc_id, n.n, n_links
"""


def brute_force(rows: list[tuple[int, str | None]], k: int, num: int, den: int) -> dict[int, tuple[int, int]]:
    """The definition itself, for tests with distinct ids: id -> (size, component)."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    by: dict[tuple, list[int]] = {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    tried = set()
    for members in by.values():
        for a, x in enumerate(members):
            for y in members[:a]:
                if (x, y) not in tried:
                    tried.add((x, y))
                    lap = len(sets[x] & sets[y])
                    if den * lap >= num * (len(sets[x]) + len(sets[y]) - lap):
                        a_, b_ = find(x), find(y)
                        root[max(a_, b_)] = min(a_, b_)
    return {i: (len(s), find(i)) for i, s in sets.items()}
