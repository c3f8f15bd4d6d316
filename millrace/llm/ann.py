"""Approximate nearest neighbours by learned partitions.

Partitions. A table of n rows has about sqrt(n / 64) partitions, a power of two: two from 256 rows on, and more and larger
ones as it grows. Up to FAN of them are one level; more are two levels, partitions within partitions, FAN * FAN at most
(from about 10^9 rows on; the routers of all then have some 50 MB), and partitions beyond that grow with the table.

Fit. Of a sample of at most SAMPLE vectors (those whose id hashes lowest) four in five give a graph of each vector's
nearest others, which is cut into partitions of equal size by recursive spectral bisection at the median and refined by
swaps that cut fewer edges; a small network with one hidden layer then learns from a vector which partition is its own.
The second level is fitted in the same way for each partition of the first, by a task each, on at most SAMPLE rows of the
partition. How many partitions are probed is settled by the fifth of the sample that nothing was fitted on: so many that
`recall` of its neighbours in the sample are found.

Index: every row goes to its most probable partition. Search: a query goes to its `probes` most probable partitions, where
all rows are scored exactly in double precision; nothing is cut short. A partition of more than BLOCK rows is cut into
blocks by a hash of the id, and so are its queries, so a vector that a third of all rows have is many bounded tasks. A
block returns its k best for each query, and the k best of these are the result. Ties go to the smaller id.

Defined cases: vectors that are null, zero, hold null or non-finite components or have another dimension than most of the
sample take no part, as query or candidate; rows with a null id neither; a query's candidates are all rows of another id;
repeated rows count once; fewer than k candidates give fewer rows; an empty table gives an empty result; further columns
are ignored. Fewer than 256 rows, or than 64 different vectors in the sample, are one partition.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

SAMPLE = 4096
FAN = 64
#: Of the neighbours of held-out vectors of the sample.
RECALL = 0.96
#: Queries by which the number of probes is settled, at most.
TRIED = 512
NEAREST = 10
HIDDEN = 96
BLOCK = 4096


def knn_graph(x: np.ndarray, k: int) -> np.ndarray:
    """k nearest others (inner product) of each row."""
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    return np.argpartition(-s, k - 1, axis=1)[:, :k]


def balanced_cut(near: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """A partition of the symmetric graph into `parts` (a power of two) sets whose sizes differ by one at most a level."""
    n = len(near)
    a = np.zeros((n, n), np.float32)
    a[np.arange(n)[:, None], near] = 1
    a = np.maximum(a, a.T)
    label = np.zeros(n, np.int64)
    rng = np.random.default_rng(seed)
    size = 1
    while size < parts:
        new = label * 2
        for p in range(size):
            rows = np.flatnonzero(label == p)
            if len(rows) < 2:
                continue
            sub = a[np.ix_(rows, rows)]
            root = np.sqrt(sub.sum(1) + 1.0)
            v = rng.standard_normal(len(rows)).astype(np.float32)
            for _ in range(40):  # power iteration for the second vector of the normalised graph
                v -= root * (root @ v) / (root @ root)
                v = (sub @ (v / root)) / root + v / root**2 + v
                v /= np.linalg.norm(v) + 1e-12
            order = np.argsort(v / root, kind="stable")
            new[rows[order[len(rows) // 2 :]]] += 1
        label = new
        size *= 2
    for _ in range(4):  # swaps of the vertices that gain most by changing places
        links = np.stack([a[:, label == p].sum(1) for p in range(parts)], 1)
        gain = links - links[np.arange(n), label][:, None]
        want = gain.argmax(1)
        wish: dict[tuple[int, int], list[int]] = {}
        for i in np.argsort(-gain.max(1), kind="stable"):
            if want[i] != label[i] and gain[i, want[i]] > 0:
                wish.setdefault((int(label[i]), int(want[i])), []).append(int(i))
        swapped = 0
        for (p, q), xs in wish.items():
            for i, j in zip(xs, wish.get((q, p), []), strict=False) if p < q else ():
                label[i], label[j] = q, p
                swapped += 1
        if not swapped:
            break
    return label


class Router:
    """Probabilities of partitions: one hidden layer, fitted by Adam on the whole sample."""

    def __init__(self, x: np.ndarray, y: np.ndarray, parts: int, steps: int = 250, seed: int = 0):
        rng = np.random.default_rng(seed)
        d = x.shape[1]
        self.scale = 1.0 / (np.sqrt((x**2).mean()) + 1e-12)
        p = [rng.standard_normal((d, HIDDEN)) / np.sqrt(d), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) / np.sqrt(HIDDEN), np.zeros(parts)]
        m, v = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p]
        x, one = x * self.scale, np.eye(parts)[y]
        for t in range(1, steps + 1):
            h = np.tanh(x @ p[0] + p[1])
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(1, keepdims=True))
            g = (z / z.sum(1, keepdims=True) - one) / len(x)
            back = (g @ p[2].T) * (1 - h**2)
            grads = [x.T @ back + 1e-4 * p[0], back.sum(0), h.T @ g + 1e-4 * p[2], g.sum(0)]
            for w, gr, mi, vi in zip(p, grads, m, v, strict=True):
                mi += 0.1 * (gr - mi)
                vi += 0.01 * (gr**2 - vi)
                w -= 0.02 * (mi / (1 - 0.9**t)) / (np.sqrt(vi / (1 - 0.99**t)) + 1e-8)
        self.p = p

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.tanh(x * self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def partitions_for(rows: int) -> int:
    """A power of two near sqrt(rows / 64), at most FAN * FAN."""
    return 1 if rows < 256 else min(FAN * FAN, 1 << round(math.log2(rows / 64) / 2))


class Level:
    """Partitions of a sample, at most `parts`, and the network that routes to them."""

    def __init__(self, sample: np.ndarray, parts: int):
        x = np.unique(sample, axis=0)
        self.parts = 1
        while self.parts < parts and self.parts * 64 <= len(x):
            self.parts *= 2
        if self.parts == 1:
            self.router = None
            return
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.router = Router(x, balanced_cut(knn_graph(unit, min(NEAREST, len(x) - 1)), self.parts), self.parts)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        return np.zeros((len(x), 1)) if self.router is None else self.router.log_probabilities(x)


class Partitions:
    """One or two levels. A partition's number is that of its first level times `width`, plus that of its second."""

    def __init__(self, top: Level, width: int = 1):
        self.top, self.width, self.probes = top, width, 1
        self.below: dict[int, Level] = {}

    def home(self, x: np.ndarray) -> np.ndarray:
        first = self.top.log_probabilities(x).argmax(1)
        out = first * self.width
        for p, level in self.below.items():
            at = np.flatnonzero(first == p)
            if len(at):
                out[at] += level.log_probabilities(x[at]).argmax(1)
        return out

    def order(self, x: np.ndarray) -> np.ndarray:
        """All partitions by falling probability."""
        first = self.top.log_probabilities(x)
        every = np.full((len(x), self.top.parts, self.width), -np.inf)
        for p in range(self.top.parts):
            own = self.below[p].log_probabilities(x) if p in self.below else np.zeros((len(x), 1))
            every[:, p, : own.shape[1]] = first[:, p, None] + own
        return np.argsort(-every.reshape(len(x), -1), axis=1, kind="stable")

    def settle(self, x: np.ndarray, held: np.ndarray, k: int, recall: float) -> None:
        """Sets probes by the rows `held` of the sample x."""
        q = held[:: max(1, len(held) // TRIED)]
        parts = self.top.parts * self.width
        if parts == 1 or not len(q) or len(x) < 2:
            self.probes = parts
            return
        s = x[q] @ x.T
        s[np.arange(len(q)), q] = -np.inf
        k = min(k, len(x) - 1)
        best = np.argpartition(-s, k - 1, axis=1)[:, :k]
        at = np.empty((len(q), parts), np.int64)  # at which probe each partition is reached
        np.put_along_axis(at, self.order(x[q]), np.broadcast_to(np.arange(parts), (len(q), parts)), 1)
        reached = np.sort(np.take_along_axis(at, self.home(x)[best], 1).ravel())
        self.probes = int(reached[min(len(reached) - 1, math.ceil(recall * len(reached)) - 1)]) + 1

    def route(self, x: np.ndarray) -> np.ndarray:
        return self.order(x)[:, : self.probes]


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _assign(index, dim: int, queries: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256 if queries else 4096):
                part = b.slice(lo, 256 if queries else 4096)
                x = _matrix(part.column(1), dim)
                got = index.value.route(x) if queries else index.value.home(x)[:, None]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1) * got.shape[1], pa.int32()), pa.array(got.ravel().astype(np.int32)))
                yield pa.record_batch([part.column(0), part.column(1), lists], ["id", "v", "parts"])

    return run


def _fit_below(dim: int, parts: int):
    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("id").to_numpy(), kind="stable")
        level = Level(_matrix(t.column("v"), dim)[order], parts)
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "level": pa.array([pickle.dumps(level)], pa.binary())})

    return run


def fitted(v: DataFrame, x: np.ndarray, rows: int, k: int, recall: float, dim: int) -> Partitions:
    """The index for the rows (id, v), of which x is the sample."""
    spark = v.sparkSession
    parts = partitions_for(rows)
    held = np.arange(0, len(x), 5)
    own = np.delete(x, held, axis=0) if len(x) >= 128 else x
    first = parts if parts <= FAN else 1 << (parts.bit_length() // 2)
    index = Partitions(Level(own, first), max(1, parts // first))
    if index.width > 1:
        found = spark.sparkContext.broadcast(index)
        placed = v.mapInArrow(_assign(found, dim, False), "id bigint, v array<double>, parts array<int>").select("id", "v", F.col("parts")[0].alias("part"))
        # about SAMPLE rows of each partition, by a hash of their ids: partitions of the first level are about equal
        share = min(1.0, SAMPLE * index.top.parts / rows)
        chosen = placed.where(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 30)) < int(share * (1 << 30)))
        rank = F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64(F.lit(7), "id"), "id"))
        chosen = chosen.withColumn("r", rank).where(F.col("r") <= SAMPLE).select((F.col("part") / index.width).cast("int").alias("part"), "id", "v")
        # FAN rows of a few hundred kB at most
        for r in chosen.groupBy("part").applyInArrow(_fit_below(dim, index.width), "part int, level binary").collect():
            index.below[r["part"]] = pickle.loads(bytes(r["level"]))
    index.settle(x, held, k, recall)
    return index


def _score(dim: int, k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if queries.num_rows and rows.num_rows:
            ids, v = rows.column("id").to_numpy(), _matrix(rows.column("v"), dim)
            qids, q = queries.column("id").to_numpy(), _matrix(queries.column("v"), dim)
            for lo in range(0, len(q), 256):
                s = q[lo : lo + 256] @ v.T
                s[qids[lo : lo + 256, None] == ids] = -np.inf
                least = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
                slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
                for i in range(len(s)):
                    # the product above may round by position: what decides is the same sum for equal vectors
                    c = np.flatnonzero((s[i] >= least[i] - slack[i]) & (s[i] > -np.inf))
                    exact = (v[c] * q[lo + i]).sum(1)
                    top = np.lexsort((ids[c], -exact))
                    # repeated rows count once, here and in the merge
                    new = np.append(True, (ids[c[top]][1:] != ids[c[top]][:-1]) | (exact[top][1:] != exact[top][:-1]))[: len(top)]
                    top = top[new][:k]
                    out[0].append(np.full(len(top), qids[lo + i]))
                    out[1].append(ids[c[top]])
                    out[2].append(exact[top])
        cat = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table([pa.array(cat[0].astype(np.int64)), pa.array(cat[1].astype(np.int64)), pa.array(cat[2].astype(np.float64))], ["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of largest inner product of each row where is_query holds.
    recall: of the neighbours of held-out rows of the sample; 1 asks for as many partitions as find all of them."""
    spark = vectors.sparkSession
    v = vectors.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    sample = v.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    dim = Counter(len(r["v"]) for r in sample).most_common(1)[0][0] if sample else 0
    v = v.where(F.size("v") == dim)
    rows = v.count()
    x = np.array([r["v"] for r in sample if len(r["v"]) == dim])
    none = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not len(x):
        return none
    index = spark.sparkContext.broadcast(fitted(v.select("id", "v"), x, rows, k, recall, dim))
    schema = "id bigint, v array<double>, parts array<int>"
    placed = stored(v.select("id", "v").mapInArrow(_assign(index, dim, False), schema).select("id", "v", F.col("parts")[0].alias("part")), "index")
    asked = stored(v.where("q").select("id", "v").mapInArrow(_assign(index, dim, True), schema).select("id", "v", F.explode("parts").alias("part")), "queries")
    # blocks by partition: FAN * FAN rows at most
    blocks = lambda df, name: df.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    cuts = F.broadcast(stored(blocks(placed, "nr").join(blocks(asked, "nq"), "part"), "blocks"))
    own = lambda n: F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), n).cast("int")  # noqa: E731  repeated rows are dealt apart
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(cuts, "part").withColumn("qb", own(F.col("nq"))).select("part", "qb", every("nr").alias("rb"), "id", "v")
    right = placed.join(cuts, "part").withColumn("rb", own(F.col("nr"))).select("part", every("nq").alias("qb"), "rb", "id", "v")
    keys = ["part", "qb", "rb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_score(dim, k), "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes as many partitions as all neighbours of the sample's held-out rows ask for."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, recall=1.0)


#: Exact search. The given vectors are nearly uniform, so all neighbours of held-out rows ask for all partitions, or nearly
#: so; where a partition is left out the SQL may find more.
OP9_SQL = """
with v as (select vec_id, embedding::double[] as e from embeddings
           where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
             and len([x for x in embedding if x <> 0]) > 0),
r as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as score from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from r) where rank <= 20
"""


def brute_force(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, k: int = 20) -> dict[int, list[tuple[int, float]]]:
    out = {}
    for q in queries:
        i = int(np.flatnonzero(ids == q)[0])
        s = (x * x[i]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), float(s[j])) for j in order]
    return out
