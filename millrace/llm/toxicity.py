"""Toxicity of documents: a learnt lexicon, matched in spite of misspellings, weighed by context.

Lexicon. From at most TRAIN_ROWS labelled training rows (those whose id hashes lowest; the bound is the only sampling
here): whole words and word beginnings of STEMS letters that toxic rows hold in at least LEAST different contexts (the
words before and after; copies of one text have one context), at least RATIO times as often as clean ones hold it at all, and too
often for chance (EVIDENCE nats). The weight of a term is the logarithm
of that ratio, from 0 to 1 at FULL. Longer terms under a beginning have weights of their own, so ordinary words that
begin like abuse are told apart.

Matching. Words of weight SURE and FUZZY_FROM letters go into a trie. A word of the text that the lexicon doesn't hold is
matched by its Levenshtein automaton of distance 1 intersected with the trie: a walk over both at once, in which branches
of the trie that no word within the distance continues are left. Beginnings must agree exactly.

Context. A hit weighs as its term, times FUZZY if misspelled, times QUOTED if it is quoted or a word of reporting is among
the CUES near it. A hit is quoted inside a pair of quotation marks: marks are paired from left to right within a
paragraph, straight ones by turns, others with their counterparts; an apostrophe inside a word is none, and a mark
without a counterpart quotes nothing. The best sum over WINDOW consecutive words tells a
burst of abuse from a word here and there. A logistic regression on such features (no label, language, source or id
among them), fitted on the training rows by Newton's method, gives a score from 0 to 1. Should the sample have no toxic
or no clean row, all score 0.

Defined cases: null and empty texts have no hit and the score of such a text; a null id is scored and isn't held out;
labels of unknown documents are ignored, of repeated ones all count; without labels all score 0; equal texts have equal
scores; an empty table gives an empty result; further columns are ignored. Texts are scored whole.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod5, table, tidy

TRAIN_ROWS = 10_000
LEAST, RATIO = 3, 6.0
#: Of some 100,000 terms none should pass by chance: e^-14 is about 10^-6.
EVIDENCE = 14.0
#: Contexts from which a term beneath a beginning has a weight of its own, and the ratio of weight 1.
ENOUGH, FULL = 5, 200.0
STEMS = (4, 5, 6, 7, 8, 9)
FUZZY_FROM, FUZZY, QUOTED = 5, 0.7, 0.4
SURE, FAINT = 0.75, 0.15
WINDOW = 25
MEMO = 100_000
TOKEN = re.compile(r"[^\W_]+")
#: Words that report what others say, in the languages of the corpus.
CUES = frozenset("said says wrote quoted quote called reported sagte schrieb zitat genannt dit écrit cité appelé dijo escribió cita llamó".split())
#: What closes a quotation that a mark opens.
PAIRS = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "‚": "‘’"}
_MARKS = re.compile("[\"“”„«»‘’‚\n]")


class Lexicon:
    """Weights of words (fuzzy, by a trie) and of beginnings (exact); the longest that is known decides."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.lengths = sorted({len(s) for s in stems}, reverse=True)
        self.trie: dict = {}
        heads: dict[int, set[str]] = {}
        tails: dict[int, set[str]] = {}
        sure = [w for w, x in words.items() if x >= SURE and len(w) >= FUZZY_FROM]
        for w in sure:
            node = self.trie
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
            # within distance 1 one half stays as it is
            h = len(w) // 2
            heads.setdefault(h, set()).add(w[:h])
            tails.setdefault(len(w) - h, set()).add(w[h:])
        self.heads, self.tails = list(heads.items()), list(tails.items())
        sizes = [len(w) for w in sure]
        self.least, self.most = (min(sizes) - 1, max(sizes) + 1) if sizes else (1, 0)
        self.memo: dict[str, float] = {}

    def fuzzy(self, word: str) -> str | None:
        """A word of the lexicon within one edit, the nearest first, or None. A state of the automaton of `word` is the
        set of (letters read, edits made); it and a node of the trie step together."""
        n, k = len(word), 1
        best: tuple[int, str] | None = None
        start = frozenset((i, i) for i in range(min(k, n) + 1))
        stack = [(self.trie, start)]
        while stack:
            node, states = stack.pop()
            for c, child in node.items():
                if c == "":
                    left = min((e + n - i for i, e in states), default=k + 1)
                    if left <= k and (best is None or (left, child) < best):
                        best = (left, child)
                    continue
                step: dict[int, int] = {}
                for i, e in states:
                    if i < n and word[i] == c:
                        step[i + 1] = min(step.get(i + 1, k + 1), e)
                    if e < k:
                        step[i] = min(step.get(i, k + 1), e + 1)  # a letter too few in the word
                        if i < n:
                            step[i + 1] = min(step.get(i + 1, k + 1), e + 1)  # another letter
                for i in sorted(step):  # a letter too many
                    if step[i] < k and i < n:
                        step[i + 1] = min(step.get(i + 1, k + 1), step[i] + 1)
                if step:
                    stack.append((child, frozenset(step.items())))
        return best[1] if best else None

    def weight(self, w: str) -> float:
        """0 to 1 for a word of the lexicon or with a beginning of it, times FUZZY for a misspelled word, else 0."""
        found = self.words.get(w)
        if found is not None:
            return found
        for n in self.lengths:
            if n < len(w) and (found := self.stems.get(w[:n])) is not None:
                return found
        if not self.least <= len(w) <= self.most:
            return 0.0
        if not (any(w[:h] in s for h, s in self.heads) or any(w[-h:] in s for h, s in self.tails)):
            return 0.0
        near = self.fuzzy(w)
        return FUZZY * self.words[near] if near else 0.0

    def hits(self, words: list[str]) -> dict[str, float]:
        """Weights of the distinct words that hit."""
        memo = self.memo
        seen = set(words)
        if len(memo) > MEMO:
            memo.clear()
        for w in seen.difference(memo):
            memo[w] = self.weight(w)
        return {w: memo[w] for w in seen if memo[w] >= FAINT}


def quotations(text: str) -> list[tuple[int, int]]:
    """(start, end) of what stands between paired marks, outermost pairs alone, in order."""
    out: list[tuple[int, int]] = []
    open_at: list[tuple[int, str]] = []  # places and marks that wait for their counterparts
    for m in _MARKS.finditer(text):
        at, c = m.start(), m[0]
        if c == "\n":
            open_at.clear()
            continue
        if c in "‘’" and 0 < at < len(text) - 1 and text[at - 1].isalnum() and text[at + 1].isalnum():
            continue
        k = next((k for k in range(len(open_at) - 1, -1, -1) if c in PAIRS[open_at[k][1]]), None)
        if k is None:
            if c in PAIRS:
                open_at.append((at, c))
            continue
        start = open_at[k][0]
        del open_at[k:]
        while out and out[-1][0] > start:
            out.pop()
        out.append((start, at + 1))
    return out


FEATURES = 7


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    low = (text or "").lower()
    words = TOKEN.findall(low)
    hits = lexicon.hits(words)
    if not hits:
        return [1.0] + [0.0] * (FEATURES - 1)
    at, raw, exact, places = [], [], 0, []
    for i, m in enumerate(TOKEN.finditer(low)):
        w = hits.get(m[0])
        if w:
            at.append(i)
            raw.append(w)
            exact += w >= SURE
            places.append((m.start(), m.end()))
    weights = []
    quotes = quotations(low)
    starts = [a for a, _ in quotes]
    for i, w, (a, e) in zip(at, raw, places, strict=True):
        q = bisect_right(starts, a) - 1
        quoted = q >= 0 and e <= quotes[q][1]
        cue = any(x in CUES for x in words[max(0, i - 6) : i + 7])
        weights.append(w * (QUOTED if quoted or cue else 1.0))
    burst, lo, run = 0.0, 0, 0.0
    for k in range(len(at)):
        run += weights[k]
        while at[k] - at[lo] >= WINDOW:
            run -= weights[lo]
            lo += 1
        burst = max(burst, run)
    total = sum(weights)
    return [1.0, math.log1p(total), math.log1p(burst), math.log1p(len(hits)), math.log1p(exact), math.log1p(100.0 * total / len(words)), 1.0 - total / sum(raw)]


def _terms(word: str) -> list[str]:
    """A word, and its beginnings marked by a star."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


#: Pairs that a task holds before it hands them on.
HELD = 50_000


@tidy
def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, context): the words before and after as a hash, almost without repeats."""

    def batch(out: set[tuple[str, int]]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [(), ()]
        return pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64())], ["term", "context"])

    out: set[tuple[str, int]] = set()
    for b in batches:
        for t in b.column(0):
            words = ["", *TOKEN.findall((t.as_py() or "").lower()), ""]
            for i in range(1, len(words) - 1):
                context = crc32(f"{words[i - 1]} {words[i + 1]}".encode())
                out.update([(x, context) for x in _terms(words[i])])
                if len(out) > HELD:
                    yield batch(out)
                    out = set()
    yield batch(out)


def _occurrences(terms: frozenset[str]):
    """(term, n): how often a task's texts hold each of the terms."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0):
                for w, n in Counter(TOKEN.findall((t.as_py() or "").lower())).items():
                    for x in _terms(w):
                        if x in terms:
                            counts[x] += n
        yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    return run


def evidence(n: int, clean: int, share: float) -> float:
    """Nats against the chance that n of n + clean contexts are toxic where a share of all rows is."""
    total = n + clean
    out = n * math.log(n / total / share)
    return out + clean * math.log(clean / total / (1 - share)) if clean else out


def learn_lexicon(train: DataFrame) -> Lexicon:
    """From (text, toxic): at most TRAIN_ROWS rows in, and terms that several toxic ones of them hold to the driver."""
    size = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not size.get(1) or not size.get(0):
        return Lexicon({}, {})
    toxic = train.where("toxic = 1").select("text").mapInArrow(_contexts, "term string, context bigint").distinct()
    top = toxic.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST).collect()
    clean = train.where("toxic = 0").select("text").mapInArrow(_occurrences(frozenset(r["term"] for r in top)), "term string, n bigint")
    clean_n = {r["term"]: r["n"] for r in clean.groupBy("term").agg(F.sum("n").alias("n")).collect()} if top else {}
    share = size[1] / (size[1] + size[0])
    clean_of = lambda t: clean_n.get(t, 0)
    known = {r["term"]: r["n"] for r in top}
    ratio = {t: (n + 0.5) / (clean_of(t) + 0.5) * size[0] / size[1] for t, n in known.items()}
    strong = [t for t, n in known.items() if ratio[t] >= RATIO and evidence(n, clean_of(t), share) >= EVIDENCE]
    stems = {t[:-1] for t in strong if t.endswith("*")}
    # under a strong beginning, longer ones and words say more precisely what is meant, ordinary words of that beginning too
    kept = set(strong) | {t for t, n in known.items() if n + clean_of(t) >= ENOUGH and any(t[:k] in stems for k in STEMS if k < len(t.rstrip("*")))}
    weight = {t: min(1.0, max(0.0, math.log(ratio[t]) / math.log(FULL))) for t in kept}
    return Lexicon({t: weight[t] for t in sorted(kept) if not t.endswith("*")}, {t[:-1]: weight[t] for t in sorted(kept) if t.endswith("*")})


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a logistic regression."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _featured(lexicon: Lexicon):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.array([features(t.as_py(), lexicon) for t in b.column(0)]).reshape(-1, FEATURES)
            yield pa.record_batch([pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * FEATURES, pa.int32()), pa.array(m.ravel())), b.column(1)], ["x", "toxic"])

    return run


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray | None):
        self.lexicon, self.weights = lexicon, weights

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(features(text, self.lexicon), self.weights))))))


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, key: str = "doc_id", text: str = "text") -> Model:
    """A model from the labelled rows of docs where `learn` holds."""
    marked = labels.where("toxic is not null").select(F.col(key).alias("__id"), F.col("toxic").cast("int").alias("toxic"))
    # the bounded choice is made on ids alone; texts are fetched after
    if learn is not None:
        marked = marked.withColumnRenamed("__id", key).where(learn).withColumnRenamed(key, "__id")
    marked = marked.where("toxic in (0, 1)").orderBy(F.xxhash64("__id"), "__id", "toxic").limit(TRAIN_ROWS)
    rows = docs.select(F.col(key).alias("__id"), F.col(text).alias("text")).join(F.broadcast(marked), "__id").select("text", "toxic").persist()
    try:
        lexicon = learn_lexicon(rows)
        # FEATURES doubles for each of TRAIN_ROWS rows at most
        got = rows.mapInArrow(_featured(lexicon), "x array<double>, toxic int").toArrow() if lexicon.words or lexicon.stems else None
    finally:
        rows.unpersist()
    if got is None or not len(got):
        return Model(lexicon, None)
    x = np.array(got.column("x").combine_chunks().flatten()).reshape(-1, FEATURES)
    order = np.lexsort([*x.T, y := got.column("toxic").to_numpy()])  # the same sums however rows arrive
    return Model(lexicon, fit(x[order], y[order].astype(float)))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of each row."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([model.score(t.as_py()) for t in b.column(1)], pa.float64())], [key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def accepted(docs: DataFrame, model: Model, text: str = "text", most: float = 0.5) -> DataFrame:
    """The rows of docs that score below `most`, unchanged."""
    names, schema = docs.columns, docs.schema

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.score(t.as_py()) < most for t in b.column(names.index(text))], pa.bool_()))

    return docs.mapInArrow(run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), crc_mod5() != 0)
    return score(docs, model).select("doc_id", (crc_mod5() == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


__all__ = ["Lexicon", "Model", "accepted", "edit_distance", "features", "op4_toxicity", "score", "train"]
