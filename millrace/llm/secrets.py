"""Secret scans: base rules, and a likelihood ratio of two character Markov models.

Base rules, each leftmost and non-overlapping by itself; a match that is too short is dropped after it was passed:
assign (a credential's name, then = or :, then a value of 8 characters or more), access (AKIA, then upper-case letters
and digits, 16 characters or more in all), hex (32 lower-case hexadecimal digits or more).

The method adds spans of kind markov: runs of letters, digits, + / _ - and = whose mean log-likelihood ratio a character
exceeds a threshold. What base spans cover is cut out of a run first. A run is asked as a whole, and if it isn't taken, its
parts between separators; runs and parts of fewer than MIN_LENGTH characters, of digits or separators alone, or in the form of
a UUID (an identifier by its format) are passed over. One model holds transitions of random strings, the other those of
ordinary identifiers; both are bigram models over printable ASCII characters with begin and end, smoothed by one. They
are trained on the driver from labelled samples: by default SAMPLE_ROWS generated random strings in several alphabets
with a fixed seed, and as many identifiers joined from the words below, or long words; labelled strings of the caller can
take their place. The threshold is the point between both classes' scores on the held-out fifth of the samples that errs
least, at least 0.

Defined cases: null and empty texts have no span; texts are scanned whole; positions are code points, the end exclusive;
equal rows give equal rows; a null id is kept; further columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, table, tidy

#: The base rules.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run is taken whole, so this is [0-9a-f]+ of 32 characters or more
KINDS = ("assign", "access", "hex", "markov")
_HINTS = ("password", "passwd", "secret", "token", "api")

MIN_LENGTH = 20
SAMPLE_ROWS = 4000
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH)

#: Words of which ordinary identifiers are joined.
WORDS = (
    "get set make find load save read write open close start stop file path name value index count total first last next "
    "user group role order item list table column row page block event state error message request response header body "
    "client server session config option default local remote cache buffer stream parse format encode decode string number "
    "array object class method field type size length width height color image button window module package version test "
    "build deploy release update delete insert select query result report summary account customer product price amount "
    "date time year month week day hour minute second zone country city street address phone mail domain host port "
    "network socket thread process task queue worker manager service handler factory builder provider adapter helper util"
).split()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules' matches, sorted."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def labelled_samples(rows: int = SAMPLE_ROWS, seed: int = 5) -> tuple[list[str], list[str]]:
    """(random strings, ordinary identifiers), as many of each."""
    rng = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = [digits + "abcdef", digits + "ABCDEF", digits + lower, digits + lower + upper, digits + lower + upper + "+/", digits + lower + upper + "-_", digits + upper]
    strings = ["".join(rng.choices(a, k=rng.randint(20, 64))) for a in (rng.choice(alphabets) for _ in range(rows))]
    names = []
    for _ in range(rows):
        parts = [rng.choice(WORDS) for _ in range(rng.randint(3, 7))]
        if rng.random() < 0.5:
            parts.insert(rng.randint(1, len(parts)), str(rng.choice([rng.randint(0, 99), rng.randint(1990, 2039)])))
        style = rng.randrange(6)
        if style == 1:
            parts = [p.upper() for p in parts]
        elif style == 2:
            parts = [parts[0], *(p.capitalize() for p in parts[1:])]
        names.append({0: "_", 1: "_", 2: "", 3: "-", 4: "/", 5: ""}[style].join(parts))
    return strings, names


class Markov:
    """log P(next | previous), trained on strings."""

    SYMBOLS = "".join(map(chr, range(33, 127)))

    def __init__(self, strings: Sequence[str]):
        n = len(self.SYMBOLS) + 2
        at = {c: i for i, c in enumerate(self.SYMBOLS)}
        counts = [[1.0] * n for _ in range(n)]
        for s in strings:
            ids = [n - 2, *(at.get(c, 0) for c in s), n - 1]
            for a, b in zip(ids, ids[1:], strict=False):
                counts[a][b] += 1
        self.at, self.end = at, n - 1
        self.log = [[math.log(x / total) for x in row] for row in counts if (total := sum(row))]

    def score(self, s: str) -> float:
        ids = [self.end - 1, *(self.at.get(c, 0) for c in s), self.end]
        return sum(self.log[a][b] for a, b in zip(ids, ids[1:], strict=False))


class Ratio:
    """Mean log-likelihood ratio a character, random against ordinary, and a threshold."""

    def __init__(self, strings: Sequence[str], names: Sequence[str]):
        kept = lambda x: [s for i, s in enumerate(x) if i % 5]
        held = lambda x: [s for i, s in enumerate(x) if i % 5 == 0]
        self.random, self.ordinary = Markov(kept(strings)), Markov(kept(names))
        marked = sorted([(self.of(s), 1) for s in held(strings)] + [(self.of(s), 0) for s in held(names)])
        wrong = sum(1 - y for _, y in marked)  # all are called random
        best, self.threshold = wrong, marked[0][0] if marked else 0.0
        for (x, y), (z, _) in zip(marked, marked[1:], strict=False):
            wrong += 1 if y else -1
            if wrong <= best:
                best, self.threshold = wrong, (x + z) / 2
        self.threshold = max(0.0, self.threshold)
        self.held_out_errors, self.held_out_rows = best, len(marked)

    def of(self, s: str) -> float:
        return (self.random.score(s) - self.ordinary.score(s)) / (len(s) + 1)


UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_PART = re.compile(r"[A-Za-z0-9]{%d,}" % MIN_LENGTH)


def markov_spans(text: str, ratio: Ratio, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that base spans, which are sorted, don't touch."""
    out = []

    def asked(a: int, b: int) -> bool:
        s = text[a:b]
        if b - a < MIN_LENGTH or not any(c.isalpha() for c in s):
            return False
        return ratio.of(s) > ratio.threshold

    for m in CANDIDATE.finditer(text):
        pieces, at = [], m.start()
        for x, _, y in base if base else ():
            if x < m.end() and at < y:
                pieces.append((at, min(max(x, at), m.end())))
                at = max(at, y)
        pieces.append((at, m.end()))
        for a, b in pieces:
            # a UUID within a longer run, as prefix-uuid, is cut out like a base span
            for u, v in _around_uuids(text, a, b):
                if asked(u, v):
                    out.append((u, 3, v))
                else:
                    out += [(p.start(), 3, p.end()) for p in _PART.finditer(text, u, v) if (p.start(), p.end()) != (u, v) and asked(p.start(), p.end())]
    return out


def _around_uuids(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    for m in UUID.finditer(text, a, b):
        yield a, m.start()
        a = m.end()
    if b > a:
        yield a, b


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, samples: tuple[Sequence[str], Sequence[str]] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, n_markov, base, spans) of each row; base and spans are lists of kind:start:end."""
    ratio = Ratio(*(samples or labelled_samples()))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                t = t.as_py() or ""
                base = base_spans(t)
                more = markov_spans(t, ratio, base)
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), len(more), named(base), named(sorted(base + more))))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.record_batch([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], [key, "n_assign", "n_access", "n_hex", "n_markov", "base", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_markov bigint, base string, spans string")


MASK = "[SECRET]"


def redact(docs: DataFrame, text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """docs with every span of `text`, overlapping ones as one, replaced by MASK; `size` is set to the new length where
    the text changed. Other rows and columns stay as they are."""
    bounded_batches(docs.sparkSession)
    ratio = Ratio(*labelled_samples())
    names, schema = docs.columns, docs.schema
    has = size in names

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = names.index(text)
            texts, sizes = [], b.column(names.index(size)).to_pylist() if has else None
            for i, t in enumerate(b.column(at)):
                t = t.as_py()
                base = base_spans(t or "")
                spans = sorted(base + markov_spans(t or "", ratio, base))
                if spans:
                    out, done = [], 0
                    for a, _, e in spans:
                        if a >= done:
                            out += [t[done:a], MASK]
                        done = max(done, e)
                    t = "".join([*out, t[done:]])
                    if has:
                        sizes[i] = len(t)
                texts.append(t)
            cols = list(b.columns)
            cols[at] = pa.array(texts, pa.string())
            if has:
                cols[names.index(size)] = pa.array(sizes, b.column(names.index(size)).type)
            yield pa.record_batch(cols, names)

    return docs.mapInArrow(run, schema)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    s = scan(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def reference_spans(text: str | None) -> str:
    """The base rules read literally, for tests."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN.pattern, text, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return named(sorted(out))
