"""Words, hashes, windows and components against plain Python."""

import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import vectext as V
from millrace.llm.components import components

texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab AB\n\t\x0b\x0c\x1cñ ¹", max_size=30)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(texts, st.booleans(), st.sampled_from([1, 9, 60, 1 << 20]))
def test_words_are_those_of_split(rows, fold, piece):
    want = [((t or "").encode().lower() if fold else (t or "").encode()).split() for t in rows]
    got, by_hash = [], {}
    for w in V.words(pa.array(rows, pa.string()), fold, piece=piece):
        for i in range(w.rows):
            own = []
            for k in range(w.first[i], w.first[i + 1]):
                s = bytes(w.buf[w.start[k] : w.end[k]])
                s = s.lower() if fold else s
                assert by_hash.setdefault(s, w.hash[k]) == w.hash[k]
                own.append(s)
            got.append(own)
    assert got == want
    assert len(set(by_hash.values())) == len(by_hash)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 12))
def test_equal_windows_have_equal_hashes_and_others_not(ids, k):
    h = V.mix(np.array(ids, np.uint64) + np.uint64(1))
    got = V.windows(h, k)
    runs = [tuple(ids[i : i + k]) for i in range(len(ids) - k + 1)]
    assert len(got) == len(runs)
    seen = {}
    for r, x in zip(runs, got.tolist(), strict=True):
        assert seen.setdefault(r, x) == x
    assert len(set(seen.values())) == len(seen)


def test_long_words_are_told_apart():
    """Thue-Morse words and their opposites agree as polynomials modulo 2^64 from 1,024 letters on."""
    for size in (60, 64, 65, 1024, 2048):
        word = "".join("ab"[bin(i).count("1") % 2] for i in range(size))
        other = word.translate(str.maketrans("ab", "ba"))
        (w,) = V.words(pa.array([f"{word} {other} {word.upper()}"]), True)
        assert w.hash[0] != w.hash[1] and w.hash[0] == w.hash[2]
        (w,) = V.words(pa.array([f"{word} {word.upper()}"]), False)
        assert w.hash[0] != w.hash[1]


def test_sliced_and_binary_columns():
    col = pa.array(["zz", "a b", None, "c"]).slice(1)
    assert [w.doc.tolist() for w in V.words(col, False)] == [[0, 0, 2]]
    assert [w.doc.tolist() for w in V.words(pa.array([b"a b", None, b"\xff"]), False)] == [[0, 0, 2]]
    assert list(V.words(pa.array([], pa.string()), False)) == []


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 1000 + i) for i in range(60)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
