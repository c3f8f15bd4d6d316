"""Each stage of the corpus pipeline against brute force on its own input."""

import hashlib
from pathlib import Path

import pytest

import corpus_pipeline
from millrace.llm import bpe, decontamination, ngram_join, secrets, toxicity
from millrace.llm.common import crc_mod5, stored, table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def test_stages(spark):
    import public_tokenizers as P
    import tiktoken

    docs = table(spark, DATA, "documents")
    names = docs.columns
    rows = lambda df: {r["doc_id"]: r for r in df.collect()}
    before = rows(docs)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DATA), "test")
        after = rows(docs)
        seen.append(name)
        if name == "toxicity":
            model = toxicity.train(table(spark, DATA, "documents"), table(spark, DATA, "labels"), crc_mod5() != 0)
            assert set(after) == {i for i, r in before.items() if model.score(r["text"]) < 0.5}
        elif name == "near duplicates":
            groups = ngram_join.brute_force([(i, r["text"]) for i, r in before.items()], corpus_pipeline.SHINGLE, corpus_pipeline.SIMILARITY, 100)
            assert set(after) == {i for i, (_, c) in groups.items() if c == i}
            assert len(after) < len(before)
        elif name == "benchmark decontamination":
            items = [tuple(r) for r in table(spark, DATA, "benchmark").select("item_id", "text").collect()]
            bad = {i for i, _ in decontamination.brute_force([(i, r["text"]) for i, r in before.items()], items)}
            assert {i for i in before if i not in after} == bad
        elif name == "secrets":
            assert set(after) == set(before)
            for i, r in after.items():
                if not secrets.base_spans(before[i]["text"]):
                    assert r["text"] == before[i]["text"]
                assert not secrets.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        else:
            ranks = bpe.Ranks(Path(P.path(bpe.VOCABULARY)).read_bytes())
            e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})
            assert set(after) == set(before)
            for i, r in after.items():
                ids = e.encode_ordinary(before[i]["text"])
                assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            continue
        assert docs.columns == names
        before = after
    assert seen == [n for n, _ in corpus_pipeline.STAGES] and len(seen) == 5


def test_stages_take_nulls_and_repeats(spark):
    rows = [(None, None, None, None, None), (1, None, "en", "a", None), (1, "", "en", "a", 0), (2, "same words here", None, "b", 15), (2, "same words here", None, "b", 15), (3, "Same words HERE", "en", "c", 15), (4, "token = abcdefgh12345678", "en", "c", 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DATA), "test")
    got = sorted((str(r.doc_id), r.n_tokens) for r in docs.collect())
    assert [i for i, _ in got] == ["1", "1", "2", "4", "None"]
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_rows_are_judged_by_themselves(spark):
    a, b, c = ("one two three four five six", "other words that nobody else has here", "a third text of some seven words")
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").where("length(text) > 80").first()["text"]
    rows = [(1, a), (2, a), (2, b), (2, b), (None, a), (None, c), (None, c), (5, item), (5, c + " indeed"), (None, item)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = stored(corpus_pipeline.drop_near_duplicates(spark, docs, DATA), "test")
    assert kept.columns == docs.columns
    got = sorted(((str(r.doc_id), r.text) for r in kept.collect()), key=repr)
    assert got == sorted([("1", a), ("2", b), ("5", item), ("5", c + " indeed"), ("None", c)], key=repr)
    clean = corpus_pipeline.drop_contaminated(spark, docs, DATA)
    assert clean.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in clean.collect()) == sorted((str(i), t) for i, t in rows if t != item)
