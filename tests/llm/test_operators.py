"""The ten operators against brute force, round trips or held-out accuracy, and their defined cases."""

import hashlib
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann, bpe, decontamination, lm_scoring, ngram_join, secrets, substring_dedup, toxicity, url_filters, warc
from millrace.llm.common import crc_mod5

DATA = "/root/testdata/sf0.001"
has_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
DOCS = "doc_id long, text string"


def docs_of(n=None):
    return duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet' order by doc_id" + (f" limit {n}" if n else "")).fetchall()


def near_copies(seed=3, groups=10):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 12, 40, 60, 100]))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append(" ".join(w + [rng.choice(words) for _ in range(rng.choice([0, 0, 3]))]))
    rows += [None, "", "a", "A", "a b", "a b c", " \n\t "]
    rng.shuffle(rows)
    return list(enumerate(rows))


# 1


def test_decontamination_is_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([1, 2, 3, 5, 7, 8, 9, 10, 12, 13, 14, 20, 40])))) for i in range(40)] + [(50, None), (51, "")]
    items.append((60, items[3][1].upper() + "!"))
    docs = []
    for i in range(80):
        w = some(rng.randint(0, 30))
        if rng.random() < 0.7:
            x = (rng.choice(items)[1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                if x:
                    x[rng.randrange(len(x))] = rng.choice(words)
            if rng.random() < 0.3:
                x = x[: rng.randint(0, len(x))]
            w += x + some(rng.randint(0, 20))
        docs.append((i, ", ".join(w)))
    docs += [(90, None), (91, ""), (0, docs[0][1])]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontamination.contaminated(d, b).collect()]
    want = decontamination.brute_force(docs, items)
    assert len(want) > 20 and set(got) == want and len(got) == len(want)
    kept = decontamination.clean(d.withColumn("item", F.lit(1)), b)
    assert kept.columns == ["doc_id", "text", "item"]
    bad = {i for i, _ in want}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i not in bad)
    assert decontamination.contaminated(d.limit(0), b).count() == 0
    assert decontamination.contaminated(d, b.limit(0)).count() == 0


def test_decontamination_masks_see_whatever_the_rule_accepts():
    from itertools import combinations

    for n in range(1, decontamination.WINDOW + 1):
        e = n - -(-4 * n // 5)
        ms = decontamination.masks(n)
        assert all(len(m) == n and "1" in m for m in ms)
        for wrong in combinations(range(n), e):
            assert any(all(m[i] == "0" for i in wrong) for m in ms)


def test_decontamination_without_the_exact_filter(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "EXACT_ROWS", -1)
    items = [(1, " ".join(f"x{i}" for i in range(20)))]
    docs = [(1, "y " * 5 + items[0][1] + " z"), (2, "nothing here at all")]
    got = decontamination.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.matched, r.n_matched, r.position) for r in got] == [(1, 1, 13, 20, 5)]


def test_registered_queries_are_their_sql(spark):
    """Every query of the subpackage that has SQL, as the driver compares them."""
    from millrace.llm.registry import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, DATA)
        want = con.sql(sql)
        assert sorted(df.columns) == sorted(want.columns), name
        cols = sorted(df.columns)
        plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
        got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr)
        assert got == sorted(([plain(r[want.columns.index(c)]) for c in cols] for r in want.fetchall()), key=repr), name


# 2


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(0)
    body = lambda: "".join(rng.choice("ñabc<>\r\n0") for _ in range(rng.choice([0, 5, 999, 1000, 4096, 40000, 90000])))
    rows = [(i, None if i % 7 == 0 else f"http://x/é\r\n{i}", None if i % 11 == 0 else body()) for i in range(120)]
    rows += [(1000 + i, "u", rows[i % 13 + 5][2]) for i in range(60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in warc.op2_warc(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(warc.OP2_SQL)
    assert len(got) == len(rows)
    for w in want.fetchall():
        x = dict(zip(want.columns, w, strict=True))
        assert {c: got[x["page_id"]][c] for c in x} == x
    path = f"{tmp_path}/archives"
    warc.write(spark.read.parquet(f"{tmp_path}/pages.parquet").where("page_id < 100"), path)
    payloads = {int(r.record_id[10:-1]): r.payload for r in warc.read(spark, path).where("kind = 'response'").collect()}
    assert all(bytes(p).decode() == (rows[i][2] or "") for i, p in payloads.items())


def test_warc_repeated_pages_are_a_record_each(spark, tmp_path):
    long, other, small = "a" * 40000, "b" * 50000, "c" * 2000
    rows = [(None, "u", long), (None, "u", long), (None, None, None), (None, "u", "n" * 60000), (1, "u", long), (1, "u", long), (1, "v", other), (2, "u", small), (2, "u", small), (3, "u", "d" * 1500), (9, "u", small), (9, "w", small), (9, "u", long), (9, "x", "e")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(warc.OP2_SQL)
    got = warc.op2_warc(spark, str(tmp_path)).select(want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_warc_broken_segments_are_reported(spark):
    records = [r for r in warc.page_records(5, "u", b"x" * 500, None, segment_bytes=200)]
    assert len(records) == 3 or len(records) == 4
    parsed = lambda rs: list(warc.parsed([b"".join(r + warc.END for r in rs)]))

    def table(rs):
        rows = []
        for f, block in parsed(rs):
            n = f.get("warc-segment-number")
            rows.append((f["warc-record-id"], f["warc-type"], None, f.get("warc-payload-digest"), None, f.get("warc-segment-origin-id", f["warc-record-id"]) if n else None, int(n) if n else None, int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, block))
        return spark.createDataFrame(rows, warc._RECORD)

    of = lambda rs: [r.problem for r in warc.reassembled(table(rs)).collect()]
    assert of(records) == [None]
    assert of(list(reversed(records))) == [None]
    assert of(records[:1] + records[2:]) == ["segments are missing or repeated"]
    assert of(records[:-1]) == ["the segments have another total length"]
    assert of(records + records[1:2]) == ["segments are missing or repeated"]


def test_warc_is_read_in_pieces():
    import gzip

    rng = random.Random(4)
    payloads = [bytes(rng.randbytes(rng.choice([0, 10, 3000, 100_000]))) for _ in range(12)]
    records = [r for i, p in enumerate(payloads) for r in warc.page_records(i, "u", p, None)]
    whole = b"".join(r + warc.END for r in records)
    want = list(warc.parsed([whole]))
    assert len(want) == len(records) and sum(len(b) for _, b in want) > sum(map(len, payloads))
    members = b"".join(gzip.compress(r + warc.END) for r in records)  # a member a record
    for data in (whole, gzip.compress(whole), members):
        for size in (7 if len(data) < 1 << 16 else 997, 1 << 20):
            assert list(warc.parsed(warc.unzipped(data, size))) == want
    assert list(warc.parsed(whole[i : i + 501] for i in range(0, len(whole), 501))) == want
    for bad in (whole[:-500_00], whole[3:], b"WARC/1.1"):
        with pytest.raises(ValueError):
            list(warc.parsed([bad]))


def test_warc_of_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string, record string, sha string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op2_warc(spark, str(tmp_path)).count() == 0


def test_chunks():
    for n in (0, 1, 4095, 4096, 4097, 20000):
        data = bytes(random.Random(n).randbytes(n))
        assert warc.unchunked(warc.chunked(data)) == data
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"3\r\nab", b"zz\r\n", b"\r\n", b"2\r\nabc\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


# 3


def test_bpe_is_tiktoken(spark):
    import public_tokenizers as P
    import tiktoken

    r = bpe.Ranks(Path(P.path(bpe.VOCABULARY)).read_bytes())
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=r.rank, special_tokens={})
    rng = random.Random(0)
    texts = ["", "a" * 3000, "ab" * 1500, " \n\n\t x", "ñé漢字" * 50, "😀" * 40, "it's I'LL don't", "\x1c a\x85b", "<|endoftext|>", "0123456789" * 20]
    texts += ["".join(rng.choice("ab \nñ漢0'st😀zqx") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    rows = [*enumerate(texts), (None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("n_tokens", F.lit("clash"))
    got = {r_.doc_id: r_ for r_ in bpe.encode_texts(df, P.path(bpe.VOCABULARY), P.PATTERN, ids=True).collect()}
    for i, t in rows:
        want = e.encode_ordinary(t or "")
        assert got[i].token_ids == want and got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode_ids(spark.createDataFrame([(i, g.token_ids) for i, g in got.items()] + [(-5, None)], "doc_id long, token_ids array<int>"), P.path(bpe.VOCABULARY))
    assert all(bytes(x.data) == ((texts[x.doc_id] if x.doc_id is not None and x.doc_id >= 0 else "") or "").encode() for x in back.collect())
    assert bpe.encode_texts(df.limit(0), P.path(bpe.VOCABULARY), P.PATTERN).count() == 0


@has_data
def test_bpe_query_is_tiktoken(spark, tmp_path):
    import base64

    import public_tokenizers as P
    import tiktoken

    r = bpe.Ranks(Path(P.path(bpe.VOCABULARY)).read_bytes())
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=r.rank, special_tokens={})
    got = {x.doc_id: x for x in bpe.op3_bpe(spark, DATA).collect()}
    for i, t in docs_of():
        ids = e.encode_ordinary(t)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    # another vocabulary under the same file name
    other = tmp_path / bpe.VOCABULARY
    other.write_bytes(b"".join(base64.b64encode(bytes([b])) + b" %d\n" % b for b in range(256)))
    docs = spark.createDataFrame([(1, "ab")], DOCS)
    assert [x.n_tokens for x in bpe.encode_texts(docs, str(other), P.PATTERN).collect()] == [2]
    assert [x.n_tokens for x in bpe.encode_texts(docs, P.path(bpe.VOCABULARY), P.PATTERN).collect()] == [1]


def test_bpe_trees_agree():
    import public_tokenizers as P

    r = bpe.Ranks(Path(P.path(bpe.VOCABULARY)).read_bytes())
    rng = random.Random(1)
    data = [bytes(rng.choice(b"etaoin shrdlu\xc3\xa9") for _ in range(rng.randint(2, 64))) for _ in range(300)]
    assert [list(x) for x in r.encode_in_step(data)] == [r.encode_long(d) for d in data]


# 4


def test_levenshtein_automaton():
    words = {"loser": 1.0, "idiot": 1.0, "moron": 1.0, "abcde": 1.0}
    lex = toxicity.Lexicon(words, {"lowei": 1.0})
    rng = random.Random(0)
    for _ in range(5000):
        w = list(rng.choice([*words, "xyzzy"]))
        for _ in range(rng.randint(0, 3)):
            k, i = rng.randrange(3), rng.randrange(len(w) + 1)
            if k == 0:
                w.insert(i, rng.choice("aeiou"))
            elif i < len(w):
                w[i : i + 1] = [] if k == 1 else [rng.choice("aeiou")]
        s = "".join(w)
        near = min(toxicity.edit_distance(s, x) for x in words) <= 1
        assert (lex.fuzzy(s) is not None) == near
        assert lex.weight(s) == (1.0 if s in words else toxicity.FUZZY if near else 0.0)
    assert lex.weight("loweischaft") == 1.0 and lex.weight("lowe") == 0.0


def test_quotation_weighs_less():
    lex = toxicity.Lexicon({"moron": 1.0}, {})
    bare, quoted, told = (toxicity.features(t, lex)[1] for t in ("you are a moron today", "you are a “moron” today", "she said he is a moron today"))
    assert bare > quoted and bare > told
    assert toxicity.features("you m0ron and morron", lex)[1] > 0
    weight = lambda t: toxicity.features(t, lex)[1]
    for plain in ('"hi". And you moron. Then "bye".', "it’s a moron, isn’t it’s", "“never closed, moron", '"a\nmoron"', "moron “x”", "”moron“"):
        assert weight(plain) == bare, plain
    for inside in ('he: "you moron!"', "„du moron“", "«un moron»", "»ein moron«", "‘what a moron, isn’t it’", "“he said «a moron» there”", '"a" b "moron"'):
        assert weight(inside) == quoted, inside
    assert toxicity.features(None, lex) == toxicity.features("", lex) == toxicity.features("fine words", lex)


@has_data
def test_toxicity_is_learnt(spark):
    lab = dict(duckdb.sql("select doc_id, toxic from '/root/testdata/sf0.01/labels.parquet'").fetchall())
    got = toxicity.op4_toxicity(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in lab]
    assert sum(r.predicted == lab[r.doc_id] for r in held) / len(held) > 0.95
    toxic = [r for r in held if lab[r.doc_id]]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.9  # recall
    found = [r for r in held if r.predicted]
    assert sum(lab[r.doc_id] for r in found) / len(found) > 0.9  # precision
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (1, "x")], DOCS).withColumn("score", F.lit("clash"))
    assert toxicity.score(docs.limit(0), toxicity.Model(toxicity.Lexicon({}, {}), None)).count() == 0
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.score(docs, model).collect()] == [0.0] * 4
    assert toxicity.accepted(docs, model).count() == 4


# 5


@has_data
def test_secrets_base_rules(spark):
    rng = random.Random(5)
    bits = ["token=", "Password : \"", "api_key", "apikey='", "AKIA", "secret=secret=", "a1b2c3d4" * 4, "ABCDEF123456", "f" * 31, " ", "\n", "ſecret=abcdefghij", "é", "=", ":", "zzzzzzzz.", "passwd:short", "0" * 33]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for i in range(400)] + [(1000, None), (1001, ""), (None, "token=abcdefgh"), *((2000 + i, t) for i, t in docs_of())]
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, DOCS)).collect()}
    for i, t in rows:
        assert got[i].base == secrets.reference_spans(t)
        assert set(filter(None, got[i].base.split(","))) <= set(got[i].spans.split(","))


def test_secrets_models_and_redaction(spark):
    r = secrets.Ratio(*secrets.labelled_samples())
    assert r.held_out_errors <= 0.01 * r.held_out_rows
    key = "Zx81kQpW7vRt20LmNb45sYcE9d"
    rows = [(1, f"here {key} there", 99), (2, "get_user_account_name_list_2 stays", 7), (3, 'token = "abcdefgh1234" x', 5), (4, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    assert [x.n_markov for x in secrets.scan(docs).orderBy("doc_id").collect()] == [1, 0, 0, 0]
    got = [tuple(x) for x in secrets.redact(docs).orderBy("doc_id").collect()]
    assert got == [(1, "here [SECRET] there", 19), rows[1], (3, '[SECRET]" x', 11), rows[3]]


def test_secrets_found_and_identifiers_left():
    """Precision and recall of the method's own spans on planted strings that no base rule takes."""
    rng = random.Random(11)
    r = secrets.Ratio(*secrets.labelled_samples())
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    keys = ["".join(rng.choices(letters + "0123456789", k=rng.randint(20, 40))) for _ in range(500)]
    keys += ["".join(rng.choices(letters, k=24)) for _ in range(100)]
    names = ["_".join(rng.choices(secrets.WORDS, k=5)) for _ in range(300)] + ["src/" + "/".join(rng.choices(secrets.WORDS, k=4)) + ".py" for _ in range(200)]
    names += [f"{p}{str(__import__('uuid').UUID(int=rng.getrandbits(128)))}" for p in ("", "request-", "user_id=") for _ in range(50)]
    names += ["Donaudampfschifffahrtsgesellschaft", "Bundesausbildungsförderungsgesetz", "anticonstitutionnellement", "electroencefalografista", "2024-01-01-2024-12-31-final", "0123456789" * 3]
    spans = lambda t: secrets.markov_spans(t, r, secrets.base_spans(t))
    caught = sum(spans(f"x {k} y") == [(2, 3, 2 + len(k))] for k in keys)
    wrong = sum(bool(spans(f"x {n} y")) for n in names)
    assert caught >= 0.97 * len(keys) and wrong <= 0.02 * len(names)
    long = "/".join(rng.choices(secrets.WORDS, k=12))
    assert [long_key in f"{long}/{keys[0]}/{long}"[a:b] for a, _, b in spans(f"{long}/{keys[0]}/{long}") for long_key in (keys[0],)] == [True]
    text = "token=abcdefgh AKIA" + "ABCDEFGH12345678" + "/" + keys[1]
    assert [(k, text[a:b]) for a, k, b in spans(text)][-1][1].endswith(keys[1])


def test_secrets_query(spark, tmp_path):
    rows = [(1, 'token = "abcdefgh1234" x'), (2, None), (3, ""), (None, "AKIA" + "B" * 12), (4, "f" * 40)]
    spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit("clash")).withColumn("base", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in secrets.op5_secrets(spark, str(tmp_path)).collect()}
    assert set(next(iter(got.values())).asDict()) == {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"}
    for i, t in rows:
        kinds = [x.split(":")[0] for x in secrets.reference_spans(t).split(",")]
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(kinds.count(k) for k in secrets.KINDS[:3])
        assert got[i].base_sha256 == hashlib.sha256(secrets.reference_spans(t).encode()).hexdigest()
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert secrets.op5_secrets(spark, f"{tmp_path}/none").count() == 0


# 6


@pytest.mark.parametrize(("window", "seed"), [(7, 2), (10, 5), (50, 6), (6, 5), (50, 25)])
def test_substring_dedup_is_brute_force(spark, window, seed):
    rng = random.Random(3)
    base = [" ".join(rng.choice("ab cd e f".split()) for _ in range(60)) for _ in range(5)]
    rows = [(i, None if i % 9 == 0 else " ".join(rng.choice([*base, "x y z", "q" * 3]) for _ in range(rng.randint(0, 4)))) for i in range(60)]
    got = substring_dedup.deduplicate(spark.createDataFrame(rows, DOCS).withColumn("h", F.lit(1)), window, seed).collect()
    want = substring_dedup.brute_force(rows, window)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    assert sum(n for _, n, _ in want.values()) > 0


def test_substring_dedup_cases(spark):
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(None, t), (1, t), (1, t), (1, "other words"), (2, t), (2, None)]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring_dedup.deduplicate(spark.createDataFrame(rows, DOCS)).collect())
    assert got == sorted([("None", 60, 0), ("1", 60, 0), ("1", 60, 0), ("1", 2, 0), ("2", 60, 60), ("2", 0, 0)])
    assert substring_dedup.deduplicate(spark.createDataFrame([], DOCS)).count() == 0


# 7


@has_data
@pytest.mark.parametrize(("block", "lane"), [(4 << 20, 512), (20_000, 3)])
def test_lm_is_brute_force(spark, monkeypatch, block, lane):
    monkeypatch.setattr(lm_scoring, "LANE", lane)
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", block)
    docs = docs_of()
    rows = [*docs, (5000, None), (5001, ""), (5002, "zzz zzz qqq"), (5003, docs[3][1]), (5004, docs[3][1]), (5005, docs[9][1].upper())]
    df = spark.createDataFrame(rows, DOCS).withColumn("block", F.lit("clash"))
    got = lm_scoring.score(df, crc_mod5() != 1).collect()
    want, shares = lm_scoring.brute_force(rows)
    assert len(got) == len(rows)
    assert list(got[0].shares) == pytest.approx(shares)
    for r in got:
        n, known, base, total = want[r.doc_id]
        assert (r.n_tokens, r.n_known) == (n, known)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(total, rel=1e-9)


def test_lm_cases(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None), (3, "c")], DOCS)
    assert lm_scoring.score(df.limit(0), crc_mod5() != 1).count() == 0
    untaught = lm_scoring.score(df, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == r.base_score for r in untaught)
    twice = lm_scoring.score(spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], DOCS), F.col("doc_id") == 1).collect()
    assert len({r.score for r in twice}) == 1 and twice[0].train_tokens == 6


def test_lm_states_hand_down_at_most_one():
    """All words after a state have a probability of one at most in sum, whatever b is, and the failure arc is used."""
    data = "a b c a b d a b c b c c".encode()
    x = lm_scoring.Tokens(np.array([len(data)]), data, 64)
    totals = tuple(np.bincount(at[at >= 0], minlength=len(k)) for k, at in zip(x.keys, (x.word, x.pair, x.triple), strict=True))
    a = lm_scoring.Automaton(x, totals, len(x.word), len(x.keys[0]))
    out = np.zeros(len(a.left))
    np.add.at(out, a.from2, 10 ** a.weight2)
    np.add.at(out, a.from3, 10 ** a.weight3)
    ended = a.words + x.word[x.end][0]
    used = [s for s in (*a.from2, *a.from3) if s != ended]
    assert np.allclose(out[used], 1.0)  # before 1 - b; the failure arc has b
    assert (10**a.root_weight).sum() + 0.5 / a.denominator == pytest.approx(1.0)
    assert all(a.fail[s] in range(a.words, a.pairs) for s in range(a.pairs, len(a.left))) and not a.fail[: a.pairs].any()


@has_data
def test_lm_base_is_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    import zlib

    con.create_function("crc", lambda s: zlib.crc32(s.encode()), ["VARCHAR"], "UBIGINT")
    want = con.sql(lm_scoring.OP7_BASE_SQL.format(held_out="crc(doc_id::varchar) % 5 = 1"))
    got = {r.doc_id: r for r in lm_scoring.op7_lm_scoring(spark, DATA).collect()}
    for w in want.fetchall():
        x = dict(zip(want.columns, w, strict=True))
        r = got.pop(x["doc_id"])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"])
        assert r.base_score == pytest.approx(x["base_score"], rel=1e-9)
    assert not got


@has_data
def test_lm_beats_its_base_on_held_out_texts(spark):
    held = [r for r in lm_scoring.op7_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


# 8


@pytest.mark.parametrize(("k", "num", "block"), [(3, 90, 256), (5, 80, 4), (2, 60, 4)])
def test_ngram_join_is_brute_force(spark, monkeypatch, k, num, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, DOCS).withColumn("id", F.lit(1)), k, num, 100).collect()}
    assert got == ngram_join.brute_force(rows, k, num, 100)


@pytest.mark.parametrize(("k", "num", "tile"), [(3, 90, 128), (2, 60, 2)])
def test_ngram_join_gives_all_links(spark, monkeypatch, k, num, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rows = near_copies()
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    linked = lambda x, y: bool(x) and bool(y) and 100 * len(x & y) >= num * len(x | y)
    want = {(i, j) for i in sets for j in sets if i != j and linked(sets[i], sets[j])}
    df = spark.createDataFrame(rows, DOCS)
    nodes, links = ngram_join.links_of(df.withColumnRenamed("doc_id", "id"), k, num, 100)
    held = {}
    for r in nodes.where("node is not null").collect():
        held.setdefault(r.node, []).append(r.id)
    got = [(i, j) for r in links.collect() for a, b in ((r.a, r.b), (r.b, r.a)) for i in held[a] for j in held[b]]
    assert sorted(got) == sorted((i, j) for i, j in want if sets[i] != sets[j])
    count = {r.doc_id: r.n_links for r in ngram_join.join(df, k, num, 100).collect()}
    assert count == {i: sum(x == i for x, _ in want) for i in sets}


def test_ngram_join_of_near_copies_that_are_not_linked(spark, monkeypatch):
    """One shard of many members, each a component of its own, and not all of them linked."""
    monkeypatch.setattr(ngram_join, "BLOCK", 32)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(70)]
    rows = []
    for i in range(240):
        w = list(base)
        for k in rng.sample(range(0, 70, 7), rng.choice([1, 2, 2, 3])):
            w[k] = f"x{rng.randrange(3)}"
        rows.append((i, " ".join(w)))
    want = ngram_join.brute_force(rows, 3, 90, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(spark.createDataFrame(rows, DOCS), 3, 90, 100).collect()}
    assert got == want
    assert 1 < len({c for _, c in want.values()})


def test_ngram_join_hands_on_few_shards_of_near_sets(spark, monkeypatch):
    """Sets that share most members, and so most shards, without being linked: rows that are handed on don't grow with the
    square of their number. Among them are links of very unequal sizes, just at the limit, and some of equal sizes."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(1000)]
    rows = []
    for _ in range(40):
        w = list(base)
        for at in rng.sample(range(1000), 25):
            w[at] = f"x{rng.randrange(10**6)}"
        rows.append(w)
    rows += [rows[0][: 4 + round(0.8 * 996) + d] for d in (-1, 0, 1)] + [rows[1][200:] + ["y"], rows[2][:500] + ["z"] * 9 + rows[2][500:], rows[3][30:]]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    kept = {}
    store = ngram_join.stored

    def stored(df, name):
        kept[name] = store(df, name)
        return kept[name]

    # as in a large corpus, where n-grams of a few tens of sets are no commoner than others
    monkeypatch.setattr(ngram_join, "commonness", lambda *_: np.zeros(ngram_join.SLOTS, np.uint8))
    monkeypatch.setattr(ngram_join, "stored", stored)
    monkeypatch.setattr(ngram_join, "dropped", lambda *_: None)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(spark.createDataFrame(rows, DOCS), 5, 80, 100).collect()}
    assert got == ngram_join.brute_force(rows, 5, 80, 100)
    assert len({c for _, c in got.values()}) < len(rows)
    assert kept["promising"].count() < 10 * len(rows)


def test_ngram_join_cases(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "x y z"), (7, "X Y z"), (8, None)]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, DOCS), 3, 90, 100).collect())
    assert got == sorted([("None", 2, 1), ("1", 2, 1), ("1", 1, 1), ("7", 1, 1), ("8", 0, 8)])
    assert ngram_join.join(spark.createDataFrame([], DOCS), 3, 90, 100).count() == 0


def test_count_tree_finds_all_that_the_bound_admits():
    rng = np.random.default_rng(0)
    base = rng.poisson(1.0, (40, ngram_join.GROUPS))
    points = np.minimum(np.concatenate([np.maximum(0, base + rng.integers(-1, 2, base.shape) * (rng.random(base.shape) < 0.05)) for _ in range(8)]), 255).astype(np.uint8)
    points[3, 5] = 255
    sizes = points.sum(1).astype(np.int64)
    tree = ngram_join.CountTree(points, sizes, 90, 100)
    for i in range(0, len(points), 7):
        want = np.flatnonzero(ngram_join.bound_ok(points, points[i], sizes, np.full(len(points), sizes[i]), 90, 100))
        assert sorted(tree.near(points[i], int(sizes[i])).tolist()) == want.tolist()


def test_fine_counts_never_refuse_a_link():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 3000))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: int(n * rng.uniform(0.5, 1))], rng.integers(0, 2**63, int(n * rng.uniform(0, 0.4))).astype(np.uint64)])
        lap = len(np.intersect1d(a, b))
        linked = 100 * lap >= 80 * (len(a) + len(b) - lap)
        assert not linked or ngram_join.fine_ok(ngram_join.counts(a), ngram_join.counts(b), len(a), len(b), 80, 100)


# 9


@pytest.mark.parametrize("fan", [64, 4])
def test_ann_recall_and_exact_scores(spark, monkeypatch, fan):
    monkeypatch.setattr(ann, "FAN", fan)  # 8 partitions: one level, or two
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 16)) * 2
    x = (centres[rng.integers(0, 40, 6000)] + rng.standard_normal((6000, 16))).astype(np.float32)
    x[::3] = x[0]  # one vector that a third has
    ids = np.arange(len(x))
    got = {}
    for r in ann.search(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = ann.brute_force(ids, x.astype(np.float64), ids[ids % 100 == 0])
    assert set(got) == set(want)
    hits = [len({v for _, v, _ in got[q]} & {v for v, _ in w}) / len(w) for q, w in want.items()]
    assert np.mean(hits) >= 0.9
    d = x.astype(np.float64)
    assert all(s == pytest.approx(float((d[q] * d[v]).sum()), rel=1e-12) for q, l_ in got.items() for _, v, s in l_)
    assert all(sorted(r for r, _, _ in l_) == list(range(1, 21)) for l_ in got.values())
    for rows_ in got.values():
        by_rank = [(-s, v) for _, v, s in sorted(rows_)]
        assert by_rank == sorted(by_rank)


def test_ann_probes_few_partitions_of_clusters():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((64, 24)) * 4
    x = centres[rng.integers(0, 64, 4000)] + rng.standard_normal((4000, 24))
    for rows, first in ((1 << 18, 64), (400, 2), (255, 1)):
        index = ann.Partitions(ann.Level(np.delete(x, np.arange(0, 4000, 5), axis=0), ann.partitions_for(rows)))
        index.settle(x, np.arange(0, 4000, 5), 20, ann.RECALL)
        assert index.top.parts == first and index.probes <= max(1, index.top.parts // 2 + 1)
    assert [ann.partitions_for(n) for n in (0, 255, 256, 500, 2000, 51_000, 10**7, 10**12)] == [1, 1, 2, 2, 4, 32, 512, 4096]


def test_ann_cases(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 6)] + [(20, [1.0, 1.0]), (40, None), (60, [0.0, 0.0]), (80, [1.0, None]), (100, [float("nan")] * 2), (120, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (5, [5.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in ann.search(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(20, r, v, v + 1.0) for r, v in enumerate((5, 4, 3, 2, 1), 1)]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


def test_balanced_cut():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8))
    label = ann.balanced_cut(ann.knn_graph(x, 5), 8)
    sizes = np.bincount(label, minlength=8)
    assert sizes.max() - sizes.min() <= 3


# 10


def test_url_filters(spark):
    pages = [
        (1, "http://a.example.com/en/7x", '<link rel="canonical" href="http://z.q/1">'),
        (2, "http://z.q/1#f", "x"),
        (3, "http://w.q/2", '<meta http-equiv="refresh" content="0; url=http://x.net/de/1">'),
        (4, "http://x.net/de/1", None),
        (5, None, None),
        (6, "foo", ""),
        (7, "HTTP://K.com/en/8?x", "<LINK href=http://z.q/1 rel=canonical>"),
        (8, "http://y.q/b", '<link rel="canonical" href="/2">'),
        (9, "http://y.q/2", None),
        (9, "http://y.q/2", None),
        (10, "https://com/en/\nx://y", None),
        (11, "http://xcom/en/1", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("node", F.lit(1))
    logs = spark.createDataFrame([("http://y.q/2", "http://w.q/2"), (None, "http://u/1")], "from_url string, to_url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(df, redirects=logs).collect()}
    assert got == {
        1: ("a.example.com", "/en/7x", "example.com/en/7", "allow"),
        2: ("z.q", "/1", None, "allow"),
        3: ("w.q", "/2", None, "block"),
        4: ("x.net", "/de/1", "net/de/", "block"),
        5: ("", "", None, "allow"),
        6: ("", "", None, "allow"),
        7: ("k.com", "/en/8", "com/en/", "block"),
        8: ("y.q", "/b", None, "block"),
        9: ("y.q", "/2", None, "block"),
        10: ("com", "/en/\nx://y", "com/en/", "block"),
        11: ("xcom", "/en/1", None, "allow"),
    }
    assert url_filters.judge(df).count() == len(pages)
    assert url_filters.judge(df.limit(0)).count() == 0
    plan = url_filters.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_links_are_resolved(spark):
    canonical = lambda *to: "".join(f'<link rel="alternate canonical" href="{t}">' for t in to)
    pages = [
        (1, "http://y.q/a/b.html?x#f", canonical("c.html", "../d", "./e/./f/..", "?q=1", "//z.q/g/../h", "http://U.q", "/i/", "#top", "mailto:a@b", "j?u=http://k.q&amp;v=1")),
        (2, "https://y.q", "<base href='/base/x'>" + "<link href=' k.html ' rel='canonical'><meta content='3;URL=../l' http-equiv=refresh>"),
        (3, "no url", canonical("http://m.q/")),
    ]
    got = [tuple(r) for r in url_filters.page_links(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()]
    one, two = "//y.q/a/b.html?x", "//y.q/"
    assert sorted(got) == sorted(
        [(one, t) for t in ("//y.q/a/c.html", "//y.q/d", "//y.q/a/e/", "//y.q/a/b.html?q=1", "//z.q/h", "//u.q/", "//y.q/i/", one, "//y.q/a/j?u=http://k.q&v=1")]
        + [(two, "//y.q/base/k.html"), (two, "//y.q/l")])
    blocked = [(1, "http://w.q/a/b.html", canonical("../c.html")), (2, "http://w.q/c.html", canonical("http://x.net/de/")), (3, "http://w.q/a/c.html", None)]
    got = {r.page_id: r.verdict for r in url_filters.judge(spark.createDataFrame(blocked, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}
