"""Operators on hand-made data: expected results, edge cases and properties."""

import random

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from millrace.functions import arrow, python, saturating_int, saturating_unsigned
from millrace.operators.aggregators import COUNT, MAX, Arrow, General
from millrace.operators.dataset import Dataset, read_partitions_from
from millrace.operators.partitioners import ById, Hash, Range

ANIMALS = [[("cougar", 1), ("bear", 2), ("squirrel", 1), ("turtle", 8), ("snake", 2)], [("cougar", 1), ("bear", 5), ("squirrel", 2), ("turtle", 5), ("snake", 0)]]


@pytest.fixture
def make(spark):
    return lambda data, schema: Dataset.new_from_list(spark, data, schema)


def rows(d):
    return [tuple(r) if len(r) > 1 else r[0] for r in d.collect()]


def parts(d):
    out = {}
    for r in d.df.select("*", F.spark_partition_id().alias("__pid")).collect():
        out.setdefault(r["__pid"], []).append(tuple(r)[:-1] if len(r) > 2 else r[0])
    return out


def test_list_keeps_partitions_and_order(make):
    d = make([[3, 1], [], [2]], "x int")
    assert d.df.rdd.getNumPartitions() == 3
    assert parts(d) == {0: [3, 1], 2: [2]}
    assert rows(d) == [3, 1, 2]


def test_empty_list(make):
    assert rows(make([], "x int")) == []
    assert rows(make([[]], "x int").sort(partitions=3)) == []


def test_map_in_three_tiers(make):
    d = make([[1, 2], [3]], "x int")
    assert rows(d.map(lambda x: {"y": x * 2})) == [2, 4, 6]
    double = arrow(lambda b: pa.record_batch([pa.compute.multiply(b.column(0), pa.scalar(2, pa.int32()))], ["y"]), "y int")
    import pyarrow.compute  # noqa: F401

    assert rows(d.map(double)) == [2, 4, 6]
    assert rows(d.map(python(lambda r: r["x"] * 2, "y int"))) == [2, 4, 6]
    assert rows(d.map_with_state(10, lambda s, x: {"y": x + s})) == [11, 12, 13]
    assert rows(d.map_with_state(10, python(lambda s, r: r["x"] + s, "y int"))) == [11, 12, 13]


def test_flat_map(make):
    d = make([[[1, 2, 3], [1, 2]]], "xs array<bigint>")
    assert rows(d.flat_map(lambda xs: xs)) == [1, 2, 3, 1, 2]
    assert rows(make([[[], None, [7]]], "xs array<bigint>").flat_map(lambda xs: xs)) == [7]
    assert rows(d.flat_map(python(lambda r: [x for x in r["xs"] if x > 1], "x bigint"))) == [2, 3, 2]
    assert rows(d.flat_map_with_state(5, lambda s, xs: F.transform(xs, lambda x: x * s))) == [5, 10, 15, 5, 10]


def test_repeat_chain_sums_to_zero_in_each_partition(make):
    d = make([[3, 5, 7], [3, 5, 11], [3, 7, 11], [5, 7, 11]], "n bigint").flat_map(lambda n: F.array_repeat(n, n.cast("int")), "x")
    d = d.map(lambda x: {"x": x * 0}).map(lambda x: {"x": x * 4}).map(lambda x: {"x": x * 5})

    def sums(batches, pid):
        yield pa.record_batch([pa.array([sum(sum(b.column(0).to_pylist()) for b in batches)], pa.int64())], ["s"])

    assert rows(d.map_partitions(sums, "s bigint")) == [0, 0, 0, 0]


def test_filter_takes_null_as_false(make):
    assert rows(make([[1, None, 3]], "x int").filter(lambda x: x > 1)) == [3]
    assert rows(make([[1, 2, 3]], "x int").filter_with_state(2, lambda s, x: x >= s)) == [2, 3]


def test_map_partitions_sees_empty_partitions_and_ids(make):
    def sizes(state, batches, pid):
        yield pa.record_batch([pa.array([pid + state], pa.int32()), pa.array([sum(b.num_rows for b in batches)], pa.int64())], ["p", "n"])

    d = make([[1, 2], [], [3]], "x int").map_partitions_with_state(100, sizes, "p int, n bigint")
    assert rows(d) == [(100, 2), (101, 0), (102, 1)]


def test_union_is_a_bag_and_adds_partitions(make):
    a = make([[1], [2]], "x int")
    u = a.union(a, make([[3]], "x int"))
    assert rows(u) == [1, 2, 1, 2, 3]
    assert u.df.rdd.getNumPartitions() == 5


def test_sum_by_key(make):
    d = make(ANIMALS, "key string, value int").sum_by_key("key", "value", Hash(3))
    assert dict(rows(d)) == {"cougar": 2, "bear": 7, "squirrel": 3, "turtle": 13, "snake": 2}
    assert dict(d.df.dtypes)["value"] == "int"
    assert d.df.rdd.getNumPartitions() == 3


def test_sum_overflow_is_an_error(make):
    with pytest.raises(Exception, match="OVERFLOW"):
        make([[("a", 2**31 - 1), ("a", 1)]], "k string, v int").sum_by_key("k", "v").collect()


def test_shuffle_aggregators(make):
    d = make(ANIMALS, "k string, v int")
    assert dict(rows(d.shuffle("k", "v", COUNT)))["bear"] == 2
    assert dict(rows(d.shuffle("k", "v", MAX)))["bear"] == 5
    product = General(F.lit(1), lambda a, v: a * (v + 1), lambda a, b: a * b, lambda a: a - 1)
    assert dict(rows(d.shuffle("k", "v", product))) == {"cougar": 3, "bear": 17, "squirrel": 5, "turtle": 53, "snake": 2}


def test_group_by_keeps_value_order(make):
    d = make([[("a", 3), ("b", 1)], [("a", 1), ("a", 2)]], "k string, v int").with_ordinal().group_by("k", "v", order="ordinal")
    assert dict(rows(d)) == {"a": [3, 1, 2], "b": [1]}


def test_cogroup_and_join(make):
    left, right = make([[(1, 4)], [(1, 2)]], "k int, v int"), make([[(1, "wow")], [(2, "bla")]], "k int, w string")
    g = {k: (a, b) for k, a, b in rows(left.with_ordinal().cogroup(right.with_ordinal(), "k", "v", "w", ("ordinal", "ordinal")))}
    assert g == {1: ([4, 2], ["wow"]), 2: ([], ["bla"])}
    assert sorted(rows(left.join(right, "k"))) == [(1, 2, "wow"), (1, 4, "wow")]
    flat = sorted((k, v, w) for k, (a, b) in g.items() for v in a for w in b)
    assert flat == sorted(rows(left.join(right, "k")))


def test_join_variants_and_null_keys(make):
    a, b = make([[(1, 4), (None, 5)]], "k int, v int"), make([[(None, 6), (2, 7)]], "k int, v int")
    assert rows(a.join(b, "k")) == []
    assert rows(a.join(b, "k", null_safe=True)) == [(None, 5, 6)]
    assert sorted(rows(a.join(b, "k", "full")), key=str) == sorted([(1, 4, None), (2, None, 7), (None, 5, None), (None, None, 6)], key=str)
    assert rows(a.join(b, "k", "left_semi", null_safe=True)) == [(None, 5)]
    assert sorted(rows(a.join(b, "k", "left_anti")), key=str) == [(1, 4), (None, 5)]
    assert rows(a.join(a, "k")) == [(1, 4, 4)]


def test_set_operations(make):
    a, b = make([[1, 1, 2]], "x int"), make([[2, 3]], "x int")
    assert sorted(rows(a.distinct())) == [1, 2]
    assert rows(a.intersect(b)) == [2]
    assert rows(a.subtract(b)) == [1]
    assert rows(a.top(2, F.desc("x"))) == [2, 1]
    assert rows(a.reduce(F.sum("x").alias("s"))) == [4]


def test_partition_by_places_each_row(make):
    rng = random.Random(1)
    data = [[rng.randrange(100) for _ in range(50)] for _ in range(3)]
    d = make(data, "x int").partition_by(ById(7, lambda x: x % 7), "x")
    got = parts(d)
    assert all(x % 7 == p for p, xs in got.items() for x in xs)
    assert sorted(x for xs in got.values() for x in xs) == sorted(sum(data, []))
    assert make(data, "x int").partition_by(Hash(5), "x").df.rdd.getNumPartitions() == 5


def test_partition_id_out_of_range_is_an_error(make):
    with pytest.raises(Exception, match="out of range"):
        make([[1, 9]], "x int").partition_by(ById(3, lambda x: x), "x").collect()
    with pytest.raises(ValueError):
        Hash(0)


def test_range_partitioner_is_upper_inclusive(make):
    d = make([[5, 10, 11, 20, 21, None]], "x int").partition_by(Range((10, 20, 20)), "x")
    got = parts(d)
    assert {p: sorted(xs, key=str) for p, xs in got.items()} == {0: sorted([5, 10, None], key=str), 1: [11, 20], 3: [21]}
    assert d.df.rdd.getNumPartitions() == 4


@pytest.mark.parametrize("values", [[], [4] * 30, list(range(100)), [1, 1, 2, 50, 50, 3]])
def test_sort_is_a_sorted_permutation_in_exact_partitions(make, values):
    rng = random.Random(2)
    rng.shuffle(values)
    d = make([values[::2], values[1::2]], "x int").sort("x", partitions=5)
    assert d.df.rdd.getNumPartitions() == (5 if values else 0)  # Spark plans a table known to be empty without tasks
    assert rows(d) == sorted(values)
    assert rows(make([values], "x int").sort("x")) == sorted(values)


def test_sample_takes_exactly_so_many_from_each_partition(make):
    data = [list(range(20)), [100], [], list(range(200, 205))]
    d = make(data, "x int")
    got = parts(d.sample(5, seed=3))
    assert {p: len(x) for p, x in got.items()} == {0: 5, 1: 1, 3: 5}
    assert all(set(x) <= set(data[p]) and len(set(x)) == len(x) for p, x in got.items())
    assert rows(d.sample(5, seed=3)) == rows(d.sample(5, seed=3))
    assert rows(d.sample(0)) == []


def test_sample_is_uniform(make):
    d = make([list(range(10))] * 300, "x int").sample(3, seed=11)
    counts = {r["x"]: r["n"] for r in d.df.groupBy("x").agg(F.count("*").alias("n")).collect()}
    assert all(55 <= counts[x] <= 130 for x in range(10))  # 90 expected


def test_save_and_read_back(make, spark, tmp_path):
    path = str(tmp_path / "out")
    make([["a", "b"], [], ["c"]], "x string").save(path)
    got = {r["id"]: bytes(r["content"]) for r in read_partitions_from(spark, path, 3).collect()}
    assert got == {0: b"a\nb\n", 1: b"", 2: b"c\n"}
    make([["z"]], "x string").save(path, lambda rs: repr([r["x"] for r in rs]).encode())
    assert {r["id"]: bytes(r["content"]) for r in read_partitions_from(spark, path, 2).collect()} == {0: b"['z']", 1: b""}
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_partitions_from(spark, path, 9).collect()
    assert read_partitions_from(spark, path, 0).collect() == []


def test_saturating_casts(make):
    d = make([[-2.5, 0.4, 7.9, float("nan"), 1e30, -1e30]], "x double")
    assert rows(d.map(lambda x: {"y": saturating_unsigned(x)})) == [0, 0, 7, 0, 2**63 - 1, 0]
    assert rows(d.map(lambda x: {"y": saturating_int(x)})) == [-2, 0, 7, 0, 2**31 - 1, -(2**31)]


@pytest.mark.parametrize("held", [1, 50, 100_000])
def test_arrow_aggregator_combines_in_tasks(spark, held):
    rows = [(i % 7 if i % 3 else 0, i) for i in range(2000)] + [(None, 5), (8, None)]
    d = Dataset(spark.createDataFrame(rows, "k int, v bigint").repartition(3))

    def summed(t):
        g = t.group_by("k").aggregate([("v", "sum")])
        return pa.table({"k": g.column("k"), "v": g.column("v_sum")})

    total = Arrow("bigint", summed, summed, held=held)
    got = {r.k: r.s for r in d.shuffle("k", "v", total, out="s").collect()}
    want = {}
    for k, v in rows:
        want[k] = None if v is None and k not in want else (want.get(k) or 0) + (v or 0)
    assert got == want
    doubled = Arrow("bigint", summed, summed, lambda t: t.set_column(1, "v", pa.compute.cast(t.column("v"), pa.float64())), "double")
    assert {r.k: r.v for r in d.shuffle("k", "v", doubled).collect()} == {k: None if v is None else float(v) for k, v in want.items()}
    assert d.filter(lambda k, v: k > 100).shuffle("k", "v", total).collect() == []


def test_predicates_in_three_tiers(spark):
    d = Dataset(spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string"))
    want = [(1, "a"), (3, "c")]
    for f in (lambda k, v: v.isNotNull(), arrow(lambda b: b.column("v").is_valid()), python(lambda r: r["v"])):
        assert sorted(tuple(r) for r in d.filter(f).collect()) == want
    assert [tuple(r) for r in d.filter_with_state(2, python(lambda s, r: r["k"] > s)).collect()] == [(3, "c")]


def test_sample_sizes(spark):
    d = Dataset(spark.range(0, 30_000, 1, 3).toDF("x"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        for n in (0, 1, 499, 501, 10_000, 20_000):
            got = [r.x for r in d.sample(n, seed=3).collect()]
            assert got == sorted(set(got)) and [sum(p * 10_000 <= x < (p + 1) * 10_000 for x in got) for p in range(3)] == [min(n, 10_000)] * 3
        assert d.sample(50, seed=1).collect() == d.sample(50, seed=1).collect() != d.sample(50, seed=2).collect()
        # every place has the same chance
        means = [sum(r.x for r in d.sample(100, seed=s).collect()) / 300 for s in range(20)]
        assert abs(sum(means) / 20 - 15_000) < 500
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("kind", ["int", "string"])
def test_sort_into_partitions(spark, monkeypatch, kind, descending):
    from millrace.operators import dataset

    monkeypatch.setattr(dataset, "SORT_SAMPLE_ALL", 200)
    rows = [(None if i % 50 == 0 else f"{i * 37 % 1000:04}", i) for i in range(1000)]
    df = spark.createDataFrame(rows, "s string, i int").select(F.col("s").cast(kind).alias("k"), "i")
    out = Dataset(df).sort("k", "i", partitions=5, descending=descending).df
    got = [tuple(r) for r in out.collect()]
    plain = lambda r: (r[0] is not None, r[0] if r[0] is not None else "", r[1])
    assert got == sorted(((r.k, r.i) for r in df.collect()), key=plain, reverse=descending)
    sizes = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) == 5 and max(r["count"] for r in sizes) < 400
    assert Dataset(df.limit(0)).sort("k", partitions=3, descending=descending).collect() == []


def test_range_buckets_are_found_in_runs(spark):
    dividers = tuple(sorted({(i * i) % 1009 for i in range(300)}))
    keys = [-1, 0, 1, 500, 1008, 2000, *dividers[::17]]
    got = spark.createDataFrame([(k,) for k in keys], "k int").select("k", Range(dividers).bucket(F.col("k")).alias("b")).collect()
    assert {r.k: r.b for r in got} == {k: sum(d < k for d in dividers) for k in keys}
