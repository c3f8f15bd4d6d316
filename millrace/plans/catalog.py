"""Named queries over the test tables and, for each, the SQL that a second engine checks it with."""

from __future__ import annotations

import json
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrow, lines_of, python, saturating_unsigned, words_on
from ..operators.aggregators import COUNT, MAX, MEAN, MIN, Arrow, Declarative, General
from ..operators.dataset import Dataset, read_partitions_from
from ..operators.partitioners import ById, Hash, Range


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> Dataset:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return Dataset(df.select(*columns) if columns else df)


def nation_order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders", "o_custkey", "o_totalprice").map(lambda k, v: {"key": k, "total": v})
    # totals by customer before the join with nations: the join then has a row a customer
    totals = orders.sum_by_key("key", "total")
    customers = load(spark, sf_dir, "customer", "c_custkey", "c_nationkey").map(lambda k, n: {"key": k, "nation": n})
    by_nation = totals.join(customers, "key").map(lambda k, t, n: {"key": n, "total": t}).sum_by_key("key", "total")
    nations = load(spark, sf_dir, "nation", "n_nationkey", "n_name").map(lambda k, n: {"key": k, "n_name": n})
    return by_nation.join(nations, "key").map(lambda k, t, n: {"n_name": n, "total": F.round(t, 2)}).sort("n_name").df


def new_from_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = [[("cougar", 2), ("bear", 7)], [], [("squirrel", 3)]]
    return Dataset.new_from_list(spark, data, "key string, value int").map(lambda k, v: [F.spark_partition_id().alias("p"), k, v]).df


def map_triple_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity").map(lambda k, q: {"l_orderkey": k, "q3": q * 3}).df


def map_with_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = {"factor": 4, "plus": 5}
    return load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").map_with_state(state, lambda s, k, n: {"l_orderkey": k, "x": n * s["factor"] + s["plus"]}).df


def filter_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").filter(lambda o, n, q: q > 45).map(lambda o, n, q: [o, n]).df


def filter_with_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").filter_with_state({"F", "P"}, lambda s, k, x: x.isin(sorted(s))).map(lambda k, x: [k]).df


def flat_map_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber")
    return d.flat_map(lambda k, n: F.array_repeat(F.struct(k, n.alias("x")), n)).df


def flat_map_with_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation", "n_nationkey").flat_map_with_state(3, lambda times, k: F.transform(F.sequence(F.lit(0), F.lit(times - 1)), lambda i: k * 10 + i), "x").df


def _sums(batches, pid: int):
    total, n = 0.0, 0
    for b in batches:
        total += pa.compute.sum(b.column("l_quantity")).as_py() or 0.0
        n += b.num_rows
    yield pa.record_batch([pa.array([pid], pa.int32()), pa.array([total], pa.float64()), pa.array([n], pa.int64())], ["p", "s", "n"])


def map_partitions_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity").partition_by(ById(8, lambda k: k % 8), "l_orderkey")
    return d.map_partitions(_sums, "p int, s double, n bigint").df


def _count(limit: int, batches, pid: int):
    n = sum(pa.compute.sum(pa.compute.greater(b.column("o_totalprice"), limit)).as_py() or 0 for b in batches)
    yield pa.record_batch([pa.array([pid], pa.int32()), pa.array([n], pa.int64())], ["p", "n"])


def map_partitions_with_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").partition_by(ById(5, lambda k: k % 5), "o_orderkey")
    return d.map_partitions_with_state(100_000, _count, "p int, n bigint").df


def union_nationkeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer", "c_nationkey").map(lambda k: {"k": k})
    s = load(spark, sf_dir, "supplier", "s_nationkey").map(lambda k: {"k": k})
    return c.union(s, s).df


def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = load(spark, sf_dir, "documents", "text").flat_map(lines_of, "l").flat_map(words_on, "w")
    return words.map(lambda w: {"w": w, "c": F.lit(1).cast("bigint")}).sum_by_key("w", "c").df


def sum_by_key_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events", "event_type").map(lambda t: {"event_type": t, "c": F.lit(1).cast("bigint")}).sum_by_key("event_type", "c").df


def sum_by_key_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem", "l_returnflag", "l_quantity").sum_by_key("l_returnflag", "l_quantity", Hash(3), "s").df


def shuffle_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = Declarative(lambda v: F.sum(v) / F.count(v))
    return load(spark, sf_dir, "lineitem", "l_suppkey", "l_quantity").shuffle("l_suppkey", "l_quantity", mean, out="m").df


def shuffle_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of prices by customer as a user-defined combiner."""
    none = F.lit(None).cast("struct<low:double,high:double>")
    merge = lambda a, low, high: F.when(a.isNull(), F.struct(low.alias("low"), high.alias("high"))).otherwise(F.struct(F.least(a["low"], low).alias("low"), F.greatest(a["high"], high).alias("high")))
    spread = General(none, lambda a, v: merge(a, v, v), lambda a, b: F.when(b.isNull(), a).otherwise(merge(a, b["low"], b["high"])), lambda a: a["high"] - a["low"])
    return load(spark, sf_dir, "orders", "o_custkey", "o_totalprice").shuffle("o_custkey", "o_totalprice", spread, out="spread").df


def group_by_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders", "o_custkey", "o_orderkey").map(lambda k, v: [k, v, v.alias("o")]).group_by("o_custkey", "o_orderkey", order="o", out="os").df


def join_cust_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer", "c_custkey", "c_name")
    o = load(spark, sf_dir, "orders", "o_custkey", "o_orderkey").map(lambda k, v: {"c_custkey": k, "o_orderkey": v})
    return c.join(o, "c_custkey").df


def _sides(spark: SparkSession, sf_dir: str) -> tuple[Dataset, Dataset]:
    """Two whole tables whose keys meet in part: every order's customer counts twice, so odd customers have no order, and
    orders of the upper half have no customer."""
    c = load(spark, sf_dir, "customer", "c_custkey", "c_name").map(lambda k, n: {"k": k, "l": n})
    o = load(spark, sf_dir, "orders", "o_custkey", "o_orderkey").map(lambda k, v: {"k": k * 2, "r": v})
    return c, o


def cogroup_cust_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _sides(spark, sf_dir)
    g = c.map(lambda k, v: [k, v, v.alias("o")]).cogroup(o.map(lambda k, v: [k, v, v.alias("o")]), "k", "l", "r", ("o", "o"))
    return g.df


def left_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _sides(spark, sf_dir)
    return c.join(o, "k", "left").df


def full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _sides(spark, sf_dir)
    return c.join(o, "k", "full").df


def semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _sides(spark, sf_dir)
    return c.join(o, "k", "left_semi").df


def anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _sides(spark, sf_dir)
    return c.join(o, "k", "left_anti").df


def right_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _sides(spark, sf_dir)
    return c.join(o, "k", "right").df


def min_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders", "o_custkey", "o_totalprice").shuffle("o_custkey", "o_totalprice", MIN, out="low").df


def max_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders", "o_custkey", "o_totalprice").shuffle("o_custkey", "o_totalprice", MAX, out="high").df


def mean_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem", "l_suppkey", "l_linenumber").shuffle("l_suppkey", "l_linenumber", MEAN, out="m").df


def group_by_unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists in no order that is kept; sorted afterwards, to compare them."""
    g = load(spark, sf_dir, "customer", "c_nationkey", "c_custkey").group_by("c_nationkey", "c_custkey", out="ks")
    return g.map(lambda k, ks: {"c_nationkey": k, "ks": F.sort_array(ks)}).df


def _tripled(b: pa.RecordBatch) -> pa.RecordBatch:
    return pa.record_batch([b.column(0), pa.compute.multiply(b.column(1), 3.0)], ["l_orderkey", "q3"])


def map_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity").map(arrow(_tripled, "l_orderkey bigint, q3 double")).df


def map_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer", "c_custkey", "c_name").map(python(lambda r: {"k": r["c_custkey"] * 2, "n": len(r["c_name"])}, "k bigint, n int")).df


def flat_map_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation", "n_nationkey", "n_name").flat_map(python(lambda r: [(r["n_nationkey"], c) for c in sorted(set(r["n_name"]))], "k int, c string")).df


def filter_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").filter(arrow(lambda b: pa.compute.greater(b.column("o_totalprice"), 200_000.0))).df


def filter_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").filter_with_state("BUILDING", python(lambda s, r: r["c_mktsegment"] == s)).df


def _low_high(t: pa.Table) -> pa.Table:
    g = t.group_by("o_custkey").aggregate([("o_totalprice", "min"), ("o_totalprice", "max")])
    pair = pa.StructArray.from_arrays([g.column(c).combine_chunks() for c in ("o_totalprice_min", "o_totalprice_max")], ["low", "high"])
    return pa.table({"o_custkey": g.column("o_custkey"), "o_totalprice": pair})


def _low_high_merged(t: pa.Table) -> pa.Table:
    x = t.column("o_totalprice").combine_chunks()
    g = pa.table({"o_custkey": t.column("o_custkey"), "low": x.field("low"), "high": x.field("high")}).group_by("o_custkey").aggregate([("low", "min"), ("high", "max")])
    pair = pa.StructArray.from_arrays([g.column(c).combine_chunks() for c in ("low_min", "high_max")], ["low", "high"])
    return pa.table({"o_custkey": g.column("o_custkey"), "o_totalprice": pair})


def _spread(t: pa.Table) -> pa.Table:
    x = t.column("o_totalprice").combine_chunks()
    return pa.table({"o_custkey": t.column("o_custkey"), "o_totalprice": pa.compute.subtract(x.field("high"), x.field("low"))})


def shuffle_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of prices by customer, combined in tasks before one exchange."""
    spread = Arrow("struct<low:double,high:double>", _low_high, _low_high_merged, _spread, "double")
    return load(spark, sf_dir, "orders", "o_custkey", "o_totalprice").shuffle("o_custkey", "o_totalprice", spread, out="spread").df


def sort_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, which have no quantile summaries, in descending order over four partitions."""
    return _positions(load(spark, sf_dir, "customer", "c_name"), 4, True)


def collect_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """collect() on the driver, and a Dataset from what it gave."""
    rows = [tuple(r) for r in load(spark, sf_dir, "region", "r_regionkey", "r_name").collect()]
    return Dataset.new_from_list(spark, [rows], "r_regionkey int, r_name string").df


def distinct_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events", "event_type").distinct().df


def intersect_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _sides(spark, sf_dir)
    return Dataset(c.df.select("k")).intersect(Dataset(o.df.select("k"))).df


def subtract_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _sides(spark, sf_dir)
    return Dataset(c.df.select("k")).subtract(Dataset(o.df.select("k"))).df


def count_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events", "user_id", "event_id").shuffle("user_id", "event_id", COUNT, out="n").df


def global_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem", "l_quantity").reduce(F.count("*").alias("n"), F.sum("l_quantity").alias("s"), F.max("l_quantity").alias("m")).df


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").top(25, F.desc("o_totalprice"), "o_orderkey").df


def _positions(rows: Dataset, n: int, descending: bool) -> DataFrame:
    """Rows in total order over n partitions, with their position. Sizes of partitions are counts of buckets before the
    exchange, so the sort runs once and no task has all rows."""
    key = rows.df.columns[0]
    placed = rows.dividers(key, n)
    sizes = {r["p"]: r["count"] for r in rows.df.groupBy(placed.bucket(F.col(key)).alias("p")).count().collect()}  # n rows
    sizes = [sizes.get(n - 1 - p if descending else p, 0) for p in range(n)]
    starts = F.create_map(*(F.lit(x) for p in range(n) for x in (p, sum(sizes[:p]))))
    d = rows.sort(*rows.df.columns, partitions=placed, descending=descending).df
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return d.withColumn("p", F.spark_partition_id()).withColumn("i", place).withColumn("pos", (starts[F.col("p")] + F.col("i") + 1).cast("bigint")).drop("p", "i")


def sort_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total order over a fixed number of partitions."""
    return _positions(load(spark, sf_dir, "orders", "o_totalprice", "o_orderkey"), 8, False).select("o_orderkey", "pos")


def sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "orders", "o_custkey").partition_by(ById(4, lambda k: k % 4), "o_custkey").sample(10, seed=7)
    return d.map(lambda k: {"p": k % 4, "n": F.lit(1).cast("bigint")}).sum_by_key("p", "n").df


def partition_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "lineitem", "l_orderkey").partition_by(ById(8, lambda k: k % 8), "l_orderkey")
    return d.map(lambda k: {"p": F.spark_partition_id().cast("bigint"), "n": F.lit(1).cast("bigint")}).sum_by_key("p", "n").df


def partition_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "lineitem", "l_quantity").partition_by(Range((10.0, 20.0, 20.0, 40.0)), "l_quantity")
    return d.map(lambda q: {"p": F.spark_partition_id(), "n": F.lit(1).cast("bigint")}).sum_by_key("p", "n").df


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir; only where that is unset a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    return f"{root.removeprefix('file://').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _fields(d: Dataset, **kinds: str) -> Dataset:
    """Lines of numbered files with fields between commas as columns."""
    lines = d.map(lambda i, p, c: {"t": c.cast("string")}).flat_map(lines_of, "l").filter(lambda line: line != "")
    return lines.map(lambda line: {n: F.split_part(line, F.lit(","), F.lit(k)).cast(t) for k, (n, t) in enumerate(kinds.items(), 1)})


def save_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "nations")
    load(spark, sf_dir, "nation", "n_nationkey", "n_name").partition_by(ById(4, lambda k: k % 3), "n_nationkey").save(path)
    return _fields(read_partitions_from(spark, path, 4), n_nationkey="int", n_name="string").df


def _as_json(rows: list[dict]) -> bytes:
    return json.dumps(rows).encode()


def save_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A serialiser of one's own: each file is one JSON list."""
    path = _scratch(spark, "suppliers")
    load(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").partition_by(Hash(3), "s_suppkey").save(path, _as_json)
    read = read_partitions_from(spark, path, 3)
    return read.flat_map(lambda i, p, c: F.from_json(c.cast("string"), "array<struct<s_suppkey:bigint,s_nationkey:int>>")).df


def sort_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stress 5 over numbered files: integers from ten files, sorted into ten, read again with their file and line."""
    source, target = _scratch(spark, "integers"), _scratch(spark, "sorted")
    load(spark, sf_dir, "orders", "o_custkey").partition_by(ById(10, lambda k: k % 10), "o_custkey").save(source)
    _fields(read_partitions_from(spark, source, 10), n="int").sort("n", partitions=10).save(target)
    files = read_partitions_from(spark, target, 10).df.select("id", F.posexplode(F.filter(lines_of(F.col("content").cast("string")), lambda x: x != "")).alias("line", "n"))
    before = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = files.groupBy("id").agg(F.count("*").alias("size")).withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))  # ten rows
    return files.join(sizes, "id").select((F.col("start") + F.col("line") + 1).alias("pos"), F.col("n").cast("int").alias("n"))


def change_tracking_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stress 4 over numbered files: two snapshots of ten files each."""
    first, second = _scratch(spark, "january"), _scratch(spark, "february")
    people = load(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    people.partition_by(ById(10, lambda k: k % 10), "c_custkey").save(first)
    people.map(lambda k, s: {"c_custkey": k, "city": F.when(k % 3 == 0, "MOVED").otherwise(s)}).partition_by(ById(10, lambda k: k % 10), "c_custkey").save(second)
    a = _fields(read_partitions_from(spark, first, 10), id="bigint", a="string")
    b = _fields(read_partitions_from(spark, second, 10), id="bigint", b="string")
    return a.join(b, "id").flat_map(lambda i, x, y: F.transform(F.when(x != y, F.array(x, y)).otherwise(F.array(x)), lambda c: F.struct(i.alias("id"), c.alias("city")))).df


def repeat_and_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stress 1: repeat each row, then a chain of maps, then sums."""
    d = load(spark, sf_dir, "lineitem", "l_linenumber", "l_returnflag").flat_map(lambda n, f: F.array_repeat(F.struct(f.alias("f"), n.cast("bigint").alias("x")), n * 4))
    return d.map(lambda f, x: {"f": f, "x": x * 3}).map(lambda f, x: {"f": f, "x": x * 4}).map(lambda f, x: {"f": f, "x": x * 5}).sum_by_key("f", "x").df


def many_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "events", "event_id").map(lambda i: {"event_id": i, "s": F.sin((i * 2).cast("double"))})
    return d.filter(lambda i, s: s < 0.5).map(lambda i, s: {"event_id": i, "k": saturating_unsigned(s * 1000)}).df


def many_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stress 2: ten rounds of map, filter, key and union. Each round reads what came before in both of its branches, so a
    plan has 2^n of them after n rounds; after five it is written and read again. Partitions don't multiply."""
    d = load(spark, sf_dir, "events", "event_id").map(lambda i: {"event_id": i, "x": (i % 1000).cast("bigint")})
    for r in range(10):
        a = d.filter(lambda i, x, r=r: (x + r) % 3 == 0).map(lambda i, x, r=r: {"event_id": i, "x": (x * 2 + r) % 1000})
        b = d.filter(lambda i, x, r=r: (x + r) % 3 != 0).map(lambda i, x, r=r: {"event_id": i, "x": (x + 1) % 1000})
        d = a.union(b)
        if r == 4:
            path = f"file://{_scratch(spark, 'rounds')}" if "://" not in (spark.conf.get("spark.checkpoint.dir", None) or "") else f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/rounds-{uuid.uuid4().hex}"
            d.df.coalesce(max(1, spark.sparkContext.defaultParallelism)).write.parquet(path)
            d = Dataset(spark.read.schema(d.df.schema).parquet(path))
    d = Dataset(d.df.coalesce(max(1, spark.sparkContext.defaultParallelism)))
    return d.map(lambda i, x: {"x": x, "n": F.lit(1).cast("bigint")}).sum_by_key("x", "n").df


def change_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stress 4: a row for each customer, and one more if the second snapshot differs."""
    a = load(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").map(lambda k, s: {"id": k, "a": s})
    b = load(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").map(lambda k, s: {"id": k, "b": F.when(k % 3 == 0, "MOVED").otherwise(s)})
    changed = a.join(b, "id").flat_map(lambda i, x, y: F.transform(F.when(x != y, F.array(x, y)).otherwise(F.array(x)), lambda c: F.struct(i.alias("id"), c.alias("city"))))
    return changed.df


QUERIES = {f.__name__: f for f in (
    nation_order_totals, new_from_list, map_triple_qty, map_with_state, filter_qty, filter_with_state, flat_map_repeat, flat_map_with_state,
    map_partitions_sum, map_partitions_with_state, union_nationkeys, word_count, sum_by_key_events, sum_by_key_qty, shuffle_mean, shuffle_general,
    group_by_orders, join_cust_orders, cogroup_cust_orders, left_outer, full_outer, semi, anti, distinct_types, intersect_keys, subtract_keys,
    count_by_key, right_outer, min_by_key, max_by_key, mean_by_key, group_by_unordered, map_arrow, map_python, flat_map_python,
    filter_arrow, filter_python, shuffle_arrow, sort_descending, collect_rows, save_custom, sort_files, change_tracking_files, global_reduce, top_orders, sort_price, sample_size, partition_by_id, partition_by_range, save_roundtrip,
    repeat_and_sum, many_step, many_rounds, change_tracking)}

_SIDES = """with c as (select c_custkey as k, c_name as l from customer),
o as (select o_custkey * 2 as k, o_orderkey as r from orders) """

_ROUNDS = "select event_id, event_id % 1000 as x from events"
for _r in range(10):
    _ROUNDS = f"select event_id, case when (x + {_r}) % 3 = 0 then (x * 2 + {_r}) % 1000 else (x + 1) % 1000 end as x from ({_ROUNDS})"

ORACLE_SQL = {
    "nation_order_totals": "select n_name, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name",
    "new_from_list": "select * from (values (0, 'cougar', 2), (0, 'bear', 7), (2, 'squirrel', 3)) t(p, key, value)",
    "map_triple_qty": "select l_orderkey, l_quantity * 3 as q3 from lineitem",
    "map_with_state": "select l_orderkey, l_linenumber * 4 + 5 as x from lineitem",
    "filter_qty": "select l_orderkey, l_linenumber from lineitem where l_quantity > 45",
    "filter_with_state": "select o_orderkey from orders where o_orderstatus in ('F', 'P')",
    "flat_map_repeat": "select l_orderkey, unnest(list_resize([]::int[], l_linenumber::bigint, l_linenumber)) as x from lineitem",
    "flat_map_with_state": "select n_nationkey * 10 + i::int as x from nation, range(3) t(i)",
    "map_partitions_sum": "select (l_orderkey % 8)::int as p, sum(l_quantity) as s, count(*) as n from lineitem group by 1",
    "map_partitions_with_state": "select (o_orderkey % 5)::int as p, count(*) filter (o_totalprice > 100000) as n from orders group by 1",
    "union_nationkeys": "select c_nationkey as k from customer union all select s_nationkey from supplier union all select s_nationkey from supplier",
    "word_count": "select w, count(*) as c from (select unnest(string_split(l, ' ')) as w from (select unnest(string_split(text, chr(10))) as l from documents)) group by w",
    "sum_by_key_events": "select event_type, count(*) as c from events group by 1",
    "sum_by_key_qty": "select l_returnflag, sum(l_quantity) as s from lineitem group by 1",
    "shuffle_mean": "select l_suppkey, sum(l_quantity) / count(*) as m from lineitem group by 1",
    "shuffle_general": "select o_custkey, max(o_totalprice) - min(o_totalprice) as spread from orders group by 1",
    "group_by_orders": "select o_custkey, list_sort(list(o_orderkey)) as os from orders group by 1",
    "join_cust_orders": "select c_custkey, c_name, o_orderkey from customer join orders on c_custkey = o_custkey",
    "cogroup_cust_orders": _SIDES + """select coalesce(a.k, b.k) as k, coalesce(a.l, []) as l, coalesce(b.r, []) as r
      from (select k, list_sort(list(l)) as l from c group by 1) a full join (select k, list_sort(list(r)) as r from o group by 1) b on a.k = b.k""",
    "left_outer": _SIDES + "select c.k, l, r from c left join o on c.k = o.k",
    "full_outer": _SIDES + "select coalesce(c.k, o.k) as k, l, r from c full join o on c.k = o.k",
    "right_outer": _SIDES + "select o.k, l, r from c right join o on c.k = o.k",
    "min_by_key": "select o_custkey, min(o_totalprice) as low from orders group by 1",
    "max_by_key": "select o_custkey, max(o_totalprice) as high from orders group by 1",
    "mean_by_key": "select l_suppkey, avg(l_linenumber) as m from lineitem group by 1",
    "group_by_unordered": "select c_nationkey, list_sort(list(c_custkey)) as ks from customer group by 1",
    "map_arrow": "select l_orderkey, l_quantity * 3 as q3 from lineitem",
    "map_python": "select c_custkey * 2 as k, length(c_name)::int as n from customer",
    "flat_map_python": "select distinct n_nationkey as k, unnest(string_split(n_name, '')) as c from nation",
    "filter_arrow": "select o_orderkey, o_totalprice from orders where o_totalprice > 200000",
    "filter_python": "select c_custkey, c_mktsegment from customer where c_mktsegment = 'BUILDING'",
    "shuffle_arrow": "select o_custkey, max(o_totalprice) - min(o_totalprice) as spread from orders group by 1",
    "sort_descending": "select c_name, row_number() over (order by c_name desc) as pos from customer",
    "collect_rows": "select r_regionkey, r_name from region",
    "save_custom": "select s_suppkey, s_nationkey from supplier",
    "sort_files": "select row_number() over (order by o_custkey) as pos, o_custkey::int as n from orders",
    "change_tracking_files": """with j as (select c_custkey as id, c_mktsegment as a, case when c_custkey % 3 = 0 then 'MOVED' else c_mktsegment end as b from customer)
      select id, a as city from j union all select id, b from j where a <> b""",
    "semi": _SIDES + "select k, l from c where exists (select 1 from o where o.k = c.k)",
    "anti": _SIDES + "select k, l from c where not exists (select 1 from o where o.k = c.k)",
    "distinct_types": "select distinct event_type from events",
    "intersect_keys": _SIDES + "select k from c intersect select k from o",
    "subtract_keys": _SIDES + "select k from c except select k from o",
    "count_by_key": "select user_id, count(*) as n from events group by 1",
    "global_reduce": "select count(*) as n, sum(l_quantity) as s, max(l_quantity) as m from lineitem",
    "top_orders": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25",
    "sort_price": "select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) as pos from orders",
    "sample_size": "select o_custkey % 4 as p, least(10, count(*)) as n from orders group by 1",
    "partition_by_id": "select l_orderkey % 8 as p, count(*) as n from lineitem group by 1",
    "partition_by_range": "select (case when l_quantity <= 10 then 0 when l_quantity <= 20 then 1 when l_quantity <= 40 then 3 else 4 end)::int as p, count(*) as n from lineitem group by 1",
    "save_roundtrip": "select n_nationkey, n_name from nation",
    "repeat_and_sum": "select l_returnflag as f, sum(l_linenumber * l_linenumber * 4 * 60)::bigint as x from lineitem group by 1",
    "many_step": "select event_id, greatest(0::bigint, floor(s * 1000)::bigint) as k from (select event_id, sin((event_id * 2)::double) as s from events) where s < 0.5",
    "many_rounds": f"select x, count(*) as n from ({_ROUNDS}) group by 1",
    "change_tracking": """with j as (select c_custkey as id, c_mktsegment as a, case when c_custkey % 3 = 0 then 'MOVED' else c_mktsegment end as b from customer)
      select id, a as city from j union all select id, b from j where a <> b""",
}
