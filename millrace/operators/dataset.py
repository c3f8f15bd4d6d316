"""Dataset: an immutable handle to a DataFrame plan with the engine's operators; `.df` is the way out to all of Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrow, as_schema, python, run_arrow, run_python
from .aggregators import COLLECT, SUM, Arrow, Declarative, General
from .partitioners import Hash, Partitioner, Range

#: Rows by which dividers of columns without quantile summaries are placed, about.
SORT_SAMPLE_ALL = 200_000


def _named(c: Column, name: str | None) -> Column:
    return c.alias(name) if name else c


class Dataset:
    def __init__(self, df: DataFrame):
        self.df = df

    def __repr__(self) -> str:
        return f"Dataset({', '.join(f'{n}: {t}' for n, t in self.df.dtypes)})"

    # sources

    @classmethod
    def new_from_list(cls, spark: SparkSession, data: Sequence[Sequence[Any]], schema: str | T.StructType) -> Dataset:
        """Rows by partition: the outer index is the partition. No partition at all gives an empty Dataset."""
        schema = as_schema(schema)
        width = len(schema)
        rows = [(p, i, *(x if width > 1 else (x[0] if isinstance(x, tuple) and len(x) == 1 else x,))) for p, part in enumerate(data) for i, x in enumerate(part)]
        full = T.StructType([T.StructField("__p", T.IntegerType()), T.StructField("__i", T.LongType()), *schema.fields])
        df = spark.createDataFrame(rows, full)
        if not data:
            return cls(df.select(*schema.names))
        return cls(df.repartitionById(len(data), F.col("__p")).sortWithinPartitions("__i").select(*schema.names))

    # one row at a time

    def map(self, f: Callable[..., Any] | arrow | python) -> Dataset:
        """f: Columns of the row to a Column, a list of Columns or a dict of named ones; or a wrapped function."""
        if isinstance(f, arrow):
            return Dataset(run_arrow(self.df, f))
        if isinstance(f, python):
            return Dataset(run_python(self.df, f, many=False))
        got = f(*(F.col(c) for c in self.df.columns))
        if isinstance(got, dict):
            got = [c.alias(n) for n, c in got.items()]
        return Dataset(self.df.select(*(got if isinstance(got, (list, tuple)) else [got])))

    def map_with_state(self, state: Any, f: Callable[..., Any]) -> Dataset:
        """As map, with an immutable configuration as the first argument."""
        if isinstance(f, (arrow, python)):
            return self.map(type(f)(lambda x, g=f.f: g(state, x), f.schema))
        return self.map(lambda *c: f(state, *c))

    def flat_map(self, f: Callable[..., Column] | arrow | python, name: str = "value") -> Dataset:
        """f: Columns to an array Column, exploded in order (rows with empty or null arrays go); arrays of structs become columns."""
        if isinstance(f, arrow):
            return Dataset(run_arrow(self.df, f))
        if isinstance(f, python):
            return Dataset(run_python(self.df, f, many=True))
        out = self.df.select(F.explode(f(*(F.col(c) for c in self.df.columns))).alias(name))
        return Dataset(out.select(f"{name}.*") if isinstance(out.schema[0].dataType, T.StructType) else out)

    def flat_map_with_state(self, state: Any, f: Callable[..., Any], name: str = "value") -> Dataset:
        if isinstance(f, (arrow, python)):
            return self.flat_map(type(f)(lambda x, g=f.f: g(state, x), f.schema), name)
        return self.flat_map(lambda *c: f(state, *c), name)

    def filter(self, f: Callable[..., Column] | arrow | python) -> Dataset:
        """Null counts as false. arrow(f): a batch to a boolean array; python(f): a row as dict to a truth value."""
        if isinstance(f, (arrow, python)):
            row, g = isinstance(f, python), f.f

            def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    yield b.filter(pa.array([bool(g(x)) for x in b.to_pylist()], pa.bool_()) if row else g(b))

            return Dataset(self.df.mapInArrow(go, self.df.schema))
        return Dataset(self.df.filter(f(*(F.col(c) for c in self.df.columns))))

    def filter_with_state(self, state: Any, f: Callable[..., Any]) -> Dataset:
        if isinstance(f, (arrow, python)):
            return self.filter(type(f)(lambda x, g=f.f: g(state, x), f.schema))
        return self.filter(lambda *c: f(state, *c))

    # one partition at a time

    def map_partitions(self, f: Callable[[Iterator[pa.RecordBatch], int], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> Dataset:
        """f gets a partition's batches and its id, also for an empty partition; batches stream, none is kept for it."""

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from f(batches, TaskContext.get().partitionId())

        return Dataset(self.df.mapInArrow(go, as_schema(schema)))

    def map_partitions_with_state(self, state: Any, f: Callable[..., Iterator[pa.RecordBatch]], schema: str | T.StructType) -> Dataset:
        return self.map_partitions(lambda batches, pid: f(state, batches, pid), schema)

    def sample(self, amount: int, seed: int = 0) -> Dataset:
        """Exactly min(amount, rows) rows of each partition without replacement, uniform and repeatable for a seed.

        Each row gets a random key, and a task keeps the rows of the `amount` largest so far; nothing is shuffled. Rows keep
        their order.
        """
        if amount < 0:
            raise ValueError("a sample has no fewer than 0 rows")
        schema = self.df.schema

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rng = np.random.default_rng([seed % 2**64, TaskContext.get().partitionId()])
            kept, keys = None, np.zeros(0)
            for b in batches:
                new = rng.random(b.num_rows)
                if len(keys) == amount:  # most batches add few rows
                    at = np.flatnonzero(new > keys.min()) if amount else np.zeros(0, np.int64)
                    b, new = b.take(pa.array(at)), new[at]
                if not b.num_rows:
                    continue
                both = pa.Table.from_batches([b] if kept is None else [*kept.to_batches(), b])
                keys = np.concatenate([keys, new])
                best = np.sort(np.argpartition(-keys, amount - 1)[:amount]) if len(keys) > amount else np.arange(len(keys))
                kept, keys = both.take(pa.array(best)), keys[best]
            if kept is not None:
                yield from kept.to_batches()

        return Dataset(self.df.mapInArrow(go, schema))

    # several inputs

    def union(self, *others: Dataset) -> Dataset:
        """A bag: repeats stay, also of the same input given twice; partitions are concatenated."""
        return Dataset(reduce(DataFrame.unionAll, [o.df for o in others], self.df))

    # keyed

    def shuffle(self, key: str | Sequence[str], value: str, aggregator: Declarative | General | Arrow, partitioner: Partitioner | None = None, out: str | None = None) -> Dataset:
        """Aggregates value by key; with a partitioner the result is placed by it, in that many partitions."""
        keys = [key] if isinstance(key, str) else list(key)
        df = aggregator.apply(self.df, keys, value, out or value)
        return Dataset(partitioner.place(df, keys) if partitioner else df)

    def sum_by_key(self, key: str | Sequence[str], value: str, partitioner: Partitioner | None = None, out: str | None = None) -> Dataset:
        """Sums keep the value's type; an overflow is an error."""
        return self.shuffle(key, value, SUM, partitioner, out)

    def group_by(self, key: str | Sequence[str], value: str, order: str | None = None, partitioner: Partitioner | None = None, out: str | None = None) -> Dataset:
        """All values of a key as an array, by a column of ordinals if `order` names one, else in no order that is kept."""
        if order is None:
            return self.shuffle(key, value, COLLECT, partitioner, out)
        keys = [key] if isinstance(key, str) else list(key)
        pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
        df = self.df.groupBy(*keys).agg(F.transform(pairs, lambda p: p["v"]).alias(out or value))
        return Dataset(partitioner.place(df, keys) if partitioner else df)

    def with_ordinal(self, name: str = "ordinal") -> Dataset:
        """A column that orders rows by partition and position, for group_by(order=)."""
        return Dataset(self.df.withColumn(name, F.monotonically_increasing_id()))

    def cogroup(self, other: Dataset, key: str, left: str, right: str, order: tuple[str | None, str | None] = (None, None), null_safe: bool = False) -> Dataset:
        """(key, left values, right values) for keys of either side; the missing side is an empty array.

        Each side is grouped before the join, so the join has a row a key. null_safe: null keys of both sides meet.
        """
        a, b = self.group_by(key, left, order[0], out="__l").df, other.group_by(key, right, order[1], out="__r").df
        a, b = a.withColumnRenamed(key, "__a"), b.withColumnRenamed(key, "__b")
        on = F.col("__a").eqNullSafe(F.col("__b")) if null_safe else F.col("__a") == F.col("__b")
        j = a.join(b, on, "full_outer")
        empty = lambda c: F.coalesce(F.col(c), F.array().cast(j.schema[c].dataType))
        second = right if right != left else f"{right}_right"
        return Dataset(j.select(F.coalesce("__a", "__b").alias(key), empty("__l").alias(left), empty("__r").alias(second)))

    def join(self, other: Dataset, key: str | Sequence[str], how: str = "inner", null_safe: bool = False) -> Dataset:
        """A native join, never a cogroup: Catalyst picks the strategy and splits skewed partitions. A column of the
        right side that the left has too gets the suffix _right."""
        keys = [key] if isinstance(key, str) else list(key)
        if not null_safe and how in ("left_semi", "left_anti"):
            return Dataset(self.df.join(other.df, keys, how))
        clash = set(self.df.columns) - set(keys)
        right = other.df.select(*(F.col(c).alias(f"__k_{c}" if c in keys else f"{c}_right" if c in clash else c) for c in other.df.columns))
        cond = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) if null_safe else F.col(k) == F.col(f"__k_{k}") for k in keys])
        j = self.df.join(right, cond, how)
        if how in ("left_semi", "left_anti"):
            return Dataset(j)
        return Dataset(j.select(*(F.coalesce(k, f"__k_{k}").alias(k) for k in keys), *(c for c in j.columns if c not in keys and not c.startswith("__k_"))))

    def distinct(self) -> Dataset:
        return Dataset(self.df.distinct())

    def intersect(self, other: Dataset) -> Dataset:
        return Dataset(self.df.intersect(other.df))

    def subtract(self, other: Dataset) -> Dataset:
        return Dataset(self.df.subtract(other.df))

    def reduce(self, *aggs: Column) -> Dataset:
        return Dataset(self.df.agg(*aggs))

    def top(self, n: int, *order: Column | str) -> Dataset:
        return Dataset(self.df.orderBy(*order).limit(n))

    # placement and order

    def partition_by(self, partitioner: Partitioner, *keys: str) -> Dataset:
        """One exchange and no grouping; every row stays."""
        return Dataset(partitioner.place(self.df, keys or tuple(self.df.columns)))

    def dividers(self, key: str, partitions: int) -> Range:
        """A Range of exactly so many partitions, by approximate quantiles of a column; nulls aren't counted.

        Numbers, dates and timestamps: quantile summaries that tasks make and Spark merges, in one pass. Other types: about
        SORT_SAMPLE_ALL rows, chosen by a hash once rows have been counted.
        """
        if partitions < 1:
            raise ValueError("sort needs one partition at least")
        if partitions == 1:
            return Range(())
        known = self.df.select(key).where(F.col(key).isNotNull())
        shares = [i / partitions for i in range(1, partitions)]
        if isinstance(self.df.schema[key].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            got = known.agg(F.percentile_approx(key, shares, max(10_000, 20 * partitions))).first()[0] or []
        else:
            share = SORT_SAMPLE_ALL / max(1, known.count())
            if share < 1:
                known = known.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)) < int(share * (1 << 30)))
            rows = sorted(r[0] for r in known.collect())
            got = [rows[min(len(rows) - 1, int(len(rows) * x))] for x in shares] if rows else []
        return Range(tuple(got) or (None,) * (partitions - 1))

    def sort(self, *keys: str, partitions: int | Range | None = None, descending: bool = False) -> Dataset:
        """Total order by the keys, all ascending with nulls first or all descending with nulls last. With `partitions` there
        are exactly so many, whatever the data: rows are placed by the first key, and those equal to a divider are in the
        partition that it ends (begins, if descending). A Range from dividers() is taken as it is."""
        keys = keys or tuple(self.df.columns)
        order = [F.desc_nulls_last(k) if descending else F.asc_nulls_first(k) for k in keys]
        if partitions is None:
            return Dataset(self.df.orderBy(*order))
        r = partitions if isinstance(partitions, Range) else self.dividers(keys[0], partitions)
        bucket = r.bucket(F.col(keys[0])).cast("int")
        placed = self.df.repartitionById(r.partitions, F.lit(r.partitions - 1) - bucket if descending else bucket)
        return Dataset(placed.sortWithinPartitions(*order))

    # actions

    def collect(self) -> list:
        return self.df.collect()

    def save(self, path: str, serialise: Callable[[list[dict]], bytes] | None = None) -> None:
        """One file a partition, named by its id; see sources.partfiles."""
        from ..sources.partfiles import save

        save(self.df, path, serialise)


def read_partitions_from(spark: SparkSession, path: str, n: int) -> Dataset:
    from ..sources.partfiles import read

    return Dataset(read(spark, path, n))


__all__ = ["Dataset", "Hash", "read_partitions_from"]
