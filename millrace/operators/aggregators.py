"""Aggregators: zero, merge of a value, merge of two combiners; there is no finishing step but an optional one.

Declarative ones are a Column over the group, with partial aggregation before the shuffle. General ones give zero and
merges as Column functions of a combiner; `finish` is optional. They are computed in three steps: a key's values in
65,536 rows of one input partition at most are folded into a combiner, these are merged by partition, then by key. So no
list that is gathered is longer than 2^17 or the number of partitions, however many rows a key has. The zero must be an
identity of the merge, since it is folded in at each step.

Arrow ones fold and merge tables in Python; values are combined in each task before they are exchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import as_schema


@dataclass(frozen=True)
class Declarative:
    agg: Callable[[Column], Column]
    #: the result gets the value's own type again, so that an overflow raises instead of widening
    keep_type: bool = False

    def apply(self, df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
        c = self.agg(F.col(value))
        if self.keep_type:
            c = c.cast(df.schema[value].dataType)
        return df.groupBy(*keys).agg(c.alias(out))


@dataclass(frozen=True)
class General:
    zero: Column
    merge_value: Callable[[Column, Column], Column]  # (combiner, value) -> combiner
    merge_combiners: Callable[[Column, Column], Column]
    finish: Callable[[Column], Column] | None = None

    def apply(self, df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
        # an id's upper bits are its partition, the lower 33 its row
        rows = df.select(*keys, F.col(value).alias("__v"), F.shiftright(F.monotonically_increasing_id(), 16).alias("__at"))
        folded = rows.groupBy(*keys, "__at").agg(F.reduce(F.collect_list("__v"), self.zero, self.merge_value).alias("__c"))
        merged = F.reduce(F.collect_list("__c"), self.zero, self.merge_combiners)
        by_partition = folded.groupBy(*keys, F.shiftright("__at", 17).alias("__at")).agg(merged.alias("__c"))
        return by_partition.groupBy(*keys).agg((self.finish(merged) if self.finish else merged).alias(out))


@dataclass(frozen=True)
class Arrow:
    """Combiners as Arrow tables. fold takes a table of keys and values to one of keys and combiners, a row a key; merge takes
    a table of keys and combiners, in which keys repeat, to one without repeats; finish, if any, gets the merged table.

    Folded and merged within each task first, so that an exchange carries a row a key and task at most; `held` rows of
    combiners are kept before they are merged again. combiner is the type of the column, which is named as the value.
    """

    combiner: str
    fold: Callable[[pa.Table], pa.Table]
    merge: Callable[[pa.Table], pa.Table]
    finish: Callable[[pa.Table], pa.Table] | None = None
    result: str | None = None
    held: int = 100_000

    def apply(self, df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
        kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
        schema = as_schema(", ".join([*kinds, f"`{value}` {self.combiner}"]))
        last = as_schema(", ".join([*kinds, f"`{value}` {self.result or self.combiner}"]))
        exact = lambda t, s: t.select(s.names).cast(to_arrow_schema(s))

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: list[pa.Table] = []
            rows, least = 0, self.held
            for b in batches:
                if not b.num_rows:
                    continue
                kept.append(exact(self.fold(pa.Table.from_batches([b])), schema))
                rows += kept[-1].num_rows
                if rows > least:
                    kept = [exact(self.merge(pa.concat_tables(kept)), schema)]
                    rows = kept[0].num_rows
                    if 2 * rows > self.held:  # mostly different keys: merging gains little
                        yield from kept[0].to_batches()
                        kept, rows = [], 0
            if kept:
                yield from exact(self.merge(pa.concat_tables(kept)), schema).to_batches()

        def whole(t: pa.Table) -> pa.Table:
            t = exact(self.merge(t), schema)
            return exact(self.finish(t) if self.finish else t, last)

        done = df.select(*keys, value).mapInArrow(partial, schema).groupBy(*keys).applyInArrow(whole, last)
        return done.withColumnRenamed(value, out) if out != value else done


SUM = Declarative(F.sum, keep_type=True)
COUNT = Declarative(F.count)
MIN = Declarative(F.min)
MAX = Declarative(F.max)
MEAN = Declarative(F.avg)
COLLECT = Declarative(F.collect_list)
