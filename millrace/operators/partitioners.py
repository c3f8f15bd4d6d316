"""Where rows go: by hash, by range with dividers, or by an expression that gives the partition itself."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Partitioner:
    partitions: int

    def place(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        raise NotImplementedError


def _positive(n: int) -> None:
    if n < 1:
        raise ValueError("a partitioner needs one partition at least")


@dataclass(frozen=True)
class Hash(Partitioner):
    partitions: int

    def __post_init__(self) -> None:
        _positive(self.partitions)

    def place(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        return df.repartition(self.partitions, *keys)


@dataclass(frozen=True)
class ById(Partitioner):
    """The partition is an expression of the row. An id out of range fails the query instead of wrapping around."""

    partitions: int
    expr: Callable[..., Column]

    def __post_init__(self) -> None:
        _positive(self.partitions)

    def place(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        pid = self.expr(*(F.col(k) for k in keys)).cast("int")
        bad = pid.isNull() | (pid < 0) | (pid >= self.partitions)
        checked = F.when(bad, F.raise_error(F.concat(F.lit("partition id out of range: "), F.coalesce(pid.cast("string"), F.lit("null")))).cast("int")).otherwise(pid)
        return df.repartitionById(self.partitions, checked)


@dataclass(frozen=True)
class Range(Partitioner):
    """Upper-inclusive ranges: partition i holds keys in (dividers[i-1], dividers[i]]; one more than there are dividers."""

    dividers: tuple[Any, ...]

    @property
    def partitions(self) -> int:  # type: ignore[override]
        return len(self.dividers) + 1

    def bucket(self, key: Column) -> Column:
        """The number of dividers below the key; nulls come first."""
        if not self.dividers:
            return F.lit(0)
        below = lambda xs: F.size(F.filter(xs, lambda d: d < key))
        every = F.array(*(F.lit(d) for d in self.dividers))
        # among n dividers first the run of about sqrt(n), by the last of each run, then the place in it
        run = max(1, math.isqrt(len(self.dividers)))
        runs = below(F.array(*(F.lit(d) for d in self.dividers[run - 1 :: run])))
        return F.when(key.isNull(), F.lit(0)).otherwise(runs * run + below(F.slice(every, runs * run + 1, F.lit(run))))

    def place(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        (key,) = keys
        return df.repartitionById(self.partitions, self.bucket(F.col(key)).cast("int"))
