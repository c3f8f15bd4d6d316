"""User functions in three tiers, and casts with saturating semantics.

Tier 1: a callable from Column(s) to Column, seen by Catalyst and run in generated code. Tier 2: a function over Arrow
batches. Tier 3: a plain Python function of a row, with the schema of what it returns. The tier is chosen by how a
function is wrapped: bare callables are tier 1, `arrow(f, schema)` tier 2, `python(f, schema)` tier 3.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


@dataclass(frozen=True)
class arrow:  # noqa: N801
    """f(batch) -> batch or batches, with the schema of the result; in filter a boolean array, without a schema."""

    f: Callable[[pa.RecordBatch], Any]
    schema: str | T.StructType = ""


@dataclass(frozen=True)
class python:  # noqa: N801
    """f(row as dict) -> value, dict or, in flat_map, an iterable of them; in filter a truth value, without a schema."""

    f: Callable[[dict], Any]
    schema: str | T.StructType = ""


def as_schema(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def exact_batch(rows: list[dict], schema: T.StructType) -> pa.RecordBatch:
    """Rows as a batch of exactly the Arrow types that Spark expects for the schema."""
    return pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))


def run_arrow(df: DataFrame, w: arrow) -> DataFrame:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = w.f(b)
            if isinstance(got, pa.RecordBatch):
                yield got
            else:
                yield from got

    return df.mapInArrow(go, as_schema(w.schema))


def run_python(df: DataFrame, w: python, many: bool) -> DataFrame:
    schema = as_schema(w.schema)
    single = schema.names[0] if len(schema) == 1 else None

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                got = w.f(row)
                for x in got if many else (got,):
                    out.append(x if isinstance(x, dict) else {single: x} if single else dict(zip(schema.names, x, strict=True)))
            yield exact_batch(out, schema)

    return df.mapInArrow(go, schema)


def saturating_unsigned(x: Column) -> Column:
    """A float as an unsigned integer: truncated, negatives and NaN are 0, what is too large is the largest bigint."""
    top = F.lit(2**63 - 1)
    return (
        F.when(F.isnan(x) | (x <= 0), F.lit(0).cast("bigint"))
        .when(x >= F.lit(float(2**63)), top)
        .otherwise(F.floor(x).cast("bigint"))
    )


def saturating_int(x: Column, bits: int = 32) -> Column:
    """A number as a signed integer of 32 or 64 bits: truncated towards zero and clamped; NaN is 0."""
    kind, low, high = ("int", -(2**31), 2**31 - 1) if bits == 32 else ("bigint", -(2**63), 2**63 - 1)
    d = x.cast("double")
    cut = F.when(d < 0, F.ceil(d)).otherwise(F.floor(d))
    return F.when(F.isnan(d), F.lit(0)).when(d <= F.lit(float(low)), F.lit(low)).when(d >= F.lit(float(high)), F.lit(high)).otherwise(cut).cast(kind)


def words_on(text: Column, separator: str = " ") -> Column:
    """Tokens between single separators; empty tokens count."""
    return F.split(text, f"[{separator}]", -1)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)
