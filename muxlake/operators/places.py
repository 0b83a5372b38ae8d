"""Numbers and running sums over rows in order, without one task for a whole source.

Rows are cut into chunks by the leading value of their order, a chunk being ``2 ** bits`` values wide.
Chunks are summed by chunks of chunks in the same way, so a window holds that many different values,
however long the source or sparse the values; the last one holds a row for each 2 ** 32 values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 16
#: Stands for null, which comes first.
LEAST = -(1 << 63)


def sums_before(df: DataFrame, keys: list[str], lead: Column, order: list[str | Column], amounts: dict[str, Column], bits: int = BITS, levels: int = 1) -> DataFrame:
    """Adds a column for each of ``amounts``: its sum over the rows before in ``order``, 0 for the first.

    ``lead`` is a whole number that never falls along ``order``; amounts are never null. Rows that
    share one value of ``lead`` are worked on by one task.
    """
    chunk = f"_chunk{levels}"
    x = df.withColumn(chunk, F.shiftright(lead.cast("long"), bits))
    own = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ends = x.groupBy(*keys, chunk).agg(*[F.sum(a.cast("long")).alias(f"_{n}") for n, a in amounts.items()])
    totals = {f"_{n}_before": F.col(f"_{n}") for n in amounts}
    if levels:
        ends = sums_before(ends, keys, F.col(chunk), [chunk], totals, bits, levels - 1)
    else:
        ahead = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select("*", *[F.coalesce(F.sum(t).over(ahead), F.lit(0)).alias(n) for n, t in totals.items()])
    ends = ends.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col(chunk).alias("_of"), *totals)
    x = x.select("*", *[F.coalesce(F.sum(a.cast("long")).over(own), F.lit(0)).alias(f"_{n}_in") for n, a in amounts.items()])
    same = F.col(chunk) == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return x.join(ends, same).select(*df.columns, *[(F.col(f"_{n}_in") + F.col(f"_{n}_before")).alias(n) for n in amounts])


def number(df: DataFrame, keys: list[str], lead: Column, order: list[str | Column], name: str, bits: int = BITS) -> DataFrame:
    """Adds ``name``: the rows before each row in ``order``."""
    return sums_before(df, keys, lead, order, {name: F.lit(1)}, bits)


def leading(df: DataFrame, column: str) -> Column:
    """The first whole number or time that rows ordered by ``column`` are ordered by, as a whole number (0 where there is none)."""
    value, kind = F.col(column), df.schema[column].dataType
    while isinstance(kind, T.StructType):
        value, kind = value[kind[0].name], kind[0].dataType
    if isinstance(kind, T.TimestampType):
        return F.coalesce(F.unix_micros(value), F.lit(LEAST))
    if isinstance(kind, T.TimestampNTZType):
        return F.coalesce(F.unix_micros(value.cast("timestamp")), F.lit(LEAST))
    if isinstance(kind, T.IntegralType):
        return F.coalesce(value.cast("long"), F.lit(LEAST))
    return F.lit(0).cast("long")
