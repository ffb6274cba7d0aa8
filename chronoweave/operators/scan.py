"""Running values over long groups that no task holds whole.

A group's rows are cut into slices of their order (hours of time, ranges of an index).
Each slice is summed up in one row; a prefix over these few rows gives what a slice
inherits from those before it; and that is put before the slice's own rows, which alone
are sorted and scanned together. Rows are shuffled once, by group and slice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

#: Microseconds of a slice of time, and places of a slice of an index.
SLICE, INDEX_SLICE = 3_600_000_000, 65_536
#: Rows that one task may sort, however they fall into groups.
WHOLE = 1_000_000


def slice_of(df: DataFrame, column: str, width: int | None = None) -> Column:
    """The slice of a column's value: microseconds of a timestamp or ranges of a number, `width` each; other types are one slice."""
    kind, c = df.select(column).schema[0].dataType, F.col(column)
    if isinstance(kind, (TimestampType, TimestampNTZType, DateType)):
        return F.floor(F.unix_micros(c.cast("timestamp")) / (width or SLICE))
    if isinstance(kind, NumericType):
        return F.floor(c / (width or INDEX_SLICE))
    return F.lit(0)


def few(*tables: DataFrame | int) -> bool:
    """Whether one task may hold all rows of the tables; a number stands for a table of so many rows."""
    return sum(x if isinstance(x, int) else x.count() for x in tables) <= WHOLE


def scan(
    rows: DataFrame,
    keys: list[str],
    by: Column | None,
    order: list[str | Column],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    wholes: dict[str, tuple[Callable, Column]] | None = None,
    of: list[DataFrame | int] | None = None,
) -> DataFrame:
    """rows with running columns over each group, in the given order.

    by: the slice of a row, which grows with the order; None if one task may hold a group. of: the tables that rows are made
    of, if rows itself is dear to count; tables of WHOLE rows together are scanned in one
    window for each group, since no task can get more. sums: the sum up to and with the
    row. lasts: the last value that is not null up to and with the row. previous: the
    value of the row before, null for the first. wholes: an aggregate (min, max or sum)
    of the whole group. Null keys are groups of their own.
    """
    sums, lasts, previous, wholes = sums or {}, lasts or {}, previous or {}, wholes or {}
    group = W.partitionBy(keys) if keys else W.partitionBy(F.lit(0))
    if by is None or few(*(of or [rows])):
        upto, earlier = (group.orderBy(*order).rowsBetween(W.unboundedPreceding, end) for end in (0, -1))
        return rows.withColumns(
            {n: F.sum(c).over(upto) for n, c in sums.items()}
            | {n: F.last(c, ignorenulls=True).over(upto) for n, c in lasts.items()}
            | {n: F.last(c).over(earlier) for n, c in previous.items()}
            | {n: f(c).over(group) for n, (f, c) in wholes.items()}
        )
    boxed = {n: F.struct(c.alias("v")) for n, c in previous.items()}  # a null value is a value here
    mine = {f"_s_{n}": c for n, c in sums.items()} | {f"_l_{n}": c for n, c in lasts.items()} | {f"_p_{n}": c for n, c in boxed.items()}
    rows = rows.withColumns({"_slice": by.cast("long"), "_kind": F.lit(1)} | mine | {f"_w_{n}": c for n, (_, c) in wholes.items()})
    place = F.struct(*[F.col(c).alias(f"o{i}") if isinstance(c, str) else c.alias(f"o{i}") for i, c in enumerate(order)])
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), place))
    one = rows.groupBy(*keys, "_slice").agg(
        F.lit(0).alias("_kind"),
        *[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums],
        *[latest(f"_l_{n}").alias(f"_l_{n}") for n in lasts],
        *[latest(f"_p_{n}").alias(f"_p_{n}") for n in previous],
        *[f(F.col(f"_w_{n}")).alias(f"_w_{n}") for n, (f, _) in wholes.items()],
    )
    before = group.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = one.withColumns(
        {f"_s_{n}": F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)) for n in sums}
        | {f"_{k}_{n}": F.last(f"_{k}_{n}", ignorenulls=True).over(before) for k, names in (("l", lasts), ("p", previous)) for n in names}
        | {f"_w_{n}": f(F.col(f"_w_{n}")).over(group) for n, (f, _) in wholes.items()}
    )
    # what a slice inherits comes first in it
    inside = W.partitionBy(*keys, "_slice").orderBy("_kind", *order)
    upto, earlier = inside.rowsBetween(W.unboundedPreceding, 0), inside.rowsBetween(W.unboundedPreceding, -1)
    both = rows.drop(*[f"_w_{n}" for n in wholes]).unionByName(carried, allowMissingColumns=True)
    out = both.withColumns(
        {n: F.sum(f"_s_{n}").over(upto) for n in sums}
        | {n: F.last(f"_l_{n}", ignorenulls=True).over(upto) for n in lasts}
        | {n: F.last(f"_p_{n}", ignorenulls=True).over(earlier)["v"] for n in previous}
        | {n: F.first(f"_w_{n}").over(upto) for n in wholes}
    )
    return out.where("_kind = 1").drop("_slice", "_kind", *mine, *[f"_w_{n}" for n in wholes])


def numbered(rows: DataFrame, keys: list[str], by: Column, order: list[str | Column], name: str = "n", of: list[DataFrame | int] | None = None) -> DataFrame:
    """rows numbered from 0 in each group."""
    return scan(rows, keys, by, order, sums={name: F.lit(1)}, of=of).withColumn(name, F.col(name) - 1)
