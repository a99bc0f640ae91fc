"""Ordered computations inside a key whose rows may not fit one task.

A plain ``Window.partitionBy(session)`` puts a whole session into one task.  A
session may hold a large part of all rows, so every operator here cuts the order
into levels: rows are windowed inside a block, block totals are windowed inside
the key, and the two are joined on (key, block).  A block holds a bounded number
of rows because the finest level is a dense position.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 8192


def block(position: str | Column, size: int = BLOCK) -> Column:
    """Block number of a dense integer position."""
    col = F.col(position) if isinstance(position, str) else position
    return F.floor(col / F.lit(size)).cast("long")


def line_levels(position: str = "line_index", size: int = BLOCK, newest_first: bool = False):
    """Levels for the order by a dense position."""
    sign = -1 if newest_first else 1
    return [block(position, size) * sign, F.col(position) * sign]


def exclusive_sums(
    df: DataFrame, keys: Sequence[str], levels: Sequence[Column], sums: Mapping[str, Column]
) -> DataFrame:
    """Add, per row, the sum of each measure over the rows before it in its key.

    ``levels`` order the rows from coarse to fine; together they identify a row
    within the key, and each level should have few values within the one above.
    """
    keys = list(keys)
    depth = len(levels)
    names = [f"_level{i}" for i in range(depth)]
    measures = list(sums)
    base = df.withColumns(
        {
            **dict(zip(names, levels)),
            **{f"_value_{m}": F.coalesce(sums[m].cast("long"), F.lit(0)) for m in measures},
        }
    )
    totals = {
        depth - 1: base.groupBy(*keys, *names[:-1]).agg(
            *[F.sum(f"_value_{m}").alias(f"_total_{m}") for m in measures]
        )
    }
    for d in range(depth - 2, 0, -1):
        totals[d] = totals[d + 1].groupBy(*keys, *names[:d]).agg(
            *[F.sum(f"_total_{m}").alias(f"_total_{m}") for m in measures]
        )
    offsets = None
    for d in range(1, depth):
        inside = (
            Window.partitionBy(*keys, *names[: d - 1])
            .orderBy(names[d - 1])
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        current = totals[d].withColumns(
            {f"_here_{m}": F.coalesce(F.sum(f"_total_{m}").over(inside), F.lit(0)) for m in measures}
        )
        if offsets is not None:
            current = current.join(offsets, keys + names[: d - 1]).withColumns(
                {f"_here_{m}": F.col(f"_here_{m}") + F.col(f"_offset_{m}") for m in measures}
            )
        offsets = current.select(
            *keys, *names[:d], *[F.col(f"_here_{m}").alias(f"_offset_{m}") for m in measures]
        )
    last = (
        Window.partitionBy(*keys, *names[:-1])
        .orderBy(names[-1])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = base.join(offsets, keys + names[:-1])
    out = joined.withColumns(
        {
            m: F.col(f"_offset_{m}") + F.coalesce(F.sum(f"_value_{m}").over(last), F.lit(0))
            for m in measures
        }
    )
    return out.select(*[c for c in df.columns if c not in measures], *measures)


def previous(
    df: DataFrame, keys: Sequence[str], levels: Sequence[Column], values: Mapping[str, Column]
) -> DataFrame:
    """Add, per row, each value as it stood on the row just before it in its key.

    Two levels: a block and the position inside it.  NULL on the first row.
    """
    keys = list(keys)
    coarse, fine = levels
    packed = F.struct(*[v.alias(n) for n, v in values.items()])
    base = df.withColumns({"_block": coarse, "_fine": fine, "_packed": packed})
    lasts = base.groupBy(*keys, "_block").agg(F.max_by("_packed", "_fine").alias("_last"))
    over_blocks = Window.partitionBy(*keys).orderBy("_block")
    carried = lasts.select(*keys, "_block", F.lag("_last").over(over_blocks).alias("_carried"))
    inside = Window.partitionBy(*keys, "_block").orderBy("_fine")
    out = base.join(carried, keys + ["_block"]).withColumn(
        "_before", F.coalesce(F.lag("_packed").over(inside), F.col("_carried"))
    )
    return out.select(*df.columns, *[F.col(f"_before.{n}").alias(n) for n in values])


def last_known(
    df: DataFrame, keys: Sequence[str], levels: Sequence[Column], values: Mapping[str, Column]
) -> DataFrame:
    """Add, per row, the latest non-NULL value at or before it in its key."""
    keys = list(keys)
    coarse, fine = levels
    names = list(values)
    base = df.withColumns(
        {"_block": coarse, "_fine": fine, **{f"_known_{n}": values[n] for n in names}}
    )
    lasts = base.groupBy(*keys, "_block").agg(
        *[
            F.max_by(f"_known_{n}", F.when(F.col(f"_known_{n}").isNotNull(), F.col("_fine"))).alias(n)
            for n in names
        ]
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = lasts.select(
        *keys,
        "_block",
        *[F.last(n, ignorenulls=True).over(earlier).alias(f"_carried_{n}") for n in names],
    )
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy("_fine")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    out = base.join(carried, keys + ["_block"])
    return out.select(
        *df.columns,
        *[
            F.coalesce(
                F.last(f"_known_{n}", ignorenulls=True).over(inside), F.col(f"_carried_{n}")
            ).alias(n)
            for n in names
        ],
    )


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters and projections refer to without repeating it.

    The optimizer copies a projected expression to every place that uses it, but not one
    that an explode of a single element yields.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key in ``order``.

    Spark cuts each map task to ``k`` rows per key before the shuffle
    (WindowGroupLimit), so a large key sends k rows per task, not all its rows.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k)
