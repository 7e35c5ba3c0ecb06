"""Prefix values over one ordered entity that may be too long for one task.

A window over a whole entity puts all its rows into one task. Here an entity is cut into buckets of
bounded length: a window runs inside each bucket, a second one over one row per bucket, and both are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def before(df: DataFrame, entity: list[str], bucket: str, order: list[str], **wanted: tuple[str, Column]) -> DataFrame:
    """For each ``name=(kind, value)`` add what the rows before the current one give: their ``max`` or ``sum``; kind ``total``
    adds the sum over all rows of the entity.

    ``df`` needs one bucket number per row that does not decrease in ``order`` within an entity. Null values are
    skipped; where no row is before, ``max`` is null and ``sum`` 0.
    """
    inside = Window.partitionBy(*entity, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*entity).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*entity)
    fold = {"max": F.max, "sum": F.sum, "total": F.sum}
    totals = df.groupBy(*entity, bucket).agg(*[fold[kind](value).alias(f"__{name}") for name, (kind, value) in wanted.items()])
    totals = totals.select(*entity, bucket, *[fold[kind](f"__{name}").over(whole if kind == "total" else across).alias(f"__{name}") for name, (kind, _) in wanted.items()])
    totals = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*entity, bucket])], *[f"__{n}" for n in wanted])
    local = df.withColumns({f"__in_{name}": fold[kind](value).over(inside) for name, (kind, value) in wanted.items() if kind != "total"})
    match = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*entity, bucket])]
    joined = local.join(totals, match)
    out = {}
    for name, (kind, _) in wanted.items():
        if kind == "total":
            out[name] = F.col(f"__{name}")
            continue
        a, b = F.col(f"__{name}"), F.col(f"__in_{name}")
        out[name] = F.greatest(a, b) if kind == "max" else F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return joined.withColumns(out).select(*df.columns, *wanted)
