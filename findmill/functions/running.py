"""Running totals that do not pull a large group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def running_total(
    df: DataFrame,
    keys: list[str],
    position: str,
    values: dict[str, Column],
    width: int = 100_000,
    bucket: Column | None = None,
) -> DataFrame:
    """Add each name in ``values``: the sum of its column up to and including ``position``
    within ``keys``.

    Positions are whole numbers, unique within ``keys``, so a bucket of ``width``
    positions holds at most ``width`` rows (or ``bucket`` cuts them otherwise).  Buckets
    are summed first (map-side combined), their few sums are accumulated, and the exact
    total is finished inside each bucket: no task ever sorts more than one bucket.
    """
    cut = bucket if bucket is not None else F.floor(F.col(position) / width)
    df = df.withColumns({"__bucket": cut, **{f"__{n}": v for n, v in values.items()}})
    place = [*keys, "__bucket"]
    before = (Window.partitionBy(*keys) if keys else Window).orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    inside = Window.partitionBy(*place).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.groupBy(*place).agg(*[F.sum(f"__{n}").alias(f"__before_{n}") for n in values])
    sums = sums.withColumns(
        {f"__before_{n}": F.coalesce(F.sum(f"__before_{n}").over(before), F.lit(0)) for n in values}
    )
    return (
        df.join(sums, place)
        .withColumns({n: F.col(f"__before_{n}") + F.sum(f"__{n}").over(inside) for n in values})
        .drop("__bucket", *[f"__{n}" for n in values], *[f"__before_{n}" for n in values])
    )
