"""Irregular readings onto a regular grid of periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The bucket of readings without one.
NEVER = -(2**31)


def regular_grid(
    readings: DataFrame,
    source: list[str],
    bucket: Column,
    value: str,
    arrived: str,
    max_gap: int = 3,
) -> DataFrame:
    """One row per source and bucket between the source's first and last usable reading.

    ``bucket`` gives an INT period of a row or null (row unusable); null and NaN
    values are unusable, too.  Result: the source columns, ``bucket``, ``n`` usable
    readings (0 in a gap), ``value`` (the reading that arrived last; ties: the
    largest value), ``filled`` (the value carried forward over at most ``max_gap``
    empty buckets) and ``mark``: 'read', 'filled' or 'missing'.

    Sources with a null part form a source of their own.  A source without a usable
    reading, and an empty table, give no row.  Columns beyond those named are never
    touched, so clashing names do no harm.

    Readings are reduced to one row per source and bucket before anything is grouped
    by source, so a source holding a large share of all rows costs one map-side
    combine, and a source's window never exceeds the grid's length.
    """
    # One struct of the source columns is the key: structs compare null with null.
    usable = (
        readings.select(
            F.struct(*[F.col(s).alias(f"s{i}") for i, s in enumerate(source)]).alias("_k"),
            F.coalesce(bucket.cast("int"), F.lit(NEVER)).alias("_b"),
            F.col(value).cast("double").alias("_v"),
            F.col(arrived).alias("_a"),
        )
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    )
    # Unusable buckets go after the aggregation: before it the filter would read each bucket twice.
    read = usable.groupBy("_k", "_b").agg(
        F.count(F.when(F.col("_b") != NEVER, 1)).alias("_n"),
        F.max(F.struct("_a", "_v"))["_v"].alias("_v"),
    ).where("_n > 0")
    # Both uses of the aggregate ask for all its columns, so its one exchange serves both; the
    # readings' side keeps the partitioning of its aggregation and only the sequence moves.
    sequence = (
        read.groupBy("_k")
        .agg(F.min("_b").alias("_first"), F.max("_b").alias("_last"), F.max("_n").alias("_n"), F.max("_v").alias("_v"))
        .where("_n is not null and _v is not null")
        .select("_k", F.explode(F.sequence("_first", "_last")).alias("_at"))
    )
    joined = (
        sequence.alias("g")
        .join(read.alias("r"), (F.col("g._k") == F.col("r._k")) & (F.col("g._at") == F.col("r._b")), "left")
        .select("g._k", "_at", "_b", "_n", "_v")
    )
    w = Window.partitionBy("_k").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("_b").isNotNull(), F.struct("_b", "_v")), ignorenulls=True).over(w)
    grid = joined.withColumn("_seen", seen).select(
        "_k", "_at", "_n", F.col("_seen._b").alias("_b"), F.col("_seen._v").alias("_v")
    )
    age = F.col("_at") - F.col("_b")
    return grid.select(
        *[F.col(f"_k.s{i}").alias(s) for i, s in enumerate(source)],
        F.col("_at").alias("bucket"),
        F.when(age == 0, F.col("_n")).otherwise(F.lit(0)).cast("bigint").alias("n"),
        F.when(age == 0, F.col("_v")).alias("value"),
        F.when(age <= max_gap, F.col("_v")).alias("filled"),
        F.when(age == 0, "read").when(age <= max_gap, "filled").otherwise("missing").alias("mark"),
    )
