"""Overlapping and gapped time intervals per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The day that stands for "without end".
FOREVER = "9999-12-31"


def _boundaries(spans: DataFrame, entity: str, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """Starts and ends of each entity, sorted independently, with their ranks.

    Equal days are counted before they are ranked, so an entity's window holds at
    most one row per calendar day however many spans it has.
    """
    valid = spans.select(
        F.col(entity).alias("_e"),
        F.col(start).cast("date").alias("_from"),
        F.coalesce(F.col(end).cast("date"), F.lit(FOREVER).cast("date")).alias("_to"),
    ).where(F.col("_e").isNotNull() & F.col("_from").isNotNull() & (F.col("_to") >= F.col("_from")))
    w = Window.partitionBy("_e").orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)

    def ranked(side: str) -> DataFrame:
        counted = valid.groupBy("_e", F.col(side).alias("_day")).agg(F.count("*").alias("_n"))
        return counted.withColumn("_upto", F.sum("_n").over(w))

    return ranked("_from").withColumn("_before", F.col("_upto") - F.col("_n")), ranked("_to")


def interval_gaps(spans: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """Gaps between the continuous periods of each entity: (entity, gap_from, gap_to).

    Spans include both their days; spans that follow on the next day are continuous.
    ``end`` null means without end.  Rows with a null entity or start, or whose end
    precedes the start, have no span.  Repeated rows change nothing.

    With starts and ends sorted independently, the (i+1)-th start lies more than a
    day after the i-th end exactly where no span covers the days between.
    """
    starts, ends = _boundaries(spans, entity, start, end)
    last = ends.select("_e", F.col("_upto").alias("_before"), F.col("_day").alias("_end"))
    pairs = starts.select("_e", "_before", "_day").join(last, ["_e", "_before"])
    return pairs.where(F.col("_day") > F.date_add("_end", 1)).select(
        F.col("_e").alias(entity),
        F.date_add("_end", 1).alias("gap_from"),
        F.date_sub("_day", 1).alias("gap_to"),
    )


def merge_intervals(spans: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """Continuous periods of each entity: (entity, period_from, period_to, spans).

    ``period_to`` is 9999-12-31 for a period without end; ``spans`` counts the spans
    merged.  Validity and continuity as in :func:`interval_gaps`.  A period begins at
    a start with no end of the same rank a day or less before it; the boundaries that
    remain pair up in order.
    """
    starts, ends = _boundaries(spans, entity, start, end)
    by_rank = ends.select("_e", F.col("_upto").alias("_before"), F.col("_day").alias("_end"))
    opened = (
        starts.join(by_rank, ["_e", "_before"], "left")
        .where(F.col("_end").isNull() & (F.col("_before") == 0) | (F.col("_day") > F.date_add("_end", 1)))
        .select("_e", "_day", "_before")
    )
    w = Window.partitionBy("_e").orderBy("_day")
    total = ends.groupBy("_e").agg(F.max("_day").alias("_last"), F.max("_upto").alias("_all"))
    periods = opened.withColumn("_next", F.lead("_before").over(w)).join(total, "_e")
    closing = by_rank.withColumnRenamed("_before", "_next")
    return (
        periods.join(closing, ["_e", "_next"], "left")
        .select(
            F.col("_e").alias(entity),
            F.col("_day").alias("period_from"),
            F.coalesce("_end", "_last").alias("period_to"),
            (F.coalesce("_next", "_all") - F.col("_before")).alias("spans"),
        )
    )
