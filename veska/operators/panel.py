"""Panels of the form entity x category x period, long and packed.

The long form (entity, category, t, v) is canonical; a missing reading is a missing row or
a null ``v``, never NaN.  The packed form holds one row per series with ``v`` as an array
over all periods, so that a rolling origin is a slice and not a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veska.session import cut

SERIES = ["entity", "category"]


def dictionary(rows: DataFrame, column: str) -> DataFrame:
    """(column, code): the distinct values in order, numbered from 0; nulls have no code.  The
    numbers of a range follow those of the ranges before it, so no task orders all values."""
    values = rows.select(column).where(F.col(column).isNotNull()).distinct()
    ranged = cut(values.repartitionByRange(column).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("n")).collect()  # one row per range
    before, starts = 0, {}
    for r in sorted(sizes, key=lambda r: r["_p"]):
        starts[r["_p"]] = before
        before += r["n"]
    at = rows.sparkSession.createDataFrame(list(starts.items()), "_p int, _first bigint")
    code = F.row_number().over(Window.partitionBy("_p").orderBy(column)) - 1 + F.col("_first")
    return ranged.join(F.broadcast(at), "_p").select(column, code.alias("code"))


def build_panel(rows: DataFrame, entity: str, category: str, period: Column, value: str, arrived: str | None = None) -> DataFrame:
    """Long panel of raw observations: not positive or not finite values are missing, of
    several values of one cell the first to arrive stays (ties: the smallest)."""
    v = F.col(value).cast("double")
    clean = F.when((v > 0) & ~F.isnan(v) & (v < float("inf")), v)
    key = F.struct(F.col(arrived) if arrived else clean, clean)
    return (
        rows.select(F.col(entity).alias("entity"), F.col(category).alias("category"), period.cast("int").alias("t"), clean.alias("v"), key.alias("k"))
        .where("t is not null and v is not null")
        .groupBy(*SERIES, "t").agg(F.min_by("v", "k").alias("v"))
    )


def beside_mean(cells: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """The cells with the mean of ``value`` over ``by`` as ``name``.  The means are aggregated
    map-side and joined (Spark broadcasts them where they are small), so no task holds all
    cells of a group, as a window would."""
    means = cells.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.avg(value).alias(name))
    on = None
    for c in by:
        same = F.col(c) == F.col(f"_{c}")
        on = same if on is None else on & same
    return cells.join(means, on).drop(*[f"_{c}" for c in by])


def complete(panel: DataFrame, periods: int) -> DataFrame:
    """Rows of the series observed in all periods."""
    n = F.count("v").over(Window.partitionBy(*SERIES))
    return panel.withColumn("_n", n).where(F.col("_n") == periods).drop("_n")


def completeness(panel: DataFrame) -> DataFrame:
    """(category, series, complete, cells): series per category, how many lack no period
    of the panel, and observed cells."""
    per = panel.groupBy(*SERIES).agg(F.count("v").alias("n"), F.max("t").alias("last"), F.min("t").alias("first"))
    span = per.agg((F.max("last") - F.min("first") + 1).alias("T"))
    return per.crossJoin(F.broadcast(span)).groupBy("category").agg(
        F.count("*").alias("series"), F.count_if(F.col("n") == F.col("T")).alias("complete"), F.sum("n").alias("cells")
    )


def packed(panel: DataFrame, periods: int, value: str = "v") -> DataFrame:
    """One row per series: (entity, category, v ARRAY<DOUBLE>) with null in gaps."""
    cells = F.map_from_entries(F.collect_list(F.struct("t", value)))
    array = F.transform(F.sequence(F.lit(0), F.lit(periods - 1)), lambda t: F.try_element_at(F.col("_m"), t))
    return panel.groupBy(*SERIES).agg(cells.alias("_m")).select(*SERIES, array.alias("v"))


def grid(panel: DataFrame, periods: int) -> DataFrame:
    """The long panel with a row for every period of every series, null in gaps."""
    return packed(panel, periods).select(*SERIES, F.posexplode("v").alias("t", "v"))


def origins(packed_panel: DataFrame, first: int, last: int) -> DataFrame:
    """A row per series and origin ``o``; whatever follows the origin is cut off ``v``."""
    return packed_panel.select(
        *SERIES, F.explode(F.sequence(F.lit(first), F.lit(last))).alias("o"), "v"
    ).withColumn("v", F.slice("v", 1, F.col("o") + 1))


def shares(panel: DataFrame) -> DataFrame:
    """(category, level, common, residual): shares of the variance of log values between
    series means, the category's common course and the rest; complete panels."""
    p = panel.withColumn("y", F.log("v"))
    p = beside_mean(beside_mean(beside_mean(p, "y", SERIES, "_row"), "y", ["category", "t"], "_col"), "y", ["category"], "_all")
    row, col, all_ = F.col("_row"), F.col("_col"), F.col("_all")
    q = p.select("category", (row - all_).alias("a"), (col - all_).alias("n"), (F.col("y") - row - col + all_).alias("e"))
    total = F.var_pop("a") + F.var_pop("n") + F.var_pop("e")
    return q.groupBy("category").agg(*[(F.var_pop(c) / total).alias(n) for c, n in (("a", "level"), ("n", "common"), ("e", "residual"))])


def yoy_growth(panel: DataFrame) -> DataFrame:
    """(category, growth): mean log change of a series on the same period a year before."""
    w = Window.partitionBy(*SERIES).orderBy("t").rangeBetween(-12, -12)
    p = panel.withColumn("y", F.log("v")).withColumn("g", F.col("y") - F.first("y").over(w))
    return p.groupBy("category").agg(F.avg("g").alias("growth"), F.stddev_samp("g").alias("spread"))


def noise_scale(cells: DataFrame, value: str, floor: float = 1e-4) -> DataFrame:
    """(entity, category, k): robust variance of a series' changes, (1.4826 MAD)^2, at least
    ``floor``; series without a change take the median of the others."""
    w = Window.partitionBy(*SERIES).orderBy("t")
    d = cells.withColumn("d", F.when(F.col("t") - F.lag("t").over(w) == 1, F.col(value) - F.lag(value).over(w)))
    mid = d.groupBy(*SERIES).agg(F.median("d").alias("m"))
    k = (
        d.join(mid, SERIES).groupBy(*SERIES).agg(F.pow(1.4826 * F.median(F.abs(F.col("d") - F.col("m"))), 2).alias("k"))
    )
    rest = k.agg(F.median("k").alias("pool"))
    return k.crossJoin(F.broadcast(rest)).select(*SERIES, F.greatest(F.coalesce("k", "pool"), F.lit(floor)).alias("k"))


def neighbours(edges: DataFrame, k: int) -> DataFrame:
    """(a, b, distance, rank): the k nearest other ends of each node of one-directional
    edges; ties by the smaller neighbour, self-edges dropped."""
    both = edges.select("a", "b", "distance").union(edges.select(F.col("b"), F.col("a"), "distance")).where("a != b")
    w = Window.partitionBy("a").orderBy("distance", "b")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbour_mean(panel: DataFrame, near: DataFrame, value: str) -> DataFrame:
    """(entity, category, t, nb, n): mean of the neighbours' values of the same category."""
    other = panel.select(F.col("entity").alias("b"), "category", "t", F.col(value).alias("x"))
    return near.join(other, "b").groupBy(F.col("a").alias("entity"), "category", "t").agg(F.avg("x").alias("nb"), F.count("x").alias("n"))


def interpolate(cells: DataFrame) -> DataFrame:
    """The grid's values with inner gaps interpolated and trailing ones held; what precedes
    a series' first value is left out."""
    w = Window.partitionBy(*SERIES).orderBy("t")
    seen = F.when(F.col("v").isNotNull(), F.struct("t", "v"))
    j = cells.withColumns({
        "_b": F.last(seen, True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_a": F.first(seen, True).over(w.rowsBetween(0, Window.unboundedFollowing)),
    })
    b, a = F.col("_b"), F.col("_a")
    inner = b["v"] + (a["v"] - b["v"]) * (F.col("t") - b["t"]) / (a["t"] - b["t"])
    return j.where("_b is not null").select(*SERIES, "t", F.when(a.isNull() | (a["t"] == b["t"]), b["v"]).otherwise(inner).alias("v"))
