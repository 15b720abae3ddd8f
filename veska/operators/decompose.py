"""Common course and own part of a panel, and forecasts of the common course.

Time effects are small (categories x periods); what is joined against them is the panel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veska.operators.kernels import airline, two_way
from veska.operators.panel import SERIES, beside_mean
from veska.session import cut


def course(panel: DataFrame, first: int, last: int) -> DataFrame:
    """(category, o, t, n): common course of complete panels as seen at each origin, of mean
    zero up to it.  Alternating means are exact after one step there: the period means less
    the mean of all."""
    by_t = panel.groupBy("category", "t").agg(F.avg(F.log("v")).alias("m"))
    at = by_t.withColumn("o", F.explode(F.sequence(F.lit(first), F.lit(last)))).where("t <= o")
    return at.select("category", "o", "t", (F.col("m") - F.avg("m").over(Window.partitionBy("category", "o"))).alias("n"))


def course_unbalanced(panel: DataFrame, periods: int, rounds: int = 30, tolerance: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """(entity, category, a) and (category, t, n) where series have gaps: alternating means
    until no course moves by more than ``tolerance``, ``rounds`` at most; each round is one
    aggregation by series and one by period.  The course (categories x
    periods) is small enough to travel with the plan; the panel itself is never gathered."""
    spark = panel.sparkSession
    p = cut(panel.where("v is not null").select(*SERIES, "t", F.log("v").alias("y")))
    n = {(r["category"], r["t"]): r["n"] for r in p.groupBy("category", "t").agg(F.avg("y").alias("n")).collect()}
    schema = "category string, t int, n double"
    frame = lambda d: spark.createDataFrame([(k[0], k[1], v) for k, v in d.items()], schema)
    effects = lambda d: p.join(F.broadcast(frame(d)), ["category", "t"]).groupBy(*SERIES).agg(F.avg(F.col("y") - F.col("n")).alias("a"))
    for _ in range(rounds):
        step = p.join(effects(n), SERIES).groupBy("category", "t").agg(F.avg(F.col("y") - F.col("a")).alias("n"))
        before, n = n, {(r["category"], r["t"]): r["n"] for r in step.collect()}  # categories x periods rows
        if max((abs(n[k] - before[k]) for k in n), default=0.0) <= tolerance:
            break
    a = effects(n)
    shift: dict = {}
    for (c, _), x in n.items():
        shift.setdefault(c, []).append(x)
    means = spark.createDataFrame([(c, sum(x) / len(x)) for c, x in shift.items()], "category string, shift double")
    return (
        a.join(F.broadcast(means), "category").select(*SERIES, (F.col("a") + F.col("shift")).alias("a")),
        frame(n).join(F.broadcast(means), "category").select("category", "t", (F.col("n") - F.col("shift")).alias("n")),
    )


def seasonal_factors(series: DataFrame, start_month: int, cutoffs: DataFrame, skip_years: tuple[int, ...] = (), start_year: int = 1995) -> DataFrame:
    """(series, o, moy, s): classical factors of log series by calendar month (0-11): the
    median over years of the deviation from a centred 2 x 12 moving average, known at
    period ``upto`` of each cutoff (o, upto), centred.  ``series``: (series, t, x)."""
    w = Window.partitionBy("series").orderBy("t")
    lo, hi = w.rowsBetween(-6, 5), w.rowsBetween(-5, 6)
    full = (F.count("x").over(lo) == 12) & (F.count("x").over(hi) == 12)
    dev = series.withColumn("d", F.when(full, F.col("x") - (F.avg("x").over(lo) + F.avg("x").over(hi)) / 2)).where("d is not null")
    dev = dev.withColumn("year", F.floor((F.col("t") + start_month) / 12) + start_year)
    if skip_years:
        dev = dev.where(~F.col("year").isin(*skip_years))
    known = dev.join(F.broadcast(cutoffs), F.col("t") + 6 <= F.col("upto"))
    f = known.groupBy("series", "o", ((F.col("t") + start_month) % 12).alias("moy")).agg(F.median("d").alias("m"))
    return f.select("series", "o", "moy", (F.col("m") - F.avg("m").over(Window.partitionBy("series", "o"))).alias("s"))


def growth(course_: DataFrame, series: DataFrame, mapping: DataFrame, offset: int) -> DataFrame:
    """(category, o, g): yearly growth at each origin: the last three months of the outside
    series over the same months a year before, averaged with the panel's own where it is
    long enough.  ``offset`` is the outside period of the panel's period 0."""
    pick = lambda t, a, b: F.avg(F.when(F.col("k").between(a, b), F.col(t)))
    os = course_.select("category", "o").distinct().join(F.broadcast(mapping), _mapped(mapping))
    ext = os.join(series, "series").withColumn("k", F.col("t") - F.col("o") - offset).groupBy("category", "o").agg((pick("x", -2, 0) - pick("x", -14, -12)).alias("ge"))
    own = course_.withColumn("k", F.col("t") - F.col("o")).groupBy("category", "o").agg((pick("n", -2, 0) - pick("n", -14, -12)).alias("gp"))
    return ext.join(own, ["category", "o"]).select("category", "o", F.when(F.col("o") >= 14, (F.col("ge") + F.col("gp")) / 2).otherwise(F.col("ge")).alias("g"))


def _mapped(mapping: DataFrame) -> list[str]:
    """Keys of a mapping: of categories, or of categories at each origin."""
    return ["category", "o"] if "o" in mapping.columns else ["category"]


def course_rules(course_: DataFrame, g: DataFrame, factors: DataFrame, mapping: DataFrame, horizon: int, start_month: int) -> DataFrame:
    """(category, o, h, snaive, hybrid, extlvl): forecasts of the common course by three
    rules.  ``factors``: (series, o, moy, s); ``start_month``: calendar month of period 0."""
    n_map = course_.groupBy("category", "o").agg(F.map_from_entries(F.collect_list(F.struct("t", "n"))).alias("n"))
    sf = factors.groupBy("series", "o").agg(F.map_from_entries(F.collect_list(F.struct("moy", "s"))).alias("sf"))
    base = n_map.join(g, ["category", "o"]).join(F.broadcast(mapping), _mapped(mapping)).join(sf, ["series", "o"])
    n = lambda t: F.try_element_at("n", t.cast("int"))
    s = lambda t: F.try_element_at("sf", ((t + start_month) % 12).cast("int"))
    o, gg = F.col("o"), F.col("g")
    recent = (n(o) - s(o) + n(o - 1) - s(o - 1) + n(o - 2) - s(o - 2)) / 3
    base = base.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    h = F.col("h")
    at = o + h - 12
    snaive = F.when(at.between(0, o), n(at) + gg).otherwise(n(o) + gg * h / 12)
    seasonal = F.when((o >= 12) & (at <= o), n(at) - n(o - 12) - (n(o) - n(o - 12)) * h / 12).otherwise(s(o + h) - s(o))
    return base.select(
        "category", "o", "h", snaive.alias("snaive"), (n(o) + seasonal + gg * h / 12).alias("hybrid"),
        (recent + gg / 12 + gg * h / 12 + s(o + h)).alias("extlvl"),
    )


def airline_rule(course_: DataFrame, series: DataFrame, mapping: DataFrame, offset: int, horizon: int, start: int = 0) -> DataFrame:
    """(category, o, h, airline): the course's last value plus the change that a seasonal
    moving-average model forecasts for the outside series."""
    last = course_.where("t = o").join(F.broadcast(mapping), "category").select("category", "series", "o", "n")
    seen = last.join(series, "series").where((F.col("t") <= F.col("o") + offset) & (F.col("t") >= start))
    packed = seen.groupBy("category", "o", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda x: x["x"]).alias("xs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            df["f"] = [(n + airline(np.array(x), horizon) - x[-1]).tolist() for n, x in zip(df["n"], df["xs"])]
            yield df[["category", "o", "f"]]

    out = packed.mapInPandas(run, "category string, o int, f array<double>")
    return out.select("category", "o", F.posexplode("f").alias("h", "airline")).withColumn("h", F.col("h") + 1)


def choose_external(course_: DataFrame, series: DataFrame, offset: int) -> DataFrame:
    """(category, o, series, rmse): the outside series whose monthly changes come nearest to
    the course's up to each origin; ties by name."""
    wn, wx = Window.partitionBy("category", "o").orderBy("t"), Window.partitionBy("series").orderBy("t")
    dn = course_.select("category", "o", "t", (F.col("n") - F.lag("n").over(wn)).alias("dn")).where("dn is not null")
    dx = series.select("series", (F.col("t") - offset).alias("t"), (F.col("x") - F.lag("x").over(wx)).alias("dx"))
    e = dn.join(dx, "t").groupBy("category", "o", "series").agg(F.sqrt(F.avg(F.pow(F.col("dn") - F.col("dx"), 2))).alias("rmse"))
    best = e.groupBy("category", "o").agg(F.min(F.struct("rmse", "series")).alias("b"))
    return best.select("category", "o", F.col("b.series").alias("series"), F.col("b.rmse").alias("rmse"))


def regional(panel: DataFrame, regions: DataFrame) -> DataFrame:
    """(category, share): share of the residual variance that regions have in common.
    ``regions``: (entity, region)."""
    r = _regional(panel, regions)
    return r.groupBy("category").agg((F.var_pop("r") / F.var_pop("z")).alias("share"))


def regional_course(panel: DataFrame, regions: DataFrame) -> DataFrame:
    """(entity, category, t, r): the mean of a series' region and category of what neither
    the series' level nor the common course explains; complete panels."""
    return _regional(panel, regions).select(*SERIES, "t", "r")


def _regional(panel: DataFrame, regions: DataFrame) -> DataFrame:
    p = panel.withColumn("y", F.log("v")).join(regions, "entity")
    p = beside_mean(beside_mean(beside_mean(p, "y", SERIES, "_row"), "y", ["category", "t"], "_col"), "y", ["category"], "_all")
    z = p.select(*SERIES, "region", "t", (F.col("y") - F.col("_row") - F.col("_col") + F.col("_all")).alias("z"))
    return beside_mean(z, "z", ["category", "region", "t"], "r")


def growth_regression(series: DataFrame) -> DataFrame:
    """(series, slope, intercept, r2): yearly growth of 12-month sums on the growth a year
    before.  ``series``: (series, t, x) with logs in x."""
    w = Window.partitionBy("series").orderBy("t")
    s12 = series.withColumn("s", F.when(F.count("x").over(w.rowsBetween(-11, 0)) == 12, F.log(F.sum(F.exp("x")).over(w.rowsBetween(-11, 0)))))
    g = s12.withColumn("g", F.col("s") - F.lag("s", 12).over(w))
    pair = g.withColumn("g1", F.lag("g", 12).over(w)).where("g is not null and g1 is not null")
    return pair.groupBy("series").agg(F.regr_slope("g", "g1").alias("slope"), F.regr_intercept("g", "g1").alias("intercept"), F.regr_r2("g", "g1").alias("r2"))


def two_way_by_category(packed_panel: DataFrame) -> DataFrame:
    """Alternating means in numpy for one bounded category: for tests and small panels."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        y = np.log(np.array([[np.nan if x is None else x for x in v] for v in df["v"]], float))
        a, _ = two_way(y)
        return pd.DataFrame({"entity": df["entity"], "category": df["category"], "a": a})

    kind = packed_panel.schema["entity"].dataType.simpleString()
    return packed_panel.groupBy("category").applyInPandas(run, f"entity {kind}, category string, a double")
