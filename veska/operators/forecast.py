"""Rolling-origin forecasts: (model, o, entity, category, h, f), null where a series has
not begun.  A model sees a series up to its origin only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veska.operators.panel import SERIES, origins

KEYS = ["o", *SERIES]


def _steps(df: DataFrame, horizon: int) -> DataFrame:
    return df.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))


def _last(v: str = "v") -> Column:
    return F.try_element_at(F.filter(v, lambda x: x.isNotNull()), F.lit(-1))


def naive(packed_panel: DataFrame, first: int, last: int, horizon: int) -> DataFrame:
    """The last observed level, however old."""
    seen = origins(packed_panel, first, last).select(*KEYS, _last().alias("f"))
    return _steps(seen, horizon).select(F.lit("naive").alias("model"), *KEYS, "h", "f")


def seasonal_naive(packed_panel: DataFrame, first: int, last: int, horizon: int) -> DataFrame:
    """The value a year before the target, else the last observed level."""
    seen = _steps(origins(packed_panel, first, last).withColumn("last", _last()), horizon)
    at = F.col("o") + F.col("h") - 12
    year_ago = F.when(at >= 0, F.get("v", at))
    return seen.select(F.lit("seasonal_naive").alias("model"), *KEYS, "h", F.coalesce(year_ago, "last").alias("f"))


def panel_seasonal(packed_logs: DataFrame, trajectory: DataFrame, first: int, last: int, horizon: int, rho: float = 0.6) -> DataFrame:
    """Own deviation decaying from the last one to last year's: with z = y - a - n,
    rho^h z_last + (1 - rho^h) z[o + h - 12], added to the series' level and the common
    trajectory.  ``trajectory``: (category, o, n ARRAY up to o, nf ARRAY of the horizon).
    For complete panels: a series' level is its mean up to the origin.
    """
    seen = origins(packed_logs, first, last).join(F.broadcast(trajectory), ["category", "o"])  # categories x origins rows
    a = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))) / F.size(F.filter("v", lambda x: x.isNotNull()))
    z = F.zip_with("v", "n", lambda x, n: x - n - F.col("a"))
    seen = seen.withColumn("a", a).withColumn("z", z)
    w, at = F.pow(F.lit(rho), F.col("h")), F.col("o") + F.col("h") - 12
    own = F.coalesce(_last("z"), F.lit(0.0))
    year_ago = F.when(at >= 0, F.get("z", at))
    path = F.coalesce(w * own + (1 - w) * year_ago, w * own)
    f = F.when(F.size(F.filter("v", lambda x: x.isNotNull())) > 0, F.exp(F.col("a") + F.get("nf", F.col("h") - 1) + path))
    return _steps(seen, horizon).select(F.lit("panel_seasonal").alias("model"), *KEYS, "h", f.alias("f"))


def ensemble(forecasts: DataFrame, members: list[str]) -> DataFrame:
    """Equal-weight geometric mean of the members, null where any of them is."""
    f = forecasts.where(F.col("model").isin(members)).groupBy(*KEYS, "h").agg(F.count("f").alias("n"), F.exp(F.avg(F.log("f"))).alias("f"))
    return f.select(F.lit("ensemble").alias("model"), *KEYS, "h", F.when(F.col("n") == len(members), F.col("f")).alias("f"))


def seasonal_wrapper(packed_panel: DataFrame, seasonal: DataFrame, model: Callable[[DataFrame], DataFrame], start_month: int) -> DataFrame:
    """Any model on deseasonalised values: divide by exp(factor of the calendar month),
    forecast, multiply back.  ``seasonal``: (moy 0-11, s), twelve rows."""
    factors = seasonal.agg(F.map_from_entries(F.collect_list(F.struct("moy", "s"))).alias("sf"))
    at = lambda t: F.try_element_at("sf", ((t + start_month) % 12).cast("int"))
    flat = packed_panel.crossJoin(F.broadcast(factors)).select(*SERIES, F.transform("v", lambda x, t: x / F.exp(at(t))).alias("v"))
    out = model(flat).crossJoin(F.broadcast(factors))
    return out.withColumn("f", F.col("f") * F.exp(at(F.col("o") + F.col("h")))).drop("sf")


#: Models by name: functions of (packed panel, first origin, last origin, horizon).
MODELS: dict[str, Callable[..., DataFrame]] = {"naive": naive, "seasonal_naive": seasonal_naive}


def register(name: str, model: Callable[..., DataFrame]) -> None:
    MODELS[name] = model


def provider(name: str, predict: Callable[[list[list[float]], int], list[list[float]]], local: bool = False) -> Callable[..., DataFrame]:
    """A model from an outside library: ``predict(contexts, horizon)`` gets trimmed series
    without gaps (leading ones cut off, inner ones interpolated, the last value held) and
    gives one list of levels each.  The library is imported by ``predict`` on the
    executors; a missing one raises there, nothing is made up instead."""
    from veska.operators.kernels import trimmed

    def model(packed_panel: DataFrame, first: int, last: int, horizon: int) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in batches:
                contexts = [trimmed(v) for v in df["v"]]
                df["fs"] = [f if len(c) else [None] * horizon for c, f in zip(contexts, predict(contexts, horizon))]
                yield df[["o", "entity", "category", "fs"]]

        seen = origins(packed_panel, first, last)
        kind = seen.schema["entity"].dataType.simpleString()
        out = seen.mapInPandas(run, f"o int, entity {kind}, category string, fs array<double>")
        return out.select(F.lit(name).alias("model"), *KEYS, F.posexplode("fs").alias("h", "f")).withColumn("h", F.col("h") + 1)

    return model


def freeze(forecasts: DataFrame) -> DataFrame:
    """(category, rows, sha): count and SHA-256 over the canonical rows of a forecast, each
    rounded to one decimal.  Rows are hashed where they lie and digests summed up as a tree:
    per series, per range of 4,096 of the entities' hashes, per category."""
    joined = lambda order, value: F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])), 256)
    row = F.concat_ws("|", "entity", "category", "h", F.format_string("%.1f", F.round("f", 1)))
    per = forecasts.where("f is not null").select("entity", "category", "h", row.alias("r")).groupBy("entity", "category").agg(F.count("*").alias("n"), joined("h", "r").alias("s"))
    part = per.groupBy("category", F.substring(F.md5(F.col("entity").cast("string")), 1, 3).alias("p")).agg(F.sum("n").alias("n"), joined("entity", "s").alias("s"))
    by = part.groupBy("category").agg(F.sum("n").alias("n"), joined("p", "s").alias("s"))
    return by.select("category", F.col("n").alias("rows"), F.col("s").alias("sha"))


def lag_features(cells: DataFrame, value: str) -> DataFrame:
    """Lags and changes of a complete panel's values: z0, z1, z2, z12, dz1, dz3, ma, nobs."""
    w = Window.partitionBy(*SERIES).orderBy("t")
    lag = lambda k: F.lag(value, k).over(w)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return cells.select(
        *SERIES, "t", F.col(value).alias("z0"), lag(1).alias("z1"), lag(2).alias("z2"), lag(12).alias("z12"),
        (F.col(value) - lag(1)).alias("dz1"), (F.col(value) - lag(3)).alias("dz3"),
        F.avg(value).over(run).alias("ma"), F.count(value).over(run).alias("nobs"),
    )
