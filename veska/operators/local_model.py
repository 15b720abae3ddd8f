"""Forecasts and intervals from the state-space model of a panel's own part, and a
gradient-boosted model over lagged features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veska.operators.detect import fit_series
from veska.operators.forecast import KEYS
from veska.operators.kernels import binned, boost_trees, local_filter
from veska.operators.panel import SERIES, origins
from veska.session import cut


def own_parts(seen: DataFrame) -> DataFrame:
    """(o, entity, category, nf, k, z): deviations from the common course in units of each
    series' noise, and the noise; series without a change take the median of the others."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            ks = []
            for v in df["z"]:
                step = np.diff(np.array([np.nan if x is None else x for x in v], float))
                step = step[~np.isnan(step)]
                ks.append((1.4826 * float(np.median(np.abs(step - np.median(step))))) ** 2 if len(step) else None)
            df["k"] = pd.array(ks, dtype="Float64")
            yield df

    kind = seen.schema["entity"].dataType.simpleString()
    z = seen.select(*KEYS, "nf", F.zip_with("v", "n", lambda x, n: x - n).alias("z"))
    known = cut(z.mapInPandas(run, f"o int, entity {kind}, category string, nf array<double>, z array<double>, k double"))
    rest = known.groupBy("category", "o").agg(F.median("k").alias("pool"))  # categories x origins rows
    known = known.join(F.broadcast(rest), ["category", "o"]).withColumn("k", F.greatest(F.coalesce("k", "pool", F.lit(1.0)), F.lit(1e-4)))
    return known.select(*KEYS, "nf", "k", F.transform("z", lambda x: x / F.sqrt("k")).alias("z"))


def panel_ssm(packed_logs: DataFrame, trajectory: DataFrame, first: int, last: int, horizon: int, boosts: DataFrame | None = None) -> DataFrame:
    """Level plus AR(1) around the common course: (model, o, entity, category, h, f, var),
    ``var`` the variance of the own part's forecast in logs.  ``boosts`` (o, entity, q ARRAY up
    to o) raise the variance of the level's steps where events known at the origin fall.  A series without a reading up
    to the origin has no forecast.  ``trajectory``: (category, o, n, nf)."""
    seen = origins(packed_logs, first, last).join(F.broadcast(trajectory), ["category", "o"])
    parts = own_parts(seen)
    if boosts is not None:
        parts = parts.join(boosts, ["o", "entity"], "left").withColumn("q", F.coalesce("q", F.transform("z", lambda _: F.lit(1.0))))
    fitted = fit_series(parts, ["category", "o"])
    h = np.arange(1, horizon + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for _, g in df.groupby(["category", "o"]):
                z = np.array([[np.nan if x is None else x for x in v] for v in g["z"]], float)
                k = g["k"].to_numpy()
                lam, phi, scale = g["lam"].iloc[0], g["phi"].iloc[0], g["scale"].iloc[0]
                s = local_filter(z, lam, phi, np.array(g["q"].tolist(), float) if "q" in g else None)
                root = np.sqrt(k)[:, None]
                path = np.array(g["nf"].tolist()) + root * s["m0"][:, None] + phi**h * root * s["m1"][:, None]
                var = s["p00"][:, None] + 2 * phi**h * s["p01"][:, None] + phi ** (2 * h) * s["p11"][:, None]
                var = scale * k[:, None] * (var + lam * h + (1 - phi ** (2 * h)) / max(1 - phi**2, 1e-6))
                begun = ~np.isnan(z).all(axis=1)
                part = g[["o", *SERIES]].copy()
                part["fs"] = [np.exp(p).tolist() if b else [None] * horizon for p, b in zip(path, begun)]
                part["vs"] = [v.tolist() if b else [None] * horizon for v, b in zip(var, begun)]
                out.append(part)
            if out:
                yield pd.concat(out)

    kind = packed_logs.schema["entity"].dataType.simpleString()
    got = parts.join(F.broadcast(fitted), ["category", "o"]).mapInPandas(run, f"o int, entity {kind}, category string, fs array<double>, vs array<double>")
    each = got.select(*KEYS, F.posexplode(F.arrays_zip("fs", "vs")).alias("h", "x"))
    return each.select(F.lit("panel_ssm" if boosts is None else "panel_ssm_news").alias("model"), *KEYS, (F.col("h") + 1).alias("h"), F.col("x.fs").alias("f"), F.col("x.vs").alias("var"))


def with_intervals(forecasts: DataFrame, course_mse: DataFrame, mapping: DataFrame, level: float) -> DataFrame:
    """Forecasts with ``lo`` and ``hi``: lognormal, own variance plus the mean squared error
    of the common course known at the origin.  ``course_mse``: (series, o, h, mse)."""
    from veska.operators.evaluate import lognormal_interval

    j = forecasts.join(F.broadcast(mapping), "category").join(F.broadcast(course_mse), ["series", "o", "h"])
    lo, hi = lognormal_interval(F.col("f"), F.sqrt(F.col("var") + F.col("mse")), level)
    return j.withColumns({"lo": lo, "hi": hi})


NEWS = ["news", "news_own"]
FEATURES = ["z0", "z1", "z2", "z12", "dz1", "dz3", "nb_dz1", "nb_dz3", "level", "ma", "nobs", "h", "moy"]


def boosted_features(packed_logs: DataFrame, trajectory: DataFrame, access: DataFrame, near: DataFrame, first: int, last: int, news: DataFrame | None = None) -> DataFrame:
    """What the boosted model knows of a series at period t as seen from origin o >= t: (o,
    entity, category, t, FEATURES without h and moy; y, n, v, nf).  z are deviations from
    the course and the series' own mean up to o, nb_ the mean changes of the neighbours in
    the category.  ``access``: (entity, ma); ``near``: (a, b) of neighbours; ``news``: (entity,
    t, s, own) surprises, which give the columns NEWS."""
    seen = origins(packed_logs, first, last).join(F.broadcast(trajectory), ["category", "o"])  # categories x origins rows
    own = F.filter(F.zip_with("v", "n", lambda x, n: x - n), lambda x: x.isNotNull())
    level = F.aggregate(own, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(own), F.lit(0))
    seen = seen.withColumn("level", level).where("level is not null")
    seen = seen.withColumn("z", F.zip_with("v", "n", lambda x, n: x - n - F.col("level")))
    back = lambda k: F.get("z", F.col("t") - k)
    cells = seen.withColumn("t", F.explode(F.sequence(F.lit(3), F.col("o")))).withColumns({
        "z0": back(0), "z1": back(1), "z2": back(2), "z12": back(12), "dz1": back(0) - back(1), "dz3": back(0) - back(3),
        "nobs": F.size(F.filter(F.slice("z", 1, F.col("t") + 1), lambda x: x.isNotNull())),
    })
    other = cells.select(F.col("entity").alias("b"), "category", "o", "t", "dz1", "dz3")
    nb = near.select("a", "b").join(other, "b").groupBy(F.col("a").alias("entity"), "category", "o", "t").agg(F.avg("dz1").alias("nb_dz1"), F.avg("dz3").alias("nb_dz3"))
    out = cells.drop("z").join(nb, [*KEYS, "t"], "left").join(access.select("entity", "ma"), "entity", "left")
    if news is None:
        return out
    told = news.select("entity", "t", F.col("s").alias("news"), F.col("own").cast("double").alias("news_own"))
    return out.join(told, ["entity", "t"], "left")


def boosted(features: DataFrame, horizon: int, start_month: int, trees: int = 400, name: str = "boosted") -> DataFrame:
    """Direct forecasts for all steps by gradient-boosted trees under absolute loss, one model
    per origin: (model, o, entity, category, h, f).  ``features``: of ``boosted_features``.

    Rows to learn from pair each period t < o with steps t + h <= o; the target is the
    change of the log value less that of the common course.  One task learns an origin's
    model and holds its pairs, about 100 bytes each; all pairs are used.
    """
    steps = features.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("moy", (F.col("t") + F.col("h") + start_month) % 12)
    at = F.col("t") + F.col("h")
    change = F.get("v", at) - F.get("v", "t") - F.get("n", at) + F.get("n", "t")
    steps = steps.withColumn("label", F.when(F.col("t") < F.col("o"), change)).where("t = o or label is not null")
    last = F.try_element_at(F.filter("v", lambda x: x.isNotNull()), F.lit(-1))
    base = F.when(F.col("t") == F.col("o"), last + F.get("nf", F.col("h") - 1) - F.get("n", "o"))
    kinds = sorted(r["category"] for r in features.select("category").distinct().collect())  # one row per category
    cat = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("category"))
    used = [*FEATURES, *[c for c in NEWS if c in features.columns]]
    numbers = ["cat", *used, "label", "base"]
    rows = steps.withColumns({"cat": cat, "base": base}).select(*KEYS, "t", "h", *[F.col(c).cast("float" if c in used else "double").alias(f"x_{c}") for c in numbers])
    # Rows of an origin come in one order, so that the subsamples of a run come again in the next.
    many = features.select("o").distinct().count()
    rows = rows.repartitionByRange(max(many, 1), "o").sortWithinPartitions("o", *SERIES, "t", "h")

    def learned(parts: list[pd.DataFrame], ends: list[pd.DataFrame]) -> pd.DataFrame:
        column = lambda c: np.concatenate([p[f"x_{c}"].to_numpy() for p in parts])
        y = column("label")
        x = np.stack([column("cat").astype(np.uint8), *[binned(column(c), ~np.isnan(y)) for c in used]], axis=1)
        got, base = boost_trees(x, y, 1, trees), column("base")
        now = ~np.isnan(base)
        return pd.concat(ends).assign(f=np.exp(got[now] + base[now]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, ends, o = [], [], None
        for df in batches:
            for key, g in df.groupby("o", sort=True):
                if key != o and parts:
                    yield learned(parts, ends)
                    parts, ends = [], []
                o = key
                parts.append(g[[f"x_{c}" for c in numbers]])
                ends.append(g.loc[g["x_base"].notna(), [*KEYS, "h"]])
        if parts:
            yield learned(parts, ends)

    kind = features.schema["entity"].dataType.simpleString()
    out = rows.mapInPandas(run, f"o int, entity {kind}, category string, h int, f double")
    return out.select(F.lit(name).alias("model"), *KEYS, "h", "f")
