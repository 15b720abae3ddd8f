"""Online detectors of level shifts and their evaluation.

Scores are long: (entity, category, t, s); an alarm is a score above a threshold.
Recursions over time are folds over one series' array, so series never move.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veska.operators.kernels import DIFFUSE, local_filter, local_sums, run_length_scores, segmentation_scores
from veska.operators.panel import SERIES, beside_mean, neighbour_mean, noise_scale, packed
from veska.session import cut


def _own(panel: DataFrame, ref: int) -> DataFrame:
    """Log values less the category's mean of the same period."""
    y = panel.select(*SERIES, "t", F.log("v").alias("y"))
    return beside_mean(y, "y", ["category", "t"], "_n").select(*SERIES, "t", (F.col("y") - F.col("_n")).alias("l"))


def _normal(cells: DataFrame, ref: int) -> DataFrame:
    """(entity, category, t, z): centred on the first ``ref`` periods, in units of the noise
    of those."""
    k = noise_scale(cells.where(F.col("t") < ref), "l")
    mean = F.avg(F.when(F.col("t") < ref, F.col("l"))).over(Window.partitionBy(*SERIES))
    return cells.withColumn("m", mean).join(k, SERIES).select(*SERIES, "t", ((F.col("l") - F.col("m")) / F.sqrt("k")).alias("z"))


def prepare(panel: DataFrame, ref: int) -> DataFrame:
    """Complete series against their category, in units of their own noise."""
    return _normal(_own(panel, ref), ref)


def prepare_relative(panel: DataFrame, near: DataFrame, ref: int) -> DataFrame:
    """Complete series against the mean of their neighbours, likewise; without neighbours
    there is no row."""
    own = _own(panel, ref)
    mean = F.avg(F.when(F.col("t") < ref, F.col("l"))).over(Window.partitionBy(*SERIES))
    own = own.withColumn("l", F.col("l") - mean)
    other = neighbour_mean(own, near, "l")
    return _normal(own.join(other, [*SERIES, "t"]).select(*SERIES, "t", (F.col("l") - F.col("nb")).alias("l")), ref)


def cusum(z: DataFrame, periods: int, slack: float = 0.5, warm: int = 8) -> DataFrame:
    """Page's two-sided sums on AR(1) residuals; the autoregression is pooled over the
    first ``warm`` periods, residuals are in units of their deviation there."""
    p = packed(z, periods, "z").withColumn("e", F.transform("v", lambda x, t: F.struct(x.alias("x"), F.get("v", t - 1).alias("b"))))
    fold = lambda g: F.aggregate(F.slice("e", 2, warm - 1), F.lit(0.0), lambda s, x: s + F.coalesce(g(x), F.lit(0.0)))
    rho = p.agg((F.sum(fold(lambda x: x["x"] * x["b"])) / F.sum(fold(lambda x: F.when(x["x"].isNotNull(), x["b"] * x["b"])))).alias("rho"))
    p = p.crossJoin(F.broadcast(rho)).withColumn("r", F.transform("e", lambda x: x["x"] - F.col("rho") * x["b"]))
    seen = F.filter(F.slice("r", 2, warm - 1), lambda x: x.isNotNull())
    mean = F.aggregate(seen, F.lit(0.0), lambda s, x: s + x) / F.size(seen)
    p = p.withColumn("mu", mean).withColumn("sd", F.sqrt(F.aggregate(seen, F.lit(0.0), lambda s, x: s + (x - F.col("mu")) * (x - F.col("mu"))) / F.size(seen)))
    pool = p.agg(F.median("sd").alias("pool"))
    p = p.crossJoin(F.broadcast(pool)).withColumn("sd", F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.col("pool")))
    zero = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.array().cast("array<double>").alias("s"))

    def step(a: Column, x: Column) -> Column:
        up = F.when(x.isNull(), a["up"]).otherwise(F.greatest(F.lit(0.0), a["up"] + x - slack))
        down = F.when(x.isNull(), a["down"]).otherwise(F.greatest(F.lit(0.0), a["down"] - x - slack))
        return F.struct(up.alias("up"), down.alias("down"), F.concat(a["s"], F.array(F.greatest(up, down))).alias("s"))

    tail = F.transform(F.slice("r", warm + 1, periods), lambda x: x / F.col("sd"))
    scores = F.concat(F.array_repeat(F.lit(0.0), warm), F.aggregate(tail, zero, step, lambda a: a["s"]))
    return p.select(*SERIES, F.posexplode(scores).alias("t", "s"))


def local_states(z: DataFrame, periods: int, lam: float, phi: float) -> DataFrame:
    """Kalman filter with given parameters as a fold: one row per series with the last
    state m0, m1, p00, p01, p11 and the innovations ``v`` and their variances ``f`` (null
    at gaps and at the first observation)."""
    none = F.lit(None).cast("double")
    zero = F.struct(
        F.lit(0.0).alias("m0"), F.lit(0.0).alias("m1"), F.lit(DIFFUSE).alias("p00"), F.lit(0.0).alias("p01"),
        F.lit(1 / max(1 - phi * phi, 1e-3)).alias("p11"), F.lit(False).alias("begun"), F.lit(0).alias("t"),
        F.array().cast("array<double>").alias("v"), F.array().cast("array<double>").alias("f"),
    )

    def predict(a: Column) -> Column:
        later = a["t"] > 0
        return F.struct(
            a["m0"].alias("m0"), F.when(later, phi * a["m1"]).otherwise(a["m1"]).alias("m1"),
            F.when(later, a["p00"] + lam).otherwise(a["p00"]).alias("p00"), F.when(later, phi * a["p01"]).otherwise(a["p01"]).alias("p01"),
            F.when(later, phi * phi * a["p11"] + 1).otherwise(a["p11"]).alias("p11"),
        )

    def gained(q: Column) -> Column:
        return F.struct(q.alias("q"), (q["p00"] + 2 * q["p01"] + q["p11"]).alias("var"), (q["p00"] + q["p01"]).alias("a"), (q["p01"] + q["p11"]).alias("b"))

    # An array of one element holds each intermediate result, so that it is computed once.
    let = lambda value, f: F.get(F.transform(F.array(value), f), 0)

    def step(s: Column, x: Column) -> Column:
        def update(g: Column) -> Column:
            q, var, a, b = g["q"], g["var"], g["a"], g["b"]
            err, here, told = x - q["m0"] - q["m1"], x.isNotNull(), x.isNotNull() & s["begun"]
            pick = lambda new, old: F.when(here, new).otherwise(old)
            return F.struct(
                pick(q["m0"] + a / var * err, q["m0"]).alias("m0"), pick(q["m1"] + b / var * err, q["m1"]).alias("m1"),
                pick(q["p00"] - a * a / var, q["p00"]).alias("p00"), pick(q["p01"] - a * b / var, q["p01"]).alias("p01"),
                pick(q["p11"] - b * b / var, q["p11"]).alias("p11"), (s["begun"] | here).alias("begun"), (s["t"] + 1).alias("t"),
                F.concat(s["v"], F.array(F.when(told, err).otherwise(none))).alias("v"), F.concat(s["f"], F.array(F.when(told, var).otherwise(none))).alias("f"),
            )

        return let(predict(s), lambda q: let(gained(q), update))

    p = packed(z, periods, "z").withColumn("k", F.aggregate("v", zero, step))
    return p.select(*SERIES, *[F.col(f"k.{c}").alias(c) for c in ("m0", "m1", "p00", "p01", "p11", "v", "f")])


def likelihood(states: DataFrame, by: list[str]) -> DataFrame:
    """(by, scale, loss, nobs): concentrated scale and -2 log likelihood of all series."""
    e = states.select(*by, F.explode(F.arrays_zip("v", "f")).alias("x")).where("x.v is not null")
    g = e.groupBy(*by).agg(F.count("*").alias("nobs"), F.sum(F.col("x.v") * F.col("x.v") / F.col("x.f")).alias("ss"), F.sum(F.log("x.f")).alias("ld"))
    return g.select(*by, (F.col("ss") / F.col("nobs")).alias("scale"), (F.col("nobs") * F.log(F.col("ss") / F.col("nobs")) + F.col("ld")).alias("loss"), "nobs")


def step_gains(periods: int, lam: float, phi: float, window: int, warm: int) -> list[tuple[int, int, float, float]]:
    """(tau, u, vx/F, sum of vx^2/F up to u) of a unit step at tau, for u in its window: the
    filter's weights do not depend on the data of complete series."""
    rows = []
    for tau in range(warm, periods):
        k = local_filter((np.arange(periods) >= tau).astype(float)[None, :], lam, phi)
        v, f = np.nan_to_num(k["v"][0]), np.where(np.isnan(k["f"][0]), 1.0, k["f"][0])
        rows += [(tau, u, float(v[u] / f[u]), float((v[: u + 1] ** 2 / f[: u + 1]).sum())) for u in range(tau, min(tau + window, periods))]
    return rows


def step_ratio(z: DataFrame, periods: int, lam: float, phi: float, window: int = 3, warm: int = 6) -> DataFrame:
    """Likelihood ratio of a level step in the last ``window`` periods, in units of the scale
    pooled over the category (complete series)."""
    states = local_states(z, periods, lam, phi)
    scale = likelihood(states, ["category"]).select("category", "scale")
    gains = z.sparkSession.createDataFrame(step_gains(periods, lam, phi, window, warm), "tau int, t int, w double, den double")
    v = states.select(*SERIES, F.posexplode("v").alias("t", "v"))
    hit = v.join(F.broadcast(gains), "t").join(F.broadcast(scale), "category")  # periods x window rows
    num = F.sum(F.coalesce(F.col("v"), F.lit(0.0)) * F.col("w")).over(Window.partitionBy(*SERIES, "tau").orderBy("t"))
    lr = hit.select(*SERIES, "t", F.when(F.col("den") > 1e-9, num * num / F.col("den") / F.col("scale")).otherwise(0.0).alias("lr"))
    best = lr.groupBy(*SERIES, "t").agg(F.max("lr").alias("s"))
    return v.select(*SERIES, "t").join(best, [*SERIES, "t"], "left").select(*SERIES, "t", F.coalesce("s", F.lit(0.0)).alias("s"))


def fit_series(series: DataFrame, by: list[str], finest: float = 5e-4) -> DataFrame:
    """(by, lam, phi, scale, loss): maximum likelihood per group from all its series, by a grid
    over ln lam and atanh phi that closes in on each group's best point.  ``series``: (by, z
    ARRAY and, where the level's variance is raised in some periods, q ARRAY); each round is one pass that sums the evidence where the series lie."""
    spark, series = series.sparkSession, cut(series.select(*by, "z", *[c for c in ("q",) if c in series.columns]))
    keys = ", ".join(f"{c} {series.schema[c].dataType.simpleString()}" for c in by)
    most = 40

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for key, g in df.groupby(by):
                z = np.array([[np.nan if x is None else x for x in v] for v in g["z"]], float)
                q = np.array(g["q"].tolist(), float) if "q" in g else None
                k, ss, ld = local_sums(z, np.exp(np.array(g["xs"].iloc[0])), np.tanh(np.array(g["es"].iloc[0])), q)
                yield pd.DataFrame([(*key, k, ss.tolist(), ld.tolist())], columns=[*by, "k", "ss", "ld"])

    def best(points: dict[tuple, np.ndarray]) -> dict[tuple, tuple[np.ndarray, float, float]]:
        tried = spark.createDataFrame([(*key, p[:, 0].tolist(), p[:, 1].tolist()) for key, p in points.items()], f"{keys}, xs array<double>, es array<double>")
        sums = series.join(F.broadcast(tried), by).mapInPandas(run, f"{keys}, k bigint, ss array<double>, ld array<double>")  # one row per group
        each = sums.select(*by, "k", F.posexplode(F.arrays_zip("ss", "ld")).alias("i", "x"))
        rows = each.groupBy(*by, "i").agg(F.sum("k").alias("k"), F.sum("x.ss").alias("ss"), F.sum("x.ld").alias("ld")).collect()  # groups x points
        found: dict[tuple, list] = {}
        for r in sorted(rows, key=lambda r: r["i"]):
            scale = r["ss"] / max(r["k"], 1)
            found.setdefault(tuple(r[c] for c in by), []).append((scale, r["k"] * math.log(max(scale, 1e-300)) + r["ld"]))
        out = {}
        for key, tried_ in found.items():
            loss = np.array([x[1] for x in tried_])
            i = int(np.flatnonzero(loss <= loss.min() + 1e-9 * abs(loss.min()))[0])  # of equals the nearest to the centre
            out[key] = (points[key][i], *tried_[i])
        return out

    def around(center: np.ndarray, xs: np.ndarray, es: np.ndarray) -> np.ndarray:
        p = np.array([(x, e) for x in xs for e in es])
        p = p[np.argsort((((p - center) / (xs[1] - xs[0], es[1] - es[0])) ** 2).sum(axis=1), kind="stable")]
        return np.clip(p, (-14.0, -6.0), (20.0, 6.0))  # lam below e^-14 is none

    begin, seven = around(np.array([-4.0, 0.5]), np.arange(-9.0, 5.0), np.arange(-2.0, 5.25, 0.25)), np.arange(-3, 4)
    groups = [tuple(r) for r in series.select(*by).distinct().collect()]  # one row per group
    got = best({key: begin for key in groups})
    step = {key: 1 / 3 for key in got}
    for _ in range(most):
        left = {key: around(got[key][0], got[key][0][0] + seven * s, got[key][0][1] + seven * s / 2) for key, s in step.items() if s > finest / 3}
        if not left:
            break
        for key, new in best(left).items():
            inside = (np.abs(new[0] - got[key][0]) < np.array([2.5, 1.25]) * step[key]).all()
            got[key], step[key] = new, step[key] / 3 if inside else min(2 * step[key], 1.0)
    rows = [(*key, math.exp(p[0]), math.tanh(p[1]), scale, loss) for key, (p, scale, loss) in got.items()]
    return spark.createDataFrame(rows, f"{keys}, lam double, phi double, scale double, loss double")


def fit_categories(z: DataFrame, periods: int) -> DataFrame:
    """(category, lam, phi, loss): maximum likelihood per category, on all of its series."""
    series = packed(z, periods, "z").withColumnRenamed("v", "z")
    return fit_series(series, ["category"]).select("category", "lam", "phi", "loss")


def fit_grid(z: DataFrame, periods: int, grid: list[tuple[float, float]]) -> DataFrame:
    """(category, lam, phi, loss) of the best of given parameters: the same likelihood, one
    fold per parameter pair, nothing sampled."""
    out = None
    for lam, phi in grid:
        one = likelihood(local_states(z, periods, lam, phi), ["category"]).select("category", F.lit(lam).alias("lam"), F.lit(phi).alias("phi"), "loss")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("category").agg(F.min(F.struct("loss", "lam", "phi")).alias("b")).select("category", "b.lam", "b.phi", "b.loss")


def _by_series(z: DataFrame, periods: int, score, boosts: DataFrame | None = None) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            array = lambda v, none: np.array([none if x is None else x for x in v], float)
            df["s"] = [score(array(v, np.nan), None if b is None else array(b, 1.0)).tolist() for v, b in zip(df["v"], df["b"])]
            yield df[[*SERIES, "s"]]

    kind = z.schema["entity"].dataType.simpleString()
    series = packed(z, periods, "z")
    if boosts is None:
        series = series.withColumn("b", F.lit(None).cast("array<double>"))
    else:
        series = series.join(packed(boosts, periods, "boost").withColumnRenamed("v", "b"), SERIES, "left")
    out = series.mapInPandas(run, f"entity {kind}, category string, s array<double>")
    return out.select(*SERIES, F.posexplode("s").alias("t", "s"))


def segmentation(z: DataFrame, periods: int, window: int = 3, warm: int = 6) -> DataFrame:
    """Largest penalty at which exact segmentation still cuts within the last periods."""
    return _by_series(z, periods, lambda y, _: segmentation_scores(y, window, warm))


def run_length(z: DataFrame, periods: int, hazard: float = 1 / 24, window: int = 3, boosts: DataFrame | None = None) -> DataFrame:
    """Log odds of a short run by Bayesian online change-point detection; ``boosts`` (entity,
    category, t, boost) raise the hazard of the periods of known events."""
    return _by_series(z, periods, lambda y, b: run_length_scores(y, hazard, window=window, boost=b), boosts)


def with_news(scores: DataFrame, news: DataFrame, factor: float, window: int = 3) -> DataFrame:
    """Scores plus 2 ln(factor) where the entity had news in the last ``window`` periods.
    ``news``: distinct (entity, t)."""
    reach = news.select("entity", F.explode(F.sequence(F.col("t"), F.col("t") + window - 1)).alias("t")).distinct().withColumn("_hit", F.lit(True))
    s = scores.join(reach, ["entity", "t"], "left")
    return s.select(*SERIES, "t", (F.col("s") + F.when(F.col("_hit"), 2 * math.log(factor)).otherwise(0.0)).alias("s"))


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    """The larger of two channels' scores; a series of one channel only keeps its own."""
    key = [*SERIES, "t"]
    return a.join(b.withColumnRenamed("s", "s2"), key, "left").select(*key, F.greatest("s", "s2").alias("s"))


def confirmed_shifts(cells: DataFrame, value: str, periods: int, w: int = 3) -> DataFrame:
    """(entity, category, t, sh): mean of ``w`` periods from t on less that of the ``w``
    before, where the panel has both."""
    o = Window.partitionBy(*SERIES).orderBy("t")
    after = F.avg(value).over(o.rangeBetween(0, w - 1))
    before = F.avg(value).over(o.rangeBetween(-w, -1))
    return cells.select(*SERIES, "t", (after - before).alias("sh")).where(F.col("t").between(w, periods - w))


def inject(z: DataFrame, share: float, first: int, last: int, sizes: list[float], seed: int) -> DataFrame:
    """Series with steps put in for a hash-chosen share: plus ``inj``, ``tau``, ``delta``.
    The same seed gives the same steps, however the data are laid out."""
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *SERIES), F.lit(1_000_003)) / 1_000_003.0
    tau = (F.floor(u("tau") * (last - first + 1)) + first).cast("int")
    size = F.get(F.array(*[F.lit(float(s)) for s in sizes]), F.floor(u("size") * len(sizes)).cast("int")) * F.when(u("sign") < 0.5, -1.0).otherwise(1.0)
    p = z.withColumns({"inj": u("inj") < share, "tau": tau, "delta": size})
    return p.withColumn("z", F.col("z") + F.when(F.col("inj") & (F.col("t") >= F.col("tau")), F.col("delta")).otherwise(0.0))


def first_alarm(scores: DataFrame, threshold: Column, start: int) -> DataFrame:
    """(entity, category, first): period of the first alarm from ``start`` on, or null."""
    return scores.where(F.col("t") >= start).groupBy(*SERIES).agg(F.min(F.when(F.col("s") > threshold, F.col("t"))).alias("first"))


def _thresholds(rows: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """(i, threshold): exact percentiles, one row each."""
    from veska.operators.studies import exact_percentiles

    got = exact_percentiles(rows, value, shares)
    return rows.sparkSession.createDataFrame(list(enumerate(got)), "i int, threshold double")


def calibrated(scores: DataFrame, truth: DataFrame, start: int, alphas: list[float], w: int = 3) -> DataFrame:
    """(alpha, threshold, recall, precision, delay, early): thresholds are quantiles of the
    clean series' largest scores.  ``truth``: (entity, category, inj, tau)."""
    s = scores.where(F.col("t") >= start).join(truth, SERIES)
    tops = s.where("not inj").groupBy(*SERIES).agg(F.max("s").alias("m"))
    thr = _thresholds(tops, "m", [1 - a for a in alphas])
    alpha = F.get(F.array(*[F.lit(a) for a in alphas]), F.col("i"))
    f = s.crossJoin(F.broadcast(thr)).groupBy("i", "threshold", *SERIES, "inj", "tau").agg(F.min(F.when(F.col("s") > F.col("threshold"), F.col("t"))).alias("f"))
    inj, hit = F.col("inj"), F.col("inj") & F.col("f").between(F.col("tau"), F.col("tau") + w - 1)
    early = F.col("inj") & (F.col("f") < F.col("tau"))
    n = lambda c: F.count_if(c)
    return f.groupBy(alpha.alias("alpha"), "threshold").agg(
        (n(hit) / n(inj)).alias("recall"),
        (n(hit) / F.greatest(n(hit) + n(~inj & F.col("f").isNotNull()) + n(early), F.lit(1))).alias("precision"),
        F.avg(F.when(hit, F.col("f") - F.col("tau"))).alias("delay"), (n(early) / n(inj)).alias("early"),
    )


def partial_area(curve: DataFrame, by: list[str], x: str, y: str, most: float) -> DataFrame:
    """Area under (x, y) from (0, 0) to ``most`` by trapezoids, as a share of ``most``."""
    w = Window.partitionBy(*by).orderBy(x)
    c = curve.where(F.col(x) <= most)
    area = (F.col(x) - F.lag(x, 1, 0.0).over(w)) * (F.col(y) + F.lag(y, 1, 0.0).over(w)) / 2
    return c.withColumn("_a", area).groupBy(*by).agg((F.sum("_a") / most).alias("pauc"))


def labelled(scores: DataFrame, shifts: DataFrame, threshold: float, rates: list[float], start: int, stop: int, window: int = 3) -> DataFrame:
    """(rate, threshold, precision, recall, alarms, shifts) against confirmed shifts: an
    alarm is right if a shift began in the last ``window`` periods, a shift is caught by an
    alarm in the ``window`` from it on; periods ``start`` to ``stop``."""
    s = scores.where(F.col("t").between(start, stop))
    thr = _thresholds(s, "s", [1 - r for r in rates])
    j = s.join(shifts.select(*SERIES, "t", (F.abs("sh") >= threshold).alias("big")), [*SERIES, "t"], "left").crossJoin(F.broadcast(thr))
    j = j.withColumns({"big": F.coalesce("big", F.lit(False)), "alarm": F.col("s") > F.col("threshold")})
    o = Window.partitionBy("i", *SERIES).orderBy("t")
    j = j.withColumns({
        "right": F.col("alarm") & F.max("big").over(o.rangeBetween(-(window - 1), 0)),
        "caught": F.col("big") & F.max("alarm").over(o.rangeBetween(0, window - 1)),
    })
    rate = F.get(F.array(*[F.lit(r) for r in rates]), F.col("i"))
    n = F.count_if
    return j.groupBy(rate.alias("rate"), "threshold").agg(
        (n("right") / F.greatest(n("alarm"), F.lit(1))).alias("precision"), (n("caught") / F.greatest(n("big"), F.lit(1))).alias("recall"),
        n("alarm").alias("alarms"), n("big").alias("shifts"),
    )


def top_alarms(scores: DataFrame, k: int, start: int) -> DataFrame:
    """(entity, category, t, s): the k series of the largest score, with its first period."""
    best = scores.where(F.col("t") >= start).groupBy(*SERIES).agg(F.max(F.struct("s", (-F.col("t")).alias("n"))).alias("b"))
    return best.select(*SERIES, (-F.col("b.n")).alias("t"), F.col("b.s").alias("s")).orderBy(F.desc("s"), *SERIES).limit(k)
