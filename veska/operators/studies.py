"""Studies on top of panels: bootstrap intervals, regressions, reports and study designs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from veska.operators.kernels import t_tail
from veska.operators.panel import SERIES

#: Distribution function of Poisson(1).
POISSON = (0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815, 0.999916759)


def unit(*parts: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the parts: the same in any engine and layout."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def multiplicity(*parts: Column | str) -> Column:
    """How often a bootstrap sample takes the unit named by the parts: Poisson(1)."""
    u = unit(*parts)
    return sum((F.when(u > c, 1).otherwise(0) for c in POISSON), F.lit(0))


def draws_of(groups: DataFrame, key: str, draws: int, seed: int = 0) -> DataFrame:
    """(b, key, m): the positive multiplicities of the groups in each draw."""
    b = groups.select(key).distinct().withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return b.withColumn("m", multiplicity(str(seed), F.col("b"), F.col(key))).where("m > 0")


def interval(draws: DataFrame, by: list[str], value: str, low: str, high: str, level: float = 0.95) -> DataFrame:
    """Percentile interval of a bootstrapped value per group (one row per draw and group)."""
    q = [(1 - level) / 2, (1 + level) / 2]
    return draws.groupBy(*by).agg(F.percentile(value, q).alias("_q")).select(*by, F.col("_q")[0].alias(low), F.col("_q")[1].alias(high))


def event_study_interval(shifts: DataFrame, news: DataFrame, groups: DataFrame, shift: float, threshold: float, lags: list[int], draws: int = 500) -> DataFrame:
    """(lag, ci_low, ci_high): interval of the event study's lift, entities drawn by group.

    ``groups``: (entity, grp).  Cells are counted per lag, period and group before any draw,
    so a draw weighs counts and never cells."""
    sh = shifts.where("sh is not null").withColumn("big", (F.abs("sh") >= shift).cast("int"))
    at = sh.withColumn("lag", F.explode(F.array(*[F.lit(k) for k in lags]))).withColumn("src", F.col("t") + F.col("lag"))
    n = news.where("s is not null").select("entity", F.col("t").alias("src"), (F.col("s") >= threshold).cast("int").alias("hit"))
    cells = at.join(n, ["entity", "src"]).join(groups.select("entity", "grp"), "entity")
    counted = cells.groupBy("lag", "t", "grp").agg(F.count("*").alias("o"), F.sum("hit").alias("n"), F.sum("big").alias("k"), F.sum(F.col("hit") * F.col("big")).alias("s"))
    drawn = counted.join(draws_of(counted, "grp", draws), "grp").groupBy("b", "lag", "t").agg(*[F.sum(F.col("m") * F.col(c)).alias(c) for c in ("o", "n", "k", "s")])
    lift = drawn.groupBy("b", "lag").agg(F.sum("s").alias("seen"), F.sum(F.col("n") * F.col("k") / F.col("o")).alias("due")).where("due > 0")
    return interval(lift.withColumn("lift", F.col("seen") / F.col("due")), ["lag"], "lift", "ci_low", "ci_high")


def response_interval(shifts: DataFrame, hits: DataFrame, within: bool = False, draws: int = 500, least: int = 10) -> DataFrame:
    """(treated, entities, shift, ci_low, ci_high, abs_shift, abs_low, abs_high, abs_control): the
    response to news with intervals, entities drawn; no row below ``least`` treated cells.
    ``abs_control`` is the mean size of the difference in other periods of treated series."""
    j = shifts.where("sh is not null").join(hits.withColumn("hit", F.lit(True)), ["entity", "t"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    by = SERIES if within else ["t"]
    base = j.where("not hit").groupBy(*by).agg(F.avg("sh").alias("base"))  # series or periods
    d = j.join(base, by, "left").withColumn("d", F.col("sh") - F.col("base"))
    per = d.groupBy(*SERIES).agg(
        F.sum(F.when(F.col("hit"), F.col("d"))).alias("s"), F.sum(F.when(F.col("hit"), F.abs("d"))).alias("a"), F.count(F.when(F.col("hit"), F.col("d"))).alias("n"),
        F.count_if("hit").alias("treated"), F.sum(F.when(~F.col("hit"), F.abs("d"))).alias("c"), F.count(F.when(~F.col("hit"), F.col("d"))).alias("cn"),
    ).where("treated > 0")
    entity = per.groupBy("entity").agg(F.sum("s").alias("s"), F.sum("a").alias("a"), F.sum("n").alias("n"))
    boot = entity.join(draws_of(entity, "entity", draws), "entity").groupBy("b").agg(*[F.sum(F.col("m") * F.col(c)).alias(c) for c in ("s", "a", "n")]).where("n > 0")
    q = lambda c: F.percentile(F.col(c) / F.col("n"), [0.025, 0.975])
    ends = boot.agg(q("s").alias("s"), q("a").alias("a"))
    whole = per.agg(
        F.sum("treated").alias("treated"), F.countDistinct("entity").alias("entities"), (F.sum("s") / F.sum("n")).alias("shift"),
        (F.sum("a") / F.sum("n")).alias("abs_shift"), (F.sum("c") / F.sum("cn")).alias("abs_control"),
    ).where(F.col("treated") >= least)
    both = whole.crossJoin(F.broadcast(ends))  # one row each
    return both.select("treated", "entities", "shift", F.col("s")[0].alias("ci_low"), F.col("s")[1].alias("ci_high"), "abs_shift", F.col("a")[0].alias("abs_low"), F.col("a")[1].alias("abs_high"), "abs_control")


@F.pandas_udf(DoubleType())
def two_sided(stat: pd.Series, df: pd.Series) -> pd.Series:
    """p-value of a statistic against Student's t, or the normal where ``df`` is null."""
    from statistics import NormalDist

    return pd.Series([None if x != x or x is None else 2 * (t_tail(float(x), float(n)) if n == n and n is not None else NormalDist().cdf(-abs(float(x)))) for x, n in zip(stat, df)], dtype="float64")


def least_squares(rows: DataFrame, by: list[str], y: str, xs: list[str]) -> DataFrame:
    """(by, n, b ARRAY): ordinary least squares with an intercept per group by the normal
    equations; the sums are aggregated where the rows lie, the small systems solved after.
    Rows with a null are left out; groups with fewer rows than coefficients give null."""
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    k = len(cols)
    full = rows.dropna(subset=[y, *xs])
    sums = full.groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.sum(a * b) for a in cols for b in cols]).alias("xx"), F.array(*[F.sum(a * F.col(y)) for a in cols]).alias("xy"))

    @F.pandas_udf("array<double>")
    def solved(n: pd.Series, xx: pd.Series, xy: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.lstsq(np.array(a).reshape(k, k), np.array(b), rcond=None)[0].tolist() if m >= k else None for m, a, b in zip(n, xx, xy)])

    return sums.select(*by, "n", solved("n", "xx", "xy").alias("b"))


def growth_table(series: DataFrame, rate: DataFrame) -> DataFrame:
    """(series, t, back, ahead, rate, real, change): yearly growth of 12-month sums behind and
    ahead of each period, beside the rate (t, rate, real) of the period and its change over
    six periods; periods without a rate keep their growth."""
    w = Window.partitionBy("series").orderBy("t")
    total = F.when(F.count("x").over(w.rowsBetween(-11, 0)) == 12, F.log(F.sum(F.exp("x")).over(w.rowsBetween(-11, 0))))
    s = series.withColumn("s", total)
    g = s.select("series", "t", (F.col("s") - F.lag("s", 12).over(w)).alias("back"), (F.lead("s", 12).over(w) - F.col("s")).alias("ahead"))
    return g.join(rate, "t", "left").withColumn("change", F.col("rate") - F.lag("rate", 6).over(w))


def growth_study(table: DataFrame, origins: list[int], rules: dict[str, list[str]], years: int = 5) -> DataFrame:
    """(series, o, rule, pred, fact): growth ahead of each origin as each rule forecasts it
    from what was known then: the growth behind ('last'), its mean over ``years`` ('mean'),
    and least squares on the regressors of ``rules``, learned from periods whose growth
    ahead was complete at the origin."""
    os = table.sparkSession.createDataFrame([(o,) for o in origins], "o int")
    now = table.join(F.broadcast(os), F.col("t") == F.col("o")).where("ahead is not null and back is not null")
    w = Window.partitionBy("series", "o").orderBy(F.desc("t"))
    past = table.join(F.broadcast(os), F.col("t") <= F.col("o")).where("back is not null").withColumn("k", F.row_number().over(w)).where(F.col("k") <= 12 * years)
    mean = past.groupBy("series", "o").agg(F.avg("back").alias("pred"))
    fact = now.select("series", "o", F.col("ahead").alias("fact"))
    out = now.select("series", "o", F.lit("last").alias("rule"), F.col("back").alias("pred")).unionByName(mean.select("series", "o", F.lit("mean").alias("rule"), "pred"))
    train = table.join(F.broadcast(os), F.col("t") <= F.col("o") - 12)
    for name, xs in rules.items():
        b = least_squares(train, ["series", "o"], "ahead", xs)
        dot = F.col("b")[0]
        for i, x in enumerate(xs):
            dot = dot + F.col("b")[i + 1] * F.col(x)
        out = out.unionByName(now.join(b, ["series", "o"]).select("series", "o", F.lit(name).alias("rule"), dot.alias("pred")))
    return out.join(fact, ["series", "o"]).where("pred is not null").select("series", "o", "rule", "pred", "fact")


def growth_variants(series: DataFrame, cutoffs: DataFrame, base: int) -> DataFrame:
    """(series, o, last, longrun, half): yearly growth at each cutoff (o, upto): of the last
    three months on the year before, the yearly mean since period ``base`` by 12-month
    sums, and the mean of both."""
    w = Window.partitionBy("series").orderBy("t")
    s = series.withColumn("s", F.when(F.count("x").over(w.rowsBetween(-11, 0)) == 12, F.log(F.sum(F.exp("x")).over(w.rowsBetween(-11, 0)))))
    k = F.col("t") - F.col("upto")
    pick = lambda a, b: F.avg(F.when(k.between(a, b), F.col("x")))
    at = s.join(F.broadcast(cutoffs), F.col("t") <= F.col("upto")).groupBy("series", "o", "upto").agg(
        (pick(-2, 0) - pick(-14, -12)).alias("last"), F.max(F.when(k == 0, F.col("s"))).alias("now"), F.max(F.when(F.col("t") == base, F.col("s"))).alias("then")
    )
    long = (F.col("now") - F.col("then")) / ((F.col("upto") - base) / 12.0)
    return at.select("series", "o", "last", long.alias("longrun"), ((F.col("last") + long) / 2).alias("half"))


def outside_errors(series: DataFrame, periods: list[tuple[str, int, int]], horizon: int) -> DataFrame:
    """(period, rule, h, err, origins): mean error in per cent of rules for the outside series
    themselves, over the origins of named periods that have a value: the last value, the value a year
    before, and that plus the yearly growth of the last three months."""
    spans = series.sparkSession.createDataFrame(periods, "period string, a int, z int")
    by = series.groupBy("series").agg(F.map_from_entries(F.collect_list(F.struct("t", "x"))).alias("m"))  # one map per series
    o = by.crossJoin(F.broadcast(spans)).withColumn("o", F.explode(F.sequence("a", "z"))).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    x = lambda t: F.try_element_at("m", t.cast("int"))
    at, h = F.col("o"), F.col("h")
    o = o.where(x(at).isNotNull())
    growth = (x(at) + x(at - 1) + x(at - 2) - x(at - 12) - x(at - 13) - x(at - 14)) / 3
    rules = {"naive": x(at), "seasonal_naive": x(at + h - 12), "seasonal_growth": x(at + h - 12) + growth}
    each = o.select("period", "series", "o", "h", x(at + h).alias("y"), F.explode(F.create_map(*[c for k, v in rules.items() for c in (F.lit(k), v)])).alias("rule", "f")).where("y is not null and f is not null")
    return each.groupBy("period", "rule", "h").agg((100 * F.avg(F.abs(F.col("y") - F.col("f")))).alias("err"), F.countDistinct("o").alias("origins"))


def month_after(month: Column, h: Column) -> Column:
    """'YYYY-MM' that many months after a month written so."""
    return F.date_format(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), h), "yyyy-MM")


def covered_models(forecasts: DataFrame, series: DataFrame, most_missing: float = 0.5) -> DataFrame:
    """Forecasts of the models that leave at most a share of the series without any value.
    ``series``: (entity, category) of the panel."""
    all_ = series.select(*SERIES).distinct().agg(F.count("*").alias("all"))
    has = forecasts.where("f is not null").select("model", *SERIES).distinct().groupBy("model").agg(F.count("*").alias("has"))
    kept = has.crossJoin(F.broadcast(all_)).where(1 - F.col("has") / F.col("all") <= most_missing).select("model")
    return forecasts.join(F.broadcast(kept), "model", "left_semi")  # one row per model


def report_pivot(metrics: DataFrame, row: str, column: str, columns: list, value: str, best_first: str) -> DataFrame:
    """One row per ``row``, a column per value of ``column``, the best first by the last one:
    the smallest, or the largest where the measure's name says so (r2)."""
    wide = metrics.where(F.col(column).isin(columns)).groupBy(row).pivot(column, columns).agg(F.first(value))
    wide = wide.select(row, *[F.col(str(c)).alias(f"{column}{c}") for c in columns])
    last = F.col(f"{column}{columns[-1]}") * (-1 if best_first == "r2" else 1)
    return wide.withColumn("place", F.row_number().over(Window.orderBy(last, row)))  # one row per model


def sampled(rows: DataFrame, strata: str, key: list[str], k: int, seed: int = 0) -> DataFrame:
    """Exactly ``k`` rows of each stratum (all where it has fewer), chosen by a hash of their
    key; each task keeps its k best before they move."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), *key))
    w = Window.partitionBy(strata).orderBy(order, *key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def neighbour_lists(near: DataFrame) -> DataFrame:
    """(a, list): the neighbours of each node as an array, the nearest first."""
    return near.groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "b"))), lambda x: x["b"]).alias("list"))


def sorted_union(*lists: Column) -> Column:
    """The values of several arrays once each, in order."""
    return F.array_sort(F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])))


def count_matrix(rows: DataFrame, entities: DataFrame, groups: dict[str, list[str] | None], periods: int) -> DataFrame:
    """(grp, entity, t, n): counts of each group of kinds (None: all) on every period of every
    entity, 0 where there is none.  ``rows``: (entity, t, kind, n)."""
    member = F.array_compact(F.array(*[F.when(F.lit(True) if ks is None else F.col("kind").isin(ks), F.lit(g)) for g, ks in groups.items()]))
    summed = rows.where(F.col("t").between(0, periods - 1)).select("entity", "t", "n", F.explode(member).alias("grp")).groupBy("grp", "entity", "t").agg(F.sum("n").alias("n"))
    grid = entities.select("entity").distinct().select("entity", F.explode(F.array(*[F.lit(g) for g in groups])).alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(periods - 1))).alias("t"))
    return grid.join(summed, ["grp", "entity", "t"], "left").select("grp", "entity", "t", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def injected(z: DataFrame, share: float, first: int, last: int, sizes: list[float], seeds: list[int], news_true: float, news_false: float, periods: int) -> DataFrame:
    """Series with steps put in, once per seed: (seed, entity, category, t, z, inj, tau, delta,
    news), ``news`` the period in which news came: for a share of the steps theirs, for a
    share of the others a random one, else null.  The choices are hashes of seed and
    series, so any engine makes the same."""
    u = lambda k: unit(F.col("seed"), k, F.col("entity"), F.col("category"))
    p = z.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    tau = (F.floor(u("tau") * (last - first + 1)) + first).cast("int")
    size = F.get(F.array(*[F.lit(float(s)) for s in sizes]), F.floor(u("size") * len(sizes)).cast("int")) * F.when(u("sign") < 0.5, -1.0).otherwise(1.0)
    p = p.withColumns({"inj": u("inj") < share, "tau": tau, "delta": size})
    fake = (F.floor(u("when") * (periods - first)) + first).cast("int")
    news = F.when(F.col("inj") & (u("true") < news_true), F.col("tau")).when(~F.col("inj") & (u("false") < news_false), fake)
    z2 = F.col("z") + F.when(F.col("inj") & (F.col("t") >= F.col("tau")), F.col("delta")).otherwise(0.0)
    return p.select("seed", *SERIES, "t", z2.alias("z"), "inj", "tau", "delta", news.alias("news"))


def sliced(truth: DataFrame) -> DataFrame:
    """Series with the groups they count in, several each: all, the size of their step (with
    all series without one) and their category."""
    sizes = [r["d"] for r in truth.select(F.abs("delta").alias("d")).distinct().orderBy("d").collect()]  # one row per size
    size = [F.when(~F.col("inj") | (F.abs("delta") == d), F.lit(f"delta {d:g}")) for d in sizes]
    groups = F.array_compact(F.array(F.lit("all"), *size, F.col("category")))
    return truth.withColumn("grp", F.explode(groups))


def calibrated_by(scores: DataFrame, truth: DataFrame, by: list[str], start: int, alphas: list[float], w: int = 3) -> DataFrame:
    """(by, alpha, threshold, recall, precision, delay, early) per group of series, thresholds
    the quantiles of the clean series' largest scores of the group.  ``scores``: (key, t,
    s); ``truth``: (key, by, inj, tau), a row per group of a series."""
    key = [c for c in scores.columns if c not in ("t", "s")]
    own = [c for c in by if c not in key]
    s = scores.where(F.col("t") >= start)
    tops = s.groupBy(*key).agg(F.max("s").alias("m"))
    clean = truth.where("not inj").join(tops, key)
    thr = clean.groupBy(*by).agg(F.percentile("m", [1 - a for a in alphas]).alias("q")).select(*by, F.posexplode("q").alias("i", "threshold"))
    cells = truth.join(s, key).join(F.broadcast(thr), by)  # groups x alphas
    f = cells.groupBy("i", "threshold", *key, *own, "inj", "tau").agg(F.min(F.when(F.col("s") > F.col("threshold"), F.col("t"))).alias("f"))
    inj, hit = F.col("inj"), F.col("inj") & F.col("f").between(F.col("tau"), F.col("tau") + w - 1)
    early, n = F.col("inj") & (F.col("f") < F.col("tau")), F.count_if
    alpha = F.get(F.array(*[F.lit(a) for a in alphas]), F.col("i"))
    return f.groupBy(*by, alpha.alias("alpha"), "threshold").agg(
        F.try_divide(n(hit), n(inj)).alias("recall"),
        (n(hit) / F.greatest(n(hit) + n(~inj & F.col("f").isNotNull()) + n(early), F.lit(1))).alias("precision"),
        F.avg(F.when(hit, F.col("f") - F.col("tau"))).alias("delay"), F.try_divide(n(early), n(inj)).alias("early"),
    )


def over_seeds(runs: DataFrame, by: list[str], alpha: float, most: float) -> DataFrame:
    """(by, seeds, recall, recall_ci, precision, precision_ci, pauc, pauc_ci): means over the
    seeds at ``alpha`` and half-widths of their 95 % intervals by Student's t; ``pauc`` is
    the area under recall up to alpha ``most``."""
    w = Window.partitionBy(*by, "seed").orderBy("alpha")
    step = (F.col("alpha") - F.lag("alpha", 1, 0.0).over(w)) * (F.col("recall") + F.lag("recall", 1, 0.0).over(w)) / 2
    area = runs.where(F.col("alpha") <= most + 1e-12).withColumn("a", step).groupBy(*by, "seed").agg((F.sum("a") / most).alias("pauc"))
    at = runs.where(F.abs(F.col("alpha") - alpha) < 1e-9).select(*by, "seed", "recall", "precision").join(area, [*by, "seed"])
    # 97.5 % quantiles of Student's t for 1 to 9 degrees of freedom.
    t = F.get(F.array(*[F.lit(x) for x in (12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157)]), (F.col("seeds") - 2).cast("int"))
    cols = ("recall", "precision", "pauc")
    g = at.groupBy(*by).agg(F.count("*").alias("seeds"), *[F.avg(c).alias(c) for c in cols], *[F.stddev_samp(c).alias(f"{c}_sd") for c in cols])
    return g.select(*by, "seeds", *[x for c in cols for x in (F.col(c), (t * F.col(f"{c}_sd") / F.sqrt("seeds")).alias(f"{c}_ci"))])


def exact_percentiles(rows: DataFrame, value: str, shares: list[float], width: float = 0.002) -> list[float | None]:
    """Exact percentiles with linear interpolation, without one task that holds all values.

    A sketch gives for each share two values that enclose its place; one pass counts what
    lies below and between, and only the values between are put in order: about ``width``
    of all.  None for each share where there is no value."""
    col = F.col(value).cast("double")
    v = rows.select(col.alias("v")).where("v is not null")
    lo_hi = v.approxQuantile("v", sorted({min(max(s + d, 0.0), 1.0) for s in shares for d in (-width, width)}), width / 4)
    if not lo_hi:
        return [None] * len(shares)
    at = dict(zip(sorted({min(max(s + d, 0.0), 1.0) for s in shares for d in (-width, width)}), lo_hi))
    ends = [(at[max(s - width, 0.0)], at[min(s + width, 1.0)]) for s in shares]
    counts = v.agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), *[F.count_if(F.col("v") < a).alias(f"b{i}") for i, (a, _) in enumerate(ends)], *[F.count_if(F.col("v").between(a, z)).alias(f"m{i}") for i, (a, z) in enumerate(ends)]).first()
    inner = []
    for i, (s, (a, z)) in enumerate(zip(shares, ends)):
        place, m = s * (counts["n"] - 1) - counts[f"b{i}"], counts[f"m{i}"]
        if place < 0 or place > m - 1:  # the sketch missed: take the value's own order
            inner.append(F.percentile("v", s).alias(f"q{i}"))
        else:
            inner.append(F.percentile(F.when(F.col("v").between(a, z), F.col("v")), place / (m - 1) if m > 1 else 0.0).alias(f"q{i}"))
    got = v.agg(*inner).first()
    return [got[f"q{i}"] for i in range(len(shares))]


def rank_table(borda: DataFrame, copeland: DataFrame, threshold: DataFrame, kemeny: DataFrame, condorcet: DataFrame) -> DataFrame:
    """(model, borda, copeland, threshold, kemeny, condorcet): each model's place by all rules;
    one row per model."""
    place = lambda df, col, name: df.select("model", F.col(col).cast("int").alias(name))
    out = place(borda, "rank", "borda").join(place(copeland, "rank", "copeland"), "model").join(place(threshold, "place", "threshold"), "model").join(place(kemeny, "place", "kemeny"), "model", "left")
    return out.join(condorcet.withColumn("condorcet", F.lit(True)), "model", "left").withColumn("condorcet", F.coalesce("condorcet", F.lit(False)))

