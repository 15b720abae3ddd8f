"""Evaluation of forecasts: metrics, interval scores, tests and rank aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["model", "o", "entity", "category", "h"]


def pairs(forecasts: DataFrame, panel: DataFrame) -> DataFrame:
    """Forecasts beside the actual value of their target period, where that is known."""
    actual = panel.where("v is not null").select("entity", "category", F.col("t").alias("_t"), F.col("v").alias("y"))
    return forecasts.withColumn("_t", F.col("o") + F.col("h")).join(actual, ["entity", "category", "_t"]).drop("_t")


def metrics(paired: DataFrame) -> DataFrame:
    """(model, h, category, mae, r2, wape, n, coverage) per category and, with category
    'total', over all; one pass."""
    e, ok = F.col("y") - F.col("f"), F.col("f").isNotNull()
    y = F.when(ok, F.col("y"))
    sets = paired.groupingSets([["model", "h"], ["model", "h", "category"]], "model", "h", "category")
    g = sets.agg(
        F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("se"), (F.var_pop(y) * F.count(y)).alias("st"),
        (F.sum(F.abs(e)) / F.sum(F.abs(y))).alias("wape"), F.count("f").alias("n"), (F.count("f") / F.count("*")).alias("coverage"),
    )
    return g.select("model", "h", F.coalesce("category", F.lit("total")).alias("category"), "mae", F.when(F.col("st") > 0, 1 - F.col("se") / F.col("st")).alias("r2"), "wape", "n", "coverage")


def cumulative_mae(paired: DataFrame, periods: int, horizon: int) -> DataFrame:
    """(model, mae): mean error over all steps, of the origins that have them all."""
    return paired.where(F.col("o") + horizon < periods).groupBy("model").agg(F.avg(F.abs(F.col("y") - F.col("f"))).alias("mae"))


def loss_differences(paired: DataFrame, a: str, b: str) -> DataFrame:
    """(o, entity, category, h, dl): |error of a| - |error of b| where both forecast."""
    key = ["o", "entity", "category", "h"]
    one = lambda m, n: paired.where((F.col("model") == m) & F.col("f").isNotNull()).select(*key, F.abs(F.col("y") - F.col("f")).alias(n))
    return one(a, "la").join(one(b, "lb"), key).select(*key, (F.col("la") - F.col("lb")).alias("dl"))


def diebold_mariano(paired: DataFrame, a: str, b: str) -> DataFrame:
    """(h, mean_diff, dm, units, by_unit): difference of losses per origin with a Bartlett HAC
    variance of lag h - 1, or per origin and entity where there are fewer than 4 origins."""
    d = loss_differences(paired, a, b)
    by_o = d.groupBy("h", "o").agg(F.avg("dl").alias("s"))
    n, mean = F.count("*").over(Window.partitionBy("h")), F.avg("s").over(Window.partitionBy("h"))
    u = by_o.select("h", "o", F.row_number().over(Window.partitionBy("h").orderBy("o")).alias("k"), (F.col("s") - mean).alias("u"), n.alias("T"))
    other = u.select(F.col("h").alias("h2"), F.col("k").alias("k2"), F.col("u").alias("u2"))
    lag = F.least(F.col("h") - 1, F.col("T") - 2)
    gap = F.col("k") - F.col("k2")
    weight = F.when(gap == 0, 1.0).otherwise(2 * (1 - gap / F.greatest(lag + 1, F.lit(1))))
    var = (
        u.join(other, (F.col("h") == F.col("h2")) & gap.between(0, F.greatest(lag, F.lit(0))))
        .groupBy("h").agg((F.sum(weight * F.col("u") * F.col("u2")) / F.first("T")).alias("var"), F.first("T").alias("T"))
    )
    mean_s = by_o.groupBy("h").agg(F.avg("s").alias("ms"))
    hac = var.join(mean_s, "h").select("h", "T", (F.col("ms") / F.sqrt(F.greatest("var", F.lit(1e-12)) / F.col("T"))).alias("dm"))
    clusters = d.groupBy("h", "o", "entity").agg(F.sum("dl").alias("g")).groupBy("h").agg(
        F.try_divide(F.avg("g"), F.stddev_samp("g") / F.sqrt(F.count("*"))).alias("dm_c"), F.count("*").alias("units_c")
    )
    means = d.groupBy("h").agg(F.avg("dl").alias("mean_diff"))
    many = F.col("T") >= 4
    return means.join(hac, "h").join(clusters, "h").select("h", "mean_diff", F.when(many, F.col("dm")).otherwise(F.col("dm_c")).alias("dm"), F.when(many, F.col("T")).otherwise(F.col("units_c")).alias("units"), F.when(many, "origin").otherwise("cluster").alias("by_unit"))


def interval_score(scored: DataFrame, y: str, lo: str, hi: str, level: float, by: list[str]) -> DataFrame:
    """Coverage, mean width and mean Winkler score of intervals of one level."""
    c = F.col
    a = 2 / (1 - level)
    winkler = c(hi) - c(lo) + F.when(c(y) < c(lo), a * (c(lo) - c(y))).when(c(y) > c(hi), a * (c(y) - c(hi))).otherwise(0.0)
    ok = scored.where(c(y).isNotNull() & c(lo).isNotNull() & c(hi).isNotNull())
    return ok.groupBy(*by).agg(F.avg(c(y).between(c(lo), c(hi)).cast("double")).alias("coverage"), F.avg(c(hi) - c(lo)).alias("width"), F.avg(winkler).alias("winkler"))


def common_losses(paired: DataFrame, models: list[str]) -> DataFrame:
    """|error| of the pairs that all models forecast: (o, entity, category, h, model, loss)."""
    key = ["o", "entity", "category", "h"]
    p = paired.where(F.col("model").isin(models) & F.col("f").isNotNull())
    n = F.count("*").over(Window.partitionBy(*key))
    return p.withColumn("_n", n).where(F.col("_n") == len(models)).select(*key, "model", F.abs(F.col("y") - F.col("f")).alias("loss"))


def cluster_sums(losses: DataFrame) -> DataFrame:
    """(entity, model, s, n): all that a bootstrap over entities needs."""
    return losses.groupBy("entity", "model").agg(F.sum("loss").alias("s"), F.count("*").alias("n"))


def bootstrap_means(sums: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """(b, model, d): mean loss of each bootstrap sample of entities.

    Entities get Poisson(1) multiplicities from a hash of (seed, draw, entity), so a sample
    needs no list of all entities and any partition can be computed again alike.
    """
    from veska.operators.studies import draws_of

    drawn = sums.join(draws_of(sums, "entity", draws, seed), "entity")
    return drawn.groupBy("b", "model").agg((F.sum(F.col("m") * F.col("s")) / F.sum(F.col("m") * F.col("n"))).alias("d"))


def model_ranks(cells: DataFrame, by: list[str], score: str) -> DataFrame:
    """Place of each model in each cell, the best first; ties by name, as voters rank
    strictly."""
    w = Window.partitionBy(*by).orderBy(score, "model")
    return cells.select(*by, "model", F.row_number().over(w).alias("place"))


def borda(ranks: DataFrame) -> DataFrame:
    """(model, points, rank): sums of places, least best."""
    b = ranks.groupBy("model").agg(F.sum("place").alias("points"))
    return b.select("model", "points", F.rank().over(Window.orderBy("points")).alias("rank"))  # one row per model


def pairwise(ranks: DataFrame, by: list[str]) -> DataFrame:
    """(a, b, n): voters that place a above b; one row per pair of models."""
    # A voter's ballot holds one entry per model, so pairs are made inside one row.
    ballots = ranks.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("place", "model"))).alias("x"))
    a = ballots.select(F.posexplode("x").alias("i", "a"), "x")
    pairs_ = a.select(F.col("a.model").alias("a"), "i", F.posexplode("x").alias("j", "b")).where("i != j")
    return pairs_.groupBy("a", F.col("b.model").alias("b")).agg(F.count_if(F.col("i") < F.col("j")).alias("n"))


def copeland(wins: DataFrame) -> DataFrame:
    """(model, score, rank): pairs won less pairs lost."""
    back = wins.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("m"))
    s = wins.join(back, ["a", "b"]).groupBy(F.col("a").alias("model")).agg(F.sum(F.signum(F.col("n") - F.col("m")).cast("bigint")).alias("score"))
    return s.select("model", "score", F.rank().over(Window.orderBy(F.desc("score"))).alias("rank"))


def threshold_rule(ranks: DataFrame, places: int) -> DataFrame:
    """(model, place): fewest last places, then fewest last but one, and so on."""
    counts = ranks.groupBy("model").agg(*[F.count_if(F.col("place") == p).alias(f"c{p}") for p in range(places, 0, -1)])
    order = Window.orderBy(*[f"c{p}" for p in range(places, 0, -1)], "model")
    return counts.select("model", F.row_number().over(order).alias("place"))


def condorcet(wins: DataFrame) -> DataFrame:
    """The model that beats each other one in more than half of the ballots, if any."""
    back = wins.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("m"))
    return wins.join(back, ["a", "b"]).groupBy(F.col("a").alias("model")).agg(F.min((F.col("n") > F.col("m")).cast("int")).alias("w")).where("w = 1").select("model")


def winkler_quantile(level: float) -> float:
    """Half-width of a normal interval of a level, in standard deviations."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(0.5 + level / 2)


def lognormal_interval(center: Column, sd: Column, level: float) -> tuple[Column, Column]:
    z = winkler_quantile(level)
    return center * F.exp(-z * sd), center * F.exp(z * sd)
