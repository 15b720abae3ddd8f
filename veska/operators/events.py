"""Events and news beside a panel: catalogues, priors, surprise and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veska.operators.panel import SERIES


def merge_catalogues(ours: DataFrame, registry: DataFrame) -> DataFrame:
    """Our events (event_id, kind, ids ARRAY, month, announced) plus the registry's
    (event_id, kind, entity, month, announced) whose entity and month ours do not name."""
    have = ours.select(F.explode("ids").alias("entity"), "month").distinct()
    new = registry.where("entity is not null").join(have, ["entity", "month"], "left_anti")
    return ours.unionByName(new.select(F.concat(F.lit("M"), "event_id").alias("event_id"), "kind", F.array("entity").alias("ids"), "month", "announced"))


def known_at(events: DataFrame, month_end: Column) -> DataFrame:
    """Events announced by the end of a month."""
    return events.where(F.col("announced") <= month_end)


def boost(panel: DataFrame, events: DataFrame, factor: float, spread: int = 1) -> DataFrame:
    """The panel's cells with ``boost``: ``factor`` in an event's period and the ``spread``
    next ones, else 1; events that overlap do not multiply.  ``events``: (ids, t)."""
    reach = events.select(F.explode("ids").alias("entity"), F.explode(F.sequence(F.col("t"), F.col("t") + spread)).alias("t")).distinct()
    b = panel.join(reach.withColumn("_b", F.lit(float(factor))), ["entity", "t"], "left")
    return b.select(*SERIES, "t", F.coalesce("_b", F.lit(1.0)).alias("boost"))


def known_boosts(events: DataFrame, first: int, last: int, factor: float, spread: int = 1) -> DataFrame:
    """(o, entity, q ARRAY of periods 0 to o): ``factor`` in an event's period and the
    ``spread`` next ones, else 1, of the events known at each origin.  ``events``: (ids, t,
    known), ``known`` the first origin that knows of it; entities without one have no row."""
    e = events.select(F.explode("ids").alias("entity"), F.explode(F.sequence(F.col("t"), F.col("t") + spread)).alias("t"), "known")
    at = e.withColumn("o", F.explode(F.sequence(F.lit(first), F.lit(last)))).where((F.col("known") <= F.col("o")) & (F.col("t") <= F.col("o")))
    hit = at.groupBy("o", "entity").agg(F.collect_set("t").alias("ts"))
    return hit.select("o", "entity", F.transform(F.sequence(F.lit(0), F.col("o")), lambda t: F.when(F.array_contains("ts", t), float(factor)).otherwise(1.0)).alias("q"))


def impute_region(entities: DataFrame, known: DataFrame, per_range: int = 1_000_000) -> DataFrame:
    """(entity, region, how): the region of an entity is its own, or that of the nearest
    known ids on both sides if they agree, else of the nearer one (ties: the lower id).

    ``known``: (entity, region), several rows of one entity count by frequency.  Ids are
    taken in ranges with the last and first known id of each carried over the range edges
    (two rows per range), so no task holds all ids.
    """
    # Ranges of ids of about equal numbers of known ones: sparse ids make no more of them.
    k = known.where("entity is not null and region is not null").groupBy("entity").agg(F.mode("region", True).alias("region"))
    n = k.count()
    parts = max(1, -(-n // per_range))
    bounds = sorted(set(k.withColumn("entity", F.col("entity").cast("double")).approxQuantile("entity", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    cell = lambda c: F.array_size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= c)) if bounds else F.lit(0)
    all_ = entities.select("entity").distinct().join(k, "entity", "left").withColumn("cell", cell(F.col("entity")))
    hit = F.when(F.col("region").isNotNull(), F.struct("entity", "region"))
    ends = k.withColumn("cell", cell(F.col("entity"))).groupBy("cell").agg(F.min(F.struct("entity", "region")).alias("lo"), F.max(F.struct("entity", "region")).alias("hi"))
    cells = all_.select("cell").distinct().join(ends, "cell", "full")
    side = Window.orderBy("cell")  # one row per range of ids
    edges = cells.select("cell", F.last("hi", True).over(side.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("lo", True).over(side.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    missing = k.join(all_.select("entity"), "entity", "left_anti").withColumn("cell", cell(F.col("entity"))).withColumn("own", F.lit(False))
    both = all_.withColumn("own", F.lit(True)).unionByName(missing.select("entity", "region", "cell", "own"))
    w = Window.partitionBy("cell").orderBy("entity")
    lo = F.last(hit, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    hi = F.first(hit, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    near = both.withColumns({"_lo": lo, "_hi": hi}).join(edges, "cell").withColumns({"lo": F.coalesce("_lo", "before"), "hi": F.coalesce("_hi", "after")})
    e = F.col("entity")
    agree = F.col("lo.region") == F.col("hi.region")
    nearer = F.when(F.col("hi").isNull() | (e - F.col("lo.entity") <= F.col("hi.entity") - e), F.col("lo.region")).otherwise(F.col("hi.region"))
    return near.where("own").select(
        "entity", F.when(F.col("region").isNotNull(), F.col("region")).when(agree, F.col("lo.region")).otherwise(nearer).alias("region"),
        F.when(F.col("region").isNotNull(), "known").when(agree, "between").otherwise("nearest").alias("how"),
    )


def counts_on_grid(counts: DataFrame, key: str, periods: int) -> DataFrame:
    """(key, t, n): counts summed onto every period of each key, 0 where there is none."""
    summed = counts.groupBy(key, "t").agg(F.sum("n").alias("n")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("t", "n"))).alias("m"))
    return summed.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(periods - 1)), lambda t: F.coalesce(F.try_element_at("m", t), F.lit(0)))).alias("t", "n"))


def surprise(counts: DataFrame, key: str, periods: int, window: int = 6) -> DataFrame:
    """(key, t, s): log(1 + count) less its mean over the ``window`` periods before."""
    g = counts_on_grid(counts, key, periods).withColumn("x", F.log1p(F.col("n").cast("double")))
    w = Window.partitionBy(key).orderBy("t").rowsBetween(-window, -1)
    return g.select(key, "t", F.when(F.count("x").over(w) == window, F.col("x") - F.avg("x").over(w)).alias("s")).where("s is not null")


def surprise_with_fallback(own: DataFrame, regional: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, t, s, own): the entity's surprise where it has news of its own at all, else
    its region's.  ``entities``: (entity, region)."""
    has = own.select("entity").distinct()
    mine = entities.join(has, "entity", "left_semi").join(own, "entity").select("entity", "t", "s", F.lit(True).alias("own"))
    theirs = entities.join(has, "entity", "left_anti").join(regional, "region").select("entity", "t", "s", F.lit(False).alias("own"))
    return mine.unionByName(theirs)


def event_study(shifts: DataFrame, news: DataFrame, shift: float, threshold: float, lags: list[int]) -> DataFrame:
    """(lag, lift, p_news, p_expected, n): confirmed shifts beside news ``lag`` periods away,
    against the share of shifts among all series of the same period."""
    sh = shifts.where("sh is not null").withColumn("big", (F.abs("sh") >= shift).cast("double"))
    at = sh.withColumn("lag", F.explode(F.array(*[F.lit(k) for k in lags]))).withColumn("src", F.col("t") + F.col("lag"))
    n = news.where("s is not null").select("entity", F.col("t").alias("src"), (F.col("s") >= threshold).alias("hit"))
    j = at.join(n, ["entity", "src"])
    by_t = j.groupBy("lag", "t").agg(F.avg("big").alias("p"), F.count_if("hit").alias("n"), F.sum(F.when(F.col("hit"), F.col("big"))).alias("obs"))
    g = by_t.groupBy("lag").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("exp"), F.sum("obs").alias("obs"))
    return g.where("n > 0").select("lag", F.when(F.col("exp") > 0, F.col("obs") / F.col("exp")).alias("lift"), (F.col("obs") / F.col("n")).alias("p_news"), (F.col("exp") / F.col("n")).alias("p_expected"), "n")


def response(shifts: DataFrame, hits: DataFrame, within: bool = False) -> DataFrame:
    """(treated, entities, shift, abs_shift): mean shift in periods with news less that of
    controls: other series of the period, or (``within``) other periods of the series.
    ``hits``: distinct (entity, t)."""
    j = shifts.where("sh is not null").join(hits.withColumn("hit", F.lit(True)), ["entity", "t"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    by = SERIES if within else ["t"]
    base = j.where("not hit").groupBy(*by).agg(F.avg("sh").alias("base"))  # aggregated map-side: no task holds a period
    d = j.where("hit").join(base, by, "left").withColumn("d", F.col("sh") - F.col("base"))
    return d.agg(F.count("*").alias("treated"), F.countDistinct("entity").alias("entities"), F.avg("d").alias("shift"), F.avg(F.abs("d")).alias("abs_shift"))


def coverage(news: DataFrame, entities: DataFrame) -> DataFrame:
    """(region, entities, covered): entities per region and how many have any news."""
    seen = news.groupBy("entity").agg(F.sum("n").alias("n"))
    return entities.join(seen, "entity", "left").groupBy("region").agg(F.count("*").alias("entities"), F.count_if(F.col("n") > 0).alias("covered"))


def explained(scores: DataFrame, hits: DataFrame, rate: float, window: int = 3) -> DataFrame:
    """(alarms, with_news, base): share of the highest-scored cells with news in the last
    ``window`` periods, and that share of all cells."""
    reach = hits.select("entity", F.explode(F.sequence(F.col("t"), F.col("t") + window - 1)).alias("t")).distinct().withColumn("hit", F.lit(1.0))
    j = scores.join(reach, ["entity", "t"], "left").withColumn("hit", F.coalesce("hit", F.lit(0.0)))
    from veska.operators.studies import exact_percentiles

    (at,) = exact_percentiles(j, "s", [1 - rate])
    return j.withColumn("thr", F.lit(at).cast("double")).agg(F.count_if(F.col("s") > F.col("thr")).alias("alarms"), F.avg(F.when(F.col("s") > F.col("thr"), F.col("hit"))).alias("with_news"), F.avg("hit").alias("base"))


def first_alarm_after(scores: DataFrame, events: DataFrame, threshold: float, window: int) -> DataFrame:
    """(event_id, entity, category, delay): periods from an event to the first alarm of each
    series of its entity within ``window``, -1 for none.  ``events``: (event_id, entity, t)."""
    e = events.select("event_id", "entity", F.col("t").alias("t0"))
    j = scores.join(e, "entity")
    hit = F.when((F.col("s") > threshold) & F.col("t").between(F.col("t0"), F.col("t0") + window - 1), F.col("t") - F.col("t0"))
    return j.groupBy("event_id", *SERIES).agg(F.coalesce(F.min(hit), F.lit(-1)).alias("delay"))


def effect_on_forecast(paired: DataFrame, events: DataFrame, a: str, b: str, after: int = 5) -> DataFrame:
    """(h, mae_a, mae_b, n): errors of two models from origins in an event's period and the
    ``after`` next, for the series of its entity.  ``events``: (entity, t)."""
    reach = events.select("entity", F.explode(F.sequence(F.col("t"), F.col("t") + after)).alias("o")).distinct()
    p = paired.where(F.col("model").isin(a, b)).join(reach, ["entity", "o"], "left_semi")
    err = lambda m: F.avg(F.when(F.col("model") == m, F.abs(F.col("y") - F.col("f"))))
    return p.groupBy("h").agg(err(a).alias("mae_a"), err(b).alias("mae_b"), F.count_if(F.col("model") == a).alias("n"))
