"""Records of several sources without a common key matched into pairs with a confidence."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veska.session import cut

#: Days between two records from which kinds are learned to go together, and the days
#: within which pairs are compared at all: the rest of those is the contrast.
NEAR, FAR = 9, 21
FEATURES = ("days", "kinds", "text")
#: Prior variance that every covariance is drawn to, and its weight in rows.
PRIOR_VAR, PRIOR_ROWS = 0.25, 20.0


def candidate_pairs(records: DataFrame) -> DataFrame:
    """Pairs of records of different sources at one place that began within FAR days.

    Each record meets only the records of its own and the two neighbouring stretches of
    FAR days at its place, so the rows of a busy place spread over its stretches.
    """
    r = records.where("place is not null and began is not null").withColumn("day", F.datediff("began", F.lit("1970-01-01")))
    r = r.withColumn("stretch", F.floor(F.col("day") / FAR)).join(weighed_words(records), ["source", "id"], "left")
    own = ("source", "id", "kind", "day", "held")
    left = r.select([F.col(c).alias(f"{c}_a") for c in own] + ["place", F.explode(F.array(*[F.col("stretch") + k for k in (-1, 0, 1)])).alias("stretch")])
    right = r.select([F.col(c).alias(f"{c}_b") for c in own] + ["place", "stretch"])
    gap = F.abs(F.col("day_a") - F.col("day_b"))
    weight = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x)
    shared = weight(F.map_filter("held_a", lambda k, _: F.map_contains_key("held_b", k)))
    alike = F.coalesce(shared / F.least(weight(F.col("held_a")), weight(F.col("held_b"))), F.lit(0.0))
    return (
        left.join(right, ["place", "stretch"])
        .where((F.col("source_a") < F.col("source_b")) & (gap <= FAR))
        .groupBy("source_a", "id_a", "source_b", "id_b")
        .agg(F.first("kind_a").alias("kind_a"), F.first("kind_b").alias("kind_b"), F.min(gap).alias("gap"), F.max(alike).alias("text"))
    )


def weighed_words(records: DataFrame) -> DataFrame:
    """(source, id, held): the words and numbers of each record with their weights, the
    rarer the heavier; words that all records hold weigh nothing."""
    text = F.lower(F.coalesce("words", F.lit("")))
    words = records.select("source", "id", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]{3,})"), F.lit(1)))).alias("word")).distinct()
    count = words.groupBy("word").agg(F.count("*").alias("n"))
    total = records.select("source", "id").distinct().count()
    rare = count.select(F.col("word").alias("w"), F.log((F.lit(total) + 1.0) / F.col("n")).alias("weight"))
    return words.join(rare, F.col("word") == F.col("w")).groupBy("source", "id").agg(F.map_from_entries(F.collect_list(F.struct("word", "weight"))).alias("held"))


def _kinds(pairs: DataFrame) -> DataFrame:
    """How much more often two kinds meet within NEAR days than their frequencies tell:
    log odds per pair of kinds, drawn to zero where few pairs show them."""
    near = pairs.where(F.col("gap") <= NEAR)
    keys = ["source_a", "source_b"]
    both = near.groupBy(*keys, "kind_a", "kind_b").agg(F.count("*").alias("n"))
    by = lambda *c: Window.partitionBy(*keys, *c)
    n, na, nb, total = F.col("n"), F.sum("n").over(by("kind_a")), F.sum("n").over(by("kind_b")), F.sum("n").over(by())
    return both.select(*keys, "kind_a", "kind_b", F.log((n + 0.2) / (na * nb / total + 0.2)).alias("pmi"))


def _log_gauss(x: Column, mean: np.ndarray, cov: np.ndarray) -> Column:
    """Log density of a struct of features under one Gaussian, as one expression."""
    inv, y = np.linalg.inv(cov), [x[f] - float(m) for f, m in zip(FEATURES, mean)]
    out = F.lit(-0.5 * math.log(np.linalg.det(cov)))
    for i in range(len(y)):
        for j in range(i, len(y)):
            out = out - float(inv[i, j] * (0.5 if i == j else 1.0)) * y[i] * y[j]
    return out


def posterior(x: Column, model: tuple) -> Column:
    weight, means, covs = model
    odds = math.log(weight / (1 - weight)) + _log_gauss(x, means[1], covs[1]) - _log_gauss(x, means[0], covs[0])
    return 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), odds))))


def obey(p: Column, sides: Column) -> Column:
    """A posterior under transitivity: of each triangle (``sides``: its other two
    posteriors q and r) two sides whose product exceeds the third are at odds with it.  The
    third is raised to the product where that changes less, else the weaker of the two is
    lowered until the product is the third."""
    raised = lambda s: F.when((s.q * s.r > p) & (p >= 1 - F.least(s.q, s.r)), s.q * s.r).otherwise(0.0)
    lower = lambda q, r: F.when((p * q > r) & (r < 1 - F.least(p, q)) & (p <= q), r / q).otherwise(1.0)
    up = F.coalesce(F.array_max(F.transform(sides, raised)), F.lit(0.0))
    down = F.coalesce(F.array_min(F.transform(sides, lambda s: F.least(lower(s.q, s.r), lower(s.r, s.q)))), F.lit(1.0))
    return F.when(up > 0, F.greatest(p, up)).otherwise(F.least(p, down))


def with_triangles(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``triangles``: of each record of a third source that both records are
    compared with, the features (q, r) of those two pairs.  Found once, so the rounds of
    the fit join nothing."""
    edge = lambda u, v: pairs.select(F.col(f"id_{u}").alias("u"), F.col(f"id_{v}").alias("v"), F.col(f"source_{v}").alias("sv"), "x")
    both = edge("a", "b").unionByName(edge("b", "a"))
    one = both.select(F.col("u").alias("id_a"), F.col("v").alias("c"), F.col("sv").alias("sc"), F.col("x").alias("q"))
    two = both.select(F.col("u").alias("id_b"), F.col("v").alias("c"), F.col("x").alias("r"))
    keys = pairs.select("source_a", "id_a", "source_b", "id_b")
    third = (
        keys.join(one, "id_a").where((F.col("sc") != F.col("source_a")) & (F.col("sc") != F.col("source_b")))
        .join(two, ["id_b", "c"]).groupBy("id_a", "id_b").agg(F.collect_list(F.struct("q", "r")).alias("triangles"))
    )
    return pairs.join(third, ["id_a", "id_b"], "left")


def scored(pairs: DataFrame, model: tuple) -> Column:
    sides = F.transform("triangles", lambda t: F.struct(posterior(t.q, model).alias("q"), posterior(t.r, model).alias("r")))
    return obey(posterior(F.col("x"), model), sides)


def fit(pairs: DataFrame, tolerance: float = 1e-3, most: int = 100) -> tuple | None:
    """(weight, means, covariances) of unmatched [0] and matched [1] pairs by EM without
    labels; ends when no weight or mean moves by more than ``tolerance``."""
    d = len(FEATURES)
    x = [F.col("x")[f] for f in FEATURES]
    moments = lambda w: [F.sum(w)] + [F.sum(w * f) for f in x] + [F.sum(w * f * g) for f in x for g in x]

    def component(s: list) -> tuple[float, np.ndarray, np.ndarray]:
        n = max(float(s[0]), 1e-9)
        mean = np.array(s[1 : d + 1], float) / n
        cov = np.array(s[d + 1 :], float).reshape(d, d) / n - np.outer(mean, mean)
        return n, mean, (n * cov + PRIOR_ROWS * PRIOR_VAR * np.eye(d)) / (n + PRIOR_ROWS)

    # The start: near pairs whose kinds meet more often than chance.
    p = F.when((F.col("gap") <= 5) & (F.col("x.kinds") > 1), 0.9).otherwise(0.05)
    model = before = None
    for _ in range(most):
        s = list(pairs.withColumn("p", p).agg(*[c.alias(f"m{i}") for i, c in enumerate(moments(F.col("p")) + moments(1 - F.col("p")))]).first())
        if s[0] is None:
            return None
        k = len(s) // 2
        (n1, m1, c1), (n0, m0, c0) = component(s[:k]), component(s[k:])
        model = (min(max(n1 / (n1 + n0), 1e-4), 1 - 1e-4), (m0, m1), (c0, c1))
        now = np.array([model[0], *m0, *m1])
        if before is not None and np.abs(now - before).max() <= tolerance:
            break
        before, p = now, scored(pairs, model)
    return model


def link_records(records: DataFrame) -> DataFrame:
    """Pairs of records on one happening: (id_a, id_b, confidence), id_a < id_b.

    ``records``: (source, id, kind, place, began, words).  Records of different sources
    at one place within FAR days are compared by the days between them, by how their
    kinds go together (learned from all pairs), and by the words and numbers they share.
    Regularised Gaussian mixtures of matched and unmatched pairs are fitted without
    labels, and in every round the posteriors obey transitivity over the sources.  Pairs
    likelier matched than not are kept; as a happening appears once per source at most, a
    record keeps its likeliest partner per other source, and only if it is that partner's
    likeliest, too (ties: fewer days, then the smaller id).  Records without a place or a day
    match nothing; repeated records count once; empty tables give no row.
    """
    found = candidate_pairs(records.select("source", "id", "kind", "place", "began", "words").distinct())
    found = cut(found.withColumns({"kind_a": F.coalesce("kind_a", F.lit("")), "kind_b": F.coalesce("kind_b", F.lit(""))}))
    compared = cut(
        found.join(_kinds(found), ["source_a", "source_b", "kind_a", "kind_b"], "left")
        .select(
            "source_a", "id_a", "source_b", "id_b", "gap",
            F.struct((F.col("gap") / 4.0).alias("days"), F.coalesce("pmi", F.lit(-1.0)).alias("kinds"), "text").alias("x"),
        )
    )
    pairs = cut(with_triangles(compared))
    model = fit(pairs)
    if model is None:
        return pairs.select("id_a", "id_b", F.lit(0.0).alias("confidence")).limit(0)
    likely = pairs.withColumn("p", scored(pairs, model)).where("p > 0.5")
    best = lambda own, source, other: Window.partitionBy(own, source).orderBy(F.desc("p"), "gap", other)
    kept = likely.withColumns({
        "ra": F.row_number().over(best("id_a", "source_b", "id_b")),
        "rb": F.row_number().over(best("id_b", "source_a", "id_a")),
    }).where("ra = 1 and rb = 1")
    return kept.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), F.round("p", 6).alias("confidence"))
