"""Queries of the panel operators over the star schema, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veska.operators import decompose as dc
from veska.operators import detect as dt
from veska.operators import evaluate as ev
from veska.operators import forecast as fo
from veska.operators import panel as pn
from veska.plans import fixtures as fx
from veska.plans.fixtures import COURSE, EDGES, FIRST, FORECASTS, GROWTH, LAST, MAP, OFFSET, OUTSIDE, OWN, P24, PAIRS, PANEL, RULES, SEASONAL, H, START_MONTH, T, scaled
from veska.session import cut, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("panel_build", f"WITH {PANEL} SELECT entity, category, t, round(v, 4) AS v FROM panel")
def panel_build(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fx.panel_brand(spark, d), v=4)


@query("panel_completeness", f"""WITH {PANEL}, s AS (SELECT entity, category, count(*) AS n FROM panel GROUP BY 1,2), b AS (SELECT max(t)-min(t)+1 AS T FROM panel)
SELECT category, count(*) AS series, count(*) FILTER (n = T) AS complete, CAST(sum(n) AS BIGINT) AS cells FROM s, b GROUP BY 1""")
def panel_completeness(spark: SparkSession, d: str) -> DataFrame:
    return pn.completeness(fx.panel_brand(spark, d))


@query("panel_user_gaps", """WITH c AS (SELECT user_id AS entity, event_type AS category, CAST(day(ts)-1 AS INTEGER) AS t, arg_min(value, (ts, value)) AS v FROM events WHERE month(ts)=1 AND year(ts)=2024 AND value > 0 AND isfinite(value) GROUP BY 1,2,3),
  g AS (SELECT entity, category, CAST(r.t AS INTEGER) AS t FROM (SELECT DISTINCT entity, category FROM c), range(0,31) r(t))
SELECT g.entity, g.category, g.t, round(c.v, 6) AS v FROM g LEFT JOIN c ON g.entity=c.entity AND g.category=c.category AND g.t=c.t""")
def panel_user_gaps(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("year(ts) = 2024 and month(ts) = 1")
    return rounded(pn.grid(pn.build_panel(e, "user_id", "event_type", F.dayofmonth("ts") - 1, "value", "ts"), 31), v=6)


@query("gap_interpolation", """WITH c AS (SELECT user_id AS entity, event_type AS category, CAST(day(ts)-1 AS INTEGER) AS t, sum(value) AS v FROM events WHERE month(ts)=1 AND year(ts)=2024 GROUP BY 1,2,3),
  g AS (SELECT entity, category, CAST(unnest(range(lo, 31)) AS INTEGER) AS t FROM (SELECT entity, category, min(t) AS lo FROM c GROUP BY 1,2)),
  j AS (SELECT g.*, c.v, max(c.t) OVER b AS t0, min(c.t) OVER a AS t1 FROM g LEFT JOIN c ON g.entity=c.entity AND g.category=c.category AND g.t=c.t
    WINDOW b AS (PARTITION BY g.entity, g.category ORDER BY g.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY g.entity, g.category ORDER BY g.t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT j.entity, j.category, j.t, round(CASE WHEN t1 IS NULL OR t0 = t1 THEN x.v ELSE x.v + (y.v - x.v)*(j.t - t0)/(t1 - t0) END, 6) AS v FROM j
  JOIN c x ON x.entity=j.entity AND x.category=j.category AND x.t=j.t0 LEFT JOIN c y ON y.entity=j.entity AND y.category=j.category AND y.t=j.t1""")
def gap_interpolation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("year(ts) = 2024 and month(ts) = 1")
    c = e.groupBy(F.col("user_id").alias("entity"), F.col("event_type").alias("category"), (F.dayofmonth("ts") - 1).alias("t")).agg(F.sum("value").alias("v"))
    g = pn.grid(c, 31)
    return rounded(pn.interpolate(g), v=6)


def _paired(spark: SparkSession, d: str) -> DataFrame:
    panel = _panel(spark, d)
    p = pn.packed(panel, T)
    both = fo.naive(p, FIRST, LAST, H).unionByName(fo.seasonal_naive(p, FIRST, LAST, H))
    return ev.pairs(both, panel)


_METRICS = """SELECT model, h, coalesce(category, 'total') AS category, round(avg(abs(act-f)), 2) AS mae, round(1 - sum((act-f)**2)/(var_pop(act)*count(*)), 6) AS r2,
  round(sum(abs(act-f))/sum(abs(act)), 6) AS wape, count(f) AS n, round(count(f)/count(*), 6) AS coverage FROM pairs"""


def _shown(m: DataFrame) -> DataFrame:
    return rounded(m, mae=2, r2=6, wape=6, coverage=6)


@query("metrics_grouping_sets", f"WITH {P24}, {FORECASTS}, {PAIRS} {_METRICS} GROUP BY GROUPING SETS ((model, h), (model, h, category))")
def metrics_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return _shown(ev.metrics(_paired(spark, d)))


@query("naive_metrics", f"WITH {P24}, {FORECASTS}, {PAIRS} {_METRICS} WHERE model = 'naive' GROUP BY GROUPING SETS ((model, h), (model, h, category))")
def naive_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _shown(ev.metrics(ev.pairs(fo.naive(fx.packed24(spark, d), FIRST, LAST, H), fx.panel24(spark, d))))


@query("seasonal_naive_metrics", f"WITH {P24}, {FORECASTS}, {PAIRS} {_METRICS} WHERE model = 'seasonal_naive' GROUP BY GROUPING SETS ((model, h), (model, h, category))")
def seasonal_naive_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _shown(ev.metrics(ev.pairs(fo.seasonal_naive(fx.packed24(spark, d), FIRST, LAST, H), fx.panel24(spark, d))))


@query("cumulative_mae", f"WITH {P24}, {FORECASTS}, {PAIRS} SELECT model, round(avg(abs(act-f)), 2) AS mae FROM pairs WHERE o + {H} < {T} GROUP BY 1")
def cumulative_mae(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.cumulative_mae(_paired(spark, d), T, H), mae=2)


@query("two_way_effects", f"WITH {P24}, {COURSE} SELECT category, o, t, round(n, 6) AS n FROM course")
def two_way_effects(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dc.course(fx.panel24(spark, d), FIRST, LAST), n=6)


_ROUNDS = ", ".join(f"a{k} AS MATERIALIZED (SELECT entity, category, avg(y - n) AS a FROM c JOIN n{k} USING (category, t) GROUP BY 1,2), n{k + 1} AS MATERIALIZED (SELECT category, t, avg(y - a) AS n FROM c JOIN a{k} USING (entity, category) GROUP BY 1,2)" for k in range(30))


@query("two_way_unbalanced", f"""WITH c AS MATERIALIZED (SELECT user_id AS entity, event_type AS category, day(ts)-1 AS t, ln(arg_min(value, (ts, value))) AS y FROM events WHERE month(ts)=1 AND year(ts)=2024 AND value > 0 AND isfinite(value) GROUP BY 1,2,3),
  n0 AS MATERIALIZED (SELECT category, t, avg(y) AS n FROM c GROUP BY 1,2), {_ROUNDS}, s AS (SELECT category, avg(n) AS s FROM n30 GROUP BY 1)
SELECT entity, category, round(avg(y - n) + any_value(s), 6) AS a FROM c JOIN n30 USING (category, t) JOIN s USING (category) GROUP BY 1,2""")
def two_way_unbalanced(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("year(ts) = 2024 and month(ts) = 1")
    p = pn.build_panel(e, "user_id", "event_type", F.dayofmonth("ts") - 1, "value", "ts")
    a, _ = dc.course_unbalanced(p, 31)
    return rounded(a, a=6)


@query("variance_shares", f"""WITH {P24}, c AS (SELECT category, avg(y) OVER (PARTITION BY entity, category) AS r, avg(y) OVER (PARTITION BY category, t) AS k, avg(y) OVER (PARTITION BY category) AS g, y FROM p24),
  q AS (SELECT category, var_pop(r-g) AS a, var_pop(k-g) AS n, var_pop(y-r-k+g) AS e FROM c GROUP BY 1) SELECT category, round(a/(a+n+e), 6) AS level, round(n/(a+n+e), 6) AS common, round(e/(a+n+e), 6) AS residual FROM q""")
def variance_shares(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pn.shares(_panel(spark, d)), level=6, common=6, residual=6)


@query("yoy_growth", f"WITH {P24} SELECT a.category, round(avg(a.y-b.y), 6) AS growth, round(stddev_samp(a.y-b.y), 6) AS spread FROM p24 a JOIN p24 b ON a.entity=b.entity AND a.category=b.category AND b.t=a.t-12 GROUP BY 1")
def yoy_growth(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pn.yoy_growth(fx.panel24(spark, d)), growth=6, spread=6)


def _factors(spark: SparkSession, d: str) -> DataFrame:
    return dc.seasonal_factors(fx.outside(spark, d), 0, fx.cutoffs(spark))


_OS = f"os AS (SELECT CAST(o AS INTEGER) AS o FROM range({FIRST},{LAST + 1}) r(o))"


@query("seasonal_factors", f"WITH {OUTSIDE}, {_OS}, {SEASONAL} SELECT series, o, CAST(moy AS INTEGER) AS moy, round(s, 6) AS s FROM sf")
def seasonal_factors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_factors(spark, d), s=6)


def _panel(spark: SparkSession, d: str) -> DataFrame:
    """The short panel, materialised: a query of many branches scans the lines once."""
    return cut(fx.panel24(spark, d))


def _growth(spark: SparkSession, d: str, p: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    c = dc.course(p or _panel(spark, d), FIRST, LAST)
    return c, dc.growth(c, fx.outside(spark, d), fx.mapping(spark), OFFSET)


@query("growth_g", f"WITH {P24}, {OUTSIDE}, {MAP}, {COURSE}, {GROWTH} SELECT category, o, round(g, 6) AS g FROM g")
def growth_g(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_growth(spark, d)[1], g=6)


def _rules(spark: SparkSession, d: str, p: DataFrame | None = None) -> DataFrame:
    c, g = _growth(spark, d, p)
    return dc.course_rules(c, g, _factors(spark, d), fx.mapping(spark), H, START_MONTH)


_ALL = f"WITH {P24}, {OUTSIDE}, {MAP}, {COURSE}, {SEASONAL}, {GROWTH}, {RULES}"


def _rule(name: str):
    @query(f"rule_{name}", f"{_ALL} SELECT category, o, h, round({name}, 6) AS n FROM rules")
    def rule(spark: SparkSession, d: str) -> DataFrame:
        return _rules(spark, d).select("category", "o", "h", F.round(name, 6).alias("n"))


for _name in ("snaive", "hybrid", "extlvl"):
    _rule(_name)


@query("rule_airline")
def rule_airline(spark: SparkSession, d: str) -> DataFrame:
    c = dc.course(fx.panel24(spark, d), FIRST, LAST)
    return rounded(dc.airline_rule(c, fx.outside(spark, d), fx.mapping(spark), OFFSET, H), airline=6)


@query("rule_combo")
def rule_combo(spark: SparkSession, d: str) -> DataFrame:
    p = _panel(spark, d)
    c = dc.course(p, FIRST, LAST)
    a = dc.airline_rule(c, fx.outside(spark, d), fx.mapping(spark), OFFSET, H)
    r = _rules(spark, d, p).join(a, ["category", "o", "h"])
    return r.select("category", "o", "h", F.round((F.col("snaive") + F.col("hybrid") + F.col("extlvl") + F.col("airline")) / 4, 6).alias("n"))


@query("choose_external", f"""WITH {P24}, {OUTSIDE}, {COURSE}, dn AS (SELECT category, o, t, n - lag(n) OVER (PARTITION BY category, o ORDER BY t) AS dn FROM course),
  dx AS (SELECT series, t-{OFFSET} AS t, x - lag(x) OVER (PARTITION BY series ORDER BY t) AS dx FROM ext),
  r AS (SELECT category, o, series, sqrt(avg((dn-dx)**2)) AS rmse FROM dn JOIN dx USING (t) WHERE dn IS NOT NULL GROUP BY 1,2,3)
SELECT category, o, arg_min(series, (rmse, series)) AS series, round(min(rmse), 6) AS rmse FROM r GROUP BY 1,2""")
def choose_external(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dc.choose_external(dc.course(fx.panel24(spark, d), FIRST, LAST), fx.outside(spark, d), OFFSET), rmse=6)


_AUTO = GROWTH.replace("FROM map JOIN ext USING (series), os GROUP BY", "FROM map JOIN ext USING (series) GROUP BY")
_AUTO_RULES = RULES.replace("JOIN map USING (category)", "JOIN map ON map.category=c.category AND map.o=c.o")
_CHOICE = ORACLE["choose_external"].removeprefix(f"WITH {P24}, {OUTSIDE}, {COURSE}, ")


@query("rule_hybrid_automap", f"WITH {P24}, {OUTSIDE}, {COURSE}, map AS (WITH {_CHOICE}), {SEASONAL}, {_AUTO}, {_AUTO_RULES} SELECT category, o, h, round(hybrid, 6) AS n FROM rules")
def rule_hybrid_automap(spark: SparkSession, d: str) -> DataFrame:
    """The hybrid rule with the outside series chosen anew at each origin."""
    c = cut(dc.course(fx.panel24(spark, d), FIRST, LAST))
    ext = cut(fx.outside(spark, d))
    chosen = cut(dc.choose_external(c, ext, OFFSET).select("category", "o", "series"))
    factors = dc.seasonal_factors(ext, 0, fx.cutoffs(spark))
    out = dc.course_rules(c, dc.growth(c, ext, chosen, OFFSET), factors, chosen, H, START_MONTH)
    return out.select("category", "o", "h", F.round("hybrid", 6).alias("n"))


def _trajectory(spark: SparkSession, d: str, rule: str = "hybrid", p: DataFrame | None = None) -> DataFrame:
    p = p or _panel(spark, d)
    c = dc.course(p, FIRST, LAST)
    ordered = lambda t, x: F.transform(F.array_sort(F.collect_list(F.struct(t, x))), lambda s: s[x])
    return c.groupBy("category", "o").agg(ordered("t", "n").alias("n")).join(_rules(spark, d, p).groupBy("category", "o").agg(ordered("h", rule).alias("nf")), ["category", "o"])


def _panel_seasonal(spark: SparkSession, d: str, p: DataFrame | None = None) -> DataFrame:
    p = p or _panel(spark, d)
    logs = pn.packed(p.withColumn("v", F.log("v")), T)
    return fo.panel_seasonal(logs, _trajectory(spark, d, p=p), FIRST, LAST, H)


_SEASONAL_FC = """aa AS (SELECT entity, category, o, avg(y) AS a FROM p24, os WHERE t <= o GROUP BY 1,2,3),
  zz AS (SELECT p.entity, p.category, c.o, c.t, y - n - a AS z FROM p24 p JOIN course c ON c.category=p.category AND c.t=p.t JOIN aa ON aa.entity=p.entity AND aa.category=p.category AND aa.o=c.o),
  zl AS (SELECT entity, category, o, arg_max(z, t) AS z FROM zz GROUP BY 1,2,3),
  ps AS (SELECT 'panel_seasonal' AS model, l.o, l.entity, l.category, r.h, exp(a + hybrid + coalesce(0.6**r.h*l.z + (1-0.6**r.h)*b.z, 0.6**r.h*l.z)) AS f
    FROM zl l JOIN aa ON aa.entity=l.entity AND aa.category=l.category AND aa.o=l.o JOIN rules r ON r.category=l.category AND r.o=l.o
    LEFT JOIN zz b ON b.entity=l.entity AND b.category=l.category AND b.o=l.o AND b.t=l.o+r.h-12)"""


@query("panel_seasonal_forecast", f"{_ALL}, {_SEASONAL_FC} SELECT model, o, entity, category, h, round(f, 2) AS f FROM ps")
def panel_seasonal_forecast(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_panel_seasonal(spark, d), f=2)


def _members(spark: SparkSession, d: str, p: DataFrame | None = None) -> DataFrame:
    p = p or _panel(spark, d)
    q = pn.packed(p, T)
    return fo.naive(q, FIRST, LAST, H).unionByName(fo.seasonal_naive(q, FIRST, LAST, H)).unionByName(_panel_seasonal(spark, d, p))


_ENSEMBLE = f"{_ALL}, {_SEASONAL_FC}, {FORECASTS}, al AS (SELECT * FROM fc UNION ALL SELECT * FROM ps)"


@query("ensemble_geo_mean", f"{_ENSEMBLE} SELECT 'ensemble' AS model, o, entity, category, h, round(exp(avg(ln(f))), 2) AS f FROM al GROUP BY ALL")
def ensemble_geo_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fo.ensemble(_members(spark, d), ["naive", "seasonal_naive", "panel_seasonal"]), f=2)


_SHA = "sha256(string_agg({}, chr(10) ORDER BY {}))"


@query("frozen_forecast", f"""{_ENSEMBLE}, en AS (SELECT entity, category, h, exp(avg(ln(f))) AS f FROM al WHERE o = {LAST} GROUP BY ALL), pe AS (SELECT entity, category, count(*) AS n, {_SHA.format("entity || '|' || category || '|' || h || '|' || printf('%.1f', round(f, 1))", "h")} AS s FROM en GROUP BY 1,2),
  pp AS (SELECT category, substr(md5(entity), 1, 3) AS p, sum(n) AS n, {_SHA.format("s", "entity")} AS s FROM pe GROUP BY 1,2) SELECT category, CAST(sum(n) AS BIGINT) AS rows, {_SHA.format("s", "p")} AS sha FROM pp GROUP BY 1""")
def frozen_forecast(spark: SparkSession, d: str) -> DataFrame:
    e = fo.ensemble(_members(spark, d), ["naive", "seasonal_naive", "panel_seasonal"])
    return fo.freeze(e.where(F.col("o") == LAST))


@query("random_walk_vs_oracle", f"""WITH {P24}, {COURSE}, w AS (SELECT category, t, m - avg(m) OVER (PARTITION BY category) AS n FROM m),
  q AS (SELECT p.entity, p.category, os.o, h.h, exp(p.y) AS flat, exp(p.y + b.n - a.n) AS oracle, x.v AS act FROM p24 p JOIN os ON p.t=os.o CROSS JOIN hs h
    JOIN w a ON a.category=p.category AND a.t=os.o JOIN w b ON b.category=p.category AND b.t=os.o+h.h JOIN p24 x ON x.entity=p.entity AND x.category=p.category AND x.t=os.o+h.h)
SELECT h, round(avg(abs(act-flat)), 2) AS flat, round(avg(abs(act-oracle)), 2) AS oracle FROM q GROUP BY 1""")
def random_walk_vs_oracle(spark: SparkSession, d: str) -> DataFrame:
    p = fx.packed24(spark, d)
    flat = ev.pairs(fo.naive(p, FIRST, LAST, H), fx.panel24(spark, d))
    w = dc.course(fx.panel24(spark, d), T - 1, T - 1).groupBy("category").agg(F.map_from_entries(F.collect_list(F.struct("t", "n"))).alias("n"))
    q = flat.join(F.broadcast(w), "category").withColumn("oracle", F.col("f") * F.exp(F.try_element_at("n", F.col("o") + F.col("h")) - F.try_element_at("n", F.col("o"))))
    return q.groupBy("h").agg(F.round(F.avg(F.abs(F.col("y") - F.col("f"))), 2).alias("flat"), F.round(F.avg(F.abs(F.col("y") - F.col("oracle"))), 2).alias("oracle"))


@query("regional_share", f"""WITH {P24}, q AS (SELECT category, substr(entity,7,1) AS region, t, y - avg(y) OVER (PARTITION BY entity, category) - avg(y) OVER (PARTITION BY category, t) + avg(y) OVER (PARTITION BY category) AS z FROM p24),
  r AS (SELECT *, avg(z) OVER (PARTITION BY category, region, t) AS r FROM q) SELECT category, round(var_pop(r)/var_pop(z), 6) AS share FROM r GROUP BY 1""")
def regional_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dc.regional(_panel(spark, d), fx.regions(spark, d)), share=6)


@query("growth_regression", f"""WITH {OUTSIDE}, s AS (SELECT series, t, CASE WHEN count(x) OVER w = 12 THEN ln(sum(exp(x)) OVER w) END AS s FROM ext WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
  g AS (SELECT series, t, s - lag(s, 12) OVER (PARTITION BY series ORDER BY t) AS g FROM s), p AS (SELECT series, g, lag(g, 12) OVER (PARTITION BY series ORDER BY t) AS g1 FROM g)
SELECT series, round(regr_slope(g, g1), 6) AS slope, round(regr_intercept(g, g1), 6) AS intercept, round(regr_r2(g, g1), 6) AS r2 FROM p WHERE g IS NOT NULL AND g1 IS NOT NULL GROUP BY 1""")
def growth_regression(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dc.growth_regression(fx.outside(spark, d)), slope=6, intercept=6, r2=6)


@query("neighbours_topk", f"WITH {EDGES} SELECT a, b, round(distance, 4) AS distance, CAST(rank AS INTEGER) AS rank FROM near")
def neighbours_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pn.neighbours(fx.edges(spark, d), 5), distance=4)


@query("neighbour_mean_diff", f"WITH {P24}, {EDGES} SELECT a AS entity, category, t, round(avg(y), 6) AS nb, count(*) AS n FROM near JOIN p24 ON p24.entity = near.b GROUP BY 1,2,3")
def neighbour_mean_diff(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pn.neighbour_mean(fx.panel24(spark, d).withColumn("y", F.log("v")), pn.neighbours(fx.edges(spark, d), 5), "y"), nb=6)


@query("lag_features", f"""WITH {P24} SELECT entity, category, t, round(y,6) AS z0, round(lag(y) OVER w,6) AS z1, round(lag(y,2) OVER w,6) AS z2, round(lag(y,12) OVER w,6) AS z12,
  round(y-lag(y) OVER w,6) AS dz1, round(y-lag(y,3) OVER w,6) AS dz3, round(avg(y) OVER r,6) AS ma, count(y) OVER r AS nobs FROM p24
  WINDOW w AS (PARTITION BY entity, category ORDER BY t), r AS (PARTITION BY entity, category ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def lag_features(spark: SparkSession, d: str) -> DataFrame:
    f = fo.lag_features(fx.panel24(spark, d).withColumn("y", F.log("v")), "y")
    return rounded(f, z0=6, z1=6, z2=6, z12=6, dz1=6, dz3=6, ma=6)


@query("noise_scale_mad", f"WITH {P24}, {OWN}, {scaled('own')} SELECT entity, category, round(k, 6) AS k FROM k")
def noise_scale_mad(spark: SparkSession, d: str) -> DataFrame:
    own = dt._own(fx.panel24(spark, d), 8)
    return rounded(pn.noise_scale(own.where("t < 8"), "l"), k=6)


_Z = f"WITH {P24}, {OWN}, {scaled('own')}"


def _z(spark: SparkSession, d: str) -> DataFrame:
    return dt.prepare(_panel(spark, d), 8)


@query("normalised_panel", f"{_Z} SELECT entity, category, t, round(z, 4) AS z FROM z")
def normalised_panel(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_z(spark, d), z=4)


@query("normalised_relative", f"""WITH {P24}, {EDGES}, {OWN}, oc AS (SELECT entity, category, t, l - avg(l) FILTER (t < 8) OVER (PARTITION BY entity, category) AS l FROM own),
  nb AS (SELECT a AS entity, category, t, avg(l) AS nb FROM near JOIN oc ON oc.entity=near.b GROUP BY 1,2,3), rel AS (SELECT entity, category, t, l - nb AS l FROM oc JOIN nb USING (entity, category, t)),
  {scaled('rel')} SELECT entity, category, t, round(z, 4) AS z FROM z""")
def normalised_relative(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dt.prepare_relative(_panel(spark, d), pn.neighbours(fx.edges(spark, d), 5), 8), z=4)


@query("cusum_scores", f"""WITH RECURSIVE {P24}, {OWN}, {scaled('own')}, lg AS (SELECT *, lag(z) OVER (PARTITION BY entity, category ORDER BY t) AS b FROM z),
  rho AS (SELECT sum(z*b)/sum(b*b) AS rho FROM lg WHERE t BETWEEN 1 AND 7), r AS (SELECT entity, category, t, z - rho*b AS r FROM lg, rho),
  sd0 AS (SELECT entity, category, stddev_pop(r) AS sd FROM r WHERE t BETWEEN 1 AND 7 GROUP BY 1,2), sd AS (SELECT entity, category, CASE WHEN sd > 0 THEN sd ELSE (SELECT median(sd) FROM sd0) END AS sd FROM sd0),
  e AS (SELECT entity, category, t, r/sd AS e FROM r JOIN sd USING (entity, category)),
  c AS (SELECT entity, category, 7 AS t, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn FROM sd UNION ALL
    SELECT c.entity, c.category, c.t+1, greatest(0, c.up + e.e - 0.5), greatest(0, c.dn - e.e - 0.5) FROM c JOIN e ON e.entity=c.entity AND e.category=c.category AND e.t=c.t+1)
SELECT z.entity, z.category, z.t, round(CASE WHEN z.t < 8 THEN 0 ELSE greatest(up, dn) END, 4) AS s FROM z LEFT JOIN c ON c.entity=z.entity AND c.category=z.category AND c.t=z.t""")
def cusum_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dt.cusum(_z(spark, d), T), s=4)


_LAM, _PHI = 0.1, 0.5


def _kalman(lam: float, phi: float, name: str = "kf") -> str:
    """CTE of the filter: the state, innovation and variance of each series and period."""
    first = f"(1/greatest(1-{phi}*{phi}, 1e-3))"
    return f"""{name} AS (SELECT entity, category, 0 AS t, z*10000/(10000+{first}) AS m0, z*{first}/(10000+{first}) AS m1,
    10000-10000.0*10000/(10000+{first}) AS p00, -10000*{first}/(10000+{first}) AS p01, {first}-{first}*{first}/(10000+{first}) AS p11, NULL::DOUBLE AS v, NULL::DOUBLE AS f FROM z WHERE t=0
  UNION ALL SELECT entity, category, t, q0+(q00+q01)/f*v, q1+(q01+q11)/f*v, q00-(q00+q01)*(q00+q01)/f, q01-(q00+q01)*(q01+q11)/f, q11-(q01+q11)*(q01+q11)/f, v, f
  FROM (SELECT z.entity, z.category, z.t, m0 AS q0, {phi}*m1 AS q1, p00+{lam} AS q00, {phi}*p01 AS q01, {phi}*{phi}*p11+1 AS q11,
     z.z - m0 - {phi}*m1 AS v, p00+{lam}+2*{phi}*p01+{phi}*{phi}*p11+1 AS f FROM {name} JOIN z ON z.entity={name}.entity AND z.category={name}.category AND z.t={name}.t+1))"""


_KALMAN = _kalman(_LAM, _PHI)
_ZR = f"WITH RECURSIVE {P24}, {OWN}, {scaled('own')}"


@query("kalman_filter_fixed", f"""{_ZR}, {_KALMAN}, w AS (SELECT entity, category, sum(v*v/f) AS ss, sum(ln(f)) AS ld FROM kf GROUP BY 1,2)
SELECT entity, category, round(m0,4) AS m0, round(m1,4) AS m1, round(p00,4) AS p00, round(p01,4) AS p01, round(p11,4) AS p11, round(ss,3) AS ss, round(ld,3) AS ld FROM kf JOIN w USING (entity, category) WHERE t = {T - 1}""")
def kalman_filter_fixed(spark: SparkSession, d: str) -> DataFrame:
    k = dt.local_states(_z(spark, d), T, _LAM, _PHI)
    fold = lambda f: F.aggregate(F.zip_with("v", "f", f), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    k = k.withColumns({"ss": fold(lambda v, f: v * v / f), "ld": fold(lambda v, f: F.log(f))})
    return rounded(k.drop("v", "f"), m0=4, m1=4, p00=4, p01=4, p11=4, ss=3, ld=3)


@query("kalman_likelihood", f"{_ZR}, {_KALMAN} SELECT category, round(sum(v*v/f)/count(v), 5) AS scale, round(count(v)*ln(sum(v*v/f)/count(v))+sum(ln(f)), 2) AS loss, count(v) AS nobs FROM kf GROUP BY 1")
def kalman_likelihood(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dt.likelihood(dt.local_states(_z(spark, d), T, _LAM, _PHI), ["category"]), scale=5, loss=2)


@query("ssm_lr_scores", f"""{_ZR}, {_KALMAN}, sc AS (SELECT category, sum(v*v/f)/count(v) AS s FROM kf GROUP BY 1),
  st AS (SELECT DISTINCT CAST(tau AS INTEGER) AS tau FROM range(6,{T}) r(tau)),
  xf AS (SELECT tau, 0 AS t, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS x1, 10000-10000.0*10000/(10000+1/0.75) AS p00, -10000*(1/0.75)/(10000+1/0.75) AS p01, 1/0.75-(1/0.75)*(1/0.75)/(10000+1/0.75) AS p11, 0.0::DOUBLE AS v, 1.0::DOUBLE AS f FROM st
    UNION ALL SELECT tau, t, q0+(q00+q01)/f*v, q1+(q01+q11)/f*v, q00-(q00+q01)*(q00+q01)/f, q01-(q00+q01)*(q01+q11)/f, q11-(q01+q11)*(q01+q11)/f, v, f
    FROM (SELECT tau, t+1 AS t, x0 AS q0, {_PHI}*x1 AS q1, p00+{_LAM} AS q00, {_PHI}*p01 AS q01, {_PHI}*{_PHI}*p11+1 AS q11, (CASE WHEN t+1 >= tau THEN 1.0 ELSE 0.0 END) - x0 - {_PHI}*x1 AS v,
       p00+{_LAM}+2*{_PHI}*p01+{_PHI}*{_PHI}*p11+1 AS f FROM xf WHERE t+1 < {T})),
  lr AS (SELECT entity, category, tau, kf.t, sum(kf.v*xf.v/kf.f) OVER w AS num, sum(xf.v*xf.v/xf.f) OVER w AS den FROM kf JOIN xf ON xf.t=kf.t AND xf.t >= tau WINDOW w AS (PARTITION BY entity, category, tau ORDER BY kf.t))
SELECT kf.entity, kf.category, kf.t, round(coalesce(max(CASE WHEN den > 1e-9 THEN num*num/den/s ELSE 0 END), 0), 4) AS s
FROM kf JOIN sc USING (category) LEFT JOIN lr ON lr.entity=kf.entity AND lr.category=kf.category AND lr.t=kf.t AND lr.t < lr.tau+3 GROUP BY 1,2,3""")
def ssm_lr_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dt.step_ratio(_z(spark, d), T, _LAM, _PHI), s=4)


def run_length_sql(extra: str = "", hazard: str = "1.0/24") -> str:
    """The detector with all run lengths of a series as lists in one row; ``extra`` CTEs may
    change the hazard of a cell."""
    seen = "list_transform(range(1, len(lr) + 1), lambda i: lr[i] - 0.5*(ln(2*pi()*(va[i]+1)) + (x-mu[i])**2/(va[i]+1)))"
    lse = lambda a: f"(list_max({a}) + ln(list_sum(list_transform({a}, lambda q: exp(q - list_max({a}))))))"
    return f"""{_ZR}{extra}, bo AS (SELECT entity, category, -1 AS t, [0.0::DOUBLE] AS lr, [0.0::DOUBLE] AS mu, [9.0::DOUBLE] AS va, 0.0::DOUBLE AS s FROM z WHERE t = 0 UNION ALL
  SELECT entity, category, t, lr, mu, va, {lse("lr[1:3]")} - (CASE WHEN len(lr) > 3 THEN {lse("lr[4:]")} ELSE -50.0 END) FROM (
    SELECT entity, category, t, list_transform(w, lambda q: q - {lse("w")}) AS lr, list_prepend(0.0::DOUBLE, list_transform(range(1, len(mu) + 1), lambda i: va[i]/(va[i]+1)*(mu[i]/va[i] + x))) AS mu, list_prepend(9.0::DOUBLE, list_transform(va, lambda q: q/(q+1))) AS va FROM (
      SELECT entity, category, t, x, mu, va, list_prepend({lse("se")} + ln(hz), list_transform(se, lambda q: q + ln(1-hz))) AS w FROM (
        SELECT bo.entity, bo.category, z.t, z.z AS x, mu, va, {hazard} AS hz, {seen.replace("x-mu", "z.z-mu")} AS se FROM bo JOIN z ON z.entity=bo.entity AND z.category=bo.category AND z.t=bo.t+1))))
SELECT entity, category, t, round(s, 4) AS s FROM bo WHERE t >= 0"""


@query("bocpd_scores", run_length_sql())
def bocpd_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dt.run_length(_z(spark, d), T), s=4)


@query("pelt_scores")
def pelt_scores(spark: SparkSession, d: str) -> DataFrame:
    return dt.segmentation(_z(spark, d), T)


@query("ssm_fit")
def ssm_fit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dt.fit_categories(_z(spark, d), T), lam=4, phi=4, loss=2)


_GRID = [(lam, phi) for lam in (0.01, 0.1, 1.0) for phi in (0.2, 0.6)]
_LOSSES = " UNION ALL ".join(f"SELECT category, {lam}::DOUBLE AS lam, {phi}::DOUBLE AS phi, count(v)*ln(sum(v*v/f)/count(v))+sum(ln(f)) AS loss FROM kg{i} GROUP BY 1" for i, (lam, phi) in enumerate(_GRID))


@query("ssm_fit_grid", f"{_ZR}, {', '.join(_kalman(lam, phi, f'kg{i}') for i, (lam, phi) in enumerate(_GRID))}, l AS ({_LOSSES}) SELECT category, arg_min(lam, loss) AS lam, arg_min(phi, loss) AS phi, round(min(loss), 2) AS loss FROM l GROUP BY 1")
def ssm_fit_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dt.fit_grid(_z(spark, d), T, _GRID), loss=2)


_ALPHAS = [0.05, 0.1, 0.2]


_SCORE = f"{_Z}, s AS (SELECT entity, category, t, abs(z) AS s FROM z)"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return _z(spark, d).select("entity", "category", "t", F.abs("z").alias("s"))


@query("calibrated_thresholds", f"""{_SCORE}, tr AS (SELECT DISTINCT entity, category, substr(entity,8,1) IN ('1','2') AS inj, 10 AS tau FROM s),
  tops AS (SELECT entity, category, max(s) AS m FROM s JOIN tr USING (entity, category) WHERE t >= 8 AND NOT inj GROUP BY 1,2),
  thr AS (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE]) AS alpha, unnest(quantile_cont(m, [0.95, 0.9, 0.8])) AS threshold FROM tops),
  f AS (SELECT alpha, threshold, entity, category, inj, tau, min(t) FILTER (s > threshold) AS f FROM s JOIN tr USING (entity, category), thr WHERE t >= 8 GROUP BY ALL),
  q AS (SELECT alpha, threshold, count(*) FILTER (inj) AS ni, count(*) FILTER (inj AND f BETWEEN tau AND tau+2) AS tp, count(*) FILTER (NOT inj AND f IS NOT NULL) AS fp, count(*) FILTER (inj AND f < tau) AS ea, avg(f-tau) FILTER (inj AND f BETWEEN tau AND tau+2) AS delay FROM f GROUP BY 1,2)
SELECT alpha, round(threshold,4) AS threshold, round(tp/ni,6) AS recall, round(tp/greatest(tp+fp+ea,1),6) AS precision, round(delay,4) AS delay, round(ea/ni,6) AS early FROM q""")
def calibrated_thresholds(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d)
    truth = s.select("entity", "category", F.substring("entity", 8, 1).isin("1", "2").alias("inj"), F.lit(10).alias("tau")).distinct()
    return rounded(dt.calibrated(s, truth, 8, _ALPHAS), threshold=4, recall=6, precision=6, delay=4, early=6)


@query("first_alarm", f"{_SCORE} SELECT entity, category, min(t) FILTER (s > 3) AS first FROM s WHERE t >= 8 GROUP BY 1,2")
def first_alarm(spark: SparkSession, d: str) -> DataFrame:
    return dt.first_alarm(_scores(spark, d), F.lit(3.0), 8)


@query("top_alarms", f"""{_SCORE}, b AS (SELECT entity, category, max(s) AS m FROM s WHERE t >= 8 GROUP BY 1,2)
SELECT b.entity, b.category, min(t) AS t, round(m, 4) AS s FROM b JOIN s ON s.entity=b.entity AND s.category=b.category AND s.s=m AND t >= 8 GROUP BY b.entity, b.category, m ORDER BY m DESC, 1, 2 LIMIT 20""")
def top_alarms(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dt.top_alarms(_scores(spark, d), 20, 8), s=4)


@query("pauc", """WITH c AS (SELECT l_returnflag AS k, l_linenumber/7.0 AS x, avg(l_discount)*10 AS y FROM lineitem GROUP BY 1, l_linenumber)
SELECT k, round(sum((x - lx)*(y + ly)/2)/0.8, 6) AS pauc FROM (SELECT k, x, y, lag(x,1,0.0) OVER w AS lx, lag(y,1,0.0) OVER w AS ly FROM c WHERE x <= 0.8 WINDOW w AS (PARTITION BY k ORDER BY x)) GROUP BY 1""")
def pauc(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k"), (F.col("l_linenumber") / 7.0).alias("x")).agg((F.avg("l_discount") * 10).alias("y"))
    return rounded(dt.partial_area(c, ["k"], "x", "y", 0.8), pauc=6)


@query("dm_statistic", f"""WITH {P24}, {FORECASTS}, {PAIRS}, d AS (SELECT a.o, a.entity, a.h, abs(a.act-a.f)-abs(b.act-b.f) AS dl FROM pairs a JOIN pairs b USING (o, entity, category, h) WHERE a.model='naive' AND b.model='seasonal_naive'),
  so AS (SELECT h, o, avg(dl) AS s FROM d GROUP BY 1,2), u AS (SELECT h, row_number() OVER (PARTITION BY h ORDER BY o) AS k, s - avg(s) OVER (PARTITION BY h) AS u, count(*) OVER (PARTITION BY h) AS T, avg(s) OVER (PARTITION BY h) AS ms FROM so),
  vv AS (SELECT a.h, a.T, a.ms, sum(CASE WHEN a.k=b.k THEN 1 ELSE 2*(1-(a.k-b.k)/greatest(least(a.h-1,a.T-2)+1,1)) END * a.u*b.u)/a.T AS v FROM u a JOIN u b ON a.h=b.h AND a.k-b.k BETWEEN 0 AND greatest(least(a.h-1,a.T-2),0) GROUP BY 1,2,3),
  cl AS (SELECT h, avg(g)/nullif(stddev_samp(g)/sqrt(count(*)), 0) AS dm, count(*) AS n FROM (SELECT h, o, entity, sum(dl) AS g FROM d GROUP BY 1,2,3) GROUP BY 1), mm AS (SELECT h, avg(dl) AS mean_diff FROM d GROUP BY 1)
SELECT h, round(mean_diff,2) AS mean_diff, round(CASE WHEN T >= 4 THEN ms/sqrt(greatest(v,1e-12)/T) ELSE cl.dm END, 4) AS dm, CASE WHEN T >= 4 THEN T ELSE n END AS units FROM mm JOIN vv USING (h) JOIN cl USING (h)""")
def dm_statistic(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.diebold_mariano(cut(_paired(spark, d)), "naive", "seasonal_naive").drop("by_unit"), mean_diff=2, dm=4)


_ZQ = ev.winkler_quantile(0.8)


@query("interval_score", f"""WITH {P24}, {FORECASTS}, {PAIRS}, i AS (SELECT model, h, act, f*exp(-{_ZQ}*0.1*sqrt(h)) AS lo, f*exp({_ZQ}*0.1*sqrt(h)) AS hi FROM pairs)
SELECT model, h, round(avg(CASE WHEN act BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END),6) AS coverage, round(avg(hi-lo),2) AS width, round(avg(hi-lo+CASE WHEN act < lo THEN 10*(lo-act) WHEN act > hi THEN 10*(act-hi) ELSE 0 END),1) AS winkler FROM i GROUP BY 1,2""")
def interval_score(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = ev.lognormal_interval(F.col("f"), F.lit(0.1) * F.sqrt("h"), 0.8)
    return rounded(ev.interval_score(_paired(spark, d).withColumns({"lo": lo, "hi": hi}), "y", "lo", "hi", 0.8, ["model", "h"]), coverage=6, width=2, winkler=1)


@query("national_known_errors", f"""WITH {OUTSIDE}, {_OS}, hs AS (SELECT CAST(h AS INTEGER) AS h FROM range(1,{H + 1}) r(h)), e AS (SELECT a.series, a.t AS o2, h, (b.x-a.x)**2 AS e FROM ext a, hs JOIN ext b ON true WHERE b.series=a.series AND b.t=a.t+h AND a.t >= 40)
SELECT series, o, h, round(avg(e),6) AS mse, count(*) AS n FROM e, os WHERE o2+h <= o+{OFFSET} GROUP BY 1,2,3""")
def national_known_errors(spark: SparkSession, d: str) -> DataFrame:
    x = fx.outside(spark, d)
    later = x.select("series", F.col("t").alias("t2"), F.col("x").alias("x2"))
    e = x.where("t >= 40").withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(H)))).withColumn("t2", F.col("t") + F.col("h")).join(later, ["series", "t2"])
    e = e.select("series", F.col("t").alias("o2"), "h", F.pow(F.col("x2") - F.col("x"), 2).alias("e"))
    known = e.join(F.broadcast(fx.cutoffs(spark)), F.col("o2") + F.col("h") <= F.col("upto"))
    return known.groupBy("series", "o", "h").agg(F.round(F.avg("e"), 6).alias("mse"), F.count("*").alias("n"))


_RANKS = f"""{_ENSEMBLE}, pr AS (SELECT al.model, al.h, al.category, avg(abs(a.v-al.f)) AS s FROM al JOIN p24 a ON a.entity=al.entity AND a.category=al.category AND a.t=al.o+al.h GROUP BY 1,2,3),
  rk AS (SELECT h, category, model, row_number() OVER (PARTITION BY h, category ORDER BY s, model) AS place FROM pr), pw AS (SELECT a.model AS a, b.model AS b, count(*) FILTER (a.place < b.place) AS n FROM rk a JOIN rk b ON a.h=b.h AND a.category=b.category AND a.model <> b.model GROUP BY 1,2)"""


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    panel = _panel(spark, d)
    p = ev.pairs(_members(spark, d, panel), panel)
    return cut(ev.model_ranks(p.groupBy("h", "category", "model").agg(F.avg(F.abs(F.col("y") - F.col("f"))).alias("s")), ["h", "category"], "s"))


@query("rank_cells", f"{_RANKS} SELECT h, category, model, CAST(place AS INTEGER) AS place FROM rk")
def rank_cells(spark: SparkSession, d: str) -> DataFrame:
    return _ranks(spark, d)


@query("borda", f"{_RANKS} SELECT model, points, CAST(rank() OVER (ORDER BY points) AS INTEGER) AS rank FROM (SELECT model, CAST(sum(place) AS BIGINT) AS points FROM rk GROUP BY 1)")
def borda(spark: SparkSession, d: str) -> DataFrame:
    return ev.borda(_ranks(spark, d))


@query("pairwise", f"{_RANKS} SELECT * FROM pw")
def pairwise(spark: SparkSession, d: str) -> DataFrame:
    return ev.pairwise(_ranks(spark, d), ["h", "category"])


@query("copeland", f"{_RANKS} SELECT model, score, CAST(rank() OVER (ORDER BY score DESC) AS INTEGER) AS rank FROM (SELECT x.a AS model, CAST(sum(sign(x.n-y.n)) AS BIGINT) AS score FROM pw x JOIN pw y ON x.a=y.b AND x.b=y.a GROUP BY 1)")
def copeland(spark: SparkSession, d: str) -> DataFrame:
    return ev.copeland(ev.pairwise(_ranks(spark, d), ["h", "category"]))


@query("threshold_rule", f"{_RANKS} SELECT model, CAST(row_number() OVER (ORDER BY c3, c2, c1, model) AS INTEGER) AS place FROM (SELECT model, count(*) FILTER (place=3) AS c3, count(*) FILTER (place=2) AS c2, count(*) FILTER (place=1) AS c1 FROM rk GROUP BY 1)")
def threshold_rule(spark: SparkSession, d: str) -> DataFrame:
    return ev.threshold_rule(_ranks(spark, d), 3)


@query("condorcet", f"{_RANKS} SELECT x.a AS model FROM pw x JOIN pw y ON x.a=y.b AND x.b=y.a GROUP BY 1 HAVING min(CASE WHEN x.n > y.n THEN 1 ELSE 0 END) = 1")
def condorcet(spark: SparkSession, d: str) -> DataFrame:
    return ev.condorcet(ev.pairwise(_ranks(spark, d), ["h", "category"]))


@query("common_series_losses", f"""{_ENSEMBLE}, pr AS (SELECT al.*, abs(a.v-al.f) AS loss, count(*) OVER (PARTITION BY al.o, al.entity, al.category, al.h) AS c FROM al JOIN p24 a ON a.entity=al.entity AND a.category=al.category AND a.t=al.o+al.h)
SELECT entity, model, round(sum(loss), 4) AS s, count(*) AS n FROM pr WHERE c = 3 GROUP BY 1,2""")
def common_series_losses(spark: SparkSession, d: str) -> DataFrame:
    panel = _panel(spark, d)
    p = ev.pairs(_members(spark, d, panel), panel)
    return rounded(ev.cluster_sums(ev.common_losses(p, ["naive", "seasonal_naive", "panel_seasonal"])), s=4)


@query("kemeny")
def kemeny(spark: SparkSession, d: str) -> DataFrame:
    return kemeny_order(ev.pairwise(_ranks(spark, d), ["h", "category"]))


def kemeny_order(pairwise_wins: DataFrame) -> DataFrame:
    import numpy as np

    from veska.operators.kernels import kemeny as order

    spark, rows = pairwise_wins.sparkSession, pairwise_wins.collect()  # one row per pair of models
    names = sorted({r["a"] for r in rows})
    wins = np.zeros((len(names), len(names)))
    for r in rows:
        wins[names.index(r["a"]), names.index(r["b"])] = r["n"]
    return spark.createDataFrame([(names[m], i + 1) for i, m in enumerate(order(wins))], "model string, place int")


@query("mcs")
def mcs(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    from veska.operators.kernels import confidence_set

    panel = _panel(spark, d)
    p = ev.pairs(_members(spark, d, panel), panel)
    sums = cut(ev.cluster_sums(ev.common_losses(p, ["naive", "seasonal_naive", "panel_seasonal"])))
    total = {r["model"]: (r["s"], r["n"]) for r in sums.groupBy("model").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
    names = sorted(total)
    boot = np.zeros((1000, len(names)))
    for r in ev.bootstrap_means(sums, 1000).collect():  # draws x models
        boot[r["b"], names.index(r["model"])] = r["d"]
    p_values = confidence_set(np.array([total[m][0] for m in names]), np.array([total[m][1] for m in names], float), boot, 0.1)
    return spark.createDataFrame([(m, float(round(x, 4))) for m, x in zip(names, p_values)], "model string, p double")


def _logs(spark: SparkSession, d: str) -> DataFrame:
    return pn.packed(fx.panel24(spark, d).withColumn("v", F.log("v")), T)


@query("panel_ssm_forecast")
def panel_ssm_forecast(spark: SparkSession, d: str) -> DataFrame:
    from veska.operators.local_model import panel_ssm

    out = panel_ssm(_logs(spark, d), cut(_trajectory(spark, d)), FIRST, LAST, H)
    return rounded(out, f=2, var=6)


@query("ssm_intervals")
def ssm_intervals(spark: SparkSession, d: str) -> DataFrame:
    from veska.operators.local_model import panel_ssm, with_intervals

    f = panel_ssm(_logs(spark, d), cut(_trajectory(spark, d)), FIRST, LAST, H)
    wide = with_intervals(f, cut(national_known_errors(spark, d)), fx.mapping(spark), 0.8)
    scored = ev.interval_score(ev.pairs(wide, fx.panel24(spark, d)), "y", "lo", "hi", 0.8, ["model", "h"])
    return rounded(scored, coverage=6, width=2, winkler=1)


@query("gbm_forecast")
def gbm_forecast(spark: SparkSession, d: str) -> DataFrame:
    from veska.operators.local_model import boosted, boosted_features

    near = pn.neighbours(fx.edges(spark, d), 10)
    features = cut(boosted_features(_logs(spark, d), cut(_trajectory(spark, d)), fx.market_access(spark, d), near, FIRST, LAST))
    out = boosted(features, H, START_MONTH)
    return rounded(out, f=4)


@query("seasonally_adjusted_naive", f"""WITH {P24}, {OUTSIDE}, {_OS.replace('os AS', 'os0 AS')}, {SEASONAL.replace(', os', ', os0')}, f0 AS (SELECT moy, s FROM sf WHERE series='total' AND o={LAST}),
  a AS (SELECT entity, category, t, v/exp(s) AS v FROM p24 JOIN f0 ON moy=(t+{START_MONTH})%12), l AS (SELECT entity, category, o, arg_max(v, t) AS lv FROM a, os WHERE t <= o GROUP BY ALL)
SELECT 'naive' AS model, o, entity, category, h, round(lv*exp(s), 4) AS f FROM l CROSS JOIN hs JOIN f0 ON moy=(o+h+{START_MONTH})%12""")
def seasonally_adjusted_naive(spark: SparkSession, d: str) -> DataFrame:
    s = _factors(spark, d).where((F.col("series") == "total") & (F.col("o") == LAST)).select("moy", "s")
    out = fo.seasonal_wrapper(fx.packed24(spark, d), s, lambda p: fo.naive(p, FIRST, LAST, H), START_MONTH)
    return rounded(out, f=4)
