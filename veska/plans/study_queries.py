"""Queries of the studies, reports and sinks over the star schema, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veska.functions import text as tx
from veska.operators import decompose as dc
from veska.operators import detect as dt
from veska.operators import evaluate as ev
from veska.operators import forecast as fo
from veska.operators import panel as pn
from veska.operators import studies as st
from veska.plans import event_queries as eq
from veska.plans import fixtures as fx
from veska.plans import panel_queries as pq
from veska.plans.fixtures import COURSE, EDGES, FIRST, FORECASTS, LAST, NEWS, OFFSET, OUTSIDE, OWN, P24, PAIRS, SEASONAL, H, START_MONTH, T, scaled
from veska.session import cut, scratch, table
from veska.sources import tables as src

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


rounded = pq.rounded
_U = "(('0x' || substr(md5({}), 1, 8))::UBIGINT / 4294967296.0)"


def _times(key: str) -> str:
    u = _U.format(key)
    return " + ".join(f"({u} > {c})::INT" for c in st.POISSON)


DRAWS = 200


def _drawn(source: str, key: str) -> str:
    return f"dr AS (SELECT * FROM (SELECT g AS {key}, b, {_times("'0:' || b || ':' || g")} AS m FROM (SELECT DISTINCT {key} AS g FROM {source}), range(0,{DRAWS}) r(b)) WHERE m > 0)"


@query("event_study_interval", f"""WITH {eq._SH}, {eq._SURPRISE}, ce AS (SELECT lag, sh.t, substr(sh.entity,7,1) AS grp, (abs(sh) >= 2)::INT AS big, (s >= 0.3)::INT AS hit FROM sh CROSS JOIN (SELECT CAST(l AS INTEGER) AS lag FROM range(-2,3) r(l)) JOIN su ON su.entity=sh.entity AND su.t=sh.t+lag WHERE sh IS NOT NULL AND s IS NOT NULL),
  cn AS (SELECT lag, t, grp, count(*) AS o, sum(hit) AS n, sum(big) AS k, sum(hit*big) AS s FROM ce GROUP BY 1,2,3), {_drawn('cn', 'grp')},
  x AS (SELECT b, lag, t, sum(m*o) AS o, sum(m*n) AS n, sum(m*k) AS k, sum(m*s) AS s FROM cn JOIN dr USING (grp) GROUP BY 1,2,3), l AS (SELECT b, lag, sum(s)/sum(n*k/o) AS lift FROM x GROUP BY 1,2 HAVING sum(n*k/o) > 0)
SELECT lag, round(quantile_cont(lift, 0.025), 6) AS ci_low, round(quantile_cont(lift, 0.975), 6) AS ci_high FROM l GROUP BY 1""")
def event_study_interval(spark: SparkSession, d: str) -> DataFrame:
    groups = fx.regions(spark, d).select("entity", F.col("region").alias("grp"))
    out = st.event_study_interval(eq._shifts(spark, d), eq._surprise(spark, d), groups, 2.0, 0.3, [-2, -1, 0, 1, 2], DRAWS)
    return rounded(out, ci_low=6, ci_high=6)


def _response_sql(by: str) -> str:
    return f"""WITH {eq._SH}, {NEWS}, j AS (SELECT sh.*, n.entity IS NOT NULL AS hit FROM sh LEFT JOIN (SELECT entity, t FROM news WHERE n >= 2) n ON n.entity=sh.entity AND n.t=sh.t WHERE sh IS NOT NULL),
  q AS (SELECT entity, category, hit, sh - avg(sh) FILTER (NOT hit) OVER (PARTITION BY {by}) AS d FROM j),
  p AS (SELECT entity, category, sum(d) FILTER (hit) AS s, sum(abs(d)) FILTER (hit) AS a, count(d) FILTER (hit) AS n, count(*) FILTER (hit) AS treated, sum(abs(d)) FILTER (NOT hit) AS c, count(d) FILTER (NOT hit) AS cn FROM q GROUP BY 1,2 HAVING count(*) FILTER (hit) > 0),
  en AS (SELECT entity, sum(s) AS s, sum(a) AS a, sum(n) AS n FROM p GROUP BY 1), {_drawn('en', 'entity')}, x AS (SELECT b, sum(m*s)/sum(m*n) AS s, sum(m*a)/sum(m*n) AS a FROM en JOIN dr USING (entity) GROUP BY 1 HAVING sum(m*n) > 0),
  w AS (SELECT CAST(sum(treated) AS BIGINT) AS treated, count(DISTINCT entity) AS entities, round(sum(s)/sum(n),6) AS shift, round(sum(a)/sum(n),6) AS abs_shift, round(sum(c)/sum(cn),6) AS abs_control FROM p HAVING sum(treated) >= 10)
SELECT w.*, round(quantile_cont(x.s,0.025),6) AS ci_low, round(quantile_cont(x.s,0.975),6) AS ci_high, round(quantile_cont(x.a,0.025),6) AS abs_low, round(quantile_cont(x.a,0.975),6) AS abs_high FROM w, x GROUP BY ALL"""


def _response(name: str, within: bool, by: str) -> None:
    @query(name, _response_sql(by))
    def response(spark: SparkSession, d: str) -> DataFrame:
        out = st.response_interval(eq._shifts(spark, d), eq._hits(spark, d), within, DRAWS)
        return rounded(out, **{c: 6 for c in out.columns if c not in ("treated", "entities")})


_response("news_response_interval", False, "t")
_response("news_response_within_interval", True, "entity, category")

_RATE = "rt AS (SELECT CAST((year(l_shipdate)-1995)*12+month(l_shipdate)-1 AS INTEGER) AS t, 100*avg(l_discount) AS rate, 100*(avg(l_discount)-avg(l_tax)) AS real FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-08-01' GROUP BY 1)"
_S12 = "s AS (SELECT series, t, x, CASE WHEN count(x) OVER w = 12 THEN ln(sum(exp(x)) OVER w) END AS s FROM ext WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))"
_ORIGINS = [47, 53, 59, 65]
_STUDY = {"ar1": ["back"], "ar1_rate": ["back", "real"], "ar1_rate_change": ["back", "real", "change"]}


def _det(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    return "(" + " + ".join(f"({'-' if j % 2 else ''}({m[0][j]}) * {_det([row[:j] + row[j + 1:] for row in m[1:]])})" for j in range(len(m))) + ")"


def _least_squares_sql(name: str, xs: list[str]) -> str:
    cov = [[f"covar_pop({a}, {b})" for b in xs] for a in xs]
    slope = [f"{_det([[f'covar_pop({xs[i]}, ahead)' if j == k else cov[i][j] for j in range(len(xs))] for i in range(len(xs))])} / {_det(cov)}" for k in range(len(xs))]
    known = " AND ".join(f"{x} IS NOT NULL" for x in (*xs, "ahead"))
    fit = ", ".join([*[f"{b} AS b{i}" for i, b in enumerate(slope)], *[f"avg({x}) AS m{i}" for i, x in enumerate(xs)], "avg(ahead) AS m"])
    dot = " + ".join(f"b{i} * (n.{x} - m{i})" for i, x in enumerate(xs))
    return f"SELECT n.series, n.o, '{name}' AS rule, m + {dot} AS pred, n.ahead AS fact FROM nw n JOIN (SELECT series, o, {fit} FROM tr WHERE {known} GROUP BY 1,2) b ON b.series=n.series AND b.o=n.o"


@query("growth_study", f"""WITH {OUTSIDE}, {_RATE}, {_S12}, g0 AS (SELECT series, t, s - lag(s, 12) OVER w AS back, lead(s, 12) OVER w - s AS ahead FROM s WINDOW w AS (PARTITION BY series ORDER BY t)),
  g AS (SELECT g0.*, rate, real, rate - lag(rate, 6) OVER (PARTITION BY series ORDER BY g0.t) AS change FROM g0 LEFT JOIN rt ON rt.t=g0.t), o AS (SELECT unnest({_ORIGINS}) AS o),
  nw AS (SELECT * FROM g, o WHERE t = o AND ahead IS NOT NULL AND back IS NOT NULL), tr AS (SELECT * FROM g, o WHERE t <= o - 12),
  mn AS (SELECT series, o, avg(back) AS pred FROM (SELECT series, o, back, row_number() OVER (PARTITION BY series, o ORDER BY t DESC) AS k FROM g, o WHERE t <= o AND back IS NOT NULL) WHERE k <= 60 GROUP BY 1,2),
  al AS (SELECT series, o, 'last' AS rule, back AS pred, ahead AS fact FROM nw UNION ALL SELECT series, o, 'mean', pred, ahead FROM mn JOIN nw USING (series, o) UNION ALL {" UNION ALL ".join(_least_squares_sql(k, v) for k, v in _STUDY.items())})
SELECT series, CAST(o AS INTEGER) AS o, rule, round(pred, 5) AS pred, round(fact, 5) AS fact FROM al WHERE pred IS NOT NULL""")
def growth_study(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_shipdate < timestamp_ntz'2001-08-01'")
    rate = li.groupBy(fx.month_no("l_shipdate").alias("t")).agg((100 * F.avg("l_discount")).alias("rate"), (100 * (F.avg("l_discount") - F.avg("l_tax"))).alias("real"))
    return rounded(st.growth_study(cut(st.growth_table(fx.outside(spark, d), rate)), _ORIGINS, _STUDY), pred=5, fact=5)


@query("growth_variants", f"""WITH {OUTSIDE}, {pq._OS}, {_S12}, v AS (SELECT series, o, avg(x) FILTER (t-o-{OFFSET} BETWEEN -2 AND 0) - avg(x) FILTER (t-o-{OFFSET} BETWEEN -14 AND -12) AS last, max(s) FILTER (t=o+{OFFSET}) - max(s) FILTER (t=11) AS d FROM s, os GROUP BY 1,2)
SELECT series, o, round(last,6) AS last, round(d/((o+{OFFSET}-11)/12.0),6) AS longrun, round((last+d/((o+{OFFSET}-11)/12.0))/2,6) AS half FROM v""")
def growth_variants(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.growth_variants(fx.outside(spark, d), fx.cutoffs(spark), 11), last=6, longrun=6, half=6)


_PERIODS = [("early", 26, 40), ("late", 45, 66)]


@query("outside_errors", f"""WITH {OUTSIDE}, pe AS (SELECT * FROM (VALUES {", ".join(f"('{p}',{a},{z})" for p, a, z in _PERIODS)}) v(period, a, z)), b AS (SELECT period, o0.series, o0.t AS o, h, o0.x AS x0, y.x AS y, sn.x AS s, (SELECT CASE WHEN count(*) = 6 THEN sum(CASE WHEN e.t > o0.t-3 THEN e.x ELSE -e.x END)/3 END FROM ext e WHERE e.series=o0.series AND (e.t BETWEEN o0.t-2 AND o0.t OR e.t BETWEEN o0.t-14 AND o0.t-12)) AS g
    FROM ext o0 JOIN pe ON o0.t BETWEEN a AND z CROSS JOIN (SELECT CAST(h AS INTEGER) AS h FROM range(1,{H + 1}) r(h)) JOIN ext y ON y.series=o0.series AND y.t=o0.t+h LEFT JOIN ext sn ON sn.series=o0.series AND sn.t=o0.t+h-12),
  f AS (SELECT period, 'naive' AS rule, h, o, abs(y-x0) AS e FROM b UNION ALL SELECT period, 'seasonal_naive', h, o, abs(y-s) FROM b UNION ALL SELECT period, 'seasonal_growth', h, o, abs(y-s-g) FROM b)
SELECT period, rule, h, round(100*avg(e),5) AS err, count(DISTINCT o) AS origins FROM f WHERE e IS NOT NULL GROUP BY 1,2,3""")
def outside_errors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.outside_errors(fx.outside(spark, d), _PERIODS, H), err=5)


@query("month_after", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month, CAST(h AS INTEGER) AS h, strftime(date_trunc('month', o_orderdate) + to_months(CAST(h AS INTEGER)), '%Y-%m') AS later FROM orders, range(1,13) r(h)")
def month_after(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct()
    m = m.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return m.select("month", "h", st.month_after(F.col("month"), F.col("h")).alias("later"))


@query("covered_models", f"WITH {P24}, {FORECASTS} SELECT model, count(f) AS n FROM fc GROUP BY 1")
def covered_models(spark: SparkSession, d: str) -> DataFrame:
    p = cut(fx.packed24(spark, d))
    naive = fo.naive(p, FIRST, LAST, H)
    partial = naive.where(F.substring("entity", 8, 1).isin("1", "2")).withColumn("model", F.lit("partial"))
    models = naive.unionByName(fo.seasonal_naive(p, FIRST, LAST, H)).unionByName(partial)
    return st.covered_models(models, p).groupBy("model").agg(F.count("f").alias("n"))


def _pivot(name: str, measure: str, digits: int, expression: str, order: str) -> None:
    cols = ", ".join(f"round(max(v) FILTER (h={h}), {digits}) AS h{h}" for h in (1, 6, 12))

    @query(name, f"WITH {P24}, {FORECASTS}, {PAIRS}, m AS (SELECT model, h, {expression} AS v FROM pairs GROUP BY 1,2) SELECT model, {cols}, CAST(row_number() OVER (ORDER BY max(v) FILTER (h=12) {order}, model) AS INTEGER) AS place FROM m GROUP BY 1")
    def pivot(spark: SparkSession, d: str) -> DataFrame:
        total = ev.metrics(pq._paired(spark, d)).where("category = 'total'")
        return rounded(st.report_pivot(total, "model", "h", [1, 6, 12], measure, measure), h1=digits, h6=digits, h12=digits)


_pivot("report_mae", "mae", 2, "avg(abs(act-f))", "ASC")
_pivot("report_r2", "r2", 6, "1 - sum((act-f)**2)/(var_pop(act)*count(*))", "DESC")


@query("stratified_sample", "SELECT c_mktsegment, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('7:' || c_custkey), c_custkey) <= 5")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return st.sampled(table(spark, d, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", ["c_custkey"], 5, 7)


@query("neighbour_lists", f"WITH {EDGES} SELECT a, string_agg(b, ',' ORDER BY rank) AS list FROM near GROUP BY 1")
def neighbour_lists(spark: SparkSession, d: str) -> DataFrame:
    return st.neighbour_lists(pn.neighbours(fx.edges(spark, d), 5)).select("a", F.concat_ws(",", "list").alias("list"))


@query("dictionary_encode", "SELECT p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT p_brand FROM part)")
def dictionary_encode(spark: SparkSession, d: str) -> DataFrame:
    return pn.dictionary(table(spark, d, "part"), "p_brand")


@query("gbm_news_forecast")
def gbm_news_forecast(spark: SparkSession, d: str) -> DataFrame:
    from veska.operators.local_model import boosted, boosted_features

    near = pn.neighbours(fx.edges(spark, d), 10)
    news = cut(eq._surprise(spark, d))
    features = cut(boosted_features(pq._logs(spark, d), cut(pq._trajectory(spark, d)), fx.market_access(spark, d), near, FIRST, LAST, news))
    return rounded(boosted(features, H, START_MONTH, name="boosted_news"), f=4)


@query("sorted_union", """WITH a AS (SELECT user_id, event_type AS k FROM events WHERE month(ts) = 1 UNION SELECT user_id, 'big ' || event_type FROM events WHERE value > 90) SELECT user_id, string_agg(k, ',' ORDER BY k) AS kinds FROM a GROUP BY 1""")
def sorted_union(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    sets = e.groupBy("user_id").agg(
        F.collect_set(F.when(F.month("ts") == 1, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("value") > 90, F.concat(F.lit("big "), "event_type"))).alias("b")
    )
    return sets.select("user_id", F.concat_ws(",", st.sorted_union(F.col("a"), F.col("b"))).alias("kinds")).where("kinds != ''")


_FLAGS = {"all": None, "open": ["N"], "closed": ["A", "R"]}


@query("count_matrix", f"""WITH l AS (SELECT p_brand AS entity, CAST((year(l_shipdate)-1995)*12+month(l_shipdate)-1-{OFFSET} AS INTEGER) AS t, l_returnflag AS kind FROM lineitem JOIN part ON l_partkey=p_partkey WHERE l_quantity > 40),
  g AS (SELECT grp, entity, CAST(r.t AS INTEGER) AS t FROM (SELECT DISTINCT p_brand AS entity FROM part), (SELECT unnest(['all','open','closed']) AS grp), range(0,{T}) r(t))
SELECT grp, g.entity, g.t, count(l.entity) AS n FROM g LEFT JOIN l ON l.entity=g.entity AND l.t=g.t AND (grp='all' OR (grp='open' AND kind = 'N') OR (grp='closed' AND kind IN ('A','R'))) GROUP BY 1,2,3""")
def count_matrix(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_quantity > 40")
    per = li.groupBy("l_partkey", F.col("l_returnflag").alias("kind"), (fx.month_no("l_shipdate") - OFFSET).alias("t")).agg(F.count("*").alias("n"))
    part = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("entity"))
    rows = per.join(part, per.l_partkey == part.p_partkey).groupBy("entity", "kind", "t").agg(F.sum("n").alias("n"))
    return st.count_matrix(rows, fx.regions(spark, d), _FLAGS, T)


@query("decree_matrix", f"""WITH {eq._CAT}, l AS (SELECT unnest(ids) AS entity, month AS t FROM cat), g AS (SELECT entity, CAST(r.t AS INTEGER) AS t FROM (SELECT DISTINCT p_brand AS entity FROM part), range(0,{T}) r(t))
SELECT 'all' AS grp, g.entity, g.t, count(l.entity) AS n FROM g LEFT JOIN l ON l.entity=g.entity AND l.t=g.t GROUP BY 2,3""")
def decree_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.catalogue(spark).select(F.explode("ids").alias("entity"), F.col("month").alias("t"), "kind", F.lit(1).alias("n"))
    return st.count_matrix(rows, fx.regions(spark, d), {"all": None}, T)


SEEDS, SIZES = [0, 1, 2, 3, 4], [2.0, 4.0, 6.0]
ALPHAS = [0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3]


def _h(k: str) -> str:
    return _U.format(f"seed || ':{k}:' || entity || ':' || category")


_INJECTED = f"""u AS (SELECT seed, entity, category, t, z, {_h('inj')} < 0.3 AS inj, CAST(floor({_h('tau')}*13) + 8 AS INTEGER) AS tau, [2.0, 4.0, 6.0][CAST(floor({_h('size')}*3) AS INTEGER) + 1]::DOUBLE * (CASE WHEN {_h('sign')} < 0.5 THEN -1.0 ELSE 1.0 END)::DOUBLE AS delta,
    {_h('true')} < 0.7 AS tr, {_h('false')} < 0.1 AS fa, CAST(floor({_h('when')}*{T - 8}) + 8 AS INTEGER) AS fake FROM z, (SELECT CAST(r.s AS INTEGER) AS seed FROM range(0,5) r(s))),
  inj AS (SELECT seed, entity, category, t, z + CASE WHEN inj AND t >= tau THEN delta ELSE 0 END AS z, inj, tau, delta, CASE WHEN inj AND tr THEN tau WHEN NOT inj AND fa THEN fake END AS news FROM u)"""


def _injected(spark: SparkSession, d: str) -> DataFrame:
    return st.injected(pq._z(spark, d), 0.3, 8, 20, SIZES, SEEDS, 0.7, 0.1, T)


@query("injected_panel", f"{pq._Z}, {_INJECTED} SELECT seed, entity, category, t, round(z, 4) AS z, inj, tau, news FROM inj")
def injected_panel(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_injected(spark, d).drop("delta"), z=4)


_LISTED = "[" + ", ".join(f"{a}::DOUBLE" for a in ALPHAS) + "]"


@query("calibrated_groups", f"""{pq._Z}, {_INJECTED}, tr AS (SELECT DISTINCT seed, entity, category, inj, tau, delta FROM inj), gr AS (SELECT *, 'all' AS grp FROM tr UNION ALL SELECT *, category FROM tr UNION ALL SELECT tr.*, 'delta ' || x FROM tr, (SELECT unnest([2,4,6]) AS x) WHERE NOT inj OR abs(delta) = x),
  tops AS (SELECT seed, entity, category, max(abs(z)) AS m FROM inj WHERE t >= 8 GROUP BY 1,2,3),
  thr AS (SELECT seed, grp, unnest({_LISTED}) AS alpha, unnest(quantile_cont(m, [{", ".join(f"{1 - a:.2f}" for a in ALPHAS)}])) AS threshold FROM gr JOIN tops USING (seed, entity, category) WHERE NOT inj GROUP BY 1,2),
  f AS (SELECT gr.seed, gr.grp, alpha, threshold, gr.entity, gr.category, gr.inj, gr.tau, min(t) FILTER (abs(z) > threshold) AS f FROM gr JOIN inj ON inj.seed=gr.seed AND inj.entity=gr.entity AND inj.category=gr.category AND t >= 8 JOIN thr ON thr.seed=gr.seed AND thr.grp=gr.grp GROUP BY ALL)
SELECT seed, grp, alpha, round(threshold,4) AS threshold, round(count(*) FILTER (inj AND f BETWEEN tau AND tau+2)/nullif(count(*) FILTER (inj),0),6) AS recall,
  round(count(*) FILTER (inj AND f BETWEEN tau AND tau+2)/greatest(count(*) FILTER (inj AND f BETWEEN tau AND tau+2)+count(*) FILTER (NOT inj AND f IS NOT NULL)+count(*) FILTER (inj AND f < tau),1),6) AS precision,
  round(avg(f-tau) FILTER (inj AND f BETWEEN tau AND tau+2),4) AS delay, round(count(*) FILTER (inj AND f < tau)/nullif(count(*) FILTER (inj),0),6) AS early FROM f GROUP BY 1,2,3,f.threshold""")
def calibrated_groups(spark: SparkSession, d: str) -> DataFrame:
    z = cut(_injected(spark, d))
    truth = st.sliced(z.select("seed", "entity", "category", "inj", "tau", "delta").distinct())
    out = st.calibrated_by(z.select("seed", "entity", "category", "t", F.abs("z").alias("s")), truth, ["seed", "grp"], 8, ALPHAS)
    return rounded(out, threshold=4, recall=6, precision=6, delay=4, early=6)


def _detectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Scores (detector, seed, entity, category, t, s) of the study and its truth by group; each
    repetition's series are series of their own, named by seed."""
    z = cut(_injected(spark, d))
    own = z.withColumn("entity", F.concat_ws("|", "seed", "entity"))
    cells, news = own.select("entity", "category", "t", "z"), own.where("news is not null").select("entity", F.col("news").alias("t")).distinct()
    plain = {"cusum": dt.cusum(cells, T), "segmentation": dt.segmentation(cells, T), "run_length": dt.run_length(cells, T), "step_ratio": dt.step_ratio(cells, T, 0.1, 0.5)}
    plain = {k: cut(v) for k, v in plain.items()}
    plain["combo"] = dt.either(plain["cusum"], plain["step_ratio"])
    out = None
    for name, s in plain.items():
        both = s.withColumn("detector", F.lit(name)).unionByName(dt.with_news(s, news, 25.0).withColumn("detector", F.lit(f"{name}_news")))
        out = both if out is None else out.unionByName(both)
    parts = F.split("entity", r"\|", 2)
    out = out.select("detector", parts[0].cast("int").alias("seed"), parts[1].alias("entity"), "category", "t", F.col("s").cast("double").alias("s"))
    truth = st.sliced(z.select("seed", "entity", "category", "inj", "tau", "delta").distinct())
    names = [n for k in plain for n in (k, f"{k}_news")]
    return out, truth.withColumn("detector", F.explode(F.array(*[F.lit(n) for n in names])))


@query("injection_study")
def injection_study(spark: SparkSession, d: str) -> DataFrame:
    out = st.calibrated_by(*_detectors(spark, d), ["detector", "seed", "grp"], 8, ALPHAS)
    return rounded(out, threshold=4, recall=6, precision=6, delay=4, early=6)


@query("detection_summary")
def detection_summary(spark: SparkSession, d: str) -> DataFrame:
    runs = cut(st.calibrated_by(*_detectors(spark, d), ["detector", "seed", "grp"], 8, ALPHAS))
    out = st.over_seeds(runs, ["detector", "grp"], 0.05, 0.2)
    return rounded(out, **{c: 6 for c in out.columns if c not in ("detector", "grp", "seeds")})


@query("seed_summary", f"""WITH c AS ({ORACLE["calibrated_groups"]}), a AS (SELECT grp, seed, sum((alpha-la)*(recall+lr)/2)/0.2 AS pauc FROM (SELECT grp, seed, alpha, recall, lag(alpha,1,0.0) OVER w AS la, lag(recall,1,0.0) OVER w AS lr FROM c WHERE alpha <= 0.2 WINDOW w AS (PARTITION BY grp, seed ORDER BY alpha)) GROUP BY 1,2),
  j AS (SELECT c.grp, recall, precision, pauc FROM c JOIN a ON a.grp=c.grp AND a.seed=c.seed WHERE abs(alpha-0.05) < 1e-9)
SELECT grp, count(*) AS seeds, {", ".join(f"round(avg({x}),4) AS {x}, round(2.776445*stddev_samp({x})/sqrt(count(*)),4) AS {x}_ci" for x in ("recall", "precision", "pauc"))} FROM j GROUP BY 1""")
def seed_summary(spark: SparkSession, d: str) -> DataFrame:
    out = st.over_seeds(cut(calibrated_groups(spark, d)), ["grp"], 0.05, 0.2)
    return rounded(out, **{c: 4 for c in out.columns if c not in ("grp", "seeds")})


_ORIGIN = f"WITH {P24}, {EDGES}, {OWN}, oc AS (SELECT entity, category, t, l - avg(l) FILTER (t < 8) OVER (PARTITION BY entity, category) AS l FROM own), nb AS (SELECT a AS entity, category, t, avg(l) AS nb FROM near JOIN oc ON oc.entity=near.b GROUP BY 1,2,3), rel AS (SELECT entity, category, t, l - nb AS l FROM oc JOIN nb USING (entity, category, t))"
_SHIFT = "SELECT * FROM (SELECT entity, category, t, avg(z) OVER (PARTITION BY entity, category ORDER BY t RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING) - avg(z) OVER (PARTITION BY entity, category ORDER BY t RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) AS sh FROM {}) WHERE t BETWEEN 3 AND 21"


@query("labelled_study", f"""{_ORIGIN}, zo AS (WITH {scaled('own')} SELECT * FROM z), zr AS (WITH {scaled('rel')} SELECT * FROM z), lb AS (SELECT 'own' AS labels, * FROM ({_SHIFT.format('zo')}) UNION ALL SELECT 'relative', * FROM ({_SHIFT.format('zr')})),
  s AS (SELECT 'own' AS channel, o.entity, o.category, o.t, abs(o.z) AS s FROM zo o JOIN zr USING (entity, category, t) UNION ALL SELECT 'relative', entity, category, t, abs(z) FROM zr UNION ALL SELECT 'combo', o.entity, o.category, o.t, greatest(abs(o.z), abs(zr.z)) FROM zo o JOIN zr ON zr.entity=o.entity AND zr.category=o.category AND zr.t=o.t),
  s2 AS (SELECT * FROM s WHERE t BETWEEN 6 AND 21), th AS (SELECT channel, unnest([0.02::DOUBLE, 0.05::DOUBLE]) AS rate, unnest(quantile_cont(s, [0.98, 0.95])) AS threshold FROM s2 GROUP BY 1),
  j AS (SELECT l.labels, s2.channel, rate, threshold, s2.entity, s2.category, s2.t, s > threshold AS alarm, coalesce(abs(sh) >= 2, false) AS big FROM s2 JOIN th ON th.channel=s2.channel CROSS JOIN (SELECT unnest(['own','relative']) AS labels) l LEFT JOIN lb ON lb.labels=l.labels AND lb.entity=s2.entity AND lb.category=s2.category AND lb.t=s2.t),
  kk AS (SELECT *, alarm AND bool_or(big) OVER (PARTITION BY labels, channel, rate, entity, category ORDER BY t RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS ok, big AND bool_or(alarm) OVER (PARTITION BY labels, channel, rate, entity, category ORDER BY t RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING) AS caught FROM j)
SELECT labels, channel, rate, round(threshold,4) AS threshold, round(count(*) FILTER (ok)/greatest(count(*) FILTER (alarm),1),6) AS precision, round(count(*) FILTER (caught)/greatest(count(*) FILTER (big),1),6) AS recall, count(*) FILTER (alarm) AS alarms, count(*) FILTER (big) AS shifts FROM kk GROUP BY 1,2,3,kk.threshold""")
def labelled_study(spark: SparkSession, d: str) -> DataFrame:
    own = cut(pq._z(spark, d))
    rel = cut(dt.prepare_relative(pq._panel(spark, d), pn.neighbours(fx.edges(spark, d), 5), 8))
    key = ["entity", "category", "t"]
    score = lambda z: z.select(*key, F.abs("z").alias("s"))
    mine = score(own).join(rel.select(*key), key)
    channels = {"own": mine, "relative": score(rel), "combo": dt.either(mine, score(rel))}
    labels = {"own": dt.confirmed_shifts(own, "z", T), "relative": dt.confirmed_shifts(rel, "z", T)}
    out = None
    for name, sh in labels.items():
        for channel, s in channels.items():
            one = dt.labelled(s, sh, 2.0, [0.02, 0.05], 6, 21).select(F.lit(name).alias("labels"), F.lit(channel).alias("channel"), "*")
            out = one if out is None else out.unionByName(one)
    return rounded(out, threshold=4, precision=6, recall=6)


@query("seasonal_factors_skipping", f"WITH {OUTSIDE}, {pq._OS}, {SEASONAL.replace('WHERE d IS NOT NULL', 'WHERE d IS NOT NULL AND 1995 + t // 12 NOT IN (1997, 1998)')} SELECT series, o, CAST(moy AS INTEGER) AS moy, round(s, 6) AS s FROM sf")
def seasonal_factors_skipping(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dc.seasonal_factors(fx.outside(spark, d), 0, fx.cutoffs(spark), skip_years=(1997, 1998)), s=6)


_WORDS = r"regexp_matches(lower(coalesce(text,'')), '(^|\PL)чс($|\PL)') AND regexp_matches(lower(coalesce(text,'')), '(^|\PL)режим')"


@query("classify_derived", f"WITH k AS ({eq._KINDS}) SELECT kind, count(DISTINCT doc_id) AS docs FROM (SELECT * FROM k UNION ALL SELECT doc_id, 'disaster' FROM k WHERE kind = 'flood' UNION ALL SELECT doc_id, 'disaster' FROM documents WHERE {_WORDS}) GROUP BY 1")
def classify_derived(spark: SparkSession, d: str) -> DataFrame:
    kinds = tx.classify(table(spark, d, "documents"), "doc_id", "text", eq.KINDS, {"disaster": (["flood"], [r"чс(?!\p{L})", "режим"])})
    return kinds.groupBy("kind").agg(F.countDistinct("doc_id").alias("docs"))


@query("dm_test", f"""WITH q AS ({pq.ORACLE["dm_statistic"]}), n AS (SELECT h, mean_diff, dm, units, CASE WHEN h <= 9 THEN units - 1 END AS df FROM q), g AS (SELECT (i + 0.5)/20000 AS s FROM range(0,20000) r(i)),
  p AS (SELECT h, 2*sum(CASE WHEN df IS NULL THEN exp(-0.5*(abs(dm)+s/(1-s))**2)/sqrt(2*pi()) ELSE exp(lgamma((df+1)/2.0)-lgamma(df/2.0))/sqrt(df*pi())*(1+(abs(dm)+s/(1-s))**2/df)**(-(df+1)/2.0) END/(1-s)**2)/20000 AS p FROM n, g GROUP BY 1)
SELECT n.h, mean_diff, dm, units, CASE WHEN df IS NULL THEN 'cluster' ELSE 'origin' END AS by_unit, round(p, 4) AS p FROM n JOIN p USING (h)""")
def dm_test(spark: SparkSession, d: str) -> DataFrame:
    q = rounded(ev.diebold_mariano(cut(pq._paired(spark, d)), "naive", "seasonal_naive"), mean_diff=2, dm=4)
    df = F.when(F.col("by_unit") == "origin", F.col("units") - 1).cast("double")
    return q.withColumn("p", F.round(st.two_sided("dm", df), 4))


_KEMENY = """ke AS (SELECT x.model AS a, y.model AS b, z.model AS c, row_number() OVER (ORDER BY p.n + q.n + r.n, x.model, y.model) AS k FROM (SELECT DISTINCT model FROM rk) x, (SELECT DISTINCT model FROM rk) y, (SELECT DISTINCT model FROM rk) z
    JOIN pw p ON p.a=y.model AND p.b=x.model JOIN pw q ON q.a=z.model AND q.b=x.model JOIN pw r ON r.a=z.model AND r.b=y.model WHERE x.model <> y.model AND y.model <> z.model AND x.model <> z.model), kp AS (SELECT unnest([a, b, c]) AS model, unnest([1, 2, 3]) AS place FROM ke WHERE k = 1)"""
pq.ORACLE["kemeny"] = f"{pq._RANKS}, {_KEMENY} SELECT model, place FROM kp"


@query("rank_table", f"""{pq._RANKS}, {_KEMENY}, bo AS ({pq.ORACLE["borda"].removeprefix(pq._RANKS)}), co AS ({pq.ORACLE["copeland"].removeprefix(pq._RANKS)}), th AS ({pq.ORACLE["threshold_rule"].removeprefix(pq._RANKS)}), cd AS ({pq.ORACLE["condorcet"].removeprefix(pq._RANKS)})
SELECT bo.model, bo.rank AS borda, co.rank AS copeland, th.place AS threshold, kp.place AS kemeny, bo.model IN (SELECT model FROM cd) AS condorcet FROM bo JOIN co USING (model) JOIN th USING (model) JOIN kp USING (model)""")
def rank_table(spark: SparkSession, d: str) -> DataFrame:
    ranks = pq._ranks(spark, d)
    wins = cut(ev.pairwise(ranks, ["h", "category"]))
    return st.rank_table(ev.borda(ranks), ev.copeland(wins), ev.threshold_rule(ranks, 3), pq.kemeny_order(wins), ev.condorcet(wins))


@query("regional_oracle", f"""{pq._ALL}, {pq._SEASONAL_FC}, rz AS (SELECT entity, category, t, avg(z) OVER (PARTITION BY category, region, t) AS r FROM (SELECT entity, category, substr(entity,7,1) AS region, t, y - avg(y) OVER (PARTITION BY entity, category) - avg(y) OVER (PARTITION BY category, t) + avg(y) OVER (PARTITION BY category) AS z FROM p24)),
  b AS (SELECT l.o, l.entity, l.category, r.h, exp(a + hybrid + l.z) AS f, exp(a + hybrid + l.z + x.r - w.r) AS g, p.v FROM zl l JOIN aa ON aa.entity=l.entity AND aa.category=l.category AND aa.o=l.o JOIN rules r ON r.category=l.category AND r.o=l.o
    JOIN rz w ON w.entity=l.entity AND w.category=l.category AND w.t=l.o JOIN rz x ON x.entity=l.entity AND x.category=l.category AND x.t=l.o+r.h JOIN p24 p ON p.entity=l.entity AND p.category=l.category AND p.t=l.o+r.h)
SELECT h, round(avg(abs(v-f)),2) AS kept, round(avg(abs(v-g)),2) AS oracle, count(*) AS n FROM b GROUP BY 1""")
def regional_oracle(spark: SparkSession, d: str) -> DataFrame:
    p = cut(fx.panel24(spark, d))
    logs = pn.packed(p.withColumn("v", F.log("v")), T)
    kept = fo.panel_seasonal(logs, pq._trajectory(spark, d, p=p), FIRST, LAST, H, rho=1.0)
    common = dc.regional_course(p, fx.regions(spark, d))
    at = lambda name, t: common.select("entity", "category", F.col("t").alias(t), F.col("r").alias(name))
    j = ev.pairs(kept, p).withColumn("ot", F.col("o") + F.col("h")).join(at("r0", "o"), ["entity", "category", "o"]).join(at("r1", "ot"), ["entity", "category", "ot"])
    err = lambda f: F.round(F.avg(F.abs(F.col("y") - f)), 2)
    return j.groupBy("h").agg(err(F.col("f")).alias("kept"), err(F.col("f") * F.exp(F.col("r1") - F.col("r0"))).alias("oracle"), F.count("*").alias("n"))


# Sources and sinks.


@query("frozen_sink", f"""{pq._ENSEMBLE}, en AS (SELECT entity, category, h, exp(avg(ln(f))) AS f FROM al WHERE o = {LAST} GROUP BY ALL) SELECT category, count(*) AS rows, round(sum(round(f, 1)), 1) AS total, min(h) AS first, max(h) AS last FROM en GROUP BY 1""")
def frozen_sink(spark: SparkSession, d: str) -> DataFrame:
    """The frozen forecast as ordered gzip CSV with its manifest, read back and compared with it."""
    e = fo.ensemble(pq._members(spark, d), ["naive", "seasonal_naive", "panel_seasonal"]).where(F.col("o") == LAST)
    with scratch(spark, "frozen") as path:
        manifest = src.write_frozen(e.select("entity", "category", "h", "f"), path, {"origin": LAST})
        back = src.csv(spark, f"{path}/forecast", "entity string, category string, h int, f double")
        out = cut(back.groupBy("category").agg(F.count("*").alias("rows"), F.round(F.sum("f"), 1).alias("total"), F.min("h").alias("first"), F.max("h").alias("last")))
        again = {r["category"]: r["sha"] for r in fo.freeze(back).collect()}  # one row per category
        if again != manifest["sha256"]:
            raise ValueError("the file is not what its manifest says")
    return out


@query("list_parquet", r"SELECT doc_id, len(regexp_extract_all(coalesce(text,''), '\pL+')) AS words, lower(regexp_extract_all(coalesce(text,''), '\pL+')[1]) AS first FROM documents")
def list_parquet(spark: SparkSession, d: str) -> DataFrame:
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\p{L}+)"), F.lit(1))
    with scratch(spark, "lists") as path:
        table(spark, d, "documents").select("doc_id", F.transform(words, F.lower).alias("words")).write.parquet(path)
        back = src.parquet(spark, path, "doc_id bigint, words array<string>")
        return cut(back.select("doc_id", F.size("words").cast("bigint").alias("words"), F.get("words", 0).alias("first")))


@query("outside_series_csv", """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS date, sum(o_totalprice) FILTER (o_orderpriority LIKE '1%') AS food, sum(o_totalprice) FILTER (o_orderpriority LIKE '2%') AS nonfood, sum(o_totalprice) FILTER (o_orderpriority LIKE '3%') AS catering, sum(o_totalprice) FILTER (o_orderpriority LIKE '4%') AS services FROM orders GROUP BY 1),
  l AS (UNPIVOT (SELECT *, food+nonfood+catering+services AS total FROM m) ON food, nonfood, catering, services, total INTO NAME series VALUE v)
SELECT series, CAST((CAST(substr(date,1,4) AS INT)-1995)*12+CAST(substr(date,6,2) AS INT)-1 AS INTEGER) AS t, round(ln(v), 6) AS x FROM l WHERE v > 0""")
def outside_series_csv(spark: SparkSession, d: str) -> DataFrame:
    part = lambda k, n: F.sum(F.when(F.col("o_orderpriority").startswith(k), F.col("o_totalprice"))).alias(n)
    wide = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("date")).agg(part("1", "food"), part("2", "nonfood"), part("3", "catering"), part("4", "services"))
    with scratch(spark, "outside") as path:
        src.write_csv(wide, path)
        return cut(rounded(src.outside_series(spark, path, 1995), x=6))


_NUMBERED = ", ".join(f"('{i}', '{';'.join(x[6:] for x in ids)}', DATE '{a}')" for i, _, ids, _, a in fx.CATALOGUE)


@query("event_csv_lists", f"SELECT event_id, CAST(unnest(string_split(ids, ';')) AS BIGINT) AS id, strftime(a, '%Y-%m-%d') AS announced FROM (VALUES {_NUMBERED}) v(event_id, ids, a)")
def event_csv_lists(spark: SparkSession, d: str) -> DataFrame:
    names = [c.split()[0] for c in src.EVENTS.split(", ")]
    rows = [(i, ";".join(x[6:] for x in ids) + "; ;x", a) for i, _, ids, _, a in fx.CATALOGUE]
    df = spark.createDataFrame(rows, "event_id string, territory_ids string, announce_date string")
    with scratch(spark, "events") as path:
        src.write_csv(df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names]), path)
        back = src.event_csv(spark, path)
        return cut(back.select("event_id", F.explode("ids").alias("id"), F.date_format("announced", "yyyy-MM-dd").alias("announced")))


@query("decrees_json", f"SELECT CAST(unnest(string_split(ids, ';')) AS BIGINT) AS entity, strftime(a, '%Y-%m-%d') AS date FROM (VALUES {_NUMBERED}) v(event_id, ids, a)")
def decrees_json(spark: SparkSession, d: str) -> DataFrame:
    import json

    text = json.dumps([{"date": a, "territory_ids": [int(x[6:]) for x in ids]} for _, _, ids, _, a in fx.CATALOGUE], indent=1)
    with scratch(spark, "decrees") as path:
        spark.createDataFrame([(text,)], "value string").write.text(path)
        return cut(src.decrees(spark, path).select("entity", F.date_format("date", "yyyy-MM-dd").alias("date")))


@query("json_days", "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1,2")
def json_days(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    with scratch(spark, "days") as path:
        e.write.json(path)
        return cut(src.json_days(spark, path, "event_type string, day string").groupBy("event_type", "day").agg(F.count("*").alias("n")))
