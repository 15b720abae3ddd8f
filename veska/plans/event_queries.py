"""Queries of the event, text, source and streaming operators, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veska.functions import text as tx
from veska.operators import detect as dt
from veska.operators import events as evt
from veska.operators import evaluate as ev
from veska.operators import forecast as fo
from veska.plans import fixtures as fx
from veska.plans import panel_queries as pq
from veska.plans.fixtures import FIRST, FORECASTS, LAST, NEWS, OWN, P24, PAIRS, SHIFTS, H, T, scaled
from veska.session import cut, scratch, table
from veska.sources import tables as src
from veska.streaming import monthly

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


def _list(ids: list[str]) -> str:
    return "[" + ", ".join(f"'{i}'" for i in ids) + "]"


_CAT = "cat AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}','{k}',{_list(ids)},{m},DATE '{a}')" for i, k, ids, m, a in fx.CATALOGUE) + ") c(event_id, kind, ids, month, announced))"
_REG = "reg AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}','{k}'," + (f"'{e}'" if e else "NULL") + f",{m},DATE '{a}')" for i, k, e, m, a in fx.REGISTRY) + ") c(event_id, kind, entity, month, announced))"


@query("catalogue_merge", f"""WITH {_CAT}, {_REG}, have AS (SELECT DISTINCT unnest(ids) AS entity, month FROM cat)
SELECT event_id, kind, array_to_string(ids, ';') AS ids, month, strftime(announced, '%Y-%m-%d') AS announced FROM cat UNION ALL
SELECT 'M' || event_id, kind, entity, month, strftime(announced, '%Y-%m-%d') FROM reg r WHERE entity IS NOT NULL AND NOT EXISTS (SELECT 1 FROM have h WHERE h.entity=r.entity AND h.month=r.month)""")
def catalogue_merge(spark: SparkSession, d: str) -> DataFrame:
    m = evt.merge_catalogues(fx.catalogue(spark), fx.registry(spark))
    return m.select("event_id", "kind", F.concat_ws(";", "ids").alias("ids"), "month", F.date_format("announced", "yyyy-MM-dd").alias("announced"))


_BOOST = f"""WITH {P24}, {_CAT}, r AS (SELECT DISTINCT entity, CAST(month + s AS INTEGER) AS t FROM (SELECT unnest(ids) AS entity, month, announced FROM cat), range(0,2) x(s) WHERE {{}})
SELECT p.entity, p.category, p.t, CASE WHEN r.entity IS NULL THEN 1.0::DOUBLE ELSE 25.0::DOUBLE END AS boost FROM p24 p LEFT JOIN r ON r.entity=p.entity AND r.t=p.t"""


@query("boost_grid", _BOOST.format("true"))
def boost_grid(spark: SparkSession, d: str) -> DataFrame:
    return evt.boost(fx.panel24(spark, d), fx.catalogue(spark).select("ids", F.col("month").alias("t")), 25.0)


@query("known_at_filter", _BOOST.format("announced <= DATE '2000-07-31'"))
def known_at_filter(spark: SparkSession, d: str) -> DataFrame:
    known = evt.known_at(fx.catalogue(spark), F.last_day(F.lit("2000-07-01")))
    return evt.boost(fx.panel24(spark, d), known.select("ids", F.col("month").alias("t")), 25.0)


@query("region_impute_nearest", """WITH k0 AS (SELECT CAST(territory_id AS BIGINT) AS entity, region_name AS region, count(*) AS c FROM event_registry_maloyan WHERE territory_id IS NOT NULL AND region_name IS NOT NULL GROUP BY 1,2),
  k AS (SELECT entity, region FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY c DESC, region) AS r FROM k0) WHERE r = 1), e AS (SELECT DISTINCT territory_id AS entity FROM market_access),
  n AS (SELECT e.entity, (SELECT max(entity) FROM k WHERE k.entity < e.entity) AS lo, (SELECT min(entity) FROM k WHERE k.entity > e.entity) AS hi FROM e)
SELECT n.entity, CASE WHEN k.region IS NOT NULL THEN k.region WHEN a.region = b.region THEN a.region WHEN hi IS NULL OR n.entity-lo <= hi-n.entity THEN a.region ELSE b.region END AS region,
  CASE WHEN k.region IS NOT NULL THEN 'known' WHEN a.region = b.region THEN 'between' ELSE 'nearest' END AS how FROM n LEFT JOIN k ON k.entity=n.entity LEFT JOIN k a ON a.entity=lo LEFT JOIN k b ON b.entity=hi""")
def region_impute_nearest(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "event_registry_maloyan").select(F.col("territory_id").cast("bigint").alias("entity"), F.col("region_name").alias("region"))
    return evt.impute_region(table(spark, d, "market_access").select(F.col("territory_id").alias("entity")), known)


_SURPRISE = f"""{NEWS}, keys AS (SELECT DISTINCT entity FROM news), g AS (SELECT k.entity, CAST(r.t AS INTEGER) AS t, ln(1+coalesce(n,0)) AS x FROM keys k CROSS JOIN range(0,{T}) r(t) LEFT JOIN news ON news.entity=k.entity AND news.t=r.t),
  own AS (SELECT entity, t, x - avg(x) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS s FROM g QUALIFY t >= 6),
  rg0 AS (SELECT substr(entity,7,1) AS region, t, sum(n) AS n FROM news GROUP BY 1,2), rg AS (SELECT k.region, CAST(r.t AS INTEGER) AS t, ln(1+coalesce(n,0)) AS x FROM (SELECT DISTINCT region FROM rg0) k CROSS JOIN range(0,{T}) r(t) LEFT JOIN rg0 ON rg0.region=k.region AND rg0.t=r.t),
  rs AS (SELECT region, t, x - avg(x) OVER (PARTITION BY region ORDER BY t ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS s FROM rg QUALIFY t >= 6),
  ent AS (SELECT DISTINCT p_brand AS entity, substr(p_brand,7,1) AS region FROM part),
  su AS (SELECT entity, t, s, true AS own FROM own UNION ALL SELECT e.entity, t, s, false FROM ent e JOIN rs USING (region) WHERE e.entity NOT IN (SELECT entity FROM own))"""


def _surprise(spark: SparkSession, d: str) -> DataFrame:
    news, reg = fx.news(spark, d), fx.regions(spark, d)
    regional = news.join(reg, "entity").select("region", "t", "n")
    return evt.surprise_with_fallback(evt.surprise(news, "entity", T), evt.surprise(regional, "region", T), reg)


@query("news_surprise_fallback", f"WITH {_SURPRISE} SELECT entity, t, round(s, 6) AS s, own FROM su")
def news_surprise_fallback(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_surprise(spark, d), s=6)


_SH = f"{P24}, {OWN.replace('own AS', 'ow AS')}, {scaled('ow')}, {SHIFTS}"


def _z(spark: SparkSession, d: str) -> DataFrame:
    return dt.prepare(pq._panel(spark, d), 8)


def _shifts(spark: SparkSession, d: str) -> DataFrame:
    return dt.confirmed_shifts(_z(spark, d), "z", T)


@query("confirmed_shifts", f"WITH {_SH} SELECT entity, category, t, round(sh, 4) AS sh FROM sh")
def confirmed_shifts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_shifts(spark, d), sh=4)


@query("event_study_lift", f"""WITH {_SH}, {_SURPRISE}, j AS (SELECT lag, sh.t, abs(sh) >= 2 AS big, s >= 0.3 AS hit FROM sh CROSS JOIN (SELECT CAST(l AS INTEGER) AS lag FROM range(-2,3) r(l)) JOIN su ON su.entity=sh.entity AND su.t=sh.t+lag WHERE sh IS NOT NULL AND s IS NOT NULL),
  m AS (SELECT lag, t, avg(big::INT) AS p, count(*) FILTER (hit) AS n, count(*) FILTER (hit AND big) AS obs FROM j GROUP BY 1,2)
SELECT lag, round(CASE WHEN sum(n*p) > 0 THEN sum(obs)/sum(n*p) END, 6) AS lift, round(sum(obs)/sum(n), 6) AS p_news, round(sum(n*p)/sum(n), 6) AS p_expected, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY 1 HAVING sum(n) > 0""")
def event_study_lift(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evt.event_study(_shifts(spark, d), _surprise(spark, d), 2.0, 0.3, [-2, -1, 0, 1, 2]), lift=6, p_news=6, p_expected=6)


_RESPONSE = f"""WITH {_SH}, {NEWS}, j AS (SELECT sh.*, n.entity IS NOT NULL AS hit FROM sh LEFT JOIN (SELECT entity, t FROM news WHERE n >= 2) n ON n.entity=sh.entity AND n.t=sh.t WHERE sh IS NOT NULL),
  q AS (SELECT entity, hit, sh - avg(sh) FILTER (NOT hit) OVER (PARTITION BY {{}}) AS d FROM j) SELECT count(*) AS treated, count(DISTINCT entity) AS entities, round(avg(d),6) AS shift, round(avg(abs(d)),6) AS abs_shift FROM q WHERE hit"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return fx.news(spark, d).where("n >= 2").select("entity", "t")


@query("news_response", _RESPONSE.format("t"))
def news_response(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evt.response(_shifts(spark, d), _hits(spark, d)), shift=6, abs_shift=6)


@query("news_response_within", _RESPONSE.format("entity, category"))
def news_response_within(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evt.response(_shifts(spark, d), _hits(spark, d), within=True), shift=6, abs_shift=6)


@query("news_coverage", f"WITH {NEWS}, e AS (SELECT DISTINCT p_brand AS entity, substr(p_brand,7,1) AS region FROM part) SELECT region, count(*) AS entities, count(*) FILTER (entity IN (SELECT entity FROM news)) AS covered FROM e GROUP BY 1")
def news_coverage(spark: SparkSession, d: str) -> DataFrame:
    return evt.coverage(fx.news(spark, d), fx.regions(spark, d))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return _z(spark, d).select("entity", "category", "t", F.abs("z").alias("s"))


_S = f"WITH {P24}, {OWN.replace('own AS', 'ow AS')}, {scaled('ow')}, s AS (SELECT entity, category, t, abs(z) AS s FROM z)"


@query("news_prior", f"""{_S}, {NEWS}, r AS (SELECT DISTINCT entity, CAST(t + k AS INTEGER) AS t FROM news, range(0,3) x(k) WHERE n >= 2)
SELECT s.entity, s.category, s.t, round(s + CASE WHEN r.entity IS NULL THEN 0 ELSE 2*ln(25) END, 4) AS s FROM s LEFT JOIN r ON r.entity=s.entity AND r.t=s.t""")
def news_prior(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dt.with_news(_scores(spark, d), _hits(spark, d), 25.0), s=4)


@query("panel_ssm_news_forecast")
def panel_ssm_news_forecast(spark: SparkSession, d: str) -> DataFrame:
    from veska.operators.local_model import panel_ssm

    known = (F.year("announced") - 1999) * 12 + F.month("announced") - 8  # of the short panel from 1999-08
    events = fx.catalogue(spark).select("ids", F.col("month").alias("t"), known.alias("known"))
    out = panel_ssm(pq._logs(spark, d), cut(pq._trajectory(spark, d)), FIRST, LAST, H, evt.known_boosts(events, FIRST, LAST, 25.0))
    return rounded(out, f=2, var=6)


@query("known_boosts", f"""WITH {_CAT}, e AS (SELECT entity, CAST(month + s AS INTEGER) AS t, (year(announced)-1999)*12+month(announced)-8 AS known FROM (SELECT unnest(ids) AS entity, month, announced FROM cat), range(0,2) x(s)), os AS (SELECT CAST(o AS INTEGER) AS o FROM range({FIRST},{LAST + 1}) r(o)),
  k AS (SELECT DISTINCT o, entity, t FROM e, os WHERE known <= o AND t <= o), g AS (SELECT o, entity, CAST(unnest(range(0, o+1)) AS INTEGER) AS t FROM (SELECT DISTINCT o, entity FROM k))
SELECT g.o, g.entity, g.t, CASE WHEN k.t IS NULL THEN 1.0::DOUBLE ELSE 25.0::DOUBLE END AS q FROM g LEFT JOIN k ON k.o=g.o AND k.entity=g.entity AND k.t=g.t""")
def known_boosts(spark: SparkSession, d: str) -> DataFrame:
    known = (F.year("announced") - 1999) * 12 + F.month("announced") - 8
    events = fx.catalogue(spark).select("ids", F.col("month").alias("t"), known.alias("known"))
    return evt.known_boosts(events, FIRST, LAST, 25.0).select("o", "entity", F.posexplode("q").alias("t", "q"))


@query("bocpd_news_scores", pq.run_length_sql(f", {_CAT}, bst AS (SELECT DISTINCT entity, CAST(month + s AS INTEGER) AS t FROM (SELECT unnest(ids) AS entity, month FROM cat), range(0,2) x(s))", "least(CASE WHEN EXISTS (SELECT 1 FROM bst WHERE bst.entity=z.entity AND bst.t=z.t) THEN 25.0 ELSE 1.0 END/24, 0.99)"))
def bocpd_news_scores(spark: SparkSession, d: str) -> DataFrame:
    z = cut(_z(spark, d))
    boosts = evt.boost(z, fx.catalogue(spark).select("ids", F.col("month").alias("t")), 25.0)
    return rounded(dt.run_length(z, T, boosts=boosts), s=4)


@query("two_channels", f"SELECT a.entity, a.category, a.t, greatest(a.s, b.s) AS s FROM ({pq.ORACLE['cusum_scores']}) a LEFT JOIN ({pq.ORACLE['ssm_lr_scores']}) b ON b.entity=a.entity AND b.category=a.category AND b.t=a.t")
def two_channels(spark: SparkSession, d: str) -> DataFrame:
    z = cut(_z(spark, d))
    return rounded(dt.either(dt.cusum(z, T), dt.step_ratio(z, T, 0.1, 0.5)), s=4)


@query("explained_alarms", f"""{_S}, {NEWS}, r AS (SELECT DISTINCT entity, CAST(t + k AS INTEGER) AS t FROM news, range(0,3) x(k) WHERE n >= 2), j AS (SELECT s.s, r.entity IS NOT NULL AS hit FROM s LEFT JOIN r ON r.entity=s.entity AND r.t=s.t), q AS (SELECT quantile_cont(s, 0.95) AS thr FROM j)
SELECT count(*) FILTER (s > thr) AS alarms, round(avg(hit::INT) FILTER (s > thr), 6) AS with_news, round(avg(hit::INT), 6) AS base FROM j, q""")
def explained_alarms(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evt.explained(_scores(spark, d), _hits(spark, d), 0.05), with_news=6, base=6)


@query("labelled_eval", f"""WITH {_SH}, s AS (SELECT entity, category, t, abs(z) AS s FROM z WHERE t BETWEEN 6 AND 21), th AS (SELECT unnest([0.01::DOUBLE, 0.02::DOUBLE, 0.05::DOUBLE]) AS rate, unnest(quantile_cont(s, [0.99, 0.98, 0.95])) AS threshold FROM s),
  j AS (SELECT rate, threshold, s.entity, s.category, s.t, s > threshold AS alarm, coalesce(abs(sh) >= 2, false) AS big FROM s CROSS JOIN th LEFT JOIN sh ON sh.entity=s.entity AND sh.category=s.category AND sh.t=s.t),
  kk AS (SELECT *, alarm AND bool_or(big) OVER (PARTITION BY rate, entity, category ORDER BY t RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS ok, big AND bool_or(alarm) OVER (PARTITION BY rate, entity, category ORDER BY t RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING) AS caught FROM j)
SELECT rate, round(threshold,4) AS threshold, round(count(*) FILTER (ok)/greatest(count(*) FILTER (alarm),1),6) AS precision, round(count(*) FILTER (caught)/greatest(count(*) FILTER (big),1),6) AS recall, count(*) FILTER (alarm) AS alarms, count(*) FILTER (big) AS shifts FROM kk GROUP BY 1, kk.threshold""")
def labelled_eval(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dt.labelled(_scores(spark, d), _shifts(spark, d), 2.0, [0.01, 0.02, 0.05], 6, 21), threshold=4, precision=6, recall=6)


@query("case_gallery", f"""WITH cu AS ({pq.ORACLE['cusum_scores']}), lr AS ({pq.ORACLE['ssm_lr_scores']}), zz AS ({pq.ORACLE['normalised_panel']}), shf AS ({ORACLE['confirmed_shifts']}), fm AS (WITH {P24}, {FORECASTS}, {PAIRS} SELECT entity, category, avg(abs(act-f)) AS e FROM pairs WHERE model='naive' AND h <= 3 GROUP BY 1,2),
  b AS (SELECT entity, category, max(s) AS top FROM cu WHERE t >= 8 GROUP BY 1,2 ORDER BY top DESC, 1, 2 LIMIT 10),
  g AS (SELECT b.entity, b.category, top, (SELECT min(t) FROM cu x WHERE x.entity=b.entity AND x.category=b.category AND t >= 8 AND s > 4) AS cusum, (SELECT min(t) FROM lr x WHERE x.entity=b.entity AND x.category=b.category AND t >= 8 AND s > 6) AS step_ratio, (SELECT min(t) FROM zz x WHERE x.entity=b.entity AND x.category=b.category AND t >= 8 AND abs(z) > 3) AS level FROM b)
SELECT g.entity, g.category, top, cusum, step_ratio, level, least(cusum, step_ratio, level) AS t, greatest(cusum, step_ratio, level) - least(cusum, step_ratio, level) AS lag, shf.sh AS shift, round(fm.e, 2) AS mae3
  FROM g LEFT JOIN shf ON shf.entity=g.entity AND shf.category=g.category AND shf.t=least(cusum, step_ratio, level) LEFT JOIN fm ON fm.entity=g.entity AND fm.category=g.category""")
def case_gallery(spark: SparkSession, d: str) -> DataFrame:
    """The series of the highest scores of one channel with the first alarms of three and the
    time between them, the confirmed shift at the first, and the error of the last value as a
    forecast over three steps."""
    z = cut(_z(spark, d))
    channels = {"cusum": (dt.cusum(z, T), 4.0), "step_ratio": (dt.step_ratio(z, T, 0.1, 0.5), 6.0), "level": (_scores(spark, d), 3.0)}
    channels = {k: (cut(rounded(s, s=4)), x) for k, (s, x) in channels.items()}
    out = cut(dt.top_alarms(channels["cusum"][0], 10, 8).select("entity", "category", F.col("s").alias("top")))
    for name, (scores, threshold) in channels.items():
        out = out.join(dt.first_alarm(scores, F.lit(threshold), 8).withColumnRenamed("first", name), ["entity", "category"], "left")
    out = out.withColumn("t", F.least(*channels)).withColumn("lag", F.greatest(*channels) - F.col("t"))
    shift = dt.confirmed_shifts(z, "z", T).select("entity", "category", "t", F.round("sh", 4).alias("shift"))
    errors = ev.pairs(fo.naive(fx.packed24(spark, d), FIRST, LAST, 3), fx.panel24(spark, d)).groupBy("entity", "category").agg(F.round(F.avg(F.abs(F.col("y") - F.col("f"))), 2).alias("mae3"))
    return out.join(shift, ["entity", "category", "t"], "left").join(errors, ["entity", "category"], "left")


@query("event_alarm_delay", f"""{_S}, {_CAT}, e AS (SELECT event_id, unnest(ids) AS entity, month AS t0 FROM cat)
SELECT event_id, s.entity, category, coalesce(min(CASE WHEN s > 1.5 AND t BETWEEN t0 AND t0+2 THEN t-t0 END), -1) AS delay FROM s JOIN e USING (entity) GROUP BY 1,2,3""")
def event_alarm_delay(spark: SparkSession, d: str) -> DataFrame:
    e = fx.catalogue(spark).select("event_id", F.explode("ids").alias("entity"), F.col("month").alias("t"))
    return evt.first_alarm_after(_scores(spark, d), e, 1.5, 3)


@query("event_effect_on_forecast", f"""WITH {P24}, {FORECASTS}, {PAIRS}, {_CAT}, r AS (SELECT DISTINCT entity, CAST(month + k AS INTEGER) AS o FROM (SELECT unnest(ids) AS entity, month FROM cat), range(0,6) x(k))
SELECT h, round(avg(abs(act-f)) FILTER (model='naive'),2) AS mae_a, round(avg(abs(act-f)) FILTER (model='seasonal_naive'),2) AS mae_b, count(*) FILTER (model='naive') AS n FROM pairs JOIN r USING (entity, o) GROUP BY 1""")
def event_effect_on_forecast(spark: SparkSession, d: str) -> DataFrame:
    p = fx.packed24(spark, d)
    paired = ev.pairs(fo.naive(p, FIRST, LAST, H).unionByName(fo.seasonal_naive(p, FIRST, LAST, H)), fx.panel24(spark, d))
    e = fx.catalogue(spark).select(F.explode("ids").alias("entity"), F.col("month").alias("t"))
    return rounded(evt.effect_on_forecast(paired, e, "naive", "seasonal_naive"), mae_a=2, mae_b=2)


@query("tokenise", "WITH w AS (SELECT lower(unnest(regexp_extract_all(text, '\\p{L}+'))) AS word FROM documents WHERE text IS NOT NULL) SELECT word, count(*) AS n FROM w GROUP BY 1")
def tokenise(spark: SparkSession, d: str) -> DataFrame:
    return tx.tokens(table(spark, d, "documents"), "doc_id", "text").groupBy("word").agg(F.count("*").alias("n"))


_ENDS = "|".join(tx.ENDINGS)


@query("stems", rf"WITH w AS (SELECT lower(unnest(regexp_extract_all(text, '\pL+'))) AS word FROM documents WHERE text IS NOT NULL) SELECT regexp_replace(word, '^(.{{3,}}?)(?:{_ENDS})$', '\1') AS stem, count(*) AS n FROM w GROUP BY 1")
def stems(spark: SparkSession, d: str) -> DataFrame:
    t = tx.tokens(table(spark, d, "documents"), "doc_id", "text").groupBy("word").agg(F.count("*").alias("n"))
    return t.groupBy(tx.stem(F.col("word")).alias("stem")).agg(F.sum("n").alias("n"))


KINDS = {"flood": ["павод", "разлив", "подтопл", "flood"], "fire": ["пожар", "торфяник", "fire"], "trade": ["магазин", "торгов", "ярмар", "shop", "market"], "spending": ["расход", "затрат", "покуп", "expend", "outlay"]}
_KINDS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind FROM documents WHERE regexp_matches(lower(text), '(^|\\PL)(?:{'|'.join(s)})')" for k, s in KINDS.items())


@query("classify_types", _KINDS)
def classify_types(spark: SparkSession, d: str) -> DataFrame:
    return tx.classify(table(spark, d, "documents"), "doc_id", "text", KINDS)


@query("monthly_type_counts", f"""WITH k AS ({_KINDS}), m AS (SELECT doc_id, strftime(published_at, '%Y-%m') AS month FROM documents WHERE published_at IS NOT NULL)
SELECT month, kind, count(*) AS n FROM m JOIN k USING (doc_id) GROUP BY 1,2 UNION ALL SELECT month, 'all', count(*) FROM m GROUP BY 1""")
def monthly_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return tx.monthly_kinds(table(spark, d, "documents"), "text", "published_at", KINDS)


def _stem(word: str) -> str:
    return f"regexp_replace({word}, '^(.{{3,}}?)(?:{_ENDS})$', '\\1')"


@query("locate_places", rf"""WITH w AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS w FROM (SELECT doc_id, regexp_extract_all(text, '\pL+') AS l FROM documents WHERE text IS NOT NULL)),
  t AS (SELECT doc_id, {_stem('lower(w)')} AS stem, substr(w,1,1) <> lower(substr(w,1,1)) AS capital, lead({_stem('lower(w)')}) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM w),
  g0 AS (SELECT {_stem('lower(name_short)')} AS stem, territory_id AS code, region_code AS region, name_short LIKE '%ий' AS adjective FROM mo_dict), g AS (SELECT *, count(*) OVER (PARTITION BY stem) AS options FROM g0),
  h AS (SELECT doc_id, code, region, options FROM t JOIN g USING (stem) WHERE capital AND (NOT adjective OR nx IN ('район','округ'))), s AS (SELECT DISTINCT doc_id, region FROM h WHERE options = 1)
SELECT code, count(*) AS docs FROM (SELECT doc_id, code FROM h WHERE options = 1 UNION SELECT doc_id, code FROM h JOIN s USING (doc_id, region) WHERE options > 1) GROUP BY 1""")
def locate_places(spark: SparkSession, d: str) -> DataFrame:
    mo = table(spark, d, "mo_dict")
    g = mo.select(tx.stem(F.lower("name_short")).alias("stem"), F.col("territory_id").alias("code"), F.col("region_code").alias("region"), F.col("name_short").endswith("ий").alias("adjective"))
    return tx.located(table(spark, d, "documents"), "doc_id", "text", g, ["район", "округ"]).groupBy("code").agg(F.count("*").alias("docs"))


@query("html_item_extract", r"""WITH i AS (SELECT doc_id, unnest(regexp_extract_all(text, '<p>([^<]*)</p>', 1)) AS item FROM documents WHERE text IS NOT NULL)
SELECT doc_id, trim(replace(replace(replace(replace(replace(item, '&nbsp;', ' '), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), ' ') AS item, count(*) AS n FROM i GROUP BY 1,2""")
def html_item_extract(spark: SparkSession, d: str) -> DataFrame:
    return tx.page_items(table(spark, d, "documents"), "doc_id", "text", r"<p>([^<]*)</p>").groupBy("doc_id", "item").agg(F.count("*").alias("n"))


@query("dedupe_keep_first", "SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY coalesce(text, '')")
def dedupe_keep_first(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))  # digests move, texts do not
    first = tx.first_seen(docs, ["h"], ["doc_id"])
    return first.join(docs.groupBy("h").agg(F.count("*").alias("n")), "h").select("doc_id", "n")


@query("region_keys", r"SELECT DISTINCT region_name, trim(regexp_replace(lower(region_name), '(республика|область|край)', '')) AS key FROM mo_dict")
def region_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mo_dict").select("region_name", tx.region_key(F.col("region_name")).alias("key")).distinct()


@query("parquet_pushdown", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40")
def parquet_pushdown(spark: SparkSession, d: str) -> DataFrame:
    return src.parquet(spark, f"{d}/lineitem.parquet", columns=["l_orderkey", "l_linenumber", "l_quantity"], where=(F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40))


@query("json_field_scan", "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1,2")
def json_field_scan(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("csv_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    with scratch(spark, "csv") as path:
        src.write_csv(table(spark, d, "nation"), path, gzip=True)
        return cut(src.csv(spark, path, "n_nationkey int, n_name string, n_regionkey int"))


@query("forecast_store", f"WITH {P24}, {FORECASTS} SELECT model, o, entity, category, h, round(f, 4) AS f FROM fc WHERE model = 'naive'")
def forecast_store(spark: SparkSession, d: str) -> DataFrame:
    p = cut(fx.packed24(spark, d))
    with scratch(spark, "store") as path:
        src.write_store(fo.naive(p, FIRST, LAST, H).unionByName(fo.seasonal_naive(p, FIRST, LAST, H)), path)
        return cut(rounded(src.read_store(spark, path, ["naive"]).select("model", "o", "entity", "category", "h", "f"), f=4))


@query("resume_missing", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-03-01')")
def resume_missing(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").where("o_orderdate < timestamp_ntz'1995-03-01'").select(F.col("o_custkey").alias("c_custkey"))
    return src.missing_work(table(spark, d, "customer").select("c_custkey"), done, ["c_custkey"])


@query("clean_json_rows", "SELECT CAST(to_json(struct_pack(c_custkey := c_custkey, c_name := c_name, c_nationkey := c_nationkey, c_acctbal := CASE WHEN isfinite(c_acctbal) THEN round(c_acctbal, 4) END, c_mktsegment := c_mktsegment)) AS VARCHAR) AS json FROM customer")
def clean_json_rows(spark: SparkSession, d: str) -> DataFrame:
    return src.clean_json(table(spark, d, "customer"))


_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@query("stream_daily_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1,2")
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    stream = monthly.windowed(monthly.file_stream(spark, f"{d}/event[s].parquet", _EVENTS), "ts", ["event_type"], "value")
    with scratch(spark, "stream") as folder:
        out = stream.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out"))
        out.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        got = spark.read.parquet(f"{folder}/out")
        return cut(got.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total")))


@query("stream_cusum", """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts)::DOUBLE AS "at", (value - 50)/30 AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
  c AS (SELECT user_id, 0::BIGINT AS k, NULL::DOUBLE AS "at", 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn FROM e GROUP BY 1 UNION ALL SELECT e.user_id, e.k, e."at", greatest(0.0, up + x - 0.5), greatest(0.0, dn - x - 0.5) FROM c JOIN e ON e.user_id=c.user_id AND e.k=c.k+1)
SELECT user_id AS source, "at", round(greatest(up, dn), 6) AS s FROM c WHERE k > 0""")
def stream_cusum(spark: SparkSession, d: str) -> DataFrame:
    s = monthly.file_stream(spark, f"{d}/event[s].parquet", _EVENTS).where("value is not null").withColumn("z", (F.col("value") - 50) / 30).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    with scratch(spark, "stream") as folder:
        return cut(rounded(monthly.drain(monthly.cusum_stream(s, "user_id", "at", "z"), folder), s=6))
