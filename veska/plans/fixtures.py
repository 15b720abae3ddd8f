"""Panels and their companions over the star schema, with the same tables as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veska.operators.panel import packed
from veska.session import table

#: The short panel: 24 months from 1999-08, which is month 55 since 1995-01.
OFFSET, T, FIRST, LAST, H, START_MONTH = 55, 24, 11, 22, 12, 7
MAPPING = [("A", "total"), ("N", "1-URGENT"), ("R", "5-LOW")]


def month_no(col: str) -> F.col:
    return ((F.year(col) - 1995) * 12 + F.month(col) - 1).cast("int")


def panel_brand(spark: SparkSession, d: str) -> DataFrame:
    """Monthly revenue by brand and return flag, months 0 (1995-01) to 81."""
    li = table(spark, d, "lineitem").where("l_shipdate < timestamp_ntz'2001-11-01'").select("l_partkey", F.col("l_returnflag").alias("category"), month_no("l_shipdate").alias("t"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x"))
    # Lines are summed up per part before they meet the parts.
    per = li.groupBy("l_partkey", "category", "t").agg(F.sum("x").alias("x"))
    part = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("entity"))
    return per.join(part, per.l_partkey == part.p_partkey).groupBy("entity", "category", "t").agg(F.sum("x").alias("v"))


def panel24(spark: SparkSession, d: str) -> DataFrame:
    p = panel_brand(spark, d).where(F.col("t").between(OFFSET, OFFSET + T - 1))
    return p.select("entity", "category", (F.col("t") - OFFSET).alias("t"), "v")


def packed24(spark: SparkSession, d: str) -> DataFrame:
    return packed(panel24(spark, d), T)


def outside(spark: SparkSession, d: str) -> DataFrame:
    """(series, t, x): logs of monthly order totals by priority and in total, 79 months."""
    o = table(spark, d, "orders").where("o_orderdate < timestamp_ntz'2001-08-01'").select(F.col("o_orderpriority").alias("series"), month_no("o_orderdate").alias("t"), "o_totalprice")
    by = o.groupBy("series", "t").agg(F.sum("o_totalprice").alias("s"))
    total = by.groupBy(F.lit("total").alias("series"), "t").agg(F.sum("s").alias("s"))
    return by.unionByName(total).select("series", "t", F.log("s").alias("x"))


def mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MAPPING, "category string, series string")


def cutoffs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(o, o + OFFSET) for o in range(FIRST, LAST + 1)], "o int, upto int")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Brand pairs with the difference of their mean prices as distance (brands are few)."""
    p = table(spark, d, "part").groupBy(F.col("p_brand").alias("b")).agg(F.avg("p_retailprice").alias("m"))
    q = p.select(F.col("b").alias("a"), F.col("m").alias("ma"))
    return q.join(p, F.col("a") < F.col("b")).select("a", "b", F.abs(F.col("ma") - F.col("m")).alias("distance"))


def market_access(spark: SparkSession, d: str) -> DataFrame:
    """(entity, ma): the brand's mean price stands for market access."""
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("entity")).agg(F.avg("p_retailprice").alias("ma"))


def regions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_brand").alias("entity"), F.substring("p_brand", 7, 1).alias("region")).distinct()


def news(spark: SparkSession, d: str) -> DataFrame:
    """(entity, t, n): returns of large lines by brand and month of the short panel."""
    li = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45 and l_shipdate < timestamp_ntz'2001-08-01'").select("l_partkey", month_no("l_shipdate").alias("m")).where(F.col("m") >= OFFSET)
    per = li.groupBy("l_partkey", "m").agg(F.count("*").alias("c"))
    part = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("entity"))
    return per.join(part, per.l_partkey == part.p_partkey).groupBy("entity", (F.col("m") - OFFSET).alias("t")).agg(F.sum("c").alias("n"))


#: (event_id, kind, ids, month of the short panel, announced)
CATALOGUE = [
    ("X1", "flood", ["Brand#11", "Brand#12"], 5, "2000-01-20"),
    ("X2", "mall", ["Brand#23"], 9, "2000-05-02"),
    ("X3", "flood", ["Brand#45", "Brand#11"], 10, "2000-09-15"),
    ("X4", "strike", ["Brand#52"], 20, "2001-04-11"),
]
REGISTRY = [("7", "fire", "Brand#11", 5, "2000-01-25"), ("8", "fire", "Brand#33", 14, "2000-10-30"), ("9", "storm", None, 3, "1999-11-01"), ("10", "fire", "Brand#52", 21, "2001-05-02")]


def catalogue(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(CATALOGUE, "event_id string, kind string, ids array<string>, month int, announced string")
    return df.withColumn("announced", F.to_date("announced"))


def registry(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(REGISTRY, "event_id string, kind string, entity string, month int, announced string")
    return df.withColumn("announced", F.to_date("announced"))


# The same as SQL.
PANEL = """panel AS (SELECT p_brand AS entity, l_returnflag AS category, CAST((year(l_shipdate)-1995)*12+month(l_shipdate)-1 AS INTEGER) AS t,
  sum(l_extendedprice*(1-l_discount)) AS v FROM lineitem JOIN part ON l_partkey=p_partkey WHERE l_shipdate < TIMESTAMP '2001-11-01' GROUP BY 1,2,3)"""
P24 = PANEL + f""", p24 AS (SELECT entity, category, t-{OFFSET} AS t, v, ln(v) AS y FROM panel WHERE t BETWEEN {OFFSET} AND {OFFSET + T - 1}),
  os AS (SELECT CAST(o AS INTEGER) AS o FROM range({FIRST},{LAST + 1}) r(o)), hs AS (SELECT CAST(h AS INTEGER) AS h FROM range(1,{H + 1}) r(h))"""
OUTSIDE = """ext0 AS (SELECT o_orderpriority AS series, CAST((year(o_orderdate)-1995)*12+month(o_orderdate)-1 AS INTEGER) AS t, sum(o_totalprice) AS s
  FROM orders WHERE o_orderdate < TIMESTAMP '2001-08-01' GROUP BY 1,2),
  ext AS (SELECT series, t, ln(s) AS x FROM ext0 UNION ALL SELECT 'total', t, ln(sum(s)) FROM ext0 GROUP BY t)"""
MAP = "map AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}','{s}')" for c, s in MAPPING) + ") m(category, series))"
FORECASTS = """lastv AS (SELECT entity, category, o, arg_max(v, t) AS lv FROM p24, os WHERE t <= o GROUP BY ALL),
  fc AS (SELECT 'naive' AS model, o, entity, category, h, lv AS f FROM lastv, hs UNION ALL
         SELECT 'seasonal_naive', l.o, l.entity, l.category, h, coalesce(p.v, lv) FROM lastv l CROSS JOIN hs
           LEFT JOIN p24 p ON p.entity=l.entity AND p.category=l.category AND p.t=l.o+h-12)"""
PAIRS = "pairs AS (SELECT fc.*, a.v AS act FROM fc JOIN p24 a ON a.entity=fc.entity AND a.category=fc.category AND a.t=fc.o+fc.h)"
COURSE = """m AS (SELECT category, t, avg(y) AS m FROM p24 GROUP BY 1,2),
  course AS (SELECT category, o, t, m - avg(m) OVER (PARTITION BY category, o) AS n FROM m, os WHERE t <= o)"""
SEASONAL = f"""dev AS (SELECT series, t, CASE WHEN count(x) OVER lo = 12 AND count(x) OVER hi = 12 THEN x - (avg(x) OVER lo + avg(x) OVER hi)/2 END AS d FROM ext
    WINDOW lo AS (PARTITION BY series ORDER BY t ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING), hi AS (PARTITION BY series ORDER BY t ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)),
  sfm AS (SELECT series, o, t % 12 AS moy, median(d) AS m FROM dev, os WHERE d IS NOT NULL AND t + 6 <= o + {OFFSET} GROUP BY 1,2,3),
  sf AS (SELECT series, o, moy, m - avg(m) OVER (PARTITION BY series, o) AS s FROM sfm)"""
GROWTH = f"""ge AS (SELECT category, o, avg(x) FILTER (t-o-{OFFSET} BETWEEN -2 AND 0) - avg(x) FILTER (t-o-{OFFSET} BETWEEN -14 AND -12) AS ge FROM map JOIN ext USING (series), os GROUP BY 1,2),
  gp AS (SELECT category, o, avg(n) FILTER (t-o BETWEEN -2 AND 0) - avg(n) FILTER (t-o BETWEEN -14 AND -12) AS gp FROM course GROUP BY 1,2),
  g AS (SELECT category, o, CASE WHEN o >= 14 THEN (ge+gp)/2 ELSE ge END AS g FROM ge JOIN gp USING (category, o))"""
RULES = f"""rules AS (SELECT c.category, c.o, h, CASE WHEN h.h <= 12 AND c.o+h.h-12 >= 0 THEN c12.n + g ELSE c.n + g*h/12 END AS snaive,
    c.n + CASE WHEN c.o >= 12 THEN c12.n - cy.n - (c.n - cy.n)*h/12 ELSE sh.s - s0.s END + g*h/12 AS hybrid,
    (c.n - s0.s + c1.n - s1.s + c2.n - s2.s)/3 + g/12 + g*h/12 + sh.s AS extlvl
  FROM course c JOIN map USING (category) JOIN g ON g.category=c.category AND g.o=c.o CROSS JOIN hs h
    LEFT JOIN course c12 ON c12.category=c.category AND c12.o=c.o AND c12.t=c.o+h.h-12
    LEFT JOIN course cy ON cy.category=c.category AND cy.o=c.o AND cy.t=c.o-12
    JOIN course c1 ON c1.category=c.category AND c1.o=c.o AND c1.t=c.o-1 JOIN course c2 ON c2.category=c.category AND c2.o=c.o AND c2.t=c.o-2
    JOIN sf s0 ON s0.series=map.series AND s0.o=c.o AND s0.moy=(c.o+{START_MONTH})%12 JOIN sf s1 ON s1.series=map.series AND s1.o=c.o AND s1.moy=(c.o-1+{START_MONTH})%12
    JOIN sf s2 ON s2.series=map.series AND s2.o=c.o AND s2.moy=(c.o-2+{START_MONTH})%12 JOIN sf sh ON sh.series=map.series AND sh.o=c.o AND sh.moy=(c.o+h.h+{START_MONTH})%12
  WHERE c.t = c.o)"""
EDGES = """pm AS (SELECT p_brand AS b, avg(p_retailprice) AS m FROM part GROUP BY 1), e AS (SELECT x.b AS a, y.b AS b, abs(x.m-y.m) AS distance FROM pm x JOIN pm y ON x.b < y.b),
  near AS (SELECT * FROM (SELECT a, b, distance, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS rank FROM (SELECT a,b,distance FROM e UNION ALL SELECT b,a,distance FROM e)) WHERE rank <= 5)"""
OWN = "own AS (SELECT entity, category, t, y - avg(y) OVER (PARTITION BY category, t) AS l FROM p24)"


def scaled(source: str, ref: int = 8) -> str:
    """CTE z: cells of ``source`` (entity, category, t, l) centred and in units of noise."""
    return f"""df AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY entity, category ORDER BY t) = 1 THEN l - lag(l) OVER (PARTITION BY entity, category ORDER BY t) END AS d FROM {source} WHERE t < {ref}),
  md AS (SELECT entity, category, median(d) AS m FROM df GROUP BY 1,2),
  k0 AS (SELECT entity, category, (1.4826*median(abs(d-m)))**2 AS k FROM df JOIN md USING (entity, category) GROUP BY 1,2),
  k AS (SELECT entity, category, greatest(coalesce(k, (SELECT median(k) FROM k0)), 1e-4) AS k FROM k0),
  z AS (SELECT entity, category, t, (l - avg(l) FILTER (t < {ref}) OVER (PARTITION BY entity, category))/sqrt(k) AS z FROM {source} JOIN k USING (entity, category))"""


NEWS = f"""news AS (SELECT p_brand AS entity, CAST((year(l_shipdate)-1995)*12+month(l_shipdate)-1-{OFFSET} AS INTEGER) AS t, count(*) AS n FROM lineitem JOIN part ON l_partkey=p_partkey
  WHERE l_returnflag='R' AND l_quantity > 45 AND l_shipdate < TIMESTAMP '2001-08-01' AND (year(l_shipdate)-1995)*12+month(l_shipdate)-1 >= {OFFSET} GROUP BY 1,2)"""
SHIFTS = """sh AS (SELECT * FROM (SELECT entity, category, t, avg(z) OVER (PARTITION BY entity, category ORDER BY t RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING)
    - avg(z) OVER (PARTITION BY entity, category ORDER BY t RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) AS sh FROM z) WHERE t BETWEEN 3 AND 21)"""
