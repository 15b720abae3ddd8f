"""Queries p1-p4 and p6 over the tables of an input folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veska.functions.dates import month_index, month_name, parse_date
from veska.operators.intervals import interval_gaps, merge_intervals
from veska.operators.orphans import orphan_references, orphan_report
from veska.operators.packed import split_packed
from veska.operators.regular_grid import regular_grid
from veska.operators.spikes import implausible_readings
from veska.session import cut, table

def territories(spark: SparkSession, d: str) -> DataFrame:
    """events_merged with one row per packed territory."""
    events = table(spark, d, "events_merged").select("event_id", "territory_ids", "announce_date").distinct()
    return split_packed(events, "territory_ids")

def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per value packed in the two fields."""
    categories = cut(table(spark, d, "consumption").select("category").distinct())
    registry = table(spark, d, "event_registry_rav11l").select("event_id", "affected_categories").distinct()
    named = split_packed(registry, "affected_categories", lexicon=categories)
    out = lambda df, t: df.select(F.lit(t).alias("src_table"), "event_id", "pos", "val")
    return out(territories(spark, d), "events_merged").unionByName(out(named, "event_registry_rav11l"))

def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    """The monthly series of consumption with gaps filled or marked."""
    grid = regular_grid(
        table(spark, d, "consumption"), ["territory_id", "category"], month_index(F.col("date")), "value", "loaded_at"
    )
    return grid.select(
        "territory_id", "category", month_name(F.col("bucket")).alias("month"), "n", "value", "filled", "mark"
    )

def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Months without a usable reading inside a series."""
    return p2_grid(spark, d).where("n = 0").select("territory_id", "category", "month")

def _orphans(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "event_registry_maloyan").select(
        F.lit("event_registry_maloyan").alias("src_table"), "event_id", F.col("territory_id").cast("bigint").alias("territory_id"), "announce_date"
    )
    many = territories(spark, d).select(
        F.lit("events_merged").alias("src_table"), "event_id", F.expr("try_cast(val as bigint)").alias("territory_id"), "announce_date"
    )
    refs = cut(one.unionByName(many).withColumn("day", parse_date(F.col("announce_date"))).drop("announce_date"))
    return orphan_references(
        refs, "territory_id", "day", table(spark, d, "market_access"), "territory_id", "added_on", "removed_on"
    ).withColumn("period", F.date_format("day", "yyyy-MM"))

def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """References to territories that are not listed on the day of the announcement."""
    return _orphans(spark, d).select("src_table", "period", "event_id", "territory_id").distinct()

def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table and month."""
    return orphan_report(_orphans(spark, d), "src_table", "territory_id", "period")

def _spans(spark: SparkSession, d: str) -> DataFrame:
    end = F.trim(F.col("end_date"))
    return table(spark, d, "event_registry_maloyan").select(
        F.col("territory_id").cast("bigint").alias("territory_id"),
        parse_date(F.col("effective_date")).alias("start"),
        parse_date(end).alias("end"),
    )

def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Gaps between the continuous periods of a territory."""
    gaps = interval_gaps(_spans(spark, d), "territory_id", "start", "end")
    return gaps.select("territory_id", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("gap_from", "gap_to")])

def p4_periods(spark: SparkSession, d: str) -> DataFrame:
    """Continuous periods of a territory."""
    periods = merge_intervals(_spans(spark, d), "territory_id", "start", "end")
    days = [F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("period_from", "period_to")]
    return periods.select("territory_id", *days, "spans")

def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Implausible readings of consumption."""
    return implausible_readings(
        table(spark, d, "consumption"), "obs_id", ["territory_id", "category"], "category", month_index(F.col("date")), "value"
    ).select("obs_id").distinct()

QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_grid": p2_grid,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p4_found": p4_found,
    "p4_periods": p4_periods,
    "p6_found": p6_found,
}

# Equivalent SQL where dates in several notations can be read by it.
_DAY = "CAST(coalesce(try_strptime(trim({0}), '%Y-%m-%d'), try_strptime(trim({0}), '%Y/%m/%d'), try_strptime(trim({0}), '%d.%m.%Y'), try_strptime(trim({0}), '%Y-%m-%d %H:%M:%S')) AS DATE)"
_SPANS = f"""s0 AS (SELECT CAST(territory_id AS BIGINT) AS territory_id, {_DAY.format("effective_date")} AS a, coalesce({_DAY.format("end_date")}, DATE '9999-12-31') AS b FROM event_registry_maloyan),
  s AS (SELECT DISTINCT * FROM s0 WHERE territory_id IS NOT NULL AND a IS NOT NULL AND b >= a), r AS (SELECT *, max(b) OVER (PARTITION BY territory_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s)"""
_LISTED = """NOT EXISTS (SELECT 1 FROM market_access m WHERE m.territory_id = q.territory_id AND (added_on IS NULL OR added_on <= d) AND (removed_on IS NULL OR d < removed_on))"""
ORACLE = {
    "p4_found": f"WITH {_SPANS} SELECT territory_id, strftime(m + 1, '%Y-%m-%d') AS gap_from, strftime(a - 1, '%Y-%m-%d') AS gap_to FROM r WHERE m IS NOT NULL AND m < DATE '9999-12-31' AND a > m + 1",
    "p3_found": f"""WITH q AS (SELECT 'event_registry_maloyan' AS src_table, event_id, CAST(territory_id AS BIGINT) AS territory_id, {_DAY.format("announce_date")} AS d FROM event_registry_maloyan UNION ALL
  SELECT 'events_merged', event_id, CAST(unnest(regexp_extract_all(territory_ids, '\\d+')) AS BIGINT), {_DAY.format("announce_date")} FROM events_merged)
SELECT DISTINCT src_table, strftime(d, '%Y-%m') AS period, event_id, territory_id FROM q WHERE territory_id IS NOT NULL AND d IS NOT NULL AND {_LISTED}""",
}

_MONTH = r"""CASE WHEN regexp_matches(x, '^\d{4}[-/.]\d{1,2}([-/.]\d{1,2}([T ,].*)?)?$') THEN CAST(regexp_extract(x, '^(\d{4})', 1) AS INT)*12 + CAST(regexp_extract(x, '^\d{4}[-/.](\d{1,2})', 1) AS INT)
  WHEN regexp_matches(x, '^\d{1,2}[-/.]\d{1,2}[-/.]\d{4}([T ,].*)?$') THEN CAST(regexp_extract(x, '^\d{1,2}[-/.]\d{1,2}[-/.](\d{4})', 1) AS INT)*12 + CAST(regexp_extract(x, '^\d{1,2}[-/.](\d{1,2})', 1) AS INT)
  WHEN regexp_matches(x, '^\d{1,2}[-/.]\d{4}$') THEN CAST(right(x, 4) AS INT)*12 + CAST(regexp_extract(x, '^(\d{1,2})', 1) AS INT)
  WHEN regexp_matches(x, '^\d{6}(\d{2})?$') THEN CAST(left(x, 4) AS INT)*12 + CAST(substr(x, 5, 2) AS INT)
  WHEN regexp_matches(x, '^\pL{3,}\.? +\d{4}$') THEN CAST(right(x, 4) AS INT)*12 + nullif(list_position(['янв','фев','мар','апр','ма','июн','июл','авг','сен','окт','ноя','дек'], CASE WHEN lower(left(x, 3)) IN ('май','мая') THEN 'ма' ELSE lower(left(x, 3)) END), 0) END"""
ORACLE["p2_found"] = f"""WITH u AS (SELECT territory_id, category, {_MONTH} AS k, regexp_extract(x, '^\\d{{4}}[-/.](\\d+)', 1) AS mm FROM (SELECT *, trim(replace(date, chr(160), ' ')) AS x FROM consumption WHERE value IS NOT NULL AND NOT isnan(value))),
  v AS (SELECT DISTINCT territory_id, category, k - 2023*12 - 1 AS t FROM u WHERE k - 2023*12 - 1 BETWEEN 0 AND 23 AND (mm = '' OR CAST(mm AS INT) BETWEEN 1 AND 12)),
  g AS (SELECT territory_id, category, unnest(range(min(t), max(t) + 1)) AS t FROM v GROUP BY 1,2)
SELECT territory_id, category, (2023 + t//12) || '-' || lpad(CAST(t%12 + 1 AS VARCHAR), 2, '0') AS month FROM g WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.territory_id=g.territory_id AND v.category=g.category AND v.t=g.t)"""

_LISTS = r"""names AS (SELECT string_agg(regexp_replace(c, '([^\pL\pN ])', '\\\1', 'g'), '|' ORDER BY length(c) DESC, c) AS p FROM (SELECT DISTINCT category AS c FROM consumption WHERE category IS NOT NULL)),
  l AS (SELECT 'event_registry_rav11l' AS src_table, event_id, regexp_extract_all(f, '(?i)' || p || '|\pL+') AS v FROM (SELECT DISTINCT event_id, affected_categories AS f FROM event_registry_rav11l WHERE affected_categories IS NOT NULL), names
    UNION ALL SELECT 'events_merged', event_id, regexp_extract_all(f, '\d+') FROM (SELECT DISTINCT event_id, territory_ids AS f FROM events_merged WHERE territory_ids IS NOT NULL))"""
ORACLE["p1_found"] = f"WITH {_LISTS} SELECT src_table, event_id, CAST(generate_subscripts(v, 1) AS BIGINT) AS pos, unnest(v) AS val FROM l"
ORACLE["p3_report"] = f"""WITH m AS (SELECT DISTINCT event_id, territory_ids, announce_date FROM events_merged), q AS (SELECT 'event_registry_maloyan' AS src_table, CAST(territory_id AS BIGINT) AS territory_id, {_DAY.format("announce_date")} AS d FROM event_registry_maloyan UNION ALL
  SELECT 'events_merged', CAST(unnest(regexp_extract_all(territory_ids, '\\d+')) AS BIGINT), {_DAY.format("announce_date")} FROM m)
SELECT src_table, strftime(d, '%Y-%m') AS period, count(*) AS orphans, count(DISTINCT territory_id) AS keys FROM q WHERE territory_id IS NOT NULL AND d IS NOT NULL AND {_LISTED} GROUP BY 1,2"""
ORACLE["p4_periods"] = f"""WITH {_SPANS.replace('s AS (SELECT DISTINCT * FROM', 's AS (SELECT * FROM')}, g AS (SELECT *, sum(CASE WHEN m IS NULL OR (m < DATE '9999-12-31' AND a > m + 1) THEN 1 ELSE 0 END) OVER (PARTITION BY territory_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM r)
SELECT territory_id, strftime(min(a), '%Y-%m-%d') AS period_from, strftime(max(b), '%Y-%m-%d') AS period_to, count(*) AS spans FROM g GROUP BY territory_id, k"""
_GRID = ORACLE["p2_found"].replace("SELECT *, trim(replace(date, chr(160), ' ')) AS x", "SELECT *, trim(replace(date, chr(160), ' ')) AS x").replace("WITH u AS (SELECT territory_id, category,", "WITH u AS (SELECT territory_id, category, value, loaded_at,")
ORACLE["p2_grid"] = _GRID[: _GRID.index("  v AS (SELECT DISTINCT")] + """  c AS (SELECT territory_id, category, k - 2023*12 - 1 AS t, count(*) AS n, max(struct_pack(a := loaded_at, v := value)).v AS v FROM u WHERE k - 2023*12 - 1 BETWEEN 0 AND 23 AND (mm = '' OR CAST(mm AS INT) BETWEEN 1 AND 12) GROUP BY 1,2,3),
  g AS (SELECT territory_id, category, unnest(range(min(t), max(t) + 1)) AS t FROM c GROUP BY 1,2),
  j AS (SELECT g.territory_id, g.category, g.t, c.n, c.v, max(c.t) OVER w AS lt, last_value(c.v IGNORE NULLS) OVER w AS lv FROM g LEFT JOIN c ON c.territory_id=g.territory_id AND c.category=g.category AND c.t=g.t WINDOW w AS (PARTITION BY g.territory_id, g.category ORDER BY g.t ROWS UNBOUNDED PRECEDING))
SELECT territory_id, category, (2023 + t//12) || '-' || lpad(CAST(t%12 + 1 AS VARCHAR), 2, '0') AS month, coalesce(n, 0) AS n, v AS value, CASE WHEN t - lt <= 3 THEN lv END AS filled, CASE WHEN n IS NOT NULL THEN 'read' WHEN t - lt <= 3 THEN 'filled' ELSE 'missing' END AS mark FROM j"""
