"""Queries p5 and p7-p10 over the tables of an input folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veska.functions.dates import parse_date
from veska.llm.grade import reading_levels
from veska.llm.leakage import find_leaks
from veska.llm.linkage import link_records
from veska.llm.names import match_names, unmatched
from veska.llm.packing import pack_documents
from veska.session import cut, table


def _canonical(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    mo = table(spark, d, "mo_dict")
    seat = F.regexp_replace("center", r"^\S+\s+", "")
    names = mo.select(F.col("territory_id").alias("code"), "region_code", F.array("name_short", seat).alias("names"))
    return names, mo.select("region_code", "region_name").distinct()


def _values(spark: SparkSession, d: str) -> DataFrame:
    """(src_table, event_id, field_name, pos, text, beside) of the freely typed places."""
    typed = table(spark, d, "event_registry_maloyan").select("event_id", "mo_name", "region_name").distinct()
    pattern = table(spark, d, "event_registry_rav11l").select("event_id", "mo_pattern").distinct()
    row = lambda df, t, f, pos, text, beside: df.select(F.lit(t).alias("src_table"), "event_id", F.lit(f).alias("field_name"), pos.cast("bigint").alias("pos"), text.alias("text"), beside.alias("beside"))
    one, none = F.lit(1), F.lit(None).cast("string")
    places = row(typed, "event_registry_maloyan", "mo_name", one, F.col("mo_name"), F.col("region_name"))
    regions = row(typed, "event_registry_maloyan", "region_name", one, F.col("region_name"), none)
    options = F.filter(F.split("mo_pattern", r"\|"), lambda x: ~_blank(x))
    parts = pattern.select("event_id", F.posexplode(options).alias("at", "part"))
    alternatives = row(parts, "event_registry_rav11l", "mo_pattern", F.col("at") + 1, F.col("part"), none)
    return places.unionByName(regions).unionByName(alternatives).where(F.col("text").isNotNull() & ~_blank(F.col("text")))


def _blank(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s\u00a0]", "") == ""


def _matched(spark: SparkSession, d: str) -> DataFrame:
    """The typed values with ``codes``: regions against regions, the others against
    municipalities."""
    names, regions = _canonical(spark, d)
    values = _values(spark, d)
    is_region = F.col("field_name") == "region_name"
    as_region = regions.select(F.col("region_code").alias("code"), "region_code", F.array("region_name").alias("names"))
    found = []
    for rows, entries in ((values.where(~is_region), names), (values.where(is_region), as_region)):
        m = match_names(rows, entries, regions).select(F.col("text").alias("t"), F.col("beside").alias("b"), "codes")
        found.append(rows.join(m, F.col("text").eqNullSafe(F.col("t")) & F.col("beside").eqNullSafe(F.col("b"))).drop("t", "b"))
    return found[0].unionByName(found[1])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The municipality or region of every typed value, -1 where the list has none."""
    code = F.coalesce(F.try_element_at("codes", F.lit(1)), F.lit(-1)).cast("bigint").alias("code")
    return _matched(spark, d).select("src_table", "event_id", "field_name", "pos", code).distinct()


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Typed values of each field without an entry, with their number of rows."""
    return unmatched(_matched(spark, d), ["src_table", "field_name"])


def happenings(spark: SparkSession, d: str) -> DataFrame:
    """Records of the three sources: (source, id, kind, place, began, words)."""
    a = table(spark, d, "event_registry_maloyan").select(
        F.lit("a").alias("source"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("mo_name").alias("text"),
        F.col("region_name").alias("beside"), "effective_date", "announce_date", F.concat_ws(" ", "note", "territory_id").alias("words"),
    )
    r = table(spark, d, "event_registry_rav11l").select(
        F.lit("b").alias("source"), F.col("event_id").alias("id"), F.col("type").alias("kind"), F.col("mo_pattern").alias("text"),
        F.lit(None).cast("string").alias("beside"), "effective_date", "announce_date", F.col("note").alias("words"),
    ).withColumn("text", F.explode(F.split("text", r"\|")))
    m = table(spark, d, "events_merged").select(
        F.lit("c").alias("source"), F.col("event_id").alias("id"), F.col("type").alias("kind"), F.col("title").alias("text"),
        F.col("region").alias("beside"), F.lit(None).cast("string").alias("effective_date"), "announce_date", F.concat_ws(" ", "title", "territory_ids").alias("words"),
    )
    rows = a.unionByName(r).unionByName(m).distinct().withColumn("began", F.coalesce(parse_date(F.col("effective_date")), parse_date(F.col("announce_date"))))
    names, regions = _canonical(spark, d)
    at = match_names(rows, names, regions).select(F.col("text").alias("t"), F.col("beside").alias("b"), F.explode("codes").alias("place"))
    return rows.join(at, F.col("text").eqNullSafe(F.col("t")) & F.col("beside").eqNullSafe(F.col("b"))).select("source", "id", "kind", "place", "began", "words").distinct()


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records on one happening with their confidence."""
    return link_records(cut(happenings(spark, d)))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records on one happening."""
    return p7_matches(spark, d).select("id_a", "id_b").distinct()


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document's place in sequences of 2,048 tokens."""
    return pack_documents(table(spark, d, "documents"), "doc_id", "text", 2048)


def p8_packed_512(spark: SparkSession, d: str) -> DataFrame:
    """Every document's place in sequences of 512 tokens."""
    return pack_documents(table(spark, d, "documents"), "doc_id", "text", 512)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that leak passages of test items."""
    leaks = find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")
    return leaks.select("doc_id", "item_id").distinct()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The grade of every document."""
    graded = reading_levels(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "doc_grades"), "grade")
    return graded.select("doc_id", "grade").distinct()


QUERIES = {
    "p5_found": p5_found,
    "p5_unmatched": p5_unmatched,
    "p7_found": p7_found,
    "p7_matches": p7_matches,
    "p8_packed": p8_packed,
    "p8_packed_512": p8_packed_512,
    "p9_found": p9_found,
    "p10_found": p10_found,
}
