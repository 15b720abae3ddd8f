"""Headlines as columns: words, stems, places, kinds of events, items of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Endings cut off a word, longest first.
ENDINGS = ("ского", "ская", "ском", "ской", "ские", "ский", "ами", "ями", "ого", "ему", "ому", "ах", "ов", "ев", "ей", "ой", "ий", "ый", "ая", "яя", "ом", "ам", "а", "я", "о", "е", "и", "ы", "у", "ю", "ь")


def tokens(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, pos, word, capital): words of letters in order, lower case."""
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(\p{L}+)"), F.lit(1))
    t = docs.select(doc_id, F.posexplode(words).alias("pos", "w"))
    return t.select(doc_id, "pos", F.lower("w").alias("word"), (F.substring("w", 1, 1) != F.lower(F.substring("w", 1, 1))).alias("capital"))


def stem(word: Column) -> Column:
    """The word without its longest ending that leaves three letters."""
    return F.regexp_replace(word, r"(?<=.{3})(?:" + "|".join(ENDINGS) + ")$", "")


def region_key(name: Column) -> Column:
    """A region's name without its kind, lower case."""
    t = F.lower(F.regexp_replace(name, r"[\s ]+", " "))
    return F.trim(F.regexp_replace(t, r"\b(?:республика|область|край|обл\.?|респ\.?|кр\.?)(?=\s|$)", ""))


def classify(docs: DataFrame, doc_id: str, text: str, kinds: dict[str, list[str]], derived: dict[str, tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """(doc_id, kind): every kind one of whose stems begins a word of the text.  ``derived``
    kinds follow from any of some kinds, or from all of some stems together."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    shows = lambda stems: t.rlike(r"(?<!\p{L})(?:" + "|".join(stems) + ")")
    tests = [F.when(shows(stems), F.lit(k)) for k, stems in kinds.items()]
    for k, (froms, together) in (derived or {}).items():
        every = F.lit(bool(together))
        for s in together:
            every = every & shows([s])
        tests.append(F.when(shows([s for f in froms for s in kinds[f]]) | every, F.lit(k)))
    return docs.select(doc_id, F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("kind"))


def monthly_kinds(docs: DataFrame, text: str, stamp: str, kinds: dict[str, list[str]]) -> DataFrame:
    """(month, kind, n) with kind 'all' for all documents of the month; one pass."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = F.array_compact(F.array(F.lit("all"), *[F.when(t.rlike(r"(?<!\p{L})(?:" + "|".join(stems) + ")"), F.lit(k)) for k, stems in kinds.items()]))
    each = docs.where(F.col(stamp).isNotNull()).select(F.date_format(stamp, "yyyy-MM").alias("month"), F.explode(found).alias("kind"))
    return each.groupBy("month", "kind").agg(F.count("*").alias("n"))


def located(docs: DataFrame, doc_id: str, text: str, gazetteer: DataFrame, adjacent: list[str]) -> DataFrame:
    """(doc_id, code): places whose stem a capitalised word shows.  A stem of several places
    counts only where another place of its region is named in the text; an adjective only
    before one of the ``adjacent`` words.  ``gazetteer``: (stem, code, region, adjective).
    Each word looks at the next inside its document's own array, so words never move to
    meet their neighbours; capitalised words meet the places in a join."""
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(\p{L}+)"), F.lit(1))
    first = lambda w: F.substring(w, 1, 1)
    each = F.transform("_w", lambda w, i: F.struct(w.alias("w"), F.get("_w", i + 1).alias("next")))
    capital = F.filter(each, lambda x: first(x["w"]) != F.lower(first(x["w"])))
    t = docs.select(doc_id, words.alias("_w")).select(doc_id, F.explode(F.array_distinct(capital)).alias("x"))
    t = t.select(doc_id, stem(F.lower("x.w")).alias("stem"), stem(F.lower("x.next")).alias("next"))
    g = gazetteer.withColumn("options", F.count("code").over(Window.partitionBy("stem")))
    hit = t.join(g, "stem").where(~F.col("adjective") | F.col("next").isin(adjacent))
    sure = hit.where("options = 1").select(doc_id, "region").distinct()
    return hit.where("options = 1").select(doc_id, "code").union(hit.where("options > 1").join(sure, [doc_id, "region"]).select(doc_id, "code")).distinct()


def page_items(pages: DataFrame, page_id: str, html: str, pattern: str = r'<a\s[^>]*href="([^"]*)"[^>]*>') -> DataFrame:
    """(page_id, pos, item): what ``pattern`` captures on a page, in order, with tags cut out
    and entities undone."""
    found = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(pattern), F.lit(1))
    item = F.regexp_replace(F.col("item"), "<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        item = F.replace(item, F.lit(entity), F.lit(char))
    return pages.select(page_id, F.posexplode(found).alias("pos", "item")).withColumn("item", F.trim(item))


def first_seen(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; keys with many rows are reduced before they move."""
    first = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(
        F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_r")
    )
    return first.select("_r.*")
