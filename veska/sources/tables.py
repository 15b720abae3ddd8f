"""Sources and sinks with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONSUMPTION = "obs_id bigint, territory_id bigint, category string, date string, value double, loaded_at timestamp_ntz"
EVENTS = "event_id string, title string, type string, region string, territory_ids string, event_month string, announce_date string, expected_sign string, source string"
ROADS = "territory_id_x bigint, territory_id_y bigint, distance double, type string"
OUTSIDE = "date string, food double, nonfood double, catering double, services double"
DECREES = "date string, territory_ids array<bigint>"


def parquet(spark: SparkSession, path: str, schema: str | None = None, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """A Parquet scan; filter and columns reach the file reader."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV scan with header; a cell that does not fit its type is null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def event_csv(spark: SparkSession, path: str) -> DataFrame:
    """An event catalogue: ids split at ';' into ARRAY<BIGINT>, the announcement as DATE."""
    ids = F.filter(F.transform(F.split("territory_ids", ";"), lambda x: F.try_to_number(F.trim(x), F.lit("9999999999999999999")).cast("bigint")), lambda x: x.isNotNull())
    return csv(spark, path, EVENTS).withColumns({"ids": ids, "announced": F.try_to_date("announce_date", "yyyy-MM-dd")})


def outside_series(spark: SparkSession, path: str, first_year: int = 2018) -> DataFrame:
    """(series, t, x): the columns of a wide monthly file and their total, as logs, long."""
    w = csv(spark, path, OUTSIDE).withColumn("total", F.col("food") + F.col("nonfood") + F.col("catering") + F.col("services"))
    t = (F.substring("date", 1, 4).cast("int") - first_year) * 12 + F.substring("date", 6, 2).cast("int") - 1
    long = w.withColumn("t", t).unpivot("t", ["food", "nonfood", "catering", "services", "total"], "series", "v")
    return long.where("v > 0").select("series", "t", F.log("v").alias("x"))


def decrees(spark: SparkSession, path: str) -> DataFrame:
    """(entity, date): a JSON list of decrees with nested ids, one row per id."""
    d = spark.read.schema(DECREES).option("multiLine", True).json(path)
    return d.select(F.explode("territory_ids").alias("entity"), F.try_to_date("date", "yyyy-MM-dd").alias("date"))


def json_days(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All JSON files of a folder of daily downloads."""
    return spark.read.schema(schema).json(folder)


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.mode("overwrite").option("header", True).csv(path, compression="gzip" if gzip else None)


def write_store(forecasts: DataFrame, path: str) -> None:
    """Forecasts by model: reading one model reads its folder only."""
    forecasts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path)


def read_store(spark: SparkSession, path: str, models: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("model").isin(models)) if models else df


def missing_work(work: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Work whose key is not done yet, to resume from."""
    return work.join(done.select(*key).distinct(), key, "left_anti")


def clean_json(df: DataFrame, digits: int = 4) -> DataFrame:
    """(json): each row as JSON, numbers rounded, NaN and infinities as null."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.dataType.simpleString() in ("double", "float"):
            c = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.round(c.cast("double"), digits))
        cols.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def write_frozen(forecasts: DataFrame, folder: str, about: dict) -> dict:
    """Rows (entity, category, h, f), f to one decimal, as gzip CSV files in order of their
    keys under ``forecast``, and ``manifest`` beside them: what ``about`` says, the rows and
    the SHA-256 of each category.  Files hold ranges of the order, so no task holds all."""
    import json

    from veska.operators.forecast import freeze
    from veska.session import cut

    spark = forecasts.sparkSession
    rows = cut(forecasts.where("f is not null").withColumn("f", F.round("f", 1)))
    write_csv(rows.repartitionByRange("category", "entity", "h").sortWithinPartitions("category", "entity", "h"), f"{folder}/forecast", gzip=True)
    digest = freeze(rows).collect()  # one row per category
    manifest = {**about, "rows": sum(r["rows"] for r in digest), "sha256": {r["category"]: r["sha"] for r in digest}}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return manifest


def markdown(rows: DataFrame, order: str | None = None, descending: bool = False, most: int = 1000) -> str:
    """A report as a Markdown table, ordered by a column if asked; a table of more than
    ``most`` rows is no report and raises."""
    if order:
        rows = rows.orderBy(F.desc(order) if descending else F.asc(order))
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows are no report")
    show = lambda x: "" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x)
    head = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(head + ["| " + " | ".join(show(x) for x in r) + " |" for r in got])
