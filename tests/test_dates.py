from pyspark.sql import functions as F

from veska.functions.dates import month_index, month_name, parse_date

DAYS = {
    "2023-02-05": "2023-02-05", "2023/2/5": "2023-02-05", "05.02.2023": "2023-02-05", "5.2.2023": "2023-02-05", "2023-02-05 00:00:00": "2023-02-05",
    "2023-02-05T10:00:00": "2023-02-05", " 20230205 ": "2023-02-05", "2023-02-30": None, "31.04.2023": None, "2023-02": None, "уточняется": None, "": None, None: None, "99.99.9999": None,
}
MONTHS = {
    "2023-01": 0, "2024-12": 23, "202307": 6, "07/2023": 6, "07.2023": 6, "2023-7": 6, "08.07.2023": 6, "08.07.2023 10:15": 6, "июль 2023": 6, "ИЮЛ 2023": 6,
    "мая 2023": 4, "2023-07-22T10:00:00": 6, "2023-07-22 10:00": 6, " 2023-07": 6, "2022-12": None, "2025-01": None, "2023-13": None, "0000-00": None, "н/д": None, "": None, None: None, "20230722": 6,
}


def test_days(spark):
    got = spark.createDataFrame([(k, v) for k, v in DAYS.items()], "x string, want string").select("x", "want", parse_date(F.col("x")).cast("string").alias("got")).collect()
    assert [(r.x, r.got) for r in got] == [(r.x, r.want) for r in got]


def test_months(spark):
    got = spark.createDataFrame([(k, v) for k, v in MONTHS.items()], "x string, want int").select("x", "want", month_index(F.col("x")).alias("got")).collect()
    assert [(r.x, r.got) for r in got] == [(r.x, r.want) for r in got]


def test_month_names(spark):
    got = spark.range(24).select(month_name(F.col("id")).alias("m")).collect()
    assert got[0].m == "2023-01" and got[12].m == "2024-01" and got[23].m == "2024-12"
