import datetime as dt
import random
from collections import defaultdict

from pyspark.sql import functions as F

from veska.operators.intervals import interval_gaps, merge_intervals
from veska.operators.orphans import orphan_references, orphan_report
from veska.operators.regular_grid import regular_grid

DAY0 = dt.date(2020, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(n)


def test_grid(spark):
    rows = [("a", 0, 1.0, 1), ("a", 0, 2.0, 2), ("a", 3, 5.0, 1), ("a", 9, 6.0, 1), ("a", None, 7.0, 1), ("a", 4, float("nan"), 1), ("a", 5, None, 1), ("b", 2, 3.0, 1), (None, 1, 4.0, 1), (None, 3, 4.0, 1), ("c", 1, None, 1)]
    df = spark.createDataFrame(rows, "src string, t int, value double, at int").withColumn("n", F.lit("clash")).withColumn("bucket", F.lit(0))
    got = regular_grid(df, ["src"], F.col("t"), "value", "at", max_gap=2)
    a = {r.bucket: (r.n, r.value, r.filled, r.mark) for r in got.where("src = 'a'").collect()}
    assert sorted(a) == list(range(10))
    assert a[0] == (2, 2.0, 2.0, "read") and a[1] == (0, None, 2.0, "filled") and a[2][3] == "filled"
    assert a[5] == (0, None, 5.0, "filled") and a[6] == (0, None, None, "missing") and a[8][3] == "missing" and a[9][3] == "read"
    assert got.where("src is null").count() == 3 and got.where("src = 'b'").count() == 1 and got.where("src = 'c'").count() == 0
    assert regular_grid(df.limit(0), ["src"], F.col("t"), "value", "at").count() == 0


def spans(spark, seed=0, n=300):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        s = rnd.randint(0, 600)
        e = s + rnd.randint(-2, 12)
        rows.append((rnd.choice([1, 2, 3, 3, 3, 4, None]), day(s) if rnd.random() > 0.03 else None, None if rnd.random() < 0.003 else day(e), "x"))
    rows += rows[:20]
    return rows, spark.createDataFrame(rows, "entity int, a date, b date, gap_from string")


def covered(rows):
    out = defaultdict(set)
    for k, a, b, _ in rows:
        if k is not None and a is not None and (b is None or b >= a):
            last = 2000 if b is None else (b - DAY0).days
            out[k] |= set(range((a - DAY0).days, last + 1))
    return out


def test_gaps_and_periods_against_days(spark):
    for seed in range(3):
        rows, df = spans(spark, seed)
        days = covered(rows)
        gaps = defaultdict(set)
        for r in interval_gaps(df, "entity", "a", "b").collect():
            new = set(range((r.gap_from - DAY0).days, (r.gap_to - DAY0).days + 1))
            assert new and not new & gaps[r.entity]
            gaps[r.entity] |= new
        held = defaultdict(set)
        total = 0
        for r in merge_intervals(df, "entity", "a", "b").collect():
            last = 2000 if r.period_to.year == 9999 else (r.period_to - DAY0).days
            new = set(range((r.period_from - DAY0).days, last + 1))
            assert not {min(new) - 1, max(new) + 1} & held[r.entity]
            held[r.entity] |= new
            total += r.spans
        assert total == sum(1 for k, a, b, _ in rows if k is not None and a is not None and (b is None or b >= a))
        for k, d in days.items():
            assert held[k] == d
            assert gaps[k] == set(range(min(d), max(d) + 1)) - d


def test_no_intervals(spark):
    _, df = spans(spark)
    assert interval_gaps(df.limit(0), "entity", "a", "b").count() == 0 and merge_intervals(df.limit(0), "entity", "a", "b").count() == 0


def test_orphans_against_brute_force(spark):
    rnd = random.Random(3)
    parents = [(rnd.randint(0, 60), None if rnd.random() < 0.1 else day(rnd.randint(0, 300)), None if rnd.random() < 0.4 else day(rnd.randint(0, 600))) for _ in range(80)]
    parents += parents[:5] + [(None, day(0), None)]
    refs = [(i, rnd.choice([None, 5, 5, 5, *range(80)]), None if rnd.random() < 0.05 else day(rnd.randint(0, 700)), "clash") for i in range(800)]
    refs += refs[:30]
    p = spark.createDataFrame(parents, "key int, f date, u date")
    r = spark.createDataFrame(refs, "id int, key int, d date, k string")

    def listed(k, d):
        return any(q == k and (f is None or f <= d) and (u is None or d < u) for q, f, u in parents)

    want = sorted(i for i, k, d, _ in refs if k is not None and d is not None and not listed(k, d))
    got = orphan_references(r, "key", "d", p, "key", "f", "u")
    assert got.columns == r.columns and sorted(x.id for x in got.collect()) == want
    far = r.unionByName(spark.range(3000).select(F.lit(9).alias("id"), (F.col("id") + 10**6).cast("int").alias("key"), F.lit("2024-01-01").cast("date").alias("d"), F.lit("").alias("k")))
    got_far = orphan_references(far, "key", "d", p, "key", "f", "u")
    assert got_far.count() == len(want) + 3000
    assert orphan_references(r, "key", "d", p.limit(0), "key", "f", "u").count() == sum(1 for _, k, d, _ in refs if k is not None and d is not None)
    assert orphan_references(r.limit(0), "key", "d", p, "key", "f", "u").count() == 0
    report = orphan_report(got.withColumn("period", F.date_format("d", "yyyy-MM")), "k", "key", "period").collect()
    assert sum(x.orphans for x in report) == len(want)
