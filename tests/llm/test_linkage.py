import datetime as dt
import random

from veska.llm.linkage import link_records

SCHEMA = "source string, id string, kind string, place bigint, began date, words string, p int"
NAMES = {"a": ["burn", "wet", "jobs", "cold"], "b": ["fire", "flood", "work", "snow"], "c": ["блаза", "вода", "завод", "снег"]}


def registry(seed=0, happenings=220, others=150):
    rnd = random.Random(seed)
    rows, truth = [], set()
    n = 0
    for k in range(happenings):
        kind, place = rnd.randrange(4), rnd.choice([0] * 3 + list(range(1, 40)))
        began = dt.date(2015, 1, 1) + dt.timedelta(rnd.randint(0, 4000))
        ids = []
        for s in "abc":
            if rnd.random() < 0.75:
                n += 1
                ids.append(f"{s.upper()}{n}")
                number = f" {1000 + k}" if rnd.random() < 0.5 else ""
                rows.append((s, ids[-1], NAMES[s][kind], place, began + dt.timedelta(rnd.randint(-3, 3)), "x" + number, 1))
        truth |= {(x, y) for i, x in enumerate(ids) for y in ids[i + 1 :]}
    for i in range(others):  # records of other things
        s = rnd.choice("abc")
        rows.append((s, f"{s.upper()}X{i}", rnd.choice(NAMES[s]), rnd.randrange(40), dt.date(2015, 1, 1) + dt.timedelta(rnd.randint(0, 4000)), None, 1))
    return rows, truth


def test_pairs(spark):
    rows, truth = registry()
    rows += rows[:40] + [("a", "N1", "burn", None, dt.date(2016, 1, 1), "x", 1), ("b", "N2", "fire", 1, None, "x", 1), ("a", "N3", None, 1, dt.date(2016, 1, 1), None, 1)]
    got = link_records(spark.createDataFrame(rows, SCHEMA)).collect()
    pairs = {(r.id_a, r.id_b) for r in got}
    assert len(pairs) == len(got) and all(r.id_a < r.id_b and 0.5 < r.confidence <= 1 for r in got)
    assert len(pairs & truth) > 0.93 * len(truth) and len(pairs - truth) < 0.06 * len(pairs)
    partners = [(x, y[0]) for p in pairs for x, y in (p, p[::-1])]
    assert len(partners) == len(set(partners))  # at most one partner per other source


def test_nothing_to_match(spark):
    df = spark.createDataFrame([("a", "A1", "burn", 1, dt.date(2020, 1, 1), "x", 1)], SCHEMA)
    assert link_records(df).count() == 0 and link_records(df.limit(0)).count() == 0


def test_the_mixture_decides(spark, monkeypatch):
    """With one posterior for all pairs the result is another and worse."""
    from pyspark.sql import functions as F

    from veska.llm import linkage

    rows, truth = registry(3, others=1200)
    df = spark.createDataFrame(rows, SCHEMA)
    mixed = {(r.id_a, r.id_b) for r in link_records(df).collect()}
    monkeypatch.setattr(linkage, "scored", lambda pairs, model: F.lit(0.9))
    flat = {(r.id_a, r.id_b) for r in link_records(df).collect()}
    assert len(mixed ^ flat) > 30 and len(flat - truth) > 3 * len(mixed - truth)


def test_transitivity(spark):
    from pyspark.sql import functions as F

    from veska.llm.linkage import obey

    cases = [
        (0.3, [(0.9, 0.9)], 0.81),  # the third side is raised
        (0.05, [(0.9, 0.9)], 0.05),  # too unlikely: the others give way
        (0.9, [(0.95, 0.02)], 0.02 / 0.95),  # the weaker of two sides is lowered
        (0.95, [(0.9, 0.02)], 0.95),
        (0.9, [(0.95, 0.5)], 0.9),
        (0.7, [], 0.7),
        (0.6, None, 0.6),
        (0.5, [(0.9, 0.9), (0.9, 0.01)], 0.81),
    ]
    df = spark.createDataFrame([(i, p, [tuple(x) for x in s] if s is not None else None) for i, (p, s, _) in enumerate(cases)], "i int, p double, s array<struct<q:double,r:double>>")
    got = {r.i: r.x for r in df.select("i", obey(F.col("p"), F.col("s")).alias("x")).collect()}
    for i, (_, _, want) in enumerate(cases):
        assert abs(got[i] - want) < 1e-9, i
