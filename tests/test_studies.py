"""Studies, their helpers and the queries built on them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veska.operators import studies as st
from veska.operators.events import known_boosts, impute_region
from veska.operators.forecast import freeze
from veska.session import scratch
from veska.sources import tables as src


def test_exact_percentiles(spark):
    rng = np.random.default_rng(0)
    for values in (rng.normal(size=5000), np.repeat([1.0, 2.0, 5.0], [700, 5, 295]), np.array([3.0]), np.arange(7.0)):
        df = spark.createDataFrame([(float(v), "x") for v in values] + [(None, "y")], "v double, q string")
        shares = [0.0, 0.01, 0.5, 0.95, 0.99, 1.0]
        assert np.allclose(st.exact_percentiles(df, "v", shares), np.quantile(values, shares))
    assert st.exact_percentiles(df.limit(0), "v", [0.5, 0.9]) == [None, None]


def test_least_squares_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 3))
    y = 1.5 + x @ [2.0, -1.0, 0.5] + rng.normal(0, 0.1, 80)
    rows = [("ab"[i % 2], *map(float, x[i]), float(y[i])) for i in range(80)] + [("a", None, 0.0, 0.0, 1.0), ("c", 1.0, 1.0, 1.0, 1.0)]
    got = {r.g: r for r in st.least_squares(spark.createDataFrame(rows, "g string, x1 double, x2 double, x3 double, y double"), ["g"], "y", ["x1", "x2", "x3"]).collect()}
    for k, g in enumerate("ab"):
        assert np.allclose(got[g].b, np.linalg.lstsq(np.c_[np.ones(40), x[k::2]], y[k::2], rcond=None)[0]) and got[g].n == 40
    assert got["c"].b is None


def test_two_sided(spark):
    df = spark.createDataFrame([(2.228139, 10.0, 0.05), (-1.959964, None, 0.05), (0.0, 5.0, 1.0), (None, 3.0, None)], "x double, n double, p double")
    for r in df.select(st.two_sided("x", "n").alias("got"), "p").collect():
        assert r.got is None and r.p is None or abs(r.got - r.p) < 1e-6


def test_bootstrap_draws(spark):
    groups = spark.range(200).select(F.col("id").cast("string").alias("g"))
    rows = st.draws_of(groups, "g", 100).collect()
    m = np.array([r.m for r in rows])
    assert abs(m.sum() / 20_000 - 1) < 0.05 and m.min() >= 1  # Poisson(1): as many draws as units
    again = st.draws_of(groups.repartition(7), "g", 100)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_samples_have_the_exact_size(spark):
    df = spark.createDataFrame([(i, "ab"[i > 20], None) for i in range(40)], "id int, s string, _x string")
    got = st.sampled(df, "s", ["id"], 7)
    assert got.groupBy("s").count().collect() == [("a", 7), ("b", 7)] or {r["count"] for r in got.groupBy("s").count().collect()} == {7}
    assert st.sampled(df, "s", ["id"], 30).count() == 40 and st.sampled(df.limit(0), "s", ["id"], 3).count() == 0


def test_models_that_leave_most_series_out(spark):
    f = [("full", i, "A", 1.0) for i in range(10)] + [("half", i, "A", 1.0 if i < 5 else None) for i in range(10)] + [("few", i, "A", 1.0) for i in range(4)]
    df = spark.createDataFrame(f, "model string, entity int, category string, f double")
    panel = df.where("model = 'full'").select("entity", "category")
    assert {r.model for r in st.covered_models(df, panel).select("model").distinct().collect()} == {"full", "half"}


def test_events_are_known_only_once_announced(spark):
    e = spark.createDataFrame([(["x", "y"], 3, 4), (["x"], 6, 9)], "ids array<string>, t int, known int")
    got = {(r.o, r.entity): r.q for r in known_boosts(e, 3, 9, 25.0).collect()}
    assert (3, "x") not in got and got[4, "x"] == [1, 1, 1, 25, 25] and got[8, "x"][6] == 1 and got[9, "x"][6:] == [25, 25, 1, 1] and (9, "y") in got
    spoiled = e.unionByName(spark.createDataFrame([(["x"], 2, 99)], e.schema))
    assert {(r.o, r.entity): r.q for r in known_boosts(spoiled, 3, 9, 25.0).collect()} == got


def test_news_model_is_blind_to_later_events(spark):
    """Forecasts with news stay the same when events nobody knows of yet are added."""
    from veska.operators.local_model import panel_ssm

    rng = np.random.default_rng(3)
    logs = spark.createDataFrame([(f"e{i}", "A", (5 + np.cumsum(rng.normal(0, 0.1, 16))).tolist()) for i in range(6)], "entity string, category string, v array<double>")
    course = spark.createDataFrame([("A", o, [0.0] * (o + 1), [0.0] * 3) for o in (11, 12)], "category string, o int, n array<double>, nf array<double>")
    known = [(["e0", "e1"], 8, 9)]
    run = lambda events: {(r.o, r.entity, r.h): r.f for r in panel_ssm(logs, course, 11, 12, 3, known_boosts(spark.createDataFrame(events, "ids array<string>, t int, known int"), 11, 12, 25.0)).collect()}
    base = run(known)
    assert run([*known, (["e2"], 9, 13)]) == base
    assert run([*known, (["e2"], 9, 10)]) != base


def test_regions_in_ranges_equal_one_range(spark):
    rng = np.random.default_rng(2)
    ids = rng.choice(10**9, 300, replace=False)
    known = spark.createDataFrame([(int(i), f"r{i % 5}") for i in ids[:80]], "entity bigint, region string")
    entities = spark.createDataFrame([(int(i),) for i in ids], "entity bigint")
    one = sorted(map(tuple, impute_region(entities, known).collect()))
    assert sorted(map(tuple, impute_region(entities, known, per_range=9).collect())) == one and len(one) == 300


def test_frozen_files_and_manifest(spark):
    f = spark.createDataFrame([(f"e{i}", "AB"[i % 2], h, float(i * h) / 3) for i in range(50) for h in (1, 2)], "entity string, category string, h int, f double")
    with scratch(spark, "frozen") as path:
        manifest = src.write_frozen(f, path, {"origin": 7})
        back = src.csv(spark, f"{path}/forecast", "entity string, category string, h int, f double")
        assert manifest["rows"] == back.count() == 100 and manifest["origin"] == 7
        assert {r["category"]: r["sha"] for r in freeze(back).collect()} == manifest["sha256"]
        other = f.withColumn("f", F.col("f") + F.when(F.col("entity") == "e4", 0.1).otherwise(0.0))
        changed = {r["category"]: r["sha"] for r in freeze(other).collect()}
        assert changed["A"] != manifest["sha256"]["A"] and changed["B"] == manifest["sha256"]["B"]
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def test_markdown(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", None)], "m string, x double")
    assert src.markdown(df, "x", True).splitlines()[2] == "| b | 3 |"
    with pytest.raises(ValueError):
        src.markdown(df, most=2)


def test_over_seeds(spark):
    runs = [(s, a, r) for s in range(3) for a, r in ((0.05, 0.2 + 0.1 * s), (0.1, 0.5), (0.2, 0.7), (0.3, 0.9))]
    df = spark.createDataFrame([("g", s, a, r, 0.5) for s, a, r in runs], "grp string, seed int, alpha double, recall double, precision double")
    r = st.over_seeds(df, ["grp"], 0.05, 0.2).first()
    area = [(0.05 * x / 2 + 0.05 * (x + 0.5) / 2 + 0.1 * 0.6) / 0.2 for x in (0.2, 0.3, 0.4)]
    assert abs(r.recall - 0.3) < 1e-9 and abs(r.recall_ci - 4.302653 * 0.1 / math.sqrt(3)) < 1e-6 and abs(r.pauc - np.mean(area)) < 1e-9


def test_empty_inputs(spark):
    sh = spark.createDataFrame([], "entity string, category string, t int, sh double")
    hits = spark.createDataFrame([], "entity string, t int")
    assert st.response_interval(sh, hits).count() == 0
    news = spark.createDataFrame([], "entity string, t int, s double")
    groups = spark.createDataFrame([], "entity string, grp string")
    assert st.event_study_interval(sh, news, groups, 2.0, 0.3, [0], 5).count() == 0
