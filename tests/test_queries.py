"""Queries against their SQL on the smallest tables, and forecasts blind to the future."""

import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from veska.operators import decompose as dc
from veska.operators import forecast as fo
from veska.operators.panel import packed
from veska.plans import event_queries, panel_queries, study_queries

NAMES = [
    "panel_build", "panel_completeness", "panel_user_gaps", "gap_interpolation", "metrics_grouping_sets", "two_way_effects", "seasonal_factors", "choose_external",
    "lag_features", "neighbours_topk", "confirmed_shifts", "borda", "copeland", "region_impute_nearest", "catalogue_merge", "boost_grid", "tokenise", "classify_types",
    "monthly_type_counts", "dedupe_keep_first", "csv_round_trip", "forecast_store", "json_field_scan", "stream_daily_counts",
    "frozen_forecast", "stems", "clean_json_rows", "stream_cusum", "locate_places", *study_queries.ORACLE,
]


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = [("" if x is None or x != x else f"{x:.4f}" if isinstance(x, float) else str(x)) for x in df[c].astype(object)]
    return sorted(map(tuple, df.to_numpy().tolist()))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, small, name):
    module = next(m for m in (panel_queries, event_queries, study_queries) if name in m.QUERIES)
    got = module.QUERIES[name](spark, small).toPandas()
    want = duck.sql(module.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    ints = [c for c in want.columns if want[c].dtype.kind in "iu" or got[c].dtype.kind in "iu"]
    for c in ints:
        got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert plain(got) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def panel(spark, spoil=None):
    rng, other = np.random.default_rng(0), np.random.default_rng(1)
    rows = []
    for i in range(12):
        level = rng.uniform(100, 1000)
        for t in range(24):
            v = float(level * np.exp(rng.normal(0, 0.05)))
            if spoil and spoil(t):
                v = float(other.uniform(1, 1e6)) if spoil(t) == "noise" else v * 1.5
            rows.append((i, "AN"[i % 2], t, v))
    return spark.createDataFrame(rows, "entity int, category string, t int, v double")


def course_forecast(spark, p, o):
    c = dc.course(p, o, o)
    return c.groupBy("category", "o").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("t", "n"))), lambda x: x["n"]).alias("n"),
    ).withColumn("nf", F.array_repeat(F.element_at("n", -1), 6))


MODELS = {
    "naive": lambda s, p, o: fo.naive(packed(p, 24), o, o, 6),
    "seasonal_naive": lambda s, p, o: fo.seasonal_naive(packed(p, 24), o, o, 6),
    "panel_seasonal": lambda s, p, o: fo.panel_seasonal(packed(p.withColumn("v", F.log("v")), 24), course_forecast(s, p, o), o, o, 6),
}


def ssm(s, p, o):
    from veska.operators.local_model import panel_ssm

    return panel_ssm(packed(p.withColumn("v", F.log("v")), 24), course_forecast(s, p, o), o, o, 6)


MODELS["panel_ssm"] = ssm


@pytest.mark.parametrize("name", list(MODELS))
def test_forecasts_do_not_see_the_future(spark, name):
    o = 15
    run = lambda spoil: {(r.entity, r.h): r.f for r in MODELS[name](spark, panel(spark, spoil), o).collect()}
    base = run(None)
    future = run(lambda t: "noise" if t > o else None)
    past = run(lambda t: "noise" if 4 <= t <= o else None)
    assert set(base) == set(future)
    for k, v in base.items():
        assert abs(future[k] - v) <= 1e-9 * abs(v)
    assert any(abs(past[k] - v) > 1 for k, v in base.items())


def test_series_not_begun_has_no_forecast(spark):
    p = panel(spark).where("entity != 3 or t > 15").unionByName(spark.createDataFrame([(99, "A", 20, 5.0)], "entity int, category string, t int, v double"))
    for f in (fo.naive, fo.seasonal_naive):
        got = {r.entity: r.f for r in f(packed(p, 24), 15, 15, 1).collect()}
        assert got[3] is None and got[99] is None and got[0] is not None


def test_missing_library_is_an_error(spark):
    from veska.operators import providers

    assert providers
    with pytest.raises(Exception, match="not installed"):
        fo.MODELS["prophet"](packed(panel(spark), 24), 15, 15, 2).collect()


def boosted(spark, p, first, last):
    from veska.operators.local_model import boosted as model, boosted_features

    path = course_forecast(spark, p, first)
    for o in range(first + 1, last + 1):
        path = path.unionByName(course_forecast(spark, p, o))
    access = p.select("entity").distinct().withColumn("ma", F.col("entity") * 1.0)
    near = p.select(F.col("entity").alias("a")).distinct().withColumn("b", (F.col("a") + 2) % 12)
    features = boosted_features(packed(p.withColumn("v", F.log("v")), 24), path, access, near, first, last)
    return features, model(features, 6, 7, trees=20)


def test_boosted_forecasts_every_origin_blind_to_the_future(spark):
    def run(spoil):
        features, out = boosted(spark, panel(spark, spoil), 14, 16)
        assert {"nb_dz1", "nb_dz3", "ma", "level"} <= set(features.columns)
        return {(r.o, r.entity, r.h): r.f for r in out.collect()}

    base = run(None)
    assert set(base) == {(o, i, h) for o in (14, 15, 16) for i in range(12) for h in range(1, 7)}
    future = run(lambda t: "noise" if t > 14 else None)
    assert all(abs(future[k] - v) <= 1e-9 * abs(v) for k, v in base.items() if k[0] == 14)
    assert any(abs(future[k] - v) > 1 for k, v in base.items() if k[0] == 16)


def test_gbm_features_are_of_the_own_part(spark):
    features, _ = boosted(spark, panel(spark), 15, 15)
    got = features.groupBy("category", "t").agg(F.avg("z0").alias("m")).collect()
    assert len(got) == 2 * 13 and max(abs(r.m) for r in got) < 1e-9  # deviations from the course average out
    one = {(r.entity, r.t): r for r in features.where("t = 15").collect()}
    assert abs(one[0, 15].nb_dz1 - one[2, 15].dz1) < 1e-12
