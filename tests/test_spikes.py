import random

import numpy as np
from pyspark.sql import functions as F

from veska.operators.spikes import MOVE, fit_moves, forward_backward, held_positions, implausible_readings, runs

SCHEMA = "id int, src int, kind string, t int, v double, n string"


def series(seed=0, sources=60, months=24):
    rnd = random.Random(seed)
    rows, bad, i = [], {}, 0
    for s in range(sources):
        level, noise = rnd.uniform(500, 5000), rnd.uniform(0.02, 0.08)
        shift_at, shift = rnd.randint(6, 18), rnd.choice([1.0, 1.0, 1.4])
        vals = [level * (shift if t >= shift_at else 1) * np.exp(rnd.gauss(0, noise)) for t in range(months)]
        kind = s % 6
        marks = {}
        if kind == 1:
            t = rnd.randint(2, 20)
            vals[t] *= rnd.choice([3.0, 0.3])
            marks[t] = "spike"
        if kind == 2:
            t = rnd.randint(2, 18)
            vals[t] *= 2.8
            vals[t + 1] *= 2.8
            marks[t] = marks[t + 1] = "spike"
        if kind == 3:
            t = rnd.randint(0, 18)
            for k in range(t, t + 5):
                vals[k] = vals[t]
                marks[k] = "stuck"
        if kind == 4:
            vals[5], vals[9] = 0.0, -3.0
            marks[5] = marks[9] = "out_of_range"
        for t, v in enumerate(vals):
            rows.append((i, s, "k", t, float(v), "x"))
            if t in marks:
                bad[i] = marks[t]
            i += 1
    # A source with many readings a month, a spike among them and one value in five months.
    for t in range(months):
        for k in range(40):
            rows.append((i, 1000, "k", t, float(1000 * np.exp(random.Random(i).gauss(0, 0.03))), "x"))
            i += 1
        if t == 7:
            rows.append((i, 1000, "k", t, 4000.0, "x"))
            bad[i] = "spike"
            i += 1
        if 10 <= t < 15:
            rows.append((i, 1000, "k", t, 1002.5, "x"))
            bad[i] = "stuck"
            i += 1
    return rows, bad


def test_flags(spark):
    rows, bad = series()
    n = len(rows)
    rows += [(n, 1, "k", None, -5.0, "x"), (n + 1, 1, "k", 3, None, "x"), (n + 2, 1, "k", 3, float("nan"), "x"), (n + 3, None, "k", 3, 900.0, "x"), (n + 4, 1, "k", 2, float("inf"), "x"), (n + 5, 2, None, 2, 800.0, "x")]
    bad |= {n: "out_of_range", n + 4: "out_of_range"}
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r.flag for r in implausible_readings(df, "id", ["src", "kind"], "kind", F.col("t"), "v").collect()}
    assert set(bad) - set(got) == set()
    assert len(set(got) - set(bad)) <= 2
    assert sum(got[i] == f for i, f in bad.items()) >= 0.95 * len(bad)


def test_repeats_count_and_empty(spark):
    rows, bad = series(1, sources=12)
    df = spark.createDataFrame(rows, SCHEMA)
    twice = df.unionByName(df.withColumn("id", F.col("id") + 100_000))
    got = {r.id for r in implausible_readings(twice, "id", ["src", "kind"], "kind", F.col("t"), "v").collect()}
    assert {i for i in bad} <= got and {i + 100_000 for i in bad} <= got
    assert implausible_readings(df.limit(0), "id", ["src", "kind"], "kind", F.col("t"), "v").count() == 0


def test_helpers():
    assert runs(np.array([0, 0, 0, 1]), np.array([1.0, 1.0, 1.0, 1.0]), np.array([0, 1, 3, 4])).tolist() == [2, 2, 1, 1]
    assert held_positions(np.array([2, 3, 4, 5, 6, 9, 10])).tolist() == [2, 3, 4, 5, 6]
    assert held_positions(np.array([2, 3, 4, 5])).tolist() == []
    move = np.repeat(MOVE[None], 2, axis=0)
    post, context, moves = forward_backward(np.log(np.full((2, 3, 4), 0.25)), np.array([3, 2]), move)
    assert np.allclose(post.sum(axis=2), 1) and (post[:, :, 0] > 0.9).all() and np.allclose(moves.sum(axis=(1, 2)), [2, 1])


def test_forward_backward_against_all_paths():
    rnd = np.random.default_rng(1)
    emit, move = rnd.normal(size=(1, 4, 4)), rnd.dirichlet(np.ones(4), size=(1, 4))
    from itertools import product

    from veska.operators.spikes import START

    post, context, moves = forward_backward(emit, np.array([4]), move)
    weight = {p: START[p[0]] * np.prod([move[0, a, b] for a, b in zip(p, p[1:])]) * np.exp(sum(emit[0, t, x] for t, x in enumerate(p))) for p in product(range(4), repeat=4)}
    total = sum(weight.values())
    for t in range(4):
        for k in range(4):
            assert abs(post[0, t, k] - sum(w for p, w in weight.items() if p[t] == k) / total) < 1e-9
    assert abs(moves[0, 1, 2] - sum(w * sum(p[t] == 1 and p[t + 1] == 2 for t in range(3)) for p, w in weight.items()) / total) < 1e-9
    alone = context[0] * np.exp(emit[0])
    assert np.allclose(alone / alone.sum(axis=1, keepdims=True), post[0])


def test_the_chain_decides():
    """One reading that says as much for a spike as against it is none after normal ones and
    one after a spike; and a source that spikes often learns so."""
    sure, split, normal = [-9.0, 0.0, -9.0, -9.0], [-3.0, -0.1, -9.0, -9.0], [0.0, -9.0, -9.0, -9.0]
    post, _, _ = fit_moves(np.array([[normal, normal, split, normal], [normal, sure, split, normal]]), np.array([4, 4]))
    assert post[0, 2, 1] < 0.5 < post[1, 2, 1]
    _, _, move = fit_moves(np.array([[normal, sure] * 20, [normal, normal] * 20]), np.array([40, 40]))
    assert move[0, 0, 1] > 0.3 and move[1, 0, 1] < 0.01


def test_long_series(spark):
    """An hourly source of 3,000 periods far from zero and one of a handful."""
    rnd = np.random.default_rng(5)
    v = 100 * np.exp(rnd.normal(0, 0.03, 3000))
    v[1234] *= 4
    v[2000:2007] = v[2000]
    rows = [(i, 1, "k", 400_000 + i, float(x), "x") for i, x in enumerate(v)]
    rows += [(5000 + i, 2, "k", 401_000 + i, 100.0 + i, "x") for i in range(4)]
    got = {(r.id, r.flag) for r in implausible_readings(spark.createDataFrame(rows, SCHEMA), "id", ["src"], "src", F.col("t"), "v").collect()}
    assert got == {(1234, "spike"), *((i, "stuck") for i in range(2000, 2007))}


def test_chance_repeats_among_many_readings_hide_no_spike(spark):
    """A busy source of whole numbers, where some value comes again every month by chance."""
    rnd = np.random.default_rng(7)
    rows, bad = [], {}
    for t in range(24):
        for _ in range(150):
            rows.append((len(rows), 1, "k", t, float(round(1000 * np.exp(rnd.normal(0, 0.05)))), "x"))
        if t % 5 == 2:
            bad[len(rows)] = "spike"
            rows.append((len(rows), 1, "k", t, 3500.0 + t, "x"))
    for s in range(2, 12):
        rows += [(len(rows) + i, s, "k", t, float(round(1000 * np.exp(rnd.normal(0, 0.05)))), "x") for i, t in enumerate(range(24))]
    got = {r.id: r.flag for r in implausible_readings(spark.createDataFrame(rows, SCHEMA), "id", ["src", "kind"], "kind", F.col("t"), "v").collect()}
    assert {i: f for i, f in got.items() if f == "spike"} == bad
