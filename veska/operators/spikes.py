"""Implausible readings of a source, judged against that source's normal behaviour."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from veska.session import cut

#: Width of a bin of log values is 1 / BINS; a bin without a logarithm is OUT.
BINS = 50
OUT = -1_000_000
#: Readings on either side that tell the level around a reading.
NEAR = 4
#: Successive readings at one value that count as stuck.
STUCK = 5
#: Least noise of a series (log), and the noise of series too short to tell.
FLOOR, DEFAULT = 0.02, 0.07
#: Least deviation (log) of a spike.
LEAST = 0.5
#: Readings beyond the kind's 99.9 % quantile times this are impossible.
BEYOND = 10.0
#: States: normal, spike, stuck, out of range; where every source's chain starts from.
START = np.array([0.985, 0.008, 0.005, 0.002])
MOVE = np.array([[0.985, 0.008, 0.005, 0.002], [0.79, 0.20, 0.005, 0.005], [0.10, 0.005, 0.89, 0.005], [0.78, 0.01, 0.01, 0.20]])
#: Moves out of each state that MOVE counts as when a source's own moves are learned.
WEIGHT = 20.0
#: Most cells that are filtered at once.
CELLS = 400_000
#: The period of readings without one.
NEVER = -(2**31)
#: Most kinds x periods (some 50 bytes each) that are sent to every task; more meet the cells in a shuffle.
SMALL = 200_000


def _gauss(x: np.ndarray, s: np.ndarray | float) -> np.ndarray:
    return np.exp(-0.5 * (x / s) ** 2) / (s * math.sqrt(2 * math.pi))


def log_normal_state(dev: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Log density of a deviation in the normal state: a Gaussian with a wider companion."""
    return np.log(0.995 * _gauss(dev, 1.1 * s) + 0.005 * _gauss(dev, 2.0 * s) + 1e-12)


def log_spike_state(dev: np.ndarray) -> np.ndarray:
    """Log density of a deviation in the spike state: a factor of about 1.5 to 5 either
    way, or any larger one."""
    a = np.abs(dev)
    return np.log(np.where(a < LEAST, 0.0, 0.45 * _gauss(a - 1.0, 0.35) + 0.02) + 1e-12)


def forward_backward(emit: np.ndarray, length: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of left-aligned sequences of log emissions (series, time, state) under each series'
    own moves (series, from, to): state posteriors, what the neighbours alone say of each
    state, and the expected moves."""
    b, t, k = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    come, bwd = np.empty_like(e), np.ones_like(e)  # before and after a reading
    step = lambda x, m: np.einsum("bi,bij->bj", x, m)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    moves = np.zeros((b, k, k))
    if t == 0:
        return e, e, moves
    come[:, 0] = START
    for i in range(1, t):
        come[:, i] = step(norm(come[:, i - 1] * e[:, i - 1]), move)
    back = move.transpose(0, 2, 1)
    for i in range(t - 2, -1, -1):
        bwd[:, i] = np.where((i + 1 < length)[:, None], norm(step(e[:, i + 1] * bwd[:, i + 1], back)), 1.0)
    here = norm(come * e)
    for i in range(t - 1):
        pair = here[:, i, :, None] * move * (e[:, i + 1] * bwd[:, i + 1])[:, None, :]
        moves += np.where((i + 1 < length)[:, None, None], pair / pair.sum(axis=(1, 2), keepdims=True), 0.0)
    return norm(come * e * bwd), norm(come * bwd), moves


def fit_moves(emit: np.ndarray, length: np.ndarray, tolerance: float = 0.01, most: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State posteriors, what the neighbours say, and moves of each series, its moves learned
    by expectation-maximisation drawn to MOVE.  A series is done when no probability of its
    moves changes by more than ``tolerance``, at the latest after ``most`` rounds, whatever
    other series need, so its result does not hang on those beside it."""
    move = np.repeat(MOVE[None], len(emit), axis=0)
    post, context = np.zeros_like(emit), np.zeros_like(emit)
    left = np.arange(len(emit))
    for _ in range(most):
        if not len(left):
            break
        post[left], context[left], moves = forward_backward(emit[left], length[left], move[left])
        new = WEIGHT * MOVE + moves
        new /= new.sum(axis=2, keepdims=True)
        changed = np.abs(new - move[left]).max(axis=(1, 2)) > tolerance
        move[left] = new
        left = left[changed]
    return post, context, move


def deviations(level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Deviation of each reading of left-aligned series from the level around it, and the
    noise of each series.  The side nearer to the reading counts, so a lasting change of
    level is none; readings between differing sides deviate by nothing."""
    b, t = level.shape
    pad = np.full((b, NEAR), np.nan)
    wide = np.hstack([pad, level, pad])
    with np.errstate(all="ignore"):
        warnings.simplefilter("ignore")
        sides = []
        for offsets in (range(-NEAR, 0), range(1, NEAR + 1)):
            around = np.stack([wide[:, NEAR + o : NEAR + o + t] for o in offsets])
            middle = np.nanmedian(around, axis=0)
            sides.append(level - np.where((~np.isnan(around)).sum(axis=0) >= 2, middle, np.nan))
        left, right = sides
        both = np.where(np.sign(left) == np.sign(right), np.sign(left) * np.minimum(abs(left), abs(right)), 0.0)
        dev = np.where(np.isnan(left), right, np.where(np.isnan(right), left, both))
        steps = np.abs(np.diff(level, axis=1))
        n = (~np.isnan(steps)).sum(axis=1)
        noise = 1.4826 / math.sqrt(2) * np.nanmedian(steps, axis=1) if t > 1 else np.full(b, np.nan)
    noise = np.where(n >= 5, noise, np.fmax(noise, DEFAULT))
    return np.nan_to_num(dev), np.fmax(np.nan_to_num(noise, nan=DEFAULT), FLOOR)


def runs(series: np.ndarray, value: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Length of the run of successive positions each (series, value, pos) belongs to;
    the triples are sorted and distinct."""
    if not len(series):
        return np.zeros(0, int)
    new = np.ones(len(series), bool)
    new[1:] = (series[1:] != series[:-1]) | (value[1:] != value[:-1]) | (pos[1:] != pos[:-1] + 1)
    run = np.cumsum(new) - 1
    return np.bincount(run)[run]


def judge(sid: np.ndarray, t: np.ndarray, bins: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray, course: np.ndarray, series: int) -> pd.DataFrame:
    """Flags of the binned readings of ``series`` sources: (sid, t, bin, flag, value, pos).

    ``course`` is the kind's common course at each row.  ``value`` is the stuck value and
    ``pos`` the number of the period among the source's periods with readings; 'unsure'
    marks runs of bins of more than two readings which may hide a stuck value.
    """
    order = np.lexsort((bins, t, sid))
    sid, t, bins, n, lo, hi, course = (x[order] for x in (sid, t, bins, n, lo, hi, course))
    if not len(sid):
        return pd.DataFrame({"sid": [], "t": [], "bin": [], "flag": [], "value": [], "pos": []})
    # Periods with readings: left-aligned sequences.
    new = np.r_[True, (sid[1:] != sid[:-1]) | (t[1:] != t[:-1])]
    cell = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    owner = sid[first]
    length = np.bincount(owner, minlength=series)
    place = np.arange(len(first)) - (np.cumsum(length) - length)[owner]
    pos = place[cell]
    width = int(length.max())
    ok = bins != OUT
    # The weighted median of each period's readings.
    at, w, c = bins[ok] / BINS, n[ok].astype(float), cell[ok]
    middle, spread = np.full(len(first), np.nan), np.zeros(series)
    if len(c):
        begin = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        size = np.diff(np.r_[begin, len(c)])
        total = np.add.reduceat(w, begin)
        k = np.repeat(np.arange(len(begin)), size)
        upto = np.cumsum(w) - np.repeat(np.cumsum(total) - total, size)
        half = total[k] / 2
        low = np.minimum.reduceat(np.where(upto >= half - 1e-9, at, np.inf), begin)
        high = np.maximum.reduceat(np.where(upto - w <= half + 1e-9, at, -np.inf), begin)
        middle[c[begin]] = (low + high) / 2
        many = total[k] >= 8
        if many.any():  # the spread of readings within a period, where it has many
            s = pd.DataFrame({"s": sid[ok][many], "o": np.abs(at - middle[c])[many], "w": w[many]}).sort_values(["s", "o"], kind="stable")
            run = s.groupby("s")["w"].cumsum() / s.groupby("s")["w"].transform("sum")
            got = s[run >= 0.5].groupby("s")["o"].first()
            spread[got.index.to_numpy()] = 1.4826 * got.to_numpy() + 0.5 / BINS
    packed = np.full((series, width), np.nan)
    packed[owner, place] = middle - course[first]
    dev, noise = deviations(packed)
    # Equal values in successive readings: a bin of up to two readings holds lo and hi only.
    both = np.concatenate([np.stack([sid[ok].astype(float), v[ok], pos[ok].astype(float)]) for v in (lo, hi)], axis=1)
    e, of_cell = np.unique(both, axis=1, return_inverse=True)
    es, ev, ep = e[0].astype(int), e[1], e[2].astype(int)
    run = runs(es, ev, ep)
    repeats = (run[of_cell.reshape(2, -1)] >= 2).any(axis=0)
    # A period repeats its neighbour where most of its readings do; among many readings some do
    # by chance, which says nothing of the others.
    share = np.bincount(c, np.where(repeats, w, 0.0), minlength=len(first)) / np.maximum(np.bincount(c, w, minlength=len(first)), 1.0)
    equal = np.zeros((series, width), bool)
    equal[owner, place] = share >= 0.5
    post, context, move = fit_moves(emissions(dev, noise[:, None], equal, np.isnan(packed)), length)
    spiky, held = post[..., 1] > 0.5, post[..., 2] > 0.5
    # Each bin against the level of its period without the spike, given the periods around.
    expect = middle - np.where(spiky[owner, place], dev[owner, place], 0.0)
    off = bins[ok] / BINS - expect[c]
    os, op = sid[ok], pos[ok]
    odds = np.log(context[os, op] + 1e-300) + emissions(off, np.maximum(noise, spread)[os], repeats, np.zeros(len(off), bool))
    rows = np.flatnonzero(ok)[(odds.argmax(axis=1) == 1) & (odds[:, 1] > np.logaddexp.reduce(odds[:, [0, 2, 3]], axis=1))]
    flags = [pd.DataFrame({"sid": sid[rows], "t": t[rows], "bin": bins[rows], "flag": "spike", "value": np.nan, "pos": pos[rows]})]
    long = run >= STUCK
    alone = equal[es, ep]
    long &= held[es, ep] | ~alone
    hidden = np.flatnonzero(long & ~alone)  # values among many readings: their own positions go through the chain
    for k in np.split(hidden, np.flatnonzero((np.diff(es[hidden]) != 0) | (np.diff(ev[hidden]) != 0)) + 1):
        if len(k):
            same = (es == es[k[0]]) & (ev == ev[k[0]])
            long[k] = np.isin(ep[k], held_positions(ep[same]))
    periods = t[first]
    start = np.cumsum(length) - length
    flags.append(pd.DataFrame({"sid": es[long], "t": periods[start[es[long]] + ep[long]], "bin": np.floor(np.log(ev[long]) * BINS + 0.5).astype(int), "flag": "stuck", "value": ev[long], "pos": ep[long]}))
    u = np.lexsort((pos, bins, sid))
    u = u[ok[u]]
    if len(u):
        ur = runs(sid[u], bins[u], pos[u])
        hides = pd.Series((n[u] > 2) & (lo[u] < hi[u])).groupby([sid[u], bins[u]]).transform("any").to_numpy(dtype=bool)
        u = u[(ur >= STUCK) & hides]
    flags.append(pd.DataFrame({"sid": sid[u], "t": t[u], "bin": bins[u], "flag": "unsure", "value": np.nan, "pos": pos[u]}))
    return pd.concat([f for f in flags if len(f)] or flags[:1])


def emissions(dev: np.ndarray, noise: np.ndarray, equal: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """Log emissions of the four states: ``equal`` readings repeat their neighbour's value,
    ``empty`` ones have no value in range."""
    eq = np.where(equal, np.log(1e-4), 0.0)
    return np.stack([
        np.where(empty, -9.0, log_normal_state(dev, noise) + eq),
        np.where(empty, -9.0, log_spike_state(dev) + eq),
        np.where(empty, -9.0, log_normal_state(dev, np.maximum(noise, 0.1)) + np.where(equal, -0.01, np.log(1e-6))),
        np.where(empty, -0.01, -16.0),
    ], axis=-1)


def _judge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = batch.column(1)
        e = cells.flatten()
        t, bins, n, lo, hi, course, over = (e.field(k).to_numpy(zero_copy_only=False) for k in range(7))
        owner = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
        raw, bins = bins, np.where(over, OUT, bins).astype(np.int64)
        none = bins == OUT
        found = [pd.DataFrame({"sid": owner[none], "t": t[none], "bin": raw[none], "flag": "out_of_range", "value": np.nan, "pos": 0})]
        timed = t != NEVER
        owner, t, bins, n, lo, hi, course = (x[timed] for x in (owner, t.astype(np.int64), bins, n, lo, hi, course))
        sizes = np.bincount(owner, minlength=len(cells))
        ends = np.cumsum(sizes)
        order = np.argsort(sizes, kind="stable")  # sources of like length together, so padding stays small
        k = 0
        while k < len(order):
            m = max(1, int(np.searchsorted(np.arange(1, len(order) - k + 1) * np.maximum(sizes[order[k:]], 1), CELLS, "right")))
            some = np.sort(order[k : k + m])
            at = np.concatenate([np.arange(ends[i] - sizes[i], ends[i]) for i in some])
            f = judge(np.repeat(np.arange(len(some)), sizes[some]), *[x[at] for x in (t, bins, n, lo, hi, course)], len(some))
            found.append(f.assign(sid=some[f["sid"].to_numpy().astype(np.int64)]))
            k += m
        f = pd.concat([x for x in found if len(x)] or found[:1])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(f["sid"].to_numpy().astype(np.int64)))]
            + [pa.array(f[c].to_numpy(), d, from_pandas=True) for c, d in (("t", pa.int32()), ("bin", pa.int32()), ("flag", pa.string()), ("value", pa.float64()), ("pos", pa.int32()))],
            names=["_k", "_t", "_bin", "_flag", "_value", "_pos"],
        )


def held_positions(positions: np.ndarray) -> np.ndarray:
    """Of the sorted positions at which one value stands, those in a run of at least STUCK
    successive ones that the chain takes for stuck."""
    p = np.asarray(positions)
    lone = np.zeros(len(p))
    keep = p[runs(lone, lone, p) >= STUCK]
    if not len(keep):
        return keep
    at = np.arange(keep[0] - 2, keep[-1] + 3)
    equal = np.isin(at, p)
    emit = emissions(np.zeros(len(at)), np.full(len(at), DEFAULT), equal, np.zeros(len(at), bool))
    post = fit_moves(emit[None], np.array([len(at)]))[0][0]
    return keep[post[keep - at[0], 2] > 0.5]


def implausible_readings(readings: DataFrame, row_id: str, source: list[str], kind: str, bucket: Column, value: str) -> DataFrame:
    """Readings that are implausible for their own source: (row_id, flag), rows distinct.

    ``flag`` is 'out_of_range' (zero, negative, infinite, or more than BEYOND times the
    99.9 % quantile of the readings of its ``kind`` in its highest period), 'spike' or
    'stuck'.  ``bucket`` gives a reading's period, an INT, or null: such readings meet the
    hard bounds only.  Null and NaN values are no readings.  ``kind`` is one of the source
    columns; nulls in source columns form sources of their own.  An empty table gives no
    row, and columns beyond those named are never touched.

    A hidden Markov model per source (normal, spike, stuck, out of range), whose moves are
    learned from the source, gives each period's state probabilities by the forward-
    backward algorithm, and each reading's by its own emission and what the periods around
    it say.  The model sees each source through its binned log values, of which a period has
    a bounded number, so a source with any number of readings stays small; its flags then
    select readings by source, period and bin.  Bins that may hide a stuck value among many
    readings are settled on the positions of each value in them, by the same chain.
    """
    base = readings.select(
        F.col(row_id).alias("_id"),
        F.struct(*[F.col(s).alias(f"s{i}") for i, s in enumerate(source)]).alias("_k"),  # structs compare null with null
        F.coalesce(bucket.cast("int"), F.lit(NEVER)).alias("_t"),  # no filter, which would read the bucket twice
        F.col(value).cast("double").alias("_v"),
    ).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    of_kind = F.struct(F.col(f"_k.s{source.index(kind)}"))
    none = (F.col("_v") <= 0) | (F.col("_v") == math.inf)
    base = base.withColumn("_bin", F.when(none, OUT).otherwise(F.floor(F.log(F.when(~none, F.col("_v"))) * BINS + 0.5)).cast("int"))
    # One row per kind and period: the common course and the hard bound.
    one = F.xxhash64("_k")
    histogram = base.groupBy(of_kind.alias("_g"), "_t", "_bin").agg(F.count("*").alias("n"), F.min(one).alias("a"), F.max(one).alias("z"))
    histogram = cut(histogram).where((F.col("_t") != NEVER) & (F.col("_bin") != OUT))
    w = Window.partitionBy("_g", "_t")
    run = histogram.withColumns({"upto": F.sum("n").over(w.orderBy("_bin")), "all": F.sum("n").over(w)})
    quantile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("_bin")))
    norm = run.groupBy("_g", "_t").agg(quantile(0.5).alias("q"), quantile(0.999).alias("top"), F.min("a").alias("a"), F.max("z").alias("z"))
    by_kind = Window.partitionBy("_g")
    alone = F.min("a").over(by_kind) == F.max("z").over(by_kind)  # one source is no common course
    norm = cut(norm.select(
        F.col("_g").alias("g"), F.col("_t").alias("gt"), F.when(alone, 0.0).otherwise((F.col("q") - F.avg("q").over(by_kind)) / BINS).alias("course"),
        (F.max("top").over(by_kind) + math.ceil(math.log(BEYOND) * BINS)).alias("limit"),
    ))
    hard = norm.groupBy("g").agg(F.first("limit").alias("limit")).select("g", F.lit(NEVER).alias("gt"), F.lit(0.0).alias("course"), "limit")
    norm = norm.unionByName(hard)
    small = norm.count() <= SMALL
    cells = base.groupBy("_k", "_t", "_bin").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    series = (
        cells.join(F.broadcast(norm) if small else norm, (of_kind == F.col("g")) & (F.col("_t") == F.col("gt")), "left")
        .select("_k", F.struct("_t", "_bin", "n", "lo", "hi", F.coalesce("course", F.lit(0.0)).alias("course"), F.coalesce(F.col("_bin") > F.col("limit"), F.lit(False)).alias("over")).alias("cell"))
        .groupBy("_k").agg(F.collect_list("cell").alias("cells"))
    )
    flagged = [("_t", IntegerType()), ("_bin", IntegerType()), ("_flag", StringType()), ("_value", DoubleType()), ("_pos", IntegerType())]
    schema = StructType([base.schema["_k"], *[StructField(n, t) for n, t in flagged]])
    flags = series.mapInArrow(_judge_batches, schema).select(F.col("_k").alias("fk"), F.col("_t").alias("ft"), F.col("_bin").alias("fb"), "_flag", "_value", "_pos")
    hits = cut(
        base.join(flags, (F.col("_k") == F.col("fk")) & (F.col("_t") == F.col("ft")) & (F.col("_bin") == F.col("fb")))
        .where("_flag != 'stuck' or _v = _value").select("_id", "_k", "_v", "_flag", "_pos")
    )

    @F.pandas_udf("array<int>")
    def settled(positions: pd.Series) -> pd.Series:
        return positions.map(held_positions)

    unsure = hits.where("_flag = 'unsure'")
    held = (
        unsure.groupBy("_k", "_v").agg(F.array_sort(F.collect_set("_pos")).alias("p")).where(F.size("p") >= STUCK)
        .select(F.col("_k").alias("hk"), F.col("_v").alias("hv"), F.explode(settled("p")).alias("hp"))
    )
    hidden = unsure.join(held, (F.col("_k") == F.col("hk")) & (F.col("_v") == F.col("hv")) & (F.col("_pos") == F.col("hp")), "left_semi")
    found = hits.where("_flag != 'unsure'").select("_id", F.col("_flag").alias("flag")).unionByName(hidden.select("_id", F.lit("stuck").alias("flag")))
    return found.select(F.col("_id").alias(row_id), "flag").distinct()
