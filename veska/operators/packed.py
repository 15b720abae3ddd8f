"""Several values packed in one field, written with inconsistent delimiters and quoting."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veska.session import cut

# Marks that quote a span, brackets around lists, and marks between values.
QUOTES = {'"': '"', "'": "'", "«": "»", "“": "”", "„": "“"}
BRACKETS = "[](){}<>"
_DELIM = r"\s;,|/+ "
_EDGE = BRACKETS + "\"'«»“”„ \t\r\n "

#: Words that join the last values of a list and are no values themselves.
CONNECTORS = ("и", "and")
#: Weight of the unseen: a value the column never showed elsewhere.
NOVEL = 0.02
#: Weight of a delimiter that is taken as part of a value not yet learned.
JOIN = 1e-3


def spans_of(text: str) -> list[tuple[str, bool]]:
    """(span, quoted) in order: quoted spans are atomic, the rest is split further on."""
    out, i, start = [], 0, 0
    free = re.compile(rf"[{_DELIM}{re.escape(BRACKETS)}]")
    while i < len(text):
        close = QUOTES.get(text[i])
        if close and (i == 0 or free.match(text[i - 1])):
            j = text.find(close, i + 1)
            while j != -1 and j + 1 < len(text) and not free.match(text[j + 1]):
                j = text.find(close, j + 1)
            if j != -1:
                if text[start:i].strip():
                    out.append((text[start:i], False))
                if text[i + 1 : j].strip(_EDGE):
                    out.append((text[i + 1 : j].strip(_EDGE), True))
                i = start = j + 1
                continue
        i += 1
    if text[start:].strip():
        out.append((text[start:], False))
    return out


_ATOM = re.compile(rf"[^{_DELIM}]+")


def atoms_of(segment: str) -> list[tuple[int, int]]:
    """Offsets of the atoms of an unquoted segment, without brackets and stray quotes."""
    out = []
    for m in _ATOM.finditer(segment):
        a, b = m.span()
        while a < b and segment[a] in _EDGE:
            a += 1
        while b > a and segment[b - 1] in _EDGE:
            b -= 1
        if a < b and any(c.isalnum() for c in segment[a:b]):
            out.append((a, b))
    return out


def normal(text: str) -> str:
    return re.sub(r"[\s ]+", " ", text).strip().lower()


def atom_text(text: str) -> tuple[str, int]:
    """A value in the form in which values are compared, and its number of atoms."""
    seg = normal(text)
    at = atoms_of(seg)
    return (seg[at[0][0] : at[-1][1]], len(at)) if at else (seg, 0)


def _spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct texts to their spans: (text, n, part, span, quoted, seg, atoms, fields)."""
    for df in batches:
        rows = []
        for text, n in zip(df["text"], df["n"]):
            spans = spans_of(text)
            for part, (span, quoted) in enumerate(spans):
                rows.append((text, int(n), part, span, quoted, *atom_text(span), len(spans)))
        yield pd.DataFrame(rows, columns=["text", "n", "part", "span", "quoted", "seg", "atoms", "fields"])


def _named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        yield pd.DataFrame([atom_text(t) for t in df["text"]], columns=["val", "k"])


def _runs(batches: Iterator[pd.DataFrame], lengths: list[int]) -> Iterator[pd.DataFrame]:
    """Every run of a candidate's number of atoms of a segment: (seg, i, j, val)."""
    for df in batches:
        rows = []
        for seg in df["seg"]:
            at = atoms_of(seg)
            for k in lengths:
                rows += [(seg, i, i + k, seg[at[i][0] : at[i + k - 1][1]]) for i in range(len(at) - k + 1)]
        yield pd.DataFrame(rows, columns=["seg", "i", "j", "val"])


def _lattices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments to their lattices, the stretches of atoms that overlapping candidates
    cover: (seg, n, at, val, ends, names), and the atoms outside them, whose ``ends`` is null."""
    for df in batches:
        rows = []
        for seg, n, runs in zip(df["seg"], df["n"], df["runs"]):
            at = atoms_of(seg)
            found = sorted((r["i"], r["j"]) for r in (runs if runs is not None else ()))
            i = k = 0
            while i < len(at):
                if k == len(found) or found[k][0] > i:
                    rows.append((seg, int(n), i, seg[at[i][0] : at[i][1]], None))
                    i += 1
                    continue
                first, end = k, i + 1
                while k < len(found) and found[k][0] < end:
                    end = max(end, found[k][1])
                    k += 1
                edges = [[a - i, b - i] for a, b in found[first:k]] + [[x, x + 1] for x in range(end - i)]
                rows.append((seg, int(n), i, seg[at[i][0] : at[end - 1][1]], edges))
                i = end
        yield pd.DataFrame(rows, columns=["seg", "n", "at", "val", "edges"])


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of distinct lattices: (sub, n, i, j, val)."""
    for df in batches:
        rows = []
        for sub, n, edges in zip(df["sub"], df["n"], df["edges"]):
            at = atoms_of(sub)
            rows += [(sub, int(n), int(i), int(j), sub[at[i][0] : at[j - 1][1]]) for i, j in edges]
        yield pd.DataFrame(rows, columns=["sub", "n", "i", "j", "val"])


def lattice(edges: list[tuple[int, int, float]]) -> tuple[np.ndarray, list[int], float]:
    """Posterior weight of every edge of one lattice (forward-backward), the edges of the
    likeliest path (Viterbi; ties: fewer values, then the longer first value) and the log
    weight of all paths."""
    end = max(j for _, j, _ in edges)
    fwd, bwd, best = [-math.inf] * (end + 1), [-math.inf] * (end + 1), [(-math.inf, 0, 0)] * (end + 1)
    fwd[0] = bwd[end] = 0.0
    best[end] = (0.0, 0, 0)
    back: list[int] = [-1] * (end + 1)
    add = lambda a, b: b if a == -math.inf else a if b == -math.inf else max(a, b) + math.log1p(math.exp(-abs(a - b)))
    order = sorted(range(len(edges)), key=lambda e: edges[e][:2])
    for e in order:
        i, j, w = edges[e]
        fwd[j] = add(fwd[j], fwd[i] + w)
    for e in reversed(order):
        i, j, w = edges[e]
        bwd[i] = add(bwd[i], bwd[j] + w)
        option = (best[j][0] + w, best[j][1] - 1, j)
        if option > best[i]:
            best[i], back[i] = option, e
    post = np.array([math.exp(fwd[i] + w + bwd[j] - fwd[end]) for i, j, w in edges])
    path, i = [], 0
    while i < end:
        path.append(back[i])
        i = edges[back[i]][1]
    return post, path, fwd[end]


def _expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Expected counts of the values of each lattice: (val, k, c, apart), ``apart`` the log
    weight of the value's atoms taken one by one; the row without a value has the log
    likelihood in ``c``."""
    for df in batches:
        rows, total = [], 0.0
        for n, edges in zip(df["n"], df["edges"]):
            post, _, weight = lattice([(e["i"], e["j"], e["w"]) for e in edges])
            total += n * weight
            single = {e["i"]: e["w"] for e in edges if e["j"] == e["i"] + 1}
            rows += [(e["val"], e["j"] - e["i"], float(n * p), sum(single[x] for x in range(e["i"], e["j"]))) for e, p in zip(edges, post)]
        yield pd.DataFrame([*rows, (None, 0, total, 0.0)], columns=["val", "k", "c", "apart"])


def _best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        rows = []
        for sub, edges in zip(df["sub"], df["edges"]):
            triples = [(e["i"], e["j"], e["w"]) for e in edges]
            rows.append((sub, [triples[e][1] for e in lattice(triples)[1]]))
        yield pd.DataFrame(rows, columns=["sub", "ends"])


def _values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        rows = []
        for text, parts in zip(df["text"], df["parts"]):
            vals: list[str] = []
            for p in sorted(parts, key=lambda p: p["part"]):
                span = p["span"]
                if p["quoted"]:
                    vals.append(span)
                    continue
                at = atoms_of(span)
                joined = {x["at"]: x["ends"] for x in (p["paths"] if p["paths"] is not None else ())}
                i = 0
                while i < len(at):
                    start = i
                    for end in joined.get(start, [1]):
                        vals.append(span[at[i][0] : at[start + end - 1][1]].strip(_EDGE))
                        i = start + end
            rows.append((text, [v for v in vals if v and v.lower() not in CONNECTORS]))
        yield pd.DataFrame(rows, columns=["text", "vals"])


def _learn(edges: DataFrame, fixed: DataFrame, start: DataFrame, tolerance: float) -> tuple[DataFrame, float]:
    """Frequencies of the values by expectation-maximisation over the lattices: (val, c,
    k, named) and the sum of ``c``.  Ends when a round raises the log likelihood by no more
    than ``tolerance`` of it.

    A candidate neither named nor quoted anywhere is worth its place in the vocabulary only
    as long as what it saves exceeds what it costs to spell: the weight of its atoms, and
    JOIN for each delimiter inside.
    """
    counts, before, dropped = start, -math.inf, 0
    total = counts.agg(F.sum("c")).first()[0] or 1.0
    is_named = start.select(F.col("val").alias("v"), "named")
    known = fixed.select("val", "k", "c", F.lit(None).cast("double").alias("apart"), "named")
    while True:
        got = _weighed(edges, counts, total).mapInPandas(_expect, "val string, k int, c double, apart double")
        found = got.join(is_named, F.col("val") == F.col("v"), "left").drop("v").unionByName(known)
        merged = cut(found.groupBy("val").agg(F.sum("c").alias("c"), F.max("k").alias("k"), F.max("apart").alias("apart"), F.coalesce(F.max("named"), F.lit(False)).alias("named")))
        value = F.col("val").isNotNull()
        total, now, held = merged.agg(F.sum(F.when(value, F.col("c"))), F.sum(F.when(~value, F.col("c"))), F.count_if(value)).first()
        saved = F.col("c") * (F.log(F.col("c") / total) - F.col("apart")) + F.col("apart") + (F.col("k") - 1) * math.log(JOIN)
        counts = merged.where(value & (F.col("named") | (F.col("k") < 2) | ((F.col("c") > 0) & (saved > 0)))).select("val", "c", "k", "named")
        gone = held - counts.count()
        if abs(now - before) <= tolerance * abs(now) and gone == dropped:
            return counts, total
        before, dropped = now, gone


def _weighed(edges: DataFrame, counts: DataFrame, total: float) -> DataFrame:
    """Distinct lattices with the weights of their edges; a value of several atoms needs a
    frequency, one atom may be new."""
    p = counts.select("val", (F.col("c") / total).alias("p"))
    single = F.col("j") - F.col("i") == 1
    w = F.log((1 - NOVEL) * F.coalesce("p", F.lit(0.0)) + F.lit(NOVEL) * F.pow(F.lit(JOIN), F.col("j") - F.col("i")))
    return (
        edges.join(p, "val", "left").where(single | F.col("p").isNotNull()).withColumn("w", w)
        .groupBy("sub").agg(F.first("n").alias("n"), F.collect_list(F.struct("i", "j", "w", "val")).alias("edges"))
    )


def split_packed(rows: DataFrame, field: str, lexicon: DataFrame | None = None, tolerance: float = 1e-6) -> DataFrame:
    """``rows`` with one row per value packed in ``field``: plus ``pos`` (from 1) and ``val``.

    ``val`` is the value as written, without surrounding blanks, brackets and quotes.
    Quoted spans are atomic.  Elsewhere blanks and ``;,|/+`` may part values or belong to
    one: the frequencies of values are learned from the whole column by expectation-
    maximisation over the lattices of its segments until the likelihood stands, and each
    segment takes its likeliest (Viterbi) path.  A value of several atoms, however many, is
    a candidate where the column shows it quoted or alone in the field of several texts, or
    where ``lexicon`` (one STRING column, any case) names it.  Null, blank and
    punctuation-only fields give no row; repeated values and repeated rows stay repeated;
    other columns are kept, except that ``pos`` and ``val`` of the input are replaced.

    Only distinct texts are parsed.  Segments fall into lattices where candidates overlap;
    equal lattices are learned once with their count, so a value that most texts hold is one
    lattice, and atoms outside lattices are counted once before the first round.
    """
    keep = [c for c in rows.columns if c not in ("pos", "val", "_vals", "_text")]
    texts = rows.select(F.col(field).cast("string").alias("text")).where("text is not null").groupBy("text").agg(F.count("*").alias("n"))
    schema = "text string, n bigint, part int, span string, quoted boolean, seg string, atoms int, fields int"
    spans = cut(texts.mapInPandas(_spans, schema))
    # Candidates of several atoms: quoted, alone in its field, or in the lexicon.
    quoted = spans.where("quoted and atoms > 1").groupBy(F.col("seg").alias("val")).agg(F.lit(0.0).alias("c"), F.first("atoms").alias("k"))
    alone = (
        spans.where(~F.col("quoted") & (F.col("atoms") > 1) & (F.col("fields") == 1) & ~F.col("seg").rlike(r"[;|+]"))
        .groupBy(F.col("seg").alias("val")).agg(F.sum("n").cast("double").alias("c"), F.first("atoms").alias("k"), F.count("*").alias("texts"))
        .where("texts > 1").drop("texts")
    )
    shown = quoted.withColumn("named", F.lit(True)).unionByName(alone.withColumn("named", F.lit(False)))
    if lexicon is not None:
        names = lexicon.select(F.col(lexicon.columns[0]).cast("string").alias("text")).where("text is not null").distinct()
        listed = names.mapInPandas(_named, "val string, k int").distinct().where("k > 1")
        shown = shown.unionByName(listed.select("val", F.lit(1.0).alias("c"), "k", F.lit(True).alias("named")))
    several = cut(shown.groupBy("val").agg(F.sum("c").alias("c"), F.first("k").alias("k"), F.max("named").alias("named")))
    lengths = sorted(r["k"] for r in several.select("k").distinct().collect())  # one row per length
    segments = spans.where("not quoted and atoms > 0").groupBy("seg").agg(F.sum("n").alias("n"), F.first("atoms").alias("atoms"))
    found = segments.where("atoms > 1").mapInPandas(lambda it: _runs(it, lengths), "seg string, i int, j int, val string")
    runs = found.join(several.select("val"), "val", "left_semi").groupBy("seg").agg(F.collect_list(F.struct("i", "j")).alias("runs"))
    parts = cut(segments.join(runs, "seg", "left").mapInPandas(_lattices, "seg string, n bigint, at int, val string, edges array<array<int>>"))
    lattices = parts.where("edges is not null").groupBy(F.col("val").alias("sub")).agg(F.sum("n").alias("n"), F.first("edges").alias("edges"))
    edges = cut(lattices.mapInPandas(_edges, "sub string, n bigint, i int, j int, val string"))
    fixed = (
        spans.where("quoted and atoms > 0").select(F.col("seg").alias("val"), "n", F.col("atoms").alias("k"))
        .unionByName(parts.where("edges is null").select("val", "n", F.lit(1).alias("k")))
        .groupBy("val").agg(F.sum("n").cast("double").alias("c"), F.first("k").alias("k")).withColumn("named", F.col("k") > 1)
    )
    values = spans.withColumn("paths", F.lit(None).cast("array<struct<at:int,ends:array<int>>>"))
    if not edges.isEmpty():
        fixed = cut(fixed)
        start = cut(fixed.unionByName(several).groupBy("val").agg(F.sum("c").alias("c"), F.first("k").alias("k"), F.max("named").alias("named")))
        counts, total = _learn(edges, fixed, start, tolerance)
        best = _weighed(edges, counts, total).mapInPandas(_best, "sub string, ends array<int>")
        chosen = parts.where("edges is not null").join(best, F.col("val") == F.col("sub"))
        paths = chosen.groupBy("seg").agg(F.collect_list(F.struct("at", "ends")).alias("paths"))
        values = spans.join(paths, "seg", "left")
    split = (
        values.groupBy("text").agg(F.collect_list(F.struct("part", "span", "quoted", "paths")).alias("parts"))
        .mapInPandas(_values, "text string, vals array<string>")
        .select(F.col("text").alias("_text"), F.col("vals").alias("_vals"))
    )
    return (
        rows.select(*keep)
        .join(split, F.col(field).cast("string") == F.col("_text"))
        .select(*keep, F.posexplode("_vals").alias("pos", "val"))
        .withColumn("pos", (F.col("pos") + 1).cast("bigint"))
    )
