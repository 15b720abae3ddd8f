"""Reading level of documents."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veska.llm.leakage import unify

#: The model is fitted on at most this many graded documents, chosen by hash of their id;
#: it keeps all their words.
SAMPLE = 5_000
#: Weight of a word that a grade's texts do not have.
SMOOTH = 0.1

_TAG = re.compile(r"</?[a-z][^<>]{0,200}>|&[a-z]{2,8};")
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-case words without digits and tags."""
    t = text.lower()
    if "<" in t or "&" in t:
        t = _TAG.sub(" ", t)
    if "\xad" in t:
        t = t.replace("\xad", "")
    return _WORD.findall(t)


class Codes(dict):
    """Row of the model for each word as written; the last row is that of unknown words."""

    MOST = 1_000_000

    def __init__(self, vocabulary: list[str]):
        super().__init__()
        self.rows = {w: i for i, w in enumerate(vocabulary)}

    def __missing__(self, word: str) -> int:
        row = self.rows.get(word)
        if row is None:
            row = self.rows.get(unify(word), len(self.rows))
        if len(self) >= self.MOST:
            self.clear()
        self[word] = row
        return row


def fit_levels(documents: DataFrame, doc_id: str, text: str, grades: DataFrame, grade: str) -> tuple[list[str], np.ndarray, np.ndarray, list[int]]:
    """(words, log probabilities per word and level, log priors, levels).

    Grades of one document share its words among their levels; null grades and exact
    repeats count for nothing.
    """
    g = grades.where(F.col(grade).isNotNull() & F.col(doc_id).isNotNull()).distinct()
    share = g.groupBy(F.col(doc_id).cast("bigint").alias("_id"), F.col(grade).cast("int").alias("_g")).agg(F.count("*").alias("_n"))
    share = share.withColumn("_w", F.col("_n") / F.sum("_n").over(Window.partitionBy("_id")))
    per_doc = share.groupBy("_id").agg(F.collect_list(F.struct("_g", "_w")).alias("_grades")).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    texts = documents.select(documents[doc_id].cast("bigint").alias("_id"), documents[text].cast("string").alias("_text")).where("_text is not null")
    labelled = texts.join(F.broadcast(per_doc), "_id")  # at most SAMPLE rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for t, gs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                held = Counter(words_of(t))
                for x in gs:
                    total[x["_g"], ""] += x["_w"]
                    for w, n in held.items():
                        total[x["_g"], w] += n * x["_w"]
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([float(total[k]) for k in keys], pa.float64())], names=["g", "word", "n"])

    counts = labelled.mapInArrow(count, "g int, word string, n double")
    per_word = counts.groupBy("word").agg(F.sum("n").alias("all"), F.collect_list(F.struct("g", "n")).alias("by"))
    rows = per_word.orderBy(F.col("word") != "", F.desc("all"), "word").collect()
    levels = sorted({b["g"] for r in rows for b in r["by"]})
    at = {g: i for i, g in enumerate(levels)}
    table = np.zeros((len(rows), len(levels)))
    for i, r in enumerate(rows):
        for b in r["by"]:
            table[i, at[b["g"]]] += b["n"]
    priors, table = (table[0], table[1:]) if rows else (np.zeros(0), table)
    log_p = np.log((table + SMOOTH) / (table.sum(axis=0) + SMOOTH * max(len(table), 1))) if len(levels) else table
    return [r["word"] for r in rows[1:]], log_p, np.log(priors / priors.sum()) if len(levels) else priors, levels


def reading_levels(documents: DataFrame, doc_id: str, text: str, grades: DataFrame, grade: str) -> DataFrame:
    """The level of every document whose text is not null or blank: (doc_id, grade, margin).

    Smoothed unigram language models, one per level, are fitted on graded documents (at
    most SAMPLE, all their words); a document takes the level of the highest
    posterior, ties the lower one.  ``margin`` is the log posterior's lead over the next
    level.  Words outside the vocabulary say nothing; a text without known words takes the
    likeliest level a priori.  Repeated rows are graded each.  Without any grade, and for
    an empty table, there is no row.  Whole texts are read once, where they lie.
    """
    vocabulary, log_p, priors, levels = fit_levels(documents, doc_id, text, grades, grade)
    schema = f"{doc_id} bigint, grade int, margin double"
    rows = documents.select(documents[doc_id].cast("bigint").alias(doc_id), documents[text].cast("string").alias("text"))
    if not levels:
        return rows.select(doc_id, F.lit(0).alias("grade"), F.lit(0.0).alias("margin")).limit(0)
    order = np.array(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(vocabulary)
        weights = np.vstack([log_p, np.zeros(len(levels))])
        for batch in batches:
            ids, scores = [], []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py()
                if t is None or not t.strip():
                    continue
                words = words_of(t)
                ids.append(key)
                scores.append(priors + weights[np.fromiter(map(codes.__getitem__, words), np.int64, len(words))].sum(axis=0))
            s = np.array(scores).reshape(-1, len(levels))
            top = np.sort(s, axis=1)
            margin = top[:, -1] - top[:, -2] if len(levels) > 1 else np.zeros(len(s))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(order[s.argmax(axis=1)] if len(s) else [], pa.int32()), pa.array(margin, pa.float64())], names=[doc_id, "grade", "margin"])

    return rows.mapInArrow(run, schema)
