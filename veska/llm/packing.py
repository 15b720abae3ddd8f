"""Documents packed whole into sequences of fixed capacity, measured in tokens."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veska.session import cut

#: A vocabulary of ranks and the pattern of its first split (a fixed value of that vocabulary).
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items of one packing task.
BLOCK = 50_000
#: Share of a round's items above which those of bins with room are not packed again.
WORTH = 0.95

_S = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNK = re.compile(f" ?[^{_S}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


class Counter(dict):
    """Tokens of each chunk of text.  A chunk is a blank with what follows up to the next
    one; the tokenizer's own first split never joins chunks, so a text's tokens are the
    sum over its chunks, and a chunk met before is not tokenized again."""

    MOST = 500_000

    def __init__(self, vocabulary: str, pattern: str = PATTERN):
        import tiktoken

        super().__init__()
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, chunk: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[chunk] = n = len(self.encode(chunk))
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, _CHUNK.findall(text)))


def token_counts(documents: DataFrame, doc_id: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of every row; null and empty texts have 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            n = [counter.count(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=[doc_id, "tokens"])

    rows = documents.select(documents[doc_id].cast("bigint").alias(doc_id), documents[text].cast("string").alias("text"))
    return rows.mapInArrow(run, f"{doc_id} bigint, tokens bigint")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item: each goes where the sum over residual gaps of the squared number
    of open bins becomes smallest (ties: the fullest bin), and into a new bin only where
    no open bin has room.  Sizes are 1 to ``capacity``; larger items come first, items of
    one size in the given order."""
    out = np.empty(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    never = np.iinfo(np.int64).max
    bins = 0
    for k in np.argsort(-sizes, kind="stable"):
        s = int(sizes[k])
        # An item moves a bin from gap g to g - s: the sum changes by 2 (N[g - s] - N[g] + 1),
        # or by 1 - 2 N[s] where the bin becomes full.
        change = 2 * (count[: capacity - s + 1] - count[s:] + 1)
        change[0] = 1 - 2 * count[s]
        change[count[s:] == 0] = never
        left = int(change.argmin())
        if change[left] == never:
            b, left = bins, capacity - s
            bins += 1
        else:
            b = open_bins[s + left].pop()
            count[s + left] -= 1
        if left:
            open_bins[left].append(b)
            count[left] += 1
        out[k] = b
    return out


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bins by :func:`sum_of_squares`; the items of bins left open are packed once more."""
    bins = sum_of_squares(sizes, capacity)
    load = np.bincount(bins, weights=sizes)
    again = np.flatnonzero(load[bins] < capacity)
    if len(again):
        other = sum_of_squares(sizes[again], capacity)
        if other.max() + 1 < len(np.unique(bins[again])):
            bins[again] = len(load) + other
    return np.unique(bins, return_inverse=True)[1]


def _two(run):
    """A function of exactly (key, frame), which applyInPandas asks for."""
    return lambda key, df: run(key, df)


def pack_documents(documents: DataFrame, doc_id: str, text: str, capacity: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every document's place: (doc_id, piece, token_from, tokens, bin).

    Texts of up to ``capacity`` tokens stay whole; a longer one is cut into pieces of
    ``capacity`` tokens and a rest.  ``bin`` is unique over all blocks and null for texts
    without a token (null or empty), which take no room.  Repeated rows are packed each.
    An empty table gives no row.

    Texts are measured where they are read and never move.  Pieces are packed in blocks
    of about BLOCK items chosen by hash, which leave a few open bins each; the items of
    all bins with room for the smallest of them are packed together in further rounds, so the
    room lost does not add up with the number of blocks; rounds end with one block, or where
    more than WORTH of the items would move again, as then bins seldom fill at all.
    """
    counts = cut(token_counts(documents, doc_id, text, vocabulary))
    cap = F.lit(capacity)
    pieces = counts.where("tokens > 0").select(
        F.col(doc_id).alias("_id"),
        F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("tokens") - 1, cap.cast("bigint"))).alias("_piece", "_from"),
        "tokens",
    ).select("_id", "_piece", "_from", F.least(F.col("tokens") - F.col("_from"), cap).cast("bigint").alias("_n"))
    schema = "_id bigint, _piece int, _from bigint, _n bigint, _bin bigint, _gap bigint"

    def packed(stage: int, key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["_id", "_piece"], kind="stable").reset_index(drop=True)
        sizes = df["_n"].to_numpy()
        bins = pack(sizes, capacity)
        load = np.bincount(bins, weights=sizes)
        df["_bin"] = (np.int64(stage) << 56) + (np.int64(key[0]) << 20) + bins
        df["_gap"] = (capacity - load[bins]).astype(np.int64)
        return df[["_id", "_piece", "_from", "_n", "_bin", "_gap"]]

    done, rest, stage, (n, least) = [], pieces, 0, pieces.agg(F.count("*"), F.min("_n")).first()
    while True:
        blocks = max(1, -(-n // BLOCK))
        block = F.pmod(F.xxhash64("_id", "_piece", F.lit(stage)), F.lit(blocks))
        run = partial(packed, stage)
        got = rest.withColumn("_block", block).groupBy("_block").applyInPandas(_two(run), schema)
        if blocks == 1:
            done.append(got)
            break
        got = cut(got)
        # A bin with less room than the smallest item can take none: it is done.
        left = got.where(F.col("_gap") >= least)
        again, smallest = left.agg(F.count("*"), F.min("_n")).first()
        if again > WORTH * n:  # another round would move nearly all to close few bins
            done.append(got)
            break
        done.append(got.where(F.col("_gap") < least))
        rest, n, least, stage = left.drop("_bin", "_gap"), again, smallest, stage + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.select(F.col("_id").alias(doc_id), F.col("_piece").alias("piece"), F.col("_from").alias("token_from"), F.col("_n").alias("tokens"), F.col("_bin").alias("bin"))
    empty = counts.where("tokens = 0").select(doc_id, F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("token_from"), "tokens", F.lit(None).cast("bigint").alias("bin"))
    return out.unionByName(empty)
