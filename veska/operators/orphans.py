"""References to records that do not exist, or not on the day of the reference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veska.session import cut

_FAR = 9_999_999


def _listed(refs: pd.DataFrame, parents: pd.DataFrame) -> np.ndarray:
    """Whether each (k, d) lies in a span of a parent k: binary search in sorted arrays."""
    if parents.empty:
        return np.zeros(len(refs), bool)
    parents = parents.sort_values(["k", "f"], kind="stable")
    keys, first = np.unique(parents["k"].to_numpy(), return_index=True)
    until = parents.groupby("k", sort=False)["u"].cummax().to_numpy()  # latest end among the earlier starts
    rank = np.repeat(np.arange(len(keys)), np.diff(np.append(first, len(parents))))
    span = np.int64(1) << 26
    order = rank * span + (parents["f"].to_numpy() + _FAR)
    k, d = refs["k"].to_numpy(), refs["d"].to_numpy()
    r = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
    known = keys[r] == k
    at = np.searchsorted(order, r * span + (d + _FAR), side="right") - 1
    found = known & (at >= 0)
    at = np.maximum(at, 0)
    return found & (rank[at] == r) & (until[at] > d)


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Misses of one key range, whose parents come first."""
    held, parents = [], None
    for df in batches:
        held.append(df.loc[df["u"].notna(), ["k", "f", "u"]])
        refs = df[df["u"].isna()]
        if len(refs):
            if parents is None or len(held[-1]):
                parents = pd.concat(held).astype({"u": "int64"})
            refs = refs.rename(columns={"f": "d"})
            yield refs.loc[~_listed(refs, parents), ["k", "d"]]


def orphan_references(
    references: DataFrame,
    key: str,
    day: str,
    parents: DataFrame,
    parent_key: str,
    parent_from: str,
    parent_until: str,
) -> DataFrame:
    """Rows of ``references`` whose ``key`` no parent holds on ``day``, all columns kept.

    A parent is listed from ``parent_from`` (null: ever) up to the day before
    ``parent_until`` (null: still listed); several rows of one parent add up.  Rows
    with a null key or day refer to nothing and give no row.  Repeated references
    stay repeated.  Without parents every reference is an orphan.

    Parents and distinct (key, day) pairs are cut together into key ranges of about equal
    numbers of rows, so keys far outside the parents' spread over ranges of their own, and
    a key that many rows share is probed once per day.  Each range holds its parents as
    sorted arrays and probes its references batch by batch with binary search; the misses
    select the rows.
    """
    number = lambda c: F.datediff(c, F.lit("1970-01-01"))
    p = parents.select(
        F.col(parent_key).cast("bigint").alias("k"),
        F.coalesce(number(F.col(parent_from)), F.lit(-_FAR)).alias("f"),
        F.coalesce(number(F.col(parent_until)), F.lit(_FAR)).alias("u"),
    ).where("k is not null").groupBy("k", "f").agg(F.max("u").alias("u"))
    r = (
        references.select(F.col(key).cast("bigint").alias("k"), number(F.col(day)).alias("f"))
        .where("k is not null and f is not null").distinct()
        .withColumn("u", F.lit(None).cast("int"))
    )
    both = cut(p.unionByName(r))  # the ranges' bounds are sampled before the rows move
    ranged = both.repartitionByRange("k").sortWithinPartitions(F.col("u").isNull(), "k")
    misses = ranged.mapInPandas(_probe, "k bigint, d int").select(F.col("k").alias("_miss_k"), F.col("d").alias("_miss_d"))
    on = (F.col(key).cast("bigint") == F.col("_miss_k")) & (number(F.col(day)) == F.col("_miss_d"))
    return references.join(misses, on, "left_semi")


def orphan_report(orphans: DataFrame, table: str, key: str, period: str) -> DataFrame:
    """Orphan references counted per table and period: (table, period, orphans, keys)."""
    return orphans.groupBy(table, period).agg(
        F.count("*").alias("orphans"), F.countDistinct(key).alias("keys")
    )
