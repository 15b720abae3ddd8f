"""Streams of readings: counts by window with late data, and a detector's state per source.
An extension: batch results are the same."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 64) -> DataFrame:
    """Parquet files as they arrive under a path or glob."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed(stream: DataFrame, stamp: str, by: list[str], value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window start, by, n, total) of readings not later than ``late``."""
    s = stream.withColumn("_ts", F.col(stamp).cast("timestamp")).withWatermark("_ts", late)
    return s.groupBy(F.window("_ts", width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def cusum_stream(stream: DataFrame, source: str, order: str, value: str, slack: float = 0.5) -> DataFrame:
    """(source, at, s): Page's two-sided sum after each batch of a source's standardised
    readings; the state is two numbers per source."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        up, down = state.get if state.exists else (0.0, 0.0)
        df = pd.concat(list(batches)).sort_values("at", kind="stable")
        x, here = df["x"].to_numpy(float), df["x"].notna().to_numpy()

        def held(start: float, steps: np.ndarray) -> np.ndarray:
            """The sum kept at zero or above: the free sum less its lowest point below zero."""
            free = start + np.cumsum(np.where(here, steps, 0.0))
            return free - np.minimum(np.minimum.accumulate(free), 0.0)

        ups, downs = held(up, x - slack), held(down, -x - slack)
        if len(df):
            state.update((float(ups[-1]), float(downs[-1])))
        yield pd.DataFrame({"source": [key[0]] * len(df), "at": df["at"].to_numpy(), "s": np.maximum(ups, downs)})

    rows = stream.select(F.col(source).alias("source"), F.col(order).cast("double").alias("at"), F.col(value).cast("double").alias("x"))
    kind = rows.schema["source"].dataType.simpleString()
    return rows.groupBy("source").applyInPandasWithState(step, f"source {kind}, at double, s double", "up double, down double", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and read its result."""
    out = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    out.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/out")
