"""The streaming jobs, and a way to run one over what there is now."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegauge.session import shared_folder

DELAY = "3 hours"


def rollup(samples: DataFrame, length: str = "1 hour", delay: str = DELAY) -> DataFrame:
    """Tallies of each listing and bucket, once, when the bucket ended ``delay`` ago.

    Columns are those of ``presence.rollup`` without the mean. A null ``game_id`` is a key like any other.
    """
    late = samples.withWatermark("sampled_at", delay)
    return late.groupBy("game_id", F.window("sampled_at", length).alias("w")).agg(
        F.count("cnt").alias("counted_samples"), F.count_if(F.col("cnt").isNull()).alias("unmeasurable_samples"),
        F.min("cnt").alias("min_count"), F.max("cnt").alias("max_count"), F.sum("cnt").alias("sum_count"),
    ).withColumn("bucket", F.col("w.start").cast("timestamp_ntz")).drop("w")


def deduplicated(rows: DataFrame, keys: list[str], at: str, delay: str = DELAY) -> DataFrame:
    """The first row of each key to arrive; a repeat within the delay goes."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


RUN = "key long, value string, from_us long, to_us long, next_value string"
_STATE = "value string, from_us long, taken_us long, times array<long>, ties array<long>, values array<string>"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Hold rows until the watermark has passed them, then take them in order of time and tie."""
    value, start, taken, times, ties, values = state.get if state.exists else (None, None, None, [], [], [])
    held = list(zip(times, ties, values))
    for rows in batches:
        held += zip(rows["at_us"].tolist(), rows["tie"].tolist(), rows["value"].tolist())
    held = sorted((r for r in held if taken is None or r[0] >= taken), key=lambda r: r[:2])
    mark = state.getCurrentWatermarkMs()
    ready = [r for r in held if r[0] // 1000 < mark]
    rest = held[len(ready) :]
    out = []
    for at, _, new in ready:
        if new != value:
            if start is not None:
                out.append((key[0], value, start, at, new))
            value, start = new, at
        taken = at
    state.update((value, start, taken, [r[0] for r in rest], [r[1] for r in rest], [r[2] for r in rest]))
    if rest:
        state.setTimeoutTimestamp(max(rest[0][0] // 1000, mark + 1))
    if out:
        yield pd.DataFrame(out, columns=["key", "value", "from_us", "to_us", "next_value"])


def closed_runs(rows: DataFrame, key: str, at: str, tie: str, value: str, delay: str = DELAY) -> DataFrame:
    """``(key, value, from_us, to_us, next_value)`` for each run of one value, once another value has ended it.

    Times are microseconds since 1970. A row from before the last one taken of its key comes too late and goes. Rows with a null key, time, tie or value take no part.
    """
    marked = rows.dropna(subset=[key, at, tie, value]).withWatermark(at, delay)
    named = marked.select(F.col(key).cast("long").alias("key"), F.unix_micros(at).alias("at_us"), F.col(tie).cast("long").alias("tie"), F.col(value).alias("value"), at)
    return named.groupBy("key").applyInPandasWithState(_advance, RUN, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def changes(runs: DataFrame) -> DataFrame:
    """Closed runs as a feed of changes."""
    return runs.select("key", F.col("value").alias("old_value"), F.col("next_value").alias("new_value"), F.col("to_us").alias("changed_us"))


def finished(stream: DataFrame, name: str) -> DataFrame:
    """What the job gives for all that its sources hold now, written as Parquet to the shared folder and read again."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    writer.start(f"{folder}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
