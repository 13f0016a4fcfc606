"""Live reports: logging, de-duplication and coverage as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def log_stream(stream: DataFrame, path: str, checkpoint: str, sender: str | None = None) -> StreamingQuery:
    """Append each message at once as a JSON row with its UTC receive time, in whole seconds."""
    rows = stream.withColumn("received", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")).withColumn("sender", F.col(sender) if sender else F.lit(None).cast("string"))
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_stream(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """First report of each key; a repeat within ``delay`` of it is dropped and state older than that goes."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def _counted(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """New points of a process with its total after each; the state is the total, which goes with the watermark."""
    if state.hasTimedOut:
        state.remove()
        return
    total = state.get[0] if state.exists else 0
    for rows in batches:
        rows = rows.sort_values("__time", kind="stable")
        yield rows.drop(columns=["__time", "__wait"]).assign(total=range(total + 1, total + 1 + len(rows)))
        total += len(rows)
        last, wait = int(rows["__time"].iloc[-1].timestamp() * 1000), int(rows["__wait"].iloc[0])
        state.update((total,))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + wait)


def coverage_stream(stream: DataFrame, process: str, point: list[str], time: str, delay: str) -> DataFrame:
    """Each (process, point) when it is new, with the process's running ``total``; for append output.

    A pair is new if it did not come within ``delay`` before. State of pairs
    and totals that are older than that goes, so it does not grow for ever:
    choose a delay longer than a process runs. New pairs of one batch may count
    in any order.
    """
    new = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([process, *point])
    begin = "timestamp '1970-01-02 00:00:00'"
    wait = F.expr(f"unix_millis({begin} + interval {delay}) - unix_millis({begin})").alias("__wait")
    kinds = dict(stream.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in [process, *point]), "total long"])
    rows = new.select(process, *point, F.col(time).alias("__time"), wait)
    return rows.groupBy(process).applyInPandasWithState(_counted, schema, "total long", "append", GroupStateTimeout.EventTimeTimeout)
