"""A backlog as a stateful stream (X1, X2, X4): queues that fill up, drain and outlive a stop.

Every account has a queue in Spark's state store. An arriving item joins its
account's queue; a queue is drained as one batch when it is full, or by an
event-time timer when nothing has come for ``wait``. What is queued when the
stream stops is in the checkpoint, and the next run goes on from there.

Queues are kept by key, so accounts are spread over the tasks, and a queue never
holds more than ``size`` items. What has arrived since the last run is one
micro-batch, taken in order of time, then id, so the files' order does not
matter; an item that arrives over ``DELAY`` behind the newest item of earlier
runs is too late and dropped by the watermark. Batches do not depend on where
runs begin and end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SIZE = 5
DELAY = "1 hour"
BATCH = "account long, batch long, n long, first_id long, last_id long, full boolean"
#: Of a queue: number of its next batch, waiting ids, time of the last item in milliseconds.
STATE = "batch long, ids array<long>, last long"


def queued(items: DataFrame, size: int = SIZE, wait_seconds: int = 86_400) -> DataFrame:
    """Drained batches of a stream of (account, id, ts): account, batch (0, 1, ...), n, first_id, last_id, full.

    ``items`` has a watermark on ts. Rows without an account only move the watermark; rows without a time are left out.
    """
    wait = wait_seconds * 1000

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            for _ in parts:
                pass
            return
        batch, ids, last = state.get if state.exists else (0, [], 0)
        ids = list(ids)
        out = []

        def drain() -> None:
            nonlocal batch, ids
            out.append((key[0], batch, len(ids), ids[0], ids[-1], len(ids) == size))
            batch, ids = batch + 1, []

        if state.hasTimedOut:
            if ids:
                drain()
        else:
            # one call for each account with news, so arrays rather than frames
            arrived = [(p["at"].to_numpy(), p["id"].to_numpy()) for p in parts]
            times, items_ = (np.concatenate(x) for x in zip(*arrived, strict=True))
            order = np.lexsort((items_, times))
            for at, item in zip(times[order].tolist(), items_[order].tolist(), strict=True):
                if ids and at - last > wait:
                    drain()
                ids.append(item)
                last = at
                if len(ids) == size:
                    drain()
        state.update((batch, ids, last))
        if ids:
            state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs()) + 1)
        if out:
            yield pd.DataFrame(dict(zip(["account", "batch", "n", "first_id", "last_id", "full"], zip(*out, strict=True), strict=True)))

    timed = items.where("ts IS NOT NULL").withColumn("at", F.unix_millis("ts"))
    return timed.select("account", "id", "at", "ts").groupBy("account").applyInPandasWithState(step, BATCH, STATE, "append", GroupStateTimeout.EventTimeTimeout)


class Backlog:
    """A folder of arriving items, the queues' checkpoint and the table of drained batches, under one path."""

    def __init__(self, spark: SparkSession, path: str, size: int = SIZE, wait_seconds: int = 86_400):
        self.spark, self.path, self.size, self.wait_seconds = spark, path, size, wait_seconds

    def arrive(self, items: DataFrame) -> None:
        """Add items (account, id, ts) to the backlog."""
        items.where("account IS NOT NULL AND ts IS NOT NULL").select("account", "id", "ts").write.mode("append").parquet(f"{self.path}/items")

    def close(self) -> None:
        """Let all timers run out at the next run, by a row of no account that is long after all items."""
        last = self.spark.read.parquet(f"{self.path}/items").agg(F.max("ts").alias("ts")).where("ts IS NOT NULL")
        late = F.timestamp_seconds(F.unix_seconds("ts") + 2 * self.wait_seconds + 86_400)
        last.select(F.lit(None).cast("long").alias("account"), F.lit(None).cast("long").alias("id"), late.alias("ts")).write.mode("append").parquet(f"{self.path}/items")

    def run(self) -> None:
        """Take all that has arrived since the last run, then stop."""
        items = self.spark.readStream.schema("account long, id long, ts timestamp").parquet(f"{self.path}/items").withWatermark("ts", DELAY)
        sink = queued(items, self.size, self.wait_seconds).writeStream.format("parquet").outputMode("append")
        sink.option("checkpointLocation", f"{self.path}/checkpoint").option("path", f"{self.path}/batches").trigger(availableNow=True).start().awaitTermination()

    def batches(self) -> DataFrame:
        return self.spark.read.schema(BATCH).parquet(f"{self.path}/batches")
