"""Queries over stateful streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import analogs as A
from tessera.storage import new_folder, written
from tessera.streaming.queues import Backlog

WAIT_SECONDS = 3 * 86_400


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as items; times are rounded to milliseconds, in which the queues order them."""
    ts = F.timestamp_millis(F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long"))
    return A.table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("account"), F.col("event_id").cast("long").alias("id"), ts.alias("ts"))


def drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a backlog that arrives in three parts, with a stop after each and a last run that lets the timers run out.

    The cuts are computed once: approximate percentiles depend on the order in which tasks' results are merged, and parts that are cut
    at different places lose events or repeat them.
    """
    events = items(spark, sf_dir)
    cuts = written(events.agg(F.expr("approx_percentile(ts, array(0.3, 0.7))").alias("at")).select(F.col("at")[0].alias("a"), F.col("at")[1].alias("b")), "cuts")
    part = F.when(F.col("ts") <= F.col("a"), 0).when(F.col("ts") <= F.col("b"), 1).otherwise(2)
    parted = events.join(F.broadcast(cuts)).withColumn("part", part)
    backlog = Backlog(spark, new_folder(spark, "backlog"), wait_seconds=WAIT_SECONDS)
    for k in range(3):
        backlog.arrive(parted.where(F.col("part") == k))
        backlog.run()
    backlog.close()
    backlog.run()
    return backlog.batches()


QUERIES = {
    "x1_x4_queues": (
        drained,
        f"""WITH e AS (SELECT user_id::bigint AS account, event_id::bigint AS id, ts FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
        g AS (SELECT *, CASE WHEN epoch_ms(ts::timestamp) - lag(epoch_ms(ts::timestamp)) OVER w > {WAIT_SECONDS * 1000} THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY account ORDER BY epoch_ms(ts::timestamp), id)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY account ORDER BY epoch_ms(ts::timestamp), id) AS spell FROM g),
        p AS (SELECT *, (row_number() OVER (PARTITION BY account, spell ORDER BY epoch_ms(ts::timestamp), id) - 1) // 5 AS k FROM s),
        b AS (SELECT account, spell, k, count(*) AS n, arg_min(id, (epoch_ms(ts::timestamp), id)) AS first_id, arg_max(id, (epoch_ms(ts::timestamp), id)) AS last_id FROM p GROUP BY account, spell, k)
        SELECT account, row_number() OVER (PARTITION BY account ORDER BY spell, k) - 1 AS batch, n, first_id, last_id, n = 5 AS "full" FROM b""",
    ),
}
