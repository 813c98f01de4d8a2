"""Mixing sources to target weights by weighted fair queueing.

Every source's documents stand in a shuffled queue, up to three times over.
A copy's virtual finish time is the words of its source up to and with it,
divided by the source's target. All copies are ranged by finish time over the
whole corpus and cut at the total budget, so each source gets its share.

Prefix sums are taken in two levels (within buckets of hash ranges and over
bucket totals), so no task holds a whole source and reruns agree.

Defined cases: null and empty texts have size 0 and take nothing; a null source
is a source of its own, last in order; repeated rows, and rows that share an id
or have none, are documents of their own, each with its own place in the queue;
an empty table gives an empty result; ``mix`` reads no other columns and
``taken`` passes them through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import WORD, fresh, table, text_column, written

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No document, and no source, is taken more often than this.
REPEATS = 3
#: Rows that a bucket of a prefix sum holds about.
BUCKET_ROWS = 20_000
SEED = "mix"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and the size of each text in words, with a shuffled queue place."""
    place = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return docs.select("doc_id", docs["source"].cast("string").alias("source"), F.regexp_count(text_column(docs), F.lit(WORD)).cast("long").alias("size"), place.alias("place"))


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``by_source`` (source, source_size) with each source's target; one row per source.

    Targets share the total by weight but stop at ``repeats`` times the source;
    the excess is shared anew until none is above. That is one level L with
    target = min(cap, L * weight): sources are ranged by cap / weight, and L
    is that of the first place where no later source is capped.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    kind = F.array(*[F.lit(float(w)) for w in weights])
    ranked = by_source.withColumn("weight", F.element_at(kind, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
    everything = Window.partitionBy()
    upward = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({
        "total": F.sum("source_size").over(everything).cast("double"), "all_weight": F.sum("weight").over(everything),
        "capped": F.coalesce(F.sum("cap").over(upward), F.lit(0.0)), "capped_weight": F.coalesce(F.sum("weight").over(upward), F.lit(0.0)),
    })
    level = (F.col("total") - F.col("capped")) / (F.col("all_weight") - F.col("capped_weight"))
    ranked = ranked.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    # of the levels that fit, that with the fewest capped sources is the highest
    ranked = ranked.withColumn("level", F.max("level").over(everything))
    return ranked.select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def running(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Add ``out``: the running sum of ``value`` by ``keys`` in the order of (bucket, order).

    Buckets are summed first, so each window holds one bucket; ``keys`` must not be null.
    """
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(totals, [*keys, bucket]).withColumn(out, F.col("_before") + F.sum(value).over(within)).drop("_before")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and copies of every document."""
    slim = written(sizes(docs), "sizes")
    n = slim.count()
    # the key of a source: null is told from every text
    slim = slim.withColumn("key", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source"))))
    by_source = slim.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    goal = targets(by_source, weights, repeats).withColumn("key", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))).drop("source")
    digits = 1
    while 16**digits * bucket_rows < n and digits < 7:
        digits += 1
    queued = running(slim.withColumn("bucket", F.substring("place", 1, digits)), ["key"], "bucket", [F.col("place"), F.col("doc_id"), F.col("size")], "size", "served")
    # the targets meet the buckets of the sources before the documents do, so no large group is joined
    parts = slim.withColumn("bucket", F.substring("place", 1, digits)).select("key", "bucket").distinct().join(goal, "key")
    queued = written(queued.join(parts, ["key", "bucket"]).drop("bucket"), "queues")

    turns = queued.where((F.col("size") > 0) & (F.col("target") > 0)).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    # a copy's row is known by its source and the words served with it, which no two rows with words share
    turns = turns.select("key", "served", "doc_id", "place", "turn", "size", ((F.col("turn") * F.col("source_size") + F.col("served")) / F.col("target")).alias("finish"))
    # virtual time in slots; all times past twice the end share the last slot
    slots = max(64, (repeats * n) // bucket_rows)
    turns = turns.withColumn("slot", F.least(F.floor(F.col("finish") * slots), F.lit(2 * slots)).cast("long"))
    budget = queued.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()["s"]
    by_slot = turns.groupBy("slot").agg(F.sum("size").alias("words"))
    ends = by_slot.withColumn("end", F.sum("words").over(Window.orderBy("slot")))
    cut = ends.where(F.col("end") > budget).agg(F.min("slot").alias("slot"), F.min_by(F.col("end") - F.col("words"), "slot").alias("before")).first()
    whole, before = (cut["slot"], cut["before"]) if cut["slot"] is not None else (2 * slots + 1, 0)
    last = turns.where(F.col("slot") == whole).withColumn("used", F.lit(before) + F.sum("size").over(Window.orderBy("finish", "place", "turn", "doc_id", "key", "served").rowsBetween(Window.unboundedPreceding, 0)))
    edge = last.where(F.col("used") <= budget).groupBy("key", "served").agg(F.count("*").alias("more"))
    done = F.floor(F.lit(0.0))
    for turn in range(repeats):
        finish = (F.lit(turn) * F.col("source_size") + F.col("served")) / F.col("target")
        done = done + F.when((F.col("size") > 0) & (F.col("target") > 0) & (F.floor(finish * slots) < whole), 1).otherwise(0)
    more = F.when(F.col("size") > 0, F.coalesce(F.col("more"), F.lit(0))).otherwise(0)
    out = queued.join(edge, ["key", "served"], "left").withColumn("copies", (done + more).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with one more column, ``copies`` (``copies_`` if that name is taken).

    Rows that share id, source and size are told apart by their number among them,
    in the order of their copies and of their text hashes.
    """
    name, size, nth = fresh(docs, "copies"), fresh(docs, "_size"), fresh(docs, "_nth")
    same = [F.col("doc_id"), F.col("source").cast("string"), F.col(size)]
    got = mix(docs, weights, repeats, bucket_rows).where("copies > 0").withColumnRenamed("size", size)
    got = got.select("doc_id", "source", size, "copies", F.row_number().over(Window.partitionBy(*same).orderBy(F.col("copies").desc())).alias(nth))
    rows = docs.withColumn(size, F.regexp_count(text_column(docs), F.lit(WORD)).cast("long"))
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(*same).orderBy(F.xxhash64("text"), "text")))
    x, y = rows.alias("x"), got.alias("y")
    on = F.col(f"x.{size}") == F.col(f"y.{size}")
    for c in ("doc_id", nth):
        on &= F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    on &= F.col("x.source").cast("string").eqNullSafe(F.col("y.source"))
    return x.join(y, on).select(*[F.col(f"x.`{c}`") for c in docs.columns], F.col("y.copies").alias(name))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies", "source")


#: DuckDB SQL of the query's rows.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS bigint) AS size, md5('mix|' || coalesce(cast(doc_id AS varchar), 'null')) AS place FROM documents),
s AS (SELECT source, cast(sum(size) AS bigint) AS source_size FROM d GROUP BY source),
w AS (SELECT *, cast([5, 2, 1][cast((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS int)] AS double) AS weight, 3.0::double * source_size AS cap FROM s),
x AS (
  SELECT *, cast(sum(source_size) OVER () AS double) AS total, sum(weight) OVER () AS aw,
    coalesce(sum(cap) OVER u, 0.0::double) AS capped, coalesce(sum(weight) OVER u, 0.0::double) AS cw
  FROM w WINDOW u AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((total - capped) / (aw - cw)) AS level FROM x WHERE (total - capped) / (aw - cw) * weight <= cap),
g AS (SELECT source, source_size, least(cap, level * weight) AS target FROM x, l),
q AS (
  SELECT d.*, g.source_size, g.target, sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS served
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
t AS (SELECT q.*, turn, (turn * source_size + served) / target AS finish FROM q, (SELECT unnest([0, 1, 2]) AS turn) WHERE size > 0 AND target > 0),
u AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, place, turn, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM t),
k AS (SELECT doc_id, cast(count(*) AS bigint) AS copies FROM u WHERE used <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.copies, 0) * q.size AS taken FROM q LEFT JOIN k USING (doc_id)
"""
