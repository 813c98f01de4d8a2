"""Exact k nearest neighbours of all vectors by cosine (J27, V10): a many-to-many join without a cross join.

Unit vectors are ordered by distance as by cosine, so the triangle inequality
holds. Equal vectors are compared once. Vectors belong to the cell of the nearest
pivot; a cell's rows are dealt into chunks of about ``CHUNK`` rows, so that a
dense region is many groups. Then:

1. each query meets one chunk of its own cell; its k-th best there bounds how far
   its k nearest can be;
2. it is sent to the other chunks whose cell can have anything within that bound
   (distance to the pivot less the cell's radius), in slices of about ``CHUNK``;
3. the best of all chunks are merged, at most k rows a chunk.

Where vectors fill their space evenly the bounds rule out little, and a query
meets most chunks: the work is then that of comparing all, as blocks of matrix
products, with bounded groups. Broadcast are the pivots (at most ``PIVOTS``) and
one row a chunk of counts.

Vectors that are null, empty, zero, not finite or of another size than most have
no neighbours and are nobody's. Similarities are rounded to ``DIGITS`` digits
before they are ordered; ties go to the smaller key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import written

CHUNK = 4000
PIVOTS = 1024
DIGITS = 6
#: Queries that meet a chunk at once, in one matrix of similarities.
BLOCK = 256
#: Rows that are sent to chunks at once, at most, or one query's.
SENT = 20_000
#: Where over so many times k + 1 members reach a query's bound, the (k + 1)-th best is found first.
MANY = 4
#: Groups of equal vectors with over one in so many of all rows are broadcast: at most so many.
HOT = 10_000
MATCH = "query long, similarity double, ids array<long>"


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix of float64."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def distinct_vectors(rows: DataFrame, k: int, size: int) -> DataFrame:
    """vector, rep (the smallest key) and ids (the k + 1 smallest keys) of all usable vectors, equal ones once."""
    good = (F.size("vector") == size) & F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("vector", lambda x: x != 0)
    first = Window.partitionBy("vector").orderBy("key")
    few = rows.where(good & F.col("key").isNotNull()).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("key")).alias("ids")).select("vector", F.col("ids")[0].alias("rep"), "ids")


def in_blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows``."""
    return (batch.slice(a, rows) for batch in batches for a in range(0, batch.num_rows, rows))


def in_cells(reps: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``reps`` with the number of the nearest pivot and the distance to it."""
    shared = reps.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches, BLOCK):
            near = unit(matrix(batch["vector"])) @ shared.value.T
            cell = near.argmax(axis=1)
            away = np.sqrt(np.maximum(0, 2 - 2 * near[np.arange(len(cell)), cell]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away)], [*batch.schema.names, "cell", "away"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reps.schema)
    return reps.mapInArrow(run, f"{fields}, cell int, away double")


def best(queries: pa.Table, members: pa.Table, k: int, block: int = BLOCK) -> pa.Table:
    """The k + 1 best members of each query, by rounded similarity and key, not below the query's ``least``.

    ``block`` queries meet the members at once, so a task's memory does not grow with the queries of its group.
    """
    order = np.argsort(members["rep"].to_numpy(), kind="stable")
    q, m, floor = unit(matrix(queries["vector"])), unit(matrix(members["vector"]))[order].T, queries["least"].to_numpy()
    rows, columns, values = [], [], []
    for a in range(0, len(q), block):
        near, least = q[a : a + block] @ m, floor[a : a + block]
        # what may count after rounding: all that the (k + 1)-th best rounds to, and more
        enough = least - 10.0**-DIGITS
        if near.shape[1] > k + 1 and (near >= enough[:, None]).sum() > MANY * near.shape[0] * (k + 1):
            enough = np.maximum(enough, np.partition(near, -k - 1, axis=1)[:, -k - 1] - 2 * 10.0**-DIGITS)
        row, column = np.nonzero(near >= enough[:, None])
        value = np.round(near[row, column], DIGITS)
        best_first = np.lexsort((column, -value, row))
        row, column, value = row[best_first], column[best_first], value[best_first]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = (place <= k) & (value >= least[row])
        rows.append(row[keep] + a)
        columns.append(column[keep])
        values.append(value[keep])
    row, column, value = (np.concatenate(x) for x in (rows, columns, values))
    return pa.table({"query": pa.array(queries["rep"].to_numpy()[row], pa.int64()), "similarity": pa.array(value), "ids": members["ids"].combine_chunks().take(pa.array(order[column]))})


def sent(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, chunks: np.ndarray, first: np.ndarray, radius: np.ndarray, most: int = SENT) -> Iterator[pa.RecordBatch]:
    """Queries (rep, vector, least, part) for all other chunks of cells within their bound.

    A query may go to all chunks, so few queries are taken at once: batches have at most ``most`` rows, or one query's, however many chunks there are.
    """
    for batch in in_blocks(batches, max(1, min(BLOCK, most // max(1, int(chunks.sum()))))):
        away = np.sqrt(np.maximum(0, 2 - 2 * (unit(matrix(batch["vector"])) @ pivots.T)))
        within = np.sqrt(np.maximum(0, 2 - 2 * (batch["least"].to_numpy() - 10.0**-DIGITS))) + 1e-9
        row, cell = np.nonzero((away - radius <= within[:, None]) & (chunks > 0))
        row, cell = np.repeat(row, chunks[cell]), np.repeat(cell, chunks[cell])
        pair = row * len(chunks) + cell
        new = np.flatnonzero(np.diff(pair, prepend=-1))
        step = np.arange(len(row)) - np.repeat(new, np.diff(new, append=len(row)))
        to = first[cell] + step
        other = to != batch["part"].to_numpy()[row]
        taken = batch.select(["rep", "vector", "least"]).take(pa.array(row[other]))
        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(to[other].astype(np.int32))], ["rep", "vector", "least", "part"])


def nearest_join(left: DataFrame, right: DataFrame, k: int, chunk: int = CHUNK) -> DataFrame:
    """key, rank (1 ... k), neighbour and similarity: for each row of ``left`` the k nearest rows of ``right`` with another key.

    Both have a long ``key`` and an array ``vector``.
    """
    spark = left.sparkSession
    left, right = (df.select(F.col("key").cast("long").alias("key"), F.col("vector").cast("array<float>").alias("vector")) for df in (left, right))
    sizes = right.where(F.size("vector") > 0).groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    empty = spark.createDataFrame([], "key long, rank int, neighbour long, similarity double")
    if sizes is None:
        return empty
    members = written(distinct_vectors(right, k, sizes[0]), "members")
    queries = written(distinct_vectors(left, 0, sizes[0]).drop("ids"), "queries")
    n = members.count()
    if not n:
        return empty
    chosen = members.orderBy(F.xxhash64("rep"), "rep").select("vector").limit(min(PIVOTS, -(-n // chunk))).toArrow()  # bounded
    pivots = unit(matrix(chosen["vector"]))

    placed = in_cells(members, pivots)
    counts = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).toArrow().to_pydict()  # one row a pivot
    chunks = np.zeros(len(pivots), np.int64)
    radius = np.zeros(len(pivots))
    for c, m, r in zip(counts["cell"], counts["n"], counts["radius"], strict=True):
        chunks[c], radius[c] = -(-m // chunk), r
    # a cell's chunks follow each other in one numbering
    first = np.cumsum(chunks) - chunks
    layout = F.broadcast(spark.createDataFrame([(c, int(first[c]), int(max(chunks[c], 1))) for c in range(len(pivots))], "cell int, first long, chunks long"))

    def dealt(df: DataFrame) -> DataFrame:
        return df.join(layout, "cell").withColumn("part", (F.col("first") + F.pmod(F.xxhash64("rep"), "chunks")).cast("int")).drop("first", "chunks")

    members = written(dealt(placed), "members")

    def met(asked: DataFrame, name: str) -> DataFrame:
        """Matches of queries (rep, vector, least, part) with the members of their part, in slices."""
        slices = asked.groupBy("part").agg(F.ceil(F.count("*") / chunk).cast("int").alias("slices"))  # one row a chunk
        sliced = asked.join(F.broadcast(slices), "part").withColumn("slice", F.pmod(F.xxhash64(F.col("rep"), F.lit(1)), "slices").cast("int"))
        spread = members.join(F.broadcast(slices), "part").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        pair = sliced.select("part", "slice", "rep", "vector", "least").groupBy("part", "slice").cogroup(spread.select("part", "slice", "rep", "vector", "ids").groupBy("part", "slice"))

        def compare(q: pa.Table, m: pa.Table) -> pa.Table:
            if not q.num_rows or not m.num_rows:
                return pa.table({"query": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64()), "ids": pa.array([], pa.list_(pa.int64()))})
            return best(q, m, k)

        return written(pair.applyInArrow(compare, MATCH), name)

    own = dealt(in_cells(queries, pivots)).withColumn("least", F.lit(-2.0))
    near = met(own, "own_chunks")
    # the (k + 1)-th best so far bounds the rest; fewer so far bound nothing
    bound = near.groupBy("query").agg(F.count("*").alias("n"), F.min("similarity").alias("least")).select(F.col("query").alias("rep"), F.when(F.col("n") > k, F.col("least")).otherwise(-2.0).alias("least"))
    shared = spark.sparkContext.broadcast((pivots, chunks, first, radius))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return sent(batches, *shared.value)

    further = own.select("rep", "vector", "part").join(bound, "rep").mapInArrow(reach, "rep long, vector array<float>, least double, part int")
    matches = near.unionAll(met(further, "other_chunks"))
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), F.col("ids")[0])
    matches = matches.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    found = matches.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("far"), "ids"))).alias("found"))
    found = written(found, "matches")

    # every row of the left side takes what its vector found, but for itself
    hashed = left.withColumn("vector_hash", F.xxhash64("vector"))
    groups = queries.select(F.col("rep").alias("query"), F.col("vector"), F.xxhash64("vector").alias("vector_hash"))
    total = left.count()
    often = hashed.groupBy("vector_hash").agg(F.count("*").alias("n")).where(F.col("n") * HOT > total).select("vector_hash")
    with_found = groups.join(found, "query")
    hot = with_found.join(F.broadcast(often), "vector_hash", "left_semi")
    columns = ["key", "found"]
    same = ["vector_hash", "vector"]
    few = hashed.join(F.broadcast(often), "vector_hash", "left_anti").join(with_found, same).select(columns)
    many = hashed.join(F.broadcast(hot), same).select(columns)
    each = F.flatten(F.transform("found", lambda f: F.transform(f["ids"], lambda i: F.struct(f["far"].alias("far"), i.alias("id")))))
    nearest = F.slice(F.sort_array(F.filter(each, lambda x: x["id"] != F.col("key"))), 1, k)
    out = few.unionAll(many).select("key", F.posexplode(nearest).alias("at", "x"))
    return out.select("key", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("neighbour"), (-F.col("x.far")).alias("similarity"))
