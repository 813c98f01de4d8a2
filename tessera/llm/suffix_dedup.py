"""Suffix-array dedup: remove bytes of long strings that also start earlier.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier
(smaller doc_id, or same document and earlier start), judged on the input.

The corpus is cut so that equal strings always meet, and nothing else has to:

1. Every string of LENGTH bytes has an *anchor*, the K-byte gram of least hash in
   it, leftmost on ties. Equal strings have equal anchors at equal places. Only
   anchors that occur twice can lie in repeated strings.
2. Anchors with equal surroundings as far as any of their strings reach need no
   sorting: all strings of all but the first repeat it.
3. The first of each different surrounding of one anchor are sorted: columns of
   the aligned surroundings on which the same ones agree are one symbol, and
   the suffix array of all symbol rows is built by linear grouping (descending
   groups of Lyndon prefixes along previous-smaller pointers, see
   ``_grouping``). Suffixes with a long enough common prefix are the same
   string; the earliest of them stays.

An anchor with very many different surroundings is parted by the bytes to its
left (strings that reach further to the left) and to its right (the others), so
that no task gets an unbounded group.

Defined cases: null and empty texts have no bytes; strings never cross
documents; rows that share an id and the text count as one document; rows with a
null id are left as they are; very long documents are handled whole; an empty
table gives an empty result; columns other than ``doc_id`` and ``text`` are
passed through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _bytes as B
from ._grouping import common_prefixes, suffix_array
from ._spark import release, small_enough, table, written

LENGTH = 100
K = 32
#: Bytes of a surrounding on either side of its anchor's start.
LEFT, RIGHT = LENGTH - K, LENGTH
#: An anchor with more different surroundings than this is parted by its neighbour bytes.
MOST_SURROUNDINGS = 500
#: Bytes to a side of which every string has so many on one side of the anchor.
SIDE = (LENGTH - K) // 2
#: Symbols that are sorted at once.
SORT_SYMBOLS = 20_000

# an anchor's place: start, and how far its first and last string begin before it
PACK = 1 << 7


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start in the row, hash, most and least bytes by which its strings begin before it) of a slice's anchors."""
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none.astype(np.uint64), none, none
    sums = B.prefix_hash(data)
    at = np.arange(len(data) - K + 1)
    grams = B.span_hash(sums, at, at + K)
    bits = np.uint64(32)  # the upper half of the hash decides, then the place
    key = (grams >> bits << bits) | at.astype(np.uint64)
    # least key over LENGTH - K + 1 grams, by doubling
    width, least = 1, key
    while 2 * width <= LENGTH - K + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    more = LENGTH - K + 1 - width
    if more:
        least = np.minimum(least[: len(least) - more], least[more:])
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)[: len(least)]
    inside = np.arange(len(least)) + LENGTH <= offsets[1:][row]
    start = np.flatnonzero(inside)
    chosen = (least[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = row[start]
    new = np.ones(len(start), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    where = chosen[first]
    return row[first], where - offsets[row[first]], grams[where], where - start[first], where - start[last]


def find_anchors(docs: DataFrame) -> DataFrame:
    """doc_id, h (gram), c (surroundings), place of every anchor."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in B.slices(batch["text"]):
                row, start, gram, most, least = anchors(data, offsets)
                sums = B.prefix_hash(data)
                a = np.maximum(offsets[row], offsets[row] + start - LEFT)
                b = np.minimum(offsets[row + 1], offsets[row] + start + RIGHT)
                around = B.mix(B.span_hash(sums, a, b) + (offsets[row] + start - a).astype(np.uint64))
                place = (start * PACK + most) * PACK + least
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, last - first).take(pa.array(row)), pa.array(gram.view(np.int64)), pa.array(around.view(np.int64)), pa.array(place)], ["doc_id", "h", "c", "place"])

    return docs.mapInArrow(run, f"doc_id {kind}, h long, c long, place long")


def surroundings(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """key, doc_id, place and bytes of the anchors in ``firsts`` (doc_id, h, place, parted)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    lists = written(firsts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "h", "parted"))).alias("a")), "firsts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in B.slices(batch["text"]):
                part = batch["a"].slice(first, last - first)
                row = np.repeat(np.arange(last - first), pc.list_value_length(part).to_numpy(zero_copy_only=False))
                flat = part.flatten()
                place, h, parted = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                place, key = place.copy(), h.astype(np.int64).view(np.uint64).copy()
                start = place // (PACK * PACK)
                most, least = place // PACK % PACK, place % PACK
                if parted.any():  # strings with SIDE bytes before the anchor, and the others with SIDE bytes after it
                    sums = B.prefix_hash(data)
                    at = offsets[row] + start
                    west, east = parted & (most >= SIDE), parted & (least < SIDE)
                    i, j, k = np.flatnonzero(~parted), np.flatnonzero(west), np.flatnonzero(east)
                    keys = [key[i], B.mix(key[j] + B.span_hash(sums, at[j] - SIDE, at[j])), B.mix(key[k] ^ B.span_hash(sums, at[k] + K, at[k] + K + SIDE))]
                    pick = np.concatenate((i, j, k))
                    most, least = np.concatenate((most[i], most[j], np.minimum(most[k], SIDE - 1))), np.concatenate((least[i], np.maximum(least[j], SIDE), least[k]))
                    key, row, start = np.concatenate(keys), row[pick], start[pick]
                a = np.maximum(offsets[row], offsets[row] + start - LEFT)
                b = np.minimum(offsets[row + 1], offsets[row] + start + RIGHT)
                text = data.tobytes()
                body = [text[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), batch["doc_id"].slice(first, last - first).take(pa.array(row)), pa.array((start * PACK + most) * PACK + least), pa.array(body, pa.binary())],
                    ["key", "doc_id", "place", "body"],
                )

    return docs.join(lists, "doc_id").mapInArrow(run, f"key long, doc_id {kind}, place long, body binary")


def repeated(group: np.ndarray, place: np.ndarray, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, from, to): strings of each surrounding that an earlier one of its group has, by ranges of their starts.

    ``group`` numbers the groups in order, 0 first; members stand in corpus order.
    """
    start, most, least = place // (PACK * PACK), place // PACK % PACK, place % PACK
    n, width = len(group), LEFT + RIGHT
    lead = LEFT - np.minimum(start, LEFT)
    lengths = np.array([len(x) for x in bodies])
    table_ = np.broadcast_to(256 + np.arange(n)[:, None], (n, width)).copy()  # outside the document: like nothing else
    owner = np.repeat(np.arange(n), lengths)
    column = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + lead[owner]
    table_[owner, column] = np.frombuffer(b"".join(bodies), np.uint8)
    # symbol of a cell: its value within group and column; its class: the first member with it
    cells = (group[:, None] * width + np.arange(width)) * (256 + n) + table_
    _, first, symbol = np.unique(cells.ravel(), return_index=True, return_inverse=True)
    kind = (first // width)[symbol].reshape(n, width)
    symbol = symbol.reshape(n, width) + 2
    heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    border = np.ones((len(heads), width), bool)
    border[:, 1:] = np.logical_or.reduceat(kind[:, 1:] != kind[:, :-1], heads, axis=0)
    run = np.cumsum(border, axis=1) - 1
    kept = border[group]
    count = kept.sum(axis=1)
    base = np.concatenate(([0], np.cumsum(count + 1)))
    text = np.ones(base[-1], np.int64)
    r, c = np.nonzero(kept)
    text[base[r] + run[group[r], c]] = symbol[r, c]
    text = text.tolist()
    order = suffix_array(text)
    shared = np.array(common_prefixes(text, order), np.int64)
    order = np.array(order, np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    member = (np.searchsorted(base, order, side="right") - 1).astype(np.int64)
    # every string: where its symbols begin and how many it has
    strings = most - least + 1
    who = np.repeat(np.arange(n), strings)
    before = np.repeat(most, strings) - (np.arange(len(who)) - np.repeat(np.cumsum(strings) - strings, strings))
    begin = LEFT - before
    a, b = run[group[who], begin], run[group[who], begin + LENGTH - 1]
    at, needs = rank[base[who] + a], b - a + 1
    hit = np.zeros(len(who), bool)
    for m in np.unique(needs):
        cut = np.flatnonzero(shared < m)
        earliest = np.minimum.reduceat(member, cut)
        some = np.flatnonzero(needs == m)
        hit[some] = earliest[np.searchsorted(cut, at[some], side="right") - 1] < who[some]
    k = np.flatnonzero(hit)
    if not len(k):
        return (np.empty(0, np.int64),) * 3
    new = np.concatenate(([True], (who[k][1:] != who[k][:-1]) | (before[k][1:] != before[k][:-1] - 1)))
    lo, hi = k[new], k[np.append(np.flatnonzero(new)[1:], len(k)) - 1]
    return who[lo], start[who[lo]] - before[lo], start[who[hi]] - before[hi] + LENGTH


def sort_surroundings(around: DataFrame) -> DataFrame:
    """doc_id, start, end of the repeated bytes that the sorted groups of surroundings show."""
    kind = around.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> pa.RecordBatch:
            key = rows["key"].to_numpy()
            group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1]))).astype(np.int64)
            who, a, b = repeated(group, rows["place"].to_numpy(), rows["body"].to_pylist())
            return pa.RecordBatch.from_arrays([rows["doc_id"].combine_chunks().take(pa.array(who)), pa.array(a), pa.array(b)], ["doc_id", "start", "end"])

        def parts(rows: pa.Table, final: bool) -> Iterator[pa.Table]:
            """Whole groups, a few thousand surroundings at once; the last group waits for more unless final."""
            nonlocal held
            key = rows["key"].to_numpy()
            heads = np.append(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), len(key))
            if not final:
                held = [rows.slice(heads[-2])]
                heads = heads[:-1]
            a = 0
            while a < len(heads) - 1:
                b = max(a + 1, int(np.searchsorted(heads, heads[a] + SORT_SYMBOLS // 16, side="right")) - 1)
                yield rows.slice(heads[a], heads[b] - heads[a])
                a = b

        for batch in batches:
            rows = pa.concat_tables([*(h if isinstance(h, pa.Table) else pa.Table.from_batches([h]) for h in held), pa.Table.from_batches([batch])])
            held = []
            if len(rows):
                for part in parts(rows, False):
                    yield flush(part)
        if held and len(held[0]):
            yield flush(held[0])

    near = around.repartition(F.col("key")).sortWithinPartitions("key", "doc_id", "place")
    return near.mapInArrow(run, f"doc_id {kind}, start long, end long")


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """doc_id and ``ranges``, the sorted disjoint byte ranges to remove, of the documents that have some."""
    slim = docs.select("doc_id", docs["text"].cast("string").alias("text")).where("doc_id is not null and text is not null")
    found = find_anchors(slim)
    by_gram, by_around = Window.partitionBy("h"), Window.partitionBy("h", "c")
    place = F.struct("doc_id", "place")
    marked = found.withColumns({"low": F.min(place).over(by_around), "c0": F.min("c").over(by_gram), "c1": F.max("c").over(by_gram)})
    marked = marked.select("doc_id", "h", "c", "place", (place == F.col("low")).alias("is_first"), (F.col("c0") != F.col("c1")).alias("varied"))
    marked = written(marked.where(~F.col("is_first") | F.col("varied")), "anchors")
    release(docs.sparkSession)

    start, most, least = F.expr(f"place div {PACK * PACK}"), F.expr(f"place div {PACK} % {PACK}"), F.expr(f"place % {PACK}")
    whole = marked.where(~F.col("is_first")).select("doc_id", (start - most).alias("start"), (start - least + LENGTH).alias("end"))
    firsts = marked.where("is_first and varied").select("doc_id", "h", "place").distinct()
    many = firsts.groupBy("h").count().where(F.col("count") > MOST_SURROUNDINGS).select("h", F.lit(True).alias("many"))
    firsts = firsts.join(many, "h", "left").select("doc_id", "h", "place", F.coalesce("many", F.lit(False)).alias("parted"))
    sorted_ = written(sort_surroundings(surroundings(slim, firsts)), "sorted")
    release(docs.sparkSession)

    # ranges that touch or overlap become one
    every = whole.union(sorted_)
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = every.withColumn("new", F.when(F.coalesce(reach, F.lit(-1)) < F.col("start"), 1).otherwise(0)).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return written(runs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("ranges")), "ranges")


def with_ranges(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_ranges``, the byte ranges to remove (null: none)."""
    return docs.join(small_enough(repeated_ranges(docs)).withColumnRenamed("ranges", "_ranges"), "doc_id", "left")


def rest(text: bytes, ranges: list[dict] | None) -> bytes:
    parts, last = [], 0
    for r in ranges or ():
        parts.append(text[last : r["start"]])
        last = r["end"]
    return b"".join([*parts, text[last:]])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the remaining bytes of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
            kept = []
            for text, ranges in zip(batch["text"].cast(pa.large_binary()), batch["_ranges"].to_pylist(), strict=True):
                text = text.as_py() or b""
                left = rest(text, ranges)
                for k, v in zip(rows, (len(text), len(text) - len(left), len(ranges or ()), hashlib.sha256(left).hexdigest()), strict=True):
                    rows[k].append(v)
                kept.append(left)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(rows[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")), pa.array(rows["kept_sha256"]), pa.array(kept, pa.binary())], ["doc_id", *rows, "kept"])

    slim = with_ranges(docs.select("doc_id", docs["text"].cast("string").alias("text"))).select("doc_id", "text", "_ranges")
    return slim.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents")).drop("kept")


#: DuckDB SQL of the query's rows, for small tables: it holds a row for every string. Bytes stand as two hex digits.
SQL = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, i, substr(x, 2000 * i + 1, 2198) AS y FROM (SELECT doc_id, x, unnest(range(0, (len(x) // 2 + 900) // 1000)) AS i FROM h WHERE len(x) >= 200)),
p AS (SELECT doc_id, 1000 * i + j AS k, md5_number(substr(y, 2 * j + 1, 200)) AS s FROM (SELECT doc_id, i, y, unnest(range(0, least(1000, len(y) // 2 - 99))) AS j FROM c WHERE len(y) >= 200)),
f AS (SELECT s, min((doc_id, k)) AS first FROM p GROUP BY s HAVING count(*) > 1),
r AS (SELECT doc_id, k, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= 100 THEN 0 ELSE 1 END AS new FROM p JOIN f USING (s) WHERE (doc_id, k) > first),
g AS (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM r),
t AS (SELECT doc_id, run, min(k) AS a, max(k) + 100 AS b FROM g GROUP BY doc_id, run),
u AS (SELECT doc_id, run, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM t),
k AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, cast(2 * last + 1 AS bigint), cast(2 * (a - last) AS bigint)), '' ORDER BY a) AS kept, max(b) AS reach
  FROM u JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, cast(len(x) // 2 AS bigint) AS n_bytes, cast(coalesce(n_removed, 0) AS bigint) AS n_removed, cast(coalesce(n_spans, 0) AS bigint) AS n_spans,
       sha256(unhex(CASE WHEN kept IS NULL THEN x ELSE kept || substr(x, cast(2 * reach + 1 AS bigint)) END)) AS kept_sha256
FROM h LEFT JOIN k USING (doc_id)
"""
