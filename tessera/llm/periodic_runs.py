"""Periodic runs of words: stretches that repeat themselves with some period.

A run is a stretch of consecutive words with smallest period q, at least
``max(MIN_WORDS, 2 * q)`` words long, that no neighbouring word extends.

Method: every run of period p covers two neighbouring points of the grid
0, p, 2p, ... of its text. For all (period, grid point) pairs of many texts at
once, NumPy compares the words at a point and the next one, and finds by a
simultaneous binary search over prefix hashes how far the two places agree to
the right and to the left. Agreements of at least p words are runs; those found
at several points or by a multiple of their period are one. The runs are then
verified on the words themselves, and a text where hashes deceived is done
again by direct comparison.

A text of n words has about n ln n pairs. They are laid out in chunks of
``CHUNK`` pairs, so a task holds one slice of texts (256 kB, or one longer text)
and one chunk, however long or repetitive the text is.

Defined cases: null and empty texts have no words, no runs and an empty
collapsed text; long texts are searched whole; overlapping runs are all
reported, and a word is dropped if any of them repeats it; repeated rows are
searched each; equal lengths are told apart by start, then period; an empty
table gives an empty result; other columns are passed on, but those named like
the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes as B
from ._crc_sql import CRC_SQL, crc_sql
from ._spark import WORD, crc, let, table

#: The fewest words of a run.
MIN_WORDS = 12
#: (period, grid point) pairs laid out at once.
CHUNK = 1 << 20

RUNS = "array<struct<start:long,length:long,period:long>>"


def grids(first: np.ndarray, count: np.ndarray, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, grid point, period) of all pairs of texts with ``count`` words from word ``first`` on, in chunks."""
    periods = count // 2
    text = np.repeat(np.arange(len(count)), periods)
    period = 1 + np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods)
    points = (count[text] - 1) // period
    upto = np.cumsum(points)
    at = 0
    while at < len(text):
        before = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, before + chunk, side="right")))
        n = points[at:to]
        owner, p = np.repeat(text[at:to], n), np.repeat(period[at:to], n)
        step = np.arange(len(p)) - np.repeat(upto[at:to] - n - before, n)
        yield owner, first[owner] + step * p, p
        at = to


def agreement(sums: np.ndarray, left: np.ndarray, right: np.ndarray, most: np.ndarray, sign: int) -> np.ndarray:
    """How many words from two places on are equal, rightwards or (sign -1) leftwards, at most ``most``: all places by one binary search."""
    up, _ = B.powers(len(sums))
    shift = up[right - left]
    low, high = np.zeros(len(left), np.int64), most.copy()
    while len(left) and (low < high).any():
        middle = (low + high + 1) // 2
        if sign > 0:
            a, b = sums[left + middle] - sums[left], sums[right + middle] - sums[right]
        else:
            a, b = sums[left] - sums[left - middle], sums[right] - sums[right - middle]
        same = a * shift == b
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def candidates(words: np.ndarray, first: np.ndarray, count: np.ndarray, least: int = MIN_WORDS, chunk: int = CHUNK) -> np.ndarray:
    """Runs as rows (text, start, end, period) by word hashes, each once with its smallest period."""
    up, _ = B.powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    found = [np.empty((0, 4), np.int64)]
    for text, left, period in grids(first, np.where(count >= least, count, 0), chunk):
        right = left + period
        same = words[left] == words[right]
        text, left, right, period = text[same], left[same], right[same], period[same]
        ahead = agreement(sums, left, right, first[text] + count[text] - right, 1)
        behind = agreement(sums, left, right, left - first[text], -1)
        good = (ahead + behind >= period) & (ahead + behind + period >= least)
        rows = np.stack((text[good], (left - behind)[good], (right + ahead)[good], period[good]), axis=1)
        found.append(np.unique(rows, axis=0))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    return rows[new]


def holds(words: list[bytes], start: int, end: int, period: int) -> bool:
    """Whether a run is periodic and maximal by the words themselves."""
    return (
        words[start : end - period] == words[start + period : end]
        and (start == 0 or words[start - 1] != words[start - 1 + period])
        and (end == len(words) or words[end] != words[end - period])
    )


def direct(words: list[bytes], least: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs by comparing the words at every distance."""
    codes: dict[bytes, int] = {}
    numbers = np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)
    best: dict[tuple[int, int], int] = {}
    for period in range(1, len(words) // 2 + 1):
        same = np.concatenate(([False], numbers[period:] == numbers[:-period], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        for a, b in edges[edges[:, 1] - edges[:, 0] >= max(period, least - period)].tolist():
            best.setdefault((a, b + period), period)
    return [(a, b, p) for (a, b), p in best.items()]


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run repeats."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, end, period in runs:
        depth[start + period] += 1
        depth[end] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def search(texts: list[bytes], data: np.ndarray, offsets: np.ndarray, least: int = MIN_WORDS, chunk: int = CHUNK) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(number of words, runs by start and period, collapsed text) of each text of a slice."""
    start, end, row = B.spans(data, offsets, B.IS_SPACE)
    hashes = B.span_hash(B.prefix_hash(data), start, end)
    count = np.bincount(row, minlength=len(texts)).astype(np.int64)
    first = np.cumsum(count) - count
    rows = candidates(hashes, first, count, least, chunk)
    at = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
    for k, text in enumerate(texts):
        words = text.split()
        runs = [(a - int(first[k]), b - int(first[k]), p) for _, a, b, p in rows[at[k] : at[k + 1]].tolist()]
        if not all(holds(words, *r) for r in runs):
            runs = direct(words, least)
        runs.sort(key=lambda r: (r[0], r[2]))
        yield len(words), runs, b" ".join(kept_words(words, runs))


def find(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """Every row of ``docs`` with n_words, runs (start, length and period in words, by start and period) and
    collapsed (the text without repeats, its words joined by one blank). Columns of these names are replaced."""
    new = ("n_words", "runs", "collapsed")
    plain = docs.drop(*new).withColumn("text", docs["text"].cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    item = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in B.slices(batch["text"]):
                body = data.tobytes()
                texts = [body[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                counts, runs, collapsed = [], [], []
                for n, found, left in search(texts, data, offsets, least):
                    counts.append(n)
                    runs.append([{"start": a, "length": b - a, "period": p} for a, b, p in found])
                    collapsed.append(left)
                part = batch.slice(low, high - low)
                new_columns = [pa.array(counts, pa.int64()), pa.array(runs, item), pa.array(collapsed, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new_columns], [*part.schema.names, *new])

    return plain.mapInArrow(run, f"{schema}, n_words long, runs {RUNS}, collapsed string")


def collapse(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeats of every run taken out of the text; texts without a run are unchanged."""
    inner = docs.withColumnsRenamed({c: f"_{c}" for c in docs.columns if c != "text"})
    found = find(inner, least).withColumn("text", F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("text")))
    return found.select([F.col(c if c == "text" else f"_{c}").alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """n_runs, the longest run and digests of the runs and of the collapsed text of every document."""
    found = find(docs.select("doc_id", docs["text"].cast("string").alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def planted(doc_id: Column, text: Column) -> Column:
    """The query's texts: with h = crc32(doc_id) and g = h div 10, where h mod 10 is 0, every word i >= a = g mod n is word
    a + (i - a) mod p for p = 1 + (n - a) div (3 + g mod 8)."""
    h = crc(doc_id)
    g = F.floor(h / 10)

    def rewritten(w: Column) -> Column:
        n = F.size(w).cast("long")
        return let(F.struct(w.alias("w"), F.pmod(g, n).alias("a"), (1 + F.floor((n - F.pmod(g, n)) / (3 + F.pmod(g, F.lit(8))))).alias("p")), lambda s: F.array_join(
            F.transform(s["w"], lambda x, i: F.when(i < s["a"], x).otherwise(F.get(s["w"], (s["a"] + F.pmod(i - s["a"], s["p"])).cast("int")))), " "))

    return F.when((F.pmod(h, F.lit(10)) == 0) & text.rlike(WORD), let(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), rewritten)).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    return report(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))


#: A run is at least six words that equal those one period on, so equal groups of six words find all pairs.
SQL = rf"""
WITH {CRC_SQL},
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, {crc_sql("cast(doc_id AS varchar)")} AS h FROM documents, crc_list),
e AS (SELECT doc_id, w, cast(len(w) AS bigint) AS n, h % 10 = 0 AND len(w) > 0 AS hit, (h // 10) AS g FROM d),
f AS (SELECT *, CASE WHEN hit THEN g % n END AS a FROM e),
p AS (SELECT *, CASE WHEN hit THEN 1 + (n - a) // (3 + g % 8) END AS p FROM f),
x AS (
  SELECT doc_id, n, CASE WHEN hit THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
s AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 6], ' ') AS six FROM (SELECT doc_id, w, unnest(range(0, n - 5)) AS i FROM x WHERE n >= 12)),
q AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM s l JOIN s r ON l.doc_id = r.doc_id AND l.six = r.six AND l.i < r.i),
v AS (SELECT doc_id, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle, i FROM q),
u AS (SELECT doc_id, q, min(i) AS a, max(i) + 6 + q AS b FROM v GROUP BY doc_id, q, isle),
r AS (SELECT doc_id, a AS start, b - a AS length, min(q) AS period FROM u WHERE b - a >= 2 * q AND b - a >= 12 GROUP BY ALL),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS body,
        list(struct_pack(start, length, period) ORDER BY length DESC, start, period)[1] AS best FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM x) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT x.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
       sha256(coalesce(t.body, '')) AS runs_sha256, sha256(coalesce(kept.body, '')) AS collapsed_sha256
FROM x LEFT JOIN t USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
