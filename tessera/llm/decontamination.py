"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to their lower-case words joined by single blanks; the
automaton holds every window of ten consecutive words of the benchmark items
(an item of fewer words is one window), each between blanks. A document is
scanned once; matches are mapped back to words and, for reports, to character
offsets of the original text.

The benchmark is broadcast only in blocks of at most ``BLOCK_CHARS`` characters
of windows: a larger benchmark takes one scan for each block.

Defined cases: null texts have no words and no hits; empty items match nothing;
items without an id are hits and count as one item, which the digest leaves out;
long texts are scanned whole; equal items are all reported; repeated rows are
reported each; an empty table gives an empty result and an empty benchmark no
hits; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes as B
from ._spark import table

WINDOW = 10
#: Characters of windows in one automaton; bounds what is broadcast.
BLOCK_CHARS = 8_000_000

#: Bytes that end a word; A-Z become a-z, all separators a blank.
_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_NORMAL = bytes.maketrans(_SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))
_IS_SEPARATOR = B.lookup(_SEPARATORS)


def normal_words(text: str | bytes | None) -> list[bytes]:
    """A text's words, lower-cased in A-Z only."""
    data = text.encode("utf-8") if isinstance(text, str) else text or b""
    return data.translate(_NORMAL).split()


def windows(text: str | None, size: int = WINDOW) -> set[bytes]:
    """The distinct windows of an item."""
    words = normal_words(text)
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def automaton(patterns: list[tuple[bytes, list]]) -> ahocorasick.Automaton:
    """Patterns are (window, item ids). Bytes stand as Latin-1 characters, so offsets are byte offsets."""
    out = ahocorasick.Automaton()
    for window, items in patterns:
        out.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, len(window), items))
    if patterns:
        out.make_automaton()
    return out


def scan(text: bytes, machine: ahocorasick.Automaton) -> tuple[int, np.ndarray, set]:
    """(words, hit words as ranges [from, to) by word number, items found)."""
    words = text.translate(_NORMAL).split()
    if not words or not len(machine):
        return len(words), np.empty((0, 2), np.int64), set()
    normal = b" " + b" ".join(words) + b" "
    found = list(machine.iter(normal.decode("latin-1")))
    if not found:
        return len(words), np.empty((0, 2), np.int64), set()
    starts = np.cumsum([1, *(len(w) + 1 for w in words)])
    ranges, items = [], set()
    for end, (count, size, ids) in found:
        first = int(np.searchsorted(starts, end - size))
        ranges.append((first, first + count))
        items.update(ids)
    return len(words), np.array(sorted(set(ranges)), np.int64), items


def merged(ranges: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in ranges:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], int(b))
        else:
            out.append([int(a), int(b)])
    return [(a, b) for a, b in out]


def original_offsets(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character ranges of the original text that word ranges cover."""
    data = np.frombuffer(text, np.uint8)
    start, end, _ = B.spans(data, np.array([0, len(data)]), _IS_SEPARATOR)
    characters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return [(int(characters[start[a]]), int(characters[end[b - 1]])) for a, b in ranges]


def in_order(items: set) -> list:
    """Item ids in ascending order, null last."""
    return sorted(items, key=lambda i: (i is None, i or ""))


def blocks(benchmark: DataFrame, size: int, block_chars: int) -> Iterator[list[tuple[bytes, list]]]:
    """The benchmark's windows with their item ids, in blocks of bounded size."""
    kind = "string"
    rows = benchmark.select(benchmark["item_id"].cast(kind).alias("item_id"), benchmark["text"].cast("string").alias("text"))
    held: dict[bytes, set] = {}
    chars = 0
    for row in rows.toLocalIterator():
        for window in windows(row["text"], size):
            if window not in held:
                chars += len(window) + 2
            held.setdefault(window, set()).add(row["item_id"])
        if chars >= block_chars:
            yield sorted((w, in_order(i)) for w, i in held.items())
            held, chars = {}, 0
    if held:
        yield sorted((w, in_order(i)) for w, i in held.items())


def find(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Every row of ``docs`` with n_words, hit_words (ranges of word numbers), items (sorted ids found) and
    spans (character ranges of the original text). Columns of ``docs`` of these names are replaced."""
    new = ("n_words", "hit_words", "items", "spans")
    plain = docs.drop(*new)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    span = "array<struct<start:long,end:long>>"
    out = None
    names = plain.columns
    parts = blocks(benchmark, size, block_chars)
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    # one block of the benchmark is on the driver at a time; an empty benchmark has an empty one
    for patterns in chain([next(parts, [])], parts):
        shared = docs.sparkSession.sparkContext.broadcast(patterns)
        again = out is not None

        def run(batches: Iterator[pa.RecordBatch], shared=shared, again=again) -> Iterator[pa.RecordBatch]:
            machine = automaton(shared.value)
            for batch in batches:
                counts, hits, found, where = [], [], [], []
                before = [batch[n].to_pylist() for n in ("hit_words", "items")] if again else None
                texts = batch["text"].cast(pa.large_binary())
                for k in range(batch.num_rows):
                    text = texts[k].as_py() or b""
                    n, ranges, items = scan(text, machine)
                    if again:
                        ranges = np.array(sorted([*map(tuple, ranges.tolist()), *((r["start"], r["end"]) for r in before[0][k])]), np.int64).reshape(-1, 2)
                        items |= set(before[1][k])
                    joined = merged(ranges)
                    counts.append(n)
                    hits.append([{"start": a, "end": b} for a, b in joined])
                    found.append(in_order(items))
                    where.append([{"start": a, "end": b} for a, b in original_offsets(text, joined)] if joined else [])
                columns = {c: batch[c] for c in names}
                columns |= {"n_words": pa.array(counts, pa.int64()), "hit_words": pa.array(hits, pair), "items": pa.array(found, pa.list_(pa.string())), "spans": pa.array(where, pair)}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        out = (plain if out is None else out).mapInArrow(run, f"{schema}, n_words long, hit_words {span}, items array<string>, spans {span}")
    return out


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    found = find(docs.select("doc_id", docs["text"].cast("string").alias("text")), benchmark, size)
    hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "spans",
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, columns unchanged."""
    kept = find(docs.withColumnsRenamed({c: f"_{c}" for c in docs.columns if c != "text"}), benchmark, size).where(F.size("hit_words") == 0)
    return kept.select([F.col(c if c == "text" else f"_{c}").alias(c) for c in docs.columns])


def sha256(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


#: DuckDB SQL of the query's rows.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT cast(item_id AS varchar) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS pat, least(len(w), 10) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM p),
o AS (
  SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS pat
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, s WHERE len(w) >= n)),
m AS (SELECT o.doc_id, o.k, o.n, p.item FROM o JOIN p ON o.pat = p.pat AND o.n = p.n),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, cast(len(d.w) AS bigint) AS n_words, cast(coalesce(h.n_hit, 0) AS bigint) AS n_hit, cast(coalesce(t.n_items, 0) AS bigint) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
