"""License scans: short license notices, also misspelt ones, in whole texts.

Texts are normalised to their lower-case words joined by single blanks. A notice
of m bytes is found with at most ``allowed(m)`` edits (insertions, deletions,
substitutions of bytes).

Method: with k edits allowed, a notice is split into k + 1 pieces; by the
pigeonhole principle at least one piece of every match has no edit. One
Aho-Corasick automaton over the pieces of all notices finds these seeds in one
scan; each seed says where its notice could stand, and windows of one notice
that overlap are joined, up to a few lengths of it. In each window the regex library's bounded-error
matching verifies the edits and gives the spans, which are mapped back to words
and to character offsets of the original text. Where matches of several notices
overlap, the one with the fewest edits for its length stays (then the longer,
the earlier, the smaller label), so a notice is not taken for its neighbour.

Short exact phrases (``PHRASES``) are counted at every place and always label.

The automaton is built from a fixed list, so nothing grows with the data but the
text at hand; windows never hold more than their text, and seeds are linear in it.

Defined cases: null and empty texts have no words, places, labels and score 0;
long texts are scanned whole; equal notices in one text are all reported; places
of one phrase may overlap those of another; repeated rows are scanned each; an
empty table gives an empty result; other columns are passed on, but those named
like the new ones are replaced. A character of several bytes counts as so many
edits.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import pairwise
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import table
from .decontamination import normal_words, original_offsets

#: Bytes of a notice for each edit that is allowed.
BYTES_PER_EDIT = 12
#: Overlapping windows are joined up to so many lengths of their notice.
JOINED = 3

# The exact phrases of the base rule and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Short notices as their licenses give them, normalised, with SPDX-like labels.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "redistribute it and or modify it under the terms of the gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "subject to the terms of the mozilla public license": "mpl",
    "made available under the terms of the eclipse public license": "epl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by nd 4 0": "cc-by-nd-4.0",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa-4.0",
    "licensed under cc by nc nd 4 0": "cc-by-nc-nd-4.0",
    "licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4.0",
    "licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4.0",
    "has waived all copyright and related or neighboring rights to this work": "cc0",
}


class Match(NamedTuple):
    """A notice's match: bytes [start, end) of the normalised text, edits, the notice."""

    start: int
    end: int
    edits: int
    notice: str


def allowed(size: int) -> int:
    """Edits allowed in a notice of so many bytes."""
    return size // BYTES_PER_EDIT


def pieces(notice: str) -> list[tuple[int, str]]:
    """The notice in one piece more than edits are allowed, with their places."""
    n = allowed(len(notice)) + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in pairwise(cuts)]


@cache
def seeds() -> ahocorasick.Automaton:
    """The pieces of all notices (piece → its notices and places there) and the phrases."""
    held: dict[str, list[tuple[str, int]]] = {}
    for notice in NOTICES:
        for at, piece in pieces(notice):
            held.setdefault(piece, []).append((notice, at))
    for phrase in PHRASES:
        held.setdefault(f" {phrase} ", []).append((phrase, -1))
    out = ahocorasick.Automaton()
    for piece, owners in held.items():
        out.add_word(piece, (len(piece), owners))
    out.make_automaton()
    return out


@cache
def verifier(notice: str) -> regex.Pattern:
    return regex.compile(f"(?e)(?:{regex.escape(notice)}){{e<={allowed(len(notice))}}}")


def windows(starts: list[int], notice: str, size: int) -> Iterator[tuple[int, int]]:
    """Windows in which the notice could stand if it began at any of ``starts`` but for edits. Each start's
    window lies whole in one of them; overlapping ones are joined up to a few notices' length."""
    k = allowed(len(notice))
    low = high = -1
    for start in sorted(set(starts)):
        a, b = max(0, start - k), min(size, start + len(notice) + k)
        if high < 0 or a > high or b - low > JOINED * len(notice):
            if high >= 0:
                yield low, high
            low = a
        high = b
    if high >= 0:
        yield low, high


@lru_cache(1 << 14)
def verified(notice: str, window: str) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the notice's matches in a window; copies of one text cost once."""
    return [(m.start(), m.end(), sum(m.fuzzy_counts)) for m in verifier(notice).finditer(window)]


def locate(normal: str) -> tuple[list[Match], list[tuple[int, str]]]:
    """(all notices with bounded edits, places of exact phrases) in a normalised text with a blank at both ends."""
    starts: dict[str, list[int]] = {}
    exact = []
    for end, (size, owners) in seeds().iter(normal):
        for notice, at in owners:
            if at < 0:
                exact.append((end - size + 2, notice))
            else:
                starts.setdefault(notice, []).append(end + 1 - size - at)
    found = []
    for notice, where in starts.items():
        for low, high in windows(where, notice, len(normal)):
            found += [Match(low + a, low + b, edits, notice) for a, b, edits in verified(notice, normal[low:high])]
    return found, exact


def settled(matches: list[Match]) -> list[Match]:
    """Of overlapping matches, those with the fewest edits for their length, in order."""
    held: list[Match] = []  # apart from each other, by start
    for m in sorted(matches, key=lambda m: (m.edits / len(m.notice), m.start - m.end, m.start, NOTICES[m.notice], m.notice)):
        at = bisect(held, m)
        if (at == 0 or held[at - 1].end <= m.start) and (at == len(held) or held[at].start >= m.end):
            held.insert(at, m)
    return held


def scan(text: bytes) -> tuple[int, list[int], list[str], list[tuple]]:
    """(words, first words of phrase places, their labels, notices as (label, edits, similarity, first word, words, start, end))."""
    words = normal_words(text)
    normal = " " + b" ".join(words).decode("latin-1") + " "
    found, exact = locate(normal) if words else ([], [])
    if not found and not exact:
        return len(words), [], [], []
    at = np.cumsum([1, *(len(w) + 1 for w in words)])
    places = sorted(int(np.searchsorted(at, p)) for p, _ in exact)
    notices = []
    kept = settled(found)
    # a match may begin or end inside a word: its span is that of the words it touches
    ranges = []
    for m in kept:
        a = max(0, int(np.searchsorted(at, m.start + (normal[m.start] == " "), "right")) - 1)
        b = max(a + 1, int(np.searchsorted(at, m.end - (normal[m.end - 1] == " "), "left")))
        ranges.append((a, min(b, len(words))))
    offsets = original_offsets(text, ranges) if ranges else []
    for m, (a, b), (start, end) in zip(kept, ranges, offsets, strict=True):
        notices.append((NOTICES[m.notice], m.edits, 1 - m.edits / len(m.notice), a, b - a, start, end))
    return len(words), places, [PHRASES[p] for _, p in exact], notices


SPANS = "array<struct<label:string,edits:long,similarity:double,word:long,n_words:long,start:long,end:long>>"


def find(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with n_words, places (first words of exact phrases, ascending), base_labels and labels (distinct,
    sorted) and notices (label, edits, similarity, words and character span in the original). Columns of these names are replaced."""
    new = ("n_words", "places", "base_labels", "labels", "notices")
    plain = docs.drop(*new).withColumn("text", docs["text"].cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    fields = [("label", pa.string()), ("edits", pa.int64()), ("similarity", pa.float64()), ("word", pa.int64()), ("n_words", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]
    names = [n for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].cast(pa.large_binary())
            counts, places, base, labels, notices = [], [], [], [], []
            for k in range(batch.num_rows):
                n, where, exact, found = scan(texts[k].as_py() or b"")
                counts.append(n)
                places.append(where)
                base.append(sorted(set(exact)))
                labels.append(sorted({*exact, *(f[0] for f in found)}))
                notices.append([dict(zip(names, f, strict=True)) for f in found])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts, pa.int64()), pa.array(places, pa.list_(pa.int64())), pa.array(base, pa.list_(pa.string())),
                 pa.array(labels, pa.list_(pa.string())), pa.array(notices, pa.list_(pa.struct(fields)))],
                [*batch.schema.names, *new],
            )

    return plain.mapInArrow(run, f"{schema}, n_words long, places array<long>, base_labels array<string>, labels array<string>, notices {SPANS}")


def report(docs: DataFrame) -> DataFrame:
    """n_words, n_base, first_word, last_word, base_labels, labels and score (1 for an exact phrase, else the best similarity) of every document."""
    found = find(docs.select("doc_id", docs["text"].cast("string").alias("text")))
    best = F.coalesce(F.array_max(F.transform("notices", lambda m: m["similarity"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.get("places", F.lit(0)).alias("first_word"), F.get("places", F.size("places") - 1).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"), "notices",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents")).drop("notices")
