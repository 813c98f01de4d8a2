"""Offset-mapped token counts: each document is encoded once, as a whole, and its
tokens are attributed to sections by their spans.

With a byte-level vocabulary a token's bytes are known, so running sums of token
lengths give exact spans without decoding. Sections are character ranges; they
are mapped to the same byte scale and joined to the tokens by binary search on
the sorted span ends, so a document costs its tokens plus its sections. The join
is local to a document: nothing is shuffled.

A token that crosses a section's edge is allocated by one of these rules:
``first``: to the section that holds its first byte; ``last``: its last byte;
``share``: to every section it overlaps, in proportion to the bytes.
Sections may overlap or leave gaps; each is counted by itself.

Defined cases: a null or empty text has one empty section with 0 tokens (by
lines) or the given sections with 0 tokens; null sections are skipped; ranges
are cut to the text; long texts, unbroken or blank ones too, are encoded whole;
repeated rows are counted each; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from ._spark import table

#: Vocabulary file of the query; every task reads it by this path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's pattern for pieces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
RULES = ("first", "last", "share")
#: White space (Unicode's) that is cut out as a piece of its own if its run is longer; the pattern's
#: lookahead steps back through a run, which a run of a million characters does not survive.
LONG_BLANK = re.compile("[\\t-\\r \\x85\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding, and the length in bytes of each token."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    lengths[list(ranks.values())] = [len(k) for k in ranks]
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def encoded(text: str, coder: tiktoken.Encoding) -> list[int]:
    """The tokens of the whole text.

    A long run of white space is one piece of the pattern but for its last
    character, which goes with what follows, if anything does; so the text may be
    cut there and the pieces encoded one by one.
    """
    out, last = [], 0
    for run in LONG_BLANK.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += coder.encode_ordinary(text[last : run.start()])
        out += coder._encode_single_piece(text[run.start() : end])
        last = end
    return out + coder.encode_ordinary(text[last:]) if last else coder.encode_ordinary(text)


def token_ends(text: str, path: str = VOCABULARY) -> np.ndarray:
    """Byte offsets where the tokens of the text end."""
    coder, lengths = encoder(path)
    return np.cumsum(lengths[np.asarray(encoded(text, coder), dtype=np.int64)])


def line_ranges(data: bytes) -> np.ndarray:
    """Byte ranges of the lines, each with its line feed."""
    cuts = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    edges = np.unique(np.concatenate(([0], cuts, [len(data)])))
    return np.stack((edges[:-1], edges[1:]), axis=1) if len(edges) > 1 else np.array([[0, 0]])


def allocate(ends: np.ndarray, ranges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each byte range; crossing tokens overlap it in part."""
    if not len(ends):
        return np.zeros(len(ranges)), np.zeros(len(ranges), np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    a, b = ranges[:, 0], ranges[:, 1]
    some = a < b
    first, last = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left") - 1  # tokens that overlap [a, b)
    n = np.where(some, last - first + 1, 0)
    left, right = np.minimum(first, len(ends) - 1), np.clip(last, 0, len(ends) - 1)
    cross_left, cross_right = some & (starts[left] < a), some & (ends[right] > b)
    crossing = cross_left.astype(np.int64) + cross_right - (cross_left & cross_right & (left == right))
    if rule == "first":
        tokens = n - cross_left
    elif rule == "last":
        tokens = n - cross_right
    else:
        size = (ends - starts).astype(float)
        outside = np.where(cross_left, (a - starts[left]) / size[left], 0.0) + np.where(cross_right, (ends[right] - b) / size[right], 0.0)
        tokens = n - outside
    return np.where(some, tokens, 0), crossing


def byte_ranges(data: bytes, sections: list[tuple[int, int]]) -> np.ndarray:
    """Character ranges as byte ranges of the text, cut to it."""
    at = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))
    ranges = np.clip(np.array(sections, np.int64).reshape(-1, 2), 0, len(at) - 1)
    return at[np.maximum(ranges, ranges[:, :1])]


def attribute(docs: DataFrame, sections: str | None = None, rule: str = "first", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document and section: doc_id, section (number), start and length in bytes, n_tokens, n_crossing, doc_tokens.

    ``sections`` names a column array<struct<start, end>> of character ranges;
    without it, sections are the text's lines.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                texts = part["text"].to_pylist()
                given = part["sections"].to_pylist() if sections else None
                owner, number, spans, tokens, crossing, total = [], [], [], [], [], []
                for k, text in enumerate(texts):
                    data = (text or "").encode()
                    ranges = line_ranges(data) if given is None else byte_ranges(data, [(s["start"], s["end"]) for s in given[k] or [] if s and s["start"] is not None and s["end"] is not None])
                    ends = token_ends(text, vocabulary) if text else np.empty(0, np.int64)
                    n, crossed = allocate(ends, ranges, rule)
                    owner.append(np.full(len(ranges), k))
                    number.append(np.arange(len(ranges)))
                    spans.append(ranges)
                    tokens.append(n)
                    crossing.append(crossed)
                    total.append(np.full(len(ranges), len(ends)))
                ranges = np.concatenate(spans)
                n = np.concatenate(tokens)
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"].take(pa.array(np.concatenate(owner))), pa.array(np.concatenate(number).astype(np.int64)), pa.array(ranges[:, 0]),
                        pa.array(ranges[:, 1] - ranges[:, 0]), pa.array(n.astype(float) if rule == "share" else n.astype(np.int64)),
                        pa.array(np.concatenate(crossing).astype(np.int64)), pa.array(np.concatenate(total).astype(np.int64)),
                    ],
                    ["doc_id", "section", "start", "n_bytes", "n_tokens", "n_crossing", "doc_tokens"],
                )

    columns = [docs["doc_id"], docs["text"].cast("string").alias("text"), *([docs[sections].alias("sections")] if sections else [])]
    counted = "double" if rule == "share" else "long"
    return docs.select(*columns).mapInArrow(run, f"doc_id {kind}, section long, start long, n_bytes long, n_tokens {counted}, n_crossing long, doc_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute(table(spark, sf_dir, "documents"))
