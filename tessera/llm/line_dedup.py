"""Line dedup by an exact set-similarity join.

A line's set is its distinct lower-case words. A line goes if an earlier line
(smaller doc_id, or same document and smaller number) has a set of Jaccard
similarity ``threshold`` or more; lines are judged on the input, not on what is
left. Lines of fewer than ``least_tokens`` distinct words are left alone; the
query and the pipeline's stage take lines of every size (``ANY_SIZE``).

Lines of equal sets are first reduced to their earliest one. The others meet
through the prefix filter: tokens are ordered from rare to frequent, and two
similar lines share a token in the first few. Sets so small that one more token
already breaks the threshold (up to three at 0.8) match equal sets only, so they
are settled by the reduction and never meet others. Length, positional and
parity filters drop most meetings before any set is moved:

* length: the smaller set has at least ``threshold`` times the larger one's size;
* position: the tokens after the shared ones must still suffice for the overlap;
* parity: each token flips one of 128 bits, so two sets differ in no more bits than
  in tokens.

Where a token is in the prefixes of more than ``LEAD`` lines, they first meet the
earliest of them, so a family of similar lines never gives all its pairs; then
the lines without a match meet all earlier ones of their tokens. Where a token is
in the prefixes of more than ``GROUP`` lines, such as the words of a passage that
many lines hold, they do so by a second token: among the lines of one first token
any order of the other tokens keeps the prefix filter exact, so the words that the
earliest line does not have come first, and lines that share the passage only do
not meet. Of a line's candidates the likeliest is verified first.
Candidates are verified on the whole sets.

Defined cases: null and empty texts have no lines and stay as they are; rows
with a null id are left as they are; rows that share an id count as one
document: a line number removed in one is removed in all; an empty table gives
an empty result; long texts are handled whole; columns other than ``doc_id``
and ``text`` are passed through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _bytes as B
from ._rarity import levels, ordered_key
from ._spark import fresh, let, small_enough, table, text_column, written

THRESHOLD = 0.8
LEAST_TOKENS = 5
#: The least number of words of a line that has any: no line is left alone.
ANY_SIZE = 1
#: Lines of a prefix token that meet each other directly; those of larger groups meet by a second token.
GROUP = 500
#: In groups of more lines than this all meet the earliest line first.
LEAD = 100
#: Bytes of the map of a line's tokens by which its group's other tokens are told from its own.
MAP = 64
#: Pairs that are compared at once.
PAIRS = 1 << 17
#: Sets of at least so many tokens have 128 parity bits, smaller ones 64.
WIDE = 90


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    data = B.ASCII_LOWER[data]
    start, end, _ = B.spans(data, offsets, B.IS_SPACE)
    return B.span_hash(B.prefix_hash(data), start, end)


def line_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (line, token) pairs of a slice of texts in line order.

    Returns tokens, their place among the lines that have words, and the row
    and the number in its text of each such line.
    """
    data = B.ASCII_LOWER[data]
    start, end, row = B.spans(data, offsets, B.IS_SPACE)
    tokens = B.span_hash(B.prefix_hash(data), start, end)
    feeds = np.concatenate(([0], np.cumsum(data == 10)))
    number = feeds[start] - feeds[offsets[row]]
    new = np.ones(len(start), bool)
    new[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
    place = np.cumsum(new) - 1
    return tokens, place, row[new], number[new]


def ranked_sets(tokens: np.ndarray, place: np.ndarray, key: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of each line in key order, and line offsets into them."""
    order = np.argsort(key)
    line = place[order].astype(np.uint16 if lines < 1 << 16 else np.int64)
    order = order[np.argsort(line, kind="stable")]
    tokens, place = tokens[order], place[order]
    if len(tokens):
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (place[1:] != place[:-1])
        tokens, place = tokens[new], place[new]
    return tokens, np.concatenate(([0], np.cumsum(np.bincount(place, minlength=lines)))).astype(np.int64)


def prefix_length(n: np.ndarray, threshold: float) -> np.ndarray:
    """Tokens of which any similar set must share one: n - ceil(threshold * n) + 1."""
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def matches_equal_only(n: np.ndarray, threshold: float) -> np.ndarray:
    """Sizes whose sets are similar to no other set: one of n + 1 tokens is too far already."""
    return n < threshold * (n + 1) - 1e-9


def short(tokens: np.ndarray) -> np.ndarray:
    """The 32 bits of tokens that prefixes carry."""
    return (tokens >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, table_: np.ndarray, threshold: float, least_tokens: int) -> DataFrame:
    """A row per line with enough tokens: doc_id, line, n, d1, d2 (digests of the set), parity and prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(table_)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for batch in batches:
            for first, last, data, offsets in B.slices(batch["text"]):
                tokens, place, row, number = line_sets(data, offsets)
                tokens, at = ranked_sets(tokens, place, ordered_key(tokens, rarity), len(row))
                n = np.diff(at)
                enough = np.flatnonzero(n >= least_tokens)
                if not len(enough):
                    continue
                mixed = B.mix(tokens)
                d1 = np.add.reduceat(mixed, at[:-1])[enough]
                d2 = np.add.reduceat(B.mix(mixed + np.uint64(1)), at[:-1])[enough]
                bit, word = np.uint64(1) << (mixed >> np.uint64(58)), (mixed & np.uint64(1)).astype(bool)
                parity = [np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), at[:-1])[enough] for k in (False, True)]
                alone = matches_equal_only(n[enough], threshold)
                n = n[enough]
                parity[0] = np.where(n < WIDE, parity[0] ^ parity[1], parity[0])
                parity[1] = np.where(n < WIDE, np.uint64(0), parity[1])
                size = np.where(alone, 0, prefix_length(n, threshold))
                cut = np.concatenate(([0], np.cumsum(size)))
                pick = np.repeat(at[:-1][enough] - cut[:-1], size) + np.arange(cut[-1])
                prefix = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(short(tokens[pick])))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(first, last - first).take(pa.array(row[enough])), pa.array(number[enough].astype(np.int32)), pa.array(n.astype(np.int32)),
                     pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), *(pa.array(p.view(np.int64)) for p in parity), prefix],
                    ["doc_id", "line", "n", "d1", "d2", "p0", "p1", "prefix"],
                )

    return docs.mapInArrow(run, f"doc_id {kind}, line int, n int, d1 long, d2 long, p0 long, p1 long, prefix array<int>")


def packed(at: Column, line: Column, open_: Column) -> Column:
    """A posting's line, its token's place among the line's tokens and a flag, in one long."""
    return F.shiftleft(line.cast("long"), 32) + at.cast("long") * 2 + open_.cast("long")


def line_of(side: str) -> Column:
    return F.shiftright(F.col(f"{side}.m"), 32).cast("int")


def is_open(side: str) -> Column:
    return F.col(f"{side}.m").bitwiseAND(F.lit(1)) == 1


def may_match(x: str, y: str, threshold: float) -> Column:
    """The length, positional and parity filters on two postings."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    ax, ay = (F.shiftright(F.col(f"{s}.m").bitwiseAND(F.lit(0xFFFFFFFF)), 1) for s in (x, y))
    overlap, small = needed(nx, ny, threshold), F.least(nx, ny)
    # the smaller set's prefix is that of sets of its own size or larger
    indexed = F.when(nx <= ny, ax).otherwise(ay) <= small - needed(small, small, threshold)
    position = 1 + F.least(nx - ax - 1, ny - ay - 1) >= overlap
    return indexed & position & close(x, y, threshold)


def needed(nx: Column, ny: Column, threshold: float) -> Column:
    """Tokens that similar sets of these sizes share at least."""
    return F.ceil((nx + ny) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))


def alike(x: str, y: str, threshold: float) -> Column:
    """The length filter, and the parity filter without rounding: ``close`` is never true where this is not."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    in_size = F.least(nx, ny) >= F.greatest(nx, ny) * F.lit(threshold) - F.lit(1e-9)
    return in_size & (apart(x, y) <= (nx + ny) * F.lit((1 - threshold) / (1 + threshold)) + F.lit(1e-6))


def close(x: str, y: str, threshold: float) -> Column:
    """The length and parity filters on two lines."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    return alike(x, y, threshold) & (apart(x, y) <= nx + ny - 2 * needed(nx, ny, threshold))


def apart(x: str, y: str) -> Column:
    """Parity bits that differ: no more than tokens that do."""
    d0, d1 = (F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}")) for p in ("p0", "p1"))
    return F.when(F.least(F.col(f"{x}.n"), F.col(f"{y}.n")) < WIDE, F.bit_count(d0.bitwiseXOR(d1))).otherwise(F.bit_count(d0) + F.bit_count(d1))


def gap(x: str, y: str) -> Column:
    """How far apart two lines seem, for the choice of the likeliest match."""
    return (F.greatest(apart(x, y), F.abs(F.col(f"{x}.n") - F.col(f"{y}.n"))) / (F.col(f"{x}.n") + F.col(f"{y}.n"))).cast("float")


def verified(docs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (y_doc, y_line, x_doc, x_line) whose whole sets have the similarity."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ends = [pairs.select(F.col(f"{e}_doc").alias("doc_id"), F.col(f"{e}_line").alias("line")) for e in "yx"]
    wanted = written(ends[0].union(ends[1]).groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("lines")), "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner = pc.list_parent_indices(batch["lines"]).to_numpy().astype(np.int64)
            asked = (owner << 32) + pc.list_flatten(batch["lines"]).to_numpy()
            for first, last, data, offsets in B.slices(batch["text"]):
                tokens, place, row, number = line_sets(data, offsets)
                low, high = np.searchsorted(owner, (first, last))
                chosen = np.isin(((row + first) << 32) + number, asked[low:high])
                held_ = chosen[place]
                place = (np.cumsum(chosen) - 1)[place[held_]]
                row, number = row[chosen], number[chosen]
                tokens, at = ranked_sets(tokens[held_], place, tokens[held_], len(row))
                found = [tokens[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(row + first)), pa.array(number.astype(np.int32)), pa.array(found, pa.binary())], ["doc_id", "line", "tokens"])

    held = docs.join(small_enough(wanted), "doc_id").mapInArrow(sets, f"doc_id {kind}, line int, tokens binary")
    held = written(held, "sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch["y_tokens"], batch["x_tokens"], strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.intersect1d(a, b, assume_unique=True).size
                keep.append(both >= threshold * (len(a) + len(b) - both) - 1e-9)
            yield batch.select(["y_doc", "y_line", "x_doc", "x_line"]).filter(pa.array(keep, pa.bool_()))

    y = held.select(F.col("doc_id").alias("y_doc"), F.col("line").alias("y_line"), F.col("tokens").alias("y_tokens"))
    x = held.select(F.col("doc_id").alias("x_doc"), F.col("line").alias("x_line"), F.col("tokens").alias("x_tokens"))
    joined = pairs.join(y, ["y_doc", "y_line"]).join(x, ["x_doc", "x_line"]).select("y_doc", "y_line", "x_doc", "x_line", "y_tokens", "x_tokens")
    return joined.mapInArrow(check, f"y_doc {kind}, y_line int, x_doc {kind}, x_line int")


def likeliest(pairs: DataFrame) -> DataFrame:
    """The pair of each y line whose lines seem nearest."""
    y = ["y_doc", "y_line"]
    return written(pairs.groupBy(*y).agg(F.min(F.struct("gap", "x_doc", "x_line")).alias("x")).select(*y, "x.x_doc", "x.x_line"), "likely")


def matched_lines(docs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, line) of the y lines of verified pairs, written."""
    found = verified(docs, pairs, threshold).select(F.col("y_doc").alias("doc_id"), F.col("y_line").alias("line"))
    return written(found.distinct(), "found")


def postings(lines: DataFrame) -> DataFrame:
    """A row for each token of the lines' prefixes: token, doc_id, n, m (line, place and whether ``open``), p0, p1."""
    each = lines.select(F.posexplode("prefix").alias("at", "token"), "doc_id", "line", "n", "p0", "p1", "open")
    return each.select("token", "doc_id", "n", packed(F.col("at"), F.col("line"), F.col("open")).alias("m"), "p0", "p1")


def ends() -> list[Column]:
    return [F.col("y.doc_id").alias("y_doc"), line_of("y").alias("y_line"), F.col("x.doc_id").alias("x_doc"), line_of("x").alias("x_line"), gap("x", "y").alias("gap")]


def x_first() -> Column:
    return (F.col("x.doc_id") < F.col("y.doc_id")) | ((F.col("x.doc_id") == F.col("y.doc_id")) & (line_of("x") < line_of("y")))


def flagged(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with ``open``: whether their lines have no match yet."""
    matched = small_enough(found.withColumn("matched", F.lit(True)))
    return rows.drop("open").join(matched, ["doc_id", "line"], "left").withColumn("open", F.col("matched").isNull()).drop("matched")


def met(posted: DataFrame, threshold: float) -> DataFrame:
    """Pairs of an open line and an earlier one that share a token and may be similar; groups of any size."""
    x, y = posted.alias("x"), posted.alias("y")
    # the filters that cost least and drop most come first
    meet = F.when(is_open("y"), alike("x", "y", threshold) & x_first() & may_match("x", "y", threshold)).otherwise(False)
    return x.join(y, (F.col("x.token") == F.col("y.token")) & meet).select(*ends()).distinct()


def met_by_size(posted: DataFrame, threshold: float) -> DataFrame:
    """The pairs of ``met``, for groups of at most ``GROUP`` postings.

    A group is put in order of size, so a posting is compared only with those
    whose size allows a match, and only if its place is in its indexed prefix.
    Numbers go to Python as one array a row: Spark measures every column of every row.
    """
    kind = posted.schema["doc_id"].dataType.simpleString()
    key = F.shiftleft(F.col("token").cast("long"), 32) + F.col("n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, facts in whole_groups(batches):
            m = facts[1]
            for y, x, gap_ in near_pairs(ordinal(doc), *facts, threshold):
                yield pa.RecordBatch.from_arrays(
                    [doc.take(pa.array(y)), pa.array((m[y] >> 32).astype(np.int32)), doc.take(pa.array(x)), pa.array((m[x] >> 32).astype(np.int32)), pa.array(gap_)],
                    ["y_doc", "y_line", "x_doc", "x_line", "gap"],
                )

    grouped = posted.repartition("token").select("doc_id", key.alias("key"), "m", "p0", "p1").sortWithinPartitions("key").select("doc_id", F.array("key", "m", "p0", "p1").alias("facts"))
    return grouped.mapInArrow(run, f"y_doc {kind}, y_line int, x_doc {kind}, x_line int, gap float").distinct()


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """doc_ids, and a row each of keys, m, p0 and p1, that hold every posting of their tokens; batches come in the order of keys."""
    held: list[tuple[pa.Array, np.ndarray]] = []

    def joined() -> tuple[pa.Array, np.ndarray]:
        return pa.concat_arrays([d for d, _ in held]), np.concatenate([f for _, f in held], axis=1)

    for batch in batches:
        if not batch.num_rows:
            continue
        facts = np.ascontiguousarray(pc.list_flatten(batch["facts"]).to_numpy().reshape(-1, 4).T)
        token = facts[0] >> 32
        if held and held[-1][1][0, -1] >> 32 != token[0]:
            yield joined()
            held = []
        cut = int(np.searchsorted(token, token[-1]))
        if cut:
            held.append((batch["doc_id"].slice(0, cut), facts[:, :cut]))
            yield joined()
            held = []
        held.append((batch["doc_id"].slice(cut), facts[:, cut:]))
    if held:
        yield joined()


def ordinal(column: pa.Array) -> np.ndarray:
    """Integers in the order of the column's values."""
    return column.to_numpy() if pa.types.is_integer(column.type) else pc.rank(column, "ascending", tiebreaker="dense").to_numpy().astype(np.int64)


def near_pairs(doc: np.ndarray, key: np.ndarray, m: np.ndarray, p0: np.ndarray, p1: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(y, x, gap) of the pairs that ``met`` would make of postings in the order of ``key`` (token and size); ``PAIRS`` are compared at once."""
    share = threshold / (1 + threshold)

    def needed_(total: np.ndarray) -> np.ndarray:
        return np.ceil(total * share - 1e-9).astype(np.int64)

    n = key & 0xFFFFFFFF
    p0, p1 = p0.view(np.uint64), p1.view(np.uint64)  # of signed numbers ``bitwise_count`` would take the absolute value
    line, at, open_, folded = m >> 32, (m & 0xFFFFFFFF) >> 1, (m & 1).astype(bool), p0 ^ p1
    # the smaller of two sets shares a token of its indexed prefix; the larger has no more than ``most`` tokens
    most = np.floor((n + 1e-9) / threshold).astype(np.int64)
    here = np.arange(len(n))
    count = np.where(at <= n - needed_(2 * n), np.searchsorted(key, key - n + most, side="right") - here - 1, 0)
    room = np.minimum(np.floor((n + most) * (1 - 2 * share) + 1e-6), 255).astype(np.uint8)
    end = np.cumsum(count)
    first = 0
    while first < len(n):
        before = end[first] - count[first]
        last = max(first + 1, int(np.searchsorted(end, before + PAIRS, side="right")))
        some = slice(first, last)
        # bits that differ after folding are no more than those that differ before
        b = np.arange(end[last - 1] - before) + np.repeat(here[some] + 1 + before - (end[some] - count[some]), count[some])
        likely = np.flatnonzero(np.bitwise_count(np.repeat(folded[some], count[some]) ^ folded[b]) <= np.repeat(room[some], count[some]))
        a, b = np.repeat(here[some], count[some])[likely], b[likely]
        first = last
        total = n[a] + n[b]
        need = needed_(total)
        bits = np.where(n[a] < WIDE, np.bitwise_count(folded[a] ^ folded[b]), np.bitwise_count(p0[a] ^ p0[b]).astype(np.int64) + np.bitwise_count(p1[a] ^ p1[b]))
        back = (doc[a] > doc[b]) | ((doc[a] == doc[b]) & (line[a] > line[b]))
        x, y = np.where(back, b, a), np.where(back, a, b)
        keep = open_[y] & (bits <= total - 2 * need) & (np.minimum(n[a] - at[a], n[b] - at[b]) >= need) & ((doc[a] != doc[b]) | (line[a] != line[b]))
        if keep.any():
            yield y[keep], x[keep], (np.maximum(bits, n[b] - n[a])[keep] / total[keep]).astype(np.float32)


def token_maps(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, line and ``map`` (a bit for each token's hash) of these lines."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = written(lines.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("lines")), "leaders")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, owner, numbers, maps = batch["lines"].to_pylist(), [], [], []
            for first, last, data, offsets in B.slices(batch["text"]):
                tokens, place, row, number = line_sets(data, offsets)
                at = np.searchsorted(place, np.arange(len(row) + 1))
                cut = np.searchsorted(row, np.arange(last - first + 1))
                for k in range(last - first):
                    for i in np.flatnonzero(np.isin(number[cut[k] : cut[k + 1]], lists[first + k])) + cut[k]:
                        bits = np.zeros(8 * MAP, bool)
                        bits[map_bits(tokens[at[i] : at[i + 1]])] = True
                        owner.append(first + k)
                        numbers.append(int(number[i]))
                        maps.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(owner, pa.int64())), pa.array(numbers, pa.int32()), pa.array(maps, pa.binary())], ["doc_id", "line", "map"])

    return docs.join(small_enough(wanted), "doc_id").mapInArrow(run, f"doc_id {kind}, line int, map binary")


def map_bits(tokens: np.ndarray) -> np.ndarray:
    return (B.mix(tokens + np.uint64(7)) % np.uint64(8 * MAP)).astype(np.int64)


def second_tokens(docs: DataFrame, members: DataFrame, table_: np.ndarray, threshold: float) -> DataFrame:
    """Postings of ``members`` (postings with their token's ``map`` and ``open``) by a second token.

    If the token is the first one that two similar lines share, they share another
    one after it; these are taken in the order that ``map`` gives them, and the
    places add up, so all filters on places hold as they are.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(table_)
    fields = ["line", "token", "at", "n", "p0", "p1", "open", "map"]
    at = F.shiftright(F.col("m").bitwiseAND(F.lit(0xFFFFFFFF)), 1).cast("int")
    wanted = members.select("doc_id", F.struct(F.shiftright("m", 32).cast("int").alias("line"), "token", at.alias("at"), "n", "p0", "p1", "open", "map").alias("to"))
    wanted = written(wanted.groupBy("doc_id").agg(F.collect_list("to").alias("to")), "hot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for batch in batches:
            for first, last, data, offsets in B.slices(batch["text"]):
                lists = batch["to"].slice(first, last - first).to_pylist()  # of this slice only: a line may be a member for many tokens
                tokens, place, row, number = line_sets(data, offsets)
                tokens, start = ranked_sets(tokens, place, ordered_key(tokens, rarity), len(row))
                names, bits = short(tokens), map_bits(tokens)
                cut = np.searchsorted(row, np.arange(last - first + 1))
                owner, key, packed_, facts = [], [], [], []
                for k in range(last - first):
                    for to in lists[k]:
                        line, token, at_, n, p0, p1, open_, own = (to[f] for f in fields)
                        i = cut[k] + int(np.searchsorted(number[cut[k] : cut[k + 1]], line))
                        if i == cut[k + 1] or number[i] != line or start[i + 1] - start[i] != n or names[start[i] + at_] != token:
                            continue  # another row of the same id
                        later = np.arange(start[i] + at_ + 1, start[i + 1])
                        known = np.unpackbits(np.frombuffer(own, np.uint8))[bits[later]]
                        count = int(prefix_length(np.array(n), threshold)) - at_
                        later = later[np.argsort(known, kind="stable")][:count]
                        owner.append(np.full(len(later), first + k))
                        key.append(B.mix(tokens[later] + np.array([token & 0xFFFFFFFF], np.uint64) * B.MULTIPLIERS[3]))
                        packed_.append((line << 32) + (at_ + np.arange(len(later))) * 2 + int(open_))
                        facts.append(np.tile(np.array([[n], [p0], [p1]], np.int64), len(later)))
                if owner:
                    n, p0, p1 = np.concatenate(facts, axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(key).view(np.int64)), batch["doc_id"].take(pa.array(np.concatenate(owner))), pa.array(n.astype(np.int32)), pa.array(np.concatenate(packed_).astype(np.int64)), pa.array(p0), pa.array(p1)],
                        ["token", "doc_id", "n", "m", "p0", "p1"],
                    )

    return docs.join(small_enough(wanted), "doc_id").mapInArrow(run, f"token long, doc_id {kind}, n int, m long, p0 long, p1 long")


def later_matches(docs: DataFrame, threshold: float = THRESHOLD, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """(doc_id, line) of every line that has an earlier match."""
    slim = docs.select("doc_id", docs["text"].cast("string").alias("text")).where("doc_id is not null and text is not null")
    rarity = levels(slim, tokens_of)
    lines = written(signatures(slim, rarity, threshold, least_tokens), "lines")

    # lines of equal sets: all but the earliest go
    same = lines.groupBy("d1", "d2").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "line")).alias("f")).where("c > 1").select("d1", "d2", "f")
    few = small_enough(same := written(same, "same"))
    is_repeat = (F.col("f.doc_id") != F.col("doc_id")) | (F.col("f.line") != F.col("line"))
    repeats = lines.select("doc_id", "line", "d1", "d2").join(few, ["d1", "d2"]).where(is_repeat).select("doc_id", "line")
    classes = lines.where(F.size("prefix") > 0).join(few, ["d1", "d2"], "left").where(F.col("f").isNull() | ~is_repeat)
    classes = classes.select("doc_id", "line", "n", "p0", "p1", "prefix")
    if few is same:  # a join by shuffle is made once
        classes = written(classes, "classes")
    unmatched = classes.withColumn("open", F.lit(True))

    # where many lines have a token, each meets the earliest one first; every posting is written once with its group's size and lead
    tokens = postings(unmatched).groupBy("token").agg(F.count("*").alias("c"), F.min("doc_id").alias("lead")).where(F.col("c") > LEAD)
    tokens = written(tokens, "tokens")
    found = []
    if not tokens.isEmpty():
        members = written(postings(unmatched).join(small_enough(tokens), "token", "left"), "postings").where("lead is not null")
        leaders = members.where("doc_id = lead").groupBy("token").agg(F.min(F.struct(F.shiftright("m", 32).cast("int").alias("line"), "doc_id", "m", "n", "p0", "p1")).alias("l"))
        leaders = written(leaders.select("token", "l.*"), "leaders")
        x, y = small_enough(leaders).alias("x"), members.alias("y")
        led = x.join(y, (F.col("x.token") == F.col("y.token")) & x_first() & close("x", "y", threshold)).select(*ends()).distinct()
        found.append(matched_lines(slim, likeliest(led), threshold))
        unmatched = flagged(classes, found[0])

    # the lines without a match meet all earlier lines of their tokens
    hot = tokens.where(F.col("c") > GROUP).select("token")
    some_hot = not hot.isEmpty()
    posted = postings(unmatched)
    pairs = written(met_by_size(posted.join(small_enough(hot), "token", "left_anti") if some_hot else posted, threshold), "pairs")
    likely = likeliest(pairs)
    found.append(matched_lines(slim, likely, threshold))
    key = likely.columns
    rest = pairs.join(small_enough(found[-1]).withColumnsRenamed({"doc_id": "y_doc", "line": "y_line"}), ["y_doc", "y_line"], "left_anti").select(*key).join(likely, key, "left_anti")

    # in the large groups they do so by a second token
    if some_hot:
        open_ = flagged(members.where(F.col("c") > GROUP).withColumn("line", F.shiftright("m", 32).cast("int")), found[0].union(found[1]).distinct())
        maps = leaders.join(small_enough(hot), "token").select("token", "doc_id", "line")
        maps = maps.join(token_maps(slim, maps.select("doc_id", "line").distinct()).groupBy("doc_id", "line").agg(F.min("map").alias("map")), ["doc_id", "line"])
        second = second_tokens(slim, open_.join(small_enough(written(maps.select("token", "map"), "maps")), "token"), rarity, threshold)
        rest = rest.union(met(written(second, "second"), threshold).select(*key)).distinct()
    rest = written(rest, "rest")
    if not rest.isEmpty():
        found.append(matched_lines(slim, rest, threshold))
    for more in found:
        repeats = repeats.union(more)
    return repeats.distinct()


def with_removed(docs: DataFrame, threshold: float = THRESHOLD, least_tokens: int = LEAST_TOKENS) -> tuple[DataFrame, Column]:
    """``docs`` with one more column, the numbers of the lines that go (null: none), and that column."""
    name = fresh(docs, "_removed")
    gone = written(later_matches(docs, threshold, least_tokens).groupBy("doc_id").agg(F.collect_set("line").alias(name)), "removed")
    return docs.join(small_enough(gone), "doc_id", "left"), F.col(name)


def kept_text(text: Column, removed: Column) -> Column:
    """The text without the lines of these numbers."""
    lines = F.split(text, "\n", -1)
    left = let(lines, lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), removed), lambda i: F.get(x, i)))
    return F.when(removed.isNull(), text).otherwise(F.array_join(left, "\n"))


def dedup(docs: DataFrame, threshold: float = THRESHOLD, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """``docs`` without later matches, columns unchanged; a document that loses all its words goes."""
    out, removed = with_removed(docs, threshold, least_tokens)
    out = out.withColumn("text", kept_text(F.col("text"), removed))
    return out.where(removed.isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, removed lines and the SHA-256 of the text that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, removed = with_removed(docs, least_tokens=ANY_SIZE)
    text = text_column(out)
    return out.select(
        "doc_id", (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size(removed), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(kept_text(text, removed), 256).alias("kept_sha256"),
    )


#: DuckDB SQL of the query's rows.
SQL = r"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
b AS (SELECT doc_id, unnest(range(0, len(x))) AS k, unnest(x) AS line FROM a),
s AS (SELECT doc_id, k, list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS s FROM b),
c AS (SELECT doc_id, k, s, len(s) AS n FROM s WHERE len(s) > 0),
t AS (SELECT doc_id, k, n, unnest(s) AS t FROM c),
f AS (SELECT t, count(*) AS f FROM t GROUP BY t),
o AS (SELECT doc_id, k, n, t, row_number() OVER (PARTITION BY doc_id, k ORDER BY f, t) AS place FROM t JOIN f USING (t)),
p AS (SELECT doc_id, k, n, t FROM o WHERE place <= n - ceil(0.8 * n - 1e-9) + 1),
m AS (
  SELECT DISTINCT y.doc_id AS yd, y.k AS yk, x.doc_id AS xd, x.k AS xk FROM p x JOIN p y ON x.t = y.t
  WHERE (x.doc_id < y.doc_id OR (x.doc_id = y.doc_id AND x.k < y.k)) AND least(x.n, y.n) >= 0.8 * greatest(x.n, y.n) - 1e-9),
v AS (
  SELECT DISTINCT yd AS doc_id, yk AS k FROM (
    SELECT yd, yk, len(list_intersect(x.s, y.s)) AS i, x.n + y.n AS n FROM m JOIN c x ON x.doc_id = xd AND x.k = xk JOIN c y ON y.doc_id = yd AND y.k = yk)
  WHERE i >= 0.8 * (n - i) - 1e-9),
g AS (SELECT doc_id, list(k) AS gone FROM v GROUP BY doc_id)
SELECT doc_id, cast(len(x) AS bigint) AS n_lines, cast(coalesce(len(gone), 0) AS bigint) AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(x, lambda e, i: NOT list_contains(gone, i - 1)), chr(10)) END) AS kept_sha256
FROM a LEFT JOIN g USING (doc_id)
"""
