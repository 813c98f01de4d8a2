"""Toxicity: noisy-channel deobfuscation, then a linear score of the restored text.

Obfuscated spans (leetspeak, letters set apart, doubled or drawn-out letters,
separators inside a word) become character lattices: each observed character may stand for itself, for letters
that it imitates, or for nothing (separators, repeated letters), each at a
channel cost. A Viterbi search finds the likeliest letters under a character
bigram language model. Two models are used: one counted over all documents and
one over the toxic words of all documents whose labels may be learned; both restorations
are scored, together with the words that need none. Words that only have a
doubled letter or an inner separator are common in plain text too: of their
restorations, as of neighbouring words joined, learned toxic words are scored.

The score is a linear hinge-loss model over indicators of restored words and
of their beginnings.

Defined cases: null and empty texts have no features and get the bias's score;
long texts are handled whole; repeated rows are scored each; an empty table
gives an empty result; labels with null ids or values are not learned. Columns
other than ``doc_id`` and ``text`` are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes as B
from ._linear import LinearModel, fit_nbsvm, sample_features, scored, training_sample
from ._spark import crc, small_enough, table

#: Number of hashed features.
FEATURES = 1 << 18
#: Labelled rows that the fit takes at most, first in hash order of the ids.
TRAIN_ROWS = 6000
THRESHOLD = 0.7
#: Lengths of the word beginnings that are features, in bytes.
BEGINNINGS = (4, 5, 6)
#: A feature of at least this weight marks a word of the toxic language model.
TOXIC_WEIGHT = 0.25

# What characters imitate. Each is a channel of probability LEET.
IMITATES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou", "#": "h",
}
LEET, DROP_SEPARATOR, DROP_REPEAT, KEEP_SEPARATOR = -1.0, -0.7, -0.5, -4.0

#: States of the language model: a-z, and one for anything else.
STATES, OTHER = 27, 26

_LETTER = B.lookup(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_DIGIT = B.lookup(b"0123456789")
_LEET = B.lookup("".join(IMITATES).encode())
_STATE = np.full(256, OTHER, np.int64)
_STATE[97:123] = np.arange(26)
#: Up to this many letters stand for one character; -1: none.
_CANDIDATES = np.full((256, 5), -1, np.int64)
for _c, _letters in IMITATES.items():
    _CANDIDATES[ord(_c), : len(_letters)] = [ord(x) - 97 for x in _letters]
#: Longer spans are decoded in pieces of this width, from every state, and the pieces put together: the same best path.
PIECE = 64
#: Lattice columns, of all rows, that are decoded at once; a single longer span is decoded alone.
CELLS = 1 << 17
#: Bytes of decoded spans that a task keeps for spans that come again.
HELD_BYTES = 1 << 23


@dataclass(frozen=True)
class Channel:
    """Log probabilities of a letter after a letter, under both language models; what marks toxic words.

    ``marks`` are the hashes of the learned toxic words and beginnings in
    ascending order, ``longest`` is the length of the longest such word.
    ``parts`` and ``heads`` are the hashes of the skeletons of all parts of these
    words and of all beginnings: without one of them a word cannot be restored to
    a learned one, or to a part of it.
    """

    models: tuple[np.ndarray, ...]
    marks: np.ndarray | None = None
    longest: int = 0
    parts: np.ndarray | None = None
    heads: np.ndarray | None = None


def log_bigrams(counts: np.ndarray) -> np.ndarray:
    smooth = counts.astype(float) + 0.05
    return np.log(smooth / smooth.sum(axis=1, keepdims=True))


def forward(spans: np.ndarray, lengths: np.ndarray, before: np.ndarray, score: np.ndarray, model: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best scores of all rows' last states from the scores of their first, with the steps taken.

    ``spans`` are lower-case bytes, padded with 0, ``before`` is the byte before
    each row (0: none) and ``model`` the row's language model, of the stack
    ``logp``. All rows advance together; the state is the last letter read.
    """
    n, width = spans.shape
    back = np.empty((width, n, STATES), np.int8)
    emitted = np.empty((width, n, STATES), bool)
    states = np.broadcast_to(np.arange(STATES, dtype=np.int8), (n, STATES))
    columns = logp.transpose(0, 2, 1).copy()
    every = np.arange(n)

    def read_as(rows: np.ndarray, target: np.ndarray, cost: np.ndarray | float) -> None:
        paths = score[rows] + columns[model[rows], target]
        best = paths.argmax(axis=1)
        value = paths[np.arange(len(rows)), best] + cost
        better = value > new[rows, target]
        rows, target = rows[better], target[better]
        new[rows, target], came[rows, target], read[rows, target] = value[better], best[better], True

    for i in range(width):
        c = spans[:, i].astype(np.int64)
        state, live = _STATE[c], i < lengths
        letter = state < OTHER
        repeated = letter & (c == (spans[:, i - 1] if i else before))
        drop = np.where(letter, np.where(repeated, DROP_REPEAT, -1e9), DROP_SEPARATOR)
        drop = np.where(live, drop, 0.0)
        new, came, read = score + drop[:, None], states.copy(), np.zeros((n, STATES), bool)
        rows = every if live.all() else np.flatnonzero(live)
        read_as(rows, state[rows], np.where(letter[rows], 0.0, KEEP_SEPARATOR))
        leet = rows[_LEET[c[rows]]]
        for k in range(_CANDIDATES.shape[1] if len(leet) else 0):
            leet = leet[_CANDIDATES[c[leet], k] >= 0]
            if not len(leet):
                break
            read_as(leet, _CANDIDATES[c[leet], k], LEET)
        score, back[i], emitted[i] = new, came, read
    return score, back, emitted


def backward(at: np.ndarray, back: np.ndarray, emitted: np.ndarray) -> np.ndarray:
    """The letters of the paths that end in the states ``at``: 0 for nothing, a blank for OTHER."""
    width, n, _ = back.shape
    out, rows = np.zeros((n, width), np.uint8), np.arange(n)
    for i in range(width - 1, -1, -1):
        was = emitted[i, rows, at]
        out[:, i] = np.where(was, np.where(at < OTHER, at + 97, 32), 0)
        at = np.where(was, back[i, rows, at], at)
    return out


def start_score(n: int) -> np.ndarray:
    score = np.full((n, STATES), -1e9)
    score[:, OTHER] = 0.0
    return score


def viterbi(spans: np.ndarray, lengths: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Decode rows of ``spans`` (lower-case bytes, padded with 0) by each model of ``logp``: restored letters, 0 for nothing."""
    n, models = len(spans), len(logp)
    spans, lengths = np.tile(spans, (models, 1)), np.tile(lengths, models)
    score, back, emitted = forward(spans, lengths, np.zeros(len(spans), np.int64), start_score(len(spans)), np.repeat(np.arange(models), n), logp)
    return backward(score.argmax(axis=1), back, emitted).reshape(models, n, -1)


def viterbi_long(span: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Decode one long span by one model: pieces from every first state side by side, then the best way through the pieces."""
    count = -(-len(span) // PIECE)
    pieces = np.zeros(count * PIECE, np.uint8)
    pieces[: len(span)] = span
    pieces = pieces.reshape(count, PIECE)
    lengths = np.full(count, PIECE)
    lengths[-1] = len(span) - (count - 1) * PIECE
    before = np.concatenate(([0], pieces[:-1, -1])).astype(np.int64)
    first = np.where(np.eye(STATES, dtype=bool), 0.0, -1e9)
    step = max(1, CELLS // (PIECE * STATES))

    def steps(rows: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return forward(pieces[rows], lengths[rows], before[rows], score, np.zeros(len(rows), np.int64), logp[None])

    # way[k, s, e]: the best score through piece k from state s to state e
    way = np.concatenate([
        steps(np.repeat(np.arange(a, min(a + step, count)), STATES), np.tile(first, (min(step, count - a), 1)))[0].reshape(-1, STATES, STATES) for a in range(0, count, step)
    ])
    total, came = start_score(1)[0], np.empty((count, STATES), np.int64)
    for k in range(count):
        paths = total[:, None] + way[k]
        came[k] = paths.argmax(axis=0)
        total = paths.max(axis=0)
        total -= total.max()
    ends = np.empty(count, np.int64)
    at = int(total.argmax())
    for k in range(count - 1, -1, -1):
        ends[k] = at
        at = came[k, at]
    starts = np.concatenate(([OTHER], ends[:-1]))
    out = []
    for a in range(0, count, step * STATES):
        rows = np.arange(a, min(a + step * STATES, count))
        out.append(backward(ends[rows], *steps(rows, first[starts[rows]])[1:]))
    return np.concatenate(out).ravel()[: len(span)]


def suspicious(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans that need restoring: (start, end, row, is a word of its own, is surely obfuscated).

    A word is surely obfuscated if characters that may imitate letters stand
    beside letters, if a letter stands three times in a row, or if separators
    part single letters; it may be if a letter is doubled or anything but a
    letter stands between letters. Three or more one-character words in a row
    are one span.
    """
    none = np.empty(0, np.int64)
    if not len(start):
        return none, none, none, none.astype(bool), none.astype(bool)
    letter = _LETTER[data]

    def within(marks: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(marks)))
        return (sums[end] - sums[start]) > 0

    leet = _LEET[data]
    beside = np.zeros(len(data), bool)
    beside[1:] |= leet[1:] & letter[:-1]
    beside[:-1] |= leet[:-1] & letter[1:]
    thrice = np.zeros(len(data), bool)
    thrice[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (data[2:] < 128)
    apart = np.zeros(len(data), bool)
    apart[2:-2] = letter[:-4] & ~letter[1:-3] & letter[2:-2] & ~letter[3:-1] & letter[4:]
    apart[2:-2] &= ~B.IS_SPACE[data[1:-3]] & ~B.IS_SPACE[data[3:-1]]
    sure = within(beside) | within(thrice) | within(apart)
    twice = np.zeros(len(data), bool)
    twice[1:] = letter[1:] & (data[1:] == data[:-1]) & (data[1:] < 128)
    twice[start] = False
    # a letter, then none, then a letter again: more than one run of letters in the word
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    begins[start] = letter[start]
    runs = np.concatenate(([0], np.cumsum(begins)))
    odd = sure | within(twice) | (runs[end] - runs[start] > 1)
    short = (end - start <= 2) & within(letter | leet)
    run = np.zeros(len(start), np.int64)
    change = np.flatnonzero(np.concatenate(([True], (short[1:] != short[:-1]) | (row[1:] != row[:-1]))))
    size = np.diff(np.append(change, len(start)))
    long_run = short[change] & (size >= 3)
    run = np.repeat(long_run, size)
    odd &= ~run
    first, last = change[long_run], change[long_run] + size[long_run] - 1
    return (
        np.concatenate((start[odd], start[first])), np.concatenate((end[odd], end[last])), np.concatenate((row[odd], row[first])),
        np.concatenate((np.ones(int(odd.sum()), bool), np.zeros(len(first), bool))),
        np.concatenate((sure[odd], np.ones(len(first), bool))),
    )


def trimmed(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words without the characters before their first and after their last letter; none without letters."""
    letter = _LETTER[data]
    where = np.flatnonzero(letter)
    a, b = np.searchsorted(where, start), np.searchsorted(where, end) - 1
    some = a <= b
    return where[a[some]], where[b[some]] + 1, row[some]


def word_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and of their beginnings, from the text's running sums; first those of the words."""
    hashes, rows = [B.span_hash(sums, start, end)], [row]
    for n in BEGINNINGS:
        has = end - start > n
        hashes.append(B.mix(B.span_hash(sums, start[has], start[has] + n) + np.uint64(n)))
        rows.append(row[has])
    return np.concatenate(hashes), np.concatenate(rows)


def ids_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 18)).astype(np.int64)


def word_features(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words and of their beginnings."""
    hashes, rows = word_hashes(B.prefix_hash(data), start, end, row)
    return ids_of(hashes), rows


def marked(hashes: np.ndarray, rows: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and rows of the hashes that are among the marks."""
    at = np.minimum(np.searchsorted(marks, hashes), len(marks) - 1)
    found = marks[at] == hashes
    return ids_of(hashes[found]), rows[found]


def toxic_joins(data: np.ndarray, words: tuple[np.ndarray, np.ndarray, np.ndarray], channel: Channel, near: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Learned toxic words that the letters of neighbouring words make together, and toxic words and beginnings in one word.

    Any number of neighbours counts up to the longest learned word's letters, so
    a word is found wherever it was cut and whatever stands before and after it.
    ``near`` are byte ranges: only words that lie in one or might join with one
    that does are looked at.
    """
    none = np.empty(0, np.int64)
    if channel.marks is None or not len(channel.marks):
        return none, none
    start, end, row = words
    letter = _LETTER[data]
    before = np.zeros(len(data) + 1, np.int32)
    np.cumsum(letter, out=before[1:])
    first, last = before[start], before[end]
    some = first < last
    if near is not None:
        a, b = np.searchsorted(last, before[near[0]] - channel.longest), np.searchsorted(first, before[near[1]] + channel.longest, side="right")
        inside = np.zeros(len(first) + 1, np.int32)
        np.add.at(inside, a, 1)
        np.add.at(inside, np.maximum(a, b), -1)
        some &= np.cumsum(inside[:-1]) > 0
    first, last, row = first[some], last[some], row[some]
    text = data[letter]
    sums = B.prefix_hash(text)
    ids, rows = marked(*word_hashes(sums, first, last, row), channel.marks)
    ids, rows = [ids], [rows]
    i = np.arange(len(first))
    for k in range(1, channel.longest):
        i = i[: np.searchsorted(i, len(first) - k)]
        i = i[(row[i] == row[i + k]) & (last[i + k] - first[i] <= channel.longest)]
        if not len(i):
            break
        got, owner = marked(B.span_hash(sums, first[i], last[i + k]), row[i], channel.marks)
        ids.append(got)
        rows.append(owner)
    return np.concatenate(ids), np.concatenate(rows)


def decode(spans: list[bytes], models: tuple[np.ndarray, ...]) -> list[tuple[bytes, ...]]:
    """Decodes of the whole spans by each model, byte for byte (0: dropped)."""
    logp = np.stack(models)
    out: list[tuple[bytes, ...]] = [()] * len(spans)
    order = sorted(range(len(spans)), key=lambda i: len(spans[i]))
    while order and len(spans[order[-1]]) > 2 * PIECE:
        i = order.pop()
        span = np.frombuffer(spans[i], np.uint8)
        out[i] = tuple(viterbi_long(span, p).tobytes() for p in models)
    step = max(1, CELLS // (2 * PIECE * len(models)))
    for part in (order[x : x + step] for x in range(0, len(order), step)):
        size = np.array([len(spans[i]) for i in part])
        matrix = np.zeros((len(part), max(1, int(size.max()))), np.uint8)
        row = np.repeat(np.arange(len(part)), size)
        matrix[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.frombuffer(b"".join([spans[i] for i in part]), np.uint8)
        found = viterbi(matrix, size, logp)
        for k, (i, n) in enumerate(zip(part, size, strict=True)):
            out[i] = tuple(f[k, :n].tobytes() for f in found)
    return out


class Decoder:
    """Decodes spans; those of a task that come again are decoded once."""

    def __init__(self, models: tuple[np.ndarray, ...]):
        self.models, self.held, self.bytes = models, {}, 0

    def __call__(self, spans: list[bytes]) -> list[tuple[bytes, ...]]:
        new = {x for x in spans if x not in self.held}
        size = sum(map(len, new))
        if self.bytes + size > HELD_BYTES:
            self.held.clear()
            self.bytes, new = 0, set(spans)
            size = sum(map(len, new))
        new = sorted(new)
        self.held.update(zip(new, decode(new, self.models), strict=True))
        self.bytes += size
        return [self.held[x] for x in spans]


def restored(data: np.ndarray, spans: tuple[np.ndarray, ...], decoder: Decoder) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each model: bytes of the decodes of all spans, their offsets, and ``data`` with the decodes in place (0: dropped)."""
    start, end = spans[:2]
    lengths = end - start
    first = np.cumsum(lengths) - lengths
    place = np.repeat(start - first, lengths) + np.arange(int(lengths.sum()))
    text = data.tobytes()
    decodes = decoder([text[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    for m in range(len(decoder.models)):
        flat = np.frombuffer(b"".join([x[m] for x in decodes]), np.uint8)
        filled = flat > 0
        count = np.concatenate(([0], np.cumsum(filled)))
        whole = data.copy()
        whole[place] = flat
        yield flat[filled], count[np.append(first, len(flat))], whole


def skeleton(word: bytes) -> bytes:
    """A word's letters a-z without repeats in a row."""
    out = bytearray()
    for c in word:
        if 97 <= c <= 122 and (not out or out[-1] != c):
            out.append(c)
    return bytes(out)


def skeleton_hashes(words: Iterable[bytes]) -> np.ndarray:
    words = list(words)
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words], dtype=np.int64)
    return np.unique(B.span_hash(B.prefix_hash(data), end - [len(w) for w in words], end)) if words else np.empty(0, np.uint64)


def hopeful(data: np.ndarray, spans: tuple[np.ndarray, ...], channel: Channel) -> tuple[np.ndarray, ...]:
    """The spans that are surely obfuscated, or might be part of a learned toxic word or begin with its beginning.

    Without characters that imitate letters, restoring drops repeats and
    separators only, so a span's skeleton tells which words it may become.
    """
    if channel.parts is None:
        return spans
    start, end, _, _, sure = spans
    leet = np.concatenate(([0], np.cumsum(_LEET[data])))
    ask = np.flatnonzero(~sure & (leet[end] == leet[start]))
    if not len(ask):
        return spans
    plain = (data >= 97) & (data <= 122)
    size = end[ask] - start[ask]
    at = np.repeat(start[ask] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    who = np.repeat(np.arange(len(ask)), size)[plain[at]]
    text = data[at[plain[at]]]
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != text[:-1]) | (who[1:] != who[:-1])
    text, who = text[keep], who[keep]
    a, b = np.searchsorted(who, np.arange(len(ask))), np.searchsorted(who, np.arange(len(ask)), side="right")
    sums = B.prefix_hash(text)
    good = np.isin(B.span_hash(sums, a, b), channel.parts)
    for n in range(1, BEGINNINGS[-1] + 1):
        some = np.flatnonzero(~good & (b - a >= n))
        good[some] |= np.isin(B.span_hash(sums, a[some], a[some] + n), channel.heads)
    drop = np.zeros(len(start), bool)
    drop[ask[~good]] = True
    return tuple(x[~drop] for x in spans)


def kept_unsure(data: np.ndarray, whole: np.ndarray, spans: tuple[np.ndarray, ...]) -> np.ndarray:
    """``whole`` with the spans that are not surely obfuscated as they are in ``data``."""
    start, end = (x[~spans[4]] for x in spans[:2])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    return np.where(np.cumsum(inside[:-1], dtype=np.int8) > 0, data, whole)


def features_of(channel: Channel):
    """The feature function of texts, with obfuscated spans restored through ``channel``."""
    decoder = Decoder(channel.models)

    def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = B.ASCII_LOWER[data]
        start, end, row = words = B.spans(data, offsets, B.IS_SPACE)
        found = [word_features(data, *trimmed(data, *words)), toxic_joins(data, words, channel)]
        odd = hopeful(data, suspicious(data, *words), channel)
        for text, at, whole in restored(data, odd, decoder) if channel.models and len(odd[0]) else ():
            a, b, span = B.spans(text, at, B.IS_SPACE)
            sure = odd[4][span]
            a, b, span = a[sure], b[sure], span[sure]
            loose = ~odd[3][span]
            if loose.any():  # letters set apart: a word may begin at each letter
                size = b[loose] - a[loose]
                more = np.repeat(a[loose] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                a, b, span = np.concatenate((a, more)), np.concatenate((b, np.repeat(b[loose], size))), np.concatenate((span, np.repeat(span[loose], size)))
            found.append(word_features(text, a, b, odd[2][span]))
            for seen in (whole, kept_unsure(data, whole, odd)):  # a doubled letter may be meant
                found.append(toxic_joins(seen, words, channel, odd[:2]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    return features


def letter_pairs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of letter after letter within a slice of texts; texts begin and end with OTHER."""
    state = _STATE[B.ASCII_LOWER[data]]
    if len(state) < 2:
        return np.zeros((STATES, STATES), np.int64)
    left, right = state[:-1].copy(), state[1:]
    cut = offsets[1:-1]
    left[cut[(cut > 0) & (cut < len(state))] - 1] = OTHER
    return np.bincount(left * STATES + right, minlength=STATES * STATES).reshape(STATES, STATES)


def corpus_pairs(docs: DataFrame) -> np.ndarray:
    """Letter pair counts of all documents; each task sends one row per letter at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((STATES, STATES), np.int64)
        for batch in batches:
            for _, _, data, offsets in B.slices(batch["text"]):
                total += letter_pairs(data, offsets)
        a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])], ["a", "b", "n"])

    pairs = docs.select(docs["text"].cast("string").alias("text")).mapInArrow(run, "a int, b int, n long")
    out = np.zeros((STATES, STATES), np.int64)
    for r in pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).collect():  # 27 x 27 rows at most
        out[r["a"], r["b"]] = r["n"]
    return out


def toxic_pairs(docs: DataFrame, model: LinearModel) -> np.ndarray:
    """Letter pair counts of the words in ``docs`` that the model finds toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value.weights
        total = np.zeros((STATES, STATES), np.int64)
        for batch in batches:
            for _, _, data, offsets in B.slices(batch["text"]):
                data = B.ASCII_LOWER[data]
                start, end, row = trimmed(data, *B.spans(data, offsets, B.IS_SPACE))
                ids, _ = word_features(data, start, end, np.arange(len(start)))
                toxic = weights[ids[: len(start)]] >= TOXIC_WEIGHT
                start, end = start[toxic], end[toxic]
                text = b" ".join(data[a:b].tobytes() for a, b in zip(start, end, strict=True))
                total += letter_pairs(np.frombuffer(b" " + text + b" ", np.uint8), np.array([0, len(text) + 2]))
        a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])], ["a", "b", "n"])

    out = np.zeros((STATES, STATES), np.int64)
    for r in docs.select("text").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        out[r["a"], r["b"]] = r["n"]
    return out


def toxic_words(sample: DataFrame, model: LinearModel) -> tuple[list[bytes], list[bytes]]:
    """The words, and the beginnings, in the sample that the model finds toxic."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value.weights
        for batch in batches:
            for _, _, data, offsets in B.slices(batch["text"]):
                data = B.ASCII_LOWER[data]
                start, end, row = trimmed(data, *B.spans(data, offsets, B.IS_SPACE))
                hashes, at = word_hashes(B.prefix_hash(data), start, end, np.arange(len(start)))
                stop = np.concatenate([end, *(start[end - start > n] + n for n in BEGINNINGS)])
                _, which = np.unique(hashes, return_index=True)
                which = which[weights[ids_of(hashes[which])] >= TOXIC_WEIGHT]
                text = data.tobytes()
                words = [text[start[at[i]] : stop[i]] for i in which]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(which < len(start))], ["word", "whole"])

    got = sample.where("y > 0").select("text").mapInArrow(run, "word binary, whole boolean").distinct().collect()  # of a bounded sample
    return sorted({bytes(r["word"]) for r in got if r["whole"]}), sorted({bytes(r["word"]) for r in got if not r["whole"]})


def with_marks(models: tuple[np.ndarray, ...], words: list[bytes], beginnings: list[bytes]) -> Channel:
    """The channel that looks for these words and beginnings."""
    whole = np.frombuffer(b"".join(words + beginnings), np.uint8)
    size = np.array([len(w) for w in words + beginnings], np.int64)
    end = np.cumsum(size)
    hashes = B.span_hash(B.prefix_hash(whole), end - size, end)
    for n in BEGINNINGS:  # as ``word_hashes`` has them
        some = np.flatnonzero((size == n) & (np.arange(len(size)) >= len(words)))
        hashes[some] = B.mix(hashes[some] + np.uint64(n))
    bare = {skeleton(w) for w in words}
    parts = {w[i:j] for w in bare for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    return Channel(models, np.unique(hashes), max(map(len, words), default=0), skeleton_hashes(parts), skeleton_hashes({skeleton(w) for w in beginnings} - {b""}))


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learned: crc32 of the id's text modulo 3 is not 1."""
    return crc(doc_id) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", train_rows: int = TRAIN_ROWS) -> tuple[Channel, LinearModel]:
    """The channel's language models and the score's weights."""
    sample = training_sample(docs, labels, label, learnable(F.col("doc_id")), train_rows).persist()
    rows, y = sample_features(sample, features_of(Channel(())), FEATURES)
    plain = fit_nbsvm(rows, y, FEATURES, cost=1.0, least_documents=2)
    words = toxic_words(sample, plain)
    sample.unpersist()
    marked_docs = labels.where(learnable(F.col("doc_id")) & (F.col(label).cast("int") > 0)).select("doc_id").distinct()
    every = docs.select("doc_id", docs["text"].cast("string").alias("text")).join(small_enough(marked_docs), "doc_id", "left_semi")
    return with_marks((log_bigrams(corpus_pairs(docs)), log_bigrams(toxic_pairs(every, plain))), *words), plain


def score(docs: DataFrame, channel: Channel, model: LinearModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    held_out = F.coalesce(~learnable(docs["doc_id"]), F.lit(False))
    return scored(docs, features_of(channel), model, held_out, threshold)


def restore(text: str, channel: Channel) -> list[str]:
    """A text's restorations, one for each language model: obfuscated spans replaced."""
    data = B.ASCII_LOWER[np.frombuffer(text.encode(), np.uint8)]
    offsets = np.array([0, len(data)])
    odd = suspicious(data, *B.spans(data, offsets, B.IS_SPACE))
    out = []
    for decoded, at, _ in restored(data, odd, Decoder(channel.models)):
        parts, last = [], 0
        for k in np.argsort(odd[0]):
            parts += [data[last : odd[0][k]].tobytes(), decoded[at[k] : at[k + 1]].tobytes()]
            last = odd[1][k]
        out.append(b"".join([*parts, data[last:].tobytes()]).decode(errors="replace"))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    channel, model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, channel, model)
