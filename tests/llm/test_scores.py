"""The quality rules, the quality classifier and the toxicity score against plain Python on the smallest tables."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import regex

from tests.llm.conftest import SCHEMA
from tessera.llm import _bytes as B
from tessera.llm import _linear, quality_classifier, quality_rules, toxicity

SMALL = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1
WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def rows_of(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/{name}.parquet").select(*columns).collect()]


# --- quality rules ---


def classes(text):
    out = [0] * (len(quality_rules.CLASSES) + 1)
    sets = [regex.compile(f"[{c}]") for c in quality_rules.CLASSES]
    for ch in text:
        out[next((i for i, s in enumerate(sets) if s.match(ch)), len(sets))] += 1
    return out


def common(text, lang, n_words):
    words = quality_rules.COMMON_WORDS.get(lang)
    if words is None:
        return [0] * 16 + [n_words]
    found = Counter(regex.findall(r"(?<!\p{L})(" + "|".join(words) + r")(?!\p{L})", text.lower()))
    each = [found[w] for w in words]
    return [*each, max(0, n_words - sum(each))]


def distance(p, q):
    if not sum(p) or not sum(q):
        return None
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    part = lambda a, m: a * math.log2(a / m) if a else 0.0
    return math.sqrt(max(0.0, sum(part(a, (a + b) / 2) + part(b, (a + b) / 2) for a, b in zip(p, q, strict=True)) / 2))


def test_quality_rules(spark):
    docs = rows_of(spark, "documents", "doc_id", "text", "lang") + [(9001, None, "en"), (9002, "some words " * 60, None), (9003, "Some other words, " * 40, "xx"), (9003, "Some other words, " * 40, "xx"), (9004, "", None)]
    shaped = []
    for _, text, lang in docs:
        t, known = text or "", lang if lang in quality_rules.COMMON_WORDS else "any"
        n = len(WORD.findall(t))
        shaped.append((known, n, t, classes(t), common(t, known, n)))
    total = {}
    for known, _, _, c, w in shaped:
        for key in {known, "any"}:
            have = total.setdefault(key, ([0] * len(c), [0] * len(w)))
            total[key] = tuple([a + b for a, b in zip(x, y, strict=True)] for x, y in zip(have, (c, w), strict=True))
    expected = []
    for (i, _, _), (known, n, t, c, w) in zip(docs, shaped, strict=True):
        cd = distance(c, total[known][0]) if len(t) >= 200 else None
        wd = distance(w, total[known][1]) if n >= 50 and known != "any" else None
        expected.append((i, cd, wd, (cd or 0.0) <= quality_rules.MOST_CHAR_DISTANCE and (wd or 0.0) <= quality_rules.MOST_WORD_DISTANCE))
    frame = spark.createDataFrame([(i, t, x, "s", 1, 1, 1, 0.5, 1, "h", "r", "c", "k", "p") for i, t, x in docs], SCHEMA)
    got = sorted((r.doc_id, r.char_distance, r.word_distance, r.base_failed, r.kept) for r in quality_rules.judge(frame).collect())
    assert len(got) == len(docs) and {g[4] for g in got} == {True, False}
    for (i, cd, wd, failed, kept), (j, ecd, ewd, near) in zip(got, sorted(expected, key=lambda x: x[0]), strict=True):
        assert i == j and kept == (near and not failed)
        for a, b in ((cd, ecd), (wd, ewd)):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)


# --- linear scores ---


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def word_hash(word):
    total = sum(int(B.ALPHABET[b]) * pow(B.BASE, k, 1 << 64) for k, b in enumerate(word))
    return mix((total + len(word)) & MASK)


def quality_features(text):
    data = (text or "").encode()
    words = [w.encode() for w in WORD.findall(text or "")]
    out = {(int.from_bytes(data[k : k + 3], "little") * 2654435761 & 0xFFFFFFFF) >> 16 for k in range(len(data) - 2)}
    out |= {word_hash(w) >> 48 for w in words}
    return out | ({1} if any(a == b for a, b in zip(words, words[1:], strict=False)) else set())


def plain_fit(features, labels, size, cost):
    """Log-count ratios, then one dual variable at a time, written out over Python sets."""
    count = Counter(j for f in features for j in f)
    rows = [sorted(j for j in f if count[j] >= 2) for f in features]
    n = [sum(y == c for y in labels) + 2 for c in (0, 1)]
    seen = [Counter(j for r, y in zip(rows, labels, strict=True) if y == c for j in r) for c in (0, 1)]
    ratio = lambda j: math.log((seen[1][j] + 1) / n[1]) - math.log((seen[0][j] + 1) / n[0])
    scale = {j: ratio(j) for r in rows for j in r}
    w, b, alpha = dict.fromkeys(scale, 0.0), 0.0, [0.0] * len(rows)
    order = np.random.default_rng(1)
    for _ in range(30):
        worst = 0.0
        for i in order.permutation(len(rows)):
            y, norm = (1 if labels[i] else -1), sum(scale[j] ** 2 for j in rows[i]) + 1
            gradient = y * (sum(w[j] * scale[j] for j in rows[i]) + b) - 1
            step = min(max(alpha[i] - gradient / norm, 0.0), cost) - alpha[i]
            if step:
                alpha[i] += step
                b += step * y
                for j in rows[i]:
                    w[j] += step * y * scale[j]
                worst = max(worst, abs(step) * norm)
        if worst < 1e-3:
            break
    return {j: w[j] * scale[j] for j in w}, b


def test_quality_query(spark):
    docs = dict(rows_of(spark, "documents", "doc_id", "text"))
    labels = sorted((str(i), i, q) for i, q in rows_of(spark, "labels", "doc_id", "quality") if q is not None and i in docs and zlib.crc32(str(i).encode()) % 5)
    weights, bias = plain_fit([quality_features(docs[i]) for _, i, _ in labels], [q for *_, q in labels], quality_classifier.FEATURES, 0.1)
    for r in quality_classifier.query(spark, SMALL).collect():
        score = 1 / (1 + math.exp(-2 * (sum(weights.get(j, 0.0) for j in quality_features(docs[r.doc_id])) + bias)))
        assert abs(r.score - score) < 1e-3 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)


def test_toxicity_query(spark):
    """Every score is the model's over the features of the one text, whatever else is in its slice."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    channel, model = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.score(docs, channel, model).collect():
        data = (texts[r.doc_id] or "").encode()
        ids, _ = toxicity.features_of(channel)(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        margin = sum(float(model.weights[j]) for j in set(ids.tolist())) + model.bias
        assert abs(r.score - 1 / (1 + math.exp(-2 * margin))) < 1e-5 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7)


def test_slices_do_not_matter():
    texts = ["an i d i o t", None, "", "x" * 5000, "plain words"] * 3
    a = [_linear.present(*quality_classifier.features(d, o), quality_classifier.FEATURES) for _, _, d, o in B.slices(pa.array(texts))]
    b = [_linear.present(*quality_classifier.features(d, o), quality_classifier.FEATURES) for _, _, d, o in B.slices(pa.array(texts), most=10)]
    assert sorted(np.concatenate([x[0] for x in a]).tolist()) == sorted(np.concatenate([x[0] for x in b]).tolist())
