"""Line dedup, Jaccard join and suffix dedup against brute force, with small limits so that every path runs."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import frame
from tessera.llm import _grouping, _rarity, jaccard_join, line_dedup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def later_lines(texts, threshold=0.8, least=5):
    seen, out = [], set()
    for i, t in sorted((i, t) for i, t in texts if t is not None):
        for k, x in enumerate(t.translate(LOWER).split("\n")):
            s = frozenset(WORD.findall(x))
            if len(s) >= least:
                if any(len(s & o) >= threshold * len(s | o) - 1e-9 for o in seen):
                    out.add((i, k))
                seen.append(s)
    return out


def test_lines(spark, corpus):
    docs = frame(spark, corpus)
    expected = later_lines(corpus)
    assert expected
    assert {tuple(r) for r in line_dedup.later_matches(docs).collect()} == expected
    kept = {r.doc_id: r.text for r in line_dedup.dedup(docs).collect()}
    for i, t in corpus:
        gone = {k for d, k in expected if d == i}
        want = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone) if gone else t
        assert kept.get(i) == (want if not gone or WORD.search(want) else None)
    assert line_dedup.dedup(docs).columns == docs.columns


def test_lines_of_one_family(spark, words):
    r = random.Random(3)
    base = [r.choice(words) for _ in range(30)]
    texts = []
    for i in range(40):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(30)] = r.choice(words)
        texts.append((i, " ".join(w)))
    assert {tuple(x) for x in line_dedup.later_matches(frame(spark, texts)).collect()} == later_lines(texts)


def groups(texts, percent=85):
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard(spark, corpus):
    docs = frame(spark, corpus)
    expected = groups(corpus)
    assert len({c for _, c in expected.values()}) < len(expected) - 5
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.cluster(docs).collect()}
    assert got == expected
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, c in expected.values()}


@pytest.mark.parametrize("edits", [1, 3, 8])
def test_jaccard_of_families(spark, words, edits, monkeypatch):
    """Chains of near copies about the threshold: cells overlap, and boundaries are joined."""
    monkeypatch.setattr(jaccard_join, "PARTNERS", 3)
    r = random.Random(edits)
    texts, w = [], [r.choice(words) for _ in range(90)]
    for i in range(70):
        if i % 35 == 0:
            w = [r.choice(words) for _ in range(90)]
        v = list(w)
        for _ in range(r.randint(0, edits)):
            v[r.randrange(90)] = r.choice(words)
        if r.random() < 0.3:
            w = v
        texts.append((r.randrange(1000) * 100 + i, " ".join(v)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.cluster(frame(spark, texts)).collect()}
    assert got == groups(texts)


def repeats(texts, length=100):
    seen, out = set(), {}
    for i, t in sorted((i, t or "") for i, t in texts):
        b = t.encode()
        gone = set()
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone.update(range(s, s + length))
            seen.add(b[s : s + length])
        kept = bytes(x for k, x in enumerate(b) if k not in gone)
        out[i] = (len(b), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("most", [500, 1])
def test_suffixes(spark, corpus, most, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_SURROUNDINGS", most)
    texts = [*corpus, (100, "ab" * 400), (101, "x" * 350), (102, "q" + "ab" * 90 + "z" * 120)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.report(frame(spark, texts)).collect()}
    expected = repeats(texts)
    assert sum(v[1] for v in expected.values()) > 1000
    assert got == expected


def test_suffix_array():
    r = random.Random(1)
    for _ in range(3000):
        x = [r.randint(1, r.choice((1, 2, 3, 9))) for _ in range(r.randint(0, 20))]
        order = _grouping.suffix_array(x)
        assert order == sorted(range(len(x)), key=lambda i: x[i:])
        shared = _grouping.common_prefixes(x, order)
        for k in range(1, len(x)):
            a, b = x[order[k - 1] :], x[order[k] :]
            assert shared[k] == next((n for n in range(min(len(a), len(b))) if a[n] != b[n]), min(len(a), len(b)))


@pytest.mark.parametrize("texts", [[], [(1, None), (2, "")], [(1, "a b c d e f"), (1, "a b c d e f")]])
def test_edges(spark, texts):
    docs = frame(spark, texts)
    assert line_dedup.dedup(docs).count() == len(texts)
    assert jaccard_join.cluster(docs).count() == len(texts)
    assert suffix_dedup.report(docs).count() == len(texts)


def test_null_ids(spark):
    docs = frame(spark, [(None, "a b c d e f g"), (None, "a b c d e f g"), (3, "a b c d e f g")])
    assert line_dedup.dedup(docs).count() == 3
    assert sorted(str(r.component_id) for r in jaccard_join.cluster(docs).collect()) == ["3", "None", "None"]
    assert all(r.n_removed == 0 for r in suffix_dedup.report(docs).collect())


def near_groups(texts, size, percent):
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    least = {i: i for i in sets}
    linked = [(i, j) for i in sets for j in sets if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    for _ in sets:
        for i, j in linked:
            least[i] = least[j] = min(least[i], least[j])
    return least


def test_near_copies_stage(spark, words):
    """Groups at five words and 80 %; one changed word in fifty, and longer texts that differ in several places."""
    import corpus_pipeline

    r = random.Random(8)
    texts = []
    for length, edits in [(50, 1), (50, 2), (90, 1), (300, 5), (300, 6), (300, 7)] * 3:
        w = [r.choice(words) for _ in range(length)]
        v = list(w)
        for k in range(edits):
            v[20 + k * (length - 40) // edits] = "changed"
        texts += [(len(texts), " ".join(w)), (len(texts) + 1, " ".join(v))]
    expected = near_groups(texts, 5, 80)
    assert set(expected.values()) != set(near_groups(texts, 4, 85).values())
    docs = frame(spark, texts)
    assert {x.doc_id for x in corpus_pipeline.near_copies(spark, docs, "").collect()} == set(expected.values())


def test_lines_of_every_size(spark, corpus):
    """No least size: equal short lines go, and four words match five that hold them."""
    import corpus_pipeline

    texts = [*corpus, (200, "yes\nNo yes\nq w e r\nq w e"), (201, "q w e r t\nYES\nyes no"), (202, "e w q\nq w e r z\nt r e w q\nyes no q"), (203, "yes")]
    expected = later_lines(texts, least=1)
    assert {(201, 0), (201, 1), (201, 2), (202, 0), (202, 1), (202, 2), (203, 0)} <= expected and (202, 3) not in expected
    assert {tuple(x) for x in line_dedup.later_matches(frame(spark, texts), least_tokens=line_dedup.ANY_SIZE).collect()} == expected
    kept = {x.doc_id: x.text for x in corpus_pipeline.lines(spark, frame(spark, texts), "").collect()}
    assert kept[202] == "yes no q" and 203 not in kept


def test_lines_query_takes_every_size(spark, tmp_path):
    texts = [(1, "yes no\na b c d e f"), (2, "No yes\nelse"), (3, "else")]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    assert {x.doc_id: x.n_removed for x in line_dedup.query(spark, str(tmp_path)).collect()} == {1: 0, 2: 1, 3: 1}


@pytest.mark.parametrize("group", [1000, 1])
def test_lines_of_large_groups(spark, words, group, monkeypatch):
    """Lines that share a passage and differ around it, about the threshold."""
    monkeypatch.setattr(line_dedup, "GROUP", group)
    monkeypatch.setattr(line_dedup, "LEAD", min(group, 2))
    r = random.Random(7)
    passages = [[r.choice(words) for _ in range(40)] for _ in range(2)]
    texts = []
    for i in range(120):
        own = [r.choice(words) for _ in range(r.randint(3, 9))]
        if texts and r.random() < 0.3:  # some of an earlier line's own words
            own = r.choice(texts)[1].split(" ")[: r.randint(2, 5)] + own[:3]
        texts.append((i, " ".join(own + r.choice(passages))))
    texts.append((0, texts[5][1]))
    expected = later_lines(texts, least=1)
    assert 10 < len(expected) < 110
    assert {tuple(x) for x in line_dedup.later_matches(frame(spark, texts), least_tokens=1).collect()} == expected


def test_jaccard_regions_are_divided(spark, words, monkeypatch):
    """Regions are joined recursively, two levels deep at least."""
    monkeypatch.setattr(jaccard_join, "REGION", 3)
    monkeypatch.setattr(jaccard_join, "SHRINKS", 0.99)
    r = random.Random(2)
    base = [r.choice(words) for _ in range(90)]
    texts = []
    for i in range(160):
        w = list(base if i < 4 or r.random() < 0.5 else r.choice(texts)[1].split(" "))
        for _ in range(r.randint(0, 3)):
            w[r.randrange(90)] = r.choice(words)
        texts.append((i, " ".join(w)))
    levels = []
    kept = jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", lambda df, name, *more: (levels.append(name), kept(df, name, *more))[1])
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.cluster(frame(spark, texts)).collect()}
    assert got == groups(texts)
    assert levels.count("parts") >= 2


def test_postings_of_a_group_meet_by_size(spark, words, monkeypatch):
    """Direct groups give the pairs of the plain join, of small and of wide sets, without comparing postings of far sizes."""
    r = random.Random(13)
    texts, w = [], []
    for i in range(300):
        w = [r.choice(words) for _ in range(r.choice((6, 9, 40, 100, 130)))] if i % 6 == 0 else list(w)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(words)
        texts.append((r.randrange(120), "\n".join([" ".join(w)] * r.randint(1, 2) + [r.choice(words)])))
    docs = frame(spark, texts).select("doc_id", "text").repartition(3)
    rarity = line_dedup.levels(docs, line_dedup.tokens_of)
    rows = line_dedup.signatures(docs, rarity, 0.8, 1).where(F.size("prefix") > 0).withColumn("open", F.col("line") % 3 < 2)
    for kind in ("long", "string"):
        posted = line_dedup.written(line_dedup.postings(rows.withColumn("doc_id", F.col("doc_id").cast(kind))), "posted")
        expected = {tuple(x) for x in line_dedup.met(posted, 0.8).collect()}
        assert len(expected) > 300
        assert {tuple(x) for x in line_dedup.met_by_size(posted, 0.8).collect()} == expected
    # sizes that are all too far from each other are never compared
    n = np.array([int(10 * 1.4**k) for k in range(30)])
    compared = []
    kept = np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: (compared.append(len(x)), kept(x))[1])
    zero = np.zeros(30, np.int64)
    assert list(line_dedup.near_pairs(n, n, zero + 1, zero, zero, 0.8)) == [] and sum(compared) == 0


def test_frequency_levels(spark):
    """Counts of any width add up over tasks; a block that no token falls in is zero."""
    texts = [(i, " ".join(["w"] * 300 + [f"x{i % 7}"])) for i in range(400)] + [(400, None), (401, "")]
    docs = frame(spark, texts).repartition(5)
    got = _rarity.levels(docs, line_dedup.tokens_of)
    data = " ".join(t for _, t in texts if t).encode()
    tokens = line_dedup.tokens_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    count = np.bincount((tokens >> np.uint64(64 - _rarity.BITS)).astype(np.int64), minlength=1 << _rarity.BITS)
    assert (got == np.floor(4 * np.log2(count + 1)).astype(np.uint8)).all() and count.max() == 120_000
    assert _rarity.levels(docs.limit(0), line_dedup.tokens_of).max() == 0
