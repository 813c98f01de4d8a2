"""Periodic runs, license scans and the conversation trie against brute force and SQL."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tests.llm.conftest import frame
from tessera.llm import _bytes, license_scan, periodic_runs, prefix_trie

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- periodic runs


def plain_runs(words, least=12):
    """(start, end, smallest period) of all runs, by trying every period at every word."""
    n, out = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(2 * p, least):
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((a, b, p) for (a, b), p in out.items())


def odd_texts(seed=7):
    r = random.Random(seed)
    texts = [None, "", " \n\t ", "a", "a " * 500, "a b " * 6, "a b " * 5 + "a", ("x " * 20 + "y ") * 9, "é 中 é 中 " * 5]
    for _ in range(60):
        unit = [r.choice("abc") for _ in range(r.randint(1, 9))]
        body = [r.choice("abcdefgh") for _ in range(r.randint(0, 30))] + (unit * 9)[: r.randint(0, 50)] + [r.choice("ab") for _ in range(r.randint(0, 40))]
        texts.append(r.choice([" ", "\n", "  "]).join(body))
    w = [f"w{r.randrange(3000)}" for _ in range(60_000)]  # beyond one slice of bytes
    w[20_000:44_000] = (w[20_000:28_000] * 3)[:24_000]
    return [*texts, " ".join(w)]


def checked(texts, **options):
    import pyarrow as pa

    column = pa.array(texts, pa.string())
    got = []
    for low, high, data, offsets in _bytes.slices(column):
        part = [(t or "").encode() for t in texts[low:high]]
        got += periodic_runs.search(part, data, offsets, **options)
    assert len(got) == len(texts)
    for text, (n, runs, collapsed) in zip(texts, got, strict=True):
        words = WORD.findall(text or "")
        assert n == len(words)
        if n <= 3000:
            assert sorted(runs) == plain_runs(words)
        gone = {i for a, b, p in runs for i in range(a + p, b)}
        assert collapsed.decode() == " ".join(w for i, w in enumerate(words) if i not in gone)
    return got


def test_runs():
    got = checked(odd_texts())
    assert got[-1][1] == [(20_000, 44_000, 8_000)]
    checked(odd_texts(8)[:-1], chunk=3)


def test_runs_despite_bad_hashes(monkeypatch):
    """Words that share a hash are told apart by the words themselves."""
    good = _bytes.span_hash
    monkeypatch.setattr(_bytes, "span_hash", lambda *a: good(*a) % np.uint64(3))
    checked(odd_texts()[:-1])


def test_run_report(spark, corpus):
    texts = [(i, t) for i, t in enumerate(odd_texts()[:-1])] + [(7, "a b " * 9), (7, "a b " * 9), (None, "z " * 12)] + [(1000 + i, t) for i, t in corpus]
    docs = frame(spark, texts)
    got = collections.Counter(tuple(r) for r in periodic_runs.report(docs).collect())
    expected = collections.Counter()
    for i, t in texts:
        words = WORD.findall(t or "")
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
        gone = {j for a, b, p in runs for j in range(a + p, b)}
        longest = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
        expected[(i, len(runs), *longest, sha("".join(f"{a},{b - a},{p}\n" for a, b, p in sorted(runs, key=lambda r: (r[0], r[2])))), sha(" ".join(w for j, w in enumerate(words) if j not in gone)))] += 1
    assert got == expected
    assert periodic_runs.report(docs.limit(0)).count() == 0
    out = periodic_runs.collapse(docs)
    assert out.columns == docs.columns
    assert {r.text for r in out.where("doc_id is null").collect()} == {"z"}


def test_planted_texts(spark, tmp_path, corpus):
    """The query's own texts, by the contract's arithmetic."""
    texts = [(i, f"{t} tail of words" if t else t) for i, (_, t) in enumerate(corpus * 4)]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in periodic_runs.query(spark, str(tmp_path)).collect()}
    hit = 0
    for i, t in texts:
        w = WORD.findall(t or "")
        h, n = zlib.crc32(str(i).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        runs = plain_runs(w) if n < 3000 else None
        if runs is not None:
            hit += h % 10 == 0 and bool(runs)
            assert got[i].n_runs == len(runs) and got[i].runs_sha256 == sha("".join(f"{a},{b - a},{p}\n" for a, b, p in sorted(runs, key=lambda r: (r[0], r[2]))))
    assert hit > 3


# --- license scans


def edits(pattern, text):
    """Edit distances of the pattern to the best part of the text that ends at each place."""
    previous, out = list(range(len(pattern) + 1)), []
    for c in text:
        row = [0]
        for i, a in enumerate(pattern, 1):
            row.append(min(previous[i - 1] + (a != c), previous[i] + 1, row[i - 1] + 1))
        previous = row
        out.append(row[-1])
    return out


def misspelt(r, text, n):
    t = list(text)
    for _ in range(n):
        at, how = r.randrange(len(t)), r.random()
        if how < 0.4:
            t[at] = r.choice("abcdefgh ")
        elif how < 0.7:
            del t[at]
        else:
            t.insert(at, r.choice("abcxyz "))
    return " ".join("".join(t).split())


def test_notices():
    """Every notice within its edits is found where it ends, and nothing else."""
    r = random.Random(5)
    for _ in range(150):
        notice = r.choice(list(license_scan.NOTICES))
        normal = f" foo bar {misspelt(r, notice, r.randint(0, license_scan.allowed(len(notice)) + 2))} baz the license "
        found, _ = license_scan.locate(normal)
        for m in found:
            assert edits(m.notice, normal[m.start : m.end])[-1] <= m.edits <= license_scan.allowed(len(m.notice))
        for other in license_scan.NOTICES:
            ends = [i + 1 for i, e in enumerate(edits(other, normal)) if e <= license_scan.allowed(len(other))]
            assert bool(ends) == any(m.notice == other for m in found)
            assert all(any(m.notice == other and m.start < e and m.end >= e - len(other) // 2 for m in found) for e in ends)


def test_pieces():
    for notice in license_scan.NOTICES:
        parts = license_scan.pieces(notice)
        assert len(parts) == license_scan.allowed(len(notice)) + 1 and "".join(p for _, p in parts) == notice and min(len(p) for _, p in parts) >= 5


def test_license_report(spark):
    texts = [
        (1, "Released under the MIT License."), (2, "x\nReleased undr the MIT\tLicence!"), (3, "Licensed under CC BY-NC 4.0. Licensed under CC BY-SA 4.0"), (4, None), (5, ""),
        (6, "the GNU General Public License, general PUBLIC license; mit  license"), (7, "licensed to kill under the bridge"), (7, "licensed to kill under the bridge"),
        (8, "é " * 200_000 + "Licensed under the Apache License, Version 2.0. " + "b " * 100_000), (None, "Permission is hereby grantd, free of charge, to any persn obtaining a copy of this sofware"),
    ]
    docs = frame(spark, texts)
    rows = license_scan.report(docs).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts)
    assert (got[1].labels, got[1].score, got[1].n_base, got[1].first_word, got[1].last_word) == ("mit", 1.0, 1, 3, 3)
    assert (got[2].labels, got[2].base_labels, got[2].n_base, got[2].first_word) == ("mit", "", 0, None) and 0.85 < got[2].score < 1
    m = got[2].notices[0]
    assert texts[1][1][m.start : m.end] == "Released undr the MIT\tLicence" and (m.word, m.n_words, m.edits) == (1, 5, 2)
    assert (got[3].labels, got[3].score) == ("cc-by-nc-4.0,cc-by-sa-4.0", 1.0)
    assert got[4].n_words == got[5].n_words == 0 and got[4].labels == "" and got[4].score == 0
    assert (got[6].base_labels, got[6].n_base, got[6].first_word, got[6].last_word) == ("gpl,mit", 3, 2, 8)
    assert got[7].labels == "" and got[7].score == 0
    assert got[8].labels == "apache" and got[8].first_word == 200_003 and got[8].notices[0].start == 400_000
    assert got[None].labels == "mit" and got[None].base_labels == ""
    assert license_scan.report(docs.limit(0)).count() == 0
    assert license_scan.find(docs).columns[: len(docs.columns) - 1] == [c for c in docs.columns if c != "n_words"][: len(docs.columns) - 1]


def test_license_query(spark):
    """Counts and labels of exact phrases over whole texts, by plain Python."""
    got = {r.doc_id: r for r in license_scan.query(spark, FOLDER).collect()}
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    assert len(docs) == len(got)
    for i, text in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = sorted((k, label) for phrase, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r.base_labels == ",".join(sorted({label for _, label in at})) and {label for _, label in at} <= set(r.labels.split(","))


# --- conversation trie


def plain_trie(sequences):
    """Nodes of {conversation: [(role, text), ...]} as the query's rows."""
    members = collections.defaultdict(list)
    for c in sorted(sequences):
        for d in range(len(sequences[c]) + 1):
            members[tuple(sequences[c][:d])].append(c)
    children = collections.defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        saved[node] = own + sum(saved[x] for x in children[node])
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
    return sorted(
        (members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(children[n]), leaves[n], saved[n], sha(",".join(str(c) for c in members[n] if len(sequences[c]) == len(n))))
        for n in members
    )


def conversations(seed):
    """(conv_id, turn, role, text) with nulls, ties, repeated rows, copies and one very long conversation."""
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-40, 400), 90):
        for k in range(r.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, r.choice([k, k, None, 1]), r.choice(["user", "bot", None]), r.choice(["a b", "a", "", None, "c d e"])))
    rows += [(5000, k, "user", f"x{k % 7}") for k in range(300)] + [(5001, k, "user", f"x{k % 7}") for k in range(250)] + [(5000, 3, "user", "x3")]
    rows += [(6000 + i, 0, "user", "hello there") for i in range(60)] + [(None, 0, "user", "lost")]
    return rows


TYPES = "conv_id long, turn long, role string, text string"


def in_order(rows):
    out = collections.defaultdict(list)
    for c, t, role, text in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        out[c].append((role or "", text or ""))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_trie(spark, monkeypatch, small):
    if small:  # blocks of two turns and two ids, and hot nodes apart from others
        for name, value in (("TURN_BITS", 1), ("ID_BITS", 1), ("HOT", 3)):
            monkeypatch.setattr(prefix_trie, name, value)
    rows = conversations(3)
    got = sorted((tuple(r) for r in prefix_trie.build(spark.createDataFrame(rows, TYPES)).collect()), key=lambda r: (r[0], r[1]))
    assert got == plain_trie(in_order(rows))


def test_rebuilt_conversations(spark, tmp_path):
    rows = conversations(4)
    spark.createDataFrame([(*x, "y", 1) for x in rows], f"{TYPES}, owner string, depth int").write.parquet(f"{tmp_path}/conversations.parquet")
    own = in_order(rows)
    sequences = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        sequences[c] = [*own.get(base, [])[:h], *turns[h:]]
    assert any(not s for s in sequences.values())
    got = sorted((tuple(r) for r in prefix_trie.query(spark, str(tmp_path)).collect()), key=lambda r: (r[0], r[1]))
    assert got == plain_trie(sequences)


def test_nested_chains_and_empty_table(spark):
    """Each conversation leaves the one before a turn later, so chains nest as deep as they can."""
    rows = [(c, k, "user", f"t{k}" if k < c else f"own{c}") for c in range(8) for k in range(c + 2)]
    df = spark.createDataFrame(rows, TYPES)
    assert sorted((tuple(r) for r in prefix_trie.build(df).collect()), key=lambda r: (r[0], r[1])) == plain_trie(in_order(rows))
    assert prefix_trie.build(df.limit(0)).count() == 0
