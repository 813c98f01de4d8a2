"""The written trigram index, ranks over many rows, exact neighbours, contradictions and eviction."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates as G
from tessera.operators import neighbours as N
from tessera.operators import relational as R
from tessera.operators import search as V
from tessera.operators.text_index import TextIndex, gram_codes


def text():
    return F.concat_ws("\n", "title", "body")


def articles(spark, rows):
    return spark.createDataFrame([(k, k, f"Title {k}", b, lang) for k, b, lang in rows], "key string, hash string, title string, body string, lang string")


BODIES = [("a", "The quick brown fox", "en"), ("b", "quick QUICK quicker", "en"), ("c", "nothing here", "de"), ("d", None, "de"), ("e", "", "en"), ("f", "über Quick 中文字符", "de"), ("g", "qu ick", "en")]


@pytest.mark.parametrize("block", [50_000, 1])
def test_index_finds_what_a_scan_finds(spark, tmp_path, block):
    docs = articles(spark, BODIES)
    index = TextIndex(spark, str(tmp_path), parts=8, block_documents=block)
    index.refresh(docs, text())
    for phrase in ("quick", "QUICK ", "the quick brown", "中文字", "ick", "no such phrase", "title a", "qui", "e c"):
        expected = V.phrase_search(docs, phrase).collect()
        got = index.search(phrase, text()).collect()
        assert sorted((r.hash, r.score, r.snippet) for r in got) == sorted((r.hash, r.score, r.snippet) for r in expected)
    assert index.search("qu", text()).count() == 0
    assert [r.hash for r in index.search("quick", text(), keep=F.col("lang") == "de").collect()] == ["f"]
    assert {r.hash for r in index.keyword_union(["brown", "quicker", "quick"], text(), 2).collect()} == {"a", "b"}


def test_index_reads_the_phrases_partitions_only(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path), parts=64)
    index.refresh(articles(spark, [(str(i), f"{i} lorem ipsum dolor {i * 7919}", "en") for i in range(300)]), text())
    rows, wanted = index.postings("dolor")
    files = {re.search(r"part=(\d+)", f)[1] for f in rows.inputFiles()}
    parts = {r.part for r in rows.select("part").distinct().collect()}
    assert len(parts) <= len(wanted) == 3
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "part#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and len(files) > 3
    assert rows.count() == 3 and rows.agg(F.sum("n")).first()[0] == 900


def test_refresh_takes_changes_only(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path), parts=4)
    index.refresh(articles(spark, BODIES), text())
    changed = [("a", "slow brown fox", "en"), *BODIES[1:5], ("h", "a quick new one", "fr")]
    assert index.refresh(articles(spark, changed), text()) == 1
    now = articles(spark, changed)
    for phrase in ("quick", "slow", "brown", "über", "new one"):
        assert {r.hash for r in index.search(phrase, text()).collect()} == {r.hash for r in V.phrase_search(now, phrase).collect()}
    written = spark.read.parquet(f"{tmp_path}/documents/generation=1")
    assert {r.key for r in written.select("key").collect()} == {"a", "h"}
    grams = {}
    for r in now.select(F.lower(text()).alias("t")).collect():
        for g in gram_codes(r.t).tolist():
            grams[g] = grams.get(g, 0) + 1
    assert {r.gram: r.n for r in index.posting_counts().collect()} == grams
    # a refresh that died before its commit does not count, and the next one takes its place
    spark.createDataFrame([("a",), ("b",)], "key string").write.parquet(f"{tmp_path}/gone/generation=2")
    assert {r.hash for r in index.search("quick", text()).collect()} == {"b", "h"}
    assert index.refresh(articles(spark, changed[1:]), text()) == 2
    assert index.search("slow", text()).count() == 0 and index.documents().count() == len(changed) - 1
    assert index.refresh(articles(spark, []), text()) == 3 and index.search("quick", text()).count() == 0


def test_empty_index(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path))
    index.refresh(articles(spark, []), text())
    assert index.search("quick", text()).count() == 0 and index.posting_counts().count() == 0


def test_ranks_of_many_rows(spark):
    """No row is lost and no rank is missing beyond one partition."""
    n = 1_000_000
    df = spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 512).alias("wide"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("score"))
    got = G.ranked(df, F.desc("score"), F.col("id"))
    r = got.agg(F.count("*").alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.count_distinct("rank").alias("ranks")).first()
    assert tuple(r) == (n, 1, n, n)
    first = got.where("rank <= 1000").orderBy("rank").select("score", "id").collect()
    assert first == df.orderBy(F.desc("score"), "id").select("score", "id").limit(1000).collect()
    assert G.ranked(df.limit(0), F.col("id")).count() == 0


def brute(left, right, k):
    out = []
    good = [(i, np.float32(v).astype(float)) for i, v in right if v and np.isfinite(v).all() and np.any(v) and len(v) == 4]
    for i, v in left:
        if not v or len(v) != 4 or not np.isfinite(v).all() or not np.any(v):
            continue
        v = np.float32(v).astype(float)
        near = sorted((-round(float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), 6), j) for j, w in good if j != i)
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(near[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("chunk", [4000, 7])
def test_nearest_join(spark, chunk):
    r = random.Random(4)
    centres = [[r.gauss(0, 1) for _ in range(4)] for _ in range(6)]
    vectors = [(i, [x + r.gauss(0, 0.05) for x in r.choice(centres)]) for i in range(120)]
    vectors += [(1000 + i, [1.0, 0.0, 0.0, 0.5]) for i in range(40)] + [(2000, None), (2001, [0.0] * 4), (2002, [1.0, 2.0]), (2003, [float("nan"), 1.0, 0.0, 0.0]), (2004, [])]
    df = spark.createDataFrame(vectors, "key long, vector array<double>")
    got = sorted((x.key, x.rank, x.neighbour, round(x.similarity, 6)) for x in N.nearest_join(df, df, 5, chunk).collect())
    assert [g[:3] for g in got] == [e[:3] for e in brute(vectors, vectors, 5)]
    assert np.allclose([g[3] for g in got], [e[3] for e in brute(vectors, vectors, 5)], atol=2e-6)
    some = vectors[:3] + vectors[-6:]
    got = sorted((x.key, x.rank, x.neighbour) for x in N.nearest_join(spark.createDataFrame(some, "key long, vector array<double>"), df, 3, chunk).collect())
    assert got == [e[:3] for e in brute(some, vectors, 3)]
    assert N.nearest_join(df, df.limit(0), 3).count() == 0 and N.nearest_join(df.limit(0), df, 3).count() == 0


@pytest.mark.parametrize("hub", [500, 3, 0])
def test_contradictions_of_many_sentences(spark, hub):
    r = random.Random(9)
    names = ["Alpha", "Beta", "Gamma", "Delta", "Eps", "Zeta", "Eta", "Theta"] + [f"Rare{i}" for i in range(40)]

    def sentence():
        return " ".join(r.choice(names[: r.choice([8, 48])]) for _ in range(r.randint(1, 6))) + f" {r.choice(['', '1999', '2001', '2001 and 1999'])} x"

    new, old = ([(i, sentence()) for i in range(60)] for _ in range(2))
    expected = []
    for i, s in new:
        years, words = set(re.findall(r"\b(?:19|20)\d{2}\b", s)), set(re.findall(r"\b[A-Z][A-Za-z0-9]+\b", s))
        hits = [j for j, t in old if years and (y := set(re.findall(r"\b(?:19|20)\d{2}\b", t))) and y != years and len(words & set(re.findall(r"\b[A-Z][A-Za-z0-9]+\b", t))) >= 2]
        expected += [(i, min(hits))] if hits else []
    got = R.contradictions(spark.createDataFrame(new, "id long, text string"), spark.createDataFrame(old, "id long, text string"), hub).collect()
    assert sorted(tuple(x) for x in got) == expected


def test_eviction_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(V, "LEAST_PART", 5)
    monkeypatch.setattr(V, "CUTS", 3)
    r = random.Random(2)
    rows = [(i, r.choice([1, 5, 5, 5, 90, None]), r.choice([10, 20, 0, None])) for i in range(200)]
    df = spark.createDataFrame(rows, "key long, at long, size long").select("key", F.timestamp_seconds("at").alias("last_used"), "size")
    order = df.select("key", "size", F.coalesce(-F.unix_micros("last_used"), F.lit((1 << 63) - 1)).alias("age"), F.xxhash64("key").alias("hash")).orderBy("age", "hash").collect()
    for budget in (0, 9, 345, 1000, 10**9):
        left, expected = budget, set()
        for x in order:
            if (x["size"] or 0) > left:
                break
            left -= x["size"] or 0
            expected.add(x.key)
        assert {x.key for x in V.evicted(df, budget).collect()} == expected
