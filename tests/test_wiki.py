"""Pages, lint, health and patches on hand-made rows."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tessera.functions.text import slug
from tessera.operators import wiki

GOOD = "---\ntitle: A\nlast_updated: 2024-06-01\nsources:\n  - id: 1\n    type: article\n    ref: 0123456789\n  - id: 2\n    type: web\n    ref: http://x\n---\n# A\n\nText [^1] and [^2], see [[beta]].\n"



def pages(spark, *rows):
    return spark.createDataFrame(rows, "slug string, text string")


def known(spark, *refs):
    return spark.createDataFrame([(r,) for r in refs], "ref string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_parse(spark):
    got = wiki.opened(pages(spark, ("a", GOOD), ("b", "no frontmatter"), ("c", None), ("d", "---\n{bad\n---\nx"))).collect()
    by = {r.slug: r for r in got}
    assert by["a"].ok and by["a"].fields["title"] == "A" and [s.ref for s in by["a"].sources] == ["0123456789", "http://x"] and by["a"].body.startswith("# A")
    assert not by["b"].ok and by["b"].body == "no frontmatter" and not by["c"].ok and not by["d"].ok


def test_edits(spark):
    df = spark.createDataFrame([("# T\n\n## One\n\nold\n\n## Two\n\nkeep\n",), ("",)], "text string")
    got = [r[0] for r in df.select(wiki.with_section("text", F.lit("One"), F.lit("new"))).collect()]
    assert got == ["# T\n\n## One\n\nnew\n\n## Two\n\nkeep\n", "## One\n\nnew\n"]
    one = spark.createDataFrame([(GOOD,)], "text string").select(wiki.with_metadata("text", F.lit("last_updated"), F.lit("2025-01-01")).alias("t"))
    assert "last_updated: 2025-01-01\nsources:" in one.first().t
    html = '<div class="codehilite"><pre><span></span><code class="language-py">'
    twice = spark.createDataFrame([(html,)], "h string").select(wiki.labelled_code("h").alias("a")).select("a", wiki.labelled_code("a").alias("b")).first()
    assert 'data-lang-label="Python"' in twice.a and twice.a == twice.b
    cited = wiki.opened(pages(spark, ("a", GOOD))).select(wiki.rendered_citations(F.col("body"), F.col("sources")).alias("h")).first().h
    assert '<sup><a href="#ref-2">2</a></sup>' in cited and "[^" not in cited


def test_health(spark):
    stale = GOOD.replace("2024-06-01", "2023-01-01").replace("[^2]", "[^9] ^[article:ffffffffff]")
    got = wiki.health(pages(spark, ("a", GOOD), ("b", stale), ("c", "x")), known(spark, "0123456789"), spark.createDataFrame([("a",), ("z",)], "slug string"), F.lit(datetime.date(2024, 7, 1)))
    assert rows(got.select("slug", "check", "severity")) == sorted([
        ("a", "wikilink", "warn"), ("b", "wikilink", "warn"), ("b", "citation", "error"), ("b", "citation", "error"), ("b", "stale", "warn"), ("b", "index_missing", "warn"),
        ("c", "yaml", "error"), ("c", "index_missing", "warn"), ("z", "index_orphan", "error"),
    ])


def test_context(spark):
    q = spark.createDataFrame([(1, "What is Open-AI?"), (2, "and open ai?"), (3, "nothing")], "id int, question string")
    ok = GOOD.replace("see [[beta]]", "end")
    got = wiki.context(q, pages(spark, ("open-ai", ok)), known(spark, "0123456789"), F.lit(datetime.date(2024, 7, 1)))
    assert {r.id: bool(r.context) for r in got.collect()} == {1: True, 2: True, 3: False}


def test_evidence(spark):
    packs = spark.createDataFrame([("p", 0, "c1"), ("p", 1, "c2"), ("q", 0, "none")], "pack string, pos int, chunk string")
    chunks = spark.createDataFrame([("c1", "abcdef"), ("c2", "ghijkl")], "chunk string, text string")
    assert rows(wiki.hydrated(packs, chunks, budget=7, cap=5).select("pack", "pos", "retry", "text")) == [("p", 0, False, "abcde"), ("p", 1, False, "gh"), ("q", 0, True, None)]
    edges = spark.createDataFrame([(0, "Open AI", "X", "chunk-1"), (1, "open ai", "X", "chunk-2")], "pos int, src_id string, tgt_id string, source_id string")
    of = spark.createDataFrame([("chunk-1", 1), ("chunk-2", 2)], "chunk string, id int")
    assert rows(wiki.entity_articles(edges, of, slug)) == [("open-ai", [1]), ("x", [1, 2])]
    ev = spark.createDataFrame([("s", "article", "1"), ("s", "web", "2"), ("t", "web", "2")], "slug string, type string, ref string")
    assert rows(wiki.assembled(ev).select("slug", "confidence")) == [("s", "high"), ("t", "low")]


def test_patches(spark):
    now = pages(spark, ("a", "old"))
    patches = spark.createDataFrame([("a", None), ("b", None), ("c", "d")], "slug string, base_digest string")
    right = spark.createDataFrame([("old",)], "t string").select(F.lit("a").alias("slug"), F.sha2("t", 256).alias("base_digest"))
    assert rows(wiki.applicable(patches, now).select("slug", "outcome")) == [("a", "conflict"), ("b", "apply"), ("c", "conflict")]
    assert rows(wiki.applicable(right, now).select("outcome")) == [("apply",)]
    blocked = {r.slug: r.blocked_by for r in wiki.gates(pages(spark, ("a", GOOD), ("b", "x")), known(spark, "0123456789")).collect()}
    assert blocked == {"a": [], "b": ["frontmatter"]}
    d = datetime.date(2024, 7, 1)
    s = spark.createDataFrame([(1, "new", None, 0, 1), (2, "retry", d, 1, 2), (3, "applied", None, 1, 0), (4, "retry", datetime.date(2025, 1, 1), 1, 0)], "id int, status string, next_retry_at date, attempts int, created_at int")
    out = spark.createDataFrame([(1, "applied")], "id int, outcome string")
    assert rows(wiki.worked(s, F.lit(datetime.date(2024, 7, 1)), out, 5)) == [(1, "applied", 1, None), (2, "retry", 2, datetime.date(2024, 7, 4))]
