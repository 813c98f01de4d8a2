"""Export items, imports, translations and enrichment: the cases that the given tables do not have."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import exports as E
from tessera.operators import relational as R
from tessera.operators import search as V
from tessera.operators import wiki

ITEM = "source string, id int, title string, url string, summary string, source_name string, topics string, reason string"


def test_export_needs_five(spark):
    rows = [("rss", i, f"t{i}", f"https://www.A.com/{i}", "摘要", "N", "x| y |x", None) for i in range(5)]
    bad = [("rss", 10, " ", "https://a", "摘要", "N", None, None), ("rss", 11, "t", "ftp://a", "摘要", "N", None, None), ("rss", 12, "t", "https://a", "plain", "N", None, None), ("rss", 13, "t", "https://a", "摘要", None, None, None), ("rss", 14, "t", None, None, "N", None, None), ("rss", 15, "t0 again", " https://www.A.com/0 ", "摘要", "N", None, None)]
    df = spark.createDataFrame(rows + bad, ITEM)
    got = E.export(df, F.col("id")).collect()
    assert sorted((r.id, r.domain, tuple(r.tags)) for r in got) == [(i, "a.com", ("N", "x", "y")) for i in range(5)]
    with pytest.raises(Exception, match="expected 5 eligible items, found 4"):
        E.export(df.where("id > 0 AND id <> 15"), F.col("id")).collect()


def test_imported_errors(spark):
    lines = [(0, ""), (1, "  "), (2, "no json"), (3, "[1]"), (4, "5"), (5, '{"lint_name": "a", "page_path": "wiki/x.y.md", "failures": ["f", "g"], "ts": "t"}'), (6, '{"lint_name": "a", "page_path": "z/x.y.txt", "failures": ["f"], "ts": "later"}'), (7, "{}"), (8, '{"lint_name": "b", "failures": []}'), (9, '{"lint_name": ')]
    none = spark.createDataFrame([], "fingerprint string")
    got = E.imported_errors(spark.createDataFrame(lines, "pos int, value string"), none)
    assert {(r.check_type, r.page_slug, r.evidence, r.first_seen) for r in got.collect()} == {("a", "x.y", "f", "t"), ("unknown", "unknown", "unknown", None), ("b", "unknown", "unknown", None)}
    known = got.where("check_type = 'a'").select("fingerprint")
    assert E.imported_errors(spark.createDataFrame(lines, "pos int, value string"), known).count() == 2


def test_translation_answers(spark):
    rows = [('{"title_translated": "a", "body_translated": ""}', ("a", "")), ('```json\n{"title_translated": "a", "body_translated": "b", "x": 1}\n```', ("a", "b")), ('{"title_translated": "a"}', None), ('{"title_translated": "a", "body_translated": null}', None), ('{"title_translated": 1, "body_translated": "b"}', None), ("[]", None), ("", None), (None, None)]
    got = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, a string").select("i", E.translation(F.col("a")).alias("t")).orderBy("i").collect()
    assert [r.t and tuple(r.t) for r in got] == [t for _, t in rows]


def test_enrichment(spark):
    articles = spark.createDataFrame([(1, "body \n"), (2, "b2"), (3, "b3")], "id int, body string")
    ask = lambda body: F.when(body == "b3", "no list").otherwise('[{"question": " q0 "}, {"question": ""}, {"context": "x"}, {"question": "q1"}, {"question": "q2"}, {"question": "q3"}]')
    asked = E.questions(articles, ask)
    assert sorted((r.id, r.n, r.question) for r in asked.collect()) == [(i, n, f"q{n}") for i in (1, 2) for n in range(3)]
    found = spark.createDataFrame([(1, 0, "s0"), (1, 2, "s2"), (2, 7, "lost")], "id int, n int, summary string")
    got = {r.id: tuple(r)[1:] for r in E.enriched(articles, asked, found).collect()}
    assert got == {1: ("body\n\n### 1. q0\n\ns0\n\n### 3. q2\n\ns2", 2, 3, 2), 2: ("b2", -2, 3, 0), 3: ("b3", 0, 0, 0)}


def test_translations_are_set_once(spark):
    columns = "source string, id int, title_translated string, body_translated string, translated_lang string, translated_at string"
    articles = spark.createDataFrame([("rss", 1, None, None, None, None), ("rss", 2, "old", None, "x", "y"), ("wechat", 1, None, "kept", None, None)], columns)
    new = spark.createDataFrame([("rss", 1, "T", "B", "en", "now"), ("rss", 2, "T", "B", "en", "now"), ("rss", 9, "T", "B", "en", "now")], "source string, id int, title string, body string, lang string, at string")
    once = E.apply_translations(articles, new)
    assert sorted(tuple(r) for r in once.collect()) == [("rss", 1, "T", "B", "en", "now"), ("rss", 2, "old", None, "x", "y"), ("wechat", 1, None, "kept", None, None)]
    assert sorted(tuple(r) for r in E.apply_translations(once, new).collect()) == sorted(tuple(r) for r in once.collect())


def test_quintiles_of_one_size(spark):
    """A size that all rows share is spread over the buckets by key."""
    df = spark.range(1003).select("id", F.lit(7).alias("size"))
    got = {r.bucket: r["count"] for r in R.quintiles(df, "size", "id").groupBy("bucket").count().collect()}
    assert got == {0: 200, 1: 200, 2: 200, 3: 200, 4: 203}


def test_keywords_and_hashes(spark):
    q = spark.createDataFrame([("What is the RAG, exactly?", "rag exactly"), ("How to?", "How to?"), ("a b", "a b"), (None, None)], "q string, k string")
    assert all(r.a == r.k for r in q.select("k", E.search_keywords(F.col("q")).alias("a")).collect())
    articles = spark.createDataFrame([("wechat", 1, "aaaaaaaaaa", "r1"), ("rss", 2, "bbbbbbbbbbcc", "r2"), ("wechat", 3, None, "bbbbbbbbbb"), ("wechat", 4, None, "r4"), ("rss", 5, "aaaaaaaaaazz", "r5"), ("wechat", 6, "aaaaaaaaaa", "r6")], "source string, id int, content_hash string, ref string")
    wanted = spark.createDataFrame([("aaaaaaaaaa",), ("bbbbbbbbbb",), ("r4",), ("r1",), ("none",)], "h string")
    assert {(r.h, r.step, r.id) for r in R.by_any_hash(wanted, articles).collect()} == {("aaaaaaaaaa", 1, 1), ("bbbbbbbbbb", 2, 2), ("r4", 3, 4)}


def test_retrieved(spark):
    """Hashes inside longer words are none; one that is named twice counts once; blank contexts are skipped."""
    a, b = "0123456789", "abcdef0123"
    contexts = spark.createDataFrame([(1, f"x {a}\n \n{b}. {a}\n\n"), (2, None), (3, " \n\n "), (4, f"文{a} {b}f _{a}")], "id int, text string")
    images = spark.createDataFrame([(a, f"{k:02}.PNG") for k in range(9)] + [(b, "z.webp"), (b, "y.gif"), (b, "x.jpeg")], "hash string, filename string")
    got = {(r.id, r.kind, r.pos): r.value for r in V.retrieved(contexts, images).collect()}
    expected = {(1, "chunk", 0): f"x {a}", (1, "chunk", 1): f"{b}. {a}", (2, "skipped", 0): "", (3, "skipped", 0): "", (4, "chunk", 0): f"文{a} {b}f _{a}"}
    expected |= {(1, "image", k): f"{a}/{k:02}.PNG" for k in range(9)} | {(1, "image", 9): f"{b}/x.jpeg"}
    assert got == expected


def test_cited_blocks(spark):
    rows = spark.createDataFrame([(["a ", None, "", "b"], None), (["a", "", "b"], []), (["a", "", "b"], [None, None, None]), (["a", " b"], [[1, 0], None, [1]])], "blocks array<string>, maps array<array<int>>")
    got = [r[0] for r in rows.select(X.cited_blocks(F.col("blocks"), F.coalesce("maps", F.expr("cast(array() as array<array<int>>)")))).collect()]
    assert got == ["a\n\nb", "a\n\nb", "a [^1]\n\nb [^3]", "a [^1]\n\nb [^1][^3]"]


def test_update_outcomes(spark):
    """Only patches that apply by themselves meet the page: unchanged, changed, gone, new and come."""
    patches = spark.createDataFrame([("same", "auto_apply", "t"), ("changed", "auto_apply", "old"), ("gone", "auto_apply", "t"), ("new", "auto_apply", None), ("come", "auto_apply", None), ("kept", "suggestion_only", "old"), ("no", "rejected", "t")], "slug string, class string, base string")
    patches = patches.select("slug", "class", F.sha2("base", 256).alias("base_digest"))
    pages = spark.createDataFrame([(s,) for s in ("same", "changed", "come", "kept", "no")], "slug string").withColumn("text", F.lit("t"))
    out = wiki.update_outcomes(patches, pages)
    assert {r.slug: r.status for r in out.collect()} == {"same": "applied", "changed": "conflict", "gone": "conflict", "new": "applied", "come": "conflict", "kept": "suggestion", "no": "rejected"}
    assert tuple(wiki.update_stats(out).first()) == (7, 2, 5, 1, 3, 1)
