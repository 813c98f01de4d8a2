"""Literal rows for rules: hits, misses, CJK text, nulls.

The results that the rules demand are in the SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import classify, merges, relational, wiki

C = F.col


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(rows: list[tuple], *names: str) -> str:
    """SQL of literal rows."""
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") t({', '.join(names)})"


def each(schema: str, out: Callable[[], Column], *rows: tuple) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """One expression over literal rows: each row has the inputs of ``schema`` and the demanded result, last."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        numbered = [(i, *r[:-1]) for i, r in enumerate(rows)]
        return spark.createDataFrame(numbered, f"id int, {schema}").select("id", out().alias("result"))

    return run, values([(i, r[-1]) for i, r in enumerate(rows)], "id", "result")


def joined(*columns: Column) -> Column:
    """Values side by side; null stays visible."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("∅")) for c in columns])


def frame(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


ZH, EN = "知识图谱与检索增强生成", "retrieval augmented generation over a knowledge graph of articles"
OPS = "ops array<struct<op:string,keys:array<string>>>, e boolean, a boolean, l boolean, o boolean"
SET = ("SET_METADATA", ["last_updated"])


def rows_by_hash(s, d):
    articles = frame(s, "id int, hash string", (1, "aaaaaaaaaa"), (2, "bbbbbbbbbb"), (3, None))
    return articles.where(C("hash").isin("bbbbbbbbbb", "cccccccccc")).select("id", "hash")


QUERIES = {
    "c8_patch_policy": each(
        OPS, lambda: classify.patch_class(C("ops"), C("e"), C("a"), C("l"), C("o")),
        ([], True, True, False, True, "suggestion_only"), ([("SET_METADATA", [])], True, True, False, True, "suggestion_only"), ([SET], True, False, False, True, "auto_apply"),
        ([SET], False, False, False, True, "suggestion_only"), ([("SET_METADATA", ["title"])], True, True, False, True, "suggestion_only"), ([("DELETE_PAGE", []), SET], True, True, False, True, "rejected"),
        ([("CREATE_PAGE", [])], False, False, False, True, "auto_apply"), ([("CREATE_PAGE", [])], True, False, False, True, "suggestion_only"), ([("MERGE_SOURCES", [])], True, False, True, False, "suggestion_only"),
        ([("MERGE_SOURCES", [])], True, False, True, True, "auto_apply"), ([("UPSERT_SECTION", []), SET], True, True, False, True, "auto_apply"), ([("UPSERT_SECTION", [])], True, False, False, True, "suggestion_only"),
        ([("RENAME", [])], True, True, False, True, "suggestion_only"),
    ),
    "f36_question_keywords": each(
        "q string", lambda: F.array_join(X.question_keywords(C("q")), " "),
        ("什么是AI Agent", "AI Agent"), ("是什么区别大", "什么区别大"), ("什么是", ""), ("how to build a RAG pipeline", "build RAG pipeline"), ("请问知识图谱和RAG的区别", "知识图谱和 RAG"), (None, ""), ("", ""), ("什么什么区别的的向量", "向量"),
    ),
    "f34_body_chunks": each(
        "b string, n int", lambda: F.array_join(F.transform(X.body_chunks(C("b"), C("n")), lambda x: F.concat(F.lit("<"), x, F.lit(">"))), ""),
        ("aaaa\n\nbbbb\n\n" + "c" * 25, 10, "<aaaa\n\nbbbb><cccccccccc><cccccccccc><ccccc>"), ("short", 10, "<short>"), ("", 10, "<>"), ("aa\nbb\ncc\ndd\n\nee", 8, "<aa\nbb\ncc><dd><ee>"), ("aa\n\nbb", 4, "<aa><bb>"), (None, 5, "<>"),
    ),
    "f24_f25_image_parity": each(
        "t string, s string", lambda: X.image_parity(C("t"), C("s")),
        ("p1\n\np2\n\np3\n\np4", "x ![](i)", "p1\n\np2\n\n![](i)\n\np3\n\np4"), ("one  ", "![](i)![](j)", "one\n\n![](i)\n\n![](j)\n"), ("![](a)\n\nq", "![](a)", "![](a)\n\nq"), ("", "![](a)", "![](a)"), (None, None, None),
        ("a\n\nb\n\nc", "![](1) ![](2) ![](3)", "a\n\n![](1)\n\n![](2)\n\nb\n\n![](3)\n\nc"),
    ),
    "f40_reference_sections": each(
        "t string", lambda: X.one_reference_section(C("t")),
        ("t\n## References\n- x\n## References\n- [a](b)\n", "t\n## References\n- [a](b)\n"), ("a\n# 参考资料\n[1](x)\n# more\nb\n**来源**\n[2](y)\nend", "a\n# 参考资料\n[1](x)\n# more\nb"), ("no sections", "no sections"), ("## References\n[a](b)", "## References\n[a](b)"), (None, None),
    ),
    "f42_f63_rendering": each(
        "t string", lambda: wiki.labelled_code(wiki.rendered_citations(C("t"), F.array(F.struct(F.lit("s1").alias("id")), F.struct(F.lit("s2").alias("id"))))),
        ("a[^s2] b[^s9]", 'a<sup><a href="#ref-2">2</a></sup> b[^s9]'),
        ('<div class="codehilite"><pre><span></span><code class="language-JavaScript">', '<div class="codehilite" data-lang-label="JavaScript"><pre><span></span><code class="language-JavaScript">'),
        ('<div class="codehilite">\n<pre><span></span><code class="language-cpp">', '<div class="codehilite" data-lang-label="C++"><pre><span></span><code class="language-cpp">'),
        ('<div class="language-shell highlighter-rouge"><div class="language-zig highlighter-rouge">', '<div class="language-shell highlighter-rouge" data-lang-label="Shell"><div class="language-zig highlighter-rouge" data-lang-label="ZIG">'),
        ('<div class="language-sh highlighter-rouge" data-lang-label="Shell">', '<div class="language-sh highlighter-rouge" data-lang-label="Shell">'), (None, None),
    ),
    "f9_f17_cjk_languages": each(
        "t string, b string", lambda: joined(X.has_cjk(C("b")), X.language_by_any(C("t"), C("b")), X.language_by_share(C("b")), X.language_by_head(C("b")), X.language_of_question(C("b")), X.target_language(X.language_by_any(C("t"), C("b"))), X.effective_language(X.canonical_language(F.lit("zh")), F.lit("rss"))),
        ("x", ZH, "true|zh-CN|zh|zh|zh|en|zh-CN"), ("x", EN, "false|en|en|en|en|zh-CN|zh-CN"), ("检索", "short", "false|zh-CN|en|en|en|en|zh-CN"), ("x", "short", "false|unknown|en|en|en|zh-CN|zh-CN"),
        ("x", None, "false|unknown|en|∅|en|zh-CN|zh-CN"), ("x", "知 a b c", "true|zh-CN|en|en|en|en|zh-CN"), ("x", "知识 abcd", "true|zh-CN|zh|en|en|en|zh-CN"), ("x", "知识图 abcdef", "true|zh-CN|zh|zh|zh|en|zh-CN"),
    ),
    "f33_f60_images": each(
        "t string", lambda: joined(X.image_count(C("t")), X.localized_images(C("t"), F.create_map(F.lit("http://a/1.png"), F.lit("img/1.png")))),
        ("![x](http://a/1.png) ![y](http://b/2.png)", "2|![x](img/1.png) ![y](http://b/2.png)"), ("none", "0|none"), ("", "0|"),
    ),
    "k15_k17_backfills": each(
        "status string, f string, lang string, title string", lambda: joined(merges.resolved(C("status"), C("f"), "fp1", "fp2"), merges.filled_language(C("lang"), X.language_by_any(C("title"), F.lit(EN)))),
        ("open", "fp1", None, "检索", "resolved|zh-CN"), ("open", "fp3", None, "plain", "open|en"), ("open", None, "zh-CN", "x", "open|zh-CN"),
    ),
    "r6_fallback_entities": each(
        "a string", lambda: F.array_join(classify.fallback_entities(C("a"), X.slug), ","),
        ('["Lang Graph", "lang graph", "RAG"]', "lang-graph,rag"), ('```json\n["A"]\n```', "a"), ('["a","b","c","d"]', None), ("no json", None), ('[""]', ""),
    ),
    "r7_semantic_results": each(
        "a string", lambda: classify.semantic_result(C("a")),
        ('{"decision": "APPLY", "sections": [{"heading": "H", "content": "c"}]}', "APPLY"), ('{"decision": "APPLY", "sections": [{"heading": "H", "content": "c"}, {"heading": " h", "content": "d"}]}', None), ('{"decision": "APPLY", "sections": []}', None),
        ('{"decision": "RETRY"}', "RETRY"), ('{"decision": "REJECT", "confidence": 1}', None), ('{"decision": "APPLY", "sections": [{"heading": "# H", "content": "c"}]}', None), ("x", None),
    ),
    "y19_agent_decisions": each(
        "a string", lambda: joined(classify.agent_decision(C("a"))["final"], classify.agent_decision(C("a"))["text"], classify.agent_decision(C("a"))["confidence"]),
        ('{"final": true, "text": "t", "confidence": 140}', "true|t|100.0"), ("plain words", "true|plain words|0.0"), ('{"tools": ["s"], "confidence": 40}', "false||40.0"), ('{"tools": []}', "true||0.0"),
    ),
    "u4_u5_set_differences": each(
        "l array<string>, r array<string>", lambda: joined(F.array_join(relational.differences(C("l"), C("r"))["dropped"], ","), F.array_join(relational.differences(C("l"), C("r"))["added"], ","), F.size(F.array_intersect("l", "r"))),
        (["b", "a"], ["a", "c"], "b|c|1"), ([], ["x"], "|x|0"), (["x"], ["x"], "||1"),
    ),
    "j14_hash_lookup": (rows_by_hash, values([(2, "bbbbbbbbbb")], "id", "hash")),
    "j22_without_articles": (
        lambda s, d: relational.without_articles(frame(s, "account string", ("a",), ("b",), ("c",)), frame(s, "account string", ("b",), (None,))), values([("a",), ("c",)], "account"),
    ),
    "j25_contradictions": (
        lambda s, d: relational.contradictions(
            frame(s, "id int, text string", (1, "Alpha Graph began in 2019"), (2, "Alpha Graph began in 2018"), (3, "Alpha only in 2001"), (4, "Beta Store has no year")),
            frame(s, "id int, text string", (10, "The Alpha Graph began in 2018"), (11, "Beta Store in 1999"))),
        values([(1, 10)], "new_id", "old_id"),
    ),
    "u7_index_differences": (
        lambda s, d: relational.index_consistency(frame(s, "slug string", ("a",), ("b",)), frame(s, "slug string", ("b",), ("z",))), values([("a", "missing"), ("z", "orphan")], "slug", "problem"),
    ),
    "u9_merged_sources": (
        lambda s, d: relational.merged_sources(frame(s, "id int, type string, key string", (1, "web", "a"), (4, "web", "b")), frame(s, "pos int, type string, key string", (1, "web", "b"), (2, "web", "c"), (3, "pdf", "a"))),
        values([(1, "web", "a"), (4, "web", "b"), (5, "web", "c"), (6, "pdf", "a")], "id", "type", "key"),
    ),
    "t9_t10_rerank": (
        lambda s, d: relational.rerank(
            frame(s, "query_id int, hash string, rank int", (1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "x", 1), (2, "y", 2), (2, "z", 3)),
            frame(s, "query_id int, hash string, score double", (1, "c", 0.9), (1, "a", 0.2), (2, "z", 1.0)), top=2).select("query_id", "hash", "new_rank"),
        values([(1, "c", 1), (1, "a", 2), (2, "x", 1), (2, "y", 2)], "query_id", "hash", "new_rank"),
    ),
    "r5_c6_prefilter": (
        lambda s, d: classify.prefiltered(
            frame(s, "batch int, slot int", (1, 1), (1, 2), (1, 3), (1, 4)),
            frame(s, "batch int, slot int, pos int, decision string, confidence double", (1, 1, 1, "reject", 0.9), (1, 1, 2, "keep", 0.9), (1, 2, 1, "reject", 0.4), (1, 3, 1, "keep", 0.1))).select("batch", "slot", "decision"),
        values([(1, 1, "reject"), (1, 2, "keep"), (1, 3, "keep"), (1, 4, "keep")], "batch", "slot", "decision"),
    ),
    "k6_promotion": each(
        "v string, p boolean", lambda: merges.promoted(C("v"), C("p")),
        (None, True, "candidate"), ("reject", True, "candidate"), ("candidate", False, "candidate"), ("reject", False, "reject"), (None, False, None), ("other", True, "other"),
    ),
    "k18_image_counts": (
        lambda s, d: merges.counted_images(frame(s, "ref string", ("a",), ("b",)), frame(s, "ref string", ("a",), ("a",), ("z",))), values([("a", 2), ("b", 0)], "ref", "image_count"),
    ),
    "y14_stalest_probe": (
        lambda s, d: relational.stalest(frame(s, "name string, scanned string", ("c", "2024-01-02"), ("b", None), ("a", "2024-01-01"), ("d", "2024-01-03")), "scanned", "name", 3).select("name"), values([("b",), ("a",), ("c",)], "name"),
    ),
    "s3_y10_optional_columns": (
        lambda s, d: merges.add_missing(merges.add_missing(frame(s, "id int, title string", (1, "t")), title="string", layer2="string"), layer2="string").select("id", "title", F.coalesce("layer2", F.lit("none")).alias("layer2")), values([(1, "t", "none")], "id", "title", "layer2"),
    ),
}
