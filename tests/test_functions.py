"""Golden rows of scalar functions, and properties that must hold for any text."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates as D
from tessera.functions import identity, predicates
from tessera.functions import text as X


def one(spark, column, **values):
    schema = ", ".join(f"`{k}` {t}" for k, (t, _) in values.items()) or "z int"
    row = tuple(v for _, v in values.values()) or (0,)
    return spark.createDataFrame([row], schema).select(column.alias("r")).first()["r"]


def s(value):
    return ("string", value)


C = F.col


@pytest.mark.parametrize(("function", "given", "expected"), [
    (X.slug, "  Open AI/GPT & Co ", "open-aigpt-co"), (X.slug, "叶小钗 老师", "叶小钗-老师"), (X.slug, None, ""),
    (X.ascii_slug, "中文", "untitled"), (X.ascii_slug, "--A  b!!", "a-b"),
    (X.reading_minutes, "", 0), (X.reading_minutes, "word " * 625, 2), (X.reading_minutes, "字" * 1250, 2), (X.reading_minutes, "<b>x</b>", 1),
    (X.language_by_share, "你好吗 hello", "zh"), (X.language_by_share, "你 hello world", "en"), (X.language_by_head, "", None),
    (X.source_domain, "https://WWW.Example.com/x", "example.com"), (X.source_domain, "ftp://a.b", None),
    (X.sentences, "A b. C d! E", ["A b.", "C d!", "E"]), (X.paragraphs, "a\n\n b \n \n\n", ["a", "b"]),
    (X.image_blocks, 'x ![a](b) <img src="c"> y', ["![a](b)", '<img src="c">']),
    (X.image_urls, '<img src="c"> ![a](b) ![q](b)', ["b", "c"]),
    (X.image_references, "Image 3 from article 'T': /static/img/h/3.jpg", '<img src="/static/img/h/3.jpg" alt="image 3" loading="lazy">'),
    (X.without_external_images, "a ![x](https://mmbiz.qpic.cn/1) b", "a  b"),
    (X.without_metadata_header, "# T\n\nURL: http://x\nTime: 2024-01-02 03:04:05\n\n# T\n\nbody", "body"),
    (X.without_repeated_headings, "# A\n\n# A\ntext\n# A", "# A\n\ntext\n# A"),
    (X.linked_citations, "see [0123456789] and [x](y)", "see [012345](articles/0123456789.html) and [x](y)"),
    (X.old_image_urls, "http://localhost:8765/a/1.jpg", "/static/img/a/1.jpg"), (X.source_chunks, "chunk-1<SEP>x|chunk-2", ["chunk-1", "chunk-2"]),
    (X.keyword_tags, "MCP and 智能体", ["MCP", "Agent"]), (X.question_keywords, "什么是AI Agent", ["AI", "Agent"]), (X.question_keywords, "什么是 the", []),
    (X.card_snippet, "# T\n\nURL: https://x.y/z\n**bold** [link](u) `code`", "T bold** link"),
    (D.feed_time, "Wed, 02 May 2026 17:26:40 +0000", "2026-05-02T17:26:40+00:00"),
])
def test_golden(spark, function, given, expected):
    column = function(C("x"), F.lit("f")) if function is D.feed_time else function(C("x"))
    assert one(spark, column, x=s(given)) == expected


def test_times(spark):
    assert one(spark, D.feed_time(C("x"), F.lit("2026-01-01 00:00:00")), x=s("nonsense")) == "2026-01-01 00:00:00"
    assert one(spark, D.epoch_to_iso(C("x")), x=("bigint", 1777249680)) == "2026-04-27T00:28:00+00:00"
    assert one(spark, D.epoch_to_iso(C("x")), x=("bigint", None)) == ""
    now = F.lit(date(2024, 9, 10))
    for value, zh, en in (("2024-09-10T05:00:00Z", "今天", "Today"), ("2024-09-09", "1 天前", "1 day ago"), ("Wed, 04 Sep 2024 04:31:00 GMT", "6 天前", "6 days ago"), ("1700000000", "2023 年 11 月 14 日", "Nov 14, 2023"), ("soon", "soon", "soon"), (None, "", "")):
        assert one(spark, D.humanized(C("x"), now), x=s(value)) == zh
        assert one(spark, D.humanized(C("x"), now, "en"), x=s(value)) == en


def test_identity(spark):
    assert one(spark, identity.display_hash(F.lit("wechat"), C("h"), F.lit("u")), h=s(None)) == "7b774effe4"
    assert one(spark, identity.display_hash(F.lit("rss"), C("h"), F.lit("u")), h=s("0123456789abcdef")) == "0123456789"
    with pytest.raises(Exception, match="unknown source"):
        one(spark, identity.display_hash(F.lit("other"), C("h"), F.lit("u")), h=s("x"))
    assert len(one(spark, identity.point_id(C("x")), x=s("k"))) == 36


def test_predicates(spark):
    ok = lambda b, l1, l2: one(spark, predicates.display_ok(C("b"), C("l1"), C("l2")), b=s(b), l1=s(l1), l2=s(l2))
    assert ok("x", "candidate", "ok") and not ok("", "candidate", "ok") and not ok("x", "candidate", None) and not ok(None, "candidate", "ok")
    assert one(spark, predicates.lenient_ok(C("x")), x=s(None)) and not one(spark, predicates.lenient_ok(C("x")), x=s("reject"))
    assert not one(spark, predicates.passes_quality_gate(C("x")), x=s("请先登录" + "a" * 300))
    assert one(spark, predicates.scrape_failed(C("x"), F.lit(None).cast("int")), x=s("")) is False
    with pytest.raises(ValueError, match="mode"):
        predicates.candidate_filter("none", C("a"), C("b"), C("c"))
    assert one(spark, predicates.evidence_violations(F.lit("web"), C("x"), F.lit("t"), F.lit(" ")), x=s(None)) == ["missing ref", "missing quote"]


def test_rewrites_are_idempotent(spark):
    texts = ["http://localhost:8765/a.jpg", "[0123456789]", "![a](https://mmbiz.qpic.cn/1)x", "Image 1 from article 'x': /u", "# a\n\n# a\nb"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for f in (X.image_paths, X.linked_citations, X.without_external_images, X.image_references, X.without_repeated_headings):
        once = df.withColumn("y", f(C("x"))).withColumn("z", f(C("y")))
        assert once.where("y != z").count() == 0


def test_stateful_text(spark):
    body = "p1\n\np2\n\np3\n\np4"
    assert one(spark, X.spliced(C("b"), F.array(F.lit("![](i)"))), b=s(body)) == "p1\n\np2\n\n![](i)\n\np3\n\np4"
    chunks = one(spark, X.body_chunks(C("b"), F.lit(10)), b=s("aaaa\n\nbbbb\n\n" + "c" * 25))
    assert chunks == ["aaaa\n\nbbbb", "c" * 10, "c" * 10, "c" * 5]
    assert one(spark, X.one_reference_section(C("b")), b=s("t\n## References\n- x\n## References\n- [a](b)\n")) == "t\n## References\n- [a](b)\n"
