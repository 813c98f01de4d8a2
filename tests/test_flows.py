"""Queues as a stream, repeated-entity grouping, halved batches, pages, stored formats."""

from __future__ import annotations

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import pages as P
from tessera.operators import batches as B
from tessera.operators import coverage as G
from tessera.sources import readers
from tessera.sources import vector_store as S
from tessera.streaming.queues import Backlog

START = datetime.datetime(2024, 1, 1)


def plain_batches(items, wait):
    """Batches by hand: (account, batch, n, first_id, last_id, full)."""
    by, out = {}, []
    for account, i, ts in sorted(items, key=lambda x: (x[0], x[2], x[1])):
        by.setdefault(account, []).append((ts, i))
    for account, rows in by.items():
        batch, held, last = 0, [], None
        for ts, i in rows:
            if held and (ts - last).total_seconds() > wait:
                out.append((account, batch, len(held), held[0], held[-1], False))
                batch, held = batch + 1, []
            held.append(i)
            last = ts
            if len(held) == 5:
                out.append((account, batch, 5, held[0], held[-1], True))
                batch, held = batch + 1, []
        if held:
            out.append((account, batch, len(held), held[0], held[-1], False))
    return sorted(out)


@pytest.mark.parametrize("stops", [(100,), (40, 41, 90, 100)])
def test_queues_resume(spark, tmp_path, stops):
    """The same batches come out wherever the runs stop; nothing is lost or taken twice."""
    r = random.Random(6)
    items = [(r.randint(-1, 4), i, START + datetime.timedelta(minutes=17 * i + r.choice([0, 0, 400]) * (i // 30))) for i in range(100)]
    items.sort(key=lambda x: x[2])
    backlog = Backlog(spark, str(tmp_path), wait_seconds=7200)
    schema, low = "account long, id long, ts timestamp", 0
    for high in stops:
        backlog.arrive(spark.createDataFrame([*items[low:high], (None, 7, START)], schema))
        backlog.run()
        low = high
    before = {tuple(x) for x in backlog.batches().collect()}
    backlog.close()
    backlog.run()
    got = sorted(tuple(x) for x in backlog.batches().collect())
    assert got == plain_batches(items, 7200) and before <= set(got) and len(before) < len(got)
    backlog.run()
    assert backlog.batches().count() == len(got)


def test_coverage(spark):
    buffers = G.buffered(spark.createDataFrame([
        ("kol", "1", 0, '{"raw_entities": ["Open AI", " open-ai ", 5, null, ""]}'), ("kol", "2", 0, "no json"), ("kol", "2", 1, '{"raw_entities": [{"name": "Open AI"}, {"name": 3}, {"x": 1}]}'),
        ("kol", "3", 0, '{"raw_entities": []}'), ("kol", "3", 1, '{"raw_entities": ["Late"]}'), ("kol", "4", 0, '["Open AI"]'), ("kol", "5", 0, '{"raw_entities": "x"}'), ("kol", "9", 0, '{"raw_entities": ["Alone"]}'),
    ], "source string, ref string, place int, document string"))
    assert {(r.ref, tuple(r.entities)) for r in buffers.collect()} == {("1", ("open-ai",)), ("2", ("open-ai",)), ("3", ()), ("9", ("alone",))}

    entities = spark.createDataFrame([(1, "Graph X", "chunk-none"), (2, " Graph-x ", "chunk-3<SEP>chunk-4"), (3, "!!", "chunk-3")], "pos long, entity_name string, source_id string")
    relations = spark.createDataFrame([(1, "Graph X", "Open AI", "chunk-5|chunk-1"), (2, None, "solo", "chunk-6"), (3, "Graph X!", "b", "other")], "pos long, src_id string, tgt_id string, source_id string")
    chunks = spark.createDataFrame([(f"chunk-{i}", "kol", str(i)) for i in range(1, 8)], "chunk string, source string, ref string")
    graph = G.graph_pairs(entities, relations, chunks)
    # 'Graph X' comes first and leads to articles by its relation; 'Graph-x' has the same slug and counts no more
    assert {(r.entity, r.ref) for r in graph.collect()} == {("graph-x", "5"), ("graph-x", "1"), ("open-ai", "5"), ("open-ai", "1"), ("solo", "6")}

    eligible = spark.createDataFrame([("kol", str(i)) for i in (*range(1, 10), 1, 1)], "source string, ref string")
    answers = spark.createDataFrame([("kol", "3", '{"entities": ["New One", 7, " "]}'), ("kol", "4", '{"entities": []}'), ("kol", "6", '{"entities": ["a", "b", "c", "d"]}'), ("kol", "7", "[]"), ("kol", "8", None), ("kol", "1", '{"entities": ["Unused"]}'), ("kol", "9", '{"entities": ["Alone"]}')], "source string, ref string, answer string")
    articles, jobs = G.discovered(eligible, buffers, graph, answers)
    got = {r.ref: (r.mapped, r["class"]) for r in articles.collect()}
    assert got == {
        "1": ("buffer", "represented"), "2": ("buffer", "represented"), "3": (None, "represented"), "4": (None, "no_wiki_entity"), "5": ("graph", "represented"),
        "6": ("graph", "retry_unresolved"), "7": (None, "retry_unresolved"), "8": (None, "retry_unresolved"), "9": ("buffer", "represented"),
    }
    assert {(r.entity, r.ref) for r in jobs.collect()} == {("open-ai", "1"), ("open-ai", "2"), ("open-ai", "5"), ("new-one", "3"), ("alone", "9")}
    assert {r.name: r.n for r in G.summary(articles, jobs).collect()} == {"eligible": 9, "mapped_by_buffer": 3, "mapped_by_graph": 2, "represented": 5, "no_wiki_entity": 1, "retry_unresolved": 3, "jobs": 3}
    with pytest.raises(G.AccountingError):
        G.check_accounting(9, {"rows": 9, "represented": 8, "no_wiki_entity": 0, "retry_unresolved": 0})
    none, _ = G.discovered(eligible.limit(0), buffers, graph, answers)
    assert none.count() == 0


def test_halved_batches(spark):
    """Only cut-off ranges are asked again, indexes are absolute, and a batch that fails has no answers."""
    asked = spark.sparkContext.accumulator(0)

    def model(rows):
        asked.add(1)
        sizes = [r["size"] for r in rows]
        if None in sizes:
            return None
        if sum(sizes) > 100:
            return B.TRUNCATED
        return [{"index": i, "double": 2 * r["size"]} if r["size"] != 3 else {"double": 0} for i, r in enumerate(rows)]

    sizes = [1] * 40 + [60, 3, *[2] * 38] + [90] * 40 + [1, None, *[1] * 38] + [5] * 7
    df = spark.createDataFrame(list(enumerate(sizes)), "key long, size long")
    got = {r["index"]: json.loads(r.answer) for r in B.halved(df, ["key"], model, batch=40, least=10).collect()}
    expected = {i: {"index": i, "double": 2 * s} for i, s in enumerate(sizes) if i < 80 and s != 3 or i >= 160}
    assert got == expected
    # one call a range: 1, 1 + 2, 1 + 2 + 4 + 8 (90s are never within the limit down to 5 rows), 1, 1
    assert asked.value == 1 + 3 + 15 + 1 + 1
    assert B.halved(df.limit(0), ["key"], model).count() == 0


def test_pages():
    main, body, everything, images = P.renderings(
        '<title>t</title><nav><a href="/n">Nav</a></nav><div class="x RichText">first<p>one <B>two <i>three</i> </B>four<p>five <code>x  y</code><br/>six <a href="u?a=1&amp;b=2">li<b>nk</b></a>'
        '<ul><li>i1<ul><li>n1<li>n2</ul><li>i2</ul><ol><li>a<li>b</ol><pre>\nx  = 1\n  y</pre></div><article>second</article><!-- <p>no --><script>if (a < b) "</p>"</SCRIPT><footer>foot</footer>')
    assert main == "first\n\none **two *three*** four\n\nfive `x y`\nsix [li**nk**](u?a=1&b=2)\n\n- i1\n  - n1\n  - n2\n- i2\n1. a\n2. b\n\n```\nx  = 1\n  y\n```"
    assert body == main + "\n\nsecond" and everything == f"[Nav](/n)\n\n{body}\n\nfoot" and images == []
    # the first selector that has an element, whatever comes first in the page
    assert P.renderings('<article>a</article><p class="RichText">b</p><div class="RichContent-inner">c<p>d')[0] == "c\n\nd"
    images = P.renderings('<img src="data:x" data-src="http://a"><img src="http://b" data-src="http://c"><img data-original="https://d" src="x"><img src="http://e" width="99px"><img src="http://f" width="100"><img src="http://g" width="9%"><img src="http://b"><img alt="x>y" src=/h>')
    assert images[3] == ["http://a", "http://b", "https://d", "http://f", "http://g"] and "![x>y](/h)" in images[2]
    for broken in (None, "", "<", "<p", "</", "<a href='x", "<!--", "<script>x", "&amp", "<b><i></b>x</i>", "<p></div></p>", "<table><td>a<td>b<tr><td>c"):
        assert len(P.renderings(broken)) == 4
    assert P.renderings("a < b &lt; c &copy;")[2] == "a < b < c ©" and P.renderings("<table><td>a<td>b<tr><td>c")[2] == "a | b\n\nc"


def test_page_cascade(spark):
    wall = "Please Sign in to read. "
    long = "word " * 60
    rows = [(1, f"<article>{long}</article>"), (2, f"<article>short</article><p>{long}"), (3, f"<nav>{long}</nav><article>x</article>"), (4, "<p>x"), (5, f"<article>{wall}{long}</article>"), (6, None)]
    df = spark.createDataFrame([(*r, "old", 1) for r in rows], "page_id int, html string, body string, main int")
    out = P.extracted(df)
    assert out.columns == ["page_id", "html", "main", "body", "everything", "images"]
    got = {r.page_id: r.c and r.c.method for r in out.select("page_id", P.cascade(F.col("main"), F.col("body"), F.col("everything")).alias("c")).collect()}
    assert got == {1: "main", 2: "body", 3: "everything", 4: None, 5: None, 6: None}
    assert P.extracted(df.limit(0)).count() == 0


def test_vector_store(spark, tmp_path):
    rows = [(f"id{i}", json.dumps({"k": i}), [float(i), 0.5, -1.0]) for i in range(23)]
    df = spark.createDataFrame(rows, "id string, payload string, vector array<float>")
    path = str(tmp_path / "store")
    S.write_store(df, path, 3, rows=4)
    back = S.read_store(spark, path, 3, pages=2)
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)
    assert back.rdd.getNumPartitions() >= 3
    assert [tuple(r) for r in S.inventory(spark, path).collect()] == [(3, 23)]
    assert tuple(S.round_trip(df, back).first()) == (20, 1.0, 1.0)
    with pytest.raises(Exception, match="not stored: id"):
        S.round_trip(df, back.limit(3)).collect()
    for call in (lambda: S.read_store(spark, path, 4).count(), lambda: S.write_store(df, str(tmp_path / "other"), 4)):
        with pytest.raises(Exception, match="3 dimensions, not 4"):
            call()
    with pytest.raises(Exception, match="different dimensions"):
        S.write_store(spark.createDataFrame([("a", None, [1.0]), ("b", None, [1.0, 2.0])], df.schema).coalesce(1), str(tmp_path / "mixed"))
    manifest = tmp_path / "store" / S.MANIFEST
    held = json.loads(manifest.read_text())
    manifest.write_text(json.dumps(held | {"rows": 24}))
    with pytest.raises(Exception, match="pages have 23 rows, the store 24"):
        S.read_store(spark, path).count()
    manifest.write_text(json.dumps(held))
    page = tmp_path / "store" / held["pages"][0][0]
    content = json.loads(page.read_text())
    page.write_text(json.dumps(content | {"data": content["data"][1:]}))
    with pytest.raises(Exception, match="matrix holds"):
        S.read_store(spark, path).count()
    S.write_store(df.limit(0), str(tmp_path / "none"))
    assert S.read_store(spark, str(tmp_path / "none")).count() == 0


def test_xml_sources(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g/a.graphml").write_text('<?xml version="1.0"?><graphml xmlns="http://x"><key id="label"/><graph edgedefault="undirected"><node id="n1"><data key="label"> Zed </data><data key="d">5</data></node><node id="n2"/><edge source="n1" target="n2"><data key="w">1</data></edge></graph></graphml>')
    (tmp_path / "g/b.graphml").write_text('<graphml><graph><node id="n2"><data key="label"></data></node></graph></graphml>')
    (tmp_path / "g/c.graphml").write_text('<graphml><graph><node id="n9"><data')
    path = str(tmp_path / "g")
    assert tuple(readers.graph_counts(spark, path).first()) == (3, 1)
    assert [r.name for r in readers.graph_entities(spark, path).collect()] == ["Zed", "n2"] and readers.graph_entities(spark, path, 1).count() == 1
    (tmp_path / "f.opml").write_text('<opml><head><title>x</title></head><body><outline text="folder"><outline type="rss" text="T" title="" xmlUrl="http://x" htmlUrl="h"/><outline type="rss" text="no"/></outline><outline type="rss" title="A &amp; B" text="t" xmlUrl="http://y"/><outline type="link" text="z" xmlUrl="http://z"/></body></opml>')
    got = sorted(tuple(r) for r in readers.opml_feeds(spark, str(tmp_path / "f.opml")).collect())
    assert got == [("A & B", "http://y", None), ("T", "http://x", "h")]
