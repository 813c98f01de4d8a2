"""Cases of a review: larger tables, cut-off references, ties and words at the edge of other scripts."""

from __future__ import annotations

import random
import time
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import pages as P
from tessera.functions import text as X
from tessera.operators import exports as E
from tessera.operators import neighbours as N
from tessera.operators import relational as R
from tessera.operators.text_index import TextIndex
from tessera.operators import wiki
from tessera.operators import search as V
from tessera.plans import catalog, export_queries, stream_queries


def test_page_counts_all_rows(spark):
    rows = spark.range(10_050).select("id", F.lit("rss").alias("source"), F.format_string("%06d", "id").alias("update_time"))
    got = R.page(rows, 670, 15).collect()
    assert [r.id for r in got] == list(range(14, -1, -1)) and {(r.total, r.has_more) for r in got} == {(10_050, False)}


def test_last_description_among_ties(spark):
    rows = [("e", 7, "late", "chunk-1", 2), ("e", 7, "first", "chunk-2", 0), ("e", 7, "", "chunk-1", -1), ("e", 3, "old", "chunk-1", -2)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "entity_name string, pos long, content string, source_id string, row long").repartition(4)
        assert [tuple(r) for r in E.entity_chunks(df, "row").collect()] == [("e", "first", 2)]


def test_cut_off_references():
    page = "<h1>a &amp;&amp</h1><p>&copy; &#65; &quot"
    assert P.renderings(page, P.terminated)[2] == "# a &&amp\n\n© A &quot" and P.renderings(page)[2] == '# a &&\n\n© A "'


def test_tags_at_word_edges(spark):
    rows = spark.createDataFrame([("órag x",), ("fragx",), ("a RAG",)], "t string")
    assert [r[0] for r in rows.select(X.keyword_tags(F.col("t"), edge=X.ASCII_EDGE)).collect()] == [["RAG"], [], ["RAG"]]
    assert [r[0] for r in rows.select(X.keyword_tags(F.col("t"))).collect()] == [[], [], ["RAG"]]


def test_images_are_cut_before_contexts_meet_them(spark):
    contexts = spark.createDataFrame([(i, "see 0123456789") for i in range(3)], "id int, text string")
    images = spark.range(1000).select(F.lit("0123456789").alias("hash"), F.format_string("%04d.png", "id").alias("filename"))
    out = V.retrieved(contexts, images, 4)
    assert {(r.id, r.value) for r in out.where("kind = 'image'").collect()} == {(i, f"0123456789/{k:04}.png") for i in range(3) for k in range(4)}
    join = out._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1]
    assert "row_number" in join


def test_grams_of_a_long_text(spark):
    rows = spark.createDataFrame([("ÄB😀b",), ("ab",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(V.grams(F.col("t"))).collect()] == [["äb😀", "b😀b"], [], [], []]
    start = time.perf_counter()
    long = spark.range(1).select(F.repeat(F.lit("abcdefghij klm "), 20_000).alias("t"))
    assert long.select(F.size(V.grams(F.col("t")))).first()[0] == 15 and time.perf_counter() - start < 30


def test_contradictions_do_not_broadcast(spark):
    rows = spark.createDataFrame([(1, "Alpha Beta 1999"), (2, "Alpha Beta 2001")], "id long, text string")
    plan = R.contradictions(rows, rows)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_only_frontmatter_is_parsed_in_python(spark):
    texts = ["---\na: b\n---\nbody\n---\n", "---\n\n---", "---\n---\nx", "---\na: b\nno end", "x\n---\n", "", None]
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "text string").select(wiki.parted(F.col("text")).alias("p")).select("p.*").collect()]
    assert got == [("a: b", "body\n---\n"), ("", ""), (None, "---\n---\nx"), (None, "---\na: b\nno end"), (None, "x\n---\n"), (None, ""), (None, "")]


def test_index_of_many_blocks(spark, tmp_path):
    """Places in a block take two bytes; documents that went are not counted, in whichever block they are."""
    with pytest.raises(ValueError, match="a block has"):
        TextIndex(spark, str(tmp_path), block_documents=70_000)
    index = TextIndex(spark, str(tmp_path), parts=4, block_documents=7)
    docs = spark.range(40).select(F.col("id").cast("string").alias("key"), F.lit("lorem").alias("text")).repartition(3)
    index.refresh(docs, F.col("text"))
    assert dict(index._read("postings").dtypes)["ids"] == "array<int>" and index.postings("lorem")[0].where("n > 7").count() == 0
    index.refresh(docs.where("key % 3 > 0"), F.col("text"))
    assert [r.n for r in index.posting_counts().collect()] == [26] * 3
    assert index.hits("lorem", F.col("text")).count() == 26


def test_nearest_in_blocks():
    r = np.random.default_rng(3)
    queries, members = ({"rep": r.permutation(n), "vector": list(np.round(r.normal(size=(n, 8)) * 2) + 0.5)} for n in (3000, 4000))
    q, m = (np.array(t["vector"]) / np.linalg.norm(t["vector"], axis=1, keepdims=True) for t in (queries, members))
    least = np.where(np.arange(3000) % 2 == 0, -2.0, 0.95)
    queries = pa.table(queries | {"least": least})
    members = pa.table(members | {"ids": pa.array([[x] for x in members["rep"]], pa.list_(pa.int64()))})
    tracemalloc.start()
    got = N.best(queries, members, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # all similarities at once are 96 MB
    rep = members["rep"].to_numpy()
    expected = []
    for i in range(0, 3000, 50):
        near = np.round(m @ q[i], N.DIGITS)
        expected += [(queries["rep"][i].as_py(), near[j], rep[j]) for j in np.lexsort((rep, -near))[:4] if near[j] >= least[i]]
    some = set(queries["rep"].to_numpy()[::50].tolist())
    rows = [(a, b, c[0]) for a, b, c in zip(*(got[c].to_pylist() for c in ("query", "similarity", "ids")), strict=True) if a in some]
    assert rows == expected


def test_chunks_and_edits_stay_in_the_jvm(spark):
    t = "aaaa\n\nbb\n\n" + "c" * 12 + "\n😀\nd\n\n" + "e" * 5 + "\n\n"
    rows = spark.createDataFrame([(t, "---\ntitle: a\n---\nsee ## News\n## News \nold\n## More\n"), (None, None)], "t string, p string")
    page = wiki.with_section(wiki.with_metadata("p", F.lit("title"), F.lit("$1 \\x")), F.lit("News"), F.lit(" y\x1c "))
    out = rows.select(X.body_chunks(F.col("t"), F.lit(5)).alias("c"), page.alias("p"))
    assert [tuple(r) for r in out.collect()] == [
        (["", "aaaa", "bb", "ccccc", "ccccc", "cc", "😀\nd", "", "eeeee"], "---\ntitle: $1 \\x\n---\nsee ## News\n## News\n\ny\n\n## More\n"),
        ([""], "## News\n\ny\n"),
    ]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def against_sql(spark, folder, name):
    """A query's rows over the folder's tables, and those of its SQL."""
    con = duckdb.connect()
    for path in folder.iterdir():
        con.execute(f"CREATE VIEW {path.name.split('.')[0]} AS SELECT * FROM '{path}/*.parquet'")
    got = catalog.queries()[name](spark, str(folder))
    rows = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in got.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.collect())), sorted(rows)


def test_backlog_is_cut_once(spark, tmp_path, monkeypatch):
    """Of 16 events of one account the fifth, at which the first part ends, and the sixth round to one millisecond; the tenth and eleventh do not."""
    ids, micros = {4: 90, 9: 80}, {5: "04.000400", 9: "09.000400", 10: "09.000600"}
    rows = [(ids.get(i, 7 + i), 1, f"2024-01-01 00:00:{micros.get(i, f'{i:02}.000100')}") for i in range(16)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    plans = []
    arrive = stream_queries.Backlog.arrive

    def seen(self, items):
        plans.append(items._jdf.queryExecution().optimizedPlan().toString())
        arrive(self, items)

    monkeypatch.setattr(stream_queries.Backlog, "arrive", seen)
    got, expected = against_sql(spark, tmp_path, "x1_x4_queues")
    assert got == expected and [r[3:5] for r in got] == [(7, 12), (90, 80), (17, 21), (22, 22)]
    assert len(plans) == 3 and not any("Aggregate" in p for p in plans)


def test_cut_titles_give_no_keyword(spark, tmp_path):
    texts = ["bo la, raga ciónírr", "Un raga", "del un Rag", "plain words"]
    docs = spark.createDataFrame([(i, t, "es", "src1", len(t)) for i, t in zip((9, 13, 19, 27), texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got, expected = against_sql(spark, tmp_path, "p20_export_items")
    assert got == expected and len(got) == 4
    titles = E.items(export_queries.candidates(spark, str(tmp_path))).select("id", F.array_join("tags", "|")).collect()
    assert dict(map(tuple, titles)) == {9: "es|MCP|RAG", 13: "es|MCP|推理优化", 19: "es|MCP|RAG", 27: "es|MCP|推理优化"}


def test_contradictions_in_rounds(spark, monkeypatch):
    """Rounds of few sentences, and ids of several ones, whose words count together as in the SQL of J25; what is found is not asked again."""
    monkeypatch.setattr(R, "GROWTH", 3)
    r = random.Random(7)
    names = [f"W{i}" for i in range(30)]
    new, old = ([(r.randrange(n * 2 // 3), " ".join(r.choices(names, k=r.randint(1, 4))) + f" {r.choice(['1998', '1999', '2000'])}") for _ in range(n)] for n in (60, 90))
    tables = {"new": new, "old": old}
    con = duckdb.connect()
    for t, rows in tables.items():
        con.execute(f"CREATE TABLE {t} (id BIGINT, year VARCHAR, words VARCHAR[])")
        con.executemany(f"INSERT INTO {t} VALUES (?, ?, ?)", [(i, s.split()[-1], sorted(set(s.split()[:-1]))) for i, s in rows])
    sql = "WITH nw AS (SELECT id, year, unnest(words) AS w FROM new), ow AS (SELECT id, year, unnest(words) AS w FROM old) SELECT new_id, min(old_id) FROM (SELECT nw.id AS new_id, ow.id AS old_id FROM nw JOIN ow ON nw.w = ow.w AND nw.year <> ow.year GROUP BY nw.id, ow.id HAVING count(*) >= 2) GROUP BY new_id"
    expected = sorted(con.execute(sql).fetchall())
    asked = []
    among = R.among
    monkeypatch.setattr(R, "among", lambda pairs, bits: asked.append(pairs.columns) or among(pairs, bits))
    for first in (4, 0):
        got = R.contradictions(*[spark.createDataFrame(x, "id long, text string") for x in (new, old)], first)
        assert sorted(map(tuple, got.collect())) == expected and len(expected) > 20
    assert len(asked) > 3


def test_queries_are_sent_to_many_chunks_in_bounded_batches():
    r = np.random.default_rng(5)
    vectors = r.normal(size=(3000, 8)).astype(np.float32)
    pivots = N.unit(r.normal(size=(20, 8)))
    chunks = r.integers(0, 40, 20)
    first, radius = np.cumsum(chunks) - chunks, r.random(20) + 0.5
    least = np.where(np.arange(3000) % 3 == 0, -2.0, 0.8)
    part = r.integers(0, chunks.sum(), 3000).astype(np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(list(vectors), pa.list_(pa.float32())), pa.array(part), pa.array(least)], ["rep", "vector", "part", "least"])
    sizes, rows = [], []
    for out in N.sent(iter([batch]), pivots, chunks, first, radius, 2000):
        sizes.append(out.num_rows)
        rows += zip(out["rep"].to_pylist(), out["part"].to_pylist(), strict=True)
    assert max(sizes) <= 2000 and len(rows) > 500_000
    away = np.sqrt(np.maximum(0, 2 - 2 * N.unit(vectors.astype(np.float64)) @ pivots.T))
    within = np.sqrt(2 - 2 * (least - 10.0**-N.DIGITS)) + 1e-9
    expected = [(i, p) for i in range(3000) for c in np.flatnonzero(away[i] - radius <= within[i]) for p in range(first[c], first[c] + chunks[c]) if p != part[i]]
    assert rows == expected
