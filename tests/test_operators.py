"""The shared fixture of section 5 and hand-made tables with known answers."""

from __future__ import annotations

import base64
import json
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import aggregates as G
from tessera.operators import classify as K
from tessera.operators import merges as M
from tessera.operators import relational as R
from tessera.operators import search as V
from tessera.sources import readers
from tessera.streaming import events as E


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_centrality_of_three_edges(spark):
    edges = spark.createDataFrame([("A", "B", "c1"), ("B", "C", "c2"), ("B", "A", "c3")], "src_id string, tgt_id string, source_id string")
    got = G.ranked(G.centrality(edges), F.desc("score"), F.desc("degree"), F.col("entity"))
    assert rows(got, "rank", "entity", "degree", "neighbours", "score") == [(1, "B", 3, 2, 5), (2, "A", 2, 1, 3), (3, "C", 1, 1, 2)]


def test_entity_gate(spark):
    mentions = spark.createDataFrame([(i, "OpenAI") for i in range(5)] + [(1, "Lib"), (2, "Lib"), (2, "Lib")], "article_id long, entity_name string")
    assert R.articles_of_entity(mentions, "OpenAI", 5).count() == 5
    assert R.articles_of_entity(mentions, "Lib", 5).count() == 0 and R.articles_of_entity(mentions, "Lib", 2).count() == 2


def test_source_aware_keys(spark):
    articles = spark.createDataFrame([("wechat", 95), ("rss", 95)], "source string, id long")
    done = spark.createDataFrame([("wechat", 95, "ok")], "source string, article_id long, status string")
    assert rows(R.candidate_pool(articles, done)) == [("rss", 95)]


def test_hash_lookup_prefers_accounts_and_keeps_order(spark):
    articles = spark.createDataFrame([("rss", 1, "h"), ("wechat", 2, "h"), ("rss", 3, "g")], "source string, id long, hash string")
    wanted = spark.createDataFrame([(0, "g"), (1, "h"), (2, "g"), (3, "none")], "pos int, hash string")
    assert [(r.pos, r.id) for r in R.by_hashes(wanted, articles).collect()] == [(0, 3), (1, 2), (2, 3)]


def test_contradictions(spark):
    new = spark.createDataFrame([(1, "OpenAI released GPT in 2022."), (2, "OpenAI and GPT, no year")], "id int, text string")
    old = spark.createDataFrame([(7, "OpenAI showed GPT in 2020."), (8, "OpenAI and GPT of 2022.")], "id int, text string")
    assert rows(R.contradictions(new, old)) == [(1, 7)]


def test_reconcile(spark):
    got = spark.createDataFrame([("ok", "Processed"), ("ok", None), ("failed", "processed"), ("failed", "pending")], "s string, d string")
    assert rows(got.select(G.reconcile_class(F.col("s"), F.col("d")).alias("c"))) == [("expected_failure",), ("ghost",), ("matched",), ("mystery",)]


def test_merges(spark):
    old = spark.createDataFrame([("u1", 1)], "url string, id int")
    new = spark.createDataFrame([("u1", 2), ("u2", 3), ("u2", 4), (None, 5)], "url string, id int")
    state = M.insert_or_ignore(old, new, "url", F.col("id"))
    assert rows(state) == [("u1", 1), ("u2", 3)]
    assert rows(M.insert_or_ignore(state, new, "url", F.col("id"))) == rows(state)
    up = M.upsert(old, spark.createDataFrame([("u1", None), ("u3", 9)], "url string, id int"), ["url"])
    assert {tuple(r) for r in up.collect()} == {("u1", None), ("u3", 9)}
    filled = M.upsert(old, spark.createDataFrame([("u1", None)], "url string, id int"), ["url"], fill=True)
    assert rows(filled) == [("u1", 1)]
    assert M.add_missing(M.add_missing(old, lang="string"), lang="string").columns == ["url", "id", "lang"]


def test_phrase_search(spark):
    docs = spark.createDataFrame([("a", "t", "an agent here", "en"), ("b", "Agent", "agent agent", "en"), ("c", "t", "100% sure", "en")], "hash string, title string, body string, lang string")
    hits = V.phrase_search(docs, " AGENT ", 10).collect()
    assert [h.hash for h in hits] == ["b", "a"]
    assert V.phrase_search(docs, "ag").count() == 0 and V.phrase_search(docs, '0% "').count() == 0
    index = V.gram_index(docs, "hash", F.col("body"))
    assert rows(V.index_candidates(index, "hash", "agent")) == [("a",), ("b",)]


def test_vectors_and_modes(spark):
    v = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0]), ("z", [0.0, 0.0])], "id string, vector array<float>")
    assert [r.id for r in V.nearest(v, [2.0, 1.0], "id", "vector", 2).collect()] == ["x", "y"]
    edges = spark.createDataFrame([("e", "x", "y", [0.0, 1.0])], "id string, src_id string, tgt_id string, vector array<float>")
    assert rows(V.graph_context("local", v, v, edges, [1.0, 0.0], 1), "kind", "id") == [("entity", "x"), ("relation", "e")]
    assert rows(V.graph_context("global", v, v, edges, [0.0, 1.0], 1), "kind", "id") == [("entity", "x"), ("entity", "y"), ("relation", "e")]
    assert rows(V.graph_context("naive", v, v, edges, [1.0, 0.0], 1), "kind", "id") == [("chunk", "x")]
    with pytest.raises(ValueError, match="mode"):
        V.graph_context("other", v, v, edges, [1.0], 1)


def test_verdict_batches():
    data = [{"title": "a"}, {"title": "b"}]
    good = json.dumps([{"verdict": "candidate"}, {"verdict": "reject"}])
    assert K.layer1(data, lambda r: good) == [("candidate", None), ("reject", None)]
    assert K.layer1(data, lambda r: "[]") == [(None, "row_count_mismatch")] * 2
    assert K.layer1(data, lambda r: "no") == [(None, "bad_json")] * 2
    assert K.layer1(data, lambda r: 1 / 0)[0] == (None, "model_error: ZeroDivisionError")
    deep = json.dumps({"results": [{"relevant": True, "depth": 2}, {"relevant": True, "depth": 1}]})
    assert [x[0] for x in K.layer2(data, lambda r: deep)] == ["ok", "reject"]


def test_answers(spark):
    a = lambda c, t: spark.createDataFrame([(t,)], "x string").select(c(F.col("x")).alias("r")).first()["r"]
    assert a(K.semantic_result, '{"decision": "APPLY", "sections": [{"heading": "H", "content": "c"}]}') == "APPLY"
    assert a(K.semantic_result, '{"decision": "APPLY", "sections": [{"heading": "H", "content": "c"}, {"heading": "h", "content": "d"}]}') is None
    assert a(K.semantic_result, '{"decision": "RETRY", "confidence": 1}') is None and a(K.semantic_result, "junk") is None
    assert tuple(a(K.agent_decision, "not json")) == (True, "not json", 0.0)
    assert tuple(a(K.agent_decision, '{"final": true, "text": "t", "confidence": "250"}')) == (True, "t", 100.0)


def test_patch_policy(spark):
    ops = lambda *names: F.array(*[F.struct(F.lit(n).alias("op"), F.array(*[F.lit(k) for k in keys]).cast("array<string>").alias("keys")) for n, keys in names])
    t, f = F.lit(True), F.lit(False)
    df = spark.range(1)
    cls = lambda o, *a: df.select(K.patch_class(o, *a).alias("c")).first()["c"]
    assert cls(ops(("DELETE_PAGE", [])), t, t, f, t) == "rejected"
    assert cls(ops(("CREATE_PAGE", [])), f, f, f, t) == "auto_apply" and cls(ops(("CREATE_PAGE", [])), t, f, f, t) == "suggestion_only"
    assert cls(ops(("SET_METADATA", ["title"])), t, t, f, t) == "suggestion_only" and cls(ops(("SET_METADATA", ["last_updated"])), t, f, f, t) == "auto_apply"
    assert cls(ops(("UPSERT_SECTION", [])), t, t, t, f) == "suggestion_only" and cls(ops(("UPSERT_SECTION", [])), t, t, f, f) == "auto_apply"


def test_readers(spark):
    status = spark.createDataFrame([('{"wechat_1": {"status": "processed", "chunks_list": ["c"]}, "rss_2": {"status": "failed"}}',)], "value string")
    assert rows(readers.key_values(status).select("key", "value.status")) == [("rss_2", "failed"), ("wechat_1", "processed")]
    row = T.StructType([T.StructField("entity_name", T.StringType())])
    both = spark.createDataFrame([('{"embedding_dim": 2, "data": [{"entity_name": "A"}]}',), ('[{"entity_name": "B"}]',)], "value string")
    assert rows(readers.store_rows(both, row)) == [("A",), ("B",)]
    packed = base64.b64encode(struct.pack("<4f", 1, 2, 3, 4)).decode()
    m = spark.createDataFrame([(packed, ["a", "b"])], "matrix string, ids array<string>")
    assert [tuple(r) for r in readers.matrix_rows(m, 2).collect()] == [("a", [1.0, 2.0]), ("b", [3.0, 4.0])]
    with pytest.raises(Exception, match="rows for"):
        readers.matrix_rows(m, 4).collect()
    with pytest.raises(ValueError, match="missing columns: body"):
        readers.require_columns(m, "body", "ids")


def test_streaming_matches_batch_and_resumes(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src)
    folder = tmp_path / "in"
    batch.repartition(3).write.parquet(str(folder))
    seen = []
    stream = E.read_folder(spark, str(folder), batch.schema)
    E.drain(stream, str(tmp_path / "cp"), lambda df, n: seen.append(df.count()))
    assert sum(seen) == batch.count() and len(seen) == 3
    E.drain(stream, str(tmp_path / "cp"), lambda df, n: seen.append(df.count()))
    assert sum(seen) == batch.count()
    # one batch: with random files some rows would be later than the watermark
    batch.coalesce(1).write.parquet(str(tmp_path / "one"))
    counted = E.tumbling(E.timed(E.read_folder(spark, str(tmp_path / "one"), batch.schema)))
    q = counted.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("windows")) == rows(E.tumbling(E.timed(batch)))


def test_settled(spark):
    polls = spark.createDataFrame([(1, 1, "processed"), (1, 2, "processed"), (2, 1, "processed"), (2, 2, "failed"), (2, 3, "processed")], "k int, t int, s string")
    assert rows(E.settled(polls, "k", "t", "s")) == [(1, True), (2, False)]


def test_text_index_holds_bodies(spark):
    """A phrase that stands only in the body is a candidate."""
    from tessera.plans import catalog
    from tessera.sources import analogs as A

    folder = "/root/testdata/sf0.001"
    got = {r.key for r in catalog.queries()["v1_k12_text_index"](spark, folder).collect()}
    body = A.unified(spark, folder).where("contains(lower(body), 'tion') and not contains(lower(title), 'tion')")
    below = {r.key for r in body.select(F.concat_ws("_", "source", "id").alias("key")).collect()}
    assert below and below <= got
