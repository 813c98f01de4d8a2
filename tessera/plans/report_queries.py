"""Queries of aggregations, merges, retrieval, rules and windows (sections 2.2, 2.5, 2.11-2.13, 2.16)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.functions import identity
from tessera.functions import text as X
from tessera.operators import aggregates as G
from tessera.operators import classify as K
from tessera.operators import merges as M
from tessera.operators import relational as R
from tessera.operators import search as V
from tessera.sources import analogs as A
from tessera.sources import readers
from tessera.streaming import events as E

C = F.col
_Q = [0.125 if i < 32 else -0.125 for i in range(64)]
_QS = "[" + ", ".join(str(x) for x in _Q) + "]::double[]"
_COS = f"round(list_inner_product(embedding::double[], {_QS}) / (sqrt(list_inner_product(embedding::double[], embedding::double[])) * sqrt(list_inner_product({_QS}, {_QS}))), 6)"


def ev(s, d):
    return A.table(s, d, "events").withColumn("ts", C("ts").cast("timestamp"))


QUERIES = {
    "a1_frequency": (lambda s, d: R.article_frequency(A.mentions(s, d)), A.with_tables("SELECT entity_name, count(DISTINCT article_id) AS freq FROM mentions GROUP BY 1", "mentions")),
    "a4_entity_languages": (
        lambda s, d: G.entity_languages(A.mentions(s, d), A.unified(s, d)),
        A.with_tables("SELECT entity_name, sum((lang = 'en')::int) AS en, sum((lang = 'de')::int) AS de, count(DISTINCT article_id) AS total FROM mentions JOIN unified ON article_id = id GROUP BY 1 HAVING count(DISTINCT article_id) >= 5", "mentions", "unified"),
    ),
    "a5_grouped_counts": (lambda s, d: G.grouped_counts(A.ingestions(s, d), "status", "event_type"), A.with_tables("SELECT status, event_type, count(*) AS n FROM ingestions GROUP BY GROUPING SETS ((status), (event_type), ())", "ingestions")),
    "a6_status_counts": (lambda s, d: G.status_counts(A.ingestions(s, d), "source", "status"), A.with_tables("SELECT source, status, count(*) AS n FROM ingestions GROUP BY 1, 2", "ingestions")),
    "a8_a9_day_summary": (
        lambda s, d: G.day_summary(A.ingestions(s, d), F.date_format("ingested_at", "yyyy-MM-dd")).withColumn("last_ok", F.date_format("last_ok", "yyyy-MM-dd HH:mm:ss")),
        A.with_tables("SELECT strftime(ingested_at, '%Y-%m-%d') AS day, source, count(*) AS n, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'failed') AS failed, strftime(max(CASE WHEN status = 'ok' THEN ingested_at END), '%Y-%m-%d %H:%M:%S') AS last_ok FROM ingestions GROUP BY 1, 2", "ingestions"),
    ),
    "a10_joined_topics": (lambda s, d: G.joined_topics(A.ingestions(s, d).select("article_id", C("event_type").alias("topic"))), A.with_tables("SELECT article_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS topics FROM ingestions GROUP BY 1", "ingestions")),
    "a11_language_coverage": (lambda s, d: G.language_coverage(A.unified(s, d)), A.with_tables("SELECT coalesce(lang, 'NULL') AS lang, count(*) AS n FROM unified GROUP BY 1", "unified")),
    "a12_time_histogram": (lambda s, d: A.ingestions(s, d).groupBy(G.time_bucket(C("value") * 10).alias("bucket")).agg(F.count("*").alias("n")), A.with_tables("SELECT CASE WHEN value * 10 < 60 THEN '0-60s' WHEN value * 10 < 300 THEN '60-300s' WHEN value * 10 < 900 THEN '300-900s' ELSE '900s+' END AS bucket, count(*) AS n FROM ingestions GROUP BY 1", "ingestions")),
    "a13_batch_metrics": (
        lambda s, d: G.batch_metrics(A.ingestions(s, d), "article_id", "value", C("status") == "ok", C("status") == "failed").withColumns({"mean_ok": F.round("mean_ok", 6), "ok_share": F.round("ok_share", 6)}),
        A.with_tables("SELECT article_id, count(*) AS n, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'failed') AS failed, round(coalesce(avg(value) FILTER (status = 'ok'), 0), 6) AS mean_ok, round(coalesce(count(*) FILTER (status = 'ok') / nullif(count(*) FILTER (status IN ('ok', 'failed')), 0)::double, 0), 6) AS ok_share FROM ingestions GROUP BY 1", "ingestions"),
    ),
    "a14_w1_centrality": (
        lambda s, d: G.ranked(G.centrality(A.relations(s, d)), F.desc("score"), F.desc("degree"), C("entity")).select("entity", "degree", "neighbours", F.array_join("sources", ",").alias("sources"), "score", "rank"),
        A.with_tables("WITH e AS (SELECT src_id AS entity, tgt_id AS neighbour, source_id FROM relations UNION ALL SELECT tgt_id, src_id, source_id FROM relations), g AS (SELECT entity, count(*) AS degree, count(DISTINCT neighbour) AS neighbours, array_to_string(list_sort(list_distinct(list(source_id)))[1:3], ',') AS sources FROM e GROUP BY 1) SELECT *, degree + neighbours AS score, row_number() OVER (ORDER BY degree + neighbours DESC, degree DESC, entity) AS rank FROM g", "relations"),
    ),
    "a15_document_frequency": (lambda s, d: G.document_frequency(A.mentions(s, d), X.ascii_slug(C("entity_type"))), A.with_tables("SELECT regexp_replace(lower(entity_type), '[^a-z0-9]+', '-', 'g') AS slug, count(DISTINCT article_id) AS documents FROM mentions GROUP BY 1 HAVING count(DISTINCT article_id) >= 2", "mentions")),
    "a17_last_modified": (lambda s, d: G.last_modified(A.unified(s, d), "publisher"), A.with_tables("SELECT publisher, coalesce(max(substr(update_time, 1, 10)), '1970-01-01') AS lastmod FROM unified GROUP BY 1", "unified")),
    "a18_topic_cards": (
        lambda s, d: G.topic_cards(A.classifications(s, d).select("topic").distinct().union(s.createDataFrame([("9-NONE",)], "topic string")), A.classifications(s, d)),
        A.with_tables("SELECT topic, count(DISTINCT article_id) AS n FROM classifications GROUP BY 1 UNION ALL SELECT '9-NONE', 0", "classifications"),
    ),
    "a20_a21_rollup": (lambda s, d: G.rollup_report(A.ingestions(s, d), "event_type", C("value") > 50), A.with_tables("SELECT event_type, count(*) FILTER (value > 50) AS passed, count(*) FILTER (NOT value > 50) AS failed, bool_and(value > 50) AS all_passed, round(count(*) FILTER (value > 50) / count(*)::double, 4) AS rate FROM ingestions GROUP BY 1", "ingestions")),
    "a22_growth": (
        lambda s, d: G.growth_ceiling(A.table(s, d, "orders").groupBy(F.datediff("o_orderdate", F.lit("1992-01-01")).alias("day")).agg(F.count("*").alias("size")), C("day").cast("double"), C("size").cast("double"), 1e6).select("n", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "last"),
        "SELECT count(*) AS n, round(regr_slope(size, day), 6) AS slope, round(regr_intercept(size, day), 4) AS intercept, max(day)::double AS last FROM (SELECT date_diff('day', date '1992-01-01', cast(o_orderdate AS date)) AS day, count(*) AS size FROM orders GROUP BY 1)",
    ),
    "a25_confidence": (
        lambda s, d: A.ingestions(s, d).groupBy("article_id").agg(F.count_distinct("id").alias("sources"), F.count_distinct("event_type").alias("types")).select("article_id", G.confidence(C("sources"), C("types")).alias("confidence")),
        A.with_tables("SELECT article_id, CASE WHEN count(*) >= 2 AND count(DISTINCT event_type) >= 2 THEN 'high' WHEN count(*) >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM ingestions GROUP BY 1", "ingestions"),
    ),
    "a26_duplicates": (lambda s, d: G.duplicates(A.unified(s, d).select(F.md5("body").alias("slug"), F.concat("source", "url").alias("path")), "slug", "path"), A.with_tables("SELECT md5(body) AS slug, count(DISTINCT url) AS n FROM unified GROUP BY 1 HAVING count(DISTINCT url) > 1", "unified")),
    "k1_k3_insert_or_ignore": (
        lambda s, d: M.insert_or_ignore(A.articles(s, d).select(F.md5("body").alias("url"), "id"), A.rss_articles(s, d).select(F.md5("body").alias("url"), "id"), "url", C("id")),
        A.with_tables("SELECT md5(body) AS url, id FROM articles UNION ALL SELECT url, min(id) FROM (SELECT md5(body) AS url, id FROM rss_articles) WHERE url NOT IN (SELECT md5(body) FROM articles) GROUP BY 1", "articles", "rss_articles"),
    ),
    "k5_k6_upsert": (
        lambda s, d: M.upsert(A.classifications(s, d).select("article_id", "topic", "depth_score"), A.ingestions(s, d).groupBy("article_id").agg(F.max("id").cast("int").alias("depth_score")).select("article_id", F.lit("2-HIGH").alias("topic"), "depth_score"), ["article_id", "topic"]),
        A.with_tables("WITH n AS (SELECT article_id, '2-HIGH' AS topic, max(id) AS depth_score FROM ingestions GROUP BY 1) SELECT article_id, topic, CASE WHEN n.article_id IS NULL THEN c.depth_score ELSE n.depth_score END AS depth_score FROM classifications c FULL JOIN n USING (article_id, topic)", "classifications", "ingestions"),
    ),
    "k7_k11_last_write": (
        lambda s, d: M.last_write(A.ingestions(s, d).select("article_id", "source", "id", "status"), ["article_id", "source"], F.desc("id")),
        A.with_tables("SELECT article_id, source, max(id) AS id, arg_max(status, id) AS status FROM ingestions GROUP BY 1, 2", "ingestions"),
    ),
    "k8_k9_verdict_update": (
        lambda s, d: M.verdict_update(A.unified(s, d).select("source", "id", "layer1_verdict"), A.ingestions(s, d).groupBy("source", C("article_id").alias("id")).agg(F.min("status").alias("layer1_verdict")), "layer1_verdict"),
        A.with_tables("SELECT source, u.id, coalesce(v, layer1_verdict) AS layer1_verdict FROM unified u LEFT JOIN (SELECT source, article_id AS id, min(status) AS v FROM ingestions GROUP BY 1, 2) USING (source, id)", "unified", "ingestions"),
    ),
    "k10_guarded_body": (
        lambda s, d: A.unified(s, d).select("source", "id", F.length(M.guarded_body(C("title"), F.when(C("lang") == "en", C("body")).otherwise(" "))).alias("n")),
        A.with_tables("SELECT source, id, length(CASE WHEN lang = 'en' AND trim(body) <> '' AND length(title) < 500 THEN body ELSE title END) AS n FROM unified", "unified"),
    ),
    "k13_k15_error_book": (
        lambda s, d: M.error_book(A.ingestions(s, d).select(identity.lint_fingerprint(C("event_type"), C("source"), C("status")).alias("fingerprint"), C("id").alias("at"))),
        A.with_tables("SELECT substr(sha256(event_type || ':' || source || ':' || status), 1, 16) AS fingerprint, min(id) AS first_seen, max(id) AS last_seen, count(*) AS seen_count FROM ingestions GROUP BY 1", "ingestions"),
    ),
    "k16_entities": (
        lambda s, d: M.persisted_entities(A.rss_articles(s, d).select("url", F.explode(F.split("title", " ")).alias("name")), A.rss_articles(s, d)).groupBy("article_id").agg(F.count("*").alias("n")),
        A.with_tables("SELECT id AS article_id, count(*) AS n FROM (SELECT id, unnest(string_split(title, ' ')) AS name FROM rss_articles) WHERE trim(name) <> '' GROUP BY 1", "rss_articles"),
    ),
    "k20_sitemap": (lambda s, d: M.sitemap(A.unified(s, d).select(F.concat(F.lit("articles/"), "hash", F.lit(".html")).alias("path"), F.substring("update_time", 1, 10).alias("lastmod")), "https://kb.example.com"), A.with_tables("SELECT '<url><loc>https://kb.example.com/articles/' || hash || '.html</loc><lastmod>' || substr(update_time, 1, 10) || '</lastmod></url>' AS entry FROM unified", "unified")),
    "k23_purge": (
        lambda s, d: M.purge(A.unified(s, d).select(F.concat_ws("_", "source", "ref").alias("doc"), F.when(C("layer1_verdict") == "candidate", "processed").otherwise(C("layer1_verdict")).alias("status")), A.unified(s, d).select(F.concat_ws("_", "source", "ref").alias("doc"), "id"))[0],
        A.with_tables("SELECT source || '_' || ref AS doc, id FROM unified WHERE layer1_verdict = 'candidate'", "unified"),
    ),
    "k24_feed_health": (
        lambda s, d: G.feed_health(A.ingestions(s, d).select(C("article_id").alias("feed"), C("id").alias("at"), (C("status") == "ok").alias("ok"))),
        A.with_tables("WITH l AS (SELECT article_id AS feed, max(id) FILTER (status = 'ok') AS last_ok FROM ingestions GROUP BY 1) SELECT feed, count(*) FILTER (status <> 'ok' AND (last_ok IS NULL OR id > last_ok)) AS error_count, max(last_ok) AS last_ok FROM ingestions JOIN l ON feed = article_id GROUP BY 1", "ingestions"),
    ),
    "k25_reconcile_patch": (
        lambda s, d: A.ingestions(s, d).select("id", G.patched(C("status"), F.lit(None).cast("int"), G.reconcile_class(C("status"), F.when(C("value") > 50, "Processed"))).alias("p")).select("id", "p.status", "p.version"),
        A.with_tables("SELECT id, CASE WHEN status = 'failed' AND value > 50 THEN 'ok' WHEN status = 'ok' AND value <= 50 THEN 'failed' ELSE status END AS status, CASE WHEN status = 'ok' AND value <= 50 THEN 1 END AS version FROM ingestions", "ingestions"),
    ),
    "state_machine": (
        lambda s, d: A.unified(s, d).groupBy(M.ingestion_state(C("layer1_verdict"), C("url"), F.when(C("lang") == "fr", "text_ingest"), C("body"), C("lang") == "es", C("layer2_verdict"), F.length("body") > 1000).alias("state")).agg(F.count("*").alias("n")),
        A.with_tables("SELECT CASE WHEN layer1_verdict = 'reject' THEN 'skipped' WHEN layer1_verdict IS NULL THEN NULL WHEN lang = 'fr' THEN 'skipped_ingested' WHEN lang = 'es' THEN 'skipped_graded' WHEN layer2_verdict = 'reject' THEN 'skipped' WHEN layer2_verdict IS NULL THEN NULL WHEN length(body) > 1000 THEN 'ok' ELSE 'failed' END AS state, count(*) AS n FROM unified GROUP BY 1", "unified"),
    ),
    "v1_gram_index": (
        lambda s, d: V.index_candidates(V.gram_index(A.unified(s, d).select(F.concat_ws("_", "source", "id").alias("key"), "title"), "key", C("title")), "key", "tion"),
        A.with_tables("SELECT source || '_' || id AS key FROM unified WHERE contains(lower(title), 'tio') AND contains(lower(title), 'ion')", "unified"),
    ),
    "v1_k12_text_index": (
        lambda s, d: V.index_candidates(V.gram_index(A.unified(s, d).select(F.concat_ws("_", "source", "id").alias("key"), "title", "body"), "key", F.concat_ws("\n", "title", "body")), "key", "tion"),
        A.with_tables("SELECT source || '_' || id AS key FROM unified WHERE contains(lower(concat_ws(chr(10), title, body)), 'tio') AND contains(lower(concat_ws(chr(10), title, body)), 'ion')", "unified"),
    ),
    "v10_nearest": (lambda s, d: V.nearest(A.table(s, d, "embeddings"), _Q, "vec_id", "embedding", 20), f"SELECT vec_id, {_COS} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20"),
    "v11_graph_stats": (lambda s, d: A.relations(s, d).agg(F.count_distinct("src_id").alias("sources"), F.count_distinct("tgt_id").alias("targets"), F.count("*").alias("edges")), A.with_tables("SELECT count(DISTINCT src_id) AS sources, count(DISTINCT tgt_id) AS targets, count(*) AS edges FROM relations", "relations")),
    "v12_embedding_cache": (
        lambda s, d: V.cached(A.table(s, d, "conversations").select((C("conv_id") * 1000 + C("turn")).alias("pos"), F.substring(F.sha2("text", 256), 1, 16).alias("key"), "text"), A.table(s, d, "documents").select(F.substring(F.sha2("text", 256), 1, 16).alias("key"), F.array(F.lit(0.0)).alias("vector")).dropDuplicates(["key"]), lambda t: F.array(F.length(t).cast("double"))).select("pos", "key", C("vector")[0].alias("v")),
        "SELECT conv_id * 1000 + turn AS pos, substr(sha256(text), 1, 16) AS key, CASE WHEN text IN (SELECT text FROM documents) THEN 0.0::double ELSE length(text)::double END AS v FROM conversations",
    ),
    "m5_y5_vectors": (lambda s, d: A.table(s, d, "embeddings").select("vec_id", V.valid_vector(C("embedding"), 64).alias("valid"), F.round(V.norm(V.normalized(C("embedding"))), 6).alias("norm")), "SELECT vec_id, len(embedding) = 64 AS valid, 1.0::double AS norm FROM embeddings"),
    "y1_missing_ids": (lambda s, d: M.missing_ids(A.table(s, d, "embeddings").select(C("vec_id").alias("id"), C("embedding").alias("vector")), A.table(s, d, "supplier").select(C("s_suppkey").alias("id"))).select("id"), "SELECT vec_id AS id FROM embeddings WHERE embedding IS NOT NULL AND vec_id NOT IN (SELECT s_suppkey FROM supplier)"),
    "y6_point_ids": (lambda s, d: A.unified(s, d).select("ref", F.length(identity.point_id(C("ref"))).alias("n"), F.substring(identity.point_id(C("ref")), 1, 8).alias("head")), A.with_tables("SELECT ref, 36 AS n, substr(sha256(ref), 1, 8) AS head FROM unified", "unified")),
    "y11_page_links": (lambda s, d: A.table(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]+)">'), 1)).alias("link")).groupBy("link").agg(F.count("*").alias("n")), """SELECT link, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<a href="([^"]+)">', 1)) AS link FROM pages) GROUP BY 1"""),
    "s15_checkpoints": (
        lambda s, d: readers.checkpoint_status(A.ingestions(s, d).select(C("article_id").alias("article_hash"), F.when(C("status") == "ok", "sub_doc_ingest").when(C("status") == "failed", "scrape").otherwise("classify").alias("stage"))),
        A.with_tables("SELECT article_id AS article_hash, CASE max(CASE status WHEN 'ok' THEN 6 WHEN 'failed' THEN 1 ELSE 2 END) WHEN 6 THEN 'sub_doc_ingest' WHEN 1 THEN 'scrape' ELSE 'classify' END AS last_stage, bool_or(status = 'ok') AS complete FROM ingestions GROUP BY 1", "ingestions"),
    ),
    "s16_routes": (
        lambda s, d: A.table(s, d, "pages").select("page_id", readers.route(_hosted(C("url"))).alias("route")),
        "WITH h AS (SELECT page_id, regexp_replace(url, '^https?://[^/?#]+', CASE WHEN length(url) % 5 = 0 THEN 'https://mp.weixin.qq.com' WHEN length(url) % 5 = 1 THEN 'https://export.arxiv.org/pdf' WHEN length(url) % 5 = 2 THEN 'http://arxiv.org' WHEN length(url) % 5 = 3 THEN 'https://notarxiv.org/pdf' ELSE 'http://a.example.com' END) AS url FROM pages) "
        "SELECT page_id, CASE WHEN starts_with(url, 'https://mp.weixin.qq.com') THEN 'wechat' WHEN starts_with(url, 'https://export.arxiv.org/pdf/') THEN 'arxiv_pdf' WHEN regexp_matches(url, '^https?://(export\\.)?arxiv\\.org') THEN 'arxiv_abs' ELSE 'generic' END AS route FROM h",
    ),
    "s10_newest_until": (
        lambda s, d: readers.newest_until(A.ingestions(s, d).select("article_id", C("id").alias("pos"), "value"), "article_id", "value", F.lit(10.0), 5),
        A.with_tables("SELECT article_id, pos, value FROM (SELECT article_id, id AS pos, value, max((value < 10)::int) OVER w AS old, row_number() OVER w AS n FROM ingestions WINDOW w AS (PARTITION BY article_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE old = 0 AND n <= 5", "ingestions"),
    ),
    "c1_layer1": (lambda s, d: K.classified(A.unified(s, d).select(F.concat_ws("_", "source", "id").alias("key"), "title"), "key", _by_length), A.with_tables("SELECT source || '_' || id AS key, CASE WHEN length(title) >= 30 THEN 'candidate' ELSE 'reject' END AS verdict, 'length' AS reason FROM unified", "unified")),
    "c2_layer2": (lambda s, d: K.classified(A.unified(s, d).select(F.concat_ws("_", "source", "id").alias("key"), "body"), "key", _by_depth, K.layer2, K.LAYER2_BATCH), A.with_tables("SELECT source || '_' || id AS key, CASE WHEN length(body) >= 1000 THEN 'ok' ELSE 'reject' END AS verdict, CAST(NULL AS VARCHAR) AS reason FROM unified", "unified")),
    "c4_c18_rules": (
        lambda s, d: A.ingestions(s, d).select("id", K.probe_skips(C("status") == "failed", C("value") / 100).alias("skips"), K.regression_status(C("value") > 95, C("status") == "failed", C("value") > 5, C("value") > 10).alias("verdict"), K.joined_reasons(F.when(C("value") > 50, "a"), F.when(C("status") == "ok", "b")).alias("reasons")),
        A.with_tables("SELECT id, status = 'failed' AND value / 100 >= 0.9 AS skips, CASE WHEN value > 95 THEN 'TIMEOUT' WHEN status = 'failed' OR value <= 10 THEN 'FAIL' ELSE 'PASS' END AS verdict, concat_ws('; ', CASE WHEN value > 50 THEN 'a' END, CASE WHEN status = 'ok' THEN 'b' END) AS reasons FROM ingestions", "ingestions"),
    ),
    "x_tumbling": (lambda s, d: E.tumbling(E.timed(ev(s, d))).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")), "SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "x_sliding": (lambda s, d: E.sliding(E.timed(ev(s, d))).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")), "SELECT strftime(time_bucket(INTERVAL 15 minute, ts) - k * INTERVAL 15 minute, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(4) r(k) GROUP BY 1, 2"),
    "x_sessions": (
        lambda s, d: E.sessions(E.timed(ev(s, d)), "2 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "n"),
        "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 hour THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g",
    ),
    "x5_settled": (lambda s, d: E.settled(A.ingestions(s, d).select("article_id", "id", F.when(C("status") == "ok", "processed").otherwise(C("status")).alias("status")), "article_id", "id", "status"), A.with_tables("SELECT article_id, coalesce(bool_or(t), false) AS settled FROM (SELECT article_id, status = 'ok' AND lag(status) OVER (PARTITION BY article_id ORDER BY id) = 'ok' AS t FROM ingestions) GROUP BY 1", "ingestions")),
}


def _hosted(url):
    """Pages' addresses under other hosts."""
    n = F.length(url) % 5
    host = F.when(n == 0, "https://mp.weixin.qq.com").when(n == 1, "https://export.arxiv.org/pdf").when(n == 2, "http://arxiv.org").when(n == 3, "https://notarxiv.org/pdf").otherwise("http://a.example.com")
    return F.concat(host, F.regexp_replace(url, "^https?://[^/?#]+", ""))


def _by_length(rows: list[dict]) -> str:
    """A model for checks: long titles are candidates."""
    return json.dumps([{"verdict": "candidate" if len(r["title"]) >= 30 else "reject", "reason": "length"} for r in rows])


def _by_depth(rows: list[dict]) -> str:
    """A model for checks: long bodies are deep."""
    return "```json\n" + json.dumps([{"relevant": True, "depth": 2 if len(r["body"]) >= 1000 else 1} for r in rows]) + "\n```"
