"""Queries of listings, joins, cohorts, ranking and sets (sections 2.3, 2.4, 2.6-2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import identity, predicates
from tessera.functions import text as X
from tessera.operators import relational as R
from tessera.sources import analogs as A

_URL_KEY = "regexp_replace(regexp_replace(trim(url), '^https?://', ''), '/+$', '')"

def _some_hash(s, d):
    """The head of the greatest content hash of the feeds."""
    return A.unified(s, d).where("source = 'rss'").agg(F.substring(F.max("content_hash"), 1, 10)).first()[0] or ""


QUERIES = {
    "j15_cooccurring_entities": (
        lambda s, d: R.cooccurring_entities(A.classifications(s, d), A.mentions(s, d), "2-HIGH"),
        A.with_tables("WITH cohort AS (SELECT DISTINCT article_id FROM classifications WHERE topic = '2-HIGH' AND depth_score >= 2), f AS (SELECT entity_name, count(DISTINCT article_id) AS global_freq FROM mentions GROUP BY 1) SELECT entity_name, count(DISTINCT m.article_id) AS freq, max(global_freq) AS global_freq FROM mentions m JOIN cohort USING (article_id) JOIN f USING (entity_name) GROUP BY 1 HAVING max(global_freq) >= 5 ORDER BY freq DESC, entity_name LIMIT 5", "classifications", "mentions"),
    ),
    "identity_keys": (
        lambda s, d: A.unified(s, d).select("source", "id", "hash", "ref", identity.doc_id(F.col("source"), F.col("url")).alias("doc"), identity.checkpoint_id(F.col("url")).alias("checkpoint"), identity.lint_fingerprint(F.lit("stale"), F.col("ref"), F.col("title")).alias("fingerprint"), identity.page_digest(F.col("body")).alias("digest")),
        A.with_tables("SELECT source, id, hash, ref, source || '_' || ref AS doc, substr(sha256(url), 1, 16) AS checkpoint, substr(sha256('stale:' || ref || ':' || substr(title, 1, 80)), 1, 16) AS fingerprint, sha256(body) AS digest FROM unified", "unified"),
    ),
    "p1_p2_quality": (
        lambda s, d: A.unified(s, d).select("source", "id", predicates.display_ok(F.col("body"), F.col("layer1_verdict"), F.col("layer2_verdict")).alias("display_ok"), predicates.lenient_ok(F.col("layer2_verdict")).alias("lenient_ok")),
        A.with_tables("SELECT source, id, coalesce(body <> '' AND layer1_verdict = 'candidate' AND layer2_verdict = 'ok', false) AS display_ok, layer2_verdict IS NULL OR layer2_verdict <> 'reject' AS lenient_ok FROM unified", "unified"),
    ),
    "p3_filter_modes": (
        lambda s, d: A.unified(s, d).agg(*[F.count_if(predicates.candidate_filter(m, F.col("body"), F.col("layer1_verdict"), F.col("layer2_verdict"))).alias(n) for m, n in (("strict", "strict"), ("layer1-only", "layer1_only"), ("all", "every"))]),
        A.with_tables("SELECT count(*) FILTER (body <> '' AND layer1_verdict = 'candidate' AND (layer2_verdict IS NULL OR layer2_verdict <> 'reject')) AS strict, count(*) FILTER (body <> '' AND layer1_verdict = 'candidate') AS layer1_only, count(*) FILTER (body <> '') AS every FROM unified", "unified"),
    ),
    "p7_title_contains": (
        lambda s, d: A.unified(s, d).where(predicates.title_contains(F.col("title"), "ATION")).select("source", "id", "title"),
        A.with_tables("SELECT source, id, title FROM unified WHERE contains(lower(title), 'ation')", "unified"),
    ),
    "p8_p11_scrape_gates": (
        lambda s, d: A.unified(s, d).select("source", "id", predicates.needs_scrape(F.col("source"), F.col("body")).alias("needs_scrape"), predicates.anti_bot_shell(F.col("body")).alias("shell"), predicates.scrape_failed(F.col("body"), F.length("body") * 5).alias("scrape_failed"), predicates.passes_quality_gate(F.col("body")).alias("gate")),
        A.with_tables("SELECT source, id, body = '' OR (source = 'rss' AND length(body) <= 100) AS needs_scrape, length(body) < 200 OR contains(upper(body), 'CAPTCHA') AS shell, length(body) < 500 AND length(body) * 5 > 2000 AS scrape_failed, length(body) >= 200 AND NOT regexp_matches(lower(body), 'sign in|log in to continue|subscribe to read|subscribe to continue reading|article limit|this content is for members only|unlock this article|become a member') AS gate FROM unified", "unified"),
    ),
    "p12_feed_reason": (
        lambda s, d: A.rss_articles(s, d).groupBy(predicates.feed_reason(F.col("body"), F.col("lang"), ("fr",)).alias("reason")).agg(F.count("*").alias("n")),
        A.with_tables("SELECT CASE WHEN length(body) < 500 THEN 'too_short' WHEN lang <> 'fr' THEN 'unsupported_lang' END AS reason, count(*) AS n FROM rss_articles GROUP BY 1", "rss_articles"),
    ),
    "p13_p14_backlogs": (
        lambda s, d: A.unified(s, d).agg(F.count_if(predicates.candidate_bucket(F.col("layer1_verdict"), F.col("lang"), "en")).alias("bucket"), F.count_if((F.col("layer1_verdict") == "candidate") & F.col("layer2_verdict").isNull() & F.col("body").isNotNull()).alias("layer2_backlog")),
        A.with_tables("SELECT count(*) FILTER (layer1_verdict IS NULL OR lang IS DISTINCT FROM 'en' OR layer1_verdict = 'candidate') AS bucket, count(*) FILTER (layer1_verdict = 'candidate' AND layer2_verdict IS NULL AND body IS NOT NULL) AS layer2_backlog FROM unified", "unified"),
    ),
    "p15_translation_backlog": (
        lambda s, d: A.unified(s, d).where(predicates.display_ok(F.col("body"), F.col("layer1_verdict"), F.col("layer2_verdict")) & (F.col("lang") != "en")).orderBy("update_time", "source", "id").limit(100).select("source", "id", "lang"),
        A.with_tables("SELECT source, id, lang FROM unified WHERE body <> '' AND layer1_verdict = 'candidate' AND layer2_verdict = 'ok' AND lang <> 'en' ORDER BY update_time, source, id LIMIT 100", "unified"),
    ),
    "p18_p19_due": (
        lambda s, d: A.ingestions(s, d).select("id", predicates.is_stuck(F.col("status")).alias("stuck"), predicates.is_due(F.when(F.col("status") == "ok", "applied").when(F.col("status") == "failed", "retry").otherwise("new"), F.when(F.col("value") > 20, F.col("value")), F.lit(60.0)).alias("due")),
        A.with_tables("SELECT id, status IN ('failed', 'processing') AS stuck, CASE status WHEN 'ok' THEN false WHEN 'failed' THEN value <= 20 OR value <= 60 ELSE true END AS due FROM ingestions", "ingestions"),
    ),
    "p21_tolerance": (
        lambda s, d: A.table(s, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(predicates.within_tolerance(F.col("l_extendedprice"), F.col("l_quantity") * 1500, 0.2)).alias("close"), F.count("*").alias("n")),
        "SELECT l_returnflag, count(*) FILTER (abs(l_extendedprice - l_quantity * 1500) <= abs(l_quantity * 1500) * 0.2) AS close, count(*) AS n FROM lineitem GROUP BY 1",
    ),
    "j1_topic_cohort": (
        lambda s, d: R.topic_cohort(A.unified(s, d), A.classifications(s, d), "1-URGENT").select("source", "id", "title"),
        A.with_tables("SELECT source, id, title FROM unified WHERE id IN (SELECT article_id FROM classifications WHERE topic = '1-URGENT' AND depth_score >= 2)", "unified", "classifications"),
    ),
    "j2_articles_of_entity": (
        lambda s, d: R.articles_of_entity(A.mentions(s, d), "Brand#11", 5),
        A.with_tables("SELECT DISTINCT article_id FROM mentions WHERE entity_name = 'Brand#11' AND (SELECT count(DISTINCT article_id) FROM mentions WHERE entity_name = 'Brand#11') >= 5", "mentions"),
    ),
    "a2_related_entities": (
        lambda s, d: R.related_entities(A.mentions(s, d), A.unified(s, d).select(F.col("id").alias("article_id"))).select("article_id", "entity_name", "freq", "rank"),
        A.with_tables("WITH f AS (SELECT entity_name, count(DISTINCT article_id) AS freq FROM mentions GROUP BY 1 HAVING count(DISTINCT article_id) >= 5), o AS (SELECT DISTINCT article_id, entity_name FROM mentions WHERE article_id IN (SELECT id FROM unified)) SELECT * FROM (SELECT article_id, entity_name, freq, row_number() OVER (PARTITION BY article_id ORDER BY freq DESC, entity_name) AS rank FROM o JOIN f USING (entity_name)) WHERE rank <= 5", "mentions", "unified"),
    ),
    "j16_entities_of_articles": (
        lambda s, d: R.entities_of_articles(A.mentions(s, d), A.unified(s, d).where("source = 'rss'").select(F.col("id").alias("article_id"))),
        A.with_tables("SELECT entity_name, count(DISTINCT article_id) AS freq FROM mentions WHERE article_id IN (SELECT id FROM unified WHERE source = 'rss') GROUP BY 1 ORDER BY freq DESC, entity_name LIMIT 8", "mentions", "unified"),
    ),
    "j3_publisher_names": (
        lambda s, d: A.table(s, d, "customer").join(A.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")),
        "SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    ),
    "j4_candidate_pool": (
        lambda s, d: R.candidate_pool(A.unified(s, d), A.ingestions(s, d)).select("source", "id"),
        A.with_tables("SELECT source, id FROM unified u WHERE NOT EXISTS (SELECT 1 FROM ingestions i WHERE i.source = u.source AND i.article_id = u.id AND status IN ('ok', 'failed', 'skipped'))", "unified", "ingestions"),
    ),
    "j5_unclassified": (
        lambda s, d: A.unified(s, d).join(A.classifications(s, d).where("topic = '5-LOW'").select(F.col("article_id").alias("id")), "id", "left_anti").groupBy("publisher").agg(F.count("*").alias("n")),
        A.with_tables("SELECT publisher, count(*) AS n FROM unified WHERE id NOT IN (SELECT article_id FROM classifications WHERE topic = '5-LOW') GROUP BY 1", "unified", "classifications"),
    ),
    "j7_j9_reconcile": (
        lambda s, d: _reconcile(s, d),
        A.with_tables("SELECT source, class, count(*) AS n FROM (SELECT i.source, CASE WHEN i.status = 'ok' AND coalesce(u.layer1_verdict = 'candidate', false) THEN 'matched' WHEN i.status = 'ok' THEN 'mystery' WHEN i.status = 'failed' AND coalesce(u.layer1_verdict = 'candidate', false) THEN 'ghost' WHEN i.status = 'failed' THEN 'expected_failure' END AS class FROM ingestions i LEFT JOIN unified u ON u.source = i.source AND u.id = i.article_id) GROUP BY 1, 2", "ingestions", "unified"),
    ),
    "j10_processed_ingestions": (
        lambda s, d: A.ingestions(s, d).where("status = 'ok'").join(A.unified(s, d).select("source", F.col("id").alias("article_id"), "ref"), ["source", "article_id"]).groupBy("source", "ref").agg(F.count("*").alias("n")),
        A.with_tables("SELECT source, ref, count(*) AS n FROM ingestions i JOIN unified u USING (source) WHERE i.status = 'ok' AND i.article_id = u.id GROUP BY 1, 2", "ingestions", "unified"),
    ),
    "j11_chunk_articles": (
        lambda s, d: R.chunks_to_articles(A.table(s, d, "conversations").select(F.concat_ws("-", F.lit("chunk"), "conv_id", "turn").alias("chunk"), F.col("conv_id").alias("k")).join(A.unified(s, d).select(F.col("id").alias("k"), F.concat("source", F.lit("_"), "ref").alias("doc")), "k").select("chunk", "doc"), A.unified(s, d).select(F.concat("source", F.lit("_"), "ref").alias("doc"), F.regexp_replace("url", "^https", "http").alias("url")), A.unified(s, d)),
        A.with_tables("SELECT 'chunk-' || conv_id || '-' || turn AS chunk, source, id FROM conversations JOIN unified ON conv_id = id", "unified"),
    ),
    "j12_unique_refs": (
        lambda s, d: R.unique_by_ref(A.unified(s, d).withColumn("ref", F.substring("ref", 1, 3))),
        A.with_tables("SELECT substr(ref, 1, 3) AS ref, min(source) AS source, min(id) AS id FROM unified GROUP BY 1 HAVING count(*) = 1", "unified"),
    ),
    "j13_by_hashes": (
        lambda s, d: R.by_hashes(A.table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.col("conv_id").alias("k")).join(A.unified(s, d).select(F.col("id").alias("k"), "hash"), "k").drop("k"), A.unified(s, d)).select("pos", "hash", "source", "id"),
        A.with_tables("WITH one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY CASE source WHEN 'wechat' THEN 0 ELSE 1 END, id) AS n FROM unified) WHERE n = 1) SELECT conv_id * 1000 + turn AS pos, o.hash, o.source, o.id FROM conversations JOIN unified u ON conv_id = u.id JOIN one o ON o.hash = u.hash", "unified"),
    ),
    "j14_one_by_hash": (
        lambda s, d: R.one_by_hash(A.unified(s, d), _some_hash(s, d)).select("source", "id"),
        A.with_tables("WITH h AS (SELECT substr(max(content_hash), 1, 10) AS h FROM unified WHERE source = 'rss') SELECT source, id FROM (SELECT source, id, CASE WHEN source = 'wechat' AND content_hash = h THEN 1 WHEN source = 'rss' AND starts_with(content_hash, h) THEN 2 WHEN source = 'wechat' AND content_hash IS NULL AND ref = h THEN 3 END AS step FROM unified, h) WHERE step IS NOT NULL ORDER BY step, id LIMIT 1", "unified"),
    ),
    "j17_digest": (
        lambda s, d: A.unified(s, d).where("layer2_verdict = 'ok'").join(A.classifications(s, d).select(F.col("article_id").alias("id"), "topic", "depth_score"), "id", "left").select("source", "id", "topic", "depth_score", F.length("body").alias("n_chars")).orderBy(F.desc("n_chars"), "source", "id", F.col("topic").asc_nulls_first()).limit(10),
        A.with_tables("SELECT source, id, topic, depth_score, length(body) AS n_chars FROM unified LEFT JOIN classifications ON article_id = id WHERE layer2_verdict = 'ok' ORDER BY n_chars DESC, source, id, topic NULLS FIRST LIMIT 10", "unified", "classifications"),
    ),
    "j18_export_join": (
        lambda s, d: A.unified(s, d).join(A.classifications(s, d).where("depth_score >= 2").select(F.col("article_id").alias("id"), "topic"), "id", "left").groupBy("source", "id").agg(F.array_join(F.array_sort(F.collect_set("topic")), "|").alias("topics")),
        A.with_tables("SELECT source, id, coalesce(string_agg(DISTINCT topic, '|' ORDER BY topic), '') AS topics FROM unified LEFT JOIN classifications ON article_id = id AND depth_score >= 2 GROUP BY 1, 2", "unified", "classifications"),
    ),
    "j19_account_productivity": (
        lambda s, d: A.articles(s, d).where("layer1_verdict = 'candidate'").groupBy("account").agg(F.count("*").alias("n"), F.max("update_time").alias("latest")),
        A.with_tables("SELECT account, count(*) AS n, max(update_time) AS latest FROM articles WHERE layer1_verdict = 'candidate' GROUP BY 1", "articles"),
    ),
    "j22_accounts_without": (
        lambda s, d: R.without_articles(A.table(s, d, "documents").select(F.concat_ws("-", "source", "lang").alias("account")).distinct(), A.articles(s, d).select(F.concat_ws("-", "account", "lang").alias("account"))),
        A.with_tables("SELECT DISTINCT source || '-' || lang AS account FROM documents WHERE source || '-' || lang NOT IN (SELECT account || '-' || lang FROM articles)", "articles"),
    ),
    "j26_known_refs": (
        lambda s, d: A.unified(s, d).select("ref").union(A.unified(s, d).select(F.col("content_hash")).where(F.col("content_hash").rlike("^[a-f0-9]{10}$"))).distinct(),
        A.with_tables("SELECT ref FROM unified UNION SELECT content_hash FROM unified WHERE regexp_full_match(content_hash, '[a-f0-9]{10}')", "unified"),
    ),
    "t1_listing": (
        lambda s, d: R.listing(A.unified(s, d), 20, 20).select("source", "id", "update_time"),
        A.with_tables("SELECT source, id, update_time FROM unified ORDER BY update_time DESC, CASE source WHEN 'wechat' THEN 0 ELSE 1 END, id DESC LIMIT 20 OFFSET 20", "unified"),
    ),
    "t2_page": (
        lambda s, d: R.page(A.unified(s, d), 2, 15).select("source", "id", "total", "has_more"),
        A.with_tables("SELECT source, id, (SELECT count(*) FROM unified) AS total, (SELECT count(*) FROM unified) > 30 AS has_more FROM unified ORDER BY update_time DESC, CASE source WHEN 'wechat' THEN 0 ELSE 1 END, id DESC LIMIT 15 OFFSET 15", "unified"),
    ),
    "t3_stalest": (
        lambda s, d: R.stalest(A.table(s, d, "customer").select(F.col("c_name").alias("name"), F.nullif(F.col("c_acctbal") > 0, F.lit(True)).alias("_x"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("scanned")).drop("_x"), "scanned", "name", 25),
        "SELECT c_name AS name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS scanned FROM customer ORDER BY scanned NULLS FIRST, name LIMIT 25",
    ),
    "t4_fifo": (
        lambda s, d: A.unified(s, d).where("layer1_verdict is null").orderBy(F.desc("source"), "id").limit(50).select("source", "id"),
        A.with_tables("SELECT source, id FROM unified WHERE layer1_verdict IS NULL ORDER BY source DESC, id LIMIT 50", "unified"),
    ),
    "t5_digest_top": (
        lambda s, d: A.unified(s, d).where("layer2_verdict = 'ok'").orderBy(F.length("body").desc(), F.col("update_time").desc_nulls_last(), "source", "id").limit(10).select("source", "id", X.excerpt(F.col("body")).alias("excerpt")),
        A.with_tables("SELECT source, id, CASE WHEN length(t) <= 120 THEN t ELSE rtrim(substr(t, 1, 120)) || '…' END AS excerpt FROM (SELECT source, id, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS t FROM unified WHERE layer2_verdict = 'ok' ORDER BY length(body) DESC, update_time DESC, source, id LIMIT 10)", "unified"),
    ),
    "t6_featured": (
        lambda s, d: R.article_frequency(A.mentions(s, d)).orderBy(F.desc("freq"), "entity_name").limit(12),
        A.with_tables("SELECT entity_name, count(DISTINCT article_id) AS freq FROM mentions GROUP BY 1 ORDER BY freq DESC, entity_name LIMIT 12", "mentions"),
    ),
    "t12_head_cap": (
        lambda s, d: R.first_rows(A.table(s, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], F.col("turn"), n=2),
        "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 2",
    ),
    "t13_related_topics": (
        lambda s, d: R.first_rows(A.classifications(s, d).select("article_id", "topic", "depth_score"), ["article_id"], F.desc("depth_score"), F.col("topic"), n=3),
        A.with_tables("SELECT article_id, topic, depth_score FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY depth_score DESC, topic) AS n FROM classifications) WHERE n <= 3", "classifications"),
    ),
    "w2_quintiles": (
        lambda s, d: R.quintiles(A.unified(s, d).select(F.concat_ws("_", "source", "id").alias("key"), F.length("body").alias("size")), "size", "key").groupBy("bucket").agg(F.count("*").alias("n"), F.min("size").alias("least"), F.max("size").alias("most")),
        A.with_tables("SELECT bucket, count(*) AS n, min(size) AS least, max(size) AS most FROM (SELECT size, least(4, (row_number() OVER (ORDER BY size, key) - 1) // greatest(1, count(*) OVER () // 5)) AS bucket FROM (SELECT source || '_' || id AS key, length(body) AS size FROM unified)) GROUP BY 1", "unified"),
    ),
    "w5_recent_history": (
        lambda s, d: A.table(s, d, "conversations").where("role = 'user'").orderBy(F.desc("conv_id"), F.desc("turn")).limit(5).select("conv_id", "turn", "text"),
        "SELECT conv_id, turn, text FROM conversations WHERE role = 'user' ORDER BY conv_id DESC, turn DESC LIMIT 5",
    ),
    "w6_budget": (
        lambda s, d: R.within_budget(A.table(s, d, "conversations").select("conv_id", "turn", F.length("text").alias("size")), "conv_id", "turn", "size", 1500, 800).select("conv_id", "turn", "granted"),
        "SELECT conv_id, turn, granted FROM (SELECT conv_id, turn, greatest(0, least(c, 1500 - coalesce(sum(c) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS granted FROM (SELECT conv_id, turn, least(length(text), 800) AS c FROM conversations)) WHERE granted > 0",
    ),
    "w7_breach_runs": (
        lambda s, d: R.breach_runs(A.ingestions(s, d).select("article_id", "id", "value"), "article_id", "id", F.col("value") > 60),
        A.with_tables("SELECT article_id, min(id) AS first, max(id) AS last, count(*) AS n FROM (SELECT article_id, id, value, a - row_number() OVER (PARTITION BY article_id ORDER BY id) AS g FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY id) AS a FROM ingestions) WHERE value > 60) GROUP BY article_id, g HAVING count(*) >= 2", "ingestions"),
    ),
    "u3_hash_set": (
        lambda s, d: A.articles(s, d).select("content_hash").where("content_hash is not null").union(A.rss_articles(s, d).select(F.substring("content_hash", 1, 10))).distinct(),
        A.with_tables("SELECT content_hash FROM articles WHERE content_hash IS NOT NULL UNION SELECT substr(content_hash, 1, 10) FROM rss_articles", "articles", "rss_articles"),
    ),
    "u6_live_sources": (
        lambda s, d: A.ingestions(s, d).where("source != ''").select("source").distinct(),
        A.with_tables("SELECT DISTINCT source FROM ingestions WHERE source <> ''", "ingestions"),
    ),
    "u7_index_diff": (
        lambda s, d: R.index_consistency(A.articles(s, d).select(F.substring("title", 1, 2).alias("slug")).distinct(), A.rss_articles(s, d).select(F.substring("title", 1, 2).alias("slug")).distinct()),
        A.with_tables("WITH p AS (SELECT DISTINCT substr(title, 1, 2) AS slug FROM articles), i AS (SELECT DISTINCT substr(title, 1, 2) AS slug FROM rss_articles) SELECT slug, 'missing' AS problem FROM p WHERE slug NOT IN (SELECT slug FROM i) UNION ALL SELECT slug, 'orphan' FROM i WHERE slug NOT IN (SELECT slug FROM p)", "articles", "rss_articles"),
    ),
    "u8_source_catalog": (
        lambda s, d: R.source_catalog(A.ingestions(s, d).select(F.col("id").alias("pos"), F.col("source").alias("type"), F.when(F.col("value") > 30, F.col("article_id").cast("string")).otherwise("").alias("ref"), F.col("event_type").alias("title"), F.array("event_type").alias("blocks"))).select("type", "key", "pos", "title", F.size("blocks").alias("blocks")),
        A.with_tables("SELECT source AS type, CASE WHEN value > 30 THEN cast(article_id AS varchar) ELSE event_type END AS key, min(id) AS pos, arg_min(event_type, id) AS title, count(DISTINCT event_type) AS blocks FROM ingestions GROUP BY 1, 2", "ingestions"),
    ),
    "y12_title_dedup": (
        lambda s, d: R.first_rows(A.unified(s, d).where(F.col("publisher").contains("1")).select("publisher", "title", "id"), ["publisher", "title"], F.col("id")),
        A.with_tables("SELECT publisher, title, min(id) AS id FROM unified WHERE contains(publisher, '1') GROUP BY 1, 2", "unified"),
    ),
}


def _reconcile(spark, d):
    from tessera.operators.aggregates import reconcile_class

    state = A.ingestions(spark, d).join(A.unified(spark, d).select("source", F.col("id").alias("article_id"), "layer1_verdict"), ["source", "article_id"], "left")
    cls = reconcile_class(F.col("status"), F.when(F.col("layer1_verdict") == "candidate", "PROCESSED"))
    return state.groupBy("source", cls.alias("class")).agg(F.count("*").alias("n"))
