"""The engine's tables, seen in the shared test tables (section 7.1).

Every document is an article of one of two sources: languages ``en`` and ``de``
are the accounts' articles (``wechat``), all others feed entries (``rss``).
``SQL`` has the same relations as DuckDB common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import identity

KOL_LANGUAGES = ("en", "de")
EPOCH = 1_700_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    layer1 = F.when(F.col("quality") == 1, "candidate").when(F.col("quality") == 0, "reject")
    layer2 = F.when(F.col("toxic") == 0, "ok").when(F.col("toxic") == 1, "reject")
    return labels.select("doc_id", layer1.alias("layer1_verdict"), layer2.alias("layer2_verdict"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(_verdicts(spark, sf_dir), "doc_id", "left")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts' articles: epoch times; German ones have no content hash."""
    d = _documents(spark, sf_dir).where(F.coalesce(F.col("lang").isin(*KOL_LANGUAGES), F.lit(False)))
    return d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("account"), F.substring(F.substring_index("text", "\n", 1), 1, 60).alias("title"),
        F.concat(F.lit("https://kol.example.com/a/"), F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("body"),
        F.when(F.col("lang") == "en", F.substring(F.md5("text"), 1, 10)).alias("content_hash"), "lang",
        (F.lit(EPOCH) + F.col("doc_id") * 3600).alias("update_time"), "layer1_verdict", "layer2_verdict",
    )


def rss_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed entries: ISO times, but RFC 822 in French feeds."""
    d = _documents(spark, sf_dir).where(~F.coalesce(F.col("lang").isin(*KOL_LANGUAGES), F.lit(False)))
    at = F.timestamp_seconds(F.lit(EPOCH) + F.col("doc_id") * 3600)
    published = F.when(F.col("lang") == "fr", F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
    return d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("feed"), F.substring(F.substring_index("text", "\n", 1), 1, 60).alias("title"),
        F.concat(F.lit("https://feed.example.com/e/"), F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("body"),
        F.md5("text").alias("content_hash"), "lang", published.alias("published_at"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("fetched_at"),
        F.to_json(F.array("source", "lang")).alias("topics"), "layer1_verdict", "layer2_verdict",
    )


def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sources in one shape, with the keys of section 1.4."""
    a = articles(spark, sf_dir).select("id", F.lit("wechat").alias("source"), F.col("account").alias("publisher"), "title", "url", "body", "content_hash", "lang", F.date_format(F.timestamp_seconds("update_time"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("update_time"), "layer1_verdict", "layer2_verdict")
    r = rss_articles(spark, sf_dir).select("id", F.lit("rss").alias("source"), F.col("feed").alias("publisher"), "title", "url", "body", "content_hash", "lang", F.regexp_replace("fetched_at", " ", "T").alias("update_time"), "layer1_verdict", "layer2_verdict")
    r = r.withColumn("update_time", F.concat("update_time", F.lit("+00:00")))
    return a.unionByName(r).withColumns({"hash": identity.display_hash(F.col("source"), F.col("content_hash"), F.col("url")), "ref": identity.canonical_ref(F.col("url"))})


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted entities; the same mention may repeat (Q7)."""
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("article_id"), F.col("p_brand").alias("entity_name"), F.col("p_type").alias("entity_type"))


def classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_id"), F.col("o_orderpriority").alias("topic"), depth.alias("depth_score"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("classified_at"))


def ingestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as state rows: views are ok, errors failed, all else skipped."""
    status = F.when(F.col("event_type").isin("view", "click"), "ok").when(F.col("event_type") == "error", "failed").otherwise("skipped")
    source = F.when(F.col("value") >= 50, "wechat").otherwise("rss")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("article_id"), source.alias("source"), status.alias("status"), F.col("ts").alias("ingested_at"), "event_type", "value", "props")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bipartite multigraph: parts and suppliers."""
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("tgt_id"), F.col("l_orderkey").cast("string").alias("source_id"))


_V = "CASE quality WHEN 1 THEN 'candidate' WHEN 0 THEN 'reject' END AS layer1_verdict, CASE toxic WHEN 0 THEN 'ok' WHEN 1 THEN 'reject' END AS layer2_verdict"
_KOL = "coalesce(lang IN ('en', 'de'), false)"
_TITLE = "substr(split_part(text, chr(10), 1), 1, 60)"
_AT = "make_timestamp((1700000000 + doc_id * 3600) * 1000000)"
SQL = {
    "articles": f"SELECT d.doc_id AS id, d.source AS account, {_TITLE} AS title, 'https://kol.example.com/a/' || d.doc_id AS url, text AS body, CASE WHEN lang = 'en' THEN substr(md5(text), 1, 10) END AS content_hash, lang, 1700000000 + d.doc_id * 3600 AS update_time, {_V} FROM documents d LEFT JOIN labels USING (doc_id) WHERE {_KOL}",
    "rss_articles": f"SELECT d.doc_id AS id, d.source AS feed, {_TITLE} AS title, 'https://feed.example.com/e/' || d.doc_id AS url, text AS body, md5(text) AS content_hash, lang, CASE WHEN lang = 'fr' THEN strftime({_AT}, '%a, %d %b %Y %H:%M:%S +0000') ELSE strftime({_AT}, '%Y-%m-%dT%H:%M:%S+00:00') END AS published_at, strftime({_AT}, '%Y-%m-%d %H:%M:%S') AS fetched_at, '[\"' || source || '\",\"' || lang || '\"]' AS topics, {_V} FROM documents d LEFT JOIN labels USING (doc_id) WHERE NOT {_KOL}",
    "unified": "SELECT *, CASE WHEN source = 'wechat' THEN coalesce(content_hash, substr(md5(url), 1, 10)) ELSE substr(content_hash, 1, 10) END AS hash, substr(md5(url), 1, 10) AS ref FROM (SELECT id, 'wechat' AS source, account AS publisher, title, url, body, content_hash, lang, strftime(make_timestamp(update_time * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS update_time, layer1_verdict, layer2_verdict FROM articles UNION ALL SELECT id, 'rss', feed, title, url, body, content_hash, lang, replace(fetched_at, ' ', 'T') || '+00:00', layer1_verdict, layer2_verdict FROM rss_articles)",
    "mentions": "SELECT l_orderkey AS article_id, p_brand AS entity_name, p_type AS entity_type FROM lineitem JOIN part ON l_partkey = p_partkey",
    "classifications": "SELECT o_orderkey AS article_id, o_orderpriority AS topic, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS depth_score, o_totalprice AS price, o_orderdate AS classified_at FROM orders",
    "ingestions": "SELECT event_id AS id, user_id AS article_id, CASE WHEN value >= 50 THEN 'wechat' ELSE 'rss' END AS source, CASE WHEN event_type IN ('view', 'click') THEN 'ok' WHEN event_type = 'error' THEN 'failed' ELSE 'skipped' END AS status, ts AS ingested_at, event_type, value, props FROM events",
    "relations": "SELECT 'p' || l_partkey AS src_id, 's' || l_suppkey AS tgt_id, cast(l_orderkey AS varchar) AS source_id FROM lineitem",
}
_NEEDS = {"unified": ("articles", "rss_articles")}


def with_tables(body: str, *names: str) -> str:
    """DuckDB SQL of ``body`` over the named relations."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*_NEEDS.get(n, ()), n) if x not in order]
    inner = ", ".join(f"{n} AS ({SQL[n]})" for n in order)
    return f"WITH {inner}{', ' + body[5:] if body.startswith('WITH ') else ' ' + body}" if names else body
