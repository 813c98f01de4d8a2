"""Queries of wiki pages and answers (sections 2.11 C9-C16, 2.12, 2.16).

Every article is a page here: its slug is its hash, its time the last update.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import answers, wiki
from tessera.sources import analogs as A

C = F.col
_TODAY = "2024-07-01"


def pages(s, d):
    u = A.unified(s, d)
    note = F.when(C("lang") == "en", "[^1] [[missing]]").otherwise(F.concat(F.lit("[^9] [["), "ref", F.lit("]]")))
    head = F.concat(F.lit("---\ntitle: "), "publisher", F.lit("\nlast_updated: "), F.substring("update_time", 1, 10), F.lit("\nsources:\n  - id: 1\n    type: article\n    ref: "), "ref", F.lit("\n---\n"))
    text = F.when(C("lang") == "fr", C("body")).otherwise(F.concat(head, C("body"), F.lit("\n"), note))
    return u.select(C("ref").alias("slug"), text.alias("text"))


def known(s, d):
    return A.unified(s, d).where("source = 'wechat'").select("ref").distinct()


def today():
    return F.lit(_TODAY).cast("date")


_P = "p AS (SELECT *, cast(substr(update_time, 1, 10) AS date) AS d FROM unified)"

QUERIES = {
    "f59_parsed_pages": (
        lambda s, d: wiki.opened(pages(s, d)).select("slug", "ok", C("fields")["title"].alias("title"), F.size("sources").alias("sources"), F.length("body").alias("n_chars")),
        A.with_tables("SELECT ref AS slug, lang <> 'fr' AS ok, CASE WHEN lang <> 'fr' THEN publisher END AS title, CASE WHEN lang <> 'fr' THEN 1 ELSE 0 END AS sources, length(body) + CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 17 ELSE 20 END AS n_chars FROM unified", "unified"),
    ),
    "f45_citation_failures": (
        lambda s, d: wiki.citation_failures(wiki.opened(pages(s, d)).where("ok"), known(s, d)),
        A.with_tables("SELECT ref AS slug, 'unknown id 9' AS failure FROM unified WHERE lang NOT IN ('fr', 'en')", "unified"),
    ),
    "f46_broken_links": (
        lambda s, d: wiki.broken_backlinks(wiki.opened(pages(s, d)).where("ok")),
        A.with_tables("SELECT ref AS slug, 'missing' AS link FROM unified WHERE lang = 'en'", "unified"),
    ),
    "c13_health": (
        lambda s, d: wiki.health(pages(s, d), known(s, d), A.unified(s, d).where("source = 'wechat'").select(C("ref").alias("slug")), today()).groupBy("check", "severity").agg(F.count("*").alias("n")),
        A.with_tables(f'WITH {_P} SELECT * FROM (SELECT \'yaml\' AS "check", \'error\' AS severity, count(*) AS n FROM p WHERE lang = \'fr\' UNION ALL SELECT \'citation\', \'error\', count(*) FROM p WHERE lang NOT IN (\'fr\', \'en\') UNION ALL SELECT \'stale\', \'warn\', count(*) FROM p WHERE lang <> \'fr\' AND date_diff(\'day\', d, date \'{_TODAY}\') > 180 UNION ALL SELECT \'wikilink\', \'warn\', count(*) FROM p WHERE lang = \'en\' UNION ALL SELECT \'index_missing\', \'warn\', count(*) FROM p WHERE source = \'rss\') WHERE n > 0', "unified"),
    ),
    "c9_patches": (
        lambda s, d: wiki.applicable(pages(s, d).select("slug", F.when(C("text").startswith("---"), F.sha2("text", 256)).alias("base_digest")), pages(s, d)).groupBy("outcome").agg(F.count("*").alias("n")),
        A.with_tables("SELECT CASE WHEN lang = 'fr' THEN 'conflict' ELSE 'apply' END AS outcome, count(*) AS n FROM unified GROUP BY 1", "unified"),
    ),
    "c10_gates": (
        lambda s, d: wiki.gates(pages(s, d), known(s, d)).groupBy(F.array_join("blocked_by", ",").alias("blocked")).agg(F.count("*").alias("n")),
        A.with_tables("SELECT CASE lang WHEN 'fr' THEN 'frontmatter' WHEN 'es' THEN 'unknown id 9' WHEN 'de' THEN 'unknown id 9' ELSE '' END AS blocked, count(*) AS n FROM unified GROUP BY 1", "unified"),
    ),
    "c11_assembled": (
        lambda s, d: wiki.assembled(A.ingestions(s, d).select(C("article_id").alias("slug"), C("source").alias("type"), C("event_type").alias("ref"))).select("slug", "sources", "types", "confidence"),
        A.with_tables("SELECT article_id AS slug, count(DISTINCT (source, event_type)) AS sources, count(DISTINCT source) AS types, CASE WHEN count(DISTINCT (source, event_type)) >= 2 AND count(DISTINCT source) >= 2 THEN 'high' WHEN count(DISTINCT (source, event_type)) >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM ingestions GROUP BY 1", "ingestions"),
    ),
    "v8_sources": (
        lambda s, d: answers.resolved_sources(A.table(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "conv_id").join(A.unified(s, d).select(C("id").alias("conv_id"), "hash"), "conv_id").select("id", F.concat(F.lit("see /article/"), "hash", F.lit(" and articles/"), "hash").alias("markdown")), A.unified(s, d)).select("id", "pos", "hash", "article_id"),
        A.with_tables("WITH one AS (SELECT hash, arg_min(id, (CASE source WHEN 'wechat' THEN 0 ELSE 1 END, id)) AS article_id FROM unified GROUP BY 1) SELECT conv_id || '-' || turn AS id, 0 AS pos, hash, article_id FROM conversations JOIN unified u ON conv_id = u.id JOIN one USING (hash)", "unified"),
    ),
    "v9_answer_entities": (
        lambda s, d: answers.entities_for_answers(A.ingestions(s, d).select(C("event_type").alias("id"), "article_id"), A.mentions(s, d)),
        A.with_tables("SELECT id, entity_name, freq FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY freq DESC, entity_name) AS n FROM (SELECT event_type AS id, entity_name, count(DISTINCT article_id) AS freq FROM ingestions JOIN mentions USING (article_id) GROUP BY 1, 2)) WHERE n <= 8", "ingestions", "mentions"),
    ),
    "y23_skill_cases": (
        lambda s, d: answers.skill_failures(A.table(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("name"), C("text").alias("answer"), F.array(F.lit("THE")).alias("contains"), F.array(F.lit("zz")).alias("not_contains"))).groupBy("passed").agg(F.count("*").alias("n")),
        "SELECT contains(lower(text), 'the') AND NOT contains(lower(text), 'zz') AS passed, count(*) AS n FROM conversations GROUP BY 1",
    ),
    "k19_pages": (
        lambda s, d: answers.rendered_pages(A.unified(s, d)).select("path", F.md5("html").alias("digest")),
        A.with_tables(r"SELECT 'articles/' || hash || '.html' AS path, md5('<article><h1>' || title || '</h1><p>' || regexp_replace(replace(replace(body, '&', '&amp;'), '<', '&lt;'), '\n{2,}', '</p><p>', 'g') || '</p></article>') AS digest FROM unified", "unified"),
    ),
}
