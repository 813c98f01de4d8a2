"""Queries of scalar text, date, number and JSON functions (sections 2.9, 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import dates as D
from tessera.functions import text as X
from tessera.plans.rule_queries import chunks_sql
from tessera.sources import analogs as A


def docs(s, d):
    return A.table(s, d, "documents")


def pages(s, d):
    return A.table(s, d, "pages")


_NOW = "timestamp '2024-01-31 00:00:00'"
C = F.col


def _snippet(text: str) -> str:
    """DuckDB SQL of a card snippet of texts without boilerplate: markup goes, blanks collapse, 200 characters stay."""
    for pattern, to in ((r"```(?:.|\n)*?```", ""), ("`[^`]*`", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]+)\]\([^)]*\)", r"\1"), ("<[^>]+>", ""), (r"(?m)^[#>\-*+]+\s*", ""), (r"\*\*([^*]+)\*\*", r"\1"), (r"\*([^*]+)\*", r"\1")):
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def _marked(body, key):
    """Bodies under headings that repeat, with a header of boilerplate, links and code."""
    again = F.when(key % 3 == 0, "# Head\n \n").when(key % 3 == 1, "text\n# Head\n").otherwise("# Other\n")
    return F.concat(F.lit("URL: https://a.example/x\nTime: 2024-01-02 03:04:05\n# Head\n\n"), again, F.lit("去阅读\n> **bold** [link](http://x) `code` ![i](j) <b>t</b>\n"), body)


_CUT = "CASE WHEN length(t) <= 200 THEN t ELSE rtrim(substr(t, 1, 200)) || '…' END AS snippet"
_SNIPPET = f"SELECT source, id, {_CUT} FROM (SELECT source, id, {_snippet('body')} AS t FROM unified)"
_HEADER = "'# Head' || chr(10) || CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN 'text' || chr(10) || '# Head' || chr(10) ELSE '# Other' || chr(10) END || '> **bold** [link](http://x) `code` ![i](j) <b>t</b>' || chr(10) || body"
_MARKED = f"SELECT source, id, {_CUT} FROM (SELECT source, id, {_snippet(_HEADER)} AS t FROM unified)"

QUERIES = {
    "f1_f3_slugs": (
        lambda s, d: A.unified(s, d).select("source", "id", F.md5(X.slug(C("title"))).alias("slug"), X.ascii_slug(C("title")).alias("ascii"), X.ascii_slug(C("publisher"), None).alias("publisher")),
        A.with_tables(r"""SELECT source, id, md5(regexp_replace(regexp_replace(lower(trim(title)), '[/\\&"''<>?#%]', '', 'g'), '\s+', '-', 'g')) AS slug, coalesce(nullif(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled') AS ascii, regexp_replace(regexp_replace(lower(publisher), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS publisher FROM unified""", "unified"),
    ),
    "f5_result_snippet": (
        lambda s, d: pages(s, d).select("page_id", X.result_snippet(C("html")).alias("snippet")),
        r"SELECT page_id, CASE WHEN length(t) <= 200 THEN t ELSE rtrim(substr(t, 1, 200)) || '…' END AS snippet FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '```[\s\S]*?```', '', 'g'), '`[^`]*`', '', 'g'), '\s+', ' ', 'g')) AS t FROM pages)",
    ),
    "f6_card_snippet": (lambda s, d: A.unified(s, d).select("source", "id", X.card_snippet(C("body")).alias("snippet")), A.with_tables(_SNIPPET, "unified")),
    "f6_w8_marked_snippet": (lambda s, d: A.unified(s, d).select("source", "id", X.card_snippet(_marked(C("body"), C("id"))).alias("snippet")), A.with_tables(_MARKED, "unified")),
    "f7_excerpt": (
        lambda s, d: docs(s, d).select("doc_id", X.excerpt(C("text")).alias("excerpt")),
        r"SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE rtrim(substr(t, 1, 120)) || '…' END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)",
    ),
    "f8_reading_minutes": (
        lambda s, d: docs(s, d).select("doc_id", X.reading_minutes(C("text")).alias("minutes")),
        r"SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE greatest(1, cast(round_even(len(regexp_extract_all(t, '[一-鿿]')) / 500 + len(regexp_extract_all(t, '[A-Za-z]+')) / 250, 0) AS int)) END AS minutes FROM (SELECT doc_id, text, regexp_replace(text, '<[^>]+>', '', 'g') AS t FROM documents)",
    ),
    "f9_f17_languages": (
        lambda s, d: A.unified(s, d).select("source", "id", X.has_cjk(C("body")).alias("cjk"), X.language_by_any(C("title"), C("body")).alias("by_any"), X.language_by_share(C("body")).alias("by_share"), X.language_by_head(C("body")).alias("by_head"), X.language_of_question(C("body")).alias("question"), X.target_language(X.language_by_share(C("body"))).alias("target"), X.canonical_language(F.when(C("lang") == "de", "zh").otherwise(C("lang"))).alias("canonical"), X.effective_language(X.canonical_language(C("lang")), C("source")).alias("effective"), X.localized(F.lit("raw"), F.when(C("lang") == "fr", "t").otherwise(""), X.effective_language(C("lang"), C("source")))["zh"].alias("zh")),
        A.with_tables("SELECT source, id, regexp_matches(body, '[一-鿿㐀-䶿]') AS cjk, CASE WHEN regexp_matches(title || body, '[一-鿿㐀-䶿]') THEN 'zh-CN' WHEN length(title) + length(body) < 50 THEN 'unknown' ELSE 'en' END AS by_any, 'en' AS by_share, CASE WHEN body <> '' THEN 'en' END AS by_head, 'en' AS question, 'zh-CN' AS target, CASE WHEN lang = 'de' THEN 'zh-CN' ELSE lang END AS canonical, CASE WHEN lang = 'en' THEN 'en' WHEN source = 'rss' THEN 'en' ELSE 'zh-CN' END AS effective, CASE WHEN (lang = 'en' OR source = 'rss') AND lang = 'fr' THEN 't' ELSE 'raw' END AS zh FROM unified", "unified"),
    ),
    "f22_f23_images": (
        lambda s, d: pages(s, d).select("page_id", F.size(X.image_blocks(C("html"))).alias("blocks"), X.image_count(C("html")).alias("markdown"), F.array_join(X.image_urls(C("html")), " ").alias("urls")),
        r"""SELECT page_id, len(regexp_extract_all(html, '<img\b[^>]*>|!\[[^\]]*\]\([^)]+\)')) AS blocks, len(regexp_extract_all(html, '!\[[^\]]*\]\([^)]*\)')) AS markdown, array_to_string(list_concat(regexp_extract_all(html, '!\[[^\]]*\]\(([^)\s]+)\)', 1), list_distinct_ordered) , ' ') AS urls FROM (SELECT page_id, html, (SELECT coalesce(list(u ORDER BY p), []) FROM (SELECT u, min(p) AS p FROM (SELECT unnest(x) AS u, unnest(range(len(x))) AS p FROM (SELECT regexp_extract_all(html, '<img[^>]+src=["'']([^"'']+)["'']', 1) AS x)) GROUP BY u)) AS list_distinct_ordered FROM pages)""",
    ),
    "f26_f28_bodies": (
        lambda s, d: A.unified(s, d).select("source", "id", X.first_text(("rewritten", F.when(C("lang") == "fr", C("title"))), ("cleaned", F.when(C("lang") == "de", "").otherwise(C("title"))), ("body", C("body")))["origin"].alias("origin"), X.translated_body(F.when(C("lang") == "es", C("title")), F.when(C("lang") == "de", C("title"))).alias("translated")),
        A.with_tables("SELECT source, id, CASE WHEN lang = 'fr' AND title <> '' THEN 'rewritten' WHEN lang <> 'de' AND title <> '' THEN 'cleaned' WHEN body <> '' THEN 'body' ELSE 'none' END AS origin, CASE WHEN lang IN ('es', 'de') THEN nullif(title, '') END AS translated FROM unified", "unified"),
    ),
    "f29_f32_html_text": (
        lambda s, d: pages(s, d).select("page_id", F.length(html_text(C("html"))).alias("n_chars"), F.size(F.regexp_extract_all("html", F.lit("""<a[^>]+href=["']([^"']+)["']"""), 1)).alias("links")),
        r"""SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript)\b.*?</(script|style|noscript)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS n_chars, len(regexp_extract_all(html, '<a[^>]+href=["'']([^"'']+)["'']', 1)) AS links FROM pages""",
    ),
    "f34_chunks": (lambda s, d: docs(s, d).select("doc_id", F.posexplode(X.body_chunks(C("text"), F.lit(2000))).alias("chunk", "body")).select("doc_id", "chunk", F.length("body").alias("n_chars")), f"WITH {chunks_sql('text', 2000)} SELECT doc_id, unnest(range(len(chunks))) AS chunk, length(unnest(chunks)) AS n_chars FROM c"),
    "f35_paragraphs": (
        lambda s, d: docs(s, d).select("doc_id", F.size(X.paragraphs(C("text"))).alias("n")),
        r"SELECT doc_id, len(list_filter(string_split_regex(text, '\n\s*\n'), lambda x: trim(x, E' \t\n\r\f\v') <> '')) AS n FROM documents",
    ),
    "f36_f37_keywords": (lambda s, d: A.table(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(X.question_keywords(C("text")), " ").alias("keywords")), 
        r"SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(text, '[A-Za-z0-9]+|[一-鿿]+'), lambda x: lower(x) NOT IN ('what','is','are','the','a','an','how','why','of','to','do','does','did','in','on','for','and','or','with','about','explain','tell','me','can','you','please','between','vs')), ' ') AS keywords FROM conversations WHERE role = 'user'"),
    "f38_overlap": (
        lambda s, d: A.table(s, d, "conversations").select("conv_id", "turn", X.overlap(F.array(F.lit("the"), F.lit("tion"), F.lit("zzz")), C("text")).alias("overlap")),
        "SELECT conv_id, turn, (contains(lower(text), 'the')::int + contains(lower(text), 'tion')::int) / 3.0::double AS overlap FROM conversations",
    ),
    "f39_f41_citations": (
        lambda s, d: A.unified(s, d).select("source", "id", X.linked_citations(F.concat(F.lit("see ["), C("ref"), F.lit("] and [/article/"), C("ref"), F.lit("]"))).alias("linked"), X.old_image_urls(F.concat(F.lit("http://localhost:8765/"), C("ref"))).alias("image")),
        A.with_tables("SELECT source, id, 'see [' || substr(ref, 1, 6) || '](articles/' || ref || '.html) and [' || substr(ref, 1, 6) || '](articles/' || ref || '.html)' AS linked, '/static/img/' || ref AS image FROM unified", "unified"),
    ),
    "f43_f46_sentences": (
        lambda s, d: docs(s, d).select("doc_id", F.size(X.sentences(C("text"))).alias("sentences"), F.length(X.without_first_heading(C("text"))).alias("n_chars")),
        r"SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, E' \t\n\r\f\v') <> '')) AS sentences, length(regexp_replace(text, '^\s*#[ \t]+[^\n]*\n?', '')) AS n_chars FROM documents",
    ),
    "f47_main_entity": (
        lambda s, d: _main_entity(s, d),
        "SELECT conv_id, turn, min(slug) AS slug FROM conversations JOIN (SELECT DISTINCT lower(r_name) AS slug FROM region UNION SELECT 'tion' UNION SELECT 'the') ON contains(lower(text), slug) WHERE role = 'user' GROUP BY 1, 2",
    ),
    "f48_source_chunks": (
        lambda s, d: A.ingestions(s, d).select("id", F.array_join(X.source_chunks(F.concat_ws("<SEP>", F.concat(F.lit("chunk-"), "event_type"), "source", F.concat(F.lit("chunk-"), "status"))), ",").alias("chunks")),
        A.with_tables("SELECT id, 'chunk-' || event_type || ',chunk-' || status AS chunks FROM ingestions", "ingestions"),
    ),
    "f49_domains": (
        lambda s, d: pages(s, d).groupBy(X.source_domain(C("url")).alias("domain")).agg(F.count("*").alias("n")),
        r"SELECT regexp_replace(nullif(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), ''), '^www\.', '') AS domain, count(*) AS n FROM pages GROUP BY 1",
    ),
    "f53_canonical_names": (
        lambda s, d: docs(s, d).select("doc_id", F.md5(X.canonical_names(C("text"), F.array(F.struct(F.lit("the").alias("raw"), F.lit("THE").alias("canonical")), F.struct(F.lit("THEre").alias("raw"), F.lit("there").alias("canonical"))))).alias("digest")),
        "SELECT doc_id, md5(replace(replace(text, 'the', 'THE'), 'THEre', 'there')) AS digest FROM documents",
    ),
    "f54_f56_sections": (
        lambda s, d: A.table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t")).select("conv_id", X.numbered_sections(F.transform("t", lambda x: x["role"]), F.transform("t", lambda x: F.when(x["role"] != "system", x["turn"].cast("string")))).alias("answers"), X.reference_list(F.transform("t", lambda x: x["role"])).alias("refs")),
        r"SELECT conv_id, array_to_string(list(CASE WHEN role <> 'system' THEN '### ' || n || '. ' || role || E'\n\n' || turn END ORDER BY turn), E'\n\n') AS answers, string_agg(n || '. ' || role, E'\n' ORDER BY turn) AS refs FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS n FROM conversations) GROUP BY 1",
    ),
    "f62_longest": (
        lambda s, d: A.unified(s, d).select("source", "id", F.length(X.longest(C("title"), C("url"), C("publisher"))).alias("n")),
        A.with_tables("SELECT source, id, greatest(length(title), length(url), length(publisher)) AS n FROM unified", "unified"),
    ),
    "d1_d2_times": (
        lambda s, d: A.rss_articles(s, d).select("id", D.feed_time(C("published_at"), C("fetched_at")).alias("at")).unionByName(A.articles(s, d).select("id", D.epoch_to_iso(C("update_time")).alias("at"))),
        A.with_tables("SELECT id, replace(fetched_at, ' ', 'T') || '+00:00' AS at FROM rss_articles UNION ALL SELECT id, strftime(make_timestamp(update_time * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') FROM articles", "articles", "rss_articles"),
    ),
    "d3_d5_time_texts": (
        lambda s, d: A.rss_articles(s, d).select("id", F.date_format(D.any_time(C("published_at")), "yyyy-MM-dd HH:mm:ss").alias("any"), D.export_time(C("fetched_at")).alias("export"), D.humanized(C("published_at"), F.lit("2023-11-20").cast("date"), "en").alias("human")),
        A.with_tables("SELECT id, fetched_at AS any, replace(fetched_at, ' ', 'T') || 'Z' AS export, CASE WHEN k <= 0 THEN 'Today' WHEN k < 7 THEN k || CASE k WHEN 1 THEN ' day ago' ELSE ' days ago' END ELSE strftime(f, '%b %-d, %Y') END AS human FROM (SELECT *, cast(fetched_at AS timestamp) AS f, date_diff('day', cast(fetched_at AS date), date '2023-11-20') AS k FROM rss_articles)", "rss_articles"),
    ),
    "d6_d10_windows": (
        lambda s, d: A.ingestions(s, d).select("id", F.floor(D.age_hours(C("ingested_at").cast("timestamp"), F.lit("2024-12-31").cast("timestamp"))).alias("hours"), D.is_stale(F.to_date("ingested_at"), F.lit("2024-12-31").cast("date")).alias("stale"), D.in_window(C("ingested_at"), F.lit("2024-01-10").cast("date"), 5).alias("inside"), D.retry_days(C("article_id")).alias("retry"), D.transition(F.lit(1), F.when(C("status") == "ok", "applied").when(C("status") == "failed", "retry").otherwise("rejected"), F.to_date("ingested_at")).alias("t")).select("id", "hours", "stale", "inside", "retry", "t.status", "t.attempts", F.col("t.next_retry_at").cast("string").alias("next")),
        A.with_tables("SELECT id, cast(floor((epoch(timestamp '2024-12-31') - floor(epoch(ingested_at)))::double / 3600) AS bigint) AS hours, date_diff('day', cast(ingested_at AS date), date '2024-12-31') > 180 AS stale, cast(ingested_at AS date) BETWEEN date '2024-01-06' AND date '2024-01-10' AS inside, CASE WHEN article_id <= 1 THEN 1 WHEN article_id = 2 THEN 3 ELSE 7 END AS retry, CASE status WHEN 'ok' THEN 'applied' WHEN 'failed' THEN 'retry' ELSE 'rejected' END AS status, 2 AS attempts, CASE WHEN status = 'failed' THEN cast(cast(ingested_at AS date) + 3 AS varchar) END AS next FROM ingestions", "ingestions"),
    ),
    "m1_m7_budgets": (
        lambda s, d: docs(s, d).select("doc_id", D.article_budget(F.length("text") * 200, F.lit(7)).alias("budget"), D.clamped_timeout(F.lit(900.0), C("n_chars").cast("double")).alias("timeout"), D.queue_budget(F.lit(600), C("n_chars"), F.lit(99999)).alias("queue"), D.cooldown(F.least(C("n_chars"), F.lit(9))).alias("cooldown"), D.burn_rate(C("n_chars").cast("double"), F.lit(0.0), F.lit(2.0)).alias("burn"), D.keeps_image(C("n_chars"), F.lit(500)).alias("image"), D.cost(C("n_chars"), F.lit(3)).cast("double").alias("cost"), D.age_text(C("n_chars") * 50).alias("age")),
        "SELECT doc_id, greatest(120 + 30 * greatest(1, length(text) * 200 // 4800) + 210, 3600) AS budget, CASE WHEN n_chars > 60 THEN least(900.0::double, n_chars - 60) ELSE greatest(60, n_chars / 2)::double END AS timeout, least(99999, greatest(600, n_chars * 200)) AS queue, least(30 * pow(2.0, least(n_chars, 9) - 1), 1800.0) AS cooldown, 1.0::double AS burn, least(n_chars, 500) >= 300 AS image, n_chars * 3 * 0.0013::double AS cost, CASE WHEN a < 60 THEN a || 's' WHEN a < 3600 THEN (a // 60) || 'm' WHEN a < 86400 THEN (a // 3600) || 'h ' || (a % 3600 // 60) || 'm' ELSE (a // 86400) || 'd ' || (a % 86400 // 3600) || 'h' END AS age FROM (SELECT *, n_chars * 50 AS a FROM documents)",
    ),
    "r1_r2_json": (
        lambda s, d: A.rss_articles(s, d).select("id", F.array_join(D.known_topics(C("topics"), ("es", "fr", "src1", "src2")), ",").alias("topics"), F.array_join(D.tag_list(C("topics")), ",").alias("tags"), F.array_join(D.tag_list(F.concat_ws(", ", "feed", "lang")), ",").alias("csv")),
        A.with_tables("SELECT id, array_to_string(list_sort(list_filter([feed, lang], lambda x: x IN ('es', 'fr', 'src1', 'src2'))), ',') AS topics, feed || ',' || lang AS tags, feed || ',' || lang AS csv FROM rss_articles", "rss_articles"),
    ),
    "r8_props": (
        lambda s, d: A.ingestions(s, d).select("id", F.from_json("props", "struct<k:long>")["k"].alias("k")),
        A.with_tables("SELECT id, cast(json_extract(props, '$.k') AS bigint) AS k FROM ingestions", "ingestions"),
    ),
}


def html_text(html):
    """Visible text of a page, by tag removal."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</(script|style|noscript)>", " ")
    return X.collapse(F.regexp_replace(t, "<[^>]*>", " "))


def _main_entity(s, d):
    """a small slug list is broadcast; its size is that of the region table."""
    slugs = A.table(s, d, "region").select(F.lower("r_name").alias("slug")).union(s.createDataFrame([("tion",), ("the",)], "slug string")).distinct()
    asked = A.table(s, d, "conversations").where("role = 'user'")
    return asked.join(F.broadcast(slugs), F.lower("text").contains(F.col("slug"))).groupBy("conv_id", "turn").agg(F.min("slug").alias("slug"))
