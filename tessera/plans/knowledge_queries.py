"""Queries of evidence, wiki context, suggestions, tags, edits, rewrites and stored JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import predicates as P
from tessera.functions import text as X
from tessera.operators import answers, wiki
from tessera.operators import search as V
from tessera.plans import wiki_queries as W
from tessera.sources import analogs as A
from tessera.sources import readers
from tessera.storage import new_folder

C = F.col
VECTOR = [0.125 if i < 32 else -0.125 for i in range(64)]


def rewrites(s: SparkSession, d: str) -> DataFrame:
    """pages' addresses under a header, with paths of the old server, image lines, and images of hosts that are left out."""
    n = C("page_id").cast("string")
    header = F.when(F.length("url") % 2 == 0, F.concat(F.lit("# T"), n, F.lit("\n\nURL:  "), "url", F.lit("\nTime: 2024-01-02  10:00:00\n\n# T\n\n"))).otherwise("# T\n\n")
    body = F.concat(
        header, F.lit("see http://localhost:8765/a/"), n, F.lit('.png and (/static/img/b.png) "/static/img/c.png" x/static/img/d.png\nImage '), n, F.lit(" from article 'T i': http://localhost:8765/q.jpg\n![e](https://mmbiz.qpic.cn/"), n,
        F.lit(") ![k](http://ok/"), n, F.lit(') <IMG alt="" src="https://mp.weixin.qq.com/x"> <img src="/keep/'), n, F.lit('">'))
    return A.table(s, d, "pages").select("page_id", X.without_metadata_header(X.image_references(X.without_external_images(X.image_paths(body, "/kb")))).alias("body"))


_REWRITES = """
SELECT page_id, CASE WHEN length(url) % 2 = 0 THEN '' ELSE '# T' || chr(10) || chr(10) END || 'see /kb/static/img/a/' || page_id || '.png and (/kb/static/img/b.png) "/kb/static/img/c.png" x/static/img/d.png' || chr(10) ||
  '<img src="/kb/static/img/q.jpg" alt="image ' || page_id || '" loading="lazy">' || chr(10) || ' ![k](http://ok/' || page_id || ')  <img src="/keep/' || page_id || '">' AS body FROM pages"""


def tags(s: SparkSession, d: str) -> DataFrame:
    """Articles under titles of which some name a subject; words end at letters that are not ASCII, as in the SQL."""
    n = C("id") % len(SUBJECTS)
    title = F.concat(F.element_at(F.array(*[F.lit(x) for x in SUBJECTS]), (n + 1).cast("int")), F.lit(" "), "title")
    return A.unified(s, d).select("source", "id", F.array_join(X.merged_tags(C("publisher"), F.concat_ws(" | ", "lang", "source"), X.keyword_tags(title, C("body"), edge=X.ASCII_EDGE), 6), "|").alias("tags"), X.agent_score(F.when(n % 2 == 0, "RAG, Agent").otherwise(C("publisher")), title).alias("score"))


SUBJECTS = ("", "MCP", "the AGENT", "知识图谱与检索", "multimodal 安全 Workflow", "KV 缓存", "mcps RAGs")


def _tags() -> str:
    matches = " || ".join(f"CASE WHEN regexp_matches(t, '(?i){p}') THEN ['{label}'] ELSE [] END" for label, p in X.KEYWORD_TAGS)
    points = " + ".join(f"CASE WHEN contains(lower(g), '{w.lower()}') THEN {n} ELSE 0 END" for w, n in X.AGENT_TAGS.items())
    words = " + ".join(f"CASE WHEN contains(lower(title), '{w.lower()}') THEN 1 ELSE 0 END" for w in X.AGENT_TITLE_WORDS)
    subjects = ", ".join(f"'{x}'" for x in SUBJECTS)
    return (
        f"WITH b AS (SELECT source, id, publisher, lang, [{subjects}][id % {len(SUBJECTS)} + 1] || ' ' || title AS title, body, CASE WHEN id % {len(SUBJECTS)} % 2 = 0 THEN 'RAG, Agent' ELSE publisher END AS g FROM unified), "
        f"k AS (SELECT *, title || ' ' || body AS t FROM b) SELECT source, id, array_to_string(([publisher, lang, source] || {matches})[1:6], '|') AS tags, {points} + {words} AS score FROM k"
    )


def edits(s: SparkSession, d: str) -> DataFrame:
    """pages of which some have the section, at their end or before another one."""
    news = F.when(C("lang") == "en", "\n## News\n\nold\n").when(C("lang") == "es", "\n## News  \nold\n## More\n\nm\n").otherwise("")
    text = W.pages(s, d).join(A.unified(s, d).select(C("ref").alias("slug"), "lang"), "slug").withColumn("text", F.concat("text", news))
    return text.select("slug", wiki.with_section(wiki.with_metadata("text", F.lit("title"), F.lit("x")), F.lit("News"), F.lit(" y ")).alias("text"))


_EDITS = """
WITH p AS (SELECT ref AS slug, lang, '---' || chr(10) || 'title: x' || chr(10) || 'last_updated: ' || substr(update_time, 1, 10) || chr(10) || 'sources:' || chr(10) || '  - id: 1' || chr(10) || '    type: article' || chr(10) || '    ref: ' || ref || chr(10) || '---' || chr(10) || body || chr(10) AS head, body, ref FROM unified),
n AS (SELECT '## News' || chr(10) || chr(10) || 'y' || chr(10) AS news)
SELECT slug, CASE lang WHEN 'en' THEN head || '[^1] [[missing]]' || chr(10) || news WHEN 'es' THEN head || '[^9] [[' || ref || ']]' || chr(10) || news || chr(10) || '## More' || chr(10) || chr(10) || 'm' || chr(10)
  WHEN 'fr' THEN CASE WHEN trim(body, E' \\n\\t') = '' THEN news ELSE rtrim(body, E' \\n\\t') || chr(10) || chr(10) || news END ELSE head || '[^9] [[' || ref || ']]' || chr(10) || chr(10) || news END AS text FROM p, n"""


def hydrated(s: SparkSession, d: str) -> DataFrame:
    """Packs of three events; the document that each names is its chunk, if there is one."""
    packs = A.table(s, d, "events").select(F.floor(C("event_id") / 3).alias("pack"), C("event_id").alias("pos"), (F.get_json_object("props", "$.k").cast("long") * 11).alias("chunk"))
    out = wiki.hydrated(packs, A.table(s, d, "documents").select(C("doc_id").alias("chunk"), "text"), 3000, 1200)
    return out.select("pack", "pos", "chunk", "retry", F.md5("text").alias("digest"))


_HYDRATED = """
WITH p AS (SELECT event_id // 3 AS pack, event_id AS pos, cast(json_extract(props, '$.k') AS bigint) * 11 AS chunk FROM events),
j AS (SELECT p.*, text, bool_or(text IS NULL) OVER (PARTITION BY pack) AS retry, least(length(text), 1200) AS size FROM p LEFT JOIN documents ON doc_id = chunk),
u AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY pack ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM j)
SELECT pack, pos, chunk, retry, CASE WHEN NOT retry THEN md5(substr(text, 1, greatest(0, least(size, 3000 - used))::int)) END AS digest FROM u"""


def contexts(s: SparkSession, d: str) -> DataFrame:
    """C14: the users' turns as questions, and one page for each first word of a title."""
    named = A.unified(s, d).select(C("ref"), F.lower(F.regexp_extract("title", "[A-Za-z]+", 0)).alias("slug")).where("slug <> ''")
    first = named.groupBy("slug").agg(F.min("ref").alias("ref"))
    pages = W.pages(s, d).withColumnRenamed("slug", "ref").join(first, "ref").select("slug", "text")
    questions = A.table(s, d, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.substring("text", 1, 40).alias("question"))
    known = A.unified(s, d).select("ref").distinct()
    return wiki.context(questions, pages, known, F.lit("2024-06-15").cast("date")).select("id", F.length("context").alias("n"), F.md5("context").alias("digest"))


_CONTEXTS = """
WITH named AS (SELECT min(ref) AS ref, lower(regexp_extract(title, '[A-Za-z]+')) AS slug FROM unified WHERE regexp_extract(title, '[A-Za-z]+') <> '' GROUP BY 2),
page AS (SELECT slug, body || chr(10) || '[^1] [[missing]]' AS body, lang = 'en' AND date_diff('day', cast(substr(update_time, 1, 10) AS date), date '2024-06-15') <= 180 AS good FROM named JOIN unified USING (ref)),
q AS (SELECT conv_id || '-' || turn AS id, lower(substr(text, 1, 40)) AS q FROM conversations WHERE role = 'user'),
w AS (SELECT DISTINCT id, unnest(regexp_extract_all(q, '[\\p{L}\\p{N}]+')) AS slug FROM q),
m AS (SELECT id, min(slug) AS slug FROM w SEMI JOIN page USING (slug) GROUP BY id)
SELECT id, length(coalesce(body, '')) AS n, md5(coalesce(body, '')) AS digest FROM q LEFT JOIN m USING (id) LEFT JOIN (SELECT * FROM page WHERE good) p USING (slug)"""


def suggestions(s: SparkSession, d: str) -> DataFrame:
    """Orders as suggestions of all states, the order's status as the outcome of the work on them."""
    status = F.when(C("o_orderpriority") == "1-URGENT", "applied").when(C("o_orderpriority") == "2-HIGH", "rejected").when(C("o_orderpriority") == "3-MEDIUM", "retry").otherwise("new")
    at = F.to_date("o_orderdate")
    rows = A.table(s, d, "orders").select(C("o_orderkey").alias("id"), status.alias("status"), F.when(C("o_custkey") % 2 == 0, at).alias("next_retry_at"), at.alias("created_at"), (C("o_custkey") % 3).cast("int").alias("attempts"))
    outcomes = A.table(s, d, "orders").where("o_orderstatus <> 'P'").select(C("o_orderkey").alias("id"), F.when(C("o_orderstatus") == "F", "applied").otherwise("retry").alias("outcome"))
    return wiki.worked(rows, F.lit("1995-06-01").cast("date"), outcomes, 500).select("id", "status", "attempts", F.date_format("next_retry_at", "yyyy-MM-dd").alias("next_retry_at"))


_SUGGESTIONS = """
WITH r AS (SELECT o_orderkey AS id, o_orderstatus AS st, o_orderpriority AS p, cast(o_orderdate AS date) AS at_day, o_custkey % 2 = 0 AS timed, o_custkey % 3 + 1 AS n FROM orders),
due AS (SELECT * FROM r WHERE p NOT IN ('1-URGENT', '2-HIGH') AND (p <> '3-MEDIUM' OR NOT timed OR at_day <= date '1995-06-01') ORDER BY at_day, id LIMIT 500)
SELECT id, CASE WHEN st = 'F' THEN 'applied' WHEN n < 3 THEN 'retry' ELSE 'rejected' END AS status, n AS attempts,
  CASE WHEN st <> 'F' AND n < 3 THEN strftime(date '1995-06-01' + CASE WHEN n <= 1 THEN 1 ELSE 3 END * INTERVAL 1 day, '%Y-%m-%d') END AS next_retry_at FROM due"""


def evidence(s: SparkSession, d: str) -> DataFrame:
    """Events as evidence of known and unknown types, with and without its parts."""
    kind = F.when(C("event_type") == "view", "article").when(C("event_type") == "click", "web").when(C("event_type") == "signup", "builtin").when(C("event_type") == "error", "other")
    some = lambda m: F.when(C("event_id") % m == 0, " ").when(C("event_id") % m == 1, None).otherwise(C("props"))
    return A.table(s, d, "events").select("event_id", F.array_join(P.evidence_violations(kind, some(5), some(7), some(9)), ",").alias("violations"))


_EVIDENCE = """
SELECT event_id, array_to_string(list_filter([CASE WHEN event_type IN ('error', 'purchase') THEN 'unknown type' END, CASE WHEN event_type IN ('view', 'click', 'error') AND event_id % 5 < 2 THEN 'missing ref' END,
  CASE WHEN event_id % 7 < 2 THEN 'missing title' END, CASE WHEN event_id % 9 < 2 THEN 'missing quote' END], lambda x: x IS NOT NULL), ',') AS violations FROM events"""


def sources(s: SparkSession, d: str) -> DataFrame:
    """Events as what stages gave: images by clicks, nothing at low values."""
    e = A.table(s, d, "events")
    return answers.assembled_sources(e.select(C("user_id").cast("string").alias("stage"), (C("value") > 2).alias("ok"), F.when(C("event_type") == "click", "image").otherwise("text").alias("kind"), C("event_id").cast("string").alias("value"), C("event_id").alias("pos")))


_SOURCES = """
WITH e AS (SELECT user_id::varchar AS stage, value > 2 AS ok, event_type = 'click' AS image, event_id FROM events)
SELECT stage, 'text' AS kind, event_id::varchar AS value FROM e WHERE ok AND NOT image UNION ALL SELECT * FROM (SELECT stage, 'image', event_id::varchar FROM e WHERE ok AND image ORDER BY stage, event_id LIMIT 5)
UNION ALL SELECT DISTINCT stage, 'note', stage || ' gave nothing' FROM e WHERE NOT ok"""


def doc_statuses(s: SparkSession, d: str) -> DataFrame:
    """articles' states as JSON files of one object each, by publisher."""
    u = A.unified(s, d)
    state = F.struct(F.coalesce("layer1_verdict", F.lit("pending")).alias("status"), F.when(C("layer2_verdict") == "reject", "toxic").alias("error_msg"), F.array(F.concat(F.lit("chunk-"), "ref")).alias("chunks_list"), F.length("body").cast("long").alias("content_length"), C("update_time").alias("updated_at"))
    files = u.groupBy("publisher", "source", F.pmod(F.xxhash64("id"), F.lit(8))).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("_", "source", "id"), state)))).alias("value"))
    path = new_folder(s, "doc-status")
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.doc_status(s, path).select("doc", "status", "error_msg", C("chunks_list")[0].alias("chunk"), "content_length", "updated_at")


def store_rows(s: SparkSession, d: str) -> DataFrame:
    """Parts as vector store files, bare lists and objects with ``data``; the rows' other fields are left."""
    rows = A.table(s, d, "part").groupBy("p_brand", "p_size").agg(F.collect_list(F.struct(C("p_name").alias("entity_name"), F.concat_ws("<SEP>", "p_brand", "p_type").alias("source_id"), C("p_retailprice").alias("other"))).alias("data"))
    text = F.when(C("p_size") % 2 == 0, F.to_json(F.struct(F.lit(4).alias("embedding_dim"), "data"))).otherwise(F.to_json("data"))
    kind = T.StructType([T.StructField("entity_name", T.StringType()), T.StructField("source_id", T.StringType())])
    return readers.store_rows(rows.select(text.alias("value")), kind).groupBy("entity_name", "source_id").agg(F.count("*").alias("n"))


def graph_context(s: SparkSession, d: str) -> DataFrame:
    """V4: vectors as chunks, entities and relations (each to the next one), in the mode that has all of them."""
    v = A.table(s, d, "embeddings").select(C("vec_id").cast("string").alias("id"), C("embedding").alias("vector"))
    edges = v.select(F.concat(F.lit("r"), "id").alias("id"), C("id").alias("src_id"), (C("id").cast("long") + 1).cast("string").alias("tgt_id"), "vector")
    return V.graph_context("mix", v, v, edges, VECTOR, 20)


def _cosine(e: str, q: list[float]) -> str:
    other = "[" + ", ".join(map(str, q)) + "]::double[]"
    return f"round(list_inner_product({e}, {other}) / (sqrt(list_inner_product({e}, {e})) * sqrt(list_inner_product({other}, {other}))), 6)"


_GRAPH = f"""
WITH v AS (SELECT vec_id::varchar AS id, {_cosine("embedding::double[]", VECTOR)} AS score FROM embeddings),
n AS (SELECT * FROM v ORDER BY score DESC, id LIMIT 20),
r AS (SELECT 'r' || id AS id, id AS src, (id::bigint + 1)::varchar AS tgt, score FROM v),
g AS (SELECT * FROM r ORDER BY score DESC, id LIMIT 20),
a AS (
  SELECT 'chunk' AS kind, id, score FROM n UNION ALL SELECT 'entity', id, score FROM n UNION ALL SELECT 'relation', r.id, n.score FROM r JOIN n ON r.src = n.id OR r.tgt = n.id
  UNION ALL SELECT 'relation', id, score FROM g UNION ALL SELECT 'entity', unnest([src, tgt]), score FROM g)
SELECT kind, id, max(score) AS score FROM a GROUP BY kind, id"""

QUERIES = {
    "f18_f21_image_rewrites": (rewrites, _REWRITES),
    "f50_f52_tags": (tags, A.with_tables(_tags(), "unified")),
    "f57_f58_edits": (edits, A.with_tables(_EDITS.strip(), "unified")),
    "j24_hydrated_evidence": (hydrated, _HYDRATED),
    "c14_wiki_context": (contexts, A.with_tables(_CONTEXTS.strip(), "unified")),
    "c16_worked_suggestions": (suggestions, _SUGGESTIONS),
    "p22_evidence": (evidence, _EVIDENCE),
    "y22_assembled_sources": (sources, _SOURCES),
    "s5_doc_statuses": (
        doc_statuses,
        A.with_tables("SELECT source || '_' || id AS doc, coalesce(layer1_verdict, 'pending') AS status, CASE WHEN layer2_verdict = 'reject' THEN 'toxic' END AS error_msg, 'chunk-' || ref AS chunk, length(body) AS content_length, update_time AS updated_at FROM unified", "unified"),
    ),
    "s6_store_rows": (store_rows, "SELECT p_name AS entity_name, p_brand || '<SEP>' || p_type AS source_id, count(*) AS n FROM part GROUP BY 1, 2"),
    "v4_graph_context": (graph_context, _GRAPH),
}
