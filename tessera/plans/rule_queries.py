"""Queries of rules over inputs that given tables make: hits and misses on both sides of each rule, and SQL that computes the results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import classify, coverage, merges, relational, wiki
from tessera.sources import analogs as A

C = F.col
NL2 = "\n\n"


def documents(s: SparkSession, d: str) -> DataFrame:
    return A.table(s, d, "documents")


def joined(*columns: Column) -> Column:
    """Values side by side; null stays visible."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("∅")) for c in columns])


def patches(s: SparkSession, d: str) -> DataFrame:
    """The first two lines of an order as a patch's operations, the order as the page."""
    op = F.when(C("l_quantity") >= 47, "DELETE_PAGE").when(C("l_returnflag") == "A", "SET_METADATA").when(C("l_returnflag") == "R", "MERGE_SOURCES").when(C("l_linestatus") == "O", "UPSERT_SECTION").when(C("l_quantity") > 40, "RENAME").otherwise("CREATE_PAGE")
    keys = F.when(C("l_discount") < 0.02, F.array(F.lit("title"))).when(C("l_discount") < 0.04, F.array().cast("array<string>")).otherwise(F.array(F.lit("last_updated")))
    lines = A.table(s, d, "lineitem").where("l_linenumber <= 2").select(C("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_partkey", op.alias("op"), keys.alias("keys")).alias("line"))
    ops = lines.groupBy("o_orderkey").agg(F.transform(F.sort_array(F.collect_list("line")), lambda x: F.struct(x["op"].alias("op"), x["keys"].alias("keys"))).alias("ops"))
    orders = A.table(s, d, "orders").join(ops, "o_orderkey")
    legacy = C("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return orders.select("o_orderkey", classify.patch_class(C("ops"), C("o_orderstatus") != "P", C("o_totalprice") > 100_000, legacy, C("o_orderpriority") == "1-URGENT").alias("class"))


_PATCHES = """
WITH l AS (
  SELECT l_orderkey AS o_orderkey, CASE WHEN l_quantity >= 47 THEN 'DELETE_PAGE' WHEN l_returnflag = 'A' THEN 'SET_METADATA' WHEN l_returnflag = 'R' THEN 'MERGE_SOURCES' WHEN l_linestatus = 'O' THEN 'UPSERT_SECTION' WHEN l_quantity > 40 THEN 'RENAME' ELSE 'CREATE_PAGE' END AS op,
    CASE WHEN l_discount < 0.02 THEN 'title' WHEN l_discount < 0.04 THEN '' ELSE 'last_updated' END AS k FROM lineitem WHERE l_linenumber <= 2),
g AS (
  SELECT o_orderkey, bool_or(op = 'DELETE_PAGE') AS del, bool_or(op = 'SET_METADATA' AND k = 'title') AS strange, bool_or(op = 'CREATE_PAGE') AS cre, bool_or(op = 'UPSERT_SECTION') AS ups, bool_or(op = 'MERGE_SOURCES') AS mer,
    bool_and(op IN ('UPSERT_SECTION', 'MERGE_SOURCES', 'SET_METADATA')) AS promo, bool_and(op = 'SET_METADATA') AS meta, bool_or(k <> '') AS keyed FROM l GROUP BY 1),
p AS (SELECT g.*, o_orderstatus <> 'P' AS e, o_totalprice > 100000 AS a, o_orderpriority = '2-HIGH' AS bad FROM g JOIN orders USING (o_orderkey))
SELECT o_orderkey, CASE WHEN del THEN 'rejected' WHEN strange THEN 'suggestion_only' WHEN cre THEN CASE WHEN NOT e THEN 'auto_apply' ELSE 'suggestion_only' END
  WHEN ups THEN CASE WHEN a AND e AND NOT bad AND promo THEN 'auto_apply' ELSE 'suggestion_only' END WHEN mer THEN CASE WHEN e AND NOT bad THEN 'auto_apply' ELSE 'suggestion_only' END
  WHEN meta THEN CASE WHEN e AND keyed THEN 'auto_apply' ELSE 'suggestion_only' END ELSE 'suggestion_only' END AS class FROM p"""


def questions(s: SparkSession, d: str) -> DataFrame:
    """the users' turns under openings of stop words, in English and Chinese."""
    opening = F.element_at(F.array(*[F.lit(x) for x in OPENINGS]), (C("turn") % len(OPENINGS) + 1).cast("int"))
    return A.table(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(X.question_keywords(F.concat(opening, F.substring("text", 1, 80))), " ").alias("keywords"))


OPENINGS = ("How to build a ", "请问什么什么是", "什么是AI Agent 和", "知识图谱和RAG的区别，", "Can you tell me about THE ", "是什么区别大 ", "")


def _questions() -> str:
    word = "w"
    for stop in sorted(X.STOP_ZH, key=len, reverse=True):
        word = f"regexp_replace({word}, '^(?:{stop})+(.)', '\\1')"
    stops = lambda words: ", ".join(f"'{w}'" for w in words)
    openings = ", ".join(f"'{o}'" for o in OPENINGS)
    return (
        f"SELECT conv_id, turn, array_to_string(list_filter(list_transform(list_filter(regexp_extract_all([{openings}][turn % {len(OPENINGS)} + 1] || substr(text, 1, 80), '[A-Za-z0-9]+|[{X.CJK}]+'), lambda w: lower(w) NOT IN ({stops(X.STOP_EN)})), lambda w: {word}), lambda w: w NOT IN ({stops(X.STOP_ZH)})), ' ') AS keywords "
        "FROM conversations WHERE role = 'user'"
    )


def chunks(text: Column, size: int) -> Column:
    return X.body_chunks(text, F.lit(size))


def chunks_sql(text: str, size: int) -> str:
    """SQL of ``body_chunks`` as CTEs ending in c(doc_id, chunks): parts in order, folded into chunks."""
    part = "{{'parts': []::varchar[], 'held': '', 't': {t}, 'gap': {gap}, 'run': {run}, 'hard': {hard}}}"
    short = part.format(t="p", gap="chr(10) || chr(10)", run="'p'", hard="false")
    line = part.format(t="x", gap="chr(10)", run="'l' || k", hard="false")
    cut = part.format(t=f"x[i + 1 : i + {size}]", gap="''", run="'h'", hard="true")
    start = part.format(t="''", gap="''", run="''", hard="true")
    lines = f"flatten(list_transform(string_split(p, chr(10)), lambda x: CASE WHEN length(x) > {size} THEN list_transform(range(0, length(x), {size}), lambda i: {cut}) ELSE [{line}] END))"
    same = "a.run = b.run AND NOT b.hard"
    held = f"CASE WHEN {same} THEN a.held ELSE '' END"
    parts = f"CASE WHEN {same} OR a.held = '' THEN a.parts ELSE a.parts || [a.held] END"
    full = f"length({held}) + length(b.gap) + length(b.t) > {size}"
    step = (
        f"{{'parts': CASE WHEN b.hard THEN CASE WHEN b.run = '' THEN []::varchar[] ELSE ({parts}) || [b.t] END WHEN {full} THEN ({parts}) || [{held}] ELSE {parts} END, "
        f"'held': CASE WHEN b.hard THEN '' WHEN {full} THEN b.t WHEN ({held}) = '' THEN b.t ELSE ({held}) || b.gap || b.t END, 't': '', 'gap': '', 'run': b.run, 'hard': b.hard}}"
    )
    return (
        f"src AS (SELECT doc_id, {text} AS body FROM documents), "
        f"f AS (SELECT doc_id, body, list_reduce(list_prepend({start}, flatten(list_transform(range(1, len(string_split(body, chr(10) || chr(10))) + 1), lambda k: list_transform([string_split(body, chr(10) || chr(10))[k]], lambda p: CASE WHEN length(p) <= {size} THEN [{short}] ELSE {lines} END)[1]))), lambda a, b: {step}) AS r FROM src), "
        f"c AS (SELECT doc_id, CASE WHEN length(body) <= {size} THEN [body] WHEN r.held <> '' THEN r.parts || [r.held] ELSE r.parts END AS chunks FROM f)"
    )


def parity(s: SparkSession, d: str) -> DataFrame:
    """texts of some paragraphs and images against sources of n_chars mod 6 images."""
    body = F.concat(F.when(C("n_chars") % 4 == 0, "![](0)\n\n").otherwise(""), F.replace(F.substring("text", 1, 300), F.lit(". "), F.lit(f".{NL2}")))
    images = F.array_join(F.transform(F.sequence(F.lit(0), C("n_chars") % 6), lambda i: F.when(i == 0, "text ").otherwise(F.concat(F.lit("![]("), i.cast("string"), F.lit(")")))), " ")
    return documents(s, d).select("doc_id", X.image_parity(body, images).alias("body"))


_PARITY = """
WITH b AS (SELECT doc_id, n_chars % 6 AS want, CASE WHEN n_chars % 4 = 0 THEN 1 ELSE 0 END AS have, CASE WHEN n_chars % 4 = 0 THEN '![](0)' || chr(10) || chr(10) ELSE '' END || replace(substr(text, 1, 300), '. ', '.' || chr(10) || chr(10)) AS body FROM documents),
p AS (SELECT *, regexp_split_to_array(body, '\\n\\s*\\n') AS parts, list_transform(range(have + 1, want + 1), lambda i: '![](' || i || ')') AS imgs FROM b),
m AS (SELECT *, len(parts) AS m, len(imgs) AS n FROM p)
SELECT doc_id, CASE WHEN have >= want THEN body WHEN body = '' THEN array_to_string(imgs, chr(10) || chr(10))
  WHEN m < 2 THEN array_to_string([regexp_replace(body, '\\s+$', '')] || imgs, chr(10) || chr(10)) || chr(10)
  ELSE array_to_string(flatten(list_transform(range(1, m + 1), lambda k: [parts[k]] || list_transform(list_filter(range(0, n), lambda i: least(greatest((i + 1) * m // (n + 1), 1), m - 1) = k), lambda i: imgs[i + 1]))), chr(10) || chr(10)) END AS body
FROM m"""


def sections(s: SparkSession, d: str) -> DataFrame:
    """texts with an English and a Chinese reference section of n_chars mod 3 and mod 4 links."""
    first = F.concat(F.lit("\n## References\n"), F.repeat(F.lit("- [a](b)\n"), (C("n_chars") % 3).cast("int")))
    second = F.when(C("n_chars") % 5 > 0, F.concat(F.lit("**参考资料**\n"), F.repeat(F.lit("[1](x)\n"), (C("n_chars") % 4).cast("int")))).otherwise("")
    return documents(s, d).select("doc_id", X.one_reference_section(F.concat(F.lit("t"), first, second, F.lit("## End\nx"))).alias("body"))


_SECTIONS = """
WITH n AS (SELECT doc_id, n_chars % 3 AS a, n_chars % 4 AS b, n_chars % 5 > 0 AS two FROM documents),
x AS (SELECT *, '## References' || chr(10) || repeat('- [a](b)' || chr(10), a) AS first, '**参考资料**' || chr(10) || repeat('[1](x)' || chr(10), b) AS second FROM n)
SELECT doc_id, 't' || chr(10) || CASE WHEN NOT two THEN first WHEN b > a THEN second ELSE first END || '## End' || chr(10) || 'x' AS body FROM x"""


def rendering(s: SparkSession, d: str) -> DataFrame:
    """a citation and a code block of each order, known and unknown ones."""
    lang = F.element_at(F.array(*[F.lit(x) for x in LANGS]), (C("o_orderkey") % len(LANGS) + 1).cast("int"))
    body = F.concat(F.lit("see[^s"), (C("o_custkey") % 4).cast("string"), F.lit("] "), F.when(C("o_orderstatus") == "F", F.concat(F.lit('<div class="codehilite">\n<pre><span></span><code class="language-'), lang, F.lit('">'))).otherwise(F.concat(F.lit('<div class="language-'), lang, F.lit(' highlighter-rouge">'))))
    sources = F.array(*[F.struct(F.lit(f"s{i}").alias("id")) for i in (1, 3)])
    return A.table(s, d, "orders").select("o_orderkey", wiki.labelled_code(wiki.rendered_citations(body, sources)).alias("body"))


LANGS = ("Python", "sh", "zig", "cpp", "md")
_LABELS = {"Python": "Python", "sh": "Shell", "zig": "ZIG", "cpp": "C++", "md": "Markdown"}
_RENDERING = f"""
WITH o AS (SELECT o_orderkey, o_orderstatus, o_custkey % 4 AS k, [{", ".join(f"'{x}'" for x in LANGS)}][o_orderkey % {len(LANGS)} + 1] AS lang, [{", ".join(f"'{_LABELS[x]}'" for x in LANGS)}][o_orderkey % {len(LANGS)} + 1] AS label FROM orders)
SELECT o_orderkey, 'see' || CASE k WHEN 1 THEN '<sup><a href="#ref-1">1</a></sup>' WHEN 3 THEN '<sup><a href="#ref-2">2</a></sup>' ELSE '[^s' || k || ']' END || ' ' ||
  CASE WHEN o_orderstatus = 'F' THEN '<div class="codehilite" data-lang-label="' || label || '"><pre><span></span><code class="language-' || lang || '">' ELSE '<div class="language-' || lang || ' highlighter-rouge" data-lang-label="' || label || '">' END AS body FROM o"""


def languages(s: SparkSession, d: str) -> DataFrame:
    """F9-F17 over texts some of whose vowels are Chinese characters: a different share in every source."""
    some = F.when(C("n_chars") % 4 == 0, F.translate("text", "aeiou", "知识图谱检")).when(C("n_chars") % 4 == 1, F.translate("text", "aeou", "知识图谱")).when(C("n_chars") % 4 == 2, F.concat(F.lit("检"), "text")).otherwise(C("text"))
    body = F.when(C("n_chars") % 7 == 0, F.substring(some, 1, 30)).when(C("n_chars") % 11 == 0, None).otherwise(some)
    title = F.when(C("n_chars") % 13 == 0, "检索").otherwise("plain")
    t = documents(s, d).select("doc_id", "lang", title.alias("t"), body.alias("b"), F.when(C("n_chars") % 2 == 0, "rss").otherwise("wechat").alias("source"))
    given = F.when(C("lang") == "en", "zh").when(C("lang") == "de", "").when(C("lang") == "fr", None).otherwise(C("lang"))
    effective = X.effective_language(X.canonical_language(given), C("source"))
    pair = X.localized(C("t"), F.when(C("lang") == "es", "other").when(C("lang") == "de", ""), effective)
    return t.select(
        "doc_id", X.has_cjk(C("b")).alias("cjk"), X.language_by_any(C("t"), C("b")).alias("by_any"), X.language_by_share(C("b")).alias("by_share"), X.language_by_head(C("b")).alias("by_head"),
        X.language_of_question(C("b")).alias("of_question"), X.target_language(X.language_by_any(C("t"), C("b"))).alias("target"), effective.alias("effective"), pair["zh"].alias("zh"), pair["en"].alias("en"))


def _share(text: str) -> str:
    return f"length(regexp_replace({text}, '[^{X.CJK}]', '', 'g')) / nullif(length({text}), 0)"


_LANGUAGES = f"""
WITH s AS (
  SELECT doc_id, lang, n_chars, CASE WHEN n_chars % 4 = 0 THEN translate(text, 'aeiou', '知识图谱检') WHEN n_chars % 4 = 1 THEN translate(text, 'aeou', '知识图谱') WHEN n_chars % 4 = 2 THEN '检' || text ELSE text END AS mixed FROM documents),
t AS (
  SELECT doc_id, lang, CASE WHEN n_chars % 13 = 0 THEN '检索' ELSE 'plain' END AS t, CASE WHEN n_chars % 7 = 0 THEN substr(mixed, 1, 30) WHEN n_chars % 11 = 0 THEN NULL ELSE mixed END AS b,
    CASE WHEN n_chars % 2 = 0 THEN 'rss' ELSE 'wechat' END AS source, CASE lang WHEN 'en' THEN 'zh-CN' WHEN 'es' THEN 'es' ELSE 'unknown' END AS canonical, CASE lang WHEN 'es' THEN 'other' WHEN 'de' THEN '' END AS translated FROM s),
x AS (SELECT *, regexp_matches(coalesce(b, ''), '[一-鿿㐀-䶿]') AS cjk, CASE WHEN canonical IN ('zh-CN', 'en') THEN canonical WHEN source = 'rss' THEN 'en' ELSE 'zh-CN' END AS effective FROM t),
y AS (SELECT *, CASE WHEN cjk OR t = '检索' THEN 'zh-CN' WHEN length(t) + length(coalesce(b, '')) < 50 THEN 'unknown' ELSE 'en' END AS by_any, coalesce(nullif(translated, ''), t) AS other FROM x)
SELECT doc_id, cjk, by_any, CASE WHEN coalesce({_share("regexp_replace(b, '[[:space:]]', '', 'g')")}, 0) > 0.3 THEN 'zh' ELSE 'en' END AS by_share,
  CASE WHEN length(b) > 0 THEN CASE WHEN {_share("substr(b, 1, 1000)")} >= 0.3 THEN 'zh' ELSE 'en' END END AS by_head, CASE WHEN coalesce({_share("b")}, 0) >= 0.3 THEN 'zh' ELSE 'en' END AS of_question,
  CASE WHEN by_any = 'zh-CN' THEN 'en' ELSE 'zh-CN' END AS target, effective, CASE WHEN effective = 'en' THEN other ELSE t END AS zh, CASE WHEN effective = 'en' THEN t ELSE other END AS en FROM y"""


def fallback(s: SparkSession, d: str) -> DataFrame:
    """Answers made of the events' fields: objects of one to four names, of none, lists and plain text."""
    k = F.get_json_object("props", "$.k").cast("int")
    names = F.transform(F.sequence(F.lit(1), k % 5), lambda i: F.concat("event_type", F.lit(" "), (i % 2).cast("string")))
    answer = F.when(k % 5 == 0, '{"entities": []}').when(k % 7 == 0, F.to_json(names)).when(k % 11 == 0, "event_type").otherwise(F.to_json(F.struct(names.alias("entities"))))
    return A.table(s, d, "events").select("event_id", F.array_join(coverage.fallback_slugs(answer), ",").alias("slugs"))


def semantic(s: SparkSession, d: str) -> DataFrame:
    """Answers made of the orders' fields."""
    decision = F.when(C("o_orderstatus") == "F", "APPLY").when(C("o_orderstatus") == "O", "RETRY").otherwise(F.when(C("o_custkey") % 2 == 0, "REJECT").otherwise("LATER"))
    heading = F.when(C("o_custkey") % 3 == 0, "# H").otherwise("H")
    section = F.struct(heading.alias("heading"), F.when(C("o_custkey") % 5 == 0, " ").otherwise("c").alias("content"))
    twice = F.when(C("o_custkey") % 7 == 0, F.array(section, F.struct(F.lit(" h").alias("heading"), F.lit("d").alias("content")))).when(C("o_custkey") % 11 == 0, F.array().cast("array<struct<heading:string,content:string>>")).otherwise(F.array(section))
    answer = F.to_json(F.struct(decision.alias("decision"), twice.alias("sections"), F.when(C("o_orderkey") % 4 == 0, 1).alias("confidence")))
    return A.table(s, d, "orders").select("o_orderkey", classify.semantic_result(F.when(C("o_orderkey") % 10 == 9, "no json").otherwise(answer)).alias("result"))


def decisions(s: SparkSession, d: str) -> DataFrame:
    """Answers made of the events' fields."""
    tools = F.when(C("event_type") == "view", F.array().cast("array<string>")).when(C("event_type") == "click", F.array("event_type"))
    answer = F.when(C("event_type") == "error", C("event_type")).otherwise(F.to_json(F.struct(tools.alias("tools"), F.when(C("value") > 90, True).alias("final"), C("event_type").alias("text"), (C("value") * 2 - 20).cast("int").alias("confidence"))))
    out = classify.agent_decision(answer)
    return A.table(s, d, "events").select("event_id", out["final"].alias("final"), out["text"].alias("text"), out["confidence"].alias("confidence"))


def event_sets(s: SparkSession, d: str) -> DataFrame:
    """Each user's kinds of events before and after the middle of the month."""
    early = F.col("ts").cast("timestamp") < F.lit("2024-01-03").cast("timestamp")
    sets = A.table(s, d, "events").groupBy("user_id").agg(F.collect_set(F.when(early, C("event_type"))).alias("l"), F.collect_set(F.when(~early & (C("value") < 30), C("event_type"))).alias("r"))
    out = relational.differences(C("l"), C("r"))
    return sets.select("user_id", F.array_join(out["dropped"], ",").alias("dropped"), F.array_join(out["added"], ",").alias("added"), F.size(F.array_intersect("l", "r")).alias("n"))


def hash_lookups(s: SparkSession, d: str) -> DataFrame:
    """Every reference and every content hash's head as wanted hashes."""
    u = A.unified(s, d)
    wanted = u.select(C("ref").alias("h")).union(u.select(F.substring("content_hash", 1, 10))).where("h IS NOT NULL").distinct()
    return relational.by_any_hash(wanted, u)


_HASHES = """
WITH w AS (SELECT ref AS h FROM unified UNION SELECT substr(content_hash, 1, 10) FROM unified WHERE content_hash IS NOT NULL),
c AS (
  SELECT h, 1 AS step, source, id FROM w JOIN unified ON source = 'wechat' AND content_hash = h UNION ALL SELECT h, 2, source, id FROM w JOIN unified ON source = 'rss' AND substr(content_hash, 1, 10) = h
  UNION ALL SELECT h, 3, source, id FROM w JOIN unified ON source = 'wechat' AND content_hash IS NULL AND ref = h)
SELECT h, step, source, id FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY step, id) AS n FROM c) WHERE n = 1"""


def reranked(s: SparkSession, d: str) -> DataFrame:
    """Each user's events by value as hits; views and clicks have a score, so that some users have enough and others not."""
    e = A.table(s, d, "events").select(C("user_id").alias("query_id"), C("event_id").cast("string").alias("hash"), "event_type", "value")
    ranked = e.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("value"), "hash")))
    scores = e.where("event_type IN ('view', 'click', 'error')").select("query_id", "hash", (C("value") % 7).alias("score"))
    return relational.rerank(ranked.select("query_id", "hash", "rank"), scores, cap=20).select("query_id", "hash", "new_rank")


_RERANKED = """
WITH h AS (SELECT user_id AS query_id, event_id::varchar AS hash, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id::varchar) AS rank FROM events),
k AS (SELECT *, CASE WHEN event_type IN ('view', 'click', 'error') THEN value % 7 END AS score FROM h WHERE rank <= 20),
e AS (SELECT *, count(score) OVER (PARTITION BY query_id) * 2 >= count(*) OVER (PARTITION BY query_id) AS enough FROM k),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN enough THEN coalesce(score, -1) END DESC NULLS LAST, rank) AS new_rank FROM e)
SELECT query_id, hash, new_rank FROM n WHERE new_rank <= 10"""


def prefiltered(s: SparkSession, d: str) -> DataFrame:
    """users' batches of thirty slots, and events as answers to them."""
    k = F.get_json_object("props", "$.k").cast("int") % 40
    answers = A.table(s, d, "events").select(C("user_id").alias("batch"), k.alias("slot"), C("event_id").alias("pos"), F.when(C("event_type").isin("error", "signup"), "reject").otherwise("keep").alias("decision"), (C("value") / 100).alias("confidence"))
    slots = A.table(s, d, "events").select(C("user_id").alias("batch")).distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(29))))
    return classify.prefiltered(slots, answers).select("batch", "slot", "decision")


_PREFILTERED = """
WITH a AS (SELECT user_id AS batch, cast(json_extract(props, '$.k') AS int) % 40 AS slot, event_type IN ('error', 'signup') AND value / 100 >= 0.5 AS no, row_number() OVER (PARTITION BY user_id, cast(json_extract(props, '$.k') AS int) % 40 ORDER BY event_id) AS n FROM events)
SELECT b.batch, b.slot, CASE WHEN coalesce(no, false) THEN 'reject' ELSE 'keep' END AS decision FROM (SELECT DISTINCT user_id AS batch, unnest(range(30)) AS slot FROM events) b LEFT JOIN a ON a.batch = b.batch AND a.slot = b.slot AND n = 1"""


def page_images(s: SparkSession, d: str) -> DataFrame:
    """pages' addresses as images, some of one host that has local copies."""
    t = F.concat(F.lit("![x](http://a/1.png) "), F.when(F.length("url") % 2 == 0, F.concat(F.lit("![y]("), "url", F.lit(")"))).otherwise(C("url")), F.when(F.length("url") % 3 == 0, " ![z](http://a/2.png)").otherwise(""))
    names = F.create_map(F.lit("http://a/1.png"), F.concat(F.lit("img/"), C("page_id").cast("string"), F.lit(".png")), F.lit("http://a/2.png"), F.lit("two.png"))
    return A.table(s, d, "pages").select("page_id", X.image_count(t).alias("n"), X.localized_images(t, names).alias("body"))


def backfills(s: SparkSession, d: str) -> DataFrame:
    """Failed events are open errors, those of two fingerprints get resolved; articles' missing languages come from their texts."""
    e = A.ingestions(s, d).select("id", F.when(C("status") == "failed", "open").otherwise(C("status")).alias("status"), F.when(C("value") > 20, F.concat("source", F.lit("-"), F.floor(C("value") / 10).cast("string"))).alias("fp"))
    lang = F.when(C("id") % 3 > 0, "known")
    return e.select("id", merges.resolved(C("status"), C("fp"), "rss-3", "wechat-7").alias("status"), merges.filled_language(lang, X.language_by_any(F.when(C("id") % 2 == 0, "检索").otherwise("plain"), C("fp"))).alias("lang"))


QUERIES = {
    "c8_patch_policy": (patches, _PATCHES),
    "f36_question_keywords": (questions, _questions()),
    "f34_body_chunks": (
        lambda s, d: documents(s, d).select("doc_id", chunks(F.replace("text", F.lit(". "), F.lit(f".{NL2}")), 300).alias("c")).select("doc_id", F.size("c").alias("n"), F.md5(F.array_join("c", "\x01")).alias("digest")),
        f"WITH {chunks_sql(chr(39).join(['replace(text, ', '. ', ', ', '.', ' || chr(10) || chr(10))']), 300)} SELECT doc_id, len(chunks) AS n, md5(array_to_string(chunks, chr(1))) AS digest FROM c",
    ),
    "f24_f25_image_parity": (parity, _PARITY),
    "f40_reference_sections": (sections, _SECTIONS),
    "f42_f63_rendering": (rendering, _RENDERING),
    "f9_f17_cjk_languages": (languages, _LANGUAGES),
    "f33_f60_images": (
        page_images,
        "SELECT page_id, 1 + (length(url) % 2 = 0)::int + (length(url) % 3 = 0)::int AS n, '![x](img/' || page_id || '.png) ' || CASE WHEN length(url) % 2 = 0 THEN '![y](' || url || ')' ELSE url END || CASE WHEN length(url) % 3 = 0 THEN ' ![z](two.png)' ELSE '' END AS body FROM pages",
    ),
    "k15_k17_backfills": (
        backfills,
        A.with_tables("SELECT id, CASE WHEN value > 20 AND source || '-' || floor(value / 10)::int IN ('rss-3', 'wechat-7') THEN 'resolved' WHEN status = 'failed' THEN 'open' ELSE status END AS status, CASE WHEN id % 3 > 0 THEN 'known' WHEN id % 2 = 0 THEN 'zh-CN' ELSE 'unknown' END AS lang FROM ingestions", "ingestions"),
    ),
    "r6_fallback_entities": (
        fallback,
        "SELECT event_id, CASE WHEN k % 5 = 0 THEN '' WHEN k % 7 = 0 OR k % 11 = 0 OR k % 5 = 4 THEN NULL WHEN k % 5 = 1 THEN event_type || '-1' ELSE event_type || '-1,' || event_type || '-0' END AS slugs FROM (SELECT event_id, event_type, cast(json_extract(props, '$.k') AS int) AS k FROM events)",
    ),
    "r7_semantic_results": (
        semantic,
        """WITH o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'APPLY' WHEN 'O' THEN 'RETRY' ELSE CASE WHEN o_custkey % 2 = 0 THEN 'REJECT' ELSE 'LATER' END END AS decision, o_custkey AS c FROM orders)
        SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 9 OR o_orderkey % 4 = 0 OR decision = 'LATER' THEN NULL WHEN decision <> 'APPLY' THEN decision
          WHEN c % 7 = 0 THEN CASE WHEN c % 3 = 0 AND c % 5 > 0 THEN NULL END WHEN c % 11 = 0 OR c % 3 = 0 OR c % 5 = 0 THEN NULL ELSE decision END AS result FROM o""",
    ),
    "y19_agent_decisions": (
        decisions,
        "SELECT event_id, event_type <> 'click' OR value > 90 AS final, event_type AS text, CASE WHEN event_type = 'error' THEN 0.0 ELSE least(greatest(trunc(value * 2 - 20)::int, 0), 100) END::double AS confidence FROM events",
    ),
    "u4_u5_set_differences": (
        event_sets,
        "WITH s AS (SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (ts < timestamp '2024-01-03'), []) AS l, coalesce(list(DISTINCT event_type) FILTER (ts >= timestamp '2024-01-03' AND value < 30), []) AS r FROM events GROUP BY 1) "
        "SELECT user_id, array_to_string(list_sort(list_filter(l, lambda x: NOT list_contains(r, x))), ',') AS dropped, array_to_string(list_sort(list_filter(r, lambda x: NOT list_contains(l, x))), ',') AS added, len(list_intersect(l, r)) AS n FROM s",
    ),
    "j14_hash_lookup": (hash_lookups, A.with_tables(_HASHES.strip(), "unified")),
    "j22_without_articles": (
        lambda s, d: relational.without_articles(A.table(s, d, "customer").select(C("c_custkey").alias("account")), A.table(s, d, "orders").where("o_totalprice > 400000").select(C("o_custkey").alias("account"))),
        "SELECT c_custkey AS account FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    ),
    "u7_index_differences": (
        lambda s, d: relational.index_consistency(A.table(s, d, "lineitem").where("l_quantity > 49").select(C("l_partkey").alias("slug")).distinct(), A.table(s, d, "part").where("p_size > 20").select(C("p_partkey").alias("slug"))),
        "WITH p AS (SELECT DISTINCT l_partkey AS slug FROM lineitem WHERE l_quantity > 49), i AS (SELECT p_partkey AS slug FROM part WHERE p_size > 20) SELECT slug, 'missing' AS problem FROM p WHERE slug NOT IN (SELECT slug FROM i) UNION ALL SELECT slug, 'orphan' FROM i WHERE slug NOT IN (SELECT slug FROM p)",
    ),
    "u9_merged_sources": (
        lambda s, d: relational.merged_sources(
            A.table(s, d, "part").where("p_size <= 30").select((C("p_partkey") + 10).cast("int").alias("id"), C("p_type").alias("type"), C("p_partkey").cast("string").alias("key")),
            A.table(s, d, "part").select(F.xxhash64("p_partkey").alias("pos"), C("p_type").alias("type"), C("p_partkey").cast("string").alias("key"), "p_size").withColumn("pos", C("p_size") * 100_000 + C("key").cast("int")).drop("p_size")),
        "WITH o AS (SELECT p_partkey + 10 AS id, p_type AS type, p_partkey::varchar AS key FROM part WHERE p_size <= 30) SELECT * FROM o UNION ALL SELECT (SELECT max(id) FROM o) + row_number() OVER (ORDER BY p_size * 100000 + p_partkey), p_type, p_partkey::varchar FROM part WHERE p_size > 30",
    ),
    "t9_t10_rerank": (reranked, _RERANKED),
    "r5_c6_prefilter": (prefiltered, _PREFILTERED),
    "k6_promotion": (
        lambda s, d: A.unified(s, d).select("source", "id", merges.promoted(C("layer1_verdict"), F.length("body") > 1000).alias("verdict")),
        A.with_tables("SELECT source, id, CASE WHEN length(body) > 1000 AND coalesce(layer1_verdict, 'reject') = 'reject' THEN 'candidate' ELSE layer1_verdict END AS verdict FROM unified", "unified"),
    ),
    "k18_image_counts": (
        lambda s, d: merges.counted_images(A.table(s, d, "customer").select(C("c_custkey").alias("ref")), A.table(s, d, "orders").select(C("o_custkey").alias("ref"))),
        "SELECT c_custkey AS ref, count(o_orderkey) AS image_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    ),
    "y14_stalest_probe": (
        lambda s, d: relational.stalest(A.table(s, d, "customer").select(C("c_custkey").alias("name")).join(A.table(s, d, "orders").where("o_totalprice > 200000").groupBy(C("o_custkey").alias("name")).agg(F.max("o_orderdate").alias("scanned")), "name", "left"), "scanned", "name", 300).select("name"),
        "SELECT c_custkey AS name FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS scanned FROM orders WHERE o_totalprice > 200000 GROUP BY 1) ON o_custkey = c_custkey ORDER BY scanned NULLS FIRST, name LIMIT 300",
    ),
    "s3_y10_optional_columns": (
        lambda s, d: merges.add_missing(merges.add_missing(A.unified(s, d).select("id", "source", "title"), title="string", layer2="string"), layer2="string").select("id", "source", "title", F.coalesce("layer2", F.lit("none")).alias("layer2")),
        A.with_tables("SELECT id, source, title, 'none' AS layer2 FROM unified", "unified"),
    ),
}
