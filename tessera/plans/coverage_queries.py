"""Queries of repeated-entity grouping (S14, J23, R6, A16) and of halved batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import batches as B
from tessera.operators import coverage as G
from tessera.sources import analogs as A

C = F.col
#: The model for checks is cut off beyond so many characters of titles.
LIMIT, BATCH = 1420, 96


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.unified(spark, sf_dir).select("id", "source", "ref", "title", "body", "lang", "publisher", "layer1_verdict", "layer2_verdict")


def words(title: Column) -> Column:
    return F.filter(F.split(title, " "), lambda w: F.length(w) >= 6)


def buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English articles have a buffer of named objects; German ones an unreadable one before one of names; Spanish ones an empty one before it."""
    a = articles(spark, sf_dir).withColumn("words", words(C("title")))
    plain = F.to_json(F.struct(C("words").alias("raw_entities")))
    objects = F.to_json(F.struct(F.transform("words", lambda w: F.struct(w.alias("name"))).alias("raw_entities")))
    parts = [
        a.where("lang = 'en'").select(*G.KEY, F.lit(1).alias("place"), objects.alias("document")),
        a.where("lang = 'de'").select(*G.KEY, F.lit(0).alias("place"), F.lit('{"raw_entities": "none"}').alias("document")),
        a.where("lang = 'es'").select(*G.KEY, F.lit(0).alias("place"), F.lit('{"raw_entities": []}').alias("document")),
        a.where("lang IN ('de', 'es')").select(*G.KEY, F.lit(1).alias("place"), plain.alias("document")),
    ]
    return G.buffered(parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]))


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as a graph: the first word is an entity, related to the last one; articles that the second layer rejects have no chunk."""
    a = articles(spark, sf_dir).where("title IS NOT NULL").select(
        F.concat_ws("/", "source", "id").alias("pos"), *G.KEY, "layer2_verdict", F.split_part("title", F.lit(" "), F.lit(1)).alias("head"), F.split_part("title", F.lit(" "), F.lit(-1)).alias("tail"),
        F.concat(F.lit("chunk-"), "ref").alias("chunk"))
    entities = a.select("pos", C("head").alias("entity_name"), C("chunk").alias("source_id"))
    relations = a.select("pos", C("head").alias("src_id"), C("tail").alias("tgt_id"), F.concat("chunk", F.lit("<SEP> other "), "chunk").alias("source_id"))
    return G.graph_pairs(entities, relations, a.where("layer2_verdict IS NULL OR layer2_verdict <> 'reject'").select("chunk", *G.KEY))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the body's length: names with a number among them, none, too many, or no answer."""
    n = F.length("body")
    text = F.when(n > 2000, F.concat(F.lit('{"entities": ["Long Read", 5, " ", "'), "publisher", F.lit('"]}'))).when(n > 1000, '{"entities": []}').when(n > 400, '{"entities": ["a", "b", "c", "d"]}').when(n > 200, "[]")
    return articles(spark, sf_dir).select(*G.KEY, text.alias("answer"))


def discovered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    eligible = articles(spark, sf_dir).where("layer1_verdict IS NULL OR layer1_verdict <> 'reject'")
    return G.discovered(eligible, buffers(spark, sf_dir), graph(spark, sf_dir), answers(spark, sf_dir))


_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"
_GRAPH = f"""
a AS (SELECT source || '/' || id AS pos, source, ref, layer2_verdict AS l2, split_part(title, ' ', 1) AS head, split_part(title, ' ', -1) AS tail FROM unified WHERE title IS NOT NULL),
g_rows AS (SELECT '0/' || pos || '/0' AS place, head AS name, source, ref, l2 FROM a UNION ALL SELECT '1/' || pos || '/0', head, source, ref, l2 FROM a UNION ALL SELECT '1/' || pos || '/1', tail, source, ref, l2 FROM a),
g_places AS (SELECT name, min(place) AS place FROM g_rows WHERE name <> '' GROUP BY name),
g_found AS (SELECT DISTINCT name, {_SLUG.format('name')} AS entity, source, ref FROM g_rows WHERE name <> '' AND (l2 IS NULL OR l2 <> 'reject')),
g_winners AS (SELECT entity, arg_min(name, place) AS name FROM (SELECT DISTINCT name, entity FROM g_found WHERE entity <> '') JOIN g_places USING (name) GROUP BY entity),
graph AS (SELECT entity, source, ref FROM g_found JOIN g_winners USING (name, entity))"""
_DISCOVERED = f"""{_GRAPH},
eligible AS (SELECT source, ref, title, body, lang, publisher FROM unified WHERE layer1_verdict IS NULL OR layer1_verdict <> 'reject'),
own AS (SELECT DISTINCT source, ref, {_SLUG.format('w')} AS entity FROM (SELECT source, ref, unnest(string_split(title, ' ')) AS w FROM eligible WHERE lang IN ('en', 'de')) WHERE length(w) >= 6),
buffered AS (SELECT * FROM own WHERE entity <> ''),
pairs AS (SELECT entity, source, ref, 'buffer' AS mapped FROM buffered UNION ALL SELECT entity, source, ref, 'graph' FROM graph SEMI JOIN eligible USING (source, ref) ANTI JOIN buffered USING (source, ref)),
grouped AS (SELECT entity FROM pairs GROUP BY entity HAVING count(*) >= 2),
covered AS (SELECT DISTINCT source, ref FROM pairs SEMI JOIN grouped USING (entity)),
mapped AS (SELECT source, ref, min(mapped) AS mapped FROM pairs GROUP BY source, ref),
classes AS (
  SELECT source, ref, mapped, CASE WHEN c THEN 'represented' WHEN length(body) > 2000 THEN 'represented' WHEN length(body) > 1000 THEN 'no_wiki_entity' ELSE 'retry_unresolved' END AS class, NOT c AND length(body) > 2000 AS named, publisher
  FROM (SELECT e.*, mapped, (source, ref) IN (SELECT (source, ref) FROM covered) AS c FROM eligible e LEFT JOIN mapped USING (source, ref))),
jobs AS (SELECT entity, source, ref FROM pairs SEMI JOIN grouped USING (entity) UNION SELECT unnest(['long-read', {_SLUG.format('publisher')}]), source, ref FROM classes WHERE named)"""


def _cut_off(rows: list[dict]) -> list[dict] | str:
    """A model for checks: titles of twenty characters or more get an answer."""
    if sum(len(r["title"] or "") for r in rows) > LIMIT:
        return B.TRUNCATED
    return [{"index": i, "long": len(r["title"]) >= 40} if len(r["title"] or "") >= 20 else {"long": False} for i, r in enumerate(rows)]


def halved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir).select(F.concat_ws("_", "source", "id").alias("key"), "title")
    out = B.halved(rows, ["key"], _cut_off, batch=BATCH)
    return out.select("index", "key", F.get_json_object("answer", "$.index").cast("long").alias("answer_index"), (F.get_json_object("answer", "$.long") == "true").alias("long"))


QUERIES = {
    "j23_graph_articles": (graph, A.with_tables(f"WITH {_GRAPH.strip()} SELECT * FROM graph", "unified")),
    "s14_buffers": (
        lambda s, d: buffers(s, d).select(*G.KEY, F.array_join(F.array_sort("entities"), ",").alias("entities")),
        A.with_tables(
            f"WITH w AS (SELECT DISTINCT source, ref, {_SLUG.format('w')} AS e FROM (SELECT source, ref, unnest(string_split(title, ' ')) AS w FROM unified WHERE lang IN ('en', 'de')) WHERE length(w) >= 6), "
            "l AS (SELECT source, ref, string_agg(e, ',' ORDER BY e) AS e FROM w WHERE e <> '' GROUP BY source, ref) "
            "SELECT source, ref, coalesce(e, '') AS entities FROM unified LEFT JOIN l USING (source, ref) WHERE lang IN ('en', 'de', 'es')", "unified"),
    ),
    "a16_coverage": (lambda s, d: discovered(s, d)[0], A.with_tables(f"WITH {_DISCOVERED.strip()} SELECT source, ref, mapped, class FROM classes", "unified")),
    "a16_jobs": (lambda s, d: discovered(s, d)[1], A.with_tables(f"WITH {_DISCOVERED.strip()} SELECT * FROM jobs", "unified")),
    "a16_accounting": (
        lambda s, d: G.summary(*discovered(s, d)),
        A.with_tables(
            f"WITH {_DISCOVERED.strip()} SELECT 'eligible' AS name, count(*) AS n FROM classes UNION ALL SELECT 'mapped_by_buffer', count(*) FROM classes WHERE mapped = 'buffer' "
            "UNION ALL SELECT 'mapped_by_graph', count(*) FROM classes WHERE mapped = 'graph' UNION ALL SELECT k, count(*) FILTER (class = k) FROM classes, (SELECT unnest(['represented', 'no_wiki_entity', 'retry_unresolved']) AS k) GROUP BY k "
            "UNION ALL SELECT 'jobs', count(DISTINCT entity) FROM jobs", "unified"),
    ),
    "w9_halved_batches": (
        halved,
        A.with_tables(
            f"""WITH t AS (SELECT source || '_' || id AS key, coalesce(title, '') AS title, row_number() OVER (ORDER BY source || '_' || id) - 1 AS i FROM unified),
            s AS (SELECT i, key, title, sum(length(title)) OVER (ORDER BY i) AS upto FROM t),
            f(batch, low, high) AS (
              SELECT i, i, least(i + {BATCH}, (SELECT count(*) FROM t)) FROM t WHERE i % {BATCH} = 0
              UNION ALL SELECT batch, unnest([low, low + (high - low) // 2]), unnest([low + (high - low) // 2, high]) FROM (SELECT f.*, h.upto - l.upto + length(l.title) AS n FROM f JOIN s l ON l.i = low JOIN s h ON h.i = high - 1) WHERE n > {LIMIT} AND high - low >= 25),
            r AS (SELECT f.*, h.upto - l.upto + length(l.title) AS n FROM f JOIN s l ON l.i = low JOIN s h ON h.i = high - 1),
            lost AS (SELECT DISTINCT batch FROM r WHERE n > {LIMIT} AND high - low < 25)
            SELECT i AS "index", key, i AS answer_index, length(title) >= 40 AS "long" FROM s WHERE length(title) >= 20 AND i - i % {BATCH} NOT IN (SELECT batch FROM lost)""", "unified").replace("WITH ", "WITH RECURSIVE ", 1),
    ),
}
