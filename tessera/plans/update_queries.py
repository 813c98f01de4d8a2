"""Queries of cited bodies, research retrieval and update runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import search as V
from tessera.operators import wiki
from tessera.plans import rule_queries as R
from tessera.sources import analogs as A

C = F.col


def cited_bodies(s: SparkSession, d: str) -> DataFrame:
    """articles as four blocks, one of them blank, whose sources have no blocks, some or all."""
    blocks = F.array(C("title"), F.lit(" "), F.concat(F.lit("\n"), F.substring("body", 1, 30)), F.concat(F.lit(" "), "publisher", F.lit(" ")))
    maps = F.expr("CASE id % 4 WHEN 0 THEN CAST(array() AS array<array<int>>) WHEN 1 THEN CAST(array(null, null, null) AS array<array<int>>) WHEN 2 THEN array(array(0, 2), array(3), array(2)) ELSE array(array(3), null) END")
    return A.unified(s, d).select("source", "id", X.cited_blocks(blocks, maps).alias("body"))


_CITED = r"""
WITH b AS (
  SELECT source, id, unnest([title, ' ', chr(10) || substr(body, 1, 30), ' ' || publisher || ' ']) AS block, unnest(range(4)) AS i,
    CASE id % 4 WHEN 0 THEN []::bigint[][] WHEN 1 THEN [NULL, NULL, NULL]::bigint[][] WHEN 2 THEN [[0, 2], [3], [2]]::bigint[][] ELSE [[3], NULL]::bigint[][] END AS maps FROM unified),
t AS (
  SELECT source, id, i, trim(block, E' \n\t\r') AS t, CASE WHEN len(list_filter(maps, lambda m: m IS NOT NULL)) > 0 THEN list_filter(range(1, len(maps) + 1), lambda n: coalesce(list_contains(maps[n], i), false))
    WHEN i < len(maps) THEN [i + 1] ELSE [] END AS ns FROM b)
SELECT source, id, string_agg(t || CASE WHEN len(ns) > 0 THEN ' ' || array_to_string(list_transform(ns, lambda n: '[^' || n || ']'), '') ELSE '' END, chr(10) || chr(10) ORDER BY i) AS body FROM t WHERE t <> '' GROUP BY source, id"""


def research(s: SparkSession, d: str) -> DataFrame:
    """Articles with the hashes of two others as contexts, some blank; pages as images of fifty articles."""
    key = lambda n: F.substring(F.md5(n.cast("string")), 1, 10)
    text = F.concat("title", F.lit("\n \n"), "body", F.lit("\n\n see "), key(C("id") % 60), F.lit(" and "), key(C("id") % 7), F.lit(", "), key(C("id") % 60), F.lit(" x"), key(C("id") % 5))
    contexts = A.unified(s, d).select(F.concat_ws("-", "source", "id").alias("id"), F.when(C("id") % 9 == 0, " \n ").when(C("id") % 9 == 1, None).otherwise(text).alias("text"))
    ending = F.when(C("page_id") % 4 == 0, ".JPG").when(C("page_id") % 4 == 1, ".png").when(C("page_id") % 4 == 2, ".txt").otherwise(".webp")
    images = A.table(s, d, "pages").select(key(C("page_id") % 50).alias("hash"), F.concat(C("page_id").cast("string"), ending).alias("filename"))
    return V.retrieved(contexts, images).select("id", "kind", "pos", F.md5("value").alias("digest"))


_RESEARCH = r"""
WITH c AS (
  SELECT source || '-' || id AS id, CASE WHEN id % 9 = 0 THEN ' ' WHEN id % 9 = 1 THEN '' ELSE title || chr(10) || ' ' || chr(10) || body || chr(10) || chr(10) || ' see ' || substr(md5((id % 60)::varchar), 1, 10) || ' and ' || substr(md5((id % 7)::varchar), 1, 10)
    || ', ' || substr(md5((id % 60)::varchar), 1, 10) || ' x' || substr(md5((id % 5)::varchar), 1, 10) END AS text FROM unified),
p AS (SELECT id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x, E' \n\t\r')), lambda x: x <> '') AS p FROM c),
i AS (SELECT substr(md5((page_id % 50)::varchar), 1, 10) AS hash, page_id || CASE page_id % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' ELSE '.webp' END AS filename FROM pages WHERE page_id % 4 <> 2),
n AS (SELECT DISTINCT id, unnest(regexp_extract_all(array_to_string(p, chr(10)), '\b[0-9a-f]{10}\b')) AS hash FROM p),
r AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY hash, filename) - 1 AS pos, hash || '/' || filename AS value FROM n JOIN i USING (hash))
SELECT id, 'chunk' AS kind, unnest(range(len(p)))::int AS pos, md5(unnest(p)) AS digest FROM p
UNION ALL SELECT id, 'skipped', 0, md5('') FROM p WHERE len(p) = 0 UNION ALL SELECT id, 'image', pos::int, md5(value) FROM r WHERE pos < 10"""


def update_runs(s: SparkSession, d: str) -> DataFrame:
    """The patches of C8 in runs of a year, on pages of which some are new, some gone and some changed."""
    there = C("o_orderstatus") != "P"
    base = F.when(C("o_custkey") % 5 > 0, F.when(C("o_custkey") % 5 > 1, F.sha2("o_orderpriority", 256)).otherwise(F.sha2(F.lit("old"), 256)))
    orders = A.table(s, d, "orders")
    patches = R.patches(s, d).join(orders.select("o_orderkey", F.year("o_orderdate").alias("run"), base.alias("base_digest")), "o_orderkey").withColumnRenamed("o_orderkey", "slug")
    pages = orders.where(there).select(C("o_orderkey").alias("slug"), C("o_orderpriority").alias("text"))
    return wiki.update_stats(wiki.update_outcomes(patches, pages), "run")


_RUNS = f"""
WITH k AS ({R._PATCHES.strip()}),
s AS (
  SELECT year(cast(o_orderdate AS date)) AS run, CASE class WHEN 'rejected' THEN 'rejected' WHEN 'suggestion_only' THEN 'suggestion' ELSE
    CASE WHEN o_custkey % 5 = 0 THEN o_orderstatus = 'P' ELSE o_custkey % 5 > 1 AND o_orderstatus <> 'P' END::varchar END AS st FROM k JOIN orders USING (o_orderkey))
SELECT run, count(*) AS suggestions_generated, count(*) FILTER (st = 'true') AS applied, count(*) FILTER (st <> 'true') AS dropped, count(*) FILTER (st = 'suggestion') AS suggestions_persisted,
  count(*) FILTER (st = 'false') AS conflicted, count(*) FILTER (st = 'rejected') AS rejected FROM s GROUP BY run"""

QUERIES = {
    "f55_cited_bodies": (cited_bodies, A.with_tables(_CITED.strip(), "unified")),
    "v13_research_retrieval": (research, A.with_tables(_RESEARCH.strip(), "unified")),
    "c15_update_runs": (update_runs, _RUNS.strip()),
}
