"""Queries of stored formats and caches: the paged vector store, XML sources, eviction, contradictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.operators import search as V
from tessera.sources import analogs as A
from tessera.sources import readers
from tessera.sources import vector_store as S
from tessera.storage import new_folder

C = F.col
DIM = 64


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "embeddings")
    return e.select(C("vec_id").cast("string").alias("id"), F.to_json(F.struct("label")).alias("payload"), C("embedding").alias("vector"))


def stored(spark: SparkSession, sf_dir: str) -> str:
    """The path of a store of all embeddings."""
    path = new_folder(spark, "vector-store")
    S.write_store(vectors(spark, sf_dir), path, DIM, rows=64)
    return path


def store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.read_store(spark, stored(spark, sf_dir), DIM, pages=2)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.select("id", F.get_json_object("payload", "$.label").cast("int").alias("label"), F.size("vector").alias("n"), F.round(total, 5).alias("total"), C("vector")[0].cast("double").alias("first"), C("vector")[DIM - 1].cast("double").alias("last"))


def matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores as rows of packed matrices, one a label, unpacked again; packing is by JVM functions: IEEE bits of each value, least byte first."""
    v = A.table(spark, sf_dir, "embeddings").select(C("vec_id").cast("string").alias("id"), "label", "embedding")
    packed = v.groupBy("label", F.pmod(F.xxhash64("id"), F.lit(8))).agg(F.sort_array(F.collect_list(F.struct("id", "embedding"))).alias("rows"))
    return readers.matrix_rows(packed.select(F.transform("rows", lambda r: r["id"]).alias("ids"), packed_floats(F.flatten(F.transform("rows", lambda r: r["embedding"]))).alias("matrix")), DIM)


def packed_floats(values: Column) -> Column:
    """Base64 of float32 values in little-endian order."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def pack(rows):
        import base64

        import numpy as np

        return rows.map(lambda v: base64.b64encode(np.asarray(v, np.float32).tobytes()).decode())

    return pack(values)


def xml_files(elements: DataFrame, before: str, after: str, path: str, size: int = 2000) -> None:
    """Write (element, broken) as files of about ``size`` elements inside the given tags; broken ones have files of their own."""
    parts = elements.count() // size + 1
    files = elements.groupBy("broken", F.pmod(F.xxhash64("element"), F.lit(parts))).agg(F.concat(F.lit(before), F.array_join(F.collect_list("element"), "\n"), F.when(C("broken"), "").otherwise(after)).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)


def graphml(spark: SparkSession, sf_dir: str) -> str:
    """Suppliers and parts as GraphML files; the nodes of every hundredth supplier are in files that break off."""
    path = new_folder(spark, "graphml")
    r = A.relations(spark, sf_dir)
    label = A.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), C("s_suppkey").cast("string")).alias("id"), "s_name")
    ids = r.select(C("src_id").alias("id")).union(r.select("tgt_id")).distinct().join(label, "id", "left")
    broken = C("id").rlike("^s[0-9]*00$")
    node = F.concat(F.lit('<node id="'), "id", F.lit('">'), F.coalesce(F.concat(F.lit('<data key="label">'), "s_name", F.lit("</data>")), F.lit("")), F.when(broken, "<data").otherwise("</node>"))
    edge = F.concat(F.lit('<edge source="'), "src_id", F.lit('" target="'), "tgt_id", F.lit('"><data key="d">x &lt; y</data></edge>'))
    xml_files(ids.select(node.alias("element"), broken.alias("broken")), "<graphml><graph>", "</graph></graphml>", f"{path}/nodes")
    xml_files(r.select(edge.alias("element"), F.lit(False).alias("broken")), "<graphml><graph>", "</graph></graphml>", f"{path}/edges")
    return path


def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = graphml(spark, sf_dir)
    return readers.graph_counts(spark, f"{path}/*")


def graph_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.graph_entities(spark, f"{graphml(spark, sf_dir)}/nodes")


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as OPML: those of a segment are in a folder; some have no title, no address or another type."""
    path = new_folder(spark, "opml")
    c = A.table(spark, sf_dir, "customer")
    name = F.when(C("c_nationkey") % 3 == 0, F.concat(F.lit('title="" text="'), "c_name", F.lit('"'))).otherwise(F.concat(F.lit('text="t" title="'), "c_name", F.lit(' &amp; Co"')))
    kind = F.when(C("c_nationkey") % 5 == 0, "link").otherwise("rss")
    address = F.when(C("c_nationkey") % 7 == 0, " ").otherwise(F.concat(F.lit("https://feeds.example.com/"), C("c_custkey").cast("string")))
    one = F.concat(F.lit('<outline type="'), kind, F.lit('" '), name, F.lit(' xmlUrl="'), address, F.lit('"/>'))
    folded = F.when(C("c_nationkey") % 2 == 0, F.concat(F.lit('<outline text="folder"><outline text="inner">'), one, F.lit("</outline></outline>"))).otherwise(one)
    xml_files(c.select(folded.alias("element"), F.lit(False).alias("broken")), "<opml><body>", "</body></opml>", path)
    return readers.opml_feeds(spark, path).select("name", "xml_url")


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' cache entries that a tenth of all bytes can hold, most recently used first; many entries share a time."""
    entries = A.table(spark, sf_dir, "documents").select(C("doc_id").alias("key"), F.timestamp_seconds(F.lit(1_700_000_000) + C("n_chars") % 50).alias("last_used"), F.octet_length("text").alias("size"))
    budget = entries.agg(F.floor(F.sum("size") / 10)).first()[0] or 0
    out = V.evicted(entries, budget)
    least = F.min(F.unix_seconds("last_used"))
    return out.agg(least.alias("oldest"), (F.sum("size") <= budget).alias("fits")).join(out.where(F.unix_seconds("last_used") > out.agg(least).first()[0]).agg(F.count("*").alias("n_newer"), F.sum("size").alias("newer_size")))


def sentences(df: DataFrame, text: str) -> DataFrame:
    """(id, text) of each sentence with its words capitalised and a year that its length gives."""
    parts = df.select("id", F.posexplode(F.split(F.regexp_replace(text, r"[^\x00-\x7F]", " "), r"[.\n]+")).alias("k", "s")).where(F.length(F.trim("s")) > 0)
    capital = F.transform(F.split("s", " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))))
    return parts.select((C("id") * 10_000 + C("k")).alias("id"), F.concat(F.array_join(capital, " "), F.lit(" "), (F.length("s") % 3 + 1998).cast("string")).alias("text"))


def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = sentences(A.table(spark, sf_dir, "conversations").where("role = 'assistant'").select((C("conv_id") * 100 + C("turn")).alias("id"), "text"), "text")
    old = sentences(A.table(spark, sf_dir, "documents").where("lang = 'en'").select(C("doc_id").alias("id"), "text"), "text")
    return R.contradictions(new, old)


def _sentences(relation: str, key: str, where: str) -> str:
    return (
        f"SELECT id * 10000 + k - 1 AS id, len(s) % 3 + 1998 AS year, list_distinct(regexp_extract_all(array_to_string(list_transform(string_split(s, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '), '\\b[A-Z][A-Za-z0-9]+\\b')) AS words "
        f"FROM (SELECT id, generate_subscripts(p, 1) AS k, unnest(p) AS s FROM (SELECT {key} AS id, regexp_split_to_array(regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g'), '[.\\n]+') AS p FROM {relation} WHERE {where})) WHERE length(trim(s)) > 0"
    )


_ASSISTANT, _ENGLISH = "role = 'assistant'", "lang = 'en'"
_TOTAL = "round(list_sum(list_transform(embedding, lambda x: x::double)), 5)"
QUERIES = {
    "s18_vector_store": (store_rows, f"SELECT vec_id::varchar AS id, label, len(embedding) AS n, {_TOTAL} AS total, embedding[1]::double AS first, embedding[{DIM}]::double AS last FROM embeddings"),
    "y2_stored_ids": (lambda s, d: S.read_store(s, stored(s, d)).select("id").distinct(), "SELECT DISTINCT vec_id::varchar AS id FROM embeddings"),
    "y4_matrix_rows": (lambda s, d: matrices(s, d).select("id", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total")), f"SELECT vec_id::varchar AS id, {_TOTAL} AS total FROM embeddings"),
    "y7_round_trip": (lambda s, d: S.round_trip(vectors(s, d), S.read_store(s, stored(s, d))), "SELECT least(20, count(DISTINCT vec_id)) AS n, 1.0 AS least, 1.0 AS most FROM embeddings"),
    "y8_inventory": (lambda s, d: S.inventory(s, stored(s, d)), "SELECT len(embedding) AS dim, count(*) AS n FROM embeddings GROUP BY 1"),
    "s7_graph_counts": (
        graph_counts,
        A.with_tables("WITH i AS (SELECT src_id AS id FROM relations UNION SELECT tgt_id FROM relations) SELECT (SELECT count(*) FROM i WHERE NOT regexp_matches(id, '^s[0-9]*00$')) AS nodes, (SELECT count(*) FROM relations) AS edges", "relations"),
    ),
    "y15_graph_entities": (
        graph_entities,
        A.with_tables("WITH i AS (SELECT src_id AS id FROM relations UNION SELECT tgt_id FROM relations) SELECT DISTINCT coalesce(s_name, id) AS name FROM i LEFT JOIN supplier ON id = 's' || s_suppkey WHERE NOT regexp_matches(id, '^s[0-9]*00$') ORDER BY name LIMIT 150", "relations"),
    ),
    "s9_opml_feeds": (
        feeds,
        "SELECT c_name || CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE ' & Co' END AS name, 'https://feeds.example.com/' || c_custkey AS xml_url FROM customer WHERE c_nationkey % 5 <> 0 AND c_nationkey % 7 <> 0",
    ),
    "v12_eviction": (
        kept,
        """WITH e AS (SELECT doc_id, 1700000000 + n_chars % 50 AS moment, strlen(text) AS size FROM documents), b AS (SELECT floor(sum(size) / 10) AS budget FROM e),
        t AS (SELECT moment, sum(size) AS size, count(*) AS n FROM e GROUP BY moment), u AS (SELECT *, sum(size) OVER (ORDER BY moment DESC) AS upto FROM t),
        w AS (SELECT max(moment) AS edge FROM u, b WHERE upto > budget)
        SELECT edge AS oldest, true AS fits, (SELECT sum(n) FROM t WHERE moment > edge)::bigint AS n_newer, (SELECT sum(size) FROM t WHERE moment > edge)::bigint AS newer_size FROM w""",
    ),
    "j25_document_contradictions": (
        contradictions,
        f"WITH n AS ({_sentences('conversations', 'conv_id * 100 + turn', _ASSISTANT)}), o AS ({_sentences('documents', 'doc_id', _ENGLISH)}), "
        "nw AS (SELECT id, year, unnest(words) AS w FROM n), ow AS (SELECT id, year, unnest(words) AS w FROM o) "
        "SELECT new_id, min(old_id) AS old_id FROM (SELECT nw.id AS new_id, ow.id AS old_id FROM nw JOIN ow ON nw.w = ow.w AND nw.year <> ow.year GROUP BY nw.id, ow.id HAVING count(*) >= 2) GROUP BY new_id",
    ),
}
