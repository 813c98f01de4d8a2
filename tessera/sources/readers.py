"""Readers of the engine's own file formats (section 2.1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOC_STATUS = T.MapType(T.StringType(), T.StructType([T.StructField("status", T.StringType()), T.StructField("error_msg", T.StringType()), T.StructField("chunks_list", T.ArrayType(T.StringType())), T.StructField("content_length", T.LongType()), T.StructField("updated_at", T.StringType())]))


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    """Fail when the plan is built if columns are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def key_values(texts: DataFrame, kind: T.MapType = DOC_STATUS, column: str = "value") -> DataFrame:
    """JSON objects, one text each, as rows (key, value)."""
    return texts.select(F.explode(F.from_json(column, kind)).alias("key", "value"))


def doc_status(spark: SparkSession, path: str) -> DataFrame:
    """The document states of whole-file JSON objects."""
    return key_values(spark.read.text(path, wholetext=True)).select(F.col("key").alias("doc"), "value.*")


def store_rows(texts: DataFrame, row: T.StructType, column: str = "value") -> DataFrame:
    """Rows of a vector store: an object with ``data``, or a bare list."""
    rows = T.ArrayType(row)
    wrapped = F.from_json(F.get_json_object(column, "$.data"), rows)
    return texts.select(F.explode(F.coalesce(wrapped, F.from_json(column, rows))).alias("r")).select("r.*")


def _text_fields(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def xml_rows(spark: SparkSession, path: str, tag: str, schema: T.StructType) -> DataFrame:
    """Elements of a tag of XML files as rows; attributes are columns with ``@``, and elements that do not parse are in ``broken``."""
    reader = spark.read.format("xml").schema(T.StructType([*schema.fields, T.StructField("broken", T.StringType())])).option("rowTag", tag).option("attributePrefix", "@").option("columnNameOfCorruptRecord", "broken").option("mode", "PERMISSIVE")
    return reader.load(path)


def graphml_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of GraphML files: id and label (data of the key ``label``)."""
    rows = xml_rows(spark, path, "node", _text_fields("@id").add("data", T.ArrayType(_text_fields("@key", "_VALUE")))).where("broken IS NULL AND `@id` IS NOT NULL")
    label = F.filter("data", lambda d: d["@key"] == "label")
    return rows.select(F.col("@id").alias("id"), F.get(label, F.lit(0))["_VALUE"].alias("label"))


def graphml_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges of GraphML files: source and target."""
    return xml_rows(spark, path, "edge", _text_fields("@source", "@target")).where("broken IS NULL AND `@source` IS NOT NULL").select(F.col("@source").alias("source"), F.col("@target").alias("target"))


def graph_counts(spark: SparkSession, path: str) -> DataFrame:
    """Nodes and edges of GraphML files."""
    counts = [graphml_nodes(spark, path).agg(F.count("*").alias("nodes")), graphml_edges(spark, path).agg(F.count("*").alias("edges"))]
    return counts[0].join(counts[1])


def graph_entities(spark: SparkSession, path: str, most: int = 150) -> DataFrame:
    """The first names of a graph's nodes in order, each once: the label, or else the id."""
    name = F.coalesce(F.nullif(F.trim("label"), F.lit("")), "id")
    return graphml_nodes(spark, path).select(name.alias("name")).distinct().orderBy("name").limit(most)


#: Levels of folders that outlines are looked for in.
OUTLINE_LEVELS = 4


def opml_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Feeds of OPML files: outlines of type rss with an address, also inside others; the name is the title, or else the text."""
    fields = ["@type", "@title", "@text", "@xmlUrl", "@htmlUrl"]
    kind = _text_fields(*fields)
    for _ in range(OUTLINE_LEVELS - 1):
        kind = _text_fields(*fields).add("outline", T.ArrayType(kind))
    level = xml_rows(spark, path, "outline", kind).where("broken IS NULL")
    rows = level.select(*fields)
    for _ in range(OUTLINE_LEVELS - 1):
        level = level.select(F.explode("outline").alias("o")).select("o.*")
        rows = rows.unionAll(level.select(*fields))
    named = rows.where("`@type` = 'rss' AND coalesce(trim(`@xmlUrl`), '') <> ''")
    return named.select(F.coalesce(F.nullif(F.col("@title"), F.lit("")), F.col("@text")).alias("name"), F.col("@xmlUrl").alias("xml_url"), F.col("@htmlUrl").alias("html_url"))


def newest_until(items: DataFrame, group: str, at: str, cutoff: Column, most: int) -> DataFrame:
    """Items in arrival order up to the first older one, at most ``most`` of each account."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy("pos")
    old = F.max((F.col(at) < cutoff).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumns({"_old": old, "_n": F.row_number().over(w)}).where((F.col("_old") == 0) & (F.col("_n") <= most)).drop("_old", "_n")


def first_directory(buffers: DataFrame, key: str, priority: str) -> DataFrame:
    """Of each key the file of the first directory."""
    from tessera.operators.relational import first_rows

    return first_rows(buffers, [key], F.col(priority))


#: The order of ingest stages.
STAGES = ("scrape", "classify", "image_download", "text_ingest", "vision_worker", "sub_doc_ingest")


def checkpoint_status(marks: DataFrame) -> DataFrame:
    """Of each article its last stage and whether it is complete."""
    order = F.array_position(F.array(*[F.lit(x) for x in STAGES]), F.col("stage"))
    return marks.groupBy("article_hash").agg(F.max_by("stage", order).alias("last_stage"), F.bool_or(F.col("stage") == STAGES[-1]).alias("complete"))


def route(url: Column) -> Column:
    """The kind of a page's address."""
    host = F.lower(F.regexp_extract(url, r"^https?://([^/?#]+)", 1))
    arxiv = host.rlike(r"(^|\.)arxiv\.org$")
    return F.when(host == "mp.weixin.qq.com", "wechat").when(arxiv & url.contains("/pdf/"), "arxiv_pdf").when(arxiv, "arxiv_abs").otherwise("generic")


def matrix_rows(packed: DataFrame, dim: int, column: str = "matrix", ids: str = "ids") -> DataFrame:
    """(id, vector) of base64 float32 matrices; the rows must be as many as the ids.

    A batch's matrices are decoded by JVM functions and read as one block of numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch["ids"].value_lengths().to_numpy(zero_copy_only=False)
            for k, data in enumerate(batch["data"]):
                values = np.frombuffer(data.as_buffer(), np.float32)
                if len(values) != dim * named[k]:
                    raise ValueError(f"matrix holds {len(values) / dim} rows for {named[k]} ids")
                vectors = pa.ListArray.from_arrays(np.arange(0, len(values) + 1, dim, dtype=np.int32), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch["ids"][k].values, vectors], ["id", "vector"])

    return packed.select(F.unbase64(column).alias("data"), F.col(ids).alias("ids")).mapInArrow(run, "id string, vector array<float>")
