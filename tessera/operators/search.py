"""Full-text, vector and graph retrieval (section 2.12)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import collapse, cut, paragraphs
from tessera.operators.relational import first_rows
from tessera.storage import written

GRAM = 3
K1, B = 1.2, 0.75


def grams(text: Column) -> Column:
    """The distinct character trigrams of a folded text, in time of its length: its characters are parted once, not for each trigram."""
    def of(c: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(c) - GRAM), lambda i: F.concat(*[F.get(c, i + k) for k in range(GRAM)])))

    found = F.transform(F.array(F.split(F.lower(text), "")), lambda c: F.when(F.size(c) >= GRAM, of(c)))
    return F.coalesce(found[0], F.array().cast("array<string>"))


def gram_index(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """The index (key, gram); written bucketed or partitioned by gram it serves many queries."""
    return rows.select(key, F.explode(grams(text)).alias("gram"))


def index_candidates(index: DataFrame, key: str, phrase: str) -> DataFrame:
    """Rows that have every trigram of the phrase: all that can match it."""
    p = phrase.lower()
    wanted = sorted({p[i : i + GRAM] for i in range(len(p) - GRAM + 1)})
    hit = index.where(F.col("gram").isin(wanted)).groupBy(key).agg(F.count_distinct("gram").alias("n"))
    return hit.where(F.col("n") == len(wanted)).select(key)


def phrase_search(articles: DataFrame, phrase: str, limit: int | None = None, lang: str | None = None, quality: Column | None = None) -> DataFrame:
    """V1: case-folded phrase match in title or body, by BM25; under three characters nothing matches.

    The phrase is one term; its length statistics come from all rows that the
    index would hold, in the same pass.
    """
    p = phrase.strip().lower()
    if len(p) < GRAM:
        return articles.limit(0).select("hash", "title", F.lit(0.0).alias("score"), F.lit("").alias("snippet"))
    text = F.lower(F.concat_ws("\n", "title", "body"))
    counted = articles if quality is None else articles.where(quality)
    counted = counted if lang is None else counted.where(F.col("lang") == lang)
    tf = (F.length(text) - F.length(F.replace(text, F.lit(p), F.lit("")))) / len(p)
    base = counted.select("hash", "title", "body", tf.alias("tf"), F.length(text).alias("len"))
    stats = base.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), F.count_if(F.col("tf") > 0).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    hits = base.where("tf > 0").join(F.broadcast(stats)).select("hash", "title", F.round(score, 6).alias("score"), cut(collapse(F.substring("body", 1, 2000)), 200).alias("snippet"))
    return hits if limit is None else hits.orderBy(F.desc("score"), "hash").limit(limit)


def keyword_union(articles: DataFrame, keywords: list[str], limit: int) -> DataFrame:
    """Hits of each keyword by rank, in keyword order, each hash once."""
    parts = None
    for k, word in enumerate(keywords):
        hits = phrase_search(articles, word, limit)
        ranked_ = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "hash"))).select(F.lit(k).alias("keyword"), "rank", "hash")
        parts = ranked_ if parts is None else parts.union(ranked_)
    first = parts.groupBy("hash").agg(F.min(F.struct("keyword", "rank")).alias("at"))
    return first.orderBy("at", "hash").limit(limit).select("hash")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))


def normalized(v: Column) -> Column:
    """M5: unit length; a zero vector stays."""
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x / F.when(n == 0, 1.0).otherwise(n)))[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def nearest(vectors: DataFrame, query: list[float], key: str, vector: str, k: int) -> DataFrame:
    """The k rows nearest to a vector by cosine; a top-k, so only k rows of each task move."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, F.round(cosine(F.col(vector), q), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def valid_vector(v: Column, size: int) -> Column:
    """Y5."""
    return F.coalesce((F.size(v) == size) & F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def graph_context(mode: str, chunks: DataFrame, entities: DataFrame, relations: DataFrame, query: list[float], k: int = 20) -> DataFrame:
    """V4: (kind, id, score) of a retrieval mode.

    naive: nearest chunks; local: nearest entities and their edges; global:
    nearest relations and their ends; hybrid: local and global; mix: hybrid and
    naive. Inputs have id and vector; relations also src_id and tgt_id.
    """
    modes = {"naive": {"naive"}, "local": {"local"}, "global": {"global"}, "hybrid": {"local", "global"}, "mix": {"local", "global", "naive"}}
    if mode not in modes:
        raise ValueError(f"unknown mode: {mode}")
    parts = []
    if "naive" in modes[mode]:
        parts.append(nearest(chunks, query, "id", "vector", k).select(F.lit("chunk").alias("kind"), "id", "score"))
    if "local" in modes[mode]:
        near = nearest(entities, query, "id", "vector", k)
        edges = relations.join(F.broadcast(near), (F.col("src_id") == near["id"]) | (F.col("tgt_id") == near["id"])).select(F.lit("relation").alias("kind"), relations["id"], "score")
        parts += [near.select(F.lit("entity").alias("kind"), "id", "score"), edges]
    if "global" in modes[mode]:
        near = nearest(relations, query, "id", "vector", k)
        ends = relations.join(F.broadcast(near), "id").select("score", F.explode(F.array("src_id", "tgt_id")).alias("id")).select(F.lit("entity").alias("kind"), "id", "score")
        parts += [near.select(F.lit("relation").alias("kind"), "id", "score"), ends]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("kind", "id").agg(F.max("score").alias("score"))


def cached(wanted: DataFrame, cache: DataFrame, embed) -> DataFrame:
    """Vectors of (pos, key, text) in order: cached ones, and ``embed`` (an injected column function) for each missing key once."""
    missing = wanted.join(cache, "key", "left_anti").groupBy("key").agg(F.min("text").alias("text"))
    known = cache.select("key", "vector").unionByName(missing.select("key", embed(F.col("text")).alias("vector")))
    return wanted.join(known, "key").select("pos", "key", "vector").orderBy("pos")


#: Parts of one cut, and rows below which a part is ordered as a whole.
CUTS, LEAST_PART = 1000, 10_000


def evicted(cache: DataFrame, budget: int) -> DataFrame:
    """The rows of a cache (key, last_used, size, ...) that stay: from the most recently used on, as long as their sizes are
    within ``budget`` together; equal times are ordered by a hash of the key, then the key.

    The cut is found by weights, not by ordering the cache: sizes are summed over parts of about equal rows (by time, then by hash),
    and only the part that the budget ends in is looked at again, until it is small. What is collected is one row a part.
    """
    age = F.coalesce(-F.unix_micros(F.col("last_used").cast("timestamp")), F.lit((1 << 63) - 1))
    place = F.struct(age.alias("age"), F.xxhash64("key").alias("hash"), F.col("key").cast("string").alias("name"))
    part = written(cache.select(place.alias("place"), F.coalesce("size", F.lit(0)).cast("long").alias("size")), "cache")
    left, kept = budget, []
    for by in (F.col("place.age"), F.col("place.hash")):
        whole, part, left = _cut(part, by.cast("decimal(38,0)"), left)
        kept += whole
    upto = F.sum("size").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    kept.append(part.withColumn("_upto", upto).where(F.col("_upto") <= left))
    stays = reduce(DataFrame.unionAll, [k.select("place") for k in kept])
    return cache.withColumn("_place", place).join(stays.toDF("_place"), "_place", "left_semi").drop("_place")


def _cut(part: DataFrame, value: Column, left: int) -> tuple[list[DataFrame], DataFrame, int]:
    """(parts below the cut, the part that the budget ends in, what is left for it), by sums over ``CUTS`` ranges of a value at a time."""
    kept = []
    while True:
        n, low, high = part.agg(F.count("*"), F.min(value), F.max(value)).first()
        if n <= LEAST_PART or low == high:
            return kept, part, left
        width = (high - low) // CUTS + 1
        sums = part.groupBy(F.floor((value - F.lit(low)) / F.lit(width)).cast("int").alias("range")).agg(F.sum("size").alias("size")).orderBy("range").collect()
        edge = None
        for r in sums:
            if r["size"] > left:
                edge = low + r["range"] * width
                break
            left -= r["size"]
        if edge is None:
            return [*kept, part], part.where(F.lit(False)), left
        kept.append(part.where(value < F.lit(edge)))
        part = part.where((value >= F.lit(edge)) & (value < F.lit(edge + width)))


def decoded_matrix(packed: bytes, dim: int) -> int:
    """The number of float32 rows that a packed matrix holds."""
    rows, rest = divmod(len(packed), 4 * dim)
    if rest or not math.isfinite(rows):
        raise ValueError("matrix does not divide into rows")
    return rows


#: How a text names an article's folder of images, and the images' endings.
ARTICLE_HASH = r"(?<![\p{L}\p{N}_])[0-9a-f]{10}(?![\p{L}\p{N}_])"
IMAGE_ENDING = r"(?i)\.(jpg|jpeg|png|webp)$"


def retrieved(contexts: DataFrame, images: DataFrame, most: int = 10) -> DataFrame:
    """(id, kind, pos, value) of what each context (id, text) gives to a research run.

    Its paragraphs are ``chunk`` rows; of the images (hash, filename) of all articles that it names, the first ``most`` by hash and file
    name are ``image`` rows. A null or blank context is one ``skipped`` row. Positions start at 0; a hash named twice counts once.
    """
    read = contexts.select("id", paragraphs(F.col("text")).alias("p"))
    chunks = read.where(F.size("p") > 0).select("id", F.lit("chunk").alias("kind"), F.posexplode("p").alias("pos", "value"))
    skipped = read.where(F.size("p") == 0).select("id", F.lit("skipped").alias("kind"), F.lit(0).alias("pos"), F.lit("").alias("value"))
    hashes = F.array_distinct(F.flatten(F.transform("p", lambda x: F.regexp_extract_all(x, F.lit(ARTICLE_HASH), F.lit(0)))))
    # images after the first ones of their hash are never among the first ones of a context
    shown = first_rows(images.where(F.col("filename").rlike(IMAGE_ENDING)).select("hash", "filename"), ["hash"], F.col("filename"), n=most)
    named = read.select("id", F.explode(hashes).alias("hash")).join(shown, "hash")
    place = F.row_number().over(Window.partitionBy("id").orderBy("hash", "filename"))
    first = named.withColumn("pos", place - 1).where(F.col("pos") < most)
    return chunks.unionByName(skipped).unionByName(first.select("id", F.lit("image").alias("kind"), "pos", F.concat_ws("/", "hash", "filename").alias("value")))
