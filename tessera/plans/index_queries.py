"""Queries of the written trigram index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.text_index import TextIndex
from tessera.sources import analogs as A
from tessera.storage import new_folder

_built: dict[tuple[str, str], TextIndex] = {}


def text() -> Column:
    """What the search looks at."""
    return F.concat_ws("\n", "title", "body")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.unified(spark, sf_dir).select(F.concat_ws("_", "source", "id").alias("key"), "hash", "title", "body", "lang", "layer2_verdict")


def index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The index of a folder's articles; an application builds it once and all its searches read it."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _built:
        built = TextIndex(spark, new_folder(spark, "text-index"))
        built.refresh(rows(spark, sf_dir), text())
        _built[at] = built
    return _built[at]


def refreshed(spark: SparkSession, sf_dir: str) -> TextIndex:
    """An index built on an older state of the articles (French ones missing, German ones with the title only, Spanish ones twice) and brought up to date."""
    now = rows(spark, sf_dir)
    old = now.where(~F.coalesce(F.col("lang") == "fr", F.lit(False))).withColumn("body", F.when(F.col("lang") == "de", "").otherwise(F.col("body")))
    old = old.unionAll(now.where("lang = 'es'").withColumn("key", F.concat("key", F.lit("_copy"))))
    out = TextIndex(spark, new_folder(spark, "text-index"))
    out.refresh(old, text())
    out.refresh(now, text())
    return out


def keys(ix: TextIndex, phrase: str) -> DataFrame:
    return ix.hits(phrase, text()).select("key")


def _ranked(phrase: str) -> str:
    """DuckDB SQL of (hash, score) over ``unified`` as CTE ``r``."""
    return (
        f"b AS (SELECT hash, (length(t) - length(replace(t, '{phrase}', ''))) / {len(phrase)} AS tf, length(t) AS len FROM (SELECT hash, lower(title || chr(10) || body) AS t FROM unified)), "
        "s AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (tf > 0) AS df FROM b), "
        "r AS (SELECT hash, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)), 6) AS score FROM b, s WHERE tf > 0)"
    )


def _union(words: list[str], limit: int) -> str:
    """DuckDB SQL of the first hashes over the words' ranked hits."""
    parts = [f"SELECT * FROM (WITH {_ranked(w)} SELECT {k} AS keyword, row_number() OVER (ORDER BY score DESC, hash) AS rank, hash FROM r) WHERE rank <= {limit}" for k, w in enumerate(words)]
    return f"SELECT hash FROM (SELECT hash, min(keyword * 1000000 + rank) AS place FROM ({' UNION ALL '.join(parts)}) GROUP BY hash) ORDER BY place, hash LIMIT {limit}"


_CODE = "(unicode(substr(t, i, 1))::bigint << 42) | (unicode(substr(t, i + 1, 1))::bigint << 21) | unicode(substr(t, i + 2, 1))"
_WORDS = ["edtion", "thand", "nothing holds this"]

def endpoint(s: SparkSession, d: str) -> DataFrame:
    """V2: one request whose phrase is found and one that falls back to its keywords."""
    ix = index(s, d)
    found = ix.search_or_keywords("tion the", _WORDS, text(), 10).select(F.lit("phrase").alias("by"), "hash")
    return found.unionAll(ix.search_or_keywords("tion the xyz", _WORDS, text(), 10).select(F.lit("keywords"), "hash"))


QUERIES = {
    "v1_phrase_search": (
        lambda s, d: index(s, d).search("Tion of the", text(), keep=F.col("layer2_verdict").isNull() | (F.col("layer2_verdict") != "reject")).select("hash"),
        A.with_tables("SELECT hash FROM unified WHERE contains(lower(title || chr(10) || body), 'tion of the') AND (layer2_verdict IS NULL OR layer2_verdict <> 'reject')", "unified"),
    ),
    "v1_ranked_search": (
        lambda s, d: index(s, d).search("tion the", text(), 20).select("hash", "score"),
        A.with_tables(f"WITH {_ranked('tion the')} SELECT hash, score FROM r ORDER BY score DESC, hash LIMIT 20", "unified"),
    ),
    "v2_search_endpoint": (
        endpoint,
        A.with_tables(f"SELECT 'phrase' AS by, hash FROM (WITH {_ranked('tion the')} SELECT hash FROM r ORDER BY score DESC, hash LIMIT 10) UNION ALL SELECT 'keywords', hash FROM ({_union(_WORDS, 10)})", "unified"),
    ),
    "k12_index_hits": (
        lambda s, d: keys(index(s, d), "tion"),
        A.with_tables("SELECT source || '_' || id AS key FROM unified WHERE contains(lower(concat_ws(chr(10), title, body)), 'tion')", "unified"),
    ),
    "k12_refreshed_index": (
        lambda s, d: keys(refreshed(s, d), "en de"),
        A.with_tables("SELECT source || '_' || id AS key FROM unified WHERE contains(lower(concat_ws(chr(10), title, body)), 'en de')", "unified"),
    ),
    "k12_posting_counts": (
        lambda s, d: refreshed(s, d).posting_counts(),
        A.with_tables(f"SELECT gram, count(DISTINCT key) AS n FROM (SELECT key, {_CODE} AS gram FROM (SELECT source || '_' || id AS key, lower(title || chr(10) || body) AS t, unnest(range(1, length(title || chr(10) || body) - 1)) AS i FROM unified)) GROUP BY gram", "unified"),
    ),
    "v7_keyword_union": (lambda s, d: index(s, d).keyword_union(_WORDS, text(), 10), A.with_tables(_union(_WORDS, 10), "unified")),
}
