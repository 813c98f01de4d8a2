"""Sinks as merges: each returns the table's next state (section 2.2).

Spark's writers commit a job as a whole, so a returned state is written in one
step (K21). Keys are matched by joins, never row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.relational import first_rows


def new_rows(existing: DataFrame, incoming: DataFrame, key: str, *order: Column) -> DataFrame:
    """Incoming rows whose key is new, the first of each; rows with a null key are left out."""
    one = first_rows(incoming.where(F.col(key).isNotNull()), [key], *order)
    return one.join(existing.select(key), key, "left_anti")


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, key: str, *order: Column) -> DataFrame:
    return existing.unionByName(new_rows(existing, incoming, key, *order), allowMissingColumns=True)


def merged_accounts(existing: DataFrame, ids: DataFrame, registry: DataFrame) -> DataFrame:
    """K4: accounts with those of an id map (name, fakeid) whose name is new; what the registry (name, wechat_id, tags, source) says of them is added, if anything."""
    known = first_rows(registry, ["name"], F.col("wechat_id"))
    tags = F.when(F.size("tags") > 0, F.to_json("tags"))
    incoming = ids.join(known, "name", "left").select("name", "wechat_id", "fakeid", tags.alias("tags"), "source")
    return insert_or_ignore(existing, incoming, "name", F.col("fakeid"))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], fill: bool = False) -> DataFrame:
    """K5, K6: incoming values win; with ``fill`` only where they are not null. ``incoming`` has each key once."""
    values = [c for c in existing.columns if c not in keys]
    new = incoming.withColumn("_new", F.lit(True)).alias("n")
    joined = existing.alias("o").join(new, keys, "full_outer")
    chosen = [F.coalesce(f"n.{c}", f"o.{c}").alias(c) if fill else F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in values]
    return joined.select(*keys, *chosen)


def promoted(layer1: Column, passed: Column) -> Column:
    """K6: null or rejected becomes a candidate when passed; nothing is demoted."""
    return F.when(passed & (layer1.isNull() | (layer1 == "reject")), "candidate").otherwise(layer1)


def last_write(states: DataFrame, keys: list[str], *newest: Column) -> DataFrame:
    """The newest state of each key."""
    return first_rows(states, keys, *newest)


def verdict_update(articles: DataFrame, verdicts: DataFrame, column: str, keys: tuple[str, ...] = ("source", "id")) -> DataFrame:
    """K8, K9: new verdicts replace old ones; articles without one keep theirs."""
    new = verdicts.select(*keys, F.col(column).alias("_v"))
    return articles.join(new, list(keys), "left").withColumn(column, F.coalesce("_v", column)).drop("_v")


def guarded_body(old: Column, new: Column, short: int = 500) -> Column:
    """A body is set only over none or a short one, and never to a blank."""
    blank = F.trim(F.coalesce(new, F.lit(""))) == ""
    return F.when(~blank & (old.isNull() | (F.length(old) < short)), new).otherwise(old)


def error_book(failures: DataFrame) -> DataFrame:
    """One row per fingerprint with first and last time and count."""
    return failures.groupBy("fingerprint").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count("*").alias("seen_count"))


def resolved(status: Column, fingerprint: Column, *fingerprints: str) -> Column:
    """K15."""
    return F.when(fingerprint.isin(*fingerprints), "resolved").otherwise(status)


def persisted_entities(buffer: DataFrame, articles: DataFrame) -> DataFrame:
    """Trimmed names with their article by URL; repeats stay (Q7)."""
    named = buffer.select("url", F.trim("name").alias("entity_name")).where("entity_name != ''")
    return named.join(articles.select("url", F.col("id").alias("article_id")), "url").select("article_id", "entity_name")


def filled_language(lang: Column, detected: Column) -> Column:
    """K17."""
    return F.coalesce(lang, detected)


def counted_images(articles: DataFrame, files: DataFrame) -> DataFrame:
    """The number of files of each article's reference."""
    counts = files.groupBy("ref").agg(F.count("*").alias("image_count"))
    return articles.join(counts, "ref", "left").withColumn("image_count", F.coalesce("image_count", F.lit(0)))


def sitemap(urls: DataFrame, base: str) -> DataFrame:
    """An entry per page."""
    return urls.select(F.concat(F.lit(f"<url><loc>{base}/"), F.col("path"), F.lit("</loc><lastmod>"), F.col("lastmod"), F.lit("</lastmod></url>")).alias("entry"))


def purge(statuses: DataFrame, documents: DataFrame, keep: str = "processed") -> tuple[DataFrame, DataFrame]:
    """The documents that stay, and how many go by status."""
    good = statuses.where(F.col("status") == keep)
    gone = statuses.where((F.col("status") != keep) | F.col("status").isNull()).groupBy("status").agg(F.count("*").alias("n"))
    return documents.join(good.select("doc"), "doc", "left_semi"), gone


def missing_ids(old: DataFrame, new: DataFrame, key: str = "id", vector: str = "vector") -> DataFrame:
    """Rows to copy: in ``old`` only, with a vector."""
    return old.where(F.col(vector).isNotNull()).join(new.select(key), key, "left_anti")


def add_missing(df: DataFrame, **columns: str) -> DataFrame:
    """Columns that are not there yet, as nulls of their type; a second run changes nothing."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def ingestion_state(layer1: Column, url: Column, stage: Column, body: Column, probe_unrelated: Column, layer2: Column, confirmed: Column) -> Column:
    """Section 2.15: the state written for a candidate, null for none; the first rule that holds."""
    return (
        F.when(layer1 == "reject", "skipped").when(layer1.isNull(), None).when(F.coalesce(url, F.lit("")) == "", "skipped")
        .when(stage == "text_ingest", "skipped_ingested").when((stage == "scrape") & body.isNull(), "skipped").when(probe_unrelated, "skipped_graded")
        .when(layer2.isin("reject", "scrape_fail"), "skipped").when(layer2.isNull(), None).when(confirmed, "ok").otherwise("failed")
    )


def session_rows(df: DataFrame, key: str, at: str, gap_seconds: int) -> DataFrame:
    """Rows with the number of their session: a new one begins after a gap."""
    w = Window.partitionBy(key).orderBy(at)
    gap = F.col(at).cast("timestamp").cast("long") - F.lag(F.col(at).cast("timestamp").cast("long")).over(w)
    return df.withColumn("session", F.sum(F.when(gap > gap_seconds, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
