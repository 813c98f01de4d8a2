"""Aggregations and reports (section 2.5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import written


def entity_languages(mentions: DataFrame, articles: DataFrame, least: int = 5) -> DataFrame:
    """A4: mentions by language (repeats count, Q7) and distinct articles of each entity."""
    joined = mentions.join(articles.select(F.col("id").alias("article_id"), "lang"), "article_id")
    out = joined.groupBy("entity_name").agg(
        F.sum(F.when(F.col("lang") == "en", 1).otherwise(0)).alias("en"), F.sum(F.when(F.col("lang") == "de", 1).otherwise(0)).alias("de"),
        F.count_distinct("article_id").alias("total"),
    )
    return out.where(F.col("total") >= least)


def grouped_counts(df: DataFrame, *columns: str) -> DataFrame:
    """A5: counts by each column and over all, in one pass over grouping sets."""
    return df.groupingSets([[F.col(c)] for c in columns] + [[]], *[F.col(c) for c in columns]).agg(F.count("*").alias("n"))


def status_counts(states: DataFrame, *keys: str) -> DataFrame:
    """A6, A7."""
    return states.groupBy(*keys).agg(F.count("*").alias("n"))


def day_summary(states: DataFrame, day: Column) -> DataFrame:
    """States by day and source, and the time of the last ok."""
    return states.groupBy(day.alias("day"), "source").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.max(F.when(F.col("status") == "ok", F.col("ingested_at"))).alias("last_ok"),
    )


def joined_topics(classifications: DataFrame, separator: str = "|") -> DataFrame:
    """A10: the topics of each article in order (Q13)."""
    return classifications.groupBy("article_id").agg(F.array_join(F.array_sort(F.collect_set("topic")), separator).alias("topics"))


def language_coverage(articles: DataFrame) -> DataFrame:
    """A11, K17."""
    return articles.groupBy(F.coalesce("lang", F.lit("NULL")).alias("lang")).agg(F.count("*").alias("n"))


#: The upper ends of the time histogram's buckets.
BUCKETS = ((60.0, "0-60s"), (300.0, "60-300s"), (900.0, "300-900s"))


def time_bucket(seconds: Column) -> Column:
    """A12."""
    out = F
    for end, name in BUCKETS:
        out = out.when(seconds < end, name)
    return out.otherwise("900s+")


def batch_metrics(runs: DataFrame, group: str, seconds: str, ok: Column, failed: Column) -> DataFrame:
    """Counts, mean of the ok runs and their share; 0 where nothing counts."""
    n_ok, n_failed = F.count_if(ok), F.count_if(failed)
    return runs.groupBy(group).agg(
        F.count("*").alias("n"), n_ok.alias("ok"), n_failed.alias("failed"), F.coalesce(F.avg(F.when(ok, F.col(seconds))), F.lit(0.0)).alias("mean_ok"),
        F.coalesce(n_ok / F.nullif(n_ok + n_failed, F.lit(0)), F.lit(0.0)).alias("ok_share"),
    )


def centrality(relations: DataFrame, samples: int = 3) -> DataFrame:
    """Degree over all edges, distinct neighbours, their sum as the score, and the first sources.

    Each edge counts at both ends; a loop counts twice and is its own neighbour.
    """
    ends = relations.select("src_id", "tgt_id", "source_id").unionAll(relations.select(F.col("tgt_id"), F.col("src_id"), "source_id"))
    ends = ends.toDF("entity", "neighbour", "source_id")
    degree = ends.groupBy("entity").agg(F.count("*").alias("degree"), F.count_distinct("neighbour").alias("neighbours"))
    # only the first sources of an entity are gathered, not all of a hub's
    first = Window.partitionBy("entity").orderBy("source_id")
    sources = ends.where("source_id is not null").select("entity", "source_id").distinct().withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= samples)
    sources = sources.groupBy("entity").agg(F.array_sort(F.collect_list("source_id")).alias("sources"))
    out = degree.join(sources, "entity", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
    return out.withColumn("score", F.col("degree") + F.col("neighbours"))


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """1..N over all rows.

    Rows are ranged over partitions and numbered inside them in one job, whose
    result is written; a rank is the rows of the partitions before plus the place
    in the own one. Counts and rows come from that one table, so they agree, and
    no task orders everything; what is broadcast is one row a partition.
    """
    place = F.monotonically_increasing_id()
    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.shiftright(place, 33), "_place": place.bitwiseAND(F.lit((1 << 33) - 1))}), "ranged")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_before") + F.col("_place") + 1).cast("long")).drop("_part", "_place", "_before")


def document_frequency(mentions: DataFrame, slug: Column, least: int = 2) -> DataFrame:
    """Distinct articles of each slug."""
    return mentions.groupBy(slug.alias("slug")).agg(F.count_distinct("article_id").alias("documents")).where(F.col("documents") >= least)


def last_modified(articles: DataFrame, group: str) -> DataFrame:
    """A17."""
    return articles.groupBy(group).agg(F.coalesce(F.max(F.substring("update_time", 1, 10)), F.lit("1970-01-01")).alias("lastmod"))


def topic_cards(topics: DataFrame, classifications: DataFrame) -> DataFrame:
    """Articles of each known topic, none included."""
    counts = classifications.groupBy("topic").agg(F.count_distinct("article_id").alias("n"))
    return topics.join(counts, "topic", "left").select("topic", F.coalesce("n", F.lit(0)).alias("n"))


def reconcile_class(status: Column, doc_status: Column) -> Column:
    """Ok rows match a processed document or are mysteries; failed rows with one are ghosts."""
    processed = F.coalesce(F.lower(doc_status) == "processed", F.lit(False))
    return F.when((status == "ok") & processed, "matched").when(status == "ok", "mystery").when((status == "failed") & processed, "ghost").when(status == "failed", "expected_failure")


def patched(status: Column, version: Column, cls: Column) -> Column:
    """Ghosts become ok; mysteries failed, with the next version."""
    return F.struct(
        F.when(cls == "ghost", "ok").when(cls == "mystery", "failed").otherwise(status).alias("status"),
        F.when(cls == "mystery", F.coalesce(version, F.lit(0)) + 1).otherwise(version).alias("version"),
    )


def rollup_report(checks: DataFrame, group: str, passed: Column) -> DataFrame:
    """Passed, failed, whether all passed, and the rate."""
    return checks.groupBy(group).agg(F.count_if(passed).alias("passed"), F.count_if(~passed).alias("failed"), F.bool_and(passed).alias("all_passed"), F.round(F.count_if(passed) / F.count("*"), 4).alias("rate"))


def growth_ceiling(samples: DataFrame, day: Column, size: Column, ceiling: float, least: int = 4, most_days: int = 365) -> DataFrame:
    """Least-squares growth a day, and the days until the ceiling; null under ``least`` samples."""
    fit = samples.agg(F.count("*").alias("n"), F.regr_slope(size, day).alias("slope"), F.regr_intercept(size, day).alias("intercept"), F.max(day).alias("last"))
    days = (F.lit(ceiling) - F.col("intercept")) / F.col("slope") - F.col("last")
    return fit.withColumn("days", F.when((F.col("n") >= least) & (F.col("slope") > 0), F.least(F.greatest(days, F.lit(0.0)), F.lit(float(most_days)))))


def confidence(sources: Column, types: Column) -> Column:
    """A25."""
    return F.when((sources >= 2) & (types >= 2), "high").when(sources >= 2, "medium").otherwise("low")


def duplicates(df: DataFrame, key: str, of: str) -> DataFrame:
    """Keys with more than one distinct value."""
    return df.groupBy(key).agg(F.count_distinct(of).alias("n")).where("n > 1")


def feed_health(attempts: DataFrame) -> DataFrame:
    """Errors since the last success of each feed."""
    last_ok = attempts.where("ok").groupBy("feed").agg(F.max("at").alias("last_ok"))
    joined = attempts.join(last_ok, "feed", "left")
    return joined.groupBy("feed").agg(F.count_if(~F.col("ok") & (F.col("last_ok").isNull() | (F.col("at") > F.col("last_ok")))).alias("error_count"), F.max("last_ok").alias("last_ok"))
