"""Repeated-entity grouping with exact coverage.

Every eligible article ends in one terminal class. Phases are successive
anti-joins over one state: entity buffers, the graph for articles without a
usable buffer, groups of two or more articles that share an entity, and a
fallback answer for the articles that no group covers.

Entities are slugs, and an entity may be in a third of all articles: its articles
are never listed in one row, and no join is by entity alone. Entities of a single
article carry that article in their aggregate (its least key is its greatest), so
coverage is counted by article; joins by entity are salted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.functions.text import ascii_slug
from tessera.storage import new_folder, written

KEY = ["source", "ref"]
REPRESENTED, NO_ENTITY, RETRY = "represented", "no_wiki_entity", "retry_unresolved"
#: Parts that the articles of one entity are dealt to in joins by entity.
SALTS = 16


class AccountingError(ValueError):
    """The terminal classes do not add up to the eligible articles."""


def slug(name: Column) -> Column:
    return ascii_slug(F.trim(name), None)


def slugs(names: Column) -> Column:
    """Distinct slugs of a list of names, in order, empty ones left out."""
    return F.array_distinct(F.filter(F.transform(names, slug), lambda s: s != ""))


def _strings(items: Column, also_name: bool = False) -> Column:
    """The strings, and where asked for the objects' names, of a list of JSON values."""

    def text(v: Column) -> Column:
        plain = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
        name = F.try_variant_get(v, "$.name", "variant")
        return F.coalesce(plain, F.when(F.schema_of_variant(name) == "STRING", F.try_variant_get(name, "$", "string"))) if also_name else plain

    return F.filter(F.transform(items, text), lambda s: s.isNotNull() & (F.trim(s) != ""))


def fallback_slugs(answer: Column, most: int = 3) -> Column:
    """Slugs of ``{"entities": [...]}``; null if it is anything else or names more than ``most``."""
    names = _strings(F.from_json(answer, "entities array<variant>")["entities"])
    return F.when(F.size(names) <= most, slugs(names))


def buffered(buffers: DataFrame) -> DataFrame:
    """Source, ref and entities (slugs) by the first readable buffer; ``buffers`` has source, ref, place (of its folder) and document (JSON).

    A readable document is an object with a list ``raw_entities``, of names or of objects with a name.
    """
    names = F.from_json("document", "raw_entities array<variant>")["raw_entities"]
    readable = buffers.select(*KEY, "place", names.alias("names")).where("names IS NOT NULL")
    first = readable.groupBy(*KEY).agg(F.min_by(F.struct("names"), "place").alias("first"))
    return first.select(*KEY, slugs(_strings(F.col("first.names"), True)).alias("entities"))


def chunk_names(source_id: Column) -> Column:
    return F.filter(F.split(source_id, r"[<>|\s]+"), lambda c: c.startswith("chunk-"))


def graph_pairs(entities: DataFrame, relations: DataFrame, chunks: DataFrame) -> DataFrame:
    """(entity, source, ref) of the graph; ``entities`` has pos, entity_name, source_id, ``relations`` pos, src_id, tgt_id, source_id, ``chunks`` chunk, source, ref.

    A relation counts for both ends. Of names with one slug, the first that leads to an article stands for it; names are ordered by entity rows, then relations.
    """
    named = entities.select(F.struct(F.lit(0).alias("kind"), "pos", F.lit(0).alias("side")).alias("at"), F.col("entity_name").alias("name"), "source_id")
    ends = relations.select("pos", F.posexplode(F.array("src_id", "tgt_id")).alias("side", "name"), "source_id").select(F.struct(F.lit(1).alias("kind"), "pos", "side").alias("at"), "name", "source_id")
    rows = named.unionAll(ends).select("at", F.trim("name").alias("name"), F.explode(chunk_names(F.col("source_id"))).alias("chunk")).where("name <> ''")
    # the place of a name is that of its first row with any chunk, found or not
    places = rows.groupBy("name").agg(F.min("at").alias("at"))
    found = written(rows.select("name", "chunk").distinct().join(chunks, "chunk").select("name", *KEY).distinct(), "graph_pairs")
    leading = found.select("name").distinct().join(places, "name").withColumn("entity", slug(F.col("name"))).where("entity <> ''")
    winners = leading.groupBy("entity").agg(F.min_by("name", "at").alias("name"))
    salted = winners.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return found.withColumn("_salt", F.pmod(F.xxhash64(*KEY), F.lit(SALTS)).cast("int")).join(salted, ["name", "_salt"]).select("entity", *KEY)


def discovered(eligible: DataFrame, buffers: DataFrame, graph: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles, jobs) of the eligible articles (source, ref).

    articles: source, ref, mapped ('buffer', 'graph' or null) and class. jobs: entity, source, ref, one row an article of a job.
    ``buffers`` is from ``buffered``, ``graph`` from ``graph_pairs``, ``answers`` has source, ref and answer (null: no answer).
    Raises ``AccountingError`` unless every eligible article has one class, as observed while the articles are written.
    """
    spark = eligible.sparkSession
    keys = written(eligible.select(KEY).distinct(), "eligible")
    own = keys.join(buffers, KEY).where(F.size("entities") > 0)
    by_buffer = own.select(F.explode("entities").alias("entity"), *KEY)
    by_graph = graph.join(keys, KEY, "left_semi").join(own.select(KEY), KEY, "left_anti")
    pairs = written(by_buffer.withColumn("mapped", F.lit("buffer")).unionByName(by_graph.distinct().withColumn("mapped", F.lit("graph"))), "pairs")

    # an entity of one article is known by its aggregate; all others are groups
    alone = pairs.groupBy("entity").agg(F.min(F.struct(*KEY)).alias("least"), F.max(F.struct(*KEY)).alias("most")).where("least = most").select("entity", "least.*")
    counted = pairs.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("mapped").alias("mapped"))
    single = alone.groupBy(*KEY).agg(F.count("*").alias("n_alone"))
    state = keys.join(counted, KEY, "left").join(single, KEY, "left").withColumn("covered", F.coalesce(F.col("n") > F.coalesce("n_alone", F.lit(0)), F.lit(False)))

    answered = answers.select(*KEY, fallback_slugs(F.col("answer")).alias("entities"))
    asked = state.join(answered, KEY, "left").withColumn(
        "class", F.when(F.col("covered") | (F.size("entities") > 0), REPRESENTED).when(F.size("entities") == 0, NO_ENTITY).otherwise(RETRY))
    seen, total = Observation(), Observation()
    counts = [F.count_if(F.col("class") == c).alias(c) for c in (REPRESENTED, NO_ENTITY, RETRY)]
    path = new_folder(spark, "coverage")
    asked.select(*KEY, "mapped", "covered", "class", F.when(~F.col("covered"), F.col("entities")).alias("entities")).observe(seen, F.count("*").alias("rows"), *counts).write.parquet(path)
    keys.observe(total, F.count("*").alias("rows")).write.format("noop").mode("overwrite").save()
    check_accounting(total.get["rows"], seen.get)
    articles = spark.read.parquet(path)
    jobs = pairs.drop("mapped").join(alone, ["entity", *KEY], "left_anti").unionByName(articles.select(F.explode("entities").alias("entity"), *KEY))
    return articles.select(*KEY, "mapped", "class"), jobs.distinct()


def check_accounting(eligible: int, seen: dict[str, int]) -> None:
    classes = {c: seen[c] for c in (REPRESENTED, NO_ENTITY, RETRY)}
    if not eligible == seen["rows"] == sum(classes.values()):
        raise AccountingError(f"{eligible} eligible articles, {seen['rows']} classified: {classes}")


def summary(articles: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row a measure: name and n."""
    n = articles.agg(
        F.count("*").alias("eligible"), F.count_if(F.col("mapped") == "buffer").alias("mapped_by_buffer"), F.count_if(F.col("mapped") == "graph").alias("mapped_by_graph"),
        *[F.count_if(F.col("class") == c).alias(c) for c in (REPRESENTED, NO_ENTITY, RETRY)])
    each = n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in n.columns])).alias("x")).select("x.*")
    return reduce(DataFrame.unionAll, [each, jobs.agg(F.count_distinct("entity").alias("n")).select(F.lit("jobs").alias("name"), "n")])
