"""Question answering around injected models (sections 2.12 V2-V14, 2.14 hooks, 2.16 Y18-Y26).

What retrieves is a plan; what writes is a callable that the caller injects.
Loops over a handful of turns or stages run on the driver, as they wait for one
answer after another; their data are DataFrames.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import relational

SOURCE_HASH = r"/?articles?/([a-f0-9]{10})"


@dataclass(frozen=True)
class Hooks:
    """H1-H4: what an installation plugs in; all optional."""

    write: Callable[[str], str] | None = None
    embed: Callable[[list[str]], list[list[float]]] | None = None
    rerank: Callable[[str, list[str]], list[float]] | None = None
    search_web: Callable[[str], list[dict]] | None = None


def embedding_column(embed: Callable[[list[str]], list[list[float]]], size: int) -> Callable[[Column], Column]:
    """H2: an injected embedding as a column function; a vector of another size is an error."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        out = embed(texts.fillna("").tolist())
        if any(len(v) != size for v in out):
            raise ValueError(f"expected vectors of {size}")
        return pd.Series([list(map(float, v)) for v in out])

    return run


def source_hashes(markdown: Column) -> Column:
    """Hashes that an answer cites, in first-seen order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(markdown, F.lit("")), F.lit(SOURCE_HASH), 1))


def resolved_sources(answers: DataFrame, articles: DataFrame) -> DataFrame:
    """V8, V3: the articles that answers (id, markdown) cite, in their order."""
    wanted = answers.select("id", F.posexplode(source_hashes(F.col("markdown"))).alias("pos", "hash"))
    rank = F.when(F.col("source") == "wechat", 0).otherwise(1)
    one = relational.first_rows(articles, ["hash"], rank, articles["id"]).select("hash", "source", F.col("id").alias("article_id"), "title")
    return wanted.join(one, "hash").select("id", "pos", "hash", "source", "article_id", "title")


def entities_for_answers(sources: DataFrame, mentions: DataFrame, most: int = 8) -> DataFrame:
    """V9: the entities that most of each answer's articles mention."""
    counts = sources.select("id", "article_id").distinct().join(mentions, "article_id").groupBy("id", "entity_name").agg(F.count_distinct("article_id").alias("freq"))
    return relational.first_rows(counts, ["id"], F.desc("freq"), F.col("entity_name"), n=most)


def answered(question: str, context: str, history: list[str], hooks: Hooks, attempts: int = 3, pause: float = 0.0) -> tuple[str, int]:
    """V5: a written answer and the attempts it took; an empty one counts as failed."""
    prompt = "\n\n".join(x for x in (context, *history, question) if x)
    for k in range(1, attempts + 1):
        try:
            text = hooks.write(prompt) if hooks.write else ""
        except Exception:  # noqa: BLE001  a model may fail in any way
            text = ""
        if text and text.strip():
            return text, k
        time.sleep(pause)
    return "", attempts


def with_fallback(first: Callable, second: Callable) -> Callable:
    """The second search once, if the first one fails."""

    def run(query):
        try:
            return first(query)
        except Exception:  # noqa: BLE001
            return second(query)

    return run


@dataclass
class Research:
    """Stages in order, each a callable of the state so far; a failed one is noted and the rest go on."""

    stages: list[tuple[str, Callable[[dict], object]]]
    state: dict = field(default_factory=dict)
    events: list[tuple[int, str, str]] = field(default_factory=list)

    def run(self) -> dict:
        for k, (name, stage) in enumerate(self.stages):
            try:
                self.state[name] = stage(self.state)
                self.events.append((k, name, "ok"))
            except Exception as e:  # noqa: BLE001
                self.events.append((k, name, f"failed: {type(e).__name__}"))
        return self.state


def turns(decide: Callable[[list], dict], tools: dict[str, Callable], most: int) -> tuple[str | None, list]:
    """Ask for decisions until one is final or ``most`` turns are over; tools of a turn answer together."""
    seen: list = []
    for _ in range(most):
        decision = decide(seen)
        wanted = decision.get("tools") or []
        if decision.get("final") or not wanted:
            return decision.get("text"), seen
        seen += [(t["name"], tools[t["name"]](t.get("input")) if t["name"] in tools else None) for t in wanted]
    return None, seen


def assembled_sources(stages: DataFrame, most_images: int = 5) -> DataFrame:
    """Sources of ok stages (stage, ok, kind, value, pos), so many images, and a note for each other stage."""
    ok = stages.where("ok")
    images = ok.where("kind = 'image'").orderBy("stage", "pos").limit(most_images)
    notes = stages.where("not ok").select("stage").distinct().select("stage", F.lit("note").alias("kind"), F.concat("stage", F.lit(" gave nothing")).alias("value"))
    return ok.where("kind != 'image'").select("stage", "kind", "value").union(images.select("stage", "kind", "value")).union(notes)


def skill_failures(cases: DataFrame) -> DataFrame:
    """What answers (name, answer, contains, not_contains) lack or should not have, without regard to case."""
    low = F.lower("answer")
    return cases.select(
        "name", F.filter("contains", lambda x: ~low.contains(F.lower(x))).alias("missing"), F.filter("not_contains", lambda x: low.contains(F.lower(x))).alias("forbidden"),
    ).withColumn("passed", (F.size("missing") == 0) & (F.size("forbidden") == 0))


def rendered_pages(articles: DataFrame, base: str = "") -> DataFrame:
    """A page per article: (path, html). Rows that cannot be rendered give an error page's text, not a failed job."""
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("body", "&", "&amp;"), "<", "&lt;"), r"\n{2,}", "</p><p>")
    html = F.concat(F.lit("<article><h1>"), F.coalesce("title", F.lit("")), F.lit("</h1><p>"), F.coalesce(body, F.lit("")), F.lit("</p></article>"))
    return articles.select(F.concat(F.lit(f"{base}articles/"), "hash", F.lit(".html")).alias("path"), html.alias("html"))
