"""Wiki pages as rows: parsing, rendering, linting, health and patches (sections 2.9 F42-F63, 2.11 C9-C16).

A page is a row (slug, text). Its frontmatter is the lines between two ``---``
lines at the start: scalars ``name: value`` and one list ``sources`` of maps.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import dates
from tessera.functions.text import let

# Citation and link forms.
FOOTNOTE, LEGACY, BACKLINK = r"\[\^(\d+)\](?!:)", r"\^\[article:([a-f0-9]{10})\]", r"\[\[([a-z0-9-]+)\]\]"
REQUIRED = ("title", "last_updated")
#: All Unicode white space, as Python's ``strip`` takes it.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

SOURCE = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "type", "ref", "title")])
HEAD = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("sources", T.ArrayType(SOURCE))])


def _unquoted(value: str) -> str:
    v = value.strip()
    return v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"" else v


def _head(text: str | None) -> tuple:
    """(parsed well, scalars, sources) of the lines of a frontmatter; null if there is none."""
    if text is None:
        return False, {}, []
    fields, sources, inside = {}, [], False
    for line in text.split("\n"):
        if not line.strip():
            continue
        if item := re.match(r"^\s*-\s+(\w+):\s*(.*)$", line) if inside else None:
            sources.append({item[1]: _unquoted(item[2])})
        elif (more := re.match(r"^\s+(\w+):\s*(.*)$", line)) and inside and sources:
            sources[-1][more[1]] = _unquoted(more[2])
        elif plain := re.match(r"^(\w+):\s*(.*)$", line):
            inside = plain[1] == "sources"
            if not inside:
                fields[plain[1]] = _unquoted(plain[2])
        else:
            return False, fields, []
    return True, fields, [tuple(s.get(n) for n in ("id", "type", "ref", "title")) for s in sources]


@F.pandas_udf(HEAD)
def parsed(heads: pd.Series) -> pd.DataFrame:
    """Of the frontmatter only, so that bodies are not sent to Python."""
    return pd.DataFrame([_head(t) for t in heads], columns=["ok", "fields", "sources"])


def parted(text: Column) -> Column:
    """(head, body) of a page; a page without frontmatter is all body."""
    t = F.coalesce(text, F.lit(""))
    end = F.locate("\n---", t, 5)
    rest = F.substring(t, end + 4, F.length(t))
    return F.when(t.startswith("---\n") & (end > 0), F.struct(F.substring(t, F.lit(5), end - 5).alias("head"), F.when(rest.startswith("\n"), F.substring(rest, F.lit(2), F.length(rest))).otherwise(rest).alias("body"))).otherwise(F.struct(F.lit(None).cast("string").alias("head"), t.alias("body")))


def with_section(text: Column | str, heading: Column, content: Column) -> Column:
    """replace the section under a second-level heading, or append it."""
    section = F.concat(F.lit("## "), heading, F.lit("\n\n"), F.trim(content, F.lit(BLANKS)), F.lit("\n"))
    quoted = F.concat(F.lit(r"\Q"), F.replace(heading, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pattern = F.concat(F.lit(r"(?dms)\A(.*?)(^## "), quoted, F.lit(r"[ \t]*\n.*?)(?=^## |\z)"))

    def put(t: Column, before: Column, old: Column) -> Column:
        tail = F.substring(t, F.length(before) + F.length(old) + 1, F.length(t))
        return F.when(old != "", F.concat(before, section, F.when(tail != "", F.concat(F.lit("\n"), tail)).otherwise("")))

    def edited(t: Column) -> Column:
        groups = F.struct(*[F.call_function("regexp_extract", t, pattern, F.lit(k)).alias(f"g{k}") for k in (1, 2)])
        # most pages do not name the heading, and are not searched for it
        found = F.when(t.contains(F.concat(F.lit("## "), heading)), let(groups, lambda x: put(t, x["g1"], x["g2"])))
        appended = let(F.rtrim(t, F.lit(BLANKS)), lambda body: F.when(body != "", F.concat(body, F.lit("\n\n"), section)).otherwise(section))
        return F.coalesce(found, appended)

    return let(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), edited)


def with_metadata(text: Column | str, name: Column, value: Column) -> Column:
    """set one scalar of the frontmatter; a page without frontmatter stays."""
    t = F.col(text) if isinstance(text, str) else text
    end = F.locate("\n---\n", t, 5)
    new = F.concat(name, F.lit(": "), value)

    def put(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda x: x.startswith(F.concat(name, F.lit(":")))), True)
        return F.when(at > 0, F.transform(lines, lambda x, i: F.when(i + 1 == at, new).otherwise(x))).otherwise(F.concat(F.array(new), lines))

    head = F.array_join(let(F.split(F.substring(t, F.lit(5), end - 5), "\n", -1), put), "\n")
    return F.when(t.startswith("---\n") & (end > 0), F.concat(F.lit("---\n"), head, F.lit("\n---\n"), F.substring(t, end + 5, F.length(t)))).otherwise(t)


def rendered_citations(body: Column, sources: Column) -> Column:
    """footnotes of known sources as numbered links, in the order of ``sources``; unknown ones stay."""
    numbered = F.transform(sources, lambda s, i: F.struct(s["id"].alias("id"), (i + 1).cast("string").alias("n")))
    return F.aggregate(numbered, body, lambda t, s: F.replace(t, F.concat(F.lit("[^"), s["id"], F.lit("]")), F.concat(F.lit('<sup><a href="#ref-'), s["n"], F.lit('">'), s["n"], F.lit("</a></sup>"))))


# Labels of code languages (F63); others are shown in capitals.
CODE_LABELS = {
    "python": "Python", "py": "Python", "bash": "Bash", "sh": "Shell", "shell": "Shell", "javascript": "JavaScript", "js": "JavaScript", "ts": "TypeScript", "typescript": "TypeScript",
    "json": "JSON", "yaml": "YAML", "yml": "YAML", "toml": "TOML", "go": "Go", "rust": "Rust", "rs": "Rust", "java": "Java", "kotlin": "Kotlin", "scala": "Scala",
    "html": "HTML", "css": "CSS", "scss": "SCSS", "sql": "SQL", "graphql": "GraphQL", "c": "C", "cpp": "C++", "csharp": "C#", "cs": "C#", "ruby": "Ruby", "php": "PHP", "perl": "Perl",
    "nix": "Nix", "lua": "Lua", "dart": "Dart", "swift": "Swift", "dockerfile": "Dockerfile", "docker": "Dockerfile", "markdown": "Markdown", "md": "Markdown",
    "diff": "Diff", "patch": "Patch", "xml": "XML",
}


def labelled_code(html: Column) -> Column:
    """a label on the blocks of highlighted code; labelled ones stay.

    The different openings of a page's blocks are found first, then each is replaced.
    """
    labels = F.create_map(*[F.lit(x) for pair in CODE_LABELS.items() for x in pair])

    def label(lang: Column) -> Column:
        return F.concat(F.lit(' data-lang-label="'), F.coalesce(labels[F.lower(lang)], F.upper(lang)), F.lit('">'))

    def replaced(text: Column, opening: str, new: Callable[[Column], Column]) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(opening), 0))
        return F.aggregate(found, text, lambda t, x: F.replace(t, x, new(F.regexp_extract(x, opening, 1))))

    code = '<pre><span></span><code class="language-'
    html = replaced(html, rf'<div class="codehilite">\s*{code}([a-zA-Z0-9_+-]+)"', lambda x: F.concat(F.lit('<div class="codehilite"'), label(x), F.lit(code), x, F.lit('"')))
    return replaced(html, '<div class="language-([a-zA-Z0-9_+-]+) highlighter-rouge">', lambda x: F.concat(F.lit('<div class="language-'), x, F.lit(' highlighter-rouge"'), label(x)))


def opened(pages: DataFrame) -> DataFrame:
    """Pages with their parsed parts."""
    return pages.withColumn("_t", parted(F.col("text"))).withColumn("_p", parsed("_t.head")).select("slug", "text", "_p.ok", "_p.fields", "_p.sources", "_t.body")


def citation_failures(pages: DataFrame, known: DataFrame) -> DataFrame:
    """(slug, failure) of citations that do not resolve; ``pages`` are opened, ``known`` has refs."""
    legacy = pages.select("slug", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(LEGACY), 1))).alias("ref")).join(known, "ref", "left_anti")
    notes = pages.select("slug", "sources", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(FOOTNOTE), 1))).alias("id"))
    source = F.try_element_at(F.filter("sources", lambda s: s["id"] == F.col("id")), F.lit(1))
    notes = notes.select("slug", "id", source.alias("s"))
    unknown = notes.where("s is null").select("slug", F.concat(F.lit("unknown id "), "id").alias("failure"))
    strange = notes.where(~F.coalesce(F.lower("s.type").isin("article", "web", "builtin"), F.lit(False)) & F.col("s").isNotNull()).select("slug", F.concat(F.lit("unknown type of "), "id"))
    lost = notes.where((F.lower("s.type") == "article") & (F.coalesce("s.ref", F.lit("")) != "")).select("slug", "id", F.col("s.ref").alias("ref")).join(known, "ref", "left_anti")
    return legacy.select("slug", F.concat(F.lit("legacy ref "), "ref").alias("failure")).union(unknown).union(strange).union(lost.select("slug", F.concat(F.lit("ref not in corpus "), "ref")))


def broken_backlinks(pages: DataFrame) -> DataFrame:
    """(slug, link) of links to pages that do not exist."""
    links = pages.select("slug", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(BACKLINK), 1))).alias("link"))
    return links.join(pages.select(F.col("slug").alias("link")), "link", "left_anti").select("slug", "link")


def health(pages: DataFrame, known: DataFrame, index: DataFrame, today: Column) -> DataFrame:
    """(slug, check, severity, detail) of all checks; a page that does not parse skips the others."""
    p = opened(pages)
    good = p.where("ok")
    row = lambda df, check, severity, detail: df.select("slug", F.lit(check).alias("check"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))
    updated = F.try_to_date(F.col("fields")["last_updated"])
    fields = F.array_compact(F.array(*[F.when(F.coalesce(F.col("fields")[n], F.lit("")) == "", n) for n in REQUIRED]))
    cited = citation_failures(good, known)
    parts = [
        row(p.where("not ok"), "yaml", "error", F.lit("frontmatter does not parse")),
        row(good.select("slug", F.explode(fields).alias("f")), "required_field", "error", F.col("f")),
        row(cited.where(~F.col("failure").startswith("ref not")), "citation", "error", F.col("failure")),
        row(cited.where(F.col("failure").startswith("ref not")), "citation", "warn", F.col("failure")),
        row(good.where(updated.isNull()), "last_updated", "error", F.lit("missing or unreadable")),
        row(good.where(updated.isNotNull() & dates.is_stale(updated, today)), "stale", "warn", updated),
        row(broken_backlinks(good), "wikilink", "warn", F.col("link")),
        row(index.join(p.select("slug"), "slug", "left_anti"), "index_orphan", "error", F.lit("no page")),
        row(p.join(index, "slug", "left_anti"), "index_missing", "warn", F.lit("not in the index")),
        row(p.groupBy("slug").agg(F.count("*").alias("n")).where("n > 1"), "duplicate_slug", "error", F.col("n")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def context(questions: DataFrame, pages: DataFrame, known: DataFrame, today: Column) -> DataFrame:
    """The fresh and well-cited page of each question's entity, else an empty text.

    Pages of a wiki are few against questions, but their number is not bounded:
    questions meet them by the words of the slug, not by a cross join.
    """
    good = opened(pages).where("ok")
    fresh = good.where(~dates.is_stale(F.try_to_date(F.col("fields")["last_updated"]), today)).join(citation_failures(good, known).select("slug").distinct(), "slug", "left_anti")
    head = F.split_part(F.col("slug"), F.lit("-"), F.lit(1))
    asked = questions.select("id", F.lower("question").alias("q")).withColumn("head", F.explode(F.array_distinct(F.regexp_extract_all("q", F.lit(r"[\p{L}\p{N}]+"), 0))))
    met = asked.join(pages.select("slug", head.alias("head")), "head").where(F.col("q").contains(F.regexp_replace("slug", "-", " ")) | F.col("q").contains(F.col("slug")))
    main = met.groupBy("id").agg(F.min("slug").alias("slug")).join(fresh.select("slug", "body"), "slug")
    return questions.select("id").join(main, "id", "left").select("id", F.coalesce("body", F.lit("")).alias("context"))


def hydrated(packs: DataFrame, chunks: DataFrame, budget: int = 48_000, cap: int = 12_000) -> DataFrame:
    """The texts of each pack (pack, pos, chunk) within its budget; a pack that misses one is to retry."""
    joined = packs.join(chunks.select("chunk", "text"), "chunk", "left")
    w = Window.partitionBy("pack")
    missing = F.max(F.col("text").isNull().cast("int")).over(w) == 1
    size = F.least(F.length("text"), F.lit(cap))
    used = F.coalesce(F.sum(size).over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    granted = F.greatest(F.lit(0), F.least(size, F.lit(budget) - used))
    return joined.select("pack", "pos", "chunk", missing.alias("retry"), F.when(~missing, F.left("text", granted)).alias("text"))


def entity_articles(relations: DataFrame, chunk_articles: DataFrame, slug) -> DataFrame:
    """Articles of each entity's edges; of entities with one slug the first in row order counts."""
    ends = relations.select("pos", F.explode(F.array("src_id", "tgt_id")).alias("entity"), "source_id").withColumn("slug", slug(F.col("entity")))
    first = ends.groupBy("slug").agg(F.min_by("entity", "pos").alias("entity"))
    chunks = ends.join(first, ["slug", "entity"], "left_semi").select("slug", F.explode(F.filter(F.split("source_id", r"[<>|\s]+"), lambda x: x.startswith("chunk-"))).alias("chunk"))
    return chunks.join(chunk_articles, "chunk").groupBy("slug").agg(F.array_sort(F.collect_set("id")).alias("articles"))


def assembled(evidence: DataFrame) -> DataFrame:
    """A patch of each slug from its evidence: its sources, their types and the confidence."""
    from tessera.operators.aggregates import confidence

    return evidence.groupBy("slug").agg(F.count_distinct("type", "ref").alias("sources"), F.count_distinct("type").alias("types"), F.array_sort(F.collect_set("ref")).alias("refs")).withColumn("confidence", confidence(F.col("sources"), F.col("types")))


def applicable(patches: DataFrame, pages: DataFrame) -> DataFrame:
    """A patch (slug, base_digest, text) applies, or conflicts with the page that is there now."""
    now = pages.select("slug", F.sha2("text", 256).alias("digest"))
    state = F.when(F.col("base_digest").isNull(), F.col("digest").isNull()).otherwise(F.coalesce(F.col("digest") == F.col("base_digest"), F.lit(False)))
    return patches.join(now, "slug", "left").withColumn("outcome", F.when(state, "apply").otherwise("conflict")).drop("digest")


def update_outcomes(patches: DataFrame, pages: DataFrame) -> DataFrame:
    """``patches`` (slug, base_digest, class by ``classify.patch_class``) with their status against the pages that are there now.

    A patch that may be applied by itself is applied, or conflicts if its page has changed (or came or went) since; the others are
    kept as suggestions or rejected, whatever the page is.
    """
    auto = F.when(F.col("outcome") == "apply", "applied").otherwise("conflict")
    status = F.when(F.col("class") == "auto_apply", auto).when(F.col("class") == "rejected", "rejected").otherwise("suggestion")
    return applicable(patches, pages).withColumn("status", status).drop("outcome")


def update_stats(outcomes: DataFrame, *keys: str) -> DataFrame:
    """What an update run reports, by ``keys``: suggestions that are persisted were not applied."""
    of = lambda name: F.count_if(F.col("status") == name)
    return outcomes.groupBy(*keys).agg(
        F.count("*").alias("suggestions_generated"), of("applied").alias("applied"), F.count_if(F.col("status") != "applied").alias("dropped"),
        of("suggestion").alias("suggestions_persisted"), of("conflict").alias("conflicted"), of("rejected").alias("rejected"))


def gates(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidate pages with what blocks them: unreadable frontmatter or citations."""
    p = opened(candidates)
    bad = citation_failures(p.where("ok"), known).groupBy("slug").agg(F.array_sort(F.collect_set("failure")).alias("failures"))
    return p.join(bad, "slug", "left").select("slug", F.when(~F.col("ok"), F.array(F.lit("frontmatter"))).otherwise(F.coalesce("failures", F.array().cast("array<string>"))).alias("blocked_by"))


def worked(suggestions: DataFrame, now: Column, outcomes: DataFrame, limit: int) -> DataFrame:
    """Due suggestions, oldest first up to ``limit``, with their next state after an outcome."""
    from tessera.functions.predicates import is_due

    due = suggestions.where(is_due(F.col("status"), F.col("next_retry_at"), now)).orderBy("created_at", "id").limit(limit)
    step = dates.transition(F.col("attempts"), F.coalesce("outcome", F.lit("retry")), now)
    return due.join(outcomes, "id", "left").select("id", step.alias("t")).select("id", "t.status", "t.attempts", "t.next_retry_at")
