"""Scalar text functions as columns (section 2.9); all stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"
CJK = "一-鿿"
SPACE = r"[\s\u0085   -     　]"

# Labels and patterns of keyword tags, in order.
KEYWORD_TAGS = (
    ("MCP", r"\bMCP\b|Model Context Protocol"), ("Agent", r"Agent|智能体|代理"), ("RAG", r"\bRAG\b|检索|知识库"), ("多模态", r"多模态|multimodal|视觉"),
    ("安全", r"安全|prompt injection|注入|劫持"), ("工程化", r"工程|架构|生产|部署|工作流"), ("推理优化", r"推理|解码|缓存|KV"),
)
# Points of account tags, and words of titles that count one each.
AGENT_TAGS = {"Agent": 3, "agent": 3, "RAG": 2, "rag": 2, "工程化": 2, "MCP": 3, "多智能体": 3, "multi-agent": 3, "AI": 1}
AGENT_TITLE_WORDS = (
    "agent", "Agent", "RAG", "rag", "MCP", "mcp", "多智能体", "智能体", "编排", "工作流", "workflow", "LangGraph", "LangChain", "CrewAI", "AutoGen",
    "推理", "reasoning", "tool", "Tool", "function call", "skill", "Skill", "知识图谱", "knowledge graph",
)
# Words that a question's keywords leave out.
STOP_ZH = (
    "什么", "是", "的", "了", "吗", "呢", "如何", "怎么", "怎样", "为什么", "哪些", "哪个", "和", "与", "及", "在", "有", "会", "区别", "介绍", "请问", "可以", "需要", "关于", "一下", "这个", "那个",
)
STOP_EN = (
    "what", "is", "are", "the", "a", "an", "how", "why", "of", "to", "do", "does", "did", "in", "on", "for", "and", "or", "with", "about", "explain", "tell", "me", "can", "you", "please", "between", "vs",
)
# Hosts of images that are never kept (F20), and the old image server.
EXTERNAL_IMAGES = r"(?:mmbiz\.qpic\.cn|mmbiz\.qlogo\.cn|mp\.weixin\.qq\.com)"
OLD_IMAGE_SERVER = "http://localhost:8765/"


def strip(c: Column) -> Column:
    """Trim all Unicode white space."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{SPACE}+", " "))


def cut(c: Column, most: int) -> Column:
    """At most so many characters, with an ellipsis if cut."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, most), f"{SPACE}+$", ""), F.lit(ELLIPSIS)))


def slug(name: Column) -> Column:
    """lower-case, without characters that URLs cannot hold, blanks as hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(F.coalesce(name, F.lit("")))), r"""[/\\&"'<>?#%]""", ""), f"{SPACE}+", "-")


def ascii_slug(name: Column, default: str | None = "untitled") -> Column:
    """F2 with a default, F3 with ``default=None`` (may be empty)."""
    out = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return out if default is None else F.coalesce(F.when(out != "", out), F.lit(default))


def result_snippet(body: Column, most: int = 200) -> Column:
    """without images and code."""
    t = F.regexp_replace(F.coalesce(body, F.lit("")), r"!\[[^\]]*\]\([^)]*\)", "")
    t = F.regexp_replace(F.regexp_replace(t, r"```[\s\S]*?```", ""), "`[^`]*`", "")
    return cut(collapse(t), most)


# Boilerplate that card snippets leave out, in order (F6), each with a text that it cannot be without.
BOILERPLATE = (
    ("URL:", r"(?m)^URL:\s*https?://\S+\s*$", ""), ("Time:", r"(?m)^Time:\s*\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\s*$", ""),
    ("在小说阅读器读本章", r"(;\)\s+)?_{3,}\s*\n+\s*在小说阅读器读本章\s*\n+\s*去阅读\s*\n+\s*在小说阅读器中沉浸阅读", ""),
    ("在小说阅读器", r"(?m)^在小说阅读器(读本章|中沉浸阅读)\s*$", ""), ("去阅读", r"(?m)^去阅读\s*$", ""),
    ("关注公众号", "\\*\\*点击上方[\"“”‘’「」]?[^\"“”‘’「」]+?[\"“”‘’「」]?,?关注公众号[^*]*\\*\\*", ""),
    ("原创", rf"(?U)(原创\s+)([{CJK}\w]{{2,5}})\s+\2\b", "$1$2"),
)
# Markdown that card snippets leave out, in order (F6), each with a text that it cannot be without.
MARKUP = (
    ("```", r"```[\s\S]*?```", ""), ("`", "`[^`]*`", ""), ("![", r"!\[[^\]]*\]\([^)]*\)", ""), ("](", r"\[([^\]]+)\]\([^)]*\)", "$1"), ("<", r"<[^>]+>", ""),
    ("", r"(?m)^[#>\-*+]+\s*", ""), ("**", r"\*\*([^*]+)\*\*", "$1"), ("*", r"\*([^*]+)\*", "$1"),
)


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def without_patterns(text: Column, patterns: tuple[tuple[str, str, str], ...]) -> Column:
    """Each pattern replaced in turn, only in texts that hold what it cannot be without."""
    def one(t: Column, needs: str, pattern: str, to: str) -> Column:
        return F.when(t.contains(needs), F.regexp_replace(t, pattern, to)).otherwise(t)

    for step in patterns:
        text = bound(text, lambda t: one(t, *step))  # noqa: B023  the lambda is called at once
    return text


def without_repeated_headings(text: Column) -> Column:
    """A first-level heading goes if the last line before it that is not blank is the same heading."""
    title = lambda line: F.when(line.rlike(r"^#\s+.+?\s*$"), F.regexp_extract(line, r"^#\s+(.+?)\s*$", 1))

    def kept(t: Column) -> Column:
        lines = F.transform(F.split(t, "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("line"), (strip(x) == "").alias("blank")))
        return bound(lines, lambda ls: bound(F.filter(ls, lambda x: ~x["blank"]), lambda full: F.array_join(
            F.transform(F.sort_array(F.concat(F.filter(ls, lambda x: x["blank"]), F.filter(full, lambda x, k: (k == 0) | F.coalesce(title(x["line"]) != title(F.get(full, k - 1)["line"]), F.lit(True))))), lambda x: x["line"]), "\n")))

    # only texts with two headings can lose one
    return bound(text, lambda t: F.when(t.rlike(r"(?ms)^#\s.*^#\s"), kept(t)).otherwise(t))


def card_snippet(body: Column, most: int = 200) -> Column:
    """boilerplate first, while it stands at line starts; then repeated headings, then markup."""
    t = without_repeated_headings(without_patterns(F.coalesce(body, F.lit("")), BOILERPLATE))
    return cut(collapse(without_patterns(t, MARKUP)), most)


def excerpt(body: Column, most: int = 120) -> Column:
    """F7."""
    return cut(collapse(F.coalesce(body, F.lit(""))), most)


def reading_minutes(body: Column) -> Column:
    """F8: 500 CJK characters or 250 Latin words a minute, half-even, at least 1; 0 without a body."""
    t = F.regexp_replace(body, "<[^>]+>", "")
    minutes = F.bround(F.regexp_count(t, F.lit(f"[{CJK}]")) / 500 + F.regexp_count(t, F.lit("[A-Za-z]+")) / 250).cast("int")
    return F.when(F.coalesce(body, F.lit("")) == "", 0).otherwise(F.greatest(F.lit(1), minutes))


def has_cjk(text: Column) -> Column:
    """F9."""
    return F.coalesce(text.rlike("[一-鿿㐀-䶿]"), F.lit(False))


def cjk_share(text: Column) -> Column:
    n = F.length(text)
    return F.when(n > 0, F.regexp_count(text, F.lit(f"[{CJK}]")) / n)


def language_by_any(title: Column, body: Column) -> Column:
    """the title first; short texts are unknown."""
    t, b = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    return F.when(has_cjk(t) | has_cjk(b), "zh-CN").when(F.length(t) + F.length(b) < 50, "unknown").otherwise("en")


def language_by_share(text: Column) -> Column:
    """over characters that are no white space; above 0.30."""
    return F.when(F.coalesce(cjk_share(F.regexp_replace(text, SPACE, "")), F.lit(0.0)) > 0.30, "zh").otherwise("en")


def language_by_head(text: Column) -> Column:
    """over the first 1000 characters; null without text."""
    head = F.substring(text, 1, 1000)
    return F.when(F.length(head) > 0, F.when(cjk_share(head) >= 0.30, "zh").otherwise("en"))


def language_of_question(text: Column) -> Column:
    """over all characters."""
    return F.when(F.coalesce(cjk_share(text), F.lit(0.0)) >= 0.3, "zh").otherwise("en")


def target_language(source: Column) -> Column:
    """F14."""
    return F.when(source.startswith("zh"), "en").otherwise("zh-CN")


def canonical_language(lang: Column) -> Column:
    """F15."""
    return F.when(F.coalesce(lang, F.lit("")) == "", "unknown").when(lang == "zh", "zh-CN").otherwise(lang)


def effective_language(canonical: Column, source: Column) -> Column:
    """F16."""
    return F.when(canonical.isin("zh-CN", "en"), canonical).when(source == "rss", "en").otherwise("zh-CN")


def localized(raw: Column, translated: Column, effective: Column) -> Column:
    """(zh, en) of a raw and a translated value."""
    other = F.coalesce(F.when(translated != "", translated), raw)
    return F.struct(F.when(effective == "en", other).otherwise(raw).alias("zh"), F.when(effective == "en", raw).otherwise(other).alias("en"))


def image_paths(body: Column, base: str = "") -> Column:
    """the old image server's addresses, and bare static paths, under ``base``; a second pass changes nothing."""
    t = F.regexp_replace(body, re.escape(OLD_IMAGE_SERVER), f"{base}/static/img/")
    return F.regexp_replace(t, r'(?<=[("\s])/static/img/', f"{base}/static/img/") if base else t


def image_references(body: Column) -> Column:
    """plain-text image lines as tags."""
    return F.regexp_replace(body, r"Image (\d+) from article '([^']*)': (\S+)", '<img src="$3" alt="image $1" loading="lazy">')


def without_external_images(body: Column) -> Column:
    """F20."""
    t = F.regexp_replace(body, rf"!\[[^\]]*\]\([^)]*{EXTERNAL_IMAGES}[^)]*\)", "")
    return F.regexp_replace(t, rf"(?i)<img[^>]*{EXTERNAL_IMAGES}[^>]*>", "")


def without_metadata_header(body: Column) -> Column:
    """the fixed header of title, URL and time."""
    return F.regexp_replace(body, r"\A# +[^\n]+\n\nURL: +\S+\nTime: +\d{4}-\d{2}-\d{2} +\d{2}:\d{2}:\d{2}\n\n# +[^\n]+\n\n", "")


def image_blocks(body: Column) -> Column:
    """F22."""
    return F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"<img\b[^>]*>|!\[[^\]]*\]\([^)]+\)"), 0)


def image_urls(body: Column) -> Column:
    """markdown images first, then tags, each once."""
    b = F.coalesce(body, F.lit(""))
    return F.array_distinct(F.concat(F.regexp_extract_all(b, F.lit(r"!\[[^\]]*\]\(([^)\s]+)\)"), 1), F.regexp_extract_all(b, F.lit("""<img[^>]+src=["']([^"']+)["']"""), 1)))


def first_text(*choices: tuple[str, Column]) -> Column:
    """the first body that is not empty, with the name of its source."""
    text = F.coalesce(*[F.when(c != "", c) for _, c in choices], F.lit(""))
    named = F.coalesce(*[F.when(c != "", n) for n, c in choices], F.lit("none"))
    return F.struct(text.alias("text"), named.alias("origin"))


def translated_body(repositioned: Column, translated: Column, base: str = "") -> Column:
    """the translation to show, its images cleaned; null without one."""
    chosen = F.coalesce(F.when(repositioned != "", repositioned), F.when(translated != "", translated))
    return image_references(image_paths(without_external_images(chosen), base))


def localized_images(text: Column, names: Column) -> Column:
    """each remote address of the map ``names`` by its local one."""
    return F.aggregate(F.map_entries(names), text, lambda t, e: F.replace(t, e["key"], e["value"]))


def paragraphs(text: Column) -> Column:
    """not empty, trimmed, parted by blank lines."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), strip), lambda p: p != "")


def overlap(keywords: Column, text: Column) -> Column:
    """the share of the keywords found in the text; 0 without keywords."""
    found = F.filter(keywords, lambda k: F.lower(text).contains(F.lower(k)))
    return F.when(F.size(keywords) > 0, F.size(found) / F.size(keywords)).otherwise(0.0)


def linked_citations(markdown: Column) -> Column:
    """references to an article's hash as links; a second pass changes nothing."""
    t = F.regexp_replace(markdown, r"\[(?:/?article/|article:)([a-f0-9]{10})(?:\.html)?\](?!\()", "[$1]")
    return F.regexp_replace(t, r"\[([a-f0-9]{6})([a-f0-9]{4})\](?!\()", "[$1](articles/$1$2.html)")


def old_image_urls(markdown: Column) -> Column:
    """F41."""
    return F.regexp_replace(markdown, r"https?://[^/\s)\"']*:8765/", "/static/img/")


def without_first_heading(text: Column) -> Column:
    """F43."""
    return F.regexp_replace(text, r"\A\s*#[ \t]+[^\n]*\n?", "")


def sentences(text: Column) -> Column:
    """F44."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def source_chunks(source_id: Column) -> Column:
    """F48."""
    return F.filter(F.split(F.coalesce(source_id, F.lit("")), r"[<>|\s]+"), lambda s: s.startswith("chunk-"))


def source_domain(url: Column) -> Column:
    """the host, lower-case, without ``www.``; null unless http or https."""
    host = F.lower(F.regexp_extract(url, r"^https?://([^/?#]+)", 1))
    return F.when(host != "", F.regexp_replace(host, r"^www\.", ""))


#: The edge of a word of ASCII letters, digits and underscores.
ASCII_EDGE = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


def keyword_tags(*values: Column, edge: str = r"\b") -> Column:
    """F50; ``edge`` is the pattern of a word's edge, by default between letters of any script and others."""
    t = F.concat_ws(" ", *[F.coalesce(v, F.lit("")) for v in values])
    return F.array_compact(F.array(*[F.when(t.rlike("(?iu)" + p.replace(r"\b", edge)), label) for label, p in KEYWORD_TAGS]))


def merged_tags(source_name: Column, topics: Column, keywords: Column, most: int = 3) -> Column:
    """the source first, then topics (parted by a bar), then keywords."""
    known = F.array_distinct(F.concat(F.filter(F.transform(F.split(F.coalesce(topics, F.lit("")), r"\|"), collapse), lambda x: x != ""), keywords))
    name = collapse(F.coalesce(source_name, F.lit("")))
    return F.slice(F.when((name != "") & ~F.array_contains(known, name), F.concat(F.array(name), known)).otherwise(known), 1, most)


def agent_score(tags: Column, title: Column) -> Column:
    """keywords count in lower case, so both spellings of one count twice."""
    g, t = F.lower(F.coalesce(tags, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    out = F.lit(0)
    for word, points in AGENT_TAGS.items():
        out = out + F.when(g.contains(word.lower()), points).otherwise(0)
    for word in AGENT_TITLE_WORDS:
        out = out + F.when(t.contains(word.lower()), 1).otherwise(0)
    return out


def canonical_names(text: Column, pairs: Column) -> Column:
    """each raw name of ``pairs`` (array of raw, canonical) replaced, in order."""
    return F.aggregate(pairs, text, lambda t, p: F.replace(t, p["raw"], p["canonical"]))


def numbered_sections(heads: Column, items: Column) -> Column:
    """numbered answers; a null answer is left out and keeps its number."""
    lines = F.transform(F.arrays_zip(heads.alias("q"), items.alias("a")), lambda x, i: F.when(x["a"].isNotNull(), F.concat(F.lit("### "), (i + 1).cast("string"), F.lit(". "), x["q"], F.lit("\n\n"), x["a"])))
    return F.array_join(F.array_compact(lines), "\n\n")


def cited_blocks(blocks: Column, maps: Column) -> Column:
    """the trimmed blocks that are not empty, with their footnotes.

    ``maps`` has an array of block numbers for each source, null for a source without one. If any source has one, a block cites the sources
    that name it; else block i cites source i. Blocks keep their numbers where empty ones are left out.
    """
    mapped = F.exists(maps, lambda m: m.isNotNull())

    def cited(block: Column, i: Column) -> Column:
        named = F.array_compact(F.transform(maps, lambda m, j: F.when(F.array_contains(m, i), j + 1)))
        numbers = F.when(mapped, named).when(i < F.size(maps), F.array(i + 1)).otherwise(F.array().cast("array<int>"))
        notes = F.array_join(F.transform(numbers, lambda n: F.concat(F.lit("[^"), n.cast("string"), F.lit("]"))), "")
        return F.when(strip(block) != "", F.concat(strip(block), F.when(notes != "", F.concat(F.lit(" "), notes)).otherwise("")))

    return F.array_join(F.array_compact(F.transform(blocks, cited)), "\n\n")


def reference_list(titles: Column) -> Column:
    """F56."""
    return F.array_join(F.transform(titles, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n")


def image_count(body: Column) -> Column:
    """F60."""
    return F.regexp_count(F.coalesce(body, F.lit("")), F.lit(r"!\[[^\]]*\]\([^)]*\)"))


def longest(*bodies: Column) -> Column:
    """the longest content, the first of equals; null if all are empty."""
    best = F.array_max(F.array(*[F.struct(F.length(F.coalesce(b, F.lit(""))).alias("n"), F.lit(-i).alias("i"), b.alias("b")) for i, b in enumerate(bodies)]))
    return F.when(best["n"] > 0, best["b"])


def question_keywords(question: Column) -> Column:
    """runs of ASCII or CJK without stop words; CJK runs lose stop words at their start, each in turn, the longest first."""

    def without_prefixes(word: Column) -> Column:
        for stop in sorted(STOP_ZH, key=len, reverse=True):
            word = F.regexp_replace(word, f"^(?:{stop})+(?=.)", "")
        return word

    words = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(f"[A-Za-z0-9]+|[{CJK}]+"), 0)
    kept = F.transform(F.filter(words, lambda w: ~F.lower(w).isin(*STOP_EN)), without_prefixes)
    return F.filter(kept, lambda w: ~w.isin(*STOP_ZH))


def spliced(body: Column, images: Column) -> Column:
    """images spread evenly over the gaps between paragraphs; without gaps they follow the body."""
    blocks, n = F.coalesce(images, F.array().cast("array<string>")), F.size(images)
    parts = F.split(body, r"\n\s*\n", -1)

    def place(i: Column) -> Column:
        """The paragraph (from 1) that image ``i`` (from 0) follows."""
        return F.least(F.greatest(F.floor((i + 1) * F.size(parts) / (n + 1)), F.lit(1)), F.size(parts) - 1)

    spread = F.flatten(F.transform(parts, lambda p, k: F.concat(F.array(p), F.filter(blocks, lambda b, i: place(i) == k + 1))))
    after = F.concat(F.array_join(F.concat(F.array(F.regexp_replace(body, r"\s+\z", "")), blocks), "\n\n"), F.lit("\n"))
    return F.when(F.coalesce(n, F.lit(0)) <= 0, body).when(F.coalesce(body, F.lit("")) == "", F.array_join(blocks, "\n\n")).when(F.size(parts) < 2, after).otherwise(F.array_join(spread, "\n\n"))


def image_parity(translated: Column, source: Column) -> Column:
    """a translation with fewer images than its source gets the rest."""
    have, want = F.size(image_blocks(translated)), image_blocks(source)
    return F.when(have < F.size(want), spliced(translated, F.slice(want, have + 1, F.greatest(F.size(want), F.lit(1))))).otherwise(translated)


def one_reference_section(text: Column) -> Column:
    """of several reference sections that with the most links stays, the first on ties."""
    blank = r"[^\S\n]*"
    heading = rf"{blank}(?:#|\*\*[^\n]+\*\*{blank}(?:\n|\z))"
    sections = F.split(text, rf"\n(?={heading})", -1)
    is_reference = lambda x: x.rlike(rf"\A{heading}") & x.rlike(rf"(?i)\A{blank}(?:#+{blank}|\*\*){blank}(?:references|参考(?:资料|文献)|来源)")
    links = F.transform(sections, lambda x, i: F.when(is_reference(x), F.struct(F.regexp_count(x, F.lit(r"\]\(")).alias("n"), (-i).alias("at"))))
    best = F.array_max(F.array_compact(links))
    one = F.filter(sections, lambda x, i: ~is_reference(x) | (-i == best["at"]))
    return F.when(F.size(F.array_compact(links)) > 1, F.array_join(one, "\n")).otherwise(text)


# --- a function that folds with state, as an Arrow UDF ---


def body_chunks(body: Column, most: Column) -> Column:
    """paragraphs packed up to ``most`` characters; longer ones are parted at lines, longer lines cut hard."""
    text = F.coalesce(body, F.lit(""))
    alone = -1

    def part(t: Column, gap: str, run: Column | int) -> Column:
        """A part of a run; parts of one run are packed, but for those that stand alone."""
        return F.struct(t.alias("t"), F.lit(gap).alias("gap"), (F.lit(run) if isinstance(run, int) else run).alias("run"))

    def lines(paragraph: Column, number: Column) -> Column:
        pieces = lambda x: F.transform(F.regexp_extract_all(x, F.concat(F.lit("(?s).{1,"), most.cast("string"), F.lit("}")), 0), lambda y: part(y, "", alone))
        return F.flatten(F.transform(F.split(paragraph, "\n", -1), lambda x: F.when(F.length(x) <= most, F.array(part(x, "\n", number + 1))).otherwise(pieces(x))))

    def more(parts: Column, held: Column) -> Column:
        return F.concat(parts, F.array(held))

    def closed(state: Column) -> Column:
        return F.when(state["held"] != "", more(state["parts"], state["held"])).otherwise(state["parts"])

    def step(state: Column, x: Column) -> Column:
        same = state["run"] == x["run"]
        full = F.when(same, F.length(state["held"])).otherwise(0) + F.length(x["gap"]) + F.length(x["t"]) > most
        parts = F.when(x["run"] == alone, more(closed(state), x["t"])).when(same, F.when(full, more(state["parts"], state["held"])).otherwise(state["parts"])).otherwise(F.when(full, more(closed(state), F.lit(""))).otherwise(closed(state)))
        held = F.when(x["run"] == alone, "").when(~same | full | (state["held"] == ""), x["t"]).otherwise(F.concat(state["held"], x["gap"], x["t"]))
        return F.struct(parts.alias("parts"), held.alias("held"), x["run"].alias("run"))

    every = F.flatten(F.transform(F.split(text, "\n\n", -1), lambda p, k: F.when(F.length(p) <= most, F.array(part(p, "\n\n", 0))).otherwise(lines(p, k))))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("held"), F.lit(alone).alias("run"))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(F.aggregate(every, start, step, closed))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """Bind a value once for an expression that uses it more than once."""
    return F.transform(F.array(value), then)[0]
