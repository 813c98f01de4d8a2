"""HTML pages as markdown with their images and main content.

Pages are read once, tag by tag, with a stack of open elements: it closes what
HTML lets authors leave open (paragraphs, list items, table cells, whatever a
closing tag passes over) and survives pages that are cut off. The events of one
reading serve all renderings: the main content, the body without navigation, and
everything.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.predicates import passes_quality_gate

#: Images of an explicit width below this are left out.
LEAST_WIDTH = 100
#: Where the main content is, in this order: classes, then elements.
MAIN = (".RichContent-inner", ".RichText", "article", "main")

VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
RAW = frozenset(("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg"))
BLOCK = frozenset(("address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "thead", "tr", "ul"))
NAVIGATION = frozenset(("nav", "footer", "aside", "header", "form"))
INLINE_MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*"}
#: An element that opens closes these, up to the nearest of the second set.
CLOSES = {"li": (frozenset(("li",)), frozenset(("ul", "ol"))), "tr": (frozenset(("tr",)), frozenset(("table",))), "td": (frozenset(("td", "th")), frozenset(("tr", "table"))), "th": (frozenset(("td", "th")), frozenset(("tr", "table"))), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",)))}
BLANKS = " \t\n\r\f"
#: A-Z to a-z; no character changes its length.
LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass
class Event:
    """The start or end of an element, or text; ``end`` of a start is the place of its end."""

    kind: str
    name: str = ""
    attributes: dict[str, str] = field(default_factory=dict)
    text: str = ""
    end: int = -1


def attributes(source: str) -> dict[str, str]:
    """The attributes of a tag's inside; the first of a name counts."""
    out: dict[str, str] = {}
    i, n = 0, len(source)
    while i < n:
        while i < n and (source[i] in BLANKS or source[i] == "/"):
            i += 1
        start = i
        while i < n and source[i] not in BLANKS and source[i] not in "=/":
            i += 1
        name = source[start:i].lower()
        while i < n and source[i] in BLANKS:
            i += 1
        value = ""
        if i < n and source[i] == "=":
            i += 1
            while i < n and source[i] in BLANKS:
                i += 1
            if i < n and source[i] in "\"'":
                stop = source.find(source[i], i + 1)
                stop = n if stop < 0 else stop
                value, i = source[i + 1 : stop], stop + 1
            else:
                start = i
                while i < n and source[i] not in BLANKS:
                    i += 1
                value = source[start:i]
        if name:
            out.setdefault(name, entities.unescape(value))
    return out


def tag_end(page: str, at: int) -> int:
    """The place of the ``>`` that ends a tag, quotes aside; the page's end if none."""
    quote = ""
    for i in range(at, len(page)):
        c = page[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and page[i - 1] in "=" + BLANKS:
            quote = c
        elif c == ">":
            return i
    return len(page)


def terminated(text: str) -> str:
    """The text with its character references that a semicolon ends decoded; one that is cut off stays as written."""
    return re.sub(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", lambda m: entities.unescape(m[0]), text)


def tokens(page: str, decode: Callable[[str], str] = entities.unescape) -> Iterator[Event]:
    """Starts, ends and texts in order, as written."""
    i, n = 0, len(page)
    lowered = None
    while i < n:
        open_at = page.find("<", i)
        if open_at < 0:
            open_at = n
        if open_at > i:
            yield Event("text", text=decode(page[i:open_at]))
        if open_at == n:
            return
        following = page[open_at + 1 : open_at + 2]
        if page.startswith("<!--", open_at):
            stop = page.find("-->", open_at + 4)
            i = n if stop < 0 else stop + 3
        elif following in ("!", "?"):
            i = tag_end(page, open_at + 1) + 1
        elif following == "/":
            stop = tag_end(page, open_at + 2)
            yield Event("end", page[open_at + 2 : stop].strip().split(" ")[0].lower())
            i = stop + 1
        elif following.isalpha():
            stop = tag_end(page, open_at + 1)
            inside = page[open_at + 1 : stop]
            size = 0
            while size < len(inside) and inside[size] not in BLANKS and inside[size] != "/":
                size += 1
            name = inside[:size].lower()
            i = stop + 1
            yield Event("start", name, attributes(inside[size:]))
            if name in RAW and not inside.endswith("/"):
                lowered = page.translate(LOWER) if lowered is None else lowered
                close = lowered.find(f"</{name}", i)
                i = n if close < 0 else tag_end(page, close) + 1
                yield Event("end", name)
        else:
            yield Event("text", text="<")
            i = open_at + 1


def events(page: str, decode: Callable[[str], str] = entities.unescape) -> list[Event]:
    """The page's events with every element closed, by the stack of open elements."""
    out: list[Event] = []
    stack: list[int] = []
    still_open: Counter[str] = Counter()

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            start = out[stack.pop()]
            still_open[start.name] -= 1
            start.end = len(out)
            out.append(Event("end", start.name))

    def topmost(names: frozenset[str], fence: frozenset[str]) -> int:
        """The depth of the innermost open element of these names before any of the fence; -1 if none."""
        if not any(still_open[n] for n in names):
            return -1
        for depth in range(len(stack) - 1, -1, -1):
            if out[stack[depth]].name in names:
                return depth
            if out[stack[depth]].name in fence:
                return -1
        return -1

    for e in tokens(page, decode):
        if e.kind == "text":
            out.append(e)
        elif e.kind == "start":
            if e.name in BLOCK and (depth := topmost(frozenset(("p",)), frozenset(("div", "article", "section", "td", "li", "body")))) >= 0:
                close_to(depth)
            if e.name in CLOSES and (depth := topmost(*CLOSES[e.name])) >= 0:
                close_to(depth)
            out.append(e)
            if e.name in VOID:
                e.end = len(out) - 1
            else:
                stack.append(len(out) - 1)
                still_open[e.name] += 1
        elif (depth := topmost(frozenset((e.name,)), frozenset())) >= 0:
            close_to(depth)
    close_to(0)
    return out


def main_range(page: list[Event]) -> tuple[int, int]:
    """The events of the main content: the first element of the first selector that has one; the whole page if none has."""
    for selector in MAIN:
        for i, e in enumerate(page):
            if e.kind == "start" and (selector[1:] in e.attributes.get("class", "").split() if selector[0] == "." else e.name == selector):
                return i, e.end + 1
    return 0, len(page)


def image_source(given: dict[str, str]) -> str:
    """An image's address: lazy pages have it in data-original or data-src."""
    source = given.get("src", "")
    if given.get("data-original"):
        return given["data-original"]
    return given["data-src"] if given.get("data-src") and (not source or source.startswith("data:")) else source


def too_small(given: dict[str, str]) -> bool:
    width = (given.get("width") or given.get("data-width") or "").replace("px", "").strip()
    return width.isascii() and width.isdigit() and int(width) < LEAST_WIDTH


class Renderer:
    """Events to markdown: blocks apart by a blank line, list items by a line feed."""

    def __init__(self, skip: frozenset[str]):
        self.skip = skip
        self.blocks: list[tuple[str, bool]] = []  # text, and whether it is an item that follows its neighbour closely
        self.line: list[str] = []
        self.marks: list[tuple[str, int]] = []
        self.lists: list[list] = []
        self.prefix = ""
        self.item = False
        self.pre = 0
        self.images: list[str] = []

    def flush(self) -> None:
        while self.marks:
            self.close_mark(self.marks[-1][0])
        text = "".join(self.line)
        self.line = []
        text = text.strip("\n") if self.pre else "\n".join(" ".join(part.split()) for part in text.split("\n")).strip()
        if text:
            self.blocks.append((self.prefix + text, self.item))
            if self.item:
                self.prefix = "  " * len(self.lists)

    def close_mark(self, mark: str) -> None:
        """End emphasis, code or a link; blanks at its ends stay outside, and empty ones go."""
        while self.marks:
            name, at = self.marks.pop()
            inner = "".join(self.line[at + 1 :])
            bare = inner.strip()
            opened = self.line[at]
            del self.line[at:]
            closing = name if name in ("**", "*", "`") else f"]({name})"
            if bare:
                lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
                self.line += [lead, opened, bare, closing, tail]
            if name == mark:
                return

    def text(self, value: str) -> None:
        if self.pre:
            self.line.append(value)
            return
        joined = " ".join(value.split())
        if value[:1].isspace() and joined:
            joined = " " + joined
        if value[-1:].isspace() and value.strip():
            joined += " "
        self.line.append(joined or (" " if value else ""))

    def start(self, e: Event) -> None:
        name = e.name
        if name in BLOCK:
            self.flush()
        if name == "br":
            self.line.append("\n")
        elif name == "hr":
            self.blocks.append(("---", False))
        elif name == "img":
            source = image_source(e.attributes)
            if source and not too_small(e.attributes):
                self.line.append(f"![{e.attributes.get('alt', '')}]({source})")
                if source.startswith("http"):
                    self.images.append(source)
        elif name in INLINE_MARKS or (name == "code" and not self.pre):
            self.open_mark(INLINE_MARKS.get(name, "`"))
        elif name == "a" and e.attributes.get("href"):
            self.marks.append((e.attributes["href"], len(self.line)))
            self.line.append("[")
        elif name in ("ul", "ol"):
            self.lists.append([name, 0])
        elif name == "li":
            if self.lists:
                self.lists[-1][1] += 1
            kind, number = self.lists[-1] if self.lists else ("ul", 0)
            self.prefix = "  " * max(0, len(self.lists) - 1) + (f"{number}. " if kind == "ol" else "- ")
            self.item = True
        elif name == "blockquote":
            self.prefix = "> "
        elif name == "pre":
            self.pre += 1
        elif len(name) == 2 and name[0] == "h" and name[1].isdigit():
            self.prefix = "#" * int(name[1]) + " "
        elif name in ("td", "th") and "".join(self.line).strip():
            self.line.append(" | ")

    def open_mark(self, mark: str) -> None:
        self.marks.append((mark, len(self.line)))
        self.line.append(mark)

    def end(self, e: Event) -> None:
        name = e.name
        if name == "pre":
            body = "".join(self.line).strip("\n")
            self.line, self.pre = [], self.pre - 1
            if body:
                self.blocks.append((f"```\n{body}\n```", False))
        elif name in BLOCK:
            self.flush()
        elif name in INLINE_MARKS or name == "code":
            mark = INLINE_MARKS.get(name, "`")
            if any(m == mark for m, _ in self.marks):
                self.close_mark(mark)
        elif name == "a" and (link := next((m for m, _ in reversed(self.marks) if m not in ("**", "*", "`")), None)) is not None:
            self.close_mark(link)
        if name in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.item = bool(self.lists)
        if name in ("li", "blockquote") or (len(name) == 2 and name[0] == "h" and name[1].isdigit()):
            self.prefix, self.item = "", self.item and bool(self.lists) and name != "li"

    def run(self, page: list[Event], low: int, high: int) -> str:
        i = low
        while i < high:
            e = page[i]
            if e.kind == "start" and (e.name in RAW or e.name in self.skip):
                if e.name in BLOCK:
                    self.flush()
                i = e.end + 1
                continue
            if e.kind == "text":
                self.text(e.text)
            elif e.kind == "start":
                self.start(e)
            else:
                self.end(e)
            i += 1
        self.flush()
        out = ""
        for k, (text, close) in enumerate(self.blocks):
            out += ("" if not k else "\n" if close and self.blocks[k - 1][1] else "\n\n") + text
        return out


def renderings(page: str | None, decode: Callable[[str], str] = entities.unescape) -> tuple[str, str, str, list[str]]:
    """(main content, body without navigation, everything, all images) of a page as markdown; ``decode`` reads character references in texts."""
    found = events(page or "", decode)
    low, high = main_range(found)
    everything = Renderer(frozenset())
    whole = everything.run(found, 0, len(found))
    return Renderer(NAVIGATION).run(found, low, high), Renderer(NAVIGATION).run(found, 0, len(found)), whole, list(dict.fromkeys(everything.images))


def extracted(pages: DataFrame, html: str = "html", decode: Callable[[str], str] = entities.unescape) -> DataFrame:
    """``pages`` with main, body, everything (markdown) and images (http addresses, each once). Columns of these names are replaced."""
    new = ("main", "body", "everything", "images")
    plain = pages.drop(*new).withColumn("_html", F.col(html).cast("string"))
    kept = [f for f in plain.schema if f.name != "_html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 100):
                part = batch.slice(low, 100)
                found = [renderings(p, decode) for p in part["_html"].to_pylist()]
                columns = [pa.array([f[k] for f in found], pa.list_(pa.string()) if k == 3 else pa.string()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([*[part[f.name] for f in kept], *columns], [*[f.name for f in kept], *new])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return plain.mapInArrow(run, f"{schema + ', ' if kept else ''}main string, body string, everything string, images array<string>")


def cascade(main: Column, body: Column, everything: Column) -> Column:
    """the first rendering that passes the quality gate, with its name; null if none does."""
    def passing(c: Column, name: str) -> Column:
        return F.when(passes_quality_gate(c), F.struct(F.lit(name).alias("method"), c.alias("markdown")))

    return F.coalesce(passing(main, "main"), passing(body, "body"), passing(everything, "everything"))
