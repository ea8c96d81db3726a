"""Main text of web pages by consensus host paths.

1. Every page's containers are scored: text of their blocks, less the text of links, a part
   of it also for the containers around them. A container's path is the chain of generalised
   tag and class names above it (class names lower-cased, digits as 0, sorted). The best one
   gives way to the article or main element around it, and to its parent where containers
   beside it hold a fifth of its score or more: an article in several parts is one article.
2. Each page votes for its best path; votes are counted per host in Spark, partial counts
   first, so a host of any size is one row a task.
3. Pages are extracted anew: all blocks under the host's highest-ranked winning path that the
   page has; pages without one use their own best container. A host has PATHS_PER_HOST winning
   paths at most, each with LEAST_SHARE of its votes; pages of rarer layouts stand alone.

Left out everywhere: scripts, styles, forms, menus, footers, sidebars, adverts and comments, by
element and by class or id names; headers and notices outside article and main elements. A name
counts if it, its last part (`site-nav`) or its first part before words of mere structure
(`ad-slot`) says so; `share-price` and `no-sidebar` do not. The names of html, body, main and
article elements never count.

A page is read once from left to right. Containers are numbers in a tree, open elements are
found by tables of their last places, and a tag that never ends is text, so time and memory
follow the length of the page, however deep or broken it is.

Defined cases: null and empty html give an empty text; unclosed and misnested tags are closed
as browsers do for paragraphs and list items, or where an outer element ends; after a quote that
never closes, quotes are not heeded; of containers with equal scores the first counts, of paths
with equal votes the one with the higher summed score, then the last by name; a null url is the
host ''; pages with equal ids are extracted one by one; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged

#: Hosts whose winning paths may be broadcast; more are joined by shuffle.
BROADCAST_HOSTS = 100_000
PATHS_PER_HOST = 3
LEAST_SHARE = 0.1
#: Score of a container beside the best one, as a share of it, from which both count.
BESIDE = 0.2

NAME = re.compile(r"/?([A-Za-z][A-Za-z0-9:-]*)")
STOP = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<=\s)(hidden)(?=\s|/|$)")
# Elements by what they do in HTML.
RAW = {"script", "style", "textarea", "xmp", "noscript", "template", "iframe", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
LEAF = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "blockquote", "td", "th", "figcaption", "caption", "ul", "ol", "dl", "table", "tbody", "thead", "tr", "figure"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SCOPE = {"article", "section", "div", "main", "td", "th", "table", "body", "aside", "nav", "footer", "header", "form"}
NEVER = {"script", "style", "noscript", "template", "iframe", "nav", "footer", "aside", "form", "button", "select", "option", "head", "title", "svg", "object", "noframes", "textarea", "menu", "dialog", "input"}
NEVER_NAMES = {"ad", "ads", "advert", "advertisement", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "popup", "promo", "related", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
OUTSIDE_NAMES = {"banner", "header", "masthead", "notice"}
STRUCTURE = {"area", "bar", "block", "box", "button", "buttons", "container", "content", "form", "group", "holder", "inner", "item", "items", "left", "link", "links", "list", "notice", "banner", "outer", "panel", "popup", "right", "row", "section", "slot", "top", "bottom", "unit", "wrap", "wrapper", "zone"}
NEGATING = {"no", "not", "has", "have", "with", "without", "is", "hide", "show"}
ROLES = {"complementary", "contentinfo", "search", "dialog", "alert", "navigation", "banner", "menu", "toolbar"}
WHOLE = {"html", "body", "main", "article"}
MAIN = {"article": 1.5, "main": 1.3}


def names_never(value: str, words: set[str]) -> bool:
    """Whether any class or id name of an attribute value stands for one of the words."""
    for name in value.split():
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        if parts and parts[0] not in NEGATING and (parts[-1] in words or (parts[0] in words and all(x in STRUCTURE for x in parts[1:]))):
            return True
    return False


def read_attributes(attributes: str) -> tuple[str, bool, bool]:
    """(generalised classes, whether its names are left out everywhere, or outside articles)."""
    classes, never, outside = "", False, False
    for name, a, b, c, hidden in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            never |= names_never(value, NEVER_NAMES)
            outside |= names_never(value, OUTSIDE_NAMES)
        if name == "class":
            classes = ".".join(sorted({re.sub(r"\d+", "0", x).replace("/", "_") for x in value.split()}))
        never |= bool(hidden) or name == "hidden" or name == "role" and value in ROLES
    return classes, never, outside


class Page:
    """Blocks of a page, each (container, text, characters in links); containers are a tree."""

    def __init__(self, source: str | None):
        self.names: list[str] = [""]
        self.parents: list[int] = [-1]
        self.blocks: list[tuple[int, str, int]] = []
        self._child: dict[tuple[int, str], int] = {}
        self._read(source or "")

    def _container(self, parent: int, name: str) -> int:
        key = parent, name
        if key not in self._child:
            self._child[key] = len(self.names)
            self.names.append(name)
            self.parents.append(parent)
        return self._child[key]

    def _read(self, s: str) -> None:
        # open elements: tag, container, left out, inside an article; where each tag was last opened
        stack: list[tuple[str, int, bool, bool]] = []
        last: dict[str, list[int]] = {}
        scopes: list[int] = []
        text: list[str] = []
        linked = in_link = 0

        def flush() -> None:
            nonlocal linked
            if text:
                joined = " ".join("".join(text).split())
                if joined and not (stack and stack[-1][2]):
                    self.blocks.append((stack[-1][1] if stack else 0, joined, min(linked, len(joined))))
                text.clear()
                linked = 0

        def pop() -> None:
            nonlocal in_link
            tag = stack[-1][0]
            if tag not in INLINE:
                flush()
            in_link -= tag == "a"
            stack.pop()
            last[tag].pop()
            if tag in SCOPE:
                scopes.pop()

        def add(raw: str) -> None:
            nonlocal linked
            if raw and not (stack and stack[-1][2]):
                plain = entities.unescape(raw)
                text.append(plain)
                if in_link > 0:
                    linked += len(plain.strip())

        def newest(tag: str) -> int:
            return last[tag][-1] if last.get(tag) else -1

        def close(tag: str, stop: int) -> None:
            """Close the newest open tag and all inside it, if it is not outside of place stop."""
            k = newest(tag)
            if k >= 0 and k >= stop:
                while len(stack) > k:
                    pop()

        def scope() -> int:
            return scopes[-1] if scopes else -1

        at, ends, quotes = 0, -1, True  # ends: place of the first '>' from here on, -2 if none is left
        n = len(s)
        while at < n:
            start = s.find("<", at)
            if start < 0:
                add(s[at:])
                break
            if s.startswith("<!--", start):
                add(s[at:start])
                end = s.find("-->", start + 4)
                at = n if end < 0 else end + 3
                continue
            if s.startswith("<![CDATA[", start):
                add(s[at:start])
                end = s.find("]]>", start + 9)
                add(entities.escape(s[start + 9 : n if end < 0 else end]))
                at = n if end < 0 else end + 3
                continue
            if ends != -2 and ends <= start:
                ends = s.find(">", start)
                if ends < 0:
                    ends = -2
            if ends == -2:  # no tag ends from here on
                add(s[at:])
                break
            if s.startswith(("<!", "<?"), start):
                add(s[at:start])
                at = ends + 1
                continue
            m = NAME.match(s, start + 1)
            if not m:
                add(s[at : start + 1])
                at = start + 1
                continue
            add(s[at:start])
            end = ends
            if quotes and (stop := STOP.search(s, m.end())) and stop[0] != ">":
                end = -1
                while stop:
                    if stop[0] == ">":
                        end = stop.start()
                        break
                    to = stop.end()
                    if s[m.end() : stop.start()].rstrip()[-1:] == "=" if stop.start() - m.end() < 64 else s[stop.start() - 64 : stop.start()].rstrip()[-1:] == "=":
                        to = s.find(stop[0], to) + 1
                        if to == 0:
                            break
                    stop = STOP.search(s, to)
                if end < 0:
                    quotes, end = False, ends
            tag, closing, attributes = m[1].lower(), s[start + 1] == "/", s[m.end() : end]
            at = end + 1
            if closing:
                if tag == "br":
                    text.append(" ")
                elif last.get(tag):
                    close(tag, -1 if tag in SCOPE else scope())
                elif tag not in INLINE:
                    flush()
                continue
            if tag == "br":
                text.append(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    close("p", scope())
                    flush()
                continue
            if tag in CLOSES_P:
                close("p", scope())
            if tag == "li":
                close("li", max(newest("ul"), newest("ol"), scope()))
            elif tag in ("dt", "dd"):
                for t in ("dt", "dd"):
                    close(t, max(newest("dl"), scope()))
            elif tag in ("td", "th", "tr"):
                for t in ("td", "th", "tr") if tag == "tr" else ("td", "th"):
                    close(t, newest("table"))
            elif tag == "body":
                close("head", -1)
            if tag not in INLINE:
                flush()
            classes, never, outside = read_attributes(attributes) if attributes else ("", False, False)
            up = stack[-1] if stack else ("", 0, False, False)
            if tag in WHOLE:
                never = outside = False
            # headings and notices inside the article belong to it
            never = up[2] or never or tag in NEVER or ((outside or tag == "header") and not up[3])
            where = up[1]
            if tag not in INLINE and tag not in LEAF and not never:
                where = self._container(where, f"{tag}{'.' + classes if classes else ''}")
            if tag in RAW:
                close_tag = re.compile(rf"</{tag}\s*>", re.I).search(s, at)
                at = close_tag.end() if close_tag else n
                continue
            if attributes.endswith("/") and tag in ("svg", "path"):
                continue
            last.setdefault(tag, []).append(len(stack))
            if tag in SCOPE:
                scopes.append(len(stack))
            stack.append((tag, where, never, up[3] or tag in MAIN))
            in_link += tag == "a"
        while stack:
            pop()
        flush()

    def tag(self, k: int) -> str:
        return self.names[k].split(".", 1)[0]

    def path(self, k: int) -> str:
        up = []
        while k > 0:
            up.append(self.names[k])
            k = self.parents[k]
        return "".join(f"/{x}" for x in reversed(up))

    def find(self, path: str) -> int | None:
        """The container with a path."""
        k: int | None = 0
        for name in path.split("/")[1:]:
            k = self._child.get((k, name))
            if k is None:
                return None
        return k

    def best(self) -> tuple[int, float]:
        """The container of the main text and its score."""
        score, below = [0.0] * len(self.names), [0.0] * len(self.names)
        for where, text, linked in self.blocks:
            worth, part = max(0.0, len(text) - 2.0 * linked), 1.0
            below[where] += worth
            while where >= 0 and part > 0.1:
                score[where] += worth * part
                where, part = self.parents[where], part * 0.6
        for k in range(len(score) - 1, 0, -1):  # parents come before their children
            score[k] *= MAIN.get(self.tag(k), 1.0)
            below[self.parents[k]] += below[k]
        top = max(range(len(score)), key=lambda k: (score[k], -k))
        best, found = top, score[top]
        k = self.parents[top]
        while k > 0:
            if self.tag(k) in MAIN:
                best = k
            k = self.parents[k]
        # parts beside the best one: what its parent holds apart from it
        while best == top and (up := self.parents[best]) > 0 and self.tag(up) not in WHOLE and below[up] - below[best] >= BESIDE * below[best] > 0:
            top = best = up
        return best, found

    def text(self, k: int) -> str:
        """All blocks in or below a container, in page order."""
        under = [False] * len(self.names)
        for i in range(len(under)):
            under[i] = i == k or i > 0 and under[self.parents[i]]
        return "\n".join(t for where, t, _ in self.blocks if under[where])


def host_of(url) -> object:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        best = []
        for h in batch.column("html").to_pylist():
            page = Page(h)
            k, score = page.best()
            best.append((page.path(k), score))
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([p for p, _ in best], pa.string()), pa.array([s for _, s in best], pa.float64())], names=["host", "path", "score"])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): the winning paths of each host, the most voted first."""
    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_votes, "host string, path string, score double")
    counts = votes.where("score > 0").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.round("score")).alias("score"))
    ranked = counts.groupBy("host").agg(F.sum("n").alias("all"), F.sort_array(F.collect_list(F.struct("n", "score", "path")), asc=False).alias("of"))
    won = F.filter("of", lambda x: x["n"] >= F.col("all") * LEAST_SHARE)
    return ranked.select("host", F.slice(F.transform(won, lambda x: x["path"]), 1, PATHS_PER_HOST).alias("paths"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, used = [], []
        for source, paths in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True):
            page = Page(source)
            k = next((k for p in paths or () if (k := page.find(p)) is not None), None)
            text = page.text(k) if k is not None else ""
            if not text:
                k = page.best()[0]
                text = page.text(k)
            texts.append(text)
            used.append(page.path(k))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(used, pa.string())],
            names=["page_id", "url", "text", "n_chars", "path"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and the path used, for every page."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    paths = staged(host_paths(rows), "host_paths")
    small = paths.count() <= BROADCAST_HOSTS
    joined = rows.withColumn("host", host_of(F.col("url"))).join(F.broadcast(paths) if small else paths, "host", "left")
    return joined.select("page_id", "url", "html", "paths").mapInArrow(_extract, "page_id long, url string, text string, n_chars long, path string")
