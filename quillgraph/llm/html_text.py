"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text that stands directly in them, less what is link text. The page votes for the
generalised path (tags and classes, digits left out) of the article that its best one is part of. Votes are counted by host in Spark. Every
page is then read again with its host's winning path; a page that has no such container uses its own best one.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.sources.scratch import Scratch, small
from quillgraph.llm.textbytes import mapped

#: Winning paths are sent to all executors only up to so many hosts (of at most MOST_PATH letters each).
BROADCAST_HOSTS, MOST_PATH = 100_000, 400
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.S)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg annotation annotation-xml xmp noembed noframes".split())
_NEVER = frozenset("head nav aside footer form button select option menu dialog label fieldset canvas object audio video".split()) | _RAW
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img math semantics mrow mi mn mo ms mtext mspace mstyle msub msup msubsup mfrac msqrt mroot mover munder munderover mfenced".split())
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot table ul ol dl pre blockquote figure figcaption caption address hr summary details".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
_STOPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tr": {"table"}}
_BAD = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adbox|banner|promo|promotion|sponsor(?:ed)?|sidebar|side|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|topbar|footer|foot|cookies?|consent|notice|gdpr|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|comments?|disqus|replies|respond|reader-comments|widget|tags?|pager|pagination|skip|toolbar|hidden)(?:$|[\s_-])", re.I)
#: Within an article a name is held against an element only if all its parts are such words or these.
_PARTS = frozenset("box bar list section block container wrapper wrap links link posts post articles article stories area content inner outer unit slot top bottom left right main site page global primary secondary buttons button icons icon form items item group panel module holder region thread policy message title heading media network toggle more this us and of the in by".split())
_ENTRY = re.compile(r"[.-](?:article|post|entry|story)(?:$|[.-])")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_MAIN = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main|body|text)(?:$|[\s_-])", re.I)


class Page:
    """The blocks of a page in order: (container number, text, letters in links), and each container's path and parents."""

    def __init__(self, source: str):
        self.paths: list[str] = [""]
        self.tags: list[str] = [""]
        self.parents: list[int] = [0]
        self.hints: list[float] = [0.0]
        self.blocks: list[tuple[int, str, int]] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        # open elements: tag, container, left out?, link?, within an article?
        stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
        buffer: list[str] = []
        linked = 0
        at, end = 0, len(source)

        def flush() -> None:
            nonlocal linked
            if buffer:
                text = " ".join("".join(buffer).split())
                if text:
                    self.blocks.append((stack[-1][1], text, min(linked, len(text))))
                buffer.clear()
            linked = 0

        def add(piece: str) -> None:
            nonlocal linked
            top = stack[-1]
            if piece and not top[2]:
                piece = entities.unescape(piece)
                buffer.append(piece)
                if top[3]:
                    linked += len(piece)

        while at < end:
            m = _TOKEN.search(source, at)
            if m is None:
                add(source[at:])
                break
            add(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<![CDATA["):
                    add(m[0][9:].removesuffix("]]>"))
                continue
            tag = m[2].lower()
            if m[1]:
                place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
                if tag in _INLINE and any(stack[i][0] not in _INLINE for i in range(place + 1, len(stack))):
                    continue  # a stray end of an inline element does not close blocks
                if place:
                    if any(stack[i][0] not in _INLINE for i in range(place, len(stack))):
                        flush()
                    del stack[place:]
                elif tag == "p":
                    flush()
                continue
            if tag == "br" or tag == "wbr":
                if tag == "br":
                    add(" ")
                continue
            if tag not in _INLINE:
                flush()
            for closed in _CLOSES.get(tag, {"p"} if tag not in _INLINE else ()):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == closed:
                        del stack[i:]
                        break
                    if stack[i][0] in _STOPS.get(tag, ()) or (closed == "p" and stack[i][0] not in _INLINE and tag not in _INLINE):
                        break
            if tag in _VOID:
                continue
            if tag in _RAW:
                close = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                at = close.end() if close else end
                continue
            top = stack[-1]
            if m[0].endswith("/>") and tag not in _INLINE and tag not in _LEAF and tag not in {"div", "section", "article", "main"}:
                continue
            if tag in _INLINE:
                stack.append((tag, top[1], top[2], top[3] or tag == "a", top[4]))
                continue
            name, hint, out = _judge(tag, m[3] or "", top[4])
            container = top[1]
            if tag not in _LEAF:
                container = len(self.paths)
                self.paths.append(_below(self.paths[top[1]], name))
                self.tags.append("entry" if tag not in {"article", "main"} and hint > 0 and _ENTRY.search(name) else tag)
                self.parents.append(top[1])
                self.hints.append(hint)
            stack.append((tag, container, top[2] or out, top[3], top[4] or tag in {"article", "main"} or (hint > 0 and _ENTRY.search(name) is not None)))
        flush()

    def best(self) -> int:
        """The container with the highest score: what its own blocks weigh, and half of what its children's do; the first of equals. Only those with a block in them or in a child are looked at."""
        own = [0.0] * len(self.paths)
        held = {container for container, _, _ in self.blocks}
        held |= {self.parents[i] for i in held}
        for container, text, linked in self.blocks:
            plain = len(text) - 2 * linked
            own[container] += plain if plain < 0 else plain * (1.0 if len(text) >= 40 or text[-1:] in ".!?…。" else 0.5)
        score = own[:]
        for i in range(len(own) - 1, 0, -1):
            score[self.parents[i]] += 0.5 * own[i]
        return max(sorted(held), key=lambda i: (score[i] * (1 + self.hints[i]), -i))

    def whole(self, best: int) -> int:
        """The container of the article that a container is part of: the outermost article element around it.

        Without one, the outermost main or entry around it, unless what that adds is mostly link text. Without a main,
        then its ancestors as far as they add only blocks that stand in them directly or in their header, not mostly link text.
        """
        chain = [best]  # outwards
        while chain[-1]:
            chain.append(self.parents[chain[-1]])
        articles = [i for i in chain if self.tags[i] == "article"]
        if articles:
            return articles[-1]
        level = {i: k for k, i in enumerate(chain)}
        at = [0] * len(self.paths)  # the innermost container of the chain that each one is in, by its place there
        direct = [True] * len(self.paths)
        for i in range(len(at)):
            if i in level:
                at[i] = level[i]
            else:
                up = self.parents[i]
                at[i] = at[up]
                direct[i] = direct[up] and (up not in level or self.tags[i] in {"header", "hgroup"})
        size, links, plain = [0] * len(chain), [0] * len(chain), [True] * len(chain)
        for container, text, linked in self.blocks:
            k = at[container]
            size[k] += len(text)
            links[k] += linked
            plain[k] = plain[k] and direct[container]
        start, more, more_links = 0, 0, 0
        for k, i in enumerate(chain):
            if k:
                more, more_links = more + size[k], more_links + links[k]
            if self.tags[i] in {"main", "entry"} and 2 * more_links <= more:
                start = k
        out = chain[start]
        for k in range(start + 1, len(chain) if self.tags[out] != "main" else 0):
            if size[k]:
                if not plain[k] or 2 * links[k] > size[k]:
                    break
                out = chain[k]
        return out

    def path(self) -> str | None:
        """The path this page votes for; none, if it has no text."""
        return self.paths[self.whole(self.best())] if self.blocks else None

    def text(self, path: str | None) -> str:
        """The blocks of all containers with this path (of one only: of the article around it) and of what is inside them; of the page's best one, if there is none."""
        roots = {i for i, p in enumerate(self.paths) if p == path} if path is not None else set()
        if len(roots) == 1:  # this page's article may hold more than its host's others
            roots = {self.whole(*roots)}
        found = self._within(roots)
        return "\n".join(found if found or not self.blocks else self._within({self.whole(self.best())}))

    def _within(self, roots: set[int]) -> list[str]:
        inside = [i in roots for i in range(len(self.paths))]
        for i in range(1, len(inside)):
            inside[i] = inside[i] or inside[self.parents[i]]
        return [text for container, text, _ in self.blocks if inside[container]]


def _below(parent: str, name: str) -> str:
    """The path of an element inside parent. One of more than MOST_PATH letters is told by a digest of the whole, so that different paths stay different."""
    path = f"{parent}>{name}"
    return path if len(path) <= MOST_PATH else "#" + hashlib.md5(path.encode("utf-8", "surrogatepass")).hexdigest()


@lru_cache(maxsize=4096)
def _judge(tag: str, attributes: str, in_article: bool) -> tuple[str, float, bool]:
    """An element's generalised name, how much its names speak for it, and whether it is left out."""
    known = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    classes = sorted({re.sub(r"\d+", "", c).strip("-_") for c in known.get("class", "").lower().split()} - {""})
    names = f"{known.get('class', '')} {known.get('id', '')}"
    out = tag in _NEVER or (tag == "header" and not in_article) or known.get("role", "").lower() in _ROLES or known.get("aria-hidden") == "true" or re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes) is not None or "display:none" in known.get("style", "").replace(" ", "").lower()
    if not out and tag not in {"html", "body", "article", "main"}:
        out = any(map(_only_bad, names.split())) if in_article else _BAD.search(names) is not None
    hint = {"article": 1.0, "main": 0.6, "body": 0.0}.get(tag, 0.5 if _MAIN.search(names) else 0.0)
    return ".".join([tag, *classes]), hint, out


def _only_bad(name: str) -> bool:
    """Is this name made of words for what is no part of an article, as related-posts is and related-work is not?"""
    parts = [p for p in re.split(r"[-_\d]+", name.lower()) if p]
    bad = [_BAD.search(p) is not None for p in parts]
    return _BAD.search(name.lower()) is not None and any(bad) and all(b or p in _PARTS for b, p in zip(bad, parts))


def host_of(url: str | None) -> str | None:
    """The part of a URL between // and the next /, ? or #, in lower case, without user and port; null if there is none."""
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m[1].lower() if m else None


def _votes(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            paths = [Page(h).path() if h else None for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([host_of(u) for u in part.column("url").to_pylist()], pa.string()), pa.array(paths, pa.string())], names=["host", "path"])


def _extract(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            texts = [Page(h).text(p) if h else "" for h, p in zip(part.column("html").to_pylist(), part.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars for each row.

    Blocks of the main container in page order, joined by line feeds; white space inside a block is one space. Menus,
    headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out. Null or empty
    html: empty text. Pages whose URL is null or has no host use their own best container. Of paths with equal votes,
    the first in code-point order wins (of long ones, by their digests). No rows: no rows. Other columns are dropped.
    """
    host = F.lower(F.nullif(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    votes = pages.select("url", "html").transform(mapped, _votes, "host string, path string").where("host IS NOT NULL AND path IS NOT NULL")
    counted = votes.groupBy("host", "path").count()
    won = counted.groupBy("host").agg(F.min(F.struct((-F.col("count")).alias("n"), "path")).alias("w")).select(F.col("host").alias("_host"), F.col("w.path").alias("path"))
    won = Scratch(spark, "paths").table(won)
    if small(won, BROADCAST_HOSTS):
        won = F.broadcast(won)
    rows = pages.select("page_id", "url", "html", host.alias("_of")).join(won, F.col("_of") == F.col("_host"), "left")
    return rows.select("page_id", "url", "html", "path").transform(mapped, _extract, "page_id long, url string, text string, n_chars long")
