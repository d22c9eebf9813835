"""Main text of web pages, with site templates removed.

Pages are read as a stream of tags and text; open elements lie on a stack. Every container
(nav, header, footer, aside, form, div, section, list, table, …) gets a hash of its whole
subtree: tags, classes and text. Spark counts, per host, on how many different pages each hash
occurs. Containers recurring on many pages of their host are deleted, together with what is
never main text: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments, named by their element, role or class. What is left of the article (or of
the body, if the page marks no article) is returned, block by block.

Inside an article only div, section and aside may be deleted as template: a paragraph that
occurs on many pages there is a copied article. Pages whose main text is the same count as
one, so copies of a page make no template.

A null or empty html has an empty text; a null url belongs to the host ''. Unclosed and
stray tags are tolerated, a cut-off page ends where it ends. Repeated rows are rows. Pages are
held one at a time, whatever their length. Empty tables give an empty result. Other columns,
whatever their names, are passed by.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleroom.functions.ids import pinned
from saleroom.llm.tokens import column, pieces, small_batches

# A template occurs on so many different pages of a host, however many it has.
LEAST_PAGES = 5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|textarea|noscript|iframe|svg|math|template|object|select)\b[^>]*?(?:/>|>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9-]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

_EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Never main text.
_OUT = frozenset("head title nav footer aside form menu dialog button label fieldset".split())
_MAIN = frozenset(("article", "main"))
_BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
_CONTAINER = frozenset("nav header footer aside form menu dialog div section ul ol dl table details center".split())
_INNER = frozenset(("div", "section", "aside"))
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
# Words of a class or id that name something beside the article.
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|notification|alert|popup|modal|overlay"
    r"|menu|nav|navbar|navigation|breadcrumb\w*|sidebar|side|widget|footer|header|masthead|topbar|toolbar|comment|comments|respond|replies|disqus"
    r"|share|sharing|social|related|recommend\w*|newsletter|subscribe|subscription|signup|login|search|pagination|pager|copyright|skip)(?:$|[\s_-])",
    re.I,
)


@dataclass
class _Open:
    tag: str
    out: bool  # beside the article, by itself or through what surrounds it
    main: bool
    container: int  # number of the container, or -1
    at: int  # first token of its subtree
    label: str


@dataclass
class Page:
    """blocks: (text, in the article?, beside the article?, numbers of the containers around it)."""

    blocks: list[tuple[str, bool, bool, tuple[int, ...]]] = field(default_factory=list)
    hashes: list[int] = field(default_factory=list)

    def text(self, templates: frozenset[int] | set[int] = frozenset()) -> str:
        article = any(main and not out for _, main, out, _ in self.blocks)
        dead = {k for k, h in enumerate(self.hashes) if h in templates}
        return "\n\n".join(
            text for text, main, out, inside in self.blocks
            if not out and (main or not article) and not dead.intersection(inside)
        )


def _hash(parts: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def read(source: str | None) -> Page:
    page = Page()
    source = source or ""
    stack: list[_Open] = []
    stream: list[str] = []  # what subtrees are hashed over
    run: list[str] = []  # text of the current block

    def flush() -> None:
        words = " ".join("".join(run).split())
        run.clear()
        if words:
            stream.append(words)
            top = stack[-1] if stack else None
            around = tuple(o.container for o in stack if o.container >= 0)
            page.blocks.append((words, bool(top and top.main), bool(top and top.out), around))

    def close(upto: int) -> None:
        flush()
        while len(stack) > upto:
            o = stack.pop()
            if o.container >= 0:
                page.hashes[o.container] = _hash([o.label, *stream[o.at :]])

    def opened(tag: str, attributes: str) -> None:
        named = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
        label = f"{tag} {named.get('class', '')} {named.get('id', '')}"
        out = (
            tag in _OUT
            or named.get("role", "").lower() in _ROLES
            or "hidden" in named
            or named.get("aria-hidden", "").lower() == "true"
            or bool(_NAMES.search(named.get("class", "")) or _NAMES.search(named.get("id", "")))
        )
        top = stack[-1] if stack else None
        main = tag in _MAIN or named.get("role", "").lower() == "main"
        if main and not out and not (top and top.main):
            # an article ends whatever was left open beside it
            for k, o in enumerate(stack):
                if o.out:
                    close(k)
                    break
            top = stack[-1] if stack else None
        in_main = bool(top and top.main)
        out = out or (tag == "header" and not in_main) or bool(top and top.out)
        container = -1
        if tag in (_INNER if in_main or main else _CONTAINER):
            container = len(page.hashes)
            page.hashes.append(0)
        stream.append("<" + label)
        stack.append(_Open(tag, out, main or in_main, container, len(stream), label))

    at = look = 0
    while (start := source.find("<", look)) >= 0:
        m = _TOKEN.match(source, start)
        if m is None:  # a bare "<" is text
            look = start + 1
            continue
        if start > at:
            run.append(entities.unescape(source[at:start]))
        at = look = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag in _EMPTY:
                run.append(" ")
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    if tag in _BLOCK or any(o.tag in _BLOCK for o in stack[k:]) or stack[k].container >= 0 or stack[k].out:
                        close(k)
                    else:
                        del stack[k]  # an inline element ends; what else is open stays open
                    break
                if stack[k].main and stack[k].tag in _MAIN and tag not in ("body", "html"):
                    break  # nothing outside an article ends inside it
            continue
        if tag in _EMPTY:
            if tag == "hr":
                flush()
            else:
                run.append(" ")
            continue
        if tag in _BLOCK or tag in _OUT:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == "p" or stack[k].tag == tag and tag in ("li", "dt", "dd", "tr"):
                    close(k)
                    break
                if stack[k].tag in _BLOCK:
                    break
            opened(tag, m["attributes"])
        elif tag in ("td", "th"):
            run.append(" ")
        elif _ATTRIBUTE.search(m["attributes"]):
            # an inline element that may be hidden or beside the article
            flush()
            opened(tag, m["attributes"])
    if at < len(source):
        run.append(entities.unescape(source[at:]))
    close(0)
    return page


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def subtrees(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, page, main, subtrees): of each page a hash of its source, one of its main text, and its distinct container hashes."""
    small_batches(pages.sparkSession)
    rows = pages.select(host_of(F.col(url)).alias("host"), F.xxhash64(html).alias("page"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "html"):
                found, mains = [], []
                for source in column(piece, "html").to_pylist():
                    page = read(source)
                    mains.append(_hash([page.text()]))
                    found.append(list(set(page.hashes)))
                yield pa.RecordBatch.from_arrays(
                    [column(piece, "host"), column(piece, "page"), pa.array(mains, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                    ["host", "page", "main", "subtrees"],
                )

    return rows.mapInArrow(run, "host string, page bigint, main bigint, subtrees array<bigint>")


def site_templates(found: DataFrame, least: int = LEAST_PAGES) -> DataFrame:
    """(host, subtree): what recurs on at least `least` different pages of its host; `found` is of subtrees()."""
    on = found.select("host", F.explode("subtrees").alias("subtree"), "main").distinct()
    return on.groupBy("host", "subtree").agg(F.count("*").alias("_on")).where(F.col("_on") >= least).select("host", "subtree")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    found = pinned(subtrees(pages, url, html))
    # each page gets the templates that it has itself, so no list grows with its host
    own = found.select("host", "page", F.explode("subtrees").alias("subtree")).distinct()
    hits = own.join(site_templates(found, least), ["host", "subtree"], "left_semi").groupBy("host", "page").agg(F.collect_list("subtree").alias("templates"))
    rows = (
        pages.select(
            F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"), F.xxhash64(html).alias("page"),
        )
        .join(hits, ["host", "page"], "left").select("page_id", "url", "html", "templates")
    )
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "html"):
                text = [
                    read(source).text(set(templates or ()))
                    for source, templates in zip(column(piece, "html").to_pylist(), column(piece, "templates").to_pylist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [column(piece, "page_id"), column(piece, "url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return rows.mapInArrow(run, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars bigint")
