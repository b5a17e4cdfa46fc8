"""Main text of pages, with boilerplate found as long strings that many pages of a host share.

A page is cut into blocks of text. Blocks inside menus, headers, footers, sidebars, forms and the like, blocks whose
class or id names an advert, a notice or comments, and on a page with an article all blocks beside it are furniture by
their markup. The tokens of the other blocks, in page order, are the page's stream.

The streams of a host are searched for strings that stand on many of its pages, as a suffix array over their
concatenation would show them: all places with the same next ``WIDTH`` tokens are one group. Groups are found by Spark,
for hosts of any size alike, in two rounds. The first counts the pages of a part of all windows that every page
chooses alike (of ``NEAR`` neighbours, the one with the least hash; outside articles, all). A string of ``LONG`` tokens has such a window in
it, on every page the same. The second counts all windows near the frequent ones. Windows on enough of a host's pages
cover their tokens; covered runs of ``LONG`` tokens go (outside articles, of ``WIDTH``), and what is unique to a page
stays. Prose in an article needs more pages than text without one. Copies of a page don't count for one another.

Defined results: null or empty html gives an empty text; pages without a host in their url (null too) are one host;
unclosed markup ends with the page; pages of any length are read whole; repeated rows stay rows, and being copies, don't
remove each other's text. Further columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import SMALL_ROWS, is_small, written
from .words import WordHashes, lean, longs, mix, pieces, texts, windows

WIDTH = 8  # tokens of a window
NEAR = 8  # windows of which one is chosen in the first round
LONG = WIDTH + NEAR - 1  # tokens of a repeated string in an article that is found on every page
LEAST_PAGES = {"text": 5, "open": 3}  # that share a string, besides copies of the page, in an article and elsewhere
LEAST_SHARE = {"text": 0.5, "open": 0.2}  # of the host's pages

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                   r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.S)
#: Elements whose content isn't markup, or is no text of the page.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
          "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u",
          "var", "wbr", "img", "nobr", "ruby", "rb", "rt", "rp"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "menu", "noscript", "template", "svg",
             "canvas", "object", "audio", "video", "dialog", "head", "script", "style", "textarea", "title", "iframe",
             "fieldset", "datalist", "math", "xmp", "noembed", "noframes"}
CONTENT = {"article", "main"}
#: Words by which a class or id names furniture. Around an article, those of ABOVE only describe the page.
INSIDE = {"comment", "comments", "commentlist", "disqus", "replies", "respond", "related", "recommended", "recommendations"}
ABOVE = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie",
         "cookies", "consent", "gdpr", "notice", "notices", "newsletter", "subscribe", "popup", "modal", "nav", "navbar",
         "navigation", "menu", "sidebar", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "share", "sharing",
         "social", "pagination", "pager", "toolbar", "widget", "login", "signup", "search", "skip"}
#: Words that may follow such a word in a name, and words before it that deny it or only say that there is one.
PARTS = {"area", "bar", "block", "bottom", "box", "buttons", "container", "content", "form", "group", "inner", "item", "items",
         "left", "links", "list", "message", "outer", "panel", "right", "row", "section", "slot", "text", "top", "unit",
         "wrap", "wrapper"}
STATES = {"no", "not", "has", "with", "without", "is", "hide", "show", "js"}
NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "alert", "dialog"}


class Block:
    __slots__ = ("text", "zone", "linked")

    def __init__(self, text: str, zone: str, linked: int):
        self.text, self.zone, self.linked = text, zone, linked  # zone: text, doubtful, open or furniture


def named(names: str) -> str | None:
    """What a class or id says: "inside", "above" or nothing. A name of several words counts if the furniture word
    is its last, or is followed by a part of a page."""
    found = None
    for name in names.split():
        words = [w.lower() for w in NAME_WORD.findall(name) if not w.isdigit()]
        while len(words) > 1 and words[-1] in PARTS:
            words.pop()
        if not words or words[0] in STATES:
            continue
        if words[-1] in INSIDE:
            return "inside"
        if words[-1] in ABOVE:
            found = "above"
    return found


def zone_of(tag: str, attributes: str) -> str | None:
    """"inside": furniture whatever it holds; "above": furniture unless it holds the article; "text"; or nothing."""
    if tag in FURNITURE:
        return "inside"
    if attributes:
        given = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
        if "hidden" in given or given.get("aria-hidden") == "true" or given.get("role", "").lower() in ROLES:
            return "inside"
        if tag not in CONTENT and tag not in ("body", "html"):
            said = {named(given.get("class", "")), named(given.get("id", ""))}
            if said != {None}:
                return "inside" if "inside" in said else "above"
        if given.get("role") in ("main", "article"):
            return "text"
    return "text" if tag in CONTENT else None


def blocks_of(page: str) -> list[Block]:
    """Blocks of a page in order; white space inside a block is one space."""
    out: list[Block] = []
    stack: list[tuple[str, str | None]] = []
    parts: list[str] = []
    linked = links = 0
    zone = "open"

    def end_block() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, zone, linked))
            parts, linked = [], 0

    def current() -> str:
        at = "open"
        for _, z in stack:
            if z == "inside":
                return "furniture"
            if z == "above":
                at = "furniture"
            elif z == "text":
                at = "doubtful" if at in ("furniture", "doubtful") else "text"
        return at

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            piece = m.group()
            if not piece.startswith(("<!", "<?")):
                piece = html.unescape(piece)
                parts.append(piece)
                if links:
                    linked += len(piece.strip())
            elif piece.startswith("<![CDATA["):
                parts.append(piece[9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m.group(1):
            if tag not in INLINE:
                end_block()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if any(t in CONTENT or t in FURNITURE for t, _ in stack[k + 1:]) and tag in INLINE | {"p", "li"}:
                        break  # a stray end tag doesn't close an article
                    links -= sum(t == "a" for t, _ in stack[k:])
                    changed = any(z for _, z in stack[k:])
                    del stack[k:]
                    if changed:
                        end_block()
                        zone = current()
                    break
            continue
        if tag not in INLINE:
            end_block()
        if tag in VOID or m.group(3).endswith("/"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if tag == "p" and stack and stack[-1][0] == "p":
            stack.pop()
        own = zone_of(tag, m.group(3))
        stack.append((tag, own))
        links += tag == "a"
        if own:
            end_block()
            zone = current()
    end_block()
    zones = {b.zone for b in out}
    for b in out:
        if b.zone == "doubtful":  # an article in a sidebar, if there is another; else a name that describes the page
            b.zone = "furniture" if "text" in zones else "text"
        elif b.zone == "open" and zones & {"text", "doubtful"}:
            b.zone = "furniture"  # beside the article
        if b.zone == "text" and 2 * b.linked > len(b.text):
            b.zone = "open"  # mostly links: as if outside
    return [b for b in out if b.zone != "furniture"]


def parsed(pages: DataFrame, page_id: str, url: str, markup: str) -> DataFrame:
    """(page_id, url, host, stream, body, zones): each page's blocks that markup leaves, one a line of ``body`` with
    a letter of ``zones`` (t in an article, else o), and a hash of the body."""
    name = F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.xxhash64(name).alias("host"), F.col(markup).cast("string").alias("html"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            found = [blocks_of(x or "") for x in batch.column("html").to_pylist()]
            bodies = ["\n".join(b.text for b in f) for f in found]
            streams = [xxhash.xxh64_intdigest(b.replace("\n", " ")) for b in bodies]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "url", "host")), pa.array(longs(np.array(streams, np.uint64))),
                 pa.array(bodies, pa.string()), pa.array(["".join(b.zone[0] for b in f) for f in found], pa.string())],
                ["page_id", "url", "host", "stream", "body", "zones"])

    return rows.mapInArrow(lean(task), "page_id bigint, url string, host bigint, stream bigint, body string, zones string")


class Page(NamedTuple):
    host: int
    stream: int
    body: bytes
    zones: str


def pages_of(batch: pa.RecordBatch) -> Iterator[Page]:
    host, stream, zones = (batch.column(c).to_pylist() for c in ("host", "stream", "zones"))
    return map(Page, host, stream, texts(batch.column("body")), zones)


def keys_of(host: int, values: np.ndarray) -> np.ndarray:
    """Names of windows, or of streams, of one host."""
    return mix(values ^ mix(np.array([host & (2 ** 64 - 1)], np.uint64)))


def groups(tokens: np.ndarray, host: int) -> np.ndarray:
    """The name of the window at each token; tokens after the last window have none."""
    return keys_of(host, windows(tokens, WIDTH)) if len(tokens) >= WIDTH else np.zeros(0, np.uint64)


def block_sizes(page: Page) -> list[int]:
    """Tokens of each block."""
    return [x.count(b" ") + 1 for x in page.body.split(b"\n")] if page.zones else []


def outside(page: Page) -> np.ndarray:
    """Which tokens stand outside an article's prose."""
    return np.repeat([z != "t" for z in page.zones], block_sizes(page)).astype(bool)


def chosen(keys: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Places of the windows that are the least of NEAR neighbours, and of all with a token outside an article."""
    if not len(keys):
        return np.zeros(0, int)
    near = min(NEAR, len(keys))
    least = sliding_window_view(keys, near).argmin(axis=1) + np.arange(len(keys) - near + 1)
    return np.union1d(least, np.flatnonzero(sliding_window_view(free, WIDTH).any(axis=1)))


def is_common(pages: np.ndarray, host_pages: np.ndarray, copies: int, zone: str) -> np.ndarray:
    """Whether strings on so many pages of a host are boilerplate for a page that has ``copies``, itself included."""
    others = host_pages - copies
    return pages - copies >= np.maximum(LEAST_PAGES[zone] - 1, LEAST_SHARE[zone] * others)


class Common:
    """name -> (pages that have it, pages of its host)."""

    def __init__(self, keys: np.ndarray, pages: np.ndarray, host_pages: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.pages, self.host_pages = keys[order], pages[order], host_pages[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.ones(len(keys), np.int64)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[place] == keys
        return np.where(known, self.pages[place], 0), np.where(known, self.host_pages[place], 1)


def with_common(rows: DataFrame, common: DataFrame, own_keys, work, schema: str, small_rows: int) -> DataFrame:
    """``rows`` through ``work(batch, table of each row)``. Few names are broadcast; with more, each page is joined
    with those of its own names (``own_keys`` of a row) that are in ``common``."""
    if is_small(common, small_rows):
        table = common.toArrow()
        shipped = rows.sparkSession.sparkContext.broadcast(
            Common(*(table.column(c).to_numpy() for c in ("name", "pages", "host_pages"))))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache = WordHashes()
            for batch in batches:
                yield work(batch, [shipped.value] * batch.num_rows, cache)

        return rows.mapInArrow(lean(task), schema)

    page = F.xxhash64("host", "stream")  # pages with equal streams have equal names

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            found = [longs(np.unique(own_keys(p, cache))) for p in pages_of(batch)]
            place = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([batch.column("page").take(place), pa.array(np.concatenate(found) if found else [],
                                                                                        pa.int64())], ["page", "name"])

    once = rows.withColumn("page", page).dropDuplicates(["page"])
    own = once.mapInArrow(lean(explode), "page bigint, name bigint").join(common, "name") \
        .groupBy("page").agg(F.collect_list(F.struct("name", "pages", "host_pages")).alias("known"))
    wide = rows.withColumn("page", page).join(own, "page", "left")

    def task_wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            tables = [Common(*(np.array([k[c] for k in known or []], np.int64) for c in ("name", "pages", "host_pages")))
                      for known in batch.column("known").to_pylist()]
            yield work(batch, tables, cache)

    return wide.mapInArrow(lean(task_wide), schema)


def page_windows(page: Page, cache: WordHashes) -> np.ndarray:
    return groups(cache.of(page.body.split()), page.host)


def all_names(page: Page, cache: WordHashes) -> np.ndarray:
    return np.append(page_windows(page, cache), keys_of(page.host, np.array([page.stream], np.int64).view(np.uint64)))


def names_batch(batch: pa.RecordBatch, found: list[np.ndarray]) -> pa.RecordBatch:
    """(host, name): each window of a page once."""
    found = [np.unique(f) for f in found]
    place = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
    flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return pa.RecordBatch.from_arrays([batch.column("host").take(place), pa.array(longs(flat))], ["host", "name"])


def counted(names: DataFrame, hosts: DataFrame) -> DataFrame:
    """(name, pages, host_pages) of the windows on enough pages of their host to matter anywhere."""
    enough = F.greatest(F.lit(float(min(LEAST_PAGES.values()))), min(LEAST_SHARE.values()) * F.col("host_pages"))
    counts = names.groupBy("host", "name").agg(F.count("*").alias("pages"))
    counts = counts.where(F.col("pages") >= min(LEAST_PAGES.values()))
    return counts.join(hosts, "host").where(F.col("pages") >= enough).select("name", "pages", "host_pages")


def common_windows(rows: DataFrame, small_rows: int = SMALL_ROWS) -> DataFrame:
    """(name, pages, host_pages) of the frequent windows of every host, and of the streams that have copies."""
    hosts = rows.groupBy("host").agg(F.count("*").alias("host_pages"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            found = []
            for page in pages_of(batch):
                keys = page_windows(page, cache)
                found.append(keys[chosen(keys, outside(page))])
            yield names_batch(batch, found)

    first = written(counted(rows.mapInArrow(lean(choose), "host bigint, name bigint"), hosts), "page-windows")

    def around(batch: pa.RecordBatch, tables: list[Common], cache: WordHashes) -> pa.RecordBatch:
        found = []
        for page, table in zip(pages_of(batch), tables):
            keys = page_windows(page, cache)
            hit = table.find(longs(keys))[0] > 0
            edge = np.zeros(len(keys) + 1, np.int64)
            at = np.flatnonzero(hit)
            np.add.at(edge, np.maximum(at - NEAR, 0), 1)
            np.add.at(edge, np.minimum(at + NEAR + 1, len(keys)), -1)
            found.append(keys[np.cumsum(edge[:-1]) > 0])
        return names_batch(batch, found)

    near = with_common(rows, first, page_windows, around, "host bigint, name bigint", small_rows)

    def named_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, stream = (batch.column(c).to_numpy().view(np.uint64) for c in ("host", "stream"))
            yield pa.RecordBatch.from_arrays([pa.array(longs(mix(stream ^ mix(host)))), batch.column("pages"),
                                              batch.column("host_pages")], ["name", "pages", "host_pages"])

    copies = rows.groupBy("host", "stream").agg(F.count("*").alias("pages")).where("pages > 1").join(hosts, "host")
    return counted(near, hosts).unionByName(
        copies.mapInArrow(named_streams, "name bigint, pages bigint, host_pages bigint"))


def kept_text(page: Page, keys: np.ndarray, table: Common, copies: int) -> bytes:
    """The blocks without covered runs; a token is judged by the rule of its block's zone. Of a block that a run only
    touches, a part shorter than a run must be stays."""
    pages, host_pages = table.find(longs(keys))
    if not (pages > copies).any():
        return page.body.replace(b"\n", b" ")
    words = page.body.split()
    free = outside(page)
    stops = np.cumsum(block_sizes(page))
    starts = np.append(0, stops[:-1])
    gone = np.zeros(len(words), bool)
    for zone, mine, least in (("text", ~free, LONG), ("open", free, WIDTH)):
        at = np.flatnonzero(is_common(pages, host_pages, copies, zone) & (pages > 0))
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WIDTH, -1)
        covered = np.cumsum(edge[:-1]) > 0
        bounds = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]])))
        for a, b in zip(bounds[::2], bounds[1::2]):
            if b - a < least:
                continue
            first = np.searchsorted(starts, a, side="right") - 1
            for start, stop in zip(starts[first:], stops[first:]):  # the blocks that the run touches
                if start >= b:
                    break
                low, high = max(a, start), min(b, stop)
                if high - low >= least or (low, high) == (start, stop):
                    gone[low:high] |= mine[low:high]
    return b" ".join(w for w, g in zip(words, gone) if not g)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html", text: str = "text",
            small_rows: int = SMALL_ROWS) -> DataFrame:
    """(page_id, url, text) of every page."""
    rows = written(parsed(pages, page_id, url, markup), "pages", "zstd")
    common = written(common_windows(rows, small_rows), "page-strings")

    def clean(batch: pa.RecordBatch, tables: list[Common], cache: WordHashes) -> pa.RecordBatch:
        out = []
        for page, table in zip(pages_of(batch), tables):
            names = all_names(page, cache)
            copies = max(1, int(table.find(longs(names[-1:]))[0][0]))
            out.append(kept_text(page, names[:-1], table, copies))
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"),
                                           pa.array(out, pa.binary()).cast(pa.string())],
                                          ["page_id", "url", text])

    return with_common(rows, common, all_names, clean, f"page_id bigint, url string, `{text}` string", small_rows)
