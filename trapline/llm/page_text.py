"""Main text of web pages by differencing pages of near urls, with what the markup itself declares.

Pages of a host are ordered by path, and each is paired with the pages of the nearest paths before and
after it. The lines of text of a page and its pair are aligned by their longest common subsequence,
and shared lines are taken for the host's template. What pages declare outranks that: lines of
a declared article stay although another page has them too, and menus, headers, footers, adverts,
forms and comments go although no other page has them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm import tokens
from trapline.llm.tables import kept
from trapline.llm.urls import split_url
from trapline.operators.ordered import next_over_all, ordered_ranges, previous_over_all

# Two pages that share this percentage of the characters of both are versions of one page and say nothing about a template.
VERSIONS = 75

# Elements by their meaning in HTML.
NO_TEXT = {"head", "script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "textarea", "select", "button", "datalist"}
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "search"}
ARTICLE = {"article", "main"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Elements that end where one of the same group begins, as long as no list or table begins between them.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
NESTS = {"ul", "ol", "dl", "table", "menu", "dir"}
# Words of classes, ids and roles that declare an element to be no part of the text.
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent",
    "contentinfo", "cookie", "cookies", "dialog", "disqus", "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices",
    "notification", "pagination", "popup", "promo", "promotion", "related", "respond", "search", "share", "sharing", "sidebar", "skip", "social", "sponsor", "sponsored",
    "subscribe", "toolbar", "widget",
}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|=|/|$)|aria-hidden\s*=\s*[\"']?true", re.I)
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "textarea", "title", "noscript", "iframe")}

OPEN, DECLARED, REJECTED = 0, 1, 2


def _declares(attributes: str) -> bool:
    """The attributes tell that the element is no part of the text."""
    if not attributes or not attributes.strip(" /"):
        return False
    words = {w for m in _NAMED.finditer(attributes) for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", next(x for x in m.groups() if x is not None)).lower())}
    return not NAMES.isdisjoint(words) or _HIDDEN.search(attributes) is not None


def lines_of(page: str) -> list[tuple[str, int]]:
    """The lines of a page in order: text of a block with single spaces, and what its elements declare.

    ``DECLARED`` is in an article, ``REJECTED`` in an element that is none of the text, ``OPEN``
    neither. Elements that hold no text (scripts, styles, form fields) give no lines. End tags may
    be missing. The first article on a page is one wherever it stands but in a menu, an aside or the like.
    """
    lines: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []  # block elements and others that declare something
    text: list[str] = []
    state, articles, at = OPEN, 0, 0

    def end_block() -> None:
        line = " ".join(html.unescape("".join(text)).split()) if text else ""
        if line:
            lines.append((line, state))
        text.clear()

    def close(depth: int) -> int:
        del stack[depth:]
        return stack[-1][1] if stack else OPEN

    while found := _TAG.search(page, at):
        if found.start() > at:
            text.append(page[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if name == "br":
            text.append(" ")
            continue
        if found[1]:  # an end tag
            if name in BLOCK:
                end_block()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    end_block()
                    state = close(depth)
                    break
            continue
        if name in NO_TEXT or name == "title":
            if found[3].endswith("/"):
                continue
            if name in BLOCK or name == "head":
                end_block()
            at = _behind(page, name, at)
            text.append(" ")
            continue
        if name in BLOCK:
            end_block()
            if stack and stack[-1][0] == "p":
                state = close(len(stack) - 1)
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in NESTS:
                    break
                if stack[depth][0] in CLOSES.get(name, ()):
                    state = close(depth)
                    break
        inside = state
        if name in ARTICLE and not _declares(found[3]):
            meant = any(kind in ASIDE for kind, _ in stack)
            inside = DECLARED if state != REJECTED or (articles == 0 and not meant) else REJECTED
            articles += inside == DECLARED
        elif name in ASIDE:
            inside = REJECTED
        elif name in HEADINGS and state == REJECTED and stack and stack[-1][0] == "header" and any(s == DECLARED for _, s in stack):
            inside = DECLARED  # the heading of an article, not of the site
        elif name not in ("html", "body") and state != REJECTED and _declares(found[3]):
            inside = REJECTED
        if name not in VOID and (name in BLOCK or inside != state) and not found[3].endswith("/"):
            if inside != state:
                end_block()
            stack.append((name, inside))
            state = inside
    text.append(page[at:])
    end_block()
    return lines


def _behind(page: str, name: str, at: int) -> int:
    """Where an element without text ends that begins before ``at``; elements of its name may be nested in it."""
    if name in _ENDS:  # what is in there is no markup
        end = _ENDS[name].search(page, at)
        return end.end() if end else len(page)
    depth = 1
    while depth and (found := _TAG.search(page, at)):
        at = found.end()
        inner = (found[2] or "").lower()
        if inner in _ENDS and not found[1]:
            at = _behind(page, inner, at)
        elif inner == name:
            depth += -1 if found[1] else 1
        elif name == "head" and inner == "body" and not found[1]:
            return found.start()  # an unclosed head ends there
    return at if not depth else len(page)


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` with every beginning of ``b`` (len(b) + 1 entries)."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    zeros = full  # a bit of b is 0 where the length grows
    for x in a:
        hit = zeros & places.get(x, 0)
        zeros = ((zeros + hit) | (zeros - hit)) & full
    bits = np.unpackbits(np.frombuffer(zeros.to_bytes(len(b) // 8 + 1, "little"), np.uint8), count=len(b), bitorder="little")
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def shared(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, in memory that is linear in both."""
    if not a or not b:
        return []
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    both = set(a[start : len(a) - end]) & set(b[start : len(b) - end])
    places = [i for i in range(start, len(a) - end) if a[i] in both]
    x, y = [a[i] for i in places], [v for v in b[start : len(b) - end] if v in both]
    found: list[int] = []
    waiting = [(x, y, 0)]
    while waiting:
        x, y, offset = waiting.pop()
        if not x or not y:
            continue
        if len(x) == 1:
            found.extend([offset] if x[0] in y else [])
            continue
        half = len(x) // 2
        cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        waiting += [(x[:half], y[:cut], offset), (x[half:], y[cut:], offset + half)]
    return [*range(start), *sorted(places[i] for i in found), *range(len(a) - end, len(a))]


def template_lines(own: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]], versions: int = VERSIONS) -> list[int]:
    """Numbers of a page's lines (hashes, sizes) that the first of ``others`` shares which isn't a version of it."""
    hashes, sizes = own
    for other, other_sizes in others:
        found = shared(hashes.tolist(), other.tolist())
        common = int(sizes[found].sum())
        if 100 * common < versions * max(int(sizes.sum()), int(other_sizes.sum())):
            return found
    return []


_HASHED = "key long, check long, host string, path string, hashes binary, sizes binary"


def hashed_lines(pages: DataFrame) -> DataFrame:
    """For each row of ``key``, ``check``, ``url`` and ``html`` the host, the path, and hashes and sizes of the page's lines."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, hashes, sizes = [], [], [], []
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                host, path = split_url(url)
                data, offsets = tokens.flat(pa.array([line for line, _ in lines_of(page or "")], pa.large_string()))
                hosts.append(host)
                paths.append(path)
                hashes.append(tokens.span_hashes(data, offsets[:-1], offsets[1:]).tobytes())
                sizes.append(np.diff(offsets).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("check"), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(hashes, pa.binary()), pa.array(sizes, pa.binary())],
                ["key", "check", "host", "path", "hashes", "sizes"],
            )

    return pages.select("key", "check", "url", "html").mapInArrow(read, _HASHED)


def nearest_paths(pages: DataFrame) -> DataFrame:
    """host, path and the pages (``key``, ``check``) of the nearest path and of the other neighbour in order of paths.

    A path stands for its page of the smallest key. The nearer neighbour is the one with the longer
    common beginning, the former one if both are as near.
    """
    own = pages.groupBy("host", "path").agg(F.min(F.struct("key", "check")).alias("page"))
    order = [F.col("host"), F.col("path")]
    ranges = ordered_ranges(own, order)
    value = F.struct("host", "path", "page")
    placed = previous_over_all(next_over_all(ranges, order, value, "after", pinned=True), order, value, "before", pinned=True)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alike = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        for batch in batches:
            near, far = [], []
            for host, path, before, after in zip(*[batch.column(c).to_pylist() for c in ("host", "path", "before", "after")], strict=True):
                there = [p for p in (before, after) if p and p["host"] == host]
                there.sort(key=lambda p: -alike(p["path"], path))
                there = [p["page"] for p in there] + [None, None]
                near.append(there[0])
                far.append(there[1])
            kind = pa.struct([("key", pa.int64()), ("check", pa.int64())])
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("path"), pa.array(near, kind), pa.array(far, kind)], ["host", "path", "near", "far"])

    page = "struct<key: long, check: long>"
    return placed.filter("host <> ''").select("host", "path", "before", "after").mapInArrow(choose, f"host string, path string, near {page}, far {page}")


def shared_lines(pages: DataFrame) -> DataFrame:
    """``key``, ``check`` and ``lines``: the numbers of each different page's lines that belong to a template."""
    lines = kept(hashed_lines(pages).dropDuplicates(["key", "check"]), "lines")
    pairs = lines.join(nearest_paths(lines), ["host", "path"]).filter("near is not null")
    other = lambda c: lines.select(F.struct("key", "check").alias(c), F.col("hashes").alias(f"{c}_hashes"), F.col("sizes").alias(f"{c}_sizes"))
    pairs = pairs.join(other("near"), "near").join(other("far"), "far", "left")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda data, kind: np.frombuffer(data, kind)
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                others = [(read(row[f"{c}_hashes"], np.int64), read(row[f"{c}_sizes"], np.int64)) for c in ("near", "far") if row[f"{c}_hashes"] is not None]
                found.append(template_lines((read(row["hashes"], np.int64), read(row["sizes"], np.int64)), others))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("check"), pa.array(found, pa.list_(pa.int32()))], ["key", "check", "lines"])

    names = ["key", "check", "hashes", "sizes", "near_hashes", "near_sizes", "far_hashes", "far_sizes"]
    return pairs.select(*names).mapInArrow(align, "key long, check long, lines array<int>").filter("size(lines) > 0")


def main_lines(page: str, template: list[int]) -> list[str]:
    """The lines of a page's main text: those of its declared articles, or without one those that are neither rejected nor template."""
    lines = lines_of(page)
    if any(state == DECLARED for _, state in lines):
        return [line for line, state in lines if state == DECLARED]
    gone = set(template)
    return [line for i, (line, state) in enumerate(lines) if state != REJECTED and i not in gone]


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    The text is the article's: lines that the page shares with a page of a near path of its host
    go, unless the markup declares them part of an article; lines in menus, headers, footers,
    asides, forms, adverts, notices and comments go; nothing else goes. Without an article the rest
    stays. Pages that are versions of one another (``VERSIONS`` % in common) delete nothing from each
    other. A null or empty html gives an empty text; pages without a host are in no pair; repeated
    pages and pages of one url each give their row; a page of any length is read whole. No rows: no rows.

    The html of a page is read twice and shuffled once, to meet the numbers of its shared lines.
    """
    keys = {"key": F.xxhash64("url", "html"), "check": F.xxhash64("html", F.lit(1), "url")}
    rows = pages.select("page_id", "url", "html").withColumns(keys)
    deleted = kept(shared_lines(rows), "template")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(main_lines(page or "", gone or [])) for page, gone in zip(batch.column("html").to_pylist(), batch.column("lines").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = rows.join(deleted, ["key", "check"], "left").select("page_id", "url", "html", "lines")
    return joined.mapInArrow(extract, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
