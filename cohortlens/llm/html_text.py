"""Main text of pages: block lines from the markup, and differencing against the page with the nearest URL.

Each page is cut into text lines (the blocks of its markup). Pages are paired by URL path within their host: with the
next page in path order, else the one before. The lines of the two pages are aligned by a longest common subsequence;
a shared line is template text. Two pages whose shared lines are nearly all of their text are mirrors of one page: they
are not differenced against each other but against the last other page of the host before them, if there is one.

Two things decide what stays. Lines in menus, headers, footers, sidebars, notices, adverts, forms and comments (by
element, or by a word of class, id or role) go. Of the others, lines inside an article or main element stay: they are
the article by markup. All other lines stay if they are not shared with the nearest page.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cohortlens.llm.layout import bounded, neighbour_ranges
from cohortlens.llm.url_filter import host_of, path_of

# Fixed values of HTML: elements without an end tag, elements whose content is no text, elements that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|svg|iframe|object|textarea|title"
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre search section "
                  "select summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold no main text.
APART = frozenset("head nav header footer aside form menu dialog select button search audio video canvas map".split())
LANDMARK = frozenset(["article", "main"])
#: Words of class, id and role that mark such parts.
APART_WORD = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertisements|advertising|banner|breadcrumb|breadcrumbs|"
    r"comment|comments|complementary|consent|contentinfo|cookie|cookies|disqus|footer|gdpr|header|masthead|menu|menubar|"
    r"modal|nav|navbar|navigation|newsletter|notice|notices|notification|popup|promo|promotion|related|reply|replies|"
    r"search|share|sharing|sidebar|sidenav|social|sponsor|sponsored|subscribe|toolbar|widget)(?:$|[\s_-])")
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)[^>]*>?", re.S | re.I)
#: Class words by which an article is none of the page's own, but a reader's comment or a teaser.
OTHER_ARTICLE = frozenset("ad advert advertisement comment comments promo related replies reply sidebar sponsored teaser widget".split())
#: Words of parts that stay apart with the articles inside them.
READERS = re.compile(r"comment|repl(?:y|ies)|disqus|sidebar|related|footer|\bnav|advert|sponsor")
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Share of the text of the shorter page that two pages share if they are mirrors.
MIRROR = 0.8
ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def _marks(attrs: str) -> list[str]:
    """The words of class, id and role, without those that only say what a part has or has not."""
    if not attrs:
        return []
    words = [w for _, a, b, c in ATTR.findall(attrs) for w in (a or b or c).lower().split()]
    return [w for w in words if not w.startswith(("no-", "has-", "with-", "without-"))]


def _apart(name: str, attrs: str, inside: bool) -> bool:
    """Whether an element holds no main text; ``inside`` an article or main element."""
    if name in APART:
        return not (name == "header" and inside)  # an article's own head holds its title
    if name in LANDMARK:
        return any(w in OTHER_ARTICLE for w in _marks(attrs))
    if name in ("body", "html") or name in HEADING:
        return False
    return any(APART_WORD.search(a) for a in _marks(attrs))


def lines_of(page: str) -> list[tuple[str, bool, bool]]:
    """Text blocks of a page in order: (text, apart, inside an article or main element).

    Character references are decoded, white space inside a block is one blank. A start tag closes an open paragraph;
    an end tag closes what is open inside its element; an end tag without a start is ignored; a page that breaks off
    ends all elements.
    """
    out: list[tuple[str, bool, bool]] = []
    stack: list[str] = []
    apart_at: int | None = None  # depth of the outermost element that holds no main text
    lifted: list[tuple[int, int]] = []  # (depth of an article, apart_at around it): the article counts nevertheless
    loose = False  # the part is apart by a word alone, and not by one of readers or other articles
    marks: list[int] = []  # depths of open article and main elements
    text: list[str] = []

    def flush() -> None:
        if text:
            own = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if own:
                out.append((own, apart_at is not None, bool(marks)))

    def close(depth: int) -> None:
        nonlocal apart_at
        del stack[depth:]
        while lifted and lifted[-1][0] >= depth:
            apart_at = lifted.pop()[1]
        if apart_at is not None and apart_at >= depth:
            apart_at = None
        while marks and marks[-1] >= depth:
            marks.pop()

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name = name.lower()
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCK:
            flush()
        if m["end"] or m["end2"]:
            if name in stack:
                close(len(stack) - 1 - stack[::-1].index(name))
            continue
        if name in VOID or (m["attrs"] or "").endswith("/"):
            continue
        if name in BLOCK and "p" in stack:
            close(len(stack) - 1 - stack[::-1].index("p"))
        if name == "body" and "head" in stack:
            close(stack.index("head"))
        attrs = m["attrs"] or ""
        if apart_at is not None and loose and name in LANDMARK and not _apart(name, attrs, bool(marks)):
            lifted.append((len(stack), apart_at))
            apart_at = None
        if apart_at is None and _apart(name, attrs, bool(marks)):
            apart_at = len(stack)
            loose = name not in APART and name not in LANDMARK and not any(READERS.search(a) for a in _marks(attrs))
        elif name in LANDMARK or 'role="main"' in (m["attrs"] or ""):
            marks.append(len(stack))
        stack.append(name)
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


def shared_lines(a: list[str], b: list[str]) -> tuple[set[int], set[int]]:
    """Places of the lines of a longest common subsequence, in ``a`` and in ``b``."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    in_a = set(range(first)) | set(range(len(a) - last, len(a)))
    in_b = set(range(first)) | set(range(len(b) - last, len(b)))
    places: dict[str, list[int]] = {}
    for j in range(len(b) - last - 1, first - 1, -1):
        places.setdefault(b[j], []).append(j)
    # longest increasing subsequence of matching places (Hunt and Szymanski)
    tails: list[int] = []
    nodes: list[tuple] = []
    chain: list[int] = []
    for i in range(first, len(a) - last):
        for j in places.get(a[i], ()):
            k = bisect_left(tails, j)
            nodes.append((i, j, chain[k - 1] if k else -1))
            if k == len(tails):
                tails.append(j)
                chain.append(len(nodes) - 1)
            else:
                tails[k], chain[k] = j, len(nodes) - 1
    at = chain[-1] if chain else -1
    while at >= 0:
        i, j, at = nodes[at]
        in_a.add(i)
        in_b.add(j)
    return in_a, in_b


def main_text(lines: list[tuple[str, bool, bool]], shared: set[int]) -> tuple[str, int]:
    """(main text, number of lines that differencing deleted)."""
    kept = [(i, t, inside) for i, (t, apart, inside) in enumerate(lines) if not apart]
    own = [t for i, t, inside in kept if inside or i not in shared]
    return "\n\n".join(own), len(kept) - len(own)


def mirrors(a: list, b: list, shared: set[int]) -> bool:
    """Whether two pages (lines of :func:`lines_of`; ``shared``: places in ``a``) show the same text: what they share is
    nearly all that the shorter one says outside the parts that hold no main text."""
    own = [sum(len(t) for t, apart, _ in lines if not apart) for lines in (a, b)]
    return sum(len(a[i][0]) for i in shared if not a[i][1]) >= MIRROR * min(own)


def extract(pages: DataFrame, ranges: int, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, url, text, n_chars, n_lines, n_shared (lines shared with the nearest page) and n_deleted (by differencing).

    Null html is empty and gives an empty text. A null url has an empty host and path, and is paired among its like.
    A page that is alone in its host has no pair and loses no line to differencing, nor do mirrors without another page of
    the host before them. Repeated rows have the same text and all stay; equal rows of an Arrow batch move as one. An
    empty table gives no rows; other columns are not read. The lines of each page move once,
    compressed; a host of any size is spread over ranges of its paths.
    """
    def pack(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = Counter(zip(*(c.to_pylist() for c in b.columns), strict=True))
                columns = [*zip(*rows, strict=True)] if rows else [()] * 5
                data = [zlib.compress(json.dumps(lines_of(t or "")).encode(), 1) for t in columns[4]]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(columns[i], b.schema.field(i).type) for i in range(4)), pa.array(data, pa.binary()),
                     pa.array(rows.values(), pa.int64())], names=["host", "path", "key", "url", "data", "copies"])

        return bounded(df).mapInArrow(run, f"host string, path string, key {kind}, url string, data binary, copies bigint")

    src = pages.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(key).alias("key"),
                       F.col(url).alias("url"), F.col(page).alias("html"))
    kind = src.schema["key"].dataType.simpleString()
    dealt = neighbour_ranges(src, ["host", "path", "key"], ranges, pack)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        # rows (range, host, key, url, lines, role, copies, places shared with the row before or None)
        before = after = other = None  # other: the last row of the host that is no mirror of ``before``

        def shared_with(row: tuple, neighbour: tuple) -> tuple[set[int], set[int]]:
            return shared_lines([x[0] for x in row[4]], [x[0] for x in neighbour[4]])

        def done(row: tuple, follower: tuple | None) -> set[int] | None:
            """Judge ``row``; returns the lines that it and its follower share, as places in the follower."""
            nonlocal other
            paired = follower is not None and follower[:2] == row[:2]
            mine, theirs = shared_with(row, follower) if paired else (None, None)
            if paired and mirrors(row[4], follower[4], mine):
                mine = theirs = None
            if row[5] == 0:
                shared = mine if mine is not None else row[7]
                if shared is None and other is not None and other[:2] == row[:2]:
                    shared = shared_with(row, other)[0]
                shared = shared or set()
                text, deleted = main_text(row[4], shared)
                out.extend([(row[2], row[3], text, len(text), len(row[4]), len(shared), deleted)] * row[6])
            if mine is not None or not paired:
                other = row
            return theirs

        for b in batches:
            for host, k, u, data, copies, r, role in zip(
                    *(b.column(n).to_pylist() for n in ("host", "key", "url", "data", "copies", "_range", "_role")), strict=True):
                if role == 2:
                    continue
                after = (r, host, k, u, json.loads(zlib.decompress(data)), role, copies, None)
                if before is not None:
                    after = (*after[:7], done(before, after))
                before = after
                if len(out) >= 1000:
                    yield _out(out)
                    out.clear()
        if before is not None:
            done(before, None)
        if out:
            yield _out(out)

    kinds = [to_arrow_type(src.schema["key"].dataType), pa.string(), pa.string()] + [pa.int64()] * 4
    names = ["key", "url", "text", "n_chars", "n_lines", "n_shared", "n_deleted"]

    def _out(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)],
                                          names=names)

    return dealt.mapInArrow(run, f"key {kind}, url string, text string, n_chars bigint, n_lines bigint, "
                                 "n_shared bigint, n_deleted bigint").withColumnRenamed("key", key)
