"""Main text of web pages: page structure, and differencing against the nearest page of the host.

A page is read into lines, one for each block (paragraph, heading, list item, cell ...). Every page is differenced: pages
of a host are ordered by URL path, each page is paired with the neighbour whose path has the longer beginning in common,
all lines of the two are aligned by longest common subsequence, and the shared lines are deleted. A pair that is the same
page twice (four fifths of the lines shared that their elements keep) proves nothing about menus; then the neighbour on
the other side is taken. Lines inside a marked article are never deleted by differencing, since articles may quote the
same passages. Of the lines left, those in menus, headers, footers, sidebars, notices, adverts, forms, scripts and
comments go by their elements. If the page marks its article, the article's lines are the text, unless differencing
against another page leaves more text of the page's own outside it: then the mark is on a teaser, and both are the text.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Collection, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.functions import arrow_udf

from lumenframe.llm.common import stored, structs, texts_of

#: Shares of lines, in hundredths, from which a pair counts as the same page.
SAME_PAGE_PERCENT = 80

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)"""
    r"""(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)|(?P<text>[^<]+|<)""", re.S)
#: Elements whose content is not text of the page; their content is skipped up to the end tag.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "select", "button",
       "canvas", "audio", "video", "xmp", "noembed", "noframes", "datalist"}
#: Elements that hold blocks and are kept track of.
CONTAINERS = {"html", "head", "body", "article", "main", "section", "div", "nav", "header", "footer", "aside", "form", "ul", "ol",
              "dl", "table", "blockquote", "figure", "fieldset", "dialog", "details", "menu", "search", "hgroup", "address", "center"}
BOILERPLATE = {"head", "nav", "footer", "aside", "form", "dialog", "menu", "search", "fieldset"}
#: Elements that start and end a block.
BLOCKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption",
                       "pre", "hr", "figcaption", "summary", "legend", "option", "optgroup"}
#: Words in a class, id or role that mark boilerplate.
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
         "cookie", "cookies", "consent", "gdpr", "notice", "notices", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb",
         "breadcrumbs", "footer", "comment", "comments", "reply", "replies", "social", "share", "sharing", "related", "newsletter",
         "subscribe", "subscription", "popup", "modal", "overlay", "skip", "pagination", "pager", "toolbar", "login", "signup",
         "widget", "complementary", "contentinfo", "search", "alert", "disclaimer", "masthead", "topbar", "byline-share"}
ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""", re.S)


def _marked(name: str, rest: str) -> bool:
    if not rest.strip():
        return False
    for key, *values in ATTRIBUTE.findall(rest):
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id", "role"):
            words = re.split(r"[^a-z0-9]+", value)
            if not MARKS.isdisjoint(words) and name not in ("html", "body", "article", "main"):
                return True
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def all_lines(page: str) -> list[tuple[str, bool, bool]]:
    """The page's lines, with whether they are in the marked article, and whether their elements keep them."""
    out: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool]] = []  # open containers, and whether their lines are dropped
    article = 0
    drop_block = False

    def flush() -> None:
        nonlocal drop_block
        if parts:
            line = " ".join(entities.unescape("".join(parts)).split())
            if line:
                out.append((line, article > 0, not drop_block and not (stack and stack[-1][1])))
            parts.clear()
        drop_block = False

    at, end = 0, len(page)
    while at < end:
        token = TOKEN.match(page, at)
        at = token.end()
        text = token["text"]
        if text is not None:
            parts.append(text)
            continue
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if token["end"]:
            if name in BLOCKS:
                flush()
            if name in CONTAINERS:
                # An end tag closes its element, but not beyond the article that it stands in.
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        article -= sum(n in ("article", "main") for n, _ in stack[k:])
                        del stack[k:]
                        break
                    if stack[k][0] in ("article", "main"):
                        break
            continue
        rest = token["rest"] or ""
        if name in RAW:
            if not rest.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = close.end() if close else (end if name in ("script", "style", "textarea", "title") else at)
            parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
            if name in CONTAINERS:
                if name == "body":
                    stack.clear()
                    article = 0
                in_article = name in ("article", "main")
                dropped = bool(stack) and stack[-1][1]
                if in_article and not article:
                    dropped = False  # a menu before it was left open
                dropped = dropped or name in BOILERPLATE or name == "header" and not article or _marked(name, rest)
                article += in_article
                stack.append((name, dropped))
            else:
                drop_block = _marked(name, rest)
        elif name in ("br", "img", "wbr", "input"):
            parts.append("" if name == "wbr" else " ")
    flush()
    return out


def _chosen(lines: list[tuple[str, bool, bool]], gone: frozenset[int]) -> tuple[list[str], bool]:
    """The lines of the text, and whether they are the marked article's alone; ``gone`` are places of shared lines."""
    lines = [(line, article) for k, (line, article, kept) in enumerate(lines) if kept and (article or k not in gone)]
    inside = [line for line, article in lines if article]
    # Only where a page with other text shares lines is the rest known to be the page's own.
    teaser = gone and 2 * sum(map(len, inside)) < sum(len(line) for line, _ in lines)
    return (inside, True) if inside and not teaser else ([line for line, _ in lines], False)


def split_lines(page: str) -> tuple[list[str], bool]:
    """The lines that may be the text, and whether the page marks its article."""
    return _chosen(all_lines(page), frozenset())


def _common_lengths(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Length of a longest common subsequence of all rows with each beginning of the columns, in one row of memory."""
    length = np.zeros(len(columns) + 1, dtype=np.int32)
    for line in rows:
        np.maximum.accumulate(np.maximum(length[1:], length[:-1] + (columns == line)), out=length[1:])
    return length


def _aligned(rows: np.ndarray, columns: np.ndarray) -> list[int]:
    """Places in ``rows`` of a longest common subsequence with ``columns``, in memory linear in both.

    The rows are halved; the columns are cut where the lengths of the two halves add up to the most.
    """
    places: list[int] = []
    work = [(0, len(rows), 0, len(columns))]
    while work:
        low, high, left, right = work.pop()
        if low == high or left == right:
            continue
        if high - low == 1:
            if (columns[left:right] == rows[low]).any():
                places.append(low)
            continue
        middle = (low + high) // 2
        part = columns[left:right]
        total = _common_lengths(rows[low:middle], part) + _common_lengths(rows[middle:high][::-1], part[::-1])[::-1]
        cut = left + int(total.argmax())
        work += [(middle, high, cut, right), (low, middle, left, cut)]
    return places


def common_lines(own: list[int], other: list[int]) -> list[int]:
    """Places in ``own`` of a longest common subsequence with ``other``."""
    head = 0
    while head < min(len(own), len(other)) and own[head] == other[head]:
        head += 1
    tail = 0
    while tail < min(len(own), len(other)) - head and own[-1 - tail] == other[-1 - tail]:
        tail += 1
    a, b = own[head : len(own) - tail], other[head : len(other) - tail]
    # Only lines that both have can match; they are numbered, so that any value of a line can be compared.
    number = {line: k for k, line in enumerate(set(a) & set(b))}
    rows = [k for k, line in enumerate(a) if line in number]
    columns = np.array([number[line] for line in b if line in number], dtype=np.int64)
    aligned = _aligned(np.array([number[a[k]] for k in rows], dtype=np.int64), columns)
    return [*range(head), *(head + rows[k] for k in aligned), *range(len(own) - tail, len(own))]


def same_page(places: list[int], judged: Collection[int]) -> bool:
    """Whether the shared ``places`` hold four fifths of those that are judged."""
    return 100 * len(set(judged).intersection(places)) >= SAME_PAGE_PERCENT * len(judged)


def shared_lines(own: list[int], other: list[int]) -> list[int]:
    """Places in ``own`` of a longest common subsequence with ``other``; none if the two are the same page."""
    places = common_lines(own, other)
    return [] if same_page(places, range(len(own))) else places


def _address(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        hosts, paths = [], []
        for url in texts_of(batch):
            try:
                parts = urlsplit(url)
                host, path = (parts.hostname or "").removeprefix("www."), parts.path
            except ValueError:
                host, path = "", url
            hosts.append(host), paths.append(path)
        yield structs(host=pa.array(hosts, pa.string()), path=pa.array(paths, pa.string()))


def _hashed_lines(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Hashes of all lines of the page, and the places of those that its elements keep."""
    for batch in batches:
        lines, kept = [], []
        for page in texts_of(batch):
            own = all_lines(page)
            lines.append([zlib.crc32(t.encode()) | zlib.adler32(t.encode()) << 31 for t, _, _ in own])
            kept.append([k for k, (_, _, stays) in enumerate(own) if stays])
        yield structs(lines=pa.array(lines, pa.list_(pa.int64())), kept=pa.array(kept, pa.list_(pa.int32())))


def _neighbours(light: DataFrame) -> DataFrame:
    """Each row of (key, host, path, lines, kept) with the rows before and after it in its host, by path and key.

    Rows are sorted in ranges, numbered in each, and joined to the next number; the ends of the ranges, two rows each,
    are matched up separately, so no host has to meet in one task.
    """
    ranged = light.repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key")
    ranged = stored(ranged.withColumn("at", F.monotonically_increasing_id()), "pages")
    part = F.shiftrightunsigned(F.col("at"), 33)
    ends = ranged.groupBy(part.alias("part")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    bridges = ends.select(F.col("last").alias("at"), F.lead("first").over(Window.orderBy("part")).alias("next"))
    ranged = stored(ranged.join(F.broadcast(bridges), "at", "left").withColumn("next", F.coalesce("next", F.col("at") + 1)), "ordered")
    side = lambda name: [F.col("host").alias(f"{name}_host"), F.col("path").alias(f"{name}_path"), F.col("lines").alias(f"{name}_lines")]
    after = ranged.select(F.col("at").alias("next"), *side("after"))
    before = ranged.select(F.col("next").alias("at"), *side("before"))
    return ranged.join(after, "next", "left").join(before, "at", "left")


def _deletions(rows: DataFrame) -> DataFrame:
    @arrow_udf("array<int>")
    def shared(path: pa.Array, own: pa.Array, kept: pa.Array, *sides: pa.Array) -> pa.Array:
        out = []
        for p, lines, judged, bp, bl, ap, al in zip(*(c.to_pylist() for c in (path, own, kept, *sides))):
            alike = lambda q, p=p: -1 if q is None else next((k for k, (x, y) in enumerate(zip(p, q)) if x != y), min(len(p), len(q)))
            gone: list[int] = []
            for other in (bl, al) if alike(bp) >= alike(ap) else (al, bl):
                places = common_lines(lines, other or [])
                if other and not same_page(places, judged):
                    gone = places
                    break
            out.append(gone)
        return pa.array(out, pa.list_(pa.int32()))

    same = lambda name, c: F.when(F.col(f"{name}_host") == F.col("host"), F.col(f"{name}_{c}"))
    found = rows.select("key", "path", "lines", "kept", *[same(n, c).alias(f"{n}_{c}") for n in ("before", "after") for c in ("path", "lines")])
    deleted = found.select("key", shared("path", "lines", "kept", "before_path", "before_lines", "after_path", "after_lines").alias("deleted"))
    return deleted.where(F.size("deleted") > 0).groupBy("key").agg(F.min("deleted").alias("deleted"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The id, url, text, n_chars and n_shared of every row.

    ``text`` has a line for each block, with character references decoded and white space runs as one space. A null or
    empty page has the empty text. A null or unreadable URL counts as a host without a name. Rows equal in id, URL and
    page share one verdict. ``n_shared`` counts the lines that differencing deletes: outside the article, and shared with
    the nearest page of the host. Only the named columns are read; an empty table gives an empty result.
    """
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(url_col), F.col(html_col))
    address = arrow_udf(_address, "struct<host:string,path:string>")
    hashed_lines = arrow_udf(_hashed_lines, "struct<lines:array<long>,kept:array<int>>")
    light = pages.select(key.alias("key"), address(F.col(url_col)).alias("a"), hashed_lines(F.col(html_col)).alias("o")).select(
        "key", "a.host", "a.path", "o.lines", "o.kept")
    deletions = stored(_deletions(_neighbours(light)), "deletions")

    @arrow_udf("struct<text:string,n_shared:long>")
    def text_of(html: pa.Array, deleted: pa.Array) -> pa.Array:
        texts, counts = [], []
        for page, places in zip(texts_of(html), deleted):
            lines, gone = all_lines(page), frozenset(places.as_py() or ())
            texts.append("\n".join(_chosen(lines, gone)[0]))
            counts.append(sum(not lines[k][1] for k in gone))
        return structs(text=pa.array(texts, pa.string()), n_shared=pa.array(counts, pa.int64()))

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), key.alias("key"))
    rows = rows.join(deletions, "key", "left").select("id", "url", text_of("html", "deleted").alias("t"))
    return rows.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "t.text", F.length("t.text").cast("long").alias("n_chars"), "t.n_shared")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of pages."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
