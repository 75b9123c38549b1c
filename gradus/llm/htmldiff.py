"""Main text of web pages by differencing each page against the nearest URL of its host.

Pages of a host are put in the order of their URL path. A page's text lines are aligned with those of the neighbour
that shares the longer path prefix by their longest common subsequence, and lines that both have are template, not
content. Markup tells most of the template before that: lines within navigation, headers, footers, sidebars, notices,
adverts, forms and comments never count. Lines within the page's article are kept when a neighbour has them too,
since copies of an article are not template.
"""
from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gradus.llm.text import mix, prefix_hash, span_hash
from gradus.session import shuffle_partitions, written

# Element names of HTML and words that name template parts in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "canvas", "select", "option")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
TEMPLATE_TAGS = frozenset("head nav footer aside form button menu dialog fieldset".split())
TEMPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side "
    "aside footer header masthead notice notices cookie cookies consent gdpr popup modal newsletter subscribe signup share sharing social related "
    "recommended comment comments respond disqus reply replies widget toolbar pagination pager skip search login alert complementary contentinfo "
    "dialog form hidden".split())
MAIN_TAGS = frozenset(("article", "main"))
MAIN_WORDS = frozenset("article main content post entry story articlebody".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?", re.S)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|$)", re.I) for t in RAW}
BLANK = re.compile(r"\s+")
PARTS = re.compile(r"[a-z]+")

TEMPLATE, PLAIN, ARTICLE = 0, 1, 2


def _marks(text: str) -> tuple[set[str], bool]:
    """Words of class, id and role, and whether the element is hidden."""
    words, hidden = set(), False
    for name, a, b, c in ATTRIBUTE.findall(text):
        name = name.lower()
        if name in ("class", "id", "role"):
            words |= set(PARTS.findall(html.unescape(a or b or c).lower()))
        elif name == "hidden" or name == "aria-hidden" and (a or b or c).lower() == "true" or name == "style" and "display:none" in (a or b or c).replace(" ", "").lower():
            hidden = True
    return words, hidden


def lines(page: str) -> list[tuple[str, int]]:
    """Text lines of a page in order, each with its zone (TEMPLATE, PLAIN or ARTICLE).

    Character references are decoded, white space within a line becomes one space. Elements that end no line: INLINE.
    Broken markup is read as browsers read it: an unclosed element ends with its parent.
    """
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []  # element and zone inside it
    zone, parts, at, n = PLAIN, [], 0, len(page)

    def end_line() -> None:
        if parts:
            text = BLANK.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((text, zone))
            parts.clear()

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            parts.append(page[at:])
            break
        if lt > at:
            parts.append(page[at:lt])
        m = TOKEN.match(page, lt)
        if not m:
            parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), -1)
            if k < 0:
                if name not in INLINE:
                    end_line()
                continue
            before = stack[k - 1][1] if k else PLAIN
            if name not in INLINE or before != zone or any(t not in INLINE for t, _ in stack[k:]):
                end_line()
            del stack[k:]
            zone = before
            continue
        if name in RAW_END and not m[3].rstrip().endswith("/"):
            end = RAW_END[name].search(page, at)
            at = end.start() if end else n
            if end:
                close = page.find(">", at)
                at = close + 1 if close >= 0 else n
            if name not in INLINE:
                end_line()
            continue
        if name not in INLINE:
            end_line()
        if name in VOID:
            if name == "br":
                end_line()
            continue
        if name in ("p", "li", "dd", "dt", "tr", "td", "th"):  # an open one of the same kind ends here
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name or stack[k][0] not in INLINE), -1)
            if k >= 0 and stack[k][0] == name:
                zone = stack[k - 1][1] if k else PLAIN
                del stack[k:]
        words, hidden = _marks(m[3]) if m[3] else (set(), False)
        inner = zone
        if zone != TEMPLATE:
            own_header = name == "header" and zone == ARTICLE
            if name in MAIN_TAGS or zone == PLAIN and name not in ("html", "body") and words & MAIN_WORDS and not words & TEMPLATE_WORDS:
                inner = ARTICLE
            if hidden or name in TEMPLATE_TAGS or name == "header" and not own_header or words & TEMPLATE_WORDS and name not in ("html", "body"):
                inner = TEMPLATE
        if inner != zone:
            end_line()
        stack.append((name, inner))
        zone = inner
    end_line()
    return out


def aligned(a: list[int], b: list[int]) -> list[int]:
    """Positions in `a` of a longest common subsequence of two number sequences, by bit-parallel rows."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    same = [*range(lo), *range(len(a) - hi, len(a))]
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    shared = set(a) & set(b)
    mine = [i for i, x in enumerate(a) if x in shared]
    theirs = [x for x in b if x in shared]
    if not mine or not theirs:
        return sorted(same)
    where: dict[int, int] = {}
    for k, i in enumerate(mine):
        where[a[i]] = where.get(a[i], 0) | 1 << k
    full = (1 << len(mine)) - 1
    row, rows = full, [full]
    for x in theirs:
        hit = row & where[x]
        row = ((row + hit) | (row & ~hit)) & full
        rows.append(row)
    # a zero at bit k of rows[j]: the subsequence of mine[: k + 1] and theirs[: j] is longer than that of mine[: k]
    k, j, found = len(mine) - 1, len(theirs), []
    while k >= 0 and j > 0:
        if rows[j] >> k & 1:
            k -= 1
        elif not rows[j - 1] >> k & 1:
            j -= 1
        else:
            found.append(mine[k] + lo)
            k, j = k - 1, j - 1
    return sorted(same + found)


def line_numbers(texts: list[str]) -> list[int]:
    """64-bit hashes of lines."""
    raws = [t.encode() for t in texts]
    ends = np.cumsum([len(r) for r in raws])
    prefix = prefix_hash(np.frombuffer(b"".join(raws), np.uint8))
    start = ends - [len(r) for r in raws]
    return mix(span_hash(prefix, start, ends)).view(np.int64).tolist() if raws else []


NUMBERED = "page_id bigint, url string, row bigint, numbers array<bigint>"
EXTRACTED = "page_id bigint, url string, near_id bigint, text string, n_chars bigint"


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers = [line_numbers([t for t, _ in lines(h or "")]) for h in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(numbers, pa.list_(pa.int64()))], names=["page_id", "url", "row", "numbers"])


def main_text(found: list[tuple[str, int]], near: list[int]) -> str:
    """The page's own lines: those of its article, or on a page without one those that its neighbour lacks."""
    shared = set(aligned(line_numbers([t for t, _ in found]), near))
    zone = ARTICLE if any(z == ARTICLE for _, z in found) else PLAIN
    return " ".join(t for i, (t, z) in enumerate(found) if z == zone and (zone == ARTICLE or i not in shared))


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        page_id, url, near_id, page, near = batch.columns
        texts = [main_text(lines(h or ""), n or []) for h, n in zip(page.to_pylist(), near.to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [page_id, url, near_id, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "near_id", "text", "n_chars"])


def host_and_path(url: str) -> tuple[Column, Column]:
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def nearest(pages: DataFrame) -> DataFrame:
    """(row, near): for each row id the row of the page next to it by path within its host, where it has one.

    Keys alone are sorted, in ranges; a range's first and last page stand in a small table, one row a range, which
    gives the ranges' ends their neighbours. No host's pages meet in one task.
    """
    host, path = host_and_path("url")
    n = shuffle_partitions(pages.sparkSession)
    keys = pages.select(host.alias("host"), path.alias("path"), "row").repartitionByRange(n, "host", "path", "row").withColumn("range", F.spark_partition_id())
    keys = written(keys.select("range", F.struct("host", "path", "row").alias("key")), "keys")
    ends = keys.groupBy("range").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    line = W.orderBy("range")
    ends = ends.select("range", F.lag("last").over(line).alias("before"), F.lead("first").over(line).alias("after"))
    inside = W.partitionBy("range").orderBy("key")
    keys = keys.withColumns({"prev": F.lag("key").over(inside), "next": F.lead("key").over(inside)}).join(ends, "range")
    keys = keys.select("key", F.coalesce("prev", "before").alias("prev"), F.coalesce("next", "after").alias("next"))
    same = lambda c: F.col(c).isNotNull() & (F.col(f"{c}.host") == F.col("key.host"))
    split = lambda p: F.split(F.col(f"{p}.path"), "/")
    depth = lambda c: F.aggregate(F.zip_with(split(c), split("key"), lambda a, b: F.coalesce(a == b, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct(F.when(s["on"] & e, s["n"] + 1).otherwise(s["n"]).alias("n"), (s["on"] & e).alias("on")))["n"]
    pick = F.when(same("prev") & same("next"), F.when(depth("next") > depth("prev"), F.col("next.row")).otherwise(F.col("prev.row")))
    pick = F.coalesce(pick, F.when(same("prev"), F.col("prev.row")), F.when(same("next"), F.col("next.row")))
    return keys.select(F.col("key.row").alias("row"), pick.alias("near"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, near_id, text, n_chars) for every row of `pages`.

    A null or empty html has an empty text. Rows are told apart by a hash of all three columns, so pages with equal
    ids or urls are fine, and equal rows are each other's neighbours but keep their article. A null url is a host of
    its own, a page alone on its host has no neighbour. Columns other than page_id, url and html are not read.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.xxhash64("page_id", "url", "html").alias("row"), "html")
    numbered = written(rows.mapInArrow(_number, NUMBERED), "lines")
    near = nearest(numbered.select("url", "row").distinct())
    others = numbered.select(F.col("row").alias("near"), F.col("page_id").alias("near_id"), "numbers").dropDuplicates(["near"])
    pairs = near.join(others, "near", "left").select("row", "near_id", "numbers")
    return rows.join(pairs, "row", "left").select("page_id", "url", "near_id", "html", "numbers").mapInArrow(_difference, EXTRACTED)
