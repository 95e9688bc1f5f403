"""Main text of web pages: block parsing and nearest-URL page differencing.

1. A page is cut into blocks: the text between block-level tags, character references
   decoded, white space turned into one space. Blocks inside menus, headers, footers,
   sidebars, notices, adverts, forms, comments and the like (by element, role, class or
   id) are dropped, and so are scripts, styles and markup. All blocks left are candidates;
   those inside an ``article`` or ``main`` carry the number of that region, the innermost one.
2. Pages are sorted by (host, path) and dealt to buckets by sampled splitters, so that
   neighbours in the path order of a host meet. A page is compared with the ``NEIGHBOURS``
   pages before and after it on its host, those first whose paths share the longer prefix.
3. The lines of two pages are aligned by longest common subsequence, for every page. On pages
   without regions, shared lines are template text: they are deleted, except where the two
   pages are copies (most of the larger text is shared): a copied article is no template.
   After a copy, or a page that has little but shared text, the next neighbour is asked.
   Where all neighbours look like copies, but at least two of them, at other paths, have text
   of their own as the page has, the lines that all of these share are template text.
   On pages with regions, the alignment decides which regions are the page's own: a region that
   two neighbours at other paths hold whole, and that are no copies of the page, is a teaser or
   notice of the site. The own regions are returned whole. Where no region is the page's own, its
   text outside of them that no neighbour shares is returned if it is the longer text, else all regions.

Buckets are read in order, a few pages at a time, so a host with a third of all pages is
spread over many buckets and none is held whole. Splitters depend on the pages alone; the
pages at the edges of a bucket are also sent to its neighbours, so that the text of a page
does not depend on the splitters.

The alignment deletes no single lines of a region, because equal paragraphs of two articles
are no template, and the article is to be returned whole.

Defined cases: null or empty html gives an empty text; a null or unparsable url has an
empty host and path; rows that repeat wholly are paired like others; truncated tags at the
end of a page are dropped; very long pages are read whole, at a cost that does not depend on how often
their lines repeat or how many tags they leave open; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import bisect
import html
import math
import re
from collections import deque
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table

SAMPLE_PAGES = 20_000
PAGES_PER_BUCKET = 2_000
COPY_SHARE = 0.8
NEIGHBOURS = 4             # pages on either side that a page may be compared with

#: fixed values: element names and the words of classes, ids and roles
_DROP = frozenset("nav footer aside form script style noscript template iframe button select textarea svg dialog menu "
                  "head title object embed canvas audio video map datalist fieldset".split())
_RAW = frozenset("script style textarea title noscript iframe template".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table "
                   "tbody td tfoot th thead title tr ul option legend caption".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_WORDS = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs masthead footer sidebar aside ad ads advert "
                   "adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice notices popup "
                   "modal newsletter subscribe share sharing social related recommended comment comments disqus respond replies "
                   "widget toolbar pagination pager login signup search skip".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
                  r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z!?/][^>]*\Z", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_PARTS = re.compile(r"[a-z0-9]+")


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(text)}


def _is_template(name: str, attrs: dict[str, str], in_article: bool) -> bool:
    if name in _DROP or (name == "header" and not in_article):
        return True
    if not attrs or name in ("body", "html", "article", "main"):
        return False
    if attrs.get("role") in _ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if "display:none" in attrs.get("style", "").replace(" ", ""):
        return True
    words = _PARTS.findall(attrs.get("class", "") + " " + attrs.get("id", ""))
    return not _WORDS.isdisjoint(words)


def blocks(page: str) -> tuple[list[str], bool]:
    """(the blocks inside regions, or all candidates where there are none, in page order; whether there are regions)."""
    lines, regions = marked_blocks(page)
    inside = [x for x, r in zip(lines, regions) if r]
    return (inside, True) if inside else (lines, False)


def marked_blocks(page: str) -> tuple[list[str], list[int]]:
    """(candidate blocks in page order, the number of the article or main each stands in, from 1; 0 outside of all)."""
    lines: list[str] = []
    regions: list[int] = []
    stack: list[tuple[str, bool, bool]] = []       # name, opens template text, opens an article
    opened: dict[str, int] = {}                    # how often a name is on the stack
    articles: list[int] = []                       # numbers of the articles on the stack
    dropped = found = 0
    text: list[str] = []
    at, n = 0, len(page)

    def close() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if line:
                lines.append(line)
                regions.append(articles[-1] if articles else 0)

    def leave(name: str) -> None:
        nonlocal dropped
        while stack:
            x = stack.pop()
            opened[x[0]] -= 1
            dropped -= x[1]
            if x[2]:
                articles.pop()
            if x[0] == name:
                break

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            if not dropped:
                text.append(page[at:])
            break
        if not dropped and m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name in _BLOCK:
                close()
            if opened.get(name):
                leave(name)
            continue
        if name in _BLOCK:
            close()
        elif name == "br" and not dropped:
            text.append(" ")
        raw_attrs = m[3] or m[6] or ""
        if name in _VOID or raw_attrs.endswith("/") and name not in _BLOCK:
            continue
        if name == "p" and stack and any(x[0] == "p" for x in stack[-3:]):
            leave("p")
        attrs = _attributes(raw_attrs) if raw_attrs.strip() else {}
        if name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        drop = _is_template(name, attrs, bool(articles))
        article = not drop and not dropped and (name in ("article", "main") or attrs.get("role") == "main"
                                                or attrs.get("itemprop") == "articlebody")
        stack.append((name, drop, article))
        opened[name] = opened.get(name, 0) + 1
        dropped += drop
        if article:
            found += 1
            articles.append(found)
    close()
    return lines, regions


def place(url: str | None) -> tuple[str, str]:
    """(host, path) of a url; empty where there is none."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").removeprefix("www."), parts.path.rstrip("/")
    except ValueError:
        return "", ""


def common_subsequence(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence as index pairs (matches in increasing order of both).

    One row of the table of lengths is one integer, with a bit for each line of ``b`` where the length does not
    grow. Only about every root of the rows is kept; the rows between are made again on the way back, so that
    memory grows with the root of a page's lines times the other page's, and repeated lines cost no more than others.
    """
    n, m, k = len(a), len(b), 0
    while k < min(n, m) and a[k] == b[k]:
        k += 1
    tail = 0
    while tail < min(n, m) - k and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    both = set(a[k:n - tail]) & set(b[k:m - tail])
    rows = [i for i in range(k, n - tail) if a[i] in both]
    cols = [j for j in range(k, m - tail) if b[j] in both]
    places = {line: bytearray(len(cols) // 8 + 1) for line in both}
    for x, j in enumerate(cols):
        places[b[j]][x >> 3] |= 1 << (x & 7)
    match = {line: int.from_bytes(v, "little") for line, v in places.items()}
    full = (1 << len(cols)) - 1

    def below(v: int, i: int) -> int:
        same = v & match[a[rows[i]]]
        return (v + same | v - same) & full

    step = math.isqrt(len(rows)) + 1
    kept = [full]                     # the row before every step-th one
    v = full
    for i in range(len(rows)):
        v = below(v, i)
        if (i + 1) % step == 0:
            kept.append(v)
    middle: list[tuple[int, int]] = []
    end = len(cols)
    for start in range((len(kept) - 1) * step, -1, -step):
        block = [kept[start // step]]
        for i in range(start, min(start + step, len(rows))):
            block.append(below(block[-1], i))
        for i in range(len(block) - 1, 0, -1):
            end = (~block[i] & (1 << end) - 1).bit_length()   # the last place where the length grows
            if not end:
                break
            if block[i - 1] >> (end - 1) & 1:                 # it does not without this line: a match
                end -= 1
                middle.append((rows[start + i - 1], cols[end]))
        if not end:
            break
    return [(i, i) for i in range(k)] + middle[::-1] + [(n - t, m - t) for t in range(tail, 0, -1)]


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def nearest(here: tuple, before: list[tuple], after: list[tuple]) -> list[tuple]:
    """Neighbours on the same host, longest shared prefix of the path first, then the closer one, then the earlier one."""
    found = [(-_prefix(x[1], here[1]), d, side, x) for side, part in ((0, before[::-1]), (1, after))
             for d, x in enumerate(part) if x[0] == here[0]]
    return [x[3] for x in sorted(found, key=lambda x: x[:3])]


def without_shared(path: str, lines: list[str], others: list[tuple[str, list[str]]]) -> list[str]:
    """Lines that the nearest page (of others: path, lines) does not share, copies aside."""
    total = sum(map(len, lines))
    gone: set[int] = set()
    alike = []
    for place_of, other in others:
        shared = common_subsequence(lines, other)
        size, theirs = sum(len(lines[i]) for i, _ in shared), sum(map(len, other))
        if size >= COPY_SHARE * max(1, total, theirs):
            if place_of != path and len(shared) < min(len(lines), len(other)):
                alike.append((place_of, other, {i for i, _ in shared}))
            continue
        gone.update(i for i, _ in shared)
        if size < COPY_SHARE * theirs:
            break
    else:
        if len({p for p, _, _ in alike}) > 1 and any(o != alike[0][1] for _, o, _ in alike):
            gone |= set.intersection(*(i for _, _, i in alike))
    return [x for i, x in enumerate(lines) if i not in gone]


def own_text(path: str, lines: list[str], regions: list[int], others: list[tuple[str, list[str], list[int]]]) -> list[str]:
    """Lines of a page's own text (others: path, lines, regions; nearest first)."""
    inside = [x for x, r in zip(lines, regions) if r]
    if not inside:
        return without_shared(path, lines, [(p, [x for x, r in zip(o, rs) if r] or o) for p, o, rs in others])
    total = sum(map(len, lines))
    gone: set[int] = set()
    held: dict[int, set[str]] = {r: set() for r in regions if r}       # region -> paths of the pages that hold it whole
    for place_of, other, _ in others:
        shared = {i for i, _ in common_subsequence(lines, other)} if place_of != path else set()
        if not shared or sum(len(lines[i]) for i in shared) >= COPY_SHARE * max(total, sum(map(len, other))):
            continue
        gone |= shared
        for r in held.keys() - {r for i, r in enumerate(regions) if i not in shared}:
            held[r].add(place_of)
    own = {r for r, paths in held.items() if len(paths) < 2}
    if own:
        return [x for x, r in zip(lines, regions) if r in own]
    rest = [x for i, (x, r) in enumerate(zip(lines, regions)) if not r and i not in gone]
    return rest if sum(map(len, rest)) > sum(map(len, inside)) else inside


def neighbourhoods(rows: Iterator[tuple], k: int) -> Iterator[tuple]:
    """Each row with the k rows before it and the k rows after it."""
    before: deque = deque(maxlen=k)
    ahead: deque = deque()
    for row in rows:
        ahead.append(row)
        if len(ahead) > k:
            here = ahead.popleft()
            yield here, list(before), list(ahead)
            before.append(here)
    while ahead:
        here = ahead.popleft()
        yield here, list(before), list(ahead)
        before.append(here)


def splitters(pages: DataFrame, id_col: str, url_col: str) -> list[tuple[str, str]]:
    """Places that cut a bounded sample of the urls into equal parts; the same for the same pages."""
    n = pages.count()
    buckets = max(1, min(SAMPLE_PAGES // 2, n // PAGES_PER_BUCKET))
    # about SAMPLE_PAGES rows by hash, never more than twice as many
    some = pages.filter(F.pmod(F.xxhash64(url_col, id_col), F.lit(max(1, -(-n // SAMPLE_PAGES)))) == 0)
    at = sorted(place(r[0]) for r in some.select(F.col(url_col).cast("string")).limit(2 * SAMPLE_PAGES).collect())
    return [at[len(at) * i // buckets] for i in range(1, buckets)] if at else []


def guests(light: DataFrame, cuts: list[tuple[str, str]], id_type: str) -> dict[tuple, list[int]]:
    """(host, path, id, url) of pages near a splitter -> the other buckets that they are sent to; urls alone are read."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [place(u) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([bisect.bisect_right(cuts, p) for p in at], pa.int32()), pa.array([p[0] for p in at], pa.string()),
                 pa.array([p[1] for p in at], pa.string()), batch.column(0), batch.column(1)],
                names=["bucket", "host", "path", "_id", "url"])

    if not cuts:
        return {}
    order = ["host", "path", "_id", "url"]
    dealt = light.mapInArrow(deal, f"bucket int, host string, path string, _id {id_type}, url string")
    ends: list[dict[int, list[tuple]]] = []
    for way in ([F.asc(c) for c in order], [F.desc(c) for c in order]):
        place_in = F.row_number().over(Window.partitionBy("bucket").orderBy(*way))
        found: dict[int, list[tuple]] = {}
        # NEIGHBOURS pages a bucket
        for r in dealt.withColumn("_r", place_in).filter(F.col("_r") <= NEIGHBOURS).orderBy("bucket", "_r").collect():
            found.setdefault(r.bucket, []).append((r.host, r.path, r._id, r.url))
        ends.append(found)
    first, last = ends
    out: dict[tuple, list[int]] = {}
    for rows, buckets in ((last, sorted(last)), (first, sorted(first, reverse=True))):
        near: list[tuple] = []                    # the nearest pages of the buckets passed, nearest first
        for b in buckets:
            for x in near:
                if b not in out.setdefault(x, []):
                    out[x].append(b)
            near = (rows[b] + near)[:NEIGHBOURS]
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(_id, url, text) of every page."""
    cuts = splitters(pages, id_col, url_col)
    id_type = pages.schema[id_col].dataType.simpleString()
    id_type = id_type if id_type in ("bigint", "int") else "string"
    names = ["bucket", "host", "path", "_id", "url", "lines", "regions", "guest"]
    light = pages.select(F.col(id_col).cast(id_type).alias("_id"), F.col(url_col).cast("string").alias("url"),
                         F.col(html_col).cast("string").alias("html"))
    also = guests(light.select("_id", "url"), cuts, id_type)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                urls = batch.column(1).to_pylist()
                at = [place(u) for u in urls]
                found = [marked_blocks(h or "") for h in batch.column(2).to_pylist()]
                to = [(i, bisect.bisect_right(cuts, p), False) for i, p in enumerate(at)]
                if also:
                    ids = batch.column(0).to_pylist()
                    to += [(i, b, True) for i, p in enumerate(at) for b in also.get((*p, ids[i], urls[i]), ())]
                rows = [i for i, _, _ in to]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for _, b, _ in to], pa.int32()), pa.array([at[i][0] for i in rows], pa.string()),
                     pa.array([at[i][1] for i in rows], pa.string()), batch.column(0).take(pa.array(rows, pa.int64())),
                     pa.array([urls[i] for i in rows], pa.string()), pa.array([found[i][0] for i in rows], pa.list_(pa.string())),
                     pa.array([found[i][1] for i in rows], pa.list_(pa.int32())), pa.array([g for _, _, g in to], pa.bool_())], names=names)

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        out: list[tuple] = []
        for here, before, after in neighbourhoods(rows(), NEIGHBOURS):
            if here[6]:
                continue
            lines = own_text(here[1], here[4], here[5], [(x[1], x[4], x[5]) for x in nearest(here, before, after)])
            out.append((here[2], here[3], "\n".join(lines)))
            if len(out) >= 500:
                yield _batch(out, types)
                out = []
        if out:
            yield _batch(out, types)

    arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(id_type, pa.string())
    types = [("_id", arrow), ("url", pa.string()), ("text", pa.string())]
    parsed = light.mapInArrow(parse, f"bucket int, host string, path string, _id {id_type}, url string, "
                                     "lines array<string>, regions array<int>, guest boolean")
    dealt = parsed.repartitionById(len(cuts) + 1, "bucket").sortWithinPartitions("host", "path", "_id", "url")
    return dealt.select("host", "path", "_id", "url", "lines", "regions", "guest").mapInArrow(
        difference, f"_id {id_type}, url string, text string")


def _batch(rows: list[tuple], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), types)], names=[n for n, _ in types])


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages``."""
    out = extract(read_table(spark, sf_dir, "pages"))
    return out.select(F.col("_id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
