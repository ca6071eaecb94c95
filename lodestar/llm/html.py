"""HTML extraction: site template removal.

Every page is parsed into blocks of text and element subtrees. Subtrees (their tags and text) of the whole page are
hashed and counted in Spark by the number of different pages (pages with one and the
same main text count once, so copies of an article don't make its parts a template): per host, and, outside of articles,
per registered domain and over all hosts, where more pages are asked for. Those that
recur are deleted. How many are many is a number of pages, the same for hosts of any size.

What is left is judged by evidence: blocks whose element, role or class names them as navigation, header,
footer, sidebar, notice, advert, form or comments go; ``article`` and ``main`` elements are taken as the main text unless there is
far more running text outside of them (a teaser in a column is no article). Text in links doesn't count for that.

Defined cases: null html gives an empty text; broken markup is read tolerantly (open elements
end where a parent or a block of their kind ends); a page without ``article`` or ``main`` is
taken whole; a null url is a host of its own; repeated rows give repeated results; an empty table
gives an empty result; very long pages take time in proportion to their length; further columns
are kept by ``extract`` (outputs replace their names).
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialize, read, slices
from .urls import host

#: Production parameters: a subtree is template from so many different pages of its host on: outside the
#: article, and inside it (there ``LEAST`` are enough where they are half of the host's pages).
LEAST, LEAST_IN = 5, 10
#: Outside of articles also from so many different pages of its registered domain, and of all hosts, on.
LEAST_DOMAIN, LEAST_EVERYWHERE = 10, 20
#: Articles are the main text unless there is more than so many times their running text outside.
OUTSIDE = 2
#: Template hashes (8 bytes each) that are sent to all tasks; beyond that they are joined page by page.
MAX_BROADCAST = 1 << 20

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|<[!?][^>]*>", re.S)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "title", "textarea", "template", "svg", "iframe", "select")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINER = frozenset("aside details div dl fieldset figure footer form header menu nav ol section table ul".split())
_DROP = frozenset("nav footer aside form menu dialog button".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Whole classes or ids that name what is no article; those of the second list only outside of one.
_CLASSES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsbox ad-banner ad-container ad-slot ad-unit breadcrumb breadcrumbs comment comments comment-list comments-area "
    "commentlist consent cookie cookies cookie-banner cookie-notice disclaimer disqus footer login masthead menu modal nav navbar navigation nav-menu main-nav newsletter notice "
    "notices notification overlay page-footer pager pagination popup promo promotion reader-comments related related-articles related-posts replies reply respond search "
    "search-form share share-buttons sharing sidebar signup site-footer site-header site-nav skip skip-link social social-share sponsor sponsored subscribe toolbar topbar "
    "user-comments widget".split()
)
_CLASSES_OUTSIDE = frozenset("banner form header top-bar".split())
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HEADING = re.compile(r"h[1-6]$")
_ITEMS = frozenset("p li dt dd tr td th".split())
_KIN = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}


def _boilerplate(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in _DROP or (tag == "header" and not in_article):
        return True
    if attrs and tag not in ("html", "body", "main"):
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "role":
                if value.strip() in _ROLES:
                    return True
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                return True
            elif name in ("class", "id") and not _HEADING.match(tag):
                own = value.split()
                if not _CLASSES.isdisjoint(own) or (not in_article and not _CLASSES_OUTSIDE.isdisjoint(own)):
                    return True
    return False


class _Open:
    """An open element: its tag, where it starts, whether it opens what is dropped or an article, and, of a container, its hash and the text before it."""

    __slots__ = ("tag", "start", "drops", "opens", "hash", "before")

    def __init__(self, tag: str, start: int, drops: bool, opens: bool, before: int):
        self.tag, self.start, self.drops, self.opens, self.before = tag, start, drops, opens, before
        self.hash = xxhash.xxh64() if tag in _CONTAINER else None


Block = tuple[int, str, bool, bool, int]


def parse(html: str | None) -> tuple[list[Block], list[tuple[int, int, int, bool]]]:
    """Blocks as (position, text, in the article, named as none, letters in links) and subtrees with text as (start, end, hash, in the article)."""
    blocks: list[Block] = []
    trees: list[tuple[int, int, int, bool]] = []
    if not html:
        return blocks, trees
    stack: list[_Open] = []
    hashes: list = []  # those of the open containers
    is_open: Counter[str] = Counter()
    parts: list[str] = []
    dropped = article = seen = letters = link = linked = 0
    at = began = 0

    def flush(now: int) -> None:
        nonlocal began, linked
        if parts:
            if text := " ".join(unescape("".join(parts)).split()):
                blocks.append((began, text, article > 0, dropped > 0, linked))
            parts.clear()
        began, linked = now, 0

    def close(k: int, end: int) -> None:
        """Close the open elements from the k-th on."""
        nonlocal dropped, article
        while len(stack) > k:
            x = stack.pop()
            is_open[x.tag] -= 1
            if x.hash is not None:
                hashes.pop()
                if letters > x.before:
                    trees.append((x.start, end, x.hash.intdigest(), article > 0))
                    if hashes:
                        hashes[-1].update(x.hash.digest())
            dropped -= x.drops
            article -= x.opens

    last = html.rfind(">")  # no tag ends behind it
    while True:
        m = _TOKEN.search(html, at) if at <= last or html.find("<!--", at) >= 0 else None
        if text := html[at : m.start() if m else len(html)]:
            if not parts:
                began = at
            parts.append(text)
            if own := " ".join(text.split()):
                letters += 1
                linked += len(own) * link
                if hashes:
                    hashes[-1].update(own.encode("utf-8", "replace"))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:  # an end tag: closes the nearest such element, and what is open in it
            if tag in _BLOCK or is_open[tag]:
                flush(at)
            if tag == "a":
                link = 0
            if is_open[tag]:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k, at)
            continue
        if tag in _RAW:
            end = _RAW[tag].search(html, at)
            at = end.end() if end else len(html)
            if tag != "svg":
                parts.append(" ") if parts else None
            continue
        if hashes:
            hashes[-1].update(f"<{tag}>".encode())
        if tag == "a":
            link = 1
        if tag in _VOID:
            if tag == "hr":
                flush(at)
            elif tag == "br" and parts:
                parts.append(" ")
            continue
        if tag in _BLOCK:
            flush(m.start())
            if tag in ("article", "main") and dropped and not seen:  # the article can't be inside what is dropped: an end tag is missing
                close(next(i for i, x in enumerate(stack) if x.drops), m.start())
            if tag in _ITEMS or _HEADING.match(tag):
                kin = _KIN.get(tag, (tag,))
                if any(is_open[x] for x in kin):
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k].tag in kin:
                            close(k, m.start())
                            break
                        if stack[k].tag in _BLOCK and stack[k].tag not in _ITEMS:
                            break
        if m[3].endswith("/"):
            continue
        drops = not dropped and _boilerplate(tag, m[3], article > 0)
        if drops:
            flush(m.start())
        opens = tag in ("article", "main") and not dropped and not drops
        if opens:
            article, seen = article + 1, 1
        if tag in _BLOCK or drops:
            stack.append(_Open(tag, m.start(), drops, opens, letters))
            is_open[tag] += 1
            if stack[-1].hash is not None:
                hashes.append(stack[-1].hash)
            dropped += drops
    flush(len(html))
    close(0, len(html))
    return blocks, trees


def main_text(blocks: list[Block], spans: list[tuple[int, int]] = ()) -> str:
    """The blocks of the main text outside ``spans``, one a line."""
    starts, ends = [], []
    for start, end in sorted(spans):
        if not ends or start >= ends[-1]:
            starts.append(start)
            ends.append(end)
        else:
            ends[-1] = max(ends[-1], end)
    gone = lambda at: (i := bisect_right(starts, at)) > 0 and at < ends[i - 1]
    left = [b for b in blocks if not b[3] and not gone(b[0])]
    running = [0, 0]
    for _, text, own, _, linked in left:
        running[own] += max(0, len(text) - linked)
    inside = any(b[2] for b in left) and running[0] <= OUTSIDE * running[1]
    whole = not any(b[2] for b in left)
    return "\n".join(text for _, text, own, _, _ in left if whole or own == inside)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def site(url_host: str) -> int:
    return _signed(xxhash.xxh64_intdigest(url_host.encode("utf-8", "replace")))


def domain(url_host: str) -> str:
    """The last two labels of a host: about its registered domain."""
    return ".".join(url_host.split(".")[-2:])


def sites(url_host: str) -> tuple[int, int, int]:
    """The levels that subtrees are counted on: the host, its domain, all hosts."""
    return site(url_host), site(f"*.{domain(url_host)}"), site("*")


def keys(url_host: str, blocks: list[Block], trees: list[tuple[int, int, int, bool]]) -> Iterator[tuple[int, int, int, int, bool]]:
    """Start, end, level, key, in the article of each subtree: on the host's level, and on the wider ones if it is outside of articles and has less than half of the page's text (a story that many sites carry is no template)."""
    at = [b[0] for b in blocks]
    upto = [0]
    for b in blocks:
        upto.append(upto[-1] + len(b[1]))
    levels = sites(url_host)
    for start, end, tree, inside in trees:
        held = upto[bisect_left(at, end)] - upto[bisect_left(at, start)]
        for k, s in enumerate(levels[: 1 if inside or 2 * held >= upto[-1] else 3]):
            yield start, end, k, key(s, tree), inside


def key(site_: int, tree: int) -> int:
    """One 64-bit number for a subtree of a site."""
    return _signed(xxhash.xxh64_intdigest(tree.to_bytes(8, "little"), seed=site_ & ((1 << 64) - 1)))


def subtree_counts(pages: DataFrame) -> DataFrame:
    """``site`` (of a host; 0 on wider levels), ``level``, ``tree``, ``inside``, ``n``: the different main texts among the pages of a host (level 0), a domain (1) and all hosts (2) that hold a subtree; ``tree`` null: all of a host's."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            out: set[tuple] = set()
            for h, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                blocks, trees = parse(page)
                s, d = site(h), _signed(xxhash.xxh64_intdigest(main_text(blocks).encode("utf-8", "replace")))
                out.add((s, 0, None, False, d))
                out.update((s, level, tree, inside, d) if level == 0 else (0, level, tree, inside, d) for _, _, level, tree, inside in keys(h, blocks, trees))
            columns = list(zip(*out, strict=True)) or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64()), strict=True)], ["site", "level", "tree", "inside", "main"])

    found = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(hashes, "site long, level int, tree long, inside boolean, main long")
    # most subtrees are on one page: the distinct rows are shuffled by subtree and page, then only counts
    return found.distinct().groupBy("site", "level", "tree", "inside").agg(F.count("*").alias("n"))


def templates(pages: DataFrame) -> DataFrame:
    """``tree``: keys of the subtrees that recur across many pages of their host, domain or of all."""
    counts = materialize(subtree_counts(pages).where(f"tree is null or n >= {LEAST}"), "subtrees")
    hosts = counts.where("tree is null").select("site", F.col("n").alias("pages"))
    wide = counts.where((F.col("level") == 1) & (F.col("n") >= LEAST_DOMAIN) | (F.col("level") == 2) & (F.col("n") >= LEAST_EVERYWHERE)).select("tree")
    enough = ~F.col("inside") | (F.col("n") >= LEAST_IN) | (F.col("n") * 2 >= F.col("pages"))
    own = counts.where("level = 0 and tree is not null").join(hosts, "site").where(enough).select("tree")
    found = materialize(own.unionAll(wide).distinct(), "templates")
    forget(counts)
    return found


def extract(pages: DataFrame) -> DataFrame:
    """Append ``text`` to ``pages`` (``url``, ``html``)."""
    rows = pages.drop("text", "_host", "_templates", "_row").withColumn("_host", host(F.col("url")))
    table = templates(pages)
    if table.count() <= MAX_BROADCAST:
        sent = pages.sparkSession.sparkContext.broadcast(np.sort(table.toArrow().column("tree").to_numpy()))
        known = None
    else:  # as many templates as fit no task: each page brings its own
        rows = rows.withColumn("_row", F.xxhash64("_host", "html"))
        known, sent = _own_templates(rows, table), None
        rows = rows.join(known, "_row", "left").drop("_row")

    def one(h: str, page: str | None, own) -> str:
        blocks, trees = parse(page)
        if own is None:
            all_ = sent.value
            held = lambda k: (i := int(np.searchsorted(all_, k))) < len(all_) and all_[i] == k
        else:
            held = set(own).__contains__
        return main_text(blocks, [(a, b) for a, b, _, k, _ in keys(h, blocks, trees) if held(k)])

    if known is None:
        udf = F.pandas_udf(lambda hosts, html: hosts.combine(html, lambda h, p: one(h, p, None)), "string")
        return rows.withColumn("text", udf("_host", F.coalesce("html", F.lit("")))).drop("_host")
    udf = F.pandas_udf(lambda hosts, html, own: hosts.combine(html, lambda h, p: (h, p)).combine(own, lambda x, o: one(*x, o)), "string")
    return rows.withColumn("text", udf("_host", F.coalesce("html", F.lit("")), F.coalesce("_templates", F.array().cast("array<bigint>")))).drop("_host", "_templates")


def _own_templates(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``_row``, ``_templates``: the template subtrees of each page."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            out = {(r, k) for r, h, p in zip(*(batch.column(c).to_pylist() for c in ("_row", "_host", "html")), strict=True) for _, _, _, k, _ in keys(h, *parse(p))}
            columns = list(zip(*out, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["_row", "tree"])

    own = rows.select("_row", "_host", "html").mapInArrow(held, "_row long, tree long").distinct()
    return own.join(table, "tree", "left_semi").groupBy("_row").agg(F.collect_set("tree").alias("_templates"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
