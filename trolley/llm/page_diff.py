"""HTML main text by nearest-URL page differencing.

1. One scan reads each page's text lines (blocks between block-level tags) with the zone each
   stands in: structural boilerplate (menus, footers, adverts, forms, comments ...), open page,
   or inside an article element.
2. Pages of a host with the same lines in the same zones collapse to one. These are ordered by
   host and URL path with a distributed dense rank, so a host with a third of all pages is
   spread over many tasks. A page's partner is the neighbour of the same host whose path shares
   the longer prefix (the earlier one on a tie); its witness is the neighbour on the other side,
   or at the end of a host the next one but one.
3. The line hashes of each pair are aligned by longest common subsequence; shared lines are
   deleted. Inside an article a headline stays, and any other line goes only if the witness holds it as well
   and so do more than half of the host's pages (``LEAST_PAGES`` at least): what fewer share is
   a quotation. A pair that shares nearly all of the page's text is a copy: it tells nothing, and the
   witness takes the partner's place.
4. A second scan rebuilds the texts without the deleted lines and the structural boilerplate.

Only line hashes travel to the pairs; pages travel once, to meet their deletions.

Defined cases: null or empty html has no text; an unclosed tag ends with its container; a page
that is alone in its host, or has only copies there, loses no line; a null or odd URL counts by its string, null ones
form a host of their own; repeated ids are told apart by URL and html, exactly repeated rows
are paired and extracted alike; an empty table gives an empty result; only the id, URL and HTML columns are
read, so others may have any names. Nesting and repeated lines cost time linear in the page, or 1/64 of the
product of the repeated lines of a pair.
"""

from __future__ import annotations

import html as htmllib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.llm.common import store
from trolley.operators.ranking import dense_ids

#: HTML elements by role.
RAW = "script|style|noscript|template|svg|math|iframe|object|textarea|select|canvas|audio|video"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span "
                   "strike strong sub sup time tt u var".split())
DROP_TAGS = frozenset("head nav aside footer form button menu dialog fieldset".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary alert alertdialog dialog search form menu menubar".split())
DROP_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
                       "notices alert popup modal overlay newsletter subscribe subscription sidebar aside nav navbar navigation menu breadcrumb "
                       "breadcrumbs footer masthead comment comments reply replies respond disqus share sharing social related recommended "
                       "pagination pager login signup search widget toolbar".split())
WEAK_ROOTS = frozenset("article content post entry story main maincontent".split())
CLOSES_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-z][^>]*\Z", re.I | re.S)
_ATTR = re.compile(r"""([a-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME = re.compile(r"[A-Za-z]+")
DROPPED, OPEN, WEAK, MAIN, ARTICLE, TITLE = range(6)
#: Pages of a host that must hold a line inside an article before it can be boilerplate; more than half of the host's must, too.
LEAST_PAGES = 4
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: A page and its partner are copies if less than one part in so many of the page's characters is its own.
COPY_PARTS = 20


def _judge(tag: str, attrs: str, in_article: bool) -> tuple[bool, int]:
    """(whether the element is structural boilerplate, the zone it opens)."""
    drop, zone = tag in DROP_TAGS or (tag == "header" and not in_article), OPEN
    if tag == "article":
        zone = ARTICLE
    elif tag == "main":
        zone = MAIN
    if "=" in attrs or "hidden" in attrs:
        found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
        names = {w.lower() for key in ("class", "id") for w in _NAME.findall(found.get(key, ""))}
        role = found.get("role", "").lower()
        named = bool(names & DROP_WORDS) or ("header" in names and not in_article)
        # a wrapper "with sidebar" is no sidebar; an article goes only as a comment
        named = named and not names & {"has", "with", "no", "without"} and tag not in ("body", "html", "main")
        named = named and (tag != "article" or bool(names & {"comment", "comments", "reply", "ad", "advert", "related", "promo"}))
        drop = drop or named or role in DROP_ROLES or found.get("aria-hidden") == "true" \
            or "display:none" in found.get("style", "").replace(" ", "") or bool(re.search(r"(?:^|\s)hidden(?:\s|$)", attrs))
        if zone == OPEN and (role == "main" or found.get("itemprop") == "articleBody"):
            zone = MAIN
        elif zone == OPEN and tag in ("div", "section", "td") and names & WEAK_ROOTS:
            zone = WEAK
    return drop, zone


def text_lines(page: str | None) -> list[tuple[str, int]]:
    """(line, zone) of a page in order; lines are blocks with character references decoded and white space as one space."""
    page = page or ""
    lines: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, int]] = []  # (tag, dropped, zone), each with what it inherits
    opened: dict[str, int] = {}  # elements of the stack by tag
    pieces: list[str] = []
    at = 0

    def push(tag: str, dropped: bool, zone: int) -> None:
        stack.append((tag, dropped, zone))
        opened[tag] = opened.get(tag, 0) + 1

    def pop() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    def flush() -> None:
        if pieces:
            text = " ".join(htmllib.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                lines.append((text, DROPPED if stack and stack[-1][1] else stack[-1][2] if stack else OPEN))

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            pieces.append(page[at:m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        above = stack[-1] if stack else ("", False, OPEN)
        if m["end"]:
            if tag in INLINE:
                if above[0] == tag:  # only inline elements that change the zone are on the stack
                    flush()
                    pop()
                continue
            flush()
            if opened.get(tag):
                while pop() != tag:
                    pass
            continue
        drop, zone = _judge(tag, m["attrs"], above[2] >= ARTICLE)
        if tag in INLINE:
            if drop and not above[1]:
                flush()
                push(tag, True, above[2])
            continue
        flush()
        if tag == "body":
            stack.clear()
            opened.clear()
            above = ("", False, OPEN)
        while stack and (stack[-1][0] == "p" or stack[-1][0] in CLOSES_ITSELF.get(tag, ())):
            pop()
            above = stack[-1] if stack else ("", False, OPEN)
        push(tag, above[1] or drop, TITLE if tag in HEADINGS and above[2] >= ARTICLE else max(above[2], zone))
    pieces.append(page[at:])
    flush()
    return lines


def split_zones(lines: list[tuple[str, int]]) -> tuple[list[bool], list[bool]]:
    """Per line: whether it can be main text, and whether it stands in an article, where a quotation is protected."""
    return [z != DROPPED for _, z in lines], [z >= ARTICLE for _, z in lines]


def _few_matches(mine: list[int], theirs: list[int], where: dict[int, list[int]]) -> list[int]:
    """Places of a longest common subsequence by the matches' longest rising run; the cost follows the matches."""
    tails: list[int] = []
    nodes: list[tuple[int, object]] = []  # (place in mine, the chain before it)
    for i, x in enumerate(mine):
        for j in reversed(where.get(x, ())):
            k = bisect_left(tails, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                nodes.append(node)
            else:
                tails[k], nodes[k] = j, node
    out, node = [], nodes[-1] if nodes else None
    while node:
        out.append(node[0])
        node = node[1]
    return out[::-1]


def _lengths(mine: list[int], theirs: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``mine`` with every beginning of ``theirs``, 64 cells at a time."""
    masks: dict[int, int] = {}
    for j, x in enumerate(theirs):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(theirs)) - 1
    row = full  # a zero bit where the length grows
    for x in mine:
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(theirs) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(theirs)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _many_matches(mine: list[int], theirs: list[int], offset: int = 0) -> list[int]:
    """The same by halving ``mine``, in memory linear in the lines."""
    if not mine or not theirs:
        return []
    if len(mine) == 1:
        return [offset] if mine[0] in theirs else []
    half = len(mine) // 2
    ahead, behind = _lengths(mine[:half], theirs), _lengths(mine[half:][::-1], theirs[::-1])[::-1]
    cut = int((ahead + behind).argmax())
    return _many_matches(mine[:half], theirs[:cut], offset) + _many_matches(mine[half:], theirs[cut:], offset + half)


def shared_lines(mine: list[int], theirs: list[int]) -> list[int]:
    """Places in ``mine`` of a longest common subsequence with ``theirs``.

    What both begin and end with is taken off first. Lines that repeat on both sides make many matches;
    these pages are compared 64 cells at a time.
    """
    n = min(len(mine), len(theirs))
    lead = next((k for k in range(n) if mine[k] != theirs[k]), n)
    trail = next((k for k in range(n - lead) if mine[-1 - k] != theirs[-1 - k]), n - lead)
    stop = len(mine) - trail
    middle = theirs[lead:len(theirs) - trail]
    both = set(middle) & set(mine[lead:stop])
    places = [i for i in range(lead, stop) if mine[i] in both]
    a, b = [mine[i] for i in places], [x for x in middle if x in both]
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    matches = sum(len(where[x]) for x in a)
    at = _few_matches(a, b, where) if matches <= 8 * (len(a) + len(b)) else _many_matches(a, b)
    return [*range(lead), *(places[i] for i in at), *range(stop, len(mine))]


def judge(mine: list[int], sizes: list[int], zones: list[int], partner: list[int], witness: list[int] | None) -> tuple[int, list[int]]:
    """(lines shared with the partner, places of the lines that go) of a page; the witness stands in for a partner that is a copy."""
    total = sum(n for n, z in zip(sizes, zones) if z != DROPPED)

    def aligned(theirs: list[int] | None) -> tuple[list[int], bool]:
        at = shared_lines(mine, theirs) if theirs is not None else []
        own = total - sum(sizes[i] for i in at if zones[i] != DROPPED)
        return at, theirs is not None and own * COPY_PARTS >= total

    (pair, differs), (third, tells) = aligned(partner), aligned(witness)
    if not differs:
        return (len(third), [i for i in third if zones[i] not in (DROPPED, ARTICLE, TITLE)]) if tells else (len(pair), [])
    common = set(third if tells else ())
    return len(pair), [i for i in pair if zones[i] not in (DROPPED, TITLE) and (zones[i] != ARTICLE or i in common)]


def _page_key(url_col: str, html_col: str):
    return F.xxhash64(F.coalesce(F.col(url_col), F.lit("\x00")), F.coalesce(F.col(html_col), F.lit("\x00")))


def page_lines(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (page, pkey, host, path, and of the lines their hashes, sizes in characters and zones)."""
    rows = pages.select(F.col(id_col).alias("page"), _page_key(url_col, html_col).alias("pkey"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["page"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, sizes, zones = [], [], []
            for page in batch.column(3):
                lines = text_lines(page.as_py())
                hashes.append(np.array([xxhash.xxh64_intdigest(t) for t, _ in lines], "<u8").view("<i8"))
                sizes.append([len(t) for t, _ in lines])
                zones.append([z for _, z in lines])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(hashes, pa.list_(pa.int64())),
                                              pa.array(sizes, pa.list_(pa.int32())), pa.array(zones, pa.list_(pa.int8()))],
                                             ["page", "pkey", "url", "hashes", "sizes", "zones"])

    got = rows.mapInArrow(run, f"page {kind}, pkey bigint, url string, hashes array<bigint>, sizes array<int>, zones array<tinyint>")
    rest = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host, path = F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return got.select("page", "pkey", host.alias("host"), F.regexp_replace(path, "/+$", "").alias("path"), "hashes", "sizes", "zones")


def deletions(lines: DataFrame) -> DataFrame:
    """Rows (page, pkey, n_shared, deleted places) of the pages that share lines with their partner."""
    same = ["host", "h1", "h2"]  # 96 bits that identify a page's lines within its host
    distinct = lines.dropDuplicates(["page", "pkey"]).withColumns({"h1": F.xxhash64("hashes", "zones"), "h2": F.hash("hashes", "zones")})
    heads = distinct.groupBy(*same).agg(F.min(F.struct("path", "page", "pkey", "hashes", "sizes", "zones")).alias("head")).select(*same, "head.*")
    ranked = store(dense_ids(heads, [F.col(c) for c in ("host", "path", "page", "pkey")], "place"))
    seen = ranked.select(F.explode(F.array(*[F.lit(k) for k in (-2, -1, 1, 2)])).alias("step"), "place", "host", "path")
    sides = {"before2": -2, "before": -1, "after": 1, "after2": 2}
    around = seen.groupBy((F.col("place") - F.col("step")).alias("place")).agg(
        *[F.max(F.when(F.col("step") == k, F.struct("host", "path"))).alias(name) for name, k in sides.items()])
    near = ranked.select("place", "host", "path").join(around, "place")

    def likeness(name: str):
        """Leading characters that the paths share; -1 without such a neighbour."""
        short = F.least(F.length("path"), F.length(f"{name}.path"))
        chars = F.filter(F.sequence(F.lit(1), F.greatest(short, F.lit(1))),
                         lambda i: F.substring(F.col("path"), i, F.lit(1)) != F.substring(F.col(f"{name}.path"), i, F.lit(1)))
        return F.when(F.col(f"{name}.host") == F.col("host"), F.coalesce(F.get(chars, F.lit(0)) - 1, short)).otherwise(-1)

    def there(name: str):
        """Place of a neighbour of the same host, or null."""
        return F.when(F.col(f"{name}.host") == F.col("host"), F.col("place") + sides[name])

    first = likeness("before") >= likeness("after")
    partner = near.select("place", F.when(first, there("before")).otherwise(there("after")).alias("partner"),
                          F.when(first, F.coalesce(there("after"), there("before2"))).otherwise(F.coalesce(there("before"), there("after2"))).alias("witness")) \
        .where("partner is not null")
    theirs = ranked.select(F.col("place").alias("partner"), F.col("hashes").alias("theirs"))
    others = ranked.select(F.col("place").alias("witness"), F.col("hashes").alias("others"))

    @F.pandas_udf("n_shared int, deleted array<int>")
    def judged(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [judge(*(None if x is None else x.tolist() for x in row)) for row in zip(*batch)]
            yield pd.DataFrame({"n_shared": [n for n, _ in rows], "deleted": [at for _, at in rows]})

    found = store(ranked.join(partner, "place").join(theirs, "partner").join(others, "witness", "left")
                  .select(*same, "hashes", "zones", judged("hashes", "sizes", "zones", "theirs", "others").alias("found")).where("found.n_shared > 0"))
    # the few lines inside articles that the alignment marks: how many pages of the host hold them
    marked = found.select(*same, F.explode(F.filter("found.deleted", lambda i: F.get("zones", i) == ARTICLE)).alias("at"), "hashes") \
        .select(*same, "at", F.get("hashes", F.col("at")).alias("line"))
    asked = marked.select("host", "line").distinct()
    held = ranked.select("host", "place", F.explode(F.array_distinct("hashes")).alias("line")).join(asked, ["host", "line"]) \
        .groupBy("host", "line").agg(F.count("*").alias("pages"))
    hosts = ranked.groupBy("host").agg(F.count("*").alias("of"))
    usual = held.join(hosts, "host").where((F.col("pages") >= LEAST_PAGES) & (F.col("pages") * 2 > F.col("of"))).select("host", "line")
    kept = marked.join(usual, ["host", "line"], "left_anti").groupBy(*same).agg(F.collect_list("at").alias("kept"))
    left = found.select(*same, "found.*").join(kept, same, "left") \
        .select(*same, "n_shared", F.array_except("deleted", F.coalesce("kept", F.array().cast("array<int>"))).alias("deleted"))
    return distinct.select("page", "pkey", *same).join(left, same).select("page", "pkey", "n_shared", "deleted")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: (id, url, text, n_shared lines of the pair)."""
    gone = store(deletions(store(page_lines(pages, id_col, url_col, html_col)))).withColumnRenamed("page", "g_page").withColumnRenamed("pkey", "g_key")
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), _page_key(url_col, html_col).alias("pkey"))
    joined = rows.join(gone, F.col("page").eqNullSafe(F.col("g_page")) & (F.col("pkey") == F.col("g_key")), "left") \
        .select("page", "url", "html", "deleted", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))
    kind = rows.schema["page"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, cut in zip(batch.column(2), batch.column(3)):
                lines, cut = text_lines(page.as_py()), set(cut.as_py() or ())
                can, _ = split_zones(lines)
                texts.append(" ".join(t for i, (t, _) in enumerate(lines) if can[i] and i not in cut))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), batch.column(4)], ["page", "url", "text", "n_shared"])

    return joined.mapInArrow(run, f"page {kind}, url string, text string, n_shared int").withColumnRenamed("page", id_col)
