"""Main text of pages: differencing against the page with the nearest URL.

The pages of a host are put in the order of their paths, and each is paired with
the neighbour whose path shares more of its start. All text lines of the two, menus
and footers among them, are aligned by longest common subsequence; lines that both
have belong to the template and go. Structure supports this: lines inside an article
element stay, whoever else has them, and what markup says is no main text goes even
where the neighbour has another one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.llm.common import positional, staged, with_rank

#: Elements without main text, elements that end a line, elements
#: with raw content, elements without content, and names of page furniture.
FURNITURE_TAGS = frozenset(
    "nav header footer aside form select button dialog menu noscript template svg math iframe object head".split()
)
LINE_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
RAW_TAGS = frozenset("script style textarea title xmp noembed noframes".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice popup promo "
    "promoted related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())

#: What a line is: open to differencing, of an article element, or furniture by its markup.
OPEN, ARTICLE, FURNITURE = 0, 1, 2

#: Pages aligned by one task, besides one more at either end.
BLOCK = 512

#: Bits of the alignment table held at once; longer pages are halved first.
TABLE_BITS = 1 << 28

# a tag whose quotes do not match ends at the next >; nothing here goes back, so any page takes linear time
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>)|[^>]*+)>", re.S
)
_CLOSING = re.compile(r"</([a-zA-Z][^\s/>]*+)\s*+>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|$|=)")


def _is_furniture(tag: str, attributes: str) -> bool:
    if tag in FURNITURE_TAGS:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}
    # a whole name only: "social-history" or "widget-theory" may be what an article is about
    names = set((found.get("class", "") + " " + found.get("id", "")).split())
    return bool(
        names & FURNITURE_NAMES
        or found.get("role") in FURNITURE_ROLES
        or found.get("aria-hidden") == "true"
        or "display:none" in found.get("style", "").replace(" ", "")
        or _HIDDEN.search(re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes))
    )


def lines_of(html: str | None) -> tuple[list[str], list[int]]:
    """All text lines of a page but raw content and what the reader never sees, and what each of them is."""
    html = html or ""
    lines: list[str] = []
    kinds: list[int] = []
    held: list[str] = []
    depth, at = 0, 0
    skip, inside = "", 0  # the open furniture element, and how many of its name are open
    last_close: dict[str, int] = {}
    end = html.rfind(">") + 1  # no tag is complete after it

    def end_line() -> None:
        line = " ".join(unescape("".join(held)).split())
        held.clear()
        if line:
            lines.append(line)
            kinds.append(FURNITURE if skip else ARTICLE if depth else OPEN)

    for m in _TAG.finditer(html, 0, end):
        if m.start() < at:  # inside of raw content
            continue
        held.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(html)
            continue
        tag, closes = m[2].lower(), m[1] == "/"
        if tag in RAW_TAGS and not closes:
            close = re.compile(rf"</{tag}\s*+>", re.I).search(html, at)
            at = close.end() if close else len(html)
            continue
        if skip:
            if tag in LINE_TAGS or tag in FURNITURE_TAGS:
                end_line()
            if tag == skip and tag not in VOID_TAGS:
                inside += -1 if closes else 1
                if not inside:
                    end_line()
                    skip = ""
            continue
        if tag in LINE_TAGS or tag in FURNITURE_TAGS:
            end_line()
        if not closes and tag not in VOID_TAGS and _is_furniture(tag, m[3]):
            end_line()
            if not last_close:
                last_close = {"": 0} | {c[1].lower(): c.start() for c in _CLOSING.finditer(html)}
            # an element that never closes hides nothing
            if last_close.get(tag, -1) >= at:
                skip, inside = tag, 1
        elif tag in ("article", "main"):
            depth = max(0, depth - 1) if closes else depth + 1
    held.append(html[at:].partition("<!--")[0])
    end_line()
    return lines, kinds


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For each start of ``a`` a number whose bit j is 0 where b[j] lengthens the longest common subsequence."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    everything = row = (1 << len(b)) - 1
    for x in a:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & everything
        yield row


def _lengths(row: int, n: int) -> np.ndarray:
    """Lengths of the longest common subsequences with every start of b, from the last row."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence of a and b.

    A row of the table is one number with a bit for each line of b. Of a table that
    is too large to hold, a is halved and b cut where both halves together are longest.
    """
    start, end = 0, 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    ends = [*range(start)], [*range(len(a) - end, len(a))]
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return ends[0] + ends[1]
    if len(a) > 1 and len(a) * len(b) > TABLE_BITS:
        half = len(a) // 2
        for up in _rows(a[:half], b):
            pass
        for down in _rows(a[half:][::-1], b[::-1]):
            pass
        cut = int((_lengths(up, len(b)) + _lengths(down, len(b))[::-1]).argmax())
        found = common_lines(a[:half], b[:cut]) + [half + i for i in common_lines(a[half:], b[cut:])]
    else:
        rows = [(1 << len(b)) - 1, *_rows(a, b)]
        i, j, found = len(a), len(b), []
        while i and j:
            if rows[i] >> j - 1 & 1:
                j -= 1
            elif not rows[i - 1] >> j - 1 & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                found.append(i)
        found.reverse()
    return ends[0] + [start + i for i in found] + ends[1]


def _parse(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
    except ValueError:
        return "", url or ""
    return parts.netloc.lower(), parts.path


def _shared_start(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _cuts(rows: pd.DataFrame) -> pd.DataFrame:
    """The places of template lines for the pages of one block.

    Articles take part in no alignment, so lines that two of them have never stand for a template.
    """
    rows = rows.sort_values("rank")
    host, path, own, keys, out = *(rows[c].tolist() for c in ("host", "path", "own", "page")), []
    places = [np.flatnonzero(np.asarray(k) != ARTICLE) for k in rows["kinds"]]
    lines = [np.asarray(x, np.int64)[p].tolist() for x, p in zip(rows["lines"], places)]
    covered = [len(p) < len(k) for p, k in zip(places, rows["kinds"])]
    for i in range(len(rows)):
        if not own[i]:
            continue
        near = [j for j in (i - 1, i + 1) if 0 <= j < len(rows) and host[j] == host[i] and lines[j] != lines[i]]
        # pages of which each has an article may have the same template all around it
        if covered[i]:
            near = [j for j in (i - 1, i + 1) if 0 <= j < len(rows) and host[j] == host[i]]
        if near:
            j = max(near, key=lambda j: (_shared_start(path[i], path[j]), j == i - 1))
            cut = common_lines(lines[i], lines[j])
            # a page of nothing else is a copy, not a template
            if cut and (covered[i] or len(cut) < len(lines[i])):
                out.append((keys[i], places[i][cut].tolist()))
    return pd.DataFrame(out, columns=["page", "cut"])


def line_table(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The parsed pages, written: ``page``, ``host``, ``path``, ``texts``, ``lines`` (hashes), ``kinds`` and the other columns."""

    @F.pandas_udf("host string, path string")
    def address(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_parse(u) for u in urls], columns=["host", "path"])

    @F.pandas_udf("texts array<string>, kinds array<tinyint>")
    def lines(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([lines_of(t) for t in texts], columns=["texts", "kinds"])

    rest = [c for c in pages.columns if c != html]
    parsed = pages.select(*rest, address(url).alias("a"), lines(html).alias("f")).select(
        *rest, "a.*", F.transform("f.texts", lambda line: F.xxhash64(line)).alias("lines"), "f.kinds",
        # of furniture the hash is enough
        F.transform("f.texts", lambda t, i: F.when(F.get("f.kinds", i) != FURNITURE, t)).alias("texts"),
    )
    return staged(parsed.withColumn("page", F.monotonically_increasing_id()), "page-lines")


def template_lines(parsed: DataFrame) -> DataFrame:
    """``page`` and ``cut``, the places of its lines that the page with the nearest URL has too, for pages with such lines."""
    light = parsed.select("page", "host", "path", "lines", "kinds")
    # a page that is all article has nothing of the template, to lose or to show
    light = light.filter(F.exists("kinds", lambda kind: kind != ARTICLE))
    ranked = with_rank(light, [F.col("host"), F.col("path"), F.col("page")], "page-order")
    block, place = F.floor(F.col("rank") / BLOCK), F.col("rank") % BLOCK
    # the first and last page of a block are also neighbours in the one beside it
    blocks = F.array_compact(
        F.array(
            F.struct(block.alias("block"), F.lit(True).alias("own")),
            F.when(place == 0, F.struct((block - 1).alias("block"), F.lit(False).alias("own"))),
            F.when(place == BLOCK - 1, F.struct((block + 1).alias("block"), F.lit(False).alias("own"))),
        )
    )
    cuts = ranked.select("*", F.inline(blocks)).groupBy("block").applyInPandas(_cuts, "page bigint, cut array<int>")
    return staged(cuts, "page-cuts")


def main_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """All columns but the html, with ``text`` and ``n_chars`` (its code points).

    Null and empty pages have an empty text; pages without a url form a host of
    their own. Pages of a host that have the same lines and no article element are
    never compared with each other; of equal paths the order of the rows decides.
    Columns named ``text`` or ``n_chars``, in any case, give way; all others keep
    their names and values.
    """
    named, (url, html) = positional(pages, url, html)
    kept = {p: c for p, c in zip(named.columns, pages.columns) if p != html and c.lower() not in ("text", "n_chars")}
    parsed = line_table(named.select(*dict.fromkeys([*kept, url, html])), url, html)
    cuts = template_lines(parsed)
    stays = lambda line, i: F.col("cut").isNull() | ~F.array_contains("cut", i)
    text = F.array_join(F.filter("texts", lambda line, i: line.isNotNull() & stays(line, i)), " ")
    joined = parsed.select(*kept, "page", "texts").join(cuts, "page", "left").select(*kept, text.alias("text"))
    return joined.withColumn("n_chars", F.length("text").cast("bigint")).toDF(*kept.values(), "text", "n_chars")
