"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page, and each line
gets its text length, less its link text, as weight. Weights are summed over
sliding windows of lines; a surge is where the window sum rises above a
threshold and a dive where it falls to zero, and the lines between the dives
around a surge are kept. The threshold is ``SURGE`` or less, as the blocks of
the page, or of its articles for their lines, are short. Lines inside navigation, forms, adverts and the
like weigh nothing and are never kept. The lines of marked articles are summed
apart, without the boilerplate between them, so an advert is no dive; there a
dive needs windows of links alone before and behind it. Lines outside the
articles are summed without them. A label marks boilerplate only as a whole:
``comment-list`` does, ``share-price-story`` not.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
SURGE = 86

_TOKEN = re.compile(
    r"<(?:svg|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>|<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|noscript|template|textarea|select|iframe|object|svg|math|title|head(?=[\s>]))\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)",
    re.S | re.I,
)
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_ASIDE = set("nav footer aside form button dialog menu".split())
_OUTER = _ASIDE | {"header"}
_MAIN = {"article", "main"}
#: Words that name boilerplate, and words that may stand beside them in a label.
_NAMES = set(
    "ad ads adsbygoogle adsense advert advertisement adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation"
    " newsletter notice notices pagination popup promo promoted promotion promotions related replies reply search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
_NEUTRAL = set("area article bar block blog bottom box button buttons card cell col column container content entry form foot footnav global group head header holder icons inner item items left link links list main media module outer page panel post primary region right row secondary section site slot sticky sub third top unit user wrap wrapper zone".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_LABELS = {"class", "id", "role", "aria-label"}
_TEXTUAL = {"h1", "h2", "h3", "h4", "h5", "h6", "p"}  # their ids are anchors made of their text
_UNSHOWN = re.compile(r"display\s*:\s*none", re.I)


def _names_boilerplate(label: str) -> bool:
    """Whether a label as a whole names boilerplate: one of its words does, and no other word says more."""
    words = {w.lower() for w in _WORD.findall(label)}
    return bool(words & _NAMES) and words <= _NAMES | _NEUTRAL


def _told(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether a label of the tag names boilerplate, and whether its attributes hide it."""
    named = hidden = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if name in _LABELS and not (name == "id" and tag in _TEXTUAL):
            named = named or any(map(_names_boilerplate, [value] if name == "aria-label" else value.split()))
        hidden = hidden or name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and bool(_UNSHOWN.search(value)))
    return named, hidden


def lines_of(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, weight, in boilerplate, in article) of every non-empty block of a page, in page order."""
    out: list[tuple[str, int, bool, bool]] = []
    texts: list[str] = []
    stack: list[tuple[str, bool]] = []  # open elements that are boilerplate or article: (name, is boilerplate)
    depth: list[str] = []
    links = linked = 0

    def close_line() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(texts)).split())
        if text:
            aside = any(b for _, b in stack)
            out.append((text, 0 if aside else max(0, len(text) - linked), aside, any(not b for _, b in stack)))
        texts.clear()
        linked = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            texts.append(page[at : m.start()])
            linked += (m.start() - at) if links else 0
        at = m.end()
        name = (m[3] or "").lower()
        if m[1]:
            close_line()
        if not name:
            continue
        if name not in _INLINE:
            close_line()
        if name == "a":
            links = 0 if m[2] else 1
        if name in _VOID:
            continue
        if m[2]:
            if name in depth:
                while depth:
                    top = depth.pop()
                    if stack and stack[-1][0] == f"{top}{len(depth)}":
                        if top in _INLINE:
                            close_line()
                        stack.pop()
                    if top == name:
                        break
            continue
        if m[4] and m[4].rstrip().endswith("/"):
            continue
        named, hidden = _told(name, m[4]) if m[4] else (False, False)
        in_main = any(not b for _, b in stack)
        if name == "article" and not in_main:
            stack, depth = [], []
        aside = name in (_ASIDE if in_main else _OUTER) or (named and name not in ("body", "html", "article", "main")) or hidden
        if aside or name in _MAIN:
            if name in _INLINE:
                close_line()
            stack.append((f"{name}{len(depth)}", aside))
        depth.append(name)
    if at < len(page):
        texts.append(page[at:])
    close_line()
    return out


def _window_sums(weights: list[int], window: int) -> list[int]:
    sums, total = [], sum(weights[:window])
    for k in range(len(weights)):
        sums.append(total)
        total += (weights[k + window] if k + window < len(weights) else 0) - weights[k]
    return sums


def _between(weights: list[int], window: int, limit: float, both: bool = False) -> list[bool]:
    """Whether each line lies between two dives with a surge above limit among its neighbours.

    A dive is where the window sum is zero, with ``both`` also the sum of the
    window that ends there, else a line without weight before the first one is
    left out. A text's first short lines, which come before the window that
    surges, are within the same dives.
    """
    sums = _window_sums(weights, window)
    live = [total > 0 for total in sums]
    if both:
        live = [a or total > 0 for a, total in zip(live, _window_sums(weights[::-1], window)[::-1])]
    out: list[bool] = []
    for alive, run in groupby(range(len(weights)), key=live.__getitem__):
        at = list(run)
        kept = alive and max(sums[n] for n in at) > limit
        first = at[0] if both else next((n for n in at if weights[n]), 0)
        out += [kept and n >= first for n in at]
    return out


def surge_of(weights: list[int], window: int, surge: int) -> float:
    """The page's threshold: at most half its densest window and twice its median block, so that short blocks surge too."""
    solid = sorted(w for w in weights if w)
    return min(surge, max(_window_sums(weights, window)) / 2, 2 * solid[(len(solid) - 1) // 2]) if solid else surge


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The page's main text, one line per kept block; empty for null."""
    lines = lines_of(page or "")
    kept: dict[int, bool] = {}
    for inside in (True, False):
        part = [n for n, line in enumerate(lines) if line[3] == inside and not (inside and line[2])]
        weights = [lines[n][1] for n in part]
        limit = surge_of(weights if inside else [line[1] for line in lines], window, surge)
        kept |= zip(part, _between(weights, window, limit, both=inside))
    return "\n".join(line[0] for n, line in enumerate(lines) if not line[2] and kept[n])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [main_text(h.as_py()) for h in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages(page_id, url, html): page_id, url, text, n_chars (code points).

    Each page is read whole. Null, empty and wholly boilerplate pages give an
    empty text. Broken markup is read as far as it goes: an open tag or comment
    at the end runs to the end. Rows are passed on one by one, repeated ones
    included; other columns are ignored.
    """
    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
