"""Main text of web pages by the distribution of text over blocks of lines.

Each page is handled whole in one task, in two steps.

1. Markup is stripped in one pass: scripts, styles and comments go with their content, as do elements that
   carry no main text by their name (head, menus, footers, sidebars, forms), by their class, id or role (adverts,
   notices, reader comments) or as hidden. Block tags end a line, inline tags end nothing. Where a page has an
   article or main element with text, what stands outside it is stripped too.
2. The lines left are weighed: a line counts the characters it has outside links, or none if most of it is
   links, unless it stands in an article. An element that went outside an article leaves `window` lines without weight
   behind, except adverts, notices and the like, which may stand inside a text. Weights are summed over a
   sliding window of `window` lines. A stretch of windows with a weight rises at its first line of weight and
   dives behind its last one; if a window in it reaches `surge` characters (or the largest sum of the page,
   where none does), it is a surge. All text between the first surge and the last dive of one is kept,
   short lines and short stretches among it too; only lines inside a dive (menus) are not.

Lines of an article leave no gap, so an article is one surge and is kept whole. Both steps take time in
proportion to the page: a tag is read forwards without a second try, and since each kind of quote swaps two of a
reader's three states (outside, in one kind, in the other), at most three tags that never end are read on at once.

Defined results: null or empty html, and html without text, give the empty text; a repeated row gives a
repeated result; null ids and urls are passed on; an element that is never closed drops no text, except
scripts, styles and comments, which run to the end as in a browser; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import table

#: Lines of a window, and the characters in a window that make a stretch a surge.
WINDOW, SURGE = 3, 86

INSIDE_TAG = r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+"
SILENT = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|template|textarea|noscript|iframe)\b{INSIDE_TAG}>.*?(?:</\1\s*>|\Z)", re.I | re.S)
TAG = re.compile(rf"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({INSIDE_TAG})>|<[!?][^<>]*>")
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = set("head title nav footer aside form menu dialog button fieldset label select svg object math".split())
#: Words that mark what is no main text if a class, id or role is made of them and of `FILLERS` alone;
#: `ASIDE` are those of parts that may stand inside a text.
ASIDE = set("ad ads adv advert adverts advertisement advertising advertorial banner sponsor sponsored promo promotion popup modal notice notices cookie cookies consent gdpr newsletter subscribe subscription signup share sharing social".split())
MARKS = ASIDE | set(
    "sidebar comment comments disqus replies related recommended recommendations breadcrumb breadcrumbs menu nav navbar navigation footer "
    "widget widgets pagination pager toolbar masthead complementary contentinfo search skip".split()
)
FILLERS = set(
    "box wrap wrapper container block section area list item items bar inner outer slot unit top bottom left right main primary secondary site page "
    "global user reader visitor form header title heading body content links link buttons button icons post posts article story message text js".split()
)
#: Elements whose id tells their heading's words rather than their part of the page.
NAMED = set("h1 h2 h3 h4 h5 h6 p a span li dt dd td th".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?")
UNSHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b")


class Line(NamedTuple):
    text: str
    weight: int
    inside: bool


def _mark(name: str, attributes: str) -> str | None:
    """'hidden', or the word for which an element's class, id or role makes it no main text."""
    for m in ATTRIBUTE.finditer(attributes or ""):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "role") or key == "id" and name not in NAMED:
            for token in value.split():
                words = [w for w in re.split(r"[^a-z]+", token) if w]
                marks = MARKS.intersection(words)
                if marks and marks.union(FILLERS).issuperset(words):
                    return min(marks)
        if key == "hidden" and value.strip() != "false" or key == "aria-hidden" and value.strip() == "true" or key == "style" and UNSHOWN.search(value):
            return "hidden"
    return None


def _closed(html: str) -> tuple[list[re.Match], dict[int, int]]:
    """The tags, and for each opening tag with a partner the index of its closing one."""
    tags, open_by, partner = list(TAG.finditer(html)), {}, {}
    for i, m in enumerate(tags):
        name = (m[2] or "").lower()
        if name and name not in VOID:
            if not m[1]:
                open_by.setdefault(name, []).append(i)
            elif open_by.get(name):
                partner[open_by[name].pop()] = i
        if name == "body" and not m[1]:
            for head in open_by.pop("head", []):  # a head ends where the body begins
                partner[head] = i - 1
    return tags, partner


def lines_of(html: str, window: int = WINDOW) -> list[Line]:
    """The lines of a page and the gaps that stripped elements leave."""
    html = SILENT.sub("", html)
    tags, partner = _closed(html)
    mains = [i for i, m in enumerate(tags) if m[2] and m[2].lower() == "main" and not m[1]]
    lines: list[Line] = []
    parts: list[str] = []
    plain: list[str] = []
    in_link, inside, ends, at_main = False, 0, set(), 0

    def add(text: str) -> None:
        parts.append(text)
        if not in_link:
            plain.append(text)

    def end_line() -> None:
        text = " ".join(unescape("".join(parts)).split())
        if text:
            free = len(" ".join(unescape("".join(plain)).split()))
            lines.append(Line(text, len(text) if inside else free if 2 * free >= len(text) else 0, inside > 0))
        parts.clear()
        plain.clear()

    at, i = 0, 0
    while i < len(tags):
        m = tags[i]
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        name, closing = (m[2] or "").lower(), bool(m[1])
        mark = None if closing or name in ("body", "html", "main", "") else _mark(name, m[3])
        drop = not closing and (name in DROPPED or name == "header" and not inside or mark)
        if drop and i in partner:
            while at_main < len(mains) and mains[at_main] <= i:
                at_main += 1
            drop = name in DROPPED or not (at_main < len(mains) and mains[at_main] < partner[i])  # what holds the main element stays
        if drop and i in partner:
            if name in BLOCKS:
                end_line()
            if not inside and mark not in ASIDE and mark != "hidden":
                lines += [Line("", 0, False)] * window
            i = max(i, partner[i])
            at = tags[i].end()
        elif name == "a":
            in_link = not closing  # links don't nest
        elif name in ("article", "main"):
            end_line()
            if not closing:
                inside += 1
                if i in partner:
                    ends.add(partner[i])
            elif i in ends:
                inside -= 1
        elif name in BLOCKS:
            end_line()
        i += 1
    if at < len(html):
        add(html[at:])
    end_line()
    return lines


def between_surges(weights: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Ranges of lines from the first surge to the last dive, without the lines inside dives."""
    sums, total = [], 0
    for i, w in enumerate(weights):
        total += w - (weights[i - window] if i >= window else 0)
        sums.append(total)
    need = min(surge, max(sums, default=0))
    stretches, start, peak = [], None, 0  # (first line of weight, line behind the last one, largest sum)
    for i, s in enumerate([*sums, 0]):
        if s and start is None:
            start, peak = i, s
        elif s:
            peak = max(peak, s)
        elif start is not None:
            last = next(j for j in range(i - 1, start - 1, -1) if weights[j])
            stretches.append((start, last + 1, peak))
            start = None
    surged = [k for k, (_, _, peak) in enumerate(stretches) if peak >= need]
    return [(a, z) for a, z, _ in stretches[surged[0] : surged[-1] + 1]] if surged else []


def main_text(html: str, window: int = WINDOW, surge: int = SURGE) -> str:
    lines = lines_of(html, window)
    if any(line.inside for line in lines):
        lines = [line for line in lines if line.inside]
    kept = between_surges([line.weight for line in lines], window, surge)
    return "\n".join(line.text for a, z in kept for line in lines[a:z] if line.text)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page."""

    def run(batches):
        for b in batches:
            texts = [main_text(h) if h else "" for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    chosen = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return chosen.mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
