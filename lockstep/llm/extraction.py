"""Main text of web pages by the distribution of text over lines.

Markup is stripped to lines, one per block, and elements that never belong to an article go with
what they contain. The lengths of the remaining text, links outside headings not counted, are summed over sliding
windows of lines. Where the sum surges above SURGE an article begins, with the shorter lines that lead up to it;
where it dives to nothing it ends; what lies between is kept. After the first surge half of it is enough. Where the sum never surges, the run of lines
with the most text is kept. Marks weigh: on a page with <main>, or where <article> holds at least a quarter of the text,
marked lines weigh MARKED more, whatever they hold, and lines outside weigh nothing.

A page is cut into tags once. End tags are paired by a stack for each name, and how much text an element holds is
the difference of two prefix sums, so time is linear in the page.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.llm.common import table

THICKNESS = 3
SURGE = 86
MARKED, SHARE = SURGE + 1, 0.25
# Shares of a page's text that an element with a doubtful name has to hold to stay.
HALF, WHOLE = 0.5, 0.95

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)(?:>|\Z)""",
    re.S | re.X,
)
_HINTED = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "xmp", "iframe", "noembed"}
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW}
_DROPPED = _RAW | {
    "head", "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "option",
    "svg", "math", "object", "canvas", "audio", "video", "map", "fieldset", "label", "input",
}
_VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i",
    "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike",
    "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
_MARKS = {"article", "main"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Words of a class, id or role that name what is not the article; a name counts if the others
# in it say only where or what kind of box it is, so not in has-sidebar or search-results.
_COMMENT = re.compile(
    r"comments?|disqus|repl(?:y|ies)|respond|responses?|discussions?|reactions?|talkback|guestbook", re.I
)
_HINT = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|"
    r"sidebar|menu|nav|navigation|navbar|breadcrumbs?|footer|siteheader|masthead|social|share|sharing|related|"
    r"recommend\w*|newsletter|subscribe|popup|modal|overlay|widget|toolbar|pagination|pager|login|signup|"
    r"search|skip|complementary|contentinfo",
    re.I,
)
# Names of things that are never an article, however long; the other hints also name parts of a layout.
_SELLS = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|social|share|sharing|related|"
    r"recommend\w*|newsletter|subscribe|popup|login|signup",
    re.I,
)
_BOX = re.compile(
    r"site|page|main|global|top|bottom|left|right|upper|lower|primary|secondary|header|area|box|bar|block|list|items?|"
    r"links?|buttons?|icons?|container|wrapper|wrap|section|panel|inner|outer|body|form|thread|title|posts?|"
    r"articles?|stories|text|media|to|us|user|the|div|id|\d+|",
    re.I,
)


_MAIN = re.compile(r"<main[\s>/]", re.I)


def _tells(name: str, hint: re.Pattern) -> bool:
    parts = re.split("[_-]+", re.sub("(?i)(side)-(?=bar)|(site)-(?=header)", r"\1\2", name))
    known = all(_COMMENT.fullmatch(x) or _HINT.fullmatch(x) or _BOX.fullmatch(x) for x in parts)
    return known and any(hint.fullmatch(x) for x in parts)


def _names(attributes: str) -> list[str]:
    return [name for m in _HINTED.findall(attributes) for name in m.strip("\"'").split()]


def _unwanted(tag: str, attributes: str, marked: bool) -> bool:
    """Does the element go whatever it holds?"""
    if tag in _DROPPED or tag == "header" and not marked:
        return True
    if tag in ("html", "body") or not attributes:
        return False
    if tag not in _MARKS and _HIDDEN.search(attributes):
        return True
    return any(_tells(name, _COMMENT) for name in _names(attributes))


def _doubtful(tag: str, attributes: str) -> bool:
    """Does the element go unless it holds the page's main text?"""
    if tag in ("html", "body", *_MARKS) or not attributes:
        return False
    return any(_tells(name, _HINT) for name in _names(attributes))


class _Page:
    """A page's tags in order, the end of each element, and how much text lies before each tag."""

    def __init__(self, page: str):
        self.page = page
        # Start, end, whether it closes, name, attributes; raw text is part of the tag that opens it.
        self.tags: list[tuple[int, int, bool, str, str]] = []
        self.ends: list[int] = []
        open_: dict[str, list[int]] = {}
        at = 0
        while found := _TAG.search(page, at):
            at = found.end()
            closing, tag, attributes = bool(found[1]), (found[2] or "").lower(), found[3] or ""
            if tag in _RAW and not closing:
                end = _END[tag].search(page, at)
                at = end.end() if end else len(page)
            k = len(self.tags)
            self.tags.append((found.start(), at, closing, tag, attributes))
            self.ends.append(k)
            if closing and open_.get(tag):
                self.ends[open_[tag].pop()] = k
            elif not closing and tag and tag not in _VOID:
                open_.setdefault(tag, []).append(k)
        self._weigh()

    def _weigh(self) -> None:
        """Sums: of the text up to each tag (one further on), without links and in all, and of marked elements."""
        self.text, self.all, marks = [0], [0], [0]
        for _, piece, linked, _ in self._pieces(lambda k: False):
            size = len(piece.strip()) if piece else 0
            self.text.append(self.text[-1] + (0 if linked else size))
            self.all.append(self.all[-1] + size)
        for k, (_, _, closing, tag, _) in enumerate(self.tags):
            held = tag in _MARKS and not closing and self.all[self.ends[k] + 1] > self.all[k + 1]
            marks.append(marks[-1] + held)
        self.marks = marks

    def _pieces(self, goes):
        """Number of each tag (and one past the last), the text before it, whether that is a link's, whether it is
        in a marked element; a dropped element has no text. goes: of doubtful elements, by number."""
        marks, linked, heading, skip, at = 0, False, 0, -1, 0
        for k, (start, end, closing, tag, attributes) in enumerate(self.tags):
            if k <= skip:
                at = end
                yield k, "", False, marks > 0
                continue
            yield k, self.page[at:start], linked and not heading, marks > 0
            at = end
            if not closing and tag not in _VOID and tag:
                if _unwanted(tag, attributes, marks > 0) or _doubtful(tag, attributes) and goes(k):
                    skip = self.ends[k]
                    continue
            if tag == "a":
                linked = not closing
            elif tag in _HEADINGS:
                heading = max(heading - 1, 0) if closing else heading + 1
            elif tag in _MARKS:
                marks = max(marks - 1, 0) if closing else marks + 1
        yield len(self.tags), self.page[at:], linked and not heading, marks > 0

    def _holds_main(self, k: int) -> bool:
        """Does an element hold a marked one, or on a page without any half of the text? One whose name sells
        something has to hold nearly all of it."""
        end = self.ends[k]
        if self.marks[-1]:
            return self.marks[end] > self.marks[k + 1]
        sells = any(_tells(name, _SELLS) for name in _names(self.tags[k][4]))
        return self.text[end + 1] - self.text[k + 1] > (WHOLE if sells else HALF) * self.text[-1]

    def lines(self) -> list[tuple[str, int, bool]]:
        """Text, length without links and whether it lies in a marked element, for each block."""
        out: list[tuple[str, int, bool]] = []
        parts: list[str] = []
        links, inside = 0, False
        for k, piece, linked, marked in self._pieces(lambda k: not self._holds_main(k)):
            if piece:
                parts.append(piece)
                links += len(piece) if linked else 0
                inside = inside or marked and not piece.isspace()
            if k == len(self.tags) or self.tags[k][3] and self.tags[k][3] not in _INLINE:
                text = " ".join(html.unescape("".join(parts)).split())
                if text:
                    out.append((text, max(len(text) - links, 0), inside))
                parts, links, inside = [], 0, False
        return out


def lines(page: str) -> list[tuple[str, int, bool]]:
    """Text, length without links and whether it lies in a marked element, for each block that stays."""
    return _Page(page).lines()


def main_text(page: str | None) -> str:
    """Blocks between surge and dive, joined by a space; empty for none."""
    found = lines(page or "")
    weight = np.array([length for _, length, _ in found], np.int64)
    inside = np.array([marked for *_, marked in found], bool)
    size = np.array([len(text) for text, *_ in found], np.int64)
    if inside.any() and (_MAIN.search(page) or size[inside].sum() >= SHARE * size.sum()):
        weight = np.where(inside, weight + MARKED, 0)
    elif not weight.any():
        weight = size
    padded = np.concatenate([weight, np.zeros(THICKNESS - 1, np.int64)])
    sums = np.convolve(padded, np.ones(THICKNESS, np.int64), "valid")
    kept = _runs(weight, sums, SURGE)
    if not kept:
        runs = _runs(weight, sums, 0)
        kept = [max(runs, key=lambda run: weight[run].sum())] if runs else []
    return " ".join(found[k][0] for run in kept for k in run)


def _runs(weight: np.ndarray, sums: np.ndarray, surge: int) -> list[list[int]]:
    """The numbers of the blocks from each surge, with the shorter ones that lead up to it, to the dive after it."""
    out: list[list[int]] = []
    open_ = False
    for k in range(len(weight)):
        if not open_ and sums[k] > (surge / 2 if out else surge) and weight[k]:
            open_ = True
            before = k
            while before and weight[before - 1] and not (out and out[-1][-1] >= before - 1):
                before -= 1
            out.append(list(range(before, k)))
        elif open_ and not sums[k]:
            open_ = False
        if open_:
            out[-1].append(k)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    The whole html is read; null counts as empty. Without any main text, text is empty and n_chars 0.
    Other columns are ignored, repeated rows are treated alike, no rows give no rows.
    """

    @F.pandas_udf("string")
    def text_of(page: pd.Series) -> pd.Series:
        return page.map(main_text)

    found = pages.select("page_id", "url", text_of(F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
