"""Main text of web pages by tag-path ratios: paths from root to leaf get scores from their text, and those that score enough hold content."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import fresh, others, small_batches

# HTML's element groups.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe object svg math canvas select option textarea button audio video head title datalist".split())
RAW = frozenset("script style textarea title iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
INSIDE = frozenset(("article", "main"))
ASIDE = frozenset("nav footer aside menu dialog".split())
#: Names of classes, ids and roles, and first or last parts of such names, where a part is likely not the article. They only weigh: see `_likely`.
CHROME = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert nav navbar navigation menu topbar breadcrumb breadcrumbs sidebar widget widgets footer masthead comment comments reply replies respond disqus discussion share sharing social related recommended recommendations popup modal overlay newsletter subscribe subscription signup login copyright legal pagination pager skip search toolbar complementary contentinfo".split()
)
#: Words with which a header is one of the article.
ARTICLE = frozenset("article entry post story content section".split())
#: How much text counts in parts whose whole name tells that they are likely no article, and where a part of a name does, on a page with much text. The
#: less text a page has, the less its ratios tell: weights are raised to the power of one and these characters by those of its text outside of links, by the squares of weights.
UNLIKELY, MAYBE, FEW_CHARS = 0.4, 0.6, 500
#: Names of parts that readers write. Their text is like an article's, so ratios can't tell it; such a part is left out unless it has most of the page's score.
COMMENTS = frozenset("comment comments reply replies respond disqus discussion".split())
#: Least score of content, whatever the other paths have: text that is all links has none.
LEAST = 1e-12
#: Share of the score that the region has which holds the article.
REGION = 0.9
#: Hidden elements that do not hold these: one that was never closed ends before them.
OPEN_ENDED = frozenset("select option button audio video canvas datalist".split())
NOT_INSIDE = "p|article|main|section|h[1-6]|ul|ol|table|blockquote|pre|header|footer|nav|form"

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^<>])*+)>|<[!?][^<>]*>", re.S)
HINT = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[a-z0-9]+")
#: The slash at the end of a tag's attributes is part of a value.
VALUE = re.compile(r"=\s*[^\s\"'>]*/\Z")
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[,.;:!?、。，！？¿¡…]")

Path = tuple[int, str]  # number of a root-to-leaf path, its last element


class Element(NamedTuple):
    """An element that is a block: the number of its parent (-1: none), its name, how much its own name weighs, and whether it tells of comments."""

    parent: int
    name: str
    weight: float
    comments: bool


class Block(NamedTuple):
    """A text between block tags, in page order: its path, its element (-1: none), the product of the weights around it, and characters in links."""

    path: Path
    element: int
    text: str
    weight: float
    linked: int


def _likely(name: str, hints: list[list[str]], inside: bool) -> float:
    """The weight of text in an element, by its name and its class, id and role: whole names weigh more than their first and last parts."""
    header = name == "header" or any("header" in (h[0], h[-1]) and not ARTICLE & set(h) for h in hints)
    if name in ASIDE or name == "form" or header and not inside or any(len(h) == 1 and h[0] in CHROME for h in hints):
        return UNLIKELY
    return MAYBE if name == "article" and inside or any(h[0] in CHROME or h[-1] in CHROME for h in hints) else 1.0


def _after_hidden(page: str, name: str, at: int) -> int:
    """Where a hidden element ends whose start tag ends at `at`; right there if it is not closed."""
    if name in RAW or name in OPEN_ENDED:
        c = re.compile(rf"</{name}\b[^<>]*>" + (rf"|(?=<(?:{NOT_INSIDE})\b)" if name in OPEN_ENDED else ""), re.I).search(page, at)
        return c.end() if c else len(page) if name in RAW else at
    depth, close, begin = 1, re.compile(rf"<(/?){name}\b[^<>]*>", re.I), at
    while depth:
        c = close.search(page, at)
        if not c:
            return begin
        depth += -1 if c[1] else not c[0].endswith("/>")
        at = c.end()
    return at


def blocks(page: str) -> tuple[list[Block], list[Element]]:
    """The texts of the page and its block elements, both in page order. A path is numbered by its elements' names and hints; only block elements make paths."""
    numbers: dict[tuple[int, str], int] = {}  # of a path, by that of its parent and the last name with its hints
    elements: list[Element] = []
    stack: list[tuple[str, int, float, int]] = []  # name, path, product of weights, element
    open_: Counter[str] = Counter()
    out, buffer, linked, link, inside = [], [], 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = SPACE.sub(" ", html.unescape("".join(buffer))).strip()
            if text:
                name, path, weight, element = stack[-1] if stack else ("", -1, 1.0, -1)
                out.append(Block((path, name), element, text, weight, linked))
            buffer.clear()
        linked = 0

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else end]
        if text:
            buffer.append(text)
            linked += len(text) * bool(link)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        closed = m[3].endswith("/") and not VALUE.search(m[3])
        if name in HIDDEN:
            if not m[1] and not closed:
                at = _after_hidden(page, name, at)
            buffer.append(" ")
        elif name in BLOCK:
            flush()
            link = 0
            if m[1] and open_[name]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        for x in stack[i:]:
                            open_[x[0]] -= 1
                            inside -= x[0] in INSIDE
                        del stack[i:]
                        break
            elif not m[1] and name not in VOID and not closed:
                while stack and stack[-1][0] in ("p", *HEADING) or stack and name == stack[-1][0] and name in ("li", "dd", "dt", "tr", "td", "th"):
                    open_[stack.pop()[0]] -= 1
                names = [w for h in HINT.finditer(m[3]) for w in (h[1] or h[2] or h[3] or "").lower().split()] if m[3] else []
                hints = [parts for w in names if (parts := PART.findall(w))]
                weight = 1.0 if name in ("html", "body") else _likely(name, hints, open_["article"] > 0 if name == "article" else inside > 0)
                _, above, product, parent = stack[-1] if stack else ("", -1, 1.0, -1)
                key = above, ".".join([name, *sorted({"-".join(h) for h in hints})])
                inside += name in INSIDE
                open_[name] += 1
                stack.append((name, numbers.setdefault(key, len(numbers)), max(weight * product, 0.01), len(elements)))
                elements.append(Element(parent, name, weight, any(h[0] in COMMENTS or h[-1] in COMMENTS for h in hints)))
        elif name == "a":
            link = 0 if m[1] else 1
        elif name in ("br", "img", "input"):
            buffer.append(" ")
    flush()
    return _weighed(out, elements), elements


def _weighed(parts: list[Block], elements: list[Element]) -> list[Block]:
    """Weights as they are used: on a page with one article element (but for those within it), text outside of it counts less; on pages with little text names count more."""
    inner = [False] * len(elements)
    for i, e in enumerate(elements):
        inner[i] = e.parent >= 0 and (inner[e.parent] or elements[e.parent].name == "article")
    outer = [i for i, e in enumerate(elements) if e.name == "article" and not inner[i]]
    if len(outer) == 1:
        parts = [p if p.element >= 0 and (inner[p.element] or p.element == outer[0]) else p._replace(weight=min(p.weight, MAYBE)) for p in parts]
    power = 1 + FEW_CHARS / max(1, sum((len(p.text) - min(p.linked, len(p.text))) * p.weight**2 for p in parts))
    return [p._replace(weight=max(p.weight**power, 1e-9)) for p in parts]


def path_scores(parts: list[Block], sigma: float = 1.0) -> dict[Path, float]:
    """The score of each path: its text per block and its punctuation per block, both smoothed, multiplied with each other, with the root of its
    share of all text, with what of its text is in no link, and with its weight, the product of its elements' weights. Smoothing is Gaussian, over the paths next to
    it in page order that have the same weight."""
    paths: dict[Path, list[float]] = {}
    for path, _, text, weight, linked in parts:
        p = paths.setdefault(path, [0, 0, 0, 0, weight])
        p[0] += 1
        p[1] += len(text)
        p[2] += len(PUNCTUATION.findall(text))
        p[3] += min(linked, len(text))
    values = list(paths.values())
    ratios = [(p[1] / p[0], (p[0] + p[2]) / p[0]) for p in values]
    near = [(d, math.exp(-d * d / (2 * sigma * sigma))) for d in (-1, 0, 1)]
    total = sum(p[1] for p in values)
    out = {}
    for i, (key, p) in enumerate(paths.items()):
        use = [(ratios[i + d], w) for d, w in near if 0 <= i + d < len(values) and values[i + d][4] == p[4]]
        whole = sum(w for _, w in use)
        text, signs = (sum(r[k] * w for r, w in use) / whole for k in range(2))
        out[key] = text * signs * math.sqrt(p[1] / total) * (1 - p[3] / p[1]) * p[4]
    return out


def _region(elements: list[Element], parts: list[Block], marks: list[float]) -> tuple[int, list[float]]:
    """(the element that holds the article, scores by element). From the page on, as long as one child has nearly all of the strong blocks' scores, it is the region; one that has a
    single block gives way to its parent, so that what stands beside the block belongs to it. -1 is the whole page, whose scores are the last."""
    inside, n_blocks = [0.0] * (len(elements) + 1), [0] * (len(elements) + 1)
    for p, mark in zip(parts, marks, strict=True):
        inside[p.element] += mark
        n_blocks[p.element] += 1
    for i in range(len(elements) - 1, -1, -1):  # children come after parents
        inside[elements[i].parent] += inside[i]
        n_blocks[elements[i].parent] += n_blocks[i]
    at = -1
    for i, e in enumerate(elements):
        if e.parent == at and inside[i] >= REGION * inside[-1] > 0:
            at = i
    while at >= 0 and n_blocks[at] < 2 and elements[at].name not in ("body", "html"):
        at = elements[at].parent
    return at, inside


def main_text(page: str | None, sigma: float = 1.0, threshold: float = 0.25) -> str:
    """The page's content blocks joined by line ends.

    Paths whose score (see `path_scores`) is at least `threshold` of the best one, and LEAST, are strong: their blocks are content. So is what shares the element that
    holds the strong text (see `_region`): lists, tables, quotes, captions, dates. Left out there are parts that a name speaks against, and blocks that are mostly links before the
    first strong block or after the last. If the region is the page's body, what stands directly in it counts only between strong blocks. Headings right before content
    belong to it. Strong text stays whatever the elements around it are called, but for parts called comments that have less than half of the page's score.
    """
    parts, elements = blocks(page or "")
    score = path_scores(parts, sigma)
    least = max(threshold * max(score.values(), default=0), LEAST)
    strong = [score[p.path] >= least for p in parts]
    region, inside = _region(elements, parts, [score[p.path] * s for p, s in zip(parts, strong, strict=True)])
    said = [False] * len(elements)  # by readers
    for i, e in enumerate(elements):
        said[i] = e.parent >= 0 and said[e.parent] or e.comments and 2 * inside[i] < inside[-1]
    # Of each element: is it in the region, does a name speak against it below the region, which is the nearest element around or of it with strong text.
    within, against, near = [False] * len(elements), [False] * len(elements), [-1] * len(elements)
    for i, (parent, _, weight, _) in enumerate(elements):
        within[i] = i == region or region < 0 or parent >= 0 and within[parent]
        against[i] = i != region and (weight < 1 or parent >= 0 and against[parent])
        if i == region:
            against[i] = False
        near[i] = i if inside[i] > 0 else near[parent] if parent >= 0 else -1
    page_wide = region < 0 or elements[region].name in ("body", "html")
    content = [s and (region < 0 or p.element >= 0 and within[p.element]) and not (p.element >= 0 and said[p.element]) for p, s in zip(parts, strong, strict=True)]
    at = [i for i, c in enumerate(content) if c]
    if not at:
        return ""
    for i, p in enumerate(parts):
        e = p.element
        if content[i] or not (region < 0 or e >= 0 and within[e]) or e >= 0 and (against[e] or said[e]):
            continue
        between = at[0] < i < at[-1]
        held = e >= 0 and near[e] >= 0 and elements[near[e]].name not in ("body", "html")
        content[i] = between or 2 * p.linked <= len(p.text) and (held or not page_wide)
    for i in range(len(parts) - 2, -1, -1):
        e = parts[i].element
        content[i] = content[i] or content[i + 1] and parts[i].path[1] in HEADING and not (e >= 0 and against[e] and parts[i].weight < parts[i + 1].weight)
    return "\n".join(p.text for p, c in zip(parts, content, strict=True) if c)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with `text`, the main text of the whole page, and `n_chars`, its code points; columns of these names are replaced, others stay.

    Null, empty and text-free pages give an empty text. Unclosed, misnested and unknown tags are read like browsers do, roughly.
    Very long pages are read whole; repeated rows give equal texts; paths with equal scores are all content or none is; an empty table gives an empty result.
    """

    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text(page: pd.Series) -> pd.Series:
        return page.map(main_text, na_action=None)

    made = fresh("text", pages)
    d = pages.select(*pages.columns, text(F.col(html_col)).alias(made))
    return d.select(*others(pages, ("text", "n_chars")), F.col(made).alias("text"), F.char_length(made).cast("long").alias("n_chars"))
