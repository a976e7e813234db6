"""Main text of HTML pages by tag-path ratios.

A page is read once into blocks of text, each with its path of open elements from the root to the leaf. For every
path the text length, punctuation, link text and number of blocks are summed. A path's score is its length ratio (characters per
block) times its punctuation ratio, fused with the share of its text that isn't link text. Scores are smoothed along the page with a
Gaussian that ends at the edges of articles, averaged per path again, and paths at or above the threshold, a share of the page's mean and
standard deviation, are content; lists of links never are. By element name, role or style, menus, footers, forms, dialogs and what can't be
seen never count. Class words for such parts, notices, adverts and comments cut a path's score to WORD_FACTOR (see `voided` for where they don't). An article or main element lowers the threshold for its own text (see `raised`), so that
short articles, headings and tables stay, while a story outside them stays by its score and teasers in article elements fall by theirs.

Cases with a defined result: a null or empty page and a page without text give an empty text; unclosed elements, comments and
scripts end with the page; stray brackets are text; repeated rows get equal results; page_id and url may be null.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import per_text

# Element kinds of HTML and words that name parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template title textarea iframe object svg canvas math select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span "
                   "strike strong sub sup time tt u var wbr img nobr".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
                     "main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
APART = frozenset("nav footer header aside form button menu dialog fieldset input option datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
                  "notices alert popup modal overlay comment comments disqus respond replies sidebar widget widgets menu nav navbar navigation "
                  "breadcrumb breadcrumbs pagination pager footer header masthead toolbar share sharing social related recommended "
                  "newsletter subscribe subscription signup login search form".split())

# A class with such a word is about the layout: no-sidebar, has-sidebar, page-with-comments.
LAYOUT = frozenset("no not non without has have with".split())
# An article of such a class is a card that points to another page.
CARDS = frozenset("teaser teasers card cards more promo".split())

SMOOTHING, REACH = 1.0, 2
THRESHOLD = 0.25
RAISE = 0.999
WORD_FACTOR = 0.005
ARTICLE_WEIGHT = 10.0
LINK_SHARE = 0.6
MARKS = frozenset(".,;:!?…。、，！？；：")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Element:
    tag: str
    path: int
    inside: bool        # within an article
    zone: int           # number of the innermost article or main element, 0 outside; a card has a negative one
    apart: bool         # within a part that never counts
    words: tuple[int, ...]      # paths of the elements around, itself included, that have class words
    outer: int          # how many of them stand around the zone
    heading: bool
    link: bool


@dataclass
class Block:
    path: int
    zone: int
    words: tuple[int, ...]
    own: bool           # in an article or main element, no class words in between
    parts: list[str] = field(default_factory=list)
    linked: int = 0


def _marked(tag: str, attributes: str) -> tuple[bool, bool, bool, bool, str]:
    """(never counts, is the main part, is a card, has words of other parts, class words) by the element's attributes."""
    apart, main, card, worded, label = False, tag == "main", False, False, ""
    if attributes.strip():
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), html.unescape(a or b or c)
            if name in ("class", "id"):
                words = {w.lower() for w in _WORD.findall(value)}
                label += "." + "-".join(sorted(words))
                named = [{w.lower() for w in _WORD.findall(c)} for c in value.split()]
                meant = set().union(*[c for c in named if not c & LAYOUT])
                # the page itself may carry such words
                if tag == "article":
                    worded |= bool(meant & {"comment", "comments", "ad", "advert", "sponsored", "related"})
                    card |= worded or bool(words & CARDS)
                elif tag not in ("html", "body", "main"):
                    worded |= bool(meant & WORDS)
            elif name == "role":
                apart |= value.lower() in ROLES
                main |= value.lower() == "main"
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                apart = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                apart = True
    return apart, main, card, worded, label


def blocks(page: str) -> list[Block]:
    """The blocks of text of a page in order, without the parts that never count."""
    paths: dict[tuple[int, str], int] = {}
    root = Element("", 0, False, 0, False, (), 0, False, False)
    stack, out = [root], []
    block: Block | None = None
    zones = 0

    def add(text: str) -> None:
        nonlocal block
        top = stack[-1]
        if top.apart and not (top.heading and top.inside):
            return
        text = html.unescape(text)
        if block is None:
            if not text.strip():
                return
            block = Block(top.path, top.zone, top.words, top.zone > 0 and len(top.words) == top.outer)
            out.append(block)
        block.parts.append(text)
        if top.link:
            block.linked += len(text.strip())

    at = 0
    for token in iter(lambda: _TOKEN.search(page, at), None):
        if token.start() > at:
            add(page[at:token.start()])
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            block = None
        if token[1]:
            if any(e.tag == tag for e in stack[:0:-1]):
                while stack.pop().tag != tag:
                    pass
            continue
        if tag in SKIPPED:
            if not token[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P or tag in ("li", "tr", "td", "th", "dt", "dd", "option"):
            closed = {"p"} if tag in CLOSES_P else {"li"} if tag == "li" else {"dt", "dd"} if tag in ("dt", "dd") else {tag, "td", "th"} \
                if tag == "tr" else {"td", "th"} if tag in ("td", "th") else {"option"}
            limit = {"ul", "ol", "table", "dl", "article", "section", "div", "body"} - closed
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closed:
                    del stack[i:]
                    break
                if stack[i].tag in limit:
                    break
        up = stack[-1]
        apart, main, card, worded, label = _marked(tag, token[3])
        apart |= tag in APART or up.apart
        path = paths.setdefault((up.path, tag + label), len(paths) + 1)
        # a headline stands in a header of its article; other parts of such a header don't count
        heading = tag in HEADINGS or up.heading
        in_header = up.tag == "header" and up.inside and not any(e.apart for e in stack[:-1])
        if tag in HEADINGS and in_header:
            apart = False
        zone, outer, words = up.zone, up.outer, up.words + (path,) if worded else up.words
        if (main or tag == "article") and not apart:
            zones += 1
            zone, outer = -zones if card else zones, len(up.words)
        if not token[3].endswith("/"):
            stack.append(Element(tag, path, up.inside or tag == "article" and not apart, zone, apart, words, outer,
                                 heading, up.link or tag == "a"))
    if at < len(page):
        add(page[at:])
    return out


def raised(weights: list[tuple[int, float]]) -> dict[int, float]:
    """How far each article or main element lowers the threshold of its own text, from 0 to RAISE, by the (zone, punctuated text) of the blocks.

    An element counts by its text against the largest of them. All together count by their share of the page, but one that stands alone
    counts in full: a short article beside other text is the page's article, several small ones beside a story are teasers.
    """
    held: dict[int, float] = {}
    for zone, weight in weights:
        if zone > 0:
            held[zone] = held.get(zone, 0.0) + weight
    largest, total = max(held.values(), default=0.0), sum(weight for _, weight in weights)
    if not largest:
        return {}
    trust = max(sum(held.values()) / total, 1 / len(held) ** 2)
    return {zone: RAISE * trust * weight / largest for zone, weight in held.items()}


def voided(found: list[tuple[Block, float]]) -> set[int]:
    """Paths of elements whose class words don't count, by the punctuated text of the blocks (other text counts a tenth).

    They stand around the article, main element or path that holds most of it, or hold more than half of it themselves; text of an article or main element counts
    ARTICLE_WEIGHT-fold, so that no long thread of comments takes the place of an article.
    """
    units: dict[tuple[bool, int], float] = {}
    below: dict[int, float] = {}
    around: dict[tuple[bool, int], tuple[int, ...]] = {}
    for b, weight in found:
        weight *= ARTICLE_WEIGHT if b.own else 1.0
        unit = (b.own, b.zone if b.own else b.path)
        units[unit] = units.get(unit, 0.0) + weight
        around[unit] = b.words
        for path in b.words:
            below[path] = below.get(path, 0.0) + weight
    half = sum(units.values()) / 2
    return set(around[max(units, key=units.__getitem__)]) | {path for path, weight in below.items() if weight > half}


def content(page: str | None) -> str:
    """The main text of a page."""
    found = [(b, " ".join("".join(b.parts).split())) for b in blocks(page)] if page else []
    found = [(b, text) for b, text in found if text]
    if not found:
        return ""
    sums: dict[int, list[float]] = {}
    held, plain = [], []
    for b, text in found:
        marks, links = sum(map(MARKS.__contains__, text)), min(b.linked, len(text))
        plain.append((b, (len(text) - links) * (1.0 if marks else 0.1)))
        held.append((1.0 + marks) * (len(text) - links))
        entry = sums.setdefault(b.path, [0.0, 0.0, 0.0, 0.0])
        for i, value in enumerate((1, len(text), marks, links)):
            entry[i] += value
    void = voided(plain)
    other = {b.path for b, _ in found if not void.issuperset(b.words)}
    linked = {p: l / chars for p, (_, chars, _, l) in sums.items()}
    fused = {p: chars / n * (1 + marks / n) * (1 - linked[p]) for p, (n, chars, marks, _) in sums.items()}
    lists = {p for p, (n, _, _, _) in sums.items() if n >= 3 and linked[p] > LINK_SHARE}
    weights = [math.exp(-d * d / (2 * SMOOTHING * SMOOTHING)) for d in range(REACH + 1)]
    series = [fused[b.path] for b, _ in found]
    smooth: dict[int, list[float]] = {}
    for i, (b, _) in enumerate(found):
        near = [(weights[abs(j - i)], series[j]) for j in range(max(0, i - REACH), min(len(found), i + REACH + 1)) if found[j][0].zone == b.zone]
        smooth.setdefault(b.path, []).append(sum(w * s for w, s in near) / sum(w for w, _ in near))
    score = {p: sum(v) / len(v) * (WORD_FACTOR if p in other else 1.0) for p, v in smooth.items()}
    values = [score[b.path] for b, _ in found if b.path not in other]
    mean = sum(values) / len(values)
    spread = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    limit = THRESHOLD * (mean + spread)
    zones = [0 if b.path in other else b.zone for b, _ in found]
    lower = raised(list(zip(zones, held)))
    return "\n".join(text for (b, text), zone in zip(found, zones)
                     if score[b.path] >= limit * (1 - lower.get(zone, 0.0)) and b.path not in lists)


def extracted(pages: DataFrame, *, html_column: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """All columns but the page itself, with its main text and the text's code points; columns of these names are replaced."""
    rows = pages.drop(*[c for c in pages.columns if c.lower() in (text.lower(), n_chars.lower())])
    kept = [f for f in rows.schema.fields if f.name.lower() != html_column.lower()]

    def each(part: pd.DataFrame) -> pd.DataFrame:
        out = part[[f.name for f in kept]].copy()
        out[text] = [content(p if isinstance(p, str) else None) for p in part[html_column]]
        return out

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    made = rows.mapInPandas(lambda batches: per_text(batches, each), f"{fields}`{text}` string")
    return made.withColumn(n_chars, F.length(text).cast("long"))
