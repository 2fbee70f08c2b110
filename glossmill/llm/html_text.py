"""Main text of HTML pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative, with
weights learned from pages that label their content themselves; words inside menus,
footers, adverts, forms and the like score negative too. One linear scan finds the
contiguous stretch with the greatest sum. Its blocks are the text, without what
such containers inside it hold.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.llm.samples import by_least_hash

#: Labelled pages that weights are learned from: so many distinct ones, those whose hashes are least.
FIT_PAGES = 2_000
_LABELLED = r"(?i)<(?:article|main)[\s/>]"

# Elements of HTML by what they mean here.
HIDDEN = frozenset("script style template noscript iframe object svg math canvas audio video map head title select textarea button datalist".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
BOILERPLATE = frozenset("nav footer aside form dialog menu search".split())
CONTENT = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
# An opened one of these closes an open one that it cannot stand in, up to the container named.
CLOSES = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "option": ("option", "select datalist"),
}
CLOSES = {tag: (frozenset(shut.split()), frozenset(until.split())) for tag, (shut, until) in CLOSES.items()}
_PARAGRAPH, _NOTHING = frozenset(["p"]), frozenset()
# Words of class, id and role that name what is not the article, and what is.
_NOT_TEXT = re.compile(
    r"ads?|adverts?|advert\w+|adsense|sponsor\w*|promo\w*|banners?|sidebars?|menus?|nav(?:bars?|igations?|links?|menus?|lists?|s)?|breadcrumbs?|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?"
    r"|newsletters?|subscri\w+|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|respond|reply|replies|discussion"
    r"|footers?|foot|mastheads?|toolbars?|widgets?|pagination|pager|copyright|legal|disclaimer|complementary|contentinfo|navigation|skip|hidden"
)
_TEXT = re.compile(r"article|content|main|post|entry|story|body|text")
_COMMENT = re.compile(r"comments?|commentlist|disqus|respond|reply|replies|discussion")
_HEADERS = frozenset("header banner".split())
# With one of these a name says what a page has, not what an element is: "comments-open".
_FLAGS = frozenset(
    "has have is no not js with without open opened close closed enabled disabled on off allow allowed accept accepted dismissed active visible show shown".split()
)
# What may stand beside those in the name of an element that is no text: its form and its place. Any other word
# makes the name one of the text's own subject: "share-price", "legal-history", "navy-blue".
_FORM = re.compile(
    r"\d+|box(?:es)?|bars?|blocks?|lists?|items?|links?|icons?|buttons?|btns?|wrap\w*|container|section|area|region|zone|panel|pane|group|row|col\w*|cell|unit|slot"
    r"|content|inner|outer|top|bottom|left|right|middle|center|main|page|site|post|posts|article|articles|stories|story|news|form|field|input|text|title|head|heading|header"
    r"|primary|secondary|global|local|fixed|sticky|mobile|desktop|small|large|mini|more|my|the|js|ui|el|tools?|media|email|mail|letter|us|by|of|and|to|in|up|out|a|x|v"
    r"|google|facebook|twitter|rss|feed|tags?|cloud|meta|info|bio|author"
)
# Inside an article these name a chapter as well as what readers say.
_CHAPTERS = frozenset(["discussion"])
#: An element that names alone put outside holds the page's content if so many times all other words are in it.
NEARLY_ALL = 19

_TAG = re.compile(r"""<(?:!--(?:>|->|(?P<comment>))|(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>"'<]++|"[^"<]*+"|'[^'<]*+'|["'])*+)>?|[!?/][^>]*+>?)""")
_NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.IGNORECASE)
_HIDDEN_ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(?:hidden(?=$|[\s=/])|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

PLAIN, OUT, NEVER = 0, 1, 2


def _names_of(rest: str) -> list[list[str]]:
    """The class, id and role of a tag, each as its parts in lower case."""
    return [[p.lower() for p in _PARTS.findall(name)] for m in _NAMES.finditer(rest) for name in (m[2] or m[3] or m[4] or "").split()]


NAMED, COMMENT = 1, 2


def _named(tag: str, rest: str, in_content: bool) -> int:
    """Whether an element's names, or that it is a form, put it outside the article; and whether as a reader's comment."""
    if tag in ("html", "body"):
        return PLAIN
    if tag == "form":
        return NAMED
    for parts in _names_of(rest) if rest else ():
        named = [p for p in parts if _NOT_TEXT.fullmatch(p) or (p in _HEADERS and not in_content)]
        if not named or not _FLAGS.isdisjoint(parts):
            continue
        comment = any(_COMMENT.fullmatch(p) for p in parts)
        if not all(p in named or _FORM.fullmatch(p) or _TEXT.fullmatch(p) for p in parts):
            continue
        if in_content and len(parts) == 1 and parts[0] in _CHAPTERS:
            continue
        if comment or not any(_TEXT.fullmatch(p) for p in parts):
            return COMMENT if comment else NAMED
    return PLAIN


@dataclass(frozen=True, eq=False)
class Wrapper:
    """An element outside the article by its names only; ``number``: of the opened tag, ``key``: tells it and those around it by tag and attributes."""

    parent: Wrapper | None
    number: int
    key: int
    comment: bool


@dataclass(frozen=True, eq=False)
class Wrapped:
    """An ``article`` or ``main`` that names alone put outside."""

    by: Wrapper
    main: bool


@dataclass(frozen=True)
class Place:
    """Where an element stands; ``by`` is None where more than names put it outside."""

    state: int = PLAIN
    content: bool = False
    by: Wrapper | None = None
    wrapped: Wrapped | None = None

    def inner(self, tag: str, rest: str, number: int, wrappers: frozenset[int]) -> Place:
        if self.state == NEVER or tag in HIDDEN or (rest and _HIDDEN_ATTRIBUTE.search(rest)):
            return Place(NEVER, self.content)
        if (self.state == OUT and self.by is None) or (tag in BOILERPLATE and tag != "form") or (tag == "header" and not self.content):
            return Place(OUT, self.content)
        named = PLAIN if number in wrappers else _named(tag, rest, self.content)
        by, wrapped = self.by, self.wrapped
        if named:
            comment = named == COMMENT or (by is not None and by.comment)
            by, wrapped = Wrapper(by, number, hash((by and by.key, tag, rest)), comment), None
        if tag in CONTENT:
            if by is None:
                return self if self.content else Place(PLAIN, True)
            main = tag == "main" and not self.content
            if wrapped is None and (main or not by.comment):
                wrapped = Wrapped(by, main)
        if by is self.by and wrapped is self.wrapped:
            return self
        return Place(OUT, self.content, by, wrapped)


@dataclass(frozen=True)
class Token:
    """A tag, or text between tags; ``state`` and ``content`` say where it stands, ``wrapped`` in which element that names put outside."""

    tag: str | None
    text: str
    breaks: bool
    state: int
    content: bool
    wrapped: Wrapped | None = None
    by: Wrapper | None = None


def tokens(page: str, wrappers: frozenset[int] = frozenset()) -> Iterator[Token]:
    """Tags and text of a page, in order; broken markup is read as browsers roughly do, in linear time.

    The names of the opened tags numbered in ``wrappers`` do not count.
    """
    stack: list[tuple[str, Place]] = []
    page_itself, number = Place(), 0
    # How many of each are open, so that no close or block looks through a deep stack in vain.
    standing: Counter[str] = Counter()
    at, n, lower = 0, len(page), None

    def leave(depth: int) -> None:
        standing.subtract(t for t, _ in stack[depth:])
        del stack[depth:]

    def here() -> Place:
        return stack[-1][1] if stack else page_itself

    def top() -> tuple[int, bool, Wrapped | None, Wrapper | None]:
        place = here()
        return place.state, place.content, place.wrapped, place.by

    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at:
            yield Token(None, page[at:start], False, *top())
        if start == n:
            return
        m = _TAG.match(page, start)
        if m is None:
            yield Token(None, "<", False, *top())
            at = start + 1
            continue
        at = m.end()
        if m["comment"] is not None:
            end = page.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        if m["name"] is None:
            continue
        tag = m["name"].lower()
        if m["close"]:
            yield Token(tag, "", tag in BLOCKS, *top())
            if standing[tag] > 0:
                leave(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        # A block ends an open paragraph.
        shut, until = CLOSES.get(tag, (_PARAGRAPH, BLOCKS) if tag in BLOCKS else (_NOTHING, _NOTHING))
        if any(standing[t] > 0 for t in shut):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in shut:
                    leave(i)
                    break
                if stack[i][0] in until:
                    break
        yield Token(tag, "", tag in BLOCKS, *top())
        number += 1
        if tag in VOID:
            continue
        if tag in RAW:
            lower = lower or page.lower()
            # Lower-casing may change the length of rare letters; then search again without it.
            end = lower.find(f"</{tag}", at) if len(lower) == n else next((x.start() for x in re.finditer(f"</{tag}", page[at:], re.IGNORECASE)), -1 - at) + at
            if end < 0:
                end = n
            inner = here().inner(tag, m["rest"], number, wrappers)
            if end > at and inner.state != NEVER:
                yield Token(None, page[at:end], False, inner.state, inner.content, inner.wrapped, inner.by)
            close = page.find(">", end)
            at = n if close < 0 else close + 1
            yield Token(tag, "", tag in BLOCKS, *top())
            continue
        standing[tag] += 1
        stack.append((tag, here().inner(tag, m["rest"], number, wrappers)))


def _wrappers(stream: list[Token]) -> set[int]:
    """Elements that names put outside although they hold the page's content.

    Whatever holds a ``main`` with words does, and what holds an ``article`` that is no
    reader's comment and has more words than all that is plain. Articles in like
    elements go with it. On a page without either, an element that holds nearly all words does.
    """
    words: Counter[Wrapped] = Counter()
    outermost: Counter[Wrapper] = Counter()
    plain = 0
    for t in stream:
        if t.tag is not None:
            continue
        if t.wrapped is not None and t.state == OUT:
            words[t.wrapped] += len(t.text.split())
        elif t.state == PLAIN:
            plain += len(t.text.split())
        elif t.by is not None:
            by = t.by
            while by.parent is not None:
                by = by.parent
            outermost[by] += len(t.text.split())
    words += Counter()
    if not words:
        by, n = outermost.most_common(1)[0] if outermost else (None, 0)
        # No more words are asked for than that some are there.
        return {by.number} if by is not None and not by.comment and n > max(0, NEARLY_ALL * plain) else set()
    chosen = [w for w in words if w.main]
    if not chosen:
        most, n = words.most_common(1)[0]
        if n <= plain:
            return set()
        chosen = [most]
    keys, found = {w.by.key for w in chosen}, set()
    for w in words:
        by = w.by if w.by.key in keys else None
        while by is not None and by.number not in found:
            found.add(by.number)
            by = by.parent
    return found


def page_tokens(page: str) -> list[Token]:
    """Tags and text of a page, where names do not count of what holds the page's content.

    With each further reading the plain words are more than twice as many, or the first ``main`` has become content,
    or the names of one more element around nearly everything do not count.
    """
    wrappers: frozenset[int] = frozenset()
    while True:
        stream = list(tokens(page, wrappers))
        more = _wrappers(stream)
        if not more:
            return stream
        wrappers |= more


@dataclass(frozen=True)
class Weights:
    """``tag_costs``: of each tag; ``word``: of a word; ``outside``: of a word beside the page's own content element."""

    tag_costs: tuple[tuple[str, float], ...] = ()
    other_tag: float = 0.3
    word: float = 1.0
    outside: float = -1.0


def count_tags(page: str) -> dict[str, tuple[int, int]] | None:
    """Tags inside and outside the content element; None for a page without one."""
    counts: dict[str, list[int]] = {}
    labelled = False
    for token in page_tokens(page):
        if token.tag is None:
            labelled = labelled or (token.content and bool(token.text.strip()))
        elif token.tag not in CONTENT:
            counts.setdefault(token.tag, [0, 0])[0 if token.content and token.state == PLAIN else 1] += 1
    return {k: (i, o) for k, (i, o) in counts.items()} if labelled else None


def fit(pages: DataFrame, text: str = "html", rows: int = FIT_PAGES) -> Weights:
    """Tag costs from pages that hold an ``article`` or ``main`` element with text.

    ``rows`` of them, chosen by their hash. A tag costs the more, the more it
    stands outside content: from 0.02 to 1. Known names of HTML are learned, so what
    is gathered does not grow with the pages. Without labelled pages all tags cost
    the same.
    """
    known = frozenset(BLOCKS | VOID | HIDDEN | frozenset("a abbr b bdi bdo cite code del dfn em i ins kbd label mark q s samp small span strong sub sup time u var".split()))

    @F.arrow_udf("array<struct<tag:string,inside:bigint,outside:bigint>>")
    def counted(texts):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("tag", pa.string()), ("inside", pa.int64()), ("outside", pa.int64())]))
        out = []
        for t in texts.to_pylist():
            found = count_tags(t or "") or {}
            out.append([{"tag": k, "inside": i, "outside": o} for k, (i, o) in found.items() if k in known])
        return pa.array(out, kind)

    labelled = pages.select(F.col(text).alias("page")).filter(F.col("page").rlike(_LABELLED))
    sample = by_least_hash(labelled, "page", rows)
    counts = sample.select(F.explode(counted("page")).alias("c")).groupBy("c.tag").agg(F.sum("c.inside").alias("i"), F.sum("c.outside").alias("o"))
    costs = []
    for r in counts.collect():
        odds = math.log((r["o"] + 1) / (r["i"] + 1))
        costs.append((r["tag"], round(min(1.0, max(0.02, 0.3 + 0.25 * odds)), 4)))
    return Weights(tuple(sorted(costs)))


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """The contiguous stretch with the greatest sum, ``[first, end)``: the first and longest of equals, empty if none is positive."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or (total == best and best > 0 and start == span[0]):
            best, span = total, (start, i + 1)
    return span


def extract(page: str | None, weights: Weights) -> str:
    """The main text: blocks in page order, two line ends between them."""
    stream = page_tokens(page or "")
    has_content = any(t.content and t.tag is None and t.state == PLAIN and t.text.strip() for t in stream)
    costs = dict(weights.tag_costs)
    scores = []
    for t in stream:
        if t.tag is not None:
            scores.append(0.0 if t.tag in CONTENT else -costs.get(t.tag, weights.other_tag) * (0.02 if t.content else 1.0))
            continue
        n = len(t.text.split())
        if t.state != PLAIN:
            scores.append(-math.log1p(n) * (0.01 if t.content else 1.0))
        elif has_content and not t.content:
            scores.append(weights.outside * n)
        else:
            scores.append(weights.word * n)
    first, end = best_stretch(scores)
    blocks, block = [], []
    for t in stream[first:end]:
        if t.tag is not None:
            if t.breaks:
                blocks.append(block)
                block = []
            elif t.tag == "br":
                block.append(" ")
        elif t.state == PLAIN:
            block.append(t.text)
    texts = (" ".join(html.unescape("".join(b)).split()) for b in [*blocks, block])
    return "\n\n".join(t for t in texts if t)


def main_text(text: Column, weights: Weights) -> Column:
    """The main text of each page; empty for a null or empty page, and where there is none."""

    @F.arrow_udf("string")
    def extracted(texts):
        import pyarrow as pa

        return pa.array([extract(t, weights) for t in texts.to_pylist()], pa.string())

    return extracted(text)
