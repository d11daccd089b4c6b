"""Main text of web pages by two passes of block rules.

A page is read as a sequence of blocks, the runs of text between block-level
tags. The first pass looks at each block alone: how much of it is link text,
how long it is, how many of its words are stop words, and whether it stands in
an article or main element. It calls a block good or bad, or leaves it open.
The second pass gives open blocks the label of decided ones near them. Where
the page's language has no stop words here, length and the end of a sentence
stand in for them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT_CHARS = 70
LONG_CHARS = 200
LINK_SHARE = 0.5
STOP_SHARE = 0.08

# Frequent function words of the languages in use.
STOP_WORDS = frozenset(
    """
    a an and are as at be but by for from has have he her his i in is it its not of on or she that the their they this
    to was we were which will with you
    aber als am an auch auf aus bei das dem den der des die durch ein eine einen er es für hat ich im in ist mit nach
    nicht oder sich sie sind und von war wie wird zu
    au aux avec ce ces dans de des du elle en est et il ils la le les mais ne nous on ou par pas pour que qui sa se ses
    son sur un une vous
    al como con de del el ella en es esta este ha la las lo los más no o para pero por que se ser su sus un una y
    """.split()
)

SENTENCE_END = tuple(".!?…:。！？।॥؟۔")
WIDE = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\uff00-\uffef]")  # letters that say as much as two

# Element names.
BLOCKS = frozenset(
    """
    address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre
    search section select summary table tbody td tfoot th thead title tr ul
    """.split()
)
UNREAD = frozenset(
    "head iframe math noembed noframes noscript object script select style svg template textarea title".split()
)
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
APART = frozenset("aside button dialog fieldset footer form menu nav search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
APART_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
_NAMES = (
    r"ads?|advert\w*|banner|breadcrumbs?|consent|cookies?|footer|header|hidden|login|masthead|menu|modal|nav|navbar|"
    r"navigation|newsletter|notices?|notification|pagination|popup|promo\w*|related|share|sharing|sidebar|signup|social|"
    r"sponsor\w*|subscribe|toolbar|widgets?"
)
_REPLIES = r"comments?|comment-?list|disqus|replies|respond"
# A whole class or id, or one of the usual compounds; "_" and "--" count as "-".
APART_NAMES = re.compile(
    rf"(?:{_NAMES})|(?:site|global|top)-(?:header|banner|bar)|(?:site|page|global|main|bottom)-footer|"
    r"(?:site|main|top|global|primary|secondary|mobile|side|footer|header)-(?:nav|navbar|navigation|menu)|"
    r"(?:left|right|primary|secondary|page|site|main)-sidebar|"
    r"(?:ads?|advert\w*|banner|breadcrumbs?|consent|cookies?|gdpr|login|menu|modal|nav|newsletter|notification|"
    r"pagination|popup|promo\w*|related|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|widget|footer)-"
    r"(?:area|banner|bar|block|box|buttons?|consent|container|content|form|icons?|inner|items?|links?|list|menu|message|"
    r"modal|notice|nav|overlay|panel|popup|posts?|articles|section|signup|slot|unit|widgets?|wrap|wrapper)"
)
REPLY_NAMES = re.compile(rf"(?:{_REPLIES})|(?:comments?|disqus|replies)-(?:area|box|container|form|section|thread|wrap|wrapper)")


@dataclass(eq=False)
class Named:
    """An element whose name says that it holds something else than the main text."""

    replies: bool
    chars: int = 0  # outside links


@dataclass(eq=False)
class Area:
    """An article or main element, and the named elements that it is in."""

    tag: str
    around: tuple[Named, ...]
    chars: int = 0


@lru_cache(maxsize=4096)
def _named(names: str) -> str:
    """What a class and id say: "apart", "replies" or nothing."""
    tokens = [re.sub("[_-]+", "-", x).strip("-") for x in names.lower().split()]
    if any(REPLY_NAMES.fullmatch(x) for x in tokens):
        return "replies"
    return "apart" if any(APART_NAMES.fullmatch(x) for x in tokens) else ""


@dataclass
class Block:
    tag: str
    inside: bool  # of an article or main element
    apart: bool  # in navigation, a form, a side column and the like
    named: tuple[Named, ...] = ()  # elements that it is in
    areas: tuple[Area, ...] = ()
    pieces: list[str] = field(default_factory=list)
    link_chars: int = 0


class _Reader(HTMLParser):
    """Blocks of one page in order; character references are decoded."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # tag, whether it is a link, unread, apart, named elements and areas around
        self.open: list[tuple[str, bool, bool, bool, tuple[Named, ...], tuple[Area, ...]]] = []
        self.areas: list[Area] = []
        self.blocks: list[Block] = []
        self.block: Block | None = None
        self.links = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A marked section that is none of the known ones is a comment up to the next ">"."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def _state(self) -> tuple[bool, bool, tuple[Named, ...], tuple[Area, ...]]:
        return self.open[-1][2:] if self.open else (False, False, (), ())

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._end_head(tag)
        if tag == "a":
            self._end_link()
        if tag in BLOCKS:
            self.block = None
            self._close_implied(tag)
        elif tag == "br" and self.block:
            self.block.pieces.append(" ")
        if tag in VOID:
            return
        unread, apart, named, areas = self._state()
        values = dict(attrs)
        role = (values.get("role") or "").lower()
        apart = apart or tag in APART or role in APART_ROLES
        apart = apart or "hidden" in values or values.get("aria-hidden") == "true"
        apart = apart or tag == "header" and not areas
        area = next((x for x in ("article", "main") if x in (tag, role)), "")
        kind = _named(f"{values.get('class') or ''} {values.get('id') or ''}") if tag not in ("html", "body") else ""
        # an article may be named for its tags and flags, unless it is a reader's
        nested = any(x.tag == "article" for x in areas)
        if kind and (not area or area == "article" and (nested or kind == "replies")):
            named = (*named, Named(kind == "replies"))
        if area:
            areas = (*areas, Area(area, named))
            self.areas.append(areas[-1])
        link = tag == "a" and values.get("href") is not None
        self.open.append((tag, link, unread or tag in UNREAD, apart, named, areas))
        self.links += link

    def _end_head(self, tag: str) -> None:
        """An open head ends, with all in it, where the body or anything else that it cannot hold begins."""
        if tag in IN_HEAD:
            return
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name == "head":
                self.block = None
                self._close(k)
                break
            if name == "body" or name in UNREAD and tag != "body":
                break

    def _end_link(self) -> None:
        """An anchor ends where the next begins; what was opened in it stays open."""
        for k in range(len(self.open) - 1, -1, -1):
            name, link = self.open[k][:2]
            if name == "a":
                self.links -= link
                del self.open[k]
            if name in ("a", "td", "th", "caption"):
                break

    def _close_implied(self, tag: str) -> None:
        """A paragraph ends where a block begins; an item where the next does."""
        top = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name == "p" or name in top.get(tag, ()):
                self._close(k)
            elif name in BLOCKS:
                break

    def _close(self, k: int) -> None:
        self.links -= sum(x[1] for x in self.open[k:])
        del self.open[k:]

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.block = None
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._close(k)
                break
            # an inline element doesn't end the block around it
            if tag not in BLOCKS and self.open[k][0] in BLOCKS:
                break

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and not data.isspace():
            self._end_head("")
        unread, apart, named, areas = self._state()
        if unread:
            return
        if self.block is None:
            if data.isspace():
                return
            tag = next((x[0] for x in reversed(self.open) if x[0] in BLOCKS), "body")
            self.block = Block(tag, bool(areas), apart, named, areas)
            self.blocks.append(self.block)
        self.block.pieces.append(data)
        if self.links:
            self.block.link_chars += len("".join(data.split()))


def _cut_by_name(reader: _Reader) -> None:
    """Blocks in named elements are apart, unless the element holds the article, main or most of the text.

    Replies that are longer than the text they answer are still replies: they
    are the text only where little else is left. Beside an article or main with
    text, the element has to be long.
    """
    whole = 0
    for block in reader.blocks:
        if not block.apart:
            chars = len("".join("".join(block.pieces).split())) - block.link_chars
            whole += chars
            for x in (*block.named, *block.areas):
                x.chars += chars
    articles = [x for x in reader.areas if x.tag == "article" and x.chars]
    articles = [x for x in articles if not any(n.replies for n in x.around)] or articles
    around = [x for x in reader.areas if x.tag == "main" and x.chars]
    if articles:
        around.append(max(articles, key=lambda x: x.chars))
    free = {n for x in around for n in x.around}
    for block in reader.blocks:
        for n in block.named:
            most = 2 * n.chars > whole and (not n.replies or whole - n.chars < LONG_CHARS)
            most = most and (bool(block.areas) or not around or n.chars >= LONG_CHARS)
            block.apart = block.apart or not (n in free or most)


@dataclass
class Page:
    """What the whole page says about its blocks."""

    article: bool  # most of its text stands in article and main elements
    known: bool  # its language has stop words here


def _stops(text: str) -> tuple[int, int]:
    """Stop words, and all words."""
    words = text.lower().split()
    return sum(word.strip(".,;:!?()\"'") in STOP_WORDS for word in words), len(words)


def _linked(block: Block, text: str) -> bool:
    return block.link_chars > LINK_SHARE * len("".join(text.split()))


def _width(text: str) -> int:
    return len(text) + (0 if text.isascii() else len(WIDE.findall(text)))


def _seen(blocks: list[tuple[Block, str]]) -> Page:
    inside = outside = stops = words = 0
    for block, text in blocks:
        if not block.apart and _width(text) >= SHORT_CHARS and not _linked(block, text):
            inside, outside = inside + len(text) * block.inside, outside + len(text) * (not block.inside)
            found, n = _stops(text)
            stops, words = stops + found, words + n
    article = (inside >= outside or outside < LONG_CHARS) and any(block.inside and not block.apart for block, _ in blocks)
    return Page(article, words > 0 and 2 * stops >= STOP_SHARE * words)


def _decide(block: Block, text: str, page: Page) -> bool | None:
    """Good, bad or open, by the block and its page."""
    if block.apart or _linked(block, text):
        return False
    width = _width(text)
    if width < SHORT_CHARS:
        return None
    stops, words = _stops(text)
    strayed = page.article and not block.inside
    if stops >= STOP_SHARE * words:
        return None if strayed and width < LONG_CHARS else True
    if page.known or strayed:
        return None
    return True if width >= LONG_CHARS or text.endswith(SENTENCE_END) else None


def _near(labels: list[bool | None]) -> list[tuple[tuple[int, bool] | None, tuple[int, bool] | None]]:
    """Of each place, the nearest decided places up to it and from it on, with their labels."""
    before, last = [], None
    for k, label in enumerate(labels):
        last = (k, label) if label is not None else last
        before.append(last)
    after, last = [], None
    for k in range(len(labels) - 1, -1, -1):
        last = (k, labels[k]) if labels[k] is not None else last
        after.append(last)
    return list(zip(before, reversed(after), strict=True))


def _by_nearest(blocks: list[tuple[Block, str]], labels: list[bool | None], alone: bool) -> list[bool]:
    """The label of the nearest decided block; of two as near, a heading takes the later one."""
    found = []
    for k, ((block, _), label, near) in enumerate(zip(blocks, labels, _near(labels), strict=True)):
        if label is None:
            sides = [(abs(x[0] - k), block.tag not in HEADINGS if x[0] > k else block.tag in HEADINGS, x[1]) for x in near if x]
            label = min(sides)[2] if sides else alone
        found.append(label)
    return found


def _in_article(blocks: list[tuple[Block, str]], labels: list[bool | None]) -> list[bool]:
    """In an article, whose ends count as good, short open runs between two bad blocks are bad.

    A heading stays wherever good text follows before the next heading that is not below it.
    """
    found = [label is not False for label in labels]
    widths = [0, *accumulate(_width(text) for _, text in blocks)]
    for k, (left, right) in enumerate(_near(labels)):
        if labels[k] is None and left and right and not left[1] and not right[1]:
            run = widths[right[0]] - widths[left[0] + 1]
            found[k] = run >= SHORT_CHARS or blocks[k][0].tag in HEADINGS and _leads(blocks, labels, k)
    return found


def _leads(blocks: list[tuple[Block, str]], labels: list[bool | None], k: int) -> bool:
    own = blocks[k][0].tag
    for (block, _), label in zip(blocks[k + 1 :], labels[k + 1 :], strict=True):
        if label or block.tag in HEADINGS and block.tag <= own:
            return bool(label)
    return False


def main_text(html: str) -> str:
    """The good blocks of a page, joined by an empty line."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    _cut_by_name(reader)
    blocks = [(block, " ".join("".join(block.pieces).split())) for block in reader.blocks]
    blocks = [(block, text) for block, text in blocks if text]
    page = _seen(blocks)
    labels = [_decide(block, text, page) for block, text in blocks]
    if True not in labels:
        labels = [True if label is None and _width(text) >= LONG_CHARS else label for (_, text), label in zip(blocks, labels, strict=True)]
    if not page.article:
        good = _by_nearest(blocks, labels, alone=True)
    else:
        good = [False] * len(blocks)
        for inside in (True, False):
            # what is apart doesn't stand in the article's text
            own = [k for k, (block, _) in enumerate(blocks) if block.inside == inside and not (inside and block.apart)]
            part, given = [blocks[k] for k in own], [labels[k] for k in own]
            for k, label in zip(own, _in_article(part, given) if inside else _by_nearest(part, given, alone=False), strict=True):
                good[k] = label
    return "\n\n".join(text for (_, text), label in zip(blocks, good, strict=True) if label)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html.as_py() or "") for html in batch.column("html")]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text"])


def extract_text(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row for each page row: page_id, url, text, n_chars.

    Blocks of the main text in page order, white space inside each as one
    space, joined by two newlines; ``n_chars`` counts code points. NULL and
    empty pages, and pages without main text, have the empty text. Repeated
    rows and NULL ids and urls stay; other columns are not read.
    """
    frame = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kinds = dict(frame.dtypes)
    found = frame.mapInArrow(_texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
