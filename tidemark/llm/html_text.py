"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Blocks inside menus, headers,
footers, asides and the like are dropped at once and take no part. So are those of
wrappers, which are forms and their parts and elements with a boilerplate word in
their class, id or role, unless the wrapper is released: it holds most of the page's
good text, or an article, main or h1 where no good text of that kind stands outside
all wrappers. A wrapper with a name made of boilerplate words alone is only released
where no good text and no article stands outside. A form with an article is always released, and
any form where nothing stands outside. A wrapper inside another needs both released.

Pass 1 looks at each remaining block on its own: a block whose text is mostly
links is bad; a long one with many stop words is good; a page that marks its
article (``article``, ``main`` with at least half of the good text or of the text
outside links) has no good blocks outside it; everything else,
such as short blocks, is ambiguous. Pass 2 gives every ambiguous block the label
of the nearest decided block, on a tie the good one; where nothing of its kind is
decided it is kept, so that a page of one short paragraph keeps its text.

All steps are linear in the page. Defined results: null and empty pages give the
empty text; unclosed comments, scripts and elements end with the page; stray end
tags are ignored; character references are decoded; inside a block every run of
white space becomes one space; rows that repeat are extracted one by one.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.llm.common import text_of

LONG = 70  # characters from which a block can be decided by its words
MAX_LINKS = 0.5
MIN_STOP_WORDS = 0.2

# A quote opens a value only right after "=" and white space, as in a browser.
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*))*+)>?",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([A-Za-z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

RAW = frozenset(("script", "style", "textarea", "title", "xmp", "noframes", "iframe", "noembed"))
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main"
    " menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
DROPPED = frozenset(
    "head nav footer aside noscript template svg math object select dialog menu canvas"
    " audio video datalist option".split()
)
FORMS = frozenset(("form", "fieldset", "button", "label"))
HEADER = frozenset(("header",))
ENDS_ITSELF = {
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "td", "th")),
    "td": frozenset(("td", "th")),
    "th": frozenset(("td", "th")),
}
SCOPES = frozenset(("ul", "ol", "dl", "table", "article", "main", "section", "div", "body"))

# Words of class, id and role names that mark what is not the article.
BOILERPLATE = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promoted promotion"
    " banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe"
    " subscription signup login search sidebar complementary menu navbar nav navigation breadcrumb"
    " breadcrumbs pagination footer contentinfo masthead topbar toolbar comment comments"
    " commentlist disqus respond replies share sharing social related recommended recommendations"
    " teaser widget copyright".split()
)
ARTICLE_BOILERPLATE = frozenset(
    "ad ads advert advertisement sponsored promo comment comments related teaser".split()
)

# Frequent function words of the four languages of the corpus.
STOP_WORDS = frozenset(
    # English
    "the of and to in is that was for it with as on by at from are this be or an a not"
    # French
    " de la le et les des en un une du est que qui dans pour par sur pas au avec"
    # German
    " der die und den das von zu mit sich auf ist im dem nicht ein eine als auch"
    # Spanish
    " el los del las se por con su para al lo como y".split()
)


@dataclass
class _Open:
    tag: str
    dropped: bool
    main: bool
    header: bool
    wrapper: int = -1


@dataclass
class _Wrapper:
    """An element that is dropped unless its content speaks for it; ``outer`` is -1 at the top."""

    outer: int
    tag: str
    sure: bool
    article: bool = False
    heading: bool = False
    good: int = 0


@dataclass
class _Block:
    text: str
    linked: int
    main: bool
    wrapper: int = -1


@dataclass
class _Page:
    """Blocks and wrappers so far, and the block (parts by wrapper) and elements that are open."""

    blocks: list[_Block] = field(default_factory=list)
    wrappers: list[_Wrapper] = field(default_factory=list)
    open: list[_Open] = field(default_factory=list)
    count: Counter[str] = field(default_factory=Counter)  # open elements by tag
    parts: dict[int, list[str]] = field(default_factory=dict)
    linked: dict[int, int] = field(default_factory=dict)
    in_link: bool = False
    heading: bool = False

    def text(self, raw: str) -> None:
        if raw and not self._hidden():
            decoded = html.unescape(raw)
            wrapper = self._wrapper()
            self.parts.setdefault(wrapper, []).append(decoded)
            if self.in_link:
                self.linked[wrapper] = self.linked.get(wrapper, 0) + len(decoded.strip())

    def _wrapper(self) -> int:
        return self.open[-1].wrapper if self.open else -1

    def _hidden(self) -> bool:
        if not self.open:
            return False
        inner = self.open[-1]
        return inner.dropped or (inner.header and not (inner.main and self.heading))

    def finish(self) -> None:
        main = bool(self.open) and self.open[-1].main
        for wrapper, parts in self.parts.items():
            text = " ".join("".join(parts).split())
            if text:
                self.blocks.append(_Block(text, self.linked.get(wrapper, 0), main, wrapper))
        self.parts, self.linked = {}, {}

    def start(self, tag: str, rest: str) -> None:
        if tag in BLOCK:
            self.finish()
            self.in_link = False
            self._close_implied(tag)
            self.heading = tag in HEADINGS
        if tag == "br":
            self.parts.setdefault(self._wrapper(), []).append("\n")
        if tag == "a":
            self.in_link = True
        if tag in VOID:
            return
        attributes = _attributes(rest) if "=" in rest or "hidden" in rest else {}
        dropped = tag in DROPPED or _unseen(tag, attributes)
        words = [] if dropped else _marking_names(tag, attributes)
        wraps = not dropped and (tag in FORMS or bool(words))
        if tag in BLOCK or dropped or wraps:
            outer = self.open[-1] if self.open else _Open("", False, False, False)
            main = tag in ("article", "main") or attributes.get("role") == "main"
            wrapper = outer.wrapper
            if wraps and not outer.dropped:
                self.wrappers.append(_Wrapper(wrapper, tag, any(words)))
                wrapper = len(self.wrappers) - 1
            elif wrapper >= 0 and not outer.dropped and not dropped:
                self.wrappers[wrapper].article |= main
                self.wrappers[wrapper].heading |= tag == "h1" and (outer.main or not outer.header)
            self.count[tag] += 1
            self.open.append(
                _Open(tag, outer.dropped or dropped, outer.main or main, outer.header or tag in HEADER, wrapper)
            )

    def end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        if tag in BLOCK:
            self.finish()
            self.heading = False
        if not self.count[tag]:
            return
        for place in range(len(self.open) - 1, -1, -1):
            if self.open[place].tag == tag:
                self._close_from(place)
                return
            if tag not in BLOCK and self.open[place].tag in BLOCK:
                return

    def _close_from(self, place: int) -> None:
        for element in self.open[place:]:
            self.count[element.tag] -= 1
        del self.open[place:]

    def _close_implied(self, tag: str) -> None:
        if self.open and self.open[-1].tag == "p":
            self._close_from(len(self.open) - 1)
        ends = ENDS_ITSELF.get(tag, frozenset())
        if not any(self.count[t] for t in ends):
            return
        for place in range(len(self.open) - 1, -1, -1):
            if self.open[place].tag in ends:
                self._close_from(place)
                return
            if self.open[place].tag in SCOPES:
                return


def _attributes(rest: str) -> dict[str, str]:
    return {name.lower(): (a or b or c or "").lower() for name, a, b, c in ATTRIBUTE.findall(rest)}


def _unseen(tag: str, attributes: dict[str, str]) -> bool:
    if tag in ("html", "body", "main"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    return "display:none" in attributes.get("style", "").replace(" ", "")


def _marking_names(tag: str, attributes: dict[str, str]) -> list[bool]:
    """For each name of class, id and role with a boilerplate word: whether it has no other."""
    if tag in ("html", "body", "main"):
        return []
    words = ARTICLE_BOILERPLATE if tag == "article" else BOILERPLATE
    names = " ".join(attributes.get(name, "") for name in ("class", "id", "role")).split()
    own = [[word in words for word in re.split(r"[_-]+", name.strip("_-"))] for name in names]
    return [all(found) for found in own if any(found)]


def _parsed(page: str) -> _Page:
    state = _Page()
    at = 0
    while True:
        found = TOKEN.search(page, at)
        if found is None:
            state.text(page[at:])
            break
        state.text(page[at : found.start()])
        at = found.end()
        if found["tag"] is None:
            continue
        tag = found["tag"].lower()
        if found["end"]:
            state.end(tag)
        elif tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            at = close.end() if close else len(page)
        else:
            state.start(tag, found["rest"])
    state.finish()
    return state


def _released(page: _Page, labels: list[bool | None]) -> list[_Block]:
    """The blocks outside wrappers and in released ones."""
    outside = outside_main = total = 0
    own_article = any(block.main and block.wrapper < 0 for block in page.blocks)
    for block, label in zip(page.blocks, labels):
        if label:
            total += len(block.text)
            if block.wrapper >= 0:
                page.wrappers[block.wrapper].good += len(block.text)
            else:
                outside += len(block.text)
                outside_main += len(block.text) * block.main
    for wrapper in reversed(page.wrappers):
        if wrapper.outer >= 0:
            outer = page.wrappers[wrapper.outer]
            outer.good += wrapper.good
            outer.article |= wrapper.article
            outer.heading |= wrapper.heading
    bare = all(block.wrapper >= 0 for block in page.blocks)
    released: list[bool] = []
    for wrapper in page.wrappers:
        form = wrapper.tag in FORMS and not wrapper.sure
        rival = (outside or own_article) if wrapper.sure else outside_main
        most = 2 * wrapper.good > total and not (wrapper.sure and rival)
        speaks = (wrapper.article or wrapper.heading) and not rival
        own = most or speaks or (form and wrapper.article) or (bare and form and wrapper.tag == "form")
        released.append(own and (wrapper.outer < 0 or released[wrapper.outer]))
    return [b for b in page.blocks if b.wrapper < 0 or released[b.wrapper]]


def _is_marked(blocks: list[_Block]) -> bool:
    """Whether the article is where the page marks it: at least half of its good text, or of any, is there."""
    if not any(b.main for b in blocks):
        return False
    unlinked = [len(b.text) - min(b.linked, len(b.text)) for b in blocks]
    good = [len(b.text) if _decide(b, False) else 0 for b in blocks]
    # Junk and texts of other languages have few stop words, so either weight is enough.
    return any(
        2 * sum(w for w, b in zip(weights, blocks) if b.main) >= sum(weights) > 0
        for weights in (good, unlinked)
    )


def _decide(block: _Block, marked: bool) -> bool | None:
    """Pass 1: good, bad or, None, ambiguous."""
    if marked and not block.main:
        return False
    if block.linked > MAX_LINKS * len(block.text):
        return False
    if len(block.text) < LONG:
        return None
    words = [w.strip(".,;:!?\"'()").lower() for w in block.text.split()]
    return True if sum(w in STOP_WORDS for w in words) >= MIN_STOP_WORDS * len(words) else None


def _inherit(labels: list[bool | None], main: list[bool]) -> list[bool]:
    """Pass 2: nearest decided label on the same side of the article's border; else kept."""
    far = len(labels) + 1
    best = [(far, True)] * len(labels)
    for order in (range(len(labels)), range(len(labels) - 1, -1, -1)):
        last: dict[bool, tuple[int, bool]] = {}
        for place in order:
            label = labels[place]
            if label is not None:
                last[main[place]] = (place, label)
            elif main[place] in last:
                at, label = last[main[place]]
                distance = abs(place - at)
                # Inside a marked article a bad block only speaks for itself.
                if (label or not main[place]) and (distance, not label) < (best[place][0], not best[place][1]):
                    best[place] = (distance, label)
    return [best[i][1] if label is None else label for i, label in enumerate(labels)]


def main_text(page: str | None) -> str:
    """The article's blocks, in page order, joined by one space."""
    parsed = _parsed(page or "")
    blocks = parsed.blocks
    if parsed.wrappers:
        blocks = _released(parsed, [_decide(b, False) for b in blocks])
    marked = _is_marked(blocks)
    kept = _inherit([_decide(b, marked) for b in blocks], [marked and b.main for b in blocks])
    return " ".join(b.text for b, keep in zip(blocks, kept) if keep)


@F.pandas_udf(StringType())
def _main_text(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


def extract_text(page: str = "html") -> Column:
    """Main text of a column of html."""
    return _main_text(text_of(page))
