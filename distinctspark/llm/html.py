"""Main text of web pages by two-pass block rules.

Names of elements and classes are hints, never verdicts.  An element hinted to hold no content is a
wrapper, and its hint void, where it holds the article or, for a form, most of the page's prose; and
where names would leave a page without text, they count for nothing.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Frequent function words of the four languages.
STOP_WORDS = frozenset(
    "a about all an and are as at be been but by can for from had has have he her his i if in into "
    "is it its more no not of on one only or other our out she so that the their them there they "
    "this to up was we were what when which who will with you "
    "aber als am auch auf aus bei bin bis das dass dem den der des die doch durch ein eine einem "
    "einen einer er es für hat ich ihr im ist man mit nach nicht noch nur oder sich sie sind so über "
    "um und uns von vor war wenn werden wie wir wird zu zum zur "
    "au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais "
    "ne nous ou où par pas plus pour qu que qui sa se ses si son sont sur un une vous "
    "al como con del desde el ella ellos entre era es esta este ha hay las lo los me mi muy más ni "
    "nos o para pero por porque sin sobre su sus también te una uno unos y ya".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements hinted to hold no content.
DROPPED = frozenset(
    "head nav footer aside form menu dialog button select option textarea label fieldset object".split())
#: Words of a class, id or role that hint at an element without content.
MARKS = frozenset(
    "ad ads adv advert advertisement adverts advertising alert banner breadcrumb breadcrumbs byline "
    "comment comments complementary consent contentinfo cookie cookies dialog disclaimer discussion "
    "disqus footer form gdpr login masthead menu menubar modal nav navbar navigation newsletter notice "
    "notices pagination popup privacy promo promotion related replies reply respond search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toc toolbar "
    "widget widgets".split()
)
#: Words beside such a word in one name that take the hint back: no-sidebar, comments-closed.
NEGATIONS = frozenset("no not non without with has hide hidden closed off none disabled".split())
CONTENT = frozenset(["article", "main"])
#: Elements of whole pages, whose marks describe the page and not themselves.
PAGE = frozenset(["html", "body", "main", "article"])

#: Decided good from this share of stop words and length on; decided bad above this link share.
STOP_SHARE, SHORT_WORDS, LINK_SHARE = 0.12, 10, 0.4
#: An element that holds this share of the page's prose is its wrapper, or its content.
MOST = 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|canvas|audio|video)\b.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)",
    re.S | re.I,
)
_MARKED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(
    r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    tag: str
    linked: int  # characters within links
    hints: tuple[int, ...]  # numbers of the hinted elements it stands in
    content: int  # number of the article or main element it stands in; 0 is none
    dropped: bool = False  # in an element whose hint holds
    label: bool | None = None


@dataclass
class _Open:
    tag: str
    hints: tuple[int, ...]
    content: int


def _is_hinted(tag: str, attributes: str, in_content: bool) -> bool:
    if tag in PAGE:
        return False
    for found in _MARKED.finditer(attributes):
        for name in (found[1] or found[2] or found[3] or "").split():
            parts = {p.lower() for p in _PART.findall(name)}
            hint = parts & MARKS or ("header" in parts and not in_content)
            if hint and not (parts & NEGATIONS):
                return True
    return False


#: Kinds of hints besides the elements' own tags: not shown, and by a class, id or role.
HIDDEN, NAMED = "hidden", "named"


def blocks(page: str) -> tuple[list[Block], list[str]]:
    """The text blocks of a page in order, and the kind of hint of every hinted element."""
    found: list[Block] = []
    hinted: list[str] = []
    stack = [_Open("", (), 0)]
    parts: list[str] = []
    linked = links = contents = at = 0
    owner = "body"

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            found.append(Block(text, owner, linked, stack[-1].hints, stack[-1].content))
        parts.clear()
        linked = 0

    def push(tag: str, attributes: str) -> None:
        nonlocal contents
        top = stack[-1]
        content = top.content
        if tag in CONTENT and not content:
            contents += 1
            content = contents
        kind = hint(tag, attributes)
        hints = top.hints
        if kind:
            hinted.append(kind)
            hints = (*hints, len(hinted) - 1)
        stack.append(_Open(tag, hints, content))

    def hint(tag: str, attributes: str) -> str:
        if _HIDDEN.search(attributes):
            return HIDDEN
        inside = bool(stack[-1].content)
        if tag in DROPPED or (tag == "header" and not inside):
            return tag
        return NAMED if _is_hinted(tag, attributes, inside) else ""

    def pop(tag: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                del stack[i:]
                return

    for token in _TOKEN.finditer(page):
        text = page[at : token.start()]
        at = token.end()
        if text:
            parts.append(text)
            linked += len(text) if links else 0
        tag = (token[3] or "").lower()
        if not tag:
            continue
        closes, attributes = bool(token[2]), token[4]
        if tag in BLOCKS:
            flush()
            owner = tag if not closes else "body"
            if closes:
                pop(tag)
                continue
            if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack[-1].tag == tag:
                stack.pop()
        if tag == "a":
            links = 0 if closes else 1
        elif tag in VOID:
            parts.append(" ")
            continue
        if closes:
            if stack[-1].hints:
                flush()
            pop(tag)
        elif not attributes.endswith("/"):
            if hint(tag, attributes):
                flush()
            push(tag, attributes)
    rest = page[at:]
    parts.append(rest)
    linked += len(rest) if links else 0
    flush()
    return found, hinted


def _first_pass(found: list[Block]) -> list[int]:
    """Decide blocks by their own text; the words of each that reads as prose, else 0.

    Good: enough words, few links, and enough stop words.  Bad: mostly links.  Where no block of the
    page has enough stop words, its language is not known here, and length and links decide alone.
    """
    long, fluent = [], []
    for block in found:
        words = _WORD.findall(block.text.lower())
        links = block.linked / max(1, len(block.text))
        stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        long.append(len(words) if links <= LINK_SHARE and len(words) >= SHORT_WORDS else 0)
        fluent.append(stops >= STOP_SHARE)
        block.label = False if links > LINK_SHARE and not block.content else None
    known = any(n and f for n, f in zip(long, fluent, strict=True))
    prose = [n if f or not known else 0 for n, f in zip(long, fluent, strict=True)]
    for block, n, own in zip(found, prose, long, strict=True):
        # In an article, long text of few stop words stays too: nothing of it may go.
        if n or (own and block.content):
            block.label = True
    return prose


def _wrappers(found: list[Block], hinted: list[str], prose: list[int]) -> set[int]:
    """Hinted elements that hold the content: most of the prose in articles, or in all for a form."""
    total, inner = sum(prose), [0] * len(hinted)
    cored = [0] * len(hinted)
    for block, n in zip(found, prose, strict=True):
        for k in block.hints:
            inner[k] += n
            cored[k] += n if block.content else 0
    return {
        k for k, tag in enumerate(hinted)
        if tag != HIDDEN and total and (cored[k] > MOST * total or (tag == "form" and inner[k] > MOST * total))
    }


def classify(found: list[Block], hinted: list[str]) -> None:
    """Label every block: first by its own text and place, then short ones by their neighbours.

    First pass: see :func:`_first_pass`; and bad are blocks in an element whose hint holds, and those
    outside the page's articles where these hold most of the prose that no hint takes away.  Second
    pass.  An undecided block takes the label of the nearest decided one in the same article (or
    outside all); at equal distance the next one counts for headings and the previous one otherwise.
    With no decided block there, text of an article is good.  A page that is left without any good
    block is classified again without the hints of names and forms.
    """
    prose = _first_pass(found)
    void = _wrappers(found, hinted, prose)
    _label(found, prose, [k not in void for k in range(len(hinted))])
    if not any(b.label for b in found) and any(tag in (NAMED, "form") for tag in hinted):
        prose = _first_pass(found)
        _label(found, prose, [tag not in (NAMED, "form") for tag in hinted])


def _label(found: list[Block], prose: list[int], holds: list[bool]) -> None:
    for block in found:
        block.dropped = any(holds[k] for k in block.hints)
        if block.dropped:
            block.label = False
    free = [n if not b.dropped else 0 for b, n in zip(found, prose, strict=True)]
    inside = sum(n for b, n in zip(found, free, strict=True) if b.content)
    has_text = any(b.content and not b.dropped for b in found)
    places = {b.content for b in found}
    if has_text and inside >= MOST * sum(free):
        for block in found:
            if not block.content:
                block.label = False
    else:  # an article of the page is not the page's article
        for block in found:
            if block.label is None and block.content and not block.dropped:
                block.content = 0
    labels = [b.label for b in found]
    for place in places:
        own = [i for i, b in enumerate(found) if b.content == place and not (b.dropped and place)]
        decided = [k for k, i in enumerate(own) if labels[i] is not None]
        for k, i in enumerate(own):
            if labels[i] is None:
                after = bisect.bisect(decided, k)
                near = decided[max(0, after - 1) : after + 1]
                heading = found[i].tag[0] == "h"
                best = min(near, default=None, key=lambda d, k=k, h=heading: (abs(d - k), (d < k) == h))
                found[i].label = place > 0 if best is None else labels[own[best]]


def main_text(page: str | None) -> str:
    """The main text of one page: its good blocks, joined by blank lines."""
    found, hinted = blocks(page or "")
    classify(found, hinted)
    return "\n\n".join(b.text for b in found if b.label)


def _extractor(html_at: int) -> Callable:
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(html_at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, type=pa.string())], [*batch.schema.names, "text"])

    return extract


def extract_text(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text``, the main text of the whole ``html``.

    A NULL, empty or textless page gives an empty text; broken or cut markup is read as far as it
    goes.  All columns pass through, and a column ``text`` is replaced.
    """
    pages = pages.drop("text")
    schema = T.StructType(list(pages.schema)).add("text", "string")
    return pages.mapInArrow(_extractor(pages.columns.index("html")), schema)
