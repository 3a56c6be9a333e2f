"""Main text of web pages by two passes of rules over blocks.

A page falls into blocks: stretches of text between tags of block elements. Those inside boilerplate elements are left
out. The first pass classifies each other block by its place (inside an article or not), link density, length and
stop-word density, as good, bad or undecided.
In the second pass an undecided block takes the label of the nearest decided block of its own section (the innermost
article, main, section or div); between equally near ones that differ, and where its section has none, those of the
whole page count, and blocks inside an article are good.

Defined results: null html counts as empty and gives an empty text, as does a page without good blocks; ids and urls are
passed on, null or not; rows are independent, so repeated rows repeat; an empty table gives an empty table; extra
columns are ignored. Pages of any length are read whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_slices

CHUNK_CHARS = 1 << 21
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.15, 0.30
LINKED = 0.5

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
    a an and are as at be been but by for from had has have he her his i in is it its not of on or she so that the their
    them they this to was we were which with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer es für hat ich
    im ist mit nach nicht noch nur oder sich sie sind so um und von vor war wie wir zu zum zur über
    au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que
    qui sa se ses son sur un une vous
    al como con cuando de del desde el ella en entre era es esta este ha hay la las le lo los más me muy no o para pero
    por que se sin sobre su sus también un una y ya
    """.split()
)
# HTML elements by their role.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td template tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
BOILERPLATE = frozenset("head nav footer aside form button select option dialog menu template svg math object canvas audio video fieldset datalist".split())
SECTIONS = frozenset("article main section div body td".split())
# Words of class, id and role attributes that mark what is not main text.
HINTS = frozenset(
    """
    ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner sidebar
    sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar
    cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login
    share sharing social related recommended recommendations comment comments disqus reply replies respond pagination
    pager copyright skip search contentinfo complementary header
    """.split()
)
ARTICLE_PARTS = frozenset("article post entry content story title headline".split())

MARKUP = re.compile(r"<(?:!--|([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|/([a-zA-Z][^\s/>]*)[^>]*>|[!?/][^>]*>)")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def is_boilerplate(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element holds no main text, by its name and attributes."""
    if name in BOILERPLATE or name == "header" and not in_article:
        return True
    if not attributes.strip() or name in ("html", "body"):
        return False
    for found in ATTRIBUTE.finditer(attributes):
        key, value = found[1].lower(), html.unescape(found[2] or found[3] or found[4] or "")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key in ("class", "id", "role"):
            for token in value.split():
                words = {x.lower() for x in PARTS.findall(token)}
                marks = words & HINTS
                if not marks or marks == {"header"} and (in_article or words & ARTICLE_PARTS):
                    continue
                if name in ("article", "main") and not marks & {"comment", "comments", "reply", "replies", "ad", "sponsored", "promo", "related"}:
                    continue
                if not {"no", "has", "with"} & words:
                    return True
    return False


class Block:
    __slots__ = ("in_article", "linked", "out", "section", "text")

    def __init__(self, text: str, linked: int, out: bool, in_article: bool, section: int):
        self.text, self.linked, self.out, self.in_article, self.section = text, linked, out, in_article, section


def blocks(page: str) -> list[Block]:
    """The page's blocks of text, in order."""
    found: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]  # name, out, in article, section
    pieces: list[tuple[str, bool]] = []
    links, sections, at, n = 0, 0, 0, len(page)

    def close() -> None:
        nonlocal pieces
        if pieces:
            text = " ".join(html.unescape("".join([x for x, _ in pieces])).split())
            if text:
                linked = sum(len(" ".join(html.unescape(x).split())) for x, inside in pieces if inside)
                found.append(Block(text, linked, *stack[-1][1:]))
            pieces = []

    while at < n:
        mark = page.find("<", at)
        if mark < 0:
            pieces.append((page[at:], links > 0))
            break
        if mark > at:
            pieces.append((page[at:mark], links > 0))
        tag = MARKUP.match(page, mark)
        if tag is None:
            following = page[mark + 1 : mark + 2]
            if not (following.isascii() and following.isalpha() or following in ("/", "!", "?")):
                pieces.append(("<", links > 0))
                at = mark + 1
                continue
            stop = page.find(">", mark)  # quotes that never close: the tag ends at the next >
            if stop < 0:
                break
            inner = page[mark + 1 : stop]
            name, attributes, ending = re.split(r"[\s/]", inner.lstrip("/"), maxsplit=1)[0].lower(), "", inner.startswith("/")
            at = stop + 1
        else:
            at = tag.end()
            if tag[0] == "<!--":
                stop = page.find("-->", mark + 2)
                at = n if stop < 0 else max(at, stop + 3)
                continue
            name, attributes, ending = (tag[1] or tag[3] or "").lower(), tag[2] or "", bool(tag[3])
        if not name or name[0] in "!?":
            continue
        if ending:
            if name == "a":
                links = 0
            opened = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if name in BLOCKS or opened and stack[opened][1] != stack[opened - 1][1]:
                close()
            if opened:
                del stack[opened:]
            continue
        if name in BLOCKS:
            close()
            links = 0
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = n if stop is None else stop.start()
            continue
        if name == "a":
            links = 1
        elif name == "br":
            pieces.append((" ", False))
        elif name == "body":
            del stack[1:]
        if name in VOID or attributes.endswith("/") and name in ("path", "use", "circle", "rect"):
            continue
        if name == "p":
            for i in range(len(stack) - 1, 0, -1):  # an open paragraph ends where the next begins
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in BLOCKS:
                    break
        elif name == "li":
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "li":
                    del stack[i:]
                    break
                if stack[i][0] in ("ul", "ol", "menu", "dir"):
                    break
        _, out, in_article, section = stack[-1]
        if name in SECTIONS:
            sections += 1
            section = sections
        if is_boilerplate(name, attributes, in_article):
            if name not in BLOCKS:
                close()
            out = True
        stack.append((name, out, in_article or name in ("article", "main"), section))
    close()
    return found


GOOD, BAD, UNDECIDED = 1, 0, -1


def first_pass(block: Block) -> int:
    size = len(block.text)
    if block.linked > LINKED * size:
        return BAD
    words = block.text.lower().split()
    stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
    if size < SHORT:
        return BAD if block.linked and not block.in_article else UNDECIDED
    if stops >= STOP_HIGH and size > LONG or block.in_article and stops >= STOP_LOW:
        return GOOD
    if stops >= STOP_LOW and size > LONG:
        return GOOD
    return UNDECIDED if stops >= STOP_LOW or block.in_article else BAD


def nearest(labels: list[int], i: int, among: list[int]) -> int:
    """The label of the decided block nearest to i; UNDECIDED if none or two that differ."""
    before = max((k for k in among if k < i and labels[k] != UNDECIDED), default=None)
    after = min((k for k in among if k > i and labels[k] != UNDECIDED), default=None)
    if before is None or after is None:
        return labels[before if after is None else after] if (before, after) != (None, None) else UNDECIDED
    if i - before == after - i:
        return labels[before] if labels[before] == labels[after] else UNDECIDED
    return labels[before if i - before < after - i else after]


def second_pass(found: list[Block], labels: list[int]) -> list[int]:
    """Labels of all blocks. One sweep each way keeps the nearest decided block by section and overall."""
    n = len(found)

    def sweep(order) -> list[tuple]:
        last_of: dict[int, int] = {}
        last, seen = None, [(None, None)] * n
        for i in order:
            seen[i] = (last_of.get(found[i].section), last)
            if labels[i] != UNDECIDED:
                last_of[found[i].section] = last = i
        return seen

    back, ahead = sweep(range(n)), sweep(range(n - 1, -1, -1))
    out = list(labels)
    for i in range(n):
        if labels[i] == UNDECIDED:
            chosen = UNDECIDED
            for level in (0, 1):
                if chosen == UNDECIDED and not (level and found[i].in_article):
                    chosen = nearest(labels, i, [k for k in (back[i][level], ahead[i][level]) if k is not None])
            out[i] = int(found[i].in_article) if chosen == UNDECIDED else chosen
    return out


def extract(page: str) -> str:
    found = [x for x in blocks(page) if not x.out]  # what stands in boilerplate elements tells nothing about its neighbours
    labels = second_pass(found, [first_pass(x) for x in found])
    return "\n".join([x.text for x, label in zip(found, labels, strict=True) if label == GOOD])


def extract_text(df: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of keep, then (text, n_chars) of each page."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, pages in text_slices(batch, len(keep), CHUNK_CHARS):
                texts = [extract(x) for x in pages]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*keep, "text", "n_chars"])

    kept = ", ".join(f"`{x}` {df.schema[x].dataType.simpleString()}" for x in keep)
    return df.select(*keep, page).mapInArrow(run, f"{kept}, text string, n_chars bigint")
