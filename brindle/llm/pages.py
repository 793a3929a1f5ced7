"""Main text of web pages by two passes of block rules.

A page is read into blocks: runs of text between block-level tags, each with the section it stands in. The first pass
decides blocks: those of boilerplate sections (menus, headers, footers, sidebars, notices, adverts, forms, comments) and
those that are mostly links are bad, long ones with enough stop words are good; what is short, or poor in stop words, is
left open. The second pass gives an open block the label of its nearest decided neighbours in the same section; where
they disagree at equal distance, or none is decided, the section's own label holds: good in an article, otherwise bad
if the page has an article and good if the block has a stop word.

Names (class, id, role) tell boilerplate by whole tokens or by compounds of BAD_NAMES and PLAIN_NAMES, on sections and on
other block elements. They never mark body, main or article; a named section that holds the page's only articles
doesn't make them bad, and a good text overrules a name of WEAK_NAMES.

Null and empty pages have an empty text. Broken markup is read as browsers do: unclosed elements end with their parents,
a tag that the page's end cuts off is dropped, unknown character references stay. Reading a page takes time in
proportion to its length, whatever its markup. Repeated rows get equal texts; extra
columns are kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from brindle.llm.text import wider
from brindle.staging import bounded_batches

#: A block of this many characters and this share of stop words is good; of this share of link characters, bad.
LONG, STOP_SHARE, LINK_SHARE = 70, 0.2, 0.5

# Frequent function words of the languages that pages are written in.
STOP_WORDS = frozenset(
    "the of and to in a is that for it was on with as be at by this from or an are not but have they which you "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat "
    "de la le et les des en un du une que est pour qui dans sur par plus pas au ce il sont avec "
    "el que y los del se las por con no para una su al lo como más pero sus le".split()
)
SKIPPED = "script|style|title|textarea|noscript|template|iframe|svg|math|select|button|object|audio|video|canvas"
BAD_TAGS = frozenset("nav footer aside form dialog menu fieldset".split())
ARTICLE_TAGS = frozenset("article main".split())
SECTION_TAGS = BAD_TAGS | ARTICLE_TAGS | frozenset("header div section ul ol dl table body figure details".split())
BLOCK_TAGS = SECTION_TAGS | frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption blockquote pre address hr html head figcaption summary center "
    "thead tbody tfoot legend hgroup".split()
)
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox sponsor sponsored banner promo promotion nav navbar "
    "navigation menu breadcrumb breadcrumbs footer masthead sidebar aside widget related recommended recommendations "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social comment comments reply replies respond disqus toolbar pagination pager skip search "
    "contentinfo complementary dialog".split()
)
#: Beginnings of longer names of the same kind, as in ``commentlist``; words that begin like them but are of another kind.
BAD_STEMS = ("comment", "advert", "sponsor", "cookie", "breadcrumb", "sidebar", "newsletter", "navbar", "footer", "pagination")
OTHER_NAMES = frozenset("commentary commentaries commentator commentable footers".split())
#: Beginnings that decide whatever else a name has, and the words that turn such a name into its opposite.
STRONG_STEMS = ("comment", "advert", "sponsor")
OPPOSITES = frozenset("no non not without with has have open opened closed off enabled disabled free hide hidden".split())
#: Names that good text overrules, and words that make known compounds with bad names.
WEAK_NAMES = frozenset("notice notices alert banner header masthead search login share sharing social skip toolbar".split())
PLAIN_NAMES = frozenset(
    "site page post entry article blog main top bottom left right primary secondary global sticky fixed area list section "
    "box bar block group container wrapper wrap inner outer row col column panel link links button buttons form item items "
    "text title message thread posts stories articles news content user reader".split()
)
#: Elements without blocks inside, which the next block ends; those that end others of their kind.
LEAF_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 pre caption legend".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
ENDS = {t: [x for x, by in ENDED_BY.items() if t in by] for t in {t for by in ENDED_BY.values() for t in by}}
#: How bad an element is: by a weak name, by a name, by its tag or hidden; or an article that a named element holds.
GOOD, WEAK, NAMED, BAD, HELD = range(5)

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in SKIPPED.split("|")}
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
#: Numbers of character references with leading zeros, and of more digits than any character has.
_ZEROS, _TOO_HIGH = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])"), re.compile(r"&#(?:[1-9]\d{7,}|[xX][1-9a-fA-F][0-9a-fA-F]{6,});?")
_PARTS = re.compile(r"[^a-z0-9]+")
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    section: int
    bad: int
    article: bool
    link_share: float


def _badness(tag: str, attributes: str, in_article: bool) -> int:
    """How bad an element is by its own tag and attributes."""
    if tag in BAD_TAGS or tag == "header" and not in_article:
        return BAD
    worst = GOOD
    for name, value in _ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return BAD
        if name in ("class", "id", "role") and tag not in ARTICLE_TAGS and tag != "body":
            for token in value.split():
                parts = {x for x in _PARTS.split(token) if x and not x.isdigit()}
                named = {x for x in parts if x in BAD_NAMES or x.startswith(BAD_STEMS) and x not in OTHER_NAMES}
                if "header" in parts and not in_article:
                    named = named | {"header"}
                strong = any(x.startswith(STRONG_STEMS) for x in named) and not parts & OPPOSITES
                if strong or named and parts <= named | PLAIN_NAMES:
                    worst = max(worst, WEAK if named <= WEAK_NAMES else NAMED)
    return worst if tag in SECTION_TAGS or worst != WEAK else GOOD


def _tag_end(page: str, at: int) -> int:
    """The place of the ``>`` that ends a tag whose name ends at ``at``: not inside a quoted value; -1 without one.

    A quote opens a value only after ``=``. Each character is passed once.
    """
    before = at
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        at = m.end()
        # only white space stands between the sign and the quote; look back no further than the last mark
        if page[before : m.start()].rstrip()[-1:] == "=":
            at = page.find(m[0], at) + 1
            if not at:
                return -1
        before = at
    return -1


def markup(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(begin, end, name, closing, attributes) of the page's tags, comments and skipped elements, in order; the latter two
    have no name. One pass from left to right; a tag that the page's end cuts off runs to the end."""
    at, size = 0, len(page)
    while (begin := page.find("<", at)) >= 0:
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = end + 3 if end >= 0 else size
            yield begin, at, "", False, ""
            continue
        closing = page.startswith("/", begin + 1)
        name = _NAME.match(page, begin + 1 + closing)
        if not name:
            if closing or page.startswith(("<!", "<?"), begin):
                end = page.find(">", begin)
                at = end + 1 if end >= 0 else size
                yield begin, at, "", False, ""
            elif begin + 1 == size:
                at = size
                yield begin, at, "", False, ""
            else:
                at = begin + 1
            continue
        tag = name[0].lower()
        end = _tag_end(page, name.end())
        if end < 0:
            yield begin, size, "", False, ""
            return
        at = end + 1
        attributes = page[name.end() : end]
        if tag in _ENDS and not closing:
            if not attributes.endswith("/"):
                last = _ENDS[tag].search(page, at)
                stop = page.find(">", last.end()) if last else -1  # without one here there is none later either
                at = stop + 1 if stop >= 0 else size
            yield begin, at, "", False, ""
            continue
        yield begin, at, tag, closing, attributes


def _decoded(text: str) -> str:
    """Character references decoded; a number that no character has is U+FFFD, however long it is."""
    if "&#" in text:
        text = _TOO_HIGH.sub("\ufffd", _ZEROS.sub(r"&#\1", text))
    return html.unescape(text)


def blocks_of(page: str) -> list[Block]:
    """The page's blocks with some text, in page order."""
    found: list[Block] = []
    stack: list[tuple[str, int, bool, int]] = [("", GOOD, False, 0)]  # tag, how bad, in an article, section
    sections, text, linked, in_link, head, at = 1, [], 0, False, False, 0

    opened: dict[str, list[int]] = {}  # places on the stack by name, rising
    held: list[int] = [0]  # places of sections

    def cut(k: int) -> None:
        for name, *_ in reversed(stack[k:]):
            opened[name].pop()
            if name in SECTION_TAGS:
                held.pop()
        del stack[k:]

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not head:
            text.append(piece)
            if in_link:
                linked += len(piece.strip())

    def close() -> None:
        nonlocal text, linked
        plain = " ".join(_decoded("".join(text)).split())
        if plain:
            _, bad, article, section = stack[-1]
            found.append(Block(plain, section, bad, article, min(1.0, linked / len(plain))))
        text, linked = [], 0

    for begin, end, tag, ending, attributes in markup(page):
        add(page[at:begin])
        at = end
        if not tag:
            continue
        if tag == "br":
            add(" ")
        elif tag == "a":
            in_link = not ending
        elif tag in BLOCK_TAGS:
            close()
            in_link = False
            if tag in ("head", "body"):
                head = tag == "head" and not ending
            if tag in ("head", "html", "hr"):
                continue
            if not ending:
                while stack[-1][0] in LEAF_TAGS:
                    cut(len(stack) - 1)
                # the last open element that this one ends, unless a section has begun since
                ended = max((opened[x][-1] for x in ENDS.get(tag, ()) if opened.get(x)), default=0)
                if ended > held[-1]:
                    cut(ended)
                _, bad, article, section = stack[-1]
                own = _badness(tag, attributes, article)
                inside = article or tag in ARTICLE_TAGS
                if bad == HELD:
                    now = own or HELD
                elif inside and not article and bad in (WEAK, NAMED):
                    now = max(own, BAD) if own else HELD
                else:
                    now = max(bad, own)
                if now != bad or inside and not article:
                    section, sections = sections, sections + 1
                opened.setdefault(tag, []).append(len(stack))
                if tag in SECTION_TAGS:
                    held.append(len(stack))
                stack.append((tag, now, inside, section))
            elif opened.get(tag):
                last = opened[tag][-1]
                if tag in SECTION_TAGS or last > held[-1]:
                    cut(last)
    add(page[at:])
    close()
    other = any(b.article and b.bad == GOOD for b in found)
    for b in found:
        if b.bad == HELD:
            b.bad = BAD if other else GOOD
    return found


def _decided(block: Block) -> bool | None:
    """The first pass: good, bad or open."""
    if block.bad > WEAK or block.link_share > LINK_SHARE:
        return False
    if len(block.text) >= LONG:
        words = _LETTERS.findall(block.text.lower())
        if words and sum(w in STOP_WORDS for w in words) >= STOP_SHARE * len(words):
            return True
    return False if block.bad else None


def classify(blocks: list[Block]) -> list[bool]:
    """The labels of both passes: whether each block belongs to the main text."""
    first = [_decided(b) for b in blocks]
    has_article = any(b.article and not b.bad for b in blocks)
    nearest: list[list[tuple[int, bool]]] = [[] for _ in blocks]  # (distance, label) on either side
    for order in (range(len(blocks)), range(len(blocks) - 1, -1, -1)):
        last: dict[int, int] = {}
        for k in order:
            section = blocks[k].section
            if first[k] is not None:
                last[section] = k
            elif section in last:
                nearest[k].append((abs(k - last[section]), bool(first[last[section]])))
    labels = []
    for b, label, near in zip(blocks, first, nearest):
        if label is None:
            near = sorted(near)
            if near and (len(near) == 1 or near[0][0] < near[1][0] or near[0][1] == near[1][1]):
                label = near[0][1]
            elif b.article or has_article:
                label = b.article
            else:
                label = any(w in STOP_WORDS for w in _LETTERS.findall(b.text.lower()))
        labels.append(label)
    return labels


def main_text(page: str | None) -> str:
    """The main text's blocks, joined by two line feeds."""
    blocks = blocks_of(page or "")
    return "\n\n".join(b.text for b, good in zip(blocks, classify(blocks)) if good)


def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    """The pages' other columns with ``text`` and ``n_chars`` of the main text of each whole page."""
    bounded_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (source, "text", "n_chars")]
    rows = pages.select(*kept, source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(v.as_py()) for v in b.column(len(kept))]
            extra = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *extra], names=[*kept, "text", "n_chars"])

    return rows.mapInArrow(run, wider(pages.select(*kept).schema, text="string", n_chars="long"))
