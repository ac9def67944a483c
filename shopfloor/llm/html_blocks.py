"""Main text of web pages by two passes of block rules.

A page is read once from left to right into blocks, the runs of text between
block-level tags. The first pass decides the clear ones: blocks of menus,
headers, footers, sidebars, notices, adverts, forms and reader comments (by
element, class, id or role), blocks outside the article of a page that marks
one, and blocks that are mostly links are bad; blocks with enough words and
enough stop words among them are good; where most of the long text lacks the
stop words (other languages, code), enough words suffice. The second pass gives
the rest, mostly short ones, the label of the nearest decided blocks of their
section, then of the page, where menus, footers and the like say nothing about
the blocks around them; between a good and a bad one, a heading follows the one
after it, and other blocks are good inside an article. Blocks of an article
without any decided block are good, and so are, on a page where the first pass
finds no good block, all that it leaves, if they have three words together.

Names are whole ones: a class token or id counts where it, or every part of it
together with words of place ("site-footer"), is such a name, not by one part
("has-sidebar"); ids of headings and sections, which documentation tools make
from titles, count only as a whole or not at all. Names of adverts, sign-up boxes
and consent notices, names of reader comments, and elements and roles of menus and
the like make all they hold bad, however long it is, articles (teaser cards) too,
but not a main element. Forms and what has another bad name are judged by the
rules of their own blocks where they hold the greater part of the page's text.
Beside an article, a short block of the form "© 2024 ..." is a copyright line.

Null and empty html gives an empty text, as does a page without a good block.
Unclosed and stray tags are accepted, an unclosed comment or script runs to the
end of the page, and reading time is linear in the page. Each row is taken by
itself: repeated rows, null ids and urls are kept, an empty table gives no rows,
other columns are not read. Pages are read in place without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Frequent function words, element names of the HTML standard, usual class names.
STOP_WORDS = frozenset("""
a an and are as at be been but by for from had has have he her his i in is it its not of on only or she that the
their there they this to was we were when which who will with you
au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas pour qui que
sa se ses son sont sur un une vous
als auch auf aus bei das dem den der des die ein eine einen er es für hat ich im in ist mit nicht sich sie sind so um
und von war wie wird zu zum
al como con del el ella en es esta ha las lo los más no para pero por se si sin su sus también un una y
""".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "select", "object")
BLOCKS = frozenset("""
address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup
option p pre section summary table tbody td tfoot th thead tr ul
""".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_ELEMENTS = frozenset("nav footer aside menu dialog head button".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar".split())
BAD_NAMES = frozenset("""
ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie
cookies copyright disclaimer disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices popup
promo promotion recommended related replies reply respond share sharing sidebar signup social sponsor sponsored
subscribe subscription toolbar widget
""".split())
PLACE_NAMES = frozenset("""
area bar block bottom box button buttons container form global header icons inner item items left link links list main
outer page panel post posts primary right secondary section site slot text title top unit wrap wrapper
""".split())
# Of these, names of what is no main text however much it holds.
AD_NAMES = frozenset("""
ad ads adv advert adverts advertisement advertising consent cookie cookies gdpr login newsletter popup popups promo
promotion signup sponsor sponsored subscribe subscription
""".split())
COMMENT_NAMES = frozenset("comment comments disqus replies reply respond".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
SECTIONS = frozenset(["article", "main", "section", "body"])

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"']++))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Scripts written without blanks (Thai to Khmer, kana, Han): each letter counts as a word.
WORD = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]"
                  "|(?:(?![\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff])[^\\W\\d_])+")
COPYRIGHT = re.compile(r"©|(copyright|\(c\))(\s|©|,|:|\(c\))*(19|20)\d\d\b|(19|20)\d\d\s*©|.*\ball rights reserved\b", re.I)
RAW_END = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW}


@dataclass
class Block:
    text: str
    tag: str
    bad: bool
    article: bool
    section: int
    linked: float
    holder: int = 0
    label: bool | None = None


@dataclass
class _Open:
    name: str
    bad: bool
    comments: bool
    article: bool
    section: int
    holder: int = 0


@dataclass
class Holder:
    """A form, or an element that is bad by its class or id alone, and the one around it (0: none)."""

    above: int
    form: bool = False
    words: int = 0
    good: int = 0
    freed: bool = False


def _bad_name(name: str, whole: bool) -> frozenset[str]:
    """The bad names that a class token or id is made of; none if it has other parts."""
    if name.lower() in BAD_NAMES:
        return frozenset([name.lower()])
    parts = frozenset(p.lower() for p in NAME_PART.findall(name))
    found = parts & BAD_NAMES
    return found if not whole and parts <= BAD_NAMES | PLACE_NAMES else frozenset()


def _names(element: str, attributes: str) -> tuple[bool, bool, bool, bool]:
    """Whether the role, then class or id, tell of something beside the article, and whether of adverts and comments."""
    role = named = advert = comments = False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "role":
            role |= value.strip().lower() in BAD_ROLES
        elif key == "class" or (key == "id" and element not in HEADINGS):
            for name in value.split():
                if found := _bad_name(name, key == "id" and element in SECTIONS):
                    named = True
                    advert |= not found.isdisjoint(AD_NAMES) and not (key == "id" and element in SECTIONS)
                    comments |= not found.isdisjoint(COMMENT_NAMES)
    return role, named, advert, comments


class _Reader:
    """Collects the blocks of one page."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.holders = [Holder(0)]
        self.stack = [_Open("", False, False, False, 0)]
        self.open: Counter[str] = Counter()
        self.sections = 0
        self.parts: list[str] = []
        self.link_chars = self.chars = 0
        self.link_depth = 0
        self.tag = ""

    def text(self, raw: str) -> None:
        if raw:
            piece = unescape(raw) if "&" in raw else raw
            self.parts.append(piece)
            n = len(piece) - piece.count(" ")
            self.chars += n
            self.link_chars += n if self.link_depth else 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.stack[-1]
            self.blocks.append(Block(text, self.tag, top.bad, top.article, top.section,
                                     self.link_chars / max(1, self.chars), top.holder))
        self.parts, self.chars, self.link_chars = [], 0, 0

    def pop_to(self, name: str) -> None:
        while len(self.stack) > 1:
            gone = self.stack.pop()
            self.open[gone.name] -= 1
            if gone.name == name:
                break
        if self.link_depth > len(self.stack):
            self.link_depth = 0

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.parts.append(" ")
        if name == "a":
            self.link_depth = len(self.stack)
        if name in EMPTY and name != "hr":
            return
        role, named, advert, comments = _names(name, attributes) if "=" in attributes else (False,) * 4
        block = name in BLOCKS
        if block:
            self.flush()
            self.tag = name
            if self.stack[-1].name == "p":
                self.pop_to("p")
            elif name == "li" and self.stack[-1].name == "li":
                self.pop_to("li")
            if name in HEADINGS or name in ("p", "article", "main"):
                self.link_depth = 0
        if name == "hr" or not (block or role or named or self.open[name]):
            return
        top = self.stack[-1]
        section, article, bad, in_comments, holder = top.section, top.article, top.bad, top.comments, top.holder
        if name in SECTIONS:
            self.sections += 1
            section = self.sections
        if name == "main":
            # It can't be a part of a menu, header, footer or sidebar.
            in_comments |= comments
            bad, article, holder = in_comments, True, 0
        elif name not in ("html", "body"):
            in_comments |= comments
            bad |= role or comments or name in BAD_ELEMENTS or (name == "header" and not article)
            # An article may be named after those who can read it.
            bad |= advert and name != "article"
            article |= name == "article"
            if not bad and (named or name == "form"):
                self.holders.append(Holder(holder, name == "form" and not named))
                holder = len(self.holders) - 1
        if (bad and not top.bad) or holder > top.holder:
            # What lies beside the article says nothing about the blocks around it.
            self.sections += 1
            section = self.sections
            self.flush()
        self.stack.append(_Open(name, bad, in_comments, article, section, holder))
        self.open[name] += 1

    def end(self, name: str) -> None:
        if name == "a":
            self.link_depth = 0
        if name in BLOCKS or self.open[name]:
            self.flush()
            self.tag = ""
            if self.open[name]:
                self.pop_to(name)


def read_blocks(html: str) -> list[Block]:
    """The blocks of a page in page order, still without labels; those of bad holders are bad."""
    reader, at, size = _Reader(), 0, len(html)
    while at < size:
        mark = html.find("<", at)
        if mark < 0:
            reader.text(html[at:])
            break
        reader.text(html[at:mark])
        after = html[mark + 1:mark + 2]
        if html.startswith("<!--", mark):
            stop = html.find("-->", mark + 4)
            at = size if stop < 0 else stop + 3
        elif after in ("!", "?"):
            stop = html.find(">", mark)
            at = size if stop < 0 else stop + 1
        elif found := TAG.match(html, mark):
            at = found.end()
            name = found[2].lower()
            if found[1]:
                reader.end(name)
            elif name in RAW_END:
                stop = RAW_END[name].search(html, at)
                reader.parts.append(" ")
                at = stop.end() if stop else size
            else:
                reader.start(name, found[3])
        elif after.isalpha() or after == "/":
            # A tag with an open quote ends at the next ">"; without one it is the cut end of the page.
            stop = html.find(">", mark)
            at = size if stop < 0 else stop + 1
        else:
            reader.text("<")
            at = mark + 1
    reader.flush()
    if len(reader.holders) > 1:
        _judge_holders(reader.blocks, reader.holders)
    return reader.blocks


def _known(words: list[str], stop_density: float = 0.15) -> bool:
    return sum(w in STOP_WORDS for w in words) >= stop_density * len(words)


def _judge_holders(blocks: list[Block], holders: list[Holder], min_words: int = 10, link_density: float = 0.5) -> None:
    """Marks the blocks of holders as bad, but for those that hold the greater part of the page's text."""
    held = [(b, WORD.findall(b.text.lower())) for b in blocks if not b.bad and b.linked < link_density]
    dense = [(b, len(w), _known(w)) for b, w in held if len(w) >= min_words]
    any_language = sum(n for _, n, known in dense if not known) > sum(n for _, n, known in dense if known)
    for b, words in held:
        holders[b.holder].words += len(words)
    for b, n, known in dense:
        holders[b.holder].good += n if known or any_language else 0
    total = sum(h.words for h in holders)
    holders[0].freed = True
    for h in reversed(holders[1:]):
        most = h.words if h.form else h.good
        h.freed |= most >= min_words and 2 * most >= total
        # What holds a freed one holds the text, too.
        holders[h.above].freed |= h.freed
    for b in blocks:
        b.bad |= not holders[b.holder].freed


def decide(blocks: list[Block], min_words: int = 10, stop_density: float = 0.15, link_density: float = 0.5) -> None:
    """First pass: labels the clear blocks."""
    marked = any(b.article and not b.bad for b in blocks)
    known, other = 0, []
    for b in blocks:
        if b.bad or (marked and not b.article) or (not marked and b.linked >= link_density):
            b.label = False
            continue
        words = WORD.findall(b.text.lower())
        if not marked and len(words) < min_words and COPYRIGHT.match(b.text):
            b.label = False
        elif b.linked < link_density and len(words) >= min_words:
            if _known(words, stop_density):
                b.label = True
                known += len(words)
            else:
                other.append((b, len(words)))
    # The stop words tell nothing about a page that is mostly in another language, or code.
    if sum(n for _, n in other) > known:
        for b, _ in other:
            b.label = True


def _nearest(decided: list[bool | None], forward: bool) -> list[tuple[int, bool] | None]:
    """For every place, distance and label of the nearest decided one before (or after) it."""
    out: list[tuple[int, bool] | None] = [None] * len(decided)
    last = None
    for i in (range(len(decided) - 1, -1, -1) if forward else range(len(decided))):
        if last is not None:
            out[i] = (abs(i - last), decided[last])
        if decided[i] is not None:
            last = i
    return out


def _inherit(blocks: list[Block]) -> None:
    labels = [b.label for b in blocks]
    before, after = _nearest(labels, False), _nearest(labels, True)
    for b, p, n in zip(blocks, before, after, strict=True):
        if b.label is not None or not (p or n):
            continue
        if not p or not n:
            b.label = (p or n)[1]
        elif p[1] == n[1]:
            b.label = p[1]
        elif b.tag in HEADINGS:
            b.label = n[1]
        else:
            b.label = b.article or (p if p[0] < n[0] else n if n[0] < p[0] else (0, False))[1]


def resolve(blocks: list[Block]) -> None:
    """Second pass: the others take the label of their nearest decided neighbours."""
    if any(b.label for b in blocks):
        sections: dict[int, list[Block]] = {}
        for b in blocks:
            sections.setdefault(b.section, []).append(b)
        for inside in sections.values():
            _inherit(inside)
    for b in blocks:
        if b.label is None and b.article:
            b.label = True
    if any(b.label for b in blocks):
        # Boilerplate by its place or name is not asked for the blocks beside it.
        _inherit([b for b in blocks if not b.bad])
    left = [b for b in blocks if b.label is None]
    enough = sum(len(WORD.findall(b.text)) for b in left) >= 3
    for b in left:
        b.label = enough


def main_text(html: str | None) -> str:
    blocks = read_blocks(html or "")
    decide(blocks)
    resolve(blocks)
    return "\n".join(b.text for b in blocks if b.label)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of every page, with its code points."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                          F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(task, "page_id long, url string, text string, n_chars long")
