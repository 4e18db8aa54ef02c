"""Main text of web pages by two passes of block rules."""

from __future__ import annotations

import re
from bisect import bisect_left
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Function words of the languages that the rules know.
STOP_WORDS = frozenset(
    """the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their
    de la le et les des en un du une que est pour qui dans par plus au ne se sur pas ce sont il mais nous avec ou leur cette
    el los las y del por con una su para es al lo como o pero sus ya entre cuando muy sin sobre ser también
    der die und den von zu das mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so""".split()
)
# Elements that end a block; of these, elements that hold blocks; elements whose content is no main text.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
HOLDERS = frozenset("article aside blockquote dialog div details dl fieldset figure footer form header main menu nav ol section table ul".split())
SILENT_TAGS = frozenset("head title script style noscript template iframe object svg math canvas select button textarea option audio video".split())
# Elements of the head; elements of one kind that end the one before; silent elements that pages forget to close.
HEAD_TAGS = frozenset("title script style noscript template meta link base".split())
ENDS_LIKE = frozenset("p li dt dd tr td th".split())
LEFT_OPEN = ("button", "canvas", "object", "video", "audio")
OUTER_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
# Class names, ids or roles of texts that are not the page's own; of parts around its text.
FOREIGN_NAMES = frozenset("ad ads advert adverts advertisement advertising alert comment comments commentlist consent contentinfo cookie cookies disclaimer disqus gdpr newsletter notice promo promotion replies reply respond sponsor sponsored warning".split())
FURNITURE_NAMES = frozenset(
    """banner breadcrumb breadcrumbs copyright footer form header legal login masthead menu modal nav navbar navigation pager pagination popup recommended related search share sharing
    sidebar signup skip social subscribe subscription toolbar widget""".split()
)
# Beginnings of names that say what a part lacks, or has beside it.
DENIALS = frozenset("no non not has have is with without hide".split())
#: What names say of a part: nothing; it may be furniture (one word of several); it is, if its text doesn't tell otherwise; it is none of the text.
PLAIN, PERHAPS, FURNITURE, FOREIGN = range(4)

#: Characters of scripts that write a word in one or two of them; these count three times.
_WIDE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")
_TAIL = re.compile("<[A-Za-z/!?]")
_WORDS, _LETTERS = re.compile(r"[^\W_]+"), re.compile(r"[^a-z0-9]+")
#: Characters of a short and of a long block; stop-word shares of running text; link share of a list of links.
SHORT, LONG, LOW, HIGH, LINKS = 70, 200, 0.12, 0.25, 0.3


class Block:
    __slots__ = ("heading", "holder", "inner", "label", "linked", "outer", "soft", "text")

    def __init__(self, text: str, linked: int, outer: bool, holder: int, inner: bool, heading: bool, soft: int = PLAIN):
        self.text, self.linked, self.outer, self.holder, self.inner, self.heading, self.soft, self.label = text, linked, outer, holder, inner, heading, soft, None


def named_kind(attrs: list, inner: bool) -> int:
    """What the class names, id and role of an element say.  Names count as wholes; of one made of several words the words are a hint,
    unless it begins with a denial.  Outside an article furniture is none of the text."""
    kind = PLAIN
    for k, v in attrs:
        if not v or k not in ("class", "id", "role"):
            continue
        for name in v.lower().split():
            words = [w for w in _LETTERS.split(name) if w]
            if name in FOREIGN_NAMES or (len(words) > 1 and words[0] not in DENIALS and (words[0] in FOREIGN_NAMES or words[-1] in FOREIGN_NAMES)):
                kind = FOREIGN
            elif name in FURNITURE_NAMES and not (inner and name == "header"):
                kind = max(kind, FURNITURE if inner else FOREIGN)
            elif len(words) > 1 and words[0] not in DENIALS and FURNITURE_NAMES.intersection(words):
                kind = max(kind, PERHAPS)
    return kind


class _Blocks(HTMLParser):
    """Cuts a page into blocks: text between the tags of block elements, with what it stands in."""

    def __init__(self, loose: frozenset[str] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.loose = loose  # silent elements with fewer end tags than start tags
        self.silent: list[tuple[str, int]] = []  # silent elements open, each with the number of block elements around it
        self.around: list[str] = []  # block elements open
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = self.links = self.holders = 0
        self.open: list[tuple[str, bool, int, bool, int]] = [("", False, 0, False, PLAIN)]  # holder, whether outside the main text, number, in an article, what names say
        self.own = self.heading = False
        self.soft = PLAIN

    def cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, outer, holder, inner, soft = self.open[-1]
            self.blocks.append(Block(text, self.linked, outer or self.own, holder, inner, self.heading, max(soft, self.soft)))
        self.parts, self.linked, self.own, self.heading, self.soft = [], 0, False, False, PLAIN

    def end_silent(self, tag: str) -> None:
        """Ends the innermost open element of the name and what is open inside it."""
        at = max((i for i, o in enumerate(self.silent) if o[0] == tag), default=len(self.silent))
        del self.silent[at:]

    def make_room(self, tag: str) -> None:
        """Ends the silent elements that cannot hold a tag: the head, foreign elements and those that are never closed."""
        if tag == "body":
            self.end_silent("head")
        while self.silent:
            top = self.silent[-1][0]
            if not (top == "head" and tag not in HEAD_TAGS or tag in BLOCK_TAGS - SILENT_TAGS and (top in ("svg", "math") or top in self.loose)):
                return
            self.silent.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.silent:
            self.make_room(tag)
        if tag in SILENT_TAGS or (tag == "foreignobject" and self.silent):
            if tag == "option" and self.silent and self.silent[-1][0] == "option":
                self.silent.pop()
            elif tag in ("button", "select"):
                self.end_silent(tag)
            self.silent.append((tag, len(self.around)))
            return
        if tag in BLOCK_TAGS:
            if tag in ENDS_LIKE and self.around and self.around[-1] == tag and not (self.silent and self.silent[-1][1] == len(self.around)):
                self.around.pop()
            self.around.append(tag)
        if tag == "a":
            self.links += 1
        elif tag == "br":
            self.parts.append(" ")
        if tag not in BLOCK_TAGS:
            return
        self.cut()
        inner = self.open[-1][3]
        kind = named_kind(attrs, inner)
        outer = kind == FOREIGN or tag in OUTER_TAGS or (tag == "header" and not inner)
        if tag in ("article", "main", "body", "html"):
            outer, kind = False, PLAIN
            while self.open[-1][0] in ("nav", "ul", "ol", "header", "menu") and tag in ("article", "main"):
                self.open.pop()
        soft = PLAIN if kind == FOREIGN else kind
        if tag in HOLDERS:
            self.holders += 1
            within = self.open[-1][4] if tag not in ("article", "main") else PLAIN
            self.open.append((tag, outer or self.open[-1][1], self.holders, inner or tag in ("article", "main"), max(soft, within)))
        else:
            self.own, self.heading, self.soft = outer, tag in ("h1", "h2", "h3", "h4", "h5", "h6"), soft

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in SILENT_TAGS and tag not in HOLDERS and tag != "a":
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT_TAGS or tag == "foreignobject":
            self.end_silent(tag)
            return
        if tag in BLOCK_TAGS and tag in self.around:
            while self.around.pop() != tag:
                pass
            while self.silent and self.silent[-1][1] > len(self.around):
                self.silent.pop()
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag not in BLOCK_TAGS:
            return
        self.cut()
        if tag in HOLDERS and any(tag == o[0] for o in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.silent and self.silent[-1][0] == "head" and not data.isspace():
            self.silent.pop()
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def blocks_of(html: str) -> list[Block]:
    tail = _TAIL.search(html, html.rfind(">") + 1)
    if tail:  # a page cut off within a tag
        html = html[: tail.start()]
    low = html.lower()
    parser = _Blocks(frozenset(t for t in LEFT_OPEN if low.count("<" + t) > low.count("</" + t)))
    parser.feed(html)
    parser.close()
    parser.cut()
    return parser.blocks


def stop_share(text: str) -> float | None:
    """The share of stop words; None for a text without words."""
    words = _WORDS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else None


def unknown_language(blocks: list[Block]) -> bool:
    """Whether the page's running text, as a whole, has too few known stop words for them to tell anything."""
    running = " ".join(b.text for b in blocks if not b.outer and not b.heading and b.linked <= LINKS * len(b.text) and (len(b.text) >= SHORT or _WIDE.search(b.text)))
    return (stop_share(running) or 0) < LOW


def decide(block: Block, unknown: bool = False) -> bool | None:
    """First pass: main text, other text, or None if the block is too short or plain to tell; by length alone in an unknown language."""
    if block.outer:
        return False
    size = len(block.text)
    if block.linked > LINKS * size or (block.text[0] == "©" and size < LONG and not block.inner):
        return False
    density = stop_share(block.text)
    if block.soft:
        running = not block.heading and size >= SHORT and density is not None and (density >= HIGH or (density >= LOW or unknown) and size > LONG)
        return True if running else None if block.soft == PERHAPS else False
    if density is None:
        return None
    if unknown and not block.heading and size + 2 * len(_WIDE.findall(block.text)) > LONG:
        return True
    if size < SHORT or block.heading:
        return None
    if density >= HIGH or (density >= LOW and size > LONG):
        return True
    return None if density >= LOW or size <= LONG or block.inner else False


def label(blocks: list[Block]) -> None:
    """Second pass: what is undecided takes the label of the nearest decided block, in its own holder if there is one.

    Without one in its holder, a block of an article looks among those of articles, any other among all; of two equally near, main
    text wins.  Undecided blocks outside stay out on a page that has an article.  Where no block of the article is decided to be
    main text, its undecided ones stay, and where none of the page is, all that are undecided.  Outside an article, an undecided block
    whose names hint at furniture stays only with main text in its own holder.
    """
    unknown = unknown_language(blocks)
    first = [decide(b, unknown) for b in blocks]
    groups: dict[int, list[int]] = {}
    for i, b in enumerate(blocks):
        if first[i] is not None:
            groups.setdefault(b.holder, []).append(i)
    everywhere = [i for i, x in enumerate(first) if x is not None]
    article = [i for i in everywhere if blocks[i].inner]
    has_article, told, any_main = any(b.inner for b in blocks), any(first[i] for i in article), any(first)

    def nearest(i: int, among: list[int]) -> bool:
        at = bisect_left(among, i)
        near = [(abs(among[j] - i), not first[among[j]]) for j in (at - 1, at) if 0 <= j < len(among)]
        return not min(near)[1]

    for i, b in enumerate(blocks):
        if first[i] is not None:
            b.label = first[i]
        elif not any_main:
            b.label = b.inner or not has_article
        elif b.holder in groups:
            b.label = nearest(i, groups[b.holder])
        elif b.soft and not b.inner:
            b.label = False
        elif b.inner:
            b.label = not told or nearest(i, article)
        else:
            b.label = nearest(i, everywhere) and not has_article


def main_text(html: str | None) -> str:
    """The blocks of main text, in page order, with an empty line between."""
    blocks = blocks_of(html or "")
    label(blocks)
    return "\n\n".join(b.text for b in blocks if b.label)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, text and n_chars (its code points) for every row.

    The text is empty for a null or empty page and where no block is main text.  A page of any length is read whole, in one pass.  Of two
    decided blocks equally near to an undecided one, main text wins.  Repeated rows are treated alike; an empty table gives an
    empty result; columns besides ``keep`` and the page are not read.
    """

    @F.arrow_udf("string")
    def text(htmls: pa.Array) -> pa.Array:
        return pa.array([main_text(h.as_py()) for h in htmls], pa.string())

    return pages.select(*keep, text(F.col(html_col)).alias("text")).select(*keep, "text", F.length("text").cast("long").alias("n_chars"))
