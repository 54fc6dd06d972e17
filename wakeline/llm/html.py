"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_pieces

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Attributes that can make an element clutter.
TELLING = re.compile("class|id|role|hidden|style", re.I)
SPACES = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?。，；：！？、…]")

#: Elements by their part in the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp svg math object canvas video audio".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math meter output progress q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split()
)
CLUTTER = frozenset("nav footer aside button select option menu dialog head datalist marquee".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag ends, up to a boundary.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements that may hold a page's whole text: clutter only while they hold less than MOST of it.
LOOSE = frozenset("form fieldset header".split())
#: Elements inside which a missing end tag is noticed at the next of BLOCKS, and where BLOCKS end them even before one.
EMBEDDED = frozenset("svg math object canvas video audio title textarea xmp noframes noscript template iframe".split())
FOREIGN = frozenset("svg math".split())
BLOCKS = "address article aside blockquote body center dd div dl dt footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split()
BLOCK = re.compile(rf"<(?:{'|'.join(BLOCKS)})(?=[\s/>])", re.I)
#: Words that mark what is no article, as a whole class, id or role, or as the last noun of one.
CLUTTER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner banners promo promotion promoted sponsor "
    "sponsored sidebar side comment comments commentlist reply replies respond disqus discussion cookie cookies consent gdpr "
    "notice notices alert alerts notification popup modal overlay newsletter subscribe subscription signup login share "
    "sharing social related recommended recommendations menu menus nav navbar navigation breadcrumb breadcrumbs footer "
    "header masthead topbar pagination pager widget widgets toolbar search complementary contentinfo hidden copyright legal "
    "tags toc".split()
)
#: Nouns and places after which the word before decides, as in ad-slot or sidebar-left.
GENERIC = frozenset(
    "slot container wrapper wrap box block list area section bar inner outer unit panel links button buttons item items row "
    "col column group zone holder content body posts articles stories news icons media network networks products items card "
    "cards grid teaser teasers feed this heading count text label message left right top bottom primary secondary mobile "
    "desktop sticky fixed".split()
)
#: Words that say what a part lacks or is arranged with, not what it is; and those whose header is the article's own.
LACKS = frozenset("has no not non with without hide show layout".split())
OWN_HEADER = frozenset("article post entry story news blog main".split())
#: Headings of reader comments, which then go on to the end of the element around the heading.
COMMENTS = re.compile(
    r"(?:\d+ |reader |user )?(?:comments?|kommentare?|leserkommentare|comentarios?|commentaires?)(?: ?\(\d+\)| \d+)?:?|"
    r"leave a (?:reply|comment):?|\d+ (?:replies|responses):?",
    re.I,
)
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Share of a page's text that makes an element the page's body, whatever its name.
MOST = 0.5
#: How sure it is that an element is clutter: by a noun in its name, by its whole name, by its kind.
BY_NOUN, BY_NAME, BY_KIND = 1, 2, 3
LANDMARKS = ("article", "main")
#: Elements nested deeper than this are siblings, as in browsers; no text is lost by it.
DEPTH = 512
#: Share of its ratio that a block keeps outside the marked article.
OUTSIDE = 0.1
#: Share of the content's text that the container holds; share of its text that is content where all of it is the article.
HELD, FILLED = 0.9, 0.8
#: What may close a container of mixed text after the last content block.
CLOSING = frozenset("ul ol dl blockquote pre table".split())


@dataclass
class Block:
    path: str
    text: str
    linked: int
    marks: tuple[Open, ...]
    landmark: str
    element: Open


@dataclass(eq=False)
class Open:
    """An open element; marks are the elements that make it clutter, from the outermost to itself."""

    tag: str
    path: str
    landmark: str
    marks: tuple[Open, ...] = ()
    inline: bool = False
    up: Open | None = None
    sure: int = 0
    comments: bool = False


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(raw)}


def named_clutter(name: str) -> int:
    """BY_NAME if a class, id or role is a clutter word, BY_NOUN if its last noun is, else 0."""
    if name.lower() in CLUTTER_WORDS:
        return BY_NAME
    parts = [w.lower() for w in NAMES.findall(name)]
    while len(parts) > 1 and parts[-1] in GENERIC and parts[-1] not in CLUTTER_WORDS:
        parts.pop()
    if not parts or parts[-1] not in CLUTTER_WORDS or not LACKS.isdisjoint(parts):
        return 0
    return 0 if parts[-1] == "header" and not OWN_HEADER.isdisjoint(parts) else BY_NOUN


def clutter_of(tag: str, raw: str, landmark: str) -> int:
    """How sure it is that an element is clutter by itself: 0, BY_NOUN, BY_NAME or BY_KIND."""
    if tag in LOOSE:
        kind = 0 if tag == "header" and landmark == "article" else BY_NOUN
    else:
        kind = BY_KIND if tag in CLUTTER else 0
    if kind == BY_KIND or not TELLING.search(raw):
        return kind
    a = attributes(raw)
    if ("hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", ""))) and tag not in ("html", "body"):
        return BY_KIND
    if tag in ("html", "body", "main"):
        return 0
    names = f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}".split()
    sure = max(map(named_clutter, names), default=0)
    # An article is clutter only where it is called so as a whole: readers' comments are articles, too.
    return max(kind, 0 if tag == "article" and sure < BY_NAME else sure)


class Tokens:
    """Text and tags of a page in order; every character is looked at a fixed number of times, however broken the page."""

    def __init__(self, html: str):
        self.html, self.gone = html, set()

    def find(self, what: str, at: int) -> int:
        """Like str.find, but what isn't in the rest of the page is not searched for again."""
        if what in self.gone:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def end_of_tag(self, at: int) -> int:
        """The place after the tag's >, past quoted attribute values; of a tag with an open quote, after the next >. -1: none."""
        here = at
        while m := STOP.search(self.html, here):
            if m[0] == ">":
                return m.end()
            close = self.find(m[0], m.end())
            here = close + 1 if close >= 0 else m.end()
        return self.find(">", at) + 1 or -1

    def __iter__(self):
        """(text, "", "") or ("", tag, rest of the tag); a closing tag begins with /."""
        html, at, end = self.html, 0, len(self.html)
        while at < end:
            begin = html.find("<", at)
            if begin < 0 or self.find(">", begin) < 0:
                yield html[at:], "", ""
                return
            if begin > at:
                yield html[at:begin], "", ""
            for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                if html.startswith(opening, begin):
                    stop = self.find(closing, begin)
                    at = stop + len(closing) if stop >= 0 else end
                    break
            else:
                if html.startswith(("<!", "<?"), begin):
                    at = self.find(">", begin) + 1
                    continue
                m = NAME.match(html, begin)
                at = self.end_of_tag(m.end()) if m else -1
                if at < 0:
                    yield "<", "", ""
                    at = begin + 1
                    continue
                tag = m[1].lower()
                closing = html[begin + 1] == "/"
                yield "", "/" + tag if closing else tag, html[m.end() : at - 1]
                if not closing and tag in RAW and html[at - 2] != "/":
                    at = self.end_of_raw(tag, at)

    def seek(self, what: re.Pattern, at: int) -> re.Match | None:
        """Like search(), but what isn't in the rest of the page is not searched for again."""
        found = None if what.pattern in self.gone else what.search(self.html, at)
        if not found:
            self.gone.add(what.pattern)
        return found

    def end_of_raw(self, tag: str, at: int) -> int:
        """Where the content of an element that is not looked into ends.

        Without an end tag scripts and styles go on to the page's end, others to the next block. A block ends svg and math
        even before their end tag, as in browsers.
        """
        end = rf"</{re.escape(tag)}\s*>"
        if tag in FOREIGN:
            m = self.seek(re.compile(rf"{end}|{BLOCK.pattern}", re.I), at)
            return len(self.html) if not m else m.end() if m[0][1] == "/" else m.start()
        if m := self.seek(re.compile(end, re.I), at):
            return m.end()
        m = self.seek(BLOCK, at) if tag in EMBEDDED else None
        return m.start() if m else len(self.html)


def blocks_of(html: str) -> list[Block]:
    """The page's text blocks in order, each with its root-to-leaf path of block elements."""
    out: list[Block] = []
    stack = [Open("", "", "")]
    count: dict[str, int] = {}
    held: list[str] = []
    linked, links = 0, 0

    def add(text: str) -> None:
        nonlocal linked
        held.append(text)
        if links:
            linked += len(text.strip())

    def flush() -> None:
        nonlocal linked
        if held:
            text = SPACES.sub(" ", unescape("".join(held))).strip()
            if text:
                top = next(o for o in reversed(stack) if not o.inline)
                if top.tag in HEADINGS and out and COMMENTS.fullmatch(text) and out[-1].path.startswith(top.up.path):
                    top.up.comments = True
                about = () if not any(o.comments for o in stack) else (COMMENT_PART,)
                out.append(Block(top.path, text, min(linked, len(text)), stack[-1].marks + about, stack[-1].landmark, top))
            held.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal links
        for o in stack[upto:]:
            count[o.tag] -= 1
            if o.tag == "a":
                links = max(0, links - 1)
        del stack[upto:]

    def push(o: Open) -> None:
        if len(stack) < DEPTH:
            stack.append(o)
            count[o.tag] = count.get(o.tag, 0) + 1

    for text, tag, rest in Tokens(html):
        if not tag:
            add(text)
            continue
        closing, tag = tag[0] == "/", tag.lstrip("/")
        if tag == "br":
            add(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in RAW and not closing:
            continue
        if tag in INLINE:
            if closing:
                for i in range(len(stack) - 1, 0, -1) if count.get(tag) else ():
                    if not stack[i].inline:
                        break
                    if stack[i].tag == tag:
                        if stack[i].sure:
                            flush()
                        close(i)
                        break
            elif len(stack) < DEPTH:
                o = Open(tag, stack[-1].path, stack[-1].landmark, inline=True, sure=clutter_of(tag, rest, stack[-1].landmark))
                if o.sure:
                    flush()
                o.marks = stack[-1].marks + ((o,) if o.sure else ())
                push(o)
                links += tag == "a"
            continue
        flush()
        if closing:
            for i in range(len(stack) - 1, 0, -1) if count.get(tag) else ():
                if stack[i].tag == tag:
                    close(i)
                    break
            continue
        if count.get("head") and tag not in ("html", "head"):
            # Its end tag may be left out; nothing that stands in it comes here.
            close(next(i for i, o in enumerate(stack) if o.tag == "head"))
        # A paragraph ends where any block begins; some elements end their like.
        ended, bounds = ENDS.get(tag, ({"p"}, {"table", "td", "div", "article", "section", "body"}))
        for i in range(len(stack) - 1, 0, -1) if any(count.get(t) for t in (*ended, "p")) else ():
            if stack[i].tag in bounds:
                break
            if stack[i].tag in ended or stack[i].tag == "p":
                close(i)
                break
        if rest.endswith("/") and tag not in ("p", "div", "li", "td"):
            continue
        up = stack[-1]
        landmark = up.landmark
        if tag in LANDMARKS and landmark != "article":
            landmark = tag
        o = Open(tag, f"{up.path}/{tag}", landmark, up=next(o for o in reversed(stack) if not o.inline), sure=clutter_of(tag, rest, up.landmark))
        o.marks = up.marks + ((o,) if o.sure else ())
        push(o)
    flush()
    return out


#: What marks blocks after a heading of reader comments.
COMMENT_PART = Open("", "", "", sure=BY_KIND)


def uncluttered(blocks: list[Block]) -> list[Block]:
    """The blocks that no clutter element is around.

    An element that is clutter only by a noun in its name, or as a form or header, is none if it holds MOST of the text that is
    not surely clutter. If that leaves nothing, so it is with elements that are clutter by their whole name.
    """
    for doubt in (BY_NOUN, BY_NAME):
        held: dict[Open, int] = {}
        total = 0
        for b in blocks:
            if all(o.sure <= doubt for o in b.marks):
                total += len(b.text)
                for o in b.marks:
                    held[o] = held.get(o, 0) + len(b.text)
        bodies = {o for o, n in held.items() if n >= MOST * total}
        left = [b for b in blocks if all(o in bodies for o in b.marks)]
        if left:
            break
    return left


def smoothed(values: np.ndarray, radius: int = 1) -> np.ndarray:
    """Gaussian smoothing over the order of the blocks."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / max(radius, 1)) ** 2)
    padded = np.pad(values, radius, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def ancestors(element: Open):
    """The elements around an element, from the nearest."""
    while element.up is not None:
        element = element.up
        yield element


def choice(blocks: list[Block], content: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """Which blocks belong to the article: all content, and what is short beside it.

    The container is the lowest element (not path) that holds HELD of the content's text. Where FILLED of its text
    is content it is the article, and its other blocks that are not links belong to it. In a container of mixed text
    these do: headings before its first content block, blocks between that are not links, and lists, quotes or tables
    right in it that follow the last.
    """
    own: dict[Open, int] = {}
    for b, ok in zip(blocks, content):
        if ok:
            up = b.element.up or b.element
            own[up] = own.get(up, 0) + len(b.text)
    weight: dict[Open, int] = {}
    for up, n in own.items():
        for o in (up, *ancestors(up)):
            weight[o] = weight.get(o, 0) + n
    most = max(weight.values())
    container = max((o for o in weight if weight[o] >= HELD * most), key=lambda o: o.path.count("/"))
    below: dict[Open, Open | None] = {}

    def child_of(element: Open) -> Open | None:
        """The container's child that the element is or is in, or the container itself; None outside."""
        up = element.up
        if element is container or up is None:
            return container if element is container else None
        if up is container:
            return element
        if up not in below:
            line = [up, *ancestors(up)]
            below[up] = line[line.index(container) - 1] if container in line else None
        return below[up]

    child = [child_of(b.element) for b in blocks]
    inside = np.array([c is not None for c in child])
    length = np.array([len(b.text) for b in blocks])
    if length[inside & content].sum() >= FILLED * length[inside].sum():
        return content | (inside & (plain > 0.5))
    where = np.flatnonzero(inside & content)
    first, last = int(where[0]), int(where[-1])
    while first and inside[first - 1] and blocks[first - 1].path.rpartition("/")[2] in HEADINGS:
        first -= 1
    while last + 1 < len(blocks) and inside[last + 1] and child[last + 1].tag in CLOSING and plain[last + 1] > 0.5:
        last += 1
    span = np.zeros(len(blocks), dtype=bool)
    span[first : last + 1] = True
    return content | (inside & span & (plain > 0.5))


def main_text(html: str) -> str:
    """The article's blocks, joined by line ends.

    For each tag path: the text length and the punctuation of its blocks over their number. Both ratios,
    smoothed over the order of the blocks, are fused (their product, scaled by the path's text outside links and by
    OUTSIDE where the page marks an article and the block is not in it), and blocks above the mean times a half are
    content. Clutter (by element, class, id or role, see uncluttered()) has ratio 0. choice() adds what is short beside the content.
    """
    blocks = uncluttered(blocks_of(html))
    if not blocks:
        return ""
    mark = next((m for m in LANDMARKS if any(b.landmark == m for b in blocks)), "")
    marked = np.array([b.landmark == mark for b in blocks])
    total: dict[str, list[int]] = {}
    for b in blocks:
        t = total.setdefault(b.path, [0, 0, 0, 0])
        t[0] += len(b.text)
        t[1] += len(PUNCTUATION.findall(b.text))
        t[2] += 1
        t[3] += b.linked
    ratio = lambda k: np.array([total[b.path][k] / total[b.path][2] for b in blocks])
    plain = np.array([1 - total[b.path][3] / max(1, total[b.path][0]) for b in blocks])
    fused = np.sqrt(smoothed(ratio(0)) * (smoothed(ratio(1)) + 0.1)) * plain * np.where(marked, 1.0, OUTSIDE)
    content = fused >= 0.5 * fused.mean()
    return "\n".join(b.text for b, ok in zip(blocks, choice(blocks, content, plain)) if ok)


def main_texts(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """One row for each input row: page_id, url, text, n_chars (code points).

    Row by row over the whole html, without a shuffle, in time linear in its length. A null or empty html gives an
    empty text, as does a page without content; a null url or id stays null, an empty table gives no rows. Ids are
    numbers. Repeated rows give repeated rows; other columns, whatever their names, don't matter.
    """

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(h) if h else "" for h in batch.column("_html").to_pylist()]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

        return each

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("_html"))
    return map_pieces(rows, "_html", make, "page_id bigint, url string, text string, n_chars bigint")
