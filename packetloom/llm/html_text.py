"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_batches, texts

#: Elements that begin a block of their own. Fixed values of HTML.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
#: Elements without content. Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup. Fixed values of HTML.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math canvas object".split())
#: Elements that never hold main text. Fixed values.
NEVER = frozenset("nav aside footer form script style noscript iframe button select option input textarea template svg math canvas object head menu dialog title".split())
#: Words in class, id or role that mark what is no main text, and those that do so only outside an article. Fixed values.
_ALWAYS = r"ads?|advert\w*|adsense|banners?|promo\w*|sponsor\w*|comments?|disqus|respond|reply|replies|sidebars?|widgets?|menus?|navbar|nav|navigation|breadcrumbs?|footers?|cookies?|consent|gdpr|notices?|popups?|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|pagination|pager|toolbar|alert|disclaimer|copyright|complementary|contentinfo"
_OUTSIDE = r"headers?|masthead|side|tags?|skip|search"
MARKED_INSIDE = re.compile(rf"(?:^|[\s_-])(?:{_ALWAYS})(?:$|[\s_-])", re.I)
MARKED = re.compile(rf"(?:^|[\s_-])(?:{_ALWAYS}|{_OUTSIDE})(?:$|[\s_-])", re.I)
#: Elements that may close an open one of the same kind, as HTML lets their end tags be left out. Fixed values.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that leave a head open; text or any other element ends it. Fixed values.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head".split())
#: Elements whose blocks are judged together; within an article a section is no box of its own. Fixed values.
BOXES = frozenset("center details div fieldset search section".split())
#: Lists and tables, headings, and elements of running text. Fixed values.
LISTS, HEADINGS, PROSE = frozenset("dl figure ol table ul".split()), frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("blockquote p pre".split())
SCOPES = frozenset("article section div body ul ol dl table td th main blockquote html".split())

#: Tags on a page whose quotes never close, after which quotes count for nothing on it: so a page of them is read in one pass.
MOST_UNCLOSED = 8
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9:-]*")
_ENDS = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_SPACE = re.compile(r"\s+")
_MARKS = re.compile(r"[.,;:!?…。，]")


class Paths:
    """Root-to-leaf tag paths as numbers: each has its parent's number and its last tag, so deep pages cost no more than their tags."""

    def __init__(self):
        self.parent, self.tag, self.in_content = [0], [""], [False]
        self.known: dict[tuple[int, str], int] = {}

    def below(self, path: int, tag: str) -> int:
        n = self.known.get((path, tag))
        if n is None:
            n = self.known[path, tag] = len(self.tag)
            self.parent.append(path)
            self.tag.append(tag)
            self.in_content.append(self.in_content[path] or tag in ("article", "main"))
        return n


class Block:
    __slots__ = ("path", "parts", "banned", "links", "box", "listed", "own")

    def __init__(self, path: int, banned: bool, box: tuple[int, ...] = (0,), listed: bool = False):
        self.path, self.parts, self.banned, self.links, self.box, self.listed, self.own = path, [], banned, 0, box, listed, None

    def text(self) -> str:
        if self.own is None:
            self.own = _SPACE.sub(" ", "".join(self.parts)).strip()
        return self.own

    def mostly_links(self) -> bool:
        return 2 * self.links >= len(self.text())


def tokens(page: str):
    """(text, tag, closing, attributes) of the page in order; a text has no tag. Comments, declarations and sections of data are left out, what follows an end
    that is missing too; a tag without an end is text. What a raw element holds is left out by sending a place to go on from."""
    at, n, last = 0, len(page), page.rfind(">")
    last_quote = {q: page.rfind(q) for q in "\"'"}
    unclosed = 0
    while at < n:
        start = page.find("<", at)
        if start != at:
            start = n if start < 0 else start
            yield page[at:start], None, False, ""
            at = start
            continue
        if page.startswith("<!--", at) or page.startswith("<![CDATA[", at):
            end = page.find("-->" if page[at + 2] == "-" else "]]>", at + 4)
            if end < 0:
                return
            at = end + 3
            continue
        closing = page.startswith("/", at + 1)
        name = _NAME.match(page, at + 1 + closing)
        if at > last or not (name or page[at + 1 : at + 2] in ("!", "?")):
            yield "<", None, False, ""
            at += 1
            continue
        if not name or closing or unclosed >= MOST_UNCLOSED:
            end = page.find(">", at)
        else:
            end = name.end()
            while m := _ENDS.search(page, end):
                if m[0] == ">":
                    end = m.start()
                    break
                if m.start() == last_quote[m[0]]:  # a quote that never closes is a mark like others
                    end = m.end()
                else:
                    end = page.find(m[0], m.end()) + 1
            else:
                unclosed += 1
                end = page.find(">", at)
        at = end + 1
        if name:
            jump = yield None, name[0].lower(), closing, "" if closing else page[name.end() : end]
            if jump is not None:
                at = n if jump == "never" else _after(page, at, jump)
                yield None, "", False, ""


def _after(page: str, at: int, tag: str) -> int:
    m = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
    return m.end() if m else len(page)


class _Open:
    """An open element."""

    __slots__ = ("tag", "path", "block", "banned", "linked", "boxes", "listed")

    def __init__(self, tag, path, block, banned, linked, boxes, listed):
        self.tag, self.path, self.block, self.banned, self.linked, self.boxes, self.listed = tag, path, block, banned, linked, boxes, listed


def blocks(page: str) -> tuple[list[Block], Paths]:
    """The page's blocks in order, each with the path of tags and the boxes that lead to it."""
    out: list[Block] = []
    paths = Paths()
    root = _Open("", 0, 0, False, False, (0,), False)
    stack: list[_Open] = []
    n_open: dict[str, int] = {}
    n_boxes = 0
    now: Block | None = None

    def shut(i: int) -> None:
        for x in stack[i:]:
            n_open[x.tag] -= 1
        del stack[i:]

    def shut_within_scope(tags) -> None:
        if any(n_open.get(t) for t in tags):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in tags:
                    shut(i)
                    return
                if stack[i].tag in SCOPES:
                    return

    found = tokens(page)
    for text, tag, closing, attributes in found:
        if stack and stack[-1].tag == "head" and (text.strip() if tag is None else not closing and tag not in HEAD):
            shut(len(stack) - 1)
        top = stack[-1] if stack else root
        if tag is None:
            if now is None:
                now = Block(top.block, top.banned, top.boxes, top.listed)
                out.append(now)
            value = html.unescape(text)
            if top.banned and not now.banned:
                continue
            now.parts.append(value)
            if top.linked:
                now.links += len(value)
        elif closing:
            if tag in BLOCKS:
                now = None
            if n_open.get(tag):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == tag:
                        shut(i)
                        break
                    if tag not in BLOCKS and stack[i].tag in BLOCKS:
                        break
        else:
            if tag == "br":
                if now is not None:
                    now.parts.append(" ")
                continue
            if tag in BLOCKS:
                now = None
                if tag in CLOSES:
                    shut_within_scope(CLOSES[tag])
                elif any(x.tag == "p" for x in stack[-3:]):  # a block ends an open paragraph
                    shut_within_scope(("p",))
            if tag in VOID or attributes.endswith("/"):
                continue
            top = stack[-1] if stack else root
            in_content = paths.in_content[top.path]
            banned = top.banned or tag in NEVER or (tag == "header" and not in_content)
            if attributes and not banned and tag not in ("html", "body", "article", "main"):
                marked = MARKED_INSIDE if in_content else MARKED
                banned = any(marked.search(" ".join(filter(None, a))) for a in _ATTRIBUTE.findall(attributes)) or bool(_HIDDEN.search(attributes))
            box, listed = top.boxes, top.listed or tag in LISTS
            if tag in BOXES and not listed and not (tag == "section" and in_content):
                n_boxes += 1
                box = (*box[-7:], n_boxes)
            if tag in RAW:
                found.send(tag)
                continue
            path = paths.below(top.path, tag)
            stack.append(_Open(tag, path, path if tag in BLOCKS else top.block, banned, top.linked or tag == "a", box, listed))
            n_open[tag] = n_open.get(tag, 0) + 1
    return [b for b in out if b.text()], paths


def path_scores(found: list[Block], paths: Paths) -> dict[int, float]:
    """By path: share of text and of punctuation of its blocks, smoothed with its neighbours in page order below the same parent, and fused."""
    length: dict[int, list[float]] = {}
    for b in found:
        t = b.text()
        row = length.setdefault(b.path, [0.0, 0.0, 0.0, 0.0])
        row[0] += len(t)
        row[1] += len(_MARKS.findall(t))
        row[2] += b.links
        row[3] += 1
    raw = {p: (np.log1p(c / k) * max(0.0, 1 - l / max(c, 1))) * (1 + np.log1p(m / k)) for p, (c, m, l, k) in length.items()}
    order = list(dict.fromkeys(b.path for b in found))
    smooth = {}
    for i, p in enumerate(order):
        near = [raw[q] for q in order[max(0, i - 1) : i + 2] if paths.parent[q] == paths.parent[p]]
        smooth[p] = 0.5 * raw[p] + 0.5 * float(np.mean(near))
    return smooth


def boxed(found: list[Block]) -> list[int]:
    """The box that each block is judged with. A box of lists and tables alone, if not mostly of links, goes with the one around it."""
    length: dict[int, list[int]] = {}
    for b in found:
        row = length.setdefault(b.box[-1], [0, 0, 0])
        row[0] += len(b.text())
        row[1] += b.links
        row[2] += not b.listed
    return [next((x for x in reversed(b.box) if x in length and (length[x][2] or 2 * length[x][1] >= length[x][0])), b.box[0]) for b in found]


def main_text(page: str) -> str:
    """Blocks of the main text, one line each.

    Blocks in elements or classes that never hold main text are left out. Where the page marks an article or main part, only its blocks count. Paths that
    score at least a fifth of the best one are kept, and in a marked part all running text that is not mostly links. What shares a box with them stays: short
    items, cells and lists of links, these outside a marked part only after kept text, and beside the page's own body only between kept text. Headings go
    with what follows them."""
    found, paths = blocks(page)
    found = [b for b in found if not b.banned]
    if not found:
        return ""
    scores = path_scores(found, paths)
    marked = [b for b in found if paths.in_content[b.path]]
    own = marked or found
    least, linked, boxes = 0.2 * max(scores[b.path] for b in own), [b.mostly_links() for b in own], boxed(own)
    last = [paths.tag[b.path] for b in own]
    strong = [scores[b.path] > 0 and scores[b.path] >= least or bool(marked) and not l and t in PROSE for b, l, t in zip(own, linked, last)]
    if marked and not any(strong):
        return "\n".join(b.text() for b in own)
    first, final = {}, {}
    for i, (x, s) in enumerate(zip(boxes, strong)):
        if s:
            first.setdefault(x, i)
            final[x] = i
    keep = [s or x in first and (bool(marked) or not l or first[x] < i and (x > 0 or i < final[x])) for i, (x, s, l) in enumerate(zip(boxes, strong, linked))]
    for i in range(len(own) - 2, -1, -1):
        keep[i] = keep[i] or last[i] in HEADINGS and not linked[i] and keep[i + 1]
    return "\n".join(b.text() for b, k in zip(own, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page. Null or empty html has an empty text; pages are independent, so rows that are repeated, or have no page_id or
    url, give rows of their own. Pages of any length and depth are read whole, in one pass. Other columns play no part. No pages, no rows."""

    def run(batch: pa.RecordBatch) -> dict:
        own = [main_text(t) for t in texts(batch, "html")]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": own, "n_chars": list(map(len, own))}

    return in_batches(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")


def op8_html(pages: DataFrame) -> DataFrame:
    return extract(pages)
