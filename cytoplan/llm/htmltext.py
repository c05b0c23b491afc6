"""Main text of web pages by two passes over blocks (operator 4).

A page is cut into blocks at block-level tags by one scan, linear in its length. Forms, scripts, styles and other elements that
show no running text are no blocks.

Pass one grades each block by its density of stop words, its length and its link density: good, bad, or undecided (short, or between
the bounds). The stop words are of four languages; a long block with few of them is good, too, if it is made of sentences by its punctuation, and where a page
has no good block by either, length and link density alone decide, so no language empties a page. Tags and attributes are evidence beside that. Menus, headers, footers, sidebars, adverts, notices and comments, by element or by a
whole token of class, id or role, make a block bad; if that leaves no good block on a page, this evidence is taken back. An article or main element
with text keeps blocks in it from being bad for few stop words, and blocks beside it from being good.

Pass two: an undecided block takes the label of its nearest decided neighbours: those of its article or main element, if it is in one, else
of the page. In an article one good neighbour, or none decided, is enough; elsewhere both have to be good; a heading looks
at the block that follows. Each page is handled by itself.

Defined cases: a null or empty page has the text ""; tags that are never closed end with their parent or the page; an end tag
without a start is passed over, a quote without an end ends with its tag, a comment without an end hides the rest; very long pages are read whole, in time in proportion to
their length; repeated rows give a result each; an empty table gives an empty result; columns other than page_id, url and html are not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pass one: bounds of jusText (Pomikálek 2011).
MAX_LINK_DENSITY, SHORT, LONG, STOP_LOW, STOP_HIGH = 0.5, 70, 200, 0.10, 0.20

# Frequent function words of four languages.
STOP_WORDS = frozenset(
    """a about all an and are as at be been but by can do for from had has have he her his i if in into is it its more no not of
    on one or our she so than that the their there they this to was we were what when which who will with would you
    au aux avec ce ces dans de des du elle en est et il ils la le les leur lui mais ne nous on ou par pas plus pour qu que qui
    sa se ses son sont sur un une vous y
    aber als am an auch auf aus bei das dass dem den der des die du ein eine einem einen einer er es für hat ich ihr im in ist
    mit nach nicht noch nur oder sich sie sind so und von vor war was wie wir zu zum zur über
    al como con cuando de del desde el ella en entre era es esta este fue ha hay la las lo los me mi muy más no nos o para pero
    por que se ser si sin sobre su sus también un una y ya""".split()
)
# Element names of HTML.
HIDDEN = frozenset("script style template noscript svg math canvas iframe object head title select option textarea button input label form dialog audio video map".split())
OUTSIDE = frozenset("nav footer aside menu header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset head header "
    "hgroup hr html legend li main menu nav noframes ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed".split())
#: Elements that end an open element of the same kind.
ALIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ()}
#: A token of class, id or role marks what is not the article if all its parts are among these, one of MARKS at least.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments consent cookie cookies disqus feedback footer "
    "gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related "
    "reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar topbar widget widgets complementary contentinfo".split()
)
BESIDE = frozenset("area bar block bottom box button buttons col column container content divider form global group header holder inner item items left links list main outer page post posts primary row right secondary section site slot top unit wrap wrapper".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SIGN = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_PART = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")
#: Ends of sentences; signs of scripts that put a word or a syllable in one of them.
_SENTENCE = re.compile(r"[.!?…](?=[\s\"'”’»)]|$)|[。！？।؟]")
_WIDE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")


@dataclass
class Block:
    text: str
    linked: int = 0  # code points inside links
    heading: bool = False
    marked: bool = False  # in an element whose name or attributes speak against it
    region: int = 0  # the article or main element that it is in, from 1 on
    tag: str = ""  # the innermost block element


class Tags:
    """A scan for tags: (text before, name, is an end tag, attributes, place after) until the page ends."""

    def __init__(self, page: str):
        self.page = page
        self.without: set[str] = set()  # signs that do not stand further on

    def _find(self, sign: str, at: int) -> int:
        if sign in self.without:
            return -1
        if (found := self.page.find(sign, at)) < 0:
            self.without.add(sign)
        return found

    def end_of(self, at: int) -> int:
        """The > that ends the tag whose attributes start here; -1 without one."""
        while (m := _SIGN.search(self.page, at)) if ">" not in self.without else None:
            if m[0] == ">":
                return m.start()
            # A quote opens a value only behind an equals sign.
            close = self._find(m[0], m.end()) if self.page[max(0, m.start() - 80) : m.start()].rstrip().endswith("=") else -1
            at = m.end() if close < 0 else close + 1
        self.without.add(">")
        return -1

    def __iter__(self) -> Iterator[tuple[str, str, bool, str, int]]:
        page, at, text = self.page, 0, 0
        while (at := self._find("<", at)) >= 0:
            if page.startswith("<!--", at):
                close = self._find("-->", at + 4)
                before, text = page[text:at], len(page) if close < 0 else close + 3
                at = text
                yield before, "", False, "", at
                continue
            if page[at + 1 : at + 2] in ("!", "?"):
                close = self._find(">", at)
                before, text = page[text:at], len(page) if close < 0 else close + 1
                at = text
                yield before, "", False, "", at
                continue
            is_end = page[at + 1 : at + 2] == "/"
            name = _NAME.match(page, at + 1 + is_end)
            close = self.end_of(name.end()) if name else -1
            if close < 0:
                at += 1  # a sign in the text
                if ">" in self.without:  # no tag ends any more: only what hides the rest of the page is looked for
                    at = min((k for k in (page.find("<!", at), page.find("<?", at)) if k >= 0), default=len(page))
                continue
            before, text = page[text:at], close + 1
            at = text
            lower = name[0].lower()
            attributes = page[name.end() : close]
            if lower in RAW and not is_end and not attributes.rstrip().endswith("/"):
                raw = re.compile(rf"</{re.escape(lower)}(?:\s[^>]*|/[^>]*)?>", re.I).search(page, at) if f"</{lower}" not in self.without else None
                if raw is None:
                    self.without.add(f"</{lower}")
                text = at = raw.end() if raw else len(page)  # its content is no text of the page
                yield before, lower, False, "/", at
                continue
            yield before, lower, is_end, attributes, at
        yield page[text:], "", False, "", len(page)


def _is_mark(token: str) -> bool:
    parts = _PART.findall(token)
    return any(p in MARKS for p in parts) and all(p in MARKS or p in BESIDE or p.isdigit() for p in parts)


def _speaks_against(name: str, attributes: str) -> tuple[bool, bool]:
    """(shows nothing, is marked)."""
    if name in ("body", "html", "article", "main"):
        return False, False
    hidden, marked = name in HIDDEN, name in OUTSIDE
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        marked = marked or key in ("class", "id", "role") and any(map(_is_mark, value.split()))
        hidden = hidden or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value) is not None
    return hidden, marked


@dataclass
class _Open:
    name: str
    hidden: bool
    marked: bool
    region: int


def blocks_of(page: str) -> list[Block]:
    found: list[Block] = []
    root = _Open("", False, False, 0)
    stack, block_places = [root], [0]  # open elements; places of those of them that are blocks
    scopes: list[dict[str, int]] = [{}]  # how many of each name are open in each article, main or body
    parts: list[str] = []
    linked = links = regions = 0
    heading = False

    def end() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            found.append(Block(text, linked, heading, stack[-1].marked, stack[-1].region, innermost()))
        parts.clear()
        linked = 0

    def pop() -> None:
        nonlocal links
        x = stack.pop()
        if x.name in ("article", "main", "body"):
            scopes.pop()
        scopes[-1][x.name] -= 1
        links -= x.name == "a"
        if block_places[-1] == len(stack):
            block_places.pop()

    def innermost() -> str:
        return stack[block_places[-1]].name

    for before, name, is_end, attributes, _ in Tags(page):
        if before and not stack[-1].hidden:
            text = entities.unescape(before)
            parts.append(text)
            if links:
                linked += len(text.strip())
        if not name:
            continue
        if name in BLOCKS:
            end()
            heading = not is_end and name in HEADINGS
        elif name == "br":
            parts.append(" ")
        if name in VOID or name in RAW and attributes == "/":
            continue
        if is_end:
            if scopes[-1].get(name):
                while stack[-1].name != name:
                    pop()
                pop()
            elif len(scopes) > 1 and scopes[-2].get(name) and name in ("article", "main", "body", "html"):
                while stack[-1].name != name:
                    pop()
                pop()
            continue
        if name in BLOCKS:
            while innermost() == "p" or innermost() in ALIKE.get(name, ()):  # such elements end where the next begins
                k = block_places[-1]
                while len(stack) > k:
                    pop()
        top = stack[-1]
        hidden, marked = _speaks_against(name, attributes)
        is_region = name in ("article", "main") or 'role="main"' in attributes.lower()
        if name == "header" and top.region:
            marked = False  # the title of an article
        if is_region and not top.region:
            regions += 1
        region = top.region or (regions if is_region else 0)
        scopes[-1][name] = scopes[-1].get(name, 0) + 1
        if name in ("article", "main", "body"):
            scopes.append({})
        if name in BLOCKS:
            block_places.append(len(stack))
        stack.append(_Open(name, top.hidden or hidden, top.marked or marked, region))
        links += name == "a"
    end()
    return found


GOOD, BAD, OPEN = True, False, None


def size_of(b: Block) -> int:
    """Code points; one of a script that puts more in each counts three."""
    return len(b.text) + 2 * len(_WIDE.findall(b.text))


def grade(b: Block) -> bool | None:
    """Pass one, by density alone."""
    size = size_of(b)
    words = _WORD.findall(b.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if b.linked > MAX_LINK_DENSITY * len(b.text):
        return GOOD if b.region and size >= SHORT and stops >= STOP_HIGH else BAD
    if b.heading or size < SHORT:
        return OPEN
    if stops >= STOP_HIGH and (size > LONG or b.region):
        return GOOD
    if size > LONG and len(_SENTENCE.findall(b.text)) >= 2:
        return GOOD
    if stops >= STOP_LOW or b.region:
        return OPEN
    return BAD


def grade_by_length(b: Block, least: int) -> bool | None:
    """Pass one where neither stop words nor sentences tell anything."""
    if b.linked > MAX_LINK_DENSITY * len(b.text):
        return BAD
    return GOOD if size_of(b) >= least and not b.heading else OPEN


def grades_of(blocks: list[Block]) -> tuple[list[bool | None], list[bool]]:
    """Pass one over a page: the grade of each block by all evidence, and whether a mark made it bad."""
    kept = [not b.marked for b in blocks]
    for kept in (kept, [True] * len(blocks)):  # marks that leave no article are taken back
        for least in (None, LONG, SHORT):
            own = [grade(b) if least is None else grade_by_length(b, least) for b in blocks]
            if any((g is GOOD or b.region) and k for g, b, k in zip(own, blocks, kept, strict=True)):
                break
        else:
            continue
        break
    else:
        own = [grade(b) for b in blocks]
    article = any(b.region and k for b, k in zip(blocks, kept, strict=True))
    first: list[bool | None] = []
    for b, k, g in zip(blocks, kept, own, strict=True):
        if not k:
            g = BAD
        elif article and not b.region:
            g = OPEN if g is GOOD else BAD
        first.append(g)
    # A linked paragraph in an article is no list of links, nor is a linked line by itself.
    for k, b in enumerate(blocks):
        if first[k] is BAD and b.region and kept[k]:
            beside = [j for j in (k - 1, k + 1) if 0 <= j < len(blocks) and blocks[j].region == b.region]
            if b.tag == "p" or not any(blocks[j].linked > MAX_LINK_DENSITY * len(blocks[j].text) for j in beside):
                first[k] = OPEN
    return first, [not k for k in kept]


def labels_of(blocks: list[Block]) -> list[bool]:
    """Whether each block is kept: pass two over the grades of pass one."""
    first, _ = grades_of(blocks)
    n = len(blocks)
    before, after = [OPEN] * n, [OPEN] * n
    for k in range(1, n):
        if blocks[k].region == blocks[k - 1].region or not blocks[k].region:
            before[k] = before[k - 1] if first[k - 1] is OPEN else first[k - 1]
    for k in range(n - 2, -1, -1):
        if blocks[k].region == blocks[k + 1].region or not blocks[k].region:
            after[k] = after[k + 1] if first[k + 1] is OPEN else first[k + 1]
    any_decided = any(x is not OPEN for x in first)
    out = []
    for k, b in enumerate(blocks):
        if (label := first[k]) is OPEN:
            near = [x for x in ((after[k],) if b.heading and after[k] is not OPEN else (before[k], after[k])) if x is not OPEN]
            if b.region:
                label = not near or any(near)
            else:
                label = bool(near) and all(near) or not any_decided
        out.append(bool(label))
    return out


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, keep in zip(blocks, labels_of(blocks), strict=True) if keep)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 200):
            part = batch.slice(at, 200)
            text = [main_text(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
