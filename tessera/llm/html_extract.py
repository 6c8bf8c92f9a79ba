"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks:
those inside containers that name themselves menu, header, footer, sidebar,
notice, advert, form or comments are bad; all others are judged by link density,
length and the share of stop words. Short blocks and blocks of middling density
stay undecided. The second pass gives each of them the label of the nearest
decided block on either side (what a container decided ends with it and says
nothing of the blocks around): if these disagree, a block of middling density is
good and a short one takes the nearer side's label (on a tie it is good if it
ends as a sentence without links); headings look downwards only. Decided blocks
of the same container come before nearer ones beyond it, and a block in a
container without any is taken for a short one. A page without any good block
starts from its longest undecided one.

A declared article or main part is evidence that both passes weigh. It counts if
it holds at least as much surely good text as the rest of the page; a card or a
teaser beside the real article doesn't. Density decides inside and outside of it
alike, but for headings inside, which may be links. Inside and outside are then
passed on apart: an undecided block whose neighbours don't both say otherwise is
good inside and bad outside, and inside a block of middling density stays good
between bad ones. A main element inside a container that names itself
boilerplate takes the name back; an article does so only where nothing else is
declared, and not in comments, adverts, related links or a nav, aside or footer.

Defined results: a null or empty page has an empty text; broken markup is read
as browsers do, as far as blocks need (open elements end with their parent, a
lone end tag is dropped, a bare < is text, what follows the last > is text, a
tag or comment that never ends takes the rest of the page); pages of any length
are read whole, in time that grows with their length, however broken they are;
repeated rows are extracted each; input columns named like an output are
replaced.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches

#: Share of link characters above which a block is bad.
LINK_DENSITY = 0.33
#: Characters: shorter blocks are undecided, longer ones of high density are good.
SHORT, LONG = 60, 160
#: Share of stop words: below the first a block with any link is bad, from the second on a block is good.
FEW_STOPS, MANY_STOPS = 0.06, 0.14

#: Stop words of the languages read (fixed values).
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i if in is it its not of on or she so that the their they this to was we were what when which who will with you"
    " au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou par pas pour qu que qui sa se ses son sur un une vous"
    " aber als am auch auf aus bei das dass dem den der des die ein eine einem einen einer es für hat ich ihr im ist mit nach nicht noch oder sich sie sind so über um und von vor war wie zu zum zur"
    " al como con del el ella en era es esta este ha la las lo los más me muy no o para pero por que se si sin sobre su sus también un una y ya".split()
)
#: Elements that begin and end blocks (fixed values).
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text isn't for reading.
SILENT = frozenset("head title script style noscript template svg math iframe object canvas audio video select textarea button datalist".split())
ASIDE = frozenset("nav header footer aside form menu dialog search".split())
#: Words in class, id and role that mark a container as no part of the article (fixed values).
HINTS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies copyright dialog disclaimer discussion disqus donate feedback footer form gdpr header login masthead menu modal nav navbar navigation navi newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promoted promotion recommended recommendations related replies reply respond responses rss search share sharing sharebar sidebar signup skip social sponsor sponsored subscribe subscription taboola teaser toolbar topbar warning widget".split()
)
#: Words that make a div or section the main part (fixed values).
MAIN_WORDS = frozenset("article articlebody entry story".split())
#: Words before a hint that take it back: has-sidebar, with-comments.
NEGATED = frozenset(("has", "with", "no", "without", "not"))
#: A main part that names itself one of these is none.
NOT_MAIN = frozenset("ad ads advert comment comments promo related reply sponsored teaser".split())
#: Elements whose blocks belong together.
CONTAINERS = frozenset("article aside body div fieldset footer form header main nav section td".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: An open element of the first kind ends where one of the second begins.
CLOSED_BY = {
    "p": BLOCKS - {"body", "html", "head", "caption", "td", "th", "tr", "option", "optgroup"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}, "head": {"body"},
}

#: A tag up to its end: quotes count where a value begins. No part is ever given back, so a page is read once, however broken.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>")
_COMMENT_END = re.compile(r"--!?>")
#: Elements whose content holds no tags, or none that count, and their ends.
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in ("script", "style", "noscript", "template", "textarea", "iframe", "svg")}
_ATTR = re.compile(r"\b(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"\w+")
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Block:
    __slots__ = ("box", "heading", "label", "linked", "place", "text")

    def __init__(self, text: str, linked: int, place: str, heading: bool, box: int):
        self.text, self.linked, self.place, self.heading, self.box, self.label = text, linked, place, heading, box, None


def _hinted(name: str, attr: str) -> str:
    """'' or what the element's own name and attributes say: silent, shut (an aside that no article opens), aside, title (a header), main or article."""
    if name in SILENT:
        return "silent"
    words: list[str] = []
    for key, *values in _ATTR.findall(attr) if attr else ():
        value, key = "".join(values), key.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return "silent"
        if key in ("class", "id", "role", "itemprop"):
            for part in value.split():
                own = [w.lower() for w in _CAMEL.findall(part)] if part.lower() != "articlebody" else ["articlebody"]
                words += [w for i, w in enumerate(own) if not i or own[i - 1] not in NEGATED]
    if name in ("article", "main") or "role" in attr and "main" in words:
        return "shut" if NOT_MAIN.intersection(words) else "article" if name == "article" else "main"
    hints = HINTS.intersection(words) if name not in ("html", "body", *HEADINGS) else frozenset()
    if name == "header" or hints == {"header"}:
        return "title"
    if name in ASIDE or hints:
        return "shut" if name in ASIDE - {"form"} or NOT_MAIN.intersection(words) else "aside"
    return "article" if name in ("div", "section") and MAIN_WORDS.intersection(words) else ""


def tokens(page: str):
    """(text, None, '', False) for text, ('', name, attributes, whether it ends) for tags; what no reader sees is left out."""
    at, last = 0, page.rfind(">")
    while at < len(page):
        begin = page.find("<", at)
        if begin < 0 or begin > last:  # no tag can end any more
            yield page[at:], None, "", False
            return
        if begin > at:
            yield page[at:begin], None, "", False
        kind = page[begin + 1]
        if page.startswith("<!--", begin):
            end = _COMMENT_END.search(page, begin + 2)
            at = end.end() if end else len(page)
        elif page.startswith("<![CDATA[", begin):
            end = page.find("]]>", begin)
            yield page[begin + 9 : end if end >= 0 else len(page)], None, "", False
            at = end + 3 if end >= 0 else len(page)
        elif kind in "!?":
            at = page.find(">", begin) + 1
        elif not (kind.isascii() and kind.isalpha() or kind == "/" and page[begin + 2 : begin + 3].isalpha() and page[begin + 2].isascii()):
            yield "<", None, "", False
            at = begin + 1
        else:
            tag = _TAG.match(page, begin)
            if not tag:  # it never ends
                return
            name, ends, attr, at = tag[2].lower(), tag[1] != "", tag[3], tag.end()
            yield "", name, attr, ends
            if name in _RAW_END and not ends:
                # its content goes; what ends it ends the element, too
                end = None if attr.endswith("/") else _RAW_END[name].search(page, at)
                at = at if attr.endswith("/") else end.end() if end else len(page)
                yield "", name, "", True


class Open:
    """The open elements, from the outermost in: names and what holds inside each.

    Which names are open, at all and since the last block, is counted, so that an
    end tag is looked for only if it ends something; whatever is passed is closed.
    """

    def __init__(self):
        self.items: list[tuple[str, str]] = []
        self.floors: list[int] = []  # places of blocks
        self.names: Counter[str] = Counter()
        self.since: list[Counter[str]] = [Counter()]  # names after each block, the first for those before any
        self.boxes: list[tuple[int, int]] = [(-1, 0)]  # places and numbers of containers
        self.boxed = 0

    def state(self) -> str:
        return self.items[-1][1] if self.items else ""

    def push(self, name: str, inside: str) -> None:
        self.names[name] += 1
        if name in BLOCKS:
            self.floors.append(len(self.items))
            self.since.append(Counter())
            if name in CONTAINERS:
                self.boxed += 1
                self.boxes.append((len(self.items), self.boxed))
        else:
            self.since[-1][name] += 1
        self.items.append((name, inside))

    def cut(self, at: int) -> None:
        """Closes the elements from a place on."""
        while len(self.items) > at:
            name, _ = self.items.pop()
            self.names[name] -= 1
            if name in BLOCKS:
                self.floors.pop()
                self.since.pop()
                if self.boxes[-1][0] == len(self.items):
                    self.boxes.pop()
            else:
                self.since[-1][name] -= 1

    def find(self, name: str) -> int | None:
        """The place of the innermost element that an end tag ends: inline ones only since the last block."""
        counts = self.names if name in BLOCKS or name in SILENT else self.since[-1]
        return next(i for i in range(len(self.items) - 1, -1, -1) if self.items[i][0] == name) if counts[name] else None


def blocks(page: str) -> list[Block]:
    """Blocks with text, in page order. place: main, nested (an article in a container named otherwise), title, aside or ''."""
    out: list[Block] = []
    stack, held = Open(), []
    linked, links = 0, 0

    def close() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            state = stack.state()
            if text and state != "silent":
                out.append(Block(text, linked, "aside" if state == "shut" else state, any(n in HEADINGS for n, _ in stack.items[-3:]), stack.boxes[-1][1]))
            held.clear()
        linked = 0

    for text, name, attr, ends in tokens(page):
        if name is None:
            if stack.state() != "silent":
                text = html.unescape(text) if "&" in text else text
                held.append(text)
                linked += len(text) if links else 0
            continue
        block = name in BLOCKS
        if ends:
            at = stack.find(name)
            if name == "a":
                links = max(0, links - 1)
            if at is None:
                if block:
                    close()
                continue
            if block or stack.floors and stack.floors[-1] >= at:
                close()
            stack.cut(at)
            continue
        if name == "br":
            held.append(" ")
        if block:
            close()
            links = 0
            if stack.floors and name in CLOSED_BY.get(stack.items[stack.floors[-1]][0], ()):
                stack.cut(stack.floors[-1])
        if name in VOID:
            continue
        if name == "a":
            links += 1
        if attr.endswith("/") and not block and name not in _RAW_END:
            continue
        said, held_by = _hinted(name, attr), stack.state()
        if said == "title" and held_by not in ("main", "nested"):
            said = "aside"
        if held_by == "title" and name in HEADINGS:
            said = "main"
        if held_by == "silent" or not said or held_by in ("shut", "aside") and said not in ("silent", "shut", "main", "article"):
            inside = held_by
        elif said == "article":
            # a div that names itself one doesn't outweigh the container's name
            inside = "main" if held_by not in ("shut", "aside", "nested") else "nested" if held_by == "nested" or held_by == "aside" and name == "article" else held_by
        else:
            inside = said
        stack.push(name, inside)
    close()
    return out


def density(b: Block) -> bool | None:
    """What links, length and stop words say of a block; None where they don't decide."""
    if b.linked > LINK_DENSITY * len(b.text) or b.text[0] == "©":
        return False
    if len(b.text) >= SHORT:
        words = _WORD.findall(b.text.lower())
        stops = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
        if stops < FEW_STOPS and b.linked:
            return False
        if stops >= MANY_STOPS and len(b.text) >= LONG:
            return True
    return None


def judge(found: list[Block]) -> None:
    """The first pass: labels True, False, or None for undecided; the place main is left to declared parts that count."""
    declared = "main" if any(b.place == "main" for b in found) else "nested"
    good = {True: 0, False: 0}
    for b in found:
        b.label = False if b.place in ("aside", "title") else density(b)
        if b.label:
            good[b.place == declared] += len(b.text)
    for b in found:
        if b.place in ("main", "nested"):
            b.place = "main" if b.place == declared and good[True] >= good[False] else ""
            if b.place and b.heading and b.linked:
                b.label = None


def inherit(found: list[Block]) -> None:
    """The second pass: undecided blocks take over labels of the nearest decided blocks on their side of a declared part's border."""
    if any(b.place == "main" for b in found):
        pass_on(found, "main", True)
        pass_on(found, "", False)
        return
    if not any(b.label for b in found) and any(b.label is None for b in found):
        # nothing is surely good: the longest undecided text is the article's seed
        max((b for b in found if b.label is None), key=lambda b: len(b.text)).label = True
    pass_on(found, "", None)


def pass_on(found: list[Block], place: str, declared: bool | None) -> None:
    """Labels for the undecided blocks of a place; declared: what the page says of it."""
    n = len(found)
    before, after = [(None, n)] * n, [(None, n)] * n
    for step, near in ((1, before), (-1, after)):
        label, away = None, n
        for i in range(n)[::step]:
            if found[i].label is not None and found[i].place == place:
                label, away = found[i].label, 0
            near[i], away = (label, away), away + 1
    mates: dict[int, list[int]] = {}
    if declared is None:
        for i, b in enumerate(found):
            if b.label is not None and b.place == place:
                mates.setdefault(b.box, []).append(i)
    for i, b in enumerate(found):
        if b.label is not None or b.place != place:
            continue
        (up, up_far), (down, down_far) = before[i], after[i]
        own = mates.get(b.box)
        if own:
            # what stands in the same container says more than what is as near beyond it
            k = bisect(own, i)
            up, up_far = (found[own[k - 1]].label, i - own[k - 1]) if k else (found[own[k]].label, n)
            down, down_far = (found[own[k]].label, own[k] - i) if k < len(own) else (up, n)
        if b.heading:
            b.label = bool(declared if down is None else down)
        elif declared is not None:
            b.label = declared if up is None or up != down else up or declared and len(b.text) >= SHORT
        elif up is None or down is None or up == down:
            b.label = bool(down if up is None else up)
        elif own and len(b.text) >= SHORT:
            b.label = True
        else:
            b.label = up if up_far < down_far else down if down_far < up_far else not b.linked and b.text[-1] in ".!?…"


def extract(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    judge(found)
    inherit(found)
    return "\n".join(b.text for b in found if b.label)


def extract_text(df: DataFrame, *, html_col: str = "html", out_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (default: all but the page) and the main text."""
    carry = [c for c in (carry or df.columns) if c not in (html_col, out_col)]
    return map_batches(df, carry, [F.col(html_col)], lambda c: [pa.array([extract(p) for p in c[0].to_pylist()], pa.string())], {out_col: "string"})


def op8_html_extract(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages, carry=["page_id", "url"]).withColumn("n_chars", F.char_length("text").cast("long"))
