"""Main text of web pages by scoring the element tree.

A forgiving parser turns a page into elements and blocks of text. Every paragraph gives points for its length and its
commas to the elements around it, the nearer the more; an element's points are discounted by its link density. The best
container is taken together with its siblings that score well or read like prose, and the blocks inside are put out in
page order. Parts that are never content (scripts, forms, menus) and parts whose tag, role, class or id says
navigation, advert, notice or comment are left out beforehand, those with such a class or id only if the page's prose is elsewhere.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.llm.common import text_slices

# Elements by their part in a page (HTML standard).
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset(
    "head script style template noscript nav footer header aside button select textarea input iframe object embed "
    "svg math canvas audio video dialog menu search title noembed noframes fieldset".split()
)
ENDS_P = BLOCKS - {"body", "html", "head", "legend", "option", "optgroup", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
# An open element of the first kind is closed by a start tag of the second, up to the given bounds.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
# Words in class, id or role that mark what is not the article, and those that mark what is.
BAD_WORDS = (
    "ads? adverts? advertisement advertorial sponsor(?:ed|s)? promo(?:tion)?s? banner nav navbar navigation menu breadcrumbs? "
    "sidebar side aside rail header masthead footer foot comments? commentlist disqus repl(?:y|ies) respond cookies? consent gdpr "
    "notice notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations widget toolbar pager pagination tags skip print search form legal disclaimer copyright "
    "outbrain taboola"
)
# Places that a marking word may come after, as in "site-header"; "has-sidebar" marks nothing.
PLACES = "site page global main top bottom left right user reader article post blog primary secondary js cookie privacy"
# What may follow a marking word, as in "sidebar-left"; "related-work" and "side-by-side" mark nothing.
PARTS = (
    "area bar block body box buttons? container content footer form header icons? inner item items left links? list main "
    "message modal nav outer panel popup posts? right row section slot top bottom unit widgets? wrap wrapper text title"
)


def _marks(words: str, places: str) -> re.Pattern:
    """A whole class or id of one of the words, perhaps after a place and before parts."""
    words, places, parts = (w.replace(" ", "|") for w in (words, places, PARTS))
    return re.compile(rf"(?:^|(?<=\s))(?:(?:{places})[_-])?(?:{words})(?:[_-]*(?:{words}|{parts}|[0-9]+)(?![^\s_0-9-]))*+(?=$|\s)", re.IGNORECASE)


BAD_NAME = _marks(BAD_WORDS, PLACES)
# Articles and main parts go only if they are called one of these.
BAD_ARTICLE = _marks("ads? adverts? comments? repl(?:y|ies) promo related sponsored teaser", "user reader")
HEADING = re.compile(r"h[1-6]$")
GOOD_NAME = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text|page|hentry|column)(?:$|[\s_\d-])", re.IGNORECASE)
BAD_ROLE = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
)

TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|--!>|\Z)|<[!?](?P<declared>[^>]*)(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"(?P<name>[^\s=/>\"']+)(?:\s*=\s*(?:\"(?P<a>[^\"]*)\"|'(?P<b>[^']*)'|(?P<c>[^\s>]+)))?")
CONTENT_NAMES = ("class", "id", "role", "hidden", "aria-hidden", "style", "itemprop")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Element:
    __slots__ = ("tag", "names", "up", "skip", "points", "letters", "linked", "down", "index", "number", "marked", "block")

    def __init__(self, tag: str, up: Element | None, names: str = "", skip: bool = False):
        self.tag, self.up, self.names = tag, up, names
        self.skip = skip or (up.skip if up else False)
        self.points = 0.0
        self.letters = self.linked = 0
        self.down: list[Element] = []
        self.index = len(up.down) if up else 0
        self.number, self.marked = 0, ""
        # The innermost block that it is or stands in.
        self.block: Element = up.block if up and tag not in BLOCKS else self
        if up:
            up.down.append(self)


class Text:
    """A block of text and the element it stands in."""

    __slots__ = ("element", "text", "linked")

    def __init__(self, element: Element, text: str, linked: int):
        self.element, self.text, self.linked = element, text, linked


def _attributes(raw: str) -> dict[str, str]:
    out = {}
    for m in ATTRIBUTE.finditer(raw):
        name = m["name"].lower()
        if name in CONTENT_NAMES and name not in out:
            out[name] = unescape(m["a"] or m["b"] or m["c"] or "")
    return out


def _left_out(tag: str, attrs: dict[str, str], inside_article: bool) -> bool:
    """Whether a part is never content, whatever it is called."""
    if tag in ("article", "main"):
        return False
    if tag == "header" and inside_article:
        return False  # an article's own heading
    if tag in NEVER:
        return True
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or HIDDEN_STYLE.search(attrs.get("style", "")):
        return True
    return attrs.get("role", "").lower() in BAD_ROLE


def _marked(tag: str, attrs: dict[str, str], inside_article: bool) -> str:
    """"class" or "id" if that says that a part is no content."""
    if HEADING.match(tag) or tag == "header" and inside_article or attrs.get("itemprop", "") == "articleBody":
        return ""
    bad = BAD_ARTICLE if tag in ("article", "main") else BAD_NAME
    return next((k for k in ("class", "id") if bad.search(attrs.get(k, ""))), "")


def _slug(text: str) -> str:
    return "-".join(re.findall(r"\w+", text.lower()))


def _to_drop(root: Element, blocks: list[Text]) -> frozenset[int]:
    """Numbers of the marked elements to leave out, in one pass down and one up.

    One stays that holds most of the page's prose, unless an article or main part outside it has some, and a section whose
    id is the slug of its heading. A form stays only where it wraps the page: with most of the prose, a heading or article
    inside, and no prose in an article outside.
    """
    elements = _in_page_order(root)
    if not any(e.marked for e in elements):
        return frozenset()
    count = max((e.number for e in elements), default=0) + 1
    prose = [0] * count  # letters outside links, by element
    apart = [0] * count  # those of them in an article or main part inside the element, or that it is
    heading: list[int | None] = [None] * count  # the first block that is a heading
    inner = [False] * count  # inside an article or main part
    parts = [False] * count  # holds an article or main part
    for k, b in enumerate(blocks):
        prose[b.element.number] += len(b.text) - b.linked
        if heading[b.element.number] is None and HEADING.match(b.element.tag):
            heading[b.element.number] = k
    for e in elements[1:]:
        inner[e.number] = inner[e.up.number] or e.up.tag in ("article", "main") and not e.up.marked
    for e in reversed(elements):
        i = e.number
        if e.tag in ("article", "main") and not e.marked:
            apart[i], parts[i] = prose[i], True
        if e.up is not None:
            up = e.up.number
            prose[up] += prose[i]
            apart[up] += apart[i]
            parts[up] = parts[up] or parts[i]
            if heading[i] is not None and (heading[up] is None or heading[i] < heading[up]):
                heading[up] = heading[i]
    total, articles = prose[root.number], apart[root.number]
    out = set()
    for e in elements:
        if not e.marked:
            continue
        i = e.number
        most = prose[i] * 2 > total
        # Inside an article only another one is elsewhere.
        elsewhere = articles > prose[i] * 2 if inner[i] else articles > apart[i]
        title = blocks[heading[i]].text if heading[i] is not None else ""
        own = e.marked == "id" and e.tag in ("section", "div") and _slug(title) in e.names.lower().split()
        stays = most and not elsewhere or own and (e.tag == "section" or "section" in e.names.split())
        if e.marked == "form":
            stays = most and not elsewhere and not inner[i] and (parts[i] or heading[i] is not None)
        if not stays:
            out.add(i)
    return frozenset(out)


def parse(html: str, drop: frozenset[int] = frozenset()) -> tuple[Element, list[Text]]:
    """The element tree and its blocks of text in page order; text of parts to leave out is not kept.

    ``drop`` has the numbers, by start tag, of further elements to leave out.
    """
    root = Element("html", None)
    at = root
    blocks: list[Text] = []
    pieces: list[str] = []
    linked = 0
    in_link = 0
    articles = 0
    number = 0
    block = root
    opened: Counter[str] = Counter()  # open elements by tag, so that a tag that closes none of them looks for none

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                blocks.append(Text(block, text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def leave(until: Element) -> None:
        """Close everything up to and with ``until``."""
        nonlocal at, block, in_link, articles
        while True:
            done, at = at, at.up
            opened[done.tag] -= 1
            if done.tag == "a":
                in_link = max(0, in_link - 1)
            elif done.tag == "article":
                articles -= 1
            if done.tag in BLOCKS:
                flush()
            if done is until:
                break
        block = at.block

    pos, n = 0, len(html)
    while pos < n:
        lt = html.find("<", pos)
        m = TOKEN.match(html, lt) if lt >= 0 else None
        stop = lt if m else (n if lt < 0 else lt + 1)
        if stop > pos:
            if not at.skip:
                pieces.append(html[pos:stop])
                if in_link:
                    linked += stop - pos
            pos = stop
            if not m:
                continue
        pos = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"]:
            if tag == "br":
                pieces.append(" ")
                continue
            if not opened[tag]:
                continue
            e = at
            bound = {"table", "td", "th"} if tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "body", "html") else set()
            while e.up is not None and e.tag != tag and e.tag not in bound:
                if tag not in BLOCKS and e.tag in BLOCKS:
                    break  # an inline end tag does not close blocks
                e = e.up
            if e.up is not None and e.tag == tag:
                leave(e)
            continue
        if tag == "br" or tag == "wbr":
            if not at.skip and tag == "br":
                pieces.append(" ")
            continue
        attrs = _attributes(m["attrs"]) if m["attrs"] else {}
        if tag in ("html", "body"):
            flush()
            continue
        if tag in ENDS_P and opened["p"]:
            e = at
            while e.up is not None and e.tag not in ("p", "table", "td", "th", "button", "object"):
                e = e.up
            if e.tag == "p":
                leave(e)
        if tag in IMPLIED:
            closes, bounds = IMPLIED[tag]
            e, last = at, None
            while any(opened[c] for c in closes) and e.up is not None and e.tag not in bounds:
                if e.tag in closes:
                    last = e
                e = e.up
            if last is not None:
                leave(last)
        if tag in BLOCKS:
            flush()
        names = f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('itemprop', '')}"
        number += 1
        skip = at.skip or number in drop or _left_out(tag, attrs, articles > 0)
        if skip and not at.skip and tag not in BLOCKS and tag not in RAW:
            pieces.append(" ")
        if tag in VOID or (m["attrs"] or "").rstrip().endswith("/") and tag in ("svg", "path", "use"):
            if tag == "hr":
                block = at.block
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.IGNORECASE).search(html, pos)
            if end is None:
                pos = n
            else:
                gt = html.find(">", end.end())
                pos = n if gt < 0 else gt + 1
            continue
        at = Element(tag, at, names, skip)
        at.number = number
        opened[tag] += 1
        if not skip:
            at.marked = "form" if tag == "form" else _marked(tag, attrs, articles > 0) if attrs else ""
        if tag == "a":
            in_link += 1
        elif tag == "article":
            articles += 1
        if tag in BLOCKS:
            block = at
    flush()
    return root, blocks


def _in_page_order(root: Element) -> list[Element]:
    """All elements, parents before what they hold."""
    out, waiting = [], [root]
    while waiting:
        e = waiting.pop()
        out.append(e)
        waiting += reversed(e.down)
    return out


def _score(elements: list[Element], blocks: list[Text]) -> list[Element]:
    """Points to the ancestors of every block: whole to the parent, half to the next, a third of that to further ones."""
    touched: dict[int, Element] = {}
    for b in blocks:
        b.element.letters += len(b.text)
        b.element.linked += b.linked
    # Every element passes what it holds to its parent, the innermost first.
    for e in reversed(elements):
        if e.up is not None:
            e.up.letters += e.letters
            e.up.linked += e.linked
    for b in blocks:
        points = 1 + b.text.count(",") + min(len(b.text) // 100, 3)
        if re.match(r"h[1-6]$", b.element.tag):
            points = 1
        # A paragraph scores its parent; loose text scores the container it stands in.
        e = b.element.up if b.element.tag in ("p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dd", "dt", "td") else b.element
        level = 0
        while e is not None and level < 6:
            if id(e) not in touched:
                touched[id(e)] = e
                e.points += _prior(e)
            e.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            e = e.up
            level += 1
    return list(touched.values())


def _prior(e: Element) -> float:
    out = {"article": 25.0, "main": 20.0, "section": 3.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0}.get(e.tag, 0.0)
    if e.tag in ("ul", "ol", "dl", "li", "dd", "dt", "address"):
        out -= 3.0
    if GOOD_NAME.search(e.names):
        out += 25.0
    return out


def link_density(e: Element) -> float:
    return e.linked / e.letters if e.letters else 0.0


def _first_with_text(html: str, *drops: frozenset[int]) -> tuple[Element, list[Text]]:
    for drop in drops:
        root, blocks = parse(html, drop)
        if blocks:
            break
    return root, blocks


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in page order, one per line; empty if there is none."""
    if not html:
        return ""
    root, blocks = parse(html)
    drop = _to_drop(root, blocks)
    if drop:
        # Without the marked parts, if anything is left; forms go in any case.
        root, blocks = _first_with_text(html, drop, frozenset(e.number for e in _in_page_order(root) if e.marked == "form") & drop)
    if not blocks:
        return ""
    elements = _in_page_order(root)
    scored = _score(elements, blocks)
    final = {id(e): e.points * (1 - link_density(e)) for e in scored}
    best = max(scored, key=lambda e: final[id(e)])  # of equal ones the first in the page
    # Several articles or sections of like standing below one parent are read together.
    kept = {id(best)}
    limit = max(10.0, final[id(best)] * 0.2)
    if best.up is not None:
        for s in best.up.down:
            if s is best or s.skip:
                continue
            bonus = final[id(best)] * 0.2 if s.names.strip() and s.names == best.names else 0.0
            density = link_density(s)
            prose = s.tag in ("p", "pre", "blockquote") and (s.letters > 80 and density < 0.25 or 0 < s.letters <= 80 and density == 0)
            heading = re.match(r"h[1-6]$", s.tag) and density < 0.25 and s.index < best.index
            if final.get(id(s), 0.0) + bonus >= limit or prose or heading:
                kept.add(id(s))
    # So are those that stand in wrappers of their own, if these are alike and hold an element of like standing.
    wrapper = best
    while wrapper.up is not None and wrapper.up.up is not None and wrapper.up.letters == wrapper.letters:
        wrapper = wrapper.up
    if wrapper is not best and wrapper.up is not None:
        strongest: dict[int, float] = {}
        for e in reversed(elements):
            own = max(strongest.get(id(e), 0.0), final.get(id(e), 0.0))
            if e.up is not None:
                strongest[id(e.up)] = max(strongest.get(id(e.up), 0.0), own)
            strongest[id(e)] = own
        for s in wrapper.up.down:
            if s is not wrapper and not s.skip and s.tag == wrapper.tag and s.names == wrapper.names and strongest[id(s)] >= limit and link_density(s) < 0.25:
                kept.add(id(s))
    for e in elements:
        if e.up is not None and id(e.up) in kept:
            kept.add(id(e))
    # Text that stands loose in the parent belongs to it when the parent is the best itself.
    return "\n".join(b.text for b in blocks if id(b.element) in kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Every whole page is read. A null or empty page, and one without text, has an empty text. Character references are
    decoded, white space within a block becomes one space, and blocks are joined by a line feed. Rows that repeat a
    page_id, or have none, each keep their row; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "html"):
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
