"""Main text of web pages by line-block distribution.

A page is read into blocks (the texts between block-level tags) with the length of their text outside links.  Elements that
are no article by what they are (menus, headers, footers, sidebars, forms, scripts, styles), and containers whose class or id
says so beyond doubt (adverts, notices, reader comments), are left out; doubtful names only weigh a block's length down.  The
lengths are summed over a sliding window; where the sums surge a stretch of text begins, where they dive it ends.

Surge and dive are found to the block, while an article's first and last lines and its lists may be short.  So two stretches
with nothing but short text between them are one, and a stretch runs on to the ends of the container that it began in, or of
the element that the page marks as its article if that holds most of the text found.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import rows_of, utf8

#: Blocks in a window, and the window's characters at which text begins.
WINDOW, SURGE = 3, 86

# Attribute values may hold ">" inside quotes; a quote that never ends counts as an ordinary character.
_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Element and attribute names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript template iframe noframes xmp".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset("article aside blockquote body details div dl fieldset figure footer form header main menu nav ol section table td th ul".split())
_DROPPED = frozenset("nav footer aside head button select datalist dialog menu svg canvas object audio video map".split())
#: Ruled out inside an article and where they hold less than half of the page's text, but never around an article.
_FORMS = frozenset(("form", "fieldset"))
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status tablist".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that hold a run of blocks; a list or a table belongs to the one around it.
_CONTAINERS = frozenset("article body div main section td th".split())
# Words in class and id names.  These mark what is no article text if the rest of the name says what kind or
# part of a box it is ("comments-area", not "comments-on-the-law"),
_SURE = frozenset(
    "adsense adslot adunit advert adverts advertisement advertising advertorial breadcrumb breadcrumbs colophon comment commentlist comments "
    "consent cookie cookies disqus gdpr lightbox masthead menubar navbar newsletter pagination paywall sidebar sidebars skiplink sponsor sponsored sponsors submenu topbar".split()
)
# these if the rest of the name says the kind of box alone,
_ALONE = frozenset(
    "ad ads alert aside copyright crumbs footer footnav hidden login menu modal nav navi navigation notice notices notification notifications overlay pager paging popup "
    "promo promoted promotion rail recirculation recommendations recommended related replies search searchbox share shares sharing signin signup skip social subscribe "
    "teaser teasers toolbar widget widgets".split()
)
# and these are in doubt: they weigh a block's text down outside of what is marked as the article.
_DOUBTFUL = frozenset("bottom discussion disclaimer follow form header legal popular print privacy reactions register reply respond reviews subscription toc trending".split())
_KINDS = frozenset(
    "area banner bar block box boxes button buttons col column container content desktop fixed global group inner item items left link links list main mobile outer page panel "
    "primary right row secondary section site slot sticky top unit wrap wrapper".split()
)
_PARTS = frozenset(
    "accept actions author avatar body card close count dialog feed footer form heading info js label meta message more no policy post posts prompt reader readers section show template text thread title toggle user".split()
)
#: What a character counts in a block that a doubtful name stands on.
DOUBT = 0.25
_ARTICLE_NAMES = frozenset("article post entry story articlebody postbody entrycontent content main".split())
#: Names that, whole, say article whatever stands beside them ("post promoted"), but for the readers' own posts.
_OWN_NAMES = _ARTICLE_NAMES - {"content", "main"}
_READERS = frozenset("comment commentlist comments disqus reply replies".split())


class _Element:
    __slots__ = ("name", "drop", "keep", "start", "end", "parent", "out", "above", "wide", "doubt", "box", "holds")

    def __init__(self, name: str, parent: _Element | None, start: int):
        self.name, self.parent, self.start, self.end = name, parent, start, None
        self.drop, self.keep, self.out = 0, 0, False
        self.above = self.wide = 0
        self.holds = False  # whether an element that may be the article lies in it
        self.doubt = parent is not None and parent.doubt  # whether a doubtful name stands on it or around it
        self.box = self if parent is None or name in _CONTAINERS else parent.box


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        out.setdefault((m[1] or m[5]).lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def _whole(token: str) -> str:
    return re.sub(r"[^a-z]", "", token.lower())


def _verdict(value: str) -> int:
    """What class and id names say: 2 no article, 1 doubtful, 0 nothing."""
    said = 0
    whole = {_whole(t) for t in value.split()}
    article = whole & _OWN_NAMES and not whole & _READERS
    for token in value.split():
        words = {w.lower() for w in _NAMES.findall(token) if not w.isdigit()}
        rest = words - _KINDS
        sure = _whole(token) in _SURE or words & _SURE and rest <= _SURE | _ALONE | _DOUBTFUL | _PARTS | _ARTICLE_NAMES
        if (sure or rest and rest <= _ALONE) and not article:
            return 2
        if words & _SURE or rest and rest <= _ALONE | _DOUBTFUL:
            said = 1
    return 0 if article else said


def _names(value: str) -> set[str]:
    return {w.lower() for w in _NAMES.findall(value)} | {re.sub(r"[^a-z]", "", w.lower()) for w in value.split()}


def _judge(e: _Element, attrs: str, inside_article: bool) -> None:
    """drop: 1 by what names say, 2 by what the element is; keep: 3 article, 2 main part, 1 by what names say."""
    if e.name in _DROPPED or e.name == "header" and not inside_article:
        e.drop = 2
    if e.name == "article":
        e.keep = 3
    elif e.name == "main":
        e.keep = 2
    if attrs.strip(" /\n\t"):
        a = _attributes(attrs)
        role = a.get("role", "").lower()
        if role in _DROPPED_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
            e.drop = 2
        if role in ("article", "main") or a.get("itemprop", "").lower() == "articlebody":
            e.keep = max(e.keep, 3 if role != "main" else 2)
        if ("class" in a or "id" in a) and e.name not in ("html", "body", "main") and e.name not in _HEADINGS:
            names = a.get("class", "") + " " + a.get("id", "")
            said = _verdict(names)
            if said == 2:
                e.drop = max(e.drop, 1)
            elif said == 1:
                e.doubt = e.doubt or e.name in _SCOPES
            elif e.name in ("div", "section", "td") and _names(names) & _ARTICLE_NAMES:
                e.keep = max(e.keep, 1)
    if e.keep >= 2 or inside_article:
        e.doubt = False


@dataclass(frozen=True)
class Block:
    """A text with its characters outside links, weighed; the container it lies in; whether something was left out, or
    links stand, between it and the block before; whether it is a heading."""

    text: str
    length: float
    box: _Element
    cut: bool
    heading: bool = False


def read_blocks(html: str) -> tuple[list[Block], list[_Element]]:
    """The page's blocks without those that their elements rule out, and the elements that may hold the article; an
    element's start and end number the blocks."""
    blocks: list[tuple[str, int, _Element]] = []
    parts: list[str] = []
    linked = keeps = 0  # characters inside links of this block; open holders
    opens: Counter = Counter()  # open elements by name, so that no search looks for what is not there
    root = _Element("", None, 0)
    stack, marked, made = [root], [], []

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                blocks.append((text, max(0, len(text) - linked), stack[-1]))
            parts.clear()
        linked = 0

    def pop_to(at: int) -> None:
        nonlocal keeps
        while len(stack) > at:
            e = stack.pop()
            e.end = len(blocks)
            opens[e.name] -= 1
            keeps -= e.keep > 0

    def find(names, stop) -> int:
        if not any(opens[x] for x in names):
            return 0
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].name in names:
                return at
            if stack[at].name in stop:
                break
        return 0

    def add_text(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if opens["a"]:
                linked += len(text.strip())

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            add_text(html[at:])
            break
        add_text(html[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["close"]:
            if name not in _INLINE:
                close_block()
            k = find((name,), _SCOPES if name not in _SCOPES else ())
            if k:
                if any(e.name not in _INLINE for e in stack[k:]) or stack[k].drop:
                    close_block()
                pop_to(k)
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if name not in _INLINE:
            close_block()
        if name in _VOID:
            continue
        if name in _ENDS_P and (k := find(("p",), _SCOPES)):
            pop_to(k)
        elif name in _SAME and (k := find(_SAME[name], _SCOPES - {"td", "th"})):
            pop_to(k)
        e = _Element(name, stack[-1], len(blocks))
        if name == "body":
            k = find(("head",), ())
            if k:
                pop_to(k)
                e.parent = stack[-1]
        _judge(e, m["attrs"], keeps > 0)
        if e.drop and name in _INLINE:
            close_block()
            e.start = len(blocks)
        if m["attrs"].endswith("/") and name not in _ENDS_P:
            continue
        stack.append(e)
        made.append(e)
        opens[name] += 1
        keeps += e.keep > 0
        if e.drop or e.keep:
            marked.append(e)
    close_block()
    pop_to(0)
    chars = [0]
    for text, _, _ in blocks:
        chars.append(chars[-1] + len(text))
    # A name may stand on a wrapper of the whole page ("with-sidebar").  If every article or main part lies in elements
    # that names rule out, those around the longest one are no ruling; without such a part, those around most of the text.
    size = lambda e: chars[e.end] - chars[e.start]
    for e in marked:
        up = e.parent if e.keep and not e.drop else None
        while up is not None and not up.holds:
            up.holds, up = True, up.parent
    within: set[_Element] = set()  # elements inside an article, parents first
    for e in made:
        if e.parent.keep or e.parent in within:
            within.add(e)
        if e.name in _FORMS and not e.drop and not e.holds and (e in within or 2 * size(e) < chars[-1]):
            e.drop = 2
    for e in made:  # the strongest ruling above each element, and the size of the largest one that is ruled out
        up = e.parent
        e.above, e.wide = max(up.above, up.drop), max(up.wide, size(up) if up.drop else 0)
    inside = [x for x in marked if x.keep and not x.drop and x.above <= 1]
    marks = [x for x in inside if x.keep >= 2] or [x for x in inside if 2 * x.wide > chars[-1]]
    if marks and all(x.above for x in marks):
        y = max(marks, key=size)
        while y is not None:
            y.drop, y = 0, y.parent
    for e in made:  # parents come before what they hold
        e.out = e.drop > 0 or e.parent.out

    kept, number, cut = [], [0], True
    for text, outside, e in blocks:
        if e.out:
            cut = True
        else:
            linked = 3 * outside < len(text)  # mostly links: no text
            kept.append(Block(text, 0 if linked else outside * (DOUBT if e.doubt else 1), e.box, cut or linked, e.name in _HEADINGS))
            cut = linked
        number.append(len(kept))
    holders = []
    for e in marked:
        if e.keep and not e.out:
            e.start, e.end = number[e.start], number[e.end]
            if e.start < e.end:
                holders.append(e)
    return kept, holders


def text_stretches(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Stretches (start, end) between a surge of the windows' sums and their dive.

    A window's sum surges at ``surge`` characters, or at half of the page's largest sum if that is less; a stretch ends
    at the last block of its last such window.  Blocks without text outside links are cut off at both ends.
    """
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    least = min(surge, max(sums, default=0) / 2)
    out: list[tuple[int, int]] = []
    i = 0
    while i < len(sums):
        if sums[i] >= least and sums[i] > 0:
            j = i
            while j + 1 < len(sums) and sums[j + 1] >= least and sums[j + 1] > 0:
                j += 1
            start, end = i, min(len(lengths), j + window)
            # Short blocks that only share a window with the first long one stand before the surge.
            while start < end and not lengths[start]:
                start += 1
            while end > start and not lengths[end - 1]:
                end -= 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], max(end, out[-1][1]))
            elif start < end:
                out.append((start, end))
            i = j + 1
        else:
            i += 1
    return out


def run_on(blocks: list[Block], stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches, joined where nothing but text stands between two, and continued to the ends of their containers.

    A stretch ends where something was left out, at blocks of links and, but between two stretches, at doubtful blocks and
    at another container.  A page's body is no container to run to the ends of.
    """

    def follows(i: int, inside: _Element) -> bool:
        """Whether block i goes on from the one before it, in the same container."""
        return not blocks[i].cut and blocks[i].box is inside and inside.name not in ("", "body") and not inside.doubt

    out: list[tuple[int, int]] = []
    for start, end in stretches:
        floor = out[-1][1] if out else 0
        while start > floor and blocks[start - 1].box is blocks[start].box and follows(start, blocks[start].box) and blocks[start - 1].length:
            start -= 1
        while end < len(blocks) and follows(end, blocks[end - 1].box) and blocks[end].length:
            end += 1
        if out and (start <= out[-1][1] or not any(b.cut for b in blocks[out[-1][1] : start + 1]) and not any(b.box.doubt for b in blocks[out[-1][1] : start])):
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def led_in(blocks: list[Block], stretches: list[tuple[int, int]], surge: int = SURGE) -> list[tuple[int, int]]:
    """The stretches from where their text surges: short text before it, in another container than most of the stretch and
    before its heading, only shares a window with the first long block."""
    out = []
    for start, end in stretches:
        held: dict[_Element, float] = {}
        for b in blocks[start:end]:
            held[b.box] = held.get(b.box, 0) + b.length
        most = max(held, key=held.get, default=None)
        at, short = start, 0.0
        while at < end and blocks[at].box is not most and not blocks[at].heading:
            short += blocks[at].length
            at += 1
        out.append((at if short < surge and at < end else start, end))
    return out


def _meets(h: _Element, stretches: list[tuple[int, int]]) -> bool:
    """Whether a stretch reaches into the element; stretches are in order and apart."""
    k = bisect_right(stretches, (h.start, len(stretches) and stretches[-1][1])) - 1
    return any(s < h.end and h.start < e for s, e in stretches[max(0, k) : k + 2])


def main_blocks(html: str, window: int = WINDOW, surge: int = SURGE) -> list[str]:
    blocks, holders = read_blocks(html)
    lengths = [b.length for b in blocks]
    stretches = led_in(blocks, run_on(blocks, text_stretches(lengths, window, surge)), surge)
    if not stretches:
        stretches = [(0, len(blocks))] if blocks and holders else []
    sums = [0.0]
    for n in lengths:
        sums.append(sums[-1] + n)
    text_in = lambda s, e: sums[e] - sums[s]
    total = sum(text_in(s, e) for s, e in stretches)
    for rank in (3, 2, 1):
        own = [h for h in holders if h.keep == rank and _meets(h, stretches)]
        # The outermost ones; of main parts, in place of each the innermost one inside it that holds all of its text.
        outer: list[_Element] = []
        picked: list[_Element] = []
        for h in sorted(own, key=lambda h: (h.start, -h.end)):
            if not outer or h.start >= outer[-1].end:
                outer.append(h)
                picked.append(h)
            elif rank < 3 and h.end - h.start < picked[-1].end - picked[-1].start and text_in(h.start, h.end) == text_in(outer[-1].start, outer[-1].end):
                picked[-1] = h
        own = picked
        if own and 2 * sum(text_in(s, e) for s, e in {(h.start, h.end) for h in own}) > total:
            stretches = sorted({(h.start, h.end) for h in own})
            break
    return [b.text for s, e in stretches for b in blocks[s:e]]


def main_text(html: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main blocks joined by one space; empty for an empty page."""
    return " ".join(main_blocks(html, window, surge))


def extract_main_text(pages: DataFrame, window: int = WINDOW, surge: int = SURGE, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` in place of the html, one row per row; a narrow pass without a shuffle.

    Pages of any length are read whole, in one pass over their tags.  A null or empty html, and one without text, gives an
    empty text; repeated rows and null ids are kept; columns named ``text`` or ``n_chars`` are replaced; an empty table
    gives no rows.
    """
    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    source = pages.select(*rest, utf8(html_col))
    schema = pages.select(*rest).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 256):
            texts = [main_text(h.decode("utf-8", "replace"), window, surge) for h in batch.column(len(rest)).to_pylist()]
            columns = [*(batch.column(i) for i in range(len(rest))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*rest, "text", "n_chars"])

    return source.mapInArrow(run, schema)
