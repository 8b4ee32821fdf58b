"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element; scripts, styles, comments
and the head leave none.  Every line has a length: the characters of its text,
without link text, and 0 where the markup names furniture (navigation, page
header and footer, sidebar, notice, advert, form, reader comments, hidden
parts) or, on pages with an article or main element, outside of it.  Lengths
are summed over sliding windows of lines; a window that rises over the
threshold is a surge, one that falls to nothing a dive, and the text between
is kept (the longest stretch where none surges).  Inside an article element the
threshold is one character, so short articles and short last lines stay.

Defined results: a null, empty or text-free page gives an empty text; repeated
rows are extracted each; long pages are read whole; an empty table gives an
empty result; other columns pass unchanged, the result column replaces one of
its name.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WINDOW = 3
SURGE = 80

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
                    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_RAW = frozenset("script style textarea noscript template iframe select option object title annotation head".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                    "small span strike strong sub sup time tt u var wbr "
                    "math mi mo mn ms mtext mspace mrow mfrac msqrt mroot msup msub msubsup mover munder munderover mstyle semantics".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LEAF = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 td th tr option pre".split())    # closed by the next block
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# an opening tag of the key ends an open marked leaf of these tags
_ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
         "tr": {"td", "th", "tr", "p"}, "option": {"option"}}
_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 pre".split())      # with containers, what ends a paragraph
_HOMES = frozenset("html body div section main article td th fieldset center form aside nav header footer".split())
_FURNITURE = frozenset("nav footer aside form button dialog menu".split())
_WORD = re.compile(
    r"(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|"
    r"subscri\w*|signup|login|sidebar|side|widget|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|topbar|footer|comments?|"
    r"commentlist|respond|replies|disqus|share|sharing|social|related|recommend\w*|pagination|pager|tags?|copyright|skip|hidden)", re.I)
# words that only say where or in what form furniture stands
_BESIDE = re.compile(r"(?:site|page|top|bottom|left|right|global|primary|secondary|main|mobile|sticky|box|bar|list|area|section|block|"
                     r"links?|buttons?|icons?|item|slot|unit|form|sign|up|\d\w*)", re.I)
_PLACES = re.compile(r"header|masthead|topbar|top|title", re.I)     # no furniture on headings and inside articles
_OTHERS = re.compile(r"comments?|commentlist|respond|replies|disqus|related|recommend\w*|cookies?|consent|gdpr", re.I)
MOST = 0.75
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=\s|/|$)""", re.I)


def _names(value: str) -> list[str]:
    """Words of the class tokens that name furniture: all parts of such a token
    are furniture words or words beside them."""
    out = []
    for token in value.split():
        parts = [x for x in re.split(r"[_-]+", token) if x]
        found = [x for x in parts if _WORD.fullmatch(x)]
        if (found and all(x in found or _BESIDE.fullmatch(x) for x in parts)) or re.fullmatch(r"sign[_-]?up", token, re.I):
            out += found or [token]
    return out


def _lasting(attributes: str) -> bool:
    """Hidden, or other people's text: furniture whatever it holds."""
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id", "role") and any(map(_OTHERS.fullmatch, _names(value))):
            return True
    return False


def _is_furniture(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _FURNITURE or (tag == "header" and not in_article):
        return True
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            named = _names(value) if tag not in ("html", "body", "main", "h1") else []
            if tag == "article":                # a reader's comment can be an article
                named = [x for x in named if _OTHERS.fullmatch(x)]
            if tag in _HEADINGS or in_article:
                named = [x for x in named if not _PLACES.fullmatch(x)]
            if named:
                return True
            if value.lower() in ("complementary", "contentinfo", "search", "dialog"):
                return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def lines_of(html: str) -> list[tuple[str, int, bool, bool, int]]:
    """(text, link characters, furniture, inside article, container) per block line; text
    is decoded, its white space single.  A container that holds every article
    or main element or most of the text outside links is no furniture, unless
    it is hidden or other people's."""
    lines: list[tuple[str, int, bool, bool, tuple[int, ...], int]] = []
    # open containers, and leaves that are furniture: (tag, lasting furniture, number of other furniture)
    stack: list[tuple[str, bool, int | None]] = []
    homes: list[int] = [0]                      # open containers that can hold a text, numbered
    boxes: list[int] = []                       # articles in every other furniture
    within: list[int] = []                      # those that are open
    text: list[str] = []
    linked: list[str] = []
    state = {"link": 0, "article": 0, "furniture": 0, "articles": 0, "homes": 0}

    def flush():
        if text:
            line = " ".join(unescape("".join(text)).split())
            if line:
                inside = unescape("".join(linked))
                link = len(" ".join(inside.split()))
                if link and sum(map(str.isalnum, inside)) >= sum(map(str.isalnum, line)):
                    link = len(line)            # nothing but links and what stands between them
                lines.append((line, link, bool(state["furniture"]), state["article"] > 0, tuple(within), homes[-1]))
            text.clear()
            linked.clear()

    def add(part: str):
        if part:
            text.append(part)
            if state["link"]:
                linked.append(part)

    def close(at: int):
        for name, lasting, box in stack[at:]:
            state["furniture"] -= lasting
            if box is not None:
                within.remove(box)
            state["article"] -= name in ("article", "main")
            if name in _HOMES:
                homes.pop()
        del stack[at:]

    pos = 0
    while True:
        m = _TOKEN.search(html, pos)
        if m is None:
            add(html[pos:])
            break
        add(html[pos:m.start()])
        pos = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if not closing and tag in _RAW and not attributes.endswith("/"):
            if tag == "head":
                flush()
                end = re.compile(r"</head\s*>|<body\b", re.I).search(html, pos)
                # an unclosed head ends where the first body content starts
                pos = end.start() if end else pos
                continue
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, pos)
            pos = end.end() if end else (len(html) if tag in ("script", "style") else pos)
            continue
        if tag in _INLINE:
            if tag == "a":
                state["link"] = 0 if closing else 1
            elif not closing and tag not in _VOID and _ATTRIBUTE.search(attributes) and re.search(
                    r"(?:^|\s)hidden(?:\s|/|=|$)|display\s*:\s*none", attributes, re.I):
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, pos)
                pos = end.end() if end else pos
            continue
        flush()
        if tag in _VOID:
            continue
        if tag in _LEAF:
            state["link"] = 0
        if closing:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if at is not None and (tag not in _LEAF or not any(name not in _LEAF for name, _, _ in stack[at:])):
                close(at)
            continue
        # leaves end without a tag of their own where the next begins
        ends = _ENDS.get(tag, {"p"} if tag in _BLOCKS or tag not in _LEAF else set())
        while stack and stack[-1][0] in _LEAF and (stack[-1][0] in ends or (stack[-1][0] in _HEADINGS and tag in _HEADINGS)):
            close(len(stack) - 1)
        if not attributes.endswith("/"):
            furniture = _is_furniture(tag, attributes, state["article"] > 0)
            lasting = furniture and (_lasting(attributes) or tag in _LEAF)
            if tag in _LEAF and not furniture:
                continue
            stack.append((tag, lasting, len(boxes) if furniture and not lasting else None))
            state["furniture"] += lasting
            if tag in _HOMES:
                state["homes"] += 1
                homes.append(state["homes"])
            if furniture and not lasting:
                within.append(len(boxes))
                boxes.append(0)
            if tag in ("article", "main") and not state["article"] and not state["furniture"]:
                state["articles"] += 1
                for box in within:
                    boxes[box] += 1
            state["article"] += tag in ("article", "main")
    flush()
    sizes, total = [0] * len(boxes), 0
    for line, link, lasting, _, inside, _ in lines:
        if not lasting:
            total += len(line) - link
            for box in inside:
                sizes[box] += len(line) - link
    kept = [n == state["articles"] if state["articles"] else size > MOST * total for n, size in zip(boxes, sizes)]
    return [(line, link, lasting or not all(kept[box] for box in inside), article, home) for line, link, lasting, article, inside, home in lines]


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """Text between surge and dive of the page's line-block distribution.  Where
    no article is marked, lines (not of links) that stand in the same container as
    kept ones stay with them, however short: only furniture separates them."""
    lines = lines_of(html or "")
    if not lines:
        return ""
    has_article = any(article and not furniture for _, _, furniture, article, _ in lines)
    threshold = 1 if has_article else surge
    # furniture and what lies outside the article are gaps as wide as a window
    slots: list[int | None] = []                # line number, None in gaps
    lengths: list[int] = []
    for number, (text, link, furniture, article, _) in enumerate(lines):
        if furniture or (has_article and not article):
            slots += [None] * window
            lengths += [0] * window
        else:
            menu = not has_article and link >= len(text)
            slots.append(number)
            lengths.append(0 if menu else len(text) - (0 if has_article else link))
    padded = np.concatenate([lengths, np.zeros(window - 1, np.int64)])
    sums = np.convolve(padded, np.ones(window, np.int64), "valid")
    best, best_size, spans, at = (0, 0), 0, [], 0
    while at < len(lengths):
        if not lengths[at]:
            at += 1
            continue
        end = at                                # to the dive: a window without text
        while end < len(lengths) and sums[end]:
            end += 1
        size = int(sum(lengths[at:end]))
        if sums[at:end].max() >= threshold:
            spans.append((at, end))
        if size > best_size:
            best, best_size = (at, end), size
        at = max(end, at + 1)
    kept = {slots[i] for a, b in spans or [best] for i in range(a, b)} - {None}
    if not has_article:
        homes = {lines[n][4] for n in kept}
        kept |= {n for n, length in zip(slots, lengths) if length and lines[n][4] in homes}
    return " ".join(lines[n][0] for n in sorted(kept))


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with ``out_col`` (main text) in place of ``html_col``."""
    keep = [c for c in pages.columns if c not in (html_col, out_col)]
    picked = pages.select(*keep, pages[html_col].cast("string").alias("__html"))

    def run(batches):
        for b in batches:
            texts = pa.array([main_text(h) for h in b.column(b.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], names=[*b.schema.names[:-1], out_col])

    return picked.mapInArrow(run, T.StructType([*picked.schema.fields[:-1], T.StructField(out_col, T.StringType())]))
