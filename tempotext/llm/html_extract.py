"""Main text of web pages by two passes of block rules."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Frequent function words of the four languages.
STOP_WORDS = frozenset(
    "the of and to a in is it that was for on are with as be at this have from or by not but they his her you we an which one all were when there can more if "
    "de la le et les des en un une du que qui dans est pour pas sur au par il elle ce se ne avec plus son sa ou mais nous vous ont aux "
    "der die das und in den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum "
    "el los las y del se por con una para su al lo como más o pero sus le ya este sí porque esta entre cuando muy sin sobre me hasta hay donde".split()
)
#: Elements that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav "
    "noscript object ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul button label caption svg math canvas video audio map".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template".split())
#: Elements whose text is never the article's.
APART = frozenset("nav footer aside form menu dialog button select option optgroup label fieldset noscript object canvas svg math video audio head map".split())
#: Words of class, id and role that say the same, but for headers within an article.
APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion sidebar rail nav navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice "
    "notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus respond reply replies related recommended recommendations pagination pager "
    "widget widgets toolbar copyright legal disclaimer skip search complementary contentinfo outbrain taboola".split()
)
APART_ROOTS = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related".split())
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*)(?P<rest>(?:[^<>"']++|"[^"]*"|'[^']*'|["'])*+)>""", re.S)
ATTR = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")
RAW_END = {x: re.compile(rf"</{x}\b[^>]*>", re.I) for x in RAW}
#: Class names that begin or go on so speak of other places ("no-sidebar", "page-with-comments").
MODIFIERS = frozenset("no not non without with has have is hide hidden show enable enabled disable disabled".split())
#: Elements a head may hold; any other one, or text, ends it.
HEAD = frozenset("head title base link meta script style noscript template".split())
#: Elements whose begin tag ends an open one of the second group, unless one of the third group is in between.
ENDS = {
    **dict.fromkeys(("li",), (("li",), ("ul", "ol", "menu"))), **dict.fromkeys(("dt", "dd"), (("dt", "dd"), ("dl",))), **dict.fromkeys(("td", "th"), (("td", "th"), ("tr", "table"))),
    "tr": (("tr",), ("table",)), **dict.fromkeys(("thead", "tbody", "tfoot"), (("thead", "tbody", "tfoot"), ("table",))), **dict.fromkeys(("option", "optgroup"), (("option",), ("select",))),
}
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
LETTERS = re.compile(r"[^\W\d_]+")

#: Pass 1: characters from which a block is decided by its words, shares of stop words and of linked characters.
LONG, STOP_HIGH, STOP_LOW, LINKED, LINKED_ROOT = 70, 0.2, 0.05, 0.33, 0.6
#: Share of stop words among a page's words from which its language is one of the list's.
KNOWN = 0.08


def hints(value: str) -> set[str]:
    """Words of a class, id or role, without those after a modifier."""
    out: set[str] = set()
    for name in value.split():
        for x in NAME_PART.findall(name):
            if x.lower() in MODIFIERS:
                break
            out.add(x.lower())
    return out


def apart(name: str, rest: str, in_root: bool) -> tuple[bool, bool]:
    """Whether an element's text is surely not the article's, by its kind or as it is hidden, and whether its names say so."""
    if name in APART or (name == "header" and not in_root):
        return True, False
    if "=" not in rest and "hidden" not in rest:
        return False, False
    words: set[str] = set()
    for key, a, b, c in ATTR.findall(rest):
        key, value = key.lower(), a or b or c
        if key == "hidden" and value.lower() != "until-found" or key == "aria-hidden" and value.lower() == "true":
            return True, False
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False
        if key in ("class", "id", "role"):
            words |= hints(value)
    if name in ("html", "body", "article", "main"):
        return False, bool(words & APART_ROOTS) and name not in ("html", "body")
    return False, bool(words & APART_WORDS) or not in_root and "header" in words


class Block(NamedTuple):
    """A stretch of text between block elements: share of linked characters, surely apart, elements above it whose names
    say apart, its article or main element (0: none), heading."""

    text: str
    linked: float
    bad: bool
    named: int
    root: int
    heading: bool


def blocks(page: str) -> tuple[list[Block], list[int], set[int]]:
    """Blocks in page order, the elements named apart by number, each with the one around it (0: none), and those that hold an article or main element all the same."""
    out, parts = [], []  # parts: (text, linked)
    stack: list[tuple[str, bool, int, int]] = []
    open_: Counter[str] = Counter()  # names on the stack
    bad, named, root, roots, linked, heading = False, 0, 0, 0, False, False
    above, wrappers = [0], set()

    def close() -> None:
        nonlocal parts
        if parts:
            text = " ".join("".join(x for x, _ in parts).split())
            if text:
                size = sum(len(x) for x, _ in parts if not x.isspace()) or 1
                out.append(Block(text, sum(len(x) for x, y in parts if y) / size, bad, named, root, heading))
            parts = []

    def pop(k: int) -> None:
        nonlocal bad, named, root
        close()
        bad, named, root = stack[k][1:]
        for x in stack[k:]:
            open_[x[0]] -= 1
        del stack[k:]

    def end(which: tuple[str, ...], stop: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in which:
                pop(k)
                return
            if stack[k][0] in stop:
                return

    def text(x: str) -> None:
        if x:
            if stack and stack[-1][0] == "head" and not x.isspace():
                pop(len(stack) - 1)
            parts.append((html.unescape(x) if "&" in x else x, linked))

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m["data"] is not None:
            parts.append((m["data"], linked))
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["end"]:
            if name == "a":
                linked = False
            if name in BLOCK:
                close()
                linked = heading = False
            for k in range(len(stack) - 1 if open_[name] else -1, -1, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
                if stack[k][0] in ("article", "main", "body"):  # a stray end tag doesn't leave its article
                    break
            continue
        if name not in HEAD and open_["head"]:
            end(("head",), ())
        if name in RAW:
            stop = RAW_END[name].search(page, at)
            at = stop.end() if stop else n
            continue
        if name == "br":
            parts.append((" ", False))
        if name == "a":
            linked = True
        if name in BLOCK:
            close()
            for k in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph, whatever inline elements are open in it
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] in BLOCK:
                    break
            if name in ENDS:
                end(*ENDS[name])
            heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
            if name in ("article", "main", "p") or heading:
                linked = False
        elif not m["rest"].strip():
            continue
        if name in VOID:
            continue
        surely, by_name = apart(name, m["rest"], root > 0)
        if name in BLOCK or surely or by_name:
            if surely or by_name:
                close()
            stack.append((name, bad, named, root))
            open_[name] += 1
            bad = bad or surely
            if by_name:
                above.append(named)
                named = len(above) - 1
            if name in ("article", "main") and not bad and not by_name:
                x = named
                while x and x not in wrappers:
                    wrappers.add(x)
                    x = above[x]
                if not root:
                    roots += 1
                    root = roots
    close()
    return out, above, wrappers


def main_text(page: str | None) -> str:
    """Text of the blocks that two passes call good, in page order, joined by one space.

    Pass 1 decides a block by its share of linked characters, its length and its share of stop words (letters only
    count, so marks around words don't matter), and by the elements it stands in; a page that holds hardly any stop
    words is in another language, where length speaks for a block alone. What the names of an element say is evidence
    only: it does not count for one that holds an article or main element, nor for one that holds the page's only
    long prose together with a heading. Pass 2 gives undecided blocks, short ones mostly, the label of the nearest decided
    block, before or after; at equal distance good wins. Within an article or main element only its own blocks count,
    and with none decided the element itself speaks for them. If an article has good blocks, those outside it are not
    its text.
    """
    found, above, wrappers = blocks(page) if page else ([], [0], set())
    words = [LETTERS.findall(b.text.lower()) for b in found]
    stops = [sum(w in STOP_WORDS for w in x) for x in words]
    known = sum(stops) >= KNOWN * sum(map(len, words))

    def prose(k: int) -> bool:
        b = found[k]
        return len(b.text) >= LONG and not b.heading and b.linked <= LINKED and (not known or stops[k] >= STOP_HIGH * len(words[k]))

    around_all = _around_all(above, [found[k].named for k in range(len(found)) if not found[k].bad and prose(k)])
    headed = set()
    for b in found:
        x = b.named if b.heading else 0
        while x and x not in headed:
            headed.add(x)
            x = above[x]
    wrappers |= {x for x in around_all if x in headed}
    text = _kept(found, _named_apart(above, wrappers), words, stops, known, prose)
    if not text and around_all:
        # what an element is called is no reason to leave out all prose that the page has
        text = _kept(found, _named_apart(above, wrappers | around_all), words, stops, known, prose)
    return text


def _around_all(above: list[int], inner: list[int]) -> set[int]:
    """Named elements around all of some blocks, given by the innermost one of each: those that every block's walk up meets."""
    if not inner or not all(inner):
        return set()
    met, todo = [0] * len(above), Counter(inner)
    for x in range(len(above) - 1, 0, -1):  # an element comes after those around it
        met[x] += todo[x]
        met[above[x]] += met[x]
    return {x for x in range(1, len(above)) if met[x] == len(inner)}


def _named_apart(above: list[int], wrappers: set[int]) -> list[bool]:
    """For each named element, whether its name or that of one around it counts."""
    out = [False] * len(above)
    for x in range(1, len(above)):
        out[x] = out[above[x]] or x not in wrappers
    return out


def _kept(found: list[Block], apart_by_name: list[bool], words: list[list[str]], stops: list[int], known: bool, prose) -> str:
    """The two passes: labels of the blocks, then those of their neighbours for the undecided ones; the good blocks' text."""
    away = [b.bad or apart_by_name[b.named] for b in found]
    label: list[bool | None] = []
    for k, b in enumerate(found):
        if away[k] or b.linked > (LINKED_ROOT if b.root else LINKED):
            label.append(False)
        elif prose(k):
            label.append(True)
        elif known and len(b.text) >= 3 * LONG and stops[k] < STOP_LOW * len(words[k]) and not b.root:
            label.append(False)
        else:
            label.append(None)
    final = list(label)
    decided = [k for k, x in enumerate(label) if x is not None]
    within: dict[int, list[int]] = {}
    for k in decided:
        if found[k].root and not away[k]:
            within.setdefault(found[k].root, []).append(k)
    for k, own in enumerate(label):
        if own is not None:
            continue
        near = _around(within.get(found[k].root, []) if found[k].root else decided, k)
        gap = min((abs(d - k) for d in near), default=0)
        final[k] = not near or any(label[d] for d in near if abs(d - k) == gap)
    inside = any(good and b.root for good, b in zip(final, found))
    return " ".join(b.text for good, b in zip(final, found) if good and (b.root or not inside))


def _around(decided: list[int], k: int) -> list[int]:
    """The nearest of some blocks before and after k."""
    at = bisect_left(decided, k)
    return decided[max(at - 1, 0) : at + 1] if at else decided[:1]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) for each row of ``pages``; a null or empty html has an empty text.

    Whole pages are read, one at a time within a task; broken markup is read as far as it goes. Null ids and urls and
    repeated rows stay; other columns are not read.
    """

    @F.pandas_udf("string")
    def text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(main_text, na_action=None).astype("object")

    out = pages.select(id_col, url_col, text(F.col(html_col)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
