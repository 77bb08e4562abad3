"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block of text, with ``window`` empty lines where a container (a
<div>, <section>, <article> ...) begins or ends. A line counts its characters outside links; lists of links count
none. The counts of windows of ``window`` lines are summed: at a *surge* the sum leaves zero, at a *dive* it
returns to zero, and what lies between is a stretch. The page's own distribution tells which stretches are text:
those whose largest window reaches ``share`` of the largest window of the page. So does what lies between the first and the last of them,
and what stands in the same element as one of them, cut off by an advert.

Tags and classes only veto. Menus, headers, footers, sidebars, notices, adverts, forms and reader comments -
told by element, role or class - never count. If the page marks an <article> or <main>, its stretches stay,
and others stay only if they hold the largest window of the page, of at least ``least`` characters. A class or id
tells only by a whole token made of known words, and never for an element with most of the page's text
unless an <article>, <main> or <h1> stands elsewhere (reader comments and adverts: unless one stands within).

Defined results: null, empty or text-free html gives the empty text; broken markup is read as far
as it goes (an element that is never closed ends before the article or at the end of the page, an embedded one has no content);
rows are treated one by one, so ties, repeats and null ids are carried as they are.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftframe.llm.common import filled, fresh

WINDOW = 3
LEAST = 80
SHARE = 0.5  # of the largest window sum of a page

RAW = "script|style|textarea|title|xmp"
# content of these goes too, if they are closed at all
EMBEDDED = set("svg iframe object math noscript template noembed noframes".split())
DROPPED = set("nav header footer aside form button select dialog menu head fieldset".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ROLES = set("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
# words of a class or id that mark what is not the article
WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert"
    " popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar aside widget comment comments"
    " disqus respond replies reply share sharing social related recommended newsletter subscribe subscription signup login pagination pager"
    " toolbar copyright legal disclaimer".split()
)
# words that may stand beside them in a token
BESIDE = set(
    "site main top bottom left right global primary secondary fixed sticky mobile desktop bar box container wrapper wrap inner outer block area"
    " section list links link item items google dfp gpt adsense doubleclick taboola outbrain buttons button icons unit slot form text body content title policy message thread inline column col row".split()
)
TOKENS = set("related-posts related-articles related-stories related-content user-comments reader-comments post-comments".split())
# of these, words of what never wraps an article: reader comments and adverts
ASIDES = set("comment comments disqus respond replies reply ad ads adv advert adverts advertisement advertising sponsor sponsored".split())
# elements around which a stretch ends
CONTAINERS = set("article aside center div main section".split())
# elements that hold text side by side
HOMES = set("article aside body center div html main section td th".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attributes>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?(?P<broken>[a-z][a-z0-9:-]*)[^<>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([a-z_:][\w:.-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)


def _known(token: str) -> bool:
    """Whether a class or id is made of known words alone, as in ``cookie-notice`` or ``ad_slot-2``."""
    words = [w for w in re.split(r"[-_0-9]+", token) if w]
    return token in TOKENS or (not WORDS.isdisjoint(words) and all(w in WORDS or w in BESIDE for w in words))


def _kind(name: str, attributes: str) -> str:
    """`drop`, `class` or `asides` (drop, as its class says), `main` or nothing."""
    if name in DROPPED:
        return "drop"
    main, named = name in ("article", "main"), ""
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES:
            return "drop"
        if key == "role" and value in ("main", "article"):
            main = True
        if key in ("class", "id") and name not in ("html", "body"):
            for token in filter(_known, value.split()):
                named = "asides" if named == "asides" or not ASIDES.isdisjoint(re.split(r"[-_0-9]+", token)) else "class"
    return named + " main" * main if named else "main" if main else ""


def _tokens(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """(name, closing, attributes, text before it)."""
    at, unclosed, m = 0, set(), _TOKEN.search(page)
    while m:
        before, at = page[at : m.start()], m.end()
        name = (m["name"] or m["broken"] or "").lower()
        closing = bool(m["close"]) or m[0].startswith("</")
        if name in EMBEDDED:
            if not closing and not m[0].endswith("/>") and name not in unclosed:
                end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
                if end:
                    at = end.end()
                else:
                    unclosed.add(name)
            yield "", False, "", before
        elif name:
            yield name, closing, m["attributes"] or "", before
        else:
            yield "", False, "", before
        m = _TOKEN.search(page, at)
    yield "", False, "", page[at:]


def _closings(tokens: list[tuple[str, bool, str, str]]) -> dict[int, int]:
    """Place of the end tag of each start tag that has one."""
    waiting: dict[str, list[int]] = {}
    found = {}
    for k, (name, closing, _, _) in enumerate(tokens):
        if closing and waiting.get(name):
            found[waiting[name].pop()] = k
        elif name and not closing and name not in VOID:
            waiting.setdefault(name, []).append(k)
    return found


class _Wrappers:
    """Tells elements with most of the text of a page, menus and the like left aside."""

    def __init__(self, tokens: list[tuple[str, bool, str, str]], ends: dict[int, int], least: int):
        self.ends, self.least, self.before, skip_to = ends, least, [0], -1
        for k, (name, closing, _, text) in enumerate(tokens):
            self.before.append(self.before[-1] + (len(text.strip()) if k > skip_to else 0))
            if k > skip_to and name in DROPPED and not closing:
                skip_to = ends.get(k, -1)
        self.marks = [k for k, (name, closing, _, _) in enumerate(tokens) if not closing and name in ("article", "main", "h1")]

    def holds(self, k: int, asides: bool) -> bool:
        """Whether the element at ``k`` is one; comments and adverts only with a mark within."""
        end = self.ends.get(k)
        if end is None:
            return False
        held = self.before[end + 1] - self.before[k + 1]
        marked = any(k <= m < end for m in self.marks)
        return held >= self.least and 2 * held > self.before[-1] and (marked or not self.marks and not asides)


def lines(page: str, window: int = WINDOW, least: int = LEAST) -> list[tuple[str, int, bool, int]]:
    """(text, characters that count, whether inside <article> or <main>, element that holds it) of each line."""
    tokens = list(_tokens(page))
    ends = _closings(tokens)
    wrappers = None
    out: list[tuple[str, int, bool, int]] = []
    spans: list[tuple[str, bool]] = []  # of the line being read: text, in a link
    links, mains, homes, items, skip_to = 0, [], [], 0, -1

    def line() -> None:
        text = " ".join(entities.unescape("".join(s for s, _ in spans)).split())
        linked = items and not mains and spans and all(inside or not s.strip() for s, inside in spans)
        spans.clear()
        if text:
            out.append((text, 0 if linked else len(text), bool(mains), homes[-1] if homes else -1))

    def gap() -> None:
        line()
        out.extend([("", 0, bool(mains), -1)] * window)

    for k, (name, closing, attributes, before) in enumerate(tokens):
        if k <= skip_to:
            continue
        if before:
            spans.append((before, links > 0))
        if mains and k >= mains[-1]:
            gap()
            while mains and k >= mains[-1]:
                mains.pop()
        if not name:
            continue
        if name in CONTAINERS:
            gap()
        elif name in BLOCKS:
            line()
        elif name == "br":
            spans.append((" ", links > 0))
        while homes and k >= ends[homes[-1]]:
            homes.pop()
        if name == "a":
            links = 0 if closing else 1
        elif name == "li":
            items = max(0, items + (-1 if closing else 1)) if closing or k in ends else items
        if closing:
            continue
        kind = _kind(name, attributes)
        if kind.startswith(("class", "asides")):
            wrappers = wrappers or _Wrappers(tokens, ends, least)
            named, _, kind = kind.partition(" ")
            kind = kind if wrappers.holds(k, named == "asides") else "drop"
        if kind == "main":
            gap()
            mains.append(ends.get(k, len(tokens)))
        elif kind == "drop" and name not in VOID:
            gap()
            stop = ends.get(k)
            if stop is None:  # never closed: up to the article, or to the end
                stop = next((j - 1 for j in range(k + 1, len(tokens)) if not tokens[j][1] and (tokens[j][0] in ("article", "main", "body") or tokens[j][0] == "h1")), len(tokens))
            skip_to, links = stop, 0
        if name in HOMES and kind != "drop" and k in ends:
            homes.append(k)
    line()
    return out


def window_sums(counts: list[int], window: int = WINDOW) -> list[int]:
    """Sums over windows of so many lines; the first ends at the first line, the last begins at the last one."""
    totals = [0, *accumulate(counts)]
    n = len(counts)
    return [totals[min(k + window, n)] - totals[max(k, 0)] for k in range(1 - window, n)]


def stretches(counts: list[int], window: int = WINDOW) -> list[tuple[int, range]]:
    """(largest window sum, lines) from each surge to its dive."""
    found, start, sums = [], None, window_sums(counts, window)
    for k, total in enumerate([*sums, 0]):
        if total and start is None:
            start = k  # surge
        elif not total and start is not None:
            # window k covers the lines from k - window + 1
            found.append((max(sums[start:k]), range(max(0, start - window + 1), min(k, len(counts)))))  # dive
            start = None
    return found


def main_text(page: str, window: int = WINDOW, least: int = LEAST, share: float = SHARE) -> str:
    """The blocks between surges and dives of the window sums, a line each."""
    found = lines(page, window, least)
    cut = stretches([n for _, n, _, _ in found], window)
    inside = lambda covered: any(found[k][2] and found[k][1] for k in covered)
    most = max((peak for peak, _ in cut), default=0)
    level = share * most
    marked = [s for s in cut if inside(s[1])]
    if marked:
        # the largest window decides whether anything outside of the marked text competes with it
        rivals = most >= least and most > max(peak for peak, _ in marked)
        chosen = [covered for peak, covered in cut if inside(covered) or rivals and peak >= level]
    else:
        chosen = [covered for peak, covered in cut if peak >= level]
    homes = {found[k][3] for covered in chosen for k in covered if found[k][1]}
    kept = []
    for _, covered in cut:
        between = chosen[0].start <= covered.start <= chosen[-1].start and not (marked and not inside(covered) and covered not in chosen)
        kept += [found[k][0] for k in covered if found[k][1] and (between or found[k][3] in homes)]
    return "\n".join(kept)


def extract(pages: DataFrame, html: str = "html", window: int = WINDOW, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """The rows with the main text added as ``text``; only the html visits Python."""

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda page: main_text(page, window, least, share))

    (name,) = fresh(pages, "text")
    return pages.withColumn(name, extracted.asNondeterministic()(filled(html)))
