"""Main text of web pages by text-to-tag ratio.

The standard library's parser sends events as it reads the page.  Each block
element's text is a line with its number of tags; lines inside parts that say
what they are (navigation, footers, forms, scripts, adverts, comments ...) are
set aside.  The logarithms of the others' text-to-tag ratios are smoothed with
a Gaussian and split at a threshold found by clustering (two means, from a
link's ratio and the median of the upper half); a ratio of prose is always
content, so one long line cannot be the only content.

A class, id or role names a part by any word of a token that says so
(``comment-list``, ``ad-container``, ``cookie-notice-bar``; a few words only as
a whole token or at its end), but not after a state (``has-sidebar``), and not
if the part holds most of the page's content lines and no article or main
element stands outside it.

The main text is the article element that holds most content, if it holds more
than stands outside of articles; else the deepest element that holds every
content line outside of articles (of all, if there are none), widened to the
main element around it and to the page's only headline.  All lines of that
region stay, so do short paragraphs and headings between long ones.

Cases: a null or empty page gives an empty text; a page cut off anywhere is
read up to there (an unfinished tag is no text); unclosed elements end with
their parent; rows are independent, so repeated ids do not matter.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from privtab.llm import common as C

# Fixed values of HTML: elements that start a block, that have no end tag, and
# that the start of another ends.
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre
    section summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDED_BY = {"p": BLOCKS - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
            "option": {"option", "optgroup"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
            "head": {"body"}}
#: Elements that never hold main text.
NOISE = frozenset("""head title script style noscript template svg math canvas iframe object nav footer aside form
    button select textarea input label dialog menu audio video map""".split())
#: Words of a class, id or role that name a part around the main text ...
NOISE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertisements advertising adsbygoogle adsense
    banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead
    cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share
    sharing social related recommended comment comments commentlist reply replies disqus respond widget toolbar
    pagination pager skip contentinfo complementary dialog menubar""".split())
#: ... and those that do so only as a whole token or as its last word.
LAST_WORDS = frozenset("header search".split())
#: A header of one of these belongs to the text.
OWN_HEADER = frozenset("article post entry story content".split())
HOLDERS = frozenset("html body main".split())
#: First words of a class that say what a part has or lacks.
STATES = frozenset("has no not with without is show hide enable disable".split())
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: A tag or reference that the end of the page cuts off.
_CUT_TAG = re.compile(r"<(?:[a-zA-Z/!?][^<>]*)?\Z")

SIGMA = 1.0
#: Characters a tag of a typical link, and of prose.
LINK_RATIO, PROSE_RATIO = 10, 80
#: A named part with this share of the content text is main text, and at the lower
#: share if it has a headline, article or main element.
MOST, HALF = 0.9, 0.5


class _Events(HTMLParser):
    """Lines of a page: (text, tags, path of element numbers, headline?)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = []      # (name, element number, noise?)
        self.named = set()   # elements that a class, id or role calls noise
        self.noise = 0
        self.names = [""]    # by element number
        self.lines = []
        self.text, self.tags = [], 0

    def end_line(self):
        if not self.noise:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append((text, self.tags, tuple(e[1] for e in self.stack)))
        self.text, self.tags = [], 0

    def pop(self):
        name, _, noise = self.stack.pop()
        self.noise -= noise
        return name

    def close_to(self, depth):
        while len(self.stack) > depth:
            if self.stack[-1][0] in BLOCKS or self.stack[-1][2] or self.stack[-1][1] in self.named:
                self.end_line()
            self.pop()

    def names_noise(self, value, inside):
        """Does a class, id or role call the part noise?"""
        for token in value.split():
            words = _WORD.findall(_CAMEL.sub("-", token).lower())
            if not words or words[0] in STATES:
                continue
            if NOISE_WORDS.intersection(words):
                return True
            if words[-1] in LAST_WORDS and not (words[-1] == "header" and (inside or OWN_HEADER.intersection(words))):
                return True
        return False

    def is_noise(self, tag, attrs):
        if tag in NOISE:
            return True
        if tag in HOLDERS:
            return False
        inside = any(e[0] == "article" for e in self.stack)
        if tag == "header":
            return not inside
        for key, value in attrs:
            if key == "hidden" or key == "aria-hidden" and value == "true":
                return True
            if not value:
                continue
            if key in ("class", "id", "role"):
                self.called = self.called or self.names_noise(value, inside)
            elif key == "style" and _HIDDEN.search(value.lower()):
                return True
        return False

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        for depth in range(len(self.stack) - 1, -1, -1):
            name = self.stack[depth][0]
            if tag in ENDED_BY.get(name, ()):
                self.close_to(depth)
                break
            if name in BLOCKS and name not in ENDED_BY:
                break
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            if tag in BLOCKS:
                self.end_line()
            return
        self.called = False
        noise = self.is_noise(tag, attrs)
        if tag in BLOCKS or noise or self.called:
            self.end_line()
            self.tags = 1
        self.names.append(tag)
        if self.called:
            self.named.add(len(self.names) - 1)
        self.stack.append((tag, len(self.names) - 1, noise))
        self.noise += noise

    def handle_endtag(self, tag):
        self.tags += 1
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == tag:
                self.close_to(depth)
                return
        if tag in BLOCKS:
            self.end_line()

    def handle_data(self, data):
        if not self.noise:
            self.text.append(data)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel is cut and weighed anew."""
    reach = max(1, int(round(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach:reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach:reach + len(ratios)] / weight


def threshold(values: np.ndarray) -> float:
    """Midpoint between two means of log ratios, at most the ratio of prose."""
    upper = np.sort(values)[len(values) // 2:]
    low, high = float(np.log1p(LINK_RATIO)), float(np.median(upper))
    for _ in range(32):
        cut = (low + high) / 2
        above = values > cut
        if not above.any() or above.all():
            break
        a, b = float(values[~above].mean()), float(values[above].mean())
        if (a, b) == (low, high):
            break
        low, high = a, b
    return min((low + high) / 2, float(np.log1p(PROSE_RATIO)))


def content_lines(lines: list) -> np.ndarray:
    """Which lines have a high smoothed text-to-tag ratio; all, if none has."""
    smooth = smoothed(np.log1p([len(text) / max(1, tags) for text, tags, _ in lines]))
    chosen = smooth >= threshold(smooth)
    return chosen if chosen.any() else ~chosen


def without_named(events: _Events) -> list:
    """The lines that are in no part that a class, id or role calls noise; a part
    with most of the content text is none, if no article or main element stands outside it."""
    lines, named = events.lines, events.named
    if not named or not lines:
        return lines
    mass, total, heads, held = {}, 0, set(), set()
    for (text, _, path), chosen in zip(lines, content_lines(lines)):
        total += len(text) * bool(chosen)
        if any(events.names[e] in ("h1", "article", "main") for e in path):
            heads.update(path)
        if any(events.names[e] in ("article", "main") for e in path):
            held.update(path)
        for e in named.intersection(path):
            mass[e] = mass.get(e, 0) + len(text) * bool(chosen)
    noise = {e for e in named if held and e not in held or mass.get(e, 0) <= (HALF if e in heads else MOST) * total}
    return [line for line in lines if not noise.intersection(line[2])]


def main_text(html: str | None) -> str:
    """The main text of one page; blocks joined by a newline."""
    if not html:
        return ""
    events = _Events()
    events.feed(_CUT_TAG.sub("", html))
    events.close()
    events.close_to(0)
    events.end_line()
    lines = without_named(events)
    if not lines:
        return ""
    chosen = content_lines(lines)
    # content of each outermost article, and outside of articles; elements are numbered in page order
    articles, outside = {}, 0
    for (text, _, path), content in zip(lines, chosen):
        article = next((e for e in path if events.names[e] == "article"), None)
        if article is not None:
            articles[article] = articles.get(article, 0) + len(text) * bool(content)
        else:
            outside += len(text) * bool(content)
    best = max(articles, key=lambda e: (articles[e], -e), default=None)
    if best is not None and articles[best] >= outside:
        return "\n".join(text for text, _, p in lines if best in p)
    core = [path for (_, _, path), content in zip(lines, chosen) if content and not articles.keys() & set(path)]
    region = max(set.intersection(*map(set, core)), default=0)
    path = next((p for _, _, p in lines if region in p), ())
    path = path[:path.index(region) + 1] if region else ()
    holder = next((e for e in path if events.names[e] == "main"), None)
    if holder is not None:
        region = holder
    elif region:
        heads = [p for _, _, p in lines if any(events.names[e] == "h1" for e in p)]
        if len(heads) == 1 and region not in heads[0]:
            region = max((e for e in path if e in heads[0]), default=0)
        elif events.names[region] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li") and len(path) > 1:
            region = path[-2]
    return "\n".join(text for text, _, p in lines if not region or region in p)


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                  carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """Per page: page_id, carry, text (main text), n_chars (its code points)."""
    base = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).cast("string").alias("html"), C.carried(carry))
    kind = StructType(C.row_type(base, "page_id", "carry").fields + StructType.fromDDL("text string, n_chars long").fields)
    schema = to_arrow_schema(kind)

    def run(batches):
        for whole in batches:
            for batch in C.sliced([whole], 500):
                texts = [main_text(h) for h in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("carry"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return base.mapInArrow(run, kind)
