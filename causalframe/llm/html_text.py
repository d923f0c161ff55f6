"""Main text of web pages: parser events, text-to-tag ratio by line, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame, functions as F

#: Elements that hold no article text, and those that end a line.
SKIPPED = frozenset("script style noscript template head title nav header footer aside form button select textarea iframe object svg canvas menu dialog audio video".split())
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary hr fieldset center".split()) | SKIPPED
#: Elements that may be the region of the article.
REGIONS = frozenset("html body main article section div td center blockquote".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id or role that hint at an element that is not part of the article; see _Reader.dropped.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "comment comments reply replies discussion disqus sidebar aside widget menu nav navbar navigation breadcrumb breadcrumbs footer foot header masthead topbar "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager copyright hidden".split()
)


#: Further elements, whose tags stand within a line.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label map mark optgroup option picture q ruby s samp small span strike strong sub sup time tt u var".split())
_OPEN_TAG = re.compile(r"<(?:([a-zA-Z][a-zA-Z0-9]*)(?:\s*/?|\s+[\w:-]+\s*(?:=[^<>]*|))|/[a-zA-Z][^<>]*|[!?][^<>]*)\Z")
_NAMES = SKIPPED | BLOCKS | VOID | INLINE


def without_cut_tag(html: str) -> str:
    """The page without a tag or comment that its end cuts off. A `<` after which no element's name stands, alone or with
    one attribute after the other, is text."""
    at = html.rfind("<")
    if at < 0 or ">" in html[at:]:
        return html
    m = _OPEN_TAG.match(html, at)
    if m and (m[1] is None or m[1].lower() in _NAMES and (len(m[0].split()) == 1 or "=" in m[0])):
        return html[:at]
    return html[:at] + "&lt;" + html[at + 1 :]


class _Reader(HTMLParser):
    """Lines of a page, streamed from parser events: (runs of text, each with the innermost marked element around it; tags;
    the innermost open container). Elements know the one above them, so that deep nesting costs no more than its tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, int, int]] = []  # tag, number, skipped, innermost marked element, innermost container
        self.names: dict[str, int] = {}  # open elements by tag
        self.raw: list[tuple[list[tuple[str, int]], int, int]] = []
        self.parts: list[tuple[str, int]] = []
        self.sure: dict[int, bool] = {}  # marked element: whether its name consists of marks alone
        self.above: dict[int, int] = {0: 0}  # marked element: the marked one around it; 0 is none
        self.parent: dict[int, int] = {0: 0}  # container: the container around it; 0 is the page
        self.articles: list[int] = []  # the innermost marked element around each article or main without marks
        self.whole: set[int] = set()  # article and main elements
        self.within = 0  # open article and main elements
        self.tags = self.count = 0

    def end_line(self) -> None:
        if self.parts:
            if any(not data.isspace() for data, _ in self.parts):
                self.raw.append((self.parts, self.tags, self.open[-1][4] if self.open else 0))
            self.parts = []
        self.tags = 0

    def close_to(self, tag: str, stop: frozenset = frozenset()) -> None:
        if not self.names.get(tag):
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag in BLOCKS:
                    self.end_line()
                for t, *_ in self.open[i:]:
                    self.names[t] -= 1
                    self.within -= t in ("article", "main")
                del self.open[i:]
                return
            if self.open[i][0] in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.end_line()
            self.close_to("p", frozenset(BLOCKS - {"p"}))
            if tag in ("li", "dt", "dd", "tr", "td", "th"):
                self.close_to(tag, frozenset(("ul", "ol", "dl", "table")))
        elif tag == "br":
            self.parts.append((" ", 0))
        self.tags += 1
        if tag in VOID:
            return
        self.count += 1
        _, _, skipped, mark, container = self.open[-1] if self.open else ("", 0, False, 0, 0)
        skipped = skipped or tag in SKIPPED
        if not skipped and tag not in ("html", "body"):
            hint, whole = self.named(tag, attrs)
            if tag in ("article", "main"):
                if not hint:
                    self.articles.append(mark)
            else:
                skipped = any(name == "hidden" for name, _ in attrs)
                if hint:
                    self.sure[self.count], self.above[self.count] = whole, mark
                    mark = self.count
        if tag in ("article", "main"):
            self.whole.add(self.count)
            self.within += 1
        if tag in REGIONS:
            self.parent[self.count] = container
            container = self.count
        self.names[tag] = self.names.get(tag, 0) + 1
        self.open.append((tag, self.count, skipped, mark, container))

    def named(self, tag, attrs) -> tuple[bool, bool]:
        """Whether a name holds a mark, and whether one consists of marks alone. Ids of headings and sections are often slugs of their titles."""
        hint = whole = False
        for name, value in attrs:
            if not value or name not in ("class", "id", "role"):
                continue
            slug = name == "id" and (tag in HEADINGS or tag == "section" or self.within > 0 and tag == "div")
            if slug and (tag in HEADINGS or self.within):
                continue
            for token in value.lower().split():
                words = token.replace("-", " ").replace("_", " ").split()
                if not MARKS.isdisjoint(words):
                    hint = True
                    whole = whole or (not slug and MARKS.issuperset(words))
        return hint, whole

    def dropped(self) -> set[int]:
        """The marked elements that are no part of the article.

        One that holds an article or main stays, and one with half of the page's text unless an article stands outside it.
        Of the others go those whose name consists of marks alone (cookie-notice); those whose name holds other words too
        (has-sidebar, related-work) only if they have less than half the characters a tag of the page's content.
        """
        if not self.sure:
            return set()
        chars, tags, holds = dict.fromkeys(self.above, 0), dict.fromkeys(self.above, 0), dict.fromkeys(self.above, False)
        surely = {0: False}  # whether a name of marks alone stands at the element or above it
        for m in sorted(self.sure):
            surely[m] = self.sure[m] or surely[self.above[m]]
        total, ratios = 0, []
        for parts, n_tags, _ in self.raw:
            sizes: dict[int, int] = {}
            for data, m in parts:
                sizes[m] = sizes.get(m, 0) + sum(map(len, data.split()))
            for m, n in sizes.items():
                total += n
                chars[m] += n
                tags[m] += max(1, n_tags)
            if not any(surely[m] for m in sizes):
                ratios.append(sum(sizes.values()) / max(1, n_tags))
        for m in self.articles:
            holds[m] = True
        for m in sorted(self.sure, reverse=True):  # inner elements have larger numbers
            up = self.above[m]
            chars[up] += chars[m]
            tags[up] += tags[m]
            holds[up] = holds[up] or holds[m]
        t = clustered(smoothed(ratios)) if ratios else 0.0
        out: set[int] = set()
        for m in sorted(self.sure):
            stays = holds[m] or 2 * chars[m] >= total and not self.articles
            if self.above[m] in out or not stays and (self.sure[m] or 2 * chars[m] < t * max(1, tags[m])):
                out.add(m)
        return out

    def lines(self) -> list[tuple[str, int, int]]:
        """(text, tags, innermost container) of the lines without what is dropped."""
        gone, out = self.dropped(), []
        for parts, tags, container in self.raw:
            text = " ".join("".join(data for data, m in parts if m not in gone).split())
            if text:
                out.append((text, tags, container))
        return out

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:  # as browsers read it
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "br":
            self.parts.append((" ", 0))
        elif tag not in VOID:
            self.close_to(tag)

    def handle_data(self, data):
        if not (self.open and self.open[-1][2]):
            self.parts.append((data, self.open[-1][3] if self.open else 0))


def smoothed(values: list[float], radius: int = 2) -> list[float]:
    """Gaussian smoothing with a kernel of 2 * radius + 1 lines, which is cut off and scaled at the ends."""
    import math

    kernel = [math.exp(-(k * k) / (2 * (radius / 2) ** 2)) for k in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        weight = total = 0.0
        for k in range(max(0, i - radius), min(len(values), i + radius + 1)):
            w = kernel[k - i + radius]
            weight, total = weight + w, total + w * values[k]
        out.append(total / weight)
    return out


def clustered(values: list[float]) -> float:
    """The threshold between the low and the high cluster: the mean of the two clusters' means, iterated until it stands."""
    t = sum(values) / len(values)
    for _ in range(50):
        low, high = [v for v in values if v < t], [v for v in values if v >= t]
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2 if low and high else t
        if abs(new - t) < 1e-9:
            break
        t = new
    return t


def main_text(html: str | None, hold: float = 0.75) -> str:
    """The article's text of a page, its blocks in page order joined by newlines; empty if there is none.

    Lines are runs of text between block elements; menus, headers, notices and the like are left out by element or by
    name, names being hints that the page's shape must bear out. Each line's ratio of characters to tags is smoothed, and
    the lines above the clusters' threshold are content.
    The innermost element that holds at least `hold` of the content lines' characters marks the place. The region is the
    article or main around it, or else the least element around it that holds all content lines; its lines are all kept,
    so that a short paragraph, a headline or a further section beside long ones stays.
    """
    if not html:
        return ""
    reader = _Reader()
    reader.feed(without_cut_tag(html))
    reader.close()
    reader.end_line()
    lines = reader.lines()
    if not lines:
        return ""
    ratios = smoothed([len(text) / max(1, tags) for text, tags, _ in lines])
    t = clustered(ratios)
    mass = dict.fromkeys(reader.parent, 0)
    for (text, _, container), r in zip(lines, ratios):
        if r >= t:
            mass[container] += len(text)
    depth = {0: 0}
    for n in sorted(reader.parent)[1:]:
        depth[n] = depth[reader.parent[n]] + 1
    for n in sorted(reader.parent, reverse=True)[:-1]:
        mass[reader.parent[n]] += mass[n]
    total = mass[0]
    held = [n for n in reader.parent if n and mass[n] >= hold * total]
    innermost = max(held, key=depth.__getitem__, default=0)
    around = []
    while innermost:
        around.append(innermost)
        innermost = reader.parent[innermost]
    region = next((n for n in around if n in reader.whole), None) or next((n for n in around if mass[n] == total), 0)
    inside = {0: region == 0}
    for n in sorted(reader.parent)[1:]:
        inside[n] = n == region or inside[reader.parent[n]]
    return "\n".join(text for text, _, container in lines if inside[container])


def extract_text(pages: DataFrame, *, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """The pages' columns without html, and the main text; see main_text.

    Pages are independent: nothing is shuffled and a task holds one Arrow batch. Null or empty html and pages without
    text give an empty text; repeated rows are kept; a column of the input named like the result, in any case of letters, is
    replaced. Pages of any length and depth are read whole, in time by their length. An empty table gives an empty one.
    """
    own = [f for f in pages.schema.fields if f.name != html_col and f.name.lower() != text_col.lower()]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            html = batch.column(len(own)).to_pylist()
            texts = pa.array([main_text(h) for h in html], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(own))), texts], [*(f.name for f in own), text_col])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), f"`{text_col}` string"])
    return pages.select(*[F.col(f"`{f.name}`") for f in own], F.col(html_col)).mapInArrow(run, schema)
