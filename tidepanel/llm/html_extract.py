"""Main text of web pages: parser events, text-to-tag ratio by line, smoothing, clusters over a threshold."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from math import exp

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements of HTML by role.
SKIPPED = frozenset("script style noscript template head title nav header footer aside form button select textarea iframe svg canvas object".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in an element's class, id or role that mark it as something else than the article.
OTHER = frozenset("ad ads advert advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar footer header masthead comment comments replies disqus cookie cookies consent notice popup modal newsletter subscribe share sharing social related recommended widget login signup pagination toolbar".split())
#: Words that only say how or where such an element stands.
PLAIN = frozenset("a the site page main top bottom left right inner outer list box bar block area section wrap wrapper container content slot unit buttons button links link items item form group row col column panel message text small large sticky fixed floating primary secondary global user reader".split())
_PART = re.compile(r"[a-z]+")
_WHITE = re.compile(r"\s+")
#: Elements that an opening tag of the key ends where they stand open, as browsers do.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}


def says_other(value: str) -> bool:
    """Whether a class, id or role names something else than the article: of some name in it, all words say so or say nothing."""
    for name in value.split():
        parts = _PART.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
        if any(p in OTHER for p in parts) and all(p in OTHER or p in PLAIN for p in parts):
            return True
    return False


class Lines(HTMLParser):
    """Turns parser events into lines: a line is what stands between two block boundaries, with its number of tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []  # element, and the number of the article or main around it
        self.skip = 0  # how many open elements are not text
        self.dark: list[bool] = []
        self.lines: list[tuple[str, int, int]] = []  # text, tags, container
        self.text: list[str] = []
        self.tags = 0
        self.boxes = 0
        self.box = 0

    def end_line(self) -> None:
        if self.text:
            text = _WHITE.sub(" ", "".join(self.text)).strip()
            if text:
                self.lines.append((text, self.tags, self.box))
                self.tags = 0
            self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.end_line()
            if (ends := _ENDS.get(tag)) and self.open and self.open[-1][0] in ends:
                self.pop()
            self.end_paragraph()
        self.tags += 1
        if tag in EMPTY:
            if tag == "br":
                self.text.append("\n")
            return
        dark = tag in SKIPPED and not (tag == "header" and self.box)
        if not dark and attrs and tag not in ("body", "html", "article", "main"):
            dark = any(k in ("class", "id", "role") and v and says_other(v) or k == "hidden" for k, v in attrs)
        self.open.append((tag, self.box))
        self.dark.append(dark)
        self.skip += dark
        if tag in ("article", "main") and not self.skip:
            self.boxes += 1
            self.box = self.boxes

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if tag == "br":
            self.text.append("\n")

    def end_paragraph(self) -> None:
        """A block ends the paragraph that stands open, with what is open in it, as in browsers."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == "p":
                while len(self.open) > k:
                    self.pop()
                return
            if self.open[k][0] in BLOCKS or self.open[k][0] in SKIPPED:
                return

    def pop(self) -> str:
        tag, self.box = self.open.pop()
        self.skip -= self.dark.pop()
        return tag

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if tag in EMPTY or all(t != tag for t, _ in self.open):
            return
        if tag not in BLOCKS and tag not in SKIPPED:  # an inline end tag doesn't end a block
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    self.skip -= self.dark[k]
                    del self.open[k], self.dark[k]
                    return
                if self.open[k][0] in BLOCKS:
                    return
        while self.pop() != tag:
            pass

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # not a section that the parser knows: up to the next >, as browsers do
            return self.parse_bogus_comment(i)

    def close(self):
        super().close()
        self.end_line()


def smoothed(values: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing within 3 sigma; the kernel is renormalised at the ends."""
    reach = max(1, int(3 * sigma))
    kernel = [exp(-0.5 * (k / sigma) ** 2) for k in range(reach + 1)]
    n, out = len(values), []
    for i in range(n):
        total = weight = 0.0
        for j in range(max(0, i - reach), min(n, i + reach + 1)):
            w = kernel[abs(i - j)]
            total += w * values[j]
            weight += w
        out.append(total / weight)
    return out


def dense(lines: list[tuple[str, int, int]], sigma: float, threshold: float) -> list[bool]:
    """Which lines belong to a cluster: their smoothed ratio of text to tags reaches `threshold` times the page's mean, and their own
    half of that, so that a list of links isn't carried by a long neighbour."""
    own = [len(t) / max(1, tags) for t, tags, _ in lines]
    ratios = smoothed(own, sigma)
    floor = threshold * sum(ratios) / len(ratios)
    return [r >= floor and x >= floor / 2 for r, x in zip(ratios, own)]


def main_text(html: str | None, sigma: float = 1.0, threshold: float = 0.5) -> str:
    """The page's article. Lines in elements that are never text are gone already; of the others `dense` makes clusters.

    An article or main element most of whose text lies in clusters is a region and is kept whole, with its short lines; if there are
    such elements and none is mostly dense, the one with most text in clusters is (then the longest, then the first). On pages
    without them a region is a run of clusters with the gaps of at most two lines between them.
    """
    parser = Lines()
    try:
        parser.feed(html or "")
        parser.close()
    except AssertionError:  # of the parser, on broken declarations; what came before counts
        parser.end_line()
    lines = parser.lines
    if not lines:
        return ""
    picked = dense(lines, sigma, threshold)
    boxes: dict[int, list[int]] = {}
    for (text, _, box), hit in zip(lines, picked):
        if box:
            sums = boxes.setdefault(box, [0, 0])
            sums[0] += len(text) * hit
            sums[1] += len(text)
    if boxes:
        keep = {b for b, (inside, whole) in boxes.items() if 2 * inside >= whole} or {max(boxes, key=lambda b: (*boxes[b], -b))}
        chosen = [t for t, _, box in lines if box in keep]
    else:
        at = [k for k, hit in enumerate(picked) if hit]
        keep = set(at)
        for a, b in zip(at, at[1:]):
            if b - a <= 3:
                keep.update(range(a, b))
        chosen = [lines[k][0] for k in sorted(keep)]
    return "\n\n".join(chosen)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page. A null or empty html gives an empty text; repeated pages give repeated rows; nulls in
    page_id and url stay; an empty table gives no rows; other columns are ignored. No shuffle; a worker holds one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
