"""Main text of web pages (operator 2): parser events, text-to-tag ratios, Gaussian smoothing, threshold clusters."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .batches import by_bytes, column

# Element names of HTML by their role.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("aside button canvas dialog footer head header iframe input menu nav noscript object script search select style svg template textarea title".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CONTENT = frozenset("article main".split())
#: Elements that the start of a like one, or of a block for a paragraph, ends.
SELF_ENDING = frozenset("dd dt li p td th tr".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
# Words in the names of classes and ids of what is not the article, and words that can stand beside them without another meaning.
NAMES = frozenset("ad adbox adsense adslot adunit ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets".split())
BESIDE = frozenset("a and area articles bar bottom box block body btn button buttons center column consent container content email fixed form global google header holder icons inner item items left line link links list main media mobile module native news outer page panel posts primary region right row secondary section sign signup site slot stories sub text thread top unit up wrap wrapper".split())
# Words that say so whatever stands beside them, and those of reader comments among all.
ALWAYS = frozenset("adsbygoogle advert adverts advertisement advertisements breadcrumb breadcrumbs commentform commentlist comments disqus navbar sidebar".split())
OF_COMMENTS = frozenset("comment commentform commentlist comments disqus replies reply respond".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+[a-z]?[0-9]*")
COMMENT_END = re.compile(r"--!?>|(?<=<!--)-?>")
#: Standard deviation of the smoothing in blocks, and share of the page's mean ratio that a content cluster must reach.
SIGMA, THRESHOLD = 1.0, 0.5


def words_of_name(name: str) -> list[str]:
    """The words of one name of a class or id."""
    return [x.lower() for x in PARTS.findall(name)]


def names_other_content(value: str) -> bool:
    """True if one of the names in a class or id says that the element is no article text, as `ad`, `site-footer` or `shareButtons` do.

    A name with any other word in it, as `social-history`, says nothing, unless it has a word that always tells, as `user-comments`.
    """
    for name in value.split():
        parts = words_of_name(name)
        if any(x in ALWAYS for x in parts) or any(x in NAMES for x in parts) and all(x in NAMES or x in BESIDE or x[0].isdigit() for x in parts):
            return True
    return False


def names_comments(value: str) -> bool:
    """True if one of the names is made of words of reader comments, and of words without a meaning of their own."""
    return any((parts := words_of_name(name)) and any(x in OF_COMMENTS for x in parts) and (any(x in ALWAYS for x in parts) or all(x in OF_COMMENTS or x in BESIDE or x[0].isdigit() for x in parts)) for name in value.split())


class Zone:
    """A block element whose name says that it is no article text, which what it holds can belie."""

    def __init__(self, above: Zone | None, inside: bool, comments: bool):
        self.above, self.inside, self.comments = above, inside, comments
        self.holds_article = False
        self.chars = 0

    def stays(self, all_chars: int) -> bool:
        """True if it holds an article, or most of the text; comments never do so by their length, and nothing inside an article by holding one."""
        return self.holds_article and not self.inside or not self.comments and 2 * self.chars > all_chars


class Blocks(HTMLParser):
    """Streams events into blocks: text, tags met in it, run number, whether an article holds it, whether a form does, and the innermost zone."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # Elements under way: name, whether left out, whether still open, zone. One that ends inside others stays in place until they end.
        self.open: list[list] = []
        self.places: dict[str, list[int]] = {}  # of the open elements of each name
        self.block_places: list[int] = []
        self.left_out = self.inside = 0
        self.around: list[str] = []  # forms and articles under way
        self.zone: Zone | None = None
        self.zones: list[Zone] = []
        self.text: list[str] = []
        self.tags = self.run = 0
        self.blocks: list[tuple[str, int, int, bool, bool, Zone | None]] = []

    # Markup that is unfinished or odd ends with the next `>`, or with the page, and is no text, as in browsers.

    def parse_comment(self, i: int, report: bool = True) -> int:
        end = COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else len(self.rawdata)

    def parse_pi(self, i: int) -> int:
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else len(self.rawdata)

    def parse_starttag(self, i: int) -> int:
        end = super().parse_starttag(i)
        return end if end >= 0 else len(self.rawdata)

    def parse_endtag(self, i: int) -> int:
        if self.rawdata.find(">", i) < 0:
            return len(self.rawdata)
        end = super().parse_endtag(i)
        return end if end >= 0 else len(self.rawdata)

    def read(self, html: str) -> None:
        """The whole page."""
        self.rawdata = html
        self.goahead(1)
        self.flush()

    def flush(self) -> None:
        if self.text:
            if text := " ".join("".join(self.text).split()):
                self.blocks.append((text, self.tags, self.run, self.inside > 0, bool(self.around) and self.around[-1] == "form", self.zone))
                if self.zone:
                    self.zone.chars += len(text)
            self.text = []
            self.tags = 0

    def push(self, name: str, left_out: bool, zone: Zone | None, article: bool) -> None:
        if name in BLOCKS:
            self.block_places.append(len(self.open))
        self.places.setdefault(name, []).append(len(self.open))
        self.open.append([name, left_out, True, zone, article])
        self.left_out += left_out
        if zone:
            self.zones.append(zone)
            self.zone = zone
        if article:
            self.inside += 1
            self.run += 1
            z = self.zone
            while z and not z.holds_article:
                z.holds_article = True
                z = z.above
        if article or name == "form":
            self.around.append(name)

    def remove(self, at: int) -> None:
        """Ends the element; those that have ended at the top of the stack leave it."""
        element = self.open[at]
        name, left_out, _, zone, article = element
        element[2] = False
        self.places[name].pop()
        if name in BLOCKS:
            self.block_places.pop()
        self.left_out -= left_out
        if zone:
            if zone.above:
                zone.above.chars += zone.chars
            self.zone = zone.above
            if not self.inside:
                self.run += 1
        if article:
            self.inside -= 1
            self.run += 1
        if article or name == "form":
            self.around.pop()
        while self.open and not self.open[-1][2]:
            self.open.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS and not self.left_out:
            self.flush()
            while self.open and self.open[-1][0] in SELF_ENDING and (self.open[-1][0] == tag or self.open[-1][0] == "p" or {self.open[-1][0], tag} <= {"dd", "dt"}):
                self.remove(len(self.open) - 1)
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        left_out, named, comments = tag in LEFT_OUT, False, False
        if attrs and not left_out and tag not in ("html", "body", "form"):
            for name, value in attrs:
                if name in ("class", "id") and value:
                    about = names_comments(value)
                    comments |= about
                    named |= about or tag not in CONTENT and names_other_content(value)
                elif tag not in CONTENT and (name == "role" and (value or "").strip().lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value or "")):
                    left_out = True
        # An inline element is left out by its name at once; what a block holds is looked at first.
        left_out |= named and tag not in BLOCKS
        zone = Zone(self.zone, self.inside > 0, comments) if named and tag in BLOCKS and not self.left_out and not left_out else None
        if (left_out or zone) and tag in BLOCKS and not self.left_out and not self.inside:
            self.run += 1
        self.push(tag, left_out, zone, tag in CONTENT and not named)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing

    def handle_endtag(self, tag: str) -> None:
        """Ends the last open element of the name with all in it; one for formatting ends alone, another inline one only inside its block."""
        self.tags += 1
        if tag in BLOCKS and not self.left_out:
            self.flush()
        if not self.places.get(tag):
            return
        at = self.places[tag][-1]
        if tag in FORMATTING:
            self.remove(at)
        elif tag in BLOCKS or tag in LEFT_OUT or not self.block_places or self.block_places[-1] < at:
            while len(self.open) > at:
                self.remove(len(self.open) - 1)

    def handle_data(self, data: str) -> None:
        if not self.left_out:
            self.text.append(data)


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Ratios under a Gaussian kernel that keeps the mean at the ends."""
    reach = max(1, int(3 * sigma + 0.5))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weight


def main_text(html: str | None, sigma: float = SIGMA, threshold: float = THRESHOLD) -> str:
    """Content blocks of a page joined by line feeds.

    Elements that are never article text are left out as the events arrive; outside an article they also end a run of
    blocks, and an article is a run of its own. The ratio of text to tags per block is smoothed; a run is content if it
    reaches `threshold` times the mean, and then all its blocks stay, short ones as well. Where the page marks an article,
    only blocks inside one are candidates. A form is left out unless an article stands in it or it holds most of the page's text, and so is an element
    whose name says that it is no article text.
    """
    if not html:
        return ""
    parser = Blocks()
    parser.read(html)
    while parser.zone:  # those that the page leaves open
        if parser.zone.above:
            parser.zone.above.chars += parser.zone.chars
        parser.zone = parser.zone.above
    all_chars, out = sum(len(b[0]) for b in parser.blocks), set()
    for zone in parser.zones:  # each after the one around it
        if zone.above in out or not zone.stays(all_chars):
            out.add(zone)
    parser.blocks = [b for b in parser.blocks if b[5] not in out]
    blocks, free = parser.blocks, [b for b in parser.blocks if not b[4]]
    if 2 * sum(len(b[0]) for b in free) >= sum(len(b[0]) for b in blocks):  # else a form holds the page
        blocks = free
    if any(b[3] for b in blocks):
        blocks = [b for b in blocks if b[3]]
    if not blocks:
        return ""
    ratios = smoothed(np.array([len(text) / (tags + 1) for text, tags, *_ in blocks]), sigma)
    runs = np.array([b[2] for b in blocks])
    content = set(runs[ratios >= threshold * ratios.mean()].tolist())
    return "\n".join(b[0] for b in blocks if b[2] in content)


def extract_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns `keep`, then text and n_chars (its code points); a null or empty page has the empty text. One row per row.

    Repeated rows stay, pages of any length are parsed whole and alone if they are long, markup of any kind is read as browsers read it, and
    other columns of pages don't matter, `text` and `n_chars` among them.
    """
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, html):
            texts = pa.array([main_text(x) for x in column(batch, html).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in keep], texts, pc.utf8_length(texts).cast(pa.int64())], [*keep, "text", "n_chars"])

    return pages.select(*keep, html).mapInArrow(run, f"{fields}, text string, n_chars bigint")
