"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass classifies each block on its own by the share
of stop words, its length and the share of its text in links; text in menus, footers, adverts and the like is bad
wherever it stands. Stop words only decide on pages whose language the list knows; elsewhere length and links do. Names count as a whole (class, id or role), not on the body, and an article or main element inside an element
that is outside by its name alone starts the main text again, unless it is itself named so or within another article, as
comments are. Inside of an article only lists of links are bad for their links. The second pass lets undecided short blocks take the label of the nearest decided
neighbours of their container (headings that of what follows), and of the container itself where nothing in it is decided. Beside an article of some
length nothing else is main text; on a page without any good block, undecided ones are.

Defined cases: null or empty html gives an empty text; unclosed, stray and cut-off tags are tolerated; repeated
rows are treated alike; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from txnwatch.llm.shared import same_columns

# Common function words of four languages.
STOP_WORDS = frozenset(
    """
    the of and to in is that it was for on are with as be at this have from or an a by not he they you which his her
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er sie aus bei nach
    de la le et les des en un du une que est pour qui dans par plus pas au sur ce il elle ne se
    el y los del las por con no su al lo más o este sí ya para como una
    """.split()
)
SKIP = frozenset("script style noscript template textarea select title svg math iframe object".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead"
    " tr ul".split()
)
# Elements that hold other blocks; the others end without being tracked.
HOLD = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol section table ul head".split())
ITEMS = frozenset("li dd dt td th option".split())
OUTSIDE = frozenset("aside footer form menu nav dialog fieldset head".split())
MAIN = frozenset(["article", "main"])
# A whole class, id or role; in compounds every part has to be such a word or a plain addition, so that has-sidebar,
# no-ads and share-price name nothing.
_WORD = (
    r"(?:ads?|adsbygoogle|advert[a-z0-9]*|alerts?|announcements?|banner|copyright|dfp|disclaimer|disqus|gdpr|login|pagination|pager|search|signin|breadcrumbs?|comments?|cookies?|consent|footer|masthead|menu|modal|nav[a-z0-9]*|newsletter|notices?|popup|"
    r"promo[a-z0-9]*|recommend[a-z0-9]*|related|reply|replies|respond|share|sharing|sidebar|social|sponsor[a-z0-9]*|subscribe|toolbar|widget)"
)
_ADDED = r"(?:article|reader|readers|user|users|section|google|thread|site|page|main|primary|secondary|global|top|bottom|box|bar|list|links?|buttons?|container|wrapper|area|block|slot|unit|posts?|items?|form|signup|inner|[0-9]+)"
NAMED_OUTSIDE = re.compile(rf"(?:^|\s)(?:comment[_-][\w-]+|(?:{_ADDED}[_-]+)*{_WORD}(?:[_-]+(?:{_WORD}|{_ADDED}))*)(?:$|\s)")
# Outside as well, but not within an article, whose header belongs to it.
NAMED_HEADER = re.compile(rf"(?:^|\s)(?:{_ADDED}[_-]+)*header(?:[_-]+{_ADDED})*(?:$|\s)")
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</?([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)",
    re.S,
)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I | re.S)


@dataclass(frozen=True)
class BlockRules:
    """Bounds of the block rules; lengths in characters."""

    links: float = 0.5  # more text in links is bad
    short: int = 70  # shorter blocks are undecided
    long: int = 140  # longer ones with enough stop words are good
    stop_low: float = 0.05
    stop_high: float = 0.12


@dataclass
class Block:
    container: int  # number of the innermost article or main element; 0: none
    outside: bool
    heading: bool = False
    item: bool = False  # of a list or table
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def cut_blocks(html: str) -> Iterator[Block]:
    """The blocks with text, in page order."""
    # Tag, is it outside the main text, its article, is it outside only by name and not within an article element.
    stack: list[tuple[str, bool, int, bool]] = []
    articles = link = at = 0
    block = Block(0, False)

    def done() -> Iterator[Block]:
        block.text = " ".join(unescape("".join(block.parts)).split())
        if block.text:
            yield block

    while True:
        found = TOKEN.search(html, at)
        part = html[at : found.start() if found else len(html)]
        if part:
            block.parts.append(part)
            if link:
                block.linked += len("".join(unescape(part).split()))
        if not found:
            break
        at = found.end()
        tag = (found[1] or "").lower()
        if not tag:
            if found[0].startswith("<![CDATA["):
                block.parts.append(found[0][9:].removesuffix("]]>"))
            continue
        closing = found[0].startswith("</")
        if tag in SKIP:
            if not closing and not found[0].endswith("/>"):
                end = re.compile(rf"</{tag}\s*(?:>|$)", re.I).search(html, at)
                at = end.end() if end else len(html)
            block.parts.append(" ")
            continue
        if tag == "a":
            link = int(not closing)
            continue
        if tag == "br":
            block.parts.append(" ")
            continue
        if tag not in BLOCK:
            continue
        yield from done()
        link = 0
        if tag in HOLD and closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag in HOLD and not found[0].endswith("/>"):
            outside, article, merely = stack[-1][1:] if stack else (False, 0, False)
            names = " ".join("".join(x) for x in NAMES.findall(found[2] or "")).lower()
            named = bool(names) and tag != "body" and bool(NAMED_OUTSIDE.search(names) or (not article and NAMED_HEADER.search(names)))
            if tag in MAIN and (not outside or (merely and not named)):
                articles += 1
                outside, article, merely = False, articles, False
            elif tag in OUTSIDE or (tag == "header" and not article):
                outside, merely = True, False
            elif named and not outside:
                outside, merely = True, all(x[0] != "article" for x in stack)
            stack.append((tag, outside, article, merely))
        outside, article = stack[-1][1:3] if stack else (False, 0)
        block = Block(article, outside, tag in ("h1", "h2", "h3", "h4", "h5", "h6") and not closing, tag in ITEMS and not closing)
    yield from done()


def stop_share(text: str) -> tuple[int, int]:
    """Stop words and words of a text."""
    words = text.lower().split()
    return sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words), len(words)


def first_pass(block: Block, rules: BlockRules, known: bool = True) -> str:
    """good, bad or short (undecided), from the block alone. ``known`` says whether stop words tell anything here."""
    if block.outside:
        return "bad"
    length = len(block.text)
    if block.linked > rules.links * len("".join(block.text.split())):
        return "short" if block.container and not block.item else "bad"
    if block.heading or length < rules.short:
        return "short"
    stops, words = stop_share(block.text)
    share = stops / words if known else 1.0
    if share >= rules.stop_high:
        return "good" if length >= rules.long or block.container else "short"
    return "short" if share >= rules.stop_low or block.container else "bad"


def knows_language(found: list[Block], rules: BlockRules) -> bool:
    """Whether the page's longer texts have a usual share of stop words, so that their absence means something."""
    counts = [stop_share(b.text) for b in found if not b.outside and len(b.text) >= rules.short]
    return sum(s for s, _ in counts) >= rules.stop_low * sum(n for _, n in counts)


def main_text(html: str | None, rules: BlockRules = BlockRules()) -> str:
    """The good blocks, one per line."""
    found = list(cut_blocks(html or ""))
    known = knows_language(found, rules)
    labels = [first_pass(b, rules, known) for b in found]
    # A page with an article of some length has its main text there.
    if sum(len(b.text) for b in found if b.container and not b.outside) >= rules.long:
        labels = [label if b.container else "bad" for b, label in zip(found, labels, strict=True)]
    nothing = "good" not in labels
    # Nearest decided label of the same container, seen from both sides.
    sides = []
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        last: dict[int, str] = {}
        near = [""] * len(found)
        for k in order:
            here = found[k].container
            near[k] = last.get(here, "")
            if labels[k] != "short" and not (here and found[k].outside):
                last[here] = labels[k]
        sides.append(near)
    out = []
    for block, label, left, right in zip(found, labels, *sides, strict=True):
        if label == "short":
            default = "good" if block.container or (nothing and any(c.isalnum() for c in block.text)) else "bad"
            label = "good" if "good" == (left or right or default) and "bad" != (right or left or default) else "bad"
            if block.container and "good" in (left, right):
                label = "good"
            if block.heading and not block.container:
                # A heading belongs to what follows.
                label = right or left or default
        if label == "good":
            out.append(block.text)
    return "\n".join(out)


def extract(pages: DataFrame, rules: BlockRules = BlockRules()) -> DataFrame:
    """One row per page: page_id, url, text and n_chars, its code points."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [main_text(h, rules) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array(rows, pa.string()), pa.array(map(len, rows), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return same_columns(pages, ["page_id", "url", "html"]).mapInArrow(run, "page_id long, url string, text string, n_chars long")
