"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags.  The first pass decides blocks by themselves: blocks in menus, headers,
footers, sidebars, notices, adverts, forms and comments, and blocks that are mostly links, are boilerplate; long blocks
with few links and the stop words of prose are text.  What is left, short blocks above all, inherits in the second pass
from the nearest decided blocks before and after it in the same part of the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

LONG_WORDS = 20                 # a block of so many words can be decided by its stop words
STOP_SHARE = 0.25               # of prose at least
NO_PROSE = 0.1                  # a long block with a lower share is decided against
LINK_SHARE, LINK_SHARE_INSIDE = 0.2, 0.5

# Tags of HTML.
BLOCK_TAGS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot
th thead tr ul""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())
BAD_TAGS = frozenset("head nav footer aside form dialog menu button select noscript template svg math object canvas audio video label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")),
          "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
# Names that authors give to parts of pages.
BAD_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar side aside rail nav navbar navigation menu
breadcrumb breadcrumbs header masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription
signup login register form search comment comments commentlist discussion disqus respond reply replies share sharing social related recommended
recommendations toolbar widget widgets skip copyright pagination pager outbrain taboola""".split())
GOOD_NAMES = frozenset("""article articlebody content maincontent main post postcontent postbody entry entrycontent story storybody bodytext""".split())
GOOD_ENDS = frozenset("content body text".split())
WITHOUT = frozenset("with has no without not".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
# Frequent function words.
STOP_WORDS = {
    "en": "the of and to in is that it for was on are as with be at by this have from or an not but they his he which you we were their has will what all can if who",
    "de": "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie",
    "fr": "le la les de des du un une et en à est que qui dans pour pas sur au avec ce il elle plus par ne se sont ou mais nous vous leur ses son sa aux",
    "es": "el la los las de del un una y en que es por con para no se su al lo como más o pero sus le ha me si sin sobre este ya entre cuando son",
    "it": "il di che e la in un per è non del una si con",
    "pt": "o de que e do da em um para é não uma os com",
    "nl": "de het een en van in is dat op te zijn voor met die",
}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
WORD = re.compile(r"[^\W\d_]+")
BAD, GOOD, OPEN = -1, 1, 0
_stops: dict[str, int] = {}


def stops() -> dict[str, int]:
    """Languages of each function word, as bits."""
    if not _stops:
        for k, own in enumerate(STOP_WORDS.values()):
            for w in own.split():
                _stops[w] = _stops.get(w, 0) | 1 << k
    return _stops


@dataclass
class Block:
    text: str
    linked: int         # characters in links
    bad: bool           # inside a part that is no article
    region: int         # number of the article part, 0 outside
    heading: bool
    label: int = OPEN
    prose: bool = False


def named(attributes: str) -> tuple[bool, bool]:
    """(names a part that is no article, names an article), by class, id and role."""
    bad = good = False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if key == "role":
            role = value.strip().lower()
            bad, good = bad or role in BAD_ROLES, good or role in ("main", "article")
        elif key == "itemprop":
            good |= value.strip().lower() == "articlebody"
        elif key == "hidden":
            bad = True
        elif key == "aria-hidden":
            bad |= value.strip().lower() == "true"
        elif key == "style":
            bad |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        else:
            for name in value.split():
                parts = [p.lower() for p in NAME_PARTS.findall(name)]
                if not parts or WITHOUT & set(parts):
                    continue
                if parts[0] in BAD_NAMES or parts[-1] in BAD_NAMES:
                    bad = True
                elif "".join(parts) in GOOD_NAMES or parts[0] in ("article", "post", "entry", "story", "main") and parts[-1] in GOOD_ENDS:
                    good = True
    return bad, good and not bad


def blocks_of(page: str) -> list[Block]:
    """Blocks of a page in order, texts decoded, white space folded, empty ones left out."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, bool]] = [("", False, 0, False)]      # tag, inside a bad part, article part, inside a link
    open_tags: Counter = Counter()
    pieces: list[str] = []
    linked = regions = 0
    breaks = 0

    def flush() -> None:
        nonlocal linked, breaks
        text = " ".join("".join(pieces).split())
        if text:
            tag, bad, region, _ = stack[-1]
            out.append(Block(text, linked, bad, region, bool(open_tags) and any(open_tags[h] for h in HEADINGS)))
        pieces.clear()
        linked = breaks = 0

    def pop() -> None:
        open_tags[stack.pop()[0]] -= 1

    def say(raw: str) -> None:
        nonlocal linked, breaks
        text = html.unescape(raw) if "&" in raw else raw
        if breaks >= 2 and text.strip():
            flush()
        if text.strip():
            breaks = 0
        pieces.append(text)
        if stack[-1][3]:
            linked += len("".join(text.split()))

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at:m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag == "br":
            pieces.append(" ")
            breaks += 1
            continue
        if tag in BLOCK_TAGS:
            flush()
        if closing:
            if open_tags[tag] > 0:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in RAW_TAGS:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|</{tag}\Z", re.I).search(page, at)
            at = stop.end() if stop else end
            pieces.append(" " if tag in ("textarea", "iframe") else "")
            continue
        if tag in VOID_TAGS:
            continue
        if tag in BLOCK_TAGS:
            while len(stack) > 1 and open_tags["p"] > 0 and tag not in ("body", "html") and not any(x in BLOCK_TAGS and x != "p" for x, *_ in stack[-1:]):
                top = stack[-1][0]
                pop()
                if top == "p":
                    break
        if tag in CLOSES:
            ends, within = CLOSES[tag]
            for k in range(len(stack) - 1, max(0, len(stack) - 40), -1):
                if stack[k][0] in within:
                    break
                if stack[k][0] in ends.split():
                    while len(stack) > k:
                        pop()
                    break
        _, bad, region, link = stack[-1]
        own_bad, own_good = named(attributes) if attributes and tag not in ("html", "body") else (False, False)
        if tag in ("article", "main"):
            own_bad, own_good = own_bad and tag == "article", True
        if tag in BAD_TAGS or tag == "header" and not region or own_bad:
            bad = True
        elif own_good and not bad and not region:
            regions += 1
            region = regions
        stack.append((tag, bad, region, link or tag == "a"))
        open_tags[tag] += 1
    flush()
    return out


def label(blocks: list[Block]) -> None:
    """Both passes over the blocks of a page."""
    known = stops()
    hits = [0] * len(STOP_WORDS)
    found: list[tuple[int, list[int]]] = []
    for b in blocks:
        words = [] if b.bad else WORD.findall(b.text.lower())
        masks = [known[w] for w in words if w in known]
        found.append((len(words), masks))
        for m in masks:
            k = 0
            while m:
                hits[k] += m & 1
                m >>= 1
                k += 1
    language = 1 << max(range(len(hits)), key=hits.__getitem__)
    for b, (n, masks) in zip(blocks, found):
        share = sum(1 for m in masks if m & language) / max(n, 1)
        links = b.linked / max(1, len(b.text.replace(" ", "")))
        b.prose = share >= STOP_SHARE
        if b.bad or links > (LINK_SHARE_INSIDE if b.region else LINK_SHARE):
            b.label = BAD
        elif n >= LONG_WORDS and b.prose and not b.heading:
            b.label = GOOD
        elif n >= 2 * LONG_WORDS and share < NO_PROSE and not b.region:
            b.label = BAD
    inside = {b.region for b in blocks if b.region and not b.bad}
    for region in {0, *inside}:
        own = [b for b in blocks if b.region == region and not b.bad]
        if region == 0 and inside:
            for b in own:                                   # the page says where its article is
                b.label = BAD
            continue
        decided = [b.label for b in own]
        after: list[tuple[int, int]] = [(OPEN, 0)] * len(own)
        near = (OPEN, 0)
        for k in range(len(own) - 1, -1, -1):
            after[k] = near
            near = (decided[k], k) if decided[k] else near
        before = (OPEN, 0)
        for k, b in enumerate(own):
            if decided[k]:
                before = (decided[k], k)
                continue
            (left, i), (right, j) = before, after[k]
            if left == right:
                b.label = left or GOOD                      # nothing decided here: the part itself is the article
            elif not left or not right:
                b.label = left or right
            elif b.heading:
                b.label = right                             # a heading goes with what it heads
            elif k - i != j - k:
                b.label = left if k - i < j - k else right
            else:
                b.label = GOOD if b.prose else BAD


def main_text(page: str | None) -> str:
    """Blocks labelled as text, joined by line feeds."""
    blocks = blocks_of(page or "")
    label(blocks)
    return "\n".join(b.text for b in blocks if b.label == GOOD)


def extract(df: DataFrame, column: str = "html") -> DataFrame:
    """Columns of ``df`` but the page, plus ``text``, the main text of the whole page.

    Character references are decoded, white space inside a block (Unicode's) is one blank, blocks come in page order,
    parted by one line feed; a page without main text, an empty or a null one has an empty text.  Equal rows have equal
    results; an empty table gives an empty table; an input column named ``text`` that is not the page is replaced.
    """
    carried = [c for c in df.columns if c not in (column, "text")]
    own = df.select(*(F.col(f"`{c}`") for c in carried), F.col(f"`{column}`").alias("_page to read"))
    schema = T.StructType([*df.select(*(F.col(f"`{c}`") for c in carried)).schema.fields, T.StructField("text", T.StringType())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_page to read"):
                texts = pa.array([main_text(p) for p in part.column("_page to read").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(carried))), texts], [*carried, "text"])

    return own.mapInArrow(go, schema)
