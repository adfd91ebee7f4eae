"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, tags get weights, and one linear scan finds
the contiguous region with the highest sum; its text is the article. Contents of comments, scripts, styles
and the like never count. Weights are learned from labelled pages: pages that mark their article with
<article> or <main> say which tags occur inside and which outside of it. A tag weighs its log odds of
standing inside, at most 0, times a scale that is picked on the same sample by how many pages come
out exactly. The sample is bounded: ``sample_pages`` pages, those with the smallest hash of page_id
(documented parameter). Tags that the sample doesn't show have the weight of ``PRIOR``.

In the region, parts that stand in an element that isn't article text are left out: navigation, forms and the like by
element, others by the words of class, id and role. Which words those are is learned from the same sample: words that
occur on ``LEAST_PAGES`` labelled pages or more and always outside of the article, or never so, are settled by that; only for words
that the sample doesn't settle does the list ``PRIOR_WORDS`` speak. A <header> inside the article is part of it.
Block tags end a block; white space inside a block becomes one space; empty blocks go; blocks are joined by a newline.
Character references are decoded. End tags close what is still open inside their element. A script or style that isn't
closed runs to the end of the page; any other missing end tag (</head>, </title>, </svg> ...) hides no text beyond its own.

Time is linear in the page: tags are cut out by searches that only move forward, and once a quote has run to the end of the
page, tags end at the next ">".

Null or empty html and pages without words give "". Ties go to the region that ends first, of words that
score as much. Repeated rows are returned as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 300
#: Longer pages are left out of the sample, so that it has a bound in bytes.
SAMPLE_CHARS = 500_000
LEAST_PAGES = 3
SCALES = (0.5, 2.0, 8.0, 32.0, 128.0)

# Element names of HTML by their role.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li link main menu meta nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
RAW = frozenset("script style".split())
HIDDEN = RAW | frozenset("noscript template svg math iframe object title select textarea button".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ASIDE_TAGS = frozenset("nav footer aside form header menu dialog".split())
PRIOR_WORDS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies footer header menu nav navbar newsletter notice popup promo related share sidebar social sponsor sponsored subscribe widget".split()
)
PRIOR = {"nav": -6.0, "footer": -6.0, "aside": -6.0, "form": -6.0, "header": -3.0, "article": -3.0, "main": -3.0, "li": -1.0, "a": -1.0, "ul": -1.0, "div": -1.0, "td": -1.0, "hgroup": 0.0}

NAME = re.compile(r"[A-Za-z][A-Za-z0-9:-]*")
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
QUOTE_OR_END = re.compile("[>\"']")
WORDS = re.compile(r"[^\s_-]+")
SPACE = re.compile(r"\s+")
_LOWER = {i: i + 32 for i in range(65, 91)}


@dataclass
class Weights:
    tags: dict[str, float] = field(default_factory=dict)
    scale: float = 8.0
    #: Words of class, id and role that the sample settles: True if they mark what isn't article text.
    words: dict[str, bool] = field(default_factory=dict)

    def of(self, name: str) -> float:
        return self.scale * self.tags.get(name, PRIOR.get(name.split(".")[0].lstrip("/"), -0.5))

    def is_aside(self, name: str) -> bool:
        tag, _, words = name.partition(".")
        return tag in ASIDE_TAGS or any(self.words.get(w, w in PRIOR_WORDS) for w in words_of(words))


def words_of(names: str) -> set[str]:
    return set(WORDS.findall(names.lower()))


def parts(page: str) -> list[tuple[str, str, str]]:
    """(kind, name, text): kind "w" for text, "t" for a tag; name of a tag with its class words, "/" before an end tag's.

    A <header> inside <article> or <main> holds the article's headings and goes by the name of hgroup.
    """
    out: list[tuple[str, str, str]] = []
    low, n = page.translate(_LOWER), len(page)  # as long as page
    at, strict, within = 0, True, 0
    closed = dict.fromkeys(HIDDEN, True)  # whether an end tag of this name may still follow

    def tag_end(i: int) -> int:
        """Where the tag ends that goes on at i, -1 if nowhere."""
        nonlocal strict
        if strict:
            k = i
            while m := QUOTE_OR_END.search(page, k):
                if m[0] == ">":
                    return m.start()
                k = page.find(m[0], m.end()) + 1
                if not k:
                    break
            strict = False
        return page.find(">", i)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            out.append(("w", "", page[at:]))
            break
        m = NAME.match(page, lt + 2 if page.startswith("/", lt + 1) else lt + 1)
        if m is None and not page.startswith(("!", "?"), lt + 1):  # a sign, not a tag
            out.append(("w", "", page[at : lt + 1]))
            at = lt + 1
            continue
        if lt > at:
            out.append(("w", "", page[at:lt]))
        if m is None:
            close = "-->" if page.startswith("<!--", lt) else ">"
            end = page.find(close, lt + 2)
            at = n if end < 0 else end + len(close)
            continue
        name, end = low[m.start() : m.end()], tag_end(m.end())
        if end < 0:
            break
        at = end + 1
        if name in ("article", "main"):
            within = max(0, within - 1) if page[lt + 1] == "/" else within + 1
        elif name == "header" and within:
            name = "hgroup"
        if page[lt + 1] == "/":
            out.append(("t", f"/{name}", ""))
            continue
        if name in HIDDEN and not page.startswith("/", end - 1):
            close = low.find(f"</{name}", at) if closed[name] else -1
            closed[name] = close >= 0
            if close >= 0:
                end = page.find(">", close)
                at = n if end < 0 else end + 1
                continue
            if name in RAW:
                break
        words = " ".join("".join(x) for x in NAMED.findall(page, m.end(), end)) if end > m.end() else ""
        out.append(("t", f"{name}.{words}" if words else name, ""))
    return out


def best_region(items: list[tuple[str, str, str]], weights: Weights) -> tuple[int, int]:
    """[start, end) of the maximum-scoring contiguous run of items; (0, 0) if nothing scores above 0."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, (kind, name, text) in enumerate(items):
        if total <= 0:
            total, start = 0.0, i
        total += len(text.split()) if kind == "w" else weights.of(name)
        if total > best or (total == best and region[0] == start and best > 0):
            best, region = total, (start, i + 1)
    return region


def blocks(items: list[tuple[str, str, str]], start: int, end: int, weights: Weights) -> str:
    """The text of items start to end outside of asides, block by block."""
    out: list[str] = []
    held: list[str] = []
    open_: list[str] = []  # elements that aren't closed, from the page's start
    count: Counter[str] = Counter()
    aside = -1  # how many were open when the aside began

    def flush() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(held))).strip()
        held.clear()
        if text:
            out.append(text)

    for i in range(end):
        kind, name, text = items[i]
        if kind == "w":
            if aside < 0 and i >= start:
                held.append(text)
            continue
        tag = name.lstrip("/").partition(".")[0]
        if tag in BLOCKS:
            flush()
        if name[0] == "/":
            if count[tag]:
                while True:
                    last = open_.pop()
                    count[last] -= 1
                    if last == tag:
                        break
                if len(open_) <= aside:
                    aside = -1
        elif tag not in VOID:
            if i >= start and aside < 0 and weights.is_aside(name):
                aside = len(open_)
            open_.append(tag)
            count[tag] += 1
    flush()
    return "\n".join(out)


def extract(page: str | None, weights: Weights) -> str:
    if not page:
        return ""
    items = parts(page)
    return blocks(items, *best_region(items, weights), weights)


def labelled(items: list[tuple[str, str, str]]) -> tuple[int, int] | None:
    """The items inside the page's one <article> (or <main>), or None."""
    for tag in ("article", "main"):
        opens = [i for i, x in enumerate(items) if x[0] == "t" and x[1].partition(".")[0] == tag]
        ends = [i for i, x in enumerate(items) if x[1] == f"/{tag}"]
        if len(opens) == 1 and ends and ends[-1] > opens[0]:
            return opens[0] + 1, ends[-1]
    return None


def learn(pages: list[str]) -> Weights:
    """Weights and scale from labelled pages; those of PRIOR if there are none."""
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    known = []
    pages_in: Counter[str] = Counter()
    pages_out: Counter[str] = Counter()
    for page in pages:
        items = parts(page)
        if found := labelled(items):
            known.append((items, found))
            seen: tuple[set[str], set[str]] = set(), set()
            for i, (kind, name, _) in enumerate(items):
                if kind == "t":
                    within = found[0] <= i < found[1]
                    (inside if within else outside)[name] += 1
                    seen[within].update(words_of(name.partition(".")[2]))
            pages_out.update(seen[False])
            pages_in.update(seen[True])
    if not known:
        return Weights()
    tags = {x: min(0.0, math.log((inside[x] + 0.5) / (outside[x] + 0.5))) for x in inside.keys() | outside.keys()}
    words = {w: not pages_in[w] for w in pages_in.keys() | pages_out.keys() if pages_in[w] + pages_out[w] >= LEAST_PAGES and not (pages_in[w] and pages_out[w])}
    right = [
        (sum(blocks(items, *best_region(items, w), w) == blocks(items, *found, w) for items, found in known), w)
        for w in (Weights(tags, s, words) for s in SCALES)
    ]
    return max(right, key=lambda x: x[0])[1]


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Weights:
    """Learn from the sample_pages pages with the smallest hashes of page_id; only their html comes to the driver."""
    known = pages.filter(F.length("html") <= SAMPLE_CHARS).withColumn("h", F.xxhash64("page_id"))
    smallest = known.select("h").orderBy("h").limit(sample_pages).agg(F.max("h")).head()[0]
    if smallest is None:
        return Weights()
    return learn([r["html"] for r in known.filter(F.col("h") <= smallest).orderBy("h", "page_id").select("html").limit(sample_pages).collect()])


def main_text(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py(), weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(work, "page_id long, url string, text string, n_chars long")
