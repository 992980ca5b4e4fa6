"""Main text of web pages as the maximum-scoring subsequence of their words and tags.

A page is read as a sequence of tags and words. Words score positive, tags negative, by weights
learned from labelled pages: those that mark their article themselves (one `article` element).
A token's weight is the logarithm of how much more often its kind stands inside the labelled
regions than outside, bounded and then signed: a word kind is at least slightly positive, a tag
kind at least slightly negative. A single scan keeps the best run of tokens that ends at each
place, and so finds the contiguous region of the greatest sum (Pasternack and Roth, 2009).

Elements that hold no content by their own meaning (scripts, styles, forms, navigation,
footers, asides, hidden parts) and those whose class, id or role says so (adverts, notices,
comments, sidebars) are walls: neither their words nor their tags score or are learned from, and
their text is never part of the result. So a kind that stands outside articles in walls alone, or
that no labelled page holds, tells of no border and is a word or the slightest tag.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import beside_text

SAMPLE_PAGES = 2_000
"""Labelled pages to learn from, at most, taken by a digest of their ids."""
SLIGHT = -0.1
"""The slightest weight of a tag."""

# Fixed values of HTML: elements without an end tag, elements that break a line, and elements whose text is not content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article blockquote body caption center dd details dialog div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
WALL = frozenset(
    "script style noscript template head title form button select option textarea input label fieldset nav footer header aside menu iframe object "
    "svg math canvas audio video dialog".split()
)
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
ENDS_P = BLOCK | frozenset("form nav footer header aside menu fieldset".split())
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|signup|login|comments?|"
    r"respond|disqus|replies|sidebar|side|widget|related|recommended|nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|footer|header|masthead|"
    r"share|sharing|social|toolbar|search|complementary|contentinfo|dialog)(?:$|[\s_-])",
    re.I,
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|$)|"
    r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)|[^<]+|<",
    re.S,
)
"""A comment, a declaration, a tag, a tag with a quote that is never closed (it ends at the next `>`), or text."""
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPACES = re.compile(r"\s+")


@dataclass
class Part:
    """A tag, or the text between two tags."""

    kind: str
    words: int = 0
    text: str = ""
    wall: bool = False
    breaks: bool = False
    inside: bool = False  # of the page's own article element


@dataclass
class Weights:
    of: dict[str, float] = field(default_factory=dict)

    def score(self, part: Part) -> float:
        if part.words:
            return part.words * self.of.get(part.kind, 1.0)
        return self.of.get(part.kind, SLIGHT if self.of else -1.0) if part.kind else 0.0


def _walled(name: str, attributes: str, inside: bool = False) -> bool:
    """Whether an element holds no content. Inside an article a header holds its title, and a text element
    like a paragraph is only believed to be an advert or the like if one of its classes is just that word."""
    if name in WALL and not (inside and name == "header"):
        return True
    if not attributes.strip():
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), entities.unescape(value.strip("\"'"))
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if inside and name in TEXTUAL:
            if key == "class" and any(MARKED.fullmatch(c) for c in value.split()):
                return True
        elif key in ("class", "id", "role") and name not in ("html", "body", "main", "article") and MARKED.search(value):
            return True
    return False


def parse(page: str) -> list[Part]:
    """Tags and texts of a page in order, each with what it stands in. Broken markup is read leniently."""
    parts: list[Part] = []
    stack: list[tuple[str, bool]] = []
    opened: Counter = Counter()  # names on the stack
    walls = articles = at = 0

    def close(name: str) -> None:
        nonlocal walls, articles
        if not opened[name]:
            return
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] == name:
                for other, wall in stack[depth:]:
                    walls -= wall
                    articles -= other == "article"
                    opened[other] -= 1
                del stack[depth:]
                return

    while found := TOKEN.match(page, at):
        at = found.end()
        closing, name, attributes = found.groups()[:3] if found[2] else found.groups()[3:]
        if name is None:
            token = found[0]
            if token[:2] in ("<!", "<?") and len(token) > 1:
                continue
            text = entities.unescape(token)
            words = len(text.split())
            parts.append(Part("w:a" if stack and stack[-1][0] == "a" else "w", words, text, walls > 0, False, articles > 0))
            continue
        name = name.lower()
        block = name in BLOCK or name in ENDS_P or name == "br"
        if closing:
            parts.append(Part("/" + name, 0, "", walls > 0, block, articles > 0))
            if name not in VOID:
                close(name)
            continue
        if name in ENDS_P and opened["p"]:
            close("p")
        wall = _walled(name, attributes, articles > 0)
        parts.append(Part(name, 0, "", walls > 0 or wall, block, articles > 0))
        if name in RAW and not attributes.rstrip().endswith("/"):
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
        if name not in VOID:
            stack.append((name, wall))
            opened[name] += 1
            walls += wall
            articles += name == "article"
    return parts


def region(parts: list[Part], weights: Weights) -> tuple[int, int]:
    """Begin and end of the run of parts with the greatest sum; ties to the earlier and longer. (0, 0) without words."""
    best, span, total, begin = 0.0, (0, 0), 0.0, 0
    for i, part in enumerate(parts):
        value = 0.0 if part.wall else weights.score(part)
        if total <= 0:
            total, begin = 0.0, i
        total += value
        if total > best:
            best, span = total, (begin, i + 1)
    return span


def blocks_text(parts: list[Part]) -> str:
    """The texts of the parts outside walls: white space folded, blocks joined by line feeds."""
    blocks, own = [], []
    for part in [*parts, Part("", breaks=True)]:
        if part.breaks and own:
            blocks.append(SPACES.sub(" ", "".join(own)).strip())
            own = []
        if part.text and not part.wall:
            own.append(part.text)
    return "\n".join(b for b in blocks if b)


def extract(page: str, weights: Weights) -> str:
    """Main text of one page; '' if it has none."""
    parts = parse(page)
    begin, end = region(parts, weights)
    return blocks_text(parts[begin:end])


def tallies(page: str) -> Counter:
    """How often each kind stands inside and outside the article, if the page has exactly one; else nothing.

    Parts in walls count as 0, but their words are outside words of kind ''.
    """
    parts = parse(page)
    if sum(p.kind == "article" for p in parts) != 1:
        return Counter()
    out: Counter = Counter()
    for p in parts:
        out[p.kind, p.inside and not p.wall] += 0 if p.wall else p.words or not p.kind.startswith("w")
        if p.wall:
            out["", False] += p.words
    return out


def learn(df: DataFrame, page_id: str = "page_id", html: str = "html", pages: int = SAMPLE_PAGES) -> Weights:
    """Weights from the pages that label their own article, at most `pages` of them. Without any, words weigh 1 and tags -1."""
    labelled = df.where(F.lower(F.coalesce(html, F.lit(""))).contains("<article")).select(F.col(page_id).alias("id"), F.col(html).alias("html"))
    total = labelled.count()
    if total > pages:
        labelled = labelled.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * pages / total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                total.update(tallies(page))
        keys = list(total)
        columns = [[k for k, _ in keys], [i for _, i in keys], [total[k] for k in keys]]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64()), strict=True)], ["kind", "inside", "n"])

    rows = labelled.select("html").mapInArrow(run, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n"))
    counts = {(r["kind"], r["inside"]): r["n"] for r in rows.orderBy(F.desc("n"), "kind").limit(10_000).collect()}
    inner = sum(n for (k, i), n in counts.items() if i and k.startswith("w")) or 1
    outer = sum(n for (k, i), n in counts.items() if not i and (not k or k.startswith("w"))) or 1
    weights = Weights()
    for kind in {k for k, _ in counts if k}:
        if not counts.get((kind, False)):
            weights.of[kind] = 1.0 if kind.startswith("w") else SLIGHT
            continue
        odds = log((counts.get((kind, True), 0) + 1) / inner) - log((counts.get((kind, False), 0) + 1) / outer)
        weights.of[kind] = min(2.0, max(0.2, 1 + odds / 4)) if kind.startswith("w") else max(-6.0, min(SLIGHT, -2 + odds / 2))
    return weights


def extract_text(df: DataFrame, weights: Weights, html: str = "html", out: str = "main_text", keep: list[str] | None = None) -> DataFrame:
    """Add the main text of every page, '' if it has none; null html counts as empty. A column named like `out` is replaced."""
    keep = [c for c in (keep if keep is not None else df.columns) if c != out]
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = pc.fill_null(batch.column(len(keep)), "")
            for begin in range(0, batch.num_rows, 500):
                texts = [extract(p.as_py(), weights) for p in pages.slice(begin, 500)]
                some = batch.slice(begin, 500)
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(len(keep))), pa.array(texts, type=pa.string())], [*keep, out])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"`{out}` string"])
    return beside_text(df, keep, html).mapInArrow(run, schema)
