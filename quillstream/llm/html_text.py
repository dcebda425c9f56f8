"""Main text of web pages by nearest-URL page differencing.

Pages are ordered by URL path within their host, and each is held against the page before and after it.
The text lines of two pages are aligned by longest common subsequence, and the lines they share go. A line of
page furniture (inside a menu, footer, advert, form and so on) is compared by its place in the page's
structure, as its words often differ from page to page; every other line by its words.

Differencing alone can't give right results: neighbours may carry the same article or passage, or furniture in a
place of its own. So shared running text of an article (paragraphs, headings, lists, quotes, tables) stays, while
other boxes in it go if shared; without an article, running text goes if shared, unless nearly all of it is, as in
a copy; and furniture goes where no neighbour shares it, too.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stash, text_key

# fixed values: names of HTML elements
_RAW = frozenset(("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "title", "textarea", "xmp"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
_INLINE = frozenset((
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
    "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
))
_FURNITURE = frozenset(("nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "head"))
_ROOT = frozenset(("article", "main"))
#: Elements whose text is an article's own, even where a neighbour has the same.
_RUNNING = frozenset((
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "td", "th", "caption", "figcaption", "article", "main",
))
_WORDS = (
    r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|masthead|menu|modal|nav(?:bar|igation)?|newsletter|notice|pagination|"
    r"popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|teaser|toolbar|widget)"
)
#: Whole class names and ids: the word, a word at a name's end ("site-footer"), or a part of furniture ("comment-list"), but no state ("has-sidebar", "comments-open").
_FURNITURE_NAME = re.compile(
    rf"(?!(?:has|no|not|with|without|is|show|hide)[-_])(?:[a-z0-9]+[-_]{{1,2}})*{_WORDS}(?:[-_]{{1,2}}(?:\d+|area|bar|block|body|box|container|content|footer|form|group|header|inner|item|left|links?|list|menu|right|section|slot|text|thread|title|top|wrap(?:per)?))*",
    re.I,
)
_FURNITURE_ROLES = frozenset(("navigation", "banner", "contentinfo", "search", "complementary", "dialog", "alert", "menu", "menubar", "form"))

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_BLANK = re.compile(r"\s+")
#: Where this share of a page's running text is shared with a neighbour, the neighbour is a copy and its text no furniture.
COPY_SHARE = 0.8


@dataclass
class Line:
    text: str
    place: int  # a hash of the names of the elements around it
    furniture: bool
    root: bool  # inside an article or main element
    running: bool  # directly in an element of running text

    @property
    def key(self) -> int:
        return self.place if self.furniture else hash_text(self.text)


def hash_text(text: str) -> int:
    """A 64-bit hash that is the same in every process."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """The page as ("", text, ""), ("<", name, attributes) and ("/", name, "") in turn, in one pass whatever the markup: comments
    and declarations are left out, a '>' inside quotes doesn't end a tag, and what no '>' ends is text."""
    at, text, size = 0, 0, len(page)
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            begin, at, kind, name, attributes = at, size if end < 0 else end + 3, "", "", ""
        else:
            found = _NAME.match(page, at + 1)
            if not found and not page.startswith(("<!", "<?"), at):
                at += 1
                continue
            end = page.find(">", at)
            if end < 0:
                break
            begin, after = at, found.end() if found else at
            quote, seen = "", after
            while found:  # an open quote before the '>' carries on to its own end
                for c in _QUOTES.findall(page, seen, end):
                    quote = "" if c == quote else quote or c
                close = page.find(quote, end) if quote else -1
                further = page.find(">", close) if close >= 0 else -1
                if further < 0:
                    break
                quote, seen, end = "", close + 1, further
            at, kind, name, attributes = end + 1, "/" if found and found[1] else "<", found[2].lower() if found else "", page[after:end]
        if begin > text:
            yield "", page[text:begin], ""
        text = at
        if not name:
            continue
        yield kind, name, attributes
        if kind == "<" and name in _RAW and not attributes.endswith("/"):
            end = _raw_end(name).search(page, at)
            text = at = end.end() if end else size
    if text < size:
        yield "", page[text:], ""


_QUOTES = re.compile("[\"']")


@cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?:>|[\s/][^>]*>|[\s/][^>]*\Z)", re.I)


class _Element(NamedTuple):
    name: str
    place: int
    furniture: bool  # by an element's kind, here or around it
    named: tuple[int, ...]  # the elements here and around that have a name of furniture
    root: bool


def lines_of(page: str) -> list[Line]:
    """The page's text lines: blocks with character references decoded and white space squeezed."""
    found: list[tuple[str, _Element]] = []
    parts: list[str] = []
    top = _Element("", 0, False, (), False)
    stack: list[_Element] = []
    open_names: Counter[str] = Counter()
    holders: set[int] = set()  # named elements that are an article or main element, or hold one
    serial = 0

    def flush() -> None:
        text = _BLANK.sub(" ", html.unescape("".join(parts))).strip() if parts else ""
        parts.clear()
        if text:
            found.append((text, stack[-1] if stack else top))

    def pop() -> None:
        open_names[stack.pop().name] -= 1

    for kind, name, attributes in tokens(page):
        if not kind:
            parts.append(name)
            continue
        if name in _INLINE or name in _RAW:
            continue
        flush()
        if name in _VOID:
            continue
        if kind == "/":
            while open_names[name] > 0:
                done = stack[-1].name == name
                pop()
                if done:
                    break
            continue
        if name == "body":
            stack.clear()
            open_names.clear()
        if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1].name == name:
            pop()  # its end tag may be left out
        above = stack[-1] if stack else top
        named = above.named
        if len(named) < NESTED and _named_furniture(name, attributes):
            serial += 1
            named = (*named, serial)
        if name in _ROOT:
            holders.update(named)
        furniture = above.furniture or name in _FURNITURE or (name == "header" and not above.root)
        stack.append(_Element(name, hash_text(f"{above.place}/{name}"), furniture, named, above.root or name in _ROOT))
        open_names[name] += 1
    flush()
    # names are believed of what holds an article only where another article is left
    if any(e.root and not e.furniture and not e.named for _, e in found):
        holders.clear()
    return [Line(t, e.place, e.furniture or any(n not in holders for n in e.named), e.root, e.name in _RUNNING) for t, e in found]


#: Named elements inside each other that are told apart.
NESTED = 8


def _named_furniture(name: str, attributes: str) -> bool:
    if not attributes or name in ("body", "html"):
        return False
    for kind, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if value.lower() in _FURNITURE_ROLES if kind.lower() == "role" else any(len(x) <= 64 and _FURNITURE_NAME.fullmatch(x) for x in value.split()):
            return True
    return False


#: A table of so many bits is held to trace a longest common subsequence; longer pairs of pages are halved first.
TRACE_BITS = 16_000_000


def common(a: Sequence[int], b: Sequence[int]) -> set[int]:
    """The places in a of a longest common subsequence of a and b, by bit vectors; memory grows with the lines, not with their square."""
    out: set[int] = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.add(a0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.add(a1)
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1 or (a1 - a0) * (b1 - b0) <= TRACE_BITS:
            out.update(a0 + i for i in _trace(a[a0:a1], b[b0:b1]))
            continue
        middle = (a0 + a1) // 2  # where b is best cut: the lengths of both halves' prefixes and suffixes
        before = _lengths(a[a0:middle], b[b0:b1])
        after = _lengths(a[middle:a1][::-1], b[b0:b1][::-1])[::-1]
        cut = b0 + int((before + after).argmax())
        todo += [(a0, middle, b0, cut), (middle, a1, cut, b1)]
    return out


def _rows(a: Sequence[int], b: Sequence[int]) -> Iterator[int]:
    """After each line of a: a bit for every line of b, 0 where the common subsequence grows by one."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    row = full = (1 << len(b)) - 1
    yield row
    for x in a:
        if x in places:
            match = row & places[x]
            row = ((row + match) | (row - match)) & full
        yield row


def _lengths(a: Sequence[int], b: Sequence[int]) -> np.ndarray:
    """The length of a longest common subsequence of a with each prefix of b."""
    *_, row = _rows(a, b)
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _trace(a: Sequence[int], b: Sequence[int]) -> set[int]:
    rows = list(_rows(a, b))
    length = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()
    out, i, j = set(), len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.add(i)
        elif length(i - 1, j) == length(i, j):
            i -= 1
        else:
            j -= 1
    return out


def main_text(lines: list[Line], neighbours: list[Sequence[int]]) -> str:
    """What is left of a page when what it shares with its neighbours has gone."""
    keys = [line.key for line in lines]
    rooted = any(line.root and not line.furniture for line in lines)
    own = [i for i, line in enumerate(lines) if not line.furniture and line.root == rooted]
    shared: set[int] = set()
    for other in neighbours:
        found = common(keys, other)
        copy = sum(i in found for i in own) > COPY_SHARE * len(own)
        shared |= {i for i in found if lines[i].furniture or not (copy or (lines[i].root and lines[i].running))}
    return "\n".join(line.text for i, line in enumerate(lines) if i not in shared and not line.furniture and (line.root or not rooted))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [[line.key for line in lines_of(x)] if x else [] for x in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(keys, pa.list_(pa.int64()))], names=["page_id", "url", "key", "lines"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages deflated, as they are about to be shuffled: to half of what Spark's own block compression leaves."""
    for batch in batches:
        packed = [zlib.compress(x.encode("utf-8", "surrogatepass"), 6) if x else None for x in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], names=["page_id", "url", "key", "packed"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))
        texts = []
        for packed, before, after in rows:
            page = zlib.decompress(packed).decode("utf-8", "surrogatepass") if packed else ""
            texts.append(main_text(lines_of(page), [x for x in (before, after) if x]) if page else "")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): one row for each row of pages(page_id, url, html).

    text: the main text's blocks in page order, joined by one newline; n_chars its code points. A null
    or empty page gives an empty text. Pages without a URL share the host ''; a host's only page is
    cleaned of furniture alone. Pages with one path are neighbours in the order of url, then page_id, then
    a hash of the page; rows that have all of these in common are one page among the neighbours, and get
    the same text. An empty table gives no rows; extra columns aren't read.

    A page's rank in its host is counted in two levels, within ranges and over them, and neighbours meet
    on (host, rank), so no host is ever in one task.
    """
    pages = small_batches(pages).select(F.col("page_id").cast("long"), "url", text_key("html").alias("key"), "html")
    address = F.coalesce("url", F.lit(""))
    split = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)"
    keyed = stash(pages.mapInArrow(_keys, "page_id long, url string, key long, lines array<long>"), "page-lines")
    order = ["host", "path", "url", "page_id", "key"]
    identity = ["page_id", "same", "key"]  # same: the url, "" for null
    named = keyed.select("page_id", "url", "key", address.alias("same"), F.lower(F.regexp_extract(address, split, 1)).alias("host"), F.regexp_extract(address, split, 2).alias("path"))
    named = named.dropDuplicates(identity)
    ranged = stash(named.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()), "page-order")
    inside = F.row_number().over(Window.partitionBy("host", "range").orderBy(*order))
    before = Window.partitionBy("host").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("host", "range").agg(F.count(F.lit(1)).alias("n")).select("host", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = ranged.withColumn("inside", inside).join(offsets, ["host", "range"]).select(*identity, "host", (F.col("offset") + F.col("inside")).alias("rank"))
    # who stands before and after a page is found by ids alone; the lines themselves are shuffled once to meet their readers, and once with them
    other = [F.col(c).alias(f"other_{c}") for c in identity]
    sides = F.array(F.struct((F.col("rank") + 1).alias("rank"), F.lit(True).alias("is_before")), F.struct((F.col("rank") - 1).alias("rank"), F.lit(False).alias("is_before")))
    given = ranked.select("host", *other, F.explode(sides).alias("to")).select("host", "to.rank", "to.is_before", *(f"other_{c}" for c in identity))
    pairs = given.hint("merge").join(ranked, ["host", "rank"]).select(*identity, "is_before", *(f"other_{c}" for c in identity))
    lists = keyed.withColumn("same", address).dropDuplicates(identity).select(*other, "lines")
    # a page without an id has neighbours, too
    meet = [pairs[f"other_{c}"].eqNullSafe(lists[f"other_{c}"]) for c in identity]
    near = pairs.hint("merge").join(lists, meet).groupBy(*identity).agg(
        F.max(F.when(F.col("is_before"), F.col("lines"))).alias("before"), F.max(F.when(~F.col("is_before"), F.col("lines"))).alias("after")
    )
    packed = pages.mapInArrow(_pack, "page_id long, url string, key long, packed binary").withColumn("same", address)
    rows = packed.hint("merge").join(near, [packed[c].eqNullSafe(near[c]) for c in identity], "left").select(packed["page_id"], "url", "packed", "before", "after")
    return rows.mapInArrow(_extract, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
