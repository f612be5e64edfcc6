"""Main text of web pages by nearest-URL page differencing, guided by the page's own structure.

Pages are put in order by host, then URL path; a page is paired with whichever of its two neighbours on the same host has
the longer path in common. The text lines (blocks) of the two pages are aligned by a longest common subsequence, and
lines shared by both are deleted: what a site repeats on its pages is not the article.

Differencing alone can't give right results: articles that are copies of each other would vanish, and so would any
passage that two neighbours share, while menus and adverts that differ from page to page would stay. So structure comes
first. Elements that are boilerplate by their name, role or class (BOILERPLATE) are left out, unless the page's text is in
one that only looks like it (see `blocks`). Lines inside a content
element (article, main) are the text and are never deleted; if a page has such lines, the lines outside them are not the
text. Differencing decides for pages without a content element. Where over half of such a page is shared with the nearest
one, as in a short page of a large template or in a copy, the lines that go are those that the page on its other side
shares as well; without such a page none do.

The order is dealt by ranges (see `ordering`), so a host with any share of the pages is spread over all tasks.

Defined cases: null or empty html gives an empty text; broken or unclosed markup is read on as text or closed at the end;
a null url is a host of its own with no neighbour; repeated rows and ties of URLs are neighbours like others; an empty
table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import deal

#: Elements, roles and words of class or id that mark what isn't the article. Fixed values.
BOILERPLATE = frozenset("script style noscript template head nav header footer aside form iframe svg button select textarea dialog object canvas".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu".split())
MARKS = frozenset("ad ads banner nav navbar navigation menu sidebar footer masthead consent signup replies share sharing social related popup modal privacy".split())
#: Words that make a name that of such an element whatever stands beside them, but for one of UNLESS before them.
STRONG = frozenset("adsbygoogle advert adverts advertisement breadcrumb breadcrumbs comment comments cookie cookies disqus newsletter promo sponsor sponsored subscribe".split())
UNLESS = frozenset("has no not with without".split())
#: Words that stand beside one of MARKS in a name of an element that isn't the article (site-nav, ad-slot-2); any other word
#: (social-policy, share-price), and has-, no- and with- above all, makes the name another thing's.
BESIDE = frozenset("notice site page main global primary secondary top bottom left right inner outer sticky mobile desktop fixed bar box list item items link links button buttons icons container wrapper wrap widget block section area slot unit panel menu nav form header inline article articles post posts content stories".split())
CONTENT = frozenset("article main".split())
#: Elements that end a block.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead title tr ul".split())
#: Elements that the next block closes.
OPEN_ENDED = frozenset("p li dt dd option tr td th".split())
RAW = frozenset("script style textarea title".split())
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
SPACED = frozenset("br td th img".split())

#: Lines times lines up to which a table of bits is kept (2 MB); times that a line occurs beyond which its bits are kept.
TABLE_BITS, FREQUENT = 1 << 24, 64

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:[!?][^>]*+>?|(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|(?<==)"[^"]*+"|(?<==)'[^']*+'|["'])*+)>?)""", re.S)
#: An attribute as a whole: its name and, quoted or not, its value.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]++)))?""")
_WORD = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _marked(value: str) -> bool:
    """Whether one of the names of a class or id is, as a whole, that of what isn't the article."""
    for token in value.split():
        of = [w.lower() for w in _WORD.findall(_CAMEL.sub(" ", token))]
        strong = [k for k, w in enumerate(of) if w in STRONG]
        if any(not k or of[k - 1] not in UNLESS for k in strong):
            return True
        if not strong and any(w in MARKS for w in of) and all(w in MARKS or w in BESIDE for w in of):
            return True
    return False


def _left_out(name: str, attributes: str) -> str:
    """Why an element is left out: `sure`, by a `form` or by the `names` of its class or id alone; empty if it stays."""
    if name in BOILERPLATE and name != "form":
        return "sure"
    why = "form" if name == "form" else ""
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "role" and value.lower() in ROLES):
            return "sure"
        if not why and key in ("class", "id") and name not in ("html", "body", *CONTENT) and _marked(value):
            why = "names"
    return why


def blocks(page: str | None) -> list[tuple[str, bool]]:
    """Text blocks of a page in order, without boilerplate elements: (text, whether inside a content element).

    A form, or an element left out for its names alone, may be around the whole page. Where a page has no content element
    otherwise, and what such elements hold is more than the rest, they are read like others.
    """
    out, around = _read(page or "", frozenset())
    if not around or any(inside for _, inside in out):
        return out
    other, more = _read(page or "", around)
    while more:  # one in another
        around |= more
        other, more = _read(page or "", around)
    size = lambda found: sum(len(t) for t, _ in found)
    return other if size(other) > 2 * size(out) else out


def _read(page: str, spared: frozenset[int]) -> tuple[list[tuple[str, bool]], frozenset[int]]:
    """The blocks, and the places of elements left out that may be around the page: they hold a content element or, if forms, a paragraph. spared: places of elements not to leave out."""
    around: set[int] = set()
    start, why = 0, ""
    out: list[tuple[str, bool]] = []
    parts: list[str] = []
    inside, at = 0, 0
    skipped, depth = "", 0  # the element being left out, and how many of its name are open

    def close() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append((text, inside > 0))
        parts.clear()

    while m := _TAG.search(page, at):
        if not skipped and m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if skipped:
            if not closing and why != "sure" and (name in CONTENT or (why == "form" and name == "p")):
                around.add(start)
            if name == skipped:
                depth += -1 if closing else not m[0].endswith("/>")
            elif skipped in OPEN_ENDED and name in BLOCKS:
                depth = 0
            if depth > 0:
                continue
            ended, skipped = skipped, ""
            if closing and name == ended:
                continue
        if not closing and m.start() not in spared and (reason := _left_out(name, m[3])):
            close() if name in BLOCKS or name in BOILERPLATE else parts.append(" ")
            if name in EMPTY or m[3].endswith("/"):
                continue
            skipped, depth, start, why = name, 1, m.start(), reason
            if name in RAW:  # its content is not markup
                end = re.compile(f"</{name}", re.I).search(page, at)
                at = end.start() if end else len(page)
            continue
        if name in BLOCKS:
            close()
        elif name in SPACED:
            parts.append(" ")
        if name in CONTENT:
            inside = max(0, inside + (-1 if closing else 1))
    if not skipped:
        parts.append(page[at:])
    close()
    return out, frozenset(around)


def _places_of(lines: list[str]) -> Callable[[str], int]:
    """A function that gives the places of a line among lines as bits. Only those of frequent lines are kept as such."""
    places: dict[str, list[int]] = {}
    for j, line in enumerate(lines):
        places.setdefault(line, []).append(j)
    kept = {line: sum(1 << j for j in at) for line, at in places.items() if len(at) > FREQUENT}
    return lambda line: kept[line] if line in kept else sum(1 << j for j in places.get(line, ()))


def _last_row(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of longest common subsequences of a and each b[:j], by the bit-parallel recurrence."""
    where, full = _places_of(b), (1 << len(b)) - 1
    v = full
    for line in a:
        u = v & where(line)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence of a and b.

    Up to TABLE_BITS a row of bits is kept for each line and walked back; larger pairs are first cut in two where the
    lengths from both ends add up to most, so memory stays in proportion to the lines.
    """
    found: set[int] = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        low, high, first, last = todo.pop()
        while low < high and first < last and a[low] == b[first]:
            found.add(low)
            low, first = low + 1, first + 1
        while low < high and first < last and a[high - 1] == b[last - 1]:
            high, last = high - 1, last - 1
            found.add(high)
        if low >= high or first >= last:
            continue
        mid, other = a[low:high], b[first:last]
        if len(mid) * len(other) <= TABLE_BITS or len(mid) == 1:
            found.update(low + i for i in _walked(mid, other))
            continue
        half = len(mid) // 2
        ahead, behind = _last_row(mid[:half], other), _last_row(mid[half:][::-1], other[::-1])[::-1]
        cut = int((ahead + behind).argmax())
        todo += [(low, low + half, first, first + cut), (low + half, high, first + cut, last)]
    return found


def _walked(a: list[str], b: list[str]) -> list[int]:
    where, full = _places_of(b), (1 << len(b)) - 1
    rows, v, found = [], full, []
    for line in a:
        u = v & where(line)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    # Zero bits of a row count the length reached: walk back to the lines that raised it.
    length = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count() if i >= 0 else 0
    i, j = len(a) - 1, len(b)
    while i >= 0 and j > 0:
        if a[i] == b[j - 1]:
            found.append(i)
            i, j = i - 1, j - 1
        elif length(i - 1, j) >= length(i, j - 1):
            i -= 1
        else:
            j -= 1
    return found


def main_text(own: list[tuple[str, bool]], other: list[tuple[str, bool]] | None, third: list[tuple[str, bool]] | None = None) -> tuple[str, int]:
    """The page's text, and how many of its lines the nearest page shares. third: the page on the other side."""
    lines = [t for t, _ in own]
    shared = common(lines, [t for t, _ in other]) if other else set()
    kept = [t for t, inside in own if inside]
    if 2 * sum(map(len, kept)) < sum(map(len, lines)) or not kept:
        template = shared
        if 2 * sum(len(lines[i]) for i in shared) > sum(map(len, lines)):
            # Mostly shared: a short page in a large template, or a copy. What the third page has too is template.
            template = shared & common(lines, [t for t, _ in third]) if third else set()
            if len(template) == len(lines):
                template = set()  # all three are copies
        kept = [t for i, (t, inside) in enumerate(own) if inside or i not in template]
    return "\n\n".join(kept), len(shared)


def _alike(a: str, b: str) -> int:
    """Length of the common start of two keys (host, path)."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def extract(pages: DataFrame, ranges: int | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars and n_shared (lines shared with the nearest page) of every row."""
    address, number = F.coalesce(pages[url], F.lit("")), pages[page_id].cast("long")
    host = F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    # Host, path and the rest, so that keys of repeated pages differ by id.
    key = F.concat_ws("\x01", host, path, F.lpad(F.coalesce(number.cast("string"), F.lit("-")), 20, "0"), address)
    rows = pages.select(key.alias("key"), number.alias("page_id"), pages[url].alias("url"), F.coalesce(pages[html], F.lit("")).alias("html"))
    dealt = deal(rows, "key", "html", ranges=ranges, before=True, after=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = now = None  # (range, key, page_id, url, blocks, halo)
        for batch in batches:
            out = []
            for number, k, ident, address, page, halo in zip(*(batch[c].tolist() for c in ("_range", "key", "page_id", "url", "html", "halo"))):
                new = (number, k, ident, address, blocks(page), halo)
                if now and not now[5]:
                    out.append(_settled(before, now, new))
                before, now = now, new
            yield pd.DataFrame(out, columns=names)
        if now and not now[5]:
            yield pd.DataFrame([_settled(before, now, None)], columns=names)

    def _settled(before, now, after) -> tuple:
        host = now[1].split("\x01", 1)[0]
        beside = [x for x in (before, after) if x and host and x[1].split("\x01", 1)[0] == host]
        beside.sort(key=lambda x: -_alike(now[1], x[1]))  # of equally near ones the one before
        near, third = [x[4] for x in beside] + [None] * (2 - len(beside))
        text, shared = main_text(now[4], near, third)
        return now[2], now[3], text, len(text), shared

    names = ["page_id", "url", "text", "n_chars", "n_shared"]
    # Ids travel as text, since pandas has no null among whole numbers.
    sent = dealt.select("_range", "key", F.col("page_id").cast("string").alias("page_id"), "url", "html", "halo")
    made = sent.mapInPandas(run, "page_id string, url string, text string, n_chars long, n_shared long")
    return made.withColumn("page_id", F.col("page_id").cast("long"))
