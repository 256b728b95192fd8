"""Main text of web pages, by differencing each page against the page with the nearest URL.

A page becomes lines: the text of its blocks, with character references decoded and white space
(in the sense of Unicode) made single spaces. Pages of a host are ordered by path; a page is paired
with the neighbour in that order whose path begins alike for longer (the earlier one on ties). The
lines of both are aligned by a longest common subsequence, and lines in it are template: deleted.
A pairing without a shared line, or one in which nothing of the page but marked template would
stay different (a copy), tells nothing; the other neighbour is taken then, or none.

What differencing can't tell, markup must, and it has the last word:

* lines inside ``article`` or ``main`` stay although they are shared. Copies, quotations and
  licence lines would be lost otherwise;
* lines in elements that never hold main text go although nobody shares them: by element
  (``GONE``), role, ``hidden``, or a word of the class or id (``HINTS``). Sites that rotate their
  menus and adverts show other ones on neighbouring pages;
* on a page with an article the other lines outside it go; on a page without one they are main
  text unless shared.

For the pairing a page is its lines' 64-bit digests. Pages are dealt by ranges of (host, path), so
a host of any size is many tasks, each of which streams its pages in order and holds three at a
time. The first and last pages of a range don't know their neighbours; they are put out with those
they know, and the same is done for them again, until one range is left. Results don't depend on
how the ranges fell. Texts move once, when the pages meet their shared lines. The alignment keeps
one bit a pair of lines up to ``TABLE_BITS`` and divides itself above that.

Defined results: null and empty html give an empty text and are paired with none; a page without a host (null URL, no
``://``) is paired with none; rows of equal id, URL and html are one page; broken markup is read to its
end (an unclosed comment, script or tag swallows what follows); other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from voxelith.llm.text import parts_for, prepare, release_memory, sliced, text_bytes
from voxelith.llm.url_markov import host, path
from voxelith.session import cut_lineage

OPEN, MAIN, TEMPLATE = 0, 1, 2  # what markup says of a line
TABLE_BITS = 1 << 24
FAN_IN = 256  # ranges whose ends make up one range of the next round

RAW = "script|style|textarea|title|iframe|noembed|noframes|noscript|template|xmp"
MARKUP = re.compile(
    rf"""<!--.*?(?:-->|\Z)
    |<(?P<raw>{RAW})(?=[\s/>]).*?(?:</(?P=raw)[^>]*(?:>|\Z)|\Z)
    |<[!?][^>]*(?:>|\Z)
    |<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*"|'[^']*')*+)(?:>|\Z)
    |</?[a-z][^>]*(?:>|\Z)""",
    re.S | re.I | re.X,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HINT_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
REPEATED = frozenset("dd dt li option td th tr".split())  # one ends where the next of its kind begins
GONE = frozenset("aside audio button canvas datalist dialog footer form head map menu menuitem meter nav object progress search select svg video".split())
GONE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split()
)
HINTS = frozenset(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr
    login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo related replies share sharing sidebar
    signup social sponsor sponsored subscribe toolbar topbar widget""".split()
)


def _says(name: str, rest: str, inside: int) -> int:
    """What an element opened inside ``inside`` says of its lines."""
    if inside == TEMPLATE or name in GONE or (name == "header" and inside != MAIN):
        return TEMPLATE
    if name in ("html", "body"):
        return inside
    says = MAIN if name in ("article", "main") else inside
    if not rest.strip():
        return says
    given = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest)}
    role = given.get("role", "").lower()
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or role in GONE_ROLES:
        return TEMPLATE
    if role == "main" or given.get("itemprop") == "articleBody":
        says = MAIN
    for label in f"{given.get('class', '')} {given.get('id', '')}".split():
        words = [w.lower() for w in HINT_WORD.findall(label)]
        # an article is often labelled by what belongs to it ("has-sidebar"): only a label of one word counts
        if HINTS.intersection(words) and (len(words) == 1 or name not in ("article", "main")):
            return TEMPLATE
    return says


def page_lines(html: str) -> list[tuple[str, int]]:
    """The blocks' texts in order, with what markup says of each; blocks without text are left out."""
    lines: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []
    depth: Counter[str] = Counter()
    pieces: list[str] = []

    def state() -> int:
        return stack[-1][1] if stack else OPEN

    def flush() -> None:
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                lines.append((text, state()))
            pieces.clear()

    def pop() -> None:
        depth[stack.pop()[0]] -= 1

    at = 0
    for m in MARKUP.finditer(html):
        if m.start() > at:
            pieces.append(html[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            if m["raw"]:
                flush()
            continue
        if m["close"]:
            if name not in INLINE:
                flush()
            if depth[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                if state() != (stack[k - 1][1] if k else OPEN):
                    flush()
                while len(stack) > k:
                    pop()
            continue
        if name in VOID:
            if name in ("br", "hr"):
                flush()
            continue
        if name in INLINE:
            says = _says(name, m["rest"], state())
            if says != state():
                flush()
        else:
            flush()
            while stack and (stack[-1][0] in INLINE or stack[-1][0] == "p"):
                pop()
            if name in REPEATED and stack and stack[-1][0] == name:
                pop()
            says = _says(name, m["rest"], state())
        stack.append((name, says))
        depth[name] += 1
    pieces.append(html[at:])
    flush()
    return lines


def _last_row(a: list[int], places: dict[int, int], width: int) -> np.ndarray:
    """Lengths of the common subsequences of ``a`` and 0, 1, ... ``width`` lines of the other."""
    full = row = (1 << width) - 1
    for line in a:
        hit = row & places.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(width // 8 + 1, "little"), np.uint8), bitorder="little")[:width]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def _places(lines: list[int]) -> dict[int, int]:
    found: dict[int, int] = {}
    for k, line in enumerate(lines):
        found[line] = found.get(line, 0) | 1 << k
    return found


def common_lines(a: list[int], b: list[int], table_bits: int = TABLE_BITS) -> list[int]:
    """Places in ``a`` of a longest common subsequence of both."""
    in_a, in_b = set(a), set(b)
    kept = [k for k, line in enumerate(a) if line in in_b]
    return [kept[k] for k in _aligned([a[k] for k in kept], [line for line in b if line in in_a], table_bits)]


def _aligned(a: list[int], b: list[int], table_bits: int) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > table_bits and len(a) > 1:
        half = len(a) // 2
        ahead = _last_row(a[:half], _places(b), len(b))
        behind = _last_row(a[half:][::-1], _places(b[::-1]), len(b))
        cut = int((ahead + behind[::-1]).argmax())
        return _aligned(a[:half], b[:cut], table_bits) + [half + k for k in _aligned(a[half:], b[cut:], table_bits)]
    places, full = _places(b), (1 << len(b)) - 1
    row, table = full, []
    for line in a:
        hit = row & places.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
        table.append(row)
    found, i, j = [], len(a), len(b)
    while i and j:
        if table[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if i and not table[i - 1] >> (j - 1) & 1:
            continue
        found.append(i)
        j -= 1
    return found[::-1]


def shared_lines(lines: list[int], says: bytes, others: list[list[int]]) -> list[int]:
    """Places of template lines found by comparing with ``others``, best first."""
    for other in others:
        found = common_lines(lines, other)
        if found and len(set(found).union(k for k, mark in enumerate(says) if mark == TEMPLATE)) < len(lines):
            return found
    return []


def main_text(lines: list[tuple[str, int]], shared: Iterable[int]) -> str:
    """What stays of a page's lines."""
    article, gone = any(says == MAIN for _, says in lines), set(shared)
    return " ".join(text for k, (text, says) in enumerate(lines) if says == MAIN or (says == OPEN and not article and k not in gone))


class Page:
    """One row of the ordered stream: where the page stands and its lines' digests."""

    def __init__(self, id, url, mark, host, path, decide, digests, says):
        self.id, self.url, self.mark, self.host, self.path, self.decide, self.says = id, url, mark, host, path, decide, says
        self.lines = np.frombuffer(digests, np.int64).tolist()

    def like(self, other: Page | None) -> int:
        """Length of the paths' common beginning; -1 for another host."""
        return len(commonprefix([self.path, other.path])) if other is not None and self.host and self.host == other.host else -1

    def row(self, decide: bool, shared: list[int] | None = None) -> tuple:
        digests = np.array(self.lines, np.int64).tobytes() if shared is None else None
        return (self.id, self.url, self.mark, self.host, self.path, decide, digests, self.says, shared)

    def decided(self, before: Page | None, after: Page | None) -> tuple:
        others = [p for _, _, p in sorted((-self.like(p), k, p) for k, p in enumerate((before, after)) if self.like(p) >= 0)]
        return self.row(True, shared_lines(self.lines, self.says, [p.lines for p in others]))


def stream(pages: Iterable[Page], whole: bool) -> Iterator[tuple]:
    """Decided rows of one range; unless it is the whole order, also its ends, undecided.

    The ends are the first and the last page; the pages next to them follow as rows that are not
    to be decided any more. A page without lines is nobody's neighbour.
    """
    before = here = None
    n = 0
    for page in pages:
        if not page.lines:
            yield page.row(True, [])
            continue
        if n == 1 and not whole:
            yield here.row(here.decide)
        elif n:
            if n == 2 and not whole:
                yield here.row(False)
            if here.decide:
                yield here.decided(before, page)
        before, here = here, page
        n += 1
    if whole and n and here.decide:
        yield here.decided(before, None)
    if not whole:
        if n > 3:
            yield before.row(False)
        if n:
            yield here.row(here.decide)


COLUMNS = {
    "url": (pa.string(), "string"), "mark": (pa.int64(), "bigint"), "host": (pa.string(), "string"), "path": (pa.string(), "string"),
    "decide": (pa.bool_(), "boolean"), "digests": (pa.binary(), "binary"), "says": (pa.binary(), "binary"), "shared": (pa.list_(pa.int32()), "array<int>"),
}


def _schema(kind: str, names: list[str]) -> str:
    return ", ".join([f"id {kind}", *(f"{name} {COLUMNS[name][1]}" for name in names)])


def _digested(rows: DataFrame, kind: str) -> DataFrame:
    """Every distinct page with its lines' digests and marks."""
    names = ["url", "mark", "host", "path", "decide", "digests", "says"]

    def run(batches):
        for batch in sliced(batches, "html"):
            digests, says = [], []
            for html in batch.column("html"):
                lines = page_lines(html.as_py() or "")
                digests.append(np.array([xxh3_64_intdigest(text) for text, _ in lines], np.uint64).tobytes())
                says.append(bytes(mark for _, mark in lines))
            columns = [*(batch.column(name) for name in ("id", *names[:5])), pa.array(digests, pa.binary()), pa.array(says, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *names])

    return rows.mapInArrow(run, _schema(kind, names)).dropDuplicates(["id", "url", "mark"])


def _round(rows: DataFrame, parts: int, kind: str) -> DataFrame:
    order = ["host", "path", "id", "url", "mark"]

    def run(batches):
        id_type = []

        def pages() -> Iterator[Page]:
            for batch in batches:
                id_type.append(batch.schema.field("id").type)
                for value in batch.to_pylist():
                    yield Page(**value)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = [id_type[0], *(t for t, _ in COLUMNS.values())]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["id", *COLUMNS])

        held = []
        for row in stream(pages(), parts == 1):
            held.append(row)
            if len(held) >= 1000:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)
        release_memory()

    dealt = rows.repartitionByRange(parts, *order) if parts > 1 else rows.coalesce(1)
    return dealt.sortWithinPartitions(*order).mapInArrow(run, _schema(kind, list(COLUMNS)))


def decisions(rows: DataFrame, parts: int, kind: str) -> DataFrame:
    """``id, url, mark, shared``: the shared lines of every distinct page, range by range, then at the ranges' ends."""
    found, rows = None, _digested(rows, kind)
    while True:
        table = cut_lineage(_round(rows, parts, kind))
        decided = table.where(F.col("shared").isNotNull()).select("id", "url", "mark", "shared")
        found = decided if found is None else found.unionByName(decided)
        if parts == 1:
            return found
        rows = table.where(F.col("shared").isNull()).drop("shared")
        parts = -(-parts // FAN_IN)


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", partition_bytes: int = 256 << 20,
) -> DataFrame:
    """``id, url, text`` of every page; the id's column keeps its name. ``partition_bytes`` are bytes of html a range."""
    prepare(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.xxhash64(html_col).alias("mark"),
        host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"), F.lit(True).alias("decide"), F.col(html_col).alias("html"),
    )
    size = text_bytes(pages, html_col)
    shared = decisions(rows, parts_for(size, partition_bytes), kind)

    def run(batches):
        for batch in sliced(batches, "html"):
            text = [main_text(page_lines(h.as_py() or ""), s.as_py()) for h, s in zip(batch.column("html"), batch.column("shared"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(text, pa.string())], names=[id_col, "url", "text"])

    same = F.col("p.id").eqNullSafe(F.col("s.id")) & F.col("p.url").eqNullSafe(F.col("s.url")) & (F.col("p.mark") == F.col("s.mark"))
    joined = rows.select("id", "url", "mark", "html").alias("p").join(shared.alias("s"), same).select("p.id", "p.url", "html", "shared")
    return joined.mapInArrow(run, f"`{id_col}` {kind}, url string, text string")
