"""Main text of web pages by differencing with the page of the nearest URL on the same host.

Pages are dealt out by ranges of (host, path) and sorted, so the neighbours of a page are the
pages whose URLs share most of its path; no host sits in one task, and each range is read with
the pages next to its ends. A page's visible lines are
aligned with its neighbour's by longest common subsequence, and what both share is taken for
the site's frame and deleted. If most of a page would go and what is left of either has no body
text of its own, the two are copies of one article, and the search goes on along the host, in
both directions, to the nearest page that is no copy.

Markup helps: lines in navigation, forms, adverts and the like go although no neighbour shares
them. Articles of one host may quote the same passage, so inside an article element shared lines
go only where it and the articles of different pages on both sides all begin or end with them.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoview.llm.common import byte_slices
from chronoview.session import shuffles_dropped, staged

BATCH_BYTES = 4 << 20
# A page that shares more than this part of its characters with a neighbour may be its copy.
COPY_SHARE = 0.5
# Shorter lines are no body text. A line is another's edition if so much of its word pairs is.
BODY_CHARS, EDITED = 12, 0.5
# Different articles looked back at (copies in a row count once), and what may wait for the next.
REACH, WAITING_CHARS = 8, 64 << 20
TABLE_BITS = 1 << 28
# So many pages beyond each end of a part are read with it.
EDGE = 16
KEY = ("host", "path", "page_id")
PLACES = "array<struct<part:int,own:boolean>>"
ENDS = ", ".join(f"{x} array<struct<host:string,path:string,page_id:long>>"
                 for x in ("first", "last"))
ENDS_ARROW = pa.schema([(x, pa.list_(pa.struct(
    [("host", pa.string()), ("path", pa.string()), ("page_id", pa.int64())])))
    for x in ("first", "last")])
RESULT = "page_id long, url string, text string, n_chars long"

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div
    dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main
    menu nav ol p pre search section summary table tbody tfoot thead tr ul""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPACED = frozenset("br td th option".split())
FRAME_TAGS = frozenset("""aside button datalist dialog footer form head header iframe menu nav
    noscript object script search select style svg template textarea""".split())
FRAME_ROLES = frozenset("""alert alertdialog banner complementary contentinfo dialog form menu
    menubar navigation search toolbar""".split())
FRAME_NAMES = frozenset("""ad ads advert advertisement adverts advertising banner breadcrumb
    breadcrumbs comment comments consent cookie cookies disqus footer header hidden login masthead
    menu modal nav navbar navigation newsletter notice pagination pager popup promo promoted
    related search share sharing sidebar signup social sponsor sponsored subscribe subscription
    teaser toolbar widget""".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|template|textarea|noscript|svg|title)\b[^>]*>.*?"
    r"(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[a-zA-Z/!?][^>]*(?:>|\Z)", re.S | re.I)
NAMED = re.compile(r"\b(?P<key>class|id|role|itemprop|hidden|aria-hidden)\b"
                   r"(?:\s*=\s*(?:\"(?P<a>[^\"]*)\"|'(?P<b>[^']*)'|(?P<c>[^\s\"'>]+)))?", re.I)
NAME_PART = re.compile(r"[a-z0-9]+")


@dataclass
class Page:
    """Visible lines of a page: their text, whether markup calls them frame or article."""
    page_id: int | None
    url: str | None
    host: str
    path: str
    own: bool = True
    unsure: bool = False
    lines: list[str] = field(default_factory=list)
    framed: list[bool] = field(default_factory=list)
    inside: list[bool] = field(default_factory=list)
    heading: list[bool] = field(default_factory=list)


def attribute_kind(tag: str, rest: str) -> tuple[bool, bool]:
    """(is frame, is article) of a start tag."""
    frame, article = tag in FRAME_TAGS, tag in ("article", "main")
    if not rest or rest.isspace():
        return frame, article
    for found in NAMED.finditer(rest):
        key = found["key"].lower()
        value = (found["a"] or found["b"] or found["c"] or "").lower()
        if key in ("class", "id"):
            frame = frame or (tag not in ("html", "body") and
                              not FRAME_NAMES.isdisjoint(NAME_PART.findall(value)))
        elif key == "role":
            frame, article = frame or value in FRAME_ROLES, article or value == "main"
        elif key == "itemprop":
            article = article or value == "articlebody"
        elif key == "hidden":
            frame = True
        elif value == "true":
            frame = True
    return frame, article


def read_page(page_id: int | None, url: str | None, host: str, path: str, source: str,
              own: bool = True) -> Page:
    """Lines are the blocks of a page; unclosed elements end with the one around them."""
    page = Page(page_id, url, host, path, own=own)
    parts: list[str] = []
    open_tags: list[tuple[str, bool, bool]] = []  # tag, frame, article
    frames = articles = headings = 0

    def end_line() -> None:
        if parts:
            line = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if line:
                page.lines.append(line)
                page.framed.append(frames > 0)
                page.inside.append(articles > 0)
                page.heading.append(headings > 0)

    at = 0
    for token in TOKEN.finditer(source):
        if token.start() > at:
            parts.append(source[at:token.start()])
        at = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK or tag in FRAME_TAGS:
            end_line()
        elif tag in SPACED:
            parts.append(" ")
        if token["close"]:
            if any(name == tag for name, _, _ in open_tags):
                while True:
                    name, frame, article = open_tags.pop()
                    if frame or article:
                        end_line()
                    frames, articles = frames - frame, articles - article
                    headings -= name in HEADINGS
                    if name == tag:
                        break
        elif tag not in VOID and not token["rest"].endswith("/"):
            frame, article = attribute_kind(tag, token["rest"])
            if frame or article:
                end_line()
            open_tags.append((tag, frame, article))
            frames, articles = frames + frame, articles + article
            headings += tag in HEADINGS
    parts.append(source[at:])
    end_line()
    return page


def common_lines(a: list, b: list) -> list[tuple[int, int]]:
    """Places (i, j) of one longest common subsequence of two lists.

    Items without a counterpart are left out first; then one machine word compares many
    columns. Where the table would be large, the problem is halved at the best middle.
    """
    shared = set(a) & set(b)
    left = [i for i, x in enumerate(a) if x in shared]
    right = [j for j, x in enumerate(b) if x in shared]
    pairs: list[tuple[int, int]] = []
    work = [(0, len(left), 0, len(right))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[left[a0]] == b[right[b0]]:
            pairs.append((left[a0], right[b0]))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[left[a1 - 1]] == b[right[b1 - 1]]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((left[a1], right[b1]))
        if a0 == a1 or b0 == b1:
            continue
        first = [a[i] for i in left[a0:a1]]
        second = [b[j] for j in right[b0:b1]]
        if len(first) * len(second) <= TABLE_BITS or len(first) == 1:
            pairs += [(left[a0 + i], right[b0 + j]) for i, j in _table(first, second)]
            continue
        middle = len(first) // 2
        down = _lengths(first[:middle], second)
        up = _lengths(first[middle:][::-1], second[::-1])[::-1]
        cut = max(range(len(second) + 1), key=lambda j: down[j] + up[j])
        work += [(a0, a0 + middle, b0, b0 + cut), (a0 + middle, a1, b0 + cut, b1)]
    return sorted(pairs)


def _rows(first: list, second: list) -> Iterator[int]:
    """Bit vectors of the table's rows: bit j is 0 where column j adds one to the length."""
    masks: dict = {}
    for j, x in enumerate(second):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(second)) - 1
    row = full
    for x in first:
        hits = row & masks.get(x, 0)
        row = ((row + hits) | (row - hits)) & full
        yield row


def _lengths(first: list, second: list) -> list[int]:
    row = (1 << len(second)) - 1
    for row in _rows(first, second):
        pass
    lengths = [0]
    for bit in format(row, f"0{len(second)}b")[::-1]:
        lengths.append(lengths[-1] + (bit == "0"))
    return lengths


def _table(first: list, second: list) -> list[tuple[int, int]]:
    rows = list(_rows(first, second))
    pairs, i, j = [], len(first) - 1, len(second) - 1
    while i >= 0 and j >= 0:
        if rows[i] >> j & 1:
            j -= 1
        elif i and not rows[i - 1] >> j & 1:
            i -= 1
        else:
            # Column j grows in row i and not above: here lies a pair, with the last equal
            # item at or before j.
            pairs.append((i, j))
            i, j = i - 1, j - 1
    return pairs


def word_pairs(line: str) -> set[tuple[str, str]]:
    """Neighbouring words, or characters where there are hardly any words."""
    words = line.split()
    units = words if len(words) > 3 else line
    return set(zip(units, units[1:]))


def mostly_shared(page: Page, shared: set[int]) -> bool:
    sizes = [0, 0]
    for i, line in enumerate(page.lines):
        if not page.framed[i]:
            sizes[i in shared] += len(line)
    return sizes[1] > COPY_SHARE * sum(sizes)


def own_body(page: Page, shared: set[int], other: Page, others_shared: set[int]) -> bool:
    """Whether the lines not shared have body text that is no edition of the other's."""
    rest = {pair for j, line in enumerate(other.lines)
            if j not in others_shared and not other.framed[j] for pair in word_pairs(line)}
    for i, line in enumerate(page.lines):
        if i in shared or page.framed[i] or page.heading[i] or len(line) < BODY_CHARS:
            continue
        pairs = word_pairs(line)
        if len(pairs & rest) <= EDITED * len(pairs):
            return True
    return False


def compared(page: Page, other: Page) -> tuple[set[int], set[int]] | None:
    """The lines of both pages that the other has too, or None for copies."""
    pairs = common_lines(page.lines, other.lines)
    mine, theirs = {i for i, _ in pairs}, {j for _, j in pairs}
    if (mostly_shared(page, mine) or mostly_shared(other, theirs)) and not (
            own_body(page, mine, other, theirs) and own_body(other, theirs, page, mine)):
        return None
    return mine, theirs


def nearness(page: Page, other: Page | None) -> int:
    if other is None or other.host != page.host:
        return -1
    n = 0
    for x, y in zip(page.path, other.path):
        if x != y:
            break
        n += 1
    return n


def article_lines(page: Page) -> list[int]:
    return [i for i in range(len(page.lines)) if page.inside[i] and not page.framed[i]]


def shared_ends(page: Page, others: list[Page]) -> set[int]:
    """Lines with which the articles of all these pages begin or end, never a whole article."""
    body = article_lines(page)
    lines = [[p.lines[i] for i in article_lines(p)] for p in (page, *others)]
    first = last = 0
    for row in zip(*lines):
        if len(set(row)) > 1:
            break
        first += 1
    for row in zip(*(x[::-1] for x in lines)):
        if len(set(row)) > 1:
            break
        last += 1
    return {*body[:first], *body[len(body) - last:]} if first + last < len(body) else set()


Neighbour = tuple[Page, set[int]]


def main_text(page: Page, before: Neighbour | None, after: Neighbour | None) -> str:
    """The page's lines without frames; each neighbour comes with the lines it shares."""
    near = [x for x in (before, after) if x is not None]
    shared = max(near, key=lambda x: nearness(page, x[0]))[1] if near else set()
    ends: set[int] = set()
    if len(near) == 2:
        ends = shared_ends(page, [x[0] for x in near])
        if ends and compared(near[0][0], near[1][0]) is None:
            ends = set()
    kept = [line for i, line in enumerate(page.lines) if not page.framed[i] and (
        i not in ends if page.inside[i] else i not in shared)]
    return "\n\n".join(kept)


class Host:
    """Pages of one host in order, each given out once its neighbours are known.

    Where a bound, or an end of the part that may lie within the host, ends a search, the page
    is ``unsure``; ``searched`` looks for its neighbours in other parts.
    """

    def __init__(self, cut: bool = False) -> None:
        self.name: str | None = None
        self.cut, self.hosts = cut, 0
        self.behind: list[Page] = []
        self.waiting: list[tuple[Page, Neighbour | None]] = []
        self.held = 0

    def end(self, cut: bool = False) -> list[tuple[Page, str]]:
        for page, _ in self.waiting:
            page.unsure = page.unsure or cut
        done = [(page, main_text(page, before, None)) for page, before in self.waiting]
        self.waiting, self.held = [], 0
        return done

    def add(self, page: Page) -> list[tuple[Page, str]]:
        done = []
        if page.host != self.name:
            done = self.end()
            self.cut, self.hosts = self.cut and not self.hosts, self.hosts + 1
            self.name, self.behind = page.host, []
        before, last = None, True
        for other in reversed(self.behind):
            found = compared(page, other)
            if last and found is None:
                self.behind.pop()
            elif last:
                done += self.meet(page, other, found[1])
            last = False
            if found is not None:
                before = other, found[0]
                break
        page.unsure = before is None and self.cut
        self.cut = self.cut or len(self.behind) >= REACH
        self.behind = [*self.behind, page][-REACH:]
        self.waiting.append((page, before))
        self.held += sum(map(len, page.lines))
        if self.held > WAITING_CHARS:
            done += self.end(cut=True)
        return done

    def meet(self, page: Page, last: Page, lasts_shared: set[int]) -> list[tuple[Page, str]]:
        """Pages that waited for one that is no copy, as ``page`` is none of the last one."""
        done, waiting = [], []
        for mine, before in self.waiting:
            if mine is last:
                done.append((mine, main_text(mine, before, (page, lasts_shared))))
                continue
            found = compared(mine, page)
            if found is None:
                waiting.append((mine, before))
            else:
                done.append((mine, main_text(mine, before, (page, found[0]))))
        self.waiting, self.held = waiting, sum(len(x) for p, _ in waiting for x in p.lines)
        return done


def sort_key(host: str, path: str, page_id: int | None) -> tuple:
    """Orders as Spark does: by bytes, a null id first."""
    return host, path, page_id is not None, page_id or 0


class Cuts:
    """Parts of the sorted pages: where each begins, and the keys it sees beyond its ends."""

    def __init__(self, ends: list[tuple[list[tuple], list[tuple]]]):
        """``ends``: first and last keys of every part, in order."""
        # Parts too small to show all that a neighbour may see of them are put together.
        whole: list[tuple[list[tuple], list[tuple]]] = []
        for first, last in ends:
            if whole and min(len(whole[-1][0]), len(first)) < EDGE:
                a, b = whole.pop()
                first, last = (a + first)[:EDGE], (b + last)[-EDGE:]
            whole.append((first, last))
        ends = whole
        self.starts = [first[0] for first, _ in ends]
        self.low = [ends[max(0, i - 1)][1][0] if i else first[0]
                    for i, (first, _) in enumerate(ends)]
        self.high = [ends[min(len(ends) - 1, i + 1)][0][-1] if i + 1 < len(ends) else last[-1]
                     for i, (_, last) in enumerate(ends)]

    def places(self, key: tuple) -> list[tuple[int, bool]]:
        """The parts that see a page, and whether it is theirs."""
        own = max(0, bisect.bisect_right(self.starts, key) - 1)
        return [(i, i == own) for i in (own - 1, own, own + 1) if i == own or (
            0 <= i < len(self.starts) and self.low[i] <= key <= self.high[i])]


def part_cuts(keys: DataFrame) -> Cuts:
    """Ranges of equal size, from the keys alone; the driver sees ``EDGE`` of each end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list[dict] = []
        last: list[dict] = []
        for batch in batches:
            if len(first) < EDGE:
                first += batch.slice(0, EDGE - len(first)).to_pylist()
            last = (last + batch.slice(max(0, batch.num_rows - EDGE)).to_pylist())[-EDGE:]
        if first:
            yield pa.RecordBatch.from_pylist([{"first": first, "last": last}], ENDS_ARROW)

    # A number of its own: the keys are few bytes, and must not be put together for that.
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keys.repartitionByRange(parts, *KEY).sortWithinPartitions(*KEY).mapInArrow(
        run, ENDS).collect()
    ends = sorted(([sort_key(*k) for k in r.first], [sort_key(*k) for k in r.last]) for r in rows)
    return Cuts(ends)


def searched(placed: DataFrame, parts: int) -> DataFrame:
    """``RESULT`` of the rows that are ``unsure``, each against all pages of its host if need be.

    ``placed``: pages with their part of the sorted order. Pages of the own part and those beside
    it come first, then twice as far each round; a row is done once it has a page that is no
    copy on either side, or its host has no further part there. Pairs are dealt by row and part.
    """
    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, Page] | None = None
        for part in byte_slices(batches, "other_html", BATCH_BYTES):
            kept = []
            for i, row in enumerate(part.to_pylist()):
                if last is None or last[0] != row["row"]:
                    last = row["row"], read_page(None, None, "", "", row["html"] or "")
                kept.append(compared(last[1], read_page(
                    None, None, "", "", row["other_html"] or "")) is not None)
            yield part.drop_columns(["html"]).filter(pa.array(kept, pa.bool_()))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "html", BATCH_BYTES):
            done = []
            for row in part.to_pylist():
                page = read_page(row["page_id"], row["url"], row["host"], row["path"], row["html"] or "")
                near: list[Neighbour | None] = []
                for x in (row["before"], row["after"]):
                    other = x and read_page(x["page_id"], None, row["host"], x["path"], x["html"] or "")
                    near.append(other and (other, compared(page, other)[0]))
                done.append((page, main_text(page, *near)))
            yield result(done)

    asked = staged(placed.where("unsure").withColumn("row", F.monotonically_increasing_id()),
                   "unsure-pages")
    ends = placed.groupBy("host").agg(F.min("part").alias("first"), F.max("part").alias("last"))
    others = placed.join(asked.select("host").distinct(), "host", "left_semi").select(
        "host", F.col("part").alias("other_part"), F.col("path").alias("other_path"),
        F.col("page_id").alias("other_id"), F.col("html").alias("other_html"))
    kind = placed.select(F.struct("path", "page_id", "html").alias("x")).schema["x"].dataType
    left = asked.join(ends, "host").withColumns(
        {x: F.lit(None).cast(kind) for x in ("before", "after")})
    found, seen, reach = None, -1, 1
    columns = left.columns
    while True:
        # Parts from seen + 1 to reach away on the sides where nothing has been found.
        away = F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("away")
        asks = left.select("row", "host", "path", "page_id", "html", "part", "before", "after", away) \
            .where(f"abs(away) > {seen} AND (before IS NULL AND away <= 0 OR after IS NULL AND away >= 0)") \
            .withColumn("other_part", F.col("part") + F.col("away"))
        earlier = F.struct("other_path", "other_id") <= F.struct("path", "page_id")
        pairs = asks.join(others, ["host", "other_part"]).select(
            "row", "html", "other_path", "other_id", "other_html", earlier.alias("earlier"))
        other = F.struct(F.col("other_path").alias("path"), F.col("other_id").alias("page_id"),
                         F.col("other_html").alias("html"))
        differing = pairs.mapInArrow(differ, "row long, other_path string, other_id long, "
                                             "other_html string, earlier boolean")
        nearest = differing.groupBy("row").agg(
            F.max(F.when(F.col("earlier"), other)).alias("_before"),
            F.min(F.when(~F.col("earlier"), other)).alias("_after"))
        left = staged(left.join(nearest, "row", "left").withColumns(
            {x: F.coalesce(x, f"_{x}") for x in ("before", "after")}).select(*columns), "unsure-pages")
        open_ends = (f"before IS NULL AND first < part - {reach} "
                     f"OR after IS NULL AND last > part + {reach}")
        done = left.where(f"NOT ({open_ends})")
        found = done if found is None else found.unionByName(done)
        left, seen, reach = left.where(open_ends), reach, 2 * reach
        if seen >= parts or left.isEmpty():
            break
    return found.select("page_id", "url", "host", "path", "html", "before", "after").mapInArrow(
        write, RESULT)


def result(done: list[tuple[Page, str]], unsure: bool = False) -> pa.RecordBatch:
    done = [(p, t) for p, t in done if p.own]
    columns = {"page_id": pa.array([p.page_id for p, _ in done], pa.int64()),
               "url": pa.array([p.url for p, _ in done], pa.string()),
               "text": pa.array([t for _, t in done], pa.string()),
               "n_chars": pa.array([len(t) for _, t in done], pa.int64())}
    if unsure:
        columns |= {"host": pa.array([p.host for p, _ in done], pa.string()),
                    "path": pa.array([p.path for p, _ in done], pa.string()),
                    "unsure": pa.array([p.unsure for p, _ in done], pa.bool_())}
    return pa.RecordBatch.from_pydict(columns)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    A null or empty html gives an empty text, a null url stands on a host of its own name "".
    Repeated rows are extracted alike; an empty table gives no rows; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, part_id = Host(), 0
        for part in byte_slices(batches, "html", BATCH_BYTES):
            done = []
            for row in part.to_pylist():
                if row["part"] != part_id or host.name is None:
                    done += host.end(cut=part_id + 1 < n)
                    host, part_id = Host(cut=row["part"] > 0), row["part"]
                done += host.add(read_page(row["page_id"], row["url"], row["host"], row["path"],
                                           row["html"] or "", row["own"]))
            yield result(done, unsure=True)
        yield result(host.end(cut=part_id + 1 < n), unsure=True)

    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    placed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html",
                          host.alias("host"), path.alias("path"))
    cuts = part_cuts(placed.select(*KEY))
    places = F.udf(lambda *key: cuts.places(sort_key(*key)), PLACES, useArrow=True)
    dealt = placed.select("*", F.inline(places(*KEY)))
    n = max(1, len(cuts.starts))
    found = dealt.repartitionByRange(n, "part").sortWithinPartitions("part", *KEY).mapInArrow(
        run, f"{RESULT}, host string, path string, unsure boolean")
    columns = ["page_id", "url", "text", "n_chars"]
    # Texts would take as much disk as the pages, so they are not stored but made again.
    with shuffles_dropped(pages.sparkSession):
        unsure = staged(found.where("unsure").select(*KEY).distinct(), "unsure-keys")
    if unsure.isEmpty():
        return found.select(*columns)
    same = [F.col(f"p.{x}").eqNullSafe(F.col(f"u.{x}")) for x in KEY]
    marked = dealt.where("own").alias("p").join(
        unsure.withColumn("unsure", F.lit(True)).alias("u"), same, "left").select(
        "p.*", F.coalesce("u.unsure", F.lit(False)).alias("unsure"))
    # A row with the key of one that is unsure is looked at again too.
    sure = found.alias("f").join(
        unsure.alias("u"), [F.col(f"f.{x}").eqNullSafe(F.col(f"u.{x}")) for x in KEY], "left_anti")
    return sure.select(*columns).unionByName(searched(marked, n))
