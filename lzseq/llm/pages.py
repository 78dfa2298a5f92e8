"""Main text of web pages by differencing each page against its nearest neighbours by URL path within its host.

A page is cut into text lines (blocks). Pages are sorted by host and path; the lines of neighbours are aligned by a
longest common subsequence, and what a page shares with a neighbour is template and goes. Copies of the page are no neighbours.
Every line is aligned by its text. What rotates from page to page is aligned by its plain path of elements, whether or not
its names say what it is: lines next to each other at one path are one unit. As the article's own lines have the
same path on every page, too, the element that holds most of a page's text is left out of that, and so are paragraphs and headings
that stand beside it. The page's marks break ties: they weigh in where most of the text is; marked article lines stay even where a copy of
the article is the neighbour; and marked template lines that no neighbour shares, as on a host with one page, go.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import bounded_batches, shared_folder, spread, texts_of

_token = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)""", re.S)
_attr = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes object select canvas audio video".split())
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
TEMPLATE = frozenset("nav footer aside form menu dialog button head".split())
_digits = re.compile(r"\d+")
CLOSES = {"li": ("ul", "ol", "menu"), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table", "tbody", "thead", "tfoot"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
#: Words of class, id and role that mark template and article.
_template_word = re.compile(r"(?<![a-z])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banner|menu|nav|navbar|navigation|breadcrumbs?|sidebar|side-?bar|footer|site-?header|page-?header|masthead|topbar|cookies?|consent|gdpr|notice|notices|alert|popup|modal|newsletter|subscribe|subscription|sign-?up|share|sharing|social|related|recommended|recommendations|comments?|comment-?list|disqus|replies|responses|widget|toolbar|login|search|copyright|legal|skip-?link|pagination|pager|tags|complementary|contentinfo|dialog)(?![a-z])")
_article_word = re.compile(r"(?<![a-z])(?:article|article-?body|post-?(?:body|content|text)|entry-?(?:content|text)|story(?:-?body)?|main-?content|articlebody)(?![a-z])")


#: Elements that hold one piece of prose, and not parts of a page.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd caption figcaption legend summary option label address center".split())
#: How much more a character weighs that is marked article, or less if marked template, when the element with most text is looked for.
MARK_WEIGHT = 50.0
#: Kinds of lines, a byte each: marked article; in the element with most text, or prose beside it; elsewhere; marked template.
ARTICLE, CONTENT, ELSEWHERE, TEMPLATE_LINE = b"acpt"


@dataclass
class Page:
    """Lines in page order: said, the hash of each one's path of elements, its kind."""

    said: list[str]
    paths: list[int]
    kinds: bytes


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - (1 << 63)


def lines_of(page: str) -> Page:
    """Each block with text, in page order."""
    said_lines: list[str] = []
    marks: list[tuple[bool, bool]] = []
    paths: list[int] = []
    at_element: list[int] = []
    parents, tags = [-1], [""]  # elements in page order
    stack: list[tuple[str, bool, bool, int, int]] = []
    open_tags: Counter = Counter()
    parts: list[str] = []
    template = article = False
    place, element = 0, 0

    def flush():
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            said_lines.append(text)
            marks.append((template, article))
            paths.append(place)
            at_element.append(element)

    def pop_through(i):
        nonlocal template, article, place, element
        for tag, *_ in stack[i:]:
            open_tags[tag] -= 1
        _, template, article, place, element = stack[i]
        del stack[i:]

    at, n, low = 0, len(page), None
    while at < n:
        m = _token.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if m["cdata"]:
                parts.append(m["cdata"])
            continue
        tag, attrs = tag.lower(), m["attrs"] or m["attrs2"] or ""
        if m["end"] or m["end2"]:
            if tag in BLOCK:
                flush()
            if open_tags[tag] > 0:
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                pop_through(i)
            continue
        if tag in RAW and not attrs.endswith("/"):
            if low is None:
                low = page.lower() if len(page.lower()) == n else page
            end = low.find(f"</{tag}", at)
            at = n if end < 0 else end
            if tag in ("svg", "math", "object", "select", "audio", "video", "canvas", "template", "noscript", "iframe"):
                flush()
            continue
        if tag in BLOCK:
            flush()
            if open_tags["p"] > 0 and stack:  # a block ends an open paragraph
                i = len(stack) - 1
                while i >= 0 and stack[i][0] != "p" and stack[i][0] not in BLOCK:
                    i -= 1
                if i >= 0 and stack[i][0] == "p":
                    pop_through(i)
            if tag in CLOSES and open_tags[tag] > 0:
                i = len(stack) - 1
                while i >= 0 and stack[i][0] != tag and stack[i][0] not in CLOSES[tag]:
                    i -= 1
                if i >= 0 and stack[i][0] == tag:
                    pop_through(i)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        stack.append((tag, template, article, place, element))
        open_tags[tag] += 1
        said = ""
        if attrs:
            named = {k.lower(): a or b or c for k, a, b, c in _attr.findall(attrs)}
            said = " ".join(named.get(k, "") for k in ("class", "id", "role", "itemprop")).lower()
            if "hidden" in named or named.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", named.get("style", ""), re.I):
                template = True
        if tag in ("article", "main") or said and _article_word.search(said):
            article = True
        elif tag in TEMPLATE or tag == "header" and not article or said and tag not in ("html", "body") and _template_word.search(said):
            template = True
        if tag not in ("html", "body"):
            place = _hash(f"{place}/{tag}.{_digits.sub('0', said)}")
        if tag in BLOCK:
            element = len(parents)
            parents.append(stack[-1][4])
            tags.append(tag)
    flush()
    return Page(said_lines, paths, _kinds(said_lines, marks, at_element, parents, tags))


def _kinds(said: list[str], marks: list[tuple[bool, bool]], at_element: list[int], parents: list[int], tags: list[str]) -> bytes:
    mass = [0.0] * len(parents)
    for text, (template, article), e in zip(said, marks, at_element):
        mass[e] += len(text) * (1 / MARK_WEIGHT if template else MARK_WEIGHT if article else 1)
    for e in range(len(parents) - 1, 0, -1):  # what is inside comes after
        mass[parents[e]] += mass[e]
    most = max((e for e in range(len(parents)) if tags[e] not in PROSE and mass[e] > mass[0] / 2), default=0)
    above, e = {most}, most
    while e > 0:
        e = parents[e]
        above.add(e)
    # Inside it, or in prose right below one of the elements that it is in.
    near = [False] * len(parents)
    for e in range(len(parents)):
        near[e] = e == most or e > 0 and (near[parents[e]] or parents[e] in above and tags[e] in PROSE) or most == 0
    for e in above:
        near[e] = True
    return bytes(TEMPLATE_LINE if template else ARTICLE if article else CONTENT if near[e] else ELSEWHERE for (template, article), e in zip(marks, at_element))


def shared_lines(a: list[int], b: list[int], most: int = 1 << 27) -> set[int]:
    """Places in a that a longest common subsequence of a and b takes. Bit-parallel; split in halves where rows would need more than `most` bits."""
    out: set[int] = set()
    start, end_a, end_b = 0, len(a), len(b)
    while start < min(end_a, end_b) and a[start] == b[start]:
        out.add(start)
        start += 1
    while end_a > start and end_b > start and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
        out.add(end_a)
    both = set(a[start:end_a]) & set(b[start:end_b])
    at = [i for i in range(start, end_a) if a[i] in both]
    x, y = [a[i] for i in at], [v for v in b[start:end_b] if v in both]
    if x and y:
        out.update(at[i] for i in _lcs(x, y, most))
    return out


def _rows(x: list[int], y: list[int]) -> list[int]:
    """Bit vectors after each item of y; a zero bit i of a row means that the length grows at x[i]."""
    masks: dict[int, int] = {}
    for i, v in enumerate(x):
        masks[v] = masks.get(v, 0) | 1 << i
    full = (1 << len(x)) - 1
    v, rows = full, []
    for item in y:
        m = masks.get(item, 0)
        v = ((v + (v & m)) | (v & ~m)) & full
        rows.append(v)
    return rows


def _lcs(x: list[int], y: list[int], most: int) -> list[int]:
    if not x or not y:
        return []
    if len(x) * len(y) > most and len(y) > 1:
        half = len(y) // 2
        front, back = _rows(x, y[:half])[-1], _rows(x[::-1], y[half:][::-1])[-1]
        left = np.cumsum([0, *(1 - (front >> i & 1) for i in range(len(x)))])
        right = np.cumsum([0, *(1 - (back >> i & 1) for i in range(len(x)))])[::-1]
        cut = int((left + right).argmax())
        return _lcs(x[:cut], y[:half], most) + [cut + i for i in _lcs(x[cut:], y[half:], most)]
    rows = _rows(x, y)
    out, i, j = [], len(x) - 1, len(y) - 1
    while i >= 0 and j >= 0:
        if rows[j] >> i & 1:
            i -= 1
        elif j and not rows[j - 1] >> i & 1:
            j -= 1
        else:
            out.append(i)
            i, j = i - 1, j - 1
    return out[::-1]


#: A page as its neighbours see it: hashes of its lines and of their paths, and their kinds.
Units = tuple[list[int], list[int], bytes]


def units_of(page: Page) -> Units:
    return [_hash(t) for t in page.said], page.paths, page.kinds


def own_texts(units: Units) -> tuple[int, ...]:
    """The hashes of the lines that aren't template by their mark or path."""
    return tuple(k for k, c in zip(units[0], units[2]) if c in (ARTICLE, CONTENT))


def covers(other: list[int], own: tuple[int, ...]) -> bool:
    """Whether a page with the lines other has all of these in their order: a copy, which tells nothing. A page without texts has no copies."""
    it = iter(other)
    return bool(own) and all(k in it for k in own)


def _path_runs(paths: list[int], kinds: bytes) -> tuple[list[int], list[list[int]]]:
    """(paths, lines of each) of the units that are aligned by path: lines next to each other outside the article, at one path."""
    keys, lines, last = [], [], None
    for i, (p, c) in enumerate(zip(paths, kinds)):
        if c not in (ELSEWHERE, TEMPLATE_LINE):
            last = None
        elif last == p:
            lines[-1].append(i)
        else:
            keys.append(p)
            lines.append([i])
            last = p
    return keys, lines


def unshared(units: Units, other: Units | None = None, by_path: bool = True) -> list[int]:
    """The lines, but for marked article, that a page doesn't share with another page by text or by path; all of them where there is no other page."""
    texts, paths, kinds = units
    gone: set[int] = set()
    if other is not None:
        gone |= shared_lines(texts, other[0])
        if by_path:
            keys, lines = _path_runs(paths, kinds)
            for k in shared_lines(keys, _path_runs(other[1], other[2])[0]):
                gone.update(lines[k])
    return [i for i, c in enumerate(kinds) if c != ARTICLE and i not in gone]


def main_text(page: str, left=None) -> tuple[str, int, int]:
    """(text, lines that differencing deleted, lines that only their mark deleted). left: the lines that differencing leaves, besides marked article; None is all."""
    read = lines_of(page)
    left = set(range(len(read.kinds)) if left is None else left)
    kept, shared, marked = [], 0, 0
    for i, (text, kind) in enumerate(zip(read.said, read.kinds)):
        if kind != ARTICLE and i not in left:
            shared += 1
        elif kind == TEMPLATE_LINE:
            marked += 1
        else:
            kept.append(text)
    return " ".join(kept), shared, marked


def host_and_path(url) -> tuple:
    """Columns of the lower-case host without www. and the path without its query, fragment, file ending and last slash; digits in it compare as numbers do up to 12 digits."""
    u = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?(?:www\.)?([^/?#:]*)", 1))
    path = F.regexp_replace(F.regexp_extract(u, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), r"(?:\.[a-zA-Z]{2,5})?/*$", "")
    return host, F.regexp_replace(F.regexp_replace(path, r"(\d+)", "000000000000$1"), r"0+(\d{12})(?!\d)", "$1")


#: What differencing leaves, of up to so many bytes, is broadcast to the pages; beyond it, that join shuffles the pages.
#: Pages at the ends of partitions are sent to the other partitions in blocks of so many bytes.
BROADCAST_BYTES = 16 << 20
#: Waiting contents that a page of a growing thread is compared with, at most; those that another one has are known by it, and none is dropped.
WAITING = 32
_UNITS = "texts array<bigint>, paths array<bigint>, kinds binary"
_MET = f"mark bigint, side int, left array<int>, end bigint, part int, host string, {_UNITS}"
_LONGS = pa.list_(pa.int64())
_MET_TYPES = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.int32(), pa.string(), _LONGS, _LONGS, pa.binary())


def _batch(cells: list[tuple], types: tuple, schema: str) -> pa.RecordBatch:
    columns = list(zip(*cells)) if cells else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in schema.split(", ")])


def walk(backward: bool, by_path: bool):
    """For mapInArrow over a sorted partition: each page waits for the next page of its host that isn't a copy of it.

    Pages of one content wait together, and as many contents as the host's pages here have. A content that is within a later
    one, as in growing threads, is within every page that has that one, so it isn't compared again. Gives mark and left (what the page doesn't
    share) where that isn't empty. Pages that still wait at the partition's end come with their units and the number of
    their content in end; each such content has a row without mark.
    """

    def run(batches):
        out: list[tuple] = []
        # Contents to [content, (mark, units) of their pages, the entry of a later content that has this one, the last page that has it].
        host, part, waiting, turn, newest = None, 0, {}, 0, None

        def settled(pages, other):
            for m, units in pages:
                left = unshared(units, other, by_path)
                if left:
                    out.append((m, int(backward), left, *(None,) * 6))

        for batch in batches:
            parts, texts, paths = batch.column("part"), batch.column("texts"), batch.column("paths")
            for i, (h, kinds, mark) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("host", "kinds", "mark")))):
                if h != host:  # the host's last pages have no page behind them
                    for entry in waiting.values():
                        settled(entry[1], None)
                    host, newest = h, None
                    waiting.clear()
                part, units = parts[i].as_py(), (texts[i].as_py(), paths[i].as_py(), kinds)
                own = own_texts(units)
                same, turn, gone = waiting.get(own), turn + 1, []
                for entry in reversed(waiting.values()):
                    if entry is same or entry[2] is not None and entry[2][3] == turn or covers(units[0], entry[0]):
                        entry[3] = turn
                    else:
                        gone.append(entry)
                for entry in gone:
                    settled(waiting.pop(entry[0])[1], units)
                if not own and () in waiting:  # a page without texts has no copies
                    settled(waiting.pop(())[1], units)
                if kinds.count(ARTICLE) < len(kinds):
                    if own not in waiting:
                        entry = waiting[own] = [own, [], None, turn]
                        if newest is not None and newest[3] == turn and covers(own, newest[0]):
                            newest[2] = entry
                        newest = entry
                    waiting[own][1].append((mark, units))
                if len(out) >= 4096:
                    yield _batch(out, _MET_TYPES, _MET)
                    out.clear()
        for n, (content, pages, *_) in enumerate(waiting.values()):
            end = (part << 32 | n) << 1 | backward
            out.append((None, None, None, end, part, host, list(content), None, None))
            for m, units in pages:
                out.append((m, int(backward), None, end, None, None, *units))
                if len(out) >= 4096:
                    yield _batch(out, _MET_TYPES, _MET)
                    out.clear()
        yield _batch(out, _MET_TYPES, _MET)

    return run


_SEEN = f"end bigint, part int, {_UNITS}"
_SEEN_TYPES = (pa.int64(), pa.int32(), _LONGS, _LONGS, pa.binary())


def seek(groups: list[tuple], backward: bool, near: int, far: int):
    """For mapInArrow over a sorted partition: end, part and the page that they meet here, of those contents (end, part, host, texts) that come from over near to far partitions away."""

    def run(batches):
        waiting, found = None, []
        for batch in batches:
            if waiting is None and batch.num_rows:
                here = batch.column("part")[0].as_py()
                waiting = [g for g in groups if near < (g[1] - here if backward else here - g[1]) <= far]
            if not waiting:
                continue
            for i, h in enumerate(batch.column("host").to_pylist()):
                if any(g[2] == h for g in waiting):
                    units = tuple(batch.column(c)[i].as_py() for c in ("texts", "paths", "kinds"))
                    met = [g for g in waiting if g[2] == h and not covers(units[0], g[3])]
                    found += [(g[0], here, *units) for g in met]
                    waiting = [g for g in waiting if g not in met]
        yield _batch(found, _SEEN_TYPES, _SEEN)

    return run


def across(ranged: DataFrame, ends: DataFrame, order: dict) -> list[tuple]:
    """(end, texts, paths, kinds): the page that the contents waiting at the partitions' ends meet in the nearest partition with one that isn't a copy. The reach doubles from one pass to the next while contents of a side are open.

    The driver holds the contents that wait at the partitions' ends in blocks of BROADCAST_BYTES, and the pages found.
    """
    out: list[tuple] = []
    bounds = None

    def settle(block):
        nonlocal bounds
        if bounds is None:  # the partitions of each host that waits
            hosts = ranged.join(F.broadcast(ends.select("host").distinct()), "host")
            bounds = {r[0]: (r[1], r[2]) for r in hosts.groupBy("host").agg(F.min("part"), F.max("part")).toLocalIterator()}
        for backward in (False, True):
            groups, near, far = [g for g in block if g[0] & 1 == backward], 0, 1
            while groups:
                groups = [g for g in groups if not (g[1] - near <= bounds[g[2]][0] if backward else g[1] + near >= bounds[g[2]][1])]  # else no page of the host is left there
                if not groups:
                    break
                best: dict[int, tuple] = {}
                for end, part, *units in ranged.sortWithinPartitions(*order[backward]).mapInArrow(seek(groups, backward, near, far), _SEEN).collect():
                    if end not in best or (part > best[end][0] if backward else part < best[end][0]):
                        best[end] = part, units
                out.extend((end, *units) for end, (_, units) in best.items())
                groups = [g for g in groups if g[0] not in best]
                near, far = far, 2 * far

    block, size = [], 0
    for r in ends.toLocalIterator(prefetchPartitions=True):
        if block and size > BROADCAST_BYTES:
            settle(block)
            block, size = [], 0
        block.append((r.end, r.part, r.host, tuple(r.texts)))
        size += 64 + 8 * len(r.texts)
    if block:
        settle(block)
    return out


def extract(pages: DataFrame, by_path: bool = True) -> DataFrame:
    """page_id, url, text, n_chars, n_shared, n_marked of every page; the last two count the lines that differencing and, besides, only their marks deleted.

    Without by_path lines are aligned by their texts alone. Of several longest alignments any may be taken; they have the
    same number of lines. Each page is differenced against the nearest page before and after it that isn't a copy of it, however many copies
    are between and whichever partition it is in. Shuffles the lines' hashes once (sorted by host and path). What
    comes back to the pages is what differencing left over, which is little where hosts have templates; the pages
    themselves are shuffled only where that is too much to broadcast.
    A hot host is spread over partitions by the path. A null or empty html has an empty text; a null url is its own host
    with an empty path. Repeated rows give repeated results. Only page_id, url and html are read.
    """
    spark = pages.sparkSession
    shared_folder(spark)
    bounded_batches(spark)
    host, path = host_and_path(F.col("url"))
    base = spread(pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")).withColumn("mark", F.xxhash64("page_id", "url", "html"))

    def cut(batches):
        for batch in batches:
            units = [units_of(lines_of(t.decode("utf-8", "replace"))) for t in texts_of(batch, "html")]
            texts, paths, kinds = zip(*units) if units else ((),) * 3
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("path"), batch.column("mark"), pa.array(texts, _LONGS), pa.array(paths, _LONGS), pa.array(kinds, pa.binary())], names=["host", "path", "mark", "texts", "paths", "kinds"])

    cuts = base.select(host.alias("host"), path.alias("path"), "mark", "html").mapInArrow(cut, f"host string, path string, mark bigint, {_UNITS}")
    cuts = cuts.checkpoint()  # small; a sort by range computes its input twice
    columns = ["host", "path", "mark"]
    order = {False: columns, True: [F.desc(c) for c in columns]}
    # Partition numbers are kept in a checkpoint: the ranges of a sort are drawn anew whenever it is computed.
    ranged = cuts.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("part", F.spark_partition_id()).checkpoint()
    met = ranged.mapInArrow(walk(False, by_path), _MET).unionByName(ranged.sortWithinPartitions(*order[True]).mapInArrow(walk(True, by_path), _MET)).checkpoint()
    seen = across(ranged, met.where("mark is null"), order)
    pages_met = spark.createDataFrame(seen, "end bigint, texts2 array<bigint>, paths2 array<bigint>, kinds2 binary")
    if sum(16 * len(x[1]) + 64 for x in seen) <= BROADCAST_BYTES:
        pages_met = F.broadcast(pages_met)

    def settle(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("texts", "paths", "kinds", "texts2", "paths2", "kinds2")]
            left = [unshared(x[:3], x[3:] if x[3] is not None else None, by_path) for x in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column("mark"), batch.column("side"), pa.array(left, pa.list_(pa.int32()))], names=["mark", "side", "left"])

    waited = met.where("mark is not null and end is not null").join(pages_met, "end", "left").select("mark", "side", "texts", "paths", "kinds", "texts2", "paths2", "kinds2").mapInArrow(settle, "mark bigint, side int, left array<int>")
    found = met.where("left is not null").select("mark", "side", "left").unionByName(waited.where(F.size("left") > 0))
    sides = found.groupBy("mark").agg(*(F.max(F.when(F.col("side") == k, F.col("left"))).alias(f"left{k}") for k in (0, 1)))
    # Where a side has no row, it shares everything.
    decided = sides.select("mark", F.array_intersect("left0", "left1").alias("left")).where(F.size("left") > 0).checkpoint()
    size = decided.agg(F.sum(16 + 4 * F.size("left"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        decided = F.broadcast(decided)

    def finish(batches):
        for batch in batches:
            out = [main_text(t.decode("utf-8", "replace"), x or ()) for t, x in zip(texts_of(batch, "html"), batch.column("left").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([x[0] for x in out], pa.string()), pa.array([len(x[0]) for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_shared", "n_marked"])

    return base.join(decided, "mark", "left").select("page_id", "url", "html", "left").mapInArrow(finish, "page_id bigint, url string, text string, n_chars bigint, n_shared bigint, n_marked bigint")
