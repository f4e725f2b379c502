"""Main text of web pages: page structure first, and for pages without an article the runs that no other page of
the host repeats."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common, words

#: Tokens that a repeated substring needs; of a block at least so much must be covered for it to go.
RUN, COVERED = 8, 0.8
#: Pages of different content of a host that must hold a substring for it to be repeated; all of them, where there are
#: fewer than LEAST.
LEAST = 3
#: Pages whose runs meet in one group, about; a group's runs are sorted in a worker.
PAGES = 8192
#: Bytes of a run's hash beside the bits that deal runs out to groups.
KEY = 6
#: Rows of counts that are sent to all tasks; more are joined.
SENT = 2_000_000

_RAW = frozenset("script style noscript template iframe svg math canvas object textarea select title".split())
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"[>\"']")
#: One attribute, its name and value; they are read from left to right, so nothing in a value passes for a name.
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]+))?""")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br td th input meta link source picture".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end by themselves, so that they never hold a zone open.
_LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot option colgroup h1 h2 h3 h4 h5 h6".split()) | _INLINE | _VOID
_CHROME = frozenset("head nav header footer aside form button menu dialog fieldset".split())
#: Of these, what isn't chrome for an article inside: some pages are one form.
_AROUND = frozenset("head form fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_WORDS = frozenset(
    "nav navbar navigation menu footer header masthead sidebar aside ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login breadcrumb breadcrumbs pagination pager share sharing social related recommended comment comments commentlist respond reply replies disqus toolbar widget search copyright skip".split()
)
#: Beside one of these the words above describe a page's layout or an article's own parts.
_LAYOUT = frozenset("article post entry content main body page wrapper container layout with has no".split())
#: These are chrome within an article's own class names too, except where the element frames the page.
_ALWAYS = frozenset("comment comments sidebar advertisement ads share sharing social newsletter related".split())
_FRAME = frozenset("with has no wrapper container layout page".split())
#: These name a subject as well as a part of a page; they are chrome by themselves or beside one of the others.
_SUBJECTS = frozenset("search share sharing social notice alert menu copyright navigation subscription".split())
_PARTS = frozenset("form box bar field button buttons icon icons link links widget block area site page top bottom main header footer nav global toggle overlay wrapper container list item items inner".split())


#: Headings of these words alone stand over the comments of readers.
_TALK = frozenset("comment comments reply replies response responses discussion reader readers leave your a the and to from".split())


def hints(attrs: str) -> tuple[bool, str]:
    """(the element is chrome, "main" or "article" if it holds one) as its attributes say."""
    chrome, kind = False, ""
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            for one in value.split():
                parts = set(re.split(r"[^a-z]+", one)) - {""}
                known = parts & _WORDS
                if known <= _SUBJECTS and parts - known - _PARTS - _LAYOUT:
                    continue
                chrome |= bool(known) and not parts & _LAYOUT
                chrome |= bool(parts & _ALWAYS) and not parts & _FRAME
        elif name == "role":
            chrome |= value in _ROLES
            kind = value if value in ("main", "article") else kind
        elif name == "itemprop":
            kind = "article" if value == "articlebody" else kind
            chrome |= value == "comment"
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            chrome = True
        elif name == "style":
            chrome |= bool(re.search(r"display\s*:\s*none", value))
    return chrome, kind


def tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text or "", name of a tag or "", whether it ends an element, attributes) in page order; comments, declarations
    and elements without readable text come as a blank.  Every character is passed once: a tag ends at the first > outside
    quotes, a quote that is never closed is an ordinary character, and where no > is left all that follows is text."""
    at, size = 0, len(page)
    open_quotes = {'"': True, "'": True}
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            begin = size
        if begin > at:
            yield page[at:begin], "", False, ""
        if begin == size:
            return
        at = begin
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            at = size if end < 0 else end + 3
            continue
        name = _NAME.match(page, at)
        if name is None:
            end = page.find(">", at) if page[at + 1 : at + 2] in ("!", "/", "?") else -1
            if end < 0:
                yield "<", "", False, ""
                at += 1
            else:
                at = end + 1
            continue
        here, end = name.end(), -1
        while (mark := _MARK.search(page, here)) is not None:
            here = mark.end()
            if mark.group() == ">":
                end = here
                break
            if open_quotes[mark.group()]:
                close = page.find(mark.group(), here)
                open_quotes[mark.group()] = close >= 0
                here = max(here, close + 1)
        if end < 0:
            end = page.find(">", name.end()) + 1
            if not end:
                yield page[at:], "", False, ""
                return
        tag, closing = name.group(1).lower(), page[at + 1] == "/"
        attrs = page[name.end() : end - 1]
        at = end
        if not closing and tag in _RAW:
            close = _CLOSE[tag].search(page, at)
            at = size if close is None else close.end()
            yield " ", "", False, ""
            continue
        yield "", tag, closing, attrs


class Region:
    """An ``article`` or ``main`` element, or one whose attributes call it so."""

    __slots__ = ("kind", "parent", "place", "level", "soft", "direct", "heading", "topic", "own", "total", "hidden")

    def __init__(self, kind: str, parent: int, place: int, level: int, soft: bool, direct: bool):
        self.kind, self.parent, self.place, self.level, self.soft, self.direct = kind, parent, place, level, soft, direct
        self.heading, self.topic, self.own, self.total, self.hidden = False, -1, 0, 0, False


def chosen(regions: list[Region], shut: list[tuple[int, int]]) -> set[int]:
    """The regions whose blocks are the page's article; ``shut`` are ranges of regions inside closed chrome.

    Regions under one parent and of one kind are parts of one candidate, and the candidate of most text is taken.  A
    ``main`` gives way to the articles in it if they hold more text than stands beside them, else they are part of it.
    An article within an article is part of it too, unless it stands right inside it without a heading, beside text
    of its own: then it is a comment."""
    inside = [0] * (len(regions) + 1)
    for first, last in shut:
        inside[first] += 1
        inside[last] -= 1
    depth = 0
    for i, r in enumerate(regions):
        depth += inside[i]
        above = regions[r.parent] if r.parent >= 0 else None
        r.hidden |= depth > 0 or above is not None and (above.hidden or above.kind == "article" and r.direct and not r.heading and above.own > 0)
    for r in reversed(regions):
        r.total += r.own
        if r.parent >= 0 and not r.hidden:
            regions[r.parent].total += r.total
    groups: dict[tuple, list[int]] = {}
    for i, r in enumerate(regions):
        if r.parent < 0 and not r.hidden and r.total:
            groups.setdefault((r.soft, r.place, r.kind), []).append(i)
    firm = [g for (soft, _, _), g in groups.items() if not soft] or list(groups.values())
    if not firm:
        return set()
    taken = set(max(firm, key=lambda g: sum(regions[i].total for i in g)))
    for i, r in enumerate(regions):
        if r.parent in taken and not r.hidden:
            taken.add(i)
    for i in sorted(taken):
        r = regions[i]
        if r.kind == "main" and r.total - r.own > r.own:
            taken.discard(i)
    return taken


def blocks(page: str) -> tuple[list[str], bool]:
    """(blocks of text outside chrome in page order, whether they are those of an article)."""
    found, _, article = parts(page)
    return found, article


def parts(page: str) -> tuple[list[str], list[str], bool]:
    """(blocks of text outside chrome in page order, of a page with an article those that stand in none, whether the
    first are those of an article)."""
    stack: list[tuple[str, bool, int, int, str]] = []  # (element, in chrome, region, regions before it, why chrome)
    depth: Counter[str] = Counter()  # of the elements, and of what is chrome by its attributes or as an element
    regions: list[Region] = []
    shut: list[tuple[int, int]] = []
    found: list[tuple[int, str]] = []  # (region, text)
    held: list[str] = []
    zone, held_zone, heading, serial = (False, -1), (False, -1), False, 0
    places: list[int] = []  # number of each element of the stack

    def close() -> None:
        if not held:
            return
        text = " ".join("".join(held).split())
        chrome, region = held_zone
        if text and not chrome:
            if region >= 0:
                r = regions[region]
                r.own += len(text)
                if heading:
                    r.heading = True
                    said = set(re.split(r"[^a-z]+", text.lower()[:80])) - {""}
                    r.topic = len(found) if said and said <= _TALK else -1
            found.append((region, text))
        held.clear()

    for text, name, closing, attrs in tokens(page):
        if text:
            if zone != held_zone:
                close()
                held_zone = zone
            held.append(entities.unescape(text) if "&" in text else text)
            continue
        if name in ("br", "td", "th", "img", "wbr"):
            held.append(" " if name != "wbr" else "")
        if name not in _INLINE:
            close()
            heading = name in _HEADINGS and not closing
        if closing:
            if depth[name]:
                while True:
                    last, _, _, first, why = stack.pop()
                    places.pop()
                    depth[last] -= 1
                    depth[why] -= 1
                    if last == name:
                        break
                if why == "/element" and len(regions) > first:
                    shut.append((first, len(regions)))
                zone = stack[-1][1:3] if stack else (False, -1)
            continue
        if name in _VOID or attrs.rstrip().endswith("/") and name not in ("article", "main", "div", "section"):
            continue
        chrome, kind = hints(attrs) if attrs else (False, "")
        if name in ("body", "html"):
            chrome = False
        kind = name if name in ("article", "main") else kind
        was, region = zone
        above = regions[region] if region >= 0 else None
        opens = bool(kind) and (above is None or name == "article" or above.kind == "main" and kind == "article" and not was)
        if opens and above is not None and above.topic >= 0:  # a comment under a heading that says so
            found[above.topic] = (region, "")
            chrome = True
        framing = name in _CHROME and not (name == "header" and above is not None and above.kind == "article")
        if opens and not chrome and not depth["/attribute"]:
            direct = above is not None and len(stack) - 1 == above.level
            regions.append(Region(kind, region, places[-1] if places else -1, len(stack), depth["/element"] > 0, direct))
            new, why = (False, len(regions) - 1), ""
        else:
            new = (was or chrome or framing, region)
            why = "/attribute" if chrome and name not in _CHROME else "/element" if framing and name not in _AROUND else ""
        if name in _LOOSE and not (new[0] and not was):
            continue
        serial += 1
        stack.append((name, *new, len(regions), why))
        places.append(serial)
        depth[name] += 1
        depth[why] += 1
        zone = new
    close()
    taken = chosen(regions, shut)
    outside = [text for region, text in found if text and region < 0]
    return ([text for region, text in found if text and region in taken], outside, True) if taken else (outside, [], False)


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, row, text of the article or null, and the open blocks: those of a page without an article, or those
    beside a page's articles, which tell what its host repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, opens = [], []
            for page in batch.column("html").to_pylist():
                found, beside, article = parts(page or "")
                texts.append("\n".join(found) if article or not found else None)
                opens.append((beside if article else found) or None)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("row"), pa.array(texts, pa.string()), pa.array(opens, pa.list_(pa.string()))], ["page_id", "url", "row", "text", "open"])

    return pages.mapInArrow(run, "page_id bigint, url string, row bigint, text string, open array<string>")


def runs_of(name: str, found: list[str]) -> np.ndarray:
    """A hash of the host and of the RUN tokens that begin at each token of the blocks, in page order."""
    hashes = np.array([xxhash.xxh3_64_intdigest(t) for b in found for t in b.split()], np.uint64)
    n = max(len(hashes) - RUN + 1, 0)
    total = np.full(n, xxhash.xxh3_64_intdigest(name), np.uint64)
    for i in range(RUN if n else 0):
        total = (total ^ (total >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n + i]
    return total


def dealt(pages: DataFrame, bits: int) -> DataFrame:
    """The host suffix table of whole pages, an article's blocks too, packed: a row for each group of runs and some
    pages in a row, with the hashes' KEY bytes and the steps from the page of one run to that of the next.  A step too
    long for a byte is made by entries of hash 0, which no run has."""

    def packed(names: list[str], texts: list[list[str]], first: int) -> Iterator[tuple[int, int, bytes, bytes]]:
        ids = [runs_of(n, t) for n, t in zip(names, texts)]
        page = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        key = words.mix(np.concatenate(ids))
        group = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
        order = np.argsort(group, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            if not len(part):
                continue
            step = np.diff(page[part], prepend=0)
            last = np.cumsum(step // 255 + 1) - 1
            steps, keys = np.full(last[-1] + 1, 255, np.uint8), np.zeros(last[-1] + 1, np.uint64)
            steps[last], keys[last] = step % 255, np.maximum(key[part] & np.uint64((1 << 8 * KEY) - 1), np.uint64(1))
            raw = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY]
            yield int(group[part[0]]), first, np.ascontiguousarray(raw).tobytes(), steps.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts, rows = batch.column("host").to_pylist(), batch.column("blocks").to_pylist(), batch.column("row").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(rows) != 1) + 1).tolist(), len(rows)]
            out = [x for a, b in zip(cuts, cuts[1:]) if b > a for x in packed(names[a:b], texts[a:b], int(rows[a]))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary()), pa.array([x[3] for x in out], pa.binary())], ["part", "first", "keys", "steps"])

    return pages.mapInArrow(run, "part int, first bigint, keys binary, steps binary")


def repeated(pages: DataFrame, count: int) -> DataFrame:
    """(row, n_repeated): how many of a page's runs of RUN tokens another row of its host holds; pages without any are
    left out.  ``pages``: row, host, blocks; ``count``: about how many there are.  Groups hold as many runs whatever the
    table's size, and each distinct run of a group is counted once a row, so a passage of all pages is no burden."""
    bits = max(0, -(-count // PAGES) - 1).bit_length()

    def meet(table: pa.Table) -> pa.Table:
        keys, rows = [], []
        for first, raw, steps in zip(*(table.column(c).to_pylist() for c in ("first", "keys", "steps"))):
            wide = np.zeros((len(steps), 8), np.uint8)
            wide[:, :KEY] = np.frombuffer(raw, np.uint8).reshape(-1, KEY)
            keys.append(wide.view("<u8").ravel())
            rows.append(first + np.cumsum(np.frombuffer(steps, np.uint8), dtype=np.int64))
        key, row = np.concatenate(keys), np.concatenate(rows)
        held = key > 0
        key, row = key[held], row[held]
        order = np.lexsort((row, key))
        key, row = key[order], row[order]
        new = np.insert(key[1:] != key[:-1], 0, True)
        other = np.insert((key[1:] == key[:-1]) & (row[1:] != row[:-1]), 0, False)
        many = np.add.reduceat(other, np.flatnonzero(new)) > 0
        found, n = np.unique(row[many[np.cumsum(new) - 1]], return_counts=True)
        return pa.table({"row": pa.array(found, pa.int64()), "n": pa.array(n, pa.int64())})

    met = dealt(pages, bits).groupBy("part").applyInArrow(meet, "row bigint, n bigint")
    return met.groupBy("row").agg(F.sum("n").alias("n_repeated"))


def suffixes(pages: DataFrame) -> DataFrame:
    """The host suffix array as a table: for each token of a page's open blocks, in page order, a hash of the host and
    of the RUN tokens that begin there, and ``once``, 1 where the page holds them for the first time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, others = [np.zeros(0, np.uint64)], [np.zeros((4, 0), np.int64)]
            for name, key, page, found in zip(*(batch.column(c).to_pylist() for c in ("host", "host_key", "page", "open"))):
                total = runs_of(name, found)
                if n := len(total):
                    once = np.zeros(n, np.int64)
                    once[np.unique(total, return_index=True)[1]] = 1
                    ids.append(total)
                    others.append(np.stack([np.full(n, page), np.arange(n), once, np.full(n, key)]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids).astype(np.int64)), *map(pa.array, np.concatenate(others, 1))], ["suffix", "page", "start", "once", "host_key"])

    return pages.withColumn("host_key", F.xxhash64("host")).mapInArrow(run, "suffix bigint, page bigint, start bigint, once bigint, host_key bigint")


def unique_runs(pages: DataFrame) -> DataFrame:
    """(page, text): of each page of ``pages`` (``page``, ``host``, ``open``, ``asks``; pages of one host differ in
    content) that asks, the blocks that aren't covered by substrings of RUN or more tokens that LEAST pages of the host,
    or all its two, hold.  Equal suffixes meet after partial aggregation, so a passage of all pages is no burden."""
    all_ = suffixes(pages)
    sizes = pages.groupBy(F.xxhash64("host").alias("host_key")).agg(F.count("*").alias("pages"))
    shared = all_.groupBy("suffix", "host_key").agg(F.sum("once").alias("n")).filter(F.col("n") >= 2)
    repeated = shared.join(sizes, "host_key").filter(F.col("n") >= F.least(F.lit(LEAST), "pages")).select("suffix")
    covered = all_.join(repeated, "suffix").groupBy("page").agg(F.collect_list("start").alias("starts"))
    joined = pages.filter("asks").select("page", "open").join(covered, "page", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for found, starts in zip(batch.column("open").to_pylist(), batch.column("starts").to_pylist()):
                sizes = np.array([len(b.split()) for b in found])
                marks = np.zeros(int(sizes.sum()) + 1, np.int64)
                for s in starts or []:
                    marks[s] += 1
                    marks[s + RUN] -= 1
                held = np.concatenate(([0], np.cumsum(np.cumsum(marks)[:-1] > 0)))
                ends = np.cumsum(sizes)
                share = (held[ends] - held[ends - sizes]) / np.maximum(sizes, 1)
                texts.append("\n".join(b for b, x in zip(found, share) if x < COVERED))
            yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array(texts, pa.string())], ["page", "text"])

    return joined.mapInArrow(run, "page bigint, text string")


def main_text(pages: DataFrame, still: bool = False) -> DataFrame:
    """(page_id, url, text, n_chars, n_repeated) for each row of ``pages`` (``page_id``, ``url``, ``html``; others are ignored).

    The text is the blocks of the page's article: its ``article`` or ``main`` element or what its attributes call so,
    without the elements and classes of menus, headers, footers, sidebars, notices, adverts, forms and comments.  Of
    several, those under one parent are parts of one, and the one of most text is taken (see ``chosen``); articles
    inside chrome never are.  Of a page that names no article, the blocks outside such elements stay that the host's
    suffix array doesn't show on LEAST pages; what other pages have beside their articles counts there too.  Pages of
    equal text count as one, so copies don't take each other's text.  Inside a named article nothing is dropped for
    other pages' sake: quoted or copied passages are text.  All the same every page's blocks, an article's too, meet
    those of its host: ``n_repeated`` tells how many runs of RUN tokens of the text another row of the host holds.

    Character references are decoded within a run of text, never across a tag, white space inside a block becomes one
    space, blocks are joined by a line feed.  A page is read in one pass, whatever its length and depth.  Pages are
    read again for the runs and for the texts, as a table of texts would take more room than that takes time; their
    rows are numbered as they come, so a table that may come in another order is written first, unless it is
    ``still``, as files are.  A null or empty page has an empty text; a null url, or one without a host, is a host of
    its own and has no repeated runs; repeated rows are rows; an
    empty table gives none; other columns, whatever their names, are left out."""
    scratch = common.Scratch(pages.sparkSession, "html")
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    if not still:
        pages = scratch.keep(pages, "pages")
    all_ = parsed(pages.withColumn("row", F.monotonically_increasing_id()))
    open_ = scratch.keep(all_.filter("open IS NOT NULL").select("page_id", "url", "row", "open", F.col("text").isNull().alias("asks"), F.xxhash64("open", "text").alias("said")), "open")
    asking = open_.filter("asks").select("page_id", "url", "row", F.array_join("open", "\n").alias("text"))
    text = all_.filter("text IS NOT NULL").select("page_id", "url", "row", "text")
    if not asking.isEmpty():
        hosted = open_.withColumn("host", host(F.col("url"))).filter("host <> ''").withColumn("page", F.xxhash64("host", "said"))
        distinct = scratch.keep(hosted.groupBy("page").agg(F.first("host").alias("host"), F.first("open").alias("open"), F.bool_or("asks").alias("asks")), "distinct")
        cleaned = hosted.filter("asks").select("row", "page").join(unique_runs(distinct).withColumnRenamed("text", "cleaned"), "page").select("row", "cleaned")
        asked = asking.join(cleaned, "row", "left").select("page_id", "url", "row", F.coalesce("cleaned", "text").alias("text"))
        text = text.unionByName(scratch.keep(asked, "asked"))
    own = text.withColumn("host", host(F.col("url"))).filter("host <> '' AND text <> ''").select("row", "host", F.split("text", "\n").alias("blocks"))
    counts = scratch.keep(repeated(own, pages.count()), "counts")
    text = text.join(F.broadcast(counts) if counts.count() <= SENT else counts, "row", "left")
    return text.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), F.coalesce("n_repeated", F.lit(0)).cast("bigint").alias("n_repeated"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(common.table(spark, sf_dir, "pages"), still=True)
