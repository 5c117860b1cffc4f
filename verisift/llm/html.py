"""HTML extraction: structure first, then a host suffix array against boilerplate.

A page is read once into blocks. Containers that are named or classed as
menus, headers, footers, sidebars, notices, adverts, forms or comments are
boilerplate, as are scripts and styles. A class counts whole: ``comments`` or
``cookie-notice`` mark a container, ``comments-open`` does not, and an article
or main element is never dropped for a class of its own. Each article element
and the main element hold the blocks that no article inside them holds; the
one with most text is the page's article, classed as boilerplate only if no
other is there. So teasers and reader comments that are articles of their own
stay out, wherever they stand.

Every page then passes the host suffix array. Blocks of pages without an
article or main element are open, and their stream is that of their tokens;
the stream of a page with an article is that of the article's blocks, since a
template puts whole blocks into an article. The suffixes of a host's streams
are ordered, and neighbours that share ``min_tokens`` tokens or more form a
run. In open streams a run is boilerplate if it stands on ``MIN_SHARE`` of the
host's distinct pages and on ``MIN_PAGES`` at least. Inside articles it must
stand on ``OWN_SHARE`` and on ``OWN_PAGES``, and a page of which it would take
more than half is a near copy of others and keeps all. What no such run covers
is kept.

The suffix order is needed to the depth of ``min_tokens`` tokens only. Suffixes
are range-partitioned in their order, so no task need hold a host, and those
equal to that depth lie side by side in one partition.

Null or empty pages, and pages without text, give an empty text; pages of any
length are read whole. Pages of equal streams count as one, whatever their ids
and urls, so copies are not boilerplate of each other; rows that repeat a page
get a row each; of articles of equal length the first is taken. Only the id,
the url and the html are read, so other columns may have any names. An empty
table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stage, text_or_empty

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAMED = frozenset(("class", "id", "role", "aria-label"))
_SPACE = re.compile(r"\s+")
#: Elements whose content is no markup; elements left out; elements that are blocks; elements without an end tag. Fixed values.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg select option object".split())
DROPPED = frozenset("head nav footer aside form button menu dialog fieldset input label canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that mark a container as boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle banner breadcrumb breadcrumbs comment comments complementary contentinfo "
    "cookie cookies consent disqus footer gdpr masthead menu menubar nav navbar navigation newsletter notice pagination popup promo promoted promotion "
    "related replies respond share sharing sidebar sidebars signup skip social sponsor sponsored subscribe toolbar widget widgets alert modal overlay login".split()
)
#: Words that may stand beside a mark in a class: of places, and of kinds of containers.
BESIDE = frozenset(
    "site page global main top bottom left right primary secondary header sticky fixed area section container wrapper wrap box bar block list links link form "
    "buttons button icons group inner outer panel slot unit item items posts articles stories thread author body text reader user leave reply div row col".split()
)
#: Distinct pages of a host, at least and as a share, that a run of boilerplate stands on; the same inside articles.
MIN_PAGES = 3
MIN_SHARE = 0.2
OWN_PAGES = 5
OWN_SHARE = 0.5
#: Pages with runs of boilerplate up to which their places are broadcast, and streams whose suffixes a task knows it has given.
SMALL = 50_000
KNOWN = 200_000
_ENDS_P = BLOCKS - {"body", "html", "head"}
_WORDS = re.compile(r"[a-z]+")


def _marked(attrs: str) -> bool:
    """Whether an element is hidden, or a whole class (id, role, label) of it is made of marks and words beside them."""
    for m in _ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            return True
        if name == "style" and any(re.fullmatch(r"\s*display\s*:\s*none\s*(?:!\s*important\s*)?", d, re.I) for d in value.split(";")):
            return True
        if name not in _NAMED:
            continue
        for one in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
            words = set(_WORDS.findall(one))
            if not MARKS.isdisjoint(words) and words <= MARKS | BESIDE:
                return True
    return False


def blocks_of(page: str | None) -> list[tuple[str, str]]:
    """(zone, text) of each block with text, in page order.

    A zone is ``article k`` (in order of their start tags; ``marked article k`` for those classed as boilerplate),
    ``main``, ``open`` or ``boilerplate``.
    """
    out: list[tuple[str, str]] = []
    if not page:
        return out
    stack: list[tuple[str, str]] = []  # open containers and the zone inside
    zone, buffer, at, end, articles = "open", [], 0, len(page), 0

    def flush() -> None:
        nonlocal buffer
        if buffer:
            text = _SPACE.sub(" ", html.unescape("".join(buffer))).strip()
            if text:
                out.append((zone, text))
            buffer = []

    while at < end:
        m = _MARKUP.search(page, at)
        if m is None:
            buffer.append(page[at:])
            break
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                buffer.append(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        name = name.lower()
        if m[1]:
            if name in BLOCKS or name in DROPPED:
                flush()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        zone = stack[-1][1] if stack else "open"
                        break
            elif stack and stack[-1][0] == name:
                flush()
                stack.pop()
                zone = stack[-1][1] if stack else "open"
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at) if not m[3].rstrip().endswith("/") else None
            if close:
                at = close.end()
            elif not m[3].rstrip().endswith("/"):
                at = end if name in ("script", "style", "title", "textarea") else at
            continue
        if name == "br":
            buffer.append("\n")
            continue
        block = name in BLOCKS or name in DROPPED
        if block:
            flush()
        if name in VOID or m[3].endswith("/") and name not in BLOCKS:
            continue
        inner = zone
        if zone != "boilerplate":
            outside = zone == "open"
            body = "itemprop" in m[3] and "articleBody" in m[3]
            if name == "article" or outside and body:
                articles += 1
                inner = f"{'marked ' if not body and _marked(m[3]) else ''}article {articles}"
            elif name == "main":
                inner = "main" if outside else zone
            elif name in DROPPED or _marked(m[3]) and name not in ("html", "body") or name == "header" and outside:
                inner = "boilerplate"
        if block:
            if name in _ENDS_P and stack and stack[-1][0] == "p":
                stack.pop()
                base = stack[-1][1] if stack else "open"
                inner = base if inner == zone and zone != base else inner
            if name != "p" or inner != (stack[-1][1] if stack else "open"):
                stack.append((name, inner))
                zone = inner
            else:
                zone = inner
        elif inner != zone:
            flush()
            stack.append((name, inner))
            zone = inner
    flush()
    return out


def main_blocks(page: str | None) -> tuple[bool, list[str]]:
    """Whether there is an article or main element, with the blocks of the one that holds most; without either, the open blocks."""
    zones: dict[str, list[str]] = {}
    for zone, text in blocks_of(page):
        zones.setdefault(zone, []).append(text)
    own = [z for z in zones if z not in ("open", "boilerplate")]
    if own:
        return True, zones[max(own, key=lambda z: (not z.startswith("marked"), sum(map(len, zones[z]))))]
    return False, zones.get("open", [])


def split_page(page: str | None) -> tuple[str, list[str]]:
    """The text of the article or main element before the host is asked; without either, the open blocks."""
    own, blocks = main_blocks(page)
    return ("\n".join(blocks), []) if own else ("", blocks)


def _parsed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            found = [main_blocks(p) for p in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([f[0] for f in found], pa.bool_()), pa.array([f[1] for f in found], pa.list_(pa.string()))],
                names=["page_id", "url", "own", "blocks"],
            )


def extract(pages: DataFrame, min_tokens: int = 8) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    rows = pages.select("page_id", "url", text_or_empty("html").alias("html"))
    kind = dict(pages.dtypes)["page_id"]
    parsed = stage(rows.mapInArrow(_parsed, f"page_id {kind}, url string, own boolean, blocks array<string>"), "html-parsed")
    return unique_runs(parsed, min_tokens).withColumn("n_chars", F.length("text").cast("long"))


def stream_of(own: bool, blocks: list[str]) -> tuple[list[str], list[int]]:
    """The symbols of a page's stream and the tokens each counts for: blocks of an article, or tokens with a mark after each block."""
    if own:
        return blocks, [t.count(" ") + 1 for t in blocks]
    symbols = [t for b in blocks for t in (*b.split(" "), "\n")]
    return symbols, [1] * len(symbols)


def reach(sizes: list[int], min_tokens: int) -> list[int]:
    """For each place the end of the shortest run from it of ``min_tokens`` tokens; places without one have no entry."""
    out, end, total = [], 0, 0
    for size in sizes:
        while total < min_tokens and end < len(sizes):
            total += sizes[end]
            end += 1
        if total < min_tokens:
            break
        out.append(end)
        total -= size
    return out


def _suffixes(min_tokens: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[tuple[str, bool, int]] = set()  # copies of a stream add nothing
        for b in it:
            for at in range(0, b.num_rows, 256):
                rows: list[tuple] = []
                for host, own, sh, blocks in zip(*[c.to_pylist() for c in b.slice(at, 256).columns], strict=True):
                    if (host, own, sh) in given:
                        continue
                    if len(given) < KNOWN:
                        given.add((host, own, sh))
                    symbols, sizes = stream_of(own, blocks)
                    ids = b"".join([xxhash.xxh64_digest(t) for t in symbols])
                    rows += [(host, own, sh, pos, ids[8 * pos : 8 * end]) for pos, end in enumerate(reach(sizes, min_tokens))]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.bool_(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["host", "own", "sh", "pos", "ids"])

    return run


def _runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes in their order: neighbours with the same first ``min_tokens`` tokens are a run; it is given if enough distinct pages have it."""
    key, pages, last, held, out = None, 0, None, [], []

    def settle() -> None:
        if key is not None and pages >= (OWN_PAGES if key[1] else MIN_PAGES):
            out.extend((*key[:2], sh, pos, pages) for sh, pos in held)

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 5
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.bool_(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["host", "own", "sh", "pos", "n"])

    for b in it:
        for host, own, sh, pos, ids in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if (host, own, ids) != key:
                settle()
                key, pages, last, held = (host, own, ids), 0, None, []
            if sh != last:
                pages, last = pages + 1, sh
            elif held[-1] == (sh, pos):  # the same stream from another task
                continue
            held.append((sh, pos))
        if len(out) >= 4096:
            yield batch()
    settle()
    yield batch()


def unique_runs(pages: DataFrame, min_tokens: int) -> DataFrame:
    """``page_id, url, text`` of ``pages`` (``page_id, url, own, blocks``): the blocks without the runs that many of the host's distinct pages share."""
    spark = pages.sparkSession
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", 1), F.lit("")))
    streams = pages.select("page_id", "url", host.alias("host"), "own", F.xxhash64("blocks").alias("sh"), "blocks")
    suffixes = streams.where(F.size("blocks") > 0).select("host", "own", "sh", "blocks").mapInArrow(_suffixes(min_tokens), "host string, own boolean, sh long, pos int, ids binary")
    ordered = suffixes.repartitionByRange(partitions(spark), "host", "own", "ids").sortWithinPartitions("host", "own", "ids", "sh", "pos")
    runs = ordered.mapInArrow(_runs, "host string, own boolean, sh long, pos int, n long")
    hosts = streams.where(F.size("blocks") > 0).select("host", "own", "sh").distinct().groupBy("host", "own").agg(F.count(F.lit(1)).alias("n_pages"))
    enough = F.col("n") >= F.when(F.col("own"), OWN_SHARE).otherwise(MIN_SHARE) * F.col("n_pages")
    starts = runs.join(hosts, ["host", "own"]).where(enough).groupBy("host", "own", "sh").agg(F.sort_array(F.collect_set("pos")).alias("starts"))
    starts = stage(starts, "html-starts")
    if starts.count() <= SMALL:  # beyond it the join shuffles
        starts = F.broadcast(starts)
    none = F.expr("cast(array() as array<int>)")
    joined = streams.join(starts, ["host", "own", "sh"], "left").select("page_id", "url", "own", "blocks", F.coalesce("starts", none).alias("starts"))
    kind = dict(pages.dtypes)["page_id"]

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [without_runs(*row, min_tokens) for row in zip(*[part.column(i).to_pylist() for i in (2, 3, 4)], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return joined.mapInArrow(cut, f"page_id {kind}, url string, text string")


def without_runs(own: bool, blocks: list[str], starts: list[int], min_tokens: int) -> str:
    """The text of a page without the runs that begin at ``starts`` of its stream."""
    if not starts:
        return "\n".join(blocks)
    symbols, sizes = stream_of(own, blocks)
    ends = reach(sizes, min_tokens)
    covered = bytearray(len(symbols))
    for i in starts:
        covered[i : ends[i]] = b"\x01" * (ends[i] - i)
    if own:
        gone = sum(n for n, c in zip(sizes, covered, strict=True) if c)
        return "\n".join(blocks if 2 * gone > sum(sizes) else [t for t, c in zip(symbols, covered, strict=True) if not c])
    kept = " ".join(t for t, c in zip(symbols, covered, strict=True) if t == "\n" or not c)
    return "\n".join(x for x in (y.strip() for y in kept.split("\n")) if x)
