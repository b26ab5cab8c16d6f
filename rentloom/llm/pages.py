"""Main text of web pages: lines that a page shares with its nearest page go, lines of its article stay."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentloom.llm.batches import row_key, stored, typed
from rentloom.llm.neighbours import with_neighbours

ARTICLE, OTHER, OUTSIDE = 0, 1, 2
EMITTED = 256
TABLE_BITS = 1 << 28       # an alignment of more bits than this is halved

# Fixed values of the markup language, and names that mark the parts of a page that are not its article.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr
ul""".split())
CHROME = frozenset("""aside audio button canvas datalist dialog footer form head header iframe input label menu nav noscript object option
select svg template textarea title video""".split())
MARKS = frozenset("""ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies
disclaimer footer header login menu nav navbar navigation newsletter notice notification popup promo promotion related replies share
sharing sidebar social sponsor sponsored subscribe toolbar widget""".split())
CONTAINERS = frozenset("center details div dl fieldset ol section table ul".split())
ROLES = frozenset("banner complementary contentinfo dialog form menu menubar navigation search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style")

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:[^"'>]|"[^"]*"|'[^']*')*)>""", re.IGNORECASE | re.DOTALL | re.VERBOSE)
_NAMED = re.compile(r"class|id|role|hidden", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PARTS = re.compile(r"[-_]+")


def _attributes(rest: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name, with lower-case values; the first of a name counts."""
    found: dict[str, str] = {}
    if _NAMED.search(rest):
        for name, *values in _ATTRIBUTE.findall(rest):
            found.setdefault(name.lower(), "".join(values).lower())
    return found


def _marked(token: str) -> bool:
    """Whether a name consists of marks only, as ``cookie-notice`` does and ``ad-hoc`` does not."""
    return MARKS.issuperset(_PARTS.split(token))


def _is_chrome(name: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether an element is no part of an article; ids inside an article name its sections and say nothing."""
    if name in CHROME or "hidden" in attributes:
        return True
    if not ROLES.isdisjoint(attributes.get("role", "").split()[:1]):
        return True
    if name not in CONTAINERS:
        return False
    return any(map(_marked, attributes.get("class", "").split())) or not in_article and _marked(attributes.get("id", "").strip())


def page_lines(page: str) -> list[tuple[int, str]]:
    """(zone, text) of the blocks of a page in order, without its markup, scripts and styles.

    Zone ARTICLE is inside an ``article`` or ``main`` element, zone OUTSIDE in a
    part that is marked as no article, such as a menu or an advert. White space
    in a block, line breaks included, becomes one space. Open elements are a
    stack: an end tag closes everything inside its element, an unmatched one
    nothing.
    """
    lines: list[tuple[int, str]] = []
    stack: list[tuple[str, bool, bool]] = []      # name, chrome, article
    chrome = article = 0
    text: list[str] = []
    outside: list[str] = []      # text of a marked part; one inside a paragraph does not cut it in two

    def close() -> None:
        for held, zone in ((text, ARTICLE if article else OTHER), (outside, OUTSIDE)):
            if held:
                joined = "".join(held)
                if "&" in joined:
                    joined = html.unescape(joined)
                if line := " ".join(joined.split()):
                    lines.append((zone, line))
                held.clear()

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            (outside if chrome else text).append(page[at:token.start()])
        at = token.end()
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            (outside if chrome else text).append(" ")
            continue
        if name in BLOCKS:
            close()
        if token["end"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                for _, was_chrome, was_article in stack[depth:]:
                    chrome -= was_chrome
                    article -= was_article
                del stack[depth:]
        elif name not in VOID and not token["rest"].endswith("/"):
            if name == "p":      # a paragraph ends the one before it
                while stack and stack[-1][0] in ("p", "b", "i", "em", "strong", "span", "a") and any(s[0] == "p" for s in stack):
                    _, was_chrome, was_article = stack.pop()
                    chrome -= was_chrome
                    article -= was_article
            attributes = _attributes(token["rest"])
            starts = name in ("article", "main") or attributes.get("role") == "main"
            if starts and chrome and not any(s[0] in ("article", "main") for s in stack):
                # An element left open before the article does not swallow it.
                stack = [(n, False, a) for n, _, a in stack]
                chrome = 0
            hides = not starts and _is_chrome(name, attributes, article > 0)
            stack.append((name, hides, starts))
            chrome += hides
            article += starts
    (outside if chrome else text).append(page[at:])
    close()
    return lines


def _vectors(mine: list[str], other: list[str]) -> Iterator[int]:
    """After every line of ``mine``, the row of the table of common lengths: bit j is 0 where the length grows at other[j]."""
    places: dict[str, list[int]] = {}
    for j, line in enumerate(other):
        places.setdefault(line, []).append(j)
    often: dict[str, int] = {}         # bits of lines with many places: few, so that they can be kept
    full = (1 << len(other)) - 1
    row = full
    for line in mine:
        bits = often.get(line)
        if bits is None:
            held = bytearray(len(other) // 8 + 1)
            for j in places.get(line, ()):
                held[j >> 3] |= 1 << (j & 7)
            bits = int.from_bytes(held, "little")
            if len(places.get(line, ())) > 64:
                often[line] = bits
        grown = row & bits
        row = ((row + grown) | (row - grown)) & full
        yield row


def _lengths(mine: list[str], other: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of ``mine`` and every beginning of ``other``."""
    row = 0
    for row in _vectors(mine, other):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(other) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(other)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def _aligned(mine: list[str], other: list[str]) -> list[int]:
    """Positions in ``mine`` of a longest common subsequence; large tables are halved, so memory is bounded."""
    if not mine or not other:
        return []
    if len(mine) > 1 and len(mine) * len(other) > TABLE_BITS:
        half = len(mine) // 2
        cut = int((_lengths(mine[:half], other) + _lengths(mine[:half - 1:-1], other[::-1])[::-1]).argmax())
        return _aligned(mine[:half], other[:cut]) + [half + i for i in _aligned(mine[half:], other[cut:])]
    rows = [(1 << len(other)) - 1, *_vectors(mine, other)]
    found, i, j = [], len(mine), len(other)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.append(i)
    return found


def shared_lines(mine: list[str], other: list[str]) -> set[int]:
    """Positions in ``mine`` of a longest common subsequence of both lists, lines that repeat included."""
    least = min(len(mine), len(other))
    low = next((i for i in range(least) if mine[i] != other[i]), least)
    high = next((i for i in range(least - low) if mine[-1 - i] != other[-1 - i]), least - low)
    rest = other[low:len(other) - high]
    both = set(rest).intersection(mine[low:len(mine) - high])
    at = [i for i in range(low, len(mine) - high) if mine[i] in both]
    found = _aligned([mine[i] for i in at], [line for line in rest if line in both])
    return {*range(low), *range(len(mine) - high, len(mine)), *(at[i] for i in found)}


def content(lines: list[tuple[int, str]]) -> list[int]:
    """Positions of the lines inside articles; if the markup names no article, of all lines in no part marked otherwise."""
    return [i for i, (zone, _) in enumerate(lines) if zone == ARTICLE] or [i for i, (zone, _) in enumerate(lines) if zone == OTHER]


def main_text(lines: list[tuple[int, str]], near: list[tuple[int, str]] | None) -> tuple[str, int, int, int]:
    """The lines a page does not share with the nearest one; how many it shares, and of how many lines the markup says otherwise.

    All lines of both pages are aligned, menus and footers included. The markup
    is a check afterwards: shared lines of a marked article are rescued, and
    lines that are not shared but lie outside the article, or in a part that is
    marked as something else, go as well. (text, shared, rescued, cut).
    """
    own, mine = content(lines), [line for _, line in lines]
    shared = shared_lines(mine, [line for _, line in near]) if near else set()
    marked = bool(own) and lines[own[0]][0] == ARTICLE
    kept = [i for i in own if marked or i not in shared]
    rescued = sum(i in shared for i in kept)
    return "\n".join(mine[i] for i in kept), len(shared), rescued, len(mine) - len(shared) - (len(kept) - rescued)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the content of every page, null without any."""
    for batch in batches:
        digests = []
        for body in batch.column("_page").to_pylist():
            lines = page_lines(body)
            digests.append(xxhash.xxh3_128_digest("\n".join(lines[i][1] for i in content(lines)).encode("utf-8", "replace")) if lines else None)
        others = [n for n in batch.schema.names if n != "_page"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in others), pa.array(digests, pa.binary())], [*others, "content"])


def _copies(picked: DataFrame) -> DataFrame:
    """Rows (``_k1``, ``_k2``) whose content an earlier row of the same host has, with the key of the first such row, stored."""
    narrow = picked.where("_key IS NOT NULL").select(F.substring_index("_key", "\x01", 1).alias("host"), "_key", "_id", "_k1", "_k2", "_page")
    schema = f"host string, _key string, {typed(picked, '_id')}, _k1 long, _k2 long, content binary"
    marks = stored(narrow.mapInArrow(_contents, schema).where("content IS NOT NULL").distinct(), "contents")
    first = marks.groupBy("host", "content").agg(F.min(F.struct("_key", "_id", "_k1", "_k2")).alias("first"), F.count(F.lit(1)).alias("rows"))
    pairs = marks.join(first.where("rows > 1"), ["host", "content"]).select("_k1", "_k2", F.col("first._k1").alias("l1"), F.col("first._k2").alias("l2"))
    return stored(pairs.where("_k1 != l1 OR _k2 != l2"), "copies")


def _short(zone: int, line: str) -> str:
    """A line as it is compared: of long lines outside the article, which no result has, a hash."""
    return line if zone != OUTSIDE or len(line) <= 16 else xxhash.xxh3_64_hexdigest(line.encode("utf-8", "replace"))


def _lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as their lines, one line of text each with its zone before it, compressed for the shuffle; empty without lines."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        held = ["\n".join(f"{z}{_short(z, t)}" for z, t in page_lines(body)).encode("utf-8", "replace") for body in batch.column("_page").to_pylist()]
        held = [pack(lines) if lines else b"" for lines in held]
        others = [n for n in batch.schema.names if n != "_page"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in others), pa.array(held, pa.binary())], [*others, "_lines"])


def extract_pages(pages: DataFrame, id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Main text of every page: ``id``, ``url``, ``text``, ``n_chars``, ``n_shared``, ``n_rescued``, ``n_cut``.

    Pages are sorted by host and path; the page before or after on the same
    host whose path shares the longer beginning (the one after, if equal) is
    the nearest. The lines of both are aligned by their longest common
    subsequence and shared lines are deleted; see :func:`main_text` for what the
    markup says afterwards, and on how many lines. Pages of one host with the
    same content are one page, at the first path, so copies are nobody's
    nearest: each gets the text of the first. Equal URLs follow by id, then by
    their lines. Pages without URL have no nearest page. Null and empty html
    gives an empty text. One output row per input row; an empty table gives
    none; other columns are not read. The pages are read twice; what is
    shuffled are their lines, and where there are many copies the texts again;
    a task holds three pages at a time.
    """
    host = F.regexp_extract(F.lower(F.col(url)), r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1)
    path = F.regexp_replace(F.col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?[^/?#]*", "")
    picked = pages.select(F.col(id).alias("_id"), F.col(url).alias("_url"), F.coalesce(F.col(page), F.lit("")).alias("_page"),
                          F.when(F.col(url).isNotNull(), F.concat(host, F.lit("\x01"), path)).alias("_key"))
    picked = picked.select("*", *row_key("_id", "_url", "_page"))
    copies = _copies(picked)
    found = ["text", "n_chars", "n_shared", "n_rescued", "n_cut"]
    columns = [F.col("_id").alias(id), F.col("_url").alias(url), *found]
    if copies.isEmpty():
        return _differences(picked).select(*columns)
    texts = stored(_differences(picked.join(copies, ["_k1", "_k2"], "left_anti")), "texts", "zstd")
    firsts = texts.join(copies.select(F.col("l1").alias("_k1"), F.col("l2").alias("_k2")).distinct(), ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])
    firsts = firsts.select(F.col("_k1").alias("l1"), F.col("_k2").alias("l2"), *found)
    copied = picked.select("_id", "_url", "_k1", "_k2").join(copies, ["_k1", "_k2"]).join(firsts, ["l1", "l2"])
    return texts.select(*columns).unionByName(copied.select(*columns))


def _differences(picked: DataFrame) -> DataFrame:
    """Main text of pages, of which only repeated rows have the same content on one host."""
    kinds = f"{typed(picked, '_id', '_url')}, _key string, _k1 long, _k2 long"
    lined = picked.select("_id", "_url", "_key", "_k1", "_k2", "_page").mapInArrow(_lines_of, f"{kinds}, _lines binary")
    ordered = with_neighbours(lined, "_key", "_id", "_lines", keys=picked).select("_id", "_url", "_k1", "_k2", "_lines", "_key", "_bucket", "_copy")
    schema = f"{typed(picked, '_id', '_url')}, _k1 long, _k2 long, text string, n_chars long, n_shared long, n_rescued long, n_cut long"

    def nearest(key: str, others: tuple) -> list | None:
        host = key.split("\x01", 1)[0] + "\x01"
        there = [o for o in others if o and o[0].startswith(host)]
        return min(there, key=lambda o: -len(commonprefix([key, o[0]])))[1] if there else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        before = here = None      # (key, lines, bucket, content); rows that repeat are counted
        pending: list[list] = []  # [number, row] of the rows here

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            kinds = (*types, pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                              ["_id", "_url", "_k1", "_k2", "text", "n_chars", "n_shared", "n_rescued", "n_cut"])

        def emit(following: tuple | None) -> Iterator[pa.RecordBatch]:
            if pending:
                text, *counts = main_text(here[1], nearest(here[0], (following, before)) if here[0] is not None else None)
                for times, row in pending:
                    for _ in range(times):
                        out.append((*row, text, len(text), *counts))
                        if len(out) >= EMITTED:
                            yield flush()
                pending.clear()

        types, unpack = None, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            types = batch.schema.field("_id").type, batch.schema.field("_url").type
            for start in range(0, batch.num_rows, EMITTED):
                part = batch.slice(start, EMITTED)
                for *row, body, key, bucket, copy in zip(*(part.column(i).to_pylist() for i in range(8)), strict=True):
                    lines = [(int(x[0]), x[1:]) for x in unpack(body).decode().split("\n")] if body else []
                    same = key and (key.split("\x01", 1)[0], [lines[i] for i in content(lines)])
                    if key is None or here is None or here[2] != bucket or here[3] != same or not lines:
                        inside = key is not None and here is not None and here[2] == bucket
                        now = key, lines, bucket, same
                        yield from emit(now if inside else None)
                        before, here = here if inside else None, now
                    if copy == 0:
                        if pending and pending[-1][1] == row:
                            pending[-1][0] += 1
                        else:
                            pending.append([1, row])
        yield from emit(None)
        if out:
            yield flush()

    return ordered.mapInArrow(run, schema)
