"""Main text of web pages: structure first, host-wide repetition for what structure leaves open.

A page is read once into text blocks, in one scan of its markup that takes time in proportion to its length however
broken it is. Containers may be main text (``article``, ``main``, or a class or id that says so) or noise (menus,
headers, footers, sidebars, notices, adverts, forms, comments). The share of text chooses: nested main containers stand
for the outer one if they hold nearly all its text, a class word never makes an ``article`` or ``main`` with most of
the text noise (but for reader comments), and main containers with little of a page's open text are passed over. End
tags of ``head``, ``p``, list items and cells may be left out; an ``article`` in a menu that never ends lies beside it.
If a page has main containers, the text is theirs without the noise inside them. If it has none, its open blocks
are the text, without the runs that other pages of the host repeat.

Runs are found by windows, not by a suffix array: every ``RUN`` tokens in a row of a page's stream are hashed with the
host, and a hash that two different pages of the host have is a repeated run. A run of RUN tokens or more is a chain
of such windows, so the covered tokens are the ones that sorted suffixes and their common prefixes of at least RUN
would give; lengths are not needed. Hashes are combined before they are shuffled and spread by key, so one host may
own most pages. All text outside main containers enters the streams. Pages of a host with equal blocks are copies of one
page and count as one: what only whole copies share is kept. Inside main containers nothing is removed for
being repeated: articles quote each other.

Null html gives empty text. Unclosed tags, unfinished comments and entities, and scripts with markup in
strings are tolerated; the text of raw elements is never shown. Rows that repeat a page are extracted each.
An empty table gives no rows. Very long pages are read whole, at about a second for each million characters.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .shared import stored

RUN = 8

#: Nested main containers stand for the outer one if they hold this share of its text.
NESTED_SHARE = 0.8
#: Main containers decide if they hold at least this share of a page's open text.
MAIN_SHARE = 0.25

# Names of elements, and words in class, id or role, that tell what a container is.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr"
    " mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split()
)
NOISE_ELEMENTS = frozenset("nav header footer aside form button select option dialog menu noscript head svg template annotation".split())
COMMENT_WORDS = frozenset("comment comments disqus".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice notices"
    " alert sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead share"
    " sharing social related recommended newsletter subscribe popup modal pagination contentinfo complementary search".split()
)
# Words that also stand in the names of containers of the text itself: the share of text decides.
DOUBTFUL_WORDS = frozenset("alert banner header masthead notice notices promo recommended related search share sharing social".split())
MAIN_WORDS = frozenset("article content main post entry story".split())
HEAD_PARTS = frozenset("base basefont bgsound link meta noscript script style template title".split())
# Elements that end an open paragraph, and open siblings that an element ends.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup"
    " hr main menu nav ol p pre section table ul".split()
)
ENDS_SIBLING = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
}

_NAME = re.compile(r"</?([A-Za-z][^\s/>]*+)")
_QUOTE = re.compile(r"=\s*+([\"'])")
_CLOSE_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_MARK = re.compile(r"(?<![\w-])(?:class|id|role)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++)", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_NUMBER = re.compile(r"&#0*+([0-9]{8,});?")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes) and ("close", name, "") of a page, in one scan.

    No place is read more than a fixed number of times, however broken the markup. A tag, comment or raw element
    that never ends takes the rest of the page, as in browsers; a quote that never ends is no quote.
    """
    at, size = 0, len(page)
    missing: set[str] = set()  # what does not occur from here on

    def find(what: str, begin: int) -> int:
        if what in missing:
            return -1
        found = page.find(what, begin)
        if found < 0:
            missing.add(what)
        return found

    def tag_end(begin: int) -> int:
        end = find(">", begin)
        while end >= 0:
            quote = _QUOTE.search(page, begin, end)
            shut = find(quote[1], quote.end()) if quote else -1
            if shut < 0:
                return end
            begin = shut + 1
            if end < begin:
                end = find(">", begin)
        return end

    while at < size:
        sign = find("<", at)
        if sign != at:
            yield "text", page[at : size if sign < 0 else sign], ""
            if sign < 0:
                return
        name = _NAME.match(page, sign)
        if name is None:
            if page.startswith("<!--", sign):
                at = sign + 5 if page.startswith("<!-->", sign) else find("-->", sign + 4) + 3
                if at == 2:
                    return
            elif page.startswith(("<!", "<?", "</"), sign) and not page.startswith(("</ ", "</\n"), sign):
                at = find(">", sign) + 1
                if at == 0:
                    return
            else:
                yield "text", "<", ""
                at = sign + 1
            continue
        end = tag_end(name.end())
        if end < 0:
            return
        at = end + 1
        lower = name[1].lower()
        if page[sign + 1] == "/":
            yield "close", lower, ""
            continue
        yield "open", lower, page[name.end() : end]
        if lower in RAW:
            shut = _CLOSE_RAW[lower].search(page, at)
            if shut is None:
                return
            at = shut.start()


def plain(text: str) -> str:
    """Text with its character references decoded; numbers beyond Unicode become the replacement character."""
    if "&" not in text:
        return text
    return html.unescape(_NUMBER.sub("\ufffd", text) if "&#" in text else text)


CLEAR, WEAK, STRONG = 0, 1, 2


class Scope:
    """A container that may be main text or noise; ``parent`` is the scope around it."""

    __slots__ = ("parent", "rank", "noise", "doubtful", "lifts", "ended", "size", "total")

    def __init__(self, parent: int, rank: int, noise: int, doubtful: bool, lifts: bool):
        self.parent, self.rank, self.noise, self.doubtful, self.lifts = parent, rank, noise, doubtful, lifts
        self.ended, self.size, self.total = False, 0, 0


def _kind(name: str, rest: str, inside_main: bool) -> tuple[int, int, bool]:
    """(rank as a main container, noise, whether only doubtful words say so) of an element."""
    if name in ("html", "body"):
        return 0, CLEAR, False
    words: set[str] = set()
    if "=" in rest:
        for m in _MARK.finditer(rest):
            words.update(_SPLIT.split(m[1].lower()))
    if words & COMMENT_WORDS or (name in NOISE_ELEMENTS and not (name == "header" and inside_main)):
        return 0, STRONG, False
    if name in ("article", "main"):
        return 3 if name == "article" else 2, CLEAR, False
    marked = words & NOISE_WORDS
    if inside_main:
        marked -= {"header", "banner"}
    if marked:
        return 0, WEAK, marked <= DOUBTFUL_WORDS
    return 2 if "main" in words else 1 if words & MAIN_WORDS else 0, CLEAR, False


def _read(page: str) -> tuple[list[tuple[str, int, bool]], list[Scope]]:
    """(text, scope, heading) of every block, and the scopes; the first scope is the page."""
    out: list[tuple[str, int, bool]] = []
    scopes = [Scope(-1, 0, CLEAR, False, False)]
    stack: list[tuple[str, int, bool]] = []  # name, scope, whether it opened the scope
    opened: dict[str, int] = {}
    text: list[str] = []
    scope, inside = 0, [False]  # inside: whether a scope lies in a main container
    heading = False

    def close() -> None:
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                out.append((joined, scope, heading))

    def pop(explicit: bool) -> None:
        nonlocal scope
        name, _, own = stack.pop()
        opened[name] -= 1
        if own and explicit:
            scopes[scope].ended = True
        scope = stack[-1][1] if stack else 0

    for kind, what, rest in tokens(page):
        if stack and stack[-1][0] == "head" and (
            what.strip() if kind == "text" else kind == "open" and what not in HEAD_PARTS
        ):  # the end tag of a head may be left out
            close()
            pop(True)
        if kind == "text":
            text.append(plain(what))
            continue
        if kind == "close":
            if opened.get(what, 0):
                if what not in INLINE or any(own for _, _, own in stack[-1:]):
                    close()
                while stack[-1][0] != what:
                    close()
                    pop(False)
                pop(True)
            elif what not in INLINE:
                close()
            heading = heading and what != "h1"
            continue
        rank, noise, doubtful = (0, CLEAR, False) if what == "a" else _kind(what, rest, inside[scope])
        if what in INLINE and noise == CLEAR:
            if opened.get(what, 0) and what not in VOID and not rest.endswith("/"):
                stack.append((what, scope, False))
                opened[what] += 1
            continue
        close()
        if what in VOID:
            continue
        heading = what == "h1" or (heading and what in INLINE)
        if what in RAW:
            noise = STRONG
        if what in ENDS_PARAGRAPH and stack and stack[-1][0] == "p":
            pop(True)
        sibling = ENDS_SIBLING.get(what)
        if sibling:
            if stack and stack[-1][0] == "p" and len(stack) > 1 and stack[-2][0] in sibling:
                pop(True)
            while stack and stack[-1][0] in sibling:
                pop(True)
        if rest.endswith("/") and what not in RAW:
            continue
        own = bool(rank or noise)
        if own:
            scopes.append(Scope(scope, rank, noise, doubtful and what not in INLINE, what == "form"))
            inside.append(inside[scope] or rank > 0)
            scope = len(scopes) - 1
        stack.append((what, scope, own))
        opened[what] = opened.get(what, 0) + 1
    close()
    return out, scopes


def blocks(page: str | None) -> list[tuple[str, bool, bool]]:
    """(text, in a main container, noise) of the blocks of a page in order.

    An ``article`` or ``main`` in a form, or in a container of noise without an end tag, lies beside it. A container
    that only a class word calls noise is none if the word is doubtful and most of the page's text is in it; an
    ``article`` or ``main`` in it counts if it holds as much as all clear text.
    """
    found, scopes = _read(page or "")
    for text, scope, _ in found:
        scopes[scope].size += len(text)
    for s in scopes[1:]:
        while s.rank >= 2 and s.parent and scopes[s.parent].noise == STRONG and (
            scopes[s.parent].lifts or not scopes[s.parent].ended
        ):
            s.parent = scopes[s.parent].parent

    def add_up(counts: list[bool]) -> None:
        for s in scopes:
            s.total = 0
        for k in range(len(scopes) - 1, -1, -1):
            s = scopes[k]
            s.total = s.total + s.size if counts[k] else 0
            if k:
                scopes[s.parent].total += s.total

    add_up([s.noise == CLEAR or s.doubtful for s in scopes])
    whole = scopes[0].total
    for s in scopes:
        if s.noise == WEAK and s.doubtful and 2 * s.total > whole:
            s.noise = CLEAR
    level = [CLEAR] * len(scopes)
    for k, s in enumerate(scopes[1:], 1):
        level[k] = max(level[s.parent], s.noise)
    add_up([s.noise == CLEAR for s in scopes])
    clear = scopes[0].total
    for k, s in enumerate(scopes[1:], 1):
        if level[k] == WEAK and s.rank >= 2 and s.total >= clear and s.total:
            level[k] = CLEAR
        elif level[k] == WEAK and s.noise == CLEAR and level[s.parent] == CLEAR:
            level[k] = CLEAR  # inside such a container
    # The main containers: outermost ones, or those in them that hold nearly all of their text.
    around = [0] * len(scopes)  # the nearest main container that holds a scope, itself included
    inner: dict[int, list[int]] = {}
    for k, s in enumerate(scopes[1:], 1):
        upper = around[s.parent] if level[s.parent] == CLEAR else 0
        around[k] = upper
        if level[k] == CLEAR and s.rank and (not upper or s.rank > scopes[upper].rank):
            around[k] = k
            inner.setdefault(upper, []).append(k)
    chosen: set[int] = set()
    titles: set[int] = set()
    open_, outer = inner.get(0, []), 0
    held = sum(scopes[k].total for k in open_)
    high = [k for k in open_ if scopes[k].rank >= 2]
    if 2 * sum(scopes[k].total for k in high) >= held:
        open_ = high or open_
    while open_:
        outer = open_.pop()
        nested = inner.get(outer, [])
        if nested and sum(scopes[k].total for k in nested) >= NESTED_SHARE * scopes[outer].total:
            titles.add(outer)
            open_ += nested
        else:
            chosen.add(outer)
    text_of = [sum(scopes[k].total for k in chosen), sum(len(t) for t, k, _ in found if level[k] == CLEAR)]
    if text_of[0] < MAIN_SHARE * text_of[1] or not text_of[0]:
        chosen, titles = set(), set()
    of = [0] * len(scopes)  # 1: in a chosen container
    for k, s in enumerate(scopes[1:], 1):
        of[k] = int(level[k] == CLEAR and (k in chosen or of[s.parent]))
    return [
        (text, bool(of[k]) or (heading and around[k] in titles and level[k] == CLEAR), level[k] != CLEAR)
        for text, k, heading in found
    ]


def main_text(found: list[tuple[str, bool, bool]]) -> str | None:
    """The text of the main containers; None if the page has none."""
    return " ".join(t for t, main, _ in found if main) if any(main for _, main, _ in found) else None


def _outside(found: list[tuple[str, bool, bool]]) -> list[tuple[str, bool]]:
    return [(t, noise) for t, main, noise in found if not main]


def _page_hash(host: str, found: list[tuple[str, bool, bool]]) -> int:
    """Signed hash of a page's host and blocks, in main containers or not; copies of a page on a host share it."""
    parts = [("\1" if rank else "\2") + t for t, rank, _ in found]
    return int(np.uint64(xxhash.xxh3_64_intdigest("\0".join([host, *parts]))).view(np.int64))


def _windows(pages: DataFrame) -> DataFrame:
    """(key, page, place): a hash of the host and RUN tokens from each place of the page's stream outside main containers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for host, raw in zip(*(batch.column(k).to_pylist() for k in range(2))):
                found = blocks(raw)
                stream = " ".join(t for t, _ in _outside(found)).split(" ")
                page = _page_hash(host, found)
                for at in range(len(stream) - RUN + 1):
                    out.append((xxhash.xxh3_64_intdigest("\0".join([host, *stream[at : at + RUN]])), page, at))
            key, page, at = (np.array([r[k] for r in out], np.uint64 if not k else np.int64) for k in range(3))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(page), pa.array(at)], names=["key", "page", "place"]
            )

    return pages.select("host", "html").mapInArrow(run, "key long, page long, place long")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_repeated (tokens outside main containers that the host repeats) of every row."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    own = own.withColumn("host", host)
    windows = stored(_windows(own), "windows")
    groups = windows.groupBy("key").agg(F.min("page").alias("x"), F.max("page").alias("y"))
    repeated = groups.where("x <> y").select("key")
    covered = windows.join(repeated, "key").groupBy("page").agg(F.collect_set("place").alias("places"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, text, stream, open_blocks = [], [], [], []
            for host, raw in zip(*(batch.column(k).to_pylist() for k in (2, 3))):
                found = blocks(raw)
                text.append(main_text(found))
                page.append(_page_hash(host, found))
                rest = [] if text[-1] is not None else _outside(found)
                stream.append([t for t, _ in rest])
                open_blocks.append([not noise for _, noise in rest])
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(k) for k in range(2)],
                    pa.array(page, pa.int64()),
                    pa.array(text, pa.string()),
                    pa.array(stream, pa.list_(pa.string())),
                    pa.array(open_blocks, pa.list_(pa.bool_())),
                ],
                names=["page_id", "url", "page", "main", "stream", "open"],
            )

    kind = dict(own.dtypes)["page_id"]
    parsed = own.select("page_id", "url", "host", "html").mapInArrow(
        read, f"page_id {kind}, url string, page long, main string, stream array<string>, open array<boolean>"
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, n_repeated = [], []
            for main, stream, is_open, places in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                gone = {p + k for p in places or () for k in range(RUN)}
                n_repeated.append(len(gone))
                if main is None:
                    kept, at = [], 0
                    for block, keep in zip(stream, is_open):
                        tokens = block.split(" ")
                        if keep:
                            kept += [t for k, t in enumerate(tokens) if at + k not in gone]
                        at += len(tokens)
                    main = " ".join(kept)
                text.append(main)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(n_repeated, pa.int64())],
                names=["page_id", "url", "text", "n_repeated"],
            )

    joined = parsed.join(covered, "page", "left").select("page_id", "url", "main", "stream", "open", "places")
    done = joined.mapInArrow(finish, f"page_id {kind}, url string, text string, n_repeated long")
    return done.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_repeated")
