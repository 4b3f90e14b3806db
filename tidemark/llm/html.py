"""Main text of web pages: a suffix array over each host's token streams, and page structure as the check of what it finds.

A page is cut into blocks (tag by tag, by HTML's tokenizer states in one pass; scripts, styles and comments never become text). A block lies in the main part (inside
<article>, else <main> or role=main), in furniture (menus, headers, footers, sidebars, forms, adverts, notices, reader comments, by
element, role, class or id), or in the rest. Furniture told only by a form element, or by a class or id that has words of its own (`layout with-sidebar`,
`menu-open`), is loose: a main part in it, or marked so itself, is one all the same, and is the page's if it holds more text than the main parts outside of furniture.
Inside a main part a class or id without any word of its own marks furniture (`share-buttons`); one with its own words (`share-price`, `newsletter-teaser`) makes the block doubtful.

The token streams of all of a host's pages, main parts too, are concatenated and sorted as a suffix array to a depth of `RUN` tokens by prefix doubling;
every token in a substring of `RUN` tokens or more that two distinct pages share is covered. Every page's text is made from what is covered:
of a page without a main part (an open page), the rest's blocks without their covered runs are the text: unique runs stay. Of a page with a main part, its main blocks are the
text, and covered runs are checked by structure: passages, lines and whole articles that pages share are content, and stay. A doubtful block goes if it is covered from end to end,
unless the article itself is a copy (half of its undoubted tokens are covered) or the doubtful blocks are not its lesser part.

A host of at most `share` pages and some `TOKENS` tokens is one run: its suffix array decides alone.
A larger host is split into hashed shares, and a share is worked off in runs of at most `TOKENS` tokens, so no host meets in one
task and memory is bounded; a page longer than that is a run of its own. For such hosts only, what pages of different shares or runs share is found by an
exchange for the pages whose text depends on it (asked pages: open ones, and those with doubtful blocks): hashes of all their windows of `RUN` tokens, and the same windows of the host's
other pages (a filter of fixed size picks them at the scan), with the least and greatest distinct page of each, go back to the asked
pages as marks. A substring of `RUN` tokens or more that distinct pages share is a chain of such windows, so both ways cover the same tokens, and a page's text does
not depend on how its host is dealt. Pages are parsed where they are read and shuffled once, compressed; those of larger hosts are parsed once more to find the asked ones.

Null or empty html gives the empty text. A null url has the empty host. Repeated rows of a page are one distinct page and give equal rows. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels, minhash, url_filter

RESULT = "page_id long, url string, text string, n_chars long"
DEALT = "page_id long, url string, host string, share int, body binary, stream long"
RUN = 8
TOKENS = 400_000
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: One attribute of a start tag, by HTML's states: a quote only opens a value right after the equals sign.
_ATTR = re.compile(r"""[\s/]*([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?|[\s/=]+""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup and no text of the page: it ends at their end tag only.
RAW = frozenset("script style title textarea noscript iframe noembed noframes".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol option p pre section select summary table tbody td template tfoot th thead tr ul".split()
)
FURNITURE = frozenset("head nav footer aside form button menu dialog select template svg".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar".split())
#: Words of classes and ids that mark furniture.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent notice notices popup modal overlay newsletter subscribe sidebar "
    "menu nav navbar navigation breadcrumb breadcrumbs footer comment comments reply replies discussion share sharing social related recommended login signup pagination "
    "pager toolbar hidden masthead".split()
)
#: Words that say nothing of a part's content. Inside a main part a class or id marks furniture only if it has no other words than these and MARKS.
NEUTRAL = frozenset("area bar block box btn button buttons container content form group icon icons inner item items left link links list outer panel posts right row section top bottom widget wrap wrapper".split())
_ENDS_P = BLOCK - {"html", "body", "button"}
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


#: Words of classes and ids of reader comments: a part named by them alone is never a main part, whatever else its classes say.
READERS = frozenset("comment comments reply replies discussion".split())
#: How sure it is that an element is furniture: a loose one is none where it turns out to hold, or to be, the page's main part.
LOOSE, SURE = 1, 2


def _marked(value: str, inside: bool) -> int:
    """How surely a class or id names furniture. Inside a main part `share-buttons` does, but not `share-price`; outside, words of its own make it loose."""
    found = 0
    every = True
    for one in value.split():
        words = {w.lower() for w in _SPLIT.split(one) if w}
        own = not words <= MARKS | NEUTRAL
        every &= not own
        if MARKS.isdisjoint(words):
            continue
        if not own and (inside or not READERS.isdisjoint(words)):
            return SURE
        found = LOOSE
    return 0 if inside else SURE if found and every else found


def _doubtful(more: list[tuple[str, str]]) -> bool:
    """Whether a class or id inside a main part has a word of furniture among words of its own."""
    return any(not MARKS.isdisjoint(w.lower() for w in _SPLIT.split(value)) for key, value in more if key in ("class", "id"))


def _furniture(name: str, more: list[tuple[str, str]], inside: bool) -> tuple[int, bool]:
    """How surely an element is furniture, and whether it begins a main part."""
    if name in FURNITURE and name != "form" or name == "header" and not inside:
        return SURE, False
    main, found = name in ("article", "main"), LOOSE if name == "form" else 0
    for key, value in more:
        if key == "role":
            if value.lower() in ROLES:
                return SURE, False
            main |= value.lower() == "main"
        elif key in ("class", "id"):
            if name not in ("html", "body"):
                found = max(found, _marked(value, inside))
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return SURE, False
    return found, main and found < SURE


def main_part(found: list[tuple[str, str]]) -> str | None:
    """The zone that is the page's main part: articles, else main elements; those in loose furniture only if they hold more text than the others."""
    size: dict[str, int] = {}
    for zone, text in found:
        size[zone] = size.get(zone, 0) + len(text)
    firm, loose = (next((z for z in zones if z in size), None) for zones in (("article", "main"), ("loose article", "loose main")))
    return loose if size.get(loose, 0) > size.get(firm, 0) else firm


def _attributes(page: str, at: int) -> tuple[list[tuple[str, str]], int]:
    """A start tag's attributes, read from `at`, and the place of its ">" (-1: the page ends first)."""
    end = page.find(">", at)
    if end <= at:
        return [], end
    found = []
    while at < len(page) and page[at] != ">":
        m = _ATTR.match(page, at)
        if m[1]:
            found.append((m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or "")))
        at = m.end()
    return found, at if at < len(page) else -1


def tokens(page: str) -> Iterator[tuple[int, int, str, bool, list[tuple[str, str]]]]:
    """Where each tag, comment or raw element begins and ends, its name ("" if it has none), whether it is an end tag, its attributes. One pass."""
    at, size = page.find("<"), len(page)
    while at >= 0:
        begin, mark = at, page[at + 1 : at + 2]
        if mark in ("!", "?"):
            end = page.find("-->", at + 4) + 2 if page.startswith("<!--", at) else page.find(">", at)
            at = size if end < at + 2 else end + 1
            yield begin, at, "", False, []
        elif mark == "/" and page[at + 2 : at + 3] == ">":
            at += 3
            yield begin, at, "", False, []
        elif m := _NAME.match(page, at + 1 + (mark == "/")):
            more, end = ([], page.find(">", m.end())) if mark == "/" else _attributes(page, m.end())
            name, at = m[0].lower(), size if end < 0 else end + 1
            if end < 0:
                yield begin, at, "", False, []  # a tag that the page's end cuts off
            elif mark != "/" and name in RAW:
                close = _RAW_END[name].search(page, at)
                end = page.find(">", close.end()) if close else -1
                at = size if end < 0 else end + 1
                yield begin, at, "", False, []
            else:
                yield begin, at, name, mark == "/", more
        elif mark == "/" and at + 2 < size:
            end = page.find(">", at)
            at = size if end < 0 else end + 1
            yield begin, at, "", False, []
        else:
            at += 1  # a plain "<"
        at = page.find("<", at)


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of all blocks in page order; zone: article, main, rest or furniture; loose article or loose main within loose furniture."""
    return [(zone, text) for zone, text, _ in parts(page)]


def parts(page: str) -> list[tuple[str, str, bool]]:
    """The blocks, and whether each is doubtful: in an element of a main part whose class or id names furniture among words of its own."""
    out: list[tuple[str, str, bool]] = []
    stack: list[tuple[str, int, str, bool]] = []  # name, how surely in furniture, main part, doubtful
    open_at: dict[str, list[int]] = {}  # places in the stack of each open name, and of all open blocks under ""
    said: list[str] = []
    zone, doubt = "rest", False

    def flush() -> None:
        if said:
            text = " ".join(entities.unescape("".join(said)).split())
            if text:
                out.append((zone, text, doubt))
            said.clear()

    def close(k: int) -> None:
        while len(stack) > k:
            name = stack.pop()[0]
            open_at[name].pop()
            if name in BLOCK:
                open_at[""].pop()

    def last(name: str) -> int:
        return open_at[name][-1] if open_at.get(name) else -1

    at = 0
    for begin, end, name, closes, more in tokens(page):
        if begin > at:
            said.append(page[at:begin])
        at = end
        if not name:
            continue
        if name == "br":
            said.append(" ")
            continue
        if name in BLOCK:
            flush()
        if closes:
            k = last(name)
            if k >= 0 and (name in BLOCK or k > last("")):  # an inline end tag never closes a block
                close(k)
        elif name not in VOID:
            if name in _ENDS_P and (k := last("")) >= 0 and (stack[k][0] == "p" or stack[k][0] == name == "li"):
                close(k)
            hidden, part, doubted = stack[-1][1:] if stack else (0, "", False)
            if hidden < SURE:
                loosely = hidden or part.startswith("loose")
                own, begins = _furniture(name, more, bool(part) and not hidden)
                if begins and (hidden or own or not part.endswith("article")):
                    part = ("loose " if loosely or own else "") + ("article" if name == "article" else "main")
                    hidden, doubted = 0, False
                else:
                    hidden = max(hidden, own)
                    doubted |= bool(part) and _doubtful(more)
            open_at.setdefault(name, []).append(len(stack))
            if name in BLOCK:
                open_at.setdefault("", []).append(len(stack))
            stack.append((name, hidden, part, doubted))
            if name == "svg" and page.endswith("/>", begin, end):
                close(len(stack) - 1)
        zone = "furniture" if stack and stack[-1][1] else (stack[-1][2] if stack else "") or "rest"
        doubt = bool(stack) and stack[-1][3]
    said.append(page[at:])
    flush()
    return out


def _packed(text: str) -> bytes:
    """Compressed, after its size: pages are exchanged, so they should be small."""
    raw = text.encode()
    return len(raw).to_bytes(8, "little") + pa.compress(raw or b" ", codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> str:
    size = int.from_bytes(packed[:8], "little")
    return pa.decompress(packed[8:], decompressed_size=max(size, 1), codec="zstd", asbytes=True)[:size].decode()


#: A block's first character says what is done with it: in an open page without its covered runs (OPEN), never text (NONE), main text (MAIN), doubtful main text (DOUBT).
OPEN, NONE, MAIN, DOUBT = "0123"


def judged(page: str) -> list[str]:
    """A page's blocks in page order, each after its character."""
    found = parts(page)
    part = main_part([f[:2] for f in found])
    if part is None:
        return [(OPEN if zone == "rest" else NONE) + text for zone, text, _ in found]
    return [(NONE if zone != part else DOUBT if doubt else MAIN) + text for zone, text, doubt in found]


def _hashes(pages: list[list[str]]) -> list[np.ndarray]:
    """The hashes of each page's tokens."""
    data, off = kernels.buffers(pa.array([b[1:] for p in pages for b in p], pa.large_string()))
    start, end, first = kernels.words(data, off, kernels.SPACED)
    at = first[np.cumsum([0, *map(len, pages)])]
    h = kernels.word_hashes(data, start, end)
    return [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _stream_id(h: np.ndarray, host: str | None) -> int:
    return int.from_bytes(hashlib.blake2b((host or "").encode() + b"\0" + h.tobytes(), digest_size=8).digest(), "little", signed=True)


def _pages(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[str]], list[np.ndarray], list[int]]]:
    """Rows that begin with (host, html), few at a time, with their pages' blocks, token hashes and stream ids."""
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            b = batch.slice(k, 256)
            pages = [judged(page or "") for page in b.column(1).to_pylist()]
            hashes = _hashes(pages)
            yield b, pages, hashes, [_stream_id(h, host) for h, host in zip(hashes, b.column(0).to_pylist(), strict=True)]


def _parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html, page_id, url, share) to DEALT: whole pages, whatever their structure."""
    for b, pages, _, ids in _pages(batches):
        bodies = pa.array([_packed("\n".join(p)) for p in pages], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), b.column(0), b.column(4), bodies, pa.array(ids, pa.int64())], names=["page_id", "url", "host", "share", "body", "stream"])


def _keys(h: np.ndarray, host: str | None) -> np.ndarray:
    """The hashes of a page's windows with its host."""
    n = max(0, len(h) - RUN + 1)
    x = np.full(n, _stream_id(h[:0], host), np.int64).view(np.uint64)
    for k in range(RUN):
        x = kernels.mix(x * np.uint64(31) + h[k : k + n], k)
    return x.view(np.int64)


def _asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) to (stream, keys): the windows of the pages whose text depends on what other pages hold."""
    for b, pages, hashes, ids in _pages(batches):
        hosts = b.column(0).to_pylist()
        asked = [i for i, p in enumerate(pages) if any(x[0] in OPEN + DOUBT for x in p)]
        keys = [_keys(hashes[i], hosts[i]) for i in asked]
        ends = np.cumsum([0, *map(len, keys)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
        yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in asked], pa.int64()), lists], names=["stream", "keys"])


def covered(streams: list[list[str]], run: int = RUN) -> list[list[np.ndarray]]:
    """For each page's blocks, which of their tokens lie in a substring of `run` tokens or more that distinct pages share."""
    texts = [t for s in streams for t in s]
    data, off = kernels.buffers(pa.array(texts, pa.large_string()))
    start, end, first = kernels.words(data, off, kernels.SPACED)
    h = kernels.word_hashes(data, start, end)
    pages = np.repeat(np.arange(len(streams)), [len(s) for s in streams])
    page = np.repeat(pages, np.diff(first))
    ends = np.searchsorted(page, np.arange(len(streams)), "right")
    # pages of the same stream are one distinct page
    begins = np.concatenate([[0], ends[:-1]])
    seen: dict[bytes, int] = {}
    same = np.asarray([seen.setdefault(h[a:b].tobytes(), i) for i, (a, b) in enumerate(zip(begins, ends, strict=True))])
    n = len(h)
    hit = np.zeros(n + 1, np.int64)
    if n >= run:
        # prefix doubling: rank[i] orders the suffixes by their first `depth` tokens
        rank = np.unique(h, return_inverse=True)[1].astype(np.int64)
        depth = 1
        while depth < run:
            step = min(depth, run - depth)
            follow = np.full(n, -1)
            follow[: n - step] = rank[step:]
            rank = np.unique(rank * (n + 2) + follow + 1, return_inverse=True)[1].astype(np.int64)
            depth += step
        fits = np.flatnonzero(np.arange(n) + run <= ends[page])
        order = fits[np.lexsort((same[page[fits]], rank[fits]))]  # the suffix array, to that depth
        r, p = rank[order], same[page[order]]
        group = np.concatenate([[0], np.flatnonzero(np.diff(r)) + 1]) if len(r) else np.zeros(0, np.int64)
        if len(r):
            shared = np.minimum.reduceat(p, group) < np.maximum.reduceat(p, group)
            at = order[np.repeat(shared, np.diff(np.append(group, len(r))))]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + run, -1)
    inside = np.cumsum(hit)[:n] > 0
    out, k = [], 0
    for s in streams:
        out.append([inside[first[k + i] : first[k + i + 1]] for i in range(len(s))])
        k += len(s)
    return out


def _with_marks(marked: list[np.ndarray], starts: list[int] | None) -> list[np.ndarray]:
    """A page's covered tokens, with those of the windows that start at `starts`."""
    if not starts:
        return marked
    hit = np.zeros(sum(map(len, marked)) + 1, np.int64)
    at = np.asarray(starts, np.int64)
    np.add.at(hit, at, 1)
    np.add.at(hit, at + RUN, -1)
    inside = np.cumsum(hit)[:-1] > 0
    return [m | w for m, w in zip(marked, np.split(inside, np.cumsum([len(m) for m in marked])[:-1]), strict=True)]


def _result(ids: list, urls: list, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=("page_id", "url", "text", "n_chars")
    )


def _text(blocks: list[str], marked: list[np.ndarray]) -> str:
    """A page's text by what is covered of each block, and by structure where a covered run may be content."""
    sums = {c: (sum(len(m) for b, m in zip(blocks, marked, strict=True) if b[0] == c), sum(int(m.sum()) for b, m in zip(blocks, marked, strict=True) if b[0] == c)) for c in (MAIN, DOUBT)}
    (firm, copied), (doubtful, _) = sums[MAIN], sums[DOUBT]
    lesser = doubtful < firm and 2 * copied < firm
    kept = []
    for block, m in zip(blocks, marked, strict=True):
        text = block[1:]
        if block[0] == OPEN:
            text = " ".join(w for w, c in zip(text.split(" "), m, strict=True) if not c) if len(m) == text.count(" ") + 1 else text
        elif block[0] == NONE or block[0] == DOUBT and lesser and len(m) and m.all():
            text = ""
        if text:
            kept.append(text)
    return "\n".join(kept)


def _finish(rows: list[tuple]) -> pa.RecordBatch:
    """The texts of those of one host's rows that are asked for (their last column); all are searched."""
    marks = [_with_marks(m, r[5]) for m, r in zip(covered([[b[1:] for b in r[4]] for r in rows]), rows, strict=True)]
    texts = [_text(r[4], m) for r, m in zip(rows, marks, strict=True) if r[6]]
    return _result([r[0] for r in rows if r[6]], [r[1] for r in rows if r[6]], texts)


def _hosts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Works off rows sorted by host and share, in runs of one host and share and of at most TOKENS tokens."""
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for k in range(0, batch.num_rows, 128):
            for *row, body, marks in zip(*[c.to_pylist() for c in batch.slice(k, 128).columns], strict=True):
                blocks = [b for b in _unpacked(body).split("\n") if b]
                n = sum(len(b) - 1 for b in blocks) // 6
                if rows and (list(rows[-1][2:4]) != row[2:4] or size + n > TOKENS):
                    yield _finish(rows)
                    rows, size = [], 0
                rows.append((*row, blocks, marks, True))
                size += n
    if rows:
        yield _finish(rows)


def host_marks(scratch: common.Scratch, large: DataFrame) -> DataFrame | None:
    """(stream, marks): where windows that distinct pages of the host share start, of each stream of asked pages; none if no page is asked."""
    large = large.select("host", "html")
    asked = scratch.table(large.mapInArrow(_asked, "stream long, keys array<long>"), compression="zstd")
    if asked.isEmpty():
        return None
    sent = large.sparkSession.sparkContext.broadcast(minhash.id_filter(asked.select(F.explode("keys").alias("key"))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, hashes, ids in _pages(batches):
            keys = [_keys(h, host) for h, host in zip(hashes, b.column(0).to_pylist(), strict=True)]
            every = np.concatenate([np.zeros(0, np.int64), *keys])
            yield minhash.held(pa.RecordBatch.from_arrays([pa.array(every), pa.array(np.repeat(np.asarray(ids, np.int64), list(map(len, keys))))], names=["key", "stream"]), *sent.value)

    every = large.mapInArrow(run, "key long, stream long").groupBy("key").agg(F.min("stream").alias("lo"), F.max("stream").alias("hi"))
    shared = scratch.table(every.where("lo < hi").select("key"))
    own = asked.dropDuplicates(["stream"]).select("stream", F.posexplode("keys").alias("at", "key"))
    marks = scratch.table(own.join(shared, "key").groupBy("stream").agg(F.collect_list("at").alias("marks")), compression="zstd")
    scratch.drop(asked)
    common.free(large.sparkSession)
    return marks


def extract(pages: DataFrame, share: int = 250) -> DataFrame:
    """page_id, url, text and n_chars of every (page_id, url, html) row."""
    scratch = common.Scratch(pages.sparkSession, "html")
    named = pages.select(url_filter.host_of(F.col("url")).alias("host"), "html", F.col("page_id").cast("long"), "url")
    hosts = scratch.table(named.groupBy("host").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("html")), F.lit(0)).alias("chars")))
    whole = (F.col("n") <= share) & (F.col("chars") <= TOKENS * 6)
    total, chars, larger = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("chars"), F.lit(0)), F.count_if(~whole)).first()
    if larger:
        # so at most 1000 hosts are split for their pages and 1000 for their text, whatever the input
        least, most = max(share, -(-total // 1000)), max(TOKENS * 6, -(-chars // 1000))
        shares = hosts.where(~whole).select("host", F.ceil(F.greatest(F.col("n") / least, F.col("chars") / most)).cast("int").alias("_shares"))
        named = named.join(shares, "host", "left")
        dealt = named.withColumn("share", F.pmod(F.xxhash64("page_id", "html"), F.coalesce("_shares", F.lit(1))).cast("int"))
        marks = host_marks(scratch, named.where(F.col("_shares").isNotNull()))
    else:
        dealt, marks = named.withColumn("share", F.lit(0)), None
    parsed = dealt.select("host", "html", "page_id", "url", "share").mapInArrow(_parse, DEALT)
    if marks is None:
        parsed = parsed.withColumn("marks", F.lit(None).cast("array<int>"))
    else:
        parsed = parsed.join(marks, "stream", "left")
    parsed = parsed.select("page_id", "url", "host", "share", "body", "marks").repartition("host", "share").sortWithinPartitions("host", "share", "page_id")
    return parsed.mapInArrow(_hosts, RESULT)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.read(spark, sf_dir, "pages").select("page_id", "url", "html"))
