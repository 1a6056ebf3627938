"""HTML extraction: blocks and zones from markup, judged by a suffix array over each host's token streams."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wiretide.llm.common import as_bytes, partitions, session_of
from wiretide.llm.wordhash import mix, word_hashes

#: The inside of a tag: quotes count after an equals sign only, and a tag ends before the next one starts.
ATTRIBUTES = r"""(?:[^<>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*+"""
#: Comments, raw elements with their content (a self-closing svg has none), other declarations, tags.
TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<svg(?=[\s/>]){ATTRIBUTES}(?<=/)>|<(script|style|noscript|template|iframe|svg|textarea|title)(?=[\s/>]){ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][^\s/<>]*)({ATTRIBUTES})>",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Elements that end a block where they start and end.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hr html legend li main menu nav object ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and roles that are never part of an article.
OUT = frozenset("footer aside button select dialog head object".split())
OUT_ROLES = frozenset("contentinfo complementary dialog alertdialog alert menu menubar toolbar".split())
#: Those that aren't either, unless an article lies within; header only outside of one.
AROUND = frozenset("nav form menu search fieldset".split())
AROUND_ROLES = frozenset("navigation banner search form".split())
#: Words of class and id that mark what isn't the article, words that take this back unless they are of the third kind, and words before one that tell of a layout.
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal "
    "nav navbar navigation newsletter notice notices pagination paywall popup promo promoted related search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
IN_WORDS = frozenset("article body content entry headline main post story title".split())
HARD_WORDS = frozenset("ad ads advert adverts advertisement advertising comment comments cookie cookies disqus promo related share social sponsor sponsored newsletter".split())
LAYOUT_WORDS = frozenset("with has no without free".split())
#: First words of a class that names the topic of an article, and words that with another of these mark teasers of other pages.
TOPIC_WORDS = frozenset("category tag topic".split())
MORE_WORDS, TEASER_WORDS = frozenset("more other".split()), frozenset("stories articles news posts".split())
#: Of the words of the third kind those that mark what readers wrote; a class or id that is one of the second line says so too.
READER_WORDS = frozenset("comment comments disqus".split())
READERS = frozenset("discussion responses replies".split())
#: Tokens of a repeated substring at least, distinct pages of a host that hold it at least, and the share of a block's tokens that such substrings cover for the block to go.
TOKENS, PAGES, COVERED = 6, 3, 0.8
#: A block of an article goes only if so many of the host's distinct articles, and this share of them, hold it, and never more than this share of an article.
ARTICLES, SHARE, MOST = 5, 0.5, 0.5
#: Of so many substrings in a row in an article block the one of least name is compared.
WINDOW = 6
#: Bytes of html in a chunk, unless that makes fewer chunks than partitions, then FEW at least; and for each bucket of names.
CHUNK, FEW, BUCKET = 8_000_000, 2_000_000, 24_000_000
#: Bytes of html that a task parses together.
PORTION = 16_000_000

Block = tuple[str, bool, bool]


#: How sure a class or id is that an element isn't the article: not at all, by what others are ruled out around an article, by a word of an advert or the like, by one of readers' comments.
NONE, SOFT, HARD, READER = range(4)


def _named(value: str) -> int:
    """What the words of a class or id say."""
    kept = set(re.split(r"[^a-z0-9]+", value)) & IN_WORDS
    sure = NONE
    for one in value.split():
        ordered = re.split(r"[^a-z0-9]+", one)
        words = set(ordered)
        if one in READERS:
            sure = max(sure, READER)
        if ordered[0] in TOPIC_WORDS or words & LAYOUT_WORDS:
            continue
        if words & READER_WORDS:
            sure = max(sure, READER)
        elif words & HARD_WORDS or words & MORE_WORDS and words & TEASER_WORDS:
            sure = max(sure, HARD)
        elif words & OUT_WORDS and not kept:
            sure = max(sure, SOFT)
    return sure


def _marks(name: str, attributes: str, inside: bool) -> tuple[bool, bool, bool, int]:
    """Whether an element is an article; is never part of one; isn't unless an article lies within; and what its class or id say."""
    main, out, around, named = name in ("article", "main"), name in OUT, name in AROUND or name == "header" and not inside, NONE
    if attributes.strip():
        for found in ATTRIBUTE.finditer(attributes):
            key, value = found[1].lower(), (found[2] or "").strip("\"'").lower()
            if key in ("class", "id") and name not in ("html", "body"):
                named = max(named, _named(value))
            elif key == "role":
                main, out, around = main or value in ("main", "article"), out or value in OUT_ROLES, around or value in AROUND_ROLES
            elif key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value):
                out = True
    return main, out, around, max(named, SOFT) if name == "form" else named


#: In an article, ruled out, innermost element that rules out what is not an article, innermost that its words rule out (0: none).
NOTHING = (False, False, 0, 0)


class _Stack:
    """The open elements; where the innermost one of a name is takes one step."""

    def __init__(self) -> None:
        self.open: list[tuple[str, int, tuple]] = []  # name, place of the innermost block up to here, state
        self.places: dict[str, list[int]] = {}

    def state(self) -> tuple:
        return self.open[-1][2] if self.open else NOTHING

    def push(self, name: str, state: tuple) -> None:
        at = len(self.open)
        self.open.append((name, at if name in BLOCKS else self.open[-1][1] if self.open else -1, state))
        self.places.setdefault(name, []).append(at)

    def cut(self, at: int) -> None:
        for name, *_ in self.open[at:]:
            self.places[name].pop()
        del self.open[at:]

    def find(self, name: str) -> int:
        """The innermost open element of that name, or -1. A paragraph or an inline element is not looked for beyond another block."""
        at = self.places.get(name)
        if not at or (name == "p" or name not in BLOCKS) and at[-1] < self.open[-1][1]:
            return -1
        return at[-1]


def blocks(page: str) -> list[Block]:
    """(text, whether in an article, whether markup rules it out) of each block of a page that has text. White space within a
    block is one space; character references are decoded. Elements that were left open end with what holds them.

    An article ends what navigation, forms, headers and class names around it say. On a page without one, a form or an element
    ruled out by its class that holds more than half of the text is the page's frame and rules nothing out. Words of adverts and
    the like rule out what they are on with all it holds, articles too, but not what holds more than half of the page's article (on
    a page without one, of its text) apart from readers' comments; and words of comments not what holds all of it.
    """
    found: list[tuple[str, bool, bool, int, int]] = []
    stack, buffer, at = _Stack(), [], 0
    doubts = [(0, NONE)]  # of each element that words rule out: the next such one around it, and how sure they are
    outer, frame = [0], [True]  # of each element that rules out what is not an article: the next such one around it, and whether it may be a frame
    state = stack.state()

    def close() -> None:
        text = " ".join(html.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            found.append((text, *state))

    for tag in TAG.finditer(page):
        if tag.start() > at:
            buffer.append(page[at : tag.start()])
        at = tag.end()
        if not tag[3]:
            continue
        name = tag[3].lower()
        if name in BLOCKS:
            close()
        elif name == "br":
            buffer.append(" ")
        if name in VOID:
            continue
        if tag[2]:
            i = stack.find(name)
            if i >= 0:
                if (stack.open[i - 1][2] if i else NOTHING) != state:
                    close()
                stack.cut(i)
        else:
            if name in BLOCKS and (i := stack.find("p")) >= 0:
                stack.cut(i)
            if name == "li" and stack.open and stack.open[-1][0] == "li":
                stack.cut(len(stack.open) - 1)
            inside, ruled, why, doubt = stack.state()
            main, out, around, named = _marks(name, tag[4], inside)
            if main:
                why = 0
            elif around or named == SOFT and not inside:
                outer.append(why)
                frame.append(named > NONE)
                why = len(outer) - 1
            if named >= HARD or named and (main or inside):  # an article whose own class says that it is none, too
                doubts.append((doubt, max(named, HARD)))
                doubt = len(doubts) - 1
            now = (inside or main, ruled or out, why, doubt)
            if now != state:
                close()
            stack.push(name, now)
        state = stack.state()
    buffer.append(re.sub(r"<[a-zA-Z/!?][^<>]*\Z", "", page[at:]))
    close()
    wrong = _doubted(doubts, found)
    found = [(text, inside, ruled or wrong[doubt], why, doubt) for text, inside, ruled, why, doubt in found]
    sizes = [0] * len(outer)
    for text, _, ruled, why, _ in found:
        sizes[why] += 0 if ruled else len(text)
    for k in range(len(outer) - 1, 0, -1):
        sizes[outer[k]] += sizes[k]
    framed = not any(inside and not ruled and not why for _, inside, ruled, why, _ in found)
    rules = [False]
    for k in range(1, len(outer)):
        rules.append(rules[outer[k]] or not (framed and frame[k] and 2 * sizes[k] > sizes[0]))
    return [(text, inside, ruled or rules[why]) for text, inside, ruled, why, _ in found]


def _doubted(doubts: list[tuple[int, int]], found: list[tuple[str, bool, bool, int, int]]) -> list[bool]:
    """Of each element that words rule out whether that holds."""
    if len(doubts) == 1:
        return [False]
    own = any(inside and not ruled for _, inside, ruled, _, _ in found)
    readers = [False]
    for above, sure in doubts[1:]:
        readers.append(readers[above] or sure == READER)
    every, but_readers = [0] * len(doubts), [0] * len(doubts)
    for text, inside, ruled, why, doubt in found:
        if not ruled and (inside or not own):
            every[doubt] += len(text)
            but_readers[doubt] += 0 if readers[doubt] else len(text)
    for sizes in (every, but_readers):
        for k in range(len(doubts) - 1, 0, -1):
            sizes[doubts[k][0]] += sizes[k]
    all_readers = not but_readers[0]  # comments' words are on all of the article: they mean something else
    out = [False]
    for k, (above, sure) in enumerate(doubts[1:], 1):
        if sure == READER:
            holds = every[k] < every[0] or not all_readers
        else:
            part, whole = (every[k], every[0]) if all_readers else (but_readers[k], but_readers[0])
            holds = 2 * part <= whole
        out.append(out[above] or holds)
    return out


def _main(page: list[Block]) -> list[bool]:
    return [inside and not ruled for _, inside, ruled in page]


def article(found: list[Block]) -> str | None:
    """The text of a page that has an article; None if its markup has none."""
    own = [text for (text, *_), main in zip(found, _main(found)) if main]
    return "\n".join(own) if own else None


def signature(page: list[Block]) -> int:
    """Pages whose article, or text that markup doesn't rule out, is the same are one page, whatever is around."""
    own = article(page)
    words, _ = word_hashes([(own if own is not None else "\n".join(text for text, _, ruled in page if not ruled)).encode("utf-8", "replace")])
    at = np.arange(1, len(words) + 1, dtype=np.uint64)
    return int(mix(np.array([np.sum(mix(words + at * np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)], np.uint64))[0])


def names(tokens: np.ndarray, depth: int = TOKENS) -> np.ndarray:
    """The name of the depth tokens from each place on: equal names are the suffixes whose longest common prefix has depth tokens.

    Prefix doubling: the name by 2h tokens is that of the pair of names by h, here and h on (by fewer at the end). Names are
    64-bit hashes of such pairs in place of ranks, so that they mean the same in every chunk.
    """
    now, h = tokens, 1
    while h < depth:
        step = min(h, depth - h)
        if len(now) <= step:
            return now[:0]
        now = mix(now[:-step] * np.uint64(0xD1342543DE82EF95) + now[step:])
        h += step
    return now


def _least_of(values: np.ndarray, first: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Marks in each run of n values from first on the least one of every window of values in a row, or of all if they are fewer."""
    picked = np.zeros(len(values), bool)
    at = np.repeat(first, np.maximum(0, n - window + 1) + ((n > 0) & (n < window)))
    if not at.size:
        return picked
    many = np.maximum(1, n[n > 0] - window + 1)
    end = np.repeat(first[n > 0] + n[n > 0], many)
    at = at + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    best, least = at.copy(), values[at]
    for k in range(1, window):
        inside = at + k < end
        value = values[np.minimum(at + k, len(values) - 1)]
        less = inside & (value < least)
        best[less], least[less] = (at + k)[less], value[less]
    picked[best] = True
    return picked


class Streams:
    """The token streams of some pages, one after another, with the names of those of their substrings that are compared.

    Outside of articles, and on pages without one, the stream runs across blocks and every substring of TOKENS tokens is
    compared. In an article each block is a stream of its own, of which a sample is compared that depends on its words alone.
    """

    def __init__(self, pages: list[list[Block]], hosts: np.ndarray, signatures: np.ndarray) -> None:
        self.pages, self.hosts = pages, hosts
        tokens, offsets = word_hashes([text.encode("utf-8", "replace") for page in pages for text, *_ in page])
        self.first, sizes = offsets[:-1], np.diff(offsets)
        self.page_of = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
        self.main = np.array([m for page in pages for m in _main(page)], bool)
        new = np.ones(len(sizes), bool)  # a stream starts with each page, and with each block of an article and after it
        new[1:] = (self.page_of[1:] != self.page_of[:-1]) | self.main[1:] | self.main[:-1]
        stream = np.repeat(np.cumsum(new) - 1, sizes) if len(sizes) else np.zeros(0, np.int64)
        name = names(tokens)
        at = np.flatnonzero(stream[: len(name)] == stream[TOKENS - 1 :][: len(name)]) if len(name) else np.zeros(0, np.int64)
        block = np.searchsorted(offsets, at, side="right") - 1
        outer = ~self.main[block]
        picked = outer.copy()
        if not outer.all():
            inner = np.flatnonzero(~outer)
            starts = np.flatnonzero(np.diff(block[inner], prepend=-1))
            picked[inner] = _least_of(name[at[inner]], starts, np.diff(starts, append=len(inner)), WINDOW)
        self.at, self.block, self.outer, self.total = at[picked], block[picked], outer[picked], len(tokens)
        page = self.page_of[self.block]
        self.keys = mix(name[self.at] * np.uint64(0x9E3779B97F4A7C15) + hosts[page])
        self.host_keys = mix(hosts ^ np.uint64(0x5851F42D4C957F2D))
        self.signatures = signatures

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Names, ascending, and how many distinct pages hold each; among them one for each host, held by all its pages."""
        keys = np.concatenate((self.keys, self.host_keys))
        owner = np.concatenate((self.signatures[self.page_of[self.block]], self.signatures))
        order = np.lexsort((owner, keys))
        keys, owner = keys[order], owner[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        held, n = np.unique(keys[fresh], return_counts=True)
        return held, n

    def texts(self, held: np.ndarray, n: np.ndarray, pages: int, share: float) -> Iterator[tuple[str, int, int]]:
        """(text, blocks that repetition removes, blocks that markup alone removes) of each page, given the names that enough
        distinct pages of the host hold, and how many."""

        def support(keys: np.ndarray) -> np.ndarray:
            if not len(held):
                return np.zeros(len(keys), np.int64)
            found = np.minimum(np.searchsorted(held, keys), len(held) - 1)
            return np.where(held[found] == keys, n[found], 0)

        often = support(self.keys)
        # outside of articles: the share of a block's tokens that repeated substrings cover
        cover = np.zeros(self.total + 1, np.int64)
        hit = self.at[self.outer & (often >= pages)]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + TOKENS, -1)
        covered = np.concatenate(([0], np.cumsum(np.cumsum(cover)[:-1] > 0)))
        ends = np.append(self.first[1:], self.total) if len(self.first) else self.first
        size = ends - self.first
        repeated = covered[ends] - covered[self.first] >= COVERED * np.maximum(size, 1)
        # in articles: the share of a block's compared substrings that half of the host's articles hold
        need = np.maximum(max(ARTICLES, pages), np.ceil(support(self.host_keys) * share))[self.page_of[self.block]]
        inner = ~self.outer
        seen = np.bincount(self.block[inner], minlength=len(size))
        common = np.bincount(self.block[inner], (often >= need)[inner], minlength=len(size))
        repeated = np.where(self.main, (seen > 0) & (common >= COVERED * seen), repeated)
        b = 0
        for page in self.pages:
            mine, gone, main, tokens = range(b, b + len(page)), repeated[b : b + len(page)].copy(), self.main[b : b + len(page)], size[b : b + len(page)]
            b += len(page)
            if main.any():
                if tokens[main & gone].sum() > MOST * tokens[main].sum():
                    gone &= ~main  # another copy of the article, not boilerplate
                kept = main & ~gone
            else:
                kept = ~gone & ~np.array([ruled for *_, ruled in page], bool)
            yield "\n".join(text for (text, *_), k in zip(page, kept) if k), int(gone.sum()), len(mine) - int(gone.sum()) - int(kept.sum())


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _planes(values: np.ndarray) -> bytes:
    """Byte planes of numbers: those that are zeros compress away."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _unplanes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


_BLOCK = pa.list_(pa.struct([("text", pa.string()), ("inside", pa.bool_()), ("ruled", pa.bool_())]))
_COUNTS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("names", pa.binary()), ("counts", pa.binary())])


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def _streams(rows: pa.Table) -> tuple[pa.Table, Streams]:
    some = pa.concat_tables([pa.ipc.open_stream(x.as_py()).read_all() for x in rows["pages"]])
    found = [[(b["text"], b["inside"], b["ruled"]) for b in page] for page in some["blocks"].to_pylist()]
    unsigned = lambda c: some[c].to_numpy().view(np.uint64)
    return some, Streams(found, unsigned("host"), unsigned("signature"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = PAGES, share: float = SHARE) -> DataFrame:
    """(page_id, url, text, n_chars, n_repeated, n_marked) for every row of pages: the main text, its blocks joined by line feeds,
    and how many blocks were removed because the host's suffix array shows them to repeat, and by markup alone.

    A suffix array ranks all positions of the streams of a host's pages; an interval of longest common prefix TOKENS or more
    that at least `least` distinct pages share is a repeated substring. A block that such substrings cover is boilerplate. What
    is left are unique runs, of which markup takes what it marks as navigation, adverts, comments and the like, and on pages
    with an article what lies outside. An article's own block goes only if half of the host's distinct articles hold it, and
    none goes if together they are most of the article, which is then a copy. Pages of equal article (or text) are one page.

    A null or empty html gives an empty text, a null url an empty host; repeated rows and null ids come out as they go in; an
    empty table gives an empty one. Other columns are not read. Very long pages are parsed in linear time.

    Pages are parsed once and dealt by the hash of their article into chunks, so that a host with a third of all pages is in
    all of them and equal articles are in one. Chunks send the names of their substrings with the count of distinct pages to
    buckets, which add the counts up, exactly at any size of a host, and tell the chunks what is shared by enough; the exchange
    of the parsed pages, compressed, is used twice. Nothing is gathered but a chunk or a bucket.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    spark = session_of(pages)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.xxhash64(host(F.col(url_col))).alias("host"), as_bytes(html_col).alias("html"))
    size = pages.agg(F.sum(F.octet_length(html_col))).first()[0] or 0
    chunks = max(1, -(-size // CHUNK), min(partitions(spark), -(-size // FEW)))
    buckets = max(1, -(-size // BUCKET), min(partitions(spark), -(-size // FEW)))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum([len(x.as_py()) for x in batch.column("html")]) // PORTION
            for a, b in zip([0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist()], [*(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]):
                some = pa.Table.from_batches([batch.slice(a, b - a)])
                found = [blocks(x.as_py().decode("utf-8", "replace")) for x in some["html"]]
                signs = np.array([signature(p) for p in found], np.uint64)
                table = some.select(["page_id", "url", "host"]).append_column("signature", pa.array(signs.view(np.int64)))
                table = table.append_column("blocks", pa.array([[{"text": t, "inside": i, "ruled": r} for t, i, r in p] for p in found], _BLOCK))
                of = (signs % np.uint64(chunks)).astype(np.int64)
                order = np.argsort(of, kind="stable")
                cuts = np.flatnonzero(np.diff(of[order], prepend=-1)).tolist()
                parts = [(int(of[order[c]]), _packed(table.take(pa.array(order[c:d])))) for c, d in zip(cuts, [*cuts[1:], len(order)])]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in parts], pa.int64()), pa.array([p for _, p in parts], pa.binary())], names=["chunk", "pages"])

    def count(rows: pa.Table) -> pa.Table:
        held, n = _streams(rows)[1].counts()
        of = (((held >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(of, prepend=-1)).tolist()
        parts = [(int(of[c]), held[c:d], n[c:d]) for c, d in zip(cuts, [*cuts[1:], len(of)])]
        chunk = rows["chunk"][0].as_py()
        return pa.table([[chunk] * len(parts), [p[0] for p in parts], [_planes(np.diff(p[1], prepend=np.uint64(0))) for p in parts], [_planes(p[2].astype(np.uint32)) for p in parts]], schema=_COUNTS)

    def add_up(rows: pa.Table) -> pa.Table:
        parts = [(c, np.cumsum(_unplanes(k, np.uint64), dtype=np.uint64), _unplanes(n, np.uint32)) for c, k, n in zip(*(rows[x].to_pylist() for x in ("chunk", "names", "counts")))]
        held, back = np.unique(np.concatenate([k for _, k, _ in parts]), return_inverse=True)
        total = np.bincount(back, np.concatenate([n for *_, n in parts])).astype(np.uint32)
        out, at, bucket = [], 0, rows["bucket"][0].as_py()
        for chunk, mine, _ in parts:
            often = total[back[at : at + len(mine)]]
            at += len(mine)
            keep = often >= least
            if keep.any():
                out.append((chunk, bucket, _planes(np.diff(mine[keep], prepend=np.uint64(0))), _planes(often[keep])))
        return pa.table([list(c) for c in zip(*out)] if out else [[], [], [], []], schema=_COUNTS)

    result = f"page_id {kind}, url string, text string, n_repeated long, n_marked long"

    def judge(rows: pa.Table, told: pa.Table) -> pa.Table:
        some, streams = _streams(rows)
        held = np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(_unplanes(k.as_py(), np.uint64), dtype=np.uint64) for k in told["names"])])
        n = np.concatenate([np.zeros(0, np.uint32), *(_unplanes(k.as_py(), np.uint32) for k in told["counts"])])
        order = np.argsort(held)
        texts, repeated, marked = zip(*streams.texts(held[order], n[order].astype(np.int64), least, share))
        return pa.table({"page_id": some["page_id"], "url": some["url"], "text": pa.array(texts, pa.string()), "n_repeated": pa.array(repeated, pa.int64()), "n_marked": pa.array(marked, pa.int64())})

    dealt = rows.mapInArrow(parse, "chunk long, pages binary")
    counted = dealt.groupBy("chunk").applyInArrow(count, "chunk long, bucket long, names binary, counts binary")
    told = counted.groupBy("bucket").applyInArrow(add_up, "chunk long, bucket long, names binary, counts binary")
    found = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(judge, result)
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_repeated", "n_marked")


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    from wiretide.llm.common import table

    return extract(table(spark, sf_dir, "pages"))
