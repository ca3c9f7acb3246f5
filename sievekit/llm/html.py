"""HTML extraction: markup, and a suffix array over the token streams of each host.

A page is cut into blocks of visible text, and these into tokens (sentences). The token
streams of a host's pages are put one after another, in shards of some SHARD pages; a
suffix array gives the runs of tokens that are repeated on MIN_PAGES distinct pages of
the shard and have MIN_WORDS words. On hosts of several shards the same is found over all
of them: a token lies in a repeated run exactly if it lies in a repeated one that can't be
shortened at its end, or at its beginning, without losing MIN_WORDS; there are at most two
such windows a token, and the host's distinct pages are counted for each. So the shards
don't change what is repeated. A block that such runs cover for the most part is
boilerplate; what remains are the page's unique runs.

Markup is a check besides: what navigation, footers, forms, adverts, comments and the like
hold is dropped, and where a page has an article (or, without one, a main) element only
its blocks are looked at. Repetition alone decides on loose blocks. Articles quote and copy each
other, so a block of an article or main element goes only if repeated runs cover it and
some page of the host has the same block in what markup calls noise.

Defined results: a null or empty html gives an empty text; a null url has an empty host;
repeated rows give a row each and count as one page for repetition, as do all pages with
equal streams; an empty table gives an empty result; further columns are ignored.
Pages are read whole, broken markup too.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm.common import looked_up, materialize, mix, powers, small_batches, span_hash

#: Pages that are searched for repetition together, and what makes a run boilerplate.
SHARD, MIN_PAGES, MIN_WORDS = 96, 3, 4
#: Share of a block's words that must be covered.
COVERED = 0.5
#: Most hosts of several shards that are broadcast; beyond, they are joined.
MAX_BROADCAST = 100_000
#: Most windows repeated over several shards that are broadcast, 8 bytes each; beyond, they are joined.
MAX_REPEATED = 2_000_000

# Elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg canvas math select object audio video".split())
NOISE = frozenset("nav footer aside form button dialog menu head fieldset label".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a new one of the key closes, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
#: Words in class, id or role that mark what is no article.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav "
    "navbar navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations comment comments disqus reply replies respond widget widgets toolbar pagination pager skip "
    "copyright complementary contentinfo dialog outbrain taboola".split()
)
#: Those that mark it outside of articles only, and as a name's whole or last word.
WEAK_WORDS = frozenset("side alert search form hidden".split())
#: First words of names that speak of a page's state or layout, not of what an element is; last ones alike.
STATES = frozenset("has no not without with is js can show enable disable allow open toggle".split())
LAYOUTS = frozenset("left right open closed enabled disabled active none on off allowed layout page wrapper visible".split())
#: Elements that hold the article: no name makes them noise.
HOLDERS = frozenset("html body main article".split())
#: Words that an article may be about: an id within one, which may be a mere anchor, says nothing by them.
TOPICS = frozenset("cookie cookies consent gdpr notice notices copyright menu navigation share sharing social login signup subscription skip".split())
#: Elements whose content is dropped even if they are never closed; others are then as if they were not there.
ENDLESS = frozenset("script style textarea title".split())

#: A tag's start, and its rest if that has no quotes.
_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)(?:([^\"'>]*+)>)?|!--|[!?])")
_STOP = re.compile("[\"'>]")
_ATTRIBUTE = re.compile(r"""(class|id|role|style|aria-hidden|hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/]|$))""", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def names_noise(name: str, in_article: bool, anchor: bool = False) -> bool:
    """Whether one class, id or role says that an element is no article: "site-footer" does, "has-sidebar" doesn't.

    Within an article only a name's last word counts, as "share-price" or "menu-of-the-day" may be what
    it is about; anchor: the name is an id there, for which TOPICS don't count either.
    """
    words = _WORD.findall(name)
    if not words or words[0] in STATES or len(words) > 1 and words[-1] in LAYOUTS:
        return False
    if in_article:
        return words[-1] in NOISE_WORDS and not (anchor and words[-1] in TOPICS)
    return not NOISE_WORDS.isdisjoint(words) or words[-1] in WEAK_WORDS or "header" in words


def _marks(attributes: str, in_article: bool, named: bool = True) -> tuple[bool, str]:
    """Whether an element's attributes make it noise; and "article" or "main" where they make it that. named: names may make it noise."""
    noise, kind = False, ""
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDES.search(value):
            noise = True
        elif name in ("class", "id", "role"):
            noise |= named and any(names_noise(x, in_article, name == "id") for x in value.split())
            if name == "role" and value in ("main", "article"):
                kind = value
        elif name == "itemprop" and value == "articlebody":
            kind = "article"
    return noise, kind


class _Tags:
    """Where the tags of a page end, in time linear in the page.

    A tag ends at the first > outside of quotes, or at the first at all if a quote in it is never
    closed. Quotes from which a search has failed are remembered, as others would fail from there.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.last = {c: page.rfind(c) for c in "\"'>"}
        self.failed: set[int] = set()

    def end(self, at: int) -> int:
        """The place after the tag whose name ends at the place, -1 if nothing ends it."""
        page, passed, pos = self.page, [], at
        if at > self.last[">"]:
            return -1
        while pos <= self.last[">"]:
            stop = _STOP.search(page, pos).start()
            if page[stop] == ">":
                return stop + 1
            if stop in self.failed:
                break
            passed.append(stop)
            if stop == self.last[page[stop]]:
                break
            pos = page.find(page[stop], stop + 1) + 1
        self.failed.update(passed)
        return page.find(">", at) + 1


class _Stack:
    """Open elements: (element, place, heading kept in a header), with the places of each name, so that none is searched for."""

    def __init__(self) -> None:
        self.held: list[tuple[str, str, bool]] = []
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, name: str, place: str, headed: bool) -> None:
        self.where.setdefault(name, []).append(len(self.held))
        if name in BLOCK:
            self.blocks.append(len(self.held))
        self.held.append((name, place, headed))

    def last(self, names: frozenset | set) -> int:
        """Place of the innermost of the names, -1 if none is open."""
        return max((at[-1] for n in names if (at := self.where.get(n))), default=-1)

    def innermost_block(self) -> int:
        return self.blocks[-1] if self.blocks else -1

    def cut(self, at: int) -> None:
        """Close all from the place on."""
        while len(self.held) > at:
            name = self.held.pop()[0]
            self.where[name].pop()
            if name in BLOCK:
                self.blocks.pop()

    def top(self) -> tuple[str, str, bool]:
        return self.held[-1] if self.held else ("", "loose", False)


def blocks(page: str) -> list[tuple[str, str]]:
    """The visible blocks of a page in order: (place, text), place one of article, main, loose, noise."""
    found: list[tuple[str, str]] = []
    stack, tags = _Stack(), _Tags(page)
    place, pieces = "loose", []
    at, unclosed = 0, set()

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                found.append((place, text))
            pieces.clear()

    size, begin = len(page), 0
    while at < size:
        m = _OPEN.search(page, begin)
        if m is None:
            pieces.append(page[at:])
            break
        ends, name, attributes = m.groups()
        end = m.end()
        if name is None:
            if m[0] == "<!--":
                end = page.find("-->", end)
                end = size if end < 0 else end + 3
            else:
                end = page.find(">", end) + 1 if end <= tags.last[">"] else -1
        elif attributes is None:
            end = tags.end(end)
            attributes = page[m.end() : end - 1]
        if end < 0:  # text, as nothing ends it; a comment may follow
            begin = page.find("<!--", m.end())
            if begin < 0:
                pieces.append(page[at:])
                break
            continue
        if m.start() > at:
            pieces.append(page[at : m.start()])
        at = begin = end
        if name is None:
            continue
        name = name.lower()
        if name in RAW:
            if not ends and not attributes.endswith("/"):
                close = None if name in unclosed else re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                if close is None:
                    unclosed.add(name)
                at = begin = close.end() if close else size if name in ENDLESS else at
            pieces.append(" ")
            continue
        if name not in BLOCK:
            if name == "br":
                pieces.append(" ")
            if ends:
                if open_at := stack.where.get(name):
                    flush()
                    if open_at[-1] > stack.innermost_block():
                        stack.cut(open_at[-1])
                    place = stack.top()[1]
            elif attributes and name not in VOID:
                noise, kind = _marks(attributes, place in ("article", "main"))
                if noise and place != "noise":
                    flush()
                    place = "noise"
                    stack.push(name, place, False)
            continue
        flush()
        if ends:
            if open_at := stack.where.get(name):
                stack.cut(open_at[-1])
        elif name != "hr":
            if (open_at := stack.where.get("p")) and open_at[-1] == stack.blocks[-1]:
                stack.cut(open_at[-1])
            if name in CLOSES:
                names, until = CLOSES[name]
                k = stack.last(names)
                if k > stack.last(until):
                    stack.cut(k)
            _, inner, headed = stack.top()
            inside = inner in ("article", "main")
            named = name not in HOLDERS and not (inside and name in HEADINGS)
            noise, kind = _marks(attributes, inside, named) if attributes else (False, "")
            if inner == "noise":
                now = "article" if headed and name in HEADINGS else "noise"
            elif noise or name in NOISE:
                now = "noise"
            elif name == "header":
                now, headed = "noise", inner == "article"
            elif name == "article" or kind == "article":
                now = "article"
            elif name == "main" or kind == "main":
                now = "main" if inner == "loose" else inner
            else:
                now = inner
            stack.push(name, now, headed)
        place = stack.top()[1]
    flush()
    return found


def tokens(text: str) -> list[str]:
    """A block's tokens: its sentences."""
    return _SENTENCE.split(text)


def place_of_text(found: list[tuple[str, str]]) -> str | None:
    """Where a page's text is: its article, else main, else loose blocks, None if it has none of them."""
    places = {p for p, _ in found}
    return next((kind for kind in ("article", "main", "loose") if kind in places), None)


def decided(found: list[tuple[str, str]]) -> list[str] | None:
    """The blocks that markup gives a page, None if it says nothing."""
    kind = place_of_text(found)
    return None if kind == "loose" else [t for p, t in found if p == kind]


def repeated_runs(streams: list[np.ndarray], words: list[np.ndarray]) -> list[np.ndarray]:
    """Which tokens of each page lie in a run that MIN_PAGES distinct pages have.

    streams: token hashes of each page, words: their numbers of words.
    """
    sizes = np.array([len(s) for s in streams], dtype=np.int64)
    seen: dict[bytes, int] = {}
    alike = [seen.setdefault(s.tobytes(), k) for k, s in enumerate(streams)]
    pages = sorted(seen.values())
    nothing = [np.zeros(n, dtype=bool) for n in sizes]
    if len(pages) < MIN_PAGES:
        return nothing
    token, rank = np.unique(np.concatenate([streams[k] for k in pages]), return_inverse=True)
    of = np.repeat(np.arange(len(pages)), sizes[pages])
    pairs = np.unique(rank.astype(np.int64) * len(pages) + of)
    often = np.bincount(pairs // len(pages), minlength=len(token)) >= MIN_PAGES
    # Only tokens that are themselves on enough pages can be in such a run; others, and page ends, part runs.
    place = np.flatnonzero(often[rank])
    covered = np.zeros(len(rank), dtype=bool)
    if len(place):
        parted = (np.diff(place) > 1) | (of[place][1:] != of[place][:-1])
        gaps = np.concatenate([[0], np.cumsum(parted)])
        spots = np.arange(len(place)) + gaps
        n = int(spots[-1]) + 2
        text = np.full(n, -1, dtype=np.int64)
        text[spots] = rank[place]
        text[text < 0] = len(token) + np.arange((text < 0).sum())
        page = np.full(n, -1, dtype=np.int64)
        page[spots] = of[place]
        length = np.zeros(n, dtype=np.int64)
        length[spots] = np.concatenate([words[k] for k in pages])[place]
        order, common = suffix_array(text)
        deep = np.zeros(n, dtype=np.int64)
        deep[order] = _shared_by_pages(page[order], common, len(pages))
        total = np.concatenate([[0], np.cumsum(length)])
        at = np.flatnonzero(deep)
        at = at[total[at + deep[at]] - total[at] >= MIN_WORDS]
        change = np.zeros(n + 1, dtype=np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + deep[at], -1)
        covered[place] = np.cumsum(change)[:-1][spots] > 0
    ends = np.cumsum(sizes[pages])
    by_page = dict(zip(pages, np.split(covered, ends[:-1]), strict=True))
    return [by_page[k] for k in alike]


def _shared_by_pages(page: np.ndarray, common: np.ndarray, n_pages: int) -> list[int]:
    """For each suffix in order how many first tokens it shares with MIN_PAGES distinct pages, itself one.

    page: that of each suffix, -1 for what parts runs; common: tokens shared with the suffix
    before. The shortest windows that hold enough pages give their least common prefix; from
    there it spreads both ways, each step cut to what neighbours share.
    """
    found = [0] * len(page)
    count, inside, begin = [0] * n_pages, 0, 0
    by, shared = page.tolist(), common.tolist()
    least: deque[int] = deque()  # places of rising prefixes within the window
    for end, p in enumerate(by):
        while least and shared[least[-1]] >= shared[end]:
            least.pop()
        least.append(end)
        if p < 0:
            for q in by[begin:end]:
                count[q] = 0
            inside, begin = 0, end + 1
            least.clear()
            continue
        inside += count[p] == 0
        count[p] += 1
        while inside >= MIN_PAGES:
            while least[0] <= begin:
                least.popleft()
            found[end] = max(found[end], shared[least[0]])
            count[by[begin]] -= 1
            inside -= count[by[begin]] == 0
            begin += 1
    for k in range(1, len(found)):
        found[k] = max(found[k], min(found[k - 1], shared[k]))
    for k in range(len(found) - 2, -1, -1):
        found[k] = max(found[k], min(found[k + 1], shared[k + 1]))
    return found


def windows(stream: np.ndarray, words: np.ndarray, site: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end token and hash (with site's) of the shortest runs of MIN_WORDS words from and up to each token."""
    n = len(stream)
    total = np.concatenate([[0], np.cumsum(words)])
    own = np.arange(n)
    end = np.searchsorted(total, total[:-1] + MIN_WORDS, side="left")
    begin = np.searchsorted(total, total[1:] - MIN_WORDS, side="right") - 1
    a = np.concatenate([own[end <= n], begin[begin >= 0]])
    b = np.concatenate([end[end <= n], own[begin >= 0] + 1])
    return a, b, mix(_run_hash(stream, a, b) ^ np.uint64(site & (1 << 64) - 1))


def _run_hash(stream: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the tokens stream[begin:end] for each run."""
    up, down = powers(len(stream) + 1)
    total = np.zeros(len(stream) + 1, dtype=np.uint64)
    np.cumsum(stream * up[: len(stream)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of text in order, and how many first tokens each shares with the one before it."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step, levels = 1, [rank]
    order = np.argsort(rank, kind="stable")
    while True:
        later = np.full(n, -1, dtype=np.int64)
        later[: n - step] = rank[step:] if step < n else later[:0]
        key = rank * (n + 1) + later + 1
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], (key[order][1:] != key[order][:-1]).cumsum()])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        step *= 2
        levels.append(rank)
        if fresh[-1] == n - 1 or step >= n:
            break
    # Common prefixes by descending powers of two.
    shared = np.zeros(n, dtype=np.int64)
    a, b = order[1:].copy(), order[:-1].copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(n - 1, dtype=bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        whole = (a + (1 << k) <= n) & (b + (1 << k) <= n)
        same &= whole
        a += same * (1 << k)
        b += same * (1 << k)
        shared[1:] += same * (1 << k)
    return order, shared


def host_of(url: Column) -> Column:
    """The host in lower case, or empty."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def _hashes(texts: list[str]) -> np.ndarray:
    """Hashes of texts without line feeds."""
    joined = np.frombuffer("\n".join([*texts, ""]).encode("utf-8", "replace"), dtype=np.uint8)
    end = np.flatnonzero(joined == 10)
    return span_hash(joined, np.concatenate([[0], end[:-1] + 1]), end) if texts else np.zeros(0, dtype=np.uint64)


#: What the hash of a noise block's text differs by from that of a run of the same tokens.
_NOISE = np.uint64(0x5851F42D4C957F2D)


def _block_hashes(texts: list[str], site: int) -> np.ndarray:
    """A hash of each block's whole text, with site's."""
    return mix(_hashes(texts) ^ np.uint64(site & (1 << 64) - 1) ^ _NOISE) if texts else np.zeros(0, dtype=np.uint64)


def choose(pages: list[list[tuple[str, str]]], site: int = 0, repeated: np.ndarray | None = None) -> tuple[list[str], list[int]]:
    """The main text of each page of a shard, and how many of its tokens repeated runs cover.

    repeated: sorted hashes of the windows that the host's other shards help to repeat, and of the blocks that it has in
    noise and in articles.
    """
    cut = [[tokens(t) for _, t in page] for page in pages]
    streams, words = map(list, zip(*map(_stream, cut), strict=True)) if cut else ([], [])
    covered = repeated_runs(streams, words)
    noise = {t for page in pages for p, t in page if p == "noise"}
    if repeated is not None and len(repeated):
        for stream, w, c in zip(streams, words, covered, strict=True):
            a, b, h = windows(stream, w, site)
            at = np.minimum(np.searchsorted(repeated, h), len(repeated) - 1)
            found = repeated[at] == h
            change = np.zeros(len(stream) + 1, dtype=np.int64)
            np.add.at(change, a[found], 1)
            np.add.at(change, b[found], -1)
            c |= np.cumsum(change)[:-1] > 0
        held = sorted({t for page in pages for p, t in page if p in ("article", "main")})
        if held:
            h = _block_hashes(held, site)
            at = np.minimum(np.searchsorted(repeated, h), len(repeated) - 1)
            noise.update(held[k] for k in np.flatnonzero(repeated[at] == h).tolist())
    texts = []
    for page, parts, c, w in zip(pages, cut, covered, words, strict=True):
        kind, at, own = place_of_text(page), 0, []
        for (place, text), part in zip(page, parts, strict=True):
            upto = at + len(part)
            if place == kind:
                most = w[at:upto].sum()
                boilerplate = w[at:upto][c[at:upto]].sum() >= COVERED * max(1, most)
                if not boilerplate or kind != "loose" and text not in noise:
                    own.append(text)
            at = upto
        texts.append("\n".join(own))
    return texts, [int(c.sum()) for c in covered]


def _stream(parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a page's tokens, and their numbers of words."""
    flat = [t for part in parts for t in part]
    words = np.array([t.count(" ") + 1 for t in flat], dtype=np.int64)  # white space is single blanks
    return _hashes(flat) if flat else np.zeros(0, dtype=np.uint64), words


def _windows(dealt: DataFrame) -> DataFrame:
    """h, stream, place, site, shard: the windows of each page on hosts of several shards, and its blocks in articles and in noise by place (else 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k, (site, page) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                cut = blocks(page or "")
                stream, words = _stream([tokens(t) for _, t in cut])
                whole = _run_hash(stream, np.array([0]), np.array([len(stream)]))
                own = [np.unique(windows(stream, words, site)[2])]
                own += [np.unique(_block_hashes([t for p, t in cut if p in places], site)) for places in (("article", "main"), ("noise",))]
                sizes = [len(h) for h in own]
                streams = np.repeat(np.array([whole[0], 0, 0], dtype=np.uint64), sizes)  # pages count for windows only
                found.append((np.concatenate(own), streams, np.repeat([0, 1, 2], sizes), np.full(sum(sizes), k)))
            if found:
                h, whole, place, k = (np.concatenate(c) for c in zip(*found, strict=True))
                at = pa.array(k.astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(place.astype(np.int32)),
                        batch.column(0).take(at), batch.column(1).take(at),
                    ],
                    names=["h", "stream", "place", "site", "shard"],
                )

    rows = dealt.where("many").select("site", "shard", "html")
    return rows.mapInArrow(run, "h bigint, stream bigint, place int, site bigint, shard bigint")


def _shards(rows: DataFrame) -> DataFrame:
    """Deal the pages of each host (column host) to shards of some SHARD pages: column shard."""
    large = rows.groupBy("host").count().where(F.col("count") > SHARD)
    large = materialize(large.select("host", F.ceil(F.col("count") / SHARD).alias("shards")), "hosts")
    dealt = looked_up(rows, large, "host", MAX_BROADCAST, ["page_id", "url"])
    shards = F.coalesce("shards", F.lit(1))
    return dealt.select(
        "page_id", "url", "html", F.xxhash64("host").alias("site"), (shards > 1).alias("many"),
        F.pmod(F.xxhash64("page_id", "url", "html"), shards).alias("shard"),
    )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars and n_repeated (tokens in repeated runs) of every page."""
    small_batches(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
        host_of(F.col(url_col)).alias("host"),
    )
    kind = pages.schema[id_col].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(page or "") for page in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:4],
                    pa.array([[p for p, _ in f] for f in found], type=pa.list_(pa.string())),
                    pa.array([[t for _, t in f] for f in found], type=pa.list_(pa.string())),
                ],
                names=["page_id", "url", "site", "shard", "places", "blocks"],
            )

    def finish(shard: pa.Table, repeated: np.ndarray) -> pa.Table:
        found = [
            list(zip(p, b, strict=True))
            for p, b in zip(shard.column("places").to_pylist(), shard.column("blocks").to_pylist(), strict=True)
        ]
        texts, covered = choose(found, shard.column("site")[0].as_py() if found else 0, repeated)
        return pa.table(
            {
                "page_id": shard.column("page_id"), "url": shard.column("url"), "text": pa.array(texts, type=pa.string()),
                "n_chars": pa.array([len(t) for t in texts], type=pa.int64()), "n_repeated": pa.array(covered, type=pa.int64()),
            }
        )

    def finish_both(shard: pa.Table, hits: pa.Table) -> pa.Table:
        return finish(shard, np.sort(hits.column("h").to_numpy().view(np.uint64)))

    dealt = _shards(rows)
    seen = _windows(dealt)
    often = seen.groupBy("h").agg(F.count_distinct("stream").alias("n"), F.min("place").alias("least"), F.max("place").alias("most"))
    often = often.where(F.when(F.col("most") == 0, F.col("n") >= MIN_PAGES).otherwise((F.col("least") == 1) & (F.col("most") == 2))).select("h")
    often = materialize(often, "windows")
    parsed = dealt.select("page_id", "url", "site", "shard", "html").mapInArrow(
        parse, f"page_id {kind}, url string, site bigint, shard bigint, places array<string>, blocks array<string>"
    ).groupBy("site", "shard")
    out = f"page_id {kind}, url string, text string, n_chars bigint, n_repeated bigint"
    if often.count() <= MAX_REPEATED:
        sent = pages.sparkSession.sparkContext.broadcast(np.sort(often.toArrow().column("h").to_numpy().view(np.uint64)))
        return parsed.applyInArrow(lambda shard: finish(shard, sent.value), out)
    hits = seen.select("h", "site", "shard").distinct().join(often, "h", "left_semi")
    return parsed.cogroup(hits.groupBy("site", "shard")).applyInArrow(finish_both, out)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op1_html_extraction": op1_html_extraction}
ORACLE: dict[str, str] = {}
