"""Main text of web pages: a suffix array over each host's token streams, with the page's structure as its prior."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.llm.common import ship

#: Element names by what they mean here.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template svg math canvas object".split())
NOT_TEXT = frozenset("nav footer aside form button select option datalist dialog menu head label audio video map".split())
#: Words in class and id, and roles, that name what is not the article.
NOT_WORDS = frozenset("ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promos promotion banner sidebar sidenav menu menubar submenu nav navbar navigation navi breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login signin share sharing social comment comments commentlist disqus reply replies respond related recommended recommendations teaser widget widgets toolbar pagination pager copyright disclaimer masthead topbar skip".split())
#: Words that may stand beside these in a compound name without changing what it names.
WITH_THEM = frozenset("a all area articles bar block body bottom box btn button buttons center container content count div fixed form global grid group header head holder icons inner item items left line links link list main module nav new next none overlay page panel popular post posts pre primary prev region right row s secondary section share site slot small stories sticky sub text thread title top unit wrap wrapper".split())
NOT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
MAIN_WORDS = frozenset("content article post entry story main".split())
KEEP = frozenset(("html", "body", "main", "article"))
#: Words in the class or id of an article element that is not the page's own text.
NOT_ARTICLES = frozenset("comment ad advert related recommended teaser teasers promo sponsored reply replies".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A tag's attributes: values in quotes may hold any character, values without may hold stray quotes; a quote that is never closed is an ordinary character.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"']?+))*+)>", re.S)
_ATTR = re.compile(r"(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_END = {n: re.compile(rf"</{n}\b[^>]*>", re.I) for n in RAW}
INSIDE, OPEN, OUTSIDE = 0, 1, 2  # in the article, in a page without one, structurally left out


def _shut(name: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element's content is left out, and whether its class or id names the main content. A compound name
    (share-buttons, site-footer) counts only if all its words say so: share-price and related-work are content."""
    if name in NOT_TEXT or (name == "header" and not in_article):
        return True, False
    if not attrs or attrs.isspace():
        return False, False
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}
    names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    parts = [[w for w in re.split(r"[^a-z]+", n) if w] for n in names]
    words = {w for p in parts for w in p}
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    main = bool(words & MAIN_WORDS) or found.get("role", "").lower() == "main"
    if name in KEEP:
        return hidden or (name == "article" and bool(words & NOT_ARTICLES)), main
    return hidden or found.get("role", "").lower() in NOT_ROLES or any(p[0] in NOT_WORDS | WITH_THEM and NOT_WORDS.issuperset(set(p) - WITH_THEM) and NOT_WORDS & set(p) for p in parts if p), main


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of every block of a page in its order.

    Zones: INSIDE the article, OPEN in a page that has none, OUTSIDE for what the structure leaves out. The article
    is all article elements, else main, else all elements whose class or id says content, in the main element of the
    longest of them (or outside of main, if that one is), short ones too: comments and teasers go by their class. The
    headings before these in a main or content element around them belong to the article. A block is the text
    between two block-level tags; inline tags leave no trace, a line break is white space. Character references are
    decoded, white space becomes one space. Unclosed elements end with the element around them.
    """
    page = page or ""
    stack: list[tuple[str, bool, int]] = []  # name, left out, article number
    out: list[tuple[bool, int, bool, str]] = []  # left out, article number, heading, text
    text: list[str] = []
    kinds: dict[int, int] = {}  # article number -> rank of its kind
    around: dict[int, int] = {}  # article number -> number of the container around it, 0 for none
    left_out, article, at = False, 0, 0

    def flush() -> None:
        if text:
            t = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if t:
                out.append((left_out, article, any(x[0] in HEADINGS for x in stack), t))

    while True:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            text.append(piece)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name, attrs = m[2].lower(), m[3]
        if name == "br":
            text.append(" ")
            continue
        if name in RAW:
            if not m[1] and not attrs.endswith("/"):
                end = _END[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in BLOCKS or name in NOT_TEXT:
            flush()
        if m[1]:
            if any(x[0] == name for x in stack):
                while stack.pop()[0] != name:
                    pass
        elif name not in VOID:
            if name in BLOCKS:  # an open paragraph ends, and so does an open item of the same list
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p" or (stack[k][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                        del stack[k:]
                        break
                    if stack[k][0] in BLOCKS:
                        break
            above = stack[-1] if stack else ("", False, 0)
            shut, main = _shut(name, attrs, above[2] > 0)
            number = above[2]
            kind = 3 if name == "article" else 2 if name == "main" else 1 if main else 0
            if kind and not (shut or above[1]) and kind > kinds.get(number, 0):
                around[len(kinds) + 1] = number
                number = len(kinds) + 1
                kinds[number] = kind
            stack.append((name, above[1] or shut, number))
        left_out, article = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
    flush()
    sizes: dict[int, int] = {}
    for shut, number, _, t in out:
        if number and not shut:
            sizes[number] = sizes.get(number, 0) + len(t)
    best = max(sizes, key=lambda n: (kinds[n], sizes[n]), default=0)
    if not best:
        return [(OUTSIDE if shut else OPEN, t) for shut, _, _, t in out]

    def containers(n: int) -> list[int]:
        up = []
        while n := around[n]:
            up.append(n)
        return up

    def main_of(n: int) -> int:
        return next((u for u in containers(n) if kinds[u] == 2), 0)

    own = {n for n in sizes if kinds[n] == kinds[best] and main_of(n) == main_of(best)}
    zones, titled = [], set()  # titled: containers around the articles that follow
    for shut, number, heading, _ in reversed(out):
        inside = not shut and (number in own or (heading and number in titled))
        if inside and number in own:
            titled.update(containers(number))
        zones.append(INSIDE if inside else OUTSIDE)
    return [(z, t) for z, (_, _, _, t) in zip(reversed(zones), out)]


#: The host of a URL, between the scheme's slashes (and a user's name) and the port or path.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


class HostStream:
    """Token streams of a host's pages laid end to end, their suffix array and longest common prefixes.

    A suffix is cut at the end of its block, which sorts before every token. Ranks come from prefix doubling, to the
    length of the longest block; the common prefix of neighbours in the array comes from the ranks of each level.
    `order` is the suffix array, `lcp[i]` the tokens that order[i] shares with order[i - 1], an end counted as one.
    Suffixes whose neighbours share DEPTH tokens, or all up to the block's end, are one group: a run of DEPTH tokens or
    more repeats if and only if the suffixes at all its windows of DEPTH tokens lie in groups of several.
    """

    DEPTH = 8

    def __init__(self, pages: list[list[tuple[int, str]]]):
        words = [[t.split(" ") for _, t in p] for p in pages]
        self.lengths = np.array([len(b) for p in words for b in p], np.int64)
        self.page = np.repeat(np.repeat(np.arange(len(pages)), [len(p) for p in words]), self.lengths)
        self.zone = np.repeat(np.array([z for p in pages for z, _ in p], np.int64), self.lengths)
        names: dict[str, int] = {}
        tokens = np.array([names.setdefault(w, len(names) + 1) for p in words for b in p for w in b], np.int64)
        digests = np.array([0, *(xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in names)], np.uint64)
        n = len(tokens)
        first = np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.at = np.arange(n) - first
        self.left = np.repeat(self.lengths, self.lengths) - self.at  # tokens to the end of the block
        self.print = digests[tokens] if n else np.zeros(0, np.uint64)
        base = power = np.full(1, 0x9E3779B97F4A7C15, np.uint64)
        rank, h, levels = tokens, 1, [tokens]
        longest = int(self.left.max()) if n else 0
        while h < max(self.DEPTH, longest + 1):
            later = np.minimum(np.arange(n) + h, max(n - 1, 0))
            inside = self.left > h
            rank = np.unique(rank * (n + 2) + np.where(inside, rank[later], 0), return_inverse=True)[1] + 1
            levels.append(rank)
            if h < self.DEPTH:
                self.print = self.print + np.where(inside, self.print[later], np.uint64(0)) * power
                power = power * power
            h *= 2
            if h >= self.DEPTH and n and int(rank.max()) == n:
                break
        self.print ^= np.minimum(self.left, self.DEPTH).astype(np.uint64) * base
        self.order = np.argsort(rank, kind="stable")
        self.lcp = self._common(levels)
        #: Suffixes that count: a full window, or a whole block that is shorter.
        self.whole = (self.left >= self.DEPTH) | (self.at == 0)

    def _common(self, levels: list[np.ndarray]) -> np.ndarray:
        """Longest common prefixes of neighbours in the array: from the highest level down, a level's rank that both share
        moves both on by as many tokens."""
        n = len(self.order)
        shared = np.zeros(n, np.int64)
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        rest_a, rest_b, done = self.left[a].copy(), self.left[b].copy(), np.zeros(max(n - 1, 0), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same = np.flatnonzero((rest_a > 0) & (rest_b > 0))
            same = same[levels[k][a[same]] == levels[k][b[same]]]
            step = np.minimum(1 << k, rest_a[same])
            done[same] += step
            for at, rest in ((a, rest_a), (b, rest_b)):
                at[same] = np.minimum(at[same] + step, n - 1)
                rest[same] -= step
        done += (rest_a == 0) & (rest_b == 0)  # equal to the end of both blocks
        shared[1:] = done
        return shared

    def _groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group of each suffix, and of each group the pages that have it outside of articles or in pages without one, and outside alone."""
        left = self.left[self.order]
        group = np.empty(len(left), np.int64)
        group[self.order] = np.cumsum((self.lcp < np.minimum(self.DEPTH, left + 1)) | (np.arange(len(left)) == 0)) - 1

        def pages(own: np.ndarray) -> np.ndarray:
            pairs = np.unique(group[own] * (int(self.page[-1]) + 1) + self.page[own])
            return np.bincount(pairs // (int(self.page[-1]) + 1), minlength=int(group.max()) + 1)

        return group, pages(self.whole & (self.zone != INSIDE)), pages(self.whole & (self.zone == OUTSIDE))

    def run_lengths(self) -> np.ndarray:
        """For each suffix the longest run from there that another page's stream has too, as far as its neighbours in the array tell."""
        n, out = len(self.order), np.zeros(len(self.order), np.int64)
        page = self.page[self.order]
        other = np.flatnonzero(page[1:] != page[:-1]) + 1
        common = np.minimum(self.lcp[other], self.left[self.order[other]])
        for side in (other, other - 1):
            np.maximum.at(out, self.order[side], common)
        return out if n else out

    def repeated(self, far: tuple[np.ndarray, np.ndarray, np.ndarray], least: float, least_outside: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each suffix whether, in their streams, `least` pages have its run, `least_outside` pages have it outside of
        articles, and two pages have it. far: prints that other parts of the host bring to so many pages, in these senses."""
        if not len(self.order):
            return (np.zeros(0, bool),) * 3
        group, pages, outside = self._groups()
        several = (pages[group] >= least) | np.isin(self.print, far[0])
        return several & (self.zone != INSIDE), (outside[group] >= least_outside) | np.isin(self.print, far[1]), (pages[group] >= 2) | np.isin(self.print, far[2])

    def covered(self, hit: np.ndarray) -> np.ndarray:
        """Tokens within a run that starts at one of the suffixes."""
        n = len(hit)
        change = np.zeros(n + 1, np.int64)
        at = np.flatnonzero(hit & self.whole)
        np.add.at(change, at, 1)
        np.add.at(change, at + np.minimum(self.left[at], self.DEPTH), -1)
        return np.cumsum(change[:n]) > 0


def removals(pages: list[list[tuple[int, str]]], far: tuple[np.ndarray, np.ndarray, np.ndarray], least: float, least_outside: float) -> tuple[list[list[tuple[int, int, int]]], np.ndarray]:
    """(block, first word, word after the last) to remove from each page of a host, and each page's longest repeated run.

    Where the structure already speaks against a block, outside of articles: words within runs of 8 words, or whole
    shorter blocks, that two pages have. In pages without an article: those that `least` pages of the host have; a page that
    would lose every word is a copy like so many others, and keeps its text. Of articles: short blocks that are covered
    whole by runs which `least_outside` pages have outside of their articles.
    """
    s = HostStream(pages)
    several, outside, two = s.repeated(far, least, least_outside)
    any_, out, twice = s.covered(several), s.covered(outside), s.covered(two)
    longest = np.zeros(len(pages), np.int64)
    np.maximum.at(longest, s.page, np.where(twice & (s.zone != INSIDE), s.run_lengths(), 0))
    ends = np.cumsum(s.lengths)
    result, block = [], 0
    for p in pages:
        spans = [(int(ends[block + k] - s.lengths[block + k]), int(ends[block + k])) for k in range(len(p))]
        block += len(p)
        open_ = [any_[a:z] for (zone, _), (a, z) in zip(p, spans) if zone == OPEN]
        total = sum(map(len, open_))
        copy = total > 0 and all(x.all() for x in open_)
        own: list[tuple[int, int, int]] = []
        for k, ((zone, _), (a, z)) in enumerate(zip(p, spans)):
            hit = twice[a:z] if zone == OUTSIDE else any_[a:z]
            if zone == INSIDE and out[a:z].all():
                own.append((k, 0, z - a))
            elif (zone == OUTSIDE or (zone == OPEN and not copy)) and hit.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                own += [(k, int(b), int(e)) for b, e in zip(edge[::2], edge[1::2])]
        result.append(own)
    return result, longest


def edge_keys(page: list[tuple[int, str]]) -> tuple[list[int], np.ndarray]:
    """Places of the article's blocks, and keys of each block with its distance from the article's start and from its end."""
    places = [k for k, (z, _) in enumerate(page) if z == INSIDE]
    h = np.array([xxhash.xxh64_intdigest(page[k][1].encode("utf-8", "surrogatepass")) for k in places], np.uint64)
    at = np.arange(len(places), dtype=np.uint64)
    mixed = [(h ^ ((2 * d + side) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93) for side, d in ((np.uint64(1), at), (np.uint64(2), at[::-1]))]
    return places, np.array(mixed)


def edge_removals(pages: list[list[tuple[int, str]]], far: np.ndarray, least: float) -> list[list[int]]:
    """Blocks to remove from the start and the end of each page's article: those in a row from the edge that `least` pages
    of the host have at the same distance from it, HostStream.DEPTH words together at least. An article that would go
    as a whole is a copy and stays. far: keys that other parts of the host bring to so many pages."""
    found = [edge_keys(p) for p in pages]
    own, n = np.unique(np.concatenate([k.ravel() for _, k in found]), return_counts=True) if found else (np.zeros(0, np.uint64),) * 2
    common = np.concatenate([own[n >= least], far])
    result = []
    for p, (places, keys) in zip(pages, found):
        hit = np.isin(keys, common)
        front, back = int(np.cumprod(hit[0]).sum()), int(np.cumprod(hit[1][::-1]).sum())
        gone: list[int] = []
        if 0 < front + back and front < len(places) > back:
            for run in (places[:front], places[max(front, len(places) - back) :]):
                if sum(p[k][1].count(" ") + 1 for k in run) >= HostStream.DEPTH:
                    gone += run
        result.append(gone if len(gone) < len(places) else [])
    return result


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", notice_words: int = 40, notice_share: float = 0.5, pages_per_part: int = 512, large_share: float = 1e-6) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars, removed_words, structure_words, longest_run.

    Pages are cut into blocks and zones by their structure (see `blocks_of`), the prior. Then each host's streams are searched
    for long runs that distinct pages share, by a suffix array (`HostStream`, `removals`). Outside of articles, runs go
    that two pages have (removed_words counts the words that go as repeated runs, structure_words those that go
    because the structure alone says so, longest_run is the longest run that the page shares). In a page without an article,
    runs go that half of the host's pages (`notice_share`, 3 pages at least) have in their streams, however much of the
    page they are; runs of fewer pages are copies, quotations or passages and stay. Inside an
    article go notices, which are blocks that half of the host's pages (5 pages at least) have outside of their
    articles, and the blocks in a row from its start or end that so many pages have at the same place (`edge_removals`);
    what else articles share, copies and passages, stays. A stream holds a page's blocks outside of the article, all
    blocks of pages without one, and the article's blocks of up to `notice_words` words (longer ones are never
    notices; edges have no such limit).

    The blocks of a page move once, compressed, to their host's group. A host with more than `pages_per_part` pages that
    has a `large_share` of all pages or more is dealt in parts by a hash of the page. There are at most 1 / large_share
    such hosts, so their list is broadcast. What parts share is found first, by a window over the prints of the runs
    that are not in articles, and each part gets those of its own prints that others have too. So nothing depends on
    where a page lies, and no task holds a whole large host; the pages of such hosts are parsed twice.

    Null html is empty and gives the empty text. A null URL has the empty host. Pages without tags are one block.
    Repeated rows and null identifiers are kept, each row as its own page. An empty table gives no rows. Other columns
    are ignored. Memory follows the longest page and `pages_per_part`.
    """
    spark = pages.sparkSession
    ship(spark)
    kind = pages.schema[id_col].dataType.simpleString()
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col).cast("string"), HOST, 1), F.lit("")))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.col(html_col).alias("_h"))
    total = rows.count()
    sizes = rows.groupBy("host").agg(F.count("*").alias("n")).where((F.col("n") > pages_per_part) & (F.col("n") >= large_share * total))
    large = F.broadcast(sizes.select("host", F.ceil(F.col("n") / pages_per_part).cast("int").alias("parts"), F.col("n").alias("of_host")))  # at most 1 / large_share rows
    dealt = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1))).cast("int")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [blocks_of(x.as_py()) for x in b.column(3)]
            zones = [bytes(z for z, _ in p) for p in found]
            packed = [zlib.compress("\n".join(t for _, t in p).encode("utf-8", "surrogatepass"), 1) for p in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(zones, pa.binary()), pa.array(packed, pa.binary())], names=["page_id", "url", "host", "zones", "blocks"])

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = [blocks_of(x.as_py()) for x in b.column(3)]
            edges = [edge_keys(p)[1].tobytes() for p in whole]
            flows = [[(z, t) for z, t in p if z != INSIDE] for p in whole]
            zones = [bytes(z for z, _ in p) for p in flows]
            packed = [zlib.compress("\n".join(t for _, t in p).encode("utf-8", "surrogatepass"), 1) for p in flows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(zones, pa.binary()), pa.array(packed, pa.binary()), pa.array(edges, pa.binary())], names=["page_id", "url", "host", "zones", "blocks", "edges"])

    schema = f"page_id {kind}, url string, host string, zones binary, blocks binary"

    def prints(t: pa.Table) -> pa.Table:
        s = HostStream(_pages(t))
        group, pages, outside = s._groups() if len(s.order) else (np.zeros(0, np.int64),) * 3
        u, first = np.unique(s.print[s.whole], return_index=True)
        of = group[s.whole][first]
        e, n = np.unique(np.frombuffer(b"".join(t["edges"].to_pylist()), np.uint64), return_counts=True)
        fill = lambda x, a, z: pa.array(np.concatenate([np.zeros(a, np.int64), x, np.zeros(z, np.int64)]), pa.int64())
        key = lambda c, k: pa.array([t[c][0].as_py()] * (len(u) + len(e)), k)
        return pa.table({"host": key("host", pa.string()), "part": key("part", pa.int32()), "print": pa.array(np.concatenate([u, e]).view(np.int64)), "pages": fill(pages[of], 0, len(e)), "outside": fill(outside[of], 0, len(e)), "edges": fill(n, len(u), 0)})

    of_large = rows.join(large.select("host"), "host", "left_semi").select("page_id", "url", "host", "_h").mapInArrow(streams, f"{schema}, edges binary")
    found = of_large.join(large, "host").withColumn("part", dealt).select("host", "part", "zones", "blocks", "edges").groupBy("host", "part").applyInArrow(prints, "host string, part int, print long, pages long, outside long, edges long")
    same = Window.partitionBy("host", "print")
    shared = found.withColumns({"n": F.count("*").over(same), "pages": F.sum("pages").over(same), "outside": F.sum("outside").over(same), "edges": F.sum("edges").over(same)}).where("n > 1")
    far = shared.select("host", "part", "print", "pages", "outside", "edges")

    def decide(t: pa.Table, known: pa.Table) -> pa.Table:
        texts, gone, rest, runs = [], [], [], []
        if t.num_rows:
            share = notice_share * (t["of_host"][0].as_py() or t.num_rows)  # a host that is not large is here as a whole
            least, least_outside = max(3.0, share), max(5.0, share)
            prints_ = known["print"].to_numpy().view(np.uint64)
            far = prints_[known["pages"].to_numpy() >= least], prints_[known["outside"].to_numpy() >= least_outside], prints_[known["pages"].to_numpy() >= 2]
            whole = _pages(t)
            flows = [_flow(p, notice_words) for p in whole]
            edges = edge_removals(whole, prints_[known["edges"].to_numpy() >= least_outside], least_outside)
            spans, longest = removals([f for _, f in flows], far, least, least_outside)
            runs += longest.tolist()
            for p, (places, _), own, ends in zip(whole, flows, spans, edges):
                words: dict[int, list[str | None]] = {k: [None] * (p[k][1].count(" ") + 1) for k in ends}
                for block, a, z in own:
                    w = words.setdefault(places[block], list(p[places[block]][1].split(" ")))
                    w[a:z] = [None] * (z - a)
                done = [" ".join(x for x in words[k] if x is not None) if k in words else t_ for k, (zone, t_) in enumerate(p) if zone != OUTSIDE]
                texts.append("\n".join(x for x in done if x))
                gone.append(sum(x is None for w in words.values() for x in w))
                rest.append(sum(t_.count(" ") + 1 for zone, t_ in p if zone == OUTSIDE) - sum(x is None for k, w in words.items() if p[k][0] == OUTSIDE for x in w))
        columns = [t["page_id"], t["url"], pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in ([len(x) for x in texts], gone, rest, runs))]
        return pa.Table.from_arrays(columns, names=["page_id", "url", "text", "n_chars", "removed_words", "structure_words", "longest_run"])

    parsed = rows.mapInArrow(parse, schema).join(large, "host", "left").withColumn("part", dealt).select("page_id", "url", "host", "part", "of_host", "zones", "blocks")
    return parsed.groupBy("host", "part").cogroup(far.groupBy("host", "part")).applyInArrow(decide, f"page_id {kind}, url string, text string, n_chars long, removed_words long, structure_words long, longest_run long")


def _flow(page: list[tuple[int, str]], notice_words: int) -> tuple[list[int], list[tuple[int, str]]]:
    """The blocks that belong to the host's stream, and their places in the page."""
    places = [k for k, (z, t) in enumerate(page) if z != INSIDE or t.count(" ") < notice_words]
    return places, [page[k] for k in places]


def _pages(t: pa.Table) -> list[list[tuple[int, str]]]:
    blocks = [zlib.decompress(x).decode("utf-8", "surrogatepass") for x in t["blocks"].to_pylist()]
    return [list(zip(z, x.split("\n"))) for z, x in zip(t["zones"].to_pylist(), blocks)]
