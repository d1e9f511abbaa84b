"""HTML extraction with a suffix array for each host.

A page's markup is cut into blocks of text, each with its slot (the elements above it) and a weight from what the markup declares:
noise that repeats (menus, headers, notices, adverts, forms, by their elements and names), noise that may be unique to a page (reader comments, sidebars, footers, hidden parts), an article, a hint, or nothing.

First pass. The token streams of a host's pages are concatenated and their suffixes sorted by prefix doubling, to their full length; the longest common prefixes of neighbours
in that order give every run of RUN or more tokens, and every whole shorter block, that distinct pages share. A page votes if a fifth of its text at
least is its own (copies of an article have none, so copies never vote their text away). Votes decide two things, by shares alone, so alike at every size of a host:

* a run is boilerplate of the host if, with confidence, over half of the host's voting pages have it (lower bound of Wilson's interval at z = 2.58,
  so seven pages of seven are enough, and six are not);
* a slot of a host is boilerplate if the log odds, within +-4, that tokens in it are covered by shared runs, plus the declared weight, pass 1 (undeclared: nearly three of four tokens). The odds are those of the
  host's own voting pages where these are certain that most tokens are the host's own, or boilerplate (Wilson's interval, RUN tokens counted as one); otherwise those of the same slot on all hosts.
  So other hosts judge what a host is too small to judge, and never outweigh its own evidence.

Hosts of more than `tile_pages` pages are split into tiles by a hash of page id and url; a run that reaches half of the host reaches an eighth of some tile, and
from there its votes are summed over the host's tiles. Smaller hosts share tiles, so that the slots of a thin host are judged by runs that other hosts have too.

Second pass. Blocks of boilerplate slots go, then what covered runs are left in the others; the unique runs stay. A page with an article keeps blocks of its
article only. A declaration only ever adds to the odds: a slot of repeating noise whose text is unique on its host stays; only noise that may be unique weighs more than all votes.
With `names` off nothing is declared, and the runs decide alone.

Null html counts as empty and gives an empty text; null urls share the empty host. Character references are decoded; white
space inside a block becomes one space; blocks are joined by one space in page order. Repeated rows and null ids
give a row each; an empty table gives an empty table; extra columns are ignored. Pages of any length are read whole.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash
from .url_filter import host_of

#: Tokens of the shortest run inside longer text that counts as repeated.
RUN = 8
#: Weights in log odds, which votes shift by 4 at most: declared noise that may be unique, and that repeats; a hint of noise, mostly linked text, an article.
UNIQUE, NOISE, HINT, LINKS, MAIN = 6.0, 4.0, 1.5, 1.0, -6.0
#: Log odds at which an undeclared slot is boilerplate: nearly three of four tokens repeat.
LEAST = 1.0
#: Least share of a page's tokens that no other page has, for the page to vote.
OWN = 0.2
#: Host summaries that are broadcast hold so many numbers at most (8 bytes each); larger ones are joined by a shuffle.
BROADCAST = 2_000_000
SALTS = 16
#: Elements whose content is no text; those of the second row stand inside lines.
RAW = frozenset("script style noscript template textarea iframe title select".split()) | {"svg", "math", "object", "button"}
IN_LINE = frozenset({"svg", "math", "object", "button"})
#: A tag; quoted values may hold the bracket that ends it. And what stands before the first bracket, if no quote closes.
TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
CUT_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")
RAW_ENDS = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW}
NAMED = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold an article's text; the second group may hold articles of other people.
SOFT, HARD = frozenset("nav header form menu dialog head".split()), frozenset("footer aside".split())
SOFT_NAMES = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar share sharing social toolbar pagination pager".split())
HARD_NAMES = frozenset("sidebar comment comments commentlist reply replies disqus widget widgets footer copyright".split())
#: Names that noise often has, and articles too.
HINT_NAMES = frozenset("discussion related recommended recommendations respond login search skip".split())
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar".split())
KEPT = frozenset("html body article main".split())


def _place(name: str, attributes: str) -> str:
    """'soft' or 'hard' for an element whose content goes, 'main' for an article, 'hint' for one whose content may be noise, else ''."""
    kind = "main" if name in ("article", "main") else ""
    if name in HARD:
        return "hard"
    if name in SOFT:
        return "soft"
    for key, *values in NAMED.findall(attributes) if attributes and not attributes.isspace() else ():
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "hard"
        if key == "role":
            if value in ROLES:
                return "soft"
            kind = "main" if value in ("main", "article") else kind
        if key in ("class", "id") and name not in ("html", "body", "main"):
            parts = set(re.split(r"[\s_-]+", value))
            if parts & HARD_NAMES:
                return "hard"
            if parts & SOFT_NAMES and name != "article":
                return "soft"
            if parts & HINT_NAMES and not kind:
                kind = "hint"
    return kind


class Block(NamedTuple):
    text: str
    weight: float
    slot: str
    main: bool = False


def _slot(name: str, attributes: str) -> str:
    """An element's step of a slot: its name and the first word of its class or id, without digits."""
    for key, *values in NAMED.findall(attributes) if attributes.strip() else ():
        if key.lower() in ("class", "id") and (word := re.sub("[0-9]+", "", "".join(values).lower()).split()[:1]):
            return f"{name}.{word[0]}"
    return name


def markup(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """start, end, kind, name and attributes (or data) of each piece of markup: 'open' and 'close' tags, 'raw' (an element with its content), 'data' or 'none' (comments and declarations).

    The scan never goes back: a search that has reached the end of the page without a find is not made again. A `<` that begins no markup is text."""
    at = 0
    quotes = brackets = data = True
    while (start := page.find("<", at)) >= 0:
        tag = TAG.match(page, start) if quotes else CUT_TAG.match(page, start) if brackets else None
        if tag is None:
            at, first = start + 1, page[start + 1 : start + 3]
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = len(page) if end < 0 else end + 3
                yield start, at, "none", "", ""
                continue
            if data and page.startswith("<![CDATA[", start):
                end = page.find("]]>", start + 9)
                data = end >= 0
                if data:
                    at = end + 3
                    yield start, at, "data", "", page[start + 9 : end]
                    continue
            letter = first[1:] if first[:1] == "/" else first[:1]
            if letter.isascii() and letter.isalpha():
                # a quote that never closes: from here on the next bracket ends a tag
                quotes = False
                tag = CUT_TAG.match(page, start) if brackets else None
            elif first[:1] in ("/", "!", "?") and brackets and (end := page.find(">", at)) >= 0:
                at = end + 1
                yield start, at, "none", "", ""
                continue
            if tag is None:
                brackets = brackets and page.find(">", at) >= 0
                continue
        at = tag.end()
        closing, name, rest = tag.groups()
        name = name.lower()
        if name in RAW and not closing:
            closed = RAW_ENDS[name].search(page, at)
            at = closed.end() if closed else len(page)
            yield start, at, "raw", name, rest
        else:
            yield start, at, "close" if closing else "open", name, rest


class _Open:
    """The open elements around a place of a page; each step costs the same at any depth."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.places: list[str] = []
        self.steps: list[str] = []
        self.open, self.within = Counter(), Counter()
        #: Depths of open elements of repeating noise, without those that were never closed.
        self.soft: list[int] = []

    def push(self, name: str, place: str, step: str) -> None:
        if place == "soft":
            self.soft.append(len(self.names))
        self.names.append(name)
        self.places.append(place)
        self.steps.append(step)
        self.open[name] += 1
        self.within[place] += 1

    def pop(self) -> str:
        name, place = self.names.pop(), self.places.pop()
        self.steps.pop()
        self.open[name] -= 1
        self.within[place] -= 1
        if self.soft and self.soft[-1] == len(self.names):
            self.soft.pop()
        return name

    def close(self, name: str) -> bool:
        """Close the innermost element of this name with all that it holds."""
        if not self.open[name]:
            return False
        while self.pop() != name:
            pass
        return True

    def inside(self, place: str) -> bool:
        return bool(self.soft) if place == "soft" else self.within[place] > 0


def blocks_of(page: str, names: bool = True) -> list[Block]:
    """All blocks of text in page order; without `names` nothing is declared."""
    out: list[Block] = []
    around = _Open()
    text: list[str] = []
    linked = length = in_link = 0

    def flush() -> None:
        nonlocal linked, length
        block = " ".join(html.unescape("".join(text)).split())
        if block:
            main, weight = names and around.inside("main"), 0.0
            if names:
                weight = MAIN if main else (LINKS if linked > 0.6 * length else 0) + (HINT if around.inside("hint") else 0)
                weight = UNIQUE if around.inside("hard") else NOISE if around.inside("soft") else weight
            out.append(Block(block, weight, ">".join(around.steps[-6:]), main))
        text.clear()
        linked = length = 0

    at = 0
    for start, end, kind, name, rest in markup(page):
        if start > at:
            piece = page[at:start]
            text.append(piece)
            size = len(piece.strip())
            length += size
            linked += size if in_link else 0
        at = end
        if kind == "data":
            text.append(html.escape(rest))
            continue
        if kind == "none":
            continue
        if kind == "raw":
            if name not in IN_LINE:
                flush()
            continue
        closing = kind == "close"
        if name == "a":
            in_link = 0 if closing else 1
        if name in INLINE and not (not closing and _place(name, rest)):
            if closing and around.open[name]:
                flush()
                around.close(name)
            continue
        flush()
        if name in VOID or rest.endswith("/") and not closing:
            continue
        if closing:
            around.close(name)
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and around.names and around.names[-1] == name and not around.places[-1]:
            around.pop()
        place = _place(name, rest)
        if place == "soft" and name == "header" and around.inside("main"):
            place = ""  # an article's own header holds its title
        if place == "main" and not around.inside("hard"):
            around.soft.clear()  # an element that was never closed
        around.push(name, place, _slot(name, rest))
    text.append(page[at:])
    length += len(page[at:].strip())
    flush()
    return out


def suffix_array(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a stream in order, and the longest common prefix of each with the one before (0 for the first)."""
    n, width = len(stream), 1
    ranks = [np.unique(stream, return_inverse=True)[1].astype(np.int32)]
    while n and width < n and ranks[-1].max() + 1 < n:  # ordered by the first 2, 4, 8 ... tokens, until all differ
        after = np.zeros(n, dtype=np.int64)
        after[: n - width] = ranks[-1][width:] + 1
        ranks.append(np.unique(ranks[-1].astype(np.int64) * (n + 1) + after, return_inverse=True)[1].astype(np.int32))
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    common = np.zeros(n, dtype=np.int64)
    a, b = order[1:].copy(), order[:-1].copy()
    for level in range(len(ranks) - 1, -1, -1):  # the common prefix in binary, longest step first
        inside = np.maximum(a, b) + (1 << level) <= n
        same = inside & (ranks[level][np.minimum(a, n - 1)] == ranks[level][np.minimum(b, n - 1)])
        common[1:] += same.astype(np.int64) << level
        a += same.astype(np.int64) << level
        b += same.astype(np.int64) << level
    return order, common


def _distinct(group: np.ndarray, page: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each entry the number of distinct pages in its group, of those that count."""
    if not len(group):
        return np.empty(0, np.int64)
    pairs = np.unique(group * (page.max() + 1) + page)
    of, on = np.divmod(pairs, page.max() + 1)
    return np.bincount(of, counts[on], minlength=group.max() + 1).astype(np.int64)[group]


class Tile:
    """The pages of a tile as one stream of tokens (32-bit numbers), and its units: windows of RUN tokens, and whole blocks of fewer.

    Suffixes that have RUN or more tokens in common stand together in the suffix array; so do the windows that they begin with."""

    def __init__(self, tokens: list[np.ndarray], sizes: list[np.ndarray]):
        self.n = np.array([len(t) for t in tokens], dtype=np.int64)
        flat = np.concatenate([np.empty(0, np.int64), *[np.append(t.astype(np.int64), -1 - p) for p, t in enumerate(tokens)]])
        page = np.repeat(np.arange(len(tokens)), self.n + 1)
        order, common = suffix_array(flat)
        group = np.empty(len(flat), dtype=np.int64)
        group[order] = np.cumsum(common < RUN)
        first = np.cumsum(self.n + 1) - self.n - 1
        at = np.concatenate([np.empty(0, np.int64), *[f + np.arange(max(0, k - RUN + 1)) for f, k in zip(first, self.n, strict=True)]])
        # whole blocks of fewer tokens, told apart by a hash of all of them
        starts = np.concatenate([np.empty(0, np.int64), *[f + np.cumsum(s) - s for f, s in zip(first, sizes, strict=True)]])
        size = np.concatenate([np.empty(0, np.int64), *sizes]).astype(np.int64)
        starts, size = starts[size < RUN], size[size < RUN]
        self.start, self.size = np.concatenate([at, starts]), np.concatenate([np.full(len(at), RUN), size])
        self.page = page[self.start] if len(flat) else np.empty(0, np.int64)
        self.key = keys_of(flat, self.start, self.size)
        short = np.unique(self.key[len(at) :], return_inverse=True)[1] + (group.max(initial=0) + 1)
        self.group = np.concatenate([group[at], short]).astype(np.int64)
        self.stream, self.token = page, np.flatnonzero(flat >= 0)

    def covered(self, units: np.ndarray) -> np.ndarray:
        """For each token whether one of the units covers it."""
        edge = np.zeros(len(self.stream) + 1, dtype=np.int64)
        np.add.at(edge, self.start[units], 1)
        np.add.at(edge, self.start[units] + self.size[units], -1)
        return (np.cumsum(edge)[:-1] > 0)[self.token]

    def votes(self, host: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which pages vote, the tokens that repeats among voters cover, and for each unit how many voting pages of its page's host have it."""
        every = np.ones(len(self.n), dtype=np.int64)
        shared = self.covered(_distinct(self.group, self.page, every) > 1)
        own = np.bincount(self.stream[self.token], ~shared, minlength=len(self.n))
        vote = (own >= OWN * self.n) & (self.n > 0)
        repeated = self.covered(_distinct(self.group, self.page, vote) > 1)
        by_host = np.unique(self.group * (host.max(initial=0) + 1) + host[self.page], return_inverse=True)[1]
        return vote, repeated, _distinct(by_host, self.page, vote)


def keys_of(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of units of tokens."""
    out = size.astype(np.uint64)
    for i in range(int(size.max(initial=0))):
        live = size > i
        x = flat[np.minimum(start + i, len(flat) - 1)].astype(np.uint64) if len(flat) else out
        out = np.where(live, (out ^ (x + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15), out)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _numbers(tokens: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(t.encode()) for t in tokens], dtype=np.int64)


def _slot_key(block: Block) -> int:
    at = f"{block.weight}:{block.slot}".encode()
    return zlib.crc32(at) << 31 ^ zlib.adler32(at)


def pack(blocks: list[Block]) -> bytes:
    """A page's blocks as few bytes for the shuffle: texts, then slots and weights, compressed."""
    marks = np.array([_slot_key(b) for b in blocks], dtype=np.int64).tobytes() + np.array([b.weight for b in blocks]).tobytes()
    return zlib.compress(len(blocks).to_bytes(4, "little") + marks + "\0".join(b.text.replace("\0", " ") for b in blocks).encode(), 1)


def unpack(page: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of a page's tokens, and its blocks' sizes, slots and weights."""
    data = zlib.decompress(page)
    n = int.from_bytes(data[:4], "little")
    words = [t.split(" ") for t in data[4 + 16 * n :].decode().split("\0")] if n else []
    return _numbers([t for w in words for t in w]), np.array([len(w) for w in words], dtype=np.int64), np.frombuffer(data[4 : 4 + 8 * n], np.int64), np.frombuffer(data[4 + 8 * n : 4 + 16 * n], np.float64)


def kept_text(blocks: list[Block], runs: np.ndarray, slots: set[int]) -> str:
    """A page's text: without blocks of boilerplate slots, and without the tokens that boilerplate runs cover."""
    keep = [_slot_key(b) not in slots for b in blocks]
    if any(k and b.main for k, b in zip(keep, blocks, strict=True)):
        keep = [k and b.main for k, b in zip(keep, blocks, strict=True)]
    if not len(runs):
        return " ".join(b.text for k, b in zip(keep, blocks, strict=True) if k)
    words = [b.text.split(" ") for b in blocks]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    tile = Tile([_numbers([t for w in words for t in w])], [sizes])
    gone = tile.covered(np.isin(tile.key, runs))
    stay = np.repeat(np.array(keep, dtype=bool), sizes) & ~gone
    return " ".join(t for t, s in zip((t for w in words for t in w), stay.tolist(), strict=True) if s)


def _bounds(part: Column, whole: Column, z: float = 2.58) -> tuple[Column, Column]:
    """Wilson's interval of a share."""
    p = part / whole
    middle, reach = p + z * z / (2 * whole), z * F.sqrt(p * (1 - p) / whole + z * z / (4 * whole * whole))
    return (middle - reach) / (1 + z * z / whole), (middle + reach) / (1 + z * z / whole)


def evidence(pages: DataFrame, tile_pages: int, names: bool) -> DataFrame:
    """host, kind ('run', 'votes' or 'slot'), key, weight, n, m: votes for each run of a host, its voting pages, and tokens and repeated tokens of its slots, from each tile.

    pages: id, url, html."""
    hosts = pages.groupBy(host_of(F.col("url")).alias("of")).agg(F.count(F.lit(1)).alias("pages"))
    hosts = stash(hosts)
    small = hosts.filter(F.col("pages") <= tile_pages).agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    pools = max(1, -(-small // tile_pages))
    # every large host once for each salt; Spark broadcasts a small table and shuffles a large one
    large = hosts.filter(F.col("pages") > tile_pages).select("of", F.ceil(F.col("pages") / tile_pages).cast("int").alias("tiles"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("of_salt"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [pack(blocks_of(page or "", names)) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["deal", "host", "page"])

    parsed = pages.select(F.xxhash64("id", "url").alias("deal"), host_of(F.col("url")).alias("host"), "html").mapInArrow(parse, "deal bigint, host string, page binary")
    parsed = parsed.withColumn("salt", F.pmod("deal", F.lit(SALTS)).cast("int"))
    tiled = parsed.join(large, (F.col("host") == F.col("of")) & (F.col("salt") == F.col("of_salt")), "left")
    big = F.col("of").isNotNull()
    tiled = tiled.select("host", "page", F.when(big, F.col("host")).otherwise("").alias("pool"), F.when(big, F.pmod(F.xxhash64("deal"), F.col("tiles"))).otherwise(-1 - F.pmod(F.xxhash64("host"), F.lit(pools))).alias("tile"))

    def count(group: pa.Table) -> pa.Table:
        lists = dict(zip(("tokens", "sizes", "slots", "weights"), zip(*map(unpack, group.column("page").to_pylist()), strict=True), strict=True))
        names_, host = np.unique(np.array(group.column("host").to_pylist(), dtype=object), return_inverse=True)
        tile = Tile(lists["tokens"], lists["sizes"])
        vote, repeated, support = tile.votes(host)
        votes = np.bincount(host, vote, minlength=len(names_)).astype(np.int64)
        wanted = np.flatnonzero((support >= 2) & (8 * support >= votes[host[tile.page]]))
        of, first = np.unique(np.stack([host[tile.page[wanted]], tile.key[wanted]]), axis=1, return_index=True)
        out = [("run", of[0], of[1], np.zeros(len(first)), support[wanted][first], np.zeros(len(first), np.int64))]
        out.append(("votes", np.arange(len(votes)), np.zeros(len(votes), np.int64), np.zeros(len(votes)), votes, np.zeros(len(votes), np.int64)))
        sizes = np.concatenate([np.empty(0, np.int64), *lists["sizes"]]).astype(np.int64)
        page = np.repeat(np.arange(len(vote)), [len(x) for x in lists["sizes"]])
        hits = np.bincount(np.repeat(np.arange(len(sizes)), sizes), repeated, minlength=len(sizes)).astype(np.int64)
        slots, weights = (np.concatenate([np.empty(0, k), *lists[c]]) for c, k in (("slots", np.int64), ("weights", np.float64)))
        at, first, to = np.unique(np.stack([host[page], slots]).astype(np.int64), axis=1, return_index=True, return_inverse=True)
        counts = vote[page]
        out.append(("slot", at[0], at[1], weights[first], np.bincount(to.ravel(), sizes * counts, minlength=len(first)), np.bincount(to.ravel(), hits * counts, minlength=len(first))))
        rows = [pa.table([pa.array(names_[h].tolist(), pa.string()), pa.array([kind] * len(h), pa.string()), pa.array(np.asarray(k, np.int64)), pa.array(np.asarray(w, np.float64)), pa.array(np.asarray(n, np.int64)), pa.array(np.asarray(m, np.int64))], ["host", "kind", "key", "weight", "n", "m"]) for kind, h, k, w, n, m in out]
        return pa.concat_tables(rows)

    found = tiled.groupBy("pool", "tile").applyInArrow(count, "host string, kind string, key bigint, weight double, n bigint, m bigint")
    return found.groupBy("host", "kind", "key").agg(F.min("weight").alias("weight"), F.sum("n").alias("n"), F.sum("m").alias("m"))


def boilerplate(found: DataFrame) -> DataFrame:
    """host, runs, slots: the keys of each host's boilerplate (a run is on half of the host's pages, so there are no more than twice a page's tokens)."""
    of = lambda kind: found.filter(F.col("kind") == kind)
    votes = of("votes").select("host", F.col("n").alias("votes"))
    runs = of("run").join(votes, "host").filter(_bounds(F.col("n"), F.col("votes"))[0] >= 0.5).select("host", "key", F.lit(True).alias("run"))
    # each slot's sums over all hosts, under salts, as a slot may be on every host
    pool = of("slot").groupBy("key").agg(F.sum("n").alias("n_all"), F.sum("m").alias("m_all")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    slots = of("slot").withColumn("salt", F.pmod(F.xxhash64("host"), F.lit(SALTS)).cast("int")).join(pool, ["key", "salt"])
    log_odds = lambda n, m: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.log((m + 0.5) / (n - m + 0.5))))
    own, pooled = log_odds(F.col("n"), F.col("m")), log_odds(F.col("n_all"), F.col("m_all"))
    low, high = _bounds(F.col("m") / RUN, F.col("n") / RUN)
    certain = (F.col("n") > 0) & ((high < 0.5) | ((low > 0.5) & (own > LEAST)))
    slots = slots.filter(F.when(certain, own).otherwise(pooled) + F.col("weight") > LEAST).select("host", "key", F.lit(False).alias("run"))
    keys = lambda run: F.collect_list(F.when(F.col("run") == run, F.col("key")))
    return runs.unionAll(slots).groupBy("host").agg(keys(True).alias("runs"), keys(False).alias("slots"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tile_pages: int = 256, names: bool = True, broadcast: int = BROADCAST) -> DataFrame:
    """The main text of every page: the id, url, text (empty if none)."""
    id_type = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    known = stash(boilerplate(stash(evidence(rows, tile_pages, names))).withColumnRenamed("host", "of"))
    size = known.agg(F.coalesce(F.sum(F.size("runs") + F.size("slots") + 8), F.lit(0))).first()[0]
    rows = rows.withColumn("host", host_of(F.col("url")))
    if size <= broadcast:
        rows = rows.join(F.broadcast(known), F.col("host") == F.col("of"), "left")
    else:
        salted = known.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.join(salted, (F.col("host") == F.col("of")) & (F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)) == F.col("of_salt")), "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, slots = (batch.column(i).to_pylist() for i in (3, 4))
            texts = [kept_text(blocks_of(page or "", names), np.array(r or [], dtype=np.int64), set(s or ())) for page, r, s in zip(batch.column(2).to_pylist(), runs, slots, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    out = rows.select("id", "url", "html", "runs", "slots").mapInArrow(read, f"id {id_type}, url string, text string")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
