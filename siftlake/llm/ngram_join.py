"""N-gram Jaccard join: exact links between the shingle sets of all texts, and their connected components.

A text's set holds the 64-bit hashes of its distinct n-word shingles (the whole sequence if it has fewer words). Texts with
equal sets are one node. Two nodes link when 100 * shared >= percent * union, so their sizes and their prefixes agree: in any
order common to all sets, the first n - ceil(percent * n / 100) + 1 shingles of both hold a shared one, and it is among the first
n - ceil(2 * percent * n / (100 + percent)) + 1 of the smaller set: those lead. Only where the smaller node leads need two nodes meet in tiles. Frequent shingles come last in that order, so that passages which many texts share seldom bring texts together.

Pairs are checked in two rounds, so that large groups of near copies never expand into all pairs: first every node with the
PIVOTS most central nodes under each shingle of its prefix (those that meet others under most shingles, as the original of near copies does);
then, of the nodes that meet under a shingle, only those still in different components. The second round runs through the nodes
of a shingle by size: a size-banded tile slides over them that holds all that are large enough for the next one; shingles of many nodes are split
into tiles in which only nodes of different components meet. A check
compares hashed bitmap signatures, whose bit counts bound the overlap from above (in the second round narrow ones, then wide ones
of the nodes that are left), and then, for what is left, the sorted arrays.

Null texts and texts without words have an empty set and link with nothing. Repeated rows share a node. Null ids give a row each and count in no
component's smallest id (a component without any id has a null one). An empty table gives an empty table; extra columns are ignored. Hashes of
64 bits stand for shingles and sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, stash

MEMORY = 400_000
#: Most frequent shingles that are ordered last; they travel as one array of 8 bytes each.
HEAVY = 500_000
HEAVY_FROM = 16
PIVOTS = 3
#: Nodes of a key that one tile holds at most on each side.
TILE = 256
#: Bits for each shingle of the signatures of nodes that narrow ones don't tell apart.
WIDE = 4
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


#: A word's hash: the sum of a number for each byte times a power of BASE for its place, then mixed with the word's length.
BASE = 0x9E3779B97F4A7C17
BYTES = np.random.default_rng(0x5EED).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: Bytes hashed at a time; a longer word is hashed whole.
PIECE = 1 << 20
GAP = re.compile(rb"[ \t\n\x0b\x0c\r]")


class Shingler:
    """Shingle sets of texts. Words are hashed in whole arrays of bytes, so that no word becomes an object."""

    def __init__(self, width: int = 5):
        import xxhash

        self.width, self.digest = width, xxhash.xxh3_64_intdigest
        self.powers = self.inverses = np.empty(0, np.uint64)

    def word_hashes(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First bytes and hashes of the words of bytes without upper-case letters."""
        starts, hashes, at = [], [], 0
        while at < len(data):
            found = GAP.search(data, at + PIECE) if at + PIECE < len(data) else None
            end = found.end() if found else len(data)
            raw = np.frombuffer(data, np.uint8, end - at, at)
            if len(self.powers) < len(raw):
                size = max(len(raw), PIECE)
                self.powers, self.inverses = (np.cumprod(np.full(size, x, dtype=np.uint64)) for x in (BASE, pow(BASE, -1, 1 << 64)))
            space = SPACE[raw]
            first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
            if len(first):
                value = BYTES[raw] * self.powers[: len(raw)]
                value[space] = 0
                h = np.add.reduceat(value, first) * self.inverses[first]
                last = np.flatnonzero(~space & np.concatenate([space[1:], [True]]))
                h ^= h >> np.uint64(32)
                h *= np.uint64(0xD6E8FEB86659FD93)
                h += (last - first + 1).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
                starts.append(first + at)
                hashes.append(h ^ (h >> np.uint64(29)))
            at = end
        if not starts:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        return np.concatenate(starts), np.concatenate(hashes)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The sorted set of each text."""
        own = [(t or "").encode() for t in texts]
        starts, h = self.word_hashes(b" ".join(own).translate(LOWER_BYTES))
        ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in own])).tolist()
        n = max(0, len(h) - self.width + 1)
        x = np.zeros(n, dtype=np.uint64)
        for i in range(self.width):
            x += (h[i : i + n] ^ FACTORS[-1 - i % 4]) * FACTORS[i % 8]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        out, start = [], 0
        for end in ends:
            if end - start >= self.width:
                out.append(np.unique(x[start : end - self.width + 1]))
            else:
                out.append(np.array([self.digest(h[start:end].tobytes())] if end > start else [], dtype=np.uint64))
            start = end
        return out

    def node(self, shingles: np.ndarray) -> int:
        """A signed 64-bit hash of a set."""
        return int(np.uint64(self.digest(shingles.tobytes())).astype(np.int64))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def lead_size(n: str, percent: int) -> Column:
    """How many shingles of a set lead; n: a column's name."""
    return F.expr(f"{n} - ({2 * percent} * {n} + {100 + percent - 1}) div {100 + percent} + 1")


def signature(shingles: np.ndarray, bits_each: int = 1) -> bytes:
    """A bitmap with at least `bits_each` bits for each shingle; its width is a power of two."""
    width = max(64, 1 << (bits_each * len(shingles) - 1).bit_length()) if len(shingles) else 64
    bits = np.zeros(width, dtype=np.uint8)
    bits[((shingles >> np.uint64(20)) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _folded(bitmap: bytes, size: int) -> np.ndarray:
    a = np.frombuffer(bitmap, dtype=np.uint8)
    return np.bitwise_or.reduce(a.reshape(-1, size), axis=0)


def overlap_bound(a: bytes, n_a: int, b: bytes, n_b: int) -> int:
    """No set with these signatures and sizes can share more: bits of one that the other lacks are shingles it lacks."""
    size = min(len(a), len(b))
    x, y = _folded(a, size), _folded(b, size)
    return min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))


def linked(shared: int | np.ndarray, n_a: int, n_b: int | np.ndarray, percent: int) -> bool | np.ndarray:
    return 100 * shared >= percent * (n_a + n_b - shared)


def heavy_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles of very many texts, sorted. Which ones are found changes the speed, never the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, sets, size = Shingler(width), [], 0

        def out() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(sets), return_counts=True)
            often = n > 2
            return pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(n[often])], ["key", "n"])

        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                more = make(batch.column(0).slice(start, 512).to_pylist())
                sets += more
                size += sum(map(len, more))
                if size > 2_000_000:
                    yield out()
                    sets, size = [], 0
        if sets:
            yield out()

    counts = stash(docs.select("text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= HEAVY_FROM))
    levels = {r["level"]: r["count"] for r in counts.groupBy(F.floor(F.log2("n")).alias("level")).count().collect()}
    least, room = max(levels, default=0) + 1, HEAVY
    while levels and least > min(levels) and levels.get(least - 1, 0) <= room:
        least -= 1
        room -= levels.get(least, 0)
    return np.sort(counts.filter(F.floor(F.log2("n")) >= least).select("key").toArrow().column("key").to_numpy().view(np.uint64))


def nodes_of(docs: DataFrame, heavy: np.ndarray, width: int, percent: int) -> DataFrame:
    """id, n, node (null: empty set), text_key (a hash of the text), and for the first text of a node in each task its signature and prefix."""
    id_type = docs.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen, often = Shingler(width), set(), shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                n, nodes, marks, prefixes = [], [], [], []
                for s in make(part.column(1).to_pylist()):
                    n.append(len(s))
                    node = make.node(s) if len(s) else None
                    nodes.append(node)
                    if node is None or node in seen:
                        marks.append(None)
                        prefixes.append(None)
                        continue
                    seen.add(node)
                    if len(seen) > MEMORY:
                        seen.clear()
                    at = np.minimum(np.searchsorted(often, s), max(0, len(often) - 1))
                    last = often[at] == s if len(often) else np.zeros(len(s), bool)
                    marks.append(signature(s))
                    prefixes.append(np.concatenate([s[~last], s[last]])[: prefix_size(len(s), percent)].view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(marks, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), part.column(2)], ["id", "n", "node", "mark", "prefix", "text_key"])

    return docs.select("id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, f"id {id_type}, n bigint, node bigint, mark binary, prefix array<bigint>, text_key bigint")


def postings_of(nodes: DataFrame, percent: int) -> DataFrame:
    """key, node, n, lead, use: the postings of keys with several nodes. A posting is of use beyond the most central nodes if it leads, or if a smaller one of its key does."""
    rows = nodes.filter(F.col("prefix").isNotNull()).select(F.posexplode("prefix").alias("pos", "key"), "node", F.col("n").cast("int").alias("n"))
    # the sign of n says whether a posting leads
    rows = rows.select("key", "node", F.when(F.col("pos") < lead_size("n", percent), F.col("n")).otherwise(-F.col("n")).alias("n"))
    rows = rows.repartition("key").sortWithinPartitions("key", F.col("n") < 0, F.abs("n"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last row waits, as only the next one shows whether its key has more nodes; `first` is the signed size of its key's first node
        held, held_is_out, first = None, False, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            key, node, n = (rows.column(i).to_numpy() for i in range(3))
            same_key = np.concatenate([[False], key[1:] == key[:-1]])
            new = ~same_key | np.concatenate([[True], node[1:] != node[:-1]])
            group = np.cumsum(~same_key) - 1
            keep = new & (np.bincount(group, new)[group] > 1)
            last = int(np.flatnonzero(new)[-1])
            last_is_out = bool(keep[last]) or last == 0 and held_is_out
            least = n[~same_key]
            if held is not None:
                least[0] = first
                keep[0] &= not held_is_out
            held, held_is_out, first = rows.slice(last, 1).to_batches()[0], last_is_out, int(least[-1])
            out = np.flatnonzero(keep)
            size, least = n[out], least[group[out]]
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(node[out]), pa.array(np.abs(size)), pa.array(size > 0), pa.array((least > 0) & ((size > 0) | (-size >= least)))], ["key", "node", "n", "lead", "use"])

    return rows.mapInArrow(run, "key bigint, node bigint, n int, lead boolean, use boolean")


def star_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the PIVOTS most central nodes of each key with the key's other nodes of fitting sizes."""
    central = postings.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    rows = postings.select("key", "node", "n").join(central, "node").repartition("key").sortWithinPartitions("key", F.desc("degree"), "node").select("key", "node", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivots, seen = None, [], set()
        for batch in batches:
            out = []
            for key, node, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != at:
                    at, pivots = key, []
                for pivot, size in pivots:
                    if 100 * min(n, size) >= percent * max(n, size) and (pivot, node) not in seen:
                        seen.add((pivot, node))
                        out.append((pivot, node))
                if len(pivots) < PIVOTS:
                    pivots.append((node, n))
                if len(seen) > MEMORY:
                    seen.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def spread_keys(postings: DataFrame, parts: DataFrame, tile: int = TILE, more: tuple[str, ...] = ()) -> DataFrame:
    """key, side, node, n, part (and the columns `more` of the postings): the postings of the keys whose nodes are in different components, dealt into tiles; `key` numbers the tile.

    A key of up to `tile` nodes is one tile (side 2). The nodes of a larger one are cut by a hash into tiles of that size (side 0), and its nodes outside its
    largest component, of which every pair across components has one, meet each of these tiles (side 1), in tiles of their own if they are many."""
    rows = postings.join(parts, "node", "left").select("key", "node", "n", *more, F.coalesce("part", "node").alias("part"))
    mixed = rows.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("all")).filter("low <> high").select("key", "all")
    rows = rows.join(mixed, "key")
    # only the few keys of more nodes than a tile are counted by component
    hot = rows.filter(F.col("all") > tile).groupBy("key", "part", "all").agg(F.count(F.lit(1)).alias("size")).groupBy("key", "all").agg(F.max(F.struct("size", "part")).alias("most"))
    hot = hot.select("key", F.ceil(F.col("all") / tile).cast("int").alias("cut"), F.ceil((F.col("all") - F.col("most.size")) / tile).cast("int").alias("few"), F.col("most.part").alias("most"))
    rows = rows.join(hot, "key", "left")
    own = lambda n: F.pmod(F.xxhash64(F.lit(7), "node"), n).cast("int")
    spot = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    row = F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda j: spot(own(F.col("cut")), j, 0))
    column = F.transform(F.sequence(F.lit(0), F.col("cut") - 1), lambda i: spot(i, own(F.col("few")), 1))
    spots = F.when(F.col("cut").isNull(), F.array(spot(F.lit(0), F.lit(0), 2))).when(F.col("part") == F.col("most"), row).otherwise(F.concat(row, column))
    return rows.withColumn("at", F.explode(spots)).select(F.xxhash64("key", "at.i", "at.j").alias("key"), F.col("at.side").alias("side"), "node", "n", "part", *more)


def _near(tile: list[tuple[np.ndarray, ...]], n: int, part: int, side: int, bits: np.ndarray, percent: int) -> Iterator[int]:
    """Nodes of a tile in other components, and on the other side where there are two, whose sizes and signatures allow a link with one node."""
    for sizes, nodes, parts, sides, rows in tile:
        first = np.searchsorted(sizes, -(-percent * n // 100))
        at = first + np.flatnonzero((parts[first:] != part) & ((sides[first:] != side) | (side == 2)))
        if len(at):
            x, y = np.bitwise_or.reduce(bits.reshape(-1, rows.shape[1]), axis=0), rows[at]
            shared = np.minimum(n - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), sizes[at] - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
            yield from nodes[at[linked(shared, n, sizes[at], percent)]].tolist()


def tile_pairs(rows: DataFrame, percent: int, names: bool = False) -> DataFrame:
    """Pairs (a < b) of nodes that meet under a key, may link by their sizes and signatures, and are in different components.

    rows: key, side, node, n, part, lead, mark (see spread_keys). With `names` only the nodes of such pairs are returned, as `node`."""
    rows = rows.repartition("key").sortWithinPartitions("key", "n", "node").select("key", "node", "n", "part", "mark", "side", "lead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tile, seen = None, [], set()
        for batch in batches:
            out = []
            key, node, n, part, side, lead = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3, 5, 6))
            marks = batch.column(4).to_pylist()
            width = np.fromiter(map(len, marks), np.int64, len(marks))
            cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (width[1:] != width[:-1])])).tolist()
            # nodes of one key and one width of signatures stand together, smaller ones first
            for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True):
                if key[a] != at:
                    at, tile = key[a], []
                # the tile holds the leading nodes of this key that are large enough for the next one
                tile = [t for t in tile if 100 * int(t[0][-1]) >= percent * int(n[a])]
                bits = np.frombuffer(b"".join(marks[a:b]), np.uint64).reshape(b - a, -1)
                leads = np.flatnonzero(lead[a:b])
                own = [x[a:b][leads] for x in (n, node, part, side)] + [bits[leads]]
                for i in range(b - a) if tile or len(leads) else ():
                    before = int(np.searchsorted(leads, i))
                    one = int(node[a + i])
                    for other in _near([*tile, tuple(x[:before] for x in own)] if before else tile, int(n[a + i]), part[a + i], side[a + i], bits[i], percent):
                        for found in (one, other) if names else [(min(one, other), max(one, other))]:
                            if found not in seen:
                                seen.add(found)
                                out.append(found)
                if len(leads):
                    tile.append(tuple(own))
                if len(seen) > MEMORY:
                    seen.clear()
            if out:
                columns = [out] if names else zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["node"] if names else ["a", "b"])

    return rows.mapInArrow(run, "node bigint" if names else "a bigint, b bigint").distinct()


def bounded_pairs(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may link by the bound that their bitmaps give."""
    sides = [marks.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("mark").alias(f"mark_{x}")) for x in "ab"]

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(overlap_bound(x, i, y, j), i, j, percent) for i, x, j, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "mark_a", "n_b", "mark_b")), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "mark_a", "n_b", "mark_b").mapInArrow(bound, "a bigint, b bigint")


def sets_of(docs: DataFrame, wanted: DataFrame, width: int, broadcast_nodes: int) -> DataFrame:
    """node, shingles, wide: the sorted arrays and wide signatures of the wanted nodes, made again from texts with their text_key."""
    n = wanted.count()
    keys = wanted.select("text_key").distinct()
    texts = docs.select("text", F.xxhash64("text").alias("text_key"))
    # a few keys filter the texts before they are cut into words; more than that are joined
    texts = texts.join(F.broadcast(keys) if n <= broadcast_nodes else keys, "text_key", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen = Shingler(width), set()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                made = {make.node(s): s for s in make(batch.column(0).slice(start, 512).to_pylist()) if len(s)}
                made = {k: s for k, s in made.items() if k not in seen}
                seen.update(made)
                if len(seen) > MEMORY:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array([s.tobytes() for s in made.values()], pa.binary()), pa.array([signature(s, WIDE) for s in made.values()], pa.binary())], ["node", "shingles", "wide"])

    return stash(texts.mapInArrow(run, "node bigint, shingles binary, wide binary").dropDuplicates(["node"]))


def exact_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by the exact overlap of their sorted arrays."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    with_b = with_a.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return with_b.select("a", "b", "x", "y").mapInArrow(exact, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """node, part: each linked node and the smallest node of its component, by alternating large and small stars."""

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = stash(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while before != (now := state(edges)):
        before = now
        both = edges.union(edges.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stash(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least.select("a", F.col("m").alias("b")))
        edges = stash(small.distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("part"))


def join(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", broadcast_nodes: int = 2_000_000, tile: int = TILE) -> DataFrame:
    """One row for each input row: the id, n_shingles, component_id (smallest id reachable by links), n_equal (rows with an equal set)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    nodes = stash(nodes_of(rows, heavy_shingles(rows, width), width, percent))
    marks = stash(nodes.filter(F.col("mark").isNotNull()).select("node", "n", "mark", "text_key").dropDuplicates(["node"]))
    postings = stash(postings_of(nodes, percent))
    likely = stash(bounded_pairs(star_pairs(postings, percent), marks, percent))
    text_of = marks.select("node", "text_key")
    sets = sets_of(rows, text_of.join(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node"), width, broadcast_nodes)
    links = stash(exact_pairs(likely, sets, percent))
    parts = components(links)
    spread = stash(spread_keys(postings.filter("use").drop("use"), parts, tile, ("lead",)))
    near = stash(tile_pairs(spread.join(marks.select("node", "mark"), "node"), percent, names=True))
    if not near.isEmpty():
        # narrow signatures leave few nodes, and only these get wide ones
        sets = sets_of(rows, text_of.join(near, "node"), width, broadcast_nodes)
        more = stash(tile_pairs(spread.join(sets.select("node", F.col("wide").alias("mark")), "node"), percent))
        links = links.union(exact_pairs(more, sets, percent))
        parts = components(stash(links))
    placed = nodes.select("id", "n", "node").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    by_node = placed.filter(F.col("node").isNotNull()).groupBy("node", "part").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n_equal"))
    by_node = stash(by_node)
    least = by_node.groupBy("part").agg(F.min("least").alias("component_id"))
    by_node = by_node.join(least, "part").select("node", "component_id", "n_equal")
    out = nodes.select("id", "n", "node").join(by_node, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_equal", F.lit(1)).alias("n_equal"))
