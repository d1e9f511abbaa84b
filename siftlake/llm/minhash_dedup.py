"""MinHash near-duplicates with sequential Bayesian verification, and their connected components.

A text's set holds the 64-bit hashes of its distinct n-word shingles (the whole sequence if it has fewer words); texts with equal sets are one node. A node's signature
has one byte of each of BANDS * ROWS min-hashes; nodes meet when all bytes of a band agree. Two sets at the wanted similarity of 0.85 miss each other in every
band with a chance of 6e-9.

Pairs that meet are compared in batches of signature bytes. After n bytes, m of them equal, the similarity has a Beta(m + 1, n - m + 1) posterior under a uniform prior; a pair goes as soon
as the posterior chance that it reaches the wanted similarity is below `miss`. A byte agrees by chance in 1 of 256 cases, which only keeps pairs longer. Every pair
that survives is confirmed on the full sets, made again from both texts.

Large groups of near copies never expand into all pairs. First every node meets, of the most central nodes of its bands (those that share bands with most others),
the best two, and pairs that survive are confirmed. Then only nodes in different components meet, band by band, in tiles of bounded size (a band of many nodes is cut
into tiles by ngram_join.spread_keys), and each pair only in the first band that it shares. A tile gives no pairs but the nodes that have a partner left; their full
sets come into the same tiles, which give one confirmed link for each two components. So near misses between a large group and its strays are compared where they meet and never listed.

Null texts and texts without words have an empty set and link with nothing. Repeated rows share a node. Null ids give a row each and count in no component's smallest id; a component without any
id has a null one. An empty table gives an empty table; extra columns are ignored. Hashes of 64 bits stand for shingles and sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash
from .ngram_join import MEMORY, Shingler, components, linked, spread_keys

BANDS, ROWS = 40, 6
SIZE = BANDS * ROWS
#: Bytes compared at a time.
BATCH = 16
#: Nodes of a band that one tile holds at most on each side.
TILE = 1024
#: Central nodes that each node meets.
PIVOTS = 2
#: Shingles whose postings are held at a time, about; a longer set is held whole.
ROOM = 4_000_000
#: Pairs of one node that one task confirms.
SPREAD = 2000
MISS = 1e-9
_RANDOM = np.random.default_rng(0x51F7)
FACTORS = _RANDOM.integers(1, 1 << 63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _RANDOM.integers(0, 1 << 63, SIZE, dtype=np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)


def signature(shingles: np.ndarray) -> bytes:
    """A byte of the least value of each of SIZE hash functions."""
    least = np.full(SIZE, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[start : start + 1024, None] * FACTORS + OFFSETS).min(axis=0), out=least)
    return ((least * MIX) >> np.uint64(56)).astype(np.uint8).tobytes()


def least_equal(percent: int, miss: float = MISS, size: int = SIZE) -> np.ndarray:
    """[n]: the fewest equal bytes among the first n with which the posterior chance of the wanted similarity is at least `miss`.

    The chance that a Beta(m + 1, n - m + 1) value is t or more is that of m or fewer successes in n + 1 trials of chance t."""
    t, out = percent / 100, []
    for n in range(size + 1):
        chance, m = 0.0, 0
        while (chance := chance + comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)) < miss:
            m += 1
        out.append(m)
    return np.array(out)


def sequential(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Places of the row pairs of two byte matrices that no batch rules out."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for at in range(0, a.shape[1], BATCH):
        end = min(at + BATCH, a.shape[1])
        equal = equal + (a[alive, at:end] == b[alive, at:end]).sum(axis=1)
        keep = equal >= least[end]
        alive, equal = alive[keep], equal[keep]
    return alive


def nodes_of(docs: DataFrame, width: int) -> DataFrame:
    """id, n, node (null: empty set), text_key (a hash of the text), and for the first text of a node in each task its signature."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen = Shingler(width), set()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                n, nodes, signs = [], [], []
                for s in make(part.column(1).to_pylist()):
                    node = make.node(s) if len(s) else None
                    n.append(len(s))
                    nodes.append(node)
                    signs.append(None if node is None or node in seen else signature(s))
                    if node is not None:
                        seen.add(node)
                    if len(seen) > MEMORY:
                        seen.clear()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), part.column(2), pa.array(signs, pa.binary())], ["id", "n", "node", "text_key", "sign"])

    return docs.select("id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, f"id {id_type}, n bigint, node bigint, text_key bigint, sign binary")


def bands_of(signs: DataFrame, percent: int) -> DataFrame:
    """key, band, node, n, together: the bands that several nodes share. Sets so small that no other set is similar enough have none."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("sign", i * ROWS + 1, ROWS)))
    rows = signs.filter(100 * F.col("n") >= percent * (F.col("n") + 1)).select(F.posexplode(keys).alias("band", "key"), "node", F.col("n").cast("int").alias("n"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("together")).filter("together > 1")
    return rows.join(shared, "key")


def central_pairs(bands: DataFrame) -> DataFrame:
    """Pairs (a, b): each node b with the PIVOTS most central of the nodes that lead its bands."""
    degree = bands.groupBy("node").agg(F.sum("together").alias("degree"))
    lead = bands.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node")).alias("lead"))
    leads = bands.join(lead, "key").filter("lead.node <> node").groupBy("node").agg(F.slice(F.sort_array(F.collect_set("lead"), asc=False), 1, PIVOTS).alias("leads"))
    return leads.select(F.explode("leads.node").alias("a"), F.col("node").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def likely_pairs(pairs: DataFrame, signs: DataFrame, percent: int, miss: float) -> DataFrame:
    """The pairs (a, b) that the sequential comparison of their signatures leaves."""
    least = least_equal(percent, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            fits = batch.filter(pa.array(100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)))
            a, b = (np.frombuffer(b"".join(fits.column(c).to_pylist()), np.uint8).reshape(-1, SIZE) for c in (3, 5))
            alive = pa.array(sequential(a, b, least))
            yield pa.RecordBatch.from_arrays([fits.column(0).take(alive), fits.column(1).take(alive)], ["a", "b"])

    sides = [signs.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sign").alias(f"sign_{x}")) for x in "ab"]
    rows = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "sign_a", "n_b", "sign_b")
    return rows.mapInArrow(run, "a bigint, b bigint")


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each tile of several nodes, from rows sorted by key. A tile is of bounded size and may go over several batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch])
        key = rows.column("key").to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                yield rows.slice(a, b - a)
        held = rows.slice(cuts[-1]).to_batches()
    if sum(x.num_rows for x in held) > 1:
        yield pa.Table.from_batches(held)


def _partners(n: np.ndarray, part: np.ndarray, side: np.ndarray, i: int, percent: int) -> np.ndarray:
    """Places before i, in order of size, of nodes in other components (and on the other side, where there are two) whose size allows a link."""
    first = int(np.searchsorted(n, -(-percent * int(n[i]) // 100)))
    return first + np.flatnonzero((part[first:i] != part[i]) & ((side[first:i] != side[i]) | (side[i] == 2)))


def tile_nodes(tiles: DataFrame, percent: int, miss: float) -> DataFrame:
    """key, side, node, n, part: of each tile (also with band, sign) the nodes that have a partner which no batch of their signatures rules out and with which they share no earlier band."""
    least = least_equal(percent, miss)
    rows = tiles.repartition("key").sortWithinPartitions("key", "n", "node").select("key", "side", "node", "n", "part", "band", "sign")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles(batches):
            side, n, part, band = (tile.column(c).to_numpy() for c in ("side", "n", "part", "band"))
            bits = np.frombuffer(b"".join(tile.column("sign").to_pylist()), np.uint8).reshape(-1, SIZE)
            met = np.zeros(len(n), dtype=bool)
            for i in range(1, len(n)):
                at = _partners(n, part, side, i, percent)
                if len(at):
                    own = np.broadcast_to(bits[i], (len(at), SIZE))
                    at = at[sequential(bits[at], own, least)]
                    shared = (bits[at] == bits[i]).reshape(len(at), BANDS, ROWS).all(axis=2)
                    at = at[shared.argmax(axis=1) == band[i]]
                    met[at] = True
                    met[i] |= len(at) > 0
            if met.any():
                yield from tile.select(["key", "side", "node", "n", "part"]).filter(pa.array(met)).combine_chunks().to_batches()

    return rows.mapInArrow(run, "key bigint, side int, node bigint, n int, part bigint")


def _overlaps(sets: list[np.ndarray], room: int = ROOM) -> np.ndarray:
    """[i, j]: the sizes of the intersections of all sets, by the postings of as many sets at a time as have `room` shingles."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    shared = np.zeros((len(sets), len(sets)), dtype=np.int32)
    block = (np.cumsum(sizes) - 1) // room
    for a, b in ((np.searchsorted(block, x), np.searchsorted(block, x, side="right")) for x in np.unique(block)):
        values, place, counts = np.unique(np.concatenate(sets[a:b]), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(b - a), sizes[a:b])[np.argsort(place, kind="stable")]
        starts = np.cumsum(counts) - counts
        for i, own in enumerate(sets):
            at = np.minimum(np.searchsorted(values, own), len(values) - 1)
            at = at[values[at] == own]
            lengths = counts[at]
            met = np.repeat(starts[at] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            shared[i, a:b] = np.bincount(owner[met], minlength=b - a)
    return shared


def tile_links(tiles: DataFrame, percent: int) -> DataFrame:
    """a, b: of each tile (key, side, node, n, part, shingles) one link, by the full sets, between any two components that have one there."""
    rows = tiles.repartition("key").sortWithinPartitions("key", "n", "node").select("key", "side", "node", "n", "part", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles(batches):
            side, node, n, part = (tile.column(c).to_numpy().astype(np.int64) for c in ("side", "node", "n", "part"))
            sets = [np.frombuffer(x, np.uint64) for x in tile.column("shingles").to_pylist()]
            found: dict[tuple[int, int], tuple[int, int]] = {}
            for i, shared in enumerate(_overlaps(sets)):
                at = _partners(n, part, side, i, percent)
                for j in at[linked(shared[at].astype(np.int64), n[i], n[at], percent)].tolist():
                    found.setdefault((min(part[i], part[j]), max(part[i], part[j])), (int(node[i]), int(node[j])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found.values(), strict=True)], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def texts_of(docs: DataFrame, wanted: DataFrame, signs: DataFrame, broadcast_nodes: int) -> DataFrame:
    """node, text: a text of each wanted node."""
    keys = signs.join(wanted, "node", "left_semi").select("node", "text_key")
    keys = F.broadcast(keys) if wanted.count() <= broadcast_nodes else keys
    return docs.withColumn("text_key", F.xxhash64("text")).join(keys, "text_key").select("node", "text").dropDuplicates(["node"])


def sets_of(texts: DataFrame, width: int) -> DataFrame:
    """node, shingles: the sorted arrays of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(width)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in make(part.column(1).to_pylist())], pa.binary())], ["node", "shingles"])

    return texts.mapInArrow(run, "node bigint, shingles binary")


def confirmed(pairs: DataFrame, docs: DataFrame, signs: DataFrame, width: int, percent: int, broadcast_nodes: int) -> DataFrame:
    """The pairs (a, b) that link by their full sets, made from a text of each. A node of many pairs is copied for each SPREAD of them."""
    wanted = stash(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    texts = stash(texts_of(docs, wanted, signs, broadcast_nodes))
    both = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("node", "other")
    copies = both.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("copies"))
    many = copies.filter("copies > 1")

    def join(rows: DataFrame, side: str, other: str) -> DataFrame:
        rows = rows.join(many.toDF(side, "copies"), side, "left").withColumn("copy", F.pmod(F.xxhash64(other), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
        each = texts.join(many, "node", "left").select(F.col("node").alias(side), F.col("text").alias(f"text_{side}"), F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
        return rows.join(each, [side, "copy"]).drop("copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, known = Shingler(width), {}

        def of(node: int, text: str) -> np.ndarray:
            if node not in known:
                if len(known) >= 64:
                    known.clear()
                known[node] = make([text])[0]
            return known[node]

        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                a, b, text_a, text_b = (c[i].as_py() for c in batch.columns)
                x, y = of(a, text_a), of(b, text_b)
                keep.append(linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    rows = join(join(pairs.select("a", "b"), "b", "a"), "a", "b")
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def dedup(docs: DataFrame, width: int = 3, percent: int = 85, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE, broadcast_nodes: int = 2_000_000) -> DataFrame:
    """One row for each input row: the id, n_shingles, component_id (smallest id reachable by links), kept (the row has that id), n_equal (rows with an equal set)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    nodes = stash(nodes_of(rows, width))
    signs = stash(nodes.filter(F.col("sign").isNotNull()).select("node", "n", "text_key", "sign").dropDuplicates(["node"]))
    bands = stash(bands_of(signs, percent))
    parts = components(stash(confirmed(stash(likely_pairs(central_pairs(bands), signs, percent, miss)), rows, signs, width, percent, broadcast_nodes)))
    tiles = spread_keys(bands.select("key", "node", "n", "band"), parts, tile, ("band",)).join(signs.select("node", "sign"), "node")
    tiles = stash(tile_nodes(tiles, percent, miss))
    wanted = stash(tiles.select("node").distinct())
    if not wanted.isEmpty():
        sets = stash(sets_of(texts_of(rows, wanted, signs, broadcast_nodes), width))
        parts = components(stash(tile_links(tiles.join(sets, "node"), percent)).union(parts.toDF("a", "b")))
    placed = nodes.select("id", "n", "node").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    by_node = stash(placed.filter(F.col("node").isNotNull()).groupBy("node", "part").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n_equal")))
    least = by_node.groupBy("part").agg(F.min("least").alias("component_id"))
    by_node = by_node.join(least, "part").select("node", "component_id", "n_equal")
    out = nodes.select("id", "n", "node").join(by_node, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), F.coalesce("n_equal", F.lit(1)).alias("n_equal"))
