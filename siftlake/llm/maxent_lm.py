"""LM scoring with a hashed maximum-entropy model.

Tokens are words (A-Z lower-cased) and one end for each text. The softmax is factored by class: the OWN most frequent tokens are
classes of their own, the other tokens that training saw twice or more fall into GROUPS classes by a hash of their first
bytes, and tokens seen once stand with all unseen ones in a last class. P(token | context) = P(class | context) * P(token | class, context).

The class model is a maximum-entropy model: the weights of hashed n-gram features (the last class, the last two) and skip features (the class
before the last, the one before that) add up and are normalised over the classes. Its sufficient statistic is the count of (three classes of context, class), at most
CONTEXTS * CLASSES rows; gradients are summed over its partitions in every step.

Inside a class of many tokens the softmax has hashed features of tokens: the pairs (last token, token) that training saw twice or
more, over the token's share of the class: P(token | class, context) = share * exp(w) / Z, with Z over the whole class, as tokens without a
feature keep their share. A group (last token and class) with more than PART training events is fitted once from the counts of its pairs, which are no more than the class has tokens; its events are cut by their texts into about PART each, and every cut gets these weights, so no part grows with the corpus and no score depends on cuts. These features are as many as the corpus has (told apart inside a part by 32 bits of hashes for the last token and class and 32 for the token, not kept in a table of a fixed size). Every event goes to the part
that its group names, so a part holds all that Z needs; there the weights are updated by gradients and the events are scored at once, in sparse
arrays, and the sums return to their texts. A part has about PART training tokens, so parts grow in number, not in size. A batch of texts sends a part each group and each pair once and two bytes for each event, and parts are
scored in at most LANES lanes that add up their sums, so neither way grows with the number of parts. Equal texts that a task meets together travel once. In the last class unseen tokens (one event, as in the base) have the Good-Turing share n1 / (n1 + 2 n2).

Three passes tokenise texts: counting tokens, counting classes, and sending events, which also scores classes (each distinct context's norm once). What a text's tokens give without
features of tokens travels with its events and returns with their sum, so rows meet it by the hash of their text. In a batch each distinct token is looked up once, in order of hashes.

Counts of tokens reach the tasks as a broadcast of (64-bit hash, count, class) while the vocabulary has at most `broadcast_vocab` tokens (13 bytes for each). Beyond that tokens seen once are left out,
if no held-out text has them: what a training text has besides was seen once. Where these are too many as well, each text's distinct tokens are joined with the counts, salted. All ways give the same scores.

Null texts count as empty; an empty text is one end. Repeated rows and null ids give a row each. Without training texts
every token is unseen. An empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, fold_of, stash, words
from .ngram_join import Shingler

#: The end of a text as a token: no word is a space.
END = b" "
END_HASH = np.uint64(0x2545F4914F6CDD1D)
OWN, GROUPS = 39, 24
CLASSES = OWN + GROUPS + 1
LAST = CLASSES - 1
#: Class before the first token of a text, in contexts only.
BEFORE = CLASSES
WIDTH = CLASSES + 1
CONTEXTS = WIDTH**3
BUCKETS = 1 << 13
#: Tokens that a Python worker remembers before it starts anew.
MEMORY = 250_000
#: Training tokens of one part of the events, about.
PART = 1_500_000
#: Variance of the prior of token features, and gradient steps on them.
VARIANCE, TILTS = 2.0, 8
#: Lanes of parts, at most, and texts whose sums one task holds, about.
LANES, MOST_TEXTS = 64, 4_000_000
#: Rows that Python workers get at a time while events are sent and scored.
BATCH_ROWS = 64
#: Steps of log10 in which shares travel.
FINE = 4096
SALTS = 16


def group_of(token: bytes) -> int:
    return OWN + zlib.crc32(token[:2]) % GROUPS


@dataclass(frozen=True)
class Vocabulary:
    """What scoring needs besides the counts: sizes, the tokens with a class of their own, and the tokens of each group."""

    total: int
    distinct: int
    once: int
    twice: int
    own: dict[bytes, int]
    groups: np.ndarray  # training tokens of the tokens seen twice or more, by class
    texts: int = 0
    top: int = 0  # training count of the most frequent token

    @property
    def below(self) -> float:
        """log10 of what the base divides counts by."""
        return float(np.log10(self.total + 0.5 * (self.distinct + 1)))

    @property
    def unseen_share(self) -> float:
        """Of an unseen token within the last class."""
        return 1.0 if not self.once else (self.once + 1) / (self.once + 2 * self.twice + 2)


def kind_of(token: bytes, count: int, vocabulary: Vocabulary) -> int:
    return LAST if count < 2 else vocabulary.own[token] if token in vocabulary.own else group_of(token)


def hashes_of(tokens: list[bytes], make: Shingler) -> np.ndarray:
    """64-bit hashes of tokens, as `Encoder` finds them in texts."""
    out = np.full(len(tokens), END_HASH, dtype=np.uint64)
    out[[t != END for t in tokens]] = make.word_hashes(b" ".join(t for t in tokens if t != END))[1]
    return out


@dataclass(frozen=True)
class Coded:
    """The tokens of some texts in order: class, training count, log10 share of the class and hash of each; how many each text has; training texts."""

    kind: np.ndarray
    count: np.ndarray
    share: np.ndarray
    hash: np.ndarray
    lengths: np.ndarray
    texts: int


class Encoder:
    """Texts to coded tokens, in whole arrays, by sorted hashes of known tokens with their counts and classes."""

    def __init__(self, vocabulary: Vocabulary, keys: np.ndarray, counts: np.ndarray, kinds: np.ndarray):
        self.v, self.keys, self.counts, self.kinds = vocabulary, keys, counts, kinds
        self.make = Shingler()
        self.texts = int(self.look_up(np.array([END_HASH], dtype=np.uint64))[0][0])

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and classes; unseen tokens have no count and the last class. Hashes in order are found several times faster than others, as the search then runs along the keys."""
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64), np.full(len(hashes), LAST)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        known = self.keys[at] == hashes
        return np.where(known, self.counts[at], 0).astype(np.int64), np.where(known, self.kinds[at], LAST).astype(np.int64)

    def share(self, count: np.ndarray, kind: np.ndarray) -> np.ndarray:
        v, share = self.v, np.ones(len(count))
        grouped = (kind >= OWN) & (kind < LAST)
        share[grouped] = count[grouped] / np.maximum(v.groups[kind[grouped]], 1)
        share[(kind == LAST) & (count > 0)] = (1 - v.unseen_share) / max(1, v.once)
        share[count == 0] = v.unseen_share
        return np.log10(share)

    def encode(self, texts: list[bytes], learns: np.ndarray | None = None) -> Coded:
        """learns: which texts are training texts, if tokens seen once are looked up for the others only."""
        starts, words_ = self.make.word_hashes(b" ".join(texts).translate(LOWER_BYTES))
        ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
        lengths = np.diff(ends, prepend=0) + 1
        hashes = np.full(int(lengths.sum()), END_HASH, dtype=np.uint64)
        inner = np.ones(len(hashes), dtype=bool)
        inner[np.cumsum(lengths) - 1] = False
        hashes[inner] = words_
        distinct, to = np.unique(hashes, return_inverse=True)
        count, kind = self.look_up(distinct)
        share = self.share(count, kind)[to]
        count = count[to]
        if learns is not None:
            once = (count == 0) & np.repeat(learns, lengths)
            count[once], share[once] = 1, self.share(np.array([1]), np.array([LAST]))[0]
        return Coded(kind[to], count, share, hashes, lengths, self.texts)


def contexts_of(kinds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The three classes before each token as one number (nearest last)."""
    start = np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    at, out = np.arange(len(kinds)), np.zeros(len(kinds), dtype=np.int64)
    for back in (3, 2, 1):
        out = out * WIDTH + np.where(at - back >= start, kinds[np.maximum(at - back, 0)], BEFORE)
    return out


def features_of(contexts: np.ndarray) -> np.ndarray:
    """Hashed features of contexts: bias, last class, last two, skip to the one before, skip to the one before that."""
    c1, c2, c3 = contexts % WIDTH, contexts // WIDTH % WIDTH, contexts // WIDTH**2
    raw = np.stack([np.zeros_like(c1), 1 + c1, 1000 + c2 * WIDTH + c1, 10_000 + c2, 20_000 + c3]).astype(np.uint64)
    mixed = raw * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64)


def class_log_probabilities(weights: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Natural log P(class | context), a row for each context."""
    s = np.zeros((len(contexts), CLASSES))
    for f in features_of(contexts):
        s += weights[f]
    s -= s.max(axis=1, keepdims=True, initial=-np.inf) if len(s) else 0
    return s - np.log(np.exp(s).sum(axis=1, keepdims=True))


class ClassScores:
    """Natural log P(class | context) of single events; the norm of a context is made when it is first met and kept (8 bytes for each of CONTEXTS)."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.norms = weights, np.full(CONTEXTS, np.nan)

    def __call__(self, contexts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        new = np.unique(contexts[np.isnan(self.norms[contexts])])
        for a in range(0, len(new), 8192):
            some = new[a : a + 8192]
            s = sum(self.weights[f].astype(np.float64) for f in features_of(some))
            top = s.max(axis=1)
            self.norms[some] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
        return sum(self.weights[f, kinds].astype(np.float64) for f in features_of(contexts)) - self.norms[contexts]


def gradient(weights: np.ndarray, contexts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Gradient of the log-likelihood of class counts (a row for each context)."""
    p = np.exp(class_log_probabilities(weights, contexts))
    delta = counts - p * counts.sum(axis=1, keepdims=True)
    out = np.zeros_like(weights)
    for f in features_of(contexts):
        order = np.argsort(f, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], f[order][1:] != f[order][:-1]])) if len(f) else np.empty(0, np.int64)
        if len(first):
            out[f[order][first]] += np.add.reduceat(delta[order], first)
    return out


def count_tokens(texts: DataFrame) -> DataFrame:
    """token (binary), c: over one column of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "c"])
            seen.clear()
            return batch

        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(words((t or "").encode()))
            seen[END] += batch.num_rows
            if len(seen) > 2 * MEMORY:
                yield out()
        if seen:
            yield out()

    return texts.mapInArrow(run, "token binary, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    row = counts.agg(F.sum("c"), F.count(F.lit(1)), F.sum((F.col("c") == 1).cast("long")), F.sum((F.col("c") == 2).cast("long")), F.max("c")).first()
    own = {bytes(r["token"]): i for i, r in enumerate(counts.filter(F.col("c") > 1).orderBy(F.desc("c"), "token").limit(OWN).collect())}
    group = (F.crc32(F.substring("token", 1, 2)) % GROUPS + OWN).cast("int")
    rest = counts.filter((F.col("c") > 1) & ~F.col("token").isin(*[bytearray(t) for t in own])) if own else counts.filter(F.col("c") > 1)
    groups = np.zeros(CLASSES)
    for r in rest.groupBy(group.alias("g")).agg(F.sum("c").alias("c")).collect():
        groups[r["g"]] = r["c"]
    texts = counts.filter(F.col("token") == F.lit(bytearray(END))).agg(F.sum("c")).first()[0] or 0
    return Vocabulary(row[0] or 0, row[1], row[2] or 0, row[3] or 0, own, groups, texts, row[4] or 0)


def hashed_counts(counts: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of a bounded vocabulary, their counts and classes."""

    c_type, name = (pa.int32(), "int") if vocabulary.top < 1 << 31 else (pa.int64(), "bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler()
        for b in batches:
            tokens = b.column(0).to_pylist()
            kinds = [kind_of(t, c, vocabulary) for t, c in zip(tokens, b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(hashes_of(tokens, make).view(np.int64)), b.column(1).cast(c_type), pa.array(kinds, pa.int8())], ["key", "c", "kind"])

    got = counts.select("token", "c").mapInArrow(run, f"key bigint, c {name}, kind tinyint").toArrow()
    keys = got.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], got.column("c").to_numpy()[order], got.column("kind").to_numpy()[order]


def looked_up(rows: DataFrame, counts: DataFrame, vocabulary: Vocabulary, train: Column, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Like hashed_counts, without the tokens seen once that only training texts have; none if there are more than `most` such rows.

    In a training text every other token was seen once, so nothing need be looked up for it."""
    if vocabulary.distinct - vocabulary.once > most:
        return None
    keys, c, kinds = hashed_counts(counts.filter("c > 1"), vocabulary)
    shared = rows.sparkSession.sparkContext.broadcast(keys)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler()
        for b in batches:
            hashes = np.unique(make.word_hashes(b" ".join(t or b"" for t in b.column(0).cast(pa.binary()).to_pylist()).translate(LOWER_BYTES))[1])
            at = np.searchsorted(shared.value, hashes)
            known = at < len(shared.value)
            known[known] = shared.value[at[known]] == hashes[known]
            yield pa.RecordBatch.from_arrays([pa.array(hashes[~known].view(np.int64))], ["key"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(hashes_of(b.column(0).to_pylist(), make).view(np.int64))], ["key"])

    asked = rows.filter(~train).select("text").mapInArrow(others, "key bigint").distinct()
    found = stash(asked.join(counts.filter("c = 1").select("token").mapInArrow(hashed, "key bigint"), "key", "left_semi"))
    if len(keys) + found.count() > most:
        shared.destroy()
        return None
    keys = np.concatenate([keys, found.toArrow().column("key").to_numpy().view(np.uint64)])
    shared.destroy()
    once = len(keys) - len(c)
    order = np.argsort(keys)
    return keys[order], np.concatenate([c, np.ones(once, c.dtype)])[order], np.concatenate([kinds, np.full(once, LAST, kinds.dtype)])[order]


class Corpus:
    """Texts with what their tasks need to look up counts: a broadcast of all, a broadcast of those that texts ask for, or counts joined to each row."""

    def __init__(self, rows: DataFrame, counts: DataFrame, vocabulary: Vocabulary, broadcast_vocab: int, train: Column | None = None):
        """rows: id, text and further columns. train: which of them are training texts, if only their tokens are in `counts`."""
        self.vocabulary, self.shared, self.partly = vocabulary, None, False
        found = hashed_counts(counts, vocabulary) if vocabulary.distinct <= broadcast_vocab else None
        if found is None and train is not None and broadcast_vocab:
            found = looked_up(rows, counts, vocabulary, train, broadcast_vocab)
            self.partly = found is not None
        if found is not None:
            self.shared = rows.sparkSession.sparkContext.broadcast(found)
            self.rows = rows.withColumns({"tokens": F.lit(None).cast("array<binary>"), "counts": F.lit(None).cast("array<bigint>")})
            return
        key = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
        keyed = rows.withColumn("key", key)

        def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = [list(dict.fromkeys([*words((t or "").encode()), END])) for t in b.column(1).to_pylist()]
                at = np.repeat(np.arange(b.num_rows), [len(x) for x in own])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([t for x in own for t in x], pa.binary())], ["key", "token"])

        tokens = keyed.select("key", "text").dropDuplicates(["key"]).mapInArrow(distinct, "key string, token binary")
        # the end and common words are in every text, so each count is there once for each salt
        salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        tokens = tokens.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
        found = tokens.join(salted, ["token", "salt"], "left").groupBy("key").agg(F.collect_list(F.struct("token", F.coalesce("c", F.lit(0)).alias("c"))).alias("found"))
        self.rows = keyed.join(found, "key").withColumns({"tokens": F.col("found.token"), "counts": F.col("found.c")}).drop("key", "found")

    def reader(self) -> Callable[[pa.RecordBatch], Iterator[tuple[int, int, Coded]]]:
        """A function for one task: cuts batches into parts and yields (first row, rows, their coded tokens). Without a column `train` all rows are training texts."""
        shared, vocabulary, partly = self.shared, self.vocabulary, self.partly
        made, make = [], Shingler()

        def of(known: dict[bytes, int]) -> Encoder:
            tokens = list(known)
            keys = hashes_of(tokens, make)
            order = np.argsort(keys)
            c = np.array(list(known.values()), dtype=np.int64)
            kinds = np.array([kind_of(t, n, vocabulary) for t, n in known.items()], dtype=np.int8)
            return Encoder(vocabulary, keys[order], c[order], kinds[order])

        def read(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Coded]]:
            names = batch.schema.names
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [t or b"" for t in part.column(names.index("text")).cast(pa.binary()).to_pylist()]
                if shared is None:
                    encoder = of({t: n for ts, ns in zip(part.column(names.index("tokens")).to_pylist(), part.column(names.index("counts")).to_pylist(), strict=True) for t, n in zip(ts, ns, strict=True)})
                else:
                    if not made:
                        made.append(Encoder(vocabulary, *shared.value))
                    encoder = made[0]
                learns = None
                if partly:
                    learns = part.column(names.index("train")).to_numpy(zero_copy_only=False).astype(bool) if "train" in names else np.ones(part.num_rows, dtype=bool)
                yield start, part.num_rows, encoder.encode(texts, learns)

        return read


def _mix(x: np.ndarray, y: np.ndarray | np.uint64) -> np.ndarray:
    z = (x ^ (y * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(31))


def token_groups(coded: Coded, over: int = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens that share a class with others, in order: place, group (last token and class), training count of the last token. With `over`: only those after a token that training has more often."""
    start = np.repeat(np.cumsum(coded.lengths) - coded.lengths, coded.lengths)
    use = np.flatnonzero((coded.kind >= OWN) & (coded.kind < LAST))
    before, inside = np.maximum(use - 1, 0), use > start[use]
    seen = np.where(inside, coded.count[before], coded.texts)
    if over >= 0:
        keep = seen > over
        use, before, inside, seen = use[keep], before[keep], inside[keep], seen[keep]
    return use, _mix(np.where(inside, coded.hash[before], np.uint64(1)), coded.kind[use].astype(np.uint64) + np.uint64(1)), seen


@dataclass(frozen=True)
class Big:
    """Groups with too many training events for one part, in order, and the number of parts that their events are cut into. The top bit of a group's name is set."""

    groups: np.ndarray
    cuts: np.ndarray

    def find(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each group here, and whether it is one of these."""
        if not len(self.groups):
            return np.zeros(len(group), np.int64), np.zeros(len(group), bool)
        at = np.minimum(np.searchsorted(self.groups, group | TOP_BIT), len(self.groups) - 1)
        return at, self.groups[at] == group | TOP_BIT


TOP_BIT = np.uint64(1 << 63)
NONE = Big(np.empty(0, np.uint64), np.empty(0, np.uint64))


def coded_token(coded: Coded, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token and share as they travel."""
    return (coded.hash[use] >> np.uint64(32)).astype(np.uint32), np.minimum(np.rint(-coded.share[use] * FINE), 65535).astype(np.uint16)


def token_events(coded: Coded, keys: np.ndarray, most: int = PART, big: Big | None = None) -> tuple[np.ndarray, ...]:
    """The tokens that share a class with others, in order: text, group, token, share. Groups in `big` are cut of the texts by their keys; where the sizes of groups are not known, those after a token that training has more than `most` times.

    Cuts say where events go. They must not change a score: see `big_weights`."""
    use, group, seen = token_groups(coded)
    text = np.repeat(np.arange(len(coded.lengths)), coded.lengths)[use]
    if big is None:
        cuts = (1 + seen // most).astype(np.uint64)
    else:
        at, known = big.find(group)
        cuts, group = np.ones(len(group), np.uint64), np.where(known, group | TOP_BIT, group)
        cuts[known] = big.cuts[at[known]]
    group = np.where(cuts > 1, _mix(group, keys[text] % cuts + np.uint64(1)), group)
    return text, group, *coded_token(coded, use)


def tilt(group: np.ndarray, token: np.ndarray, base: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Natural log of P(token | group) / base of each event, where training has seen a token twice or more in the group.

    base: P(token) without this feature, alike for all events of one token and group. weight: how often training has the event. Every feature's weight follows the gradient of the penalised
    likelihood, scaled by its curvature."""
    # one sort of whole numbers takes a third of the time of two
    narrow = group.dtype == token.dtype == np.uint32
    order = np.argsort(group.astype(np.uint64) << np.uint64(32) | token) if narrow else np.lexsort((token, group))
    g, t = group[order], token[order]
    new_group = np.concatenate([[True], g[1:] != g[:-1]])[: len(g)]
    new_pair = new_group | np.concatenate([[True], t[1:] != t[:-1]])[: len(g)]
    pair_of, group_of_event = np.cumsum(new_pair) - 1, np.cumsum(new_group) - 1
    seen = np.bincount(pair_of, weight[order]) if len(g) else np.empty(0)
    every = np.bincount(group_of_event, weight[order]) if len(g) else np.empty(0)
    live = np.flatnonzero(seen >= 2)
    where, p0, n = group_of_event[new_pair][live], base[order][new_pair][live], seen[live]
    w = np.zeros(len(live))
    norm = np.ones(len(every))
    for _ in range(TILTS):
        norm = np.maximum(1e-9, 1 + np.bincount(where, p0 * np.expm1(w), minlength=len(every)))
        p = np.minimum(1.0, p0 * np.exp(w) / norm[where])
        gradient = n - every[where] * p - w / VARIANCE
        w += np.clip(gradient / (every[where] * p * (1 - p) + 1 / VARIANCE), -1, 1)
    norm = np.maximum(1e-9, 1 + np.bincount(where, p0 * np.expm1(w), minlength=len(every)))
    of_pair = np.zeros(len(seen))
    of_pair[live] = w
    out = np.empty(len(g))
    out[order] = of_pair[pair_of] - np.log(norm)[group_of_event]
    return out


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Small batches put together until they have so many rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held.clear()
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _small(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs, behind their width."""
    most = int(values.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return width.to_bytes(1, "little") + values.astype(f"<u{width}").tobytes()


def _read_small(blob: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    width = blob[at]
    return np.frombuffer(blob, f"<u{width}", n, at + 1), at + 1 + n * width


def pack_events(parts: int, entry: np.ndarray, group: np.ndarray, token: np.ndarray, share: np.ndarray, train: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(part, blob) of the events of some texts; entry: their texts, train: how many training rows these have.

    A blob has each group once, each pair of group and token once, and two bytes for each event: its text. So its size does not depend on how many parts a text's events are dealt to."""
    part = (group % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
    pair = group >> np.uint64(32) << np.uint64(32) | token
    order = np.argsort(pair)
    order = order[np.argsort(part[order], kind="stable")]
    part, pair, entry, share = part[order], pair[order], entry[order].astype("<u2"), share[order].astype("<u2")
    first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (part[1:] != part[:-1])])[: len(pair)])
    n, weight = np.diff(first, append=len(pair)), np.add.reduceat(train[entry], first) if len(first) else first
    part_of, pair, share = part[first], pair[first], share[first]
    name = (pair >> np.uint64(32)).astype("<u4")
    lead = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (part_of[1:] != part_of[:-1])])[: len(name)])
    pairs = np.diff(lead, append=len(name))
    met = np.unique(part_of)
    ends = np.stack([np.searchsorted(x, met, side=side) for x in (part, part_of, part_of[lead]) for side in ("left", "right")], axis=1).tolist()
    token = (pair & np.uint64(0xFFFFFFFF)).astype("<u4")
    for p, (a, b, c, d, e, f) in zip(met.tolist(), ends, strict=True):
        head = np.array([b - a, d - c, f - e], "<u4").tobytes()
        yield p, head + b"".join([name[lead[e:f]].tobytes(), token[c:d].tobytes(), share[c:d].tobytes(), entry[a:b].tobytes(), _small(pairs[e:f]), _small(n[c:d]), _small(weight[c:d])])


def unpack_events(blob: bytes) -> tuple[np.ndarray, ...]:
    """Of each pair: group, token, share, weight (training rows of its events), number of events; of each event its text."""
    events, pairs, groups = np.frombuffer(blob, "<u4", 3).tolist()
    at, out = 12, []
    for kind, n in (("<u4", groups), ("<u4", pairs), ("<u2", pairs), ("<u2", events)):
        out.append(np.frombuffer(blob, kind, n, at))
        at += out[-1].nbytes
    in_group, at = _read_small(blob, at, groups)
    n, at = _read_small(blob, at, pairs)
    weight, at = _read_small(blob, at, pairs)
    return np.repeat(out[0], in_group), out[1], out[2], weight, n, out[3]


def send_events(corpus: Corpus, train: Column, parts: int, big: Big = NONE, weights: Broadcast | None = None) -> DataFrame:
    """part, batch, texts, blob: the events of all texts, dealt by group; see token_events for `big` and pack_events for blobs. batch: some texts that a task has met, named by their keys.

    Texts that are equal and in one batch are one of its texts. In part -1 a batch has its marks: the sizes of each text and what its tokens give without features of tokens (their classes by `weights`,
    if given). Batches of one name have equal texts, so what came several times is told by the number of their marks."""
    read, below = corpus.reader(), corpus.vocabulary.below

    def mark_of(coded: Coded, by_class: ClassScores | None) -> np.ndarray:
        out = np.zeros(len(coded.lengths), dtype=MARK)
        first = np.cumsum(coded.lengths) - coded.lengths
        own = coded.share if by_class is None else by_class(contexts_of(coded.kind, coded.lengths), coded.kind) / np.log(10) + coded.share
        out["tokens"], out["known"] = coded.lengths, np.add.reduceat((coded.count > 0).astype(np.int64), first)
        out["base"], out["own"] = np.add.reduceat(np.log10(coded.count + 0.5) - below, first), np.add.reduceat(own, first)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_class = None if weights is None else ClassScores(weights.value)
        keys: dict[int, int] = {}
        learned: list[int] = []
        rows: list[int] = []
        held: list[tuple[np.ndarray, ...]] = []
        said: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            marks, n_train = np.concatenate(said), np.array(learned, dtype=np.int64)
            marks["key"], marks["rows"] = list(keys), rows
            batch = int.from_bytes(hashlib.blake2b(marks["key"].tobytes(), digest_size=8).digest(), "little", signed=True)
            events = [np.concatenate(x) for x in zip(*held, strict=True)]
            keys.clear(), learned.clear(), rows.clear(), held.clear(), said.clear()
            names, blobs = zip((-1, marks.tobytes()), *pack_events(parts, *events, n_train), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(np.full(len(names), batch)), pa.array(np.full(len(names), len(marks), np.int32)), pa.array(blobs, pa.binary())], ["part", "batch", "texts", "blob"])

        for batch in gathered(batches):
            own_keys, learns = batch.column(batch.schema.get_field_index("key")).to_pylist(), batch.column(batch.schema.get_field_index("train")).to_pylist()
            for start, n, coded in read(batch):
                index = np.full(n, -1)
                for i, (k, learn) in enumerate(zip(own_keys[start : start + n], learns[start : start + n], strict=True)):
                    if k not in keys:
                        index[i] = keys[k] = len(keys)
                        learned.append(0)
                        rows.append(0)
                    learned[keys[k]] += learn
                    rows[keys[k]] += 1
                text, *arrays = token_events(coded, np.array(own_keys[start : start + n], dtype=np.int64).view(np.uint64), big=big)
                said.append(mark_of(coded, by_class)[index >= 0])
                fresh = index[text] >= 0
                held.append((index[text][fresh].astype(np.uint16), *(x[fresh] for x in arrays)))
                size += int(fresh.sum())
                if size > 1_000_000 or len(keys) > 50_000:
                    yield out()
                    size = 0
        if held:
            yield out()

    return corpus.rows.select("text", "tokens", "counts", F.xxhash64("text").alias("key"), train.alias("train")).mapInArrow(run, "part int, batch bigint, texts int, blob binary")


#: What is known of one text before its events are scored: its tokens, those that training has, the base score, and the score without features of tokens; its rows in a batch.
MARK = np.dtype([("key", "<i8"), ("tokens", "<i8"), ("known", "<i8"), ("base", "<f8"), ("own", "<f8"), ("rows", "<i8")])


#: The weight of one token in a cut group, and that of tokens without a feature.
WEIGHT = np.dtype([("group", "<u4"), ("token", "<u4"), ("tilt", "<f8"), ("other", "<f8")])


def big_weights(corpus: Corpus, train: Column, parts: int, big: Big) -> DataFrame:
    """part, blob: the weights of groups in `big`, fitted from the counts of all their pairs, for every part that has some of their events.

    A group's pairs are at most the tokens of its class."""
    read = corpus.reader()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            rows, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows["at"]), pa.array(rows["token"].astype(np.int64)), pa.array(rows["share"].astype(np.int32)), pa.array(n)], ["at", "token", "share", "n"])

        for batch in batches:
            for _, _, coded in read(batch):
                use, group, _ = token_groups(coded, 0)
                at, known = big.find(group)
                own = np.zeros(int(known.sum()), dtype=[("at", "<i4"), ("token", "<u4"), ("share", "<u2")])
                own["at"], (own["token"], own["share"]) = at[known], coded_token(coded, use[known])
                held.append(own)
                size += len(own)
            if size > 1_000_000:
                yield out()
                size = 0
        if held:
            yield out()

    def fitted(group: pa.Table) -> pa.Table:
        at = group.column("at")[0].as_py()
        # one more token that training has not seen, for all that have no feature
        token = np.append(group.column("token").to_numpy(), np.int64(1) << 32)
        base, n = np.append(10.0 ** (group.column("share").to_numpy() / -FINE), 1.0), np.append(group.column("n").to_numpy(), 0).astype(np.float64)
        value = tilt(np.zeros(len(token), np.uint64), token, base, n)
        live = np.flatnonzero(n >= 2)
        if not len(live):
            live = np.arange(1)
        rows = np.zeros(len(live), dtype=WEIGHT)
        rows["token"], rows["tilt"], rows["other"] = token[live], value[live], value[-1]
        cuts = _mix(np.repeat(big.groups[at], int(big.cuts[at])), np.arange(big.cuts[at], dtype=np.uint64) + np.uint64(1))
        blobs = []
        for cut in cuts:
            rows["group"] = cut >> np.uint64(32)
            blobs.append(rows.tobytes())
        return pa.table([pa.array((cuts % np.uint64(parts)).astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "blob"])

    counts = corpus.rows.filter(train).select("text", "tokens", "counts").mapInArrow(pairs, "at int, token bigint, share int, n bigint")
    return counts.groupBy("at", "token").agg(F.max("share").alias("share"), F.sum("n").alias("n")).groupBy("at").applyInArrow(fitted, "part int, blob binary")


def tilt_with(weights: np.ndarray, group: np.ndarray, token: np.ndarray, base: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Like tilt; groups that have `weights` (sorted by group and token) take these."""
    out = np.zeros(len(group))
    names, first = np.unique(weights["group"], return_index=True)
    given = np.isin(group, names)
    out[~given] = tilt(group[~given], token[~given], base[~given], weight[~given])
    pairs = weights["group"].astype(np.uint64) << np.uint64(32) | weights["token"]
    wanted = group[given].astype(np.uint64) << np.uint64(32) | token[given]
    at = np.minimum(np.searchsorted(pairs, wanted), max(0, len(pairs) - 1))
    if len(wanted):
        out[given] = np.where(pairs[at] == wanted, weights["tilt"][at], weights["other"][first[np.searchsorted(names, group[given])]])
    return out


def score_events(events: DataFrame, lanes: int = 1, weights: DataFrame | None = None) -> DataFrame:
    """key, add and the fields of MARK: for each text what its tokens' features add to its log10 probability. weights: see big_weights.

    Parts are scored one after another in `lanes` (of each task one or more), and a lane adds up the sums of its texts over its parts, so what returns for a text grows with lanes, not with parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        held: list[tuple[int, int, bytes]] = []
        fitted: list[bytes] = []
        at = None

        def score_part() -> Iterator[pa.RecordBatch]:
            known = np.concatenate([np.empty(0, WEIGHT), *[np.frombuffer(x, WEIGHT) for x in fitted]])
            known = known[np.lexsort((known["token"], known["group"]))]
            each = [unpack_events(x) for _, _, x in held]
            group, token, share, weight = (np.concatenate([x[i] for x in each]) for i in range(4))
            each = [x[4:] for x in each]
            value = tilt_with(known, group, token, 10.0 ** (share.astype(np.float64) / -FINE), weight.astype(np.float64)) / np.log(10)
            first, size = 0, sum(len(x) for x in sums.values())
            for (batch, texts, _), (n, text) in zip(held, each, strict=True):
                if batch not in sums:
                    if size > MOST_TEXTS:
                        yield from out()
                        size = 0
                    sums[batch] = np.zeros(texts)
                    size += texts
                sums[batch] += np.bincount(text, np.repeat(value[first : first + len(n)], n), minlength=texts)
                first += len(n)
            held.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for batch, add in sums.items():
                met = add != 0
                yield pa.RecordBatch.from_arrays([pa.array([batch]), pa.array([np.packbits(met).tobytes() + add[met].tobytes()], pa.binary()), pa.array([None], pa.binary())], ["batch", "sums", "marks"])
            sums.clear()

        for b in batches:
            for part, batch, texts, is_fitted, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != at:
                    if held:
                        yield from score_part()
                    fitted.clear()
                    at = part
                if part < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([batch]), pa.array([None], pa.binary()), pa.array([blob], pa.binary())], ["batch", "sums", "marks"])
                elif is_fitted:
                    fitted.append(blob)
                else:
                    held.append((batch, texts, blob))
        if held:
            yield from score_part()
        yield from out()

    def merge(group: pa.Table) -> pa.Table:
        marks = [x.as_py() for x in group.column("marks") if x.is_valid]
        own = np.frombuffer(marks[0], MARK)
        add = np.zeros(len(own))
        for x in group.column("sums"):
            if x.is_valid:
                blob = x.as_py()
                met = np.unpackbits(np.frombuffer(blob, np.uint8, -(-len(own) // 8)), count=len(own)).astype(bool)
                add[met] += np.frombuffer(blob, np.float64, int(met.sum()), -(-len(own) // 8))
        rows = np.sum([np.frombuffer(x, MARK)["rows"] for x in marks], axis=0)
        return pa.table([pa.array(own["key"]), pa.array(add / len(marks)), *[pa.array(own[x]) for x in MARK.names[1:-1]], pa.array(rows)], ["key", "add", *MARK.names[1:]])

    events = events.withColumn("fitted", F.lit(False))
    if weights is not None:
        events = events.unionByName(weights.withColumns({"fitted": F.lit(True), "batch": F.lit(0).cast("bigint"), "texts": F.lit(0)}))
    lane = F.pmod(F.when(F.col("part") < 0, F.col("batch")).otherwise(F.col("part")), F.lit(lanes)).cast("int")
    # the weights of a part come before its events
    sums = events.withColumn("lane", lane).repartition("lane").sortWithinPartitions("lane", "part", F.desc("fitted")).select("part", "batch", "texts", "fitted", "blob").mapInArrow(run, "batch bigint, sums binary, marks binary")
    texts = sums.groupBy("batch").applyInArrow(merge, "key bigint, add double, tokens bigint, known bigint, base double, own double, rows bigint")
    # a text that several batches have is the same in each
    return texts.groupBy("key").agg(*[F.max(c).alias(c) for c in ("add", *MARK.names[1:-1])], F.sum("rows").alias("rows"))


def class_counts(corpus: Corpus, train: Column, partitions: int, most: int = PART) -> DataFrame:
    """context, rows (kind, n): how often each class followed each context in the training texts.

    Below zero stand the groups of events after tokens that training has more than `most` times: with one row, their number of events. See big_groups."""
    read = corpus.reader()
    frequent = max(corpus.vocabulary.top, corpus.vocabulary.texts) > most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64), np.zeros(0, np.int64)
        parts: list[np.ndarray] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, n = np.unique(np.concatenate(parts), return_counts=True) if parts else seen
            every, to = np.unique(np.concatenate([seen[0], keys]), return_inverse=True)
            return every, np.bincount(to, np.concatenate([seen[1], n]), minlength=len(every)).astype(np.int64)

        for batch in batches:
            for _, _, coded in read(batch):
                parts.append(contexts_of(coded.kind, coded.lengths) * CLASSES + coded.kind)
                size += len(coded.kind)
                if frequent:
                    parts.append((token_groups(coded, most)[1] | TOP_BIT).view(np.int64))
            if size > 2_000_000:
                seen = merged()
                parts.clear()
                size = 0
        keys, n = merged()
        for a in range(0, len(keys), 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + (1 << 20)]), pa.array(n[a : a + (1 << 20)])], ["key", "n"])

    pairs = corpus.rows.filter(train).select("text", "tokens", "counts").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    # a context has at most CLASSES rows
    return pairs.groupBy(F.when(F.col("key") < 0, F.col("key")).otherwise(F.floor(F.col("key") / CLASSES)).alias("context")).agg(F.collect_list(F.struct(F.pmod("key", F.lit(CLASSES)).alias("kind"), "n")).alias("rows")).repartition(partitions, "context")


def big_groups(classes: DataFrame, most: int) -> Big:
    """Groups of more than `most` training events; they are at most the training tokens / most. classes: see class_counts."""
    got = {r["context"]: r["n"] for r in classes.filter("context < 0").select("context", F.col("rows")[0]["n"].alias("n")).filter(F.col("n") > most).collect()}
    groups = np.sort(np.array(list(got), dtype=np.int64).view(np.uint64))
    return Big(groups, np.array([1 + got[g] // most for g in groups.view(np.int64).tolist()], dtype=np.uint64))


def fit(contexts: DataFrame, steps: int = 14, rate: float = 0.25) -> np.ndarray:
    """Weights by Adam; every step's gradient is summed over the partitions of the contexts' counts."""
    weights = np.zeros((BUCKETS, CLASSES))
    m, v, total = np.zeros_like(weights), np.zeros_like(weights), None
    sc = contexts.sparkSession.sparkContext
    for step in range(1, steps + 1):
        shared = sc.broadcast(weights.astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            w, out, n = shared.value.astype(np.float64), np.zeros((BUCKETS, CLASSES)), 0.0
            for b in batches:
                rows = b.column(1)
                counts = np.zeros((b.num_rows, CLASSES))
                at = np.repeat(np.arange(b.num_rows), np.diff(rows.offsets.to_numpy()))
                counts[at, rows.flatten().field("kind").to_numpy()] = rows.flatten().field("n").to_numpy()
                out += gradient(w, b.column(0).to_numpy(), counts)
                n += counts.sum()
            used = np.flatnonzero(np.abs(out).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array([*(out[i].astype(np.float32).tobytes() for i in used), np.float64(n).tobytes()], pa.binary())], ["bucket", "g"])

        got = contexts.mapInArrow(run, "bucket bigint, g binary").toArrow()
        g, n = np.zeros_like(weights), 0.0
        for bucket, value in zip(got.column("bucket").to_pylist(), got.column("g").to_pylist(), strict=True):
            if bucket < 0:
                n += np.frombuffer(value, np.float64)[0]
            else:
                g[bucket] += np.frombuffer(value, np.float32)
        shared.unpersist()
        total = n
        if not total:
            break
        g = g / total - 1e-7 * weights
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        weights += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return weights


def score(docs: DataFrame, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text", broadcast_vocab: int = 8_000_000, partitions: int = 8, part: int = PART) -> DataFrame:
    """Learn from the texts whose fold (crc32 of the id as text, modulo 5) is not `held_out` and score all.

    Returns the id, held_out, n_tokens, n_known, train_tokens, base_score (add-half unigram) and score, both as log10 probabilities."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (fold_of(F.col(id_col)) == held_out).alias("held_out"))
    counts = stash(count_tokens(rows.filter(~F.col("held_out")).select("text")))
    vocabulary = vocabulary_of(counts)
    corpus = Corpus(rows, counts, vocabulary, broadcast_vocab, ~F.col("held_out"))
    classes = stash(class_counts(corpus, ~F.col("held_out"), partitions, part))
    weights = fit(classes.filter("context >= 0")).astype(np.float32)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    parts = max(1, -(-vocabulary.total // part))
    big = big_groups(classes, part)
    of_big = big_weights(corpus, ~F.col("held_out"), parts, big) if len(big.groups) else None
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, str(min(BATCH_ROWS, max(1, int(before)) if int(before) > 0 else BATCH_ROWS)))
    try:
        adds = stash(score_events(send_events(corpus, ~F.col("held_out"), parts, big, shared), min(LANES, parts), of_big))
    finally:
        spark.conf.set(size, before)
    # texts with a thousandth of all rows or more, a thousand at most, spread over several tasks
    hot = F.col("rows") * 1000 >= F.lit(adds.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
    keyed = rows.select("id", "held_out", F.xxhash64("text").alias("key")).join(F.broadcast(adds.filter(hot).select("key", F.lit(True).alias("hot"))), "key", "left")
    keyed = keyed.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(0))
    adds = adds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(hot, SALTS - 1).otherwise(0))))
    out = keyed.join(adds.drop("rows"), ["key", "salt"], "left")
    total = F.lit(vocabulary.total).cast("bigint").alias("train_tokens")
    out = out.select("id", "held_out", F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), total, F.col("base").alias("base_score"), (F.col("own") + F.col("add")).alias("score"))
    return out.withColumnRenamed("id", id_col)
