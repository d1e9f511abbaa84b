"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Each line is good or bad. Its features are shares of character classes, length, word shape and repetition, joined by those of the
lines before and after it. Transition weights tie neighbouring lines together. The field is fitted by gradient ascent
on the likelihood of lines that carry their document's label; a document's score is the mean marginal probability of its
lines being good, from forward-backward sums, weighted by line length.

Only the text enters a score. The fit may use at most `max_train` labelled documents (those with the smallest md5 of
their id, one text for each id: the smallest) and `max_lines` lines (a document whose lines no longer fit is passed over), bounds that keep the driver's share fixed; scoring covers every whole text.

Null and empty texts (and texts of white space alone) have no lines and score 0. Repeated rows and null ids give a
row each. Labels that are null, have no document or are not 0 or 1 are left out; a document with several labels takes the
lowest. Without labels of both kinds every text with a line scores 1 when all labels are 1, 0 when all are 0, else 0.5. An empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, stash

BAD, GOOD = 0, 1
#: Character classes by byte: lower, upper, digit, space, line feed, sentence marks, bar, brackets and quotes, symbols, control, UTF-8 beyond ASCII.
CLASSES = np.full(256, 8, dtype=np.int64)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n", b".,;:?-", b"|", b"()[]{}<>\"'")):
    CLASSES[list(_chars)] = _i
CLASSES[[*range(9), *range(11, 32), 127]] = 9
CLASSES[128:] = 10
N_CLASSES, SPACE, FEED = 11, 3, 4
#: Features of one line: the classes' shares, log length, words per character, repeated-line flag, sentence-end flag, symbols per word, repeated words, constant.
N_LINE = N_CLASSES + 7
N_FEATURES = 3 * N_LINE - 2


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all non-blank lines of the texts: (features, lengths in bytes, lines in each text)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    code = CLASSES[data]
    line = np.repeat(np.arange(len(ends)), ends - starts + 1)
    counts = np.bincount(line * N_CLASSES + code, minlength=len(ends) * N_CLASSES).reshape(-1, N_CLASSES).astype(np.float32)
    length = (ends - starts).astype(np.float32)
    keep = counts[:, SPACE] < length
    starts, ends, owner, counts, length = starts[keep], ends[keep], owner[keep], counts[keep], length[keep]
    raw = data.tobytes()
    hashes = np.array([hash(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=np.int64)
    order = np.lexsort((hashes, owner))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    repeated = np.zeros(len(order), dtype=np.float32)
    repeated[order] = same | np.concatenate([same[1:], [False]]) if len(order) else same
    base = np.empty((len(starts), N_LINE), dtype=np.float32)
    base[:, :N_CLASSES] = counts / np.maximum(length, 1)[:, None]
    base[:, FEED] = 0
    base[:, N_CLASSES] = np.log1p(length) / 6
    base[:, N_CLASSES + 1] = (counts[:, SPACE] + 1) / np.maximum(length, 1)
    base[:, N_CLASSES + 2] = repeated
    last = code[np.maximum(ends - 1, 0)] if len(ends) else np.empty(0, np.int64)
    base[:, N_CLASSES + 3] = (last == 5).astype(np.float32)
    base[:, N_CLASSES + 4] = np.minimum(1, counts[:, 8] / np.maximum(1, counts[:, SPACE] + 1))
    split = [raw[a:b].split() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    base[:, N_CLASSES + 5] = [1 - len(set(w)) / max(1, len(w)) for w in split]
    base[:, N_CLASSES + 6] = 1
    lines = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    wide = np.zeros((len(base), N_FEATURES), dtype=np.float32)
    wide[:, :N_LINE] = base
    if len(base):
        inner = owner[1:] == owner[:-1]
        wide[1:, N_LINE : 2 * N_LINE - 1] = base[:-1, :-1] * inner[:, None]
        wide[:-1, 2 * N_LINE - 1 :] = base[1:, :-1] * inner[:, None]
    return wide, length, lines


def _padded(lines: np.ndarray) -> Iterator[np.ndarray]:
    """Groups of texts of like numbers of lines, so that padding stays below a factor of two."""
    level = np.ceil(np.log2(np.maximum(lines, 1))).astype(int)
    for v in np.unique(level[lines > 0]):
        yield np.flatnonzero((level == v) & (lines > 0))


def marginals(unary: np.ndarray, transition: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all texts side by side.

    unary[line, state] and transition[state, state] are log potentials. Returns each line's marginals and the expected
    number of transitions summed over all texts."""
    first = np.concatenate([[0], np.cumsum(lines)[:-1]])
    out = np.zeros_like(unary, dtype=np.float64)
    pairs = np.zeros((2, 2))
    for group in _padded(lines):
        n, top = lines[group], int(lines[group].max())
        at = np.minimum(first[group][:, None] + np.arange(top), len(unary) - 1)
        live = np.arange(top) < n[:, None]
        u = np.where(live[:, :, None], unary[at], 0.0)
        forward, backward = np.empty_like(u), np.zeros_like(u)
        forward[:, 0] = u[:, 0]
        for t in range(1, top):
            x = forward[:, t - 1, :, None] + transition
            forward[:, t] = np.where(live[:, t, None], np.logaddexp(x[:, 0], x[:, 1]) + u[:, t], forward[:, t - 1])
        for t in range(top - 2, -1, -1):
            x = transition + (u[:, t + 1] + backward[:, t + 1])[:, None, :]
            backward[:, t] = np.where(live[:, t + 1, None], np.logaddexp(x[:, :, 0], x[:, :, 1]), 0.0)
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        out[at[live]] = np.exp(forward + backward - total[:, None, None])[live]
        if top > 1:
            joint = forward[:, :-1, :, None] + transition + (u + backward)[:, 1:, None, :] - total[:, None, None, None]
            pairs += np.exp(joint[live[:, 1:]]).sum(axis=0)
    return out, pairs


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # for state GOOD, on scaled features; BAD has none
    transition: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    constant: float | None = None

    def scores(self, texts: list[bytes]) -> np.ndarray:
        features, length, lines = line_features(texts)
        out = np.zeros(len(texts))
        some = lines > 0
        if self.constant is not None:
            out[some] = self.constant
            return out
        unary = np.zeros((len(features), 2))
        unary[:, GOOD] = ((features - self.mean) / self.scale) @ self.weights
        good, _ = marginals(unary, self.transition, lines)
        owner = np.repeat(np.arange(len(texts)), lines)
        weight = np.bincount(owner, length, minlength=len(texts))
        out[some] = (np.bincount(owner, good[:, GOOD] * length, minlength=len(texts)) / np.maximum(weight, 1))[some]
        return np.clip(out, 0, 1)


def train(features: np.ndarray, lines: np.ndarray, labels: np.ndarray, steps: int = 150, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Gradient ascent (Adam) on the log-likelihood of the lines' labels; each document weighs the same."""
    mean, scale = features.mean(axis=0), features.std(axis=0)
    mean[N_LINE - 1], scale[scale < 1e-6] = 0, 1
    nothing = Model(np.zeros(N_FEATURES), np.zeros((2, 2)), mean, scale)
    if len(set(labels.tolist())) < 2:
        return Model(nothing.weights, nothing.transition, mean, scale, float(labels[0]) if len(labels) else 0.5)
    x = (features - mean) / scale
    y = np.repeat(labels, lines).astype(np.float64)
    w, tr = np.zeros(N_FEATURES), np.zeros((2, 2))
    owner = np.repeat(np.arange(len(lines)), lines)
    weight = 1 / np.maximum(lines, 1)[owner]
    # a document's lines share its weight; transitions keep the count of the lines
    inner = owner[1:] == owner[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][inner].astype(int), y[1:][inner].astype(int)), 1)
    m, v = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    docs, n = (lines > 0).sum(), max(1, inner.sum())
    for step in range(1, steps + 1):
        unary = np.zeros((len(x), 2))
        unary[:, GOOD] = x @ w
        p, pairs = marginals(unary, tr, lines)
        g = np.concatenate([x.T @ ((y - p[:, GOOD]) * weight) / docs - decay * w, ((seen - pairs) / n).ravel() - decay * tr.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, tr = w + move[:N_FEATURES], tr + move[N_FEATURES:].reshape(2, 2)
    return Model(w, tr, mean, scale)


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 0, max_train: int = 4000, max_lines: int = 400_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on labelled rows whose fold (crc32 of the id as text, modulo 5) is not `held_out`; at most `max_train` of them, with at most `max_lines` lines."""
    chosen = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold_of(F.col(id_col)) != held_out))
    chosen = chosen.groupBy(F.col(id_col).alias("key")).agg(F.min(label_col).alias("label"))
    chosen = chosen.orderBy(F.md5(F.col("key").cast("string").cast("binary")), "key").limit(max_train)
    # at most max_train keys
    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "key").groupBy("key").agg(F.min("text").alias("text"), F.min("label").cast("int").alias("label"))
    rows = stash(rows)
    fit_in, used = [], 0
    sizes = rows.select("key", F.md5(F.col("key").cast("string").cast("binary")).alias("md5"), F.size(F.split("text", "\n")).alias("lines"))
    for r in sorted(sizes.collect(), key=lambda r: (r["md5"], r["key"])):  # max_train rows at most
        if used + r["lines"] <= max_lines:
            fit_in.append(r["key"])
            used += r["lines"]
    if len(fit_in) < max_train:
        rows = rows.filter(F.col("key").isin(fit_in))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, _, lines = line_features([t.encode() for t in batch.column(1).to_pylist()])
            cuts = np.concatenate([[0], np.cumsum(lines)])
            blobs = [features[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines), pa.array(blobs, pa.binary()), batch.column(2)], ["key", "lines", "features", "label"])

    key_type = docs.schema[id_col].dataType.simpleString()
    got = rows.mapInArrow(run, f"key {key_type}, lines bigint, features binary, label int").orderBy("key", "features").toPandas()
    features = np.frombuffer(b"".join(got["features"]), dtype=np.float32).reshape(-1, N_FEATURES)
    if not len(features):
        features = np.zeros((1, N_FEATURES), dtype=np.float32)
        return train(features, np.array([1]), np.array([], dtype=int))
    return train(features, got["lines"].to_numpy(), got["label"].to_numpy())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with a column `score` between 0 and 1 (digits beyond the ninth are rounded away), in place of any of that name."""
    docs = docs.drop("score")
    names = docs.columns
    schema = docs.withColumn("score", F.lit(0.0)).schema
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                got = model.scores([(t or "").encode() for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.round(got, 9))], [*names, "score"])

    return docs.mapInArrow(run, schema)
