"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counted over whole texts. The trees are grown here: each feature is cut at quantiles into at most 64 bins, and a split is
chosen from histograms of gradients. The fitted trees are flattened into arrays, and numpy walks all rows of a batch down a tree
level by level.

Fitted on a bounded sample: at most TRAIN_ROWS labelled rows, chosen by a hash of the id. Every document is scored.

Defined results: a null text counts as empty and is scored like one; labels other than 0 and 1, and null ones, teach nothing; of a
repeated label row the greatest label holds; without labelled rows every score is 0.5, with rows of one label only it is their share,
smoothed. Repeated rows get equal scores. An empty table gives an empty table. Other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import CHUNK_BYTES, bounded, text_buffers, word_stream

TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, LEAST, SMOOTH = 80, 4, 0.15, 20, 1.0
BINS = 64
FEATURES = (
    "chars", "words", "mean_word", "long_words", "distinct_words", "repeated_next", "top_pair_share", "repeated_triples", "lines", "mean_line", "repeated_lines", "upper", "digits", "marks",
    "symbols", "pipes", "exclamations", "periods", "high_bytes", "spaces", "marked_words", "upper_words",
)

_KIND = np.zeros((256, 10), np.int64)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b"#*$%&<>@^~_=+\\", b"|", b"!", b".", bytes(range(128, 256)), b" \t", b"\n")):
    _KIND[list(_chars), _i] = 1


def _repeats(h: np.ndarray) -> float:
    return 1 - len(np.unique(h)) / len(h) if len(h) else 0.0


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    data, offsets = text_buffers(column)
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    newline = np.uint8(10)
    for i, (words, starts, ends) in enumerate(word_stream(column)):
        raw = data[offsets[i] : offsets[i + 1]]
        size = len(raw)
        if not size:
            continue
        counts = np.zeros(10, np.int64)
        for lo in range(0, size, CHUNK_BYTES):
            counts += np.bincount(raw[lo : lo + CHUNK_BYTES], minlength=256) @ _KIND
        upper, digits, marks, symbols, pipes, shouts, periods, high, spaces, breaks = counts / size
        n = len(words)
        row = out[i]
        row[[0, 11, 12, 13, 14, 15, 16, 17, 18, 19]] = np.log1p(size), upper, digits, marks, symbols, pipes, shouts, periods, high, spaces
        if n:
            lengths = ends - starts
            last, first = raw[ends - 1], raw[starts]
            row[1:4] = np.log1p(n), lengths.mean(), (lengths > 16).mean()
            row[4], row[5] = len(np.unique(words)) / n, (words[1:] == words[:-1]).mean() if n > 1 else 0
            if n > 2:
                pairs = words[1:] * np.uint64(31) + words[:-1]
                row[6] = np.unique(pairs, return_counts=True)[1].max() / n
                row[7] = _repeats(pairs[1:] * np.uint64(31) + words[:-2])
            row[20] = (_KIND[last, 3] | _KIND[last, 5]).mean()
            row[21] = (_KIND[first, 0] & _KIND[raw[np.maximum(starts, ends - 2)], 0]).mean()
        cut = np.flatnonzero(raw == newline)
        bounds = np.concatenate(([0], cut + 1, [size + 1]))
        row[8], row[9] = np.log1p(len(cut)), np.log1p(size / (len(cut) + 1))
        if len(cut) and n:
            # A line's hash: the sum of its word hashes by place.
            line = np.searchsorted(bounds, starts, "right") - 1
            keys = np.zeros(len(bounds), np.uint64)
            np.add.at(keys, line, words * (np.arange(n, dtype=np.uint64) - np.searchsorted(line, line).astype(np.uint64) + np.uint64(1)))
            row[10] = _repeats(keys[np.unique(line)])
    return out


class Trees:
    """Boosted trees as arrays: for tree t and node i, feature[t, i] (-1: leaf), threshold[t, i] and value[t, i]; the children of node
    i are 2i + 1 (feature <= threshold) and 2i + 2."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[node]
                down = 2 * node + 1 + (x[rows, np.maximum(f, 0)] > threshold[node])
                node = np.where(f < 0, node, down)
            total += value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic loss, second-order gains, depth DEPTH."""
    n, width = x.shape
    nodes = 2 ** (DEPTH + 1) - 1
    rate = (y.sum() + 1) / (n + 2)
    base = float(np.log(rate / (1 - rate)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) if n else np.zeros(0) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1) if n else np.zeros((0, width), np.int64)
    trees = TREES if n and 0 < y.sum() < n else 0
    feature, threshold, value = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    raw = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for depth in range(DEPTH + 1):
            lo, count = 2**depth - 1, 2**depth
            active = node >= lo
            local = node[active] - lo
            sums = [np.bincount(local, w, count) for w in (g[active], h[active], np.ones(active.sum()))]
            value[t, lo : lo + count] = -RATE * sums[0] / (sums[1] + SMOOTH)
            if depth == DEPTH:
                break
            best, pick, at = np.full(count, 1e-6), np.full(count, -1), np.zeros(count, np.int64)
            for j in range(width):
                key = local * BINS + binned[active, j]
                gs, hs, ns = (np.bincount(key, w, count * BINS).reshape(count, BINS).cumsum(1) for w in (g[active], h[active], np.ones(active.sum())))
                gain = gs**2 / (hs + SMOOTH) + (sums[0][:, None] - gs) ** 2 / (sums[1][:, None] - hs + SMOOTH) - (sums[0] ** 2 / (sums[1] + SMOOTH))[:, None]
                gain[(ns < LEAST) | (sums[2][:, None] - ns < LEAST)] = -1
                gain = gain[:, : len(cuts[j])]
                if gain.shape[1]:
                    k = gain.argmax(1)
                    better = gain[np.arange(count), k] > best
                    best, pick, at = np.where(better, gain[np.arange(count), k], best), np.where(better, j, pick), np.where(better, k, at)
            for i in np.flatnonzero(pick >= 0):
                feature[t, lo + i], threshold[t, lo + i] = pick[i], cuts[pick[i]][at[i]]
            f = feature[t, node]
            split = active & (f >= 0)
            node[split] = 2 * node[split] + 1 + (x[split, f[split]] > threshold[t, node[split]])
        raw += value[t, node]
    return Trees(base, feature, threshold, value)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """labels: a table of ids and labels to learn from. The labelled texts' features, TRAIN_ROWS rows at most, reach the driver."""
    marked = labels.select(F.col(id_col).alias("doc"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and doc is not null").groupBy("doc").agg(F.max("y").alias("y"))
    n = marked.count()
    mark = F.pmod(F.xxhash64("doc", F.lit("quality sample")), F.lit(2**30))
    if n > TRAIN_ROWS:
        marked = marked.where(mark < int(2**30 * 0.97 * TRAIN_ROWS / n))
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).join(bounded(marked), "doc").select("doc", "y", "text")

    def run(batches):
        for batch in batches:
            x = features(batch.column(2))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], names=["doc", "y", "x"])

    found = sorted((r["doc"], r["y"], r["x"]) for r in rows.mapInArrow(run, "doc long, y int, x array<double>").limit(TRAIN_ROWS).collect())
    x = np.array([r[2] for r in found]).reshape(len(found), len(FEATURES))
    return fit(x, np.array([r[1] for r in found], np.float64))


def scores(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None, threshold: float = 0.3) -> DataFrame:
    """A row for each document: id, the columns of carry, score and predicted (1 if score >= threshold)."""
    picked = docs.select(F.col(id_col), *(c.alias(k) for k, c in (carry or {}).items()), F.col(text_col).cast("string").alias("_text"))
    names = [*picked.columns[:-1], "score", "predicted"]

    def run(batches):
        for batch in batches:
            score = trees.score(features(batch.column(len(names) - 2)))
            rest = [batch.column(i) for i in range(len(names) - 2)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema[:-1])
    return picked.mapInArrow(run, f"{kinds}, score double, predicted int")
