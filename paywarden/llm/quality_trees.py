"""Quality scores from histogram gradient-boosted trees over document statistics.

Statistics come from whole texts, as arrays over the Arrow text buffer. Training sees
a bounded sample of labelled rows; trees are kept as flat arrays (heap order) and are
walked for all rows and trees of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.llm.common import blank, text_chunks

# Byte classes: 0 other control, then as named below.
CLASSES = ("control", "lower", "upper", "digit", "blank", "line", "stop", "comma", "bang", "bar", "bracket", "quote", "symbol", "lead", "tail")
_LUT = np.zeros(256, np.uint8)
for _k, _chars in ((1, range(97, 123)), (2, range(65, 91)), (3, range(48, 58)), (4, b" \t\r\v\f"), (5, b"\n"), (6, b"."), (7, b",;:"), (8, b"!?"), (9, b"|"), (10, b"()[]{}<>"), (11, b"'\"`"), (12, b"#$%&*+-/=@\\^_~"), (13, range(192, 256)), (14, range(128, 192))):
    _LUT[list(_chars)] = _k

STATISTICS = (
    *(f"share_{c}" for c in CLASSES),
    "log_chars", "log_words", "word_length", "distinct_words", "words_per_line", "distinct_lines",
    "capital_starts", "symbol_ends", "bang_ends", "stop_ends", "two_symbols", "long_words", "line_without_stop",
)


def statistics(texts: list[str]) -> np.ndarray:
    """One row of STATISTICS per text; shares are of the code points, an empty text is all zero."""
    n, k = len(texts), len(CLASSES)
    raw = [t.encode() for t in texts]
    size = np.fromiter(map(len, raw), np.int64, n)
    kind = _LUT[np.frombuffer(b"".join(raw) + b"\n", np.uint8)]
    doc = np.repeat(np.arange(n), size)
    counts = np.bincount(doc * k + kind[:-1], minlength=n * k).reshape(n, k).astype(float)
    inside = (kind != 4) & (kind != 5)
    last = np.zeros(len(doc), bool)
    first = np.zeros(len(doc), bool)
    ends = np.cumsum(size)
    last[ends[size > 0] - 1] = True
    first[(ends - size)[size > 0]] = True
    word_end = inside[:-1] & (~inside[1:] | last)
    word_start = inside[:-1] & (np.concatenate([[True], ~inside[:-2]]) if len(doc) else True) | inside[:-1] & first
    of = lambda mask: np.bincount(doc[mask], minlength=n)
    words = np.maximum(of(word_end), 1)
    now, then = kind[:-1], kind[1:]
    symbol = (kind == 12) | (kind == 8)
    parts = [t.split() for t in texts]
    lines = [t.split("\n") for t in texts]
    n_lines = np.fromiter(map(len, lines), np.int64, n)
    chars = counts.sum(axis=1) - counts[:, 14]
    at = np.maximum(chars, 1)
    return np.column_stack([
        counts / at[:, None], np.log1p(chars), np.log1p(of(word_end)), (at - counts[:, 4] - counts[:, 5]) / words,
        [len(set(p)) / (len(p) or 1) for p in parts], words / n_lines, [len(set(x)) / len(x) for x in lines],
        of(word_start & (now == 2)) / words, of(word_end & (now == 12)) / words, of(word_end & (now == 8)) / words,
        of(word_end & (now == 6)) / words, of(symbol[:-1] & symbol[1:] & (now == then) & ~last) / words,
        [sum(len(w) > 20 for w in p) / (len(p) or 1) for p in parts],
        of((then == 5) & (now != 6) & inside[:-1] & ~last) / n_lines,
    ]) * (size > 0)[:, None]


@dataclass(frozen=True)
class Trees:
    """Perfect trees of one depth in heap order: split feature and threshold per inner node, value per leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        rows = np.arange(len(x))[:, None]
        tree = np.arange(trees)[None, :]
        at = np.zeros((len(x), trees), np.int64)
        for _ in range(int(np.log2(inner + 1))):
            at = 2 * at + 1 + (x[rows, self.feature[tree, at]] > self.threshold[tree, at])
        return 1 / (1 + np.exp(-(self.base + self.leaf[tree, at - inner].sum(axis=1))))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0) -> Trees:
    """Boost logistic loss with histograms of at most `bins` quantile bins a feature."""
    n, f = x.shape
    if n == 0:
        return Trees(0.0, np.zeros((1, 2**depth - 1), np.int64), np.full((1, 2**depth - 1), np.inf), np.zeros((1, 2**depth)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    code = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    flat = code + np.arange(f) * bins
    rate_of_one = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(rate_of_one / (1 - rate_of_one)))
    total = np.full(n, base)
    inner = 2**depth - 1
    feature, threshold, leaf = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, inner + 1))
    for t in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width = 2**level
            spot = (node[:, None] * (f * bins) + flat).ravel()
            sums = [np.bincount(spot, np.repeat(v, f), width * f * bins).reshape(width, f, bins) for v in (g, h)]
            left_g, left_h = (np.cumsum(s, axis=2) for s in sums)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
            for j, c in enumerate(cuts):
                gain[:, j, len(c) :] = -np.inf
            best = gain.reshape(width, -1).argmax(axis=1)
            worth = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            for k in np.flatnonzero(worth):
                j, b = divmod(int(best[k]), bins)
                feature[t, width - 1 + k], threshold[t, width - 1 + k] = j, cuts[j][b]
            at = width - 1 + node
            node = 2 * node + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        sum_g, sum_h = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
        leaf[t] = -rate * sum_g / (sum_h + ridge)
        total += leaf[t][node]
    return Trees(base, feature, threshold, leaf)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _in_chunks(batch: pa.RecordBatch, text: int, value) -> np.ndarray:
    texts = [t or "" for t in batch.column(text).to_pylist()]
    return np.concatenate([np.empty((0,)), *(value(texts[i:j]) for i, j in text_chunks(texts))])


def train_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Trees:
    """Fit on at most `max_rows` labelled documents, the smallest by a hash of doc_id.

    Rows that are held out, have no label or no document are not learned from; a
    document with several labels counts with each. Without any label every score is 0.5.
    """
    usable = labels.select("doc_id", "quality").where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    # At most max_rows rows of two numbers: small whatever the size of the tables.
    rows = docs.select("doc_id", blank("text").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "quality")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            for i, j in text_chunks(texts):
                x = pa.array(statistics(texts[i:j]).astype(np.float64).tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([x, b.column(1).slice(i, j - i)], ["x", "y"])

    got = rows.mapInArrow(measure, "x array<double>, y int").collect()
    x = np.array([r["x"] for r in got]).reshape(len(got), len(STATISTICS))
    y = np.array([r["y"] for r in got], float)
    # A fixed order of rows makes the sums, and so the trees, the same on every run.
    order = np.lexsort([y, *x.T])
    return fit_trees(x[order], y[order])


def score_quality(docs: DataFrame, trees: Trees, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _in_chunks(b, 1, lambda t: trees.score(statistics(t)))
            out = [b.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "score", "predicted"])

    return docs.selectExpr("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def keep_quality(docs: DataFrame, trees: Trees, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs` that score at least `threshold`, with all their columns and no shuffle."""
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_in_chunks(b, text, lambda t: trees.score(statistics(t))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train, then score all rows: doc_id, held_out, score, predicted."""
    scored = score_quality(docs, train_quality(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
