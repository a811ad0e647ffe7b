"""Quality classifier: histogram gradient-boosted trees over document statistics.

`document_stats` turns a text into a fixed vector of counts and ratios over the whole text. `fit` grows
depth-limited trees on quantile-binned features: every level sums gradients and Hessians into (node, feature, bin)
histograms and takes the best gain of all. `Forest` keeps all trees in flat arrays (feature, threshold, left, right,
value), where a leaf points to itself, so that scoring is `depth` rounds of vectorised gathers for all documents and
trees at once.

Training uses at most `max_train` labelled documents, those with the smallest hash of their id; scoring and the
statistics cover every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import slices

STATS = (
    "log_bytes", "log_words", "bytes_per_word", "chars_per_byte", "upper", "digit", "space", "newline", "mark",
    "shout", "pipe", "stop", "other", "distinct_words", "top_word", "twin_words", "distinct_lines", "log_line_words",
    "compressed", "capital_words", "marked_words", "longest_word", "bracket", "slash",
)
_LOWER = bytes(range(97, 123))
_SETS = {
    "upper": bytes(range(65, 91)), "digit": b"0123456789", "space": b" \t\r\n", "newline": b"\n", "mark": b"*$&%#@^~_=+",
    "shout": b"!?", "pipe": b"|", "stop": b".,;:", "bracket": b"()[]{}<>\"'", "slash": b"/\\",
}
_WORDLIKE = _LOWER + _SETS["upper"] + _SETS["digit"] + _SETS["space"] + bytes(range(128, 256))
_EDGE = re.compile(r"[^\w\s][^\w\s]")


def document_stats(text: str | None) -> list[float]:
    """The statistics named in STATS for one whole text; a null text counts as empty, of which every ratio is 0."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    size = len(raw)
    if not size:
        return [0.0] * len(STATS)
    share = {k: (size - len(raw.translate(None, v))) / size for k, v in _SETS.items()}
    other = len(raw.translate(None, _WORDLIKE)) / size - sum(share[k] for k in ("mark", "shout", "pipe", "stop", "bracket", "slash"))
    words = text.split()
    n = max(1, len(words))
    tally: dict[str, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    twins = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x]
    capitals = sum(map(str.isupper, words))
    return [
        float(np.log1p(size)), float(np.log1p(len(words))), size / n, len(text) / size, share["upper"], share["digit"],
        share["space"], share["newline"], share["mark"], share["shout"], share["pipe"], share["stop"], other,
        len(tally) / n, max(tally.values(), default=0) / n, twins / n, len(set(lines)) / max(1, len(lines)),
        float(np.log1p(len(words) / max(1, len(lines)))), len(zstandard.ZstdCompressor(level=1).compress(raw)) / size,
        capitals / n, len(_EDGE.findall(text)) / n, float(np.log1p(max(map(len, words), default=0))), share["bracket"],
        share["slash"],
    ]


@dataclass
class Forest:
    """Trees in flat arrays; node ids are global, `roots` has the first node of each tree, leaves point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if not len(self.roots) or not len(x):
            return total
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            down = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(down, self.left[node], self.right[node])
        return total + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -500, 500)))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 100, depth: int = 4, rate: float = 0.15, bins: int = 64,
    l2: float = 1.0, min_hessian: float = 2.0, min_gain: float = 1e-3,
) -> Forest:
    """Boosts `trees` trees of logistic loss. With no rows, or rows of one class, there are no trees: every document
    then scores the (smoothed) share of the positive class, and with no rows at all 1."""
    x, y = np.asarray(x, dtype=np.float64).reshape(-1, len(STATS) if not len(x) else np.shape(x)[1]), np.asarray(y, dtype=np.float64)
    n, f = x.shape
    if not n:
        return Forest(*(np.zeros(0, t) for t in (int, float, int, int, float)), np.zeros(0, int), depth, 30.0)
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    flat: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    margin = np.full(n, base)
    offsets = np.arange(f) * bins
    for _ in range(trees if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-12)
        start = len(flat["value"])
        roots.append(start)

        def add(g: float, h: float) -> int:
            me = len(flat["value"])
            for k, v in (("feature", 0), ("threshold", np.inf), ("left", me), ("right", me), ("value", -rate * g / (h + l2))):
                flat[k].append(v)
            return me

        level = {add(grad.sum(), hess.sum()): np.arange(n)}
        for _ in range(depth):
            below: dict[int, np.ndarray] = {}
            for node, rows in level.items():
                cell = (binned[rows] + offsets).ravel()
                gs = np.bincount(cell, np.repeat(grad[rows], f), f * bins).reshape(f, bins).cumsum(axis=1)
                hs = np.bincount(cell, np.repeat(hess[rows], f), f * bins).reshape(f, bins).cumsum(axis=1)
                g, h = gs[0, -1], hs[0, -1]
                gr, hr = g - gs, h - hs
                gain = gs**2 / (hs + l2) + gr**2 / (hr + l2) - g**2 / (h + l2)
                gain[(hs < min_hessian) | (hr < min_hessian)] = -np.inf
                best = int(gain.argmax())
                j, b = divmod(best, bins)
                if not gain[j, b] > min_gain or b >= len(edges[j]):
                    continue
                goes = binned[rows, j] <= b
                flat["feature"][node], flat["threshold"][node] = j, edges[j][b]
                for side, part, sg, sh in (("left", rows[goes], gs[j, b], hs[j, b]), ("right", rows[~goes], gr[j, b], hr[j, b])):
                    child = add(sg, sh)
                    flat[side][node] = child
                    below[child] = part
            for node, rows in level.items():
                if flat["left"][node] == node:
                    margin[rows] += flat["value"][node]
            level = below
        for node, rows in level.items():
            margin[rows] += flat["value"][node]
    return Forest(
        np.array(flat["feature"], int), np.array(flat["threshold"], float), np.array(flat["left"], int),
        np.array(flat["right"], int), np.array(flat["value"], float), np.array(roots, int), depth, base,
    )


def _stats_of(batch: pa.RecordBatch) -> np.ndarray:
    rows = [document_stats(t) for t in batch.column(1).to_pylist()]
    return np.array(rows, dtype=np.float64).reshape(-1, len(STATS))


def labelled_stats(docs: DataFrame, labels: DataFrame, max_train: int, seed: int) -> DataFrame:
    """(doc_id, y, stats) of at most max_train labelled documents that have a text, smallest hash of the id first.
    Several labels of a document are averaged and rounded half up; null labels and ids don't count."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality", F.xxhash64(F.lit(seed), "doc_id").alias("h"))
    rows = known.count()
    share = (max_train + 10 * max_train**0.5 + 10) / max(1, rows)
    if share < 1 and (low := known.where(F.col("h") < int((share - 0.5) * 2.0**64))).select("doc_id").distinct().count() >= max_train:
        known = low  # the same smallest hashes, without a sorted limit's max_train rows from every partition
    chosen = (
        known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"), F.first("h").alias("h"))
        .orderBy("h", "doc_id").limit(max_train).select("doc_id", "y")
    )
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("text").isNotNull())

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(list(_stats_of(batch)), pa.list_(pa.float64()))],
                names=["doc_id", "y", "stats"],
            )

    joined = texts.join(F.broadcast(chosen), "doc_id")  # at most max_train rows of 16 bytes
    return joined.select("doc_id", "text", "y").mapInArrow(stats, "doc_id bigint, y double, stats array<double>")


def train(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, seed: int = 17, **params) -> Forest:
    """Fits the forest on the driver; the rows sent there are bounded by max_train."""
    rows = labelled_stats(docs, labels, max_train, seed).toPandas().sort_values(["doc_id", "y"], kind="stable")
    x = np.array(rows["stats"].tolist(), dtype=np.float64).reshape(len(rows), len(STATS))
    return fit(x, rows["y"].to_numpy(dtype=np.float64), **params)


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, score) for every row of docs: the probability of good quality from the whole text.

    A null or empty text is scored by its all-zero statistics; a null doc_id is carried through; repeated rows are
    scored each; an empty table gives no rows. Only doc_id and text are read, so other columns don't matter."""
    model = docs.sparkSession.sparkContext.broadcast(forest)  # some thousand nodes, bounded by trees * 2 ** depth

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            p = model.value.probability(_stats_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(scored, "doc_id bigint, score double")


def keep_good(docs: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores at least `threshold`, with all their columns, whatever their names; no shuffle. A
    null or empty text scores by its all-zero statistics; null ids don't matter; repeated rows stay or go each; an empty
    table gives no rows."""
    model = docs.sparkSession.sparkContext.broadcast(forest)
    place = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, place):
            texts = batch.column(place).to_pylist()
            x = np.array([document_stats(t) for t in texts], dtype=np.float64).reshape(-1, len(STATS))
            yield batch.filter(pa.array(model.value.probability(x) >= threshold))

    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(kept, docs.schema)
