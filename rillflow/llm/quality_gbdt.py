"""Quality scores: histogram gradient-boosted trees over document statistics.

Every tree is complete to a fixed depth and lies flat in three arrays (feature, threshold, value), so numpy walks all
documents of a batch down one level at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fitting import fit_in_one_task, held_out, labelled_sample, scored
from .shared import lean
from .textstats import STATISTICS, statistics
from .wordhash import Text, chunks

FOLDS, FOLD, THRESHOLD = 3, 1, 0.5
SAMPLE_ROWS = 16384
#: Texts are worked on in runs of about so many bytes, which bounds a worker's memory.
CHUNK_BYTES = 1 << 19
DEPTH, TREES, BINS = 4, 60, 64


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = 0.15, l2: float = 1.0, min_hess: float = 1.0) -> dict[str, np.ndarray]:
    """Flat arrays: feature (trees, inner nodes; -1 sends all left), threshold (same), value (trees, leaves), base."""
    n, k = x.shape
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature, threshold, value = np.full((trees, inner), -1, np.int32), np.zeros((trees, inner), np.float32), np.zeros((trees, leaves))
    rate_of = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(rate_of / (1 - rate_of)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) for j in range(k)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(k)], axis=1)  # bin b: x <= edges[b]
    raw = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-12)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width = 1 << level
            best_gain, best_j, best_b = np.full(width, 1e-6), np.full(width, -1), np.zeros(width, np.int64)
            g_all, h_all = np.bincount(node, grad, width), np.bincount(node, hess, width)
            parent = g_all**2 / (h_all + l2)
            for j in range(k):
                if not len(edges[j]):
                    continue
                slot = node * bins + binned[:, j]
                g = np.bincount(slot, grad, width * bins).reshape(width, bins).cumsum(axis=1)[:, :-1]
                h = np.bincount(slot, hess, width * bins).reshape(width, bins).cumsum(axis=1)[:, :-1]
                g2, h2 = g_all[:, None] - g, h_all[:, None] - h
                gain = g**2 / (h + l2) + g2**2 / (h2 + l2) - parent[:, None]
                gain[(h < min_hess) | (h2 < min_hess)] = 0
                gain[:, len(edges[j]) :] = 0
                b = gain.argmax(axis=1)
                top = gain[np.arange(width), b]
                better = top > best_gain
                best_gain[better], best_j[better], best_b[better] = top[better], j, b[better]
            at = width - 1 + np.arange(width)
            feature[t, at] = best_j
            threshold[t, at] = [edges[j][b] if j >= 0 else 0 for j, b in zip(best_j, best_b, strict=True)]
            j_of, b_of = best_j[node], best_b[node]
            right = (j_of >= 0) & (binned[np.arange(n), np.maximum(j_of, 0)] > b_of)
            node = 2 * node + right
        g, h = np.bincount(node, grad, leaves), np.bincount(node, hess, leaves)
        value[t] = -rate * g / (h + l2)
        raw += value[t][node]
    return {"feature": feature, "threshold": threshold, "value": value, "base": np.array([base])}


def predict(x: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    """Probabilities for the rows of ``x``."""
    raw = np.full(len(x), float(model["base"][0]))
    rows = np.arange(len(x))
    trees, inner = model["feature"].shape
    depth = int(inner + 1).bit_length() - 1
    for t in range(trees):
        feature, threshold = model["feature"][t], model["threshold"][t]
        node = np.zeros(len(x), np.int64)
        for _ in range(depth):
            j = feature[node]
            node = 2 * node + 1 + ((j >= 0) & (x[rows, np.maximum(j, 0)] > threshold[node]))
        raw += model["value"][t][node - inner]
    return 1 / (1 + np.exp(-np.clip(raw, -35, 35)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, raw, offsets in chunks(batch.column(1), CHUNK_BYTES):
            x = statistics(Text(raw, offsets))
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])


def _fit(table: pa.Table | None) -> list[pa.Array]:
    rows = sorted(zip(table["doc_id"].to_pylist(), table["label"].to_pylist(), table["x"].to_pylist(), strict=True)) if table is not None else []
    x = np.array([np.frombuffer(r[2], np.float32) for r in rows]).reshape(-1, len(STATISTICS))
    y = np.array([r[1] for r in rows], float)
    model = fit_trees(x, y) if len(rows) else fit_trees(np.zeros((2, len(STATISTICS)), np.float32), np.array([0.0, 1.0]), trees=1)
    return [pa.array([model[k].astype(t).tobytes()], pa.binary()) for k, t in (("feature", "<i4"), ("threshold", "<f4"), ("value", "<f8"), ("base", "<f8"))]


def train_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict[str, np.ndarray]:
    """Trees from at most ``sample_rows`` labelled documents outside the held-out fold; without any, all score 0.5."""
    sample = labelled_sample(docs, labels, "quality", FOLDS, FOLD, sample_rows)
    features = sample.select("doc_id", "text", "label").mapInArrow(lean(_features), "doc_id long, label int, x binary")
    names = ["feature", "threshold", "value", "base"]
    row = fit_in_one_task(features, _fit, ", ".join(f"{k} binary" for k in names), names)
    inner = (1 << DEPTH) - 1
    return {
        "feature": np.frombuffer(row["feature"], "<i4").reshape(-1, inner), "threshold": np.frombuffer(row["threshold"], "<f4").reshape(-1, inner),
        "value": np.frombuffer(row["value"], "<f8").reshape(-1, inner + 1), "base": np.frombuffer(row["base"], "<f8"),
    }


def score_quality(docs: DataFrame, model: dict[str, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (double) and predicted (int, 1 from ``threshold`` on) added, every text scored whole.

    A null or empty text is scored by its statistics, which are all 0. Columns named score or predicted are replaced;
    all others, repeated rows and null ids stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: pa.Array) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(predict(statistics(Text(raw, offsets)), shared.value) for _, _, raw, offsets in chunks(texts, CHUNK_BYTES))])

    return scored(docs, score, threshold)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    out = score_quality(docs.select("doc_id", "text"), train_quality(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", "predicted")
