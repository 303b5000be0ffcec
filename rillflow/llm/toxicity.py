"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fitting import fit_in_one_task, held_out, labelled_sample, scored
from .shared import lean
from .wordhash import Text, chunks, mix

BITS = 20
FOLDS, FOLD, THRESHOLD = 4, 2, 0.3
SAMPLE_ROWS = 8192
#: Texts are worked on in runs of about so many bytes, which bounds a worker's memory.
CHUNK_BYTES = 1 << 18


STEMS = (4, 5, 6, 7, 8)
#: Lower-cases A-Z and turns every byte that is neither a letter, a digit nor part of a longer character into a space.
FOLD_BYTES = np.full(256, 32, np.uint8)
for _b in (*range(48, 58), *range(97, 123), *range(128, 256)):
    FOLD_BYTES[_b] = _b
FOLD_BYTES[65:91] = np.arange(97, 123)


def feature_hashes(raw: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of each word, its stems (its first few bytes, so that inflected forms meet), each pair of
    neighbours and each pair with one word between (skip-gram)."""
    text = Text(FOLD_BYTES[raw], offsets)
    starts, ends, doc = text.words()
    h = text.word_hashes()
    docs, slots = [doc], [h]
    for length in STEMS:
        at = np.flatnonzero(ends - starts > length)
        docs.append(doc[at])
        slots.append(mix(text.hashes(starts[at], starts[at] + length) + np.uint64(0x9FB21C651E98DF25)))
    for gap, salt in ((1, 0x8CB92BA72F3D8DD7), (2, 0xC2B2AE3D27D4EB4F)):
        same = np.flatnonzero(doc[:-gap] == doc[gap:]) if len(doc) > gap else np.zeros(0, np.int64)
        docs.append(doc[same])
        slots.append(mix(h[same] * np.uint64(salt) + h[same + gap]))
    return np.concatenate(docs), (np.concatenate(slots) >> np.uint64(64 - bits)).astype(np.uint32)


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0, epochs: int = 6) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots with a weight, weights, bias) of per-coordinate FTRL-proximal with binary features; the bias isn't penalised."""
    size = 1 << bits
    z, n, w = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for _ in range(epochs):
        for slots, y in zip(rows, labels, strict=True):
            at = np.append(slots, size)
            zi, ni = z[at], n[at]
            shrunk = np.sign(zi) * np.maximum(np.abs(zi) - l1, 0)
            shrunk[-1] = zi[-1]
            wi = -shrunk / ((beta + np.sqrt(ni)) / alpha + l2)
            g = 1 / (1 + np.exp(-np.clip(wi.sum(), -35, 35))) - y
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] = zi + g - sigma * wi
            n[at] = ni + g * g
    shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
    shrunk[-1] = z[-1]
    w = -shrunk / ((beta + np.sqrt(n)) / alpha + l2)
    used = np.flatnonzero(w[:-1]).astype(np.uint32)
    return used, w[used].astype(np.float32), float(w[-1])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, raw, offsets in chunks(batch.column(1), CHUNK_BYTES):
            doc, slot = feature_hashes(raw, offsets)
            both = np.unique((doc.astype(np.uint64) << np.uint64(32)) | slot)
            cut = np.searchsorted(both >> np.uint64(32), np.arange(hi - lo + 1))
            slot = (both & np.uint64(0xFFFFFFFF)).astype("<u4")
            rows = [slot[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(rows, pa.binary())], ["doc_id", "label", "slots"])


def _fit(table: pa.Table | None) -> list[pa.Array]:
    if table is None or not table.num_rows:
        return [pa.array([b""], pa.binary()), pa.array([b""], pa.binary()), pa.array([-35.0])]
    ids, labels = table["doc_id"].to_numpy().astype(np.int64), table["label"].to_numpy().astype(float)
    order = np.lexsort((ids, mix(ids.astype(np.uint64))))  # an order that no partitioning changes
    slots = [np.frombuffer(row.as_buffer(), "<u4") for row in table["slots"]]
    used, w, bias = fit_ftrl([slots[i] for i in order], labels[order])
    return [pa.array([used.astype("<u4").tobytes()], pa.binary()), pa.array([w.astype("<f4").tobytes()], pa.binary()), pa.array([bias])]


def train_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Weights (slots, weights, bias) from at most ``sample_rows`` labelled documents outside the held-out fold."""
    sample = labelled_sample(docs, labels, "toxic", FOLDS, FOLD, sample_rows)
    features = sample.select("doc_id", "text", "label").mapInArrow(lean(_features), "doc_id long, label int, slots binary")
    return fit_in_one_task(features, _fit, "slots binary, weights binary, bias double", ["slots", "weights", "bias"])


def score_toxicity(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (double) and predicted (int, 1 from ``threshold`` on) added, every text scored whole.

    A null or empty text gets the score of the bias alone; with no labelled rows at all every score is near 0.
    Columns named score or predicted are replaced; all others, repeated rows and null ids stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model["slots"], model["weights"], model["bias"]))

    def score(texts: pa.Array) -> np.ndarray:
        table, bias = _weights(shared)
        out = [np.zeros(0)]
        for lo, hi, raw, offsets in chunks(texts, CHUNK_BYTES):
            doc, slot = feature_hashes(raw, offsets)
            hit = np.flatnonzero(table[slot])
            both = np.unique((doc[hit].astype(np.uint64) << np.uint64(32)) | slot[hit])
            total = np.bincount((both >> np.uint64(32)).astype(np.int64), weights=table[both & np.uint64(0xFFFFFFFF)], minlength=hi - lo)
            out.append(1 / (1 + np.exp(-np.clip(total + bias, -35, 35))))
        return np.concatenate(out)

    return scored(docs, score, threshold)


_held: dict = {}


def _weights(shared) -> tuple[np.ndarray, float]:
    """A broadcast model's weights by slot; the last one's stay with the worker."""
    if _held.get("model") is not shared.value:
        used, weights, bias = shared.value
        table = np.zeros(1 << BITS, np.float32)
        table[np.frombuffer(used, "<u4")] = np.frombuffer(weights, "<f4")
        _held.update(model=shared.value, table=table, bias=bias)
    return _held["table"], _held["bias"]


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    out = score_toxicity(docs.select("doc_id", "text"), train_toxicity(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", "predicted")
