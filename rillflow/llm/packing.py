"""Harmonic packing of token sequences.

A document is cut into full sequences and a tail. Tails fall into reciprocal-capacity classes: class k holds pieces of
just below capacity / k, and each of its bins takes exactly k of them. A tail that would leave more than ``slack`` of a
bin empty is cut at the next reciprocal first. Pieces below the last class are laid end to end, as are the pieces of
the bins that are still open when a worker's partition ends. No worker needs to know of another.
"""

from __future__ import annotations

import contextlib
import json
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .shared import lean

CAPACITY, CLASSES, SLACK = 1024, 48, 0.01
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, class int"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


#: Fixed value: how byte-level BPE splits a text before it merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


def _fast(spec: dict):
    """The same tokenizer as ranked merges (several times faster), or None where its file asks for more than that."""
    import tiktoken

    model, split, added = spec["model"], spec["pre_tokenizer"] or {}, spec["added_tokens"]
    vocab, bytes_of = model["vocab"], _characters()
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    asks = [spec["normalizer"], model["dropout"], model["unk_token"], model["continuing_subword_prefix"], model["end_of_word_suffix"], model["byte_fallback"], model["ignore_merges"], split.get("add_prefix_space")]
    asks += [t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")]
    ranked = all(vocab[a + b] == 256 + i for i, (a, b) in enumerate(pairs))
    if any(asks) or not ranked or model["type"] != "BPE" or split.get("type") != "ByteLevel" or not split.get("use_regex"):
        return None
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(bytes_of[c] for c in token): i for token, i in vocab.items() if token not in special}
    bpe = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: bpe.encode(text, allowed_special="all", disallowed_special=())


@lru_cache(1)
def encoder(tokenizer_file: str) -> Callable[[str], list[int]]:
    """The ids that the tokenizer of a file gives with ``add_special_tokens=False``.

    An added token's string in a text is that token, as is the tokenizer's default. Texts on which the fast form's
    regular expressions give up (hundreds of thousands of blanks in a row) go to the tokenizer itself.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        fast = _fast(json.load(f))

    @cache
    def whole():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(tokenizer_file)

    def encode(text: str) -> list[int]:
        if fast:
            with contextlib.suppress(ValueError):
                return fast(text)
        return whole().encode(text, add_special_tokens=False).ids

    return encode


class Harmonic:
    """The packer of one worker. ``add`` and ``finish`` return finished rows (tuples in the order of NAMES)."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, classes: int = CLASSES, slack: float = SLACK):
        self.next_id, self.capacity, self.classes, self.slack = first_id, capacity, classes, slack
        self.open: dict[int, list] = defaultdict(list)
        self.small: list = []
        self.small_size = 0

    def _close(self, pieces: list, kind: int) -> list[tuple]:
        out, at = [], 0
        for doc_id, start, ids, total in pieces:
            out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, at, kind))
            at += len(ids)
        self.next_id += 1
        return out

    def _lay(self, piece: tuple) -> list[tuple]:
        """Next-fit with a cut where a sequence is full."""
        out, (doc_id, start, ids, total) = [], piece
        while len(ids):
            room = self.capacity - self.small_size
            self.small.append((doc_id, start, ids[:room], total))
            self.small_size += len(ids[:room])
            start, ids = start + len(ids[:room]), ids[room:]
            if self.small_size == self.capacity:
                out += self._close(self.small, 0)
                self.small, self.small_size = [], 0
        return out

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        out, total, start, cap = [], len(ids), 0, self.capacity
        while start < total:
            left = min(cap, total - start)
            k = cap // left
            if k > self.classes:
                out += self._lay((doc_id, start, ids[start : start + left], total))
            else:
                if cap - k * left > self.slack * cap and k < self.classes:
                    k += 1
                    left = min(left, cap // k)
                bin_ = self.open[k]
                bin_.append((doc_id, start, ids[start : start + left], total))
                if len(bin_) == k:
                    out += self._close(bin_, k)
                    self.open[k] = []
            start += left
        return out

    def finish(self) -> list[tuple]:
        """Lay the pieces of open bins end to end; the rest ends in sequences of powers of two."""
        out = []
        for k in sorted(self.open):
            for piece in self.open[k]:
                out += self._lay(piece)
        self.open.clear()
        rest, self.small, size = self.small, [], self.small_size
        self.small_size = 0
        while size:
            power, take, taken = 1 << (size.bit_length() - 1), [], 0
            while taken < power:
                doc_id, start, ids, total = rest.pop(0)
                use = min(len(ids), power - taken)
                take.append((doc_id, start, ids[:use], total))
                if use < len(ids):
                    rest.insert(0, (doc_id, start + use, ids[use:], total))
                taken += use
            out += self._close(take, 0)
            size -= power
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in NAMES]
    return pa.record_batch([pa.array(c, pa.int32() if n == "class" else pa.int64()) for c, n in zip(cols, NAMES, strict=True)], NAMES)


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, classes: int = CLASSES, slack: float = SLACK, end_id: int = 0) -> DataFrame:
    """Pieces of every document of ``docs`` (doc_id, text), ``end_id`` ending each, in sequences of ``capacity``. Ids are those
    of ``encoder``.

    Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, class (0: laid end to end). A null or
    empty text is the one token ``end_id``. Repeated rows and null ids are packed like any other; other columns are left
    aside; an empty table gives no rows. A partition's pieces depend on that partition alone, so a lost task is redone
    with the same result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, rows = None, Harmonic(TaskContext.get().partitionId() << 40, capacity, classes, slack), []
        for batch in batches:
            encode = encode or encoder(tokenizer_file)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                rows += packer.add(doc_id, np.array([*ids, end_id], "<u4"))
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows = []
        yield _batch(rows + packer.finish())

    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(lean(run), SCHEMA)
