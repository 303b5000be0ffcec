"""SentencePiece encoding with Gumbel top-k sampling without replacement.

A unigram model over the model's pieces (Zipf weights by rank, since the file is a merge model) spans a lattice of
segmentations. Perturbed A* search takes segmentations off it in the order of their perturbed log-probabilities: the
root's Gumbel is drawn first, the best segmentation is drawn from the lattice's posterior and gets it; the rest of the
space splits by the first piece that differs, every part gets a Gumbel truncated at its parent's, and the part with the
largest is searched next. So each row gets distinct segmentations, exactly distributed as sampling without replacement,
with inclusion probabilities given the next perturbed value. Random numbers come from a counter keyed by the row's key.

No piece spans a word's end, so backward sums are computed once per distinct word, all words of a run at a time.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean
from .wordhash import _STEP, _high, _powers, _tables, mix

SAMPLES = 2
RUN_CHARS = 1 << 18
MARK = 0x2581
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """The pieces of a model file as a trie in flat arrays, their log-probabilities and their bytes."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ranks = {i: r for r, i in enumerate(sorted(normal, key=lambda i: -sp.get_score(i)))}
        weight = np.zeros(n)
        weight[normal] = [1 / (ranks[i] + 2) for i in normal]
        total = weight.sum() * 1.001  # the rest is for bytes
        self.logp = np.full(n, -np.inf)
        self.logp[normal] = np.log(weight[normal] / total)
        self.byte_logp = float(np.log(0.001 / 256))
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        raw = [b""] * n
        for i in normal:
            raw[i] = sp.id_to_piece(i).replace(chr(MARK), " ").encode()
        for b in range(256):
            raw[self.byte_id[b]] = bytes([b])
        self.piece_len = np.array([len(x) for x in raw], np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)[:-1]])
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        edges: dict[tuple[int, int], int] = {}
        terminal = [-1]
        for i in normal:
            node = 0
            for c in map(ord, sp.id_to_piece(i)):
                if (node, c) not in edges:
                    edges[node, c] = len(terminal)
                    terminal.append(-1)
                node = edges[node, c]
            terminal[node] = i
        self.terminal = np.array(terminal, np.int32)
        self.root = np.full(0x110000, -1, np.int64)
        for (parent, c), to in edges.items():
            if not parent:
                self.root[c] = to
        self.bits = max(10, (8 * len(edges) - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.next = np.zeros(1 << self.bits, np.int64)
        mask = (1 << self.bits) - 1
        keys = np.array([(node << 21) | c for node, c in edges], np.int64)
        for key, h, to in zip(keys, self._hash(keys), edges.values(), strict=True):
            at = int(h)
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at], self.next[at] = key, to

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        h = keys.view(np.uint64) * _GOLD
        h >>= np.uint64(64 - self.bits)
        return h.view(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The child of each node by a character, -1 if there is none."""
        key = (node << 21) | char
        at = self._hash(key)
        slot = self.slots[at]
        hit = slot == key
        out = np.where(hit, self.next[at], -1)
        todo = np.flatnonzero((slot >= 0) > hit)
        at = at[todo]
        while len(todo):
            at = (at + 1) & (len(self.slots) - 1)
            slot = self.slots[at]
            hit = slot == key[todo]
            out[todo[hit]] = self.next[at[hit]]
            more = (slot >= 0) > hit
            todo, at = todo[more], at[more]
        return out


@lru_cache(1)
def vocabulary(model_file: str) -> Vocabulary:
    return Vocabulary(model_file)


class Lattice:
    """The lattices of distinct words. Places lie by their distance from their word's end, the farthest first, and in one
    distance by words, the longest first: so sums run over slices. A word's lattice goes from ``first`` to ``last``; the
    places from ``inner`` on are ends. Edges leave places.

    cut[p] : cut[p + 1] are the edges of p; each has a target, a log-probability given p, and an id; a negative
    one stands for the row of ``by_bytes`` with the up to four ids of a character's bytes. ``upto`` sums probabilities
    in integers, so that it doesn't depend on the other words.
    """

    def __init__(self, voc: Vocabulary, chars: np.ndarray, lengths: np.ndarray):
        longest = int(lengths.max()) if len(lengths) else 0
        rank = np.empty(len(lengths), np.int64)
        rank[np.argsort(-lengths, kind="stable")] = np.arange(len(lengths))
        reach = np.cumsum(np.bincount(lengths, minlength=longest + 1)[::-1])  # words of at least each length, the longest first
        base = np.concatenate([[0], np.cumsum(reach)])[longest::-1]  # of each distance the first place
        n, self.inner = int(reach.sum()), int(base[0])
        self.first, self.last = base[lengths] + rank, base[0] + rank
        far = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(chars))
        word = np.repeat(rank, lengths)
        at = base[far] + word
        code, after = np.empty(self.inner, np.int64), np.empty(self.inner, np.int64)
        code[at], after[at] = chars, base[far - 1] + word
        source, target, piece, nth = [], [], [], []
        degree = np.zeros(n, np.int64)
        now = here = lost = np.arange(self.inner)
        while len(now):
            node = voc.step(node, code[here]) if source else voc.root[code]
            ok = np.flatnonzero(node >= 0)
            now, node, to = now[ok], node[ok], after[here[ok]]
            ends = voc.terminal[node]
            hit = np.flatnonzero(ends >= 0)
            src = now[hit]
            source.append(src)
            target.append(to[hit])
            piece.append(ends[hit])
            nth.append(degree[src])
            degree[src] += 1
            if len(source) == 1:
                lost = np.flatnonzero(degree[: self.inner] == 0)
                degree[lost] = 1  # characters that no piece stands for go by their bytes
            more = np.flatnonzero(to < self.inner)
            now, node, here = now[more], node[more], to[more]
        src = np.concatenate([*source, lost])
        n_piece = len(src) - len(lost)
        self.degree, self.cut = degree, np.concatenate([[0], np.cumsum(degree)])
        place = self.cut[src]
        place[:n_piece] += np.concatenate([*nth, lost[:0]])
        self.src, self.dst = np.repeat(np.arange(n, dtype=np.int32), degree), np.empty(len(src), np.int64)
        self.dst[place] = np.concatenate([*target, after[lost]])
        text = code[lost]
        size = 1 + (text > 0x7F) + (text > 0x7FF) + (text > 0xFFFF)
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size]
        self.ids, self.n_ids = np.empty(len(src), np.int32), np.ones(len(src), np.int8)
        self.ids[place] = np.concatenate([*piece, -1 - np.arange(len(lost), dtype=np.int32)])
        self.n_ids[place[n_piece:]] = size
        self.by_bytes = np.zeros((len(lost), 4), np.int64)
        for k in range(4):
            has = size > k
            byte = (text[has] >> (6 * (size[has] - 1 - k))) & 0x3F | 0x80
            if k == 0:
                byte = np.where(size == 1, text, lead | (text >> (6 * (size - 1))))
            self.by_bytes[has, k] = voc.byte_id[byte]
        self.logp = voc.logp[np.maximum(self.ids, 0)]
        self.logp[place[n_piece:]] = size * voc.byte_logp
        self.beta, self.upto = np.zeros(n), np.empty(len(src))
        for lo, hi in zip(base[1:].tolist(), base[:-1].tolist(), strict=True):
            x, y = self.cut[lo], self.cut[hi]
            head, width, v = self.cut[lo:hi] - x, degree[lo:hi], self.logp[x:y]
            v += self.beta[self.dst[x:y]]
            top = np.maximum.reduceat(v, head)
            self.beta[lo:hi] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, width)), head))
            v -= np.repeat(self.beta[lo:hi], width)
            np.minimum(v, 0.0, out=v)
            total = np.cumsum((np.exp(v) * 2.0**52).astype(np.int64))  # may wrap; differences don't mind
            before = total[head - 1]
            before[0] = 0
            np.multiply(total - np.repeat(before, width), 2.0**-52, out=self.upto[x:y])
        self.upto[self.cut[1 : self.inner + 1] - 1] = 1.0  # the last edge of a place takes what rounding leaves

    def draw(self, p: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each position p by its probability."""
        e = self.cut[p]
        todo = np.flatnonzero(self.upto[e] < u)
        while len(todo):
            e[todo] += 1
            todo = todo[self.upto[e[todo]] < u[todo]]
        return e


def uniform(key: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1), a function of both arguments alone."""
    u = (mix(key + counter.astype(np.uint64, copy=False) * _GOLD) >> np.uint64(11)).astype(np.float64)
    u += 0.5
    u *= 2.0**-53
    return u


def _walk(lattice: Lattice, p: np.ndarray, key: np.ndarray, counter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, edge) of free draws from each place p to the end of its word, in the order of rows and steps."""
    steps, count = [], np.zeros(len(p), np.int64)
    live = np.flatnonzero(p < lattice.inner)
    p, key, counter = p[live], key[live], counter[live]
    while len(live):
        e = lattice.draw(p, uniform(key, counter + np.uint64(len(steps))))
        steps.append((live, e))
        count[live] += 1
        p = lattice.dst[e]
        more = np.flatnonzero(p < lattice.inner)
        live, p, key, counter = live[more], p[more], key[more], counter[more]
    at = np.cumsum(count) - count
    edge = np.empty(int(count.sum()), np.int64)
    for t, (live, e) in enumerate(steps):
        edge[at[live] + t] = e
    return np.repeat(np.arange(len(count)), count), edge


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(characters, start, length, document) of the words of ``texts``, each with a space put before it."""
    joined = np.frombuffer("".join(" " + t if t else "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lengths = np.array([len(t) + 1 if t else 0 for t in texts])
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    joined = np.where(joined == 32, MARK, joined)
    n = len(joined)
    start = np.zeros(n + 1, bool)
    start[offsets] = True
    if n:
        space, line = joined == MARK, joined == 10
        start[1:n] |= (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    starts = np.flatnonzero(start[:n])
    return joined, starts, np.diff(np.append(starts, n)), np.searchsorted(offsets, starts, side="right") - 1


def _distinct(chars: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters and lengths of the distinct words, which of them each word is)."""
    value = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(mix(chars.astype(np.uint64) + np.uint64(7)) * _powers(len(chars)), out=value[1:])
    back = _tables()[1][start & (_STEP - 1)] * _high(True, len(chars) // _STEP + 1)[start >> 16]
    h = mix((value[start + length] - value[start]) * back + length.astype(np.uint64) * _GOLD)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    size = length[first]
    at = np.repeat(start[first] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
    return chars[at], size, which


class Segmentation:
    """One sampled segmentation of a document: its edges, log-probability, perturbed value and inclusion score."""

    def __init__(self, edges, logp, value):
        self.edges, self.logp, self.value, self.inclusion = edges, logp, value, 1.0


def _truncated(x: float, limit: float) -> float:
    """The Gumbel of location phi, at most ``limit``, of log(-log(u)) - phi."""
    return float(-np.logaddexp(-limit, x))


def sample_run(texts: list[str], keys: np.ndarray, voc: Vocabulary, samples: int) -> tuple[Lattice, list[list[Segmentation]]]:
    """For each text up to ``samples`` distinct segmentations, in the order of their perturbed values.

    All first segmentations of the run are drawn together; then each document's queue decides where its next one leaves
    an earlier one, and all of those are completed together, round by round.
    """
    chars, start, length, doc = _words(texts)
    distinct, sizes, which = _distinct(chars, start, length)
    lattice = Lattice(voc, distinct, sizes)
    base = mix(keys.astype(np.uint64))
    n = len(texts)
    word_cut = np.searchsorted(doc, np.arange(n + 1))
    in_doc = np.arange(len(doc)) - word_cut[doc]
    found: list[list[Segmentation]] = [[] for _ in range(n)]
    queues: list[list] = [[] for _ in range(n)]
    kappa = np.full(n, -np.inf)
    word_of: list[list[np.ndarray]] = [[] for _ in range(n)]
    # (document, edges before, word index of the first free word, position in it or -1, its value, the split's place, banned)
    none, roots = np.zeros(0, np.int64), (-np.log(-np.log(uniform(base, np.zeros(n))))).tolist()
    jobs = [(i, none, none, w, -1, root, -1, ()) for i, w, root in zip(range(n), word_cut[:n].tolist(), roots, strict=True)]
    for r in range(samples):
        # Complete the jobs of this round, all at once.
        lo = np.array([job[3] for job in jobs], np.int64)
        many = word_cut[np.array([job[0] for job in jobs], np.int64) + 1] - lo
        at = np.cumsum(many) - many
        owner = np.repeat(np.arange(len(jobs)), many)
        w = np.arange(len(owner)) + np.repeat(lo - at, many)
        p = lattice.first[which[w]]
        within = np.array([job[4] for job in jobs], np.int64)
        begun = np.flatnonzero((within >= 0) & (many > 0))
        p[at[begun]] = within[begun]
        salt = np.uint64(r + 1) << np.uint64(56)
        key = base[doc[w]] if len(w) else np.zeros(0, np.uint64)
        row, edge = _walk(lattice, p, key, salt + (in_doc[w].astype(np.uint64) << np.uint64(20)))
        cut = np.searchsorted(owner[row], np.arange(len(jobs) + 1))
        paths, path_words = [], []
        for j, job in enumerate(jobs):
            new, new_w = edge[cut[j] : cut[j + 1]], w[row[cut[j] : cut[j + 1]]]
            paths.append(np.concatenate([job[1], new]) if len(job[1]) else new)
            path_words.append(np.concatenate([job[2], new_w]) if len(job[2]) else new_w)
        # Split what is left of each part of the space by the first edge that differs.
        ends = np.concatenate([[0], np.cumsum([len(x) for x in paths])]).astype(np.int64)
        every = np.concatenate(paths) if paths else np.zeros(0, np.int64)
        job_of = np.repeat(np.arange(len(jobs)), np.diff(ends))
        within = np.arange(len(every)) - ends[job_of]
        logp = lattice.logp[every]
        before = np.concatenate([[0.0], np.cumsum(logp)])
        total = before[ends[1:]] - before[ends[:-1]]
        source = lattice.src[every]
        left = 1 - np.exp(logp)
        some = lattice.degree[source] > 1
        for j, job in enumerate(jobs):
            if (at := job[6]) >= 0:  # the part's own split: what was banned there stays so, and nothing before it differs
                k = ends[j] + at
                out = [*job[7], int(every[k])]
                left[k] = 1 - np.exp(lattice.logp[out]).sum()
                some[k] = lattice.degree[source[k]] > len(out)
                some[ends[j] : k] = False
        with np.errstate(divide="ignore"):
            phi = np.where(some, before[:-1] - before[ends[job_of]] + np.log(np.maximum(left, 1e-300)), -np.inf)
        own = np.array([base[job[0]] for job in jobs], np.uint64)[job_of] if len(jobs) else np.zeros(0, np.uint64)
        order = np.log(-np.log(uniform(own, (np.uint64(r + 128) << np.uint64(56)) + within.astype(np.uint64)))) - phi  # as its Gumbels, falling
        next_jobs, picks = [], uniform(base, np.full(n, (r + 64) << 48, np.uint64))
        for j, (i, _, _, _, _, value, place, banned) in enumerate(jobs):
            edges, x = paths[j], order[ends[j] : ends[j + 1]]
            found[i].append(Segmentation(edges, float(total[j]), value))
            word_of[i].append(path_words[j])
            need = samples - r
            top = range(len(x)) if len(x) <= need else [x.argmin()] if need == 1 else np.argpartition(x, need - 1)[:need]
            for t in top:
                if x[t] < np.inf:
                    at = int(t)
                    ban = (*(banned if at == place else ()), int(edges[at]))
                    heapq.heappush(queues[i], (-_truncated(x[t], value), len(found[i]) - 1, at, ban))
            if not queues[i]:
                continue
            if r == samples - 1:
                kappa[i] = -queues[i][0][0]
                continue
            neg, s, at, ban = heapq.heappop(queues[i])
            parent, parent_w = found[i][s].edges, word_of[i][s]
            src = int(lattice.src[parent[at]])
            options_e = np.array([e for e in range(lattice.cut[src], lattice.cut[src + 1]) if e not in ban])
            pr = np.exp(lattice.logp[options_e])
            pick = picks[i] * pr.sum()
            e = int(options_e[min(int(np.searchsorted(np.cumsum(pr), pick)), len(options_e) - 1)])
            ww, dst = int(parent_w[at]), int(lattice.dst[e])
            next_jobs.append((i, np.append(parent[:at], e), np.append(parent_w[:at], ww), ww, dst, -neg, at, ban))
        jobs = next_jobs
    for i in range(n):
        for s in found[i]:
            s.inclusion = float(-np.expm1(-np.exp(min(s.logp - kappa[i], 50.0)))) if kappa[i] > -np.inf else 1.0
    return lattice, found


def edge_ids(lattice: Lattice, edges: np.ndarray) -> np.ndarray:
    """The ids that the edges stand for."""
    first = lattice.ids[edges].astype(np.int64)
    lost = np.flatnonzero(first < 0)
    if not len(lost):
        return first
    n = lattice.n_ids[edges].astype(np.int64)
    out, at, size, row = np.repeat(first, n), np.cumsum(n)[lost] - n[lost], n[lost], -1 - first[lost]
    for k in range(4):
        has = size > k
        out[at[has] + k] = lattice.by_bytes[row[has], k]
    return out


def _digest(lattice: Lattice, found: list[Segmentation], voc: Vocabulary) -> tuple[list[np.ndarray], list[memoryview]]:
    """The ids of each segmentation, and the bytes that they decode to."""
    edges = np.concatenate([s.edges for s in found]) if found else np.zeros(0, np.int64)
    ids = edge_ids(lattice, edges)
    at = np.concatenate([[0], np.cumsum([len(s.edges) for s in found])]).astype(np.int64)
    cut = np.concatenate([[0], np.cumsum(lattice.n_ids[edges], dtype=np.int64)])[at]
    size = voc.piece_len[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    raw = voc.piece_bytes[np.repeat(voc.piece_at[ids] - ends[:-1], size) + np.arange(ends[-1])].data
    return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], [raw[ends[a] : ends[b]] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def decode(ids: np.ndarray, voc: Vocabulary) -> str:
    """The text of a sequence of ids, without the space put before it."""
    size = voc.piece_len[ids]
    at = np.repeat(voc.piece_at[ids] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum())) if len(ids) else np.zeros(0, np.int64)
    return voc.piece_bytes[at].tobytes().decode("utf-8", "replace")[1:]


def segment_samples(docs: DataFrame, model_file: str, samples: int = SAMPLES, seed: int = 0, with_ids: bool = True) -> DataFrame:
    """Up to ``samples`` rows per row of ``docs`` (doc_id, text): doc_id, sample (from 1), n_pieces, logp, perturbed,
    inclusion, ids_crc32 (little-endian unsigned 32-bit ids), round_trip (the ids decode to the text) and, if asked for,
    ids.

    A null or empty text has the one empty segmentation (inclusion 1); a text with fewer than ``samples``
    segmentations gets all of them. A null id counts as key 0 for the random numbers. Repeated rows get equal samples.
    U+2581 in a text decodes as a space, as the format has it. Other columns are left aside; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            voc = vocabulary(model_file)
            ids, texts = batch.column(0).to_pylist(), [t.as_py() or "" for t in batch.column(1)]
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= RUN_CHARS):
                    size, hi = size + len(texts[hi]), hi + 1
                keys = np.array([(i or 0) ^ seed for i in ids[lo:hi]], np.int64)
                lattice, found = sample_run(texts[lo:hi], keys, voc, samples)
                rows, flat = [], [s for own in found for s in own]
                seqs, decoded = _digest(lattice, flat, voc)
                at = 0
                for i, own, text in zip(ids[lo:hi], found, texts[lo:hi], strict=True):
                    whole = (" " + text.replace(chr(MARK), " ")).encode() if text else b""
                    for k, s in enumerate(own, 1):
                        seq = seqs[at]
                        rows.append((i, k, len(seq), s.logp, s.value, s.inclusion, zlib.crc32(seq.astype("<u4").tobytes()), decoded[at] == whole, *([seq] if with_ids else [])))
                        at += 1
                cols = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
                names = ["doc_id", "sample", "n_pieces", "logp", "perturbed", "inclusion", "ids_crc32", "round_trip", "ids"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types[: len(cols)], strict=True)], names[: len(cols)])
                lo = hi

    schema = "doc_id long, sample int, n_pieces long, logp double, perturbed double, inclusion double, ids_crc32 long, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), schema + (", ids array<long>" if with_ids else ""))
