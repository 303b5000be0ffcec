"""Exact Jaccard self-join on word n-grams, by vertical partitioning.

The global order of n-grams is that of their 64-bit hashes; cuts at equal ranges divide it into fragments, and with it
every document's set into segments. The steps:

1. Each fragment finds, on its own, which of its n-grams two documents or more share; partial counts are summed per
   document. A document of which less than the threshold is shared cannot link to any other and is done.
2. Of the rest, documents with equal sets form classes, and one of each class goes on.
3. Prefixes: with the rarest n-grams first, two sets that link share one of the first n - ceil(t n) + 1. Documents are
   gathered into groups connected by shared prefix n-grams.
4. Tiles of bounded size compare parity bitmaps of the sets, which bound the difference from below, and propose a
   spanning forest of pairs. A pair is proposed only if it would connect two components. A small group is one tile. In a
   large one, a few pivots of each size band are first compared with all others, as often as this shrinks what lies
   outside the group's largest component; then only tiles with a document outside it are left to compare.
5. Vertical counting: each fragment counts the overlap of the proposed pairs' segments separately; the sum per pair
   decides exactly. Links merge components, failed pairs are barred, and 4. goes on until nothing is left to propose.

So no link that matters for a component is lost. A group of n near copies costs about n verified pairs and n times the
number of pivots in comparisons; only documents that link to none of the others still meet all of their group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import components, local_components
from .shared import drop_table, lean, shuffle_partitions, write_table
from .wordhash import Text, chunks, mix, sort_by_doc, window_hashes

BLOCK_BYTES = 2 << 20
TILE_ROWS = 256
#: So many documents of a size band, in expectation, are compared with all of a large group at a time.
PIVOTS = 32
CUTS = 8
#: A group, or a document in pairs, is heavy beyond this share of all rows: there are fewer heavy ones than its inverse,
#: which bounds what is broadcast.
HEAVY = 1 / 1000
#: The ids of classes that have to share their smallest doc_id with another start here.
FRESH = 1 << 62


def shingles(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct n-grams, sorted; a document of fewer than k words has its whole sequence."""
    text = Text(raw, offsets, lower=True)
    _, _, doc = text.words()
    h = text.word_hashes()
    grams, at = window_hashes(h, doc, k)
    grams, owner = [grams], [doc[at]]
    n_words = np.bincount(doc, minlength=text.n_docs)
    for short in range(1, k):
        few = n_words == short
        if few.any():
            g, at = window_hashes(h, doc, short)
            ok = few[doc[at]]
            grams.append(mix(g[ok] + np.uint64(short)))
            owner.append(doc[at][ok])
    h, doc = np.concatenate(grams), np.concatenate(owner)
    order = sort_by_doc(doc, h)
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


SEGMENT = "key int, block long, n_docs int, shared binary, owners binary, hashes binary, ids binary, sizes binary, local binary, digests binary"
SEGMENT_NAMES = [c.split()[0] for c in SEGMENT.split(", ")]
SEGMENT_SCHEMA = pa.schema([("key", pa.int32()), ("block", pa.int64()), ("n_docs", pa.int32())] + [(n, pa.binary()) for n in SEGMENT_NAMES[3:]])


def _segments(batches: Iterator[pa.RecordBatch], k: int, bits: int) -> Iterator[pa.RecordBatch]:
    """For each block of documents a row per fragment, and one (kind: ids set) about the documents.

    An n-gram that several documents of the block share is sent once, without owner ("shared"), and counted here for
    each of them ("local"); so a frequent n-gram costs a fragment one entry a block.
    """
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        for lo, hi, raw, offsets in chunks(batch.column(1), BLOCK_BYTES):
            doc, h = shingles(raw, offsets, k)
            n_docs = hi - lo
            sizes = np.bincount(doc, minlength=n_docs)
            cut = np.concatenate([[0], np.cumsum(sizes)])
            digests = b"".join(_digests(h, cut))
            key = h >> np.uint64(32 - bits)
            order = np.argsort(key)
            same = np.zeros(len(key), bool)
            same[1:] = key[order][1:] == key[order][:-1]
            in_run = same.copy()
            in_run[:-1] |= same[1:]
            many = np.zeros(len(key), bool)
            many[order[in_run]] = True
            shared = key[order[in_run & ~same]]
            own_key, own_doc = key[~many], doc[~many]
            fragment = (own_key >> np.uint64(32)).astype(np.uint32 if bits > 16 else np.uint16)
            by = np.argsort(fragment, kind="stable")
            low, owner = own_key[by].astype(np.uint32), own_doc[by]
            edges = np.arange((1 << bits) + 1)
            a, b = np.searchsorted(fragment[by], edges), np.searchsorted(shared >> np.uint64(32), edges.astype(np.uint64))
            shared = shared.astype(np.uint32)
            rows = {n: [] for n in SEGMENT_NAMES}
            for f in range(1 << bits):
                if a[f] == a[f + 1] and b[f] == b[f + 1]:
                    continue
                o = owner[a[f] : a[f + 1]]
                values = (f, block, n_docs, shared[b[f] : b[f + 1]].tobytes(), np.diff(o, prepend=0).astype(np.uint16 if n_docs < 65536 else np.uint32).tobytes(), low[a[f] : a[f + 1]].tobytes(), None, None, None, None)
                for n, v in zip(SEGMENT_NAMES, values, strict=True):
                    rows[n].append(v)
            ids = batch.column(0).slice(lo, n_docs)
            about = (
                int(block % (1 << bits)) if bits else 0, block, n_docs, None, None, None,
                _pack_ids(ids), sizes.astype("<i8").tobytes(),
                np.bincount(doc[many], minlength=n_docs).astype("<i8").tobytes(), digests,
            )
            for n, v in zip(SEGMENT_NAMES, about, strict=True):
                rows[n].append(v)
            yield pa.record_batch([pa.array(rows[f.name], f.type) for f in SEGMENT_SCHEMA], schema=SEGMENT_SCHEMA)
            block += 1


def _pack_ids(ids: pa.Array) -> bytes:
    valid = np.array(ids.is_valid())
    return np.array(ids.fill_null(0), "<i8").tobytes() + valid.tobytes()


PARTIAL = "block long, n_docs int, counts binary, ids binary, sizes binary, digests binary"
PARTIAL_NAMES = [c.split()[0] for c in PARTIAL.split(", ")]
PARTIAL_TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _count_fragment(rows: list[dict]) -> list[tuple]:
    """How many n-grams of each document other documents have too, within one fragment."""
    owned = [np.frombuffer(r["hashes"], np.uint32) for r in rows]
    shared = [np.frombuffer(r["shared"], np.uint32) for r in rows]
    n = sum(map(len, owned))
    values = np.concatenate([*owned, *shared, *shared])  # twice: one of these suffices
    order = np.argsort(values)
    same = np.zeros(len(values), bool)
    same[1:] = values[order][1:] == values[order][:-1]
    same[:-1] |= same[1:]
    hit = np.zeros(len(values), bool)
    hit[order] = same
    out, at = [], 0
    for r, own in zip(rows, owned, strict=True):
        owner = np.cumsum(np.frombuffer(r["owners"], np.uint16 if r["n_docs"] < 65536 else np.uint32).astype(np.int64))
        counts = np.bincount(owner[hit[at : at + len(own)]], minlength=r["n_docs"])
        at += len(own)
        if counts.any():
            out.append((r["block"], r["n_docs"], counts.astype("<u4").tobytes(), None, None, None))
    assert at == n
    return out


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for lo in range(0, batch.num_rows, 64):
        yield from batch.slice(lo, 64).to_pylist()


def _partial_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in PARTIAL_NAMES]
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, PARTIAL_TYPES, strict=True)], PARTIAL_NAMES)


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by fragment; what is about documents passes through."""
    held, key = [], None
    for batch in batches:
        out = []
        for r in _rows(batch):
            if r["ids"] is not None:
                out.append((r["block"], r["n_docs"], np.frombuffer(r["local"], "<i8").astype("<u4").tobytes(), r["ids"], r["sizes"], r["digests"]))
                continue
            if r["key"] != key and held:
                out += _count_fragment(held)
                held = []
            key = r["key"]
            held.append(r)
        if out:
            yield _partial_batch(out)
    if held:
        yield _partial_batch(_count_fragment(held))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the fragments' counts of each block; rows come sorted by block."""

    def finish(total, about):
        n = len(total)
        ids = np.frombuffer(about["ids"][: 8 * n], "<i8")
        valid = np.frombuffer(about["ids"][8 * n :], bool)
        d = about["digests"]
        return pa.record_batch(
            [pa.array(ids, mask=~valid), pa.array(np.frombuffer(about["sizes"], "<i8")), pa.array(total), pa.array([d[i * 16 : i * 16 + 16] for i in range(n)], pa.binary())],
            ["doc_id", "n_shingles", "n_shared", "digest"],
        )

    block, total, about = None, None, None
    for batch in batches:
        for r in _rows(batch):
            if r["block"] != block:
                if block is not None:
                    yield finish(total, about)
                block, total, about = r["block"], np.zeros(r["n_docs"], np.int64), None
            total += np.frombuffer(r["counts"], "<u4")
            about = r if r["ids"] is not None else about
    if block is not None:
        yield finish(total, about)


def shared_counts(docs: DataFrame, k: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, n_shared (those that another row has too), digest of the set."""
    parts = shuffle_partitions(docs.sparkSession)
    bits = max(0, min(24, (2 * parts - 1).bit_length()))
    segments = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(lambda it: _segments(it, k, bits)), SEGMENT)
    counted = segments.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(lean(_fragments), PARTIAL)
    summed = counted.repartition(parts, "block").sortWithinPartitions("block")
    return summed.mapInArrow(lean(_blocks), "doc_id long, n_shingles long, n_shared long, digest binary")


def _digests(h: np.ndarray, cut: np.ndarray) -> list[bytes]:
    return [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, raw, offsets in chunks(batch.column(0), BLOCK_BYTES // 4):
            doc, h = shingles(raw, offsets, k)
            sizes = np.bincount(doc, minlength=hi - lo)
            cut = np.concatenate([[0], np.cumsum(sizes)])
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(h.view(np.int64)))
            yield pa.record_batch([pa.array(_digests(h, cut), pa.binary()), pa.array(sizes.astype(np.int64)), lists], ["digest", "n", "hashes"])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A parity bitmap of about 16 bits an n-gram, a power of two of them."""
    for batch in batches:
        out = []
        for row in batch.column("hashes"):
            h = mix(row.values.to_numpy(zero_copy_only=False).view(np.uint64))
            size = 1 << max(9, (16 * len(h) - 1).bit_length())
            odd = (np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(bool)
            out.append(np.packbits(odd, bitorder="little").tobytes())
        names = [n for n in batch.schema.names if n != "hashes"]
        yield pa.record_batch([*(batch.column(n) for n in names), pa.array(out, pa.binary())], [*names, "bitmap"])


def _by_gram(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct n-grams, a document of each) and, for each row in the order of n-grams, the document of its n-gram."""
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(new)
    return h[at], doc[at], doc[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]


def _sorted_grams(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    doc, h = batch.column("u").to_numpy(), batch.column("h").to_numpy()
    order = np.lexsort((doc, h))
    return doc[order], h[order]


def _near_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before the exchange by n-gram: each batch's documents that share one as a forest (h null), and one row (u, h)
    for each of its n-grams. So an n-gram of however many documents costs the exchange one row a batch."""
    for batch in batches:
        doc, h = _sorted_grams(batch)
        grams, of, first = _by_gram(doc, h)
        nodes, label = local_components(doc, first)
        moved = nodes != label
        u = np.concatenate([nodes[moved], label[np.searchsorted(nodes, of)]])
        null = np.arange(len(u)) < moved.sum()
        v = np.concatenate([label[moved], np.zeros(len(of), np.int64)])
        yield pa.record_batch([pa.array(u), pa.array(v, mask=~null), pa.array(np.concatenate([np.zeros(moved.sum(), np.int64), grams]), mask=null)], ["u", "v", "h"])


def _prefix_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of the documents of each partition that share an n-gram; rows of one n-gram are in one partition."""
    held = list(batches)
    if held:
        table = pa.Table.from_batches(held)
        linked = pc.is_null(table["h"])
        edges = table.filter(linked)
        doc, h = _sorted_grams(table.filter(pc.invert(linked)))
        u, v = np.concatenate([edges["u"].to_numpy(), doc]), np.concatenate([edges["v"].to_numpy(), _by_gram(doc, h)[2]])
        nodes, label = local_components(u, v)
        yield pa.record_batch([pa.array(nodes), pa.array(label)], ["u", "v"])


def _fold(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (a row each) folded to ``words`` words."""
    return np.bitwise_xor.reduce(maps.reshape(len(maps), -1, words), axis=1)


class _Forest:
    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up.setdefault(y, y)
        return x

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


#: What a row is in its tile: of its left or right side, of a tile that has only one, or a pair that failed.
LEFT, RIGHT, OWN, FAILED = range(4)


def _propose(table: pa.Table, percent: int, forests: int) -> pa.Table:
    """Pairs of a tile that may link and would connect components, the most alike first, as disjoint spanning forests."""
    side, doc, n = (table[c].to_numpy() for c in ("side", "doc_id", "n"))
    label, other = table["label"].to_numpy(), table["other"].to_numpy()
    barred = {(int(a), int(b)) for a, b in zip(doc[side == FAILED], other[side == FAILED], strict=True)}
    out_a, out_b, found = [], [], []
    own = np.flatnonzero(side == OWN)
    left, right = (own, own) if len(own) else (np.flatnonzero(side == LEFT), np.flatnonzero(side == RIGHT))
    if len(left) and len(right) and len(np.unique(label[np.concatenate([left, right])])) > 1:
        maps = table["bitmap"].combine_chunks()
        words = np.zeros(len(doc), np.int64)
        words[side != FAILED] = [len(maps[int(i)].as_buffer()) // 8 for i in np.flatnonzero(side != FAILED)]
        stacked = {(id(rows), w): np.stack([np.frombuffer(maps[int(i)].as_buffer(), np.uint64) for i in rows[words[rows] == w]]) for rows in (left, right) for w in np.unique(words[rows]).tolist()}
        for w1 in np.unique(words[left]).tolist():
            for w2 in np.unique(words[right]).tolist():
                if max(w1, w2) * percent > 200 * min(w1, w2):  # sizes that far apart can't link
                    continue
                l, r, w = left[words[left] == w1], right[words[right] == w2], min(w1, w2)
                x, y = _fold(stacked[id(left), w1], w), _fold(stacked[id(right), w2], w)
                for i, a in enumerate(l):
                    to = np.flatnonzero((label[r] != label[a]) & (100 * np.minimum(n[a], n[r]) >= percent * np.maximum(n[a], n[r])))
                    if len(own):
                        to = to[doc[r[to]] > doc[a]] if w1 == w2 else to if w1 < w2 else to[:0]
                    if len(to):
                        apart = np.bitwise_count(y[to] ^ x[i]).sum(axis=1, dtype=np.int64)
                        b, total = r[to], n[a] + n[r[to]]
                        ok = apart * (100 + percent) <= total * (100 - percent)
                        found += [(d / t, min(doc[a], doc[j]), max(doc[a], doc[j]), label[a], label[j]) for d, t, j in zip(apart[ok], total[ok], b[ok], strict=True)]
        found = [e for e in sorted(found) if (int(e[1]), int(e[2])) not in barred]
        for _ in range(forests):
            forest, rest = _Forest(), []
            for edge in found:
                if forest.join(edge[3], edge[4]):
                    out_a.append(edge[1])
                    out_b.append(edge[2])
                else:
                    rest.append(edge)
            found = rest
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def _proposer(percent: int, forests: int):
    return lambda table: _propose(table, percent, forests)


def _by_group(rows: DataFrame, info: DataFrame) -> DataFrame:
    """``rows`` with their group's row of ``info`` (both: grp, heavy); the few heavy groups' rows don't move."""
    light, heavy = info.where("NOT heavy").drop("heavy"), info.where("heavy").drop("heavy")
    return rows.where("NOT heavy").join(light, "grp").unionByName(rows.where("heavy").join(F.broadcast(heavy), "grp"))


def _band(percent: int):
    """Sizes within the threshold's ratio are in one band or in neighbouring ones."""
    return F.floor(F.log(F.col("n").cast("double")) / (F.log(F.lit(100.0 / percent)) + 1e-9)).cast("int")


TILE = "struct<grp: bigint, k1: int, c1: int, k2: int, c2: int>"


def _tiles(rows: DataFrame, tile_rows: int) -> DataFrame:
    """The rows of large groups (doc_id, n, grp, heavy, band, open and others) with tile and side, one for each tile that
    they belong to: every pair of one band or neighbouring ones of which one at least is open is in a tile.

    The open documents of a band, and the others, are dealt by hash into cells of about ``tile_rows``; a pair of cells is
    a tile.
    """
    kinds = rows.withColumn("kind", 2 * F.col("band") + F.when(F.col("open"), 0).otherwise(1))
    counts = kinds.groupBy("grp", "heavy", "kind").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("n_cells"))
    info = counts.groupBy("grp", "heavy").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n_cells"))).alias("cells"))
    kind, cell = F.col("kind"), F.col("cell")

    def upto(k):
        n = F.coalesce(F.try_element_at("cells", k), F.lit(0))
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def tile(side, k1, c1, k2, c2):
        return F.struct(F.lit(side).alias("side"), F.struct("grp", k1.alias("k1"), c1.alias("c1"), k2.alias("k2"), c2.alias("c2")).cast(TILE).alias("tile"))

    def on(k, left):
        """The tiles with each cell of kind ``k``."""
        return F.transform(upto(k), lambda c: tile(LEFT, kind, cell, k, c) if left else tile(RIGHT, k, c, kind, cell))

    own = F.transform(upto(kind), lambda c: F.when(c < cell, tile(RIGHT, kind, c, kind, cell)).when(c > cell, tile(LEFT, kind, cell, kind, c)).otherwise(tile(OWN, kind, cell, kind, c)))
    of_open = F.concat(own, on(kind + 1, True), on(kind + 2, True), on(kind + 3, True), on(kind - 2, False), on(kind - 1, False))
    of_rest = F.concat(on(kind - 1, False), on(kind + 1, True), on(kind - 3, False))
    joined = _by_group(kinds, info).withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.try_element_at("cells", kind)).cast("int"))
    return joined.withColumn("t", F.explode(F.when(F.col("open"), of_open).otherwise(of_rest))).select("t.tile", "t.side", "doc_id", "n", "bitmap")


def _beside(pairs: DataFrame, segments: DataFrame, end: str) -> DataFrame:
    """``pairs`` with the segments of the documents at one ``end``. A document of many pairs is copied, so that none of
    its copies meets more than about TILE_ROWS of them."""
    copies = pairs.groupBy(end).agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).cast("int").alias("copies"))
    dealt = pairs.join(copies, end).withColumn("copy", F.pmod(F.xxhash64("a", "b"), "copies").cast("int")).drop("copies")
    copied = segments.withColumnsRenamed({"doc_id": end, "n": f"n{end}", "seg": f"seg_{end}"}).join(copies, end)
    copied = copied.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    return dealt.join(copied, [end, "copy", *(["f"] if "f" in pairs.columns else [])]).drop("copy")


def _overlaps(pairs: DataFrame, sets: DataFrame, cuts: int) -> DataFrame:
    """(a, b, overlap, na, nb): every fragment counts the overlap of its segments separately; the counts are summed per pair."""
    bits = (cuts - 1).bit_length()  # a fragment is a range of the hash order: its top bits
    parts = F.transform(F.sequence(F.lit(0), F.lit(cuts - 1)), lambda f: F.struct(f.alias("f"), F.filter("hashes", lambda h: F.shiftrightunsigned(h, 64 - bits) == f).alias("seg")))
    needed = sets.join(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "doc_id", "left_semi")
    segments = needed.select("doc_id", "n", F.explode(parts).alias("p")).select("doc_id", "n", "p.f", "p.seg")
    both = _beside(_beside(pairs, segments, "a"), segments, "b")
    overlap = F.sum(F.size(F.array_intersect("seg_a", "seg_b"))).alias("overlap")
    return both.groupBy("a", "b").agg(overlap, F.first("na").alias("na"), F.first("nb").alias("nb"))


class _Links:
    """What is known so far: ``labels`` (id, label), a forest of all links found."""

    def __init__(self, sets: DataFrame, percent: int, cuts: int):
        self.sets, self.percent, self.cuts, self.labels = sets, percent, cuts, None

    def labelled(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the label of each doc_id."""
        if self.labels is None:
            return rows.withColumn("label", F.col("doc_id"))
        return rows.join(self.labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))

    def settle(self, tiles: DataFrame, forests: int) -> DataFrame:
        """Propose pairs of the tiles, count their overlaps and merge components: the pairs (a, b) that failed, a table, or
        None if none did."""
        judge = 100 * F.col("overlap") >= self.percent * (F.col("na") + F.col("nb") - F.col("overlap"))
        proposed = write_table(tiles.groupBy("tile").applyInArrow(_proposer(self.percent, forests), "a long, b long").distinct(), "proposed")
        judged = write_table(_overlaps(proposed, self.sets, self.cuts).select("a", "b", judge.alias("link")), "judged")
        drop_table(proposed)
        n = judged.agg(F.count_if("link").alias("good"), F.count_if(~F.col("link")).alias("bad")).first()
        if self.labels is None or n.good:
            before, good = self.labels, judged.where("link").select(F.col("a").alias("u"), F.col("b").alias("v"))
            self.labels = components(good if before is None else good.union(before))
            if before is not None:
                drop_table(before)
        if n.bad:
            return judged
        drop_table(judged)
        return None


def _pivot_rounds(known: _Links, big: DataFrame, tile_rows: int) -> DataFrame:
    """Compare a few pivots with all of each large group while that merges what is left; ``big`` with ``open`` for the
    documents outside their group's largest component."""
    none, before = F.lit(0).cast("long").alias("other"), None
    while True:
        if known.labels is None:
            marked = known.labelled(big).withColumn("open", F.lit(True))
        else:
            rows = known.labelled(big)
            sizes = rows.groupBy("grp", "heavy", "label").agg(F.count(F.lit(1)).alias("size"))
            main = sizes.groupBy("grp", "heavy").agg(F.max_by("label", F.struct("size", "label")).alias("main"))
            marked = _by_group(rows, main).withColumn("open", F.col("label") != F.col("main")).drop("main")
        opens = marked.where("open").groupBy("grp", "heavy", "band").agg(F.count(F.lit(1)).alias("size"))
        left = opens.agg(F.sum("size")).first()[0] or 0
        if not left or before is not None and left > 0.8 * before:
            return marked
        before = left
        per_band = opens.groupBy("grp", "heavy").agg(F.map_from_entries(F.collect_list(F.struct("band", "size"))).alias("sizes"))
        chance = F.pmod(F.xxhash64("doc_id", F.lit(left)), F.lit(1 << 32)) / float(1 << 32)
        pivots = _by_group(marked, per_band).withColumn("open", F.col("open") & (chance * F.try_element_at("sizes", "band") < PIVOTS)).drop("sizes")
        bad = known.settle(known.labelled(_tiles(pivots, tile_rows)).withColumn("other", none), 1)
        if bad is not None:
            drop_table(bad)


def link_components(sets: DataFrame, percent: int, tile_rows: int = TILE_ROWS, cuts: int = CUTS) -> DataFrame:
    """(id, label) of the documents of ``sets`` (doc_id, n, hashes) that link to another."""
    grams = sets.select("doc_id", F.explode("hashes").alias("h"))
    df = grams.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = grams.join(df, "h").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("order"))
    # Unshared n-grams are the rarest: they stand first in the prefix, and lead nowhere.
    first = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("long") + 1 - (F.col("n") - F.size("order"))
    prefix = ranked.join(sets.select("doc_id", "n"), "doc_id").where(first > 0).select(F.col("doc_id").alias("u"), F.explode(F.slice("order", 1, first.cast("int"))).alias("g")).select("u", "g.h")
    near = prefix.mapInArrow(lean(_near_groups), "u long, v long, h long")
    edges = near.repartition(shuffle_partitions(sets.sparkSession), F.coalesce("h", "u")).mapInArrow(lean(_prefix_groups), "u long, v long")
    grouped = components(edges)
    members = sets.join(grouped.select(F.col("id").alias("doc_id"), F.col("label").alias("grp")), "doc_id").select("doc_id", "n", "grp", "hashes")
    placed = write_table(members.mapInArrow(lean(_bitmaps), "doc_id long, n long, grp long, bitmap binary"), "placed")
    sizes = write_table(grouped.groupBy(F.col("label").alias("grp")).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > tile_rows), "sizes")
    drop_table(grouped)
    known, none, spare = _Links(sets, percent, cuts), F.lit(0).cast("long"), [placed, sizes]
    whole = lambda rows: rows.select(F.struct("grp", *(F.lit(0).alias(c) for c in ("k1", "c1", "k2", "c2"))).cast(TILE).alias("tile"), F.lit(OWN).alias("side"), "doc_id", "n", "bitmap")
    if sizes.isEmpty():
        tiles = write_table(whole(placed), "tiles")
    else:
        limit = placed.count() * HEAVY
        heavy = F.broadcast(sizes.where(F.col("size") > limit).select("grp"))
        others = placed.join(heavy, "grp", "left_anti")
        medium = sizes.where(F.col("size") <= limit).select("grp")
        large = placed.join(heavy, "grp", "left_semi").withColumn("heavy", F.lit(True)).unionByName(others.join(medium, "grp", "left_semi").withColumn("heavy", F.lit(False)))
        big = write_table(large.withColumn("band", _band(percent)), "big")
        tiles = write_table(_tiles(_pivot_rounds(known, big, tile_rows), tile_rows).unionByName(whole(others.join(medium, "grp", "left_anti"))), "tiles")
        spare.append(big)
    bad = known.settle(known.labelled(tiles).withColumn("other", none), 1)
    barred = None
    while bad is not None:  # only tiles with a pair that failed can hold more that would connect components
        spare.append(bad)
        barred = bad.where("NOT link").select("a", "b") if barred is None else barred.union(bad.where("NOT link").select("a", "b"))
        failed = tiles.select("tile", F.col("doc_id").alias("a")).join(barred, "a").join(tiles.select("tile", F.col("doc_id").alias("b")), ["tile", "b"]).select("tile", "a", "b").distinct()
        rows = known.labelled(tiles.join(failed.select("tile").distinct(), "tile", "left_semi")).select("tile", "side", "doc_id", "n", "bitmap", "label", none.alias("other"))
        bad = known.settle(rows.union(failed.select("tile", F.lit(FAILED), "a", none, F.lit(None).cast("binary"), none, "b")), 8)
    for table in (*spare, tiles):
        drop_table(table)
    return known.labels


def ngram_join(docs: DataFrame, k: int = 4, percent: int = 85, tile_rows: int = TILE_ROWS, cuts: int = CUTS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, class_id, component_id.

    Two documents link when ``100 * intersection >= percent * union`` of their sets of distinct k-word shingles (words
    ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; with fewer words the whole sequence is the one shingle). class_id is the
    smallest id with an equal set, component_id the smallest that links lead to, both the own id for an empty or null
    text. Rows with a null id keep null for both. Rows with one id and different texts are one document: what any of
    them links to is linked to all of them (class_id stays each text's own). Ids are below 2**62. Texts are taken whole,
    however long. Other columns are left aside; an empty table gives no rows. The result is a table in the shared folder.
    """
    info = write_table(shared_counts(docs, k), "shared")
    may_link = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0) & (100 * F.col("n_shared") >= percent * F.col("n_shingles"))
    rest = info.where(may_link)
    # A set goes by its class's smallest id, and by a fresh one where that stands for another set already.
    classes = rest.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("size"))
    nth = F.row_number().over(W.partitionBy("class_id").orderBy("digest"))
    classes = classes.withColumn("nth", nth).withColumn("node", F.when(F.col("nth") == 1, F.col("class_id")).otherwise(FRESH + F.monotonically_increasing_id())).drop("nth")
    classes = write_table(classes, "classes")
    total = classes.agg(F.sum("size")).first()[0] or 0
    heavy = F.broadcast(classes.where(F.col("size") > HEAVY * total))
    found = rest.join(heavy, "digest").unionByName(rest.join(heavy, "digest", "left_anti").join(classes.where(F.col("size") <= HEAVY * total), "digest"))
    found = write_table(found.select("doc_id", "n_shingles", "class_id", "node", (F.col("size") > HEAVY * total).alias("heavy")), "found")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = text.join(classes.select(F.col("class_id").alias("doc_id")).distinct(), "doc_id", "left_semi").select("text").mapInArrow(lean(lambda it: _sets(it, k)), "digest binary, n long, hashes array<long>")
    sets = sets.dropDuplicates(["digest"]).join(classes.select("digest", "node"), "digest")
    sets = write_table(sets.select(F.col("node").alias("doc_id"), "n", "hashes"), "sets")
    labels = link_components(sets, percent, tile_rows, cuts)
    drop_table(sets)
    ends = found.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("hi")).where("v != hi")
    same = write_table(found.join(ends.select("doc_id", "v"), "doc_id").select(F.col("node").alias("u"), "v").where("u != v").distinct(), "same")
    if not same.isEmpty():
        before, labels = labels, components(labels.select(F.col("id").alias("u"), F.col("label").alias("v")).union(same))
        drop_table(before)
    drop_table(same)
    # A row that can't link is still one document with the other rows of its id.
    own = labels.select(F.col("id").alias("node"), F.col("label").alias("component_id"))
    of_heavy = F.broadcast(own.join(heavy.select("node"), "node", "left_semi"))
    final = found.where("heavy").join(of_heavy, "node", "left").unionByName(found.where("NOT heavy").join(own, "node", "left")).withColumn("component_id", F.coalesce("component_id", "class_id"))
    alone = info.where(~may_link).withColumn("class_id", F.col("doc_id"))
    by_id = final.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    alone = alone.join(by_id, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    columns = ["doc_id", "n_shingles", "class_id", "component_id"]
    out = write_table(alone.select(columns).unionByName(final.select(columns)), "joined")
    for used in (info, classes, found, labels):
        drop_table(used)
    return out


#: The same rows (four words, 85 percent) in DuckDB's SQL.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
),
g AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(ws[p : p + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 2)) AS p FROM w WHERE len(ws) >= 4)
    UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 3)
),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS digest FROM g GROUP BY doc_id),
often AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
f AS (SELECT g.doc_id, g.g FROM g JOIN often USING (g)),
able AS (SELECT f.doc_id FROM f JOIN n USING (doc_id) GROUP BY f.doc_id, n.n HAVING 100 * count(*) >= 85 * n.n),
s AS (SELECT f.* FROM f JOIN able USING (doc_id)),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles,
       coalesce(min(w.doc_id) OVER (PARTITION BY coalesce(n.digest, w.doc_id::VARCHAR)), w.doc_id) AS class_id,
       least(w.doc_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = w.doc_id), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id)
"""
