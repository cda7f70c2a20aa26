"""Operator 13: exact Jaccard join of shingle sets in their metric space."""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, components, partitions, table

#: Sets link when SHARE hundredths of their union are shared: at a Jaccard distance of REACH at most.
SHARE = 80
REACH = 1 - SHARE / 100
#: Rounding of distances, which only widens windows; whole numbers decide on links.
SLACK = 1e-9
#: Shingles of sets that a task compares at once, as one region; regions of fewer sets are compared as they are; pivots of a region.
REGION_SHINGLES, LEAF, PIVOTS = 1 << 20, 24, 8
#: A region is parted again only if its parts' comparisons are fewer than this share of its own.
WORTH = 0.6
NO_ID = -(1 << 63)


def _least(n: int) -> int:
    """Shingles that a set of n shares with any that it links with, at least."""
    return -(-SHARE * n // 100)


# -- sets ------------------------------------------------------------------------------------------

SHINGLE = 5
_ODD = np.random.default_rng(SHINGLE).integers(0, 1 << 64, SHINGLE + 2, dtype=np.uint64) | np.uint64(1)


class _Words(dict):
    """64-bit hashes of words, of a million at a time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 20:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


_hash = _Words().__getitem__


def shingle_set(text: bytes | None) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; a shorter text is one shingle, one without words has none."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hash, words), np.uint64, len(words))
    k = min(len(words), SHINGLE)
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * _ODD[i] + h[i : len(h) - k + 1 + i]
        out ^= out >> np.uint64(32)
    out *= _ODD[SHINGLE]
    return np.unique(out ^ (out >> np.uint64(29)))


def _node(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)


# -- tables of counts by slot, summed over all tasks -------------------------------------------------

SLICE = 1 << 14


def _packed(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(slice, packed counts) of the slices that hold any."""
    pack = zstandard.ZstdCompressor().compress
    for k, part in enumerate(counts.reshape(-1, min(SLICE, len(counts)))):
        if part.any():
            yield k, pack(part.astype(np.uint32).tobytes())


def _summed(parts: DataFrame, slots: int) -> np.ndarray:
    """The sums of what tasks have packed (slice, packed), on the driver: 8 bytes a slot, of a bounded number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for b in batches:
            for k, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != now and now is not None:
                    yield pa.RecordBatch.from_pydict({"slice": pa.array([now], pa.int32()), "packed": [zstandard.ZstdCompressor().compress(total.tobytes())]})
                part = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint32).astype(np.int64)
                now, total = k, part if k != now else total + part
        if now is not None:
            yield pa.RecordBatch.from_pydict({"slice": pa.array([now], pa.int32()), "packed": [zstandard.ZstdCompressor().compress(total.tobytes())]})

    dealt = parts.repartition(max(1, min(partitions(parts), slots // SLICE)), "slice").sortWithinPartitions("slice")
    out = np.zeros((max(1, slots // SLICE), min(SLICE, slots)), np.int64)
    for k, raw in dealt.mapInArrow(run, "slice int, packed binary").collect():
        out[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(raw)), np.int64)
    return out.ravel()


def _slots(items: int, each: float, most: int) -> int:
    return 1 << min(most, max(10, math.ceil(math.log2(items / each + 1))))


# -- which sets can be near each other -------------------------------------------------------------


def sketched(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, text_hash, node, n) of every document, and how often the shingles of each cell occur.

    node is a hash of the set, n its size.  A cell is what shingles have in
    common in their first bits; there are some 64 shingles to one, and 2^20
    cells at most.  All documents count.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = _slots(size // 6, 64, 20)
    shift = np.uint64(65 - cells.bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, kept = np.zeros(cells, np.int64), [], 0
        for b in batches:
            nodes, sizes = [], []
            for t in b.column(2):
                s = shingle_set(t.as_buffer().to_pybytes() if t.is_valid else None)
                nodes.append(_node(s))
                sizes.append(len(s))
                held.append(s >> shift)
                kept += len(s)
                if kept > 1 << 20:
                    counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=cells)
                    held, kept = [], 0
            none = [pa.nulls(b.num_rows, k) for k in (pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), *none], names=names)
        if held:
            counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=cells)
        for k, raw in _packed(counts):
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 4, pa.array([k], pa.int32()), pa.array([raw], pa.binary())], names=names)

    names = ["doc_id", "text_hash", "node", "n", "slice", "packed"]
    found = checkpoint(docs.select("doc_id", "text_hash", "text").mapInArrow(run, "doc_id long, text_hash long, node long, n long, slice int, packed binary"))
    return found.where("slice is null").select(*names[:4]), _summed(found.where("slice is not null").select("slice", "packed"), cells)


def ordered(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set's shingles, those of rare cells first: one order for all sets."""
    return found[np.lexsort((found, counts[(found >> np.uint64(65 - len(counts).bit_length())).astype(np.int64)]))]


def keys(docs: DataFrame, counts: Broadcast) -> DataFrame:
    """key, node, n, at (the key's place in the set's order) of the sets of all documents.

    Sets that link share _least(n) shingles, so at least one is among the first
    n - _least(n) + 1 of each, in whatever order is common to all: the keys.  A
    set that a task has just met again, in a copy, is not given again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for b in batches:
            nodes, found = [], []
            for t in b.column(0):
                s = shingle_set(t.as_buffer().to_pybytes() if t.is_valid else None)
                node = _node(s)
                if not len(s) or node in met:
                    continue
                if len(met) >= 1 << 17:
                    met.clear()
                met.add(node)
                nodes.append((node, len(s)))
                found.append(ordered(s, counts.value)[: len(s) - _least(len(s)) + 1].view(np.int64))
            if nodes:
                each = np.array([len(f) for f in found])
                own = np.repeat(np.array(nodes, np.int64), each, axis=0)
                at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                cols = [pa.array(np.concatenate(found)), pa.array(own[:, 0].copy()), pa.array(own[:, 1].astype(np.int32)), pa.array(at.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "node", "n", "at"])

    return docs.select("text").mapInArrow(run, "key long, node long, n int, at int")


#: Of more sets than this that have a key in common, all are kept.
BUCKET = 64


def _viable(n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of sets that have a key in common: which could link with another if it were the first they share."""
    shared = np.minimum((n - at)[:, None], (n - at)[None, :])
    both = (100 + SHARE) * shared >= SHARE * (n[:, None] + n[None, :])
    np.fill_diagonal(both, False)
    return both.any(1)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, n, at) by key and node -> region (the least node of those that have the key), node, key."""
    held = [np.zeros(0, np.int64) for _ in range(4)]
    large: tuple[int, int] | None = None  # key and least node of a bucket above BUCKET, whose further rows are passed on

    def given(parts: list[tuple[int, np.ndarray, int]]) -> pa.RecordBatch:
        region = np.concatenate([np.full(len(node), r) for r, node, _ in parts])
        key = np.concatenate([np.full(len(node), k) for _, node, k in parts])
        return pa.RecordBatch.from_arrays([pa.array(region), pa.array(np.concatenate([node for _, node, _ in parts])), pa.array(key)], names=["region", "node", "key"])

    def closed(cols: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, int]]:
        key, node, n, at = cols
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        for i, m in zip(start[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            own = slice(i, i + m)
            stay = node[own][_viable(n[own], at[own])] if m <= BUCKET else node[own]
            if len(stay) > 1:
                yield int(stay[0]), stay, int(key[i])

    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.concatenate([h, c.to_numpy().astype(np.int64)]) for h, c in zip(held, b.columns, strict=True)]
        new = np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])]
        cols = [c[new] for c in cols]  # copies that several tasks have met
        parts = []
        if large is not None:
            more = int(np.searchsorted(cols[0] != large[0], True)) if (cols[0] != large[0]).any() else len(cols[0])
            if more:
                parts.append((large[1], cols[1][:more], large[0]))
            cols = [c[more:] for c in cols]
            large = large if not len(cols[0]) else None
        last = int(np.argmax(cols[0] == cols[0][-1])) if len(cols[0]) else 0
        parts += closed([c[:last] for c in cols]) if last else []
        held = [c[last:] for c in cols]
        if len(held[0]) > BUCKET:
            large = (int(held[0][0]), int(held[1][0]))
            parts.append((large[1], held[1], large[0]))
            held = [h[:0] for h in held]
        if parts:
            yield given(parts)
    parts = list(closed(held)) if len(held[0]) > 1 else []
    if parts:
        yield given(parts)


def balls(rows: DataFrame) -> DataFrame:
    """region, node, keys: the sets round each pivot, and by which of its keys each is there; rows: key, node, n, at.

    Unrelated sets are all at a distance of 1 or nearly so from each other, and
    so from any pivot: windows of a Voronoi partition of the whole table would
    hold all of it.  So the first regions are open balls of radius 1: sets that
    have a key are gathered round the least of them, their pivot, whose distance
    to each is below 1, as they share that shingle.  Every two sets that link
    have a key in common, the first shingle they share, and with it a ball.
    Sets whose sizes and places of the key rule that out for all others stay away.
    """
    met = rows.repartition(partitions(rows), "key").sortWithinPartitions("key", "node").mapInArrow(_buckets, "region long, node long, key long")
    return met.groupBy("region", "node").agg(F.collect_set("key").alias("keys"))


def candidate_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, hash, packed: the texts of `wanted` (id, hash, distinct), packed, each once, and a few others.

    A table of bits, of 2^24 at most and of eight for each text where that is
    enough, tells most other texts before anything is sent.
    """
    slots = _slots(wanted.count(), 1 / 8, 24)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(slots, bool)
        for b in batches:
            bits[b.column(0).to_numpy()] = True
        for k, raw in _packed(bits):
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "packed": pa.array([raw], pa.binary())})

    slot = F.pmod(F.xxhash64("id", "hash"), F.lit(slots))
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(_summed(wanted.select(slot).mapInArrow(marked, "slice int, packed binary"), slots) > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            at = b.column(3).to_numpy()
            rows = np.flatnonzero((bits.value[at >> 3] >> (7 - (at & 7))) & 1)
            packed = [pack(b.column(2)[k].as_buffer().to_pybytes()) for k in rows.tolist()]
            own = pa.array(rows)
            yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), pa.array(packed, pa.binary())], names=["id", "hash", "packed"])

    texts = docs.where("text is not null").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("text_hash").alias("hash"), "text")
    return texts.withColumn("slot", slot).mapInArrow(run, "id long, hash long, packed binary").dropDuplicates(["id", "hash"])


def _opened(packed: bytes) -> np.ndarray:
    return shingle_set(zstandard.ZstdDecompressor().decompress(packed))


# -- one region in a task --------------------------------------------------------------------------


class Region:
    """Sets of one region, and what their links come to: `linked`, documents that each links with, and a spanning forest."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], owned: list[np.ndarray], copies: np.ndarray, guest: np.ndarray, side: np.ndarray | None):
        #: owned: which of a set's shingles (all in the common order) brought it here; side: part of each, where only pairs across parts count.
        self.ids, self.owned, self.copies, self.guest, self.side = ids, owned, copies, guest, side
        words, code = np.unique(np.concatenate(sets), return_inverse=True)
        self.size = np.array([len(s) for s in sets])
        self.own = np.split(code, np.cumsum(self.size)[:-1])
        self.mark = np.zeros(len(words), np.int32)
        self.linked, self.tree, self.edges = np.zeros(len(ids), np.int64), np.arange(len(ids)), []

    def distances(self, x: int, flat: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
        self.mark[self.own[x]] = 1
        shared = np.add.reduceat(self.mark[flat], at)
        self.mark[self.own[x]] = 0
        return 1 - shared / (self.size[own] + self.size[x] - shared)

    def parted(self, own: np.ndarray, guest: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Voronoi regions of some of its sets as pivots, with their windows; None if that isn't worth it.

        Each set belongs to its nearest pivot.  One that links with it is nearer
        to that pivot than the region's radius and REACH, and by 2 REACH at most
        further from it than from its own: such are guests there.  Of a pair,
        the set of smaller id must not be a guest, so that it counts once.
        """
        flat = np.concatenate([self.own[k] for k in own])
        at = np.cumsum(self.size[own]) - self.size[own]
        pivots = own[np.unique(np.linspace(0, len(own) - 1, PIVOTS).astype(int))]
        d = np.stack([self.distances(p, flat, at, own) for p in pivots])
        home, near = d.argmin(0), d.min(0)
        out = []
        for k in range(len(pivots)):
            core = home == k
            radius = near[core].max(initial=0)
            visits = ~core & (d[k] <= near + 2 * REACH + SLACK) & (d[k] <= radius + REACH + SLACK)
            both = core | visits
            out.append((own[both], (guest | visits)[both]))
        return out if sum(len(o) ** 2 for o, _ in out) <= WORTH * len(own) ** 2 else None

    def compare(self, own: np.ndarray, guest: np.ndarray) -> None:
        """All pairs of sizes that can link, one set against many at a time."""
        order = np.argsort(self.size[own], kind="stable")
        own, guest = own[order], guest[order]
        size, ids = self.size[own], self.ids[own]
        flat, end = np.concatenate([self.own[k] for k in own]), np.cumsum(size)
        upto = np.searchsorted(size, 100 * size // SHARE, side="right")
        for k, x in enumerate(own):
            lo, hi = k + 1, int(upto[k])
            if lo >= hi:
                continue
            self.mark[self.own[x]] = np.arange(1, size[k] + 1)
            place = self.mark[flat[end[k] : end[hi - 1]]]
            self.mark[self.own[x]] = 0
            at = end[k : hi - 1] - end[k]
            shared = np.add.reduceat(place > 0, at, dtype=np.int64)
            near = 100 * shared >= SHARE * (size[k] + size[lo:hi] - shared)
            near &= ~np.where(ids[lo:hi] < ids[k], guest[lo:hi], guest[k])
            if self.side is not None:
                near &= self.side[own[lo:hi]] != self.side[x]
            if near.any():
                # the pair counts in the ball of the first shingle it shares, alone
                first = np.minimum.reduceat(np.where(place > 0, place, np.iinfo(np.int32).max), at)
                near[near] = self.owned[x][first[near] - 1]
                self.link(x, own[lo:hi][near])

    def link(self, x: int, others: np.ndarray) -> None:
        self.linked[x] += self.copies[others].sum()
        self.linked[others] += self.copies[x]
        trees = self.tree[others]
        for t, k in zip(*np.unique(trees, return_index=True), strict=True):
            if t != self.tree[x]:
                self.edges.append((int(self.ids[x]), int(self.ids[others[k]])))
                self.tree[self.tree == t] = self.tree[x]

    def join(self) -> None:
        stack = [(np.arange(len(self.ids)), self.guest)]
        while stack:
            own, guest = stack.pop()
            if guest.all():
                continue
            parts = self.parted(own, guest) if len(own) > LEAF else None
            if parts is None:
                self.compare(own, guest)
            else:
                stack += parts


def _joined(batches: Iterator[pa.RecordBatch], counts: Broadcast) -> Iterator[pa.RecordBatch]:
    """Rows (region, part, mixed, own, node, guest, copies, keys, packed) by region and part -> a, b, linked: edges, and (node, null, documents it links with)."""
    held: list[tuple] = []

    def close() -> tuple[list, list, list]:
        _, _, mixed, own, ids, guest, copies, keys, texts = zip(*held, strict=True)
        held.clear()
        sets = [ordered(_opened(t), counts.value) for t in texts]
        owned = [np.isin(s, np.array(k, np.int64).view(np.uint64)) for s, k in zip(sets, keys, strict=True)]
        side = np.array(own) if mixed[0] else None
        r = Region(np.array(ids, np.int64), sets, owned, np.array(copies, np.int64), np.array(guest), side)
        r.join()
        some = np.flatnonzero(r.linked)
        a = [*(e[0] for e in r.edges), *r.ids[some].tolist()]
        return a, [*(e[1] for e in r.edges), *[None] * len(some)], [*[0] * len(r.edges), *r.linked[some].tolist()]

    group = None
    for batch in batches:
        found: list[tuple[list, list, list]] = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:2] != group:
                if len(held) > 1:
                    found.append(close())
                held.clear()
                group = row[:2]
            held.append(row)
        if found:
            a, b, n = ([x for f in found for x in f[k]] for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], names=["a", "b", "linked"])
    if len(held) > 1:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in close()], names=["a", "b", "linked"])


# -- regions too large for a task ------------------------------------------------------------------


def _parted(rows: DataFrame, texts: DataFrame, turn: int) -> DataFrame:
    """Rows (region, volume, node, n, guest, id, hash, keys, copies) in the Voronoi regions of some pivots of each region, `parent` beside them."""
    chance = F.pmod(F.xxhash64("node", "region", F.lit(turn)), F.lit(1 << 30)) * F.col("members") < F.lit(PIVOTS << 30)
    counted = rows.join(rows.groupBy("region").agg(F.count("*").alias("members")), "region")
    chosen = texts.join(counted.where(chance).select("region", "id", "hash", F.col("node").alias("pivot")), ["id", "hash"])
    # PIVOTS texts for a region, more or less
    pivots = chosen.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("pivot", "packed"))).alias("pivots"))
    names = ["region", "volume", "node", "n", "guest", "id", "hash", "keys", "copies"]
    met = texts.join(rows, ["id", "hash"]).select(*names, "packed").join(pivots, "region")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, found = None, []
        for b in batches:
            take, parent, pivot, visits = [], [], [], []
            for k, (now, text) in enumerate(zip(b.column(0).to_pylist(), b.column(9), strict=True)):
                if now != region:
                    region, found = now, [(p["pivot"], _opened(p["packed"])) for p in b.column(10)[k].as_py()]
                s = _opened(text.as_py())
                shared = np.array([len(np.intersect1d(s, p, assume_unique=True)) for _, p in found])
                d = 1 - shared / (len(s) + np.array([len(p) for _, p in found]) - shared)
                home = int(d.argmin())
                for j in np.flatnonzero(d <= d[home] + 2 * REACH + SLACK).tolist():
                    take.append(k)
                    parent.append(now)
                    pivot.append(found[j][0])
                    visits.append(j != home)
            cols = [b.column(k).take(pa.array(take, pa.int64())) for k in range(9)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(pivot, pa.int64()), pa.array(visits, pa.bool_())], names=[*names, "pivot", "visits"])

    kinds = "region long, volume long, node long, n long, guest boolean, id long, hash long, keys array<long>, copies long"
    out = met.mapInArrow(run, f"{kinds}, pivot long, visits boolean")
    out = out.withColumn("guest", F.col("guest") | F.col("visits")).withColumn("parent", F.col("region"))
    return out.withColumn("region", F.xxhash64("region", "pivot")).drop("pivot", "visits")


def _regions(rows: DataFrame, texts: DataFrame, turns: int = 6) -> DataFrame:
    """Rows (region, node, n, guest, id, hash, keys, copies) in regions of REGION_SHINGLES at most, larger ones parted, with part, mixed, own.

    Regions are parted round pivots again and again, as long as that leaves less
    to compare.  What stays too large is cut into parts by node, and every two
    parts meet as a region of their own.
    """
    rows = rows.join(rows.groupBy("region").agg(F.sum("n").alias("volume")), "region")
    large = F.col("volume") > REGION_SHINGLES
    done, open_ = rows.where(~large), rows.where(large)
    for turn in range(turns):
        if not open_.head(1):
            break
        parts = checkpoint(_parted(open_, texts, turn))
        volumes = parts.groupBy("parent", "region").agg(F.sum("n").alias("own"), F.max("volume").alias("volume"))
        square = F.sum(F.col("own").cast("double") * F.col("own"))
        worth = volumes.groupBy("parent").agg((square <= WORTH * F.max(F.col("volume").cast("double") * F.col("volume"))).alias("worth"))
        # regions without a pivot are tried again
        kept = open_.join(worth.select(F.col("parent").alias("region"), "worth"), "region", "left")
        finer = parts.join(worth.where("worth").select("parent"), "parent", "left_semi").drop("volume")
        finer = finer.join(volumes.select("parent", "region", F.col("own").alias("volume")), ["parent", "region"]).select(*rows.columns)
        done = done.unionByName(kept.where("worth = false").drop("worth")).unionByName(finer.where(~large))
        open_ = checkpoint(kept.where("worth is null").drop("worth").unionByName(finer.where(large)))
    rows = done.unionByName(open_)
    parts = F.ceil(F.col("volume") / REGION_SHINGLES).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    pair = F.transform(F.sequence(F.lit(0), parts - 1), lambda o: F.least(o, own) * parts + F.greatest(o, own))
    return rows.withColumn("own", own).withColumn("parts", parts).withColumn("part", F.explode(pair)).withColumn("mixed", F.floor(F.col("part") / F.col("parts")) != F.col("part") % F.col("parts"))


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every document.

    A document's set are its distinct five-word shingles (A-Z lower-cased; with
    fewer words, all of them as one).  Two documents link when SHARE hundredths
    of their union are shared; component_id is the smallest doc_id reachable by
    links, itself included, and n_links the number of other documents it links
    with.  The join is exact.  Null and empty texts, and those without words,
    have no set and link with nothing; equal texts link; rows that repeat are
    documents of their own that link; null doc_ids are never the smallest (a
    component of such alone has a null one).  An empty table gives none; other
    columns, of any name, are left out.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    sets, cells = sketched(source)
    counts = spark.sparkContext.broadcast(cells)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    some = sets.where("n > 0")
    nodes = checkpoint(some.groupBy("node").agg(F.min("n").alias("n"), F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.min(order).alias("least")))
    where = [F.coalesce("least.doc_id", F.lit(NO_ID)).alias("id"), F.col("least.text_hash").alias("hash")]
    rows = balls(keys(source, counts)).join(nodes.select("node", "n", "copies", *where), "node")
    rows = checkpoint(rows.select("region", "node", "n", F.lit(False).alias("guest"), "id", "hash", "keys", "copies"))
    texts = candidate_texts(source, rows.select("id", "hash").distinct())
    dealt = _regions(rows, texts)
    met = texts.join(dealt, ["id", "hash"]).select("region", "part", "mixed", "own", "node", "guest", "copies", "keys", "packed")
    parts = max(partitions(docs), math.ceil((dealt.agg(F.sum("n")).first()[0] or 0) / REGION_SHINGLES))
    run = met.repartition(parts, "region", "part").sortWithinPartitions("region", "part").mapInArrow(lambda it: _joined(it, counts), "a long, b long, linked long")
    found = checkpoint(run)
    linked = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("linked").alias("linked"))
    trees = components(found.where("b is not null").select("a", "b"))
    placed = nodes.select("node", "copies", "first").join(trees, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    known = placed.join(least, "root").join(linked, "node", "left").select("node", "component_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    full = some.select("doc_id", "node", F.col("n").alias("n_shingles")).join(known, "node").select("doc_id", "n_shingles", "component_id", "n_links")
    none = sets.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return full.unionByName(none)


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


#: Every pair that shares a shingle, counted; then whatever can be reached.
OP13_SQL = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(greatest(len(w) - 4, 0)), lambda i: array_to_string(w[i + 1:i + 5], ' ')) END) AS g FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= {SHARE} * (x.n + y.n - c)),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS c FROM e GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, m)::BIGINT AS component_id, coalesce(c, 0)::BIGINT AS n_links
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN least ON d.doc_id = least.a LEFT JOIN links ON d.doc_id = links.a
"""
